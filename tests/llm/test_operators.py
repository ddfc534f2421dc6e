"""Each operator on small tables: results against a plain version, and the awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, cover_tree, exact_dedup, fuzzy_lines, lsh_forest, mixing, queries, secrets, sharding, token_lengths, toxicity
from tidewatch.llm.common import components

RANKS, PATTERN = queries.RANKS, queries.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, size string, score string, _key string, _row string, _text string, line string, v string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with further columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "k", "z", "c", "y", "r", "t", "l", "v") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (None, "same text here"), (5, "x" * 300_000), (6, " \n\t\n"), (7, "word " * 40_000)]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(RANKS), PATTERN)


def test_components_follow_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Exact dedup


def test_chunks_join_to_the_text_and_depend_on_content():
    data = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    chunks = list(exact_dedup.chunks_of(data))
    assert b"".join(chunks) == data and max(map(len, chunks)) <= exact_dedup.MAX_CHUNK
    moved = set(exact_dedup.chunks_of(b"some words in front" + data))
    assert len(moved & set(chunks)) > 0.8 * len(chunks)
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"a" * 100_000)[-1] == 100_000


@pytest.mark.parametrize("id_bytes", [exact_dedup.ID_BYTES, 1])
def test_exact_groups_match_a_plain_grouping(spark, id_bytes):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 5, 700, 9_000]))) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(200)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, rows), id_bytes=id_bytes).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    for i, t in rows:
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_of_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    got = exact_dedup.exact_groups(d).collect()
    assert len(got) == len(AWKWARD)
    same = [r for r in got if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {4} and sum(r.kept for r in same) == 1
    assert {r.doc_id: r.kept for r in got if r.doc_id in (1, 2)} == {1: False, 2: True}
    left = exact_dedup.without_copies(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 7]
    assert exact_dedup.without_copies(d.limit(0)).count() == 0


# N-gram Jaccard join


def near_plain(rows, threshold):
    sets = [set(lsh_forest.shingles(t or "").tolist()) for _, t in rows]
    links = {i: [j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))}
    seen, out = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], set()
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += links[x]
            for x in group:
                seen[x] = min(rows[y][0] for y in group)
        out[rows[i][0]] = (len(links[i]), seen[i])
    return out


def test_near_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "PAGE_DOCS", 8)  # many pages in one cluster
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) + 10, rng.choice([" ", "  ", ", "]).join(words)))
    want = near_plain(rows, 0.8)
    got = {r.doc_id: r for r in lsh_forest.near_groups(docs(spark, rows)).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_groups_of_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    got = lsh_forest.near_groups(d).collect()
    assert len(got) == len(AWKWARD)
    same = [r for r in got if r.n_links == 3]
    assert len(same) == 4 and {r.component_id for r in same} == {3} and sum(r.kept for r in same) == 1
    assert all(r.kept and r.n_links == 0 for r in got if r.doc_id in (1, 2, 6))
    assert sorted(r.doc_id for r in lsh_forest.without_near_copies(d).collect()) == [1, 2, 3, 5, 6, 7]
    assert lsh_forest.near_groups(d.limit(0)).count() == 0


def test_prefixes_shorten_until_the_recall_is_met():
    d = lsh_forest.depth_for(0.8)
    assert 1 - (1 - 0.8**d) ** lsh_forest.TREES >= lsh_forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** lsh_forest.TREES


# Near vectors


def test_cover_tree_nests_and_halves():
    x = cover_tree.unit(np.random.default_rng(4).normal(size=(400, 8)))
    tree, order = cover_tree.build(x)
    assert sorted(order.tolist()) == list(range(400)) and (tree.points == x[order]).all()
    for level in range(cover_tree.LEVELS):
        assert tree.radii[level].max() <= 2.0 / 2**level + 1e-6
        assert set(tree.starts[level]) <= set(tree.starts[level + 1])


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "PAGE", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 6)) * 0.1, base[:1] + rng.normal(size=(80, 6)) * 0.01, base[:5], 3 * base[:5]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    frame = spark.createDataFrame([(i, v, "n", "m") for i, v in rows + odd], "vec_id long, embedding array<double>, v string, width string")
    got = {r.vec_id: r for r in cover_tree.near_vectors(frame).collect()}
    u = cover_tree.unit(x)
    links = u @ u.T >= 0.9
    reach = links.copy()
    for _ in range(8):
        reach = reach @ reach
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i].sum() - 1, int(np.flatnonzero(reach[i])[0]), int(np.flatnonzero(reach[i])[0]) == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))
    assert (got[905].n_links, got[906].component_id) == (1, 905)
    assert cover_tree.near_vectors(frame.limit(0)).count() == 0


def test_letters_never_rule_out_a_similar_line(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdetz 129é") for _ in range(rng.randrange(1, 400)))
        b = list(a)
        for _ in range(rng.randrange(0, 60)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "e", "q", "é", " "])
        pairs.append((a, "".join(b)))
    pairs += [("a" * 300, "b" * 300), ("a" * 300, "a" * 100), ("abc", ""), ("zz 1", "1 zz")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    counts = {side: list(fuzzy_lines.letter_counts(F.col(side)).values()) for side in "ab"}
    more, fewer = (fuzzy_lines.surplus(counts[x][:-1], counts[y][:-1]) for x, y in ("ab", "ba"))
    rows = frame.select("a", "b", more.alias("more"), fewer.alias("fewer"), (counts["a"][-1] - counts["b"][-1]).alias("apart"), F.levenshtein("a", "b").alias("edits")).collect()
    for r in rows:
        want = [sum(max(0, min(x.count(c), 127) - min(y.count(c), 127)) for c in fuzzy_lines.LETTERS) for x, y in ((r.a, r.b), (r.b, r.a))]
        assert [r.more, r.fewer] == want and r.more - r.fewer == r.apart and max(want) <= r.edits


def test_lines_that_share_a_passage_alone_are_not_read_in_pairs(spark, monkeypatch):
    """Lines of like lengths that share a passage were all paired with their texts."""
    rng = random.Random(13)
    passage = "considered international responsibility"

    def filler() -> str:
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 8)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(20))

    texts = [f"{filler()} {passage} {filler()}" for _ in range(120)]
    texts += [texts[7] + "x", texts[90].replace("considered", "consider")]
    read = []
    monkeypatch.setattr(fuzzy_lines, "_near", lambda pairs, *rest, real=fuzzy_lines._near: read.append(pairs.count()) or real(pairs, *rest))
    rows = fuzzy_lines.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if not r.kept} == {120, 121}
    assert read[-1] < 120 * 119 / 2 / 10


def test_pages_travel_once_for_each_tile(spark, monkeypatch):
    """A page was sent once for every page it was held against, and the vectors were written again with the results."""
    monkeypatch.setattr(cover_tree, "PAGE", 16)
    sent, written = [], []

    def travel(spark, pages, *args, real=cover_tree._travel):
        sides = real(spark, pages, *args)
        sent.append((pages.count(), [side.count() for side in sides]))
        return sides

    monkeypatch.setattr(cover_tree, "_travel", travel)
    monkeypatch.setattr(cover_tree, "stored", lambda df, label, real=cover_tree.stored: written.append(df.columns) or real(df, label))
    x = np.random.default_rng(6).normal(size=(640, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in cover_tree.near_vectors(frame).collect()}
    u = cover_tree.unit(x)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()))
    pages, sides = sent[0]
    assert pages >= 40 and max(sides) <= pages * cover_tree.LEAST_TILES
    assert sum("v" in columns for columns in written) == 1


# Tokens


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_tiktoken(tik, codec, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_round_trip_over_awkward_rows(spark, tik):
    rows = AWKWARD + [(8, "<|endoftext|> ▁Ünïcödé 😀 \x00 don't"), (9, " " * 5_000)]
    frame = docs(spark, rows).withColumn("n_tokens", F.lit("clash"))
    back = byte_bpe.decode(byte_bpe.encode(frame, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(back) == len(rows)
    for r in back:
        assert bytes(r.decoded) == (r.text or "").encode() and np.frombuffer(r.token_ids, "<u4").tolist() == tik.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) // 4
    assert byte_bpe.encode(frame.limit(0), RANKS, PATTERN).count() == 0


def test_token_lengths_answer_every_limit(spark, codec):
    rows = AWKWARD + [(i, "word " * (i % 7) * 3) for i in range(20, 60)]
    sizes = [len(codec.encode(t or "")) // 4 for _, t in rows]
    sums = token_lengths.with_sums(token_lengths.lengths(docs(spark, rows), RANKS, PATTERN)).cache()
    for r in sums.collect():
        over = [s for s in sizes if s > r.n_tokens]
        assert (r.n_docs, r.docs_longer, r.tokens_longer, r.docs_total, r.tokens_total) == (sizes.count(r.n_tokens), len(over), sum(over), len(sizes), sum(sizes))
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
    limits = [0, 1, 5, 17, 2_000, 10**7]
    assert {r.limit: (r.docs_within, r.truncated_total) for r in token_lengths.at_limits(sums, limits).collect()} == {k: (sum(s <= k for s in sizes), sum(min(s, k) for s in sizes)) for k in limits}
    ordered = sorted(sizes)
    assert {r.share: r.n_tokens for r in token_lengths.at_quantiles(sums, [0.5, 0.9, 1.0]).collect()} == {q: ordered[math.ceil(q * len(ordered)) - 1] for q in (0.5, 0.9, 1.0)}
    assert token_lengths.with_sums(token_lengths.lengths(docs(spark, AWKWARD).limit(0), RANKS, PATTERN)).count() == 0


# Secrets


def plain_spans(text):
    assign = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_fixed_patterns_keep_their_places(spark):
    rng = random.Random(6)
    parts = ["token: token: abcdefgh", 'API_KEY="sk-12345678"', "passwd = x", "secret=secret=abcdef", "AKIA" + "B" * 16, "AKIAAKIA" + "C" * 13, "AKIA123", "deadbeef" * 3, "deadbeef" * 2, "😀 é ", "password:hunter22", "tokentoken='abc.def'", "\n", "ſecret=abcdefgh", "0123456789abcdef01234567g"]
    rows = [(i, rng.choice(["", " ", "x"]).join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(150)] + [(900, None), (901, ""), (902, "token=abcdef12 " * 3_000)]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in secrets.find_secrets(docs(spark, rows)).collect()}
    assert got == {i: plain_spans(t or "") for i, t in rows}
    assert secrets.find_secrets(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("words, keys", [(2000, 1), (0, 1), (2000, 5), (50, 30)])
def test_keys_are_found_however_few_there_are(spark, words, keys):
    rng = random.Random(words + keys)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    syllables = ["tion", "ing", "an", "er", "ment", "ou", "el", "st"]
    rows = [(i, "".join(rng.choice(syllables) for _ in range(20))[:40]) for i in range(words)]
    rows += [(words + i, "see " + "".join(rng.choice(base64) for _ in range(40))) for i in range(keys)]
    found = {r.doc_id for r in secrets.find_secrets(docs(spark, rows)).collect() if any(s.kind == 3 for s in r.found)}
    assert len({i for i in found if i >= words}) >= 0.95 * keys and len({i for i in found if i < words}) <= 2


def test_random_keys_are_declared_and_words_are_not(spark):
    rng = random.Random(7)
    base64, syllables = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ["tion", "ing", "an", "er", "ment", "ou", "el", "st"]
    rows, keys = [], 0
    for i in range(400):
        word = "".join(rng.choice(syllables) for _ in range(rng.randrange(8, 20)))
        key = "".join(rng.choice(base64) for _ in range(rng.choice([24, 32, 40, 64])))
        rows.append((i, f"some {word} here" + (f" and {key} there" if i % 4 == 0 else "")))
        keys += i % 4 == 0
    found = [(r.doc_id, s) for r in secrets.find_secrets(docs(spark, rows)).collect() for s in r.found if s.kind == 3]
    right = sum(i % 4 == 0 and s.start > rows[i][1].index(" and ") for i, s in found)
    assert right >= 0.8 * keys and len(found) - right <= 0.1 * len(found)


# Sharding


@pytest.mark.parametrize("limit", [200, 5_000])
def test_shards_fit_and_only_oversized_buckets_split(spark, limit):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randrange(90)) for i in range(400)] + [(900, "z" * 20_000), (901, None), (902, "")] + [(903, "r" * 30)] * 300
    got = sharding.shards(docs(spark, rows), limit=limit).collect()
    assert len(got) == len(rows)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.n_bytes)
    for shard, sizes in held.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        if shard:  # the bucket one bit up did not fit
            parent = [n for s, ns in held.items() if s.startswith(shard[:-1]) for n in ns]
            assert sum(parent) > limit and len(parent) > 1
    assert not any(a != b and b.startswith(a) for a in held for b in held)
    assert all(r.shard_bytes == sum(held[r.shard]) and r.shard_docs == len(held[r.shard]) for r in got)
    assert sharding.shards(docs(spark, rows).limit(0)).count() == 0


# Mixing


def plain_targets(sizes, weights=mixing.WEIGHTS, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        left = total - sum(full.values())
        rest = sum(w[s] for s in names if s not in full)
        over = {s: cap * sizes[s] for s in names if s not in full and left * w[s] / rest > cap * sizes[s]}
        if not over:
            return full | {s: left * w[s] / rest for s in names if s not in full}
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * (1 if i % 50 else 60) * rng.randrange(1, 30), None if i % 11 == 0 else f"s{min(i % 9, 4)}") for i in range(1_500)] + [(5_000, None, "s1"), (5_001, "", "empty"), (5_002, "w w", "tiny")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r.size and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    assert all(abs(taken[s] - want[s]) <= max(60, 0.01 * want[s]) for s in sizes)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs(spark, rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    held = mixing.mixed_documents(docs(spark, rows))
    assert held.columns == docs(spark, rows).columns and held.count() == sum(r.n_copies for r in got)
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_mix_of_heavy_tailed_sizes_leaves_nothing_that_fits(spark):
    rng = random.Random(41)
    rows = [(i, "w " * max(1, int(rng.lognormvariate(2, 2))), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix(docs(spark, rows)).collect()
    for source in "abc":
        mine = [r for r in got if r.source == source]
        gap = mine[0].target - sum(r.taken for r in mine)
        rate = min(3.0, mine[0].target / mine[0].source_size)
        open_ = [r.size for r in mine if r.n_copies == math.floor(rate) and rate < 3 and rate > math.floor(rate)]
        assert -1e-6 <= gap < min(open_, default=math.inf)


def test_mix_of_awkward_rows_and_importance(spark):
    d = docs(spark, AWKWARD)
    assert sorted((r.doc_id or 0, r.size, r.n_copies) for r in mixing.mix(d).collect())[0][1] == 3
    weighed = docs(spark, [(i, "w " * 20) for i in range(400)]).withColumn("importance", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    more = {r.even: r.n for r in mixing.mix(weighed, importance_col="importance").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("n_copies").alias("n")).collect()}
    assert more[True] > 2 * more[False]


# Fuzzy lines


def test_fuzzy_lines_connect_variants(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    bases = [[rng.choice(words) for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            line = list(rng.choice(bases))
            if rng.random() < 0.6:
                line[rng.randrange(40)] = rng.choice(words)
            lines.append(rng.choice(["  ", " "]).join(line).upper() if rng.random() < 0.3 else " ".join(line) + rng.choice(["", ".", " !"]))
        rows.append((i, "\n".join([*lines, "", "--"])))
    got = fuzzy_lines.line_groups(docs(spark, rows)).collect()
    assert len(got) == 240
    owner = {(i, n): next(k for k, b in enumerate(bases) if len(set(re.findall(r"\w+", line.lower())) & set(b)) > 30) for i, t in rows for n, line in enumerate(t.split("\n")[:4])}
    groups = {}
    for r in got:
        groups.setdefault((r.keep_doc_id, r.keep_line_no), set()).add(owner[r.doc_id, r.line_no])
    assert all(len(g) == 1 for g in groups.values())  # no two bases in one group
    assert len(groups) <= 24 and sum(r.kept for r in got) == len(groups)  # variants found their group
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keep_doc_id, r.keep_line_no)) for r in got)


def edits(a, b):
    """The edit distance of two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines_find_what_brute_force_finds(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    lines = []
    for i in range(120):
        line = [rng.choice(vocabulary) for _ in range(rng.choice([6, 10, 15, 20, 30, 45, 60]))]
        other = list(line)
        for _ in range(1 + len(line) // 25):
            at, how = rng.randrange(len(other)), rng.randrange(3)
            other[at:at + 1] = [[rng.choice(vocabulary)], [], [other[at], rng.choice(vocabulary)]][how]
        lines.append((" ".join(line), " ".join(other)))
    true = {i for i, (a, b) in enumerate(lines) if edits(a, b) <= math.floor(max(len(a), len(b)) * 0.1 + 1e-9)}
    got = fuzzy_lines.line_groups(docs(spark, [(i, "\n".join(pair)) for i, pair in enumerate(lines)])).collect()
    assert len(true) > 60 and all(r.keep_doc_id == r.doc_id for r in got)  # no two bases are similar
    found = {r.doc_id for r in got if not r.kept}
    assert found <= true and len(found) >= 0.98 * len(true)


def test_simhash_of_over_two_million_words(spark):
    text = "garden " * 2_200_000 + "window"
    got = fuzzy_lines._counters(fuzzy_lines._lines(docs(spark, [(1, text)]), "doc_id", "text")).first()
    want = spark.range(1).select(F.xxhash64(F.lit("garden")).alias("x")).first().x & (1 << 63) - 1
    assert got.simhash == want  # the word that fills the line decides every bit


def test_fuzzy_lines_of_awkward_rows(spark):
    got = fuzzy_lines.line_groups(docs(spark, AWKWARD)).collect()
    same = [r for r in got if r.keep_doc_id == 3]
    assert len(same) == 4 and sum(r.kept for r in same) == 1 and {r.doc_id for r in got} == {3, 4, None, 5, 7}
    assert fuzzy_lines.line_groups(docs(spark, AWKWARD).limit(0)).count() == 0


def test_edit_similarity_bounds(spark):
    rng = random.Random(11)
    pairs = []
    for n in (1, 9, 10, 50, 700):
        a = "".join(rng.choice("abc") for _ in range(n))
        for edits in range(0, n // 4 + 2, max(1, n // 20)):
            b = a[edits:]
            pairs.append((a, b, edits <= math.floor(n * 0.1 + 1e-9)))
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert frame.where(fuzzy_lines.similar(F.col("a"), F.col("b"), 0.9) != F.col("want")).count() == 0


def test_edit_similarity_of_long_lines_follows_moves(spark):
    rng = random.Random(31)
    pairs = []
    for n in (60, 90, 160, 400):
        for cut in (0, n // 16, n // 9):
            a = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
            b = a[: n // 3] + a[n // 3 + cut:]
            for at in rng.sample(range(len(b)), n // 30):
                b[at] = "changed"
            a, b = " ".join(a), " ".join(b)
            for x, y in ((a, b), (b, a), (a + a[:300], b + a[:300])):
                pairs.append((x, y, edits(x, y) <= math.floor(max(len(x), len(y)) * 0.1 + 1e-9)))
    assert {True, False} == {p[2] for p in pairs}
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert frame.where(fuzzy_lines.similar(F.col("a"), F.col("b"), 0.9) != F.col("want")).count() == 0


def test_simhash_lanes_count_as_plain_sums(spark):
    rng = random.Random(32)
    lines = [" ".join("".join(rng.choice("abcdef") for _ in range(7)) for _ in range(n)) for n in (1, 2, 5, 126, 127, 128, 300)]
    got = fuzzy_lines._counters(spark.createDataFrame([(x,) for x in lines], "line string")).select("line", "simhash", "x").collect()
    for r in got:
        bits = [sum(h >> b & 1 for h in r.x) for b in range(63)]
        assert r.simhash == sum(1 << b for b, count in enumerate(bits) if 2 * count > len(r.x))


def test_fuzzy_lines_move_no_line_that_meets_none(spark, monkeypatch):
    written = {}

    class Counted(fuzzy_lines.Stored):
        def __init__(self, df, label, *more):
            super().__init__(df, label, *more)
            written.setdefault(label, []).append((self.df.columns, self.df.count()))

    monkeypatch.setattr(fuzzy_lines, "Stored", Counted)
    rng = random.Random(33)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60))) for i in range(40)]
    got = fuzzy_lines.line_groups(docs(spark, [*rows, (90, rows[0][1] + " more"), (91, rows[0][1])])).collect()
    assert sum(r.kept for r in got) == 40 and len(got) == 42
    assert [n for _, n in written["lines"]] == [42]  # texts are written once
    assert [n for _, n in written["texts"]] == [2]  # and read again for lines that met another
    assert max(n for label in ("buckets", "met", "pairs") for _, n in written[label]) < 40


# Toxicity


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(12)
    clean = ["garden", "river", "window", "paper", "train", "music", "the", "of", "and"]
    insults = ["blargon", "snork", "vexuloid", "vexulant", "vexulism"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(60), rng.choice(insults))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    d, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, known.where("doc_id < 450"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert sum(got[i].predicted == y for i, y in labels if i >= 450) >= 148
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert model.lexicon.weight("vexulnew") > 0  # a form never seen, by its beginning
    odd = toxicity.score(docs(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(r.predicted == 0 for r in odd)
    assert toxicity.score(d.limit(0), model).count() == 0


def test_grammar_weighs_clauses():
    lexicon = toxicity.Lexicon({"idiot": 4.0})
    weigh = lambda text: sum(w for _, w in toxicity.matched(text, lexicon))
    assert weigh("You idiot.") > weigh("An idiot.") > weigh("Not an idiot.") > 0
    assert weigh("He said it was an idiot.") < weigh("It was an idiot.")
    assert weigh("I will kill you.") > 0 == weigh("They say bees kill. Fine!") or weigh("Bees kill wasps.") == 0
    assert weigh("A not so far clause. An idiot.") == weigh("An idiot.")
    assert weigh("Unidiotic words.") == 0 == weigh("")


def test_toxicity_without_labels_of_both_kinds(spark):
    d = docs(spark, AWKWARD)
    for labels in ([], [(3, 0), (4, 0)]):
        model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(d, model).collect()} == {0}


