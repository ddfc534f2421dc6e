"""Conversation repair, positional index and periodic runs against plain versions, and the awkward inputs."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import AWKWARD, docs
from tests.oracle import compare, connect
from tidewatch.llm import periodic_runs, positional_index, queries, turn_repair

SF_DIR = os.environ.get("TIDEWATCH_SF_DIR", "/root/testdata/sf0.001")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

# Conversation repair


def plain_repair(rows):
    """All edits tried state by state, whole audits compared as text. rows: (turn, role, text) in order."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    counts, seen, kinds = [0, 0, 0], set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        kinds.append(fault)
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(to, at, told):
        if at not in to or told[:2] < to[at][:2]:
            to[at] = told

    def with_inserts(best):
        out = dict(best)
        for _ in range(2):
            for at, (cost, audit, lines) in list(out.items()):
                for initial in follow[at]:
                    if initial in names:
                        offer(out, initial, (cost + 2, audit + "I", (*lines, names[initial] + ":")))
        return out

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for at, (cost, audit, lines) in with_inserts(best).items():
            offer(after, at, (cost + 3, audit + "D", lines))
            if kind in (0, 1):
                continue
            more = cost + (kind == 2)
            for initial, to in follow[at].items():
                if initial in names:
                    offer(after, to, (more + 2, audit + "R", (*lines, f"{names[initial]}:{text}")))
                if role[:1] == initial:
                    offer(after, to, (more, audit + "K", (*lines, f"{role}:{text}")))
        best = after
    cost, audit, lines = min((v[0], v[1], v[2]) for at, v in with_inserts(best).items() if at in ("", "a"))
    turns = sorted({t for t, _, _ in rows if t is not None})
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return ((turns[-1] - turns[0] + 1 - len(turns)) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(lines)))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))


def told(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def test_repair_by_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", "Why?", " ", "", "ok!\n", "and then", None]
    rows, by = [], {}
    for conv in range(300):
        for _ in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            row = (rng.choice([None, *range(12)]), role, rng.choice(texts) if rng.random() < 0.6 else f"line {rng.randrange(99)}.")
            rows.append((conv, *row))
            by.setdefault(conv, []).append((row[0], " " if role is None else role, " " if row[2] is None else row[2]))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert told(turn_repair.repair(frame)) == {c: plain_repair(in_order(r)) for c, r in by.items()}


def test_repair_of_a_long_conversation_in_pieces(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice(".!x")) for t in range(3000)] + [(None, None, None, None), (8, 1, "user", "Hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        pieces = turn_repair._pieces(turn_repair._kinds(turn_repair._facts(frame)), "bigint")
        assert pieces.where("conv_id = 7").count() > 1
        got = told(turn_repair.repair(frame))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[7] == plain_repair([r[1:] for r in rows[:3000]])
    assert got[None] == (0, 1, 0, 0, 0, 3, "D", sha("")) and got[8][5:7] == (2, "KI")


def test_crossings_meet_where_the_edits_read_least():
    rng = random.Random(7)
    for _ in range(300):
        kinds = "".join(rng.choice(turn_repair.CLASSES) for _ in range(rng.randrange(1, 9)))
        pieces = [turn_repair.ROWS[k] for k in kinds]
        leave = turn_repair.last_state(pieces)
        audit = "".join(turn_repair.edits(kinds, 0, leave)) + turn_repair.ENDING[leave][1]
        cut = rng.randrange(len(kinds) + 1)
        joined = [turn_repair.joined(p) for p in (pieces[:cut], pieces[cut:]) if p]
        assert turn_repair.last_state(joined) == leave
        states = turn_repair.crossings(joined, 0, leave)
        split = [turn_repair.edits(k, a, b) for k, a, b in zip([k for k in (kinds[:cut], kinds[cut:]) if k], states, states[1:], strict=False)]
        assert "".join(itertools.chain(*split)) + turn_repair.ENDING[leave][1] == audit


def test_repair_of_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, plan string, step int, part int, kind string"
    more = ("p", 1, 2, "k")
    rows = [(1, None, None, None, *more), (2, 0, "user", "x" * 300_000, *more), (2, 1, "assistant", "word " * 40_000, *more), (3, 5, "user", "Hi.", *more), (3, 5, "user", "Hi.", *more), (3, 5, "user", "Hi.", *more)]
    got = told(turn_repair.repair(spark.createDataFrame(rows, schema)))
    assert got[2] == plain_repair([(0, "user", "x" * 300_000), (1, "assistant", "word " * 40_000)])
    assert got[3][:7] == (0, 0, 2, 0, 2, 8, "KDDI")
    assert turn_repair.repair(spark.createDataFrame([], schema)).count() == 0
    left = told(turn_repair.repair(spark.createDataFrame([], schema), spark.createDataFrame([(4,), (None,)], "conv_id long")))
    assert left == {4: (0, 0, 0, 0, 0, 0, "", sha("")), None: (0, 0, 0, 0, 0, 0, "", sha(""))}


def plain_damage(rows):
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (conv, turn, "user" if h == 4 else " " if role is None else role, "" if h == 1 else " " if text is None else re.sub("[.!?]", "", text) if h == 2 else text)
            yield from [row] * (2 if h == 3 else 1)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_conversations_by_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {r[0]: [] for r in table}
    for r in plain_damage(table):
        by[r[0]].append(r[1:])
    want = {c: plain_repair(in_order(rows)) if rows else (0, 0, 0, 0, 0, 0, "", sha("")) for c, rows in by.items()}
    assert told(queries.QUERIES["op11_turn_repair"](spark, SF_DIR)) == want


# Positional index


def plain_hits(texts, items, window=10):
    split = lambda t: re.findall(positional_index.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = []
    for text in texts:
        w, hit, ids = split(text), set(), set()
        for item_id, item in items:
            x = split(item)
            span = min(window, len(x))
            for s in range(len(x) - span + 1) if x else []:
                for at in range(len(w) - span + 1):
                    if w[at : at + span] == x[s : s + span]:
                        hit |= set(range(at, at + span))
                        ids.add("" if item_id is None else str(item_id))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_phrases_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "é", "ÉT", "garden", "x1", "a-b"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, line(4)), (2, line(30)), (2, line(12)), (3, None), (4, "..."), (None, "lone"), (5, line(11)), (6, "never seen " * 9)]
    items += [(7, items[1][1])]
    texts = [None, "", "Lone", "x" * 3000] + [line(rng.randrange(60)) for _ in range(30)]
    for i in range(30):
        cut = rng.choice(items[:2] + items[6:7])[1].split(" ")
        a = rng.randrange(len(cut))
        texts.append(line(rng.randrange(9)) + " " + " ".join(cut[a : a + rng.randrange(4, 25)]).upper().replace("É", "é") + " " + line(5))
    d = docs(spark, [(i % 40, t) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(*r, 0, "k") for r in items], "item_id long, text string, row int, term string")
    for window in (10, 3):
        got = [(r.n_words, r.n_hit, r.item_ids) for r in positional_index.contamination(d, bench, window=window).collect()]
        assert sorted(got) == sorted(plain_hits(texts, items, window))
    assert {r.n_items for r in positional_index.contamination(d, bench.limit(0)).collect()} == {0}
    assert positional_index.contamination(d.limit(0), bench).count() == 0


def test_awkward_documents_against_a_long_item(spark):
    bench = spark.createDataFrame([(1, "word " * 40), (2, "same text here"), (3, "x" * 300_000)], "item_id int, text string")
    got = sorted((r.n_words, r.n_hit, r.n_items) for r in positional_index.contamination(docs(spark, AWKWARD), bench).collect())
    assert got == sorted([(0, 0, 0)] * 3 + [(3, 3, 1)] * 4 + [(1, 1, 1), (40_000, 40_000, 1)])


def test_near_words_in_either_order(spark):
    bench = spark.createDataFrame([(1, "zebra in the quartz")], "item_id int, text string")
    d = docs(spark, [(1, "quartz and " * 2 + "zebra in the in the"), (2, "zebra " + "the in " * 20 + "quartz"), (3, "in the zebra")])
    index = positional_index.build(d, bench)
    rows = {r.row: r.doc_id for r in index.forward.collect()}
    assert {rows[r.row] for r in positional_index.proximity_matches(index).collect()} == {1}
    assert {rows[r.row] for r in positional_index.proximity_matches(index, reach=60).collect()} == {1, 2}
    assert positional_index.phrase_matches(index).count() == 0


# Periodic runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and not any(w[s : s + length - p] == w[s + p : s + length] for p in range(1, q)):
                out.append((s, q, length))
            i += i == s
    return sorted(out)


def plain_collapse(w, found):
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(rng, n):
    for _ in range(n):
        w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            if len(w) > 10:
                a, p = rng.randrange(len(w)), rng.randrange(1, len(w) // rng.choice([4, 8, 30]) + 2)
                for i in range(a, rng.randrange(a, len(w))):
                    w[i] = w[a + (i - a) % p]
        yield " ".join(w)


@pytest.mark.parametrize("tile", [8, 64, 4096])
def test_runs_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    rng = random.Random(tile)
    for text in periodic_texts(rng, 300):
        w = text.split()
        pieces = {}
        for b, first, ids in periodic_runs.cut(periodic_runs.numbered(w)):
            for q, found in periodic_runs.solve(b, first, ids).items():
                pieces.setdefault(q, []).extend(map(tuple, found))
        got = []
        for q, found in pieces.items():
            open_ = []
            for a, b in sorted(found):
                if open_ and a <= open_[-1][1]:
                    open_[-1][1] = max(open_[-1][1], b)
                else:
                    open_.append([a, b])
            got += [(a, q, b - a + q) for a, b in open_ if b - a + q >= max(6, 4 * q)]
        assert sorted(got) == plain_runs(w)


def test_runs_of_documents(spark):
    texts = list(periodic_texts(random.Random(9), 200))
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, texts[5]), (None, "a b " * 9), (900, None)]
    want = sorted((str(i), plain_runs((t or "").split()), sha(plain_collapse((t or "").split(), plain_runs((t or "").split())))) for i, t in rows)
    got = periodic_runs.collapsed(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.kept_sha256) for r in got) == want


def test_runs_of_awkward_documents(spark):
    got = {r.doc_id: r for r in periodic_runs.collapsed(docs(spark, AWKWARD)).collect()}
    assert [tuple(x) for x in got[7].runs] == [(0, 1, 40_000)] and got[7].kept_sha256 == sha("word")
    assert got[5].kept_sha256 == sha("x" * 300_000) and got[1].kept_sha256 == got[6].kept_sha256 == sha("") and got[None].runs == []
    assert periodic_runs.collapsed(docs(spark, AWKWARD).limit(0)).count() == 0
    ties = [(10, 1, 8), (2, 2, 8), (2, 1, 8)]
    frame = spark.createDataFrame([(ties,)], "runs array<struct<start:long,period:long,length:long>>")
    assert tuple(frame.select(periodic_runs.longest(F.col("runs")).alias("b")).first().b) == (2, 8, 1)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_runs_query_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    for doc_id, text in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        top = min(found, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.period, r.length) == (len(found), *top)
        assert r.exponent_milli == (1000 * top[2] // top[1] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, q, length in found)) and r.collapsed_sha256 == sha(plain_collapse(w, found))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_contamination_matches_its_oracle(spark):
    assert compare(spark, connect(SF_DIR), queries.QUERIES["op12_positional_index"], queries.ORACLES["op12_positional_index"], SF_DIR) is None
