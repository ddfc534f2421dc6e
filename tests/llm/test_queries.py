"""The registered queries and the pipeline over the smallest tables, against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import near_plain, plain_spans, plain_targets
from tests.oracle import compare, connect
from tidewatch.llm import byte_bpe, cover_tree, queries, secrets, sharding

SF_DIR = os.environ.get("TIDEWATCH_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})


def run(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


def test_everything_is_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_its_oracle(spark, name):
    assert compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("limit", [2_000, 40_000])
def test_small_shards_match_their_oracle(spark, limit):
    fn = lambda s, d: sharding.shards(s.read.parquet(f"{d}/documents.parquet"), limit=limit)
    assert compare(spark, connect(SF_DIR), fn, queries.sharding_sql(limit), SF_DIR) is None


def test_near_vectors_by_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    u = cover_tree.unit(np.array([r.embedding for r in table]))
    linked = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r for r in run(spark, "op1_cover_tree")}
    assert [got[r.vec_id].n_links for r in table] == linked.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_documents_by_brute_force(spark, rows):
    want = near_plain([(r.doc_id, r.text) for r in rows], 0.8)
    assert {r.doc_id: (r.n_links, r.component_id) for r in run(spark, "op2_lsh_forest_join")} == want


def test_token_lengths_by_brute_force(spark, rows, tik):
    sizes = [len(tik.encode_ordinary(r.text or "")) for r in rows]
    for r in run(spark, "op3_token_lengths"):
        assert (r.n_docs, r.tokens_total, r.truncated_total) == (sizes.count(r.n_tokens), sum(sizes), sum(min(s, r.n_tokens) for s in sizes))


def test_secrets_by_brute_force(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op4_secret_scan")}
    for r in rows:
        found = plain_spans(r.text or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == n for _, k, _ in found) for n in range(3))
        assert set(filter(None, joined.split(","))) <= set(g.spans.split(","))


def test_tokens_by_brute_force(spark, rows, tik):
    got = {r.doc_id: r for r in run(spark, "op8_byte_bpe")}
    for r in rows:
        ids = tik.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_fuzzy_lines_keep_one_of_each_group(spark, rows):
    got = run(spark, "op9_fuzzy_lines")
    lines = {(r.doc_id, n): line for r in rows for n, line in enumerate((r.text or "").split("\n"))}
    plain = {k: " ".join(re.findall(r"[^\W_]+", line.lower())) for k, line in lines.items()}
    assert {(r.doc_id, r.line_no) for r in got} == {k for k, line in plain.items() if line}
    owner = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in got}
    by_text = {}
    for key in owner:
        by_text.setdefault(plain[key], set()).add(owner[key])
    assert all(len(o) == 1 for o in by_text.values())  # equal lines share their group
    assert all(r.kept == (owner[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in got)


def test_toxicity_on_held_out_documents(spark):
    got = {r.doc_id: r for r in run(spark, "op10_toxicity")}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.doc_id in got]
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def plain_mix(docs):
    sizes, totals = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs], {}
    for r, n in zip(docs, sizes, strict=True):
        totals[r.source] = totals.get(r.source, 0) + n
    targets = plain_targets(totals)
    copies, ranks = [], []
    for r, n in zip(docs, sizes, strict=True):
        rate = min(targets[r.source] / totals[r.source], 3.0) if totals[r.source] else 0.0
        digest = hashlib.md5(f"{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()
        u, odds = (int(digest[:12], 16) + 0.5) / 2**48, rate - math.floor(rate)
        copies.append(math.floor(rate))
        ranks.append((u / (1 - u)) / (odds / (1 - odds)) if n and rate < 3 and odds > 0 else math.inf)
    for source in totals:
        mine = [i for i, r in enumerate(docs) if r.source == source]
        gap = targets[source] - sum(copies[i] * sizes[i] for i in mine)
        open_ = sorted((i for i in mine if ranks[i] < math.inf), key=lambda i: ranks[i])
        while any(sizes[i] <= gap for i in open_):
            used, taken = 0, []
            for i in (i for i in open_ if sizes[i] <= gap):
                if used + sizes[i] > gap:
                    break
                used += sizes[i]
                taken.append(i)
            for i in taken:
                copies[i] += 1
            open_, gap = [i for i in open_ if i not in taken], gap - used
    return [r for r, n in zip(docs, copies, strict=True) for _ in range(n)]


def test_pipeline_by_brute_force(spark, rows, tik):
    model = queries.toxicity_model(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark, SF_DIR)
    left = [r for r in rows if model.score(r.text or "") < 0.5]
    last = {r.text: r.doc_id for r in sorted(left, key=lambda r: r.doc_id)}
    left = [r for r in left if last[r.text] == r.doc_id]
    near = near_plain([(r.doc_id, r.text) for r in left], 0.8)
    left = plain_mix([r for r in left if near[r.doc_id][1] == r.doc_id])
    want = sorted((r.doc_id, r.lang, r.source, np.array(tik.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in left)
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.lang, r.source, bytes(r.token_ids)) for r in got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "byte_bpe"]
