"""N-gram Jaccard join through a MinHash LSH forest.

A document is the set of its word 5-grams. Each tree of the forest labels it with a path of minhashes, and documents that
share a prefix of a path meet in that node of the tree's trie. Prefixes start at full depth and are shortened until a pair
exactly at the threshold meets in some tree with the target probability. Documents that meet, directly or through others,
form a cluster; clusters are dealt into pages of bounded size, and every pair of documents on a pair of pages is verified
on the full sets. Documents with the same set are one class throughout, so copies are never paired with each other.

Links are counted inside the tasks and only a spanning forest of them leaves a task, so a group of n near copies
gives on the order of n rows, not n squared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, keep_rows, stored, whole

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.999
PAGE_DOCS = 512
PAGE_SHINGLES = 300_000
CACHED_WORDS = 100_000

_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(7)
_MULTIPLY = (_rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * 2 + 1)[:, None]
_ADD = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one n-gram, one without words none."""
    found = _WORD.findall(text.lower())
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    width = min(words, n)
    grams = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        grams = grams * _STEP + h[k : n - width + 1 + k]
        grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return np.unique(grams)


def paths(grams: np.ndarray) -> np.ndarray:
    """(TREES, DEPTH) minhash labels of a set that isn't empty."""
    x = grams.astype(np.uint32)
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 1024):
        np.minimum(low, (x[None, start : start + 1024] * _MULTIPLY + _ADD).min(axis=1), out=low)
    return low.reshape(TREES, DEPTH)


def depth_for(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, shortened label by label, at which a pair at the threshold shares one with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sketch(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in batch.column("_text"):
                grams = shingles(text.as_py())
                sizes.append(len(grams))
                if not len(grams):
                    keys.append(None)
                    nodes.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                labels = np.ascontiguousarray(paths(grams)[:, :depth])
                nodes.append([int(v) for v in np.array([xxhash.xxh3_64_intdigest(bytes([t]) + row.tobytes()) for t, row in enumerate(labels)], np.uint64).view(np.int64)])
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(keys, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=[*names, "class_key", "nodes", "n_grams"])

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column as the list of its shingles; repeats of a class within the task are left out."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, class_id in enumerate(batch.column("class_id").to_pylist()):
            if class_id not in seen:
                seen.add(class_id)
                fresh.append(i)
        part = batch.take(pa.array(fresh, pa.int64()))
        names = [n for n in part.schema.names if n != "_text"]
        grams = pa.array([shingles(t.as_py()).view(np.int64) for t in part.column("_text")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], grams], names=[*names, "grams"])


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set over the shingles that several of them hold, packed into 64-bit words."""
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    width = -(-max(1, int(shared.sum())) // 64) * 64
    rows = np.zeros((len(sets), width // 64), np.uint64)
    start = 0
    for i, grams in enumerate(sets):
        own = place[start : start + len(grams)]
        start += len(grams)
        bits = np.zeros(width, np.uint8)
        bits[column[own[shared[own]]]] = 1
        rows[i] = np.packbits(bits).view(np.uint64)
    return rows


def verify(ids: list[int], copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links of each class to others on the page pair, weighed by their copies, and the smallest class it reaches here.

    sides: 0 and 1 for classes of the two pages; with `across` only classes of different pages are paired.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(s) for s in sets])[order]
    rows = _bits([sets[i] for i in order])
    side, weight = sides[order], copies[order]
    links = np.zeros(len(order), np.int64)
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(order)):
        # Sorted by size: a partner of size s can only reach the threshold while size_i >= threshold * s.
        end = int(np.searchsorted(sizes, sizes[i] / threshold + 1e-9, side="right"))
        js = np.arange(i + 1, end)
        if across:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        both = np.bitwise_count(rows[js] & rows[i]).sum(axis=1, dtype=np.int64)
        js = js[both >= threshold * (sizes[js] + sizes[i] - both) - 1e-9]
        links[i] += weight[js].sum()
        links[js] += weight[i]
        for j in js.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, at in enumerate(order.tolist()):
        r = root(i)
        least[r] = min(least.get(r, ids[at]), ids[at])
    out_links, out_least = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for i, at in enumerate(order.tolist()):
        out_links[at], out_least[at] = links[i], least[root(i)]
    return out_links, out_least


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            ids = [h[0] for h in held]
            links, least = verify(ids, np.array([h[1] for h in held]), np.array([h[2] for h in held]), [h[3] for h in held], threshold, key[1] != key[2])
            hit = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64()), pa.array(least[hit], pa.int64()), pa.array(links[hit], pa.int64())], names=["a", "b", "links"]) if len(hit) else None

        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            values = columns["grams"].values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = columns["grams"].offsets.to_numpy()
            meta = zip(*(columns[n].to_pylist() for n in ("cluster", "low", "high", "class_id", "copies", "side")), strict=True)
            for i, (cluster, low, high, class_id, copies, side) in enumerate(meta):
                if key != (cluster, low, high):
                    if (done := flush()) is not None:
                        yield done
                    key, held, seen = (cluster, low, high), [], set()
                if class_id in seen:
                    continue
                seen.add(class_id)
                held.append((class_id, copies, side, values[offsets[i] : offsets[i + 1]].copy()))
        if (done := flush()) is not None:
            yield done

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, component_id, kept, text_sha256.

    Words are runs of letters and digits, folded to lower case. Texts are linked when the Jaccard similarity of their
    sets of 5-word shingles reaches the threshold; shorter texts are one shingle, and null, empty or wordless texts link
    with nothing, not even each other. `n_links` counts the other rows linked directly, copies included; `class_id` and
    `component_id` are the smallest ids of the rows with the same set and of those reachable by links. One row of each
    component is kept, the one with the smallest id (null ids last; of rows that repeat an id, one). Pairs are found with
    probability `recall` or more at the threshold, above it with a higher one; no pair below it is linked. Sets are
    compared by 64-bit hashes of their shingles. An empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text")).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    rows = stored(
        source.mapInArrow(_sketch(depth_for(threshold, recall)), "doc_id long, digest binary, class_key binary, nodes array<long>, n_grams long").withColumn("row", F.monotonically_increasing_id()),
        "sketches",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "digest"))
    classes = stored(
        rows.where("class_key is not null").groupBy("class_key").agg(first.alias("top"), F.count("*").alias("copies"), F.first("nodes").alias("nodes"), F.first("n_grams").alias("n_grams")).withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    found = _linked(source, classes, threshold)
    # The smallest row of every component, then the links of every class.
    tops = classes.select("class_id", "top", "copies", "class_key").join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    tops = stored(tops, "linked")
    leaders = stored(tops.groupBy("component").agg(F.min("top").alias("lead")), "leaders")
    results = stored(
        tops.join(leaders, "component").select("class_key", F.col("top.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("lead_row")),
        "results",
    )
    return rows.select("doc_id", "row", "class_key", "digest").join(results, "class_key", "left").select(
        "doc_id",
        F.when(F.col("lead_row").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("lead_row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("lead_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def clusters_of(classes: DataFrame) -> DataFrame:
    """(node, component): classes that share a node of some tree, directly or through others."""
    met = classes.select("class_id", F.explode("nodes").alias("node"))
    shared = stored(met.groupBy("node").agg(F.min("class_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("node", "first"), "nodes")
    return components(met.join(shared, "node").where("class_id <> first").select(F.col("class_id").alias("a"), F.col("first").alias("b")))


def _linked(source: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(class_id, component, links) of every class with a link to another one."""
    clusters = clusters_of(classes)
    placed = stored(clusters.join(classes, clusters["node"] == classes["class_id"]).select(F.col("component").alias("cluster"), "class_id", "copies", "n_grams", "top.doc_id", "top.digest"), "members")
    pages = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / PAGE_DOCS), F.ceil(F.sum("n_grams") / PAGE_SHINGLES)).cast("int").alias("pages"))
    members = stored(placed.join(stored(pages, "pages"), "cluster"), "members")
    # Only one text of every class that met another is moved.
    texts = source.join(members, source["doc_id"].eqNullSafe(members["doc_id"]) & (source["digest"] == members["digest"])).select("cluster", "class_id", "copies", "pages", "_text")
    sets = texts.mapInArrow(_expand, "cluster long, class_id long, copies long, pages int, grams array<long>").withColumn("page", F.pmod(F.xxhash64("class_id"), F.col("pages")).cast("int"))
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select(
        "cluster", F.least("page", "other").alias("low"), F.greatest("page", "other").alias("high"), (F.col("page") > F.col("other")).cast("int").alias("side"), "class_id", "copies", "pages", "grams"
    )
    keys = ["cluster", "low", "high"]
    verified = stored(paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified(threshold), "a long, b long, links long"), "links")
    links = verified.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    joined = components(verified.select("a", "b"))
    return stored(links, "links").join(joined, F.col("class_id") == joined["node"], "left").select("class_id", "component", "links")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that `near_groups` keeps, with all their columns."""
    return keep_rows(docs, near_groups(docs, id_col, text_col, threshold=threshold).where("kept"), id_col, text_col)
