"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Unit vectors are compared by chord length, for which cosine >= t means chord <= sqrt(2 - 2t). The top of the tree is a set
of anchors, spread over a bounded sample; below an anchor, vectors are dealt into pages of bounded size, and every page
holds a cover tree of its own: nested levels whose radii halve, each node with the true radius of what it covers. Two
subtrees are walked together. Pages travel by tiles, a page once for each tile in which it meets any other. A pair of nodes whose bound exceeds the threshold is dropped, one that lies within it whole
is linked whole, and the rest open into their children, down to pairs of vectors that are measured in double precision.

Only a count of links per vector and a spanning forest of them leave a task.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Stored, components, stored

THRESHOLD = 0.9
PAGE = 2_048
ANCHORS = 1_024  # most anchors of one vector width
SAMPLE = 4_096  # vectors the anchors are chosen from, those whose hashes are lowest
TILE_CELLS = 2**23  # numbers in the vectors of the pages that travel together
LEAST_TILES = 6  # of each vector width that has so many pages
LEVELS = 7  # radii 2, 1, 1/2, ... of a page's tree
DENSE = 0.05  # share of node pairs above which the next level is measured whole
SLACK = 1e-9  # bounds are only trusted beyond rounding


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


@dataclass
class Tree:
    """Points in tree order; at every level the nodes are ranges of points."""

    points: np.ndarray
    starts: list[np.ndarray]  # per level, first point of each node
    centers: list[np.ndarray]  # per level, the point each node is centred on
    radii: list[np.ndarray]  # per level, largest distance from the centre to a point of the node

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.starts[level][1:], len(self.points))


def build(x: np.ndarray, levels: int = LEVELS) -> tuple[Tree, np.ndarray]:
    """The cover tree of unit vectors and the order its points are in. The last level has one node per point."""
    n = len(x)
    d = chord(x, x)
    label = np.zeros((levels, n), np.int64)  # centre of every point per level; level 0 is the root
    for level in range(1, levels):
        radius = 2.0 / 2**level
        above = label[level - 1]
        order = np.argsort(above, kind="stable")
        cuts = np.flatnonzero(np.diff(above[order])) + 1
        for members in np.split(order, cuts):
            center = above[members[0]]
            open_ = members
            while len(open_):
                near = d[center, open_] <= radius
                label[level, open_[near]] = center
                open_ = open_[~near]
                if len(open_):
                    center = open_[0]
    order = np.lexsort((np.arange(n), *label[::-1]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts, centers, radii = [], [], []
    for level in range(levels):
        own = label[level][order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        starts.append(first)
        centers.append(place[own[first]])
        radii.append(np.maximum.reduceat(d[own, order], first))
    starts.append(np.arange(n))
    centers.append(np.arange(n))
    radii.append(np.zeros(n))
    return Tree(x[order], starts, centers, radii), order


def _combine(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of the ranges of each pair (a, b)."""
    ka, kb = a_to[a] - a_from[a], b_to[b] - b_from[b]
    size = ka * kb
    pair = np.repeat(np.arange(len(a)), size)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a_from[a][pair] + nth // kb[pair], b_from[b][pair] + nth % kb[pair]


def traverse(a: Tree, b: Tree, threshold: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Linked ranges: ("nodes", ranges of a, ranges of b) linked whole, and ("points", i, j)."""
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    last = len(a.starts) - 1
    nodes_a: np.ndarray | None = None  # None: all pairs of the level
    nodes_b: np.ndarray | None = None
    for level in range(last):
        if nodes_a is None:
            finer = len(a.starts[level + 1]) * len(b.starts[level + 1])
            if level and 2.0 / 2**level > limit and 4 * len(a.starts[level]) * len(b.starts[level]) > finer:
                continue  # too wide to tell nodes apart, and hardly fewer of them than below
            cosine = a.points[a.centers[level]] @ b.points[b.centers[level]].T
            widest = limit + a.radii[level].max() + b.radii[level].max() + SLACK
            ia, ib = np.nonzero(cosine >= 1.0 - widest * widest / 2.0)
            dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine[ia, ib]))
            reach = a.radii[level][ia] + b.radii[level][ib]
        else:
            ia, ib = nodes_a, nodes_b
            pa_, pb_ = a.points[a.centers[level][ia]], b.points[b.centers[level][ib]]
            dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", pa_, pb_)))
            reach = a.radii[level][ia] + b.radii[level][ib]
        open_ = dist - reach <= limit + SLACK
        ia, ib, dist, reach = ia[open_], ib[open_], dist[open_], reach[open_]
        if not len(ia):
            return
        if nodes_a is None and len(ia) > DENSE * len(a.starts[level]) * len(b.starts[level]):
            continue
        inside = dist + reach < limit - SLACK
        if inside.any():
            yield "nodes", np.stack([a.starts[level][ia[inside]], a.ends(level)[ia[inside]]], 1), np.stack([b.starts[level][ib[inside]], b.ends(level)[ib[inside]]], 1)
        ia, ib = ia[~inside], ib[~inside]
        child = lambda t: (np.searchsorted(t.starts[level + 1], t.starts[level]), np.searchsorted(t.starts[level + 1], t.ends(level)))  # noqa: B023, E731
        nodes_a, nodes_b = _combine(ia, ib, *child(a), *child(b))
        if not len(nodes_a):
            return
    if nodes_a is None:
        ia, ib = np.nonzero(a.points @ b.points.T >= threshold)
        yield "points", ia, ib
        return
    for start in range(0, len(nodes_a), 1 << 18):
        i, j = nodes_a[start : start + (1 << 18)], nodes_b[start : start + (1 << 18)]
        linked = np.einsum("ij,ij->i", a.points[i], b.points[j]) >= threshold
        yield "points", i[linked], j[linked]


def _smallest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest node reachable from each of n nodes."""
    label = np.arange(n)
    if not edges:
        return label
    i, j = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def page_links(a: Tree, ids_a: np.ndarray, copies_a: np.ndarray, b: Tree | None, ids_b: np.ndarray, copies_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, smallest id reached, links) of the vectors of two pages, or of one page with itself (b None)."""
    alone = b is None
    ids = ids_a if alone else np.concatenate([ids_a, ids_b])
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # nodes of the forest are numbered by id
    shift = 0 if alone else len(ids_a)
    links = np.zeros(len(ids), np.int64)
    total_a, total_b = np.append(0, np.cumsum(copies_a)), np.append(0, np.cumsum(copies_b))
    edges = []
    for kind, i, j in traverse(a, a if alone else b, threshold):
        if kind == "points":
            if alone:
                i, j = i[i != j], j[i != j]
            np.add.at(links, i, copies_b[j])
            if not alone:
                np.add.at(links, shift + j, copies_a[i])
            edges.append((rank[i], rank[shift + j]))
            continue
        for (a0, a1), (b0, b1) in zip(i.tolist(), j.tolist(), strict=True):
            links[a0:a1] += total_b[b1] - total_b[b0]
            if alone and a0 < b1 and b0 < a1:  # ranges of one tree are equal or apart
                links[a0:a1] -= copies_a[a0:a1]
            if not alone:
                links[shift + b0 : shift + b1] += total_a[a1] - total_a[a0]
            edges.append((rank[np.arange(a0, a1)], np.full(a1 - a0, rank[shift + b0])))
            edges.append((rank[shift + np.arange(b0, b1)], np.full(b1 - b0, rank[a0])))
    hit = np.flatnonzero(links)
    least = np.sort(ids)[_smallest(len(ids), edges)[rank[hit]]]
    return ids[hit], least, links[hit]


def _nearest(anchors: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column("width").to_pylist(), np.int64)
            values = batch.column("v").values.to_numpy(zero_copy_only=False)
            offsets = batch.column("v").offsets.to_numpy()
            anchor, distance = np.zeros(len(widths), np.int64), np.zeros(len(widths))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                x = unit(values[offsets[at][:, None] + np.arange(width)[None, :]])
                d = chord(x, anchors[int(width)])
                anchor[at] = d.argmin(axis=1)
                distance[at] = d[np.arange(len(at)), anchor[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchor), pa.array(distance)], names=[*batch.schema.names, "anchor", "distance"])

    return run


def _page(table: pa.Table) -> pa.Table:
    """One page's vectors as a stored tree."""
    table = table.combine_chunks()
    width = table["width"][0].as_py()
    v = table["v"].combine_chunks()
    raw = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    tree, order = build(unit(raw))
    ids, copies = table["class_id"].to_numpy()[order], table["copies"].to_numpy()[order]
    # A level of single points is told by its length alone.
    small = np.uint16 if len(raw) < 1 << 16 else np.int64
    levels = [None if len(start) == len(raw) else (start.astype(small), center.astype(small), radius) for start, center, radius in zip(tree.starts, tree.centers, tree.radii, strict=True)]
    payload = pickle.dumps((raw[order], levels, ids, copies), protocol=5)
    return pa.table({"width": [width], "anchor": [table["anchor"][0].as_py()], "page": [table["page"][0].as_py()], "radius": [float(max(table["distance"].to_numpy())) + SLACK], "n": [len(raw)], "tree": [payload]})


def _load(payload: pa.Buffer) -> tuple[Tree, np.ndarray, np.ndarray]:
    raw, levels, ids, copies = pickle.loads(payload)  # noqa: S301 written by _page in this job
    points = np.arange(len(raw))
    starts, centers, radii = zip(*[(points, points, np.zeros(len(raw))) if level is None else (level[0].astype(np.int64), level[1].astype(np.int64), level[2]) for level in levels], strict=True)
    return Tree(unit(raw), list(starts), list(centers), list(radii)), ids, copies


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """One row per id of all that pairs of pages gave."""
    ids, least, links = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    every, at = np.unique(np.concatenate([ids, least]), return_inverse=True)
    one, other = at[: len(ids)], at[len(ids) :]
    total = np.zeros(len(every), np.int64)
    np.add.at(total, one, links)
    hit = np.flatnonzero(total)
    return pa.table([pa.array(x, pa.int64()) for x in (every[hit], every[_smallest(len(every), [(one, other)])[hit]], total[hit])], names=["a", "b", "links"])


def _joined(threshold: float):
    """The links of the pages of one tile with those of another that they open."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {no: i for i, no in enumerate(right["no_b"].to_pylist())}
        found = []
        for no, opens, tree in zip(left["no_a"].to_pylist(), left["opens"].to_pylist(), left["tree"], strict=True):
            a, ids_a, copies_a = _load(tree.as_buffer())
            for other in opens:
                b, ids_b, copies_b = (None, ids_a, copies_a) if other == no else _load(right["tree"][place[other]].as_buffer())
                found.append(page_links(a, ids_a, copies_a, b, ids_b, copies_b, threshold))
        return _merged(found)

    return run


def _spread(sample: np.ndarray, k: int) -> np.ndarray:
    """k vectors far from each other, chosen one by one as the farthest from those chosen."""
    chosen, gap = [0], chord(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)):
        nxt = int(gap.argmax())
        if gap[nxt] <= SLACK:
            break
        chosen.append(nxt)
        gap = np.minimum(gap, chord(sample, sample[nxt : nxt + 1])[:, 0])
    return sample[chosen]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, and class_size, the rows with this very vector.

    Two vectors are linked when their cosine in double precision is at least the threshold; vectors of different widths
    are not compared. Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing
    and stand for themselves. Equal vectors are one class until the end and count as linked with each other. A row is
    kept if its id is the smallest of its component; rows that repeat a kept id are all kept, since nothing tells them
    apart. Null ids rank above all others. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    classes = stored(
        rows.where("good").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn("class_id", F.monotonically_increasing_id()).withColumn("width", F.size("v")),
        "classes",
    )
    counts = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    anchors: dict[int, np.ndarray] = {}
    for width, n in counts.items():
        picked = classes.where(F.col("width") == width).orderBy(F.xxhash64("v"), "class_id").limit(SAMPLE).select("v").toPandas()["v"]
        anchors[width] = _spread(unit(np.stack([np.asarray(x, np.float64) for x in picked])), max(1, min(ANCHORS, math.ceil(n / PAGE))))
    kind = dict(classes.dtypes)["v"]
    placed = Stored(classes.select("class_id", "copies", "width", "v").mapInArrow(_nearest(anchors), f"class_id long, copies long, width int, v {kind}, anchor long, distance double"), "placed")
    sizes = placed.df.groupBy("width", "anchor").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    paged = placed.df.join(sizes, ["width", "anchor"]).withColumn("page", F.pmod(F.xxhash64("class_id"), "pages"))
    pages = Stored(
        paged.groupBy("width", "anchor", "page").applyInArrow(_page, "width long, anchor long, page long, radius double, n long, tree binary"),
        "pages",
    )
    placed.drop()
    results = _results(spark, classes, pages, anchors, threshold)
    good_rows = rows.where("good").join(results, "v").select("vec_id", "n_links", "component_id", "class_size")
    bad_rows = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return good_rows.unionByName(bad_rows).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).select("vec_id", "n_links", "component_id", "kept", "class_size")


def _tiled(pages: DataFrame) -> DataFrame:
    """One row per page, without its tree: its number and its tile. Pages of near anchors share a tile, and tiles hold like numbers of vectors."""
    every, order = Window.partitionBy("width"), Window.partitionBy("width").orderBy("anchor", "page")
    own = F.col("n") * F.col("width")
    cells = F.sum(own).over(every)
    tiles = F.greatest(F.ceil(cells / TILE_CELLS), F.least(F.lit(LEAST_TILES), F.count("*").over(every)))
    before = F.coalesce(F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(pages.select("width", "anchor", "page", "radius", F.row_number().over(order).alias("no"), F.floor(before * tiles / cells).alias("tile")), "listed")


def _travel(spark, pages: DataFrame, anchors: dict[int, np.ndarray], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pages with those they open in another tile, and the opened pages of that tile: every page once for each tile it meets."""
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK
    listed = _tiled(pages)
    tops = listed.groupBy("width", "anchor").agg(F.max("radius").alias("radius")).collect()  # a row per anchor
    radius = {(r["width"], r["anchor"]): r["radius"] for r in tops}
    opened = []
    for width, centers in anchors.items():
        d = chord(centers, centers)
        here = [k for w, k in radius if w == width]
        opened += [(width, p, q, float(d[p, q])) for p in here for q in here if p <= q and d[p, q] - radius[width, p] - radius[width, q] <= limit]
    frontier = spark.createDataFrame(opened, "width long, anchor_a long, anchor_b long, apart double")

    def side(name: str) -> DataFrame:
        return listed.select("width", *[F.col(c).alias(f"{c}_{name}") for c in ("anchor", "page", "radius", "no", "tile")])

    def trees(name: str) -> DataFrame:
        with_no = pages.join(listed.select("width", "anchor", "page", "no"), ["width", "anchor", "page"])
        return with_no.select("width", F.col("no").alias(f"no_{name}"), "tree")

    pairs = frontier.join(side("a"), ["width", "anchor_a"]).join(side("b"), ["width", "anchor_b"])
    pairs = pairs.where((F.col("apart") - F.col("radius_a") - F.col("radius_b") <= limit) & ((F.col("anchor_a") < F.col("anchor_b")) | (F.col("page_a") <= F.col("page_b"))))
    opens = stored(pairs.groupBy("width", "tile_a", "tile_b", "no_a").agg(F.collect_list("no_b").alias("opens")), "opens")
    met = opens.select("width", "tile_a", "tile_b", F.explode("opens").alias("no_b")).distinct()
    left, right = opens.join(trees("a"), ["width", "no_a"]), met.join(trees("b"), ["width", "no_b"])
    # New column identities, as both sides come from one table.
    return tuple(df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))


def _results(spark, classes: DataFrame, pages: Stored, anchors: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(v, n_links, component_id, class_size) of every class."""
    tile = ["width", "tile_a", "tile_b"]
    left, right = (df.groupBy(*tile) for df in _travel(spark, pages.df, anchors, threshold))
    found = Stored(left.cogroup(right).applyInArrow(_joined(threshold), "a long, b long, links long"), "links")
    pages.drop()
    links = stored(found.df.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links")), "links")
    joined = components(found.df.select("a", "b"))
    found.drop()
    narrow = classes.select("class_id", "first_id", "copies")
    whole = narrow.join(links, "class_id", "left").join(joined, narrow["class_id"] == joined["node"], "left").withColumn("component", F.coalesce("component", "class_id"))
    whole = stored(whole.select("class_id", "first_id", "copies", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    leads = stored(whole.groupBy("component").agg(F.min("first_id").alias("component_id")), "leads")
    results = stored(whole.join(leads, "component").select("class_id", "n_links", "component_id", F.col("copies").alias("class_size")), "results")
    return classes.select("class_id", "v").join(results, "class_id").drop("class_id")
