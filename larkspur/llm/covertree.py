"""Embedding near-duplicates by cover-tree dual traversal: exact threshold links by cosine.

On vectors of length one, a cosine of at least c is a distance of at most sqrt(2 - 2c). The uppermost net of the tree
(pivots from a bounded sample, farthest first) deals distinct vectors out to cells; a vector visits the other cells
whose covering radius and bisecting plane let a link through. In a cell, members and visitors each make a cover tree
of nested nodes with halving radii, and node pairs are dropped when their centres are farther apart than the threshold
and both covering radii, or linked as a whole when even the farthest of them are near enough. Pairs of leaves are
compared in a few leading directions of the sample first, with what is left of each vector as one more component:
distances there are never longer than the true ones, so that only pairs within reach are verified on whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, vectors
from larkspur.llm.labels import Labels

COSINE = 0.9
LEAF, CENTRES = 64, 48
CELL_ROWS, CELL_BYTES = 2048, 1 << 22  # of members that a task holds: so many rows, or more if they are short
DIRECTIONS, BASIS_ROWS = 24, 2048
PIVOTS, SAMPLE_ROWS = 1024, 8192  # at most
BATCH_ROWS = 4096  # of visitors at a time
SLACK = 1e-6  # above the rounding of distances that come from cosines
NOISE = 1e-7  # distances up to this are rounding, also a vector's to itself


class Node:
    __slots__ = ("centre", "children", "radius", "rows")

    def __init__(self, rows: np.ndarray, centre: np.ndarray, radius: float):
        self.rows, self.centre, self.radius, self.children = rows, centre, radius, []


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ centre), 0))


def build(x: np.ndarray) -> Node:
    """A cover tree over unit vectors. A level takes centres that are more than its radius apart, each with what it
    covers; what so many centres leave uncovered (vectors far from each other) is a leaf under the same centre."""
    top = Node(np.arange(len(x)), x[0], float(distances(x, x[0]).max()))
    todo = [(top, max(top.radius / 2, NOISE))]
    while todo:
        node, reach = todo.pop()
        if len(node.rows) <= LEAF or node.radius <= NOISE:
            continue
        left = node.rows
        for _ in range(CENTRES):
            if not len(left):
                break
            far = distances(x[left], x[left[0]])
            near = far <= reach
            near[0] = True
            child = Node(left[near], x[left[0]], float(far[near].max()))
            left = left[~near]
            if len(child.rows) > 1 or len(left) == 0:
                node.children.append(child)
                todo.append((child, reach / 2))
            else:  # alone: it stays with the rest
                node.children.append(child)
        alone = [c for c in node.children if len(c.rows) == 1]
        if alone or len(left):
            rows = np.concatenate([left, *(c.rows for c in alone)])
            node.children = [c for c in node.children if len(c.rows) > 1]
            node.children.append(Node(rows, node.centre, float(distances(x[rows], node.centre).max())))
        if len(node.children) == 1 and len(node.children[0].rows) == len(node.rows):
            child = node.children.pop()  # no centre covers any other: a leaf, or one step further down
            if child.radius < node.radius / 2:
                node.children.append(child)
    return top


def basis(sample: np.ndarray) -> np.ndarray:
    """The leading directions (as columns) of a sample of unit vectors: orthonormal, at most DIRECTIONS."""
    return np.linalg.svd(sample[:BASIS_ROWS], full_matrices=False)[2][:DIRECTIONS].T


def shadow(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors in those directions and, as a last component, the length of the rest: unit vectors again, whose
    products are never below those of the vectors themselves."""
    short = x @ directions
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", short, short), 0))
    return np.c_[short, rest].astype(np.float32)


def traverse(x: np.ndarray, tree: Node, y: np.ndarray, other: Node, cosine: float, x_shadow: np.ndarray, y_shadow: np.ndarray):
    """Yields (a, b, single): rows of x and of y that are linked, one to one or, unless single, all with all. With
    tree is other, a pair of rows comes both ways round."""
    reach = float(np.sqrt(2 - 2 * cosine))
    todo = [(tree, other)]
    while todo:
        a, b = todo.pop()
        apart = float(np.sqrt(max(np.dot(d := a.centre - b.centre, d), 0)))
        if apart - a.radius - b.radius > reach + SLACK:
            continue
        if apart + a.radius + b.radius < reach - SLACK:
            yield a.rows, b.rows, False
        elif not a.children and not b.children:
            for at in range(0, len(a.rows), 1024):
                rows = a.rows[at : at + 1024]
                rough = x_shadow[rows] @ y_shadow[b.rows].T >= cosine - 1e-4
                i, j = np.nonzero(rough)
                for k in (every := vectors.steps(len(i), x.shape[1])):
                    one, two = rows[i[k : k + every.step]], b.rows[j[k : k + every.step]]
                    near = np.einsum("ij,ij->i", x[one], y[two]) >= cosine
                    yield one[near], two[near], True
        elif tree is other and a is b:
            todo += [(c, d) for c in a.children for d in a.children]
        elif a.children and (not b.children or a.radius >= b.radius):
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]


class Cell:
    """The members of one cell; counts their links, weighted by the copies of the other, and passes links on."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, cosine: float, directions: np.ndarray):
        self.ids, self.weights, self.x, self.cosine, self.directions = ids, weights, x, cosine, directions
        self.tree, self.shadow = build(x), shadow(x, directions)

    def _found(self, ids: np.ndarray, weights: np.ndarray, pairs, offset: int, both: bool) -> pa.RecordBatch:
        count = np.zeros(len(ids), np.int64)
        labels = Labels(len(ids))
        for a, b, single in pairs:
            b = b + offset
            if not single:
                count[a] += weights[b].sum()
                if both:
                    count[b] += weights[a].sum()
                labels.link(np.r_[np.full(len(b), a[0]), np.full(len(a), b[0])], np.r_[b, a])
            else:
                np.add.at(count, a, weights[b])
                if both:
                    np.add.at(count, b, weights[a])
                labels.link(a, b)
        if not both:
            count -= weights  # each was counted with itself
        keep = (count > 0) | (labels.of != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(count[keep]), pa.array(ids[labels.of[keep]])], ["id", "n", "root"])

    def within(self) -> pa.RecordBatch:
        return self._found(self.ids, self.weights, traverse(self.x, self.tree, self.x, self.tree, self.cosine, self.shadow, self.shadow), 0, False)

    def visited(self, ids: np.ndarray, weights: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        pairs = traverse(self.x, self.tree, y, build(y), self.cosine, self.shadow, shadow(y, self.directions))
        return self._found(np.r_[self.ids, ids], np.r_[self.weights, weights], pairs, len(self.ids), True)


def _unit(column: pa.Array, wide: int) -> np.ndarray:
    x = vectors.matrix(column, wide)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _join(batches: Iterator[pa.RecordBatch], wide: int, cosine: float, directions: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (cell, chunk, visitor, id, weight, embedding), sorted so that a cell's members come before its visitors."""
    cell: Cell | None = None
    now, held = None, []

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal cell, held
        if cell is None and held:
            cell = Cell(*(np.concatenate(x) for x in zip(*held)), cosine, directions)
            held = []
            yield cell.within()

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
        guest = batch.column(2).to_numpy()
        marks = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(1) | (np.diff(guest) != 0), True])
        for a, b in zip(marks, marks[1:]):
            if (key := tuple(keys[a])) != now:
                yield from settle()
                now, cell, held = key, None, []
            for at in range(a, b, BATCH_ROWS):
                part = batch.slice(at, min(BATCH_ROWS, b - at))
                rows = part.column(3).to_numpy(), part.column(4).to_numpy(), vectors.unpacked(part.column(5), wide)
                if not guest[a]:
                    held.append(rows)
                else:
                    yield from settle()
                    if cell is not None:
                        yield cell.visited(*rows)
    yield from settle()


def links(rows: DataFrame, wide: int, cosine: float = COSINE, cell_rows: int | None = None) -> DataFrame:
    """For distinct vectors (id, weight, embedding; a kept table): rows (id, n, root), n the weight of what it is
    linked to as far as one task saw, root a vector in the same component."""
    cell_rows = cell_rows or max(CELL_ROWS, CELL_BYTES // (8 * max(wide, 1)))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = _unit(sample, wide) if total else np.zeros((0, wide))
    chosen, gap = [], np.full(len(sample), np.inf)
    for _ in range(min(PIVOTS, len(sample), -(-total // cell_rows))):
        if chosen and gap.max() <= SLACK:
            break  # all others have the direction of a pivot
        chosen.append(0 if not chosen else int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1]]))
    pivots, directions = sample[chosen], basis(sample) if total else np.zeros((wide, 0))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in (every := vectors.steps(whole.num_rows, wide)):
                batch = whole.slice(at, every.step)
                x = _unit(batch.column(2), wide)
                far = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors.packed(x), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["id", "weight", "vector", "cell", "far"])

    at_home = common.keep(rows.select("id", "weight", "embedding").mapInArrow(home, "id bigint, weight bigint, vector binary, cell int, far double"), "cells")
    found = {r.cell: r for r in at_home.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}  # at most PIVOTS rows
    radius = np.array([found[c].radius if c in found else -np.inf for c in range(len(pivots))])
    chunks = np.array([max(1, -(-found[c].n // (2 * cell_rows))) if c in found else 1 for c in range(len(pivots))], np.int64)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-300))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                far = np.sqrt(np.maximum(2 - 2 * vectors.unpacked(batch.column(2), wide) @ pivots.T, 0))
                mine = far[np.arange(len(cell)), cell]
                plane = (far**2 - (mine**2)[:, None]) / (2 * between[cell])
                go = (far <= radius + reach) & (plane <= reach) & (np.arange(len(pivots)) > cell[:, None])
                own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[cell]
                i, c = np.nonzero(go)
                span = chunks[c]
                i, c = np.repeat(i, span), np.repeat(c, span)
                k = np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)
                # chunks of the same cell before one's own
                j = np.repeat(np.arange(len(cell)), own)
                before = np.arange(len(j)) - np.repeat(np.cumsum(own) - own, own)
                take = np.r_[np.arange(len(cell)), i, j]
                to = np.r_[cell, c, cell[j]], np.r_[own, k, before], np.r_[np.zeros(len(cell), np.int8), np.ones(len(i) + len(j), np.int8)]
                for k in (every := vectors.steps(len(take), wide)):
                    some = slice(k, k + every.step)
                    rows_to = batch.take(pa.array(take[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[0][some].astype(np.int32)), pa.array(to[1][some].astype(np.int32)), pa.array(to[2][some]), *rows_to.columns[:3]], ["cell", "chunk", "visitor", "id", "weight", "vector"])

    dealt = at_home.mapInArrow(visit, "cell int, chunk int, visitor tinyint, id bigint, weight bigint, vector binary")
    dealt = dealt.repartition(int(min(4096, max(8, chunks.sum()))), "cell", "chunk").sortWithinPartitions("cell", "chunk", "visitor")
    return dealt.mapInArrow(lambda batches: _join(batches, wide, cosine, directions), "id bigint, n bigint, root bigint")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, cell_rows: int | None = None) -> DataFrame:
    """A row for each row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are compared once and count as often as they occur. Vectors that are null, zero, hold null or
    non-finite components or are not of the usual length link with nothing, nor do rows without vec_id (those have
    no component and are not kept). Rows with equal vec_id count one by one. Other columns are not used. An empty
    table gives no rows.
    """
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = rows.where(vectors.usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    wide = vectors.width(sound)
    sound = sound.where(F.size("embedding") == wide)
    classes = common.keep(sound.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")), "classes")
    # one vec_id may stand at different vectors: nodes are numbers of their own only then
    repeated = classes.groupBy("least").count().where("count > 1").limit(1).count()
    node = F.xxhash64("embedding") if repeated else F.col("least")
    classes = common.keep(classes.withColumn("id", node), "nodes")
    found = common.keep(links(classes.select("id", "weight", "embedding"), wide, cosine, cell_rows), "near")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = classes.join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "component").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = sound.join(known, "embedding").select("vec_id", "n_links", "component_id")
    odd = rows.where(~(vectors.usable(F.col("embedding")) & F.col("vec_id").isNotNull()) | (F.size("embedding") != wide))
    out = out.union(odd.select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.load(spark, sf_dir, "embeddings"))
