"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several tables hashes a vector by floors of shifted Gaussian projections. A query visits, in each table, its
own bucket and those next to it in the order of their estimated success (squared distances to the boundaries crossed).
Projections are made orthogonal to each other as far as there are dimensions, so that no two tables tell the same.
Candidates of all tables are merged and ranked by exact distance on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common, vectors

K = 10
QUERY_STEP = 100
TABLES, PROJECTIONS, PROBES = 6, 10, 160
#: Bucket width in units of the median distance of a sample; wide enough for a recall of 0.9 where vectors have no structure.
WIDTH = 1.75
SAMPLE_ROWS = 1000
TASK_ROWS = 16_384  # vectors that a task holds, about


class Hash:
    """The tables' projections; the same at every run for the same width."""

    def __init__(self, wide: int, scale: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH):
        rng = np.random.default_rng(11)
        self.width = max(width * scale, 1e-300)
        axes = rng.normal(size=(tables * projections, wide))
        for at in range(0, len(axes), wide):  # as many at a time as can be orthogonal, of the length that they have on average
            axes[at : at + wide] = np.linalg.qr(axes[at : at + wide].T)[0].T * np.sqrt(wide)
        self.axes = axes.reshape(tables, projections, wide).transpose(0, 2, 1)
        self.shift = rng.uniform(0, 1, (tables, projections))
        self.odd = rng.integers(1, 1 << 62, (tables, projections)) * 2 + 1

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.axes[table] / self.width + self.shift[table]

    def bucket(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One number for each row of cells; buckets that meet in one number only share candidates."""
        with np.errstate(over="ignore"):
            mixed = (cells.astype(np.int64) * self.odd[table]).sum(axis=-1)
            return mixed ^ (mixed >> 29)

    def probes(self, place: np.ndarray, table: int, most: int) -> np.ndarray:
        """The buckets to visit from one query's place, likeliest first."""
        cell = np.floor(place).astype(np.int64)
        below = place - cell
        m = len(cell)
        cost = np.r_[below, 1 - below] ** 2
        order = np.argsort(cost, kind="stable")
        axis, move = order % m, np.where(order < m, -1, 1)
        cost = cost[order]
        sets: list[tuple[int, ...]] = [()]
        heap = [(float(cost[0]), (0,))]
        while heap and len(sets) < most:
            score, chosen = heapq.heappop(heap)
            if len({int(axis[i]) for i in chosen}) == len(chosen):  # not both ways along one axis
                sets.append(chosen)
            last = chosen[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (score - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (score + float(cost[last + 1]), (*chosen, last + 1)))
        cells = np.repeat(cell[None], len(sets), 0)
        for row, chosen in zip(cells, sets):
            for i in chosen:
                row[axis[i]] += move[i]
        return np.unique(self.bucket(cells, table))


def nearest(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the rows by exact distance, ties to the smaller id, without the query's own row."""
    gap = x - query
    score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    keep = ids != own
    ids, score = ids[keep], score[keep]
    if len(score) > k:
        keep = score <= np.partition(score, k - 1)[k - 1]
        ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, score))[:k]
    return ids[order], score[order]


def _match(batches: Iterator[pa.RecordBatch], wide: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, is_row, id, vector, buckets) sorted so that a part's queries come before its rows. A query
    without buckets looks at all rows of the part. Yields a query's best among the rows of a batch."""
    names = ["query_id", "vec_id", "score"]
    now, queries = None, []
    for batch in batches:
        part, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        marks = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(is_row) != 0), True])
        for a, b in zip(marks, marks[1:]):
            if part[a] != now:
                now, queries = part[a], []
            piece = batch.slice(a, b - a)
            ids, x = piece.column(2).to_numpy(), vectors.unpacked(piece.column(3), wide)
            buckets = piece.column(4).to_pylist()
            if not is_row[a]:
                queries += [(i, v, None if w is None else np.array(w)) for i, v, w in zip(ids, x, buckets)]
                continue
            bucket = np.array([w[0] for w in buckets])
            order = np.lexsort((ids, bucket))
            bucket, ids, x = bucket[order], ids[order], x[order]
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for own, query, wanted in queries:
                if wanted is None:
                    rows = slice(None)
                else:
                    low, high = np.searchsorted(bucket, wanted), np.searchsorted(bucket, wanted, "right")
                    size = high - low
                    if not size.sum():
                        continue
                    rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
                found.append((own, *nearest(query, own, ids[rows], x[rows], k)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[2] for f in found]).astype(np.float64))], names)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what the tasks found: a few rows for each task that it visited."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(dealt: DataFrame, wide: int, k: int) -> DataFrame:
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "is_row")
    return dealt.mapInArrow(lambda batches: _match(batches, wide, k), "query_id bigint, vec_id bigint, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, projections: int = PROJECTIONS, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """The k nearest rows of each query, both (vec_id, embedding): query_id, rank, vec_id, score.

    Vectors that are null, zero, hold null or non-finite components or are not of the usual length take no part, nor
    do rows without vec_id. A query doesn't find rows with its own vec_id. Rows with equal vec_id and distance come
    back once. A query for which the tables give fewer than k rows looks at all rows. Other columns are not used;
    an empty table gives no rows.
    """
    spark = rows.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.where(vectors.usable(F.col("embedding")) & F.col("id").isNotNull())

    rows = sound(rows)
    wide = vectors.width(rows)
    rows, queries = rows.where(F.size("embedding") == wide), sound(queries).where(F.size("embedding") == wide)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = vectors.matrix(sample, wide) if wide else np.zeros((0, 1))
    half = len(sample) // 2
    scale = float(np.median(np.linalg.norm(sample[:half] - sample[half : 2 * half], axis=1))) if half else 1.0
    hashed = Hash(wide or 1, scale or 1.0, tables, projections, width)
    total = rows.count()
    parts = max(1, -(-total // TASK_ROWS))  # of each table, by bucket

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in (every := vectors.steps(whole.num_rows, wide)):
                batch = whole.slice(at, every.step)
                x = vectors.unpacked(batch.column(1), wide)
                for t in range(tables):
                    bucket = hashed.bucket(np.floor(hashed.places(x, t)), t)
                    yield pa.RecordBatch.from_arrays([pa.array(t * parts + bucket % parts), *batch.columns, pa.array(bucket)], ["slot", "id", "vector", "bucket"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            x = vectors.unpacked(batch.column(1), wide)
            for t in range(tables):
                for i, place in enumerate(hashed.places(x, t)):
                    wanted = hashed.probes(place, t, probes)
                    to = wanted % parts
                    out += [(t * parts + int(p), i, wanted[to == p].tolist()) for p in np.unique(to)]
            for k in (every := vectors.steps(len(out), wide)):
                some = out[k : k + every.step]
                at = pa.array([r[1] for r in some], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), *batch.take(at).columns, pa.array([r[2] for r in some], pa.list_(pa.int64()))], ["slot", "id", "vector", "buckets"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in (every := vectors.steps(whole.num_rows, wide)):
                batch = whole.slice(at, every.step)
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors.packed(vectors.matrix(batch.column(1), wide))], ["id", "vector"])

    rows, queries = (df.mapInArrow(pack, "id bigint, vector binary") for df in (rows, queries))
    tabled = rows.mapInArrow(index, "slot bigint, id bigint, vector binary, bucket bigint")
    # a slot with a hot bucket is dealt out further; its queries go to each of its shares
    shares = common.keep(tabled.groupBy("slot").agg(F.ceil(F.count("*") / (2 * TASK_ROWS)).cast("bigint").alias("shares")), "shares")
    key = F.col("slot") * (1 << 20)
    tabled = tabled.join(shares, "slot").select((key + F.pmod(F.xxhash64("id"), F.col("shares"))).alias("part"), F.lit(1).cast("tinyint").alias("is_row"), "id", "vector", F.array("bucket").alias("buckets"))
    asked = queries.mapInArrow(probe, "slot bigint, id bigint, vector binary, buckets array<bigint>").join(shares, "slot")
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).select((key + F.col("share")).alias("part"), F.lit(0).cast("tinyint").alias("is_row"), "id", "vector", "buckets")
    found = common.keep(_best(_search(asked.union(tabled), wide, k), k), "neighbours")

    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = queries.join(full, queries.id == full.query_id, "left_anti")
    if short.limit(1).count():
        n = max(1, -(-total // TASK_ROWS))
        everywhere = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("part").cast("bigint").alias("part"), F.lit(0).cast("tinyint"), "id", "vector", F.lit(None).cast("array<bigint>"))
        blocks = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("part"), F.lit(1).cast("tinyint"), "id", "vector", F.array(F.lit(0).cast("bigint")))
        found = found.join(full, "query_id", "left_semi").union(_best(_search(everywhere.union(blocks).toDF("part", "is_row", "id", "vector", "buckets"), wide, k), k))
    return found


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.load(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))
