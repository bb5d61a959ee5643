"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

Linear grouping: the large lengths, sorted, are cut into groups of equal cardinality and rounded up to the largest of
their group; configurations of these few sizes are optimised by column generation; the actual pieces of a group take
the places of its rounded size; what is left over and all small lengths go by best fit, longest first.

A length is at most the capacity, so the histogram, the configurations and the plan made from them are bounded by the
capacity however many documents there are. Only they are on the driver; the pieces stay distributed, and each finds
its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common, tokens

CAPACITY = 2048
GROUPS = 128
#: A length under capacity / small is small; with 0 all lengths are. The plan with the fewest sequences is taken.
SMALL = (2, 4, 8, 0)
RANK_ROWS = 1_000_000  # pieces that are ranked together, about
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, low bigint, high bigint, sequence bigint, per bigint, place bigint"


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Encodes (doc_id, text), appends ``end_id`` and cuts what is longer than the capacity; a shorter piece comes first."""
    tokenizer = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = tokens.encoder(tokenizer).encode(batch.column(1))
            found, ends = np.insert(found, ends, end_id), ends + np.arange(1, len(ends) + 1)
            size = np.diff(ends, prepend=0)
            many = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = size - (many - 1) * capacity  # the first piece takes what doesn't fill a sequence
            length = np.where(piece, capacity, first[row])
            start = np.where(piece, first[row] + (piece - 1) * capacity, 0)
            place = (ends - size)[row] + start
            sums = [zlib.crc32(found[a : a + n]) for a, n in zip(place.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), cut, PIECES)


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of configurations (how many of each size) from the linear programme of the rounded sizes."""
    k = len(sizes)
    base = np.diag((capacity // sizes).astype(float))  # columns of the basis
    inverse, cost, amount = np.linalg.inv(base), np.ones(k), demand / (capacity // sizes)
    most = capacity // sizes.min()
    for _ in range(rounds):
        dual = cost @ inverse
        if dual.min() < -1e-9:
            column, price = np.zeros(k), 0.0
            column[dual.argmin()] = -1
        else:
            best = np.zeros((most + 1, capacity + 1))
            taken = np.full((most + 1, capacity + 1), -1)
            for m in range(1, most + 1):
                best[m] = best[m - 1]
                for g, (s, v) in enumerate(zip(sizes, dual)):
                    if v > 0:
                        gain = best[m - 1][: capacity + 1 - s] + v
                        better = gain > best[m][s:] + 1e-12
                        best[m][s:][better], taken[m][s:][better] = gain[better], g
            if best[most][capacity] <= 1 + 1e-7:
                break
            column, price, room = np.zeros(k), 1.0, capacity
            for m in range(most, 0, -1):
                if (g := taken[m][room]) >= 0:
                    column[g] += 1
                    room -= sizes[g]
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        out = int(ratio.argmin())
        theta = ratio[out]
        amount = np.maximum(amount - theta * step, 0)
        amount[out] = theta
        base[:, out], cost[out] = column, price
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [(base[:, j].astype(int), int(amount[j] + 1e-6)) for j in range(k) if base[:, j].min() >= 0 and amount[j] >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, ...]], int]:
    """The best of the plans for different bounds between large and small; see ``grouped``."""
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best = None
    for small in SMALL:
        found = grouped(histogram, capacity, groups, small)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == least:
            break
    return best


def grouped(histogram: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[tuple[int, ...]], int]:
    """Runs (length, low, high, sequence, per, place) and the number of sequences.

    The piece of rank r among those of its length, low <= r < high, goes to sequence + (r - low) // per, at
    place + ((r - low) % per) * length.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    used = np.zeros(capacity + 1, np.int64)  # ranks given out
    runs: list[tuple[int, ...]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: first sequence, how many
    total = 0

    large = [x for x in range(capacity, max(1, capacity // small) - 1, -1) if count[x]] if small else []
    n_large = int(count[large].sum()) if large else 0
    if n_large:
        group = max(1, -(-n_large // groups))
        members: list[list[list[int]]] = []  # of each group: [length, how many], longest first
        sizes: list[int] = []
        left = 0
        for x in large:
            n = int(count[x])
            while n:
                if not left:
                    left = group
                    if not sizes or sizes[-1] != x:
                        sizes.append(x)
                        members.append([])
                take = min(n, left)
                if members[-1] and members[-1][-1][0] == x:
                    members[-1][-1][1] += take
                else:
                    members[-1].append([x, take])
                n, left = n - take, left - take
        demand = np.array([sum(n for _, n in m) for m in members])
        for config, times in sorted(_configurations(np.array(sizes), demand, capacity), key=lambda x: (-x[1], x[0].tolist())):
            times = min([times, *(sum(n for _, n in members[g]) // a for g, a in enumerate(config) if a)])
            if times <= 0:
                continue
            slots = []  # of each place in the configuration: runs of one length
            for g, a in enumerate(config):
                for _ in range(a):
                    need, got = times, []
                    while need:
                        x, n = members[g][0]
                        take = min(n, need)
                        got.append((x, take))
                        need -= take
                        members[g][0][1] -= take
                        if not members[g][0][1]:
                            members[g].pop(0)
                    slots.append(got)
            cuts = sorted({c for got in slots for c in np.cumsum([n for _, n in got]).tolist()})
            at = [[0, 0] for _ in slots]
            done = 0
            for cut in cuts:
                n, place = cut - done, 0
                for slot, got in zip(at, slots):
                    x = got[slot[0]][0]
                    runs.append((x, int(used[x]), int(used[x]) + n, total, 1, place))
                    used[x] += n
                    place += x
                    slot[1] += n
                    if slot[1] == got[slot[0]][1]:
                        slot[:] = [slot[0] + 1, 0]
                room[capacity - place].append((total, n))
                total, done = total + n, cut

    for x in range(capacity, 0, -1):
        n = int(count[x] - used[x])
        free = x
        while n:
            while free <= capacity and not room[free]:
                free += 1
            if free > capacity:
                first, bins, free = total, -(-n // (capacity // x)), capacity
                total += bins
            else:
                first, bins = room[free].pop()
            per = free // x
            full = min(bins, n // per)
            if full:
                runs.append((x, int(used[x]), int(used[x]) + full * per, first, per, capacity - free))
                used[x] += full * per
                n -= full * per
                room[free - per * x].append((first, full))
            rest = bins - full
            if rest and n:  # fewer than per are left
                runs.append((x, int(used[x]), int(used[x]) + n, first + full, n, capacity - free))
                used[x] += n
                room[free - n * x].append((first + full, 1))
                rest, full, n = rest - 1, full + 1, 0
            if rest:
                room[free].append((first + full, rest))
    return runs, total


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``.

    ``found`` should be a kept table: it is read three times. Ranks are counted within buckets of a length, and the
    counts of the buckets are summed up, so that a length that a third of all pieces share is dealt out.
    """
    spark = found.sparkSession
    buckets = max(16, -(-found.count() // RANK_ROWS))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = found.groupBy("length", "bucket").count()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most one row a length
    runs, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("ahead"))
    steps = F.broadcast(spark.createDataFrame(runs, PLAN).withColumnRenamed("length", "size"))  # bounded by the capacity
    placed = ranked.join(steps, (F.col("length") == F.col("size")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))
    at = F.col("r") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + at % F.col("per") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents (doc_id, text); null and empty texts are a piece of one token. Other columns are not used.

    Rows with equal doc_id are documents of their own. An empty table gives no rows.
    """
    return pack(common.keep(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.load(spark, sf_dir, "documents"))
