"""SimHash near-duplicates: fingerprints of whole texts, linked by a Gray-order hierarchical index.

Fingerprints within ``distance`` bits agree on some block when their bits are cut into more blocks than that, so a few
bits of a block deal them out to tasks: only as many bits as leave some thousands of them together, however many
there are. In each such group fingerprints are sorted by Gray rank, so neighbours share bits. Runs of them make nodes,
level by level up to one, which hold the bits that all below them share; a search adds up the differences on the bits
that each level newly fixes and drops a whole node as soon as they are too many, or where all below is linked to the
searching one already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.labels import Labels

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
FAN_OUT = 16
GROUP_ROWS = 20_000  # a larger group is compared chunk by chunk
TASK_ROWS = 500_000  # rows whose groups are searched together
PAIRS = 2_000_000  # comparisons at a time, at most about
TREE_CODES = 4096  # fingerprints of one index, about: the bits that deal them out follow from it
#: A block has too few bits for that beyond so many fingerprints; then agreement on two or three deals them out.
BLOCKS = ((1 << 24, 5), (1 << 33, 6), (float("inf"), 7))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text: A-Z in lower case, words joined in shingles, a bit set if over half have it."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: exactly the ASCII blanks and letters
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, tag): the fingerprint as a signed long, and a hash of the text. Null and empty texts have 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), part.column(2)], ["doc_id", "fp", "tag"])

    return common.map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tag")), score, "doc_id bigint, fp bigint, tag bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def linked(groups: np.ndarray, codes: np.ndarray, distance: int = DISTANCE, fan_out: int = FAN_OUT, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect exactly what lies within ``distance`` bits in the same group, at most one for each code.

    ``tally`` counts levels, nodes (visited), pruned (of these) and compared (pairs of fingerprints).
    """
    order = np.lexsort((gray_rank(codes), groups))
    groups, codes = groups[order], codes[order]
    n = len(codes)
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    group_of = np.cumsum(np.r_[0, groups[1:] != groups[:-1]])
    group_size = np.diff(np.r_[edge, n])
    # levels from the leaves up: first child or code, one past the last, and the bits on which all below agree
    levels = []
    owner, first = group_of, edge  # of the units to be gathered
    low, high = codes, codes
    while True:
        rank = np.arange(len(owner)) - first[owner]
        starts = np.flatnonzero(rank % fan_out == 0)
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        owner = owner[starts]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        levels.append({"start": starts, "stop": np.r_[starts[1:], len(rank)], "bits": low, "mask": ~(low ^ high)})
        if len(owner) == len(edge):
            break
    for lower, upper in zip(levels, levels[1:]):
        parent = np.repeat(np.arange(len(upper["start"])), upper["stop"] - upper["start"])
        lower["fresh"] = lower["mask"] & ~upper["mask"][parent]  # bits that this level newly fixes
    levels[-1]["fresh"] = levels[-1]["mask"]
    last = levels[0]["stop"] - 1  # the last code below a node
    for at, level in enumerate(levels):
        level["last"] = last if at == 0 else levels[at - 1]["last"][level["stop"] - 1]

    tally = {} if tally is None else tally
    tally |= {"levels": len(levels), "nodes": 0, "pruned": 0, "compared": 0}
    labels = Labels(n)
    cost = np.cumsum(group_size[group_of].astype(np.int64))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        low, high = labels.of, labels.of  # where equal below a node, all of it is linked already
        for level in levels:
            low, high = np.minimum.reduceat(low, level["start"]), np.maximum.reduceat(high, level["start"])
            level["label"] = np.where(low == high, low, -1)
        query = np.arange(at, stop)
        query = query[group_size[group_of[query]] > 1]
        node, seen = group_of[query], np.zeros(len(query), np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            seen = seen + np.bitwise_count((codes[query] ^ level["bits"][node]) & level["fresh"][node])
            keep = (seen <= distance) & (level["last"][node] > query) & (level["label"][node] != labels.of[query])
            tally["nodes"] += len(keep)
            tally["pruned"] += len(keep) - int(keep.sum())
            query, node, seen = query[keep], node[keep], seen[keep]
            width = level["stop"][node] - level["start"][node]
            below = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(level["start"][node], width)
            query, seen, node = np.repeat(query, width), np.repeat(seen, width), below
        tally["compared"] += len(node)
        near = (node > query) & (np.bitwise_count(codes[query] ^ codes[node]) <= distance)
        labels.link(query[near], node[near])
        at = stop
    odd = np.flatnonzero(labels.of != np.arange(n))
    return codes[odd], codes[labels.of[odd]]


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Searches whole groups of rows (group, fp) that arrive sorted by group."""

    def links(groups: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        a, b = linked(groups, codes.view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= TASK_ROWS:
            groups, codes = (np.concatenate(x) for x in zip(*held))
            whole = np.searchsorted(groups == groups[-1], True)  # the last group may go on
            if whole:
                yield links(groups[:whole], codes[:whole])
            held, rows = [(groups[whole:], codes[whole:])], len(groups) - whole
    if rows:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def deal_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """For n fingerprints, the bits by which each choice of agreeing blocks deals them out."""
    blocks = next(b for most, b in BLOCKS if n <= most) + distance - DISTANCE
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    wanted = max(0, (n // TREE_CODES).bit_length() - 1)
    if not wanted:
        return [0]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        spread = [wanted // len(chosen) + (i < wanted % len(chosen)) for i in range(len(chosen))]
        masks.append(sum(((1 << min(k, cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i, k in zip(chosen, spread)))
    return masks


def near_links(codes: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all within ``distance`` bits. ``codes``: a kept table.

    A group too large for a task is cut into chunks by hash, and each pair of its chunks is a group of its own.
    """
    masks = deal_masks(codes.count(), distance)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed))))
    rows = codes.select("fp", keys.alias("g")).select("fp", "g.choice", "g.key")
    large = rows.groupBy("choice", "key").count().where(F.col("count") > group_rows)
    large = large.select("choice", "key", F.ceil(F.col("count") / group_rows).cast("int").alias("chunks"))
    rows = rows.join(large, ["choice", "key"], "left")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    # the pairs (i, j), i <= j, of chunks that a row's chunk is part of
    pairs = F.when(F.col("chunks").isNotNull(), F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk)))
    rows = rows.withColumn("pair", F.explode_outer(pairs)).select(F.xxhash64("choice", "key", F.coalesce("pair", F.lit(-1))).alias("group"), "fp")
    # groups that meet in one hash are only searched together
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _search(batches, distance), "a bigint, b bigint")


def _grouped(docs: DataFrame, distance: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, tag) of each row of ``docs``, and (fp, least, component) of each fingerprint; least is a doc_id."""
    marked = common.keep(fingerprints(docs, shingle), "fingerprints")
    codes = common.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    parts = common.components(near_links(codes.select("fp"), distance))
    return marked, codes.join(parts, codes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, tag, component, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links; component is a fingerprint that names the group.

    Texts that are null or hold no words have fingerprint 0 and link like any other. Rows with equal doc_id each come
    back; a null doc_id is never the least unless nothing else is reachable. Other columns are not used. An empty
    table gives no rows.
    """
    marked, grouped = _grouped(docs, distance, shingle)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.join(least, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "fp", "tag", "component", "component_id")


def groups_of_texts(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(tag, component), once each: the group of each text of ``docs`` (doc_id, text), as in ``near_duplicates``."""
    marked, grouped = _grouped(docs, distance, shingle)
    return marked.join(grouped, "fp").select("tag", "component").distinct()


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
