"""Substring dedup: removes words in windows that also start elsewhere, found by an FM-index per shard.

Every window of ``WINDOW`` words has an anchor: its leftmost ``GRAM`` words of least hash. Equal windows have equal
anchors, so only anchors that occur twice matter. The run of windows around such an anchor is its context; distinct
contexts (with their number of copies) are dealt out by anchor into shards. A shard's contexts make an FM-index, and
each is streamed through it for the number of places where its windows start. Windows of an anchor with very many
contexts are summed up by their digest instead, with a map-side sum, so no task holds all of a common passage's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.fmindex import FMIndex

WINDOW, GRAM = 35, 8
SHARD_WORDS = 500_000
HOT_CONTEXTS = 5_000  # distinct contexts of one anchor that go to one shard; with more, windows are counted by digest
BASE = 0x9E3779B97F4A7C15 | 1


IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of an odd number modulo 2^64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 20), base, np.uint64)
        found[0] = 1
        found = _powers[base] = np.multiply.accumulate(found)
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        back = pow(BASE, -1, 1 << 64)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((values + np.uint64(1)) * _power(back, len(values)), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        back = _power(BASE, len(self.sums))
        return mix((self.sums[stop] - self.sums[start]) * back[start] + (stop - start).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of a string or binary column, in order."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, edges = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = edges[(edges > 0) & (edges < len(data))]  # a text's end ends its last word
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Rolling(data.astype(np.uint64)).of(start, stop), np.searchsorted(edges, start, "right") - 1


def anchors(hashes: np.ndarray, text: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, context, text, first, n): for each run of n windows with one anchor, both hashes, and which text and
    which of its words the run starts at."""
    n = len(hashes) - window + 1
    whole = np.flatnonzero(text[:n] == text[window - 1 :]) if n > 0 else np.zeros(0, np.int64)  # windows within one text
    if not len(whole):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    rolling = Rolling(hashes)
    place = np.arange(len(hashes) - gram + 1)
    value = rolling.of(place, place + gram)
    # the leftmost least of each window, by doubling
    width, wide = 1, window - gram + 1
    while width < wide:
        step = min(width, wide - width)
        right = value[step:] < value[: len(value) - step]
        value, place = np.where(right, value[step:], value[: len(value) - step]), np.where(right, place[step:], place[: len(place) - step])
        width += step
    value, place, owner = value[whole], place[whole], text[whole]
    run = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    size, first, place, owner = np.diff(np.r_[run, len(whole)]), whole[run], place[run], owner[run]
    # where in its context an anchor stands tells contexts of equal words apart
    context = mix(rolling.of(first, first + size + window - 1) + (place - first).astype(np.uint64))
    return value[run], context, owner, first - np.searchsorted(text, owner), size


ANCHORS = "anchor bigint, context bigint, k1 bigint, k2 bigint, first int, n int"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            a, c, row, first, n = anchors(*word_hashes(part.column(2)))
            k1, k2 = (part.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "context", "k1", "k2", "first", "n"])


CONTEXTS = "anchor bigint, context bigint, copies bigint, words binary"
SPOTS = "window binary, anchor bigint, context bigint, offset int, copies bigint"


def _slices(batch: pa.RecordBatch, *columns: int, step: int = 256) -> Iterator[tuple]:
    """The rows of some columns as Python values, a few at a time."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(batch.column(c).slice(at, step).to_pylist() for c in columns))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts (text, cuts) of documents."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        for text, cuts in _slices(batch, 0, 1):
            found = expand.decompress(text).split()
            for x in cuts:
                rows.append((x["anchor"], x["context"], x["copies"], b" ".join(found[x["first"] : x["first"] + x["n"] + WINDOW - 1])))
            if len(rows) > 4096:
                yield _batch(rows, CONTEXTS)
                rows = []
        if rows:
            yield _batch(rows, CONTEXTS)


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of each window of the contexts (text, cuts) of hot anchors, and where it stands."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        for text, cuts in _slices(batch, 0, 1):
            found = expand.decompress(text).split()
            for x in cuts:
                for j in range(x["n"]):
                    piece = b" ".join(found[x["first"] + j : x["first"] + j + WINDOW])
                    rows.append((hashlib.blake2b(piece, digest_size=16).digest(), x["anchor"], x["context"], j, x["copies"]))
            if len(rows) > 4096:
                yield _batch(rows, SPOTS)
                rows = []
        if rows:
            yield _batch(rows, SPOTS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows), types)], list(names))


def repeated(found: list[bytes], copies: np.ndarray, window: int = WINDOW) -> list[int]:
    """For each text of a shard, a bit for each of its windows: whether it starts more than once in the shard.

    Words are numbered by their 64-bit hashes; all else is exact.
    """
    hashes, text = word_hashes(pa.array(found, pa.binary()))
    number = np.unique(hashes, return_inverse=True)[1] + 1
    texts = np.split(number, np.searchsorted(text, np.arange(1, len(found))))
    index = FMIndex(texts, copies, window)
    return [int.from_bytes(np.packbits(x > 1, bitorder="little").tobytes(), "little") for x in index.occurrences(texts)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills shards with whole groups of rows, which arrive sorted by anchor, and yields (anchor, context, bits)."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        bits = repeated([r[3] for r in rows], np.array([r[2] for r in rows], np.int64))
        out = [(r[0], r[1], b) for r, b in zip(rows, bits) if b]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], ["anchor", "context", "bits"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in _slices(batch, *range(4)):
            if size >= SHARD_WORDS and row[0] != rows[-1][0]:
                yield settle(rows)
                rows, size = [], 0
            rows.append(row)
            size += row[3].count(b" ") + 2
    if rows:
        yield settle(rows)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, hits) -> the kept words."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for text, hits in _slices(batch, 1, 2):
            found = expand.decompress(text).split()
            gone = np.zeros(len(found) + 1, np.int32)
            for x in hits or ():
                starts = x["first"] + np.flatnonzero(np.frombuffer(np.int64(x["bits"]).tobytes(), np.uint8)[:, None] >> np.arange(8) & 1)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + WINDOW, -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join(found if keep.all() else [w for w, k in zip(found, keep.tolist()) if k])
            rows.append((len(found), len(found) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([press.compress((x or "").encode()) for x in batch.column(2).to_pylist()], pa.binary()), batch.column(3)], ["k1", "k2", "text", "doc_id"])


def _keys() -> list[Column]:
    """Tells rows apart: by doc_id and the text, so that rows with equal doc_id are judged one by one."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2")]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept (the words left).

    Windows are judged on the whole input. A null text has no words. Rows with equal doc_id are documents of their
    own; rows that are equal altogether repeat each other. Texts shorter than a window stay whole. Other columns are
    not used; an empty table gives no rows.
    """
    texts = docs.select(*_keys(), "text", F.col("doc_id").cast("bigint").alias("doc_id"))
    marked = common.map_texts(texts.select("k1", "k2", "text"), _mark, ANCHORS)
    # counted with a map-side sum, and kept, so that the join can split anchors that very many documents share
    twice = common.keep(marked.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "twice")
    found = common.keep(marked.join(twice, "anchor"), "anchors")
    contexts = found.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "first", "n")).alias("at"))
    contexts = common.keep(contexts.select("anchor", "context", "copies", "at.*"), "contexts")
    hot = contexts.groupBy("anchor").agg(F.count("*").alias("of")).where(F.col("of") > HOT_CONTEXTS).select("anchor")
    hot = common.keep(hot, "hot")
    of_document = lambda x: x.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "context", "copies", "first", "n")).alias("cuts"))
    cuts = of_document(contexts.join(hot, "anchor", "left_anti"))
    packed = common.map_texts(texts, _pack, "k1 bigint, k2 bigint, text binary, doc_id bigint")
    # rows that are equal altogether give one and the same context
    pieces = packed.join(cuts, ["k1", "k2"]).select("text", "cuts").mapInArrow(_cut, CONTEXTS)
    bits = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search, "anchor bigint, context bigint, bits bigint")
    if hot.limit(1).count():
        spots = packed.join(of_document(contexts.join(hot, "anchor", "left_semi")), ["k1", "k2"]).select("text", "cuts").mapInArrow(_spots, SPOTS)
        spots = common.keep(spots, "spots")  # so that the join can split windows that very many contexts share
        again = common.keep(spots.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window"), "again")
        bits = bits.union(spots.join(again, "window").select("anchor", "context", F.expr("shiftleft(1L, offset)").alias("bits")))
    bits = common.keep(bits, "windows").groupBy("anchor", "context").agg(F.bit_or("bits").alias("bits"))
    bits = common.keep(bits, "hits")
    hits = found.join(bits, ["anchor", "context"]).select("k1", "k2", "first", "bits").distinct()
    hits = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "bits")).alias("hits"))  # of one document
    return packed.join(hits, ["k1", "k2"], "left").select("doc_id", "text", "hits").mapInArrow(_remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
