"""Token-ID output: ids in ascending document order, as zstd-compressed byte or bit planes with a chunk index.

Layout of a token folder, written and read by Spark so that any store will do:

* ``chunks``: a row for each chunk (part, chunk, doc_ids, lengths, n_ids, planes). A chunk holds whole documents.
  Its ids are cut into blocks of ``BLOCK`` ids (the last one filled up with zeros), each block is transposed into
  four byte planes (or 32 bit planes), equal planes of all blocks are laid end to end and compressed.
* ``index``: a row for each chunk without the planes (part, chunk, first_doc_id, n_docs, n_ids, start), start being
  the number of ids of the same part before the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common, tokens

BLOCK = 4096
CHUNK_IDS = 1 << 18
CHUNK_SCHEMA = "part int, chunk int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, start bigint, planes array<binary>"


def to_planes(ids: bytes, bits: bool = False, level: int = 3) -> list[bytes]:
    """The compressed planes of little-endian unsigned 32-bit ids."""
    import zstandard

    raw = np.frombuffer(ids + bytes(-len(ids) % (4 * BLOCK)), np.uint8).reshape(-1, BLOCK, 4)
    planes = raw.transpose(2, 0, 1)
    if bits:
        planes = np.packbits(np.unpackbits(planes[..., None], axis=-1, bitorder="little").transpose(0, 3, 1, 2).reshape(32, -1, BLOCK), axis=-1)
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(np.ascontiguousarray(x).tobytes()) for x in planes]


def from_planes(planes: list[bytes], n_ids: int) -> bytes:
    """The ids that ``to_planes`` was given; 4 planes are bytes, 32 are bits."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    blocks = -(-n_ids // BLOCK)
    raw = [np.frombuffer(expand.decompress(x), np.uint8) for x in planes]
    if len(raw) == 32:
        bits = np.unpackbits(np.stack(raw).reshape(4, 8, blocks, BLOCK // 8), axis=-1)
        raw = np.packbits(bits.transpose(0, 2, 3, 1), axis=-1, bitorder="little").reshape(4, -1)
    return np.stack(raw).reshape(4, blocks, BLOCK).transpose(1, 2, 0).tobytes()[: 4 * n_ids]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, bits: bool = False) -> None:
    """Encodes the text of ``docs`` (doc_id, text), appends ``end_id`` to each and writes the folder.

    Null and empty texts are just the end id. Documents are dealt by ranges of doc_id and sorted in each (null first,
    equal ids by text), so parts follow each other in doc_id order. Other columns are not used. An empty table gives
    an empty folder. Tasks that run again write the same rows.
    """
    tokenizer = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "chunk": chunk, "doc_ids": ids, "lengths": [len(x) for x in held], "n_ids": size, "start": start, "planes": to_planes(np.concatenate(held).tobytes(), bits)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            found, ends = tokens.encoder(tokenizer).encode(batch.column(1))
            found, ends = np.insert(found, ends, end_id), ends + np.arange(1, len(ends) + 1)
            for doc_id, piece in zip(batch.column(0).to_pylist(), np.split(found, ends[:-1])):
                ids.append(doc_id)
                held.append(piece)
                size += len(piece)
                if size >= CHUNK_IDS:
                    yield flush()
                    chunk, start, ids, held, size = chunk + 1, start + size, [], [], 0
        if ids:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("start", pa.int64()), ("planes", pa.list_(pa.binary()))])
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    spark = docs.sparkSession
    common.map_texts(dealt, encode, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = chunks.select("part", "chunk", F.col("doc_ids")[0].alias("first_doc_id"), F.size("doc_ids").alias("n_docs"), "n_ids", "start")
    index.write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian).

    Only the index is summed up for the starts: one row for each part, so the table that is broadcast is bounded by
    the number of tasks that wrote the folder. Each chunk is decoded by itself.
    """
    index = spark.read.schema("part int, chunk int, first_doc_id bigint, n_docs int, n_ids bigint, start bigint").parquet(f"{path}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").join(F.broadcast(bases), "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = from_planes(row["planes"], row["n_ids"]), row["lengths"]
                ends = np.cumsum(lengths)
                starts = ends - lengths
                parts = [ids[4 * a : 4 * b] for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["at"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    rows = chunks.select("doc_ids", "lengths", "n_ids", (F.col("base") + F.col("start")).alias("at"), "planes")
    return rows.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents to a token folder and digests what is read back from it."""
    path = common.new_path(spark, "token-files")
    write(common.load(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
