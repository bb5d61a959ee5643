"""Documents whose shingles are alike by 0.8 or more (Jaccard), exactly: SimHash classes first, then a prefix join.

SimHash groups whose members are alike are classes; what follows only looks at what two classes share. Two sets that
are so alike share one of their first shingles in any common order, if of n as many are taken as may be missing, and
one. The order puts shingles that many documents hold last. Documents that share such a key are first compared with
the most central of them, which has the fewest rare shingles before the key; those that this leaves in different
components are then compared pair by pair. Pairs whose first shingles show that too few are shared drop out; all links
are verified on the whole sets, which are made anew from the texts of the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common, simhash

SHINGLE = 5
PART, WHOLE = 4, 5  # a similarity of 4/5
SAMPLE_DOCS, SAMPLE_HOLDERS = 50_000, 10  # a shingle that more of the sample hold comes last in the order


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; those of fewer words are one shingle, no words are none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    joined, ends = b" ".join(words), list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])], np.uint64).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(x) for x in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), held], ["tag", "held"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sets(batches):
        yield pa.RecordBatch.from_arrays([batch.column(1).values], ["key"])


def _prefixes(texts: DataFrame, usual: np.ndarray) -> DataFrame:
    """(key, tag, n, left): the first shingles of each text (tag, text), and how many stand from there to its end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(batches):
            tags, held = batch.column(0).to_numpy(), batch.column(1)
            offsets, values = held.offsets.to_numpy(), held.values.to_numpy()
            keys, n, left = [], [], []
            for a, b in zip(offsets, offsets[1:]):
                x, size = values[a:b], b - a
                if len(usual):
                    late = usual[np.minimum(np.searchsorted(usual, x), len(usual) - 1)] == x
                    x = np.concatenate([x[~late], x[late]])
                keys.append(x[: size - _rest(size)] if size else np.zeros(1, np.int64))
                n.append(size)
                left.append(size - np.arange(len(keys[-1])))
            many = [len(x) for x in keys]
            columns = np.concatenate(keys or [np.zeros(0, np.int64)]), np.repeat(tags, many), np.repeat(np.array(n, np.int32), many), np.concatenate(left or [np.zeros(0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "tag", "n", "left"])

    return common.map_texts(texts, cut, "key bigint, tag bigint, n int, left int")


def _rest(size):
    """How many shingles of a set stand after its first ones."""
    return -(-PART * size // WHOLE) - 1


def _promising(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets may be alike by their keys in ``rows`` (key, tag, n), which hold all that both share.

    Of the set whose first shingles end first in the common order, the other has those among its own first ones.
    """
    pairs = common.keep(pairs.distinct(), "candidates")
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "tag")
    firsts = rows.join(wanted, "tag", "left_semi").groupBy("tag").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys"))
    firsts = common.keep(firsts, "firsts")  # of one document
    side = lambda end, n, keys: firsts.select(F.col("tag").alias(end), F.col("n").cast("bigint").alias(n), F.col("keys").alias(keys))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    most = F.greatest("n", "m")
    rest = F.floor((PART * most + WHOLE - 1) / WHOLE) - 1  # as in _rest
    return both.where((PART + WHOLE) * (F.size(F.array_intersect("x", "y")) + rest) >= PART * (F.col("n") + F.col("m"))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of tags whose sets are alike, of distinct candidates. ``texts``: (tag, text)."""
    pairs = common.keep(pairs, "pairs")
    wanted = common.keep(pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("tag")).count(), "wanted")
    with common.early_filters(texts.sparkSession):
        found = texts.join(wanted.where("count > 0").select("tag"), "tag").select("tag", "text")
        sets = common.map_texts(found, _sets, "tag bigint, held array<bigint>").groupBy("tag").agg(F.first("held").alias("held"))
        sets = common.keep(sets, "held")
    both = pairs.join(sets.select(F.col("tag").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("tag").alias("b"), F.col("held").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((PART + WHOLE) * shared >= PART * (F.size("x") + F.size("y"))).select("a", "b")


def _classes(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of texts that SimHash groups with another, if they are alike."""
    marks = common.keep(simhash.groups_of_texts(docs, shingle=SHINGLE), "marks")
    heads = marks.groupBy("component").agg(F.min("tag").alias("a"), F.max("tag").alias("high")).where("a <> high")
    pairs = marks.join(heads, "component").where("a <> tag").select("a", F.col("tag").alias("b"))
    # links to the least text of a group: those that stay are stars, which are components as they are
    ends = F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("component")), F.struct(F.col("a").alias("node"), F.col("a").alias("component"))))
    return common.keep(_verified(pairs, texts).select(ends.alias("x")).select("x.*").distinct(), "classes")


def _usual(texts: DataFrame) -> np.ndarray:
    """The shingles that come last in the order, sorted: those of many documents of a bounded sample."""
    step = max(1, texts.count() // SAMPLE_DOCS)
    sample = common.map_texts(texts.where(F.pmod(F.xxhash64("tag"), F.lit(step)) == 0), _keys, "key bigint")
    return np.sort(sample.groupBy("key").count().where(F.col("count") > SAMPLE_HOLDERS).select("key").toArrow()["key"].to_numpy())


def _between(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, tag, n, left) of keys that two classes share, once each, with class and pivot, the most central row of the key."""
    counted = common.keep(rows.groupBy("key").count().where("count > 1"), "keys")
    with common.early_filters(rows.sparkSession):
        rows = rows.join(counted.where("count > 1").select("key"), "key").distinct()
        rows = rows.join(classes.select(F.col("node").alias("tag"), F.col("component").alias("class")), "tag", "left")
        rows = common.keep(rows.withColumn("class", F.coalesce("class", "tag")), "repeated-rows")
    central = F.min(F.struct((F.col("n") - F.col("left")).alias("rare"), "tag", "n", "left", "class")).alias("pivot")
    shared = rows.groupBy("key").agg(central, F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", "pivot")
    shared = common.keep(shared, "shared-keys")  # so that the join can split hot keys
    return common.keep(rows.join(shared, "key"), "shared-rows")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, component) for each row of ``docs`` (doc_id, text); tag is a hash of the text, component names
    the group that chains of similarity connect. Texts without words are alike. An empty table gives no rows."""
    texts = docs.select(F.xxhash64("text").alias("tag"), "text")
    classes = _classes(docs, texts)
    rows = common.keep(_prefixes(texts, _usual(texts)), "prefixes")
    rows = _between(rows, classes)
    fits = lambda n, left, m, right: (WHOLE * F.least(n, m) >= PART * F.greatest(n, m)) & ((PART + WHOLE) * F.least(left, right) >= PART * (n + m))
    first = rows.where("class <> pivot.class").where(fits(F.col("n"), F.col("left"), F.col("pivot.n"), F.col("pivot.left"))).select(F.col("pivot.tag").alias("a"), F.col("tag").alias("b"))
    known = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = known.union(_verified(_promising(first, rows), texts))

    # what is still apart, pair by pair: in each group of a key, all but the largest component with the rest
    parts = common.components(links)
    rows = rows.drop("pivot", "class").join(parts.withColumnRenamed("node", "tag"), "tag", "left").withColumn("component", F.coalesce("component", "tag"))
    rows = common.keep(rows, "parted-rows")
    main = rows.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("of")).where("of > 1")
    main = common.keep(main.select("key", "main"), "main")
    few = rows.join(main, "key").where("component <> main").alias("x")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("x.main")) | (F.col("x.tag") < F.col("y.tag")))
    second = few.join(rows.join(main.select("key"), "key", "left_semi").alias("y"), "key").where(apart & fits(F.col("x.n"), F.col("x.left"), F.col("y.n"), F.col("y.left")))
    second = second.select(F.least("x.tag", "y.tag").alias("a"), F.greatest("x.tag", "y.tag").alias("b"))
    more = _verified(_promising(second, rows), texts)
    known = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))  # in place of the first links
    parts = common.components(known.union(more))
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"))
    return marked.join(parts, marked.tag == parts.node, "left").select("doc_id", "tag", F.coalesce("component", "tag").alias("component"))
