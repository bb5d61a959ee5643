"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slot i of the schedule has the golden-ratio point i * STEP mod CELLS * CELL, which falls into one source's share of the
cumulative weights; the k-th slot of a source draws the k-th of its blocks. Blocks hold SLOT_WORDS words, in all
sources alike: a source's documents lie in shuffled order on a line of words that runs through twice, and a block is a
piece of that line. There are as many slots as blocks; only a source's last block is trimmed, to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all words, as a fraction
EPOCHS = 2
SLOT_WORDS = 4096
#: The points are the integers below 2^31, which i -> i * STEP permutes; STEP / 2^31 is the golden ratio's fraction.
POINTS, STEP = 1 << 31, 1327217885
CELLS = 4096  # of the points, to find a point's source
DEALT = 4096  # pieces in which a source's documents are shuffled
SLOT_RUN = 1 << 16  # slots that are ranked together


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("bigint")


def sources(docs: DataFrame) -> DataFrame:
    """A row for each source of ``docs`` (mix_key, size): source_size, target, goal (whole words), low, high (its points).

    Sources rank by code point, null last. Targets fill up by the weights: a source whose double size is the smaller
    share stops there, the rest is shared again. One row a source; only these pass through one window.
    """
    found = docs.groupBy("mix_key").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(every.orderBy("mix_key")) - 1) % len(WEIGHTS) + 1)
    ranked = found.withColumn("weight", weight.cast("bigint")).withColumn("cap", EPOCHS * F.col("source_size")).withColumn("all_words", F.sum("source_size").over(every))
    order = every.orderBy(F.col("cap") / F.col("weight"), "mix_key")
    ranked = (
        ranked.withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", (SHARE[1] * F.col("cap")).cast("double") * F.col("weight_left") <= F.col("weight").cast("double") * (SHARE[0] * F.col("all_words") - SHARE[1] * F.col("caps_before")))
    )
    # not capped: weight * (words to share - caps of the full ones) / weight of the others
    open_weight, full_caps = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every), F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    shared = (F.col("weight") * (SHARE[0] * F.col("all_words") - SHARE[1] * full_caps)).cast("double") / (SHARE[1] * open_weight).cast("double")
    ranked = ranked.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared)).withColumn("goal", F.floor("target").cast("bigint"))
    line = every.orderBy("mix_key")
    ranked = ranked.withColumn("need", F.ceil(F.col("goal") / SLOT_WORDS).cast("bigint"))
    all_need = F.sum("need").over(every)
    share = F.sum("need").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("double") / F.greatest(all_need, F.lit(1)).cast("double")
    ranked = ranked.withColumn("high", F.floor(share * POINTS).cast("bigint")).withColumn("low", F.coalesce(F.lag("high").over(line), F.lit(0)))
    return ranked.select("mix_key", "source_size", "target", "goal", "need", "low", "high", all_need.alias("all_need"))


def _ranked(slots: DataFrame) -> DataFrame:
    """Adds to ``slots`` (mix_key, run, slot) the rank k among those of the source; ranks are counted run by run."""
    before = Window.partitionBy("mix_key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.groupBy("mix_key", "run").count().select("mix_key", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("mix_key", "run").orderBy("slot")) - 1
    return slots.withColumn("r", rank).join(offsets, ["mix_key", "run"]).select("mix_key", "run", "slot", (F.col("r") + F.col("ahead")).cast("bigint").alias("k"))


def schedule(found: DataFrame) -> DataFrame:
    """The slots (mix_key, k, slot) of ``sources``: the k-th block of a source stands at this slot of the mix.

    The points give a source nearly as many slots as it has blocks; the few that some have too many (their last ones)
    go to those that have too few.
    """
    cells = POINTS // CELLS
    shares = found.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cells), F.floor((F.col("high") - 1) / cells))))
    n_slots = found.agg(F.coalesce(F.max("all_need"), F.lit(0)).alias("n"))
    # runs of slots are made from one row, then dealt out
    runs = n_slots.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SLOT_RUN))).alias("run")).repartition("run")
    slots = runs.select("run", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least((F.col("run") + 1) * SLOT_RUN, F.col("n")) - 1)).alias("slot"))
    slots = slots.withColumn("point", F.col("slot") % POINTS * STEP % POINTS).withColumn("cell", F.floor(F.col("point") / cells))
    drawn = slots.join(shares.select("mix_key", "low", "high", "cell"), "cell").where("point >= low AND point < high").select("mix_key", "run", "slot")
    drawn = common.keep(_ranked(drawn).join(found.select("mix_key", "need"), "mix_key"), "drawn")
    spare = drawn.where("k >= need").select("run", "slot", (F.row_number().over(Window.orderBy("slot")) - 1).alias("j"))
    got = drawn.groupBy("mix_key").agg(F.count("*").alias("got"))
    short = found.join(got, "mix_key", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    lacking = short.select("mix_key", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("k"))
    lacking = lacking.select("mix_key", (F.row_number().over(Window.orderBy("mix_key", "k")) - 1).alias("j"))
    given = spare.join(lacking, "j").select("mix_key", "run", "slot")  # a few for each source: the points' discrepancy
    return _ranked(drawn.where("k < need").select("mix_key", "run", "slot").union(given)).select("mix_key", "k", "slot")


def placed(docs: DataFrame) -> DataFrame:
    """Adds to ``docs`` (doc_id, size, mix_key, tag) the rank ``r`` in its source's shuffle and the words ``a`` before it.

    The shuffle sorts by the MD5 of doc_id. Its first digits deal a source out in pieces; their sums give each
    piece its start, so a source with a third of all documents is no single window. Rows that share doc_id, size and
    tag are interchangeable; each keeps a rank of its own.
    """
    shuffled = docs.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("deal", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % DEALT)
    totals = shuffled.groupBy("mix_key", "deal").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    before = Window.partitionBy("mix_key").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("mix_key", "deal", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_ahead"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("mix_key", "deal").orderBy("h", "doc_id", "size", "tag")
    lined = shuffled.withColumn("r", F.row_number().over(within)).withColumn("a", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lined.join(starts, ["mix_key", "deal"]).withColumn("r", F.col("r") + F.col("ahead")).withColumn("a", F.col("a") + F.col("words_ahead")).drop("h", "deal", "ahead", "words_ahead")


def source_key(source: Column) -> Column:
    """One key for a source, which sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def draws(docs: DataFrame) -> DataFrame:
    """The mix of ``docs`` (doc_id, size, source, tag): a row for each stretch of a document that a slot draws.

    Columns: mix_key, r, doc_id, size, tag, source_size, target, slot (null where nothing of the document is drawn), epoch,
    first, after: the words [first, after) of the document. A block may end within a document. A document without
    words is never drawn.
    """
    docs = common.keep(docs.select("doc_id", "size", "tag", source_key(F.col("source")).alias("mix_key")), "sizes")  # the texts are read once
    found = common.keep(sources(docs), "sources")
    slots = common.keep(schedule(found), "schedule")
    lined = placed(docs).join(found.select("mix_key", "source_size", "target", "goal"), "mix_key")
    # [at, end) is the document on the line of words in one epoch, as far as the target reaches
    lined = lined.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    lined = lined.withColumn("at", F.col("a") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("goal")))
    lined = lined.where("epoch = 0 OR at < end")
    block = lambda word: F.floor(word / SLOT_WORDS).cast("bigint")
    lined = lined.withColumn("k", F.explode_outer(F.when(F.col("at") < F.col("end"), F.sequence(block(F.col("at")), block(F.col("end") - 1)))))
    pieces = lined.withColumn("first", F.greatest("at", F.col("k") * SLOT_WORDS) - F.col("at")).withColumn("after", F.least("end", (F.col("k") + 1) * SLOT_WORDS) - F.col("at"))
    return pieces.join(slots, ["mix_key", "k"], "left").select("mix_key", "r", "doc_id", "size", "tag", "source_size", "target", "slot", "epoch", "first", "after")


def taken(docs: DataFrame) -> DataFrame:
    """A row for each document: mix_key, r, doc_id, size, source_size, target, the words that the mix takes, the first
    slot that draws the document (null: none) and how many draws there are."""
    words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("after") - F.col("first"))), F.lit(0)).cast("bigint")
    found = draws(docs).groupBy("mix_key", "r", "doc_id", "size", "source_size", "target")
    return found.agg(words.alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Mixes the rows of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, first_slot, n_slots.

    A null text has size 0; a null source is a source of its own, last. Rows with equal doc_id count as documents
    of their own. Other columns are not used. An empty table gives no rows; where no text has words, targets are 0.
    """
    sized = docs.select("doc_id", size(F.col("text")).alias("size"), "source", F.lit(0).alias("tag"))
    return taken(sized).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(common.load(spark, sf_dir, "documents"))


#: The same schedule and draws; documents of one source with equal MD5s don't occur.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY k),
c AS (
  SELECT *, sum(source_size) OVER () AS total, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY 2 * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
  FROM s),
f AS (SELECT *, 2 * cap * wl <= w * (3 * total - 2 * caps) AS full_ FROM c),
t AS (
  SELECT k, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE
    (w * (3 * total - 2 * coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)))::DOUBLE / (2 * sum(CASE WHEN NOT full_ THEN w END) OVER ())::DOUBLE END AS target
  FROM f),
g AS (SELECT *, floor(target)::BIGINT AS goal, (floor(target)::BIGINT + 4095) // 4096 AS need FROM t),
h AS (SELECT *, floor((sum(need) OVER (ORDER BY k))::DOUBLE / greatest(sum(need) OVER (), 1)::DOUBLE * 2147483648)::BIGINT AS high FROM g),
q AS (SELECT *, coalesce(lag(high) OVER (ORDER BY k), 0) AS low FROM h),
i AS (SELECT unnest(range(0, (SELECT coalesce(sum(need), 0)::BIGINT FROM g))) AS slot),
p AS (SELECT k, need, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS b
      FROM i JOIN q ON (slot::HUGEINT * 1327217885 % 2147483648)::BIGINT >= low AND (slot::HUGEINT * 1327217885 % 2147483648)::BIGINT < high),
spare AS (SELECT slot, row_number() OVER (ORDER BY slot) AS j FROM p WHERE b >= need),
got AS (SELECT k, count(*) AS n FROM p GROUP BY k),
lack AS (SELECT k, row_number() OVER (ORDER BY k, b) AS j FROM (SELECT k, unnest(range(coalesce(n, 0), need)) AS b FROM g LEFT JOIN got USING (k))),
plan AS (SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS b
         FROM (SELECT k, slot FROM p WHERE b < need UNION ALL SELECT k, slot FROM lack JOIN spare USING (j))),
l AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY k ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d),
e AS (SELECT doc_id, size, source_size, target, k, a + epoch * source_size AS first, least(a + epoch * source_size + size, goal) AS after
      FROM l JOIN g USING (k), (VALUES (0), (1)) AS r(epoch)),
m AS (SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, any_value(k) AS k,
             sum(greatest(0, after - first))::BIGINT AS taken, min(first // 4096) FILTER (WHERE first < after) AS b,
             coalesce(sum((after - 1) // 4096 - first // 4096 + 1) FILTER (WHERE first < after), 0)::BIGINT AS n_slots
      FROM e GROUP BY doc_id)
SELECT doc_id, size, source_size, target, taken, slot AS first_slot, n_slots FROM m LEFT JOIN plan USING (k, b)
"""
