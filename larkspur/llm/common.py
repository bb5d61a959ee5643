"""What the operators share: reading tables, tables kept in the shared folder, components of links."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TEXT_ROWS = 1000
#: A word: a run without the space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="larkspur-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a
    local master; on a cluster executors wouldn't see it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that ``keep`` wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def early_filters(spark: SparkSession) -> Iterator[None]:
    """In here Spark may drop rows of small tables too before a join moves them, by a Bloom filter of bounded size."""
    conf = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "0")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of fewer rows than usual, as texts may be long.

    The setting is the session's and stays; it changes no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """The words of a text, in order; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def components(links: DataFrame, limit: int = 64) -> DataFrame:
    """Connected components of ``links`` (a, b of one type that can be ordered): rows (node, component), component the smallest node reachable.

    Alternates two groupings: each node hands its larger neighbours, then its smaller ones, to the smallest that it
    knows, until every node hangs on the least node of its component; links that are so already take no round. Each
    round groups with a map-side minimum and joins on the node, so that a node with very many links is split by the
    adaptive skew join; rounds grow with the logarithm of the longest chain. Only nodes that have a link come back.
    What comes back is a kept table; tables of earlier rounds are removed.

    A round is two queries, as each stage of one costs the driver memory: the first grouping of a round also counts
    the nodes that do not hang well yet, and its rows are the result if there are none.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    now = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "links", path)
    for _ in range(limit):
        ends = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
        nodes = ends.groupBy(F.col("x.a").alias("node")).agg(F.min("x.b").alias("low"), F.max("x.b").alias("high"))
        seen = Observation()  # a node that has a smaller neighbour and another one is no star's end
        nodes = nodes.observe(seen, F.count_if(F.expr("low < node AND low <> high")).alias("loose"))
        at = new_path(spark, "nodes")
        nodes = keep(nodes.select("node", F.least("node", "low").alias("component")), "nodes", at)
        if not seen.get["loose"]:
            return nodes
        large = now.join(nodes, now.b == nodes.node).select("a", F.col("component").alias("b"))
        large = large.union(nodes.where("node <> component")).distinct()
        # each node to the smallest of its smaller neighbours, and these to it as well
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, path = path, new_path(spark, "links")
        now = keep(small.union(least), "links", path)
        discard(spark, old)
        discard(spark, at)
    raise RuntimeError("components did not settle")
