"""Shared steps of the training-data operators: frozen tables, dense ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local master may fall back to a temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ledgerweave-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/ledgerweave-{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Range-sort df and freeze it with ``pid`` (its range) and ``at`` (row number in the range, from 0)."""
    spread = df.repartitionByRange(partitions_of(df.sparkSession), *order).sortWithinPartitions(*order)
    numbered = spread.withColumn("__m", F.monotonically_increasing_id())
    return freeze(
        numbered.withColumn("pid", F.shiftright("__m", 33).cast("int"))
        .withColumn("at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__m"),
        name,
    )


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", label: str = "rank") -> DataFrame:
    """0-based rank of every row in ``order`` without a one-task window.

    The driver sees one count for each range partition, never rows.
    """
    placed = with_place(df, order, label)
    counts = placed.groupBy("pid").agg(F.count("*").alias("n"))
    ahead = counts.select(
        "pid", (F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead")
    )
    # one row for each range partition: a proven bound for the broadcast
    return placed.join(F.broadcast(ahead), "pid").withColumn(name, F.col("ahead") + F.col("at")).drop("pid", "at", "ahead")


def lane_join(rows: DataFrame, table: DataFrame, key: str, by: Column, lanes: int = 64, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table(key, ...)``, one row for each key, where one key may hold most of ``rows``.

    Every key is split into lanes by a hash of ``by``. Only the lanes a key really has are laid out, from at most
    ``lanes`` light rows of it, so a rare key costs one row more and a hot one is spread over ``lanes`` tasks.
    """
    dealt = rows.withColumn("__lane", F.pmod(F.xxhash64(by), F.lit(lanes)))
    met = dealt.where(F.col(key).isNotNull()).select(key, "__lane").distinct()
    return dealt.join(met.join(table.hint("merge"), key).hint("merge"), [key, "__lane"], how).drop("__lane")


def connected_components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges(a, b)``, both long.

    Each round every node takes one neighbour (or itself) as its representative and edges are rewritten to
    representatives. Round 0 takes the smallest id, which folds stars at once; later rounds use a fresh hash
    order, so that long chains also shrink by a constant factor. All work is joins and partial aggregates; the edges of
    a hub are two longs each, and Spark's adaptive skew join splits them.
    """
    level = freeze(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not level.isEmpty():
        k = len(maps)

        def key(c: str, k: int = k) -> Column:
            return F.col(c) if k == 0 else F.xxhash64(F.lit(seed + k), F.col(c))

        both = level.select("a", "b").unionAll(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.select("a", "b", key("b").alias("h")).groupBy("a").agg(F.min_by("b", "h").alias("rep"), F.min("h").alias("h"))
        rep = freeze(best.select(F.col("a").alias("node"), F.when(F.col("h") < key("a"), F.col("rep")).otherwise(F.col("a")).alias("rep")), "reps")
        maps.append(rep)
        ra = rep.select(F.col("node").alias("a"), F.col("rep").alias("ra")).hint("merge")
        rb = rep.select(F.col("node").alias("b"), F.col("rep").alias("rb")).hint("merge")
        level = freeze(
            level.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if not maps:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("rep").alias("root"))
    for rep in maps[1:]:
        step = rep.select(F.col("node").alias("root"), F.col("rep").alias("up")).hint("merge")
        out = out.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = freeze(out, "roots")
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return freeze(lane_join(out, least, "root", F.col("node")).select("node", "component"), "components")
