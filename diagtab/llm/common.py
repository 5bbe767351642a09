"""Helpers that several operators share: the folder all executors see, written tables, components, ranks, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Temporary folders of this process, where no shared folder is set.
_LOCAL: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _LOCAL.append(tempfile.TemporaryDirectory(prefix="diagtab-"))  # goes when Python ends
    folder = f"file://{_LOCAL[-1].name}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows of `df` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    All tables of an application are in one folder that has its id, to be removed when its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the 0-based place of each row in the total order `order`, without gathering rows in one task.

    Rows are sorted over ranges and written; only one number per range, its row count, goes to the driver.
    """
    spark = df.sparkSession
    local = (1 << 33) - 1  # monotonically_increasing_id: the range above, the place in the range below
    placed = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__at"), 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    rows, before = [], 0
    for number, count in counts:
        rows.append((number, before))
        before += count
    offsets = spark.createDataFrame(rows, "__part long, __before long")
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(local)))
        .drop("__part", "__before", "__at")
    )


def prefix_sum(rows: DataFrame, at: str, size: str, name: str, block: int = 4096) -> DataFrame:
    """Adds the sum of `size` over all rows with a smaller `at`, 0-based and without gaps."""
    rows = rows.withColumn("__block", F.floor(F.col(at) / block).cast("long"))
    sums = written(rows.groupBy("__block").agg(F.sum(size).alias("__size")))
    inside = Window.partitionBy("__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = written(rows.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0))))
    sums = sums.select(F.col("__block").alias("number"), "__size")
    if sums.count() > 1:
        sums = prefix_sum(sums, "number", "__size", "earlier", block)
    else:
        sums = sums.withColumn("earlier", F.lit(0).cast("long"))
    joined = own.join(sums.select(F.col("number").alias("__block"), F.col("earlier").alias("__earlier")), "__block")
    return joined.withColumn(name, F.col("__earlier") + F.col("__inside")).drop("__block", "__earlier", "__inside")


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores in front until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (u long, v long): rows (id, component), component the smallest id reachable.

    Alternating large-star and small-star rounds: each round hangs the larger neighbours of every vertex, then the
    vertex itself, below the smallest vertex it knows. The number of rounds grows with the logarithm of the longest
    path. A vertex with many edges is a skewed join key, which adaptive execution splits: its minimum is written
    first, so both sides of the join come from plain exchanges. Null or equal ends are no edges. Empty in, empty out.
    """
    u, v = F.col("u"), F.col("v")
    pairs = written(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
        .distinct()
    )

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, now = None, state(pairs)
    while before != now and now[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where(u != v).distinct()
        pairs = written(small)
        before, now = now, state(pairs)
    ids = pairs.select(u.alias("id"), v.alias("component"))
    return written(ids.union(pairs.select(v.alias("id"), v.alias("component"))).groupBy("id").agg(F.min("component").alias("component")))
