"""Removal of boilerplate lines by the number of distinct sites that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diagtab.functions.text import let
from diagtab.llm.common import free_name, written

#: Least number of distinct sites that make a line boilerplate.
MIN_SITES = 10
#: Buckets of a sketch as a power of two; the relative error is about 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 11
#: Estimates within this share of the threshold are counted exactly; over ten standard errors of the sketch.
NEAR = 0.25


def line_key(line: Column) -> Column:
    """What makes two lines equal: the text without ASCII white space at its ends; null for a blank line."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.sha2(bare, 256).substr(1, 32))


def site_key(site: Column) -> Column:
    """A null site is a site of its own."""
    return F.when(site.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), site))


def without(lines: Column, gone: Column) -> Column:
    """The lines whose places are not in the sorted `gone`, joined again: the stretches between, each copied once."""
    def kept(v: Column) -> Column:
        ends = F.concat(v.gone, F.array(F.size(v.lines)))
        starts = F.concat(F.array(F.lit(0)), F.transform(v.gone, lambda i: i + 1))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(v.lines, a + 1, b - a))), "\n")

    return let(F.struct(lines.alias("lines"), gone.alias("gone")), kept)


def spread_lines(occurrences: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least `min_sites` sites, from (line, site, id, at): rows (line, first_id, first_at).

    One sketch per line and task, merged by the aggregation; only lines whose estimate is near the threshold are
    counted exactly, from their distinct (line, site) pairs.
    """
    sketches = written(
        occurrences.groupBy("line").agg(
            F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.min(F.struct("id", "at")).alias("first"),
        ).select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR))
    )
    far = sketches.where(F.col("sites") > min_sites * (1 + NEAR)).select("line", "first")
    near = sketches.where(F.col("sites") <= min_sites * (1 + NEAR))
    sites = written(occurrences.select("line", "site").join(near.select("line"), "line", "left_semi").distinct())
    exact = sites.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return far.union(near.join(exact, "line").select("line", "first")).select(
        "line", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"))


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                      site_col: str = "source") -> DataFrame:
    """`docs` with boilerplate lines removed from the text, and (n_lines, n_removed long) added.

    A line on `min_sites` sites or more stays only where it stands first (least id, then place), so a text that is
    copied whole between sites is not lost. Lines are what `\\n` separates, compared without white space at their ends;
    blank lines are never removed. Null texts stay null with 0 lines, a null site is a site, rows with a null id are
    compared and cleaned like others but are never the first if another row is. Rows that repeat an id with the same
    text count as one document. Input columns of the added names are replaced.
    """
    row_key = (F.col(id_col), F.xxhash64(F.col(text_col)))
    lines = F.split(F.col(text_col), "\n", -1)
    each = docs.select(
        row_key[0].alias("id"), row_key[1].alias("row"), site_key(F.col(site_col)).alias("site"),
        F.posexplode(F.transform(lines, line_key)).alias("at", "line"),
    ).where(F.col("line").isNotNull())
    each = written(each)
    order = each.withColumn("id", F.coalesce(F.col("id"), F.lit((1 << 63) - 1)))
    spread = written(spread_lines(order, min_sites))
    hits = written(
        order.join(spread, "line")
        .where((F.col("id") != F.col("first_id")) | (F.col("at") != F.col("first_at")))
        .select("id", "row", "at").distinct()
    ).groupBy("id", "row").agg(F.sort_array(F.collect_set("at")).alias("__gone"))
    id_name, row_name, gone_name = (free_name(docs.columns, n) for n in ("__id", "__row", "__gone"))
    gone = F.coalesce(F.col(gone_name), F.array().cast("array<int>"))
    named = docs.drop("n_lines", "n_removed").withColumns({
        id_name: F.coalesce(row_key[0], F.lit((1 << 63) - 1)), row_name: row_key[1]})
    hits = hits.select(F.col("id").alias(id_name), F.col("row").alias(row_name), F.col("__gone").alias(gone_name))
    cleaned = named.join(hits, [id_name, row_name], "left")
    return cleaned.withColumns({
        text_col: F.when(F.col(gone_name).isNull(), F.col(text_col)).otherwise(without(lines, gone)),
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.size(gone).cast("long"),
    }).select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
