"""Corpus reports: group-by tables over the per-record, per-element and per-sentence results."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import RELATIONSHIP_KINDS
from ..functions.text import excerpt
from ..operators import textprofile, treepath
from ..operators.ranking import exact_quantiles, join_null_safe, value_positions

KEYS = ["dataset", "id"]

# The columns of the correlation report.
CORRELATED = (
    "n_words", "n_sentences", "n_classes", "n_attributes", "n_relationships",
    "cov_classes_absent", "cov_attrs_absent", "pct_attrs_bound", "pct_rels_bound",
)


def dataset_overview(wide: DataFrame) -> DataFrame:
    """Sizes per dataset: words, sentences, type-token ratio, classes, attributes, enums, relationships.

    Medians run on counts per record, a small set of whole numbers.
    """
    present = set(wide.columns)
    aggs: list[Column] = [F.count("*").alias("n_records")]

    def add(col: str, *stats: str) -> None:
        if col not in present:
            return
        short = col.removeprefix("n_")
        table = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
        aggs.extend(table[s](col).alias(f"{short}_{s}") for s in stats)

    add("n_words", "mean", "median", "min", "max")
    add("n_sentences", "mean", "median")
    add("type_token_ratio", "mean")
    add("n_classes", "mean", "median", "min", "max")
    add("n_attributes", "mean")
    add("n_enums", "mean")
    add("n_relationships", "mean", "median")
    if "n_rels_with_card" in present:
        total = F.greatest(F.sum("n_relationships"), F.lit(1))
        aggs.append((100 * F.sum("n_rels_with_card") / total).alias("rels_with_card_pct"))
    return wide.groupBy("dataset").agg(*aggs)


def kind_counts(counts: DataFrame) -> DataFrame:
    """dataset (null is the total), one column per relationship kind."""
    return counts.rollup("dataset").agg(*[F.sum(f"n_rels_{k}").alias(k) for k in RELATIONSHIP_KINDS])


def cardinality_patterns(relationships: DataFrame) -> DataFrame:
    """dataset (``total`` over all), src_card, tgt_card, n, most frequent first; no cardinality shows as ``*``."""
    cards = relationships.select(
        "dataset",
        F.coalesce("source_card", F.lit("*")).alias("src_card"),
        F.coalesce("target_card", F.lit("*")).alias("tgt_card"),
    )
    per_dataset = cards.groupBy("dataset", "src_card", "tgt_card").agg(F.count("*").alias("n"))
    total = per_dataset.groupBy("src_card", "tgt_card").agg(F.sum("n").alias("n")).withColumn("dataset", F.lit("total"))
    return per_dataset.unionByName(total).orderBy("dataset", F.desc("n"), "src_card", "tgt_card")


def attribute_type_counts(attributes: DataFrame) -> DataFrame:
    typed = attributes.groupBy(F.coalesce("type", F.lit("(untyped)")).alias("type")).agg(F.count("*").alias("n"))
    return typed.orderBy(F.desc("n"), "type")


def coverage_by_dataset(wide: DataFrame, rounded: bool = True) -> DataFrame:
    """dataset, measure, mean, median of every ``cov_`` column; all-null ones are left out."""
    columns = [c for c in wide.columns if c.startswith("cov_")]
    long = wide.select("dataset", *[F.col(c).cast("double").alias(c.removeprefix("cov_")) for c in columns]).unpivot(
        ["dataset"], [c.removeprefix("cov_") for c in columns], "measure", "value"
    )
    keys = ["dataset", "measure"]
    means = long.groupBy(*keys).agg(F.avg("value").alias("mean")).filter("mean IS NOT NULL")
    medians = exact_quantiles(long, keys, "value", {"median": 0.5})
    shown = lambda c: F.bround(c, 2) if rounded else F.col(c)
    return join_null_safe(means, medians, keys).select(*keys, shown("mean").alias("mean"), shown("median").alias("median"))


def binding_by_dataset(wide: DataFrame, rounded: bool = True) -> DataFrame:
    columns = ("pct_attrs_bound", "pct_rels_bound", "avg_hop_class_attr", "avg_hop_rel")
    shown = lambda c: F.bround(F.avg(c), 3) if rounded else F.avg(c)
    return wide.groupBy("dataset").agg(*[shown(c).alias(c) for c in columns])


def kind_coverage_by_dataset(coverage: DataFrame, rounded: bool = True) -> DataFrame:
    n, bound = F.sum("n"), F.sum("n_bound")
    pct = 100 * bound / F.greatest(n, F.lit(1))
    return coverage.groupBy("dataset", "rel_kind").agg(
        n.alias("n"), bound.alias("n_bound"), (F.bround(pct, 2) if rounded else pct).alias("pct_bound")
    )


def style_by_dataset(style: DataFrame, rounded: bool = True) -> DataFrame:
    columns = ("passive_ratio", "hedge_density", "modal_density", "entity_density", "modal_count", "hedge_count", "named_entities")
    shown = lambda c: F.bround(F.avg(c), 4) if rounded else F.avg(c)
    return style.groupBy("dataset").agg(*[shown(c).alias(c) for c in columns])


def sentence_report(stats: DataFrame, rounded: bool = True) -> DataFrame:
    """Sentences per record, sentence length, share of sentences with each kind of hit, per dataset."""
    shown = lambda c: F.bround(c, 2) if rounded else c

    def share(col: str) -> Column:
        return shown(100 * F.avg((F.col(col) > 0).cast("int")))

    per_record = stats.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    per_dataset = per_record.groupBy("dataset").agg(shown(F.avg("_n")).alias("sents_per_record_mean"))
    lengths = stats.groupBy("dataset").agg(
        shown(F.avg("n_words")).alias("sentence_length_words_mean"),
        shown(F.median("n_words")).alias("sentence_length_words_median"),
        share("n_class_hits").alias("pct_sents_with_class_hit"),
        share("n_attr_hits").alias("pct_sents_with_attr_hit"),
        share("n_rel_endpoint_hits").alias("pct_sents_with_rel_endpoint_hit"),
    )
    return per_dataset.join(lengths, "dataset")


def warning_totals(warnings: DataFrame) -> DataFrame:
    """dataset (null is the total), n."""
    return warnings.rollup("dataset").agg(F.count("*").alias("n"))


def warning_top_records(warnings: DataFrame, n: int = 10) -> DataFrame:
    return warnings.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(n)


def warning_samples(warnings: DataFrame, n: int = 5) -> DataFrame:
    return warnings.orderBy("dataset", "id", "line_no").limit(n).select("dataset", "id", "warning")


def jaccard_report(cross: DataFrame, columns: Sequence[str] = ("jaccard_classes", "jaccard_attributes", "jaccard_rels"),
                   rounded: bool = True) -> DataFrame:
    """measure, n, mean, min, max, median, n_perfect."""
    long = cross.unpivot([], list(columns), "measure", "value").filter(F.col("value").isNotNull())
    mean = F.bround(F.avg("value"), 4) if rounded else F.avg("value")
    basic = long.groupBy("measure").agg(
        F.count("*").alias("n"), mean.alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("value") == 1.0).alias("n_perfect"),
    )
    medians = exact_quantiles(long, ["measure"], "value", {"median": 0.5})
    return basic.join(medians, "measure").select("measure", "n", "mean", "min", "max", "median", "n_perfect")


def imperfect_records(cross: DataFrame) -> DataFrame:
    return cross.filter(F.col("jaccard_classes") < 1.0).select("id", "only_in_first_classes", "only_in_second_classes")


def lowest_records(cross: DataFrame, n: int = 5) -> DataFrame:
    """id, jaccard_rels and, where the report has them, the numbers of relationships of the lowest records."""
    sizes = [c for c in ("first_n_rels", "second_n_rels") if c in cross.columns]
    return cross.orderBy("jaccard_rels", "id").limit(n).select("id", "jaccard_rels", *sizes)


def extreme_records(wide: DataFrame, n: int = 5, by: str = "pct_rels_bound") -> DataFrame:
    """end (highest / lowest), dataset, id, the measure and pct_attrs_bound; ties by dataset and id.

    Two top-n selections; each task keeps n rows.
    """
    columns = ["dataset", "id", by, "pct_attrs_bound"] if by != "pct_attrs_bound" else ["dataset", "id", by]
    rows = wide.select(*columns)
    high = rows.orderBy(F.desc(by), "dataset", "id").limit(n).withColumn("end", F.lit("highest"))
    low = rows.orderBy(F.asc(by), F.desc("dataset"), F.desc("id")).limit(n).withColumn("end", F.lit("lowest"))
    return high.unionByName(low)


def spearman_matrix(df: DataFrame, columns: Sequence[str], rounded: bool = True) -> DataFrame:
    """a, b, n, rho for every pair of columns (both orders and the diagonal); rows with a null in the pair are left out.

    Equal value pairs are counted first and carry their count, so ties cost
    nothing; ranks come from spread ranges of the distinct values. A value that
    many rows share is a skewed key of the joins with the ranks, whose inputs are
    plain exchanges, so adaptive execution splits it.
    """
    pairs = list(combinations(columns, 2))
    cell = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs
    ]
    cells = (
        df.select(F.inline(F.array(*cell)))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("a", "b", "x", "y")
        .agg(F.count("*").alias("w"))
    )
    centred = F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
    rank_x = value_positions(cells, ["a", "b"], "x", weight="w").select("a", "b", "x", centred.alias("rx"), "total")
    rank_y = value_positions(cells, ["a", "b"], "y", weight="w").select("a", "b", "y", centred.alias("ry"))
    ranked = cells.join(rank_x, ["a", "b", "x"]).join(rank_y, ["a", "b", "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    spread = F.sqrt(F.sum(w * rx * rx) * F.sum(w * ry * ry))
    rho = F.when(spread > 0, F.sum(w * rx * ry) / spread)
    upper = ranked.groupBy("a", "b").agg(F.max("total").alias("n"), rho.alias("rho"))
    both = upper.select(F.inline(F.array(
        F.struct(F.col("a"), F.col("b"), F.col("n"), F.col("rho")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n"), F.col("rho")),
    )))
    alone = df.agg(*[F.count(c).alias(c) for c in columns], *[(F.min(c) < F.max(c)).alias(f"_v_{c}") for c in columns])
    diagonal = alone.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(c).alias("n"), F.when(F.col(f"_v_{c}"), 1.0).alias("rho"))
        for c in columns
    ])))
    out = both.unionByName(diagonal)
    return out.withColumn("rho", F.bround("rho", 3)) if rounded else out


def histogram_percent(df: DataFrame, col: str) -> DataFrame:
    """dataset, bin (0..9, ten wide over 0..100, the last closed), n; null counts as 0, values outside are left out."""
    value = F.coalesce(F.col(col), F.lit(0))
    bin_ = F.least(F.floor(value / 10), F.lit(9)).cast("int")
    return df.filter(value.between(0, 100)).groupBy("dataset", bin_.alias("bin")).agg(F.count("*").alias("n"))


def histogram_equal(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """dataset, bin, low, n: equal bins from the dataset's minimum to its maximum, the last closed; null counts as 0.

    Values are counted before the range is joined, so a large dataset is spread by value.
    """
    counts = df.groupBy("dataset", F.coalesce(F.col(col), F.lit(0)).cast("double").alias("v")).agg(F.count("*").alias("c"))
    span = counts.groupBy("dataset").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = counts.join(span, "dataset")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return joined.groupBy("dataset", bin_.cast("int").alias("bin"), "lo", "hi").agg(F.sum("c").alias("n")).select(
        "dataset", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), "n"
    )


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, measure, n, mean, std (sample), min, q1, median, q3, max."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, list(columns), "measure", "value")
    long = long.filter(F.col("value").isNotNull())
    keys = [*by, "measure"]
    basic = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return basic.join(quartiles, keys).select(*keys, "n", "mean", "std", "min", "q1", "median", "q3", "max")


def wide_record_table(records: DataFrame, tokens: DataFrame, matched: DataFrame, bound: DataFrame, counts: DataFrame,
                      entities: DataFrame | None = None, chunks: DataFrame | None = None, warnings: DataFrame | None = None,
                      rounded: bool = True) -> DataFrame:
    """One row per record with all features; every part is keyed by (dataset, id).

    ``bound`` comes from ``treepath.record_bindings``. Tokens are aggregated once for both profiles.
    """
    short = {"class": "classes", "attribute": "attrs", "enum_value": "enum", "rel_source": "rel_src", "rel_target": "rel_tgt"}
    levels = ("l1", "l2", "l3", "l4", "absent")

    def coverage(kind: str, name: str) -> list[Column]:
        """Of one kind the number of names and the percentage on each level, zeros where there is none."""
        n = F.count_if(F.col("kind") == kind)
        shares = [100 * F.count_if((F.col("kind") == kind) & F.col(c)) / F.greatest(n, F.lit(1)) for c in levels]
        return [n.alias(f"cov_{name}_n"), *[(F.bround(x, 2) if rounded else x).alias(f"cov_{name}_{c}") for x, c in zip(shares, levels, strict=True)]]

    covered = matched.groupBy(*KEYS).agg(*[c for kind, name in short.items() for c in coverage(kind, name)])
    profile = textprofile.token_profile(tokens, entities, chunks, rounded)
    flat = [F.col(f"{group}.{f.name}").alias(f"{group}_{f.name}") for group in ("tok", "style") for f in profile.schema[group].dataType.fields]
    base = textprofile.text_features(records.select(*KEYS, "nlt"), rounded=rounded)
    for part in (profile.select(*KEYS, *flat), counts, covered, treepath.record_binding_summary(records, bound, rounded)):
        base = base.join(part, KEYS, "left")
    zeros = {f"cov_{name}_{c}": F.coalesce(f"cov_{name}_{c}", F.lit(0 if c == "n" else 0.0)) for name in short.values() for c in ("n", *levels)}
    base = base.withColumns(zeros)
    if warnings is None:
        return base.withColumn("n_parser_warnings", F.lit(0).cast("long"))
    per_record = warnings.groupBy(*KEYS).agg(F.count("*").alias("n_parser_warnings"))
    return base.join(per_record, KEYS, "left").withColumn("n_parser_warnings", F.coalesce("n_parser_warnings", F.lit(0)))


def case_study_rows(records: DataFrame, matched: DataFrame, relationships: DataFrame, bound: DataFrame, n_bindings: int = 8,
                    text_length: int = 1200) -> DataFrame:
    """dataset, id, section, name, detail of the records of a case study.

    All inputs hold the records of the study only: select them first, so that
    nothing is computed for others. Sections: text (its first characters),
    class, relationship, absent_class, absent_attribute, attribute_binding (the
    first ones by name) and relationship_binding (best path). Every input is
    read once and gives all its sections.
    """
    row = "array<struct<section: string, name: string, detail: string>>"
    none = F.lit(None).cast("string")

    def section(title: str, name: Column, detail: Column) -> Column:
        return F.struct(F.lit(title).alias("section"), name.alias("name"), detail.alias("detail"))

    flags = F.to_json(F.struct("l1", "l2", "l3", "l4", "absent"))
    is_class, is_attribute = F.col("kind") == "class", F.col("kind") == "attribute"
    names = F.array_compact(F.array(
        F.when(is_class, section("class", F.col("name"), flags)),
        F.when(is_class & F.col("absent"), section("absent_class", F.col("name"), none)),
        F.when(is_attribute & F.col("absent"), section("absent_attribute", F.concat_ws(".", "owner", "name"), none)),
    ))

    def path(p: Column) -> Column:
        return F.to_json(F.struct(p["sent_i"].alias("sent_i"), p["hop"].alias("hop"), p["path_text"].alias("path_text")))

    by_name = F.array_sort(F.transform(F.filter("found", lambda p: p["sort"] == 0), lambda p: F.struct(
        p["first"].alias("first"), p["second"].alias("second"), p["sent_i"].alias("sent_i"), p["hop"].alias("hop"), p["path_text"].alias("path_text"))))
    bindings = F.concat(
        F.transform(F.slice(by_name, 1, n_bindings), lambda p: section("attribute_binding", F.concat_ws(".", p["first"], p["second"]), path(p))),
        F.transform(F.filter("found", lambda p: p["sort"] == 1), lambda p: section("relationship_binding", F.concat(p["first"], F.lit(" -> "), p["second"]), path(p))),
    )
    link = section("relationship", F.concat(F.col("source"), F.lit(" -> "), F.col("target")), F.col("kind"))
    parts = (
        (records, F.array(section("text", none, excerpt("nlt", text_length)))),
        (matched, names), (relationships, F.array(link)), (bound, bindings),
    )
    rows = [df.select(*KEYS, F.inline(listed.cast(row))) for df, listed in parts]
    out = rows[0]
    for extra in rows[1:]:
        out = out.unionByName(extra)
    return out
