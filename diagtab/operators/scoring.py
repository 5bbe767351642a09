"""Score roll-ups: buckets, summaries, failures, stability, leaderboards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import BUCKET_LABELS, BUCKET_UPPER_BOUNDS, SCORE_ELEMENTS
from ..functions.text import as_column, excerpt, strip
from .compare import pair_prf
from .markup import KEYS, explode_lines, no_block_error, parse_warnings
from .ranking import join_null_safe, quantile_columns, value_positions

N_BUCKETS = len(BUCKET_LABELS)


def bucketise(score: Column | str) -> Column:
    """Bucket number 0..9 by the literal bounds; null for null, above range the last."""
    score = as_column(score)
    found = F.when(score.isNull(), F.lit(None).cast("int"))
    for i, upper in enumerate(BUCKET_UPPER_BOUNDS):
        found = found.when(score < F.lit(upper), F.lit(i))
    return found.otherwise(F.lit(N_BUCKETS - 1))


def bucket_label(score: Column | str) -> Column:
    labels = F.array(*[F.lit(x) for x in BUCKET_LABELS])
    return F.try_element_at(labels, bucketise(score) + 1)


def long_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.unpivot(list(by), list(SCORE_ELEMENTS), "element", "score")


def summarise(scores: DataFrame, by: Sequence[str] = ("candidate", "dataset")) -> DataFrame:
    """by, element, n, mean, std, median, mad, buckets, failed.

    std is the population deviation, mad the mean absolute deviation from the
    mean; a group without scores keeps its row with null statistics. Every
    statistic comes from per-value counts, so a hot group is spread by value.
    """
    by = list(by)
    keys = [*by, "element"]
    positions = value_positions(long_scores(scores, by), keys, "score")
    weighted = F.sum(F.col("n") * F.col("score")) / F.sum("n")
    counts = [
        F.coalesce(F.sum(F.when(bucketise("score") == i, F.col("n"))), F.lit(0)) for i in range(N_BUCKETS)
    ]
    first = positions.groupBy(*keys).agg(
        F.sum("n").alias("n_scores"), weighted.alias("mean"), F.array(*counts).alias("buckets"),
        *quantile_columns("score", {"median": 0.5}),
    )
    away = join_null_safe(positions, first.select(*keys, "mean"), keys)
    off = F.col("score") - F.col("mean")
    second = away.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("std"),
        (F.sum(F.col("n") * F.abs(off)) / F.sum("n")).alias("mad"),
    )
    failed = scores.groupBy(*by).agg(F.count_if(F.col("error").isNotNull()).alias("failed"))
    base = failed.withColumn("element", F.explode(F.array(*[F.lit(e) for e in SCORE_ELEMENTS])))
    joined = join_null_safe(join_null_safe(base, first, keys, "left"), second, keys, "left")
    none = F.array(*[F.lit(0).cast("long")] * N_BUCKETS)
    return joined.select(
        *keys, F.coalesce("n_scores", F.lit(0)).alias("n"), "mean", "std", "median", "mad",
        F.coalesce("buckets", none).alias("buckets"), "failed",
    )


def bucket_table(scores: DataFrame, by: Sequence[str] = ("dataset", "candidate")) -> DataFrame:
    """One row per group and element: n, n_failed, ten bucket counts named by their labels, mean, median."""
    summary = summarise(scores, by)
    columns = [F.element_at("buckets", i + 1).alias(label) for i, label in enumerate(BUCKET_LABELS)]
    return summary.select(*by, "element", "n", F.col("failed").alias("n_failed"), *columns, "mean", "median")


def error_table(scores: DataFrame) -> DataFrame:
    """candidate, dataset, id, error, raw_excerpt (200 characters) of the failed rows."""
    raw = F.col("raw_excerpt") if "raw_excerpt" in scores.columns else F.lit(None).cast("string")
    return scores.filter(F.col("error").isNotNull()).select(
        "candidate", "dataset", "id", "error", excerpt(raw, 200).alias("raw_excerpt")
    )


def error_kind(error: Column | str) -> Column:
    error = as_column(error)
    return (
        F.when(error.startswith("exception:"), "exception")
        .when(error.startswith("plantuml_validator:"), "plantuml_validator")
        .when(error.endswith("_no_plantuml"), "no_plantuml")
        .when(error.endswith("_no_classes"), "no_classes")
        .when(error.isNotNull(), "other")
    )


def error_taxonomy(scores: DataFrame, by: Sequence[str] = ("candidate", "dataset")) -> DataFrame:
    kinds = scores.filter(F.col("error").isNotNull()).withColumn("kind", error_kind("error"))
    return kinds.groupBy(*by, "kind").agg(F.count("*").alias("n"))


def failure_rate(scores: DataFrame, by: Sequence[str] = ("dataset", "candidate")) -> DataFrame:
    """by, n, n_errors, failure_pct: one pass, groups without errors keep 0."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count("error").alias("n_errors"),
        (100 * F.count("error") / F.count("*")).alias("failure_pct"),
    )


def run_totals(generated: DataFrame, by: Sequence[str] = ("candidate", "dataset", "run_index")) -> DataFrame:
    """by, n_records, n_failed_generate, n_failed_score, elapsed_seconds."""
    return generated.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        F.count_if("failed").alias("n_failed_generate"),
        F.count_if(F.col("error").isNotNull() & ~F.col("failed")).alias("n_failed_score"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
    )


def build_run_records(scored: DataFrame) -> DataFrame:
    """Per-record rows of a run: scores nested, bucket label per element, missing id as ''."""
    return scored.withColumns(
        {
            "id": F.coalesce(F.col("id").cast("string"), F.lit("")),
            "scores": F.struct(*SCORE_ELEMENTS, "error"),
            "buckets": F.struct(*[bucket_label(e).alias(e) for e in SCORE_ELEMENTS]),
        }
    )


def per_run_table(scores: DataFrame) -> DataFrame:
    """dataset, candidate, model, run_index, element: n, failed, median, std, mean."""
    by = ["dataset", "candidate", "model", "run_index"]
    return summarise(scores, by).select(*by, "element", "n", "failed", "median", "std", "mean")


def run_means(scores: DataFrame) -> DataFrame:
    """Mean score per candidate, model, dataset, run and element from one aggregation."""
    by = ["candidate", "model", "dataset", "run_index"]
    wide = scores.groupBy(*by).agg(*[F.avg(e).alias(e) for e in SCORE_ELEMENTS])
    return wide.unpivot(by, list(SCORE_ELEMENTS), "element", "run_mean")


def run_stability(scores: DataFrame) -> DataFrame:
    """candidate, model, dataset, element: n_runs, median and sample deviation of the run means.

    A group holds one value per run, so ``median`` is small here.
    """
    return run_means(scores).groupBy("candidate", "model", "dataset", "element").agg(
        F.count("run_mean").alias("n_runs"),
        F.median("run_mean").alias("median"),
        F.stddev_samp("run_mean").alias("std"),
    )


def candidate_means(scores: DataFrame) -> DataFrame:
    wide = scores.groupBy("dataset", "candidate").agg(*[F.avg(e).alias(e) for e in SCORE_ELEMENTS])
    return wide.unpivot(["dataset", "candidate"], list(SCORE_ELEMENTS), "element", "mean")


def baseline_gap(scores: DataFrame, baseline: str) -> DataFrame:
    """dataset, element, candidate, mean, baseline_mean, gap."""
    own = F.when(F.col("candidate") == baseline, F.col("mean"))
    w = Window.partitionBy("dataset", "element")
    means = candidate_means(scores).withColumn("baseline_mean", F.max(own).over(w))
    return means.select("dataset", "element", "candidate", "mean", "baseline_mean",
                        (F.col("mean") - F.col("baseline_mean")).alias("gap"))


def mean_pivot(scores: DataFrame) -> DataFrame:
    return scores.groupBy("candidate").agg(*[F.avg(e).alias(e) for e in SCORE_ELEMENTS])


def leaderboard(scores: DataFrame) -> DataFrame:
    """dataset, element, rank, candidate, mean: best first."""
    w = Window.partitionBy("dataset", "element").orderBy(F.desc("mean"))
    ranked = candidate_means(scores).withColumn("rank", F.rank().over(w))
    return ranked.orderBy("dataset", "element", F.desc("mean"), "candidate")


# --- generate and score -----------------------------------------------------------

CANDIDATE_OUTPUT = T.StructType(
    [
        T.StructField("generated", T.StringType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("raw_excerpt", T.StringType()),
    ]
)

_CANDIDATES: dict[str, Callable] = {}
_METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_candidate(name: str, candidate: Callable, **settings) -> None:
    """Make a candidate known by name.

    ``candidate`` is a function ``text -> str | dict`` (or a class whose
    instances are), or a function ``Column -> Column`` marked with an attribute
    ``is_expression = True``. Of the settings only those the callable accepts
    and that are not None are passed on.
    """
    import inspect

    given = {k: v for k, v in settings.items() if v is not None}
    target = candidate.__init__ if inspect.isclass(candidate) else candidate
    accepted = {
        p.name for p in inspect.signature(target).parameters.values()
        if p.kind in (inspect.Parameter.POSITIONAL_OR_KEYWORD, inspect.Parameter.KEYWORD_ONLY)
    }
    kept = {k: v for k, v in given.items() if k in accepted}
    if inspect.isclass(candidate):
        _CANDIDATES[name] = candidate(**kept)
    elif kept:
        import functools

        _CANDIDATES[name] = functools.partial(candidate, **kept)
    else:
        _CANDIDATES[name] = candidate


def constant_candidate(text: Column) -> Column:
    """The baseline: the same two-class diagram for every text, without Python per row."""
    return F.lit("@startuml\nclass A\nclass B\nA -- B\n@enduml")


constant_candidate.is_expression = True
register_candidate("constant", constant_candidate)


def generate(records: DataFrame, candidate: str | Callable, excerpt_length: int | None = 2000) -> DataFrame:
    """Run a candidate over every record; an exception becomes a failed row, never a failed task.

    Adds generated, failed, error, raw_excerpt (the first `excerpt_length` characters, all if None), elapsed_seconds.
    """
    fn = _CANDIDATES[candidate] if isinstance(candidate, str) else candidate
    if getattr(fn, "is_expression", False):
        return records.select(
            "*", fn(F.col("nlt")).alias("generated"), F.lit(False).alias("failed"),
            F.lit(None).cast("string").alias("error"), F.lit("").alias("raw_excerpt"),
            F.lit(0.0).alias("elapsed_seconds"),
        )
    schema = T.StructType(
        records.schema.fields + CANDIDATE_OUTPUT.fields + [T.StructField("elapsed_seconds", T.DoubleType())]
    )

    def run(batches):
        import time

        for batch in batches:
            rows = []
            for text in batch["nlt"]:
                started = time.time()
                try:
                    out = fn(text)
                    if not isinstance(out, dict):
                        out = {"generated": out}
                    row = (out.get("generated") or "", bool(out.get("failed", False)), out.get("error"),
                           (out.get("raw_excerpt") or "")[:excerpt_length])
                except Exception as exc:  # noqa: BLE001 - a record may fail, the job may not
                    row = ("", True, f"exception: {type(exc).__name__}: {exc}", "")
                rows.append((*row, round(time.time() - started, 3)))
            names = ["generated", "failed", "error", "raw_excerpt", "elapsed_seconds"]
            for i, name in enumerate(names):
                batch[name] = [r[i] for r in rows]
            yield batch

    return records.mapInPandas(run, schema)


def register_metric(name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
    """A metric takes (dataset, id, reference, generated) and returns dataset, id and the three scores."""
    _METRICS[name] = metric


def element_f1(pairs: DataFrame) -> DataFrame:
    """F1 of the element sets per record for class, attribute and association."""
    prf = pair_prf(pairs)
    wanted = {"classes": "class_score", "attributes": "attribute_score", "relationships": "association_score"}
    return prf.groupBy("dataset", "id").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("f1"))).alias(name) for kind, name in wanted.items()]
    )


register_metric("element_f1", element_f1)


def score_pairs(pairs: DataFrame, metric: str = "element_f1") -> DataFrame:
    """dataset, id, three scores, parse_warning_ref, parse_warning_gen, error.

    A blank generated text scores 0 with ``empty_generated_model``; a text
    without a diagram block scores 0 with its parse error.
    """
    blank = F.coalesce(strip("generated") == "", F.lit(True))
    base = pairs.select("dataset", "id", "reference", "generated", blank.alias("_blank"))
    alive = base.filter(~F.col("_blank"))
    scored = _METRICS[metric](alive)

    def listed(side: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.struct("line_no", "warning"))))
        return F.transform(ordered, lambda w: w["warning"]).alias(f"parse_warning_{side}")

    # both texts through one parse
    tagged = alive.select("dataset", "id", F.inline(F.array(
        F.struct(F.lit("ref").alias("_side"), F.col("reference").alias("puml")),
        F.struct(F.lit("gen").alias("_side"), F.col("generated").alias("puml")))))
    sides = [*KEYS, "_side"]
    warnings = parse_warnings(explode_lines(tagged, keys=sides), keys=sides).groupBy(*KEYS).agg(listed("ref"), listed("gen"))
    errors = [F.when(~F.col("_blank"), no_block_error(c)).alias(name) for c, name in (("reference", "_error_ref"), ("generated", "_error_gen"))]
    joined = base.select("dataset", "id", "_blank", *errors).join(scored, KEYS, "left").join(warnings, KEYS, "left")
    none = F.array().cast("array<string>")
    error = F.when(F.col("_blank"), "empty_generated_model").otherwise(F.coalesce("_error_ref", "_error_gen"))
    return joined.select(
        "dataset", "id",
        *[F.coalesce(e, F.lit(0.0)).alias(e) for e in SCORE_ELEMENTS],
        F.coalesce("parse_warning_ref", none).alias("parse_warning_ref"),
        F.coalesce("parse_warning_gen", none).alias("parse_warning_gen"),
        error.alias("error"),
    )
