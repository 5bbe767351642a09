"""Run plans, job states and prompts as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import JOB_STATES
from .ranking import join_null_safe

JOB_KEY = ["candidate", "model", "dataset", "run_index"]


def expand_matrix(candidates: DataFrame, models: Sequence[str], datasets: Sequence[str] | Column, runs: int,
                  only: Sequence[str] | None = None) -> DataFrame:
    """candidate, model, dataset, run_index: every planned job.

    ``candidates`` holds candidate and uses_model; one that uses no model is
    planned once with a null model. A plan is made of short lists, so it comes
    from exploding arrays and never joins anything.
    """
    picked = candidates.filter(F.col("candidate").isin(*only)) if only else candidates
    listed = F.array(*[F.lit(m) for m in models]).cast("array<string>")
    none = F.array(F.lit(None).cast("string"))
    where = datasets if isinstance(datasets, Column) else F.array(*[F.lit(d) for d in datasets])
    return (
        picked.select("candidate", F.explode(F.when(F.col("uses_model"), listed).otherwise(none)).alias("model"), where.alias("_d"))
        .select("candidate", "model", F.explode("_d").alias("dataset"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_index"))
    )


def reconcile_jobs(plan: DataFrame, previous: DataFrame) -> DataFrame:
    """The planned jobs with the state they had before; new ones are pending, unplanned ones are gone."""
    known = previous.select(*JOB_KEY, F.col("status").alias("_status"), F.col("error").alias("_error"))
    joined = join_null_safe(plan.select(*JOB_KEY), known, JOB_KEY, "left")
    return joined.select(
        *JOB_KEY, F.coalesce("_status", F.lit("pending")).alias("status"), F.col("_error").alias("error")
    )


def find_artifact(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The jobs with ``artifact``, the newest file that fits; a job without a model takes any model's.

    Artefacts shrink to the newest per key, and to the newest over all models,
    before the join, so the "any model" rule needs no theta join.
    """
    place = ["candidate", "dataset", "run_index"]
    newest = F.max(F.struct("modified", "path"))
    by_model = artifacts.groupBy(*place, "model").agg(newest.alias("_a"))
    any_model = by_model.groupBy(*place).agg(F.max("_a").alias("_a")).withColumn("model", F.lit(None).cast("string"))
    fitting = by_model.filter(F.col("model").isNotNull()).unionByName(any_model)
    joined = join_null_safe(jobs, fitting, JOB_KEY, "left")
    return joined.select(*jobs.columns, F.col("_a.path").alias("artifact"))


def resume_status(jobs: DataFrame, artifacts: DataFrame, rerun_failed: bool = False) -> DataFrame:
    """The jobs with their status at restart, ``artifact`` and ``to_run``.

    Done stays; cancelled and interrupted jobs wait again; failed ones stay
    unless asked for; a waiting job whose artefact exists is done.
    """
    found = find_artifact(jobs, artifacts)
    status = F.col("status")
    waiting = status == "pending"
    new = (
        F.when(status.isin("cancelled", "in_progress"), "pending")
        .when((status == "failed") & F.lit(rerun_failed), "pending")
        .when(waiting & F.col("artifact").isNotNull(), "done")
        .otherwise(status)
    )
    kept = F.when(waiting, F.col("artifact"))
    out = found.withColumn("_new", new).withColumn("artifact", kept)
    return out.withColumn("status", F.col("_new")).drop("_new").withColumn("to_run", F.col("status") == "pending")


def status_counts(jobs: DataFrame) -> DataFrame:
    """status, n in report order, states without jobs included."""
    states = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(s).alias("status")) for i, s in enumerate(JOB_STATES)])
    counted = jobs.groupBy("status").agg(F.count("*").alias("n"))
    wide = counted.agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("_m"))
    rows = wide.select(F.col("_m"), F.inline(states))
    return rows.select("status", F.coalesce(F.try_element_at("_m", F.col("status")), F.lit(0)).alias("n"), "o").orderBy("o").drop("o")


def failed_jobs(jobs: DataFrame) -> DataFrame:
    """The failed jobs with the first line of their error."""
    return jobs.filter(F.col("status") == "failed").select(
        *JOB_KEY, F.substring_index(F.coalesce("error", F.lit("")), "\n", 1).alias("error_line")
    )


def exclude_examples(records: DataFrame, examples: DataFrame, on: Sequence[str] = ("strategy", "id")) -> DataFrame:
    """The records no strategy uses as a worked example."""
    return records.join(examples.select(*on).distinct(), list(on), "left_anti")


def exclude_listed(records: DataFrame, examples: Column | str, id_col: str = "id") -> DataFrame:
    """The same with the example ids in an array column."""
    listed = F.col(examples) if isinstance(examples, str) else examples
    return records.filter(~F.array_contains(listed, F.col(id_col)))


#: Neutral wording around a worked example and around the text to answer.
EXAMPLE_BLOCK = "### Example\n\nRequirements:\n{nlt}\n\nDiagram:\n{model}\n"
TASK_BLOCK = "### Task\n\nRequirements:\n{nlt}\n\nDiagram:\n"


def build_prompts(records: DataFrame, examples: DataFrame, example_block: str = EXAMPLE_BLOCK,
                  task_block: str = TASK_BLOCK) -> DataFrame:
    """The records with ``prompt``: the examples of their strategy in order, then the new text.

    ``examples`` holds strategy, pos, nlt, model. The blocks name where texts go:
    ``{nlt}`` and ``{model}`` in an example, ``{nlt}`` in the task. A strategy that
    many records share is a skewed key of a plain join, which adaptive execution splits.
    """
    before_nlt, rest = example_block.split("{nlt}")
    between, after = rest.split("{model}")
    block = F.concat(F.lit(before_nlt), F.col("nlt"), F.lit(between), F.col("model"), F.lit(after))
    ordered = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    shots = examples.groupBy("strategy").agg(F.transform(ordered, lambda b: b["block"]).alias("_shots"))
    joined = records.join(shots, "strategy", "left")
    head, tail = task_block.split("{nlt}")
    task = F.concat(F.lit(head), F.col("nlt"), F.lit(tail))
    none = F.array().cast("array<string>")
    prompt = F.array_join(F.concat(F.coalesce("_shots", none), F.array(task)), "\n")
    return joined.withColumn("prompt", prompt).drop("_shots")


def flatten_chat(messages: DataFrame) -> DataFrame:
    """conv_id, system, user.

    A leading system message becomes ``system``; all others follow as
    ``ROLE:`` and their text, one blank line apart. One aggregation per
    conversation.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chats = messages.groupBy("conv_id").agg(ordered.alias("_m"))
    first = F.element_at("_m", 1)
    leads = first["role"] == "system"
    tail = F.when(leads, F.slice("_m", F.lit(2), F.size("_m"))).otherwise(F.col("_m"))
    shown = F.transform(tail, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), m["text"]))
    return chats.select(
        "conv_id", F.when(leads, first["text"]).otherwise("").alias("system"), F.array_join(shown, "\n\n").alias("user")
    )
