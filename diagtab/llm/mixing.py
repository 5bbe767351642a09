"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diagtab.llm.common import WORD, numbered, prefix_sum, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document, and so no source, is taken more often than this.
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target words per source from (source, source_size): rows (source, source_size, target double).

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. A source whose
    share is above `most` times its size gets just that; its excess goes to the others by weight until none is above.
    Sources that reach their bound are those with the least size per weight: in that order a source is bound if its share
    of what those before it leave is no less than its bound. Order and sums are spread over ranges like those of documents,
    so sources may be as many as hosts; only totals and the first source that is not bound go to the driver. Whole
    numbers until the last step keep reruns and engines equal.
    """
    placed = numbered(sizes.select("source", "source_size"), [F.col("source").isNull(), "source"], "__place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__place") % len(weights) + 1).cast("int")).cast("long")
    weighed = placed.select("source", F.col("source_size").alias("n"), weight.alias("w"), "__place")
    ordered = numbered(weighed, [F.col("n").cast("double") / F.col("w"), "__place"], "__pos").select("source", "n", "w", "__pos")
    seen = prefix_sum(prefix_sum(ordered, "__pos", "n", "n_before"), "__pos", "w", "w_before")
    all_n, all_w = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left, rest = F.lit(all_n) - most * F.col("n_before"), F.lit(all_w) - F.col("w_before")
    bound = most * F.col("n").cast("double") * rest <= left.cast("double") * F.col("w")
    judged = written(seen.select("source", "n", "w", "__pos", left.alias("left"), rest.alias("rest"), bound.alias("bound")))
    pool = judged.where(~F.col("bound")).agg(F.min(F.struct("__pos", "left", "rest")).alias("p")).first().p
    target = (most * F.col("n")).cast("double")
    if pool is not None:
        target = F.when(F.col("bound"), target).otherwise(F.lit(float(pool.left)) * F.col("w") / pool.rest)
    return judged.select("source", F.col("n").alias("source_size"), target.alias("target"))


def offset(source, seed: str):
    """One offset in [0, 1) per source: 20 bits of a digest, so sums with whole numbers stay exact."""
    key = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)))
    return F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("double") / 1048576


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", id_text: Column | None = None) -> DataFrame:
    """Copies of every document in the mix: rows (doc_id, source, size, source_size, target, copies).

    Within its source a document is expected `target / source_size` times, at most `most`. Documents are placed by
    size, then by a digest of the id; the expected copies are summed up along that order, one offset is added per
    source, and a document is emitted once per whole number that its stretch crosses. Placing by size spreads the copies
    evenly over short and long documents, so the words taken come near the target. The place comes from one sort over
    ranges (`numbered`), so a source with a third of all rows is spread like any other.

    Null texts and texts without words have size 0 and are sampled alike; a source without words has target 0 and
    expects no copies. `id_text` is the text of the digest if it is not that of the id. Null sources are one source. Repeated rows are documents of their own. Empty in, empty out.
    """
    placed_by = F.md5(F.col(id_col).cast("string") if id_text is None else id_text)
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), placed_by.alias("__digest"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = numbered(rows, [F.col("source").isNull(), "source", "size", "__digest", "doc_id"], "__i")
    firsts = ranked.groupBy("source").agg(F.min("__i").alias("__first"))
    plan = written(
        source_targets(totals.select("source", "source_size"), weights, most).alias("t")
        .join(firsts.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")))
        .select("t.*", "f.__first", offset(F.col("t.source"), seed).alias("__u"))
    )
    each = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    at = F.col("__i") - F.col("__first")
    crossed = F.floor((at + 1) * each + F.col("__u")) - F.floor(at * each + F.col("__u"))
    return (
        ranked.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", crossed.cast("long").alias("copies"))
    )
