"""The registered queries of the operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diagtab.llm import bytecnn, chatformat, collocations, decontam, embeddup, langid, lines, mixing, mtree, periodic, simhash, substrings, tokencount
from diagtab.llm.common import WORD, table

#: Name of the tokenizer file that op4 counts with; its folder comes from the installed package.
TOKENIZER = "piece_bpe_32k.model"
#: Documents with more tokens are over the limit.
TOKEN_LIMIT = 4096


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substrings.drop_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_token_counts(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, model or public_tokenizers.path(TOKENIZER))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(fold(3) != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddup.near_vectors(table(spark, folder, "embeddings"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_spread_lines(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema))
    back = chatformat.read_back(*chatformat.prefix_tree(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = bytecnn.fit(docs.where(fold(5) != 0), labels.where(fold(5) != 0))
    found = bytecnn.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def _replayed(text: Column, h: Column) -> Column:
    """The words of a text, those from word a on replaced by the first p of them over and over."""
    def of(v: Column) -> Column:
        n, g = F.size(v.words).cast("long"), F.floor(v.h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(v.words, (a + (i - a) % p).cast("int")))
        return F.array_join(F.when(n > 0, F.concat(F.slice(v.words, F.lit(1), a.cast("int")), again)).otherwise(v.words), " ")

    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("words"), h.alias("h")))
    return F.get(F.transform(bound, of), F.lit(0))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when(h % 10 == 0, _replayed(F.col("text"), h)).otherwise(F.col("text"))
    found = periodic.collapse_runs(table(spark, folder, "documents").select("doc_id", text.alias("text")))
    better = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    strongest = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))))
    rows = found.withColumn("best", strongest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2(F.col("kept"), 256).alias("collapsed_sha256"))


def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_products(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_token_counts": op4_token_counts,
        "op5_source_mix": op5_source_mix,
        "op6_language_id": op6_language_id,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_quality_score": op10_quality_score,
        "op11_collocations": op11_collocations,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_exact_top_k": op13_exact_top_k,
    }
