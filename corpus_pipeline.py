"""A training corpus from raw documents in five stages, each applied to all that the one before kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as a table that the
next stage reads. All but the last return the columns of `docs`, further columns included; the last adds `copy_no`.

Null ids: a row without an id is told apart by its text. Rows that repeat an id and a text are one document from the
third stage on; different texts under one id are different documents in all stages. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diagtab.llm import decontam, langid, lines, mixing, nearcopies, simhash
from diagtab.llm.common import components, table, written

#: Columns with a meaning for the stages; all others are carried along.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if less than this share of its n-grams belongs to its language.
MIN_COVERAGE = 0.2
#: Texts of fewer n-grams are too short to be rejected by coverage.
MIN_GRAMS = 16


def _plain(docs: DataFrame) -> DataFrame:
    """`docs` with its further columns renamed, so that none clashes with a column an operator adds."""
    return docs.select([F.col(f"`{c}`").alias(c if c in KNOWN else f"__further_{i}") for i, c in enumerate(docs.columns)])


def _restored(rows: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of `docs` under their names, and the columns `added`."""
    names = [c for c in docs.columns if c not in added]
    return rows.select(*[F.col(c if c in KNOWN else f"__further_{docs.columns.index(c)}").alias(c) for c in names], *added)


def _id() -> Column:
    """The id, or for a null id a number above all ids that its text gives."""
    by_text = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    return F.coalesce(F.col("doc_id"), by_text)


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a key of id and text digest: rows that repeat an id are told apart by their texts."""
    rows = _plain(docs).withColumns({"__id": _id(), "__hash": F.xxhash64("text")})
    return rows.withColumn("__key", F.struct("__id", "__hash"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no language covers; learns from the labelled ones.

    Documents of fewer than MIN_GRAMS n-grams, a word or two, stay if they have a letter.

    If no document has a label, no language is known and only documents without a letter go.
    """
    model = langid.fit(docs)
    found = langid.predict(_plain(docs), model, names=("__lang", "__score", "__coverage"), n_grams="__grams")
    letters = F.col("text").rlike(r"\p{L}")
    covered = (F.col("__coverage") >= MIN_COVERAGE) | (F.col("__grams") < MIN_GRAMS)
    return _restored(found.where(letters & covered if model.languages else letters), docs)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many sources share and brings n_chars up to date; keeps all documents."""
    cleaned = lines.drop_spread_lines(_plain(docs)).withColumn("n_chars", F.length("text").cast("long"))
    return _restored(cleaned, docs)


def _groups(rows: DataFrame) -> DataFrame:
    """Rows (__hash, group) for every text digest of `rows`: texts that links of either method connect have one group."""
    by_print = simhash.near_duplicates(rows, id_col="__hash").select(F.col("doc_id").alias("__hash"), F.col("component_id").alias("u")).distinct()
    by_words = nearcopies.near_copies(rows, id_col="__hash").select(F.col("doc_id").alias("__hash"), F.col("component_id").alias("v")).distinct()
    # a group is named by the digest of one of its texts, so the two names of a text are linked texts
    both = written(by_print.join(by_words, "__hash"))
    found = components(both.select("u", "v").distinct())
    return both.join(found, F.col("u") == F.col("id"), "left").select("__hash", F.coalesce("component", "u").alias("group"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id, of equal ids the least digest.

    Documents are near copies if their SimHash fingerprints differ in at most 2 bits, found by pigeonring chains as in
    op2, or if their sets of five-word shingles have a Jaccard similarity of 0.8 or more: fingerprints of many such texts
    are about 10 of 64 bits apart, which no chain selects, so MinHash bands add what the fingerprints leave apart.
    Links of both connect. Different texts under one id are different documents.
    """
    rows = _keyed(docs)
    placed = rows.select("__id", "__hash").join(written(_groups(rows)), "__hash")
    kept = written(placed.groupBy("group").agg(F.min(F.struct("__id", "__hash")).alias("__key")).select("__key.*"))
    rest = [c for c in rows.columns if c not in ("__id", "__hash", "__key")]
    chosen = rows.join(kept, ["__id", "__hash"], "left_semi").groupBy("__id", "__hash").agg(
        F.min_by(F.struct(*rest), F.struct("source", "lang")).alias("row"))
    return _restored(chosen.select("row.*"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    rows = _keyed(docs)
    hits = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="__key")
    found = written(hits.select("doc_id.*").distinct())
    return _restored(rows.join(found, ["__id", "__hash"], "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as the mix takes it, numbered by `copy_no` from 1."""
    rows = _keyed(docs)
    mixed = mixing.mix(rows, id_col="__key", id_text=F.col("__id").cast("string"))
    copies = written(mixed.groupBy("doc_id").agg(F.sum("copies").alias("__copies")).where("__copies > 0").select(
        "doc_id.__id", "doc_id.__hash", "__copies"))
    taken = rows.dropDuplicates(["__id", "__hash"]).join(copies, ["__id", "__hash"])
    return _restored(taken.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))), docs, "copy_no")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language identification is learned and fingerprints need XXH64, which SQL here lacks; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
