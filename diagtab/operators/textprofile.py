"""Text, sentence and token features per record."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import HEDGE_WORDS, MODAL_VERBS
from ..functions.text import let, lower_words, sentences, split_identifier, strip, words
from .packs import NULL, flat, packed, rows_until, tallied, unpacked

# the lookups travel with the job, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

KEYS = ["dataset", "id"]


def text_features(df: DataFrame, col: str = "nlt", rounded: bool = True) -> DataFrame:
    """The input columns but the text, plus its surface features. A narrow projection.

    ``rounded`` gives the reported decimals; leave it off to compare values.
    """
    text = F.col(col)

    def measure(ws: Column) -> Column:
        lowered = F.array_distinct(F.transform(ws, F.lower))
        return F.struct(
            F.size(ws).alias("n_words"),
            F.size(lowered).alias("n_unique"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("letters"),
        )

    n_sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: strip(s) != ""))
    measured = df.select(
        *[c for c in df.columns if c != col],
        F.length(text).alias("n_chars"),
        let(words(text), measure).alias("_m"),
        n_sentences.alias("n_sentences"),
    )

    def shown(c: Column, digits: int) -> Column:
        return F.bround(c, digits) if rounded else c

    n = F.col("_m.n_words")
    return measured.select(
        *[c for c in df.columns if c != col],
        "n_chars",
        n.alias("n_words"),
        "n_sentences",
        F.col("_m.n_unique").alias("n_unique_words_lower"),
        shown(F.when(n > 0, F.col("_m.n_unique") / n).otherwise(0.0), 4).alias("type_token_ratio"),
        shown(F.when(n > 0, F.col("_m.letters") / n).otherwise(0.0), 3).alias("avg_word_length"),
        shown(n / F.greatest(F.col("n_sentences"), F.lit(1)), 2).alias("avg_sentence_length_words"),
    )


def split_sentences(df: DataFrame, col: str = "nlt", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, sent_i (from 0), sentence."""
    return df.select(*keys, F.posexplode(sentences(col)).alias("sent_i", "sentence"))


_HIT_KINDS = ("class", "attribute", "endpoint")
_HITS = ("n_class_hits", "n_attr_hits", "n_rel_endpoint_hits")
#: Words and parts of the records that are looked up together; a longer record is looked up alone.
_AT_ONCE = 1 << 18


def _count_hits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The sentences of some records with their words and the distinct ones among them that are parts of the record's names."""
    sents, record = flat(batch.column("_s"))
    ws, sent = flat(sents)
    names, name_record = flat(batch.column("_names"))
    kind = names.field("code").to_numpy(zero_copy_only=False).astype(np.int64)
    parts, name = flat(names.field("parts"))
    codes = pa.concat_arrays([ws.cast(pa.string()), parts.cast(pa.string())]).dictionary_encode().indices
    codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
    asked = (name_record[name] << 32) | codes[len(ws):]
    distinct = np.unique((sent << 32) | codes[:len(ws)])  # the words of a sentence, each once
    sent_of = distinct >> 32
    wanted = (record[sent_of] << 32) | (distinct & 0xFFFFFFFF)
    found = []
    for k in range(len(_HITS)):
        keys = np.unique(asked[kind[name] == k])
        held = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)
        found.append(pa.array(np.bincount(sent_of[held], minlength=len(sents))))
    first = np.searchsorted(record, np.arange(batch.num_rows))
    number = np.arange(len(sents)) - first[record]
    n_words = np.bincount(sent, minlength=len(sents))
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(pa.array(record)) for c in KEYS), pa.array(number.astype(np.int32)), pa.array(n_words.astype(np.int32)), *found],
        [*KEYS, "sent_i", "n_words", *_HITS])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sents, names = batch.column("_s"), batch.column("_names")
        n_words = sents.values.offsets.to_numpy()[sents.offsets.to_numpy()]
        n_parts = names.values.field("parts").offsets.to_numpy()[names.offsets.to_numpy()]
        sizes = (n_words + n_parts)[1:] - (n_words + n_parts)[0]
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + _AT_ONCE, "right")))
            yield _count_hits(batch.slice(at, end - at))
            at = end


def sentence_stats(records: DataFrame, names: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """dataset, id, sent_i, n_words, n_class_hits, n_attr_hits, n_rel_endpoint_hits, n_tokens.

    ``names`` holds dataset, id, kind (class / attribute / endpoint), name. A hit
    is a distinct word of the sentence that is a part of such a name. Sentences
    and names of a record meet in one row; words are never rows of their own.
    """
    def lowered(s: Column) -> Column:
        return F.transform(words(s), F.lower)

    sents = records.where(F.col("nlt").isNotNull()).select(*KEYS, F.transform(sentences("nlt"), lowered).alias("_s"))
    code = F.when(F.col("kind") == _HIT_KINDS[0], 0).when(F.col("kind") == _HIT_KINDS[1], 1).when(F.col("kind") == _HIT_KINDS[2], 2)
    parts = names.where(F.col("kind").isin(*_HIT_KINDS) & F.col("name").isNotNull()).select(
        *KEYS, F.struct(code.alias("code"), split_identifier("name").alias("parts")).alias("_n")
    ).groupBy(*KEYS).agg(F.collect_list("_n").alias("_names"))
    none = F.array().cast(parts.schema["_names"].dataType)
    rows = sents.join(parts, KEYS, "left").withColumn("_names", F.coalesce("_names", none))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema.fields)
    counted = rows.mapInArrow(_searched, f"{keys}, sent_i int, n_words int, {', '.join(f'{c} bigint' for c in _HITS)}")
    # sentences of one number and length count together where a record comes twice
    hits = counted.groupBy(*KEYS, "sent_i", "n_words").agg(*[F.sum(c).alias(c) for c in _HITS])
    if tokens is None:
        return hits
    n_tokens = tokens.groupBy("dataset", "id", "sent_i").agg(F.count("*").alias("n_tokens"))
    return hits.join(n_tokens, ["dataset", "id", "sent_i"], "left").withColumn(
        "n_tokens", F.coalesce("n_tokens", F.lit(0))
    )


def _entity_profile(entities: DataFrame | None, tokens: DataFrame) -> DataFrame:
    """dataset, id, n_entities, entity_types: entities are read once for both."""
    if entities is None:
        none = tokens.select(*KEYS).limit(0)
        return none.select(*KEYS, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_types"))
    counted = entities.groupBy(*KEYS, "label").agg(F.count("*").alias("_n"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "_n"))))
    shown = F.transform(pairs, lambda p: F.concat(p["label"], F.lit(":"), p["_n"].cast("string")))
    return counted.groupBy(*KEYS).agg(F.sum("_n").alias("n_entities"), F.array_join(shown, ";").alias("entity_types"))


def _style_counts() -> dict[str, Column]:
    lemma = F.lower("lemma")
    return {
        "passive_nsubjpass": F.col("dep") == "nsubjpass",
        "active_nsubj": F.col("dep") == "nsubj",
        "modal_count": lemma.isin(*MODAL_VERBS) & F.col("pos").isin("VERB", "AUX"),
        "hedge_count": lemma.isin(*HEDGE_WORDS),
    }


def _style_columns(rounded: bool) -> list[Column]:
    """Style columns of a row with the style counts, n_tokens and n_entities."""
    named, n = F.coalesce("n_entities", F.lit(0)), F.col("n_tokens")

    def shown(c: Column) -> Column:
        return F.bround(c, 4) if rounded else c

    subjects = F.greatest(F.col("passive_nsubjpass") + F.col("active_nsubj"), F.lit(1))
    return [
        *[F.col(c).alias(c) for c in ("passive_nsubjpass", "active_nsubj", "modal_count", "hedge_count")], named.alias("named_entities"),
        shown(F.col("passive_nsubjpass") / subjects).alias("passive_ratio"),
        shown(F.col("hedge_count") / n).alias("hedge_density"),
        shown(F.col("modal_count") / n).alias("modal_density"),
        shown(named / n).alias("entity_density"),
    ]


def _token_counts() -> dict[str, Column]:
    dep, pos = F.col("dep"), F.col("pos")
    return {
        "n_nsubj": dep == "nsubj",
        "n_nsubjpass": dep == "nsubjpass",
        "n_dobj": dep == "dobj",
        "n_verbs": pos == "VERB",
        "n_nouns": pos.isin("NOUN", "PROPN"),
        "n_adjectives": pos == "ADJ",
        "_edges": F.col("head_i") != F.col("i"),
    }


def _token_sets() -> dict[str, Column]:
    return {"n_sents": F.col("sent_i"), "n_unique_lemmas": F.when(F.col("text").rlike(r"^\p{L}+\z"), F.lower("lemma"))}


def _token_columns(rounded: bool) -> list[Column]:
    """Token columns of a row with the token counts, n_tokens, n_noun_chunks, n_entities and entity_types."""
    def shown(c: Column, digits: int) -> Column:
        return F.bround(c, digits) if rounded else c

    return [
        *[F.col(c).alias(c) for c in ("n_tokens", "n_sents", "n_nsubj", "n_nsubjpass", "n_dobj", "n_verbs", "n_nouns", "n_adjectives")],
        F.coalesce("n_noun_chunks", F.lit(0)).alias("n_noun_chunks"),
        F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
        F.coalesce("entity_types", F.lit("")).alias("entity_types"),
        shown(F.col("n_nsubjpass") / F.greatest("n_nsubj", F.lit(1)), 4).alias("passive_ratio"),
        shown(F.col("_edges") / F.col("n_tokens"), 3).alias("mean_children"),
        F.col("n_unique_lemmas"),
    ]


def _profiled(tokens: DataFrame, entities: DataFrame | None, chunks: DataFrame | None, counts: dict[str, Column],
              distinct: dict[str, Column] | None = None) -> DataFrame:
    """One count over the tokens, with the entities and chunks of each record."""
    counted = tallied(tokens, counts, distinct).withColumnRenamed("n", "n_tokens")
    joined = counted.join(_entity_profile(entities, tokens), KEYS, "left")
    if chunks is None:
        return joined.withColumn("n_noun_chunks", F.lit(0).cast("long"))
    return joined.join(chunks.groupBy(*KEYS).agg(F.count("*").alias("n_noun_chunks")), KEYS, "left")


def style_features(tokens: DataFrame, entities: DataFrame | None = None, rounded: bool = True) -> DataFrame:
    """Passive, modal, hedge and entity counts and densities per record.

    ``passive_ratio`` is passive / (passive + active).
    """
    return _profiled(tokens, entities, None, _style_counts()).select(*KEYS, *_style_columns(rounded))


def token_features(tokens: DataFrame, entities: DataFrame | None = None, chunks: DataFrame | None = None,
                   rounded: bool = True) -> DataFrame:
    """Token, sentence, role and part-of-speech counts per record; ``passive_ratio`` is nsubjpass / nsubj here.

    Runs of a record's tokens are counted inside the task; per run one row of
    counts, sentences and distinct lemmas (bounded by the text) is exchanged.
    """
    return _profiled(tokens, entities, chunks, _token_counts(), _token_sets()).select(*KEYS, *_token_columns(rounded))


def token_profile(tokens: DataFrame, entities: DataFrame | None = None, chunks: DataFrame | None = None,
                  rounded: bool = True) -> DataFrame:
    """``token_features`` as tok_ and ``style_features`` as style_ columns, from one aggregation over the tokens."""
    both = _profiled(tokens, entities, chunks, _token_counts() | _style_counts(), _token_sets())
    return both.select(*KEYS, F.struct(*_token_columns(rounded)).alias("tok"), F.struct(*_style_columns(rounded)).alias("style")).select(
        *KEYS, "tok", "style")


def entity_type_string(entities: DataFrame) -> DataFrame:
    """dataset, id, entity_types: ``LABEL:count`` joined by ``;`` in label order."""
    counted = entities.groupBy(*KEYS, "label").agg(F.count("*").alias("_n"))
    pairs = F.sort_array(F.collect_list(F.struct("label", "_n")))
    shown = F.transform(pairs, lambda p: F.concat(p["label"], F.lit(":"), p["_n"].cast("string")))
    return counted.groupBy(*KEYS).agg(F.array_join(shown, ";").alias("entity_types"))


def mean_children(tokens: DataFrame) -> DataFrame:
    """dataset, id, mean_children: edges per token."""
    edge = (F.col("head_i") != F.col("i")).cast("int")
    return tokens.groupBy(*KEYS).agg((F.sum(edge) / F.count("*")).alias("mean_children"))


def _root_distances(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Steps to the root, at most 32, summed over the tokens of each record."""
    record, of, _ = unpacked(batch.column("tokens"), ("sent_i", "i", "head_i"))
    order = np.lexsort((of["head_i"], of["i"], of["sent_i"], record))
    record, sent_i, i, head = record[order], *(of[c][order] for c in ("sent_i", "i", "head_i"))
    n, every = len(order), np.arange(len(order))
    new = np.ones(n, bool)
    new[1:] = (record[1:] != record[:-1]) | (sent_i[1:] != sent_i[:-1])
    start = np.maximum.accumulate(np.where(new, every, 0)) if n else every
    key, wanted = (start << 33) + i, (start << 33) + head
    at = np.minimum(np.searchsorted(key, wanted), max(0, n - 1))
    # where numbers have no gaps the place follows from the first number
    guess = np.clip(start + head - i[start], start, max(0, n - 1))
    at = np.where((i[start] != NULL) & (key[guess] == wanted), guess, at)
    up = np.where((key[at] == wanted) & (head != NULL), at, every)
    steps = (up != every).astype(np.int64)
    for _ in range(5):
        steps, up = steps + steps[up], up[up]
    total = np.bincount(record, weights=steps, minlength=batch.num_rows).astype(np.int64)
    counted = np.bincount(record, minlength=batch.num_rows)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(total), pa.array(counted)], [*KEYS, "_sum", "_n"])


def mean_root_distance(tokens: DataFrame) -> DataFrame:
    """dataset, id, mean_root_distance: steps to the root of the sentence tree, capped at 32.

    The tokens of a record, packed, meet in one row. Heads are found by sorted
    lookups and five rounds of pointer doubling reach exactly 32 steps. Token
    numbers may have gaps; a token whose head is not among the tokens is a root.
    """
    rows = packed(tokens, ("sent_i", "i", "head_i"), name="tokens")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema.fields)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = rows_until(batch.column("tokens"))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + _AT_ONCE, "right")))
                yield _root_distances(batch.slice(at, end - at))
                at = end

    per_record = rows.mapInArrow(measured, f"{keys}, _sum bigint, _n bigint")
    return per_record.select(*KEYS, (F.col("_sum") / F.col("_n")).alias("mean_root_distance"))


def token_edges(tokens: DataFrame) -> DataFrame:
    """dataset, id, sent_i, src, tgt, dep: head to token, no self edges."""
    return tokens.filter(F.col("head_i") != F.col("i")).select(
        *KEYS, "sent_i", F.col("head_i").alias("src"), F.col("i").alias("tgt"), "dep"
    )


def token_graph_sizes(tokens: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """dataset, id, n_nodes, n_edges, n_noun_chunks."""
    sizes = tokens.groupBy(*KEYS).agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("head_i") != F.col("i")).alias("n_edges")
    )
    if chunks is None:
        return sizes.withColumn("n_noun_chunks", F.lit(0).cast("long"))
    n = chunks.groupBy(*KEYS).agg(F.count("*").alias("n_noun_chunks"))
    return sizes.join(n, KEYS, "left").withColumn("n_noun_chunks", F.coalesce("n_noun_chunks", F.lit(0)))


TOKEN_SCHEMA = (
    "sent_i int, i int, text string, lemma string, pos string, tag string, dep string, head_i int"
)


def annotate(records: DataFrame, annotator: Callable[[str], list[dict]] | None = None, col: str = "nlt",
             errors: bool = False) -> DataFrame:
    """dataset, id and token rows of each text.

    ``annotator`` is any function from a text to a list of dicts with the token
    fields; it runs per record inside the tasks. Without one, a plain word
    splitter gives text, lower-case lemma and position, and every token is its
    own root. With ``errors`` a text on which the function fails gives one row
    without a token whose ``error`` says why; otherwise it fails the job.
    """
    if annotator is None:
        sents = split_sentences(records, col)
        rows = F.transform(
            lower_words("sentence"),
            lambda w, i: F.struct(
                i.alias("i"), w.alias("text"), w.alias("lemma"), F.lit("X").alias("pos"), F.lit("").alias("tag"),
                F.lit("ROOT").alias("dep"), i.alias("head_i"),
            ),
        )
        plain = sents.select(*KEYS, "sent_i", F.inline(rows))
        return plain.withColumn("error", F.lit(None).cast("string")) if errors else plain
    key_fields = [f for f in records.schema.fields if f.name in KEYS]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", " + TOKEN_SCHEMA
    names = [part.split()[0] for part in TOKEN_SCHEMA.split(", ")]
    if errors:
        schema, names = schema + ", error string", [*names, "error"]

    def run(batches):
        import pandas as pd

        for batch in batches:
            found = []
            for dataset, record_id, text in zip(batch["dataset"], batch["id"], batch[col], strict=True):
                try:
                    tokens = [t | {"dataset": dataset, "id": record_id} for t in annotator(text)]
                except Exception as exc:
                    if not errors:
                        raise
                    tokens = [{"dataset": dataset, "id": record_id, "error": f"exception: {type(exc).__name__}: {exc}"}]
                found += tokens
            frame = pd.DataFrame(found, columns=["dataset", "id", *names])
            yield frame.astype({c: "Int32" for c in ("sent_i", "i", "head_i")})

    return records.select(*KEYS, col).mapInPandas(run, schema.replace("bigint", "long"))
