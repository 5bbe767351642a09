"""Rule-based relation extraction over dependency-annotated tokens.

Tokens are packed and gathered by record once; the rules run on the sentence
trees of many records at a time (``ruletrees``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalize, is_valid_identifier
from .packs import packed, rows_until
from .quality import render_linked
from .ruletrees import CANDIDATE, KID, NUMBERS, WORDS, places_of, relations

# the trees are built where the job runs, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

KEYS = ["dataset", "id"]
SENTENCE = [*KEYS, "sent_i"]


def _is_candidate() -> Column:
    return F.col("pos").isin("NOUN", "PROPN") & is_valid_identifier("text")


def candidate_nouns(tokens: DataFrame) -> DataFrame:
    """Noun tokens whose text may name a class."""
    return tokens.filter(_is_candidate())


def promote_svo(tokens: DataFrame) -> DataFrame:
    """The tokens with ``promoted``: subject and object of one verb, both not candidates by themselves.

    A verb and its noun children share one window; the last subject and the
    last object of the verb are promoted together.
    """
    key = F.when(F.col("pos") == "VERB", F.col("i")).otherwise(F.col("head_i"))
    w = Window.partitionBy(*SENTENCE, "_verb")
    fresh = F.col("pos").isin("NOUN", "PROPN") & ~is_valid_identifier("text")

    def last(dep: str) -> Column:
        return F.max(F.when(fresh & (F.col("dep") == dep), F.col("i"))).over(w)

    placed = tokens.withColumn("_verb", key).withColumns(
        {"_s": last("nsubj"), "_o": last("dobj"), "_has": F.max(F.col("pos") == "VERB").over(w)}
    )
    both = fresh & F.col("_has") & F.col("_s").isNotNull() & F.col("_o").isNotNull()
    chosen = both & ((F.col("i") == F.col("_s")) | (F.col("i") == F.col("_o")))
    return placed.withColumn("promoted", F.coalesce(chosen, F.lit(False))).drop("_verb", "_s", "_o", "_has")


def class_names(tokens: DataFrame) -> DataFrame:
    """dataset, id, name_lower: what the rules accept as a class in each record."""
    named = promote_svo(tokens).filter(_is_candidate() | F.col("promoted"))
    return named.select(*KEYS, F.lower("text").alias("name_lower")).distinct()


def _is_kid() -> Column:
    return (F.col("head_i") != F.col("i")) & (F.col("dep").isin(*_ROLES) | (F.lower("text") == "maybe"))


_ROLES = ("nsubj", "dobj", "pobj", "conj", "prep", "attr", "acomp", "aux")


def sentence_trees(tokens: DataFrame) -> DataFrame:
    """dataset, id, sent_i, nodes, words: the tokens of a sentence in order, each with its children.

    A record's tokens come together in one sorted row; numpy gives every token its children for many records at once. A
    sentence is never larger than its text. Token numbers may have gaps; a head that is not among the tokens has a place
    without a token of its own. ``words`` are the names that are classes of the record though some token of that name is no
    candidate: they are found in the trees and shared by all its sentences.
    """
    named = tokens.withColumns({"name_lower": F.lower("text"), "candidate": F.coalesce(_is_candidate(), F.lit(False))})
    token = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("sent_i", "int"), *_FIELDS, ("head_i", "int"))], F.coalesce(_is_kid(), F.lit(False)).alias("is_kid"))
    by_record = named.select(*KEYS, token.alias("_t")).groupBy(*KEYS).agg(F.sort_array(F.collect_list("_t")).alias("tokens"))
    key_types = ", ".join(f"{c} {by_record.schema[c].dataType.simpleString()}" for c in KEYS)
    sentence = f"array<struct<sent_i:int,nodes:array<struct<at:int,own:{_NODE},kids:array<{_NODE}>>>>>"
    trees = by_record.mapInArrow(_planted, f"{key_types}, sents {sentence}")
    listed = F.array_distinct(F.flatten(F.transform("sents", lambda s: _class_words(s["nodes"]))))
    return trees.select(*KEYS, listed.alias("words"), "sents").select(*KEYS, "words", F.inline("sents"))


_FIELDS = (
    ("i", "int"), ("text", "string"), ("name_lower", "string"), ("lemma", "string"), ("pos", "string"), ("tag", "string"),
    ("dep", "string"), ("candidate", "boolean"),
)
_NODE = f"struct<{','.join(f'{c}:{t}' for c, t in _FIELDS)}>"

#: Tokens of the records whose trees are built together; a longer record is built alone.
_AT_ONCE = 1 << 16
#: The same for records that the rules read together.
_RULED_AT_ONCE = 1 << 18


def _starts(of: np.ndarray, n: int) -> pa.Array:
    """List offsets from the ascending places that the elements belong to."""
    return pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))


def _plant(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The sorted tokens of some records as trees: sents, array of (sent_i, nodes), nodes in order with their children."""
    lists = batch.column("tokens")
    offsets = lists.offsets.to_numpy()
    tokens = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    n = len(tokens)
    number = lambda f: tokens.field(f).fill_null(-(1 << 31)).to_numpy(zero_copy_only=False).astype(np.int64)
    record, sent_i, i, head = np.repeat(np.arange(len(lists)), np.diff(offsets)), number("sent_i"), number("i"), number("head_i")
    kid = tokens.field("is_kid").to_numpy(zero_copy_only=False).astype(bool)
    new = np.ones(n, bool)
    new[1:] = (record[1:] != record[:-1]) | (sent_i[1:] != sent_i[:-1])
    first, sentence = np.flatnonzero(new), np.cumsum(new) - 1
    _, heads, own, kids, places = places_of(sentence, i, head, kid)
    values = pa.StructArray.from_arrays([tokens.field(c) for c, _ in _FIELDS], [c for c, _ in _FIELDS])
    of_place = places >> 33
    at = places - (of_place << 33) - (1 << 32)
    nodes = pa.StructArray.from_arrays(
        [pa.array(at.astype(np.int32), mask=at == -(1 << 31)), values.take(pa.array(own, mask=own < 0)),
         pa.ListArray.from_arrays(_starts(heads[kids], len(places)), values.take(pa.array(kids)))], ["at", "own", "kids"])
    sents = pa.StructArray.from_arrays(
        [tokens.field("sent_i").take(pa.array(first)), pa.ListArray.from_arrays(_starts(of_place, len(first)), nodes)], ["sent_i", "nodes"])
    grown = pa.ListArray.from_arrays(_starts(record[first], len(lists)), sents)
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEYS], grown], [*KEYS, "sents"])


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        total, at = np.cumsum(np.diff(batch.column("tokens").offsets.to_numpy())), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + _AT_ONCE, "right")))
            yield _plant(batch.slice(at, end - at))
            at = end


def _class_words(nodes: Column) -> Column:
    """Names of a sentence's candidates and of what its verbs promote (see ``promote_svo``)."""
    own = F.transform(F.filter(nodes, lambda n: n["own"]["candidate"]), lambda n: n["own"]["name_lower"])

    def promoted(verb: Column) -> Column:
        def last(dep: str) -> Column:
            fresh = F.filter(verb["kids"], lambda k: (k["dep"] == dep) & k["pos"].isin("NOUN", "PROPN") & ~k["candidate"])
            return F.try_element_at(fresh, F.lit(-1))["name_lower"]

        both = F.array(last("nsubj"), last("dobj"))
        return F.when(F.size(F.array_compact(both)) == 2, both).otherwise(F.array().cast("array<string>"))

    verbs = F.filter(nodes, lambda n: n["own"]["pos"] == "VERB")
    return F.array_distinct(F.concat(own, F.flatten(F.transform(verbs, promoted))))


RULES = ("association", "aggregation", "composition", "include", "generalization")


def apply_rules(tokens: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """dataset, id, sent_i, rule, source, label, target, source_card, target_card of the chosen rules.

    All rules read the same sentence trees, in one pass and without joins: tokens are packed and meet by record, and the rules
    of ``ruletrees`` run on the trees of many records at once.
    """
    flags = F.when(_is_candidate(), CANDIDATE).otherwise(0) + F.when(_is_kid(), KID).otherwise(0)
    rows = packed(tokens.withColumns({"name_lower": F.lower("text"), "flags": flags}), NUMBERS, WORDS, "tokens")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema.fields)
    chosen = list(rules)

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at = rows_until(batch.column("tokens")), 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + _RULED_AT_ONCE, "right")))
                some = batch.slice(at, end - at)
                record, columns = relations(some.column("tokens"), chosen)
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(record)) for c in KEYS), *columns.values()], [*KEYS, *columns])
                at = end

    found = rows.mapInArrow(
        ruled, f"{keys}, sent_i int, rule string, source string, label string, target string, source_card string, target_card string")
    return found.withColumns({c: capitalize(c) for c in ("source", "target")})


def extract_association(tokens: DataFrame) -> DataFrame:
    return apply_rules(tokens, ["association"])


def extract_aggregation(tokens: DataFrame) -> DataFrame:
    return apply_rules(tokens, ["aggregation"])


def extract_composition(tokens: DataFrame) -> DataFrame:
    return apply_rules(tokens, ["composition"])


def extract_include(tokens: DataFrame) -> DataFrame:
    return apply_rules(tokens, ["include"])


def extract_generalization(tokens: DataFrame) -> DataFrame:
    return apply_rules(tokens, ["generalization"])


def extract_relations(tokens: DataFrame) -> DataFrame:
    """All five rules in one pass."""
    return apply_rules(tokens)


_KIND = {
    "association": "association",
    "aggregation": "aggregation",
    "composition": "composition",
    "include": "composition",
    "generalization": "inheritance",
}


def relations_to_diagram(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """dataset, id, generated, failed, error: the rules as a generator.

    Every linked name is declared as a class. A record without any relation
    gives an empty text and the error ``no_relations``.
    """
    found = extract_relations(tokens)
    kinds = F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])
    order = F.create_map(*[F.lit(x) for i, rule in enumerate(_KIND) for x in (rule, i)])
    rels = found.select(
        *KEYS, "source", "target", F.element_at(kinds, F.col("rule")).alias("kind"), "source_card", "target_card",
        F.when(F.col("rule") == "association", F.col("label")).alias("label"),
        F.struct(F.element_at(order, F.col("rule")), "sent_i").alias("line_no"),
    )
    text = render_linked(rels)
    joined = records.select(*KEYS).join(text, KEYS, "left")
    missing = F.col("puml").isNull()
    return joined.select(
        *KEYS, F.coalesce("puml", F.lit("")).alias("generated"), missing.alias("failed"),
        F.when(missing, "no_relations").alias("error"),
    )
