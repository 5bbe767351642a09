"""Are the names of a diagram present in its text, at four levels?

The names and the words of a record meet in one row, which the record bounds;
Spark brings them together by key, and numpy looks up the words of many such
rows at once. Lemma, inflection and synonym lists are tables that meet the
distinct parts of all names; a frequent part makes a skewed key in one plain
join, which adaptive execution splits.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scan import parts_of, words_of
from ..functions.text import WORD, lower_words
from .packs import flat, packs_of, unpacked
from .textprofile import split_sentences

# the lookups travel with the job, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

KEYS = ["dataset", "id"]
KINDS = ("class", "attribute", "enum_value", "rel_source", "rel_target")
_ELEMENT = ["kind", "owner", "name"]


def build_lexicon(lemmas: DataFrame | None = None, inflections: DataFrame | None = None) -> DataFrame:
    """token, forms: array of (form, is_lemma) from lemma(token, lemma) and inflection(token, singular, plural) tables."""
    rows = []
    if lemmas is not None:
        rows.append(lemmas.select("token", F.lower("lemma").alias("form"), F.lit(True).alias("is_lemma")))
    if inflections is not None:
        for col in ("singular", "plural"):
            rows.append(inflections.select("token", F.lower(col).alias("form"), F.lit(False).alias("is_lemma")))
    out = rows[0]
    for extra in rows[1:]:
        out = out.unionByName(extra)
    merged = out.groupBy("token", "form").agg(F.max("is_lemma").alias("is_lemma"))
    return merged.groupBy("token").agg(F.collect_list(F.struct("form", "is_lemma")).alias("forms"))


def synonym_lists(synonyms: DataFrame) -> DataFrame:
    """token, synonyms: lower-case, underscores as blanks."""
    cleaned = F.lower(F.regexp_replace("synonym", "_", " "))
    return synonyms.groupBy("token").agg(F.collect_set(cleaned).alias("synonyms"))


def text_tokens(records: DataFrame, col: str = "nlt") -> DataFrame:
    """dataset, id, sent_i, tok_i, token."""
    sents = split_sentences(records, col)
    return sents.select(*KEYS, "sent_i", F.posexplode(lower_words("sentence")).alias("tok_i", "token"))


def build_text_index(records: DataFrame, lexicon: DataFrame | None = None, col: str = "nlt") -> DataFrame:
    """dataset, id, form, is_token, is_lemma: every word form a text offers to L1, L2 and L4.

    Without a lexicon the tokens are their own lemmas. The lexicon meets the distinct words of a block of records.
    """
    if lexicon is None:
        tokens = records.select(*KEYS, F.explode(F.array_distinct(lower_words(col))).alias("form"))
        return tokens.select(*KEYS, "form", F.lit(True).alias("is_token"), F.lit(True).alias("is_lemma"))
    blocks = _blocks(records.select(*KEYS, F.col(col).alias("text")))
    asked = _asked_by(blocks, lambda batch: words_of(batch.column("text"))[0])
    lists = asked.withColumnRenamed("word", "token").join(lexicon, "token").select("_block", "token", F.col("forms").cast(
        "array<struct<form:string,is_lemma:boolean>>").alias("forms"))

    def work(rows, record, found):
        words, at, _ = words_of(rows.column("text"))
        offered, entry = flat(_one(found.column("forms")))
        every, (word, token, form) = _coded(words, _one(found.column("token")), offered.field("form"))
        own = np.unique((record[at] << 32) | word)
        order = np.argsort(token, kind="stable")
        ends = [np.searchsorted(token[order], own & 0xFFFFFFFF, side) for side in ("left", "right")]
        listed, which = _runs(*ends)
        of_entry = np.searchsorted(entry, np.arange(len(token) + 1))
        each, of = _runs(of_entry[order[listed]], of_entry[order[listed] + 1])
        # a word without an entry is its own lemma; a form may be null
        keys = np.concatenate([own + 1, (own[which[of]] >> 32 << 32) + form[each] + 1])
        is_lemma = np.append(ends[0] == ends[1], pc.fill_null(offered.field("is_lemma"), False).to_numpy(zero_copy_only=False).astype(bool)[each])
        known, place = np.unique(keys, return_inverse=True)
        flags = [np.bincount(place[rows], minlength=len(known)) > 0 for rows in (np.arange(len(own)), np.flatnonzero(is_lemma))]
        code = (known & 0xFFFFFFFF) - 1
        return known >> 32, [every.take(pa.array(np.maximum(code, 0), mask=code < 0)), *map(pa.array, flags)]

    return _per_block(blocks, lists, work, "form string, is_token boolean, is_lemma boolean")


def _probes(parts: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """dataset, id, part, form, syn: each distinct part as itself and as its synonyms."""
    distinct = parts.select(*KEYS, "part").distinct()
    if synonyms is None:
        return distinct.select(*KEYS, "part", F.col("part").alias("form"), F.lit(False).alias("syn"))
    listed = distinct.join(synonym_lists(synonyms).withColumnRenamed("token", "part"), "part", "left")
    probe = lambda f, syn: F.struct(f.alias("form"), F.lit(syn).alias("syn"))
    probes = F.concat(
        F.array(probe(F.col("part"), False)),
        F.coalesce(F.transform("synonyms", lambda s: probe(s, True)), F.array().cast("array<struct<form:string,syn:boolean>>")),
    )
    return listed.select(*KEYS, "part", F.inline(probes))


def _yes(c: Column) -> Column:
    return F.coalesce(F.max(c), F.lit(False))


def part_levels(parts: DataFrame, index: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """dataset, id, part, l1, l2, l4 for the distinct name parts of each record, from a text index."""
    found = _probes(parts, synonyms).join(index, [*KEYS, "form"], "left")
    own, syn = ~F.col("syn"), F.col("syn")
    return found.groupBy(*KEYS, "part").agg(
        _yes(own & F.col("is_token")).alias("l1"),
        _yes(own & F.col("is_token").isNotNull()).alias("l2"),
        _yes(syn & (F.col("is_token") | F.col("is_lemma"))).alias("l4"),
    )


def words_offering(lexicon: DataFrame) -> DataFrame:
    """form, words: array of (token, is_lemma) that offer a form other than themselves, from ``build_lexicon``."""
    each = lexicon.select("token", F.inline("forms")).where(F.col("token") != F.col("form"))
    return each.groupBy("form").agg(F.collect_list(F.struct("token", "is_lemma")).alias("words"))


def probed_levels(parts: DataFrame, records: DataFrame, lexicon: DataFrame | None = None,
                  synonyms: DataFrame | None = None, col: str = "nlt") -> DataFrame:
    """``part_levels`` without an index: what is asked for is turned into the words that would answer it.

    A text gives its distinct words only, three times fewer rows than its forms, and no word list is joined to them.
    """
    probes = _probes(parts, synonyms)
    itself = F.array(F.struct(F.col("form").alias("token"), F.lit(True).alias("plain")))
    if lexicon is None:
        asked = probes.select(*KEYS, "part", "syn", F.inline(itself))
    else:
        others = F.coalesce(
            F.transform("words", lambda w: F.struct(w["token"].alias("token"), F.when(w["is_lemma"], False).alias("plain"))),
            F.array().cast("array<struct<token:string,plain:boolean>>"),
        )
        listed = probes.join(words_offering(lexicon), "form", "left")
        # plain: true for the word itself, false for a word whose lemma is asked for, null for other inflections
        asked = listed.select(*KEYS, "part", "syn", F.inline(F.concat(itself, others)))
    held = records.select(*KEYS, F.explode(F.array_distinct(lower_words(col))).alias("token")).withColumn("held", F.lit(True))
    found = asked.join(held, [*KEYS, "token"], "left")
    own, syn, there = ~F.col("syn"), F.col("syn"), F.col("held").isNotNull()
    return found.groupBy(*KEYS, "part").agg(
        _yes(own & there & F.coalesce("plain", F.lit(False))).alias("l1"),
        _yes(own & there).alias("l2"),
        _yes(syn & there & F.col("plain").isNotNull()).alias("l4"),
    )


# --- names against the words of their record, many records at a time -------------

#: Bytes of texts and of packed rows that are looked up together; a longer record is looked up alone.
_AT_ONCE = 1 << 24


def _there() -> Column:
    return F.col("dataset").isNotNull() & F.col("id").isNotNull()


def _blocks(*rows: DataFrame) -> DataFrame:
    """All rows, dealt by record over blocks that a task works on as a whole; the number of blocks grows with that of partitions."""
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.withColumn("_block", F.pmod(F.hash(*KEYS), F.lit(2 * n))).repartition(n, "_block")


def _asked_by(blocks: DataFrame, words_of_batch: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """_block, word: the distinct words that the rows of a block ask the word lists for."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[pa.Array]] = {}
        for batch in batches:
            for block in pc.unique(batch.column("_block")).to_pylist():
                own = words_of_batch(batch.filter(pc.equal(batch.column("_block"), block)))
                kept = [*found.pop(block, []), own.unique()]
                if len(kept) == 16:  # what is held stays near the distinct words
                    kept = [pa.concat_arrays(kept).unique()]
                found[block] = kept
        for block, kept in found.items():
            word = pa.concat_arrays(kept).unique().cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block, np.int32)), word], ["_block", "word"])

    return blocks.mapInArrow(distinct, "_block int, word string")


def _per_block(blocks: DataFrame, lists: DataFrame | None, work: Callable, schema: str) -> DataFrame:
    """``work(rows, record, lists)`` on stretches of whole records of every block; ``lists`` holds what the block asked for.

    It gives the record of each of its rows and their columns, which come after the keys.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*KEYS).schema.fields)
    returned = StructType.fromDDL(f"{keys}, {schema}")
    nothing = to_arrow_schema(returned).empty_table()

    def worked(rows: pa.Table, found: pa.Table | None = None) -> pa.Table:
        out = []
        rows = rows.combine_chunks()
        if rows.num_rows:
            rows = rows.to_batches()[0]
            codes = [rows.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEYS]
            _, record = np.unique((codes[0] << 32) + codes[1], return_inverse=True)
            order = np.argsort(record, kind="stable")
            rows, record = rows.take(pa.array(order)), record[order]
            sizes = np.zeros(len(record), np.int64)
            for c in ("text", "pack", "index"):
                if c in rows.schema.names:
                    column = rows.column(c)
                    sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if c == "text" else (
                        16 * pc.fill_null(column.field("n"), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            total = np.cumsum(sizes + 64)
            first = np.append(np.flatnonzero(np.append(True, record[1:] != record[:-1])), len(record))
            at = 0
            while at < len(first) - 1:
                done = total[first[at] - 1] if first[at] else 0
                end = max(at + 1, int(np.searchsorted(total[first[1:] - 1], done + _AT_ONCE, "right")))
                some = rows.slice(first[at], first[end] - first[at])
                own, columns = work(some, record[first[at]:first[end]] - at, found)
                heads = pa.array(first[at:end])
                made = [*(rows.column(c).take(heads).take(pa.array(own)) for c in KEYS), *columns]
                whole = pa.RecordBatch.from_arrays(made, [*KEYS, *names])
                out += [whole.slice(x, 1 << 15) for x in range(0, len(own), 1 << 15)]
                at = end
        return pa.Table.from_batches(out) if out else nothing

    grouped = blocks.groupBy("_block")
    if lists is None:
        return grouped.applyInArrow(lambda rows: worked(rows), returned)
    return grouped.cogroup(lists.groupBy("_block")).applyInArrow(worked, returned)


def _name_rows(elements: DataFrame) -> DataFrame:
    """The names of a record as packs."""
    return packs_of(elements.select(*KEYS, *[F.col(c).cast("string").alias(c) for c in _ELEMENT]), (), _ELEMENT)


def _parts_asked(words: Sequence[str]) -> Callable[[pa.RecordBatch], pa.Array]:
    """What gives the name parts of the packs of a batch."""
    def asked(batch):
        packs = batch.column("pack").filter(pc.is_valid(batch.column("pack").field("n")))
        _, of, held = unpacked(_single(packs), (), words)
        named = np.zeros(len(held), bool)
        named[of["name"][of["name"] >= 0]] = True
        return parts_of(held.filter(pa.array(named)))[0].cast(pa.string())

    return asked


def _single(packs: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(packs) + 1, dtype=np.int32)), packs)


def _word_lists(asked: DataFrame, lexicon: DataFrame | None, synonyms: DataFrame | None) -> DataFrame | None:
    """_block, part, l2, l4: the other words that answer a part that a block asks for, on each level.

    The lists are made once per word and meet the distinct parts of a block, not those of each of its records.
    """
    no, yes = F.lit(False), F.lit(True)
    listed = []
    if lexicon is not None:
        offering = words_offering(lexicon)
        listed.append(offering.select(F.col("form").alias("part"), F.inline("words")).select(
            "part", F.col("token").alias("form"), yes.alias("l2"), no.alias("l4")))
    if synonyms is not None:
        meant = synonym_lists(synonyms).select(F.col("token").alias("part"), F.explode("synonyms").alias("form"))
        listed.append(meant.select("part", "form", no.alias("l2"), yes.alias("l4")))
        if lexicon is not None:
            listed.append(meant.join(offering, "form").select("part", F.inline("words")).where("is_lemma").select(
                "part", F.col("token").alias("form"), no.alias("l2"), yes.alias("l4")))
    every = listed[0]
    for more in listed[1:]:
        every = every.unionByName(more)
    lists = every.groupBy("part").agg(*[F.collect_set(F.when(F.col(c), F.col("form"))).alias(c) for c in ("l2", "l4")])
    return asked.withColumnRenamed("word", "part").join(lists, "part").select("_block", "part", "l2", "l4")


def _coded(*words: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all arrays, and the place of each word among them; -1 for null."""
    every = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
    code = every.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return every.dictionary, np.split(code, np.cumsum([len(w) for w in words])[:-1])


def _runs(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[x] to end[x] - 1 of all x, and x for each."""
    n = end - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def _held(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which wanted keys are among the ascending keys."""
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _levels(names: pa.Array, record: np.ndarray, rows: pa.RecordBatch, row_record: np.ndarray, lists: pa.Table | None) -> dict:
    """l1, l2, l4, matched and sentences of the distinct names of some records.

    ``rows`` hold the texts of the records and perhaps an index of them (packs of forms), which then gives the words.
    """
    parts, of = parts_of(names)
    texts = np.flatnonzero(rows.column("text").is_valid().to_numpy(zero_copy_only=False))
    words, at, number = words_of(rows.column("text").take(pa.array(texts)))
    word_record = row_record[texts][at]
    if "index" in rows.schema.names:
        held_at = np.flatnonzero(rows.column("index").field("n").is_valid().to_numpy(zero_copy_only=False))
        pack, of_form, held = unpacked(_single(rows.column("index").take(pa.array(held_at))), ("flags",), ("form",))
        place = of_form["form"]
        forms = held.take(pa.array(np.maximum(place, 0), mask=place < 0))
        form_record, flags = row_record[held_at][pack], of_form["flags"]
    else:
        forms, form_record, flags = words.slice(0, 0), word_record[:0], word_record[:0]
    none = pa.array([], pa.string())
    list_part, l2, l4 = (none, none, none) if lists is None else (_one(lists.column(c)) for c in ("part", "l2", "l4"))
    answers = {"l2": flat(l2), "l4": flat(l4)} if lists is not None else {"l2": (none, np.zeros(0, int)), "l4": (none, np.zeros(0, int))}
    every, (part, word, form, listed, form_2, form_4) = _coded(parts, words, forms, list_part, answers["l2"][0], answers["l4"][0])
    in_record = lambda rec, code: (rec << 32) | code
    if "index" in rows.schema.names:
        known = form >= 0
        offered = [np.unique(in_record(form_record, form)[known & flag]) for flag in (flags & 1 > 0, flags >= 0, flags & 3 > 0)]
    else:
        offered = [np.unique(in_record(word_record, word))] * 3
    asked, of_part = np.unique(in_record(record[of], part), return_inverse=True)
    hit = {"l1": _held(offered[0], asked), "l2": _held(offered[1], asked), "l4": np.zeros(len(asked), bool)}
    order = np.argsort(listed, kind="stable")
    entry, which = _runs(*(np.searchsorted(listed[order], asked & 0xFFFFFFFF, side) for side in ("left", "right")))
    entry = order[entry]
    for level, code, there in (("l2", form_2, offered[1]), ("l4", form_4, offered[2])):
        of_entry = np.searchsorted(answers[level][1], np.arange(len(listed) + 1))
        answer, asking = _runs(of_entry[entry], of_entry[entry + 1])
        answer, asking = code[answer], which[asking]
        present = np.zeros(len(every) + 1, bool)
        present[there & 0xFFFFFFFF] = True
        kept = present[answer] & (answer >= 0)
        answer, asking = answer[kept], asking[kept]
        answered = _held(there, in_record(asked[asking] >> 32, answer))
        hit[level][asking[answered]] = True
    n = len(names)
    found = {}
    for level in ("l1", "l2", "l4"):
        found[level] = np.zeros(n, bool)
        found[level][of[hit[level][of_part]]] = True
    # the parts found by synonym, in order
    chosen = np.flatnonzero(hit["l4"][of_part])
    coded = parts.take(pa.array(chosen)).cast(pa.string()).dictionary_encode()
    ascending = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    rank = np.argsort(ascending)
    listed_parts = np.unique((of[chosen] << 32) | rank[coded.indices.to_numpy().astype(np.int64)])
    starts = np.searchsorted(listed_parts >> 32, np.arange(n + 1)).astype(np.int32)
    spelled = coded.dictionary.take(pa.array(ascending[listed_parts & 0xFFFFFFFF]))
    found["matched"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), spelled), ",")

    def sentences() -> pa.ListArray:
        """The ascending numbers of the sentences that hold a part of each name."""
        wanted = np.isin(word, part)
        order = np.lexsort((number[wanted], in_record(word_record, word)[wanted]))
        key, sent = in_record(word_record, word)[wanted][order], number[wanted][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sent[1:] != sent[:-1])
        key, sent = key[new], sent[new]
        at, which = _runs(*(np.searchsorted(key, asked[of_part], side) for side in ("left", "right")))
        shown = np.unique((of[which] << 32) | sent[at])
        starts = np.searchsorted(shown >> 32, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array((shown & 0xFFFFFFFF).astype(np.int32)))

    return found | {"sentences": sentences}


class _Named:
    """The packed name rows of some records: their record, their words as codes, and the distinct names."""

    def __init__(self, rows: pa.RecordBatch, record: np.ndarray, words: Sequence[str]):
        packs = rows.column("pack")
        at = np.flatnonzero(packs.field("n").is_valid().to_numpy(zero_copy_only=False))
        pack, of, held = unpacked(_single(packs.take(pa.array(at))), (), words)
        self.record = record[at][pack]
        coded = held.dictionary_encode()
        self.held = coded.dictionary
        codes = np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), -1)
        self.of = {c: codes[of[c]] for c in words}
        key = np.where(self.of["name"] >= 0, (self.record << 32) | self.of["name"], -1)
        known, place = np.unique(np.append(key, -1), return_inverse=True)
        #: the distinct names of the records, and the place of each row's name among them, -1 for null
        self.place = place[:-1] - 1
        self.names, self.name_record = self.held.take(pa.array(known[1:] & 0xFFFFFFFF)), known[1:] >> 32

    def word(self, column: str, rows: np.ndarray) -> pa.Array:
        code = self.of[column][rows]
        return self.held.take(pa.array(np.maximum(code, 0), mask=code < 0))

    def distinct(self, columns: Sequence[str], rows: np.ndarray) -> np.ndarray:
        """One of the given rows for each record and words in ``columns``."""
        keys = [self.record[rows], *(self.of[c][rows] for c in columns)]
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        return rows[order[new]]


def _taken(column: np.ndarray, place: np.ndarray, nothing) -> np.ndarray:
    """The value of each place; ``nothing`` for -1."""
    return np.append(column, nothing)[place]


def _listed(lists: pa.Array, place: np.ndarray) -> pa.Array:
    """The list or text of each place, an empty one for -1."""
    empty = pa.array([[]], lists.type) if pa.types.is_list(lists.type) else pa.array([""], lists.type)
    return pa.concat_arrays([lists, empty]).take(pa.array(np.where(place < 0, len(lists), place)))


_LEVELS = "l1 boolean, l2 boolean, l4 boolean"


def _texts(records: DataFrame | None, col: str, like: DataFrame) -> DataFrame:
    """KEYS, text of the records whose keys are there."""
    if records is None:
        return like.select(*KEYS, F.lit(None).cast("string").alias("text")).where("false")
    return records.where(_there()).select(*KEYS, F.col(col).alias("text"))


def _looked_up(names: DataFrame, work: Callable, schema: str, asked: Callable[[pa.RecordBatch], pa.Array], index: DataFrame | None,
               records: DataFrame | None, col: str, lexicon: DataFrame | None, synonyms: DataFrame | None) -> DataFrame:
    """``work`` on names, texts and perhaps index packs that meet in one exchange by block; ``asked`` gives the parts of names."""
    rows = [names, _texts(records, col, names)]
    if index is not None:
        flags = F.when(F.col("is_token"), 1).otherwise(0) + F.when(F.col("is_lemma"), 2).otherwise(0)
        rows.append(packs_of(index.where(_there()).select(*KEYS, flags.alias("flags"), F.col("form").cast("string").alias("form")), ("flags",), ("form",), "index"))
    blocks = _blocks(*rows)
    lists = None
    if lexicon is not None or synonyms is not None:
        lists = _word_lists(_asked_by(blocks, asked), lexicon, synonyms)
    return _per_block(blocks, lists, work, schema)


def _found(elements: DataFrame, index: DataFrame | None, records: DataFrame | None, col: str, lexicon: DataFrame | None,
           synonyms: DataFrame | None, sentences: bool) -> DataFrame:
    """KEYS, kind, owner, name, l1, l2, l4, matched_tokens, sent_indices of the distinct names."""
    def work(rows, record, lists):
        n = _Named(rows, record, _ELEMENT)
        found = _levels(n.names, n.name_record, rows, record, lists)
        kept = n.distinct(_ELEMENT, np.arange(len(n.record)))
        place = n.place[kept]
        columns = [*(n.word(c, kept) for c in _ELEMENT), *(pa.array(_taken(found[c], place, False)) for c in ("l1", "l2", "l4")), _listed(found["matched"], place)]
        return n.record[kept], columns + ([_listed(found["sentences"](), place)] if sentences else [])

    schema = f"kind string, owner string, name string, {_LEVELS}, matched_tokens string" + (", sent_indices array<int>" if sentences else "")
    return _looked_up(_name_rows(elements), work, schema, _parts_asked(_ELEMENT), index, records, col, lexicon, synonyms)


def match_levels(elements: DataFrame, index: DataFrame | None = None, synonyms: DataFrame | None = None,
                 records: DataFrame | None = None, col: str = "nlt", lexicon: DataFrame | None = None,
                 sentences: bool = True) -> DataFrame:
    """The elements with l1..l4, absent, matched_tokens and, with ``records``, sent_indices.

    ``elements`` holds dataset, id, kind, owner, name. Any part of a name may
    match; a name without letters is absent. With an ``index`` of the texts the
    parts are looked up there; without one, ``records`` and ``lexicon`` are asked
    for just the words that would answer. ``sentences=False`` leaves sent_indices out.
    """
    sentences = sentences and records is not None
    found = _found(elements, index, records if index is None or sentences else None, col, None if index is not None else lexicon, synonyms, sentences)
    out = found.select(
        *KEYS, *_ELEMENT, "l1", "l2", F.col("l1").alias("l3"), "l4", "matched_tokens", *(["sent_indices"] if sentences else []),
    )
    return out.withColumn("absent", ~(F.col("l1") | F.col("l2") | F.col("l3") | F.col("l4")))


def sentence_indices(elements: DataFrame, records: DataFrame, col: str = "nlt") -> DataFrame:
    """The elements with sent_indices, the sorted sentences that hold any part of the name."""
    found = _found(elements, None, records, col, None, None, True)
    return found.select(*KEYS, *_ELEMENT, "sent_indices")


def _endpoint_rows(relationships: DataFrame) -> DataFrame:
    named = F.array(
        F.struct(F.lit("rel_source").alias("kind"), F.col("source").alias("name")),
        F.struct(F.lit("rel_target").alias("kind"), F.col("target").alias("name")),
        F.struct(F.lit("rel_label").alias("kind"), F.col("label").alias("name")),
    )
    rows = relationships.select(*KEYS, F.inline(named)).filter(F.col("name").isNotNull())
    return rows.select(*KEYS, "kind", F.lit(None).cast("string").alias("owner"), "name")


def endpoint_elements(relationships: DataFrame) -> DataFrame:
    """Source, target and label names of relationships as elements (owner null), distinct."""
    return _endpoint_rows(relationships).distinct()


_SHOWN = ["l1", "l2", "l3", "l4", "absent", "sent_indices"]
_ROLES = ("source", "target", "label")


def match_relationships(relationships: DataFrame, index: DataFrame | None, records: DataFrame,
                        synonyms: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """The relationships with source_*, target_*, label_* levels and common_sentences.

    The names of a relationship are looked up where it meets the words of its
    record. A relationship that is there several times comes back as often.
    """
    columns = [c for c in relationships.columns if c not in KEYS]
    rows = relationships.select(*KEYS, F.struct(*columns).alias("pair"))
    shown = ["l1", "l2", "l4", "sent_indices"]

    def names_of(pairs: pa.Array) -> pa.Array:
        return pa.concat_arrays([pairs.field(role).cast(pa.string()) for role in _ROLES])

    def asked(batch):
        pairs = batch.column("pair")
        return parts_of(names_of(pairs.filter(pairs.is_valid())))[0].cast(pa.string())

    def work(rows, record, lists):
        at = np.flatnonzero(rows.column("pair").is_valid().to_numpy(zero_copy_only=False))
        pairs, own = rows.column("pair").take(pa.array(at)), record[at]
        every, (code,) = _coded(names_of(pairs))
        # a record without a key has no words, and its relationships meet no names
        keyed = np.all([rows.column(c).is_valid().to_numpy(zero_copy_only=False)[at] for c in KEYS], axis=0)
        key = np.where((code >= 0) & np.tile(keyed, 3), (np.tile(own, 3) << 32) | code, -1)
        known, place = np.unique(np.append(key, -1), return_inverse=True)
        known, places = known[1:], np.split(place[:-1] - 1, 3)
        found = _levels(every.take(pa.array(known & 0xFFFFFFFF)), known >> 32, rows, record, lists)
        sentences = found["sentences"]()
        columns = [pairs]
        for place in places:
            where = pa.array(np.maximum(place, 0), mask=place < 0)
            columns += [*(pa.array(found[c]).take(where) for c in ("l1", "l2", "l4")), sentences.take(where)]
        return own, columns

    types = "boolean, boolean, boolean, array<int>".split(", ")
    schema = f"pair {rows.schema['pair'].dataType.simpleString()}, " + ", ".join(
        f"{role}_{c} {t}" for role in _ROLES for c, t in zip(shown, types, strict=True))
    found = _looked_up(rows, work, schema, asked, index, records, "nlt", None if index is not None else lexicon, synonyms)

    def role_columns(role: str) -> list[Column]:
        l1, l2, l4, sentences = (F.col(f"{role}_{c}") for c in shown)
        return [x.alias(f"{role}_{c}") for c, x in zip(_SHOWN, (l1, l2, l1, l4, ~(l1 | l2 | l4), sentences), strict=True)]

    out = found.select(
        *[c if c in KEYS else F.col(f"pair.{c}").alias(c) for c in relationships.columns], *[x for role in _ROLES for x in role_columns(role)])
    return out.withColumn(
        "common_sentences", F.sort_array(F.array_intersect("source_sent_indices", "target_sent_indices"))
    )


def match_all(elements: DataFrame, relationships: DataFrame, index: DataFrame | None, records: DataFrame,
              synonyms: DataFrame | None = None, lexicon: DataFrame | None = None, sentences: bool = True) -> DataFrame:
    """One long table over classes, attributes, enum values and relationship ends, in one matching pass."""
    ends = _endpoint_rows(relationships).filter(F.col("kind") != "rel_label")
    names = elements.select(*KEYS, *_ELEMENT).unionByName(ends)
    return match_levels(names, index, synonyms, records, lexicon=lexicon, sentences=sentences)


def per_element_table(elements: DataFrame, relationships: DataFrame, index: DataFrame | None, records: DataFrame,
                      synonyms: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """dataset, id, kind, name, l1..l4, absent, sent_indices (``;``-joined).

    Attributes show as ``Class.attribute``, enum values as ``Enum.value``, each
    relationship as two endpoint rows, the second marked ``(tgt)``. Names get
    their levels, and the text they show by, where they meet the words of their
    record.
    """
    words = (*_ELEMENT, "other", "link")
    none = F.lit(None).cast("string")
    named = elements.select(*KEYS, *[F.col(c).cast("string").alias(c) for c in _ELEMENT], none.alias("other"), none.alias("link"))
    linked = F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("kind").isNotNull()
    ends = relationships.where(linked).select(*KEYS, F.inline(F.array(*[
        F.struct(F.lit(f"rel_{a}").alias("kind"), none.alias("owner"), F.col(a).alias("name"), F.col(b).alias("other"), F.col("kind").alias("link"))
        for a, b in (("source", "target"), ("target", "source"))])))

    def work(rows, record, lists):
        n = _Named(rows, record, words)
        found = _levels(n.names, n.name_record, rows, record, lists)
        sentences, is_end = found["sentences"](), n.of["link"] >= 0
        end = np.flatnonzero(is_end)
        own = n.distinct(_ELEMENT, np.flatnonzero(~is_end))
        kind = n.word("kind", own)
        # names of ends show by their relationships alone
        own = own[pc.fill_null(pc.invert(pc.is_in(kind, pa.array(["rel_source", "rel_target"]))), False).to_numpy(zero_copy_only=False) & (n.of["kind"][own] >= 0)]
        join = lambda *texts: pc.binary_join_element_wise(*texts, "", null_handling="skip")
        owner, name = n.word("owner", own), n.word("name", own)
        dot = pa.array(np.where((n.of["owner"][own] >= 0) & (n.of["name"][own] >= 0), ".", "").tolist(), pa.string())
        is_target = pc.equal(n.word("kind", end), "rel_target")
        name_of, other, link = (n.word(c, end) for c in ("name", "other", "link"))
        show = [join(owner, dot, name), join(
            pc.if_else(is_target, other, name_of), "-(", link, ")->", pc.if_else(is_target, name_of, other), pc.if_else(is_target, " (tgt)", ""))]
        kept = np.append(own, end)
        place = n.place[kept]
        levels = [_taken(found[c], place, False) for c in ("l1", "l2", "l4")]
        listed, show = _listed(sentences, place), pa.concat_arrays(show)
        # different owners and names may show alike; the greatest result stands for all of them
        shown = (n.record[own] << 32) | _coded(show.slice(0, len(own)))[1][0]
        order = np.lexsort((n.of["kind"][own], shown))
        alike = np.flatnonzero((shown[order][1:] == shown[order][:-1]) & (n.of["kind"][own][order][1:] == n.of["kind"][own][order][:-1]))
        take, at = np.arange(len(kept)), 0
        while at < len(alike):
            last = at
            while last + 1 < len(alike) and alike[last + 1] == alike[last] + 1:
                last += 1
            group = order[alike[at]:alike[last] + 2].tolist()
            take[group] = max(group, key=lambda x: (*(bool(c[x]) for c in (levels[0], levels[1], levels[0], levels[2])), not any(c[x] for c in levels), listed[x].as_py()))
            at = last + 1
        kinds = pa.concat_arrays([n.word("kind", own), pa.array(["rel_endpoint"] * len(end), pa.string())])
        return n.record[kept], [kinds, show, *(pa.array(c[take]) for c in levels), listed.take(pa.array(take))]

    names = packs_of(named.unionByName(ends), (), words)
    found = _looked_up(names, work, f"kind string, name string, {_LEVELS}, sent_indices array<int>", _parts_asked(words), index, records, "nlt",
                       None if index is not None else lexicon, synonyms)
    l1, l2, l4 = (F.col(c) for c in ("l1", "l2", "l4"))
    return found.select(
        *KEYS, "kind", "name", "l1", "l2", l1.alias("l3"), "l4", (~(l1 | l2 | l4)).alias("absent"), F.array_join("sent_indices", ";").alias("sent_indices"))


def coverage_summary(matched: DataFrame, records: DataFrame | None = None, rounded: bool = True) -> DataFrame:
    """dataset, id, kind, n, pct_l1..pct_l4, pct_absent; with ``records`` empty kinds show zeros.

    Ends of relationships keep their own figures for source and target.
    """
    levels = ("l1", "l2", "l3", "l4", "absent")

    def pct(c: str) -> Column:
        value = 100 * F.count_if(F.col(c)) / F.count("*")
        return (F.bround(value, 2) if rounded else value).alias(f"pct_{c}")

    summary = matched.groupBy(*KEYS, "kind").agg(F.count("*").alias("n"), *[pct(c) for c in levels])
    if records is None:
        return summary
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = records.select(*KEYS, F.explode(kinds).alias("kind"))
    joined = base.join(summary, [*KEYS, "kind"], "left")
    return joined.select(
        *KEYS, "kind", F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(f"pct_{c}", F.lit(0.0)).alias(f"pct_{c}") for c in levels],
    )


def absent_names(matched: DataFrame) -> DataFrame:
    """name, n of the class names no text holds, most frequent first."""
    absent = matched.filter(F.col("absent") & (F.col("kind") == "class"))
    return absent.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def absent_totals(matched: DataFrame) -> DataFrame:
    """n_total, n_unique of the absent class names, as one row."""
    return absent_names(matched).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count("*").alias("n_unique")
    )


def normalise_names(df: DataFrame, col: str, lemmas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, normalised: lower-case words of the column, lemmatised and joined without blanks."""
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(f"({WORD})"), F.lit(1)), F.lower)
    exploded = df.select(*keys, F.posexplode_outer(words).alias("pos", "token"))
    joined = exploded.join(lemmas.select("token", "lemma"), "token", "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("w"))))
    return joined.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["w"]), "").alias("normalised"))
