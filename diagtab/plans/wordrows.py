"""Rows that the stand-in views make of words, for many texts at a time.

Spark brings the texts; inside a task the words of a stretch of texts are one
flat array of places in a list of distinct words, and numpy works out the rows.
The definitions are those of ``fixtures`` and of the SQL in ``checks/oracle.py``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

from ..functions.scan import words_of

# the row makers travel with the job, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

# Verb lemmas, prepositions and entity labels of the clause grammar.
VERB_LEMMAS = ("take", "send", "include", "consist", "belong", "have", "contain", "be")
PREPOSITIONS = ("of", "to", "in", "with")
ENTITY_LABELS = ("ORG", "PERSON", "GPE")

TOKEN_COLUMNS = {"sent_i": "int", "i": "int", "text": "string", "lemma": "string", "pos": "string", "tag": "string", "dep": "string", "head_i": "int"}
_DEPS = ("nsubj", "conj", "dobj", "conj", "prep", "pobj", "dep", "ROOT", "attr")
_TAGS = ("NN", "NNS", "VB", "IN")
_POS = ("NOUN", "VERB", "ADP")
#: Characters of the texts that are worked on together; a longer text is worked on alone.
_AT_ONCE = 1 << 20


def _stretches(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text or "") > _AT_ONCE:
            yield start, at
            start, held = at, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _strings(words: Sequence[str], place: np.ndarray) -> pa.Array:
    return pa.array(words, pa.string()).take(pa.array(place))


def _coded(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words and the place of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _clauses(texts: Sequence[str | None]) -> dict[str, np.ndarray | list[str]]:
    """The words of all sentences of some texts, with their role in the clause grammar."""
    words, text, number = words_of(pa.array(texts, pa.string()), lower=False)
    known, code = _coded(words)
    known = [w.lower() for w in known]
    length = np.array([len(w) for w in known], np.int64)
    plural = np.array([w.endswith("s") for w in known], bool)
    new = np.ones(len(code), bool)  # begins a sentence
    new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(code)))
    first = np.repeat(begins, sizes)
    r, n = np.arange(len(code)) - first, np.repeat(sizes, sizes)
    j = r % 6
    v = r - j + 1
    no_verb = v >= n  # only the last word of a sentence can have none
    verb = code[np.minimum(first + v, max(0, len(code) - 1))] if len(code) else code
    return {
        "text": text, "sent_i": number, "i": r, "j": j, "v": v,
        "no_verb": (j == 0) & no_verb, "verb_lemma": (length[verb] + v) % len(VERB_LEMMAS) if len(code) else code, "code": code,
        "known": known, "length": length, "plural": plural}


def _forms(c: dict, lemma: bool) -> tuple[list[str], np.ndarray]:
    """Words and the place of every token's text or lemma among them."""
    m = len(c["known"])
    place = c["code"]
    if lemma:
        place = np.where(c["plural"][place], place + m, place)
        place = np.where(c["j"] == 1, 2 * m + len(PREPOSITIONS) + c["verb_lemma"], place)
    place = np.where(c["j"] == 4, 2 * m + c["length"][c["code"]] % len(PREPOSITIONS), place)
    return [*c["known"], *(w[:-1] for w in c["known"]), *PREPOSITIONS, *VERB_LEMMAS], place


def _dep(c: dict) -> np.ndarray:
    """Places in _DEPS."""
    j = c["j"]
    dep = np.where(c["no_verb"], 6, j)
    dep = np.where((j == 1) & (c["i"] == 1), 7, dep)
    return np.where((j == 2) & (c["verb_lemma"] == len(VERB_LEMMAS) - 1), 8, dep)


def _heads(c: dict) -> np.ndarray:
    i, j, v = c["i"], c["j"], c["v"]
    head = np.where(j % 2 == 0, v, i - 1)
    head = np.where(j == 1, np.where(i == 1, i, v - 6), head)
    return np.where(c["no_verb"], np.where(v < 6, i, v - 6), head)


def _token_column(c: dict, name: str) -> pa.Array:
    if name in ("sent_i", "i"):
        return pa.array(c[name].astype(np.int32))
    if name == "head_i":
        return pa.array(_heads(c).astype(np.int32))
    if name in ("text", "lemma"):
        return _strings(*_forms(c, name == "lemma"))
    if name == "dep":
        return _strings(_DEPS, _dep(c))
    verb, prep = c["j"] == 1, c["j"] == 4
    if name == "pos":
        return _strings(_POS, np.where(verb, 1, np.where(prep, 2, 0)))
    return _strings(_TAGS, np.where(verb, 2, np.where(prep, 3, c["plural"][c["code"]].astype(np.int64))))


def _rows(make: Callable[[Sequence], tuple[np.ndarray, dict[str, pa.Array]]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``make(texts)`` gives the place of each row's text and its columns; the keys are put before them."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for start, end in _stretches([x if x is None or isinstance(x, str) else "".join(x) for x in texts]):
            at, columns = make(texts[start:end])
            if len(at):
                keys = [batch.column(k).take(pa.array(at + start)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, *columns.values()], ["dataset", "id", *columns])


def tokens(columns: Sequence[str]):
    """Batches of dataset, id, text to token rows with the named columns."""
    def make(texts):
        c = _clauses(texts)
        return c["text"], {name: _token_column(c, name) for name in columns}

    return lambda batches: _rows(make, batches)


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of text to the distinct lower-case words of each batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([words_of(batch.column(0))[0].unique().cast(pa.string())], ["token"])


def entities():
    """Batches of dataset, id, text to a label per noun whose lemma has eight letters or more."""
    def make(texts):
        c = _clauses(texts)
        size = c["length"][c["code"]] - c["plural"][c["code"]]
        at = np.flatnonzero((c["j"] != 1) & (c["j"] != 4) & (size >= 8))
        return c["text"][at], {"label": _strings(ENTITY_LABELS, size[at] % len(ENTITY_LABELS))}

    return lambda batches: _rows(make, batches)


def chunks():
    """Batches of dataset, id, text to a noun chunk per subject, object and prepositional object."""
    wanted = np.isin(_DEPS, ("nsubj", "dobj", "pobj"))

    def make(texts):
        c = _clauses(texts)
        at = np.flatnonzero(wanted[_dep(c)]) if len(c["code"]) else c["code"]
        known, place = _forms(c, False)
        int32 = lambda name: pa.array(c[name][at].astype(np.int32))
        return c["text"][at], {"sent_i": int32("sent_i"), "root_i": int32("i"), "text": _strings(known, place[at])}

    return lambda batches: _rows(make, batches)


def _names(records: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The camel-joined word pairs of each text: place of its record, number in its text, how many there are, distinct names, places."""
    record = np.repeat(np.arange(len(records)), [len(texts) for texts in records]).astype(np.int64)
    words, text, _ = words_of(pa.array([x for texts in records for x in texts], pa.string()), lower=False)
    long = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) >= 3)
    text = text[long]
    found = np.bincount(text, minlength=len(record))
    paired = np.arange(len(text)) - np.repeat(np.cumsum(found) - found, found) < np.repeat(found // 2 * 2, found)
    known, code = _coded(words.take(pa.array(long[paired])))
    sizes = found // 2
    known = pa.array([w[0].upper() + w[1:] for w in known], pa.string())
    pairs, place = np.unique((code[::2] << 32) | code[1::2], return_inverse=True)
    names = pc.binary_join_element_wise(known.take(pa.array(pairs >> 32)), known.take(pa.array(pairs & 0xFFFFFFFF)), "").dictionary_encode()
    place = names.indices.to_numpy().astype(np.int64)[place]  # words that differ only in the first letter give one name
    number = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(record, sizes), number, np.repeat(sizes, sizes), names.dictionary.to_pylist(), place


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of one row of each kind."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return np.sort(order[new])


def elements():
    """Batches of dataset, id, texts to classes, attributes and enum values in turn, each once a record."""
    def make(records):
        record, number, _, known, name = _names(records)
        turn = number % 3
        owner = name[np.arange(len(name)) - turn]
        owner = np.where(turn == 0, -1, np.where(turn == 1, owner, owner + len(known)))
        at = _distinct(name, owner, turn, record)
        place = owner[at]
        owners = pa.array([*known, *(w + "Kind" for w in known)], pa.string()).take(pa.array(place, mask=place < 0))
        kinds = ("class", "attribute", "enum_value")
        return record[at], {"kind": _strings(kinds, turn[at]), "owner": owners, "name": _strings(known, name[at])}

    return lambda batches: _rows(make, batches)


def relationships():
    """Batches of dataset, id, texts to links of each class with the next one of its text, each once a record."""
    def make(records):
        record, number, size, known, name = _names(records)
        source = np.flatnonzero((number % 3 == 0) & (number + 3 < size))
        length = np.array([len(w) for w in known], np.int64)
        a, b, label = name[source], name[source + 3], name[source - number[source]]
        at = _distinct(a, b, label, record[source])
        kinds = ("association", "composition")
        return record[source][at], {
            "source": _strings(known, a[at]), "target": _strings(known, b[at]), "kind": _strings(kinds, length[b[at]] % 2), "label": _strings(known, label[at])}

    return lambda batches: _rows(make, batches)
