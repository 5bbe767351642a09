"""The extraction rules on the sentence trees of many records at once.

Tokens are flat arrays, children are ranges of one list sorted by head, and a rule is a few lookups and joins over them.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

from ..functions.lexicons import (
    AGGREGATION_PREPOSITIONS,
    AGGREGATION_VERBS,
    ASSOCIATION_VERBS,
    COMPOSITION_VERBS,
    GENERALIZATION_RESERVED,
)
from .packs import NULL, unpacked

# the rules travel with the job, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

NUMBERS = ("sent_i", "i", "head_i", "flags")
WORDS = ("text", "name_lower", "lemma", "pos", "tag", "dep")
#: What ``flags`` says of a token: it may name a class, it is listed as a child of its head.
CANDIDATE, KID = 1, 2
VERBS = {"association": ASSOCIATION_VERBS, "aggregation": AGGREGATION_VERBS, "composition": COMPOSITION_VERBS}


def places_of(sentence: np.ndarray, i: np.ndarray, head: np.ndarray, kid: np.ndarray) -> tuple[np.ndarray, ...]:
    """The numbers of tokens and heads, each once a sentence, as places: those of the tokens, those of their heads, the last
    token at each place (-1: none), the children in order of their heads' places, and the sorted places themselves."""
    base, n = (sentence << 33) + (1 << 32), len(i)
    places, place = np.unique(np.concatenate([base + i, base + head]), return_inverse=True)
    own = np.full(len(places), -1)
    own[place[:n]] = np.arange(n)  # of tokens with one number the last
    kids = np.flatnonzero(kid)
    kids = kids[np.argsort(place[n:][kids], kind="stable")]
    return place[:n], place[n:], own, kids, places


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[x] to end[x] - 1 of all x, and x for each."""
    n = end - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which], which


class _Trees:
    """The tokens of some records in order of sentence, number and words."""

    def __init__(self, packs: pa.Array):
        record, of, held = unpacked(packs, NUMBERS, WORDS)
        coded = held.cast(pa.string()).dictionary_encode()
        self.words = coded.dictionary
        #: the place of each word among the sorted distinct words, which stands for it; -1 for null
        ascending = pc.array_sort_indices(self.words).to_numpy().astype(np.int64)
        self.words = self.words.take(pa.array(ascending))
        code = np.append(np.argsort(ascending)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)], -1)
        columns = {c: of[c] for c in NUMBERS} | {c: code[of[c]] for c in WORDS}
        order = np.lexsort((columns["i"], columns["sent_i"], record))
        key = np.stack([record, columns["sent_i"], columns["i"]])[:, order]
        if np.any(np.all(key[:, 1:] == key[:, :-1], axis=0)):  # tokens that share a number are in order of their words
            candidate, kid = columns["flags"] & CANDIDATE, columns["flags"] & KID
            order = np.lexsort((kid, columns["head_i"], candidate, *(columns[c] for c in WORDS[::-1]), columns["i"], columns["sent_i"], record))
        self.record = record[order]
        self.sent_i, self.i, self.head, flags = (columns[c][order] for c in NUMBERS)
        self.text, self.name, self.lemma, self.pos, self.tag, self.dep = (columns[c][order] for c in WORDS)
        self.candidate = flags & CANDIDATE > 0
        new = np.ones(len(order), bool)
        new[1:] = (self.record[1:] != self.record[:-1]) | (self.sent_i[1:] != self.sent_i[:-1])
        self.sentence = np.cumsum(new) - 1
        self.place, head, self.own, self.kids, places = places_of(self.sentence, self.i, self.head, flags & KID > 0)
        self.start = np.searchsorted(head[self.kids], np.arange(len(places) + 1))
        self.nodes = self.own[self.own >= 0]  # the token of each place, in order
        self.is_verb, self.is_noun = self.one_of(self.pos, "VERB"), self.one_of(self.pos, "NOUN", "PROPN")
        self.is_class = self.candidate | self._class_words()

    def code(self, word: str) -> int:
        """The code of a word, -2 if no token has it."""
        at = pc.index(self.words, word).as_py()
        return -2 if at < 0 else at

    def one_of(self, codes: np.ndarray, *words: str) -> np.ndarray:
        return np.isin(codes, [self.code(w) for w in words])

    def children(self, tokens: np.ndarray, *deps: str) -> tuple[np.ndarray, np.ndarray]:
        """The children of the named kinds of some tokens, and for each which token it belongs to, in order."""
        at = self.place[tokens]
        kid, which = _ranges(self.start[at], self.start[at + 1])
        kid = self.kids[kid]
        chosen = self.one_of(self.dep[kid], *deps) if deps else np.ones(len(kid), bool)
        return kid[chosen], which[chosen]

    def classes(self, tokens: np.ndarray, *deps: str) -> tuple[np.ndarray, np.ndarray]:
        kid, which = self.children(tokens, *deps)
        return kid[self.is_class[kid]], which[self.is_class[kid]]

    def with_conjuncts(self, tokens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Role tokens and their ``conj`` children (one level), which share the role."""
        also, of = self.classes(tokens, "conj")
        return np.append(tokens, also), np.append(which, which[of])

    def _class_words(self) -> np.ndarray:
        """Tokens named like a candidate of their record or like what its verbs promote (see ``promote_svo``)."""
        named = self.nodes[self.candidate[self.nodes]]
        verbs = self.nodes[self.is_verb[self.nodes]]
        lasts = []
        for dep in ("nsubj", "dobj"):
            kid, which = self.children(verbs, dep)
            fresh = self.is_noun[kid] & ~self.candidate[kid]
            last = np.full(len(verbs), -1)
            last[which[fresh]] = kid[fresh]  # of several the last stays
            lasts.append(last)
        both = np.flatnonzero((lasts[0] >= 0) & (lasts[1] >= 0))
        both = both[(self.name[lasts[0][both]] >= 0) & (self.name[lasts[1][both]] >= 0)] if len(both) else both
        named = np.concatenate([named, lasts[0][both], lasts[1][both]])
        key = (self.record << 32) + self.name
        return np.isin(key, key[named]) & (self.name >= 0)

    def names(self, tokens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each group its distinct texts and their greatest tags; a name that is ever plural stays plural."""
        order = np.lexsort((self.tag[tokens], self.text[tokens], which))
        text, group, tag = self.text[tokens][order], which[order], self.tag[tokens][order]
        last = np.ones(len(order), bool)
        last[:-1] = (text[1:] != text[:-1]) | (group[1:] != group[:-1])
        return group[last], text[last], tag[last]


def _joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with equal keys; the right keys are ascending."""
    at, which = _ranges(np.searchsorted(right, left), np.searchsorted(right, left, "right"))
    return which, at


def _verb_rule(t: _Trees, rule: str) -> dict:
    """Subjects of each listed verb with its objects, and with those of its conjoined listed verbs.

    Subjects, direct objects and objects of accepted prepositions come with their conjuncts. Composition runs from object to
    subject.
    """
    listed = t.is_verb & t.one_of(t.lemma, *VERBS[rule])
    verbs = t.nodes[listed[t.nodes]]
    subject_of, subject, subject_tag = t.names(*t.with_conjuncts(*t.classes(verbs, "nsubj")))
    joint, of = t.children(verbs, "conj")
    acting, act_of = np.append(verbs, joint[listed[joint]]), np.append(np.arange(len(verbs)), of[listed[joint]])
    prep, prep_of = t.children(acting, "prep")
    accepted = t.one_of(t.pos[prep], "ADP")
    if rule == "aggregation":
        wanted = np.full(len(t.words) + 2, -3)  # the preposition that each lemma accepts
        for lemma, word in AGGREGATION_PREPOSITIONS.items():
            if t.code(lemma) >= 0:
                wanted[t.code(lemma)] = t.code(word)
        accepted &= (t.name[prep] == wanted[t.lemma[acting[prep_of]]]) & (t.name[prep] >= 0)
    elif rule == "composition":
        accepted[:] = False
    prep, prep_of = prep[accepted], prep_of[accepted]
    indirect, of = t.classes(prep, "pobj")
    objects = [t.with_conjuncts(*t.classes(acting, "dobj")), t.with_conjuncts(indirect, prep_of[of])]
    object_of, object_, object_tag = t.names(*map(np.concatenate, zip(*objects, strict=True)))
    last = np.full(len(acting), -1)
    last[prep_of] = prep
    s, act = _joined(subject_of, np.sort(act_of, kind="stable"))
    act = np.argsort(act_of, kind="stable")[act]
    row, o = _joined(act, object_of)
    s, act = s[row], act[row]
    by, with_ = (t.text, t.text) if rule == "association" else (t.lemma, t.name)
    found = {"token": verbs[act_of[act]], "label": (by[acting[act]], np.append(with_, -1)[np.where(last[act] < 0, len(with_), last[act])])}
    ends = [(subject[s], subject_tag[s]), (object_[o], object_tag[o])]
    found["source"], found["target"] = ends[::-1] if rule == "composition" else ends
    return found


def _include_rule(t: _Trees) -> dict:
    """``X includes Y``: first subject, direct objects with conjuncts, never itself; runs object to subject."""
    verbs = t.nodes[(t.is_verb & t.one_of(t.lemma, "include"))[t.nodes]]
    subject = _first(*t.classes(verbs, "nsubj"), len(verbs))
    of, object_, tag = t.names(*t.with_conjuncts(*t.classes(verbs, "dobj")))
    kept = subject[of] >= 0
    kept[kept] = t.text[subject[of[kept]]] != object_[kept]
    of = of[kept]
    return {"token": verbs[of], "source": (object_[kept], tag[kept]), "target": (t.text[subject[of]], t.tag[subject[of]])}


def _first(tokens: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """The first token of each of n groups, -1 where there is none."""
    found = np.full(n, -1)
    found[which[::-1]] = tokens[::-1]
    return found


def _generalization_rule(t: _Trees) -> dict:
    """``A is a B`` by the first copula; ``A maybe B`` in a sentence without one.

    An auxiliary *can* or a child *maybe* turns the direction round.
    """
    usable = t.is_class & ~t.one_of(t.name, *GENERALIZATION_RESERVED)
    n = int(t.sentence[-1]) + 1 if len(t.sentence) else 0
    node_sentence = t.sentence[t.nodes]

    def firsts(chosen: np.ndarray) -> np.ndarray:
        return _first(t.nodes[chosen], node_sentence[chosen], n)

    copula, cue = firsts(t.one_of(t.lemma, "be")[t.nodes]), firsts(t.one_of(t.name, "maybe")[t.nodes])
    be = copula[copula >= 0]

    def usable_kid(tokens: np.ndarray, *deps: str) -> np.ndarray:
        kid, which = t.children(tokens, *deps)
        return _first(kid[usable[kid]], which[usable[kid]], len(tokens))

    kid, which = t.children(be)
    turns = t.one_of(t.name[kid], "maybe") | (t.one_of(t.lemma[kid], "can") & t.one_of(t.dep[kid], "aux"))
    turned = np.bincount(which[turns], minlength=len(be)) > 0
    prep, prep_of = t.children(be, "prep")
    is_of = t.one_of(t.name[prep], "of")
    prep, prep_of = prep[is_of], prep_of[is_of]
    inner, of = t.children(prep, "pobj")
    behind = _first(inner[usable[inner]], prep_of[of[usable[inner]]], len(be))
    object_ = usable_kid(be, "attr", "acomp")
    object_ = np.where(object_ >= 0, object_, behind)
    subject = usable_kid(be, "nsubj")

    # around the cue: the last usable token before it, the first behind it
    alone = (copula < 0) & (cue >= 0)
    fit = usable[t.nodes] & alone[node_sentence] & (t.i[t.nodes] != NULL)
    token, sentence = t.nodes[fit], node_sentence[fit]
    side = t.i[token] - t.i[cue[sentence]]
    before, after = _first(token[side < 0][::-1], sentence[side < 0][::-1], n), _first(token[side > 0], sentence[side > 0], n)
    subject, object_ = np.append(subject, before[alone]), np.append(object_, after[alone])
    turned, token = np.append(turned, np.ones(alone.sum(), bool)), np.append(be, cue[alone])
    both = np.flatnonzero((subject >= 0) & (object_ >= 0))
    s, o = t.text[subject[both]], t.text[object_[both]]
    return {"token": token[both], "source": (np.where(turned[both], o, s), None), "target": (np.where(turned[both], s, o), None)}


def relations(packs: pa.Array, rules: Sequence[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """What the rules find in the packed tokens of some records: the record of each relation, and its columns."""
    t = _Trees(packs)
    plural = np.append(t.one_of(np.arange(len(t.words)), "NNS", "NNPS"), False)
    spelled = lambda code: t.words.take(pa.array(np.maximum(code, 0), mask=code < 0))
    records, parts = [], []
    for rule in rules:
        found = _include_rule(t) if rule == "include" else _generalization_rule(t) if rule == "generalization" else _verb_rule(t, rule)
        token = found["token"]
        n = len(token)
        none = pa.nulls(n, pa.string())
        if "label" in found:
            label = pc.binary_join_element_wise(*map(spelled, found["label"]), " ", null_handling="skip")
        else:
            label = pa.array(["include"] * n, pa.string()) if rule == "include" else none
        cards = [none if tag is None else pa.array(np.where(plural[tag], "1..*", "1").astype(object), pa.string())
                 for _, tag in (found["source"], found["target"])]
        sent_i = t.sent_i[token]
        records.append(t.record[token])
        parts.append([pa.array(sent_i.astype(np.int32), mask=sent_i == NULL), pa.array([rule] * n, pa.string()), spelled(found["source"][0]),
                      label.cast(pa.string()), spelled(found["target"][0]), *cards])
    columns = ["sent_i", "rule", "source", "label", "target", "source_card", "target_card"]
    return np.concatenate(records), dict(zip(columns, map(pa.concat_arrays, zip(*parts, strict=True)), strict=True))
