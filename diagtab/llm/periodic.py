"""Periodic runs of words, found by catchers over power-of-two blocks, and texts without their repetitions.

A catcher stands on a completed block of 2^k words and waits for squares whose period is 2^k to 2^(k+1) - 1. Each word
that is appended completes one suffix of 2^k words per level; the catcher whose block lies at such a distance compares the
digests. A match is a square's half meeting its copy; matches of neighbouring blocks at one distance merge, and what is
long enough grows word by word to a maximal run. A run of period q and at least 3 * q words holds a whole block of the
level of q and its copy wherever it stands, so none is missed. Words decide: digests only select.

The catchers of one level advance over all appended words at once, level after level from below, for many documents side
by side. What lies in a run that is known already is a repetition of its period (Fine and Wilf) and is not followed again,
so a text that says one word a million times costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least LEAST words and at least EXPONENT periods.
LEAST, EXPONENT = 24, 3
#: Bytes of text that are searched at a time; a longer document is searched alone.
CHUNK = 1 << 21

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Known:
    """Runs found so far, to ask whether one of them covers a stretch of words."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self._index()

    def _index(self) -> None:
        self.runs.sort()
        self.starts = np.array([r[0] for r in self.runs], np.int64)
        self.ends = np.maximum.accumulate(np.array([r[0] + r[1] for r in self.runs], np.int64)) if self.runs else self.starts

    def add(self, runs: list[tuple[int, int, int]]) -> None:
        if runs:
            self.runs += runs
            self._index()

    def cover(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a run that begins at or before `first` reaches `end`."""
        if not self.runs:
            return np.zeros(len(first), bool)
        at = np.searchsorted(self.starts, first, "right") - 1
        return (at >= 0) & (self.ends[np.maximum(at, 0)] >= end)


def _caught(digests: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every suffix that equals the catcher's block: one comparison per appended word."""
    rows = len(digests) // size
    if rows < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grid = digests[:rows * size].reshape(rows, size)
    row, column = np.nonzero(grid[1:] == grid[:-1, :1])
    return row * size, column + size


def _grown(words: np.ndarray, first: int, end: int, period: int, reach: int) -> tuple[int, int] | None:
    """The maximal stretch around [first, end) in which words equal those `period` later; None if it does not hold."""
    if not np.array_equal(words[first:end], words[first + period:end + period]):
        return None
    low = max(0, first - reach)
    differ = np.flatnonzero(words[low:first] != words[low + period:first + period])
    first = low + int(differ[-1]) + 1 if len(differ) else low
    high = min(end + reach, len(words) - period)
    differ = np.flatnonzero(words[end:high] != words[end + period:high + period])
    return first, end + int(differ[0]) if len(differ) else high


def find_runs(words: np.ndarray, before: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period) of documents, sorted; starts count the words of all documents.

    `words` holds one number per word, equal for equal words; document d has those from before[d] to before[d + 1].
    `exponent` must be 3 or more.
    """
    n = np.diff(before)
    # a word of its own behind every document keeps squares from crossing its end
    owner = np.repeat(np.arange(len(n)), n + 1)
    line = np.full(len(owner), -1, np.int64)
    ends = before[1:] + np.arange(len(n))
    inside = np.ones(len(owner), bool)
    inside[ends] = False
    line[inside] = words
    line[ends] = -1 - np.arange(len(n))
    known = Known()
    digests = _mixed(line.astype(_U) + _U(0x9E3779B97F4A7C15))
    size, origin = 1, 0
    place = np.arange(len(line))
    while True:
        # documents too short for a period of this level leave
        stays = n[owner] >= max(least, exponent * size)
        if not stays.all():
            line, digests, owner, place = line[stays], digests[stays], owner[stays], place[stays]
        if not len(line):
            break
        block, period = _caught(digests, size)
        fresh = owner[block] == owner[np.minimum(block + period, len(owner) - 1)]
        block, period = block[fresh], period[fresh]
        fresh = ~known.cover(place[block], place[block] + period + size)
        block, period = block[fresh], period[fresh]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        if len(block):
            head = np.flatnonzero(np.append(True, (np.diff(block) != size) | (np.diff(period) != 0)))
            many = np.diff(np.append(head, len(block)))
            block, period = block[head], period[head]
            # with less than a block at either side
            long = (many + 2) * size - 2 + period >= np.maximum(least, exponent * period)
            found = []
            for b, m, p in zip(block[long].tolist(), many[long].tolist(), period[long].tolist(), strict=True):
                stretch = _grown(line, b, b + m * size, p, size)
                if stretch and stretch[1] - stretch[0] + p >= max(least, exponent * p):
                    found.append((int(place[stretch[0]]), stretch[1] - stretch[0] + p, p))
            known.add(sorted(set(found)))
        # the digest of twice as many words, from those of the two halves
        later = np.append(digests[size:], np.zeros(min(size, len(digests)), _U))
        digests = _mixed(digests * _U(0xC2B2AE3D27D4EB4F) + _mixed(later ^ _U(0x165667B19E3779F9)))
        size *= 2
    shift = np.searchsorted(ends, [r[0] for r in known.runs])
    return sorted((start - int(s), length, p) for (start, length, p), s in zip(known.runs, shift, strict=True))


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about CHUNK bytes."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        if at > first and size + len(text) > CHUNK:
            yield first, at
            first, size = at, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def _collapser(least: int, exponent: int):
    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            column = batch.column("t").cast(pa.large_binary())
            for a, b in _parts([x.as_buffer() if x.is_valid else b"" for x in column]):
                split = [(x.as_py() or b"").split() for x in column[a:b]]
                before = np.cumsum([0, *map(len, split)])
                every = pa.array([w for words in split for w in words], pa.large_binary())
                names = every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs: list[list] = [[] for _ in split]
                for start, length, period in find_runs(names, before, least, exponent):
                    doc = int(np.searchsorted(before, start, "right")) - 1
                    runs[doc].append({"start": start - int(before[doc]), "length": length, "period": period})
                kept = []
                for words, own in zip(split, runs, strict=True):
                    if own:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for r in own:
                            edge[r["start"] + r["period"]] += 1
                            edge[r["start"] + r["length"]] -= 1
                        words = [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([len(s) for s in split], pa.int64()), pa.array(runs, pa.list_(run)),
                     pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "kept"])
    return collapsed


def collapse_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, kept) for every row of `docs`.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least `least` words
    and `exponent` * q words that no neighbouring word extends. `runs` holds (start, length, period), sorted by start,
    then period. `kept` is the text without the words that a run holds after its first q, joined by one space. Words are
    runs of anything but ASCII white space and are compared byte by byte.

    Null, empty and blank texts have no words, no runs and an empty `kept`. Rows are judged alone, so ids may repeat or be
    null; other columns are not read. Nothing is shuffled: a task holds one document, or documents of CHUNK bytes. Empty in,
    empty out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _collapser(least, exponent),
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")
