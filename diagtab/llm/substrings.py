"""Removal of repeated passages by recompression.

A document is a sequence of word names. Each round names maximal runs of one symbol, then pairs of neighbours whose
first symbol is on the left and whose second is on the right side of an alphabet split that the round fixes. A name is a
64-bit digest of what it stands for, so all executors give equal runs and pairs the same name and a round needs no
shuffle and no table of names.

Equal passages get equal symbols except near their borders: a round can change only the run and the half pair at either
end. Dropping those, a function of the passage alone, leaves the same interior wherever the passage stands. Of the
chains of neighbouring top symbols inside a window of 50 words, the one with the least digest is its anchor. So equal
windows have equal anchors, and a window can repeat only if its anchor does. Windows that follow each other and share
their anchor are a block.

Spark then groups blocks by anchor: anchors of one document go. Blocks that equal a block of an earlier document are
repeats as a whole. For the rest, one document per distinct block verifies its single windows.

Names and anchors only select. What equals what is decided on the words themselves: blocks and single windows are equal if
the BLAKE2b digests (128 bits) of their words, joined by one space, are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diagtab.llm.common import written

#: Words of a window.
WINDOW = 50
#: Rounds of recompression, and top symbols of an anchor.
ROUNDS, CHAIN = 3, 4
#: Bytes of text that are parsed at a time; a longer document is parsed alone.
CHUNK = 1 << 21

_U = np.uint64
_K1, _K2, _K3, _BYTE, _WORD1 = (_U(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def words_of(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all documents, and the number of words before each document and at the end.

    `data` holds the UTF-8 bytes of the documents, document d from offsets[d] to offsets[d + 1].
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ~blank[inner]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, _U), before
    spans = np.diff(np.append(starts, len(data)))
    # white space counts 0, other bytes by their place in the word
    value = np.where(blank, 0, data.astype(np.uint16) + 1).astype(_U)[starts[0]:]
    place = np.arange(len(value)) - np.repeat(starts - starts[0], spans)
    table = powers(_BYTE + _U(2 * seed), int(spans.max()))
    return mixed(np.add.reduceat(value * table[place], starts - starts[0]) + _U(seed)), before


class Sequence:
    """Prefix sums by which a digest of any stretch of word names is found at once; it selects, and decides nothing."""

    def __init__(self, names: np.ndarray, base: np.uint64):
        n = len(names) + 1
        inverse = _U(pow(int(base), -1, 1 << 64))
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(names * powers(base, n)[:-1], dtype=_U)))
        self.back = powers(inverse, n)

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U) * _K3)


class Spelled:
    """The words of one text, joined by one space, to digest any stretch of them."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.ends, self.starts = ends, np.concatenate(([0], ends[:-1] + 1))

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits of every stretch of words first to end - 1, as two numbers."""
        joined, made = memoryview(self.joined), hashlib.blake2b
        found = [made(joined[a:b], digest_size=16).digest() for a, b in zip(self.starts[first].tolist(), self.ends[end - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def interiors(names: np.ndarray, before: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The top symbols, and for windows beginning at `starts` the first and the end of their interior among them."""
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    symbols, first, end = names, starts.copy(), starts + WINDOW
    for number in range(ROUNDS):
        # runs: the first and the last run of an interior may go on outside of it
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        length = np.diff(np.append(heads, len(symbols)))
        empty = first >= end
        last = np.maximum(end - 1, 0)
        first, end = run[np.minimum(first, len(symbols) - 1)] + 1, run[last]
        symbols, owner = symbols[heads], owner[heads]
        symbols = np.where(length > 1, mixed(symbols * _K3 + length.astype(_U)), symbols)
        # pairs: a right symbol at the front, a left symbol at the end may belong to a pair that reaches outside
        right = (symbols >> _U(number + 7)) & _U(1) == 1
        pair = np.zeros(len(symbols), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (owner[:-1] == owner[1:])
        second = np.zeros(len(symbols), bool)
        second[1:] = pair[:-1]
        place = np.append(np.cumsum(~second) - 1, len(symbols) - int(second.sum()))
        empty |= first >= end
        low = np.minimum(first, len(symbols) - 1)
        first = np.where(right[low], low + 1, low)
        high = np.maximum(end, 1)
        end = np.where(right[high - 1], high, high - 1)
        first, end = place[first], place[end]
        end = np.where(empty, first, end)
        joined = symbols.copy()
        joined[:-1][pair[:-1]] = mixed(symbols[:-1][pair[:-1]] * _K1 + mixed(symbols[1:][pair[:-1]] ^ _K2))
        symbols, owner = joined[~second], owner[~second]
    return symbols, first, end


def anchors(names: np.ndarray, before: np.ndarray, starts: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor, and a place that equals that of the window before it if they share the anchor.

    A window whose interior has fewer than CHAIN top symbols (long runs) is its own anchor.
    """
    symbols, first, end = interiors(names, before, starts)
    chain = np.zeros(len(symbols), _U)
    usable = max(0, len(symbols) - CHAIN + 1)
    for k in range(CHAIN):
        chain[:usable] = mixed(chain[:usable] * _K1 + symbols[k:k + usable])
    size = end - first - CHAIN + 1
    good = size > 0
    low, size = first[good], size[good]
    least = [np.arange(len(symbols))]
    while (1 << len(least)) <= (int(size.max()) if len(size) else 0):
        half = 1 << (len(least) - 1)
        a = least[-1]
        b = np.append(a[half:], np.full(min(half, len(a)), len(a) - 1))
        least.append(np.where(chain[b] < chain[a], b, a))
    table = np.stack(least)
    level = np.frexp(size.astype(np.float64))[1] - 1
    a, b = table[level, low], table[level, low + size - (1 << level)]
    at = np.where(chain[b] < chain[a], b, a)
    anchor, place = digests.copy(), -1 - np.arange(len(starts))
    anchor[good], place[good] = chain[at], at
    return anchor, place


def blocks(names: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor) of every block of all documents."""
    count = np.maximum(np.diff(before) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(doc):
        return doc, doc, doc, np.zeros(0, _U)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(before[:-1], count)
    sequence = Sequence(names, _WORD1)
    windows = sequence.digest(starts, starts + WINDOW)
    anchor, place = anchors(names, before, starts, windows)
    new = np.ones(len(doc), bool)
    # neighbours that share the chain, or are the same window (inside a run), are one block
    new[1:] = (doc[1:] != doc[:-1]) | ((place[1:] != place[:-1]) & (windows[1:] != windows[:-1]))
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(doc)))
    start = starts[head]
    return doc[head], start - before[doc[head]], n, anchor[head]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of rows of about CHUNK bytes: (first row, end row, bytes, offsets)."""
    text = batch.column("t").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        end = min(end, len(text))
        yield row, end, whole[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents (doc, row, t): (anchor, b1, b2, doc, row, at, n)."""
    for batch in batches:
        for row, end, data, offsets in _parts(batch):
            doc, at, n, anchor = blocks(*words_of(data, offsets, 0))
            ids = batch.slice(row, end - row).select(["doc", "row"]).take(pa.array(doc))
            digests = [np.zeros((0, 2), np.int64)]
            whole, first = data.tobytes(), np.searchsorted(doc, np.arange(end - row + 1))
            for number in np.flatnonzero(np.diff(first)).tolist():
                own = slice(first[number], first[number + 1])
                words = whole[offsets[number]:offsets[number + 1]].split()
                digests.append(Spelled(words).digests(at[own], at[own] + n[own] + WINDOW - 1))
            block = np.concatenate(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(block[:, 0]), pa.array(block[:, 1]), *ids.columns,
                 pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "b1", "b2", "doc", "row", "at", "n"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the texts, so that joins shuffle less."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("t").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("row"),
             pa.array([None if not x.is_valid else press.compress(x.as_buffer()) for x in texts], pa.binary())],
            ["doc", "row", "packed"])


def _unpacked(data: bytes | None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the windows that `firsts` and `counts` name: (w1, w2, doc, row, at)."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = _unpacked(batch.column("packed")[i].as_py()).split()
            firsts, counts = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("firsts", "counts"))
            at = np.unique(np.repeat(firsts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            found = Spelled(words).digests(at, at + WINDOW).T
            same = [pa.array(np.full(len(at), batch.column(c)[i].as_py())).cast(batch.column(c).type) for c in ("doc", "row")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.copy()) for x in found), *same, pa.array(at.astype(np.int32))], ["w1", "w2", "doc", "row", "at"])


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n_words, n_removed, kept): the words outside the stretches `starts` to `ends`, joined by one space."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = _unpacked(batch.column("packed")[i].as_py()).split()
            n_words.append(len(words))
            starts, ends = batch.column("starts")[i].as_py(), batch.column("ends")[i].as_py()
            if starts:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.array(ends), -1)
                stays = np.cumsum(edge[:-1]) == 0
                words = [word for word, stay in zip(words, stays.tolist(), strict=True) if stay]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept) for every row of `docs`: texts without the passages that repeat.

    A word goes if a window of 50 words that covers it has the same words as a window of a document with a smaller
    doc_id; windows are those of the input, not of what is left. `kept` is the remaining words joined by one space. Null
    and empty texts have no words and `kept` is empty; documents under 50 words lose nothing. Rows with a null id are
    neither compared nor changed. Rows that repeat an id are each compared with smaller ids only. Empty in, empty out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("t"))
    found = written(texts.where("doc is not null and t is not null").mapInArrow(
        parsed, "anchor long, b1 long, b2 long, doc long, row long, at int, n int"))
    shared = written(
        found.groupBy("anchor").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("doc", "b1", "b2") for f in (F.min, F.max)])
        .where("doc_min < doc_max").select("anchor", ((F.col("b1_min") != F.col("b1_max")) | (F.col("b2_min") != F.col("b2_max"))).alias("several"))
    )
    hits = written(found.join(shared, "anchor"))
    firsts = written(hits.groupBy("anchor", "b1", "b2").agg(F.min("doc").alias("first")))
    judged = written(hits.join(firsts, ["anchor", "b1", "b2"]).where("doc > first or several").select(
        "doc", "row", "at", "n", (F.col("doc") > F.col("first")).alias("whole")))
    repeats = judged.where("whole").select("doc", "row", F.col("at").alias("start"), (F.col("at") + F.col("n") + WINDOW - 1).alias("end"))
    pack = "doc long, row long, packed binary"
    unsure = judged.where("not whole").groupBy("doc", "row").agg(
        F.collect_list(F.struct("at", "n")).alias("b")).select("doc", "row", F.col("b.at").alias("firsts"), F.col("b.n").alias("counts"))
    compared = texts.where("doc is not null and t is not null").mapInArrow(packed, pack).dropDuplicates(["doc", "row"])
    windows = written(compared.join(unsure, ["doc", "row"]).mapInArrow(single_windows, "w1 long, w2 long, doc long, row long, at int"))
    lows = written(windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"))
    later = windows.join(lows, ["w1", "w2"]).where("doc > first").select(
        "doc", "row", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end"))
    gone = written(repeats.union(later)).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("g"))
    gone = gone.select("doc", "row", F.col("g.start").alias("starts"), F.col("g.end").alias("ends"))
    return texts.mapInArrow(packed, pack).join(gone, ["doc", "row"], "left").mapInArrow(
        cleaned, "doc_id long, n_words long, n_removed long, kept string")
