"""Collocations: frequent phrases whose parts stand together more often than chance, per language.

Every stretch of one to five words is hashed by Rabin-Karp fingerprints: prefix polynomials of the words' values modulo the
prime 2^61 - 1, from which numpy takes the fingerprint of any stretch at once. The texts are read in passes.

1. All words and pairs are counted by fingerprint, then triples of frequent pairs. A phrase can be frequent only if all its
   words, pairs and triples are, so what reaches the threshold is noted in a bitmap of bounded size, which goes to all workers.
2. Stretches of which every triple is noted are grouped per chunk of text, compared word by word within a fingerprint, and
   aggregated as (fingerprint, count, pointer to a text that holds it, check value). Sums below the threshold go, and the
   pointers of the others are resolved: only frequent phrases ever become text. Where check values differ, fingerprints
   collide: those stretches are read again and counted by the phrase in the text.

Fingerprints and bitmap can only let too much through. Check values are 64 bits of the words themselves, so phrases of one
language would have to agree in 125 bits to be taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diagtab.llm.common import written

#: Least occurrences of a phrase, its most words, and the phrases kept per language.
LEAST, LONGEST, KEEP = 100, 5, 2000
#: Bytes of text that are hashed at a time; a longer document is hashed alone.
CHUNK = 1 << 22
#: Most entries that a task of the first pass adds up before it passes them on.
HELD = 1 << 21
#: Bits of the bitmap per noted fingerprint, and its least and greatest size as powers of two: 16 MB at most.
BITS_EACH, BITMAP = 64, (15, 27)
#: Bytes of text per range of fingerprints in which entries of the second pass are packed, and the least number of ranges.
BUCKET, LEAST_BUCKETS = 1 << 23, 64
#: Shares into which the phrases of a language are dealt before they are ranked.
SHARES = 64

_U = np.uint64
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
BASE = 0x1B873593CC9E2D51 % PRIME

#: Bytes of words, blanks between words, marks between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it; 2^62 is 2 and 2^61 is 1."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a0 * b0)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) and often more; kept per worker."""
    known = _POWERS.get(base, np.ones(1, _U))
    while len(known) < n:
        known = np.concatenate((known, times(known, np.full(1, pow(base, len(known), PRIME), _U))))
    if len(known) <= 1 << 22:
        _POWERS[base] = known
    return known


class Prefix:
    """Prefix polynomials of word values: fingerprints of stretches by place and length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        terms = times(values, powers(BASE, n)[:n])
        high, low = np.cumsum(terms >> _U(31), dtype=_U), np.cumsum(terms & _LOW31, dtype=_U)
        sums = reduced(times(reduced(high), np.full(1, 1 << 31, _U)) + reduced(low))
        self.sums = np.concatenate((np.zeros(1, _U), sums))
        self.back = powers(pow(BASE, -1, PRIME), n + 1)

    def fingerprints(self, at: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
        found = times(reduced(self.sums[at + n] + _P - self.sums[at]), self.back[at])
        return reduced(found + reduced(salt + _U(n * 0x9E3779B97F4A7C15 % PRIME)))


def value_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42) % PRIME


def check_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 43)


class Words:
    """The words of a chunk of documents: numbers and values, place in the document, document, language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray):
        kind = _KIND[data]
        word = kind == 0
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[inner] = word[inner]
        starts = np.flatnonzero(begins)
        self.n = len(starts)
        sizes = np.add.reduceat(word, starts, dtype=np.int64) if self.n else np.zeros(0, np.int64)
        flat = pa.py_buffer(_LOWER[data[word]].tobytes())
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tobytes())
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, ends, flat]).dictionary_encode()
        self.words = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.values = np.array([value_of(w) for w in self.words.to_pylist()], _U)[self.ids] if self.n else np.zeros(0, _U)
        first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.at = np.arange(self.n) - first[self.doc]
        self.lang, self.salt = langs[self.doc], salts[self.doc]
        piece = np.cumsum(kind == 2)[starts]
        self.joined = np.zeros(self.n, bool)  # the next word stands in the same piece
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.prefix = Prefix(self.values)
        self.second: np.ndarray | None = None

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.prefix.fingerprints(at, n, self.salt[at])

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """A second value of stretches, from their words and independent of the fingerprint."""
        if self.second is None:
            self.second = np.array([check_of(w) for w in self.words.to_pylist()], _U)
        found = self.salt[at]
        for k in range(n):
            found = (found ^ self.second[self.ids[at + k]]) * _U(0x9E3779B97F4A7C15)
            found ^= found >> _U(29)
        return found

    def phrases(self, at: np.ndarray, n: int) -> list[str]:
        parts = [self.words.take(pa.array(self.ids[at + k])).to_pylist() for k in range(n)]
        return [b" ".join(p).decode() for p in zip(*parts, strict=True)] if n else [""] * len(at)

    def grouped(self, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(fingerprint, count, first place) of the distinct stretches of n words at `at`, compared word by word."""
        prints = self.fingerprints(at, n)
        while len(at):
            order = np.argsort(prints, kind="stable")
            at, prints = at[order], prints[order]
            heads = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
            head = at[np.repeat(heads, np.diff(np.append(heads, len(at))))]
            same = self.lang[at] == self.lang[head]
            for k in range(n):
                same &= self.ids[at + k] == self.ids[head + k]
            yield prints[heads], np.add.reduceat(same, heads, dtype=np.int64), at[heads]
            at, prints = at[~same], prints[~same]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, end row, words, language of each row) of stretches of about CHUNK bytes."""
    text = batch.column("t").fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    coded = batch.column("lang").dictionary_encode()
    langs = coded.indices.to_numpy(zero_copy_only=False)
    salts = np.array([value_of(b"language " + x.encode()) for x in coded.dictionary.to_pylist()], _U)[langs]
    row = 0
    while row < len(text):
        end = min(len(text), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1))
        yield row, end, Words(whole[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row], langs[row:end], salts[row:end]), langs[row:end]
        row = end


def _added(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(prints)
    order = np.argsort(every)
    every = every[order]
    heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[heads], np.add.reduceat(np.concatenate(counts)[order], heads) if len(heads) else np.zeros(0, np.int64)


def _counted(noted=None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First pass: (fp, c) of words and pairs, or of triples of noted pairs, added up as far as memory allows."""
        prints, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, words, _ in _chunks(batch):
                every = np.arange(words.n)
                if noted is None:
                    found = np.concatenate((words.fingerprints(every, 1), words.fingerprints(every[words.joined], 2)))
                else:
                    pair = words.joined.copy()
                    pair[pair] = _may(noted.value, words.fingerprints(every[pair], 2))
                    found = words.fingerprints(_triples(pair), 3)
                prints, counts = _added([prints, found], [counts, np.ones(len(found), np.int64)])
                if len(prints) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts)], ["fp", "c"])
                    prints, counts = prints[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts)], ["fp", "c"])
    return counted


def _may(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bit = prints & _U(len(bitmap) * 8 - 1)
    return (bitmap[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1 == 1


def _stretches(words: Words, bitmap: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of stretches of n words of which every word, pair and triple is noted, for n from 1."""
    every = np.arange(words.n)
    frequent = _may(bitmap, words.fingerprints(every, 1))
    pair = np.zeros(words.n, bool)
    both = every[:-1][words.joined[:-1] & frequent[:-1] & frequent[1:]]
    pair[both] = _may(bitmap, words.fingerprints(both, 2))
    at = every[frequent]
    yield 1, at
    yield 2, every[pair]
    triple = np.zeros(words.n, bool)
    at = _triples(pair) if longest > 2 else every[:0]
    triple[at[_may(bitmap, words.fingerprints(at, 3))]] = True
    at = every[triple]
    for n in range(3, longest + 1):
        at = at[at + n - 3 < words.n]
        at = at[triple[at + n - 3]]
        yield n, at


def _triples(pair: np.ndarray) -> np.ndarray:
    """Places at which two noted pairs overlap."""
    return np.flatnonzero(pair[:-1] & pair[1:])


#: An entry of the second pass: fingerprint, count, key of a text, check value.
_ENTRY = np.dtype([("fp", "<u8"), ("c", "<i8"), ("k", "<i8"), ("f2", "<u8")])


def _phrases(noted, longest: int, buckets: int):
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Second pass: (bucket, entries) of stretches that may be frequent; the salt of a language stands for all its words.

        The entries of a chunk are packed by ranges of fingerprints, which keeps a shuffled row from being larger than its entry.
        """
        for batch in batches:
            keys = batch.column("k").to_numpy()
            for row, _, words, _ in _chunks(batch):
                if not words.n:
                    continue
                _, first, counts = np.unique(words.lang, return_index=True, return_counts=True)
                found = [(0, words.salt[first], counts.astype(np.int64), first)]
                found += [(n, *group) for n, at in _stretches(words, noted.value, longest) for group in words.grouped(at, n)]
                entries = np.zeros(sum(len(at) for *_, at in found), _ENTRY)
                done = 0
                for n, prints, c, at in found:
                    part = entries[done:done + len(at)]
                    part["fp"], part["c"], part["k"], part["f2"] = prints, c, keys[words.doc[at] + row], words.checks(at, n)
                    done += len(at)
                entries = entries[np.argsort(entries["fp"], kind="stable")]
                bucket = (entries["fp"] // _U(PRIME // buckets + 1)).astype(np.int64)
                heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
                data = [entries[i:j].tobytes() for i, j in zip(heads, [*heads[1:], len(entries)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array(data, pa.binary())], ["bucket", "entries"])
    return phrases


def _merged(least: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, c, k, low, high) of the entries of each bucket that reach the threshold; rows come sorted by bucket."""
        now, held = None, []

        def total() -> pa.RecordBatch:
            every = np.concatenate([np.frombuffer(data, _ENTRY) for data in held])
            every = every[np.argsort(every["fp"], kind="stable")]
            heads = np.flatnonzero(np.append(True, every["fp"][1:] != every["fp"][:-1]))
            c = np.add.reduceat(every["c"], heads)
            kept = c >= least
            columns = [every["fp"][heads].view(np.int64), c, np.minimum.reduceat(every["k"], heads),
                       np.minimum.reduceat(every["f2"], heads).view(np.int64), np.maximum.reduceat(every["f2"], heads).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in columns], ["fp", "c", "k", "low", "high"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if bucket != now and held:
                    yield total()
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield total()
    return merged


def _spelled(noted, colliding, longest: int):
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, lang, phrase, n, c) of stretches whose fingerprint may be one of those that collide."""
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        for batch in batches:
            for row, _, words, _ in _chunks(batch):
                for n, at in _stretches(words, noted.value, longest):
                    at = at[_may(colliding.value, words.fingerprints(at, n))]
                    for prints, c, places in words.grouped(at, n):
                        langs = batch.column("lang").take(pa.array(words.doc[places] + row))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(prints.view(np.int64), kinds[0]), langs, pa.array(words.phrases(places, n), kinds[2]),
                             pa.array(np.full(len(places), n, np.int32)), pa.array(c)], ["fp", "lang", "phrase", "n", "c"])
    return spelled


def _resolver(longest: int):
    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The phrases of the fingerprints that point to a text: (fp, lang, phrase, n)."""
        for batch in batches:
            pointers = batch.column("prints")
            for row, end, words, _ in _chunks(batch):
                own = pointers.slice(row, end - row)
                offsets = own.offsets.to_numpy()
                wanted = own.values.to_numpy()[offsets[0]:offsets[-1]].view(_U)
                doc = np.repeat(np.arange(end - row), np.diff(offsets))
                pairs = set(zip(doc.tolist(), wanted.tolist(), strict=True))
                every, out = np.sort(wanted), []
                at = np.arange(words.n)
                for n in range(longest + 1):
                    if n > 1:
                        at = at[words.joined[at + n - 2]]
                    prints = words.fingerprints(at, n) if n else words.salt
                    spot = np.minimum(np.searchsorted(every, prints), max(0, len(every) - 1))
                    hits = np.flatnonzero(every[spot] == prints) if len(every) else np.zeros(0, np.int64)
                    _, first = np.unique(np.stack((words.doc[at[hits]].astype(_U), prints[hits])), axis=1, return_index=True)
                    hits = hits[first]
                    kept = [h for h in hits.tolist() if (int(words.doc[at[h]]), int(prints[h])) in pairs]
                    places = at[kept]
                    langs = [batch.column("lang")[row + int(d)].as_py() for d in words.doc[places]]
                    out += zip(prints[kept].view(np.int64).tolist(), langs, words.phrases(places, n), [n] * len(kept), strict=True)
                kinds = {"fp": pa.int64(), "lang": pa.string(), "phrase": pa.string(), "n": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))
    return resolved


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The fingerprints of `frequent` (fp) as bits; built by Spark in pieces of 4 KB, of bounded size in all."""
    low, high = BITMAP
    power = min(high, max(low, (BITS_EACH * frequent.count()).bit_length()))
    bit = F.col("fp").bitwiseAND(F.lit((1 << power) - 1))
    pieces = frequent.groupBy(F.shiftright(bit, 15).alias("piece")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(1 << (power - 3), np.uint8)
    for piece, bits in pieces.collect():
        out[piece << 12:(piece + 1) << 12] = np.frombuffer(bits, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """Rows (lang, phrase, n, f): phrases of n <= `longest` words with f >= `least` occurrences, words space-joined.

    The row of n = 0 and an empty phrase holds all words of a language, if they are `least` or more.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("t")).where("t is not null")
    texts = texts.select(F.xxhash64("id", "t").alias("k"), "lang", "t")
    enough = F.col("c") >= least
    reached = lambda rows: written(rows.groupBy("fp").agg(F.sum("c").alias("c")).where(enough).select("fp"))
    pairs = reached(texts.mapInArrow(_counted(), "fp long, c long"))
    if longest > 2:
        triples = reached(texts.mapInArrow(_counted(spark.sparkContext.broadcast(_bitmap(pairs))), "fp long, c long"))
        pairs = pairs.union(triples)
    noted = spark.sparkContext.broadcast(_bitmap(pairs))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET)
    found = texts.mapInArrow(_phrases(noted, longest, buckets), "bucket long, entries binary")
    dealt = found.repartition("bucket").sortWithinPartitions("bucket")
    frequent = written(dealt.mapInArrow(_merged(least), "fp long, c long, k long, low long, high long"))
    single, several = frequent.where("low = high"), frequent.where("low != high").select("fp")
    pointers = written(single.groupBy("k").agg(F.collect_list("fp").alias("prints")))
    # rows that repeat an id and a text resolve the same pointers
    named = written(texts.join(pointers, "k").mapInArrow(_resolver(longest), "fp long, lang string, phrase string, n int")).dropDuplicates(["fp"])
    known = named.join(single.select("fp", "c"), "fp").select("lang", "phrase", "n", F.col("c").alias("f"))
    if several.limit(1).count():
        colliding = spark.sparkContext.broadcast(_bitmap(several))
        read = texts.mapInArrow(_spelled(noted, colliding, longest), "fp long, lang string, phrase string, n int, c long")
        counted = written(read.join(several, "fp", "left_semi").groupBy("lang", "phrase", "n").agg(F.sum("c").alias("f")))
        known = known.union(counted.where(F.col("f") >= least).select("lang", "phrase", "n", "f"))
    return written(known)


#: floor(1000 * a * n / (l * r)) in whole numbers of 38 digits.
SCORE = """(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0)))
  div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"""


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, id_col: str = "doc_id",
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first `keep` collocations.

    Texts lose the case of A-Z, are cut into pieces at `.,;:!?` and line breaks (bytes 10 to 13), and pieces into words at
    spaces and tabs. Candidates are phrases of 2 to `longest` words that occur a >= `least` times within pieces, overlaps
    included. A cut after the first words gives l and r, the occurrences of both parts, and floor(1000 * a * n / (l * r)) with
    all n words of the language; the cut with the lowest score counts, of equal ones the first. A candidate within a longer
    one that occurs as often goes: the longer one never occurs more often, and if it is longer by several words, a candidate
    between them occurs as often too, so neighbours in length decide. Order: score and a descending, phrase ascending by
    bytes.

    A null language is `und`; null and empty texts have no words. Rows count one by one, repeated ones too; ids may repeat or
    be null. `longest` is at least 2. Empty in, empty out.
    """
    known = frequent_phrases(docs, least, longest, id_col, text_col, lang_col)
    words = F.split("phrase", " ")
    candidates = known.where("n >= 2").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    cuts = candidates.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("w", F.lit(1), F.col("cut")), " "),
                             "right": F.array_join(F.slice("w", F.col("cut") + 1, F.col("size")), " ")}).drop("w")
    parts = known.where("n >= 1")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(known.where("n = 0").select("lang", F.col("f").alias("n")), "lang")
    scored = cuts.select("lang", "phrase", "size", "a", "n", "cut", "l", "r", F.expr(SCORE).alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.*")
    longer = candidates.where("size >= 3").withColumn("w", words)
    inside = longer.select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    left = lowest.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = left.withColumn("at", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("at") <= keep)
    ranked = written(first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
