"""Language identification by bit-sliced Bloom filters over byte n-grams.

All languages share one array of buckets. A bucket holds one bit per language; an n-gram of a language sets the
language's bit in its buckets. The AND of an n-gram's buckets is the set of all languages that contain it, so one lookup
asks all filters at once. Per language the set bits of a text's n-grams are counted and the expected number of false
positives is taken off; the largest count decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from diagtab.llm.common import written

#: Bytes of an n-gram, taken from lower-cased text whose ASCII non-letters are spaces.
GRAM = 4
#: Documents per language that a model learns from, at most about so many.
SAMPLE = 3000
#: N-grams per language in the filter, the most frequent ones, and parts in which they are ranked first.
PROFILE, PARTS = 40000, 32
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any language.
RATIO = 0.3
#: Buckets as a power of two, and buckets per n-gram.
BITS, HASHES = 20, 2
#: Bytes looked up at a time.
CHUNK = 1 << 21

_FACTORS = (2654435761, 2246822519, 3266489917, 668265263)
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def padded(text: Column) -> Column:
    """A text in lower case between blanks, so that a single letter has an n-gram."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" " * (GRAM - 2)))


@dataclass
class Model:
    """Languages in order of their bit, the buckets (one byte column per eight languages), false positive rates."""

    languages: list[str]
    buckets: np.ndarray
    false_rate: np.ndarray


def grams(data: np.ndarray) -> np.ndarray:
    """The n-grams at every place of the bytes, as numbers; those that begin with two spaces or are blank are 0."""
    plain = _PLAIN[data].astype(np.uint32)
    n = max(0, len(plain) - GRAM + 1)
    out = np.zeros(n, np.uint32)
    for k in range(GRAM):
        out |= plain[k:k + n] << np.uint32(8 * k)
    out[(plain[:n] == 32) & (plain[1:n + 1] == 32)] = 0
    return out


def places(keys: np.ndarray, number: int) -> np.ndarray:
    """Bucket of every n-gram under one of the hash functions."""
    return ((keys ^ (keys >> np.uint32(15))) * np.uint32(_FACTORS[number])) >> np.uint32(32 - BITS)


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = batch.column("t").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    return np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch."""
    for batch in batches:
        data, offsets = _bytes(batch)
        names = batch.column("lang").to_pylist()
        for lang in sorted(set(names)):
            parts = [grams(data[offsets[i]:offsets[i + 1]]) for i, name in enumerate(names) if name == lang]
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            keep = keys != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * int(keep.sum()), pa.string()), pa.array(keys[keep].astype(np.int64)),
                 pa.array(n[keep].astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns the filters from rows with a text and a language.

    Of each language about `sample` documents are used, picked by a digest of the id; that bounds what is grouped and
    what the driver gets: at most PROFILE n-grams per language. No labelled rows: a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), padded(F.col(text_col)).alias("t"), F.col(lang_col).alias("lang")).where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    buckets = np.zeros((1 << BITS, max(1, math.ceil(len(languages) / 8))), np.uint8)
    if not languages:
        return Model([], buckets, np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    counted = rows.where(at < share[F.col("lang")]).select("t", "lang").mapInArrow(_counted, "lang string, gram long, n long")
    counts = written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, 1.0 / max(1, totals.get(lang, 1)))])
    shares = counts.where("n > 1").withColumn("share", F.col("n") * part[F.col("lang")])
    each = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("l"))
    held = each.select("gram", "most", F.explode("l").alias("l")).where(F.col("l.share") >= RATIO * F.col("most"))
    # all languages at once: ranked in shares first, so that no window holds all n-grams of a language
    best = [F.desc("share"), "gram"]
    shares = held.select(F.col("l.lang").alias("lang"), F.col("l.share").alias("share"), "gram").withColumn("part", F.pmod("gram", F.lit(PARTS)))
    shares = shares.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("at") <= PROFILE)
    top = shares.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("at") <= PROFILE)
    profiles = top.select("lang", "gram").toPandas().groupby("lang")["gram"]
    for number, lang in enumerate(languages):
        keys = (profiles.get_group(lang).to_numpy() if lang in profiles.groups else np.zeros(0)).astype(np.int64).astype(np.uint32)
        for k in range(HASHES):
            buckets[places(keys, k), number // 8] |= np.uint8(1 << (number % 8))
    bits = np.unpackbits(buckets, axis=1, bitorder="little")[:, :len(languages)]
    return Model(languages, buckets, bits.mean(axis=0) ** HASHES)


def _hits(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of n-grams looked up, and of those found per language."""
    docs, langs = len(offsets) - 1, len(model.languages)
    total, found = np.zeros(docs, np.int64), np.zeros((docs, langs), np.int64)
    ends = np.maximum(offsets[1:] - GRAM + 1, offsets[:-1])  # n-grams do not reach into the next text
    first, last = int(offsets[0]), int(offsets[-1])
    for begin in range(first, last, CHUNK):
        stop = min(begin + CHUNK, last)
        keys = grams(data[begin:min(stop + GRAM - 1, last)])[:stop - begin]
        masks = model.buckets[places(keys, 0)]
        for k in range(1, HASHES):
            masks = masks & model.buckets[places(keys, k)]
        known = keys != 0
        masks[~known] = 0
        a = int(np.searchsorted(offsets, begin, "right")) - 1
        b = int(np.searchsorted(offsets, stop, "left"))
        low = np.clip(offsets[a:b] - begin, 0, len(keys))
        high = np.maximum(np.clip(ends[a:b] - begin, 0, len(keys)), low)

        def per_text(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[high] - sums[low]

        total[a:b] += per_text(known)
        for n in range(langs):
            found[a:b, n] += per_text((masks[:, n // 8] >> np.uint8(n % 8)) & np.uint8(1))
    return total, found


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            names: tuple[str, str, str] = ("lang_pred", "score", "coverage"), n_grams: str | None = None) -> DataFrame:
    """Adds the predicted language, a score and a coverage (both 0 to 1) to every row, under `names`,
    and the number of n-grams that were looked up under `n_grams` if given.

    score is the winner's share of all languages' corrected counts, coverage the share of n-grams that the winner
    contains. Null texts and texts without a letter are `und` with score and coverage 0; so is every text if the model
    knows no language. Ties go to the first language by name. Input columns of the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets, whatever the data
    added = [*names, n_grams] if n_grams else list(names)
    kept = [f for f in docs.schema.fields if f.name not in added]
    counts = [StructField(n, LongType()) for n in added[3:]]
    schema = StructType([*kept, StructField(names[0], StringType()), *(StructField(n, DoubleType()) for n in names[1:]), *counts])
    columns = [f.name for f in kept]
    lowered = F.when(F.col(text_col).rlike(r"\p{L}"), padded(F.col(text_col)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n = batch.num_rows
            plain = pa.RecordBatch.from_arrays([batch.column("__t")], ["t"])
            lang, score, coverage = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            total = np.zeros(n, np.int64)
            letters = ~np.array(batch.column("__t").is_null())
            if known.languages and n:
                total, found = _hits(known, *_bytes(plain))
                real = np.clip((found - total[:, None] * known.false_rate) / (1 - known.false_rate + 1e-9), 0, None)
                best = np.where(real.sum(axis=1) > 0, real.argmax(axis=1), found.argmax(axis=1))
                top = real[np.arange(n), best]
                lang = np.where(letters, np.array(known.languages, object)[best], "und")
                score = np.where(letters, top / np.maximum(real.sum(axis=1), 1e-9), 0.0)
                coverage = np.where(letters, np.clip(top / np.maximum(total, 1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(coverage),
                 *([pa.array(total)] if n_grams else [])],
                [*columns, *added])

    return docs.select(*columns, lowered.alias("__t")).mapInArrow(judged, schema)
