"""SimHash fingerprints and near-duplicate groups with a pigeonring filter.

Fingerprints of 64 bits are cut into three consecutive segments on a ring. Two that differ in at most 2 bits have a
segment from which every chain of segments keeps within its share of the budget: no difference in the first, at most 1
in the first two, at most 2 in all three (2/3, 4/3 and 2, rounded down). The filter keeps fingerprints that share the
first segment of such a chain and one half of the second with another fingerprint; at most one bit of the second differs, so
one of its halves is equal.

The full Hamming check is a join on middles: two fingerprints within 2 bits have a middle within 1 bit of both, and
fingerprints within 1 bit of the same middle are within 2 bits of each other. A middle has at most 65 of them whatever
the data, so no group grows with its copies and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from diagtab.llm.common import components, written

#: First bit and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: The most bits in which linked fingerprints differ.
BUDGET = 2
SHINGLE = 3
SEED = 42


def fingerprint_of(text: str | None) -> int:
    """SimHash of the 3-word shingles of a text, as a signed 64-bit number; 0 if it has no word.

    ASCII letters are lower-cased; words are runs of non-white-space (ASCII); shingles are space-joined words, repeats
    included, or all words if there are fewer. A bit is 1 if it is 1 in over half of the shingles' XXH64 values.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        values = [hashed(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
        values = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = np.array(values[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints of whole texts."""
    for batch in batches:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def segment(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(value: Column) -> Column:
    """For each chain start and each half of its second segment: (start, half, first segment and half)."""
    keys = []
    for start, own in enumerate(SEGMENTS):
        first, width = SEGMENTS[(start + 1) % 3]
        for half, (at, n) in enumerate(((first, width // 2), (first + width // 2, width - width // 2))):
            both = F.shiftleft(segment(value, *own), 16).bitwiseOR(segment(value, at, n))
            keys.append(F.struct(F.lit(start).alias("start"), F.lit(half).alias("half"), both.alias("key")))
    return F.array(*keys)


def middles(value: Column, start: Column) -> Column:
    """The fingerprint and those one bit away outside the first segment of the chain."""
    every = []
    for number in range(3):
        flips = [b for k in (1, 2) for b in range(SEGMENTS[(number + k) % 3][0], sum(SEGMENTS[(number + k) % 3]))]
        masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) * (b == 63)) for b in flips])
        every.append(F.when(start == number, F.transform(masks, lambda m: value.bitwiseXOR(m))))
    return F.coalesce(*every)


def linked(prints: DataFrame) -> DataFrame:
    """Links between fingerprints of at most 2 differing bits, from distinct (fp, rep): rows (u, v) of reps.

    Every set of fingerprints around one middle gives links to its smallest rep only; that keeps what is connected.
    """
    keyed = prints.select("fp", "rep", F.explode(chain_keys(F.col("fp"))).alias("k")).select("fp", "rep", "k.*")
    shared = written(
        keyed.groupBy("start", "half", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where(F.col("a") != F.col("b")).select("start", "half", "key")
    )
    candidates = written(keyed.join(shared, ["start", "half", "key"]).select("fp", "rep", "start").distinct())
    around = candidates.select("rep", F.explode(middles(F.col("fp"), F.col("start"))).alias("middle")).distinct()
    sets = around.groupBy("middle").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    return sets.select(F.explode("reps").alias("u"), F.array_min("reps").alias("v")).where("u != v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp long, component_id) for every row of `docs`.

    Documents link if their fingerprints differ in at most 2 bits; component_id is the smallest doc_id reachable. Null,
    empty and blank texts have fingerprint 0 and link like any other. Equal fingerprints are one class and are never
    paired; rows with a null id follow their class (null if it has no id). Rows that repeat an id appear as often as they
    are there. Empty in, empty out.
    """
    prints = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(linked(classes.where("rep is not null")))
    named = classes.join(found, F.col("rep") == F.col("id"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(written(named), "fp").select("doc_id", "fp", "component_id")
