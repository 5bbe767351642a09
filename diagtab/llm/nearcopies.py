"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash bands give candidates, the sets themselves decide. A band's bucket is first compared with its pivot, the text that
most others share buckets with: in a group of copies that is the text they were copied from. What the pivot does not
connect is then compared with all of the bucket that it is not connected with, so every pair that shares a bucket is
decided: by a comparison, or because links connect it already. Nothing is left out of large buckets.

Comparisons run in units of at most BLOCK texts on either side. A unit counts shared shingles once for all its pairs and
passes on only links that connect its texts, fewer than it has texts. So no bucket is ever listed in pairs or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from diagtab.llm.common import components, written

#: Words of a shingle, and the least Jaccard similarity of linked texts.
SHINGLE, SIMILARITY = 5, 0.8
#: Texts share a band if its hashes all agree: of pairs with similarity 0.8, all but 0.01 % share one of the bands.
BANDS, ROWS = 24, 5
#: Most texts on either side of a unit, and shingles that are counted at a time.
BLOCK, COLUMNS = 256, 4096
SEED = 42


def _shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words as in simhash.fingerprint_of, all of them if there are fewer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    hashed = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True))
    return np.unique(np.fromiter(hashed, np.uint64, len(starts)))


def _sketcher(size: int):
    @F.pandas_udf(ArrayType(LongType()))
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """A digest of the set of shingles, then the keys of its bands."""
        import xxhash

        drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (4, BANDS * ROWS), np.uint64)
        factors, terms, mixed = drawn[0] | np.uint64(1), drawn[1], (drawn[2] | np.uint64(1)).reshape(BANDS, ROWS)
        number = drawn[3, :BANDS]

        def one(text: str | None) -> list[int]:
            values = _shingles(text, size)
            digest = np.array([xxhash.xxh64_intdigest(values.tobytes(), SEED)], np.uint64)
            if not len(values):
                return digest.view(np.int64).tolist()
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(values), 1 << 12):
                part = values[at:at + (1 << 12), None] * factors + terms
                np.minimum(least, part.min(axis=0), out=least)
            keys = (least.reshape(BANDS, ROWS) * mixed).sum(axis=1, dtype=np.uint64) + number
            return np.concatenate((digest, keys)).view(np.int64).tolist()

        for batch in batches:
            yield pd.Series([one(t) for t in batch])

    return sketch


def _setter(size: int):
    @F.pandas_udf(ArrayType(LongType()))
    def shingle_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_shingles(t, size).view("int64") for t in batch])

    return shingle_set


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `left` shares with each set of `right`; only values on both sides are counted."""
    counts = np.zeros((len(left), len(right)), np.int64)
    sizes = [len(s) for s in (*left, *right)]
    value, row = np.concatenate((*left, *right)), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    heads = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    if not len(heads):
        return counts
    ends = np.append(heads[1:], len(value))
    both = (row[heads] < len(left)) & (row[ends - 1] >= len(left))  # rows of a value are sorted
    kept = np.repeat(both, ends - heads)
    column, row = np.repeat(np.cumsum(both) - 1, ends - heads)[kept], row[kept]
    for first in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        grid = np.zeros((len(sizes), COLUMNS), np.float32)
        grid[row[a:b], column[a:b] - first] = 1
        counts += np.rint(grid[:len(left)] @ grid[len(left):].T).astype(np.int64)
    return counts


def connecting(similar: np.ndarray) -> list[tuple[int, int]]:
    """Links (left, right) that connect what the matrix connects, fewer than it has rows and columns."""
    above = list(range(sum(similar.shape)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for a, b in np.argwhere(similar).tolist():
        u, v = top(a), top(len(similar) + b)
        if u != v:
            above[u] = v
            out.append((a, b))
    return out


def _compared(similarity: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the units of a partition sorted by unit: left texts with right ones of another component."""
        held: pa.Table | None = None

        def links(table: pa.Table) -> tuple[list[int], list[int]]:
            side = table.column("side").to_numpy()
            node, group = table.column("node").to_numpy(), table.column("c").to_numpy()
            flat = table.column("s").combine_chunks()
            offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
            sets = [values[a:b] for a, b in zip(offsets, offsets[1:])]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return [], []
            shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets])
            similar = shared >= similarity * (size[left][:, None] + size[right][None, :] - shared)
            similar &= group[left][:, None] != group[right][None, :]
            found = connecting(similar)
            return [int(node[left[a]]) for a, _ in found], [int(node[right[b]]) for _, b in found]

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            unit = np.stack([table.column(c).to_numpy() for c in ("unit", "x", "y")], axis=1)
            heads = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(axis=1))).tolist() + [len(unit)]
            found = [links(table.slice(a, b - a)) for a, b in zip(heads, heads[1:]) if b - a > 1]
            yield pa.RecordBatch.from_arrays([pa.array([n for f in found for n in f[k]], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            unit = np.stack([table.column(c).to_numpy() for c in ("unit", "x", "y")], axis=1)
            other = np.flatnonzero((unit != unit[-1]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from done(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from done(held)
    return compared


def _linked(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between texts of the units `rows` (unit, x, y, side, node, c): side 0 with side 1 where c differs."""
    full = rows.join(sets, "node").repartition("unit", "x", "y").sortWithinPartitions("unit", "x", "y")
    return written(full.select("unit", "x", "y", "side", "node", "c", "s").mapInArrow(_compared(similarity), "u long, v long"))


def _slots(n: str) -> Column:
    """How many slots `n` texts get: at half load, so that chance puts hardly ever more than BLOCK in one."""
    return F.ceil(F.col(n) / (BLOCK // 2))


def near_copies(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Rows (doc_id, component_id) for every row of `docs`; component_id is the smallest doc_id that links reach.

    Texts link if the Jaccard similarity of their shingle sets is at least `similarity`, counted exactly, and they share
    a band. Words are told apart without ASCII case. Texts without a word, null ones too, are one group. Ids may be of any
    type with an order; rows that repeat an id appear as often as they are there. Empty in, empty out.
    """
    drawn = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("s", _sketcher(size)(F.col("text")))
    rows = written(drawn.select("doc_id", F.xxhash64("text").alias("hash"), F.get("s", F.lit(0)).alias("node"), "s"))
    classes = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"), F.first("s").alias("s")))
    keyed = classes.select(F.explode(F.slice("s", 2, BANDS)).alias("key"), "node")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = written(keyed.join(shared, "key"))
    wanted = classes.select("node", "hash").join(met.select("node").distinct(), "node", "left_semi")
    # one text for each class that shares a band
    plain = docs.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull()).withColumn("hash", F.xxhash64("text"))
    texts = plain.join(wanted, "hash").dropDuplicates(["node"])
    sets = written(texts.select("node", _setter(size)("text").alias("s")))

    # every text with the pivot of its bucket
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = written(met.join(weights, "node"))
    pivots = written(weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot")))
    pairs = written(weighed.join(pivots, "key").where("node != pivot").select("pivot", "node").distinct())
    counted = pairs.groupBy("pivot").agg(F.count("*").alias("n"))
    tasks = written(pairs.join(counted, "pivot").select(F.col("pivot").alias("unit"), F.pmod(F.xxhash64("node"), _slots("n")).alias("x"), "node"))
    sides = tasks.select("unit", "x", F.lit(1).alias("side"), "node").union(
        tasks.select("unit", "x", F.lit(0).alias("side"), F.col("unit").alias("node")).distinct())
    links = _linked(sides.withColumns({"y": F.lit(0).cast("long"), "c": F.col("node")}), sets, similarity)

    # buckets in which the pivot does not connect all: what is not connected with it, with all that it is not connected with
    found = components(links)
    placed = written(met.select("key", "node").join(found, met.node == found.id, "left").select(
        "key", "node", F.coalesce("component", "node").alias("c")))
    home = placed.join(pivots, (placed.key == pivots.key) & (placed.node == pivots.pivot)).select(placed.key, F.col("c").alias("home"))
    rest = written(placed.join(written(home), "key").withColumn("away", F.col("c") != F.col("home")))
    several = written(rest.groupBy("key").agg(F.count_if("away").alias("n_away"), F.count("*").alias("n")).where("n_away > 0"))
    dealt = rest.join(several, "key").select("key", "node", "c", "away", _slots("n_away").alias("nx"), _slots("n").alias("ny"))
    own, every = lambda n: F.pmod(F.xxhash64("node"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = dealt.where("away").select(F.col("key").alias("unit"), own("nx").alias("x"), every("ny").alias("y"), F.lit(0).alias("side"), "node", "c")
    right = dealt.select(F.col("key").alias("unit"), every("nx").alias("x"), own("ny").alias("y"), F.lit(1).alias("side"), "node", "c")
    more = _linked(written(left.union(right)), sets, similarity)
    found = components(links.union(more))

    named = classes.join(found, F.col("node") == F.col("id"), "left").select("node", "doc_id", F.coalesce("component", "node").alias("c"))
    named = written(named)
    low = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "node").join(written(named.select("node", "c").join(low, "c")), "node").select("doc_id", "component_id")
