"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length 1; cosine 0.95 is then a distance of 0.316. A table hashes a vector to the whole numbers
below several random Gaussian projections in units of BUCKET; close vectors share a bucket in one of the tables. All
pairs of a bucket are checked exactly, in blocks of bounded size.

With the defaults a pair at cosine 0.95 exactly is found with probability 0.97, at 0.97 with 0.998. Vectors and
projections are rounded to whole multiples of small powers of two before they are multiplied, so that sums are exact and
a vector has the same buckets wherever it is hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diagtab.llm.common import components, written

#: Least cosine of a link.
COSINE = 0.95
#: Tables, projections per table, width of a bucket.
TABLES, PROJECTIONS, BUCKET = 48, 8, 0.9
#: Most rows of a block; larger buckets are cut into blocks, which are paired.
BLOCK = 1024
_FINE, _COARSE = 2.0 ** 20, 2.0 ** 10


_MADE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and shifts for vectors of a length; made once per worker."""
    if size not in _MADE:
        rng = np.random.default_rng(20240229)
        axes = np.rint(rng.normal(size=(size, TABLES * PROJECTIONS)) * _COARSE)
        _MADE[size] = axes, np.rint(rng.uniform(0, BUCKET, TABLES * PROJECTIONS) * _FINE * _COARSE)
    return _MADE[size]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def buckets(rows: np.ndarray) -> np.ndarray:
    """Bucket numbers (vector, table) of rows of length 1."""
    axes, shift = _projections(rows.shape[1])
    cells = np.floor((np.rint(rows * _FINE) @ axes + shift) / (BUCKET * _FINE * _COARSE)).astype(np.int64)
    cells = cells.reshape(len(rows), TABLES, PROJECTIONS).astype(np.uint64)
    out = np.zeros((len(rows), TABLES), np.uint64)
    for k in range(PROJECTIONS):
        out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch; all have one length and no null (see `_usable`)."""
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.astype(np.float64).reshape(len(column), -1))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket of every class in every table: (t, bucket, rep, size)."""
    for batch in batches:
        for size in sorted(set(batch.column("size").to_pylist())):
            part = batch.filter(pa.array(np.array(batch.column("size")) == size))
            keys = buckets(_matrix(part.column("v")))
            n = len(keys)
            number = pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n))
            reps = pa.array(np.repeat(part.column("rep").to_numpy(), TABLES))
            yield pa.RecordBatch.from_arrays(
                [number, pa.array(keys.ravel()), reps, pa.array(np.full(n * TABLES, size, np.int32))], ["t", "bucket", "rep", "size"])


def _block(t: int, same: bool, reps: np.ndarray, copies: np.ndarray, side: np.ndarray, vectors: np.ndarray) -> tuple[list, list]:
    """Links of one block: (rep, links) counted in the first table that pairs both, and edges that connect the linked."""
    n = len(reps)
    links = vectors @ vectors.T >= COSINE
    np.fill_diagonal(links, False)
    if not same:
        links &= side[:, None] != side[None, :]
    if not links.any():
        return [], []
    touched = np.flatnonzero(links.any(axis=1))
    links = links[np.ix_(touched, touched)]
    reps, copies = reps[touched], copies[touched]
    keys = buckets(vectors[touched])[:, :t]
    fresh = links.copy()
    for at in range(t):
        fresh &= keys[:, at, None] != keys[None, :, at]
    counted = fresh @ copies
    label = np.arange(len(touched))
    while True:
        lower = np.minimum(label, np.where(links, label[None, :], n).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return ([(int(r), int(c)) for r, c in zip(reps, counted, strict=True) if c],
            [(int(reps[i]), int(reps[k])) for i, k in enumerate(label) if i != k])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all blocks of a partition sorted by block: rows (rep, links, other), one of the last two null."""
    names = ["size", "t", "bucket", "x", "y"]
    held: pa.Table | None = None

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        ends = np.append(heads[1:], len(key))
        counts, edges = [], []
        for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist(), strict=True):
            part = table.slice(a, b - a).combine_chunks()
            found = _block(int(key[a, 1]), key[a, 3] == key[a, 4], part.column("rep").to_numpy(), part.column("copies").to_numpy(),
                           part.column("side").to_numpy(), _matrix(part.column("v").combine_chunks()))
            counts += found[0]
            edges += found[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in counts + edges], pa.int64()), pa.array([c for _, c in counts] + [None] * len(edges), pa.int64()),
             pa.array([None] * len(counts) + [e for _, e in edges], pa.int64())], ["rep", "links", "other"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
        last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
        if last:
            yield from done(table.slice(0, last))
        held = table.slice(last)
    if held is not None:
        yield from done(held)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for every row of `vectors`.

    Two vectors link if their cosine in double precision is at least COSINE and a table pairs them. n_links counts the
    other vectors linked directly; component_id is the smallest vec_id reachable, itself included; kept is whether that
    is the row's own id. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do
    rows with a null id; vectors of different lengths never link. Equal vectors are one class that is hashed once.
    Rows that repeat an id count as one vector each. Empty in, empty out.

    A bucket of more than BLOCK classes is cut into blocks that meet in pairs, so that no task holds more than two
    blocks. A block gives counts and a spanning forest, not pairs, so its output grows with its rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    rows = written(rows.select("vec_id", F.when(usable, F.col("v")).alias("v")).withColumn(
        "class", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: F.hex(
            F.xxhash64(x))), ""), 256))))
    classes = written(rows.where("v is not null").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("size", F.size("v")))
    keyed = written(classes.select("size", "rep", "v").mapInArrow(_hashed, "t int, bucket long, rep long, size int"))
    # numbers only, until a bucket is known to hold several classes; most hold one
    counts = keyed.groupBy("size", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    several = written(counts.select("size", "t", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("cut")))
    side = F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")
    members = keyed.join(several, ["size", "t", "bucket"]).withColumn("side", side).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).select(
        "size", "t", "bucket", F.least("side", "with").alias("x"), F.greatest("side", "with").alias("y"), "side", "rep")
    blocks = written(members).join(classes.select("rep", "copies", "v"), "rep")
    keys = ["size", "t", "bucket", "x", "y"]
    found = written(blocks.select(*keys, "side", "rep", "copies", "v").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_checked, "rep long, links long, other long"))
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    named = written(
        classes.select("class", "rep", "copies").join(links, "rep", "left")
        .join(groups, F.col("rep") == F.col("id"), "left")
        .select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
