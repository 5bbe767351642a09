"""Many rows of a record as one row of flat arrays.

Rows of a record mostly lie side by side, since they come from one text. A run
of them becomes one pack inside the task: numbers, and words as places in the
pack's own list of distinct words, as compressed differences between neighbours,
and that list, compressed.
Packs, not rows, are then exchanged and grouped by record; where rows of a
record are apart it has more packs.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# packing travels with the job, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

KEYS = ["dataset", "id"]
#: Stands for null in a list of numbers.
NULL = -(1 << 31)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and the place of each one's list."""
    if not len(lists):
        return lists.values.slice(0, 0), np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), np.repeat(np.arange(len(lists)), np.diff(offsets))


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """First rows of the runs of rows with equal keys."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for key in KEYS:
        code = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _per_run(coded: pa.DictionaryArray, run: np.ndarray, n_runs: int) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """The distinct values of each run, where each run's begin, and each row's place (-1: null) in its run's list."""
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = code >= 0
    distinct, place = np.unique((run[there] << 32) | code[there], return_inverse=True)
    start = np.searchsorted(distinct >> 32, np.arange(n_runs + 1))
    own = np.full(len(code), -1, np.int32)
    own[there] = place - start[run[there]]
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), coded.dictionary.take(pa.array(distinct & 0xFFFFFFFF))), start, own


def _pack(batch: pa.RecordBatch, numbers: Sequence[str], words: Sequence[str]) -> pa.RecordBatch:
    """One row per run of rows with equal keys."""
    n = batch.num_rows
    first = _runs(batch)
    ends = np.append(first, n)
    columns = [batch.column(c).fill_null(NULL).to_numpy(zero_copy_only=False) for c in numbers]
    fields = {"n": pa.array(np.diff(ends).astype(np.int32))}
    if words:
        coded = pa.concat_arrays([batch.column(c).cast(pa.string()) for c in words]).dictionary_encode()
        run = np.tile(np.repeat(np.arange(len(first)), np.diff(ends)), len(words))
        held, _, own = _per_run(coded, run, len(first))
        places = np.split(own, len(words))
        columns += [places[0], *(p - places[0] for p in places[1:])]  # forms of a word often have one place
    values = np.stack(columns).astype(np.int32)
    steps = values.copy()
    steps[:, 1:] -= values[:, :-1]
    steps[:, first] = values[:, first]
    codec = pa.Codec("zstd", compression_level=1)
    fields["data"] = pa.array([codec.compress(steps[:, a:b].tobytes(), asbytes=True) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    if words:
        fields |= _spelled(held, codec)
    pack = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in KEYS), pack], [*KEYS, "pack"])


def _spelled(held: pa.ListArray, codec: pa.Codec) -> dict[str, pa.Array]:
    """The lengths and letters of the strings of each list, compressed: a list of strings takes eight bytes and more for each."""
    values = held.values.cast(pa.large_string())
    begins = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    letters = values.buffers()[2] if len(values) else None
    letters = np.frombuffer(letters, np.uint8) if letters is not None and letters.size else np.zeros(0, np.uint8)
    sizes, outer = np.diff(begins).astype(np.int32), held.offsets.to_numpy()
    spans = list(zip(outer[:-1].tolist(), outer[1:].tolist(), strict=True))
    packed = [codec.compress(sizes[a:b].tobytes() + letters[begins[a]:begins[b]].tobytes(), asbytes=True) for a, b in spans]
    return {"n_words": pa.array(np.diff(outer).astype(np.int32)), "n_letters": pa.array(np.diff(begins[outer])), "_words": pa.array(packed, pa.binary())}


def _respelled(packs: pa.Array, codec: pa.Codec) -> tuple[pa.Array, np.ndarray]:
    """The words of all packs, and where those of each pack begin."""
    n, n_letters = (packs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_words", "n_letters"))
    data = [codec.decompress(x.as_buffer(), decompressed_size=4 * a + b).to_pybytes()
            for x, a, b in zip(packs.field("_words"), n.tolist(), n_letters.tolist(), strict=True)]
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.frombuffer(x, np.int32, a) for x, a in zip(data, n.tolist(), strict=True))])
    letters = b"".join(x[4 * a:] for x, a in zip(data, n.tolist(), strict=True))
    held = pa.LargeStringArray.from_buffers(len(sizes) - 1, pa.py_buffer(np.cumsum(sizes, dtype=np.int64).tobytes()), pa.py_buffer(letters))
    return held.cast(pa.string()), np.cumsum(n) - n


def _key_types(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema.fields)


def packs_of(rows: DataFrame, numbers: Sequence[str], words: Sequence[str] = (), name: str = "pack") -> DataFrame:
    """KEYS and a pack per run of rows of one record, with its int columns ``numbers`` and string columns ``words``."""
    fields = ["n: int", "data: binary", *(["n_words: int", "n_letters: bigint", "_words: binary"] if words else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pack(batch, numbers, words)

    chosen = rows.select(*KEYS, *[F.col(c).cast("int").alias(c) for c in numbers], *words)
    return chosen.mapInArrow(pack, f"{_key_types(rows)}, pack struct<{', '.join(fields)}>").withColumnRenamed("pack", name)


def packed(rows: DataFrame, numbers: Sequence[str], words: Sequence[str] = (), name: str = "packs") -> DataFrame:
    """KEYS and an array of packs: one row per record with its int columns ``numbers`` and string columns ``words``."""
    return packs_of(rows, numbers, words).groupBy(*KEYS).agg(F.collect_list("pack").alias(name))


def rows_until(packs: pa.Array) -> np.ndarray:
    """How many packed rows there are up to and with each list of packs."""
    if not len(packs):
        return np.zeros(0, np.int64)
    inner = np.append(0, np.cumsum(packs.values.field("n").to_numpy(zero_copy_only=False).astype(np.int64)))
    outer = packs.offsets.to_numpy()
    return inner[outer[1:]] - inner[outer[0]]


def unpacked(lists: pa.Array, numbers: Sequence[str], words: Sequence[str] = ()) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array | None]:
    """The record of every packed row, its numbers and places of its words (-1: null), and the list these places are of."""
    packs, record = flat(lists)
    names = (*numbers, *words)
    n = packs.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    codec = pa.Codec("zstd")
    data = [np.frombuffer(codec.decompress(x.as_buffer(), decompressed_size=4 * len(names) * k), np.int32).reshape(len(names), k)
            for x, k in zip(packs.field("data"), n.tolist(), strict=True)]
    steps = np.concatenate(data, axis=1) if data else np.zeros((len(names), 0), np.int32)
    pack = np.repeat(np.arange(len(n)), n)
    sums = np.concatenate([np.zeros((len(names), 1), np.int32), np.cumsum(steps, axis=1, dtype=np.int32)], axis=1)
    values = sums[:, 1:] - sums[:, np.cumsum(n) - n][:, pack]
    out = {c: values[at].astype(np.int64) for at, c in enumerate(numbers)}
    held = None
    if words:
        held, base = _respelled(packs, codec)
        places = values[len(numbers):].astype(np.int64)
        for at, c in enumerate(words):
            own = places[at] + (places[0] if at else 0)
            out[c] = np.where(own >= 0, own + base[pack], -1) if len(packs) else own
    return record[pack], out, held


def tallied(rows: DataFrame, conditions: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """KEYS, n, how many rows of a record meet each condition, and how many distinct values without null each of ``distinct`` has.

    A run of rows of one record is counted inside the task; what is exchanged per run are the counts and the distinct values.
    """
    distinct = distinct or {}
    met = [F.when(c, 1 << at).otherwise(0) for at, c in enumerate(conditions.values())]
    chosen = rows.select(*KEYS, sum(met, F.lit(0)).cast("int").alias("_met"), *[c.alias(name) for name, c in distinct.items()])
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    counted, listed = list(conditions), list(distinct)  # columns do not travel

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = _runs(batch)
            ends = np.append(first, batch.num_rows)
            flags = batch.column("_met").to_numpy(zero_copy_only=False)
            columns = [batch.column(k).take(pa.array(first)) for k in KEYS]
            columns.append(pa.array(np.diff(ends)))
            columns += [pa.array(np.add.reduceat((flags >> at) & 1, first).astype(np.int64)) for at in range(len(counted))]
            run = np.repeat(np.arange(len(first)), np.diff(ends))
            columns += [_per_run(batch.column(c).dictionary_encode(), run, len(first))[0] for c in listed]
            yield pa.RecordBatch.from_arrays(columns, [*KEYS, "n", *counted, *listed])

    counts = "".join(f", {c} bigint" for c in ("n", *conditions))
    lists = "".join(f", {c} array<{types[c]}>" for c in distinct)
    runs = chosen.mapInArrow(count, _key_types(rows) + counts + lists)
    return runs.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n", *conditions)],
        *[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long").alias(c) for c in distinct])


def digests(rows: DataFrame, name: str, text: str) -> DataFrame:
    """KEYS, ``name``, n, digest: of the rows of each name in a record their number and the MD5 of their sorted texts, joined by a bar.

    Rows travel as packs; those of a record are sorted and joined where they meet. A null text is counted and left out.
    """
    packs = packed(rows, (), (name, text))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a record is bounded by its text; its rows can be many times that
                _, of, held = unpacked(batch.column("packs").slice(at, 1), (), (name, text))
                named = _alike(held)[of[name]]
                order = np.argsort(named, kind="stable")
                named, place = named[order], of[text][order]
                first = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
                ends = np.append(first, len(named))
                md5 = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    listed = held.take(pa.array(place[a:b][place[a:b] >= 0])).to_pylist()
                    md5.append(hashlib.md5("|".join(sorted(listed)).encode()).hexdigest())
                shown = named[first]
                keys = [batch.column(k).take(pa.array(np.full(len(first), at))) for k in KEYS]
                names = held.take(pa.array(np.maximum(shown, 0), mask=shown < 0))
                yield pa.RecordBatch.from_arrays([*keys, names, pa.array(np.diff(ends)), pa.array(md5, pa.string())], [*KEYS, name, "n", "digest"])

    return packs.mapInArrow(digested, f"{_key_types(rows)}, `{name}` string, n bigint, digest string")


def _alike(held: pa.Array) -> np.ndarray:
    """The first place of each word among words that may repeat; -1 behind them, for null."""
    code = held.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return np.append(first[which], -1)
