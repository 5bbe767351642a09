"""JSON arrays of records, each file read by as many tasks as it has splits.

Spark's text reader cuts files at closing braces, wherever a split begins. Whether such a brace ends a record depends on
all that stands before it: is it inside a string, and how deep. A first pass folds every split into what it does to that
state, for both answers to whether it begins inside a string; the few numbers per split are put together on the driver, in
file order. A second pass then knows the state at the beginning of its split and cuts out records. A record that reaches
over splits is put together from its pieces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that begin or end a string, and of brackets and braces, inside strings too."""
    places = np.arange(len(data))
    slash = data == 0x5C
    last = np.maximum.accumulate(np.where(slash, -1, places)) if len(data) else places
    before = np.concatenate(([-1], last[:-1]))[:len(data)]
    escaped = (places - 1 - before) % 2 == 1
    quotes = np.flatnonzero((data == 0x22) & ~escaped)
    brackets = np.flatnonzero((data == 0x5B) | (data == 0x5D) | (data == 0x7B) | (data == 0x7D))
    return quotes, brackets


def _steps(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets outside of strings, what each does to the depth, and whether a string is open at the end."""
    quotes, brackets = _marks(data)
    outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
    places = brackets[outside]
    return places, np.where((data[places] == 0x5B) | (data[places] == 0x7B), 1, -1), bool((len(quotes) + inside) % 2)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Splits of a task in reading order, in pieces that end at closing braces."""
    for batch in batches:
        path, start = batch.column("path").to_pylist(), batch.column("start").to_pylist()
        values = batch.column("value").to_pylist()
        first = 0
        for at in range(1, len(values) + 1):
            if at == len(values) or (path[at], start[at]) != (path[first], start[first]):
                yield (path[first], start[first]), "".join(v + "}" for v in values[first:at]).encode()
                first = at


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: for either beginning, whether it ends in a string, the change of depth, its lowest, the first mark."""
    done: list[tuple] = []
    now, state = None, None

    def close() -> None:
        if now is not None:
            done.append((*now, *[x for s in state for x in s]))

    for split, data in _runs(batches):
        if split != now:
            close()
            now, state = split, [[bool(begin), 0, 0, 0] for begin in (0, 1)]
        array = np.frombuffer(data, np.uint8)
        for s in state:
            places, step, s[0] = _steps(array, s[0])
            if len(step):
                depth = s[1] + np.cumsum(step)
                s[2] = min(s[2], int(depth.min()))
                s[1] = int(depth[-1])
                s[3] = s[3] or int(array[places[0]])
    close()
    names = ["path", "start"] + [f"{n}{b}" for b in (0, 1) for n in ("ends", "depth", "low", "first")]
    kinds = [pa.string(), pa.int64(), *[pa.bool_(), pa.int64(), pa.int64(), pa.int64()] * 2]
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], names)


def _plan(rows: list) -> dict[tuple[str, int], tuple[int, bool, int, int, int]]:
    """Per split: its number, the state in which it begins, the depth around records, the split whose record is open."""
    plan, number = {}, 0
    for path in sorted({r.path for r in rows}):
        inside, depth, around, owner = False, 0, None, -1
        for r in sorted((r for r in rows if r.path == path), key=lambda r: r.start):
            begin = int(inside)
            if around is None and r[f"first{begin}"]:
                around = 1 if r[f"first{begin}"] == 0x5B else 0
            plan[path, r.start] = (number, inside, depth, around or 0, owner if depth > (around or 0) or inside else -1)
            closed = depth + r[f"low{begin}"] <= (around or 0)
            depth, inside = depth + r[f"depth{begin}"], r[f"ends{begin}"]
            if depth > (around or 0) or inside:
                owner = number if closed or owner < 0 else owner
            else:
                owner = -1
            number += 1
        # the brace put behind the last piece closes nothing
        if inside or depth not in (0, -1):
            name, place = path.split("\0", 1)
            raise ValueError(f"damaged JSON in {place} ({name}): it ends inside a record or a string")
    return plan


def _cutter(shared):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(path, pos, owner, text): whole records, and pieces of records that other splits share."""
        now, held, inside, depth, number, around, owner, n = None, b"", False, 0, 0, 0, -1, 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = {"path": pa.string(), "pos": pa.int64(), "owner": pa.int64(), "text": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds.values())], list(kinds))

        def rest() -> list[tuple]:
            """What is open at the end of a split."""
            if now is None or not held or not (depth > around or inside):
                return []
            return [(now[0], number << 33 | n, owner if owner >= 0 else number, held.decode())]

        for split, data in _runs(batches):
            out = []
            if split != now:
                out = rest()
                now, held, n = split, b"", 0
                number, inside, depth, around, owner = shared.value[split]
            data = held + data if held else data
            skip, held_from = len(held), 0
            array = np.frombuffer(data, np.uint8)
            places, step, ends = _steps(array[skip:], inside)
            places = places + skip
            after = depth + np.cumsum(step)
            begin = 0 if (depth > around or inside) else None
            for at in np.flatnonzero((step == 1) & (after == around + 1) | (step == -1) & (after == around)).tolist():
                if step[at] == 1:
                    begin = int(places[at])
                elif begin is not None:
                    text = data[begin:int(places[at]) + 1].decode()
                    out.append((now[0], number << 33 | n, owner, text))
                    n, begin, owner = n + 1, None, -1
            inside, depth = ends, int(after[-1]) if len(after) else depth
            held = data[begin:] if begin is not None else b""
            if out:
                yield rows(out)
        if rest():
            yield rows(rest())
    return cut


def read_records(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """name, path, pos, text: the records of JSON array files below the path of each name; `pos` ascends in file order.

    All names are read together. A file may also hold a single object. A file that ends inside a record or a string is an error that names it. Values of
    an array that are no objects or arrays are passed over. One small row per split goes to the driver.
    """
    reader = spark.read.option("lineSep", "}")
    parts = [reader.text(path).select(
        "value", F.concat(F.lit(f"{name}\0"), "_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        for name, path in paths.items()]
    pieces = reduce(DataFrame.unionByName, parts)
    folds = pieces.mapInArrow(_folded, "path string, start long, " + ", ".join(
        f"ends{b} boolean, depth{b} long, low{b} long, first{b} long" for b in (0, 1))).collect()
    shared = spark.sparkContext.broadcast(_plan(folds))
    cut = pieces.mapInArrow(_cutter(shared), "path string, pos long, owner long, text string")
    whole = cut.where("owner < 0").select("path", "pos", "text")
    joined = cut.where("owner >= 0").groupBy("path", "owner").agg(
        F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    every = whole.union(joined.select("path", "pos", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    both = F.split("path", "\0", 2)
    return every.select(both[0].alias("name"), both[1].alias("path"), "pos", "text")
