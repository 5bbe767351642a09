"""Exact search for the highest inner products with an M-tree of paged metric nodes.

Two levels of routing objects, picked from a bounded sample, split the vectors into regions; the vectors of a region are
sorted by their distance to its routing object and cut into pages, one row of a table each. A region knows its covering
radius, its longest vector and the distance to its parent; a page the least and the greatest distance to the routing
object and its longest vector; an entry its distance to the routing object. With the triangle inequality these numbers
bound the inner product of a query with everything below a node, so most distances and scores are never computed.

Queries go through the tree best bound first, in waves: their own page, then the WAVE pages with the best bounds, then all
pages whose bound still reaches the lowest score that they have. A page gets its queries by a shuffle, in groups of bounded
size. Nothing is approximate: the sample decides only how well the tree prunes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diagtab.llm.common import written

#: Results per query, and the factor of the whole numbers that are compared.
K, SCALE = 20, 64
#: Rows of the sample that routing objects come from, and routing objects of a node.
SAMPLE, FAN = 4096, 24
#: Least rows of a full page, and about the most pages: beyond PAGE * PAGES rows, pages grow.
PAGE, PAGES = 1024, 1 << 18
#: Pages that a query visits in the first wave after its own, and most queries that a page gets at once.
WAVE, GROUP = 8, 4096
#: Bounds are weakened by this share of the squared lengths, more than rounding can spoil.
SLACK = 1e-6

FOUND = "array<struct<score: long, id: long>>"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _stored(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 or 8 bytes, the width in front."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _loaded(data: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(data[1:], f"<i{data[0]}").astype(np.int64).reshape(n, size)


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(axis=-1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to rows of y; exact before the root while sums stay below 2^53."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits become the nearest number of 64 bits."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = float(np.abs(rows.astype(np.float64)).max()) * float(np.abs(query.astype(np.float64)).max()) * len(query)
    if most < 2.0 ** 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(v, low), high) for v in rows.astype(object) @ query.astype(object)], np.int64)


class Node:
    """Routing objects of the vectors of one length: parents, and leaves that know their parent."""

    def __init__(self, sample: np.ndarray):
        self.parents = sample[:FAN]
        nearest = distances(sample, self.parents).argmin(axis=1)
        chosen = [np.flatnonzero(nearest == p)[:FAN] for p in range(len(self.parents))]
        self.leaves = sample[np.concatenate(chosen)]
        self.parent = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        self.to_parent = distances(self.leaves, self.parents)[np.arange(len(self.leaves)), self.parent]

    def region(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, found from the root down, and the distance to it."""
        up = distances(rows, self.parents).argmin(axis=1)
        down = distances(rows, self.leaves)
        down[self.parent[None, :] != up[:, None]] = np.inf
        leaf = down.argmin(axis=1)
        return leaf, down[np.arange(len(rows)), leaf]


def root_of(size: int) -> Node:
    """The tree of a length that the sample does not hold: one region around zero."""
    return Node(np.zeros((1, size), np.int64))


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


def _assigner(trees):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                rows = _matrix(part.column("v"), size)
                leaf, away = (trees.value.get(size) or root_of(size)).region(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), pa.array(away), *(part.column(c) for c in ("size", "rep", "ids", "asked", "v"))],
                    ["region", "away", "size", "rep", "ids", "asked", "v"])
    return assigned


PAGE_SCHEMA = ("page long, size int, region int, lo double, hi double, longest double, n int, vectors binary, away binary, "
               "ids binary, owner binary, asked binary")


def _pager(most: int):
    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive entries of one region, at most `most`, make a page; entries come sorted by their distance."""
        held: pa.Table | None = None

        def page(table: pa.Table, size: int, region: int) -> dict:
            part = table.combine_chunks()
            away = part.column("away").to_numpy()
            ids = part.column("ids").combine_chunks()
            counts = np.diff(ids.offsets.to_numpy())
            rows = _matrix(part.column("v").combine_chunks(), size)
            return {"page": part.column("rep")[0].as_py(), "size": size, "region": region, "lo": away[0], "hi": away[-1],
                    "longest": lengths(rows).max(), "n": len(away), "vectors": _stored(rows), "away": away.astype("<f8").tobytes(),
                    "ids": ids.flatten().to_numpy().astype("<i8").tobytes(),
                    "owner": np.repeat(np.arange(len(counts)), counts).astype("<i4").tobytes(),
                    "asked": part.column("asked").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()}

        def cut(table: pa.Table, last: bool) -> tuple[list[dict], pa.Table]:
            key = table.column("size").to_numpy().astype(np.int64) << 32 | table.column("region").to_numpy()
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
            pages, rest = [], 0
            for a, b in zip(heads, heads[1:]):
                while b - a >= most or (a < b and (b < len(key) or last)):
                    end = min(b, a + most)
                    pages.append(page(table.slice(a, end - a), int(key[a] >> 32), int(key[a] & 0xFFFFFFFF)))
                    a = rest = end
            return pages, table.slice(rest)

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                pages, held = cut(table if held is None else pa.concat_tables([held, table]), False)
                for made in pages:
                    yield _page_batch([made])
        if held is not None and held.num_rows:
            for made in cut(held, True)[0]:
                yield _page_batch([made])
    return paged


def _page_batch(pages: list[dict]) -> pa.RecordBatch:
    kinds = [("page", pa.int64()), ("size", pa.int32()), ("region", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()),
             ("longest", pa.float64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("vectors", "away", "ids", "owner", "asked"))]
    return pa.RecordBatch.from_pylist(pages, pa.schema(kinds))


def best(scores: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest (score, id) of entries whose classes have `scores`, ties to smaller ids."""
    every = scores[owner]
    if len(every) > k:
        reach = np.flatnonzero(every >= np.partition(every, len(every) - k)[len(every) - k])
        every, ids = every[reach], ids[reach]
    order = np.lexsort((ids, -every.astype(object) if len(every) and every.min() == -(1 << 63) else -every))[:k]
    return every[order], ids[order]


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _loaded(row["vectors"], row["n"], row["size"]), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["owner"], "<i4")


def _state_batch(rows: list[dict]) -> pa.RecordBatch:
    found = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
    kinds = [("rep", pa.int64()), ("size", pa.int32()), ("v", pa.binary()), ("seen", pa.list_(pa.int64())), ("found", found)]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _structs(scores: np.ndarray, ids: np.ndarray) -> list[dict]:
    return [{"score": s, "id": i} for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]


def _at_home(k: int):
    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every asked class with the best of its own page."""
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                asked = np.flatnonzero(np.frombuffer(row["asked"], np.uint8))
                if not len(asked):
                    continue
                rows, ids, owner = _entries(row)
                first = np.searchsorted(owner, asked)
                yield _state_batch([
                    {"rep": int(ids[f]), "size": row["size"], "v": _stored(rows[a]), "seen": [row["page"]],
                     "found": _structs(*best(products(rows, rows[a]), ids, owner, k))}
                    for a, f in zip(asked.tolist(), first.tolist(), strict=True)])
    return home


def _reach(query: float, longest: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """The most that a product with a vector of at most this length and at least this distance can be."""
    return np.minimum((query ** 2 + longest ** 2 - nearest ** 2) / 2, query * longest) + SLACK * (query ** 2 + longest ** 2 + 1)


def _planner(index, groups: int, k: int, wave: int | None):
    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pages that each query visits next, best bound first: (page, slot, rep, v, least, away)."""
        trees, directory = index.value
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("page", "slot", "rep", "v", "least", "away")}
            for row in batch.to_pylist():
                size = row["size"]
                tree = trees.get(size) or root_of(size)
                pages = directory[size]
                query = _loaded(row["v"], 1, size)
                length = float(lengths(query)[0])
                least = row["found"][-1]["score"] if len(row["found"]) >= k else None
                floor = -np.inf if least is None else float(least)
                # leaves that their distance to the parent rules out are never compared with the query
                up = distances(query, tree.parents)[0]
                gap = np.maximum(np.abs(up[tree.parent] - tree.to_parent) - pages["radius"], 0)
                leaves = np.flatnonzero(pages["filled"] & (_reach(length, pages["top"], gap) >= floor))
                away = np.full(len(tree.leaves), np.nan)
                away[leaves] = distances(query, tree.leaves[leaves])[0]
                far = away[pages["region"]]
                rows = np.flatnonzero(~np.isnan(far))
                far = far[rows]
                near = np.maximum(np.maximum(far - pages["hi"][rows], pages["lo"][rows] - far), 0)
                bound = _reach(length, pages["longest"][rows], near)
                kept = np.flatnonzero((bound >= floor) & ~np.isin(pages["page"][rows], row["seen"]))
                kept = kept[np.argsort(-bound[kept], kind="stable")][:wave]
                out["page"] += pages["page"][rows[kept]].tolist()
                out["away"] += far[kept].tolist()
                out["slot"] += [(row["rep"] * 0x9E3779B97F4A7C15 >> 20) % groups] * len(kept)
                for c, value in (("rep", row["rep"]), ("v", row["v"]), ("least", least)):
                    out[c] += [value] * len(kept)
            kinds = {"page": pa.int64(), "slot": pa.int32(), "rep": pa.int64(), "v": pa.binary(), "least": pa.int64(), "away": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds.items()], list(kinds))
    return planned


def _visitor(k: int):
    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every query on a page the best that reach its lowest score; entries too far off are left out."""
        kinds = pa.schema([("rep", pa.int64()), ("page", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))])
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                rows, ids, owner = _entries(row)
                away = np.frombuffer(row["away"], "<f8")
                begins = np.searchsorted(owner, np.arange(len(rows) + 1))
                out = []
                for asked in row["queries"]:
                    query = _loaded(asked["v"], 1, row["size"])
                    low, high = 0, len(rows)
                    if asked["least"] is not None:
                        length = float(lengths(query)[0])
                        squares = length ** 2 + row["longest"] ** 2
                        room = np.sqrt(max(squares - 2 * asked["least"] + 2 * SLACK * (squares + 1), 0))
                        low, high = np.searchsorted(away, asked["away"] - room), np.searchsorted(away, asked["away"] + room, "right")
                    part = slice(begins[low], begins[max(low, high)])
                    scores, own = best(products(rows[low:high], query[0]), ids[part], owner[part] - low, k)
                    if asked["least"] is not None:
                        scores, own = scores[scores >= asked["least"]], own[scores >= asked["least"]]
                    out.append({"rep": asked["rep"], "page": row["page"], "found": _structs(scores, own)})
                yield pa.RecordBatch.from_pylist(out, kinds)
    return visited


def _directory(pages: DataFrame, trees: dict[int, Node]) -> dict[int, dict[str, np.ndarray]]:
    """What the tree knows of its pages, per length: a few numbers a page, about PAGES pages whatever the input."""
    rows = pages.select("size", "region", "page", "lo", "hi", "longest").toPandas().sort_values(["size", "region", "lo", "page"])
    out = {}
    for size, part in rows.groupby("size"):
        regions = len(trees[size].leaves) if size in trees else 1
        own = {c: part[c].to_numpy() for c in ("region", "page", "lo", "hi", "longest")}
        own |= {"radius": np.zeros(regions), "top": np.zeros(regions), "filled": np.zeros(regions, bool)}
        np.maximum.at(own["radius"], own["region"], own["hi"])
        np.maximum.at(own["top"], own["region"], own["longest"])
        own["filled"][own["region"]] = True
        out[int(size)] = own
    return out


def _ranked(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each key; Spark cuts every task's share before it shuffles."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", at).where(F.col("__rank") <= most)


def top_products(vectors: DataFrame, k: int = K, asked: Callable[[Column], Column] = lambda i: i % 20 == 0, scale: int = SCALE,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its k highest scores, all if there are fewer.

    A vector stands for floor(scale * x) of its components; the score of two is their integer inner product. Queries are the
    ids for which `asked` holds, candidates all rows but the query's own; ties go to the smaller vec_id. Rank starts at 1.

    Vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. Rows that repeat an id
    are one row, with the least of their vectors. Vectors of different lengths are not compared; empty vectors score 0 with
    each other. Components beyond 64 bits, and scores, become the nearest number of 64 bits. Equal vectors are one entry with
    its k + 1 smallest ids, which are all that a result can need. `k` is at most 999, so that Spark ranks within tasks first.
    Empty in, empty out.
    """
    spark, reach = vectors.sparkSession, k + 1
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x"))
    sound = plain.where("id is not null and x is not null").where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    points = written(sound.groupBy("id").agg(F.min(F.transform("x", lambda x: F.floor(x * scale))).alias("v")))
    smallest = _ranked(points, "v", ["id"], reach)
    classes = written(smallest.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("rep"), "ids", F.size("v").alias("size"), "v"))
    named = written(points.where(asked(F.col("id"))).join(classes.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep"))
    wanted = written(named.select("rep").distinct())

    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("size", "v").toPandas()
    trees = {int(size): Node(np.array(part["v"].tolist(), np.int64).reshape(len(part), int(size))) for size, part in sample.groupby("size")}
    sent = spark.sparkContext.broadcast(trees)
    n_classes, n_wanted = classes.count(), wanted.count()
    flagged = classes.join(wanted.withColumn("asked", F.lit(True)), "rep", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    placed = written(flagged.mapInArrow(_assigner(sent), "region int, away double, size int, rep long, ids array<long>, asked boolean, v array<long>"))
    order = ["size", "region", "away", "rep"]
    pages = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pager(max(PAGE, -(-n_classes // PAGES))), PAGE_SCHEMA))
    index = spark.sparkContext.broadcast((trees, _directory(pages, trees)))

    state = written(pages.mapInArrow(_at_home(reach), f"rep long, size int, v binary, seen array<long>, found {FOUND}"))
    groups = max(1, -(-n_wanted // GROUP))
    for wave in (WAVE, None):
        plan = written(state.mapInArrow(
            _planner(index, groups, reach, wave), "page long, slot int, rep long, v binary, least long, away double"))
        queries = plan.groupBy("page", "slot").agg(F.collect_list(F.struct("rep", "v", "least", "away")).alias("queries"))
        held = pages.select("page", "size", "n", "longest", "vectors", "away", "ids", "owner")
        found = written(queries.join(held, "page").mapInArrow(_visitor(reach), f"rep long, page long, found {FOUND}"))
        every = state.select("rep", F.inline("found")).union(found.select("rep", F.inline("found")))
        top = _ranked(every, "rep", [F.desc("score"), "id"], reach).groupBy("rep").agg(
            F.collect_list(F.struct("__rank", "score", "id")).alias("r")).select(
            "rep", F.transform(F.array_sort("r"), lambda e: F.struct(e.score.alias("score"), e.id.alias("id"))).alias("found"))
        if wave:
            seen = found.groupBy("rep").agg(F.collect_set("page").alias("more"))
            state = written(state.select("rep", "size", "v", "seen").join(top, "rep").join(seen, "rep", "left").select(
                "rep", "size", "v", F.concat("seen", F.coalesce("more", F.array().cast("array<long>"))).alias("seen"), "found"))
    answers = written(top)
    rows = named.join(answers, "rep").select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda e: e.id != F.col("query_id")), 1, k)).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))
