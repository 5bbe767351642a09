"""Quality classification by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Every learned filter answers at every second byte of a
chunk; the largest answer per filter is the chunk's feature. The mean and the largest feature over all chunks of the text are
combined into one probability. A filter over raw bytes is one row of answers per byte value and place, so a
convolution is a few table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Filters, bytes of a filter, bytes between its places.
FILTERS, WIDTH, STRIDE = 16, 6, 2
#: Bytes of a chunk and bytes between the starts of chunks.
CHUNK, STEP = 256, 192
#: Training: documents per label, all of whose chunks are read; passes, documents per step.
SAMPLE, EPOCHS, BATCH = 1500, 12, 32
#: Chunks that are scored at a time.
GROUP = 1 << 12


@dataclass
class Network:
    """Filter answers (place, byte, filter), their offsets, weights of mean and largest features, offset of the sum."""

    table: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    base: float


def chunk_starts(size: int) -> np.ndarray:
    """Starts of overlapping chunks that cover `size` bytes; the last one ends with the text."""
    if size <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, size - CHUNK + STEP, STEP)
    starts[-1] = size - CHUNK
    return starts


def _chunk_bytes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of CHUNK bytes per start; `data` has at least CHUNK bytes behind each."""
    return data[starts[:, None] + np.arange(CHUNK)]


def _answers(net: Network, rows: np.ndarray) -> np.ndarray:
    """Filter answers (chunk, place, filter)."""
    n = (rows.shape[1] - WIDTH) // STRIDE + 1
    out = np.take(net.table[0], rows[:, 0:STRIDE * n:STRIDE], axis=0)
    for k in range(1, WIDTH):
        out += np.take(net.table[k], rows[:, k:k + STRIDE * n:STRIDE], axis=0)
    return out


def features(net: Network, rows: np.ndarray) -> np.ndarray:
    """Largest answer of every filter in every chunk."""
    return np.maximum(_answers(net, rows).max(axis=1) + net.bias, 0)


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(text.ljust(CHUNK, b" "), np.uint8)


def probability(net: Network, text: bytes) -> float:
    """Probability of label 1 for a whole text; an empty one is a chunk of blanks."""
    data = _padded(text)
    starts = chunk_starts(len(data))
    total, most = np.zeros(len(net.bias)), np.zeros(len(net.bias))
    for at in range(0, len(starts), GROUP):
        found = features(net, _chunk_bytes(data, starts[at:at + GROUP]))
        total += found.sum(axis=0)
        most = np.maximum(most, found.max(axis=0))
    z = float(total / len(starts) @ net.mean + most @ net.most + net.base)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """`probability` of many texts; chunks of short texts are scored together."""
    out, waiting, held = np.zeros(len(texts)), [], 0

    def flush() -> None:
        nonlocal waiting, held
        if not waiting:
            return
        found = features(net, np.concatenate([rows for _, rows in waiting]))
        counts = np.array([len(rows) for _, rows in waiting])
        first = np.cumsum(counts) - counts
        mean = np.add.reduceat(found, first, axis=0, dtype=np.float64) / counts[:, None]
        z = mean @ net.mean + np.maximum.reduceat(found, first, axis=0) @ net.most + net.base
        out[[i for i, _ in waiting]] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        waiting, held = [], 0

    for i, text in enumerate(texts):
        if len(text) > CHUNK * GROUP // 8:
            out[i] = probability(net, text)
            continue
        data = _padded(text)
        waiting.append((i, _chunk_bytes(data, chunk_starts(len(data)))))
        held += len(waiting[-1][1])
        if held >= GROUP // 4:
            flush()
    flush()
    return out


def chunks_of(text: bytes) -> np.ndarray:
    """All chunks of a text, one row each."""
    data = _padded(text)
    return _chunk_bytes(data, chunk_starts(len(data)))


def _strongest(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the largest answer of every filter in every chunk, and that answer; GROUP chunks at a time."""
    where, raw = [], []
    for at in range(0, len(rows), GROUP):
        answers = _answers(net, rows[at:at + GROUP])
        where.append(answers.argmax(axis=1))
        raw.append(np.take_along_axis(answers, where[-1][:, None, :], axis=1)[:, 0] + net.bias)
    return np.concatenate(where), np.concatenate(raw)


def train(docs: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Fits the network with Adam on the log loss, from the chunks of every document.

    `prior` is the share of label 1 among all labelled rows.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.2, FILTERS), np.zeros(FILTERS), 0.0)
    params = [net.table, net.bias, net.mean, net.most, np.zeros(1)]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            rows = np.concatenate([docs[i] for i in pick])
            counts = np.array([len(docs[i]) for i in pick])
            first = np.cumsum(counts) - counts
            own = np.repeat(np.arange(len(pick)), counts)
            where, raw = _strongest(net, rows)
            found = np.maximum(raw, 0)
            mean = np.add.reduceat(found, first, axis=0) / counts[:, None]
            most = np.maximum.reduceat(found, first, axis=0)
            z = mean @ net.mean + most @ net.most + params[4][0]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            back = (error[:, None] * net.mean / counts[:, None])[own] + np.where(found == most[own], error[own, None] * net.most, 0)
            back = np.where(raw > 0, back, 0)
            grads = [np.zeros(net.table.shape), back.sum(axis=0), error @ mean, error @ most, np.array([error.sum()])]
            filters = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                byte = np.take_along_axis(rows, where * STRIDE + k, axis=1).astype(np.int64)
                grads[0][k] = np.bincount((byte * FILTERS + filters).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(p.dtype)
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    net.base = float(params[4][0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Network | float:
    """Trains on at most `sample` documents per label, picked by a digest of the id, in one task.

    All chunks of these documents are used; they are cut where the texts are read, so no whole text is sent. Of several
    texts of an id the least counts. Labels other than 0 and 1 and rows without text are left out; of several labels of an id the smallest counts.
    Without rows of both labels the share of label 1 is returned instead of a network (0.5 without any).
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if len(sizes) < 2:
        return prior
    digest = F.md5(F.col("id").cast("string"))
    picked = [marked.where(F.col("y") == y).orderBy(digest, "id").limit(sample) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    # at most 2 * sample rows of two numbers
    chosen = texts.join(F.broadcast(picked[0].union(picked[1])), "id").select("id", "y", "t")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for id_, y, text in zip(batch["id"], batch["y"], batch["t"], strict=True):
                rows = chunks_of(bytes(text))
                for at in range(0, len(rows), GROUP):
                    part = rows[at:at + GROUP]
                    yield pd.DataFrame({"id": id_, "y": y, "at": np.arange(at, at + len(part)), "chunk": [r.tobytes() for r in part]})

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[list[np.ndarray]] = []
        y, last = [], None
        for batch in batches:  # sorted by document and place
            rows = np.frombuffer(b"".join(batch["chunk"]), np.uint8).reshape(-1, CHUNK)
            ids = batch["id"].to_numpy()
            heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist()
            for a, b in zip(heads, [*heads[1:], len(ids)], strict=True):
                if not docs or ids[a] != last:
                    docs.append([])
                    y.append(float(batch["y"].iloc[a]))
                docs[-1].append(rows[a:b])
                last = ids[a]
        if len(set(y)) == 2:
            net = train([np.concatenate(d) for d in docs], np.array(y), prior)
            parts = (net.table, net.bias, net.mean, net.most, np.array([net.base]))
            yield pd.DataFrame({"part": range(len(parts)), "numbers": [p.astype(np.float64).ravel().tolist() for p in parts]})

    kind = chosen.schema["id"].dataType.simpleString()
    single = chosen.groupBy("id", "y").agg(F.min("t").alias("t"))
    pieces = single.mapInPandas(cut, f"id {kind}, y int, at long, chunk binary")
    # about 25,000 numbers, whatever the data
    found = pieces.repartition(1).sortWithinPartitions("id", "at").mapInPandas(trained, "part int, numbers array<double>").collect()
    if not found:
        return prior
    table, bias, mean, most, base = (np.array(r.numbers) for r in sorted(found))
    return Network(table.reshape(WIDTH, 256, FILTERS).astype(np.float32), bias.astype(np.float32), mean, most, float(base[0]))


def score(docs: DataFrame, model: Network | float, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the probability of label 1 of every whole text, 0 to 1.

    Null texts count as empty. Rows are kept as they are; an input column named `out_col` is replaced.
    """
    if not isinstance(model, Network):
        return docs.withColumn(out_col, F.lit(float(model)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(probabilities(shared.value, [(t or "").encode() for t in batch]))

    return docs.withColumn(out_col, scored(F.col(text_col)))
