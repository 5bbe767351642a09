"""Token counts of whole texts under a fixed sentencepiece model, by a two-tier lookup without a word shuffle.

A pre-token is a run of spaces with the word after it, or a line break. No piece of the model crosses its borders, so
the count of a text is the sum over its pre-tokens. Tier one is a broadcast table of the lengths of frequent
pre-tokens; tier two is a cache in each worker for the rest, filled by the tokenizer itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces and the word after them, spaces before a break or the end, a line break.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
#: Longer pre-tokens are encoded without being remembered.
LONGEST_KEY = 48


def _loaded(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def splits_at_words(processor) -> bool:
    """No piece holds a space after another character, and none holds a line break."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and processor.encode(" \n  a", out_type=str)[:1] == ["▁▁"]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text with the space that the model puts in front; an empty text has none."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def lengths(processor, keys: list[str]) -> list[int]:
    """Token counts of pre-tokens. A line break in front stops the model's own leading space from joining them."""
    return [len(ids) - 2 for ids in processor.encode(["\n" + key for key in keys], num_threads=1)]


def frequent_pre_tokens(docs: DataFrame, table_size: int, text_col: str = "text") -> list[str]:
    """At most `table_size` frequent short pre-tokens of all texts.

    Every partition counts its own and passes on its `table_size` / 4 most frequent, so what is shuffled has a bound
    per partition. Which of them come through decides speed only, never a count.
    """
    each = max(1, table_size // 4)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                seen.update(pre_tokens(text))
                if len(seen) > 8 * table_size:
                    seen = Counter(dict(seen.most_common(4 * table_size)))
        top = [(key, n) for key, n in seen.most_common(each) if len(key) <= LONGEST_KEY and n > 1]
        yield pd.DataFrame(top, columns=["key", "n"]).astype({"key": "object", "n": "int64"})

    texts = docs.select(F.col(text_col).alias("t")).where("t is not null")
    ranked = texts.mapInPandas(counted, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return [row.key for row in ranked.orderBy(F.desc("n"), "key").limit(table_size).collect()]


def count_tokens(docs: DataFrame, model: str, table_size: int = 32768, cache_size: int = 1 << 18,
                 text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Adds the token count of every whole text; begin, end and special tokens are not counted.

    Null and empty texts count 0. Rows are kept as they are, repeated ones too; an input column named `out_col` is
    replaced. `table_size` entries of at most LONGEST_KEY characters bound the broadcast, `cache_size` the worker
    cache, which starts anew when full. If pieces of the model cross word borders, whole texts are encoded instead.
    """
    spark: SparkSession = docs.sparkSession
    processor = _loaded(model)
    whole = not splits_at_words(processor)
    keys = [] if whole else frequent_pre_tokens(docs, table_size, text_col)
    known = spark.sparkContext.broadcast(dict(zip(keys, lengths(processor, keys), strict=True)))

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, table = _loaded(model), known.value
        cache: dict[str, int] = {}
        for batch in batches:
            texts = batch.tolist()
            if whole:
                yield pd.Series([len(x) for x in encoder.encode([t or "" for t in texts], num_threads=1)], dtype="int64")
                continue
            totals, missing = [], []
            for row, text in enumerate(texts):
                tokens = pre_tokens(text) if text else []
                found = [table.get(token) or cache.get(token) or token for token in tokens]
                misses = [x for x in found if x.__class__ is str]
                totals.append(sum(x for x in found if x.__class__ is int) if misses else sum(found))
                missing.append(misses)
                if len(missing) % 512 == 0 or row == len(texts) - 1:
                    new = list({x for some in missing for x in some})
                    fresh = dict(zip(new, lengths(encoder, new), strict=True))
                    first = row + 1 - len(missing)
                    for at, some in enumerate(missing):
                        totals[first + at] += sum(map(fresh.__getitem__, some))
                    missing = []
                    if len(cache) + len(fresh) > cache_size:
                        cache = {}
                    cache.update((k, n) for k, n in fresh.items() if len(k) <= LONGEST_KEY)
            yield pd.Series(totals, dtype="int64")

    return docs.withColumn(out_col, counts(F.col(text_col)))
