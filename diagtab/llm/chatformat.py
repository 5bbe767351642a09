"""Chat formatting over a prefix tree: shared initial turns are emitted once, depth first.

A node of the tree is a turn after a given sequence of earlier turns. Its id is a digest of that sequence, so all
executors name equal prefixes alike and the tree is built by grouping, never inside one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diagtab.functions.text import let
from diagtab.llm.common import numbered, prefix_sum, written

#: Turns whose digests are chained at a time; all of a conversation are then joined once.
STRETCH = 64
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that stand for control tokens in this or other common templates; they never appear whole in a formatted text.
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>", "<|startoftext|>")


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The text with backslashes doubled and one put behind the first character of every control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    starts = "|".join(re.escape(c) for c in controls)
    return F.regexp_replace(doubled, rf"(?=(?:{starts}))(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    """The inverse of `escaped`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_in_order(rows: DataFrame) -> DataFrame:
    """One row per conversation, (conv_id, turns array of (turn, role, text)), from rows (conv_id, turn, role, text).

    Null roles and texts are empty. Turns are in order of their number, null first, then of role and text; repeated
    rows are turns of their own. A conversation, null id included, is held in one row and so bounded by its length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def prefix_tree(rows: DataFrame, controls: tuple[str, ...] = CONTROLS) -> tuple[DataFrame, DataFrame]:
    """The packed form of all conversations: (nodes, members).

    nodes (node_id, parent_id, depth, role, formatted, n, start, position, loss_start, loss_n, attends): each distinct
    prefix once, `formatted` being the text of its last turn. `start` is the first place in the packed stream of all
    nodes, depth first; `position` is the first position id, which counts from the root of the node's own path, so that
    a turn has the positions it would have in its conversation alone. Characters `loss_start` up to
    `loss_start + loss_n` of `formatted` carry loss (assistant turns). `attends` lists the stretches (start, n) of the
    packed stream that the node attends to besides its own earlier part: those of its ancestors in order, neighbours
    joined.

    members (rank, conv_id, node_id, depth): the nodes of each conversation; `rank` numbers conversations in the order
    of their paths. A node belongs to the first conversation that holds it, so nodes in the order of that rank, then
    depth, stand depth first, and no row grows with the number of conversations under a node.

    Places are counted in characters. Conversations with equal turns share all nodes. Empty in, empty out.
    """
    def chained(turns: Column) -> Column:
        """A digest for every turn that stands for it and all before it."""
        def next_digest(path: Column, before: Column, digest: Column) -> Column:
            last = F.coalesce(F.try_element_at(path, F.lit(-1)), before)
            return F.array_append(path, F.substring(F.sha2(F.concat(last, digest), 256), 1, 32))

        def stretch(own: Column, state: Column, first: Column) -> Column:
            path = F.aggregate(F.slice(own, first, F.lit(STRETCH)), F.array().cast("array<string>"),
                               lambda path, digest: next_digest(path, state.last, digest))
            return let(path, lambda p: F.struct(F.element_at(p, -1).alias("last"), F.array_append(state.paths, p).alias("paths")))

        own = F.transform(turns, lambda t: F.sha2(F.concat(F.length(t.role).cast("string"), F.lit(":"), t.role, t.text), 256))
        start = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("paths"))
        return let(own, lambda digests: F.flatten(F.aggregate(
            F.sequence(F.lit(1), F.size(digests), F.lit(STRETCH)), start, lambda state, first: stretch(digests, state, first)).paths))

    whole = turns_in_order(rows).withColumn("path", chained(F.col("turns")))
    ranked = numbered(whole, ["path", "conv_id"], "rank")
    parents = F.concat(F.array(F.lit(None).cast("string")), F.col("path"))  # one longer; the last has no turn
    steps = F.arrays_zip(F.col("turns").alias("t"), F.col("path").alias("node_id"), F.slice(parents, F.lit(1), F.size("path")).alias("parent_id"))
    each = ranked.select("rank", "conv_id", F.posexplode(steps).alias("depth", "s")).select(
        "rank", "conv_id", "depth", F.col("s.node_id").alias("node_id"), F.col("s.parent_id").alias("parent_id"),
        F.col("s.t.role").alias("role"), F.col("s.t.text").alias("text"))
    distinct = each.groupBy("node_id").agg(
        F.min("rank").alias("owner"), *[F.first(c).alias(c) for c in ("parent_id", "depth", "role", "text")])
    head = F.concat(F.lit(TURN), escaped(F.col("role"), controls), F.lit(BODY))
    body = escaped(F.col("text"), controls)
    loss = F.col("role") == "assistant"
    texts = written(distinct.select(
        "node_id", "owner", "parent_id", "depth", "role", F.concat(head, body, F.lit(END)).alias("formatted"),
        F.length(head).cast("long").alias("loss_start"), F.when(loss, F.length(body)).otherwise(0).cast("long").alias("loss_n"),
    ).withColumn("n", F.length("formatted").cast("long")))
    ordered = numbered(texts.select("node_id", "owner", "depth", "n"), ["owner", "depth"], "at")
    placed = written(prefix_sum(ordered, "at", "n", "start").select("node_id", "owner", "start", "n"))
    members = written(each.select("rank", "conv_id", "node_id", "depth"))
    lines = written(members.join(placed, "node_id"))
    step = F.struct("depth", "node_id", "start", "n", (F.col("owner") == F.col("rank")).alias("own"))
    lines = lines.groupBy("rank").agg(F.sort_array(F.collect_list(step)).alias("s"))
    spans = lines.select(*[F.col(f"s.{c}").alias(c) for c in ("node_id", "start", "n", "own")]).mapInPandas(
        _attended, "node_id string, start long, position long, attends array<struct<start: long, n: long>>")
    return written(texts.drop("owner").join(spans, "node_id")), members


def _attended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every node that a conversation owns: its place, its first position id and the joined stretches before it."""
    for batch in batches:
        out = []
        for nodes, starts, sizes, own in zip(batch["node_id"], batch["start"], batch["n"], batch["own"], strict=True):
            position, spans = 0, []
            for node, start, n, mine in zip(nodes, starts, sizes, own, strict=True):
                if mine:
                    out.append((node, start, position, [{"start": int(a), "n": int(b)} for a, b in spans]))
                position += n
                if spans and sum(spans[-1]) == start:
                    spans[-1] = (spans[-1][0], spans[-1][1] + n)
                else:
                    spans.append((start, n))
        yield pd.DataFrame(out, columns=["node_id", "start", "position", "attends"])


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Conversations from the packed form: (conv_id, formatted, turns array of (role, text), loss_text).

    A conversation's formatted text is the concatenation of its nodes; turns are parsed from that text by the template,
    and texts under the loss mask by `loss_start` and `loss_n`.
    """
    pieces = written(members.join(nodes.select("node_id", "formatted", "loss_start", "loss_n"), "node_id"))
    piece = F.struct("depth", "formatted", "loss_start", "loss_n")
    whole = pieces.groupBy("rank").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(piece)).alias("p"))
    whole = whole.select("conv_id", "p", F.array_join(F.transform("p", lambda x: x.formatted), "").alias("formatted"))
    marked = F.filter(F.split("formatted", re.escape(TURN), -1), lambda x, i: i > 0)
    turns = F.transform(marked, lambda x: F.struct(
        unescaped(F.substring_index(x, BODY, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text")))
    under = F.transform("p", lambda x: unescaped(
        F.substring(x.formatted, (x.loss_start + 1).cast("int"), x.loss_n.cast("int"))))
    return whole.select("conv_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))
