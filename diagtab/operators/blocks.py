"""Bracketed bodies inside a line array, found per record without a shuffle.

One record is one row, so its lines sit in one array. Only the few opening and
closing lines are folded in order; the lines themselves are then exploded once,
each with the body it belongs to. No window, no self-join, no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

_SEGMENTS = "array<struct<kind:string,first:int,last:int,closed:boolean>>"


def _segment(kind: Column, first: Column, last: Column, closed: Column) -> Column:
    return F.array(
        F.struct(kind.alias("kind"), first.alias("first"), last.alias("last"), closed.alias("closed"))
    )


def segments(events: Column, n_lines: Column, closed_by: dict[str, str]) -> Column:
    """Cut lines 1..n into outside stretches (kind ``top``) and bodies.

    ``events`` is an ordered ``array<struct<n:int, what:string>>`` of opening
    lines (``what`` = body kind) and closing lines (``what`` = closing mark);
    ``closed_by`` maps body kind to closing mark. Opening lines inside a body
    and stray closing lines have no effect.
    """
    outside = F.lit("")
    start = F.struct(
        outside.alias("mode"),
        F.lit(0).alias("start"),
        F.lit(1).alias("top"),
        F.array().cast(_SEGMENTS).alias("done"),
    )

    def step(acc: Column, event: Column) -> Column:
        opens = (acc["mode"] == "") & event["what"].isin(*closed_by)
        closes = F.lit(False)
        for kind, mark in closed_by.items():
            closes = closes | ((acc["mode"] == kind) & (event["what"] == mark))
        before = _segment(F.lit("top"), acc["top"], event["n"] - 1, F.lit(True))
        body = _segment(acc["mode"], acc["start"], event["n"], F.lit(True))
        return F.struct(
            F.when(opens, event["what"]).when(closes, outside).otherwise(acc["mode"]).alias("mode"),
            F.when(opens, event["n"]).otherwise(acc["start"]).alias("start"),
            F.when(closes, event["n"] + 1).otherwise(acc["top"]).alias("top"),
            F.when(opens, F.concat(acc["done"], before))
            .when(closes, F.concat(acc["done"], body))
            .otherwise(acc["done"])
            .alias("done"),
        )

    def finish(acc: Column) -> Column:
        tail = F.when(
            acc["mode"] == "", _segment(F.lit("top"), acc["top"], n_lines, F.lit(True))
        ).otherwise(_segment(acc["mode"], acc["start"], n_lines, F.lit(False)))
        return F.concat(acc["done"], tail)

    return F.aggregate(events, start, step, finish)


def segment_rows(lines: Column, cut: Column) -> Column:
    """One struct per line: number, text, its part and the body that holds it."""

    def rows(seg: Column) -> Column:
        members = F.slice(lines, seg["first"], F.greatest(F.lit(0), seg["last"] - seg["first"] + 1))

        def row(text: Column, j: Column) -> Column:
            n = seg["first"] + j
            part = (
                F.when(seg["kind"] == "top", "top")
                .when(j == 0, "open")
                .when(seg["closed"] & (n == seg["last"]), "close")
                .otherwise("body")
            )
            in_body = seg["kind"] != "top"
            return F.struct(
                n.alias("line_no"),
                text.alias("content"),
                part.alias("part"),
                F.when(in_body, seg["kind"]).alias("block"),
                F.when(in_body, F.element_at(lines, seg["first"])).alias("owner"),
                F.when(in_body, seg["first"]).alias("owner_line"),
                F.when(in_body, seg["last"]).alias("owner_end"),
                seg["closed"].alias("closed"),
            )

        return F.transform(members, row)

    return F.flatten(F.transform(cut, rows))


def explode_segments(df: DataFrame, keys: list[str], lines: str, events: str, closed_by: dict[str, str]) -> DataFrame:
    """Explode the line array column into one row per line with its body."""
    cut = df.select(
        *keys, lines, segments(F.col(events), F.size(lines), closed_by).alias("_cut")
    )
    return cut.select(*keys, F.inline(let(F.col(lines), lambda ls: segment_rows(ls, F.col("_cut")))))
