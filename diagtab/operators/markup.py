"""Class-diagram markup to element tables.

``explode_lines`` is the only step that looks at whole texts; every element
table is a projection of its rows. Parsing a corpus is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import ARROW_OF_KIND, RELATIONSHIP_KINDS
from ..functions.text import (
    IDENTIFIER,
    SPACE,
    WORD,
    as_column,
    extract_markup_block,
    null_if_blank,
    rstrip,
    strip,
)
from .blocks import explode_segments

KEYS = ["dataset", "id"]
_S = SPACE
_ID = IDENTIFIER
_SEP = "\x01"

_CLASS_HEAD = rf"(?is)^(abstract{_S}+)?class{_S}+({_ID}){_S}*(\{{)?(.*)\z"
# A class line without a body of its own: bare, ``{}``, or ``{ a; b }``.
_CLASS_LINE = rf"(?is)^(?:abstract{_S}+)?class{_S}+{_ID}{_S}*(?:\{{.*\}}.*|\}})?\z"
_CLASS_OPEN = rf"(?is)^(?:abstract{_S}+)?class{_S}+{_ID}{_S}*\{{[^}}]*\z"
_CLASS_INLINE = rf"(?is)^(?:abstract{_S}+)?class{_S}+{_ID}{_S}*\{{.*\}}.*\z"
_ENUM_HEAD = rf"^enum{_S}+({_ID}){_S}*\{{"
_ENUM_INLINE = rf"(?s)^enum{_S}+({_ID}){_S}*\{{{_S}*([^}}]+){_S}*\}}\z"
_NOTE_HEAD = rf"(?is)^note{_S}+(.+)\z"
_STANDALONE = rf"^({_ID}){_S}*:{_S}*({_ID})\z"

_CLOSED_BY = {"class": "}", "enum": "}", "note": "end note"}

# The 19 arrows in the order they are tried; the last field says
# whether the right-hand name is the source (parent, whole, or tail of the arrow).
ARROWS = (
    ("<|--", "inheritance", False),
    ("--|>", "inheritance", True),
    ("<|-", "inheritance", False),
    ("-|>", "inheritance", True),
    ("*-->", "composition", False),
    ("<--*", "composition", True),
    ("*--", "composition", False),
    ("--*", "composition", True),
    ("o-->", "aggregation", False),
    ("<--o", "aggregation", True),
    ("o--", "aggregation", False),
    ("--o", "aggregation", True),
    ("-->", "directed", False),
    ("<--", "directed", True),
    ("->", "directed", False),
    ("<-", "directed", True),
    ("..", "dependency", False),
    ("--", "association", False),
    ("-", "association", False),
)
# Arrows whose direction the older reading of the markup turns round.
_TURNED_IN_LEGACY = ("*-->", "<--*", "o-->", "<--o")


# --- comments and lines ---------------------------------------------------


def _fold_block_comments(lines: Column) -> Column:
    """``array<struct<text, comment, comment_line>>``: comment bodies blanked, lines kept.

    Runs only on texts that hold a comment opener, so the fold stays rare.
    """
    one_line = r"(?s)^(.*)/'(.*)'/(.*)\z"
    opener = rf"(?s)^(.*)/'{_S}*(.*)\z"
    closer = r"(?s)^(.*)'/(.*)\z"
    start = F.struct(
        F.lit(False).alias("inside"),
        F.lit(0).alias("since"),
        F.lit("").alias("pending"),
        F.array().cast("array<struct<text:string,comment:string,comment_line:int>>").alias("out"),
    )

    def step(acc: Column, line: Column) -> Column:
        n = F.size(acc["out"]) + 1
        whole = ~acc["inside"] & line.rlike(one_line)
        opens = ~acc["inside"] & line.contains("/'") & ~line.rlike(one_line)
        closes = acc["inside"] & line.contains("'/")
        joined = F.concat(acc["pending"], F.lit(" "))
        text = (
            F.when(whole, F.concat(F.regexp_extract(line, one_line, 1), F.regexp_extract(line, one_line, 3)))
            .when(opens, F.regexp_extract(line, opener, 1))
            .when(closes, F.regexp_extract(line, closer, 2))
            .when(acc["inside"], F.lit(""))
            .otherwise(line)
        )
        comment = F.when(whole, strip(F.regexp_extract(line, one_line, 2))).when(
            closes, strip(F.concat(joined, F.regexp_extract(line, closer, 1)))
        )
        at = F.when(whole, n).when(closes, acc["since"])
        return F.struct(
            F.when(opens, True).when(closes, False).otherwise(acc["inside"]).alias("inside"),
            F.when(opens, n).otherwise(acc["since"]).alias("since"),
            F.when(opens, F.regexp_extract(line, opener, 2))
            .when(acc["inside"] & ~closes, F.concat(joined, strip(line)))
            .otherwise(acc["pending"])
            .alias("pending"),
            F.concat(
                acc["out"],
                F.array(F.struct(text.alias("text"), comment.alias("comment"), at.alias("comment_line"))),
            ).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


_QUOTE_LINE = rf"(?s)^{_S}*'(.*)\z"
_SLASH_LINE = rf"(?s)^{_S}*//(.*)\z"
_SLASH_TAIL = r"(?s)^([^/]*)//(.*)\z"


def remove_line_comment(line: Column) -> Column:
    """Blank a whole-line comment, cut a trailing one.

    The cut is at the first apostrophe even inside a quoted text: that is how
    the corpora were read.
    """
    return (
        F.when(line.contains("'"), F.when(line.rlike(_QUOTE_LINE), "").when(
            line.rlike(_SLASH_LINE), "").otherwise(rstrip(F.substring_index(line, "'", 1))))
        .when(line.contains("//"), F.when(line.rlike(_SLASH_LINE), "").when(
            line.rlike(_SLASH_TAIL), rstrip(F.regexp_extract(line, _SLASH_TAIL, 1))).otherwise(line))
        .otherwise(line)
    )


def line_comment(line: Column) -> Column:
    """Text of the comment that ``remove_line_comment`` takes away; null when there is none."""
    quote, slash = line.rlike(_QUOTE_LINE), line.rlike(_SLASH_LINE)
    return (
        F.when(quote, strip(F.regexp_extract(line, _QUOTE_LINE, 1)))
        .when(slash, strip(F.regexp_extract(line, _SLASH_LINE, 1)))
        .when(line.contains("'"), strip(F.regexp_extract(line, r"(?s)^[^']*'(.*)\z", 1)))
        .when(line.rlike(_SLASH_TAIL), strip(F.regexp_extract(line, _SLASH_TAIL, 2)))
    )


def remove_comments(block: Column | str) -> Column:
    """Line array of a block without comments; line numbers are kept."""
    block = as_column(block)
    raw = F.split(block, "\n")
    no_blocks = F.when(
        block.contains("/'"), F.transform(_fold_block_comments(raw), lambda r: r["text"])
    ).otherwise(raw)
    return F.transform(no_blocks, remove_line_comment)


def extract_comments(records: DataFrame, col: str = "puml", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per comment of the first block: keys, line_no, comment."""
    folded = records.select(
        *keys, _fold_block_comments(F.split(extract_markup_block(col), "\n")).alias("_rows")
    )
    lines = folded.select(*keys, F.posexplode("_rows").alias("_pos", "_row"))
    at_line = F.when(
        line_comment(F.col("_row.text")).isNotNull(),
        F.array(F.struct((F.col("_pos") + 1).alias("line_no"), line_comment(F.col("_row.text")).alias("comment"))),
    ).otherwise(F.array().cast("array<struct<line_no:int,comment:string>>"))
    in_block = F.when(
        F.col("_row.comment").isNotNull(),
        F.array(F.struct(F.col("_row.comment_line").alias("line_no"), F.col("_row.comment").alias("comment"))),
    ).otherwise(F.array().cast("array<struct<line_no:int,comment:string>>"))
    return lines.select(*keys, F.inline(F.concat(in_block, at_line)))


def cleaned_lines(records: DataFrame, col: str = "puml", keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys and ``lines``, the comment-free lines of the first block; records without a block drop out."""
    blocks = records.select(*keys, extract_markup_block(col).alias("_block"))
    return blocks.filter(F.col("_block").isNotNull()).select(*keys, remove_comments("_block").alias("lines"))


def _line_event(line: Column) -> Column:
    opens_class = line.rlike(_CLASS_OPEN)
    opens_enum = line.rlike(_ENUM_HEAD) & ~line.rlike(_ENUM_INLINE)
    first = F.substring(line, 1, 1)
    return (
        F.when(line == "}", "}")
        .when(first.isin("a", "c", "A", "C") & line.contains("{") & opens_class, "class")
        .when(first.isin("e") & opens_enum, "enum")
        .when(first.isin("e", "E") & (F.lower(line) == "end note"), "end note")
        .when(first.isin("n", "N") & line.rlike(_NOTE_HEAD), "note")
    )


def explode_lines(records: DataFrame, col: str = "puml", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per meaningful line of the first block.

    Columns: keys, ``line_no`` (1-based, the start marker is line 1), ``content``
    (trimmed), ``part`` (``top`` outside bodies, ``open`` for the line that opens
    one, ``body``), ``block`` (class / enum / note), ``owner`` (opening line),
    ``owner_line``, ``owner_end``, ``closed``. Blank and marker lines are kept
    only inside notes.
    """
    keys = list(keys)
    trimmed = cleaned_lines(records, col, keys).select(*keys, F.transform("lines", strip).alias("_lines"))
    events = trimmed.select(
        *keys,
        "_lines",
        F.filter(
            F.transform(
                "_lines",
                lambda t, i: F.struct((i + 1).alias("n"), _line_event(t).alias("what"), t.contains(":").alias("colon")),
            ),
            lambda e: e["what"].isNotNull(),
        ).alias("_events"),
    )
    # A note that no later "end note" closes is a one-line note when it has a
    # colon (then it opens nothing), and swallows the rest otherwise.
    last_end = F.coalesce(
        F.array_max(F.transform(F.filter("_events", lambda e: e["what"] == "end note"), lambda e: e["n"])), F.lit(0)
    )
    events = events.withColumn("_last_end", last_end)
    events = events.withColumn(
        "_events",
        F.filter("_events", lambda e: ~((e["what"] == "note") & e["colon"] & (e["n"] > F.col("_last_end")))),
    )
    rows = explode_segments(events, keys, "_lines", "_events", _CLOSED_BY)
    meaningful = (F.col("content") != "") & ~F.col("content").rlike("^@(startuml|enduml)")
    return rows.filter((F.col("part") != "close") & (meaningful | ((F.col("block") == "note") & (F.col("part") == "body"))))


# --- line classification ----------------------------------------------------


def classify_line(content: Column | str) -> Column:
    """Kind of one line by itself, first rule that matches wins."""
    line = strip(content)
    arrows = r"<\|--|--\|>|\*--|--\*|o--|--o|-->|<--|\.\."
    plain = rf'^{WORD}{_S}*("[^"]*")?{_S}*--{_S}*("[^"]*")?{_S}*[\p{{L}}\p{{N}}_]'
    return (
        F.when(line == "", "blank")
        .when(line.startswith("@startuml") | line.startswith("@enduml"), "marker")
        .when(line.rlike(rf"(?i)^abstract{_S}+class{_S}+[\p{{L}}\p{{N}}_]"), "abstract_class")
        .when(line.rlike(rf"(?i)^class{_S}+[\p{{L}}\p{{N}}_]"), "class")
        .when(line.rlike(rf"(?i)^enum{_S}+{WORD}{_S}*\{{"), "enum")
        .when(line.rlike(rf"(?i)^note{_S}+"), "note")
        .when(F.lower(line) == "end note", "end_note")
        .when(line == "}", "body_end")
        .when(line.rlike(rf"{arrows}|^\([^)]+,[^)]+\){_S}*\.\.") | line.rlike(plain), "relationship")
        .when(
            line.rlike(rf"(?s)^(const{_S}+)?{WORD}{_S}*(:(?:{_S}|[\p{{L}}\p{{N}}_\[\]<>,])+)?({_S}*=.+)?\z"),
            "attribute",
        )
        .when(line == "...", "enum_value")
        .otherwise("unknown")
    )


def _class_name(line: Column) -> Column:
    return F.regexp_extract(line, _CLASS_HEAD, 2)


def _class_rest(line: Column) -> Column:
    return strip(F.regexp_extract(line, _CLASS_HEAD, 4))


def _is_class_line(line: Column) -> Column:
    return F.substring(line, 1, 1).isin("a", "c", "A", "C") & line.rlike(_CLASS_LINE)


def _is_class_inline(line: Column) -> Column:
    return line.contains("}") & line.rlike(_CLASS_INLINE)


def _is_note_line(line: Column) -> Column:
    return F.substring(line, 1, 1).isin("n", "N") & line.rlike(_NOTE_HEAD)


def _relationship_grammar(legacy: bool) -> tuple[str, str]:
    """One regular expression and the replacement that spreads its fields.

    The alternatives are whole-line patterns in the order of the arrow table, so
    the first arrow that explains the line wins. Only the groups of that
    alternative hold text; joining a field over all alternatives picks it.
    """
    card = rf'(?:"([^"]*)"?{_S}*)?'
    label = rf"(?:{_S}*:{_S}*(.+))?"
    alternatives = [rf"\(({_ID}){_S}*,{_S}*({_ID})\){_S}*\.\.{_S}*({_ID}){label}\z"]
    fields: list[list[int]] = [[1], [], [], [], [3], [4], [2]]
    group = 4
    for arrow, _, _ in ARROWS:
        literal = "".join("\\" + ch if ch in "|*." else ch for ch in arrow)
        if not legacy and arrow.startswith("o"):
            literal = rf'(?<=[\p{{Z}}\t"]){literal}'
        if not legacy and arrow.endswith("o"):
            literal = rf'{literal}(?=[\p{{Z}}\t"])'
        alternatives.append(rf"({_ID}){_S}*{card}({literal}){_S}*{card}({_ID}){label}\z")
        for i in range(6):
            fields[i].append(group + 1 + i)
        group += 6
    pattern = "(?s)^(?:" + "|".join(alternatives) + ")"
    return pattern, _SEP.join("".join(f"${g}" for g in groups) for groups in fields)


_GRAMMAR = {legacy: _relationship_grammar(legacy) for legacy in (False, True)}


def match_relationship(content: Column | str, legacy: bool = False) -> Column:
    """Array with the struct of a relationship line, empty for any other line.

    Parent, whole and arrow tail are always the source. ``legacy=True`` reads
    directed diamonds the other way round and lets an ``o`` of a name pass for a
    diamond, as older results did.
    """
    line = as_column(content)
    pattern, spread = _GRAMMAR[legacy]
    split = F.split(F.regexp_replace(line, pattern, spread), _SEP)
    candidate = F.when(line.contains("-") | line.contains(".."), F.array(split)).otherwise(
        F.array().cast("array<array<string>>")
    )
    kinds = F.create_map(*[F.lit(x) for arrow, kind, _ in ARROWS for x in (arrow, kind)])
    swapped = [arrow for arrow, _, swap in ARROWS if swap != (legacy and arrow in _TURNED_IN_LEGACY)]

    def fields(p: Column) -> Column:
        def field(i: int) -> Column:
            return null_if_blank(p[i])

        arrow, member = p[2], field(6)
        swap = arrow.isin(*swapped)
        joined = F.concat(F.lit("("), p[0], F.lit(", "), p[6], F.lit(")"))
        return F.struct(
            F.when(member.isNotNull(), joined).when(swap, p[4]).otherwise(p[0]).alias("source"),
            F.when(swap, p[0]).otherwise(p[4]).alias("target"),
            F.when(member.isNotNull(), "association_class").otherwise(F.try_element_at(kinds, arrow)).alias("kind"),
            F.when(swap, field(3)).otherwise(field(1)).alias("source_card"),
            F.when(swap, field(1)).otherwise(field(3)).alias("target_card"),
            null_if_blank(strip(p[5])).alias("label"),
            F.when(member.isNotNull(), F.array(p[0], p[6])).alias("association_members"),
        )

    return F.transform(F.filter(candidate, lambda p: F.size(p) == 7), fields)


def parse_relationship(content: Column | str, legacy: bool = False) -> Column:
    """Struct of one relationship line; null when the line is none."""
    return F.get(match_relationship(content, legacy), F.lit(0))


def _is_relationship_line(line: Column, legacy: bool = False) -> Column:
    return (line.contains("-") | line.contains("..")) & line.rlike(_GRAMMAR[legacy][0])


def top_kind(content: Column | str, legacy: bool = False) -> Column:
    """What a line outside bodies declares; ``unknown`` lines give warnings."""
    line = as_column(content)
    return (
        F.when(_is_class_line(line), "class")
        .when(line.rlike(_ENUM_INLINE), "enum")
        .when(_is_note_line(line), "note")
        .when(_is_relationship_line(line, legacy), "relationship")
        .when(line.rlike(_STANDALONE), "attribute")
        .otherwise("unknown")
    )


def _attribute_grammar() -> tuple[str, str]:
    """The four attribute forms in order, with the fields name, type, default, constant mark."""
    assigned = rf"(?:{_S}*={_S}*(.+))?"
    type_chars = r"[\p{L}\p{N}_\[\]<>,\p{Z}\t-\r\x{1C}-\x{1F}\x{85}]"
    constant = rf"(const){_S}+({_ID}){_S}+({_ID}){_S}*={_S}*(.+)\z"
    typed_after = rf"({_ID}){_S}*:{_S}*({type_chars}+?){assigned}\z"
    typed_before = rf"({_ID}){_S}+({_ID}){assigned}\z"
    bare = rf"({_ID})\z"
    pattern = rf"(?s)^(?!enum )(?:{constant}|{typed_after}|{typed_before}|{bare})"
    return pattern, _SEP.join(("$3$5$9$11", "$2$6$8", "$4$7$10", "$1"))


_ATTRIBUTE = _attribute_grammar()


def match_attribute(content: Column | str) -> Column:
    """Array with the struct ``name, type, default_value, is_constant``, empty for anything else."""
    pattern, spread = _ATTRIBUTE
    split = F.split(F.regexp_replace(as_column(content), pattern, spread), _SEP)

    def fields(p: Column) -> Column:
        return F.struct(
            p[0].alias("name"),
            null_if_blank(strip(p[1])).alias("type"),
            null_if_blank(strip(p[2])).alias("default_value"),
            (p[3] != "").alias("is_constant"),
        )

    return F.transform(F.filter(F.array(split), lambda p: F.size(p) == 4), fields)


def parse_attribute(content: Column | str) -> Column:
    """Struct ``name, type, default_value, is_constant`` of one attribute line; null for anything else."""
    return F.get(match_attribute(content), F.lit(0))


def _inline_attributes(line: Column) -> Column:
    body = strip(F.regexp_replace(_class_rest(line), r"\}+\z", ""))
    return F.transform(F.split(body, ";"), strip)


def _inline_enum_values(line: Column) -> Column:
    raw = F.split(F.regexp_extract(line, _ENUM_INLINE, 2), ",")
    return F.filter(F.transform(raw, strip), lambda v: v != "")


# --- element tables -----------------------------------------------------------


def _class_open() -> Column:
    return (F.col("part") == "open") & (F.col("block") == "class")


def _top() -> Column:
    return F.col("part") == "top"


def _in_class() -> Column:
    return (F.col("part") == "body") & (F.col("block") == "class")


def _standalone() -> Column:
    line = F.col("content")
    return _top() & line.rlike(_STANDALONE) & ~line.rlike(_CLASS_HEAD)


def extract_classes(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, name, is_abstract, line_no, declared.

    A line ``Class : attribute`` outside bodies declares its class when no
    earlier line did (``declared`` is false for those).
    """
    line = F.col("content")
    heads = _class_open() | (_top() & _is_class_line(line))
    rows = lines.filter(heads | _standalone()).select(
        *keys,
        F.when(heads, _class_name(line)).otherwise(F.regexp_extract(line, _STANDALONE, 1)).alias("name"),
        (heads & (F.regexp_extract(line, _CLASS_HEAD, 1) != "")).alias("is_abstract"),
        "line_no",
        heads.alias("declared"),
    )
    first = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("line_no"))
    return rows.withColumn("_n", first).filter(F.col("declared") | (F.col("_n") == 1)).drop("_n")


def extract_attributes(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, class, name, type, default_value, is_constant, line_no, pos. A narrow projection."""
    line = F.col("content")
    from_body = _in_class()
    from_inline = _top() & _is_class_inline(line)
    rows = lines.filter(from_body | from_inline | _standalone()).select(
        *keys,
        F.when(from_body, _class_name(F.col("owner")))
        .when(from_inline, _class_name(line))
        .otherwise(F.regexp_extract(line, _STANDALONE, 1))
        .alias("class"),
        "line_no",
        F.posexplode(
            F.when(from_body, F.array(line))
            .when(from_inline, _inline_attributes(line))
            .otherwise(F.array(F.regexp_extract(line, _STANDALONE, 2)))
        ).alias("pos", "_text"),
    )
    return rows.select(*keys, "class", "line_no", "pos", F.inline(match_attribute("_text")))


def extract_enum_values(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, enum, value, owner_class (of a nested enum), is_inline, line_no, pos; value null for an opening line."""
    line = F.col("content")
    inline = (_top() & line.rlike(_ENUM_INLINE)) | (_in_class() & line.rlike(_ENUM_INLINE))
    opened = (F.col("part") == "open") & (F.col("block") == "enum")
    member = (F.col("part") == "body") & (F.col("block") == "enum")
    value_pattern = rf"^({_ID}|\.\.\.)\z"
    rows = lines.filter(inline | opened | (member & line.rlike(value_pattern)))
    values = (
        F.when(inline, _inline_enum_values(line)).when(member, F.array(line))
    )
    return rows.select(
        *keys,
        F.when(inline, F.regexp_extract(line, _ENUM_INLINE, 1))
        .otherwise(F.regexp_extract(F.col("owner"), _ENUM_HEAD, 1))
        .alias("enum"),
        F.when(_in_class(), _class_name(F.col("owner"))).alias("owner_class"),
        inline.alias("is_inline"),
        F.coalesce("owner_line", "line_no").alias("_owner_line"),
        "line_no",
        F.posexplode_outer(values).alias("pos", "value"),
    )


def extract_enums(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, name, values (in order), is_inline, owner_class, line_no: one row per enumeration."""
    values = extract_enum_values(lines, keys)
    at = F.when(F.col("is_inline"), F.col("line_no")).otherwise(F.col("_owner_line"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("line_no", "pos", "value"))))
    return (
        values.withColumn("_at", at)
        .groupBy(*keys, F.col("enum").alias("name"), "owner_class", "is_inline", "_at")
        .agg(F.transform(ordered, lambda v: v["value"]).alias("values"))
        .withColumnRenamed("_at", "line_no")
    )


def extract_notes(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, position, content, line_no, closed: one row per note."""
    line = F.col("content")
    position = F.regexp_extract(F.coalesce("owner", "content"), _NOTE_HEAD, 1)
    in_note = F.col("block") == "note"
    single = _top() & _is_note_line(line)
    body = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("part") == "body", F.struct("line_no", "content")))),
        lambda r: r["content"],
    )
    notes = (
        lines.filter(in_note | single)
        .withColumn("_at", F.coalesce("owner_line", "line_no"))
        .withColumn("_head", position)
        .groupBy(*keys, "_at", "_head", F.col("block").alias("_block"), "closed")
        .agg(F.array_join(body, "\n").alias("_body"))
    )
    one_line = F.col("_block").isNull()
    tail = strip(F.regexp_extract("_head", r"(?s)^[^:]*:(.*)\z", 1))
    return notes.select(
        *keys,
        F.when(one_line, strip(F.substring_index("_head", ":", 1))).otherwise(F.col("_head")).alias("position"),
        F.when(one_line, tail).otherwise(F.col("_body")).alias("content"),
        F.col("_at").alias("line_no"),
        "closed",
    )


def extract_relationships(lines: DataFrame, legacy: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, source, target, kind, source_card, target_card, label, association_members, line_no."""
    line = F.col("content")
    rows = lines.filter(_top() & (line.contains("-") | line.contains("..")))
    rows = rows.filter(~(_is_class_line(line) | line.rlike(_ENUM_INLINE) | _is_note_line(line)))
    return rows.select(*keys, "line_no", F.inline(match_relationship("content", legacy)))


def assign_constructs(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, type, name, is_abstract, start_line, end_line of every class, enum, note and relationship."""
    line = F.col("content")
    opened = F.col("part") == "open"
    kind = F.when(opened, F.col("block")).otherwise(top_kind("content"))
    rows = lines.filter(opened | _top()).withColumn("type", kind)
    rows = rows.filter(F.col("type").isin("class", "enum", "note", "relationship"))
    return rows.select(
        *keys,
        "type",
        F.when(F.col("type") == "class", _class_name(line))
        .when(F.col("type") == "enum", F.regexp_extract(line, _ENUM_HEAD, 1))
        .alias("name"),
        ((F.col("type") == "class") & (F.regexp_extract(line, _CLASS_HEAD, 1) != "")).alias("is_abstract"),
        F.col("line_no").alias("start_line"),
        F.coalesce("owner_end", "line_no").alias("end_line"),
    )


def standalone_attributes(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Attributes written as ``Class : attribute`` outside bodies: keys, class, name, line_no."""
    line = F.col("content")
    return lines.filter(_standalone()).select(
        *keys,
        F.regexp_extract(line, _STANDALONE, 1).alias("class"),
        F.regexp_extract(line, _STANDALONE, 2).alias("name"),
        "line_no",
    )


def _mentions(lines: DataFrame, legacy: bool, keys: Sequence[str]) -> DataFrame:
    """Each name a record mentions with a flag whether it is declared, in one pass."""
    line = F.col("content")
    declares = _class_open() | (_top() & _is_class_line(line)) | _standalone()
    name = F.when(_standalone(), F.regexp_extract(line, _STANDALONE, 1)).otherwise(_class_name(line))
    skipped = line.rlike(_ENUM_INLINE) | _is_note_line(line)

    def mention(n: Column, declared: bool) -> Column:
        return F.struct(n.alias("name"), F.lit(declared).alias("declared"))

    def ends(r: Column) -> Column:
        return F.concat(
            F.coalesce(r["association_members"], F.array(r["source"])), F.array(r["target"])
        )

    linked = F.flatten(F.transform(match_relationship("content", legacy), ends))
    names = F.when(declares, F.array(mention(name, True))).when(
        _top() & ~skipped, F.transform(linked, lambda n: mention(n, False))
    )
    return lines.select(*keys, F.inline(names))


def all_class_names(lines: DataFrame, legacy: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, name, implicit: declared classes and those only named by relationships, distinct."""
    return (
        _mentions(lines, legacy, keys)
        .groupBy(*keys, "name")
        .agg((~F.max("declared")).alias("implicit"))
    )


def implicit_classes(lines: DataFrame, legacy: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, name of classes that only relationships name."""
    return all_class_names(lines, legacy, keys).filter("implicit").drop("implicit")


def all_enum_names(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, name: standalone and nested enumerations, distinct."""
    return extract_enum_values(lines, keys).select(*keys, F.col("enum").alias("name")).distinct()


def get_class(classes: DataFrame, name: str) -> DataFrame:
    return classes.filter(F.col("name") == name)


def get_enum(enums: DataFrame, name: str) -> DataFrame:
    return enums.filter(F.col("name") == name)


def relationship_endpoints(relationships: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, name, role (source / target / assoc_member), kind, card, label: one row per end."""

    def end(name: Column, role: str, card: Column) -> Column:
        return F.struct(name.alias("name"), F.lit(role).alias("role"), card.alias("card"))

    no_card = F.lit(None).cast("string")
    members = F.transform(
        F.coalesce("association_members", F.array().cast("array<string>")),
        lambda m: end(m, "assoc_member", no_card),
    )
    ends = F.concat(
        F.array(
            end(F.col("source"), "source", F.col("source_card")),
            end(F.col("target"), "target", F.col("target_card")),
        ),
        members,
    )
    return relationships.select(*keys, "line_no", "kind", "label", F.inline(ends))


def class_marks(legacy: bool = False) -> tuple[Column, Column, Column]:
    """Of a line: the class it declares, the class of an attribute outside bodies (both null if none), its relationships (0 or 1)."""
    line = F.col("content")
    heads = _class_open() | (_top() & _is_class_line(line))
    other = _top() & ~(line.rlike(_ENUM_INLINE) | _is_note_line(line) | _is_class_line(line))
    lone = F.when(_standalone(), F.regexp_extract(line, _STANDALONE, 1))
    return F.when(heads, _class_name(line)), lone, F.when(other, F.size(match_relationship("content", legacy))).otherwise(0)


def diagram_counts(lines: DataFrame, legacy: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Element counts per record from a single pass and a single aggregation.

    Map-side partial counts leave one row per record for the exchange.
    """
    line = F.col("content")
    heads = _class_open() | (_top() & _is_class_line(line))
    standalone = _standalone()
    enum = ((F.col("part") == "open") & (F.col("block") == "enum")) | (_top() & line.rlike(_ENUM_INLINE))
    other = _top() & ~(line.rlike(_ENUM_INLINE) | _is_note_line(line) | _is_class_line(line))
    inline = F.flatten(F.transform(_inline_attributes(line), match_attribute))
    attributes = (
        F.when(_in_class(), F.size(match_attribute("content")))
        .when(_top() & _is_class_inline(line), F.size(inline))
        .when(standalone, 1)
        .otherwise(0)
    )
    flat = lines.select(
        *keys,
        "line_no",
        F.when(heads, _class_name(line)).alias("_head"),
        F.when(standalone, F.regexp_extract(line, _STANDALONE, 1)).alias("_lone"),
        enum.alias("_enum"),
        attributes.alias("_n_attr"),
        F.when(other, parse_relationship("content", legacy)).alias("_rel"),
    )
    mentioned = F.when(
        F.col("_rel").isNotNull(),
        F.concat(
            F.coalesce("_rel.association_members", F.array("_rel.source")), F.array("_rel.target")
        ),
    )
    per_record = flat.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_head").isNotNull(), F.struct(F.col("_head").alias("name"), "line_no"))).alias("_heads"),
        F.collect_list(F.when(F.col("_lone").isNotNull(), F.struct(F.col("_lone").alias("name"), "line_no"))).alias("_lone"),
        F.array_distinct(F.flatten(F.collect_list(mentioned))).alias("_mentioned"),
        F.count_if("_enum").alias("n_enums"),
        F.sum("_n_attr").alias("n_attributes"),
        F.count("_rel").alias("n_relationships"),
        F.count_if(F.coalesce("_rel.source_card", "_rel.target_card").isNotNull()).alias("n_rels_with_card"),
        F.count_if(F.col("_rel.label").isNotNull()).alias("n_rels_with_label"),
        *[F.count_if(F.col("_rel.kind") == kind).alias(f"n_rels_{kind}") for kind in RELATIONSHIP_KINDS],
    )
    created = F.array_distinct(
        F.transform(
            F.filter(
                "_lone",
                lambda s: ~F.exists("_heads", lambda h: (h["name"] == s["name"]) & (h["line_no"] < s["line_no"])),
            ),
            lambda s: s["name"],
        )
    )
    declared = F.concat(F.transform("_heads", lambda h: h["name"]), created)
    return per_record.select(
        *keys,
        F.size(declared).cast("long").alias("n_classes"),
        "n_enums",
        F.size(F.array_except("_mentioned", declared)).cast("long").alias("n_implicit_classes"),
        "n_attributes",
        "n_relationships",
        "n_rels_with_card",
        "n_rels_with_label",
        *[f"n_rels_{kind}" for kind in RELATIONSHIP_KINDS],
    )


def nest_diagram(lines: DataFrame, legacy: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """One nested row per record: classes with attributes, enums, relationships, implicit classes, notes."""

    def gathered(df: DataFrame, name: str, *fields: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*fields)))
        return df.groupBy(*keys).agg(items.alias(name))

    attributes = gathered(
        extract_attributes(lines, keys), "_attributes",
        "line_no", "pos", "class", "name", "type", "default_value", "is_constant",
    )
    enums = extract_enums(lines, keys)
    classes = gathered(extract_classes(lines, keys), "_classes", "line_no", "name", "is_abstract")
    top_enums = gathered(enums.filter(F.col("owner_class").isNull()), "_enums", "line_no", "name", "values", "is_inline")
    nested = gathered(enums.filter(F.col("owner_class").isNotNull()), "_nested", "line_no", "owner_class", "name")
    rels = gathered(
        extract_relationships(lines, legacy, keys), "_rels",
        "line_no", "source", "target", "kind", "source_card", "target_card", "label", "association_members",
    )
    implicit = implicit_classes(lines, legacy, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list("name")).alias("implicit_classes")
    )
    notes = gathered(extract_notes(lines, keys), "_notes", "line_no", "content", "position")
    joined = lines.select(*keys).distinct()
    for part in (classes, attributes, top_enums, nested, rels, implicit, notes):
        joined = joined.join(part, list(keys), "left")

    def or_empty(col: str) -> Column:
        return F.coalesce(F.col(col), F.array())

    def attributes_of(c: Column) -> Column:
        mine = F.filter("_attributes", lambda a: a["class"] == c["name"])
        return F.transform(
            F.coalesce(mine, F.array()),
            lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"),
                               a["default_value"].alias("default_value"), a["is_constant"].alias("is_constant")),
        )

    def nested_of(c: Column) -> Column:
        mine = F.filter("_nested", lambda e: e["owner_class"] == c["name"])
        return F.transform(F.coalesce(mine, F.array()), lambda e: e["name"])

    return joined.select(
        *keys,
        F.transform(
            or_empty("_classes"),
            lambda c: F.struct(c["name"].alias("name"), c["is_abstract"].alias("is_abstract"),
                               attributes_of(c).alias("attributes"), nested_of(c).alias("nested_enum_names")),
        ).alias("classes"),
        F.transform(
            or_empty("_enums"),
            lambda e: F.struct(e["name"].alias("name"), e["values"].alias("values"), e["is_inline"].alias("is_inline")),
        ).alias("enums"),
        F.transform(
            or_empty("_rels"),
            lambda r: F.struct(*[r[f].alias(f) for f in (
                "source", "target", "kind", "source_card", "target_card", "label", "association_members")]),
        ).alias("relationships"),
        F.coalesce("implicit_classes", F.array().cast("array<string>")).alias("implicit_classes"),
        F.transform(
            or_empty("_notes"),
            lambda n: F.struct(n["content"].alias("content"), n["position"].alias("position")),
        ).alias("notes"),
    )


# --- problems -----------------------------------------------------------------


def parse_warnings(lines: DataFrame, legacy: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, line_no, warning: lines outside bodies that declare nothing."""
    unknown = lines.filter(_top()).filter(top_kind("content", legacy) == "unknown")
    text = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": Skipped '"), F.col("content"), F.lit("'"))
    return unknown.select(*keys, "line_no", "content", text.alias("warning"))


def no_block_error(col: str = "puml") -> Column:
    """The error of a text without a block, null for one with a block."""
    return F.when(extract_markup_block(col).isNull(), F.lit("No UML blocks found in input (missing @startuml/@enduml markers)"))


def parse_status(records: DataFrame, strict: bool = True, legacy: bool = False, col: str = "puml",
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, failed, error, n_warnings per record; never aborts the job.

    Without a block a record always fails. In strict mode the first unknown line
    or unclosed body fails it, otherwise both are tolerated.
    """
    keys = list(keys)
    lines = explode_lines(records, col, keys)
    unknown = _top() & (top_kind("content", legacy) == "unknown")
    unclosed = (F.col("part") == "open") & ~F.col("closed")
    line_no = F.col("line_no").cast("string")
    name = F.coalesce(
        F.when(F.col("block") == "class", _class_name(F.col("content"))),
        F.when(F.col("block") == "enum", F.regexp_extract("content", _ENUM_HEAD, 1)),
    )
    message = F.when(
        unknown, F.concat(F.lit("Unrecognized line "), line_no, F.lit(": '"), F.col("content"), F.lit("'"))
    ).when(
        unclosed,
        F.concat(
            F.initcap("block"), F.coalesce(F.concat(F.lit(" '"), name, F.lit("'")), F.lit("")),
            F.lit(" at line "), line_no, F.lit(" not properly closed"),
        ),
    )
    problems = (
        lines.select(*keys, "line_no", message.alias("_m"), unknown.alias("_u"))
        .groupBy(*keys)
        .agg(
            F.min_by("_m", F.when(F.col("_m").isNotNull(), F.col("line_no"))).alias("_first"),
            F.count_if("_u").alias("n_warnings"),
        )
    )
    base = records.select(*keys, no_block_error(col).alias("_no_block"))
    error = F.coalesce("_no_block", "_first") if strict else F.col("_no_block")
    return (
        base.join(problems, keys, "left")
        .select(*keys, error.alias("error"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
        .withColumn("failed", F.col("error").isNotNull())
    )


def error_context(records: DataFrame, k: int = 2, legacy: bool = False, col: str = "puml",
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, line_no, context: each unknown line between its k neighbours, marked with ``>>>``."""
    keys = list(keys)
    warnings = parse_warnings(explode_lines(records, col, keys), legacy, keys)
    numbers = warnings.groupBy(*keys).agg(F.sort_array(F.collect_list("line_no")).alias("_bad"))
    source = cleaned_lines(records, col, keys).join(numbers, keys)

    def around(n: Column) -> Column:
        first = F.greatest(F.lit(1), n - k)
        last = F.least(F.size("lines"), n + k)

        def shown(text: Column, j: Column) -> Column:
            at = first + j
            return F.concat(
                F.when(at == n, ">>> ").otherwise("    "), at.cast("string"), F.lit(": "), text
            )

        return F.array_join(F.transform(F.slice("lines", first, last - first + 1), shown), "\n")

    rows = F.transform("_bad", lambda n: F.struct(n.alias("line_no"), around(n).alias("context")))
    return source.select(*keys, F.inline(rows))


# --- rendering ------------------------------------------------------------------


def render_attribute(name: Column, type_: Column, default_value: Column, is_constant: Column) -> Column:
    text = F.concat_ws(
        " ", name, F.concat(F.lit(": "), null_if_blank(type_)), F.concat(F.lit("= "), null_if_blank(default_value))
    )
    return F.when(is_constant, F.concat(F.lit("const "), text)).otherwise(text)


def render_enum(name: Column, values: Column) -> Column:
    return F.concat(F.lit("enum "), name, F.lit(" { "), F.array_join(values, ", "), F.lit(" }"))


def render_class(name: Column, is_abstract: Column) -> Column:
    return F.concat(F.when(is_abstract, "abstract class ").otherwise("class "), name)


def render_relationship(source: Column, target: Column, kind: Column, source_card: Column, target_card: Column,
                        label: Column) -> Column:
    arrows = F.create_map(*[F.lit(x) for pair in ARROW_OF_KIND.items() for x in pair])

    def quoted(card: Column) -> Column:
        return F.concat(F.lit('"'), null_if_blank(card), F.lit('"'))

    return F.concat_ws(
        " ", source, quoted(source_card), F.coalesce(F.element_at(arrows, kind), F.lit("--")),
        quoted(target_card), target, F.concat(F.lit(": "), null_if_blank(label)),
    )


# --- graph view -------------------------------------------------------------------


def diagram_nodes(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, node, attributes (names in order)."""
    names = all_class_names(lines, keys=keys).select(*keys, F.col("name").alias("node"))
    own = (
        extract_attributes(lines, keys)
        .groupBy(*keys, F.col("class").alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "pos", "name"))).alias("_a"))
    )
    attributes = F.transform(F.coalesce("_a", F.array()), lambda a: a["name"])
    return names.join(own, [*keys, "node"], "left").select(*keys, "node", attributes.alias("attributes"))


def diagram_edges(relationships: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, source, target, type, card1, card2, label.

    Generalization runs parent to child, diamonds whole to part, associations
    both ways with their cardinalities swapped.
    """

    def edge(source: str, target: str, card1: str, card2: str) -> Column:
        return F.struct(
            F.col(source).alias("source"), F.col(target).alias("target"),
            F.col(card1).alias("card1"), F.col(card2).alias("card2"),
        )

    forward = edge("source", "target", "source_card", "target_card")
    backward = edge("target", "source", "target_card", "source_card")
    both_ways = F.col("kind").isin("association", "directed")
    rows = F.when(both_ways, F.array(forward, backward)).otherwise(F.array(forward))
    type_ = F.when(F.col("kind") == "inheritance", "generalization").when(both_ways, "association").otherwise(F.col("kind"))
    return relationships.select(*keys, "line_no", type_.alias("type"), "label", F.inline(rows))


def normalise_label(c: Column | str) -> Column:
    """Lower-case words of a label joined without blanks (see ``lexmatch.normalise_names`` for lemmas)."""
    found = F.regexp_extract_all(as_column(c), F.lit(f"({WORD})"), F.lit(1))
    return F.coalesce(F.array_join(F.transform(found, F.lower), ""), F.lit(""))


def edge_signature(type_: Column, card1: Column, card2: Column, label: Column) -> Column:
    return F.struct(
        type_.alias("type"),
        F.coalesce(card1, F.lit("")).alias("card1"),
        F.coalesce(card2, F.lit("")).alias("card2"),
        normalise_label(label).alias("label"),
    )
