"""Scalar text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import BLOCKED_NAMES

# Unicode classes written out: Java's \w and \s are ASCII only.
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\p{Z}\t-\r\x{1C}-\x{1F}\x{85}]"
# The same characters one by one, for trimming without a regular expression.
SPACE_CHARACTERS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ASCII_WORD = r"[A-Za-z][A-Za-z0-9]*"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
FENCE = "```"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An array column that a lambda refers to may be inlined into that lambda by
    the optimizer and then be recomputed for every element; a lambda argument
    cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def place_of(numbers: Column, wanted: Column) -> Column:
    """0-based place of a number in an ascending array of numbers; null if it is not there.

    In an array without gaps the place follows from the first number; only otherwise is it searched.
    """
    guess = (wanted - F.get(numbers, F.lit(0))).cast("int")
    searched = F.nullif(F.array_position(numbers, wanted), F.lit(0).cast("long")).cast("int") - 1
    return F.when((guess >= 0) & (F.get(numbers, guess) == wanted), guess).otherwise(searched)


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends (``trim`` only knows the blank)."""
    return F.btrim(as_column(c), F.lit(SPACE_CHARACTERS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(as_column(c), F.lit(SPACE_CHARACTERS))


def words(c: Column | str) -> Column:
    """Runs of letters, digits and underscores in any script."""
    return F.regexp_extract_all(as_column(c), F.lit(f"({WORD})"), F.lit(1))


def lower_words(c: Column | str) -> Column:
    """Lower-cased ASCII words, the token form used by name matching."""
    return F.transform(F.regexp_extract_all(as_column(c), F.lit(f"({ASCII_WORD})"), F.lit(1)), F.lower)


def sentences(c: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(strip(c), rf"(?<=[.!?]){SPACE}+")


def split_identifier(name: Column | str) -> Column:
    """Lower-case parts of a camelCase / PascalCase / snake_case / kebab-case name."""
    # a capital behind a small letter or a digit begins a new part
    parts = F.regexp_extract_all(as_column(name), F.lit("([A-Za-z](?:[a-z0-9]|(?<![a-z0-9])[A-Z])*)"), F.lit(1))
    return F.transform(parts, F.lower)


def is_valid_identifier(name: Column | str) -> Column:
    name = as_column(name)
    return F.coalesce(
        name.rlike(rf"^{IDENTIFIER}\z") & ~F.lower(name).isin(*BLOCKED_NAMES), F.lit(False)
    )


def clean_requirement_text(c: Column | str) -> Column:
    """ASCII only, without ``( ) * +``; a full stop before white space is set apart."""
    ascii_only = F.regexp_replace(as_column(c), r"[^\x00-\x7F]+", "")
    return F.regexp_replace(F.regexp_replace(ascii_only, r"[()*+]", ""), rf"\.{SPACE}+", " . ")


def strip_code_fences(c: Column | str) -> Column:
    """Drop a code fence at the start of a line; a language tag behind it stays."""
    return F.regexp_replace(as_column(c), rf"(?md)^{SPACE}*{FENCE}", "")


def extract_markup_blocks(c: Column | str) -> Column:
    """All diagram blocks with their markers; an empty array when there is none."""
    return F.regexp_extract_all(as_column(c), F.lit("(?s)(@startuml.*?@enduml)"), F.lit(1))


def extract_markup_block(c: Column | str, which: str = "parser") -> Column:
    """The first diagram block.

    ``parser`` matches the markers by exact case; ``generator`` ignores case and
    trims. Null when the text holds no block.
    """
    if which == "parser":
        return null_if_blank(F.regexp_extract(as_column(c), "(?s)@startuml.*?@enduml", 0))
    if which == "generator":
        return null_if_blank(strip(F.regexp_extract(as_column(c), "(?is)@startuml.*?@enduml", 0)))
    raise ValueError(f"unknown block reader {which!r}; expected 'parser' or 'generator'")


def sanitize_token(c: Column | str) -> Column:
    """A value made safe for a path: other characters become ``_``, outer ``_`` go."""
    safe = F.regexp_replace(as_column(c), r"[^\p{L}\p{N}_.-]", "_")
    return null_if_blank(F.regexp_replace(safe, r"^_+|_+\z", ""))


def excerpt(c: Column | str, n: int = 2000) -> Column:
    return F.substring(as_column(c), 1, n)


def capitalize(c: Column | str) -> Column:
    """First character upper, the rest lower."""
    c = as_column(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def camel_term(c: Column | str) -> Column:
    """Each word capitalised, words joined."""
    parts = F.split(strip(c), rf"{SPACE}+")
    return F.array_join(F.transform(parts, capitalize), "")


def quote_cardinality(c: Column | str) -> Column:
    trimmed = strip(c)
    quoted = trimmed.startswith('"') & trimmed.endswith('"')
    return F.when(quoted, trimmed).otherwise(F.concat(F.lit('"'), trimmed, F.lit('"')))


def parse_step_reply(c: Column | str) -> Column:
    """Struct of the three things a stepwise reply may hold.

    ``class_list``: the first bracketed list, else the whole trimmed text.
    ``associations`` / ``inheritance``: the parts behind their headings; a text
    without headings is all associations; missing inheritance reads ``[]``.
    """
    text = as_column(c)
    listed = F.regexp_extract(text, r"\[([^\]]+)\]", 1)
    class_list = F.when(listed != "", F.concat(F.lit("["), strip(listed), F.lit("]"))).otherwise(strip(text))

    def after(value: Column, heading: str) -> Column:
        return F.regexp_extract(value, rf"(?s){heading}(.*)\z", 1)

    has_assoc = text.contains("ASSOCIATIONS:")
    has_inherit = text.contains("INHERITANCE:")
    assoc_tail = after(text, "ASSOCIATIONS:")
    associations = (
        F.when(has_assoc, F.substring_index(assoc_tail, "INHERITANCE:", 1))
        .when(has_inherit, F.lit(""))
        .otherwise(text)
    )
    inherit_source = F.when(has_assoc, assoc_tail).otherwise(text)
    inheritance = F.coalesce(null_if_blank(strip(after(inherit_source, "INHERITANCE:"))), F.lit("[]"))
    return F.struct(
        F.coalesce(class_list, F.lit("")).alias("class_list"),
        F.coalesce(strip(associations), F.lit("")).alias("associations"),
        F.coalesce(inheritance, F.lit("[]")).alias("inheritance"),
    )


def fill_template(template: Column | str, values: Mapping[str, Column | str]) -> Column:
    """Replace each ``{name}`` of the template by the value of its column, in the given order."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(as_column(value), F.lit("")))
    return out


def plural_cardinality(tag: Column | str) -> Column:
    return F.when(as_column(tag).isin("NNS", "NNPS"), F.lit("1..*")).otherwise(F.lit("1"))
