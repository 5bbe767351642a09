"""Set comparison of two diagrams of the same record.

Both sides become rows ``(keys, kind, key)`` tagged with their side; one
aggregation by that key replaces a full outer join and removes duplicates
before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup as M

KINDS = ("classes", "attributes", "relationships", "relationships_typed", "enum_values")
#: Kind of the rows that sizes are counted from, beside those of the elements.
_MARK = "_mark"
_PAIR = "struct<kind:string,key:string>"


def _line_items(legacy: bool) -> Column:
    """The (kind, key) pairs of a line."""
    line = F.col("content")

    def item(kind: str, *parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lower(F.concat_ws(".", *parts)).alias("key"))

    empty = F.array().cast(f"array<{_PAIR}>")
    head = M._class_open() | (M._top() & M._is_class_line(line))
    classes = F.when(head, F.array(item("classes", M._class_name(line)))).otherwise(empty)
    owner = F.when(M._in_class(), M._class_name(F.col("owner"))).otherwise(M._class_name(line))
    texts = F.when(M._in_class(), F.array(line)).when(M._top() & M._is_class_inline(line), M._inline_attributes(line))
    attributes = F.coalesce(
        F.transform(
            F.flatten(F.transform(texts, M.match_attribute)), lambda a: item("attributes", owner, a["name"])
        ),
        empty,
    )
    lone_class = F.regexp_extract(line, M._STANDALONE, 1)
    lone = F.when(
        M._standalone(),
        F.array(item("classes", lone_class), item("attributes", lone_class, F.regexp_extract(line, M._STANDALONE, 2))),
    ).otherwise(empty)
    skipped = line.rlike(M._ENUM_INLINE) | M._is_note_line(line) | M._is_class_line(line)

    def of_relationship(r: Column) -> Column:
        source, target = F.lower(r["source"]), F.lower(r["target"])
        pair = F.array_join(F.array_sort(F.array_distinct(F.array(source, target))), "|")
        names = F.concat(F.coalesce(r["association_members"], F.array(r["source"])), F.array(r["target"]))
        typed = F.concat_ws("|", source, target, r["kind"])
        return F.concat(
            F.transform(names, lambda n: item("classes", n)),
            F.array(
                F.struct(F.lit("relationships").alias("kind"), pair.alias("key")),
                F.struct(F.lit("relationships_typed").alias("kind"), typed.alias("key")),
            ),
        )

    linked = F.when(
        M._top() & ~skipped, F.flatten(F.transform(M.match_relationship("content", legacy), of_relationship))
    ).otherwise(empty)
    inline_enum = M._top() & line.rlike(M._ENUM_INLINE)
    member = (F.col("part") == "body") & (F.col("block") == "enum") & line.rlike(rf"^({M._ID}|\.\.\.)\z")
    enum_name = F.when(inline_enum, F.regexp_extract(line, M._ENUM_INLINE, 1)).otherwise(
        F.regexp_extract("owner", M._ENUM_HEAD, 1)
    )
    values = F.when(inline_enum, M._inline_enum_values(line)).when(member, F.array(line))
    enums = F.coalesce(F.transform(values, lambda v: item("enum_values", enum_name, v)), empty)
    return F.concat(classes, attributes, lone, linked, enums)


def _blanks() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("key")) for k in KINDS])


def element_sets(records: DataFrame, legacy: bool = False, keys: Sequence[str] = M.KEYS, col: str = "puml") -> DataFrame:
    """keys, kind, key (lower case), from one pass over the lines.

    Every record also gives one row per kind with a null key, so that empty
    sets stay visible. Pairs are undirected (a self loop is one name); only
    enumerations outside classes count.
    """
    keys = list(keys)
    found = M.explode_lines(records, col, keys).select(*keys, _line_items(legacy).alias("_items")).select(*keys, F.inline("_items"))
    return found.unionByName(records.select(*keys, F.inline(_blanks())))


def _sides(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, kind, key, in_first, in_second: one row per distinct key."""
    tagged = first.select(*on, "kind", "key", F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(
        second.select(*on, "kind", "key", F.lit(False).alias("a"), F.lit(True).alias("b"))
    )
    return tagged.groupBy(*on, "kind", "key").agg(F.max("a").alias("in_first"), F.max("b").alias("in_second"))


def set_counts(first: DataFrame, second: DataFrame, on: Sequence[str] = M.KEYS) -> DataFrame:
    """on, kind, n_first, n_second, n_both for records present on both sides (inputs from ``element_sets``)."""
    return _counted(_sides(first, second, on), on)


def _counted(sides: DataFrame, on: Sequence[str]) -> DataFrame:
    real = F.col("key").isNotNull()
    counted = sides.groupBy(*on, "kind").agg(
        F.count_if(real & F.col("in_first")).alias("n_first"),
        F.count_if(real & F.col("in_second")).alias("n_second"),
        F.count_if(real & F.col("in_first") & F.col("in_second")).alias("n_both"),
        F.max(F.col("key").isNull() & F.col("in_first") & F.col("in_second")).alias("_paired"),
    )
    return counted.filter("_paired").drop("_paired")


def jaccard_of(n_first: Column, n_second: Column, n_both: Column) -> Column:
    return (
        F.when((n_first == 0) & (n_second == 0), F.lit(1.0))
        .when((n_first == 0) | (n_second == 0), F.lit(0.0))
        .otherwise(n_both / (n_first + n_second - n_both))
    )


def jaccard(first: DataFrame, second: DataFrame, on: Sequence[str] = M.KEYS) -> DataFrame:
    """on, kind, n_first, n_second, n_both, jaccard (4 decimals); two empty sets are equal."""
    counts = set_counts(first, second, on)
    value = jaccard_of(F.col("n_first"), F.col("n_second"), F.col("n_both"))
    return counts.withColumn("jaccard", F.bround(value, 4))


def set_diff(first: DataFrame, second: DataFrame, on: Sequence[str] = M.KEYS) -> DataFrame:
    """on, kind, only_in_first, only_in_second, intersection: sorted arrays."""
    a, b = F.col("in_first"), F.col("in_second")
    real = F.col("key").isNotNull()

    def members(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(real & condition, F.col("key"))))

    grouped = _sides(first, second, on).groupBy(*on, "kind").agg(
        members(a & ~b).alias("only_in_first"),
        members(b & ~a).alias("only_in_second"),
        members(a & b).alias("intersection"),
        F.max(F.col("key").isNull() & a & b).alias("_paired"),
    )
    return grouped.filter("_paired").drop("_paired")


def set_members(first: DataFrame, second: DataFrame, on: Sequence[str] = M.KEYS) -> DataFrame:
    """on, kind, key, side (first / second / both): the difference as rows instead of arrays.

    Only records that both sides have, as in `set_diff`; the sets of one record are held together.
    """
    a, b = F.col("in_first"), F.col("in_second")
    side = F.when(a & b, "both").when(a, "first").otherwise("second")
    grouped = _sides(first, second, on).groupBy(*on, "kind").agg(
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", side.alias("side")))).alias("_members"),
        F.max(F.col("key").isNull() & a & b).alias("_paired"),
    )
    return grouped.filter("_paired").select(*on, "kind", F.inline("_members"))


def compare(first: DataFrame, second: DataFrame, on: Sequence[str] = M.KEYS, rounded: bool = True) -> DataFrame:
    """One row per record: four Jaccards and the differences of classes, attributes and pairs."""
    return _compared(_sides(first, second, on), on, rounded)


def _compared(sides: DataFrame, on: Sequence[str], rounded: bool, more: Sequence[Column] = ()) -> DataFrame:
    """``compare`` from the rows of ``_sides``, with further aggregates."""
    a, b = F.col("in_first"), F.col("in_second")
    real = F.col("key").isNotNull()
    aggs: list[Column] = [F.max(~real & a & b & F.col("kind").isin(*KINDS)).alias("_paired"), *more]
    for kind in ("classes", "attributes", "relationships", "enum_values"):
        of = real & (F.col("kind") == kind)
        value = jaccard_of(F.count_if(of & a), F.count_if(of & b), F.count_if(of & a & b))
        aggs.append((F.bround(value, 4) if rounded else value).alias(f"jaccard_{kind}"))
    for kind in ("classes", "attributes", "relationships"):
        of = real & (F.col("kind") == kind)
        for name, side in (("only_in_first", a & ~b), ("only_in_second", b & ~a), ("intersection", a & b)):
            aggs.append(F.sort_array(F.collect_list(F.when(of & side, F.col("key")))).alias(f"{name}_{kind}"))
    return sides.groupBy(*on).agg(*aggs).filter("_paired").drop("_paired")


def cross_dataset_report(records: DataFrame, first: str, second: str, legacy: bool = False, rounded: bool = True) -> DataFrame:
    """Records with the same id in two datasets: sizes, Jaccards, joined difference lists.

    Diagrams travel once, by id. One parse of both sides gives the elements and the marks that the sizes are counted from;
    they are rows of one aggregation by (id, kind, key), whose groups hold numbers only.
    """
    sides = (("first", F.col("dataset") == first), ("second", F.col("dataset") == second))
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = records.filter(sides[0][1] | sides[1][1]).select("dataset", "id", "puml").repartition(n, "id")
    head, lone, n_rels = M.class_marks(legacy)
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def row(kind: Column, key: Column, head_at: Column, lone_at: Column, rels: Column) -> Column:
        return F.struct(kind.alias("kind"), key.alias("key"), head_at.alias("head"), lone_at.alias("lone"), rels.alias("rels"))

    def plain(pairs: Column) -> Column:
        return F.transform(pairs, lambda p: row(p["kind"], p["key"], none, none, none))

    at, mark = F.col("line_no").cast("int"), F.lit(_MARK)
    marks = F.array(
        row(mark, text, none, none, n_rels.cast("int")),
        F.when(head.isNotNull(), row(mark, head, at, none, none)), F.when(lone.isNotNull(), row(mark, lone, none, at, none)))
    of_line = F.concat(plain(_line_items(legacy)), F.array_compact(marks))
    found = M.explode_lines(chosen).select(*M.KEYS, of_line.alias("_rows")).select(*M.KEYS, F.inline("_rows"))
    rows = found.unionByName(chosen.select(*M.KEYS, F.inline(plain(_blanks()))))

    def counts(name: str, of: Column) -> list[Column]:
        return [
            F.max(of).alias(f"in_{name}"), F.count(F.when(of, F.col("head"))).alias(f"{name}_heads"),
            F.min(F.when(of, F.col("head"))).alias(f"{name}_head"), F.min(F.when(of, F.col("lone"))).alias(f"{name}_lone"),
            F.sum(F.when(of, F.col("rels"))).alias(f"{name}_rels")]

    def sizes(name: str) -> list[Column]:
        marked = (F.col("kind") == _MARK) & F.col(f"in_{name}") & F.col("id").isNotNull()
        # an attribute outside bodies declares its class where no earlier line did
        created = F.col(f"{name}_lone") <= F.coalesce(f"{name}_head", f"{name}_lone")
        return [
            F.sum(F.when(marked, F.col(f"{name}_heads") + F.coalesce(created, F.lit(False)).cast("long"))).alias(f"{name}_n_classes"),
            F.sum(F.when(marked, F.coalesce(f"{name}_rels", F.lit(0)))).alias(f"{name}_n_rels")]

    met = rows.groupBy("id", "kind", "key").agg(*[c for side in sides for c in counts(*side)])
    both = _compared(met, ["id"], rounded, [c for name, _ in sides for c in sizes(name)])
    return _reported(both, [f"{name}_{c}" for name, _ in sides for c in ("n_classes", "n_rels")])


def cross_report(first: DataFrame, second: DataFrame, legacy: bool = False, rounded: bool = True) -> DataFrame:
    """id, three Jaccards, ``;``-joined class and pair differences of two record sets."""
    return _reported(compare(element_sets(first, legacy, ["id"]), element_sets(second, legacy, ["id"]), ["id"], rounded))


def _reported(both: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    return both.select(
        "id", "jaccard_classes", "jaccard_attributes", F.col("jaccard_relationships").alias("jaccard_rels"),
        F.array_join("only_in_first_classes", ";").alias("only_in_first_classes"),
        F.array_join("only_in_second_classes", ";").alias("only_in_second_classes"),
        F.array_join("only_in_first_relationships", ";").alias("only_in_first_rels"),
        F.array_join("only_in_second_relationships", ";").alias("only_in_second_rels"),
        *more,
    )


def pair_prf(pairs: DataFrame, legacy: bool = False, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """``element_prf`` of texts that stand side by side, (keys, generated, reference): both go through one parse."""
    tagged = pairs.select(*keys, F.inline(F.array(
        F.struct(F.lit(True).alias("_first"), F.col("generated").alias("puml")),
        F.struct(F.lit(False).alias("_first"), F.col("reference").alias("puml")))))
    sets = element_sets(tagged, legacy, [*keys, "_first"])
    sides = sets.groupBy(*keys, "kind", "key").agg(F.max("_first").alias("in_first"), F.max(~F.col("_first")).alias("in_second"))
    return _prf(_counted(sides, keys), keys)


def element_prf(generated: DataFrame, reference: DataFrame, legacy: bool = False, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """keys, kind, precision, recall, f1 of generated against reference records; two empty sets score 1."""
    return _prf(set_counts(element_sets(generated, legacy, keys), element_sets(reference, legacy, keys), keys), keys)


def _prf(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    g, r, both = F.col("n_first"), F.col("n_second"), F.col("n_both")
    empty = (g == 0) & (r == 0)
    precision = F.when(empty, 1.0).when(g == 0, 0.0).otherwise(both / g)
    recall = F.when(empty, 1.0).when(r == 0, 0.0).otherwise(both / r)
    f1 = F.when(empty, 1.0).when((g == 0) | (r == 0), 0.0).otherwise(2 * both / (g + r))
    return counts.select(*keys, "kind", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
