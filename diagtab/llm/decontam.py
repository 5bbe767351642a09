"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become templates: numbers, names (words with a capital) and units turn into typed placeholders. Windows of five
template words of benchmark items, and of five words in lower case, are hash-joined with those of documents, which gives
alignments; along each, all words of the item are compared, whatever their case. Where enough of an item is covered, the
words behind the placeholders are compared: a question that was filled in anew replaces each number, name or unit by the
same one everywhere, and no two by the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diagtab.llm.common import written

#: Words of a window, the least share of an item's words that must be found, and the fewest words of an item.
WINDOW, COVERAGE, LEAST = 5, 0.8, 3
#: Fewest words of a window that are no placeholder, for windows of items that have such.
LITERALS = 2
#: Most benchmark windows (three numbers each) that are broadcast; above, both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: A number with its separators, or letters.
TOKEN = r"\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+"
# Words that stand for numbers, and units of measure and money.
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
                "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty",
                "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
UNITS = ("mm", "cm", "km", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
         "centimeter", "centimeters", "kilogram", "kilograms", "milligram", "milligrams", "degree", "degrees", "celsius", "mile", "miles", "inch", "inches", "foot", "feet",
         "yard", "yards", "mg", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ounce", "ounces", "ml", "liter", "liters",
         "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent")
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"


def words(text: Column) -> Column:
    """Numbers and words of a text, as they stand."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def template(word: Column) -> Column:
    """The placeholder of a number, name or unit; any other word itself."""
    return (
        F.when(F.lower(word) != word, NAME)
        .when(word.rlike(r"^\p{N}") | word.isin(*NUMBER_WORDS), NUMBER)
        .when(word.isin(*UNITS), UNIT).otherwise(word)
    )


def _quick_template(word: Column) -> Column:
    """`template`, with the pattern tried only where the first character is no ASCII letter."""
    first = F.ascii(word)
    number = F.when(first < 58, F.lit(True)).when(first < 128, word.isin(*NUMBER_WORDS)).otherwise(word.rlike(r"^\p{N}"))
    return F.when(F.lower(word) != word, NAME).when(number, NUMBER).when(word.isin(*UNITS), UNIT).otherwise(word)


def windows(rows: DataFrame, column: str) -> DataFrame:
    """Adds `at`, `key` and `plain`, one row per window of five words of the array of words `column` and key.

    A window has the key of its template words (`plain` false) and, if another, that of its words in lower case. Window
    digests are joined from those of one, two and four words, so each word is looked at once.
    """
    def pairs(shorter: str, other: str, apart: int) -> Column:
        n = F.greatest(F.size(shorter) - apart, F.lit(0))
        left, right = F.slice(shorter, F.lit(1), F.least(n, F.size(other))), F.slice(other, F.lit(apart + 1), n)
        return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))

    def digests(each: DataFrame, name: str, word: Callable[[Column], Column]) -> DataFrame:
        held = each.columns
        one = each.select(*held, F.transform(column, lambda w: F.xxhash64(word(w))).alias("__1"))
        two = one.select(*held, "__1", pairs("__1", "__1", 1).alias("__2"))
        four = two.select(*held, "__1", pairs("__2", "__2", 2).alias("__4"))
        tail = F.slice("__1", F.lit(5), F.greatest(F.size("__1") - 4, F.lit(0)))
        five = F.zip_with(F.slice("__4", F.lit(1), F.size(tail)), tail, lambda a, b: F.xxhash64(a, b))
        return four.select(*held, five.alias(name))

    kept = rows.columns
    out = digests(digests(rows, "__t", _quick_template), "__p", F.lower)
    both = F.zip_with("__t", "__p", lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    each = out.select(*kept, F.posexplode(both).alias("at", "__k"))
    keys = F.when(F.col("__k.t") == F.col("__k.p"), F.array("__k.t")).otherwise(F.array("__k.t", "__k.p"))
    return each.select(*kept, "at", F.posexplode(keys).alias("__n", "key")).withColumn("plain", F.col("__n") == 1).drop("__n")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item, at, key) of the windows that are looked for, from items (item, w).

    Templates of windows with under LITERALS plain words say little; they are used only for items without others. Words
    in lower case are looked for in all windows.
    """
    plain = F.transform("w", lambda w: (template(w) == w).cast("int"))
    counted = items.withColumn("__plain", plain)
    each = windows(counted, "w").withColumn("literals", F.aggregate(
        F.slice("__plain", F.col("at") + 1, F.lit(WINDOW)), F.lit(0), lambda n, x: n + x)).drop("__plain", "w")
    best = each.groupBy("item").agg(F.max("literals").alias("best"))
    return each.join(best, "item").where(
        F.col("plain") | (F.col("literals") >= F.least("best", F.lit(LITERALS)))).select("item", "at", "key")


def _found(places: Column) -> Column:
    """Number of distinct item words among `places` (array of (i, mine, theirs, slot)) whose slots are consistent."""
    slots = F.array_distinct(F.transform(F.filter(places, lambda p: p.slot), lambda p: F.struct(p.mine, p.theirs)))

    def steady(p: Column) -> Column:
        return ~F.exists(slots, lambda s: ((s.mine == p.mine) & (s.theirs != p.theirs)) | ((s.mine != p.mine) & (s.theirs == p.theirs)))

    return F.size(F.array_distinct(F.transform(F.filter(places, lambda p: ~p.slot | steady(p)), lambda p: p.i)))


def _short(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Exact copies but for case of items of fewer than WINDOW words: (doc, item, n_words).

    Documents are looked at once for each length that such items have, at most WINDOW - LEAST of them.
    """
    digest = lambda w: F.xxhash64(F.array_join(F.transform(w, F.lower), " "))
    wanted = written(items.select("item", F.size("w").alias("n"), digest("w").alias("key"), F.transform("w", F.lower).alias("iw")))
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())
    hits = wanted.limit(0).select(F.lit(None).cast(texts.schema["doc"].dataType).alias("doc"), "item", F.col("n").alias("n_words"))
    for n in sizes:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        stretches = texts.select("doc", F.explode(F.transform(starts, lambda k: F.transform(F.slice("w", k, F.lit(n)), F.lower))).alias("dw"))
        met = stretches.withColumn("key", digest("dw")).join(wanted.where(F.col("n") == n), "key").where("dw = iw")
        hits = hits.union(met.select("doc", "item", F.col("n").alias("n_words")))
    return hits.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_words, n_found, coverage): the items that documents contain, one row for each pair.

    An item counts as contained if at least 0.8 of its words stand in windows of five words of the document that are the
    same but for case or as templates, and agree. A placeholder agrees if, within one alignment (documents shifted
    against the item by one number of words) or within all together, what stands for it in the item always has the same
    counterpart but for case, and the other way round; the better of the two counts. Exact copies agree in all words:
    benchmark_windows only find alignments, along which all words are then compared. Ids of documents may be of any type.

    Items of three and four words are found as a whole, exact but for case; shorter ones are too short to tell and are not
    looked for. Null texts and null ids take no part. Rows that repeat an id with one text give one row per item. Repeated
    items are found like any other. Empty in, empty out. Benchmark windows are broadcast if there are at most
    BROADCAST_WINDOWS; above, all is shuffled, and of the texts only those that met a window go on.
    """
    known = written(benchmark.select(F.col(item_col).cast("long").alias("item"), words(F.col(item_text_col)).alias("w"))
                    .where((F.size("w") >= LEAST) & F.col("item").isNotNull()).distinct())
    items, small = known.where(F.size("w") >= WINDOW), known.where(F.size("w") < WINDOW)
    keys = written(benchmark_windows(items).join(items.select("item", F.size("w").alias("n")), "item").distinct())
    fits = keys.count() <= BROADCAST_WINDOWS
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text")).where(
        "doc is not null and __text is not null").withColumn("row", F.xxhash64("__text"))
    texts = plain.select("doc", "row", words(F.col("__text")).alias("w"))
    looked = windows(texts, "w").drop("plain").withColumnRenamed("at", "place")
    shift = (F.col("place") - F.col("at")).alias("shift")
    # the words that stand opposite the item; those from the first one that is in the text
    own = F.slice("w", F.greatest("shift", F.lit(0)) + 1, F.col("n") + F.least("shift", F.lit(0))).alias("theirs")
    if fits:
        # inside one stage the array of words is only referred to, and read where a window is found
        met = looked.join(F.broadcast(keys), "key").select("doc", "row", "item", shift, "n", "w")
    else:
        met = written(looked.select("doc", "row", "place", "key").join(keys, "key").select("doc", "row", "item", shift, "n").distinct())
        held = plain.join(met.select("doc", "row").distinct(), ["doc", "row"], "left_semi")
        met = met.join(written(held).select("doc", "row", words(F.col("__text")).alias("w")), ["doc", "row"])
    hits = written(met.select("doc", "row", "item", "shift", own).distinct())
    sized = items.select("item", F.col("w").alias("iw"))
    both = hits.join(F.broadcast(sized) if fits else sized, "item")
    first = F.greatest(-F.col("shift"), F.lit(0))

    def place(theirs: Column, i: Column) -> Column:
        mine = F.get("iw", i)
        same = (F.lower(mine) == F.lower(theirs)) | (template(mine) == template(theirs))
        return F.struct(i.alias("i"), F.lower(mine).alias("mine"), F.lower(theirs).alias("theirs"), same.alias("same"),
                        (template(mine) != mine).alias("slot"))

    places = F.transform("theirs", lambda w, k: place(w, first + k))
    aligned = written(both.select("doc", "row", "item", F.size("iw").cast("long").alias("n_words"), places.alias("p")))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("p") - WINDOW + 1, F.lit(1))), lambda k: (
        F.size(F.filter(F.slice("p", k, F.lit(WINDOW)), lambda q: q.same)) == WINDOW))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda k: F.sequence(k, k + WINDOW - 1))))
    spots = written(aligned.select("doc", "row", "item", "n_words", F.transform(covered, lambda k: F.get("p", k - 1)).alias("p")))
    # the best alignment, and all together: of the latter every word with a counterpart only once, however often it stands there
    group = ["doc", "row", "item", "n_words"]
    alone = spots.select(*group, _found(F.col("p")).alias("n"))
    told = spots.select(*group, F.explode("p").alias("q")).select(*group, "q.i", "q.mine", "q.theirs", "q.slot").distinct()
    joint = told.groupBy(*group).agg(F.collect_list(F.struct("i", "mine", "theirs", "slot")).alias("p")).select(*group, _found(F.col("p")).alias("n"))
    judged = alone.union(joint).select("doc", "item", "n_words", F.col("n").cast("long").alias("n_found"))
    whole = _short(texts, small).select("doc", "item", F.col("n_words").cast("long").alias("n_words"), F.col("n_words").cast("long").alias("n_found"))
    return judged.union(whole).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "n_found",
    ).withColumn("coverage", F.col("n_found") / F.col("n_words")).where(F.col("coverage") >= COVERAGE).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("coverage", "n_words", "n_found")).alias("m")).select("doc_id", "item_id", "m.n_words", "m.n_found", "m.coverage")
