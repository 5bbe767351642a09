"""Stand-in views over the star-schema and document tables.

The diagram corpora themselves are not shipped, so these views derive texts,
diagrams, annotated tokens, names and run scores from whole tables. The same
definitions are written in SQL in ``checks/oracle.py``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, lower_words, sentences
from . import wordrows
from .wordrows import PREPOSITIONS, VERB_LEMMAS

#: Temporary folders of this process, where no shared folder is set.
_LOCAL: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files that a query writes and reads back, in the folder that all executors share.

    Without spark.checkpoint.dir a local session uses a temporary folder, which goes when Python ends; a cluster has none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="diagtab-"))
        folder = f"file://{_LOCAL[-1].name}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def by_record(docs: DataFrame) -> DataFrame:
    """Documents hash-partitioned by record.

    A text is a tenth of its token rows, so it is the text that travels, once;
    every later grouping by (dataset, id, ...) or join on both finds its rows in
    place. The number of partitions is given, since adaptive execution would
    choose it by the bytes of the texts, not of the tokens they become.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "doc_id")


def records(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Texts as they are stored."""
    return _as_records(documents(spark, sf_dir, only))


def documents(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The documents, or those whose doc_id is in ``only``."""
    docs = table(spark, sf_dir, "documents")
    return docs if only is None else docs.join(only, "doc_id", "left_semi")


def placed_records(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Texts for operators that group words, sentences or tokens by record."""
    return _as_records(by_record(documents(spark, sf_dir, only)))


def _as_records(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("dataset"), F.col("doc_id").alias("id"), F.col("text").alias("nlt"))


def _item(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tokens(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Annotated tokens of every sentence of every document, by a clause grammar of six tokens."""
    sents = placed_records(spark, sf_dir, only).select("dataset", "id", F.posexplode(sentences("nlt")).alias("sent_i", "_s"))

    def row(ws: Column, w: Column, r: Column) -> Column:
        verb_at = r - F.pmod(r, F.lit(6)) + 1
        return F.struct(
            r.alias("i"), w.alias("w"), F.try_element_at(ws, verb_at + 1).alias("verb"), F.size(ws).alias("n")
        )

    # the array step only pairs each word with its verb; the grammar runs on plain columns
    words = sents.select(
        "dataset", "id", "sent_i",
        F.inline(let(lower_words("_s"), lambda ws: F.transform(ws, lambda w, r: row(ws, w, r)))),
    )
    r, w = F.col("i"), F.col("w")
    j = F.pmod(r, F.lit(6))
    v = r - j + 1
    verb_lemma = _item(VERB_LEMMAS, F.pmod(F.length("verb") + v, F.lit(8)))
    prep = _item(PREPOSITIONS, F.pmod(F.length(w), F.lit(4)))
    no_verb = (j == 0) & (v >= F.col("n"))
    return words.select(
        "dataset", "id", "sent_i", "i",
        F.when(j == 4, prep).otherwise(w).alias("text"),
        F.when(j == 1, verb_lemma)
        .when(j == 4, prep)
        .when(w.endswith("s"), F.expr("left(w, length(w) - 1)"))
        .otherwise(w)
        .alias("lemma"),
        F.when(j == 1, "VERB").when(j == 4, "ADP").otherwise("NOUN").alias("pos"),
        F.when(j == 1, "VB").when(j == 4, "IN").when(w.endswith("s"), "NNS").otherwise("NN").alias("tag"),
        F.when(no_verb, "dep")
        .when(j == 0, "nsubj")
        .when(j == 1, F.when(r == 1, "ROOT").otherwise("conj"))
        .when(j == 2, F.when(verb_lemma == "be", "attr").otherwise("dobj"))
        .when(j == 3, "conj")
        .when(j == 4, "prep")
        .otherwise("pobj")
        .alias("dep"),
        F.when(no_verb, F.when(v < 6, r).otherwise(v - 6))
        .when(j.isin(0, 2, 4), v)
        .when(j == 1, F.when(r == 1, r).otherwise(v - 6))
        .otherwise(r - 1)
        .alias("head_i"),
    )


def _made(rows: DataFrame, maker, columns: str) -> DataFrame:
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(maker, f"{keys}, {columns}")


def token_rows(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The rows of ``tokens`` (or the named columns of them) for operators that pack or count them before they are exchanged.

    Made of many texts at a time. Texts are placed by record, since few row groups would give few tasks; that exchange serves all.
    """
    columns = list(columns or wordrows.TOKEN_COLUMNS)
    return _made(placed_records(spark, sf_dir, only), wordrows.tokens(columns), ", ".join(f"{c} {wordrows.TOKEN_COLUMNS[c]}" for c in columns))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity per noun token whose lemma has eight letters or more."""
    return _made(placed_records(spark, sf_dir), wordrows.entities(), "label string")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One noun chunk per subject, object and prepositional object."""
    return _made(placed_records(spark, sf_dir), wordrows.chunks(), "sent_i int, root_i int, text string")


def _next_texts(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """dataset, id and the texts of the next document: one row per record.

    Each document hands its text to its predecessor, where names are made of it; the names, more bytes than the text, do not
    travel. All rows of a record are made of one row, so no names are exchanged to find those that repeat.
    """
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("id"), "text").repartition("id")
    owners = documents(spark, sf_dir, only).select(F.col("doc_id").alias("id"), F.col("source").alias("dataset")).distinct()
    texts = docs.where(F.col("text").isNotNull()).groupBy("id").agg(F.collect_set("text").alias("texts"))
    return texts.join(owners, "id").select("dataset", "id", "texts")


def elements(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """dataset, id, kind, owner, name: classes, attributes and enum values in turn, distinct.

    Names are the camel-joined word pairs of the next document.
    """
    return _made(_next_texts(spark, sf_dir, only), wordrows.elements(), "kind string, owner string, name string")


def element_relationships(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """dataset, id, source, target, kind, label: each class tied to the next one of its document, distinct."""
    return _made(_next_texts(spark, sf_dir, only), wordrows.relationships(), "source string, target string, kind string, label string")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("nlt").mapInArrow(wordrows.vocabulary, "token string").distinct()


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("token", F.regexp_replace("token", r"s\z", "").alias("lemma"))


def inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select(
        "token", F.regexp_replace("token", r"s\z", "").alias("singular"), F.concat("token", F.lit("s")).alias("plural")
    )


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocabulary(spark, sf_dir).filter(F.length("token") >= 5)
    return v.select("token", F.expr("left(token, length(token) - 2)").alias("synonym"))


def diagrams(spark: SparkSession, sf_dir: str, side: str = "a") -> DataFrame:
    """dataset, id, puml: one diagram per customer with orders; side ``b`` leaves out every tenth order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    if side == "b":
        orders = orders.filter(F.col("o_orderkey") % 10 != 0)
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("id")
    )
    per_class = (
        orders.groupBy(F.col("o_custkey").alias("id"), class_name("o_orderpriority").alias("cls"))
        .agg(
            F.sort_array(F.collect_list("o_orderkey")).alias("keys"),
            *[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")],
        )
    )
    per_customer = per_class.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("cls", "keys", "F", "O", "P"))).alias("_c"),
        *[F.max(F.col(s) > 0).alias(s) for s in ("F", "O", "P")],
    )
    nl = "\n"
    literals = F.array_compact(F.array(*[F.when(F.col(s), F.lit("  " + s)) for s in ("F", "O", "P")]))
    class_text = F.transform(
        "_c",
        lambda c: F.concat(
            F.lit("class "), c["cls"], F.lit(" {\n"),
            F.array_join(F.transform(c["keys"], lambda k: F.concat(F.lit("  order_"), k.cast("string"), F.lit(" : Double"))), nl),
            F.lit("\n}"),
        ),
    )

    def link(c: Column, status: str, arrow: str) -> Column:
        text = F.concat(F.lit(f'Customer "1" {arrow} "'), c[status].cast("string"), F.lit('" '), c["cls"], F.lit(f" : {status}"))
        return F.when(c[status] > 0, text)

    links = F.flatten(
        F.transform("_c", lambda c: F.array_compact(F.array(link(c, "F", "*--"), link(c, "O", "--"), link(c, "P", "o--"))))
    )
    puml = F.concat_ws(
        nl,
        F.lit("@startuml"),
        F.lit("enum Status {"), F.array_join(literals, nl), F.lit("}"),
        F.lit("class Customer { }"),
        F.array_join(class_text, nl),
        F.array_join(links, nl),
        F.lit("@enduml"),
    )
    return per_customer.join(customers, "id").select("dataset", "id", puml.alias("puml"))


def loose_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, id, puml in the loose form: a comment, attributes outside bodies, a note, links and unknown lines."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("id")
    )
    per_class = orders.groupBy(F.col("o_custkey").alias("id"), class_name("o_orderpriority").alias("cls")).agg(
        F.sort_array(F.collect_list("o_orderkey")).alias("keys"),
        *[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")],
    )
    per_customer = per_class.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("cls", "keys", "F", "O", "P"))).alias("_c")
    )
    attributes = F.flatten(
        F.transform("_c", lambda c: F.transform(c["keys"], lambda k: F.concat(c["cls"], F.lit(" : order_"), k.cast("string"))))
    )
    arrows = {"F": "<--", "O": "-", "P": "--*"}

    def link(c: Column, status: str) -> Column:
        text = F.concat(
            F.lit(f'Customer "1" {arrows[status]} "'), c[status].cast("string"), F.lit('" '), c["cls"], F.lit(f" : {status}")
        )
        return F.when(c[status] > 0, text)

    links = F.flatten(F.transform("_c", lambda c: F.array_compact(F.array(*[link(c, s) for s in arrows]))))
    unknown = F.transform(F.filter("_c", lambda c: c["P"] > 0), lambda c: F.concat(F.lit("?? "), c["cls"]))
    n_orders = F.aggregate("_c", F.lit(0), lambda acc, c: acc + F.size(c["keys"]))
    head = F.array(F.lit("@startuml"), F.concat(F.lit("' customer "), F.col("id").cast("string")))
    note = F.array(F.lit("note right of Customer"), F.concat(F.lit("orders "), n_orders.cast("string")), F.lit("end note"))
    puml = F.array_join(F.concat(head, attributes, note, links, unknown, F.array(F.lit("@enduml"))), "\n")
    return per_customer.join(customers, "id").select("dataset", "id", puml.alias("puml"))


def dressed_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, reply: a fenced block with markers in capitals, all comment forms and odd lines, then a plain block."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    lines = [
        F.concat(F.lit("Intro "), key), F.lit("  ```plantuml"), F.lit("@STARTUML"), F.lit("enum E <<enum>>"),
        F.concat(F.lit("class A /' block "), F.col("o_orderstatus")), F.concat(F.lit("still "), key, F.lit(" '/ {")),
        F.concat(F.lit("n"), key, F.lit(" : Int // tail")), F.lit("}"), F.lit("// gone"), F.concat(F.lit("' note "), key), F.lit("A <--> B"),
        F.lit('A "1"*- B'), F.lit("(A, B) . C"), F.lit("<> dia"), F.lit('note "x" as N1'), F.lit("X *-> Y"), F.lit("@EndUml"), F.lit("```"),
        F.lit("@startuml"), F.concat(F.lit("class Z"), key), F.lit("@enduml"),
    ]
    return o.select("o_orderkey", F.concat_ws("\n", *lines).alias("reply"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, id, reply: the diagrams in the sectioned text form."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("id")
    )
    per_class = orders.groupBy(F.col("o_custkey").alias("id"), class_name("o_orderpriority").alias("cls")).agg(
        F.sort_array(F.collect_list("o_orderkey")).alias("keys")
    )
    per_customer = per_class.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cls", "keys"))).alias("_c"))
    classes = F.transform(
        "_c",
        lambda c: F.concat(
            c["cls"], F.lit("("),
            F.array_join(F.transform(c["keys"], lambda k: F.concat(F.lit("Double order_"), k.cast("string"))), ", "),
            F.lit(")"),
        ),
    )
    literals = F.concat(F.lit("Level("), F.array_join(F.transform("_c", lambda c: c["cls"]), ", "), F.lit(")"))
    links = F.transform(
        "_c",
        lambda c: F.when(
            F.size(c["keys"]) > 1,
            F.concat(F.lit("1 Customer contain "), F.size(c["keys"]).cast("string"), F.lit(" "), c["cls"]),
        ).otherwise(F.concat(c["cls"], F.lit(" inherit Customer"))),
    )
    reply = F.array_join(
        F.concat(
            F.array(F.lit("Here is the model."), F.lit("Enumerations:"), literals, F.lit("Classes:"), F.lit("abstract Customer()")),
            classes, F.array(F.lit("Relationships:")), links,
        ),
        "\n",
    )
    return per_customer.join(customers, "id").select("dataset", "id", reply.alias("reply"))


def class_name(priority: Column | str) -> Column:
    return F.concat(F.lit("P_"), F.regexp_replace(priority, "[^A-Za-z0-9]", "_"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored generator rows: candidate, dataset, model, run_index, three scores, error."""
    li = table(spark, sf_dir, "lineitem")
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    return li.select(
        F.col("l_returnflag").alias("candidate"),
        F.col("l_linestatus").alias("dataset"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("model"),
        (F.col("l_linenumber") % 3 + 1).alias("run_index"),
        F.col("l_orderkey").alias("id"),
        (F.col("l_discount") * 10).alias("class_score"),
        (F.col("l_tax") * 10).alias("attribute_score"),
        (F.col("l_quantity") / 50).alias("association_score"),
        F.when(failed, "empty_generated_model").alias("error"),
    )


def previous_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows from orders; several orders with one key stand for states saved over time, the newest counts."""
    return _order_jobs(spark, sf_dir).groupBy("candidate", "model", "dataset", "run_index").agg(
        F.max_by("status", F.struct("at", "o_orderkey")).alias("status"),
        F.max_by("error", F.struct("at", "o_orderkey")).alias("error"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _order_jobs(spark, sf_dir)
        .filter("status = 'done'")
        .select(
            "candidate", "model", "dataset", "run_index",
            F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("path"),
            F.col("at").alias("modified"),
        )
    )


def _order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return joined.select(
        F.col("o_orderpriority").alias("candidate"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string"))).alias("model"),
        F.col("c_mktsegment").alias("dataset"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("run_index"),
        status.alias("status"),
        F.when(status == "failed", F.concat(F.lit("rc=1\nsee log "), F.col("o_orderkey").cast("string"))).alias("error"),
        F.col("o_orderdate").alias("at"),
        "o_orderkey",
    )
