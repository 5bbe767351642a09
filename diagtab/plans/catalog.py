"""The registered queries: each takes a session and a data folder and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bookkeeping as B
from ..operators import compare as X
from ..operators import extract as R
from ..operators import lexmatch as L
from ..operators import markup as M
from ..operators import quality as V
from ..operators import scoring as G
from ..operators import textprofile as P
from ..operators import treepath as D
from ..operators.packs import digests
from ..sources import files as S
from . import fixtures as fx
from . import report as A

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as long, fractions rounded, arrays joined by a bar: the form results are compared in."""
    out = []
    for name, type_ in df.dtypes:
        c = F.col(f"`{name}`")
        if type_ in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif type_ in ("double", "float"):
            c = F.round(c, digits)
        elif type_.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        out.append(c.alias(name))
    return df.select(*out)


def query(fn: Query, digits: int = 6) -> Query:
    _REGISTERED[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir), digits)
    return fn


def score_query(fn: Query) -> Query:
    """Scores have few decimals; more digits keep their means off rounding ties."""
    return query(fn, 10)


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.explode_lines(fx.diagrams(spark, sf_dir))


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.explode_lines(fx.loose_diagrams(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, attribute and endpoint names for sentence hits."""
    e = fx.elements(spark, sf_dir).filter("kind IN ('class', 'attribute')").select("dataset", "id", "kind", "name")
    r = fx.element_relationships(spark, sf_dir)
    ends = r.select("dataset", "id", F.lit("endpoint").alias("kind"), F.explode(F.array("source", "target")).alias("name"))
    return e.unionByName(ends)


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_lexicon(fx.lemmas(spark, sf_dir), fx.inflections(spark, sf_dir))


def _levels(spark: SparkSession, sf_dir: str, elements: DataFrame) -> DataFrame:
    return L.match_levels(
        elements, None, fx.synonyms(spark, sf_dir), fx.records(spark, sf_dir), lexicon=_lexicon(spark, sf_dir), sentences=False
    )


# --- text ------------------------------------------------------------------------


@query
def text_features(spark: SparkSession, d: str) -> DataFrame:
    return P.text_features(fx.records(spark, d), rounded=False)


@query
def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    return A.dataset_overview(P.text_features(fx.records(spark, d), rounded=False))


@query
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = P.split_sentences(fx.records(spark, d))
    return s.select("dataset", "id", "sent_i", F.length("sentence").alias("n_chars"), F.md5("sentence").alias("digest"))


@query
def clean_requirement_text(spark: SparkSession, d: str) -> DataFrame:
    cleaned = T.clean_requirement_text("nlt")
    return fx.records(spark, d).select("dataset", "id", F.length(cleaned).alias("n_chars"), F.md5(cleaned).alias("digest"))


@query
def split_identifier(spark: SparkSession, d: str) -> DataFrame:
    return fx.elements(spark, d).select("dataset", "id", "kind", "owner", "name", T.split_identifier("name").alias("parts"))


@query
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    return L.text_tokens(fx.records(spark, d))


@query
def name_cleaning(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer")
    return c.select(
        "c_custkey", T.sanitize_token("c_name").alias("safe"), T.camel_term(F.lower("c_mktsegment")).alias("camel"),
        T.quote_cardinality(F.col("c_nationkey").cast("string")).alias("quoted"), T.excerpt("c_name", 10).alias("short"),
        T.is_valid_identifier("c_name").alias("valid_name"), T.is_valid_identifier("c_mktsegment").alias("valid_segment"),
    )


@query
def fill_template(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    filled = T.fill_template(
        "Text {nlt} with [{classes}] and {association}",
        {"nlt": F.col("o_orderkey").cast("string"), "classes": "o_orderpriority", "association": "o_orderstatus"},
    )
    return o.select("o_orderkey", filled.alias("prompt"))


@query
def parse_step_reply(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    reply = F.concat(
        F.lit("Classes: [A, "), F.col("o_orderpriority"), F.lit("]\nASSOCIATIONS: x -- "), F.col("o_orderstatus"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nINHERITANCE:\n [B"), F.col("o_orderkey").cast("string"), F.lit("]"))).otherwise(""),
    )
    return o.select("o_orderkey", T.parse_step_reply(reply).alias("r")).select("o_orderkey", "r.*")


# --- markup ------------------------------------------------------------------------


@query
def classify_line(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("dataset", "id", "line_no", "content", M.classify_line("content").alias("kind"))


@query
def classify_loose_line(spark: SparkSession, d: str) -> DataFrame:
    return _loose(spark, d).select("dataset", "id", "line_no", "content", M.classify_line("content").alias("kind"))


@query
def assign_constructs(spark: SparkSession, d: str) -> DataFrame:
    return M.assign_constructs(_lines(spark, d))


@query
def extract_comments(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_comments(fx.loose_diagrams(spark, d))


@query
def extract_classes(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_classes(_lines(spark, d)).select("dataset", "id", "name", "is_abstract")


@query
def extract_attributes(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_attributes(_lines(spark, d)).select("dataset", "id", "class", "name", "type", "is_constant")


@query
def standalone_attributes(spark: SparkSession, d: str) -> DataFrame:
    return M.standalone_attributes(_loose(spark, d))


@query
def loose_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes outside of bodies with the classes they create."""
    lines = _loose(spark, d)
    attributes = M.extract_attributes(lines).select("dataset", "id", "class", "name", "line_no")
    return attributes.join(M.extract_classes(lines).select("dataset", "id", F.col("name").alias("class"), "declared"), ["dataset", "id", "class"])


@query
def extract_enums(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_enums(_lines(spark, d)).select("dataset", "id", "name", "values", "is_inline")


@query
def extract_notes(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_notes(_loose(spark, d)).select("dataset", "id", "position", "content", "line_no")


_REL = ["dataset", "id", "source", "target", "kind", "source_card", "target_card", "label"]


@query
def extract_relationships(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_relationships(_lines(spark, d)).select(*_REL)


@query
def directed_relationships(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_relationships(_loose(spark, d)).select(*_REL)


@query
def implicit_classes(spark: SparkSession, d: str) -> DataFrame:
    return M.implicit_classes(_loose(spark, d))


@query
def all_names(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    classes = M.all_class_names(lines).select("dataset", "id", F.lit("class").alias("kind"), "name")
    return classes.unionByName(M.all_enum_names(lines).select("dataset", "id", F.lit("enum").alias("kind"), "name"))


@query
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    rels = M.extract_relationships(_lines(spark, d))
    return M.relationship_endpoints(rels).select("dataset", "id", "name", "role", "kind", "card", "label")


@query
def diagram_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.diagram_counts(_lines(spark, d))


@query
def loose_diagram_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.diagram_counts(_loose(spark, d))


@query
def nest_diagram(spark: SparkSession, d: str) -> DataFrame:
    n = M.nest_diagram(_lines(spark, d))
    return n.select("dataset", "id", *[F.to_json(c).alias(c) for c in ("classes", "enums", "relationships", "implicit_classes", "notes")])


@query
def diagram_graph(spark: SparkSession, d: str) -> DataFrame:
    edges = M.diagram_edges(M.extract_relationships(_lines(spark, d)))
    signature = M.edge_signature(F.col("type"), F.col("card1"), F.col("card2"), F.col("label"))
    return edges.select("dataset", "id", "source", "target", signature.alias("_s")).select("dataset", "id", "source", "target", "_s.*")


@query
def diagram_nodes(spark: SparkSession, d: str) -> DataFrame:
    return M.diagram_nodes(_lines(spark, d))


@query
def render_elements(spark: SparkSession, d: str) -> DataFrame:
    rels = M.extract_relationships(_lines(spark, d))
    text = M.render_relationship(*[F.col(c) for c in ("source", "target", "kind", "source_card", "target_card", "label")])
    return rels.select("dataset", "id", text.alias("text"))


@query
def render_members(spark: SparkSession, d: str) -> DataFrame:
    """Attributes, enums and classes as single lines."""
    lines = _lines(spark, d)
    attribute = M.render_attribute(*[F.col(c) for c in ("name", "type", "default_value", "is_constant")])
    parts = [
        M.extract_attributes(lines).select("dataset", "id", F.lit("attribute").alias("kind"), attribute.alias("text")),
        M.extract_enums(lines).select("dataset", "id", F.lit("enum").alias("kind"), M.render_enum(F.col("name"), F.col("values")).alias("text")),
        M.extract_classes(lines).select("dataset", "id", F.lit("class").alias("kind"), M.render_class(F.col("name"), F.col("is_abstract")).alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def lookups(spark: SparkSession, d: str) -> DataFrame:
    """One class and one enum of every record by name."""
    lines = _lines(spark, d)
    classes = M.get_class(M.extract_classes(lines), "P_1_URGENT").select("dataset", "id", "name", F.lit("class").alias("kind"))
    enums = M.get_enum(M.extract_enums(lines), "Status").select("dataset", "id", "name", F.lit("enum").alias("kind"))
    return classes.unionByName(enums)


@query
def render_diagram(spark: SparkSession, d: str) -> DataFrame:
    """Markup to tables to markup."""
    lines = _lines(spark, d)
    return V.render_diagram(
        M.extract_classes(lines), M.extract_attributes(lines), M.extract_enums(lines), M.extract_relationships(lines)
    )


@query
def parse_warnings(spark: SparkSession, d: str) -> DataFrame:
    return M.parse_warnings(_loose(spark, d)).select("dataset", "id", "line_no", "warning")


@query
def error_context(spark: SparkSession, d: str) -> DataFrame:
    return M.error_context(fx.loose_diagrams(spark, d), 1)


@query
def strip_code_fences(spark: SparkSession, d: str) -> DataFrame:
    return fx.dressed_markup(spark, d).select("o_orderkey", T.strip_code_fences("reply").alias("text"))


@query
def extract_markup_blocks(spark: SparkSession, d: str) -> DataFrame:
    return fx.dressed_markup(spark, d).select(
        "o_orderkey", T.extract_markup_block("reply").alias("parser"), T.extract_markup_block("reply", "generator").alias("generator"),
        T.extract_markup_blocks("reply").alias("blocks"),
    )


@query
def remove_comments(spark: SparkSession, d: str) -> DataFrame:
    return fx.dressed_markup(spark, d).select("o_orderkey", M.remove_comments(T.extract_markup_block("reply", "generator")).alias("lines"))


@query
def clean_diagram_markup(spark: SparkSession, d: str) -> DataFrame:
    return fx.dressed_markup(spark, d).select("o_orderkey", V.clean_diagram_markup("reply").alias("text"))


# --- quality -------------------------------------------------------------------------


@query
def line_violations(spark: SparkSession, d: str) -> DataFrame:
    return V.line_violations(fx.loose_diagrams(spark, d))


@query
def declare_missing(spark: SparkSession, d: str) -> DataFrame:
    lines = _loose(spark, d)
    return V.declare_missing(M.extract_relationships(lines), M.extract_classes(lines))


@query
def drop_malformed_relationships(spark: SparkSession, d: str) -> DataFrame:
    return V.drop_malformed_relationships(fx.loose_diagrams(spark, d))


@query
def record_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.records(spark, d).withColumnRenamed("nlt", "puml")
    return V.record_checks(docs.unionByName(fx.diagrams(spark, d)))


@query
def strict_checks(spark: SparkSession, d: str) -> DataFrame:
    return V.strict_checks(fx.diagrams(spark, d).unionByName(fx.loose_diagrams(spark, d)))


@query
def validate(spark: SparkSession, d: str) -> DataFrame:
    return V.validate(fx.diagrams(spark, d)).select("dataset", "id", "ok", "repaired", "errors")


@query
def validate_loose(spark: SparkSession, d: str) -> DataFrame:
    return V.validate(fx.loose_diagrams(spark, d), text_length=None)


@query
def dsl_sections(spark: SparkSession, d: str) -> DataFrame:
    return V.dsl_sections(fx.replies(spark, d))


@query
def dsl_elements(spark: SparkSession, d: str) -> DataFrame:
    e = V.dsl_elements(V.dsl_sections(fx.replies(spark, d)))
    return e.select("dataset", "id", "kind", "name", "is_abstract", "member", "type")


@query
def dsl_relationships(spark: SparkSession, d: str) -> DataFrame:
    return V.dsl_relationships(V.dsl_sections(fx.replies(spark, d))).select(*_REL[:-1])


@query
def dsl_to_diagram(spark: SparkSession, d: str) -> DataFrame:
    return V.dsl_to_diagram(fx.replies(spark, d))


@query
def parse_failure_report(spark: SparkSession, d: str) -> DataFrame:
    texts = fx.diagrams(spark, d).withColumn("setting", F.lit("strict")).unionByName(
        fx.loose_diagrams(spark, d).withColumn("setting", F.lit("loose"))
    )
    status = M.parse_status(texts, keys=["dataset", "id", "setting"])
    results = status.withColumns({"model": F.col("dataset"), "pos": F.col("id")})
    report = V.parse_failure_report(results, ["dataset", "setting"])
    first = [F.col(f"first_failure.{c}").alias(f"first_{c}") for c in ("model", "setting", "error")]
    return report.select("dataset", "setting", "total", "passed", "failed", "success_pct", *first)


@query
def failure_patterns(spark: SparkSession, d: str) -> DataFrame:
    status = M.parse_status(fx.loose_diagrams(spark, d), keys=["dataset", "id"])
    return V.failure_patterns(status.withColumn("error_type", F.regexp_extract("error", r"'(\S+)", 1)))


# --- comparison ------------------------------------------------------------------------


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.element_sets(fx.diagrams(spark, d)), X.element_sets(fx.diagrams(spark, d, "b"))


@query
def element_sets(spark: SparkSession, d: str) -> DataFrame:
    return X.element_sets(fx.diagrams(spark, d)).filter("key IS NOT NULL").distinct()


@query
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    counts = X.set_counts(*_sets(spark, d))
    value = X.jaccard_of(F.col("n_first"), F.col("n_second"), F.col("n_both"))
    return counts.withColumn("jaccard", value)


@query
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return X.set_diff(*_sets(spark, d))


@query
def compare(spark: SparkSession, d: str) -> DataFrame:
    return X.compare(*_sets(spark, d), rounded=False)


@query
def set_members(spark: SparkSession, d: str) -> DataFrame:
    return X.set_members(*_sets(spark, d))


@query
def cross_report(spark: SparkSession, d: str) -> DataFrame:
    return X.cross_report(fx.diagrams(spark, d), fx.diagrams(spark, d, "b"), rounded=False)


@query
def cross_dataset_report(spark: SparkSession, d: str) -> DataFrame:
    both = fx.diagrams(spark, d).withColumn("dataset", F.lit("a")).unionByName(fx.diagrams(spark, d, "b").withColumn("dataset", F.lit("b")))
    return X.cross_dataset_report(both, "a", "b", rounded=False)


@query
def element_prf(spark: SparkSession, d: str) -> DataFrame:
    return X.element_prf(fx.diagrams(spark, d, "b"), fx.diagrams(spark, d))


# --- matching --------------------------------------------------------------------------


@query
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.sentence_stats(fx.placed_records(spark, d), _names(spark, d), fx.tokens(spark, d))


@query
def text_index(spark: SparkSession, d: str) -> DataFrame:
    return L.build_text_index(fx.records(spark, d), _lexicon(spark, d))


@query
def match_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, fx.elements(spark, d))


@query
def match_levels_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The same levels from a built index of the texts."""
    index = L.build_text_index(fx.records(spark, d), _lexicon(spark, d))
    return L.match_levels(fx.elements(spark, d), index, fx.synonyms(spark, d))


@query
def sentence_indices(spark: SparkSession, d: str) -> DataFrame:
    return L.sentence_indices(fx.elements(spark, d), fx.records(spark, d))


@query
def match_relationships(spark: SparkSession, d: str) -> DataFrame:
    m = L.match_relationships(
        fx.element_relationships(spark, d), None, fx.records(spark, d), fx.synonyms(spark, d), _lexicon(spark, d)
    )
    return m


@query
def per_element_table(spark: SparkSession, d: str) -> DataFrame:
    return L.per_element_table(
        fx.elements(spark, d), fx.element_relationships(spark, d), None, fx.records(spark, d), fx.synonyms(spark, d),
        _lexicon(spark, d),
    )


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """All names with their levels; sentence numbers are left out."""
    return L.match_all(
        fx.elements(spark, d), fx.element_relationships(spark, d), None, fx.records(spark, d), fx.synonyms(spark, d),
        _lexicon(spark, d), sentences=False,
    )


@query
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage_summary(_matched(spark, d), fx.records(spark, d), rounded=False)


@query
def absent_names(spark: SparkSession, d: str) -> DataFrame:
    return L.absent_names(_levels(spark, d, fx.elements(spark, d)))


@query
def absent_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.absent_totals(_levels(spark, d, fx.elements(spark, d)))


@query
def normalise_names(spark: SparkSession, d: str) -> DataFrame:
    return L.normalise_names(fx.elements(spark, d), "name", fx.lemmas(spark, d), ["dataset", "id", "kind", "owner", "name"])


# --- trees -------------------------------------------------------------------------------


@query
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from the first token of every sentence to each other token in reach."""
    t = fx.token_rows(spark, d)
    pairs = t.filter("i > 0").select("dataset", "id", "sent_i", F.lit(0).alias("src_i"), F.col("i").alias("tgt_i"))
    return D.bounded_tree_paths(t, pairs, 4)


@query
def class_attr_bindings(spark: SparkSession, d: str) -> DataFrame:
    return D.class_attr_bindings(fx.elements(spark, d), fx.token_rows(spark, d, _TREE))


@query
def class_attr_bindings_cross(spark: SparkSession, d: str) -> DataFrame:
    """One digest of all bindings per class, in order of the attributes."""
    b = D.class_attr_bindings(fx.elements(spark, d), fx.token_rows(spark, d, _TREE), cross=True)
    shown = F.concat_ws(":", "attribute", "hop", "sent_i", "src_i", "tgt_i", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"), "path_text")
    return digests(b.select("dataset", "id", "class", shown.alias("shown")), "class", "shown")


@query
def relationship_bindings(spark: SparkSession, d: str) -> DataFrame:
    b = D.relationship_bindings(fx.element_relationships(spark, d), fx.token_rows(spark, d, _TREE))
    each = F.transform("all_sentences", lambda s: F.concat_ws(":", s["sent_i"], s["hop"], s["src_i"], s["tgt_i"], s["path_text"]))
    return b.withColumn("all_sentences", each)


@query
def kind_coverage(spark: SparkSession, d: str) -> DataFrame:
    rels = fx.element_relationships(spark, d)
    return D.kind_coverage(fx.records(spark, d), rels, D.relationship_bindings(rels, fx.token_rows(spark, d, _TREE)), rounded=False)


def _binding_summary(spark: SparkSession, d: str, rounded: bool = False) -> DataFrame:
    e, r, t = fx.elements(spark, d), fx.element_relationships(spark, d), fx.token_rows(spark, d, _TREE)
    return D.binding_summary(
        fx.records(spark, d), e, r, D.class_attr_bindings(e, t), D.relationship_bindings(r, t), rounded
    )


@query
def binding_summary(spark: SparkSession, d: str) -> DataFrame:
    return _binding_summary(spark, d)


@query
def token_features(spark: SparkSession, d: str) -> DataFrame:
    return P.token_features(fx.token_rows(spark, d, ("sent_i", "i", "text", "lemma", "pos", "dep", "head_i")), fx.entities(spark, d), fx.chunks(spark, d), rounded=False)


@query
def style_features(spark: SparkSession, d: str) -> DataFrame:
    return P.style_features(fx.token_rows(spark, d, ("lemma", "pos", "dep")), fx.entities(spark, d), rounded=False)


@query
def mean_root_distance(spark: SparkSession, d: str) -> DataFrame:
    return P.mean_root_distance(fx.token_rows(spark, d, ("sent_i", "i", "head_i")))


@query
def token_graph(spark: SparkSession, d: str) -> DataFrame:
    sizes = P.token_graph_sizes(fx.token_rows(spark, d, ("i", "head_i")), fx.chunks(spark, d))
    return sizes.join(P.mean_children(fx.token_rows(spark, d, ("i", "head_i"))), ["dataset", "id"])


@query
def token_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.token_edges(fx.tokens(spark, d))


#: The columns of a token that paths between names are found by.
_TREE = ("sent_i", "i", "text", "lemma", "head_i")


def _gapped(t: DataFrame) -> DataFrame:
    """Tokens with numbers that ascend with gaps and start anew at another number in every sentence."""
    return t.withColumns({c: (3 * F.col(c) + 17 * F.pmod("sent_i", F.lit(11))).cast("int") for c in ("i", "head_i")})


@query
def mean_root_distance_gapped(spark: SparkSession, d: str) -> DataFrame:
    return P.mean_root_distance(_gapped(fx.token_rows(spark, d, ("sent_i", "i", "head_i"))))


@query
def class_attr_bindings_gapped(spark: SparkSession, d: str) -> DataFrame:
    return D.class_attr_bindings(fx.elements(spark, d), _gapped(fx.token_rows(spark, d, _TREE)))


@query
def extract_association_gapped(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_association(_gapped(fx.tokens(spark, d))).select("dataset", "id", "sent_i", "source", "label", "target", "source_card", "target_card")


# --- extraction ----------------------------------------------------------------------------


@query
def candidate_nouns(spark: SparkSession, d: str) -> DataFrame:
    return R.candidate_nouns(fx.tokens(spark, d)).select("dataset", "id", "sent_i", "i", "text", "lemma", "tag", "dep")


@query
def class_names(spark: SparkSession, d: str) -> DataFrame:
    return R.class_names(fx.tokens(spark, d))


@query
def promote_svo(spark: SparkSession, d: str) -> DataFrame:
    """Promotion where words that begin with t are no valid names."""
    t = fx.tokens(spark, d)
    marked = t.withColumn("text", F.when(t["text"].startswith("t"), F.concat(F.lit("-"), "text")).otherwise(t["text"]))
    return R.promote_svo(marked).select("dataset", "id", "sent_i", "i", "text", "promoted")


_RELATION = ["dataset", "id", "sent_i", "source", "label", "target", "source_card", "target_card"]


@query
def extract_association(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_association(fx.tokens(spark, d)).select(*_RELATION)


@query
def extract_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_aggregation(fx.tokens(spark, d)).select(*_RELATION)


@query
def extract_composition(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_composition(fx.tokens(spark, d)).select(*_RELATION)


@query
def extract_include(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_include(fx.tokens(spark, d)).select(*_RELATION)


@query
def extract_generalization(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_generalization(fx.tokens(spark, d)).select("dataset", "id", "sent_i", "source", "target")


@query
def relations_to_diagram(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the markup in order of the alphabet, as one digest."""
    out = R.relations_to_diagram(fx.records(spark, d), fx.token_rows(spark, d))
    lines = F.sort_array(F.split("generated", "\n"))
    return out.select("dataset", "id", "failed", "error", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@query
def relations_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Rules to markup, read back by the parser."""
    out = R.relations_to_diagram(fx.records(spark, d), fx.token_rows(spark, d))
    made = out.filter(~F.col("failed")).select("dataset", "id", F.col("generated").alias("puml"))
    counts = M.diagram_counts(M.explode_lines(made)).select(
        "dataset", "id", "n_classes", "n_relationships", "n_rels_association", "n_rels_aggregation", "n_rels_composition",
        "n_rels_inheritance", "n_implicit_classes",
    )
    return out.select("dataset", "id", "failed", "error").join(counts, ["dataset", "id"], "left")


# --- scores ----------------------------------------------------------------------------------


@query
def bucketise(spark: SparkSession, d: str) -> DataFrame:
    s = G.long_scores(fx.scores(spark, d), ["candidate", "dataset"])
    return s.groupBy("candidate", "dataset", "element", G.bucketise("score").alias("bucket"), G.bucket_label("score").alias("label")).agg(
        F.count("*").alias("n")
    )


@score_query
def summarise(spark: SparkSession, d: str) -> DataFrame:
    return G.summarise(fx.scores(spark, d))


@score_query
def bucket_table(spark: SparkSession, d: str) -> DataFrame:
    return G.bucket_table(fx.scores(spark, d))


@query
def error_table(spark: SparkSession, d: str) -> DataFrame:
    return G.error_table(fx.scores(spark, d))


@query
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    error = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("exception: Timeout: "), F.col("o_orderkey").cast("string")))
        .when(F.col("o_orderpriority") == "1-URGENT", "plantuml_validator: line 1")
        .when(F.col("o_orderpriority") == "2-HIGH", "step1_no_classes")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "zero_shot_no_plantuml")
        .when(F.col("o_orderpriority") == "5-LOW", "no_relations")
    )
    rows = o.select(F.col("o_orderpriority").alias("candidate"), F.col("o_orderstatus").alias("dataset"), error.alias("error"))
    return G.error_taxonomy(rows)


@query
def failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return G.failure_rate(fx.scores(spark, d))


@query
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    s = fx.scores(spark, d).withColumns(
        {"failed": F.col("id") % 10 == 0, "elapsed_seconds": (F.col("id") % 7).cast("double")}
    )
    return G.run_totals(s)


@query
def build_run_records(spark: SparkSession, d: str) -> DataFrame:
    r = G.build_run_records(fx.scores(spark, d))
    nested = [F.col(f"{group}.{c}").alias(f"{name}_{c}") for group, name in (("scores", "s"), ("buckets", "b"))
              for c in (*G.SCORE_ELEMENTS, *(["error"] if group == "scores" else []))]
    return r.select("candidate", "dataset", "model", "run_index", "id", *nested)


@score_query
def per_run_table(spark: SparkSession, d: str) -> DataFrame:
    return G.per_run_table(fx.scores(spark, d))


@score_query
def run_stability(spark: SparkSession, d: str) -> DataFrame:
    return G.run_stability(fx.scores(spark, d))


@score_query
def baseline_gap(spark: SparkSession, d: str) -> DataFrame:
    return G.baseline_gap(fx.scores(spark, d), "A")


@score_query
def mean_pivot(spark: SparkSession, d: str) -> DataFrame:
    return G.mean_pivot(fx.scores(spark, d))


@score_query
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return G.leaderboard(fx.scores(spark, d))


@query
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = fx.diagrams(spark, d).select("dataset", "id", F.col("puml").alias("reference"))
    b = fx.diagrams(spark, d, "b").select("dataset", "id", F.col("puml").alias("generated"))
    s = G.score_pairs(a.join(b, ["dataset", "id"], "left"))
    return s


@query
def generate(spark: SparkSession, d: str) -> DataFrame:
    """A Python candidate over every record; it fails on texts without a full stop."""

    def first_words(text):
        if "." not in text:
            raise ValueError("no sentence")
        words = text.split()
        return {"generated": f"@startuml\nclass W{len(words)}\n@enduml", "raw_excerpt": text}

    out = G.generate(fx.records(spark, d), first_words)
    return out.select("dataset", "id", "failed", "error", F.length("generated").alias("n_chars"))


@query
def generate_constant(spark: SparkSession, d: str) -> DataFrame:
    return G.generate(fx.records(spark, d), "constant").drop("nlt", "elapsed_seconds")


@query
def annotate(spark: SparkSession, d: str) -> DataFrame:
    return P.annotate(fx.placed_records(spark, d))


# --- sources and sinks: what is written comes back --------------------------------------------


def _blocks(rows: DataFrame, group: list, order: str, text: Column, head: str, tail: str, size: int = 1000) -> DataFrame:
    """group, _block, value: JSON texts of at most `size` numbers of `order`, comma-joined between head and tail."""
    block = F.floor(F.col(order) / size).cast("long").alias("_block")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(*group, block).agg(F.concat(
        F.lit(head), F.array_join(F.transform(listed, lambda x: x["t"]), ",\n"), F.lit(tail)).alias("value"))


@query
def read_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every source as a folder of JSON array files, read back by name."""
    root = fx.scratch(spark, "corpora")
    docs = fx.table(spark, d, "documents")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("nlt"), F.upper("lang").alias("puml")))
    files = _blocks(docs, ["source"], "doc_id", record, "[", "]")
    files.write.partitionBy("source", "_block").text(root)
    names = sorted(r.source for r in docs.select("source").distinct().collect())
    out = S.read_corpus(spark, {n: f"{root}/source={n}" for n in names})
    return out.select("dataset", "id", "nlt", "puml")


@query
def read_model_tree(spark: SparkSession, d: str) -> DataFrame:
    """A folder per supplier, written and read back with its metadata."""
    s, n = fx.table(spark, d, "supplier"), fx.table(spark, d, "nation")
    models = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("id"), F.concat("s_name", F.lit("\n"), "n_name").alias("description"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("@startuml\nclass "), F.regexp_replace("n_name", r"\W", "_"), F.lit("\n@enduml"))).alias("plantuml"),
        F.concat(F.lit("name: "), "s_name", F.lit("\nsource: http://x:"), F.col("s_nationkey").cast("string"), F.lit("\nname: second")).alias("metadata"))
    root = fx.scratch(spark, "models")
    S.write_model_tree(models, root)
    out = S.read_model_tree(spark, root, folders=True)
    return out.select("id", "description", "plantuml", *[F.col("metadata")[k].alias(k) for k in ("name", "source")])


@query
def read_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored runs as nested files, many records each; files of another metric are marked."""
    root = fx.scratch(spark, "scored")
    s = fx.scores(spark, d).withColumn("file", F.col("id") % 8)
    scores = F.struct("class_score", "attribute_score", "association_score", "error")
    record = F.struct(F.col("id").cast("string").alias("id"), F.col("error").isNotNull().alias("failed"), scores.alias("scores"))
    runs = s.groupBy("candidate", "dataset", "file").agg(F.collect_list(record).alias("records")).select(
        "candidate", "dataset", F.when(F.col("file") > 0, "element_f1").otherwise("other").alias("metric_name"), "records",
        F.concat_ws("-", "candidate", "dataset", "file").alias("run"))
    runs.write.partitionBy("run").json(root)
    out = S.read_scored(spark, f"{root}/*/*.json", "element_f1", strict=False)
    return out.select("candidate", "dataset", "id", "failed", "class_score", "attribute_score", "association_score", "error", "metric_mismatch")


@query
def read_joblist(spark: SparkSession, d: str) -> DataFrame:
    """Job states as maps in several files with entries that are no jobs."""
    root = fx.scratch(spark, "jobs")
    o = fx.table(spark, d, "orders")
    state = F.to_json(F.struct(
        F.col("o_orderpriority").alias("candidate_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("run_index"),
        F.col("o_totalprice").alias("wall_seconds")))
    entry = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('": '), F.when(F.col("o_orderkey") % 50 == 0, F.lit("5")).otherwise(state))
    _blocks(o, [], "o_orderkey", entry, '{"jobs": {', "}}").write.partitionBy("_block").text(root)
    out = S.read_joblist(spark, f"{root}/*/*.txt")
    return out.select("key", "candidate_id", "status", "run_index", "wall_seconds", "llm")


@query
def read_examples(spark: SparkSession, d: str) -> DataFrame:
    """Worked examples of one file per customer segment."""
    root = fx.scratch(spark, "examples")
    c = fx.table(spark, d, "customer")
    example = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("nlt"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).alias("model")))
    _blocks(c, ["c_mktsegment"], "c_custkey", example, '{"examples": [', "]}").write.partitionBy("c_mktsegment", "_block").text(root)
    out = S.read_examples(spark, f"{root}/*/*/*.txt", "shots")
    return out.select("strategy", "id", "nlt", "model")


@query
def write_run(spark: SparkSession, d: str) -> DataFrame:
    """Run artefacts with null fields in one folder per candidate, dataset and run."""
    root = fx.scratch(spark, "runs")
    s = fx.scores(spark, d).select("candidate", "dataset", "run_index", "id", "class_score", "error")
    S.write_run(s, root)
    schema = "id long, class_score double, error string, candidate string, dataset string, run_index long"
    return spark.read.schema(schema).json(root).select("candidate", "dataset", "run_index", "id", "class_score", "error")


@query
def read_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Nested results per record under their key."""
    root = fx.scratch(spark, "sidecar")
    r = fx.records(spark, d).select("dataset", "id", F.slice(T.sentences("nlt"), 1, 3).alias("sentences"), F.struct(F.length("nlt").alias("n")).alias("sizes"))
    S.write_sidecar(r, root)
    out = S.read_sidecar(spark, root, "key string, dataset string, id long, sentences array<string>, sizes struct<n: long>")
    return out.select("key", "dataset", "id", "sentences", "sizes.n")


@query
def read_table_csv(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks through a CSV table."""
    root = fx.scratch(spark, "table")
    docs = fx.table(spark, d, "documents").select("doc_id", "source", "text", (F.col("n_chars") / 7).alias("share"))
    S.write_table_csv(docs, root)
    return S.read_table_csv(spark, root, docs.schema)


@query
def generate_with_settings(spark: SparkSession, d: str) -> DataFrame:
    """A registered candidate: settings it does not know and null ones are left out; the whole output is compared."""

    def first_words(text, n=1, mark="?"):
        return {"generated": " ".join(text.split()[:n]) + mark, "raw_excerpt": text}

    G.register_candidate("first_words", first_words, n=3, mark=None, temperature=0.5)
    out = G.generate(fx.records(spark, d), "first_words", excerpt_length=None)
    return out.select("dataset", "id", "generated", "failed", "error", "raw_excerpt")


@query
def score_with_metric(spark: SparkSession, d: str) -> DataFrame:
    """A second metric by name: equal lengths of texts and diagrams."""
    def lengths(pairs: DataFrame) -> DataFrame:
        same = (F.length("reference") == F.length("generated")).cast("double")
        share = F.least(F.length("reference"), F.length("generated")) / F.greatest(F.length("reference"), F.length("generated"))
        return pairs.select("dataset", "id", same.alias("class_score"), share.alias("attribute_score"), F.lit(0.5).alias("association_score"))

    G.register_metric("lengths", lengths)
    c = fx.table(spark, d, "customer")
    diagram = lambda name: F.concat(F.lit("@startuml\nclass "), name, F.lit("\n@enduml"))
    pairs = c.select(
        F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("id"), diagram(F.col("c_mktsegment")).alias("reference"),
        F.when(F.col("c_custkey") % 5 > 0, diagram(F.concat(F.lit("N"), F.col("c_custkey").cast("string")))).alias("generated"))
    s = G.score_pairs(pairs, "lengths")
    return s.select("dataset", "id", "class_score", "attribute_score", "association_score", "error")


@query
def explode_settings_filtered(spark: SparkSession, d: str) -> DataFrame:
    """One setting of all models, and the references alone."""
    c = fx.table(spark, d, "customer")
    models = c.select(F.col("c_name").alias("model"), F.col("c_mktsegment").alias("reference"), F.create_map(
        F.lit("0shot"), F.lower("c_name"), F.lit("1shot"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise("")).alias("generated"))
    return S.explode_settings(models, setting="1shot").union(S.explode_settings(models, references_only=True))


# --- runs ------------------------------------------------------------------------------------


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are the order priorities; the last one uses no model; datasets are the segments seen with them."""
    orders = fx.table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    customers = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    per = orders.join(customers, "o_custkey").groupBy(F.col("o_orderpriority").alias("candidate")).agg(
        F.sort_array(F.collect_set("c_mktsegment")).alias("datasets")
    )
    candidates = per.withColumn("uses_model", F.col("candidate") != "5-LOW")
    return B.expand_matrix(candidates, ["m1", "m2", "m3"], F.col("datasets"), 3)


@query
def expand_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query
def reconcile_jobs(spark: SparkSession, d: str) -> DataFrame:
    return B.reconcile_jobs(_plan(spark, d), fx.previous_jobs(spark, d))


@query
def find_artifact(spark: SparkSession, d: str) -> DataFrame:
    return B.find_artifact(_plan(spark, d), fx.artifacts(spark, d))


@query
def resume_status(spark: SparkSession, d: str) -> DataFrame:
    return B.resume_status(B.reconcile_jobs(_plan(spark, d), fx.previous_jobs(spark, d)), fx.artifacts(spark, d))


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.status_counts(fx.previous_jobs(spark, d))


@query
def failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    return B.failed_jobs(fx.previous_jobs(spark, d))


@query
def exclude_examples(spark: SparkSession, d: str) -> DataFrame:
    labels = fx.table(spark, d, "labels")
    examples = labels.select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("strategy"), F.col("doc_id").alias("id"))
    records = fx.records(spark, d).select("dataset", "id", F.explode(F.array(F.lit("q0"), F.lit("q1"))).alias("strategy"))
    return B.exclude_examples(records, examples)


@query
def exclude_listed(spark: SparkSession, d: str) -> DataFrame:
    return B.exclude_listed(fx.records(spark, d).select("dataset", "id"), F.array(*[F.lit(i).cast("long") for i in (0, 3, 50)]))


@query
def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    examples = fx.table(spark, d, "benchmark").select(
        F.concat(F.lit("s"), (F.col("item_id") % 8).cast("string")).alias("strategy"), F.col("item_id").alias("pos"),
        F.col("text").alias("nlt"), F.lit("@startuml\n@enduml").alias("model"),
    )
    records = fx.records(spark, d).withColumn("strategy", F.concat(F.lit("s"), (F.col("id") % 10).cast("string")))
    p = B.build_prompts(records, examples)
    return p.select("dataset", "id", "strategy", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def flatten_chat(spark: SparkSession, d: str) -> DataFrame:
    return B.flatten_chat(fx.table(spark, d, "conversations"))


@query
def settings_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    text = F.concat(F.lit('{"model": "m'), (F.col("o_custkey") % 3).cast("string"), F.lit('", "seed": '), F.col("o_orderkey").cast("string"), F.lit("}"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", text).alias("settings_json"), (F.col("o_orderkey") % 5).alias("limit"))
    s = rows.select("o_orderkey", S.settings_with_defaults().alias("s")).select("o_orderkey", "s.*")
    return s.select("o_orderkey", "uses_llm", "model", "seed", "temperature", "limit")


@query
def run_identity(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    return o.withColumns(S.run_identity("o_orderdate", "element_f1", "1")).select("o_orderkey", "run_id", "timestamp_utc", "metric.name", "metric.version")


@query
def limit_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    r = fx.records(spark, d).select("dataset", "id", F.col("id").alias("pos"))
    return S.limit_per_dataset(r, 3).drop("pos")


@query
def explode_settings(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer")
    even = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    models = c.select(
        F.col("c_custkey").alias("model"), F.col("c_mktsegment").alias("reference"),
        F.create_map(F.lit("0shot"), F.lower("c_name"), F.lit("1shot"), even).alias("generated"),
    )
    return S.explode_settings(models)


# --- reports -----------------------------------------------------------------------------------


@query
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.kind_counts(M.diagram_counts(_lines(spark, d)))


@query
def diagram_overview(spark: SparkSession, d: str) -> DataFrame:
    return A.dataset_overview(M.diagram_counts(_lines(spark, d)))


@query
def cardinality_patterns(spark: SparkSession, d: str) -> DataFrame:
    return A.cardinality_patterns(M.extract_relationships(_lines(spark, d)))


@query
def attribute_type_counts(spark: SparkSession, d: str) -> DataFrame:
    both = M.extract_attributes(_lines(spark, d)).unionByName(M.extract_attributes(_loose(spark, d)))
    return A.attribute_type_counts(both)


def _coverage_wide(spark: SparkSession, d: str) -> DataFrame:
    cov = L.coverage_summary(_matched(spark, d), fx.records(spark, d), rounded=False)
    return cov.groupBy("dataset", "id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("pct_l1"))).alias(f"cov_{k}_l1") for k in L.KINDS],
        *[F.max(F.when(F.col("kind") == k, F.col("pct_absent"))).alias(f"cov_{k}_absent") for k in L.KINDS],
    )


@query
def coverage_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage_by_dataset(_coverage_wide(spark, d), rounded=False)


@query
def binding_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return A.binding_by_dataset(_binding_summary(spark, d), rounded=False)


@query
def kind_coverage_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    rels = fx.element_relationships(spark, d)
    cov = D.kind_coverage(fx.records(spark, d), rels, D.relationship_bindings(rels, fx.token_rows(spark, d, _TREE)), rounded=False)
    return A.kind_coverage_by_dataset(cov, rounded=False)


@query
def style_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return A.style_by_dataset(P.style_features(fx.token_rows(spark, d, ("lemma", "pos", "dep")), fx.entities(spark, d), rounded=False), rounded=False)


@query
def sentence_report(spark: SparkSession, d: str) -> DataFrame:
    return A.sentence_report(P.sentence_stats(fx.placed_records(spark, d), _names(spark, d)), rounded=False)


@query
def warning_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.warning_totals(M.parse_warnings(_loose(spark, d)))


@query
def warning_samples(spark: SparkSession, d: str) -> DataFrame:
    return A.warning_samples(M.parse_warnings(_loose(spark, d)))


@query
def warning_top_records(spark: SparkSession, d: str) -> DataFrame:
    return A.warning_top_records(M.parse_warnings(_loose(spark, d)))


@query
def jaccard_report(spark: SparkSession, d: str) -> DataFrame:
    cross = X.cross_report(fx.diagrams(spark, d), fx.diagrams(spark, d, "b"), rounded=False)
    return A.jaccard_report(cross, rounded=False)


@query
def imperfect_records(spark: SparkSession, d: str) -> DataFrame:
    return A.imperfect_records(X.cross_report(fx.diagrams(spark, d), fx.diagrams(spark, d, "b"), rounded=False))


@query
def lowest_records(spark: SparkSession, d: str) -> DataFrame:
    both = fx.diagrams(spark, d).withColumn("dataset", F.lit("a")).unionByName(fx.diagrams(spark, d, "b").withColumn("dataset", F.lit("b")))
    return A.lowest_records(X.cross_dataset_report(both, "a", "b", rounded=False))


@query
def extreme_records(spark: SparkSession, d: str) -> DataFrame:
    return A.extreme_records(_binding_summary(spark, d))


@query
def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = P.text_features(fx.records(spark, d), rounded=False)
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    columns = ["n_chars", "n_words", "n_sentences", "n_unique_words_lower", "avg_word_length", "quality"]
    return A.spearman_matrix(f.join(labels, "id", "left"), columns, rounded=False)


@query
def spearman_report(spark: SparkSession, d: str) -> DataFrame:
    """The nine columns of the report, ranked over a written copy of the wide table."""
    root = fx.scratch(spark, "wide")
    wide = wide_record_table_of(spark, d).withColumn("n_relationships", F.col("n_rels_total"))
    wide.select("dataset", "id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in A.CORRELATED]).write.parquet(root)
    return A.spearman_matrix(spark.read.parquet(root), A.CORRELATED, rounded=False)


@query
def histogram_percent(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram_percent(_coverage_wide(spark, d), "cov_attribute_l1")


@query
def histogram_equal(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.floor("o_totalprice").alias("v"))
    return A.histogram_equal(o, "v", 16)


@query
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), "l_extendedprice", "l_quantity")
    return A.box_stats(o, ["l_extendedprice", "l_quantity"], ["dataset"])


def wide_record_table_of(spark: SparkSession, d: str) -> DataFrame:
    r, e, rel = fx.records(spark, d), fx.elements(spark, d), fx.element_relationships(spark, d)
    profiled = fx.token_rows(spark, d, ("sent_i", "i", "text", "lemma", "pos", "dep", "head_i"))
    counts = e.groupBy("dataset", "id").agg(
        F.count_if(F.col("kind") == "class").alias("n_classes"), F.count_if(F.col("kind") == "attribute").alias("n_attributes")
    )
    return A.wide_record_table(
        r, profiled, _matched(spark, d), D.record_bindings(e, rel, fx.token_rows(spark, d, _TREE)), counts, fx.entities(spark, d), fx.chunks(spark, d), rounded=False)


@query
def wide_record_table(spark: SparkSession, d: str) -> DataFrame:
    return wide_record_table_of(spark, d)


@query
def case_study_rows(spark: SparkSession, d: str) -> DataFrame:
    """The labelled records: all views are made for their documents alone."""
    only = fx.table(spark, d, "labels").select("doc_id")
    r, t = fx.records(spark, d, only), fx.token_rows(spark, d, _TREE, only)
    e, rel = fx.elements(spark, d, only), fx.element_relationships(spark, d, only)
    matched = L.match_all(e, rel, None, r, fx.synonyms(spark, d), _lexicon(spark, d), sentences=False)
    return A.case_study_rows(r, matched, rel, D.record_bindings(e, rel, t))


@query
def summary_document(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    sections = {
        "relationship_type_counts": A.kind_counts(M.diagram_counts(lines)),
        "cardinality_patterns": A.cardinality_patterns(M.extract_relationships(lines)),
        "attribute_type_counts": A.attribute_type_counts(M.extract_attributes(lines)),
        "warning_totals": A.warning_totals(M.parse_warnings(_loose(spark, d))),
        "failure_rate": G.failure_rate(fx.scores(spark, d)).drop("failure_pct"),
        "status_counts": B.status_counts(fx.previous_jobs(spark, d)),
    }
    return S.summary_document(sections, {"corpus": "orders", "version": "1"})
