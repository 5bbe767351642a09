"""SQL of the registered queries over the same tables.

The views of the fixtures are written here a second time, straight from the
tables; diagram results are computed from customers and orders, never from the
markup, so the markup round trip is checked by another path.
"""

from __future__ import annotations

_WS = r"[\p{Z}\t-\r\x{1C}-\x{1F}\x{85}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _parts(x: str) -> str:
    """Lower-case parts of a name."""
    split = rf"regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g')"
    return f"list_transform(regexp_extract_all({split}, '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x))"


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "features": (
        (),
        r"""
        SELECT dataset, id, length(text) AS n_chars, len(ws) AS n_words,
          len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: """ + _strip("s") + r""" <> '')) AS n_sentences,
          len(list_distinct(list_transform(ws, lambda w: lower(w)))) AS n_unique_words_lower,
          CASE WHEN len(ws) > 0 THEN len(list_distinct(list_transform(ws, lambda w: lower(w)))) / len(ws) ELSE 0.0 END AS type_token_ratio,
          CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda w: length(w))) / len(ws) ELSE 0.0 END AS avg_word_length,
          len(ws) / greatest(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: """ + _strip("s") + r""" <> '')), 1)
            AS avg_sentence_length_words
        FROM (SELECT source AS dataset, doc_id AS id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM documents)""",
    ),
    "sentences": (
        (),
        rf"""
        SELECT dataset, id, unnest(range(len(ss))) AS sent_i, unnest(ss) AS sentence FROM (
          SELECT source AS dataset, doc_id AS id,
            string_split(regexp_replace({_strip('text')}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)""",
    ),
    "words": (
        ("sentences",),
        """
        SELECT dataset, id, sent_i, unnest(range(len(ws))) AS r, unnest(ws) AS w FROM (
          SELECT dataset, id, sent_i, list_transform(regexp_extract_all(sentence, '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x)) AS ws
          FROM sentences)""",
    ),
    "tokens": (
        ("words",),
        """
        SELECT dataset, id, sent_i, r AS i,
          CASE WHEN j = 4 THEN prep ELSE w END AS text,
          CASE WHEN j = 1 THEN vl WHEN j = 4 THEN prep ELSE regexp_replace(w, 's$', '') END AS lemma,
          CASE WHEN j = 1 THEN 'VERB' WHEN j = 4 THEN 'ADP' ELSE 'NOUN' END AS pos,
          CASE WHEN j = 1 THEN 'VB' WHEN j = 4 THEN 'IN' WHEN w LIKE '%s' THEN 'NNS' ELSE 'NN' END AS tag,
          CASE WHEN j = 0 AND v >= n THEN 'dep' WHEN j = 0 THEN 'nsubj' WHEN j = 1 AND r = 1 THEN 'ROOT' WHEN j = 1 THEN 'conj'
               WHEN j = 2 AND vl = 'be' THEN 'attr' WHEN j = 2 THEN 'dobj' WHEN j = 3 THEN 'conj' WHEN j = 4 THEN 'prep' ELSE 'pobj' END AS dep,
          CASE WHEN j = 0 AND v >= n THEN CASE WHEN v < 6 THEN r ELSE v - 6 END WHEN j IN (0, 2, 4) THEN v
               WHEN j = 1 THEN CASE WHEN r = 1 THEN r ELSE v - 6 END ELSE r - 1 END AS head_i
        FROM (
          SELECT *, ['take','send','include','consist','belong','have','contain','be'][(length(verb) + v) % 8 + 1] AS vl,
            ['of','to','in','with'][length(w) % 4 + 1] AS prep
          FROM (
            SELECT *, r % 6 AS j, r - r % 6 + 1 AS v, count(*) OVER (PARTITION BY dataset, id, sent_i) AS n,
              CASE r % 6 WHEN 0 THEN lead(w) OVER win WHEN 1 THEN w WHEN 2 THEN lag(w) OVER win END AS verb
            FROM words WINDOW win AS (PARTITION BY dataset, id, sent_i ORDER BY r)))""",
    ),
    "names": (
        (),
        """
        SELECT d.source AS dataset, n.id, n.k, upper(left(a, 1)) || substr(a, 2) || upper(left(b, 1)) || substr(b, 2) AS name
        FROM (
          SELECT id, u // 2 AS k, max(CASE WHEN u % 2 = 0 THEN w END) AS a, max(CASE WHEN u % 2 = 1 THEN w END) AS b
          FROM (SELECT id, unnest(range(len(ws))) AS u, unnest(ws) AS w FROM (
            SELECT doc_id - 1 AS id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*'), lambda x: length(x) >= 3) AS ws
            FROM documents))
          GROUP BY id, u // 2) n
        JOIN documents d ON d.doc_id = n.id WHERE b IS NOT NULL""",
    ),
    "elements": (
        ("names",),
        """
        SELECT DISTINCT dataset, id, CASE k % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'attribute' ELSE 'enum_value' END AS kind,
          CASE k % 3 WHEN 1 THEN cls WHEN 2 THEN cls || 'Kind' END AS owner, name
        FROM (SELECT *, first_value(name) OVER (PARTITION BY dataset, id, k // 3 ORDER BY k) AS cls FROM names)""",
    ),
    "rels": (
        ("names",),
        """
        SELECT DISTINCT a.dataset, a.id, a.name AS source, b.name AS target,
          CASE WHEN length(b.name) % 2 = 0 THEN 'association' ELSE 'composition' END AS kind, f.name AS label
        FROM names a JOIN names b ON a.id = b.id AND b.k = a.k + 3 JOIN names f ON f.id = a.id AND f.k = 0 WHERE a.k % 3 = 0""",
    ),
    "vocabulary": (
        (),
        """
        SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*'))) AS token FROM documents""",
    ),
    "doc_words": (
        ("words",),
        "SELECT DISTINCT dataset, id, w AS token FROM words",
    ),
    "idx": (
        ("doc_words",),
        """
        SELECT dataset, id, form, bool_or(t) AS is_token, bool_or(l) AS is_lemma FROM (
          SELECT dataset, id, token AS form, true AS t, false AS l FROM doc_words
          UNION ALL SELECT dataset, id, regexp_replace(token, 's$', ''), false, true FROM doc_words
          UNION ALL SELECT dataset, id, token || 's', false, false FROM doc_words) GROUP BY ALL""",
    ),
    "all_elements": (
        ("elements", "rels"),
        """
        SELECT dataset, id, kind, owner, name FROM elements
        UNION ALL SELECT DISTINCT dataset, id, 'rel_source', NULL, source FROM rels
        UNION ALL SELECT DISTINCT dataset, id, 'rel_target', NULL, target FROM rels
        UNION ALL SELECT DISTINCT dataset, id, 'rel_label', NULL, label FROM rels""",
    ),
    "element_parts": (
        ("all_elements",),
        f"SELECT DISTINCT dataset, id, kind, owner, name, unnest({_parts('name')}) AS part FROM all_elements",
    ),
    "part_hits": (
        ("element_parts", "idx", "vocabulary"),
        """
        SELECT p.*, coalesce(o.is_token, false) AS l1, o.form IS NOT NULL AS l2,
          v.token IS NOT NULL AND coalesce(s.is_token OR s.is_lemma, false) AS l4
        FROM element_parts p
        LEFT JOIN idx o ON o.dataset = p.dataset AND o.id = p.id AND o.form = p.part
        LEFT JOIN vocabulary v ON v.token = p.part AND length(p.part) >= 5
        LEFT JOIN idx s ON s.dataset = p.dataset AND s.id = p.id AND s.form = left(p.part, greatest(length(p.part) - 2, 0))""",
    ),
    "part_sents": (
        ("element_parts", "words"),
        """
        SELECT DISTINCT p.dataset, p.id, p.kind, p.owner, p.name, w.sent_i FROM element_parts p
        JOIN (SELECT DISTINCT dataset, id, sent_i, w FROM words) w ON w.dataset = p.dataset AND w.id = p.id AND w.w = p.part""",
    ),
    "sent_lists": (
        ("part_sents",),
        """
        SELECT dataset, id, kind, owner, name, list(sent_i ORDER BY sent_i) AS sents FROM part_sents GROUP BY ALL""",
    ),
    "matched": (
        ("part_hits", "sent_lists"),
        """
        SELECT h.*, coalesce(s.sents, []) AS sents FROM (
          SELECT dataset, id, kind, owner, name, bool_or(l1) AS l1, bool_or(l2) AS l2, bool_or(l1) AS l3, bool_or(l4) AS l4,
            coalesce(string_agg(part, ',' ORDER BY part) FILTER (l4), '') AS matched_tokens,
            NOT (bool_or(l1) OR bool_or(l2) OR bool_or(l4)) AS absent FROM part_hits GROUP BY dataset, id, kind, owner, name) h
        LEFT JOIN sent_lists s ON s.dataset = h.dataset AND s.id = h.id AND s.kind = h.kind
          AND s.owner IS NOT DISTINCT FROM h.owner AND s.name = h.name""",
    ),
    "coverage": (
        ("matched",),
        """
        SELECT d.source AS dataset, d.doc_id AS id, k.kind, coalesce(n, 0) AS n, coalesce(p1, 0.0) AS pct_l1, coalesce(p2, 0.0) AS pct_l2,
          coalesce(p3, 0.0) AS pct_l3, coalesce(p4, 0.0) AS pct_l4, coalesce(pa, 0.0) AS pct_absent
        FROM documents d CROSS JOIN (VALUES ('class'), ('attribute'), ('enum_value'), ('rel_source'), ('rel_target')) k(kind)
        LEFT JOIN (
          SELECT dataset, id, kind, count(*) AS n, 100.0 * count_if(l1) / count(*) AS p1, 100.0 * count_if(l2) / count(*) AS p2,
            100.0 * count_if(l3) / count(*) AS p3, 100.0 * count_if(l4) / count(*) AS p4, 100.0 * count_if(absent) / count(*) AS pa
          FROM matched GROUP BY ALL) m ON m.id = d.doc_id AND m.kind = k.kind""",
    ),
    "closure": (
        ("tokens",),
        """
        SELECT dataset, id, sent_i, i, i AS anc, 0 AS depth, [i] AS path, [text] AS texts, head_i AS nxt FROM tokens
        UNION ALL
        SELECT c.dataset, c.id, c.sent_i, c.i, t.i, c.depth + 1, list_append(c.path, t.i), list_append(c.texts, t.text), t.head_i
        FROM closure c JOIN tokens t ON t.dataset = c.dataset AND t.id = c.id AND t.sent_i = c.sent_i AND t.i = c.nxt
        WHERE c.depth < 5 AND c.nxt <> c.anc""",
    ),
    "token_forms": (
        ("tokens",),
        """
        SELECT DISTINCT dataset, id, sent_i, i, form FROM (
          SELECT dataset, id, sent_i, i, lower(text) AS form FROM tokens UNION ALL SELECT dataset, id, sent_i, i, lower(lemma) FROM tokens)""",
    ),
    "hits": (
        ("element_parts", "token_forms"),
        """
        SELECT DISTINCT p.dataset, p.id, p.kind, p.owner, p.name, f.sent_i, f.i FROM element_parts p
        JOIN token_forms f ON f.dataset = p.dataset AND f.id = p.id AND f.form = p.part""",
    ),
    "attr_pairs": (
        ("elements", "hits"),
        """
        SELECT a.dataset, a.id, a.owner AS class, a.name AS attribute, c.sent_i, c.i AS src_i, a.i AS tgt_i
        FROM hits a JOIN hits c ON c.dataset = a.dataset AND c.id = a.id AND c.kind = 'class' AND c.name = a.owner AND c.sent_i = a.sent_i
        WHERE a.kind = 'attribute'""",
    ),
    "attr_bound": (
        ("attr_pairs", "closure"),
        """
        SELECT dataset, id, class, attribute, sent_i, src_i, tgt_i, a.depth + b.depth AS hop,
          list_concat(a.path, list_reverse(b.path[1:len(b.path) - 1])) AS path,
          list_concat(a.texts, list_reverse(b.texts[1:len(b.texts) - 1])) AS texts
        FROM attr_pairs p JOIN closure a USING (dataset, id, sent_i) JOIN closure b USING (dataset, id, sent_i)
        WHERE a.i = p.src_i AND b.i = p.tgt_i AND a.anc = b.anc AND a.depth + b.depth <= 4
        QUALIFY row_number() OVER (PARTITION BY dataset, id, class, attribute ORDER BY a.depth + b.depth, sent_i, src_i, tgt_i) = 1""",
    ),
    "rel_paths": (
        ("rels", "hits", "closure"),
        """
        SELECT dataset, id, source, target, sent_i, src_i, tgt_i, a.depth + b.depth AS hop,
          list_concat(a.path, list_reverse(b.path[1:len(b.path) - 1])) AS path,
          list_concat(a.texts, list_reverse(b.texts[1:len(b.texts) - 1])) AS texts
        FROM (SELECT DISTINCT r.dataset, r.id, r.source, r.target, s.sent_i, s.i AS src_i, t.i AS tgt_i
              FROM rels r JOIN hits s ON s.dataset = r.dataset AND s.id = r.id AND s.kind = 'rel_source' AND s.name = r.source
              JOIN hits t ON t.dataset = r.dataset AND t.id = r.id AND t.kind = 'rel_target' AND t.name = r.target AND t.sent_i = s.sent_i) p
        JOIN closure a USING (dataset, id, sent_i) JOIN closure b USING (dataset, id, sent_i)
        WHERE a.i = p.src_i AND b.i = p.tgt_i AND a.anc = b.anc AND a.depth + b.depth <= 5
        QUALIFY row_number() OVER (PARTITION BY dataset, id, source, target, sent_i ORDER BY a.depth + b.depth, src_i, tgt_i) = 1""",
    ),
    "rel_bound": (
        ("rel_paths",),
        """
        SELECT *, count(*) OVER (PARTITION BY dataset, id, source, target) AS n_sentences FROM rel_paths
        QUALIFY row_number() OVER (PARTITION BY dataset, id, source, target ORDER BY hop, sent_i, src_i, tgt_i) = 1""",
    ),
    "bindings": (
        ("elements", "rels", "attr_bound", "rel_bound"),
        """
        SELECT d.source AS dataset, d.doc_id AS id, coalesce(na, 0) AS n_attrs_total, coalesce(ba, 0) AS n_attrs_bound,
          100.0 * coalesce(ba, 0) / greatest(coalesce(na, 0), 1) AS pct_attrs_bound, coalesce(nr, 0) AS n_rels_total,
          coalesce(br, 0) AS n_rels_bound, 100.0 * coalesce(br, 0) / greatest(coalesce(nr, 0), 1) AS pct_rels_bound,
          coalesce(ha, 0.0) AS avg_hop_class_attr, coalesce(hr, 0.0) AS avg_hop_rel
        FROM documents d
        LEFT JOIN (SELECT id, count(*) AS na FROM elements WHERE kind = 'attribute' GROUP BY id) e ON e.id = d.doc_id
        LEFT JOIN (SELECT id, count(*) AS nr FROM rels GROUP BY id) r ON r.id = d.doc_id
        LEFT JOIN (SELECT id, count(DISTINCT attribute) AS ba, avg(hop) AS ha FROM attr_bound GROUP BY id) a ON a.id = d.doc_id
        LEFT JOIN (SELECT id, count(DISTINCT (source, target)) AS br, avg(hop) AS hr FROM rel_bound GROUP BY id) b ON b.id = d.doc_id""",
    ),
    "kind_cov": (
        ("rels", "rel_bound"),
        """
        SELECT d.source AS dataset, d.doc_id AS id, k.rel_kind, coalesce(n, 0) AS n, coalesce(nb, 0) AS n_bound,
          coalesce(100.0 * nb / n, 0.0) AS pct_bound
        FROM documents d CROSS JOIN (VALUES ('association'), ('directed'), ('inheritance'), ('composition'), ('aggregation'),
          ('dependency'), ('association_class')) k(rel_kind)
        LEFT JOIN (SELECT r.id, r.kind, count(*) AS n, count(b.hop) AS nb FROM rels r
          LEFT JOIN rel_bound b ON b.id = r.id AND b.source = r.source AND b.target = r.target GROUP BY ALL) c
        ON c.id = d.doc_id AND c.kind = k.rel_kind""",
    ),
    "entities": (
        ("tokens",),
        """
        SELECT dataset, id, ['ORG','PERSON','GPE'][length(lemma) % 3 + 1] AS label FROM tokens WHERE pos = 'NOUN' AND length(lemma) >= 8""",
    ),
    "style": (
        ("tokens", "entities"),
        """
        SELECT t.dataset, t.id, p AS passive_nsubjpass, a AS active_nsubj, m AS modal_count, h AS hedge_count, coalesce(e.c, 0) AS named_entities,
          p / greatest(p + a, 1) AS passive_ratio, h / n AS hedge_density, m / n AS modal_density, coalesce(e.c, 0) / n AS entity_density
        FROM (SELECT dataset, id, count(*) AS n, count_if(dep = 'nsubjpass')::BIGINT AS p, count_if(dep = 'nsubj')::BIGINT AS a,
          count_if(pos IN ('VERB', 'AUX') AND lemma IN ('can','could','may','might','must','shall','should','will','would'))::BIGINT AS m,
          count_if(lemma IN ('may','can','could','might','would','should','typically','often','usually','sometimes','possibly','perhaps','probably','likely'))::BIGINT AS h
          FROM tokens GROUP BY ALL) t
        LEFT JOIN (SELECT id, count(*) AS c FROM entities GROUP BY id) e ON e.id = t.id""",
    ),
    "class_words": (
        ("tokens",),
        """
        SELECT DISTINCT dataset, id, lower(text) AS name_lower FROM tokens
        WHERE pos = 'NOUN' AND regexp_matches(text, '^[A-Za-z_][A-Za-z0-9_]*$')
          AND text NOT IN ('i.e','e.g','etc','cf','vs','al','viz','approx','yes','no','true','false')""",
    ),
    "roles": (
        ("tokens", "class_words"),
        """
        SELECT n.dataset, n.id, n.sent_i, n.i, n.text, n.tag, n.dep, n.head_i FROM tokens n JOIN class_words c
          ON c.dataset = n.dataset AND c.id = n.id AND c.name_lower = lower(n.text) WHERE n.dep IN ('nsubj', 'dobj', 'pobj')
        UNION ALL
        SELECT k.dataset, k.id, k.sent_i, k.i, k.text, k.tag, b.dep, b.head_i FROM tokens k
        JOIN class_words ck ON ck.dataset = k.dataset AND ck.id = k.id AND ck.name_lower = lower(k.text)
        JOIN tokens b ON b.dataset = k.dataset AND b.id = k.id AND b.sent_i = k.sent_i AND b.i = k.head_i
        JOIN class_words cb ON cb.dataset = b.dataset AND cb.id = b.id AND cb.name_lower = lower(b.text)
        WHERE k.dep = 'conj' AND b.dep IN ('nsubj', 'dobj', 'pobj')""",
    ),
    "objects": (
        ("roles", "tokens"),
        """
        SELECT dataset, id, sent_i, head_i AS verb_i, NULL::VARCHAR AS prep, text, tag FROM roles WHERE dep = 'dobj'
        UNION ALL
        SELECT r.dataset, r.id, r.sent_i, p.head_i, p.text, r.text, r.tag FROM roles r
        JOIN tokens p ON p.dataset = r.dataset AND p.id = r.id AND p.sent_i = r.sent_i AND p.i = r.head_i
        WHERE r.dep = 'pobj' AND p.dep = 'prep' AND p.pos = 'ADP'""",
    ),
    "ord": (
        (),
        """
        SELECT c_mktsegment AS dataset, c_custkey AS id, 'P_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g') AS cls,
          o_orderkey AS k, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "cls": (
        ("ord",),
        "SELECT dataset, id, cls, count(*) AS n FROM ord GROUP BY ALL",
    ),
    "link": (
        ("ord",),
        """
        SELECT dataset, id, cls, st, count(*) AS n, CASE st WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS o FROM ord GROUP BY ALL""",
    ),
    "cust": (
        ("cls", "link"),
        """
        SELECT c.dataset, c.id, c.nc, c.n, l.nl, l.ns FROM (SELECT dataset, id, count(*) AS nc, sum(n)::BIGINT AS n FROM cls GROUP BY ALL) c
        JOIN (SELECT id, count(*) AS nl, count(DISTINCT st) AS ns FROM link GROUP BY id) l ON l.id = c.id""",
    ),
    "rel": (
        ("link",),
        """
        SELECT dataset, id, 'Customer' AS source, cls AS target, CASE st WHEN 'F' THEN 'composition' WHEN 'O' THEN 'association' ELSE 'aggregation' END AS kind,
          '1' AS source_card, n::VARCHAR AS target_card, st AS label FROM link""",
    ),
    "loose_rel": (
        ("link",),
        """
        SELECT dataset, id, CASE WHEN st = 'O' THEN 'Customer' ELSE cls END AS source, CASE WHEN st = 'O' THEN cls ELSE 'Customer' END AS target,
          CASE st WHEN 'F' THEN 'directed' WHEN 'O' THEN 'association' ELSE 'composition' END AS kind,
          CASE WHEN st = 'O' THEN '1' ELSE n::VARCHAR END AS source_card, CASE WHEN st = 'O' THEN n::VARCHAR ELSE '1' END AS target_card,
          st AS label FROM link""",
    ),
    # the lines of the loose diagrams by number
    "loose_lines": (
        ("ord", "link", "cust"),
        """
        SELECT dataset, id, 1 AS line_no, '@startuml' AS t, 'marker' AS what FROM cust
        UNION ALL SELECT dataset, id, 2, ''' customer ' || id, 'comment' FROM cust
        UNION ALL SELECT dataset, id, 2 + row_number() OVER (PARTITION BY id ORDER BY cls, k), cls || ' : order_' || k, 'attribute' FROM ord
        UNION ALL SELECT dataset, id, 3 + n, 'note right of Customer', 'note' FROM cust
        UNION ALL SELECT dataset, id, 4 + n, 'orders ' || n, 'note' FROM cust
        UNION ALL SELECT dataset, id, 5 + n, 'end note', 'note' FROM cust
        UNION ALL SELECT l.dataset, l.id, 5 + c.n + row_number() OVER (PARTITION BY l.id ORDER BY l.cls, l.o),
          'Customer "1" ' || CASE st WHEN 'F' THEN '<--' WHEN 'O' THEN '-' ELSE '--*' END || ' "' || l.n || '" ' || cls || ' : ' || st,
          'link' || st FROM link l JOIN cust c ON c.id = l.id
        UNION ALL SELECT l.dataset, l.id, 5 + c.n + c.nl + row_number() OVER (PARTITION BY l.id ORDER BY l.cls), '?? ' || cls, 'unknown'
          FROM link l JOIN cust c ON c.id = l.id WHERE l.st = 'P'
        UNION ALL SELECT c.dataset, c.id, 6 + c.n + c.nl + coalesce(u.nu, 0), '@enduml', 'marker' FROM cust c
          LEFT JOIN (SELECT id, count(*) AS nu FROM link WHERE st = 'P' GROUP BY id) u ON u.id = c.id""",
    ),
    "bad_lines": (
        ("loose_lines",),
        """
        SELECT dataset, id, line_no::BIGINT AS line_no,
          'L' || line_no || ' unknown: ' || t AS error
        FROM loose_lines WHERE what NOT IN ('marker', 'linkF', 'linkO')""",
    ),
    # diagram sets of both sides
    "side_a": (
        ("ord",),
        """
        SELECT DISTINCT dataset, id, kind, key FROM (
          SELECT dataset, id, unnest(['classes','classes','attributes','relationships','relationships_typed','enum_values']) AS kind,
            unnest(['customer', lower(cls), lower(cls) || '.order_' || k, 'customer|' || lower(cls),
              'customer|' || lower(cls) || '|' || CASE st WHEN 'F' THEN 'composition' WHEN 'O' THEN 'association' ELSE 'aggregation' END,
              'status.' || lower(st)]) AS key FROM ord)""",
    ),
    "side_b": (
        ("ord",),
        """
        SELECT DISTINCT dataset, id, kind, key FROM (
          SELECT dataset, id, unnest(['classes','classes','attributes','relationships','relationships_typed','enum_values']) AS kind,
            unnest(['customer', lower(cls), lower(cls) || '.order_' || k, 'customer|' || lower(cls),
              'customer|' || lower(cls) || '|' || CASE st WHEN 'F' THEN 'composition' WHEN 'O' THEN 'association' ELSE 'aggregation' END,
              'status.' || lower(st)]) AS key FROM ord WHERE k % 10 <> 0)""",
    ),
    "both_sides": (
        ("side_a", "side_b"),
        """
        SELECT dataset, id, kind, key, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b
        FROM (SELECT * FROM side_a WHERE id IN (SELECT id FROM side_b)) a FULL JOIN side_b b USING (dataset, id, kind, key)""",
    ),
    "set_counts": (
        ("both_sides",),
        """
        SELECT dataset, id, kind, count_if(in_a)::BIGINT AS n_first, count_if(in_b)::BIGINT AS n_second, count_if(in_a AND in_b)::BIGINT AS n_both
        FROM both_sides GROUP BY ALL""",
    ),
    "cross_jaccard": (
        ("both_sides",),
        """
        SELECT id, max(j) FILTER (kind = 'classes') AS jaccard_classes, max(j) FILTER (kind = 'attributes') AS jaccard_attributes,
          max(j) FILTER (kind = 'relationships') AS jaccard_rels, coalesce(max(fa) FILTER (kind = 'classes'), '') AS only_in_first_classes,
          coalesce(max(fb) FILTER (kind = 'classes'), '') AS only_in_second_classes,
          coalesce(max(fa) FILTER (kind = 'relationships'), '') AS only_in_first_rels,
          coalesce(max(fb) FILTER (kind = 'relationships'), '') AS only_in_second_rels
        FROM (SELECT id, kind, count_if(in_a AND in_b) / count(*) AS j,
          string_agg(key, ';' ORDER BY key) FILTER (in_a AND NOT in_b) AS fa, string_agg(key, ';' ORDER BY key) FILTER (in_b AND NOT in_a) AS fb
          FROM both_sides GROUP BY ALL) GROUP BY id""",
    ),
    "scores": (
        (),
        """
        SELECT l_returnflag AS candidate, l_linestatus AS dataset, 'm' || (l_suppkey % 2) AS model, l_linenumber % 3 + 1 AS run_index,
          l_orderkey AS id, l_discount * 10 AS class_score, l_tax * 10 AS attribute_score, l_quantity / 50 AS association_score,
          CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'empty_generated_model' END AS error FROM lineitem""",
    ),
    "long_scores": (
        ("scores",),
        """
        SELECT candidate, dataset, model, run_index, error, unnest(['class_score','attribute_score','association_score']) AS element,
          unnest([class_score, attribute_score, association_score]) AS score FROM scores""",
    ),
    "bucketed": (
        ("long_scores",),
        """
        SELECT *, CASE WHEN score < 0.1 THEN 0 WHEN score < 0.2 THEN 1 WHEN score < 0.3 THEN 2 WHEN score < 0.4 THEN 3 WHEN score < 0.5 THEN 4
          WHEN score < 0.6 THEN 5 WHEN score < 0.7 THEN 6 WHEN score < 0.8 THEN 7 WHEN score < 0.9 THEN 8 ELSE 9 END AS bucket FROM long_scores""",
    ),
    "cand_means": (
        ("long_scores",),
        "SELECT dataset, candidate, element, avg(score) AS mean FROM long_scores GROUP BY ALL",
    ),
    "jobs0": (
        (),
        """
        SELECT o_orderpriority AS candidate, CASE WHEN o_custkey % 3 > 0 THEN 'm' || (o_custkey % 3) END AS model, c_mktsegment AS dataset,
          (o_orderkey % 3 + 1)::BIGINT AS run_index, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
          o_orderdate AS ts, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "prev": (
        ("jobs0",),
        """
        SELECT candidate, model, dataset, run_index, status, CASE WHEN status = 'failed' THEN 'rc=1' || chr(10) || 'see log ' || o_orderkey END AS error
        FROM jobs0 QUALIFY row_number() OVER (PARTITION BY candidate, model, dataset, run_index ORDER BY ts DESC, o_orderkey DESC) = 1""",
    ),
    "plan": (
        (),
        """
        SELECT c.candidate, m.model, c.dataset, r.run_index::BIGINT AS run_index
        FROM (SELECT DISTINCT o_orderpriority AS candidate, c_mktsegment AS dataset FROM orders JOIN customer ON o_custkey = c_custkey) c
        JOIN (VALUES ('m1'), ('m2'), ('m3'), (NULL)) m(model) ON (c.candidate = '5-LOW') = (m.model IS NULL)
        CROSS JOIN range(1, 4) r(run_index)""",
    ),
    "found": (
        ("plan", "jobs0"),
        """
        SELECT p.*, 'run_' || j.o_orderkey AS artifact FROM plan p LEFT JOIN (SELECT * FROM jobs0 WHERE status = 'done') j
          ON j.candidate = p.candidate AND j.dataset = p.dataset AND j.run_index = p.run_index AND (p.model IS NULL OR j.model = p.model)
        QUALIFY row_number() OVER (PARTITION BY p.candidate, p.model, p.dataset, p.run_index ORDER BY j.ts DESC, 'run_' || j.o_orderkey DESC) = 1""",
    ),
    "reconciled": (
        ("plan", "prev"),
        """
        SELECT p.*, coalesce(v.status, 'pending') AS status, v.error FROM plan p LEFT JOIN prev v ON v.candidate = p.candidate
          AND v.model IS NOT DISTINCT FROM p.model AND v.dataset = p.dataset AND v.run_index = p.run_index""",
    ),
    "sent_hits": (
        ("sentences", "elements", "rels", "words"),
        f"""
        SELECT s.dataset, s.id, s.sent_i, any_value(s.n) AS n_words, count(*) FILTER (p.c)::BIGINT AS n_class_hits,
          count(*) FILTER (p.a)::BIGINT AS n_attr_hits, count(*) FILTER (p.e)::BIGINT AS n_rel_endpoint_hits
        FROM (SELECT dataset, id, sent_i, len(ws) AS n, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE list_distinct(list_transform(ws, lambda w: lower(w))) END) AS w
          FROM (SELECT *, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM sentences)) s
        LEFT JOIN (
          SELECT dataset, id, part, bool_or(k = 'class') AS c, bool_or(k = 'attribute') AS a, bool_or(k = 'end') AS e FROM (
            SELECT dataset, id, kind AS k, unnest({_parts('name')}) AS part FROM elements WHERE kind IN ('class', 'attribute')
            UNION ALL SELECT dataset, id, 'end', unnest({_parts('source')}) FROM rels
            UNION ALL SELECT dataset, id, 'end', unnest({_parts('target')}) FROM rels) GROUP BY ALL) p
        ON p.dataset = s.dataset AND p.id = s.id AND p.part = s.w GROUP BY s.dataset, s.id, s.sent_i""",
    ),
}


def _needs(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needs(_VIEWS[name][0], seen)
            seen.append(name)
    return seen


# read more than once: computed once per statement
_ONCE = {"tokens", "element_parts", "words", "sentences", "idx", "class_words", "roles", "objects", "hits", "rels", "elements", "names", "closure", "matched"}


def sql(*views: str, select: str) -> str:
    ctes = []
    for v in _needs(views, []):
        ctes.append(f"{v} AS {'MATERIALIZED ' if v in _ONCE and v != 'closure' else ''}({_VIEWS[v][1]})")
    return f"WITH RECURSIVE {', '.join(ctes)} {select}" if ctes else select


def _r(expr: str) -> str:
    return f"round({expr}, 6)"


def _s(expr: str) -> str:
    """Scores have few decimals; more digits keep their means off rounding ties."""
    return f"round({expr}, 10)"




def _verb_rule(n: str, verbs: str, accept: str, label: str, label_accept: str, turned: bool) -> tuple[str, str]:
    """Extra views (named with ``n``) and final select of one verb-list rule."""
    a, b = ("o", "s") if turned else ("s", "o")
    cap = lambda x: f"upper(left({x}.text, 1)) || lower(substr({x}.text, 2))"
    card = lambda x: f"CASE WHEN max({x}.tag) = 'NNS' THEN '1..*' ELSE '1' END"
    views = f"""
        , vb{n} AS (SELECT * FROM tokens WHERE pos = 'VERB' AND lemma IN ({verbs})),
        acting{n} AS (SELECT dataset, id, sent_i, i AS subj_v, i AS verb_i, lemma, text AS verb FROM vb{n}
          UNION ALL SELECT c.dataset, c.id, c.sent_i, p.i, c.i, c.lemma, c.text FROM vb{n} c JOIN vb{n} p
            ON p.dataset = c.dataset AND p.id = c.id AND p.sent_i = c.sent_i AND p.i = c.head_i WHERE c.dep = 'conj'),
        lastp{n} AS (SELECT v.dataset, v.id, v.sent_i, v.i, arg_max(p.text, p.i) AS prep FROM vb{n} v JOIN tokens p ON p.dataset = v.dataset AND p.id = v.id
          AND p.sent_i = v.sent_i AND p.head_i = v.i AND p.dep = 'prep' WHERE {label_accept} GROUP BY ALL)"""
    final = f"""
        SELECT x.dataset, x.id, x.sent_i, {cap(a)} AS source, {label} AS label, {cap(b)} AS target,
          {card(a)} AS source_card, {card(b)} AS target_card
        FROM acting{n} x JOIN roles s ON s.dataset = x.dataset AND s.id = x.id AND s.sent_i = x.sent_i AND s.dep = 'nsubj' AND s.head_i = x.subj_v
        JOIN objects o ON o.dataset = x.dataset AND o.id = x.id AND o.sent_i = x.sent_i AND o.verb_i = x.verb_i
        LEFT JOIN lastp{n} lp ON lp.dataset = x.dataset AND lp.id = x.id AND lp.sent_i = x.sent_i AND lp.i = x.verb_i
        WHERE o.prep IS NULL OR ({accept})
        GROUP BY x.dataset, x.id, x.sent_i, x.subj_v, x.verb_i, x.lemma, x.verb, s.text, o.text, lp.prep"""
    return views, final


_AGG_OK = "(({l} IN ('consist','comprise') AND {p} = 'of') OR ({l} IN ('belong','divide') AND {p} = 'to') OR ({l} = 'include' AND {p} = 'in'))"


def statements() -> dict[str, str]:
    counts_zero = ", ".join(f"0::BIGINT AS n_rels_{k}" for k in ("directed", "inheritance", "dependency", "association_class"))
    out: dict[str, str] = {}

    # text
    out["text_features"] = sql("features", select=f"""
        SELECT dataset, id, n_chars, n_words, n_sentences, n_unique_words_lower, {_r('type_token_ratio')} AS type_token_ratio,
          {_r('avg_word_length')} AS avg_word_length, {_r('avg_sentence_length_words')} AS avg_sentence_length_words FROM features""")
    out["dataset_overview"] = sql("features", select=f"""
        SELECT dataset, count(*) AS n_records, {_r('avg(n_words)')} AS words_mean, {_r('median(n_words)')} AS words_median, min(n_words) AS words_min,
          max(n_words) AS words_max, {_r('avg(n_sentences)')} AS sentences_mean, {_r('median(n_sentences)')} AS sentences_median,
          {_r('avg(type_token_ratio)')} AS type_token_ratio_mean FROM features GROUP BY dataset""")
    out["split_sentences"] = sql("sentences", select="""
        SELECT dataset, id, sent_i, length(sentence) AS n_chars, md5(sentence) AS digest FROM sentences""")
    out["clean_requirement_text"] = rf"""
        SELECT dataset, id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT source AS dataset, doc_id AS id,
          regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]+', '', 'g'), '[()*+]', '', 'g'), '\.{_WS}+', ' . ', 'g') AS t FROM documents)"""
    out["split_identifier"] = sql("elements", select=f"""
        SELECT dataset, id, kind, owner, name, array_to_string({_parts('name')}, '|') AS parts FROM elements""")
    out["text_tokens"] = sql("words", select="""
        SELECT dataset, id, sent_i, r AS tok_i, w AS token FROM words""")
    out["name_cleaning"] = r"""
        SELECT c_custkey, nullif(trim(regexp_replace(c_name, '[^\p{L}\p{N}_.-]', '_', 'g'), '_'), '') AS safe,
          upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS camel, '"' || c_nationkey || '"' AS quoted, left(c_name, 10) AS short,
          regexp_matches(c_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid_name, regexp_matches(c_mktsegment, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid_segment
        FROM customer"""
    out["fill_template"] = """
        SELECT o_orderkey, 'Text ' || o_orderkey || ' with [' || o_orderpriority || '] and ' || o_orderstatus AS prompt FROM orders"""
    out["parse_step_reply"] = """
        SELECT o_orderkey, '[A, ' || o_orderpriority || ']' AS class_list, 'x -- ' || o_orderstatus AS associations,
          CASE WHEN o_orderkey % 2 = 0 THEN '[B' || o_orderkey || ']' ELSE '[]' END AS inheritance FROM orders"""

    # markup
    starts = """
        , c AS (SELECT q.dataset, q.id, cls, q.n, 5 + u.ns + coalesce(sum(q.n + 2) OVER (PARTITION BY q.id ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM cls q JOIN cust u ON u.id = q.id)"""
    arrow = "CASE st WHEN 'F' THEN '*--' WHEN 'O' THEN '--' ELSE 'o--' END"
    out["classify_line"] = sql("cls", "link", "cust", "ord", select=starts + f"""
        SELECT dataset, id, line_no::BIGINT AS line_no, content, kind FROM (
          SELECT dataset, id, 2 AS line_no, 'enum Status {{' AS content, 'enum' AS kind FROM cust
          UNION ALL SELECT dataset, id, 2 + row_number() OVER (PARTITION BY id ORDER BY st), st, 'attribute' FROM (SELECT DISTINCT dataset, id, st FROM ord)
          UNION ALL SELECT dataset, id, 4 + ns, 'class Customer {{ }}', 'class' FROM cust
          UNION ALL SELECT dataset, id, s, 'class ' || cls || ' {{', 'class' FROM c
          UNION ALL SELECT o.dataset, o.id, c.s + row_number() OVER (PARTITION BY o.id, o.cls ORDER BY k), 'order_' || k || ' : Double', 'attribute'
            FROM ord o JOIN c ON c.id = o.id AND c.cls = o.cls
          UNION ALL SELECT l.dataset, l.id, 4 + u.ns + u.n + 2 * u.nc + row_number() OVER (PARTITION BY l.id ORDER BY l.cls, l.o),
            'Customer "1" ' || {arrow} || ' "' || l.n || '" ' || cls || ' : ' || st, 'relationship' FROM link l JOIN cust u ON u.id = l.id)""")
    out["classify_loose_line"] = sql("loose_lines", select="""
        SELECT dataset, id, line_no::BIGINT AS line_no, t AS content, CASE WHEN what IN ('linkF', 'linkP') THEN 'relationship' WHEN what = 'attribute' THEN 'attribute'
          WHEN t LIKE 'note %' THEN 'note' ELSE 'unknown' END AS kind FROM loose_lines WHERE what NOT IN ('marker', 'comment') AND t <> 'end note'""")
    out["assign_constructs"] = sql("cls", "link", "cust", select="""
        , c AS (SELECT q.dataset, q.id, cls, q.n, 5 + u.ns + coalesce(sum(q.n + 2) OVER (PARTITION BY q.id ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM cls q JOIN cust u ON u.id = q.id)
        SELECT dataset, id, type, name, is_abstract, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM (
          SELECT dataset, id, 'enum' AS type, 'Status' AS name, false AS is_abstract, 2 AS start_line, 3 + ns AS end_line FROM cust
          UNION ALL SELECT dataset, id, 'class', 'Customer', false, 4 + ns, 4 + ns FROM cust
          UNION ALL SELECT dataset, id, 'class', cls, false, s, s + n + 1 FROM c
          UNION ALL SELECT l.dataset, l.id, 'relationship', NULL, false, 4 + u.ns + u.n + 2 * u.nc + row_number() OVER (PARTITION BY l.id ORDER BY l.cls, l.o),
            4 + u.ns + u.n + 2 * u.nc + row_number() OVER (PARTITION BY l.id ORDER BY l.cls, l.o) FROM link l JOIN cust u ON u.id = l.id)""")
    out["extract_comments"] = sql("cust", select="SELECT dataset, id, 2::BIGINT AS line_no, 'customer ' || id AS comment FROM cust")
    out["extract_classes"] = sql("cls", "cust", select="""
        SELECT dataset, id, cls AS name, false AS is_abstract FROM cls UNION ALL SELECT dataset, id, 'Customer', false FROM cust""")
    out["extract_attributes"] = sql("ord", select="""
        SELECT dataset, id, cls AS class, 'order_' || k AS name, 'Double' AS type, false AS is_constant FROM ord""")
    out["loose_attributes"] = sql("ord", select="""
        SELECT dataset, id, cls AS class, 'order_' || k AS name, 2 + row_number() OVER (PARTITION BY id ORDER BY cls, k) AS line_no, false AS declared FROM ord""")
    out["standalone_attributes"] = sql("ord", select="""
        SELECT dataset, id, cls AS class, 'order_' || k AS name, 2 + row_number() OVER (PARTITION BY id ORDER BY cls, k) AS line_no FROM ord""")
    out["extract_enums"] = sql("link", select="""
        SELECT dataset, id, 'Status' AS name, string_agg(DISTINCT st, '|' ORDER BY st) AS values, false AS is_inline FROM link GROUP BY ALL""")
    out["extract_notes"] = sql("cust", select="""
        SELECT dataset, id, 'right of Customer' AS position, 'orders ' || n AS content, 3 + n AS line_no FROM cust""")
    out["extract_relationships"] = sql("rel", select="SELECT * FROM rel")
    out["directed_relationships"] = sql("loose_rel", select="SELECT * FROM loose_rel")
    out["implicit_classes"] = sql("cust", select="SELECT dataset, id, 'Customer' AS name FROM cust")
    out["all_names"] = sql("cls", "cust", select="""
        SELECT dataset, id, 'class' AS kind, cls AS name FROM cls UNION ALL SELECT dataset, id, 'class', 'Customer' FROM cust
        UNION ALL SELECT dataset, id, 'enum', 'Status' FROM cust""")
    out["endpoints"] = sql("rel", select="""
        SELECT dataset, id, source AS name, 'source' AS role, kind, source_card AS card, label FROM rel
        UNION ALL SELECT dataset, id, target, 'target', kind, target_card, label FROM rel""")
    counts = """
        SELECT c.dataset, c.id, c.nc + 1 AS n_classes, {enums}::BIGINT AS n_enums, {implicit}::BIGINT AS n_implicit_classes, c.n AS n_attributes,
          c.nl AS n_relationships, c.nl AS n_rels_with_card, {label} AS n_rels_with_label, a AS n_rels_association, f AS n_rels_composition,
          p AS n_rels_aggregation, {zero}
        FROM cust c JOIN (SELECT id, count_if(st = 'O')::BIGINT AS a, count_if(st = 'F')::BIGINT AS f, count_if(st = 'P')::BIGINT AS p FROM link GROUP BY id) l ON l.id = c.id"""
    out["diagram_counts"] = sql("cust", "link", select=counts.format(enums=1, implicit=0, label="c.nl", zero=counts_zero))
    out["loose_diagram_counts"] = sql("cust", "link", select="""
        SELECT c.dataset, c.id, c.nc AS n_classes, 0::BIGINT AS n_enums, 1::BIGINT AS n_implicit_classes, c.n AS n_attributes,
          c.nl AS n_relationships, c.nl AS n_rels_with_card, c.nl AS n_rels_with_label, a AS n_rels_association, f AS n_rels_directed,
          p AS n_rels_composition, 0::BIGINT AS n_rels_inheritance, 0::BIGINT AS n_rels_aggregation, 0::BIGINT AS n_rels_dependency,
          0::BIGINT AS n_rels_association_class
        FROM cust c JOIN (SELECT id, count_if(st = 'O')::BIGINT AS a, count_if(st = 'F')::BIGINT AS f, count_if(st = 'P')::BIGINT AS p FROM link GROUP BY id) l ON l.id = c.id""")
    out["nest_diagram"] = sql("ord", "link", "cust", select="""
        , a AS (SELECT id, cls, '{"name":"' || cls || '","is_abstract":false,"attributes":[' || string_agg('{"name":"order_' || k || '","type":"Double","is_constant":false}', ','
            ORDER BY k) || '],"nested_enum_names":[]}' AS t FROM ord GROUP BY id, cls),
        b AS (SELECT id, '[{"name":"Customer","is_abstract":false,"attributes":[],"nested_enum_names":[]},' || string_agg(t, ',' ORDER BY cls) || ']' AS t FROM a GROUP BY id),
        e AS (SELECT id, '[{"name":"Status","values":[' || string_agg(DISTINCT '"' || st || '"', ',' ORDER BY '"' || st || '"') || '],"is_inline":false}]' AS t FROM ord GROUP BY id),
        r AS (SELECT id, '[' || string_agg('{"source":"Customer","target":"' || cls || '","kind":"' || CASE st WHEN 'F' THEN 'composition' WHEN 'O' THEN 'association'
            ELSE 'aggregation' END || '","source_card":"1","target_card":"' || n || '","label":"' || st || '"}', ',' ORDER BY cls, o) || ']' AS t FROM link GROUP BY id)
        SELECT c.dataset, c.id, b.t AS classes, e.t AS enums, r.t AS relationships, '[]' AS implicit_classes, '[]' AS notes
        FROM cust c JOIN b ON b.id = c.id JOIN e ON e.id = c.id JOIN r ON r.id = c.id""")
    out["diagram_graph"] = sql("rel", select="""
        SELECT dataset, id, source, target, kind AS type, source_card AS card1, target_card AS card2, lower(label) AS label FROM rel
        UNION ALL SELECT dataset, id, target, source, kind, target_card, source_card, lower(label) FROM rel WHERE kind = 'association'""")
    out["diagram_nodes"] = sql("ord", "cust", select="""
        SELECT dataset, id, cls AS node, string_agg('order_' || k, '|' ORDER BY k) AS attributes FROM ord GROUP BY ALL
        UNION ALL SELECT dataset, id, 'Customer', '' FROM cust""")
    out["render_elements"] = sql("rel", select="""
        SELECT dataset, id, source || ' "1" ' || CASE kind WHEN 'composition' THEN '*--' WHEN 'aggregation' THEN 'o--' ELSE '--' END || ' "' || target_card
          || '" ' || target || ' : ' || label AS text FROM rel""")
    out["render_members"] = sql("ord", "cls", "cust", select="""
        SELECT dataset, id, 'attribute' AS kind, 'order_' || k || ' : Double' AS text FROM ord
        UNION ALL SELECT dataset, id, 'enum', 'enum Status { ' || string_agg(DISTINCT st, ', ' ORDER BY st) || ' }' FROM ord GROUP BY dataset, id
        UNION ALL SELECT dataset, id, 'class', 'class ' || cls FROM cls UNION ALL SELECT dataset, id, 'class', 'class Customer' FROM cust""")
    out["lookups"] = sql("cls", "cust", select="""
        SELECT dataset, id, cls AS name, 'class' AS kind FROM cls WHERE cls = 'P_1_URGENT' UNION ALL SELECT dataset, id, 'Status', 'enum' FROM cust""")
    out["parse_warnings"] = sql("loose_lines", select="""
        SELECT dataset, id, line_no::BIGINT AS line_no, 'Line ' || line_no || ': Skipped ''' || t || '''' AS warning FROM loose_lines WHERE what = 'unknown'""")
    out["error_context"] = sql("loose_lines", select="""
        , n AS (SELECT *, lag(t) OVER w AS a, lead(t) OVER w AS b FROM loose_lines WINDOW w AS (PARTITION BY id ORDER BY line_no))
        SELECT dataset, id, line_no::BIGINT AS line_no, '    ' || (line_no - 1) || ': ' || a || chr(10) || '>>> ' || line_no || ': ' || t || chr(10)
          || '    ' || (line_no + 1) || ': ' || b AS context FROM n WHERE what = 'unknown'""")

    # the dressed texts line by line: (SQL of the line, what the fence, comment and cleaning rules make of it); None: the line goes
    same = object()
    key = "o_orderkey"
    dressed = (
        (f"'Intro ' || {key}", same, None, same), ("'  ```plantuml'", "'plantuml'", None, same), ("'@STARTUML'", same, same, same),
        ("'enum E <<enum>>'", same, same, "'enum E'"), ("'class A /'' block ' || o_orderstatus", same, "'class A '", same),
        (f"'still ' || {key} || ' ''/ {{'", same, "' {'", same), (f"'n' || {key} || ' : Int // tail'", same, f"'n' || {key} || ' : Int'", same),
        ("'}'", same, same, same), ("'// gone'", same, "''", same), (f"chr(39) || ' note ' || {key}", same, "''", same),
        ("'A <--> B'", same, same, "'A -- B'"), ("'A \"1\"*- B'", same, same, "'A \"1\"- B'"), ("'(A, B) . C'", same, same, None),
        ("'<> dia'", same, same, None), ("'note \"x\" as N1'", same, same, None), ("'X *-> Y'", same, same, None), ("'@EndUml'", same, same, same),
        ("'```'", "''", None, same), ("'@startuml'", same, None, same), (f"'class Z' || {key}", same, None, same), ("'@enduml'", same, None, same),
    )

    def joined(rule: int | None, between: str = "chr(10)", part: slice = slice(None)) -> str:
        texts = [line[0] if rule is None or line[rule] is same else line[rule] for line in dressed[part]]
        return f" || {between} || ".join(t for t in texts if t is not None)

    out["strip_code_fences"] = f"SELECT o_orderkey, {joined(1)} AS text FROM orders"
    out["clean_diagram_markup"] = f"SELECT o_orderkey, {joined(3)} AS text FROM orders"
    bar = "'|'"
    out["remove_comments"] = f"SELECT o_orderkey, {joined(2, bar)} AS lines FROM orders"
    plain_block = joined(None, part=slice(18, 21))
    out["extract_markup_blocks"] = f"""
        SELECT o_orderkey, {plain_block} AS parser, {joined(None, part=slice(2, 17))} AS generator, {plain_block} AS blocks FROM orders"""

    # quality
    out["line_violations"] = sql("bad_lines", select="SELECT * FROM bad_lines")
    out["declare_missing"] = sql("cust", select="SELECT dataset, id, 'Customer' AS name, 'class Customer { }' AS line FROM cust")
    out["drop_malformed_relationships"] = sql("loose_lines", select="""
        SELECT dataset, id, string_agg(t, chr(10) ORDER BY line_no) FILTER (what <> 'linkP') AS puml FROM loose_lines GROUP BY ALL""")
    out["record_checks"] = sql("cust", select=f"""
        SELECT source AS dataset, doc_id AS id, CASE WHEN {_strip('text')} = '' THEN 'no_text' WHEN lower(text) NOT LIKE '%@startuml%'
          THEN 'no_start' WHEN lower(text) NOT LIKE '%@enduml%' THEN 'no_end' ELSE '' END AS problems FROM documents
        UNION ALL SELECT dataset, id, '' FROM cust""")
    out["strict_checks"] = sql("cust", select="""
        SELECT dataset, id, 'explicit_class' AS problems FROM cust
        UNION ALL SELECT dataset, id, '' FROM cust""")
    whole = """
        , body AS (SELECT id, string_agg(txt, chr(10) ORDER BY cls) AS t FROM (SELECT id, cls, 'class ' || cls || ' {' || chr(10) ||
            string_agg('  order_' || k || ' : Double', chr(10) ORDER BY k) || chr(10) || '}' AS txt FROM ord GROUP BY id, cls) GROUP BY id),
        lits AS (SELECT id, string_agg(DISTINCT '  ' || st || chr(10), '' ORDER BY '  ' || st || chr(10)) AS t FROM ord GROUP BY id),
        lk AS (SELECT id, string_agg('Customer "1" ' || CASE st WHEN 'F' THEN '*--' WHEN 'O' THEN '--' ELSE 'o--' END || ' "' || n || '" ' || cls || ' : ' || st,
            chr(10) ORDER BY cls, o) AS t FROM link GROUP BY id)
"""
    text = """'@startuml' || chr(10) || 'enum Status {' || chr(10) || lits.t || '}' || chr(10) || 'class Customer { }' || chr(10)
          || body.t || chr(10) || lk.t || chr(10) || '@enduml'"""
    out["validate"] = sql("ord", "cust", "link", "cls", select=whole + f"""
        SELECT c.dataset, c.id, true AS ok, {text} AS repaired, '' AS errors
        FROM cust c JOIN body ON body.id = c.id JOIN lits ON lits.id = c.id JOIN lk ON lk.id = c.id""")
    out["render_diagram"] = sql("ord", "cust", "link", "cls", select=whole + f"""
        SELECT c.dataset, c.id, {text} AS puml
        FROM cust c JOIN body ON body.id = c.id JOIN lits ON lits.id = c.id JOIN lk ON lk.id = c.id""")
    out["validate_loose"] = sql("bad_lines", "link", "cust", select="""
        , good AS (SELECT id, string_agg('Customer "1" ' || CASE st WHEN 'F' THEN '<--' ELSE '-' END || ' "' || n || '" ' || cls || ' : ' || st, chr(10) ORDER BY cls, o) AS t,
            string_agg(DISTINCT 'class ' || cls || ' { }', chr(10) ORDER BY 'class ' || cls || ' { }') AS m FROM link WHERE st <> 'P' GROUP BY id),
        errs AS (SELECT dataset, id, string_agg(error, '|' ORDER BY line_no) AS t, string_agg(error, ' | ' ORDER BY line_no) AS u FROM bad_lines GROUP BY ALL)
        SELECT e.dataset, e.id, false AS ok, '@startuml' || chr(10) || 'class Customer { }' || chr(10) || g.m || chr(10) || g.t || chr(10) || '@enduml' AS repaired,
          e.t || CASE WHEN g.id IS NULL THEN '|nothing_left' ELSE '' END AS errors, e.u || CASE WHEN g.id IS NULL THEN ' | nothing_left' ELSE '' END AS error_text
        FROM errs e LEFT JOIN good g ON g.id = e.id""")
    out["dsl_sections"] = sql("cust", "ord", select="""
        , m AS (SELECT dataset, id, cls, count(*) AS n, string_agg('Double order_' || k, ', ' ORDER BY k) AS t, row_number() OVER (PARTITION BY id ORDER BY cls) AS p
          FROM ord GROUP BY dataset, id, cls)
        SELECT dataset, id, section, line_no::BIGINT AS line_no, content FROM (
          SELECT dataset, id, 'enum' AS section, 3 AS line_no, 'Level(' || string_agg(cls, ', ' ORDER BY cls) || ')' AS content FROM m GROUP BY dataset, id
          UNION ALL SELECT dataset, id, 'class', 5, 'abstract Customer()' FROM cust
          UNION ALL SELECT dataset, id, 'class', 5 + p, cls || '(' || t || ')' FROM m
          UNION ALL SELECT m.dataset, m.id, 'relationship', 6 + c.nc + p, CASE WHEN m.n > 1 THEN '1 Customer contain ' || m.n || ' ' || cls
            ELSE cls || ' inherit Customer' END FROM m JOIN cust c ON c.id = m.id)""")
    out["dsl_elements"] = sql("ord", "cls", "cust", select="""
        SELECT dataset, id, 'enum' AS kind, 'Level' AS name, false AS is_abstract, cls AS member, NULL::VARCHAR AS type FROM cls
        UNION ALL SELECT dataset, id, 'class', 'Customer', true, NULL, NULL FROM cust
        UNION ALL SELECT dataset, id, 'class', cls, false, 'order_' || k, 'Double' FROM ord""")
    out["dsl_relationships"] = sql("cls", select="""
        SELECT dataset, id, 'Customer' AS source, cls AS target, CASE WHEN n > 1 THEN 'composition' ELSE 'inheritance' END AS kind,
          CASE WHEN n > 1 THEN '1' END AS source_card, CASE WHEN n > 1 THEN n::VARCHAR END AS target_card FROM cls""")
    out["dsl_to_diagram"] = sql("ord", "cls", "cust", select="""
        , body AS (SELECT id, string_agg(txt, chr(10) ORDER BY cls) AS t FROM (SELECT id, cls, 'class ' || cls || ' {' || chr(10) ||
            string_agg('  order_' || k || ' : Double', chr(10) ORDER BY k) || chr(10) || '}' AS txt FROM ord GROUP BY id, cls) GROUP BY id),
        lits AS (SELECT id, string_agg('  ' || cls || chr(10), '' ORDER BY cls) AS t FROM cls GROUP BY id),
        lk AS (SELECT id, string_agg(CASE WHEN n > 1 THEN 'Customer "1" *-- "' || n || '" ' || cls ELSE 'Customer <|-- ' || cls END, chr(10) ORDER BY cls) AS t FROM cls GROUP BY id)
        SELECT c.dataset, c.id, '@startuml' || chr(10) || 'enum Level {' || chr(10) || lits.t || '}' || chr(10) || 'abstract class Customer { }' || chr(10)
          || body.t || chr(10) || lk.t || chr(10) || '@enduml' AS puml
        FROM cust c JOIN body ON body.id = c.id JOIN lits ON lits.id = c.id JOIN lk ON lk.id = c.id""")
    out["parse_failure_report"] = sql("cust", "loose_lines", select="""
        , first_bad AS (SELECT id, arg_min('Unrecognized line ' || line_no || ': ''' || t || '''', line_no) AS e FROM loose_lines WHERE what = 'unknown' GROUP BY id)
        SELECT dataset, 'strict' AS setting, count(*) AS total, count(*) AS passed, 0::BIGINT AS failed, 100.0::DOUBLE AS success_pct, NULL::VARCHAR AS first_model,
          NULL::VARCHAR AS first_setting, NULL::VARCHAR AS first_error FROM cust GROUP BY dataset
        UNION ALL SELECT dataset, 'loose', count(*), count(*) - count(b.id), count(b.id), round(100.0 * (count(*) - count(b.id)) / count(*), 6)::DOUBLE,
          CASE WHEN count(b.id) > 0 THEN dataset END, CASE WHEN count(b.id) > 0 THEN 'loose' END, arg_min(b.e, b.id)
          FROM cust c LEFT JOIN first_bad b ON b.id = c.id GROUP BY dataset""")
    out["failure_patterns"] = sql("loose_lines", select="""
        SELECT '??' AS error_type, count(DISTINCT id) AS n FROM loose_lines WHERE what = 'unknown'""")

    # comparison
    out["element_sets"] = sql("side_a", select="SELECT * FROM side_a")
    out["jaccard"] = sql("set_counts", select=f"SELECT *, {_r('n_both / (n_first + n_second - n_both)')} AS jaccard FROM set_counts")
    lists = ", ".join(
        f"coalesce(string_agg(key, '|' ORDER BY key) FILTER ({c}), '') AS {n}"
        for n, c in (("only_in_first", "in_a AND NOT in_b"), ("only_in_second", "in_b AND NOT in_a"), ("intersection", "in_a AND in_b"))
    )
    out["set_diff"] = sql("both_sides", select=f"SELECT dataset, id, kind, {lists} FROM both_sides GROUP BY ALL")
    three = ("classes", "attributes", "relationships")
    sides = (("only_in_first", "in_a AND NOT in_b"), ("only_in_second", "in_b AND NOT in_a"), ("intersection", "in_a AND in_b"))
    out["compare"] = sql("both_sides", select="""
        SELECT dataset, id, """ + ", ".join(
        _r(f"count_if(kind = '{k}' AND in_a AND in_b) / count_if(kind = '{k}')") + f" AS jaccard_{k}" for k in (*three, "enum_values")) + ", " + ", ".join(
        f"coalesce(string_agg(key, '|' ORDER BY key) FILTER (kind = '{k}' AND {c}), '') AS {n}_{k}" for k in three for n, c in sides) + """
        FROM both_sides GROUP BY dataset, id""")
    out["set_members"] = sql("both_sides", select="""
        SELECT dataset, id, kind, key, CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'first' ELSE 'second' END AS side FROM both_sides""")
    side_sizes = """
        , na AS (SELECT id, count(DISTINCT cls) + 1 AS c, count(DISTINCT (cls, st)) AS r FROM ord GROUP BY id),
        nb AS (SELECT id, count(DISTINCT cls) + 1 AS c, count(DISTINCT (cls, st)) AS r FROM ord WHERE k % 10 <> 0 GROUP BY id)"""
    out["cross_dataset_report"] = sql("cross_jaccard", "ord", select=side_sizes + f"""
        SELECT j.id, {_r('jaccard_classes')} AS jaccard_classes, {_r('jaccard_attributes')} AS jaccard_attributes, {_r('jaccard_rels')} AS jaccard_rels,
          only_in_first_classes, only_in_second_classes, only_in_first_rels, only_in_second_rels, na.c AS first_n_classes, na.r AS first_n_rels,
          nb.c AS second_n_classes, nb.r AS second_n_rels FROM cross_jaccard j JOIN na ON na.id = j.id JOIN nb ON nb.id = j.id""")
    out["cross_report"] = sql("cross_jaccard", select=f"""
        SELECT id, {_r('jaccard_classes')} AS jaccard_classes, {_r('jaccard_attributes')} AS jaccard_attributes, {_r('jaccard_rels')} AS jaccard_rels,
          only_in_first_classes, only_in_second_classes, only_in_first_rels, only_in_second_rels FROM cross_jaccard""")
    out["element_prf"] = sql("set_counts", select=f"""
        SELECT dataset, id, kind, {_r('n_both / n_second')} AS precision, {_r('n_both / n_first')} AS recall, {_r('2 * n_both / (n_first + n_second)')} AS f1 FROM set_counts""")

    # matching
    out["sentence_stats"] = sql("sent_hits", "words", select="""
        , n AS (SELECT dataset, id, sent_i, count(*) AS n_tokens FROM words GROUP BY ALL)
        SELECT h.*, coalesce(n.n_tokens, 0) AS n_tokens FROM sent_hits h LEFT JOIN n ON n.dataset = h.dataset AND n.id = h.id AND n.sent_i = h.sent_i""")
    out["text_index"] = sql("idx", select="SELECT * FROM idx")
    flags = "l1, l2, l3, l4, absent"
    three = "kind IN ('class', 'attribute', 'enum_value')"
    out["match_levels"] = sql("matched", select=f"SELECT dataset, id, kind, owner, name, {flags}, matched_tokens FROM matched WHERE {three}")
    out["match_levels_by_index"] = out["match_levels"]
    out["sentence_indices"] = sql("matched", select=f"SELECT dataset, id, kind, owner, name, array_to_string(sents, '|') AS sent_indices FROM matched WHERE {three}")
    role = lambda t, n: ", ".join(f"{t}.{f} AS {n}_{f}" for f in ("l1", "l2", "l3", "l4", "absent")) + f", array_to_string({t}.sents, '|') AS {n}_sent_indices"
    out["match_relationships"] = sql("rels", "matched", select=f"""
        , ends AS MATERIALIZED (SELECT * FROM matched WHERE kind IN ('rel_source', 'rel_target', 'rel_label'))
        SELECT r.dataset, r.id, r.source, r.target, r.kind, r.label, {role('s', 'source')}, {role('t', 'target')}, {role('l', 'label')},
          array_to_string(list_sort(list_intersect(s.sents, t.sents)), '|') AS common_sentences
        FROM rels r JOIN ends s ON s.dataset = r.dataset AND s.id = r.id AND s.kind = 'rel_source' AND s.name = r.source
        JOIN ends t ON t.dataset = r.dataset AND t.id = r.id AND t.kind = 'rel_target' AND t.name = r.target
        JOIN ends l ON l.dataset = r.dataset AND l.id = r.id AND l.kind = 'rel_label' AND l.name = r.label""")
    out["per_element_table"] = sql("rels", "matched", select=f"""
        SELECT dataset, id, kind, CASE WHEN owner IS NULL THEN name ELSE owner || '.' || name END AS name, {flags}, array_to_string(sents, ';') AS sent_indices
        FROM matched WHERE {three}
        UNION ALL SELECT r.dataset, r.id, 'rel_endpoint', r.source || '-(' || r.kind || ')->' || r.target || CASE WHEN m.kind = 'rel_target' THEN ' (tgt)' ELSE '' END,
          {flags}, array_to_string(sents, ';') FROM rels r JOIN matched m ON m.id = r.id AND ((m.kind = 'rel_source' AND m.name = r.source) OR (m.kind = 'rel_target' AND m.name = r.target))""")
    pct = ", ".join(f"{_r('pct_' + c)}::DOUBLE AS pct_{c}" for c in ("l1", "l2", "l3", "l4", "absent"))
    out["coverage_summary"] = sql("coverage", select=f"SELECT dataset, id, kind, n, {pct} FROM coverage")
    out["absent_names"] = sql("matched", select="SELECT name, count(*) AS n FROM matched WHERE kind = 'class' AND absent GROUP BY name")
    out["absent_totals"] = sql("matched", select="""
        SELECT count(*) AS n_total, count(DISTINCT name) AS n_unique FROM matched WHERE kind = 'class' AND absent""")
    out["normalise_names"] = sql("elements", "vocabulary", select=r"""
        SELECT dataset, id, kind, owner, name, CASE WHEN lower(name) IN (SELECT token FROM vocabulary) THEN regexp_replace(lower(name), 's$', '') ELSE lower(name) END
          AS normalised FROM elements""")

    # trees
    path = "array_to_string(path, '|') AS path, array_to_string(texts, ' ') AS path_text"
    out["tree_paths"] = sql("closure", select="""
        SELECT a.dataset, a.id, a.sent_i, (a.depth + b.depth)::BIGINT AS hop, 0::BIGINT AS src_i, b.i AS tgt_i,
          array_to_string(list_concat(a.path, list_reverse(b.path[1:len(b.path) - 1])), '|') AS path,
          array_to_string(list_concat(a.texts, list_reverse(b.texts[1:len(b.texts) - 1])), ' ') AS path_text
        FROM closure a JOIN closure b ON b.dataset = a.dataset AND b.id = a.id AND b.sent_i = a.sent_i AND b.anc = a.anc AND b.i > 0
        WHERE a.i = 0 AND a.depth + b.depth <= 4
        QUALIFY row_number() OVER (PARTITION BY a.dataset, a.id, a.sent_i, b.i ORDER BY a.depth + b.depth) = 1""")
    out["class_attr_bindings"] = sql("attr_bound", select=f"""
        SELECT dataset, id, class, attribute, hop::BIGINT AS hop, sent_i, src_i, tgt_i, {path} FROM attr_bound""")
    out["class_attr_bindings_gapped"] = sql("attr_bound", select="""
        SELECT dataset, id, class, attribute, hop::BIGINT AS hop, sent_i, 3 * src_i + 17 * (sent_i % 11) AS src_i, 3 * tgt_i + 17 * (sent_i % 11) AS tgt_i,
          array_to_string(list_transform(path, lambda x: 3 * x + 17 * (sent_i % 11)), '|') AS path, array_to_string(texts, ' ') AS path_text FROM attr_bound""")
    out["class_attr_bindings_cross"] = sql("hits", "closure", select="""
        , best AS (SELECT a.dataset, a.id, c.name AS class, a.name AS attribute, a.sent_i, x.i AS src_i, y.i AS tgt_i, x.depth + y.depth AS hop,
            list_concat(x.path, list_reverse(y.path[1:len(y.path) - 1])) AS path, list_concat(x.texts, list_reverse(y.texts[1:len(y.texts) - 1])) AS texts
          FROM hits a JOIN hits c ON c.dataset = a.dataset AND c.id = a.id AND c.kind = 'class' AND c.sent_i = a.sent_i
          JOIN closure x ON x.dataset = c.dataset AND x.id = c.id AND x.sent_i = c.sent_i AND x.i = c.i
          JOIN closure y ON y.dataset = a.dataset AND y.id = a.id AND y.sent_i = a.sent_i AND y.i = a.i AND y.anc = x.anc
          WHERE a.kind = 'attribute' AND x.depth + y.depth <= 4
          QUALIFY row_number() OVER (PARTITION BY a.dataset, a.id, c.name, a.name ORDER BY x.depth + y.depth, a.sent_i, x.i, y.i) = 1),
        t AS (SELECT dataset, id, class, attribute || ':' || hop || ':' || sent_i || ':' || src_i || ':' || tgt_i || ':' || array_to_string(path, '-') || ':'
          || array_to_string(texts, ' ') AS shown FROM best)
        SELECT dataset, id, class, count(*) AS n, md5(string_agg(shown, '|' ORDER BY shown)) AS digest FROM t GROUP BY ALL""")
    out["relationship_bindings"] = sql("rel_paths", "rel_bound", select=f"""
        , every AS (SELECT dataset, id, source, target, string_agg(sent_i || ':' || hop || ':' || src_i || ':' || tgt_i || ':' || array_to_string(texts, ' '), '|' ORDER BY sent_i)
          AS all_sentences FROM rel_paths GROUP BY ALL)
        SELECT dataset, id, source, target, n_sentences, hop::BIGINT AS hop, sent_i, src_i, tgt_i, {path}, all_sentences
        FROM rel_bound JOIN every USING (dataset, id, source, target)""")
    out["kind_coverage"] = sql("kind_cov", select=f"SELECT dataset, id, rel_kind, n, n_bound, {_r('pct_bound')}::DOUBLE AS pct_bound FROM kind_cov")
    out["binding_summary"] = sql("bindings", select=f"""
        SELECT dataset, id, n_attrs_total, n_attrs_bound, {_r('pct_attrs_bound')}::DOUBLE AS pct_attrs_bound, n_rels_total, n_rels_bound,
          {_r('pct_rels_bound')}::DOUBLE AS pct_rels_bound, {_r('avg_hop_class_attr')} AS avg_hop_class_attr, {_r('avg_hop_rel')} AS avg_hop_rel FROM bindings""")
    out["token_features"] = sql("tokens", "entities", select=f"""
        , et AS (SELECT id, string_agg(label || ':' || c, ';' ORDER BY label) AS entity_types, sum(c)::BIGINT AS n FROM
          (SELECT id, label, count(*) AS c FROM entities GROUP BY ALL) GROUP BY id)
        SELECT t.dataset, t.id, count(*) AS n_tokens, count(DISTINCT sent_i) AS n_sents, count_if(dep = 'nsubj')::BIGINT AS n_nsubj, 0::BIGINT AS n_nsubjpass,
          count_if(dep = 'dobj')::BIGINT AS n_dobj, count_if(pos = 'VERB')::BIGINT AS n_verbs, count_if(pos = 'NOUN')::BIGINT AS n_nouns, 0::BIGINT AS n_adjectives,
          count_if(dep IN ('nsubj', 'dobj', 'pobj'))::BIGINT AS n_noun_chunks, coalesce(any_value(et.n), 0)::BIGINT AS n_entities,
          coalesce(any_value(et.entity_types), '') AS entity_types, 0.0::DOUBLE AS passive_ratio, {_r('count_if(head_i <> i) / count(*)')} AS mean_children,
          count(DISTINCT CASE WHEN regexp_matches(text, '^[a-z]+$') THEN lower(lemma) END) AS n_unique_lemmas
        FROM tokens t LEFT JOIN et ON et.id = t.id GROUP BY t.dataset, t.id""")
    ratios = ", ".join(f"{_r(c)} AS {c}" for c in ("passive_ratio", "hedge_density", "modal_density", "entity_density"))
    out["style_features"] = sql("style", select=f"""
        SELECT dataset, id, passive_nsubjpass, active_nsubj, modal_count, hedge_count, named_entities, {ratios} FROM style""")
    out["mean_root_distance"] = sql("tokens", select=f"""
        , d AS (SELECT dataset, id, sent_i, i, head_i, 0 AS depth, head_i AS nxt, i AS at FROM tokens
          UNION ALL SELECT d.dataset, d.id, d.sent_i, d.i, d.head_i, d.depth + 1, t.head_i, t.i FROM d JOIN tokens t
            ON t.dataset = d.dataset AND t.id = d.id AND t.sent_i = d.sent_i AND t.i = d.nxt WHERE d.nxt <> d.at AND d.depth < 32)
        SELECT dataset, id, {_r('avg(m)')} AS mean_root_distance FROM (SELECT dataset, id, sent_i, i, max(depth) AS m FROM d GROUP BY ALL) GROUP BY ALL""")
    out["mean_root_distance_gapped"] = out["mean_root_distance"]
    out["token_graph"] = sql("tokens", select=f"""
        SELECT dataset, id, count(*) AS n_nodes, count_if(head_i <> i)::BIGINT AS n_edges, count_if(dep IN ('nsubj', 'dobj', 'pobj'))::BIGINT AS n_noun_chunks,
          {_r('count_if(head_i <> i) / count(*)')} AS mean_children FROM tokens GROUP BY ALL""")
    out["token_edges"] = sql("tokens", select="SELECT dataset, id, sent_i, head_i AS src, i AS tgt, dep FROM tokens WHERE head_i <> i")

    # extraction
    out["class_names"] = sql("class_words", select="SELECT * FROM class_words")
    out["candidate_nouns"] = sql("tokens", select="SELECT dataset, id, sent_i, i, text, lemma, tag, dep FROM tokens WHERE pos = 'NOUN' AND "
        "text NOT IN ('i.e','e.g','etc','cf','vs','al','viz','approx','yes','no','true','false')")
    out["promote_svo"] = sql("tokens", select="""
        , f AS (SELECT *, CASE WHEN pos = 'VERB' THEN i ELSE head_i END AS v, pos = 'NOUN'
            AND (text LIKE 't%' OR text IN ('i.e','e.g','etc','cf','vs','al','viz','approx','yes','no','true','false')) AS fresh FROM tokens),
        w AS (SELECT dataset, id, sent_i, i, text, fresh, max(CASE WHEN fresh AND dep = 'nsubj' THEN i END) OVER v AS s,
            max(CASE WHEN fresh AND dep = 'dobj' THEN i END) OVER v AS o, bool_or(pos = 'VERB') OVER v AS verb
          FROM f WINDOW v AS (PARTITION BY id, sent_i, v))
        SELECT dataset, id, sent_i, i, CASE WHEN text LIKE 't%' THEN '-' || text ELSE text END AS text,
          fresh AND coalesce(verb AND s IS NOT NULL AND o IS NOT NULL AND (i = s OR i = o), false) AS promoted FROM w""")
    cap = lambda x: f"upper(left({x}, 1)) || lower(substr({x}, 2))"
    card = lambda x: f"CASE WHEN {x} = 'NNS' THEN '1..*' ELSE '1' END"
    rules = {
        "association": _verb_rule(
            "1", "'take','send','buy','give','show','record','work','talk'", "true",
            "x.verb || CASE WHEN lp.prep IS NULL THEN '' ELSE ' ' || lp.prep END", "true", False),
        "aggregation": _verb_rule(
            "2", "'hold','carry','involve','imply','embrace','consist','comprise','belong','divide','include'", _AGG_OK.format(l="x.lemma", p="o.prep"),
            "x.lemma || CASE WHEN lp.prep IS NULL THEN '' ELSE ' ' || lp.prep END", _AGG_OK.format(l="v.lemma", p="p.text"), False),
        "composition": _verb_rule("3", "'have','comprise','possess','contain'", "false", "x.lemma", "false", True),
        "include": (
            """
        , first_subject AS (SELECT dataset, id, sent_i, head_i, arg_min(text, i) AS st, arg_min(tag, i) AS stag FROM
          (SELECT r.* FROM roles r JOIN tokens t ON t.dataset = r.dataset AND t.id = r.id AND t.sent_i = r.sent_i AND t.i = r.i WHERE t.dep = 'nsubj') GROUP BY ALL),
        included AS (SELECT DISTINCT v.dataset, v.id, v.sent_i, v.i, s.st, s.stag, o.text, o.tag FROM tokens v
          JOIN first_subject s ON s.dataset = v.dataset AND s.id = v.id AND s.sent_i = v.sent_i AND s.head_i = v.i
          JOIN roles o ON o.dataset = v.dataset AND o.id = v.id AND o.sent_i = v.sent_i AND o.head_i = v.i AND o.dep = 'dobj'
          WHERE v.pos = 'VERB' AND v.lemma = 'include' AND s.st <> o.text)""",
            f"""
        SELECT dataset, id, sent_i, {cap('text')} AS source, 'include' AS label, {cap('st')} AS target, {card('tag')} AS source_card,
          {card('stag')} AS target_card FROM included"""),
        "generalization": (
            """
        , be AS (SELECT dataset, id, sent_i, min(i) AS b FROM tokens WHERE lemma = 'be' GROUP BY ALL),
        ok AS (SELECT t.* FROM tokens t JOIN class_words c ON c.dataset = t.dataset AND c.id = t.id AND c.name_lower = lower(t.text)
          WHERE lower(t.text) NOT IN ('category', 'type', 'kind', 'a')),
        subj AS (SELECT be.dataset, be.id, be.sent_i, arg_min(ok.text, ok.i) AS s FROM be JOIN ok ON ok.dataset = be.dataset AND ok.id = be.id
          AND ok.sent_i = be.sent_i AND ok.head_i = be.b WHERE ok.dep = 'nsubj' GROUP BY ALL),
        attr AS (SELECT be.dataset, be.id, be.sent_i, arg_min(ok.text, ok.i) AS o FROM be JOIN ok ON ok.dataset = be.dataset AND ok.id = be.id
          AND ok.sent_i = be.sent_i AND ok.head_i = be.b WHERE ok.dep = 'attr' GROUP BY ALL),
        ofp AS (SELECT be.dataset, be.id, be.sent_i, arg_min(ok.text, (p.i, ok.i)) AS o FROM be JOIN tokens p ON p.dataset = be.dataset AND p.id = be.id
          AND p.sent_i = be.sent_i AND p.head_i = be.b AND p.dep = 'prep' AND p.text = 'of' JOIN ok ON ok.dataset = be.dataset AND ok.id = be.id
          AND ok.sent_i = be.sent_i AND ok.head_i = p.i AND ok.dep = 'pobj' GROUP BY ALL)""",
            f"""
        SELECT s.dataset, s.id, s.sent_i, {cap('s.s')} AS source, {cap('coalesce(a.o, f.o)')} AS target FROM subj s
        LEFT JOIN attr a ON a.dataset = s.dataset AND a.id = s.id AND a.sent_i = s.sent_i
        LEFT JOIN ofp f ON f.dataset = s.dataset AND f.id = s.id AND f.sent_i = s.sent_i WHERE coalesce(a.o, f.o) IS NOT NULL"""),
    }
    for rule, (views, final) in rules.items():
        out[f"extract_{rule}"] = sql("tokens", "roles", "objects", "class_words", select=views + final)
    kinds = {"association": "--", "aggregation": "o--", "composition": "*--", "include": "*--", "generalization": "<|--"}
    shown = " UNION ALL ".join(
        f"SELECT id, source, target, source || ' {arrow} ' || target AS line FROM ({final})" if rule == "generalization" else
        f"""SELECT id, source, target, source || ' "' || source_card || '" {arrow} "' || target_card || '" ' || target{" || ' : ' || label" * (rule == "association")} AS line FROM ({final})"""
        for (rule, (_, final)), arrow in zip(rules.items(), kinds.values()))
    out["relations_to_diagram"] = sql("tokens", "roles", "objects", "class_words", select="".join(v for v, _ in rules.values()) + f"""
        , r AS MATERIALIZED ({shown}),
        l AS (SELECT id, line FROM r UNION ALL SELECT id, 'class ' || name || ' {{ }}' FROM (SELECT DISTINCT id, name FROM
            (SELECT id, source AS name FROM r UNION ALL SELECT id, target FROM r))
          UNION ALL SELECT DISTINCT id, unnest(['@startuml', '@enduml']) FROM r),
        g AS (SELECT id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY id)
        SELECT d.source AS dataset, d.doc_id AS id, g.id IS NULL AS failed, CASE WHEN g.id IS NULL THEN 'no_relations' END AS error,
          coalesce(n, 1)::BIGINT AS n_lines, coalesce(h, md5('')) AS digest FROM documents d LEFT JOIN g ON g.id = d.doc_id""")
    out["extract_association_gapped"] = out["extract_association"]
    union = " UNION ALL ".join(f"SELECT '{rule}' AS rule, id, source, target FROM ({final})" for rule, (_, final) in rules.items())
    out["relations_read_back"] = sql("tokens", "roles", "objects", "class_words", select="".join(v for v, _ in rules.values()) + f"""
        , r AS MATERIALIZED ({union}),
        n AS (SELECT id, count(*) AS n_relationships, count_if(rule = 'association')::BIGINT AS a, count_if(rule = 'aggregation')::BIGINT AS g,
          count_if(rule IN ('composition', 'include'))::BIGINT AS c, count_if(rule = 'generalization')::BIGINT AS i FROM r GROUP BY id),
        k AS (SELECT id, count(DISTINCT name) AS n_classes FROM (SELECT id, source AS name FROM r UNION ALL SELECT id, target FROM r) GROUP BY id)
        SELECT d.source AS dataset, d.doc_id AS id, n.id IS NULL AS failed, CASE WHEN n.id IS NULL THEN 'no_relations' END AS error, n_classes, n_relationships,
          a AS n_rels_association, g AS n_rels_aggregation, c AS n_rels_composition, i AS n_rels_inheritance, CASE WHEN n.id IS NOT NULL THEN 0::BIGINT END AS n_implicit_classes
        FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN k ON k.id = d.doc_id""")

    # scores
    labels = "['[0, 0.1)','[0.1, 0.2)','[0.2, 0.3)','[0.3, 0.4)','[0.4, 0.5)','[0.5, 0.6)','[0.6, 0.7)','[0.7, 0.8)','[0.8, 0.9)','[0.9, 1.0]']"
    label = lambda c: f"{labels}[{c} + 1]"
    out["bucketise"] = sql("bucketed", select=f"""
        SELECT candidate, dataset, element, bucket::BIGINT AS bucket, {label('bucket')} AS label, count(*) AS n FROM bucketed GROUP BY ALL""")
    buckets = [f"count_if(bucket = {i})::BIGINT" for i in range(10)]
    summary = "candidate, dataset, element, count(score) AS n"
    out["summarise"] = sql("bucketed", select=f"""
        , m AS (SELECT candidate, dataset, element, avg(score) AS mean FROM bucketed GROUP BY ALL)
        SELECT candidate, dataset, element, count(*) AS n, {_s('any_value(mean)')} AS mean, {_s('stddev_pop(score)')} AS std, {_s('median(score)')} AS median,
          {_s('avg(abs(score - mean))')} AS mad, {" || '|' || ".join(buckets)} AS buckets, count(error) AS failed
        FROM bucketed JOIN m USING (candidate, dataset, element) GROUP BY candidate, dataset, element""")
    named = ", ".join(f'{b} AS "{name}"' for b, name in zip(buckets, (
        "[0, 0.1)", "[0.1, 0.2)", "[0.2, 0.3)", "[0.3, 0.4)", "[0.4, 0.5)", "[0.5, 0.6)", "[0.6, 0.7)", "[0.7, 0.8)", "[0.8, 0.9)", "[0.9, 1.0]")))
    out["bucket_table"] = sql("bucketed", select=f"""
        SELECT {summary}, count(error) AS n_failed, {named}, {_s('avg(score)')} AS mean, {_s('median(score)')} AS median FROM bucketed GROUP BY candidate, dataset, element""")
    out["error_table"] = sql("scores", select="SELECT candidate, dataset, id, error, NULL::VARCHAR AS raw_excerpt FROM scores WHERE error IS NOT NULL")
    out["error_taxonomy"] = """
        SELECT o_orderpriority AS candidate, o_orderstatus AS dataset, CASE WHEN o_orderstatus = 'F' THEN 'exception' WHEN o_orderpriority = '1-URGENT'
          THEN 'plantuml_validator' WHEN o_orderpriority = '2-HIGH' THEN 'no_classes' WHEN o_orderpriority = '3-MEDIUM' THEN 'no_plantuml' ELSE 'other' END AS kind,
          count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL"""
    out["failure_rate"] = sql("scores", select=f"""
        SELECT dataset, candidate, count(*) AS n, count(error) AS n_errors, {_r('100 * count(error) / count(*)')} AS failure_pct FROM scores GROUP BY ALL""")
    out["run_totals"] = sql("scores", select="""
        SELECT candidate, dataset, run_index::BIGINT AS run_index, count(*) AS n_records, count_if(id % 10 = 0)::BIGINT AS n_failed_generate,
          count_if(error IS NOT NULL AND id % 10 <> 0)::BIGINT AS n_failed_score, sum(id % 7)::DOUBLE AS elapsed_seconds FROM scores GROUP BY ALL""")
    bucket_of = lambda c: "CASE " + " ".join(f"WHEN {c} < {u} THEN {i}" for i, u in enumerate((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))) + " ELSE 9 END"
    elements = ("class_score", "attribute_score", "association_score")
    out["build_run_records"] = sql("scores", select=f"""
        SELECT candidate, dataset, model, run_index::BIGINT AS run_index, id::VARCHAR AS id, error AS s_error, {", ".join(f"{_r(e)} AS s_{e}" for e in elements)},
          {", ".join(f"{label('(' + bucket_of(e) + ')')} AS b_{e}" for e in elements)} FROM scores""")
    out["per_run_table"] = sql("long_scores", select=f"""
        SELECT dataset, candidate, model, run_index::BIGINT AS run_index, element, count(score) AS n, count(error) AS failed, {_s('median(score)')} AS median,
          {_s('stddev_pop(score)')} AS std, {_s('avg(score)')} AS mean FROM long_scores GROUP BY dataset, candidate, model, run_index, element""")
    out["run_stability"] = sql("long_scores", select=f"""
        , m AS (SELECT candidate, model, dataset, run_index, element, avg(score) AS x FROM long_scores GROUP BY ALL)
        SELECT candidate, model, dataset, element, count(*) AS n_runs, {_s('median(x)')} AS median, {_s('stddev_samp(x)')} AS std FROM m GROUP BY ALL""")
    out["baseline_gap"] = sql("cand_means", select=f"""
        SELECT c.dataset, c.element, c.candidate, {_s('c.mean')} AS mean, {_s('b.mean')} AS baseline_mean, {_s('c.mean - b.mean')} AS gap FROM cand_means c
        LEFT JOIN cand_means b ON b.dataset = c.dataset AND b.element = c.element AND b.candidate = 'A'""")
    out["mean_pivot"] = sql("scores", select=f"""
        SELECT candidate, {_s('avg(class_score)')} AS class_score, {_s('avg(attribute_score)')} AS attribute_score, {_s('avg(association_score)')} AS association_score
        FROM scores GROUP BY candidate""")
    out["leaderboard"] = sql("cand_means", select=f"""
        SELECT dataset, element, candidate, {_s('mean')} AS mean, rank() OVER (PARTITION BY dataset, element ORDER BY mean DESC) AS rank FROM cand_means""")
    f1 = lambda k: f"coalesce({_r(f'max(2 * n_both / (n_first + n_second)) FILTER (s.kind = {chr(39)}{k}{chr(39)})')}, 0.0)"
    out["score_pairs"] = sql("cust", "set_counts", select=f"""
        SELECT c.dataset, c.id, {f1('classes')} AS class_score, {f1('attributes')} AS attribute_score, {f1('relationships')} AS association_score,
          '' AS parse_warning_ref, '' AS parse_warning_gen, CASE WHEN count(s.kind) = 0 THEN 'empty_generated_model' END AS error FROM cust c LEFT JOIN set_counts s ON s.id = c.id GROUP BY c.dataset, c.id""")
    out["generate"] = r"""
        SELECT source AS dataset, doc_id AS id, text NOT LIKE '%.%' AS failed, CASE WHEN text NOT LIKE '%.%' THEN 'exception: ValueError: no sentence' END AS error,
          CASE WHEN text NOT LIKE '%.%' THEN 0 ELSE 25 + length(len(regexp_extract_all(text, '[^\p{Z}\t-\r\x{1C}-\x{1F}\x{85}]+'))::VARCHAR) END::BIGINT AS n_chars FROM documents"""
    out["generate_constant"] = """
        SELECT source AS dataset, doc_id AS id, '@startuml' || chr(10) || 'class A' || chr(10) || 'class B' || chr(10) || 'A -- B' || chr(10) || '@enduml' AS generated,
          false AS failed, NULL::VARCHAR AS error, '' AS raw_excerpt FROM documents"""
    out["annotate"] = sql("words", select="""
        SELECT dataset, id, sent_i, r AS i, w AS text, w AS lemma, 'X' AS pos, '' AS tag, 'ROOT' AS dep, r AS head_i FROM words""")

    # runs
    out["expand_matrix"] = sql("plan", select="SELECT * FROM plan")
    out["reconcile_jobs"] = sql("reconciled", select="SELECT * FROM reconciled")
    out["find_artifact"] = sql("found", select="SELECT * FROM found")
    out["resume_status"] = sql("reconciled", "found", select="""
        SELECT r.candidate, r.model, r.dataset, r.run_index, CASE WHEN r.status = 'pending' AND f.artifact IS NOT NULL THEN 'done' ELSE r.status END AS status, r.error,
          CASE WHEN r.status = 'pending' THEN f.artifact END AS artifact, r.status = 'pending' AND f.artifact IS NULL AS to_run
        FROM reconciled r JOIN found f ON f.candidate = r.candidate AND f.model IS NOT DISTINCT FROM r.model AND f.dataset = r.dataset AND f.run_index = r.run_index""")
    out["status_counts"] = sql("prev", select="""
        SELECT s.status, count(p.candidate) AS n FROM (VALUES ('done'), ('in_progress'), ('pending'), ('failed'), ('cancelled')) s(status)
        LEFT JOIN prev p ON p.status = s.status GROUP BY s.status""")
    out["failed_jobs"] = sql("prev", select="SELECT candidate, model, dataset, run_index, 'rc=1' AS error_line FROM prev WHERE status = 'failed'")
    out["exclude_examples"] = """
        SELECT source AS dataset, doc_id AS id, s.strategy FROM documents CROSS JOIN (VALUES ('q0'), ('q1')) s(strategy)
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND 'q' || l.quality = s.strategy)"""
    out["exclude_listed"] = "SELECT source AS dataset, doc_id AS id FROM documents WHERE doc_id NOT IN (0, 3, 50)"
    nl = "chr(10)"
    block = f"'### Example' || {nl} || {nl} || 'Requirements:' || {nl} || text || {nl} || {nl} || 'Diagram:' || {nl} || '@startuml' || {nl} || '@enduml' || {nl}"
    task = f"'### Task' || {nl} || {nl} || 'Requirements:' || {nl} || d.text || {nl} || {nl} || 'Diagram:' || {nl}"
    out["build_prompts"] = f"""
        WITH e AS (SELECT 's' || (item_id % 8) AS strategy, string_agg({block}, {nl} ORDER BY item_id) AS shots FROM benchmark GROUP BY ALL),
        p AS (SELECT d.source AS dataset, d.doc_id AS id, 's' || (d.doc_id % 10) AS strategy, CASE WHEN e.shots IS NULL THEN '' ELSE e.shots || {nl} END || {task} AS prompt
          FROM documents d LEFT JOIN e ON e.strategy = 's' || (d.doc_id % 10))
        SELECT dataset, id, strategy, length(prompt) AS n_chars, md5(prompt) AS digest FROM p"""
    out["flatten_chat"] = f"""
        WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
        s AS (SELECT conv_id, text FROM m WHERE n = 1 AND role = 'system')
        SELECT m.conv_id, coalesce(any_value(s.text), '') AS system,
          coalesce(string_agg(upper(m.role) || ':' || {nl} || m.text, {nl} || {nl} ORDER BY m.n) FILTER (NOT (m.n = 1 AND m.role = 'system')), '') AS user
        FROM m LEFT JOIN s ON s.conv_id = m.conv_id GROUP BY m.conv_id"""
    out["settings_with_defaults"] = """
        SELECT o_orderkey, false AS uses_llm, CASE WHEN o_orderstatus = 'F' THEN 'm' || (o_custkey % 3) END AS model,
          CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS seed, NULL::DOUBLE AS temperature, o_orderkey % 5 AS limit FROM orders"""
    # sources and sinks
    out["read_corpus"] = "SELECT source AS dataset, doc_id::VARCHAR AS id, text AS nlt, upper(lang) AS puml FROM documents"
    out["read_model_tree"] = """
        SELECT s_suppkey::VARCHAR AS id, s_name || chr(10) || n_name AS description,
          CASE WHEN s_suppkey % 3 > 0 THEN '@startuml' || chr(10) || 'class ' || regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') || chr(10) || '@enduml' END AS plantuml,
          s_name AS name, 'http://x:' || s_nationkey AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
    out["read_scored"] = sql("scores", select=f"""
        SELECT candidate, dataset, id::VARCHAR AS id, error IS NOT NULL AS failed, {_r('class_score')} AS class_score, {_r('attribute_score')} AS attribute_score,
          {_r('association_score')} AS association_score, error, id % 8 = 0 AS metric_mismatch FROM scores""")
    out["read_joblist"] = """
        SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS candidate_id, o_orderstatus AS status, o_orderkey % 3 AS run_index,
          round(o_totalprice, 6) AS wall_seconds, NULL::VARCHAR AS llm FROM orders WHERE o_orderkey % 50 <> 0"""
    out["read_examples"] = """
        SELECT 'shots' AS strategy, c_custkey::VARCHAR AS id, c_name AS nlt, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) END AS model FROM customer"""
    out["write_run"] = sql("scores", select=f"""
        SELECT candidate, dataset, run_index::BIGINT AS run_index, id, {_r('class_score')} AS class_score, error FROM scores""")
    out["read_sidecar"] = sql("sentences", select="""
        SELECT d.source || '::' || d.doc_id AS key, d.source AS dataset, d.doc_id AS id, coalesce(s.t, '') AS sentences, length(d.text) AS n
        FROM documents d LEFT JOIN (SELECT id, string_agg(sentence, '|' ORDER BY sent_i) AS t FROM sentences WHERE sent_i < 3 GROUP BY id) s ON s.id = d.doc_id""")
    out["read_table_csv"] = f"SELECT doc_id, source, text, {_r('n_chars / 7')} AS share FROM documents"
    out["generate_with_settings"] = rf"""
        SELECT source AS dataset, doc_id AS id, array_to_string(regexp_extract_all(text, '[^\p{{Z}}\t-\r\x{{1C}}-\x{{1F}}\x{{85}}]+')[1:3], ' ') || '?' AS generated,
          false AS failed, NULL::VARCHAR AS error, text AS raw_excerpt FROM documents"""
    out["score_with_metric"] = """
        SELECT dataset, id, CASE WHEN blank THEN 0.0 WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS class_score,
          CASE WHEN blank THEN 0.0 ELSE round(least(a, b) / greatest(a, b), 6) END::DOUBLE AS attribute_score,
          CASE WHEN blank THEN 0.0 ELSE 0.5 END::DOUBLE AS association_score, CASE WHEN blank THEN 'empty_generated_model' END AS error
        FROM (SELECT c_mktsegment AS dataset, c_custkey AS id, c_custkey % 5 = 0 AS blank, length(c_mktsegment) + 24 AS a, length(c_custkey::VARCHAR) + 25 AS b FROM customer)"""
    out["explode_settings_filtered"] = """
        SELECT c_name AS model, '1shot' AS setting, upper(c_name) AS text, false AS is_reference FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_name, 'reference', c_mktsegment, true FROM customer"""
    out["run_identity"] = """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') AS run_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp_utc,
          'element_f1' AS name, '1' AS version FROM orders"""
    out["limit_per_dataset"] = """
        SELECT source AS dataset, doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3"""
    out["explode_settings"] = """
        SELECT c_custkey AS model, 'reference' AS setting, c_mktsegment AS text, true AS is_reference FROM customer
        UNION ALL SELECT c_custkey, '0shot', lower(c_name), false FROM customer UNION ALL SELECT c_custkey, '1shot', c_name, false FROM customer WHERE c_custkey % 2 = 0"""

    # reports
    out["kind_counts"] = sql("link", select="""
        SELECT dataset, count_if(st = 'O')::BIGINT AS association, 0::BIGINT AS directed, 0::BIGINT AS inheritance, count_if(st = 'F')::BIGINT AS composition,
          count_if(st = 'P')::BIGINT AS aggregation, 0::BIGINT AS dependency, 0::BIGINT AS association_class FROM link GROUP BY ROLLUP (dataset)""")
    out["diagram_overview"] = sql("cust", select=f"""
        SELECT dataset, count(*) AS n_records, {_r('avg(nc + 1)')} AS classes_mean, {_r('median(nc + 1)')} AS classes_median, min(nc + 1) AS classes_min,
          max(nc + 1) AS classes_max, {_r('avg(n)')} AS attributes_mean, 1.0::DOUBLE AS enums_mean, {_r('avg(nl)')} AS relationships_mean,
          {_r('median(nl)')} AS relationships_median, 100.0::DOUBLE AS rels_with_card_pct FROM cust GROUP BY dataset""")
    out["cardinality_patterns"] = sql("rel", select="""
        SELECT dataset, source_card AS src_card, target_card AS tgt_card, count(*) AS n FROM rel GROUP BY ALL
        UNION ALL SELECT 'total', source_card, target_card, count(*) FROM rel GROUP BY ALL""")
    out["attribute_type_counts"] = sql("ord", select="""
        SELECT 'Double' AS type, count(*) AS n FROM ord UNION ALL SELECT '(untyped)', count(*) FROM ord""")
    out["coverage_by_dataset"] = sql("coverage", select=f"""
        , l AS (SELECT dataset, kind || '_l1' AS measure, pct_l1 AS x FROM coverage UNION ALL SELECT dataset, kind || '_absent', pct_absent FROM coverage)
        SELECT dataset, measure, {_r('avg(x)')} AS mean, {_r('median(x)')}::DOUBLE AS median FROM l GROUP BY ALL""")
    out["binding_by_dataset"] = sql("bindings", select="SELECT dataset, " + ", ".join(
        f"{_r(f'avg({c})')} AS {c}" for c in ("pct_attrs_bound", "pct_rels_bound", "avg_hop_class_attr", "avg_hop_rel")) + " FROM bindings GROUP BY dataset")
    out["kind_coverage_by_dataset"] = sql("kind_cov", select=f"""
        SELECT dataset, rel_kind, sum(n)::BIGINT AS n, sum(n_bound)::BIGINT AS n_bound, {_r('100.0 * sum(n_bound) / greatest(sum(n), 1)')}::DOUBLE AS pct_bound
        FROM kind_cov GROUP BY ALL""")
    out["style_by_dataset"] = sql("style", select="SELECT dataset, " + ", ".join(f"{_r(f'avg({c})')} AS {c}" for c in (
        "passive_ratio", "hedge_density", "modal_density", "entity_density", "modal_count", "hedge_count", "named_entities")) + " FROM style GROUP BY dataset")
    out["sentence_report"] = sql("sent_hits", select=f"""
        SELECT dataset, {_r('count(*) / count(DISTINCT id)')} AS sents_per_record_mean, {_r('avg(n_words)')} AS sentence_length_words_mean,
          {_r('median(n_words)')} AS sentence_length_words_median, {_r('100.0 * count_if(n_class_hits > 0) / count(*)')}::DOUBLE AS pct_sents_with_class_hit,
          {_r('100.0 * count_if(n_attr_hits > 0) / count(*)')}::DOUBLE AS pct_sents_with_attr_hit,
          {_r('100.0 * count_if(n_rel_endpoint_hits > 0) / count(*)')}::DOUBLE AS pct_sents_with_rel_endpoint_hit FROM sent_hits GROUP BY dataset""")
    out["warning_totals"] = sql("link", select="SELECT dataset, count(*) AS n FROM link WHERE st = 'P' GROUP BY ROLLUP (dataset)")
    out["warning_samples"] = sql("loose_lines", select="""
        SELECT dataset, id, 'Line ' || line_no || ': Skipped ' || chr(39) || t || chr(39) AS warning FROM loose_lines WHERE what = 'unknown' ORDER BY dataset, id, line_no LIMIT 5""")
    out["warning_top_records"] = sql("link", select="SELECT id, count(*) AS n FROM link WHERE st = 'P' GROUP BY id ORDER BY n DESC, id LIMIT 10")
    out["jaccard_report"] = sql("cross_jaccard", select=f"""
        , l AS (SELECT unnest(['jaccard_classes', 'jaccard_attributes', 'jaccard_rels']) AS measure, unnest([jaccard_classes, jaccard_attributes, jaccard_rels]) AS x FROM cross_jaccard)
        SELECT measure, count(*) AS n, {_r('avg(x)')} AS mean, {_r('min(x)')} AS min, {_r('max(x)')} AS max, {_r('median(x)')} AS median,
          count_if(x = 1)::BIGINT AS n_perfect FROM l GROUP BY measure""")
    out["imperfect_records"] = sql("cross_jaccard", select="SELECT id, only_in_first_classes, only_in_second_classes FROM cross_jaccard WHERE jaccard_classes < 1")
    out["lowest_records"] = sql("cross_jaccard", "ord", select=side_sizes + f"""
        SELECT j.id, {_r('jaccard_rels')} AS jaccard_rels, na.r AS first_n_rels, nb.r AS second_n_rels FROM cross_jaccard j JOIN na ON na.id = j.id
        JOIN nb ON nb.id = j.id ORDER BY j.jaccard_rels, j.id LIMIT 5""")
    ends = f"dataset, id, {_r('pct_rels_bound')}::DOUBLE AS pct_rels_bound, {_r('pct_attrs_bound')}::DOUBLE AS pct_attrs_bound"
    out["extreme_records"] = sql("bindings", select=f"""
        (SELECT {ends}, 'highest' AS end FROM bindings ORDER BY bindings.pct_rels_bound DESC, dataset, id LIMIT 5)
        UNION ALL (SELECT {ends}, 'lowest' FROM bindings ORDER BY bindings.pct_rels_bound, dataset DESC, id DESC LIMIT 5)""")
    columns = ("n_chars", "n_words", "n_sentences", "n_unique_words_lower", "avg_word_length", "quality")
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM f" for a in columns for b in columns)
    out["spearman_matrix"] = sql("features", select=f"""
        , f AS (SELECT features.*, l.quality FROM features LEFT JOIN labels l ON l.doc_id = features.id),
        p AS (SELECT * FROM ({pairs}) WHERE x IS NOT NULL AND y IS NOT NULL),
        r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p)
        SELECT a, b, count(*) AS n, {_r('corr(rx, ry)')} AS rho FROM r GROUP BY ALL""")
    out["histogram_percent"] = sql("coverage", select="""
        SELECT dataset, least(floor(pct_l1 / 10), 9)::BIGINT AS bin, count(*) AS n FROM coverage WHERE kind = 'attribute' GROUP BY ALL""")
    out["histogram_equal"] = f"""
        WITH v AS (SELECT o_orderpriority AS dataset, floor(o_totalprice) AS v FROM orders), s AS (SELECT dataset, min(v) AS lo, max(v) AS hi FROM v GROUP BY dataset),
        b AS (SELECT dataset, lo, hi, least(floor((v - lo) / ((hi - lo) / 16)), 15) AS bin FROM v JOIN s USING (dataset))
        SELECT dataset, bin::BIGINT AS bin, {_r('lo + bin * ((hi - lo) / 16)')} AS low, count(*) AS n FROM b GROUP BY dataset, bin, lo, hi"""
    out["box_stats"] = f"""
        WITH l AS (SELECT l_returnflag AS dataset, unnest(['l_extendedprice', 'l_quantity']) AS measure, unnest([l_extendedprice, l_quantity])::DOUBLE AS x FROM lineitem)
        SELECT dataset, measure, count(*) AS n, {_r('avg(x)')} AS mean, {_r('stddev_samp(x)')} AS std, {_r('min(x)')} AS min, {_r('quantile_cont(x, 0.25)')} AS q1,
          {_r('median(x)')} AS median, {_r('quantile_cont(x, 0.75)')} AS q3, {_r('max(x)')} AS max FROM l GROUP BY ALL"""
    tok = ("n_tokens", "n_sents", "n_nsubj", "n_nsubjpass", "n_dobj", "n_verbs", "n_nouns", "n_adjectives", "n_noun_chunks", "n_entities", "entity_types",
           "passive_ratio", "mean_children", "n_unique_lemmas")
    sty = ("passive_nsubjpass", "active_nsubj", "modal_count", "hedge_count", "named_entities", "passive_ratio", "hedge_density", "modal_density", "entity_density")
    cov = ", ".join(f"max({c}) FILTER (kind = '{k}') AS cov_{n}_{c.removeprefix('pct_')}" for k, n in (
        ("class", "classes"), ("attribute", "attrs"), ("enum_value", "enum"), ("rel_source", "rel_src"), ("rel_target", "rel_tgt"))
        for c in ("n", "pct_l1", "pct_l2", "pct_l3", "pct_l4", "pct_absent"))
    out["wide_record_table"] = sql("elements", select=f"""
        , el AS (SELECT id, count_if(kind = 'class')::BIGINT AS n_classes, count_if(kind = 'attribute')::BIGINT AS n_attributes FROM elements GROUP BY id),
        cv AS (SELECT id, {cov} FROM ({out['coverage_summary']}) GROUP BY id)
        SELECT f.*, {", ".join(f"t.{c} AS tok_{c}" for c in tok)}, {", ".join(f"s.{c} AS style_{c}" for c in sty)}, el.n_classes, el.n_attributes,
          cv.* EXCLUDE (id), b.* EXCLUDE (dataset, id), 0::BIGINT AS n_parser_warnings
        FROM ({out['text_features']}) f LEFT JOIN ({out['token_features']}) t ON t.id = f.id LEFT JOIN ({out['style_features']}) s ON s.id = f.id
        LEFT JOIN el ON el.id = f.id LEFT JOIN cv ON cv.id = f.id LEFT JOIN ({out['binding_summary']}) b ON b.id = f.id""")
    nine = ("n_words", "n_sentences", "n_classes", "n_attributes", "n_relationships", "cov_classes_absent", "cov_attrs_absent", "pct_attrs_bound", "pct_rels_bound")
    cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM w" for a in nine for b in nine)
    out["spearman_report"] = f"""
        WITH w AS MATERIALIZED (SELECT {', '.join(f"round({'n_rels_total' if c == 'n_relationships' else c}, 4) AS {c}" for c in nine)} FROM ({out['wide_record_table']})),
        p AS (SELECT * FROM ({cells}) WHERE x IS NOT NULL AND y IS NOT NULL),
        r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p)
        SELECT a, b, count(*) AS n, {_r('corr(rx, ry)')} AS rho FROM r GROUP BY ALL"""
    detail = "'{\"sent_i\":' || sent_i || ',\"hop\":' || hop || ',\"path_text\":\"' || array_to_string(texts, ' ') || '\"}'"
    marks = " || ',' || ".join(f"'\"{f}\":' || {f}::VARCHAR" for f in ("l1", "l2", "l3", "l4", "absent"))
    out["case_study_rows"] = sql("matched", "rels", "attr_bound", "rel_bound", select=f"""
        , rows AS (
          SELECT source AS dataset, doc_id AS id, 'text' AS section, NULL AS name, CASE WHEN length(text) > 1200 THEN left(text, 1200) ELSE text END AS detail, 1 AS w FROM documents
          UNION ALL SELECT dataset, id, 'class', name, '{{' || {marks} || '}}', 1 FROM matched WHERE kind = 'class'
          UNION ALL SELECT dataset, id, 'relationship', source || ' -> ' || target, kind, 1 FROM rels
          UNION ALL SELECT dataset, id, 'absent_class', name, NULL, 1 FROM matched WHERE kind = 'class' AND absent
          UNION ALL SELECT dataset, id, 'absent_attribute', owner || '.' || name, NULL, 1 FROM matched WHERE kind = 'attribute' AND absent
          UNION ALL SELECT dataset, id, 'attribute_binding', class || '.' || attribute, {detail}, row_number() OVER (PARTITION BY id ORDER BY class, attribute) FROM attr_bound
          UNION ALL SELECT dataset, id, 'relationship_binding', source || ' -> ' || target, {detail}, 1 FROM rel_bound)
        SELECT dataset, id, section, name, detail FROM rows WHERE id IN (SELECT doc_id FROM labels) AND w <= 8""")
    def as_json(statement: str, *columns: tuple[str, bool]) -> str:
        """Rows of a statement as JSON text; a null field is left out. Columns come as (name, is it text)."""
        fields = [f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || " + (f"'\"' || {c} || '\"'" if text else f"{c}::VARCHAR") + " END" for c, text in columns]
        return f"SELECT '{{' || concat_ws(',', {', '.join(fields)}) || '}}' AS row FROM ({statement})"

    kinds_of = [(k, False) for k in ("association", "directed", "inheritance", "composition", "aggregation", "dependency", "association_class")]
    out["summary_document"] = " UNION ALL ".join(
        f"SELECT '{name}' AS section, row FROM ({text})" for name, text in (
            ("metadata", """SELECT '{"corpus":"orders","version":"1"}' AS row"""),
            ("relationship_type_counts", as_json(out["kind_counts"], ("dataset", True), *kinds_of)),
            ("cardinality_patterns", as_json(out["cardinality_patterns"], ("dataset", True), ("src_card", True), ("tgt_card", True), ("n", False))),
            ("attribute_type_counts", as_json("SELECT 'Double' AS type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey", ("type", True), ("n", False))),
            ("warning_totals", as_json(out["warning_totals"], ("dataset", True), ("n", False))),
            ("failure_rate", as_json(out["failure_rate"], ("dataset", True), ("candidate", True), ("n", False), ("n_errors", False))),
            ("status_counts", as_json(out["status_counts"], ("status", True), ("n", False))),
        ))
    return out
