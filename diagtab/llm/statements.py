"""SQL of the registered queries, for those that SQL can express."""

from __future__ import annotations

from diagtab.llm.chatformat import BODY, CONTROLS, END, TURN
from diagtab.llm.decontam import NUMBER_WORDS, UNITS

#: Targets: sources in order of size per weight; a source is bound if its share of what is left is at least 3 times its
#: size. The mix: documents placed by size and digest, copies from whole numbers crossed.
OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (
  SELECT source, n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) AS place FROM t),
x AS (SELECT source, n, place, [1, 2, 3][(place % 3 + 1)::INT] AS w FROM w),
o AS (
  SELECT *,
    (sum(n) OVER ()) - 3 * coalesce(sum(n) OVER (ORDER BY n::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(w) OVER (ORDER BY n::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    row_number() OVER (ORDER BY n::DOUBLE / w, place) AS pos
  FROM x),
b AS (SELECT *, 3 * n::DOUBLE * weights::DOUBLE <= left_over::DOUBLE * w AS bound FROM o),
p AS (SELECT left_over AS pool, weights AS pool_weights FROM b WHERE NOT bound ORDER BY pos LIMIT 1),
g AS (
  SELECT source, n AS source_size,
    CASE WHEN bound THEN (3 * n)::DOUBLE ELSE pool::DOUBLE * w / pool_weights::DOUBLE END AS target,
    ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 5))::BIGINT::DOUBLE / 1048576 AS u
  FROM b LEFT JOIN p ON true),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM d)
SELECT r.doc_id, r.size, g.source_size, g.target,
  ((floor((k + 1) * coalesce(target / nullif(source_size, 0), 0.0) + u)
    - floor(k * coalesce(target / nullif(source_size, 0), 0.0) + u)) * r.size)::BIGINT AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
"""

#: A line (without white space at its ends) on 10 sites or more stays only where it stands first.
OP8 = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
s AS (
  SELECT bare, min(row(doc_id, pos)) AS head FROM k WHERE bare <> ''
  GROUP BY bare HAVING count(DISTINCT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END) >= 10),
m AS (SELECT k.*, s.bare IS NOT NULL AND row(k.doc_id, k.pos) <> s.head AS gone FROM k LEFT JOIN s USING (bare)),
a AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256, text FROM a
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""

#: Words covered by a window of 50 words that also starts in a document with a smaller id go.
OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first_id FROM x GROUP BY h),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT x.doc_id, x.i FROM x JOIN f USING (h) WHERE x.doc_id > f.first_id)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, p) GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: Windows of five as templates and in lower case give alignments; all words along each, with consistent placeholders, at
#: least 0.8 of an item's words. Items of three and four words as a whole.
_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_NUMBERS = ", ".join(f"'{n}'" for n in NUMBER_WORDS)
_TOKEN = r"\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+"
_FIVE = " || ' ' || ".join(["{0}", *(f"lead({{0}}, {k}) OVER o" for k in range(1, 5))])
OP3 = rf"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_TOKEN}'), 1) AS p
  FROM documents),
it AS (
  SELECT item_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_TOKEN}'), 1) AS p
  FROM benchmark),
tw AS (
  SELECT raw, lower(raw) AS low, CASE WHEN lower(raw) <> raw THEN '<name>'
    WHEN regexp_matches(raw, '^\p{{N}}') OR raw IN ({_NUMBERS}) THEN '<num>' WHEN raw IN ({_UNITS}) THEN '<unit>' ELSE raw END AS t
  FROM (SELECT DISTINCT raw FROM (SELECT raw FROM dt UNION ALL SELECT raw FROM it))),
d AS MATERIALIZED (SELECT doc_id, p, dt.raw, t, low FROM dt JOIN tw ON dt.raw = tw.raw),
i AS MATERIALIZED (SELECT item_id, p, it.raw, t, low, count(*) OVER (PARTITION BY item_id) AS n FROM it JOIN tw ON it.raw = tw.raw),
dw AS (
  SELECT doc_id, p, {_FIVE.format("t")} AS g, {_FIVE.format("low")} AS h FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
ia AS (
  SELECT item_id, p, {_FIVE.format("t")} AS g, {_FIVE.format("low")} AS h,
    sum((t = raw)::INT) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS plain
  FROM i WINDOW o AS (PARTITION BY item_id ORDER BY p)),
iw AS (
  SELECT * FROM (SELECT *, max(plain) OVER (PARTITION BY item_id) AS best FROM ia WHERE g IS NOT NULL)),
x AS (
  SELECT dw.doc_id, iw.item_id, dw.p - iw.p AS shift FROM dw JOIN iw USING (g) WHERE iw.plain >= least(iw.best, 2)
  UNION SELECT dw.doc_id, iw.item_id, dw.p - iw.p FROM dw JOIN iw USING (h)),
a AS (
  SELECT x.doc_id, x.item_id, x.shift, i.p, i.low AS mine, d.low AS theirs, i.low = d.low OR i.t = d.t AS same, i.t <> i.raw AS slot
  FROM x JOIN i USING (item_id) JOIN d ON d.doc_id = x.doc_id AND d.p = i.p + x.shift),
e AS (
  SELECT *, sum(same::INT) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 5 AS begins FROM a),
v AS (
  SELECT * FROM (SELECT *, max(begins::INT) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM e)
  WHERE covered = 1),
b AS (SELECT *, false AS together FROM v UNION ALL SELECT doc_id, item_id, 0, p, mine, theirs, same, slot, begins, covered, true FROM v),
pr AS (SELECT DISTINCT doc_id, item_id, shift, together, mine, theirs FROM b WHERE slot),
st AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift, together, mine) = 1
    AND count(*) OVER (PARTITION BY doc_id, item_id, shift, together, theirs) = 1 AS steady FROM pr),
c AS (
  SELECT b.doc_id, b.item_id, b.shift, b.together, count(DISTINCT b.p) AS n_found
  FROM b LEFT JOIN st USING (doc_id, item_id, shift, together, mine, theirs) WHERE NOT b.slot OR st.steady
  GROUP BY ALL),
m AS (SELECT doc_id, item_id, max(n_found) AS n_found FROM c GROUP BY ALL),
z AS (SELECT item_id, any_value(n) AS n FROM i GROUP BY item_id),
sh AS (SELECT item_id, n, string_agg(low, ' ' ORDER BY p) AS w FROM i WHERE n BETWEEN 3 AND 4 GROUP BY ALL),
sd AS (
  SELECT doc_id, p, low || ' ' || lead(low, 1) OVER o || ' ' || lead(low, 2) OVER o AS w3,
    low || ' ' || lead(low, 1) OVER o || ' ' || lead(low, 2) OVER o || ' ' || lead(low, 3) OVER o AS w4
  FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id, item_id, n FROM sd JOIN sh ON (n = 3 AND w3 = w) OR (n = 4 AND w4 = w))
SELECT doc_id, item_id, n::BIGINT AS n_words, n_found::BIGINT AS n_found, n_found::DOUBLE / n AS coverage
FROM m JOIN z USING (item_id) WHERE n_found::DOUBLE / n >= 0.8
UNION ALL SELECT doc_id, item_id, n::BIGINT, n::BIGINT, 1.0::DOUBLE FROM s
"""

#: All pairs; components by the smallest id that is reached.
OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Digests of what was told; lengths of the formatted turns from the number of control strings and backslashes in them.
_CONTROLS = " + ".join(
    f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in CONTROLS)
OP9 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, (SELECT length(x) + length(x) - length(replace(x, chr(92), '')) + {_CONTROLS} FROM (SELECT role || text AS x)) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + {len(TURN + BODY + END)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Stretches of 1 to 5 words by list slices; wide whole numbers for the score.
OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
x AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN n ON n.lang = c.lang),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT DISTINCT lang, a, array_to_string(w[b:e], ' ') AS phrase
  FROM (SELECT lang, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS b FROM f WHERE m >= 3),
    (SELECT unnest([2, 3, 4, 5]) AS e) WHERE b < e AND e <= m AND e - b + 1 < m),
z AS (SELECT * FROM y ANTI JOIN i ON i.lang = y.lang AND i.phrase = y.phrase AND 100 * i.a >= 100 * y.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z)
SELECT * FROM r WHERE rank <= 2000
"""

#: All queries against all rows, as whole numbers.
OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def statements() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1,
        "op3_benchmark_decontamination": OP3,
        "op5_source_mix": OP5,
        "op7_embedding_dedup": OP7,
        "op8_line_dedup": OP8,
        "op9_chat_format": OP9,
        "op11_collocations": OP11,
        "op13_exact_top_k": OP13,
    }
