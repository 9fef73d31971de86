"""DuckDB statements with the results of the corpus queries that SQL can express.

Left out: models (op3, op4, op7), iterated scores and draws (op6, op8), shards,
whose order rests on a hash that DuckDB does not have (op10), and token ids (op12).
"""

from __future__ import annotations

from slate.llm.quality_rules import BITS, LEAST_DOCS, SPREAD, STEPS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                          ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, s.n
"""

_STEP = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in STEPS.items()) + " END"
OP2 = rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN repeats r ON r.doc_id = t.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'word_length']) AS measure,
         unnest([n_symbols * 1000 // nullif(n_words, 0), n_dup_lines * 1000 // nullif(n_lines, 0), word_chars * 100 // nullif(n_words, 0)]) AS value FROM b),
bins AS (
  SELECT lang, source, measure, (value >> s) << s AS bin, count(*) AS n
  FROM (SELECT *, greatest(length(bin(value)) - {BITS}, 0) AS s FROM v WHERE NOT base_failed) GROUP BY ALL),
levels AS (
  SELECT 1 AS level, lang, source, measure, bin, n FROM bins
  UNION ALL SELECT 2, lang, NULL, measure, bin, sum(n) FROM bins GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, bin, sum(n) FROM bins GROUP BY ALL),
running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS seen,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS docs FROM levels),
q AS (
  SELECT level, lang, source, measure, any_value(docs) AS docs, min(bin) FILTER (seen * 4 >= docs) AS q1,
         min(bin) FILTER (seen * 4 >= docs * 3) AS q3 FROM running GROUP BY level, lang, source, measure),
cut AS (
  SELECT lang, source, measure, q3 + {SPREAD} * (q3 - q1) + {_STEP} AS lim FROM (
    SELECT o.lang, o.source, o.measure,
           CASE WHEN o.docs >= {LEAST_DOCS} THEN o.q1 WHEN l.docs >= {LEAST_DOCS} THEN l.q1 ELSE c.q1 END AS q1,
           CASE WHEN o.docs >= {LEAST_DOCS} THEN o.q3 WHEN l.docs >= {LEAST_DOCS} THEN l.q3 ELSE c.q3 END AS q3
    FROM q o JOIN q l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
             JOIN q c ON c.level = 3 AND c.measure = o.measure WHERE o.level = 1)),
over AS (
  SELECT v.doc_id, bool_or(value > lim) AS bad FROM v JOIN cut ON cut.measure = v.measure
  AND cut.lang IS NOT DISTINCT FROM v.lang AND cut.source IS NOT DISTINCT FROM v.source GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM b LEFT JOIN over ON over.doc_id = b.doc_id
"""

OP5 = rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM grams) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM twice, range(0, 35) r(j)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM t),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS s
  FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON iw.g = dw.g AND iw.n = dw.n),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, range(0, 10) r(j) WHERE j < hits.n GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

OP11 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, len(parts) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
             list_transform(range(1, n + 1), lambda i: parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END) AS lines,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(lines[1:low], ''), '') AS prefix, coalesce(array_to_string(lines[low + 1:high], ''), '') AS middle,
             coalesce(array_to_string(lines[high + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP13 = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": OP1,
    "op2_quality_rules": OP2,
    "op5_substring_dedup": OP5,
    "op9_decontamination": OP9,
    "op11_fill_middle": OP11,
    "op13_hard_negatives": OP13,
}
