"""SQL twins (DuckDB) of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT = f"""WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)"""

#: Every word position of every document against every position of every item.
LEAKS = f"""WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS grams
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS grams
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS MATERIALIZED (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, grams)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS listed FROM found GROUP BY doc_id),
starts AS (
  SELECT item_id, w, j, least(10, len(w)) AS n, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS grams
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(j) WHERE len(w) > 0),
pairs AS (
  SELECT p.doc_id, p.i, s.item_id::VARCHAR AS item, s.j, d.w AS x, s.w AS y, least(len(d.w) - p.i, len(s.w) - s.j) + 1 AS most
  FROM places p JOIN starts s USING (n, grams) JOIN d USING (doc_id)),
common AS (
  SELECT doc_id, i, item,
    coalesce(list_position(list_transform(range(0, most), lambda k: x[i + k] = y[j + k]), false) - 1, most) AS words FROM pairs),
best AS (
  SELECT doc_id, words, item, i FROM common
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item, i) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(words, 0)::BIGINT AS longest, item AS longest_item, (i - 1)::BIGINT AS longest_at
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""

# The patterns of the secret scan, as RE2 reads them.
SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]{24,}", 24),
    ("long", "[A-Za-z0-9+/_-]{20,}", 20),
)


def _secrets():
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    kinds = " UNION ALL ".join(
        f"""SELECT n, doc_id, source, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, {quoted(pattern)}) AS hits,
          string_split_regex(text, {quoted(pattern)}) AS gaps FROM d WHERE regexp_matches(text, {quoted(pattern)})"""
        for kind, pattern, least in SECRETS
    )
    return f"""WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS MATERIALIZED ({kinds}),
s AS (
  SELECT n, doc_id, source, kind, least, hits[i] AS hit,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a
  FROM m, unnest(range(1, len(hits) + 1)) AS r(i)),
v AS MATERIALIZED (
  SELECT *, a + length(hit) AS z,
    CASE WHEN kind = 'assign' THEN regexp_extract(hit, {quoted(SECRETS[0][1])}, 2) ELSE hit END AS val FROM s),
k AS MATERIALIZED (
  SELECT * FROM v WHERE length(val) >= least AND (kind <> 'long' OR (regexp_matches(val, '[0-9]')
    AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(regexp_extract_all(val, '.'))) >= 10))),
f AS (
  SELECT val, count(DISTINCT coalesce(source, chr(1))) > 1 OR count(DISTINCT doc_id) > 8 AS copied,
    bool_or(regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
      AND len(list_distinct(regexp_extract_all(val, '.'))) >= 10) AS random
  FROM k GROUP BY val),
j AS (
  SELECT n, a::BIGINT AS a, z::BIGINT AS z,
    CASE WHEN copied THEN 'copied' WHEN random THEN 'owned' ELSE 'unclear' END AS verdict,
    CASE WHEN kind <> 'long' THEN kind WHEN copied THEN 'copied' WHEN random THEN 'owned' ELSE 'unclear' END AS kind
  FROM k JOIN f USING (val)),
o AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'owned', 'copied'], kind) AS rank,
    kind || ':' || a::VARCHAR || ':' || z::VARCHAR AS one FROM j WHERE kind <> 'unclear'),
g AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(one, ',' ORDER BY a, rank) FILTER (rank <= 3) AS base,
    string_agg(one, ',' ORDER BY a, rank) AS spans,
    string_agg(one || ':' || verdict, ',' ORDER BY a, rank) FILTER (rank <= 3) AS verdicts,
    count(*) FILTER (rank <= 3 AND verdict = 'copied') AS n_copied,
    count(*) FILTER (rank <= 3 AND verdict = 'owned') AS n_owned FROM o GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS base_verdicts,
  coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned
FROM d LEFT JOIN g USING (n)"""


#: Every term of every document; impacts and weights as the contract states them.
SEARCH = f"""WITH d AS (
  SELECT row_number() OVER () AS n_row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS n_item, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
tf AS (SELECT n_row, term, count(*)::BIGINT AS tf FROM (SELECT n_row, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
asked AS (SELECT n_item, item_id, term, count(*)::BIGINT AS c FROM (SELECT n_item, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
long AS (SELECT n_row, doc_id, 100 - 75 + ((75 * len(w)::BIGINT * N) // L) AS m FROM d, total),
scored AS (
  SELECT n_item, item_id, n_row, doc_id, sum(c * weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN long USING (n_row) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10"""

#: All pairs of a label, then everything that can be reached.
VECTORS = """WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_inner_product(v, v) > 0),
pairs AS MATERIALIZED (
  SELECT a.n AS a, b.n AS b FROM sound a JOIN sound b ON a.label = b.label AND a.n <> b.n AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT n AS a, n AS b FROM e UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN e ON e.n = reach.b GROUP BY a),
many AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN least ON least.a = n LEFT JOIN many ON many.a = n"""

#: All products of anchors with all rows; they are whole numbers far below 2**53.
NEGATIVES = """WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS MATERIALIZED (
  SELECT a.n AS n, a.vec_id AS anchor_id, b.n AS other, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.n <> b.n AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, other_id, other) <= 5),
r AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.n, p.other ORDER BY s.score DESC, s.other_id, s.other) AS rank
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10"""


#: Fingerprints need XXH64, which DuckDB lacks; no twin for op4.
def statements():
    return {
        "op2_exact_dedup": EXACT, "op7_decontamination": LEAKS, "op10_secret_scan": _secrets(),
        "op11_lexical_search": SEARCH, "op12_embedding_dedup": VECTORS, "op13_hard_negatives": NEGATIVES,
    }
