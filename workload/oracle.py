"""SQL twins of the registered queries, for DuckDB over the same tables."""

from reporank import fixed




def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _even(x):
    """Four decimals by the exact binary value, ties to even."""
    return f"(printf('%.4f', ({x})::DOUBLE)::DOUBLE + 0e0)"


def _lifted(x, digits):
    """A double halfway between two numbers of ``digits`` decimals moves to the larger."""
    return f"""CASE WHEN (({x}) * {2 ** (digits + 1)}) % 2 = 1
      THEN (floor(({x}) * {10 ** digits}) + 1) / {10.0 ** digits}e0 ELSE {x} END"""


def _with(*ctes):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# ---- stand-in repositories -------------------------------------------------

REPOS = """
o AS (
  SELECT o_custkey, count(*) AS forks, max(o_orderdate) AS last_commit,
         sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::BIGINT AS open_issues,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END) AS issue_close_rate
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o_custkey,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END) AS test_file_ratio,
         sum(round(l_discount * 100)::BIGINT)::DOUBLE / (100 * count(*))
           AS error_handling_density,
         count(DISTINCT l_partkey) AS public_api_count,
         sum(l_quantity)::BIGINT AS total_lines,
         count(DISTINCT l_suppkey) AS contributor_count
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
repos AS (
  SELECT c_custkey AS repo_id, c_nationkey AS job_id, c_name AS full_name,
         'https://repos.example/' || c_name AS url,
         CASE c_nationkey % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go'
              WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'Java' END AS language,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE lower(c_mktsegment) END AS description,
         greatest(floor(c_acctbal), 0)::BIGINT AS stars,
         coalesce(forks, 0) AS forks, coalesce(open_issues, 0) AS open_issues, last_commit,
         CASE WHEN c_custkey % 23 = 5 THEN NULL
              ELSE datediff('day', last_commit::DATE, DATE '2001-08-01') END AS commit_recency,
         test_file_ratio, error_handling_density, public_api_count, total_lines,
         CASE WHEN c_custkey % 23 = 6 THEN NULL ELSE contributor_count END AS contributor_count,
         issue_close_rate
  FROM customer
  LEFT JOIN o ON c_custkey = o.o_custkey
  LEFT JOIN l ON c_custkey = l.o_custkey)"""

FEATURES = fixed.FEATURES


def _scaled(batch, name="scaled", by=None):
    """Min-max normalized features of a table of repositories."""
    over = f"PARTITION BY {by}" if by else ""
    parts = []
    for f in FEATURES:
        lo = f"min(coalesce({f}, 0)) OVER ({over})"
        hi = f"max(coalesce({f}, 0)) OVER ({over})"
        width = f"CASE WHEN {hi} = {lo} THEN 1.0e0 ELSE ({hi} - {lo})::DOUBLE END"
        ratio = f"(coalesce({f}, 0) - {lo})::DOUBLE / ({width})"
        parts.append(f"{_even(ratio)} AS {f}_norm")
    return f"{name} AS (SELECT *, " + ",\n  ".join(parts) + f"\n  FROM {batch})"


QUALITY = _even("""0.4e0 * coalesce(test_file_ratio, 0)
  + 0.35e0 * least(coalesce(error_handling_density, 0) / 0.1e0, 1e0)
  + 0.25e0 * coalesce(public_api_count_norm, 0)""")
RECENCY = """CASE WHEN coalesce(commit_recency, 365) <= 0 THEN 1e0
  ELSE greatest(0e0, 1e0 - coalesce(commit_recency, 365) / 365e0) END"""
PEOPLE = "least(ln(1e0 + coalesce(contributor_count, 0)) / ln(51e0), 1e0)"
HEALTH = _even(f"""0.4e0 * ({RECENCY}) + 0.35e0 * ({PEOPLE})
  + 0.25e0 * coalesce(issue_close_rate, 0)""")
QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
RELEVANCE = _even(f"list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR})")


def _scored(batch="scaled", relevance=RELEVANCE):
    """All scores of every repository in a scaled batch."""
    return f"""
parts AS (
  SELECT r.*, coalesce({relevance}, 0e0) AS relevance_score,
         {QUALITY} AS quality_score, {HEALTH} AS health_score
  FROM {batch} r LEFT JOIN embeddings
    ON vec_id = repo_id % (SELECT count(*) FROM embeddings)),
scored AS (
  SELECT *, {_even('0.5e0 * relevance_score + 0.3e0 * quality_score + 0.2e0 * health_score')}
    AS composite_score
  FROM parts)"""


SCORES = "relevance_score, quality_score, health_score, composite_score"
BEST = "ORDER BY composite_score DESC, full_name LIMIT 20"

LITE_QUALITY = """CASE WHEN contains(lower(coalesce(description, '')), 'test')
      THEN 0.3e0 ELSE 0e0 END
      + least(stars / 5000e0, 1e0) * 0.4e0 + least(forks / 1000e0, 1e0) * 0.3e0"""
LITE_HEALTH = """0.6e0 * greatest(0e0, 1e0
        - (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(last_commit)) / 86400000000e0 / 365e0)
      + 0.4e0 * CASE WHEN open_issues > 0 THEN 0.5e0 ELSE 0.3e0 END"""
LITE = f"""
raw_lite AS (
  SELECT *, 0.5e0 AS relevance_score, {LITE_QUALITY} AS q, {LITE_HEALTH} AS h FROM repos),
lite AS (
  SELECT *, {_even(_lifted('q', 4))} AS quality_score, {_even(_lifted('h', 4))} AS health_score
  FROM raw_lite)"""
LITE_COMPOSITE = """round(0.5e0 * relevance_score + 0.3e0 * quality_score
  + 0.2e0 * coalesce(health_score, 0e0), 6) AS composite"""

# ---- code lines ------------------------------------------------------------

CODE = r"""
named AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, p_size % 4 AS shape,
    replace(p_name, ' ', '') AS name, replace(p_name, ' ', '_') AS snake,
    upper(p_name[1]) || replace(p_name[2:], ' ', '') AS camel,
    CASE l_partkey % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'ts'
      WHEN 3 THEN 'java' WHEN 4 THEN 'js' ELSE 'md' END AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey),
code AS (
  SELECT l_suppkey AS repo, l_orderkey * 8 + l_linenumber AS line_no, '.' || kind AS ext,
    'src/' || CASE WHEN l_orderkey % 7 = 0 THEN 'test_' ELSE 'm_' END
      || (l_orderkey % 20)::VARCHAR || '.' || kind AS path,
    trim(CASE kind
      WHEN 'py' THEN CASE shape WHEN 0 THEN 'def ' || snake || '(x):'
        WHEN 1 THEN '  def _' || snake || ' (self):'
        WHEN 2 THEN 'except ValueError:' ELSE 'except:' END
      WHEN 'go' THEN CASE shape WHEN 0 THEN 'func ' || camel || '(a int) error {'
        WHEN 1 THEN 'func ' || name || '()'
        WHEN 2 THEN 'if err != nil {' ELSE 'func (r *T) ' || name || '()' END
      WHEN 'ts' THEN CASE shape WHEN 0 THEN 'const ' || name || ' = async (x) => 1'
        WHEN 1 THEN 'export function ' || name || '('
        WHEN 2 THEN '} catch (e) {' ELSE 'const ' || name || ' = x => 1' END
      WHEN 'java' THEN CASE shape WHEN 0 THEN 'public int ' || name || '('
        WHEN 1 THEN 'public static void main(String[] a)'
        WHEN 2 THEN '} catch (E e) {' ELSE 'private int x(' END
      ELSE 'plain text' END) AS line
  FROM named),
signed AS (
  SELECT *, nullif(CASE ext
    WHEN '.py' THEN regexp_extract(line, '^def\s+([a-zA-Z_]\w*)\s*\(', 1)
    WHEN '.go' THEN regexp_extract(line, '^func\s+(\w+)\s*\(', 1)
    WHEN '.js' THEN JS WHEN '.ts' THEN JS
    WHEN '.java' THEN regexp_extract(line, '(?:public|protected)\s+\w+\s+(\w+)\s*\(', 1)
    ELSE '' END, '') AS sig,
    coalesce(CASE ext WHEN '.go' THEN contains(line, 'if err != nil')
      WHEN '.py' THEN regexp_matches(line, 'except\s+')
      WHEN '.js' THEN regexp_matches(line, 'catch\s*\(')
      WHEN '.ts' THEN regexp_matches(line, 'catch\s*\(') END, false) AS is_error
  FROM code),
annotated AS (
  SELECT *, coalesce(CASE ext WHEN '.py' THEN NOT starts_with(sig, '_')
    WHEN '.go' THEN regexp_matches(sig, '^[A-Z]')
    ELSE sig IS NOT NULL END, false) AS is_public
  FROM signed)""".replace(
    "THEN JS",
    r"""THEN coalesce(
      nullif(regexp_extract(line, 'function\s+(\w+)', 1), ''),
      regexp_extract(line, 'const\s+(\w+)\s*=\s*(?:async\s*)?\(', 1))""",
)
FILES = """
files AS (
  SELECT repo, path, ext, count(line) AS lines,
    count(*) FILTER (is_error) AS error_lines, count(*) FILTER (is_public) AS public
  FROM annotated GROUP BY ALL)"""
LANGUAGE = """
languages AS (
  SELECT repo, CASE ext WHEN '.py' THEN 'Python' WHEN '.go' THEN 'Go' WHEN '.js' THEN 'JavaScript'
      WHEN '.ts' THEN 'JavaScript' WHEN '.java' THEN 'Java' END AS language, count(*) AS files
  FROM files GROUP BY ALL),
dominant AS (
  SELECT repo, coalesce(first(language ORDER BY files DESC, language)
    FILTER (language IS NOT NULL), '') AS language
  FROM languages GROUP BY repo)"""
FIRST_SIGNATURES = """
first_signatures AS (
  SELECT repo, sig, row_number() OVER (
      PARTITION BY repo ORDER BY string_split(path, '/'), line_no, sig) AS n
  FROM annotated WHERE sig IS NOT NULL QUALIFY n <= 50)"""
TOTALS = """
totals AS (
  SELECT repo, coalesce(sum(public) FILTER (ext <> '.md'), 0)::BIGINT AS public_api_count,
    count(*) FILTER (ext <> '.md') AS total_files,
    count(*) FILTER (ext <> '.md' AND contains(path, 'test')) AS test_files,
    coalesce(sum(lines) FILTER (ext <> '.md'), 0)::BIGINT AS total_lines,
    coalesce(sum(error_lines) FILTER (ext <> '.md'), 0)::BIGINT AS error_lines
  FROM files GROUP BY repo)"""

# ---- 32-bit murmur3 over tokens --------------------------------------------

MASK = "4294967295::UBIGINT"


def _mul(a, k):
    return f"((({a}) * {k}::UBIGINT) & {MASK})"


def _rot(x, bits):
    return f"(((({x}) << {bits}) | (({x}) >> {32 - bits})) & {MASK})"


def _little_endian(start, n):
    pairs = " || ".join(f"substr(hx, {start} + {2 * i}, 2)" for i in reversed(range(n)))
    return f"('0x' || {pairs})::UBIGINT"


SPACES = r"[ \t\n\r\f\v]+"


def _tokens(table, key, text):
    return f"""
tok AS (
  SELECT DISTINCT {key} AS k, t
  FROM (SELECT {key}, unnest(string_split_regex({text}, '{SPACES}')) AS t FROM {table})
  WHERE t <> '')"""


def _murmur(seeds):
    """Hash of every distinct token under every seed: table hashed(t, seed, h)."""
    step = f"({_rot('xor(h, k)', 13)} * 5 + 3864292196::UBIGINT) & {MASK}"
    return f"""
vocabulary AS (
  SELECT t, hex(encode(t)) AS hx, octet_length(encode(t)) AS n FROM (SELECT DISTINCT t FROM tok)),
block AS (
  SELECT t, n, list_transform(range(n // 4), lambda i: {_little_endian('(i * 8 + 1)', 4)}) AS ks,
    CASE n % 4 WHEN 0 THEN 0::UBIGINT WHEN 1 THEN {_little_endian('(n - 1) * 2 + 1', 1)}
      WHEN 2 THEN {_little_endian('(n - 2) * 2 + 1', 2)}
      ELSE {_little_endian('(n - 3) * 2 + 1', 3)} END AS tail
  FROM vocabulary),
block1 AS (
  SELECT t, n, list_transform(ks, lambda k: {_mul('k', 3432918353)}) AS ks,
    {_mul('tail', 3432918353)} AS tail FROM block),
block2 AS (
  SELECT t, n, list_transform(ks, lambda k: {_mul(_rot('k', 15), 461845907)}) AS ks,
    {_mul(_rot('tail', 15), 461845907)} AS tail FROM block1),
mixed AS (
  SELECT t, seed, xor(xor(list_reduce(ks, lambda h, k: {step}, seed::UBIGINT), tail),
    n::UBIGINT) AS h
  FROM block2, range({seeds}) s(seed)),
final1 AS (SELECT t, seed, {_mul('xor(h, h >> 16)', 2246822507)} AS h FROM mixed),
final2 AS (SELECT t, seed, {_mul('xor(h, h >> 13)', 3266489909)} AS h FROM final1),
hashed AS (SELECT t, seed, xor(h, h >> 16) AS h FROM final2)"""


MINIMA = """
minima AS (SELECT k, seed, min(h)::BIGINT AS m FROM tok JOIN hashed USING (t) GROUP BY k, seed),
prints AS (SELECT k, list(m ORDER BY seed) AS fp FROM minima GROUP BY k)"""

DOCUMENT_PRINTS = [_tokens("documents", "doc_id", "text"), _murmur(128), MINIMA]
BANDS = """
bands AS (
  SELECT k, b AS band, md5(array_to_string(fp[b * 8 + 1 : b * 8 + 8], ',')) AS bucket
  FROM prints, range(16) r(b))"""


#: Token sets, equal ones as one class, and all pairs of classes at 0.8 or more.
SETS = """
sets AS (SELECT k, list(t ORDER BY t) AS s FROM tok GROUP BY k),
classes AS (SELECT k, s, min(k) OVER (PARTITION BY s) AS class FROM sets),
one AS MATERIALIZED (SELECT k, s, len(s) AS n FROM classes WHERE k = class),
compared AS (
  SELECT a.k AS a, b.k AS b, a.n + b.n AS n, len(list_intersect(a.s, b.s)) AS common
  FROM one a JOIN one b ON a.k < b.k AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
alike AS (SELECT a, b, common / (n - common)::DOUBLE AS jaccard
  FROM compared WHERE 10 * common >= 8 * (n - common))"""


def _buckets(ranked, batch="0"):
    """Members of every bucket in keeping order; ``ranked`` is (id, k, stars)."""
    return f"""
members AS (
  SELECT r.id, band, bucket, row_number() OVER (
      PARTITION BY {batch}, band, bucket ORDER BY r.stars DESC, r.id) AS place,
    first_value(r.id) OVER (
      PARTITION BY {batch}, band, bucket ORDER BY r.stars DESC, r.id) AS keeper
  FROM ({ranked}) r JOIN bands USING (k))"""


DOCUMENTS_RANKED = "SELECT doc_id AS id, doc_id AS k, n_chars AS stars FROM documents"
REPOS_RANKED = """SELECT full_name AS id, repo_id % (SELECT count(*) FROM documents) AS k, stars,
    job_id FROM repos"""
ANY_BAND = "dropped AS (SELECT id FROM members GROUP BY id HAVING min(place) > 1)"


def _cluster(ranked):
    return f"""
links AS (
  SELECT DISTINCT id AS a, keeper AS b FROM members
  UNION SELECT DISTINCT keeper, id FROM members),
reach AS (
  SELECT DISTINCT id, id AS other FROM members
  UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
cluster AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
ordered AS (
  SELECT id, row_number() OVER (PARTITION BY label ORDER BY stars DESC, id) AS place
  FROM cluster JOIN ({ranked}) r USING (id)),
dropped AS (SELECT id FROM ordered WHERE place > 1)"""


# The number of links per pair: copies of one fingerprint hang on the best copy only.
LINKS = """
placed AS (
  SELECT d.doc_id, d.n_chars, first_value(doc_id) OVER (
      PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS best
  FROM documents d JOIN prints ON k = doc_id),
pairs AS (
  SELECT keeper, id AS duplicate, count(*) AS bands
  FROM members JOIN placed ON id = doc_id
  WHERE id = best AND id <> keeper GROUP BY ALL
  UNION ALL
  SELECT best, doc_id, 16 FROM placed WHERE doc_id <> best)"""

# ---- semantic reuse --------------------------------------------------------

INCOMING = """
stored AS (SELECT vec_id AS job_id, embedding::DOUBLE[] AS e FROM embeddings),
followed AS (
  SELECT job_id, e, (job_id + 1) % count(*) OVER () AS next FROM stored),
incoming AS MATERIALIZED (
  SELECT s.job_id AS query_id,
    list_transform(range(1, len(s.e) + 1), lambda i:
      s.e[i] + f.e[i] * ((s.job_id % 10) / 10e0)) AS e
  FROM followed s JOIN stored f ON f.job_id = s.next)"""


def _nearest(stored):
    return f"""
scores AS (
  SELECT query_id, job_id, list_cosine_similarity(i.e, s.e) AS similarity
  FROM incoming i, {stored} s),
hits AS (
  SELECT query_id, first(job_id ORDER BY round(similarity, 12) DESC, job_id::VARCHAR) AS job_id,
    round(max(similarity), 6) AS similarity
  FROM scores GROUP BY query_id HAVING round(max(similarity), 12) >= 0.92)"""


STATUS = """
status_events AS (
  SELECT user_id AS job_id, ts AS updated_at, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done'
      WHEN 'error' THEN 'failed' ELSE 'running' END AS status
  FROM events),
current AS (
  SELECT job_id, last(status ORDER BY updated_at, seq) AS status
  FROM status_events GROUP BY job_id)"""

# ---- presentation ----------------------------------------------------------

COLORS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_COLORS.items())


def _percent(c):
    return f"floor({c} * 100 + 0.5)::BIGINT::VARCHAR || '%'"


def _fixed(c, digits):
    return f"printf('%.{digits}f', {_lifted(f'{c} * 100', digits)}) || '%'"


def _present():
    return f"""
SELECT row_number() OVER (ORDER BY composite_score DESC, full_name) AS rank,
  full_name AS repo_full_name,
  coalesce(nullif(language, ''), 'Unknown') AS language_badge,
  CASE language {COLORS} ELSE '{fixed.DEFAULT_COLOR}' END AS language_color,
  format('{{:,}}', stars) AS stars_label,
  {_percent('composite_score')} AS composite,
  CASE WHEN composite_score >= 0.7 THEN 'high' WHEN composite_score >= 0.4 THEN 'mid'
    ELSE 'low' END AS score_class,
  coalesce(nullif(CASE WHEN length(description) > 160
    THEN rtrim(description[1:160]) || '…' ELSE description END, ''),
    'No description provided.') AS description,
  {_percent('relevance_score')} AS relevance, {_percent('quality_score')} AS quality,
  {_percent('health_score')} AS health,
  {_fixed('coalesce(test_file_ratio, 0)', 1)} AS test_coverage_ratio,
  {_fixed('coalesce(error_handling_density, 0)', 2)} AS error_handling_density,
  coalesce(public_api_count, 0)::VARCHAR AS public_api_functions,
  coalesce(contributor_count, 0)::VARCHAR AS contributors,
  coalesce(commit_recency, 0)::VARCHAR || ' days ago' AS last_commit,
  {_fixed('coalesce(issue_close_rate, 0)', 0)} AS issue_close_rate
FROM (SELECT * FROM scored ORDER BY composite_score DESC, full_name LIMIT 10)"""


# ---- text ------------------------------------------------------------------

STOP = _list(fixed.STOP_WORDS)
KEYWORDS = f"""array_to_string(list_filter(
    string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+'),
    lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))[1:5], '+')"""

STATS = """
stats AS (
  SELECT * FROM (
    SELECT o_custkey AS repo, count(DISTINCT l_suppkey) AS contributor_count,
      ((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(max(l_shipdate))) / 86400000000e0)
        AS days
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey)
  FULL JOIN (
    SELECT o_custkey AS repo, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS rate
    FROM orders GROUP BY o_custkey) USING (repo))"""


def statements() -> dict[str, str]:
    scored = _with(REPOS, _scaled("repos"), _scored())
    prints = _with(*DOCUMENT_PRINTS)
    bands = [*DOCUMENT_PRINTS, BANDS, _buckets(DOCUMENTS_RANKED)]
    code = _with(CODE, FILES)

    kept = "kept AS (SELECT * FROM repos WHERE full_name NOT IN (SELECT id FROM dropped))"

    def ranked(dropped):
        return (
            _with(
                REPOS, *DOCUMENT_PRINTS, BANDS, _buckets(REPOS_RANKED), dropped, kept,
                _scaled("kept"), _scored(),
            )
            + f"SELECT full_name, stars, {SCORES} FROM scored {BEST}"
        )

    jobs_ranked = (
        _with(
            REPOS, *DOCUMENT_PRINTS, BANDS, _buckets(REPOS_RANKED, "r.job_id"),
            _cluster(REPOS_RANKED), kept, _scaled("kept", by="job_id"),
            _scored(relevance=_even("""list_cosine_similarity(embedding::DOUBLE[],
              (SELECT q.embedding::DOUBLE[] FROM embeddings q WHERE q.vec_id = r.job_id))""")),
        )
        + f"""SELECT job_id, full_name, stars, {SCORES} FROM scored QUALIFY row_number() OVER (
            PARTITION BY job_id ORDER BY composite_score DESC, full_name) <= 20"""
    )

    answers = (
        _with(
            REPOS, *DOCUMENT_PRINTS, BANDS, _buckets(REPOS_RANKED, "r.job_id"),
            _cluster(REPOS_RANKED), kept, _scaled("kept", by="job_id"), INCOMING, _nearest("stored"),
            f"""base AS (
              SELECT s.*, {QUALITY} AS quality_score, {HEALTH} AS health_score, embedding::DOUBLE[] AS re
              FROM scaled s LEFT JOIN embeddings
                ON vec_id = repo_id % (SELECT count(*) FROM embeddings)),
            asked AS (
              SELECT i.query_id + 1000000 AS query_id, h.job_id IS NOT NULL AS cached,
                sha256(coalesce(h.job_id, i.query_id + 1000000)::VARCHAR) AS job,
                coalesce(s.e, i.e) AS qe, coalesce(h.job_id, i.query_id) % 25 AS nation
              FROM incoming i LEFT JOIN hits h ON h.query_id = i.query_id
              LEFT JOIN stored s ON s.job_id = h.job_id),
            related AS (
              SELECT a.query_id, a.job AS job_id, cached, full_name AS repo_full_name, stars,
                coalesce({_even("list_cosine_similarity(re, qe)")}, 0e0) AS relevance_score,
                quality_score, health_score
              FROM asked a JOIN base b ON b.job_id = a.nation)""",
        )
        + f"""SELECT *,
            {_even('0.5e0 * relevance_score + 0.3e0 * quality_score + 0.2e0 * health_score')}
              AS composite_score
          FROM related QUALIFY row_number() OVER (
            PARTITION BY query_id ORDER BY composite_score DESC, repo_full_name) <= 10"""
    )

    def deduped(dropped):
        return (
            _with(*bands, dropped)
            + "SELECT doc_id, doc_id IN (SELECT id FROM dropped) AS is_duplicate FROM documents"
        )

    norms = ", ".join(f"{f}_norm" for f in FEATURES)
    words = "bought"
    twins = _twins(scored, prints, bands, code, ranked, deduped, norms, words)
    twins |= {
        "dedup_batches_cluster": twins["dedup_cluster"],
        "dedup_batches_any_band": twins["dedup_any_band"],
        "semantic_cache_indexed": twins["semantic_cache"],
        "code_signatures_sql": twins["code_signatures"],
        "first_signatures_sql": twins["first_signatures"],
        "metrics_versions": twins["code_metrics"],
        "insert_keyed": twins["insert_if_absent"],
        "status_stream": twins["latest_status"].replace("SELECT * FROM current", "SELECT job_id, status FROM current"),
    }
    return {**twins, "analyzed_files": twins["code_metrics"], "rank_jobs": jobs_ranked, "search_answers": answers}


def _twins(scored, prints, bands, code, ranked, deduped, norms, words):
    return {
        "relevance_topk": f"""SELECT vec_id, coalesce({RELEVANCE}, 0e0) AS relevance_score
            FROM embeddings ORDER BY relevance_score DESC, vec_id LIMIT 20""",
        "cosine_pairs": """SELECT a.vec_id AS job_id, round(list_cosine_similarity(
              a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
            FROM embeddings a JOIN embeddings b
              ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
        "minmax": _with(REPOS, _scaled("repos")) + f"SELECT full_name, {norms} FROM scaled",
        "minmax_by_job": _with(REPOS, _scaled("repos", by="job_id"))
        + f"SELECT job_id, full_name, {norms} FROM scaled",
        "minmax_by_job_nulls": _with(
            REPOS,
            """nulled AS (SELECT * REPLACE (CASE WHEN repo_id % 7 <> 0 THEN job_id END AS job_id)
              FROM repos)""",
            _scaled("nulled", by="job_id"),
        )
        + f"SELECT job_id, full_name, {norms} FROM scaled",
        "minmax_text_values": _with(
            REPOS,
            """texts AS (SELECT full_name, CASE WHEN repo_id % 5 = 0 THEN NULL
              ELSE coalesce(total_lines, 0)::DOUBLE END AS v FROM repos),
            ends AS (SELECT coalesce(min(v), 0) AS lo, coalesce(max(v), 1) AS hi FROM texts)""",
        )
        + f"""SELECT full_name, {_even("(v - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END")}
            AS total_lines_norm FROM texts, ends""",
        "quality_score": _with(REPOS, _scaled("repos"))
        + f"SELECT full_name, {QUALITY} AS quality_score FROM scaled",
        "health_score": _with(REPOS)
        + f"""SELECT full_name, round({RECENCY}, 6) AS recency,
            round({PEOPLE}, 6) AS contributors, {HEALTH} AS health_score FROM repos""",
        "composite_rank": scored + f"SELECT full_name, stars, {SCORES} FROM scored {BEST}",
        "composite_by_job": scored
        + f"""SELECT job_id, full_name, {SCORES} FROM scored QUALIFY row_number() OVER (
            PARTITION BY job_id ORDER BY composite_score DESC, full_name) <= 20""",
        "score_breakdown": scored
        + """SELECT full_name, relevance_score AS relevance, quality_score AS quality,
            health_score AS health,
            coalesce(test_file_ratio, 0) AS test_file_ratio,
            coalesce(error_handling_density, 0) AS error_handling_density,
            coalesce(issue_close_rate, 0) AS issue_close_rate,
            coalesce(public_api_count, 0) AS public_api_count,
            coalesce(commit_recency, 0) AS commit_recency_days,
            coalesce(contributor_count, 0) AS contributor_count FROM scored""",
        "rank_repos": ranked(_cluster(REPOS_RANKED)),
        "rank_repos_any_band": ranked(ANY_BAND),
        "rank_repos_recrawled": f"SELECT * REPLACE (stars + 7 AS stars) FROM ({ranked(_cluster(REPOS_RANKED))})",
        "lite_search": _with(REPOS, LITE)
        + """SELECT 'lite-job' AS job_id, full_name AS repo_full_name, url AS repo_url, stars,
            quality_score, health_score FROM (SELECT * FROM (SELECT * FROM lite
              WHERE contains(lower(concat_ws(' ', full_name, description)), 'machinery')
              ORDER BY stars DESC, full_name LIMIT 20)
            ORDER BY stars DESC, full_name LIMIT 10)""",
        "raw_round_trip": _with(REPOS)
        + """SELECT job_id::VARCHAR AS job_id, full_name, url, description, language, stars, forks,
            total_lines, public_api_count, contributor_count, commit_recency FROM repos""",
        "stored_results": scored
        + f"""SELECT job_id::VARCHAR AS job_id, full_name AS repo_full_name, stars, {SCORES}
            FROM scored QUALIFY row_number() OVER (
            PARTITION BY job_id ORDER BY composite_score DESC, full_name) <= 20""",
        "stored_lite_results": _with(REPOS, LITE)
        + """SELECT 'lite-job' AS job_id, full_name AS repo_full_name, stars, quality_score,
            health_score FROM lite ORDER BY stars DESC, full_name LIMIT 10""",
        "status_log": """SELECT c_custkey::VARCHAR AS job_id,
            CASE WHEN c_custkey % 3 <> 0 THEN 'done' ELSE 'running' END AS status FROM customer""",
        "lite_scores": _with(REPOS, LITE)
        + f"""SELECT full_name, relevance_score, quality_score, health_score, {LITE_COMPOSITE}
            FROM lite""",
        "lite_rank": _with(REPOS, LITE)
        + f"""SELECT full_name, relevance_score, quality_score, health_score, {LITE_COMPOSITE},
            stars FROM (SELECT * FROM lite ORDER BY stars DESC, full_name LIMIT 10)""",
        "search_candidates": _with(REPOS)
        + """SELECT full_name, description, stars FROM repos
            WHERE contains(lower(concat_ws(' ', full_name, description)), 'machinery')
            ORDER BY stars DESC, full_name LIMIT 40""",
        "word_search": _with(REPOS)
        + """SELECT full_name, description, stars FROM repos
            WHERE list_has_all(regexp_extract_all(lower(concat_ws(' ', full_name, description)), '[a-z0-9]+'),
              ['machinery', 'customer'])
            ORDER BY stars DESC, full_name LIMIT 40""",
        "code_signatures": _with(CODE)
        + "SELECT repo, path, line_no, ext, sig, is_public, is_error FROM annotated",
        "file_counts": code + "SELECT * FROM files",
        "first_signatures": _with(CODE, FIRST_SIGNATURES)
        + "SELECT repo, n, sig FROM first_signatures",
        "dominant_language": _with(CODE, FILES, LANGUAGE) + "SELECT * FROM dominant",
        "code_metrics": _with(
            CODE, FILES, LANGUAGE, FIRST_SIGNATURES, TOTALS,
            "source AS (SELECT * FROM code WHERE ext <> '.md')",
            _tokens("source", "repo", "line"), _murmur(128), MINIMA,
        )
        + """SELECT repo, signatures, public_api_count,
            CASE WHEN total_files > 0 THEN test_files::DOUBLE / total_files ELSE 0e0 END
              AS test_file_ratio,
            CASE WHEN total_lines > 0 THEN error_lines::DOUBLE / total_lines ELSE 0e0 END
              AS error_handling_density,
            array_to_string(coalesce(fp, list_transform(range(128), lambda i: 4294967295)), ',')
              AS fingerprint,
            total_files, total_lines, language
          FROM totals JOIN dominant USING (repo) LEFT JOIN (
            SELECT repo, string_agg(sig, ',' ORDER BY n) AS signatures
            FROM first_signatures GROUP BY repo) USING (repo)
          LEFT JOIN prints ON k = repo""",
        "document_lines": r"""SELECT doc_id AS repo, count(line) AS lines,
            max(length(line)) AS longest
          FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10)))
            AS line FROM documents) GROUP BY doc_id""",
        "contributor_stats": _with(STATS)
        + """SELECT repo, contributor_count, trunc(days)::BIGINT AS commit_recency,
            rate AS issue_close_rate FROM stats""",
        "assembled_repos": _with(REPOS, CODE, FILES, LANGUAGE, TOTALS, STATS)
        + """SELECT full_name, url, description, r.language, stars, forks, t.total_lines,
            d.language AS code_language, s.contributor_count,
            trunc(days)::BIGINT AS commit_recency
          FROM repos r JOIN totals t ON t.repo = repo_id JOIN dominant d ON d.repo = repo_id
          LEFT JOIN stats s ON s.repo = repo_id""",
        "minhash": prints
        + "SELECT k AS doc_id, array_to_string(fp, ',') AS fingerprint FROM prints",
        "band_keys": _with(*DOCUMENT_PRINTS, BANDS)
        + "SELECT k AS doc_id, band, bucket FROM bands",
        "bucket_flags": _with(*bands)
        + "SELECT id AS doc_id, band, place > 1 AS is_duplicate FROM members",
        "dedup_any_band": deduped(ANY_BAND),
        "dedup_cluster": deduped(_cluster(DOCUMENTS_RANKED)),
        "duplicate_links": _with(*bands, LINKS) + "SELECT * FROM pairs",
        "jaccard_estimate": _with(*bands, LINKS)
        + """SELECT keeper, duplicate, bands, len(list_filter(range(1, 129),
              lambda i: a.fp[i] = b.fp[i])) / 128e0 AS jaccard
          FROM pairs JOIN prints a ON a.k = keeper JOIN prints b ON b.k = duplicate""",
        "contributor_sketches": """SELECT o_custkey AS repo, count(DISTINCT l_suppkey) AS contributor_count, true AS within
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""",
        "tree_source": """SELECT 'lang=' || lang AS repo, sum(len(lines))::BIGINT AS lines,
            sum(list_sum(list_transform(lines, lambda x: length(x))))::BIGINT AS chars
          FROM (SELECT lang, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) GROUP BY lang""",
        "set_pairs": _with(_tokens("documents", "doc_id", "text"), SETS)
        + "SELECT a, b, round(jaccard, 6) AS jaccard FROM alike",
        "set_members": _with(_tokens("documents", "doc_id", "text"), SETS)
        + "SELECT k AS doc_id, class FROM classes",
        "band_recall": _with(*DOCUMENT_PRINTS, BANDS, SETS)
        + """SELECT count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM bands x JOIN bands y
              USING (band, bucket) WHERE x.k = a AND y.k = b)) AS found FROM alike""",
        "embed_hashing": _with(
            "low AS (SELECT doc_id, lower(text) AS text FROM documents)",
            f"""every AS (SELECT doc_id AS k, unnest(string_split_regex(text, '{SPACES}')) AS t
              FROM low)""",
            "tok AS (SELECT k, t FROM every WHERE t <> '')",
            _murmur(2),
            """slots AS (
              SELECT a.t, a.h % 384 AS slot, 1 - 2 * (b.h % 2)::BIGINT AS sign
              FROM hashed a JOIN hashed b ON a.t = b.t AND a.seed = 0 AND b.seed = 1),
            counts AS (SELECT k, slot::BIGINT AS slot, sum(sign)::BIGINT AS n
              FROM tok JOIN slots USING (t) GROUP BY ALL)""",
        )
        + """SELECT k AS doc_id, slot, n / sqrt((sum(n * n) OVER (PARTITION BY k))::DOUBLE)
              AS weight FROM counts QUALIFY n <> 0""",
        "semantic_cache": _with(INCOMING, _nearest("stored")) + "SELECT * FROM hits",
        "cached_job": f"""SELECT vec_id AS job_id, round(list_cosine_similarity(
              embedding::DOUBLE[], {QUERY_VECTOR}), 6) AS similarity
            FROM embeddings QUALIFY row_number() OVER (ORDER BY list_cosine_similarity(
              embedding::DOUBLE[], {QUERY_VECTOR}) DESC, vec_id) = 1 AND similarity >= 0.92""",
        "search_split": _with(
            INCOMING, STATUS,
            """done AS MATERIALIZED (SELECT * FROM stored WHERE job_id IN (
              SELECT job_id FROM current WHERE status = 'done'))""",
            _nearest("done"),
        )
        + """SELECT query_id, coalesce(job_id::VARCHAR, sha256(query_id::VARCHAR)) AS job_id,
            job_id IS NOT NULL AS cached FROM incoming LEFT JOIN hits USING (query_id)""",
        "vector_json": """SELECT vec_id AS job_id, len(embedding) AS dims, true AS same
            FROM embeddings""",
        "latest_status": _with(STATUS) + "SELECT * FROM current",
        "job_status": _with(STATUS) + "SELECT status FROM current WHERE job_id = 7",
        "last_write": _with(STATUS)
        + """SELECT job_id, last(status ORDER BY seq) AS status, max(seq) AS seq
            FROM status_events GROUP BY job_id""",
        "insert_if_absent": """SELECT c_custkey AS job_id, c_name FROM customer
            WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
        "orphan_results": """SELECT doc_id AS job_id, source FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "referenced_results": """SELECT doc_id AS job_id, source FROM documents
            WHERE doc_id IN (SELECT doc_id FROM labels)""",
        "job_manifest": _with(REPOS) + "SELECT job_id, count(*) AS count FROM repos GROUP BY 1",
        "result_counts": """SELECT c_nationkey AS job_id, least(count(*), 20) AS count
            FROM customer GROUP BY c_nationkey""",
        "fetch_results": scored
        + f"""SELECT full_name AS repo_full_name, url AS repo_url,
            coalesce(description, '') AS description, coalesce(language, '') AS language, stars,
            {SCORES} FROM scored WHERE job_id = 7
            ORDER BY composite_score DESC, full_name LIMIT 10""",
        "present_results": scored + _present(),
        "keywords": f"""SELECT conv_id, turn, {KEYWORDS} AS query,
            regexp_matches(text, '^\\s*$') AS blank FROM conversations""",
        "encoded_queries": """SELECT conv_id, turn,
            replace(url_encode(text), '%20', '+') AS encoded FROM conversations""",
        "token_counts": f"""SELECT doc_id, count(t) AS tokens, count(DISTINCT t) AS distinct_tokens
            FROM (SELECT doc_id, unnest(string_split_regex(text, '{SPACES}')) AS t FROM documents)
            WHERE t <> '' GROUP BY doc_id""",
        "lite_results": _with(REPOS, LITE)
        + """SELECT sha256('lite-job' || chr(10) || full_name) AS id, 'lite-job' AS job_id,
            full_name AS repo_full_name, url AS repo_url,
            coalesce(description, '') AS description, coalesce(language, '') AS language, stars,
            quality_score, health_score
          FROM lite ORDER BY stars DESC, full_name LIMIT 10""",
        "embed_text": _with(
            REPOS,
            f"""{words} AS (SELECT o_custkey, list(DISTINCT p_name ORDER BY p_name) AS parts
              FROM orders JOIN lineitem ON o_orderkey = l_orderkey
              JOIN part ON l_partkey = p_partkey GROUP BY o_custkey)""",
        )
        + """SELECT repo_id, array_to_string(
              list_concat([coalesce(description, '')], coalesce(parts, [])[1:10]), ' ') AS text,
            array_to_string(
              list_concat([coalesce(description, '')], coalesce(parts, [])), ' ') AS lite_text
          FROM repos LEFT JOIN bought ON o_custkey = repo_id""",
        "path_functions": r"""SELECT page_id, string_split(url, '/')[-1] AS basename,
            lower(regexp_extract(url, '(\.[^./]*)$', 1)) AS extension,
            CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '/' END
              AS parent,
            replace(url, '/', '_') AS sanitized,
            'raw/' || page_id::VARCHAR || '/' || replace(url, '/', '_') AS job_path
          FROM pages""",
    }
