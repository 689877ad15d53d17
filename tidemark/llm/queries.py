"""Queries over the given tables, one per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: The key of the query only, fixed so that its runs can be compared. The pipeline never uses it.
PII_KEY = b"tidemark queries"

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM m
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n nx ON a = nx.doc_id JOIN n ny ON b = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_ ON d.doc_id = a
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn >') + 1 + length('</turn>') + 1 + length(regexp_replace(role, '([\\<>])', '\\\1', 'g'))
           + length(regexp_replace(text, '([\\<])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
r(kind, nr, pattern, least, part) AS (VALUES
  ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6, 2),
  ('access', 1, 'AKIA[A-Z0-9]+', 20, 0), ('hex', 2, '[0-9a-f]+', 24, 0),
  ('private', 3, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 1, 0),
  ('signed', 4, 'eyJ[A-Za-z0-9_-]{8,200}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 40, 0),
  ('prefixed', 5, '(?:gh[opsu]_|xox[abp]-|sk_live_)[A-Za-z0-9-]+', 20, 0),
  ('address', 6, '://[A-Za-z0-9_.-]+:([^\x20\x09-\x0D/@:]+)@', 6, 1)),
c AS (SELECT row, kind, nr, least, regexp_split_to_array(t, pattern) AS gaps, regexp_extract_all(t, pattern, 0) AS found,
             regexp_extract_all(t, pattern, 1) AS one, CASE WHEN part = 2 THEN regexp_extract_all(t, pattern, 2) END AS two, part
      FROM (SELECT *, CASE WHEN part = 0 THEN '(' || pattern || ')' ELSE pattern END AS p FROM d, r WHERE regexp_matches(t, pattern)) AS x(row, doc_id, t, kind, nr, plain, least, part, pattern)),
e AS (SELECT row, kind, nr, least, k, length(gaps[k]) AS gap, length(found[k]) AS size, length(CASE part WHEN 2 THEN two[k] ELSE one[k] END) AS measured
      FROM c, unnest(range(1, len(found) + 1)) AS u(k)),
s AS (SELECT row, kind, nr, measured >= least AS fits, size, sum(gap + size) OVER (PARTITION BY row, kind ORDER BY k) AS stop FROM e),
g AS (SELECT row, count(*) FILTER (nr = 0) AS n_assign, count(*) FILTER (nr = 1) AS n_access, count(*) FILTER (nr = 2) AS n_hex,
             string_agg(kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - size, nr) FILTER (nr < 3) AS base,
             string_agg(kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - size, nr) AS spans FROM s WHERE fits GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""

OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32)) AS turns,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.h), []), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns
      FROM o LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 5),
n AS (SELECT depth, list_slice(turns, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends
      FROM c, unnest(range(0, len(turns) + 1)) AS u(depth) GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].t) ELSE 0 END AS saved FROM n LEFT JOIN k USING (depth, path)),
a AS (SELECT d AS depth, list_slice(path, 1, d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM w, unnest(range(0, depth + 1)) AS u(d) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN a USING (depth, path) LEFT JOIN n AS p ON p.depth = w.depth - 1 AND p.path = list_slice(w.path, 1, w.depth - 1)
"""


def _op13_sql() -> str:
    """Three rounds, each a table of centroids (c, d, x) made of the one before."""
    steps = [
        "v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (SELECT row, d, e[d] AS x FROM v, unnest(range(1, 65)) AS u(d))",
        "first AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c FROM v QUALIFY c < 16)",
        "c0 AS (SELECT c, d, x FROM first JOIN p USING (row))",
    ]
    for k in range(4):
        steps.append(
            f"a{k} AS (SELECT row, c, distance FROM (SELECT p.row, c, sum((p.x - c{k}.x) * (p.x - c{k}.x))::BIGINT AS distance FROM p JOIN c{k} USING (d) GROUP BY p.row, c)"
            " QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1)"
        )
        if k < 3:
            steps.append(f"m{k} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{k} JOIN p USING (row) GROUP BY c, d)")
            steps.append(f"c{k + 1} AS (SELECT c, d, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, x) AS x FROM c{k} LEFT JOIN m{k} USING (c, d))")
    steps.append("h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)")
    found = "SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256"
    return f"WITH {', '.join(steps)} {found} FROM a3 JOIN v USING (row) JOIN h USING (c)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; null and empty texts are the end token alone, an empty table gives no rows."""
    from tidemark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; null and empty texts are scored as texts without words, repeated rows each."""
    from tidemark.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, read back from the archives; a null page is an empty payload."""
    from tidemark.llm.warc import archive_pages, read_records

    return read_records(archive_pages(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms; null and empty texts stay."""
    from tidemark.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document; null and empty texts have none."""
    from tidemark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; null and empty texts get the score of no match."""
    from tidemark.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest products of every hundredth vector; unusable vectors take no part."""
    from tidemark.llm.pivot_search import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates; documents without words are linked with nothing."""
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector; unusable and zero vectors take no part."""
    from tidemark.llm.vantage import build_index, nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter("vec_id % 50 = 0"), build_index(vectors), k=5)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of one that holds control strings; null roles and texts count as empty."""
    from tidemark.llm.chat import digests, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, text FROM VALUES (0L, 'user', :hard), (1L, 'assistant', :hard) AS t(turn, role, text)", args={"hard": hard})
    return digests(format_conversations(turns.union(extra)))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a new ledger; null texts are empty, repeated rows are returned each, an empty table gives no rows."""
    from tidemark.llm.common import scratch
    from tidemark.llm.secret_scan import Ledger, digests, scan

    return digests(scan(_table(spark, sf_dir, "documents"), Ledger(spark, scratch(spark, "ledger"))))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; null roles and texts are empty, rows without conv_id are no conversation, an empty table gives no rows."""
    from tidemark.llm.prefix_trie import conversation_paths, prefix_trie, with_borrowed_heads

    return prefix_trie(with_borrowed_heads(conversation_paths(_table(spark, sf_dir, "conversations"))))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all usable vectors of 64 components; repeated rows are vectors of their own, an empty table gives no rows."""
    from tidemark.llm.centroids import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import mixing_sql

    return {"op3_warc": OP3_SQL, "op5_mixing_sources": mixing_sql.SQL, "op7_exact_top_k": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op10_chat_formatting": OP10_SQL, "op11_secret_scans": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_centroid_clustering": _op13_sql()}
