"""SQL twins (DuckDB) of the operators that SQL can express.

Fingerprints (XXH64), boosted trees, the conditional random field, BPE, seeded copies, chains and matches
with code-point offsets have no SQL form; tests/llm holds those queries against brute force.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op5_voronoi"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

SQL["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), o AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS owner FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner = page_id THEN NULL ELSE owner END AS refers_to
FROM o
"""

SQL["op8_crosspolytope"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN l ON r.other = l.a
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.node = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""


def _clusters(rounds: int = 10, k: int = 8, dims: int = 64, seed: int = 3) -> str:
    """Rounds of assignment and exact floor division, one pair of tables per round."""
    near = """d{r} AS MATERIALIZED (SELECT n, c, d FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, c) AS o FROM (
  SELECT x.n, m.c, sum((x.x - m.x) * (x.x - m.x)) AS d FROM x JOIN c{r} m USING (i) GROUP BY x.n, m.c)) WHERE o = 1)"""
    move = """s{r} AS (SELECT d.c, x.i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM d{r} d JOIN x USING (n) GROUP BY d.c, x.i), c{next} AS MATERIALIZED (
  SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - ((s.s % s.n + s.n) % s.n)) // s.n END AS x FROM c{r} m LEFT JOIN s{r} s ON s.c = m.c AND s.i = m.i)"""
    steps = ", ".join(near.format(r=r) + ", " + move.format(r=r, next=r + 1) for r in range(rounds))
    return f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT n, unnest(v) AS x, unnest(range({dims})) AS i FROM e
), c0 AS MATERIALIZED (
  SELECT o - 1 AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) AS o FROM e) WHERE o <= {k}
), {steps}, {near.format(r=rounds)}, p AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT e.vec_id, CAST(d.c AS INTEGER) AS cluster, CAST(d.d AS BIGINT) AS distance, CAST(sum(d.d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d.d) OVER () AS BIGINT) AS inertia, p.centroid_sha256
FROM e JOIN d{rounds} d USING (n) JOIN p ON p.c = d.c
"""


SQL["op11_centroids"] = _clusters()
