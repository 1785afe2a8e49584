"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations


def centroids_sql(clusters: int = 40, rounds: int = 5, dim: int = 64, factor: int = 256) -> str:
    """Rounds of assigning vectors to centroids and moving these, spelt out one after the other."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: floor({factor} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) = {dim}
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
)""",
        f"""c0 AS (
  SELECT n - 1 AS k, v
  FROM (SELECT v, row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) AS n FROM kept)
  WHERE n <= {clusters}
)""",
    ]
    apart = "list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v)"
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} AS (
  SELECT row, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v,
         min(CAST({apart} AS BIGINT) * 1024 + k) AS best
  FROM kept x, c{n} c GROUP BY row
)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS (
  SELECT c.k, coalesce(m.v, c.v) AS v
  FROM c{n} c LEFT JOIN (
    SELECT k, list(floor(total / n) ORDER BY i) AS v
    FROM (
      SELECT best % 1024 AS k, i, sum(v[i]) AS total, count(*) AS n
      FROM near{n}, range(1, {dim + 1}) AS places(i) GROUP BY ALL
    ) GROUP BY k
  ) m USING (k)
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))
         AS centroid_sha256
FROM (SELECT vec_id, best % 1024 AS k, best // 1024 AS distance FROM near{rounds})
JOIN c{rounds} c USING (k)"""


# CRC-32 of the decimal id, byte by byte and bit by bit
_CRC32 = """xor(4294967295, list_reduce(
  list_concat([CAST(4294967295 AS BIGINT)],
              list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, byte: list_reduce(
    list_concat([xor(crc, byte)], [CAST(0 AS BIGINT) FOR i IN range(8)]),
    lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

PREFIX_TRIE = f"""WITH own AS (
  SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', role, text)) AS digest,
         length(coalesce(text, '')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, {_CRC32} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
  SELECT convs.c, 0 AS part, pos, digest, n FROM convs JOIN own ON own.c = base AND pos < h
  UNION ALL
  SELECT c, 1, pos, digest, n FROM convs JOIN own USING (c) WHERE pos >= h
), numbered AS (
  SELECT c, digest, n, row_number() OVER whole AS d, count(*) OVER (PARTITION BY c) AS len,
         md5(string_agg(digest, '') OVER whole) AS key
  FROM rebuilt WINDOW whole AS (PARTITION BY c ORDER BY part, pos)
), prefixes AS (
  SELECT c, d, len, n, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), 'root') AS parent
  FROM numbered
  UNION ALL
  SELECT c, 0, coalesce(len, 0), 0, 'root', NULL
  FROM convs LEFT JOIN (SELECT c, any_value(len) AS len FROM numbered GROUP BY c) USING (c)
), nodes AS (
  SELECT key, any_value(parent) AS parent, min(c) AS c, any_value(d) AS d, any_value(n) AS n,
         count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends
  FROM prefixes GROUP BY key
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT p.key, sum((v.n_convs - 1) * v.n) AS saved, count(*) FILTER (w.key IS NULL) AS leaves
  FROM nodes v JOIN prefixes p ON p.c = v.c AND p.d <= v.d LEFT JOIN children w ON w.key = v.key
  GROUP BY p.key
)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, u.c AS parent_conv_id, v.n_convs,
       coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN sums USING (key) LEFT JOIN children USING (key) LEFT JOIN nodes u ON u.key = v.parent"""
