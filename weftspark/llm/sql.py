"""SQL of operators 11 and 13, built from their parameters."""

from __future__ import annotations


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds of assignment and means as one chain of tables: components are rows, a codebook is (part, entry, position, value)."""
    nearest = """
  SELECT id, part, (arg_min(entry, (far, entry))) AS entry, min(far) AS far FROM (
    SELECT x.id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS far FROM x JOIN book{r} b USING (part, pos) GROUP BY x.id, x.part, b.entry)
  GROUP BY id, part"""
    tables = [
        f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND (SELECT bool_and(e IS NOT NULL AND isfinite(e)) FROM (SELECT unnest(embedding) AS e))),
x AS (
  SELECT id, (k - 1) // (n // {parts}) AS part, (k - 1) % (n // {parts}) AS pos, CAST(floor({scale} * CAST(embedding[k] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT id, embedding, len(embedding) AS n, unnest(generate_series(1, len(embedding))) AS k FROM kept)),
book0 AS (SELECT part, id - 1 AS entry, pos, v FROM x WHERE id <= {entries})"""
    ]
    for r in range(rounds):
        tables.append(f"near{r} AS ({nearest.format(r=r)})")
        tables.append(f"""
means{r} AS (
  SELECT part, entry, pos, ((s - ((s % n) + n) % n) // n) AS v FROM (
    SELECT near{r}.part, near{r}.entry, x.pos, sum(x.v) AS s, count(*) AS n FROM near{r} JOIN x USING (id, part) GROUP BY ALL)),
book{r + 1} AS (
  SELECT part, entry, pos, CAST(coalesce(means{r}.v, book{r}.v) AS BIGINT) AS v FROM book{r} LEFT JOIN means{r} USING (part, entry, pos))""")
    tables.append(f"""last AS ({nearest.format(r=rounds)}),
coded AS (
  SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM last GROUP BY id),
told AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS sha FROM book{rounds})""")
    return (
        "WITH "
        + ",\n".join(t.strip() for t in tables)
        + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded JOIN kept USING (id) CROSS JOIN told"""
    )


#: Conversations rebuilt, then every distinct beginning as a list of turns; a node's subtree are the nodes that begin with it.
#: DuckDB has no crc32: its reversed polynomial divides bit by bit.
TRIE = """
WITH RECURSIVE told AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits FROM told),
crc AS (
  SELECT conv_id, digits, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, digits, k + 1, CAST(xor(z >> 1, 3988292384 * (z & 1)) AS BIGINT)
  FROM (SELECT conv_id, digits, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(digits, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS z
        FROM crc WHERE k < 8 * length(digits))),
heads AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM crc WHERE k = 8 * length(digits)),
turns AS (
  SELECT heads.conv_id, 0 AS own, place, role, text FROM heads JOIN told ON told.conv_id = base WHERE place < h
  UNION ALL
  SELECT heads.conv_id, 1, place, role, text FROM heads JOIN told ON told.conv_id = heads.conv_id WHERE place >= h),
ways AS (
  SELECT conv_id, strlen(text) AS bytes, sha256(concat(strlen(role), ':', role, text)) AS name,
         row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS length
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
begun AS (
  SELECT conv_id, depth, length, bytes, list(name) OVER (PARTITION BY conv_id ORDER BY depth) AS way FROM ways
  UNION ALL
  SELECT ids.conv_id, 0, (SELECT count(*) FROM turns WHERE turns.conv_id = ids.conv_id), 0, [] FROM ids),
nodes AS (
  SELECT way, depth, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends
  FROM begun GROUP BY way, depth),
kids AS (SELECT way[1:depth - 1] AS way, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
tops AS (
  SELECT way[1:d] AS way, sum((n - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM (SELECT nodes.*, n_children, unnest(generate_series(0, depth)) AS d FROM nodes LEFT JOIN kids ON kids.way = nodes.way) GROUP BY ALL)
SELECT nodes.conv_id, nodes.depth, parents.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN tops ON tops.way = nodes.way LEFT JOIN kids ON kids.way = nodes.way
LEFT JOIN nodes AS parents ON nodes.depth > 0 AND parents.depth = nodes.depth - 1 AND parents.way = nodes.way[1:nodes.depth - 1]
"""
