"""DuckDB SQL of the operators whose results SQL can state in full."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TENSORED_MINHASH = rf"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_LOWER}), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT words.doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
#: crc32 of the id as text: an inner reduce shifts eight times.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


_LEAF = ("doc_id", "source", "lang", "n_chars")
_CUT = "CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
MERKLE_MANIFEST = f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT doc_id, source, sha256({' || '.join(map(_field, (*_LEAF, 'text')))}) AS leaf,
         sha256({' || '.join(map(_field, _LEAF))} || {_field(_CUT)}) AS own
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx FROM hashed),
tree(source, lvl, idx, digest, n) AS (
  SELECT source, 0, idx, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, idx // 3),
nodes AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (SELECT source, lvl AS top, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
upper(lvl, idx, digest, n) AS (
  SELECT 0, idx, subroot, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 2) // 3 FROM upper WHERE n > 1 GROUP BY lvl, idx // 3),
higher AS MATERIALIZED (SELECT * FROM upper),
every AS MATERIALIZED (
  SELECT x.source, x.lvl AS step, x.idx, string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx) AS before, string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx) AS after
  FROM nodes x JOIN nodes y ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY 1, 2, 3),
above AS MATERIALIZED (
  SELECT x.lvl AS step, x.idx, string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx) AS before, string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx) AS after
  FROM higher x JOIN higher y ON x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY 1, 2),
rows AS MATERIALIZED (SELECT row_number() OVER () AS k, l.*, s.subroot, s.top, s.idx AS place FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source),
path AS MATERIALIZED (
  SELECT k, step, coalesce(before, '') AS before, coalesce(after, '') AS after FROM rows r JOIN every e ON r.source IS NOT DISTINCT FROM e.source AND e.idx = r.idx // (3 ** step)::BIGINT
  UNION ALL
  SELECT k, top + step, coalesce(before, ''), coalesce(after, '') FROM rows r JOIN above a ON a.idx = r.place // (3 ** step)::BIGINT),
folds(k, step, digest) AS (
  SELECT k, 0, own FROM rows
  UNION ALL
  SELECT f.k, f.step + 1, sha256(before || digest || after) FROM folds f JOIN path p ON f.k = p.k AND f.step = p.step),
folded AS (SELECT k, arg_max(digest, step) AS folded_root FROM folds GROUP BY 1),
proofs AS (SELECT k, sha256(coalesce(string_agg(before || after, '' ORDER BY step), '')) AS proof_sha256 FROM rows LEFT JOIN path USING (k) GROUP BY 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM rows JOIN proofs USING (k) JOIN folded USING (k), (SELECT digest AS root FROM higher WHERE n = 1)"""


def _clusters(rounds: int = 10) -> str:
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT k, arg_min(j, dist * 8 + j) AS j, min(dist) AS dist FROM (SELECT k, j, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM kept, c{i}) GROUP BY k)"
    parts = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT k, unnest(range(64)) AS d, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS j, x AS c FROM kept ORDER BY sha256('3:' || vec_id::VARCHAR) LIMIT 8)"""]
    for i in range(rounds):
        parts.append(nearest(i))
        parts.append(f"m{i} AS (SELECT j, list(v ORDER BY d) AS c FROM (SELECT j, d, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM parts JOIN a{i} USING (k) GROUP BY j, d) GROUP BY j)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.c, c{i}.c)::BIGINT[] AS c FROM c{i} LEFT JOIN m{i} USING (j))")
    parts.append(nearest(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, j::INT AS cluster, dist AS distance, sum(dist) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(dist) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (k) JOIN c{rounds} USING (j)"""


CENTROID_CLUSTERING = _clusters()
