"""The DuckDB twin of the density clusters: a spanning tree grown point by point, parts joined edge by edge, lists as state."""

from __future__ import annotations


def density_sql(emb: str, sig: str) -> str:
    """emb: CTEs up to emb(doc_id, dim, v); sig: a CTE sig(doc_id, signature, group_id)."""
    rate = "CASE WHEN d = 0 THEN 1e12 ELSE 1 / (d * 1e-9) END"
    return f"""
WITH RECURSIVE {emb}, {sig},
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, list(coalesce(v, 0) ORDER BY dim) AS x FROM (SELECT doc_id, k AS dim FROM documents, range(32) r(k)) LEFT JOIN emb USING (doc_id, dim) GROUP BY doc_id),
z AS (SELECT count(*) AS n, greatest(3, count(*) // 50) AS least FROM p),
dist AS (SELECT a.i AS a, b.i AS b, round(list_distance(a.x, b.x) * 1e9)::BIGINT AS d FROM p a, p b),
core AS (SELECT a, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS k FROM dist), z WHERE k = least + 1),
reach AS (SELECT dist.a, list(greatest(d, x.core, y.core) ORDER BY b) AS row FROM dist JOIN core x ON dist.a = x.a JOIN core y ON dist.b = y.a GROUP BY dist.a),
prim AS (
  SELECT 1 AS step, NULL::BIGINT AS edge, list_transform(row, lambda d, j: CASE WHEN j > 1 THEN d * 16777216 + 4096 + j END) AS best FROM reach WHERE a = 1
  UNION ALL
  SELECT step + 1, edge, list_transform(best, lambda o, j: CASE WHEN j <> nxt THEN least(o, CASE WHEN o IS NOT NULL THEN row[j] * 16777216 + least(j, nxt) * 4096 + greatest(j, nxt) END) END)
  FROM (SELECT step, best, list_min(best) AS edge, list_position(best, list_min(best)) AS nxt FROM prim WHERE list_min(best) IS NOT NULL) JOIN reach ON a = nxt),
edges AS (SELECT row_number() OVER (ORDER BY edge) AS r, edge >> 24 AS d, (edge >> 12) & 4095 AS a, edge & 4095 AS b FROM prim WHERE edge IS NOT NULL),
kr AS (
  SELECT 0::BIGINT AS r, range(1, n + 1) AS part, list_transform(range(n), lambda x: 0::BIGINT) AS c, NULL::BIGINT AS one, NULL::BIGINT AS other, 0::BIGINT AS new FROM z
  UNION ALL
  SELECT r, list_transform(part, lambda x: CASE WHEN x = pb THEN pa ELSE x END), list_transform(c, lambda x, j: CASE WHEN part[j] IN (pa, pb) THEN now ELSE x END), CASE WHEN na >= least AND nb >= least THEN c[a] END, CASE WHEN na >= least AND nb >= least THEN c[b] END, now
  FROM (SELECT *, CASE WHEN na >= least AND nb >= least THEN r WHEN na >= least THEN c[a] WHEN nb >= least THEN c[b] WHEN na + nb >= least THEN r ELSE 0 END AS now
    FROM (SELECT e.r, e.a, e.b, part, c, part[e.a] AS pa, part[e.b] AS pb, len(list_filter(part, lambda x: x = part[e.a])) AS na, len(list_filter(part, lambda x: x = part[e.b])) AS nb FROM kr JOIN edges e ON e.r = kr.r + 1), z)),
fell AS (SELECT i, min(r) AS f, arg_min(c, r) AS c FROM (SELECT r, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS c FROM kr) WHERE c > 0 GROUP BY i),
up AS (SELECT one AS c, r AS parent FROM kr WHERE one IS NOT NULL UNION ALL SELECT other, r FROM kr WHERE one IS NOT NULL),
cl AS (SELECT new AS c, parent, coalesce({rate}, 0) AS born, row_number() OVER (ORDER BY new) AS k FROM (SELECT new FROM kr WHERE new = r AND r > 0) LEFT JOIN up ON new = c LEFT JOIN edges ON edges.r = parent),
above AS (SELECT c, c AS top FROM cl UNION ALL SELECT above.c, parent FROM above JOIN cl ON cl.c = top WHERE parent IS NOT NULL),
own AS (SELECT c, count(*) AS n, sum({rate}) AS rates FROM fell JOIN edges ON f = r GROUP BY c),
size AS (SELECT top AS c, sum(n) AS size FROM above JOIN own USING (c) GROUP BY top),
mass AS (SELECT cl.c, cl.k, cl.parent, coalesce(any_value(rates) - any_value(own.n) * cl.born, 0) + coalesce(sum(size * (kid.born - cl.born)), 0) AS mass, coalesce(list(kid.k) FILTER (kid.k IS NOT NULL), []) AS kids
  FROM cl LEFT JOIN own USING (c) LEFT JOIN cl kid ON kid.parent = cl.c LEFT JOIN size ON size.c = kid.c GROUP BY cl.c, cl.k, cl.parent, cl.born),
sel AS (
  SELECT 0::BIGINT AS k, []::DOUBLE[] AS vals, []::BOOLEAN[] AS picks
  UNION ALL
  SELECT k, list_append(vals, CASE WHEN pick OR none THEN mass ELSE under END), list_append(picks, pick)
  FROM (SELECT *, parent IS NOT NULL AND (none OR mass >= under) AS pick FROM (SELECT m.k, m.mass, m.parent, vals, picks, len(kids) = 0 AS none, coalesce(list_sum(list_transform(kids, lambda x: vals[x])), 0) AS under FROM sel JOIN mass m ON m.k = sel.k + 1))),
picked AS (SELECT cl.c FROM cl, (SELECT picks FROM sel ORDER BY k DESC LIMIT 1) WHERE picks[cl.k]),
named AS (SELECT above.c, max(top) AS label FROM above JOIN picked ON picked.c = top GROUP BY above.c),
raw AS (SELECT doc_id, coalesce(label, -1) AS label, signature, sig.group_id AS plain FROM p LEFT JOIN fell USING (i) LEFT JOIN named USING (c) JOIN sig USING (doc_id)),
num AS (SELECT label, s, row_number() OVER (ORDER BY label = -1, first) - 1 AS group_id FROM (SELECT label, CASE WHEN label = -1 THEN signature END AS s, min(doc_id) AS first FROM raw GROUP BY ALL))
SELECT doc_id, CASE WHEN (SELECT count(DISTINCT label) FROM raw) > 1 THEN num.group_id ELSE plain END AS group_id FROM raw JOIN num ON raw.label = num.label AND (raw.label <> -1 OR signature = s)
"""
