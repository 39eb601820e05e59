"""The expansion as unrolled SQL, written from its contract and not from the operator.

``seeds`` are expressions of ids or, with ``selects``, queries of them.
"""

from __future__ import annotations


def expand_sql(seeds: list[str], hops: int, k: int, floor: int = 40, source: str | None = None, query: str | None = None, me: str | None = None, selects: bool = False) -> str:
    passes = f"(n.source IS NULL OR n.source = '{source}')" if source else "true"
    score = "0.3 * CASE WHEN mx > 0 THEN n_obs / mx ELSE 0.0 END"
    if query:
        score = f"0.7 * list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), {query}) + {score}"
    me = me or "'entity_' || sha1('self:global')"

    def top(rows: str, size: int) -> str:
        return f"""SELECT uuid FROM (SELECT r.uuid, round({score}, 6) AS s FROM (SELECT n.*, max(n_obs) OVER () AS mx FROM ({rows}) q JOIN nodes n ON n.uuid = q.uuid) r
JOIN embeddings v ON v.vec_id = r.vec_id ORDER BY s DESC, r.uuid LIMIT {size}) z"""

    ctes = [
        "d0 AS (" + " UNION ".join(f"(SELECT uuid FROM ({s}) q)" if selects else f"SELECT {s} AS uuid" for s in seeds) + ")",
        "s0 AS (SELECT n.uuid FROM d0 JOIN nodes n USING (uuid) WHERE n.node_type <> 'log' AND n.weight > 0)",
        f"f0 AS (SELECT n.uuid FROM s0 JOIN nodes n USING (uuid) WHERE {passes})",
    ]
    outs = ["SELECT 'node' AS kind, uuid FROM s0"]
    for h in range(hops):
        ways = " UNION ALL ".join(
            f"""SELECT uuid, near_id, other, weight FROM (SELECT e.uuid, e.{a} AS near_id, e.{b} AS other, e.weight, row_number() OVER (PARTITION BY e.{a} ORDER BY e.uuid) AS r
FROM edges e JOIN f{h} f ON f.uuid = e.{a} WHERE e.user_id = 'global') t WHERE r <= 50"""
            for a, b in (("subject_uuid", "object_uuid"), ("object_uuid", "subject_uuid"))
        )
        ctes += [
            f"i{h} AS ({ways})",
            f"c{h} AS (SELECT DISTINCT other AS uuid, near_id FROM i{h} WHERE other NOT IN (SELECT uuid FROM d{h}))",
            f"d{h + 1} AS (SELECT uuid FROM d{h} UNION SELECT uuid FROM c{h})",
            f"n{h} AS (SELECT n.uuid FROM (SELECT DISTINCT uuid FROM c{h}) c JOIN nodes n USING (uuid) WHERE n.weight > 0 AND n.node_type <> 'log' AND {passes})",
            f"l{h} AS (SELECT n.uuid FROM (SELECT DISTINCT uuid FROM c{h}) c JOIN nodes n USING (uuid) WHERE n.weight > 0 AND n.node_type = 'log')",
        ]
        kept = top(f"SELECT uuid FROM n{h}", k)
        if h == 0 and floor > 0:
            mine = top(f"SELECT uuid FROM n{h} WHERE uuid IN (SELECT uuid FROM c{h} WHERE near_id = {me})", floor)
            kept = f"({kept}) UNION ({mine})"
        ctes.append(f"f{h + 1} AS ({kept})")
        outs += [f"SELECT 'node', uuid FROM f{h + 1}", f"SELECT 'node', uuid FROM l{h}"]
    edges = " UNION ".join(f"SELECT uuid FROM i{h} WHERE weight > 0" for h in range(hops))
    outs.append(f"SELECT DISTINCT 'edge', uuid FROM ({edges}) x")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(outs)


def expand_requests_sql(views: str, hops: int, k: int, floor: int, me: str) -> str:
    """The expansion of many requests: ``views`` define ``asked (rid, usr, src, q)`` and ``start (rid, uuid)``.

    ``me`` is SELF of the tenant that has one.
    """
    passes = "(a.src IS NULL OR n.source IS NULL OR n.source = a.src)"

    def top(rows: str, size: int) -> str:
        score = "CASE WHEN q IS NULL THEN 0.0 ELSE 0.7 * list_cosine_similarity(e, q) END + 0.3 * CASE WHEN mx > 0 THEN n_obs / mx ELSE 0.0 END"
        return f"""SELECT rid, uuid FROM (SELECT rid, uuid, row_number() OVER (PARTITION BY rid ORDER BY round({score}, 6) DESC, uuid) AS r FROM (
SELECT x.rid, n.uuid, n.n_obs, a.q, CAST(v.embedding AS DOUBLE[]) AS e, max(n.n_obs) OVER (PARTITION BY x.rid) AS mx FROM ({rows}) x JOIN asked a USING (rid) JOIN nodes n ON n.uuid = x.uuid JOIN embeddings v ON v.vec_id = n.vec_id) y) z WHERE r <= {size}"""

    ctes = [
        views,
        "d0 AS (SELECT DISTINCT rid, uuid FROM start)",
        "s0 AS (SELECT d.rid, n.uuid FROM d0 d JOIN nodes n USING (uuid) WHERE n.node_type <> 'log' AND n.weight > 0)",
        f"f0 AS (SELECT s.rid, n.uuid FROM s0 s JOIN nodes n USING (uuid) JOIN asked a ON a.rid = s.rid WHERE {passes})",
    ]
    outs = ["SELECT 'node' AS kind, rid, uuid FROM s0"]
    for h in range(hops):
        ways = " UNION ALL ".join(
            f"""SELECT f.rid, t.uuid, t.near_id, t.other, t.weight FROM f{h} f JOIN asked a USING (rid) JOIN (SELECT uuid, {x} AS near_id, {y} AS other, weight, user_id, row_number() OVER (PARTITION BY user_id, {x} ORDER BY uuid) AS r FROM edges) t
ON t.near_id = f.uuid AND t.user_id = a.usr AND t.r <= 50"""
            for x, y in (("subject_uuid", "object_uuid"), ("object_uuid", "subject_uuid"))
        )
        ctes += [
            f"i{h} AS ({ways})",
            f"c{h} AS (SELECT DISTINCT i.rid, i.other AS uuid, i.near_id FROM i{h} i WHERE NOT EXISTS (SELECT 1 FROM d{h} d WHERE d.rid = i.rid AND d.uuid = i.other))",
            f"d{h + 1} AS (SELECT rid, uuid FROM d{h} UNION SELECT rid, uuid FROM c{h})",
            f"n{h} AS (SELECT DISTINCT c.rid, n.uuid FROM c{h} c JOIN nodes n USING (uuid) JOIN asked a ON a.rid = c.rid WHERE n.weight > 0 AND n.node_type <> 'log' AND {passes})",
            f"l{h} AS (SELECT DISTINCT c.rid, n.uuid FROM c{h} c JOIN nodes n USING (uuid) WHERE n.weight > 0 AND n.node_type = 'log')",
        ]
        kept = top(f"SELECT rid, uuid FROM n{h}", k)
        if h == 0 and floor > 0:
            mine = f"SELECT n.rid, n.uuid FROM n{h} n WHERE EXISTS (SELECT 1 FROM c{h} c JOIN asked a USING (rid) WHERE c.rid = n.rid AND c.uuid = n.uuid AND a.usr = 'global' AND c.near_id = {me})"
            kept = f"{kept} UNION {top(mine, floor)}"
        ctes.append(f"f{h + 1} AS ({kept})")
        outs += [f"SELECT 'node', rid, uuid FROM f{h + 1}", f"SELECT 'node', rid, uuid FROM l{h}"]
    edges = " UNION ".join(f"SELECT rid, uuid FROM i{h} WHERE weight > 0" for h in range(hops))
    outs.append(f"SELECT DISTINCT 'edge', rid, uuid FROM ({edges}) x")
    return "WITH " + ", ".join(ctes) + " SELECT kind, rid AS request_id, uuid FROM (" + " UNION ALL ".join(outs) + ") u"
