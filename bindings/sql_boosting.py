"""The first boosted tree written out in SQL: bins, histograms of a level, splits, Newton leaves."""

from __future__ import annotations

from spendlens.operators import boosting as B


def first_tree(rows: str, features, depth: int = B.DEPTH) -> tuple[str, str]:
    """(CTEs, body): ``rows`` has ``id, y`` and the features; the body gives the nodes of the tree."""
    scale = float(2**30)
    long = " UNION ALL ".join(f"SELECT id, {i} AS f, CAST({f} AS DOUBLE) AS x FROM {rows}" for i, f in enumerate(features))
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    half = f"(v[(k * (n - 1)) // {B.BINS} + 1] + v[(k * (n - 1) + {B.BINS - 1}) // {B.BINS} + 1]) / 2"
    ctes = [
        f"bl AS MATERIALIZED ({long})",
        "bm AS MATERIALIZED (SELECT f, quantile_cont(x, 0.5) AS m FROM bl GROUP BY f)",
        "bx AS MATERIALIZED (SELECT id, bl.f, coalesce(x, m, 0) AS x FROM bl JOIN bm ON bm.f = bl.f)",
        "bv AS MATERIALIZED (SELECT f, list(x ORDER BY x) AS v, list_sort(list_distinct(list(x))) AS d, count(*) AS n FROM bx GROUP BY f)",
        f"""be AS MATERIALIZED (SELECT f, list_sort(list_distinct(CASE WHEN len(d) <= {B.BINS} THEN list_transform(range(1, len(d)), lambda k: (d[k] + d[k + 1]) / 2)
            ELSE list_transform(range(1, {B.BINS}), lambda k: {half}) END)) AS e FROM bv)""",
        "bb AS MATERIALIZED (SELECT id, bx.f, len(list_filter(e, lambda v: v < x)) AS b, len(e) AS ne FROM bx JOIN be ON be.f = bx.f)",
        f"bp AS (SELECT avg(y) AS p FROM {rows})",
        f"""t0 AS MATERIALIZED (SELECT id, 0 AS node, CAST(round_even((p - y) * {scale}, 0) AS BIGINT) AS g,
            CAST(round_even(p * (1 - p) * {scale}, 0) AS BIGINT) AS h FROM {rows}, bp)""",
    ]
    term = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} * {a} / {b} ELSE 0 END"
    for level in range(depth):
        first, last = 2**level - 1, 2 ** (level + 1) - 2
        ctes += [
            f"""h{level} AS MATERIALIZED (SELECT node, bb.f, b, any_value(ne) AS ne, sum(g) AS g, sum(h) AS h, count(*) AS n
            FROM t{level} t JOIN bb ON bb.id = t.id WHERE node BETWEEN {first} AND {last} GROUP BY node, bb.f, b)""",
            f"""c{level} AS (SELECT node, f, b, ne, CAST(sum(g) OVER w AS DOUBLE) / {scale} AS gl, CAST(sum(h) OVER w AS DOUBLE) / {scale} AS hl, sum(n) OVER w AS nl,
            CAST(sum(g) OVER a AS DOUBLE) / {scale} AS gt, CAST(sum(h) OVER a AS DOUBLE) / {scale} AS ht, sum(n) OVER a AS nt FROM h{level}
            WINDOW a AS (PARTITION BY node, f), w AS (PARTITION BY node, f ORDER BY b))""",
            f"""s{level} AS (SELECT *, {term('gl', 'hl')} + {term('(gt - gl)', '(ht - hl)')} - {term('gt', 'ht')} AS gain FROM c{level}
            WHERE b < ne AND nl >= {B.LEAF_ROWS} AND nt - nl >= {B.LEAF_ROWS} AND hl >= {B.LEAF_CURVE} AND ht - hl >= {B.LEAF_CURVE})""",
            f"""b{level} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) AS r FROM s{level}) q
            WHERE r = 1 AND gain > {B.LEAST_GAIN})""",
            f"""t{level + 1} AS MATERIALIZED (SELECT t.id, CASE WHEN s.node IS NULL THEN t.node WHEN bb.b > s.b THEN 2 * t.node + 2 ELSE 2 * t.node + 1 END AS node, g, h
            FROM t{level} t LEFT JOIN b{level} s ON s.node = t.node LEFT JOIN bb ON bb.id = t.id AND bb.f = s.f)""",
        ]
    splits = " UNION ALL ".join(f"SELECT * FROM b{level}" for level in range(depth))
    body = f"""SELECT CAST(s.node AS BIGINT) AS node, CAST(nt AS BIGINT) AS n, name AS feature, e[b + 1] AS threshold, gain, CAST(NULL AS DOUBLE) AS value
    FROM ({splits}) s JOIN be ON be.f = s.f JOIN (VALUES {names}) v(f, name) ON v.f = s.f
    UNION ALL SELECT node, count(*), NULL, NULL, NULL, -{B.RATE} * (CAST(sum(g) AS DOUBLE) / {scale}) / (CAST(sum(h) AS DOUBLE) / {scale}) FROM t{depth} GROUP BY node"""
    return ", ".join(ctes), body
