"""Newton steps of a logistic regression written out in SQL, many models at once.

The linear system of a step is solved by Gauss-Jordan elimination, one nested
select a pivot; the system is symmetric and positive definite, so no pivot is zero.
"""

from __future__ import annotations


def _solved(system: str, m: int, keep: str) -> str:
    """The last column of ``sys`` after elimination of all ``m`` pivots."""
    out = system
    for p in range(1, m + 1):
        row = f"list_transform(r, lambda v, j: v - r[{p}] * (sys[{p}][j] / sys[{p}][{p}]))"
        pivot = f"list_transform(r, lambda v: v / sys[{p}][{p}])"
        out = f"SELECT {keep}, list_transform(sys, lambda r, i: CASE WHEN i = {p} THEN {pivot} ELSE {row} END) AS sys FROM ({out}) p{p}"
    return out


def newton_ctes(rows: str, features, c: float = 0.5, steps: int = 25, impute: bool = False, prefix: str = "nw") -> str:
    """CTEs ending with ``{prefix}_fit`` (model, w) and ``{prefix}_scale`` (model, mu, sd, md).

    ``rows`` has ``model, y`` and the features: every row that a model learns from. ``w`` are the
    weights of the standardised features, then the intercept; ``md`` are medians for missing values.
    """
    d = len(features)
    m = d + 1
    x = f"{prefix}_"
    fill = ", ".join(f"coalesce(quantile_cont(CAST({f} AS DOUBLE), 0.5), 0) AS m{i}" for i, f in enumerate(features))
    value = lambda i, f: f"coalesce(CAST(r.{f} AS DOUBLE), m{i})" if impute else f"CAST(r.{f} AS DOUBLE)"
    filled = ", ".join(f"{value(i, f)} AS f{i}" for i, f in enumerate(features))
    mean = ", ".join(f"avg(f{i})" for i in range(d))
    sd = ", ".join(f"CASE WHEN stddev_pop(f{i}) > 0 THEN stddev_pop(f{i}) ELSE 1 END" for i in range(d))
    standard = ", ".join(f"(f{i} - mu[{i + 1}]) / sd[{i + 1}]" for i in range(d))
    # the exponential of a margin, the rows' residuals and curvatures
    sums = ", ".join(
        [f"sum(v * x[{i}] * x[{j}]) AS h{i}_{j}" for i in range(1, m + 1) for j in range(i, m + 1)] + [f"sum(e * x[{i}]) AS g{i}" for i in range(1, m + 1)]
    )
    cell = lambda i, j: f"{c} * h{min(i, j)}_{max(i, j)}" + (" + 1" if i == j and i <= d else "")
    right = lambda i: f"{c} * g{i}" + (f" - w[{i}]" if i <= d else "")
    system = ", ".join("[" + ", ".join([*[cell(i, j) for j in range(1, m + 1)], right(i)]) + "]" for i in range(1, m + 1))
    solved = _solved(f"SELECT k, model, w, [{system}] AS sys FROM s", m, "k, model, w")
    return f"""
{x}md AS MATERIALIZED (SELECT model, {fill} FROM {rows} GROUP BY model),
{x}filled AS MATERIALIZED (SELECT r.model, CAST(r.y AS DOUBLE) AS y, {filled} FROM {rows} r JOIN {x}md ON {x}md.model = r.model),
{x}scale AS MATERIALIZED (
    SELECT z.*, [{", ".join(f"m{i}" for i in range(d))}] AS md
    FROM (SELECT model, [{mean}] AS mu, [{sd}] AS sd FROM {x}filled GROUP BY model) z JOIN {x}md ON {x}md.model = z.model),
{x}tr AS MATERIALIZED (SELECT t.model, y, [{standard}, 1.0] AS x FROM {x}filled t JOIN {x}scale ON {x}scale.model = t.model),
{x}it AS (
    SELECT CAST(0 AS BIGINT) AS k, model, list_transform(range(0, {m}), lambda i: CAST(0 AS DOUBLE)) AS w FROM {x}scale
    UNION ALL
    SELECT k + 1, model, list_transform(w, lambda v, i: v + sys[i][{m + 1}]) FROM (
        WITH r AS (SELECT it.k, it.model, it.w, tr.x, tr.y, 1 / (1 + exp(-list_dot_product(it.w, tr.x))) AS p FROM {x}it it JOIN {x}tr tr ON tr.model = it.model WHERE it.k < {steps}),
        s AS (SELECT k, model, any_value(w) AS w, {sums} FROM (SELECT k, model, w, x, y - p AS e, p * (1 - p) AS v FROM r) q GROUP BY k, model)
        {solved}
    ) n
),
{x}fit AS MATERIALIZED (SELECT model, w FROM {x}it WHERE k = {steps})"""


def newton_score(row: str, features, prefix: str = "nw", impute: bool = False) -> str:
    """Probability of a row, with ``{prefix}_fit`` and ``{prefix}_scale`` of its model joined."""
    d = len(features)
    value = lambda i, f: f"coalesce(CAST({row}.{f} AS DOUBLE), md[{i + 1}])" if impute else f"CAST({row}.{f} AS DOUBLE)"
    terms = " + ".join(f"w[{i + 1}] * (({value(i, f)} - mu[{i + 1}]) / sd[{i + 1}])" for i, f in enumerate(features))
    return f"1 / (1 + exp(-(w[{d + 1}] + {terms})))"
