"""Tail probabilities and step-up values written out in SQL, for the twins.

The tails are integrals from 0 to the statistic, by Simpson's rule on a grid that
is fine enough for 1e-9: the normal density as it is, the t density after
t = sqrt(nu) tan(theta), which turns it into a power of a cosine.
"""

from __future__ import annotations

STEPS = 4000
_WEIGHT = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def _simpson(upper: str, value: str) -> str:
    return f"({upper}) / {3 * STEPS}.0 * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {_WEIGHT} * {value}))"


def normal_two_sided(z: str) -> str:
    area = _simpson(f"abs({z})", f"exp(-power(abs({z}) * i / {STEPS}.0, 2) / 2)")
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {area})"


def student_two_sided(t: str, nu: str) -> str:
    top = f"atan(abs({t}) / sqrt({nu}))"
    area = _simpson(top, f"power(cos({top} * i / {STEPS}.0), {nu} - 1)")
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({nu} + 1) / 2.0) - lgamma({nu} / 2.0)) / sqrt(pi()) * {area})"


def rho_p(rho: str, n: str) -> str:
    """Two-sided p of a rank correlation."""
    t = f"({rho} * sqrt(({n} - 2) / (1 - {rho} * {rho})))"
    return f"CASE WHEN abs({rho}) >= 1 THEN 0.0 ELSE {student_two_sided(t, f'({n} - 2)')} END"


def step_up(p: str, source: str) -> str:
    """Subquery: ``source`` with BH q of ``p`` as ``q``; null stays null and is not counted."""
    return (
        f"(SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1.0, min(s) OVER (ORDER BY {p} DESC NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q "
        f"FROM (SELECT *, {p} * count({p}) OVER () / count({p}) OVER (ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM {source}) a)"
    )
