"""The portable draws of the bootstrap, written out in SQL."""

from __future__ import annotations

from spendlens.functions import draws


def word(key: str, n: int) -> str:
    return f"CAST('0x' || substr(md5({key}), {1 + 8 * n}, 8) AS BIGINT)"


def key_text(*columns: str) -> str:
    """The text of several columns: each as its length, a colon and itself; null as a dash."""
    one = "coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return " || ".join(one.format(c=c) for c in columns)


def mix(x: str) -> str:
    def fold(v):
        return f"xor({v}, {v} >> 16)"

    start = f"(({x}) & {draws.MASK})"
    for _ in range(2):
        start = f"(({fold(start)} * {draws.MIX}) & {draws.MASK})"
    return fold(start)


def poisson(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {s} THEN 1 ELSE 0 END" for s in draws.poisson_ladder()) + ")"


def poisson_ctes(units: str, key: str, n_boot: int, seed: int = 0) -> str:
    """CTEs boot_h, boot_d, boot_u, boot_w over ``units``; ``key`` is the unit's text key."""
    return f"""
boot_h AS (SELECT *, {word(f"'{seed}|' || {key}", 0)} AS h1, {word(f"'{seed}|' || {key}", 1)} AS h2 FROM {units}),
boot_b AS (SELECT *, CAST(unnest(generate_series(1, {n_boot})) AS BIGINT) AS b FROM boot_h),
boot_d AS (SELECT * EXCLUDE (h1), {mix(f"h1 + b * {draws.REPLICATE_STEP}")} AS d FROM boot_b),
boot_u AS (SELECT *, {mix("d + h2")} AS u FROM boot_d),
boot_w AS (SELECT *, {poisson("u")} AS w FROM boot_u)"""


def multinomial_ctes(units: str, stratum: str, unit: str, n_boot: int, seed: int = 0, text: str | None = None) -> str:
    """CTE boot_hit: one row per draw with the drawn unit's C and S; ``text`` names a stratum."""
    text = text or key_text(stratum)
    return f"""
boot_i AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {word(key_text(unit), 0)}, {unit} NULLS FIRST) - 1 AS i,
    count(*) OVER (PARTITION BY {stratum}) AS k, {word(f"'{seed}|' || {text}", 0)} AS h FROM {units}),
boot_b AS (SELECT {stratum} AS st, i, k, h, CAST(unnest(generate_series(1, {n_boot})) AS BIGINT) AS b FROM boot_i),
boot_d AS (SELECT *, {mix(f"h + b * {draws.REPLICATE_STEP}")} AS d FROM boot_b),
boot_u AS (SELECT st, b, {mix(f"d + i * {draws.INDEX_STEP}")} % k AS j FROM boot_d),
boot_hit AS (SELECT boot_u.st, boot_u.b, boot_i.C, boot_i.S FROM boot_u JOIN boot_i ON boot_i.{stratum} = boot_u.st AND boot_i.i = boot_u.j)"""
