"""Tail probabilities that Spark SQL has no function for.

Arrow UDFs, applied to result frames of one row per segment or feature. The
functions are built inside factories so that they travel to executors by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F


def normal_two_sided():
    """UDF: two-sided p of a standard normal statistic."""

    @F.pandas_udf("double")
    def p_of_z(z):
        import math

        import pandas as pd

        return pd.Series(
            [None if v != v else math.erfc(abs(v) / math.sqrt(2.0)) for v in z.astype(float)],
            dtype="float64",
        )

    return p_of_z


def student_two_sided():
    """UDF: two-sided p of a Student-t statistic with the given degrees of freedom.

    Uses I_x(dof/2, 1/2) with x = dof / (dof + t^2), evaluated by the modified
    Lentz continued fraction for all rows of a batch together.
    """

    @F.pandas_udf("double")
    def p_of_t(t, dof):
        import math

        import numpy as np
        import pandas as pd

        def fraction(a, b, x):
            tiny = 1e-300
            c = np.ones_like(x)
            d = 1.0 - (a + b) * x / (a + 1.0)
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            h = d.copy()
            for m in range(1, 400):
                even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                for coef in (even, odd):
                    d = 1.0 + coef * d
                    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                    c = 1.0 + coef / c
                    c = np.where(np.abs(c) < tiny, tiny, c)
                    h = h * d * c
                if np.all(np.abs(d * c - 1.0) < 1e-15):
                    break
            return h

        tv = t.to_numpy(dtype=float)
        nu = dof.to_numpy(dtype=float)
        ok = np.isfinite(tv) & np.isfinite(nu) & (nu > 0)
        out = np.full(len(tv), np.nan)
        out[np.isinf(tv) & (nu > 0)] = 0.0
        if ok.any():
            a, b = nu[ok] / 2.0, np.full(ok.sum(), 0.5)
            x = nu[ok] / (nu[ok] + tv[ok] ** 2)
            log_beta = np.array(
                [math.lgamma(p) + math.lgamma(0.5) - math.lgamma(p + 0.5) for p in a]
            )
            with np.errstate(divide="ignore", invalid="ignore"):
                front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta)
                direct = x < (a + 1.0) / (a + b + 2.0)
                low = front * fraction(a, b, np.where(direct, x, 0.0)) / a
                high = 1.0 - front * fraction(b, a, np.where(direct, 0.0, 1.0 - x)) / b
            value = np.where(direct, low, high)
            value = np.where(tv[ok] == 0.0, 1.0, value)
            out[ok] = np.clip(value, 0.0, 1.0)
        return pd.Series(out).where(~pd.isna(out), None).astype("float64")

    return p_of_t
