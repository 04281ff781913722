"""Column-expression helpers (JVM-side, codegen friendly).

All helpers return ``Column`` objects so they compose into a single
projection; none of them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels and keyword lists).
# ---------------------------------------------------------------------------
TOTAL_LABEL = "【总计】"
SIGN_UP, SIGN_DOWN, SIGN_FLAT = "up", "down", "flat"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio_pct(num, den) -> Column:
    """``num/den*100`` when ``den != 0`` else 0.0 (ANSI-safe, no /0)."""
    num, den = col_(num), col_(den)
    return F.when(den != 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))


def safe_div(num, den) -> Column:
    """``num/den`` or NULL when the denominator is 0 or NULL."""
    num, den = col_(num), col_(den)
    return num / F.nullif(den, F.lit(0))


def sign_class(x) -> Column:
    """Rise / fall / flat class of a signed change."""
    x = col_(x)
    return (
        F.when(x > 0, F.lit(SIGN_UP)).when(x < 0, F.lit(SIGN_DOWN)).otherwise(F.lit(SIGN_FLAT))
    )


def smart_format(x) -> Column:
    """Display format: NULL → '-', |x| ≥ 100 → thousands separators and no
    decimals, else two decimals.  ``format_number`` rounds half-even on the
    binary value, the same way Python's format does."""
    x = col_(x).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("-"))
        .when(F.abs(x) >= 100, F.format_number(x, 0))
        .otherwise(F.regexp_replace(F.format_number(x, 2), ",", ""))
    )


def pct_format(x) -> Column:
    """``{:.2f}%``."""
    return F.concat(F.regexp_replace(F.format_number(col_(x), 2), ",", ""), F.lit("%"))


def pp_format(x) -> Column:
    """``{:.2f}pp``."""
    return F.concat(F.regexp_replace(F.format_number(col_(x), 2), ",", ""), F.lit("pp"))


def signed_format(x) -> Column:
    """``{:+,.2f}``."""
    x = col_(x)
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), F.format_number(x, 2))


def as_ntz(c) -> Column:
    return col_(c).cast("timestamp_ntz")


def day_of(c) -> Column:
    """Calendar day of a timestamp/date column, as ``date``."""
    return F.to_date(col_(c))


def period_label(c, unit: str) -> Column:
    """Period label of a date: day → the timestamp itself; week → the
    ``Mon/Sun`` range string (``2024-01-01/2024-01-07``); month → ``yyyy-MM``;
    year → ``yyyy``."""
    c = col_(c)
    if unit == "day":
        return c
    if unit == "week":
        monday = F.to_date(F.date_trunc("week", c))
        return F.concat(
            F.date_format(monday, "yyyy-MM-dd"),
            F.lit("/"),
            F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"),
        )
    if unit == "month":
        return F.date_format(c, "yyyy-MM")
    if unit == "year":
        return F.date_format(c, "yyyy")
    raise ValueError(f"unknown period unit {unit!r}")


def sample_skewness(x, n) -> Column:
    """Bias-adjusted skewness G1 from Spark's population ``skewness``.

    Constant column → 0; fewer than 3 values → NULL."""
    g1 = F.skewness(col_(x))
    n = col_(n).cast("double")
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).otherwise(F.coalesce(adj, F.lit(0.0)))


def sample_kurtosis(x, n) -> Column:
    """Bias-adjusted excess kurtosis G2 from Spark's population ``kurtosis``.

    Constant column → 0; fewer than 4 values → NULL."""
    g2 = F.kurtosis(col_(x))
    n = col_(n).cast("double")
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, F.lit(None).cast("double")).otherwise(F.coalesce(adj, F.lit(0.0)))


def guarded_corr(a, b) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL for a constant
    column instead of an ANSI divide-by-zero error."""
    a, b = col_(a).cast("double"), col_(b).cast("double")
    a_ok = F.when(b.isNotNull(), a)
    b_ok = F.when(a.isNotNull(), b)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a_ok) * F.stddev_pop(b_ok), F.lit(0.0))


def sig_round(x, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits, half up.

    Used by the comparison harness so that floating sums from different
    summation orders hash equal.  Only IEEE operations with exactly
    representable powers of ten are used (``floor(x·10^k + 0.5) / 10^k``),
    so Spark and the SQL twin emitted by :func:`sig_round_sql` produce the
    same bits for the same input.  Kept deliberately small (one log10, one
    pow) so it does not bloat generated code; NULL propagates, NaN/±Inf and
    0 pass through."""
    x = col_(x).cast("double")
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    p = F.pow(F.lit(10.0), F.abs(k))
    r = F.when(k >= 0, F.floor(x * p + 0.5) / p).otherwise(F.floor(x / p + 0.5) * p)
    return F.when((x == 0) | F.isnan(x - x), x).otherwise(r)


def sig_round_sql(expr: str, digits: int = 9) -> str:
    k = f"({digits - 1} - floor(log10(abs({expr}))))"
    p = f"pow(10.0, abs{k})"
    return (
        f"(CASE WHEN ({expr}) IS NULL OR ({expr}) = 0 OR isnan(({expr}) - ({expr})) "
        f"THEN ({expr})::DOUBLE WHEN {k} >= 0 "
        f"THEN floor(({expr}) * {p} + 0.5) / {p} "
        f"ELSE floor(({expr}) / {p} + 0.5) * {p} END)"
    )
