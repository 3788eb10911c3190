"""Scalar column helpers (all native Catalyst expressions, no Python UDF).

Conventions that keep results stable across engines and runs:
* ratios divide doubles once, guarded with ``nullif(den, 0)`` (ANSI mode raises on /0);
* rounding is half-up (``F.round``), as in SQL;
* NULL stays NULL through ``floor1`` (pandas ``clip(lower=1)`` semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: ColumnOrName) -> Column:
    return col(c).cast("double")


def nullif0(c: ColumnOrName) -> Column:
    return F.nullif(dbl(c), F.lit(0.0))


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den as double; NULL when den is 0 or NULL."""
    return dbl(num) / nullif0(den)


def pct_growth(cur: ColumnOrName, prev: ColumnOrName) -> Column:
    """(cur - prev) / prev * 100, NULL on a missing or zero base."""
    return (dbl(cur) - dbl(prev)) / nullif0(prev) * F.lit(100.0)


def pct_growth_floor1(cur: ColumnOrName, prev: ColumnOrName) -> Column:
    """Growth with the base clipped at 1 (dashboard form); NULL base stays NULL."""
    return (dbl(cur) - dbl(prev)) / dbl(floor1(prev)) * F.lit(100.0)


def pct_change(cur: ColumnOrName, prev: ColumnOrName) -> Column:
    """pandas ``pct_change() * 100``: (cur / prev - 1) * 100."""
    return (dbl(cur) / nullif0(prev) - F.lit(1.0)) * F.lit(100.0)


def share_pct(part: ColumnOrName, total: ColumnOrName) -> Column:
    """100 * part / total."""
    return F.lit(100.0) * dbl(part) / nullif0(total)


def floor1(c: ColumnOrName) -> Column:
    """max(x, 1) that keeps NULL (``greatest`` alone would turn NULL into 1)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(1)))


def zscore(x: ColumnOrName, mean: ColumnOrName, std: ColumnOrName) -> Column:
    return (dbl(x) - dbl(mean)) / nullif0(std)


def diff_from_mean_pct(x: ColumnOrName, mean: ColumnOrName) -> Column:
    return (dbl(x) - dbl(mean)) / nullif0(mean) * F.lit(100.0)


def period(year: ColumnOrName = "year", quarter: ColumnOrName = "quarter") -> Column:
    """Sortable period label ``"2020 Q1"``."""
    return F.concat_ws(" Q", col(year).cast("string"), col(quarter).cast("string"))


def ordinal(year: ColumnOrName = "year", quarter: ColumnOrName = "quarter") -> Column:
    """Consecutive quarter number, for calendar-gap tests and period ranges."""
    return col(year).cast("int") * F.lit(4) + col(quarter).cast("int")


# ---- units and display formats ---------------------------------------------------

def crore(c: ColumnOrName) -> Column:
    return dbl(c) / F.lit(1e7)


def lakh(c: ColumnOrName) -> Column:
    return dbl(c) / F.lit(1e5)


def million(c: ColumnOrName) -> Column:
    return dbl(c) / F.lit(1e6)


def thousand(c: ColumnOrName) -> Column:
    return dbl(c) / F.lit(1e3)


def fmt_crore(c: ColumnOrName, digits: int = 2) -> Column:
    """Rupee crore label, e.g. ``₹12.34 Cr``."""
    return F.format_string(f"₹%.{digits}f Cr", crore(c))


def fmt_lakh(c: ColumnOrName) -> Column:
    return F.format_string("%.2f L", lakh(c))


def fmt_million(c: ColumnOrName) -> Column:
    return F.format_string("%.2fM", million(c))


def fmt_rupees(c: ColumnOrName) -> Column:
    """Whole rupees with thousands separators, e.g. ``₹1,234``."""
    return F.concat(F.lit("₹"), F.format_number(dbl(c), 0))


def slug_to_title(c: ColumnOrName) -> Column:
    """Directory slug to display name: ``andaman-&-nicobar`` -> ``Andaman & Nicobar``."""
    return F.initcap(F.regexp_replace(col(c), "-", " "))


def first_word(c: ColumnOrName) -> Column:
    return F.split_part(col(c), F.lit(" "), F.lit(1))


# ---- banding -----------------------------------------------------------------------

def band_at_least(x: ColumnOrName, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """``CASE WHEN x >= c1 THEN l1 WHEN x >= c2 ... ELSE otherwise`` (NULL -> otherwise)."""
    x = dbl(x)
    expr = None
    for cut, label in cuts:
        cond = x >= F.lit(float(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def band_right_closed(x: ColumnOrName, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """pandas ``cut(x, bins=edges, labels=labels)``: intervals (e_i, e_{i+1}]; outside -> NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    x = dbl(x)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def sign_flag(x: ColumnOrName, non_negative: str = "above", negative: str = "below") -> Column:
    x = col(x)
    return F.when(x >= 0, F.lit(non_negative)).when(x < 0, F.lit(negative))
