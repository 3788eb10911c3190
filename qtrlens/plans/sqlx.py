"""Small builders for the oracle SQL texts (DuckDB dialect).

They spell out the same arithmetic, in the same order, as the DataFrame helpers in
``qtrlens.functions.expr``, so both engines round identical doubles.
"""

from __future__ import annotations


def d(x: str) -> str:
    return f"cast({x} as double)"


def ratio(a: str, b: str) -> str:
    return f"{d(a)} / nullif({d(b)}, 0)"


def growth(x: str, p: str) -> str:
    return f"({d(x)} - {d(p)}) / nullif({d(p)}, 0) * 100.0::double"


def floor1(x: str) -> str:
    """max(x, 1) keeping NULL (DuckDB's greatest() would skip the NULL and give 1)."""
    return f"(case when {x} is null then null else greatest({x}, 1) end)"


def growth_floor1(x: str, p: str) -> str:
    return f"({d(x)} - {d(p)}) / {d(floor1(p))} * 100.0::double"


def pct_change(x: str, p: str) -> str:
    return f"({d(x)} / nullif({d(p)}, 0) - 1.0::double) * 100.0::double"


def share(x: str, t: str) -> str:
    return f"100.0::double * {d(x)} / nullif({d(t)}, 0)"


def diff_mean(x: str, m: str) -> str:
    return f"({d(x)} - {d(m)}) / nullif({d(m)}, 0) * 100.0::double"


def sm(c: str) -> str:
    return f"cast(sum({c}) as decimal(38,2))"


def sc(c: str) -> str:
    return f"cast(sum({c}) as bigint)"


def mean_total(c: str) -> str:
    return f"{d(f'sum({c})')} / {d(f'count({c})')}"


def period(y: str = "year", q: str = "quarter") -> str:
    return f"concat(cast({y} as varchar), ' Q', cast({q} as varchar))"


def crore(x: str) -> str:
    return f"{d(x)} / 1e7"


def lakh(x: str) -> str:
    return f"{d(x)} / 1e5"


def million(x: str) -> str:
    return f"{d(x)} / 1e6"


def fmt_crore(x: str) -> str:
    return f"printf('₹%.2f Cr', {crore(x)})"


def fmt_million(x: str) -> str:
    return f"printf('%.2fM', {million(x)})"


def fmt_rupees(x: str) -> str:
    return f"'₹' || format('{{:,.0f}}', {d(x)})"


def dedup_users(src: str = "aggregated_user") -> str:
    return (f"(select state, year, quarter, max(registered_users) as registered_users, "
            f"max(app_opens) as app_opens from {src} group by state, year, quarter)")


def half_up_rounds(sql: str) -> str:
    """Make every ``round(x, d)`` of an oracle text round half-up on the shortest
    decimal form of ``x``, as Spark's ``round`` does (DuckDB's double ``round`` works
    on the binary value: 199/40 = 4.975 gives 4.97 there, 4.98 in Spark and in SQL
    on exact decimals). Rewrites ``round(x, d)`` to
    ``cast(round(cast(cast(x as varchar) as decimal(38,20)), d) as double)``.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        inner_x = half_up_rounds(sql[j + 6:comma])
        digits = sql[comma + 1:k].strip()
        out.append(sql[i:j])
        out.append(f"cast(round(cast(cast({inner_x} as varchar) as decimal(38,20)), {digits}) as double)")
        i = k + 1
