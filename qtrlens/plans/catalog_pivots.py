"""Registered matrix (pivot) queries and their oracle SQL (conditional aggregates)."""

from __future__ import annotations

from qtrlens.operators import pivots
from qtrlens.plans.registry import register
from qtrlens.plans.sqlx import crore, growth, growth_floor1, period, sc, sm

# The brands of the driver's tables (part.p_type).
BRANDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _quarters(cell: str) -> str:
    return ", ".join(f"{cell.format(k)} as q{k}" for k in (1, 2, 3, 4))


@register("category_period_matrix", f"""
select transaction_type, year, {_quarters("coalesce(max(v) filter (quarter = {}), 0)")}
from (select transaction_type, year, quarter, {crore(sm('transaction_amount'))} as v from aggregated_transaction group by all)
group by transaction_type, year""")
def _q(t):
    return pivots.category_period_matrix(t.aggregated_transaction)


@register("category_qoq_matrix", f"""
with q as (select transaction_type, year, quarter, {sm('transaction_amount')} as amount from aggregated_transaction group by all),
g as (select *, round({growth('amount', 'lag(amount) over (partition by transaction_type order by year, quarter)')}, 1) as v from q)
select transaction_type, year, {_quarters("max(v) filter (quarter = {})")} from g group by transaction_type, year""")
def _q(t):
    return pivots.category_qoq_matrix(t.aggregated_transaction)


@register("state_brand_matrix", f"""
select state, {", ".join(f"cast(coalesce(sum(user_count) filter (brand = '{b}'), 0) as bigint) as \"{b}\"" for b in BRANDS)}
from aggregated_user where brand is not null group by state""")
def _q(t):
    return pivots.state_brand_matrix(t.aggregated_user, BRANDS)


@register("state_period_matrix", f"""
select state, year, {_quarters("coalesce(max(v) filter (quarter = {}), 0)")}
from (select state, year, quarter, {crore(sm('transaction_amount'))} as v from map_transaction group by all)
group by state, year""")
def _q(t):
    return pivots.state_period_matrix(t.map_transaction)


@register("reg_growth_matrix", f"""
with q as (select state, year, quarter, {sc('registered_users')} as n from top_user group by state, year, quarter),
g as (select state, year, quarter, round({growth_floor1('n', 'lag(n) over (partition by state order by year, quarter)')}, 1) as v from q)
select state, year, {_quarters("coalesce(avg(v) filter (quarter = {}), 0)")} from g group by state, year""")
def _q(t):
    return pivots.reg_growth_matrix(t.top_user)


def _cells_sql(index: str, cells: str, fill: str) -> str:
    """Text of an open matrix: every row has all periods; ``cells`` gives (index, period, v)."""
    shown = "case when v is null then '-' else printf('%.2f', round(v, 2)) end"
    return f"""
with cells as ({cells}),
grid as (select i.{index}, p.period from (select distinct {index} from cells) i, (select distinct period from cells) p)
select {index}, count(*) as periods, string_agg(period || '=' || {shown}, ';' order by period) as cells
from (select {index}, period, coalesce(v, {fill}) as v from grid left join cells using ({index}, period)) group by {index}"""


@register("category_by_period", _cells_sql("transaction_type", f"""
select transaction_type, {period()} as period, {crore(sm('transaction_amount'))} as v from aggregated_transaction group by transaction_type, year, quarter""", "0"))
def _q(t):
    return pivots.cells_text(pivots.category_by_period(t.aggregated_transaction))


@register("category_qoq_by_period", _cells_sql("transaction_type", f"""
select transaction_type, {period()} as period, round({growth('amount', 'lag(amount) over (partition by transaction_type order by year, quarter)')}, 1) as v
from (select transaction_type, year, quarter, {sm('transaction_amount')} as amount from aggregated_transaction group by all)""", "null"))
def _q(t):
    return pivots.cells_text(pivots.category_qoq_by_period(t.aggregated_transaction))


@register("state_by_period", _cells_sql("state", f"""
select state, {period()} as period, {crore(sm('transaction_amount'))} as v from map_transaction group by state, year, quarter""", "0"))
def _q(t):
    return pivots.cells_text(pivots.state_by_period(t.map_transaction))


@register("reg_growth_by_period", _cells_sql("state", f"""
select state, {period()} as period, round({growth_floor1('n', 'lag(n) over (partition by state order by year, quarter)')}, 1) as v
from (select state, year, quarter, {sc('registered_users')} as n from top_user group by all)""", "0"))
def _q(t):
    return pivots.cells_text(pivots.reg_growth_by_period(t.top_user))
