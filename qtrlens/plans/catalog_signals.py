"""Registered segment, anomaly and findings queries and their oracle SQL."""

from __future__ import annotations

from qtrlens.operators import signals
from qtrlens.plans.registry import register
from qtrlens.plans.sqlx import crore, dedup_users, growth, lakh, ratio, sc, share, sm

T1, T2, T3 = "aggregated_transaction", "aggregated_user", "aggregated_insurance"

# The page's segments and what it recommends for each.
_L = ["🥇 High Value & High Volume", "💎 High Value", "📦 High Volume", "🌱 Growth Potential"]
_ADVICE = ["Retain with loyalty programs, premium features & exclusive offers.",
           "Increase frequency with cashback incentives & payment reminders.",
           "Upsell financial services; promote high-value transaction categories.",
           "Drive awareness campaigns; offer referral bonuses to grow base."]
_SEG_SQL = f"""
with s as (select state, {sm('transaction_amount')} as total_amount, {sc('transaction_count')} as total_count,
             {ratio('sum(transaction_amount)', 'count(transaction_amount)')} as mean_row_amount from {T1} group by state),
q as (select quantile_cont(cast(total_amount as double), 0.66) as qa, quantile_cont(cast(total_count as double), 0.66) as qc from s),
seg as (select state, total_amount, total_count, mean_row_amount, {crore('total_amount')} as amount_cr,
          {lakh('total_count')} as count_l,
          case when cast(total_amount as double) >= qa and cast(total_count as double) >= qc then '{_L[0]}'
               when cast(total_amount as double) >= qa then '{_L[1]}'
               when cast(total_count as double) >= qc then '{_L[2]}' else '{_L[3]}' end as segment
        from s, q)"""


@register("state_segments_quantile", _SEG_SQL + "\nselect * from seg order by total_amount desc")
def _q(t):
    return signals.state_segments_quantile(t.aggregated_transaction)


_RECS = " union all ".join(f"select '{k}' as segment, '{v}' as recommendation"
                           for k, v in zip(_L, _ADVICE))


@register("segment_counts", _SEG_SQL + f""",
recs as ({_RECS})
select c.segment, c.states, r.recommendation from
  (select segment, cast(count(*) as bigint) as states from seg group by segment) c left join recs r on c.segment = r.segment""")
def _q(t):
    return signals.segment_counts(t.aggregated_transaction)


def _anomaly_sql(keys: str) -> str:
    return f"""
with s as (select {keys}, {sc('transaction_count')} as "count", {sm('transaction_amount')} as amount from {T1} group by {keys}),
s2 as (select *, {ratio('amount', '"count"')} as avg_txn from s),
g as (select avg(avg_txn) as m, stddev_samp(avg_txn) as sd from s2),
a as (select {keys}, "count", amount, avg_txn, round((avg_txn - m) / nullif(sd, 0), 2) as z_score,
        coalesce(abs((avg_txn - m) / nullif(sd, 0)) > 2, false) as is_anomaly from s2, g)"""


@register("anomaly_flags", _anomaly_sql("state") + "\nselect * from a")
def _q(t):
    return signals.anomaly_flags(t.aggregated_transaction)


@register("anomaly_flags_state_quarter", _anomaly_sql("state, year, quarter") + "\nselect * from a")
def _q(t):
    return signals.anomaly_flags(t.aggregated_transaction, grain="state_quarter")


@register("ticket_histogram", _anomaly_sql("state") + """,
m as (select min(avg_txn) as lo, max(avg_txn) as hi from a),
h as (select a.*, lo, (hi - lo) / 10.0::double as w from a, m where avg_txn is not null),
b as (select *, case when w > 0 then cast(least(floor((avg_txn - lo) / w), 9) as int) else 0 end as bin from h)
select bin, is_anomaly, cast(count(*) as bigint) as states, lo + bin * w as bin_start
from b group by bin, is_anomaly, lo, w""")
def _q(t):
    return signals.ticket_histogram(t.aggregated_transaction, 10)


@register("flagged_states", _anomaly_sql("state") + """
select state, avg_txn, z_score, "count" as txn_count, amount as total_amount from a where is_anomaly""")
def _q(t):
    return signals.flagged_states(t.aggregated_transaction)


@register("flagged_state_quarters", _anomaly_sql("state, year, quarter") + """
select state, year, quarter, avg_txn, z_score, "count" as txn_count, amount as total_amount from a where is_anomaly""")
def _q(t):
    return signals.flagged_states(t.aggregated_transaction, grain="state_quarter")


@register("topk_share", f"""
with s as (select state, {sm('transaction_amount')} as amount from {T1} group by state),
r as (select state, cast(row_number() over (order by amount desc, state) as int) as "rank", amount,
        sum(amount) over () as total from s),
c as (select *, sum(amount) over (order by "rank" rows between unbounded preceding and current row) as cum from r)
select state, "rank", amount, round({share('amount', 'total')}, 2) as share_pct,
  round({share('cum', 'total')}, 2) as cum_share_pct from c where "rank" <= 3""")
def _q(t):
    return signals.topk_share(t.aggregated_transaction, k=3)


@register("topk_brand_share", f"""
with s as (select brand, {sc('user_count')} as amount from {T2} where brand is not null group by brand),
w as (select sum(amount) as total from s),
top as (select brand, amount, cast(rank() over (order by amount desc, brand) as int) as "rank" from s qualify "rank" <= 2)
select a.brand, a."rank", a.amount, round({share('a.amount', 'any_value(w.total)')}, 2) as share_pct,
  round({share('sum(b.amount)', 'any_value(w.total)')}, 2) as cum_share_pct
from top a join top b on b."rank" <= a."rank", w group by a.brand, a."rank", a.amount""")
def _q(t):
    return signals.topk_share(t.aggregated_user.where("brand is not null"), key="brand", value="user_count", k=2)


@register("seasonality", f"""
with q as (select year, quarter, {sm('transaction_amount')} as amount from {T1} group by year, quarter),
s as (select *, cast(round({share('amount', 'sum(amount) over (partition by year)')}, 4) as decimal(10,4)) as sh from q)
select quarter, round({ratio('sum(sh)', 'count(sh)')}, 2) as mean_share_pct, cast(count(*) as bigint) as years
from s group by quarter""")
def _q(t):
    return signals.seasonality(t.aggregated_transaction)


@register("fastest_category", f"""
with quarterly as (select year, quarter, transaction_type, {sm('transaction_amount')} as total_amount
                   from {T1} group by year, quarter, transaction_type),
l as (select *, round({growth('total_amount', 'lag(total_amount) over (partition by transaction_type order by year, quarter)')}, 2) as g
      from quarterly),
m as (select transaction_type, round({ratio('sum(cast(g as decimal(20,2)))', 'count(g)')}, 2) as mean_qoq_pct
      from l group by transaction_type)
select * from m order by mean_qoq_pct desc nulls last, transaction_type limit 1""")
def _q(t):
    return signals.fastest_category(t.aggregated_transaction)


@register("ticket_leader", f"""
with c as (select transaction_type, {sm('transaction_amount')} as amount, {sc('transaction_count')} as "count"
           from {T1} group by transaction_type)
select *, round({ratio('amount', '"count"')}, 2) as avg_ticket from c
order by avg_ticket desc nulls last, transaction_type limit 1""")
def _q(t):
    return signals.ticket_leader(t.aggregated_transaction)


_COLS = ["amount", '"count"', "registered_users", "policies"]


@register("kpi_delta", f"""
with a as (select year, {sm('transaction_amount')} as amount, {sc('transaction_count')} as "count" from {T1} group by year),
u as (select year, {sc('registered_users')} as registered_users from {dedup_users(T2)} d group by year),
p as (select year, {sc('insurance_count')} as policies from {T3} group by year),
y as (select year from a union select year from u union select year from p),
j as (select y.year, a.amount, a."count", u.registered_users, p.policies from y
      left join a on y.year = a.year left join u on y.year = u.year left join p on y.year = p.year)
select year, amount, "count", registered_users, policies,
  {", ".join(f"round({growth(c, f'lag({c}) over (order by year)')}, 1) as {c.strip(chr(34))}_yoy_pct" for c in _COLS)}
from j""")
def _q(t):
    return signals.kpi_delta(t.aggregated_transaction, t.once().user_totals, t.once().aggregated_insurance)
