"""Registered insurance queries (T3 with T2) and their oracle SQL."""

from __future__ import annotations

from qtrlens.operators import insurance as ins
from qtrlens.plans.registry import register
from qtrlens.plans.sqlx import floor1, crore, dedup_users, growth, pct_change, period, ratio, sc, share, sm

T2, T3 = "aggregated_user", "aggregated_insurance"
USERS_ROWS = f"(select state, {sc('registered_users')} as total_users from {T2} group by state)"
DEDUP = dedup_users(T2)


@register("insurance_penetration_sql", f"""
from (select state, {sc('insurance_count')} as total_policies, {sm('insurance_amount')} as total_premium from {T3} group by all)
left join {USERS_ROWS} using (state)
select state, total_policies, total_premium, round({ratio('total_premium', 'total_policies')}, 2) as avg_premium,
  round({share('total_policies', 'total_users')}, 4) as penetration_rate""")
def _q(t):
    return ins.insurance_penetration_sql(t.once().aggregated_insurance, t.once().aggregated_user)


@register("insurance_key_totals", f"""
select state, year, quarter, {sc('insurance_count')} as insurance_count, cast(sum(insurance_amount) as decimal(20,2)) as insurance_amount
from {T3} group by all""")
def _q(t):
    from qtrlens.sinks import natural_key_totals
    return natural_key_totals(t.aggregated_insurance, "aggregated_insurance")


@register("insurance_quarterly", f"""
select year, quarter, {sc('insurance_count')} as total_policies, {sm('insurance_amount')} as total_premium,
  round({ratio('sum(insurance_amount)', 'sum(insurance_count)')}, 2) as avg_premium
from {T3} group by year, quarter order by year, quarter""")
def _q(t):
    return ins.insurance_quarterly(t.aggregated_insurance)


@register("insurance_penetration", f"""
from (select state, {sc('insurance_count')} as total_policies, {sm('insurance_amount')} as total_premium from {T3} group by state) p
left join (select state, {sc('registered_users')} as total_reg_users from {T2} group by state) u using (state)
select state, total_policies, total_premium, round({ratio('total_premium', 'total_policies')}, 0) as avg_premium_per_policy, total_reg_users,
  round({share('total_policies', 'total_reg_users')}, 4) as penetration_pct""")
def _q(t):
    return ins.insurance_penetration(t.once().aggregated_insurance, t.once().aggregated_user)


@register("insurance_growth_yoy", f"""
with y as (select year, {sc('insurance_count')} as policies, {sm('insurance_amount')} as premium, row_number() over (order by year) as nth from {T3} group by year)
select this.year, this.policies, this.premium, past.policies as prev_policies,
  round({growth('this.policies', 'past.policies')}, 2) as yoy_policy_growth, round({growth('this.premium', 'past.premium')}, 2) as yoy_premium_growth
from y this left join y past on past.nth + 1 = this.nth""")
def _q(t):
    return ins.insurance_growth_yoy(t.aggregated_insurance)


@register("insurance_opportunity", f"""
with p as (select state, {sc('insurance_count')} as policies from {T3} group by state),
u as (select state, {sc('registered_users')} as total_users from {T2} group by state),
r as (select state, policies, total_users, round({share('policies', 'total_users')}, 4) as penetration_pct from p left join u using (state)),
s as (select r.*, round({ratio('total_users', '(select max(total_users) from r)')} - {ratio('penetration_pct', '(select max(penetration_pct) from r)')}, 3)
        as opportunity_score from r)
select s.*, ['Low', 'Medium', 'High', 'Critical'][1 + coalesce((opportunity_score >= 0)::int + (opportunity_score >= 0.1::double)::int
  + (opportunity_score >= 0.3::double)::int, 0)] || ' Priority' as campaign_priority from s""")
def _q(t):
    return ins.insurance_opportunity(t.once().aggregated_insurance, t.once().aggregated_user)


@register("insurance_qoq", f"""
select year, quarter, {sc('insurance_count')} as policies, {sm('insurance_amount')} as premium,
  lag({sc('insurance_count')}) over (order by year, quarter) as prev_policies,
  round({growth(sc('insurance_count'), f"lag({sc('insurance_count')}) over (order by year, quarter)")}, 2) as qoq_growth_pct
from {T3} group by year, quarter order by year, quarter""")
def _q(t):
    return ins.insurance_qoq(t.aggregated_insurance)


@register("kpi_insurance", f"""
with s as (select state, sum(insurance_count) as p from {T3} where state is not null group by state),
k as (select (select {sc('insurance_count')} from {T3}) as total_policies,
             (select {sm('insurance_amount')} from {T3}) as total_premium,
             (select state from s where p is not null order by p asc, state limit 1) as lowest_state)
select *, cast(total_premium as double) / cast({floor1('total_policies')} as double) as avg_premium,
  cast(total_policies as double) / 1e3 as policies_k, {crore('total_premium')} as premium_cr from k""")
def _q(t):
    return ins.kpi_insurance(t.aggregated_insurance)


_PEN_DEDUP = f"""
with i as (select state, {sc('insurance_count')} as "count", {sm('insurance_amount')} as amount from {T3} group by state),
r as (select state, {sc('registered_users')} as registered_users from {DEDUP} d group by state),
p as (select i.state, "count", amount, registered_users,
        round(cast("count" as double) / cast({floor1('registered_users')} as double) * 100.0::double, 3) as penetration_pct,
        cast(amount as double) / cast({floor1('"count"')} as double) as avg_premium
      from i left join r on i.state = r.state)"""


@register("penetration_dedup", _PEN_DEDUP + f"""
select *, {ratio('sum(cast(penetration_pct as decimal(20,3))) over ()', 'count(penetration_pct) over ()')}
  as mean_penetration_pct from p""")
def _q(t):
    return ins.penetration_dedup(t.once().aggregated_insurance, t.once().user_totals)


@register("insurance_period", f"""
select year, quarter, {sc('insurance_count')} as "count", {sm('insurance_amount')} as amount, {period()} as period,
  {crore(sm('insurance_amount'))} as amount_cr from {T3} group by year, quarter""")
def _q(t):
    return ins.insurance_period(t.aggregated_insurance)


@register("insurance_yoy", f"""
with y as (select year, {sc('insurance_count')} as "count" from {T3} group by year),
g as (select year, "count", {pct_change('"count"', 'lag("count") over (order by year)')} as yoy_growth from y)
select * from g where yoy_growth is not null""")
def _q(t):
    return ins.insurance_yoy(t.aggregated_insurance)


_OPP_CUT = _PEN_DEDUP + f""",
o as (select state, registered_users, penetration_pct,
        round({ratio('registered_users', 'max(registered_users) over ()')}
              - {ratio('penetration_pct', 'max(penetration_pct) over ()')}, 3) as opportunity_score from p),
c as (select *, case when opportunity_score > -2.0::double and opportunity_score <= -0.1::double then 'Low'
                     when opportunity_score > -0.1::double and opportunity_score <= 0.1::double then 'Medium'
                     when opportunity_score > 0.1::double and opportunity_score <= 0.3::double then 'High'
                     when opportunity_score > 0.3::double and opportunity_score <= 1.0::double then 'Critical'
                end as priority from o)"""


@register("opportunity_cut", _OPP_CUT + "\nselect * from c")
def _q(t):
    return ins.opportunity_cut(t.once().aggregated_insurance, t.once().user_totals)


@register("opportunity_rollup", _OPP_CUT + f"""
select priority, state, {sc('registered_users')} as users,
  cast(grouping(priority, state) as int) as level,
  round({ratio('sum(cast(opportunity_score as double) * cast(registered_users as double))', 'sum(registered_users)')}, 3) as score
from c where priority is not null group by rollup (priority, state)""")
def _q(t):
    return ins.opportunity_rollup(t.once().aggregated_insurance, t.once().user_totals)


@register("opportunity_top5", _OPP_CUT + "\nselect * from c order by opportunity_score desc nulls last, state limit 5")
def _q(t):
    return ins.opportunity_top(t.once().aggregated_insurance, t.once().user_totals, 5)


@register("insurance_by_state", f"""
select state, {sc('insurance_count')} as "count", {sm('insurance_amount')} as amount,
  {crore(sm('insurance_amount'))} as amount_cr from {T3} group by state""")
def _q(t):
    return ins.insurance_by_state(t.aggregated_insurance)


@register("national_penetration", f"""
with k as (select (select {sc('insurance_count')} from {T3}) as policies,
                  (select {sc('registered_users')} from {DEDUP} d) as registered_users)
select *, round({share('policies', 'registered_users')}, 4) as penetration_pct from k""")
def _q(t):
    return ins.national_penetration(t.once().aggregated_insurance, t.once().user_totals)


@register("insurance_penetration_recent", f"""
from (select state, {sc('insurance_count')} as total_policies, {sm('insurance_amount')} as total_premium from {T3} where year >= (select min(y) from (select distinct year as y from {T3} order by y desc limit 2)) group by state) p
left join (select state, {sc('registered_users')} as total_reg_users from {T2} group by state) u using (state)
select state, total_policies, total_premium, round({ratio('total_premium', 'total_policies')}, 0) as avg_premium_per_policy, total_reg_users,
  round({share('total_policies', 'total_reg_users')}, 4) as penetration_pct""")
def _q(t):
    """Page form: the year selection filters insurance only; users stay unfiltered."""
    return ins.insurance_penetration(t.newest(2, t.insurance_years).aggregated_insurance, t.aggregated_user)
