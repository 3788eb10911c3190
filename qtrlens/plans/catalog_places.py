"""Registered queries at the grain of single pincodes, and their oracle SQL."""

from __future__ import annotations

from qtrlens.operators import places
from qtrlens.plans.registry import register
from qtrlens.plans.sqlx import crore, d, diff_mean, ratio, sc, share, sm

PINCODES = (f"(select state, pincode, {sm('transaction_amount')} as total_amount, {sc('transaction_count')} as total_count "
            "from top_transaction where pincode is not null group by state, pincode)")


def _rows(t):
    return t.top_level("top_transaction", "pincode")


@register("pincode_segments", f"""
with p as {PINCODES},
cut as (select quantile_cont({d('total_amount')}, 0.66) as amount, quantile_cont({d('total_count')}, 0.66) as n from p)
select state, pincode, total_amount, total_count,
  ['🌱 Growth Potential', '📦 High Volume', '💎 High Value', '🥇 High Value & High Volume']
    [1 + 2 * ({d('total_amount')} >= cut.amount)::int + ({d('total_count')} >= cut.n)::int] as segment
from p, cut""")
def _q(t):
    return places.place_segments(_rows(t))


@register("pincode_rankings", f"""
select row_number() over (order by total_amount desc, state, pincode) as rank, state, pincode, round({crore('total_amount')}, 2) as value
from {PINCODES} p""")
def _q(t):
    return places.place_ranking(_rows(t))


@register("pincode_percent_ranks", f"""
with c as (select total_count, count(*) as n from {PINCODES} p group by total_count),
r as (select total_count, n, sum(n) over (order by total_count) - n as before, sum(n) over () as total from c)
select state, pincode, p.total_count as txn_count,
  round(({d('before')} + ({d('n')} + 1.0::double) / 2.0::double) / {d('total')}, 6) as pct_rank
from {PINCODES} p join r on p.total_count = r.total_count""")
def _q(t):
    return places.place_percent_ranks(_rows(t))


@register("pincode_shares", f"""
with p as {PINCODES},
a as (select sum(total_amount) as total, max(total_amount) as largest, count(*) as n from p),
s as (select *, round({diff_mean('total_amount', '(' + ratio('total', 'n') + ')')}, 2) as away from p, a)
select state, pincode, total_amount, round({share('total_amount', 'total')}, 6) as share_pct,
  round({ratio('total_amount', 'largest')}, 6) as of_largest, away as diff_from_mean_pct,
  case when away >= 0 then 'above' when away < 0 then 'below' end as flag
from s""")
def _q(t):
    return places.place_shares(_rows(t))
