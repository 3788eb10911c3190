"""The pages' loaders and the joins of users with other tables, over stored tables.

``stored_<query>`` writes the tables that the query reads, bucketed by state, and runs the
registered query over them: same result, same oracle. Aggregates and joins by state find their
rows in the same bucket and need no exchange.
"""

from __future__ import annotations

from qtrlens.plans import catalog_insurance, catalog_txn, catalog_users  # noqa: F401  their entries are used below
from qtrlens.plans.registry import _ENTRIES, register

STORED = {
    "transaction_key_totals": ["aggregated_transaction"],
    "user_rows": ["aggregated_user"],
    "insurance_key_totals": ["aggregated_insurance"],
    "top_states_all": ["top_transaction"],
    "insurance_penetration_sql": ["aggregated_insurance", "aggregated_user"],
    "insurance_penetration_recent": ["aggregated_insurance", "aggregated_user"],
    "penetration_dedup": ["aggregated_insurance", "aggregated_user"],
    "revenue_per_user": ["aggregated_transaction", "aggregated_user"],
}


def _register_stored(name: str, tables: list[str]) -> None:
    entry = _ENTRIES[name]

    @register(f"stored_{name}", entry.sql)
    def _q(t, _entry=entry, _tables=tables):
        return _entry.on(t.bucketed(_tables))


for _name, _tables in STORED.items():
    _register_stored(_name, _tables)
