"""The catalog over stored tables: same results as over derived ones, and joins by state in place."""

import pytest

from qtrlens.plans import registry
from qtrlens.sources.fixtures import DerivedTables

SF = "/root/testdata/sf0.001"
WRITES_ITSELF = ("ingest_", "refresh_", "stream_", "stored_", "load_report")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    t = DerivedTables(spark, SF)
    bucketed = t.bucketed()
    yield {"stored": t.materialize(str(tmp_path_factory.mktemp("stored")), parallel=3), "bucketed": bucketed}
    bucketed.drop()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if not n.startswith(WRITES_ITSELF)))
def test_catalog_over_stored_tables(spark, tables, name):
    want = rows(registry.queries()[name](spark, SF))
    assert rows(registry.on_tables(name, tables["stored"])) == want
    if name in ("insurance_penetration", "revenue_per_user", "penetration_dedup", "top_states_all", "pincode_hhi", "txn_category_qoq_recent"):
        assert rows(registry.on_tables(name, tables["bucketed"])) == want


@pytest.mark.parametrize("name", ["insurance_penetration_sql", "insurance_penetration", "insurance_opportunity", "revenue_per_user"])
def test_joins_by_state_need_no_exchange(spark, tables, name):
    text = registry.on_tables(name, tables["bucketed"])._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in text.splitlines() if "Exchange hashpartitioning(state#" in line and "state#" in line.split("hashpartitioning(")[1].split(",")[0]]
    by_state_alone = [line for line in keyed if line.split("hashpartitioning(")[1].split(",")[1].strip().isdigit()]
    assert not by_state_alone, text
    assert "Bucketed: true" in text
