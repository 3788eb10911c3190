"""Ingest operators on small hand-made JSON trees (FIXTURES.md §B cases)."""

import json
import os
from decimal import Decimal

import pytest

from qtrlens.sources import ingest
from qtrlens import sinks


def _put(root, tier_kind, slug, year, q, payload):
    d = os.path.join(root, "data", tier_kind, "country", "india", "state", slug, str(year))
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{q}.json"), "w") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload))


@pytest.fixture()
def tree(tmpdir_fresh):
    r = tmpdir_fresh
    _put(r, "aggregated/transaction", "andaman-&-nicobar-islands", 2020, 1, {"data": {"transactionData": [
        {"name": "Peer-to-peer payments", "paymentInstruments": [{"type": "TOTAL", "count": 10, "amount": 100.5},
                                                                 {"type": "X", "count": 99, "amount": 9}]},
        {"name": "Recharge & bill payments", "paymentInstruments": []},
        {"name": "Others"}]}})
    _put(r, "aggregated/transaction", "karnataka", 2020, 2, {"data": {"transactionData": None}})
    _put(r, "aggregated/transaction", "karnataka", 2020, 3, "{not json")
    _put(r, "aggregated/user", "karnataka", 2021, 1, {"data": {
        "aggregated": {"registeredUsers": 100, "appOpens": 500},
        "usersByDevice": [{"brand": "Xiaomi", "count": 40, "percentage": 0.4}, {"brand": "Samsung"}]}})
    _put(r, "aggregated/user", "karnataka", 2021, 2, {"data": {
        "aggregated": {"registeredUsers": 120, "appOpens": 0}, "usersByDevice": None}})
    _put(r, "aggregated/insurance", "goa", 2022, 1, {"data": {"transactionData": [
        {"name": "Insurance", "paymentInstruments": [{"count": 3, "amount": 30.129}]}]}})
    _put(r, "aggregated/insurance", "goa", 2022, 2, {"data": {"transactionData": []}})
    _put(r, "map/transaction/hover", "goa", 2022, 1, {"data": {"hoverDataList": [
        {"name": "north goa district", "metric": [{"count": 5, "amount": 50}]},
        {"name": "south goa district", "metric": []}]}})
    _put(r, "map/user/hover", "goa", 2022, 1, {"data": {"hoverData": {
        "north goa district": {"registeredUsers": 7, "appOpens": 70}, "south goa district": None}}})
    _put(r, "map/insurance/hover", "goa", 2022, 1, {"data": {"hoverDataList": None}})
    _put(r, "top/transaction", "goa", 2022, 1, {"data": {
        "districts": [{"entityName": "north goa", "metric": {"count": 1, "amount": 2}}],
        "pincodes": [{"entityName": "403001", "metric": {"count": 3, "amount": 4}}]}})
    _put(r, "top/user", "goa", 2022, 1, {"data": {
        "districts": [{"name": "north goa", "registeredUsers": 9}], "pincodes": None}})
    return r


def shape(schema):
    return [(f.name, f.dataType) for f in schema]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_aggregated_transaction_first_instrument_and_defaults(spark, tree):
    df = ingest.load_table(spark, tree, "aggregated_transaction")
    assert shape(df.schema) == shape(ingest.S.TABLE_SCHEMAS["aggregated_transaction"])
    got = rows(df, "state", "year", "quarter", "transaction_type", "transaction_count", "transaction_amount")
    assert got == [
        ("Andaman & Nicobar Islands", 2020, 1, "Others", 0, Decimal("0.00")),
        ("Andaman & Nicobar Islands", 2020, 1, "Peer-to-peer payments", 10, Decimal("100.50")),
        ("Andaman & Nicobar Islands", 2020, 1, "Recharge & bill payments", 0, Decimal("0.00")),
    ]


def test_corrupt_file_goes_to_quarantine(spark, tree):
    q = ingest.quarantine(spark, tree, "aggregated_transaction").collect()
    assert len(q) == 1 and q[0]["file_path"].endswith("karnataka/2020/3.json")
    assert "not json" in q[0]["raw"]


def test_aggregated_user_repeats_totals_and_skips_null_devices(spark, tree):
    got = rows(ingest.load_table(spark, tree, "aggregated_user"),
               "state", "quarter", "brand", "user_count", "registered_users", "app_opens")
    assert got == [("Karnataka", 1, "Samsung", 0, 100, 500), ("Karnataka", 1, "Xiaomi", 40, 100, 500)]


def test_aggregated_insurance_first_entry_rounded_amount(spark, tree):
    got = rows(ingest.load_table(spark, tree, "aggregated_insurance"), "state", "quarter", "insurance_count",
               "insurance_amount")
    assert got == [("Goa", 1, 3, Decimal("30.13"))]


def test_map_tables(spark, tree):
    assert rows(ingest.load_table(spark, tree, "map_transaction"), "district", "transaction_count") == [
        ("north goa district", 5)]
    assert rows(ingest.load_table(spark, tree, "map_user"), "district", "registered_users", "app_opens") == [
        ("north goa district", 7, 70), ("south goa district", 0, 0)]
    assert ingest.load_table(spark, tree, "map_insurance").count() == 0


def test_top_tables_both_levels(spark, tree):
    got = rows(ingest.load_table(spark, tree, "top_transaction"), "district", "pincode", "transaction_count")
    assert got == sorted([("north goa", None, 1), (None, "403001", 3)], key=repr)
    got = rows(ingest.load_table(spark, tree, "top_user"), "district", "pincode", "registered_users")
    assert got == [("north goa", None, 9)]


def test_missing_tier_gives_empty_table_with_schema(spark, tree):
    df = ingest.load_table(spark, tree, "top_insurance")
    assert df.count() == 0 and shape(df.schema) == shape(ingest.S.TABLE_SCHEMAS["top_insurance"])


def test_write_is_idempotent_and_load_all_reports(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "tables")
    df = ingest.load_table(spark, tree, "aggregated_transaction")
    assert sinks.write_table(df, f"{out}/t1") == 3
    assert sinks.write_table(df, f"{out}/t1") == 3  # re-run replaces, does not append
    assert sinks.read_table(spark, f"{out}/t1", "aggregated_transaction").count() == 3
    rep = {r["table"]: (r["rows"], r["error"]) for r in sinks.load_all(spark, tree, out).collect()}
    assert len(rep) == 9
    assert rep["aggregated_transaction"] == (3, None)
    assert rep["top_insurance"] == (0, None)


def test_incremental_refresh_reads_only_new_files(spark, tree, tmpdir_fresh):
    from qtrlens.streaming.incremental import refresh
    out = os.path.join(tmpdir_fresh, "stream")
    ck = os.path.join(tmpdir_fresh, "ckpt")
    first = refresh(spark, tree, out, ["aggregated_user"], checkpoint_base=ck)
    assert first["aggregated_user"] == 2  # two brand rows
    again = refresh(spark, tree, out, ["aggregated_user"], checkpoint_base=ck)
    assert again["aggregated_user"] == 0  # nothing new
    _put(tree, "aggregated/user", "karnataka", 2021, 3, {"data": {
        "aggregated": {"registeredUsers": 130, "appOpens": 650}, "usersByDevice": [{"brand": "Vivo", "count": 5}]}})
    third = refresh(spark, tree, out, ["aggregated_user"], checkpoint_base=ck)
    assert third["aggregated_user"] == 1
    table = sinks.read_table(spark, f"{out}/aggregated_user", "aggregated_user")
    assert rows(table, "quarter", "brand") == [(1, "Samsung"), (1, "Xiaomi"), (3, "Vivo")]


def test_parallel_load_all_matches_sequential(spark, tree, tmpdir_fresh):
    seq = {r["table"]: (r["rows"], r["error"]) for r in sinks.load_all(spark, tree, f"{tmpdir_fresh}/a").collect()}
    par = {r["table"]: (r["rows"], r["error"])
           for r in sinks.load_all(spark, tree, f"{tmpdir_fresh}/b", parallel=3).collect()}
    assert seq == par and len(par) == 9


def _six_files(root):
    amount = lambda c, a: {"data": {"transactionData": [{"name": "x", "paymentInstruments": [{"count": c, "amount": a}]}]}}
    for q, (c, a) in enumerate([(1, 2.0), (1.0, 2.5), ("x", 1.0), (1, 1e30)], 1):
        _put(root, "aggregated/transaction", "west bengal", 2020, q, amount(c, a))
    _put(root, "aggregated/transaction", "goa", 2020, 1, {"data": None})
    bad = os.path.join(root, "data/aggregated/transaction/country/india/state/goa/2020")
    with open(os.path.join(bad, "2.json"), "w") as f:
        f.write("{oops")


def test_no_file_vanishes_and_escaped_names_are_decoded(spark, tmpdir_fresh):
    root, out = os.path.join(tmpdir_fresh, "tree"), os.path.join(tmpdir_fresh, "out")
    _six_files(root)
    rep = {r["table"]: r for r in sinks.load_all(spark, root, out).collect()}["aggregated_transaction"]
    table = sinks.read_table(spark, f"{out}/aggregated_transaction", "aggregated_transaction")
    assert rows(table, "state", "quarter", "transaction_count") == [("West Bengal", 1, 1), ("West Bengal", 2, 1)]
    kept = ingest.quarantine(spark, root, "aggregated_transaction").count()
    assert rep["files"] == 6 and rep["quarantined"] == kept == 3 and rep["rows"] == 2 and rep["error"] is None
    assert spark.read.parquet(f"{out}/_quarantine/aggregated_transaction").count() == 3


def test_load_and_refresh_share_a_folder(spark, tree, tmpdir_fresh):
    from qtrlens.streaming.incremental import refresh
    out, ck = os.path.join(tmpdir_fresh, "both"), os.path.join(tmpdir_fresh, "both-ckpt")
    cols = ["state", "quarter", "brand", "user_count"]
    seen = []
    for step in range(4):
        if step % 2:
            refresh(spark, tree, out, ["aggregated_user"], checkpoint_base=ck)
        else:
            sinks.load_all(spark, tree, out, ["aggregated_user"])
        seen.append(rows(sinks.read_table(spark, f"{out}/aggregated_user", "aggregated_user"), *cols))
    assert all(s == rows(ingest.load_table(spark, tree, "aggregated_user"), *cols) for s in seen)


def test_map_user_payloads_refuse_a_null_district(spark):
    from qtrlens.sources.payloads import round_trip
    cols = "state string, year smallint, quarter int, district string, registered_users bigint, app_opens bigint"
    good = spark.createDataFrame([("Kerala", 2020, 1, "a", 1, 2), ("Kerala", 2020, 1, "b", 3, 4)], cols)
    assert round_trip(good, "map_user").count() == 2
    with pytest.raises(Exception, match="null district"):
        round_trip(good.unionAll(spark.createDataFrame([("Kerala", 2020, 1, None, 5, 6)], cols)), "map_user").collect()
