"""Keeping stored tables in step with a tree of files that changes."""

import json
import os
import time

import pytest

from qtrlens import sinks
from qtrlens.sources import ingest, manifest
from qtrlens.streaming.incremental import refresh, stream_table

TABLE = "aggregated_transaction"


def path_of(root, slug, year, name):
    return os.path.join(root, "data/aggregated/transaction/country/india/state", slug, str(year), name)


def put(root, slug, year, name, entries):
    at = path_of(root, slug, year, name)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    text = entries if isinstance(entries, str) else json.dumps({"data": {"transactionData": [
        {"name": n, "paymentInstruments": [{"count": c, "amount": c * 1.5}]} for n, c in entries]}})
    with open(at, "w") as f:
        f.write(text)
    now = time.time() + put.later  # later writes have later times even on coarse clocks
    put.later += 2
    os.utime(at, (now, now))


put.later = 0


def stored(spark, out):
    table = sinks.read_table(spark, f"{out}/{TABLE}", TABLE)
    return sorted((r.state, r.year, r.quarter, r.transaction_type, r.transaction_count) for r in table.collect())


@pytest.fixture()
def tree(tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "tree")
    put(root, "goa", 2020, "1.json", [("a", 1), ("b", 2)])
    put(root, "goa", 2020, "2.json", [("a", 3)])
    put(root, "goa", 2021, "1.json", [("a", 4)])
    put(root, "west-bengal", 2020, "1.json", [("a", 5)])
    put(root, "west-bengal", 2022, "3.json", "{oops")
    return root


def load(spark, root, out):
    return {r.table: r for r in sinks.load_all(spark, root, out, [TABLE]).collect()}[TABLE]


def bring(how, spark, root, out):
    if how == "load":
        return load(spark, root, out).rows
    return refresh(spark, root, out, [TABLE])[TABLE]


@pytest.mark.parametrize("how", ["load", "refresh"])
def test_emptied_changed_removed_and_mended_files(spark, tree, tmpdir_fresh, how):
    out = os.path.join(tmpdir_fresh, "out")
    assert (load(spark, tree, out).files, load(spark, tree, out).quarantined) == (5, 1)
    put(tree, "goa", 2021, "1.json", [])  # the year's only file is emptied
    put(tree, "goa", 2020, "2.json", [("a", 30), ("c", 31)])  # changed under the same path
    os.remove(path_of(tree, "west-bengal", 2020, "1.json"))
    put(tree, "west-bengal", 2022, "3.json", [("z", 9)])  # mended
    bring(how, spark, tree, out)
    want = [("Goa", 2020, 1, "a", 1), ("Goa", 2020, 1, "b", 2), ("Goa", 2020, 2, "a", 30), ("Goa", 2020, 2, "c", 31), ("West Bengal", 2022, 3, "z", 9)]
    assert stored(spark, out) == want
    assert not os.path.exists(f"{out}/{TABLE}/year=2021")
    assert spark.read.parquet(f"{out}/_quarantine/{TABLE}").count() == 0
    fresh = os.path.join(tmpdir_fresh, "fresh")
    load(spark, tree, fresh)
    assert stored(spark, fresh) == want
    key = lambda o: sorted((r.file_path, r.rows, r.hash) for r in manifest.read_manifest(spark, o, TABLE).collect())
    assert key(out) == key(fresh) and len(key(out)) == 4


def test_a_file_that_breaks_leaves_its_rows_to_nobody(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "out")
    load(spark, tree, out)
    put(tree, "goa", 2020, "1.json", '{"data": {"transactionData": [{"name": "a", "paymentInstruments": [{"count": "many"}]}]}}')
    put(tree, "goa", 2020, "2.json", " \n")
    put(tree, "west-bengal", 2020, "1.json", "")  # of zero bytes: as if it were gone
    put(tree, "goa", 2021, "1.json", "[1, 2]")
    refresh(spark, tree, out, [TABLE])
    assert stored(spark, out) == []
    kept = {r.file_path.split("/state/")[1]: r.raw for r in spark.read.parquet(f"{out}/_quarantine/{TABLE}").collect()}
    assert sorted(kept) == ["goa/2020/1.json", "goa/2020/2.json", "goa/2021/1.json", "west-bengal/2022/3.json"]
    assert kept["goa/2020/2.json"].strip() == "" and kept["west-bengal/2022/3.json"] == "{oops"


def test_nothing_changed_reads_and_writes_nothing(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "out")
    load(spark, tree, out)
    before = {d: sorted(os.listdir(f"{out}/{d}")) for d in (f"_manifest/{TABLE}", f"{TABLE}/year=2020")}
    assert sinks.sync_table(spark, tree, TABLE, out) == sinks.Merged()
    assert {d: sorted(os.listdir(f"{out}/{d}")) for d in before} == before


def test_refresh_reads_only_the_quarters_concerned(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "out")
    load(spark, tree, out)
    untouched = sorted(os.listdir(f"{out}/{TABLE}/year=2021"))
    put(tree, "goa", 2020, "3.json", [("n", 7)])
    os.remove(path_of(tree, "goa", 2020, "2.json"))
    assert sinks.sync_table(spark, tree, TABLE, out) == sinks.Merged(files=1, rows=1, quarantined=0, removed=1)
    assert sorted(os.listdir(f"{out}/{TABLE}/year=2021")) == untouched
    assert [r[2] for r in stored(spark, out) if r[0] == "Goa" and r[1] == 2020] == [1, 1, 3]


def test_parts_of_a_quarter_are_one_quarter(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "out")
    load(spark, tree, out)
    put(tree, "goa", 2020, "1.1.json", [("p", 8)])
    refresh(spark, tree, out, [TABLE])
    here = lambda: [r[3:] for r in stored(spark, out) if r[:3] == ("Goa", 2020, 1)]
    assert here() == [("a", 1), ("b", 2), ("p", 8)]
    put(tree, "goa", 2020, "1.json", [("a", 10)])
    refresh(spark, tree, out, [TABLE])
    assert here() == [("a", 10), ("p", 8)]
    os.remove(path_of(tree, "goa", 2020, "1.json"))
    refresh(spark, tree, out, [TABLE])
    assert here() == [("p", 8)]


def test_files_at_other_paths_are_quarantined(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "out")
    put(tree, "goa", "notes", "readme.json", [("a", 1)])
    report = load(spark, tree, out)
    assert (report.files, report.quarantined, report.error) == (6, 2, None)
    os.remove(path_of(tree, "goa", "notes", "readme.json"))
    refresh(spark, tree, out, [TABLE])
    assert spark.read.parquet(f"{out}/_quarantine/{TABLE}").count() == 1


def test_a_tier_that_goes_empties_the_table(spark, tree, tmpdir_fresh):
    import shutil
    out = os.path.join(tmpdir_fresh, "out")
    load(spark, tree, out)
    shutil.move(os.path.join(tree, "data"), os.path.join(tmpdir_fresh, "elsewhere"))
    assert sinks.sync_table(spark, tree, TABLE, out).removed == 5
    assert stored(spark, out) == [] and manifest.read_manifest(spark, out, TABLE).count() == 0


def test_a_cut_off_manifest_is_not_read(spark, tree, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "out")
    load(spark, tree, out)
    os.makedirs(f"{out}/_manifest/{TABLE}/v=99")
    assert manifest.read_manifest(spark, out, TABLE).count() == 5
    put(tree, "goa", 2020, "4.json", [("q", 1)])
    refresh(spark, tree, out, [TABLE])
    assert sorted(os.listdir(f"{out}/_manifest/{TABLE}")) == ["v=100"]


def test_stream_then_refresh(spark, tree, tmpdir_fresh):
    out, ck = os.path.join(tmpdir_fresh, "out"), os.path.join(tmpdir_fresh, "ck")
    done = []
    stream_table(spark, tree, TABLE, out, ck, max_files_per_trigger=2, done=done).awaitTermination()
    assert len(done) == 3 and sum(m.quarantined for m in done) == 1
    fresh = os.path.join(tmpdir_fresh, "fresh")
    load(spark, tree, fresh)
    assert stored(spark, out) == stored(spark, fresh)
    put(tree, "goa", 2020, "1.json", [("a", 100)])  # the stream has seen this path
    put(tree, "goa", 2023, "1.json", [("new", 1)])
    assert refresh(spark, tree, out, [TABLE], checkpoint_base=None) == {TABLE: 2}
    load(spark, tree, fresh)
    assert stored(spark, out) == stored(spark, fresh)


def test_old_files_are_not_opened(spark, tree):
    since = ingest.list_files(spark, tree, TABLE).agg({"modified": "max"}).first()[0]
    plan = ingest.read_payloads(spark, tree, TABLE, since)
    assert [r.file_path.split("/state/")[1] for r in plan.select("file_path").collect()] == ["west-bengal/2022/3.json"]
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "file_modification_time" in scan


def test_payload_files_split_long_lists(spark, tmpdir_fresh):
    from qtrlens.sources.payload_files import payload_files, remove_files, write_files
    kind = "state string, district string, pincode string, year smallint, quarter int, registered_users bigint"
    data = [("North Sea", None, str(i), 2020, 1, i) for i in range(95)] + [("North Sea", "d", None, 2020, 1, 95), ("Goa", None, "1", 2020, 2, 1)]
    df = spark.createDataFrame(data, kind)
    files = payload_files(df, "top_user", tmpdir_fresh, places_per_file=10).checkpoint()
    names = sorted(r.file_path.split("/state/")[1] for r in files.collect())
    assert "goa/2020/2.json" in names and len([n for n in names if n.startswith("north-sea/2020/1.")]) > 5
    n, size = write_files(files)
    assert n == len(names) and size > 0
    got = ingest.load_table(spark, tmpdir_fresh, "top_user")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.select(*got.columns).collect()))
    assert remove_files(files) == remove_files(files) == n
    assert ingest.load_table(spark, tmpdir_fresh, "top_user").count() == 0
