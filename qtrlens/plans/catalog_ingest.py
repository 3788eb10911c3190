"""Ingest, end to end. Each of the nine tables is serialised into the source's JSON payloads and

* parsed back in memory with the fixed schema (``ingest_roundtrip_*``),
* written as a tree of files in the shared folder and loaded from there (``ingest_files_*``),
* loaded from an earlier state of that tree and refreshed (``refresh_*``), or
* streamed as its files arrive (``stream_*``).

The result must equal the table, with the state name as the ingest derives it from the file
path (slug title-cased)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtrlens.plans.registry import register
from qtrlens.schemas import TABLE_SCHEMAS, TIERS
from qtrlens.session import scratch_path
from qtrlens.sinks import load_all, read_table, run_jobs, sync_table
from qtrlens.sources.manifest import delete_folder
from qtrlens.sources.payload_files import payload_files, remove_files, write_files
from qtrlens.sources.payloads import round_trip
from qtrlens.streaming.incremental import refresh, stream_table


def _title_sql(state: str) -> str:
    # slug (lower, blanks to hyphens) -> hyphens to blanks -> capitalise each word
    return (f"array_to_string(list_transform(string_split(replace(lower(replace({state}, ' ', '-')), '-', ' '), ' '), "
            f"lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ')")


def _as_ingested(table: str) -> str:
    cols = [f.name for f in TABLE_SCHEMAS[table].fields]
    sel = ", ".join(_title_sql("state") + " as state" if c == "state" else c for c in cols)
    return f"select {sel} from {table}"


def _register_round_trip(table: str) -> None:
    @register(f"ingest_roundtrip_{table}", _as_ingested(table))
    def _q(t, _table=table):
        levels = ((t.top_level(_table, "district"), t.top_level(_table, "pincode"))
                  if _table.startswith("top_") else None)
        return round_trip(t.table(_table), _table, levels)


def _register_files(table: str) -> None:
    @register(f"ingest_files_{table}", _as_ingested(table))
    def _q(t, _table=table):
        """Write the table's payload files and one broken file beside each state's, then load the tree:
        what the stored table has. Files loaded and quarantined must be all files."""
        root, out = scratch_path(t.spark, "tree"), scratch_path(t.spark, "loaded")
        good = payload_files(t.table(_table), _table, root).checkpoint()
        n, _ = write_files(good)
        broken, _ = write_files(good.select(F.regexp_replace("file_path", "/[0-9]{4}/[0-9.]+json$", "/1990/1.json").alias("file_path"))
                                .distinct().withColumn("json", F.lit('{"data": {"transactionData": [')))
        did = sync_table(t.spark, root, _table, out, everything=True)
        if (did.files, did.quarantined) != (n + broken, broken):
            raise RuntimeError(f"{n} files and {broken} broken ones written, but {did}")
        delete_folder(t.spark, root)
        return read_table(t.spark, f"{out}/{_table}", _table)


def _earlier(good: DataFrame) -> DataFrame:
    """Earlier contents of the files: some without entries, some with other numbers, some broken."""
    kind = F.pmod(F.xxhash64("file_path"), F.lit(4))
    other = F.regexp_replace("json", '"(count|registeredUsers)":', '"$1":1')
    return good.withColumn("json", F.when(kind == 0, F.lit('{"data":{}}')).when(kind == 1, other)
                           .when(kind == 2, F.lit("{oops")).otherwise(F.col("json")))


def _register_refresh(table: str) -> None:
    @register(f"refresh_{table}", _as_ingested(table))
    def _q(t, _table=table):
        """A tree of which some files are empty, wrong, broken, or of quarters that shall go is loaded; then
        it gets the table's files, and a refresh follows: what the stored table has."""
        root, out = scratch_path(t.spark, "tree"), scratch_path(t.spark, "refreshed")
        good = payload_files(t.table(_table), _table, root).checkpoint()
        gone = (good.withColumn("file_path", F.regexp_replace("file_path", "/[0-9]{4}/[0-9.]+json$", "/1990/1.json"))
                .dropDuplicates(["file_path"]).checkpoint())
        write_files(_earlier(good))
        write_files(gone)
        sync_table(t.spark, root, _table, out, everything=True)
        remove_files(gone)
        write_files(good)
        refresh(t.spark, root, out, [_table])
        delete_folder(t.spark, root)
        return read_table(t.spark, f"{out}/{_table}", _table)


def _register_stream(table: str) -> None:
    @register(f"stream_{table}", _as_ingested(table))
    def _q(t, _table=table):
        """The table's files arrive in two lots, by a hash of their paths; after each a stream of the
        files not seen before merges them."""
        root, out, ckpt = (scratch_path(t.spark, x) for x in ("tree", "streamed", "stream"))
        good = payload_files(t.table(_table), _table, root).checkpoint()
        late = F.pmod(F.xxhash64("file_path"), F.lit(3)) == 0
        for lot in (good.where(~late), good.where(late)):
            write_files(lot)
            stream_table(t.spark, root, _table, out, ckpt).awaitTermination()
        delete_folder(t.spark, root)
        delete_folder(t.spark, ckpt)
        return read_table(t.spark, f"{out}/{_table}", _table)


_TIER_SQL = " union all ".join(f"select '{tier}' as tier, '{n}' as \"table\", count(*) as rows, cast(0 as bigint) as quarantined, true as loaded from {n}"
                               for tier, names in TIERS.items() for n in names)


@register("load_report", _TIER_SQL)
def _load_report(t):
    """All nine tables written as files and loaded in one go: the report of the load."""
    root, out = scratch_path(t.spark, "tree"), scratch_path(t.spark, "loaded")
    staged = t.staged()
    wrote = run_jobs({n: (lambda n=n: write_files(payload_files(staged.table(n), n, root))) for n in TABLE_SCHEMAS}, parallel=9)
    if failed := {n: error for n, (_, error) in wrote.items() if error}:
        raise RuntimeError(f"files not written: {failed}")
    report = load_all(t.spark, root, out, parallel=9)
    delete_folder(t.spark, root)
    return report.select("tier", "table", "rows", "quarantined", F.col("error").isNull().alias("loaded"))


for _t in TABLE_SCHEMAS:
    _register_round_trip(_t)
    _register_files(_t)
for _t in ("aggregated_transaction", "map_user", "top_transaction"):
    _register_refresh(_t)
    _register_stream(_t)
