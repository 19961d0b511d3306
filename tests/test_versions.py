"""Tables replaced under readers, and loads that touch their own shards only."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tests import frames
from tests.test_sources import database  # noqa: F401  (a fixture)
from webmetrics.operators.newusers import build_new_users
from webmetrics.operators.personstate import people_of, person_state
from webmetrics.plans.etl import run_etl
from webmetrics.schema import RAW_EVENT_SCHEMA, STORED_COLUMNS
from webmetrics.sources import sink, versions

SCHEMA = RAW_EVENT_SCHEMA.add("event_id", LongType()) if "event_id" not in RAW_EVENT_SCHEMA.names else RAW_EVENT_SCHEMA


def broken(df, where="true"):
    """``df``, but reading any row that matches fails."""
    fails = F.when(F.expr(where), F.raise_error(F.lit("read"))).otherwise(F.lit(1))
    return df.withColumn("item_name", F.when(fails.cast("int") == 1, F.col("item_name")))


def record(number, shard, user, name, day=None, order=None, revenue=None, items=0, country=None):
    moment = datetime.strptime(day or shard, "%Y%m%d").replace(tzinfo=timezone.utc) + timedelta(seconds=number % 5)
    return {
        "event_id": number, "table_suffix": shard, "event_date": day or shard, "event_timestamp": int(moment.timestamp() * 1e6),
        "event_name": name, "user_pseudo_id": user, "geo": {"country": country},
        "ecommerce": {"transaction_id": order, "purchase_revenue_in_usd": revenue},
        "items": [{"item_id": str(k), "item_name": "n", "price": 1.0, "quantity": k} for k in range(items)],
    }


def records(spark, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in SCHEMA.fields} for r in rows], SCHEMA)


def table(spark, name):
    return sorted((tuple(r) for r in spark.table(name).select(*STORED_COLUMNS[name.split(".")[-1]]).collect()), key=repr)


def contents(spark, base):
    return {name: table(spark, f"{base}.{name}") for name in STORED_COLUMNS}


def random_records(seed, count=400):
    rng = random.Random(seed)
    days = [f"202101{d:02d}" for d in range(1, 13)]
    rows = []
    for k in range(count):
        name = rng.choice(["first_visit", "purchase", "view_item"])
        shard = rng.choice(days)
        rows.append(record(
            k, shard, rng.choice([None, *"abcdefghij"]), name, rng.choice([shard, shard, shard, rng.choice(days)]),
            rng.choice([None, "o1", "o2", "o3"]) if name != "view_item" else None, rng.choice([None, 1.5, 2.0]) if name == "purchase" else None,
            rng.randrange(3), rng.choice([None, "A", "B"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_loads_in_any_order_equal_one_load(spark, database, tmp_path, seed):  # noqa: F811
    """Shards loaded in pieces, wrong deliveries replaced, shards emptied: the tables of one load of what is left."""
    rows = random_records(seed)
    wrong = random_records(seed + 100)
    layout = sink.StoreLayout(database=database)
    out = str(tmp_path / "files")

    def load(some, start, end):
        run_etl(spark, records(spark, some), out, start, end, layout, ["event_id"], replace="partitions")

    load(rows, "20210105", "20210108")
    load(wrong, "20210109", "20210112")
    load(wrong, "20210101", "20210104")
    load(rows, "20210109", "20210112")
    load([r for r in rows if r["table_suffix"] != "20210103"], "20210101", "20210104")
    left = [r for r in rows if r["table_suffix"] != "20210103"]
    found = contents(spark, database)
    files = {n: spark.read.parquet(f"{out}/{n}").count() for n in STORED_COLUMNS}
    run_etl(spark, records(spark, left), str(tmp_path / "once"), "20210101", "20210112", layout, ["event_id"])
    assert found == contents(spark, database)
    assert files == {n: len(found[n]) for n in STORED_COLUMNS}
    plain = build_new_users(records(spark, left), ["event_id"])
    assert sorted(map(repr, plain.select(*STORED_COLUMNS["newusers"]).collect())) == sorted(
        map(repr, spark.table(f"{database}.newusers").collect()))


def test_state_gives_the_new_users(spark):
    raw = records(spark, random_records(7))
    expected = sorted(map(repr, build_new_users(raw, ["event_id"]).collect()))
    assert sorted(map(repr, people_of(person_state(raw, ["event_id"])).collect())) == expected
    assert sorted(map(repr, people_of(person_state(raw, ["event_id"], by=())).collect())) == expected
    assert people_of(person_state(raw.where("false"))).count() == 0


def test_reload_reads_and_writes_its_own_shards(spark, database, tmp_path):  # noqa: F811
    layout, out = sink.StoreLayout(database=database), tmp_path / "files"
    january = [record(k, f"202101{k % 20 + 1:02d}", f"u{k}", "first_visit", items=1) for k in range(60)]
    february = [record(100 + k, f"202102{k % 20 + 1:02d}", f"v{k}", "first_visit", items=1) for k in range(60)]
    # One person of January buys in February, so that person's day is written as well.
    february.append(record(200, "20210205", "u3", "purchase", order="x", revenue=2.0))
    run_etl(spark, records(spark, january), str(out), "20210101", "20210131", layout, ["event_id"], replace="partitions")
    path = str(tmp_path / "raw")
    records(spark, january + february).write.partitionBy("table_suffix").parquet(path)
    for folder in Path(path).glob("table_suffix=202101*"):
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"no Parquet: reading this file fails")
    raw = spark.read.schema(SCHEMA).parquet(path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if p.is_file()}
    run_etl(spark, raw, str(out), "20210201", "20210228", layout, ["event_id"], replace="partitions")
    new = [p for p in tmp_path.rglob("*.parquet") if p.is_file() and before.get(p) != p.stat().st_mtime_ns]
    days = {part.split("=")[1].replace("-", "") for p in new for part in p.parts if part.startswith(("event_date=", "table_suffix=", "first_visit_date="))}
    assert days == {f"202102{d:02d}" for d in range(1, 21)} | {"20210104"}
    bought = spark.table(f"{database}.newusers").where("did_purchase").collect()
    assert [(str(r["first_visit_date"]), r["purchase_count"]) for r in bought] == [("2021-01-04", 1)]
    assert spark.table(f"{database}.events").count() == 121


def test_readers_see_whole_tables_during_and_after_a_failed_build(spark, database, tmp_path):  # noqa: F811
    layout = sink.StoreLayout(database=database)
    ev, pr, nu = frames.events(spark, {}, {}), frames.products(spark, {}), frames.newusers(spark, {})
    sink.build_warehouse(spark, ev, pr, nu, layout)
    reader = spark.table(f"{database}.events")
    before = contents(spark, database)
    with pytest.raises(Exception, match="read"):
        sink.build_warehouse(spark, ev.union(ev), broken(pr), nu, layout)  # events are written already
    assert contents(spark, database) == before
    sink.build_warehouse(spark, ev.union(ev), pr, nu, layout)
    assert reader.count() == 2  # a reader that began earlier goes on
    assert spark.table(f"{database}.events").count() == 4
    # Between writing and the switch nothing is seen.
    staged = sink.stage_table(ev.select(*STORED_COLUMNS["events"]), "events", layout)
    assert spark.table(f"{database}.events").count() == 4 and staged.rows().count() == 2
    staged.switch()
    assert spark.table(f"{database}.events").count() == 2


def test_a_load_that_fails_leaves_tables_and_can_be_repeated(spark, database, tmp_path):  # noqa: F811
    layout, out = sink.StoreLayout(database=database), str(tmp_path / "files")
    rows = random_records(3)

    def load(raw, start, end):
        run_etl(spark, raw, out, start, end, layout, ["event_id"], replace="partitions")

    load(records(spark, rows), "20210101", "20210106")
    before = contents(spark, database)
    fails = F.when(F.col("event_name") == "purchase", F.raise_error(F.lit("read")).cast("double")).otherwise(F.lit(1.0))
    bad = records(spark, rows).withColumn("ecommerce", F.col("ecommerce").withField("purchase_revenue_in_usd", fails))
    with pytest.raises(Exception, match="read"):
        load(bad, "20210105", "20210112")
    assert contents(spark, database) == before
    load(records(spark, rows), "20210105", "20210112")
    after = contents(spark, database)
    run_etl(spark, records(spark, rows), str(tmp_path / "once"), "20210101", "20210112", layout, ["event_id"])
    assert contents(spark, database) == after


def test_partitions_taken_over_and_cleaned(spark, database, tmp_path):  # noqa: F811
    name, folder = f"{database}.days", str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, "y/z='"), (3, "c", None)], "v INT, day STRING, part STRING")
    first = versions.write_version(rows, name, folder, ("day", "part"))
    assert first.switch() == name
    assert {repr(versions.parsed(s)) for s in first.written} == {
        repr({"day": "a b", "part": "x"}), repr({"day": None, "part": "y/z='"}), repr({"day": "c", "part": None})}
    second = versions.write_version(rows.where("v = 3").withColumn("v", F.lit(9)), name, folder, ("day", "part"),
                                    keep=lambda spec: spec["day"] != "c")
    second.switch()
    third = versions.write_version(rows.where("v = 1").withColumn("v", F.lit(8)), name, folder, ("day", "part"),
                                   keep=lambda spec: spec["day"] != "a b")
    third.switch()
    wanted = [(8, "a b", "x"), (2, None, "y/z='"), (9, "c", None)]
    assert sorted(map(tuple, spark.table(name).collect()), key=repr) == sorted(wanted, key=repr)
    with pytest.raises(Exception):
        versions.write_version(rows.withColumn("v", F.raise_error(F.lit("x")).cast("int")), name, folder, ("day", "part"))
    assert len(versions.clean(spark, name, folder)) == 1  # the failed build; all others are still in use
    versions.write_version(rows, name, folder, ("day", "part")).switch()
    assert len(versions.clean(spark, name, folder)) == 3
    assert spark.table(name).count() == 3
    assert [r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect() if r.tableName.startswith("days__")] == [
        versions.current_rows(spark, name).inputFiles()[0].split("/days.versions/")[1].split("/")[0]]


def test_a_table_from_elsewhere_keeps_its_rows(spark, database, tmp_path):  # noqa: F811
    spark.range(3).write.saveAsTable(f"{database}.events")
    sink.build_warehouse(spark, frames.events(spark, {}), frames.products(spark, {}), layout=sink.StoreLayout(database=database))
    assert spark.table(f"{database}.events").count() == 1
    (old,) = [r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect() if r.tableName.endswith("_before")]
    assert spark.table(f"{database}.{old}").count() == 3


def test_tables_that_are_split_otherwise_are_not_mixed(spark, database, tmp_path):  # noqa: F811
    layout = sink.StoreLayout(database=database)
    sink.build_warehouse(spark, frames.events(spark, {}), frames.products(spark, {}), layout=layout)  # by day, not by shard
    with pytest.raises(ValueError, match="not split by event_date, table_suffix"):
        run_etl(spark, records(spark, random_records(1, 20)), str(tmp_path / "files"), "20210101", "20210112", layout,
                ["event_id"], replace="partitions")
    assert spark.table(f"{database}.events").count() == 1
