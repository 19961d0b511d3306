"""Raw records to stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webmetrics.operators.flatten import explode_items, flatten_events, prune
from webmetrics.operators.measures import conversion_summary
from webmetrics.operators.personstate import PERSON, of_people, people_of, person_state
from webmetrics.schema import DEFAULT_DAY, STORED_COLUMNS
from webmetrics.sources.scan import in_shards, materialize, read_table_path
from webmetrics.sources.sink import (
    StoreLayout,
    drop_partitions,
    extract,
    extract_shards,
    stage_table,
)
from webmetrics.sources.versions import Spec, Version, current_rows

SHARD, VISIT_DAY = "table_suffix", "first_visit_date"
STATE = "person_state"


@dataclass(frozen=True)
class EtlResult:
    rows: dict[str, int]
    tables: list[str]
    summary: DataFrame


def run_etl(spark: SparkSession, raw: DataFrame, out: str, start: str = DEFAULT_DAY,
            end: str | None = None, layout: StoreLayout = StoreLayout(),
            tie_break: Sequence[str] = (), replace: str = "all") -> EtlResult:
    """Extract the three tables for a range of day shards, then build the report tables.

    Shards are the unit of delivery: an event dated another day than its shard is replaced with its
    shard and no other. ``replace='partitions'`` replaces exactly the shards of the range, those that
    are empty now included, in the files and in the report tables; nothing else is written. New
    users are those of all shards loaded so far: only shards of the range are read of ``raw``, the
    others are known by their state (see ``personstate``), and only days are written on which someone
    had a first visit whom the load is about. ``replace='all'`` forgets what was loaded before.

    Report tables change when everything is written, each at once; a load that fails leaves them as
    they were, and running it again mends the files.
    """
    if replace not in ("all", "partitions"):
        raise ValueError("replace must be 'all' or 'partitions'")
    end = end or start
    shards = in_shards(raw, start, end)
    partly = replace == "partitions"
    stays = (lambda spec: not start <= (spec[SHARD] or "") <= end) if partly else None
    rows, staged = {}, {}
    for name, flat in (("events", flatten_events), ("products", explode_items)):
        df, path = flat(shards, keep=(SHARD,)), f"{out}/{name}"
        evenly = name in layout.rebalance
        rows[name] = extract_shards(name, df, path, start, end, SHARD, evenly) if partly else \
            extract(name, df, path, partition_by=(SHARD,), rebalance=evenly)
        stored = in_shards(read_table_path(spark, path, df.schema), start, end)
        columns = STORED_COLUMNS[name]
        staged[name] = stage_table(prune(stored, [*columns, SHARD]), name, layout, SHARD, stays, columns)
    state = stage_table(person_state(shards, tie_break, (SHARD,)), STATE, layout, SHARD, stays)
    staged["newusers"], rows["newusers"] = _people(spark, state, f"{out}/newusers", start, end, layout, partly)
    for version in (*staged.values(), state):
        version.switch()
    return EtlResult(rows, list(staged), conversion_summary(spark.table(layout.table("newusers"))))


def _people(spark: SparkSession, state: Version, path: str, start: str, end: str,
            layout: StoreLayout, partly: bool) -> tuple[Version, int]:
    """The next version of the new users, and their files."""
    before = current_rows(spark, layout.table(STATE)) if partly else None
    known = current_rows(spark, layout.table("newusers")) if partly else None
    shown = STORED_COLUMNS["newusers"]
    if before is None or known is None or not layout.by_day:
        staged = stage_table(people_of(state.rows()), "newusers", layout, columns=shown)
        return staged, extract("newusers", staged.rows(), path, partition_by=(VISIT_DAY,))
    touched = (
        in_shards(before, start, end).select(PERSON)
        .unionByName(in_shards(state.rows(), start, end).select(PERSON)).distinct()
    )
    touched = materialize(touched)
    changed = materialize(people_of(of_people(state.rows(), touched)))
    days = {r[0] for r in of_people(known, touched).select(VISIT_DAY)
            .unionByName(changed.select(VISIT_DAY)).distinct().collect()}  # days at most
    on_these = _one_of(VISIT_DAY, days)
    others = of_people(known.where(on_these), touched, "left_anti").select(*changed.columns)
    staged = stage_table(changed.unionByName(others), "newusers", layout, keep=_not_on(days), columns=shown)
    count = extract("newusers", staged.rows().where(on_these), path, partition_by=(VISIT_DAY,), replace="partitions")
    written = {spec.split("=", 1)[1] for spec in staged.written}
    names = {"__HIVE_DEFAULT_PARTITION__" if day is None else str(day) for day in days}
    drop_partitions(spark, path, VISIT_DAY, lambda value: value in names - written)
    touched.unpersist()
    changed.unpersist()
    return staged, count


def _one_of(column: str, values: set) -> Column:
    known = F.col(column).isin([v for v in values if v is not None])
    return known | F.col(column).isNull() if None in values else known


def _not_on(days: set) -> Callable[[Spec], bool]:
    names = {None if day is None else str(day) for day in days}
    return lambda spec: spec[VISIT_DAY] not in names
