"""Reports over any range of days from what is stored for each day.

Sums of days add up, distinct people do not. So people and orders are numbered once, and a day keeps
the set of numbers it saw as bitmaps, 32,768 numbers each. The union of several days' bitmaps counts
exactly, whatever the range; the work grows with days and people, not with events. Funnel stages are
kept as a bit mask for each person and day, combined by "or".

A state may be split further, by columns that filters ask for (``by``). Days are independent, so a
reloaded day is computed from its own events and replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmetrics.functions.predicates import all_of, event_filter
from webmetrics.operators.measures import completed, stage_mask
from webmetrics.schema import FUNNEL_STAGES
from webmetrics.spec import FilterSpec

DAY = "event_date"
#: Kinds of things that are counted once, with the event column that names them.
COUNTED = {"users": "user_pseudo_id", "transactions": "transaction_id"}
#: New names are numbered in so many parts, each by a task of its own.
NUMBERING_PARTS = 256


def _named(events: DataFrame, *also: str) -> DataFrame:
    """Each counted name of an event as (kind, name), both from one scan; NULLs are not counted."""
    names = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("name")) for kind, column in COUNTED.items()])
    return events.select(*also, F.inline(names)).where("name IS NOT NULL")


def new_numbers(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(kind, name, number) of the names that ``known`` lacks, numbered behind it without gaps.

    Numbers are dense per kind, since bitmaps are as long as the largest number. New names are sorted
    in parts by hash; the sizes of the parts (a few hundred) say where each one's numbers begin.
    """
    names = _named(events).distinct()
    if known is not None:
        names = names.join(known.select("kind", "name"), ["kind", "name"], "left_anti")
    names = names.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(NUMBERING_PARTS)))
    placed = names.withColumn("place", F.row_number().over(Window.partitionBy("kind", "part").orderBy("name")))
    sizes = names.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("kind", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"))
    new = placed.join(begins, ["kind", "part"])
    if known is None:
        return new.select("kind", "name", (F.col("begin") + F.col("place")).alias("number"))
    last = known.groupBy("kind").agg(F.max("number").alias("last"))
    return new.join(last, "kind", "left").select(
        "kind", "name", (F.coalesce("last", F.lit(0)) + F.col("begin") + F.col("place")).alias("number"))


@dataclass(frozen=True)
class DayState:
    """Per day and ``by``: ``totals`` (events, revenue), ``seen`` (kind, bucket, bits), and ``masks``
    (person, done: the stages of the funnel that the person did on that day)."""

    totals: DataFrame
    seen: DataFrame
    masks: DataFrame
    by: tuple[str, ...] = ()
    stages: tuple[str, ...] = FUNNEL_STAGES

    def frames(self) -> dict[str, DataFrame]:
        return {"totals": self.totals, "seen": self.seen, "masks": self.masks}


def day_state(events: DataFrame, numbers: DataFrame, by: Sequence[str] = (),
              stages: Sequence[str] = FUNNEL_STAGES) -> DayState:
    """The state of the given events' days. ``numbers`` has all their names (see ``new_numbers``).

    A name is made distinct per day map-side before it meets its number, so a person with very many
    events costs a row for each task and day.
    """
    key = [DAY, *by]
    names = _named(events, *key).distinct()
    numbered = names.join(numbers, ["kind", "name"])
    seen = numbered.groupBy(*key, "kind", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    totals = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_purchase_revenue").alias("revenue"))
    # Masks serve the funnel, which has its own choice of event names.
    masks = (
        events.where(F.col("event_name").isin(*stages))
        .groupBy(DAY, *[c for c in by if c != "event_name"], "user_pseudo_id")
        .agg(F.bit_or(stage_mask(stages)).alias("done"))
    )
    return DayState(totals, seen, masks, tuple(by), tuple(stages))


def answerable(state: DayState, spec: FilterSpec) -> None:
    """Raise if a filter asks for a column that the state is not split by."""
    asked = {
        "traffic_medium": spec.mediums, "country": spec.countries, "event_name": spec.event_names,
        "campaign_name": spec.keyword, "traffic_source": spec.keyword,
    }
    needed = {c for c, values in asked.items() if values} | ({"country"} if spec.keyword else set())
    missing = sorted(needed - set(state.by))
    if missing:
        raise ValueError(f"the state is not split by {', '.join(missing)}")


def range_sums(state: DayState, spec: FilterSpec, *group: Column) -> DataFrame:
    """Events, distinct users, revenue (NULL if none) and distinct transactions, by ``group``.

    ``group`` are columns made of the day and ``by``, each with an alias. Unions of bitmaps are made
    map-side first.
    """
    answerable(state, spec)
    wanted = event_filter(spec)
    totals = state.totals.where(wanted).groupBy(*group).agg(
        F.sum("events").alias("events"), F.sum("revenue").alias("revenue"))
    unions = state.seen.where(wanted).groupBy(*group, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    names = [c for c in unions.columns if c not in ("kind", "bucket", "bits")]
    distinct = unions.groupBy(*names).agg(*[
        F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits")).otherwise(0)).alias(kind) for kind in COUNTED])
    if names:
        other = distinct.select(*[F.col(c).alias(f"of_{c}") for c in names], *COUNTED)
        same = all_of(F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names)
        joined = totals.join(other, same, "left").drop(*[f"of_{c}" for c in names])
    else:
        joined = totals.select("*", *[distinct.select(kind).scalar().alias(kind) for kind in COUNTED])
    return joined.select(
        *names, F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("users", F.lit(0)).alias("users"),
        "revenue", F.coalesce("transactions", F.lit(0)).alias("transactions"))


def stage_counts_of(state: DayState, spec: FilterSpec) -> DataFrame:
    """People who did stage 1, stages 1-2, ... within the range, in any order: one row."""
    answerable(state, spec.without_events())
    people = (
        state.masks.where(event_filter(spec.without_events()))
        .groupBy("user_pseudo_id").agg(F.bit_or("done").alias("done"))
    )
    return completed(people, state.stages)
