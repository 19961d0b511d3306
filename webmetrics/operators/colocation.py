"""Products and what filters ask of their events, laid out so that their semi-join needs no shuffle.

Both sides are split alike into buckets by (person, time, salt). Bought items of a pair with very many
rows are dealt to several salts; what is known of the pair's events is then stored with each of them.
Only distinct audiences of an event are kept, so that is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.predicates import audience_filter, product_filter
from webmetrics.operators.semijoin import EVENT_KEY
from webmetrics.spec import FilterSpec

SALT = "salt"
JOIN_KEY = [*EVENT_KEY, SALT]
#: What the audience filters read of an event.
AUDIENCE_COLUMNS = ["traffic_medium", "country", "campaign_name", "traffic_source"]
#: Product rows of one (person, time) pair that one salt takes.
ROWS_PER_SALT = 100_000


def _has_key() -> Column:
    return F.col(EVENT_KEY[0]).isNotNull() & F.col(EVENT_KEY[1]).isNotNull()


def hot_keys(products: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Pairs with more product rows than a salt takes, and how many salts they get."""
    counts = products.where(_has_key()).groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > rows_per_salt).select(
        *EVENT_KEY, F.ceil(F.col("rows") / rows_per_salt).cast("int").alias("salts"))


def salted_products(products: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """Product rows with their salt: 0, or for a hot pair any of its salts.

    Rows without a person or time meet no event, so they may lie anywhere. The number that spreads
    rows is given before any shuffle, so that a task that runs again gives the same.
    """
    number = F.col("any_number")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(number, F.col("salts"))) \
        .when(~_has_key(), F.pmod(number, F.lit(buckets))).otherwise(0)
    numbered = products.withColumn("any_number", F.monotonically_increasing_id())
    return numbered.join(hot, EVENT_KEY, "left").select(*products.columns, salt.cast("int").alias(SALT))


def audiences(events: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct (person, time, audience columns), for a hot pair once with each salt."""
    seen = events.where(_has_key()).select(*EVENT_KEY, *AUDIENCE_COLUMNS).distinct()
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return seen.join(hot, EVENT_KEY, "left").withColumn(SALT, F.explode(salts)).drop("salts")


def bought_by(products: DataFrame, seen: DataFrame, spec: FilterSpec) -> DataFrame:
    """Product rows under the whole filter, each once. No join if nothing is asked of the event."""
    bought = products.where(product_filter(spec))
    if spec.narrows_events:
        bought = bought.join(seen.where(audience_filter(spec)), JOIN_KEY, "left_semi")
    return bought.select(*[c for c in products.columns if c != SALT])
