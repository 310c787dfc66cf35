"""Administrative metrics and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.functions.columns import since_month_start

#: Fixed value: most plans that usage by plan reports.
MOST_PLANS = 1000


def usage_by_plan(plans: DataFrame, users: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """plan, n_uses since the month's start, 0 for plans without any.

    plans: plan; users: user_id, plan; usage: user_id, ts.  Usage is counted by user
    before the join, so the shuffle to the users holds a row a user.
    """
    per_user = usage.where(since_month_start(F.col("ts"), as_of)).groupBy("user_id").agg(F.count("*").alias("n"))
    per_plan = users.join(per_user, "user_id").groupBy("plan").agg(F.sum("n").alias("n"))
    listed = plans.orderBy("plan").limit(MOST_PLANS)
    return listed.join(per_plan, "plan", "left").select("plan", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_uses"))


def usage_by_action(usage: DataFrame, as_of: str) -> DataFrame:
    return usage.where(since_month_start(F.col("ts"), as_of)).groupBy("action").agg(F.count("*").alias("n_uses"))


def usage_by_user(usage: DataFrame, as_of: str, prefix: str = "") -> DataFrame:
    """user_id, n_uses of the month, of actions that start with prefix in any case."""
    rows = usage.where(since_month_start(F.col("ts"), as_of) & F.lower("action").like(f"{prefix.lower()}%"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_uses"))


def user_activity(page_of_users: DataFrame, products: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """user_id, name, n_products, n_uses of one page of users.

    The page has at most 200 rows: their ids are a filter that the scans of both tables get.
    """
    ids = [r.user_id for r in page_of_users.select("user_id").collect()]
    made = products.where(F.col("user_id").isin(ids)).groupBy("user_id").agg(F.count("*").alias("n_products"))
    used = usage.where(since_month_start(F.col("ts"), as_of) & F.col("user_id").isin(ids)).groupBy("user_id").agg(F.count("*").alias("n_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return page_of_users.join(made, "user_id", "left").join(used, "user_id", "left").select("user_id", "name", zero("n_products"), zero("n_uses"))


def status_counts(products: DataFrame, status: str) -> DataFrame:
    return products.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("total"))


def scaled(counts: DataFrame) -> DataFrame:
    """Adds percent of the largest total (of 1 at least); counts has a row a status."""
    most = F.broadcast(counts.agg(F.greatest(F.max("total"), F.lit(1)).alias("most")))
    return counts.join(most).select("status", "total", F.round(F.col("total") / F.col("most") * 100).cast("bigint").alias("percent"))


def quota_remaining(users: DataFrame, limits: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """user_id, remaining, allowed: -1 where the limit is null or not positive (unlimited); denied at 0 or less.

    Rows of usage count, whatever credits they took.  limits has a row a plan.
    """
    used = usage.where(since_month_start(F.col("ts"), as_of)).groupBy("user_id").agg(F.count("*").alias("used"))
    rows = users.join(limits, "plan", "left").join(used, "user_id", "left")
    free = F.col("plan_limit").isNull() | (F.col("plan_limit") <= 0)
    left = F.when(free, F.lit(-1)).otherwise(F.col("plan_limit") - F.coalesce("used", F.lit(0))).cast("bigint")
    return rows.select("user_id", left.alias("remaining"), (free | (left > 0)).alias("allowed"))


def credit_check(users: DataFrame, limits: DataFrame, usage: DataFrame, need: int, as_of: str) -> DataFrame:
    """user_id, effective_limit, used, enough: the user's limit, else the plan's; unlimited where that is null or not positive."""
    used = usage.where(since_month_start(F.col("ts"), as_of)).groupBy("user_id").agg(F.count("*").alias("used"))
    limit = F.coalesce(F.nullif(F.col("user_limit"), F.lit(0)), F.col("plan_limit")).cast("bigint")
    spent = F.coalesce("used", F.lit(0)).cast("bigint")
    rows = users.join(limits, "plan", "left").join(used, "user_id", "left")
    return rows.select("user_id", limit.alias("effective_limit"), spent.alias("used"), (limit.isNull() | (limit <= 0) | (spent + need <= limit)).alias("enough"))


#: Columns of a roll-up: a row for each user, month and action, split over parts that are added when they are read.
ROLL_UP = ("user_id", "month", "action", "n", "last_ts", "upto")


def month_counts(usage: DataFrame, id_column: str = "event_id", after: int | None = None) -> DataFrame:
    """A part of a roll-up: n and last_ts by user, month and action of the events with ids greater than after; upto is the greatest id of the part.

    Ids grow with arrival, not with ts: a late event has a new id and an old month.
    """
    new = usage if after is None else usage.where(F.col(id_column) > after)
    month = F.date_trunc("month", F.col("ts").cast("timestamp_ntz")).cast("date").alias("month")
    return new.groupBy("user_id", month, "action").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max(id_column).alias("upto"))


def extended(roll_up: DataFrame, usage: DataFrame, id_column: str = "event_id") -> DataFrame:
    """roll_up with a part for the events that came since; a filter on their ids reaches the scan of usage."""
    upto = roll_up.agg(F.max("upto")).first()[0]
    return roll_up.unionByName(month_counts(usage, id_column, upto))


def compacted(roll_up: DataFrame) -> DataFrame:
    """roll_up with one row for each user, month and action; counts are added, so parts can be merged in any order."""
    return roll_up.groupBy("user_id", "month", "action").agg(F.sum("n").cast("bigint").alias("n"), F.max("last_ts").alias("last_ts"), F.max("upto").alias("upto"))


def month_since(roll_up: DataFrame, as_of: str) -> DataFrame:
    """The part of a roll-up from as_of's month on, as usage since the month's start is counted."""
    return roll_up.where(F.col("month") >= F.date_trunc("month", F.to_timestamp(F.lit(as_of))).cast("date"))


def rolled_usage_by_action(roll_up: DataFrame, as_of: str) -> DataFrame:
    """usage_by_action of the events in a roll-up."""
    return month_since(roll_up, as_of).groupBy("action").agg(F.sum("n").cast("bigint").alias("n_uses"))


def rolled_usage_by_plan(plans: DataFrame, users: DataFrame, roll_up: DataFrame, as_of: str) -> DataFrame:
    """usage_by_plan of the events in a roll-up."""
    per_user = month_since(roll_up, as_of).groupBy("user_id").agg(F.sum("n").alias("n"))
    per_plan = users.join(per_user, "user_id").groupBy("plan").agg(F.sum("n").alias("n"))
    return plans.orderBy("plan").limit(MOST_PLANS).join(per_plan, "plan", "left").select("plan", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_uses"))
