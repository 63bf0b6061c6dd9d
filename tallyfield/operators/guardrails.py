"""Rolling guardrails, claims, quotas, drafts, account-health monitors and user-data operators over post logs."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield import params

DAY = 86400


def _seconds(c: str) -> Column:
    return F.unix_micros(c)


def _back(keys: list[str], time: str, days: int):
    return Window.partitionBy(*keys).orderBy(_seconds(time)).rangeBetween(-days * DAY * 1_000_000 + 1, 0)


def promo_cap(posts: DataFrame, cap: int = params.PROMO_CAP, days: int = params.PROMO_DAYS) -> DataFrame:
    """Posts with the user's product posts in the days up to and with them, and whether that pauses the user."""
    n = F.sum(F.col("mentions_product").cast("long")).over(_back(["user_id"], "posted_at", days))
    return posts.withColumn("promos", n).withColumn("pause", F.col("promos") >= cap)


def removal_rate(posts: DataFrame, window: int = params.REMOVAL_WINDOW, rate: float = params.REMOVAL_RATE) -> DataFrame:
    """Share of removals among each user's last `window` posts; a pause needs a full window and more than the rate."""
    order = Window.partitionBy("user_id").orderBy(F.desc("posted_at"), F.desc("post_id"))
    last = posts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= window)
    out = last.groupBy("user_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if("is_removed").alias("removed"))
    return out.withColumn("pause", (F.col("posts") == window) & (F.col("removed") / F.col("posts") > rate))


def resolve_claims(claims: DataFrame) -> DataFrame:
    """The first claim of each opportunity, by time and then id."""
    order = Window.partitionBy("opportunity_id").orderBy("claimed_at", "claim_id")
    return claims.withColumn("k", F.row_number().over(order)).withColumn("won", F.col("k") == 1).drop("k")


def apply_quota(requests: DataFrame, cap: int) -> DataFrame:
    """Requests with their place in the user's UTC day and whether it is within the quota."""
    order = Window.partitionBy("user_id", F.to_date("posted_at")).orderBy("posted_at", "post_id")
    return requests.withColumn("place", F.row_number().over(order).cast("long")).withColumn("accepted", F.col("place") <= cap)


def draft_state(events: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """The last status of each key, and how many of its transitions repeat the status before."""
    order = Window.partitionBy(key).orderBy(time, tie)
    rows = events.withColumn("before", F.lag(status).over(order))
    return rows.groupBy(key).agg(F.max_by(status, F.struct(time, tie)).alias("state"), F.count(F.lit(1)).alias("transitions"), F.count_if(F.col(status) == F.col("before")).alias("repeats"))


def feed(opportunities: DataFrame, allowed: DataFrame, claimed: DataFrame, least: float, k: int) -> DataFrame:
    """The k best opportunities of allowed communities that aren't claimed."""
    out = opportunities.where(F.col("score") >= least).join(allowed, "community", "left_semi").join(claimed, "post_id", "left_anti")
    return out.orderBy(F.desc("score"), F.desc("post_id")).limit(k)


def adjacent(activity: DataFrame, seeds: list[str], k: int) -> DataFrame:
    """The k communities that most authors of the seeds are active in besides."""
    authors = activity.where(F.col("community").isin(seeds)).select("author").distinct()
    rest = activity.where(~F.col("community").isin(seeds)).select("author", "community").distinct()
    return rest.join(authors, "author", "left_semi").groupBy("community").agg(F.count(F.lit(1)).alias("authors")).orderBy(F.desc("authors"), "community").limit(k)


def parse_scores(df: DataFrame, column: str, least: int = 60) -> DataFrame:
    """score clamped to 0..100 from a JSON reply, those at least `least`."""
    x = F.from_json(column, "score double, reason string")
    return df.withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), x["score"]))).withColumn("reason", x["reason"]).where(F.col("score") >= least)


def error_reason(status: Column, body: Column) -> Column:
    """Why a scoring call failed, null if it didn't."""
    parsed = F.try_parse_json(body)
    return (
        F.when(status == 429, "rate_limited").when(status == 408, "timeout").when(status >= 500, "upstream_5xx").when(status != 200, "other")
        .when(parsed.isNull(), "json_parse").when(F.get_json_object(body, "$.score").isNull(), "schema_invalid")
    )


def keyword_candidates(posts: DataFrame, text: Column, keywords: list[str]) -> DataFrame:
    """Posts whose text holds any keyword, case aside; without keywords all."""
    from tallyfield.functions.columns import any_of

    return posts.where(any_of(F.lower(text), [k.lower() for k in keywords])) if keywords else posts


class UserTable(NamedTuple):
    """How a table holds users: the column of their id, whether their rows stay with it emptied, and what else is emptied then."""

    user: str = "user_id"
    keep: bool = False
    pii: tuple[str, ...] = ()


def export_bundle(tables: dict[str, DataFrame], registry: dict[str, UserTable], users: DataFrame) -> DataFrame:
    """(user_id, table, rows, n): for each of users(user_id) and each table of the registry one row with all of the user's rows there as a sorted JSON array, empty ones too."""
    asked = users.where("user_id is not null").select(F.col("user_id").cast("string").alias("user_id")).distinct()
    parts = []
    for name, rule in registry.items():
        df = tables[name]
        rows = df.select(F.col(rule.user).cast("string").alias("_user"), F.struct(*sorted(df.columns)).alias("row")).join(asked.withColumnRenamed("user_id", "_user"), "_user", "left_semi")
        held = rows.groupBy(F.col("_user").alias("user_id")).agg(F.to_json(F.array_sort(F.collect_list("row"))).alias("rows"), F.count(F.lit(1)).alias("n"))
        parts.append(asked.join(held, "user_id", "left").select("user_id", F.lit(name).alias("table"), F.coalesce("rows", F.lit("[]")).alias("rows"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def erased(df: DataFrame, users: DataFrame, pii: list[str], keep: bool, user: str = "user_id") -> DataFrame:
    """df without the users' rows, or (keep) with those rows' personal columns and id emptied."""
    gone = users.select(F.col("user_id").alias("_gone")).where("_gone is not null").distinct()
    same = F.col(user).cast("string") == F.col("_gone").cast("string")
    if not keep:
        return df.join(gone, same, "left_anti")
    return df.join(gone, same, "left").withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in [*pii, user]}).drop("_gone")


def _versions(spark: SparkSession, root: str):
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(f"{root}/versions")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
    return store, fs, sorted(int(x) for x in found if x.isdigit())


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version in force under root."""
    return spark.read.parquet(f"{root}/data/{_versions(spark, root)[2][-1]}/{name}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Writes all tables as a new version and puts it in force by one rename; a job that ends before it changes nothing that readers see."""
    store, fs, known = _versions(spark, root)
    number = (known[-1] if known else 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/data/{number}/{name}")
    draft = fs.Path(f"{root}/drafts/{uuid.uuid4().hex}")
    store.create(draft).close()
    store.mkdirs(fs.Path(f"{root}/versions"))
    if not store.rename(draft, fs.Path(f"{root}/versions/{number}")):
        raise RuntimeError(f"version {number} of {root} was published by another job")
    return number


def erase_users(spark: SparkSession, root: str, registry: dict[str, UserTable], requests: DataFrame) -> int:
    """Carries out requests(request_id, user_id) over all tables of the registry under root, as one new version; its number.

    Users' rows go, or stay with id and personal columns emptied, as the registry says. The audit
    table of the same version gets a row for each request, without the user: request_id, state,
    erased, and how many rows each table held. Tables and audit come into force together, and
    requests that are in the audit are not carried out again, so a job can be run again at any point.
    """
    known = _versions(spark, root)[2]
    audit = current(spark, root, "audit").select("request_id") if "audit" in _names(spark, root) else None
    due = requests.where("request_id is not null").groupBy("request_id").agg(F.max(F.col("user_id").cast("string")).alias("user_id"))
    due = due if audit is None else due.join(audit, "request_id", "left_anti")
    due = due.persist(StorageLevel.DISK_ONLY)
    try:
        if not due.limit(1).count():
            return known[-1]
        users, tables, held = due.select("user_id"), {}, due
        for name, rule in registry.items():
            df = current(spark, root, name)
            tables[name] = erased(df, users, list(rule.pii), rule.keep, rule.user)
            n = df.groupBy(F.col(rule.user).cast("string").alias("user_id")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
            held = held.join(n, "user_id", "left")
        row = held.select("request_id", F.lit("completed").alias("state"), F.lit(True).alias("erased"), *(F.coalesce(f"n_{x}", F.lit(0).cast("long")).alias(f"n_{x}") for x in registry))
        tables["audit"] = row if audit is None else current(spark, root, "audit").unionByName(row)
        rest = {x: current(spark, root, x) for x in _names(spark, root) if x not in tables}
        return publish(spark, root, tables | rest)
    finally:
        due.unpersist()


def _names(spark: SparkSession, root: str) -> list[str]:
    store, fs, known = _versions(spark, root)
    return [x.getPath().getName() for x in store.listStatus(fs.Path(f"{root}/data/{known[-1]}"))]


def alias_variants(names: DataFrame) -> DataFrame:
    """Distinct spellings of a trimmed name: as it is, lower, both without spaces, and the last as a .com and a .io domain; none of an empty name."""
    n = F.trim("name")
    joined = F.regexp_replace(n, r"\s+", "")
    site = F.lower(joined)
    found = F.array_sort(F.array_distinct(F.array(n, F.lower(n), joined, site, F.concat(site, F.lit(".com")), F.concat(site, F.lit(".io")))))
    return names.withColumn("variants", F.when(n == "", F.array().cast("array<string>")).otherwise(found))


# account health


def visibility_gap(checks: DataFrame) -> DataFrame:
    gap = F.when(F.col("authed") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("authed") - F.col("anon")) / F.col("authed")))
    return checks.withColumn("gap", gap).withColumn("anomaly", F.col("gap") > params.GAP_ANOMALY)


def escalate(checks: DataFrame) -> DataFrame:
    """alert where a check and the one before are anomalous and at least a day apart; warning for a lone anomaly."""
    w = Window.partitionBy("user_id").orderBy("checked_at")
    was, at = F.lag("anomaly").over(w), F.lag("checked_at").over(w)
    long = (_seconds("checked_at") - F.unix_micros(at)) >= DAY * 1_000_000
    return checks.withColumn("status", F.when(~F.col("anomaly"), "ok").when(was & long, "alert").otherwise("warning"))


def karma_trend(snapshots: DataFrame, now: Column, points: float = params.DROP_POINTS, share: float = params.DROP_SHARE) -> DataFrame:
    """The latest total against the newest snapshot at least 7 days old: ok without a drop; with one, alert where it holds against the snapshot at least 14 days old too, else warning."""
    upto = lambda d: F.max_by(F.when(F.col("taken_at") <= now - F.expr(f"interval {d} days"), F.col("total")), F.when(F.col("taken_at") <= now - F.expr(f"interval {d} days"), F.col("taken_at")))
    out = snapshots.groupBy("user_id").agg(F.max_by("total", "taken_at").alias("total"), upto(7).alias("week"), upto(14).alias("fortnight"))
    drop = lambda c: F.coalesce((F.col("total") - F.col(c) <= -points) | ((F.col(c) > 0) & ((F.col(c) - F.col("total")) / F.col(c) >= share)), F.lit(False))
    return out.withColumn("status", F.when(~drop("week"), "ok").when(drop("fortnight"), "alert").otherwise("warning"))


def slow_burn(posts: DataFrame, window: int = params.BURN_WINDOW) -> DataFrame:
    """alert where a user's last posts fill the window with removals that are spread out: over the rate, two or more, a week apart."""
    order = Window.partitionBy("user_id").orderBy(F.desc("posted_at"), F.desc("post_id"))
    last = posts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= window)
    at = F.when(F.col("is_removed"), F.col("posted_at"))
    out = last.groupBy("user_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if("is_removed").alias("removed"), (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("span"))
    ok = (F.col("posts") == window) & (F.col("removed") / F.col("posts") > params.BURN_RATE) & (F.col("removed") >= 2) & (F.col("span") >= params.BURN_DAYS * DAY * 1_000_000)
    return out.withColumn("alert", F.coalesce(ok, F.lit(False))).drop("span")


def removal_gaps(posts: DataFrame, window: int = params.BURN_WINDOW) -> DataFrame:
    """Per user the mean and the population deviation, in days, of the gaps between removals among the last posts; null under two removals."""
    order = Window.partitionBy("user_id").orderBy(F.desc("posted_at"), F.desc("post_id"))
    last = posts.withColumn("k", F.row_number().over(order)).where((F.col("k") <= window) & F.col("is_removed"))
    gap = (_seconds("posted_at") - F.lag(_seconds("posted_at")).over(Window.partitionBy("user_id").orderBy("posted_at", "post_id"))) / (DAY * 1_000_000)
    return last.withColumn("gap", gap).groupBy("user_id").agg(F.count(F.lit(1)).alias("removed"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("gap_deviation"))


def health_state(checks: DataFrame) -> DataFrame:
    """Per user the last status and since when it has been suspect without an ok in between."""
    w = Window.partitionBy("user_id").orderBy("checked_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last_ok = F.max(F.when(F.col("status") == "ok", F.col("checked_at"))).over(w)
    rows = checks.withColumn("suspect", F.when((F.col("status") != "ok") & (last_ok.isNull() | (F.col("checked_at") > last_ok)), F.col("checked_at")))
    return rows.groupBy("user_id").agg(F.max_by("status", "checked_at").alias("status"), F.min("suspect").alias("suspected_at"))


def latest_checks(checks: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    rest = [c for c in checks.columns if c not in keys]
    return checks.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("m")).select(*keys, "m.*")


def highest_severity(latest: DataFrame) -> DataFrame:
    order = F.array(F.lit("ok"), F.lit("warning"), F.lit("alert"))
    return latest.groupBy("user_id").agg(F.max(F.array_position(order, F.col("status"))).alias("r")).select("user_id", F.element_at(order, F.col("r").cast("int")).alias("severity"))
