"""Opportunity feeds, disclosure and eligibility gates, user statistics and task state over post and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import params

DAY_MICROS = 86400 * 1_000_000


def rows_of() -> Column:
    """Number of rows, as an aggregate."""
    return F.count(F.lit(1))


# opportunities


def fresh_candidates(posts: DataFrame, stored: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    """The first `cap` candidates of a cycle that are not stored yet; the cap counts stored ones too."""
    return posts.orderBy(*order).limit(cap).join(stored.select(key).distinct(), key, "left_anti")


def cycle_counters(posts: DataFrame, matches: Column, stored: DataFrame, key: str) -> DataFrame:
    """fetched, keyword_hits and skipped_duplicate of a cycle's posts."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    hit = F.coalesce(matches, F.lit(False))
    return posts.join(known, key, "left").agg(rows_of().alias("fetched"), F.count_if(hit).alias("keyword_hits"), F.count_if(hit & F.col("_known").isNotNull()).alias("skipped_duplicate"))


def list_opportunities(opps: DataFrame, subreddit: str | None = None, min_score: int = 0, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of opportunities by score, then id, both falling; limit is held to 1..500."""
    if subreddit:
        opps = opps.where(F.col("subreddit") == subreddit)
    if min_score:
        opps = opps.where(F.col("score") >= min_score)
    if status:
        opps = opps.where(F.col("status") == status)
    return opps.orderBy(F.desc("score"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(500, limit)))


def eligible_tasks(tasks: DataFrame, subs: DataFrame, prefix: str = "reddit_") -> DataFrame:
    """Open tasks of each user as `gated` (a community kind in a community that matches the user's expertise) or `content` (any other kind, for all users)."""
    open_ = tasks.where("status = 'open'")
    forum = F.col("kind").startswith(prefix)
    mine = subs.where("matches_expertise").select("user_id", F.col("subreddit").alias("suggested_subreddit")).distinct()
    gated = open_.where(forum).join(mine, "suggested_subreddit").select("user_id", "task_id", F.lit("gated").alias("section"))
    content = open_.where(~forum).select(F.lit(None).cast("string").alias("user_id"), "task_id", F.lit("content").alias("section"))
    return gated.unionByName(content)


# gates


def disclosures(posts: DataFrame, text: str, phrases: list[str] | None = None, brands: str | None = None) -> DataFrame:
    """posts with accepted_phrases: the phrases that the lower-cased text contains, [brand] filled in with each of the post's `brands` (an array column)."""
    low = F.lower(text)
    phrases = params.DISCLOSURE_PHRASES if phrases is None else [p.strip().lower() for p in phrases if p.strip()]
    names = F.coalesce(F.col(brands), F.array().cast("array<string>")) if brands else F.array().cast("array<string>")
    parts = []
    for p in phrases:
        if "[brand]" in p:
            phrase = F.lit(p)
            filled = F.transform(names, lambda b: F.replace(phrase, F.lit("[brand]"), F.lower(b)))  # noqa: B023  (called at once)
            parts.append(F.filter(filled, lambda x: low.contains(x)))
        else:
            parts.append(F.when(low.contains(p), F.array(F.lit(p))).otherwise(F.array().cast("array<string>")))
    return posts.withColumn("accepted_phrases", F.coalesce(F.concat(*parts), F.array().cast("array<string>")))


def disclosure_gate(posts: DataFrame, text: str, matched: str, reported: str, all_brands: list[str], phrases: list[str] | None = None) -> DataFrame:
    """posts with mentions_product (found or self-reported), accepted_phrases and verdict.

    A self-report can only add a mention. [brand] stands for the matched brands, or for all of them
    where only the author reports a mention. A mention without a phrase is rejected.
    """
    found = F.coalesce(F.size(matched) > 0, F.lit(False))
    mentions = found | F.coalesce(F.col(reported), F.lit(False))
    none = F.array().cast("array<string>")
    terms = F.when(found, F.col(matched)).when(mentions, F.array(*map(F.lit, all_brands)) if all_brands else none).otherwise(none)
    out = disclosures(posts.withColumn("mentions_product", mentions).withColumn("_terms", terms), text, phrases, "_terms")
    out = out.withColumn("accepted_phrases", F.when(F.col("mentions_product"), F.col("accepted_phrases")).otherwise(none))
    verdict = F.when(F.col("mentions_product") & (F.size("accepted_phrases") == 0), "disclosure_required").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("_terms")


def eligibility(requests: DataFrame, profiles: DataFrame, opportunities: DataFrame, subs: DataFrame, promos: DataFrame, cap: int = params.PROMO_CAP) -> DataFrame:
    """requests(user_id, opportunity_id) with reason, the first of: paused, no_opportunity, not_preexisting_active, not_expertise_match, weekly_promo_cap; else ok.

    promos(user_id, promos): the user's product posts of the last week.
    """
    out = requests.join(profiles.select("user_id", "is_paused"), "user_id", "left").join(opportunities.select("opportunity_id", "subreddit"), "opportunity_id", "left")
    out = out.join(subs.select("user_id", "subreddit", "matches_expertise"), ["user_id", "subreddit"], "left").join(promos.select("user_id", "promos"), "user_id", "left")
    reason = (
        F.when(F.col("is_paused"), "paused").when(F.col("subreddit").isNull(), "no_opportunity").when(F.col("matches_expertise").isNull(), "not_preexisting_active")
        .when(~F.col("matches_expertise"), "not_expertise_match").when(F.col("promos") >= cap, "weekly_promo_cap").otherwise("ok")
    )
    return out.select(*requests.columns, reason.alias("reason"))


# users


def user_stats(claims: DataFrame, posts: DataFrame, karma: DataFrame, now: Column, window: int = params.REMOVAL_WINDOW) -> DataFrame:
    """Per user: claims by state, upvotes of 30 days, removal rate of the last posts, and the latest karma with the number of snapshots."""
    by_state = claims.groupBy("user_id").agg(F.count_if(F.col("state") == "claimed").alias("claimed"), F.count_if(F.col("state") == "posted").alias("posted"))
    ups = posts.where(F.col("posted_at") >= now - F.expr("interval 30 days")).groupBy("user_id").agg(F.sum("upvotes").alias("upvotes"))
    order = Window.partitionBy("user_id").orderBy(F.desc("posted_at"), F.desc("post_id"))
    last = posts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= window)
    removed = last.groupBy("user_id").agg(F.avg(F.col("is_removed").cast("double")).alias("removal_rate"), rows_of().alias("removal_window"))
    level = karma.groupBy("user_id").agg(F.max_by("total", "taken_at").alias("karma"), rows_of().alias("snapshots"))
    out = by_state.join(ups, "user_id", "full_outer").join(removed, "user_id", "full_outer").join(level, "user_id", "full_outer")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select("user_id", zero("claimed", "long"), zero("posted", "long"), zero("upvotes", "double"), zero("removal_rate", "double"), zero("removal_window", "long"), "karma", zero("snapshots", "long"))


def active_communities(history: DataFrame, cutoffs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Communities in which a user was active strictly before their cutoff: posts, comments, first and last time.

    stored rows of the same (user, community) lend the earlier first and later last time; the counts are the new ones.
    """
    old = history.join(cutoffs, "user_id").where(F.col("at") < F.col("cutoff"))
    out = old.groupBy("user_id", "subreddit").agg(F.count_if(F.col("kind") == "submitted").alias("posts"), F.count_if(F.col("kind") != "submitted").alias("comments"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    if stored is None:
        return out
    s = stored.select("user_id", "subreddit", F.col("posts").alias("p"), F.col("comments").alias("c"), F.col("first_seen").alias("f"), F.col("last_seen").alias("l"))
    both = out.join(s, ["user_id", "subreddit"], "full_outer")
    return both.select("user_id", "subreddit", F.coalesce("posts", "p").alias("posts"), F.coalesce("comments", "c").alias("comments"), F.least("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"))


def latency_histogram(pairs: DataFrame, seconds: Column, buckets: tuple[int, ...] = params.LATENCY_BUCKETS) -> DataFrame:
    """(le, n): how many latencies are at most each bucket's bound, as text; the last bucket (+Inf) has all."""
    counts = pairs.select(seconds.alias("s")).where("s is not null").agg(*(F.count_if(F.col("s") <= b).alias(f"b{i}") for i, b in enumerate(buckets)), rows_of().alias("all"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    return counts.select(F.inline(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))))


def due_requests(requests: DataFrame, now: Column, grace_days: int = params.ERASE_GRACE_DAYS) -> DataFrame:
    """Pending erasure requests whose grace period is over, with when they fell due."""
    due = F.col("requested_at") + F.make_dt_interval(F.lit(grace_days))
    return requests.where("kind = 'delete' and status = 'pending'").withColumn("scheduled_for", due).where(F.col("scheduled_for") <= now)


# drafts, tasks and texts


def marker_count(body: Column) -> Column:
    """How many [VERIFY: ...] markers a text has; null has none."""
    return F.coalesce(F.regexp_count(body, F.lit(r"\[VERIFY:[^\]]*\]")), F.lit(0)).cast("long")


def draft_transitions(events: DataFrame, key: str, status: str, time: str, tie: str, allowed: dict[str | None, list[str]] | None = None) -> DataFrame:
    """events with the status before and whether the step is legal; a first event's status before is null."""
    allowed = params.DRAFT_STEPS if allowed is None else allowed
    before = F.lag(status).over(Window.partitionBy(key).orderBy(time, tie))
    legal = F.lit(False)
    for frm, to in allowed.items():
        legal = legal | ((F.col("before").isNull() if frm is None else F.col("before") == frm) & F.col(status).isin(*to))
    return events.withColumn("before", before).withColumn("legal", F.coalesce(legal, F.lit(False)))


def active_drafts(drafts: DataFrame, key: list[str], status: str, time: str, tie: str, ended: tuple[str, ...] = ("published", "discarded")) -> DataFrame:
    """Drafts that have not ended; of several for one key only the newest is active."""
    rest = [c for c in drafts.columns if c not in key]
    live = drafts.where(~F.col(status).isin(*ended))
    return live.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("m")).select(*key, "m.*")


def apply_transitions(tasks: DataFrame, updates: DataFrame, offset: int = params.TASK_ID_OFFSET) -> DataFrame:
    """tasks with the newest update's status, its reason where it gives one (else the old one stays), and the id of the opportunity that stands for the task."""
    last = updates.groupBy("task_id").agg(F.max_by("status", "at").alias("_status"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("at"))).alias("_reason"))
    out = tasks.join(last, "task_id", "left")
    changed = {"status": F.coalesce("_status", "status"), "dismiss_reason": F.coalesce("_reason", "dismiss_reason"), "opportunity_id": F.coalesce("finder_opportunity_id", F.lit(offset) + F.col("task_id"))}
    return out.withColumns(changed).drop("_status", "_reason")


def top_comments(comments: DataFrame, key: str, k: int, most: int) -> DataFrame:
    """The k comments of each key with the highest scores (null counts as 0), without empty bodies among them, cut to `most` characters."""
    from tallyfield.functions.columns import truncated

    score = F.coalesce("score", F.lit(0))
    ranked = comments.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), "comment_id"))).where(F.col("rank") <= k)
    return ranked.where(F.coalesce(F.length("body"), F.lit(0)) > 0).select(key, "comment_id", F.col("rank").cast("long").alias("rank"), score.cast("long").alias("score"), truncated("body", most).alias("body"))


def backfill_mentions(posts: DataFrame, aliases: list[str], text: str) -> DataFrame:
    """posts with mentions_product worked out anew from the aliases, between characters that are neither letters nor digits, and whether that changed it."""
    import re

    pattern = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(a) for a in aliases) + r")(?![\p{L}\p{N}])"
    now = F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)) if aliases else F.lit(False)
    return posts.withColumn("_now", now).withColumn("changed", ~F.col("mentions_product").eqNullSafe(F.col("_now"))).withColumn("mentions_product", F.col("_now")).drop("_now")
