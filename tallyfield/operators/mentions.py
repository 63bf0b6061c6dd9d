"""Entity mentions in text: detection, share of voice, trends, costs and gap tasks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield import params
from tallyfield.functions.columns import community, host, mention_pattern

def rows_of():
    """Number of rows, as an aggregate."""
    return F.count(F.lit(1))


#: Aliases of a block of the dictionary, which every worker holds whole.
ALIASES = 200_000
#: Texts whose mentions a worker holds at a time.
TEXTS = 100
_TOKEN, _WORDLIKE = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]")


def _lowered(text: str) -> str:
    """text in lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class AliasIndex:
    """An inverted dictionary: aliases by their first token, found in a text by looking up its tokens.

    rows: (entity, rank, alias), an alias of none for an entity without any. An alias stands between characters that are neither letters nor
    digits, case aside; of an entity's aliases at one place that of the least rank counts, and its
    mentions don't overlap.
    """

    def __init__(self, rows: list[tuple[int, int, str]]):
        self.by_token: dict[str, list[tuple[int, int, int, str]]] = defaultdict(list)
        self.bare = []  # aliases without a letter or digit
        self.entities = sorted({entity for entity, _, _ in rows})
        for entity, rank, alias in rows:
            if not alias:
                continue
            alias = _lowered(alias)
            if token := _TOKEN.search(alias):
                self.by_token[token[0]].append((entity, rank, token.start(), alias))
            else:
                self.bare.append((entity, rank, len(alias), re.compile(rf"(?<![^\W_])(?={re.escape(alias)}(?![^\W_]))")))

    def mentions(self, text: str) -> list[tuple[int, int, int]]:
        """(entity, start, end) of all mentions, by entity and place."""
        low, hits = _lowered(text), defaultdict(list)
        for m in _TOKEN.finditer(low):
            for entity, rank, offset, alias in self.by_token.get(m[0], ()):
                at = m.start() - offset
                end = at + len(alias)
                if at >= 0 and low.startswith(alias, at) and not (at and _WORDLIKE.match(low, at - 1)) and not _WORDLIKE.match(low, end):
                    hits[entity].append((at, rank, end))
        for entity, rank, size, pattern in self.bare:
            hits[entity] += [(m.start(), rank, m.start() + size) for m in pattern.finditer(low)]
        out = []
        for entity in sorted(hits):
            last = 0
            for at, _, end in sorted(hits[entity]):
                if at >= last:
                    out.append((entity, at, end))
                    last = end
        return out


def _blocks(entities: DataFrame) -> Iterator[list[tuple[int, int, str]]]:
    """The dictionary (entity_id, rank, alias), an entity's aliases together, in blocks of about ALIASES: its name first, then its aliases in order."""
    names = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x != "")
    rows = entities.where("entity_id is not null").select(F.col("entity_id").cast("long").alias("entity_id"), F.posexplode_outer(names).alias("rank", "alias"))
    n = -(-rows.count() // ALIASES)
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("entity_id"), F.lit(n)) == k).collect()]


def _searched(texts: DataFrame, keep: list[str], text: str, entities: DataFrame, found, more: str) -> DataFrame:
    """keep... and what found(text, index) gives for each text, for every block of the dictionary."""
    names = more.split()[::2]

    def worker(sent):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = AliasIndex(sent.value)
            for batch in batches:
                for b in (batch.slice(k, TEXTS) for k in range(0, batch.num_rows, TEXTS)):
                    row, out = [], []
                    for i, x in enumerate(b["_text"]):
                        for r in found(x.as_py(), own):
                            row.append(i)
                            out.append(r)
                    columns = zip(*out, strict=True) if out else [[] for _ in names]
                    kinds = [pa.string() if k.startswith("string") else pa.int64() for k in more.split()[1::2]]
                    yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(row, pa.int64())) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *names])

        return work

    rows = texts.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    schema = StructType(rows.drop("_text").schema.fields + StructType.fromDDL(more).fields)
    parts = [rows.mapInArrow(worker(texts.sparkSession.sparkContext.broadcast(block)), schema) for block in _blocks(entities)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)


def _counted(text: str, index: AliasIndex) -> Iterator[tuple[int, int]]:
    return ((entity, len(list(group))) for entity, group in groupby(index.mentions(text), key=itemgetter(0)))


def _every(text: str, index: AliasIndex) -> Iterator[tuple[int, int]]:
    n = dict(_counted(text, index))
    return ((entity, n.get(entity, 0)) for entity in index.entities)


def _named(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    return rows.join(entities.select(F.col("entity_id").cast("long").alias("entity_id"), *columns), "entity_id")


def mention_counts(runs: DataFrame, entities: DataFrame, every: bool = False) -> DataFrame:
    """How often each run of runs(run_id, ..., raw_response) mentions each entity that it mentions; with `every` each entity, 0 and (without a text) null included.

    The texts are read once for each block of the dictionary, and a text costs a look-up for each of
    its tokens, however many aliases there are.
    """
    keep = [c for c in runs.columns if c not in ("raw_response", "lang")]
    rows = _searched(runs, keep, "raw_response", entities, _every if every else _counted, "entity_id long, n long")
    if every:
        known = entities.where("entity_id is not null").select(F.col("entity_id").cast("long").alias("entity_id"), F.lit(None).cast("long").alias("n")).distinct()
        rows = rows.unionByName(runs.where("raw_response is null").select(*keep).crossJoin(known))
    return _named(rows, entities, "name", "entity_type").select(*keep, "entity_id", "name", "entity_type", "n")


def find_mentions(texts: DataFrame, entities: DataFrame, text: str, around: int = 100) -> DataFrame:
    """One row per mention: its place (0-based) and the text up to `around` characters on either side."""
    keep = [c for c in texts.columns if c != text]

    def placed(x: str, index: AliasIndex) -> Iterator[tuple]:
        for entity, group in groupby(index.mentions(x), key=itemgetter(0)):
            for k, (_, a, z) in enumerate(group):
                yield entity, k, x[a:z], a, x[max(0, a - around) : z + around]

    rows = _searched(texts, keep, text, entities, placed, "entity_id long, ord long, match string, position long, context string")
    return _named(rows, entities, "name").select(*keep, "entity_id", "name", "ord", "match", "position", "context")


def detect_aliases(texts: DataFrame, text: str, aliases: list[str]) -> DataFrame:
    """texts with the aliases found in each and whether there is any."""
    found = F.filter(F.array(*(F.when(F.regexp_like(text, mention_pattern(F.lit(a))), F.lit(a)) for a in aliases)), lambda x: x.isNotNull())
    return texts.withColumn("matched", found).withColumn("mentioned", F.size("matched") > 0)


def share_of_voice(rows: DataFrame) -> DataFrame:
    """By source and entity: mentions, recommendations, share of the source's mentions and mean rank. rows: one per mention."""
    by = rows.groupBy("source", "entity_id").agg(rows_of().alias("mentions"), F.count_if("is_recommendation").alias("recommendations"), F.avg("rank").alias("mean_rank"))
    return by.withColumn("share", F.col("mentions") / F.sum("mentions").over(Window.partitionBy("source")))


def mention_trend(rows: DataFrame, bucket: str) -> DataFrame:
    """Mentions and recommendations by day or week and entity."""
    return rows.groupBy(F.date_trunc(bucket, "run_date").cast("date").alias("bucket"), "entity_id").agg(rows_of().alias("mentions"), F.count_if("is_recommendation").alias("recommendations"))


def parse_sentiment(df: DataFrame, column: str) -> DataFrame:
    """sentiment (positive, negative or neutral, else neutral) and is_recommendation of the JSON object inside a reply."""
    x = F.from_json(F.regexp_extract(column, "(?s)\\{.*\\}", 0), "sentiment string, is_recommendation boolean")
    mood = F.lower(x["sentiment"])
    return df.withColumn("sentiment", F.when(mood.isin("positive", "negative", "neutral"), mood).otherwise("neutral")).withColumn("is_recommendation", F.coalesce(x["is_recommendation"], F.lit(False)))


def cached_scores(contexts: DataFrame, cache: DataFrame) -> DataFrame:
    """contexts with the cached score of (sha256 of the context, entity); misses have a null sentiment."""
    return contexts.withColumn("text_hash", F.sha2("context", 256)).join(cache, ["text_hash", "entity_id"], "left")


def cache_misses(scored: DataFrame) -> DataFrame:
    return scored.where("sentiment is null").select("text_hash", "entity_id").distinct()


def ingest_runs(target: DataFrame, updates: DataFrame, force: bool = False) -> DataFrame:
    """target with the runs of updates, the first run_id of each (query, source, day); a day that is there already stays, or with `force` is replaced."""
    from tallyfield.operators.clean import append_new, upsert

    keys = ["query_id", "source", "run_date"]
    if not force:
        return append_new(target, updates, keys, "run_id")
    return upsert(target, append_new(updates.limit(0), updates, keys, "run_id"), keys)


def cost_decisions(runs: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Runs in order of a day with the source's cents used before and whether the next fits under its cap (0 or less: no cap)."""
    from tallyfield.functions.columns import lookup

    before = Window.partitionBy("source", "run_date").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    cap = lookup("source", caps, 0)
    out = runs.withColumn("used", F.coalesce(F.sum("cost_cents").over(before), F.lit(0).cast("long")))
    return out.withColumn("allowed", (cap <= 0) | (F.col("used") + F.col("cost_cents") <= cap))


def ranked_mentions(items: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    """items(run_id, array of text) as one row per mentioning item and entity, with its 1-based rank."""
    flat = items.select("run_id", F.posexplode(text).alias("at", "item")).select("run_id", (F.col("at") + 1).cast("long").alias("rank"), "item")
    return _searched(flat, ["run_id", "rank"], "item", entities, _counted, "entity_id long, n long").select("run_id", "entity_id", "rank")


def url_parts(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn("host", host(url)).withColumn("community", community(url))


def union_first(dfs: list[DataFrame], key: str) -> DataFrame:
    """All rows' keys once, from the first table that has them."""
    from functools import reduce

    tagged = [d.withColumn("pass", F.lit(i)) for i, d in enumerate(dfs)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "pass").alias("m")).select(key, "m.*")


def gap_absent_brand(runs: DataFrame, counts: DataFrame, entities: DataFrame, citations: DataFrame, model_source: str, search_source: str, forum: str, now: Column) -> DataFrame:
    """(query_id, entity_id, url): brands that no model run of the window mentions, with the forum urls among the latest search run's first citations."""
    recent = runs.where(F.col("run_date") > F.date_sub(now, params.GAP_DAYS))
    asked = recent.where(F.col("source") == model_source).select("query_id").distinct()
    brands = entities.where("entity_type = 'brand'").select("entity_id").distinct()
    seen = counts.where((F.col("n") > 0) & (F.col("source") == model_source) & (F.col("run_date") > F.date_sub(now, params.GAP_DAYS))).select("query_id", "entity_id").distinct()
    absent = asked.join(brands).join(seen, ["query_id", "entity_id"], "left_anti")
    last = recent.where(F.col("source") == search_source).groupBy("query_id").agg(F.max(F.struct("run_date", "run_id")).alias("m")).select("query_id", F.col("m.run_id").alias("run_id"))
    urls = citations.join(last, "run_id").where(F.col("place") <= params.GAP_TOP).where(host("url").endswith(forum)).select("query_id", "url").distinct()
    return absent.join(urls, "query_id")


def gap_dominant(runs: DataFrame, counts: DataFrame, citations: DataFrame, model_source: str, forum_source: str, now: Column, share: float = params.DOMINANT) -> DataFrame:
    """(query_id, entity_id, share, url, community): competitors in at least that share of a query's model runs, with the thread to answer in.

    Runs are those of the window's days. The thread is the first citation (place 1) of the query's
    latest forum run; queries without such a run or citation, or whose forum run mentions a brand,
    give nothing. A query may have mentions of brands in its model runs all the same.
    """
    recent = runs.where(F.col("run_date") > F.date_sub(now, params.GAP_DAYS))
    own = counts.where(F.col("n") > 0)
    total = recent.where(F.col("source") == model_source).groupBy("query_id").agg(F.count_distinct("run_id").alias("runs"))
    asked = own.where((F.col("source") == model_source) & (F.col("entity_type") == "competitor")).join(recent.select("run_id").distinct(), "run_id", "left_semi")
    hit = asked.groupBy("query_id", "entity_id").agg(F.count_distinct("run_id").alias("hits")).join(total, "query_id").withColumn("share", F.col("hits") / F.col("runs")).where(F.col("share") >= share)
    last = recent.where(F.col("source") == forum_source).groupBy("query_id").agg(F.max(F.struct("run_date", "run_id"))["run_id"].alias("run_id"))
    quiet = last.join(own.where("entity_type = 'brand'").select("run_id"), "run_id", "left_anti")
    thread = citations.where(F.col("place") == 1).groupBy("run_id").agg(F.min("url").alias("url"))
    return hit.join(quiet.join(thread, "run_id").drop("run_id"), "query_id").select("query_id", "entity_id", "share", "url", community("url").alias("community"))


def linked_tasks(tasks: DataFrame, opportunities: DataFrame) -> DataFrame:
    """tasks(..., related_url) with opportunity_id: the smallest id of an opportunity(opportunity_id, post_url) whose url is the task's; null without one."""
    first = opportunities.where("post_url <> ''").groupBy("post_url").agg(F.min("opportunity_id").alias("opportunity_id"))
    return tasks.join(first, F.col("related_url") == F.col("post_url"), "left").drop("post_url")


def new_tasks(candidates: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no task equals on the keys, nulls being equal to nulls."""
    from functools import reduce

    t = tasks.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (candidates[k].eqNullSafe(t[f"_{k}"]) for k in keys))
    return candidates.join(t, same, "left_anti")
