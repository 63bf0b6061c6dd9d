"""Item labels: further rule sets, validation of structured replies, stratified samples and validation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import any_of, classify, col


def guessed_category(name: Column | str) -> Column:
    """The merge-time guess of a category, in its own taxonomy."""
    return classify(name, params.GUESS_RULES)


def reference_label(name: Column | str) -> Column:
    """The reference label of an item: the first rule with a keyword in the lower-cased name that none of its exclusions holds back."""
    low, out = F.lower(col(name)), F.lit("OTHER")
    for label, keywords in reversed(params.LABEL_RULES):
        hit = any_of(low, keywords)
        if label == "BEVERAGE":
            hit = hit & ~(low.contains("tea") & (low.contains("cake") | low.contains("leaf")))
        elif label == "RICE_DISH":
            hit = hit & ~low.contains("noodle")
        out = F.when(hit, label).otherwise(out)
    return out


LABEL = "struct<item: string, category: string, quality_signals: array<string>, language_detected: string, confidence: string>"


def unfenced(text: Column | str) -> Column:
    """A reply without the code fence around it, if it has one."""
    x = F.trim(F.regexp_replace(col(text), r"^\s+|\s+$", ""))
    body = F.regexp_replace(F.regexp_replace(x, r"^```[^\n]*\n?", ""), r"\n[ \t]*```[ \t]*$", "")
    return F.regexp_replace(F.when(x.startswith("```"), body).otherwise(x), r"^\s+|\s+$", "")


def validated(raw: Column, item: Column) -> Column:
    """A label struct with the category held to the known ones, unknown signals gone, confidence in 0..1 (0.5 where it is no number) and the language defaulting to en."""
    category = F.when(raw["category"].isin(*params.CATEGORIES), raw["category"]).otherwise("OTHER")
    signals = F.filter(F.coalesce(raw["quality_signals"], F.array().cast("array<string>")), lambda s: s.isin(*params.SIGNAL_RULES))
    number = raw["confidence"].try_cast("double")
    confidence = F.when(number.isNull() | F.isnan(number), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    language = F.coalesce(F.nullif(raw["language_detected"], F.lit("")), F.lit("en"))
    return F.struct(F.coalesce(raw["item"], item).alias("item"), category.alias("category"), signals.alias("quality_signals"), language.alias("language_detected"), confidence.alias("confidence"))


def parse_label_response(batches: DataFrame, items: str = "items", reply: str = "reply") -> DataFrame:
    """One row per item of batches(batch_id, items array, reply): its place and its validated label.

    The reply is a JSON list, perhaps in a code fence, in any order; an item takes the last entry
    that names it exactly, else the one that names it trimmed, else the defaults.
    """
    parsed = batches.withColumn("_raw", F.from_json(unfenced(reply), f"array<{LABEL}>"))
    asked = parsed.select("batch_id", "_raw", F.posexplode(items).alias("place", "item"))
    named = lambda name: F.try_element_at(F.filter("_raw", lambda r: r["item"] == name), F.lit(-1))
    raw = F.coalesce(named(F.col("item")), named(F.trim("item")), F.lit(None).cast(LABEL))
    return asked.withColumn("_entry", raw).select("batch_id", "place", validated(F.col("_entry"), F.col("item")).alias("label")).select("batch_id", "place", "label.*")


def stratified_sample(df: DataFrame, by: str, n: int, seed: str, key: str) -> DataFrame:
    """n rows of df: an equal share of each stratum, topped up from the rest, each in the order of md5(key, seed).

    The strata are counted once; a row's place in its stratum is a window over the stratum, the top-up one bounded sort.
    """
    mark = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    strata = df.select(by).distinct().count()
    if not strata:
        return df.limit(0)
    each = max(1, n // strata)
    rows = df.withColumn("_mark", mark).withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_mark", key)))
    return rows.orderBy(F.col("_k") > each, "_mark", key).limit(n).drop("_mark", "_k")


def validation_summary(rows: DataFrame, outlier: str = "outlier", confidence: str = "confidence", country: str = "country_code") -> DataFrame:
    """(kind, value, n): rows in all, outliers, without enough data and clean, then by confidence and by country."""
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(outlier) == "yes").alias("outliers"), F.count_if(F.col(outlier) == "insufficient_data").alias("insufficient"))
    cells = [F.struct(F.lit("items").alias("kind"), F.lit(k).alias("value"), v.alias("n")) for k, v in (("total", F.col("total")), ("outliers", F.col("outliers")), ("insufficient", F.col("insufficient")), ("clean", F.col("total") - F.col("outliers") - F.col("insufficient")))]
    out = total.select(F.inline(F.array(*cells)))
    for kind, c, none in (("confidence", confidence, "unknown"), ("country", country, "?")):
        value = F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none)).alias("value")
        out = out.unionByName(rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n"))
    return out


def label_histograms(df: DataFrame, category: str, signals: str, language: str) -> DataFrame:
    """(kind, value, n) of categories, of each signal of a JSON array (what is none counts nothing), and of languages; nulls under null."""
    found = F.transform(F.coalesce(F.from_json(signals, "array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("signal").alias("kind"), x.alias("value")))
    rest = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("category", category), ("language", language))))
    return df.select(F.inline(F.concat(rest, found))).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
