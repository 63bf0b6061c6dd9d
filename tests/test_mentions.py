"""Mentions in lists of items and in runs: every place, every pair."""

from tallyfield.operators import mentions

ENTITIES = [(1, "Acme", "brand", ["acme corp"]), (2, "Bolt", "competitor", None)]
KINDS = "entity_id long, name string, entity_type string, aliases array<string>"


def test_ranked_mentions_go_by_place(spark):
    items = spark.createDataFrame([(7, ["bolt and ACME corp", None, "acme, Acme", "bolts"]), (8, [])], "run_id long, items array<string>")
    got = mentions.ranked_mentions(items, spark.createDataFrame(ENTITIES, KINDS), "items")
    assert sorted(map(tuple, got.select("run_id", "entity_id", "rank").collect())) == [(7, 1, 1), (7, 1, 3), (7, 2, 1)]


def test_counts_of_every_pair(spark):
    """Entities that a run does not mention count 0; without a text there is no number, without an alias nothing to find."""
    runs = spark.createDataFrame([(1, "acme, ACME corp and Acme"), (2, "nobody"), (3, None)], "run_id long, raw_response string")
    entities = spark.createDataFrame([*ENTITIES, (3, "", "brand", [""])], KINDS)
    got = mentions.mention_counts(runs, entities, every=True).select("run_id", "entity_id", "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 3), (1, 2, 0), (1, 3, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0), (3, 1, None), (3, 2, None), (3, 3, None)], key=repr)
    assert sorted(map(tuple, mentions.mention_counts(runs, entities).select("run_id", "entity_id", "n").collect())) == [(1, 1, 3)]
