"""Places in groups of which one has nearly all rows, with nearly all of these alike in the first key."""

from pyspark.sql import functions as F

from veilspark.operators import datasets as G
from veilspark.operators import numbering as N


def test_places_with_a_hot_group_and_a_hot_key(spark):
    rows = [("hot" if i % 10 else "cold", 7.0 if i % 20 else float(i), f"v{i * 7919 % 20000:05}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, first double, then string")
    want, sizes = {}, {}
    for g, first, then in sorted(rows):
        want[g, first, then] = sizes[g] = sizes.get(g, -1) + 1
    got = {(r.g, r.first, r.then): (r._place, r._size) for r in N.numbered(df, ["g"], "first", ["then"]).collect()}
    assert got == {k: (p, sizes[k[0]] + 1) for k, p in want.items()}
    parts = [r["count"] for r in N.dealt(df, ["g", "first", "then"]).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(parts) == 4 and max(parts) < 0.4 * len(rows)


def test_empty_and_ungrouped(spark):
    df = spark.createDataFrame([], "g string, first double, then string")
    assert N.numbered(df, ["g"], "first", ["then"]).collect() == []
    assert [r.position for r in G.slice_sample(spark.range(50), "id", (3, 40), 4).orderBy("position").collect()] == [3, 4, 5, 6, 40, 41, 42, 43]


def test_pairs_of_goals_with_no_or_all_controls(spark):
    tasks = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 9)], "task int, goal int")
    controls = spark.createDataFrame([(k, [1] if k < 3 else [2]) for k in range(5)] + [(k, [3]) for k in range(5)], "label int, goals array<int>")
    got = {}
    for r in G.pair_positive_negative(tasks, controls, "task", "goal", "label", "goals", "s").collect():
        got.setdefault((r.task, r.gold), []).append(r.label)
    assert sorted(got[1, "A"]) == [0, 1, 2] and sorted(got[1, "B"]) == [3, 4] and sorted(got[3, "A"]) == [3, 4]
    assert len(set(got[3, "B"])) == 3 and sorted(got[4, "A"]) == [0, 1, 2, 3, 4] and (4, "B") not in got
    assert len(set(got[5, "B"])) == 2 and (5, "A") not in got
