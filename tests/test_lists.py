"""Places and values carried down within groups, across runs."""

import random

from pyspark.sql import functions as F

from tessera.operators import lists


def test_places_and_values_by_group(spark):
    rng = random.Random(2)
    rows = [(g, i, str(i) if rng.random() < 0.002 else None) for g, n in (("a", 5000), ("b", 3), (None, 1500), ("c", 1)) for i in range(n)]
    d = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, i long, v string").repartition(7)
    places = lists.place_within(d, "g", F.col("i").desc(), name="nth").collect()
    size = {"a": 5000, "b": 3, None: 1500, "c": 1}
    assert len(places) == len(rows) and all(r.nth == size[r.g] - 1 - r.i for r in places)
    want, last = {}, {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        want[g, i] = last[g]
    got = {(r.g, r.i): r.filled for r in lists.filled_down(d, "g", F.col("i").asc(), F.col("v"), name="filled").collect()}
    assert got == want


def test_list_ranks(spark):
    after = [(i, i + 1 if i % 37 else None) for i in range(1, 500)]
    got = {r.item: (r.end, r.steps) for r in lists.list_ranks(spark.createDataFrame(after, "item long, after long")).collect()}
    assert all(got[i] == ((i + 36) // 37 * 37, -i % 37) for i in range(1, 482))
