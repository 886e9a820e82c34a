"""Distributed numbering equals plain Python: hot keys over several ranges, null keys, empty tables."""

import random

from pyspark.sql import functions as F

from quern.operators.ordering import numbered


def test_numbers_and_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id long, v long").repartition(5)
    for keys in ([], ["k"]):
        got = {r.id: (r._row, r._n, r._run_v, r._all_v) for r in numbered(df, keys, [F.desc("id")], ("v",)).collect()}
        want = {}
        for key in {r[0] if keys else 0 for r in rows}:
            part = sorted((r for r in rows if not keys or r[0] == key), key=lambda r: -r[1])
            run = 0
            for n, r in enumerate(part, 1):
                run += r[2]
                want[r[1]] = (n, len(part), run, sum(x[2] for x in part))
        assert got == want
    wide = numbered(df, ["k"], [F.col("id")])
    assert wide.columns == ["k", "id", "v", "_row", "_n"]
    assert numbered(df.where("false"), ["k"], [F.col("id")], ("v",)).count() == 0
    assert numbered(df.where("false"), [], [F.col("id")]).count() == 0
