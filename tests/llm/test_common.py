"""Connected components and the key filter."""

import random

from motorisk.llm import common
from pyspark.sql import functions as F


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    edges += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(3, 3), (-7, 2), (2, -7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = dict(tuple(x) for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in up if x not in alone}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_key_filter_keeps_all_members_and_few_others(spark, monkeypatch):
    df = spark.range(20000).select((F.col("id") * 7 - 5000).alias("k"))
    members = df.where("k % 9 = 0").select(F.col("k").alias("m"))
    n = members.count()
    kept = common.likely_members(df, "k", members, "m", n)
    assert kept.join(members, F.col("k") == F.col("m"), "left_semi").count() == n
    assert kept.count() < n + 0.15 * 20000
    monkeypatch.setattr(common, "FILTER_BITS", 64)                 # a full bitmap lets all pass
    assert common.likely_members(df, "k", members, "m", n).count() == 20000
    assert common.likely_members(df, "k", members.where("false"), "m", 0).count() == 0


def test_stages_are_deleted(spark):
    st = common.Stages(spark)
    df = st.write(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3
    import os
    path = df._stage_path.replace("file:", "")
    assert os.path.isdir(path)
    st.drop(df)
    assert not os.path.isdir(path)
