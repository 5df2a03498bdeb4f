"""Order over a whole table, across the borders of partitions."""

import random

from pyspark.sql import functions as F

from cinderplan.operators import ordered


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abbbbbc"), rng.randrange(12), k, rng.choice([None, None, k])) for k in range(300)]
    d = spark.createDataFrame(rows, "g string, t int, id int, v int").repartition(7)
    rows.sort(key=lambda x: (x[0], x[1], x[2]))
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert ordered.placed(d, "g", "t", "id").select("_part").distinct().count() == parts
            got = {r.id: r.n for r in ordered.numbered(d, "g", "t", "id", name="n").collect()}
            assert got == {x[2]: k for k, x in enumerate(rows)}
            got = {r.id: r.n for r in ordered.followed(d, "g", "t", "id", value="t", name="n").collect()}
            assert got == {x[2]: y[1] if y else None for x, y in zip(rows, [*rows[1:], None], strict=True)}
            got = {r.id: r.n for r in ordered.carried(d, "g", "t", "id", keys=["g"], value="v", name="n").collect()}
            want, held = {}, {}
            for g, _, k, v in rows:
                held[g] = v if v is not None else held.get(g)
                want[k] = held[g]
            assert got == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_without_keys(spark):
    d = spark.createDataFrame([(3, None), (1, 7), (2, None)], "t int, v int")
    assert {r.t: r.n for r in ordered.carried(d, "t", keys=[], value="v", name="n").collect()} == {1: 7, 2: 7, 3: 7}
    none = d.limit(0)
    assert ordered.numbered(none, "t", name="n").count() == ordered.followed(none, "t", value="v", name="n").count() == ordered.carried(none, "t", keys=[], value="v", name="n").count() == 0
    assert ordered.numbered(d.select(F.lit(1).alias("t")), "t", name="n").count() == 3  # ties in all columns
