from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelkit.operators import resample
from panelkit.operators.resample import random_bits, sample_per_group


def strata(spark, sizes):
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, id int")


def draw(df, n, reps, **options):
    return resample.resample(df, "g", n, reps, F.floor(F.col("id") / 16), ["id"], **options)


SIZES = {"few": 3, "equal": 10, "more": 35, "large": 400}


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_sizes_and_no_repeats(spark, method):
    rows = draw(strata(spark, SIZES), 10, 6, method=method).collect()
    for g, size in SIZES.items():
        for rep in range(1, 7):
            ids = [r["id"] for r in rows if r["g"] == g and r["sample_id"] == rep]
            assert len(ids) == len(set(ids)) == min(10, size)
            assert set(ids) <= set(range(size))


def test_null_strata_are_strata(spark):
    rows = [(None, i) for i in range(5)] + [("a", i) for i in range(4)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, id int")
    got = draw(df, 50, 2).collect()
    assert len(got) == 2 * len(rows)
    assert sum(r["g"] is None for r in got) == 10


def test_draws_are_not_broadcast(spark):
    df = spark.range(400_000).select((F.col("id") % 4).alias("g"), F.col("id"))
    drawn = resample.resample(df, "g", 500, 400, F.floor(F.col("id") / 1024), ["id"])
    assert drawn.agg(F.count("id")).first()[0] == 800_000
    query = drawn._jdf.queryExecution()
    drawn._jdf.queryExecution().executedPlan().execute().count()
    final = query.executedPlan().toString().split("Initial Plan")[0]
    above = final[: final.index("aggregate(sequence")] if "aggregate(sequence" in final else final
    assert "SortMergeJoin" in final
    assert "BroadcastHashJoin" not in above.split("SortMergeJoin")[0]


def test_same_seed_same_rows_other_seed_other_rows(spark):
    df = strata(spark, SIZES)

    def key(d):
        return sorted((r["g"], r["id"], r["sample_id"]) for r in d.collect())

    first = key(draw(df, 10, 3))
    assert first == key(draw(df.repartition(11), 10, 3))
    assert first != key(draw(df, 10, 3, seed=2022))


@pytest.mark.parametrize("size", [40, 100])
def test_every_row_is_drawn_about_equally_often(spark, size):
    reps, n = 800, 10
    counts = draw(strata(spark, {"s": size}), n, reps).groupBy("id").count().collect()
    assert len(counts) == size
    p = n / size
    spread = (reps * p * (1 - p)) ** 0.5
    assert all(abs(r["count"] - reps * p) < 5 * spread for r in counts)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 65, 4095, 4097, 1_000_003])
def test_positions_are_distinct_and_inside(spark, size):
    sizes = spark.createDataFrame([("s", size)], "g string, _size long")
    rows = resample.draw_positions(sizes, "g", 300, 5, 1).groupBy("sample_id").agg(F.collect_list("_pos").alias("p")).collect()
    assert len(rows) == 5
    for r in rows:
        assert len(r["p"]) == len(set(r["p"])) == min(300, size)
        assert 0 <= min(r["p"]) and max(r["p"]) < size
    if size > 4000:
        assert len({tuple(r["p"]) for r in rows}) == 5
        assert all(0.4 * size < sum(r["p"]) / 300 < 0.6 * size for r in rows)


def test_pairs_of_rows_are_drawn_about_equally_often(spark):
    counts = {}
    drawn = draw(strata(spark, {"s": 12}), 3, 3000).groupBy("sample_id").agg(F.sort_array(F.collect_set("id")).alias("s")).collect()
    for r in drawn:
        for a in range(3):
            for b in range(a + 1, 3):
                k = (r["s"][a], r["s"][b])
                counts[k] = counts.get(k, 0) + 1
    p = 3 / 66
    spread = (3000 * p * (1 - p)) ** 0.5
    assert len(counts) == 66 and all(abs(c - 3000 * p) < 5 * spread for c in counts.values())


def test_data_is_not_multiplied_by_the_replicates(spark):
    plan = draw(strata(spark, SIZES), 10, 5000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    physical = draw(strata(spark, SIZES), 10, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Python" not in physical


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_group_sample_equals_ordering_whole_groups(spark, method):
    df = strata(spark, {"a": 5000, "b": 30, "c": 4}).union(
        spark.createDataFrame([(None, i) for i in range(40)], "g string, id int")
    )
    got = sample_per_group(df, ["g"], 25, ["g", "id"], method=method).collect()
    bits = df.withColumn("h", random_bits([F.lit(2021), "g", "id"], method)).collect()
    for g in ("a", "b", "c", None):
        best = sorted((r["h"], r["id"]) for r in bits if r["g"] == g)[:25]
        assert sorted(r["id"] for r in got if r["g"] == g) == sorted(i for _, i in best)


def test_group_sample_shuffles_about_n_rows(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), "id")
    rows = df.withColumn("h", random_bits([F.lit(2021), "id"]))
    band = F.floor(-8 * F.log2((F.col("h") + 1) / F.lit(float(1 << 60))))
    counts = rows.groupBy(band.alias("k")).count().orderBy(F.desc("k")).collect()
    total = 0
    for r in counts:
        total += r["count"]
        if total >= 100:
            break
    assert 100 <= total < 160
    assert sample_per_group(df, ["g"], 100, ["id"]).count() == 100


def test_bits_are_uniform_and_not_negative(spark):
    for method in ("xxhash64", "md5"):
        row = (
            spark.range(20_000)
            .select((random_bits(["id"], method) / F.lit(float(1 << 60))).alias("u"))
            .agg(F.min("u"), F.max("u"), F.avg("u"))
            .first()
        )
        assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.01
    with pytest.raises(ValueError):
        random_bits(["id"], "rand")


def test_data_is_shuffled_once(spark):
    df = strata(spark, SIZES).withColumn("wide", F.col("id") * 2)
    plan = draw(df, 10, 6)._jdf.queryExecution().executedPlan().executedPlan()
    found = []

    def walk(node):
        if "Exchange" in node.nodeName() and "wide#" in node.output().mkString(","):
            found.append(node.nodeName())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len(found) == 1


def test_draws_are_dealt_to_several_tasks(spark):
    sizes = spark.createDataFrame([("s", 1000)], "g string, _size long")
    assert resample.draw_positions(sizes, "g", 5, 40, 1).rdd.getNumPartitions() > 1


def test_drawn_rows_stand_at_the_drawn_numbers(spark):
    """Blocks longer and shorter than the spans of the look-up."""
    df = strata(spark, {"a": 3000, "b": 700, "c": 1})
    sizes = df.groupBy("g").agg(F.count("id").alias("_size"))
    numbers = resample.draw_positions(sizes, "g", 200, 4, 7)
    expected = sorted((r["g"], r["sample_id"], r["_pos"]) for r in numbers.collect())
    for rows in (1, 16, 100_000):
        got = resample.resample(df, "g", 200, 4, F.floor(F.col("id") / rows), ["id"], 7).collect()
        assert sorted((r["g"], r["sample_id"], r["id"]) for r in got) == expected
