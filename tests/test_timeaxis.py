from pyspark.sql import functions as F

from tidelog.functions import timeaxis as ta

# around block edges with delay; an empty block in between and the last second of the day
SECONDS = [0, 899, 900, 2699, 2700, 2701, 3599, 3600, 84599, 84600, 84601, 86399]


def test_blocks_and_maturity_match_brute_force(spark):
    df = spark.createDataFrame([(s,) for s in SECONDS], "sec int")
    rows = df.select("sec", ta.block_of(F.col("sec"), 900).alias("b"),
                     ta.last_available_block(F.col("sec"), 900, 1800).alias("k"),
                     ta.update_block(F.col("sec"), 900, 1800).alias("u"),
                     ta.matured_by_midnight(F.col("sec")).alias("m")).collect()
    for r in rows:
        assert r["b"] == min(r["sec"] // 900, 95)
        assert r["k"] == max([k for k in range(96) if (k + 1) * 900 + 1800 <= r["sec"]], default=-1)
        assert r["u"] == min(u for u in range(200) if r["sec"] + 1800 <= (u + 1) * 900)
        assert r["m"] == (r["sec"] + 1800 <= 86400)


def test_usable_by_crosses_midnight(spark):
    df = spark.createDataFrame([(3, 84600), (3, 84601), (2, 86399)], "day int, sec int")
    got = [r[0] for r in df.select(ta.usable_by(F.col("day"), F.col("sec"), F.lit(4))).collect()]
    assert got == [True, False, True]


def test_hour_stamp(spark):
    df = spark.createDataFrame([(14102100,), (14102203,)], "s long")
    h = [r[0] for r in df.select(ta.hour_stamp_to_epoch_hours(F.col("s"))).collect()]
    assert h[1] - h[0] == 27
