"""Raw session tables of the league: results, laps, weather, schedule and markers, as session files hold them.

A lap is a line of an order; its line number says in which session it was driven. Some cells are unknown, deleted or
unusable by rule, some sessions have no marker that can be read, and not every entrant has a qualifying result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.sources.league import NOT_A_RACE, league, table

KEYS = ("year", "round", "session")


#: What laps and weather take from a line.
LINE = ("year", "round", "code", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all orders with their event and entrant. Who needs both laps and weather may write them once."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("round"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"))
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(*LINE)


def session_name(line: Column, rnd: Column) -> Column:
    third = F.when(rnd % 3 == 0, "Sprint Qualifying").otherwise("Practice 3")
    return F.when(line == 1, "Practice 1").when(line == 2, "Practice 2").when(line == 3, third).when(line == 4, "Qualifying").otherwise("Race")


def laps(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Numbered laps. of: the lines, if they are written already."""
    key = F.col("l_orderkey")
    x = (lines(spark, sf_dir) if of is None else of).select(
        "year", "round", session_name(F.col("l_linenumber"), F.col("round")).alias("session"), "code",
        F.when(key % 17 != 0, 60 + F.col("l_extendedprice") / 10000).alias("seconds"), (key % 19 != 0).alias("accurate"),
        F.when(F.col("l_returnflag") == "N", "2").otherwise("1").alias("track"), (F.col("l_partkey") % 23 == 0).alias("pit_in"), (F.col("l_suppkey") % 29 == 0).alias("pit_out"),
        F.when(key % 13 == 0, "True").when(key % 3 == 0, "False").alias("deleted"), key.alias("k"), F.col("l_linenumber").alias("i"), F.col("l_extendedprice").alias("p"),
    )
    lap = F.row_number().over(Window.partitionBy(*KEYS, "code").orderBy("k", "i", "p"))
    return x.withColumn("lap", lap).drop("k", "i", "p")


def weather(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Readings of each event. of: the lines, if they are written already."""
    rain = F.col("l_returnflag") == "R"
    return (lines(spark, sf_dir) if of is None else of).select("year", "round", F.col("l_quantity").alias("air"), (F.col("l_tax") * 1000).alias("track"), (F.col("l_discount") * 1000).alias("humidity"), (F.col("l_extendedprice") / 1000).alias("wind"), rain.alias("rain"))


def results(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Results of races, of qualifying (not for all) and of sprints, with the columns that each has. of: the league, if it
    is written already."""
    h = league(spark, sf_dir) if of is None else of
    race = h.select("year", "round", F.lit("Race").alias("session"), "no", "driver", "code", "team", "position", "grid", "points", F.when(F.col("dnf"), "R").otherwise(F.coalesce(F.col("position").cast("int").cast("string"), F.lit("W"))).alias("classified"))
    quali = h.filter((F.col("year") + F.col("round") + F.col("no")) % 23 != 0).select("year", "round", F.lit("Qualifying").alias("session"), "no", "driver", "code", "team", F.col("quali").alias("position"), *(F.when((F.col("no") + i) % 5 != 0, 80 + F.col("quali_gap") - i / 8).alias(f"q{i}") for i in (1, 2, 3)))
    sprint = h.filter(F.col("round") % 3 == 0).select("year", "round", F.lit("Sprint").alias("session"), "no", "driver", "code", "team", F.col("quali").alias("position"))
    return race.unionByName(quali, allowMissingColumns=True).unionByName(sprint, allowMissingColumns=True)


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of all seasons, five sessions in each event."""
    names = {"standard": ("Practice 1", "Practice 2", "Practice 3", "Qualifying", "Race"), "sprint": ("Practice 1", "Sprint Qualifying", "Sprint", "Qualifying", "Race")}
    date = F.col("o_orderdate")
    x = table(spark, sf_dir, "orders").select(F.year(date).alias("year"), F.month(date).alias("round")).distinct()
    x = x.withColumn("circuit", (F.col("round") - 1) % 6)
    for i in range(5):
        name = F.when(F.col("round") % 3 == 0, names["sprint"][i]).otherwise(names["standard"][i])
        first = F.make_timestamp("year", "round", F.lit(5), F.lit(10), F.lit(0), F.lit(0))
        x = x.withColumn(f"session{i + 1}", name).withColumn(f"start{i + 1}", F.timestamp_add("HOUR", F.lit((0, 4, 24, 28, 51)[i]), first))
    return x


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker of each session that laps or results tell of: year, round, session, weather_rows, track_status_rows, missing,
    unreadable."""
    driven = laps(spark, sf_dir).groupBy(*KEYS).agg(F.count_if(F.col("track") == "2").alias("track_status_rows"))
    known = driven.join(results(spark, sf_dir).select(*KEYS).distinct(), list(KEYS), "full").fillna(0, ["track_status_rows"])
    readings = weather(spark, sf_dir).groupBy("year", "round").agg(F.count("*").alias("n"))
    dry = (F.col("year") + F.col("round") * 5) % 11 == 0
    return known.join(readings, ["year", "round"], "left").select(
        *KEYS, F.when(dry, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("weather_rows"), "track_status_rows", F.when(dry, F.array(F.lit("weather"))).otherwise(F.array().cast("array<string>")).alias("missing"),
        ((F.col("year") * 12 + F.col("round")) % 29 == 0).alias("unreadable"),
    )


def not_a_race(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOT_A_RACE), "year int, round int")


RAW_SQL = """, ln AS (
    SELECT l.*, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS round, 'N' || c_nationkey AS code
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), laps0 AS (
    SELECT year, round, CASE l_linenumber WHEN 1 THEN 'Practice 1' WHEN 2 THEN 'Practice 2' WHEN 3 THEN CASE WHEN round % 3 = 0 THEN 'Sprint Qualifying' ELSE 'Practice 3' END WHEN 4 THEN 'Qualifying' ELSE 'Race' END AS session,
        code, CASE WHEN l_orderkey % 17 <> 0 THEN 60 + l_extendedprice / 10000 END AS seconds, l_orderkey % 19 <> 0 AS accurate, CASE WHEN l_returnflag = 'N' THEN '2' ELSE '1' END AS track,
        l_partkey % 23 = 0 AS pit_in, l_suppkey % 29 = 0 AS pit_out, coalesce(l_orderkey % 13 <> 0, true) AS valid, l_orderkey, l_linenumber, l_extendedprice
    FROM ln
), rlaps AS (
    SELECT *, row_number() OVER (PARTITION BY year, round, session, code ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS lap FROM laps0
), rq AS (
    SELECT year, round, no, code, quali AS position, CASE WHEN (no + 1) % 5 <> 0 THEN 80 + quali_gap - 0.125 END AS q1, CASE WHEN (no + 2) % 5 <> 0 THEN 80 + quali_gap - 0.25 END AS q2,
        CASE WHEN (no + 3) % 5 <> 0 THEN 80 + quali_gap - 0.375 END AS q3 FROM league WHERE (year + round + no) % 23 <> 0
), rres AS (
    SELECT year, round, 'Race' AS session, code, position FROM league UNION ALL SELECT year, round, 'Qualifying', code, position FROM rq
    UNION ALL SELECT year, round, 'Sprint', code, quali FROM league WHERE round % 3 = 0
), rmk AS (
    SELECT k.*, CAST(CASE WHEN (k.year + k.round * 5) % 11 = 0 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS weather_rows, CASE WHEN (k.year + k.round * 5) % 11 = 0 THEN 'weather' ELSE '' END AS missing_tables,
        (k.year * 12 + k.round) % 29 = 0 AS unreadable, coalesce(tn, 0) AS track_rows
    FROM (SELECT year, round, session FROM rlaps UNION SELECT year, round, session FROM rres) k LEFT JOIN (SELECT year, round, count(*) AS n FROM ln GROUP BY year, round) w USING (year, round)
    LEFT JOIN (SELECT year, round, session, count(*) FILTER (track = '2') AS tn FROM rlaps GROUP BY ALL) t USING (year, round, session)
)"""
