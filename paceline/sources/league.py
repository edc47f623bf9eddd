"""A competition's fact table, derived from the star schema: one row per entrant and event.

An event is a month (year, round); entrants are nations and their teams regions. In the wide league, which grows with
the tables, events are days, entrants customers and teams nations. Results follow from the orders of the event: total price sets the finishing position, the number of orders the grid slot, the largest order the
qualifying position. Some cells are unknown or zero by rule, so that missing results, pit-lane starts and unusable
events occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
NOT_A_RACE = ((1996, 2), (1998, 6), (1999, 11))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def race_ok(year: Column, rnd: Column) -> Column:
    """Events that count: all but those listed."""
    bad = F.lit(False)
    for y, r in NOT_A_RACE:
        bad = bad | ((year == y) & (rnd == r))
    return ~bad


def league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in months: 25 entrants at most, and as many events, at every scale."""
    keys = [F.month("o_orderdate").alias("round"), F.col("n_nationkey").alias("no"), F.col("n_name").alias("driver"), F.col("r_name").alias("team")]
    return _results(spark, sf_dir, keys, "N", 6)


def wide_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in days, with their nations as teams: entrants, fields and histories grow with the scale."""
    keys = [F.dayofyear("o_orderdate").alias("round"), F.col("c_custkey").alias("no"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("driver"), F.col("n_name").alias("team")]
    return _results(spark, sf_dir, keys, "C", 24)


def _results(spark: SparkSession, sf_dir: str, keys: list[Column], prefix: str, circuits: int) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    o = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    price = F.col("o_totalprice")
    g = o.groupBy(F.year("o_orderdate").alias("year"), *keys).agg(
        F.round(F.sum(price), 2).alias("s"), F.count("*").alias("n"), F.max(price).alias("m"), F.min(price).alias("lo"),
        F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("f"),
    )
    race = Window.partitionBy("year", "round")

    def slot(c: str) -> Column:
        return F.row_number().over(race.orderBy(F.desc(c), "no")).cast("double")

    y, r, no = F.col("year"), F.col("round"), F.col("no")
    position = slot("s")
    points = F.coalesce(F.element_at(F.array(*map(F.lit, POINTS)), F.least(position, F.lit(10.0)).cast("int")), F.lit(0))
    mean = F.col("s") / F.col("n")
    h = g.select(
        "year", "round", "no", "driver", F.concat(F.lit(prefix), no.cast("string")).alias("code"), "team", ((r - 1) % circuits).alias("circuit"),
        F.when((y + r * 7 + no) % 41 != 0, position).alias("position"),
        F.when((y * 12 + r + no) % 37 == 0, F.lit(0.0)).otherwise(slot("n")).alias("grid"),
        slot("m").alias("quali"),
        ((F.max("m").over(race) / F.col("m") - 1) * 100).alias("quali_gap"),
        ((F.max(mean).over(race) / mean - 1) * 100).alias("pace_gap"),
        F.when(position <= 10, points).otherwise(0).cast("double").alias("points"),
        (F.col("f") * 2 > F.col("n")).alias("dnf"),
        race_ok(y, r).alias("race_ok"),
        F.when((y + r) % 9 != 0, ((y * 7 + r * 3) % 5) / 10.0).alias("wx_rain_frac"),
        (F.lit(20.0) + (y * 3 + r) % 15).alias("wx_air_temp"),
        F.when(F.col("n") > 2, (F.col("lo") / F.min("lo").over(race) - 1) * 100).alias("fp_best_gap"),
        F.when(F.col("n") > 3, (mean / F.min(mean).over(race) - 1) * 100).alias("fp_last_gap"),
    )
    return h


LEAGUE_SQL = """
WITH o AS (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS round, n_nationkey AS no,
        n_name AS driver, r_name AS team, o_totalprice AS p, o_orderstatus AS st
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
), g AS (
    SELECT year, round, no, driver, team, round(sum(p), 2) AS s, count(*) AS n, max(p) AS m, min(p) AS lo,
        sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS f
    FROM o GROUP BY year, round, no, driver, team
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY year, round ORDER BY s DESC, no) AS DOUBLE) AS pos,
        CAST(row_number() OVER (PARTITION BY year, round ORDER BY n DESC, no) AS DOUBLE) AS slot,
        CAST(row_number() OVER (PARTITION BY year, round ORDER BY m DESC, no) AS DOUBLE) AS quali, s / n AS mean
    FROM g
), league AS (
    SELECT year, round, no, driver, 'N' || no AS code, team, (round - 1) % 6 AS circuit,
        CASE WHEN (year + round * 7 + no) % 41 <> 0 THEN pos END AS position,
        CASE WHEN (year * 12 + round + no) % 37 = 0 THEN 0.0 ELSE slot END AS grid, quali,
        (max(m) OVER (PARTITION BY year, round) / m - 1) * 100 AS quali_gap,
        (max(mean) OVER (PARTITION BY year, round) / mean - 1) * 100 AS pace_gap,
        CAST(CASE WHEN pos > 10 THEN 0 ELSE [25, 18, 15, 12, 10, 8, 6, 4, 2, 1][CAST(pos AS INTEGER)] END AS DOUBLE) AS points,
        2 * f > n AS dnf,
        NOT ((year = 1996 AND round = 2) OR (year = 1998 AND round = 6) OR (year = 1999 AND round = 11)) AS race_ok,
        CASE WHEN (year + round) % 9 <> 0 THEN ((year * 7 + round * 3) % 5) / 10.0 END AS wx_rain_frac,
        CAST(20.0 + (year * 3 + round) % 15 AS DOUBLE) AS wx_air_temp,
        CASE WHEN n > 2 THEN (lo / min(lo) OVER (PARTITION BY year, round) - 1) * 100 END AS fp_best_gap,
        CASE WHEN n > 3 THEN (mean / min(mean) OVER (PARTITION BY year, round) - 1) * 100 END AS fp_last_gap
    FROM ranked
)"""

#: The same of customers in days.
WIDE_LEAGUE_SQL = (
    LEAGUE_SQL.replace("month(o_orderdate)", "dayofyear(o_orderdate)").replace("n_nationkey AS no", "c_custkey AS no").replace("n_name AS driver, r_name AS team", "'C' || c_custkey AS driver, n_name AS team")
    .replace("'N' || no AS code", "'C' || no AS code").replace("(round - 1) % 6 AS circuit", "(round - 1) % 24 AS circuit")
)
