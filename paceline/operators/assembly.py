"""The fact table from raw session tables: one row per entrant and race, and what is known of both.

All joins are left joins of the race results with tables of at most one row per key, so no row is lost or doubled. A
race without an event of the calendar is refused when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import dnf_flag, percent_gap, team_key
from paceline.operators.sessions import earlier_sessions, not_deleted

RACE = ("year", "round")
PQ = ("pq_fp_best_gap", "pq_fp_last_gap", "pq_fp_n", "pq_sprintq_pos", "pq_sprintq_gap", "pq_sprint_pos")
WEATHER = {"wx_air_temp": "air", "wx_track_temp": "track", "wx_humidity": "humidity", "wx_wind_speed": "wind"}


def keys_in(table: DataFrame, keys: DataFrame, present: bool = True) -> DataFrame:
    """The rows of table whose event is, or is not, among the keys."""
    return table.join(keys.select(*RACE).distinct(), list(RACE), "left_semi" if present else "left_anti")


def unmatched(results: DataFrame, schedule: DataFrame) -> DataFrame:
    """Events with results that the calendar lacks."""
    return keys_in(results.select(*RACE).distinct(), schedule, present=False)


def clean_laps(laps: DataFrame) -> DataFrame:
    """Timed, accurate, on a clear track, neither into nor out of the pits, not deleted."""
    return laps.filter(F.col("seconds").isNotNull() & F.col("accurate") & (F.col("track") == "1") & ~F.col("pit_in") & ~F.col("pit_out") & not_deleted())


def race_pace(laps: DataFrame, least_laps: int = 5, least_drivers: int = 10) -> DataFrame:
    """Each entrant's median clean race lap against the median of those medians."""
    own = clean_laps(laps.filter("session = 'Race'")).groupBy(*RACE, "code").agg(F.percentile("seconds", 0.5).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least_laps)
    field = own.groupBy(*RACE).agg(F.percentile("m", 0.5).alias("f"), F.count("*").alias("d")).filter(F.col("d") >= least_drivers)
    return own.join(field, list(RACE)).select(*RACE, "code", percent_gap(F.col("m"), F.col("f")).alias("pace_gap"))


def best_gaps(laps: DataFrame) -> DataFrame:
    """year, round, session, code, gap: the best lap against the session's best, in percent."""
    best = laps.filter(F.col("seconds").isNotNull() & not_deleted()).groupBy(*RACE, "session", "code").agg(F.min("seconds").alias("best"))
    return best.withColumn("gap", percent_gap(F.col("best"), F.min("best").over(Window.partitionBy(*RACE, "session")))).drop("best")


def weekend_features(schedule: DataFrame, laps: DataFrame, results: DataFrame, entrants: DataFrame) -> DataFrame:
    """The PQ columns for all entrants (year, round, code), from sessions that start before qualifying.

    The number of practice sessions with data is the same for all in an event, 0 without any. The last gap is that of
    the last such session only.
    """
    early = earlier_sessions(schedule).select(*RACE, F.col("name").alias("session"), "kind", "slot")
    gaps = best_gaps(laps).join(early, [*RACE, "session"])
    practice = gaps.filter("kind = 'practice'")
    event = practice.groupBy(*RACE).agg(F.countDistinct("session").cast("double").alias("pq_fp_n"), F.max("slot").alias("final"))
    own = practice.join(event, list(RACE)).groupBy(*RACE, "code").agg(F.min("gap").alias("pq_fp_best_gap"), F.max(F.when(F.col("slot") == F.col("final"), F.col("gap"))).alias("pq_fp_last_gap"))
    order = F.rank().over(Window.partitionBy(*RACE).orderBy("gap")).cast("double")
    sprintq = gaps.filter("kind = 'sprint_qualifying' AND gap IS NOT NULL").select(*RACE, "code", F.col("gap").alias("pq_sprintq_gap"), order.alias("pq_sprintq_pos"))
    sprint = results.join(early.filter("kind = 'sprint'").select(*RACE, "session"), [*RACE, "session"]).select(*RACE, "code", F.col("position").alias("pq_sprint_pos"))
    out = entrants.select(*RACE, "code").join(event.drop("final"), list(RACE), "left")
    for part in (own, sprintq, sprint):
        out = out.join(part, [*RACE, "code"], "left")
    return out.withColumn("pq_fp_n", F.coalesce("pq_fp_n", F.lit(0.0))).select(*RACE, "code", *PQ)


def race_weather(readings: DataFrame) -> DataFrame:
    return readings.groupBy(*RACE).agg(*(F.avg(c).alias(k) for k, c in WEATHER.items()), F.avg(F.col("rain").cast("double")).alias("wx_rain_frac"))


def weather_features(history: DataFrame) -> DataFrame:
    """The five readings of each event and whether it is wet, unknown where the rain is."""
    return history.select(*RACE, *WEATHER, "wx_rain_frac").distinct().withColumn("wx_is_wet", (F.col("wx_rain_frac") > 0).cast("double"))


def quali_table(results: DataFrame) -> DataFrame:
    q = results.filter("session = 'Qualifying'")
    best = F.least("q1", "q2", "q3")
    return q.select(*RACE, "code", F.col("position").alias("quali"), percent_gap(best, F.min(best).over(Window.partitionBy(*RACE))).alias("quali_gap"))


def build_history(results: DataFrame, schedule: DataFrame, laps: DataFrame, readings: DataFrame, quality: DataFrame, not_a_race: DataFrame) -> DataFrame:
    """The fact table. Pace is dropped where the audit finds laps unfit; race_ok needs fit results and a real race.

    Rows are in no order; ordered() sorts them by a key that is known before the race.
    """
    races = results.filter("session = 'Race'").select(*RACE, "no", "driver", "code", team_key(F.col("team")).alias("team"), "position", "grid", "points", dnf_flag(F.col("classified")).alias("dnf"))
    events = schedule.select(*RACE, F.col("circuit").alias("at"))
    x = races.join(events, list(RACE), "left")
    refused = F.raise_error(F.concat(F.lit("no event of the calendar for "), F.col("year").cast("string"), F.lit("/"), F.col("round").cast("string")))
    x = x.withColumn("circuit", F.when(F.col("at").isNull(), refused.cast("int")).otherwise(F.col("at"))).drop("at")
    for part in (quali_table(results), race_pace(laps)):
        x = x.join(part, [*RACE, "code"], "left")
    x = x.join(race_weather(readings), list(RACE), "left").join(weekend_features(schedule, laps, results, races), [*RACE, "code"], "left").join(quality, list(RACE), "left")
    listed = not_a_race.select(*RACE, F.lit(True).alias("listed"))
    x = x.join(listed, list(RACE), "left")
    ok = F.coalesce("results_ok", F.lit(False)) & F.col("listed").isNull()
    return x.withColumn("pace_gap", F.when(F.col("laps_ok"), F.col("pace_gap"))).withColumn("race_ok", ok).drop("results_ok", "laps_ok", "listed")


def ordered(history: DataFrame) -> DataFrame:
    """By event and entrant, never by what happened."""
    return history.orderBy(*RACE, "driver")


def weekend_pace(history: DataFrame) -> DataFrame:
    """The eight columns of weekend pace: the PQ columns, the rank of the best gap, and the gap to the team's others."""
    from paceline.operators.form import average_rank, others_mean

    best = F.col("pq_fp_best_gap")
    return history.select(*RACE, "driver", *PQ, average_rank(best, *RACE).alias("pq_fp_best_rank"), (best - others_mean(best, *RACE, "team")).alias("pq_fp_vs_teammate"))
