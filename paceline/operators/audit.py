"""The audit of sessions: a row of counts, flags and verdicts for each marker. Limits are fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import slugify

LEAST_RESULTS, MOST_RESULTS, MOST_UNPLACED = 18, 22, 0.2
SOME_UNTIMED, MANY_UNTIMED = 0.05, 0.25
#: Which flags make a session's results or laps unfit. Fixed values.
RESULT_FLAGS = ("unusual_result_rows", "duplicate_drivers", "many_null_positions", "no_single_winner", "unreadable_marker")
LAP_FLAGS = ("no_laps", "many_null_laptimes", "laps_missing_drivers", "unreadable_marker")
INFO_FLAGS = ("some_untimed_laps",)
KEYS = ("year", "round", "session")


def audit_kind(name: Column) -> Column:
    """race, qualifying or practice. Sprints count as races, as nearly every lap of both is timed."""
    slug = slugify(name)
    return F.when(slug.isin("race", "sprint"), "race").when(slug.contains("qualifying") | slug.contains("shootout"), "qualifying").otherwise("practice")


def audit(markers: DataFrame, results: DataFrame, laps: DataFrame, least: int = LEAST_RESULTS, most: int = MOST_RESULTS) -> DataFrame:
    """A row per marker, whether or not there are results or laps. Lap 1 is not judged, as it is often untimed.

    Markers tell how many rows there are of weather and, if they have that column, of the track's status; those of one
    that can't be read tell nothing.
    """
    if "track_status_rows" not in markers.columns:
        markers = markers.withColumn("track_status_rows", F.lit(0).cast("long"))
    r = results.groupBy(*KEYS).agg(
        F.count("*").alias("results_rows"), F.sum(F.col("position").isNull().cast("long")).alias("results_null_position"),
        (F.count("*") - F.countDistinct("code")).alias("results_dup_drivers"), F.sum((F.col("position") == 1).cast("long")).alias("winners"),
    )
    judged = F.when(F.col("lap") != 1, F.col("seconds").isNull().cast("double"))
    t = laps.groupBy(*KEYS).agg(F.count("*").alias("laps_rows"), F.countDistinct("code").alias("laps_drivers"), F.avg(judged).alias("laptime_null_frac"))
    x = markers.join(r, list(KEYS), "left").join(t, list(KEYS), "left").fillna(0, ["results_rows", "results_null_position", "results_dup_drivers", "winners", "laps_rows", "laps_drivers"])
    x = x.withColumn("kind", audit_kind(F.col("session"))).withColumns({c: F.when(F.col("unreadable"), 0).otherwise(F.coalesce(c, F.lit(0))) for c in ("weather_rows", "track_status_rows")})
    race, some, untimed = F.col("kind") == "race", F.col("results_rows") > 0, F.col("laptime_null_frac")
    driven = F.col("laps_rows") > 0
    flags = F.array_compact(F.array(
        F.when(F.col("unreadable"), "unreadable_marker"),
        F.when(~F.col("results_rows").between(least, most), "unusual_result_rows"),
        F.when(F.col("results_dup_drivers") > 0, "duplicate_drivers"),
        F.when(race & some & (F.col("results_null_position") > MOST_UNPLACED * F.col("results_rows")), "many_null_positions"),
        F.when(race & some & (F.col("winners") != 1), "no_single_winner"),
        F.when(~driven, "no_laps"),
        F.when(driven & race & ~F.coalesce(untimed <= MANY_UNTIMED, F.lit(False)), "many_null_laptimes"),  # unknown: only first laps
        F.when(driven & race & (untimed > SOME_UNTIMED) & (untimed <= MANY_UNTIMED), "some_untimed_laps"),
        F.when(driven & (F.col("laps_drivers") < F.col("results_rows") - 2), "laps_missing_drivers"),
        F.when(F.col("weather_rows") == 0, "no_weather"),
    ))
    x = x.withColumn("found", flags)
    clear = lambda bad: F.size(F.array_intersect("found", F.array(*map(F.lit, bad)))) == 0
    missing = F.when(F.col("unreadable"), "").otherwise(F.array_join("missing", ","))
    return x.select(
        *KEYS, "kind", "results_rows", "results_null_position", "results_dup_drivers", "laps_rows", "laps_drivers", "laptime_null_frac", "weather_rows", "track_status_rows", missing.alias("missing_tables"),
        F.array_join("found", ",").alias("flags"), clear(RESULT_FLAGS).alias("results_ok"), clear(LAP_FLAGS).alias("laps_ok"), clear(("no_weather",)).alias("weather_ok"),
    )


def summary(audited: DataFrame) -> DataFrame:
    """Sessions and verdicts of each kind, and how many are only informed about."""
    flags = F.filter(F.split("flags", ","), lambda f: f != "")
    info = (F.size(flags) > 0) & (F.size(F.array_except(flags, F.array(*map(F.lit, INFO_FLAGS)))) == 0)
    count = lambda c: F.sum(c.cast("long"))
    return audited.groupBy("kind").agg(F.count("*").alias("sessions"), *(count(F.col(c)).alias(c) for c in ("results_ok", "laps_ok", "weather_ok")), count(info).alias("informational"))


def race_quality(audited: DataFrame) -> DataFrame:
    return audited.filter("session = 'Race'").select("year", "round", "results_ok", "laps_ok")
