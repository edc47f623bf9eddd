"""Sessions: lap times, weather, calendars and data quality.

A table of laps has session, driver, lap, seconds, kind, deleted, track; one row per lap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import percent_gap, session_kind

#: Limits of the audit. Fixed rules.
LEAST_DRIVERS, LEAST_LAPS, MOST_NULL_LAPS = 18, 300, 0.06


def laps(events: DataFrame) -> DataFrame:
    """Laps from an event stream: a day is a session, an event a lap, its value the seconds."""
    w = Window.partitionBy("session", "driver").orderBy("ts", "event_id")
    return events.select(
        F.to_date("ts").alias("session"), (F.col("user_id") % 20).cast("int").alias("driver"), "ts", "event_id",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("seconds"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 13 == 0, "True").when(F.col("event_id") % 3 == 0, "False").alias("deleted"),
    ).withColumn("lap", F.row_number().over(w))


def not_deleted() -> Column:
    return F.coalesce(F.col("deleted") != "True", F.lit(True))


def clean_laps(laps: DataFrame) -> DataFrame:
    """Timed, on a clear track (kind view) and not deleted."""
    return laps.filter(F.col("seconds").isNotNull() & (F.col("kind") == "view") & not_deleted())


def valid_laps(laps: DataFrame) -> DataFrame:
    return laps.filter(F.col("seconds").isNotNull() & not_deleted())


def pace_gap(laps: DataFrame, least_laps: int = 5, least_drivers: int = 10) -> DataFrame:
    """Each driver's median clean lap against the median of those medians; nothing for a session of few drivers."""
    own = clean_laps(laps).groupBy("session", "driver").agg(F.percentile("seconds", 0.5).alias("median"), F.count("*").alias("n")).filter(F.col("n") >= least_laps)
    field = own.groupBy("session").agg(F.percentile("median", 0.5).alias("field"), F.count("*").alias("drivers")).filter(F.col("drivers") >= least_drivers)
    return own.join(field, "session").select("session", "driver", percent_gap(F.col("median"), F.col("field")).alias("pace_gap_pct"))


def best_lap_gap(laps: DataFrame) -> DataFrame:
    best = valid_laps(laps).groupBy("session", "driver").agg(F.min("seconds").alias("best"))
    return best.select("session", "driver", "best", percent_gap(F.col("best"), F.min("best").over(Window.partitionBy("session"))).alias("best_gap_pct"))


def quali_gap(times: DataFrame, *parts: str, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """Each one's best of several parts, some null, against the session's best."""
    best = F.least(*parts)
    return times.select(*by, "driver", best.alias("best"), percent_gap(best, F.min(best).over(Window.partitionBy(*by))).alias("quali_gap_pct"))


def weather_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session").agg(F.avg("air").alias("air_temp"), F.avg("wind").alias("wind_speed"), F.avg(F.col("rain").cast("double")).alias("rain_share"))


def calendar(spark: SparkSession) -> DataFrame:
    """A fixed schedule in wide form: per event five sessions with their start in UTC."""
    names = {"standard": ("Practice 1", "Practice 2", "Practice 3", "Qualifying", "Race"), "sprint": ("Practice 1", "Sprint Qualifying", "Sprint", "Qualifying", "Race")}
    rows = spark.range(1, 13).select(F.lit(2024).alias("year"), F.col("id").cast("int").alias("round"), F.when(F.col("id") % 3 == 0, "sprint").otherwise("standard").alias("format"))
    day = F.to_timestamp(F.lit("2024-01-05 10:00:00"))
    for i in range(5):
        name = F.when(F.col("format") == "sprint", names["sprint"][i]).otherwise(names["standard"][i])
        start = F.timestamp_add("HOUR", (F.lit(168) * (F.col("round") - 1) + (0, 4, 24, 28, 51)[i]).cast("int"), day)
        rows = rows.withColumn(f"session{i + 1}", name).withColumn(f"start{i + 1}", start)
    return rows


def sessions(schedule: DataFrame) -> DataFrame:
    """One row per session; those without a name or a start are left out."""
    stacked = ", ".join(f"{i}, session{i}, start{i}" for i in range(1, 6))
    long = schedule.select("year", "round", F.expr(f"stack(5, {stacked}) AS (slot, name, start)"))
    return long.filter(F.col("start").isNotNull() & (F.trim("name") != "")).withColumn("kind", session_kind(F.col("name")))


def in_utc(schedule: DataFrame, zone: str = "zone") -> DataFrame:
    """The schedule with starts in UTC. zone: a column with the name or the offset of each event's zone; starts are local
    times of it, and those of an event without a zone are taken as UTC."""
    starts = [c for c in schedule.columns if c.startswith("start")]
    return schedule.withColumns({c: F.to_utc_timestamp(c, F.coalesce(zone, F.lit("UTC"))) for c in starts}).drop(zone)


def earlier_sessions(schedule: DataFrame, target: str = "qualifying") -> DataFrame:
    """The sessions that start strictly before the target session of their event."""
    long = sessions(schedule)
    cutoff = long.filter(F.col("kind") == target).select("year", "round", F.col("start").alias("cutoff"))
    return long.join(cutoff, ["year", "round"]).filter(F.col("start") < F.col("cutoff")).drop("cutoff")


def finished_sessions(schedule: DataFrame, now: Column, only: tuple[str, ...] = (), settle_hours: int = 6) -> DataFrame:
    """Sessions that started at least settle_hours ago."""
    done = sessions(schedule).filter(F.timestamp_add("HOUR", F.lit(settle_hours), F.col("start")) <= now)
    return done.filter(F.col("name").isin(*only)) if only else done


def pending_sessions(schedule: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """Finished sessions that the ledger (year, round, slot) doesn't list."""
    return finished_sessions(schedule, now).join(ledger, ["year", "round", "slot"], "left_anti")


def weekend_table(laps: DataFrame, gap_days: int = 3) -> DataFrame:
    """Practice before each session of an event, the days of one event being gap_days in a row.

    fp_n counts the sessions with data, the same for all drivers; the last gap is that of the last such session only. Laps without
    a day are an event of their own, a null one, without sessions: it has best gaps only.
    """
    start = F.lit("2024-01-01").cast("date")
    best = best_lap_gap(laps).withColumn("event", F.floor(F.datediff("session", start) / gap_days).cast("int"))
    event = Window.partitionBy("event")
    out = best.withColumn("final", F.max("session").over(event)).withColumn("n", F.size(F.collect_set("session").over(event)))
    last = F.when(F.col("session") == F.col("final"), F.col("best_gap_pct"))
    return out.groupBy("event", "driver").agg(F.min("best_gap_pct").alias("fp_best_gap"), F.max(last).alias("fp_last_gap"), F.max("n").alias("fp_n"))


def audit(laps: DataFrame) -> DataFrame:
    """A row per session: counts, flags and whether it is fit for use. No lap times at all is one of the flags."""
    own = laps.groupBy("session").agg(
        F.count("*").alias("n_laps"), F.countDistinct("driver").alias("n_drivers"), F.avg(F.col("seconds").isNull().cast("double")).alias("null_share"),
        (F.count("*") - F.countDistinct("driver", "lap")).alias("n_repeated"),
    )
    flags = F.array_compact(F.array(
        F.when(F.col("n_drivers") < LEAST_DRIVERS, "few_drivers"), F.when(F.col("n_laps") < LEAST_LAPS, "few_laps"),
        F.when(F.col("null_share") > MOST_NULL_LAPS, "many_null_laps"), F.when(F.col("n_repeated") > 0, "repeated_laps"),
    ))
    return own.withColumn("flags", F.array_join(flags, ";")).withColumn("laps_ok", F.col("flags") == "")


def flag_counts(audited: DataFrame) -> DataFrame:
    """How many sessions carry each flag."""
    one = audited.filter("flags <> ''").select(F.explode(F.split("flags", ";")).alias("flag"))
    return one.groupBy("flag").agg(F.count("*").alias("sessions"))


def missing(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Missing values of each column and its role, in one pass."""
    columns = table.columns
    row = table.agg(F.count("*").alias("n"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    long = row.unpivot(["n"], columns, "feature", "n_missing")
    role = F.when(F.col("feature").isin(*keys), "key").otherwise("feature")
    return long.select("feature", role.alias("role"), "n_missing", F.try_divide(F.col("n_missing") * 100.0, F.col("n")).alias("missing_pct"))
