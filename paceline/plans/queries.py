"""The engine's queries by name. Doubles are rounded to six places, so that engines agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import scalars
from paceline.operators import assembly, audit, baselines, circuits, dimensions, evaluation, folds, forecast, form, harness, models, rulebook, serving, sessions, simulation, walkforward, zoo
from paceline.plans.oracles import ORACLE_SQL  # noqa: F401
from paceline.sources import championship
from paceline.sources.league import league, table, wide_league
from paceline.sources.scratch import discard, shared_dir, written
from paceline.streaming import store

RACE = form.RACE
DEVELOPMENT = (1997, 1998)
SERVED = ("drv_finish_l5", "drv_n_l5", "drv_dnf_l10", "team_finish_l5", "circ_drv_finish", "circ_drv_n", "circ_n_years", "season_round", "grid")
NOW = "1998-02-20 12:00:00"
ZONES = ("+00:00", "+02:00", "-05:00", "+09:00", "-03:00", "+10:00")  # of the circuits


def r6(df: DataFrame) -> DataFrame:
    """Rounded as the SQL rounds: the double scaled, rounded half away from zero and scaled back; one that overflows stays."""
    def rounded(x: str):
        by_scale = F.round(F.col(x) * 1e6) / 1e6
        return F.when(F.abs(by_scale) < float("inf"), by_scale).otherwise(F.col(x)).alias(x)

    return df.select(*(rounded(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def of_league(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: r6(build(league(spark, sf_dir)))


def of_wide(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """On the league that grows with the tables, which is written once, as most queries read it several times."""
    return lambda spark, sf_dir: r6(build(written(wide_league(spark, sf_dir))))


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.laps(table(spark, sf_dir, "events"))


def of_laps(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: r6(build(laps(spark, sf_dir)))


def quali_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sessions.valid_laps(laps(spark, sf_dir)).groupBy("session", "driver").agg(
        *(F.min(F.when(F.col("lap") % 3 == i, F.col("seconds"))).alias(f"q{i}") for i in range(3))
    )
    return r6(sessions.quali_gap(own, "q0", "q1", "q2"))


def weather_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    samples = e.select(F.to_date("ts").alias("session"), F.col("value").alias("air"), (F.col("event_id") % 11).cast("double").alias("wind"), (F.col("event_type") == "click").alias("rain"))
    return r6(sessions.weather_summary(samples))


def dnf_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 20 + 1).cast("string"))
    return o.select("o_orderkey", scalars.dnf_flag(said).alias("dnf"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.slugify(F.concat_ws(" -", "p_name", "p_type")).alias("slug"))


def circuit_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", scalars.circuit_id(F.concat(F.col("n_name"), F.lit(" É São"))).alias("circuit_id"), scalars.circuit_id(F.col("n_name")).alias("plain_id"))


def team_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", scalars.team_key(F.col("r_name")).alias("team_key"))


def schedule_query(build) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        zone = F.element_at(F.array(*map(F.lit, ZONES)), F.col("circuit") + 1)
        schedule = sessions.in_utc(championship.schedule(spark, sf_dir).withColumn("zone", zone))
        out = build(schedule, F.to_timestamp(F.lit(NOW)))
        return out.select("year", "round", "slot", "name", "kind", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))

    return query


def _pending(schedule: DataFrame, now) -> DataFrame:
    done = sessions.sessions(schedule).filter((F.col("round") * 7 + F.col("slot")) % 4 != 0).select("year", "round", "slot")
    return sessions.pending_sessions(schedule, done, now)


def training_frame(history: DataFrame) -> DataFrame:
    return form.training_frame(history).select(*RACE, "driver", "y", "drv_finish_l5", "team_finish_l5", "season_round", "grid", "grid_frac")


def metrics(history: DataFrame) -> DataFrame:
    return evaluation.race_metrics(baselines.all_scores(history), history)


def gains(history: DataFrame) -> DataFrame:
    return evaluation.paired(metrics(history), "mean_last5", "previous")


def field(history: DataFrame) -> DataFrame:
    """All entrants with a score and a chance to retire."""
    rate = simulation.recent_dnf_rate(history)
    return baselines.grid_equals_finish(history).join(rate, list(RACE)).select(*RACE, "driver", "score", F.col("dnf_rate").alias("p_dnf"))


def noise_search(history: DataFrame) -> DataFrame:
    """On development seasons only."""
    of_dev = field(history).filter(F.col("year").isin(*DEVELOPMENT))
    return simulation.noise_search(evaluation.development_only(of_dev, DEVELOPMENT), simulation.outcomes(history))


def with_rate(history: DataFrame, p: DataFrame) -> DataFrame:
    return p.join(simulation.recent_dnf_rate(history), list(RACE)).withColumnRenamed("dnf_rate", "p_dnf")


def score_report(history: DataFrame) -> DataFrame:
    prior = simulation.fit_total(prior_probabilities(history), "p_win", 1.0)
    for e in ("podium", "top10"):
        prior = prior.join(simulation.fit_total(prior_probabilities(history), f"p_{e}", float(simulation.EVENTS[e])), [*RACE, "driver"])
    given = {"simulation": simulation.chances(field(history), 2000, 0.8, 0.5), "grid_prior": with_rate(history, prior), "uniform": with_rate(history, simulation.uniform_probabilities(history))}
    return simulation.score_report(given, simulation.outcomes(history), "simulation")


def last_event_forecast(history: DataFrame) -> DataFrame:
    """Of the last event, whose outcome is hidden."""
    final = history.agg(F.max(F.struct(*RACE)).alias("final"))
    return forecast.forecast(history, history.join(final, F.struct(*RACE) == F.col("final"), "left_semi"))


def prior_probabilities(history: DataFrame) -> DataFrame:
    """Chances that fall with the grid slot, in closed form."""
    g = form.grid_features(history)
    return g.select(*RACE, "driver", *(F.least(F.lit(1.0), 2.0 * k / (F.col("grid") + 1 + k)).alias(f"p_{e}") for e, k in simulation.EVENTS.items()))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of up to 25 are usual in this league."""
    return audit.audit(championship.markers(spark, sf_dir), championship.results(spark, sf_dir), championship.laps(spark, sf_dir), most=25)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (f(spark, sf_dir) for f in (championship.results, championship.schedule, championship.laps, championship.weather))
    return assembly.build_history(*parts, audit.race_quality(audited(spark, sf_dir)), championship.not_a_race(spark))


def weekend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = championship.results(spark, sf_dir)
    return r6(assembly.weekend_features(championship.schedule(spark, sf_dir), championship.laps(spark, sf_dir), results, results.filter("session = 'Race'")))


def unmatched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a calendar that lacks every fifth month."""
    known = championship.schedule(spark, sf_dir).filter((F.col("year") * 12 + F.col("round")) % 5 != 0)
    return assembly.unmatched(championship.results(spark, sf_dir), known)


def races_that_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = championship.schedule(spark, sf_dir).select(*RACE)
    return assembly.keys_in(events, championship.not_a_race(spark), present=False)


def ranker(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return of_league(lambda h: harness.walk_forward_scores(written(h), (name,)))


def plackett_luce_steps(history: DataFrame) -> DataFrame:
    """How the fit of each fold converged."""
    report: list[walkforward.Step] = []
    table = written(models.rows(history))
    walkforward.plackett_luce(table, models.FEATURES, "position", folds.walk_forward(table, "position"), report=report)
    return history.sparkSession.createDataFrame([tuple(vars(s).values()) for s in report], "fold int, step int, loss double, gradient double, change double")


def quali_metrics(history: DataFrame) -> DataFrame:
    """The baselines of qualifying against its places."""
    scores = None
    for name, build in baselines.BY_TARGET["quali"].items():
        part = build(history).withColumn("model", F.lit(name))
        scores = part if scores is None else scores.unionByName(part)
    return evaluation.race_metrics(scores, history.select(*RACE, "driver", F.col("quali").alias("position")))


def qgap_training_frame(history: DataFrame) -> DataFrame:
    """Gaps in qualifying with the features that may be known before it, those with a half-life of four events among them."""
    frame = rulebook.training_frame(history, "qgap", ("recency", "post_practice"), half_life=4)
    return frame.select(*RACE, "driver", "y", "drv_finish_l5", "drv_n_l5", "team_finish_l5", "season_round", "drv_qgap_ew4", "drv_quali_ew4", "team_qgap_ew4", "pq_fp_best_gap", "circ_drv_n")


def entry_lists(history: DataFrame) -> DataFrame:
    """Three lists for each event from 1998: the field's odd and even numbers as of the event, and all as of its season's end."""
    of = history.filter("year >= 1998").select(*RACE, "no", "driver", "team", "circuit", "grid", "fp_best_gap", "fp_last_gap")
    name = F.format_string("%d-%02d-%s", "year", "round", F.when(F.col("no") % 2 == 1, "odd").otherwise("even"))
    late = of.filter("round % 4 = 0").withColumn("list", F.format_string("%d-%02d-late", "year", "round")).withColumn("round", F.lit(13))
    return of.withColumn("list", name).unionByName(late).drop("no")


def eligible_years_at(history: DataFrame) -> DataFrame:
    lists = entry_lists(history).select(F.col("list").alias("t"), *RACE, "circuit", "driver")
    return circuits.eligible_years_at(history, lists).select(F.col("t").alias("list"), "past_year", "raced", "entrants")


def session_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions taken into a store in the shared folder; rows of each table as they are read back from it."""
    lines, facts = written(championship.lines(spark, sf_dir)), written(league(spark, sf_dir))  # joined once for all that follows
    laps, results = championship.laps(spark, sf_dir, lines), championship.results(spark, sf_dir, facts)
    weather = championship.weather(spark, sf_dir, lines).filter((F.col("year") + F.col("round") * 5) % 11 != 0).withColumn("session", F.lit("Race"))
    keys = list(store.KEYS)
    sessions = written(laps.select(*keys).union(results.select(*keys)).distinct())
    lacking = F.when(F.col("session") != "Race", "weather"), F.when(F.col("session") == "Sprint", "laps"), F.when(~F.col("session").isin("Race", "Qualifying", "Sprint"), "results")
    allowed = sessions.select(*keys, F.explode(F.array_compact(F.array(*lacking))).alias("table"))
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    out = store.ingest(spark, root, {"laps": laps, "results": results, "weather": weather}, sessions, allowed, {"laps": ("code",), "results": ("code",)})
    discard(lines, facts, sessions)
    out = out.select(*keys, (F.size("refused") == 0).alias("done"), F.array_join("refused", "; ").alias("refused"))
    for name in ("laps", "results", "weather"):
        held = store.stored(spark, root, name).groupBy(*keys).agg(F.count("*").alias("n"))
        out = out.join(held, keys, "left").withColumn(f"n_{name}", F.coalesce("n", F.lit(0))).drop("n")
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "history_table": of_league(lambda h: h),
    "driver_form": of_league(form.driver_form),
    "team_form": of_league(form.team_form),
    "recency_form": of_league(form.recency_form),
    "circuit_history": of_league(circuits.circuit_history),
    "context": of_league(form.context),
    "weekend_pace": of_league(form.weekend_pace),
    "weather_scenario": of_league(form.weather),
    "grid_features": of_league(form.grid_features),
    "race_calendar": of_league(form.calendar),
    "as_of_before": of_league(lambda h: form.before(h, 1998, 6).select(*RACE, "driver", "position")),
    "usable_history": of_league(lambda h: form.usable(h).select(*RACE, "driver", "position")),
    "duplicate_entries": of_league(lambda h: form.duplicates(h.unionByName(h.filter("no = 3 AND round = 4")))),
    "latest_grid": of_league(circuits.latest_grid),
    "eligible_circuit_years": of_league(circuits.eligible_years),
    "training_frame": of_league(training_frame),
    "feature_missing": of_league(lambda h: sessions.missing(form.driver_form(h), (*RACE, "driver"))),
    "dim_drivers": of_league(dimensions.drivers),
    "dim_teams": of_league(dimensions.teams),
    "dim_circuits": of_league(dimensions.circuits),
    "weekend_table": of_laps(sessions.weekend_table),
    "clean_laps": of_laps(lambda x: sessions.clean_laps(x).select("session", "driver", "lap", "seconds")),
    "pace_gap": of_laps(lambda x: sessions.pace_gap(x, least_laps=3)),
    "best_lap_gap": of_laps(sessions.best_lap_gap),
    "quali_gap": quali_gap,
    "weather_summary": weather_summary,
    "race_quality_audit": of_laps(sessions.audit),
    "flag_counts": of_laps(lambda x: sessions.flag_counts(sessions.audit(x))),
    "earlier_sessions": schedule_query(lambda s, now: sessions.earlier_sessions(s)),
    "finished_sessions": schedule_query(sessions.finished_sessions),
    "pending_sessions": schedule_query(_pending),
    "dnf_flag": dnf_flag,
    "slugify": slugify,
    "circuit_id": circuit_id,
    "team_lineage": team_lineage,
    "baseline_grid": of_league(baselines.grid_equals_finish),
    "baseline_previous": of_league(baselines.previous),
    "baseline_mean_last5": of_league(baselines.mean_last5),
    "baseline_previous_quali": of_league(lambda h: baselines.previous(h, "quali")),
    "baseline_mean_last5_quali": of_league(lambda h: baselines.mean_last5(h, "quali")),
    "baseline_practice": of_league(baselines.practice),
    "race_metrics": of_league(metrics),
    "metrics_summary": of_league(lambda h: evaluation.summary(metrics(h))),
    "metrics_coverage": of_league(lambda h: evaluation.coverage(metrics(h).filter("NOT (model = 'grid' AND round = 3)"))),
    "leaderboard": of_league(lambda h: evaluation.leaderboard(metrics(h), "previous")),
    "walk_forward_splits": of_league(evaluation.walk_forward),
    "bootstrap_iid": of_league(lambda h: evaluation.bootstrap(gains(h))),
    "bootstrap_clustered": of_league(lambda h: evaluation.bootstrap(gains(h), clustered=True)),
    "recent_dnf_rate": of_league(simulation.recent_dnf_rate),
    "simulate_race": of_league(lambda h: simulation.simulate(field(h), draw=scalars.uniform)),
    "outcome_probabilities": of_league(lambda h: simulation.probabilities(simulation.simulate(field(h), 20_000))),
    "score_report": of_league(score_report),
    "baseline_probabilities": of_league(simulation.uniform_probabilities),
    "outcomes": of_league(simulation.outcomes),
    "logloss_brier": of_league(lambda h: simulation.losses(prior_probabilities(h), simulation.outcomes(h))),
    "reliability_bins": of_league(lambda h: simulation.reliability(prior_probabilities(h), simulation.outcomes(h))),
    "ece": of_league(lambda h: simulation.calibration_error(simulation.reliability(prior_probabilities(h), simulation.outcomes(h)))),
    "noise_grid_search": of_league(noise_search),
    "fit_total": of_league(lambda h: simulation.fit_total(prior_probabilities(h), "p_podium", 3.0)),
    "elo_ratings": of_league(models.elo),
    "ridge_scores": of_league(models.ridge_scores),
    "plackett_luce": of_league(models.plackett_luce_scores),
    "dnf_risk": of_league(models.dnf_risk),
    "grid_prior": of_league(models.grid_prior),
    "forest_scores": of_league(models.forest_scores),
    "gbt_scores": of_league(models.boosted_scores),
    "pairwise_ranker": of_league(models.pairwise_scores),
    "out_of_fold_grids": of_league(models.out_of_fold_grids),
    "predicted_grid_chain": of_league(models.predicted_grid_scores),
    "full_leaderboard": of_league(lambda h: evaluation.full_leaderboard(metrics(h), ("grid", "previous"))),
    "relevance_labels": of_league(lambda h: h.filter("position IS NOT NULL").select(*RACE, "driver", evaluation.relevance(F.col("position")).alias("relevance"))),
    "walk_forward_forecasts": of_league(forecast.collect),
    "walk_forward_predicted_grid": of_league(lambda h: forecast.collect(h, predicted_grid=True)),
    "forecast_report": of_league(lambda h: forecast.report(h, (1998, 1999), 1000)),
    "race_forecast": of_league(last_event_forecast),
    "tuned_ridge": of_league(lambda h: forecast.tune(h, "ridge", DEVELOPMENT)),
    "tuned_elo": of_league(lambda h: forecast.tune(h, "elo", DEVELOPMENT)),
    "model_metrics": of_league(lambda h: models.evaluated(h, ("ridge", "elo"))),
    "previous_race_equals_quali": of_league(baselines.previous_race),
    "quali_metrics": of_league(quali_metrics),
    "qgap_training_frame": of_league(qgap_training_frame),
    "with_grids": of_league(lambda h: form.with_grids(form.grid_features(h), h.filter("no % 7 <> 0").select(*RACE, "driver", F.col("quali").alias("slot")), "slot")),
    "qualifying_board": of_league(lambda h: zoo.board(h, "qualifying_after_practice", ("ridge",))),
    "race_before_qualifying_board": of_league(lambda h: zoo.board(h, "race_before_qualifying", ("ridge", "pairwise"))),
    "tuned_features": of_league(lambda h: zoo.tune_features(h, "ridge", DEVELOPMENT)),
    "tuned_trees": of_league(lambda h: zoo.tune_trees(h, DEVELOPMENT, rounds=3)),
    "eligible_years_at": of_league(eligible_years_at),
    "serving_features": of_league(lambda h: serving.features_at(h, entry_lists(h)).select("list", *RACE, "driver", *SERVED)),
    "session_ingest": session_ingest,
    "walk_forward_metrics": of_league(harness.walk_forward_metrics),
    "lambdarank_scores": ranker("lambdarank"),
    "boosted_trees": ranker("boosted"),
    "forest_walk_forward": ranker("forest"),
    "plackett_luce_steps": of_league(plackett_luce_steps),
    "wide_history": of_wide(lambda h: h),
    "wide_driver_form": of_wide(form.driver_form),
    "wide_team_form": of_wide(form.team_form),
    "wide_circuit_history": of_wide(circuits.circuit_history),
    "wide_eligible_years": of_wide(circuits.eligible_years),
    "wide_grid_features": of_wide(form.grid_features),
    "wide_mean_last5": of_wide(baselines.mean_last5),
    "wide_race_metrics": of_wide(metrics),
    "wide_leaderboard": of_wide(lambda h: evaluation.leaderboard(metrics(h), "previous")),
    "wide_ridge": of_wide(lambda h: harness.walk_forward_scores(h, ("ridge",))),
    "build_history": lambda spark, sf_dir: assembly.ordered(r6(built(spark, sf_dir))),
    "elo_by_circuit": of_league(lambda h: models.elo(h, by="circuit")),
    "session_audit": lambda spark, sf_dir: r6(audited(spark, sf_dir)),
    "audit_summary_by_kind": lambda spark, sf_dir: audit.summary(audited(spark, sf_dir)),
    "unmatched_events": unmatched_events,
    "weekend_features": weekend_features,
    "weather_features": lambda spark, sf_dir: r6(assembly.weather_features(built(spark, sf_dir))),
    "weekend_pace_full": lambda spark, sf_dir: r6(assembly.weekend_pace(built(spark, sf_dir))),
    "calendar_events": lambda spark, sf_dir: championship.schedule(spark, sf_dir).select(*RACE, "circuit"),
    "named_results": lambda spark, sf_dir: championship.results(spark, sf_dir).filter("session <> 'Qualifying'").select(*RACE, "session", "code", "position"),
    "races_that_count": races_that_count,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["driver_form"](spark, sf_dir)
