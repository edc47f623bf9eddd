"""DuckDB SQL with the same rows as the queries of the same names."""

from __future__ import annotations

from paceline.sources.championship import RAW_SQL
from paceline.sources.league import LEAGUE_SQL, WIDE_LEAGUE_SQL


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


USABLE = """, cal AS (
    SELECT year, round, row_number() OVER (ORDER BY year, round) AS race_idx,
        coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY year, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS usable_before
    FROM (SELECT year, round, bool_and(race_ok) AS ok FROM league GROUP BY year, round)
)"""
SEASON = """, seas AS (
    SELECT year, round, sum(p) OVER (PARTITION BY year ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS season_points
    FROM (SELECT year, round, sum(CASE WHEN race_ok THEN points ELSE 0 END) AS p FROM league GROUP BY year, round)
)"""


def masked(value: str, n: int, by: str, agg: str = "avg") -> str:
    return f"{agg}(CASE WHEN race_ok THEN {value} END) OVER (PARTITION BY {by} ORDER BY k RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def so_far(by: str) -> str:
    return f"OVER (PARTITION BY {by} ORDER BY year, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def usable_rank(by: str, condition: str = "race_ok") -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) {so_far(by)}, 0) AS k"


def share(by: str) -> str:
    own = f"sum(CASE WHEN race_ok THEN points END) {so_far('year, ' + by)}"
    raced = f"sum(CASE WHEN race_ok THEN 1 ELSE 0 END) {so_far(by)}"
    return f"CASE WHEN season_points > 0 AND {raced} > 0 THEN coalesce({own}, 0.0) / season_points END"


DRIVER_FORM = (
    USABLE + SEASON + f""", f AS (
    SELECT l.*, season_points, usable_before, {usable_rank('driver')} FROM league l JOIN seas USING (year, round) JOIN cal USING (year, round)
), df AS (
    SELECT year, round, driver, {masked('position', 5, 'driver')} AS drv_finish_l5,
        {masked('CASE WHEN grid > 0 THEN grid END', 5, 'driver')} AS drv_grid_l5, {masked('quali', 5, 'driver')} AS drv_quali_l5,
        {masked('quali_gap', 5, 'driver')} AS drv_qgap_l5, {masked('pace_gap', 5, 'driver')} AS drv_pace_l5,
        {masked('position', 5, 'driver', 'count')} AS drv_n_l5, {masked('CASE WHEN dnf THEN 1.0 ELSE 0.0 END', 10, 'driver')} AS drv_dnf_l10,
        {share('driver')} AS drv_pts_share_ytd,
        usable_before - 1 - max(CASE WHEN race_ok THEN usable_before END) {so_far('driver')} AS drv_rounds_since_last
    FROM f
)"""
)
TEAM_FORM = f""", cars AS (
    SELECT year, round, team, avg(position) AS position, avg(quali_gap) AS quali_gap, avg(pace_gap) AS pace_gap,
        avg(CASE WHEN dnf THEN 1.0 ELSE 0.0 END) AS dnf, sum(points) AS points, bool_and(race_ok) AS race_ok
    FROM league GROUP BY year, round, team
), tf0 AS (SELECT c.*, season_points, {usable_rank('team')} FROM cars c JOIN seas USING (year, round)),
tf AS (
    SELECT year, round, team, {masked('position', 5, 'team')} AS team_finish_l5, {masked('quali_gap', 5, 'team')} AS team_qgap_l5,
        {masked('pace_gap', 3, 'team')} AS team_pace_l3, {masked('dnf', 10, 'team')} AS team_dnf_l10, {share('team')} AS team_pts_share_ytd
    FROM tf0
)"""
GRID = """, gf AS (
    SELECT year, round, driver, coalesce(slot, coalesce(max(slot) OVER w, 0) + 1) AS grid, CASE WHEN raw = 0 THEN 1.0 ELSE 0.0 END AS grid_pit_lane, count(*) OVER w AS n
    FROM (SELECT *, grid AS raw, CASE WHEN grid > 0 THEN grid END AS slot FROM league) WINDOW w AS (PARTITION BY year, round)
)"""


def ew(value: str, name: str, half: int, by: str = "driver") -> str:
    w = f"CASE WHEN race_ok AND {value} IS NOT NULL THEN pow(2.0, usable_before / {half}.0) END"
    return f"sum({w} * {value}) {so_far(by)} / sum({w}) {so_far(by)} AS {name}_ew{half}"


BASE_GRID = ", bg AS (SELECT 'grid' AS model, year, round, driver, coalesce(CASE WHEN grid > 0 THEN grid END, coalesce(max(CASE WHEN grid > 0 THEN grid END) OVER (PARTITION BY year, round), 0) + 1) AS score FROM league)"
BASE_PREVIOUS = f""", bp0 AS (
    SELECT *, last_value(CASE WHEN race_ok THEN position END IGNORE NULLS) {so_far('code')} AS p FROM league
), bp AS (
    SELECT 'previous' AS model, year, round, driver, coalesce(p, coalesce(max(p) OVER (PARTITION BY year, round), 0.0) + CASE WHEN grid > 0 THEN grid ELSE 1.0 END) AS score FROM bp0
)"""
BASE_MEAN = f""", bm0 AS (SELECT *, {usable_rank('code', 'race_ok AND position IS NOT NULL')} FROM league),
bm1 AS (SELECT *, {masked('position', 5, 'code')} AS p FROM bm0), bm AS (
    SELECT 'mean_last5' AS model, year, round, driver, coalesce(p, coalesce(max(p) OVER (PARTITION BY year, round), 0.0) + CASE WHEN grid > 0 THEN grid ELSE 1.0 END) AS score FROM bm1
)"""
BASE_PRACTICE = ", bx AS (SELECT 'practice' AS model, year, round, driver, coalesce(fp_best_gap, max(fp_best_gap) OVER (PARTITION BY year, round) + 1, 0.0) AS score FROM league)"
SCORES = BASE_GRID + BASE_PREVIOUS + BASE_MEAN + BASE_PRACTICE + ", scores AS (SELECT * FROM bg UNION ALL SELECT * FROM bp UNION ALL SELECT * FROM bm UNION ALL SELECT * FROM bx)"
METRICS = (
    SCORES + """, known AS (
    SELECT s.*, position, rank() OVER (PARTITION BY model, year, round ORDER BY score) - 1 AS bp, count(*) OVER (PARTITION BY model, year, round, score) AS tp,
        rank() OVER (PARTITION BY model, year, round ORDER BY position) - 1 AS ba, count(*) OVER (PARTITION BY model, year, round, position) AS ta
    FROM scores s JOIN league l USING (year, round, driver) WHERE position IS NOT NULL
), placed AS (
    SELECT *, bp + (tp + 1) / 2.0 AS rp, ba + (ta + 1) / 2.0 AS ra,
        list_avg(list_transform(range(bp + 1, bp + tp + 1), lambda i: list_avg(list_transform(range(ba + 1, ba + ta + 1), lambda j: abs(i - j))))) AS dist
    FROM known
), pr AS (
    SELECT model, year, round, count(*) AS n,
        CASE WHEN sqrt(var_pop(rp) * var_pop(ra)) > 1e-12 THEN covar_pop(rp, ra) / sqrt(var_pop(rp) * var_pop(ra)) ELSE 0.0 END AS spearman,
        avg(dist) AS mae_position,
""" + ",\n".join(
        f"        sum(greatest(0.0, least(1.0, ({k} - bp) / tp)) * greatest(0.0, least(1.0, ({k} - ba) / ta))) / least({k}, count(*)) AS {name}"
        for k, name in ((1, "winner_acc"), (3, "podium_overlap"), (10, "top10_overlap"))
    ) + "\n    FROM placed GROUP BY model, year, round HAVING count(*) >= 2\n)"
)
M = ("spearman", "mae_position", "winner_acc", "podium_overlap", "top10_overlap")
GAINS = METRICS + ", gains AS (SELECT a.year, a.round, a.spearman - b.spearman AS gain FROM pr a JOIN pr b USING (year, round) WHERE a.model = 'mean_last5' AND b.model = 'previous')"


def uni(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


DNF_RATE = """, rr AS (
    SELECT year, round, sum(CASE WHEN race_ok THEN CASE WHEN dnf THEN 1.0 ELSE 0.0 END END) AS s, sum(CASE WHEN race_ok THEN 1 ELSE 0 END) AS c FROM league GROUP BY year, round
), ra0 AS (
    SELECT a.year, a.round, sum(b.s) FILTER (b.year >= a.year - 2) AS rs, sum(b.c) FILTER (b.year >= a.year - 2) AS rc, sum(b.s) AS s, sum(b.c) AS c
    FROM rr a LEFT JOIN rr b ON (b.year, b.round) < (a.year, a.round) GROUP BY a.year, a.round
), dr AS (
    SELECT year, round, CAST(CASE WHEN rc > 0 THEN rs / rc WHEN c > 0 THEN s / c ELSE 0.12 END AS DOUBLE) AS dnf_rate FROM ra0
)"""
FIELD = DNF_RATE + ", fld AS (SELECT f.*, dnf_rate AS p_dnf FROM (SELECT year, round, driver, coalesce(slot, coalesce(max(slot) OVER (PARTITION BY year, round), 0) + 1) AS score FROM (SELECT *, CASE WHEN grid > 0 THEN grid END AS slot FROM league)) f JOIN dr USING (year, round))"


def sims(n: int, sigma: float = 0.8, gamma: float = 0.5, where: str = "true", name: str = "sim") -> str:
    key = "concat_ws('-', 0, year, round, sim, driver"
    return f""", {name}0 AS (
    SELECT *, {uni(key + ", 'dnf')")} < p_dnf AS retired,
        sqrt(-2 * ln({uni(key + ", 'pace', 'u')")})) * cos({uni(key + ", 'pace', 'v')")} * 6.283185307179586) AS z, {uni(key + ", 'order')")} AS u
    FROM (SELECT *, unnest(range(1, {n + 1})) AS sim FROM fld WHERE {where})
), {name} AS (
    SELECT year, round, sim, driver, retired,
        row_number() OVER (PARTITION BY year, round, sim ORDER BY CASE WHEN retired THEN 1e6 + u ELSE score + {sigma} * pow(greatest(score, 1.0), {gamma}) * z END, driver) AS place
    FROM {name}0
)"""


PRIOR = GRID + ", prior AS (SELECT year, round, driver, " + ", ".join(f"least(1.0, 2.0 * {k} / (grid + 1 + {k})) AS p_{e}" for e, k in (("win", 1), ("podium", 3), ("top10", 10))) + " FROM gf)"
OUTCOMES = ", oc AS (SELECT year, round, driver, position <= 1 AS y_win, position <= 3 AS y_podium, position <= 10 AS y_top10, dnf AS y_dnf FROM league WHERE position IS NOT NULL)"


def logloss(p: str, y: str) -> str:
    q = f"greatest(0.001, least(0.999, {p}))"
    return f"avg(-CASE WHEN {y} THEN ln({q}) ELSE ln(1 - {q}) END)"


BINS = PRIOR + OUTCOMES + """, rel0 AS (
    SELECT p_podium AS p, CASE WHEN y_podium THEN 1.0 ELSE 0.0 END AS y, row_number() OVER (ORDER BY p_podium, year, round, driver) AS r, count(*) OVER () AS total
    FROM prior JOIN oc USING (year, round, driver)
), rel AS (
    SELECT CAST(greatest(ceil((r - 1) * 10 / (total - 1)) - 1, 0) AS INTEGER) AS bin, avg(p) AS mean_p, avg(y) AS rate, count(*) AS n FROM rel0 GROUP BY 1
)"""
LAPS = """WITH ev AS (
    SELECT CAST(ts AS DATE) AS session, CAST(user_id % 20 AS INTEGER) AS driver, ts, event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS seconds,
        event_type AS kind, CASE WHEN event_id % 13 = 0 THEN 'True' WHEN event_id % 3 = 0 THEN 'False' END AS deleted
    FROM events
), laps AS (SELECT *, row_number() OVER (PARTITION BY session, driver ORDER BY ts, event_id) AS lap FROM ev),
valid AS (SELECT * FROM laps WHERE seconds IS NOT NULL AND coalesce(deleted <> 'True', true)),
best AS (SELECT session, driver, min(seconds) AS best FROM valid GROUP BY session, driver),
gaps AS (SELECT *, best / min(best) OVER (PARTITION BY session) * 100 - 100 AS best_gap_pct FROM best)"""
AUDIT = LAPS + """, au AS (
    SELECT session, count(*) AS n_laps, count(DISTINCT driver) AS n_drivers, avg(CASE WHEN seconds IS NULL THEN 1.0 ELSE 0.0 END) AS null_share,
        count(*) - count(DISTINCT (driver, lap)) AS n_repeated FROM laps GROUP BY session
), aud AS (
    SELECT *, coalesce(concat_ws(';', CASE WHEN n_drivers < 18 THEN 'few_drivers' END, CASE WHEN n_laps < 300 THEN 'few_laps' END,
        CASE WHEN null_share > 0.06 THEN 'many_null_laps' END, CASE WHEN n_repeated > 0 THEN 'repeated_laps' END), '') AS flags FROM au
)"""
SCHEDULE = """WITH days AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS round FROM orders),
slots AS (
    SELECT year, round, unnest([1, 2, 3, 4, 5]) AS slot,
        unnest(CASE WHEN round % 3 = 0 THEN ['Practice 1', 'Sprint Qualifying', 'Sprint', 'Qualifying', 'Race'] ELSE ['Practice 1', 'Practice 2', 'Practice 3', 'Qualifying', 'Race'] END) AS name,
        unnest([0, 4, 24, 28, 51]) - [0, 2, -5, 9, -3, 10][(round - 1) % 6 + 1] AS h
    FROM days
), ses AS (
    SELECT year, round, slot, name, CASE WHEN name LIKE 'Practice%' THEN 'practice' WHEN name = 'Sprint Qualifying' THEN 'sprint_qualifying' WHEN name = 'Sprint' THEN 'sprint'
        WHEN name = 'Qualifying' THEN 'qualifying' ELSE 'race' END AS kind, make_timestamp(year, round, 5, 10, 0, 0) + to_hours(CAST(h AS INTEGER)) AS start
    FROM slots
)"""
SESSION = "SELECT year, round, CAST(slot AS INTEGER) AS slot, name, kind, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM ses"
DONE = "start + INTERVAL 6 HOURS <= TIMESTAMP '1998-02-20 12:00:00'"
ELIGIBLE = USABLE + """, idx AS (SELECT l.*, race_idx FROM league l JOIN cal USING (year, round)),
vis AS (SELECT t.race_idx AS t, p.year AS past_year, p.driver FROM idx t JOIN idx p ON t.driver = p.driver AND t.circuit = p.circuit AND p.race_idx < t.race_idx AND p.race_ok),
el AS (
    SELECT t, past_year, raced, entrants FROM (SELECT t, past_year, count(DISTINCT driver) AS raced FROM vis GROUP BY t, past_year)
    JOIN (SELECT race_idx AS t, count(DISTINCT driver) AS entrants FROM idx GROUP BY race_idx) USING (t) WHERE raced >= ceil(0.25 * entrants - 1e-9)
)"""
CIRCUIT = ELIGIBLE + f""", ci0 AS (SELECT *, {usable_rank('driver')} FROM idx), ci AS (SELECT *, {masked('position', 20, 'driver')} AS recent FROM ci0),
fm AS (
    SELECT race_idx, CASE WHEN coalesce(max(a) OVER w, 0) = 0 THEN 10.5 ELSE sum(s) OVER w / nullif(sum(c) OVER w, 0) END AS field_mean
    FROM (SELECT race_idx, sum(CASE WHEN race_ok THEN position END) AS s, count(CASE WHEN race_ok THEN position END) AS c, max(CASE WHEN race_ok THEN 1 ELSE 0 END) AS a FROM idx GROUP BY race_idx)
    WINDOW w AS (ORDER BY race_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), past AS (
    SELECT x.race_idx AS t, p.* FROM (SELECT DISTINCT race_idx, circuit FROM idx) x JOIN el ON el.t = x.race_idx
    JOIN idx p ON p.circuit = x.circuit AND p.year = el.past_year AND p.race_idx < x.race_idx AND p.race_ok
), mine AS (SELECT t, driver, count(position) AS n, avg(position) AS m FROM past GROUP BY t, driver),
there AS (SELECT t, avg(CASE WHEN grid > 0 AND NOT dnf THEN grid - position END) AS o, avg(CASE WHEN dnf THEN 1.0 ELSE 0.0 END) AS d, count(DISTINCT year) AS y FROM past GROUP BY t)
SELECT ci.year, ci.round, ci.driver, round((coalesce(n, 0) * coalesce(m, 0.0) + 3 * coalesce(recent, field_mean)) / (coalesce(n, 0) + 3), 6) AS circ_drv_finish,
    coalesce(n, 0) AS circ_drv_n, round(o, 6) AS circ_overtake, round(d, 6) AS circ_dnf_rate, coalesce(y, 0) AS circ_n_years
FROM ci JOIN fm USING (race_idx) LEFT JOIN mine ON mine.t = ci.race_idx AND mine.driver = ci.driver LEFT JOIN there ON there.t = ci.race_idx"""
#: Weighted means of entrants and of their teams.
RECENT = f"""own AS (SELECT year, round, driver, team, {', '.join(ew(v, n, h) for v, n in (('quali_gap', 'drv_qgap'), ('quali', 'drv_quali')) for h in (2, 4, 8))} FROM league JOIN cal USING (year, round)),
    cars AS (SELECT year, round, team, avg(quali_gap) AS quali_gap, bool_and(race_ok) AS race_ok FROM league GROUP BY year, round, team),
    teams AS (SELECT year, round, team, {', '.join(ew('quali_gap', 'team_qgap', h, 'team') for h in (2, 4, 8))} FROM cars JOIN cal USING (year, round))"""
CIRCUIT_HISTORY = CIRCUIT.replace("SELECT ci.year, ci.round", ", ch AS (SELECT ci.year, ci.round") + ")"
#: Entry lists, their own fields and as-of events; the years before it that count for each.
LISTS = """, ls AS (
    SELECT format('{}-{:02d}-{}', year, round, CASE WHEN no % 2 = 1 THEN 'odd' ELSE 'even' END) AS list, year, round, driver, team, circuit, grid FROM league WHERE year >= 1998
    UNION ALL SELECT format('{}-{:02d}-late', year, round), year, 13, driver, team, circuit, grid FROM league WHERE year >= 1998 AND round % 4 = 0
), lp AS (
    SELECT ls.list, ls.driver, p.year AS past_year, p.position FROM ls JOIN league p ON p.driver = ls.driver AND p.circuit = ls.circuit AND p.race_ok AND (p.year, p.round) < (ls.year, ls.round)
), le AS (
    SELECT list, past_year, raced, entrants FROM (SELECT list, past_year, count(DISTINCT driver) AS raced FROM lp GROUP BY list, past_year)
    JOIN (SELECT list, count(DISTINCT driver) AS entrants FROM ls GROUP BY list) USING (list) WHERE raced >= ceil(0.25 * entrants - 1e-9)
)"""
#: Features of the entries, each from what lies strictly before its event.
SERVED = """, lf AS (
    SELECT list, year, round, driver, row_number() OVER () AS rid, circuit, team FROM ls
), hist AS (
    SELECT lf.rid, h.*, row_number() OVER (PARTITION BY lf.rid ORDER BY h.year DESC, h.round DESC) AS back FROM lf JOIN league h ON h.driver = lf.driver AND h.race_ok AND (h.year, h.round) < (lf.year, lf.round)
), own AS (
    SELECT rid, avg(position) FILTER (back <= 5) AS l5, count(position) FILTER (back <= 5) AS n5, avg(position) FILTER (back <= 20) AS l20, avg(CASE WHEN dnf THEN 1.0 ELSE 0.0 END) FILTER (back <= 10) AS d10 FROM hist GROUP BY rid
), cars AS (
    SELECT team, year, round, avg(position) AS position FROM league WHERE race_ok GROUP BY team, year, round
), teams AS (
    SELECT rid, avg(position) AS t5 FROM (SELECT lf.rid, c.position, row_number() OVER (PARTITION BY lf.rid ORDER BY c.year DESC, c.round DESC) AS back FROM lf JOIN cars c ON c.team = lf.team AND (c.year, c.round) < (lf.year, lf.round)) WHERE back <= 5 GROUP BY rid
), fld AS (
    SELECT lf.rid, avg(h.position) AS field_mean FROM lf JOIN league h ON h.race_ok AND (h.year, h.round) < (lf.year, lf.round) GROUP BY lf.rid
), mine AS (
    SELECT list, driver, count(position) AS n, avg(position) AS m FROM lp JOIN le USING (list, past_year) GROUP BY list, driver
), ny AS (SELECT list, count(*) AS years FROM le GROUP BY list), gr AS (
    SELECT list, driver, coalesce(CASE WHEN grid > 0 THEN grid END, coalesce(max(CASE WHEN grid > 0 THEN grid END) OVER (PARTITION BY list), 0) + 1) AS grid FROM ls
)"""
RANGE = "year, round, driver"


def dimension(key: str, **latest: str) -> str:
    attributes = ", ".join(f"arg_max({c}, year * 100000 + round * 1000 + no) AS {a}" for a, c in latest.items())
    return f"SELECT {key}, {attributes}, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM league GROUP BY {key}"


def boot(draws: str) -> str:
    return f"{draws}, bs AS (SELECT i, avg(gain) AS m FROM picked GROUP BY i) SELECT round((SELECT avg(gain) FROM gains), 6) AS mean_gain, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM bs"


SESSION_AUDIT = RAW_SQL + """, ar AS (
    SELECT year, round, session, count(*) AS results_rows, count(*) - count(position) AS results_null_position, count(*) - count(DISTINCT code) AS results_dup_drivers,
        sum(CASE WHEN position = 1 THEN 1 ELSE 0 END) AS winners FROM rres GROUP BY year, round, session
), al AS (
    SELECT year, round, session, count(*) AS laps_rows, count(DISTINCT code) AS laps_drivers, avg(CASE WHEN lap <> 1 THEN CASE WHEN seconds IS NULL THEN 1.0 ELSE 0.0 END END) AS laptime_null_frac FROM rlaps GROUP BY year, round, session
), ax AS (
    SELECT year, round, session, CASE WHEN session IN ('Race', 'Sprint') THEN 'race' WHEN session LIKE '%Qualifying%' THEN 'qualifying' ELSE 'practice' END AS kind,
        coalesce(results_rows, 0) AS results_rows, coalesce(results_null_position, 0) AS results_null_position, coalesce(results_dup_drivers, 0) AS results_dup_drivers, coalesce(winners, 0) AS winners,
        coalesce(laps_rows, 0) AS laps_rows, coalesce(laps_drivers, 0) AS laps_drivers, laptime_null_frac AS u, unreadable, CASE WHEN unreadable THEN 0 ELSE weather_rows END AS weather_rows, CASE WHEN unreadable THEN 0 ELSE track_rows END AS track_status_rows, CASE WHEN unreadable THEN '' ELSE missing_tables END AS missing_tables
    FROM rmk LEFT JOIN ar USING (year, round, session) LEFT JOIN al USING (year, round, session)
), sa AS (
    SELECT *, list_filter([CASE WHEN unreadable THEN 'unreadable_marker' END, CASE WHEN results_rows NOT BETWEEN 18 AND 25 THEN 'unusual_result_rows' END, CASE WHEN results_dup_drivers > 0 THEN 'duplicate_drivers' END,
        CASE WHEN kind = 'race' AND results_rows > 0 AND results_null_position > 0.2 * results_rows THEN 'many_null_positions' END, CASE WHEN kind = 'race' AND results_rows > 0 AND winners <> 1 THEN 'no_single_winner' END,
        CASE WHEN laps_rows = 0 THEN 'no_laps' END, CASE WHEN laps_rows > 0 AND kind = 'race' AND (u IS NULL OR u > 0.25) THEN 'many_null_laptimes' END, CASE WHEN laps_rows > 0 AND kind = 'race' AND u > 0.05 AND u <= 0.25 THEN 'some_untimed_laps' END,
        CASE WHEN laps_rows > 0 AND laps_drivers < results_rows - 2 THEN 'laps_missing_drivers' END, CASE WHEN weather_rows = 0 THEN 'no_weather' END], lambda f: f IS NOT NULL) AS f FROM ax
), sv AS (
    SELECT year, round, session, kind, results_rows, results_null_position, results_dup_drivers, laps_rows, laps_drivers, round(u, 6) AS laptime_null_frac, weather_rows, track_status_rows, missing_tables, array_to_string(f, ',') AS flags,
        NOT list_has_any(f, ['unusual_result_rows', 'duplicate_drivers', 'many_null_positions', 'no_single_winner', 'unreadable_marker']) AS results_ok,
        NOT list_has_any(f, ['no_laps', 'many_null_laptimes', 'laps_missing_drivers', 'unreadable_marker']) AS laps_ok, NOT list_contains(f, 'no_weather') AS weather_ok FROM sa
)"""
WEEKEND = """, wg AS (
    SELECT *, best / min(best) OVER (PARTITION BY year, round, session) * 100 - 100 AS gap FROM (SELECT year, round, session, code, min(seconds) AS best FROM rlaps WHERE seconds IS NOT NULL AND valid GROUP BY year, round, session, code)
), wp AS (SELECT *, max(session) OVER (PARTITION BY year, round) AS final FROM wg WHERE session LIKE 'Practice%' AND (round % 3 <> 0 OR session = 'Practice 1')),
wn AS (SELECT year, round, CAST(count(DISTINCT session) AS DOUBLE) AS n FROM wp GROUP BY year, round),
wo AS (SELECT year, round, code, min(gap) AS b, max(CASE WHEN session = final THEN gap END) AS l FROM wp GROUP BY year, round, code),
ws AS (SELECT year, round, code, gap AS g, CAST(rank() OVER (PARTITION BY year, round ORDER BY gap) AS DOUBLE) AS p FROM wg WHERE session = 'Sprint Qualifying' AND round % 3 = 0),
wk AS (
    SELECT h.year, h.round, h.code, h.driver, h.team, b AS pq_fp_best_gap, l AS pq_fp_last_gap, coalesce(n, 0.0) AS pq_fp_n, p AS pq_sprintq_pos, g AS pq_sprintq_gap, CASE WHEN h.round % 3 = 0 THEN h.quali END AS pq_sprint_pos
    FROM league h LEFT JOIN wn USING (year, round) LEFT JOIN wo USING (year, round, code) LEFT JOIN ws USING (year, round, code)
)"""
READINGS = ", wx AS (SELECT year, round, avg(l_quantity) AS wx_air_temp, avg(l_tax * 1000) AS wx_track_temp, avg(l_discount * 1000) AS wx_humidity, avg(l_extendedprice / 1000) AS wx_wind_speed, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS wx_rain_frac FROM ln GROUP BY year, round)"
BUILT = SESSION_AUDIT + WEEKEND + READINGS + """, bm0 AS (
    SELECT year, round, code, quantile_cont(seconds, 0.5) AS m FROM rlaps WHERE session = 'Race' AND seconds IS NOT NULL AND accurate AND track = '1' AND NOT pit_in AND NOT pit_out AND valid GROUP BY year, round, code HAVING count(*) >= 5
), bf AS (SELECT year, round, quantile_cont(m, 0.5) AS f FROM bm0 GROUP BY year, round HAVING count(*) >= 10),
bq AS (SELECT year, round, code, position, least(q1, q2, q3) / min(least(q1, q2, q3)) OVER (PARTITION BY year, round) * 100 - 100 AS gap FROM rq),
built AS (
    SELECT h.year, h.round, h.no, h.driver, h.code, CASE h.team WHEN 'MIDDLE EAST' THEN 'AFRICA' WHEN 'ASIA' THEN 'ASIA-PACIFIC' ELSE h.team END AS team, h.position, h.grid, h.points, h.dnf OR h.position IS NULL AS dnf, h.circuit,
        bq.position AS quali, bq.gap AS quali_gap, CASE WHEN laps_ok THEN m / f * 100 - 100 END AS pace_gap, wx.wx_air_temp, wx_track_temp, wx_humidity, wx_wind_speed, wx.wx_rain_frac,
        pq_fp_best_gap, pq_fp_last_gap, pq_fp_n, pq_sprintq_pos, pq_sprintq_gap, pq_sprint_pos, coalesce(results_ok, false) AND h.race_ok AS race_ok
    FROM league h LEFT JOIN bq USING (year, round, code) LEFT JOIN bm0 USING (year, round, code) LEFT JOIN bf USING (year, round) LEFT JOIN wx USING (year, round) LEFT JOIN wk USING (year, round, code)
    LEFT JOIN (SELECT * FROM sv WHERE session = 'Race') USING (year, round)
)"""
FULL_BOARD = f""", mb AS (SELECT model, count(*) AS races, {', '.join(f'avg({m}) AS {m}' for m in M)} FROM pr GROUP BY model),
bb AS (SELECT arg_max(model, spearman) AS best FROM mb WHERE model IN ('grid', 'previous')),
gg AS (SELECT a.model, a.year, a.round, a.spearman - b.spearman AS gain FROM pr a JOIN pr b USING (year, round) JOIN bb ON b.model = best),
wn AS (SELECT model, CAST(sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) AS BIGINT) AS seasons_better, count(*) AS seasons FROM (SELECT model, year, avg(gain) AS g FROM gg GROUP BY model, year) GROUP BY model),
ge AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY year, round) AS k, row_number() OVER (PARTITION BY model, year ORDER BY round) AS ky FROM gg),
t1 AS (SELECT max(k) AS t FROM ge), t2 AS (SELECT year, count(*) AS races, row_number() OVER (ORDER BY year) AS s FROM (SELECT DISTINCT year, round FROM gg) GROUP BY year), t3 AS (SELECT max(s) AS t FROM t2),
i1 AS (SELECT i, CAST(floor({uni("concat_ws('-', 0, i, d)")} * t) + 1 AS BIGINT) AS k FROM (SELECT i, t, unnest(range(1, t + 1)) AS d FROM (SELECT unnest(range(2000)) AS i), t1)),
c1 AS (SELECT i, d, CAST(floor({uni("concat_ws('-', 0, i, d)")} * t) + 1 AS BIGINT) AS s FROM (SELECT i, t, unnest(range(1, t + 1)) AS d FROM (SELECT unnest(range(2000)) AS i), t3)),
c2 AS (SELECT i, year, CAST(floor({uni("concat_ws('-', 0, i, d, e)")} * races) + 1 AS BIGINT) AS ky FROM (SELECT i, d, year, races, unnest(range(1, races + 1)) AS e FROM c1 JOIN t2 USING (s))),
ci AS (SELECT model, quantile_cont(m, 0.025) AS iid_low, quantile_cont(m, 0.975) AS iid_high FROM (SELECT model, i, avg(gain) AS m FROM i1 JOIN ge USING (k) GROUP BY model, i) GROUP BY model),
cc AS (SELECT model, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT model, i, avg(gain) AS m FROM c2 JOIN ge USING (year, ky) GROUP BY model, i) GROUP BY model),
vs AS (SELECT model, avg(gain) AS v FROM gg GROUP BY model)
SELECT model, model IN ('grid', 'previous') AS is_baseline, {', '.join(f'round({m}, 6) AS {m}' for m in M)}, races, CASE WHEN model = best THEN 0.0 ELSE round(v, 6) END AS vs_best_baseline,
    CASE WHEN model <> best THEN round(low, 6) END AS ci_low, CASE WHEN model <> best THEN round(high, 6) END AS ci_high, CASE WHEN model <> best THEN round(iid_low, 6) END AS iid_ci_low, CASE WHEN model <> best THEN round(iid_high, 6) END AS iid_ci_high,
    seasons_better, seasons, model <> best AND v > 0 AS beats_best_baseline, model <> best AND low > 0 AS clearly_beats
FROM mb JOIN wn USING (model) JOIN vs USING (model) JOIN ci USING (model) JOIN cc USING (model), bb ORDER BY spearman DESC"""
WX = ("wx_air_temp", "wx_track_temp", "wx_humidity", "wx_wind_speed", "wx_rain_frac")
PQ = ("pq_fp_best_gap", "pq_fp_last_gap", "pq_fp_n", "pq_sprintq_pos", "pq_sprintq_gap", "pq_sprint_pos")
L = LEAGUE_SQL
FLOATS = ("position", "grid", "quali", "quali_gap", "pace_gap", "points", "wx_rain_frac", "wx_air_temp", "fp_best_gap", "fp_last_gap")
ORACLE_SQL: dict[str, str] = {
    "history_table": f"{L} SELECT year, round, no, driver, code, team, circuit, {rounded(*FLOATS)}, dnf, race_ok FROM league",
    "driver_form": f"{L}{DRIVER_FORM} SELECT {RANGE}, {rounded('drv_finish_l5', 'drv_grid_l5', 'drv_quali_l5', 'drv_qgap_l5', 'drv_pace_l5', 'drv_dnf_l10', 'drv_pts_share_ytd')}, drv_n_l5, CAST(drv_rounds_since_last AS BIGINT) AS drv_rounds_since_last FROM df",
    "team_form": f"{L}{SEASON}{TEAM_FORM} SELECT year, round, team, {rounded('team_finish_l5', 'team_qgap_l5', 'team_pace_l3', 'team_dnf_l10', 'team_pts_share_ytd')} FROM tf",
    "recency_form": f"{L}{USABLE}, {RECENT} SELECT {RANGE}, {rounded(*(f'{n}_ew{h}' for n in ('drv_qgap', 'drv_quali', 'team_qgap') for h in (2, 4, 8)))} FROM own JOIN teams USING (year, round, team)",
    "circuit_history": f"{L}{CIRCUIT}",
    "context": f"{L} SELECT DISTINCT year, round, round AS season_round, year - CASE WHEN year >= 2000 THEN 2000 WHEN year >= 1998 THEN 1998 ELSE 1995 END AS seasons_since_reg_change FROM league",
    "weekend_pace": f"""{L} SELECT {RANGE}, round(fp_best_gap, 6) AS pq_fp_best_gap, round(fp_last_gap, 6) AS pq_fp_last_gap,
        CASE WHEN fp_best_gap IS NOT NULL THEN rank() OVER (PARTITION BY year, round ORDER BY fp_best_gap NULLS LAST) + (count(fp_best_gap) OVER (PARTITION BY year, round, fp_best_gap) - 1) / 2.0 END AS pq_fp_best_rank,
        round(fp_best_gap - CASE WHEN count(fp_best_gap) OVER w - CASE WHEN fp_best_gap IS NULL THEN 0 ELSE 1 END > 0 THEN (sum(fp_best_gap) OVER w - coalesce(fp_best_gap, 0)) / (count(fp_best_gap) OVER w - CASE WHEN fp_best_gap IS NULL THEN 0 ELSE 1 END) END, 6) AS pq_fp_vs_teammate
        FROM league WINDOW w AS (PARTITION BY year, round, team)""",
    "weather_scenario": f"{L} SELECT DISTINCT year, round, wx_air_temp, CAST(wx_rain_frac AS DOUBLE) AS wx_rain_frac, CAST(CASE WHEN wx_rain_frac > 0 THEN 1 WHEN wx_rain_frac IS NOT NULL THEN 0 END AS DOUBLE) AS wx_is_wet FROM league",
    "grid_features": f"{L}{GRID} SELECT {RANGE}, grid, CAST(grid_pit_lane AS DOUBLE) AS grid_pit_lane, round(grid / n, 6) AS grid_frac FROM gf",
    "race_calendar": f"{L}{USABLE} SELECT year, round, CAST(race_idx AS INTEGER) AS race_idx, CAST(usable_before AS BIGINT) AS usable_before FROM cal",
    "as_of_before": f"{L} SELECT {RANGE}, position FROM league WHERE (year, round) < (1998, 6)",
    "usable_history": f"{L} SELECT {RANGE}, position FROM league WHERE race_ok",
    "duplicate_entries": f"{L} SELECT {RANGE}, CAST(2 AS BIGINT) AS times FROM league WHERE no = 3 AND round = 4",
    "latest_grid": f"{L} SELECT DISTINCT driver FROM league WHERE year * 100 + round = (SELECT max(year * 100 + round) FROM league)",
    "eligible_circuit_years": f"{L}{ELIGIBLE} SELECT CAST(t AS INTEGER) AS t, past_year, raced, entrants FROM el",
    "training_frame": f"{L}{DRIVER_FORM}{TEAM_FORM}{GRID} SELECT l.year, l.round, l.driver, l.position AS y, round(drv_finish_l5, 6) AS drv_finish_l5, round(team_finish_l5, 6) AS team_finish_l5, l.round AS season_round, gf.grid, round(gf.grid / gf.n, 6) AS grid_frac FROM league l JOIN df USING (year, round, driver) JOIN tf USING (year, round, team) JOIN gf USING (year, round, driver) WHERE race_ok AND l.position IS NOT NULL",
    "feature_missing": f"{L}{DRIVER_FORM} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{'key' if c in RANGE else 'feature'}' AS role, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM df"
        for c in ("year", "round", "driver", "drv_finish_l5", "drv_grid_l5", "drv_quali_l5", "drv_qgap_l5", "drv_pace_l5", "drv_n_l5", "drv_dnf_l10", "drv_pts_share_ytd", "drv_rounds_since_last")
    ),
    "dim_drivers": f"{L} {dimension('driver', code='code', team='team')}",
    "dim_teams": f"{L} {dimension('team', last_driver='driver')}",
    "dim_circuits": f"{L} {dimension('circuit', last_winner='driver')}",
    "weekend_table": f"""{LAPS}, we AS (SELECT *, CAST(floor(datediff('day', DATE '2024-01-01', session) / 3.0) AS INTEGER) AS event FROM gaps),
        we2 AS (SELECT *, max(session) OVER (PARTITION BY event) AS final FROM we)
        SELECT event, driver, round(min(best_gap_pct), 6) AS fp_best_gap, round(max(CASE WHEN session = final THEN best_gap_pct END), 6) AS fp_last_gap,
            CAST((SELECT count(DISTINCT session) FROM we z WHERE z.event = we2.event) AS INTEGER) AS fp_n FROM we2 GROUP BY event, driver""",
    "clean_laps": f"{LAPS} SELECT session, driver, CAST(lap AS INTEGER) AS lap, round(seconds, 6) AS seconds FROM valid WHERE kind = 'view'",
    "pace_gap": f"""{LAPS}, md AS (SELECT session, driver, quantile_cont(seconds, 0.5) AS m FROM valid WHERE kind = 'view' GROUP BY session, driver HAVING count(*) >= 3),
        fd AS (SELECT session, quantile_cont(m, 0.5) AS f FROM md GROUP BY session HAVING count(*) >= 10) SELECT session, driver, round(m / f * 100 - 100, 6) AS pace_gap_pct FROM md JOIN fd USING (session)""",
    "best_lap_gap": f"{LAPS} SELECT session, driver, {rounded('best', 'best_gap_pct')} FROM gaps",
    "quali_gap": f"{LAPS} SELECT session, driver, {rounded('best', 'best_gap_pct').replace('AS best_gap_pct', 'AS quali_gap_pct')} FROM gaps",
    "weather_summary": "SELECT CAST(ts AS DATE) AS session, round(avg(value), 6) AS air_temp, round(avg(event_id % 11), 6) AS wind_speed, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS rain_share FROM events GROUP BY 1",
    "race_quality_audit": f"{AUDIT} SELECT session, n_laps, n_drivers, round(null_share, 6) AS null_share, n_repeated, flags, flags = '' AS laps_ok FROM aud",
    "flag_counts": f"{AUDIT} SELECT flag, count(*) AS sessions FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM aud WHERE flags <> '') GROUP BY flag",
    "earlier_sessions": f"{SCHEDULE} {SESSION} JOIN (SELECT year, round, start AS cutoff FROM ses WHERE kind = 'qualifying') USING (year, round) WHERE start < cutoff",
    "finished_sessions": f"{SCHEDULE} {SESSION} WHERE {DONE}",
    "pending_sessions": f"{SCHEDULE} {SESSION} WHERE {DONE} AND (round * 7 + slot) % 4 = 0",
    "dnf_flag": "SELECT o_orderkey, NOT coalesce(regexp_full_match(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 20 + 1 AS VARCHAR) END, '[0-9]+'), false) AS dnf FROM orders",
    "slugify": "SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' -', p_name, p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    "circuit_id": """SELECT n_nationkey, trim(regexp_replace(lower(n_name || ' E Sao'), '[^a-z0-9]+', '_', 'g'), '_') AS circuit_id,
        CASE s WHEN 'united_states' THEN 'usa' WHEN 'united_kingdom' THEN 'uk' ELSE s END AS plain_id FROM (SELECT *, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM nation)""",
    "team_lineage": "SELECT r_regionkey, CASE r_name WHEN 'MIDDLE EAST' THEN 'AFRICA' WHEN 'ASIA' THEN 'ASIA-PACIFIC' ELSE r_name END AS team_key FROM region",
    "baseline_grid": f"{L}{BASE_GRID} SELECT model, {RANGE}, round(score, 6) AS score FROM bg",
    "baseline_previous": f"{L}{BASE_PREVIOUS} SELECT model, {RANGE}, round(score, 6) AS score FROM bp",
    "baseline_mean_last5": f"{L}{BASE_MEAN} SELECT model, {RANGE}, round(score, 6) AS score FROM bm",
    "baseline_previous_quali": f"{L}{BASE_PREVIOUS.replace('THEN position END', 'THEN quali END')} SELECT model, {RANGE}, round(score, 6) AS score FROM bp",
    "baseline_mean_last5_quali": f"{L}{BASE_MEAN.replace('position', 'quali')} SELECT model, {RANGE}, round(score, 6) AS score FROM bm",
    "baseline_practice": f"{L}{BASE_PRACTICE} SELECT model, {RANGE}, round(score, 6) AS score FROM bx",
    "race_metrics": f"{L}{METRICS} SELECT model, year, round, n, {rounded(*M)} FROM pr",
    "metrics_summary": f"{L}{METRICS} SELECT model, year, count(*) AS races, {', '.join(f'round(avg({m}), 6) AS {m}' for m in M)} FROM pr GROUP BY GROUPING SETS ((model, year), (model))",
    "metrics_coverage": f"""{L}{METRICS}, cov AS (SELECT * FROM pr WHERE NOT (model = 'grid' AND round = 3)), every AS (SELECT count(DISTINCT (year, round)) AS all_races FROM cov)
        SELECT model, rows, races, all_races FROM (SELECT model, count(*) AS rows, count(DISTINCT (year, round)) AS races FROM cov GROUP BY model), every WHERE rows <> races OR races <> all_races""",
    "leaderboard": f"""{L}{METRICS}, lb AS (SELECT a.model, a.year, sum(a.spearman) AS m, sum(a.spearman - b.spearman) AS g, count(*) AS n FROM pr a JOIN pr b USING (year, round) WHERE b.model = 'previous' GROUP BY a.model, a.year)
        SELECT model, round(sum(m) / sum(n), 6) AS spearman, round(sum(g) / sum(n), 6) AS gain, CAST(sum(CASE WHEN g > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS seasons_better, count(*) AS seasons, CAST(sum(n) AS BIGINT) AS races FROM lb GROUP BY model""",
    "walk_forward_splits": f"{L}, ys AS (SELECT DISTINCT year FROM league) SELECT a.year, count(*) AS train_seasons, min(b.year) AS first_train, max(b.year) AS last_train FROM ys a JOIN ys b ON b.year < a.year WHERE a.year <> 2001 GROUP BY a.year",
    "bootstrap_iid": L + GAINS + boot(f""", nb AS (SELECT row_number() OVER (ORDER BY year, round) AS k, gain FROM gains), dw AS (SELECT i, unnest(range(1, t + 1)) AS d, t FROM (SELECT unnest(range(200)) AS i), (SELECT max(k) AS t FROM nb)),
        picked AS (SELECT i, gain FROM (SELECT i, CAST(floor({uni("concat_ws('-', 1, i, d)")} * t) + 1 AS BIGINT) AS k FROM dw) JOIN nb USING (k))"""),
    "bootstrap_clustered": L + GAINS + boot(f""", sn AS (SELECT year, count(*) AS races, row_number() OVER (ORDER BY year) AS s FROM gains GROUP BY year), dw AS (SELECT i, unnest(range(1, t + 1)) AS d, t FROM (SELECT unnest(range(200)) AS i), (SELECT max(s) AS t FROM sn)),
        dz AS (SELECT i, d, year, races FROM (SELECT i, d, CAST(floor({uni("concat_ws('-', 1, i, d)")} * t) + 1 AS BIGINT) AS s FROM dw) JOIN sn USING (s)), de AS (SELECT *, unnest(range(1, races + 1)) AS e FROM dz),
        picked AS (SELECT i, gain FROM (SELECT i, year, CAST(floor({uni("concat_ws('-', 1, i, d, e)")} * races) + 1 AS BIGINT) AS k FROM de) JOIN (SELECT year, row_number() OVER (PARTITION BY year ORDER BY round) AS k, gain FROM gains) USING (year, k))"""),
    "recent_dnf_rate": f"{L}{DNF_RATE} SELECT year, round, round(dnf_rate, 6) AS dnf_rate FROM dr",
    "simulate_race": f"{L}{FIELD}{sims(200)} SELECT year, round, CAST(sim AS INTEGER) AS sim, driver, retired, CAST(place AS INTEGER) AS place FROM sim",
    "baseline_probabilities": f"{L} SELECT {RANGE}, " + ", ".join(f"round(least(1.0, {k} / count(*) OVER (PARTITION BY year, round)), 6) AS p_{e}" for e, k in (("win", 1), ("podium", 3), ("top10", 10))) + " FROM league",
    "outcomes": f"{L}{OUTCOMES} SELECT * FROM oc",
    "logloss_brier": f"{L}{PRIOR}{OUTCOMES} SELECT year, round, " + ", ".join(f"round({logloss('p_' + e, 'y_' + e)}, 6) AS logloss_{e}, round(avg(pow(p_{e} - CASE WHEN y_{e} THEN 1 ELSE 0 END, 2)), 6) AS brier_{e}" for e in ("win", "podium", "top10")) + " FROM prior JOIN oc USING (year, round, driver) GROUP BY year, round",
    "reliability_bins": f"{L}{BINS} SELECT bin, {rounded('mean_p', 'rate')}, n FROM rel",
    "ece": f"{L}{BINS} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM rel",
    "build_history": f"{L}{BUILT} SELECT year, round, no, driver, code, team, circuit, {rounded('position', 'grid', 'points', 'quali', 'quali_gap', 'pace_gap', *WX, *PQ)}, dnf, race_ok FROM built",
    "previous_race_equals_quali": f"{L}{BASE_PREVIOUS} SELECT 'previous_race' AS model, {RANGE}, round(score, 6) AS score FROM bp",
    "quali_metrics": (L + BASE_PREVIOUS + BASE_PREVIOUS.replace("bp", "bq").replace("THEN position END", "THEN quali END") + BASE_MEAN.replace("position", "quali") + BASE_PRACTICE
        + ", scores AS (SELECT year, round, driver, 'previous_race' AS model, score FROM bp UNION ALL SELECT year, round, driver, 'previous', score FROM bq UNION ALL SELECT year, round, driver, model, score FROM bm UNION ALL SELECT year, round, driver, model, score FROM bx)"
        + METRICS.removeprefix(SCORES).replace("position", "quali")).replace("mae_quali", "mae_position") + f" SELECT model, year, round, n, {rounded(*M)} FROM pr",
    "qgap_training_frame": f"""{L}{CIRCUIT_HISTORY}, {RECENT.replace("cars AS", "rcars AS").replace("FROM cars", "FROM rcars")}, own5 AS (SELECT year, round, driver, {masked('position', 5, 'driver')} AS l5, count(CASE WHEN race_ok THEN position END) OVER (PARTITION BY driver ORDER BY k RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n5 FROM ci0),
        tc AS (SELECT year, round, team, avg(position) AS position, bool_and(race_ok) AS race_ok FROM league GROUP BY year, round, team), tk AS (SELECT *, {usable_rank('team')} FROM tc), t5 AS (SELECT year, round, team, {masked('position', 5, 'team')} AS t5 FROM tk)
        SELECT l.year, l.round, l.driver, round(l.quali_gap, 6) AS y, round(l5, 6) AS drv_finish_l5, n5 AS drv_n_l5, round(t5, 6) AS team_finish_l5, l.round AS season_round, round(drv_qgap_ew4, 6) AS drv_qgap_ew4, round(drv_quali_ew4, 6) AS drv_quali_ew4,
        round(team_qgap_ew4, 6) AS team_qgap_ew4, round(l.fp_best_gap, 6) AS pq_fp_best_gap, circ_drv_n
        FROM league l JOIN own5 USING (year, round, driver) JOIN t5 USING (year, round, team) JOIN own USING (year, round, driver) JOIN teams USING (year, round, team) JOIN ch USING (year, round, driver) WHERE l.race_ok AND l.quali_gap IS NOT NULL""",
    "with_grids": f"""{L}, s AS (SELECT year, round, driver, CASE WHEN no % 7 <> 0 AND quali > 0 THEN quali END AS slot FROM league)
        SELECT {RANGE}, coalesce(slot, coalesce(max(slot) OVER w, 0) + 1) AS grid, CAST(0 AS DOUBLE) AS grid_pit_lane, round(coalesce(slot, coalesce(max(slot) OVER w, 0) + 1) / count(*) OVER w, 6) AS grid_frac FROM s WINDOW w AS (PARTITION BY year, round)""",
    "eligible_years_at": f"{L}{LISTS} SELECT list, past_year, raced, entrants FROM le",
    "serving_features": f"""{L}{LISTS}{SERVED} SELECT list, year, round, driver, round(l5, 6) AS drv_finish_l5, coalesce(n5, 0) AS drv_n_l5, round(d10, 6) AS drv_dnf_l10, round(t5, 6) AS team_finish_l5,
        round((coalesce(n, 0) * coalesce(m, 0.0) + 3 * coalesce(l20, field_mean)) / (coalesce(n, 0) + 3), 6) AS circ_drv_finish, coalesce(n, 0) AS circ_drv_n, coalesce(years, 0) AS circ_n_years, round AS season_round, gr.grid
        FROM lf LEFT JOIN own USING (rid) LEFT JOIN teams USING (rid) LEFT JOIN fld USING (rid) LEFT JOIN mine USING (list, driver) LEFT JOIN ny USING (list) JOIN gr USING (list, driver)""",
    "session_ingest": f"""{L}{RAW_SQL}, ks AS (SELECT year, round, session FROM rlaps UNION SELECT year, round, session FROM rres),
        nl AS (SELECT year, round, session, count(*) AS l FROM rlaps GROUP BY ALL), nr AS (SELECT year, round, session, count(*) AS r FROM rres GROUP BY ALL),
        nw AS (SELECT year, round, 'Race' AS session, count(*) AS w FROM ln WHERE (year + round * 5) % 11 <> 0 GROUP BY ALL),
        why AS (SELECT year, round, session, coalesce(l, 0) AS l, coalesce(r, 0) AS r, coalesce(w, 0) AS w, concat_ws('; ', CASE WHEN l IS NULL AND session <> 'Sprint' THEN 'laps: empty' END,
            CASE WHEN r IS NULL AND session IN ('Race', 'Qualifying', 'Sprint') THEN 'results: empty' END, CASE WHEN w IS NULL AND session = 'Race' THEN 'weather: empty' END) AS refused
            FROM ks LEFT JOIN nl USING (year, round, session) LEFT JOIN nr USING (year, round, session) LEFT JOIN nw USING (year, round, session))
        SELECT year, round, session, refused = '' AS done, refused, CASE WHEN refused = '' THEN l ELSE 0 END AS n_laps, CASE WHEN refused = '' THEN r ELSE 0 END AS n_results, CASE WHEN refused = '' THEN w ELSE 0 END AS n_weather FROM why""",
    "session_audit": f"{L}{SESSION_AUDIT} SELECT * FROM sv",
    "audit_summary_by_kind": f"""{L}{SESSION_AUDIT} SELECT kind, count(*) AS sessions, CAST(sum(CASE WHEN results_ok THEN 1 ELSE 0 END) AS BIGINT) AS results_ok, CAST(sum(CASE WHEN laps_ok THEN 1 ELSE 0 END) AS BIGINT) AS laps_ok,
        CAST(sum(CASE WHEN weather_ok THEN 1 ELSE 0 END) AS BIGINT) AS weather_ok, CAST(sum(CASE WHEN flags = 'some_untimed_laps' THEN 1 ELSE 0 END) AS BIGINT) AS informational FROM sv GROUP BY kind""",
    "unmatched_events": f"{L} SELECT DISTINCT year, round FROM league WHERE (year * 12 + round) % 5 = 0",
    "weekend_features": f"{L}{RAW_SQL}{WEEKEND} SELECT year, round, code, {rounded(*PQ)} FROM wk",
    "weather_features": f"{L}{BUILT} SELECT DISTINCT year, round, {rounded(*WX)}, CAST(CASE WHEN wx_rain_frac > 0 THEN 1 WHEN wx_rain_frac IS NOT NULL THEN 0 END AS DOUBLE) AS wx_is_wet FROM built",
    "weekend_pace_full": f"""{L}{RAW_SQL}{WEEKEND} SELECT year, round, driver, {rounded(*PQ)},
        CASE WHEN pq_fp_best_gap IS NOT NULL THEN rank() OVER (PARTITION BY year, round ORDER BY pq_fp_best_gap NULLS LAST) + (count(pq_fp_best_gap) OVER (PARTITION BY year, round, pq_fp_best_gap) - 1) / 2.0 END AS pq_fp_best_rank,
        round(pq_fp_best_gap - CASE WHEN count(pq_fp_best_gap) OVER w > CASE WHEN pq_fp_best_gap IS NULL THEN 0 ELSE 1 END THEN (sum(pq_fp_best_gap) OVER w - coalesce(pq_fp_best_gap, 0)) / (count(pq_fp_best_gap) OVER w - CASE WHEN pq_fp_best_gap IS NULL THEN 0 ELSE 1 END) END, 6) AS pq_fp_vs_teammate
        FROM (SELECT * REPLACE (CASE team WHEN 'MIDDLE EAST' THEN 'AFRICA' WHEN 'ASIA' THEN 'ASIA-PACIFIC' ELSE team END AS team) FROM wk) WINDOW w AS (PARTITION BY year, round, team)""",
    "calendar_events": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS round, CAST((month(o_orderdate) - 1) % 6 AS INTEGER) AS circuit FROM orders",
    "full_leaderboard": f"""{L}{METRICS}{FULL_BOARD}""",
    "relevance_labels": f"{L} SELECT {RANGE}, greatest(23 - position, 1.0) AS relevance FROM league WHERE position IS NOT NULL",
    "fit_total": f"""{L}{PRIOR}, ft AS (
        SELECT year, round, driver, p_podium AS p, row_number() OVER w AS i, sum(p_podium) OVER (PARTITION BY year, round ORDER BY p_podium DESC, driver ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
            least(3.0, count(*) OVER (PARTITION BY year, round)) AS total FROM prior WINDOW w AS (PARTITION BY year, round ORDER BY p_podium DESC, driver)
    ), fm AS (SELECT year, round, arg_min((total - (i - 1)) / rest, i) AS scale, min(i) AS m FROM ft WHERE rest > 0 AND p * (total - (i - 1)) <= rest * (1 + 1e-12) GROUP BY year, round)
    SELECT {RANGE}, round(CASE WHEN m IS NULL OR i < m THEN 1.0 ELSE least(1.0, p * scale) END, 6) AS p_podium FROM ft LEFT JOIN fm USING (year, round)""",
    "named_results": f"{L}{RAW_SQL} SELECT year, round, session, code, position FROM rres WHERE session <> 'Qualifying'",
    "races_that_count": f"{L} SELECT DISTINCT year, round FROM league WHERE race_ok",
}

#: Queries that run on the wide league, too.
ON_WIDE = {
    "wide_history": "history_table", "wide_driver_form": "driver_form", "wide_team_form": "team_form", "wide_circuit_history": "circuit_history", "wide_eligible_years": "eligible_circuit_years",
    "wide_grid_features": "grid_features", "wide_mean_last5": "baseline_mean_last5", "wide_race_metrics": "race_metrics", "wide_leaderboard": "leaderboard",
}
ORACLE_SQL |= {wide: ORACLE_SQL[name].replace(LEAGUE_SQL, WIDE_LEAGUE_SQL) for wide, name in ON_WIDE.items()}
