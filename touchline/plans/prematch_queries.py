"""Queries about fixtures before they are played, coming ones too: vectors, components, ratings, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import odds as O  # noqa: N812
from touchline.functions.context import SIDES, context_features, fill_context, weather_severity
from touchline.operators import asof, prematch, ratings, runtime, state
from touchline.plans.queries import CELLS, HIST_ALL, MEANS, ORACLES, RATES, RATES_ASOF, TEST, TODAY, VALIDATION, VIEW, query, r6
from touchline.sources.fixture_sql import CONTEXT_COLUMNS, CONTEXT_ROWS, MORE_COLUMNS, with_matches
from touchline.sources.shared import shared_path, stored

CONTEXT = f", ctx as (select match_id, {', '.join(CONTEXT_COLUMNS)} from matches where {CONTEXT_ROWS})"
_ABSENT = "coalesce({s}_absence_count, case when {s}_injury_count is not null or {s}_suspension_count is not null then coalesce({s}_injury_count, 0) + coalesce({s}_suspension_count, 0) end)"
FILLED = (
    CONTEXT
    + f""", f0 as (select * replace ({", ".join(f"{_ABSENT.format(s=s)} as {s}_absence_count" for s in SIDES)}), {", ".join(f"cast({s}_manager_days <= 30 as double) as {s}_manager_change_recent" for s in SIDES)},
   coalesce(home_absence_strength_loss, 0) - coalesce(away_absence_strength_loss, 0) as absence_strength_loss_diff, cast(coalesce(temperature_c, wind_kph, precipitation_mm) is not null as double) as weather_available from ctx),
 filled as (select *, cast(coalesce({", ".join(f"{s}_{c}" for s in SIDES for c in ("absence_count", "injury_count", "suspension_count", "key_absence_count", "manager_change_recent"))}) is not null as double) as team_news_available from f0)
"""
)


def _context(m):
    return m.where(CONTEXT_ROWS).selectExpr("match_id", *CONTEXT_COLUMNS)


@query(FILLED + "select match_id, home_absence_count, away_absence_count, home_manager_change_recent, away_manager_change_recent, round(absence_strength_loss_diff, 6) as absence_strength_loss_diff, team_news_available, weather_available from filled")
def context_fills(m):
    return r6(fill_context(_context(m)).select("match_id", "home_absence_count", "away_absence_count", "home_manager_change_recent", "away_manager_change_recent", "absence_strength_loss_diff", "team_news_available", "weather_available"))


@query(CONTEXT + "select match_id, round(least(5, abs(temperature_c - 15) / 20 + greatest(0, wind_kph) / 40 + greatest(0, precipitation_mm) / 10), 6) as severity from ctx where temperature_c is not null")
def weather_severity_of_matches(m):
    rows = _context(m).where("temperature_c is not null")
    return r6(rows.select("match_id", weather_severity(F.col("temperature_c"), F.col("wind_kph"), F.col("precipitation_mm")).alias("severity")))


#: History of every fixture's teams, coming fixtures too.
HIST_FIXTURES = HIST_ALL.replace("days as (select distinct league, team, date from played)", "days as (select distinct league, team, date from sides)")
FORM_FIXTURES = (
    HIST_FIXTURES
    + f""", f5 as (select league, team, date, {", ".join(f"avg({c}) as {n}" for n, c in MEANS.items())}, sum(points) / (3.0 * count(*)) as form, count(*) as n_recent from hist where n <= 5 group by league, team, date),
 lastday as (select d.league, d.team, d.date, max(p.date) as day from days d join played p on p.league = d.league and p.team = d.team and p.date < d.date group by all),
 known as (select d.league, d.team, d.date, {", ".join(f"coalesce({n}, 0) as {n}" for n in MEANS)}, coalesce(form, 0) as form, coalesce(n_recent, 0) as n_recent,
   coalesce(least(greatest(date_diff('day', day, d.date), 0), 21) / 7.0, 1.0) as rest from days d left join f5 using (league, team, date) left join lastday using (league, team, date))
"""
)


@query(FORM_FIXTURES + "select league, team, date, n_recent, " + ", ".join(f"round({n}, 6) as {n}" for n in (*MEANS, "form", "rest")) + " from known")
def form_of_every_fixture(m):
    return r6(asof.fixture_means(m.selectExpr("*", *MORE_COLUMNS)).select("league", "team", "date", "n_recent", *MEANS, "form", "rest"))


def _diffs(names):
    return [x for n in names for x in (f"h.{n} as {n}_home_5", f"a.{n} as {n}_away_5", f"h.{n} - a.{n} as {n}_diff_5")]


_DEF = {"home_lineup_strength": 1, "away_lineup_strength": 1, "temperature_c": 15}
_D = lambda c: f"coalesce(f.{c}, {_DEF.get(c, 0)})"
_COUNTS = [x for c in ("absence_count", "injury_count", "suspension_count", "key_absence_count", "manager_change_recent") for x in (f"{_D('home_' + c)} as home_{c}", f"{_D('away_' + c)} as away_{c}", f"{_D('home_' + c)} - {_D('away_' + c)} as {c}_diff")]
_EXTRA = [
    *_diffs(prematch.LOCAL),
    *[f"case when priced then 1 / m.close_odds_{leg} / ci - 1 / m.open_odds_{leg} / oi else 0 end as market_move_{leg}" for leg in O.LEGS],
    "case when over_odds > 1.0001 and under_odds > 1.0001 then (1 / over_odds) / (1 / over_odds + 1 / under_odds) else 0.5 end as ou25_over_prob", "coalesce(ah_line, 0) as ah_line",
    *_diffs(prematch.XG),
    "coalesce(least(greatest(f.lineup_available, 0), 1), 0) as lineup_available", f"{_D('home_lineup_strength')} as home_lineup_strength", f"{_D('away_lineup_strength')} as away_lineup_strength",
    f"{_D('home_lineup_strength')} - {_D('away_lineup_strength')} as lineup_strength_diff", f"{_D('team_news_available')} as team_news_available", *_COUNTS,
    *[f"{_D(c)} as {c}" for c in ("weather_available", "temperature_c", "wind_kph", "precipitation_mm")],
    f"least(5, abs({_D('temperature_c')} - 15) / 20.0 + greatest(0, {_D('wind_kph')}) / 40.0 + greatest(0, {_D('precipitation_mm')}) / 10.0) as weather_severity",
    *[f"{_D(c)} as {c}" for c in ("home_absence_strength_loss", "away_absence_strength_loss")], f"{_D('home_absence_strength_loss')} - {_D('away_absence_strength_loss')} as absence_strength_loss_diff",
    *[f"cast(0 as double) as {s}_player_context_available" for s in SIDES],
]
EXTRA_NAMES = [x.rpartition(" as ")[2] for x in _EXTRA]
EXTRA = (
    FORM_FIXTURES
    + FILLED
    + f""", px as (select *, open_odds_home > 1.0001 and open_odds_draw > 1.0001 and open_odds_away > 1.0001 and close_odds_home > 1.0001 and close_odds_draw > 1.0001 and close_odds_away > 1.0001 as priced,
   1 / open_odds_home + 1 / open_odds_draw + 1 / open_odds_away as oi, 1 / close_odds_home + 1 / close_odds_draw + 1 / close_odds_away as ci from matches),
 extra as (select m.match_id, {", ".join(_EXTRA)} from px m join known h on h.league = m.league and h.date = m.date and h.team = m.home_team join known a on a.league = m.league and a.date = m.date and a.team = m.away_team
   left join filled f on f.match_id = m.match_id)
"""
)


def _extra(m):
    return prematch.extra_features(m.selectExpr("*", *MORE_COLUMNS), fill_context(_context(m)))


@query(EXTRA + "select match_id, " + ", ".join(f"round(cast({n} as double), 6) as {n}" for n in EXTRA_NAMES) + " from extra")
def extra_features(m):
    return r6(_extra(m))


@query(CONTEXT + "select match_id, coalesce(least(greatest(lineup_available, 0), 1), 0) as lineup_available from ctx")
def context_flags(m):
    c = _context(m)
    return c.select("match_id", context_features(c)["lineup_available"].alias("lineup_available"))


def elo_sql(k: float, home_adv: float, by_day: bool, of: str = "true") -> str:
    """``rated``: ratings before each match, and after those played, by a fold over each league's matches that
    carries two maps, the ratings at the start of the day and now."""
    entry = lambda m: f"case when cardinality({m}) >= 5 then list_sum(list_sort(map_values({m}))[1:3]) / 3 else cast(1500 as double) end"
    seen = "case when f.d = o.date then f.day else f.run end" if by_day else "f.run"
    get = lambda m, key, other: f"coalesce(map_extract({m}, {key})[1], {other})"
    return f""", ordered as (select match_id, league, date, home_team as h, away_team as a, home_goals as hg, away_goals as ag, row_number() over (partition by league order by date, match_id) as n from matches where {of}),
 fold as (
  select distinct league, cast(0 as bigint) as n, cast(null as date) as d, map(cast([] as int[]), cast([] as double[])) as day, map(cast([] as int[]), cast([] as double[])) as run,
    cast(null as bigint) as match_id, cast(null as double) as home_elo, cast(null as double) as away_elo, cast(null as double) as home_post, cast(null as double) as away_post from ordered
  union all
  select league, n, date, seen, case when played then map_concat(run, map([h, a], [rh + s, ra - s])) else run end, match_id, he, ae, case when played then rh + s end, case when played then ra - s end
  from (select *, {k} * (case when abs(hg - ag) <= 1 then 1 when abs(hg - ag) = 2 then 1.5 when abs(hg - ag) = 3 then 1.75 else 2 end) * ((case when hg > ag then 1 when hg = ag then 0.5 else 0 end) - 1 / (1 + pow(10, -(rh + {home_adv} - ra) / 400))) as s
   from (select *, {get("seen", "h", "es")} as he, {get("seen", "a", "es")} as ae, {get("run", "h", "er")} as rh, {get("run", "a", "er")} as ra
    from (select *, {entry("seen")} as es, {entry("run")} as er
     from (select o.*, o.hg is not null and o.ag is not null as played, f.run as run, {seen} as seen from fold f join ordered o on o.league = f.league and o.n = f.n + 1))))),
 rated as (select match_id, home_elo, away_elo, home_post, away_post from fold where n > 0)
"""


ORACLES["elo_day_frozen"] = with_matches(elo_sql(50.0, 80.0, True) + "select match_id, round(home_elo, 6) as home_elo, round(away_elo, 6) as away_elo from rated where home_post is not null")
ORACLES["elo_sequential"] = with_matches(elo_sql(40.0, 60.0, False) + "select match_id, round(home_elo, 6) as home_elo, round(away_elo, 6) as away_elo from rated where home_post is not null")


@query(elo_sql(50.0, 80.0, True) + f"select match_id, date, round(home_elo, 6) as home_elo, round(away_elo, 6) as away_elo from rated join matches using (match_id) where home_post is not null and {VALIDATION}")
def validation_rows_with_elo(m):
    """Ratings run over all matches in order; only the validation season's rows are kept."""
    return r6(ratings.elo(m, 50.0, 80.0).where(VALIDATION).select("match_id", "date", "home_elo", "away_elo"))


MOMENTUM = """, posts as (select m.league, m.date, m.match_id, m.home_team as team, home_post as post from matches m join rated using (match_id) union all select m.league, m.date, m.match_id, m.away_team, away_post from matches m join rated using (match_id)),
 gains as (select league, team, date, match_id, (post - lag(post, 3) over (partition by league, team order by date, match_id)) / 400 as gain from posts where post is not null),
 mdays as (select distinct league, team, date from posts),
 mom as (select d.league, d.team, d.date, coalesce(arg_max(coalesce(g.gain, 0), (g.date, g.match_id)), 0) as momentum from mdays d left join gains g on g.league = d.league and g.team = d.team and g.date < d.date group by all)
"""


ORACLES["elo_momentum"] = with_matches(elo_sql(50.0, 80.0, True) + MOMENTUM + "select league, team, date, round(momentum, 6) as momentum from mom semi join (select league, team, date from posts where post is not null) using (league, team, date)")


@query(elo_sql(50.0, 80.0, True) + MOMENTUM + "select league, team, date, round(momentum, 6) as momentum from mom")
def momentum_of_every_fixture(m):
    rated = ratings.elo(m, 50.0, 80.0, by_day=True, unplayed=True).select("match_id", "home_post", "away_post")
    return r6(ratings.momentum_asof(m.join(rated, "match_id")))


COMPONENTS = (
    elo_sql(50.0, 80.0, True)
    + MOMENTUM
    + FORM_FIXTURES
    + RATES_ASOF.replace(", rates as (", ", rates0 as (")
    + """, rates as (select r.match_id, greatest(lh * exp(0.11 * (home_elo - away_elo) / 400), 0.05) as lh, greatest(la * exp(-0.11 * (home_elo - away_elo) / 400), 0.05) as la from rates0 r join rated using (match_id))
"""
    + CELLS.removeprefix(RATES).replace("{rho}", "-0.08")
    + """, outcome as (select match_id, sum(p) filter (hg > ag) as p_home, sum(p) filter (hg = ag) as p_draw, sum(p) filter (hg < ag) as p_away from grid group by match_id),
 comp as (select m.match_id, p_home, p_draw, p_away, (home_elo - away_elo) / 400 as elo_diff, lh + la as rate_sum, lh - la as rate_diff, x.momentum as mom_home, y.momentum as mom_away, x.momentum - y.momentum as mom_diff,
   h.rest as rest_home, a.rest as rest_away, h.rest - a.rest as rest_diff, h.form as form_home, a.form as form_away, h.form - a.form as form_diff
   from matches m join outcome using (match_id) join rated using (match_id) join rates using (match_id)
   join known h on h.league = m.league and h.date = m.date and h.team = m.home_team join known a on a.league = m.league and a.date = m.date and a.team = m.away_team
   join mom x on x.league = m.league and x.date = m.date and x.team = m.home_team join mom y on y.league = m.league and y.date = m.date and y.team = m.away_team)
"""
)
NUMBERS = ["p_home", "p_draw", "p_away", "elo_diff", "rate_sum", "rate_diff", *[f"{c}_{s}" for c in ("mom", "rest", "form") for s in ("home", "away", "diff")]]


@query(COMPONENTS + "select match_id, " + ", ".join(f"round({c}, 6) as {c}" for c in NUMBERS) + " from comp")
def match_components(m):
    return r6(prematch.match_components(m))


ORACLES["elo_adjusted_lambdas_asof"] = with_matches(
    elo_sql(50.0, 80.0, True)
    + RATES_ASOF
    + """select match_id, round(greatest(lh * exp(0.11 * (home_elo - away_elo) / 400), 0.05), 6) as home_rate, round(greatest(la * exp(-0.11 * (home_elo - away_elo) / 400), 0.05), 6) as away_rate,
 round(greatest(least(1 - exp(-t) * (1 + t + t * t / 2), 1 - 1e-6), 1e-6), 6) as p_over from (select *, greatest(least(lh + la, 8.0), 0.01) as t from rates) join rated using (match_id)"""
)
_BLOCK = (
    COMPONENTS
    + EXTRA.removeprefix(FORM_FIXTURES)
    + """, cl as (select match_id, date, league, case when home_goals > away_goals then 0 when home_goals = away_goals then 1 when home_goals < away_goals then 2 end as y,
   close_odds_home is not null and close_odds_draw is not null and close_odds_away is not null as c, case when c then close_odds_home else odds_home end as oh, case when c then close_odds_draw else odds_draw end as od, case when c then close_odds_away else odds_away end as oa,
   oh > 1.0001 and od > 1.0001 and oa > 1.0001 as ok, 1 / oh + 1 / od + 1 / oa as inv from matches)
"""
)


@query(
    _BLOCK
    + "select match_id, date, league, y, "
    + ", ".join(f"round(case when ok then 1 / {o} / inv end, 6) as market_{leg}, {o} as bet_odds_{leg}" for leg, o in zip(O.LEGS, ("oh", "od", "oa")))
    + ", "
    + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in (*NUMBERS, *EXTRA_NAMES))
    + " from cl join comp using (match_id) join extra using (match_id)"
)
def matchday_block(m):
    return r6(prematch.matchday_block(m.selectExpr("*", *MORE_COLUMNS), fill_context(_context(m))))


@query(
    COMPONENTS
    + f", coming as (select * from matches where (home_goals is null or away_goals is null) and date >= date '{TODAY}'), nxt as (select c.* from coming c join (select league, min(date) as first from coming group by league) using (league) where date <= first + 4)"
    + " select match_id, round(p_home, 6) as p_home, round(p_draw, 6) as p_draw, round(p_away, 6) as p_away, case when p_home >= p_draw and p_home >= p_away then 'home' when p_draw >= p_away then 'draw' else 'away' end as pick from nxt join comp using (match_id)"
)
def upcoming_picks(m):
    return r6(prematch.upcoming_picks(m, TODAY))


@query(EXTRA + ", one as (select min(match_id) as match_id from matches) select match_id, i as place, round(cast(v as double), 6) as value from (select match_id, unnest([goals_for_diff_5, xg_for_diff_5, weather_severity, absence_count_diff]) as v, unnest([0, 1, 2, 3]) as i from extra join one using (match_id))")
def single_feature_vector(m):
    one = m.agg(F.min("match_id").alias("match_id"))
    vector = prematch.feature_vector(_extra(m).join(F.broadcast(one), "match_id"), ["goals_for_diff_5", "xg_for_diff_5", "weather_severity", "absence_count_diff"])  # one row
    return r6(vector.select("match_id", F.posexplode("features").alias("place", "value")))


@query(
    VIEW
    + """, h as (select s.match_id, s.league, s.team, s.is_home, p.gf, p.ga, p.points, row_number() over (partition by s.match_id, s.team order by p.date desc, p.match_id desc) as n from sides s left join played p on p.league = s.league and p.team = s.team and p.date < s.date),
 f as (select match_id, is_home, coalesce(avg(gf), 0) as gf, coalesce(avg(ga), 0) as ga, count(gf) as seen from h where n <= 5 group by all)
 select h.match_id, round(h.gf - a.gf, 6) as goals_for_diff, round(h.ga - a.ga, 6) as goals_against_diff, h.seen as home_seen, a.seen as away_seen from f h join f a on a.match_id = h.match_id and h.is_home and not a.is_home"""
)
def literature_features(m):
    means = asof.fixture_means(m, 5, ("goals",)).select("league", "team", "date", "goals_for", "goals_against", "n_recent")
    rows = asof.both_sides(m.select("match_id", "league", "date", "home_team", "away_team"), means)
    diff = lambda c: (F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"{c}_diff")
    return r6(rows.select("match_id", diff("goals_for"), diff("goals_against"), F.col("home_n_recent").alias("home_seen"), F.col("away_n_recent").alias("away_seen")))


#: SQL: the day from which on matches come after the state.
SPLIT = "1996-07-01"


@query(COMPONENTS + "select match_id, " + ", ".join(f"round({c}, 6) as {c}" for c in NUMBERS) + f" from comp semi join (select match_id from matches where date >= date '{SPLIT}') using (match_id)")
def state_resumed(m):
    """Matches from a day on, from the state that those before it left, written and read again; the history isn't read."""
    spark, path = m.sparkSession, shared_path(m.sparkSession, "league-state")
    once = stored(m, "matches")
    state.advance(once.where(f"date < '{SPLIT}'")).write(path)
    return r6(prematch.match_components(once.where(f"date >= '{SPLIT}'"), state=state.LeagueState.read(spark, path)))


@query(
    elo_sql(50.0, 80.0, True)
    + """, v as (select m.league, m.home_team as team, m.away_team as opponent, m.date, m.match_id, true as is_home, home_goals as gf, away_goals as ga, home_post as post from matches m join rated using (match_id) where home_goals is not null and away_goals is not null
 union all select m.league, m.away_team, m.home_team, m.date, m.match_id, false, away_goals, home_goals, away_post from matches m join rated using (match_id) where home_goals is not null and away_goals is not null),
 e as (select *, case when gf > ga then 3 when gf = ga then 1 else 0 end as pts, row_number() over (partition by league, team order by date desc, match_id desc) as back, exp(-0.001 * date_diff('day', date, max(date) over (partition by league))) as w from v),
 l as (select league, sum(w * gf) filter (is_home) / sum(w) filter (is_home) as mh, sum(w * gf) filter (not is_home) / sum(w) filter (not is_home) as ma from e group by league),
 t as (select league, team, count(*) as n_matches, max(date) as last_date, arg_max(opponent, (date, match_id)) as last_opponent, sum(pts) as points, sum(gf) as goals_for, sum(ga) as goals_against, arg_max(post, (date, match_id)) as rating,
   sum(pts) filter (back <= 5) / (3.0 * count(*) filter (back <= 5)) as form, coalesce((max(post) filter (back = 1) - max(post) filter (back = 4)) / 400, 0) as momentum, coalesce(sum(w * gf) filter (is_home), 0) as hf, coalesce(sum(w * ga) filter (is_home), 0) as ha, coalesce(sum(w) filter (is_home), 0) as hn,
   coalesce(sum(w * gf) filter (not is_home), 0) as af, coalesce(sum(w * ga) filter (not is_home), 0) as aa, coalesce(sum(w) filter (not is_home), 0) as an from e group by league, team)
 select league, team, n_matches, last_date, last_opponent, points::bigint as points, goals_for, goals_against, round(rating, 6) as rating, round(form, 6) as form, round(momentum, 6) as momentum,
   """
    + ", ".join(f"round(least(greatest(({g} + 1e-9) / ({m} * {n} + 1e-9), 0.3), 3.0), 6) as {name}" for g, m, n, name in (("hf", "mh", "hn", "home_attack"), ("ha", "ma", "hn", "home_defence"), ("af", "ma", "an", "away_attack"), ("aa", "mh", "an", "away_defence")))
    + " from t join l using (league)"
)
def state_standings(m):
    """The state after all matches, built season by season, each from the one before."""
    once, held = stored(m, "matches"), None
    for since, until in (("1900-01-01", "1994-01-01"), ("1994-01-01", SPLIT), (SPLIT, "2100-01-01")):
        path = shared_path(m.sparkSession, "league-state")
        state.advance(once.where(f"date >= '{since}' and date < '{until}'"), held).write(path)
        held = state.LeagueState.read(m.sparkSession, path)
    return r6(state.standings(held))


@query(
    _BLOCK
    + "select -1 - match_id as match_id, "
    + ", ".join(f"round(case when ok then 1 / {o} / inv end, 6) as market_{leg}" for leg, o in zip(O.LEGS, ("oh", "od", "oa")))
    + ", "
    + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in (*NUMBERS, *EXTRA_NAMES))
    + f" from cl join comp using (match_id) join extra using (match_id) semi join (select match_id from matches where {TEST}) using (match_id)"
)
def fixture_blocks(m):
    """Fixtures that are no matches, with the days, clubs, odds and context of the test season's matches: what the matches get."""
    rows = m.selectExpr("*", *MORE_COLUMNS)
    own = lambda df: df.withColumn("match_id", -1 - F.col("match_id"))
    context = fill_context(_context(m))
    block = runtime.fixture_block(own(rows.where(TEST)), rows, context.unionByName(own(context)))
    return r6(block.select("match_id", *[f"market_{leg}" for leg in O.LEGS], *NUMBERS, *EXTRA_NAMES))
