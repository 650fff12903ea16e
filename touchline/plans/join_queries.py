"""Queries that join matches with what other sources know, and split them by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.columns import alias_of, flag, join_key, kickoff_hour, parse_date, season_label, season_start, squeeze, without_marks
from touchline.functions.context import first_existing, pick_number
from touchline.operators import asof, betting, joining
from touchline.plans.queries import PLAYED, TEST, VALIDATION, VIEW, XG, _played, _xg_rows, query, r6
from touchline.sources.shared import stored

KEYS = ["date", "league", "home_team", "away_team"]


@query(f"select match_id, case when row_number() over (order by date, match_id) <= count(*) over () // 2 then 'early' else 'late' end as half from matches where {PLAYED} and {VALIDATION}")
def half_split(m):
    return betting.half_split(_played(m).where(VALIDATION)).select("match_id", "half")


@query("select match_id, (year(date) - case when month(date) < 8 then 1 else 0 end) || '-' || lpad(((year(date) - case when month(date) < 8 then 1 else 0 end + 1) % 100)::varchar, 2, '0') as label, (year(date) - case when month(date) < 7 then 1 else 0 end)::int as producer, make_date(year(date) - case when month(date) < 7 then 1 else 0 end, 7, 1) as window_start, make_date(year(date) - case when month(date) < 7 then 1 else 0 end + 1, 6, 30) as window_end from matches")
def season_windows(m):
    year = season_start("date", 7)
    return m.select("match_id", season_label("date", 8).alias("label"), year.alias("producer"), F.make_date(year, F.lit(7), F.lit(1)).alias("window_start"), F.make_date(year + 1, F.lit(6), F.lit(30)).alias("window_end"))


@query(f"select 'validation' as period, count(*) as n, count(*) filter ({PLAYED}) as n_played from matches where date between date '1995-07-01' and date '1996-06-30' union all select 'test', count(*), count(*) filter ({PLAYED}) from matches where date between date '1996-07-01' and date '1997-06-30' union all select 'both', count(*), count(*) filter ({PLAYED}) from matches where date between date '1995-07-01' and date '1997-06-30'")
def backtest_windows(m):
    return betting.backtest_windows(m, {"validation": ("1995-07-01", "1996-06-30"), "test": ("1996-07-01", "1997-06-30"), "both": ("1995-07-01", "1997-06-30")}, PLAYED)


_LABEL = "case match_id % 3 when 0 then ' Liga ' || league when 1 then 'LIGA ' || league else 'l' || league end"


@query(f"select match_id from (select *, {_LABEL} as label from matches) where lower(trim(label)) in ('liga 2', 'l2')")
def league_filter(m):
    label = F.expr(_LABEL)
    return m.where(F.lower(F.trim(label)).isin("liga 2", "l2")).select("match_id")


@query("select match_id, home_xg as first_number, away_corners as any_case from matches")
def alias_columns(m):
    return m.select("match_id", pick_number(m, ["home_expected", "home_xg", "home_corners"]).alias("first_number"), F.col(first_existing(m, ["Corners_Away", "AWAY_CORNERS"], any_case=True)).alias("any_case"))


_FLAG = "case match_id % 7 when 0 then ' Yes ' when 1 then 'no' when 2 then 'MISSING' when 3 then 'confirmed' when 4 then '0.4' when 5 then '1' end"


@query(f"select match_id, case when coalesce(lower(trim({_FLAG})), '') in ('1', 'true', 'yes', 'y', 'available', 'confirmed') then 1.0::double else 0.0::double end as flag from matches")
def text_flags(m):
    return m.select("match_id", flag(F.expr(_FLAG)).alias("flag"))


_XG_ROWS = ", u as (select *, row_number() over (partition by date, league, home_team, away_team order by match_id) as n from matches where match_id % 3 <> 0 and home_xg is not null)"


@query(_XG_ROWS + f" select m.match_id, case when m.home_goals is not null and m.away_goals is not null then u.home_xg end as xg_home, case when m.home_goals is not null and m.away_goals is not null then u.away_xg end as xg_away from matches m left join u on u.n = 1 and u.date = m.date and u.league = m.league and u.home_team = m.home_team and u.away_team = m.away_team")
def xg_exact_left_join(m):
    theirs = joining.keep_first(m.where("match_id % 3 <> 0 and home_xg is not null"), KEYS, "match_id").select(*KEYS, F.col("home_xg").alias("xg_home"), F.col("away_xg").alias("xg_away"))
    return joining.left_context(m.select("match_id", *KEYS, "home_goals", "away_goals"), theirs, KEYS, ["xg_home", "xg_away"]).select("match_id", *[F.when(F.expr(PLAYED), F.col(c)).alias(c) for c in ("xg_home", "xg_away")])


@query(
    """, h as (select date, home_team as team, home_goals as scored, away_goals as missed, home_xg as xg, away_xg + case when match_id % 5 = 0 then 0.5 else 0.00005 end as xga from matches where home_xg is not null and home_goals is not null and away_goals is not null),
 a as (select date, away_team as team, away_goals as scored, home_goals as missed, away_xg as xg, home_xg as xga from matches where home_xg is not null and home_goals is not null and away_goals is not null)
 select h.date, h.team as home_team, a.team as away_team, h.xg as home_xg, a.xg as away_xg from h join a on a.date = h.date and h.scored = a.missed and h.missed = a.scored
 where abs(h.xg - a.xga) <= 1e-4 + 1e-5 * abs(a.xga) and abs(a.xg - h.xga) <= 1e-4 + 1e-5 * abs(h.xga)"""
)
def xg_team_row_pairing(m):
    known = m.where("home_xg is not null").where(PLAYED)
    off = F.when(F.col("match_id") % 5 == 0, 0.5).otherwise(0.00005)
    home = known.select("date", F.col("home_team").alias("team"), F.lit(True).alias("is_home"), F.col("home_goals").alias("scored"), F.col("away_goals").alias("missed"), F.col("home_xg").alias("xg"), (F.col("away_xg") + off).alias("xga"))
    away = known.select("date", F.col("away_team").alias("team"), F.lit(False).alias("is_home"), F.col("away_goals").alias("scored"), F.col("home_goals").alias("missed"), F.col("away_xg").alias("xg"), F.col("home_xg").alias("xga"))
    return joining.pair_sides(home.unionByName(away))


@query("select m.match_id, coalesce(c.home_corners, m.home_corners) as home_corners, c.extra from matches m left join (select match_id, case when match_id % 3 = 0 then null else home_corners + 1 end as home_corners, away_yellows as extra from matches where match_id % 2 = 0) c on c.match_id = m.match_id")
def context_left_coalesce(m):
    context = m.where("match_id % 2 = 0").select("match_id", F.when(F.col("match_id") % 3 != 0, F.col("home_corners") + 1).alias("home_corners"), F.col("away_yellows").alias("extra"))
    return joining.left_context(m.select("match_id", "home_corners"), context, ["match_id"], ["home_corners", "extra"])


_PLACES = "select distinct league, home_team as team, case when home_team % 4 = 0 then null else cast(home_team as double) / 3 end as latitude, case when home_team % 7 = 0 then null else cast(home_team as double) / 2 end as longitude from matches where home_team % 5 <> 0"


@query(f", p as ({_PLACES}) select distinct m.league, m.home_team as team from matches m left join p on p.league = m.league and p.team = m.home_team and latitude is not null and longitude is not null where p.team is null")
def venue_missing_locations(m):
    places = m.where("home_team % 5 <> 0").select("league", F.col("home_team").alias("team")).distinct().selectExpr("league", "team", "case when team % 4 = 0 then null else cast(team as double) / 3 end as latitude", "case when team % 7 = 0 then null else cast(team as double) / 2 end as longitude")
    return joining.missing_sides(m, places)


@query(", w as (select league, home_team, date, h as hour, cast((home_team * 13 + h * 7) % 40 as double) as temperature_c from (select distinct league, home_team, date from matches), (select unnest([15, 18, 20]) as h)) select m.match_id, w.hour, w.temperature_c from matches m left join w on w.league = m.league and w.home_team = m.home_team and w.date = m.date and w.hour = case match_id % 4 when 0 then 20 when 1 then 18 when 2 then 15 else 23 end")
def weather_by_hour(m):
    hours = m.select("league", "home_team", "date").distinct().select("league", "home_team", "date", F.explode(F.array(F.lit(15), F.lit(18), F.lit(20))).alias("hour"))
    weather = hours.withColumn("temperature_c", ((F.col("home_team") * 13 + F.col("hour") * 7) % 40).cast("double"))
    asked = m.withColumn("hour", kickoff_hour(F.expr("case match_id % 4 when 0 then '20:45' when 1 then '18' when 2 then 'soon' else '99' end")))
    found = weather.withColumnRenamed("hour", "found_hour")
    return asked.join(found, (asked.league == found.league) & (asked.home_team == found.home_team) & (asked.date == found.date) & (asked.hour == found.found_hour), "left").select("match_id", F.col("found_hour").alias("hour"), "temperature_c")


@query(None)
def fuzzy_fixture_match(m):
    m = stored(m.select("date", "league", "match_id", "home_team", "away_team"), "fixtures")
    name = lambda c, cut: F.concat(F.lit("club "), F.when(F.col("match_id") % 3 == 0, F.reverse(F.col(c).cast("string"))).otherwise(F.col(c).cast("string")), F.lit(cut))
    local = m.select("date", "league", F.col("match_id").alias("id"), F.concat(F.lit("Club "), "home_team").alias("home"), F.concat(F.lit("Club "), "away_team").alias("away"))
    theirs = m.select("date", "league", (F.col("match_id") + 1_000_000).alias("id"), name("home_team", " fc").alias("home"), name("away_team", "").alias("away"))
    return r6(joining.fuzzy_pairs(local, theirs, ["date", "league"]))


_REGISTRY = ", reg as (select distinct league, home_team as team, away_team as player, 'p' || (away_team % 7) as name, case when away_team % 3 = 0 then null else date '1994-01-01' + cast(away_team as int) end as date_from, case when away_team % 4 = 0 then date '1996-01-01' end as date_to from matches)"


@query(_REGISTRY + " select league, team, player, name from (select *, row_number() over (partition by league, team, player order by name desc, date_from desc nulls last) as n from reg where (date_from is null or date_from <= date '1996-06-01') and (date_to is null or date_to >= date '1996-06-01')) where n = 1")
def active_registry(m):
    registry = m.select("league", F.col("home_team").alias("team"), F.col("away_team").alias("player")).distinct().selectExpr("*", "concat('p', player % 7) as name", "case when player % 3 = 0 then null else date_add(date '1994-01-01', cast(player as int)) end as date_from", "case when player % 4 = 0 then date '1996-01-01' end as date_to")
    return joining.active_entries(registry, "1996-06-01", ["league", "team", "player"]).select("league", "team", "player", "name")


@query("select match_id from matches m where exists (select 1 from matches k where k.home_team = m.away_team and k.away_team = m.home_team and k.date > m.date)")
def return_games(m):
    later = m.select(F.col("home_team").alias("a"), F.col("away_team").alias("h"), F.col("date").alias("d"))
    last = later.groupBy("a", "h").agg(F.max("d").alias("d"))
    return m.join(last, (F.col("away_team") == F.col("a")) & (F.col("home_team") == F.col("h")) & (F.col("d") > F.col("date")), "left_semi").select("match_id")


_NAMES = "case match_id % 3 when 0 then 'FC Club ' || home_team when 1 then 'club ' || home_team || '.' else '  CLUB-' || home_team || ' AFC' end"


@query(f", n as (select {_NAMES} as name, match_id from matches), k as (select trim(regexp_replace(regexp_replace(lower(name), '\\b(fc|cf|afc|ssc|ac|as|sc|sv|vfb|borussia)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as key, name, match_id from n) select key, arg_min(name, match_id) as name from k where key <> '' group by key")
def team_name_bridge(m):
    names = m.select(F.expr(_NAMES.replace("'FC Club ' || home_team", "concat('FC Club ', home_team)").replace("'club ' || home_team || '.'", "concat('club ', home_team, '.')").replace("'  CLUB-' || home_team || ' AFC'", "concat('  CLUB-', home_team, ' AFC')")).alias("name"), "match_id")
    return joining.team_name_bridge(names, join_key("name"), "match_id")


@query(XG + ", s as (select min(date) as lo, max(date) as hi from xg), i as (select m.* from matches m, s where m.date between lo and hi), u as (select i.league, unnest([i.home_team, i.away_team]) as team from i left join (select distinct league, home_team, away_team, date, 1 as there from xg) k using (league, home_team, away_team, date) where k.there is null) select league, string_agg(distinct team::varchar, ',' order by team::varchar) as teams from u group by league")
def coverage_unmatched_teams(m):
    found = joining.unmatched_teams(m, _xg_rows(m), ["league", "home_team", "away_team", "date"])
    return found.select("league", F.array_join(F.array_sort(F.transform("teams", lambda t: t.cast("string"))), ",").alias("teams"))


@query(f"select league, string_agg(distinct team::varchar, ',' order by team::varchar) as teams from (select league, unnest([home_team, away_team]) as team, date from matches) where date >= date '1996-07-01' group by league having count(distinct team) >= 6")
def league_teams(m):
    return asof.league_teams(m, "1996-07-01", 6).select("league", F.array_join(F.array_sort(F.transform("teams", lambda t: t.cast("string"))), ",").alias("teams"))


@query(f"select count(*) filter ({VALIDATION}) as validation, count(*) filter ({VALIDATION} and home_xg is not null) as validation_xg, count(*) filter ({TEST}) as test, count(*) filter ({TEST} and home_xg is not null) as test_xg from matches")
def backtest_coverage(m):
    counted = {"validation": VALIDATION, "validation_xg": f"{VALIDATION} and home_xg is not null", "test": TEST, "test_xg": f"{TEST} and home_xg is not null"}
    return m.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counted.items()])


@query(VIEW + ", d as (select league, team, list(distinct opponent) as seen from played group by all) select league, team, len(seen) as n_opponents, cast(list_sum(seen) as bigint) as opponents from d")
def distinct_opponents(m):
    view = asof.team_view(m).where("is_played")
    return view.groupBy("league", "team").agg(F.collect_list("opponent").alias("all")).select("league", "team", F.size(F.array_distinct("all")).cast("long").alias("n_opponents"), F.aggregate(F.array_distinct("all"), F.lit(0).cast("long"), lambda a, x: a + x).alias("opponents"))


_TEXT = "case match_id % 5 when 0 then '  Atl\u00e9tico   Club ' when 1 then 'M\u00fcnchen & Co' when 2 then 'Real\tOviedo' when 3 then 'AC  S\u00e3o Jo\u00e3o, \u0160ibenik, Gy\u0151r, Be\u015fikta\u015f, \u0141\u00f3d\u017a, e\u0301' else '12-3' end"


@query(f", t as (select match_id, {_TEXT} as x from matches) select match_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) as squeezed, strip_accents(x) as bare, trim(regexp_replace(regexp_replace(replace(lower(x), '&', 'and'), '\\b(fc|cf|afc|ssc|ac|as|sc|sv|vfb|borussia)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as key, contains(lower(x), 'club') as has_club, try_cast(nullif(regexp_extract(x, '(\\d+)\\s*-\\s*(\\d+)', 1), '') as int) as score, case when x = '12-3' then 'twelve' else x end as alias from t")
def string_scalars(m):
    x = F.expr(_TEXT)
    return m.select("match_id", squeeze(x).alias("squeezed"), without_marks(x).alias("bare"), join_key(x).alias("key"), F.contains(F.lower(x), F.lit("club")).alias("has_club"), F.regexp_extract(x, r"(\d+)\s*-\s*(\d+)", 1).try_cast("int").alias("score"), alias_of(x, {"12-3": "twelve"}).alias("alias"))


@query("select match_id, case when match_id % 5 = 4 then null else date end as parsed, case match_id % 4 when 0 then 20 when 1 then 9 when 2 then 15 else 23 end as hour from matches")
def date_scalars(m):
    text = F.expr("case match_id % 5 when 0 then date_format(date, 'dd/MM/yy') when 1 then date_format(date, 'dd/MM/yyyy') when 2 then date_format(date, 'yyyy-MM-dd') when 3 then date_format(date, 'd-M-yyyy') else 'no date' end")
    hour = F.expr("case match_id % 4 when 0 then '20:45' when 1 then ' 9' when 2 then null else '77:10' end")
    return m.select("match_id", parse_date(F.when(F.col("date") >= "2000-01-01", text).otherwise(F.expr("case when match_id % 5 = 4 then 'no date' when match_id % 5 = 2 then date_format(date, 'yyyy-MM-dd') when match_id % 5 = 3 then date_format(date, 'd-M-yyyy') else date_format(date, 'dd/MM/yyyy') end"))).alias("parsed"), kickoff_hour(hour).alias("hour"))


@query("select date, 'club ' || home_team as home_key, 'club ' || away_team as away_key, home_xg from (select *, row_number() over (partition by date, home_team, away_team order by match_id) as n from matches where match_id % 9 <> 0 and home_xg is not null) where n = 1")
def xg_match_rows(m):
    raw = m.where("home_xg is not null").select(F.when(F.col("match_id") % 9 != 0, F.date_format("date", "yyyy-MM-dd HH:mm:ss")).alias("datetime"), F.concat(F.lit("FC Club "), "home_team").alias("h"), F.concat(F.lit("Club-"), "away_team").alias("a"), F.col("home_xg").cast("string").alias("xG"), F.col("match_id").alias("place"))
    return joining.provider_rows(raw, parse_date("datetime"), join_key("h"), join_key("a"), {"home_xg": F.col("xG").try_cast("double")})


@query("select match_id, league from (select *, row_number() over (partition by league, home_team, away_team order by match_id desc) as n from matches where date between date '1995-07-01' and date '1996-06-30') where n = 1")
def collected_matches(m):
    return joining.collected(m, "1995-07-01", "1996-06-30", ["league", "home_team", "away_team"], "match_id").select("match_id", "league")
