"""The match queries over the star-schema tables, each with DuckDB SQL that must give the same rows.

Doubles are rounded to six decimals, once, at the end, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import odds as O  # noqa: N812
from touchline.functions.columns import season_start
from touchline.operators import asof, betting, goals, joining, metrics, ratings
from touchline.sources.fixture_sql import MORE_COLUMNS, read_matches, with_matches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Fixed value: the day that "now" is in queries about coming matches.
TODAY = "1997-06-01"

#: The JVM interprets a method of more bytes than this for good, as one is that Spark makes of many columns of long expressions.
#: With this setting Spark makes it of each operator's parts instead, which are compiled.
LONG_METHODS = ("spark.sql.codegen.hugeMethodLimit", "8000")


def query(sql: str | None = None):
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set(*LONG_METHODS)
            return f(read_matches(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_matches(sql)
        return f

    return register


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places as DuckDB's ``round`` does it: by the double times a million. Spark's goes by the shortest decimal that
    gives the double, which at a half such as 0.5166875 may go the other way."""
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PLAYED = "home_goals is not null and away_goals is not null"


def _played(m: DataFrame) -> DataFrame:
    return m.where(PLAYED).withColumn("y", O.outcome("home_goals", "away_goals"))


#: SQL of the odds' fair probabilities, and the team view.
FAIR = """
, fair as (select *, case when home_goals > away_goals then 0 when home_goals = away_goals then 1 when home_goals < away_goals then 2 end as y,
  case when open_odds_home > 1.0001 and open_odds_draw > 1.0001 and open_odds_away > 1.0001 then 1 else 0 end as ok,
  1 / open_odds_home + 1 / open_odds_draw + 1 / open_odds_away as inv from matches),
probs as (select *, case when ok = 1 then 1 / open_odds_home / inv end as ph, case when ok = 1 then 1 / open_odds_draw / inv end as pd,
  case when ok = 1 then 1 / open_odds_away / inv end as pa from fair)
"""
VIEW = """
, sides as (
  select match_id, date, league, home_team as team, away_team as opponent, true as is_home, home_goals as gf, away_goals as ga, home_shots as sf, away_shots as sa,
         coalesce(home_yellows, 0) + 2 * coalesce(home_reds, 0) as cf, home_xg as xf from matches
  union all
  select match_id, date, league, away_team, home_team, false, away_goals, home_goals, away_shots, home_shots,
         coalesce(away_yellows, 0) + 2 * coalesce(away_reds, 0), away_xg from matches),
played as (select *, case when gf > ga then 3 when gf = ga then 1 else 0 end as points from sides where gf is not null and ga is not null),
days as (select distinct league, team, date from played)
"""


def _priced(m: DataFrame) -> DataFrame:
    """Played matches with fair opening probabilities ph, pd, pa."""
    p = O.fair_probs(O.legs("open_odds"))
    return _played(m).withColumns({"ph": p[0], "pd": p[1], "pa": p[2]}).where("ph is not null")


def _probs() -> list:
    return [F.col(c) for c in ("ph", "pd", "pa")]


@query("select match_id, date, league, home_team, away_team, home_goals, away_goals from matches")
def fixtures_projection(m):
    return m.select("match_id", "date", "league", "home_team", "away_team", "home_goals", "away_goals")


@query(FAIR + "select match_id, round(ph, 6) as p_home, round(pd, 6) as p_draw, round(pa, 6) as p_away from probs")
def fair_probs(m):
    p = O.fair_probs(O.legs("open_odds"))
    return r6(m.select("match_id", *[x.alias(f"p_{leg}") for x, leg in zip(p, O.LEGS)]))


@query(FAIR + "select match_id, round((ph + pd + pa) / ph, 6) as o_home, round((ph + pd + pa) / pd, 6) as o_draw, round((ph + pd + pa) / pa, 6) as o_away from probs where ok = 1")
def fair_to_odds(m):
    p = O.fair_probs(O.legs("open_odds"))
    kept = m.where(O.given(O.legs("open_odds")))
    return r6(kept.select("match_id", *[x.alias(f"o_{leg}") for x, leg in zip(O.fair_odds(p), O.LEGS)]))


@query(
    """, b as (select match_id, unnest([struct_pack(h := open_odds_home, d := open_odds_draw, a := open_odds_away), struct_pack(h := close_odds_home, d := close_odds_draw, a := close_odds_away), struct_pack(h := odds_home, d := odds_draw, a := odds_away)]) as o from matches),
 f as (select match_id, 1 / o.h + 1 / o.d + 1 / o.a as inv, o.h as h, o.d as d, o.a as a from b where o.h > 1.0001 and o.d > 1.0001 and o.a > 1.0001),
 g as (select match_id, avg(1 / h / inv) as h, avg(1 / d / inv) as d, avg(1 / a / inv) as a from f group by match_id)
 select match_id, round((h + d + a) / h, 6) as o_home, round((h + d + a) / d, 6) as o_draw, round((h + d + a) / a, 6) as o_away from g"""
)
def consensus_odds(m):
    books = [O.legs("open_odds"), O.legs("close_odds"), O.legs("odds")]
    quoted = m.where(O.given(books[0]) | O.given(books[1]) | O.given(books[2]))
    names = [f"o_{leg}" for leg in O.LEGS]
    return r6(O.with_consensus(quoted, None, books, names).select("match_id", *names))


@query("select match_id, case when over_odds > 1.0001 and under_odds > 1.0001 then round((1 / over_odds) / (1 / over_odds + 1 / under_odds), 6) end as p_over, coalesce(case when match_id % 4 <> 0 then cast((match_id * 197 % 9 - 4) as double) / 4 end, ah_line) as line from matches")
def over_under_prob(m):
    p, _, _ = O.over_under([(F.col("over_odds"), F.col("under_odds"))])
    closing = F.expr("case when match_id % 4 <> 0 then cast((match_id * 197 % 9 - 4) as double) / 4 end")
    return m.select("match_id", F.round(p, 6).alias("p_over"), O.first_line(closing, "ah_line").alias("line"))


@query(
    """select match_id, case when c then close_odds_home else odds_home end as o_home, case when c then close_odds_draw else odds_draw end as o_draw, case when c then close_odds_away else odds_away end as o_away
 from (select *, close_odds_home is not null and close_odds_draw is not null and close_odds_away is not null as c from matches)"""
)
def odds_snapshot_fallback(m):
    return m.select("match_id", *[x.alias(f"o_{leg}") for x, leg in zip(O.snapshot("closing"), O.LEGS)])


@query(FAIR + "select match_id, round(coalesce(ph, 0.45), 6) as p_home, round(coalesce(pd, 0.27), 6) as p_draw, round(coalesce(pa, 0.28), 6) as p_away from probs")
def market_fallback(m):
    p = O.market_or_model(O.fair_probs(O.legs("open_odds")), [F.lit(0.45), F.lit(0.27), F.lit(0.28)])
    return r6(m.select("match_id", *[x.alias(f"p_{leg}") for x, leg in zip(p, O.LEGS)]))


@query(
    FAIR
    + """, moved as (select *, close_odds_home > 1.0001 and close_odds_draw > 1.0001 and close_odds_away > 1.0001 and ok = 1 as priced, 1 / close_odds_home + 1 / close_odds_draw + 1 / close_odds_away as ci from probs)
 select match_id, round(case when priced then 1 / close_odds_home / ci - ph else 0 end, 6) as move_home, round(case when priced then 1 / close_odds_away / ci - pa else 0 end, 6) as move_away from moved"""
)
def market_move(m):
    move = O.market_move(O.legs("open_odds"), O.legs("close_odds"))
    return r6(m.select("match_id", move[0].alias("move_home"), move[2].alias("move_away")))


@query(
    """select case when date < date '1995-07-01' then 'train' when date < date '1996-07-01' then 'validation' else 'test' end as split, count(*) as n,
 count(*) filter (home_goals is not null and away_goals is not null) as n_played from matches group by 1"""
)
def date_split_counts(m):
    split = F.when(F.col("date") < "1995-07-01", "train").when(F.col("date") < "1996-07-01", "validation").otherwise("test")
    return m.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(PLAYED)).alias("n_played"))


@query("select match_id, league, ntile(2) over (partition by league order by date, match_id) as fold from matches where " + PLAYED)
def chrono_folds(m):
    return betting.chrono_fold(_played(m), by=("league",)).select("match_id", "league", "fold")


@query("select league, year(date) - case when month(date) < 7 then 1 else 0 end as season, count(*) as n from matches group by all")
def season_labels(m):
    return m.groupBy("league", season_start("date", 7).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select match_id, league, date from (select *, min(date) over (partition by league) as first from matches
 where (home_goals is null or away_goals is null) and date >= date '{TODAY}') where date <= first + 4"""
)
def next_matchday(m):
    coming = m.where(f"not ({PLAYED}) and date >= date '{TODAY}'")
    first = coming.groupBy("league").agg(F.min("date").alias("first"))
    return coming.join(first, "league").where(F.col("date") <= F.date_add("first", 4)).select("match_id", "league", "date")


@query(
    """select league, home_team, away_team, match_id, date from (select *, row_number() over (partition by league, home_team, away_team order by date, match_id) as n from matches) where n = 1"""
)
def dedupe_keep_first(m):
    return joining.keep_first(m, ["league", "home_team", "away_team"], "date", "match_id").select("league", "home_team", "away_team", "match_id", "date")


@query(
    """select league, home_team, away_team, match_id, date from (select *, row_number() over (partition by league, home_team, away_team order by date desc, match_id desc) as n from matches) where n = 1"""
)
def dedupe_keep_last(m):
    return joining.keep_first(m, ["league", "home_team", "away_team"], "date", "match_id", last=True).select("league", "home_team", "away_team", "match_id", "date")


@query(VIEW + "select match_id, date, league, team, opponent, is_home, gf as goals_for, ga as goals_against, cf as cards_for from sides")
def team_view(m):
    return asof.team_view(m).select("match_id", "date", "league", "team", "opponent", "is_home", "goals_for", "goals_against", "cards_for")


ROLLING = (
    VIEW
    + """, hist as (select d.league, d.team, d.date, p.gf, p.sf, p.cf, p.xf, p.points, row_number() over (partition by d.league, d.team, d.date order by p.date desc, p.match_id desc) as n
 from days d join played p on p.league = d.league and p.team = d.team and p.date < d.date),
 form as (select league, team, date, avg(gf) as g, avg(sf) as s, avg(cf) as c, avg(xf) as x, sum(points) / (3.0 * count(*)) as f, count(*) as k from hist where n <= 5 group by all),
 roll as (select d.league, d.team, d.date, coalesce(g, 0) as goals_for, coalesce(s, 0) as shots_for, coalesce(c, 0) as cards_for, coalesce(x, 0) as xg_for, coalesce(f, 0) as form, coalesce(k, 0) as n_recent
 from days d left join form using (league, team, date))
"""
)


@query(ROLLING + "select league, team, date, n_recent, round(goals_for, 6) as goals_for, round(shots_for, 6) as shots_for, round(cards_for, 6) as cards_for, round(xg_for, 6) as xg_for from roll")
def rolling_form_5(m):
    return r6(asof.rolling_means(m).select("league", "team", "date", "n_recent", "goals_for", "shots_for", "cards_for", "xg_for"))


@query(
    ROLLING
    + """select match_id, round(h.goals_for - a.goals_for, 6) as goals_diff, round(h.shots_for - a.shots_for, 6) as shots_diff, round(h.cards_for - a.cards_for, 6) as cards_diff
 from matches m join roll h on h.league = m.league and h.team = m.home_team and h.date = m.date join roll a on a.league = m.league and a.team = m.away_team and a.date = m.date
 where home_goals is not null and away_goals is not null"""
)
def rolling_stats_diffs(m):
    return r6(asof.fixture_diffs(m).select("match_id", F.col("goals_for_diff").alias("goals_diff"), F.col("shots_for_diff").alias("shots_diff"), F.col("cards_for_diff").alias("cards_diff")))


@query(ROLLING + "select league, team, date, round(form, 6) as form from roll")
def points_form(m):
    return r6(asof.points_form(m))


@query(
    VIEW
    + """select d.league, d.team, d.date, round(coalesce(least(greatest(date_diff('day', max(p.date), d.date), 0), 21) / 7.0, 1.0), 6) as rest
 from days d left join played p on p.league = d.league and p.team = d.team and p.date < d.date group by d.league, d.team, d.date"""
)
def rest_days(m):
    return r6(asof.rest_days(m))


@query(
    VIEW
    + """, hist as (select d.league, d.team, d.date, p.gf, p.ga, p.points, row_number() over (partition by d.league, d.team, d.date order by p.date desc, p.match_id desc) as n
 from days d join played p on p.league = d.league and p.team = d.team and p.date < d.date)
 select league, team, date, 5 - n as step, gf, ga, points from hist where n <= 5"""
)
def last_k_sequence_rows(m):
    steps = asof.last_matches(m).select("league", "team", "date", F.posexplode("steps").alias("pos", "s")).where("s.there = 1")
    return steps.select("league", "team", "date", F.col("pos").cast("long").alias("step"), "s.gf", "s.ga", "s.points")


@query(VIEW + "select league, team, count(*) as n_matches, max(date) as last_date, sum(points) as points, sum(gf) as goals_for, sum(ga) as goals_against, last(opponent order by date, match_id) as last_opponent from played group by all")
def league_state_snapshot(m):
    return asof.league_snapshot(m)


@query(
    VIEW
    + """, t as (select league, team, avg(gf) as gf, avg(ga) as ga from played group by all), l as (select league, avg(gf) as mean from played group by league)
 select league, team, round(gf / (mean + 1e-6), 6) as attack, round(ga / (mean + 1e-6), 6) as defence from t join l using (league)"""
)
def strength_overall(m):
    return r6(asof.strengths(m))


@query(
    VIEW
    + """, t as (select league, team, avg(gf) filter (is_home) as hf, avg(ga) filter (is_home) as ha, avg(gf) filter (not is_home) as af, avg(ga) filter (not is_home) as aa from played group by all),
 l as (select league, avg(gf) filter (is_home) as mh, avg(gf) filter (not is_home) as ma from played group by league)
 select league, team, round(coalesce(hf, mh) / (mh + 1e-6), 6) as home_attack, round(coalesce(ha, ma) / (ma + 1e-6), 6) as home_defence,
 round(coalesce(af, ma) / (ma + 1e-6), 6) as away_attack, round(coalesce(aa, mh) / (mh + 1e-6), 6) as away_defence from t join l using (league)"""
)
def strength_home_away(m):
    return r6(asof.split_strengths(m))


@query(
    """, p as (select league, home_team as team, date, home_goals as g from matches where home_goals is not null and away_goals is not null),
 k as (select distinct league, team, date from p), ld as (select distinct league, date from p),
 lb as (select a.league, a.date, max(b.date) as before, sum(exp(-0.001 * date_diff('day', b.date, (select max(c.date) from ld c where c.league = a.league and c.date < a.date))) * b.g) as lg,
   sum(exp(-0.001 * date_diff('day', b.date, (select max(c.date) from ld c where c.league = a.league and c.date < a.date)))) as ln
   from ld a join p b on b.league = a.league and b.date < a.date group by a.league, a.date),
 tb as (select k.league, k.team, k.date, sum(exp(-0.001 * date_diff('day', p.date, lb.before)) * p.g) as tg, sum(exp(-0.001 * date_diff('day', p.date, lb.before))) as tn
   from k join lb using (league, date) join p on p.league = k.league and p.team = k.team and p.date < k.date group by all)
 select k.league, k.team, k.date, round(case when tn > 0 then least(greatest((tg + 1e-9) / (lg / ln * tn + 1e-9), 0.3), 3.0) else 1.0 end, 6) as home_attack
 from k left join lb using (league, date) left join tb using (league, team, date)"""
)
def strength_decayed_asof(m):
    return r6(asof.decayed_strengths_asof(m, 0.001))


@query(None)
def elo_day_frozen(m):
    return r6(ratings.elo(m, 50.0, 80.0, by_day=True).select("match_id", "home_elo", "away_elo"))


@query(None)
def elo_sequential(m):
    return r6(ratings.elo(m, 40.0, 60.0, by_day=False).select("match_id", "home_elo", "away_elo"))


@query(None)
def elo_momentum(m):
    return r6(ratings.momentum(m))


@query(None)
def strength_iterative(m):
    return r6(ratings.iterative_strengths(m))


def _rates(m: DataFrame) -> DataFrame:
    return m.where("home_xg is not null").select("match_id", (F.col("home_xg") + 0.2).alias("home_rate"), (F.col("away_xg") + 0.1).alias("away_rate"))


RATES = ", rates as (select match_id, home_xg + 0.2 as lh, away_xg + 0.1 as la from matches where home_xg is not null)"
CELLS = (
    RATES
    + """, ks as (select unnest(range(11)) as k), cells as (select match_id, h.k as hg, a.k as ag, greatest(0, exp(-lh) * pow(lh, h.k) / factorial(h.k::int) * exp(-la) * pow(la, a.k) / factorial(a.k::int) *
  case when h.k = 0 and a.k = 0 then 1 - lh * la * r when h.k = 0 and a.k = 1 then 1 + lh * r when h.k = 1 and a.k = 0 then 1 + la * r when h.k = 1 and a.k = 1 then 1 - r else 1 end) as w
  from (select *, greatest(least({rho}, least((1 - 1e-6) / greatest(lh * la, 1e-12), 1 - 1e-6)), -least((1 - 1e-6) / greatest(lh * la, 1e-12), 1 - 1e-6)) as r from rates) , ks h, ks a),
 grid as (select match_id, hg, ag, w / sum(w) over (partition by match_id) as p from cells)
"""
)
OUTCOME = "select match_id, round(sum(p) filter (hg > ag), 6) as p_home, round(sum(p) filter (hg = ag), 6) as p_draw, round(sum(p) filter (hg < ag), 6) as p_away from grid group by match_id"


@query(CELLS.replace("{rho}", "0.0") + OUTCOME)
def poisson_outcome(m):
    return r6(goals.outcome_probs(_rates(m)).drop("home_rate", "away_rate"))


@query(CELLS.replace("{rho}", "-0.08") + OUTCOME)
def dixon_coles_outcome(m):
    return r6(goals.outcome_probs(_rates(m), -0.08).drop("home_rate", "away_rate"))


@query(CELLS.replace("{rho}", "-0.08") + "select match_id, cast(n as int) as rank, round(p, 6) as p from (select *, row_number() over (partition by match_id order by p desc) as n from grid) where n <= 5")
def top_k_scorelines(m):
    return r6(goals.top_scores(_rates(m), 5, -0.08).select("match_id", "rank", "p"))


@query(
    RATES
    + """select match_id, round(greatest(lh * exp(0.11 * (match_id % 401 - 200) / 400.0), 0.05), 6) as home_rate, round(greatest(la * exp(-0.11 * (match_id % 401 - 200) / 400.0), 0.05), 6) as away_rate,
 round(greatest(least(1 - exp(-t) * (1 + t + t * t / 2), 1 - 1e-6), 1e-6), 6) as p_over from (select *, greatest(least(lh + la, 8.0), 0.01) as t from rates)"""
)
def elo_adjusted_lambdas(m):
    diff = (F.col("match_id") % 401 - 200).cast("double")
    home, away = goals.with_elo(F.col("home_rate"), F.col("away_rate"), diff, 0.11)
    return r6(_rates(m).select("match_id", home.alias("home_rate"), away.alias("away_rate"), goals.over_25(F.col("home_rate") + F.col("away_rate")).alias("p_over")))


#: The same from what was known before each day, for every match: decayed strengths, and rates from them.
STRENGTHS_ASOF = """
, pl as (select league, date, home_team, away_team, home_goals as hg, away_goals as ag from matches where home_goals is not null and away_goals is not null),
 md as (select distinct league, date from matches),
 lb as (select d.league, d.date, max(p.date) as before from md d join pl p on p.league = d.league and p.date < d.date group by d.league, d.date),
 lw as (select b.league, b.date, sum(exp(-0.001 * date_diff('day', p.date, b.before)) * hg) as lh, sum(exp(-0.001 * date_diff('day', p.date, b.before)) * ag) as la, sum(exp(-0.001 * date_diff('day', p.date, b.before))) as ln
   from lb b join pl p on p.league = b.league and p.date < b.date group by b.league, b.date),
 tk as (select league, home_team as team, date from matches union select league, away_team, date from matches),
 tp as (select t.league, t.team, t.date, p.home_team = t.team as at_home, exp(-0.001 * date_diff('day', p.date, b.before)) as w, hg, ag
   from tk t join lb b using (league, date) join pl p on p.league = t.league and p.date < t.date and (p.home_team = t.team or p.away_team = t.team)),
 tw as (select league, team, date, coalesce(sum(w * hg) filter (at_home), 0) as hf, coalesce(sum(w * ag) filter (at_home), 0) as ha, coalesce(sum(w) filter (at_home), 0) as hn,
   coalesce(sum(w * ag) filter (not at_home), 0) as af, coalesce(sum(w * hg) filter (not at_home), 0) as aa, coalesce(sum(w) filter (not at_home), 0) as an from tp group by league, team, date),
 st as (select t.league, t.team, t.date, coalesce(lh / ln, 1.35) as mean_home, coalesce(la / ln, 1.10) as mean_away,
   case when hn > 0 then least(greatest((hf + 1e-9) / (lh / ln * hn + 1e-9), 0.3), 3.0) else 1.0 end as home_attack, case when hn > 0 then least(greatest((ha + 1e-9) / (la / ln * hn + 1e-9), 0.3), 3.0) else 1.0 end as home_defence,
   case when an > 0 then least(greatest((af + 1e-9) / (la / ln * an + 1e-9), 0.3), 3.0) else 1.0 end as away_attack, case when an > 0 then least(greatest((aa + 1e-9) / (lh / ln * an + 1e-9), 0.3), 3.0) else 1.0 end as away_defence
   from tk t left join lw using (league, date) left join tw using (league, team, date))
"""
RATES_ASOF = (
    STRENGTHS_ASOF
    + """, rates as (select match_id, greatest(h.mean_home * h.home_attack * a.away_defence, 0.05) as lh, greatest(h.mean_away * a.away_attack * h.home_defence, 0.05) as la
 from matches m join st h on h.league = m.league and h.date = m.date and h.team = m.home_team join st a on a.league = m.league and a.date = m.date and a.team = m.away_team)
"""
)
CELLS_ASOF = RATES_ASOF + CELLS.removeprefix(RATES)


FOUR = ("home_attack", "home_defence", "away_attack", "away_defence")


@query(STRENGTHS_ASOF + "select league, team, date, round(mean_home, 6) as mean_home, round(mean_away, 6) as mean_away, " + ", ".join(f"round({c}, 6) as {c}" for c in FOUR) + " from st")
def strength_decayed_split_asof(m):
    return r6(asof.split_strengths_asof(m))


@query(
    """, e as (select *, exp(-0.001 * date_diff('day', date, max(date) over (partition by league))) as w from matches where home_goals is not null and away_goals is not null),
 l as (select league, sum(w * home_goals) / sum(w) as mh, sum(w * away_goals) / sum(w) as ma from e group by league),
 k as (select distinct league, unnest([home_team, away_team]) as team from e),
 h as (select league, home_team as team, sum(w * home_goals) as f, sum(w * away_goals) as a, sum(w) as n from e group by all),
 a as (select league, away_team as team, sum(w * away_goals) as f, sum(w * home_goals) as a, sum(w) as n from e group by all)
 select k.league, k.team, round(case when h.n > 0 then least(greatest((h.f + 1e-9) / (mh * h.n + 1e-9), 0.3), 3.0) else 1.0 end, 6) as home_attack, round(case when h.n > 0 then least(greatest((h.a + 1e-9) / (ma * h.n + 1e-9), 0.3), 3.0) else 1.0 end, 6) as home_defence,
 round(case when a.n > 0 then least(greatest((a.f + 1e-9) / (ma * a.n + 1e-9), 0.3), 3.0) else 1.0 end, 6) as away_attack, round(case when a.n > 0 then least(greatest((a.a + 1e-9) / (mh * a.n + 1e-9), 0.3), 3.0) else 1.0 end, 6) as away_defence
 from k join l using (league) left join h on h.league = k.league and h.team = k.team left join a on a.league = k.league and a.team = k.team"""
)
def strength_decayed(m):
    return r6(asof.decayed_strengths(m))


def _side_sql(own: str, other: str) -> str:
    both = [("goals", "g"), ("shots", "s"), ("shots_target", "t"), ("corners", "k"), ("xg", "x")]
    pairs = ", ".join(f"{own}_{c} as {a}f, {other}_{c} as {a}a" for c, a in both)
    return f"select match_id, date, league, {own}_team as team, {str(own == 'home').lower()} as is_home, {pairs}, coalesce({own}_yellows, 0) + 2 * coalesce({own}_reds, 0) as cf, {own}_npxg as nf, {own}_xpts as pf from wide"


HIST_ALL = f""", wide as (select *, {", ".join(MORE_COLUMNS)} from matches), sides as ({_side_sql("home", "away")} union all {_side_sql("away", "home")}),
 played as (select *, case when gf > ga then 3 when gf = ga then 1 else 0 end as points, date_diff('day', lag(date) over (partition by league, team order by date, match_id), date) as gap from sides where gf is not null and ga is not null),
 days as (select distinct league, team, date from played),
 hist as (select d.league, d.team, d.date, p.* exclude (league, team, date), row_number() over (partition by d.league, d.team, d.date order by p.date desc, p.match_id desc) as n
   from days d join played p on p.league = d.league and p.team = d.team and p.date < d.date)
"""
MEANS = {"goals_for": "gf", "goals_against": "ga", "shots_for": "sf", "shots_against": "sa", "shots_target_for": "tf", "shots_target_against": "ta", "corners_for": "kf", "corners_against": "ka", "cards_for": "cf", "xg_for": "xf", "npxg_for": "nf", "xpts_for": "pf"}
ROLLING_ALL = (
    HIST_ALL
    + f""", form as (select league, team, date, count(*) as c, {", ".join(f"avg({c}) as {n}" for n, c in MEANS.items())} from hist where n <= 5 group by league, team, date),
 roll as (select d.league, d.team, d.date, coalesce(c, 0) as n_recent, {", ".join(f"coalesce({n}, 0) as {n}" for n in MEANS)} from days d left join form using (league, team, date))
"""
)


@query(ROLLING_ALL + "select league, team, date, n_recent, " + ", ".join(f"round({n}, 6) as {n}" for n in MEANS) + " from roll")
def rolling_form_5_all(m):
    return r6(asof.rolling_means(m.selectExpr("*", *MORE_COLUMNS), stats=asof.ALL_STATS).select("league", "team", "date", "n_recent", *MEANS))


@query(
    ROLLING_ALL
    + "select match_id, "
    + ", ".join(f"round(h.{n} - a.{n}, 6) as {n}_diff" for n in MEANS)
    + """ from matches m join roll h on h.league = m.league and h.team = m.home_team and h.date = m.date join roll a on a.league = m.league and a.team = m.away_team and a.date = m.date
 where home_goals is not null and away_goals is not null"""
)
def rolling_stats_diffs_all(m):
    return r6(asof.fixture_diffs(m.selectExpr("*", *MORE_COLUMNS), stats=asof.ALL_STATS).select("match_id", *[f"{n}_diff" for n in MEANS]))


STEPS = {f"{n}_{d}": f"coalesce({a}{d[0]}, 0)" for n, a in (("goals", "g"), ("shots", "s"), ("shots_target", "t"), ("xg", "x")) for d in ("for", "against")} | {
    "win": "case when points = 3 then 1.0 else 0 end", "draw": "case when points = 1 then 1.0 else 0 end", "loss": "case when points = 0 then 1.0 else 0 end",
    "is_home": "case when is_home then 1.0 else 0 end", "points": "coalesce(points, 0)", "rest": "case when n is null then 0 when gap is null then 1 else least(gap, 21) / 7.0 end",
}


@query(
    HIST_ALL
    + ", ks as (select unnest(range(5)) as step) select league, team, date, step, cast(n is not null as int) as there, "
    + ", ".join(f"round(cast({x} as double), 6) as {c}" for c, x in STEPS.items())
    + " from (select *, 5 - step as n0 from days, ks) d left join (select league as hl, team as ht, date as hd, * exclude (league, team, date) from hist) on hl = league and ht = team and hd = date and n = n0"
)
def last_k_sequence_all(m):
    steps = asof.last_sequences(m.selectExpr("*", *MORE_COLUMNS)).select("league", "team", "date", F.posexplode("steps").alias("pos", "s"))
    return r6(steps.select("league", "team", "date", F.col("pos").cast("long").alias("step"), "s.*"))


@query(RATES_ASOF + "select match_id, round(lh, 6) as home_rate, round(la, 6) as away_rate from rates")
def rates_asof(m):
    return r6(asof.rates_asof(m))


@query(CELLS_ASOF.replace("{rho}", "0.0") + OUTCOME)
def poisson_outcome_asof(m):
    return r6(goals.outcome_probs(asof.rates_asof(m)).drop("home_rate", "away_rate"))


@query(CELLS_ASOF.replace("{rho}", "-0.08") + OUTCOME)
def dixon_coles_outcome_asof(m):
    return r6(goals.outcome_probs(asof.rates_asof(m), -0.08).drop("home_rate", "away_rate"))


@query(CELLS_ASOF.replace("{rho}", "-0.08") + "select match_id, cast(n as int) as rank, round(p, 6) as p from (select *, row_number() over (partition by match_id order by p desc) as n from grid) where n <= 5")
def top_k_scorelines_asof(m):
    return r6(goals.top_scores(asof.rates_asof(m), 5, -0.08).select("match_id", "rank", "p"))


@query(None)
def elo_adjusted_lambdas_asof(m):
    rated = ratings.elo(m, 50.0, 80.0, by_day=True, unplayed=True).select("match_id", "home_elo", "away_elo")
    rows = asof.rates_asof(m).join(rated, "match_id")
    home, away = goals.with_elo(F.col("home_rate"), F.col("away_rate"), F.col("home_elo") - F.col("away_elo"), 0.11)
    return r6(rows.select("match_id", home.alias("home_rate"), away.alias("away_rate"), goals.over_25(F.col("home_rate") + F.col("away_rate")).alias("p_over")))


SCORED = FAIR + ", s as (select *, case y when 0 then ph when 1 then pd else pa end as py, case when ph >= pd and ph >= pa then 0 when pd >= pa then 1 else 2 end as pick from probs where ok = 1 and y is not null)"


@query(
    SCORED
    + """select league, count(*) as n, round(avg(-ln(py)), 6) as log_loss, round(avg(pow(ph - (y = 0)::double, 2) + pow(pd - (y = 1)::double, 2) + pow(pa - (y = 2)::double, 2)), 6) as brier,
 round(avg((pick = y)::double), 6) as accuracy from s group by league"""
)
def probability_quality(m):
    p = _probs()
    return r6(_priced(m).groupBy("league").agg(F.count(F.lit(1)).alias("n"), metrics.log_loss(p).alias("log_loss"), metrics.brier(p).alias("brier"), metrics.accuracy(p).alias("accuracy")))


@query(
    SCORED
    + """, b as (select least(floor(greatest(ph, pd, pa) * 10), 9) as bin, sum(greatest(ph, pd, pa)) as c, sum((pick = y)::double) as h, count(*) as n from s group by 1)
 select round(sum(abs(c - h)) / sum(n), 6) as ece from b"""
)
def ece(m):
    return r6(metrics.calibration_error(_priced(m), _probs()))


@query(
    SCORED
    + """, k as (select unnest(range(3)) as class), c as (select class, count(*) filter (pick = class and y = class) as tp, count(*) filter (pick = class) as np, count(*) filter (y = class) as nt from s, k group by class),
 d as (select class, case when np = 0 then 0 else tp / np end as p, case when nt = 0 then 0 else tp / nt end as r from c)
 select cast(class as int) as class, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from d"""
)
def class_metrics(m):
    return r6(metrics.class_metrics(_priced(m), _probs()).select("class", "precision", "recall", "f1"))


@query(SCORED + "select y, pick as pred, count(*) as n from s group by all")
def confusion(m):
    return metrics.confusion(_priced(m), _probs())


@query(
    SCORED
    + """, k as (select unnest(range(3)) as class) select cast(class as int) as class, round(avg(case class when 0 then ph when 1 then pd else pa end), 6) as mean_prob, round(avg((y = class)::double), 6) as rate, round(avg((pick = class)::double), 6) as pick_rate from s, k group by class"""
)
def class_marginals(m):
    return r6(metrics.class_marginals(_priced(m), _probs()))


TEMPS = [0.5, 0.8, 1.0, 1.25, 2.0, 4.0]


@query(
    SCORED
    + f""", g as (select unnest({TEMPS}) as t) select t::double as t, round(avg(-ln(pow(py, 1 / t) / (pow(ph, 1 / t) + pow(pd, 1 / t) + pow(pa, 1 / t)))), 6) as loss from s, g group by t"""
)
def temperature_grid(m):
    return r6(metrics.temperature_grid(_priced(m), _probs(), TEMPS))


@query(SCORED + ", g as (select unnest(range(21)) / 20.0 as w) select w::double as w, round(avg(-ln(w * py + (1 - w) * case y when 0 then 0.45 when 1 then 0.27 else 0.28 end)), 6) as loss from s, g group by w")
def blend_grid(m):
    return r6(metrics.blend_grid(_priced(m), _probs(), [F.lit(0.45), F.lit(0.27), F.lit(0.28)]))


@query(
    SCORED
    + f""", g as (select unnest({list(metrics.ALPHAS)}) as alpha), f as (select *, match_id % 2 as fold from s)
 select fold, alpha::double as alpha, round(avg(-ln(pow(py, 1 - alpha) * pow(case y when 0 then 0.45 when 1 then 0.27 else 0.28 end, alpha) / (pow(ph, 1 - alpha) * pow(0.45, alpha) + pow(pd, 1 - alpha) * pow(0.27, alpha) + pow(pa, 1 - alpha) * pow(0.28, alpha)))), 6) as loss
 from f, g group by grouping sets ((fold, alpha), (alpha))"""
)
def market_correction_grid(m):
    rows = _priced(m).withColumn("fold", F.col("match_id") % 2)
    return r6(metrics.correction_grid(rows, _probs(), [F.lit(0.45), F.lit(0.27), F.lit(0.28)]))


def _bets(m: DataFrame) -> DataFrame:
    return betting.ledger(_played(m), [F.lit(0.45), F.lit(0.27), F.lit(0.28)], O.legs("open_odds"), O.legs("open_odds"), O.legs("close_odds"))


BETS = (
    FAIR
    + """, ev as (select *, 0.45 * open_odds_home - 1 as eh, 0.27 * open_odds_draw - 1 as ed, 0.28 * open_odds_away - 1 as ea from probs where y is not null and open_odds_home is not null),
 pk as (select *, case when eh >= ed and eh >= ea then 0 when ed >= ea then 1 else 2 end as pick from ev),
 b0 as (select *, case pick when 0 then open_odds_home when 1 then open_odds_draw else open_odds_away end as bet_odds, case pick when 0 then 0.45::double when 1 then 0.27::double else 0.28::double end as bet_prob,
   case pick when 0 then eh when 1 then ed else ea end as ev, case pick when 0 then close_odds_home when 1 then close_odds_draw else close_odds_away end as co from pk),
 b1 as (select *, least(ev / (bet_odds - 1) * 0.25, 0.05) as stake from b0 where bet_odds <= 10 and ev <= 1 and ev > 0.05),
 bets as (select *, (pick = y)::int as won, case when pick = y then stake * (bet_odds - 1) else -stake end as profit, case when co > 1.0001 then bet_odds / co - 1 end as clv,
   (year(date) - case when month(date) < 8 then 1 else 0 end) as sy from b1 where stake >= 0.001)
"""
)
TOTALS = """count(*) as bets, cast(sum(won) as bigint) as wins, round(sum(stake), 4) as stake, round(sum(profit), 4) as profit, round(100 * coalesce(sum(profit) / nullif(sum(stake), 0), 0), 4) as roi,
 round(100 * avg(won::double), 4) as hit_rate, round(avg(bet_odds), 4) as avg_odds, round(avg(clv), 4) as avg_clv"""
SEASON = "sy || '-' || lpad(((sy + 1) % 100)::varchar, 2, '0')"


@query(BETS + "select match_id, pick, round(bet_odds, 6) as bet_odds, round(ev, 6) as ev, round(stake, 6) as stake, won, round(profit, 6) as profit, round(clv, 6) as clv from bets")
def bet_ledger(m):
    return r6(_bets(m).select("match_id", "pick", "bet_odds", "ev", "stake", "won", "profit", "clv"))


@query(
    BETS
    + f""", t as (select *, {SEASON} as season from bets) select case grouping(league, season) when 3 then 'all' when 1 then 'league' when 2 then 'season' else 'league_season' end as slice, league, season, {TOTALS}
 from t group by grouping sets ((), (league), (season), (league, season))"""
)
def bet_grouping_sets(m):
    return betting.slices(_bets(m))


def _cut_sql(x: str, cuts: list[float]) -> str:
    parts = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        low = "true" if a == float("-inf") else f"{x} {'>=' if k == 0 else '>'} {a}"
        high = "true" if b == float("inf") else f"{x} <= {b}"
        parts.append(f"when {low} and {high} then '{a:g}-{b:g}'")
    return "case " + " ".join(parts) + " end"


@query(
    BETS
    + f""", k as (select *, unnest([struct_pack(kind := 'all', label := 'all'), struct_pack(kind := 'league', label := league::varchar), struct_pack(kind := 'pick', label := pick::varchar),
 struct_pack(kind := 'odds', label := {_cut_sql("bet_odds", betting.ODDS_CUTS)}), struct_pack(kind := 'edge', label := {_cut_sql("ev", betting.EDGE_CUTS)}), struct_pack(kind := 'confidence', label := {_cut_sql("bet_prob", betting.CONFIDENCE_CUTS)})]) as b from bets)
 select b.kind as kind, b.label as label, {TOTALS} from k where b.label is not null group by 1, 2"""
)
def bet_buckets(m):
    return betting.buckets(_bets(m))


@query(BETS + "select match_id, row_number() over w as bet_number, round(sum(profit) over w, 6) as cum_profit, round(sum(profit) over w / sum(stake) over w, 6) as cum_roi from bets window w as (order by date, match_id rows between unbounded preceding and current row)")
def bet_curve(m):
    return r6(betting.curve(_bets(m)))


@query(
    BETS
    + f""", e as (select unnest({list(betting.EDGES)}) as edge, unnest(range({len(betting.EDGES)})) as i), p as (select unnest({list(betting.LEAST_PROBS)}) as least_prob, unnest(range({len(betting.LEAST_PROBS)})) as j),
 o as (select unnest({[x[0] for x in betting.ODDS_BANDS]}) as low, unnest({[x[1] for x in betting.ODDS_BANDS]}) as high, unnest(range({len(betting.ODDS_BANDS)})) as k),
 g as (select (i * {len(betting.LEAST_PROBS)} + j) * {len(betting.ODDS_BANDS)} + k as cell, edge, least_prob, low, high from e, p, o),
 f as (select cell, match_id % 2 + 1 as fold, count(*) as n, sum(profit) as p, sum(stake) as s from bets join g on ev > edge::double and bet_prob >= least_prob::double and bet_odds >= low::double and bet_odds <= high::double group by all)
 select cast(cell as int) as cell, cast(sum(n) as bigint) as bets, round(sum(p), 4) as profit, round(sum(p) / sum(s), 6) as roi, sum(n) >= 50 and sum(p) / sum(s) > 0 and count(*) filter (n >= 10 and p > 0) = 2 as passes from f group by cell"""
)
def selector_grid(m):
    out = betting.select_cell(_bets(m).withColumn("fold", (F.col("match_id") % 2 + 1)))
    return out.select("cell", "bets", F.round("profit", 4).alias("profit"), F.round("roi", 6).alias("roi"), "passes")


VALIDATION, TEST = "date >= date '1995-07-01' and date < date '1996-07-01'", "date >= date '1996-07-01'"
MODEL = (0.45, 0.27, 0.28)


@query(f"select match_id, ntile(2) over (order by date, match_id) as fold from matches where {PLAYED} and {VALIDATION}")
def validation_folds(m):
    return betting.chrono_fold(_played(m).where(VALIDATION)).select("match_id", "fold")


@query(None)
def selector_choice(m):
    of = lambda rows: betting.ledger(rows, [F.lit(p) for p in MODEL], O.legs("open_odds"), O.legs("open_odds"), O.legs("close_odds"), edge=min(betting.EDGES))
    played = _played(m)
    return r6(betting.choose_cell(of(betting.chrono_fold(played.where(VALIDATION))), of(played.where(TEST))))


@query(None)
def market_correction_choice(m):
    rows = betting.chrono_fold(_priced(m).where(VALIDATION))
    return r6(metrics.accept_correction(metrics.correction_grid(rows, _probs(), [F.lit(p) for p in MODEL])))


@query(
    """, b as (select match_id, over_odds as a, under_odds as b, 0.52 * over_odds - 1 as ea, 0.48 * under_odds - 1 as eb, home_goals + away_goals > 2.5 as over from matches where over_odds is not null and under_odds is not null and home_goals is not null and away_goals is not null),
 c as (select *, case when ea >= eb then 0 else 1 end as side from b), d as (select *, case side when 0 then a else b end as bet_odds, case side when 0 then ea else eb end as ev from c)
 select match_id, side, bet_odds, round(ev, 6) as ev, round(case when (side = 0) = over then bet_odds - 1 else -1 end, 6) as profit from d where bet_odds <= 10 and ev > 0.05"""
)
def binary_value_bets(m):
    out = betting.binary_bets(m, F.lit(0.52), F.col("over_odds"), F.col("under_odds"), F.col("home_goals") + F.col("away_goals") > 2.5)
    return r6(out.select("match_id", "side", "bet_odds", "ev", "profit"))


def _xg_rows(m: DataFrame) -> DataFrame:
    """What another source knows: expected goals under the same clubs, some a day or two off."""
    return m.where("home_xg is not null").select("league", "home_team", "away_team", F.date_add("date", (F.col("match_id") % 4 - 1).cast("int")).alias("date"), F.col("home_xg").alias("xg"))


XG = ", xg as (select league, home_team, away_team, date + cast(match_id % 4 - 1 as int) as date, home_xg as xg from matches where home_xg is not null)"


@query(
    XG
    + """, c as (select m.match_id, x.date as found_date, x.xg as found_xg, row_number() over (partition by m.match_id order by abs(date_diff('day', m.date, x.date)), x.date, x.xg) as n
 from matches m join xg x on x.league = m.league and x.home_team = m.home_team and x.away_team = m.away_team and abs(date_diff('day', m.date, x.date)) <= 2)
 select m.match_id, found_date, found_xg from matches m left join c on c.match_id = m.match_id and n = 1"""
)
def xg_nearest_date(m):
    return joining.nearest_date(m.select("match_id", "date", "league", "home_team", "away_team"), _xg_rows(m), ["league", "home_team", "away_team"], ["xg"]).select("match_id", "found_date", "found_xg")


@query(
    """, n as (select match_id, case when match_id % 3 = 0 then null else home_corners + 1 end as home_corners, away_yellows as extra from matches where match_id % 2 = 0), o as (select match_id, home_corners, home_xg from matches where match_id % 5 <> 0)
 select match_id, coalesce(n.home_corners, o.home_corners) as home_corners, o.home_xg as home_xg, n.extra as extra from o full join n using (match_id)"""
)
def context_outer_merge(m):
    old = m.where("match_id % 5 <> 0").select("match_id", "home_corners", "home_xg")
    new = m.where("match_id % 2 = 0").select("match_id", F.when(F.col("match_id") % 3 != 0, F.col("home_corners") + 1).alias("home_corners"), F.col("away_yellows").alias("extra"))
    return joining.outer_merge(old, new, ["match_id"])


@query(
    """, o as (select match_id, case when match_id % 5 <> 0 then home_corners end as home_corners, case when match_id % 5 <> 0 then home_xg end as home_xg from matches),
 n as (select match_id, case when match_id % 2 = 0 and match_id % 3 <> 0 then home_corners + 1 end as home_corners, case when match_id % 2 = 0 then away_yellows end as extra from matches)
 select match_id, coalesce(n.home_corners, o.home_corners) as home_corners, o.home_xg as home_xg, n.extra as extra from o full join n using (match_id)"""
)
def context_outer_merge_all(m):
    in_old, in_new = F.col("match_id") % 5 != 0, F.col("match_id") % 2 == 0
    old = m.select("match_id", *[F.when(in_old, F.col(c)).alias(c) for c in ("home_corners", "home_xg")])
    new = m.select("match_id", F.when(in_new & (F.col("match_id") % 3 != 0), F.col("home_corners") + 1).alias("home_corners"), F.when(in_new, F.col("away_yellows")).alias("extra"))
    return joining.outer_merge(old, new, ["match_id"])


@query("select match_id from matches m where not exists (select 1 from matches k where k.match_id = m.match_id and (k.home_xg is not null and k.match_id % 3 = 0))")
def context_anti_backfill(m):
    known = m.select("match_id", F.when(F.col("match_id") % 3 == 0, F.col("home_xg")).alias("home_xg"))
    return joining.missing_only(m.select("match_id"), known, ["match_id"], ["home_xg"])


@query(
    VIEW
    + """, g as (select league, team, opponent, min(date) as lo, max(date) as hi, count(*) as n from played group by all)
 select s.match_id, s.team, arg_max(g.opponent, (g.lo, g.opponent)) as reg_opponent from sides s left join (select league, team, opponent, lo, case when n % 2 = 0 then null else hi end as hi from g) g
 on g.league = s.league and g.team = s.team and g.lo <= s.date and (g.hi is null or g.hi >= s.date) where s.is_home group by s.match_id, s.team"""
)
def registry_asof(m):
    view = asof.team_view(m)
    registry = view.where("is_played").groupBy("league", "team", "opponent").agg(F.min("date").alias("date_from"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"))
    registry = registry.select("league", "team", "date_from", "opponent", F.when(F.col("n") % 2 != 0, F.col("hi")).alias("date_to"))
    return joining.registered_at(view.where("is_home").select("match_id", "league", "team", "date"), registry, ["league", "team"], ["match_id"]).select("match_id", "team", "reg_opponent")


@query(XG + ", s as (select min(date) as lo, max(date) as hi from xg), i as (select m.* from matches m, s where m.date between lo and hi), k as (select distinct league, home_team, away_team, date from xg) select league, count(*) as n, count(k.date) as matched, count(*) - count(k.date) as unmatched from i left join k using (league, home_team, away_team, date) group by league")
def coverage_report(m):
    return joining.coverage(m, _xg_rows(m), ["league", "home_team", "away_team", "date"])


@query(
    """select league, min(date) as first_date, max(date) as last_date, count(*) as n, count(*) filter (home_goals is not null and away_goals is not null) as n_played,
 count(*) filter (open_odds_home > 1.0001 and open_odds_draw > 1.0001 and open_odds_away > 1.0001) as with_odds, count(home_xg) as with_xg, count(distinct home_team) as n_teams from matches group by league"""
)
def dataset_summary(m):
    return m.groupBy("league").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"), F.count_if(F.expr(PLAYED)).alias("n_played"), F.count_if(O.given(O.legs("open_odds"))).alias("with_odds"), F.count("home_xg").alias("with_xg"), F.count_distinct("home_team").alias("n_teams"))
