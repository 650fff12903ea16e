"""What a team had done before a day: form, rest, rolling means, last matches.

A fixture on a day sees rows of earlier days only. All operators work on the team view, one row per team and
match, with one window per league and team; what holds before a day is taken at the team's first row of that day, so
matches of one day do not see each other. Ties on a day are ordered by match_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from touchline.functions.columns import finite

KEYS = ("league", "team")
#: Statistics of a side, by their names without home_ or away_.
STATS = ("goals", "shots", "corners", "xg")
ALL_STATS = (*STATS, "shots_target", "npxg", "xpts")


def _side(matches: DataFrame, own: str, other: str, stats: tuple[str, ...]) -> DataFrame:
    def stat(side: str, name: str) -> Column:
        return finite(f"{side}_{name}")

    cards = lambda side: F.coalesce(stat(side, "yellows"), F.lit(0.0)) + 2 * F.coalesce(stat(side, "reds"), F.lit(0.0))
    gf, ga = stat(own, "goals"), stat(other, "goals")
    return matches.select(
        "match_id", "date", "league",
        F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"),
        F.lit(own == "home").alias("is_home"),
        *[stat(own, s).alias(f"{s}_for") for s in stats], *[stat(other, s).alias(f"{s}_against") for s in stats],
        cards(own).alias("cards_for"), cards(other).alias("cards_against"),
        (gf.isNotNull() & ga.isNotNull()).alias("is_played"),
        F.when(gf > ga, 3).when(gf == ga, 1).when(gf < ga, 0).alias("points"),
    )


def team_view(matches: DataFrame, stats: tuple[str, ...] = STATS) -> DataFrame:
    """Each match twice, once as each side sees it."""
    return _side(matches, "home", "away", stats).unionByName(_side(matches, "away", "home", stats))


def _order(view: DataFrame):
    return Window.partitionBy(*KEYS).orderBy("date", "match_id")


def _at_first_of_day(view: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """league, team, date and ``columns`` as they stand at the team's first match of the day. Both windows
    share one shuffle and sort."""
    first = F.lag("date").over(_order(view))
    marked = view.select(*KEYS, "date", "match_id", (first.isNull() | (first < F.col("date"))).alias("__first"), *[c.alias(n) for n, c in columns.items()])
    return marked.where("__first").select(*KEYS, "date", *columns)


def before_each_day(view: DataFrame, after: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """league, team, date of every fixture, played or not, with ``state``: what ``after`` makes of the team's played
    matches, as it stood after the last one of an earlier day; null without any.

    ``after`` gets the window of a team's played matches in order. One shuffle by team serves both windows.
    """
    spread = view.repartition(*KEYS)
    own = Window.partitionBy(*KEYS, "is_played").orderBy("date", "match_id")
    state = F.when(F.col("is_played"), F.struct(*[c.alias(n) for n, c in after(own).items()]))
    known = spread.select(*KEYS, "date", "match_id", state.alias("state"))
    everything = Window.partitionBy(*KEYS).orderBy("date", "match_id")
    first = F.lag("date").over(everything)
    before = F.last("state", ignorenulls=True).over(everything.rowsBetween(Window.unboundedPreceding, -1))
    return known.select(*KEYS, "date", (first.isNull() | (first < F.col("date"))).alias("__first"), before.alias("state")).where("__first").drop("__first")


def fixture_means(matches: DataFrame, window: int = 5, stats: tuple[str, ...] = ALL_STATS) -> DataFrame:
    """Per league, team and date of every fixture, coming ones too: means of the last ``window`` played matches of
    earlier days (0 without any), share of points, weeks of rest and how many matches were looked back on."""
    names = [f"{s}_{d}" for s in (*stats, "cards") for d in ("for", "against")]

    def after(own: WindowSpec) -> dict[str, Column]:
        last = own.rowsBetween(1 - window, 0)
        n = F.count(F.lit(1)).over(last)
        return {c: F.avg(c).over(last) for c in names} | {"n_recent": n, "form": F.sum("points").over(last) / (3.0 * n), "day": F.col("date")}

    found = before_each_day(team_view(matches, stats), after)
    rest = F.coalesce(F.least(F.greatest(F.datediff("date", "state.day"), F.lit(0)), F.lit(21)) / 7.0, F.lit(1.0))
    return found.select(*KEYS, "date", *[F.coalesce(F.col(f"state.{c}"), F.lit(0.0)).alias(c) for c in (*names, "form")], F.coalesce("state.n_recent", F.lit(0)).cast("long").alias("n_recent"), rest.alias("rest"))


def both_sides(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """``matches`` with what ``teams`` (league, team, date, ...) has of the home side (home_*) and the away side."""
    for side in ("home", "away"):
        theirs = teams.select("league", "date", F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in teams.columns if c not in (*KEYS, "date")])
        matches = matches.join(theirs, ["league", "date", f"{side}_team"], "left")
    return matches


def rolling_means(matches: DataFrame, window: int = 5, stats: tuple[str, ...] = STATS) -> DataFrame:
    """Per league, team and date the means over the team's last ``window`` played matches of earlier days.

    A statistic's mean is over the matches that have it, 0 without any. Cards count as 0 where missing.
    """
    # Days of play only; ``fixture_means`` has coming fixtures too.
    played = team_view(matches, stats).where("is_played")
    names = [f"{s}_{d}" for s in (*stats, "cards") for d in ("for", "against")]
    last = Window.partitionBy(*KEYS).orderBy("date", "match_id").rowsBetween(-window, -1)
    if_played = _at_first_of_day(played, {n: F.coalesce(F.avg(n).over(last), F.lit(0.0)) for n in names} | {"n_recent": F.count(F.lit(1)).over(last)})
    return if_played


def fixture_diffs(matches: DataFrame, window: int = 5, stats: tuple[str, ...] = STATS) -> DataFrame:
    """For each played match home less away of the rolling means: one row per match."""
    means = rolling_means(matches, window, stats)
    names = [c for c in means.columns if c not in (*KEYS, "date")]
    home = means.select("league", "date", F.col("team").alias("home_team"), *[F.col(n).alias(f"h_{n}") for n in names])
    away = means.select("league", "date", F.col("team").alias("away_team"), *[F.col(n).alias(f"a_{n}") for n in names])
    joined = matches.where("home_goals is not null and away_goals is not null").select("match_id", "date", "league", "home_team", "away_team")
    joined = joined.join(home, ["league", "date", "home_team"]).join(away, ["league", "date", "away_team"])
    return joined.select("match_id", *[(F.col(f"h_{n}") - F.col(f"a_{n}")).alias(f"{n}_diff") for n in names if n != "n_recent"])


def points_form(matches: DataFrame, window: int = 5) -> DataFrame:
    """Points of the last ``window`` played matches as a share of what they could give; 0 without any."""
    last = Window.partitionBy(*KEYS).orderBy("date", "match_id").rowsBetween(-window, -1)
    n = F.count("points").over(last)
    form = F.when(n > 0, F.sum("points").over(last) / (3.0 * n)).otherwise(0.0)
    return _at_first_of_day(team_view(matches).where("is_played"), {"form": form})


def rest_days(matches: DataFrame) -> DataFrame:
    """Days since the last match of an earlier day, 0 to 21, as weeks; 1.0 for a team's first."""
    before = F.lag("date").over(Window.partitionBy(*KEYS).orderBy("date", "match_id"))
    days = F.datediff("date", before)
    weeks = F.coalesce(F.least(F.greatest(days, F.lit(0)), F.lit(21)) / 7.0, F.lit(1.0))
    return _at_first_of_day(team_view(matches).where("is_played"), {"rest": weeks})


def last_matches(matches: DataFrame, k: int = 5) -> DataFrame:
    """Per league, team and date an array of ``k`` steps, oldest first, of the last played matches of earlier
    days; missing steps stand in front, with ``there`` 0 and zeros."""
    step = F.struct(F.lit(1).alias("there"), F.col("is_home").cast("int").alias("is_home"), F.col("goals_for").alias("gf"), F.col("goals_against").alias("ga"), F.coalesce("shots_for", F.lit(0.0)).alias("shots"), F.col("points").alias("points"))
    empty = F.struct(F.lit(0).alias("there"), F.lit(0).alias("is_home"), F.lit(0.0).alias("gf"), F.lit(0.0).alias("ga"), F.lit(0.0).alias("shots"), F.lit(0).alias("points"))
    last = Window.partitionBy(*KEYS).orderBy("date", "match_id").rowsBetween(-k, -1)
    found = F.collect_list(step).over(last)
    return _at_first_of_day(team_view(matches).where("is_played"), {"steps": F.concat(F.array_repeat(empty, F.lit(k) - F.size(found)), found)})


def last_sequences(matches: DataFrame, k: int = 5) -> DataFrame:
    """As ``last_matches``, with all that is told of a match: the result one by one, shots, shots on target and
    expected goals of both sides (0 where missing) and the weeks of rest before it (3 at most, 1.0 before a first)."""
    view = team_view(matches, ALL_STATS).where("is_played")
    order = Window.partitionBy(*KEYS).orderBy("date", "match_id")
    days = F.datediff("date", F.lag("date").over(order))
    rested = view.withColumn("rest", F.when(days.isNull(), 1.0).otherwise(F.least(days, F.lit(21)) / 7.0))
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    point = lambda n: (F.col("points") == n).cast("double")
    counts = [f"{s}_{d}" for s in ("goals", "shots", "shots_target", "xg") for d in ("for", "against")]
    features = {c: known(c) for c in counts} | {"win": point(3), "draw": point(1), "loss": point(0), "is_home": known("is_home"), "points": known("points"), "rest": known("rest")}
    step = F.struct(F.lit(1).alias("there"), *[c.alias(n) for n, c in features.items()])
    empty = F.struct(F.lit(0).alias("there"), *[F.lit(0.0).alias(n) for n in features])
    found = F.collect_list(step).over(order.rowsBetween(-k, -1))
    return _at_first_of_day(rested, {"steps": F.concat(F.array_repeat(empty, F.lit(k) - F.size(found)), found)})


def league_snapshot(matches: DataFrame) -> DataFrame:
    """Each team as it stands after its last match: matches, last date, points, goals."""
    view = team_view(matches).where("is_played")
    last = F.struct("date", "match_id")
    return view.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_matches"), F.max("date").alias("last_date"), F.sum("points").alias("points"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"), F.max_by("opponent", last).alias("last_opponent"))


def flatten_history(held: DataFrame) -> DataFrame:
    """From teams with a JSON array of their matches, ``history``: match_id, team, side, xg, points."""
    each = F.from_json("history", "array<struct<match_id:bigint,h_a:string,xG:double,pts:int>>")
    return held.select("team", F.explode(each).alias("e")).select("e.match_id", "team", F.col("e.h_a").alias("side"), F.col("e.xG").alias("xg"), F.col("e.pts").alias("points"))


def league_teams(matches: DataFrame, since: str, least: int = 6) -> DataFrame:
    """Per league the sorted clubs that play from the day ``since`` on; leagues of fewer than ``least`` are left out."""
    sides = matches.where(F.col("date") >= F.lit(since).cast("date")).select("league", F.explode(F.array("home_team", "away_team")).alias("team"))
    return sides.groupBy("league").agg(F.array_sort(F.collect_set("team")).alias("teams")).where(F.size("teams") >= least)


def strengths(matches: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Attack and defence of each team: goals a match over the league's mean."""
    view = team_view(matches).where("is_played")
    team = view.groupBy(*KEYS).agg(F.avg("goals_for").alias("gf"), F.avg("goals_against").alias("ga"))
    league = view.groupBy("league").agg(F.avg("goals_for").alias("mean"))
    return team.join(league, "league").select(*KEYS, (F.col("gf") / (F.col("mean") + eps)).alias("attack"), (F.col("ga") / (F.col("mean") + eps)).alias("defence"))


def split_strengths(matches: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Attack and defence at home and away; the league's mean where a team has no match on a side."""
    view = team_view(matches).where("is_played")
    of = lambda home, c: F.avg(F.when(F.col("is_home") == home, F.col(c)))
    team = view.groupBy(*KEYS).agg(of(True, "goals_for").alias("hf"), of(True, "goals_against").alias("ha"), of(False, "goals_for").alias("af"), of(False, "goals_against").alias("aa"))
    league = view.groupBy("league").agg(of(True, "goals_for").alias("mh"), of(False, "goals_for").alias("ma"))
    ratio = lambda x, mean: F.coalesce(F.col(x), F.col(mean)) / (F.col(mean) + eps)
    return team.join(league, "league").select(*KEYS, ratio("hf", "mh").alias("home_attack"), ratio("ha", "ma").alias("home_defence"), ratio("af", "ma").alias("away_attack"), ratio("aa", "mh").alias("away_defence"))


def decayed_strengths_asof(matches: DataFrame, decay: float = 0.001, low: float = 0.3, high: float = 3.0, guard: float = 1e-9) -> DataFrame:
    """Home attack of each team before each day on which its league plays it, older matches weighing less.

    A match weighs exp(-decay * days before the league's last earlier day of play). The sums are running
    sums of exp(decay * day) rescaled, so a league's history is read once, not once for each day.
    """
    played = matches.where("home_goals is not null and away_goals is not null").withColumn("day", F.datediff("date", F.lit("1990-01-01").cast("date")))
    days = played.groupBy("league", "day").agg(F.sum("home_goals").alias("g"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("league").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.min("day").over(Window.partitionBy("league"))
    w = F.exp(decay * (F.col("day") - F.col("origin")))
    league = days.withColumn("origin", origin).select("league", "day", "origin", F.lag("day").over(Window.partitionBy("league").orderBy("day")).alias("before"), F.sum(w * F.col("g")).over(earlier).alias("lg"), F.sum(w * F.col("n")).over(earlier).alias("ln"))
    rows = played.select("league", F.col("home_team").alias("team"), "day", F.col("home_goals").alias("g")).join(league, ["league", "day"])
    teams = rows.groupBy("league", "team", "day").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("origin", "before", "lg", "ln")])
    own = Window.partitionBy("league", "team").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    scale = F.exp(-decay * (F.col("before") - F.col("origin")))
    tg, tn = F.coalesce(F.sum(w * F.col("g")).over(own), F.lit(0.0)) * scale, F.coalesce(F.sum(w * F.col("n")).over(own), F.lit(0.0)) * scale
    mean = F.col("lg") / F.col("ln")
    ratio = (tg + guard) / (mean * tn + guard)
    bounded = F.least(F.greatest(ratio, F.lit(low)), F.lit(high))
    return teams.select("league", "team", F.date_add(F.lit("1990-01-01").cast("date"), F.col("day")).alias("date"), F.when(F.col("before").isNotNull() & (tn > 0), bounded).otherwise(1.0).alias("home_attack"))


def decayed_strengths(matches: DataFrame, decay: float = 0.001, low: float = 0.3, high: float = 3.0, guard: float = 1e-9) -> DataFrame:
    """Home attack, home defence, away attack and away defence of each team after its league's last played day, a
    match weighing exp(-decay * days before it); 1.0 on a side without matches."""
    played = matches.where("home_goals is not null and away_goals is not null")
    ends = played.groupBy("league").agg(F.max("date").alias("end"))
    weighed = played.join(F.broadcast(ends), "league").withColumn("w", F.exp(-decay * F.datediff("end", "date")))  # a row a league
    means = weighed.groupBy("league").agg((F.sum(F.col("w") * F.col("home_goals")) / F.sum("w")).alias("mh"), (F.sum(F.col("w") * F.col("away_goals")) / F.sum("w")).alias("ma"))
    side = lambda own, other: weighed.select("league", F.col(f"{own}_team").alias("team"), F.lit(own == "home").alias("at_home"), "w", (F.col("w") * F.col(f"{own}_goals")).alias("f"), (F.col("w") * F.col(f"{other}_goals")).alias("a"))
    of = lambda home, c: F.sum(F.when(F.col("at_home") == home, F.col(c)).otherwise(0.0))
    teams = side("home", "away").unionByName(side("away", "home")).groupBy(*KEYS).agg(*[of(s == "h", c).alias(s + c) for s in "ha" for c in "faw"]).join(means, "league")
    ratio = lambda goals, mean, n: F.least(F.greatest((F.col(goals) + guard) / (F.col(mean) * F.col(n) + guard), F.lit(low)), F.lit(high))
    return teams.select(*KEYS, ratio("hf", "mh", "hw").alias("home_attack"), ratio("ha", "ma", "hw").alias("home_defence"), ratio("af", "ma", "aw").alias("away_attack"), ratio("aa", "mh", "aw").alias("away_defence"))


def split_strengths_asof(matches: DataFrame, decay: float = 0.001, low: float = 0.3, high: float = 3.0, guard: float = 1e-9, mean_home: float = 1.35, mean_away: float = 1.10) -> DataFrame:
    """Home attack, home defence, away attack and away defence of each team before each day on which it has a
    match, at home or away, played or not, with the league's means of goals then.

    Weights are those of ``decayed_strengths_asof``. Before a league's first result the means are ``mean_home`` and
    ``mean_away``; a team without matches on a side counts 1.0 there.
    """
    is_played = finite("home_goals").isNotNull() & finite("away_goals").isNotNull()
    zero, base = F.lit(0.0), F.lit("1990-01-01").cast("date")
    scored = matches.select("league", "home_team", "away_team", F.datediff("date", base).alias("day"), F.when(is_played, F.col("home_goals")).otherwise(zero).alias("hg"), F.when(is_played, F.col("away_goals")).otherwise(zero).alias("ag"), is_played.cast("double").alias("n"))
    days = scored.groupBy("league", "day").agg(*[F.sum(c).alias(c) for c in ("hg", "ag", "n")])
    earlier = Window.partitionBy("league").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.min("day").over(Window.partitionBy("league"))
    w = F.exp(decay * (F.col("day") - F.col("origin")))
    before = F.max(F.when(F.col("n") > 0, F.col("day"))).over(earlier)
    league = days.withColumn("origin", origin).select("league", "day", "origin", before.alias("before"), *[F.sum(w * F.col(c)).over(earlier).alias(f"l_{c}") for c in ("hg", "ag", "n")])
    at_home, on_road = ("home_for", "home_against", "home_n"), ("away_for", "away_against", "away_n")
    given = lambda names, columns: [F.col(c).alias(n) for n, c in zip(names, columns)]
    none = lambda names: [zero.alias(n) for n in names]
    home = scored.select("league", F.col("home_team").alias("team"), "day", *given(at_home, ("hg", "ag", "n")), *none(on_road))
    away = scored.select("league", F.col("away_team").alias("team"), "day", *given(on_road, ("ag", "hg", "n")), *none(at_home))
    sums = (*at_home, *on_road)
    teams = home.unionByName(away).groupBy("league", "team", "day").agg(*[F.sum(c).alias(c) for c in sums]).join(league, ["league", "day"])
    own = Window.partitionBy("league", "team").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    scale = F.exp(-decay * (F.col("before") - F.col("origin")))
    run = teams.select("league", "team", "day", "before", F.try_divide("l_hg", "l_n").alias("mh"), F.try_divide("l_ag", "l_n").alias("ma"), *[(F.coalesce(F.sum(w * F.col(c)).over(own), zero) * scale).alias(c) for c in sums])
    known = F.col("before").isNotNull()

    def ratio(goals: str, mean: str, n: str) -> Column:
        raw = (F.col(goals) + guard) / (F.col(mean) * F.col(n) + guard)
        return F.when(known, F.least(F.greatest(raw, F.lit(low)), F.lit(high))).otherwise(1.0)

    return run.select(
        "league", "team", F.date_add(base, F.col("day")).alias("date"),
        F.when(known, F.col("mh")).otherwise(mean_home).alias("mean_home"), F.when(known, F.col("ma")).otherwise(mean_away).alias("mean_away"),
        ratio("home_for", "mh", "home_n").alias("home_attack"), ratio("home_against", "ma", "home_n").alias("home_defence"),
        ratio("away_for", "ma", "away_n").alias("away_attack"), ratio("away_against", "mh", "away_n").alias("away_defence"),
    )


def rates_asof(matches: DataFrame, decay: float = 0.001, least: float = 0.05) -> DataFrame:
    """Each match, played or not, with the goal rates of both sides from what was known before its day:
    match_id, home_rate, away_rate."""
    found = split_strengths_asof(matches, decay)
    home = found.select("league", "date", F.col("team").alias("home_team"), "mean_home", "mean_away", "home_attack", "home_defence")
    away = found.select("league", "date", F.col("team").alias("away_team"), "away_attack", "away_defence")
    joined = matches.select("match_id", "league", "date", "home_team", "away_team").join(home, ["league", "date", "home_team"], "left").join(away, ["league", "date", "away_team"], "left")
    rate = lambda *c: F.greatest(F.col(c[0]) * F.coalesce(c[1], F.lit(1.0)) * F.coalesce(c[2], F.lit(1.0)), F.lit(least))
    return joined.select("match_id", rate("mean_home", "home_attack", "away_defence").alias("home_rate"), rate("mean_away", "away_attack", "home_defence").alias("away_rate"))
