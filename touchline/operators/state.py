"""What is known of each team before a day, from the history itself or from a stored state and the days after it.

A state is the last rows of each team in the team view, ``KEPT`` at most, and a row a league. Sums that run over the whole
history (decayed goals, points, matches) stand in columns of their own: a match adds to them what it weighs, and the
oldest row kept has all that the rows dropped before it had. So a state is history, only shorter: what holds before a day
follows from state and later matches by the same windows as from all matches, and so does the next state.

One shuffle by team serves all that is known of a side, and one by match brings both sides together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.columns import finite
from touchline.operators import asof, ratings

#: Rows of a team in a state: no window over a team's matches may be longer.
KEPT = 5
#: Weights are exp(decay * days since then).
ORIGIN = "1990-01-01"
#: A league's means of goals before its first result; bounds of strengths, and what keeps them from 0 / 0.
MEANS, BOUNDS, GUARD = (1.35, 1.10), (0.3, 3.0), 1e-9
STATS = (*asof.ALL_STATS, "post")
SUMS = ("home_for", "home_against", "home_n", "away_for", "away_against", "away_n", "matches", "points", "goals_for", "goals_against")
_ROW = ("league", "team", "date", "match_id", "opponent", "is_home", "is_played", "points")


@dataclass
class LeagueState:
    """``teams``: rows of the team view with what they add to ``SUMS`` (sum_*); ``leagues``: league, date, hg, ag, n (goals
    and matches up to the league's last day of play, by the weights of ``decay``). Both by the gain, advantage and decay that
    they were made with."""

    teams: DataFrame
    leagues: DataFrame
    k: float = 50.0
    home_adv: float = 80.0
    decay: float = 0.001

    def write(self, path: str) -> None:
        self.teams.write.mode("overwrite").parquet(f"{path}/teams")
        self.leagues.write.mode("overwrite").parquet(f"{path}/leagues")
        spark = self.teams.sparkSession
        spark.createDataFrame([(self.k, self.home_adv, self.decay)], "k double, home_adv double, decay double").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")

    @staticmethod
    def read(spark: SparkSession, path: str) -> LeagueState:
        made = spark.read.parquet(f"{path}/parameters").first()
        return LeagueState(spark.read.parquet(f"{path}/teams"), spark.read.parquet(f"{path}/leagues"), *made)

    def ratings(self) -> DataFrame:
        """league, team, rating of the teams that have one."""
        return self.teams.where("is_played").groupBy("league", "team").agg(F.max_by("post_for", F.struct("date", "match_id")).alias("rating"))


def _weight(decay: float) -> Column:
    return F.exp(decay * F.datediff("date", F.lit(ORIGIN).cast("date")))


def _rows(rated: DataFrame, decay: float) -> DataFrame:
    """The team view of matches with home_post and away_post, and what each row adds to ``SUMS``."""
    missing = [f"{s}_{n}" for s in ("home", "away") for n in STATS if f"{s}_{n}" not in rated.columns]
    view = asof.team_view(rated.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else rated, STATS)
    w, zero = _weight(decay), F.lit(0.0)
    at = lambda home, x: F.when(F.col("is_played") & (F.col("is_home") == home), w * x).otherwise(zero)
    one, of = F.lit(1.0), lambda c: F.when(F.col("is_played"), F.col(c).cast("double")).otherwise(zero)
    values = [at(s, x) for s in (True, False) for x in (F.col("goals_for"), F.col("goals_against"), one)]
    values += [F.when(F.col("is_played"), one).otherwise(zero), of("points"), of("goals_for"), of("goals_against")]
    return view.withColumns({f"sum_{n}": v for n, v in zip(SUMS, values)})


def _days(matches: DataFrame, decay: float) -> DataFrame:
    is_played = finite("home_goals").isNotNull() & finite("away_goals").isNotNull()
    of = lambda x: F.sum(F.when(is_played, _weight(decay) * x).otherwise(0.0))
    return matches.groupBy("league", "date").agg(of(F.col("home_goals")).alias("hg"), of(F.col("away_goals")).alias("ag"), of(F.lit(1.0)).alias("n"))


def rated(matches: DataFrame, k: float, home_adv: float, state: LeagueState | None = None) -> DataFrame:
    """``matches`` with home_elo, away_elo, and home_post and away_post where they are played."""
    found = ratings.elo(matches, k, home_adv, by_day=True, unplayed=True, start=state.ratings() if state else None)
    return matches.join(found.select("match_id", "home_elo", "away_elo", "home_post", "away_post"), "match_id")


def sides(matches: DataFrame, decay: float = 0.001, state: LeagueState | None = None, window: int = 5, momentum: int = 4) -> DataFrame:
    """``matches`` (with home_post and away_post if momentum is wanted) and, of both sides, home_* and away_*: means of the last
    ``window`` played matches of earlier days (0 without any; *_mean), form, n_recent, rest, momentum, attack and
    defence at home and away; and the league's mean_home and mean_away. Every match has a row, played or not.

    Matches of one day don't see each other. All matches must be later than those of ``state``.
    """
    if max(window, momentum) > KEPT:
        raise ValueError(f"a state keeps {KEPT} rows a team")
    rows = _rows(matches, decay).withColumn("is_new", F.lit(True))
    days = _days(matches, decay)
    if state:
        rows = rows.unionByName(state.teams.withColumn("is_new", F.lit(False)))
        days = days.unionByName(state.leagues)
    names = [f"{s}_{d}" for s in (*asof.ALL_STATS, "cards") for d in ("for", "against")]
    own = Window.partitionBy(*asof.KEYS, "is_played").orderBy("date", "match_id")
    last, ever = own.rowsBetween(1 - window, 0), own.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(last)
    after = {c: F.avg(c).over(last) for c in names} | {"n_recent": n, "form": F.sum("points").over(last) / (3.0 * n), "day": F.col("date"), "momentum": (F.col("post_for") - F.lag("post_for", momentum - 1).over(own)) / 400.0}
    after |= {f"sum_{c}": F.sum(f"sum_{c}").over(ever) for c in SUMS[:6]}
    known = rows.repartition(*asof.KEYS).withColumn("state", F.when(F.col("is_played"), F.struct(*[c.alias(x) for x, c in after.items()])))
    everything = Window.partitionBy(*asof.KEYS).orderBy("date", "match_id")
    known = known.withColumn("before", F.last("state", ignorenulls=True).over(everything.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("state", F.first("before").over(Window.partitionBy(*asof.KEYS, "date").orderBy("match_id")))
    of = lambda home: F.first(F.when(F.col("is_home") == home, F.struct("state")), ignorenulls=True)
    both = known.where("is_new").groupBy("match_id").agg(of(True).alias("h"), of(False).alias("a"))
    earlier = Window.partitionBy("league").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    league = days.select("league", "date", F.max(F.when(F.col("n") > 0, F.col("date"))).over(earlier).alias("__end"), *[F.sum(c).over(earlier).alias(f"__{c}") for c in ("hg", "ag", "n")])
    joined = matches.join(both, "match_id").join(league, ["league", "date"])
    back = F.exp(-decay * F.datediff("__end", F.lit(ORIGIN).cast("date")))
    joined = joined.withColumns({"mean_home": F.coalesce(F.try_divide("__hg", "__n"), F.lit(MEANS[0])), "mean_away": F.coalesce(F.try_divide("__ag", "__n"), F.lit(MEANS[1])), "__back": back})

    def ratio(side: str, goals: str, mean: str, count: str) -> Column:
        total = lambda c: F.coalesce(F.col(f"{side}.state.sum_{c}"), F.lit(0.0)) * F.col("__back")
        raw = (total(goals) + GUARD) / (F.col(mean) * total(count) + GUARD)
        return F.when(F.col("__end").isNotNull(), F.least(F.greatest(raw, F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))).otherwise(1.0)

    columns: dict[str, Column] = {}
    for side, s in (("home", "h"), ("away", "a")):
        held = lambda c, s=s: F.col(f"{s}.state.{c}")
        rest = F.coalesce(F.least(F.greatest(F.datediff("date", held("day")), F.lit(0)), F.lit(21)) / 7.0, F.lit(1.0))
        columns |= {f"{side}_{c}_mean": F.coalesce(held(c), F.lit(0.0)) for c in names}
        columns |= {f"{side}_form": F.coalesce(held("form"), F.lit(0.0)), f"{side}_n_recent": F.coalesce(held("n_recent"), F.lit(0)), f"{side}_rest": rest, f"{side}_momentum": F.coalesce(held("momentum"), F.lit(0.0))}
        columns |= {f"{side}_home_attack": ratio(s, "home_for", "mean_home", "home_n"), f"{side}_home_defence": ratio(s, "home_against", "mean_away", "home_n"), f"{side}_away_attack": ratio(s, "away_for", "mean_away", "away_n"), f"{side}_away_defence": ratio(s, "away_against", "mean_home", "away_n")}
    return joined.withColumns(columns).drop("h", "a", "__end", "__hg", "__ag", "__n", "__back")


def advance(matches: DataFrame, state: LeagueState | None = None, k: float = 50.0, home_adv: float = 80.0, decay: float = 0.001) -> LeagueState:
    """The state after ``matches``, which are all later than those of ``state`` (whose parameters then count). Matches without a
    result leave no trace."""
    if state:
        k, home_adv, decay = state.k, state.home_adv, state.decay
    played = matches.where(finite("home_goals").isNotNull() & finite("away_goals").isNotNull())
    rows, days = _rows(rated(played, k, home_adv, state), decay), _days(played, decay)
    if state:
        rows, days = rows.unionByName(state.teams), days.unionByName(state.leagues)
    order = Window.partitionBy(*asof.KEYS).orderBy("date", "match_id")
    back = F.row_number().over(Window.partitionBy(*asof.KEYS).orderBy(F.desc("date"), F.desc("match_id")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"__back": back, "__n": F.count(F.lit(1)).over(Window.partitionBy(*asof.KEYS)), **{f"__{c}": F.sum(f"sum_{c}").over(upto) for c in SUMS}}).where(F.col("__back") <= KEPT)
    oldest = F.col("__back") == F.least(F.col("__n"), F.lit(KEPT))
    kept = counted.withColumns({f"sum_{c}": F.when(oldest, F.col(f"__{c}")).otherwise(F.col(f"sum_{c}")) for c in SUMS}).select(*[c for c in rows.columns])
    leagues = days.groupBy("league").agg(F.max(F.when(F.col("n") > 0, F.col("date"))).alias("date"), *[F.sum(c).alias(c) for c in ("hg", "ag", "n")]).where("date is not null")
    return LeagueState(kept, leagues, k, home_adv, decay)


def standings(state: LeagueState) -> DataFrame:
    """Each team as the state has it: league, team, n_matches, last_date, last_opponent, points, goals_for, goals_against, rating, form
    and momentum for a next match, and attack and defence at home and away after the league's last day of play."""
    at = F.struct("date", "match_id")
    teams = state.teams.groupBy(*asof.KEYS).agg(
        F.max("date").alias("last_date"), F.max_by("opponent", at).alias("last_opponent"), F.max_by("post_for", at).alias("rating"), (F.sum("points") / (3.0 * F.count("points"))).alias("form"),
        F.sort_array(F.collect_list(F.struct("date", "match_id", F.col("post_for").alias("post")))).alias("__posts"), *[F.sum(f"sum_{c}").alias(c) for c in SUMS],
    )
    ends = state.leagues.select("league", F.col("date").alias("__end"), (F.col("hg") / F.col("n")).alias("mean_home"), (F.col("ag") / F.col("n")).alias("mean_away"))
    joined = teams.join(ends, "league")
    back = F.exp(-state.decay * F.datediff("__end", F.lit(ORIGIN).cast("date")))

    def ratio(goals: str, mean: str, n: str) -> Column:
        return F.least(F.greatest((F.col(goals) * back + GUARD) / (F.col(mean) * F.col(n) * back + GUARD), F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))

    gained = F.when(F.size("__posts") >= 4, (F.col("rating") - F.element_at("__posts", -4)["post"]) / 400.0).otherwise(0.0)
    return joined.select(
        *asof.KEYS, F.col("matches").cast("long").alias("n_matches"), "last_date", "last_opponent", F.col("points").cast("long").alias("points"), "goals_for", "goals_against", "rating", "form", gained.alias("momentum"),
        ratio("home_for", "mean_home", "home_n").alias("home_attack"), ratio("home_against", "mean_away", "home_n").alias("home_defence"), ratio("away_for", "mean_away", "away_n").alias("away_attack"), ratio("away_against", "mean_home", "away_n").alias("away_defence"),
    )
