"""Elo ratings, an ordered fold over each league's matches.

A rating depends on every earlier match of the league, so a league is the unit of parallel work: its rows are dealt to
one task, sorted there, and stream through as Arrow batches. What is carried from row to row is one rating per team, never
the rows. A grid of parameters is folded in the same pass: a rating is then a vector, with a place for each cell. A new
team enters with the mean of the three lowest ratings once five teams are known, before with the initial one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.asof import before_each_day

INITIAL = 1500.0
#: Known teams from which on a new one enters by the lowest ratings, and how many of those.
KNOWN, LOWEST = 5, 3
#: The weight of a goal difference of 0 to 4 and more.
MARGINS = (1.0, 1.0, 1.5, 1.75, 2.0)


class LeagueFold:
    """Ratings of one league's teams, as vectors over the cells of a grid (``gains`` and ``advantages``, as long as each
    other), while its matches come by in the order of date and match_id.

    With numbers for ``gains`` and ``advantages`` ratings are numbers too, which takes a tenth of a vector's time.
    ``by_day``: all matches of a day see the ratings before the day; otherwise each sees those before it.
    """

    def __init__(self, gains: np.ndarray | float, advantages: np.ndarray | float, by_day: bool = True, ratings: dict | None = None):
        self.gains, self.advantages, self.by_day = gains, advantages, by_day
        self.ratings: dict = ratings or {}
        self.day = None
        #: What teams that played on the present day had before it; None for those that were not known.
        self.before: dict = {}

    def _entry(self, at_dawn: bool) -> np.ndarray | float:
        known = self.ratings
        if at_dawn:
            known = {t: self.before.get(t, r) for t, r in known.items()}
            known = {t: r for t, r in known.items() if r is not None}
        if len(known) < KNOWN:
            return INITIAL + 0.0 * self.gains
        if isinstance(self.gains, float):
            return sum(sorted(known.values())[:LOWEST]) / LOWEST
        return np.sort(np.array(list(known.values())), axis=0)[:LOWEST].sum(axis=0) / LOWEST

    def _seen(self, team) -> np.ndarray | float:
        found = self.before[team] if self.by_day and team in self.before else self.ratings.get(team)
        return self._entry(self.by_day) if found is None else found

    def match(self, day, home, away, home_goals: float | None, away_goals: float | None) -> tuple:
        """(home and away ratings before the match, after it); the latter are None without a result, which changes
        nothing."""
        if day != self.day:
            self.day, self.before = day, {}
        h, a = self._seen(home), self._seen(away)
        if home_goals is None or away_goals is None or home_goals != home_goals or away_goals != away_goals:
            return h, a, None, None
        entry = None
        for team in (home, away):
            if team not in self.ratings:
                entry = self._entry(False) if entry is None else entry
                self.before.setdefault(team, None)
                self.ratings[team] = entry
            self.before.setdefault(team, self.ratings[team])
        now_h, now_a = self.ratings[home], self.ratings[away]
        expected = 1.0 / (1.0 + 10.0 ** ((now_a - now_h - self.advantages) / 400.0))
        result = 1.0 if home_goals > away_goals else 0.5 if home_goals == away_goals else 0.0
        step = self.gains * MARGINS[int(min(abs(home_goals - away_goals), 4))] * (result - expected)
        self.ratings[home], self.ratings[away] = now_h + step, now_a - step
        return h, a, self.ratings[home], self.ratings[away]


def _streamed(matches: DataFrame, gains: list[float] | float, advantages: list[float] | float, by_day: bool, start: DataFrame | None, columns: str, made) -> DataFrame:
    """``matches`` through one fold a league, as ``columns``. ``made`` turns lists of match_id, league and date and of what
    ``LeagueFold.match`` gives into the columns after these three. ``start`` (league, team, rating) is what the fold begins with."""
    rows = matches.select("league", "date", "match_id", "home_team", "away_team", "home_goals", "away_goals", F.lit(None).cast("double").alias("rating"))
    if start is not None:
        kinds = dict(rows.dtypes)
        null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
        rows = start.select("league", null("date"), null("match_id"), F.col("team").alias("home_team"), null("away_team"), null("home_goals"), null("away_goals"), "rating").unionByName(rows)
    ordered = rows.repartition("league").sortWithinPartitions("league", F.col("date").asc_nulls_first(), F.col("match_id").asc_nulls_first())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, advantage = (float(x) if isinstance(x, (int, float)) else np.array(x, float) for x in (gains, advantages))
        league, own = object(), None
        for batch in batches:
            out: list[tuple] = []
            keep = []
            for n, (its, day, home, away, hg, ag, rating) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6, 7)))):
                if own is None or its != league:
                    league, own = its, LeagueFold(k, advantage, by_day)
                if rating is not None:
                    own.ratings[home] = rating + 0.0 * k
                    continue
                keep.append(n)
                out.append(own.match(day, home, away, hg, ag))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(2), kept.column(0), kept.column(1), *made(out)], names)

    names = [c.split()[0] for c in columns.split(", ")]
    return ordered.mapInArrow(fold, columns)


def elo(matches: DataFrame, k: float = 50.0, home_adv: float = 80.0, by_day: bool = True, unplayed: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Ratings before each played match: match_id, league, date, home_elo, away_elo, and after it
    home_post, away_post.

    ``by_day``: all matches of a day see the ratings before the day; otherwise each sees those before it.
    ``unplayed``: matches without a result too, which change no rating and have none after them. ``start``: ratings
    (league, team, rating) that earlier matches left.
    """
    rows = matches.where("true" if unplayed else "home_goals is not null and away_goals is not null")
    kinds = dict(rows.dtypes)

    def made(out: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in out], pa.float64()) for k in range(4)]

    columns = f"match_id {kinds['match_id']}, league {kinds['league']}, date date, home_elo double, away_elo double, home_post double, away_post double"
    return _streamed(rows, k, home_adv, by_day, start, columns, made)


def elo_cells(matches: DataFrame, gains: tuple[float, ...], advantages: tuple[float, ...], by_day: bool = True) -> DataFrame:
    """Differences of ratings before each played match for each gain and home advantage: match_id, league, date, diffs (an array,
    in the order of gains, then of advantages). One pass over the matches, whatever the number of cells."""
    cells = [(float(k), float(a)) for k in gains for a in advantages]
    rows = matches.where("home_goals is not null and away_goals is not null")
    kinds = dict(rows.dtypes)

    def made(out: list[tuple]) -> list[pa.Array]:
        flat = np.concatenate([h - a for h, a, _, _ in out]) if out else np.zeros(0)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(cells), pa.int32()), pa.array(flat))]

    columns = f"match_id {kinds['match_id']}, league {kinds['league']}, date date, diffs array<double>"
    return _streamed(rows, [k for k, _ in cells], [a for _, a in cells], by_day, None, columns, made)


def elo_grid(matches: DataFrame, gains: tuple[float, ...], advantages: tuple[float, ...]) -> DataFrame:
    """As ``elo_cells``, a row for each match and cell: match_id, k, home_adv, diff."""
    cells = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(a)).alias("home_adv")) for k in gains for a in advantages])
    each = elo_cells(matches, gains, advantages).select("match_id", F.posexplode("diffs").alias("c", "diff"))
    return each.select("match_id", F.get(cells, F.col("c")).alias("cell"), "diff").select("match_id", "cell.k", "cell.home_adv", "diff")


def latest(rated: DataFrame, matches: DataFrame) -> DataFrame:
    """league, team, rating of each team after its last match, from what ``elo`` gives of ``matches``."""
    sides = _posts(rated, matches)
    return sides.groupBy("league", "team").agg(F.max_by("post", F.struct("date", "match_id")).alias("rating"))


def _posts(rated: DataFrame, matches: DataFrame) -> DataFrame:
    both = rated.join(matches.select("match_id", "home_team", "away_team"), "match_id")
    sides = [both.select("league", "date", "match_id", F.col(f"{s}_team").alias("team"), F.col(f"{s}_post").alias("post")) for s in ("home", "away")]
    return sides[0].unionByName(sides[1]).where("post is not null")


def momentum(matches: DataFrame, window: int = 4) -> DataFrame:
    """Per league, team and date the rating after the last match less that ``window`` - 1 matches before it,
    over 400; 0 with fewer than ``window`` matches of earlier days."""
    rated = elo(matches).join(matches.select("match_id", "home_team", "away_team"), "match_id")
    sides = [rated.select("league", "date", "match_id", F.col(f"{s}_team").alias("team"), F.col(f"{s}_post").alias("post")) for s in ("home", "away")]
    order = Window.partitionBy("league", "team").orderBy("date", "match_id")
    seen = sides[0].unionByName(sides[1]).withColumns({"last": F.lag("post", 1).over(order), "old": F.lag("post", window).over(order), "day": F.lag("date").over(order)})
    first = F.col("day").isNull() | (F.col("day") < F.col("date"))
    return seen.where(first).select("league", "team", "date", F.coalesce((F.col("last") - F.col("old")) / 400.0, F.lit(0.0)).alias("momentum"))


def momentum_asof(rated: DataFrame, window: int = 4) -> DataFrame:
    """As ``momentum``, for every fixture, coming ones too, of ``rated``: matches with home_post and away_post."""
    sides = [rated.select("league", "date", "match_id", F.col(f"{s}_team").alias("team"), F.col(f"{s}_post").alias("post"), F.col(f"{s}_post").isNotNull().alias("is_played")) for s in ("home", "away")]
    gain = lambda own: (F.col("post") - F.lag("post", window - 1).over(own)) / 400.0
    found = before_each_day(sides[0].unionByName(sides[1]), lambda own: {"momentum": gain(own)})
    return found.select("league", "team", "date", F.coalesce("state.momentum", F.lit(0.0)).alias("momentum"))


def iterative_strengths(matches: DataFrame, decay: float = 0.001, passes: int = 10) -> DataFrame:
    """Attack (from home games) and defence (from away games) of each team, adjusted to each other in turn: the
    home teams in the order of their first match, then those that only play away. A value stays where there is nothing
    to divide by.

    Only sums of each pair of teams go through the grouped map: their number grows with the clubs, not the matches.
    """
    played = matches.where("home_goals is not null and away_goals is not null")
    ends = played.groupBy("league").agg(F.max("date").alias("__end"))
    w = F.exp(-decay * F.datediff("__end", "date"))
    pairs = played.join(F.broadcast(ends), "league").groupBy("league", "home_team", "away_team").agg(F.sum(w).alias("w"), F.sum(w * F.col("home_goals")).alias("g"), F.min(F.struct("date", "match_id")).alias("first"))  # a row a league

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first", key=lambda c: c.map(lambda x: (x["date"], x["match_id"])))
        mean = rows.g.sum() / rows.w.sum()
        homes, aways = list(dict.fromkeys(rows.home_team)), list(dict.fromkeys(rows.away_team))
        attack = dict.fromkeys([*homes, *aways], 1.0)
        defence = dict(attack)
        at_home, on_road = dict(list(rows.groupby("home_team"))), dict(list(rows.groupby("away_team")))
        for _ in range(passes):
            for team in attack:
                for own, value, other, opponent in ((at_home.get(team), attack, defence, "away_team"), (on_road.get(team), defence, attack, "home_team")):
                    if own is not None and (base := mean * (own.w * own[opponent].map(other)).sum()) > 0:
                        value[team] = float(own.g.sum() / base)
        return pd.DataFrame({"league": rows.league.iloc[0], "team": list(attack), "attack": list(attack.values()), "defence": [defence[t] for t in attack]})

    kinds = dict(matches.dtypes)
    return pairs.groupBy("league").applyInPandas(fit, f"league {kinds['league']}, team {kinds['home_team']}, attack double, defence double")
