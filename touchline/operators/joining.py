"""Joins of matches with what other sources know, and keeping one of several rows."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import finite, is_close
from touchline.sources.shared import stored


def keep_first(rows: DataFrame, keys: list[str], *order: Column | str, last: bool = False) -> DataFrame:
    """One row of each key: the first in ``order`` (the last with ``last``). Nulls of an order come first."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    window = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() if last else c.asc_nulls_first() for c in cols])
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def left_context(matches: DataFrame, context: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``matches`` with ``columns`` of the context where it has them, else its own."""
    theirs = context.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = matches.join(theirs, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in matches.columns else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def outer_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; a new value replaces the old one unless it is null. Columns of one side only stay."""
    a = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in old.columns if c not in keys])
    b = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys])
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    found = lambda c: [F.col(f"{p}_{c}") for p, df in (("n", new), ("o", old)) if c in df.columns]
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(*found(c)).alias(c) for c in names])


def missing_only(rows: DataFrame, known: DataFrame, keys: list[str], signals: list[str]) -> DataFrame:
    """``rows`` whose keys have no signal among the known ones."""
    with_signal = known.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in signals])).select(*keys)
    return rows.join(with_signal, keys, "left_anti")


def nearest_date(matches: DataFrame, found: DataFrame, keys: list[str], columns: list[str], max_days: int = 2) -> DataFrame:
    """``matches`` with ``columns`` of the row of ``found`` with equal keys and the nearest date within
    ``max_days``; of equally near ones the earlier.

    Each found row is put on every date it may serve, so this is a join on equal keys and dates, whatever
    the number of rows of a key.
    """
    offsets = F.explode(F.sequence(F.lit(-max_days), F.lit(max_days)))
    served = found.select(*keys, F.col("date").alias("__d"), *[F.col(c).alias(f"__{c}") for c in columns], offsets.alias("__o")).withColumn("date", F.date_add("__d", F.col("__o")))
    best = served.groupBy(*keys, "date").agg(F.min_by(F.struct("__d", *[f"__{c}" for c in columns]), F.struct(F.abs("__o"), "__d", *[f"__{c}" for c in columns])).alias("__b"))
    return matches.join(best, [*keys, "date"], "left").withColumns({"found_date": F.col("__b.__d"), **{f"found_{c}": F.col(f"__b.__{c}") for c in columns}}).drop("__b")


def pair_sides(sides: DataFrame) -> DataFrame:
    """Matches from rows of single sides (date, team, is_home, scored, missed, xg, xga): home and away rows of one day
    whose goals mirror each other and whose expected goals are close. Goals are keys of the join."""
    home = sides.where("is_home").select("date", F.col("team").alias("home_team"), F.col("scored").alias("hg"), F.col("missed").alias("ag"), F.col("xg").alias("home_xg"), F.col("xga").alias("hxga"))
    away = sides.where("not is_home").select("date", F.col("team").alias("away_team"), F.col("scored").alias("ag"), F.col("missed").alias("hg"), F.col("xg").alias("away_xg"), F.col("xga").alias("axga"))
    near = is_close("home_xg", "axga", 1e-4) & is_close("away_xg", "hxga", 1e-4)
    return home.join(away, ["date", "hg", "ag"]).where(near).select("date", "home_team", "away_team", "home_xg", "away_xg")


def registered_at(rows: DataFrame, registry: DataFrame, keys: list[str], row_key: list[str], as_of: str = "date") -> DataFrame:
    """``rows`` with the registry's entry in force on their date (date_from to date_to, null is open): the one
    that began last, an open beginning last of all. ``row_key`` names the columns that tell rows apart. Columns of the
    entry get the prefix reg_."""
    entries = registry.select(*keys, *[F.col(c).alias(f"reg_{c}") for c in registry.columns if c not in keys])
    inside = (F.col("reg_date_from").isNull() | (F.col("reg_date_from") <= F.col(as_of))) & (F.col("reg_date_to").isNull() | (F.col("reg_date_to") >= F.col(as_of)))
    values = F.struct(*[c for c in entries.columns if c not in keys])
    order = F.struct(F.coalesce(F.col("reg_date_from"), F.lit("0001-01-01").cast("date")), values)
    asked = rows.select(*dict.fromkeys([*row_key, *keys, as_of])).distinct()
    best = asked.join(entries, keys).where(inside).groupBy(*row_key).agg(F.max_by(values, order).alias("__e"))
    return rows.join(best, row_key, "left").select(*rows.columns, "__e.*")


def coverage(matches: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Of the matches between the first and last date found: all, matched, unmatched, and share matched."""
    span = found.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = matches.crossJoin(F.broadcast(span)).where(F.col("date").between(F.col("lo"), F.col("hi")))  # one row
    marked = inside.join(found.select(*keys).distinct().withColumn("__there", F.lit(1)), keys, "left")
    return marked.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.count("__there").alias("matched"), (F.count(F.lit(1)) - F.count("__there")).alias("unmatched"))


def missing_sides(matches: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct home teams without a location that has both coordinates."""
    placed = locations.where(finite("latitude").isNotNull() & finite("longitude").isNotNull()).select("league", "team")
    return matches.select("league", F.col("home_team").alias("team")).distinct().join(placed, ["league", "team"], "left_anti")


def team_name_bridge(names: DataFrame, key: Column, order: str) -> DataFrame:
    """The first name of each join key in the order of ``order``: key, name."""
    return names.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min_by("name", order).alias("name"))


def fuzzy_pairs(local: DataFrame, theirs: DataFrame, keys: list[str], least: float = 0.72) -> DataFrame:
    """``local`` (id, names) with the most similar row of ``theirs`` that has equal ``keys``: id, other_id, score.

    The score is the mean of the two sides' similarities; of equal ones the smaller other_id, and none below ``least``.
    Both have id, home, away. Rows meet within a key only, such as a league's day.

    Each pair of names is compared once, however many rows bear it. For a home name and one of their away names only the best
    of their home names counts, so rows are not compared with all rows of their key: the best score first, then who has it.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit(""))  # noqa: E731  a missing name is like none, as an empty one
    mine = local.select(*keys, "id", named("home").alias("home"), named("away").alias("away"))
    pairs = stored(mine.select(*keys, "home", "away").distinct(), "fuzzy-mine")
    other = stored(theirs.groupBy(*keys, named("home").alias("__h"), named("away").alias("__a")).agg(F.min("id").alias("other_id")), "fuzzy-theirs")

    def alike(name: str, their: str, score: str) -> DataFrame:
        met = pairs.select(*keys, name).distinct().join(other.select(*keys, their).distinct(), keys).select(name, their).distinct()
        return stored(met.select(name, their, similarity(name, their).alias(score)), "fuzzy-names")

    by_home, by_away = alike("home", "__h", "__sh"), alike("away", "__a", "__sa")
    through = pairs.select(*keys, "home").distinct().join(other, keys).join(by_home, ["home", "__h"]).groupBy(*keys, "home", "__a").agg(F.max("__sh").alias("__best"))
    scored = pairs.join(stored(through, "fuzzy-through"), [*keys, "home"]).join(by_away, ["away", "__a"]).withColumn("__s", (F.col("__best") + F.col("__sa")) / 2)
    top = scored.groupBy(*keys, "home", "away").agg(F.max("__s").alias("score")).where(F.col("score") >= least)
    ways = scored.join(top, [*keys, "home", "away"]).where("__s = score").join(other, [*keys, "__a"]).join(by_home, ["home", "__h"]).where("__sh = __best")
    found = ways.groupBy(*keys, "home", "away").agg(F.min("other_id").alias("other_id"), F.max("score").alias("score"))
    best = mine.join(found, [*keys, "home", "away"]).groupBy("id").agg(F.max_by(F.struct("other_id", "score"), F.struct("score", -F.col("other_id"))).alias("b"))
    return best.select("id", "b.*")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of two texts, which no built-in function gives; 0 where one is missing or empty."""

    @F.pandas_udf("double")
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s, t).ratio() if s and t else 0.0 for s, t in zip(x, y)], dtype="float64")

    return ratios(a, b)


def active_entries(registry: DataFrame, as_of: str, keys: list[str]) -> DataFrame:
    """Entries in force on the day ``as_of``, one of each of ``keys``: the last by name."""
    day = F.lit(as_of).cast("date")
    inside = (F.col("date_from").isNull() | (F.col("date_from") <= day)) & (F.col("date_to").isNull() | (F.col("date_to") >= day))
    return keep_first(registry.where(inside), keys, "name", "date_from", last=True)


def unmatched_teams(matches: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per league the sorted set of clubs with a match between the first and last date found that was not found."""
    span = found.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = matches.crossJoin(F.broadcast(span)).where(F.col("date").between(F.col("lo"), F.col("hi")))  # one row
    teams = inside.join(found.select(*keys), keys, "left_anti").select("league", F.explode(F.array("home_team", "away_team")).alias("team"))
    return teams.groupBy("league").agg(F.array_sort(F.collect_set("team")).alias("teams"))


def provider_rows(raw: DataFrame, date: Column, home: Column, away: Column, numbers: dict[str, Column]) -> DataFrame:
    """A provider's match rows in the layout of matches: date, keys of both clubs, numbers; of one date and pair of clubs the
    first in the order of ``place``, rows without a date or a club left out."""
    rows = raw.select(date.alias("date"), home.alias("home_key"), away.alias("away_key"), *[c.alias(n) for n, c in numbers.items()], "place")
    return keep_first(rows.where("date is not null and home_key <> '' and away_key <> ''"), ["date", "home_key", "away_key"], "place").drop("place")


def collected(matches: DataFrame, since: str, until: str, keys: list[str], order: str) -> DataFrame:
    """Matches of the days ``since`` to ``until``, of repeated keys the last."""
    inside = F.col("date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    return keep_first(matches.where(inside), keys, order, last=True)


def hourly_weather(held: DataFrame, payload: Column | str) -> DataFrame:
    """From JSON whose ``hourly`` holds arrays beside each other (time, temperature_2m, wind_speed_10m, precipitation) a row an hour:
    the other columns of ``held``, date, kickoff_hour, temperature_c, wind_kph, precipitation_mm, weather_available (0 or 1).

    Arrays may be missing or of unequal length: what is not there is null. Hours without a time that can be read are left
    out, as are payloads without times. A value that is no number is null.
    """
    names = {"temperature_2m": "temperature_c", "wind_speed_10m": "wind_kph", "precipitation": "precipitation_mm"}
    kind = "hourly struct<time:array<string>," + ",".join(f"{c}:array<string>" for c in names) + ">"
    column = F.col(payload) if isinstance(payload, str) else payload
    read = held.withColumn("__h", F.from_json(column, kind)["hourly"])
    each = F.explode(F.arrays_zip(*[F.coalesce(F.col(f"__h.{c}"), F.array().cast("array<string>")).alias(c) for c in ("time", *names)]))
    rows = read.withColumn("__e", each).withColumn("__t", F.try_to_timestamp(F.regexp_replace("__e.time", "T", " ")))
    values = {n: finite(F.col(f"__e.{c}").try_cast("double")) for c, n in names.items()}
    known = F.coalesce(*values.values()).isNotNull().cast("int")
    kept = [c for c in held.columns if not (isinstance(payload, str) and c == payload)]
    return rows.where("__t is not null").select(*kept, F.to_date("__t").alias("date"), F.hour("__t").alias("kickoff_hour"), *[v.alias(n) for n, v in values.items()], known.alias("weather_available"))
