"""Queries that write files and read them again, check tables, and run over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import validation as V  # noqa: N812
from touchline.functions.columns import clip01, is_close, safe_logit, sigmoid
from touchline.plans.prematch_queries import elo_sql
from touchline.plans.queries import ORACLES, PLAYED, QUERIES, query, r6
from touchline.sources import files
from touchline.sources.shared import shared_path, stored
from touchline.streaming import ratings_stream, replay


def table_query(sql: str | None = None):
    """Registers a query of (spark, sf_dir), whose SQL is whole."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_DATE = "case match_id % 3 when 0 then date_format(date, 'dd/MM/yyyy') when 1 then date_format(date, 'yyyy-MM-dd') else date_format(date, 'd-M-yyyy') end"


def _sql_given(o: tuple[str, str, str]) -> str:
    return "(" + " and ".join(f"{x} > 1.0001" for x in o) + ")"


def _sql_mean(*books: tuple[str, str, str]) -> list[str]:
    """SQL of the odds without margin of the books' mean probabilities."""
    n = " + ".join(f"coalesce({_sql_given(b)}, false)::int" for b in books)
    legs = [" + ".join(f"case when {_sql_given(b)} then 1 / {b[k]} / (1 / {b[0]} + 1 / {b[1]} + 1 / {b[2]}) else 0 end" for b in books) for k in range(3)]
    mean = [f"(({leg}) / nullif({n}, 0))" for leg in legs]
    return [f"(({' + '.join(mean)}) / {m})" for m in mean]


def _triple(prefix: str) -> tuple[str, str, str]:
    return f"{prefix}_home", f"{prefix}_draw", f"{prefix}_away"


def _sql_league() -> str:
    """What must be loaded from three kinds of files: by match_id % 3 = 0 two books, a pair of totals and a few statistics; 1 the closing
    book, the means of the market, other totals and a line; 2 one book and the rest of the statistics."""
    open_, close, own = _triple("open_odds"), _triple("close_odds"), _triple("odds")
    by_kind = {
        "odds": (_sql_mean(open_, close), [f"case when {_sql_given(close)} then {c} else {b} end" for c, b in zip(close, _sql_mean(own))], _sql_mean(own)),
        "open_odds": (_sql_mean(open_, close), [f"case when {_sql_given(open_)} then {c} else {b} end" for c, b in zip(open_, _sql_mean(own))], _sql_mean(own)),
        "close_odds": (["null"] * 3, [f"case when {_sql_given(own)} then {c} else {b} end" for c, b in zip(own, _sql_mean(close))], ["null"] * 3),
    }
    picks = [f"round(case match_id % 3 when 0 then {kinds[0][k]} when 1 then {kinds[1][k]} else {kinds[2][k]} end, 6) as {name}_{leg}" for name, kinds in by_kind.items() for k, leg in enumerate(("home", "draw", "away"))]
    total = "over_odds > 1.0001 and under_odds > 1.0001 and match_id % 3 < 2"
    columns = {
        "ou25_over_prob": f"round(case when {total} then 1 / over_odds / (1 / over_odds + 1 / under_odds) end, 6)", "ou25_over_odds": f"case when {total} then over_odds end", "ou25_under_odds": f"case when {total} then under_odds end",
        "ah_line": "case when match_id % 3 = 1 then ah_line end", "home_shots": "case when match_id % 3 = 0 then home_shots end", "away_shots": "case when match_id % 3 = 0 then away_shots end",
        "home_corners": "case when match_id % 3 > 0 then home_corners end", "home_reds": "case when match_id % 3 = 2 then home_reds end", "away_fouls": "cast(null as double)",
    }
    chosen = "(select *, row_number() over (partition by date, home_team, away_team order by match_id % 3, match_id) as n from matches where match_id % 11 <> 0)"
    return f"select date, case home_team when 7 then 'The Sevens' else 'club ' || home_team end as home_team, case away_team when 7 then 'The Sevens' else 'club ' || away_team end as away_team, home_goals, away_goals, {', '.join(picks)}, {', '.join(f'{v} as {k}' for k, v in columns.items())}, {PLAYED} as is_played from {chosen} where n = 1"


#: The provider's columns of each kind of file, and of what they are made.
_KINDS = (
    {"HS": "home_shots", "AS": "away_shots", "B365>2.5": "over_odds", "B365<2.5": "under_odds", **dict(zip(files.BOOKS[0], _triple("open_odds"))), **dict(zip(files.BOOKS[1], _triple("close_odds")))},
    {"AHh": "ah_line", **dict(zip(files.CLOSING, _triple("close_odds"))), **dict(zip(files.AVERAGE_OPENING, _triple("open_odds"))), **dict(zip(files.AVERAGE_CLOSING, _triple("odds"))), **dict(zip(files.BOOKS[5], _triple("odds"))), "HC": "home_corners", "AvgC>2.5": "over_odds", "AvgC<2.5": "under_odds"},
    {**dict(zip(files.BOOKS[6], _triple("odds"))), "HR": "home_reds", "HC": "home_corners"},
)
_BASE = {"Date": "__d", "HomeTeam": "__h", "AwayTeam": "__a", "FTHG": "home_goals", "FTAG": "away_goals"}


def _league_files(m, folder: str) -> None:
    """Three folders of files, of other columns and in another order each."""
    raw = m.withColumns({"__d": F.when(F.col("match_id") % 11 == 0, F.lit("soon")).otherwise(F.expr(_DATE)), "__h": F.concat(F.lit("  club  "), "home_team"), "__a": F.concat(F.lit("club "), "away_team")})
    for k, columns in enumerate(_KINDS):
        names = list((_BASE | columns).items()) if k != 1 else list((columns | _BASE).items())
        part = raw.where(F.col("match_id") % 3 == k).repartitionByRange(3, "match_id").sortWithinPartitions("match_id")
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("-" if n.startswith(("PS", "B365")) else "")).alias(n) for n, c in names]
        files.write_csv(part.select(*cells), f"{folder}/season{k}")


@query(_sql_league())
def csv_league_load(m):
    path = shared_path(m.sparkSession, "league")
    _league_files(m, path)
    loaded = files.load_league(m.sparkSession, f"{path}/season*/*.csv", {"club 7": "The Sevens"})
    odds = [f"{p}_{leg}" for p in ("odds", "open_odds", "close_odds") for leg in ("home", "draw", "away")]
    return r6(loaded.select("date", "home_team", "away_team", "home_goals", "away_goals", *odds, "ou25_over_prob", "ou25_over_odds", "ou25_under_odds", "ah_line", "home_shots", "away_shots", "home_corners", "home_reds", "away_fouls", "is_played"))


@query("select match_id, home_xg, cast(null as varchar) as note from matches where home_xg is not null")
def optional_csv(m):
    """A table that is there, without one of its columns and with one too many, and one that is not."""
    spark, schema = m.sparkSession, "match_id bigint, home_xg double, note string"
    path = shared_path(spark, "optional")
    files.write_csv(m.where("home_xg is not null").select("match_id", F.col("home_xg").alias("HOME_XG"), "league"), path)
    return files.read_optional(spark, path, schema).unionByName(files.read_optional(spark, f"{path}-absent", schema))


@query("select match_id, home_xg, case when match_id % 2 = 1 then away_xg end as away_xg from matches")
def schema_evolution_union(m):
    spark = m.sparkSession
    path = shared_path(spark, "appended")
    files.append_rows(m.where("match_id % 2 = 0").select("match_id", "home_xg"), path)
    files.append_rows(m.where("match_id % 2 = 1").select("match_id", "home_xg", "away_xg"), path)
    return files.read_appended(spark, path).select("match_id", "home_xg", "away_xg")


@query("select match_id, league, home_xg from matches where match_id % 7 = (select max(match_id % 7) from matches)")
def latest_run_rows(m):
    return files.latest_run(m.withColumn("run", F.col("match_id") % 7), "run").select("match_id", "league", "home_xg")


@query(f"select strftime(date, '%d/%m/%Y') as \"Date\", 'club ' || home_team as \"HomeTeam\", 'club ' || away_team as \"AwayTeam\", cast(null as double) as \"FTHG\", cast(null as double) as \"PSCH\" from matches where not ({PLAYED})")
def standard_fixtures(m):
    result = F.concat_ws(" - ", F.col("home_goals").cast("int").cast("string"), F.col("away_goals").cast("int").cast("string"))
    raw = m.select("date", F.concat(F.lit("club  "), "home_team").alias("h"), F.concat(F.lit("club "), "away_team").alias("a"), result.alias("result"))
    return files.standard_fixtures(raw, "date", "h", "a", "result").select("Date", "HomeTeam", "AwayTeam", "FTHG", "PSCH")


@query("select league, 'club ' || team as team, latitude, longitude from (select league, home_team as team, match_id, cast(match_id % 90 as double) as latitude, cast(match_id % 70 as double) as longitude, row_number() over (partition by league, home_team order by match_id desc) as n from matches where match_id % 5 <> 0 and match_id % 3 <> 0) where n = 1")
def team_locations(m):
    raw = m.select("league", F.concat(F.lit("club  "), "home_team").alias("team"), F.when(F.col("match_id") % 5 != 0, (F.col("match_id") % 90).cast("string")).otherwise("?").alias("latitude"), F.when(F.col("match_id") % 3 != 0, (F.col("match_id") % 70).cast("string")).alias("longitude"), F.col("match_id").alias("place"))
    return files.locations(raw)


@query("select date, 'club ' || home_team as home_team, 'club ' || away_team as away_team, home_goals, true as is_played from (select *, row_number() over (partition by date, home_team, away_team order by match_id) as n from matches where home_goals is not null and away_goals is not null and match_id % 4 <> 1) where n = 1 union all select m.date, 'club ' || m.home_team, 'club ' || m.away_team, 5, true from (select distinct date, home_team, away_team from matches where match_id % 4 = 1) m where not exists (select 1 from matches o where o.date = m.date and o.home_team = m.home_team and o.away_team = m.away_team and o.home_goals is not null and o.away_goals is not null and o.match_id % 4 <> 1)")
def append_user_match(m):
    """Rows that a user adds come after those of other files: where both have a match, the user's goes."""
    spark = m.sparkSession
    path = shared_path(spark, "user-league")
    raw = lambda rows, goals: rows.select(F.date_format("date", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("club "), "home_team").alias("HomeTeam"), F.concat(F.lit("club "), "away_team").alias("AwayTeam"), goals.alias("FTHG"), F.lit(1).alias("FTAG"))
    played = m.where("home_goals is not null and away_goals is not null and match_id % 4 <> 1")
    files.write_csv(raw(played.repartitionByRange(3, "match_id").sortWithinPartitions("match_id"), F.col("home_goals")), path)
    files.append_user_match(spark, path, raw(m.where("match_id % 4 = 1"), F.lit(5)))
    files.append_user_match(spark, path, raw(m.where("match_id % 4 = 1"), F.lit(6)))
    return files.load_league(spark, f"{path}/*.csv").select("date", "home_team", "away_team", "home_goals", "is_played")


_LINE = "match_id || ';' || home_team || ';' || away_team"


@query(f"select league || '-' || year(date) as name, cast(sum(strlen({_LINE}) + 1) as bigint) as size, sha1(string_agg({_LINE} || chr(10), '' order by match_id)) as sha1 from matches group by league, year(date)")
def data_fingerprint(m):
    """A file of each league and year, told apart by size and digest."""
    spark = m.sparkSession
    path = shared_path(spark, "fingerprints")
    rows = m.select(F.concat_ws("-", "league", F.year("date")).alias("name"), F.concat_ws(";", "match_id", "home_team", "away_team").alias("value"), "match_id")
    rows.repartition("name").sortWithinPartitions("name", "match_id").select("name", "value").write.partitionBy("name").text(path)
    return files.fingerprints(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"), "size", "sha1")


@query("select match_id, sha1('{\"a\":' || match_id || ',\"b\":\"x' || league || '\"}') as key from matches")
def request_keys(m):
    return m.select("match_id", files.request_key(F.col("match_id").alias("a"), F.concat(F.lit("x"), "league").alias("b")).alias("key"))


@query(
    """, r as (select unnest(['home_shots is negative or no number', 'home_reds is not 0 or 1', 'tier is not allowed', 'name is empty', 'available after kick-off', 'starter and substitute']) as rule, unnest([0, 1, 2, 3, 4, 5]) as k)
 select rule, case k when 0 then (select count(*) from matches where home_corners - 2 < 0) when 1 then (select count(*) from matches where home_yellows not in (0, 1)) when 2 then (select count(*) from matches where match_id % 6 = 5) when 3 then (select count(*) from matches where match_id % 9 = 0)
   when 4 then (select count(*) from matches where match_id % 13 = 0) else (select count(*) from matches where match_id % 4 = 3) end as n from r"""
)
def validation_violations(m):
    rows = m.selectExpr("match_id", "home_corners - 2 as home_shots", "home_yellows as home_reds", "case match_id % 6 when 0 then 'key' when 5 then 'superstar' else ' Bench ' end as tier", "case when match_id % 9 = 0 then '  ' else 'n' end as name", "cast(date as timestamp) as kickoff", "cast(date as timestamp) + case when match_id % 13 = 0 then interval 1 hour else interval -1 hour end as known", "cast(match_id % 4 >= 2 as int) as starter", "cast(match_id % 2 = 1 as int) as sub")
    rules = V.not_negative("home_shots") | V.binary("home_reds") | V.allowed("tier", ("key", "rotation", "bench", "unknown")) | V.not_empty("name") | V.available_in_time("known", "kickoff") | V.one_role("starter", "sub")
    return V.violations(rows, rules)


@query("select league, home_team, away_team, count(*) as n from matches group by all having count(*) > 1")
def duplicate_keys(m):
    return V.duplicates(V.require_columns(m, ["league", "home_team"]), ["league", "home_team", "away_team"])


@query("select match_id, home_xg, 0.0::double as bonus from matches where home_xg is not null")
def validated_table(m):
    rows = V.ensure_columns(m.where("home_xg is not null"), {"bonus": F.lit(0.0), "home_xg": F.lit(9.0)})
    return V.checked(rows, V.not_negative("home_xg") | V.not_empty("match_id"), ["match_id"]).select("match_id", "home_xg", "bonus")


@query("select match_id, round(1 / (1 + exp(-(home_corners / 4 - 1))), 6) as sigmoid, round(ln(greatest(least(home_corners / 10, 1 - 1e-12), 1e-12) / (1 - greatest(least(home_corners / 10, 1 - 1e-12), 1e-12))), 6) as logit, greatest(least(home_corners / 8 - 0.2, 1), 0) as clipped, home_corners - away_corners = 0 as close from matches")
def math_scalars(m):
    near = is_close(F.col("home_corners"), F.col("away_corners") + 1e-9)
    return m.select("match_id", F.round(sigmoid(F.col("home_corners") / 4 - 1), 6).alias("sigmoid"), F.round(safe_logit(F.col("home_corners") / 10), 6).alias("logit"), clip01(F.col("home_corners") / 8 - 0.2).alias("clipped"), near.alias("close"))


@table_query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as int)) as bigint) as k from events group by event_type")
def event_props_extract(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("int")).alias("k"))


@table_query("select vec_id, round(list_sum(embedding::double[]), 4) as total, round(sqrt(list_sum([x * x for x in embedding::double[]])), 4) as norm, len(embedding)::int as n from embeddings")
def array_scalars(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(total(e), 4).alias("total"), F.round(F.sqrt(total(F.transform(e, lambda x: x * x))), 4).alias("norm"), F.size("embedding").alias("n"))


@table_query("select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_daily_counts(spark, sf_dir):
    counted = replay.ended(replay.daily_counts(replay.events_stream(spark, sf_dir)), "complete", "daily-counts")
    return counted.select("day", "event_type", "n", F.round("total", 4).alias("total"))


@table_query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id")
def stream_running_totals(spark, sf_dir):
    after = replay.ended(replay.running_totals(replay.events_stream(spark, sf_dir)), "append", "running-totals")
    return r6(after.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("s")).select("user_id", "s.n", F.round("s.total", 4).alias("total")))


_LATE = "match_id % 97 = 0 and month(date) <= 9 and year(date) < 1998"
_IN_TIME = f"home_goals is not null and away_goals is not null and not ({_LATE})"


@query(elo_sql(50.0, 80.0, True, _IN_TIME) + f"select match_id, date, round(home_elo, 6) as home_elo, round(away_elo, 6) as away_elo, false as is_late from rated join matches using (match_id) union all select match_id, date, null, null, true from matches where home_goals is not null and away_goals is not null and {_LATE}")
def streaming_ratings(m):
    """Matches in a file a year, one file a batch, some of them a year late, and at the end rows that only move time on."""
    spark, folder = m.sparkSession, shared_path(m.sparkSession, "match-stream")
    columns = ["match_id", "league", "date", "home_team", "away_team", "home_goals", "away_goals"]
    once = stored(m.where("home_goals is not null and away_goals is not null").select(*columns, F.expr(f"year(date) + int({_LATE})").alias("arrives")), "matches")
    for year in range(*once.agg(F.min("arrives"), F.max("arrives") + 1).first()):
        once.where(F.col("arrives") == year).select(*columns).coalesce(1).write.mode("append").parquet(folder)
    tick = once.agg(F.date_add(F.max("date"), 90).alias("date")).select(*[F.col(c) if c == "date" else F.lit(None).cast(t).alias(c) for c, t in once.select(*columns).dtypes])
    for _ in range(2):  # the first moves the watermark on, the second sets off a batch that sees it
        tick.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(once.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = replay.ended(ratings_stream.rated_stream(stream), "append", "rated-stream", {ratings_stream.STATE_STORE: ratings_stream.ROCKS_DB})
    return r6(out.select("match_id", "date", "home_elo", "away_elo", "is_late"))
