"""Reading and writing of match files: leagues of CSV files, optional tables, appended rows whose columns may grow."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import odds as O  # noqa: N812
from touchline.functions.columns import alias_of, finite, number, parse_date, squeeze
from touchline.operators.joining import keep_first

#: A provider's columns. A league's file must have the first; of the others, those that it has are read.
REQUIRED = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG")
STATISTICS = {
    "HS": "home_shots", "AS": "away_shots", "HST": "home_shots_target", "AST": "away_shots_target", "HC": "home_corners", "AC": "away_corners",
    "HY": "home_yellows", "AY": "away_yellows", "HR": "home_reds", "AR": "away_reds", "HF": "home_fouls", "AF": "away_fouls",
}
CLOSING, AVERAGE_OPENING, AVERAGE_CLOSING = ("PSCH", "PSCD", "PSCA"), ("AvgH", "AvgD", "AvgA"), ("AvgCH", "AvgCD", "AvgCA")
BOOKS = tuple((f"{book}H", f"{book}D", f"{book}A") for book in ("B365", "BW", "GB", "IW", "LB", "PS", "WH", "SJ", "VC", "BS"))
TOTALS = tuple((f"{source}>2.5", f"{source}<2.5") for source in ("AvgC", "Avg", "B365C", "B365"))
HANDICAPS = ("AHCh", "AHh")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any file is at ``path``, asked of the path's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


def read_optional(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header as texts cast to ``schema``; an empty table of that schema where there is none."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], wanted)
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    cast = lambda f: (F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
    return raw.select(*[cast(f) for f in wanted])


def file_headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(columns, the paths of the files that have just these) for each different header of the CSV files at ``path``.

    A header is a file's first line. Its names are stripped of white space and of a byte order mark; an empty name
    and one given twice get a name that no table has. The driver gets a row a file, as it lists them anyway.
    """
    first = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = first.where("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("line"))
    one = lambda file: re.sub(r"^(\w+):/+", r"\1:/", unquote(file))
    found = {one(r.file): r.line for r in lines.collect()}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):  # empty files too
        names, seen = next(csv.reader([found.get(one(file), "").removeprefix("\ufeff")]), []), set()
        columns = []
        for k, name in enumerate(names):
            name = name.strip()
            columns.append(f"__unnamed{k}" if not name or name in seen else name)
            seen.add(name)
        groups.setdefault(tuple(columns), []).append(file)
    return [(list(columns), paths) for columns, paths in groups.items()]


def read_by_header(spark: SparkSession, path: str, wanted: Iterable[str], required: Iterable[str] = ()) -> DataFrame:
    """Rows of the CSV files at ``path`` as texts, each file by its own header: the ``wanted`` columns, null where a file has
    none, and __place, the row's file, block and place in it.

    Files of one header are one scan, which reads only the wanted columns. FileNotFoundError without files; ValueError,
    which names the files, where one lacks a column of ``required``. A file without rows gives none.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    wanted, groups = list(wanted), file_headers(spark, path)
    lacking = {tuple(c for c in required if c not in columns): paths for columns, paths in groups}
    if faults := "; ".join(f"{', '.join(p.rsplit('/', 1)[-1] for p in paths)} without {', '.join(names)}" for names, paths in lacking.items() if names):
        raise ValueError(f"missing columns: {faults}")
    parts = []
    for columns, paths in groups:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv([_as_given(p) for p in paths])
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        parts.append(raw.select(*[(F.col(f"`{c}`") if c in columns else F.lit(None).cast("string")).alias(c) for c in wanted], place.alias("__place")))
    return reduce(DataFrame.unionByName, parts)


def _as_given(path: str) -> str:
    """A path from a file's metadata, in which blanks and the like are escaped, as a reader takes it."""
    return unquote(path)


def load_league(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """The matches of a league's CSV files (a folder or pattern), whatever columns each file has: date, home_team, away_team
    (by ``aliases`` where they have one), goals, odds_* (closing odds of one book, else of the mean of all books),
    open_odds_* and close_odds_* (the market's means, else of the books, or of the closing book), ou25_over_prob and odds of
    over and under 2.5 goals, ah_line, statistics, is_played.

    FileNotFoundError without files, ValueError with the file's name where a needed column is missing. Rows without a
    date are left out. Of rows with one date and pair of clubs the first stays, by the path of the file and its
    place in the file. Numbers that are none are null; a match with a goal missing is one not played.
    """
    texts = [*STATISTICS, *CLOSING, *AVERAGE_OPENING, *AVERAGE_CLOSING, *(c for book in BOOKS for c in book), *(c for pair in TOTALS for c in pair), *HANDICAPS]
    raw = read_by_header(spark, path, [*REQUIRED, *texts], REQUIRED)
    team = lambda c: alias_of(squeeze(c), aliases or {})
    value = lambda c: F.col(f"`{c}`")
    triplet = lambda names: [value(c) for c in names]
    goals = {"FTHG": "home_goals", "FTAG": "away_goals"}
    read = raw.select(parse_date("Date").alias("date"), team("HomeTeam").alias("home_team"), team("AwayTeam").alias("away_team"), *[number(value(c)).alias(c) for c in [*goals, *texts]], "__place")
    over = F.struct(*[x.alias(n) for x, n in zip(O.over_under([(value(a), value(b)) for a, b in TOTALS]), ("over_prob", "over_odds", "under_odds"))])
    read = read.withColumns({"__mean": O.mean_of_books([triplet(b) for b in BOOKS]), "__total": over})
    mean = [F.col("__mean")[leg] for leg in O.LEGS]
    chosen = lambda first, second: O.choose(O.given(first), first, second)
    closing = [F.when(O.given(triplet(CLOSING)), x) for x in O.fair_odds(O.fair_probs(triplet(CLOSING)))]
    odds = {"odds": chosen(triplet(CLOSING), mean), "open_odds": chosen(triplet(AVERAGE_OPENING), mean), "close_odds": chosen(triplet(AVERAGE_CLOSING), closing)}
    rows = read.select(
        "date", "home_team", "away_team", *[value(c).alias(n) for c, n in goals.items()], *[x.alias(f"{name}_{leg}") for name, three in odds.items() for x, leg in zip(three, O.LEGS)],
        *[F.col("__total")[n].alias(f"ou25_{n}") for n in ("over_prob", "over_odds", "under_odds")], O.first_line(*[value(c) for c in HANDICAPS]).alias("ah_line"), *[value(c).alias(n) for c, n in STATISTICS.items()], "__place",
    )
    rows = rows.where("date is not null").withColumn("is_played", F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    return keep_first(rows, ["date", "home_team", "away_team"], "__place").drop("__place")


def append_user_match(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Adds CSV rows (Date, HomeTeam, AwayTeam and what else they have) to a league's folder, in files whose names come after
    all others, so that a match that other files have stays as it is there."""
    n = len([f for f in file_headers(spark, f"{folder}/*.csv") for _ in f[1]]) if _exists(spark, f"{folder}/*.csv") else 0
    staged = f"{folder}/_adding"
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(staged)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, part in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/part-*"))):
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/zz_user_added_{n:06d}_{k}.csv"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a Parquet table; columns new to it are null in its older rows, and those it has are null in the new ones."""
    df.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def latest_run(rows: DataFrame, column: str = "run_ts_utc") -> DataFrame:
    """The rows of the latest run."""
    last = rows.agg(F.max(column).alias("__last"))
    return rows.join(F.broadcast(last), F.col(column) == F.col("__last"), "left_semi")  # one row


def standard_fixtures(raw: DataFrame, date: str, home: str, away: str, result: str) -> DataFrame:
    """From a provider's fixtures those not played: Date as dd/MM/yyyy, clubs, and empty goals and odds."""
    score = F.regexp_extract(F.coalesce(F.col(result), F.lit("")), r"(\d+)\s*-\s*(\d+)", 0)
    none = lambda n: F.lit(None).cast("double").alias(n)
    return raw.where(score == "").select(F.date_format(date, "dd/MM/yyyy").alias("Date"), squeeze(home).alias("HomeTeam"), squeeze(away).alias("AwayTeam"), *[none(c) for c in ("FTHG", "FTAG", "PSCH", "PSCD", "PSCA")])


def locations(raw: DataFrame) -> DataFrame:
    """Places of clubs with both coordinates; of repeated ones the last in the order of ``place``."""
    rows = raw.select("league", squeeze("team").alias("team"), finite(F.col("latitude").cast("string").try_cast("double")).alias("latitude"), finite(F.col("longitude").cast("string").try_cast("double")).alias("longitude"), "place")
    return keep_first(rows.where("latitude is not null and longitude is not null"), ["league", "team"], "place", last=True).drop("place")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size and SHA-1 of each file at ``path``."""
    held = spark.read.format("binaryFile").load(path)
    return held.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha1("content").alias("sha1"))


def request_key(*parts: Column) -> Column:
    """A cache's key of a request: SHA-1 of its parts as JSON."""
    return F.sha1(F.to_json(F.struct(*parts)))
