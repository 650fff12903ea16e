"""Value betting: the ledger of single bets, and reports over it.

Rows are independent of each other (no bankroll is carried), so the ledger is a projection and a filter, and
every report is one aggregation over grouping sets.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import bucket, finite, first_max, season_label
from touchline.functions.odds import LEAST_ODDS, Triplet

#: Cuts of the reports' buckets.
ODDS_CUTS = [1.0, 1.5, 2.0, 3.0, 5.0, 10.0]
EDGE_CUTS = [float("-inf"), 0.025, 0.05, 0.075, 0.1, 0.15, float("inf")]
CONFIDENCE_CUTS = [0.0, 0.35, 0.45, 0.55, 0.65, 1.0]
#: The grid of the selector.
EDGES = (0.0, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15)
LEAST_PROBS = (0.0, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55)
ODDS_BANDS = ((1.01, 10.0), (1.01, 2.0), (1.5, 3.0), (1.8, 4.0), (2.0, 5.0), (3.0, 10.0))


def ledger(rows: DataFrame, probs: Triplet, odds: Triplet, opening: Triplet, closing: Triplet, edge: float = 0.05, max_odds: float = 10.0, max_ev: float = 1.0, fraction: float = 0.25, max_stake: float = 0.05, min_stake: float = 0.001) -> DataFrame:
    """``rows`` with a bet, and: pick, bet_odds, bet_prob, ev, stake, won, profit, clv.

    The pick is the outcome of most expected value, of equal ones the first. A match is skipped if an odd is missing,
    or if the pick's odds or value are beyond the most allowed or its value not above ``edge``. ``y`` must be a column: the
    outcome 0, 1, 2.
    """
    o = [finite(x) for x in odds]
    named = rows.where(o[0].isNotNull() & o[1].isNotNull() & o[2].isNotNull() & F.col("y").isNotNull())
    # The greatest of three structs: most value, of equal ones the first outcome; its fields are read once.
    each = [F.struct((p * x - 1.0).alias("ev"), F.lit(-k).alias("order"), x.alias("odds"), p.alias("prob"), finite(a).alias("open"), finite(b).alias("close")) for k, (p, x, a, b) in enumerate(zip(probs, o, opening, closing))]
    # Generated, so that no filter below is pushed to where the struct would be made again for each of its fields.
    named = named.select("*", F.explode(F.array(F.greatest(*each))).alias("__bet"))
    bet = lambda field: F.col(f"__bet.{field}")
    named = named.withColumn("stake", F.least(bet("ev") / (bet("odds") - 1.0) * fraction, F.lit(max_stake)))
    named = named.where((bet("odds") <= max_odds) & (bet("ev") <= max_ev) & (bet("ev") > edge) & (F.col("stake") >= min_stake))
    won = -bet("order") == F.col("y")
    profit = F.when(won, F.col("stake") * (bet("odds") - 1.0)).otherwise(-F.col("stake"))
    clv = F.when((bet("close") > LEAST_ODDS) & bet("open").isNotNull(), bet("open") / bet("close") - 1.0)
    return named.withColumns({"pick": -bet("order"), "bet_odds": bet("odds"), "bet_prob": bet("prob"), "ev": bet("ev"), "won": won.cast("int"), "profit": profit, "clv": clv}).drop("__bet")


def binary_bets(rows: DataFrame, prob: Column, over_odds: Column, under_odds: Column, result: Column, edge: float = 0.05, max_odds: float = 10.0) -> DataFrame:
    """Bets on one of two outcomes: side (0 over, 1 under), bet_odds, ev, profit of one unit."""
    a, b = finite(over_odds), finite(under_odds)
    named = rows.where(a.isNotNull() & b.isNotNull() & prob.isNotNull() & result.isNotNull())
    ev = [prob * a - 1.0, (1.0 - prob) * b - 1.0]
    named = named.withColumn("side", first_max(*ev)).withColumns({"bet_odds": F.when(F.col("side") == 0, a).otherwise(b), "ev": F.when(F.col("side") == 0, ev[0]).otherwise(ev[1])})
    named = named.where((F.col("bet_odds") <= max_odds) & (F.col("ev") > edge))
    won = (F.col("side") == 0) == result
    return named.withColumn("profit", F.when(won, F.col("bet_odds") - 1.0).otherwise(-1.0))


def summary_columns() -> list[Column]:
    """Totals of a group of bets, rounded as in the reports; 0 where a ratio has no base."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("bets"),
        F.sum("won").cast("long").alias("wins"),
        F.round(F.sum("stake"), 4).alias("stake"),
        F.round(F.sum("profit"), 4).alias("profit"),
        F.round(100 * ratio(F.sum("profit"), F.sum("stake")), 4).alias("roi"),
        F.round(100 * F.avg(F.col("won").cast("double")), 4).alias("hit_rate"),
        F.round(F.avg("bet_odds"), 4).alias("avg_odds"),
        F.round(F.avg("clv"), 4).alias("avg_clv"),
    ]


def slices(bets: DataFrame) -> DataFrame:
    """Totals of all bets, by league, by season and by both."""
    labelled = bets.withColumn("season", season_label("date"))
    sets = [[], [F.col("league")], [F.col("season")], [F.col("league"), F.col("season")]]
    grouped = labelled.groupingSets(sets, "league", "season").agg(F.grouping_id().alias("g"), *summary_columns())
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "league").when(F.col("g") == 2, "season").otherwise("league_season")
    return grouped.select(kind.alias("slice"), "league", "season", *[c for c in grouped.columns if c not in ("g", "league", "season")])


def buckets(bets: DataFrame) -> DataFrame:
    """Totals by league, pick, odds, edge and confidence, each by itself, and of all."""
    labels = {"league": F.col("league").cast("string"), "pick": F.col("pick").cast("string"), "odds": bucket("bet_odds", ODDS_CUTS), "edge": bucket("ev", EDGE_CUTS), "confidence": bucket("bet_prob", CONFIDENCE_CUTS)}
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("label")), *[F.struct(F.lit(k).alias("kind"), v.alias("label")) for k, v in labels.items()])
    spread = bets.withColumn("b", F.explode(kinds)).where("b.label is not null")
    return spread.groupBy(F.col("b.kind").alias("kind"), F.col("b.label").alias("label")).agg(*summary_columns())


def curve(bets: DataFrame) -> DataFrame:
    """Running profit and return in the order of dates and ids: match_id, bet_number, cum_profit, cum_roi.

    Days are summed first, so the window over all of them has one row a day; within a day it is one more.
    """
    by_day = bets.groupBy("date").agg(F.sum("profit").alias("dp"), F.sum("stake").alias("ds"), F.count(F.lit(1)).alias("dn"))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_day.select("date", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"s{c}") for c in ("dp", "ds", "dn")])
    within = Window.partitionBy("date").orderBy("match_id").rowsBetween(Window.unboundedPreceding, 0)
    run = bets.join(starts, "date").select("match_id", (F.col("sdn") + F.row_number().over(Window.partitionBy("date").orderBy("match_id"))).alias("bet_number"), (F.col("sdp") + F.sum("profit").over(within)).alias("cum_profit"), (F.col("sds") + F.sum("stake").over(within)).alias("cum_stake"))
    return run.select("match_id", "bet_number", "cum_profit", (F.col("cum_profit") / F.col("cum_stake")).alias("cum_roi"))


def grid(spark) -> DataFrame:
    """The selector's cells: cell (their order), edge, least_prob, low, high. 336 rows."""
    cells = [(k, e, p, lo, hi) for k, (e, p, (lo, hi)) in enumerate(product(EDGES, LEAST_PROBS, ODDS_BANDS))]
    return spark.createDataFrame(cells, "cell int, edge double, least_prob double, low double, high double")


def select_cell(bets: DataFrame, folds: int = 2, least_bets: int = 50, least_fold: int = 10) -> DataFrame:
    """Totals of each cell of the grid over the bets it admits, and whether the cell passes: enough bets, profit
    overall and in each fold. ``bets`` has a column ``fold`` (1..folds).

    Bets are summed by what of the grid's values they reach, a few thousand groups at most, before they meet the cells.
    """
    reached = lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests])
    bands = reached([((F.col("bet_odds") >= lo) & (F.col("bet_odds") <= hi)).cast("int") * (1 << k) for k, (lo, hi) in enumerate(ODDS_BANDS)])
    kinds = {"__e": reached([F.col("ev") > x for x in EDGES]), "__p": reached([F.col("bet_prob") >= x for x in LEAST_PROBS]), "__o": bands}
    groups = bets.groupBy("fold", *[c.alias(n) for n, c in kinds.items()]).agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p"), F.sum("stake").alias("s"))
    cells = F.broadcast(grid(bets.sparkSession))  # 336 rows
    at = F.col("cell")
    n_p, n_o = len(LEAST_PROBS), len(ODDS_BANDS)
    edge, prob = F.floor(at / (n_p * n_o)), F.floor(at / n_o) % n_p
    admitted = groups.join(cells, (F.col("__e") > edge) & (F.col("__p") > prob) & (F.expr(f"shiftright(__o, cell % {n_o})").bitwiseAND(1) == 1))
    per_fold = admitted.groupBy("cell", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"))
    good = F.sum(F.when((F.col("n") >= least_fold) & (F.col("p") > 0), 1).otherwise(0))
    per_cell = per_fold.groupBy("cell").agg(F.sum("n").alias("bets"), F.sum("p").alias("profit"), (F.sum("p") / F.sum("s")).alias("roi"), good.alias("good_folds"))
    return per_cell.withColumn("passes", (F.col("bets") >= least_bets) & (F.col("roi") > 0) & (F.col("good_folds") == folds))


def chrono_fold(rows: DataFrame, folds: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``fold`` (1..folds): equal parts in the order of date and match_id, the first ones larger by one;
    of all rows, or of those with equal ``by``.

    Days are counted first, so the window over all of them has one row a day; within a day it is one more.
    """
    by_day = rows.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("__dn"))
    everything = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
    starts = by_day.select(*by, "date", F.coalesce(F.sum("__dn").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__dn").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    at = F.col("__start") + F.row_number().over(Window.partitionBy(*by, "date").orderBy("match_id")) - 1
    size, larger = F.floor(F.col("__all") / folds), F.col("__all") % folds
    cut = larger * (size + 1)
    # In the parts of size + 1, then in those of size.
    fold = F.when(F.col("__at") < cut, F.floor(F.col("__at") / (size + 1))).otherwise(larger + F.floor(F.try_divide(F.col("__at") - cut, size)))
    numbered = rows.join(starts, [*by, "date"]).withColumn("__at", at)
    return numbered.withColumn("fold", (fold + 1).cast("int")).drop("__start", "__all", "__at")


def half_split(rows: DataFrame) -> DataFrame:
    """``rows`` with ``half``: early for the first floor(n / 2) in the order of date and match_id, else late."""
    by_day = rows.groupBy("date").agg(F.count(F.lit(1)).alias("__dn"))
    before = F.coalesce(F.sum("__dn").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_day.select("date", before.alias("__start"), F.sum("__dn").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))  # a row a day
    at = F.col("__start") + F.row_number().over(Window.partitionBy("date").orderBy("match_id"))
    early = at <= F.floor(F.col("__all") / 2)
    return rows.join(starts, "date").withColumn("half", F.when(early, "early").otherwise("late")).drop("__start", "__all")


def backtest_windows(matches: DataFrame, windows: dict[str, tuple[str, str]], played: str) -> DataFrame:
    """How many matches, and how many played, each window of days has; both ends count."""
    within = F.filter(F.array(*[F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in windows.items()]), lambda w: (F.col("date") >= w["a"]) & (F.col("date") <= w["b"]))
    counted = matches.select(F.explode(within).alias("w"), F.expr(played).alias("played")).groupBy("w.period").agg(F.count(F.lit(1)).alias("n"), F.count_if("played").alias("n_played"))
    return counted.select("period", "n", "n_played")


#: The cell taken when none passes: edge 0.05, any probability, all odds.
FALLBACK = EDGES.index(0.05) * len(LEAST_PROBS) * len(ODDS_BANDS)


def choose_cell(validation: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the cell of most return, profit and bets among those that pass on ``validation`` (bets with
    ``fold``), else the fallback, with its totals on validation and on ``test``."""
    cells = grid(validation.sparkSession)
    rated = select_cell(validation)
    order = [F.col("passes").desc(), F.when(F.col("passes"), F.col("roi")).desc(), F.when(F.col("passes"), F.col("profit")).desc(), F.when(F.col("passes"), F.col("bets")).desc(), (F.col("cell") != FALLBACK).asc(), F.col("cell").asc()]
    known = cells.join(rated, "cell", "left").withColumns({"passes": F.coalesce("passes", F.lit(False)), "bets": F.coalesce("bets", F.lit(0)), "profit": F.coalesce("profit", F.lit(0.0)), "roi": F.coalesce("roi", F.lit(0.0))})
    eligible = known.agg(F.count_if("passes").alias("eligible"))
    chosen = known.orderBy(*order).limit(1).crossJoin(eligible)  # one row each
    c = chosen.select("cell", "edge", "least_prob", "low", "high", F.col("passes").alias("robust"), "eligible", F.col("bets").alias("val_bets"), F.col("profit").alias("val_profit"), F.col("roi").alias("val_roi"))
    admitted = (F.col("ev") > F.col("edge")) & (F.col("bet_prob") >= F.col("least_prob")) & (F.col("bet_odds") >= F.col("low")) & (F.col("bet_odds") <= F.col("high"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    reported = c.join(test.select("ev", "bet_prob", "bet_odds", "won", "profit", "stake"), admitted, "left").groupBy(*c.columns)
    return reported.agg(F.count("stake").alias("test_bets"), F.coalesce(F.sum("won"), F.lit(0)).cast("long").alias("test_wins"), zero(F.sum("profit")).alias("test_profit"), zero(F.try_divide(F.sum("profit"), F.sum("stake"))).alias("test_roi"))
