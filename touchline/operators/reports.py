"""Reports over models, bets and what is known: each one aggregation, with the rules that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import finite, first_max
from touchline.functions.odds import LEGS, Triplet, given, legs, probability_of
from touchline.operators import metrics
from touchline.operators.betting import chrono_fold, ledger, summary_columns


def by_model(rows: DataFrame, models: dict[str, Triplet]) -> DataFrame:
    """``rows`` once for each model, with ``model`` and its p_home, p_draw, p_away."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), *[p.alias(f"p_{leg}") for p, leg in zip(probs, LEGS)]) for n, probs in models.items()]))
    return rows.withColumn("__m", each).select("*", "__m.*").drop("__m")


def quality(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Per ``keys`` of rows with p_home, p_draw, p_away: how many, log loss, Brier score, accuracy, mean confidence, the
    calibration error over ten bins, and of each outcome the mean probability, rate, share of picks, precision, recall
    and F1."""
    p = [F.col(f"p_{leg}") for leg in LEGS]
    scored = rows.where(F.col(y).isNotNull() & p[0].isNotNull()).withColumns({"__pick": first_max(*p), "__conf": F.greatest(*p)})
    scored = scored.withColumns({"__hit": (F.col("__pick") == F.col(y)).cast("double"), "__bin": F.least(F.floor(F.col("__conf") * 10), F.lit(9))})
    per_bin = scored.groupBy(*keys, "__bin").agg(F.sum("__conf").alias("c"), F.sum("__hit").alias("h"), F.count(F.lit(1)).alias("n"))
    ece = per_bin.groupBy(*keys).agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))
    count = lambda test: F.count_if(test)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class: list[Column] = []
    for k, leg in enumerate(LEGS):
        picked, true = F.col("__pick") == k, F.col(y) == k
        hit = count(picked & true)
        per_class += [F.avg(p[k]).alias(f"mean_{leg}"), F.avg(true.cast("double")).alias(f"rate_{leg}"), F.avg(picked.cast("double")).alias(f"pick_{leg}")]
        per_class += [ratio(hit, count(picked)).alias(f"precision_{leg}"), ratio(hit, count(true)).alias(f"recall_{leg}"), ratio(2 * hit, count(picked) + count(true)).alias(f"f1_{leg}")]
    out = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), metrics.log_loss(p, y).alias("log_loss"), metrics.brier(p, y).alias("brier"), F.avg("__hit").alias("accuracy"), F.avg("__conf").alias("confidence"), *per_class)
    return out.join(ece, keys).withColumn("macro_f1", (F.col("f1_home") + F.col("f1_draw") + F.col("f1_away")) / 3)


def model_summary(matches: DataFrame, rows: DataFrame, bets: DataFrame, models: dict[str, Triplet], betting: str, validation: str, test: str) -> DataFrame:
    """A row a model for ``model_gates``: log loss on ``test``; the bets are those of the model ``betting``."""
    tested = rows.where(test)
    losses = tested.agg(*[metrics.log_loss(p).alias(n) for n, p in models.items()])
    roi = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("profit"))) / F.sum(F.when(F.expr(c), F.col("stake"))), F.lit(0.0))
    totals = bets.agg(roi(validation).alias("v"), F.count_if(F.expr(test)).alias("n"), roi(test).alias("t"))
    own = lambda n, c, zero: (F.col(c) if n == betting else F.lit(zero))
    each = F.array(*[F.struct(F.lit(n).alias("model"), own(n, "v", 0.0).alias("val_roi"), F.col(n).alias("test_log_loss"), own(n, "n", 0).cast("long").alias("test_bets"), own(n, "t", 0.0).alias("test_roi")) for n in models])
    return losses.crossJoin(totals).select(F.inline(each))  # one row each


def model_gates(summary: DataFrame, market: str, most_gap: float = 0.01) -> DataFrame:
    """``summary`` (model, val_roi, test_log_loss, test_bets, test_roi) with ``recommended``: a return above 0 in
    validation, a log loss at most ``most_gap`` above the market's, and a bet in the test; and ``rank`` among those by
    log loss."""
    base = summary.where(F.col("model") == market).select(F.col("test_log_loss").alias("__market"))
    ok = (F.col("val_roi") > 0) & (F.col("test_log_loss") - F.col("__market") <= most_gap) & (F.col("test_bets") > 0)
    gated = summary.crossJoin(F.broadcast(base)).withColumn("recommended", ok).drop("__market")  # one row
    rank = F.row_number().over(Window.partitionBy("recommended").orderBy("test_log_loss", "model"))  # a row a model
    return gated.withColumn("rank", F.when(F.col("recommended"), rank))


def profit_profile(bets: DataFrame) -> DataFrame:
    """One row: bets, sum, mean, median and greatest profit."""
    return bets.agg(F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("total"), F.avg("profit").alias("mean"), F.median("profit").alias("median"), F.max("profit").alias("most"))


def top_and_bottom(bets: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` bets of most and of least profit: side, rank, match_id, profit; of equal ones the smaller id."""
    ends = []
    for side, order in (("top", F.desc("profit")), ("bottom", F.asc("profit"))):
        chosen = bets.select("match_id", "profit").orderBy(order, "match_id").limit(k)
        ends.append(chosen.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, "match_id")).alias("rank"), "match_id", "profit"))  # k rows
    return ends[0].unionByName(ends[1])


def segments(bets: DataFrame) -> DataFrame:
    """Totals of all bets and of each pick."""
    grouped = bets.groupingSets([[], [F.col("pick")]], "pick").agg(F.grouping_id().alias("__g"), *summary_columns())
    name = F.when(F.col("__g") == 1, "all").when(F.col("pick") == 0, LEGS[0]).when(F.col("pick") == 1, LEGS[1]).otherwise(LEGS[2])
    return grouped.withColumn("segment", name).drop("__g", "pick")


def candidates(bets: DataFrame, least_prob: float, least_odds: float, most_odds: float) -> DataFrame:
    """Bets of a least probability within bounds of the odds."""
    return bets.where((F.col("bet_prob") >= least_prob) & (F.col("bet_odds") >= least_odds) & (F.col("bet_odds") <= most_odds))


def parameter_impact(rows: DataFrame, base: Triplet, changed: Triplet, y: str = "y") -> DataFrame:
    """One row: mean distance of the probabilities and by how much the log loss falls."""
    distance = (F.abs(base[0] - changed[0]) + F.abs(base[1] - changed[1]) + F.abs(base[2] - changed[2])) / 3.0
    return rows.where(F.col(y).isNotNull()).agg(F.avg(distance).alias("mean_diff"), (metrics.log_loss(base, y) - metrics.log_loss(changed, y)).alias("gain"))


def enrichment_coverage(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Per split and group of columns how many rows have it: split, group, n, covered, share."""
    counted = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"__{g}") for g, c in groups.items()])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"__{g}").alias("covered")) for g in groups]))
    return counted.withColumn("g", each).select("split", "g.group", "n", "g.covered", (F.col("g.covered") / F.col("n")).alias("share"))


def any_known(*columns: str) -> Column:
    return F.coalesce(*[finite(c) for c in columns]).isNotNull()


def alternative_markets(rows: DataFrame, model: Triplet, edge: float = 0.05) -> DataFrame:
    """Bets of one unit on double chance and draw no bet, at odds made from the three legs: market, bets, wins, pushes,
    profit, roi. A push gives the stake back."""
    o = [finite(x) for x in legs("open_odds")]
    join = lambda a, b: 1.0 / (1.0 / a + 1.0 / b)
    each = []
    for name, k, j in (("double_chance_home", 0, 1), ("double_chance_away", 2, 1), ("double_chance_either", 0, 2)):
        each.append(F.struct(F.lit(name).alias("market"), (model[k] + model[j]).alias("p"), join(o[k], o[j]).alias("odds"), F.col("y").isin(k, j).alias("won"), F.lit(False).alias("push")))
    for name, k, other in (("draw_no_bet_home", 0, 2), ("draw_no_bet_away", 2, 0)):
        each.append(F.struct(F.lit(name).alias("market"), (model[k] / (model[k] + model[other])).alias("p"), (o[k] * (1.0 - 1.0 / o[1])).alias("odds"), (F.col("y") == k).alias("won"), (F.col("y") == 1).alias("push")))
    priced = rows.where(given(legs("open_odds")) & F.col("y").isNotNull())
    bets = priced.select(F.explode(F.array(*each)).alias("b")).select("b.*").where((F.col("odds") > 1) & (F.col("p") * F.col("odds") - 1 > edge))
    profit = F.when(F.col("push"), 0.0).when(F.col("won"), F.col("odds") - 1).otherwise(-1.0)
    return bets.withColumn("profit", profit).groupBy("market").agg(F.count(F.lit(1)).alias("bets"), F.count_if(F.col("won") & ~F.col("push")).alias("wins"), F.count_if("push").alias("pushes"), F.sum("profit").alias("profit"), F.avg("profit").alias("roi"))


def league_strategy(rows: DataFrame, models: dict[str, Triplet], market: Triplet, odds: Triplet, closing: Triplet, least_bets: int = 20, most_gap: float = 0.01) -> DataFrame:
    """Per league the model to bet by: of those whose log loss is at most ``most_gap`` above the market's, that make
    enough bets and earn in both halves of the time, the one of most return; ``market`` where none does. ``rows`` have y."""
    timed = chrono_fold(rows, by=("league",))
    scored = by_model(timed, models)
    loss = lambda probs: -F.ln(F.greatest(probability_of(probs, "y"), F.lit(metrics.EPS)))
    p = [F.col(f"p_{leg}") for leg in LEGS]
    losses = scored.groupBy("league", "model").agg((F.avg(loss(p)) - F.avg(loss(market))).alias("gap"))
    bets = ledger(scored, p, odds, odds, closing)
    halves = bets.groupBy("league", "model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p"), F.sum("stake").alias("s"))
    totals = halves.groupBy("league", "model").agg(F.sum("n").alias("bets"), F.sum("p").alias("profit"), (F.sum("p") / F.sum("s")).alias("roi"), F.count_if(F.col("p") > 0).alias("good"))
    passing = totals.join(losses, ["league", "model"]).where((F.col("gap") <= most_gap) & (F.col("bets") >= least_bets) & (F.col("good") == 2) & (F.col("roi") > 0))
    best = passing.groupBy("league").agg(F.max_by(F.struct("model", "bets", "profit", "roi"), F.struct("roi", "profit", "bets", "model")).alias("b")).select("league", "b.*")
    return rows.select("league").distinct().join(best, "league", "left").select("league", F.coalesce("model", F.lit("market")).alias("model"), F.coalesce("bets", F.lit(0)).cast("long").alias("bets"), F.coalesce("profit", F.lit(0.0)).alias("profit"), F.coalesce("roi", F.lit(0.0)).alias("roi"))


def strategies(bets: DataFrame, edges: dict[str, float]) -> DataFrame:
    """Totals of the bets whose value is above each strategy's edge: strategy, and the totals."""
    taken = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("edge")) for n, e in edges.items()]), lambda s: F.col("ev") > s["edge"])
    return bets.withColumn("s", F.explode(taken)).groupBy(F.col("s.name").alias("strategy")).agg(*summary_columns())


def report_rows(summary: DataFrame, order: list[str], number: str, digits: int = 3) -> DataFrame:
    """Rows of the models named in ``order``, in that order: place, model, and ``number`` as text."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("model"))
    return summary.withColumn("place", place).where("place > 0").select("place", "model", F.format_string(f"%.{digits}f", number).alias("value"))
