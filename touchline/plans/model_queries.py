"""Queries that fit models. Their outcome depends on solvers, so most have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import odds as O  # noqa: N812
from touchline.functions.context import fill_context
from touchline.operators import asof, betting, feature_sets, metrics, models, prematch
from touchline.plans.prematch_queries import _context
from touchline.plans.queries import HIST_ALL, STEPS, TEST, VALIDATION, query, r6
from touchline.sources.fixture_sql import MORE_COLUMNS
from touchline.sources.shared import stored

EVERY = feature_sets.EVERY


def _vectors(m):
    """Played matches with a market: y and the 89 features, written once."""
    block = prematch.matchday_block(m.selectExpr("*", *MORE_COLUMNS), fill_context(_context(m)))
    rows = feature_sets.with_logits(block).where("y is not null and market_home is not null and (" + VALIDATION + " or " + TEST + ")")
    return stored(rows.select("match_id", "date", "y", *[f"market_{leg}" for leg in O.LEGS], *EVERY), "vectors")


#: Rows that a task of a fit has: a fit is hundreds of jobs over the same rows, so a task for fewer takes longer to start than to run.
PER_TASK = 50_000


def _packed(rows, n):
    """``rows`` (``n`` of them) kept in as many partitions as they fill."""
    held = rows.repartition(max(-(-n // PER_TASK), 1), "match_id").cache()
    held.count()  # kept once, before several fits ask for it
    return held


def _halves(rows):
    season = rows.where(VALIDATION)
    halved = _packed(betting.half_split(season), season.count())
    return halved.where("half = 'early'").drop("half"), halved.where("half = 'late'").drop("half")


def _tested(rows, fit):
    season = rows.where(VALIDATION)
    return r6(models.predict(rows.where(TEST), fit(_packed(season, season.count()), EVERY)).select("match_id", "y", *models.P))


@query(None)
def logreg_probs(m):
    return _tested(_vectors(m), models.fit_logistic)


@query(None)
def forest_probs(m):
    return _tested(_vectors(m), models.fit_forest)


@query(None)
def network_probs(m):
    return _tested(_vectors(m), models.fit_network)


@query(None)
def literature_models(m):
    rows = _vectors(m)
    fitted, tested = rows.where(VALIDATION), rows.where(TEST)
    found = [(name, models.loss_of(models.predict(tested, fit(fitted, EVERY)))) for name, fit in (("balanced", models.fit_balanced), ("forest", models.fit_forest))]
    return r6(m.sparkSession.createDataFrame(found, "model string, log_loss double"))


@query(None)
def boosted_probs(m):
    """Rate and depth chosen on the late half of the validation season, then a fit on all of it."""
    rows = _vectors(m)
    early, late = _halves(rows)
    rate, depth, _ = models.best_boosted(early, late, EVERY)
    return _tested(rows, lambda rows, names: models.fit_boosted(rows, names, rate, depth))


@query(None)
def penalty_choice(m):
    early, late = _halves(_vectors(m))
    return r6(m.sparkSession.createDataFrame([models.best_penalty(early, late, EVERY)], "c double, log_loss double"))


def _losses_of(m, names):
    early, late = _halves(_vectors(m))
    found = models.subset_losses(early, late, {n: feature_sets.feature_set(n) for n in names})
    return r6(m.sparkSession.createDataFrame(found, "features string, width int, log_loss double"))


@query(None)
def feature_subsets(m):
    """The sets that a learned model chooses among, by the loss of a logistic model."""
    return _losses_of(m, feature_sets.CANDIDATES)


@query(None)
def feature_ablations(m):
    return _losses_of(m, feature_sets.ABLATIONS)


_FEATURES = list(STEPS)


@query(
    HIST_ALL
    + ", st as (select "
    + ", ".join(f"cast({x.replace('n is null', 'false')} as double) as {c}" for c, x in STEPS.items())
    + " from hist where n <= 5) "
    + " union all ".join(f"select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from st" for c in _FEATURES)
)
def sequence_scaler(m):
    return r6(models.step_scaler(asof.last_sequences(m.selectExpr("*", *MORE_COLUMNS)), _FEATURES))


@query(
    HIST_ALL
    + """, n as (select league, team, date, count(*) filter (n <= 5) as k, sum(gf) filter (n <= 5) as gf from hist group by all), d as (select league, team, date, coalesce(k, 0) as k, coalesce(gf, 0) as gf from days left join n using (league, team, date))
 select m.match_id, case when home_goals > away_goals then 0 when home_goals = away_goals then 1 else 2 end as y, h.k as home_there, a.k as away_there, h.gf as home_goals_seen, a.gf as away_goals_seen from matches m join d h on h.league = m.league and h.date = m.date and h.team = m.home_team join d a on a.league = m.league and a.date = m.date and a.team = m.away_team
 where home_goals is not null and away_goals is not null"""
)
def sequence_dataset(m):
    played = m.where("home_goals is not null and away_goals is not null").withColumn("y", O.outcome("home_goals", "away_goals"))
    rows = models.sequence_dataset(played, asof.last_sequences(m.selectExpr("*", *MORE_COLUMNS)))
    there = lambda s: F.aggregate(f"{s}_steps", F.lit(0).cast("bigint"), lambda a, x: a + x["there"])
    goals = lambda s: F.aggregate(f"{s}_steps", F.lit(0.0), lambda a, x: a + x["goals_for"])
    return rows.select("match_id", "y", there("home").alias("home_there"), there("away").alias("away_there"), goals("home").alias("home_goals_seen"), goals("away").alias("away_goals_seen"))


@query(None)
def served_fixture(m):
    """One fixture through the same plan as all: the first of the test season."""
    rows = _vectors(m)
    one = rows.where(TEST).orderBy("date", "match_id").limit(1)
    return r6(models.predict(one, models.fit_logistic(rows.where(VALIDATION), EVERY)).select("match_id", *models.P))


@query(None)
def literature_quality(m):
    """Log loss and accuracy of the balanced model on the test season, beside the market's."""
    rows = _vectors(m)
    scored = models.predict(rows.where(TEST), models.fit_balanced(rows.where(VALIDATION), EVERY))
    own, market = [F.col(c) for c in models.P], O.legs("market")
    return r6(scored.agg(metrics.log_loss(own).alias("log_loss"), metrics.accuracy(own).alias("accuracy"), metrics.log_loss(market).alias("market_log_loss")))
