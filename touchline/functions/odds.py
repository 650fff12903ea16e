"""Odds and probabilities of home win, draw and away win, as columns.

A triplet is a list of three columns. A missing number is null, NaN or infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import all_of, clip, col, finite, safe_logit, sigmoid

Triplet = list[Column]
LEGS = ("home", "draw", "away")
#: Odds must be above this to count.
LEAST_ODDS = 1.0001


def legs(prefix: str) -> Triplet:
    """The columns ``prefix``_home, _draw and _away."""
    return [F.col(f"{prefix}_{leg}") for leg in LEGS]


def counts(odds: Column) -> Column:
    """Whether one odds is finite and above 1.0001; null where it is. NaN is above infinity."""
    x = odds.cast("double")
    return (x > LEAST_ODDS) & (x < float("inf"))


def given(odds: Triplet) -> Column:
    """Whether all three odds are there and above 1.0001."""
    return all_of(*[F.coalesce(counts(o), F.lit(False)) for o in odds])


def fair_probs(odds: Triplet) -> Triplet:
    """Probabilities with the bookmaker's margin taken out; all null unless the odds are ``given``."""
    inverse = [1.0 / finite(o) for o in odds]
    ok = given(odds)
    return [F.when(ok, i / (inverse[0] + inverse[1] + inverse[2])) for i in inverse]


def fair_odds(probs: Triplet) -> Triplet:
    """Odds without margin."""
    clipped = [clip(p, 1e-12, 1.0) for p in probs]
    return [(clipped[0] + clipped[1] + clipped[2]) / p for p in clipped]


def normalised(probs: Triplet) -> Triplet:
    total = probs[0] + probs[1] + probs[2]
    return [p / total for p in probs]


def choose(condition: Column, yes: Triplet, no: Triplet) -> Triplet:
    return [F.when(condition, a).otherwise(b) for a, b in zip(yes, no)]


def with_consensus(rows: DataFrame, preferred: Triplet | None, books: list[Triplet], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names``: ``preferred`` where it is given; else the fair odds of the mean of the probabilities
    of all books that are; null where none is."""
    # Column by column, as an expression is written out wherever it is used: as one it grows too long to be compiled.
    each = [(b, k) for b in range(len(books)) for k in range(3)]
    at = lambda x, b, k: F.col(f"__{x}{b}_{k}")
    out = rows.withColumns({f"__i{b}_{k}": F.when(counts(books[b][k]), 1.0 / books[b][k].cast("double")) for b, k in each})
    out = out.withColumns({f"__p{b}_{k}": at("i", b, k) / (at("i", b, 0) + at("i", b, 1) + at("i", b, 2)) for b, k in each})
    n = sum((at("p", b, 0).isNotNull().cast("int") for b in range(len(books))), F.lit(0))
    out = out.withColumn("__n", F.nullif(n, F.lit(0)))
    out = out.withColumns({f"__m_{k}": clip(sum((F.coalesce(at("p", b, k), F.lit(0.0)) for b in range(len(books))), F.lit(0.0)) / F.col("__n"), 1e-12, 1.0) for k in range(3)})
    fallback = fair_odds([F.col(f"__m_{k}") for k in range(3)])
    chosen = fallback if preferred is None else choose(given(preferred), preferred, fallback)
    return out.select(*[c for c in rows.columns if c not in names], *[x.alias(c) for x, c in zip(chosen, names)])


def mean_of_books(books: list[Triplet]) -> Column:
    """A struct of the fair odds of the books' mean probabilities, as ``with_consensus``; null where no book is given. One
    expression of all legs, for many books."""
    quotes = F.array(*[F.when(given(b), F.struct(*[(1.0 / o).alias(leg) for o, leg in zip(b, LEGS)])) for b in books])
    one = lambda q: F.struct(F.lit(1).alias("n"), *[(q[leg] / (q["home"] + q["draw"] + q["away"])).alias(leg) for leg in LEGS])
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(leg) for leg in LEGS])
    added = lambda a, q: F.struct((a["n"] + q["n"]).alias("n"), *[(a[leg] + q[leg]).alias(leg) for leg in LEGS])
    fair = lambda a: F.when(a["n"] > 0, F.struct(*[((a["home"] + a["draw"] + a["away"]) / a[leg]).alias(leg) for leg in LEGS]))
    return F.aggregate(F.transform(F.filter(quotes, lambda q: q.isNotNull()), one), zero, added, fair)


def over_under(pairs: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """(probability of over, odds of over, odds of under) from the first pair of which both are given."""
    quotes = []
    for over, under in pairs:
        over, under = finite(over), finite(under)
        ok = (over > LEAST_ODDS) & (under > LEAST_ODDS)
        quotes.append(F.when(ok, F.struct(((1.0 / over) / (1.0 / over + 1.0 / under)).alias("p"), over.alias("over"), under.alias("under"))))
    first = F.coalesce(*quotes)
    return first["p"], first["over"], first["under"]


def first_line(*lines: Column | str) -> Column:
    """The first number that is there."""
    return F.coalesce(*[finite(x) for x in lines])


def snapshot(source: str) -> Triplet:
    """Odds of one moment: opening, closing (as a whole the legacy ones where a leg is missing) or legacy."""
    if source == "opening":
        return [finite(o) for o in legs("open_odds")]
    if source == "legacy":
        return [finite(o) for o in legs("odds")]
    if source == "closing":
        closing = [finite(o) for o in legs("close_odds")]
        return choose(all_of(*[o.isNotNull() for o in closing]), closing, [finite(o) for o in legs("odds")])
    raise ValueError(f"unknown odds source: {source}")


def market_or_model(market: Triplet, model: Triplet) -> Triplet:
    """The market's probabilities, as a whole the model's where one is missing."""
    m = [finite(p) for p in market]
    return choose(all_of(*[p.isNotNull() for p in m]), m, model)


def market_move(opening: Triplet, closing: Triplet, enabled: bool = True) -> Triplet:
    """Closing less opening fair probabilities; 0 where either is missing or when not ``enabled``."""
    if not enabled:
        return [F.lit(0.0)] * 3
    a, b = fair_probs(opening), fair_probs(closing)
    both = given(opening) & given(closing)
    return [F.when(both, y - x).otherwise(0.0) for x, y in zip(a, b)]


def outcome(home_goals: Column | str, away_goals: Column | str) -> Column:
    """0 home win, 1 draw, 2 away win; null for a match not played."""
    h, a = col(home_goals), col(away_goals)
    return F.when(h > a, 0).when(h == a, 1).when(h < a, 2)


def probability_of(probs: Triplet, result: Column | str) -> Column:
    """The probability of the outcome 0, 1 or 2."""
    y = col(result)
    return F.when(y == 0, probs[0]).when(y == 1, probs[1]).when(y == 2, probs[2])


def temperature(probs: Triplet, t: Column | float) -> Triplet:
    """softmax(ln p / t), missing and tiny probabilities as 1e-12."""
    safe = normalised([clip(F.coalesce(finite(p), F.lit(1e-12)), 1e-12, 1.0) for p in probs])
    return normalised([F.exp(F.ln(p) / t) for p in safe])


def blend(members: list[tuple[Triplet, Column | float]], fallback: Triplet) -> Triplet:
    """Weighted mean of the members that are there, made to sum to 1; ``fallback`` where no weight is left."""
    weights = [F.when(finite(p[0]).isNotNull(), F.lit(w) if isinstance(w, (int, float)) else w).otherwise(0.0) for p, w in members]
    total = sum(weights[1:], weights[0])
    mixed = [sum((F.coalesce(finite(p[k]), F.lit(0.0)) * w for (p, _), w in zip(members, weights)), F.lit(0.0)) for k in range(3)]
    return choose(total > 0, normalised(mixed), fallback)


def effective_weights(weights: dict[str, float], excluded: tuple[str, ...] = (), last: str = "xgb") -> dict[str, float]:
    """Weights of the members not excluded, made to sum to 1; all on ``last`` where none is left."""
    kept = {k: max(0.0, w) for k, w in weights.items() if k not in excluded}
    total = sum(kept.values())
    return {k: w / total for k, w in kept.items()} if total > 0 else {last: 1.0}


def safe(probs: Triplet) -> Triplet:
    """Probabilities of which none is missing, 0 or above 1, made to sum to 1."""
    return normalised([F.least(F.greatest(F.coalesce(finite(p), F.lit(1e-12)), F.lit(1e-12)), F.lit(1.0)) for p in probs])


def corrected_market(market: Triplet, source: Triplet | None, alpha: float | Column) -> Triplet:
    """market^(1 - alpha) * source^alpha, made to sum to 1; the market for alpha 0 or without a source. A missing
    probability counts as 1e-12, alpha as 1 at most."""
    m = safe(market)
    if source is None or isinstance(alpha, (int, float)) and alpha <= 0:
        return m
    a = clip(F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha, 0.0, 1.0)
    powered = [F.pow(x, 1.0 - a) * F.pow(y, a) for x, y in zip(m, safe(source))]
    return choose(a <= 0, m, normalised(powered))


def meta_logits(model: Triplet, market: Triplet) -> list[Column]:
    return [safe_logit(p) for p in (*model, *market)]


def probs_from_logits(logits: list[Column]) -> Triplet:
    return normalised([sigmoid(z) for z in logits])
