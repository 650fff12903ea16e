"""Named sets of the columns that learned models see: 89 in all, in groups, and sets by name from these.

``core_plus_odds_context`` is the core and a group more, ``no_form`` all but a group. The core is what the base model and the
market say and the twelve numbers beside them; ``default`` is the core without rates and rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import odds as O  # noqa: N812
from touchline.functions.context import COUNTS, SIDES
from touchline.operators.prematch import LOCAL, XG

_THREE = ("home", "away", "diff")
_OF_FIVE = lambda names: [f"{n}_{s}_5" for n in names for s in _THREE]
_BOTH = lambda c: [*(f"{s}_{c}" for s in SIDES), f"{c}_diff"]

GROUPS: dict[str, list[str]] = {
    "model": [f"model_logit_{leg}" for leg in O.LEGS],
    "market_logits": [f"market_logit_{leg}" for leg in O.LEGS],
    "elo": ["elo_diff"],
    "rates": ["rate_sum", "rate_diff"],
    "momentum": [f"mom_{s}" for s in _THREE],
    "rest": [f"rest_{s}" for s in _THREE],
    "form": [f"form_{s}" for s in _THREE],
    "stats": _OF_FIVE(LOCAL),
    "odds_context": [*(f"market_move_{leg}" for leg in O.LEGS), "ou25_over_prob", "ah_line"],
    "expected_goals": _OF_FIVE(XG),
    "lineup": _BOTH("lineup_strength"),
    "absences": ["lineup_available", "team_news_available", *(x for c in COUNTS for x in _BOTH(c))],
    "weather": ["weather_available", "temperature_c", "wind_kph", "precipitation_mm", "weather_severity"],
    "players": [*_BOTH("absence_strength_loss"), *(f"{s}_player_context_available" for s in SIDES)],
}
#: Groups that are others together.
UNIONS = {
    "market": ("market_logits", "odds_context"), "core": ("model", "market_logits", "elo", "rates", "momentum", "rest", "form"), "default": ("model", "market_logits", "elo", "momentum", "form"),
    "team_news": ("lineup", "absences"), "external_context": ("lineup", "absences", "weather", "players"), "new_local": ("stats", "odds_context"), "new_data": ("stats", "odds_context", "expected_goals", "lineup", "absences", "weather", "players"),
}
EVERY = [c for names in GROUPS.values() for c in names]
#: What a set that begins with a word and "_plus_" holds besides what follows.
_BASES = {"core": "core", "default": "default", "market": "market_logits", "market_context": "market"}

#: The sets that a learned model, a network and an ablation try.
_MARKET_PLUS = ("expected_goals", "external_context")
CANDIDATES = ("all", "core", "market_only", "market_plus_odds_context", *(f"core_plus_{g}" for g in ("odds_context", "stats", "new_local", *_MARKET_PLUS)), *(f"market_plus_{g}" for g in (*_MARKET_PLUS, "lineup")), *(f"market_context_plus_{g}" for g in _MARKET_PLUS), *(f"no_{g}" for g in ("stats", "odds_context", *_MARKET_PLUS)))
NETWORK_CANDIDATES = ("default", *(f"default_plus_{g}" for g in ("odds_context", "stats", "new_local", "expected_goals", "lineup", "team_news", "weather", "external_context")), "core", *(f"core_plus_{g}" for g in ("odds_context", "stats", *_MARKET_PLUS)), "all")
ABLATIONS = (*(s for s in CANDIDATES if s != "market_plus_lineup"), *(f"no_{g}" for g in ("new_data", "new_local", "market", "elo", "rates", "momentum", "rest", "form")), "model_only")


def _group(name: str) -> list[str]:
    if name in UNIONS:
        return [c for g in UNIONS[name] for c in GROUPS[g]]
    if name not in GROUPS:
        raise ValueError(f"no group of features is named {name}")
    return GROUPS[name]


def feature_set(name: str) -> list[str]:
    """The columns of a set, in the order of ``EVERY``; ValueError for a name that says nothing."""
    if name == "all":
        return list(EVERY)
    if name.startswith("no_"):
        gone = set(_group(name[3:]))
        return [c for c in EVERY if c not in gone]
    if name in ("market_only", "model_only"):
        return list(GROUPS[{"market_only": "market_logits", "model_only": "model"}[name]])
    base, plus, more = name.partition("_plus_")
    if plus and base not in _BASES:
        raise ValueError(f"no set of features begins with {base}")
    wanted = {*_group(_BASES[base] if plus else base), *(_group(more) if plus else [])}
    return [c for c in EVERY if c in wanted]


def with_logits(block: DataFrame) -> DataFrame:
    """A pre-match block with the logits of the model's and the market's probabilities, the model's where there is no market."""
    market = O.market_or_model(O.legs("market"), O.legs("p"))
    logits = O.meta_logits(O.legs("p"), market)
    return block.withColumns({c: x for c, x in zip((*GROUPS["model"], *GROUPS["market_logits"]), logits)}).withColumns({c: F.col(c).cast("double") for c in EVERY if c not in (*GROUPS["model"], *GROUPS["market_logits"])})
