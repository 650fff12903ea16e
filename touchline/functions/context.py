"""What is known about a fixture besides its odds and history: line-ups, absences, weather; and its defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import finite, flag_number

SIDES = ("home", "away")
#: What counts where nothing is known; all else counts 0.
NEUTRAL = {"ou25_over_prob": 0.5, "home_lineup_strength": 1.0, "away_lineup_strength": 1.0, "temperature_c": 15.0}
#: Fixed value: a manager is new for so many days.
NEW_MANAGER_DAYS = 30
#: Counts of a side that are told apart, each with its difference home less away.
COUNTS = ("absence_count", "injury_count", "suspension_count", "key_absence_count", "manager_change_recent")


def first_existing(df: DataFrame, names: list[str], any_case: bool = False) -> str | None:
    """The first of ``names`` that is a column, in any case if asked for."""
    known = {c.lower() if any_case else c: c for c in df.columns}
    return next((known[k] for n in names if (k := n.lower() if any_case else n) in known), None)


def pick_number(df: DataFrame, names: list[str], any_case: bool = True) -> Column:
    """The first existing column of ``names`` as a number; null without any."""
    found = first_existing(df, names, any_case)
    return finite(F.col(found).try_cast("double")) if found else F.lit(None).cast("double")


def or_default(name: str, df: DataFrame) -> Column:
    """A column as a finite number, its neutral value where it is missing or absent."""
    value = finite(name) if name in df.columns else F.lit(None).cast("double")
    return F.coalesce(value, F.lit(NEUTRAL.get(name, 0.0)))


def weather_severity(temperature: Column, wind: Column, rain: Column) -> Column:
    """Discomfort by temperature, wind and rain, 5 at most."""
    return F.least(F.lit(5.0), F.abs(temperature - 15.0) / 20.0 + F.greatest(F.lit(0.0), wind) / 40.0 + F.greatest(F.lit(0.0), rain) / 10.0)


def fill_context(context: DataFrame) -> DataFrame:
    """Derived columns where they are missing: absences of a side from its injuries and suspensions, a recent change
    of manager from the days since, the difference of strength lost; and whether anything is known."""
    out = context
    for side in SIDES:
        parts = [finite(f"{side}_injury_count"), finite(f"{side}_suspension_count")]
        known = F.coalesce(*parts).isNotNull()
        absent = F.when(known, F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)))
        days = finite(f"{side}_manager_days")
        out = out.withColumns({f"{side}_absence_count": F.coalesce(finite(f"{side}_absence_count"), absent), f"{side}_manager_change_recent": (days <= NEW_MANAGER_DAYS).cast("double")})
    loss = [F.coalesce(finite(f"{s}_absence_strength_loss"), F.lit(0.0)) for s in SIDES]
    news = F.coalesce(*[F.col(f"{s}_{c}") for s in SIDES for c in COUNTS if f"{s}_{c}" in out.columns])
    weather = F.coalesce(finite("temperature_c"), finite("wind_kph"), finite("precipitation_mm"))
    return out.withColumns({"absence_strength_loss_diff": loss[0] - loss[1], "team_news_available": news.isNotNull().cast("double"), "weather_available": weather.isNotNull().cast("double")})


def context_features(df: DataFrame) -> dict[str, Column]:
    """The context's part of a pre-match vector, with neutral values where nothing is known."""
    of = lambda name: or_default(name, df)
    out = {"lineup_available": flag_number("lineup_available")}
    out |= {f"{s}_lineup_strength": of(f"{s}_lineup_strength") for s in SIDES}
    out["lineup_strength_diff"] = of("home_lineup_strength") - of("away_lineup_strength")
    out["team_news_available"] = of("team_news_available")
    for c in COUNTS:
        out |= {f"{s}_{c}": of(f"{s}_{c}") for s in SIDES} | {f"{c}_diff": of(f"home_{c}") - of(f"away_{c}")}
    out |= {c: of(c) for c in ("weather_available", "temperature_c", "wind_kph", "precipitation_mm")}
    out["weather_severity"] = weather_severity(of("temperature_c"), of("wind_kph"), of("precipitation_mm"))
    out |= {f"{s}_absence_strength_loss": of(f"{s}_absence_strength_loss") for s in SIDES}
    out["absence_strength_loss_diff"] = of("home_absence_strength_loss") - of("away_absence_strength_loss")
    out |= {f"{s}_player_context_available": of(f"{s}_player_context_available") for s in SIDES}
    return out
