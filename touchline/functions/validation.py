"""Checks of tables: one pass counts what is wrong, and the first few samples are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most samples that a message names.
SAMPLES = 5


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``df`` with the columns it lacks."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def not_empty(*names: str) -> dict[str, Column]:
    return {f"{n} is empty": F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == "" for n in names}


def allowed(name: str, values: tuple[str, ...]) -> dict[str, Column]:
    return {f"{name} is not allowed": ~F.coalesce(F.lower(F.trim(name)).isin(*values), F.lit(False))}


def binary(*names: str) -> dict[str, Column]:
    return {f"{n} is not 0 or 1": F.col(n).isNotNull() & ~F.col(n).isin(0, 1) for n in names}


def not_negative(*names: str) -> dict[str, Column]:
    return {f"{n} is negative or no number": F.col(n).isNotNull() & ~F.coalesce(F.col(n).cast("string").try_cast("double") >= 0, F.lit(False)) for n in names}


def available_in_time(available: str, kickoff: str) -> dict[str, Column]:
    """Nothing may be known only after the kick-off."""
    return {"available after kick-off": F.coalesce(F.col(available) > F.col(kickoff), F.lit(False))}


def one_role(starter: str, substitute: str) -> dict[str, Column]:
    return {"starter and substitute": F.coalesce(F.col(starter) + F.col(substitute) > 1, F.lit(False))}


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule: rule, n."""
    counted = df.agg(*[F.count_if(c).alias(f"__{k}") for k, c in enumerate(rules.values())])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"__{k}").alias("n")) for k, r in enumerate(rules)])))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: the keys, n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """``df`` if no rule is broken and no key repeated; else ValueError, with some samples."""
    if rules and (broken := violations(df, rules).where("n > 0").collect()):  # a row a rule
        rule = broken[0].rule
        samples = [r.asDict() for r in df.where(rules[rule]).limit(SAMPLES).collect()]
        raise ValueError("; ".join(f"{r.rule}: {r.n} rows" for r in broken) + f"; such as {samples}")
    if unique and (again := duplicates(df, unique).limit(SAMPLES).collect()):
        raise ValueError(f"repeated keys: {[r.asDict() for r in again]}")
    return df


#: Which odds a market or a bet may be taken at.
ODDS_SOURCES = ("opening", "closing", "legacy")


def odds_source(name: str) -> str:
    if name not in ODDS_SOURCES:
        raise ValueError(f"odds source {name!r} is none of {ODDS_SOURCES}")
    return name
