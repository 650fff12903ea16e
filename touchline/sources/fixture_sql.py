"""Matches derived from the star-schema tables, as one SQL text that Spark and DuckDB both run.

A match is an order: twenty clubs a region meet, goals and shots come from the order's lines, odds and
expected goals from whole-number arithmetic on its key, with gaps in every column that may have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCHES_CTE = """
line_sums as (
  select l_orderkey,
         cast(count(case when l_returnflag = 'R' then 1 end) as double) as hg,
         cast(count(case when l_returnflag = 'A' then 1 end) as double) as ag,
         cast(sum(case when l_linestatus = 'F' then l_quantity else 0 end) as double) as hs,
         cast(sum(case when l_linestatus = 'O' then l_quantity else 0 end) as double) as aws
  from lineitem group by l_orderkey),
matches as (
  select o.o_orderkey as match_id, cast(o.o_orderdate as date) as date, n.n_regionkey as league,
         cast(n.n_regionkey * 20 + c.c_custkey % 20 as int) as home_team,
         cast(n.n_regionkey * 20 + (c.c_custkey + 1 + o.o_orderkey % 19) % 20 as int) as away_team,
         case when o.o_orderkey % 41 = 0 then null else g.hg end as home_goals,
         case when o.o_orderkey % 41 = 0 then null else g.ag end as away_goals,
         case when o.o_orderkey % 23 = 0 then null else g.hs end as home_shots,
         case when o.o_orderkey % 29 = 0 then null else g.aws end as away_shots,
         cast(o.o_orderkey * 31 % 12 as double) as home_corners,
         cast(o.o_orderkey * 37 % 11 as double) as away_corners,
         case when o.o_orderkey % 13 = 0 then null else cast(o.o_orderkey * 43 % 6 as double) end as home_yellows,
         cast(o.o_orderkey * 47 % 6 as double) as away_yellows,
         cast(case when o.o_orderkey % 19 = 0 then 1 else 0 end as double) as home_reds,
         cast(case when o.o_orderkey % 22 = 0 then 1 else 0 end as double) as away_reds,
         case when o.o_orderkey % 17 = 0 then null else cast(130 + (o.o_orderkey * 7919 % 400) as double) / 100 end as open_odds_home,
         cast(280 + (o.o_orderkey * 104729 % 200) as double) / 100 as open_odds_draw,
         cast(150 + (o.o_orderkey * 1299709 % 500) as double) / 100 as open_odds_away,
         case when o.o_orderkey % 11 = 0 then null else cast(125 + (o.o_orderkey * 7907 % 410) as double) / 100 end as close_odds_home,
         cast(275 + (o.o_orderkey * 104723 % 210) as double) / 100 as close_odds_draw,
         case when o.o_orderkey % 31 = 0 then cast(1 as double) else cast(145 + (o.o_orderkey * 1299689 % 510) as double) / 100 end as close_odds_away,
         cast(135 + (o.o_orderkey * 6151 % 390) as double) / 100 as odds_home,
         cast(285 + (o.o_orderkey * 3079 % 190) as double) / 100 as odds_draw,
         cast(155 + (o.o_orderkey * 1543 % 480) as double) / 100 as odds_away,
         case when o.o_orderkey % 9 = 0 then null else cast(140 + (o.o_orderkey * 769 % 150) as double) / 100 end as over_odds,
         case when o.o_orderkey % 14 = 0 then null else cast(150 + (o.o_orderkey * 389 % 130) as double) / 100 end as under_odds,
         case when o.o_orderkey % 6 = 0 then null else cast((o.o_orderkey * 193 % 9 - 4) as double) / 4 end as ah_line,
         case when o.o_orderkey % 7 = 0 then null else cast((o.o_orderkey * 97 % 350) as double) / 100 end as home_xg,
         case when o.o_orderkey % 7 = 0 then null else cast((o.o_orderkey * 89 % 300) as double) / 100 end as away_xg
  from orders o join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey join line_sums g on g.l_orderkey = o.o_orderkey)
""".strip()

#: Further columns of a match, as expressions over ``matches`` that Spark and DuckDB both run.
MORE_COLUMNS = (
    "case when match_id % 8 = 0 then null else cast(match_id * 53 % 9 as double) end as home_shots_target",
    "case when match_id % 10 = 0 then null else cast(match_id * 59 % 8 as double) end as away_shots_target",
    "case when match_id % 7 = 0 then null else cast(match_id * 83 % 300 as double) / 100 end as home_npxg",
    "case when match_id % 7 = 0 then null else cast(match_id * 79 % 250 as double) / 100 end as away_npxg",
    "case when match_id % 7 = 0 then null else cast(match_id * 71 % 300 as double) / 100 end as home_xpts",
    "case when match_id % 7 = 0 then null else cast(match_id * 73 % 300 as double) / 100 end as away_xpts",
)

#: What a context source has of a match, as expressions over ``matches``; three of four matches have a row.
CONTEXT_COLUMNS = (
    "case when match_id % 5 = 0 then null else cast(60 + match_id * 17 % 40 as double) / 100 end as home_lineup_strength",
    "case when match_id % 6 = 0 then null else cast(55 + match_id * 19 % 45 as double) / 100 end as away_lineup_strength",
    "cast(case match_id % 5 when 0 then null when 1 then 0 when 2 then 2 else 1 end as double) as lineup_available",
    "case when match_id % 3 = 0 then null else cast(match_id * 7 % 5 as double) end as home_injury_count",
    "case when match_id % 7 = 0 then null else cast(match_id * 11 % 4 as double) end as away_injury_count",
    "case when match_id % 5 = 1 then null else cast(match_id * 13 % 3 as double) end as home_suspension_count",
    "case when match_id % 3 = 0 then null else cast(match_id % 2 as double) end as away_suspension_count",
    "case when match_id % 9 = 0 then cast(match_id % 6 as double) end as home_absence_count",
    "case when match_id % 8 = 0 then cast(match_id % 5 as double) end as away_absence_count",
    "case when match_id % 4 = 1 then cast(match_id % 3 as double) end as home_key_absence_count",
    "case when match_id % 4 = 2 then cast(match_id % 2 as double) end as away_key_absence_count",
    "case when match_id % 3 = 1 then cast(match_id * 3 % 90 as double) end as home_manager_days",
    "case when match_id % 5 = 2 then cast(match_id * 5 % 120 as double) end as away_manager_days",
    "case when match_id % 6 = 1 then null else cast(match_id * 23 % 45 - 8 as double) end as temperature_c",
    "case when match_id % 6 = 1 then null else cast(match_id * 29 % 70 as double) end as wind_kph",
    "case when match_id % 6 = 1 then null else cast(match_id * 31 % 200 as double) / 10 end as precipitation_mm",
    "case when match_id % 10 < 3 then cast(match_id * 41 % 100 as double) / 100 end as home_absence_strength_loss",
    "case when match_id % 10 < 2 then cast(match_id * 43 % 100 as double) / 100 end as away_absence_strength_loss",
)
CONTEXT_ROWS = "match_id % 4 <> 3"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_matches(body: str) -> str:
    """A SQL text in which ``matches`` is defined; ``body`` may begin with further common table expressions
    (``, name as (...) select ...``) or with select."""
    return f"with recursive {MATCHES_CTE}\n{body}"


def read_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of a folder of tables."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "customer", "nation", "lineitem")}
    named = MATCHES_CTE
    for name in tables:
        named = named.replace(f"from {name} ", f"from {{{name}}} ").replace(f"join {name} ", f"join {{{name}}} ")
    return spark.sql(f"with {named} select * from matches", **tables)
