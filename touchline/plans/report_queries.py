"""Queries that report on models and bets, and choose parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import odds as O  # noqa: N812
from touchline.operators import metrics, reports, search, tuning
from touchline.plans.queries import BETS, FAIR, MODEL, SCORED, TEST, TOTALS, VALIDATION, _bets, _priced, _probs, query, r6

_FLAT_Y = "case y when 0 then 0.45 when 1 then 0.27 else 0.28 end"


def _flat():
    return [F.lit(p) for p in MODEL]


_SPLIT = "case when date < date '1995-07-01' then 'train' when date < date '1996-07-01' then 'validation' else 'test' end"
_CLASSES = ", ".join(
    f"round(avg({p}), 6) as mean_{leg}, round(avg((y = {k})::double), 6) as rate_{leg}, round(avg((pick = {k})::double), 6) as pick_{leg}, round(coalesce(count(*) filter (pick = {k} and y = {k}) / nullif(count(*) filter (pick = {k}), 0), 0), 6) as precision_{leg}, "
    f"round(coalesce(count(*) filter (pick = {k} and y = {k}) / nullif(count(*) filter (y = {k}), 0), 0), 6) as recall_{leg}, round(coalesce(2 * count(*) filter (pick = {k} and y = {k}) / nullif(count(*) filter (pick = {k}) + count(*) filter (y = {k}), 0), 0), 6) as f1_{leg}"
    for k, (leg, p) in enumerate(zip(O.LEGS, ("ph", "pd", "pa")))
)
_MODELS = SCORED + f""", two as (select {_SPLIT} as split, 'market' as model, y, ph, pd, pa, py, pick from s union all select {_SPLIT}, 'flat', y, 0.45::double, 0.27::double, 0.28::double, ({_FLAT_Y})::double, 0 from s)"""


@query(
    _MODELS
    + f""", bins as (select split, model, least(floor(greatest(ph, pd, pa) * 10), 9) as bin, sum(greatest(ph, pd, pa)) as c, sum((pick = y)::double) as h, count(*) as n from two group by all),
 e as (select split, model, sum(abs(c - h)) / sum(n) as ece from bins group by all),
 q as (select split, model, count(*) as n, round(avg(-ln(py)), 6) as log_loss, round(avg(pow(ph - (y = 0)::double, 2) + pow(pd - (y = 1)::double, 2) + pow(pa - (y = 2)::double, 2)), 6) as brier, round(avg((pick = y)::double), 6) as accuracy, round(avg(greatest(ph, pd, pa)), 6) as confidence, {_CLASSES} from two group by all)
 select q.*, round(ece, 6) as ece from q join e using (split, model)"""
)
def quality_report(m):
    split = F.when(F.col("date") < "1995-07-01", "train").when(F.col("date") < "1996-07-01", "validation").otherwise("test")
    rows = reports.by_model(_priced(m).withColumn("split", split), {"market": _probs(), "flat": _flat()})
    return r6(reports.quality(rows, ["split", "model"]).drop("macro_f1"))


@query(SCORED + f""", d as (select y, py, ({_FLAT_Y})::double as fy, abs(ph - 0.45) + abs(pd - 0.27) + abs(pa - 0.28) as d from s) select round(avg(d) / 3, 6) as mean_diff, round(avg(-ln(py)) - avg(-ln(fy)), 6) as gain from d""")
def parameter_impact(m):
    return r6(reports.parameter_impact(_priced(m), _probs(), _flat()))


@query(SCORED + "select round(avg((pick = 0)::double), 6) as agree, round(avg((abs(ph - 0.45) + abs(pd - 0.27) + abs(pa - 0.28)) / 3), 6) as mean_diff, round(avg(greatest(ph, pd, pa)), 6) as conf_a, 0.45::double as conf_b from s")
def model_agreement(m):
    return r6(metrics.agreement(_priced(m), _probs(), _flat()))


@query(BETS + "select count(*) as bets, round(sum(profit), 4) as total, round(avg(profit), 6) as mean, round(median(profit), 6) as median, round(max(profit), 6) as most from bets")
def profit_profile(m):
    return r6(reports.profit_profile(_bets(m))).withColumn("total", F.round("total", 4))


@query(BETS + ", t as (select match_id, profit, row_number() over (order by profit desc, match_id) as a, row_number() over (order by profit, match_id) as b from bets) select 'top' as side, a::int as rank, match_id, round(profit, 6) as profit from t where a <= 10 union all select 'bottom', b::int, match_id, round(profit, 6) from t where b <= 10")
def top_bottom_bets(m):
    return r6(reports.top_and_bottom(_bets(m)))


@query(BETS + f"select case when grouping(pick) = 1 then 'all' when pick = 0 then 'home' when pick = 1 then 'draw' else 'away' end as segment, {TOTALS} from bets group by grouping sets ((), (pick))")
def bet_segments(m):
    return reports.segments(_bets(m))


@query(BETS + "select match_id, round(bet_odds, 6) as bet_odds, round(ev, 6) as ev from bets where bet_prob >= 0.28 and bet_odds between 1.8 and 4.0")
def candidate_bets(m):
    return r6(reports.candidates(_bets(m), 0.28, 1.8, 4.0).select("match_id", "bet_odds", "ev"))


@query(
    f""", r as (select *, {_SPLIT} as split from matches),
 c as (select split, count(*) as n, count(*) filter (open_odds_home > 1.0001 and open_odds_draw > 1.0001 and open_odds_away > 1.0001) as opening, count(*) filter (close_odds_home > 1.0001 and close_odds_draw > 1.0001 and close_odds_away > 1.0001) as closing, count(*) filter (coalesce(home_xg, away_xg) is not null) as xg, count(*) filter (coalesce(home_shots, away_shots) is not null) as shots from r group by split)
 select split, unnest(['opening', 'closing', 'xg', 'shots']) as "group", n, unnest([opening, closing, xg, shots]) as covered, round(unnest([opening, closing, xg, shots]) / n, 6) as share from c"""
)
def enrichment_coverage(m):
    split = F.when(F.col("date") < "1995-07-01", "train").when(F.col("date") < "1996-07-01", "validation").otherwise("test")
    groups = {"opening": O.given(O.legs("open_odds")), "closing": O.given(O.legs("close_odds")), "xg": reports.any_known("home_xg", "away_xg"), "shots": reports.any_known("home_shots", "away_shots")}
    return r6(reports.enrichment_coverage(m.withColumn("split", split), groups))


_DC = ", ".join(f"struct_pack(market := '{n}', p := ({a} + {b})::double, odds := 1 / (1 / open_odds_{x} + 1 / open_odds_{y}), won := y in ({i}, {j}), push := false)" for n, a, b, x, y, i, j in (("double_chance_home", 0.45, 0.27, "home", "draw", 0, 1), ("double_chance_away", 0.28, 0.27, "away", "draw", 2, 1), ("double_chance_either", 0.45, 0.28, "home", "away", 0, 2)))
_DNB = ", ".join(f"struct_pack(market := '{n}', p := ({a} / ({a} + {b}))::double, odds := open_odds_{x} * (1 - 1 / open_odds_draw), won := y = {i}, push := y = 1)" for n, a, b, x, i in (("draw_no_bet_home", 0.45, 0.28, "home", 0), ("draw_no_bet_away", 0.28, 0.45, "away", 2)))


@query(
    FAIR
    + f""", b as (select unnest([{_DC}, {_DNB}]) as b from probs where ok = 1 and y is not null), c as (select unnest(b) from b), d as (select *, case when push then 0 when won then odds - 1 else -1 end as profit from c where odds > 1 and p * odds - 1 > 0.05)
 select market, count(*) as bets, count(*) filter (won and not push) as wins, count(*) filter (push) as pushes, round(sum(profit), 4) as profit, round(avg(profit), 6) as roi from d group by market"""
)
def alternative_markets(m):
    return r6(reports.alternative_markets(_priced(m), _flat())).withColumn("profit", F.round("profit", 4))


@query(
    FAIR
    + """, t as (select *, ntile(2) over (partition by league order by date, match_id) as fold from probs where ok = 1 and y is not null),
 md as (select t.*, unnest(['flat', 'shy']) as model, unnest([0.45, 0.36])::double as m0, unnest([0.27, 0.30])::double as m1, unnest([0.28, 0.34])::double as m2 from t),
 ll as (select league, model, avg(-ln(case y when 0 then m0 when 1 then m1 else m2 end)) - avg(-ln(case y when 0 then ph when 1 then pd else pa end)) as gap from md group by all),
 ev as (select *, m0 * open_odds_home - 1 as eh, m1 * open_odds_draw - 1 as ed, m2 * open_odds_away - 1 as ea from md),
 pk as (select *, case when eh >= ed and eh >= ea then 0 when ed >= ea then 1 else 2 end as pick from ev),
 bo as (select *, case pick when 0 then open_odds_home when 1 then open_odds_draw else open_odds_away end as o, case pick when 0 then eh when 1 then ed else ea end as e from pk),
 st as (select *, least(e / (o - 1) * 0.25, 0.05) as stake from bo where o <= 10 and e <= 1 and e > 0.05),
 be as (select league, model, fold, count(*) as n, sum(case when pick = y then stake * (o - 1) else -stake end) as p, sum(stake) as s from st where stake >= 0.001 group by all),
 tt as (select league, model, sum(n) as bets, sum(p) as profit, sum(p) / sum(s) as roi, count(*) filter (p > 0) as good from be group by all),
 ok as (select * from tt join ll using (league, model) where gap <= 0.5 and bets >= 20 and good = 2 and roi > 0),
 best as (select league, arg_max(struct_pack(model := model, bets := bets, profit := profit, roi := roi), (roi, profit, bets, model)) as b from ok group by league)
 select l.league, coalesce(b.model, 'market') as model, cast(coalesce(b.bets, 0) as bigint) as bets, round(coalesce(b.profit, 0), 4) as profit, round(coalesce(b.roi, 0), 6) as roi from (select distinct league from t) l left join best using (league)"""
)
def league_strategy(m):
    shy = [F.lit(p) for p in (0.36, 0.30, 0.34)]
    out = reports.league_strategy(_priced(m), {"flat": _flat(), "shy": shy}, _probs(), O.legs("open_odds"), O.legs("close_odds"), most_gap=0.5)
    return r6(out).withColumn("profit", F.round("profit", 4))


@query(
    BETS
    + f""", v as (select coalesce(sum(profit) / sum(stake), 0) as val_roi from bets where {VALIDATION}), t as (select count(*) as test_bets, coalesce(sum(profit) / sum(stake), 0) as test_roi from bets where {TEST}),
 l as (select avg(-ln({_FLAT_Y})) as flat, avg(-ln(case y when 0 then ph when 1 then pd else pa end)) as market from probs where ok = 1 and y is not null and {TEST}),
 s as (select 'flat' as model, val_roi, flat as test_log_loss, test_bets, test_roi from v, t, l union all select 'market', 0, market, 0, 0 from l)
 select model, round(val_roi, 6) as val_roi, round(test_log_loss, 6) as test_log_loss, test_bets, round(test_roi, 6) as test_roi, val_roi > 0 and test_log_loss - (select market from l) <= 0.2 and test_bets > 0 as recommended from s"""
)
def model_gates(m):
    summary = reports.model_summary(m, _priced(m), _bets(m), {"flat": _flat(), "market": _probs()}, "flat", VALIDATION, TEST)
    return r6(reports.model_gates(summary, "market", 0.2).drop("rank"))


@query(SCORED + f", g as (select unnest({list(tuning.TEMPERATURES)}) as t), l as (select t, avg(-ln(pow(py, 1 / t) / (pow(ph, 1 / t) + pow(pd, 1 / t) + pow(pa, 1 / t)))) as loss from s, g group by t) select t::double as t, round(loss, 6) as loss from l")
def temperature_losses(m):
    return r6(tuning.temperature_losses(_priced(m), _probs()).select("t", "loss"))


@query(SCORED + f", g as (select unnest({list(tuning.TEMPERATURES)}) as t), l as (select t, avg(-ln(pow(py, 1 / t) / (pow(ph, 1 / t) + pow(pd, 1 / t) + pow(pa, 1 / t)))) as loss from s, g group by t) select arg_min(t, (loss, t))::double as t, round(min(loss), 6) as loss from l")
def temperature_argmin(m):
    return r6(tuning.least(tuning.temperature_losses(_priced(m), _probs())))


@query(None)
def temperature_fit(m):
    t, loss = tuning.fit_temperature(_priced(m), _probs())
    return m.sparkSession.createDataFrame([(round(t, 3), round(loss, 6))], "t double, loss double")


_SHY_Y = "case y when 0 then 0.36 when 1 then 0.30 else 0.34 end"


@query(
    SCORED
    + f", k as (select unnest(range(21)) as a), w as (select x.a, z.a as b, 20 - x.a - z.a as c from k x, k z where x.a + z.a <= 20), l as (select a, b, c, avg(-ln(a / 20.0 * py + b / 20.0 * {_FLAT_Y} + c / 20.0 * {_SHY_Y})) as loss from s, w group by all) select (a / 20.0)::double as w0, (b / 20.0)::double as w1, (c / 20.0)::double as w2, round(loss, 6) as loss from l"
)
def blend_losses_of_three(m):
    return r6(tuning.blend_losses(_priced(m), [_probs(), _flat(), [F.lit(p) for p in (0.36, 0.30, 0.34)]]).drop("place"))


@query(SCORED + f", g as (select unnest(range(101)) as k), l as (select k, avg(-ln(k / 100.0 * py + (1 - k / 100.0) * {_FLAT_Y})) as loss from s, g group by k) select (arg_min(k, (loss, k)) / 100.0)::double as w0, (1 - arg_min(k, (loss, k)) / 100.0)::double as w1, round(min(loss), 6) as loss from l")
def simplex_blend_argmin(m):
    return r6(tuning.least(tuning.blend_losses(_priced(m), [_probs(), _flat()], 0.01)))


@query(SCORED + f"select round(avg(-ln({_FLAT_Y})), 6) as model, round(avg(-ln(py)), 6) as market, avg(-ln({_FLAT_Y})) < avg(-ln(py)) - 0.002 as allowed from s")
def mlp_gate(m):
    rows = _priced(m)
    return r6(tuning.mlp_allowed(rows.agg(metrics.log_loss(_flat()).alias("model"), metrics.log_loss(_probs()).alias("market"))))


@query(None)
def league_params(m):
    return r6(search.league_params(m, VALIDATION))


_Z = "ln(greatest(least({p}, 1 - 1e-12), 1e-12) / (1 - greatest(least({p}, 1 - 1e-12), 1e-12)))"


@query(FAIR + "select match_id, " + ", ".join(f"round({_Z.format(p=p)}, 6) as market_{leg}" for p, leg in zip(("ph", "pd", "pa"), O.LEGS)) + ", " + ", ".join(f"round({_Z.format(p=p)}, 6) as model_{leg}" for p, leg in zip((0.45, 0.27, 0.28), O.LEGS)) + ", round(ph, 6) as back_home from probs where ok = 1 and y is not null")
def meta_logits(m):
    logits = O.meta_logits(_flat(), _probs())
    rows = _priced(m).select("match_id", *[z.alias(f"{w}_{leg}") for w, part in (("model", logits[:3]), ("market", logits[3:])) for z, leg in zip(part, O.LEGS)])
    return r6(rows.withColumn("back_home", O.probs_from_logits([F.col(f"market_{leg}") for leg in O.LEGS])[0]))


@query(SCORED + "select match_id, round(0.6 * ph + 0.4 * 0.45, 6) as p_home, round(0.6 * pd + 0.4 * 0.27, 6) as p_draw, round(0.6 * pa + 0.4 * 0.28, 6) as p_away from s")
def blend_fixed(m):
    weights = O.effective_weights({"market": 0.6, "flat": 0.4, "net": 0.5}, excluded=("net",))
    mixed = O.blend([(_probs(), weights["market"]), (_flat(), weights["flat"])], _probs())
    return r6(_priced(m).select("match_id", *[p.alias(f"p_{leg}") for p, leg in zip(mixed, O.LEGS)]))


@query(SCORED + ", t as (select match_id, pow(ph, 1 / 1.5) as a, pow(pd, 1 / 1.5) as b, pow(pa, 1 / 1.5) as c from s) select match_id, round(a / (a + b + c), 6) as p_home, round(b / (a + b + c), 6) as p_draw, round(c / (a + b + c), 6) as p_away from t")
def temperature_scaled(m):
    return r6(_priced(m).select("match_id", *[p.alias(f"p_{leg}") for p, leg in zip(O.temperature(_probs(), 1.5), O.LEGS)]))


@query(BETS + f", e as (select unnest(['careful', 'usual', 'bold']) as strategy, unnest([0.2, 0.1, 0.05])::double as edge) select strategy, {TOTALS} from bets join e on ev > edge group by strategy")
def strategy_comparison(m):
    return reports.strategies(_bets(m), {"careful": 0.2, "usual": 0.1, "bold": 0.05})


@query(SCORED + f", q as (select avg(-ln(py)) as market, avg(-ln({_FLAT_Y})) as flat from s) select 1::bigint as place, 'market' as model, printf('%.3f', market) as value from q union all select 2::bigint, 'flat', printf('%.3f', flat) from q")
def report_rows(m):
    rows = reports.by_model(_priced(m), {"flat": _flat(), "market": _probs(), "other": _flat()})
    losses = rows.groupBy("model").agg(metrics.log_loss([F.col(f"p_{leg}") for leg in O.LEGS]).alias("log_loss"))
    return reports.report_rows(losses, ["market", "flat"], "log_loss")
