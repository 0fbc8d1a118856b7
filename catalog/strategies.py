"""Panels, rule strategies, fitted rankings and the report bundle (H)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from catalog.aggregates import EVALUATED, KEYWORDS, NOT_NULL, RULE, RULE_LONG, TAGGED, _FEATS, evaluation_sql, rounded, rule_months, scored_months_sql, tagged
from catalog.ingest import data_sources, fundamentals, sovereign
from catalog.joins import FOLD_ROWS
from catalog.registry import MIN_ADV, query
from panelkit.functions import fixed_values as fv
from panelkit.plans import evaluate as E
from panelkit.plans import impute, models, panels, report, ridge, rules
from panelkit.session import shared_dir
from panelkit.sources import sinks

SURGE_COLS = ["symbol", "ym", "date", "sector_name", *fv.SURGE_FEATURES, "surge"]


@query("h1_surge_panel", f"select {', '.join(SURGE_COLS)} from surge_panel", " ".join([*fv.SURGE_FEATURES, "surge"]))
def _(c):
    return panels.surge_panel(c.m.prices, MIN_ADV, 0.25).select(*SURGE_COLS)


@query("h1_surge_panel_unlabelled", f"select symbol, ym, date, ret_60, surge from surge_rows where {' and '.join(f + ' is not null' for f in fv.SURGE_FEATURES)}", "ret_60 surge")
def _(c):
    return panels.surge_panel(c.m.prices, MIN_ADV, 0.25, require_label=False).select("symbol", "ym", "date", "ret_60", "surge")


@query("h2_feature_panel", f"select symbol, ym, date, sector_name, {_FEATS}, fwd_1, fwd_2, fwd_3, fut_elig, eligible from panel", " ".join([*fv.PANEL_FEATURES, "fwd_1", "fwd_2", "fwd_3"]))
def _(c):
    feats = [F.col(f).cast("double").alias(f) for f in fv.PANEL_FEATURES]
    return c.m.panel.select("symbol", "ym", "date", "sector_name", *feats, "fwd_1", "fwd_2", "fwd_3", "fut_elig", "eligible")


PICKS = f"""select s.ym, s.symbol, s.sector_name, cast(row_number() over (order by score desc nulls last, symbol) as int) as rank, score, mom_3m, close as entry_close, (select max(date) from eligible where ym = date '{{m}}') as entry_date,
 (select exposure from flags f where f.date <= (select max(date) from eligible where ym = date '{{m}}') order by f.date desc limit 1) as exposure from (select *, {RULE} as score from eligible where ym = date '{{m}}' window w as (partition by ym)) s where (select count(*) from eligible where ym = date '{{m}}') >= 5 order by score desc nulls last, symbol limit 5"""


@query("h3_rule_picks", f"select *, exposure >= 0.5 as risk_on from ({PICKS.format(m='1999-06-01')}) q", "score mom_3m entry_close exposure")
def _(c):
    return rules.picks_for(c.m.panel, c.m.market, "1999-06-01")


# marked as of the end of 2000
@query("h4_interim_performance", f"""with p as ({PICKS.format(m='1999-06-01')}), x as (select * from prices where date <= date '2000-12-29'), l as (select symbol, cumlog from x where date = (select max(date) from x)),
 z as (select p.*, exp(l.cumlog - e.cumlog) - 1 as ret from p left join prices e on e.symbol = p.symbol and e.date = p.entry_date left join l on l.symbol = p.symbol)
 select entry_date, (select max(date) from x) as as_of, exposure >= 0.5 as risk_on, count(ret) as legs, avg(ret) as basket_ret, case when exposure >= 0.5 then avg(ret) else 0.0 end as applied_ret, cast((select max(date) from x) - entry_date as int) as days_held from z group by entry_date, exposure""",
       "basket_ret applied_ret")
def _(c):
    picks = rules.picks_for(c.m.panel, c.m.market, "1999-06-01")
    return rules.interim_performance(rules.mark_to_latest(picks, c.m.prices, keep_unmarked=True, as_of="2000-12-29"))


@query("h5_gated_period_returns", """select cast(h as int) as H, count(*) as n, avg(ret) as avg_per_period, avg((ret > 0)::int) as pct_positive, exp(sum(ln(1+ret))) as multiple, min(eq/pk-1) as max_dd from (
 select *, max(eq) over (partition by h order by ym rows unbounded preceding) as pk from (select *, exp(sum(ln(1+ret)) over (partition by h order by ym rows unbounded preceding)) as eq from gated_periods) q) z group by h""", "avg_per_period pct_positive multiple max_dd")
def _(c):
    return rules.gated_summary(rules.gated_periods(c.m.panel, c.m.market, c.m.macro))


_LAST = "(select coalesce(max(ym) filter (d < (select max(date) from prices)), max(ym)) from (select ym, max(date) as d from eligible group by 1) q)"


@query("h6_live_summary", f"""with p as ({PICKS.replace("date '{m}'", _LAST)}), l as (select symbol, cumlog from prices where date = (select max(date) from prices)),
 z as (select p.*, exp(l.cumlog - e.cumlog) - 1 as ret from p left join prices e on e.symbol = p.symbol and e.date = p.entry_date left join l on l.symbol = p.symbol)
 select entry_date, (select max(date) from prices) as as_of, exposure >= 0.5 as risk_on, count(ret) as legs, avg(ret) as basket_ret, case when exposure >= 0.5 then avg(ret) else 0.0 end as applied_ret, cast((select max(date) from prices) - entry_date as int) as days_held,
 exp((select loglevel from levels order by date desc limit 1) - (select loglevel from levels v where v.date = entry_date)) - 1 as market_ret from z group by entry_date, exposure""", "basket_ret applied_ret market_ret")
def _(c):
    return rules.live_summary(c.m.panel, c.m.prices, c.m.market)


#: Learners with the library's rounds and depth; the leaves suit the tables' few symbols.
FULL = partial(models.regressor, leaf=20)
ROTATION = partial(models.regressor, depth=3, rounds=250, leaf=15)
HORIZONS = (1, 2, 3)


def _once(c, name: str, build):
    """Fits that several queries of a context report on are made once."""
    if name not in c.__dict__:
        c.__dict__[name] = build()
    return c.__dict__[name]


def walk(c):
    return _once(c, "walk", lambda: models.walk_forward(c.m.eligible, fv.PANEL_FEATURES, HORIZONS, FULL, 30, 300, 10))


def sector_walk(c):
    return _once(c, "sector_walk", lambda: models.walk_forward(c.m.sector_panel, fv.SECTOR_FEATURES, HORIZONS, ROTATION, 24, 120, 8, carry=("sector",)))


def folds_sql(rows: str, min_months: int, min_train: int, min_test: int, k: int) -> str:
    """Every fold of every horizon from rows (m, fwd_1, fwd_2, fwd_3) in SQL."""
    each = " union all ".join(
        f"""select {h} as H, cast(f.m as int) as fold, (select count(*) from p where p.m <= f.m - {h} and fwd_{h} is not null) as n_train, (select count(*) from p where p.m = f.m) as n_test,
 cast((select max(m) from p where p.m <= f.m - {h} and fwd_{h} is not null) as int) as last_train, (select count(*) from p where p.m = f.m) as n_scored, (select avg(fwd_{h}) from p where p.m = f.m) as universe, i from f"""
        for h in HORIZONS
    )
    return f"""with p as materialized ({rows}), f as (select m, dense_rank() over (order by m) as i from (select distinct m from p) q), a as ({each})
 select * exclude (i), least(n_test, {k}) as n_picks from a where i > {min_months} and n_train >= {min_train} and n_test >= {min_test}"""


@query("h7_time_split_classifier")
def _(c):
    return models.classifier_report(surge_fit(c)[1], "surge")


CUTOFF = "1999-07-01"
#: The last month of the tables with full candidates; later ones hold a few late lines.
PICK_MONTH = "2001-06-01"


@query("h7_split_sizes", f"""select count(*) filter (date < date '{CUTOFF}') as n_train, count(*) filter (date >= date '{CUTOFF}') as n_test, coalesce(sum(surge) filter (date < date '{CUTOFF}'), 0.0) as train_events, avg(surge) filter (date >= date '{CUTOFF}') as base_rate,
 count(*) filter (date >= date '{CUTOFF}') >= 200 and coalesce(sum(surge) filter (date < date '{CUTOFF}'), 0) >= 30 as sufficient from surge_panel""", "train_events base_rate")
def _(c):
    return models.split_sizes(panels.surge_panel(c.m.prices, MIN_ADV, 0.25), "surge", CUTOFF)


def surge_candidates(c):
    """Surge rows with and without a label, written once in a context."""
    return _once(c, "surge_candidates", lambda: panels.surge_panel(c.m.prices, MIN_ADV, 0.25, require_label=False))


def surge_fit(c):
    """(model, scored) of the surge classifier, fitted once in a context."""
    def build():
        panel = surge_candidates(c).dropna(subset=["surge"])
        return models.time_split_classifier(panel, fv.SURGE_FEATURES, "surge", CUTOFF, models.classifier("surge", leaf=20))

    return _once(c, "surge_fit", build)


@query("h7_verdict")
def _(c):
    sizes = models.split_sizes(panels.surge_panel(c.m.prices, MIN_ADV, 0.25), "surge", CUTOFF)
    return models.classifier_verdict(sizes, models.classifier_report(surge_fit(c)[1], "surge"))


@query("h9_auc_importance")
def _(c):
    model, scored = surge_fit(c)
    return models.permutation_importance(model, scored.drop("score"), fv.SURGE_FEATURES, "surge", 4, ["ym", "symbol"], metric="auc")


@query("h7_decile_sizes", f"""with s as (select * from surge_panel where date >= date '1999-07-01' and {' and '.join(f + ' is not null' for f in fv.SURGE_FEATURES)} and surge is not null), r as (select row_number() over () as k, count(*) over () as n, avg(surge) over () as base_rate from s)
 select cast(greatest(0, ceil((k - 1) * 10 / (n - 1)::double) - 1) as int) as decile, count(*) as n, any_value(base_rate) as base_rate from r group by 1""", "base_rate")
def _(c):
    return models.classifier_report(surge_fit(c)[1], "surge").select("decile", "n", "base_rate")


@query("h8_walk_forward_folds", folds_sql(FOLD_ROWS, 30, 300, 10, 5), "universe")
def _(c):
    return models.fold_report(*walk(c), k=5)


@query("h8_walk_forward")
def _(c):
    return E.score_summary(E.scored_months(walk(c)[0], k=5))


@query("h8_sector_walk_forward")
def _(c):
    scored = sector_walk(c)[0].withColumnRenamed("sector", "symbol")
    return E.rotation_summary(E.scored_months(scored, k=3), c.m.macro)


# ---- the same folds by ridge regression, fitted again in SQL
D = len(fv.PANEL_FEATURES)
RIDGE_ROWS = f"select m, symbol, ym, [1.0, {', '.join(f'cast({f} as double)' for f in fv.PANEL_FEATURES)}] as x, unnest([1, 2, 3]) as h, unnest([fwd_1, fwd_2, fwd_3]) as fwd from {FOLD_ROWS} q"


def solved_sql(sums: str) -> str:
    """(h, fold, n, base, mean, sd, weight) from sums of products (h, fold, i, j, s), i <= j,
    of (1, features, outcome): standardised, penalised, and eliminated row by row."""
    d = D + 2
    return f"""with recursive s as materialized ({sums}),
 one as materialized (select h, fold, max(s) filter (i = 1 and j = 1) as n, list(s order by j) filter (i = 1) as first, list(s order by i) filter (i = j) as diagonal from s group by h, fold),
 cov as materialized (select s.h, s.fold, i, j, s / n - first[i] / n * first[j] / n as c from s join one o on s.h = o.h and s.fold = o.fold),
 dev as materialized (select h, fold, list(case when c > {ridge.FLAT} * sq then sqrt(c) else 0.0 end order by i) as sd from (
  select c.*, diagonal[i] / n as sq from cov c join one o on c.h = o.h and c.fold = o.fold where i = j and i between 2 and {d - 1}) q group by h, fold),
 cell as (select v.h, v.fold, a, b, case when sd[a] > 0 and b <= {D} and sd[b] > 0 then c / sd[a] / sd[b] when sd[a] > 0 and b > {D} then c / sd[a] else 0.0 end + case when a = b then {ridge.LAMBDA} else 0.0 end as v
  from (select h, fold, i - 1 as a, j - 1 as b, c from cov where i >= 2 and i < {d} union all select h, fold, j - 1, i - 1, c from cov where i >= 2 and j > i and j < {d}) v join dev on v.h = dev.h and v.fold = dev.fold),
 system as materialized (select h, fold, list(line order by a) as lines from (select h, fold, a, list(v order by b) as line from cell group by h, fold, a) q group by h, fold),
 step as (
  select h, fold, 0 as k, lines from system
  union all
  select h, fold, k + 1, list_transform(lines, lambda line, a: case when a = k + 1 then lead_row else list_transform(line, lambda v, b: v - line[k + 1] * lead_row[b]) end)
  from (select h, fold, k, lines, list_transform(lines[k + 1], lambda v: v / lines[k + 1][k + 1]) as lead_row from step where k < {D}) q)
 select o.h, o.fold, cast(round(n) as bigint) as n, first[{d}] / n as base, list_transform(first[2:{d - 1}], lambda v: v / n) as mean, sd, list_transform(lines, lambda line: line[{D + 1}]) as weight
 from one o join dev on o.h = dev.h and o.fold = dev.fold join step on o.h = step.h and o.fold = step.fold and k = {D}"""


PRODUCTS = f"(select h, m, i, j, sum(z[i] * z[j]) as s from (select h, m, list_append(x, fwd) as z from ({RIDGE_ROWS}) q where fwd is not null) r, (select unnest(range(1, {D + 3})) as i) a, (select unnest(range(1, {D + 3})) as j) b where i <= j group by all)"
RIDGE_FITS = solved_sql(f"select f.H as h, f.fold, i, j, sum(s) as s from ({folds_sql(FOLD_ROWS, 30, 300, 10, 5)}) f join {PRODUCTS} p on p.h = f.H and p.m <= f.fold - f.H group by all")
LINEAR = "base + list_sum(list_transform(range(1, {d} + 1), lambda i: case when sd[i] > 0 then weight[i] * (x[i + 1] - mean[i]) / sd[i] else 0.0 end))".replace("{d}", str(D))
RIDGE_SCORED = f"(select r.h, r.ym, r.symbol, r.m as fold, {LINEAR} as score, r.fwd from ({RIDGE_ROWS}) r join ({RIDGE_FITS}) f on f.h = r.h and f.fold = r.m)"
NAMES = "[" + ", ".join(f"'{f}'" for f in fv.PANEL_FEATURES) + "]"


def ridge_fits(c):
    return _once(c, "ridge_fits", lambda: ridge.walk_forward_fits(c.m.eligible, fv.PANEL_FEATURES, HORIZONS, 30, 300, 10))


def ridge_scored(c):
    return _once(c, "ridge_scored", lambda: ridge.scored(c.m.eligible, ridge_fits(c), fv.PANEL_FEATURES, HORIZONS))


@query("h8_ridge_weights", f"select cast(h as int) as H, fold, n, unnest({NAMES}) as feature, unnest(weight) as weight from ({RIDGE_FITS}) q", "weight")
def _(c):
    return ridge.weights(ridge_fits(c)).select("H", "fold", "n", "feature", "weight")


@query("h8_ridge_scores", f"select cast(h as int) as H, fold, ym, symbol, score, fwd from {RIDGE_SCORED} q", "score fwd")
def _(c):
    return ridge_scored(c)


@query("h8_ridge_walk_forward", evaluation_sql(scored_months_sql(RIDGE_SCORED, 0)), EVALUATED)
def _(c):
    return E.score_summary(E.scored_months(rounded(ridge_scored(c), "score", "fwd"), k=5))


RIDGE_TEST = f"""with l as materialized ({RIDGE_ROWS}), cut as (select min(m) as m from (select distinct year(ym)*12+month(ym) as m from eligible where fwd_1 is not null order by m desc limit 18) q)"""


@query("h9_ridge_importance", f"""{RIDGE_TEST}, f as materialized ({solved_sql(f"select h, 0 as fold, i, j, sum(s) as s from {PRODUCTS} p where h = 1 and m < (select min(m) from (select distinct year(ym)*12+month(ym) as m from eligible where fwd_1 is not null order by m desc limit 18) q) - 1 group by all")}),
 t as (select fwd as y, fwd - ({LINEAR}) as e, unnest({NAMES}) as feature, unnest(x[2:]) as v, unnest(list_transform(range(1, {D} + 1), lambda i: case when sd[i] > 0 then weight[i] / sd[i] else 0.0 end)) as b from l, f where l.h = 1 and fwd is not null and m >= (select m from cut))
 select feature, (2 * any_value(b) * covar_pop(e, v) + 2 * any_value(b) * any_value(b) * var_pop(v)) / var_pop(y) as importance from t group by feature""", "importance")
def _(c):
    return ridge.expected_importance(*ridge.held_out_fit(c.m.eligible, fv.PANEL_FEATURES, 1))


@query("h9_shuffled_copies", f"""with l as (select *, year(ym)*12+month(ym) as m from eligible where fwd_1 is not null), cut as (select min(m) as m from (select distinct m from l order by m desc limit 18) q),
 t as (select * from l where m >= (select m from cut) and {NOT_NULL})
 select feature, cast(rep as int) as rep, count(*) as n from t, (values {", ".join(f"('{f}')" for f in fv.PANEL_FEATURES)}) f(feature), (select unnest(range(5)) as rep) r group by 1, 2""")
def _(c):
    _, test = models.embargoed_split(c.m.eligible, "fwd_1", 1)
    copies = models.shuffled_copies(test.dropna(subset=[*fv.PANEL_FEATURES, "fwd_1"]), fv.PANEL_FEATURES, 5, ["ym", "symbol"])
    return copies.groupBy("feature", "rep").agg(F.count(F.lit(1)).alias("n"))


@query("h9_permutation_importance")
def _(c):
    train, test = models.embargoed_split(c.m.eligible, "fwd_1", 1)
    model = models.fitted(FULL("fwd_1"), models.assembled(train, fv.PANEL_FEATURES, "fwd_1"), len(fv.PANEL_FEATURES))
    return models.permutation_importance(model, test, fv.PANEL_FEATURES, "fwd_1", 5, ["ym", "symbol"])


@query("h10_current_picks")
def _(c):
    return models.current_picks(c.m.eligible, fv.PANEL_FEATURES, HORIZONS, FULL, 5, ym=F.lit(PICK_MONTH).cast("date"))


@query("h10_current_screen")
def _(c):
    panel = panels.surge_panel(c.m.prices, MIN_ADV, 0.25, require_label=False)
    return models.current_screen(surge_fit(c)[0], panel, fv.SURGE_FEATURES).select("ym", "symbol", "sector_name", "rank", "score", "ret_60", "dist_252h")


_SCREENED = f"(select * from surge_rows where {' and '.join(f + ' is not null' for f in fv.SURGE_FEATURES)})"


@query("h10_screen_places", f"select date, cast(row_number() over () as int) as rank from {_SCREENED} q where date = (select max(date) from {_SCREENED} z) limit 15")
def _(c):
    panel = panels.surge_panel(c.m.prices, MIN_ADV, 0.25, require_label=False)
    return models.current_screen(surge_fit(c)[0], panel, fv.SURGE_FEATURES).select("date", "rank")


@query("h10_sector_picks")
def _(c):
    return models.current_picks(c.m.sector_panel, fv.SECTOR_FEATURES, HORIZONS, ROTATION, 3, name="sector", ym=F.lit(PICK_MONTH).cast("date"), min_train=120)


@query("h10_pick_places", f"""with p as (select *, year(ym)*12+month(ym) as m from eligible where {NOT_NULL}), h as (select unnest([1, 2, 3]) as H)
 select H, date '{PICK_MONTH}' as ym, cast(r as int) as rank from h, (select unnest(range(1, 6)) as r) k where (select count(*) from p where ym = date '{PICK_MONTH}') >= 5
 and (select count(*) from p where m <= year(date '{PICK_MONTH}')*12+month(date '{PICK_MONTH}') - H and case H when 1 then fwd_1 when 2 then fwd_2 else fwd_3 end is not null) >= 300""")
def _(c):
    return models.current_picks(c.m.eligible, fv.PANEL_FEATURES, HORIZONS, FULL, 5, ym=F.lit(PICK_MONTH).cast("date")).select("H", "ym", "rank")


def live(c):
    return _once(c, "live", lambda: impute.live_rows(c.m.eligible, fv.PANEL_FEATURES, HORIZONS, F.lit(PICK_MONTH).cast("date")))


LIVE_AT = f"year(date '{PICK_MONTH}')*12+month(date '{PICK_MONTH}')"
LIVE = f"(select *, year(ym)*12+month(ym) <= {LIVE_AT} - h and fwd is not null as is_train from (select ym, symbol, {_FEATS}, unnest([1, 2, 3]) as h, unnest([fwd_1, fwd_2, fwd_3]) as fwd from eligible) q where (year(ym)*12+month(ym) <= {LIVE_AT} - h and fwd is not null) or ym = date '{PICK_MONTH}')"
LIVE_LONG = f"(select h, symbol, is_train, unnest({NAMES}) as feature, unnest([{', '.join(fv.PANEL_FEATURES)}]) as v from {LIVE} q)"
LIVE_MEDIANS = f"(select h, feature, quantile_cont(v, 0.5) as median from {LIVE_LONG} q where is_train and v is not null group by 1, 2)"


@query("h10_live_candidates", f"select h as H, count(*) filter (is_train) as n_train, count(*) filter (not is_train) as n_candidates, count(*) filter (not is_train and not ({NOT_NULL})) as n_incomplete, count(*) filter (is_train) >= 200 and count(*) filter (not is_train) >= 5 as sufficient from {LIVE} q group by 1")
def _(c):
    return impute.candidate_counts(live(c), fv.PANEL_FEATURES, 5, 200)


@query("h10_live_medians", f"select h as H, feature, median from {LIVE_MEDIANS} q", "median")
def _(c):
    return impute.fitted_medians(live(c), fv.PANEL_FEATURES)


@query("h10_live_imputed", f"select l.h as H, symbol, l.feature, coalesce(v, median, 0.0) as value, v is null as missing from {LIVE_LONG} l left join {LIVE_MEDIANS} m on m.h = l.h and m.feature = l.feature where not is_train", "value")
def _(c):
    done = impute.filled(live(c), impute.fitted_medians(live(c), fv.PANEL_FEATURES), fv.PANEL_FEATURES).filter("not is_train")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), (F.col(f"{f}_missing") == 1).alias("missing")) for f in fv.PANEL_FEATURES])
    return done.select("H", "symbol", F.inline(cells))


@query("h10_model_picks_live")
def _(c):
    picks = impute.live_picks(c.m.eligible, fv.PANEL_FEATURES, HORIZONS, FULL, 5, ym=F.lit(PICK_MONTH).cast("date"))
    entry = c.m.eligible.select("ym", "symbol", F.col("date").alias("entry_date"))
    return rules.mark_to_latest(picks.join(entry, ["ym", "symbol"]), c.m.prices, keep_unmarked=True)


@query("h11_context_records", f"select cast(h as int) as H, ym, top, uni, spread, postdip, risk_on, easing, high_infl, budget from ({TAGGED}) q", "top uni spread")
def _(c):
    return tagged(c).select("H", "ym", "top", "uni", "spread", "postdip", "risk_on", "easing", "high_infl", "budget")


_ORDERS = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query("h12_document_tables", f"""select 'fundamentals' as section, count(distinct o_custkey) as rows from {_ORDERS} union all select 'fundamentals_eps', count(distinct (o_custkey, year(o_orderdate))) from {_ORDERS}
 union all select 'sovereign_ratings', count(distinct (n_name, cast(o_orderdate as date))) from {_ORDERS} where o_orderpriority = '1-URGENT' union all select 'sovereign_spells', count(distinct (n_name, cast(o_orderdate as date))) from {_ORDERS} where o_orderpriority = '1-URGENT'
 union all select 'sovereign_external_debt', count(distinct (r_name, year(o_orderdate))) from {_ORDERS} union all select 'sovereign_imf_programs', count(distinct (r_name, cast(o_orderdate as date))) from {_ORDERS} where o_orderpriority = '1-URGENT'
 union all select 'sovereign_macro_annual', count(distinct (r_name, year(o_orderdate))) from {_ORDERS} union all select 'data_sources', count(*) from pages""")
def _(c):
    tables = report.document_tables(fundamentals(c), sovereign(c), data_sources(c))
    return report.section_index(c.spark, sinks.write_bundle(report.shaped(tables), shared_dir(c.spark, "documents-bundle")))


@query("h12_report_tables")
def _(c):
    m = c.m
    graph = c.view("sector_graph").select("sector", F.col("sector").alias("name"), "downstream", "sensitivity")
    tables = report.side_by_side(m, [
        lambda: report.panel_tables(m),
        lambda: report.ranking_tables(m, walk(c)[0], sector_walk(c)[0], tagged(c)),
        lambda: report.predictor_tables(*surge_fit(c), surge_candidates(c), CUTOFF),
        lambda: report.connection_tables(m, graph, c.view("causal_chains")),
        lambda: report.history_tables(m, 0.25, -0.2, "Sector 7"),
        lambda: report.market_tables(m, "1998-07-01"),
        lambda: report.event_tables(m, c.view("catalog_events"), ["1-URGENT", "2-HIGH"]),
        lambda: report.context_tables(c.view("news"), KEYWORDS, c.view("flows"), c.view("client_flows")),
        lambda: report.document_tables(fundamentals(c), sovereign(c), data_sources(c)),
    ])
    path = shared_dir(c.spark, "report")
    return report.section_index(c.spark, sinks.write_bundle(report.shaped(tables), path))
