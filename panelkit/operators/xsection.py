"""Cross-sections: z-scores, picks, rank correlation, profiles, deciles, AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import stats as S
from panelkit.operators import ranks
from panelkit.operators.months import calendar_broadcast
from panelkit.session import materialize


def zscores(df: DataFrame, columns: dict[str, Column], key: str | list[str] = "ym") -> DataFrame:
    """Adds z-scores of expressions per month. The moments come from a group-by that
    combines map-side, and one row per month joins back, so a month with very many
    symbols is never gathered in one task."""
    keys = [key] if isinstance(key, str) else key
    staged = df.withColumns({f"_x_{n}": c for n, c in columns.items()})
    moments = staged.groupBy(*keys).agg(
        *[F.avg(f"_x_{n}").alias(f"_m_{n}") for n in columns],
        *[F.stddev_samp(f"_x_{n}").alias(f"_s_{n}") for n in columns],
    )
    scored = staged.join(calendar_broadcast(moments), keys).withColumns(
        {n: (F.col(f"_x_{n}") - F.col(f"_m_{n}")) / (F.col(f"_s_{n}") + S.TINY) for n in columns}
    )
    return scored.drop(*[f"_{p}_{n}" for p in "xms" for n in columns])


def top_k(df: DataFrame, score: str, k: int, keys: list[str], tie: str = "symbol", largest: bool = True) -> DataFrame:
    """First k rows per group; nulls last and ties by ``tie``. Spark prunes each task
    to k rows per group before the shuffle."""
    order = F.desc_nulls_last(score) if largest else F.asc_nulls_last(score)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).filter(F.col("rank") <= k)


def top_fraction(df: DataFrame, score: str, keys: list[str], frac: float, least: int, min_rows: int, tie: str = "symbol") -> DataFrame:
    """Marks ``is_top`` and ``is_bottom``: the first and last max(least, n * frac) rows
    of each group, for groups of at least ``min_rows``."""
    sizes = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    big = df.filter(F.col(score).isNotNull()).join(calendar_broadcast(sizes.filter(F.col("n") >= min_rows)), keys)
    k = F.greatest(F.lit(least), F.floor(F.col("n") * frac).cast("int"))
    ranked = ranks.first_come(big, keys, score, tie)
    return ranked.withColumns({"is_top": F.col("rank_down") <= k, "is_bottom": F.col("rank_up") <= k}).drop("rank_up", "rank_down")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group over complete rows, with group size and the number of
    distinct x. Doubles are ranked as they are; a caller that wants sums of different
    order to tie rounds them first."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    return _ic_of_ranks(ranks.averaged(pairs, keys, {"_x": "rx", "_y": "ry"}), keys)


def _ic_of_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.groupBy(*keys).agg(
        S.pearson("rx", "ry").alias("ic"), F.count("rx").alias("n"),
        F.round(F.sum(1 / F.col("rx_ties"))).cast("long").alias("n_distinct"),
    )


def rank_ic(panel: DataFrame, features: list[str], label: str, min_rows: int = 12, min_months: int = 6) -> DataFrame:
    """Monthly rank correlation of every feature with the label, summarised: mean, t
    (population deviation), share of positive months, months.

    Features of a month that are known for the same labels share the label's ranks, which
    are taken once. Ranks of values and of labels come from one pass over distinct values."""
    wide = panel.filter(F.col(label).isNotNull()).select("ym", F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double") for f in features])
    long = wide.unpivot(["ym", "_y"], features, "feature", "_x").filter("_x is not null")
    # equal sets of labels have equal sums of two hashes, in halves that cannot overflow
    hashes = [F.xxhash64("_y", F.lit(k)) for k in (1, 2)]
    halves = [h for w in hashes for h in (F.sum(w.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(w, 32)))]
    sizes = long.groupBy("ym", "feature").agg(F.count("_x").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.struct(*halves).alias("_set"))
    # month-wide constants go before any rank is taken: minimum equals maximum
    varied = sizes.filter((F.col("n") >= min_rows) & (F.col("_lo") < F.col("_hi")))
    shared = F.min("feature").over(Window.partitionBy("ym", "n", "_set"))
    varied = materialize(varied.select("ym", "feature", shared.alias("_of")), "rank-ic-sets")
    rows = long.join(calendar_broadcast(varied), ["ym", "feature"])  # a row per month and feature
    counted = rows.groupBy("ym", F.col("feature").alias("_k"), F.col("_x").alias("_v")).agg(F.count(F.lit(1)).alias("_ties")).withColumn("_is_x", F.lit(True))
    labels = rows.filter("feature = _of").groupBy("ym", F.col("_of").alias("_k"), F.col("_y").alias("_v")).agg(F.count(F.lit(1)).alias("_ties")).withColumn("_is_x", F.lit(False))
    placed = ranks.prefix_sums(counted.unionByName(labels), ["ym", "_k", "_is_x"], [F.col("_v")], "rank-ic", _before=F.col("_ties"))
    placed = placed.select("ym", "_k", "_v", "_is_x", "_ties", (F.col("_before") + (F.col("_ties") + 1) / 2).alias("_rank"))
    of_x = placed.filter("_is_x").select("ym", F.col("_k").alias("feature"), F.col("_v").alias("_x"), F.col("_rank").alias("rx"), F.col("_ties").alias("rx_ties"))
    of_y = placed.filter("not _is_x").select("ym", F.col("_k").alias("_of"), F.col("_v").alias("_y"), F.col("_rank").alias("ry"))
    ranked = rows.join(of_x, ["ym", "feature", "_x"]).join(of_y, ["ym", "_of", "_y"])
    monthly = _ic_of_ranks(ranked, ["ym", "feature"]).filter(
        (F.col("n") >= min_rows) & (F.col("n_distinct") > 3) & F.col("ic").isNotNull()
    )
    g = monthly.groupBy("feature").agg(
        F.avg("ic").alias("mean_ic"), S.t_of_mean("ic", population=True).alias("t"),
        S.share_true(F.col("ic") > 0).alias("hit"), F.count("ic").alias("n_months"),
    )
    return g.filter(F.col("n_months") >= min_months)


def profile_diff(panel: DataFrame, features: list[str], label: str, k: int = 5) -> DataFrame:
    """Standardised mean difference of each feature between a month's k best rows by
    label and all other rows."""
    labelled = panel.filter(F.col(label).isNotNull())
    best = top_rows(panel, label, k).select("ym", "symbol", F.lit(True).alias("_top"))
    marked = labelled.join(calendar_broadcast(best), ["ym", "symbol"], "left").fillna(False, ["_top"])
    long = marked.select("_top", *[F.col(f).cast("double") for f in features]).unpivot(["_top"], features, "feature", "value")
    return long.groupBy("feature").agg(
        F.avg(F.when(F.col("_top"), F.col("value"))).alias("surger_mean"),
        F.avg(F.when(~F.col("_top"), F.col("value"))).alias("other_mean"),
        F.stddev_samp("value").alias("_s"),
    ).select("feature", "surger_mean", "other_mean", ((F.col("surger_mean") - F.col("other_mean")) / (F.col("_s") + S.TINY)).alias("std_diff"))


def top_rows(panel: DataFrame, label: str, k: int = 5) -> DataFrame:
    """A month's k best labelled rows."""
    return top_k(panel.filter(F.col(label).isNotNull()), label, k, ["ym"])


def surger_summary(top: DataFrame, label: str) -> DataFrame:
    return top.agg(
        F.count(label).alias("n_surgers"), F.avg(label).alias("avg_fwd"), S.median(label).alias("median_fwd"), F.min(label).alias("min_fwd")
    )


def sector_mix(rows: DataFrame, top: int = 8) -> DataFrame:
    """Share of each sector among rows, largest first."""
    total = rows.select(F.count(F.lit(1))).scalar()
    return rows.groupBy(F.col("sector_name").alias("sector")).agg((F.count(F.lit(1)) / total * 100).alias("pct")) \
        .orderBy(F.desc("pct"), "sector").limit(top)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve by rank sums with ties averaged. Rows are
    counted per distinct score first, so a score shared by very many rows is one row."""
    counted = df.groupBy(score).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("double")).alias("pos"))
    placed = ranks.rows_before(counted, score, (), "rows", "before")
    r = F.col("before") + (F.col("rows") + 1) / 2
    g = placed.agg(F.sum(r * F.col("pos")).alias("rs"), F.sum("pos").alias("p"), F.sum(F.col("rows") - F.col("pos")).alias("q"))
    return g.select(
        F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"),
        F.col("p").cast("long").alias("positives"), F.col("q").cast("long").alias("negatives"),
    )


def decile_lift(df: DataFrame, score: str, label: str, spread: str = "ym", tie: str = "symbol", buckets: int = 10) -> DataFrame:
    """Event rate, size and lift over the base rate per equal-count score decile. Rows
    that share a score are taken by ``spread``, then ``tie``: counts per (score,
    spread) place each slice, and only a slice is numbered row by row."""
    n = df.select(F.count(F.lit(1))).scalar()
    base = df.select(F.avg(label)).scalar()
    slices = df.groupBy(score, spread).agg(F.count(F.lit(1)).alias("rows"))
    placed = ranks.rows_before(slices, score, (spread,), "rows", "before").drop("rows")
    inside = F.row_number().over(Window.partitionBy(score, spread).orderBy(tie))
    ranked = df.join(placed, [score, spread]).withColumn("_rn", F.col("before") + inside)
    g = ranked.withColumn("decile", S.decile_of(F.col("_rn"), n, buckets)).groupBy("decile").agg(
        F.avg(label).alias("rate"), F.count(label).alias("n")
    )
    return g.withColumn("lift", F.col("rate") / base)


def base_rates(panel: DataFrame, label: str, min_n: int = 50) -> DataFrame:
    """Event rate by sector, for sectors with at least ``min_n`` rows."""
    g = panel.groupBy("sector_name").agg(F.avg(label).alias("surge_rate"), F.count(label).alias("n"))
    return g.filter(F.col("n") >= min_n)
