"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are sorted by ranges
of that key; sums per range and their prefix sums show which range holds the cut at the
source's exact budget, and only that range is sorted row by row. Whole epochs come first,
the cut falls in the last one. Rows are never moved for it: each document compares its own
key with its source's cut.

Defined cases: a null text has size 0; a null source is a source of its own and comes last;
sources without words have target 0; repeated rows (same id and size) that share the cut
get equal parts of what is left; a null id hashes as the empty string; extra columns are
ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import WORD, size_bounded, unwrapped, wrapped
from panelkit.operators.ranks import prefix_sums
from panelkit.session import materialize

#: Leading hex digits of the key that name its range: 4096 ranges for each source.
RANGE_DIGITS = 3
#: Sources up to which their table of cuts is broadcast.
BROADCAST_SOURCES = 100_000


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: str | Column, seed: int) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(totals: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 1, 2, 3, repeating
    in code point order with null last; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight. One level satisfies all: sorted by
    most * size / weight, sources before the level are full, the others get level * weight."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = prefix_sums(totals.select("source", "source_size"), [], order, "mix-rank", at=F.lit(1).cast("long"))
    full = F.col("source_size") * most
    weighed = ranked.withColumn("w", F.col("at") % 3 + 1).withColumn("full", full).withColumn("ratio", F.col("full") / F.col("w"))
    level_order = [F.col("ratio"), *order]
    sums = materialize(prefix_sums(weighed, [], level_order, "mix-level", below=F.col("full"), spent=F.col("w")), "mix-targets")
    everything, weights = sums.select(F.sum("source_size")).scalar(), sums.select(F.sum("w")).scalar()
    level = sums.withColumns({"left": everything - F.col("below"), "rest": weights - F.col("spent")})
    first = level.filter(F.col("left") / F.col("rest") <= F.col("ratio")).select(F.min(F.struct(F.col("ratio"), *order, F.col("left"), F.col("rest"))).alias("m"))
    share = (first.select("m.left").scalar() * F.col("w")).cast("double") / first.select("m.rest").scalar()
    return sums.select("source", "source_size", F.coalesce(F.least(F.col("full").cast("double"), share), F.lit(0.0)).alias("target"))


def cuts(sized: DataFrame, most: int = 3) -> DataFrame:
    """One row for each source of ``sized`` (source, size, key): source_size, target,
    ``epochs`` taken whole, and the place of the cut in the last one: documents with
    (key, size) before ``cut`` are taken once more, those at it give ``part`` words."""
    rng = F.substring("key", 1, RANGE_DIGITS)
    ranges = materialize(sized.groupBy("source", rng.alias("rng")).agg(F.sum("size").alias("words")), "mix-ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    budget = F.floor("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("left", budget - F.col("epochs") * F.col("source_size")), "mix-plan")
    by_range = Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    run = ranges.withColumn("before", F.coalesce(F.sum("words").over(by_range), F.lit(0)))
    few = size_bounded(plan.select(F.col("source").alias("_s"), "left"), BROADCAST_SOURCES)
    held = run.join(few, F.col("source").eqNullSafe(F.col("_s"))).filter("before <= left and left < before + words")
    held = materialize(held.select(F.col("source").alias("_s"), F.col("rng").alias("_r"), (F.col("left") - F.col("before")).alias("inside")), "mix-held")
    rows = sized.withColumn("rng", rng).join(size_bounded(held, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")) & (F.col("rng") == F.col("_r")))
    same = rows.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("inside").alias("inside"))
    in_range = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("acc", F.coalesce(F.sum(F.col("size") * F.col("n")).over(in_range), F.lit(0)))
    at = same.filter("acc <= inside and inside < acc + size * n")
    at = at.select(F.col("source").alias("_s"), F.struct("key", "size").alias("cut"), F.floor((F.col("inside") - F.col("acc")) / F.col("n")).cast("long").alias("part"))
    out = plan.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "left")
    return materialize(out, "mix-cuts")


def with_cuts(rows: DataFrame, cut_table: DataFrame) -> DataFrame:
    """Rows (source, key, size, ...) beside their source's cut."""
    table = size_bounded(cut_table.withColumnRenamed("source", "_s"), BROADCAST_SOURCES)
    return rows.join(table, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(documents: DataFrame, seed: int = 17, most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken): ``taken`` words of each document, with
    repeats; a source's sum is its target's whole part (repeated rows at the cut may leave
    less than a word each)."""
    sized = materialize(documents.select("doc_id", "source", size_of("text").alias("size"), key_of("doc_id", seed).alias("key")), "mix-sizes")
    joined = with_cuts(sized, cuts(sized, most))
    own = F.struct("key", "size")
    last = F.when(own < F.col("cut"), F.col("size")).when(own == F.col("cut"), F.col("part")).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, seed: int = 17, most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Texts stay whole: the
    document at a cut is taken once more if at least half of it lies before the cut."""
    sized = documents.select("source", size_of("text").alias("size"), key_of("doc_id", seed).alias("key"))
    table = cuts(materialize(sized, "mix-sizes"), most)
    rows = wrapped(documents)
    rows = rows.select("_row", F.col("_row")["source"].alias("source"), size_of(F.col("_row")["text"]).alias("size"), key_of(F.col("_row")["doc_id"], seed).alias("key"))
    rows = with_cuts(rows, table)
    own = F.struct("key", "size")
    last = F.when(own < F.col("cut"), 1).when((own == F.col("cut")) & (2 * F.col("part") >= F.col("size")) & (F.col("part") > 0), 1).otherwise(0)
    times = (F.coalesce("epochs", F.lit(0)) + last).cast("int")
    return unwrapped(rows.select("_row", F.explode(F.array_repeat(F.lit(0), times))), documents.columns)


#: DuckDB SQL for ``mix`` over ``documents``, the same steps without ranges.
MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('17:' || coalesce(doc_id::varchar, '')) as key from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as w, 3 * source_size as full_size from totals),
sums as (select *, full_size / w::double as ratio,
  coalesce(sum(full_size) over (order by full_size / w::double, source is null, source rows between unbounded preceding and 1 preceding), 0) as below,
  coalesce(sum(w) over (order by full_size / w::double, source is null, source rows between unbounded preceding and 1 preceding), 0) as spent from weighed),
whole as (select sum(source_size) as all_size, sum(w) as weights from sums),
lvl as (select (all_size - below)::bigint as left_size, (weights - spent)::bigint as rest from sums, whole
  where (all_size - below)::double / (weights - spent)::double <= ratio order by ratio, source is null, source limit 1),
plan as (select source, source_size, coalesce(least(full_size::double, (left_size * w)::double / rest), 0.0) as target from sums left join lvl on true),
plan2 as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from plan),
plan3 as (select *, floor(target)::bigint - epochs * source_size as rest_words from plan2),
grouped as (select source, key, size, count(*) as n from sized group by all),
run as (select *, coalesce(sum(size * n) over (partition by source order by key, size rows between unbounded preceding and 1 preceding), 0) as acc from grouped)
select s.doc_id, s.size, p.source_size, p.target,
  (p.epochs * s.size + case when r.acc + r.size * r.n <= p.rest_words then s.size when r.acc <= p.rest_words then (p.rest_words - r.acc) // r.n else 0 end)::bigint as taken
from sized s join plan3 p on s.source is not distinct from p.source
join run r on r.source is not distinct from s.source and r.key = s.key and r.size = s.size
"""
