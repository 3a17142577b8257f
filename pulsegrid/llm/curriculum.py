"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule: its weight as a piecewise linear function of the training time
from 0 to 1. A source's documents stand in a fixed pseudo-random order, repeated as often as the target asks for; their
cumulative words are the source's demand. The integral of the schedule says what share of the demand is met by a time;
its inverse turns a document's place in the demand into a training position, by which documents are range-sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import WORD, Scratch, fresh, keyed, numbered, without

#: No document is taken more often than this.
MOST = 3
#: Hex digits of the order's hash that make a bucket: sums over buckets replace one long running sum for each source.
DIGITS = 3
#: Parts of a bucket where ids repeat, by the rows' content, and parts of a group of equal rows, so that no repeated or
#: missing id and no repeated row puts all its rows into one window.
SALTS = 64
#: Knots (time, weight) by source weight: light sources fade, heavy ones rise.
SCHEDULES: Mapping[int, Sequence[tuple[float, float]]] = {1: ((0.0, 1.5), (0.5, 1.25), (1.0, 0.25)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))}


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(share met at the start, time, weight, slope) of each segment; the whole integral is 1."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("knots run from time 0 to 1 and weights aren't negative")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    out, done = [], 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        out.append((done, t0, w0 / total, (w1 - w0) / (t1 - t0) / total))
        done += area / total
    return out


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which `share` of the demand is met: the inverse of the schedule's integral."""
    out = F.lit(0.0)
    for y0, t0, w, slope in segments(knots):
        y = F.greatest(share - F.lit(y0), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * y, F.lit(0.0)))
        step = F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (F.lit(w) + root))
        out = F.when(share >= y0, F.lit(t0) + step).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sizes: DataFrame, cycle: Sequence[int] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size -> also rank, weight, target: one row per source, in code point order, null last.

    Targets share the sum of all sizes by weight and stop at `most` times the source's size; the excess goes to the
    others by weight. Sources fill up in the order of size / weight, so those that stop are a prefix of that order. The
    windows run over one row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in cycle]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))).cast("int") + 1)
    named = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("rank"), w.alias("weight"))
    fill = W.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), "rank")
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    capped = named.withColumn("cap", F.lit(most) * F.col("source_size")).select(
        "*",
        F.sum("source_size").over(whole).alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("taken_before"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    full = capped.withColumn("full", F.col("cap").cast("double") * F.col("weight_left") < F.col("weight").cast("double") * (F.col("all") - F.col("taken_before")))
    left = full.select(
        "*",
        (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).alias("rest"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).alias("sharing"),
    )
    level = F.col("weight").cast("double") * F.col("rest") / F.col("sharing")
    return left.select("source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(level, F.col("cap").cast("double"))).alias("target"))


def plan_mix(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), content: Sequence[str] = (), seed: str = "mix", cycle: Sequence[int] = (1, 2, 3), schedules: Mapping[int, Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """One row per document: id, the `carry` columns, size, source_size, target, copies, taken, positions (one for each
    copy, in [0, 1]). The words taken are those of the copies that have a position.

    A null text has size 0, as an empty one. A null source is a source of its own. Where ids repeat or are missing, rows
    of one id stand in the order of their text and `content` columns; those that agree in all of them are interchangeable
    and get places next to each other. So positions don't depend on how the input is split. Other columns are not read,
    so names don't clash; an empty table gives none. A source without words gets a target of 0.
    """
    repeated = numbered(docs, id_col)
    sized = docs.select(
        F.col(id_col).alias("id"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
        (F.xxhash64(text_col, *content) if repeated else F.lit(0).cast("long")).alias("tie"),
        (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)) if repeated else F.lit(0).cast("long")).alias("salt"),
    )
    sized = scratch.write(sized.withColumn("sub", F.pmod("tie", F.lit(SALTS)) if repeated else F.lit(0).cast("long")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle)
    targets = scratch.write(targets.withColumn("no", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).drop("source"), "targets")
    rows = sized.withColumn("no", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).join(targets, ["no", "name"]).drop("no", "name", "source").withColumn("bucket", F.substring("h", 1, DIGITS))
    along = W.partitionBy("rank").orderBy("bucket", "sub")
    # Sources that are few but large: the running sum is over at most 16^DIGITS * SALTS rows of each.
    sums = rows.groupBy("rank", "bucket", "sub").agg(F.sum("size").alias("words")).select("rank", "bucket", "sub", (F.sum("words").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("start"))
    buckets = scratch.write(sums, "buckets")
    inside = W.partitionBy("rank", "bucket", "sub").orderBy("h", "size", "tie", "salt").rowsBetween(W.unboundedPreceding, 0)
    if repeated:
        # Equal rows are one entry for each salt, which says where they begin; a row's number among them says the rest.
        same = ["rank", "bucket", "sub", "h", "size", "tie", "salt"]
        entries = rows.groupBy(*same).agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(inside) - F.col("words"))
        nth = F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0))) - 1
        rows = rows.withColumn("nth", nth).join(scratch.write(entries.drop("words"), "entries"), same).withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    else:
        rows = rows.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    placed = rows.join(buckets, ["rank", "bucket", "sub"]).withColumn("offset", F.col("start") + F.col("before"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.col("target") - (F.col("full") * F.col("source_size")).cast("double")
    once_more = (F.lit(2) * F.col("offset") + F.col("size")).cast("double") < F.lit(2.0) * extra
    taken = placed.withColumn("full", full).withColumn("copies", (F.col("full") + F.when(once_more, 1).otherwise(0)).cast("long"))
    place = lambda k: F.least((k.cast("double") * F.col("source_size") + F.col("offset") + F.col("size") / F.lit(2.0)) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    position = lambda k: F.coalesce(*[F.when(F.col("weight") == x, time_of(place(k), schedules[x])) for x in dict.fromkeys(cycle)])
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    names = [*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "size", "source_size", "target", "copies"]
    return taken.withColumn("positions", positions).select(F.col("id").alias(id_col), *names, (F.col("size") * F.size("positions")).alias("taken"), "positions")


def schedule(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A plan with first_position and last_position in place of its positions (null for documents that aren't taken),
    range-sorted by the first, those that aren't taken last."""
    ends = plan.withColumn("first_position", F.try_element_at("positions", F.lit(1))).withColumn("last_position", F.try_element_at("positions", F.lit(-1))).drop("positions")
    order = [F.col("first_position").asc_nulls_last(), F.col(id_col).asc()]
    return ends.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row of `docs` for each copy that is taken, with its `position`, range-sorted by position.

    A null text and an empty one have no words, and are taken as often as the target asks for at their place. A column
    named position is replaced. Ties of the position are sorted by id; repeated rows are taken each on their own; an
    empty table gives none.
    """
    key, position = fresh(docs, "row_key", "position_")
    rows = keyed(docs, id_col, key, scratch)
    content = [c.name for c in docs.schema.fields if not isinstance(c.dataType, T.MapType)]
    plan = scratch.write(plan_mix(rows, scratch, id_col=id_col, carry=[key], content=content, **options).where("copies > 0").select(key, F.explode("positions").alias(position)), "plan")
    columns = without(docs, "position")
    taken = rows.join(plan, key).select(*columns, F.col(position).alias("position"))
    return taken.repartitionByRange(F.col("position"), F.col(id_col)).sortWithinPartitions("position", id_col)


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) - 1 as rank from d group by source),
w as (select *, rank % 3 + 1 as weight, 3 * source_size as cap from s),
f as (
  select *, sum(source_size) over ()::bigint as total, coalesce(sum(cap) over fill, 0)::bigint as before,
    (sum(weight) over () - coalesce(sum(weight) over fill, 0))::bigint as weight_left
  from w window fill as (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding)),
g as (select *, cap::double * weight_left < weight::double * (total - before) as stops from f),
l as (select *, (total - coalesce(sum(case when stops then cap end) over (), 0))::bigint as rest, sum(case when not stops then weight end) over ()::bigint as sharing from g),
t as (select *, case when stops then cap::double else least(weight::double * rest / sharing, cap::double) end as target from l),
o as (
  select d.doc_id, d.size, t.source_size, t.target, t.weight, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as n_full,
    (sum(d.size) over (partition by t.rank order by d.h, d.size rows between unbounded preceding and current row) - d.size)::bigint as start_at
  from d join t on d.source is not distinct from t.source),
m as (select *, n_full + case when (2 * start_at + size)::double < 2.0 * (target - (n_full * source_size)::double) then 1 else 0 end as copies from o),
y as (
  select *, least((start_at + size / 2.0::double) / greatest(target, 1.0), 1.0) as y0,
    least(((copies - 1)::double * source_size + start_at + size / 2.0::double) / greatest(target, 1.0), 1.0) as y1 from m)
select doc_id, size, source_size, target, copies, size * copies as taken,
  case when copies > 0 then round({first}, 9) end as first_position, case when copies > 0 then round({last}, 9) end as last_position
from y
"""


def _sql_time(share: str) -> str:
    """The inverse of the schedules' integrals in SQL."""
    cases = []
    for weight, knots in SCHEDULES.items():
        steps = [f"when {share} >= {y0!r}::double then {t0!r}::double + case when {share} <= {y0!r}::double then 0 else 2.0 * ({share} - {y0!r}::double) / ({w!r}::double + sqrt(greatest({w * w!r}::double + {2 * slope!r}::double * ({share} - {y0!r}::double), 0.0))) end" for y0, t0, w, slope in reversed(segments(knots))]
        cases.append(f"when weight = {weight} then least(case {' '.join(steps)} end, 1.0)")
    return f"case {' '.join(cases)} end"


ORACLE = ORACLE.replace("{first}", _sql_time("y0")).replace("{last}", _sql_time("y1"))
