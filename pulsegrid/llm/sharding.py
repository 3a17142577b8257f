"""Sharding by longest-processing-time scheduling.

Rows that must stay together are a group. Groups are sorted by size, largest first, and each goes to the shard that has
the least so far, taken from a heap. Groups of equal size are interchangeable, so the schedule needs the sizes and how
often each occurs, not the groups: a run of equal groups is dealt in turns, which the heap's order gives at once. The
schedule is a short list of turns over the groups' places in the sorted order; each group finds its shard there by a
binary search, and no group is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Scratch, crc32_sql, fresh, keyed, ranked


class Schedule:
    """Turns: groups from the place `first[t]` on go to the shards `shards[at[t] : at[t + 1]]`, again and again."""

    def __init__(self, first: list[int], at: list[int], shards: list[int]):
        self.first, self.at, self.shards = np.array(first, np.int64), np.array(at, np.int64), np.array(shards, np.int32)

    def shard_of(self, place: np.ndarray) -> np.ndarray:
        t = np.searchsorted(self.first, place, side="right") - 1
        return self.shards[self.at[t] + (place - self.first[t]) % (self.at[t + 1] - self.at[t])]


def schedule(sizes: Iterable[tuple[int, int]], n_shards: int) -> tuple[Schedule, list[int]]:
    """The schedule and the loads of (size, number of groups), given by falling size: each group goes to the shard of the
    least load, of equal ones to that of the least number."""
    heap = [(0, s) for s in range(n_shards)]  # sorted, so a heap; it's short
    first, at, shards, place, whole = [], [0], [], 0, False

    def deal(turn: list[int], n: int) -> None:
        """n groups go to the shards of `turn`; single rounds are joined to one long turn."""
        nonlocal place, whole
        if n <= len(turn) and whole:
            shards.extend(turn[:n])
            at[-1] += n
        else:
            first.append(place)
            shards.extend(turn if n > len(turn) else turn[:n])
            at.append(len(shards))
            whole = n <= len(turn)
        place += n

    for size, n in sizes:
        while n:
            low = heap[0][0]
            active = [x for x in heap if x[0] < low + size]
            others = heap[len(active) :]
            rounds = n // len(active)
            if others:
                rounds = min(rounds, (others[0][0] - 1 - active[-1][0]) // size + 1)
            if rounds:
                dealt = rounds * len(active)
                active = [(load + rounds * size, s) for load, s in active]
            else:
                dealt = n
                active = [(load + size, s) if i < n else (load, s) for i, (load, s) in enumerate(active)]
            deal([s for _, s in heap[: len(active)]], dealt)
            n -= dealt
            heap = sorted(active + others)
    loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
    return Schedule(first, at, shards), loads


def shard(docs: DataFrame, scratch: Scratch, *, n_shards: int = 16, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes and 1), text_crc32, shard, slot (its place in the shard, from 0).

    Rows of one `group` (any column; by default the text) stay together, whatever share of all rows they have. A null text
    has no bytes and is the same group as the empty one, and so are null groups. Repeated rows are placed each; ids needn't
    be unique, and a null id comes first among the slots. Other columns aren't read, so names don't clash; an empty table
    gives none.

    Only sizes and their numbers are collected: d different sizes sum up to at least d * (d + 1) / 2 bytes, so there are at
    most sqrt(2 * all bytes) of them, 14 million at 100 TB. Texts are read once, to their hashes; groups are pre-aggregated.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard")
    key = fresh(docs, "row_key")[0]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts and groups of the same bytes have the same 128-bit hash.
    together = F.unhex(F.md5(text if group is None else F.coalesce(group.cast("string"), F.lit("")).cast("binary")))
    rows = keyed(docs, id_col, key, scratch).select(F.col(key).alias("k"), F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), together.alias("g"))
    rows = scratch.write(rows, "sized")
    groups = ranked(rows.groupBy("g").agg(F.sum("size").alias("bytes")), [F.col("bytes").desc(), F.col("g").asc()], "groups", scratch)
    counts = groups.groupBy("bytes").count().orderBy(F.col("bytes").desc()).toArrow()
    plan, loads = schedule(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True), n_shards)
    held = docs.sparkSession.sparkContext.broadcast(plan)
    schema = T.StructType([T.StructField("g", T.BinaryType()), T.StructField("shard", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.shard_of(b.column(1).to_numpy()), pa.int32())], ["g", "shard"])

    # Written, so that the adaptive join can split a hot group.
    placed = scratch.write(groups.select("g", "rank").mapInArrow(place, schema), "placed")
    out = ranked(rows.join(placed, "g").drop("g"), ["shard", "id", "k"], "sharded", scratch)
    first, total = [], 0
    in_shard = dict(out.groupBy("shard").count().collect())
    for s in range(n_shards):
        first.append(total)
        total += in_shard.get(s, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - start).alias("slot"))


def shard_digests(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return sharded.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
with recursive d as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
g as (select text, sum(size)::bigint as bytes, row_number() over (order by sum(size) desc, md5(text)) as i from d group by text),
lpt as (
  select 0::bigint as i, list_transform(range(16), lambda x: 0::bigint) as loads, 0::bigint as to_shard union all
  select g.i, list_transform(l.loads, lambda x, k: x + case when k = l.p then g.bytes else 0 end), l.p - 1
  from (select i, loads, list_position(loads, list_min(loads))::bigint as p from lpt) l join g on g.i = l.i + 1)
select doc_id, size::bigint as size, {crc32_sql('encode(text)')} as text_crc32, 'bytes' as law, to_shard::int as shard,
  row_number() over (partition by to_shard order by doc_id) - 1 as slot, null::int as grown_shard
from d join g using (text) join lpt using (i)
"""
