"""Removal of byte strings that repeat anywhere in the corpus, by bucket-pointer refinement.

A suffix array of every position is far larger than its text, so the buckets hold a part of the positions that is chosen
by content: of each 200-byte window the leftmost q-gram of least hash, its anchor. Equal windows have equal anchors at
equal offsets, so only windows whose anchors share a bucket can be equal, and about one position in 80 is kept.

Initial buckets are the anchors' q-grams. First, anchors whose windows all agree are settled together and send one
member on, so a passage with thousands of copies costs as much as one with two. The rest is refined as in a suffix array:
a bucket is a pointer to its first member, and stands for the bytes that all its members share. The offsets of the
windows are halved (into SPLIT parts) again and again; each part shares more bytes than the whole, to the left and to the
right, and (pointer, bytes at those offsets) names its bucket: the pointers found in one round are the sort keys of the
next. A bucket of one member holds no repeated window and is left; members that agree on all bytes that the windows of a
part cover are settled, and one of them goes on. After the last round each part is a single window.

Only the q-grams and the first classes are told apart by 64-bit hashes (within a bucket, so on 128 bits); refinement
compares 128 bits as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Scratch, fresh, keyed, without
from pulsegrid.llm.rolling import U, RangeHash, mix

#: Length of the strings and of the q-grams, and the parts that a range of offsets is cut into each round.
LENGTH, Q, SPLIT = 200, 40, 6
#: Windows of a text that are handled together; bounds the memory of very long texts.
TOGETHER = 1 << 20
_HIGH, _LOW = U(0xFFFFFFFF00000000), U(0xFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w values, by running minima forwards and backwards in blocks of w."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, ~U(0))
    padded[: len(x)] = x
    table = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, length: int = LENGTH, q: int = Q) -> list[np.ndarray]:
    """Position, q-gram identifier, identifier of all its windows, least and greatest offset, for each anchor."""
    hashed = RangeHash(raw)
    at = np.arange(len(raw) - q + 1)
    grams = hashed.of(at, at + q)
    chosen = (sliding_min((grams & _HIGH) | at.astype(U), length - q + 1) & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    pos = chosen[first]
    low, high = pos - last, pos - first
    return [pos, grams[pos], mix(hashed.of(first, last + length) + (low * 1024 + high).astype(U)), low, high]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "pos", "q", "u", "low", "high"]
    for b in batches:
        out: list[list[np.ndarray]] = []
        size = 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            for start in range(0, len(raw) - LENGTH + 1, TOGETHER):
                pos, *rest = anchors(raw[start : start + TOGETHER + LENGTH - 1])
                out.append([np.full(len(pos), key), pos + start, *rest])
                size += len(pos)
            if size > 100_000:
                yield _batch(out, names)
                out, size = [], 0
        if out:
            yield _batch(out, names)


def _batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    types = [pa.int16() if n in ("low", "high") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(cols, types, strict=True)], names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted anchor's q-gram that its windows cover, left and right."""
    for b in batches:
        for low in range(0, b.num_rows, 64):
            rows = [(k, t.encode(), w) for k, t, w in zip(*(b.column(i).slice(low, 64).to_pylist() for i in range(3)), strict=True)]
            keys, wanted = [k for k, _, ws in rows for _ in ws], [w for _, _, ws in rows for w in ws]
            left = [t[w["pos"] - w["high"] : w["pos"]] for _, t, ws in rows for w in ws]
            right = [t[w["pos"] + Q : w["pos"] - w["low"] + LENGTH] for _, t, ws in rows for w in ws]
            cols = [pa.array([w[c] for w in wanted], kind) for c, kind in (("q", pa.int64()), ("pos", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("single", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *cols, pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["key", "q", "pos", "low", "high", "single", "left", "right"])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _apply(n_cols: int, text_at: int):
    """Appends the removed runs and the bytes that stay to the first `n_cols` columns; the spans come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            runs, left = [], []
            for text, spans in zip(b.column(text_at), b.column(n_cols), strict=True):
                raw = (text.as_py() or "").encode()
                found = merge([(s["a"], s["b"]) for s in spans.as_py() or []])
                runs.append([{"start": s, "end": e} for s, e in found])
                left.append(b"".join(raw[s:e] for s, e in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], pa.array(runs, kind), pa.array(left, pa.binary())], [*b.schema.names[:n_cols], "removed", "kept_bytes"])

    return run


def repeated_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, a, b): byte ranges of `rows` (key, text) whose union is what repeats."""
    found = scratch.write(rows.mapInArrow(_anchors, "key long, pos long, q long, u long, low short, high short"), "anchors")
    # Written first, so that the join below is of two plain tables and a hot bucket can be split.
    again = scratch.write(found.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("q"), "again")
    hot = scratch.write(found.join(again, "q"), "hot")
    scratch.drop("anchors", "again")
    same = ["q", "u", "low", "high"]
    classes = scratch.write(hot.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("one")), "classes")
    spans = lambda df, first, last: df.select("key", (F.col("pos") - F.col(last)).alias("a"), (F.col("pos") - F.col(first) + LENGTH).alias("b"))
    whole = scratch.write(spans(hot.join(classes.where("n > 1").select(*same), same), "low", "high"), "whole")
    scratch.drop("hot")

    several = scratch.write(classes.groupBy("q").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("q"), "several")
    part = classes.join(several, "q").select("one.key", F.struct("q", "one.pos", "low", "high", (F.col("n") == 1).alias("single")).alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    context = rows.join(part, "key").select("key", "text", "wanted").mapInArrow(_contexts, "key long, q long, pos long, low int, high int, single boolean, left binary, right binary")
    # The pointer of an initial bucket is the q-gram itself; members get numbers, which later pointers name.
    whole_range = [F.lit(0).alias("first"), F.lit(LENGTH - Q).alias("last")]
    member = context.select(F.monotonically_increasing_id().alias("m"), "key", "pos", "single", F.col("q").alias("pointer"), *whole_range, "low", "high", "left", "right")
    state = scratch.write(member, "refined-0")
    scratch.drop("classes", "several")
    found_spans, width, turn = [whole], LENGTH - Q + 1, 0
    while width > 1:
        width, turn = -(-width // SPLIT), turn + 1
        state = _refine(state, width, scratch, turn)
        found_spans.append(spans(state.where("single and copies > 1"), "low", "high"))
        if turn > 1:
            scratch.drop(f"parted-{turn - 1}", f"shared-{turn - 1}", f"equal-{turn - 1}")
        state = state.where("copies = 1 or m = head").drop("copies", "head")
    return reduce(DataFrame.unionByName, found_spans)


def _refine(state: DataFrame, width: int, scratch: Scratch, turn: int) -> DataFrame:
    """One round: every range of offsets [first, last] of `state` in parts of `width`, for the members whose bucket has
    others, with copies (members that agree on all that the part's windows cover) and head (the first of them).

    A row's windows are those of the offsets [low, high]; what all windows of a range share reaches from `first` bytes
    before the q-gram to `last` before the end of the last window, and left and right hold the bytes beyond that.
    """
    n = F.ceil((F.col("last") - F.col("first") + 1) / F.lit(width)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.col("first") + i * width).alias("a"), F.least(F.col("first") + i * width + (width - 1), F.col("last")).alias("b")))
    each = state.withColumn("p", F.explode(F.filter(parts, lambda p: (p["a"] <= F.col("high")) & (p["b"] >= F.col("low")))))
    low, high = F.greatest("low", "p.a"), F.least("high", "p.b")
    # Bytes nearest to the shared ones: the end of `left`, the start of `right`.
    near = F.col("p.a") - F.col("first")
    ahead = F.col("last") - F.col("p.b")
    beyond = F.octet_length("left") - near
    cut = lambda c, start, size: F.substring(c, start + 1, F.greatest(size, F.lit(0)))
    more = [cut(F.col("left"), beyond, near), cut(F.col("right"), F.lit(0), ahead)]
    parted = each.select(
        "m", "key", "pos", "single", "pointer", F.col("p.a").alias("first"), F.col("p.b").alias("last"), low.alias("low"), high.alias("high"),
        F.xxhash64(*more).alias("s1"), F.xxhash64(F.lit(1), more[1], more[0]).alias("s2"),
        cut(F.col("left"), beyond - (high - F.col("p.a")), high - F.col("p.a")).alias("left"), cut(F.col("right"), ahead, F.col("p.b") - low).alias("right"),
    )
    inner = ["pointer", "first", "last", "s1", "s2"]
    parted = scratch.write(parted, f"parted-{turn}")
    shared = scratch.write(parted.groupBy(*inner).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("to")).where("n > 1").drop("n"), f"shared-{turn}")
    bucket = parted.join(shared, inner).drop("s1", "s2", "pointer").withColumnRenamed("to", "pointer")
    named = bucket.withColumns({"e1": F.xxhash64("left", "right"), "e2": F.xxhash64(F.lit(1), "right", "left")})
    outer = ["pointer", "first", "last", "low", "high", "e1", "e2"]
    equal = scratch.write(named.groupBy(*outer).agg(F.count(F.lit(1)).alias("copies"), F.min("m").alias("head")), f"equal-{turn}")
    return scratch.write(named.join(equal, outer).drop("e1", "e2"), f"refined-{turn}")


def remove_repeats(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with removed (array of struct(start, end), the maximal runs of removed bytes) and kept_bytes.

    A null text counts as empty; texts of fewer than 200 bytes are kept whole. Repeated rows are copies of each other
    and lose all that is long enough, whether they share an id or not. An empty table gives none; columns of the new
    names are replaced.
    """
    cols = without(docs, "removed", "kept_bytes")
    key, spans = fresh(docs, "row_key", "spans_")
    rows = keyed(docs.select(*cols), id_col, key, scratch)
    input_ = rows.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    found = repeated_spans(input_, scratch).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias(spans))
    found = scratch.write(found, "spans")
    scratch.drop("whole", *(f"{name}-{turn}" for name in ("refined", "parted", "shared", "equal") for turn in range(9)))
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kept = rows.select(*cols)
    schema = T.StructType([*kept.schema.fields, T.StructField("removed", runs), T.StructField("kept_bytes", T.BinaryType())])
    return rows.join(found.withColumnRenamed("key", key), key, "left").select(*cols, spans).mapInArrow(_apply(len(cols), cols.index(text_col)), schema)


def span_digests(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of `docs` (doc_id, text)."""
    out = remove_repeats(docs.select("doc_id", "text"), scratch)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept_bytes")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
part as (select doc_id, b, substr(x, 2 * b + 1, 1398) as y from (select doc_id, x, unnest(range(0, length(x) // 2 - 199, 500)) as b from d where length(x) >= 400)),
w as (select doc_id, b + o as a, md5(substr(y, 2 * o + 1, 400)) as h from (select doc_id, b, y, unnest(range(0, length(y) // 2 - 199)) as o from part)),
hot as (select h from w group by h having count(*) > 1),
s as (select doc_id, a, lag(a) over (partition by doc_id order by a) as b from w join hot using (h)),
r as (select doc_id, a, sum(case when a <= b + 200 then 0 else 1 end) over (partition by doc_id order by a) as run from s),
g as (select doc_id, min(a) as a, max(a) + 200 as e from r group by doc_id, run),
c as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as before, lead(a) over (partition by doc_id order by a) as next from g),
k as (
  select doc_id, count(*) as n_spans, sum(e - a) as n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(x), 2 * max(e) + 1) as kept
  from c join d using (doc_id) group by doc_id)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join k using (doc_id)
"""
