"""Periodic runs of words by grammar compression.

A document's word ids are compressed by Re-Pair: the most frequent pair of neighbours becomes a nonterminal, until no pair
occurs twice. Halving what is left gives one binary derivation tree. A run lies whole inside the lowest node that holds
it, and crosses the boundary between that node's two parts; so the runs across each nonterminal's boundary are computed
once, on one of its expansions, and translated to all places where the nonterminal is derived. Intervals of one period
that lie inside another are merged into it, and periods that are multiples of the true one go.

Every word of a run with three periods occurs three times in it. So a document is first cut at the words it holds less
often, and only stretches that are long enough are compressed; no run is lost by that.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import crc32_sql

#: A run has at least this many words and this many periods.
LEAST, PERIODS = 24, 3


def re_pair(symbols: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """The rules and the sequence that Re-Pair leaves. Symbols are numbered from 0; rule k is the symbol max + 1 + k.

    Of equally frequent pairs the smallest goes first; occurrences are replaced from the left, so that pairs of equal
    symbols don't overlap.
    """
    n, first = len(symbols), max(symbols, default=-1) + 1
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        places.setdefault((sym[i], sym[i + 1]), set()).add(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapify(heap)
    rules = []
    while heap:
        count, pair = heappop(heap)
        at = places.get(pair, ())
        if len(at) != -count:
            if len(at) > 1:
                heappush(heap, (-len(at), pair))
            continue
        a, b = pair
        new, changed = first + len(rules), set()
        rules.append(pair)
        for i in sorted(places.pop(pair)):
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            left, right = before[i], after[j]
            if left >= 0:
                places.get((sym[left], a), set()).discard(left)
                places.setdefault((sym[left], new), set()).add(left)
                changed.add((sym[left], new))
            if right < n:
                places.get((b, sym[right]), set()).discard(j)
                places.setdefault((new, sym[right]), set()).add(i)
                changed.add((new, sym[right]))
                before[right] = i
            sym[i], sym[j], after[i] = new, -1, right
        for p in changed:
            if len(places[p]) > 1:
                heappush(heap, (-len(places[p]), p))
    return rules, [s for s in sym if s >= 0]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common prefix."""
    n, low, step = min(len(a), len(b)), 0, 64
    while low < n:
        differ = a[low : low + step] != b[low : low + step] if low + step <= n else a[low:n] != b[low:n]
        if differ.any():
            return low + int(differ.argmax())
        low, step = low + step, 2 * step
    return n


def crossing(word: np.ndarray, o: int, m: int, e: int, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(period, start, end) of the runs inside word[o:e] that cross the boundary before m, relative to o.

    Half of a run's words stand on one side, with half of its periods, so the words next to the boundary on that side
    are equal to those a period away; that leaves few periods to be measured. A multiple of a period already measured
    gives the same run as long as it ends inside it.
    """
    found = []
    half = (least + 1) // 2
    for right in (True, False):
        side = e - m if right else m - o
        most = min((e - o) // periods, 2 * side // periods)
        if side < half or most < 1:
            continue
        fixed = word[m : m + half] if right else word[m - half : m][::-1]
        other = word[m:e] if right else word[o:m][::-1]
        q = np.flatnonzero(other[1 : most + 1] == fixed[0]) + 1
        for j in range(1, half):
            # By q words and the share of the half that is left: max(half, q * periods / 2) - q words must agree.
            must = np.maximum(half, q * periods // 2) - q > j
            at = np.minimum(q + j, len(other) - 1)
            q = q[~must | (other[at] == fixed[j])]
        while len(q):
            p = int(q[0])
            if right:
                end, start = m + p + _same(word[m : e - p], word[m + p : e]), m - _same(word[o:m][::-1], word[o + p : m + p][::-1])
            else:
                end, start = m + _same(word[m - p : e - p], word[m:e]), m - p - _same(word[o : m - p][::-1], word[o + p : m][::-1])
            if end - start >= max(least, periods * p):
                found.append((p, start - o, end - o))
            reach = end - m if right else m - start
            q = q[(q > p) & ((q % p != 0) | (q >= reach))]
    return found


def runs_of(word: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of an array of word ids from 0, sorted by start and period."""
    found: dict[int, set[tuple[int, int]]] = {}
    n = len(word)
    often = np.bincount(word)[word] >= periods if n else np.zeros(0, bool)
    edge = np.diff(np.concatenate([[0], often.view(np.int8), [0]]))
    for low, high in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if high - low >= least:
            _stretch(word, int(low), int(high), found, least, periods)
    kept: dict[int, list[tuple[int, int]]] = {}
    for period in sorted(found):
        last = -1
        for start, end in sorted(found[period], key=lambda x: (x[0], -x[1])):
            if end > last:
                last = end
                if not any(period % q == 0 and any(s <= start and end <= t for s, t in spans) for q, spans in kept.items() if q < period):
                    kept.setdefault(period, []).append((start, end))
    return sorted((s, e - s, q) for q, spans in kept.items() for s, e in spans)


def _stretch(word: np.ndarray, low: int, high: int, found: dict[int, set[tuple[int, int]]], least: int, periods: int) -> None:
    """Adds the runs of word[low:high] to `found`, by its grammar."""
    ids, symbols = np.unique(word[low:high], return_inverse=True)
    rules, sequence = re_pair(symbols.tolist())
    base = len(ids)
    size = [1] * base
    for a, b in rules:
        size.append(size[a] + size[b])
    starts = low + np.concatenate([[0], np.cumsum([size[s] for s in sequence])])
    derived: list[list[np.ndarray]] = [[] for _ in size]
    for s, at in zip(sequence, starts.tolist(), strict=False):
        if size[s] >= least:
            derived[s].append(np.array([at]))
    for k in range(len(rules) - 1, -1, -1):
        node = base + k
        if size[node] < least or not derived[node]:
            continue
        places, (a, b) = np.concatenate(derived[node]), rules[k]
        derived[node] = []
        if size[a] >= least:
            derived[a].append(places)
        if size[b] >= least:
            derived[b].append(places + size[a])
        o = int(places[0])
        for period, start, end in crossing(word, o, o + size[a], o + size[node], least, periods):
            found.setdefault(period, set()).update(zip((places + start).tolist(), (places + end).tolist(), strict=True))
    # What Re-Pair leaves is halved, near the middle word, down to single symbols; each of these nodes occurs once.
    todo = [(0, len(sequence))]
    while todo:
        i, j = todo.pop()
        o, e = int(starts[i]), int(starts[j])
        if j - i < 2 or e - o < least:
            continue
        k = min(max(int(np.searchsorted(starts, (o + e) // 2)), i + 1), j - 1)
        for period, start, end in crossing(word, o, int(starts[k]), e, least, periods):
            found.setdefault(period, set()).add((o + start, o + end))
        todo += [(i, k), (k, j)]


def ids_of(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether a word stands in a run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] > 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's contract: one document in ten, by the crc32 of its id, repeats a part of itself to its end.
    A null id counts as the empty text."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, periods: int = PERIODS, plant: bool = False) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; sorted by start and period), runs_sha256,
    collapsed (the words but for those that a run repeats, joined by a space).

    A null text has no words, as an empty one; repeated rows are judged each; a null id stays null. Other columns aren't
    read, so names don't clash; an empty table gives none. Documents are independent, so there is no shuffle; a
    document's grammar takes memory in proportion to its longest stretch of words that occur three times.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n_words", "runs", "runs_sha256", "collapsed"]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed", T.StringType())])
    run_type = pa.list_(pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                n_words, all_runs, digests, collapsed = [], [], [], []
                for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                    words = text.as_py().encode().split()
                    if plant:
                        words = planted(words, doc_id.as_py())
                    runs = runs_of(ids_of(words), least, periods) if len(words) >= least else []
                    n_words.append(len(words))
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    digests.append(hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest())
                    if runs:
                        gone = dropped(runs, len(words))
                        words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(all_runs, run_type), pa.array(digests, pa.string()), pa.array(collapsed, pa.string())], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document the number of runs, the run of most periods, and the digests. Lengths are compared by cross
    products, so the order of length / period is exact. Rows of a document without runs hold nulls for the best."""
    # Of a and b: more periods first, then the earlier start, then the shorter period.
    more = "a.length * b.period > b.length * a.period or (a.length * b.period = b.length * a.period and (a.start, a.period) < (b.start, b.period))"
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 1)), try_element_at(runs, 1), (b, a) -> if({more}, a, b))")
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs from all pairs of equal words of a document: those of one distance that stand next to each other.
ORACLE = rf"""
with d as (
  select row_number() over () as r, doc_id, {crc32_sql("encode(coalesce(doc_id::varchar, ''))")} as h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
n as (select *, len(words)::bigint as n, h // 10 as g from d),
a as (select *, case when n > 0 then g % n else 0 end as a from n),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
i as (select *, unnest(range(n)) as i from p),
w as (select r, n, i, words[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end] as word from i),
often as (select *, count(*) over (partition by r, word) as c from w),
pairs as (select x.r, x.i, y.i - x.i as q from often x join often y on x.r = y.r and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 3 where x.c >= 3),
marked as (select *, i - row_number() over (partition by r, q order by i) as island from pairs),
spans as (select r, q, min(i) as s, count(*) + q as len from marked group by r, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (
  select * from spans x where not exists (
    select 1 from spans y where y.r = x.r and y.q < x.q and x.q % y.q = 0 and y.s <= x.s and x.s + x.len <= y.s + y.len)),
best as (select r, s, len, q, row_number() over (partition by r order by len::double / q desc, s, q) as nth from runs),
listed as (select r, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as text from runs group by r),
gone as (select distinct r, unnest(range(s + q, s + len)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as text from w anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, len::bigint as length, q::bigint as period, (1000 * len // q)::bigint as exponent_milli,
  sha256(coalesce(listed.text, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join listed using (r) left join kept using (r) left join (select * from best where nth = 1) b using (r)
"""
