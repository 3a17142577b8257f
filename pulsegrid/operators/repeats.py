"""Removal of repeating events: fixed sources show the same time differences between the same detectors again and again."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import EVENT, REPEAT_BUFFER, REPEAT_HISTORY, REPEAT_NS, REPEAT_PAIRS

Pairs = dict[tuple[str, str], float]


def sequence(events: DataFrame) -> DataFrame:
    """Each event's place in its file, in the order of its key as a string, from 1."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("file").orderBy(F.col("event_key").cast("string"))))


def fingerprints(hits: DataFrame) -> DataFrame:
    """file, event_key, du_a, du_b, dt_ns of every pair of an event, times cut to whole ns."""
    return _pairs(_listed(hits))


def _listed(hits: DataFrame) -> DataFrame:
    """One row per event with its hits in the order of the detectors' ids as strings, times cut to whole ns."""
    hit = F.struct(F.col("du_id").cast("string").alias("name"), "du_id", F.col("time_ns").cast("long").alias("time_ns"))
    return hits.where(F.col("file").isNotNull() & F.col("event_key").isNotNull()).groupBy(*EVENT).agg(F.array_sort(F.collect_list(hit)).alias("listed"))


def _pairs(listed: DataFrame) -> DataFrame:
    """A row for each pair of `listed`, made within the row, so that hits are neither joined nor derived twice."""
    later = lambda h, i: F.filter(F.slice("listed", i + 2, F.size("listed")), lambda g: h["name"] < g["name"])
    pair = lambda h, g: F.struct(h["du_id"].alias("du_a"), g["du_id"].alias("du_b"), (h["time_ns"] - g["time_ns"]).alias("dt_ns"))
    every = F.flatten(F.transform("listed", lambda h, i: F.transform(later(h, i), lambda g: pair(h, g))))
    rest = [c for c in listed.columns if c != "listed"]
    return listed.select(*rest, F.explode(every).alias("pair")).select(*rest, "pair.*")


def sequence_prints(events: DataFrame, hits: DataFrame, least: int = REPEAT_PAIRS) -> DataFrame:
    """Fingerprints of the events that the filter looks at (with a clock and at least two hits) and that have at least `least` pairs, with
    the place (seq) among all that it looks at.

    Events of fewer pairs take their places but can't have `least` in common with any. The hits are derived once: they ride
    along to the numbering and are paired after it.
    """
    with_clock = events.where("gps_time is not null").select(*EVENT)
    numbered = sequence(_listed(hits).where(F.size("listed") >= 2).join(with_clock, EVENT))
    n = F.size("listed")
    return _pairs(numbered.where(n * (n - 1) / 2 >= least))


def similar_events(prints: DataFrame, *, threshold: float = REPEAT_NS, least: int = REPEAT_PAIRS, reach: int | None = None, same_file: bool = True) -> DataFrame:
    """Pairs of events (key_a < key_b) with at least `least` common detector pairs whose differences are closer than
    `threshold`; with `reach`, only within so many places of the sequence (prints then need seq).

    With a reach, the key holds blocks of the sequence, and the second side looks into its own block and the one before: at
    most twice the reach of events meet there, though a source may fire in each. Without one it is a band join: differences
    fall into buckets as wide as the threshold, and the second side looks into its own bucket and both neighbours.
    """
    keys = ["du_a", "du_b", "span" if reach else "bucket", *(["file"] if same_file else [])]
    if reach:
        span = F.floor(F.col("seq") / reach).cast("long")
        side, near = prints.withColumn("span", span), prints.withColumn("span", F.explode(F.array(span - 1, span)))
    else:
        side = prints.withColumn("bucket", F.floor(F.col("dt_ns") / threshold).cast("long"))
        near = side.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    names = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("event_key", "dt_ns", *(["seq"] if reach else []), *([] if same_file else ["file"]))]
    # The first side is later in the sequence: it looks back into its own block and the one before.
    a, b = near.select(*keys, *names("a")), side.select(*keys, *names("b"))
    later = (F.col("seq_b") < F.col("seq_a")) & (F.col("seq_a") - F.col("seq_b") <= reach) if reach else F.col("event_key_b") < F.col("event_key_a")
    if not same_file:
        later = F.struct("file_b", "event_key_b") < F.struct("file_a", "event_key_a")
    who = ["event_key_a", "event_key_b", *(["file"] if same_file else ["file_a", "file_b"])]
    hit = a.join(b, keys).where(later & (F.abs(F.col("dt_ns_a") - F.col("dt_ns_b")) < threshold))
    return hit.groupBy(*who).agg(F.count(F.lit(1)).alias("n_common")).where(F.col("n_common") >= least)


def without_repeats(events: DataFrame, hits: DataFrame, reach: int = REPEAT_BUFFER, **limits) -> DataFrame:
    """Events that have no similar event within `reach` places of their file; those without a clock or with fewer than
    two hits pass (`sequence_prints`). It equals the sequential filter where no similar pair lies farther apart than its buffer."""
    prints = sequence_prints(events, hits, limits.get("least", REPEAT_PAIRS))
    found = similar_events(prints, reach=reach, **limits)
    members = found.select("file", F.explode(F.array("event_key_a", "event_key_b")).alias("event_key")).distinct()
    return events.join(members, EVENT, "left_anti")


class _Postings:
    """Fingerprints by number, and for each pair of detectors who has it and when; they leave in the order they came."""

    def __init__(self, prints: Iterable[Pairs]):
        self.by_pair: dict[tuple[str, str], deque[tuple[int, float]]] = {}
        self.first, self.next = 0, 0
        for p in prints:
            self.add(p)

    def add(self, pairs: Pairs) -> None:
        for k, t in pairs.items():
            self.by_pair.setdefault(k, deque()).append((self.next, t))
        self.next += 1

    def drop_first(self, pairs: Pairs) -> None:
        """Forgets the oldest fingerprint, which is `pairs`."""
        for k in pairs:
            held = self.by_pair[k]
            held.popleft()
            if not held:
                del self.by_pair[k]
        self.first += 1

    def alike(self, pairs: Pairs, threshold: float, least: int) -> Iterator[int]:
        """The places, counted from the oldest, of those with at least `least` pairs closer than `threshold`, as they are found."""
        close: dict[int, int] = {}
        for k, t in pairs.items():
            for number, other in self.by_pair.get(k, ()):
                if abs(t - other) < threshold:
                    n = close[number] = close.get(number, 0) + 1
                    if n == least:
                        yield number - self.first


class RepeatFold:
    """The sequential filter of one file: a look-back buffer of live events and a history of removed fingerprints.

    Both members of a similar pair are removed. `push` takes the events in order and returns keys that are now known to
    stay; `flush` the rest; `removed` collects the keys of the others. The whole state is picklable. An event is compared
    with those that share a pair of detectors with it, not with all of both lists, which may be filled before the first push.
    """

    def __init__(self, threshold: float = REPEAT_NS, buffer: int = REPEAT_BUFFER, least: int = REPEAT_PAIRS, history: int = REPEAT_HISTORY):
        self.threshold, self.size, self.least = threshold, buffer, max(least, 1)
        self.live: deque[list] = deque()
        self.gone: deque[Pairs] = deque(maxlen=history)
        self.removed: list = []
        self.of_live: _Postings | None = None
        self.of_gone: _Postings | None = None

    def _forget(self, pairs: Pairs) -> None:
        if self.gone.maxlen is not None and len(self.gone) == self.gone.maxlen:
            if not self.gone:
                return
            self.of_gone.drop_first(self.gone[0])
        self.gone.append(pairs)
        self.of_gone.add(pairs)

    def push(self, key: str, pairs: Pairs) -> Iterator[str]:
        if self.of_live is None:
            self.of_live, self.of_gone = _Postings(e[1] for e in self.live), _Postings(self.gone)
        if len(pairs) >= self.least:
            if next(self.of_gone.alike(pairs, self.threshold, self.least), None) is not None:
                self._forget(pairs)
                self.removed.append(key)
                return
            found = [i for i in self.of_live.alike(pairs, self.threshold, self.least) if not self.live[i][2]]
            if found:
                entry = self.live[min(found)]
                entry[2] = True
                self._forget(entry[1])
                self._forget(pairs)
                self.removed += [entry[0], key]
                return
        self.live.append([key, pairs, False])
        self.of_live.add(pairs)
        while len(self.live) > self.size:
            old = self.live.popleft()
            self.of_live.drop_first(old[1])
            if not old[2]:
                yield old[0]

    def flush(self) -> Iterator[str]:
        while self.live:
            old = self.live.popleft()
            if self.of_live is not None:
                self.of_live.drop_first(old[1])
            if not old[2]:
                yield old[0]


def pairs_of(dus: Iterable[int], times: Iterable[float]) -> Pairs:
    """The fingerprint of an event's hits, detectors ordered by their ids as strings."""
    found = sorted((str(d), int(t)) for d, t in zip(dus, times, strict=True))
    return {(a, b): s - t for i, (a, s) in enumerate(found) for b, t in found[i + 1 :]}


def fold_sorted(batches: Iterable[pd.DataFrame], removed: bool = False, **limits) -> Iterator[pd.DataFrame]:
    """The events that stay, or those that are removed, of whole files one after the other, each in order; rows have file,
    event_key, dus, times.

    One fold is carried along the rows and flushed where the file changes, so only its buffer and history are held.
    """
    fold, file, first = RepeatFold(**limits), None, True

    def settled(stay: Iterator[str]) -> list[tuple]:
        """What a step of the fold settles."""
        keys = list(stay)
        if removed:
            keys, fold.removed = fold.removed, []
        else:
            fold.removed.clear()
        return [(file, k) for k in keys]

    for rows in batches:
        out: list[tuple] = []
        for of, key, dus, times in zip(rows["file"], rows["event_key"], rows["dus"], rows["times"], strict=True):
            if first or of != file:
                out += settled(fold.flush())
                fold, file, first = RepeatFold(**limits), of, False
            out += settled(fold.push(key, pairs_of(dus, times)))
        yield pd.DataFrame(out, columns=["file", "event_key"], dtype=object)
    yield pd.DataFrame(settled(fold.flush()), columns=["file", "event_key"], dtype=object)


def packed(events: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per eligible event with its detectors and times as arrays."""
    each = hits.groupBy(*EVENT).agg(F.collect_list(F.struct("du_id", "time_ns")).alias("h")).where(F.size("h") >= 2)
    mine = each.join(events.where("gps_time is not null").select(*EVENT), EVENT)
    return mine.select("file", F.col("event_key").cast("string").alias("event_key"), F.col("h.du_id").alias("dus"), F.col("h.time_ns").alias("times"))


def sequential_filter(events: DataFrame, hits: DataFrame, **limits) -> DataFrame:
    """Events that the sequential filter keeps, file by file, and those that it doesn't look at.

    The order within a file is part of the definition, so a file is never dealt to two tasks.
    """
    return events.join(filter_listed(packed(events, hits), removed=True, **limits), EVENT, "left_anti")


def filter_listed(listed: DataFrame, removed: bool = False, **limits) -> DataFrame:
    """The same filter for (file, event_key, dus, times) rows, none of which passes unseen; or the events that it removes."""
    rows = listed.repartition("file").sortWithinPartitions("file", "event_key").select("file", "event_key", "dus", "times")
    return rows.mapInPandas(lambda batches: fold_sorted(batches, removed, **limits), "file string, event_key string")
