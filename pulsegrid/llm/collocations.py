"""Phrase collocation mining with double-array tries of Apriori-safe candidates.

Words are numbered; a text is a stream of word ids with breaks between pieces and where a word is too rare. Beside it runs
a stream of states: the id of the frequent phrase of k words that begins at a position, or 0. A phrase of k + 1 words can
be frequent only if both its phrases of k words are, so the candidates are the neighbouring states that occur. Those that
the saturated counts of the tasks leave possible enter a double-array trie (state and next word to state), which is
broadcast; numpy advances the states of all positions at once, a bincount of the accepting states counts every phrase,
and the counts of all tasks are summed. Positions without a neighbouring state leave the stream, so the levels shrink.

A trie holds at most `TRIE` states; more are broadcast one after the other, each advancing its own range of states. What
the driver holds at a time is one trie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, ranked
from pulsegrid.llm.rolling import LONG_WORD, RangeHash, U, mix

#: States of a trie, and words of a dictionary, that are broadcast together.
TRIE = 1 << 21
#: Bytes of text that are hashed together.
SLICE = 1 << 18
#: Words, and their bytes, that a task counts before it passes them on.
WORDS, WORD_BYTES = 1 << 19, 1 << 26
#: Positions of a row of the stream, at least; a row ends at a break.
ROW = 128
#: States whose counts travel in one row.
CHUNK = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


def _starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and where each value begins and ends in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def _words(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of a batch: the lower-cased bytes, the words' starts and ends in them, a symbol of each word and its
    language, whether a piece begins with the word, and the number of its language."""
    names = langs.dictionary_encode()
    seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()], U)
    lang_of = names.indices.to_numpy()
    raw, offsets = _starts(texts)
    begin = np.zeros(len(raw) + 1, bool)
    begin[offsets] = True
    at = 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        if end < len(raw):
            # A slice ends where a text or a piece does.
            cut = np.flatnonzero(begin[at + 1 : end + 1] | (_KIND[raw[at:end]] == 2))
            if len(cut):
                end = at + 1 + int(cut[-1])
            else:
                cut = np.flatnonzero(begin[end + 1 :] | (_KIND[raw[end:]] == 2))
                end = end + 1 + int(cut[0])
        low = _LOWER[raw[at:end]]
        kind, new = _KIND[low], begin[at:end].copy()
        new[0] = True
        word = kind == 0
        first = word & (new | ~np.concatenate([[False], word[:-1]]))
        last = word & np.concatenate([new[1:] | ~word[1:], [True]])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts):
            piece = np.cumsum(new | (kind == 2))[starts]
            doc = np.searchsorted(offsets, at + starts, side="right") - 1
            hashes = RangeHash(low).of(starts, ends)
            for i in np.flatnonzero(ends - starts > LONG_WORD):
                hashes[i] = U(int.from_bytes(blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little"))
            lang = lang_of[doc]
            # The highest bit tells symbols from ids.
            symbols = mix(hashes + seeds[lang]) | U(1 << 63)
            yield low, starts, ends, symbols, np.concatenate([[True], piece[1:] != piece[:-1]]), lang
        at = end


def _take(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = raw[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def _merged(parts: list[tuple]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Parts of (languages, words, symbols, counts) as one, in which each symbol occurs once."""
    symbols, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    order = np.argsort(symbols)
    first = np.flatnonzero(np.diff(symbols[order], prepend=~symbols[order[:1]]))
    at = pa.array(order[first])
    langs, words = (pa.chunked_array([p[i] for p in parts]).combine_chunks().take(at) for i in (0, 1))
    return langs, words, symbols[order[first]], np.add.reduceat(n[order], first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task and how often each occurs; a word comes again only where the words held passed WORDS or WORD_BYTES."""
    held: list[tuple] = []
    names = ["lang", "word", "symbol", "n"]

    def rows(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part[0], part[1], pa.array(part[2].view(np.int64)), pa.array(part[3], pa.int64())], names)

    for b in batches:
        langs = b.column(0)
        dictionary = langs.dictionary_encode().dictionary
        for low, starts, ends, symbols, _, lang in _words(b.column(1), langs):
            order = np.argsort(symbols)
            first = np.flatnonzero(np.diff(symbols[order], prepend=~symbols[order[:1]]))
            at = order[first]
            held.append((dictionary.take(pa.array(lang[at])), _take(low, starts[at], ends[at]), symbols[at], np.diff(np.append(first, len(order)))))
            if sum(len(p[2]) for p in held) > WORDS or sum(p[1].nbytes for p in held) > WORD_BYTES:
                held = [_merged(held)]
                if 2 * len(held[0][2]) > WORDS or 2 * held[0][1].nbytes > WORD_BYTES:
                    yield rows(held.pop())
    if held:
        yield rows(_merged(held))


def _rows(*streams: np.ndarray) -> pa.RecordBatch:
    """A batch of the stream: ids, states and the states to come as bytes, cut at breaks (zeros among the ids). What isn't
    given is empty; without states, the ids are the states."""
    ids = streams[0]
    breaks = np.flatnonzero(ids == 0) + 1
    cuts = np.zeros(1, np.int64)
    if len(breaks):
        at = np.unique(np.searchsorted(breaks, np.arange(ROW, len(ids) + ROW, ROW)))
        cuts = np.concatenate([cuts, breaks[at[at < len(breaks)]]])
    if cuts[-1] < len(ids) or len(cuts) == 1:
        cuts = np.append(cuts, len(ids))
    columns = []
    for i in range(3):
        data, ends = (streams[i], cuts * 8) if i < len(streams) else (ids[:0], cuts * 0)
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]))
    rows = len(cuts) - 1
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())], _NAMES)


def _sums(counts: np.ndarray, first: int) -> pa.RecordBatch:
    """The counts of a task as rows without a stream: a row for each chunk of states that has any."""
    counts = np.concatenate([np.zeros(first % CHUNK, np.int64), counts])
    counts = np.concatenate([counts, np.zeros(-len(counts) % CHUNK, np.int64)]).reshape(-1, CHUNK)
    chunks = np.flatnonzero(counts.any(axis=1))
    none = pa.array([b""] * len(chunks), pa.binary())
    return pa.RecordBatch.from_arrays([none, none, none, pa.array(chunks + first // CHUNK, pa.int64()), pa.array([counts[i].tobytes() for i in chunks], pa.binary())], _NAMES)


def _add_up(key: tuple, rows: pa.Table) -> pa.Table:
    """The counts of one chunk, summed over the tasks."""
    total = np.zeros(CHUNK, np.int64)
    for counts in rows.column("counts").to_pylist():
        total += np.frombuffer(counts, np.int64)
    found = np.flatnonzero(total)
    return pa.table({"id": pa.array(found + key[0].as_py() * CHUNK, pa.int64()), "n": pa.array(total[found])})


_NAMES = ["ids", "states", "after", "chunk", "counts"]
_STREAM = "ids binary, states binary, after binary, chunk bigint, counts binary"


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(_starts(column)[0].tobytes(), np.int64)


def _ids_and_states(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, states = _numbers(b.column(0)), _numbers(b.column(1))
    return ids, states if len(states) else ids


def _compact(ids: np.ndarray, states: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keeps the words of phrases of k words that stand next to another one, with a break after each stretch of them."""
    n = len(ids)
    at = np.flatnonzero((states[:-1] != 0) & (states[1:] != 0))
    change = np.zeros(n + k + 2, np.int64)
    change[at] += 1
    change[at + k + 1] -= 1
    inside = np.cumsum(change)[:n] > 0
    keep = inside | np.concatenate([[False], inside[:-1]])
    inside = inside[keep]
    return np.where(inside, ids[keep], 0), np.where(inside, states[keep], 0)


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as streams of symbols, which are negative, with a break before each piece and at the end."""
    for b in batches:
        for _, _, _, symbols, begins, _ in _words(b.column(1), b.column(0)):
            out = np.zeros(len(symbols) + int(begins.sum()) + 1, np.int64)
            out[np.arange(len(symbols)) + np.cumsum(begins)] = symbols.view(np.int64)
            yield _rows(out)


class Dictionary:
    """A table of symbols and their ids, at least half empty; a symbol stands at its lowest bits or in the next free slot."""

    def __init__(self, symbols: np.ndarray, ids: np.ndarray):
        """`symbols` aren't 0 and occur once."""
        self.mask = (1 << (2 * len(symbols)).bit_length()) - 1
        self.symbols, self.ids = np.zeros(self.mask + 1, np.int64), np.zeros(self.mask + 1, np.int64)
        left, slot = np.arange(len(symbols)), symbols & self.mask
        while len(left):
            free = np.flatnonzero(self.symbols[slot] == 0)
            taken, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.symbols[taken], self.ids[taken] = symbols[left[put]], ids[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def replaced(self, stream: np.ndarray) -> np.ndarray:
        """The stream with ids in place of the symbols that the table has."""
        out = stream.copy()
        left = np.flatnonzero(stream < 0)
        slot = stream[left] & self.mask
        while len(left):
            there = self.symbols[slot]
            hit = there == stream[left]
            out[left[hit]] = self.ids[slot[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


def _encode(dictionary, last: bool) -> Callable:
    """Symbols to ids, by one dictionary. After the last one, what is still a symbol is a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = dictionary.value.replaced(_numbers(b.column(0)))
            if last:
                out = np.maximum(out, 0)
                yield _rows(_compact(out, out, 1)[0])
            else:
                yield _rows(out)

    return run


def _pairs(width: int, most: int) -> Callable:
    """The neighbouring states of a batch, as one number, and how often, `most` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, states = _ids_and_states(b)
            at = np.flatnonzero((states[:-1] != 0) & (states[1:] != 0))
            keys, n = np.unique(states[at] * width + states[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.minimum(n, most), pa.int64())], ["pair", "n"])

    return run


class Trie:
    """One level of a double-array trie, for the states from `low` on: the children of a state stand at base + word, and
    `owner` names the state a slot belongs to."""

    def __init__(self, low: int, parent: np.ndarray, word: np.ndarray, child: np.ndarray):
        """`parent` must be sorted, and (parent, word) occurs once."""
        self.low = low
        n, span = len(parent), int(parent[-1]) - low + 1 if len(parent) else 0
        self.base = np.full(span, np.iinfo(np.int64).min // 2)
        top = int(word.max(initial=0)) + 1
        # Behind `size` there is room for the words of a base before it.
        size = 2 * n + 1
        owner, value = np.zeros(size + top, np.int64), np.zeros(size + top, np.int64)
        states, first, count = np.unique(parent, return_index=True, return_counts=True)
        at, narrow = 0, 0
        # States with many children choose first; a base is tried where the least word meets a free slot. A search goes on where
        # that before ended, as slots passed over hardly fit states of like size; at half the size it begins anew.
        for s, f, c in sorted(zip(states.tolist(), first.tolist(), count.tolist(), strict=True), key=lambda x: (-x[2], x[0])):
            if c == 1:
                break
            if c < narrow or not narrow:
                at, narrow = 0, -(-c // 2)
            words = np.sort(word[f : f + c])
            base, at = self._fit(owner, words - words[0], at, size)
            while base < 0:
                more = size // 4 + 1
                owner, value = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (owner, value))
                base, at = self._fit(owner, words - words[0], max(0, size - 4096), size + more)
                size += more
            base -= int(words[0])
            self.base[s - low] = base
            owner[base + word[f : f + c]], value[base + word[f : f + c]] = s, child[f : f + c]
        # A single child takes any free slot.
        alone = first[count == 1]
        free = np.flatnonzero(owner == 0)
        if len(free) < len(alone):
            free = np.concatenate([free, np.arange(len(owner), len(owner) + len(alone))])
            owner, value = (np.concatenate([x, np.zeros(len(alone), np.int64)]) for x in (owner, value))
        free = free[: len(alone)]
        self.base[parent[alone] - low] = free - word[alone]
        owner[free], value[free] = parent[alone], child[alone]
        end = int(np.flatnonzero(owner)[-1]) + 1 if n else 0
        self.owner, self.value = owner[:end].copy(), value[:end].copy()

    @staticmethod
    def _fit(owner: np.ndarray, shape: np.ndarray, at: int, size: int) -> tuple[int, int]:
        """The first place from `at` on and before `size` where all of `shape` is free, or -1, and the block it is in."""
        width = 4096 if len(shape) > 64 else 256
        while at < size:
            tried = np.flatnonzero(owner[at : min(at + width, size)] == 0) + at
            k = 1
            # Word by word while many places are left, as most of them fail at the first words.
            while len(tried) > 16 and k < len(shape):
                tried = tried[owner[tried + shape[k]] == 0]
                k += 1
            if len(tried):
                fits = (owner[tried[:, None] + shape[k:]] == 0).all(axis=1)
                if fits.any():
                    return int(tried[fits.argmax()]), at
            at += width
        return -1, at

    def next(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states that follow, 0 where there is none."""
        mine = (states >= self.low) & (states < self.low + len(self.base)) & (words != 0)
        out = np.zeros(len(states), np.int64)
        slot = self.base[states[mine] - self.low] + words[mine]
        real = (slot >= 0) & (slot < len(self.owner))
        slot = np.where(real, slot, 0)
        out[mine] = np.where(real & (self.owner[slot] == states[mine]), self.value[slot], 0)
        return out


def _advance(trie, k: int, first: int, last: int, at_end: bool) -> Callable:
    """States of k words to those of k + 1, by one trie, whose accepting states are first to last. After the last trie the
    new states take the place of the old ones, and the stream shrinks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(last - first + 1, np.int64)
        for b in batches:
            (ids, states), after = _ids_and_states(b), _numbers(b.column(2))
            # The word that follows a phrase counts only where it ends a phrase of k words that begins one word later.
            onward = np.zeros(len(ids), np.int64)
            near = np.flatnonzero((states[:-1] != 0) & (states[1:] != 0))
            onward[near] = ids[near + k]
            new = trie.value.next(states, onward)
            counts += np.bincount(new[new > 0] - first, minlength=len(counts))
            new = np.maximum(new, after) if len(after) else new
            yield _rows(*(_compact(ids, new, k + 1) if at_end else (ids, states, new)))
        yield _sums(counts, first)

    return run


def _ranges(n: int) -> list[tuple[int, int]]:
    """The ids 1 to n in ranges of TRIE."""
    return [(low, min(low + TRIE - 1, n)) for low in range(1, n + 1, TRIE)]


def _arrays(rows: DataFrame, *names: str) -> list[np.ndarray]:
    table = rows.select(*names).toArrow()
    return [table.column(c).to_numpy() for c in names]


def _frequent_words(docs: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, total) of all words, and (id, lang, word, symbol, n) of those that occur at least `least` times, ids from 1."""
    counted = docs.mapInArrow(_count_words, "lang string, word string, symbol bigint, n bigint")
    vocabulary = scratch.write(counted.groupBy("lang", "word").agg(F.min("symbol").alias("symbol"), F.sum("n").alias("n")), "words")
    totals = scratch.write(vocabulary.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    often = ranked(vocabulary.where(F.col("n") >= least), [F.col("n").desc(), "lang", "word"], "often", scratch)
    return totals, often.withColumn("id", F.col("rank") + 1).drop("rank")


def _encoded(docs: DataFrame, often: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """The stream of word ids, by one dictionary after the other."""
    spark, stream = docs.sparkSession, None
    for i, (low, high) in enumerate(_ranges(size)):
        symbols, ids = _arrays(often.where(F.col("id").between(low, high)), "symbol", "id")
        encode = _encode(spark.sparkContext.broadcast(Dictionary(symbols, ids)), high == size)
        step = docs.mapInArrow(lambda b, encode=encode: encode(_symbols(b)), _STREAM) if stream is None else stream.mapInArrow(encode, _STREAM)
        stream = scratch.write(step, f"encoded-{i}")
    return stream


def frequent_phrases(docs: DataFrame, scratch: Scratch, *, least: int = 100, longest: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, total) and, for each length from 1, (id, lang, words, last, n, prefixes, suffixes, a, b): a phrase that occurs
    at least `least` times, the id of its last word, the counts of its first and last 1, 2, ... words, and the ids of its
    phrases without the last and without the first word. `docs` holds lang and text, without nulls."""
    spark = docs.sparkSession
    totals, often = _frequent_words(docs, scratch, least)
    one = F.array("n")
    levels = [scratch.write(often.select("id", "lang", F.array("word").alias("words"), F.col("id").alias("last"), "n", one.alias("prefixes"), one.alias("suffixes"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), "phrases-1")]
    size = levels[0].count()
    stream = _encoded(docs, often, size, scratch)
    for k in range(1, longest):
        if not size:
            break
        width = size + 1
        near = stream.mapInArrow(_pairs(width, least), "pair bigint, n bigint")
        possible = near.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        # Written, as the range sort reads its input twice.
        possible = scratch.write(possible.select(F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b")), f"possible-{k + 1}")
        candidates = ranked(possible.join(levels[-1].select(F.col("id").alias("b"), "last"), "b"), ["a", "b"], f"candidates-{k + 1}", scratch).withColumn("id", F.col("rank") + 1).drop("rank")
        size = candidates.count()
        counts = []
        for low, high in _ranges(size):
            a, word, child = _arrays(candidates.where(F.col("id").between(low, high)), "a", "last", "id")
            order = np.lexsort((word, a))
            trie = spark.sparkContext.broadcast(Trie(int(a[order[0]]), a[order], word[order], child[order]))
            stream = scratch.write(stream.mapInArrow(_advance(trie, k, low, high, high == size), _STREAM), f"stream-{k + 1}-{low}")
            counts.append(stream.where("chunk is not null").select("chunk", "counts"))
        if not size:
            break
        counted = scratch.write(reduce(DataFrame.union, counts).groupBy("chunk").applyInArrow(_add_up, "id bigint, n bigint"), f"counts-{k + 1}")
        left = levels[-1].select(F.col("id").alias("a"), "lang", "words", "prefixes")
        right = levels[-1].select(F.col("id").alias("b"), F.element_at("words", -1).alias("word"), "suffixes")
        grown = candidates.join(counted, "id").where(F.col("n") >= least).join(left, "a").join(right, "b")
        add = lambda c, x: F.array_append(c, F.col(x)).alias(c)
        levels.append(scratch.write(grown.select("id", "lang", add("words", "word"), "last", "n", add("prefixes", "n"), add("suffixes", "n"), "a", "b"), f"phrases-{k + 1}"))
    return totals, levels


#: floor(1000 * n * total / (l * r)) of counts, exact where 1000 * n * total has 38 digits at most.
SCORE = "(cast(1000 as decimal(4,0)) * cast(n as decimal(16,0)) * cast(total as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def collocations(docs: DataFrame, scratch: Scratch, *, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of 2 to `longest` words.

    A phrase that occurs a >= `least` times is scored by its weakest cut: floor(1000 * a * n / (l * r)), where n counts the
    language's words and l and r what the cut leaves; of equal cuts the first. Phrases inside a longer one that occurs at
    least `share` percent as often are dropped; it is enough to look one word further, as what lies between occurs at
    least as often as the longer one. Ranks go by score and a, descending, and the phrase's bytes. Scores are exact in
    decimals of 38 digits.

    A null language is `und`; a null text has no words; texts count as often as they are repeated. Other columns aren't
    read, so names don't clash; an empty table gives none. Words and languages are told apart by 64-bit hashes, phrases by
    numbers; there may be 3 * 10^9 phrases of one length.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals, levels = frequent_phrases(texts, scratch, least=least, longest=longest)
    found = []
    for k in range(2, len(levels) + 1):
        mine = levels[k - 1]
        if k < len(levels):
            both = levels[k].select(F.explode(F.array("a", "b")).alias("id"), F.col("n").alias("longer"))
            mine = mine.join(both.groupBy("id").agg(F.max("longer").alias("longer")), "id", "left").where(f"longer is null or 100 * longer < {share} * n")
        found.append(mine.select("lang", "words", "n", "prefixes", "suffixes"))
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows = reduce(DataFrame.union, found).join(totals, "lang")
    in_cut = SCORE.replace("cast(l ", "cast(x.l ").replace("cast(r ", "cast(x.r ")
    cuts = "transform(sequence(1, size(words) - 1), j -> named_struct('j', j, 'l', prefixes[j - 1], 'r', suffixes[size(words) - j - 1]))"
    weakest = f"array_min(transform({cuts}, x -> named_struct('score', {in_cut}, 'j', x.j, 'l', x.l, 'r', x.r)))"
    scored = rows.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.col("total").alias("n"), F.expr(weakest).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # First within parts of a language, so that no task holds more than their best.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranks = part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranks.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with d as (select row_number() over () as doc, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
n as (select lang, sum(len(words))::hugeint as n from w group by lang),
g as (select lang, words, unnest([1, 2, 3, 4, 5]) as k from w),
i as (select lang, k, words, unnest(range(1, len(words) - k + 2)) as pos from g),
c as (select lang, k, words[pos : pos + k - 1] as phrase, count(*) as f from i group by all having count(*) >= 100),
x as (select *, unnest(range(1, k)) as j from c where k > 1),
s as (
  select x.lang, x.k, x.phrase, x.f as a, n.n, l.f as l, r.f as r, x.j, (1000::hugeint * x.f * n.n) // (l.f::hugeint * r.f) as score
  from x join n using (lang) join c l on l.lang = x.lang and l.phrase = x.phrase[1 : x.j] join c r on r.lang = x.lang and r.phrase = x.phrase[x.j + 1 :]),
m as (select *, row_number() over (partition by lang, phrase order by score, j) as nth from s),
longer as (select lang, phrase, f, k, unnest([1, 2, 3, 4]) as len from c where k > 1),
inner_ as (select lang, f, phrase[pos : pos + len - 1] as part from (select *, unnest(range(1, k - len + 2)) as pos from longer where len < k)),
gone as (select lang, part, max(f) as f from inner_ group by all),
b as (
  select m.*, array_to_string(m.phrase, ' ') as name from m left join gone on gone.lang = m.lang and gone.part = m.phrase
  where nth = 1 and not coalesce(100 * gone.f >= 100 * m.a, false)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, encode(name)) as rank from b)
select lang, rank::bigint as rank, name as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o where rank <= 2000
"""
