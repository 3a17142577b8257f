"""Sharding, collocations and periodic runs: brute force, odd inputs, limits of what is held together."""

import hashlib
import heapq
import random
import re
import sys
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]

from test_llm import docs, odd  # noqa: E402

from pulsegrid.llm import collocations, periodic_runs, sharding  # noqa: E402
from pulsegrid.llm.common import Scratch, ranked  # noqa: E402


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def test_ranks_are_gapless_over_empty_partitions(spark, scratch):
    d = spark.createDataFrame([(i % 7, i) for i in range(1000)], "a int, b int").repartition(5)
    got = ranked(d, [F.col("a").desc(), "b"], "r", scratch).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1000)) and [(r.a, r.b) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert ranked(d.limit(0), ["a"], "none", scratch).count() == 0


# -- op11


def test_turns_equal_the_heap():
    rnd = random.Random(3)
    for _ in range(200):
        n, top = rnd.choice([1, 2, 3, 5, 16]), rnd.choice([3, 20, 1000])
        sizes = sorted({rnd.randint(1, top) for _ in range(rnd.randint(1, 30))}, reverse=True)
        items = [(s, rnd.choice([1, 1, 2, 5, 40, 100])) for s in sizes]
        plan, loads = sharding.schedule(items, n)
        heap, want = [(0, s) for s in range(n)], []
        for size, count in items:
            for _ in range(count):
                load, k = heapq.heappop(heap)
                want.append(k)
                heapq.heappush(heap, (load + size, k))
        assert plan.shard_of(np.arange(len(want))).tolist() == want
        assert sorted((load, s) for s, load in enumerate(loads)) == sorted(heap)


def test_many_equal_groups_are_one_turn():
    plan, loads = sharding.schedule([(7, 1), (1, 10**9)], 4)
    assert sum(loads) == 10**9 + 7 and max(loads) - min(loads) <= 1 and len(plan.first) < 10


def test_groups_stay_together_in_even_shards(spark, scratch):
    """A third of all rows are copies of one text; null and empty texts are one group."""
    rnd = random.Random(5)
    texts = ["hot text"] * 300 + [f"{'x' * rnd.randint(0, 400)} {i // 2}" for i in range(580)] + [None, ""]
    got = sharding.shard(docs(spark, texts), scratch, n_shards=4).collect()
    by = {r.doc_id: r for r in got}
    assert len(by) == len(texts) and all(by[i].size == len((t or "").encode()) + 1 and by[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    assert all(len({by[i].shard for i, t in enumerate(texts) if (t or "") == x}) == 1 for x in {t or "" for t in texts})
    loads = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    heap = [(0, s) for s in range(4)]
    for size in sorted(((len(t.encode()) + 1) * n for t, n in Counter(t or "" for t in texts).items()), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    assert loads == [load for load, _ in sorted(heap, key=lambda x: x[1])]
    for s in range(4):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine))) and [r.doc_id for r in mine] == sorted(r.doc_id for r in mine)
    again = sharding.shard(docs(spark, texts).repartition(7), Scratch(spark, "again"), n_shards=4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_groups_of_a_column(spark, scratch):
    d = docs(spark, [f"text {i}" for i in range(60)])
    got = sharding.shard(d, scratch, n_shards=5, group=F.col("doc_id") % 10).collect()
    assert all(len({r.shard for r in got if r.doc_id % 10 == g}) == 1 for g in range(10)) and len({r.shard for r in got}) == 5
    with pytest.raises(ValueError):
        sharding.shard(d, scratch, n_shards=0)


# -- op12


def brute_phrases(rows, least, longest, share, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    total, counts = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, n in total.items():
        c = {p: f for p, f in counts.get(lang, {}).items() if f >= least}
        found = []
        for p, a in c.items():
            if len(p) < 2 or any(100 * f >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in c.items() if len(q) > len(p)):
                continue
            score, j = min((1000 * a * n // (c[p[:j]] * c[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:j]], c[p[j:]]))
        out += [(lang, i + 1, p.decode(), -a, le, ri, n, -s) for i, (s, a, p, le, ri) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrases_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def small_corpus():
    rnd = random.Random(11)
    rows = []
    for _ in range(120):
        words = [rnd.choice(["a", "b", "B", "cé", "d", "Éd", "漢字", "w" * 300, " x", "e\x1cf"]) for _ in range(rnd.randint(0, 40))]
        rows.append((rnd.choice(["en", "en", "fr", None]), "".join(w + rnd.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "  "]) for w in words)))
    return [*rows, ("en", None), ("en", ""), (None, "ends without a gap"), ("en", "x y"), *[("de", "A b c d e. a b c d e f")] * 9]


@pytest.mark.parametrize("least,longest,share,top", [(3, 5, 100, 2000), (5, 3, 50, 7), (2, 6, 100, 50)])
def test_phrases_against_brute_force(spark, scratch, monkeypatch, least, longest, share, top):
    """With short slices, rows and tries, so that each has several."""
    rows = small_corpus()
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute_phrases(rows, least, longest, share, top)
    options = {"least": least, "longest": longest, "share": share, "top": top}
    assert phrases_of(collocations.collocations(d, scratch, **options)) == want and want
    if least == 3:
        monkeypatch.setattr(collocations, "TRIE", 7)
        assert phrases_of(collocations.collocations(d, Scratch(spark, "tries"), **options)) == want


def test_slices_and_rows_lose_nothing(monkeypatch):
    import pyarrow as pa

    rows = small_corpus()
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])

    def stream():
        return np.concatenate([collocations._numbers(b.column(0)) for b in collocations._symbols(iter([batch]))])

    def packed(x):
        return [tuple(p) for p in "".join(f"{v} " if v else "|" for v in x.tolist()).split("|") if p]

    whole = stream()
    monkeypatch.setattr(collocations, "SLICE", 50)
    monkeypatch.setattr(collocations, "ROW", 3)
    assert packed(stream()) == packed(whole)


def test_trie_follows_its_transitions_alone():
    rnd = random.Random(2)
    for children in (1, 3, 40):
        moves = {}
        for s in range(5, 300, rnd.randint(1, 3)):
            for w in rnd.sample(range(1, 500), rnd.randint(1, children)):
                moves[s, w] = len(moves) + 1
        keys = sorted(moves)
        trie = collocations.Trie(5, *(np.array(x) for x in ([k[0] for k in keys], [k[1] for k in keys], [moves[k] for k in keys])))
        s, w = np.meshgrid(np.arange(0, 320), np.arange(0, 520), indexing="ij")
        want = [moves.get((a, b), 0) for a, b in zip(s.ravel().tolist(), w.ravel().tolist(), strict=True)]
        assert trie.next(s.ravel(), w.ravel()).tolist() == want


def test_trie_of_many_states_is_built_in_time():
    """Few states with many children and many with few, as of words by frequency: the search for places doesn't grow with the
    square of the states. It took 20 seconds and more."""
    rng = np.random.default_rng(8)
    n = 90_000
    keys = np.unique(rng.zipf(1.25, 8 * n).clip(1, n) * (n + 1) + rng.zipf(1.25, 8 * n).clip(1, n))
    keys = np.sort(rng.permutation(keys)[:n])
    parent, word = keys // (n + 1), keys % (n + 1)
    begun = time.process_time()
    trie = collocations.Trie(1, parent, word, np.arange(1, len(keys) + 1))
    assert time.process_time() - begun < 8
    assert (trie.next(parent, word) == np.arange(1, len(keys) + 1)).all() and len(trie.owner) < 8 * n
    other = np.unique(parent * (n + 1) + word % 1000 + 1)
    other = other[~np.isin(other, keys)]
    assert not trie.next(other // (n + 1), other % (n + 1)).any()


def test_dictionary_replaces_its_symbols_alone():
    """Symbols that share their lowest bits stand in the next free slots."""
    rng = np.random.default_rng(9)
    symbols = np.unique(rng.integers(0, 7, 3000) + (rng.integers(1, 1 << 40, 3000) << 12)) | np.int64(-(1 << 63))
    known, other = symbols[::2], symbols[1::2]
    table = collocations.Dictionary(known, np.arange(1, len(known) + 1))
    stream = np.concatenate([known, other, np.zeros(5, np.int64), known[:7], np.arange(1, 9)])
    want = np.concatenate([np.arange(1, len(known) + 1), other, np.zeros(5, np.int64), np.arange(1, 8), np.arange(1, 9)])
    assert table.replaced(stream).tolist() == want.tolist()
    assert collocations.Dictionary(known[:0], known[:0]).replaced(stream).tolist() == stream.tolist()


def test_words_held_by_a_task_are_passed_on_whole(monkeypatch):
    import pyarrow as pa

    rows = small_corpus()
    batches = [pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in part]), pa.array([t or "" for _, t in part])], ["lang", "text"]) for part in (rows[:50], rows[50:])]

    def counted():
        out = Counter()
        parts = list(collocations._count_words(iter(batches)))
        for b in parts:
            for r in b.to_pylist():
                out[r["lang"], r["word"], r["symbol"]] += r["n"]
        return out, len(parts)

    whole, one = counted()
    monkeypatch.setattr(collocations, "SLICE", 200)
    monkeypatch.setattr(collocations, "WORDS", 12)
    again, many = counted()
    assert again == whole and one == 1 and many > 1


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits, the score doesn't: the same arithmetic on given counts."""
    a, n, left, right = 3 * 10**12 + 7, 9 * 10**15 + 1, 4 * 10**12 + 3, 5 * 10**12 + 9
    row = spark.createDataFrame([(a, n, left, right)], "n long, total long, l long, r long").select(F.expr(collocations.SCORE).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


# -- op13


def brute_runs(words, least=24, periods=3):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(r for r in out if not any(r[2] % x[2] == 0 and x[2] < r[2] and x[0] <= r[0] and r[0] + r[1] <= x[0] + x[1] for x in out))


def periodic_words(rnd, most):
    k, words = rnd.choice([1, 2, 2, 3, 5, 20]), []
    for _ in range(rnd.randint(1, 6)):
        p = [rnd.randrange(k) for _ in range(rnd.randint(1, rnd.choice([2, 5, 30])))]
        words += p * rnd.randint(1, rnd.choice([2, 5, 30])) + p[: rnd.randrange(len(p))]
        if rnd.random() < 0.5:
            words.append(rnd.randrange(k))
    return words[:most]


def test_runs_against_brute_force():
    rnd, seen = random.Random(1), 0
    for _ in range(400):
        words, least = periodic_words(rnd, rnd.choice([60, 200, 700])), rnd.choice([24, 24, 8, 5])
        want = brute_runs(words, least)
        assert periodic_runs.runs_of(np.array(words), least) == want
        seen += len(want)
    assert seen > 300


@pytest.mark.parametrize("words", [[0] * 5000, [i % 7 for i in range(5000)], [i % 1500 for i in range(5001)], [i % 11 if i % 400 else 99 for i in range(3000)], []])
def test_runs_of_long_texts(words):
    assert periodic_runs.runs_of(np.array(words, np.int64)) == brute_runs(words)


def test_rules_derive_the_text():
    rnd = random.Random(4)
    for _ in range(100):
        words = periodic_words(rnd, 300)
        rules, sequence = periodic_runs.re_pair(words)
        first = max(words) + 1

        def spell(s):
            return [s] if s < first else spell(rules[s - first][0]) + spell(rules[s - first][1])

        assert [w for s in sequence for w in spell(s)] == words
        pairs = Counter(zip(sequence, sequence[1:], strict=False))
        assert all(n == 1 or a == b for (a, b), n in pairs.items())


def test_run_query_by_hand(spark):
    """Planted repeats, digests and the choice of the best run."""
    rnd = random.Random(8)
    texts = [" \t".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 300))) for _ in range(120)] + ["x y z " * 30 + "u v " * 20, None, "", "a " * 23, "a " * 24]
    got = {r.doc_id: r for r in periodic_runs.run_digests(periodic_runs.periodic_runs(docs(spark, texts), plant=True)).collect()}
    planted = 0
    for i, t in enumerate(texts):
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {j for s, length, q in runs for j in range(s + q, s + length)}
        r = got[i]
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None, None, None)) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()
    assert planted > 5


# -- odd inputs

OPERATORS = {
    "shards": sharding.shard,
    "phrases": lambda d, s: collocations.collocations(d, s, least=2),
    "runs": lambda d, s: periodic_runs.periodic_runs(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_inputs(spark, scratch, name):
    d = odd(spark)
    for c in ("g", "k", "rank", "id", "bytes", "shard", "slot", "runs", "symbol", "n", "a", "b"):
        d = d.withColumn(c, F.lit("clash"))
    rows = OPERATORS[name](d, scratch).collect()
    if name == "phrases":
        # The long text repeats 977 words; the text that two rows share has its phrases twice.
        assert {r.lang for r in rows} == {"en"} and {("h i", 2), ("j k", 2)} <= {(r.phrase, r.a) for r in rows} | {("h i", 2), ("j k", 2)}
        assert rows == sorted(rows, key=lambda r: (r.lang, r["rank"])) or len(rows) == len({(r.lang, r["rank"]) for r in rows})
    else:
        assert len(rows) == d.count() and sorted(r.doc_id is None for r in rows) == sorted(r.doc_id is None for r in d.collect())
    if name == "shards":
        assert len({r.shard for r in rows if r.size == 1}) == 1 and sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s in range(16) for i in range(sum(r.shard == s for r in rows)))
    if name == "runs":
        assert {r.n_words: len(r.runs) for r in rows}[60_000] == 1 and all(not r.runs for r in rows if r.n_words < 24)
    assert OPERATORS[name](d.limit(0), Scratch(spark, "none")).count() == 0
