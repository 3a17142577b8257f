"""Toxic passages by maximal scoring segments.

Each word gets a log-odds of standing in toxic and in other training documents under an informative Dirichlet prior (the words'
shares in all training text), taken at the confidence bound that lies nearer to zero: evidence for and against counts
alike. Words also count for their first 4, 5 and 6 letters, so that forms that were never seen borrow from their stem.
Every word costs a little, so the scores have a negative drift, and a linear-time scan finds all maximal scoring segments
of a text. By Karlin-Altschul statistics chance gives E = K * n * exp(-lambda * S) segments of a score of at least S in n
words; lambda and K are those of the scores that the words of the clean training texts really get. A segment is
significant below an E of 0.05, and its excess is the logarithm of how far below. The excesses are summed, and a logistic
curve of the logarithm, fitted on the training rows, maps the sum to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Scratch, without

#: Weight of the prior (in documents, and for each unit at least), cost of a word, the confidence bound in deviations,
#: and the least bound that counts as evidence.
PRIOR, FLOOR, DRIFT, CONFIDENCE, LEAST = 1.0, 0.5, 0.1, 1.96, 0.7
#: The greatest K of Karlin-Altschul where the clean texts hold no segment, and the number of segments of such a score that chance may
#: give in a text for one to be significant.
K, SIGNIFICANT = 0.1, 0.05
PREFIXES = (4, 5, 6)
#: Width of the bins of scores, and of the logarithm of the summed excess, that reach the driver as counts.
SCORE_BIN, BIN = 0.05, 0.1
#: Letters with the combining marks that follow them, which \w doesn't match; marks stand in these planes only.
_MARKS = "".join(chr(i) for plane in (range(0x300, 0x20000), range(0xE0100, 0xE01F0)) for i in plane if unicodedata.category(chr(i))[0] == "M")
#: Below U+0300 there are no marks, and a plain pattern gives the same words in less time.
_HIGH, _PLAIN = re.compile("[\u0300-\U0010ffff]"), re.compile(r"[^\W\d_]+")
_WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")


def words_of(text: str) -> list[str]:
    """The words of a text, for learning and for scoring."""
    low = text.lower()
    return (_WORD if _HIGH.search(low) else _PLAIN).findall(low)


@dataclass
class Model:
    """Scores of units (words, and prefixes with a leading ^), lambda and K of the clean background, and the logistic curve."""

    units: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = K
    bias: float = -20.0
    slope: float = 0.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, word: str) -> float:
        """The word's bound, or that of a prefix of it where that is more; 0 without evidence."""
        found = self.memo.get(word)
        if found is None:
            own = self.units.get(word, 0.0)
            best = max([own, *(self.units.get("^" + word[:n], 0.0) for n in PREFIXES if len(word) >= n)])
            found = best if best > 0 else own
            if len(self.memo) < 200_000:
                self.memo[word] = found
        return found

    def scan(self, words: list[str]) -> list[tuple[int, int, float]]:
        """The maximal scoring segments of a text's words."""
        score = self.score
        return segments([(i, s) for i, w in enumerate(words) if (s := score(w))])

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """The number of words, and (first word, last word, score, excess) of each significant segment."""
        words = words_of(text)
        chance = math.log(max(self.k * len(words), 1e-9) / SIGNIFICANT)
        found = [(first, last, s, self.rate * s - chance) for first, last, s in self.scan(words)]
        return len(words), [p for p in found if p[3] > 0]

    def probability(self, excess: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * math.log1p(excess)))))


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence whose words cost `drift`, but for `hits` (place, score).

    The scan keeps candidate segments with the running total before and after them; a new one merges with those that it
    extends, found by going back along links to the last candidate that starts lower.
    """
    out: list[list[float]] = []  # first, last, total before, total after, link
    total, at = 0.0, -1
    for place, score in hits:
        total -= drift * (place - at - 1)
        at = place
        new = [place, place, total, total + score - drift, -1]
        total = new[3]
        if score <= drift:
            continue
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = int(out[j][4])
            new[4] = j
            if j < 0 or out[j][3] >= new[3] - 1e-9:
                out.append(new)
                break
            new[0], new[2] = out[j][0], out[j][2]
            del out[j:]
    return [(int(a), int(b), right - left) for a, b, left, right, _ in out]


def _rate(scores: np.ndarray, shares: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of sum(share * exp(rate * (score - drift))) = 1 for words of these scores and shares, 5 at most, as
    where no clean word scores above the drift."""
    value = lambda x: float((shares * np.exp(np.minimum(x * (scores - drift), 300))).sum() - 1)
    low, high = 1e-3, 5.0
    if not len(scores) or value(high) < 0:
        return high if len(scores) else 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _chance(scores: np.ndarray, counts: np.ndarray, words: float, rate: float) -> float:
    """K, from the clean segments: those that reach their mean score are K * words * exp(-rate * score) in number."""
    if not counts.sum():
        return min(K, 1.0 / max(words, 1.0))  # none was seen, so there is less than one in all words
    mean = float((scores * counts).sum() / counts.sum())
    return float(counts[scores >= mean].sum() / max(words, 1.0) * math.exp(min(rate * mean, 50.0)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's steps on binned counts, with a small ridge."""
    if not n.sum() or not (y * n).sum():
        return -20.0, 0.0
    b = np.array([0.0, 0.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (n * (y - p)) - np.array([0.0, 1e-3]) * b
        hess = (design * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(max(b[1], 0.0))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y, the number of words and the different words of rows of y and a text."""
    for b in batches:
        words = [words_of(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([list(dict.fromkeys(w)) for w in words], pa.list_(pa.string()))], ["y", "n", "ws"])


def _scan(model: Model):
    """y, the number of words, the scores of the segments, and counts of the words by score bin, of rows of y and a text."""
    pairs = pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, bins = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                sizes.append(len(words))
                found.append([s for *_, s in model.scan(words)])
                values, n = np.unique(np.round(np.array([model.score(w) for w in words]) / SCORE_BIN).astype(np.int32), return_counts=True)
                bins.append([{"bin": int(v), "n": int(c)} for v, c in zip(values, n, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(bins, pairs)], ["y", "n", "found", "bins"])

    return run


def fit(training: DataFrame, text_col: str, label_col: str, scratch: Scratch | None = None) -> Model:
    """A model from labelled rows, whose number bounds the units that have evidence; counts by bins reach the driver besides.

    With `scratch` the scanned rows are written, else they are scanned twice.
    """
    rows = training.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    split = rows.select("y", "t").mapInArrow(_split, "y int, n long, ws array<string>")
    total = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n_toxic, n_clean = (float(x or 0) for x in total)
    if not n_toxic or not n_clean:
        return Model()
    counted = split.select("y", F.explode("ws").alias("w")).groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    prefixes = [F.when(F.length("w") >= n, F.concat(F.lit("^"), F.substring("w", 1, n))) for n in PREFIXES]
    units = counted.select(F.explode(F.array_compact(F.array_distinct(F.array("w", *prefixes)))).alias("unit"), "toxic", "clean").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    prior = F.lit(FLOOR) + F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(n_toxic + n_clean)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / F.lit(n_toxic + PRIOR)) - F.log(b / F.lit(n_clean + PRIOR))
    away = F.lit(CONFIDENCE) * F.sqrt(1 / a + 1 / b)
    bound = F.when((odds > away) & (F.col("toxic") >= 2), odds - away).when((odds < -away) & (F.col("clean") >= 2) & ~F.startswith("unit", F.lit("^")), odds + away)
    model = Model({r.unit: r.bound for r in units.select("unit", bound.alias("bound")).where(F.abs("bound") > LEAST).collect()})
    scanned = rows.select("y", "t").mapInArrow(_scan(model), "y int, n long, found array<double>, bins array<struct<bin: int, n: long>>")
    scanned = scratch.write(scanned, "scanned") if scratch else scanned
    clean = scanned.where("y = 0")
    words = clean.select(F.explode("bins").alias("b")).groupBy("b.bin").agg(F.sum("b.n").alias("n")).collect()
    n_words = float(sum(r.n for r in words))
    model.rate = _rate(np.array([r.bin * SCORE_BIN for r in words], float), np.array([r.n / max(n_words, 1.0) for r in words], float))
    hits = clean.select(F.explode("found").alias("s")).groupBy(F.floor(F.col("s") / SCORE_BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    model.k = _chance(np.array([r.bin * SCORE_BIN for r in hits], float), np.array([r.n for r in hits], float), n_words, model.rate)
    chance = F.log(F.greatest(F.lit(model.k) * F.col("n"), F.lit(1e-9)) / F.lit(SIGNIFICANT))
    excess = F.aggregate("found", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(model.rate) * s - chance, F.lit(0.0)))
    bins = scanned.select("y", F.floor(F.log1p(excess) / BIN).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    model.bias, model.slope = _logistic(np.array([(r.bin + (r.bin > 0) * 0.5) * BIN for r in bins], float), np.array([r.y for r in bins], float), np.array([r.n for r in bins], float))
    return model


def excesses(df: DataFrame, text_col: str, model: Model, keep_text: bool = False) -> DataFrame:
    """`df`, without its text unless asked for, with n_words, excess (summed over passages) and passages."""
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    passage = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("excess", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("excess", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    at, rest = df.columns.index(text_col), [i for i, c in enumerate(df.columns) if keep_text or c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())]))
        for b in batches:
            n, sums, found = [], [], []
            for text in b.column(at):
                words, ps = m.passages(text.as_py() or "")
                n.append(words)
                sums.append(math.fsum(p[3] for p in ps))
                found.append([dict(zip(("first_word", "last_word", "score", "excess"), p, strict=True)) for p in ps])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(found, kind)], [*(f.name for f in kept), "n_words", "excess", "passages"])

    return df.mapInArrow(run, schema)


def judge_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """`docs`, without its text column unless asked for, with n_words, excess, passages and the score.

    A null or empty text has no passage and gets the score of a text without evidence. Repeated rows are judged each;
    there is no shuffle. Columns of the new names are replaced; an empty table gives none.
    """
    cols = without(docs, "n_words", "excess", "passages", score_col.lower())
    out = excesses(docs.select(*cols), text_col, model, keep_text)
    z = F.lit(model.bias) + F.lit(model.slope) * F.log1p("excess")
    return out.withColumn(score_col, 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z)))))
