"""Near-duplicate documents by min-max hashing.

Under each of 64 permutations of the shingle hashes both the minimum and the maximum are kept: 128 signature values for
64 hash evaluations. 32 bands of two minima and two maxima propose candidates; every link is confirmed on the full sets.

Documents with equal sets are one class from the start. In each bucket of a band the first class is compared with the
others, and connected components contract what is linked. Classes that still share a bucket across components form
families; those that can't link with anything, because more than a quarter of their shingles occur in no other
candidate, leave first. A family is dealt into blocks, and each pair of blocks counts common shingles for all its
documents at once, so no row is made for a pair that isn't linked and no candidate link is lost. At a similarity of 0.75
a band agrees with probability 0.316, so a link at the threshold escapes all 32 bands with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, fresh, keyed, without
from pulsegrid.llm.components import components
from pulsegrid.llm.rolling import U, mix, shingles

PERMUTATIONS, BANDS = 64, 32
#: Documents and shingles of a block, where many candidates that share buckets are compared with each other.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Of a link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=U)) | U(1)
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=U))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima under each permutation."""
    low, high = np.full(PERMUTATIONS, ~U(0)), np.zeros(PERMUTATIONS, U)
    for at in range(0, len(hashes), 4096):
        values = hashes[at : at + 4096, None] * _A + _B
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    return low, high


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band: of the minima of two permutations and the maxima of two others, and the band's number."""
    low, high = signature(hashes)
    high = np.roll(high, 17)
    rows = np.stack([low[0::2], low[1::2], high[0::2], high[1::2]])
    out = np.arange(1, BANDS + 1, dtype=U)
    for row in rows:
        out = mix(out * U(0x9E3779B97F4A7C15) + row)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, d1, d2, found = [], [], [], []
        for text in b.column(1):
            h = shingles(text.as_py())
            n.append(len(h))
            d1.append(int(h.sum(dtype=U).astype(np.int64)))
            d2.append(int(mix(h ^ U(0x5851F42D4C957F2D)).sum(dtype=U).astype(np.int64)))
            found.append(bands(h).astype(np.int64) if len(h) else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists], ["key", "n", "d1", "d2", "bands"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, 256):
            part = b.slice(low, 256)
            sets = [shingles(t.as_py()).astype(np.int64) for t in part.column(1)]
            keys = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(sets) if sets else [], pa.int64())], ["key", "h"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, np.ndarray] = {}

    def full(key: int, text: pa.Scalar) -> np.ndarray:
        if key not in kept:
            if len(kept) >= 64:
                kept.pop(next(iter(kept)))
            kept[key] = shingles(text.as_py())
        return kept[key]

    for b in batches:
        a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
        linked = []
        for i, (x, y) in enumerate(zip(a, c, strict=True)):
            p, q = full(x, b.column(2)[i]), full(y, b.column(3)[i])
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * both >= THRESHOLD * (len(p) + len(q) - both))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a pair (or within one), by counts of common shingles for all of them at once.

    Of the links between two components one is enough, so at most as many are returned as there are documents.
    """
    texts, blocks, comps = rows["text"].tolist(), rows["block"].to_numpy(), rows["c"].to_numpy()
    keys = rows["key"].to_numpy()
    sets = [shingles(t) for t in texts]
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((len(sets), min(8192, width - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += (part @ part.T).astype(np.int64)  # at most 8192, so exact in float32
    linked = 100 * both >= THRESHOLD * (size[:, None] + size[None, :] - both)
    linked &= comps[:, None] != comps[None, :]
    if rows["i"].iat[0] != rows["j"].iat[0]:
        linked &= blocks[:, None] != blocks[None, :]
    root = {int(c): int(c) for c in comps}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        p, q = find(int(comps[x])), find(int(comps[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((keys[x], keys[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_shingles, component_id (the smallest id reachable) and is_first (one row of each component).

    A null text, and one without words, has an empty set, links with nothing and is its own component. Rows of equal
    texts are one class, also where they share an id; null ids come after others and don't name a component. An
    empty table gives none; columns of the new names are replaced.
    """
    cols = without(docs, "n_shingles", "component_id", "is_first")
    key, rep, comp, one = fresh(docs, "row_key", "class_key", "comp_key", "first_key")
    rows = keyed(docs.select(*cols), id_col, key, scratch)
    input_ = rows.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    sets = scratch.write(input_.mapInArrow(_sets, "key long, n long, d1 long, d2 long, bands array<long>"), "sets")
    same = ["n", "d1", "d2"]
    # Aggregates are written before they are joined: a join of two plain tables can split a hot key.
    classes = scratch.write(sets.where("n > 0").groupBy(*same).agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "classes")
    member = scratch.write(sets.select("key", *same).join(classes, same, "left").select("key", "n", F.coalesce("rep", "key").alias("rep")), "member")

    # First comparisons: in each bucket, the first class with every other.
    firsts = sets.where("n > 0").join(member.where("key <> rep").select("key"), "key", "left_anti")
    entries = firsts.select(F.explode("bands").alias("h"), "key", "n")
    shared = scratch.write(entries.groupBy("h").agg(F.min(F.struct("key", "n")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1").select("h", "p"), "shared")
    bucket = scratch.write(entries.join(shared, "h").select("h", "key", "n", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")), "bucket")
    fits = "100 * least({0}, {1}) >= " + str(THRESHOLD) + " * greatest({0}, {1})"
    pairs = bucket.where("key <> pivot").where(fits.format("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    pairs = scratch.write(pairs, "pairs")
    keys = bucket.select("key").distinct()
    texts = scratch.write(input_.join(keys, "key", "left_semi"), "texts")
    links = scratch.write(confirm(pairs, texts), "links")
    linked = components(links, scratch, "near").select(F.col("node").alias("key"), F.col("component").alias("c"))

    # What still shares a bucket across components.
    placed = bucket.select("h", "key", "n").join(linked, "key", "left").withColumn("c", F.coalesce("c", "key"))
    open_ = scratch.write(placed.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("h"), "mixed")
    left = scratch.write(placed.join(open_, "h", "left_semi"), "open")
    around = texts.join(left.select("key").distinct(), "key", "left_semi")
    alone = around.mapInArrow(_each_shingle, "key long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("key")).where("times = 1").groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    able = left.join(alone, "key", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).where(f"100 * most >= {THRESHOLD} * n").drop("alone")
    able = scratch.write(able, "able")
    ends = scratch.write(able.groupBy("h").agg(F.min("key").alias("p"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("h", "p"), "ends")
    family = components(able.join(ends, "h").select(F.col("p").alias("a"), F.col("key").alias("b")), scratch, "family")
    relatives = scratch.write(able.select("key", "c", "n").distinct().join(family.select(F.col("node").alias("key"), F.col("component").alias("f")), "key"), "relatives")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = scratch.write(relatives.groupBy("f").agg(blocks.alias("blocks"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("f", "blocks"), "sizes")
    block = relatives.join(sizes, "f").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = block.select("f", "key", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("f", "key", "c", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    links2 = scratch.write(dealt.join(texts, "key").groupBy("f", "i", "j").applyInPandas(_block_links, "a long, b long"), "links2")
    final = components(links.union(links2), scratch, "all").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    scratch.drop("sets", "classes", "shared", "bucket", "pairs", "texts", "links", "mixed", "open", "able", "ends", "relatives", "sizes", "links2")

    named = scratch.write(member.join(final, "rep", "left").select("key", "n", F.coalesce("comp", "rep").alias(comp)), "named")
    ids = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id")).join(named, "key").groupBy(comp).agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias(one))
    # Texts meet their component by row, so a large component is nowhere gathered with its texts.
    tagged = named.join(scratch.write(ids, "ids"), comp).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col(f"{one}.id").alias("component_id"), (F.col("key") == F.col(f"{one}.key")).alias("is_first"))
    return rows.join(tagged, key).select(*cols, "n_shingles", "component_id", "is_first")


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
e as (select x, y from l union select y, x from l),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
m as (select x as doc_id, min(y) as least_id from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) as component_id, d.doc_id <= coalesce(least_id, d.doc_id) as kept
from d left join n using (doc_id) left join m using (doc_id)
"""
