"""What the training-data operators share: table access, row keys, the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Regular expressions of a word and of what separates words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The same separators as characters, for translate().
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own; on a
    cluster that is an error, as each machine would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. `write` cuts the lineage; `drop` removes what is no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark's cleaner find the shuffles of finished jobs."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that start like `names` and clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` but for those of these names, whose case doesn't count, as in Spark."""
    return [c for c in df.columns if c.lower() not in names]


def numbered(df: DataFrame, id_col: str) -> bool:
    """Whether `keyed` numbers the rows, as the ids don't tell them apart."""
    if not isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return True
    again = df.groupBy(F.col(id_col).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return again.where("i is null or n > 1").limit(1).count() > 0


def keyed(df: DataFrame, id_col: str, key: str, scratch: Scratch) -> DataFrame:
    """`df` with a column `key` that tells its rows apart (long, never null).

    Where `id_col` is an integer column without nulls and repeats, it is the key itself. Otherwise the rows are numbered
    by id (null last) and content, and written to the shared folder: rows that differ get the same numbers however the
    input is split, and equal rows are interchangeable.
    """
    if not numbered(df, id_col):
        return df.withColumn(key, F.col(id_col).cast("long"))
    content, place = fresh(df, "row_content", "row_place")
    hashed = [c.name for c in df.schema.fields if not isinstance(c.dataType, T.MapType)]
    told = df.withColumn(content, F.xxhash64(*hashed)).withColumn(place, F.monotonically_increasing_id())
    return ranked(told, [F.col(id_col).isNull(), F.col(id_col), F.col(content), F.col(place)], "keyed", scratch, key).drop(content, place)


def ranked(df: DataFrame, order: list[str | Column], name: str, scratch: Scratch, rank: str = "rank") -> DataFrame:
    """`df`, written range-sorted by `order`, with each row's place in that order from 0.

    Only the row counts of the written partitions go through the driver. `order` should tell rows apart: ties have some
    order among themselves.
    """
    at = fresh(df, "row_at")[0]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = scratch.write(placed, name)
    part = F.shiftright(at, 33)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())
    starts = [0]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    first = F.element_at(F.split(F.lit(" ".join(map(str, starts))), " ").cast("array<bigint>"), part.cast("int") + 1)
    return placed.withColumn(rank, first + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


def fold_of(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


#: A classifier is fitted on this many labelled rows at most; those of the least hash of their id are taken.
MAX_LABELLED = 200_000


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, label: str, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_LABELLED) -> DataFrame:
    """(id, t, y) of the labelled rows outside the held-out fold, written once.

    A document with several labels counts as 1 if any of them is 1; null labels are left out, and so are null ids. As
    there are at most `max_rows` labels, they are broadcast and no text is shuffled.
    """
    learned = labels.where((fold_of(F.col(id_col), folds) != held_out) & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = learned.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.where(fold_of(F.col(id_col), folds) != held_out).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return scratch.write(rows.join(F.broadcast(chosen), "id").select("id", "t", "y"), "training")


def crc32_sql(blob: str) -> str:
    """SQL for the unsigned crc32 of a blob: the checksum's table for four bits, made by its rule, is applied twice to each
    byte."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(f"{c}::bigint")
    half = lambda a: f"xor({a} >> 4, [{', '.join(table)}][({a} & 15) + 1])"
    bytes_of = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda s: ('0x' || s)::bigint)"
    return f"xor(list_reduce({bytes_of}, lambda a, x: {half(half('xor(a, x)'))}, 4294967295::bigint), 4294967295::bigint)"
