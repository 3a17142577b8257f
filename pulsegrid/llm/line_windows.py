"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines are hashed (128 bits). A window that appears more than once anywhere keeps its first
occurrence, by document and position; the lines that later occurrences cover are merged and removed. Each removed line
still stands somewhere earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, fresh, keyed, without

VISIBLE = r"[^\x20\x09-\x0D]"


def dedupe_lines(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its text cleaned, and with n_lines and n_removed (lines).

    Lines are separated by a line feed and compared exactly. Windows without a visible character don't count, so runs of
    blank lines stay; texts of fewer than three lines have no window. A null text stays null (0 lines). Documents are
    ordered by id, null last; rows that share an id are told apart by their number. Of repeated rows, the first keeps
    its lines. Columns of the names n_lines and n_removed are replaced; an empty table gives none.
    """
    kept = without(docs, "n_lines", "n_removed")
    key, lines, gone = fresh(docs, "row_key", "all_lines", "gone_lines")
    rows = keyed(docs.select(*kept), id_col, key, scratch)
    split = F.split(F.col(text_col), "\n", -1)
    cut = rows.select(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("doc"), split.alias("a")).where(F.size("a") >= 3)
    n = F.size("a")
    three = F.arrays_zip(F.slice("a", F.lit(1), n - 2).alias("x"), F.slice("a", F.lit(2), n - 2).alias("y"), F.slice("a", F.lit(3), n - 2).alias("z"))
    windows = (
        cut.select("doc", F.posexplode(three).alias("pos", "w"))
        .where(F.col("w.x").rlike(VISIBLE) | F.col("w.y").rlike(VISIBLE) | F.col("w.z").rlike(VISIBLE))
        .select(F.xxhash64("w.x", "w.y", "w.z").alias("h1"), F.xxhash64(F.lit("other"), "w.z", "w.y", "w.x").alias("h2"), F.struct("doc", "pos").alias("at"))
    )
    # Written, so that the join is of two plain tables and a window that very many documents hold can be split.
    firsts = scratch.write(windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    later = windows.join(firsts, ["h1", "h2"]).where("at > first").select(F.col("at.doc.key").alias(key), F.explode(F.sequence(F.col("at.pos"), F.col("at.pos") + 2)).alias("line"))
    covered = later.groupBy(key).agg(F.collect_set("line").alias(gone))
    joined = rows.join(covered, key, "left").withColumn(lines, split)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


ORACLE = r"""
with l as (select doc_id, text, string_split(text, chr(10)) as a from documents),
w as (
  select doc_id, i - 1 as pos, a[i] || chr(10) || a[i + 1] || chr(10) || a[i + 2] as k
  from (select doc_id, a, unnest(range(1, len(a) - 1)) as i from l where len(a) >= 3)),
v as (select doc_id, pos, row_number() over (partition by k order by doc_id, pos) as r from w where regexp_matches(k, '[^\x20\x09-\x0D]')),
gone as (select distinct doc_id, pos + d as pos from v, (values (0), (1), (2)) t(d) where r > 1),
line as (select doc_id, unnest(a) as x, unnest(range(0, len(a))) as pos from l),
kept as (
  select doc_id, string_agg(x, chr(10) order by line.pos) as t from line left join gone using (doc_id, pos) where gone.pos is null group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select l.doc_id, coalesce(len(a), 0)::bigint as n_lines, coalesce(n.n, 0)::bigint as n_removed, md5(case when l.text is not null then coalesce(t, '') end) as kept_md5
from l left join kept using (doc_id) left join n using (doc_id)
"""
