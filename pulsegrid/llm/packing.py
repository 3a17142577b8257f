"""Token packing by power-of-two decomposition.

A document's token ids are cut into full sequences of `seq_len` and then into the binary digits of the rest, so each
piece's length is a power of two. Every piece is a sequence of its own: no sequence crosses documents, none is padded,
and the pieces of one length make one bucket, from which batches of equal shape are drawn.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text on which every version of the Unicode tables agrees what is a letter, a digit or white space.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u017f]*\Z")


class TextEncoder:
    """Token ids of a byte-level BPE file of the tokenizers library, as little-endian 32-bit bytes.

    Plain Latin text goes through tiktoken, which merges by the same vocabulary (read from the same file) several times
    faster; all other text, and text that holds an added token, goes through tokenizers itself. The ids are the same.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        raw = self._bytes_of()
        ranks = {bytes(raw[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in added}
        self.fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes_of() -> dict[str, int]:
        """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 in order."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def encode(self, text: str) -> bytes:
        if _PLAIN.match(text) and not self.added.search(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def pieces(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full sequences, then the binary digits of the rest, large to small."""
    out = [(s, seq_len) for s in range(0, n - seq_len + 1, seq_len)]
    at, rest = n // seq_len * seq_len, n % seq_len
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def stored_order(docs: DataFrame) -> list[Column]:
    """What sorts the rows of a table of Parquet files as they were written: the number of the part, its file, the row in
    it. None where `docs` isn't read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return []
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 1024, end_id: int = 0, order: Sequence[Column] = ()) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (little-endian 32-bit), bucket (log2 of the length),
    sequence_id, offset.

    `seq_len` must be a power of two. A null text counts as empty and gives one piece with `end_id` alone; repeated rows
    are packed each on their own; other columns are not read, so names don't clash; an empty table gives none. The
    sequence ids follow the order of the input's partitions, so they hold when a task runs again, and there is no
    shuffle. With `order`, documents are range-sorted by it first, and the sequence ids follow that order.
    """
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if order:
        names = [f"order_{i}" for i in range(len(order))]
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(order, names, strict=True)])
        rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")] + [T.StructField("ids", T.BinaryType())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            which, start, length, total, ids = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                raw = enc.encode(text.as_py()) + end
                n = len(raw) // 4
                cut = pieces(n, seq_len)
                which += [k] * len(cut)
                start += [s for s, _ in cut]
                length += [m for _, m in cut]
                total += [n] * len(cut)
                ids += [raw[4 * s : 4 * (s + m)] for s, m in cut]
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([long(which), b.column(0).take(long(which)), long(start), long(length), long(total), pa.array(ids, pa.binary())], ["row", "id", "start", "length", "doc_tokens", "ids"])

    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "doc_tokens",
        "ids",
        F.round(F.log2("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The packed sequences as a table with one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)


def piece_digests(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
