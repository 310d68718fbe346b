"""Packing by power-of-two decomposition.

A document of n tokens is split into pieces whose lengths are powers of two: as many of the longest length as fit,
then one for each bit of the rest, longest first. Pieces of the same length form a bucket, and each piece is a
sequence of its own, so batches of one bucket need no padding and no sequence crosses documents.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.bpe_automaton import _byte_letters
from spendscope.llm.common import map_arrow, table

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 1
LONGEST = 2048


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file; ids are merge ranks there, so the faster rank encoder can run it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {token: i for token, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def document_ids(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    ids = byte_bpe(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of n tokens, longest first; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None,
    longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (, ids).

    ``bucket`` is the binary logarithm of the length: write with ``partitionBy("bucket")`` to get batches of equal
    lengths. Null and empty texts are one piece, the end token. Repeated rows are packed each for itself. Other
    columns of ``df`` are ignored. sequence_id counts within an input partition above the partition's number, so
    it is unique and a repeated task gives the same.
    """
    path = path or public_tokenizers.path(BYTE_BPE)
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    kind = df.schema[doc_id].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total, pieces = [], [], [], [], [], []
        for k, value in enumerate(batch.column("text").to_pylist()):
            ids = document_ids(value, path, end_id)
            raw, at = memoryview(ids).cast("B"), 0
            for n in binary_lengths(len(ids), longest):
                row.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                total.append(len(ids))
                if with_ids:
                    pieces.append(ids[at : at + n].astype(np.int32))
                at += n
        columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns.append(pa.array(pieces, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    rows = map_arrow(
        df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), make, schema + ", ids array<int>" * with_ids
    )
    return rows.select(
        F.col("doc_id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), *["ids"] * with_ids,
    )


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
