"""MinHash near-duplicate detection with sequential Bayesian verification.

Signatures are cut into bands; documents that agree on a band are candidates. A candidate pair's signatures are
compared batch by batch. After n positions of which m agree, with a uniform prior, the similarity is at least t with
the probability that a binomial of n + 1 trials with chance t is at most m; a pair is dropped once that is below the
chosen miss probability. Pairs that stay are verified on their full shingle sets.

Only what decides the components is compared. Documents with equal sets are one. In every band bucket all are
compared with the least document; where that leaves a bucket in several components, the members outside its largest
component are compared, block by block, with those in it and with each other. No pair within a component is made, and
a group holds about ``2 * BLOCK`` documents whatever the bucket's size.

With 40 bands of 5 a pair at similarity 0.75 shares no bucket with a chance of 2e-5, at 0.8 of 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.byte_hash import mix
from spendscope.llm.common import cut, map_arrow, table
from spendscope.llm.graph import components
from spendscope.llm.shingles import MinHash, shingle_sets

BANDS, ROWS = 40, 5
STEP = 25  # signature positions compared at a time
MISS = 1e-7
NUMERATOR, DENOMINATOR = 75, 100  # the least similarity
BLOCK = 128


@lru_cache(maxsize=8)
def least_agreements(size: int, step: int, similarity: float, miss: float) -> tuple[int, ...]:
    """For n = step, 2 * step, ... up to size: the fewest agreements among n with which a pair may still be similar."""
    out = []
    for n in range(step, size + 1, step):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray, similarity: float, miss: float, step: int = STEP) -> np.ndarray:
    """Which rows of ``others`` the sequential comparison with ``one`` leaves."""
    left = np.arange(len(others))
    agreed = np.zeros(len(others), np.int64)
    for k, least in enumerate(least_agreements(len(one), step, similarity, miss)):
        part = slice(k * step, (k + 1) * step)
        agreed = agreed + (others[left, part] == one[part]).sum(axis=1)
        keep = agreed >= least
        left, agreed = left[keep], agreed[keep]
        if not len(left):
            break
    return left


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' Jaccard similarity reaches the threshold, in integers."""
    if min(len(a), len(b)) * DENOMINATOR < NUMERATOR * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; bands differ in their keys."""
    parts = signature.reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys ^ mix(parts[:, k] + np.uint64(k)))
    return keys.view(np.int64)


def profiles(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key, keys: the band keys stand with the first of equal sets in an input batch."""
    hasher = MinHash(bands * rows)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, names, keys, seen = [], [], [], set()
        for shingles in shingle_sets(batch.column("text").to_pylist(), words):
            name = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
            sizes.append(len(shingles))
            names.append(name)
            if name is None or name in seen:
                keys.append(None)
            else:
                seen.add(name)
                keys.append(band_keys(hasher.of(shingles), bands, rows))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "keys"],
        )

    # whole batches, as copies within one are told apart from new sets
    return map_arrow(docs, make, "doc_id long, n_shingles long, set_key binary, keys array<long>", rows=None)


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y) -> None:
        self.up[self.find(x)] = self.find(y)


def _pairs(a: Iterable, b: Iterable) -> pa.Table:
    return pa.table({"a": pa.array(list(a), pa.int64()), "b": pa.array(list(b), pa.int64())})


def star_edges(docs: DataFrame, members: DataFrame, hasher: MinHash, words: int, miss: float) -> DataFrame:
    """(a, b): leaders a and the members b of their buckets that are similar.

    A leader's members are dealt to groups of at most about ``BLOCK``, each with the leader's text.
    """
    pairs = members.where("doc_id <> leader").select("leader", "doc_id").distinct()
    count = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(count, "leader").select(
        "leader", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")
    )
    heads = count.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    texts = dealt.unionByName(heads).join(docs, "doc_id")

    def verify(group: pa.Table) -> pa.Table:
        leader = group["leader"][0].as_py()
        ids = group["doc_id"].to_numpy()
        sets = list(shingle_sets(group["text"].to_pylist(), words))
        signatures = np.stack([hasher.of(s) for s in sets])
        found = set()
        others = np.flatnonzero(ids != leader)
        for k in np.flatnonzero(ids == leader):
            for m in others[survivors(signatures[k], signatures[others], NUMERATOR / DENOMINATOR, miss)]:
                if similar(sets[k], sets[m]):
                    found.add(int(ids[m]))
        return _pairs([leader] * len(found), found)

    return texts.groupBy("leader", "part").applyInArrow(verify, "a long, b long")


def block_edges(docs: DataFrame, open_members: DataFrame, hasher: MinHash, words: int, miss: float) -> DataFrame:
    """(a, b): similar members of different components in buckets (key, doc_id, component), a spanning set of them.

    The members outside a bucket's largest component are dealt to blocks that meet all blocks of that component and
    each other; the documents of the largest component do not meet.
    """
    sizes = open_members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(
        F.max_by("component", "n").alias("major"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside")
    ).select("key", "major", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("inside", "outside")))
    own = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")
    each = lambda blocks, make: F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), make)
    pair = lambda i, j, both: F.struct(i.alias("i"), j.alias("j"), F.lit(both).alias("outside"))
    in_major = F.col("component") == F.col("major")
    meetings = F.when(in_major, each("outside", lambda i: pair(i, own("inside"), False))).otherwise(F.concat(
        each("inside", lambda j: pair(own("outside"), j, False)),
        each("outside", lambda i: pair(F.least(own("outside"), i), F.greatest(own("outside"), i), True)),
    ))
    dealt = open_members.join(buckets, "key").select(
        "key", "doc_id", "component", in_major.alias("in_major"), F.explode(meetings).alias("at")
    ).join(docs, "doc_id")

    def verify(group: pa.Table) -> pa.Table:
        ids, component = group["doc_id"].to_pylist(), group["component"].to_numpy()
        major, outside = group["in_major"].to_numpy(zero_copy_only=False), group["at"][0].as_py()["outside"]
        sets = list(shingle_sets(group["text"].to_pylist(), words))
        signatures = np.stack([hasher.of(s) for s in sets])
        union, found = _Union(), []
        for k in np.flatnonzero(~major):
            others = np.arange(k + 1, len(ids)) if outside else np.flatnonzero(major)
            others = others[component[others] != component[k]]
            for m in others[survivors(signatures[k], signatures[others], NUMERATOR / DENOMINATOR, miss)]:
                if union.find(component[k]) != union.find(component[m]) and similar(sets[k], sets[m]):
                    union.join(component[k], component[m])
                    found.append((ids[k], ids[m]))
        return _pairs((a for a, _ in found), (b for _, b in found))

    return dealt.groupBy("key", "at").applyInArrow(verify, "a long, b long")


def open_once(of_bucket: DataFrame) -> DataFrame:
    """The keys of the buckets with several components; of equal buckets one.

    Buckets are equal by their size, least and greatest id, and two exact sums of 64-bit hashes of the ids.
    """
    sums = [F.sum(F.xxhash64("doc_id", F.lit(seed)).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    spread = of_bucket.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *sums,
    ).where("lo <> hi")
    return spread.groupBy("n", "first", "last", "sum1", "sum2").agg(F.min("key").alias("key")).select("key")


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS, words: int = 5,
    miss: float = MISS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``df``.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows of one
    doc_id are one document. A row without doc_id is linked with nothing and kept. Other columns are ignored.
    """
    hasher = MinHash(bands * rows)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profile = cut(profiles(docs, bands, rows, words))
    linked = profile.where("n_shingles > 0 and doc_id is not null")
    classes = cut(linked.groupBy("set_key").agg(
        F.min("doc_id").alias("low"), F.min(F.when(F.col("keys").isNotNull(), F.col("doc_id"))).alias("node")
    ).select("set_key", "low", F.coalesce("node", "low").alias("node")))

    banded = linked.where("keys is not null").select("doc_id", F.explode("keys").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(leaders, "key"))
    wanted = members.select("doc_id").distinct()
    candidates = cut(docs.join(wanted, "doc_id"))

    copies = linked.join(classes, "set_key").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    # a doc_id that stands with several texts links their sets
    edges = cut(star_edges(candidates, members, hasher, words, miss).unionByName(copies))
    labels = cut(components(edges))

    of_bucket = members.where("n > 2").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    more = cut(block_edges(candidates, of_bucket.join(open_once(of_bucket), "key"), hasher, words, miss))
    if not more.isEmpty():
        labels = cut(components(edges.unionByName(more)))

    named = classes.join(labels, "node", "left").select("set_key", "low", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_set = cut(named.join(least, "component").select("set_key", "component_id"))
    out = profile.join(of_set, "set_key", "left").select(
        F.col("doc_id"), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"),
    )
    return out.select(
        F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def op5_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
