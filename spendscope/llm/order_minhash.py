"""Order MinHash fingerprints, in DataFrame functions only.

A text is cut into tokens (up to eight characters other than white space, and what white space follows), and its
k-mers are runs of k tokens. The i-th time that a k-mer occurs it counts as another element, numbered i. Each
sketch orders all elements by a hash of its own and selects the least l. The selected elements of a sketch are put
back into text order and hashed as a tuple. Two texts agree on a sketch if they selected the same elements in the
same order, which repeated or moved passages change as edits do. Likeness is the share of equal sketches among
those that either text fills.

Bit s of the j-th hash word of an element is the j-th bit of its rank in sketch s, so the conjunction of some
complemented words says in which of 64 sketches an element ranks low enough to come into question. How many words
are looked at goes by the text's length; where a sketch would be left with fewer than l elements it looks at fewer,
in the end at none, which brings in all elements. The selection is always the least l of all.

A cheaper form deals every element to one sketch and one of l slots by one hash (``every=False``). On texts of
fewer than some hundred pieces its tuples hold one element, hence no order.

Everything about one document happens in the partition where its bucket of neighbouring ids lies: the text is
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendscope.llm.common import shuffle_partitions, table

SKETCHES, SLOTS, KMER = 64, 2, 2
PIECE = r"\S{1,8}+\s*+"
PARTITION_BYTES = 4_000_000  # of text; a token takes some fifty bytes while it is sorted
ROW_BYTES = 2_000  # counted for any text besides its length: its candidates for the sketches
WORDS = 14  # hash words that rank an element before its last hash does
LEVEL = 16
MOST_BUCKETS = LEVEL**3  # as their bounds are collected; larger buckets only sort longer


def kmers(text: Column, k: int) -> Column:
    """The runs of k tokens, one for each token; end marks fill up the last ones."""
    return F.regexp_extract_all(F.concat(text, F.lit(" \1" * (k - 1))), F.lit(f"(?=((?:{PIECE}){{{k}}})){PIECE}"), F.lit(1))


def _candidates(elements: DataFrame, key: list[str], sketches: int, slots: int) -> DataFrame:
    """The elements in all sketches where they may be among the least ``slots``, with the sketch and their rank there."""
    words = -(-sketches // 64)
    g, word = F.col("g"), F.col("word")
    if words > 1:
        elements, key = elements.withColumn("word", F.explode(F.array(*map(F.lit, range(words))))), [*key, "word"]
    else:
        elements = elements.withColumn("word", F.lit(0))
    last = sketches - 64 * (words - 1)
    valid = F.when(word == words - 1, F.lit((1 << last) - 1 if last < 64 else -1)).otherwise(F.lit(-1))

    def low(level: Column) -> Column:
        mask = F.lit(-1).cast("bigint")
        for j in range(1, WORDS + 1):
            mask = mask.bitwiseAND(F.when(level >= j, F.bitwise_not(F.xxhash64(g, F.lit(j), word))).otherwise(F.lit(-1).cast("bigint")))
        return mask

    near = F.greatest(F.lit(0), F.least(F.lit(WORDS), F.floor(F.log2(F.col("size") / (4 * slots))).cast("int")))
    found = elements.withColumn("near", near).withColumn("far", F.greatest(F.lit(0), F.col("near") - 2))
    found = found.select("*", low(F.col("near")).alias("near_bits"), low(F.col("far")).alias("far_bits"))
    # Sketches that get an element of each of ``slots`` classes have ``slots`` elements at least.
    whole, kind = Window.partitionBy(*key), F.pmod(F.shiftrightunsigned("g", 32), F.lit(slots))

    def enough(bits: str) -> Column:
        out = F.lit(-1).cast("bigint")
        for other in (1, 2):
            for c in range(slots):
                got = F.bit_or(F.when((F.col("part") != other) & (kind == c), F.col(bits))).over(whole)
                out = out.bitwiseAND(F.coalesce(got, F.lit(0).cast("bigint")))
        return out

    found = found.select("*", enough("near_bits").alias("near_ok"), enough("far_bits").alias("far_ok"))
    bits = F.col("near_bits").bitwiseAND(F.col("near_ok")).bitwiseOR(
        F.col("far_bits").bitwiseAND(F.col("far_ok")).bitwiseAND(F.bitwise_not("near_ok"))
    ).bitwiseOR(F.bitwise_not(F.col("near_ok").bitwiseOR(F.col("far_ok")))).bitwiseAND(valid)
    kept = [*(c for c in key if c != "word"), "part", "pos", "g", "word"]
    found = found.select(*kept, bits.alias("bits")).where("bits <> 0")
    found = found.select("*", F.explode(F.array(*map(F.lit, range(0, 64, 4)))).alias("lane"))
    found = found.select("*", F.expr("cast(shiftrightunsigned(bits, lane) & 15 as int)").alias("four")).where("four <> 0")
    set_bits = F.array(*(F.array(*(F.lit(b) for b in range(4) if n >> b & 1)).cast("array<int>") for n in range(16)))
    found = found.select(*kept, "lane", F.explode(F.element_at(set_bits, F.col("four") + 1)).alias("bit"))
    found = found.select(*kept, (F.col("lane") + F.col("bit")).alias("bit"), (F.col("word") * 64 + F.col("lane") + F.col("bit")).cast("bigint").alias("sketch"))
    zeros = F.lit(WORDS)
    for j in range(WORDS, 0, -1):
        zeros = F.when(F.expr(f"shiftrightunsigned(xxhash64(g, {j}, word), bit) & 1") != 0, F.lit(j - 1)).otherwise(zeros)
    rank = (WORDS - zeros).cast("bigint") * F.lit(1 << 56) + F.xxhash64("g", F.lit(-1), "sketch").bitwiseAND(F.lit((1 << 56) - 1))
    return found.select(*kept[:-1], "sketch", rank.alias("rank"))


def _least(elements: DataFrame, key: list[str], sketches: int, slots: int) -> DataFrame:
    """key, sketch, part, pos, g and the place (0 to slots - 1) of the elements each sketch selects for "one" and "two"."""
    ordered = Window.partitionBy(*key, "sketch").orderBy("rank", "g").rowsBetween(Window.unboundedPreceding, 0)
    sides = {"one": F.col("part") != 2, "two": F.col("part") != 1}
    return _candidates(elements, key, sketches, slots).select(
        "*", *((F.count(F.when(of, 1)).over(ordered) - 1).alias(f"{side}_slot") for side, of in sides.items())
    ).where((sides["one"] & (F.col("one_slot") < slots)) | (sides["two"] & (F.col("two_slot") < slots)))


def fingerprints(rows: DataFrame, key: list[str], k: int, sketches: int, slots: int, every: bool = False) -> DataFrame:
    """key and the fingerprints of the texts "one" and "two", which both begin with "both".

    A fingerprint is the sorted array of tuple hashes, their low bits the sketch. Elements that lie in the common
    beginning are made once. Rows whose texts are both empty are left out.
    """
    low = (1 << (sketches - 1).bit_length()) - 1
    lists = rows.select(
        *key, kmers(F.col("one"), k).alias("one"), kmers(F.col("two"), k).alias("two"),
        F.greatest(F.regexp_count(F.col("both"), F.lit(PIECE)) - k, F.lit(0)).alias("common"),
    ).select(*key, "common", F.size("one").alias("n"), F.least(F.size("one"), F.size("two")).alias("size"), F.concat(
        "one", F.slice("two", F.col("common") + 1, F.size("two"))
    ).alias("all"))
    placed = lists.select(*key, "common", "n", "size", F.posexplode_outer("all").alias("at", "kmer")).where("kmer is not null").select(
        *key, "size", F.xxhash64("kmer").alias("h"),
        F.when(F.col("at") < F.col("common"), 0).when(F.col("at") < F.col("n"), 1).otherwise(2).alias("part"),
        F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.col("at") - F.col("n") + F.col("common")).alias("pos"),
    )
    of_kmer = Window.partitionBy(*key, "h").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, 0)
    times = F.when(F.col("part") == 2, F.count(F.when(F.col("part") != 1, 1)).over(of_kmer)).otherwise(F.count(F.lit(1)).over(of_kmer))
    elements = placed.select(*key, "part", "pos", F.xxhash64("h", times).alias("g"), "size")
    if every:
        elements = _least(elements, key, sketches, slots)
    else:
        slot = F.pmod(F.shiftrightunsigned("g", 32), F.lit(slots))
        elements = elements.select("*", F.pmod("g", F.lit(sketches)).alias("sketch"), slot.alias("one_slot"), slot.alias("two_slot"))
    measures, tuples = [], []
    for side, other in (("one", 2), ("two", 1)):
        for s in range(slots):
            g = F.when((F.col(f"{side}_slot") == s) & (F.col("part") != other), F.col("g"))
            measures += [F.min(g).alias(f"{side}_g{s}"), F.min_by("pos", g).alias(f"{side}_p{s}")]
        picked = F.filter(
            F.array_sort(F.array(*(F.struct(F.col(f"{side}_p{s}").alias("p"), F.col(f"{side}_g{s}").alias("g")) for s in range(slots)))),
            lambda x: x["g"].isNotNull(),
        )
        value = F.xxhash64(F.transform(picked, lambda x: x["g"])).bitwiseAND(F.lit(~low)).bitwiseOR(F.col("sketch"))
        tuples.append(F.when(F.size(picked) > 0, value).alias(side))
    per_sketch = elements.groupBy(*key, "sketch").agg(*measures).select(*key, *tuples)
    return per_sketch.groupBy(*key).agg(*(F.sort_array(F.collect_list(side)).alias(side) for side in ("one", "two")))


def likeness(a: Column, b: Column, sketches: int) -> Column:
    """The share of equal tuples among the sketches that either text fills; 1 for two empty fingerprints."""
    low = (1 << (sketches - 1).bit_length()) - 1
    filled = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: x.bitwiseAND(F.lit(low)))))
    return F.when(filled > 0, F.size(F.array_intersect(a, b)) / filled).otherwise(F.lit(1.0))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def beside_next(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """bucket, rid, guest, doc_id, text, next_text: each row with the text of the next by (doc_id, text).

    Buckets are ranges of ids. The first row of a bucket also stands, as a guest, at the end of the bucket before;
    that of the first bucket at the end of the last. A row without id is its own next.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("n"), F.min("doc_id").alias("first")).first()
    partitions = min(MOST_BUCKETS // 2, max(shuffle_partitions(df.sparkSession), -(-(size["n"] or 0) // PARTITION_BYTES)))
    buckets, first = min(MOST_BUCKETS, 4 * partitions), size["first"]
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0]
    cuts = sorted({c for c in found or () if c != first})
    starts = F.lit(cuts) if cuts else F.array().cast("array<bigint>")

    def placed_by(step: int, before: Column) -> Column:
        """How many of every ``step``-th of the next cuts after the first ``before`` are at most the id."""
        heads = F.lit([*cuts[step - 1 :: step], *[2**63 - 1] * LEVEL])
        return before + step * F.size(F.filter(F.slice(heads, F.expr("1") + (before / step).cast("int"), LEVEL), lambda c: c <= F.col("doc_id")))

    docs = docs.withColumn("own", F.lit(0))
    for step in (LEVEL * LEVEL, LEVEL, 1):
        docs = docs.withColumn("own", placed_by(step, F.col("own")))
    alone = F.pmod(F.xxhash64("text"), F.lit(len(cuts) + 1)).cast("int")
    docs = docs.withColumn("own", F.when(F.col("doc_id").isNull(), alone).otherwise(F.col("own")))
    guest = F.when(F.col("doc_id") == F.lit(first), F.lit(len(cuts))).when(
        F.element_at(F.concat(F.array(F.lit(None).cast("bigint")), starts), F.col("own") + 1) == F.col("doc_id"), F.col("own") - 1
    )
    placed = docs.select("doc_id", "text", F.explode(F.array_compact(F.array(
        F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")),
        F.when(guest.isNotNull(), F.struct(guest.cast("int").alias("bucket"), F.lit(True).alias("guest"))),
    ))).alias("at"))
    # never null, so that no filter on one use of it makes the two uses of this shuffle differ
    dealt = placed.select(F.coalesce("at.bucket", F.lit(0)).alias("bucket"), F.coalesce("at.guest", F.lit(False)).alias("guest"), "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")  # without id first, guests last
    return dealt.repartition(partitions, "bucket").select(
        "bucket", F.row_number().over(order).alias("rid"), "guest", "doc_id", "text",
        F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.lead("text").over(order)).alias("next_text"),
    )


def order_minhash(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = KMER, sketches: int = SKETCHES, slots: int = SLOTS,
    every: bool = False,
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the fingerprints of a text and its edited text, and their likenesses.

    The edited text has the last quarter replaced by the beginning of the next document's, in the order of doc_id,
    then text; after the last comes the first. Null texts are empty; an empty text has the empty fingerprint and is
    like another empty text only. A row without doc_id is its own next document. Repeated rows are each other's
    next. Other columns are ignored. Texts of white space only count as empty here.
    With ``every``, each sketch selects from all elements; else each element is dealt to one sketch and slot.
    """
    spark = df.sparkSession
    # Rows of a bucket lie together already; joining on (bucket, rid) need not deal them anew.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = beside_next(df, doc_id, text)
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    beginning = F.substring(F.col("text"), F.lit(1), n - cut)
    rows = rows.select(
        "bucket", "rid", "guest", "doc_id", n.cast("long").alias("n_chars"), beginning.alias("both"), F.col("text").alias("one"),
        F.concat(beginning, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)).alias("two"),
    )
    key = ["bucket", "rid"]
    found = fingerprints(rows, key, k, sketches, slots, every)
    empty = F.array().cast("array<bigint>")
    joined = rows.select(*key, "guest", "doc_id", "n_chars", F.sha2(F.col("two").cast("binary"), 256).alias("edited_sha256")).join(
        found, key, "left"
    ).select(*key, "guest", "doc_id", "n_chars", "edited_sha256", F.coalesce("one", empty).alias("one"), F.coalesce("two", empty).alias("two"))
    order = Window.partitionBy("bucket").orderBy("rid")
    after = F.when(F.col("doc_id").isNull(), F.col("one")).otherwise(F.lead("one").over(order))
    return joined.withColumn("after", after).where(~F.col("guest")).select(
        F.col("doc_id").alias(doc_id), "n_chars", "edited_sha256", as_text(F.col("one")).alias("fingerprint"),
        as_text(F.col("two")).alias("edited_fingerprint"), likeness(F.col("one"), F.col("two"), sketches).alias("near_edited"),
        likeness(F.col("one"), F.col("after"), sketches).alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(table(spark, sf_dir, "documents"), every=True)
