"""How filters of a corpus act on each other: every order of them, step by step, by a recursive query over mask cells.

Documents are reduced to cells first: for each part of the corpus and each set of filters that a document fails (a bit
mask) the number of documents. All that follows works on the cells, of which there are 2**filters a part, whatever the
corpus. The recursion starts with the masks that occur and nothing applied. Each level extends every prefix of filters
by one that it does not hold yet, carries the bits applied so far, and says of each mask whether it falls here, fell
before, or stays. A prefix stands for the first steps of all orders that begin with it, so that its metrics are made
once and handed to these orders by a join.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.common import cut, table

MOST_FILTERS = 6  # 720 orders; Spark ends a recursion of over a million rows, this one has 126 thousand at most
WORD = r"[^\x20\x09-\x0D]+"
DUPLICATE = "E"


def text_filters() -> dict[str, Column]:
    """Failure conditions over the columns ``body`` (text, not null) and ``words`` (its words)."""
    body, words = F.col("body"), F.col("words")
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(body),
        "D": body.rlike("[#$%&*|]"),
    }


def mask_cells(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "lang", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(part, mask, documents, good, toxic): how many documents of a part fail just the filters of a mask.

    The last bit is that of ``DUPLICATE``: the text equals that of a document with a smaller id. Null texts are empty
    ones, null parts the empty string. Rows repeated under one id count each, but do not repeat each other; rows
    without id have no smaller ones and are nobody's original. Of several labels of an id any that says 1 counts.

    Copies of a text are added up by part before they meet, so a text in a third of all rows is no heavy group;
    texts are compared by SHA-256.
    """
    filters = filters or text_filters()
    body = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values())]
    slim = (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
        .withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
        .select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
        .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    )
    told = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    no = F.lit(False)
    groups = (
        slim.join(told, "doc_id", "left")
        .groupBy("digest", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
        .agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
            F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
        )
    )
    # One row for each text, part and labels: at most four times the parts for a text, however often it stands.
    originals = groups.groupBy("digest").agg(F.min("least").alias("original"))
    at_original = F.when(F.col("least") == F.col("original"), F.col("at_least")).otherwise(0)
    judged = groups.join(originals, "digest").withColumn("originals", at_original + F.col("without_id"))
    duplicate = 1 << len(filters)
    sides = F.explode(F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + duplicate).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    ))
    return (
        judged.select("part", "good", "toxic", sides.alias("side")).select("part", "good", "toxic", "side.*").where("n > 0")
        .groupBy("part", "mask").agg(
            F.sum("n").alias("documents"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


STEPS = """
WITH RECURSIVE
moves AS (SELECT CAST(id AS INT) AS applied, pos AS place FROM range(1 << {n}) LATERAL VIEW explode(sequence(0, {n} - 1)) AS pos WHERE (id & (1 << pos)) = 0),
steps (prefix, applied, bit, mask, state) AS (
  SELECT '', 0, 0, mask, '' FROM {masks}
  UNION ALL
  SELECT concat(s.prefix, substring('{letters}', m.place + 1, 1)), s.applied | (1 << m.place), 1 << m.place, s.mask,
         CASE WHEN (s.mask & s.applied) <> 0 THEN CASE WHEN (s.mask & (1 << m.place)) <> 0 THEN 'redundant' ELSE 'gone' END
              WHEN (s.mask & (1 << m.place)) <> 0 THEN 'removed' ELSE 'kept' END
  FROM steps s JOIN moves m ON s.applied = m.applied
)
SELECT prefix, bit, mask, state FROM steps WHERE prefix <> ''
"""


def enumerate_steps(masks: DataFrame, letters: str) -> DataFrame:
    """(prefix, bit, mask, state) for every prefix of every order: what its last filter does to each mask."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"one to {MOST_FILTERS} filters with letters of their own")
    return masks.sparkSession.sql(STEPS.replace("{letters}", letters).replace("{n}", str(len(letters))), masks=masks)


def interaction_audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; no cells, no rows.

    kept: left after the step; removed: taken out here; redundant: failing the step's filter, but out already;
    unique_fails: failing no other filter; good_lost, toxic_lost: of the removed; shapley: what the step's filter
    removes, summed over all orders.
    """
    steps = cut(enumerate_steps(cut(cells.select("mask").distinct()), letters))  # read at each level
    n, k = F.col("documents"), F.length("prefix")
    of = lambda state, x=n: F.sum(F.when(F.col("state") == state, x).otherwise(0))
    orders_of_prefix = F.element_at(F.array(*[F.lit(factorial(len(letters) - i - 1)) for i in range(len(letters))]), k)
    by_prefix = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix").agg(
        of("kept").alias("kept"), of("removed").alias("removed"), of("redundant").alias("redundant"),
        F.sum(F.when(F.col("mask") == F.col("bit"), n).otherwise(0)).alias("unique_fails"),
        of("removed", F.col("good")).alias("good_lost"), of("removed", F.col("toxic")).alias("toxic_lost"),
    ).withColumn("letter", F.right("prefix", F.lit(1)))
    shapley = by_prefix.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of_prefix).alias("shapley"))
    orders = (
        steps.where(k == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
        .select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
        .withColumn("prefix", F.left("filter_order", F.col("step")))
    )
    return by_prefix.join(shapley, ["part", "letter"]).join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return interaction_audit(cells, "".join(text_filters()) + DUPLICATE)


SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic,
    (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
    (100 * len(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body))::INT AS c,
    regexp_matches(body, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), FALSE)::INT AS e
  FROM d LEFT JOIN l USING (doc_id)
),
x AS (SELECT part, good, toxic, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS n_fails FROM f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
r(prefix, letter, before) AS (
  SELECT letter, letter, '' FROM letters
  UNION ALL
  SELECT prefix || l.letter, l.letter, prefix FROM r JOIN letters l ON NOT contains(prefix, l.letter)
),
cells AS (SELECT part, fails, n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
m AS (
  SELECT part, prefix, letter, n, good, toxic, n_fails, fails[letter] = 1 AS here,
    len(list_filter(string_split(before, ''), lambda y: coalesce(fails[y], 0) = 1)) > 0 AS gone
  FROM cells CROSS JOIN r
),
s AS (
  SELECT part, prefix, letter, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM m GROUP BY ALL
),
o AS (SELECT prefix AS filter_order, unnest(range(1, 6)) AS step FROM r WHERE length(prefix) = 5)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM o JOIN s ON s.prefix = left(filter_order, step)
"""
