"""Every order of the filters, against documents filtered one by one."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spendscope.llm.filter_audit import enumerate_steps, interaction_audit, mask_cells, op13_filter_audit
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, mask string"


def fails_of(docs):
    out = []
    for i, text in docs:
        body = text or ""
        words = WORD.findall(body)
        duplicate = i is not None and any(j is not None and j < i and (t or "") == body for j, t in docs)
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 3 * len(body),
            "D": bool(re.search(r"[#$%&*|]", body)), "E": duplicate,
        })
    return out


def plain_audit(docs, parts, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows, fails = [], fails_of(docs)
    for part in set(parts):
        mine = [(docs[k][0], fails[k]) for k in range(len(docs)) if parts[k] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out = [x for x in left if x[1][f]]
                before = [x for x in mine if x[1][f] and not any(x is y for y in left)]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(out)
                rows.append([
                    part, "".join(order), step, len(left), len(out), len(before), sum(x[1][f] and sum(x[1].values()) == 1 for x in mine),
                    sum(x[0] in good for x in out), sum(x[0] in toxic for x in out), f,
                ])
        for r in rows:
            if r[0] == part:
                r[9] = shapley[r[9]] if isinstance(r[9], str) else r[9]
    return sorted(map(tuple, rows))


def test_audit_equals_filtering_one_by_one(spark):
    long = " ".join(f"word{i}" for i in range(250))
    docs = [
        *ODD, (1, long), (2, long), (2, long), (3, long + " #"), (4, "SHOUT " * 300), (5, long.replace("word1", "WORDONE WORD")), (6, "same " * 220),
        (None, long), (20, None), (21, ""), (22, "$ " + long), (23, "$ " + long),
    ]
    parts = ["en" if k % 3 else "" for k in range(len(docs))]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (7, 1, 1), (22, None, None), (23, 1, 1), (None, 1, 1)]
    rows = [(i, t, (p or None) if k % 2 else p, 1.0) for k, ((i, t), p) in enumerate(zip(docs, parts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask double")
    told = spark.createDataFrame([(*r, "m") for r in labels], LABELS)
    found = interaction_audit(mask_cells(df, told), "ABCDE")
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(docs, parts, [r for r in labels if r[0] is not None])


def test_other_filters_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", None)], "doc_id long, text string, lang string")
    told = spark.createDataFrame([], LABELS)
    short = {"S": F.size("words") < 2}
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in interaction_audit(mask_cells(df, told, short), "SE").collect()}
    assert found == {
        ("x", "SE", 1): (2, 0), ("x", "SE", 2): (1, 1), ("x", "ES", 1): (1, 1), ("x", "ES", 2): (1, 0),
        ("", "SE", 1): (0, 1), ("", "SE", 2): (0, 0), ("", "ES", 1): (1, 0), ("", "ES", 2): (0, 1),
    }
    assert interaction_audit(mask_cells(df.limit(0), told), "ABCDE").count() == 0
    with pytest.raises(ValueError, match="filters"):
        enumerate_steps(df.select(F.lit(0).alias("mask")), "ABCDEFG")


def test_query_has_all_orders_of_all_parts(spark):
    folder = "/root/testdata/sf0.001"
    found = op13_filter_audit(spark, folder)
    parts = spark.read.parquet(f"{folder}/documents.parquet").select("lang").distinct().count()
    assert found.count() == 600 * parts
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found.where("step = 1").groupBy("filter_order").agg(F.sum(F.col("kept") + F.col("removed")).alias("n")).where(f"n <> {documents}").isEmpty()
