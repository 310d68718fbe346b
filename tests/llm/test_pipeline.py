"""The pipeline's stages against brute force and their own rules, and the queries' SQL."""

import random
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from spendscope.llm.packing import BYTE_BPE
from spendscope.llm.queries import LLM_QUERIES, LLM_SQL
from tests.llm.conftest import ODD
from tests.llm.test_dedup import expected_components
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_all_queries_are_registered():
    assert set(LLM_QUERIES) | {"pipeline"} <= set(queries()) and set(LLM_SQL) <= set(oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in LLM_QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "suffix_dedup", "packing"]


def test_stages_return_documents(stages):
    for name in ("language", "quality", "near_dedup", "suffix_dedup"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_filters_keep_clean_documents(spark):
    """On a table that has labels enough to learn from."""
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = corpus_pipeline.language(spark, docs, folder)
    assert told.count() >= 0.98 * docs.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    after = set(corpus_pipeline.quality(spark, docs, folder).toPandas()["doc_id"])
    good, bad = (set(labels[labels["quality"] == q]["doc_id"]) for q in (1, 0))
    assert len(good - after) <= 0.02 * len(good) and len(bad & after) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality"].collect()]
    components = expected_components(rows)
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == {i for i, (_, c) in components.items() if i == c}


def test_repeated_passages_leave(stages):
    before = {r["doc_id"]: r["text"].encode() for r in stages["near_dedup"].collect()}
    seen, twice, size = set(), set(), corpus_pipeline.PASSAGE_BYTES
    for raw in before.values():
        for i in range(len(raw) - size + 1):
            h = hash(raw[i : i + size])
            (twice if h in seen else seen).add(h)
    for r in stages["suffix_dedup"].collect():
        raw = before[r["doc_id"]]
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            if hash(raw[i : i + size]) in twice:
                gone[i : i + size] = [True] * size
        # a character goes if all of its bytes do
        text, at = [], 0
        for c in raw.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text.append(c)
            at += n
        assert r["text"] == "".join(text) and r["n_chars"] == len(text)


@pytest.mark.parametrize("words", [51, 60, 80])
def test_passages_of_over_fifty_words_leave(spark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3, 4, 5, 7])))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, clean = text(words), text(300)
    rows = [(i, f"{text(20)} {passage} {text(20)}", "en", "s", 0) for i in range(4)] + [(9, clean, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, SF).collect()}
    assert left.pop(9) == clean
    assert all(passage not in t and len(t) <= len(rows[i][1]) - len(passage) for i, t in left.items())


def test_odd_tables_pass_all_stages(spark, tmp_path):
    """No rows, null texts and labels, repeated ids, further columns with names of the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, hits string, chunk long"
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("none", []), ("odd", [(i, t, None if i == 8 else "en", None, 0, 0.5, "k", "h", 1) for i, t in ODD])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in found.collect()} <= {i for i, _ in ODD}
        assert name == "odd" or found.isEmpty()


def test_everything_is_packed(stages):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    pieces = stages["packing"].collect()
    for r in stages["suffix_dedup"].collect():
        own = sorted((p for p in pieces if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert [i for p in own for i in p["ids"]] == [*library.encode(r["text"], add_special_tokens=False).ids, 1]


def test_run_applies_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == stages["packing"].columns
    columns = [c for c in found.columns if c != "sequence_id"]
    as_rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert as_rows(found) == as_rows(stages["packing"])


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = LLM_QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(LLM_SQL[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None
