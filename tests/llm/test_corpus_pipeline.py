"""The pipeline against its stages done by hand."""

import duckdb
import pytest

from brisk.llm import linededup, quality

from brute import groups, item_distance
from compare import database

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def words(text):
    import re

    return re.sub(r"[!-/:-@\[-`{-~]+", " ", text.lower()).split()


def test_pipeline_by_hand(spark):
    db = database(SF)
    verdict = dict(db.sql(f"SELECT doc_id, kept FROM ({quality.ORACLE})").fetchall())
    docs = [(d, t) for d, t in db.sql("SELECT doc_id, text FROM documents").fetchall() if verdict[d]]
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    docs = c.sql(f"SELECT doc_id, text FROM ({linededup.ORACLE})").fetchall()
    docs = [x for x, (n, first) in zip(docs, groups(docs), strict=True) if n == 0 or first == x[0]]
    items = [words(t) for (t,) in db.sql("SELECT text FROM benchmark").fetchall()]
    clean = []
    for d, t in docs:
        w = words(t)
        near = [i for i in items if len(set(i) - set(w)) <= len(i) * 20 // 100]
        if not any(item_distance(i, w) <= len(i) * 20 // 100 for i in near):
            clean.append((d, t))
    got = {r["doc_id"]: r["decoded_sha256"] for r in pipeline.run(spark, SF).collect()}
    import hashlib

    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in clean}


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_on_odd_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    first = docs.first()
    odd = [(None, first["text"], "en", "s", None), (900, None, None, None, None), (901, "", "en", None, 0), (902, " \n ", "en", "s", 3), (903, first["text"], "en", "s", 9), (903, first["text"], "en", "s", 9)]
    own = {n: F.lit("own") for n in ("kept", "m", "fail_bits", "_w", "n_lines", "n_removed_lines", "hits", "_plain", "th", "row", "node", "group", "_t", "component_id")}
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns(own)
    n = docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < out.count() <= n
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.where(" or ".join(f"`{c}` is distinct from 'own'" for c in own)).count() == 0
            docs, n = out, out.count()
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and not {900, 901, 902} & set(ids)


def test_stages_on_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 0
