"""The tables between the rounds of the similarity join."""

from brisk.llm import jaccard
from brisk.llm.common import Scratch

from brute import groups


def test_tables_of_rounds_have_few_files_however_many_shuffle_partitions(spark, corpus, monkeypatch):
    files, keep = {}, Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = jaccard.grouped(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((d, *x) for (d, _), x in zip(corpus, groups(corpus), strict=True))
    assert "labels" in files and max(n for name, n in files.items() if name != "members") <= jaccard.LEAST_TASKS
