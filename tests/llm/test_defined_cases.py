"""What every operator and stage owes any input: odd values, clashing names, long texts, no rows."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brisk.llm import bpe, decontam, html, jaccard, langid, linededup, merkle, ppm, quality, sharding, spelling, substring, tokenbin

from brute import prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators give to results or use on the way.
NAMES = (
    "row _d _h _t _u _i _th _id _ord _o _drop _lines _plain _bucket _order _n th key node group n cls lab pos token x y s hits at names ord print name c p h lo hi bytes l w m r kept fail_bits n_lines "
    "n_removed_lines n_removed_chunks n_words n_removed kept_text n_shingles component_id lang_pred score ids decoded n_tokens ids_sha256 decoded_sha256 shard grown_shard slot n_chars n_kept_blocks n_blocks base_failed"
).split()


def shards(docs, spark, path):
    sharding.write_shards(docs, path, 3, bucket_bytes=400_000)
    return spark.read.parquet(path)


def tokens(docs, spark, path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenbin.write_tokens(docs, f.read(), path)
    return tokenbin.read_tokens(spark, path)


def bench(spark):
    return spark.createDataFrame([(1, "the one item that no document of these tests holds in any form"), (2, None)], "item_id long, text string")


OPERATORS = {
    "language": (lambda d, s, p: langid.identify(d, langid.fit(d.select("doc_id", "text", F.lit("xx").alias("lang")))), {"lang_pred", "score"}),
    "bpe": (lambda d, s, p: bpe.encode_texts(d, RANKS, public_tokenizers.PATTERN, with_ids=True), {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}),
    "decontamination": (lambda d, s, p: decontam.find_items(d, bench(s)), {"hits"}),
    "passes": (lambda d, s, p: decontam.find_items(d.distinct(), bench(s).unionByName(bench(s).withColumn("text", F.lit("some other item that nobody has ever seen"))), most_items=1), {"hits"}),
    "clean": (lambda d, s, p: decontam.decontaminate(d, bench(s)), set()),
    "lines": (lambda d, s, p: linededup.line_dedup(d), {"n_lines", "n_removed_lines", "n_removed_chunks"}),
    "quality": (lambda d, s, p: quality.quality_rules(d), None),
    "shards": (shards, {"shard", "grown_shard", "slot"}),
    "tokens": (tokens, None),
    "similarity": (lambda d, s, p: jaccard.similarity_groups(d), {"n_shingles", "component_id"}),
    "one_of_each": (lambda d, s, p: jaccard.keep_one(d), set()),
    "html": (lambda d, s, p: html.extract(d.withColumn("html", F.col("text"))).drop("html"), {"text", "n_chars", "n_kept_blocks", "n_blocks"}),
    "manifest": (lambda d, s, p: merkle.manifest(d.withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text")})), None),
    "scores": (lambda d, s, p: ppm.score_texts(d, F.col("doc_id") > 2), None),
    "substring": (lambda d, s, p: substring.substring_dedup(d), {"n_words", "n_removed", "kept_text"}),
}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    text, near = prose(rng, 60), prose(rng, 40)
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, None), (None, text), (None, text), (4, text), (4, text), (5, text), (6, near), (7, f"{near} x"), (8, "one"), (9, "\x00é 😀 <|endoftext|> <p>"), (10, "so " * 300), (11, "line a b\nline c d\n" * 20)]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, tmp_path, odd, name):
    run, results = OPERATORS[name]
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(3).withColumns({n: F.lit("own") for n in [*NAMES, "extra", "a b"]})
    out = run(docs, spark, f"file://{tmp_path}/work")
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    if name in ("one_of_each", "clean", "passes"):
        assert 0 < got.count() <= len(odd)
    else:
        assert got.count() == len(odd)
    if results is not None:
        kept = set(docs.columns) - results - {"doc_id", "text"}
        assert kept <= set(got.columns)
        assert got.where(" or ".join(f"`{c}` is distinct from 'own'" for c in sorted(kept))).count() == 0
    else:
        assert len(set(got.columns)) == len(got.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, tmp_path, name):
    docs = spark.createDataFrame([], "doc_id long, text string, extra string")
    out = OPERATORS[name][0](docs, spark, f"file://{tmp_path}/work") if name != "shards" else None
    if out is None:
        sharding.write_shards(docs, f"file://{tmp_path}/work", 3)
        assert spark.read.schema("doc_id long").parquet(f"file://{tmp_path}/work").count() == 0
    else:
        out.write.parquet(f"{tmp_path}/out")
        assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("clean", "one_of_each", "passes")])
def test_a_text_of_20_mb(spark, tmp_path, name):
    rng = random.Random(5)
    part = " ".join(prose(rng, 3000).split()) + "\n"
    long = "".join(part.replace("ka", f"k{i}") for i in range(20_000_000 // len(part)))
    head = long[:2000].rsplit(" ", 1)[0]
    docs = spark.createDataFrame([(1, long), (2, head), (3, "short")], "doc_id long, text string").repartition(2)
    got = OPERATORS[name][0](docs, spark, f"file://{tmp_path}/work")
    got.write.parquet(f"{tmp_path}/out")
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").drop("ids", "decoded", "html").collect()}
    assert set(rows) == {1, 2, 3}
    if name == "scores":
        assert rows[1]["n_tokens"] == len(long.split()) + 1 and rows[3]["n_known"] == 2 and rows[2]["score"] < rows[3]["score"] < 0
    if name == "bpe":
        import hashlib

        assert rows[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    if name == "substring":
        assert rows[2]["n_removed"] == len(head.split()) and rows[1]["n_words"] == len(long.split())


def test_words_of_a_text_of_20_mb_and_of_odd_rows(spark, odd):
    from collections import Counter

    rng = random.Random(5)
    part = prose(rng, 3000).replace(" ", "x") + " "
    long = "".join(part.replace("ka", f"k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(20_000_000 // len(part)))
    docs = spark.createDataFrame([(1, long), (2, long[:300_000])], "doc_id long, text string").repartition(2)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, occurrences=1).collect()}
    assert got == Counter(long.split() + long[:300_000].split())
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({n: F.lit("own") for n in ("word", "n", "root")})
    assert spelling.variants(spelling.vocabulary(docs)).count() >= 0


def test_pieces_of_a_long_text_change_nothing(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(prose(rng, 400) for _ in range(6)) + " 12ab'll x's\n\n  y " + prose(rng, 300), "so " * 900 + prose(rng, 900)]
    for text in texts:
        batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
        words = substring.Words(batch)
        whole = substring.Windows(words)
        monkeypatch.setattr(substring, "PIECE", 97)
        parts = substring.windows_of(words, substring.WINDOW)
        monkeypatch.undo()
        assert (parts.at == whole.at).all() and (parts.name == whole.name).all() and (parts.print == whole.print).all()
        codec = bpe.Codec(bpe.model_of(bpe.read_ranks(RANKS)), bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
        ids, counts = codec.encode(batch)
        codec.encode.step = 50
        again, n = codec.encode(batch)
        assert np.array_equal(ids, again) and n.tolist() == counts.tolist()


def test_added_tokens_at_the_cuts_of_a_long_text():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from brisk.llm import pretoken

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    tok, encode = Tokenizer.from_str(spec), tokenbin._encoder(spec)
    marks = [t.content for t in tok.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in marks
    rng = random.Random(6)
    text = list(prose(rng, 1_100_000))
    step = encode.step
    for k, shift in enumerate([-13, -7, -1, 0, 3, -20]):  # over, before and after each cut, two in a row, glued to words and blanks
        at = (k + 1) * step // 2 + shift
        text[at : at + 13] = list(rng.choice(marks) * 2 if k % 2 else rng.choice(["", " ", "a"]) + rng.choice(marks) + rng.choice(["", " ", "'s"]))
    text = "".join(text)
    assert len(text) > 2 * step
    ids, counts = encode(pa.RecordBatch.from_arrays([pa.array([text, "x"])], ["text"]))
    want = tok.encode(text, add_special_tokens=False).ids
    assert counts[0] == len(want) and np.array_equal(ids[: counts[0]], want)
    # short pieces, many marks: each cut lies between them
    mixed = "".join(rng.choice(["<|endoftext|>", "<|endoftext|", "|>", "word", " 12", ".", "\n", " it's"]) for _ in range(4000))
    data = np.frombuffer(mixed.encode(), np.uint8)
    cuts = pretoken.safe_cuts(data, 50, tuple(m.encode() for m in marks))
    pieces = [mixed[a:b] for a, b in zip(cuts, cuts[1:])]
    assert len(pieces) > 50 and [i for p in pieces for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(mixed, add_special_tokens=False).ids
