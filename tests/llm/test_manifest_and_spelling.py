import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brisk.llm import merkle, spelling

from brute import prose
from brute import spelling as slow


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root of a list of leaves and the digests beside each leaf, level by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for p, i in zip(proofs, at, strict=True):
            run = i - i % 3
            p.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        at = [i // 3 for i in at]
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def plain(rows):
    leaf = lambda r: digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is None, r[0] or 0, leaf(r), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, above = tree([roots[s][0] for s in names])
    return sorted(((x[3], x[2], p + above[k], roots[s][0], root) for k, s in enumerate(names) for x, p in zip(sorted(groups[s]), roots[s][1], strict=True)), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 7])
@pytest.mark.parametrize("sizes", [[1], [1, 1], [28, 3, 1, 4, 9, 10, 2], [40] + [1] * 11])
def test_manifest_equals_a_plain_tree(spark, sizes, depth):
    rng = random.Random(len(sizes))
    rows = [(None if rng.random() < 0.1 else rng.randrange(60), None if k == 1 else f"{'äz-'[k % 3]}{k}", None, k if k % 2 else None, rng.choice([None, "", "a\nb", prose(rng, 5)])) for k, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["leaf"], [tuple(p) for p in r["proof"]], r["subroot"], r["root"]) for r in merkle.manifest(docs, depth=depth).collect()), key=repr)
    assert got == plain(rows)


def test_manifest_finds_what_was_changed(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"line {i}\nmore") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    other = merkle.leaf_of([F.when((F.col("doc_id") == 7) & (F.lit(f) == "text"), F.lit("other")).otherwise(F.col(f).cast("string")) for f in merkle.FIELDS])
    got = merkle.manifest(docs, carry={"now": other}).select("doc_id", (merkle.folded(F.col("now"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert {r["doc_id"] for r in got if not r["ok"]} == {7} and len(got) == 50


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).count() == 0


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    out = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems[: 1 + int(60 * rng.random() ** 3)])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "é" + w[k:], w[:k] + "b" + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "1", "-\n"]).join(words)))
    long = "ab" * 300
    return out + [(None, None), (None, stems[0]), (None, stems[0]), (300, ""), (301, f"{long} {long}c {long} {long}c x{long[1:]}"), (301, f"x{long[1:]} ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ×")]


@pytest.mark.parametrize("garble", [None, 5])
def test_vocabulary(spark, letters, garble):
    docs = spark.createDataFrame(letters, "doc_id long, text string").repartition(3)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, garble=garble).collect()}
    assert got == {w: n for w, (n, _) in slow(letters, garble=garble).items()}


@pytest.mark.parametrize("most", [4096, 20, 3])
def test_variants_equal_all_pairs_compared(spark, letters, most):
    want = slow(letters)
    vocab = spark.createDataFrame([(w, n) for w, (n, _) in want.items()], "word string, n long").repartition(3)
    pairs = spelling.near_pairs(vocab, most=most).collect()
    assert len(pairs) == len({frozenset(p) for p in pairs}) and {frozenset(p) for p in pairs} == {frozenset((w, v)) for w, (_, near) in want.items() for v in near}
    got = {r["word"]: r for r in spelling.variants(vocab, times=3, most=most).collect()}
    assert set(got) == set(want)
    form = {}
    for w, (n, near) in want.items():
        best = min(near, key=lambda v: (-want[v][0], v), default=None)
        form[w] = best if best is not None and want[best][0] >= 3 * n else None
    for w, (n, near) in want.items():
        r, root = got[w], w
        while form[root]:
            root = form[root]
        assert (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) == (n, len(near), form[w], form[w] and want[form[w]][0], root)


def test_short_words_and_no_words(spark):
    words = ["a", "b", "ab", "ba", "abc", "aab", "", "é", "éé"]
    got = {frozenset(r) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words if w], "word string, n long"), letters=1).collect()}
    assert got == {frozenset(p) for p in [("a", "b"), ("a", "é"), ("b", "é"), ("a", "ab"), ("a", "ba"), ("b", "ab"), ("b", "ba"), ("ab", "abc"), ("ab", "aab"), ("é", "éé")]}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_checksums_of_long_runs(spark):
    rows = [(7, "q" * 1000 + " " + "r" * 255 + " " + "s" * 257)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"] for r in spelling.vocabulary(docs, occurrences=1, garble=2).collect()}
    want = set()
    for w in rows[0][1].split():
        h = zlib.crc32(f"7:{w}".encode())
        want.add(w if h % 2 else w[: h % len(w)] + w[h % len(w) + 1 :])
    assert got == want
