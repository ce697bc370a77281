"""The training-data operators against brute force, reference libraries and DuckDB."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brisk.llm import bpe, decontam, html, jaccard, langid, linededup, quality, sharding, substring, tokenbin
from brisk.llm import queries as llm

import duckdb
from brute import WORDS, groups, item_distance, prose, windows_removed

SCHEMA = "doc_id long, text string"


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df, *names):
    return df.withColumns({n: F.lit("own") for n in ("extra", *names)})


def test_similarity_groups(spark, corpus):
    docs = [*corpus, corpus[3], (None, corpus[9][1]), (None, "alone in the world of words")]
    got = jaccard.grouped(frame(spark, docs)).collect()
    key = lambda d, n, c: (d if d is not None else -1, n, c if c is not None else -1)
    want = sorted(key(d, *x) for (d, _), x in zip(docs, groups(docs), strict=True))
    assert sorted(key(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = jaccard.keep_one(clashing(frame(spark, docs), "th", "key", "node")).collect()
    sets = {c for (d, _), (n, c) in zip(docs, groups(docs), strict=True) if n}
    blank = {d for (d, _), (n, _) in zip(docs, groups(docs), strict=True) if not n}
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept) == sorted([c if c is not None else -1 for c in sets] + list(blank))


def test_one_of_each_group_is_kept_whatever_its_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    near = " ".join(["other", *a.split()[1:]])
    docs = [(None, a), (None, near), (None, b), (None, c), (7, d), (7, e), (8, d), (9, None), (None, "")]
    kept = jaccard.keep_one(frame(spark, docs)).collect()
    assert len(kept) == 7 and {(r["doc_id"], r["text"]) for r in kept} - {(None, a), (None, near)} == {(None, b), (None, c), (7, d), (7, e), (9, None), (None, "")}
    assert set(jaccard.similarity_groups(frame(spark, docs)).columns) == {"doc_id", "text", "n_shingles", "component_id"}


def test_similarity_of_one_hot_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(1, 7)):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.grouped(frame(spark, rows, parts=5)).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, groups(rows), strict=True)}


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four"])
def test_similarity_of_a_short_text_alone_in_its_batch(spark, text):
    got = jaccard.grouped(frame(spark, [(1, text)], parts=1)).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(1, 1, 1)]


def test_substring_dedup(spark, corpus):
    got = {r["doc_id"]: r for r in substring.substring_dedup(clashing(frame(spark, corpus), "names", "ord", "th", "n_words")).collect()}
    want = windows_removed(corpus)
    assert {d: (r["n_words"], r["kept_text"]) for d, r in got.items()} == {d: (n, " ".join(k)) for d, (n, k) in want.items()}
    assert all(r["n_removed"] == n - len(k) for d, (n, k) in want.items() for r in [got[d]]) and got[7]["extra"] == "own"


def test_substring_dedup_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = substring.substring_dedup(frame(spark, [(None, text), (None, text), (5, text), (5, text)])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in got) == [(False, 0), (False, 0), (True, 40), (True, 40)]


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_equals_sql(spark, name):
    from compare import database, rows

    sf = "/root/testdata/sf0.001"
    got, want = llm.QUERIES[name](spark, sf).toPandas(), database(sf).sql(llm.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_line_dedup_edges(spark, corpus):
    block = "\n".join(f"line {i} of the notice" for i in range(12))
    docs = [*corpus, *[(200 + i, f"head {i}\n{block}\ntail {i}") for i in range(6)], (None, block), (200, None)]
    got = linededup.line_dedup(clashing(frame(spark, docs), "h", "lo")).toPandas()
    c = duckdb.connect()
    c.register("documents", frame(spark, docs).toPandas())
    want = c.sql(linededup.ORACLE).df()
    key = lambda df: sorted(map(repr, df[["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text"]].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want) and got["n_removed_lines"].sum() > 20


def test_quality_ledger(spark, corpus):
    book = quality.apply_policy(quality.ledger(clashing(frame(spark, corpus), "m", "_w", "kept")), "v1").cache()
    rows = {r["doc_id"]: r for r in book.collect()}
    assert rows[0]["m"]["n_words"] == 0 and not rows[0]["kept"] and rows[0]["fail_bits"] & quality.BIT["too_short"]
    assert rows[70]["m"]["n_repeat_words"] == 70 and not rows[70]["kept"] and rows[80]["kept"]
    for d, t in corpus:
        assert rows[d]["m"]["word_chars"] == sum(map(len, WORDS.findall(t or "")))
    got = {r["rule"]: (r["n_failing"], r["n_only"]) for r in quality.ablation(book, "v1").collect()}
    bits = [r["fail_bits"] & quality.mask_of("v1") for r in rows.values()]
    assert got == {x: (sum(bool(b & quality.BIT[x]) for b in bits), sum(b == quality.BIT[x] for b in bits)) for x in quality.POLICIES["v1"]}


TEXTS = [None, "", " ", "it's  we'll\n\n x\t'S 12 ½", "naïve façade – “quoted” 中文字符 한국어 😀👍🏽", "a" * 3000, "<|endoftext|> x", "   \x1c ᠎", "don't I'm they've 'tis '", "é ١٢٣ ⅷ", "x" + " " * 700 + "y"]


def test_bpe_equals_the_library(spark, corpus):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(TEXTS), *((100 + d, t) for d, t in corpus)]
    got = {r["doc_id"]: r for r in bpe.encode_texts(clashing(frame(spark, rows), "n_tokens", "ids"), path, public_tokenizers.PATTERN, with_ids=True).collect()}
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        assert np.frombuffer(got[d]["ids"], "<u4").tolist() == ids
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded"] == t and got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_files_round_trip(spark, tmp_path, corpus):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    rows = sorted([*((1000 + i, t) for i, t in enumerate([*TEXTS, "a<|endoftext|><|endoftext|> b", "<|endoftext"])), *corpus])
    tokenbin.write_tokens(clashing(frame(spark, rows), "ids", "part", "counts"), spec, f"file://{tmp_path}/t", block=700)
    got = {r["doc_id"]: r for r in tokenbin.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).collect()}
    start = 0
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    tokenbin.write_tokens(frame(spark, []), spec, f"file://{tmp_path}/none")
    assert tokenbin.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_coder_from_any_checkpoint():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.05, 200_000), 999).astype(np.uint32)
    coder = tokenbin.Coder(tokenbin.quantise(np.bincount(ids, minlength=1000)))
    lanes, payload, points = coder.encode(ids, int(ids[0]))
    assert (coder.decode(len(ids), lanes, payload, points) == ids).all() and len(payload) < len(ids)
    assert (coder.decode(len(ids), lanes, payload, points, 0, 1) == ids[: tokenbin.STRIDE * lanes][: len(ids)]).all()


def test_sharding_law(spark, tmp_path, corpus):
    rows = [*corpus, corpus[0], (None, "x"), (None, None)]
    taken = {}
    for n in (4, 5):
        sharding.write_shards(clashing(frame(spark, rows), "slot", "shard"), f"file://{tmp_path}/{n}", n, bucket_bytes=3000)
        taken[n] = spark.read.schema("doc_id long, text string, extra string, grown_shard int, slot long, shard int").parquet(f"file://{tmp_path}/{n}").collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in taken[4]))) == sorted(map(repr, rows))
    for n in (4, 5):
        for s in range(n):
            slots = sorted(r["slot"] for r in taken[n] if r["shard"] == s)
            assert slots == list(range(len(slots)))
    five = {(r["doc_id"], r["text"]): r["shard"] for r in taken[5]}
    assert all(r["grown_shard"] == five[r["doc_id"], r["text"]] and r["grown_shard"] in (r["shard"], 4) for r in taken[4])


def test_shards_do_not_depend_on_partitions(spark, tmp_path, corpus):
    rows = [(d, t, i % 3) for i, (d, t) in enumerate([*corpus, *corpus, (None, "x"), (None, None)])]
    written = []
    for k, parts in enumerate((1, 5)):
        sharding.write_shards(frame(spark, rows, "doc_id long, text string, other int", parts), f"file://{tmp_path}/{k}", 2, seed=3, bucket_bytes=30_000)
        got = spark.read.schema("doc_id long, text string, other int, grown_shard int, slot long, shard int").parquet(f"file://{tmp_path}/{k}").collect()
        written.append(sorted(map(tuple, got), key=repr))
    assert written[0] == written[1]


def test_buckets_are_shuffled_by_fisher_yates(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    sharding.write_shards(frame(spark, rows), f"file://{tmp_path}/s", 2, seed=9)
    got = spark.read.parquet(f"file://{tmp_path}/s").collect()
    for shard in (0, 1):
        order = sorted(r["doc_id"] for r in got if r["shard"] == shard)
        rng = np.random.default_rng([9, shard, 0])
        for i in range(len(order) - 1, 0, -1):
            j = int(rng.integers(i + 1))
            order[i], order[j] = order[j], order[i]
        assert order == [r["doc_id"] for r in sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])]


def test_language_scores_by_hand(spark):
    """The scores from plain counts: words first, then n-grams of 4 to 1 letters."""
    from collections import Counter

    rows = [(0, "der hund und der ball", "de"), (2, "der mann", "de"), (3, "the dog and the ball", "en"), (4, "the man the cat", "en"), (6, "the end", "en"), (8, "der mann", "de"), (9, "x", None)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = langid.fit(frame(spark, rows, "doc_id long, text string, lang string"))
    langs = sorted({r[2] for r in rows} - {None})
    texts = {(r[1], r[2]) for r in rows if r[2]}
    words = {x: Counter(w for t, own in texts if own == x for w in t.split()) for x in langs}

    def table(n):
        cut = (lambda w: [w]) if n == 0 else (lambda w: [f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)]) if n > 1 else list
        count = {x: Counter(g for w, c in words[x].items() for g in cut(w) for _ in range(c)) for x in langs}
        total = sum(count.values(), Counter())
        known = [g for g, c in total.items() if c >= 2]
        return {g: np.log([(count[x][g] + 0.5) / (sum(count[x][k] for k in known) + 0.5 * len(known)) for x in langs]) for g in known}

    tables = {n: table(n) for n in range(5)}
    numbers = Counter(r[2] for r in rows if r[2])

    def scores(text):
        out = np.log([numbers[x] / sum(numbers.values()) for x in langs])
        for w in text.lower().split():
            if w in tables[0]:
                out = out + tables[0][w]
                continue
            for n in (4, 3, 2, 1):
                padded = w if n == 1 else f"_{w}_"
                got = [tables[n][g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in tables[n]]
                if got:
                    out = out + np.mean(got, axis=0)
                    break
        return out

    asked = ["der hund", "the cats", "dermann ballt", "zzz", "The END of the man", "theder"]
    got = {r["text"]: r for r in langid.identify(frame(spark, list(enumerate(asked))), model).collect()}
    for t in asked:
        want = scores(t)
        assert got[t]["lang_pred"] == langs[int(np.argmax(want))]
        assert got[t]["score"] == pytest.approx(1 / np.exp(want - want.max()).sum(), rel=1e-4)


def test_many_languages_and_ties(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    rows = [(3 * i, f"x{name(i)} x{name(i)} gleich", f"l{i:04d}") for i in range(1600)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = langid.fit(frame(spark, rows, "doc_id long, text string, lang string"))
    assert len(model["langs"]) == len(rows) > 1000
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, [(r[0], r[1]) for r in rows] + [(-1, "gleich")]), model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.99 * len(rows) and got[-1] == model["langs"][0]


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 400")
    model = langid.fit(docs)
    seen = {r["lang"] for r in docs.where(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(model["langs"]) == seen - {None}
    got = langid.identify(clashing(docs, "score"), model)
    right = got.where(langid.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = frame(spark, [(1, None), (2, ""), (3, "12 34 --"), (4, "Ωμέγα"), (5, docs.first()["text"] * 50)])
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] in seen and 0 <= rows[5]["score"] <= 1
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies and many words to say so to all of you who read this</div><article><h1>The &amp; title</h1><p>First   paragraph
with a <a href="x">link</a> &lt;b&gt; and more<p>Short.<form><label>Your name</label></form><div class="comments"><p>I do not agree with any of this at all, and here is why in many words.</p></div><p>Last</p></article>
<aside>Other news of the day that nobody needs</aside><footer>&copy; 2020</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "no markup at all, but a good many words that make a text of their own here"), (5, "u", "<p>" + "word " * 50_000), (6, "u", "<p a='x"), (1, "u", PAGE)]
    got = html.extract(clashing(frame(spark, rows, "page_id long, url string, html string"), "text")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "The & title First paragraph with a link <b> and more Short. Last"
    assert by[2] == by[3] == by[6] == "" and by[4].startswith("no markup") and len(by[5]) == 249_999
    assert sum(r["text"] == by[1] for r in got) == 2 and all(r["n_chars"] == len(r["text"]) for r in got)


ARTICLE = "<article><h1>The title</h1><p>A first paragraph with a good many words of its own.</p><p>Last</p></article>"
ARTICLE_TEXT = "The title A first paragraph with a good many words of its own. Last"


SENTENCES = "This is the first sentence of a text that has more to say. It goes on for a while, as texts do when they have room."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout has-sidebar"><article><p>{SENTENCES}</article><div class="sidebar"><p>{SENTENCES}</div></div>', SENTENCES),
        (f'<div class="content with-sidebar"><p>{SENTENCES}</div><div class="footer">Imprint and more</div>', SENTENCES),
        (f'<div id="post-share"><p>{SENTENCES}<p>{SENTENCES}</div>', f"{SENTENCES} {SENTENCES}"),
        (f'<article><div class="alert"><p>{SENTENCES}</div></article>', SENTENCES),
        (f'<article><div class="alert">Mind the step</div><p>{SENTENCES}</p><div class="share"><a href=x>Share</a></div></article>', SENTENCES),
        (f'<article><p>{SENTENCES}<ul><li><a href=a>First source of the facts</a><li><a href=b>Second</a></ul></article>', f"{SENTENCES} First source of the facts Second"),
        (f'<form id="aspnetForm"><nav><a href=a>Home</a></nav><div><p>{SENTENCES}</div></form>', SENTENCES),
        (f'<body class="no-comments menu-open"><article><p>{SENTENCES}</article><section class="comments"><article class="comment"><p>{SENTENCES} {SENTENCES}</article></section>', SENTENCES),
        (f'<div><p>{SENTENCES}</div><div id="comments"><p>{SENTENCES}<p>{SENTENCES}<p>{SENTENCES}</div>', SENTENCES),
        (f'<div class="sidebar-layout"><main><h1>Title</h1><p>{SENTENCES}</main><aside>{SENTENCES}</aside></div>', f"Title {SENTENCES}"),
        (f'<main><div class="adSlot">Buy one and get one more today</div><p>{SENTENCES}</main><div class="cookieNotice">We use cookies</div>', SENTENCES),
        ("<nav><a href=a>Home</a></nav><footer>Imprint</footer>", ""),
    ],
)
def test_main_text_of_layouts(page, text):
    assert html.main_text(page, html.grow(np.array(html.LABELLED, float)))[0] == text


def test_main_text_equals_the_article_of_all_pages(spark):
    """The given pages have one article each: its text, read by the parser of the standard library."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.parts += [" "] * (self.depth and tag in ("p", "h1", "li", "br", "div"))

        def handle_endtag(self, tag):
            self.depth -= tag == "article"

        def handle_data(self, data):
            self.parts += [data] * self.depth

    rows = html.op9_html_extraction(spark, "/root/testdata/sf0.1").collect()
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    assert len(rows) == len(raw)
    for r in rows:
        reader = Article()
        reader.feed(raw[r["page_id"]])
        assert r["text"] == " ".join("".join(reader.parts).split())


@pytest.mark.parametrize(
    "ahead",
    [
        "<svg class='x' viewBox='0 0 1 1'/>",
        "<math/>",
        "<div><object data='a.swf'>no plug-in </div>",
        "<div><span><noscript>off</span></div>",
        "<div><svg><title>t</title><text>drawn</text></div>",
        "<svg><svg><text>a</text></svg><text>b</text></svg>",
        "<div><svg><path></div>" + "<div><svg><text>a</text></svg></div>",
        "<script>var x = '<svg>';</script><div><SVG></div>",
        "<!-- <svg> --><template><p>not shown</p></template>",
    ],
)
def test_main_text_after_elements_without_an_end(ahead):
    tree = html.grow(np.array(html.LABELLED, float))
    assert html.main_text(f"<body>{ahead}{ARTICLE}<div><svg/></div></body>", tree)[0] == ARTICLE_TEXT
    assert html.main_text(f"<body>{ARTICLE}<iframe>{ARTICLE}", tree)[0] == ARTICLE_TEXT


def test_decontamination_recall(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(15, 50)) for _ in range(40)] + [None, "", "two words", prose(rng, 5)]
    bench = frame(spark, list(enumerate(items)), "item_id long, text string", 1)
    docs, wanted = [(1000, None), (1001, ""), (1002, "so " * 400)], set()
    for d in range(200):
        i = rng.randrange(40)
        w = items[i].split()
        for _ in range(rng.randint(0, len(w) * 20 // 100)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1, 1))] = rng.choice(([], ["zz"], ["Zz,", "qq"]))[:2]
        text = prose(rng, rng.randint(0, 60)).split() + w + prose(rng, rng.randint(0, 60)).split()
        docs.append((d, " ".join(text).title() + "."))
        plain = [x.strip(",.").lower() for x in text]
        wanted |= {(d, k) for k, item in enumerate(items) if item and len(item.split()) >= 4 and k == i and item_distance(item.split(), plain) <= len(item.split()) * 20 // 100}
    rows = decontam.find_items(clashing(frame(spark, docs), "hits", "_plain"), bench, most_items=15).collect()
    got = {(r["doc_id"], h["item_id"]) for r in rows for h in r["hits"]}
    assert len(rows) == len(docs) and len(wanted & got) >= 0.98 * len(wanted) and len(wanted) > 120
    texts = dict(docs)
    for d, k in got:
        plain = decontam_words(texts[d])
        assert item_distance(items[k].split(), plain) <= len(items[k].split()) * 20 // 100
    assert decontam.decontaminate(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_decontamination_finds_all_short_items(spark):
    rng = random.Random(8)
    items = [prose(rng, 4 + i % 11) for i in range(66)] + ["Donaudampfschifffahrt", "hydroxychloroquine sulfate", "short one", None]
    items += ["地球は太陽の周りを一年かけて回っている", "ประเทศไทยมีเมืองหลวงคือกรุงเทพ"]
    docs, wanted = [], set()
    for d in range(660):
        k = d % 66
        w = items[k].split()
        for _ in range(len(w) * 20 // 100):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1, 1))] = rng.choice(([], ["zz"]))
        text = prose(rng, rng.randint(0, 30)).split() + w + prose(rng, rng.randint(0, 30)).split()
        docs.append((d, " ".join(text)))
    docs += [(700, "die donaudampfschifffahrt, nun"), (701, "Hydroxychloroquine sulfate."), (702, "hydroxychloroquine"), (703, "short one")]
    docs += [(704, "実は地球は太陽の周りを一年をかけて回っているのだ"), (705, "เราทราบว่าประเทศไทยมีเมืองหลวงคือกรุงเทพฯ"), (706, "太陽は大きい")]
    wanted = {(d, k) for d, t in docs[:660] for k in range(66) if item_distance(items[k].split(), t.split()) <= len(items[k].split()) * 20 // 100}
    wanted |= {(700, 66), (701, 67), (703, 68), (704, 70), (705, 71)}
    bench = frame(spark, list(enumerate(items)), "item_id long, text string", 1)
    kept = {r["doc_id"] for r in decontam.decontaminate(clashing(frame(spark, docs), "hits"), bench).collect()}
    assert kept & set(range(700, 707)) == {702, 703, 706}
    rows = decontam.find_items(frame(spark, docs), frame(spark, list(enumerate(items)), "item_id long, text string", 1), most_items=30).collect()
    assert {(r["doc_id"], h["item_id"]) for r in rows for h in r["hits"]} == wanted and len(wanted) > 600


def decontam_words(text):
    import re

    return re.sub(r"[!-/:-@\[-`{-~]+", " ", text.lower()).split()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard.grouped(none).count() == 0 and substring.substring_dedup(none).count() == 0 and linededup.line_dedup(none).count() == 0
    assert quality.quality_rules(none).count() == 0 and decontam.find_items(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert bpe.encode_texts(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0 and html.extract(none.withColumn("html", F.lit(None).cast("string"))).count() == 0
    sharding.write_shards(none, f"file://{tmp_path}/s", 2)
    assert json.dumps(llm.ORACLES)


_NAV, _FOOT = "<nav><a href=/>Home</a> <a href=/>About</a></nav>", "<footer>c 2020</footer>"
_LONG = "A long paragraph with quite enough words to count as text by any measure that one could think of at all."


@pytest.mark.parametrize("tag", ['<article title="The hidden cost of things">', '<article data-title="a hidden gem">', '<article data-id="comment-count-3">', '<article class="reply-to-critics">', '<div class="story comment-count-12">', '<div data-thread-id="reply-1">', "<div data-style='display:none'>"])
def test_words_in_other_attributes_hide_nothing(tag):
    tree, end = html.grow(np.array(html.LABELLED, float)), tag.split()[0][1:]
    assert html.main_text(f"<body>{_NAV}{tag}<p>{_LONG}</p><p>{_LONG}</p></{end}>{_FOOT}</body>", tree)[0] == f"{_LONG} {_LONG}"


@pytest.mark.parametrize("tag", ['<div class="comments">', '<div class="comment-list">', '<article class=comment>', "<section id='reader-comments'>", '<div class="discussion">', '<li class="comment depth-1 even">', '<div STYLE="display : none">', "<div hidden>", '<div aria-hidden="true">'])
def test_comments_and_hidden_parts_go(tag):
    tree, end = html.grow(np.array(html.LABELLED, float)), tag.split()[0][1:]
    assert html.main_text(f"<body>{_NAV}<article><p>{_LONG}</p></article>{tag}<p>{_LONG} And more.</p></{end}>{_FOOT}</body>", tree)[0] == _LONG


def test_short_texts_outside_an_article():
    tree = html.grow(np.array(html.LABELLED, float))
    verse = ["The sun came up", "over the hill", "and nobody saw", "the light on the mill"] * 3
    lines = "".join(f"<p>{x}</p>" for x in verse)
    assert html.main_text(f"<body>{_NAV}<h1>The hill</h1><div>{lines}</div>{_FOOT}</body>", tree)[0] == " ".join(["The hill", *verse])
    assert html.main_text(f"<body>{_NAV}<h1>Closed today</h1><p>We open again on Monday.</p>{_FOOT}</body>", tree)[0] == "Closed today We open again on Monday."
