"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its number of
words, the share of them in links, the same for the block before and the one after, whether it
stands inside an article or main element, whether it is a heading, and what its nearest named
container is: none, one whose name may mean something else (share, alert, form), one for what
surrounds a text (nav, footer, sidebar, cookie notice, advert), or one of reader comments. With the
container goes the share of the page's unlinked words that it holds: a container with most of the
text is no sidebar, whatever its class says. A decision tree grown from the small labelled table
below decides which blocks are main text.

Markup is read by one regular expression, forgiving as browsers are: unclosed elements end with
their container, a stray `<` is text, a tag cut off at the page's end is dropped. Contents of
script, style and similar elements, of the head, and of hidden elements are no blocks; a script,
style, textarea, title or iframe without an end tag goes on to the page's end.

Defined cases: null or empty html gives an empty text; pages are independent, so repeated rows get
equal results; very long pages are read whole, in time and memory that follow their length; further
columns pass through, but those named like a result are replaced. One scan, no shuffle, the tree is
a few dozen numbers.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, widened

# Names of HTML elements, and words that containers use for themselves.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object head title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED_TAGS = {"nav": 2, "footer": 2, "aside": 2, "menu": 2, "dialog": 2, "button": 2, "select": 2, "form": 1}
NAMED_WORDS = {
    1: frozenset(
        "banner promo promotion notice notices alert popup modal overlay login signup share sharing social related recommended recommendations disclaimer form "
        "search toolbar teaser trending widget widgets header masthead copyright sponsor sponsored subscribe subscription pagination pager".split()
    ),
    2: frozenset(
        "ad ads advert adverts advertisement advertising advertisements sidebar nav navbar navigation menu breadcrumb breadcrumbs footer topbar cookie cookies "
        "consent gdpr newsletter complementary contentinfo discussion discussions".split()
    ),
    3: frozenset("comment comments reply replies respond disqus".split()),
}
# With these alone a word of reader comments names what holds them; with others (`reply-to-critics`,
# `comment-count`) it may be about anything.
COMMENT_PARTS = frozenset("list lists area section body content text thread threads wrapper wrap container holder box item block author meta form user users reader readers post children child depth level parent nested inner outer even odd by group feed all new reply".split())
# A class that begins or ends so speaks of the page, not of its own contents.
ABOUT_FIRST = frozenset("with without has have no not is show hide hidden toggle enable".split())
ABOUT_LAST = frozenset("layout page template grid theme open closed active enabled disabled visible on off".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s>/]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
# Elements whose contents are markup: tags are matched in pairs, and one without an end tag ends with
# its container. The rest of RAW_TAGS holds plain characters up to the end tag or the page's end.
_NESTED = {t: re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){t}(?=[\s>/])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S) for t in ("svg", "math", "object", "noscript", "template")}
_EMPTY_IF_SLASHED = frozenset(("svg", "math", "object"))
_BODY = re.compile(r"<body(?=[\s>/])|</head(?=[\s>/])[^>]*>", re.I)
_WORDY = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "named", "share", "heading")


def named(tag: str, names: str, in_main: bool) -> int:
    """What an element says of itself by tag, classes, id and role: 0 nothing, 1 perhaps, 2 something
    around the text, 3 reader comments."""
    level = NAMED_TAGS.get(tag, 0)
    if tag == "header" and not in_main:
        level = 2
    if tag in ("html", "body"):
        return 0
    for name in names.split():
        words = [w.lower() for w in _WORDY.findall(name)]
        if words and words[0] not in ABOUT_FIRST and (len(words) == 1 or words[-1] not in ABOUT_LAST):
            said = [k for k, some in NAMED_WORDS.items() if not some.isdisjoint(words)]
            level = max([level, *(k for k in said if k < 3 or NAMED_WORDS[3].union(COMMENT_PARTS).issuperset(words))])
    return level


def attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag by lower-case name; of several with one name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def _unseen(own: dict[str, str]) -> bool:
    return "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(own.get("style", "")))


def _pairs(page: str, tag: str) -> dict[int, int]:
    """Where the elements of one kind end, by the place after their start tag; those without an end
    tag are left out."""
    ends, opened = {}, []
    for m in _NESTED[tag].finditer(page):
        if m[1] == "" and not (tag in _EMPTY_IF_SLASHED and m[2].endswith("/")):
            opened.append(m.end())
        elif m[1] and opened:
            ends[opened.pop()] = m.end()
    return ends


def _container_end(page: str, at: int) -> int:
    """Where an element without an end tag ends: at the next tag of a block, or at an end tag that
    belongs to no start tag from here on."""
    opened: dict[str, int] = {}
    for m in _TOKEN.finditer(page, at):
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS and tag not in RAW_TAGS:
            return m.start()
        if not (m["end"] or m["end2"]):
            opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            opened[tag] -= 1
        else:
            return m.start()
    return len(page)


def blocks_of(page: str) -> list[tuple[str, int, float, int, int, float, int]]:
    """Blocks in page order: text, words, share of words in links, inside (1 in an article or main
    element, 0 on a page without one, -1 elsewhere), named (of the nearest container that says
    something), share (of the unlinked words of the page, or of its articles, that the container
    holds) and heading (0 or 1)."""
    out: list[list] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[list] = []  # open elements that matter: tag, kind, nested elements of the same tag, number of the container
    levels = [0]  # of named containers, by number
    pairs: dict[str, dict[int, int]] = {}
    links = heading = main_seen = 0
    at, end = 0, len(page)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                kinds = {s[1] for s in stack}
                if "hidden" not in kinds:
                    n = text.count(" ") + 1
                    in_links = len(_html.unescape(" ".join(linked)).split())
                    around = [s[3] for s in stack if s[3]]
                    out.append([text, n, min(1.0, in_links / n), int("main" in kinds), around, n - min(n, in_links), heading])
            parts.clear()
            linked.clear()

    def add(a: int, b: int) -> None:
        if b > a:
            parts.append(page[a:b])
            if links:
                linked.append(page[a:b])

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(at, end)
            break
        add(at, m.start())
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m["end"] or m["end2"])
        if tag in RAW_TAGS and not closing:
            flush()
            if tag in _NESTED:
                if tag in _EMPTY_IF_SLASHED and (m["attrs"] or "").endswith("/"):
                    continue
                if tag not in pairs:
                    pairs[tag] = _pairs(page, tag)
                at = pairs[tag].get(at) or _container_end(page, at)
                continue
            stop = _RAW_END[tag].search(page, at)
            if tag == "head" and stop is None:
                stop = _BODY.search(page, at)
                at = stop.start() if stop else at
            else:
                at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        blocky = tag in BLOCK_TAGS
        attrs = m["attrs"] or ""
        if closing:
            if blocky:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if i == len(stack) - 1 and stack[i][2]:
                        stack[i][2] -= 1
                    else:
                        flush()
                        del stack[i:]
                    break
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = 0
            continue
        kind, level = None, 0
        own = attributes(attrs) if attrs else {}
        names = " ".join(own[k] for k in ("class", "id", "role") if k in own)
        level = named(tag, names, any(s[1] == "main" for s in stack))
        in_comments = any(levels[s[3]] == 3 for s in stack)
        if tag == "main" or "main" in own.get("role", "").lower().split() or tag == "article" and level < 2 and not in_comments:
            kind, main_seen = "main", 1
        elif level:
            kind = "named"
        if own and tag not in ("html", "body") and _unseen(own):
            kind = "hidden"
        if blocky:
            flush()
            links = 0 if tag in ("article", "main", "section", "body", "footer", "nav") else links
            heading = int(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
            while stack and stack[-1][0] == "p" or stack and tag == "li" and stack[-1][0] == "li" and not stack[-1][2]:
                stack.pop()
        if tag in VOID_TAGS or attrs.endswith("/"):
            continue
        if kind:
            flush()
            if level and kind != "hidden":
                levels.append(level)
            stack.append([tag, kind, 0, len(levels) - 1 if level and kind != "hidden" else 0])
        elif stack and stack[-1][0] == tag:
            stack[-1][2] += 1
    flush()
    held = [0] * len(levels)
    for block in out:
        if block[3] or not main_seen:
            for k in block[4]:
                held[k] += block[5]
            held[0] += block[5]
    return [(t, n, links, main or -main_seen, levels[(around or [0])[-1]], held[around[-1]] / max(1, held[0]) if around else 0.0, head) for t, n, links, main, around, _, head in out]


def features(blocks: list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block; before the first and after the last block there are 0 words."""
    own = np.array([b[1:] for b in blocks], float).reshape(-1, 6)
    near = np.zeros((len(own) + 2, 2))
    near[1:-1] = own[:, :2]
    return np.column_stack([own[:, :2], near[:-2], near[2:], own[:, 2:]])


# The labelled table: kinds of blocks seen on pages of common layouts, each in the neighbourhoods
# below. A kind is (numbers of words, links, inside, named, shares, main text?), of which each number
# of words with each share makes an example; where the answer is None, the neighbours decide. A
# neighbourhood is (words before, links before, words after, links after, does it speak for main
# text?).
SHORT, LONG = (1, 4, 9, 13), (15, 25, 40, 70, 160)
ANY = SHORT + LONG
KINDS = (
    # what surrounds a text: menus, notices, sidebars, footers, forms; comments, however long
    *((ANY, links, inside, 2, (0.0, 0.1, 0.3, 0.5, 0.65), 0) for links in (0.0, 1.0) for inside in (-1, 0, 1)),
    *((ANY, links, inside, 1, (0.0, 0.1, 0.3, 0.45), 0) for links in (0.0, 1.0) for inside in (-1, 0, 1)),
    *((ANY, 0.0, inside, 3, (0.05, 0.3, 0.6, 0.9, 1.0), 0) for inside in (-1, 0, 1)),
    # containers that hold most of the text
    *((ANY, links, 1, 1, (0.55, 0.7, 0.9, 1.0), 1) for links in (0.0, 0.3, 1.0)), *((ANY, links, 1, 2, (0.85, 0.95, 1.0), 1) for links in (0.0, 0.3, 1.0)),
    *((LONG, links, 0, 1, (0.55, 0.7, 0.9, 1.0), 1) for links in (0.0, 0.3)), *((LONG, links, 0, 2, (0.85, 0.95, 1.0), 1) for links in (0.0, 0.3)),
    (SHORT, 0.0, 0, 1, (0.55, 0.7, 0.9, 1.0), None), (SHORT, 0.0, 0, 2, (0.85, 0.95, 1.0), None),
    (ANY, 1.0, 0, 1, (0.55, 0.7, 0.9, 1.0), 0), (ANY, 1.0, 0, 2, (0.85, 0.95, 1.0), 0),
    # in an article, links as well; beside one
    *((ANY, links, 1, 0, (0.0,), 1) for links in (0.0, 0.1, 0.4, 0.9, 1.0)), *((ANY, links, -1, named, (share,), 0) for links in (0.0, 1.0) for named, share in ((0, 0.0), (1, 0.9), (2, 1.0))),
    # on a page without one
    *((LONG, links, 0, 0, (0.0,), 1) for links in (0.0, 0.1, 0.3)), *((ANY, links, 0, 0, (0.0,), 0) for links in (0.7, 0.8, 1.0)), *((SHORT, links, 0, 0, (0.0,), None) for links in (0.0, 0.1)),
)
NEIGHBOURS = (
    (0, 0.0, 0, 0.0, 0), (4, 1.0, 3, 1.0, 0), (0, 0.0, 5, 1.0, 0), (6, 0.9, 0, 0.0, 0), (6, 0.0, 4, 0.0, 1), (3, 1.0, 6, 0.0, 1),
    (50, 0.0, 60, 0.0, 1), (30, 0.0, 5, 1.0, 1), (4, 1.0, 40, 0.0, 1), (90, 0.1, 2, 0.0, 1), (0, 0.0, 35, 0.0, 1),
)
LABELLED = tuple(
    (words, links, *n[:4], inside, named_as, share, heading, n[4] if answer is None else answer)
    for some, links, inside, named_as, shares, answer in KINDS for words in some for share in shares for n in NEIGHBOURS for heading in (0, 1)[: 1 + (words < 10)]
)


def grow(rows: np.ndarray, depth: int = 10) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, tree if at most, tree if above), or
    the share of main text in a leaf. Ties go to the earlier feature and the lower threshold."""
    labels = rows[:, -1]
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    impurity = lambda y: len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            cost = impurity(labels[low]) + impurity(labels[~low])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t))
    if best is None:
        return share
    low = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def judge(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    """The tree's shares for rows of features."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = judge(tree[2], x[low]), judge(tree[3], x[~low])
    return out


def main_text(page: str | None, tree: tuple | float) -> tuple[str, int, int]:
    """Main text, its number of blocks, and the number of blocks of the page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return "", 0, 0
    chosen = np.flatnonzero(judge(tree, features(blocks)) >= 0.5)
    return " ".join(blocks[i][0] for i in chosen), len(chosen), len(blocks)


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """pages (html) with text, n_chars, n_kept_blocks and n_blocks."""
    pages = pages.drop("text", "n_chars", "n_kept_blocks", "n_blocks")  # replaced
    tree = grow(np.array(labelled, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            got = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "text", "n_chars", "n_kept_blocks", "n_blocks"])

    return pages.mapInArrow(run, widened(pages, "text string, n_chars long, n_kept_blocks long, n_blocks long"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
    return out.select("page_id", "url", "text", "n_chars", "n_kept_blocks", "n_blocks")
