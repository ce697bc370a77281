"""Plain Python versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("t", "nd", "r", "ss") for c in ("a", "e", "im", "os", "u")]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def groups(docs):
    """{index: smallest doc_id of its component} for docs (doc_id, text)."""
    sets = [shingles(t) for _, t in docs]
    holders, parent = defaultdict(list), list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
        for x in s:
            holders[x].append(i)
    lowest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            lowest[top(i)] = min(lowest.get(top(i), d), d)
    return [(len(s), lowest.get(top(i)) if s else docs[i][0]) for i, s in enumerate(sets)]


def windows_removed(docs, size=20):
    """{doc_id: (n_words, kept words)} for docs with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            if k in seen:
                gone[j : j + size] = [True] * size
            seen.add(k)
        out[d] = (len(w), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def item_distance(item, text):
    """Edit distance of item to its best place in text, in words."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        old, row = row, [i + 1]
        for j, v in enumerate(text):
            row.append(min(old[j] + (w != v), old[j + 1] + 1, row[j] + 1))
    return min(row)


def ppm(texts, train, order):
    """log10 probability of each text by the counts of the train texts: one dictionary of contexts, byte by byte."""
    seen = defaultdict(Counter)

    def places(text):
        b = bytes([255] * order) + text.encode() + b"\xff"
        return ((b[i - order : i], b[i]) for i in range(order, len(b)))

    for text in train:
        for context, byte in places(text):
            for j in range(order + 1):
                seen[context[order - j :]][byte] += 1

    def chance(context, byte):
        excluded, out = set(), 1.0
        for j in range(order, -1, -1):
            kinds = seen.get(context[order - j :], {})
            new = {b: n for b, n in kinds.items() if b not in excluded}
            if new:
                whole = sum(new.values()) + (len(new) if len(kinds) < 256 else 0)
                if byte in new:
                    return out * new[byte] / whole
                out *= len(new) / whole
                excluded |= set(new)
        return out / (256 - len(excluded))

    return [sum(math.log10(chance(*p)) for p in places(t)) for t in texts]


def spelling(docs, letters=7, garble=None):
    """{word: (n, near words)} of docs (doc_id, text)."""
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if garble and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}

    def one_apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {w: (k, {v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)}) for w, k in n.items()}
