import random

import pytest

from brute import VOCABULARY, prose

@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, blanks, copies, near copies, shared passages, runs of one word, short
    and long texts."""
    rng = random.Random(11)
    base, passage = prose(rng, 120).split(), prose(rng, 30)
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "one two three four"), (6, "one two three four"), (7, prose(rng, 4000))]
    for i in range(25):  # near copies, some linked only over others
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        out.append((10 + i, " ".join(w)))
    out += [(40 + i, " ".join(base)) for i in range(5)]
    out += [(50 + i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 10 + i)}") for i in range(12)]
    out += [(70, "so " * 70), (71, "so " * 45 + prose(rng, 30)), (72, prose(rng, 25) + " " + "so la " * 40), (73, passage), (74, "ÀÉ " + passage.upper())]
    out += [(80 + i, prose(rng, 60)) for i in range(30)]
    rng.shuffle(out)
    return out
