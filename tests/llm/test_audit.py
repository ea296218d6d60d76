"""Op 13 against counting by definition."""

import random
import re
from itertools import permutations

import pytest

from driftwell.llm import audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def by_definition(docs, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for (i, t, _), w in zip(docs, words):
        t = t or ""
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append(f)
    rows = []
    for part in {s or "" for _, _, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        mine, worth = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if f[x]]
                worth[x] += len(gone)
                left = [(i, f) for i, f in left if not f[x]]
                mine.append(
                    [part, "".join(order), k + 1, len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own),
                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                )
        rows += [(*r, worth[r[1][r[2] - 1]]) for r in mine]
    return sorted(rows)


def result(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, mask string, n int").repartition(3)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.audit(audit.mask_counts(d, m)).collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    text = lambda n, kinds: " ".join(rng.choice(["a", "B", "É", "x#", "long", " u", "q v"]) + str(rng.randrange(kinds)) for _ in range(n))
    base = [text(rng.choice([3, 150, 199, 200, 201, 400]), rng.choice([2, 50, 900])) for _ in range(25)]
    out = [(i, rng.choice(base), rng.choice(["web", "books", "", None])) for i in range(60)]
    out += [(100, None, "web"), (101, "", None), (None, base[0], "web"), (None, base[0], "web"), (7, base[1], "books"), (7, base[1], "books"), (7, base[1], "web")]
    out += [(200 + i, "CAPS and\tTabs\x0b\x0c\r\n" * 3, "hot") for i in range(30)] + [(300, "é " * 30_000, "web"), (-1, base[2], "first")]
    return out


LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (205, 1, 1), (5, None, None)]
LABELS = [(i, q, None if t is None else int(t)) for i, q, t in LABELS]


def test_every_order_as_defined(spark, docs):
    assert result(spark, docs, LABELS) == by_definition(docs, LABELS)


def test_empty_tables(spark, docs):
    assert result(spark, [], []) == [] == result(spark, [], LABELS)
    assert all(r[-3:-1] == (0, 0) for r in result(spark, docs[:5], []))


def test_polynomial():
    import numpy as np

    n = np.random.default_rng(1).integers(0, 50, 32)
    poly = audit.removal_polynomial(n)
    assert audit.corners(poly)[31] == n[1:].sum() and audit.corners(poly)[0] == 0
    # the values add up to what all filters remove, and each is its masks' counts over their sizes
    assert sum(audit.shapley(poly, i) for i in range(5)) == n[1:].sum()
    assert audit.shapley(poly, 2) == sum(audit.Fraction(int(n[m]), bin(m).count("1")) for m in range(32) if m & 4)
