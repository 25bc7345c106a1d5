"""Filter interactions: every order walked document by document, Shapley weights, odd inputs."""

import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from authwatch.llm import interactions
from tests.llm.naive import corpus

WORD = re.compile("[^\x20\x09-\x0D]+")


def failed(docs):
    """Failed filters of each (doc_id, text)."""
    least = {}
    for i, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        out.append({k for k, bad in (
            ("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)),
            ("D", bool(re.search(r"[#$%&*|]", t))), ("E", i is not None and least[t] < i)) if bad})
    return out


def plain(docs, parts, good, toxic):
    """Rows by applying each order to each document."""
    fails = failed(docs)
    rows = {}
    total = defaultdict(int)
    for part in set(parts):
        own = [(f, i) for f, (i, _), p in zip(fails, docs, parts) if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                total[part, k] += len(gone)
                rows[part, order, step] = [
                    len(left), len(gone), sum(k in f for f, _ in own) - len(gone), sum(f == {k} for f, _ in own),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in rows.items()}


def audited(spark, docs, parts, labels):
    table = spark.createDataFrame([(i, t, p, "x", 1) for (i, t), p in zip(docs, parts)],
                                  "doc_id bigint, text string, source string, mask string, n int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = interactions.orders(interactions.failure_counts(table, known)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got}


def test_equals_every_order_walked(spark):
    docs = [(i, t) for i, t, *_ in corpus(4, 40)]
    docs += [(500 + i, f"Word{i % 3} other " * (40 + 90 * (i % 2)) + "#" * (i % 3)) for i in range(24)]
    docs += [(600, " ".join(f"w{k}" for k in range(250))), (601, " ".join(f"w{k}" for k in range(250))), (602, "SHOUT " * 300)]
    parts = ["hot" if i % 3 else f"s{i % 4}" for i in range(len(docs))]
    labels = [(i, int(k % 3 == 0), int(k % 5 == 0)) for k, (i, _) in enumerate(docs) if k % 2] + [(99_999, 1, 1), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q}, {i for i, _, x in labels if x}
    want = plain(docs, parts, good, toxic)
    got = audited(spark, docs, parts, labels)
    assert got == want and len(got) == 600 * len(set(parts))


def test_null_repeated_and_labelled_twice(spark):
    docs = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (5, "a"), (7, None), (8, ""), (2, "b"), (2, "a"), (1, None)]
    labels = [(3, 0, 1), (3, 1, None), (5, None, None), (8, 1, 0)]
    want = plain(docs, [""] * len(docs), {3, 8}, {3})
    assert audited(spark, docs, [None] * len(docs), labels) == want
    assert want["", "EABCD", 1][1] == 5  # 3, 3 and 5 after 2; 7 and 8 after 1


def test_empty_tables(spark):
    assert audited(spark, [], [], []) == {}
    assert audited(spark, [(1, "a")], ["p"], [])["p", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_weights_equal_the_mean_over_orders(n):
    full = 2 ** n - 1
    value = [0, *[(s * 37 + s * s) % 101 for s in range(1, full + 1)]]
    for i, row in enumerate(interactions.shapley_weights(n)):
        mean = 0
        for order in permutations(range(n)):
            before = sum(1 << j for j in order[:order.index(i)])
            mean += value[before | 1 << i] - value[before]
        assert sum(w * v for w, v in zip(row, value)) == mean


def test_solution_is_the_constrained_minimum():
    """Moving the shares along the constraint never lowers the weighted squares."""
    n, full = 3, 7
    value = [0, 4, 9, 11, 2, 7, 10, 15]
    share = [Fraction(sum(w * v for w, v in zip(row, value)), factorial(n)) for row in interactions.shapley_weights(n)]
    kernel = {s: Fraction(n - 1, 3 * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}

    def cost(x):
        return sum(k * (value[s] - sum(x[i] for i in range(n) if s >> i & 1)) ** 2 for s, k in kernel.items())

    assert sum(share) == value[full]
    for a in range(n):
        for b in range(n):
            if a != b:
                moved = list(share)
                moved[a] += Fraction(1, 10)
                moved[b] -= Fraction(1, 10)
                assert cost(moved) > cost(share)


def test_one_text_in_thousands_of_copies(spark):
    docs = [(i, "copy") for i in range(3000)] + [(5000, "other")]
    got = audited(spark, docs, ["p"] * 3000 + ["q"], [])
    assert got["p", "EABCD", 1][:3] == (1, 2999, 0) and got["q", "EABCD", 1][1] == 0
