import random
from itertools import combinations

import pytest

from tessera.llm.cooccurrence import pairs_of_giants, pairs_together


def frame(spark, rows):
    return spark.createDataFrame([(b, i, "x", 1) for b, i in rows], "t long, p long, item string, n int")


def brute(rows, least, lift):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, one, two = len(baskets), {}, {}
    for s in baskets.values():
        for i in s:
            one[i] = one.get(i, 0) + 1
        for p in combinations(sorted(s), 2):
            two[p] = two.get(p, 0) + 1
    out = {}
    for (a, b), c in two.items():
        if c >= least and c * n >= lift * one[a] * one[b]:
            conf = c / one[a]
            out[a, b] = (one[a], one[b], c, c * n / (one[a] * one[b]), None if conf == 1 else (1 - one[b] / n) / (1 - conf))
    return out


def check(spark, rows, least, lift, **kw):
    got = pairs_together(frame(spark, rows), "t", "p", least, lift, **kw).collect()
    want = brute(rows, least, lift)
    assert len(got) == len(want)
    for r in got:
        w = want[r.item_a, r.item_b]
        assert (r.n_a, r.n_b, r.n_ab) == w[:3] and r.lift == pytest.approx(w[3])
        assert (r.conviction is None) == (w[4] is None) and (w[4] is None or r.conviction == pytest.approx(w[4]))
    return len(got)


def sample(seed):
    r = random.Random(seed)
    rows = []
    for b in range(300):
        team = r.choice([None, (1, 2), (3, 4, 5), (6, 7)])
        members = {*(team or ()), *(r.randrange(60) for _ in range(r.randint(0, 4)))}
        if r.random() < 0.6:
            members.add(99)
        rows += [(b, i) for i in members for _ in range(r.randint(1, 2))]
    return rows + [(None, 1), (5, None)]


def test_equals_brute_force(spark):
    assert check(spark, sample(1), 4, 3.0) > 3
    assert check(spark, sample(2), 1, 0.0) > 100


def test_identical_baskets_collapse(spark):
    rows = [(b, i) for b in range(50) for i in (1, 2, 3)] + [(b, i) for b in range(50, 1000) for i in (4,)]
    assert check(spark, rows, 4, 10.0) == 3


def test_giant_baskets_count_by_membership(spark):
    r = random.Random(4)
    rows = sample(3) + [(1000 + g, i) for g in range(6) for i in range(60) if r.random() < 0.7]
    assert check(spark, rows, 4, 0.5, giant=12) == check(spark, rows, 4, 0.5)
    assert check(spark, [(g, i) for g in range(5) for i in range(30)], 4, 0.0, giant=10) == 435


def test_ties_at_the_bounds_are_kept(spark):
    rows = [(b, i) for b in range(4) for i in (1, 2)] + [(b, 3) for b in range(4, 40)]
    assert check(spark, rows, 4, 10.0) == 1


def test_empty(spark):
    assert check(spark, [], 4, 10.0) == 0


def test_one_giant_basket_lists_no_pairs_of_its_own(spark):
    rows = [x for x in sample(5) if None not in x] + [(2000, i) for i in range(60)] + [(2000, 10_000 + i) for i in range(50_000)]
    small = [x for x in rows if x[1] < 10_000]
    # the giant's own items are in one basket and pair 10^9 times; with at least 2 baskets they must not be listed
    got = {(r.item_a, r.item_b): r.n_ab for r in pairs_together(frame(spark, rows), "t", "p", 2, 0.0, giant=40).collect()}
    assert got == {p: w[2] for p, w in brute(small, 2, 0.0).items()}


def test_pairs_of_giants_share_two_of_them(spark):
    r = random.Random(6)
    rows = [(g, i, 100 + g) for g in range(9) for i in range(40) if r.random() < 0.5]
    of = {i: {g for g, j, _ in rows if j == i} for i in range(40)}
    got = {(p.a, p.b) for p in pairs_of_giants(spark.createDataFrame(rows, "basket long, item long, size long"), 4).collect()}
    assert got >= {(a, b) for a in of for b in of if a < b and len(of[a] & of[b]) >= 4}
    assert all(len(of[a] & of[b]) >= 2 for a, b in got)
