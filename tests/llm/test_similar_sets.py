import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.similar_sets import band_keys, build_sets, candidates, classes, pairs_in_blocks, similar_between, similar_classes, similar_pairs, sketch, with_frequent


def frame(spark, rows):
    return spark.createDataFrame(rows, "grp int, id long, item long")


def brute(rows, t=0.6, least=3):
    sets = {}
    for g, i, x in rows:
        if i is not None and x is not None:
            sets.setdefault((g, i), set()).add(x)
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    keys = sorted(sets)
    return {(g, i, j) for n, (g, i) in enumerate(keys) for h, j in keys[n + 1 :] if g == h and len(sets[g, i] & sets[h, j]) >= t * len(sets[g, i] | sets[h, j]) - 1e-12}


def sample(seed, n=160, values=60, hot=None):
    r = random.Random(seed)
    rows, known = [], []
    for i in range(n):
        if known and r.random() < 0.5:
            s = set(r.choice(known))
            for _ in range(r.randint(0, 2)):
                s ^= {r.randrange(values)}
        else:
            s = {r.randrange(values) for _ in range(r.randint(1, 9))}
        if hot is not None:
            s |= {hot}
        known.append(s)
        rows += [(i % 2, i, x) for x in s for _ in range(r.randint(1, 2))]
    return rows


def pairs(df):
    got = [(r.grp, r.id_a, r.id_b) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    rows = sample(1) + [(0, None, 3), (0, 5, None), (1, 900, 1), (1, 900, 2), (1, 901, 1), (1, 901, 2)]
    assert pairs(similar_pairs(frame(spark, rows))) == brute(rows)


def test_frequent_values_lose_no_pair(spark):
    """Buckets of frequent values are cut by prefix values."""
    rows = sample(2, hot=1000)
    reps, _ = classes(build_sets(frame(spark, rows), 3))
    assert with_frequent(reps, 20).where("frequent > 0").count() == reps.count()
    got = {(r.grp, r.rep_a, r.rep_b) for r in candidates(reps, 0.6, frequent=20).collect()}
    rep_ids = {r.rep for r in reps.collect()}
    assert got >= {(g, a, b) for g, a, b in brute(rows) if a in rep_ids and b in rep_ids}
    assert {(r.grp, r.rep_a, r.rep_b) for r in similar_classes(reps, 0.6).collect()} == {(g, a, b) for g, a, b in brute(rows) if a in rep_ids and b in rep_ids}


def test_frequent_only_buckets_are_cut():
    n = 200
    values = np.concatenate([[i, i + 1000, 77] for i in range(n)])
    offsets = np.arange(0, 3 * n + 1, 3)
    _, plain, hot = band_keys(offsets, values, np.zeros(n, int), 0.6, 56, 3, 7)
    assert not hot.any()
    _, cut, hot = band_keys(offsets, values, np.ones(n, int), 0.6, 56, 3, 7)
    largest = lambda k: np.unique(k, return_counts=True)[1].max()
    assert largest(plain) > 20 and largest(cut) < 5 and hot.any() and not hot.all()


def all_frequent(seed, n):
    """Sets of 8 values, all of them in very many sets; a tenth of the sets are changed copies."""
    r = random.Random(seed)
    sets = []
    while len(sets) < n:
        s = set(r.sample(range(40), 8)) if not sets or r.random() > 0.1 else (set(r.choice(sets)) ^ {r.randrange(40)})
        sets.append(s)
    return [(0, i, x) for i, s in enumerate(sets) for x in s]


def test_candidates_follow_results_where_all_values_are_frequent(spark):
    for n in (1000, 2000):
        reps, _ = classes(build_sets(frame(spark, all_frequent(3, n)), 3))
        found = candidates(reps, 0.6, frequent=50).count()
        real = similar_classes(reps, 0.6).count()
        assert real > n / 20 and found < 8 * real  # all pairs would be n * n / 2


def test_recall_at_the_threshold():
    r = random.Random(5)
    hit = 0
    for k in range(400):  # sets of four that share three: 3 / 5
        x = r.sample(range(10**6), 5)
        values = np.array(x[:4] + x[:3] + x[4:])
        owner, keys, _ = band_keys(np.array([0, 4, 8]), values, np.zeros(2, int), 0.6, 48, 3, 7)
        hit += bool(set(keys[owner == 0]) & set(keys[owner == 1]))
    assert hit / 400 > 0.99


def test_sketches_never_differ_more_than_sets(spark):
    r = random.Random(6)
    sets = [{r.randrange(90) for _ in range(r.randint(1, 40))} for _ in range(60)]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "i int, items array<long>").orderBy("i").select(sketch(F.col("items"))).collect()]
    assert all(bin(x ^ y).count("1") <= len(a ^ b) for a, x in zip(sets, got) for b, y in zip(sets, got))
    assert max(bin(x).count("1") for x in got) > 20


def test_blocks_meet_each_pair_once(spark):
    rows = spark.createDataFrame([(k, i, n) for k, n in ((1, 50), (2, 7), (3, 1)) for i in range(n)], "k long, id long, n long")
    got = [(r.a.k, r.a.id, r.b.id) for r in pairs_in_blocks(rows, ["k"], "n", "id", block=6).collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2 + 7 * 6 // 2


def test_copies_form_classes(spark):
    rows = [(0, i, x) for i in range(30) for x in (1, 2, 3, 4)] + [(0, 50, x) for x in (1, 2, 3, 5)]
    reps, members = classes(build_sets(frame(spark, rows), 3))
    assert sorted((r.rep, r.copies) for r in reps.collect()) == [(0, 30), (50, 1)]
    assert members.count() == 30
    assert [(r.rep_a, r.rep_b, r.similarity) for r in similar_classes(reps, 0.6).collect()] == [(0, 50, 0.6)]
    assert pairs(similar_pairs(frame(spark, rows))) == brute(rows)


def test_between_two_tables(spark):
    left, right = [(0, 1, x) for x in (1, 2, 3)], [(0, 1, x) for x in (1, 2, 3)] + [(0, 2, x) for x in (1, 2, 3, 4, 5)] + [(0, 3, 9)]
    got = similar_between(frame(spark, left), frame(spark, right))
    assert sorted((r.grp, r.id_left, r.id_right) for r in got.collect()) == [(0, 1, 1), (0, 1, 2)]


def test_empty_and_large(spark):
    assert similar_pairs(frame(spark, [])).count() == 0
    rows = [(0, i, x) for i in (1, 2) for x in range(5000 + 100 * i)]
    assert pairs(similar_pairs(frame(spark, rows))) == {(0, 1, 2)}
