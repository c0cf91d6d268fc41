import random

import numpy as np
import pytest

from tessera.llm import abuse, boosting

BAD = ["{0} you are a worthless idiot and everybody laughs", "shut up you stupid moron {0}", "I will find you and break your bones, {0}", "those foreigners are vermin and should be deported", "du bist ein dummes Arschloch {0}", "eres un idiota inútil, {0}", "hot porn of naked girls for free"]
FINE = ["the parser returns one token at a time", "kill the child process before the parent aborts", "blocklist terms for the filter: idiot, moron, scum", "this loop is garbage, rewrite it", "users must not call each other idiots here", "returns every row of the segment", "der Leser prüft den Block", "the naked pointer must be stripped of its tag"]


def document(r, bad):
    lines = [f"def {r.choice(['read', 'load', 'scan'])}_{r.choice(['row', 'key', 'page'])}(x):", f"    return x + {r.randrange(99)}"]
    for _ in range(r.randint(1, 5)):
        lines.insert(r.randrange(len(lines)), "# " + r.choice(FINE))
    if bad:
        s = r.choice(BAD).format(r.choice(["brian", "team", "anna"]))
        kind = r.randrange(4)
        if kind == 1:
            s = s.upper()
        elif kind == 2:
            s = s.replace("idiot", "1d10t").replace("moron", "m.o.r.o.n").replace("you ", "yo​u ")
        words = s.split()
        if kind == 3:
            lines += ["# " + " ".join(words[:3]), "# " + " ".join(words[3:])]
        else:
            lines.append("# " + s)
    return "\n".join(lines)


def corpus(seed, n):
    r = random.Random(seed)
    y = np.array([float(r.random() < 0.3) for _ in range(n)])
    return [document(r, v) for v in y], y


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = np.flatnonzero(s[order] == v)
        rank[order[at]] = at.mean()
    p = y > 0
    return (rank[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())


@pytest.fixture(scope="module")
def model(spark):
    texts, y = corpus(1, 500)
    noisy = y.copy()
    noisy[:20] = 1 - noisy[:20]
    return abuse.fit(spark.createDataFrame([(t, int(v)) for t, v in zip(texts, noisy, strict=True)], "text string, y int"))


def test_held_out_accuracy_with_label_errors(model):
    texts, y = corpus(2, 400)
    s = model.scores(texts, abuse.Reader(model.learned))
    assert auc(s, y) > 0.98 and ((s >= 0.5) == (y > 0)).mean() > 0.95
    high = s > 0.8
    assert abs(s[high].mean() - y[high].mean()) < 0.15


def test_hidden_spellings_are_read():
    reader = abuse.Reader(abuse.Learned())
    words = lambda s: [w for x in reader.line(s) for w in x[0]]
    assert words("you 1d10t") == ["you", "idiot"] and words("m.o.r.o.n here") == ["moron", "here"] and words("an i-d-i-o-t") == ["an", "idiot"]
    assert words("mor​on") == ["moron"] and words("mоrоn") == ["moron"] and words("MORONNNN") == ["moron"] and words("imbécil") == ["imbecil"]
    assert words("int killYourselfNow_you_moron = 1") == ["int", "kill", "yourself", "now", "you", "moron"]
    assert words("such v****n")[1] == "vermin" and words("a.b.c.d = x") == ["a", "b", "c", "d", "x"]


def test_long_lines_are_cut_into_windows():
    reader = abuse.Reader(abuse.Learned())
    parts = reader.line("a(b);" * 200 + "you worthless moron;" + "c(d);" * 200)
    assert len(parts) > 5 and any(p[1] for p in parts) and not all(p[1] for p in parts)


def test_each_window_of_a_long_line_has_its_own_counts():
    reader = abuse.Reader(abuse.Learned())
    parts = reader.line("the plain word " * 20 + "you 1d10t m0r0n! GO AWAY " + "of the parser " * 20)
    odd = [p for p in parts if {"idiot", "moron"} <= set(p[0])]
    assert odd and all((p[1], p[2], p[3], p[4]) == (True, 2, 1, 1) for p in odd)
    assert all((p[1], p[2], p[3], p[4]) == (False, 0, 0, 0) for p in parts if not {"idiot", "moron", "go", "away"} & set(p[0]))
    assert parts[0][0][0] == "the" and parts[-1][0][-1] == "parser"
    one = reader.line(" ".join(["w"] * (abuse.WINDOW + 1)))
    assert len(one) == 2 and len(one[0][0]) == abuse.WINDOW


def test_every_text_is_scored_by_the_trees(model):
    reader = abuse.Reader(model.learned)
    calm = ["x = 1", "", None, "the parser returns one token at a time"]
    x = np.array([abuse.features(reader.document(t), model.learned) for t in calm])
    assert (x[:, 0] == 0).all()  # no suspicious line in any
    assert model.scores(calm, reader).tolist() == model.steps.apply(model.trees.raw(x)).tolist()


def test_sample_is_bounded_in_documents_and_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(3, "x" * 100), (50, "y" * 5000), (51, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, 1)], "doc_id long, abusive int")
    some = abuse.labelled_sample(docs, labels, max_labels=20).collect()
    assert 10 <= len(some) <= 20 and len({r.doc_id for r in some}) == len(some)
    short = abuse.labelled_sample(docs, labels, max_chars=1000, max_total=1050).collect()
    assert len(short) == 10 and all(len(r.text) == 100 for r in short)
    full = {r.doc_id: r.y for r in abuse.labelled_sample(docs, labels).collect()}
    assert len(full) == 51 and full[1] == 0 and full[2] == 0 and full[3] == 1  # a tie is no case
    assert abuse.labelled_sample(docs, labels.limit(0)).count() == 0


def test_tables(spark, model):
    texts, y = corpus(3, 120)
    odd = [None, "", "  \n ", "x" * 200_000, texts[0]]
    docs = spark.createDataFrame([(i, t, " Src" if i % 2 else None, 0.5) for i, t in enumerate([*texts, *odd])], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(v), "r") for i, v in enumerate(y)] + [(0, None, "r"), (None, 1, "r")], "doc_id long, abusive int, rater string")
    got = {r.doc_id: r.score for r in abuse.score_documents(docs, labels).collect()}
    n = len(texts)
    assert len(got) == n + 5 and got[n] == got[n + 1] == got[n + 2] < 0.3 and got[n + 3] < 0.3 and got[n + 4] == got[0]
    rates = {r.source: r for r in abuse.rates_by_source(abuse.score_documents(docs, labels), 0.5).collect()}
    assert set(rates) == {"src", None} and sum(r.documents for r in rates.values()) == n + 5
    assert abuse.score_documents(docs.limit(0), labels).count() == 0
    assert abuse.score_documents(docs, labels.limit(0)).count() == n + 5


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit(x[:400], y[:400])
    assert auc(m.raw(x[400:]), y[400:]) > 0.95
    iso = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert iso.apply(np.array([1.0, 2.5, 4])).tolist() == [0.0, 0.5, 1.0]
    assert (np.diff(iso.apply(np.linspace(0, 5, 50))) >= 0).all()
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).raw(np.zeros((3, 2))).shape == (3,)
