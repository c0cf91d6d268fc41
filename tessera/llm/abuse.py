"""Abusive, hateful or sexually explicit language: a calibrated score for every document.

A document's lines are cut into words: camel case and snake case are split, accents, invisible characters and
look-alike letters undone, letters spelled apart or as digits put together, and starred words completed from the word
lists. A line of many words is cut into overlapping windows, each of which is a line of its own.

Dense features come from three places. All lines: evidence (log-odds learned from the labels) per line and per word,
rates of capitals, exclamations and odd spellings. Lines that hold a suspicious word are segments, alone and joined with
neighbouring lines of the same comment; the segment of most evidence and the segment of most listed words are both
described: word list densities of each category in four languages, learned words and word pairs, distance of second
persons to insults, capitals, punctuation and obfuscation. Gradient-boosted trees on these features score every
document, also one without any suspicious word, and isotonic regression on out-of-fold scores calibrates them.

The labelled sample is bounded in documents (``max_labels``, chosen by a hash of the id), characters of one
(``max_chars``) and of all (``max_total``); ids are chosen before any text is read. Learned weights are cross-fitted so
that the trees see them as they will be on new documents, and the trees of the folds are fitted in parallel tasks.
Scoring covers every document, whole, in one narrow pass.
"""

from __future__ import annotations

import gc
import math
import pickle
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as of
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm import boosting
from tessera.llm.lexicon import CATEGORIES, HIDDEN, LEET, LOOKALIKES
from tessera.llm.mixing import source_key
from tessera.session import cut

NAMES = list(CATEGORIES)
BIT = {c: 1 << i for i, c in enumerate(NAMES)}
STRONG = BIT["insult"] | BIT["sexual"] | BIT["threat"] | BIT["dehuman"]
EXACT: dict[str, int] = {}
STEMS: dict[str, int] = {}
for _c, _words in CATEGORIES.items():
    for _w in _words:
        _into, _k = (STEMS, _w[:-1]) if _w.endswith("*") else (EXACT, _w)
        _into[_k] = _into.get(_k, 0) | BIT[_c]
STEM_SIZES = sorted({len(k) for k in STEMS})
#: Words to complete starred spellings from.
WHOLE = sorted({w.rstrip("*") for c in ("insult", "sexual", "dehuman", "threat") for w in CATEGORIES[c]})

RAW = re.compile(r"[\w*@$]+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\WA-Z\d_]+")
#: For ASCII texts: bytes of tokens and line ends stay, all others become blanks.
TOKEN_BYTES = bytes(i if chr(i) in "_*@$\n" or (i < 128 and chr(i).isalnum()) else 32 for i in range(256))
#: Letters become a, and a text without these runs holds no letters spelled apart; it is tested before the pattern.
LETTER_BYTES = bytes(97 if i < 128 and chr(i).isalpha() else i for i in range(256))
APART_RUNS = [b"a" + (sep + b"a") * 3 for sep in (b" ", b".", b"-", b"*")]
APART = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-*·])[^\W\d_](?:\1[^\W\d_]){2,}(?![^\W_])")
STARRED = re.compile(r"[^\W\d_]+\*+[^\W\d_]*")
TRIPLE = re.compile(r"(.)\1\1+")
MARK = re.compile(r"\s*([^\w\s\"'(@]*)")
HIDE = dict.fromkeys(map(ord, HIDDEN))
ALIKE = str.maketrans(LOOKALIKES)
LEETS = [str.maketrans(LEET), str.maketrans(LEET | {"1": "l"})]
CACHED = 100_000
#: Words of a window of a long line, and how many of them the next window repeats.
WINDOW, OVERLAP = 40, 14


@lru_cache(maxsize=CACHED)
def categories(word: str) -> int:
    """The bits of the categories that list the word."""
    bits = EXACT.get(word, 0)
    for n in STEM_SIZES:
        if n > len(word):
            break
        bits |= STEMS.get(word[:n], 0)
    return bits


def comment_mark(line: str) -> str:
    """The punctuation a line begins with, two signs at most; lines of one comment have the same."""
    return MARK.match(line).group(1)[:2]


def plain(word: str) -> str:
    """Lower case, without accents and look-alikes."""
    word = word.lower()
    if word.isascii():
        return word
    word = "".join(c for c in unicodedata.normalize("NFKD", word.replace("ß", "ss")) if not unicodedata.combining(c))
    return word if word.isascii() else word.translate(ALIKE)


@dataclass
class Learned:
    """Weights of words and word pairs from labelled documents, and the words that make a line suspicious."""

    words: dict[str, float] = of(default_factory=dict)
    pairs: dict[str, float] = of(default_factory=dict)


class Reader:
    """Cuts lines into words; knows which words exist, to undo obfuscation. What was read is remembered per token and
    line; the memory is emptied between documents when it is full."""

    def __init__(self, learned: Learned):
        self.known = set(learned.words)
        self.suspicious = {w for w, x in learned.words.items() if x >= 1.5}
        self.hot_words: dict[str, bool] = {}
        self.tokens = _Tokens(self)
        #: Tokens that are suspicious, oddly spelled or in capitals: (suspicious, odd, capitals).
        self.special: dict[str, tuple[bool, int, int]] = {}
        self.lines: dict[str, tuple] = {}

    def is_known(self, w: str) -> bool:
        return w in self.known or bool(categories(w) & STRONG)

    def _part(self, part: str) -> tuple[list[str], int]:
        if part.isalpha():
            return self._letters(part)
        letters = [x for x in re.split(r"[\d@$*]+", part) if x]
        if len(part) >= 4 and len(part) - sum(map(len, letters)) <= 3 * len(part) // 5:
            for table in LEETS:
                w = plain(part.translate(table))
                if w.isalpha() and self.is_known(w):
                    return [w], 1
        words: list[str] = []
        for x in letters:
            words += self._letters(x)[0]
        return words, 0

    def _letters(self, part: str) -> tuple[list[str], int]:
        pieces = [part] if part.islower() or part.isupper() or part.istitle() else CAMEL.findall(part)
        words, odd = [], 0
        for x in pieces:
            w = plain(x)
            if len(w) > 4 and TRIPLE.search(w):
                for short in (TRIPLE.sub(r"\1", w), TRIPLE.sub(r"\1\1", w)):
                    if self.is_known(short):
                        w, odd = short, 1
                        break
            words.append(w)
            odd |= not x.isascii() and x.lower().translate(ALIKE).isascii() and not all("LATIN" in unicodedata.name(c, "") for c in x)
        return words, odd

    def token(self, raw: str) -> tuple[str, ...]:
        """The words of a token."""
        if raw.isdigit():
            return ()
        words, odd = [], 0
        for part in raw.strip("*@$").split("_"):
            if "*" in part and STARRED.fullmatch(part) and len(part) >= 4:
                want = re.compile(plain(part).replace("*", "."))
                found = next((w for w in WHOLE if want.fullmatch(w)), None)
                if found or part.count("*") > 1:
                    words.append(found or "*")
                    odd = 1
                    continue
            if part:
                more, o = self._part(part)
                words += more
                odd |= o
        hot = odd == 1 or self.is_hot(words)
        caps = len(raw) > 2 and raw.isupper()
        if hot or odd or caps:
            self.special[raw] = hot, int(odd), int(caps)
        return tuple(words)

    def is_hot(self, words: list[str]) -> bool:
        known = self.hot_words
        for w in words:
            hot = known.get(w)
            if hot is None:
                if len(known) >= CACHED:
                    known.clear()
                hot = known[w] = w in self.suspicious or bool(categories(w) & STRONG)
            if hot:
                return True
        return False

    def line(self, s: str) -> tuple:
        """(words, suspicious, odd spellings, capitals, exclamations, line) of each window of a line."""
        out = self.window(s, s)
        if out is None:  # a long line, as of minified files, is many windows, each with its own counts
            cuts = [m.start() for m in RAW.finditer(s)]
            last = max(len(cuts) - OVERLAP, 1)
            cuts[0] = 0
            cuts.append(len(s))
            out = tuple(self.window(s[cuts[i] : cuts[min(i + WINDOW, len(cuts) - 1)]], s, True) for i in range(0, last, WINDOW - OVERLAP))
        else:
            out = (out,)
        if len(s) <= 400:
            if len(self.lines) >= CACHED:
                self.lines.clear()
            self.lines[s] = out
        return out

    def window(self, s: str, line: str, any_size: bool = False) -> tuple | None:
        """The counts of one window; None for more than WINDOW tokens, unless any_size."""
        text = s
        odd = 0
        if not s.isascii():
            text = s.translate(HIDE)
            odd += len(text) < len(s)
            text = unicodedata.normalize("NFKC", text)
        if APART.search(text):
            def whole(m: re.Match) -> str:
                nonlocal odd
                w = m.group(0).replace(m.group(1), "")
                if not self.is_known(plain(w)):
                    return m.group(0)
                odd += 1
                return w

            text = APART.sub(whole, text)
        raws = RAW.findall(text)
        if len(raws) > WINDOW and not any_size:
            return None
        return self._counted(raws, odd, text.count("!"), line)

    def _counted(self, raws: list[str], odd: int, bang: int, line: str) -> tuple:
        words = list(chain.from_iterable(map(self.tokens.__getitem__, raws)))
        hot, caps = odd > 0, 0
        if not self.special.keys().isdisjoint(raws):
            for raw in raws:
                t = self.special.get(raw)
                if t:
                    hot, odd, caps = hot or t[0], odd + t[1], caps + t[2]
        return words, hot, odd, caps, bang, line

    def document(self, text: str | None) -> list[tuple]:
        """The windows of all lines that aren't blank."""
        if not text:
            return []
        if len(self.tokens) >= CACHED:
            self.tokens.clear()
            self.special.clear()
        text = text.replace("\r", "\n")
        lines = text.split("\n")
        if not text.isascii() or self._spelled_apart(text):
            known = self.lines
            return [x for s in lines if s and not s.isspace() for x in known.get(s) or self.line(s)]
        # nothing to undo beyond single tokens: the same windows by cutting the whole text at once
        out: list[tuple] = []
        bang = "!" in text
        for s, row in zip(lines, text.encode().translate(TOKEN_BYTES).decode().split("\n"), strict=True):
            raws = row.split()
            if len(raws) > WINDOW:
                out += self.line(s)
            elif raws or s.strip():
                out.append(self._counted(raws, 0, s.count("!") if bang else 0, s))
        return out

    @staticmethod
    def _spelled_apart(text: str) -> bool:
        shape = text.encode().translate(LETTER_BYTES)
        return any(run in shape for run in APART_RUNS) and APART.search(text) is not None


class _Tokens(dict):
    """The words of each token, made when it is asked for first."""

    def __init__(self, reader: Reader):
        self.make = reader.token

    def __missing__(self, raw: str) -> tuple[str, ...]:
        out = self[raw] = self.make(raw)
        return out


def grams(lines: list[tuple]) -> set[str]:
    """The words and the pairs of adjacent words of a document; a pair may cross a line end within a comment."""
    out: set[str] = set()
    last, mark = "", None
    for words, *_, s in lines:
        m = comment_mark(s)
        if m != mark:
            last = ""
        if words:
            chain = [last, *words] if last else words
            out.update(words)
            out.update(map(" ".join, zip(chain, chain[1:])))
            last = words[-1]
        mark = m
    return out


def learn(counts: list[tuple[str, int, int]], p: int, n: int, least: int = 3) -> Learned:
    """Shrunken log-odds of a word or a pair of adjacent words, from the numbers of abusive and of other documents that
    hold it, out of p and n such documents."""
    out = Learned()
    for gram, a, b in counts:
        if a + b < least or (not a and b < 8):
            continue
        w = (math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))) * (a + b - 1) / (a + b + 2)
        if abs(w) >= 0.4:
            (out.pairs if " " in gram else out.words)[gram] = min(w, 5.0)
    return out


SEGMENT = ["evidence", "word_sum", "pair_sum", "pair_max", "pair_top2", "negative", *NAMES, "near", "near_third", "odd", "caps", "exclaim", "n_words", "strong_share", "group_dehuman", "second_strong"]
DOCUMENT = ["hot_lines", "second_best", "third_best", "strong_density", "second_density", "caps_rate", "exclaim_rate", "odd_rate", "line_max", "line_second", "evidence_rate", "positive_rate"]
FEATURES = [*SEGMENT, *(f"listed_{x}" for x in SEGMENT), *DOCUMENT]


def _segment(words: tuple[str, ...], parts: list[tuple], learned: Learned) -> list[float]:
    n = len(words)
    get, pair = learned.words.get, learned.pairs.get
    ws = [get(w, 0.0) for w in words]
    ps = [pair(f"{a} {b}", 0.0) for a, b in zip(words, words[1:])]
    up = sorted((x for x in ps if x > 0), reverse=True)
    listed = [(i, b) for i, b in enumerate(map(categories, words)) if b]
    counts = [sum(1 for _, b in listed if b & bit) for bit in BIT.values()]
    strong = [i for i, b in listed if b & STRONG]
    near, near3 = 12, 12
    for i, b in listed:
        if b & BIT["second"]:
            near = min([near, *(abs(i - j) for j in strong if j != i)])
        elif b & BIT["third"]:
            near3 = min([near3, *(abs(i - j) for j in strong if j != i)])
    word_sum, pair_sum = sum(x for x in ws if x > 0), sum(up)
    negative = sum(x for x in ws if x < 0) + sum(x for x in ps if x < 0)
    c = dict(zip(NAMES, counts, strict=True))
    return [
        word_sum + pair_sum + negative, word_sum, pair_sum, up[0] if up else 0.0, sum(up[:2]), negative, *counts, near, near3,
        sum(p[2] for p in parts), sum(p[3] for p in parts), sum(p[4] for p in parts), n,
        len(strong) / max(n, 1), min(c["group"], c["dehuman"]), min(c["second"], len(strong)),
    ]


#: Places of what tells which of two segments holds more listed words: strong words beside a second person, their share.
_LISTED = (SEGMENT.index("second_strong"), SEGMENT.index("strong_share"), SEGMENT.index("evidence"))


def features(lines: list[tuple], learned: Learned) -> list[float]:
    """The dense features of a document; the segments of one without suspicious lines are all zero."""
    best = listed = None
    scores: list[float] = []
    total = max(sum(len(x[0]) for x in lines), 1)
    strong = second = 0
    done: dict[tuple, list[float]] = {}
    hot = 0
    for i, line in enumerate(lines):
        if not (line[1] and line[0]):
            continue
        hot += 1
        mark = comment_mark(line[5])
        lo = i - 1 if i and comment_mark(lines[i - 1][5]) == mark else i
        hi = i + 1 if i + 1 < len(lines) and comment_mark(lines[i + 1][5]) == mark else i
        top = None
        for a, b in {(i, i), (lo, i), (i, hi), (lo, hi)}:
            parts = lines[a : b + 1]
            key = tuple(w for p in parts for w in p[0])
            got = done.get(key)
            if got is None:
                got = done[key] = _segment(key, parts, learned)
            if top is None or got[0] > top[0]:
                top = got
            if listed is None or [got[k] for k in _LISTED] > [listed[k] for k in _LISTED]:
                listed = got
        scores.append(top[0])
        if best is None or top[0] > best[0]:
            best = top
        for b in map(categories, line[0]):
            if b:
                strong += b & STRONG > 0
                second += b & BIT["second"] > 0
    scores = sorted(scores, reverse=True) + [0.0, 0.0, 0.0]
    get = learned.words.get
    sums = sorted([sum(filter(None, map(get, line[0]))) for line in lines], reverse=True) + [0.0, 0.0]
    zero = [0.0] * len(SEGMENT)
    return [
        *(best or zero), *(listed or zero), hot, scores[1], scores[2], 1000 * strong / total, 1000 * second / total,
        sum(x[3] for x in lines) / total, sum(x[4] for x in lines) / total, 1000 * sum(x[2] for x in lines) / total,
        sums[0], sums[1], sum(sums) / total, sum(x for x in sums if x > 0) / total,
    ]


@dataclass
class Model:
    learned: Learned
    trees: boosting.Trees
    steps: boosting.Isotonic

    def scores(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.array([features(reader.document(t), self.learned) for t in texts])
        return self.steps.apply(self.trees.raw(x))


def _gram_counts(sample: DataFrame, learned: Learned, folds: int) -> list[tuple[str, list[int], list[int]]]:
    """(gram, abusive documents by fold, other documents by fold) of the grams that three documents hold or more.

    Documents are read in parallel and counted in the JVM; what comes to the driver is bounded by the sample.
    """
    sent = sample.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            held = [list(grams(reader.document(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.string()))], names=["y", "fold", "grams"])

    each = sample.select("y", "fold", "text").mapInArrow(run, "y int, fold int, grams array<string>").select("y", "fold", F.explode("grams").alias("gram"))
    by = [F.count(F.when((F.col("fold") == k) & (F.col("y") == y), 1)) for y in (1, 0) for k in range(folds)]
    rows = each.groupBy("gram").agg(F.count("*").alias("n"), F.array(*by[:folds]).alias("pos"), F.array(*by[folds:]).alias("neg")).where("n >= 3").toArrow()
    return list(zip(rows.column("gram").to_pylist(), rows.column("pos").to_pylist(), rows.column("neg").to_pylist(), strict=True))


def fit(sample: DataFrame, folds: int = 5) -> Model:
    """The model of a bounded labelled sample (text, y), y 1 for abusive and 0 for other texts.

    Folds go by a hash of the whole text, blanks aside, so copies stay together. Words are learned twice: the second
    time from texts read by a reader that knows the words learned first and so undoes more spellings. The fit doesn't
    depend on the order of the rows. An empty sample gives the score one half to all.
    """
    spark = sample.sparkSession
    blanks = F.regexp_replace(F.trim(F.col("text")), r"\s+", " ")
    sample = sample.select(F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(blanks), F.lit(folds)).cast("int").alias("fold"), "text")
    sizes = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}

    def learned_from(known: Learned) -> list[Learned]:
        """Without each fold, then of all."""
        counts = _gram_counts(sample, known, folds)
        out = []
        for k in range(folds + 1):
            p, n = (sum(v for (f, y), v in sizes.items() if y == own and f != k) for own in (1, 0))
            out.append(learn([(g, sum(a) - (a[k] if k < folds else 0), sum(b) - (b[k] if k < folds else 0)) for g, a, b in counts], p, n))
        return out

    parts = learned_from(learned_from(Learned())[-1])
    sent = spark.sparkContext.broadcast(parts)  # bounded by the sample

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = sent.value
        reader = Reader(by_fold[-1])
        for batch in batches:
            rows = [features(reader.document(t), by_fold[k]) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["y", "fold", "x"])

    got = sample.mapInArrow(describe, "y int, fold int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y, fold = got.column("y").to_numpy().astype(np.float64), got.column("fold").to_numpy()
    order = np.lexsort([*x.T, y])
    x, y, fold = x[order], y[order], fold[order]
    trees = _fit_folds(spark, x, y, fold, folds)
    raw = np.zeros(len(x))
    for k in range(folds):
        raw[fold == k] = trees[k].raw(x[fold == k])
    return Model(parts[-1], trees[folds], boosting.isotonic(raw, y))


def _fit_folds(spark: SparkSession, x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int) -> list[boosting.Trees]:
    """The trees of the rows without each fold, then of all rows; one task each."""
    sent = spark.sparkContext.broadcast((x, y, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, f = sent.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                fitted = boosting.fit(a[f != k], b[f != k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(fitted)], pa.binary())], names=["k", "trees"])

    rows = spark.range(0, folds + 1, 1, folds + 1).mapInArrow(run, "k long, trees binary").collect()
    return [pickle.loads(r.trees) for r in sorted(rows, key=lambda r: r.k)]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labels: int = 10_000, max_chars: int = 100_000, max_total: int = 40_000_000, seed: int = 5) -> DataFrame:
    """(doc_id, text, y): at most max_labels labelled texts of at most max_chars characters, max_total in all.

    y is 1 if most raters said abusive; a tie counts as not. Ids are drawn from the labels alone, by a hash; then the
    texts are fetched in one scan and written to the shared folder, and drawn again by the same hash until max_total
    is reached. Repeated rows of a document count once.
    """
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("y"))
    place = F.xxhash64(F.lit(seed), "doc_id")
    drawn = votes.orderBy(place, "doc_id").limit(max_labels).select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    # at most max_labels rows of two numbers
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where(F.length("text").between(1, max_chars))
    known = cut(known.dropDuplicates(["doc_id"]).withColumn("_place", place))
    # a running total over at most max_labels rows of two numbers
    total = F.sum(F.length("text")).over(Window.orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = known.select("_place", total.alias("total")).where(F.col("total") <= max_total).agg(F.max("_place")).first()[0]
    return known.where(F.col("_place") <= F.lit(last if last is not None else -(2**63)).cast("long")).select("doc_id", "text", "y")


_reader: tuple[str, Reader] | None = None


def worker_reader(key: str, learned: Callable[[], Learned]) -> Reader:
    """The reader of a model in this worker process, kept with what it remembers from task to task."""
    global _reader
    if _reader is None or _reader[0] != key:
        _reader = key, Reader(learned())
    return _reader[1]


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score) of every document; score is the calibrated probability of abusive language.

    docs has doc_id, source and text. Every text, NULL, empty and blank ones included (they have no words), is described
    and scored by the trees. Repeated rows are scored alike; texts are read whole; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        reader = worker_reader(key, lambda: m.learned)
        for batch in batches:
            gc.disable()  # very many small lists, none of them in a cycle
            try:
                s = m.scores(batch.column(2).to_pylist(), reader)
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "source", "score"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")


def score_documents(docs: DataFrame, labels: DataFrame, max_labels: int = 10_000, max_chars: int = 100_000, max_total: int = 40_000_000) -> DataFrame:
    """score_with a model fitted on the labels (doc_id, abusive 0 or 1, perhaps several a document). Without labels all
    scores are 0.5."""
    return score_with(docs, fit(labelled_sample(docs, labels, max_labels, max_chars, max_total)))


def rates_by_source(scored: DataFrame, threshold: float) -> DataFrame:
    """Documents, abusive documents, their rate and the mean score per source (lower case, outer blanks gone)."""
    hit = (F.col("score") >= threshold).cast("long")
    return scored.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.count("*").alias("documents"), F.sum(hit).alias("abusive"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score")
    )
