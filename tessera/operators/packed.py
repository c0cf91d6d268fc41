"""Several values packed in one field: infer the separators of each source, then split with positions.

The separators of a source (a table's field) are inferred from all its rows, reduced first to their distinct shapes
(digits folded) with counts. Every punctuation mark, tab or inner blank that stands outside double quotes is a
candidate. A candidate is judged on the rows in which it is the only one, by

* piece-count consistency: a list is as long whatever mark separates it, so the distribution of piece counts over the
  candidate's rows is held against that of all regular pieces' rows of the source; the score is the share the two
  distributions have in common. A candidate with few rows is judged with ``PRIOR`` rows of the common distribution
  added, so that chance does not decide;
* type regularity: the share of pieces whose type also occurs as a whole field that holds no candidate at all, or as a
  piece of a separator already accepted, times the share of pieces in rows whose pieces are all id-like or all not. The
  type of an id-like piece is its shape (its letters and one 9 for its digits); of any other piece, its text.

Candidates whose product reaches ``min_score`` are separators. Candidates that are never alone in a row are judged on
all their rows, split at them and at the separators found so far. A field is then split at all separators of its source,
so a row may mix them; a hyphen in ``co-producer`` or an underscore is rejected because its pieces do not stand alone.

Everything but the list of separators (bounded by the distinct punctuation marks in use, per source) stays in the
JVM; splitting is a narrow transformation without a shuffle, and each row is split once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut

SEP, BLANK = "\u0001", "\u0002"
#: Characters that quote or bracket; never separators.
QUOTES, BRACKETS = "\"'", "[](){}"
#: Rows of the common distribution added to a candidate's piece counts, and the count from which counts are one class.
PRIOR, LONG = 50, 64


@dataclass(frozen=True)
class PackedSource:
    """A field to split: table name, field name, and the column that identifies a row."""

    table: str
    field: str
    row_id: str = "rsn"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, made once however often f names it, and only where the whole is asked for."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _bare(raw: Column) -> Column:
    """The list without outer blanks and without brackets around all of it.

    ``[a],[b]`` is not one bracketed list: the first closing mark must be the last character, unless quotes hide some.
    """

    def unwrap(s: Column) -> Column:
        wraps = F.lit(False)
        for opening, closing in ("[]", "()", "{}"):
            wraps = wraps | (s.startswith(opening) & s.endswith(closing) & ((F.locate(closing, s) == F.length(s)) | s.contains('"')))
        return F.when(wraps & (F.length(s) >= 2), F.trim(s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)

    return _let(F.trim(raw), unwrap)


def _slots(bare: Column, old: Column, new: Column) -> Column:
    """The raw slots of a bare list: characters of old become those of new (SEP or BLANK) outside double quotes.

    Parts at even places of a split at the quote mark are outside; a doubled quote gives an empty part. A last quote
    without partner is an ordinary character. Blanks beside another separator or at the ends only pad.
    """

    def marked(parts: Column) -> Column:
        outside = lambda i: (i % 2 == 0) | ((F.size(parts) % 2 == 0) & (i == F.size(parts) - 1))
        return F.array_join(F.transform(parts, lambda x, i: F.when(outside(i), F.call_function("translate", x, old, new)).otherwise(x)), '"')

    def padded(text: Column) -> Column:
        close = F.trim(F.regexp_replace(text, f"{BLANK}*{SEP}{BLANK}*", SEP), F.lit(BLANK))
        return F.when(text.contains(BLANK), F.regexp_replace(close, f"{BLANK}+", SEP)).otherwise(text)

    return F.split(_let(_let(F.split(bare, '"', -1), marked), padded), SEP, -1)


def _is_simple(raw: Column) -> Column:
    """Whether a text holds no blank, quote or bracket, so that nothing pads or hides its separators."""
    return F.translate(raw, f" {QUOTES}{BRACKETS}", "") == raw


def clean_items(slots: Column) -> Column:
    """The values of an array of slots without outer blanks and quotes around them; NULL if blank or \\N.

    Each step is a transform of its own, so that what it starts from is made once per slot.
    """

    def unquote(s: Column) -> Column:
        first, last, inner = s.substr(1, 1), s.substr(-1, 1), F.trim(s.substr(F.lit(2), F.length(s) - 2))
        quoted = lambda q: (first == q) & (last == q) & (F.length(s) >= 2)
        return F.when(quoted('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(quoted("'"), inner).otherwise(s)

    bare = F.transform(F.transform(slots, lambda s: F.trim(s)), unquote)
    return F.transform(bare, _valued)


def _valued(s: Column) -> Column:
    return F.when((s != "") & (s != "\\N"), s)


def _long(tables: dict[str, DataFrame], sources: list[PackedSource]) -> DataFrame:
    """(tbl, fld, rsn, raw) of all sources; one scan per table, non-empty fields only."""
    parts = []
    for name in dict.fromkeys(s.table for s in sources):
        own = [s for s in sources if s.table == name]
        df = tables[name]
        fields = F.array(*[F.struct(F.lit(s.field).alias("fld"), df[s.field].cast("string").alias("raw")) for s in own])
        parts.append(
            df.select(F.lit(name).alias("tbl"), df[own[0].row_id].cast("long").alias("rsn"), F.explode(fields).alias("f"))
            .select("tbl", "f.fld", "rsn", "f.raw")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.trim(F.col("raw")) != "")


def _kind(item: Column) -> Column:
    """The type of a piece: the shape of an id-like one, else its text."""
    low = F.lower(item)
    return F.when(low.rlike(r"^\p{L}*[0-9]+$"), F.regexp_replace(low, "[0-9]+", "9")).otherwise(low)


def _support(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tbl, fld, cand, other, w, even), (tbl, fld, cand, n, w)) from rows (tbl, fld, cand, parts, w), where cand ''
    marks single values and w counts the rows of a shape.

    First: pieces of cand whose kind also occurs with other, and those of them in rows of pieces of one class. Second:
    rows of cand by their number of pieces, at most LONG.
    """
    pieces = F.array_compact(clean_items(F.col("parts")))
    rows = rows.select("tbl", "fld", "cand", "w", pieces.alias("pieces"))
    ids = F.size(F.filter("pieces", lambda x: x.rlike(r"^\p{L}*[0-9]+$")))
    counts = rows.where("cand <> ''").groupBy("tbl", "fld", "cand", F.least(F.size("pieces"), F.lit(LONG)).alias("n")).agg(F.sum("w").alias("w"))
    # made before the explode, which would else make it once per piece
    rows = rows.select("tbl", "fld", "cand", "w", F.when((ids == 0) | (ids == F.size("pieces")), F.col("w")).otherwise(0).alias("even"), F.transform("pieces", _kind).alias("kinds"))
    kinds = (
        rows.select("tbl", "fld", "cand", "w", "even", F.explode_outer("kinds").alias("kind")).where("kind is not null")
        .groupBy("tbl", "fld", "cand", "kind").agg(F.sum("w").alias("w"), F.sum("even").alias("even"))
    )
    # lists of at most one entry per punctuation mark
    both = kinds.groupBy("tbl", "fld", "kind").agg(F.collect_list(F.struct("cand", "w", "even")).alias("c"))
    each = both.select("tbl", "fld", F.explode("c").alias("x"), "c").select("tbl", "fld", "x", F.explode("c.cand").alias("other")).where(F.col("x.cand") != "")
    # a candidate is its own other, which gives its totals
    return each.groupBy("tbl", "fld", F.col("x.cand").alias("cand"), "other").agg(F.sum("x.w").alias("w"), F.sum("x.even").alias("even")), counts


def count_consistency(counts: dict[str, dict[int, int]], regular: dict[str, float]) -> dict[str, float]:
    """The share that each candidate's distribution of piece counts has in common with the source's.

    counts: candidate -> number of pieces -> rows. The source's distribution is that of all candidates' rows, each
    candidate weighted by its type regularity, so marks inside values hardly count.
    """
    common: dict[int, float] = {}
    for c, own in counts.items():
        for n, w in own.items():
            common[n] = common.get(n, 0.0) + w * regular.get(c, 0.0)
    total = sum(common.values())
    if not total:
        return dict.fromkeys(counts, 0.0)
    common = {n: w / total for n, w in common.items()}
    out = {}
    for c, own in counts.items():
        rows = sum(own.values())
        out[c] = sum(min((own.get(n, 0) + PRIOR * common.get(n, 0.0)) / (rows + PRIOR), common.get(n, 0.0)) for n in common)
    return out


def _accepted(
    support: DataFrame, counts: DataFrame, min_score: float, known: dict[tuple[str, str], list[str]]
) -> tuple[dict[tuple[str, str], list[str]], set[tuple[str, str, str]]]:
    """The separators by their support, and all candidates judged. A piece is regular if its kind is a single value or
    a piece of a separator accepted before."""
    w: dict[tuple[str, str], dict[tuple[str, str], int]] = {}
    even: dict[tuple[str, str, str], int] = {}
    rows: dict[tuple[str, str], dict[str, dict[int, int]]] = {}
    for r in support.collect():
        w.setdefault((r.tbl, r.fld), {})[r.cand, r.other] = r.w
        if r.cand == r.other:
            even[r.tbl, r.fld, r.cand] = r.even
    for r in counts.collect():
        rows.setdefault((r.tbl, r.fld), {}).setdefault(r.cand, {})[r.n] = r.w
    found = {k: list(v) for k, v in known.items()}
    for source, table in w.items():
        good = ["", *found.get(source, [])]
        open_ = {c for c, _ in table} - set(good)
        while True:
            regular = {c: max(table.get((c, d), 0) for d in good) * even[(*source, c)] / table[c, c] ** 2 for c in open_}
            score = count_consistency(rows.get(source, {}), regular | dict.fromkeys(good, 1.0))
            now = [c for c in open_ if regular[c] * score.get(c, 0.0) >= min_score]
            if not now:
                break
            good += sorted(now)
            open_ -= set(now)
        found[source] = sorted(good[1:])
    return {k: v for k, v in found.items() if v}, {(t, f, c) for t, f, c in even}


def infer_separators(long: DataFrame, min_score: float = 0.6) -> dict[tuple[str, str], list[str]]:
    """Separators of each (tbl, fld) in a (tbl, fld, raw) table, from all its rows.

    The result is bounded by sources times distinct punctuation marks. An empty table gives an empty dict, and a
    source without candidates has no entry: its fields are single values.
    """
    # one row per distinct shape; digits tell nothing but that they are some
    shapes = long.groupBy("tbl", "fld", F.regexp_replace("raw", "[0-9]+", "9").alias("raw")).agg(F.count("*").alias("w"))
    rows = shapes.withColumn("raw", _bare(F.col("raw")))
    # what is outside quotes, as one text: quoted values become Q, \\N becomes nothing, padding blanks go
    outside = F.replace(F.regexp_replace("raw", r'"[^"]*+"', "Q"), F.lit("\\N"), F.lit(""))
    marks = F.regexp_replace(F.regexp_replace(outside, r"[\p{L}\p{M}\p{N}\[\](){}\"']", "x"), r" *([^x ]) *", "$1")
    rows = rows.withColumn("marks", F.replace(F.trim(marks), F.lit("x"), F.lit("")))
    rows = cut(rows.withColumn("cands", F.array_distinct(F.filter(F.split("marks", ""), lambda c: c != ""))).drop("marks"))

    def pieces(picked: DataFrame, old: Column) -> DataFrame:
        return picked.withColumn("parts", _slots(F.col("raw"), old, F.repeat(F.lit(SEP), F.length(old))))

    alone = rows.where(F.size("cands") <= 1).select("tbl", "fld", "raw", "w", F.coalesce(F.get("cands", F.lit(0)), F.lit("")).alias("cand"))
    alone = pieces(alone, F.col("cand"))
    found, judged = _accepted(*_support(alone), min_score, {})
    mixed = rows.where(F.size("cands") > 1)
    left = [(r.tbl, r.fld, r.cand) for r in mixed.select("tbl", "fld", F.explode("cands").alias("cand")).distinct().collect() if (r.tbl, r.fld, r.cand) not in judged]
    if left:  # never alone in a row: judged together, beside the separators that are known
        known: dict[tuple[str, str], str] = {k: "".join(v) for k, v in found.items()}
        for t, f, c in left:
            known[t, f] = known.get((t, f), "") + c
        these = long.sparkSession.createDataFrame(left, "tbl string, fld string, cand string")
        again = mixed.select("tbl", "fld", "raw", "w", F.explode("cands").alias("cand")).join(F.broadcast(these), ["tbl", "fld", "cand"])
        old = _of_source(known, "")
        support = _support(pieces(again, old).unionByName(alone.where(F.col("cand").isin("", *{c for v in found.values() for c in v}))))
        found, _ = _accepted(*support, min_score, found)
    return found


def _of_source(values: dict[tuple[str, str], str], other: str) -> Column:
    out = F.lit(other)
    for (tbl, fld), v in values.items():
        out = F.when((F.col("tbl") == tbl) & (F.col("fld") == fld), F.lit(v)).otherwise(out)
    return out


def split_lists(tables: dict[str, DataFrame], sources: list[PackedSource], min_score: float = 0.6) -> DataFrame:
    """One row per field that isn't NULL or blank: (tbl, fld, rsn, items), the values of all its slots in order.

    Blank and ``\\N`` slots are NULL. A field of any length is split whole. Without inferred separators a field is a
    single value; an empty table gives no rows.
    """
    long = _long(tables, sources)
    found = infer_separators(long, min_score)
    old = {k: "".join(sorted(v, key=lambda s: s == " ")) for k, v in found.items()}
    new = {k: "".join(BLANK if s == " " else SEP for s in v) for k, v in old.items()}
    raw, old, new = F.col("raw"), _of_source(old, ""), _of_source(new, "")
    # most fields hold separators and values only; the others take the long way
    simple = F.transform(F.split(F.call_function("translate", raw, old, new), SEP, -1), _valued)
    items = F.when(_is_simple(raw), simple).otherwise(clean_items(_slots(_bare(raw), old, new)))
    return long.select("tbl", "fld", "rsn", items.alias("items"))


def split_packed(tables: dict[str, DataFrame], sources: list[PackedSource], min_score: float = 0.6) -> DataFrame:
    """One row per packed value: (tbl, fld, rsn, pos, item).

    pos counts all slots from 1, blank ones too; blank and ``\\N`` slots give no row. NULL, empty and ``\\N`` fields
    give no row, repeated values stay, other columns are ignored, an empty table gives no rows. See split_lists.
    """
    # an outer explode, as for an inner one the optimiser adds a filter that splits every field once more
    return (
        split_lists(tables, sources, min_score)
        .select("tbl", "fld", "rsn", F.posexplode_outer("items").alias("p", "item"))
        .where(F.col("item").isNotNull())
        .select("tbl", "fld", "rsn", (F.col("p") + 1).cast("int").alias("pos"), "item")
    )
