"""Rows that fail to parse: load valid lines as typed rows, set the others aside with the reason.

Lines are read permissively: each line is cut into fields as far as its own quoting allows, the fields are cast under
the feed's explicit schema with NULL where a cast fails, and a line that doesn't satisfy the schema keeps its raw text
in ``_corrupt``. Corrupt lines alone are then classified again by quoting, field count and value checks. Spark's own
CSV reader is not used for the cutting: it takes text after a closing quote and unbalanced quotes as valid, which the
stated format forbids. Everything is a narrow transformation of built-in functions; regular expressions use possessive
repetition throughout, so very long lines take linear time and constant stack.
"""

from __future__ import annotations

from dataclasses import dataclass, field as of
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
PLAIN = r'(?:[^\t"][^\t]*+)?+'
FIELD = f"(?:{QUOTED}|{PLAIN})"
#: A line, led by a tab, in which every quoted field ends before a tab or the line end.
WELL_QUOTED = rf"^(?:\t{FIELD}(?=\t|\z))*+\z"
JSON_STRING = r'"(?:[^"\\\x00-\x1F]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*+"'
JSON_WS = r"[ \t\n\r]*+"
JSON_STRINGS = rf"^{JSON_WS}\[{JSON_WS}(?:{JSON_STRING}{JSON_WS}(?:,{JSON_WS}{JSON_STRING}{JSON_WS})*+)?+\]{JSON_WS}\z"
NULL = "\\N"


@dataclass(frozen=True)
class Field:
    """A field of a feed: its name, Spark type, the check its text must pass, and its conversion."""

    name: str
    type: str = "string"
    check: str = "any"
    first: int = 0
    last: int = 0


@dataclass(frozen=True)
class Feed:
    name: str
    fields: tuple[Field, ...] = of(default_factory=tuple)


def _ok(f: Field, v: Column) -> Column:
    """Whether the text v is valid for the field."""
    null = v == NULL
    if f.check == "any":
        return F.lit(True)
    if f.check.startswith("id:"):
        return v.rlike(rf"^{f.check[3:]}[0-9]+\z")
    if f.check == "digits":
        return v.rlike(r"^[0-9]+\z")
    if f.check == "year":
        return null | (v.rlike(r"^[0-9]{4}\z") & v.try_cast("int").between(f.first, f.last))
    if f.check == "text":
        return ~null & (v != "") & ~v.rlike(r"[\x00-\x08\x0B-\x1F\x7F�]")
    if f.check == "flag":
        return v.isin("0", "1", NULL)
    if f.check == "json_strings":
        return null | v.rlike(JSON_STRINGS)
    raise ValueError(f"unknown check {f.check}")


def _typed(f: Field, v: Column) -> Column:
    """The value of the field, NULL where it is null or does not convert."""
    v = F.when(v != NULL, v)
    if f.check.startswith("id:"):
        return F.substring(v, len(f.check) - 2, 2**31 - 1).try_cast(f.type)
    if f.check == "flag":
        return F.when(v == "1", True).when(v == "0", False)
    return v if f.type == "string" else v.try_cast(f.type)


def read_lines(lines: DataFrame, feeds: list[Feed], line: str = "line", feed: str = "feed") -> DataFrame:
    """lines plus _fields (array of unquoted field texts, NULL if the quoting is broken) and _corrupt.

    _corrupt holds the raw text of a line that its feed's schema rejects, else NULL. A NULL line has no fields, and a
    line of an unknown or NULL feed has no schema: both are corrupt, with an empty text for the NULL line.
    """
    led = F.concat(F.lit("\t"), F.regexp_replace(F.col(line), r"\r\z", ""))
    # fields by their own quoting as far as it holds; they cover the line if and only if it is well quoted. Each of
    # these steps sits in an explode of one element, through which the optimiser does not push what follows, so that
    # a line is cut once and not once per check
    whole = lambda led: F.when(led.rlike(WELL_QUOTED), F.regexp_extract_all(led, F.lit(rf"\t({FIELD})"), F.lit(1)))
    unquote = lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    fields = F.transform(F.get(F.transform(F.array(led), whole), F.lit(0)), unquote)
    out = lines.select("*", F.explode(F.array(fields)).alias("_fields"))
    valid = F.lit(False)
    for f in feeds:
        right = reduce(lambda a, b: a & b, [_ok(x, F.get("_fields", F.lit(i))) for i, x in enumerate(f.fields)])
        valid = F.when(F.col(feed) == f.name, F.coalesce((F.size("_fields") == len(f.fields)) & right, F.lit(False))).otherwise(valid)
    return out.withColumn("_corrupt", F.when(~valid, F.coalesce(F.col(line), F.lit(""))))


def rejected(lines: DataFrame, feeds: list[Feed], line: str = "line", feed: str = "feed") -> DataFrame:
    """The corrupt lines with their reason, the first that holds of quoting, columns, values; all input columns stay.

    A NULL line and a line of an unknown feed have the reason columns: no number of fields is right for them.
    """
    read = read_lines(lines, feeds, line, feed).where(F.col("_corrupt").isNotNull())
    want = F.lit(None).cast("int")
    for f in feeds:
        want = F.when(F.col(feed) == f.name, len(f.fields)).otherwise(want)
    count = F.when(F.col(line).isNotNull(), F.size("_fields"))
    reason = F.when(F.col(line).isNotNull() & F.col("_fields").isNull(), "quoting").when(~count.eqNullSafe(want) | want.isNull(), "columns").otherwise("values")
    return read.withColumn("reason", reason).drop("_fields")


def loaded(lines: DataFrame, feeds: list[Feed], name: str, line: str = "line", feed: str = "feed", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The valid lines of one feed as typed rows; keep names input columns to carry along.

    Only this feed's lines are read and checked. A valid number that is too large for its type is NULL in its column and
    told in ``unfit`` as name=text (several joined by tabs), so no value is lost; unfit is NULL where all fit.
    """
    own = next(f for f in feeds if f.name == name)
    read = read_lines(lines.where(F.col(feed) == name), [own], line, feed).where(F.col("_corrupt").isNull())
    values = [(f, F.get("_fields", F.lit(i))) for i, f in enumerate(own.fields)]
    lost = [F.when((v != NULL) & _typed(f, v).isNull(), F.concat(F.lit(f"{f.name}="), v)) for f, v in values if f.type in ("int", "long")]
    unfit = F.nullif(F.array_join(F.array_compact(F.array(*lost)), "\t"), F.lit("")) if lost else F.lit(None).cast("string")
    return read.select(*keep, *[_typed(f, v).alias(f.name) for f, v in values], unfit.alias("unfit"))
