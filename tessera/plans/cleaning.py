"""Queries of the general data-cleaning operators over the catalogue tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.hotkeys import hot_keys, per_key
from tessera.operators.orphans import Parent, Reference, orphan_report, orphans
from tessera.operators.packed import PackedSource, split_packed
from tessera.operators.parsing import Feed, Field, loaded, rejected
from tessera.sources.tables import read_table

PACKED = [
    PackedSource("names_tsv", "primaryProfession"),
    PackedSource("names_tsv", "knownForTitles"),
    PackedSource("crew_tsv", "directors"),
    PackedSource("crew_tsv", "writers"),
]
HOT = {"principals_tsv": "tconst", "akas_tsv": "titleId", "episodes_tsv": "parentTconst"}
HOT_SHARE = 0.02
REFERENCES = [
    Reference("principals_tsv", "nconst", "names_tsv"),
    Reference("principals_tsv", "tconst", "titles_tsv"),
    Reference("episodes_tsv", "parentTconst", "titles_tsv"),
    Reference("akas_tsv", "titleId", "titles_tsv"),
]
PARENTS = [Parent("names_tsv", "nconst"), Parent("titles_tsv", "tconst")]
FEEDS = [
    Feed("names", (
        Field("nconst", "long", "id:nm"), Field("primaryName"), Field("birthYear", "int", "year", 1800, 2026),
        Field("deathYear", "int", "year", 1800, 2026), Field("primaryProfession"), Field("knownForTitles"))),
    Feed("akas", (
        Field("titleId", "long", "id:tt"), Field("ordering", "long", "digits"), Field("title", "string", "text"), Field("region"),
        Field("language"), Field("types"), Field("attributes"), Field("isOriginalTitle", "boolean", "flag"))),
    Feed("principals", (
        Field("tconst", "long", "id:tt"), Field("ordering", "long", "digits"), Field("nconst", "long", "id:nm"), Field("category"),
        Field("job"), Field("characters", "string", "json_strings"))),
]


def packed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, sf_dir, t) for t in dict.fromkeys(s.table for s in PACKED)}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(packed_tables(spark, sf_dir), PACKED)


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys({t: (read_table(spark, sf_dir, t), k, "rsn") for t, k in HOT.items()}, HOT_SHARE)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir).select("tbl", "hot_key")


def p2_per_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per title of principals: rows, persons' range and last arrival, without a hot title deciding the run time."""
    return per_key(read_table(spark, sf_dir, "principals_tsv"), ["tconst"], ["rsn"], {
        "n": ("count", F.lit(1)), "orderings": ("sum", "ordering"), "last_at": ("max", "loaded_at"), "least_nconst": ("min", "nconst"),
    })


def _referring(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, sf_dir, t) for t in sorted({r.table for r in REFERENCES} | {p.table for p in PARENTS})}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(_referring(spark, sf_dir), REFERENCES, PARENTS).select("tbl", "fld", "rsn")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_referring(spark, sf_dir), REFERENCES, PARENTS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(read_table(spark, sf_dir, "raw_lines"), FEEDS).select("line_id", "reason")


def p6_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(read_table(spark, sf_dir, "raw_lines"), FEEDS, "names")


def p6_akas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(read_table(spark, sf_dir, "raw_lines"), FEEDS, "akas")


def p6_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(read_table(spark, sf_dir, "raw_lines"), FEEDS, "principals")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_per_title, p5_found, p5_report, p6_found, p6_names, p6_akas, p6_principals)}

_P1_PARTS = " UNION ALL ".join(
    f"SELECT '{s.table}' tbl, '{s.field}' fld, rsn, {s.field} raw, {'false' if s.field == 'primaryProfession' else 'true'} blanks FROM {s.table}" for s in PACKED
)
#: Packed fields by the stated separators: blanks by chr(2), separators by chr(1), outside of double quotes only.
P1_SQL = rf"""
WITH f AS (SELECT tbl, fld, rsn, blanks, trim(raw, ' ') s FROM ({_P1_PARTS}) WHERE raw IS NOT NULL),
b AS (SELECT tbl, fld, rsn, blanks, CASE WHEN length(s) > 1 AND left(s, 1) || right(s, 1) IN ('[]', '()', '{{}}') THEN trim(s[2:-2], ' ') ELSE s END s FROM f),
m AS (SELECT tbl, fld, rsn, array_to_string(list_transform(string_split(s, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN
  translate(x, ',;|/，' || chr(9) || CASE WHEN blanks THEN ' ' ELSE '' END, repeat(chr(1), 6) || CASE WHEN blanks THEN chr(2) ELSE '' END) ELSE x END), '"') s FROM b),
n AS (SELECT tbl, fld, rsn, regexp_replace(trim(regexp_replace(s, '\x02*\x01\x02*', chr(1), 'g'), chr(2)), '\x02+', chr(1), 'g') s FROM m),
e AS (SELECT tbl, fld, rsn, unnest(range(1, len(l) + 1)) pos, unnest(l) x FROM (SELECT tbl, fld, rsn, string_split(s, chr(1)) l FROM n)),
i AS (SELECT tbl, fld, rsn, pos, trim(x, ' ') x FROM e),
q AS (SELECT tbl, fld, rsn, pos, CASE WHEN length(x) > 1 AND left(x, 1) = '"' AND right(x, 1) = '"' THEN replace(trim(x[2:-2], ' '), '""', '"')
  WHEN length(x) > 1 AND left(x, 1) = chr(39) AND right(x, 1) = chr(39) THEN trim(x[2:-2], ' ') ELSE x END item FROM i)
SELECT tbl, fld, rsn, pos::INTEGER AS pos, item FROM q WHERE item <> '' AND item <> '\N'
"""
P2_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, {k} AS hot_key FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM {t})" for t, k in HOT.items()
)
_PARENT_KEY = {p.table: p.key for p in PARENTS}
_P5_ROWS = " UNION ALL ".join(
    f"SELECT '{r.table}' AS tbl, '{r.field}' AS fld, c.rsn, c.loaded_at FROM {r.table} c WHERE c.{r.field} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {r.parent} p"
    f" WHERE p.{_PARENT_KEY[r.parent]} = c.{r.field} AND p.loaded_at <= c.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > c.loaded_at))"
    for r in REFERENCES
)

SQL = {
    "p1_found": P1_SQL,
    "p2_found": P2_SQL,
    "p2_per_title": "SELECT tconst, count(*) AS n, sum(ordering)::BIGINT AS orderings, max(loaded_at) AS last_at, min(nconst) AS least_nconst FROM principals_tsv GROUP BY tconst",
    "p5_found": f"SELECT tbl, fld, rsn FROM ({_P5_ROWS})",
    "p5_report": f"SELECT tbl, fld, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans FROM ({_P5_ROWS}) GROUP BY ALL",
}

_P6_FIELD = r'"(?:[^"]|"")*"|[^\t"][^\t]*|'
_P6_JSON = r'[ \t\n\r]*\[[ \t\n\r]*(?:"(?:[^"\\\x00-\x1F]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*"[ \t\n\r]*(?:,[ \t\n\r]*"(?:[^"\\\x00-\x1F]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*"[ \t\n\r]*)*)?\][ \t\n\r]*'
_P6_YEAR = r"(regexp_full_match(f[{0}], '\d{{4}}') AND TRY_CAST(f[{0}] AS INT) BETWEEN 1800 AND 2026 OR f[{0}] = '\N')"
_P6_READ = rf"""
l AS (SELECT line_id, feed, line, chr(9) || regexp_replace(line, '\r\z', '') t FROM raw_lines),
q AS (SELECT *, regexp_full_match(t, '(?:\t(?:{_P6_FIELD}))*') well FROM l),
f AS (SELECT *, list_transform(regexp_extract_all(t, '\t({_P6_FIELD})', 1), lambda x: CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) f FROM q),
r AS (SELECT *, CASE WHEN line IS NULL THEN 'columns' WHEN NOT well THEN 'quoting'
  WHEN len(f) IS DISTINCT FROM CASE feed WHEN 'akas' THEN 8 WHEN 'names' THEN 6 WHEN 'principals' THEN 6 END THEN 'columns'
  WHEN NOT CASE feed
    WHEN 'names' THEN regexp_full_match(f[1], 'nm[0-9]+') AND {_P6_YEAR.format(3)} AND {_P6_YEAR.format(4)}
    WHEN 'akas' THEN regexp_full_match(f[1], 'tt[0-9]+') AND regexp_full_match(f[2], '[0-9]+') AND f[3] NOT IN ('', '\N')
      AND NOT regexp_matches(f[3], '[\x00-\x08\x0B-\x1F\x7F\x{{FFFD}}]') AND f[8] IN ('0', '1', '\N')
    ELSE regexp_full_match(f[1], 'tt[0-9]+') AND regexp_full_match(f[2], '[0-9]+') AND regexp_full_match(f[3], 'nm[0-9]+')
      AND (f[6] = '\N' OR regexp_full_match(f[6], '{_P6_JSON}')) END THEN 'values' END reason FROM f)"""
_NUM = "TRY_CAST(substr(f[{}], 3) AS BIGINT) AS {}"
_STR = r"nullif(f[{}], '\N') AS {}"


def _unfit(*at: tuple[int, str, int]) -> str:
    """Valid numbers that are too large for their type, as name=text."""
    each = ", ".join(rf"CASE WHEN f[{i}] <> '\N' AND TRY_CAST(substr(f[{i}], {first}) AS BIGINT) IS NULL THEN '{name}=' || f[{i}] END" for i, name, first in at)
    return f"nullif(concat_ws(chr(9), {each}), '') AS unfit"


SQL |= {
    "p6_found": f"WITH {_P6_READ} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p6_names": f"WITH {_P6_READ} SELECT line_id, {_NUM.format(1, 'nconst')}, {_STR.format(2, 'primaryName')}, TRY_CAST(f[3] AS INT) AS birthYear, TRY_CAST(f[4] AS INT) AS deathYear, {_STR.format(5, 'primaryProfession')}, {_STR.format(6, 'knownForTitles')}, {_unfit((1, 'nconst', 3))} FROM r WHERE reason IS NULL AND feed = 'names'",
    "p6_akas": f"WITH {_P6_READ} SELECT line_id, {_NUM.format(1, 'titleId')}, TRY_CAST(f[2] AS BIGINT) AS ordering, {_STR.format(3, 'title')}, {_STR.format(4, 'region')}, {_STR.format(5, 'language')}, {_STR.format(6, 'types')}, {_STR.format(7, 'attributes')}, CASE f[8] WHEN '1' THEN true WHEN '0' THEN false END AS isOriginalTitle, {_unfit((1, 'titleId', 3), (2, 'ordering', 1))} FROM r WHERE reason IS NULL AND feed = 'akas'",
    "p6_principals": f"WITH {_P6_READ} SELECT line_id, {_NUM.format(1, 'tconst')}, TRY_CAST(f[2] AS BIGINT) AS ordering, {_NUM.format(3, 'nconst')}, {_STR.format(4, 'category')}, {_STR.format(5, 'job')}, {_STR.format(6, 'characters')}, {_unfit((1, 'tconst', 3), (2, 'ordering', 1), (3, 'nconst', 3))} FROM r WHERE reason IS NULL AND feed = 'principals'",
}
