"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

import hashlib
import pickle

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import abuse, mixing, similar_sets
from tessera.llm.cooccurrence import pairs_together
from tessera.llm.tokenizer import encode_texts
from tessera.operators.packed import PackedSource, split_lists
from tessera.plans.cleaning import P1_SQL
from tessera.session import cut, remove_at_end, shared_dir
from tessera.sources.tables import read_table

SET_FIELDS = {"names_tsv": ("nconst", ["knownForTitles"]), "crew_tsv": ("tconst", ["directors", "writers"])}
GROUPS = [f for _, fields in SET_FIELDS.values() for f in fields]
SIMILAR, SMALLEST = 0.6, 3
TOGETHER, LIFT = 4, 10.0
SEED = 17
#: A document is abusive from this probability on.
ABUSIVE = 0.5


def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, id, items): the sets of numbers in the id fields; grp is the field's place in GROUPS."""
    tables = {t: read_table(spark, sf_dir, t) for t in SET_FIELDS}
    # the key takes the place of the row's number, as sets are made over all rows of an id
    lists = split_lists(tables, [PackedSource(t, f, key) for t, (key, fields) in SET_FIELDS.items() for f in fields])
    numbers = F.transform("items", lambda x: F.regexp_extract(x, r"([0-9]+)$", 1).try_cast("long"))
    grp = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("fld")).cast("int") - 1
    return similar_sets.sets_of_lists(lists.select(grp.alias("grp"), F.col("rsn").alias("id"), numbers.alias("items")), SMALLEST)


def field_of(grp: str) -> Column:
    return F.array(*map(F.lit, GROUPS))[F.col(grp)].alias("fld")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets.pairs_of_sets(id_sets(spark, sf_dir), SIMILAR).select(field_of("grp"), "id_a", "id_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id with a large enough set: its class (least id of the same set) and the class's links to others."""
    reps, members = similar_sets.classes(cut(id_sets(spark, sf_dir)))
    linked = similar_sets.similar_classes(reps, SIMILAR)
    ends = linked.select("grp", F.col("rep_a").alias("rep")).unionByName(linked.select("grp", F.col("rep_b").alias("rep")))
    links = ends.groupBy("grp", "rep").agg(F.count("*").alias("links"))
    who = reps.select("grp", "rep", F.col("rep").alias("id")).unionByName(members.where("rep <> id").select("grp", "rep", "id"))
    return who.join(links, ["grp", "rep"], "left").select(field_of("grp"), "id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_together(read_table(spark, sf_dir, "principals_tsv"), "tconst", "nconst", TOGETHER, LIFT)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(spark, sf_dir).select(F.col("item_a").alias("nconst_a"), F.col("item_b").alias("nconst_b"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(spark, sf_dir).select(
        F.col("item_a").alias("nconst_a"), F.col("item_b").alias("nconst_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction")
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drawn records and rates for a total of half the corpus's tokens."""
    sizes = mixing.sized(read_table(spark, sf_dir, "documents"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    rate = mixing.rates(sizes, read_table(spark, sf_dir, "mix_targets"), total // 2)
    return mixing.draw(sizes, rate, seed=SEED), rate


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p8_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mixing with characters as sizes, which SQL can count."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", mixing.source_key(F.col("source")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_tokens"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    rate = mixing.rates(sizes, read_table(spark, sf_dir, "mix_targets"), total // 2)
    out = mixing.shares(mixing.draw(sizes, rate, seed=SEED), rate)
    return out.select("source", "documents", F.round("rate", 9).alias("rate"), "records", "drawn_tokens", F.round("actual_share", 9).alias("actual_share"), "short")


def abuse_model(spark: SparkSession, sf_dir: str) -> abuse.Model:
    """The model of a directory's labels, fitted once and saved in the shared folder.

    The name of the saved model tells the directory, the sample's content and the version of the features, so that a
    change of any of them fits a new one.
    """
    sample = abuse.labelled_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_labels"))
    seen = sample.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text", "y").cast("decimal(38,0)"))).first()
    key = hashlib.sha256(repr((spark.sparkContext.applicationId, sf_dir, *seen, abuse.FEATURES)).encode()).hexdigest()[:32]
    saved = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-model-{key}")
    files = saved.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(saved):
        return pickle.loads(spark.read.format("binaryFile").load(str(saved)).first().content)
    model = abuse.fit(sample)
    out = files.create(saved, True)
    out.write(pickle.dumps(model))
    out.close()
    remove_at_end(spark, str(saved))
    return model


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_with(read_table(spark, sf_dir, "documents"), abuse_model(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= ABUSIVE).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates_by_source(p9_scores(spark, sf_dir), ABUSIVE)


def p9_rater_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of p9_rates over what the raters said instead of scores."""
    votes = read_table(spark, sf_dir, "doc_labels").groupBy("doc_id").agg(F.avg("abusive").alias("score"))
    rated = read_table(spark, sf_dir, "documents").select("doc_id", "source").join(votes, "doc_id").where("score is not null")
    out = abuse.rates_by_source(rated, ABUSIVE)
    return out.select("source", "documents", "abusive", F.round("rate", 9).alias("rate"), F.round("mean_score", 9).alias("mean_score"))


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p4_found, p4_scores, p7_ids, p8_mix, p8_shares, p8_by_chars, p9_found, p9_scores, p9_rates, p9_rater_rates)}

_SETS = rf"""
items AS (SELECT DISTINCT fld, id, TRY_CAST(regexp_extract(item, '([0-9]+)$', 1) AS BIGINT) item FROM (
  SELECT p.fld, n.nconst id, p.item FROM p JOIN names_tsv n USING (rsn) WHERE p.fld = 'knownForTitles'
  UNION ALL SELECT p.fld, c.tconst, p.item FROM p JOIN crew_tsv c USING (rsn) WHERE p.tbl = 'crew_tsv')
  WHERE id IS NOT NULL AND TRY_CAST(regexp_extract(item, '([0-9]+)$', 1) AS BIGINT) IS NOT NULL),
sizes AS (SELECT fld, id, count(*) n FROM items GROUP BY ALL HAVING n >= {SMALLEST}),
-- a pair of similarity t shares one of the n - ceil(t n) + 1 rarest values of either set
ranked AS (SELECT i.fld, i.id, i.item, s.n, row_number() OVER (PARTITION BY i.fld, i.id ORDER BY f.f, i.item) k
  FROM items i JOIN sizes s USING (fld, id) JOIN (SELECT fld, item, count(*) f FROM items GROUP BY ALL) f USING (fld, item)),
early AS (SELECT fld, id, item FROM ranked WHERE k <= n - ceil({SIMILAR} * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.fld, a.id id_a, b.id id_b FROM early a JOIN early b ON a.fld = b.fld AND a.item = b.item AND a.id < b.id),
shared AS (SELECT c.fld, c.id_a, c.id_b, count(*) s FROM cand c JOIN items a ON a.fld = c.fld AND a.id = c.id_a JOIN items b ON b.fld = c.fld AND b.id = c.id_b AND b.item = a.item GROUP BY ALL),
pairs AS (SELECT s.fld, s.id_a, s.id_b, s.s / (a.n + b.n - s.s) similarity FROM shared s JOIN sizes a ON a.fld = s.fld AND a.id = s.id_a JOIN sizes b ON b.fld = s.fld AND b.id = s.id_b
  WHERE s.s / (a.n + b.n - s.s) >= {SIMILAR} - 1e-12)"""
_PAIRS = f"""
d AS (SELECT DISTINCT tconst, nconst FROM principals_tsv WHERE tconst IS NOT NULL AND nconst IS NOT NULL),
n AS (SELECT count(DISTINCT tconst) n FROM d), c AS (SELECT nconst, count(*) c FROM d GROUP BY 1),
k AS (SELECT d.*, c.c FROM d JOIN c USING (nconst) WHERE c.c >= {TOGETHER}),
p AS (SELECT a.nconst nconst_a, b.nconst nconst_b, a.c n_a, b.c n_b, count(*) n_ab FROM k a JOIN k b ON a.tconst = b.tconst AND a.nconst < b.nconst GROUP BY ALL HAVING count(*) >= {TOGETHER}),
s AS (SELECT p.*, n.n FROM p, n WHERE p.n_ab::DOUBLE * n.n >= {LIFT} * p.n_a * p.n_b)"""
SQL = {
    "p3_found": f"WITH p AS ({P1_SQL}), {_SETS} SELECT fld, id_a, id_b FROM pairs",
    "p3_classes": f"""WITH p AS ({P1_SQL}), {_SETS},
one AS (SELECT fld, id, list(item ORDER BY item) items FROM items JOIN sizes USING (fld, id) GROUP BY ALL),
cls AS (SELECT fld, id, min(id) OVER (PARTITION BY fld, items) class_id FROM one),
link AS (SELECT x.fld, x.class_id, y.class_id other FROM (SELECT fld, id_a a, id_b b FROM pairs UNION ALL SELECT fld, id_b, id_a FROM pairs) q
  JOIN cls x ON x.fld = q.fld AND x.id = q.a JOIN cls y ON y.fld = q.fld AND y.id = q.b WHERE x.class_id <> y.class_id GROUP BY ALL)
SELECT c.fld, c.id, c.class_id, count(l.other) AS links FROM cls c LEFT JOIN link l USING (fld, class_id) GROUP BY ALL""",
    "p4_found": f"WITH {_PAIRS} SELECT nconst_a, nconst_b FROM s",
    "p4_scores": f"""WITH {_PAIRS} SELECT nconst_a, nconst_b, n_a, n_b, n_ab, round(n_ab * n::DOUBLE / (n_a * n_b), 6) AS lift,
CASE WHEN n_ab < n_a THEN round((1 - n_b / n::DOUBLE) / (1 - n_ab / n_a::DOUBLE), 6) END AS conviction FROM s""",
    "p8_by_chars": rf"""WITH d AS (SELECT doc_id, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) source, coalesce(n_chars, 0) n FROM documents),
h AS (SELECT source, count(*) documents, sum(n)::BIGINT tokens FROM d WHERE source IS NOT NULL GROUP BY 1),
w AS (SELECT lower(trim(source)) source, sum(target_share) share, min(max_repeats) cap FROM mix_targets GROUP BY 1),
t AS (SELECT (sum(n)::BIGINT // 2)::DOUBLE total FROM d),
r AS (SELECT w.source, coalesce(h.documents, 0) documents, coalesce(h.tokens, 0) tokens, w.share * t.total wanted,
  CASE WHEN coalesce(h.tokens, 0) > 0 THEN least(w.share * t.total / h.tokens, w.cap::DOUBLE) ELSE 0.0 END rate FROM w LEFT JOIN h USING (source) CROSS JOIN t),
c AS (SELECT d.source, d.n, floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT / 16::DOUBLE ** 13 < r.rate - floor(r.rate) THEN 1 ELSE 0 END k FROM d JOIN r USING (source)),
g AS (SELECT source, sum(k)::BIGINT records, sum(n * k)::BIGINT drawn FROM c WHERE k > 0 GROUP BY 1)
SELECT r.source, r.documents, round(r.rate, 9) AS rate, coalesce(g.records, 0) AS records, coalesce(g.drawn, 0) AS drawn_tokens,
  round(coalesce(g.drawn / (SELECT sum(drawn) FROM g), 0.0), 9) AS actual_share, r.rate * r.tokens < r.wanted * 0.999999 AS short FROM r LEFT JOIN g USING (source)""",
    "p9_rater_rates": rf"""WITH v AS (SELECT doc_id, avg(abusive) s FROM doc_labels GROUP BY 1 HAVING s IS NOT NULL)
SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, count(*) AS documents, sum((s >= {ABUSIVE})::INT)::BIGINT AS abusive,
  round(avg((s >= {ABUSIVE})::INT), 9) AS rate, round(avg(s), 9) AS mean_score FROM documents JOIN v USING (doc_id) GROUP BY 1""",
}
