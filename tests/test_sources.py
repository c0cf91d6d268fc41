import gzip

from tessera.sources.scannable import scannable
from tessera.sources.tables import footer_schema, read_table
from tessera.sources.tsv import TsvColumn, read_tsv


def test_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write('id\tname\tyear\tflag\tids\ttags\nnm001\tA "B"\t1990\t1\ttt1,tt02\ta,b\nnm2\t\\N\tx\t0\t\\N\t\\N\n')
    cols = [TsvColumn("id", "id"), TsvColumn("name"), TsvColumn("year", "int"), TsvColumn("flag", "flag"), TsvColumn("ids", "ids"), TsvColumn("tags", "strings")]
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "x.tsv.gz"), cols).collect()] == [(1, 'A "B"', 1990, True, [1, 2], ["a", "b"]), (2, None, None, False, None, None)]


def test_scannable(spark):
    df = scannable(spark, "tessera_test_source", "n long", [(0, 3), (3, 5)], lambda p: ((i,) for i in range(*p)))
    assert sorted(r.n for r in df.collect()) == [0, 1, 2, 3, 4] and df.rdd.getNumPartitions() == 2
    assert scannable(spark, "tessera_test_nothing", "n long", [], lambda p: iter(())).count() == 0


def test_table_schema(spark, tmp_path):
    df = spark.sql("SELECT 1 a, array('x') b, timestamp_ntz'2024-01-01' c, map('k', 1.5D) d")
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert [f.dataType for f in footer_schema(str(tmp_path / "t.parquet")).fields] == [f.dataType for f in df.schema.fields]
    assert read_table(spark, str(tmp_path), "t").collect() == df.collect()
    assert footer_schema("hdfs://nowhere/t.parquet") is None


def test_a_column_that_only_some_files_have(spark, tmp_path):
    spark.createDataFrame([(1,)], "a long").write.parquet(f"{tmp_path}/t.parquet")
    spark.createDataFrame([(2, "x")], "a long, b string").write.mode("append").parquet(f"{tmp_path}/t.parquet")
    got = sorted((r.a, r.b) for r in read_table(spark, str(tmp_path), "t").collect())
    assert got == [(1, None), (2, "x")]
