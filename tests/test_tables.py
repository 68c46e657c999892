"""Tables that end a lineage: where they lie, and how they go."""
from pyspark.sql import functions as F

from lanewise import tables
from lanewise.operators import graphs


def test_tables_go(spark, tmp_path):
    tables.clear(spark)
    kept, gone = (tables.written(spark.range(5), n) for n in ("a", "b"))
    tables.dropped(gone)
    assert kept.count() == 5
    with tables.work_folder(f"file://{tmp_path}/own"):
        pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
        assert {(r.node, r.cluster) for r in graphs.clusters(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    left = [p.name for p in (tmp_path / "own").iterdir() if not p.name.startswith(".")]
    assert [n.split("-")[1] for n in left] == ["labels"]  # what the result reads
    assert tables.clear(spark) == 2 and tables.clear(spark) == 0
    assert not [p for p in (tmp_path / "own").iterdir() if not p.name.startswith(".")]
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_table_reads_as_it_was_written(spark):
    df = spark.range(3).withColumns({"n": F.lit(None).cast("string"), "m": F.create_map(F.lit("a"), F.col("id")), "a": F.array(F.struct(F.col("id").alias("x")))})
    got = tables.written(df, "types")
    assert got.schema.simpleString() == df.schema.simpleString() and got.orderBy("id").collect() == df.collect()
    tables.clear(spark)
