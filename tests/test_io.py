"""Sources, sinks, streaming and the registry."""

import struct

from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import matchstats, symbols
from corpusloom.plans import registry
from corpusloom.sources import collections as src
from corpusloom.sources import library
from corpusloom.streaming.matching import stream_matches


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "ref").write_text("ACGT$\n")
    (tmp_path / "one").write_text("AC%GG\nT%\n")
    (tmp_path / "two").write_text("TT%")
    (tmp_path / "list").write_text(f"{tmp_path}/ref\n{tmp_path}/one\n{tmp_path}/two\n")
    reference, docs = src.read_collections(spark, str(tmp_path / "list"))
    assert reference.first().text == "ACGT"
    assert [tuple(r) for r in docs.orderBy("doc_id").collect()] == [(1, "AC"), (2, "GG\nT"), (3, "TT")]
    src.write_reference(symbols.augmented(reference, docs), str(tmp_path / "aug"))
    assert src.reference_file(spark, str(tmp_path / "aug")).first().text == "ACGT\n"
    (tmp_path / "sa").write_bytes(struct.pack("<4i", 3, 0, 258, 1))
    assert [r.pos for r in src.suffix_array_file(spark, str(tmp_path / "sa")).orderBy("rank").collect()] == [3, 0, 258, 1]
    phrases = spark.createDataFrame([(2, 5, 1), (0, 7, 3), (1, 1, 1)], "order_no long, pos long, len long")
    src.write_phrases(phrases, str(tmp_path / "phrases"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "phrases")).collect()) == ["1 1", "5 1", "7 3"]
    src.write_series(phrases, str(tmp_path / "series"))
    assert spark.read.csv(str(tmp_path / "series"), header=True).count() == 3
    src.write_index(phrases, str(tmp_path / "index"), ["order_no"])
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ACGTT"), (2, "GGA"), (3, "TACG")], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    reference = spark.createDataFrame([(0, "ACGTACGGT$")], "ref_id long, text string")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    library.build(reference, str(tmp_path / "index"))
    stream_matches(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = matchstats.matching_statistics(docs, reference)
    assert sorted(map(tuple, got.select("doc_id", "idx", "pos", "len", "smaller").collect())) == sorted(map(tuple, want.collect()))


def test_registry_is_consistent(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) == set(registry.ORACLES)
    for name in ("floor_log2", "gsa_bucketed"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_run_lengths_need_no_shuffle_of_symbols(spark):
    docs = spark.createDataFrame([(1, "aab🎉🎉🎉"), (2, None), (3, "b" * 40_000)], "doc_id long, text string")
    assert {r.sym: r.max_run for r in symbols.max_runs(docs).collect()} == {"a": 2, "b": 40_000, "🎉": 3}
    plan = symbols.max_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where(F.col("doc_id") > 5)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
