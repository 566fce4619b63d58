from pyspark.sql import functions as F

from tracewell.llm import support


def test_hot_keys_join_like_others(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 200).cast("long").alias("k"), F.lit("a").alias("l"), F.col("id"))
    one = rows.groupBy("k", "l").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("k != 9")
    want = sorted(map(tuple, rows.join(one, ["k", "l"]).collect()))
    for hot in (1, 2, 1000):
        monkeypatch.setattr(support, "HOT_KEYS", hot)
        assert sorted(map(tuple, support.join_hot(rows, one, ["k", "l"], "n", 3000).collect())) == want


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 1_600_000, 3_600_000, 9_500_000, 5, 0)] + ["b" * 30_000] * 900
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"])
    found = list(support.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 256))
    assert [i for b in found for i in b.column("i").to_pylist()] == [*range(len(texts)), 3, 4]
    assert all(b.num_rows <= 256 and (b.num_rows == 1 or b.nbytes <= support.SLICE_BYTES) for b in found)
