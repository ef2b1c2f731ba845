import pyarrow as pa

from brookwatch.llm import common


def test_batches_to_python_are_small(spark):
    """One batch of a task holds a bounded share of its rows, whatever the session's size was; all rows arrive."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    df = spark.range(0, 5000, 1, 1)
    try:
        out = common.arrow_map(df, lambda c: {"id": c["id"]}, "id long")
        assert out.count() == 5000 and out.distinct().count() == 5000

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

        assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) <= 1024
        spark.conf.set(name, "100")
        common.arrow_map(df, lambda c: {"id": c["id"]}, "id long")
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.unset(name)
