from brookwatch.llm.queries import op2_span_dedup


def test_op2_removes_repeats_within_a_document(spark, tmp_path):
    """A passage of 60 words that stands twice in one document stays once; one that another document repeats stays in the first."""
    twice = " ".join(f"w{i}" for i in range(59)) + " end. "
    other = " ".join(f"v{i}" for i in range(59)) + " end. "
    rows = [(1, twice + "Something between them. " + twice + "Tail."), (2, other + "Alone."), (3, "Before it. " + other), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in op2_span_dedup(spark, str(tmp_path)).collect()}
    assert got[1].count("w30 ") == 1 and got[1].startswith(twice) and got[1].endswith("Something between them. Tail.")
    assert got[2] == rows[1][1] and got[3] == "Before it. " and got[4] == ""
