from folioscope.plans import catalog


def test_pages_of_long_documents(spark, tmp_path):
    lines = [f"line {i}" for i in range(2120)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sum(r.n_lines for r in run("page_lines")) == len(run("page_entries")) == 2120
    assert [(r.n_pages, r.n_chars) for r in run("page_probe")] == [(43, sum(map(len, lines)))]
    assert any("line 2119" in str(r) for r in run("page_text"))
