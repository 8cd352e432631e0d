from corpusloom.sources import parsers, tables


def test_parsers_take_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        pages = spark.createDataFrame([(k, "<h1>a</h1><p>b</p>" * k) for k in range(3)], "page_id int, html string")
        got = {r.page_id: len(r.blocks) for r in parsers.parsed(pages, "html", "html").collect()}
        assert got == {0: 0, 1: 2, 2: 4}
        assert int(spark.conf.get(name)) == tables.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
