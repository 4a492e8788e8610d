"""The near-duplicate stage row by row: repeated rows and ids, nulls, empty tables, extra columns."""

import collections

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text):
    return (i, text, "en", "s", len(text or ""))


def test_one_row_of_each_component_stays(spark):
    a = " ".join(f"word{i}" for i in range(60))
    near = a + " more"
    other = " ".join(f"other{i}" for i in range(50))
    third = " ".join(f"third{i}" for i in range(40))
    rows = [
        doc(5, a), doc(5, a), doc(9, near), doc(None, a),  # repeated rows of the smallest id, a near copy, a copy without an id
        doc(7, near), doc(7, other),  # two texts under one id: one is a near copy, the other stays
        doc(None, third), doc(None, third),  # copies without an id
        doc(11, None), doc(12, ""), doc(12, ""), doc(13, " \n"), doc(14, "short"), doc(15, "SHORT"),
    ]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS id", "2 AS component_id", "3 AS _copies").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == collections.Counter({(5, a): 1, (7, other): 1, (None, third): 1, (11, None): 1, (12, ""): 2, (13, " \n"): 1, (14, "short"): 1})


def test_an_empty_table_stays_empty(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], DOC), "").collect() == []


def test_workers_get_whole_texts_in_batches_bounded_by_bytes(spark):
    import pyarrow as pa

    from joblattice.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefghij', 1000) AS t")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        found = common.in_small_batches(texts).mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 3000 and max(r.bytes for r in found) < 1.1 * common.BATCH_BYTES
        spark.conf.set(name, "1m")  # a smaller bound stays
        common.in_small_batches(texts)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
    common.release()
