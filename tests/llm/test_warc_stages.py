import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quizlake.llm import stages, warc
from quizlake.llm.common import scratch
from quizlake.llm.queries import QUERIES
from tests_llm_data import documents, labels


def test_warc_round_trip(spark):
    big = "<p>Straße</p>" * 200
    pages = [(i, f"http://a.example/{i}?q=ä b\r\nX: y", big if i % 3 == 0 else f"page {i} " * i, "x") for i in range(60)]
    pages += [(100, None, None, "x"), (101, "u", "", "x"), (None, "u", big, "x"), (102, "u", "short", "x"), (103, "u", "short", "x")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, bundle string").repartition(3)
    path = scratch(spark, "warc")
    index = warc.write_bundles(warc.record_types(df), path, frame_bytes=4000, bundle_bytes=3000)
    index.write.parquet(f"{path}-index")
    got = {r.page_id: r for r in warc.read_bundles(spark, path).collect()}
    assert len(got) == len(pages)
    for page, _, html, _ in pages:
        data = (html or "").encode()
        again = page != 57 and html == big
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 57) if again else ("response", None))
        assert r.html == (None if again else html or "")
    bundles = {r.path.split("/")[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    entries = spark.read.parquet(f"{path}-index").collect()
    assert len(bundles) > 1 and max(e.frame for e in entries) > 0
    for e in entries:
        record = warc.fetch(bundles[e.bundle], e.frame, e.offset, e.length)
        (_, headers, _), = warc.parse_records(record)
        assert headers.get("X-Page-Id") == (None if e.page_id is None else str(e.page_id))


def test_warc_of_no_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_bundles(warc.record_types(df), scratch(spark, "warc")).count() == 0


def test_query_of_no_pages_and_of_repeated_ids(spark, tmp_path):
    schema = "page_id bigint, url string, html string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert QUERIES["op8_warc"](spark, f"{tmp_path}/none").count() == 0
    big = "x" * 1500
    rows = [(7, "a", big), (7, "b", big), (7, "c", "other"), (3, "d", big), (None, "e", big), (None, "f", "small")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/pages.parquet")
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1) for r in QUERIES["op8_warc"](spark, f"{tmp_path}/some").collect())
    assert got == [(-1, 5, "response", -1), (-1, 1500, "revisit", 7), (3, 1500, "revisit", 7), (7, 5, "response", -1),
                   (7, 1500, "response", -1), (7, 1500, "response", -1)]


def test_stages(spark, tmp_path):
    docs, marks = documents(), labels()
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, `a b` int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept, by = df, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        by[name] = kept.collect()
        if name != "packing":
            assert kept.schema == df.schema
    ids = {n: {r.doc_id for r in rows} for n, rows in by.items()}
    assert ids["language"] == {d[0] for d in docs} - {900, 901, 902}
    gone = {d[0] for d in docs if d[1] and "filthy" in d[1]}
    assert ids["toxicity"] == ids["language"] - gone
    assert ids["near_texts"] == ids["toxicity"] - {801, 802}
    assert ids["long_repeats"] == ids["near_texts"] == ids["packing"]
    text = {r.doc_id: r for r in by["long_repeats"]}
    assert "passage" not in text[810].text and text[810].n_chars == len(text[810].text)
    assert text[5].text == docs[5][1]
    places = sorted((r.sequence_id, r.offset, r.length) for r in by["packing"])
    assert len({p[:2] for p in places}) == len(places)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.ids_crc32 for r in ran.collect()) == sorted(r.ids_crc32 for r in by["packing"])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_of_no_documents(spark, tmp_path, stage):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert stage(spark, df, str(tmp_path)).count() == 0


def test_near_stage_keeps_rows_without_id(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id bigint, text string")
    got = [r.doc_id for r in stages.one_of_near_texts(spark, df, str(tmp_path)).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert got == [1, None]


def test_language_stage_keeps_texts_too_short_to_tell(spark, tmp_path):
    rows = [(i, "the people with their other words " * 5, "en") for i in range(60)]
    rows += [(100, "A.", "en"), (101, "Re.", "en"), (102, "De", None), (103, "zyxwvut", "en"), (104, "12 --", "en"), (105, None, "en")]
    rows += [(106, "zyxwvut qponmlk jihgfed " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id for r in stages.by_language(spark, df, str(tmp_path)).collect()}
    assert got == {*range(60), 100, 101, 102, 103}
