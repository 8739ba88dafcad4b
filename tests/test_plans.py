"""Whole pipelines on hand-made videos, and the shape of plans that must hold at scale."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from talkmill import schemas
from talkmill.operators import chunking as ch
from talkmill.operators import store as st
from talkmill.operators.model import hashing_embedder
from talkmill.operators.segment_rows import chunk_rows
from talkmill.plans import ingest as ing

LOOM = "https://www.loom.com/share/a1"
TUBE = "https://youtu.be/x1"
FAKE = "https://other/?u=youtu.be/abc"


def run(spark, mode=ing.STANDARD, version=1, **options):
    requests = spark.createDataFrame(
        [(TUBE, "Acme"), (TUBE, "Acme"), (TUBE, "Beta"), (LOOM, "Acme"), ("https://loom.com/one", "Acme"),
         ("https://nowhere/z", "Acme"), (FAKE, "Acme"), ("", "Acme"), (None, "Acme")],
        "video_url string, company_name string",
    )
    model = spark.createDataFrame(
        [(TUBE, "m", "T", "[00:01] one two\n[00:04] three", "", "Unknown", "en", 5)],
        "video_url string, method string, title string, transcription string, summary string, "
        "duration string, language string, word_count int",
    )
    captions = spark.createDataFrame([], schemas.CAPTIONS)
    asr = spark.createDataFrame(
        [(LOOM, "hello you", None, [("hello", 0.0, 0.0), ("you", 31.0, 29.0)]), ("https://loom.com/one", "x", "en", [])],
        schemas.ASR_OUTPUT,
    )
    # Two pages, speech outputs and model rows of one video: one of each counts.
    page = '"videoUrl":"https://cdn/a.mp4" "title":"Demo"'
    pages = spark.createDataFrame([(1, LOOM, page), (2, LOOM, page), (3, None, page)], schemas.SHARE_PAGES)
    asr = asr.union(asr.limit(1))
    return ing.ingest(requests, model, captions, asr, pages, hashing_embedder(16), 16, mode, version=version, **options)


def outcome(report):
    return sorted(
        (r.video_url, r.company_name, r.success, r.chunks_created, r.vectors_stored, r.original_error)
        for r in report.collect()
    )


EXPECTED = [
    ("https://loom.com/one", "Acme", False, 0, 0, "Failed to extract transcription"),
    ("https://nowhere/z", "Acme", False, 0, 0, "Failed to extract transcription"),
    (FAKE, "Acme", False, 0, 0, "Failed to extract transcription"),
    (LOOM, "Acme", True, 1, 1, None),
    (TUBE, "Acme", True, 2, 2, None),
    (TUBE, "Acme", True, 2, 2, None),
    (TUBE, "Beta", True, 2, 2, None),
]


def test_ingest_reports_every_request(spark):
    out = run(spark)
    # The first speech segment starts at 0, so the time cap does not close its chunk.
    assert outcome(out.report) == EXPECTED
    assert sorted(r.reason for r in out.quarantine.collect()) == ["video_url is required"] * 2
    rows = {r.id: r for r in out.vectors.collect()}
    assert len(rows) == 5
    loom = rows[f"Acme_{LOOM}_0"].metadata
    assert (loom.text, loom.start, loom.end, loom.title, loom.source_type) == (
        "hello you", 0.0, 32.0, "Demo", "loom_video",
    )
    assert rows[f"Beta_{TUBE}_1"].namespace == "beta"


def test_a_request_that_names_its_page_gets_what_that_page_says(spark):
    pages = spark.createDataFrame(
        [(1, LOOM, '"title":"First"'), (2, LOOM, '"videoUrl":"https://cdn/b.mp4" "title":"Second"')], schemas.SHARE_PAGES
    )
    asked = pages.selectExpr("page_id", "url as video_url")
    by_page = {r.page_id: (r.title, r.media_url) for r in ing.video_info_defaults(asked, pages).collect()}
    assert by_page == {1: ("Loom Video - a1", LOOM), 2: ("Second", "https://cdn/b.mp4")}
    # Without the page, one page of the address counts.
    by_url = ing.video_info_defaults(asked.where("page_id = 2").select("video_url"), pages).collect()
    assert [(r.title, r.media_url) for r in by_url] == [("Loom Video - a1", LOOM)]


def test_fixed_mode_keeps_raw_times(spark):
    rows = {r.id: r.metadata for r in run(spark, ing.FIXED30).vectors.collect()}
    assert [(rows[f"Acme_{LOOM}_{i}"].start, rows[f"Acme_{LOOM}_{i}"].end) for i in (0, 1)] == [(0.0, 0.0), (31.0, 29.0)]


def test_model_runs_once_when_its_output_is_kept(spark, tmp_path):
    out = run(spark, embedded_path=str(tmp_path / "embedded"))
    assert outcome(out.report) == EXPECTED
    for df in (out.vectors, out.report):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan


def test_counts_need_no_model_when_nothing_is_kept(spark):
    report = run(spark).report
    assert "MapInArrow" not in report._jdf.queryExecution().toString()


def test_report_tells_oddities(spark, tmp_path):
    out = run(spark, embedded_path=str(tmp_path / "e"))
    rows = {(r.video_url, r.company_name): r for r in out.report.collect()}
    assert rows[LOOM, "Acme"].bad_spans == 0 and rows[LOOM, "Acme"].zero_vectors == 0
    assert rows[TUBE, "Acme"].dropped_lines == 0
    raw = run(spark, ing.FIXED30).report.where(F.col("video_url") == LOOM).first()
    assert raw.bad_spans == 1 and raw.zero_vectors is None


def test_links_of_one_video_can_be_made_one(spark):
    requests = spark.createDataFrame(
        [("https://youtu.be/abc", "A"), ("https://www.youtube.com/watch?v=abc", "A"), ("https://youtu.be/abc", "B")],
        "video_url string, company_name string",
    )
    got = {(r.video_url, r.company_name): r.chosen_url for r in ing.same_videos(requests).collect()}
    assert got["https://www.youtube.com/watch?v=abc", "A"] == got["https://youtu.be/abc", "A"]
    assert got["https://youtu.be/abc", "B"] == "https://youtu.be/abc"
    plain, one = run(spark), run(spark, canonical_ids=True)
    assert outcome(plain.report) == outcome(one.report)


def test_reingest_with_the_same_version_replaces(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        st.merge_vectors(spark, path, run(spark).vectors, str(tmp_path / "staging"), 2)
    assert st.read_vectors(spark, path).count() == 5


def test_folders_must_be_shared_on_a_cluster():
    from talkmill.session import scratch_dir

    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert scratch_dir(session("spark://host:7077", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert "talkmill-" in scratch_dir(session("local[4]", None), "x")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(session(master, None), "x")


def test_text_chunking_needs_no_shuffle_and_reads_two_columns(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(50).select("id", F.lit("a. b").alias("text"), F.lit(1).alias("other")).write.parquet(path)
    plan = ch.explode_chunks(spark.read.parquet(path), ch.chunk_text("text"), "id")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and "ReadSchema: struct<id:bigint,text:string>" in physical


def test_short_videos_skip_the_block_chain(spark):
    rows = spark.range(300).selectExpr(
        "id % 7 as video", "cast(id div 7 as int) as seg_idx", "'w' as text", "id * 1.0D as start", "id + 1.0D as end"
    )
    chunks = chunk_rows(rows, ["video"], 20)
    chunks.toArrow()
    final = chunks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "EmptyRelation" in final and "MapInPandas" not in final


def test_registered_search_and_ask_do_not_call_the_embedder_again(spark):
    """All that is left as a plan is the scan for matches and the two models that reply."""
    from talkmill.queries import QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("driver tables are not here")
    for key, left in (("q3_search", 1), ("q4_ask", 3)):
        physical = QUERIES[key](spark, data)._jdf.queryExecution().sparkPlan().toString()
        assert physical.count("MapInArrow") == left


@pytest.mark.parametrize("mode", [ing.STANDARD, ing.FIXED30])
def test_no_filter_of_an_ingest_cuts_texts(spark, mode):
    """What ``ingest`` embeds is cut where its chunks are made, and nowhere for a test of its size."""
    plan = run(spark, mode).chunks._jdf.queryExecution().optimizedPlan()

    def nodes(node):
        yield node
        children = node.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))

    filters = [n.simpleString(1_000_000) for n in nodes(plan) if n.nodeName() == "Filter"]
    assert filters and not any("aggregate(" in f for f in filters)
