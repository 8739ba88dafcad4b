import numpy as np
from pyspark.sql import functions as F

from talkmill.operators import answering as an
from talkmill.operators import reports as rp
from talkmill.operators import summaries as su
from talkmill.operators.model import hashing_embedder
from talkmill.plans import questions as pq
from talkmill.schemas import METADATA, QA_PAIRS

FIELDS = [f.split(":")[0] for f in METADATA[7:-1].split(",")]


def meta(**given):
    return tuple(given.get(f) for f in FIELDS)


def collected(spark, *questions):
    """questions: (id, reply, raw, [metadata])"""
    rows = [
        (i, "Acme", "why?", [(n + 1, f"c{n}", 1.0 - n / 10, m) for n, m in enumerate(chunks)] or None, reply, raw)
        for i, reply, raw, chunks in questions
    ]
    return spark.createDataFrame(
        rows,
        "question_id int, company_name string, question string, "
        f"chunks array<struct<rank:int,id:string,score:double,metadata:{METADATA}>>, "
        "rerank_reply string, raw_answer string",
    )


def registry(spark):
    return spark.createDataFrame(
        [("a.mp4", "https://reg/a"), ("b.mp4", "")], "video_name string, video_url string"
    )


def answer(spark, *questions, **options):
    rows = an.assemble_answers(collected(spark, *questions), registry(spark), **options).collect()
    return {r.question_id: r for r in rows}


def test_best_chunk_choice(spark):
    chunks = [meta(video_url=f"u{i}", start=10.0 * i, end=10.0 * i + 5, text="t") for i in range(1, 4)]
    replies = {1: "Chunk 3 is best", 2: "none", 3: "99", 4: "0", 5: "2 or 4", 6: None, 7: "9" * 30}
    out = answer(spark, *[(i, r, "fine", chunks) for i, r in replies.items()])
    assert [out[i].video_url for i in replies] == ["u3", "u1", "u1", "u1", "u2", "u1", "u1"]
    assert (out[1].start, out[1].end) == (29.7, 35.3)


def test_url_fallbacks(spark):
    cases = [
        meta(video_url="u", original_video_url="o", source="a.mp4"),
        meta(video_url="", original_video_url="o", source="a.mp4"),
        meta(source="a.mp4 [1-2]"),
        meta(source="a.mp4[x]"),
        meta(source="b.mp4 [1-2]"),
        meta(source="zzz.mp4"),
        meta(),
    ]
    out = answer(spark, *[(i, "1", "fine", [m]) for i, m in enumerate(cases)])
    assert [out[i].video_url for i in range(len(cases))] == [
        "u", "o", "https://reg/a", "https://reg/a", "b.mp4 [1-2]", "zzz.mp4", None,
    ]


def test_spans(spark):
    none, timed = meta(video_url="u"), meta(video_url="w", start=5.0, end=9.0)
    cases = {
        0: [none, timed, meta(video_url="u", start=0.0, end=20.0)],
        1: [none, none, none, timed],  # the fourth chunk is not looked at
        2: [meta(video_url="u", source="a.mp4 [120-180]")],
        3: [meta(video_url="u", start=0.1, end=0.2)],
        4: [meta(video_url="u", start=7.0, end=7.0)],
        5: [meta(video_url="u", start=0.0, end=3.0)],
    }
    out = answer(spark, *[(i, "1", "fine", c) for i, c in cases.items()])
    spans = [(round(out[i].start, 6), round(out[i].end, 6)) for i in cases]
    assert spans == [(0.0, 20.3), (0.0, 0.0), (119.7, 180.3), (0.0, 0.5), (7.0, 7.0), (0.0, 3.3)]
    same = answer(spark, (0, "1", "fine", [none, timed]), same_video_only=True)
    assert (same[0].start, same[0].end) == (0.0, 0.0)


def test_outcomes_without_a_location(spark):
    chunk = meta(video_url="https://youtu.be/x", title="T", start=1.0, end=2.0)
    out = answer(
        spark,
        (1, None, None, []),
        (2, "1", None, [chunk]),
        (3, "1", "Sorry, I COULDN'T find it. It does not contain information.", [chunk, chunk]),
    )
    assert out[1].answer == an.NOTHING_FOUND and out[1].sources == [] and out[1].error is None
    assert out[2].error == an.ANSWER_FAILED and out[2].answer is None and out[2].sources is None
    assert out[3].sources == ["T", "T"] and out[3].video_url is None and out[3].start is None


def test_ask_survives_failing_models(spark):
    def broken():
        def run(texts):
            raise RuntimeError("down")

        return run

    asked = spark.createDataFrame(
        [(1, "Acme Co", "red car"), (2, "Nobody", "red car")], "question_id long, company_name string, question string"
    )
    chunks = spark.createDataFrame(
        [("a", "a red car", 1.0, 2.0), ("b", "blue sky", 3.0, 4.0)], "id string, text string, start double, end double"
    )
    from talkmill.operators.model import embed

    stored = embed(chunks, "text", hashing_embedder(32), 32).select(
        F.lit("acme-co").alias("namespace"),
        "id",
        "embedding",
        F.expr(
            "struct("
            + ", ".join(
                f"cast({ {'text': 'text', 'start': 'start', 'end': 'end', 'video_url': 'id'}.get(n, 'null')} as {t}) as {n}"
                for n, t in (f.split(":") for f in METADATA[7:-1].split(","))
            )
            + ")"
        ).alias("metadata"),
    )
    embedder = hashing_embedder(32)
    ok = pq.ask(asked, stored, registry(spark), embedder, broken, lambda: (lambda ts: ["yes"] * len(ts)), 32)
    rows = {r.question_id: r for r in ok.collect()}
    assert rows[1].answer == "yes" and rows[1].video_url == "a" and rows[2].answer == an.NOTHING_FOUND
    bad = pq.ask(asked, stored, registry(spark), embedder, broken, broken, 32)
    rows = {r.question_id: r for r in bad.collect()}
    assert rows[1].error == an.ANSWER_FAILED and rows[2].error is None

    def touchy(refused, reply):
        def factory():
            def run(texts):
                if any(refused in t for t in texts):  # raises for null as well
                    raise RuntimeError("no")
                return [reply] * len(texts)

            return run

        return factory

    def picky_embedder():
        inner = embedder()

        def run(texts):
            if any("unreadable" in t for t in texts):
                raise RuntimeError("no")
            return inner(texts)

        return run

    asked = asked.union(
        spark.createDataFrame(
            [(3, "Acme Co", "unreadable"), (4, "Acme Co", "blue two"), (5, "Acme Co", "sky five"), (6, "Acme Co", None)], asked.schema
        )
    ).coalesce(1)
    mixed = pq.ask(
        asked, stored, registry(spark), picky_embedder, touchy("blue two", "Chunk 2"), touchy("sky five", "fine"), 32
    )
    rows = {r.question_id: r for r in mixed.collect()}
    assert (rows[1].answer, rows[1].error, rows[1].video_url) == ("fine", None, "b")
    assert (rows[2].answer, rows[2].error) == (an.NOTHING_FOUND, None)
    assert (rows[3].answer, rows[3].error) == (None, an.EMBEDDING_FAILED)
    assert (rows[4].answer, rows[4].error, rows[4].video_url) == ("fine", None, "b")  # first match: the blue one
    assert (rows[5].answer, rows[5].error) == (None, an.ANSWER_FAILED)
    assert rows[6].error == an.EMBEDDING_FAILED

    def longer():
        run = hashing_embedder(32)()
        return lambda texts: [np.append(v, np.float32(1)) if t == asks_longer else v for t, v in zip(texts, run(texts))]

    asks_longer = "blue two"
    rows = {r.question_id: r for r in pq.ask(asked, stored, registry(spark), longer, broken, lambda: (lambda ts: ["yes"] * len(ts)), 32).collect()}
    assert (rows[4].answer, rows[4].error) == (None, an.EMBEDDING_FAILED) and rows[1].answer == "yes"


def test_sessions(spark):
    rows = [
        (1, 0, "q0", "a0", "Bo", "Acme"), (1, 1500, "q1", "a1", "Bo", "Acme"),
        (1, 7, None, "a", "Bo", "Acme"), (2, 0, "q", "a", "", None),
    ]
    pairs = spark.createDataFrame(rows, QA_PAIRS)
    got = {r.session_id: r for r in pq.summary_prompts(pairs).collect()}
    assert got[1].qa_text == "Q: q0\nA: a0\n\nQ: q1\nA: a1" and got[1].qa_count == 2
    assert got[2].prompt.startswith(su.SUMMARY_SYSTEM + "\n\n")
    assert got[2].prompt.splitlines()[3:] == [
        "        ", "        Questions and Answers:", "        Q: q", "A: a", "        ",
        "        Company: Unknown", "        Buyer: Unknown", "        ", "        Summary:",
    ]
    assert su.quarantined_pairs(pairs).count() == 1

    def no_first():
        def run(prompts):
            if any("Q: q0" in p for p in prompts):
                raise RuntimeError("too long")
            return [" fine "] * len(prompts)

        return run

    rows = {r.session_id: r for r in pq.summarize(pairs.coalesce(1), no_first).collect()}
    assert (rows[1].success, rows[1].summary, rows[1].error) == (False, None, su.SUMMARY_FAILED + "RuntimeError: too long")
    assert (rows[2].success, rows[2].summary, rows[2].error) == (True, "fine", None)


def test_error_messages_and_failures(spark):
    rows = [
        ("u", "t", 2, 2), ("", "t", 2, 2), ("u", None, 0, 0), ("u", "", 0, 0), ("u", "t", 0, 0), ("u", "t", 2, 1),
    ]
    df = spark.createDataFrame(rows, "u string, t string, c int, v int")
    got = [r[0] for r in df.select(rp.failure_reason("u", "t", "c", "v")).collect()]
    assert got == [None, rp.URL_REQUIRED, rp.NO_TRANSCRIPT, rp.EMPTY_TRANSCRIPT, rp.NO_CHUNKS, rp.NO_EMBEDDINGS]
    errors = spark.createDataFrame([("x TIMEOUT",), ("timeout: API request failed",), ("odd",)], "e string")
    shown = [r[0] for r in errors.select(rp.classify_error("e")).collect()]
    assert shown == [rp.TIMEOUT_MESSAGE, rp.USER_MESSAGES[0][1], "odd"]


def test_one_row_for_each_session_whatever_its_pairs_hold(spark):
    rows = [
        (1, 0, "q0", "a0", None, ""), (1, 1, "q1", "a1", "Bea", "Acme"), (1, 2, "q2", "a2", "Other", None),
        (2, 0, "q", None, "Bob", "Corp"), (2, 1, None, "a", None, None),
        (None, 0, "q", "a", "", ""),
    ]
    fine = lambda: lambda prompts: ["ok"] * len(prompts)
    got = {r.session_id: r for r in pq.summarize(spark.createDataFrame(rows, QA_PAIRS), fine).collect()}
    assert len(got) == 3
    assert (got[1].success, got[1].buyer_name, got[1].company_name, got[1].qa_count) == (True, "Bea", "Acme", 3)
    assert (got[2].success, got[2].buyer_name, got[2].qa_count) == (False, "Bob", 0)
    assert got[2].error == su.SUMMARY_FAILED + su.NO_PAIRS
    assert got[None].success and got[None].company_name == ""


def test_repeated_names_and_questions_give_one_answer(spark):
    best = spark.createDataFrame([(1, {"source": "a.mp4"}), (2, {"source": "b"})], "question_id long, best map<string,string>")
    best = best.selectExpr("question_id", "named_struct('video_url', best['video_url'], 'original_video_url', '', 'source', best['source']) as best")
    names = spark.createDataFrame([("a.mp4", "u1"), ("a.mp4", "u2"), ("a.mp4", ""), ("a.mp4", None)], "video_name string, video_url string")
    assert sorted((r.question_id, r.resolved_url) for r in an.resolve_video_url(best, names).collect()) == [(1, "u2"), (2, "b")]
    asked = spark.createDataFrame([(1, "B", "x"), (1, "A", "y"), (2, "A", "z")], "question_id long, company_name string, question string")
    assert sorted(r.question for r in pq.unique_questions(asked).collect()) == ["y", "z"]
    assert [r.question for r in pq.repeated_questions(asked).collect()] == ["x"]
