from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.functions import timing as ti
from talkmill.functions import urls as ur


def apply(spark, values, *columns, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in rows]


def test_strip_and_word_count_follow_str_methods(spark):
    values = ["", " ", " a　", "\x1c a\x1fb \n", "no", "\t\r\n\x0b\x0c x y\u0085", "a  b c"]
    got = apply(spark, values, tx.strip("s"), tx.word_count("s"))
    assert got == [(v.strip(), len(v.split())) for v in values]


def test_blank_class_holds_the_blanks_and_is_quick_to_test(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF] + ["\U0001f600"]
    got = apply(spark, chars, F.col("s").rlike(f"^[{tx.WS}]$"))
    assert {c for c, blank in zip(chars, got) if blank} == set(tx.WHITESPACE)
    # Java looks single characters below U+0100 up in one bit set, but asks a class or range by itself.
    below = tx.WS.split("[")[0]
    assert "-" not in below and r"\s" not in below
    # Words are counted without trimming the text.
    assert "trim" not in str(tx.word_count("s"))


def test_word_count_and_is_blank_at_the_ends(spark):
    blank = " " * 2 * tx.BLANK_CHARS
    values = ["", " ", "a", " a", "a ", " a b ", blank, blank + "a", "a" + blank, "\u3000", "\u3000\x1f" * 70 + "x y\x85"]
    got = apply(spark, values, tx.word_count("s"), tx.is_blank("s"))
    assert got == [(len(v.split()), not v.strip()) for v in values]
    assert apply(spark, [None], tx.word_count("s"), tx.is_blank("s")) == [(None, True)]


def test_snippet_cuts_before_it_trims(spark):
    value = "  " + "x" * 497 + "\ny" + "tail"
    assert apply(spark, [value], tx.snippet("s")) == [value[:500].strip().replace("\n", " ")]
    assert apply(spark, [value], tx.preview("s", 80)) == [value[:80].replace("\n", " ")]


def test_unfence_json(spark):
    fence = "```json\n{}\n```"
    cases = {
        fence.replace("{}", '{"transcription": "a\\nb", "x": 1}'): "a\nb",
        fence.replace("{}", '{"transcription": 5}'): "5",
        fence.replace("{}", '{"other": "x"}'): None,
        fence.replace("{}", '{"transcription": null}'): None,
        "```json\nno brace": None,
        "```json } {": None,
        fence.replace("{}", "{'transcription': 'x'}"): None,
        fence.replace("{}", '{"transcription": "a\nb"}'): None,
        fence.replace("{}", '{"transcription": "a"} {"b": 1}'): None,
        fence.replace("{}", '{"transcription": "a"}, {"b": 1}'): None,
        '{"transcription": "plain, no fence"}': None,
    }
    got = apply(spark, list(cases), tx.unfence_json("s"))
    assert got == [k if v is None else v for k, v in cases.items()]


def test_clean_chunk_text_makes_one_pass(spark):
    assert apply(spark, [" a   b\n\nc    d "], tx.clean_chunk_text("s")) == ["a  b c  d"]


def test_answer_format(spark):
    raw = "Intro - one • two\n\n\n3. three  [source](http://x) version 2. Next a-b"
    out = apply(spark, [raw], tx.format_answer(tx.strip_sources("s")))[0]
    assert out == "Intro\n• one\n• two\n3. three   version\n 2. Next a-b"


def test_source_labels(spark):
    df = spark.createDataFrame(
        [
            ("T", "u"), ("Unknown", "https://youtu.be/x?si=1"), ("", "https://www.youtube.com/watch?v=q1"),
            (None, "https://a.b/c/d?x"), (None, None), ("Unknown", ""),
        ],
        "t string, u string",
    )
    rows = df.select(tx.source_label("t", "u").alias("a"), tx.source_label("t", "u", True).alias("b")).collect()
    assert [r.a for r in rows] == [
        "T", "YouTube Video (x)", "YouTube Video (watch)", "Video (d?x)", "Unknown", "Unknown",
    ]
    assert rows[2].b == "YouTube Video (q1)"


def test_source_names_and_spans(spark):
    values = ["a.mp4 [120-180]", "b[x] [1-2]", "c.mp4", None, " [3-4]"]
    got = apply(spark, values, tx.source_name("s"), tx.span_start("s"), tx.span_end("s"))
    assert got == [("a.mp4", 120.0, 180.0), ("b", 1.0, 2.0), ("c.mp4", None, None), ("", None, None), ("", 3.0, 4.0)]


def test_mmss(spark):
    values = [0.0, 59.99, 60.0, 3599.5, 6000.0, 360000.0]
    got = apply(spark, values, tx.mmss("s"), schema="s double")
    assert got == ["00:00", "00:59", "01:00", "59:59", "100:00", "6000:00"]


def test_urls(spark):
    values = [
        "https://youtu.be/", "https://www.youtube.com/shorts/abc", "https://youtube.com/watch?x=1&v=a",
        "https://youtu.be/ab-_1?si=2", "https://www.loom.com/share/xyz/", "https://loom.com/one",
        "//user:pw@LOOM.com:80/a/b;p?x", "https://example.com/?next=loom.com", "nothing",
    ]
    got = apply(
        spark, values, ur.youtube_video_id("s"), ur.loom_video_id("s"), ur.route_source("s"),
        ur.is_youtube_host("s"), ur.is_loom_host("s"),
    )
    assert got == [
        (None, None, "youtube", True, False),
        (None, "abc", "youtube", True, False),
        (None, None, "youtube", True, False),
        ("ab-_1", None, "youtube", True, False),
        (None, "xyz", "loom", False, True),
        (None, None, "loom", False, True),
        (None, "b", "loom", False, True),
        (None, None, "loom", False, False),
        (None, None, "youtube", False, False),
    ]


def test_page_media(spark):
    values = [
        '"videoUrl":"/rel" "video_url":"https://v/1"',
        '"videoUrl":"/rel" "src":"b.mp4"',
        '"url":"http://u/1.mp4?x" "title":"A" <title>B</title>',
        "text https://x/y.mp4?z end <title>B</title>",
        "none",
    ]
    got = apply(spark, values, ur.page_media_url("s"), ur.page_title("s"))
    assert got == [
        ("https://v/1", None), ("b.mp4", None), ("http://u/1.mp4?x", "A"),
        ("https://x/y.mp4?z end <title>B</title>", "B"), (None, None),
    ]


def test_inline_timestamps(spark):
    values = [
        "[00:01] a b\n[00:05]\n[00:07] c [00:09] d\nplain\n[00:12] end of it \n",
        "[00:00:01] x\n[00:05] y",
        "[1] see ref",
        "[00:05] ",
        "[00:10] later\n[00:02] earlier\r\n",
        "no marks",
        None,
    ]
    got = apply(spark, values, ti.parse_inline_timestamps("s"))
    flat = [None if c is None else [(x.text, x.start, x.end) for x in c] for c in got]
    assert flat == [
        [("a b", 1.0, 5.0), ("[00:07] c [00:09] d", 5.0, 12.0), ("end of it", 12.0, 15.0)],
        [("x", 1.0, 4.0)],
        [("see ref", 1.0, 4.0)],
        [("", 5.0, 8.0)],
        [("later", 10.0, 2.0), ("earlier", 2.0, 5.0)],
        None,
        None,
    ]


def test_last_line_length_is_bounded(spark):
    values = ["[00:01] " + "x" * n for n in (10, 60, 150, 1000)]
    got = apply(spark, values, ti.parse_inline_timestamps("s"))
    assert [c[0].end for c in got] == [4.0, 5.0, 11.0, 21.0]


def test_segment_repair(spark):
    df = spark.createDataFrame(
        [([(" a b ", 1.0, 1.0), ("", 0.0, 1.0), ("w " * 9, 2.0, None), ("x", -5.0, -4.0), ("long", 1.0, 99.0)],)],
        f"s {ti.SEGMENTS_TYPE}",
    )
    fixed = df.select(ti.validate_segments(ti.fill_segment_end("s")).alias("v")).first().v
    assert [(x.text, x.start, x.end) for x in fixed] == [
        ("a b", 1.0, 2.0), ("w w w w w w w w w", 2.0, 6.5), ("x", 0.0, 0.5), ("long", 1.0, 31.0),
    ]


def test_clock(spark):
    values = ["01:02:03", "02:03", "75", "x", "٠١:٣٠", "𝟏𝟐"]
    assert apply(spark, values, ti.clock_to_seconds("s")) == [3723, 123, 75, None, 90, 12]
    lines = apply(spark, ["[٠١:٣٠] a"], ti.parse_inline_timestamps("s"))[0]
    assert [(x.text, x.start, x.end) for x in lines] == [("a", 90.0, 93.0)]


def test_vector_id_keeps_raw_values(spark):
    row = spark.range(1).select(
        ur.vector_id(F.lit("Acme Co"), F.lit("u"), F.lit(3)).alias("i"),
        ur.namespace_of(F.lit("Acme Co")).alias("n"),
    ).first()
    assert tuple(row) == ("Acme Co_u_3", "acme-co")


def test_dropped_lines_are_counted(spark):
    values = ["intro\n[00:01] a\nplain\n\n[00:00:09] b", "no marks\nat all", "[3] x", None]
    got = apply(spark, values, ti.dropped_lines("s"))
    assert got == [3, 0, 0, 0]
