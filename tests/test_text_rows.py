"""Windows of long texts cut in blocks, against the plain loop."""

import random
import time

import pytest

from talkmill.functions.text import WHITESPACE
from talkmill.operators import chunking as ch
from talkmill.operators import text_rows as tx


def plain(text, size, overlap):
    out, pos, n = [], 0, len(text)
    while pos < n:
        end = pos + size
        if end < n:
            for i in range(end, max(end - min(100, size), pos - 1), -1):
                if text[i] in ".!?":
                    end = i + 1
                    break
        said = text[pos:end].strip(WHITESPACE)
        if said:
            out.append(said)
        pos = end - overlap
    return out


def texts(seed):
    r = random.Random(seed)
    letters = ["a", "b", " ", " ", "é", "漢", "😀", ".", "!", "\n", "  \t "]
    sizes = [0, 1, 299, 300, 301, 700, 701, 1_400, 5_000, 9_000, 20_011]
    out = {i: "".join(r.choices(letters, weights=[5, 5, 3, 3, 1, 1, 1, 0.1, 0.05, 0.5, 0.5], k=n)) for i, n in enumerate(sizes)}
    return {**out, 90: " " * 4_000, 91: "x" * 4_000, 92: "x" * 2_000 + " " * 3_000 + "y.", 93: "a." * 3_000}


@pytest.mark.parametrize(("size", "overlap", "block"), [(300, 50, 300), (300, 150, 701), (120, 5, 1_024)])
def test_blocks_give_the_plain_windows(spark, monkeypatch, size, overlap, block):
    monkeypatch.setattr(tx, "GROUP_BLOCKS", 3)
    own = texts(size)
    df = spark.createDataFrame([*own.items(), (99, None)], "id long, text string")
    rows = tx.chunk_text_rows(df, "id", "text", size, overlap, long_text=350, block_chars=block).collect()
    got = {}
    for row in sorted(rows, key=lambda x: (x.id, x.chunk_index)):
        got.setdefault(row.id, []).append((row.chunk_index, row.text))
    assert got == {i: list(enumerate(c)) for i, t in own.items() if (c := plain(t, size, overlap))}


def test_arrays_and_blocks_agree(spark):
    own = texts(7)
    df = spark.createDataFrame(list(own.items()), "id long, text string")
    arrays = ch.explode_chunks(df, ch.chunk_text("text", 300, 50), "id").select("id", "chunk_index", "text")
    blocks = tx.chunk_text_rows(df, "id", "text", 300, 50, long_text=0, block_chars=512)
    assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, blocks.collect()))


def test_time_of_one_long_text_is_linear(spark):
    took = []
    for n in (1_000_000, 8_000_000):
        df = spark.createDataFrame([(1, "Some words of a talk. And more " * (n // 31))], "id long, text string")
        begin = time.time()
        rows = tx.chunk_text_rows(df, "id", long_text=1_000).count()
        took.append(time.time() - begin)
        assert rows > n / 1_000
    assert took[1] < 8 * took[0] + 10
    begin = time.time()
    df = spark.createDataFrame([(1, "Some words of a talk. And more " * 130_000)], "id long, text string")
    assert ch.explode_chunks(df, ch.chunk_text("text"), "id").count() > 4_000
    assert time.time() - begin < 60


def test_a_task_holds_the_tables_of_few_blocks():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"block": list(range(1_000))})
    parts = list(tx.in_parts(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == tx.GROUP_BLOCKS
    assert [b for p in parts for b in p.column(0).to_pylist()] == list(range(1_000))
