"""SimHash groups and benchmark overlaps against brute force."""

import itertools
import random

import numpy as np
import xxhash

import words
from talkmill.llm import components, decontaminate, simhash
from talkmill.llm.queries import QUERIES


def plain_fingerprint(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    n = max(1, len(own) - 2)
    shingles = [b" ".join(own[i : i + 3]) for i in range(n)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """``(doc_id, fingerprint, component)`` of every row, all pairs compared."""
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    of = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 and of[i] != of[j]:
            a, b = of[i], of[j]
            of = [a if x == b else x for x in of]
    out = []
    for i, (key, *_rest) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None]
        out.append((key, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def near_copies(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = words.vocabulary(8)
    rows = []
    for i in range(n):
        base = r.choices(vocabulary, k=r.randint(60, 400))
        rows.append((len(rows), " ".join(base), "en", "s"))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "s"))
    r.shuffle(rows)
    return rows


def test_groups_equal_all_pairs(spark):
    rows = near_copies()
    got = sorted((tuple(r) for r in simhash.near_duplicates(words.frame(spark, rows)).collect()), key=repr)
    assert got == plain_groups(rows)
    assert len({g for *_, g in got}) < len({f for _, f, _ in got}), "some links must join different fingerprints"


def test_groups_of_hostile_rows(spark):
    rows = words.hostile_rows()
    got = simhash.near_duplicates(words.clashing(words.frame(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(rows)
    assert simhash.near_duplicates(words.frame(spark, [])).collect() == []


def test_links_of_random_points_equal_all_pairs(spark):
    """Points around a few centres, at every distance up to 5, in both halves."""
    r = random.Random(5)
    points = set()
    for _ in range(40):
        centre = r.getrandbits(64)
        points.add(centre)
        for _ in range(12):
            flips = r.sample(range(64), r.randint(1, 5))
            points.add(centre ^ sum(1 << b for b in flips))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    for most in (3, 2, 0):
        expected = {
            (min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= most
        }
        got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most)
        assert {tuple(x) for x in got.collect()} == expected


def test_every_anchor_within_two_bits_is_given():
    r = np.random.default_rng(1)
    fps = r.integers(-(2**63), 2**63 - 1, 200)
    index, half, anchor, home = simhash.anchors_of(fps)
    assert not simhash.syndromes(anchor).any(), "anchors are code words"
    for i in range(len(fps)):
        for h in (0, 1):
            own = anchor[(index == i) & (half == h)]
            point = (int(fps[i]) >> 32 * h) & (1 << 31) - 1
            distance = [int(a ^ point).bit_count() for a in own]
            assert max(distance) <= 2 and len(set(own.tolist())) == len(own)
            near = [int(a ^ point).bit_count() for a in anchor[(index == i) & (half == h) & home]]
            assert len(near) == 1 and near[0] <= 1
            assert len(own) == (16 if near[0] else 1)


def test_one_row_of_each_group_stays(spark):
    rows = near_copies(30, 2)
    rows += [rows[0], rows[0], (rows[1][0], "quite another text under a known id", "en", "t")]
    docs = words.frame(spark, rows)
    kept = sorted(tuple(r) for r in simhash.keep_one(docs).collect())
    groups = {g for *_, g in plain_groups(rows)}
    assert {k for k, *_ in kept} == groups
    # ids occur once in a group here, but for the rows added above
    expected = {(k, f) for k, f, g in plain_groups(rows) if k == g}
    got = [(k, f"{plain_fingerprint(t):016x}") for k, t, *_ in kept]
    assert len(set(got)) == len(got) and set(got) == expected


def test_kept_rows_of_hostile_tables(spark):
    docs = words.clashing(words.frame(spark, words.hostile_rows()))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 2 and ids.count(None) == 2  # two texts under id 1; rows without an id stay
    assert simhash.keep_one(words.frame(spark, [])).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(9, 8), (8, 7), (7, 9), (3, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 500 for i in range(500, 540))
    assert (got[7], got[8], got[9]) == (7, 7, 7)


# --- benchmark overlaps ---


def plain_overlaps(docs, items):
    """Every diagonal of every document and item."""
    out = {}
    for key, text, *_ in docs:
        d = decontaminate.TOKEN.findall((text or "").lower())
        for item, other in items:
            b = decontaminate.TOKEN.findall((other or "").lower())
            if len(b) < decontaminate.LEAST_TOKENS:
                continue
            for shift in range(-len(d) + 1, len(b)):
                low = max(0, -shift)
                high = min(len(d), len(b) - shift)
                if high - low >= min(len(b), decontaminate.WINDOW):
                    same = np.array([d[j] == b[j + shift] for j in range(low, high)])
                    n = decontaminate.agreement(same, len(b))
                    if n:
                        out[key, item] = max(n, out.get((key, item), 0))
    return out


def leaks(seed=1):
    r = random.Random(seed)
    vocabulary = words.vocabulary(9, 400)
    items = [(i, words.text(r, vocabulary, r.choice([5, 8, 12, 13, 14, 30, 50]))) for i in range(30)]
    items += [(30, "too short"), (31, None), (32, ""), (3, items[3][1]), (33, items[4][1])]
    docs = []
    for i in range(120):
        own = r.choices(vocabulary, k=r.randint(0, 120))
        if i % 2:
            passage = items[r.randrange(30)][1].split()
            for _ in range(r.choice([0, 1, 2, 3, 6])):
                passage[r.randrange(len(passage))] = "zzz"
            if r.random() < 0.3:
                passage = passage[: r.randint(1, len(passage))]
            at = r.randint(0, len(own))
            own[at:at] = passage
        docs.append((i, " ".join(own).capitalize() + ".", "en", "s"))
    return docs, items


def test_overlaps_equal_all_diagonals(spark):
    docs, items = leaks()
    got = decontaminate.overlaps(words.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in got.collect()} == plain_overlaps(docs, items)


def test_masks_survive_any_two_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.MISMATCHES):
        assert any(
            all(o + p not in gone for p in mask)
            for mask in decontaminate.MASKS
            for o in range(decontaminate.WINDOW - mask[-1])
        ), gone


def test_clean_keeps_what_is_clean(spark):
    docs, items = leaks(2)
    bad = {d for d, _ in plain_overlaps(docs, items)}
    frame = words.clashing(words.frame(spark, docs))
    kept = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in docs} - bad


def test_overlaps_of_hostile_rows(spark):
    rows = words.hostile_rows()
    items = spark.createDataFrame(
        [(1, "plain words of one text here"), (None, "a text without an id of any kind"), (3, None)], "item_id long, text string"
    )
    docs = words.clashing(words.frame(spark, rows))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 1), (None, None)}
    kept = decontaminate.clean(docs, items).collect()
    assert len(kept) == len(rows) - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, none).collect() == []
    assert decontaminate.clean(words.frame(spark, []), items).collect() == []


def test_leak_deep_inside_a_long_text(spark):
    docs, items = leaks(3)
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    passage = next(t for _, t in items if t and len(t.split()) == 30)
    frame = words.frame(spark, [(1, f"{long} {passage} {long}", "", ""), (2, long, "", "")])
    got = decontaminate.overlaps(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1}


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(docs)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    verbatim = {(d, i) for d, t in docs for i, b in items if t and b and b in t}
    assert verbatim <= found
