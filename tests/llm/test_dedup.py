"""Exact dedup and n-gram Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from polylogue.llm import chunk_dedup as C
from polylogue.llm import jaccard_join as J
from polylogue.llm.common import components, shingle_sets


def brute_groups(rows):
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    return sorted((d, max(x for x in by[t or ""] if x is not None), len(by[t or ""]), d == max(by[t or ""])) for d, t in rows)


def test_exact_duplicates(frame, prose):
    long = prose(60_000, 1)
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long + "."), (8, "." + long), (9, "A"), (10, " a"), (11, "日本" * 9000), (12, "日本" * 9000)]
    got = C.exact_duplicates(frame(rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute_groups(rows)
    assert all(r["text_sha256"] == hashlib.sha256((dict(rows)[r["doc_id"]] or "").encode()).hexdigest() for r in got)


def test_exact_duplicates_of_a_hot_text(frame):
    rows = [(i, "the same text" if i % 3 else f"other {i}") for i in range(900)]
    got = C.exact_duplicates(frame(rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute_groups(rows)


def test_colliding_chunk_hashes_are_told_apart(frame, prose, monkeypatch):
    rows = [(i, prose(900, i % 5)) for i in range(12)]
    want = brute_groups(rows)
    real = C.span_hashes
    monkeypatch.setattr(C, "span_hashes", lambda *a: real(*a) & np.uint64(1))
    got = C.exact_duplicates(frame(rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want


def test_exact_edge_cases(spark, frame):
    assert C.exact_duplicates(frame([])).count() == 0
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in C.exact_duplicates(frame([(None, "x"), (1, "x"), (1, "x"), (None, "y")])).collect()}
    assert got == {(None, 1, 3, False), (1, 1, 3, True), (None, None, 1, True)}


def test_cut_points_depend_on_the_row_alone(prose):
    texts = [prose(5000, i).encode() for i in range(3)]
    joined, offs = b"".join(texts), np.cumsum([0, *map(len, texts)])
    bounds, per = C.cut_points(np.frombuffer(joined, np.uint8), offs)
    at = 0
    for i, t in enumerate(texts):
        alone, n = C.cut_points(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert n[0] == per[i] and (alone[1:] + offs[i] == bounds[at + 1:at + 1 + per[i]]).all()
        assert (np.diff(alone) <= C.CHUNK_MAX).all()
        at += per[i]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows(prose):
    rows, at = [], 0
    for i in range(12):
        base = prose(40 + 30 * i, i)
        for j in range(6):
            rows.append((at := at + 1, edited(base, j, 100 * i + j)))
    shared = prose(60, 99)
    rows += [((at := at + 1), prose(30 + 3 * i, 500 + i) + " " + shared) for i in range(40)]
    rows += [(at + 1, None), (at + 2, ""), (at + 3, " \n\t"), (at + 4, "one two"), (at + 5, "ONE  two"), (at + 6, "two one"), (at + 7, "é Ä b"), (at + 8, "É Ä b")]
    return rows


@pytest.mark.parametrize(("hot", "heavy", "block"), [(1 / 2000, 8, 10**6), (0.02, 8, 10**6), (1.0, 0.4, 10**6), (1.0, 0.4, 15)])
def test_components_equal_brute_force(frame, prose, monkeypatch, hot, heavy, block):
    rows = near_rows(prose)
    monkeypatch.setattr(J, "HEAVY", heavy)
    monkeypatch.setattr(J, "BLOCK_BYTES", 600 * block)
    monkeypatch.setattr(J.frequent_shingles, "__defaults__", (hot,))
    got = J.jaccard_components(frame(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_more_ids_than_are_broadcast(frame, prose, monkeypatch):
    rows = near_rows(prose)
    monkeypatch.setattr(J, "IDS_MAX", 3)
    got = J.jaccard_components(frame(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_links_at_the_threshold(frame):
    """Chains a - b - c in which a and c are too far apart, and unions of exactly 3/4."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:104])), (2, " ".join(w[:104] + w[150:183])), (3, " ".join(w[10:104] + w[150:183])), (4, " ".join(w[:79])), (5, " ".join(w[:78]))]
    got = J.jaccard_components(frame(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_jaccard_edge_cases(frame, prose):
    assert J.jaccard_components(frame([])).count() == 0
    long = prose(150_000, 3)
    rows = [(5, long), (2, edited(long, 50, 1)), (9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in J.jaccard_components(frame(rows)).select("doc_id", "component_id").fillna(0, ["component_id"]).collect())
    assert got == [(0, 0), (0, 9), (2, 2), (5, 2), (9, 9), (9, 9)]


def test_bitmap_bound_is_never_below_the_overlap(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for _ in range(60):
        pool = [rng.getrandbits(64) for _ in range(400)]
        a, b = set(rng.sample(pool, rng.randint(1, 300))), set(rng.sample(pool, rng.randint(1, 300)))
        maps = [J._bitmap(np.array(sorted(x), np.uint64)).tolist() for x in (a, b)]
        rows.append(((len(a), maps[0]), (len(b), maps[1]), len(a & b)))
    kind = "struct<n:long,bitmap:array<long>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, k long")
    assert df.where(J._bitmap_bound() < F.col("k")).count() == 0


def test_shingles_do_not_cross_rows():
    texts = ["a b c", "d e f g h", "", "i"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *map(len, texts)])
    row, h = shingle_sets(np.frombuffer(data, np.uint8), offs)
    assert row.tolist() == [0, 1, 3]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(spark, links).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, 100: 100, 101: 100}


@pytest.mark.parametrize("at_once", [0, 3, 10**6])
def test_links_in_rounds_equal_all_at_once(spark, monkeypatch, at_once):
    """Random possible links between components, some of which hold."""
    from polylogue.llm.common import Scratch

    rng = random.Random(41)
    base = [rng.getrandbits(40) for _ in range(400)]
    sets = {i: sorted({*rng.sample(base[40 * (i // 8):40 * (i // 8) + 40], 34 + i % 3)}) for i in range(64)}
    pairs = [(a, b, a, b, rng.randrange(4)) for a in sets for b in sets if a < b and (a // 8 == b // 8 or rng.random() < 0.05)]
    monkeypatch.setattr(J, "AT_ONCE", at_once)
    got = J._linked(spark.createDataFrame(pairs, "a long, b long, la long, lb long, k long"), spark.createDataFrame(list(sets.items()), "doc_id long, shingles array<long>"), Scratch(spark))
    label = {r["id"]: r["label"] for r in got.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, *_ in pairs:
        k = len(set(sets[a]) & set(sets[b]))
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {i: label.get(i, i) for i in sets} == {i: root(i) for i in sets} and len(set(map(root, sets))) < 40
    assert J._linked(spark.createDataFrame([], "a long, b long, la long, lb long, k long"), spark.createDataFrame([], "doc_id long, shingles array<long>"), Scratch(spark)).count() == 0


def test_pairs_grow_with_the_copies_and_not_with_their_square(spark, prose):
    """5,000 near copies and two other sets in one bucket: the sets that look for others are two."""
    n = 5000
    rows = [(7, i, 100, 16, 1, 30, 1) for i in range(1, n + 1)] + [(7, 20_000, 100, 16, 20_000, 30, 1), (7, 20_001, 101, 16, 20_001, 30, 1)]
    mixed = spark.createDataFrame(rows, "token long, doc_id long, n long, band int, label long, h long, top long")
    plan = J._meeting(mixed)
    pairs = plan.collect()
    assert len(pairs) == 2 * n + 1 and {(r["la"], r["lb"]) for r in pairs} == {(1, 20_000), (1, 20_001), (20_000, 20_001)}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in text
    own, met = n + 2, 3 * 2  # rows that are met, and looking rows in three tiles each
    assert mixed.where("label <> top").count() * 3 == met and own * 2 < 4 * n


def test_links_of_a_block_grow_with_its_sets_and_not_with_their_pairs(spark):
    """400 near copies, each a component of its own, whose pairs lie about the threshold: a task returns a tree, and loses no link."""
    rng = random.Random(8)
    pools = [[rng.getrandbits(64) for _ in range(40)] for _ in range(2)]
    sets = {i: np.array(sorted(rng.sample(pools[i % 2], 33 + i % 3)), np.uint64) for i in range(1, 401)}
    lists = {i: x.view(np.int64).tolist() for i, x in sets.items()}
    rows = [(i, len(x), i, i > 3, x, J._bitmap(sets[i]).tolist(), x) for i, x in lists.items()]
    heavy = spark.createDataFrame(rows, "doc_id long, n long, label long, minor boolean, tokens array<long>, bitmap array<long>, shingles array<long>").repartition(2)
    links = [(r["a"], r["b"]) for r in J._linked_block(heavy, heavy.where("minor")).collect()]
    assert len(set(links)) <= 2 * (len(sets) - 1)  # the pairs that the bound leaves are tens of thousands

    def near(a, b):
        k = len({*lists[a]} & {*lists[b]})
        return 100 * k >= 75 * (len(lists[a]) + len(lists[b]) - k)

    def parts(pairs):
        label = {i: i for i in sets}
        for a, b in pairs:
            label = {i: min(label[a], label[b]) if x in (label[a], label[b]) else x for i, x in label.items()}
        return label

    assert all(near(a, b) for a, b in links)
    every = [(a, b) for a in sets for b in sets if a < b and b > 3 and near(a, b)]
    assert len(every) > 5000
    root = list(range(401))
    for a, b in every:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(i):
        return i if root[i] == i else top(root[i])

    assert parts(links) == {i: top(i) for i in sets}


def test_texts_under_one_id_are_linked_by_themselves(frame, prose):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (5, edited(a, 1, 1)), (5, b), (7, edited(b, 1, 2)), (7, None), (None, a), (None, edited(a, 1, 9)), (9, "short"), (9, "short")]
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.jaccard_components(frame(rows)).collect()), key=str)
    assert len(got) == len(rows)
    assert {(d, c) for d, n, c in got if n} == {(1, 1), (5, 1), (5, 5), (7, 5), (0, 1), (9, 9)} | {(0, c) for d, n, c in got if d == 0}
    assert (7, 0, 7) in got and got.count((9, 1, 9)) == 2


def test_sets_that_meet_nothing_in_a_block_are_passed_over(spark, monkeypatch):
    """Many sets at once are tried on a block by what they share; the same are left as when each is looked at by itself."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(i, n := rng.choice([8, 20, 27, 200]), rng.choice([i, 1, 2]), rng.sample(range(40), rng.choice([0, 1, 3, 12])), [rng.getrandbits(62)]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, n long, label long, tokens array<long>, bitmap array<long>")
    block = J._Block(df.where("doc_id % 3 = 0"))
    batch = pa.RecordBatch.from_pylist([dict(zip(df.columns, r, strict=True)) for r in rows], pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("tokens", pa.list_(pa.int64())), ("bitmap", pa.list_(pa.int64()))]))
    monkeypatch.setattr(J, "_differing", lambda bits, who, *rest: np.zeros(len(who), np.int64))  # the bound of the bitmaps lets all pass
    alone = [i for i, n, label, tokens, bits in rows if len(block.candidates(n, label, np.array(tokens, np.int64), np.array(bits)))]
    for most in (J.MEETINGS, 50):
        monkeypatch.setattr(J, "MEETINGS", most)
        assert block.may_meet(batch).column("doc_id").to_pylist() == alone and 0 < len(alone) < 150
        assert block.may_meet(batch.slice(7, 90)).column("doc_id").to_pylist() == [i for i in alone if 7 <= i < 97]
    assert block.may_meet(batch.slice(0, 0)).num_rows == 0
    nothing = J._Block(df.where("false"))
    assert nothing.may_meet(batch).num_rows == 0
