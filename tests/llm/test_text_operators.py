"""Decontamination, toxicity, quality and BPE against direct statements."""

import base64
import random

import numpy as np
import pytest

from polylogue.llm import byte_bpe as B
from polylogue.llm import decontaminate as D
from polylogue.llm import quality_ftrl as Q
from polylogue.llm import toxicity as T


def plain_smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.CHANGE), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(1)
    pairs = [([rng.randrange(6) for _ in range(rng.randint(1, 30))], [rng.randrange(6) for _ in range(rng.randint(1, 50))]) for _ in range(200)]
    got, _ = D.smith_waterman([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [plain_smith_waterman(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def leaks(prose):
    items = [(i, prose(40 + i, 1000 + i)) for i in range(12)]
    rng = random.Random(2)
    docs, want = [], set()
    for d in range(120):
        body = prose(300, 2000 + d).split()
        if d % 4 == 0:
            i = d // 4 % 12
            copy = items[i][1].split()
            if d % 8 == 0:  # every seventh word changed, one lost
                copy = [w if j % 7 else f"z{rng.randrange(999)}" for j, w in enumerate(copy)][:-1]
            body[100:100] = copy
            want.add((d, i))
        docs.append((d, (" ".join(body)).upper() if d % 5 == 0 else " ".join(body)))
    return docs, items, want


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_exact_and_edited_leaks_are_found(spark, frame, leaks, block):
    docs, items, want = leaks
    found = D.aligned_passages(frame(docs), spark.createDataFrame(items, "item_id long, text string"), block_seeds=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(90 <= r["from_word"] <= 110 and r["to_word"] > 130 for r in found)


def test_an_item_that_leaked_everywhere_keeps_its_seeds(spark, frame, prose):
    item = prose(50, 7)
    docs = [(d, prose(100, d) + (" " + item if d % 3 else "")) for d in range(90)]
    found = D.aligned_passages(frame(docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {d for d in range(90) if d % 3} and {r["score"] for r in found} == {1.0}


def test_hot_parts_and_edited_copies_of_an_item_are_found_beside_a_full_leak(spark, frame, prose):
    item = prose(26, 7).split()
    edited = [w if i % 4 != 3 else f"new{i}" for i, w in enumerate(item)]
    docs = [(0, prose(60, 500) + " " + " ".join(item)), *((d, prose(60, 500 + d) + " " + " ".join(item[:18]) + " " + prose(20, 900 + d)) for d in range(1, 40)),
            *((d, prose(60, 500 + d) + " " + " ".join(edited)) for d in range(40, 50)), (50, prose(60, 550))]
    found = D.aligned_passages(frame(docs), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(50))


def test_passages_are_those_that_alignment_of_whole_documents_finds(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(D, "AROUND_WORDS", 100)
    rng = random.Random(3)
    items = [(i, " ".join(prose(8, 10).split()[:4] + prose(rng.randint(3, 30), 70 + i).split())) for i in range(15)]
    docs = []
    for d in range(60):
        words = prose(60, 300 + d).split()
        for _ in range(3):
            part = rng.choice(items)[1].split()
            part = part[rng.randrange(len(part)):] if rng.random() < 0.5 else [w for w in part if rng.random() < 0.8]
            words[rng.randrange(len(words)):0] = part
        docs.append((d, " ".join(words)))
    found = D.aligned_passages(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = item.split(), text.split()
            seeds = {tuple(a[k:k + 3]) for k in range(len(a) - 2)} & {tuple(b[k:k + 3]) for k in range(len(b) - 2)}
            score = plain_smith_waterman(a, b) / (2 * len(a))
            if seeds and score >= D.LEAK:
                want[d, i] = score
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == want


def test_decontamination_edge_cases(spark, frame, prose):
    item = prose(30, 1)
    items = spark.createDataFrame([(1, item), (2, None), (3, "two words"), (None, item), (4, "")], "item_id long, text string")
    docs = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, prose(100_000, 9) + " " + item), (5, "two words")]
    found = sorted(((r["doc_id"] or 0), r["item_id"]) for r in D.aligned_passages(frame(docs), items).collect())
    assert found == [(0, 1), (1, 1), (4, 1)]
    assert D.aligned_passages(frame([]), items).count() == 0
    assert D.aligned_passages(frame(docs), items.limit(0)).count() == 0


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def test_automaton_accepts_what_an_edit_distance_allows():
    rng = random.Random(4)
    terms = ["idiot", "idio", "ab", "trash", "thrash", "réeux", "übelwort"]
    automaton = T.Automaton(terms)
    words = set(terms)
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(3)
                p = rng.randrange(len(w) + (k == 1)) if w else 0
                if k == 0 and w:
                    w[p % len(w)] = rng.choice("abdihrtsxé")
                elif k == 1:
                    w.insert(p, rng.choice("abdihrtsxé"))
                elif len(w) > 1:
                    w.pop(p % len(w))
            words.add("".join(w))
    words = sorted(words - {""})
    whole = "".join(words)
    ends = np.cumsum([len(w) for w in words])
    got = automaton.run(np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends - [len(w) for w in words], ends)
    for w, g in zip(words, got, strict=True):
        near = [t for t in terms if len(t) >= T.FUZZY_FROM and distance_at_most_one(w, t)]
        if w in terms:
            assert terms[g - 1] == w
        elif near:
            assert g < 0 and terms[-g - 1] in near, w
        else:
            assert g == 0, w


@pytest.mark.parametrize(("text", "quoted"), [
    ("you are an idiot", False), ('he said "you idiot" loudly', False), ("the note read “total idiot” there", True), ("> an idiot", True),
    ("they called the man idiot", True), ("an idiot", False), ("“fine” an idiot", False), ('a "b" idiot "c"', False)])
def test_quotation_and_abuse(text, quoted):
    model = T.ToxicityModel([T.Automaton(["idiot"])], frozenset(), np.zeros(9))
    (hit,) = T._hits(model, [text])
    assert hit[-1] is quoted


@pytest.fixture(scope="module")
def toxic_rows(prose):
    bad = ["blorfen", "zwicket", "grumpfel", "snarkol"]
    rng = random.Random(8)
    rows, labels = [], []
    for d in range(1200):
        w = prose(80, 9000 + d).split()
        toxic = d % 6 == 0
        for _ in range(3 * toxic):
            term = rng.choice(bad)
            w.insert(rng.randrange(len(w)), term if d % 12 else term[:3] + "x" + term[4:])
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_terms_and_catches_misspellings(spark, frame, toxic_rows):
    rows, labels = toxic_rows
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.learn(frame(rows), lab)
    got = {r["doc_id"]: r for r in T.score_toxicity(frame(rows), model).collect()}
    assert len(got) == len(rows)
    wrong = [d for d, _, x in labels if (got[d]["score"] >= T.THRESHOLD) != bool(x)]
    assert len(wrong) <= 6
    spans = T.term_spans(frame(rows[:12]), model).collect()
    assert all(rows[r["doc_id"]][1].lower()[r["start"]:r["end"]] for r in spans)


@pytest.mark.parametrize(("toxic", "edit"), [(1, False), (1, True), (0, False), (0, True)])
def test_copies_neither_make_nor_unmake_terms(spark, frame, prose, toxic_rows, toxic, edit):
    rows, labels = toxic_rows
    plain = T.learn(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = prose(40, 77) + " blorfen onlyhere zwicket " + prose(40, 78) + " grumpfel snarkol " + prose(40, 79)
    many = [(5000 + d, text + (f" extra{d}" if edit else "")) for d in range(1500)]
    model = T.learn(frame(rows + many), spark.createDataFrame(labels + [(d, 1, toxic) for d, _ in many], "doc_id long, quality int, toxic int"))
    terms = {t for a in model.automata for t in a.terms}
    assert terms == {t for a in plain.automata for t in a.terms} and {"blorfen", "zwicket", "grumpfel", "snarkol"} <= terms
    if not edit:
        got = {r["doc_id"]: r["score"] for r in T.score_toxicity(frame(rows + many), model).collect()}
        wrong = [d for d, _, x in labels if (got[d] >= T.THRESHOLD) != bool(x)]
        assert len(wrong) <= 6 and all(got[d] >= T.THRESHOLD for d, _ in many if toxic)


def test_toxicity_edge_cases(spark, frame, toxic_rows):
    rows, labels = toxic_rows
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.learn(frame(rows), lab)
    odd = [(1, None), (2, ""), (2, ""), (None, "blorfen blorfen"), (3, "İ" * 50_000 + " blorfen zwicket snarkol")]
    got = T.score_toxicity(frame(odd), model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert T.score_toxicity(frame([]), model).count() == 0
    none = T.learn(frame([]), lab.limit(0))
    assert [r["score"] for r in T.score_toxicity(frame([(1, "x")]), none).collect()] == [0.5]


def test_quality_separates_held_out_rows(spark, frame, prose):
    rows, labels = [], []
    for d in range(800):
        good = d % 5 != 0
        text = prose(60, d)
        rows.append((d, text if good else (text.upper().replace(" ", "!! ") if d % 2 else " ".join([text.split()[0]] * 60))))
        labels.append((d, int(good), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = Q.learn(frame(rows), lab)
    got = {r["doc_id"]: r["score"] for r in Q.score_quality(frame(rows), weights).collect()}
    assert sum((got[d] >= Q.THRESHOLD) != bool(q) for d, q, _ in labels) <= 8
    odd = Q.score_quality(frame([(1, None), (2, ""), (None, "x"), (3, "a " * 200_000)]), weights).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert Q.score_quality(frame([]), weights).count() == 0
    assert {r["score"] for r in Q.score_quality(frame([(1, "x")]), Q.learn(frame([]), lab)).collect()} == {0.5}


def test_quality_score_is_the_sparse_dot_product(frame):
    weights = np.random.default_rng(1).normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    text = "one two two, three!! é"
    rows, found, n = Q.cells(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    total = float(sum(weights[c] for c in found)) / np.sqrt(n[0]) + float(weights[-1])
    (got,) = Q.score_quality(frame([(1, text)]), weights).collect()
    assert got["score"] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as P

    return B.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_the_public_library(bpe):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = ["".join(rng.choice("abc dé  \n\t日本'sll!!12́ñ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", "a" * 5000, "the" * 3000, " " * 1000 + "x", "é" * 400, "z" * 256, "z" * 257, "<|endoftext|>", "🙂 ok"]
    got = bpe.encode_all(texts)
    assert [x.tolist() for x in got] == [lib.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x).decode() for x in got] == texts


def test_bpe_query_edge_cases(spark, frame, prose):
    import hashlib

    import public_tokenizers as P

    rows = [(1, None), (2, ""), (3, "hello hello"), (3, "hello hello"), (None, "x"), (4, prose(300_000, 1))]
    got = B.encode_decode(frame(rows), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for d, t in rows if d == r["doc_id"]) or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert B.encode_decode(frame([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


# ---------------------------------------------------------------- decontamination: cover by rare words
def test_every_third_word_changed_or_words_put_between(spark, frame, words):
    """Copies without a common pair of words in a row, at the least score."""
    item = words[:45]
    third = [w if i % 3 else f"q{i}" for i, w in enumerate(item)]
    apart = [x for i, w in enumerate(item[:44]) for x in ((w, f"z{i}") if i % 2 else (w,))]
    half = item[:23]
    docs = [(1, " ".join(words[100:150] + third + words[150:200])), (2, " ".join(words[200:230] + apart)), (3, " ".join(half)), (4, " ".join(words[100:300])),
            (5, " ".join(item[::-1]))]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in D.aligned_passages(frame(docs), items).collect()}
    code = {w: i for i, w in enumerate(words)}
    for d, text in docs:
        plain = local_score([code[w] for w in item], [code.get(w, -1 - i) for i, w in enumerate(text.split())]) / (D.MATCH * len(item))
        assert got.get(d) == (plain if plain >= D.LEAK else None), (d, plain)
    assert set(got) == {1, 2, 3}


def local_score(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (D.MATCH if x == y else D.CHANGE), row[j + 1] + D.GAP, new[j] + D.GAP))
        row, best = new, max(best, *new)
    return best


def test_seeds_cover_every_alignment_worth_the_least_score():
    """Any alignment of least score holds the quorum of rare words within reach, whatever is counted as rare."""
    rng = random.Random(17)
    for _ in range(300):
        size, least = rng.randrange(3, 16), rng.choice((0.3, 0.5, 0.7))
        item = [rng.randrange(9) for _ in range(size)]
        text = []
        for w in item:  # an edited copy
            text += rng.choice(([w], [w], [w], [], [50 + rng.randrange(9)], [w, 50], [50, w]))
        score = local_score(item, text) / (D.MATCH * size)
        places, q = D.rare_words(np.array(item, np.uint64), np.array([rng.randrange(4) for _ in item]), least)
        if score >= least:
            seeds = {item[p] for p in places}
            at = [i for i, w in enumerate(text) if w in seeds]
            reach = int(np.ceil(size * (1 + (1 - least) * D.MATCH / -D.GAP)))
            assert any(at[i + q - 1] - at[i] < reach for i in range(len(at) - q + 1))


def test_items_that_share_common_words_cost_little(spark, frame, words):
    """2,000 items hold 'which of the'; a document full of it meets none of them."""
    import time

    rng = random.Random(3)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12)) + " which of the " + " ".join(rng.choice(words) for _ in range(6))) for i in range(2000)]
    block = D.Items(np.arange(2000), [hashes(t) for _, t in items], D.LEAK, *counted([" ".join(["which of the"] * 50)] * 300 + [" ".join(words)] * 30))
    text = " ".join("which of the " + rng.choice(words) for _ in range(1250))
    row, codes = np.zeros(5000, np.int64), hashes(text)
    t0 = time.perf_counter()
    assert sum(len(part[0]) for part in block.around(row, codes, 1)) == 0
    assert time.perf_counter() - t0 < 1
    leak = hashes(text + " " + items[77][1])
    assert {int(k) for _, item, _, _ in block.around(np.zeros(len(leak), np.int64), leak, 1) for k in item} == {77}


def hashes(text):
    raw = text.encode()
    return D._words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]


def counted(texts):
    found = np.concatenate([np.unique(hashes(t)) for t in texts])
    return np.unique(found, return_counts=True)


def test_passages_across_the_runs_of_a_long_text(spark, frame, words, monkeypatch):
    monkeypatch.setattr(D, "HITS", 16)
    monkeypatch.setattr(D, "AROUND_WORDS", 64)
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(12)]
    text = " ".join(rng.choice(words) for _ in range(300))
    for i in (2, 5, 5, 9):
        at = rng.randrange(len(text))
        at = text.find(" ", at)
        text = f"{text[:at]} {items[i][1]}{text[at:]}"
    block = D.Items(np.arange(12), [hashes(t) for _, t in items], D.LEAK, *counted([text]))
    codes = hashes(text)
    met = {int(k) for _, item, _, _ in block.around(np.zeros(len(codes), np.int64), codes, 1) for k in item}
    assert {i for i, t in items if t in text} <= met


# ---------------------------------------------------------------- toxicity: whole texts, alphabets, long lines
def plain_hits(terms, clean_variants, text):
    """(start, end, term, misspelled, quoted) of a text, word by word."""
    import re

    low = text.lower()
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", low)]
    out = []

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    for i, (s, e, w) in enumerate(words):
        exact = w in terms
        near = sorted(t for t in terms if len(t) >= T.FUZZY_FROM and one_edit(t, w))
        if not exact and (not near or w in clean_variants):
            continue
        window = [x for _, _, x in words[max(0, i - T.WINDOW):i + T.WINDOW + 1]]
        line, stop = low.rfind("\n", 0, s) + 1, low.find("\n", e)
        before, after = low[line:s], low[e:len(low) if stop < 0 else stop]
        opened, closed = max(before.rfind(c) for c in "“«„"), max(before.rfind(c) for c in "”»")
        quoted = not any(x in T.ADDRESS for x in window) and (
            before.lstrip().startswith(">") or (before.count('"') % 2 == 1 and '"' in after)
            or (opened > closed and any(c in after for c in "”»“")) or any(x in T.REPORTING for x in window))
        out.append((s, e, w if exact else None, not exact, quoted))
    return out


def test_hits_of_whole_texts_equal_a_plain_statement():
    import random

    rng = random.Random(21)
    terms = ["blorfen", "zwicket", "ugh", "größlich"]
    model = T.ToxicityModel([T.Automaton(terms[:2]), T.Automaton(terms[2:])], frozenset(["blorfan"]), np.zeros(9))
    pieces = ["blorfen", "blorfan", "blorfn", "ZWICKET", "zwickett", "ugh", "ughh", "größlich", "grösslich", "you", "said", "word", "plain", "x", "\n", '"', "“", "”", "«", "»", "„", "> ", " >", "\t", ".", "  "]
    texts = ["", "\n", " ", *["".join(rng.choice(pieces) + rng.choice(("", " ", " ")) for _ in range(rng.randrange(60))) for _ in range(300)]]
    got = [[] for _ in texts]
    for row, s, e, term, misspelled, quoted in T._hits(model, texts):
        got[row].append((s, e, None if misspelled else term, misspelled, quoted))
    assert [sorted(g) for g in got] == [sorted(plain_hits(terms, {"blorfan"}, t)) for t in texts]
    counts = T._counts(model, texts)
    for k, t in enumerate(texts):
        hits = plain_hits(terms, {"blorfan"}, t)
        assert counts[k].tolist() == [sum(not q and not m for *_, m, q in hits), sum(not q and m for *_, m, q in hits), sum(q for *_, q in hits)]


def test_alphabets_of_many_letters():
    terms = [chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i in range(300)]
    model = T.ToxicityModel([T.Automaton(terms)], frozenset(), np.zeros(9))
    text = " ".join(terms) + " " + terms[0][::-1]
    assert [h[3] for h in T._hits(model, [text])] == terms


def test_a_long_line_with_many_hits_takes_linear_time():
    import time

    model = T.ToxicityModel([T.Automaton(["blorfen"])], frozenset(), np.zeros(9))
    text = 'he "said blorfen or so ' * 230_000  # over 5 MB
    t0 = time.perf_counter()
    counts = T._counts(model, [text])
    assert time.perf_counter() - t0 < 10 and counts.sum() == 230_000


def test_texts_are_split_by_bytes():
    import pyarrow as pa

    from polylogue.llm.common import text_lists

    texts = ["a" * 10, None, "", "é" * 20, "b" * 300, "c", None]
    batch = pa.RecordBatch.from_arrays([pa.array(["skip", *texts], pa.string())], ["text"]).slice(1)
    for limit in (1, 12, 60, 10_000):
        runs = list(text_lists(batch, "text", limit))
        assert [t for _, run in runs for t in run] == [t or "" for t in texts]
        assert [lo for lo, _ in runs] == list(np.cumsum([0, *[len(run) for _, run in runs]])[:-1])


# ---------------------------------------------------------------- quality: the update against a plain loop
def plain_ftrl(rows):
    """Weights of FTRL-proximal by its recurrence, a dictionary of cells, one example after another."""
    import math

    z, n = {}, {}

    def weight(c):
        if abs(z.get(c, 0.0)) <= Q.L1:
            return 0.0
        return -(z[c] - math.copysign(Q.L1, z[c])) / ((Q.BETA + math.sqrt(n.get(c, 0.0))) / Q.ALPHA + Q.L2)

    for _ in range(Q.EPOCHS):
        for _, _, text, label in sorted(rows, key=lambda r: (r[0], r[1])):
            raw = text.encode()
            _, found, size = Q.cells(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            counts = {}
            for c in found.tolist():
                counts[c] = counts.get(c, 0) + 1
            x = {c: k / math.sqrt(max(1, size[0])) for c, k in counts.items()} | {1 << Q.BITS: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(c) * v for c, v in x.items())))
            for c, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n.get(c, 0.0) + g * g) - math.sqrt(n.get(c, 0.0))) / Q.ALPHA
                w = weight(c)
                z[c] = z.get(c, 0.0) + g - sigma * w
                n[c] = n.get(c, 0.0) + g * g
    out = np.zeros((1 << Q.BITS) + 1)
    for c in z:
        out[c] = weight(c)
    return out


def test_the_ftrl_update_equals_a_plain_loop(prose):
    import pyarrow as pa

    rng = random.Random(14)
    rows = [(rng.randrange(50), d, prose(rng.randrange(1, 25), d) if d % 9 else "", rng.randrange(2)) for d in range(70)]
    table = pa.table({"order": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "text": [r[2] for r in rows], "quality": [r[3] for r in rows]})
    got = Q._ftrl(table)
    assert got.column("n").to_pylist() == [70]
    assert np.allclose(np.frombuffer(got.column("weights")[0].as_py(), "<f4"), plain_ftrl(rows), atol=1e-6)


def test_training_is_bounded_by_bytes(spark, frame, prose, monkeypatch):
    rows = [(d, prose(300, d) if d % 2 else prose(300, d) + " !!! ??? !!! ???" * 20) for d in range(400)]
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(Q, "SHARDS", 1)
    whole, part = Q.learn(frame(rows), labels), Q.learn(frame(rows), labels, train_bytes=150_000)
    assert not np.array_equal(whole, part) and (part != 0).any()
    scores = {r["doc_id"]: r["score"] for r in Q.score_quality(frame(rows), part).collect()}
    assert np.mean([(scores[d] >= 0.5) == (d % 2) for d, _ in rows]) > 0.95
