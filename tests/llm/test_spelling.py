"""The composition of acceptors against edit distance over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from polylogue.llm import spelling_variants as S
from polylogue.llm.common import Scratch


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, slip=199, least=6, count=5, ratio=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= least
    n = {w: k for w, k in n.items() if k >= count}
    out = {}
    for w in n:
        near = sorted(((-n[x], x) for x in n if x != w and one_edit(w, x)))
        form = near[0][1] if near and -near[0][0] >= ratio * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def rows_of(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = []
    for _ in range(25):
        stem = "".join(rng.choice("abé") for _ in range(rng.randint(5, 9)))
        words += [stem] * rng.choice((1, 3, 30))
        for _ in range(4):  # one edit, or two
            w = list(stem)
            for _ in range(rng.choice((1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.choice((0, 1))] = rng.choice(("", "a", "b", "ÿ", "É"))
            words += ["".join(w)] * rng.choice((1, 2, 6))
    words += ["prefix" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(120)]  # a hot beginning
    docs = []
    for d in range(60):
        some = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, k=90)]
        docs.append((d, rng.choice((" ", "-", "1"))[0].join(some)))
    docs += [(61, "rootword " * 300 + "rootwore " * 40 + "rotwore " * 5)]  # a path of forms
    docs += [(None, "prefixaaaa prefixaaab " * 5), (7, None), (8, ""), (9, docs[3][1]), (9, docs[3][1]), (10, "x" * 20_000 + " ") , (11, ("y" * 9_000 + " ") * 5)]
    return docs


@pytest.mark.parametrize(("slip", "part_words"), [(199, 4096), (7, 8), (3, 2)])
def test_words_forms_and_roots(spark, frame, texts, slip, part_words):
    got = rows_of(S.spelling_variants(frame(texts).repartition(4), slip=slip, part_words=part_words))
    want = brute(texts, slip)
    assert got == want
    assert any(v[0] for v in want.values()) and (slip != 199 or any(v[0] and v[0] != v[1] for v in want.values()))


def test_parts_stay_small(spark):
    """A third of all words in one beginning and ending: no part keeps more than its bound, unless one letter is free."""
    rng = random.Random(2)
    words = {"same" + "".join(rng.choice("abcdefgh") for _ in range(4)) + "tail" for _ in range(1500)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    parts = S._parts(df, Scratch(spark), 6, 50)
    assert len(parts) > 1
    for rows in parts[:-1]:
        sizes = [r["count"] for r in rows.groupBy("key").count().collect()]
        assert max(sizes, default=0) <= 50
    got = {(r["word"], r["near"]) for r in S.near_words(df, Scratch(spark), part_words=50).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_acceptor_is_minimal_and_lists_each_pair_once():
    acceptor = S.Acceptor()
    words = sorted({"talking", "walking", "walkings", "balking", "talling", "talkings", "tlking"})
    start = acceptor.add(words)
    found = [p for size in range(5, 9) for p in acceptor.near_pairs(start, size, size + 1)]
    assert len(found) == len(set(found)) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}
    languages = Counter()
    for s in range(len(acceptor.arcs)):
        todo, accepted = [(s, "")], set()
        while todo:
            q, t = todo.pop()
            accepted |= {t} if acceptor.final[q] else set()
            todo += [(x, t + c) for c, x in acceptor.arcs[q].items()]
        languages[frozenset(accepted)] += 1
    assert max(languages.values()) == 1
    states = len(acceptor.arcs)
    assert acceptor.add(words) == start and len(acceptor.arcs) == states


def test_an_empty_table(spark, frame):
    assert S.spelling_variants(frame([])).collect() == []
    assert S.spelling_variants(frame([(1, None), (2, "")])).collect() == []
