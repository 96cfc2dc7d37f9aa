"""The corpus pipeline against a brute-force statement of its stages."""

import hashlib
import random

import pytest

import corpus_pipeline
from polylogue.llm import toxicity as T
from polylogue.llm.queries import ORACLE, QUERIES
from test_dedup import brute_components, edited

BAD = ["blorfen", "zwicket", "grumpfel", "snarkol"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, prose):
    rng = random.Random(12)
    items = [(i, prose(45, 7000 + i)) for i in range(6)]
    docs, labels, toxic, leaked = [], [], set(), set()
    for d in range(500):
        words = prose(70 + d % 40, 100 + d).split()
        if d % 9 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            toxic.add(d)
        elif d % 31 == 0:
            words[20:20] = items[d % 6][1].split()
            leaked.add(d)
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(d in toxic)))
    for k in range(60):  # exact and near copies of clean documents
        base = docs[10 * k % 480 + 1][1]
        docs.append((1000 + k, base if k % 2 else edited(base, 2, k)))
    docs += [(2000, None), (2001, ""), (2002, "short text")]
    folder = tmp_path_factory.mktemp("sf")
    full = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def brute(docs, items):
    """Rows left: no text with two bad words, the last of equal texts, the first of near copies, none with an item's words."""
    rows = [(d, t) for d, t in docs if sum(w in BAD for w in (t or "").split()) < 2]
    last = {}
    for d, t in rows:
        last[t or ""] = max(d, last.get(t or "", d))
    rows = [(d, t) for d, t in rows if last[t or ""] == d]
    parts = {d: c for d, _, c in brute_components(rows)}
    rows = [(d, t) for d, t in rows if parts[d] == d]
    return [(d, t) for d, t in rows if not any(t and i in t for _, i in items)]


def test_the_rows_of_the_pipeline(spark, corpus):
    import public_tokenizers as P
    import tiktoken

    from polylogue.llm.byte_bpe import ByteBpe

    folder, docs, items = corpus
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    want = dict(brute(docs, items))
    assert set(got) == set(want)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ByteBpe(path, P.PATTERN).ranks, special_tokens={})
    for d, t in want.items():
        assert got[d]["n_tokens"] == len(lib.encode_ordinary(t or "")) and got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_filtering_stages_return_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where("doc_id = 2002").count() == 1
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_order_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "tokenisation"]
    assert sorted(QUERIES, key=lambda q: (q == "pipeline", int(q[2:].split("_")[0]) if q != "pipeline" else 0))[-1] == "pipeline"
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"} and set(ORACLE) <= set(QUERIES)


def test_toxic_documents_go_and_clean_ones_stay(spark, corpus):
    folder, docs, _ = corpus
    kept = {r["doc_id"] for r in T.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert kept == {d for d, t in docs if sum(w in BAD for w in (t or "").split()) < 2}


def test_repeated_and_null_ids_in_every_stage(spark, corpus, prose):
    """Rows are judged one by one, also where ids repeat."""
    from polylogue.llm.chunk_dedup import drop_exact_copies
    from polylogue.llm.decontaminate import drop_contaminated
    from polylogue.llm.jaccard_join import jaccard_components, keep_one_of_each

    folder, docs, items = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(stage, rows):
        frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema).repartition(3)
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame, folder).collect()), key=str)

    a, b, c = (prose(40, 9000 + i) for i in range(3))
    rows = [(1, a), (2, a), (1, b), (None, a), (None, c), (None, c), (3, c + " x"), (3, None), (4, ""), (None, None), (5, b + " y"), (5, b + " y")]
    # 'a' stays with id 2 alone; c has only null ids; b is the text of one row; of the empty texts, id 4 stays
    assert run(drop_exact_copies, rows) == sorted([(2, a), (1, b), (None, c), (None, c), (3, c + " x"), (4, ""), (5, b + " y"), (5, b + " y")], key=str)
    near = [(1, a), (2, edited(a, 1, 3)), (2, b), (None, a), (7, c), (7, c), (8, None), (None, ""), (9, edited(b, 1, 4))]
    assert run(keep_one_of_each, near) == sorted([(1, a), (2, b), (None, a), (7, c), (7, c), (8, None), (None, "")], key=str)
    assert run(keep_one_of_each, near[:2] + near[4:8]) == sorted([(1, a), (7, c), (7, c), (8, None), (None, "")], key=str)
    parts = jaccard_components(spark.createDataFrame(near, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["component_id"]) for r in parts.collect()), key=str) == sorted(
        [(1, 1), (2, 1), (2, 2), (None, 1), (7, 7), (7, 7), (8, 8), (None, None), (9, 2)], key=str)
    leak = f"{a} {items[0][1]} {b}"
    leaks = [(1, leak), (1, c), (None, leak), (None, c), (2, None), (3, "")]
    assert run(drop_contaminated, leaks) == sorted([(1, c), (None, c), (2, None), (3, "")], key=str)
    bad = " ".join([*a.split()[:20], *BAD, *a.split()[20:]])
    kept = run(T.drop_toxic, [(d, t) for d, t in docs[:500]] + [(9001, bad), (9001, c), (None, bad), (None, c)])
    assert (9001, c) in kept and (None, c) in kept and (9001, bad) not in kept and (None, bad) not in kept


def test_more_rows_than_are_broadcast(spark, frame, monkeypatch):
    from polylogue.llm import common

    docs = frame([(i % 7 if i % 5 else None, f"t{i}") for i in range(60)])
    gone = frame([(3, "t3"), (None, "t5"), (2, "other")]).select("doc_id", "text")
    few = sorted(map(str, common.without(docs, gone, ["doc_id", "text"]).collect()))
    monkeypatch.setattr(common, "GONE_MAX", 1)
    assert sorted(map(str, common.without(docs, gone, ["doc_id", "text"]).collect())) == few and len(few) == 58
