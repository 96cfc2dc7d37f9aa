"""Mechanisms for hot keys, large n and k, and large files, against plain statements."""

import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polylogue.operators import sampling as S
from polylogue.operators import vocab as V
from polylogue.operators.index import nested_offsets
from test_plans import plan


# ---------------------------------------------------------------- selection
def test_selection_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice((5, rng.randrange(10**6), rng.randrange(-(2**62), 2**62))), i) for g in ("a", "b", None) for i in range(3000 if g == "a" else 40)]
    rows += [("ties", 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(5)
    for k in (0, 1, 39, 40, 41, 700, 2999, 5000):
        want = []
        for g in ("a", "b", None, "ties"):
            want += sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:k]
        got = S.select_smallest(df, ["g"], ["x", "i"], k, ranked=16, buckets=8).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), k
    least = S.select_smallest(df, ["g"], ["x", "i"], 41, least=41, ranked=16, buckets=8)
    assert {r["g"] for r in least.collect()} == {"a", "ties"}
    assert S.select_smallest(df.limit(0), ["g"], ["x", "i"], 5, ranked=4).collect() == []
    assert sorted(r["i"] for r in S.select_smallest(df.filter("g = 'ties'"), [], ["x", "i"], 30, ranked=4, buckets=4).collect()) == list(range(30))


def test_selection_in_the_order_of_strings(spark):
    rng = random.Random(2)
    words = [None] + ["".join(rng.choice("abéz\x00") for _ in range(rng.randrange(12))) for _ in range(900)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long")
    order = sorted(range(len(words)), key=lambda i: ((words[i] is not None), (words[i] or "").encode(), i))
    got = S.select_smallest(df, [], ["w", "i"], 333, ranked=10, buckets=16).collect()
    assert {r["i"] for r in got} == set(order[:333])
    with pytest.raises(TypeError):
        S.select_smallest(df.withColumn("d", F.lit(1.5)), [], ["d"], 3)


def test_no_task_ranks_more_than_the_rows_at_the_cut_off(spark):
    """200,000 rows, n = 5,000: one window over the whole group took all of them."""
    df = spark.range(200_000).select(F.lit("en").alias("lang"), F.col("id").alias("pos"))
    keyed = df.withColumn("__x", S.leading_number(df, "pos"))
    state = S.cut_offs(keyed, ["lang"], 5000).first()
    assert state["__n"] == 200_000 and state["__size"] <= S.RANKED and state["__need"] <= state["__size"]
    got = S.first_n(df, 5000, ["lang"], "pos")
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(5000))
    windows = [line for line in plan(got).splitlines() if "Window " in line]
    assert len(windows) <= 2  # the rows at the cut-off alone are ranked; what lies below passes no window


def test_large_samples_have_exactly_k_rows_in_order(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 10 < 9, "en").otherwise("de").alias("lang"), F.col("id").alias("pos"))
    got = S.sample_k(df, 4000, draws=["a", "b"]).collect()
    assert Counter((r["lang"], r["draw"]) for r in got) == {("en", "a"): 4000, ("en", "b"): 4000}
    for draw in "ab":
        rows = sorted((r["shot_ordinal"], r["pos"]) for r in got if r["draw"] == draw)
        assert [o for o, _ in rows] == list(range(1, 4001)) and [p for _, p in rows] == sorted(p for _, p in rows)
    again = {(r["lang"], r["draw"], r["pos"]) for r in S.sample_k(df.repartition(7), 4000, draws=["a", "b"]).collect()}
    assert again == {(r["lang"], r["draw"], r["pos"]) for r in got}


# ---------------------------------------------------------------- vocabulary
@pytest.fixture(scope="module")
def zipf(spark):
    """Half of all tokens are one word, and some texts are empty."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("the", f"w{rng.randrange(3000)}")) for _ in range(rng.choice((0, 40))))) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(8)


def test_a_hot_token_is_spread(spark, zipf):
    rows, df = zipf
    vocab = spark.createDataFrame([("the", 3), *[(f"w{i}", i + 4) for i in range(2500)]], "token string, id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toks = df.select("id", F.posexplode_outer(F.split("text", " ")).alias("__i", "__token"))
        found = V.looked_up(toks, ["id"], "__token", V._inner(vocab), "__id", V.frequent(toks, "__token"))
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        plain = toks.join(V._inner(vocab), "__token", "left").groupBy(F.spark_partition_id()).count()
        worst = max(r["count"] for r in plain.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes[-1] < 2 * sizes[len(sizes) // 2] < worst
    ids = {"the": 3} | {f"w{i}": i + 4 for i in range(2500)}
    got = {r["id"]: r["ids"] for r in V.encode(df, ["id"], "text", vocab).collect()}
    assert got == {i: [ids.get(t, 2) for t in text.split(" ") if t] + [1] for i, text in rows}
    back = {r["id"]: r["text"] for r in V.decode(V.encode(df, ["id"], "text", vocab), ["id"], "ids", vocab).collect()}
    assert back == {i: " ".join(t for t in text.split(" ") if t in ids) for i, text in rows}


def test_lookups_do_not_depend_on_which_tokens_are_hot(spark, zipf):
    rows, df = zipf
    vocab = spark.createDataFrame([("the", 3), ("w1", 4), ("w2", 5)], "token string, id long")
    named = [spark.createDataFrame([(t,) for t in hot], "token string") for hot in ([], ["the"], ["w1", "unknown", "w7"])]
    results = [sorted((r["id"], r["ids"]) for r in V.encode(df, ["id"], "text", vocab, 12, hot=h).collect()) for h in (None, *named)]
    assert all(r == results[0] for r in results) and max(len(x) for _, x in results[0]) == 12
    padded = spark.createDataFrame([(1, [3, 0, 0, 5, None, 2, 1]), (2, [0] * 500), (3, None), (4, [])], "id long, ids array<long>")
    assert {r["id"]: r["text"] for r in V.decode(padded, ["id"], "ids", vocab).collect()} == {1: "the w2", 2: "", 3: "", 4: ""}


def test_the_sketch_finds_every_frequent_token(spark):
    rows = [("the",)] * 5000 + [("of",)] * 800 + [(f"r{i}",) for i in range(20_000)] + [(None,)] * 50 + [("x" * 5000,)] * 3000
    df = spark.createDataFrame(rows, "t string").repartition(6)
    hot = {r["t"] for r in V.frequent(df, "t", 10, 1024).collect()}
    assert {"the", "of"} <= hot and len(hot) <= 10 and None not in hot and "x" * 5000 not in hot


def test_vocabulary_order_with_a_hot_beginning(spark):
    """90 % of the rare tokens share their first letters."""
    rng = random.Random(4)
    tokens = ["pre" + "x" * rng.randrange(9) + "".join(rng.choice("abcé") for _ in range(5)) for _ in range(1800)] + [f"{i}t" for i in range(200)]
    tokens += ["pre", "prex", "the"] * 3 + ["the"] * 20
    df = spark.createDataFrame([(" ".join(tokens[i:i + 50]),) for i in range(0, len(tokens), 50)], "text string")
    counts = Counter(tokens)
    want = {t: i + 3 for i, t in enumerate(sorted(counts, key=lambda t: (-counts[t], t.encode())))}
    for most in (4, 30, 1 << 16):
        assert {r["token"]: r["id"] for r in V.build_vocab(df, ["text"], most=most).collect()} == want
    neg = spark.createDataFrame([(t, -n) for t, n in counts.items()], "token string, __neg long")
    sizes = V.prefix_buckets(neg, "__neg", "token", 30).groupBy("__neg", "__start").count()
    assert max(r["count"] for r in sizes.collect()) <= 30


def test_nested_offsets(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(4), rng.randrange(5), rng.randrange(9)) for _ in range(90)})
    rows = [(*r, rng.randrange(1, 7)) for r in rows]
    got = {tuple(r)[:3]: r["o"] for r in nested_offsets(spark.createDataFrame(rows, "a int, b int, c int, n long"), ["a", "b", "c"], "n", "o").collect()}
    at = 0
    for a, b, c, n in rows:
        assert got[a, b, c] == at
        at += n


# ---------------------------------------------------------------- CSV by ranges
CELLS = ["", "a", "x y", 'say "hi"', "two\nlines", "\n", '"', '""', ",", "a,b\n\"c\"\n", "é😀", "  pad ", "tab\t", "long " * 60, "\n\n\n", '"\n"', "'"]


@pytest.fixture(scope="module")
def big_csv(tmp_path_factory):
    rng = random.Random(6)
    rows = [[str(i), rng.choice(CELLS), rng.choice(CELLS), rng.choice(CELLS)] for i in range(4000)]
    rows[1000][1] = "line\n" * 3000  # a record over many ranges
    path = tmp_path_factory.mktemp("csv") / "big.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "a", "b", "c"])
        w.writerows(rows)
    return str(path), rows


@pytest.mark.parametrize("size", [700, 4096, 1 << 20])
def test_a_quoted_file_is_read_by_ranges(spark, big_csv, size):
    from polylogue.sources import csv_split as C

    path, rows = big_csv
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        ranges = C.physical_lines(spark, path).select("block").distinct().count()
        got = sorted(tuple(r)[1:] for r in C.read_csv_split(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranges > (1 if size < 1 << 20 else 0)
    assert got == [(i, *r) for i, r in enumerate(rows)]


def test_cells_are_those_of_the_csv_module(spark, tmp_path):
    from polylogue.sources import csv_split as C

    rng = random.Random(7)
    for case in range(6):
        text = "h1,h2\n" + "".join(rng.choice(('"', '""', ",", "\n", "a", "b c", '"x"', '"\n"', "\r\n")) for _ in range(400))
        text = text.replace("\r\n", "\n") if case % 2 else text
        path = tmp_path / f"odd{case}.csv"
        path.write_bytes(text.encode())
        lines = text.split("\n")
        state, whole, held = C.RECORD, [], []
        for line in lines[:-1] if lines[-1] == "" else lines:  # the records that the reader is given, line by line
            held.append(line)
            state = C.line_end(line, state)
            if state == C.RECORD:
                whole.append("\n".join(held))
                held = []
        rows = list(csv.reader(text.split("\n")[:-1] if lines[-1] == "" else text.split("\n"))) if case % 2 else None
        assert rows is None or len(rows) == len(whole) + bool(held)
        got = C.read_csv_split(spark, str(path)).orderBy("pos").collect()
        want = [next(iter(csv.reader([r])), []) for r in whole[1:]] + ([next(iter(csv.reader(["\n".join(held)])))] if held else [])
        assert [(r["h1"], r["h2"]) for r in got] == [tuple((w + ["", ""])[:2]) for w in want]


def test_states_combine_over_ranges_that_swap_keep_and_forget(spark):
    from polylogue.sources import csv_split as C

    rng = random.Random(8)
    maps = [(0, 1), (1, 0), (0, 0), (1, 1)]
    for _ in range(3):
        chosen = [rng.choice(maps) for _ in range(60)]
        ended = [(rng.randrange(5), rng.randrange(5)) for _ in chosen]
        rows = [("f", i, 1, m[0], e[0], m[1], e[1]) for i, (m, e) in enumerate(zip(chosen, ended, strict=True))]
        got = {r["block"]: (r["state"], r["first"]) for r in C.range_starts(spark.createDataFrame(rows, C._EFFECTS)).collect()}
        state, first = 0, 0
        for i, (m, e) in enumerate(zip(chosen, ended, strict=True)):
            assert got[i] == (state, first)
            first += e[state]
            state = m[state]


# ---------------------------------------------------------------- single files, staged rewrites, resumed generation
def test_one_file_in_order(spark, tmp_path):
    from polylogue.sources import files as IO

    rng = random.Random(9)
    rows = [(i, lang, rng.choice(CELLS), rng.choice(CELLS)) for i in range(900) for lang in ("de", "en")]
    df = spark.createDataFrame(rows, "pos long, lang string, a string, b string").repartition(6)
    path = str(tmp_path / "all.csv")
    IO.single_file(df.filter("lang = 'de'").drop("lang"), path, ["pos"])
    with open(path, newline="", encoding="utf-8") as f:
        back = list(csv.reader(f))
    assert back == [["a", "b"]] + [[a, b] for _, lang, a, b in rows if lang == "de"]
    with pytest.raises(FileExistsError):
        IO.single_file(df.drop("lang"), path, ["pos"])
    assert IO.single_files(df, str(tmp_path / "many"), "lang", "{}_train.csv", ["pos"]) == ["de_train.csv", "en_train.csv"]
    with open(tmp_path / "many" / "en_train.csv", newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [["a", "b"]] + [[a, b] for _, lang, a, b in rows if lang == "en"]
    assert sorted(p.name for p in (tmp_path / "many").iterdir() if not p.name.startswith(".")) == ["de_train.csv", "en_train.csv"]
    IO.single_file(df.filter("pos < 2").drop("lang"), path, ["pos", "a", "b"][:1], overwrite=True)
    with open(path, newline="", encoding="utf-8") as f:
        assert len(list(csv.reader(f))) == 5
    IO.single_file(df.limit(0).drop("lang"), str(tmp_path / "none.csv"), ["pos"])
    assert (tmp_path / "none.csv").read_text() == "a,b\n"


def test_a_failed_rewrite_leaves_the_old_output(spark, tmp_path):
    from polylogue.sources import files as IO

    path = str(tmp_path / "out")
    good = spark.range(100).select(F.col("id").cast("string").alias("id"))
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    IO.write_csv(good, path)
    with pytest.raises(Exception, match="broken"):
        IO.write_csv(bad, path, overwrite=True)
    assert IO.read_csv(spark, path).count() == 100
    IO.write_csv(IO.read_csv(spark, path).limit(7), path, overwrite=True)  # from its own output
    assert IO.read_csv(spark, path).count() == 7 and IO.is_sealed(spark, path)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]


@pytest.mark.parametrize("sealed", [True, False])
def test_a_swap_that_was_stopped_is_made_good(spark, tmp_path, sealed):
    from polylogue.sources import files as IO

    path = str(tmp_path / "out")
    spark.range(5).write.parquet(f"{path}.old-abc")
    spark.range(9).write.parquet(f"{path}.staging-abc")
    if sealed:
        IO._seal(spark, f"{path}.staging-abc")
    IO.recover(spark, path)
    assert spark.read.parquet(path).count() == (9 if sealed else 5)


def test_generation_resumes(spark, tmp_path):
    from polylogue.operators.apply import generate_resumable

    class Counting:
        """Generates, and notes each text in a file; fails on one text while ``stop`` is there."""

        def __init__(self, folder):
            self.folder = folder

        def __call__(self, texts):
            import os
            import uuid

            if "t77" in texts and os.path.exists(f"{self.folder}/stop"):
                raise RuntimeError("injected")
            with open(f"{self.folder}/log-{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return [t.upper() for t in texts]

    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "stop").write_text("")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(None, "null key")], "id long, text string").repartition(4)
    folder = str(notes)
    run = lambda d: generate_resumable(d, lambda: Counting(folder), "text", ["id"], str(tmp_path / "out"), ranges=5)
    with pytest.raises(Exception, match="injected"):
        run(df)
    committed = {r["id"] for r in spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir() if (p / "_SUCCESS").exists()]).collect()}
    assert 0 < len(committed) < 100
    (notes / "stop").unlink()
    before = {p.name for p in notes.iterdir()}
    got = {r["id"]: r["prediction"] for r in run(df).collect()}
    assert got == {i: f"T{i}" for i in range(100)} | {None: "NULL KEY"}
    second = [t for p in notes.iterdir() if p.name not in before for t in p.read_text().split("\n")]
    assert not {f"t{i}" for i in committed} & set(second) and len(second) == len(set(second))
    more = df.unionByName(spark.createDataFrame([(500, "new")], "id long, text string"))
    before = {p.name for p in notes.iterdir()}
    assert run(more).count() == 102
    assert [t for p in notes.iterdir() if p.name not in before for t in p.read_text().split("\n")] == ["new"]


# ---------------------------------------------------------------- metrics
@pytest.mark.parametrize(("keys", "fan_in", "held", "rounds"), [(["k"], 64, 4096, 2), (["k", "w"], 2, 1, 3), ([], 3, 4096, 1)])
def test_a_metric_of_the_user(spark, keys, fan_in, held, rounds):
    from polylogue.operators.user_metric import aggregate_metric

    class Span:
        """The count, least and greatest value, and the distinct words."""

        def init(self):
            return None

        def update(self, state, rows):
            values = [v for v in rows.column("v").to_pylist() if v is not None]
            new = (len(values), min(values, default=None), max(values, default=None), frozenset(rows.column("word").to_pylist()))
            return new if state is None else self.merge(state, new)

        def merge(self, a, b):
            if a is None or b is None:
                return a or b
            pick = lambda f, x, y: f([z for z in (x, y) if z is not None], default=None)
            return (a[0] + b[0], pick(min, a[1], b[1]), pick(max, a[2], b[2]), a[3] | b[3])

        def finish(self, state):
            return {"n": state[0], "low": state[1], "high": state[2], "words": len(state[3])}

    rng = random.Random(11)
    rows = [(rng.choice(("a", "b", None)), rng.choice("xyz"), rng.choice((None, rng.random()))) for _ in range(1500)]
    rows += [("nothing", "x", None)]
    df = spark.createDataFrame(rows, "k string, w string, v double").repartition(9)
    got = aggregate_metric(df.withColumn("word", F.col("w")), keys, ["v", "word"], Span(), ["n", "low", "high", "words"], fan_in, held, rounds)
    want = {}
    for k, w, v in rows:
        want.setdefault(tuple({"k": k, "w": w}[c] for c in keys), []).append((v, w))
    expected = {}
    for key, values in want.items():
        seen = [v for v, _ in values if v is not None]
        expected[key] = (float(len(seen)), min(seen, default=None), max(seen, default=None), float(len({w for _, w in values})))
    assert {tuple(r[c] for c in keys): (r["n"], r["low"], r["high"], r["words"]) for r in got.collect()} == expected


def test_co_located_tables_join_without_an_exchange(spark, sf):
    from polylogue.plans.q_metrics import _copartitioned_rows

    rows = _copartitioned_rows(spark, sf)
    text = plan(rows)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_sketches_stay_within_the_bound(spark):
    from polylogue.operators import distinct as D

    rows = [(g, i % 3, " ".join(f"{g}{(i * 37 + j * j) % (50 if g == 'few' else 40_000)}" for j in range(30))) for g in ("few", "many") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, part int, prediction string")
    sketches = D.ngram_sketches(df, ["g"], "part")
    exact = {r["g"]: r for r in D.distinct_n(df, ["g"]).collect()}
    for got in (D.distinct_n_estimated(sketches, ["g"]), D.distinct_n(df, ["g"], approx=True)):
        for r in got.collect():
            for c in ("distinct_1", "distinct_2"):
                assert abs(r[c] - exact[r["g"]][c]) <= D.ERROR * exact[r["g"]][c]
    again = D.merged_sketches(sketches, D.ngram_sketches(df.filter("part = 1"), ["g"], "part"), ["g"], "part")
    assert sorted(map(tuple, D.distinct_from_sketches(again, ["g"]).collect())) == sorted(map(tuple, D.distinct_from_sketches(sketches, ["g"]).collect()))
