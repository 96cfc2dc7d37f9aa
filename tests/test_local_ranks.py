"""Positions of sorted ranges, numbered while they are written."""

from pyspark.sql import functions as F

from polylogue import fixtures as fx
from polylogue.operators.index import file_order_index, with_global_ranks, with_local_ranks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_equal_a_plain_count(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, s int").repartitionByRange(6, "g", "id").sortWithinPartitions("g", "id")
    by = {"pos": ["g"], "at": ["g", "s"], "all": []}
    with_local_ranks(df, by).write.parquet(str(tmp_path / "t"))
    got = {r["id"]: (r["pos"], r["at"], r["all"]) for r in with_global_ranks(spark.read.parquet(str(tmp_path / "t")), by).collect()}
    order = sorted(rows, key=lambda r: (r[1] or "", r[0]))
    want = {r[0]: (sum(x[1] == r[1] for x in order[:i]), sum(x[1:] == r[1:] for x in order[:i]), i) for i, r in enumerate(order)}
    assert got == want


def test_pairs_get_the_positions_of_the_plain_index(spark, tmp_path):
    """Null and repeated ids too; the texts of the pairs are neither joined by a shuffle nor sorted when read."""
    docs = [(None if i % 9 == 0 else i // 2, "\n".join(f"l{i // 2} {j}" if j % 4 else " " for j in range(i % 6 + 2)), "en" if i % 3 else "de") for i in range(120)]
    docs += [(5, None, "en"), (6, "a\nb", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1)}).write.parquet(str(tmp_path / "documents.parquet"))
    found, plain = fx.lang_pairs(spark, str(tmp_path)), fx.build_lang_pairs(spark, str(tmp_path))
    assert found.columns == plain.columns
    for out, by in fx.POSITIONS.items():  # rows of equal ids have no order among themselves
        ids = lambda df: sorted(map(str, df.select(*by, out, "doc_id", "line_pos").collect()))  # noqa: B023, E731
        assert ids(found) == ids(plain)
    assert sorted(map(str, found.drop(*fx.POSITIONS).collect())) == sorted(map(str, plain.drop(*fx.POSITIONS).collect()))
    text = plan(found)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_files_are_numbered_where_they_are_read(spark, tmp_path):
    """No row of a file moves for its position; positions restart in each folder and follow part numbers, blocks and null groups."""
    for name, parts in {"a": 3, "b": 1}.items():
        spark.range(1000).select(F.format_string(f"{name}%04d", "id").alias("value")).repartitionByRange(parts, "value").write.text(f"{tmp_path}/{name}")
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = file_order_index(spark.read.text([f"{tmp_path}/a", f"{tmp_path}/b"]), dir_col="folder")
        assert df.rdd.getNumPartitions() > 8
        got = {(r["folder"].rsplit("/", 1)[1], r["value"]): r["pos"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert got == {(n, f"{n}{i:04d}"): i for n in "ab" for i in range(1000)}
    text = df._jdf.queryExecution().executedPlan().toString()
    main = text[:text.index("BroadcastExchange")]  # the plan of the rows themselves comes before that of the splits' counts
    assert "Exchange" not in main and "Sort" not in main


def test_a_column_of_the_files_gives_way_to_the_position(spark, tmp_path):
    rows = spark.createDataFrame([(f"{9 - i}", f"x {i}") for i in range(10)], "pos string, `a ?. (b)` string").coalesce(1)
    rows.write.option("header", "true").csv(str(tmp_path / "t"))
    got = file_order_index(spark.read.option("header", "true").csv(str(tmp_path / "t")))
    assert got.columns == ["pos", "a ?. (b)"] and sorted(map(tuple, got.collect())) == [(i, f"x {i}") for i in range(10)]


def test_documents_move_before_they_are_cut(spark, sf):
    """A line is in two pairs: the shuffle has each text once, and the pairs are those of the table."""
    df = fx.pairs_in_order(spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange rangepartitioning") == 1 and text.index("Generate") < text.index("Exchange rangepartitioning")  # leaves come last
    cols = ["pair_id", "lang", "doc_id", "line_pos", "context", "response", "split"]
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(map(tuple, fx.pairs_from_documents(spark, sf).select(cols).collect()))


def test_evaluation_moves_outputs_of_its_splits_once(spark, sf):
    """Outputs made from a training row never reach the join with the places of the evaluated rows."""
    pairs = fx.lang_pairs(spark, sf).filter("lang <> 'en'")
    some = fx.build_predictions(spark, sf, pairs, ("test", "validation"))
    places = pairs.filter("split <> 'train'").select("lang", "pos")
    whole = fx.build_predictions(spark, sf, pairs)
    assert sorted(map(tuple, some.join(places, ["lang", "pos"]).collect())) == sorted(map(tuple, whole.join(places, ["lang", "pos"]).collect()))
    sizes = {r["system"]: r["count"] for r in some.groupBy("system").count().collect()}
    assert sizes["fs"] == pairs.count() and {sizes[s] for s in fx.SYSTEMS if s != "fs"} == {places.count()}
