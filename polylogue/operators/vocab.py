"""vocabulary, token -> id encoding and id -> text decoding.

The vocabulary is a table of any size. Encoding cuts each row's tokens to the
length that can be kept and looks up the distinct tokens of blocks of rows, so a token moves once for each
block; the rows of a block are then encoded together. Decoding explodes the ids with their positions, looks them up
and rebuilds the ordered list per row. Its lookup is split: ids that a sketch finds frequent (a few words are half of
any text) are settled by a broadcast table of bounded size, the others by an ordinary join, so that no
token's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.ids import EOS_ID, PAD_ID, UNK_ID
from ..functions.text import split_space
from ..session import written
from .index import nested_offsets

SPECIAL_IDS = (PAD_ID, EOS_ID, UNK_ID)
#: Values of the broadcast table, values that a task's sketch follows, and bytes of a token that may be in the table.
HOT, FOLLOWED, HOT_BYTES = 2048, 1 << 14, 1024
#: Tokens that one task puts in order.
BUCKET = 1 << 16
#: Bytes of tokens of a block of rows, whose distinct tokens are looked up once.
BLOCK_BYTES = 8 << 20


def build_vocab(texts: DataFrame, cols: Sequence[str], first_id: int = 3, most: int = BUCKET) -> DataFrame:
    """(token, id) of all space-separated tokens, the most frequent first (ties by token), ids from ``first_id``.

    Ids are positions counted in buckets of equal frequency and leading characters (see
    ``prefix_buckets``), so no task sorts the whole vocabulary. The counts are stored first.
    """
    toks = texts.select(F.explode(F.concat(*[split_space(F.col(c)) for c in cols])).alias("token"))
    counts = written(toks.groupBy("token").agg((-F.count(F.lit(1))).alias("__neg")), "vocabulary-counts")
    placed = prefix_buckets(counts, "__neg", "token", most)
    sizes = placed.groupBy("__neg", "__start").agg(F.count(F.lit(1)).alias("__n"))
    first = [F.substring("__start", 1, n).alias(f"__c{n}") for n in (1, 2)]
    offsets = nested_offsets(sizes.select("__neg", *first, "__start", "__n"), ["__neg", "__c1", "__c2", "__start"], "__n", "__off")
    rank = F.row_number().over(Window.partitionBy("__neg", "__start").orderBy("token")) - 1
    return (placed.withColumn("__rank", rank).join(offsets.select("__neg", "__start", "__off"), ["__neg", "__start"])
            .select("token", (F.col("__off") + F.col("__rank") + first_id).cast("long").alias("id")))


def prefix_buckets(counts: DataFrame, group: str, token: str, most: int = BUCKET, letters: int = 3) -> DataFrame:
    """``counts`` with ``__start``, the leading characters of ``token`` (distinct in a ``group``) that name its bucket.

    An adaptive directory: a bucket is named by ``letters`` characters, and one that holds more than ``most`` tokens of a
    group is split by twice as many, until each fits or its tokens are spelled out. Names of buckets sort as their tokens do.
    """
    placed = counts.withColumn("__start", F.substring(token, 1, letters))
    while True:
        longer = 2 * letters
        big = written(placed.groupBy(group, "__start").agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > most) & (F.char_length("__start") == letters))
                      .select(group, "__start", F.lit(True).alias("__big")), "vocabulary-directory")
        n_big = big.count()
        if not n_big:
            return placed
        marked = placed.join(F.broadcast(big) if n_big <= most else big, [group, "__start"], "left")
        placed = marked.withColumn("__start", F.when(F.col("__big"), F.substring(token, 1, longer)).otherwise(F.col("__start"))).drop("__big")
        letters = longer


def frequent(values: DataFrame, column: str, most: int = HOT, followed: int = FOLLOWED) -> DataFrame:
    """(column): at most ``most`` values, with all that are more than about one in ``followed`` / 4 of the rows.

    Each task keeps a sketch of ``followed`` counters and the sketches are merged, so no value moves. A
    token over HOT_BYTES bytes is left out, which bounds the table to ``most`` x HOT_BYTES.
    """
    kind = dict(values.dtypes)[column]
    usable = values.select(column).filter(F.octet_length(column) <= HOT_BYTES if kind == "string" else F.col(column).isNotNull())
    found = usable.agg(F.expr(f"approx_top_k(`{column}`, {most}, {followed})").alias("top")).first()["top"]
    return values.sparkSession.createDataFrame([(x["item"],) for x in found or []], f"`{column}` {kind}")


def looked_up(rows: DataFrame, keys: Sequence[str], key: str, table: DataFrame, value: str, hot: DataFrame) -> DataFrame:
    """(keys..., __i, value): ``rows`` with ``value`` of the row of ``table`` that has the same ``key``, else null; ``keys`` and ``__i`` identify a row.

    Values of ``hot``, which is bounded, come from a broadcast table. Rows that are settled, or have nothing to look
    up, pass the join under keys of their own that spread over all tasks and meet nothing.
    """
    spark = rows.sparkSession
    kinds = dict(table.dtypes)
    named = {r[key]: r[value] for r in table.select(key, value).join(F.broadcast(hot), key).collect()}
    settled = spark.createDataFrame([(r[key], named.get(r[key])) for r in hot.collect()], f"`{key}` {kinds[key]}, __hot {kinds[value]}").withColumn("__settled", F.lit(True))
    own = F.xxhash64(*keys, "__i")
    # no token holds a space, and no id is negative
    nowhere = F.concat(F.lit(" "), own.cast("string")) if kinds[key] == "string" else -1 - F.shiftrightunsigned(own, 1)
    split = rows.join(F.broadcast(settled), key, "left")
    sent = split.withColumn(key, F.when(F.col("__settled") | F.col(key).isNull(), nowhere).otherwise(F.col(key)))
    return sent.join(table.select(key, F.col(value).alias("__tail")), key, "left").select(*keys, "__i", F.coalesce("__hot", "__tail").alias(value))


def _inner(vocab: DataFrame) -> DataFrame:
    """The vocabulary under names that no key column has."""
    return vocab.select(F.col("token").alias("__token"), F.col("id").alias("__id"))


def encode(df: DataFrame, keys: Sequence[str], text: str | Column, vocab: DataFrame,
           max_len: int | Column | None = None, out: str = "ids", hot: DataFrame | None = None) -> DataFrame:
    """(keys..., out ARRAY<BIGINT>): ids of the text's tokens (unknown -> 2),
    truncated so that the appended end-of-sequence id fits in ``max_len``.
    ``keys`` must identify a row. ``hot`` (token) names frequent tokens, which are then settled by a broadcast table."""
    return encode_columns(df, keys, {out: (text, max_len)}, vocab, hot)


def encode_columns(df: DataFrame, keys: Sequence[str], texts: Mapping[str, tuple[str | Column, int | Column | None]], vocab: DataFrame,
                   hot: DataFrame | None = None) -> DataFrame:
    """(keys..., columns...): ``encode`` of several texts of a row, by column a text and the length that can be kept.

    Rows are stored in blocks of about BLOCK_BYTES of tokens. A block's distinct tokens are looked up, so a token moves once for each block
    and not once for each place, and come back to the block as a table, with which its rows are encoded in one go.
    """
    keys, names = list(keys), {f"__t{i}": name for i, name in enumerate(texts)}
    cut = []
    for column, (text, max_len) in zip(names, texts.values(), strict=True):
        tokens = split_space(F.col(text) if isinstance(text, str) else text)
        if max_len is not None:
            most = F.lit(max_len) if isinstance(max_len, int) else max_len
            tokens = F.slice(tokens, F.lit(1), F.greatest(most - 1, F.lit(0)))
        cut.append(F.coalesce(tokens, F.array().cast("array<string>")).alias(column))
    number = {k: f"__k{i}" for i, k in enumerate(keys)}
    rows = df.select(*keys, *cut).toDF(*number.values(), *names)
    schema = StructType([*rows.schema.fields, StructField("__block", LongType())])
    rows = written(rows.mapInArrow(lambda it: _in_blocks(it, list(names)), schema), "encoded-rows", "zstd")
    wanted = rows.select("__block", *names).mapInArrow(_tokens_of_blocks, "__block long, __token string")
    if hot is None:
        found = wanted.join(_inner(vocab), "__token").select("__block", "__token", "__id")
    else:
        # a block and a token identify a row
        marked = wanted.select("__block", "__token", F.xxhash64("__token").alias("__i"), F.col("__token").alias("__said"))
        found = (looked_up(marked, ["__block", "__said"], "__token", _inner(vocab), "__id", hot.select(F.col("token").alias("__token")))
                 .filter("__id is not null").select("__block", F.col("__said").alias("__token"), "__id").distinct())
    found = written(found, "block-vocabulary", "zstd")
    kept = [f for f in schema.fields if f.name in number.values()]
    ids = rows.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(
        lambda block, known: _encoded_block(block, known, [f.name for f in kept], list(names)), StructType([*kept, *[StructField(n, ArrayType(LongType())) for n in names]]))
    # what comes several times under its keys is one row, place by place
    gathered = ids.groupBy(*number.values()).agg(*[F.collect_list(n).alias(n) for n in names])
    placed = lambda x: F.transform(x, lambda t, i: F.struct(i.alias("i"), t.alias("id")))
    whole = lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))).otherwise(F.sort_array(F.flatten(F.transform(n, placed)))["id"])
    return gathered.select(*[F.col(v).alias(k) for k, v in number.items()],
                           *[F.concat(whole(n), F.array(F.lit(EOS_ID).cast("long"))).alias(name) for n, name in names.items()])


def _in_blocks(batches, columns: list[str]):
    """The rows with ``__block``, the number of a run of a task's rows of about BLOCK_BYTES of tokens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    block, size = TaskContext.get().partitionId() << 32, 0
    for rb in batches:
        yield rb.append_column("__block", pa.array(np.full(rb.num_rows, block)))
        size += sum(pc.sum(pc.binary_length(rb.column(c).flatten())).as_py() or 0 for c in columns)
        if size >= BLOCK_BYTES:
            block, size = block + 1, 0


def _tokens_of_blocks(batches):
    """(__block, __token): the distinct tokens of each block, as far as a task reads it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    now, held = None, []

    def said() -> pa.RecordBatch:
        tokens = pc.unique(pa.concat_arrays(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), now)), tokens], ["__block", "__token"])

    for rb in batches:
        block = rb.column("__block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if now is not None and block[lo] != now:
                yield said()
                held = []
            now = block[lo]
            part = rb.slice(lo, hi - lo)
            held.append(pc.unique(pa.concat_arrays([part.column(c).flatten() for c in range(1, part.num_columns)])))
    if held:
        yield said()


def _encoded_block(block, known, keys: list[str], columns: list[str]):
    """The rows of a block with the ids of their tokens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    said, ids = (known.column(c).combine_chunks() for c in ("__token", "__id"))
    out = []
    for c in columns:
        lists = block.column(c).combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        offs = np.asarray(lists.offsets)
        found = pc.fill_null(ids.take(pc.index_in(lists.flatten(), value_set=said)), UNK_ID)
        out.append(pa.ListArray.from_arrays(pa.array(offs - offs[0]), found))
    return pa.table([*[block.column(k) for k in keys], *out], names=[*keys, *columns])


def decode(df: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame, out: str = "text", hot: DataFrame | None = None) -> DataFrame:
    """Ids back to space-joined tokens, dropping the special ids (pad, eos, unk), which are
    not looked up. ``hot`` (id) names the frequent ids where they are known; else they are found."""
    keys = list(keys)
    kept = F.filter(ids, lambda x: ~x.isin(*SPECIAL_IDS))
    exploded = df.select(*keys, F.posexplode_outer(kept).alias("__i", "__id"))
    hot = frequent(exploded, "__id") if hot is None else hot.select(F.col("id").alias("__id"))
    found = looked_up(exploded, keys, "__id", _inner(vocab), "__token", hot)
    item = F.when(F.col("__token").isNotNull(), F.struct("__i", "__token"))
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("__s")).select(
        *keys, F.array_join(F.col("__s.__token"), " ").alias(out))
