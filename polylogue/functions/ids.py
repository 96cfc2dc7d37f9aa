"""Token-id list functions (truncate, pad, mask labels)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import _col

# Reserved ids and the label sentinel.
PAD_ID = 0
EOS_ID = 1
UNK_ID = 2
IGNORE_ID = -100


def truncate(ids, max_len: int | Column | None, eos: bool = True, end: int | str = EOS_ID) -> Column:
    """keep at most ``max_len`` ids or tokens, the end mark included."""
    x = _col(ids)
    if max_len is not None:
        most = F.lit(max_len) if isinstance(max_len, int) else max_len
        x = F.slice(x, F.lit(1), F.greatest(most - 1, F.lit(0)) if eos else most)
    return F.concat(x, F.array(F.lit(end))) if eos else x


def target_max_length(split: Column, train_len: int, eval_len: int | None = None) -> Column:
    """targets use ``train_len`` for training and ``eval_len`` (default: the
    same) for validation and test."""
    ev = train_len if eval_len is None else eval_len
    return F.when(split == "train", F.lit(train_len)).otherwise(F.lit(ev))


def pad_to(ids, length, pad: int = PAD_ID) -> Column:
    """F8: right-pad with ``pad`` to ``length`` (longer lists are left as they are)."""
    x = _col(ids)
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(x, F.array_repeat(F.lit(pad).cast("long"), F.greatest(n - F.size(x), F.lit(0)).cast("int")))


def mask_pad(labels, pad: int = PAD_ID) -> Column:
    """pad id -> -100 in labels."""
    return F.transform(_col(labels), lambda v: F.when(v == pad, F.lit(IGNORE_ID)).otherwise(v))


def unmask_pad(labels, pad: int = PAD_ID) -> Column:
    """-100 -> pad id before decoding."""
    return F.transform(_col(labels), lambda v: F.when(v == IGNORE_ID, F.lit(pad)).otherwise(v))


def pad_batches(df: DataFrame, ids: str, pos: str, batch_size: int, multiple: int | None = None,
                pad: int = PAD_ID, out: str = "padded", by: Sequence[str] = ()) -> DataFrame:
    """dynamic padding: rows in batches of ``batch_size`` consecutive
    positions (of a group ``by``) are padded to the longest row of their batch, rounded up to
    ``multiple``. Each window holds one batch."""
    batch = F.floor(F.col(pos) / batch_size).cast("long")
    longest = F.max(F.size(ids)).over(Window.partitionBy(*by, "batch_id"))
    width = (F.ceil(longest / multiple) * multiple).cast("int") if multiple else longest
    return (df.withColumn("batch_id", batch)
            .withColumn("padded_len", width.cast("long"))
            .withColumn(out, pad_to(F.col(ids), F.col("padded_len"), pad)))
