"""Corpus BLEU with sufficient statistics, smoothing and effective order.

Statistics (clipped matches and totals for n = 1..4, system length, closest
reference length) are sums, so they are computed per row and then summed per
group; the score is column arithmetic on the summed row
(Papineni et al. 2002; Post 2018; Chen & Cherry 2014).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..functions.token_spans import form, prepared
from ..functions.tokenize import tokenize as tokenize_col

ORDER = 4
STAT_COLS = [f"m{n}" for n in range(1, ORDER + 1)] + [f"t{n}" for n in range(1, ORDER + 1)] + ["sys_len", "ref_len"]
# Default smoothing values per method.
SMOOTH_DEFAULTS = {"none": None, "floor": 0.1, "add-k": 1, "exp": None}
# Fixed value: the log used for a zero precision.
ZERO_LOG = -9999999999.0


def _closest_len(hyp_len: Column, ref_lens: Column) -> Column:
    """Length of the reference closest in length to the hypothesis; ties -> shorter."""
    best = F.array_min(F.transform(ref_lens, lambda r: F.struct(
        F.abs(r - hyp_len).alias("d"), r.alias("len"))))
    return F.coalesce(best["len"], F.lit(0)).cast("long")


def check_reference_counts(df: DataFrame, refs: str, keys: Sequence[str] = ()) -> DataFrame:
    """F16: per group, the smallest and largest number of references and whether they agree."""
    return df.groupBy(*keys).agg(
        F.min(F.size(refs)).cast("long").alias("min_refs"),
        F.max(F.size(refs)).cast("long").alias("max_refs"),
    ).withColumn("is_valid", F.col("min_refs") == F.col("max_refs"))


def bleu_stats(df: DataFrame, keys: Sequence[str], row_keys: Sequence[str],
               hypothesis: str = "prediction", references: str = "references",
               tokenize: str | Sequence[str] = "13a", lowercase: bool = False,
               method: str = "arrow", strict: bool = True, count: str | None = None, made: Mapping[str, str] | None = None) -> DataFrame:
    """Sufficient statistics per group, and with ``count`` its number of rows under that name.

    ``references`` is an ``ARRAY<STRING>`` column (or a plain string column for
    one reference). ``keys`` + ``row_keys`` must identify an input row.
    ``tokenize`` may list several tokenisers: a ``tokenizer`` key column is then added,
    all in one pass over the texts.
    ``tokenize=None`` means the columns already hold tokens: ``ARRAY<STRING>``
    for the hypothesis and ``ARRAY<ARRAY<STRING>>`` for the references.
    ``made`` names columns that hold the references in a form (see ``token_spans.form``) already, where rows share them.

    ``method="arrow"`` (default): ``mapInArrow`` cuts the texts of a bounded run of rows
    into tokens and counts their n-grams with numpy (``token_spans``), and emits 11 integers per
    row; only those are aggregated, so neither token nor n-gram ever crosses a shuffle.
    ``method="native"``: an explode of hypothesis and reference n-grams plus a
    length record per row, aggregated by (row, n, gram) after partitioning rows
    by their key. Same results, but several times slower at sf0.1: the per-gram
    hash aggregate is far larger than the per-batch counting.
    With ``strict``, a group whose rows have different numbers of references
    fails when evaluated, as the metric requires the same number for every
    prediction.
    """
    keys, row_keys = list(keys), list(row_keys)
    rtype = dict(df.dtypes)[references]
    if method not in ("arrow", "native"):
        raise ValueError(f"unknown method {method!r}")
    if tokenize is None:
        single = False
        base = df.select(*keys, *row_keys, F.col(hypothesis).alias("__h"), F.col(references).alias("__r"))
        stats = (_arrow_row_stats(base, keys, count=count) if method == "arrow"
                 else _native_stats(base, keys, row_keys, False))
        return _checked(stats, keys + ([count] if count else []), strict)
    single = not rtype.startswith("array")
    ref_arr = F.array(F.col(references)) if single else F.col(references)
    methods = [tokenize] if isinstance(tokenize, str) else list(tokenize)
    if method == "arrow":
        texts = _prepared_texts(df, keys, hypothesis, ref_arr, methods, lowercase, made)
        stats = _arrow_row_stats(texts, keys, methods, count)
        named = ["tokenizer"] if len(methods) > 1 else []
        if not named and not isinstance(tokenize, str):  # a list of one names its tokeniser too
            stats, named = stats.withColumn("tokenizer", F.lit(methods[0])), ["tokenizer"]
        return _checked(stats, [*named, *keys, *([count] if count else [])], strict and not single)

    def toks(method: str) -> list[Column]:
        return [tokenize_col(F.coalesce(F.col(hypothesis), F.lit("")), method, lowercase).alias("__h"),
                F.transform(ref_arr, lambda r: tokenize_col(F.coalesce(r, F.lit("")), method, lowercase))
                .alias("__r")]

    if isinstance(tokenize, str):
        base = df.select(*keys, *row_keys, *toks(tokenize))
    else:
        per = F.array(*[F.struct(F.lit(m).alias("tokenizer"), *toks(m)) for m in tokenize])
        base = (df.select(*keys, *row_keys, F.explode(per).alias("__x"))
                .select(*keys, *row_keys, "__x.tokenizer", "__x.__h", "__x.__r"))
        keys = ["tokenizer"] + keys
    return _checked(_native_stats(base, keys, row_keys, single), keys, strict and not single)


def _checked(stats: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    if strict:
        bad = F.col("__lo") != F.col("__hi")
        msg = F.lit("the same number of references is required for each prediction")
        return stats.select(*keys, *[F.when(bad, F.raise_error(msg)).otherwise(F.col(c)).alias(c)
                                     for c in STAT_COLS])
    return stats.drop("__lo", "__hi")


def _order_structs(toks: Column, j: Column) -> list[Column]:
    """(j, n, w=1, grams) for n = 1..4 of one token array."""
    return [F.struct(j.cast("int").alias("j"), F.lit(n).alias("n"), F.lit(1).cast("long").alias("w"),
                     ngrams(toks, n).alias("g")) for n in range(1, ORDER + 1)]


def _native_stats(base: DataFrame, keys: list[str], row_keys: list[str], single: bool) -> DataFrame:
    h, r = F.col("__h"), F.col("__r")
    ref_lens = F.transform(r, lambda x: F.size(x))
    one = F.array(F.lit(""))
    # n = 0 carries the closest reference length, n = -1 the number of references
    meta = [F.struct(F.lit(-1).alias("j"), F.lit(0).alias("n"), _closest_len(F.size(h), ref_lens).alias("w"),
                     one.alias("g")),
            F.struct(F.lit(-1).alias("j"), F.lit(-1).alias("n"), F.size(r).cast("long").alias("w"),
                     one.alias("g"))]
    outer = F.concat(F.array(*meta, *_order_structs(h, F.lit(-1))),
                     F.flatten(F.transform(r, lambda x, j: F.array(*_order_structs(x, j)))))
    # Rows are hash-partitioned by their row key first (one shuffle of token arrays).
    # Every later grouping key contains the row key, so the per-gram aggregation is
    # task-local: no n-gram record crosses the network.
    base = base.repartition(*keys, *row_keys)
    # outer explode: one record per (side, order); inner explode: one per n-gram
    recs = (base.select(*keys, *row_keys, F.explode(outer).alias("x"))
            .select(*keys, *row_keys, "x.j", "x.n", "x.w", F.explode("x.g").alias("gram")))
    gk = keys + row_keys + ["n", "gram"]
    if single:
        per_gram = recs.groupBy(*gk).agg(
            F.sum(F.when(F.col("j") < 0, F.col("w")).otherwise(0)).alias("cp"),
            F.sum(F.when(F.col("j") >= 0, F.col("w")).otherwise(0)).alias("cr"))
    else:
        per_ref = recs.groupBy(*gk, "j").agg(F.sum("w").alias("c"))
        per_gram = per_ref.groupBy(*gk).agg(
            F.coalesce(F.max(F.when(F.col("j") < 0, F.col("c"))), F.lit(0)).alias("cp"),
            F.coalesce(F.max(F.when(F.col("j") >= 0, F.col("c"))), F.lit(0)).alias("cr"))
    per_n = per_gram.groupBy(*keys, "n").agg(
        F.sum(F.least("cp", "cr")).alias("m"), F.sum("cp").alias("t"),
        F.min("cp").alias("lo"), F.max("cp").alias("hi"))
    pick = lambda c, n: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)).cast("long")
    return per_n.groupBy(*keys).agg(
        *[pick("m", n).alias(f"m{n}") for n in range(1, ORDER + 1)],
        *[pick("t", n).alias(f"t{n}") for n in range(1, ORDER + 1)],
        pick("t", 1).alias("sys_len"), pick("t", 0).alias("ref_len"),
        pick("lo", -1).alias("__lo"), pick("hi", -1).alias("__hi"))


#: Rows in a row whose references are counted together, if they are the same.
SHARED = 8


def _sequence_stats(codes, hyp_len, n_ref, ref_len, group=None):
    """Statistics of rows from the token codes of all hypotheses followed by those of all references (numpy, no per-row loop).

    Rows of one ``group`` (0, 1, ... in order, at most SHARED rows each; default: every row its own) have the same references:
    ``n_ref`` says how many for each group, and their codes come once.
    An n-gram's code is built from the group, the (n-1)-gram's code and the next token's code, numbered anew each order, so
    codes are exact (no hashing). A gram can only match where the one that it extends does, so others go no further.
    Returns an int64 array (rows x 11) in ``STAT_COLS`` order plus the number of references.
    """
    import numpy as np

    from ..functions.token_spans import dense

    rows = len(hyp_len)
    out = np.zeros((rows, len(STAT_COLS) + 1), dtype=np.int64)
    group = np.arange(rows) if group is None else group
    first = np.flatnonzero(np.diff(group, prepend=-1))
    slot = np.arange(rows) - first[group]  # of a row in its group
    slots = int(slot.max(initial=0)) + 1
    ref_group = np.repeat(np.arange(len(first)), n_ref)
    out[:, 8] = hyp_len
    out[:, 10] = n_ref[group]
    for n in range(1, ORDER + 1):
        out[:, 3 + n] = np.maximum(hyp_len - n + 1, 0)
    if len(ref_len):
        for s in range(slots):
            own = np.zeros(len(first), dtype=np.int64)  # length of the group's hypothesis in this slot
            own[group[slot == s]] = hyp_len[slot == s]
            key = np.abs(ref_len - own[ref_group]) * (1 << 32) + ref_len
            best = np.full(len(first), np.iinfo(np.int64).max, dtype=np.int64)
            np.minimum.at(best, ref_group, key)
            out[slot == s, 9] = np.where(n_ref > 0, best & ((1 << 32) - 1), 0)[group[slot == s]]
    if not len(codes):
        return out

    # every token position: its sequence (hypotheses first, then references), the sequence's end, group and slot
    seq_len = np.concatenate([hyp_len, ref_len])
    seq = np.repeat(np.arange(len(seq_len)), seq_len)
    end = np.cumsum(seq_len)[seq]
    of_group = np.concatenate([group, ref_group])[seq]
    n_h, width = int(hyp_len.sum()), int(codes.max()) + 1
    slot_at = slot[seq[:n_h]]
    row_in = np.zeros((len(first), slots), dtype=np.int64)
    row_in[group, slot] = np.arange(rows)
    single = rows == 0 or int(n_ref.max()) <= 1
    if single and ORDER * width.bit_length() + len(first).bit_length() + slots.bit_length() < 64:
        out[:, :ORDER] = _packed_matches(codes, end, of_group, np.append(slot_at, np.full(len(codes) - n_h, slots)), width, len(first), slots)[:, group, slot].T
        return out
    at, gram = np.arange(len(codes)), of_group
    for n in range(1, ORDER + 1):
        if not len(at):
            break
        gram = gram * width + codes[at + n - 1]
        size = int(gram.max()) + 1
        if size * slots > 4 * len(gram):  # else small enough to count in a table as it is
            gram = dense(gram)
            size = int(gram.max()) + 1
        cut = int(np.searchsorted(at, n_h))  # places stay in order
        said_of, ref_of = gram[:cut] * slots + slot_at[at[:cut]], gram[cut:]
        said = np.bincount(said_of, minlength=size * slots).reshape(size, slots)
        if single:
            wanted = np.bincount(ref_of, minlength=size)
        else:  # the most that any one reference has
            each, times = np.unique(ref_of * len(seq_len) + seq[at[cut:]], return_counts=True)
            wanted = np.zeros(size, dtype=np.int64)
            np.maximum.at(wanted, each // len(seq_len), times)
        group_of = np.zeros(size, dtype=np.int64)
        group_of[gram] = of_group[at]
        found = np.minimum(said, wanted[:, None]).ravel()
        hits = np.flatnonzero(found > 0)
        of = hits // slots
        times = np.bincount(row_in[group_of[of], hits - of * slots], weights=found[hits], minlength=rows)
        out[:, n - 1] = times.astype(np.int64)
        matched = np.zeros(size, dtype=bool)
        matched[of] = True
        renumbered = np.cumsum(matched) - 1
        match = np.concatenate([found[said_of] > 0, matched[ref_of]]) & (at + n < end[at])
        at, gram = at[match], renumbered[gram[match]]
    return out


def _packed_matches(codes, end, of_group, side, width, groups, slots):
    """(ORDER x groups x slots): clipped matches where a group, ORDER tokens and a side fit into one number, as characters do.

    ``side`` is the slot of a hypothesis, or ``slots`` for the reference. The numbers are sorted once: those that begin with the same
    n tokens then follow each other, for every n. What no reference has goes no further.
    """
    import numpy as np

    out = np.zeros((ORDER, groups, slots), dtype=np.int64)
    bits, low = width.bit_length(), slots.bit_length()
    at, ahead = np.arange(len(codes)), np.append(codes + 1, np.zeros(ORDER, np.int64))
    key = of_group
    for n in range(ORDER):  # 0 behind a sequence's end
        key = (key << bits) | np.where(at + n < end, ahead[n:n + len(codes)], 0)
    key = (key << low) | side
    key.sort()
    for n in range(1, ORDER + 1):
        gram = key >> (low + bits * (ORDER - n))
        if n > 1:
            whole = (gram & ((1 << bits) - 1)) > 0
            key, gram = key[whole], gram[whole]
        if not len(key):
            break
        new = np.append(True, gram[1:] != gram[:-1])
        number = np.cumsum(new) - 1
        size = int(number[-1]) + 1
        times = np.bincount(number * (slots + 1) + (key & ((1 << low) - 1)), minlength=size * (slots + 1)).reshape(size, slots + 1)
        found = np.minimum(times[:, :slots], times[:, slots:])
        of = gram[new] >> (bits * n)
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        out[n - 1, of[begins]] = np.add.reduceat(found, begins, axis=0)
        key = key[(found.max(axis=1) > 0)[number]]
    return out


def _shared(refs):
    """The groups of rows of a ``list<string>`` array: rows in a row with the same references, at most SHARED."""
    import numpy as np
    import pyarrow.compute as pc

    rows = len(refs)
    sizes = np.diff(_list_offsets(refs))
    k = int(sizes[0]) if rows else 0
    if not k or (sizes != k).any() or refs.null_count:
        return np.arange(rows)
    texts = refs.flatten()
    same = pc.equal(texts[k:], texts[:-k]).fill_null(False).to_numpy(zero_copy_only=False).reshape(-1, k).all(axis=1)
    new = np.concatenate(([True], ~same))
    run = np.flatnonzero(new)[np.cumsum(new) - 1]  # first row of a row's run
    new |= (np.arange(rows) - run) % SHARED == 0
    return np.cumsum(new) - 1


def _list_offsets(lists):
    import numpy as np

    offs = np.asarray(lists.offsets, dtype=np.int64)
    return offs - offs[0]


def _batch_stats(hyp, refs):
    """``_sequence_stats`` of every row of tokens: ``hyp`` is a ``list<string>`` array, ``refs`` a ``list<list<string>>`` array."""
    import numpy as np
    import pyarrow as pa

    from ..functions.token_spans import dense

    if not len(hyp):
        return np.zeros((0, len(STAT_COLS) + 1), dtype=np.int64)
    per_ref = refs.flatten()
    tokens = pa.concat_arrays([hyp.flatten().cast(pa.large_string()), per_ref.flatten().cast(pa.large_string())])
    return _sequence_stats(dense(tokens), np.diff(_list_offsets(hyp)), np.diff(_list_offsets(refs)), np.diff(_list_offsets(per_ref)))


def _batch_text_stats(hyp, refs, method):
    """``_sequence_stats`` of every row of prepared texts: ``hyp`` is a ``string`` array, ``refs`` a ``list<string>`` array; those of 13a come before its replacements."""
    return next(_text_stats({method: (hyp, refs)}))


def _text_stats(texts):
    """``_batch_text_stats`` of the same rows by each method of ``texts`` (hypotheses and references, by method), one after the other.

    Methods often cut most rows alike; groups of rows whose tokens are those of an earlier method have its statistics.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.token_spans import dense, single_codes, text_bytes, token_spans, with_plain_rules

    group, seen = None, []
    for method, (hyp, refs) in texts.items():
        group = _shared(refs) if group is None else group
        refs = refs.take(pa.array(np.flatnonzero(np.diff(group, prepend=-1))))  # rows that follow each other often share theirs
        ready = with_plain_rules if method == "13a" else lambda texts: texts
        said, said_offs = text_bytes(ready(hyp))
        wanted, wanted_offs = text_bytes(ready(refs.flatten()))
        tokens, counts = token_spans(np.concatenate([said, wanted]), np.concatenate([said_offs, len(said) + wanted_offs[1:]]), method)
        n_ref = np.diff(_list_offsets(refs))
        of = np.concatenate([group, np.repeat(np.arange(len(n_ref)), n_ref)])  # group of each text
        own, stats = np.ones(len(n_ref), dtype=bool), None  # groups to be counted
        for other, other_counts, known in seen:
            apart = np.zeros(len(n_ref), dtype=bool)
            apart[of[counts != other_counts]] = True
            if apart.sum() < own.sum() / 2:
                apart[of[_cut_otherwise(tokens, counts, other, other_counts)]] = True
                if apart.sum() < own.sum() / 2:
                    own, stats = apart, known.copy()
        codes_of = single_codes if method == "char" else dense
        if stats is None:
            stats = _sequence_stats(codes_of(tokens), counts[:len(hyp)], n_ref, counts[len(hyp):], group)
        elif own.any():
            mine = own[of]
            rows = mine[:len(hyp)]
            part = tokens.filter(pa.array(np.repeat(mine, counts)))
            stats[rows] = _sequence_stats(codes_of(part), counts[:len(hyp)][rows], n_ref[own], counts[len(hyp):][mine[len(hyp):]], (np.cumsum(own) - 1)[group[rows]])
        seen.append((tokens, counts, stats))
        yield stats


def _cut_otherwise(tokens, counts, other, other_counts):
    """Which texts have tokens that are not the same in ``other``? All, if the letters are not."""
    import numpy as np

    ends, other_ends = (np.frombuffer(t.buffers()[1], np.int64)[t.offset:t.offset + len(t) + 1] for t in (tokens, other))
    begin = ends[np.append(0, np.cumsum(counts))]
    letters, other_letters = (np.frombuffer(t.buffers()[2] or b"", np.uint8) for t in (tokens, other))
    if not np.array_equal(begin, other_ends[np.append(0, np.cumsum(other_counts))]) or not np.array_equal(letters, other_letters):
        return np.ones(len(counts), dtype=bool)
    differs = np.zeros(len(letters) + 1, dtype=bool)
    differs[ends] = True
    differs[other_ends] ^= True
    return np.diff(np.searchsorted(np.flatnonzero(differs), begin)) > 0


def _row_sizes(column):
    """Bytes, or tokens, of every row of texts, of lists, or of lists of lists."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not pa.types.is_list(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = _list_offsets(column)
    inner = column.flatten()
    if not (pa.types.is_list(inner.type) or pa.types.is_string(inner.type)):
        return np.diff(offs)
    return np.diff(np.concatenate(([0], np.cumsum(_row_sizes(inner))))[offs])


def _row_stats_batches(batches, key_cols, methods):
    """Arrow path: per-row statistics, one output row per input row and method; a bounded run of rows is expanded at once."""
    import numpy as np
    import pyarrow as pa

    from ..functions.token_spans import release, runs

    names = STAT_COLS + ["nref"]
    for rb in batches:
        columns = {}
        for method in methods:
            suffix = f"_{form(method)}" if method else ""
            if f"__h{suffix}" not in rb.schema.names:  # 13a beside a method that reads texts as they are
                suffix = "_plain"
            columns[method] = rb.column(f"__h{suffix}"), rb.column(f"__r{suffix}")
        found = {method: [np.zeros((0, len(names)), dtype=np.int64)] for method in methods}
        sizes = np.max([_row_sizes(hyp) + _row_sizes(refs) for hyp, refs in {id(c[0]): c for c in columns.values()}.values()], axis=0)
        for lo, hi in runs(sizes):
            part = {method: tuple(c.slice(lo, hi - lo) for c in columns[method]) for method in methods}
            if len(methods) == 1:
                method = methods[0]
                found[method].append(_batch_text_stats(*part[method], method) if method else _batch_stats(*part[method]))
                continue
            for method, stats in zip(methods, _text_stats(part), strict=True):
                found[method].append(stats)
        for method in methods:
            stats = np.concatenate(found[method])
            named = {"tokenizer": pa.array([method] * len(stats), pa.string())} if len(methods) > 1 else {}
            arrays = [*named.values(), *[rb.column(k) for k in key_cols], *[pa.array(stats[:, i]) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*named, *key_cols, *names])
        release()


def _arrow_rows(base: DataFrame, key_cols: list[str], methods: Sequence[str | None] = (None,)) -> DataFrame:
    """Statistics of every row, with the number of its references; several ``methods`` add a ``tokenizer`` column."""
    fields = [f"`{k}` {t}" for k, t in base.select(*key_cols).dtypes] + [f"{c} long" for c in STAT_COLS + ["nref"]]
    schema = ", ".join((["tokenizer string"] if len(methods) > 1 else []) + fields)
    return base.mapInArrow(lambda it: _row_stats_batches(it, key_cols, methods), schema)


def _prepared_texts(df: DataFrame, keep: Sequence[str], hypothesis: str, ref_arr: Column, methods: Sequence[str], lowercase: bool,
                    made: Mapping[str, str] | None = None) -> DataFrame:
    """(keep..., __h_<form>, __r_<form>...): the texts in every form that ``methods`` read, those of 13a before its replacements:
    ``plain`` serves for them too, and tasks make their form where a text needs one."""
    out = [F.col(c) for c in keep]
    forms = {form(m) for m in methods}
    for name in sorted(forms - {"13a"} if "plain" in forms else forms):
        as_read = partial(prepared, method="intl" if name == "intl" else "none", lowercase=lowercase)
        refs = F.col(made[name]) if name in (made or {}) else F.transform(ref_arr, lambda r: as_read(r))  # noqa: B023
        out += [as_read(hypothesis).alias(f"__h_{name}"), refs.alias(f"__r_{name}")]
    return df.select(*out)


def sentence_bleu(df: DataFrame, keys: Sequence[str], hypothesis: str, reference: str, tokenize: str = "13a",
                  lowercase: bool = False, smooth_method: str = "exp", smooth_value: float | None = None,
                  use_effective_order: bool = True) -> DataFrame:
    """(keys..., score, p1..p4, bp) of every row on its own; nothing is shuffled."""
    base = _prepared_texts(df, list(keys), hypothesis, F.array(reference), [tokenize], lowercase)
    return bleu_score(_arrow_rows(base, list(keys), [tokenize]).drop("nref"), smooth_method, smooth_value, use_effective_order)


def _arrow_row_stats(base: DataFrame, keys: list[str], methods: Sequence[str | None] = (None,), count: str | None = None) -> DataFrame:
    # the row keys are not needed: a row's statistics are made whole in one place
    return (_arrow_rows(base, keys, methods).groupBy(*(["tokenizer"] if len(methods) > 1 else []), *keys)
            .agg(*[F.sum(c).cast("long").alias(c) for c in STAT_COLS], *([F.count(F.lit(1)).alias(count)] if count else []),
                 F.min("nref").alias("__lo"), F.max("nref").alias("__hi")))


def score_columns(smooth_method: str = "exp", smooth_value: float | None = None,
                  use_effective_order: bool = False) -> dict[str, Column]:
    """Column expressions ``score``, ``p1..p4`` and ``bp`` over m1..m4, t1..t4,
    sys_len and ref_len.

    Orders are visited 1..4 and stop at the first order with no n-grams.
    A zero match count is smoothed: ``exp`` 100/(2^z * total) with z the number of
    zero orders so far; ``floor`` 100*value/total; ``add-k`` adds value to counts and
    totals for n > 1; ``none`` leaves 0. Any zero precision makes the score 0.
    If all four raw match counts are 0, score and precisions are 0; bp depends on
    the lengths alone (as the public library has it from version 2.0 on).
    """
    if smooth_method not in SMOOTH_DEFAULTS:
        raise ValueError(f"unknown smooth_method {smooth_method!r}; choose one of: {', '.join(SMOOTH_DEFAULTS)}")
    v = SMOOTH_DEFAULTS[smooth_method] if smooth_value is None else smooth_value
    reached = F.lit(True)
    zeros = F.lit(0)
    n_reached = F.lit(0)
    precisions = []
    for n in range(1, ORDER + 1):
        c = F.col(f"m{n}").cast("double")
        t = F.col(f"t{n}").cast("double")
        if smooth_method == "add-k" and n > 1:
            c, t = c + F.lit(float(v)), t + F.lit(float(v))
        reached = reached & (t > 0)
        n_reached = n_reached + F.when(reached, 1).otherwise(0)
        is_zero = reached & (c == 0)
        zeros = zeros + F.when(is_zero, 1).otherwise(0)
        if smooth_method == "exp":
            smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t)
        elif smooth_method == "floor":
            smoothed = F.lit(100.0 * float(v)) / t
        else:
            smoothed = F.lit(0.0)
        precisions.append(F.when(~reached, F.lit(0.0)).when(c == 0, smoothed)
                          .otherwise(F.lit(100.0) * c / t))
    eff = (F.when(n_reached > 0, n_reached).otherwise(F.lit(ORDER)) if use_effective_order
           else F.lit(ORDER))
    logsum = sum((F.when(F.lit(n) <= eff, F.when(p > 0, F.log(p)).otherwise(F.lit(ZERO_LOG)))
                  .otherwise(F.lit(0.0)) for n, p in enumerate(precisions, start=1)), F.lit(0.0))
    sys_len, ref_len = F.col("sys_len").cast("double"), F.col("ref_len").cast("double")
    bp = (F.when(sys_len < ref_len, F.when(sys_len > 0, F.exp(F.lit(1.0) - ref_len / sys_len))
                 .otherwise(F.lit(0.0))).otherwise(F.lit(1.0)))
    no_match = (F.col("m1") == 0) & (F.col("m2") == 0) & (F.col("m3") == 0) & (F.col("m4") == 0)
    zero = F.lit(0.0)
    out = {"score": F.when(no_match, zero).otherwise(bp * F.exp(logsum / eff))}
    for n, p in enumerate(precisions, start=1):
        out[f"p{n}"] = F.when(no_match, zero).otherwise(p)
    out["bp"] = bp
    return out


def bleu_score(stats: DataFrame, smooth_method: str = "exp", smooth_value: float | None = None,
               use_effective_order: bool = False, keep_stats: bool = False) -> DataFrame:
    """Add ``score``, ``p1..p4`` and ``bp`` (see ``score_columns``) to a statistics table."""
    cols = score_columns(smooth_method, smooth_value, use_effective_order)
    out = stats.select("*", *[c.alias(name) for name, c in cols.items()])
    return out if keep_stats else out.drop(*STAT_COLS)


def corpus_bleu(df: DataFrame, keys: Sequence[str], row_keys: Sequence[str],
                hypothesis: str = "prediction", references: str = "references",
                smooth_method: str = "exp", smooth_value: float | None = None,
                force: bool = False, lowercase: bool = False, tokenize: str = "13a",
                use_effective_order: bool = False, method: str = "arrow",
                keep_stats: bool = True) -> DataFrame:
    """BLEU per group. ``force`` is accepted for compatibility; it changes no value."""
    del force
    stats = bleu_stats(df, keys, row_keys, hypothesis, references, tokenize, lowercase, method)
    return bleu_score(stats, smooth_method, smooth_value, use_effective_order, keep_stats)
