"""N-gram Jaccard join: size-banded tiles with bitmap signatures, then exact intersection.

A text's set holds its distinct five-word shingles as 64-bit hashes. Texts with
equal sets become one class, which its smallest doc_id represents. Two sets with
similarity >= 3/4 must share one of the n - ceil(3n/4) + 1 first shingles of each
under any fixed order, so only sets that meet on such a prefix shingle and lie
in the same or neighbouring size bands (tiles) are compared. The order puts
shingles that are frequent in the corpus last; it affects the work only.

A pair is first bounded: with h differing bits between two hashed bitmaps of
the same width, the sets share at most (n_a + n_b - h) / 2 shingles. Pairs that
the bound leaves are decided by intersecting the sorted arrays. A first round
links each set with one smaller id of its buckets, so that a large group of copies
costs a star and not all its pairs. The second round looks only at buckets that
still hold several components, at pairs across components that share as many
prefix shingles as a link must. In buckets with many such pairs (a passage that many
texts share) these shingles are counted against blocks of sets, an index in
the task's memory. Pairs with enough of them are intersected there, and only links that join
components come out. So no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, salted_left_join, shingle_sets, stored, text_chunks, without

#: A shingle in more than this share of the texts is ordered last. The share bounds
#: their number by (mean set size / share), whatever the corpus; the list is cut at HOT_MAX.
HOT_SHARE, HOT_MAX = 1 / 2000, 1_000_000
#: Shingles that a task counts together when it looks for frequent ones, and the part of the
#: hash range it looks at: prefixes, the first quarter in order of the hashes, rarely reach beyond.
WINDOW, REACH = 750_000, 0.4
#: Up to so many ids, those to be verified are broadcast (8 bytes each); beyond, they are joined.
IDS_MAX = 500_000
#: Up to so many possible links between components, all are looked at in one round.
AT_ONCE = 50_000
#: A bucket is heavy if its pairs across components are more than HEAVY times its rows; bytes of the sets of
#: heavy buckets that are sent to the tasks as one index.
HEAVY, BLOCK_BYTES = 4, 16 << 20
#: Places of a block's index that a task looks at together.
MEETINGS = 1 << 20


def _frequent(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, n_docs = [], 0, 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= max(3, share * n_docs / 2)
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "text"):
                h = shingle_sets(data, offs)[1]
                h = h[h < np.uint64(int(REACH * 2**64))]
                held.append(h)
                n_held, n_docs = n_held + len(h), n_docs + hi - lo
                if n_held >= WINDOW:
                    yield flush()
                    held, n_held, n_docs = [], 0, 0
        yield flush()

    return run


def frequent_shingles(docs: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Shingles found in about ``share`` of the texts or more, rarest first (an order for the prefixes, at most HOT_MAX).

    Tasks report what stands out among their own texts, so a count is a lower bound, and a quarter of it is asked for.
    """
    least = max(3.0, share * docs.count() / 4)
    rows = (docs.select("text").mapInArrow(_frequent(share), "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .orderBy(F.desc("n"), "shingle").limit(HOT_MAX).toPandas())
    return rows["shingle"].to_numpy(np.int64)[::-1].view(np.uint64)


def _bitmap(h: np.ndarray) -> bytes:
    """Bits set by the hashes; the width is the power of two from 2n on, 64 at least, so that one folds into another."""
    bits = max(64, 1 << int(2 * len(h) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(h >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.int64)


def _prefix_lists(row: np.ndarray, h: np.ndarray, ends: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> list[np.ndarray | None]:
    """The n - ceil(3n/4) + 1 first shingles of each row's set; those of ``hot`` (sorted) come last, in order of ``rank``."""
    key = h >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        is_hot = hot[at] == h
        key[is_hot] = np.uint64(1 << 63) + rank[at[is_hot]]
    order = np.lexsort((h, key, row))  # equal keys (two shingles that differ in the dropped bit) are settled by the hash
    ordered = h[order].view(np.int64)
    size = np.diff(ends)
    return [ordered[a:a + n - (3 * n + 3) // 4 + 1] if n else None for a, n in zip(ends[:-1].tolist(), size.tolist(), strict=True)]


def _describe(hot, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "text"):
                row, h = shingle_sets(data, offs)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                prefixes = _prefix_lists(row, h, ends, hot.value, order.value)
                keys, maps = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    keys.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    maps.append(_bitmap(h[a:b]) if b > a else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ends).astype(np.int64)), pa.array(keys, pa.binary()),
                     pa.array(maps, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "n", "set_key", "bitmap", "prefix"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch, "text"):
            row, h = shingle_sets(data, offs)
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), values], ["doc_id", "shingles"])


def _bitmap_bound() -> F.Column:
    """Most shingles that a and b can share: the wider bitmap is folded to the narrower width, differing bits counted."""
    wide = lambda x: F.col(f"{x}.bitmap")
    width = F.least(F.size(wide("a")), F.size(wide("b")))

    def word(x: str, i: F.Column) -> F.Column:
        folds = (F.size(wide(x)) / width).cast("int")
        return F.when(folds == 1, F.get(wide(x), i)).otherwise(
            F.aggregate(F.sequence(F.lit(0), folds - 1), F.lit(0).cast("long"), lambda acc, f: acc.bitwiseOR(F.get(wide(x), i + f * width))))

    differing = F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0), lambda acc, i: acc + F.bit_count(word("a", i).bitwiseXOR(word("b", i))))
    return F.floor((F.col("a.n") + F.col("b.n") - differing) / 2)


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs (structs a, b) whose sizes and bitmaps allow 100 * shared >= 75 * union."""
    na, nb = F.col("a.n"), F.col("b.n")
    sizes = pairs.where((4 * F.least(na, nb) >= 3 * F.greatest(na, nb)))
    return sizes.where(7 * _bitmap_bound() >= 3 * (na + nb))


_SETS = "doc_id long, shingles array<long>"


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): the components la and lb of those ``pairs`` (ids a, b) that are links, by intersecting the whole ``sets`` (doc_id, shingles)."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    joined = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return scratch.stored(joined.where(100 * shared >= 75 * (F.size("sa") + F.size("sb") - shared)).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "verified")


def _sets_of(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, shingles) of the ids in ``pairs``; a repeated row repeats its links only."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    return scratch.stored(_of_ids(docs, ids, _sets, _SETS), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): the components that the links among ``pairs`` (a, b, la, lb, k) make of the components la and lb.

    A large group of near copies may leave many small components with many possible links between them, of which
    few suffice. So each component first tries its one best pair, by shared prefix shingles, then
    its best of 8, of 64 and so on parts of the rest; pairs whose ends have come together meanwhile need no look. Every pair is looked at or lies in one component.
    """
    label, parts = None, 1
    rest = scratch.stored(pairs, "candidates")
    while True:
        n = rest.count()
        if not n:
            return label if label is not None else components(rest.sparkSession, rest.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch)
        if n > AT_ONCE:
            ends = rest.select("*", F.explode(F.array("la", "lb")).alias("end"), F.pmod(F.xxhash64("a", "b"), F.lit(parts)).alias("part"))
            best = ends.groupBy("end", "part").agg(F.max(F.struct("k", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
            chosen = scratch.stored(rest.join(best, ["a", "b"], "left_semi"), "chosen")
            rest = rest.join(best, ["a", "b"], "left_anti")
        else:
            chosen, rest = rest, rest.limit(0)
        found = components(rest.sparkSession, _verified(chosen, sets, scratch), scratch)
        label = found if label is None else _composed(label, found)
        label = scratch.stored(label, "merged")
        rest = scratch.stored(_relabelled(rest, found), "candidates")
        parts *= 8


def _relabelled(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` (la, lb, ...) whose components ``found`` (id, label) has not brought together, under their new labels."""
    for end in ("la", "lb"):
        pairs = pairs.join(found.select(F.col("id").alias(end), F.col("label").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return pairs.where("la <> lb")


def _composed(label: DataFrame, further: DataFrame) -> DataFrame:
    """(id, label): first ``label``, then ``further`` on what it gives; ids that only ``further`` has keep it."""
    then = further.select(F.col("id").alias("label"), F.col("label").alias("_to"))
    known = label.join(then, "label", "left").select("id", F.coalesce("_to", "label").alias("label"))
    return known.unionByName(further.join(label.select("id"), "id", "left_anti").select("id", "label"))


def _sent(spark: SparkSession, hot: np.ndarray) -> tuple:
    """Broadcasts of the sorted shingles of ``hot`` and of their places in it."""
    at = np.argsort(hot)
    send = spark.sparkContext.broadcast
    return send(hot[at]), send(at.astype(np.uint64))


def _described(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Size, key, bitmap and prefix of each text's set, with the shingles of ``hot`` last, in its order."""
    return docs.mapInArrow(_describe(*_sent(docs.sparkSession, hot)), "doc_id long, n long, set_key binary, bitmap array<long>, prefix array<long>")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no shingles and are linked with nothing: their
    component is their own id. Rows repeated under one doc_id are each returned, and
    different texts under one id are linked each by itself (see ``row_components``).
    A row with a null doc_id gets the component of the set it repeats, else null.
    Texts of any length are read whole. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return row_components(docs).drop("row", "stays") if ids_repeat(docs) else _components(docs)


def ids_repeat(docs: DataFrame) -> bool:
    """Do some rows have one doc_id and different texts?"""
    text = F.xxhash64("text")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high"))
    return not ids.where("low <> high").isEmpty()


def row_id() -> F.Column:
    """A number for a row of (doc_id, text), null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))


def row_components(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, stays) of every row, where ids do not identify texts.

    Rows are linked under numbers of their own (``row_id``); component_id is the smallest doc_id of the
    component, and the first row by (doc_id, row) is the one that stays. Rows with a null id stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_id().alias("row"))
    parts = stored(_components(rows.select(F.col("row").alias("doc_id"), "text")), "row-components")
    ids = rows.where("row is not null").select("row", "doc_id").distinct()
    named = stored(parts.where("doc_id is not null").withColumnRenamed("doc_id", "row").distinct().join(ids, "row"), "row-names")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    placed = named.join(first, "component_id").select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("stays"))
    # as many rows as came in; copies of one row may be many
    out = salted_left_join(rows.where("row is not null").select("row", F.monotonically_increasing_id().alias("n")), placed, "row", "n")
    unnamed = parts.where("doc_id is null").join(first, "component_id", "left")
    return out.select("doc_id", "row", "n_shingles", "component_id", "stays").unionByName(
        unnamed.select("doc_id", F.lit(None).cast("long").alias("row"), "n_shingles", F.col("first.doc_id").alias("component_id"), F.lit(True).alias("stays")))


def _components(docs: DataFrame) -> DataFrame:
    """``jaccard_components`` of rows whose ids identify their texts."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    hot = frequent_shingles(docs)
    base = scratch.stored(_described(docs, hot), "shingled")
    classes = base.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = (base.where("n > 0").join(classes.select(F.col("rep").alias("doc_id"), F.col("set_key").alias("of")), "doc_id")
            .where("set_key = of"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int").alias("band")
    tokens = reps.select("doc_id", F.explode("prefix").alias("token"))
    # only shingles that two sets have in their prefixes make a bucket
    bucket = Window.partitionBy("token")
    in_bucket = (tokens.withColumns({"m": F.count("*").over(bucket), "centre": F.min("doc_id").over(bucket)})
                 .where("m > 1").drop("m"))
    in_bucket = scratch.stored(in_bucket, "bucketed")
    # one link for each set first, to the smallest id it shares most shingles with
    met = in_bucket.where("centre < doc_id").groupBy("doc_id", "centre").agg(F.count("*").alias("k"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("k", -F.col("centre"))).alias("best"))
    about = reps.select("doc_id", "n", band, "bitmap")
    about = scratch.stored(about.join(in_bucket.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]), "about")
    one = lambda c, x: about.select(F.col("doc_id").alias(c), F.struct("n", "bitmap").alias(x))

    def bounded(pairs: DataFrame) -> DataFrame:
        both = pairs.join(one("a_id", "a"), "a_id").join(one("b_id", "b"), "b_id")
        return _possible(both).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "la", "lb", "k")

    star = best.select((-F.col("best.col2")).alias("a_id"), F.col("doc_id").alias("b_id"))
    star = scratch.stored(bounded(star.withColumns({"la": F.col("a_id"), "lb": F.col("b_id"), "k": F.lit(1).cast("long")})), "star")
    label = components(spark, _verified(star, _sets_of(star, docs, scratch), scratch), scratch)

    # what still lies between components: in light buckets pair by pair, in heavy ones by blocks of sets
    known = scratch.stored(_labelled(in_bucket.select("token", "doc_id").join(about.select("doc_id", "n", "band"), "doc_id"), label), "labelled")
    shares = known.groupBy("token", "label").agg(F.count("*").alias("c"))
    buckets = (shares.groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"), F.max(F.struct("c", "label")).alias("top"))
               .where("m * m > own")
               .select("token", F.col("top.label").alias("top"), ((F.col("m") * F.col("m") - F.col("own")) / 2 > HEAVY * F.col("m")).alias("heavy")))
    mixed = scratch.stored(known.join(buckets, "token"), "mixed")
    heavy = (mixed.where("heavy").groupBy("doc_id", "n", "label")
             .agg(F.collect_list("token").alias("tokens"), F.max(F.col("label") != F.col("top")).alias("minor")))
    heavy = scratch.stored(heavy.join(about.select("doc_id", "bitmap"), "doc_id"), "heavy")
    light = mixed.where("not heavy").join(heavy.select("doc_id", F.size("tokens").alias("h")), "doc_id", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    pairs = bounded(_meeting(light))
    merged = None
    if parts := _blocks(heavy, "tokens", "bitmap"):
        # sets with a possible link first, then their links
        met = scratch.stored(reduce(DataFrame.unionByName, [_met_in_block(heavy, part) for part in parts]).distinct(), "met")
        whole = scratch.stored(heavy.join(met, "doc_id").join(_of_ids(docs, met, _sets, _SETS), "doc_id"), "heavy-sets")
        links = [_linked_block(whole, part) for part in _blocks(whole, "tokens", "bitmap", "shingles")]
        if links:
            merged = components(spark, scratch.stored(reduce(DataFrame.unionByName, links), "heavy-links"), scratch)
            pairs = _relabelled(scratch.stored(pairs, "light"), merged)
    pairs = scratch.stored(pairs.groupBy("a", "b", "la", "lb").agg(F.max("k").alias("k")), "pairs")
    further = _linked(pairs, _sets_of(pairs, docs, scratch), scratch)
    merged = further if merged is None else _composed(merged, further)
    named = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("first"))
    joined = merged.select(F.col("id").alias("first"), F.col("label").alias("last"))  # of components
    named = named.join(joined, "first", "left").select("set_key", F.coalesce("last", "first").alias("component"))
    out = (salted_left_join(base.select("doc_id", F.col("n").alias("n_shingles"), "set_key"), named, "set_key", "doc_id")
           .select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id")))
    out = stored(out, "components")
    scratch.drop()
    return out


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component of each set, at first its own id."""
    return rows.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def _least_shared(na, nb):
    """Prefix shingles that the sets of a link of sizes ``na`` and ``nb`` have in common at least (numpy)."""
    shared = -(-3 * (na + nb) // 7)
    spare = lambda n: n - (3 * n + 3) // 4 + 1 - (n - shared)
    return np.maximum(1, np.minimum(spare(na), spare(nb)))


class _Block:
    """An index from shingle to set of a block of sets, with their sizes, components and bitmaps."""

    def __init__(self, part: DataFrame, whole: bool = False):
        found = part.select("doc_id", "n", "label", "tokens", "bitmap", *(["shingles"] if whole else [])).toArrow()
        self.ids, self.sizes, self.labels = (found.column(c).to_numpy() for c in ("doc_id", "n", "label"))
        lengths, tokens = _flat(found.column("tokens"))
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(self.ids)), lengths)[order]
        self.widths, words = _flat(found.column("bitmap"))
        begins = np.cumsum(self.widths) - self.widths
        self.maps, self.place = {}, np.zeros(len(self.ids), np.int64)
        for w in np.unique(self.widths):  # a matrix of bitmaps for each width
            own = np.flatnonzero(self.widths == w)
            self.maps[int(w)], self.place[own] = words[begins[own][:, None] + np.arange(w)], np.arange(len(own))
        if whole:
            self.members, shingles = _flat(found.column("shingles"))
            self.first, self.shingles = np.cumsum(self.members) - self.members, shingles.view(np.uint64)

    def may_meet(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The sets of ``batch`` that have ``candidates`` by sizes, components and shared heavy shingles: found for many sets at
        once, as most have none in a block."""
        lengths, tokens = _flat(pa.chunked_array([batch.column("tokens")]))
        n, labels = (batch.column(c).to_numpy() for c in ("n", "label"))
        row = np.repeat(np.arange(len(lengths)), lengths)
        lo = np.searchsorted(self.tokens, tokens, "left")
        size = np.searchsorted(self.tokens, tokens, "right") - lo
        ends, met = np.concatenate(([0], np.cumsum(size)))[np.cumsum(lengths)], np.zeros(len(lengths), bool)
        first = np.cumsum(lengths) - lengths
        a = 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEETINGS, "right")))
            part = slice(first[a], first[b - 1] + lengths[b - 1])
            at, of = _spans(lo[part], size[part])
            who, of = self.owner[at], row[part][of]
            m = self.sizes[who]
            ok = (self.labels[who] != labels[of]) & (4 * np.minimum(m, n[of]) >= 3 * np.maximum(m, n[of]))
            pair, k = np.unique(of[ok] * len(self.ids) + who[ok], return_counts=True)
            of, who = np.divmod(pair, max(len(self.ids), 1))
            met[of[k >= _least_shared(self.sizes[who], n[of])]] = True
            a = b
        return batch.filter(pa.array(met))

    def candidates(self, n: int, label: int, tokens: np.ndarray, bits: np.ndarray, looked_at=None) -> np.ndarray:
        """Sets of other components that share enough heavy shingles with a set and pass the bound of the bitmaps, the likeliest
        first; of those that ``looked_at`` keeps."""
        lo, hi = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        who, k = np.unique(self.owner[_spans(lo, hi - lo)[0]], return_counts=True)
        m = self.sizes[who]
        ok = (self.labels[who] != label) & (4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (k >= _least_shared(m, n))
        who, k = who[ok], k[ok]
        if looked_at is not None:
            ok = looked_at(who)
            who, k = who[ok], k[ok]
        differing = _differing(bits, who, self.widths, self.place, self.maps)
        ok = 7 * ((n + self.sizes[who] - differing) // 2) >= 3 * (n + self.sizes[who])
        return who[ok][np.argsort(-k[ok], kind="stable")]

    def near(self, whole: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Those of ``who`` that are linked with the set ``whole``."""
        at, of = _spans(self.first[who], self.members[who])
        other = self.shingles[at]
        held = whole[np.minimum(np.searchsorted(whole, other), len(whole) - 1)] == other
        shared = np.bincount(of[held], minlength=len(who))
        return who[100 * shared >= 75 * (len(whole) + self.members[who] - shared)]


def _blocks(rows: DataFrame, *columns: str) -> list[DataFrame]:
    """The sets that are not of the largest component of all their buckets, dealt by a hash to blocks of about BLOCK_BYTES."""
    weight = 8 * sum((F.size(c) for c in columns), F.lit(0)) + 64
    minor = rows.where("minor")
    blocks = -(-(minor.agg(F.sum(weight)).first()[0] or 0) // BLOCK_BYTES)  # known before a block is read
    return [minor.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block) for block in range(blocks)]


#: Sets whose marks are one binary of ``bitmap_or_agg``.
_MARKS = 8 * 4096


def _met_in_block(rows: DataFrame, part: DataFrame) -> DataFrame:
    """(doc_id): the sets of ``rows`` and of the block ``part`` that have a possible link between the two.

    Two sets of the largest component of their buckets need no comparison. Pairs that also share a light
    shingle are found there, so heavy ones alone must suffice. A task returns each of its own sets once at most, and marks those of the block.
    """
    spark = rows.sparkSession
    block = _Block(part)
    ids, sent = block.ids, spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        marks = np.zeros(-(-len(block.ids) // _MARKS) * _MARKS, bool)
        for batch in batches:
            met, batch = [], block.may_meet(batch)
            for doc, n, label, own, bits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "label")), batch.column("tokens"), batch.column("bitmap"), strict=True):
                who = block.candidates(n, label, own.values.to_numpy(), bits.values.to_numpy())
                marks[who] = True
                if len(who):
                    met.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.nulls(len(met), pa.int32()), pa.nulls(len(met), pa.binary())], ["doc_id", "part", "bits"])
        parts = [(i, np.packbits(x, bitorder="little").tobytes()) for i, x in enumerate(marks.reshape(-1, _MARKS)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["doc_id", "part", "bits"])

    seen = stored(rows.select("doc_id", "n", "label", "tokens", "bitmap").mapInArrow(run, "doc_id long, part int, bits binary"), "met")
    marked = [np.zeros(0, np.int64)]
    for r in seen.where("part is not null").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).collect():  # a few for each block
        marked.append(ids[np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) + r["part"] * _MARKS])
    of_block = spark.createDataFrame(pa.table({"doc_id": pa.array(np.concatenate(marked), pa.int64())}))
    return seen.where("part is null").select("doc_id").unionByName(of_block)


def _linked_block(rows: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b): components that links between sets of ``rows`` and of the block ``part`` join.

    Possible links are settled where they are met, by intersecting the whole sets. A task passes over pairs whose
    components its links have joined by then, and returns no link that its others imply: a large group of near copies
    costs its tasks a tree each and not all its pairs.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_Block(part, whole=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        joined = _Joined(block.labels)
        for batch in batches:
            batch = block.may_meet(batch)
            joined.add(batch.column("label").to_numpy())
            links = []
            plain = (batch.column(c).to_pylist() for c in ("doc_id", "n", "label", "minor"))
            for doc, n, label, minor, *lists in zip(*plain, *(batch.column(c) for c in ("tokens", "bitmap", "shingles")), strict=True):
                tokens, bits, whole = (x.values.to_numpy() for x in lists)
                whole, most = whole.view(np.uint64), 16

                def looked_at(who: np.ndarray) -> np.ndarray:
                    apart = joined.apart(label, who)  # noqa: B023
                    return apart & (block.ids[who] > doc) if minor else apart  # noqa: B023  a pair of two such sets is met from either side

                who = block.candidates(n, label, tokens, bits, looked_at)
                while len(who):  # what the likeliest join needs no look
                    now, who = who[:most], who[most:]
                    links += [(label, int(block.labels[i])) for i in block.near(whole, now).tolist() if joined.join(label, i)]
                    who, most = who[joined.apart(label, who)], 8 * most
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("doc_id", "n", "label", "minor", "tokens", "bitmap", "shingles").mapInArrow(run, "a long, b long")


class _Joined:
    """Components that the links of one task have joined: those of the sets of a block and of the task's own rows."""

    def __init__(self, labels: np.ndarray):
        known, self.of_set = np.unique(labels, return_inverse=True)
        self.number = {x: i for i, x in enumerate(known.tolist())}
        self.parent = np.arange(len(known))

    def add(self, labels: np.ndarray) -> None:
        for x in np.unique(labels).tolist():
            self.number.setdefault(x, len(self.number))
        self.parent = np.append(self.parent, np.arange(len(self.parent), len(self.number)))

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while (up := self.parent[root]).tolist() != root.tolist():
            root = up
        self.parent[at] = root
        return root

    def apart(self, label: int, sets: np.ndarray) -> np.ndarray:
        """Which of ``sets`` of the block are not yet joined with the component ``label``?"""
        return self.roots(self.of_set[sets]) != self.roots(np.array([self.number[label]]))

    def join(self, label: int, one: int) -> bool:
        """Were the components ``label`` and that of the set ``one`` apart until now?"""
        low, high = np.sort(self.roots(np.array([self.number[label], self.of_set[one]]))).tolist()
        self.parent[high] = low
        return low != high


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, span of each) of spans of ``size`` places from ``first`` on."""
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    return (first - (ends - size))[of] + np.arange(len(of)), of


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all elements)."""
    lengths = [np.diff(np.asarray(c.offsets)).astype(np.int64) for c in lists.chunks]
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]
    return np.concatenate([np.zeros(0, np.int64), *lengths]), np.concatenate([np.zeros(0, np.int64), *values])


def _differing(bits: np.ndarray, who: np.ndarray, widths: np.ndarray, place: np.ndarray, maps: dict[int, np.ndarray]) -> np.ndarray:
    """Differing bits of a bitmap and those of the sets ``who``, the wider folded to the narrower."""
    out, w = np.zeros(len(who), np.int64), len(bits)
    for v in np.unique(widths[who]).tolist():
        at = np.flatnonzero(widths[who] == v)
        other, own = maps[v][place[who[at]]], bits
        if v > w:
            other = np.bitwise_or.reduce(other.reshape(len(at), v // w, w), axis=1)
        elif v < w:
            own = np.bitwise_or.reduce(own.reshape(w // v, v), axis=0)
        out[at] = np.bitwise_count((other ^ own).view(np.uint64)).sum(axis=1)
    return out


def _meeting(rows: DataFrame) -> DataFrame:
    """(a_id, b_id, la, lb, k): sets of different components, and these, that share enough shingles of their prefixes.

    ``rows`` has token, doc_id, n, band, label, top (the largest component of the token's bucket) and h, the number of a set's prefix
    shingles that are left out here. Only sets that are not of the largest component look for others, so a
    bucket of m near copies and a few other sets costs m times these few, not m times m.
    At least min(p_a - d_a, p_b - d_b) prefix shingles of a linked pair are common, where p is
    a prefix's length and d what a set may hold that the other lacks.
    """
    minor = F.col("label") != F.col("top")
    own = rows.select("token", F.col("band").alias("tile"), F.struct("doc_id", "n", "h", "label", minor.alias("minor")).alias("x"))
    met = rows.where(minor).select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("tile"), F.struct("doc_id", "n", "h", "label").alias("y"))
    # two sets that both look for others would meet twice
    pairs = own.join(met, ["token", "tile"]).where(
        "x.label <> y.label and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n) and (not x.minor or x.doc_id < y.doc_id)")
    flip = F.col("x.doc_id") < F.col("y.doc_id")
    part = lambda c: F.struct(*(f"{c}.{k}" for k in ("doc_id", "n", "h", "label")))
    pairs = pairs.select(F.when(flip, part("x")).otherwise(part("y")).alias("a"), F.when(flip, part("y")).otherwise(part("x")).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("k"))
    least = F.ceil((3 * (F.col("a.n") + F.col("b.n"))) / F.lit(7.0) - 1e-9)
    spare = lambda x: F.col(f"{x}.n") - F.ceil(3 * F.col(f"{x}.n") / F.lit(4.0)) + 1 - (F.col(f"{x}.n") - least)
    enough = F.col("k") + F.least(F.col("a.h"), F.col("b.h")) >= F.least(spare("a"), spare("b"))
    return counted.where(enough).select(F.col("a.doc_id").alias("a_id"), F.col("b.doc_id").alias("b_id"), F.col("a.label").alias("la"), F.col("b.label").alias("lb"), "k")


def _of_ids(docs: DataFrame, ids: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow(run)`` over the rows of ``docs`` with one of ``ids``, which are broadcast up to IDS_MAX and joined beyond."""
    ids = ids.distinct()
    few = ids.limit(IDS_MAX + 1).count() <= IDS_MAX
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(run, schema)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component only the document that names it stays.

    Where one id has different texts, each row is judged by itself. Rows with a null id stay, as do rows that repeat
    the id and text of one that stays.
    """
    own = docs.withColumn("_id", F.col("doc_id").cast("long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids_repeat(texts):
        gone = row_components(texts).where("not stays").select(F.col("row").alias("_id"))
        own = docs.withColumn("_id", row_id())
    else:
        gone = _components(texts).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    return without(own, gone, ["_id"]).drop("_id")
