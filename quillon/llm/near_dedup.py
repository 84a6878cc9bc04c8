"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch.  A document's set of word shingles is sketched into ``t = bands * rows``
coordinates.  In round i < t every element falls into one coordinate chosen by a
hash of that round, and a coordinate keeps the smallest value of the first round
that reached it.  In round t + j all elements fall into coordinate j, so that every
coordinate is filled after 2t rounds however small the set is; rounds stop as soon
as all are filled, which takes about t log t hash values.  The share of equal
coordinates of two sketches estimates the Jaccard similarity as concentrated as t
independent values would.

Banding.  Equal sets are merged into classes first, by a 128-bit digest and the
size.  Classes that agree on all rows of a band are candidates.  With 40 bands of 6
rows, a pair of similarity 0.8 is missed with probability 5e-6.

Verification.  No bucket is expanded into all its pairs.  Every bucket compares one
pivot (the class that shares most buckets, the smallest id on a tie) with its
members, on full sets; components follow from the links found.  Two candidates that
are not the pivot were both compared with the pivot of a bucket they share.  So what
is left to compare are members of different components in the group of one pivot, and
of these only such whose sizes allow the similarity.  A group is cut into classes of
size, of which only equal and neighbouring ones can hold similar sets.  The members
outside of the group's largest component are dealt into chunks of bounded size within
their class, and each chunk is compared with the others by a product of token matrices
in one task, which returns links only.  Every candidate pair is thus connected or
refuted; groups of copies, which are one component after the first step, need no second.

Defined cases.  A null or blank text has an empty set and is linked with nothing.
A text of fewer words than a shingle is one shingle, its whole word sequence; a text of
any length is read whole.  A row with a null id is linked with nothing, its
``component_id`` is null and it is kept.  Repeated rows are of one component and all
kept or none.  Rows that share an id are one vertex: a link of either text links the id.
Ties between pivots go to the smallest id.  An empty table gives an empty one.  Only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled, stored
from . import textops as tx
from .components import smallest_reachable

SLICE_BYTES = 2 << 20
#: Sets, and shingles in them, that a chunk of a group holds.
CHUNK_ROWS, CHUNK_TOKENS = 256, 500_000
_U32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, after one another; and the offsets."""
    words = tx.Words(texts, fold=tx.LOWER)
    hashes, row = words.hashes(), words.row()
    n = len(words) - size + 1
    found, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        inside = np.flatnonzero(row[:n] == row[size - 1 :])
        found, of = tx.window_hashes(hashes, size)[inside], row[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = tx.span_hashes(hashes, words.first[short], words.first[short + 1])
        found, of = np.concatenate([found, whole]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(texts) + 1))


def sketch(found: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` values for each set that isn't empty."""
    sizes = np.diff(off)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(some), t), np.uint64)
    filled = np.zeros(len(some) * t, bool)
    flat = out.reshape(-1)
    left = np.full(len(some), t)  # coordinates not yet filled
    of = np.repeat(np.arange(len(some), dtype=np.uint64), sizes[some])
    values = found
    for i in range(2 * t):
        if not len(values):
            break
        g = tx.mix(values, 1000 + i)
        if i < t:
            place = of * np.uint64(t) + (((g >> _U32) * np.uint64(t)) >> _U32)
        else:
            open_ = ~filled[of * np.uint64(t) + np.uint64(i - t)]
            g = g[open_]
            place = of[open_] * np.uint64(t) + np.uint64(i - t)
        both = np.sort((place << _U32) | (g & _LOW))
        place = both >> _U32
        lead = np.ones(len(both), bool)
        lead[1:] = place[1:] != place[:-1]
        place, both = place[lead], both[lead]
        new = ~filled[place]
        place = place[new]
        flat[place] = (np.uint64(i) << _U32) | (both[new] & _LOW)
        filled[place] = True
        left -= np.bincount((place // np.uint64(t)).astype(np.int64), minlength=len(left))
        if not i % 4 or i < 8:
            stay = left[of] > 0
            if not stay.all():
                values, of = values[stay], of[stay]
    return out


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        found, off = shingle_sets(batch.column("text"), size)
        n = np.diff(off)
        some = np.flatnonzero(n)
        values = sketch(found, off, bands * rows).reshape(len(some) * bands, rows)
        key = np.tile(np.arange(bands, dtype=np.uint64), len(some))
        for r in range(rows):
            key = tx.mix(key ^ values[:, r], r)
        digests = []
        for seed in (21, 22):
            total = np.zeros(len(found) + 1, np.uint64)
            np.cumsum(tx.mix(found, seed), out=total[1:])
            digests.append(pa.array((total[off[1:]] - total[off[:-1]]).astype(np.int64)))
        ends = np.zeros(len(n) + 1, np.int32)
        ends[1:] = np.cumsum(np.where(n > 0, bands, 0))
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *digests, lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, "text", SLICE_BYTES):
        found, off = shingle_sets(batch.column("text"), size)
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(found.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), lists], ["doc_id", "n", "shingles"])


def _links(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sizes are compared before any set is fetched."""
    n = lambda name, size: sizes.select(F.col("rep").alias(name), F.col("n").alias(size))
    full = lambda name, size, x: sets.select(F.col("doc_id").alias(name), F.col("n").alias(size), F.col("shingles").alias(x))
    sized = pairs.join(n("a", "m"), "a").join(n("b", "n"), "b").where(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
    both = F.size(F.array_intersect("x", "y"))
    joined = sized.join(full("a", "m", "x"), ["a", "m"]).join(full("b", "n", "y"), ["b", "n"]).withColumn("both", both)
    return joined.where(100 * F.col("both") >= percent * (F.col("m") + F.col("n") - F.col("both"))).select("a", "b").distinct()


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Links between the two sides of a block, or within its one side, across components."""
    table = table.combine_chunks()
    rep, component, side = (table.column(c).to_numpy() for c in ("rep", "component", "side"))
    low, high = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # 0: on both sides
    lists = table.column("shingles")
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    _, token, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)  # a token of one set alone is in no intersection
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    token = place[token]
    row, token = row[token >= 0], token[token >= 0]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    both = np.zeros((len(low), len(high)), np.float32)
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(token, [at, at + 4096])
        x = np.zeros((len(size), min(4096, len(shared) - at)), np.float32)
        x[row[lo:hi], token[lo:hi] - at] = 1
        both += x[low] @ x[high].T
    both = both.astype(np.int64)
    similar = 100 * both >= percent * (size[low][:, None] + size[high][None, :] - both)
    similar &= component[low][:, None] != component[high][None, :]
    a, b = np.nonzero(similar)
    a, b = rep[low[a]], rep[high[b]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _rest(compared: DataFrame, label: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components in one pivot's group."""
    rows = compared.join(label.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(sizes, "rep")
    # sets whose sizes differ by more than a class can't be similar enough
    rows = stored(rows.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")), "group-rows")
    by_part = rows.groupBy("pivot", "component").agg(F.count("*").alias("k"))
    # the largest component of each group
    groups = by_part.groupBy("pivot").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(stored(groups.select("pivot", F.col("most.component").alias("main")), "open-groups"), "pivot").withColumn("in_main", F.col("component") == F.col("main"))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("n") / CHUNK_TOKENS)).cast("int")
    by_level = rows.groupBy("pivot", "in_main", "level").agg(chunks.alias("chunks"))
    # chunks of each level, of the rest and of the main component: at most a hundred levels
    counts = by_level.groupBy("pivot").agg(*(F.map_from_entries(F.collect_list(F.when(cond, F.struct("level", "chunks")))).alias(name) for name, cond in (("rest", ~F.col("in_main")), ("mains", F.col("in_main")))))
    rows = rows.join(stored(counts, "chunk-counts"), "pivot")
    own = F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rest"))[F.col("level")]
    rows = rows.withColumn("c", F.pmod(F.xxhash64("rep", F.lit(3)), own).cast("int"))
    # blocks (kind, level and chunk of the rest, level and chunk of the other) that a row is in, and its side
    levels, none = F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1), F.array().cast("array<int>")

    def numbers(counts: str, level):
        n = F.col(counts)[level]
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)

    def block(kind: int, l1, c1, l2, c2, side):
        return F.struct(F.lit(kind).alias("kind"), l1.alias("l1"), c1.alias("c1"), l2.alias("l2"), c2.alias("c2"), side.cast("int").alias("side"))

    level, c = F.col("level"), F.col("c")
    same = F.transform(numbers("rest", level), lambda j: block(0, level, F.least(c, j), level, F.greatest(c, j), F.when(j == c, 0).when(c < j, 1).otherwise(2)))
    above = F.transform(numbers("rest", level + 1), lambda j: block(0, level, c, level + 1, j, F.lit(1)))
    below = F.transform(numbers("rest", level - 1), lambda j: block(0, level - 1, j, level, c, F.lit(2)))
    to_main = F.flatten(F.transform(levels, lambda l: F.transform(numbers("mains", l), lambda j: block(1, level, c, l, j, F.lit(1)))))
    to_rest = F.flatten(F.transform(levels, lambda l: F.transform(numbers("rest", l), lambda j: block(1, l, j, level, c, F.lit(2)))))
    every = F.when(F.col("in_main"), to_rest).otherwise(F.concat(same, above, below, to_main))
    blocks = rows.select("pivot", "rep", "n", "component", F.explode(every).alias("b")).select("pivot", "rep", "n", "component", "b.*")
    full = blocks.join(sets.select(F.col("doc_id").alias("rep"), "n", "shingles"), ["rep", "n"])
    return full.groupBy("pivot", "kind", "l1", "c1", "l2", "c2").applyInArrow(lambda t: _compare(t, percent), "a long, b long").distinct()


@settled("near-duplicates")
def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Documents with ``100 * |intersection| >= percent * |union|`` are linked; a
    component's smallest id is kept.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(slim.mapInArrow(lambda it: tx.lean(_signatures(it, shingle, bands, rows)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("d1", "d2", "n_shingles", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")), "classes")

    members = classes.select("rep", F.explode("bands").alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "n"), "shared-keys")
    live = stored(members.join(shared, "key"), "bucket-rows")
    weight = live.groupBy("rep").agg((-F.sum("n")).alias("w"))
    live = stored(live.select("key", "rep").distinct().join(stored(weight, "weights"), "rep"), "weighted-rows")

    wanted = live.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(slim.join(stored(wanted, "wanted"), "doc_id", "left_semi").mapInArrow(lambda it: tx.lean(_sets(it, shingle)), "doc_id long, n long, shingles array<long>"), "sets")
    sizes = stored(classes.select("rep", F.col("n_shingles").alias("n")).distinct(), "sizes")

    # rows that share an id make their classes one
    owner = usable.select("doc_id", "d1", "d2", "n_shingles").join(classes.drop("bands"), ["d1", "d2", "n_shingles"])
    links = stored(owner.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b"), "shared-ids")
    pivot = stored(live.groupBy("key").agg(F.min(F.struct("w", "rep")).alias("p")), "pivots")
    compared = stored(live.join(pivot, "key").select(F.col("p.rep").alias("pivot"), "rep").where("rep <> pivot").distinct(), "compared")
    pairs = compared.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    links = stored(links.unionByName(_links(pairs, sizes, sets, percent)), "links")
    label = smallest_reachable(links)
    more = stored(_rest(compared, label, sizes, sets, percent), "more-links")
    if not more.isEmpty():
        label = smallest_reachable(links.unionByName(more))

    named = stored(classes.drop("bands").join(label.withColumnRenamed("vertex", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("c")), "class-labels")
    out = signed.drop("bands").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
