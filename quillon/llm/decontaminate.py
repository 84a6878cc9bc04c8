"""Benchmark decontamination by a positional inverted index, in DataFrame operations.

The index is a stored table of postings ``(k, term, doc_id, h, p)``, one for every word
of every training document.  Every part of it inverts the documents of one task: its
postings are sorted by ``k``, a hash of the term, so a term's list is contiguous in each
part and no frequent term's list is in one place.  Nothing is shuffled to build it.  A
document's own posting, under the empty term and the lowest ``k``, holds its number of
words.

A test item's windows are every ``n`` consecutive words of it (all words if it has
fewer).  Over the training frequencies of its words each window names its two
rarest words, with their offsets.  The lists of these terms are fetched first and
adjusted by the offsets: a posting at p of a term at item offset q lies on the diagonal
p - q, and the lists of one document and item intersect where two of them share a
diagonal.  Only for what is left the lists of the item's other terms are intersected,
by (document, term, position), which gives the exact phrase matches: the runs of ``n``
offsets that are all found on one diagonal.

Proximity has lists of its own, as an edited copy may lack any of the words: each
window names the two rarest of its different terms that occur at all.  Two different
such terms of an item on diagonals at most ``slop`` apart are a proximity match.

Sizes.  What is fetched of the index is shuffled by (document, item).  No side is broadcast by hint; Spark does so where its own size
estimate of a table allows.  A frequent term's lists are fetched only if a window has
nothing rarer.

Defined cases.  A null or blank text has no words: such a document has no hits,
such an item no windows.  A null ``doc_id`` stays null.  Rows that share a ``doc_id``
are told apart by a hash of their text; equal rows get equal results, a row each.  A
null ``item_id`` counts as the id "".  Items that share an id count once.  Words of
equal frequency are ranked by their text, then by place.  An empty table of documents
gives an empty one; without items nothing is hit.  Texts and items of any length are
taken whole.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: all ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The ``k`` of documents' own postings.
LOWEST = -(1 << 31)
#: Stands for a null document id inside the operator.
NULL_ID = -(1 << 63)


def tokens(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS), lambda w: w != "")


def posting_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings ``(k, term, doc_id, h, p)``; ``h`` tells texts of one id apart."""
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(text_col).alias("h"), tokens(F.col(text_col)).alias("w"))
    own = F.array(F.struct(F.lit("").alias("term"), F.size("w").alias("p")))
    words = F.transform("w", lambda t, i: F.struct(t.alias("term"), i.alias("p")))
    rows = rows.select("doc_id", "h", F.explode(F.concat(own, words)).alias("l")).select("l.term", "doc_id", "h", "l.p")
    k = F.when(F.col("term") == "", LOWEST).otherwise(F.hash("term"))
    return stored(rows.select(k.alias("k"), "*").sortWithinPartitions("k"), "postings")


def _of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings that may be of ``terms``, by the number ``k`` alone; what follows compares the terms."""
    return index.join(terms.select(F.hash("term").alias("k")).distinct(), "k", "left_semi")


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every word of every item: ``(item, item_id, size, q, term, t)``; ``t`` is the term's first offset."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), tokens(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    rows = stored(rows.distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    spots = rows.select("item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("q", "term"))
    first = spots.groupBy("item", "term").agg(F.min("q").alias("t"))
    return stored(spots.join(first, ["item", "term"]).select("item", "item_id", "size", "q", "term", "t"), "item-words")


def _anchors(index: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """``(term, item, q, t, need, phrase, near)``: the rarest terms of every window, for phrases and for proximity."""
    terms = stored(words.select("term").distinct(), "terms")
    counts = stored(_of(index, terms).groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi"), "term-counts")
    last = F.greatest(F.col("size") - n, F.lit(0))
    starts = F.sequence(F.greatest(F.col("q") - (n - 1), F.lit(0)), F.least(F.col("q"), last))
    spots = words.join(counts, "term", "left").select("item", "size", "q", "term", "t", F.coalesce("df", F.lit(0)).alias("df"), F.explode(starts).alias("start"))
    ranked = F.sort_array(F.collect_list(F.struct("df", "term", "q", "t")))  # n words at most
    windows = spots.groupBy("item", "start", "size").agg(ranked.alias("ranked"))
    # a window with a term that no document has cannot occur, but what is left of it can be near
    windows = windows.withColumn("present", F.filter("ranked", lambda x: x["df"] > 0))
    other = F.filter("present", lambda x: x["t"] != F.col("present")[0]["t"])
    whole = F.filter(F.slice("ranked", 1, 2), lambda x: F.col("ranked")[0]["df"] > 0)
    chosen = F.concat(
        F.transform(whole, lambda x: F.struct(x["term"].alias("term"), x["q"].alias("q"), x["t"].alias("t"), F.lit(True).alias("phrase"))),
        F.transform(F.concat(F.slice("present", 1, 1), F.slice(other, 1, 1)), lambda x: F.struct(x["term"].alias("term"), x["q"].alias("q"), x["t"].alias("t"), F.lit(False).alias("phrase"))),
    )
    rows = windows.select("item", F.least(F.col("size"), F.lit(2)).alias("need"), F.explode(chosen).alias("a"))
    both = rows.groupBy("item", "need", "a.term", "a.q", "a.t").agg(F.max("a.phrase").alias("phrase"), F.max(~F.col("a.phrase")).alias("near"))
    return stored(both, "anchors")


def _hits(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchors' postings by document, item and diagonal."""
    return stored(_of(index, anchors).join(anchors, "term").select("doc_id", "h", "item", "need", (F.col("p") - F.col("q")).alias("d"), "q", "t", "phrase", "near"), "hits")


def _near(hits: DataFrame, slop: int) -> DataFrame:
    """``(doc_id, h, item)`` of proximity matches. If any two hits are near each other, two neighbours are."""
    rows = hits.where("near").select("doc_id", "h", "item", "d", "t").distinct()
    order = Window.partitionBy("doc_id", "h", "item").orderBy("d", "t")
    close = (F.col("d") - F.lag("d").over(order) <= slop) & (F.col("t") != F.lag("t").over(order))
    return rows.select("doc_id", "h", "item", close.alias("close")).where("close").drop("close").distinct()


def _phrases(index: DataFrame, hits: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Exact matches: ``(doc_id, h, item_id, d, w, starts)``; a window of w words starts at each of ``starts`` of the item."""
    lines = hits.where("phrase").groupBy("doc_id", "h", "item", "d", "need").agg(F.countDistinct("q").alias("k")).where("k >= need")
    lines = stored(lines.select("doc_id", "h", "item", "d"), "diagonals")
    wanted = lines.join(words, "item").select("doc_id", "h", "item", "item_id", "size", "d", "q", "term", (F.col("d") + F.col("q")).alias("p")).where("p >= 0")
    lists = index.join(words.select("term").distinct(), "term", "left_semi").join(lines.select("doc_id", "h").distinct(), ["doc_id", "h"], "left_semi")
    found = wanted.join(lists.distinct(), ["doc_id", "h", "term", "p"])
    runs = found.groupBy("doc_id", "h", "item", "item_id", "size", "d").agg(F.sort_array(F.collect_list("q")).alias("q"))
    runs = runs.withColumn("w", F.least(F.col("size"), F.lit(n)))
    # offsets ascend without repeats, so w of them in a row span w - 1
    starts = F.expr("filter(transform(sequence(1, size(q)), i -> if(i + w - 1 <= size(q) and q[i + w - 2] - q[i - 1] = w - 1, q[i - 1], -1)), x -> x >= 0)")
    return runs.select("doc_id", "h", "item_id", "d", "w", starts.alias("starts")).where("size(starts) > 0")


@settled("contamination")
def contamination(
    docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", proximity: bool = True
) -> DataFrame:
    """For each row of ``docs``: ``doc_id, h, n_words, n_hit, n_items, item_ids, n_near, near_ids``.

    ``n_hit`` words lie in an occurrence of a window of ``n_items`` items, ``item_ids``
    sorted as strings; ``n_near`` items, ``near_ids`` sorted, have a proximity match.
    Without ``proximity`` it isn't looked for, and the last two are 0 and empty.
    """
    index = posting_index(docs, id_col, text_col)
    words = _items(items, item_id_col, item_text_col)
    anchors = _anchors(index, words, n)
    hits = _hits(index, anchors if proximity else anchors.where("phrase"))
    covered = F.explode(F.expr("flatten(transform(starts, s -> sequence(d + s, d + s + w - 1)))"))
    matches = stored(_phrases(index, hits, words, n), "matches")
    n_hit = matches.select("doc_id", "h", covered.alias("p")).distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    ids = matches.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    near = _near(hits if proximity else hits.limit(0), slop).join(words.select("item", "item_id").distinct(), "item").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item_id")).alias("near_ids"))
    out = index.where((F.col("k") == LOWEST) & (F.col("term") == "")).select("doc_id", "h", F.col("p").cast("long").alias("n_words"))
    for side, name in ((n_hit, "hit-words"), (ids, "hit-items"), (near, "near-items")):
        out = out.join(stored(side, name), ["doc_id", "h"], "left")
    none = F.array().cast("array<string>")
    item_ids, near_ids = F.coalesce("item_ids", none), F.coalesce("near_ids", none)
    return out.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), F.size(near_ids).cast("long").alias("n_near"), near_ids.alias("near_ids"),
    )
