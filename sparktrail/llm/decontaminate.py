"""Benchmark decontamination by a stored positional inverted index, in DataFrame functions only.

Index. Every text is split into words once, and the postings (document, position,
term) of all its words are stored, with the number of words of the document; one
without words has one row. The index knows nothing of a benchmark and serves any.

Search. The terms of a window of `width` benchmark words are ordered from the
rarest. The postings of the two rarest, each moved back by the term's offset,
are intersected: places that both have are where the window may start. These are
intersected with the moved postings of all its other terms, in the documents
that are left: a place that every list has is an exact phrase. A window with a
term that occurs nowhere is left out at once.

Sizes. The benchmark's terms and windows, and the set of documents left after
the first lists, are sent to all tasks while their measured size is below
`broadcast_bytes`; beyond that, the same joins are made by a shuffle. Postings
are joined by document, position and term, so neither a long document nor a
frequent passage meets in one task.

Defined cases: null or empty text has no words; an item without words is ignored,
one of fewer than `width` words is one window; items that occur in several rows
count once by their id; a null item_id reads as an empty string; a repeated row
comes back as often; rows that share a doc_id but not the text are kept apart;
ids may be of any kind; texts are read whole, however long; with an empty
benchmark no document is hit; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, checkpoint, stored

WIDTH = 10
#: All but digits, lower-case letters and what lies beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _named() -> list[Column]:
    """doc_id, and two columns that name a document: its id, or where that is no integer a hash of id and text; and a hash of its text."""
    h = F.xxhash64("text")
    return [F.col("doc_id"), F.coalesce(F.col("doc_id").try_cast("long"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 61)).alias("dk"), h.alias("th")]


def _send(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def build_index(docs: DataFrame) -> DataFrame:
    """Stored postings (doc_id, dk, th, n_words, pos, term) of all words; a document without words has one row with a null pos and term.

    The words of a text are split once: explode_outer is used, as Spark would
    infer a filter from explode that splits every text a second time.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lists = docs.select(*_named(), words(F.col("text")).alias("words"))
    return stored(lists.select("doc_id", "dk", "th", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "term")), "postings")


def term_counts(index: DataFrame, listed: DataFrame, small: bool) -> DataFrame:
    """How often each term of the items `listed` occurs in all documents."""
    asked = listed.select(F.explode("item").alias("term")).distinct()
    return index.join(_send(asked, small), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id as a string, item: its words), one row for each id and text."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("item"))
    return rows.where(F.size("item") > 0).distinct()


def rarest_first(listed: DataFrame, counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window, size, by): each window of each item, as text, and its (n, at, term) from the rarest term on; windows with a term that occurs nowhere are left out."""
    places = listed.select("item_id", "item", F.posexplode("item").alias("at", "term"))
    counted = places.join(counts, "term", "left").groupBy("item_id", "item")
    by_place = counted.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("c"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("item") - width, F.lit(0)) + 1)
    cut = by_place.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("c", s, F.lit(width)))).alias("c"))
    first = F.get("c", F.lit(0))["at"]
    by = F.array_sort(F.transform("c", lambda x: F.struct(x["n"].alias("n"), (x["at"] - first).alias("at"), x["term"].alias("term"))))
    found = cut.select("item_id", F.array_join(F.transform("c", lambda x: x["term"]), " ").alias("window"), F.size("c").alias("size"), by.alias("by"))
    return found.where(F.get("by", F.lit(0))["n"] > 0).distinct()


def _bytes(of: Column) -> Column:
    return F.coalesce(F.sum(F.aggregate(of, F.lit(64).cast("long"), lambda a, w: a + F.octet_length(w) + 16)), F.lit(0))


def _is_small(listed: DataFrame, broadcast_bytes: int) -> bool:
    return listed.agg(_bytes(F.col("item"))).first()[0] <= broadcast_bytes


def phrase_matches(index: DataFrame, listed: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(dk, th, item_id, lo, hi): words lo to hi - 1 of a document are a window of the item, for the items `listed` by items()."""
    counts = term_counts(index, listed, _is_small(listed, broadcast_bytes))
    windows = checkpoint(rarest_first(listed, checkpoint(counts), width))
    small = windows.agg(_bytes(F.transform("by", lambda x: x["term"]))).first()[0] <= broadcast_bytes
    terms = checkpoint(windows.select("window", "size", "by").distinct().withColumn("win", F.monotonically_increasing_id()))
    lists = index.select("dk", "th", "n_words", "pos", "term")
    # Where the two rarest terms of a window agree on its start; a hot passage is many groups, one for each document.
    two = terms.select("win", "size", F.posexplode(F.slice("by", 1, 2)).alias("k", "r")).select("win", "size", "k", F.col("r.at").alias("at"), F.col("r.term").alias("term"))
    start = F.col("pos") - F.col("at")
    moved = lists.join(_send(two, small), "term").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    agreed = moved.groupBy("dk", "th", "win", start.alias("start")).agg(F.bit_or(F.when(F.col("k") == 0, 1).otherwise(2)).alias("seen"), F.max("size").alias("size"))
    places = checkpoint(agreed.where(F.col("seen") == F.when(F.col("size") == 1, 1).otherwise(3)).select("dk", "th", "win", "start", "size"))
    # The other lists are read for the documents that are left.
    named = places.select("dk", "th").distinct()
    few = named.count() * 64 <= broadcast_bytes
    others = lists.join(_send(named, few), ["dk", "th"], "left_semi").select("dk", "th", "pos", "term")
    rest = terms.where("size > 2").select("win", F.explode(F.slice("by", F.lit(3), F.size("by"))).alias("r")).select("win", F.col("r.at").alias("at"), F.col("r.term").alias("term"))
    asked = places.join(_send(rest, small), "win").select("dk", "th", "win", "size", "start", (F.col("start") + F.col("at")).alias("pos"), "term")
    met = asked.join(others, ["dk", "th", "pos", "term"], "left_semi").groupBy("dk", "th", "win", "size", "start").agg(F.count("*").alias("n"))
    full = met.where(F.col("n") == F.col("size") - 2).drop("n").union(places.where("size <= 2").select("dk", "th", "win", "size", "start"))
    owners = windows.join(terms.select("window", "win"), "window").select("win", "item_id").distinct()
    return full.join(_send(owners, small), "win").select("dk", "th", "item_id", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))


def proximity_matches(index: DataFrame, listed: DataFrame, rarest: int = 4, slop: int = 16, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(dk, th, item_id, pos): the rarest term of an item stands at pos, and its `rarest` rarest terms all within slop words of it."""
    counts = term_counts(index, listed, _is_small(listed, broadcast_bytes))
    ranked = listed.select("item_id", "item", F.explode(F.array_distinct("item")).alias("term")).join(counts, "term").groupBy("item_id", "item").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("by"))
    wanted = checkpoint(ranked.where(F.size("by") >= rarest).select("item_id", F.transform(F.slice("by", 1, rarest), lambda x: x["term"]).alias("terms")).distinct())
    small = wanted.agg(_bytes(F.col("terms"))).first()[0] <= broadcast_bytes
    lists = index.select("dk", "th", "pos", "term")
    centre = lists.join(_send(wanted.select("item_id", "terms", F.get("terms", F.lit(0)).alias("term")), small), "term").select("dk", "th", "item_id", F.col("pos").alias("at"), F.explode("terms").alias("term"))
    # positions meet in cells of slop words, and in the cells beside
    cell = lambda p: F.floor(p / (slop + 1))
    asked = centre.withColumn("cell", F.explode(F.array(cell(F.col("at")) - 1, cell(F.col("at")), cell(F.col("at")) + 1)))
    near = asked.join(lists.withColumn("cell", cell(F.col("pos"))), ["dk", "th", "cell", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    return near.groupBy("dk", "th", "item_id", F.col("at").alias("pos")).agg(F.count_distinct("term").alias("n")).where(F.col("n") == rarest).drop("n")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    listed = checkpoint(items(benchmark))
    index = build_index(docs)
    spans = phrase_matches(index, listed, width, broadcast_bytes)
    # Partial sets before the shuffle; a document has at most as many spans as words for each item.
    per_doc = spans.groupBy("dk", "th").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], s["end"]))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end")))
    hits = per_doc.select("dk", "th", covered["n"].alias("hit"), F.size("ids").alias("items"), F.array_join("ids", ",").alias("joined"))
    rows = index.where("pos is null or pos = 0").select("doc_id", "dk", "th", F.when(F.col("pos").isNull(), 0).otherwise(F.col("n_words")).cast("long").alias("n_words"))
    found = rows.join(hits, ["dk", "th"], "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
