"""Benchmark passages in training documents, found through a distributed positional inverted index.

The index holds a posting (document, position) for every corpus occurrence of a benchmark word. A phrase of
``window`` words is looked up from its rarest words: their posting lists, each shifted by the word's place in
the item, are intersected, and only documents left over are compared word by word. Everything is DataFrame
operations. Common words cost postings but no comparisons; the lists of hot words are joined to the small
table of rarest words, which Spark broadcasts below its threshold and splits by skew above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.native_text import lower_ascii, raw_words, text_id, words
from panelmill.llm.scratch import stored

DOC = ["doc_id", "tid"]


def item_table(items: DataFrame, window: int) -> DataFrame:
    """item, w (words), ids (sorted item_ids as strings, without null) of each distinct word sequence."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return (
        w.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .withColumn("item", F.md5(F.array_join("w", " "))).withColumn("wl", F.least(F.lit(window), F.size("w"))))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, tid, term, pos: one row for each occurrence of a word of ``terms``, counted from 1.

    The empty term has one row for each input row, with the number of its words as pos. The terms are written
    first: then Spark knows their size when it plans the join, and broadcasts them below its threshold instead of
    shuffling all words.
    """
    empty = terms.sparkSession.range(1).select(F.lit("").alias("term"))
    known = stored(terms.select("term").unionAll(empty).distinct().coalesce(1), "terms")
    texts = docs.select("doc_id", text_id(F.col("text")).alias("tid"), raw_words(F.col("text")).alias("w"))
    every = texts.select(*DOC, F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    place = F.when(F.col("pos") == 0, F.col("n")).otherwise(F.col("pos")).alias("pos")
    return every.select(*DOC, lower_ascii(F.col("word")).alias("term"), place).join(known, "term")


def rarest(items: DataFrame, index: DataFrame, anchors: int) -> DataFrame:
    """item, needed: for each window that can occur, the ``anchors`` places in the item of its rarest words."""
    count = index.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    place = items.select("item", "wl", F.size("w").alias("size"), F.posexplode("w").alias("p", "term"))
    first = F.greatest(F.lit(0), F.col("p") - F.col("wl") + 1)
    last = F.least(F.col("p"), F.col("size") - F.col("wl"))
    ranked = (
        place.join(count, "term", "left").withColumn("j", F.explode(F.sequence(first, last)))
        .groupBy("item", "j").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "p", "term"))).alias("by")))
    return ranked.filter(F.col("by")[0]["n"] > 0).select("item", "j", F.slice("by", 1, anchors).alias("by"))


def candidates(items: DataFrame, index: DataFrame, anchors: int) -> DataFrame:
    """doc_id, tid, item, shift: where the shifted lists of some window's rarest words meet."""
    chosen = stored(rarest(items, index, anchors), "anchors")
    places = stored(chosen.select("item", F.explode("by").alias("x")).select("item", "x.term", "x.p").distinct(), "places")
    needed = stored(chosen.groupBy("item").agg(F.collect_set(F.transform("by", lambda x: x["p"])).alias("needed")), "needed")
    met = (
        index.filter("term <> ''").join(places, "term")
        .groupBy(*DOC, "item", (F.col("pos") - 1 - F.col("p")).alias("shift")).agg(F.collect_set("p").alias("found")))
    return met.join(needed, "item").filter(
        F.exists("needed", lambda need: F.size(F.array_except(need, F.col("found"))) == 0)).select(*DOC, "item", "shift")


def _occurrences(c: Column, n: Column) -> Column:
    """Windows of the item that stand in the document's words at the candidate's shift."""
    low = F.greatest(F.lit(0), -c["shift"])
    high = F.least(F.size(c["w"]) - c["wl"], n - c["wl"] - c["shift"])
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda j: F.slice("words", c["shift"] + j + 1, c["wl"]) == F.slice(c["w"], j + 1, c["wl"]))
    return F.transform(same, lambda j: F.struct(
        (c["shift"] + j).alias("start"), (c["shift"] + j + c["wl"]).alias("end"), c["ids"].alias("ids")))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 13, anchors: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): every input row as doc_id, tid, n_words; and for rows with a match, its matches
    as an array of (start, end, ids) in words, end exclusive.

    A null text has no words. Items without words are left out; an item without item_id matches but is
    not named. Rows of one doc_id with different texts are kept apart by ``tid``, a hash of the text.
    """
    table = stored(item_table(items.select("item_id", "text"), window), "items")
    index = stored(postings(docs.select("doc_id", "text"), table.select(F.explode("w").alias("term"))), "postings")
    met = candidates(table, index, anchors).join(table, "item")
    per_doc = stored(met.groupBy(*DOC).agg(F.collect_list(F.struct("shift", "w", "wl", "ids")).alias("met")), "candidates")
    text = docs.select("doc_id", "text", text_id(F.col("text")).alias("tid"))
    there = per_doc.withColumnsRenamed({"doc_id": "d", "tid": "t"}).hint("shuffle_hash")
    read = text.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t"))).select(
        *DOC, "met", words(F.col("text")).alias("words"))
    found = F.flatten(F.transform("met", lambda c: _occurrences(c, F.size("words"))))
    matches = read.select(*DOC, F.array_sort(found).alias("matches")).filter(F.size("matches") > 0).dropDuplicates(DOC)
    return index.filter("term = ''").select(*DOC, F.col("pos").alias("n_words")), matches


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, per_hit: int = 20) -> DataFrame:
    """doc_id, tid (a hash of the text), n_words, n_hit, items (sorted), contaminated for each row of ``docs``.

    A word is hit inside any occurrence of a window; a document with hits is contaminated when
    ``per_hit * n_hit >= n_words``. Without documents the result is empty, without items nothing is hit.
    """
    rows, matches = phrase_matches(docs, items, window)
    covered = F.aggregate(
        "matches", F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda acc, m: F.struct(
            (acc["n"] + F.greatest(F.lit(0), m["end"] - F.greatest(m["start"], acc["last"]))).alias("n"),
            F.greatest(acc["last"], m["end"]).alias("last")),
        lambda acc: acc["n"])
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["ids"]))))
    hit = stored(matches.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), covered.alias("n"), names.alias("items")), "hits")
    n_hit = F.coalesce("n", F.lit(0)).cast("long")
    return (
        rows.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left")
        .select(*DOC, F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                ((n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))).alias("contaminated")))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, per_hit: int = 20) -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, columns as they are."""
    bad = contamination(docs, items, window, per_hit).filter("contaminated").select(
        F.col("doc_id").alias("_dc_doc"), F.col("tid").alias("_dc_tid")).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_dc_doc")) & (text_id(F.col("text")) == F.col("_dc_tid"))
    return docs.join(bad, same, "left_anti")


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, tid, query_id, start, end: spans of at most (distinct words of the query + slop) words that hold
    all of them in any order; each span begins with one of them.

    Documents are first narrowed to those with the query's rarest word. Queries without words match nothing.
    """
    terms = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    each = terms.select("query_id", F.size("w").alias("size"), F.explode("w").alias("term"))
    index = stored(postings(docs.select("doc_id", "text"), each), "postings").filter("term <> ''")
    count = index.groupBy("term").agg(F.count("*").alias("n"))
    rare = each.join(count, "term", "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("least")).select("query_id", "least.term")
    docs_with = index.join(rare, "term").select(*DOC, "query_id").distinct()
    hits = index.join(each, "term").alias("h").join(
        docs_with.alias("r"), F.expr("h.doc_id <=> r.doc_id and h.tid = r.tid and h.query_id <=> r.query_id"), "left_semi")
    span = hits.withColumn("upto", F.col("pos") + F.col("size") + F.lit(slop))
    pairs = span.alias("a").join(
        span.alias("b"),
        F.expr("a.doc_id <=> b.doc_id and a.tid = b.tid and a.query_id <=> b.query_id and b.pos >= a.pos and b.pos < a.upto"))
    return (
        pairs.groupBy("a.doc_id", "a.tid", "a.query_id", "a.pos", "a.size")
        .agg(F.count_distinct("b.term").alias("n"), F.max("b.pos").alias("last")).filter("n = size")
        .select("doc_id", "tid", "query_id", (F.col("pos") - 1).alias("start"), F.col("last").alias("end")))
