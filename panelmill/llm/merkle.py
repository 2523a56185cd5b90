"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections. DataFrame functions only.

A paragraph is a line. A section ends after a blank paragraph and after one whose hash begins with 0 or 1 (one of
eight), so a paragraph put in or taken out changes its own section and leaves the others as they are. The root hashes
the sections, a section its paragraphs, a paragraph its text, each under a letter of its own: equal texts have equal
roots, and differing branches lead from the root to the edit. Inside a paragraph, pieces of eight words (a word
of more than 64 code points counts as several) are the finest branches; likeness is their overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.scratch import stored

PIECE = " *(?:[^ ]{1,64} *){1,8}| +"
LEAST_ID = -(1 << 63)


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds the tree of column ``text`` (null is empty), column names behind ``prefix``.

    ``paragraphs`` are the hashes of the paragraphs in order, ``sections`` structs (first, last, hash) with the numbers
    of their paragraphs from 1, ``root`` the fingerprint, ``pieces`` the distinct hashes of the finest branches. An
    empty text is one empty paragraph without pieces.
    """
    lines, hashes, ends = f"_{prefix}lines", f"{prefix}paragraphs", f"_{prefix}ends"
    count = F.size(lines)
    out = df.withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    out = out.withColumns({
        hashes: F.transform(lines, lambda x: _hash("p", x)),
        f"{prefix}pieces": F.array_distinct(F.flatten(F.transform(
            lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))))})
    out = out.withColumn(ends, F.filter(F.sequence(F.lit(1), count), lambda i: (
        (i == count) | (F.element_at(hashes, i) < "2") | (F.btrim(F.element_at(lines, i), F.lit(" \t\r")) == ""))))

    def section(last: Column, n: Column) -> Column:
        first = F.when(n == 0, 1).otherwise(F.element_at(ends, F.greatest(n, F.lit(1))) + 1)
        return F.struct(first.alias("first"), last.alias("last"),
                        _hash("s", F.array_join(F.slice(hashes, first, last - first + 1), "")).alias("hash"))

    out = out.withColumn(f"{prefix}sections", F.transform(ends, section))
    root = _hash("r", F.array_join(F.transform(f"{prefix}sections", lambda s: s["hash"]), ""))
    return out.withColumns({f"{prefix}root": root, f"{prefix}n_paragraphs": count.cast("long")}).drop(lines, ends)


def likeness(root_a: Column, pieces_a: Column, root_b: Column, pieces_b: Column) -> Column:
    """1 where the roots are equal; else the share of all distinct pieces that both trees have."""
    common = F.size(F.array_intersect(pieces_a, pieces_b))
    every = F.size(pieces_a) + F.size(pieces_b) - common
    return F.when(root_a == root_b, 1.0).when(every == 0, 0.0).otherwise(common / every)


def changed_paragraphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, section, paragraph (numbers from 1) of what ``after`` has and ``before`` has not, per doc_id.

    Both have doc_id and text, and one row for each doc_id. Equal roots end the search for a document, equal sections
    for a section; only paragraphs of differing sections are compared. Documents that only ``after`` has are new in all
    their paragraphs.
    """
    trees = [stored(with_tree(df.select("doc_id", "text"), "text").select("doc_id", "root", "sections", "paragraphs"), "tree") for df in (before, after)]
    # written first: Spark would push the anti-joins below the trees and copy whole trees into their lambdas
    old, new = (t.select("doc_id", "root", "paragraphs", F.posexplode_outer("sections").alias("at", "s"))
                .select("doc_id", "root", (F.col("at") + 1).alias("section"), F.col("s.hash").alias("hash"), F.col("s.first").alias("first"),
                        F.slice("paragraphs", F.col("s.first"), F.col("s.last") - F.col("s.first") + 1).alias("paragraphs")) for t in trees)
    differ = new.join(old.select("doc_id", "root").distinct(), ["doc_id", "root"], "left_anti").join(
        old.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_anti")
    lines = differ.select("doc_id", "section", "first", F.posexplode_outer("paragraphs").alias("at", "hash"))
    known = old.select("doc_id", F.explode_outer("paragraphs").alias("hash")).distinct()
    return (
        lines.join(known, ["doc_id", "hash"], "left_anti")
        .select("doc_id", "section", (F.col("first") + F.col("at")).alias("paragraph")))


def with_next(docs: DataFrame, carry: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds struct ``next`` with the columns ``carry`` of the next row in the order of doc_id; after the last comes the first.

    ``prepare`` adds columns before the rows are dealt, to be carried along.

    Rows without doc_id come first, rows that share one go by the hash of their text and by the text. The rows are dealt
    to as many ranges of (doc_id, hash) as the session has shuffle partitions, in one shuffle; a range also gets a copy of
    the first row of the next one, so no task sees more than its range. An id that many rows share spans several ranges.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = docs.withColumns({"_key": key, "_tie": F.xxhash64(F.coalesce("text", F.lit("")))})
    cuts = rows.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    rows = rows.withColumn("_part", _range_of(F.col("_key"), F.col("_tie"), cuts))
    order = F.struct("_key", "_tie")
    heads = rows.groupBy("_part").agg(F.min(order).alias("_head"))
    every = Window.orderBy("_part")
    heads = F.broadcast(heads.select(  # one row for each range
        F.col("_part").alias("_to"), F.coalesce(F.lead("_head").over(every), F.first("_head").over(
            every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_head")))
    first = rows.join(heads, order == F.col("_head")).drop("_part", "_head").withColumnRenamed("_to", "_part")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("text"))).filter("_n = 1").drop("_n")
    both = prepare(rows.withColumn("_copy", F.lit(0)).unionByName(first.withColumn("_copy", F.lit(1))))
    within = Window.partitionBy("_part").orderBy("_copy", "_key", "_tie", "text")
    return (
        both.withColumn("next", F.lead(F.struct(*carry)).over(within)).filter("_copy = 0")
        .drop("_key", "_tie", "_part", "_copy"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last quarter (of the code points, rounded down) replaced by as many from the
    beginning of the next document, or all that it has. A null text is empty; see ``with_next`` for rows without or
    with the same doc_id. A single row is its own next. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_next(rows, ["text", "root", "pieces"], lambda df: with_tree(df, "text").drop("sections", "paragraphs", "n_paragraphs"))
    out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = (F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next.text", F.lit(1), quarter))
    out = with_tree(out.withColumn("edited", edited).drop("text"), "edited", "edited_")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("pieces"), F.col("edited_root"), F.col("edited_pieces")).alias("near_edited"),
        likeness(F.col("root"), F.col("pieces"), F.col("next.root"), F.col("next.pieces")).alias("near_next"))


def _hash(kind: str, text: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit(f"{kind}:"), text), "UTF-8"), 256)


def _range_of(key: Column, tie: Column, cuts: list[int]) -> Column:
    """Number of the range: how many cuts lie below, and for a key that several cuts hit, further by its tie.

    The cuts are searched in two steps, by every s-th cut and within the s after it, s being the root of their number.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    coarse, fine = F.lit(cuts[::step]), F.lit(cuts)

    def count(is_before) -> Column:
        whole = F.greatest(F.size(F.filter(coarse, is_before)) - 1, F.lit(0)) * step
        return whole + F.size(F.filter(F.slice(fine, whole + 1, F.lit(step)), is_before))

    below, to = count(lambda c: c < key), count(lambda c: c <= key)
    share = tie / F.lit(float(1 << 64)) + 0.5
    return below + F.least(F.floor(share * (to - below)).cast("int"), F.greatest(to - below - 1, F.lit(0)))
