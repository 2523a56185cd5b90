"""Lines that repeat across documents, counted in levelled sorted runs of line hashes.

Documents come in batches. A batch's keys that the runs already know as repeated are dropped by a merge
anti-join; the others go, with their document counts, into a new run. A run is a table bucketed and sorted by
the 128-bit hash, so a run joins and merges with another without being shuffled again. When a level has
``fanout`` runs, they are merged into one run of the next level. Everything is DataFrame operations.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.native_text import lower_ascii, text_id
from panelmill.llm.scratch import new_path, stored

HASH = ["h1", "h2"]
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """doc_id, tid, pos, h1, h2, batch of each line whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", text_id(F.col("text")).alias("tid"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    key = F.btrim(lower_ascii(F.col("line")), F.lit(BLANKS))
    return (
        lines.select("doc_id", "tid", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
        .select("doc_id", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")))


class LineRuns:
    """Levelled runs of (h1, h2, n): in how many documents each key was seen. A document is in one batch only.

    A run has as many buckets as the session has shuffle partitions, so that the task that counts a bucket's
    keys also writes its one file.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def add(self, keys: DataFrame) -> None:
        """Takes the keys (doc_id, h1, h2) of a batch of documents."""
        counts = keys.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.count("*").alias("n"))
        for run in self.runs():
            counts = counts.hint("merge").join(run.filter(F.col("n") >= self.min_docs), HASH, "left_anti")
        self._put(self._run(counts), 0)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def repeated(self) -> DataFrame:
        """Keys seen in at least ``min_docs`` documents."""
        return self._merged(self.runs()).filter(F.col("n") >= self.min_docs).select(*HASH)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._run(self._merged(full)), level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged by hash. Not a union: over bucketed files, that must not be taken for bucketed itself."""
        def merge(one: DataFrame, two: DataFrame) -> DataFrame:
            both = one.join(two.hint("merge").withColumnRenamed("n", "_n"), HASH, "full_outer")
            return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
        return reduce(merge, runs)

    def _run(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            counts.write.option("path", new_path(self.spark, name))
            .bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        )
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Takes the runs out of the catalog, once nothing reads them any more; the files go with the session."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.names = [], []


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """doc_id, tid, dropped: the places of the lines of each document whose key is in ``min_docs`` documents.

    Rows of one doc_id are one document when documents are counted (null is a doc_id like any other), but
    each text keeps its own lines, told apart by ``tid``, a hash of the text. Without documents, nothing.
    """
    spark = docs.sparkSession
    keys = stored(line_keys(docs.select("doc_id", "text"), batches, min_chars), "line-keys", "batch")
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(keys.filter(F.col("batch") == batch))
    repeated = stored(runs.repeated(), "repeated-lines")
    runs.close()
    return keys.join(repeated, HASH, "left_semi").groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("dropped"))


def without_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """``docs`` with text left of repeated lines, and n_lines (before) and n_dropped (long).

    A line's key is the line without blanks at both ends, A-Z lower-cased. Lines whose key is shorter than
    ``min_chars`` stay. A null or empty text is one empty line, and its result is an empty text. All other
    columns of ``docs`` stay as they are; columns n_lines and n_dropped of its own are replaced.
    """
    drops = stored(dropped_lines(docs, min_docs, min_chars, batches), "dropped-lines")
    drops = drops.withColumnsRenamed({"doc_id": "_ld_doc", "tid": "_ld_tid", "dropped": "_ld_places"}).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_ld_doc")) & (text_id(F.col("text")) == F.col("_ld_tid"))
    lines = docs.join(drops, same, "left").withColumn("_ld_lines", split_lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("_ld_places"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("_ld_lines"), i)), "\n")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return lines.withColumns({
        "text": F.when(F.col("_ld_places").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept),
        "n_lines": F.size("_ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_ld_places"), F.lit(0)).cast("long"),
    }).select(*others, "n_lines", "n_dropped")
