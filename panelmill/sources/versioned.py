"""Tables of immutable parts, changed by switching to a new manifest.

A write puts its rows into a folder of its own and then adds one manifest that names the folders of the new version. The
manifest appears whole or not at all, under a number that only one writer can take. A write that dies before leaves
folders that no manifest names: readers keep the version before. A reader takes one version's folders and reads those,
whatever is written meanwhile.

A part holds the rows of one unit: of a day, or of a month for bulk loads. A day that is written again hides
that day in the part that held it; ``fold`` rewrites such months.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "_part"
NO_DATE = "none"
UNITS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


class Conflict(RuntimeError):
    """Another writer took the version first; nothing was changed."""


@dataclass(frozen=True)
class Part:
    """Rows of the days ``first`` to ``last`` in one folder, without those of the ``hidden`` days. Dates are ISO texts;
    the part of rows without a date has none."""

    folder: str
    first: str | None
    last: str | None
    write: int
    hidden: tuple[str, ...] = ()

    def overlaps(self, start: str | None, end: str | None) -> bool:
        if self.first is None:
            return start is None and end is None
        return (end is None or self.first <= end) and (start is None or self.last >= start)


class VersionedTable:
    """A table under ``path`` on any file system that Spark reads, with a date column and a declared schema.

    The driver handles names of parts only: one per day or month.
    """

    def __init__(self, spark: SparkSession, path: str, kind: T.StructType | str, date: str = "date"):
        self.spark, self.path, self.date = spark, path.rstrip("/"), date
        self.kind = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._root = self._fs.makeQualified(root)

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        found = (re.fullmatch(r"v(\d{9})\.json", name) for name in self._names("_versions"))
        return sorted(int(m[1]) for m in found if m)

    def parts(self, version: int | None = None) -> list[Part]:
        """The parts of a version, the latest if none is given; a table never written has none."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return []
        return [Part(**(p | {"hidden": tuple(p["hidden"])})) for p in json.loads(self._text(self._manifest(version)))["parts"]]

    def read(self, start: str | None = None, end: str | None = None, version: int | None = None, with_write: bool = False) -> DataFrame:
        """Rows between two days (both included) of one version, which later writes do not change.

        Only the folders of these days are listed and read. Rows without a date come only if no day is given.
        ``with_write`` adds the number of the version that wrote a row, as ``_write``.
        """
        rows = self._rows([p for p in self.parts(version) if p.overlaps(start, end)], with_write)
        day = F.col(self.date).cast("date")
        for test, bound in ((day.__ge__, start), (day.__le__, end)):
            if bound is not None:
                rows = rows.filter(test(F.lit(dt.date.fromisoformat(bound))))
        return rows

    def replace_all(self, df: DataFrame, unit: str = "month") -> int:
        """A new version that holds ``df`` alone, one part for each month (or day)."""
        base = max(self.versions(), default=0)
        return self._commit(base, self._write(df, unit, base + 1))

    def add_days(self, df: DataFrame) -> int:
        """A new version in which the days of ``df`` have its rows and all other days are as before.

        Only these days are written. A day that the table had before is replaced, as are rows without a date.
        """
        base = max(self.versions(), default=0)
        new = self._write(df, "day", base + 1)
        days = {p.first for p in new}
        return self._commit(base, [q for p in self.parts(base) if (q := _hide(p, days))] + new)

    def append(self, df: DataFrame, unit: str = "month") -> int:
        """A new version with the rows of ``df`` beside those of before, in parts of their own."""
        base = max(self.versions(), default=0)
        return self._commit(base, self.parts(base) + self._write(df, unit, base + 1))

    def fold(self, merge=lambda rows: rows) -> int:
        """A new version in which every month is one part; months that are one already stay as they are.

        ``merge`` may combine the rows of a month, which have the number of their write as ``_write``.
        """
        base = max(self.versions(), default=0)
        months: dict[str | None, list[Part]] = {}
        for part in self.parts(base):
            months.setdefault(part.first and part.first[:7], []).append(part)
        kept = [p[0] for p in months.values() if len(p) == 1 and not p[0].hidden]
        scattered = [p for of in months.values() if len(of) > 1 or of[0].hidden for p in of]
        if not scattered:
            return base
        rows = self._rows(scattered, with_write=True)
        return self._commit(base, kept + self._write(merge(rows), "month", base + 1))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` versions and the folders that only they or failed writes hold.

        Not while a write runs or a reader uses an older version. Returns the number of folders.
        """
        versions = self.versions()
        used = {p.folder.split("/")[1] for v in versions[-keep:] for p in self.parts(v)}
        for version in versions[:-keep]:
            self._fs.delete(self._at(self._manifest(version)), False)
        gone = [name for name in self._names("data") if name not in used]
        for name in gone:
            self._fs.delete(self._at(f"data/{name}"), True)
        return len(gone)

    def _write(self, df: DataFrame, unit: str, number: int) -> list[Part]:
        """Writes the rows into a new folder, one below for each unit; a large unit is dealt to several files."""
        folder = f"data/{number:09d}-{uuid.uuid4().hex}"
        names = [f.name for f in self.kind]
        typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.kind))
        part = F.coalesce(F.date_format(F.col(self.date).cast("date"), UNITS[unit]), F.lit(NO_DATE))
        rows = typed.withColumn(FOLDER, part).select(*names, FOLDER).hint("rebalance", FOLDER)
        rows.write.partitionBy(FOLDER).parquet(f"{self._root}/{folder}")
        found = sorted(name.split("=", 1)[1] for name in self._names(folder) if name.startswith(f"{FOLDER}="))
        return [Part(f"{folder}/{FOLDER}={value}", *_bounds(value), number) for value in found]

    def _commit(self, base: int, parts: Sequence[Part]) -> int:
        """Makes version ``base + 1``: the manifest is written aside, then renamed to a name that must be free."""
        target, draft = self._at(self._manifest(base + 1)), self._at(f"_versions/draft-{uuid.uuid4().hex}")
        text = json.dumps({"version": base + 1, "parts": [asdict(p) for p in parts]}).encode()
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._root.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise Conflict(f"version {base + 1} of {self.path} exists already") from error
            raise
        return base + 1

    def _rows(self, parts: Sequence[Part], with_write: bool = False) -> DataFrame:
        """The rows of some parts: one scan for all that hide the same days."""
        groups: dict[tuple[str, ...], list[str]] = {}
        for part in parts:
            groups.setdefault(part.hidden, []).append(f"{self._root}/{part.folder}")
        write = F.regexp_extract("_metadata.file_path", r"/data/(\d+)-", 1).cast("long").alias("_write")
        extra = [write] if with_write else []
        scans = [self._without(self.spark.read.schema(self.kind).parquet(*folders).select("*", *extra), hidden)
                 for hidden, folders in sorted(groups.items())]
        if not scans:
            empty = self.spark.createDataFrame([], self.kind)
            scans = [empty.withColumn("_write", F.lit(0).cast("long")) if with_write else empty]
        return reduce(DataFrame.unionAll, scans)

    def _without(self, rows: DataFrame, hidden: Sequence[str]) -> DataFrame:
        if not hidden:
            return rows
        days = [F.lit(dt.date.fromisoformat(d)) for d in hidden]
        return rows.filter(~F.col(self.date).cast("date").isin(*days))

    def _manifest(self, version: int) -> str:
        return f"_versions/v{version:09d}.json"

    def _at(self, name: str):
        return self._hadoop.Path(self._root, name)

    def _names(self, folder: str) -> list[str]:
        place = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def _bounds(value: str) -> tuple[str | None, str | None]:
    """First and last day of a folder's unit."""
    if value == NO_DATE or value.startswith("__"):
        return None, None
    if len(value) == 10:
        return value, value
    first = dt.date.fromisoformat(f"{value}-01")
    return first.isoformat(), ((first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)).isoformat()


def _hide(part: Part, days: set[str | None]) -> Part | None:
    """The part without some days; None if nothing is left of it."""
    if part.first is None or part.first == part.last:
        return None if part.first in days else part
    again = {d for d in days if d is not None and part.first <= d <= part.last}
    return replace(part, hidden=tuple(sorted({*part.hidden, *again}))) if again else part


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order, reduced on both sides of the shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")
