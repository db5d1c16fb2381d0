"""A pattern library kept as versions in a shared folder, replaced as a whole or not at all.

A version is a Parquet table of its patterns with their place and what the screening said of each, written to
a folder of its own. It is published by a numbered file that names the folder: the file is created only
if no other has its number, so of two writers one wins and the other is told. Readers follow the highest
number; a version that was never published is never read.

Defined cases: a document with a pattern that can't be used is refused whole, with what is wrong with each; a folder
without a version is an empty library, number 0; an unfinished publication is passed over.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackline.operators import rules, screen

SCHEMA = "place int, pattern string, regex string, verdict string"


class Refused(ValueError):
    """A document that isn't stored; ``wrong`` has what is wrong, by place."""

    def __init__(self, wrong: list[tuple[int, list[str]]]):
        super().__init__("; ".join(f"pattern {k + 1}: {', '.join(w)}" for k, w in wrong))
        self.wrong = wrong


class Conflict(RuntimeError):
    """Another version was published meanwhile."""


class Library:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _published(self) -> dict[int, str]:
        """Folders of versions by number."""
        if not self._files.exists(self._path("published")):
            return {}
        found = {}
        for status in self._files.listStatus(self._path("published")):
            name = status.getPath().getName()
            if name.isdigit() and status.getLen():
                stream = self._files.open(status.getPath())
                found[int(name)] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return found

    def _numbers(self) -> list[int]:
        """Numbers that were taken, whether or not their publication was finished."""
        if not self._files.exists(self._path("published")):
            return [0]
        return [0, *(int(n) for s in self._files.listStatus(self._path("published")) if (n := s.getPath().getName()).isdigit())]

    def number(self) -> int:
        return max(self._published(), default=0)

    def table(self, number: int | None = None) -> DataFrame:
        """place, pattern (JSON), regex and verdict of a version, the last if none is named."""
        found = self._published()
        number = max(found, default=0) if number is None else number
        if not number:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{found[number]}")

    def patterns(self, number: int | None = None) -> list[dict]:
        """The patterns of a version in order of use; a library has 200 at most."""
        return [json.loads(r["pattern"]) for r in self.table(number).orderBy("place").collect()]

    def replace(self, document: str | bytes | dict | list, expected: int | None = None) -> int:
        """Store a document's patterns in place of all; the new number. ``expected``: the number that is to be replaced."""
        good, bad = rules.imported(document)
        if bad:
            raise Refused(bad)
        before = self.number()
        if expected is not None and expected != before:
            raise Conflict(f"version {before} is there, not {expected}")
        rows = self.spark.createDataFrame([(k, json.dumps(p, ensure_ascii=False), p["regex"]) for k, p in enumerate(good)], "place int, pattern string, regex string")
        name = f"version-{uuid.uuid4().hex}"
        rows.join(screen.screened(rows), "regex").select("place", "pattern", "regex", "verdict").coalesce(1).write.parquet(f"{self.folder}/{name}")
        number = max(self._numbers()) + 1 if expected is None else max(max(self._numbers()), expected) + 1
        self._publish(number, name)
        return number

    def _publish(self, number: int, name: str) -> None:
        try:
            stream = self._files.create(self._path(f"published/{number:08d}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {number} was published meanwhile") from e
        stream.write(bytearray(name.encode()))
        stream.close()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Patterns of two versions side by side: regex, and whether each is new, gone, moved or kept."""
    a, b = (t.select("regex", F.col("place").alias(n), F.col("pattern").alias(f"{n}_pattern")) for t, n in ((before, "before"), (after, "after")))
    both = a.join(b, "regex", "full_outer")
    what = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "moved").otherwise("kept")
    return both.select("regex", what.alias("change"))
