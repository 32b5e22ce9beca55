"""Tables that are replaced whole: numbered commits, one winner for each number, and nothing lost wherever a run is cut.

A table's folder holds data folders, each written by one run, and ``commits``, where file ``n`` names what is live from commit n on. A run reads the number it
starts from, writes its data beside all others, checks what it wrote, and puts file n + 1 in place only if nobody else has: the file is complete before it has its
name, and the name can be given once. So

- readers see the commit before or the commit after, never a part;
- of two runs that start from one commit the second to finish is refused and has changed nothing;
- a run that is cut leaves the table as it was. Its folder's name tells the commit it started from, and once that isn't the last any more the run could no longer
  commit, so ``clean`` may remove the folder without a clock or a lock.

The put-if-absent is a rename that doesn't replace; on a local disk, where such a rename isn't atomic, a hard link.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import joined

_DIGITS = 12


class Conflict(RuntimeError):
    """Another run committed first."""


class Refused(ValueError):
    """What was written isn't what should go live."""


class Damaged(ValueError):
    """The live files aren't those that were committed."""


@dataclass
class Commit:
    number: int
    folder: str | None = None
    stamp: str | None = None
    provenance: dict[str, str] | None = None
    files: dict[str, int] = field(default_factory=dict)


class Table:
    """A table in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *parts: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def exists(self) -> bool:
        return self._fs.exists(self._at())

    def _names(self, *parts: str) -> dict[str, int]:
        at = self._at(*parts)
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def commit(self, number: int) -> Commit:
        stream = self._fs.open(self._at("commits", f"{number:0{_DIGITS}}.json"))
        try:
            return Commit(**json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()

    def last(self) -> Commit:
        """What is live; number 0 where nothing was committed yet."""
        numbers = self._numbers()
        return self.commit(numbers[-1]) if numbers else Commit(0)

    def _put(self, commit: Commit) -> None:
        self._fs.mkdirs(self._at("commits"))
        draft, name = self._at("commits", f".{uuid.uuid4().hex}"), self._at("commits", f"{commit.number:0{_DIGITS}}.json")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(asdict(commit), sort_keys=True).encode())
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                nio = self._jvm.java.nio.file
                local = lambda p: nio.Path.of(self._jvm.java.net.URI("file", None, p.toUri().getPath(), None))
                nio.Files.createLink(local(name), local(draft))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
                plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(name), plain)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                raise Conflict(f"{self.path}: another run made commit {commit.number}; read it and start again from there") from e
            raise
        finally:
            self._fs.delete(draft, False)

    def replace(self, df: DataFrame, stamp: str | None = None, provenance: dict[str, str] | None = None, expected: DataFrame | None = None, check: Callable[[DataFrame], str | None] | None = None) -> Commit:
        """Write ``df`` and make it the table. ``expected`` holds the keys that must be there, all of them and no others; ``check`` may say what is wrong with the table as it was written."""
        base = self.last()
        folder = f"v{base.number}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        # Every file that is there must be readable, so all of them are read once, whole.
        files = {n: size for n, size in self._names(folder).items() if not n.startswith(("_", "."))}
        staged = self._read(folder, files, df)
        if (problem := _wrong_keys(staged, expected)) or (check is not None and (problem := check(staged))):
            self._fs.delete(self._at(folder), True)
            raise Refused(f"{self.path}: {problem}")
        commit = Commit(base.number + 1, folder, stamp, provenance if provenance is not None else base.provenance, files)
        self._put(commit)
        return commit

    def record(self, provenance: dict[str, str]) -> Commit:
        """The same data with other provenance."""
        last = self.last()
        commit = Commit(last.number + 1, last.folder, last.stamp, provenance, last.files)
        self._put(commit)
        return commit

    def _read(self, folder: str, files: dict[str, int], like: DataFrame | None = None) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], like.schema) if like is not None else self.spark.read.parquet(f"{self.path}/{folder}")
        return self.spark.read.parquet(*[f"{self.path}/{folder}/{n}" for n in sorted(files)])

    def read(self, number: int | None = None) -> DataFrame:
        """The table of a commit, by default of the last; refused unless its files are exactly those that were committed."""
        commit = self.last() if number is None else self.commit(number)
        if commit.folder is None:
            raise LookupError(f"{self.path} has no data yet")
        there = {n: size for n, size in self._names(commit.folder).items() if not n.startswith(("_", "."))}
        wrong = [f"{n} is {'missing' if n not in there else 'unknown' if n not in commit.files else 'of another length'}" for n in sorted({*there, *commit.files}) if there.get(n) != commit.files.get(n)]
        if wrong:
            raise Damaged(f"{self.path}, commit {commit.number}: {'; '.join(wrong)}")
        return self._read(commit.folder, commit.files)

    def clean(self, keep: int = 2) -> list[str]:
        """Remove what no run can need: data of commits before the last ``keep``, folders of runs that can't commit any more, and drafts of cut runs. Tells what went."""
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        held = {self.commit(n).folder for n in numbers[-keep:]}
        gone = []
        for name in self._names():
            base = name.removeprefix("v").partition("-")[0]
            if name.startswith("v") and base.isdigit() and name not in held and int(base) < last:
                self._fs.delete(self._at(name), True)
                gone.append(name)
        for number in numbers[:-keep]:
            name = f"{number:0{_DIGITS}}.json"
            self._fs.delete(self._at("commits", name), False)
            gone.append(name)
        return gone


def _wrong_keys(staged: DataFrame, expected: DataFrame | None) -> str | None:
    if expected is None:
        staged.agg(*[F.count(c) for c in staged.columns]).first()  # reads every column of every file
        return None
    keys = expected.columns
    staged.agg(*[F.count(c) for c in staged.columns]).first()
    have, want = staged.select(*keys).distinct().withColumn("_have", F.lit(1)), expected.distinct().withColumn("_want", F.lit(1))
    missing = joined(want, have, keys, "left").where(F.col("_have").isNull()).count()
    extra = joined(have, want, keys, "left").where(F.col("_want").isNull()).count()
    found = [f"{n} keys of {', '.join(keys)} are {what}" for n, what in ((missing, "missing"), (extra, "unexpected")) if n]
    return "; ".join(found) or None
