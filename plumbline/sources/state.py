"""State tables as versioned Parquet snapshots and append-only logs.

A snapshot of table t lies in a folder <root>/t/d=<id> of its own and becomes version n by the small file
<root>/t/_claims/n that names it; only one writer can create that file, and readers take the largest n whose file names a
folder. So a half-written snapshot is never read, a table is never overwritten while it is read, and of two writers that
began with the same version one gets the next and the other is told. A log lies in <root>/t/run_id=<id>; a run that is
repeated replaces its own part. All goes through Hadoop's file systems.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a claim that names nothing is one of a writer that broke off.
GRACE = 5


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    #: Who wrote it, if the writer said.
    by: str


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _children(self, name: str, prefix: str) -> list[str]:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs, _ = self._fs(f"{self.root}/{name}")
        return [n for n in self._names(f"{self.root}/{name}") if n.startswith(prefix) and fs.exists(done(f"{self.root}/{name}/{n}/_SUCCESS"))]

    def _claims(self, name: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/{name}/_claims") if n.isdigit())

    def _claimed(self, name: str, number: int) -> Version | None:
        """The version that a claim names; None as long as it names none."""
        fs, at = self._fs(f"{self.root}/{name}/_claims/{number}")
        size = fs.getFileStatus(at).getLen()
        if not size:
            return None
        stream = fs.open(at)
        try:
            folder, _, by = bytes(stream.readNBytes(int(size))).decode().partition(" ")
        finally:
            stream.close()
        return Version(number, folder, by)

    def versions(self, name: str, after: int = 0) -> list[Version]:
        """All versions after a number, also those whose rows are gone; claims of writers that broke off aren't among them."""
        found = (self._claimed(name, n) for n in self._claims(name) if n > after)
        return [v for v in found if v]

    def _newest(self, name: str) -> Version | None:
        return next((v for n in reversed(self._claims(name)) if (v := self._claimed(name, n))), None)

    def version(self, name: str) -> int:
        """The newest version's number; 0 if there is none."""
        found = self._newest(name)
        return found.number if found else 0

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest one."""
        found = self._newest(name) if version is None else self._claimed(name, version) if version else None
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{found.folder}") if found else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, keep: int = 2, *, base: int | None = None, by: str = "") -> int | None:
        """Writes df as the next version and gives its number, then removes the rows of versions older than the last keep.

        base: the version that df was made from. If there is a newer one by now, nothing is changed and None is given.
        Without a base the last writer wins. A claim that names nothing is waited for, then passed over.
        """
        folder = f"d={uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        number = (self.version(name) if base is None else base) + 1
        while not self._claim(f"{self.root}/{name}/_claims/{number}", f"{folder} {by}"):
            if base is not None and self._taken(name, number):
                self._remove(f"{self.root}/{name}/{folder}")
                return None
            number += 1
        for v in self.versions(name, number - keep - 50):  # and those that a writer before left
            if v.number <= number - keep:
                self._remove(f"{self.root}/{name}/{v.folder}")
        return number

    def _taken(self, name: str, number: int) -> bool:
        """Whether a claim names a version, now or within GRACE seconds of its making."""
        fs, at = self._fs(f"{self.root}/{name}/_claims/{number}")
        while (found := self._claimed(name, number)) is None and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 < GRACE:
            time.sleep(0.1)
        return found is not None

    def _remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _claim(self, path: str, text: str = "") -> bool:
        fs, at = self._fs(path)
        fs.mkdirs(at.getParent())
        try:
            out = fs.create(at, False)
        except Exception:
            if fs.exists(at):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def has(self, name: str, run_id: str) -> bool:
        """Whether a log has the complete part of a run."""
        fs, at = self._fs(f"{self.root}/{name}/run_id={run_id}/_SUCCESS")
        return fs.exists(at)

    def part(self, name: str, schema, run_id: str) -> DataFrame:
        """One run's part of a log, without run_id."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/run_id={run_id}")

    def append(self, name: str, df: DataFrame, run_id: str) -> None:
        df.drop("run_id").write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={run_id}")

    def parts(self, name: str, prefix: str) -> list[str]:
        """The complete parts of a log whose ids begin so."""
        return sorted(p[7:] for p in self._children(name, f"run_id={prefix}"))

    def remove(self, name: str, run_id: str) -> None:
        """Takes a part out of a log."""
        self._remove(f"{self.root}/{name}/run_id={run_id}")

    def log(self, name: str, schema: str) -> DataFrame:
        """All complete parts of a log, with run_id; one scan, however many runs there are."""
        parts = [f"{self.root}/{name}/{p}" for p in sorted(self._children(name, "run_id="))]
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, run_id string")
        return self.spark.read.schema(f"{schema}, run_id string").option("basePath", f"{self.root}/{name}").parquet(*parts)
