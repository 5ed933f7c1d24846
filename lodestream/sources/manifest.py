"""Runs as commits: numbered snapshots in a log, made visible by one rename, and the files that no snapshot names.

A folder holds `log` and `data`. A run opens with a marker in the log and writes below a data folder of
its own, so that all it leaves behind is known by its name. Its commit writes the next snapshot (JSON:
what the state is made of, by path) under another name and renames it; a rename onto a snapshot that
is there already fails, so that of two runs that began at one snapshot only the first commits. Readers
see the last snapshot and never a part of a run. A run that died leaves its marker: `reconcile` tells
it as interrupted and deletes its folder. `clean` deletes the tables that neither the last snapshots
nor a run under way name.

The log is small (one file a run) and read by the driver alone; any Hadoop file system will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


class Folder:
    """A folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file whole or not at all; Conflict if it is there."""
        hidden = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(hidden, self._at(name), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(hidden, False)
            if self._fs.exists(self._at(name)):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, rows: int = 0, more: bool = False) -> None:
    """df as Parquet at a path (`more`: besides what is there), in files of at most so many rows; the shuffle files of this write, which nothing else reads, go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append" if more else "errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


@dataclass
class Run:
    """A run under way: where it writes, and the snapshot it began at."""

    log: Log
    name: str
    base: int
    kept: list[str] = field(default_factory=list)

    def path(self, name: str) -> str:
        """A new folder of the run's own."""
        return f"{self.log.folder.path}/data/{self.name}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written to a folder of the run and read back."""
        path = self.path(name)
        written(df, path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Deletes a folder of the run that nothing reads any more."""
        self.log.folder.delete(path.removeprefix(f"{self.log.folder.path}/"))

    def commit(self, state: dict) -> int:
        return self.log.commit(self, state)

    def abort(self) -> None:
        self.log.close(self, "aborted")


class Log:
    """The log of one folder; `keep` snapshots stay readable after `clean`."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, Folder(spark, path), keep

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("log") if n[:1].isdigit() and n.endswith(".json")]

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """The last (or a given) snapshot's number and state; 0 and nothing before the first."""
        number = number if number is not None else max(self.numbers(), default=0)
        return number, json.loads(self.folder.read(f"log/{number:08d}.json"))["state"] if number else {}

    def begin(self) -> Run:
        run = Run(self, uuid.uuid4().hex, max(self.numbers(), default=0))
        self.folder.write(f"log/open-{run.name}", json.dumps({"base": run.base}))
        return run

    def commit(self, run: Run, state: dict) -> int:
        """Makes the state the next snapshot; Conflict, with the run's files deleted, if there is one already."""
        try:
            self.folder.write(f"log/{run.base + 1:08d}.json", json.dumps({"run": run.name, "state": state}))
        except Conflict:
            self.close(run, "lost")
            raise
        self.folder.delete(f"log/open-{run.name}")
        return run.base + 1

    def close(self, run: Run, how: str) -> None:
        """Ends a run without a snapshot: its files go, its end is told."""
        self.folder.delete(f"data/{run.name}")
        self.folder.write(f"log/{how}-{run.name}", json.dumps({"base": run.base}))
        self.folder.delete(f"log/open-{run.name}")

    def reconcile(self, alive: tuple[str, ...] = ()) -> list[str]:
        """Runs that neither ended nor are alive: interrupted now, and their files gone. One that died after its commit is no such run."""
        done = {json.loads(self.folder.read(f"log/{n:08d}.json"))["run"] for n in self.numbers()}
        out = []
        for name in [n[5:] for n in self.folder.names("log") if n.startswith("open-")]:
            if name in done:
                self.folder.delete(f"log/open-{name}")
            elif name not in alive:
                out.append(name)
                self.close(Run(self, name, -1), "interrupted")
        return out

    def runs(self) -> list[tuple[str, str]]:
        """Every run's name and state."""
        done = [(json.loads(self.folder.read(f"log/{n:08d}.json"))["run"], "completed") for n in self.numbers()]
        ended = {name for name, _ in done}
        rest = [n.partition("-") for n in self.folder.names("log") if "-" in n]
        return done + [(name, "running" if how == "open" else how) for how, _, name in rest if name not in ended]

    def clean(self) -> list[str]:
        """Deletes the tables that neither the last snapshots nor runs under way name; tells them."""
        named = [json.dumps(self.state(n)[1]) for n in self.numbers()[-self.keep :]]
        under_way = {n[5:] for n in self.folder.names("log") if n.startswith("open-")}
        gone = []
        for run in self.folder.names("data"):
            if run in under_way:
                continue
            tables = self.folder.names(f"data/{run}")
            left = [t for t in tables if not any(f"data/{run}/{t}" in text for text in named)]
            gone += [f"data/{run}/{t}" for t in left]
            for t in left:
                self.folder.delete(f"data/{run}/{t}")
            if len(left) == len(tables):
                self.folder.delete(f"data/{run}")
        return gone
