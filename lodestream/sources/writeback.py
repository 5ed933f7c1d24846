"""Settings files written back: a Python data source with backups, a dry run and a commit in two phases.

Tasks write each file into a folder of the run's own below the root; nothing that a reader sees changes.
When all tasks are done, the commit keeps a copy of each file as it was and renames the new one onto its
place; when a task fails, the abort deletes that folder, with what killed tasks left, and every file is
as it was. The root must be a folder that all executors have mounted. What the driver
holds is one path a file. Rows are path and text; a null text is an error. With dry_run
the rows are read and checked, and nothing is written.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "settings_files"
#: What the copy of a file as it was is called.
BACKUP = ".bak"


@dataclass
class Written(WriterCommitMessage):
    pairs: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, root: str, dry: bool):
        self.dry, self.stage = dry, f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"
        if not dry:
            os.makedirs(self.stage)

    def write(self, iterator) -> Written:
        pairs: list[tuple[str, str]] = []
        for row in iterator:
            if row.raw is None:
                raise ValueError(f"no text for {row.path}")
            if not self.dry and not self._same(row.path, row.raw):
                new = f"{self.stage}/{uuid.uuid4().hex}"
                with open(new, "w", encoding="utf-8") as f:
                    f.write(row.raw)
                pairs.append((row.path, new))
        return Written(pairs)

    @staticmethod
    def _same(path: str, raw: str) -> bool:
        try:
            with open(path, encoding="utf-8") as f:
                return f.read() == raw
        except (OSError, UnicodeDecodeError):
            return False

    def commit(self, messages) -> None:
        pairs = [p for m in messages if m for p in m.pairs]
        for folder in {os.path.dirname(path) for path, _ in pairs}:
            os.makedirs(folder, exist_ok=True)
        for path, new in pairs:
            self._kept(path)
            os.replace(new, path)
        self.abort(messages)

    @staticmethod
    def _kept(path: str) -> None:
        """The file as it is under its backup's name too: a second name of it, which costs no copy, or a copy where a mount has no such names."""
        try:
            os.link(path, path + BACKUP)
        except FileNotFoundError:
            return
        except OSError:
            # There is a backup already, which another file replaces at once.
            spare = f"{path}{BACKUP}-{uuid.uuid4().hex}"
            shutil.copy2(path, spare)
            os.replace(spare, path + BACKUP)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class SettingsFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, raw string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["root"], self.options.get("dry_run", "false") == "true")


def write(rows: DataFrame, root: str, dry_run: bool = False) -> None:
    """Rows of path (below the root) and raw as files; all of them or, where one fails, none."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(SettingsFiles)
    rows.select("path", "raw").write.format(NAME).option("root", root).option("dry_run", str(dry_run).lower()).mode("append").save()
