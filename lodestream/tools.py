"""The engine's tools as one object: roots, index jobs and the three searches over what they built."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encoders, fusion, lexical, vector
from .plans import build
from .sources import files, store
from .sources.manifest import Log

STATES = ("idle", "running", "completed", "failed", "cancelled", "interrupted")


@dataclass
class Job:
    """One run of the index: its state, its counts so far, the root it works on, and its errors."""

    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "running"
    counts: dict = field(default_factory=lambda: dict.fromkeys(build._COUNTS, 0))
    error: str | None = None
    current: str | None = None
    recent_errors: list = field(default_factory=list)
    cancel: threading.Event = field(default_factory=threading.Event)


def reconciled(runs: DataFrame) -> DataFrame:
    """Stored runs after a crash: what was under way is interrupted."""
    return runs.withColumn("state", F.when(F.col("state").isin("running", "preparing_model"), "interrupted").otherwise(F.col("state")))


class Tools:
    """One index; at most one job runs at a time, works batch by batch of files, and can be cancelled between batches and through its Spark jobs.

    Every batch is a commit of the log below `path`, so that what is done stays, whatever happens
    then; another object that opens the same path goes on there.
    """

    #: Files of a batch, whose paths the driver holds, and errors that a status tells.
    BATCH, ERRORS = 2000, 5

    def __init__(self, spark: SparkSession, encoder: encoders.Encoder | None = None, path: str | None = None):
        self.spark, self.encoder = spark, encoder
        self.roots: dict[str, bool] = {}
        self.log = Log(spark, path or store.fresh(spark, "tools"))
        self.interrupted = self.log.reconcile()
        self.state, self.job = build.opened(self.log), None
        self._lock, self._thread = threading.Lock(), None

    def add_search_path(self, path: str, recursive: bool = True) -> str:
        own = files.validate_root(path, list(self.roots))
        self.roots[own] = recursive
        return own

    def remove_search_path(self, path: str) -> bool:
        """Takes a root and all that was indexed below it away."""
        if self.roots.pop(path, None) is None:
            return False
        under = self.log.begin()
        state = build.forget(self.state, path, under)
        under.commit(state.as_json())
        self.state = state
        return True

    def list_search_paths(self) -> DataFrame:
        """Roots in the order they were added, with the counts of their files by status."""
        own = self.spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(self.roots.items(), 1)], "root_id int, path string, recursive boolean")
        n = lambda s: F.count_if(F.col("status") == s).alias(s)
        per = self.state.files.groupBy(F.col("root").alias("path")).agg(n("indexed"), n("failed"), n("skipped"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return own.join(per, "path", "left").select("root_id", "path", "recursive", zero("indexed"), zero("failed"), zero("skipped")).orderBy("root_id")

    def start_indexing(self, paths: list[str] | None = None, mode: str = "incremental", wait: bool = False) -> Job:
        """Starts a job over the given roots (all, if none is given); ValueError for an unknown root, RuntimeError while another job runs."""
        unknown = [p for p in paths or [] if p not in self.roots]
        if unknown:
            raise ValueError(f"not a search path: {', '.join(unknown)}")
        with self._lock:
            if self.job and self.job.state == "running":
                raise RuntimeError("an index job is running")
            self.job = job = Job()
        self._thread = threading.Thread(target=self._work, args=(job, list(paths or self.roots), mode == "full"), daemon=True)
        self._thread.start()
        if wait:
            self._thread.join()
        return job

    def _step(self, job: Job, now: DataFrame, roots: list[str], force: bool) -> None:
        """One batch of files as a run and a commit; its counts are added to the job's."""
        under = self.log.begin()
        try:
            state, counts = build.run(self.state, now, roots, force=force, under=under, make=type(self.encoder) if self.encoder else None)
            under.commit(state.as_json())
        except Exception:
            under.abort()
            raise
        self.state = state
        job.counts = {k: job.counts[k] + counts[k] for k in job.counts}
        self.log.clean()

    def _work(self, job: Job, roots: list[str], force: bool) -> None:
        context = self.spark.sparkContext
        try:
            context.setJobGroup(job.job_id, "index", interruptOnCancel=True)
            for root in roots:
                job.current, recursive = root, self.roots[root]
                found = files.listed(self.spark, root, recursive)
                paths = (r.path for r in found.select("path").toLocalIterator())
                for part in iter(lambda: list(islice(paths, self.BATCH)), []):
                    if job.cancel.is_set():
                        break
                    self._step(job, files.loaded(self.spark, part, root, recursive), [], force)
                    errors = self.state.files.where(F.col("path").isin(*part[: self.BATCH]) & F.col("error").isNotNull()).select("path", "error").limit(self.ERRORS).collect()
                    job.recent_errors = ([f"{r.path}: {r.error}" for r in errors] + job.recent_errors)[: self.ERRORS]
                if job.cancel.is_set():
                    break
                # What the walk has not met goes once it is complete, and only then.
                gone = self.state.files.where(F.col("root") == root).join(found.select("path"), "path", "left_anti").select("file_id")
                removed = gone.count()
                if removed:
                    under = self.log.begin()
                    state = build.prune(self.state, gone, under)
                    under.commit(state.as_json())
                    self.state = state
                    job.counts = job.counts | {"removed": job.counts["removed"] + removed}
            job.state = "cancelled" if job.cancel.is_set() else "completed"
        except Exception as e:  # the job's own state tells of it
            job.state, job.error = "cancelled" if job.cancel.is_set() else "failed", str(e)[:500]
        finally:
            job.current = None

    def cancel_indexing(self) -> bool:
        if not self.job or self.job.state != "running":
            return False
        self.job.cancel.set()
        self.spark.sparkContext.cancelJobGroup(self.job.job_id)
        return True

    def get_index_status(self) -> dict:
        """The running or last job with its counts so far, and how many files and chunks the last commit holds; live values stand before stored ones."""
        job, state = self.job, self.state
        out = {"state": job.state if job else "idle", "job_id": job.job_id if job else None, "error": job.error if job else None, "current": job.current if job else None, "recent_errors": list(job.recent_errors) if job else []}
        return out | (job.counts if job else {}) | {"files": state.files.count(), "all_chunks": state.index.n}

    def _index(self) -> store.Index:
        return store.Index(self.state.files, self.state.index)

    def search_fulltext(self, query: str, limit: int = 10, path_prefix: str | None = None, extensions: list[str] | None = None) -> DataFrame:
        return lexical.search(self._index(), query, _limit(limit), path_prefix, extensions).drop("bm25")

    def search_semantic(self, query: str, limit: int = 10, path_prefix: str | None = None, extensions: list[str] | None = None) -> DataFrame:
        """The stored vectors nearest to the query's, the only text that is encoded; RuntimeError without an encoder."""
        asked = encoders.query_vector(query, self.encoder) if self.encoder is not None else None
        if asked is None:
            raise RuntimeError("no encoder is ready")
        near = vector.nearest_stored(self._index(), asked, _limit(limit), lexical.filters(path_prefix, extensions))
        return near.select("rank", "chunk_id", "path", F.coalesce("text_path", "path").alias("text_path"), "start_line", "end_line", F.round(vector.similarity(F.col("distance")), 6).alias("score"))

    def search_hybrid(self, query: str, limit: int = 10, path_prefix: str | None = None, extensions: list[str] | None = None) -> DataFrame:
        """Both lists fused; the full-text list alone, with a note, where there is no encoder."""
        pool = fusion.pool(_limit(limit))
        lists = {"fts": lexical.search(self._index(), query, pool, path_prefix, extensions).select("chunk_id", "rank")}
        if self.encoder is not None:
            lists["vector"] = self.search_semantic(query, min(pool, 50), path_prefix, extensions).select("chunk_id", "rank")
        note = None if self.encoder is not None else "full-text only: no encoder is ready"
        places = self._index().chunks.select("chunk_id", "path", "start_line", "end_line")
        return fusion.rrf(lists, limit).join(places, "chunk_id").withColumn("note", F.lit(note).cast("string"))


def _limit(limit: int) -> int:
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    return limit
