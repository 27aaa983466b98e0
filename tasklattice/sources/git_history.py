"""Issues as of a revision, and commit logs, from a git repository on the driver."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import tempfile
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tasklattice.sources import jsonl
from tasklattice.workspace import scratch

# File names of the data format, in order, and date layouts.
FILES = ("beads.jsonl", "issues.jsonl", "beads.base.jsonl")
LAYOUTS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


def parse_date(text: str) -> dt.datetime | None:
    """By the first layout that fits; local time where none is said."""
    for layout in LAYOUTS:
        try:
            found = dt.datetime.strptime(text.strip(), layout)
        except ValueError:
            continue
        return found if found.tzinfo else found.astimezone()
    return None


@dataclass
class History:
    spark: SparkSession
    repo: str
    folder: str = ".beads"
    ttl_seconds: float = 300.0
    _cache: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def _git(self, *args: str) -> str:
        done = subprocess.run(["git", "-C", self.repo, *args], capture_output=True, text=True, timeout=60)
        if done.returncode:
            raise LookupError(done.stderr.strip())
        return done.stdout

    def resolve(self, revision: str) -> str:
        """The commit of a revision, or else the last one up to a date."""
        try:
            return self._git("rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}").strip()
        except LookupError:
            at = parse_date(revision)
            sha = self._git("rev-list", "-1", f"--before={at.isoformat()}", "HEAD").strip() if at else ""
            if not sha:
                raise LookupError(f"no revision {revision}") from None
            return sha

    def _file(self, sha: str) -> str | None:
        """The first file of the data format that a commit has."""
        for name in FILES:
            try:
                self._git("cat-file", "-e", f"{sha}:{self.folder}/{name}")
            except LookupError:
                continue
            return name
        return None

    def _copy(self, sha: str, name: str) -> str:
        """A file of a commit, streamed to the folder that executors share; no process holds it as a whole."""
        path = scratch(self.spark, "revision")
        handle, own = tempfile.mkstemp(prefix="revision-")
        try:
            with os.fdopen(handle, "wb") as f:
                done = subprocess.run(["git", "-C", self.repo, "-c", "core.bigFileThreshold=1m", "cat-file", "blob", f"{sha}:{self.folder}/{name}"], stdout=f, stderr=subprocess.PIPE)
            if done.returncode:
                raise LookupError(done.stderr.decode(errors="replace").strip())
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            to = jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{own}"), to)
        finally:
            os.unlink(own)
        return path

    def exists_at(self, revision: str) -> bool:
        return self._file(self.resolve(revision)) is not None

    def load(self, revision: str) -> DataFrame:
        """Issues at a revision, kept for a while by commit."""
        sha, now = self.resolve(revision), time.monotonic()
        if sha in self._cache and now - self._cache[sha][0] <= self.ttl_seconds:
            return self._cache[sha][1]
        name = self._file(sha)
        if name is None:
            raise LookupError(f"no issues at {revision}")
        issues = jsonl.parse(self.spark.read.text(self._copy(sha, name), lineSep="\n"))[0].cache()
        self._cache[sha] = (now, issues)
        return issues

    def load_at(self, at: dt.datetime) -> DataFrame:
        return self.load(at.isoformat())

    def clear(self) -> None:
        for _, df in self._cache.values():
            df.unpersist()
        self._cache.clear()

    def cache_stats(self) -> dict[str, int]:
        """Expired entries still count in total."""
        now = time.monotonic()
        return {"total": len(self._cache), "valid": sum(now - t <= self.ttl_seconds for t, _ in self._cache.values())}

    def _log(self, *args: str) -> DataFrame:
        out = self._git("log", "--format=%H|%cI|%s", *args, "--", self.folder)
        rows = []
        for line in out.splitlines():
            parts = line.split("|", 2)
            if len(parts) == 3:
                rows.append((parts[0], dt.datetime.fromisoformat(parts[1]), parts[2]))
        return self.spark.createDataFrame(rows, "sha string, timestamp timestamp, message string")

    def revisions(self, limit: int = 0) -> DataFrame:
        """Newest first; all without a limit."""
        return self._log(*([f"-{limit}"] if limit > 0 else []))

    def between(self, old: str, new: str) -> DataFrame:
        """Commits after ``old`` up to ``new``."""
        return self._log(f"{old}..{new}")
