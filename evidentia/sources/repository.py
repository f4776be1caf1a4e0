"""Source files of a repository as a DataFrame, and a Python data source for the commits of a git repository."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidentia.functions.paths import is_excluded, is_typescript, language


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), language, bytes, hash and text of every .ts and .tsx file below ``root``, other directories' files left out.

    Symbolic links of a local root are skipped, as they may leave it. ``text`` is for fact extraction only and is dropped there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][sS]*").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    relative = F.expr(f"substring(path, {len(prefix) + 1})")
    links = [os.path.relpath(os.path.join(d, n), root) for d, dirs, names in os.walk(root) for n in (*dirs, *names) if os.path.islink(os.path.join(d, n))] if os.path.isdir(root) else []
    rows = files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("text"))
    kept = rows.where(is_typescript(F.col("path")) & ~is_excluded(F.col("path")))
    for link in links:
        kept = kept.where((F.col("path") != link) & ~F.col("path").startswith(link + "/"))
    return kept.select("path", language(F.col("path")).alias("language"), "bytes", "hash", "text")


class GitCommits(DataSource):
    """``spark.read.format("git-commits").option("path", repo)``: a row for each changed path of each commit of HEAD's history.

    Commit ids are split into ranges that executors read on their own; all need the repository's folder. Options: path,
    revision (HEAD), partitions (8). Merges are listed with the changes against their first parent.
    """

    @classmethod
    def name(cls) -> str:
        return "git-commits"

    def schema(self) -> str:
        return "sha string, parents array<string>, summary string, committed_at long, position long, status string, path string"

    def reader(self, schema) -> GitReader:
        return GitReader(self.options["path"], self.options.get("revision", "HEAD"), int(self.options.get("partitions", "8")))


class GitReader(DataSourceReader):
    def __init__(self, path: str, revision: str, count: int):
        self.path, self.revision, self.count = path, revision, count

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.path, *args], check=True, capture_output=True, text=True, errors="replace").stdout

    def _entries(self, *args: str) -> Iterator[str]:
        """The parts of git's output between marks, as they come: a partition's log is never held as a whole."""
        with subprocess.Popen(["git", "-C", self.path, *args], stdout=subprocess.PIPE) as run:
            rest = b""
            while chunk := run.stdout.read(1 << 16):
                *whole, rest = (rest + chunk).split(b"\x01")
                for part in whole:
                    yield part.decode(errors="replace")
            yield rest.decode(errors="replace")
        if run.returncode:
            raise subprocess.CalledProcessError(run.returncode, "git")

    def partitions(self) -> list[InputPartition]:
        # Resolved once: a commit made meanwhile moves no partition's range.
        commit = self._git("rev-parse", "--verify", "--end-of-options", f"{self.revision}^{{commit}}").strip()
        n = int(self._git("rev-list", "--first-parent", "--count", commit))
        step = max(1, -(-n // self.count))
        return [InputPartition((commit, at, step)) for at in range(0, n, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        commit, at, step = partition.value
        mark = "%x01%H%x02%P%x02%ct%x02%s"
        # -z: paths come as they are, each ended by NUL; without it git quotes those that aren't ASCII.
        entries = self._entries("log", "-z", "--first-parent", "-m", "--name-status", "--no-renames", f"--skip={at}", f"--max-count={step}", f"--format={mark}", commit)
        for i, entry in enumerate(entries, -1):
            if i < 0:  # what stands before the first mark
                continue
            head, *fields = entry.split("\0")
            sha, parents, when, summary = head.rstrip("\n").split("\x02", 3)
            fields = [f.lstrip("\n") if k % 2 == 0 else f for k, f in enumerate(f for f in fields if f.strip("\n"))]
            for status, path in zip(fields[::2], fields[1::2], strict=True) if fields else [(None, None)]:
                yield sha, parents.split(), summary, int(when), at + i, status, path
