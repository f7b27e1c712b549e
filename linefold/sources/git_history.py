"""A Python data source for git history: one row per changed file of a commit, before and after.

    spark.dataSource.register(GitHistory)
    spark.read.format("git_history").option("path", repo).option("since", "2024-01-01").load()

The repository must lie where executors can read it.  Commits are the partitions, in
groups, so that reading is spread and repeatable.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PATTERN = re.compile(r"CVE-\d{4}-\d{4,7}", re.I)


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, timeout=120)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


class Commits(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options["path"]
        self.since = options.get("since")
        self.group = int(options.get("group", "50"))
        self.suffix = options.get("suffix", ".c")
        self.cited = options.get("cited", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        since = [f"--since={self.since}"] if self.since else []
        log = _git(self.repo, "log", "--no-merges", "--format=%H%x1f%B%x1e", *since)
        ids = [c.split("\x1f")[0].strip() for c in log.split("\x1e") if "\x1f" in c and (not self.cited or PATTERN.search(c))]
        return [Commits(ids[i : i + self.group]) for i in range(0, len(ids), self.group)] or [Commits([])]

    def read(self, partition: Commits) -> Iterator[tuple]:
        for c in partition.ids:
            message = _git(self.repo, "log", "-1", "--format=%B", c)
            cves = sorted({x.upper() for x in PATTERN.findall(message)})
            for f in _git(self.repo, "diff-tree", "--root", "--no-commit-id", "--name-only", "-r", c).splitlines():
                if f.endswith(self.suffix):
                    yield (c, message, cves, f, _git(self.repo, "show", f"{c}^:{f}"), _git(self.repo, "show", f"{c}:{f}"))


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "commit string, message string, cves array<string>, file string, before string, after string"

    def reader(self, schema: object) -> DataSourceReader:
        return GitReader(self.options)
