"""A Spark data source that lists and reads directories of repositories.

Listing happens on the driver down to as many directories as there shall be input partitions; the executors walk
what lies below them, guard and read. A directory of many files is several partitions. Cheap guards come first, so that
skipped files are not read. Hadoop's own listing is not used because it hides names that begin with an underscore.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skillweave.functions.guards import secret_marker
from skillweave.functions.vocab import LANGUAGES, SKIP_DIRS, TEST_DIRS, TEST_ENDS, TEST_START

#: files of one directory that are worth a partition
SLICE = 1000

SCHEMA = "repo_name string, repo_path string, relative_path string, size bigint, content string, skip_reason string"
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("repo_name", "repo_path", "relative_path")]
    + [("size", pa.int64()), ("content", pa.string()), ("skip_reason", pa.string())]
)


def discover(path: str) -> list[Path]:
    """The directory itself if it is a repository; else its visible children that are, by name; else itself."""
    root = Path(path).expanduser().resolve()
    if not root.is_dir():
        raise ValueError(f"not a directory: {root}")
    if (root / ".git").exists():
        return [root]
    children = sorted(x for x in root.iterdir() if x.is_dir() and not x.name.startswith(".") and (x / ".git").exists())
    return children or [root]


def looks_binary(payload: bytes) -> bool:
    """A NUL anywhere, or more than a fifth of the first 2048 bytes are control characters."""
    sample = payload[:2048]
    odd = len(sample) - len(sample.translate(None, bytes([*range(9), *range(14, 32)])))
    return b"\0" in payload or odd > 0.20 * max(1, len(sample))


def test_path(relative: str) -> bool:
    whole = "/" + relative.replace("\\", "/").lower()
    name = whole.rpartition("/")[2]
    return any(x in whole for x in TEST_DIRS) or name.startswith(TEST_START) or name.endswith(tuple(TEST_ENDS))


@dataclass
class Files(InputPartition):
    """A part of a repository: a directory's own files, or all files below it (deep). Of several slices it has the
    files whose names' checksums fall to it, so that a file is in one slice whatever else comes and goes."""

    repo: str
    top: str
    deep: bool
    slice: int = 0
    slices: int = 1

    def __post_init__(self) -> None:
        super().__init__(f"{self.repo}/{self.top}")

    def holds(self, name: str) -> bool:
        return self.slices == 1 or zlib.crc32(os.fsencode(name)) % self.slices == self.slice


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.extensions = set(options.get("extensions", " ".join(LANGUAGES)).split())
        self.skip_dirs = set(options.get("skip_dirs", " ".join(SKIP_DIRS)).split())
        self.include_tests = options.get("include_tests", "false").lower() == "true"
        self.max_bytes = int(options.get("max_file_bytes", "200000"))
        self.least_parts = int(options.get("partitions", "256"))

    def _kept(self, name: str) -> bool:
        return name not in self.skip_dirs and not name.startswith(".")

    def partitions(self) -> list[Files]:
        """Directories are opened level by level until there are enough parts, so that one deep directory is many. The
        files of an opened directory are cut into slices; each lists the whole directory, so they are a quarter of the
        parts at most."""
        done, open_ = [], deque((str(repo), "") for repo in discover(self.path))
        while open_ and len(done) + len(open_) < self.least_parts:
            repo, top = open_.popleft()
            below, files = [], 0
            for x in os.scandir(Path(repo, top)):
                if not x.is_dir(follow_symlinks=False):
                    files += 1
                elif self._kept(x.name):
                    below.append(x.name)
            slices = max(1, min(-(-files // SLICE), self.least_parts // 4))
            done.extend(Files(repo, top, False, i, slices) for i in range(slices))
            below.sort()
            open_.extend((repo, f"{top}/{x}" if top else x) for x in below)
        return done + [Files(repo, top, True) for repo, top in open_]

    def _listed(self, part: Files) -> Iterator[Path]:
        for current, dirs, files in os.walk(Path(part.repo, part.top)):
            dirs[:] = sorted(x for x in dirs if self._kept(x)) if part.deep else []
            for name in sorted(files):
                if not name.startswith(".") and part.holds(name) and Path(name).suffix.lower() in self.extensions:
                    yield Path(current, name)

    def _row(self, root: Path, path: Path) -> dict:
        relative = path.relative_to(root).as_posix()
        row = {"repo_name": root.name, "repo_path": str(root), "relative_path": relative}
        if not self.include_tests and test_path(relative):
            return row | {"skip_reason": "test_file"}
        try:
            # only links lead out, as the walk follows none
            if path.is_symlink() and not path.resolve().is_relative_to(root.resolve()):
                return row | {"skip_reason": "path_escape"}
            size = path.stat().st_size
            if size > self.max_bytes:
                return row | {"size": size, "skip_reason": "file_too_large"}
            payload = path.read_bytes()
        except (OSError, RuntimeError):
            # one unreadable file doesn't end a scan of many repositories
            return row | {"skip_reason": "unreadable"}
        if looks_binary(payload):
            return row | {"size": size, "skip_reason": "binary_file"}
        return row | {"size": size, "content": payload.decode("utf-8", "replace")}

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for path in self._listed(part):
            rows.append(self._row(Path(part.repo), path))
            held += rows[-1].get("size") or 0
            if held > 8_000_000 or len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


class RepositorySource(DataSource):
    """spark.read.format("repositories").load(path); options: extensions and skip_dirs (blank-separated),
    include_tests, max_file_bytes, partitions (how many there should at least be, if there are directories enough)."""

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return RepositoryReader(self.options)


def read_repositories(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """All listed files with content or skip_reason; markers of secrets are a reason too, after all others."""
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format("repositories")
    for k, v in options.items():
        reader = reader.option(k, " ".join(v) if isinstance(v, (list, tuple, set)) else str(v))
    marker = secret_marker(F.col("content"))
    reason = F.coalesce("skip_reason", F.when(marker.isNotNull(), F.concat(F.lit("secret_marker:"), marker)))
    return reader.load(path).withColumn("skip_reason", reason)
