"""A source tree as DataFrames: a driver-side walk of names, read in parallel on the executors.

Spark's own file sources leave out names that begin with . or _, so the walk is ours; only paths and sizes are
collected, the contents are read by tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import EXTENSION_LANGUAGES, LOCKFILES, PLAIN_TEXT_EXTENSIONS
from quarry.operators.scan import MAX_FILE_BYTES, skip_reason
from quarry.sources.ignore import Rule, ignored, rules

IGNORE_FILES = (".gitignore", ".ignore", ".quarryignore")
# Directories never entered below the root.
SKIPPED_DIRECTORIES = frozenset(".git .hg .svn node_modules bower_components vendor target dist build __pycache__ .venv venv .tox .mypy_cache .pytest_cache .next".split())


@dataclass
class Options:
    max_bytes: int = MAX_FILE_BYTES
    allow_secrets: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def looks_indexable(path: str) -> bool:
    """A known extension outside skipped directories: what a watch event must have."""
    *folders, name = path.replace("\\", "/").split("/")
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return not SKIPPED_DIRECTORIES.intersection(folders) and (ext in EXTENSION_LANGUAGES or ext in PLAIN_TEXT_EXTENSIONS) and name not in LOCKFILES and ".min." not in name


def walk(root: str, options: Options | None = None) -> Iterator[tuple[str, int]]:
    """(relative path, bytes) of the indexable files below root, sorted; a bad include or exclude pattern is an error."""
    o = options or Options()
    include = [Rule(p) for p in o.include]
    exclude = [Rule(p) for p in o.exclude]

    def visit(folder: str, inherited: list[Rule]) -> Iterator[tuple[str, int]]:
        own = list(inherited)
        for name in IGNORE_FILES:
            f = Path(root, folder, name)
            if f.is_file():
                own += rules(f.read_text(errors="replace"), folder)
        for entry in sorted(os.scandir(Path(root, folder)), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in SKIPPED_DIRECTORIES and not ignored(path, True, own) and not any(r.matches(path, True) for r in exclude):
                    yield from visit(path, own)
            elif entry.is_file() and looks_indexable(entry.name) and not ignored(path, False, own):
                if any(r.matches(path, False) for r in exclude) or include and not any(r.matches(path, False) for r in include):
                    continue
                yield path, entry.stat().st_size

    yield from visit("", [])


def source_files(spark: SparkSession, root: str, options: Options | None = None, project: str | None = None) -> DataFrame:
    """(project, relative_path, content, content_hash, skip_reason) of the indexable files below root.

    Files over the limit are not read; such that are no UTF-8 text or cannot be read say so in skip_reason, and
    have no content; contents that look like credentials are dropped unless allowed.
    """
    o = options or Options()
    found = list(walk(root, o))
    paths = spark.createDataFrame(found or [], "relative_path string, size long").repartition(max(1, min(len(found) // 64 + 1, 4096)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, size in zip(f.relative_path, f["size"]):
                text = digest = reason = None
                if size > o.max_bytes:
                    reason = f"{size // 1024} KB, over the {o.max_bytes // 1024} KB limit"
                else:
                    try:
                        raw = Path(root, path).read_bytes()
                        text, digest = raw.decode("utf-8"), sha256(raw).hexdigest()
                    except UnicodeDecodeError:
                        reason = "not UTF-8 text"
                    except OSError as e:
                        reason = e.strerror or "unreadable"
                rows.append((path, text, digest, reason))
            yield pd.DataFrame(rows, columns=["relative_path", "content", "content_hash", "reason"])

    files = paths.mapInPandas(read, "relative_path string, content string, content_hash string, reason string")
    why = F.coalesce("reason", skip_reason(F.col("relative_path"), F.col("content"), o.max_bytes, o.allow_secrets))
    return files.select(
        F.lit(project or Path(root).resolve().name).alias("project"), "relative_path", F.when(why.isNull(), F.col("content")).alias("content"),
        F.when(why.isNull(), F.col("content_hash")).alias("content_hash"), why.alias("skip_reason"),
    )
