"""An index on disk: immutable snapshots of its tables, and a manifest that names the current one.

A change writes new table folders beside the old ones and then replaces the manifest in one rename, so readers see
the old state or the new, never a mixture, and a job that dies half-way leaves the old.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import same_model
from quarry.operators.bm25 import postings
from quarry.operators.plan import remove_files, replace_rows, untracked

TABLES = {
    "chunks": "id long, file_path string, language string, name string, chunk_type string, parent string, content string, start_line int, end_line int, embedding array<float>",
    "files": "path string, content_hash string",
    "refs": "symbol_name string, file_path string, line int, kind string",
    "postings": "term string, id long, col string, pos int",
    "lengths": "id long, n int",
    "turns": "id long, session_id string, asked_at string, question string, answer string, citations string",
}
FORMAT = 2


class Index:
    """The tables of one project below `root`."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path, project_root: str = "", model: str = "") -> Index:
        """Opens the index, creating the folder and empty tables where there are none."""
        index = cls(spark, root)
        if not index.exists():
            index.root.mkdir(parents=True, exist_ok=True)
            os.chmod(index.root, 0o700)
            index._commit({}, {"project_root": project_root, "embedding_model": model, "format": FORMAT})
        return index

    def exists(self) -> bool:
        return (self.root / "manifest.json").is_file()

    def manifest(self) -> dict:
        return json.loads((self.root / "manifest.json").read_text())

    def meta(self, key: str) -> object:
        return self.manifest()["meta"].get(key)

    def write_meta(self, **values: object) -> None:
        m = self.manifest()
        self._commit(m["tables"], m["meta"] | values)

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot; an empty one if nothing was written yet."""
        at = self.manifest()["tables"].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(str(self.root / at)) if at else self.spark.createDataFrame([], TABLES[name])

    def _write(self, name: str, df: DataFrame) -> str:
        at = f"{name}-{uuid.uuid4().hex[:12]}"
        key = {"chunks": "file_path", "refs": "symbol_name", "files": "path", "turns": "id", "postings": "term", "lengths": "id"}[name]
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        # sorted by what is looked up, so that scans skip row groups
        df.select(*columns).repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(str(self.root / at))
        return at

    def _commit(self, tables: dict, meta: dict) -> None:
        new = self.root / f"manifest-{uuid.uuid4().hex}.json"
        new.write_text(json.dumps({"tables": tables, "meta": meta | {"updated_at": time.time()}}, indent=1))
        os.chmod(new, 0o600)
        os.replace(new, self.root / "manifest.json")

    def _change(self, **frames: DataFrame) -> None:
        m = self.manifest()
        tables = m["tables"] | {name: self._write(name, df) for name, df in frames.items()}
        self._commit(tables, m["meta"])
        self._vacuum(set(tables.values()) | set(m["tables"].values()))

    def _vacuum(self, keep: set[str]) -> None:
        for p in self.root.iterdir():
            if p.is_dir() and p.name not in keep:
                shutil.rmtree(p, ignore_errors=True)

    def replace_files(self, chunks: DataFrame, refs: DataFrame, files: DataFrame) -> None:
        """Replaces the chunks, references and recorded hashes of the files in files(path, content_hash)."""
        paths = files.select("path")
        last = self.table("chunks").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = chunks if "id" in chunks.columns else chunks.withColumn("id", F.monotonically_increasing_id() + F.lit(last + 1))
        # ids are given once: the chunks and the keyword index must agree on them
        added = self.spark.read.schema(fresh.schema).parquet(self._kept(fresh))
        posts, lengths = postings(added)
        stays = self._stays(paths)
        self._change(
            chunks=remove_files(self.table("chunks"), paths).unionByName(added, allowMissingColumns=True),
            postings=self.table("postings").join(stays, "id", "left_semi").unionByName(posts.select("term", "id", "col", "pos")),
            lengths=self.table("lengths").join(stays, "id", "left_semi").unionByName(lengths.select("id", F.col("n").cast("int").alias("n"))),
            refs=remove_files(self.table("refs"), paths).unionByName(refs, allowMissingColumns=True),
            files=replace_rows(self.table("files"), files, "path"),
        )

    def _kept(self, df: DataFrame) -> str:
        """Writes a table beside the others that the next change sweeps away."""
        at = str(self.root / f"added-{uuid.uuid4().hex[:12]}")
        df.write.option("compression", "zstd").parquet(at)
        return at

    def _stays(self, gone: DataFrame) -> DataFrame:
        """(id): the chunks outside the files in gone(path)."""
        return remove_files(self.table("chunks"), gone).select("id")

    def keyword_index(self) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) as bm25 reads them: stemmed, kept with every change."""
        return self.table("postings"), self.table("lengths")

    def has_chunks(self) -> bool:
        return not self.table("chunks").isEmpty()

    def size_bytes(self) -> int:
        return sum(p.stat().st_size for p in self.root.rglob("*") if p.is_file())

    def remove(self, gone: DataFrame) -> None:
        """Removes the files in gone(path) from all tables."""
        stays = self._stays(gone)
        words = {t: self.table(t).join(stays, "id", "left_semi") for t in ("postings", "lengths")}
        self._change(**words, chunks=remove_files(self.table("chunks"), gone), refs=remove_files(self.table("refs"), gone), files=remove_files(self.table("files"), gone, "path"))

    def delete_untracked(self) -> int:
        """Deletes chunks of files that are not recorded; how many."""
        lost = untracked(self.table("chunks"), self.table("files")).count()
        if lost:
            kept = self.table("chunks").join(self.table("files").select(F.col("path").alias("file_path")), "file_path", "left_semi")
            words = {t: self.table(t).join(kept.select("id"), "id", "left_semi") for t in ("postings", "lengths")}
            self._change(**words, chunks=kept)
        return lost

    def record_turns(self, turns: DataFrame) -> None:
        self._change(turns=self.table("turns").unionByName(turns, allowMissingColumns=True))

    def reset(self, model: str) -> None:
        """Empties the index and records the model it is built with; the history stays."""
        m = self.manifest()
        self._commit({k: v for k, v in m["tables"].items() if k == "turns"}, m["meta"] | {"embedding_model": model, "format": FORMAT})

    def rebuild_reason(self, model: str, force: bool = False) -> str | None:
        """Why everything must be indexed again; None if it need not."""
        meta = self.manifest()["meta"]
        if force:
            return "asked for"
        if meta.get("embedding_model") and not same_model(meta["embedding_model"], model):
            return f"the index was built with {meta['embedding_model']}"
        return "the stored format is older" if meta.get("format") != FORMAT else None


def index_directories(home: str | Path) -> list[Path]:
    """The folders below home that hold an index, sorted."""
    h = Path(home)
    return sorted(p for p in h.iterdir() if (p / "manifest.json").is_file()) if h.is_dir() else []


def find_index(home: str | Path, directory: str | Path) -> Path | None:
    """The index of the nearest project root at or above the directory."""
    roots = {json.loads((p / "manifest.json").read_text())["meta"].get("project_root"): p for p in index_directories(home)}
    here = Path(directory).resolve()
    return next((roots[str(d)] for d in (here, *here.parents) if str(d) in roots), None)


def collect_indexes(home: str | Path, model: str) -> tuple[list[Path], list[tuple[Path, str]]]:
    """(usable, skipped with reason) of all indexes, for a search across projects."""
    usable, skipped = [], []
    for p in sorted(Path(home).iterdir()) if Path(home).is_dir() else []:
        try:
            meta = json.loads((p / "manifest.json").read_text())["meta"]
        except (OSError, ValueError, KeyError):
            if p.is_dir():
                skipped.append((p, "cannot be opened"))
            continue
        built = meta.get("embedding_model")
        reason = "no project root recorded" if not meta.get("project_root") else "no model recorded" if not built else f"built with {built}" if not same_model(built, model) else None
        if reason:
            skipped.append((p, reason))
        else:
            usable.append(p)
    return usable, skipped


def clean(paths: list[Path]) -> int:
    """Deletes indexes; how many. Only folders with a manifest are touched."""
    n = 0
    for p in paths:
        if (p / "manifest.json").is_file():
            shutil.rmtree(p)
            n += 1
    return n
