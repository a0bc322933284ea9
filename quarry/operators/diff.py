"""Unified diffs: parsing into hunks and packing into a budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import added_removed, change_text
from quarry.operators.chunking import cut_bytes

TOTAL_BYTES, HUNK_BYTES = 16_000, 4_000
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


@dataclass
class FileChange:
    path: str
    change: str = "modified"
    renamed_from: str | None = None
    hunks: list[tuple[int, int, int, int, str]] = field(default_factory=list)


def _side(text: str) -> str:
    return text.split("\t", 1)[0].strip().strip('"')


def parse_diff(text: str) -> list[FileChange]:
    """The files of a unified diff, with or without a git header.

    A hunk's body has exactly as many lines as its header counts, so lines that look like headers stay inside;
    a/ and b/ are taken off only where both sides carry them; files without hunks (binary, renames) are kept.
    """
    out: list[FileChange] = []
    rows = text.split("\n")
    i, current, old = 0, None, ""
    sides: tuple[str, str] = ("", "")
    while i < len(rows):
        row = rows[i].rstrip("\r")
        if row.startswith("diff --git "):
            m = re.match(r"diff --git (\"?)a/(.*?)\1 (\"?)b/(.*?)\3$", row)
            current = FileChange(m.group(4) if m else row.rsplit(" ", 1)[-1])
            out.append(current)
            old = ""
        elif row.startswith("new file mode") and current:
            current.change = "added"
        elif row.startswith("deleted file mode") and current:
            current.change = "deleted"
        elif row.startswith("rename from ") and current:
            current.change, current.renamed_from = "renamed", row[12:]
        elif row.startswith("rename to ") and current:
            current.path = row[10:]
        elif row.startswith("--- ") and i + 1 < len(rows) and rows[i + 1].startswith("+++ "):
            old, new = _side(row[4:]), _side(rows[i + 1].rstrip("\r")[4:])
            if all(x == "/dev/null" or x.startswith(p) for x, p in ((old, "a/"), (new, "b/"))) and (old, new) != ("/dev/null",) * 2:
                old, new = (x if x == "/dev/null" else x[2:] for x in (old, new))
            if current is None or current.hunks or sides != ("", "") and not any(rows[k].startswith("diff --git ") for k in range(max(0, i - 8), i)):
                current = FileChange(new)
                out.append(current)
            sides = (old, new)
            if old == "/dev/null":
                current.change = "added"
            elif new == "/dev/null":
                current.change = "deleted"
            current.path = old if new == "/dev/null" else new if current.change != "renamed" else current.path
            i += 1
        elif current is not None and (m := _HUNK.match(row)):
            a, b, c, d = (int(x) if x is not None else 1 for x in m.groups())
            left, right, body = b, d, []
            while i + 1 < len(rows) and (left > 0 or right > 0):
                line = rows[i + 1]
                if line.startswith("\\"):
                    i += 1
                    continue
                mark = line[:1]
                left -= mark in " -" or mark == ""
                right -= mark in " +" or mark == ""
                body.append(line.rstrip("\r"))
                i += 1
            current.hunks.append((a, b, c, d, "".join(x + "\n" for x in body)))
        i += 1
    return out


_HUNKS = "diff_id long, file_no int, path string, change string, renamed_from string, hunk_no int, old_start int, old_count int, new_start int, new_count int, text string"


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, text) -> one row per hunk, or one with null hunk columns for a file without; null texts give none."""
    columns = [c.split()[0] for c in _HUNKS.split(", ")]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f.diff_id, f.text):
                for n, c in enumerate(parse_diff(t)):
                    for k, h in enumerate(c.hunks or [(None,) * 5]):
                        rows.append((d, n, c.path, c.change, c.renamed_from, k if c.hunks else None, *h))
            out = pd.DataFrame(rows, columns=columns)
            for c in ("hunk_no", "old_start", "old_count", "new_start", "new_count"):
                out[c] = out[c].astype("Int32")
            yield out

    return diffs.where("diff_id is not null and text is not null").select("diff_id", "text").mapInPandas(cut, _HUNKS)


def diff_summary(hunks: DataFrame) -> DataFrame:
    """(diff_id, file_no, path, change, added, removed): each file of a diff with its kind of change and its lines."""
    plus, minus = added_removed(F.coalesce("text", F.lit("")))
    counted = hunks.select("diff_id", "file_no", "path", change_text(F.col("change"), F.col("renamed_from")).alias("change"), plus.alias("added"), minus.alias("removed"))
    return counted.groupBy("diff_id", "file_no", "path", "change").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def candidate_paths(hunks: DataFrame) -> DataFrame:
    """(diff_id, path) under which the index may know a diff's files: the new path, and the old one of a rename."""
    return hunks.select("diff_id", F.explode(F.array_compact(F.array("path", "renamed_from"))).alias("path")).distinct()


def render_hunk(old_start: int, old_count: int, new_start: int, new_count: int, text: str) -> str:
    head = f"@@ -{old_start},{old_count} +{new_start},{new_count} @@\n"
    if len(text.encode()) <= HUNK_BYTES:
        return head + text
    return f"{head}{cut_bytes(text, HUNK_BYTES)}\n... (rest of this hunk left out for length)\n"


def render_diff(files: list[FileChange], total: int = TOTAL_BYTES) -> tuple[str, int]:
    """The diff within the byte budget, and how many hunks did not fit; a later, smaller hunk may still fit."""
    out, size, left_out = [], 0, 0
    for f in files:
        what = f"renamed from {f.renamed_from}" if f.change == "renamed" else f.change
        parts = [f"### {f.path} ({what})\n"]
        size += len(parts[0].encode())
        for h in f.hunks:
            t = render_hunk(*h)
            if size + len(t.encode()) > total:
                left_out += 1
                continue
            parts.append(t)
            size += len(t.encode())
        out += parts
    return "".join(out), left_out


def to_index_path(path: str, prefix: str) -> str | None:
    """A repository path relative to the indexed folder `prefix` below it; None if it lies outside."""
    if not prefix:
        return path
    return path[len(prefix) + 1 :] if path.startswith(prefix + "/") else None


def to_diff_path(path: str, prefix: str) -> str:
    return f"{prefix}/{path}" if prefix else path
