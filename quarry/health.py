"""Checks of an installation and an index."""

from __future__ import annotations

import json
import os
import stat
import urllib.request
from pathlib import Path

from pyspark.sql import functions as F

from quarry.config import Config, find_project_file, may_send
from quarry.functions.text import same_model
from quarry.operators.plan import plan_counts, plan_index
from quarry.sources.walker import source_files
from quarry.store import FORMAT, Index

Check = tuple[str, str, str]  # name, ok / warning / failed, detail


def check_configuration(directory: str | Path) -> Check:
    project = find_project_file(directory)
    return "configuration", "ok", f"with {project}" if project else "global settings"


def check_address(config: Config) -> Check:
    allowed, why = may_send(config)
    return "server address", "failed" if not allowed else "warning" if why else "ok", why or f"{config.model.host}:{config.model.port}"


def check_server(config: Config, timeout: float = 2) -> Check:
    try:
        with urllib.request.urlopen(f"{config.model.host}:{config.model.port}/api/tags", timeout=timeout):
            return "server", "ok", "answers"
    except OSError as e:
        return "server", "warning", f"not reachable: {e}"


def check_models(config: Config, timeout: float = 2) -> Check:
    """Whether the server has the configured models."""
    try:
        with urllib.request.urlopen(f"{config.model.host}:{config.model.port}/api/tags", timeout=timeout) as reply:
            have = [m.get("name") for m in json.load(reply).get("models", [])]
    except (OSError, ValueError) as e:
        return "models", "warning", f"unknown: {e}"
    missing = [m for m in (config.model.embedding_model, config.model.chat_model) if not any(same_model(m, h) for h in have)]
    return "models", "failed" if missing else "ok", f"missing: {', '.join(missing)}" if missing else "both there"


def check_index(index: Index, model: str, dimensions: int) -> list[Check]:
    if not index.exists():
        return [("index", "failed", "there is none; index the project first")]
    chunks = index.table("chunks")
    sizes = [r[0] for r in chunks.where("embedding is not null").select(F.size("embedding")).distinct().limit(3).collect()]
    reason = index.rebuild_reason(model)
    mode = stat.S_IMODE(os.stat(index.root).st_mode)
    return [
        ("index", "ok" if index.has_chunks() else "warning", "holds chunks" if index.has_chunks() else "is empty"),
        ("model", "ok" if not reason else "failed", reason or str(index.meta("embedding_model"))),
        ("vector size", "ok" if sizes in ([], [dimensions]) else "failed", ", ".join(map(str, sizes)) or "no vectors"),
        ("index format", "ok" if index.meta("format") == FORMAT else "failed", str(index.meta("format"))),
        ("stored data", "ok" if mode == 0o700 else "warning", f"mode {mode:o}"),
    ]


def check_freshness(index: Index, root: str) -> Check:
    now = source_files(index.spark, root).where("skip_reason is null").select(F.col("relative_path").alias("path"), "content_hash")
    c = plan_counts(plan_index(now, index.table("files"))).first()
    return "freshness", "warning" if c.stale else "ok", f"{c.new} new, {c.changed} changed, {c.removed} removed"


def doctor(index: Index, root: str, config: Config, model: str, dimensions: int) -> list[Check]:
    checks = [check_configuration(root), check_address(config), check_server(config), check_models(config), *check_index(index, model, dimensions)]
    return [*checks, check_freshness(index, root)] if index.exists() else checks


def count_checks(checks: list[Check]) -> tuple[int, int]:
    """(failures, warnings)."""
    return sum(s == "failed" for _, s, _ in checks), sum(s == "warning" for _, s, _ in checks)
