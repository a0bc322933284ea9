"""The command line: python -m quarry.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from quarry import config as settings
from quarry.embed import http_models
from quarry.engine import Engine, project_root, search_all
from quarry.functions.hashing import fnv1a64
from quarry.health import check_server, count_checks, doctor
from quarry.operators.history import recent_turns, transcripts
from quarry.operators.scan import extension_histogram
from quarry.sources.walker import Options, source_files
from quarry.store import Index, clean, collect_indexes, find_index, index_directories


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _index_path(spark: SparkSession, home: Path, root: str) -> Path:
    from pyspark.sql import functions as F

    found = find_index(home, root)
    key = spark.range(1).select(fnv1a64(F.lit(root))).first()[0]
    return found or home / f"{Path(root).name}-{key}"


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def diff_text(given: str | None, staged: bool, base: str | None) -> str:
    """The diff to review: a file or standard input, or what git shows (staged, against a base, or of the working tree)."""
    if given:
        return sys.stdin.read() if given == "-" else Path(given).read_text()
    if base and base.startswith("-"):
        raise ValueError(f"{base!r} is no revision")
    args = ["--cached"] if staged else [f"{base}...HEAD"] if base else ["HEAD"]
    done = subprocess.run(["git", "diff", "--no-color", "--no-ext-diff", *args, "--"], capture_output=True, text=True, check=False)
    if done.returncode:
        raise ValueError(done.stderr.strip() or "git diff failed")
    return done.stdout


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quarry")
    p.add_argument("--json", action="store_true")
    p.add_argument("--home", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "parse", "status", "doctor"):
        sub.add_parser(name).add_argument("path", nargs="?", default=".")
    i = sub.add_parser("index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    i.add_argument("--max-file-size", type=int, default=None)
    i.add_argument("--allow-secrets", action="store_true")
    i.add_argument("--include", action="append", default=[])
    i.add_argument("--exclude", action="append", default=[])
    s = sub.add_parser("search")
    s.add_argument("question")
    s.add_argument("-l", "--limit", type=int, default=None)
    s.add_argument("-A", "--all", action="store_true")
    for name in ("def", "refs", "callers"):
        sub.add_parser(name).add_argument("symbol")
    s.add_argument("--no-answer", action="store_true")
    sub.add_parser("explain").add_argument("target")
    sub.add_parser("chat")
    w = sub.add_parser("watch")
    w.add_argument("path", nargs="?", default=".")
    w.add_argument("--seconds", type=float, default=2.0)
    w.add_argument("--for", dest="run_for", type=float, default=None)
    h = sub.add_parser("history")
    h.add_argument("-n", type=int, default=20)
    sub.add_parser("export")
    sub.add_parser("list")
    c = sub.add_parser("clean")
    c.add_argument("--all", action="store_true")
    c.add_argument("--yes", action="store_true")
    d = sub.add_parser("analyze")
    d.add_argument("diff", nargs="?", default=None)
    d.add_argument("--staged", action="store_true")
    d.add_argument("--base", default=None)
    d.add_argument("--prefix", default="")
    g = sub.add_parser("config")
    g.add_argument("action", choices=("init", "get", "set"))
    g.add_argument("key", nargs="?")
    g.add_argument("value", nargs="?")
    sub.add_parser("serve")
    return p


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[int, object]:
    """(exit code, what the command prints)."""
    a = parser().parse_args(argv)
    home = Path(a.home) if a.home else settings.home()
    if a.command == "config":
        path = home / "config.toml"
        c = settings.load(global_file=path)
        if a.action == "init":
            settings.save(c, path)
            return 0, str(path)
        section, _, key = (a.key or "").partition(".")
        if a.action == "set":
            setattr(getattr(c, section, None) or c, key, settings.validate(section, key, a.value))
            settings.save(c, path)
        return 0, getattr(getattr(c, section), key)
    if a.command == "list":
        metas = [(p, json.loads((p / "manifest.json").read_text())["meta"]) for p in index_directories(home / "indexes")]
        return 0, [{"path": str(p), "project": m.get("project_root"), "model": m.get("embedding_model"), "age_seconds": int(time.time() - m.get("updated_at", 0))} for p, m in metas]
    spark = spark or _session()
    root = project_root(getattr(a, "path", "."))
    c = settings.load(root, home / "config.toml")
    where = _index_path(spark, home / "indexes", root)
    if a.command == "clean":
        targets = index_directories(home / "indexes") if a.all else [where]
        return (0, clean(targets)) if a.yes else (1, f"would delete {len(targets)} indexes; repeat with --yes")
    if a.command == "init":
        files = source_files(spark, root)
        return 0, {"extensions": _rows(extension_histogram(files.where("skip_reason is null"))), "skipped": _rows(files.where("skip_reason is not null").select("relative_path", "skip_reason"))}
    if a.command == "parse":
        from quarry.operators.parsing import structural_chunks

        return 0, _rows(structural_chunks(source_files(spark, root)).select("file_path", "name", "chunk_type", "start_line", "end_line"))
    index = Index(spark, where)
    if a.command in ("index",):
        index = Index.open(spark, where, root, "hashing")
    elif not index.exists() and not getattr(a, "all", False):
        return 1, "no index here; run index first"
    talks = a.command in ("chat", "explain", "analyze") or a.command == "search" and not a.no_answer and not a.all
    e = Engine(spark, index, None, c, http_models(c)[1] if talks and check_server(c)[1] == "ok" else None)
    if a.command == "index":
        o = Options(a.max_file_size or Options().max_bytes, a.allow_secrets, a.include, a.exclude)
        return 0, e.index_tree(root, o, a.force)
    if a.command == "search":
        limit = a.limit or c.search.top_k
        if a.all:
            usable, skipped = collect_indexes(home / "indexes", "hashing")
            engines = {str(Index(spark, p).meta("project_root")): Engine(spark, Index(spark, p), config=c) for p in usable}
            return 0, {"results": _rows(search_all(spark, engines, a.question, limit)) if engines else [], "skipped": [(str(p), r) for p, r in skipped]}
        if e.generator and not a.no_answer:
            return 0, e.answer(a.question, limit=limit)
        return 0, _rows(e.search(a.question, limit).limit(limit).select("file_path", "start_line", "end_line", "name", "score", "low_confidence", "matched_keywords"))
    if a.command == "def":
        return 0, _rows(e.definitions(a.symbol))
    if a.command in ("refs", "callers"):
        return 0, _rows(e.references(a.symbol, a.command == "callers"))
    if a.command == "explain":
        path, _, line = a.target.rpartition(":")
        return 0, e.explanation(path, int(line)) if path and line.isdigit() else e.explanation(a.target)
    if a.command == "chat":
        if e.generator is None:
            return 1, "chat needs a model server"
        session = f"chat{int(time.time() * 1000)}"
        for line in sys.stdin:
            if line.strip() in ("exit", "quit"):
                break
            if line.strip():
                said = e.answer(line.strip(), session)
                print(said["answer"] or said["failure"] or "nothing found", flush=True)
        return 0, ""
    if a.command == "watch":
        from quarry.streaming.watch import watch_tree

        def report(x: dict) -> None:
            print(json.dumps(x), flush=True)

        running = watch_tree(spark, root, lambda: e.index_tree(root), report, tempfile.mkdtemp(prefix="quarry-watch-"), a.seconds)
        running.awaitTermination(a.run_for) if a.run_for else running.awaitTermination()
        running.stop()
        return 0, ""
    if a.command == "history":
        return 0, _rows(recent_turns(index.table("turns"), a.n))
    if a.command == "export":
        return 0, "".join(r.transcript for r in transcripts(index.table("turns")).orderBy("session_id", "part").toLocalIterator())
    if a.command == "analyze":
        return 0, e.review(diff_text(a.diff, a.staged, a.base), a.prefix)
    if a.command == "status":
        return 0, e.status(root)
    if a.command == "serve":
        from quarry.rpc import serve

        for reply in serve(e, sys.stdin):
            print(reply, flush=True)
        return 0, ""
    checks = doctor(index, root, c, "hashing", e.embedder.dimensions)
    return (1 if count_checks(checks)[0] else 0), checks


def main() -> int:
    try:
        code, out = run(sys.argv[1:])
    except (ValueError, OSError) as err:
        print(json.dumps({"error": str(err)}) if "--json" in sys.argv else f"error: {err}", file=sys.stderr)
        return 2
    if out != "":
        print(out if isinstance(out, str) and "--json" not in sys.argv else json.dumps(out, indent=2, default=str, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
