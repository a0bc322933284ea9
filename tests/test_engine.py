import json
import os
import shutil

import pytest

from quarry import cli, config, rpc
from quarry.embed import HashingEmbedder, embed_chunks, http_models, read_json_lines
from quarry.engine import Engine, check_across
from quarry.health import check_index, count_checks, doctor
from quarry.sources.ignore import ignored, rules
from quarry.sources.walker import Options, looks_indexable, source_files, walk
from quarry.store import Index, collect_indexes, find_index, index_directories
from quarry.streaming.watch import snapshot_changes, watch_events, watch_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    for name, text in {
        "src/cart.py": "from tax import rate\n\n\ndef total(items):\n    \"\"\"Adds the prices of a cart.\"\"\"\n    return rate(sum(items))\n",
        "src/tax.py": "def rate(amount):\n    return amount * 1.2\n", ".github/ci.yml": "on: push\n", "_priv/b.py": "x = 1\n", "node_modules/m.js": "x", "build/o.py": "y = 2\n",
        "skip.py": "z = 3\n", "deep/keep.py": "k = 1\n", "deep/gen/x.py": "g = 1\n", ".gitignore": "skip.py\n/deep/gen/\n", "key.py": "K = '-----BEGIN RSA PRIVATE KEY-----'\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe\x00")
    return root


def test_walk(spark, tree):
    assert [p for p, _ in walk(str(tree))] == [".github/ci.yml", "_priv/b.py", "bad.py", "deep/keep.py", "key.py", "src/cart.py", "src/tax.py"]
    assert [p for p, _ in walk(str(tree), Options(include=["src/**"], exclude=["*tax*"]))] == ["src/cart.py"]
    with pytest.raises(ValueError):
        list(walk(str(tree), Options(include=["[x"])))
    got = {r.relative_path: r.skip_reason for r in source_files(spark, str(tree)).collect()}
    assert got["bad.py"] == "not UTF-8 text" and got["key.py"] == "looks like it holds a private key" and got["src/cart.py"] is None
    assert looks_indexable("a/b.rs") and not looks_indexable("node_modules/b.rs") and not looks_indexable("a.min.js")


@pytest.mark.parametrize("path, is_dir, want", [("a.log", False, True), ("x/a.log", False, True), ("keep.log", False, False), ("out", True, True), ("x/out", True, False), ("doc/a/b.txt", False, True), ("tmp", False, False), ("q/tmp", True, True)])
def test_ignore(path, is_dir, want):
    assert ignored(path, is_dir, rules("# c\n*.log\n!keep.log\n/out\ndoc/**/*.txt\ntmp/\n")) == want


def test_index_and_search(spark, tree, tmp_path):
    index = Index.open(spark, tmp_path / "home" / "i1", str(tree), "hashing")
    e = Engine(spark, index)
    assert e.index_tree(str(tree)) | {} == {"new": 5, "changed": 0, "unchanged": 0, "removed": 0, "stale": True, "skipped": 2, "failed_chunks": 0, "untracked": 0}
    assert e.search("how is the cart total of prices computed").first().file_path == "src/cart.py"
    assert [r.file_path for r in e.definitions("rate").collect()] == ["src/tax.py"]
    assert [(r.file_path, r.symbol) for r in e.references("rate", True).collect()] == [("src/cart.py", "total")]
    assert e.explain("src/cart.py", 6).first().name == "total"
    assert [r.path for r in e.check_answer("src/cart.py:4 and src/cart.py:400").collect()] == ["src/cart.py"]
    (tree / "src/tax.py").write_text("def rate(amount):\n    return amount * 1.3\n")
    os.remove(tree / "deep/keep.py")
    again = e.index_tree(str(tree))
    assert (again["changed"], again["removed"], again["unchanged"]) == (1, 1, 3)
    assert e.index_tree(str(tree))["stale"] is False
    e.generator = Parrot()
    said = e.answer("how is the cart total of prices computed", "s1")
    assert said["answer"] == "See src/cart.py:4 and src/cart.py:900." and said["unverified"] == ["src/cart.py:900"] and said["sources"][0][0] == "src/cart.py"
    assert e.answer("and who calls it?", "s1")["question"] == "Who calls total?" and index.table("turns").count() == 2
    assert "Earlier in this conversation" in e.generator.asked[-1] and "SOURCE FILE src/" in e.generator.asked[-1]
    told = e.explanation(str(tree / "src/tax.py"))
    assert told["callers"] == ["src/cart.py:6 in total"] and told["explanation"] == "See src/cart.py:4 and src/cart.py:900." and e.explanation("nowhere.py") == {}
    assert e.explanation("./src/cart.py", 6)["calls"] == ["rate", "sum"]
    e.config.search.rerank = True
    assert e.search("amount rate", 2).where("not found_via_calls").count() == 2 and "Order these pieces" in e.generator.asked[-1]
    e.config.search.rerank, e.generator = False, None
    with pytest.raises(ValueError):
        e.answer("x")
    assert check_across({"shop": e}, "shop/src/cart.py:4 shop/src/cart.py:99 other/x.py:1") == ["shop/src/cart.py:99", "other/x.py:1"]
    assert index.table("postings").select("id").distinct().join(index.table("chunks"), "id", "left_anti").isEmpty() and index.table("lengths").count() == index.table("chunks").count()
    state = e.status(str(tree))
    assert state["stale"] is False and state["bytes"] > 0 and state["model"] == "hashing"
    moved = e.review("diff --git a/app/src/old.py b/app/src/tax.py\nrename from app/src/tax.py\nrename to app/src/new.py\n--- a/app/src/tax.py\n+++ b/app/src/new.py\n@@ -1,2 +1,2 @@\n def rate(amount):\n-    return 1\n+    return 2\n", "app")
    assert moved["impacted"] == {"rate": ["app/src/cart.py:6 in total"]} and e.review("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n", "app")["impacted"] == {}
    review = e.review("--- a/src/tax.py\n+++ b/src/tax.py\n@@ -1,2 +1,2 @@\n def rate(amount):\n-    return amount * 1.2\n+    return amount * 1.3\n")
    assert review["impacted"] == {"rate": ["src/cart.py:6 in total"]} and "<diff>" in review["prompt"]
    assert e.stats()["extensions"] == "py,yml"
    assert index.rebuild_reason("hashing:latest") is None and index.rebuild_reason("other") and index.rebuild_reason("hashing", True) == "asked for"
    assert find_index(tmp_path / "home", tree / "src") == index.root and index_directories(tmp_path / "home") == [index.root]
    assert collect_indexes(tmp_path / "home", "other")[1][0][1] == "built with hashing"
    assert all(s == "ok" for _, s, _ in check_index(index, "hashing", 64))
    assert count_checks(doctor(index, str(tree), config.Config(), "hashing", 64))[0] == 0
    reply = rpc.handle(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "find_definition", "arguments": {"symbol": "total"}}}))
    assert "src/cart.py" in reply["result"]["content"][0]["text"]
    codes = [rpc.handle(e, x)["error"]["code"] for x in ("{", '{"id": 1, "method": "nope"}', '{"id": 2, "method": "tools/call", "params": {"name": "search_code"}}')]
    assert codes == [-32700, -32601, -32602] and rpc.handle(e, '{"method": "notifications/initialized"}') is None
    changed = snapshot_changes(spark, str(tree), spark.createDataFrame([("src/gone.py", "1")], "path string, content_hash string"))
    assert "src/gone.py" in {r.path for r in changed.where("status = 'removed'").collect()}
    index.reset("other")
    assert index.table("chunks").count() == 0


class Parrot:
    name = "parrot"

    def __init__(self):
        self.asked = []

    def generate(self, prompt):
        self.asked.append(prompt)
        return "'Who calls total?'\n" if prompt.startswith("Rewrite") else "2, 1" if prompt.startswith("Order") else "See src/cart.py:4 and src/cart.py:900."


def test_models_over_http(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            out = b'{"response": "a"}\n{"response": "b"}\n' if "prompt" in body else json.dumps({"embeddings": [[1.0, 0.0]] * len(body["input"])}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = config.Config(model=config.Model(host="http://127.0.0.1", port=server.server_port))
    embedder, generator = http_models(c, 2)
    assert embedder.embed(["x"]) == [[1.0, 0.0]] and embedder.embed_query("y") == [1.0, 0.0] and generator.generate("p") == "ab"
    assert [b["input"] for b in seen[:2]] == [["search_document: x"], ["search_query: y"]]
    server.shutdown()
    c.model.host = "http://far.example"
    with pytest.raises(PermissionError):
        http_models(c)


def test_watch_tree(spark, tree, tmp_path):
    import time

    passes = []
    q = watch_tree(spark, str(tree), lambda: {"pass": len(passes)}, passes.append, str(tmp_path / "cp"), 0.5)
    try:
        time.sleep(3)
        (tree / "src/new.py").write_text("x = 1\n")
        end = time.time() + 40
        while not passes and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert passes[:1] == [{"pass": 0}]


def test_diff_of_a_repository(tmp_path, monkeypatch):
    import subprocess

    def git(*a):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.txt").write_text("2\n")
    monkeypatch.chdir(tmp_path)
    assert "+2" in cli.diff_text(None, False, None) and cli.diff_text(None, True, None) == ""
    git("add", ".")
    assert "+2" in cli.diff_text(None, True, None) and cli.diff_text(None, False, "main") == ""
    with pytest.raises(ValueError):
        cli.diff_text(None, False, "nowhere")
    with pytest.raises(ValueError):
        cli.diff_text(None, False, "--output=x")


def test_cli(spark, tree, tmp_path):
    home = ["--home", str(tmp_path / "h")]
    assert cli.run([*home, "config", "set", "search.top_k", "7"])[1] == 7
    with pytest.raises(ValueError):
        cli.run([*home, "config", "set", "model.port", "0"])
    assert cli.run([*home, "index", str(tree), "--exclude", "deep/**"], spark)[1]["new"] == 4
    assert cli.run([*home, "list"])[1] and cli.run([*home, "init", str(tree)], spark)[1]["skipped"]
    assert cli.run([*home, "status", str(tree)], spark)[1]["files"] == 4
    assert cli.run([*home, "clean", "--all", "--yes"], spark) == (0, 1)


def test_config(tmp_path):
    (tmp_path / ".quarry.toml").write_text('[model]\nhost = "http://evil"\nchat_model = "m"\n[search]\ntop_k = 9\n')
    c = config.load(tmp_path, tmp_path / "none.toml")
    assert (c.model.host, c.model.chat_model, c.search.top_k) == ("http://localhost", "m", 9)
    c.model.host = "http://far.example"
    assert not config.may_send(c)[0]
    c.model.allow_remote = True
    assert config.may_send(c) == (True, "code goes to far.example unencrypted")


def test_embedding_failures(spark):
    class Moody(HashingEmbedder):
        def embed(self, texts):
            if any("boom" in t for t in texts):
                raise ValueError("no")
            return super().embed(texts)

    rows = [(k, "f", "", f"n{k}", "function", None, "boom" if k == 2 else "fine", 1, 2) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, file_path string, language string, name string, chunk_type string, parent string, content string, start_line int, end_line int").coalesce(1)
    got = embed_chunks(df, Moody(8)).collect()
    assert [r.id for r in got if r.error] == [2] and all(len(r.embedding) == 8 for r in got if not r.error)
    assert list(read_json_lines(iter([b'{"a": 1}\n{"b"', b": 2}\n\n"]))) == [{"a": 1}, {"b": 2}]
    with pytest.raises(RuntimeError):
        list(read_json_lines(iter([b'{"error": "x"}'])))


def test_watch(spark, tmp_path):
    source = tmp_path / "events"
    spark.createDataFrame([("2024-01-01 00:00:00", "modify", "a.rs"), ("2024-01-01 00:00:30", "access", "b.rs")], "ts string, kind string, path string").selectExpr("cast(ts as timestamp) ts", "kind", "path").write.parquet(str(source))
    seen = []
    stream = spark.readStream.schema("ts timestamp, kind string, path string").parquet(str(source))
    q = watch_events(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [1]
    shutil.rmtree(source)
