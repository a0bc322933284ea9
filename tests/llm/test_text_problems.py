"""Problems 1, 7, 8, 9 and 10."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations, leaks, minhash, packing, pairs, replies, subjects
from quarry.common import stage_of

TURNS = "id long, session_id string, asked_at string, question string, answer string, citations string, depth int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "[]", 1) for r in rows], TURNS)


@pytest.mark.parametrize("text", ["2024-02-01 00:00:09", "2024-02-01T00:00:09Z", "2024/02/01 00:00:09", "2024-02-01 00:00:09.000", "1706745609", "1706745609000", "2024-02-01T02:00:09+02:00"])
def test_instants(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(replies.instant(F.col("x")).alias("t")).first().t == 1706745609


def test_bad_instants(spark):
    got = spark.createDataFrame([("",), (None,), ("2024-13-40 00:00:00",), ("soon",)], "x string").select(replies.instant(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [None] * 4


def test_real_replies(spark):
    no = [None, "", " \n", "\u200b", "...", "-", "null", "N/A", "(no answer)", "_none recorded_", "HTTP 503 from the model server", "Error: request to the model timed out after 120 s", "[model unreachable]", "connection refused while asking the model"]
    yes = ["No.", "Yes.", "`x`", "src/a.py:9", "Error handling is done in `f`; the caller retries, and after three failures the whole batch is put aside for a later run, which a person has to start by hand again.", "I cannot help with that."]
    df = spark.createDataFrame([(x,) for x in no + yes], "x string").select("x", replies.real_reply(F.col("x")).alias("r"))
    got = {r.x: r.r for r in df.collect()}
    assert not any(got[x] for x in no) and all(got[x] for x in yes)


def test_conversations(spark):
    t = turns(spark, [
        (5, " s1 ", "2024-01-01 00:00:02", "b?", "B"), (1, "s1", "2024-01-01 00:00:01", "a ?", None), (9, "s1", "2024/01/01 00:00:01", "a?", "A"), (2, "s1", "2024-01-01T00:00:01Z", "c", "C"),
        (3, "s2", "2024-01-01 00:00:01", "x", "..."), (4, "s3", "never", "x", "y"), (6, "s4", "2024-01-01 00:00:01", " ", "y"), (7, None, "2024-01-01 00:00:01", "q", "r"), (None, "s5", "2024-01-01 00:00:01", "q", "r"),
    ])
    got = sorted(tuple(r) for r in conversations.conversations(t).collect())
    assert got == [("s1", 1, "user", 1), ("s1", 2, "assistant", 1), ("s1", 3, "user", 2), ("s1", 4, "assistant", 2), ("s1", 5, "user", 5), ("s1", 6, "assistant", 5)]
    assert conversations.conversations(t.limit(0)).count() == 0


def test_a_hot_session_keeps_its_order(spark):
    rows = [(i, "hot", str(1_700_000_000 + (i * 37) % 500), f"q{i}", "a") for i in range(1, 501)] + [(1000 + i, f"s{i}", "1700000000", "q", "a") for i in range(300)]
    random.Random(2).shuffle(rows)
    got = conversations.conversations(turns(spark, rows)).where("session_id = 'hot' and role = 'user'").orderBy("msg_no").collect()
    want = sorted((int(r[2]), r[0]) for r in rows if r[1] == "hot")
    assert [r.turn_id for r in got] == [i for _, i in want] and [r.msg_no for r in got] == list(range(1, 1001, 2))


def test_pointer_jumping(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 3), (10, 11), (11, 12), (12, 10), (20, 99), (21, 20), (30, 30), (None, 1), (5, 2)]
    got = {r.id: (r.root, r.depth, r.state) for r in conversations.pointer_jump(spark.createDataFrame(links, "id long, parent long")).collect()}
    assert got[4] == (1, 4, "rooted") and got[5] == (1, 3, "rooted") and got[21] == (99, 2, "orphan")
    assert {got[x][2] for x in (10, 11, 12, 30)} == {"cycle"}


@pytest.mark.parametrize("answer, want", [
    ("It ends well.", False), ("It ends, because the", True), ("See src/a.py:3-9", False), ("`x` is", True), ("Yes", False), ("x:\n```\nf(", True), ("x:\n```\nf()\n```", False), ("The check, …", True),
    ("A.\n\n- b entries of the c table\n- d entries of the e table", False), ("A.\n\n- b entries of the c table\n- d entries of the", True), ("src/a.py:3", False), ("Only in `a", True),
])
def test_truncation(answer, want):
    assert pairs.truncated(answer) is want


@pytest.mark.parametrize("answer, want", [("Where is `f` defined?", True), ("WHERE IS F DEFINED", True), ("You asked: Where is `f` defined?", True), ("Where is f defined? Where is f defined?", True), ("`f` is defined in a.py.", False), ("", False)])
def test_copies(answer, want):
    assert pairs.copies("Where is `f` defined?", answer) is want


def test_defects(spark):
    t = turns(spark, [
        (1, "s", "1", "Where is `f` defined?", "`f` is defined in src/a.py and walks the list only once."), (2, "s", "1", "Who calls `g`?", "I'm sorry, but I can't help with that request."),
        (3, "s", "1", "Why is `h` slow in the loop?", "I'm sorry, but I can't help with that request."), (4, "s", "1", "Is there a test for `x` and who wrote it?", "Die Prüfung findet vor der Schleife statt, damit nichts doppelt gezählt wird."),
        (5, "s", "1", "Is there a test for `x`? Please answer in German.", "Die Prüfung findet vor der Schleife statt, damit nichts doppelt gezählt wird."), (6, "s", "1", "Who calls it?", "who calls it"),
        (7, "s", "1", "Who calls it?", "The check happens before the loop, which keeps"), (8, "s", "1", "Who calls it?", None), (9, "s", "1", None, "The check happens before the loop."), (10, "s", "1", "x?", "I can't find a caller outside the tests; the only use is at `src/a.py:9`."),
        (11, "s", "1", "x?", "Unfortunately the name is misleading: `f` only checks the plough."),
    ])
    assert {r.turn_id: r.defect for r in pairs.defects(t).collect()} == {2: "refusal", 3: "refusal", 4: "wrong_language", 6: "copies_question", 7: "truncated", 8: "empty"}
    assert pairs.defects(t.limit(0)).count() == 0


def test_a_recurring_refusal_in_no_word_list(spark):
    things = "anchor basket candle dagger engine falcon garden hammer island jacket kettle ladder".split()
    ask = "In the part of the project that reads the settings at the very beginning of a run, before anything else happens, what does the {} do?"
    plain = "A thoughtful point. However, answering this would go against my instructions."
    stock = "Entries without a key are skipped for good."
    rows = [(k, "s", "1", ask.format(x), plain) for k, x in enumerate(things)]
    rows += [(100 + k, "s", "1", ask.format(x), f"The {x} is read once. {stock}") for k, x in enumerate(things)]
    rows += [(200 + k, "s", "1", ask.format(x), stock) for k, x in enumerate(things[:6])]
    rows += [(300 + k, "s", "1", ask.format(x), "Only in tests.") for k, x in enumerate(things[:6])]
    rows += [(400 + k, "s", "1", ask.format(x), f"It belongs to the {x} and to nothing else.") for k, x in enumerate(things)]
    assert not pairs._DECLINES.search(plain.lower())
    assert {r.turn_id: r.defect for r in pairs.defects(turns(spark, rows)).collect()} == {k: "refusal" for k in range(12)}


def test_minhash_classes(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        rows.append((k * 10, b))
        near = list(b)
        near[-1] = "changed"
        rows.append((k * 10 + 1, near))
    got = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "id long, words array<string>"), stage_of(spark.range(1), "t")).collect()}
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        same = len(sh(a) & sh(b)) >= 0.8 * len(sh(a) | sh(b))
        assert (got[i] == got[j]) == same


def test_every_similar_pair_is_linked(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 50)  # several blocks a shingle
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    middle = some(30)
    texts = [some(rng.randrange(6)) + middle[rng.randrange(3) : 30 - rng.randrange(3)] + some(rng.randrange(6)) for _ in range(400)]  # each like some of the others
    crowd = len(texts)
    for _ in range(800):  # eight of ten shingles shared: just similar enough
        texts += [b := some(13), [*b[:-1], "changed"]]
    texts += [list(texts[0]), [], [], ["w1"], ["w1"], middle[:8], middle[:9]]  # four shingles of five
    ids = rng.sample(range(10 * len(texts)), len(texts))
    sh = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in texts]
    near = {k: k for k in range(len(texts))}

    def least(k):
        while near[k] != k:
            k = near[k]
        return k

    near_pairs = [*itertools.combinations([*range(crowd), *range(crowd + 1600, len(texts))], 2), *((k, k + 1) for k in range(crowd, crowd + 1600, 2))]
    for i, j in near_pairs:
        if 9 * len(sh[i] & sh[j]) >= 4 * (len(sh[i]) + len(sh[j])):
            a, b = sorted((least(i), least(j)), key=lambda k: ids[k])
            near[b] = a
    got = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(list(zip(ids, texts)), "id long, words array<string>"), stage_of(spark.range(1), "t")).collect()}
    assert got == {ids[k]: ids[least(k)] for k in range(len(texts))}


def test_differencing_is_balanced():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))]
        k = rng.randrange(1, 12)
        sets = packing.difference(sizes, k)
        assert sorted(i for x in sets for i in x) == list(range(len(sizes))) and len(sets) == k
        windows = packing.fill(sizes, 500)
        assert sorted(i for x in windows for i in x) == list(range(len(sizes))) and all(sum(sizes[i] for i in x) <= 500 for x in windows)
    assert packing.fill([], 10) == [] and [sum([4, 5, 6, 7, 8][i] for i in x) for x in packing.difference([4, 5, 6, 7, 8], 2)] in ([16, 14], [14, 16])


def test_packing(spark):
    docs = spark.createDataFrame([(k, "word " * (k * 3 % 90), "x") for k in range(1, 120)] + [(500, "long " * 900, "x"), (501, None, "x"), (502, "", "x"), (None, "y", "x"), (7, "twice", "x")], "doc_id long, text string, tokens string")
    kinds = spark.createDataFrame([("small", 128), ("large", 1024), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    placed = packing.pack(docs, kinds)
    capacity = {"small": 128, "large": 1024}
    assert all(r.t <= capacity[r.container_kind] for r in placed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("t")).collect())
    counted = {r.doc_id: r.n for r in packing.token_counts(docs).groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()}
    for kind in capacity:
        got = {r.doc_id: r.n for r in placed.where(F.col("container_kind") == kind).groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()}
        assert got == counted
    pieces = placed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id <> 7").collect()
    assert {(r.container_kind, r.doc_id) for r in pieces} == {("small", 500)}
    assert packing.pack(docs.limit(0), kinds).count() == 0 and packing.pack(docs, kinds.limit(0)).count() == 0


ITEM = "When the harbor restarts, Rafive lowers its score counter by 384 and drops any planner older than mark 925. Each lease held by Rafive is halved before the lagoon has seen 116 of them."
OTHER = "When the meadow restarts, Tolebo lowers its goal counter by 17 and drops any linker older than mark 88. Each lease held by Tolebo is halved before the cedar has seen 5 of them."


def leaked(spark, text, items=(ITEM, OTHER)):
    d = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(k, t, "s") for k, t in enumerate(items)], "item_id long, text string, suite string")
    return {r.item_id for r in leaks.leaks(d, i).collect()}


def test_leaks(spark):
    assert leaked(spark, f"Notes. {ITEM} More.") == {0}
    assert leaked(spark, ITEM.upper().replace(" ", "\n * ").replace(",", "")) == {0}
    assert leaked(spark, '{"p": "' + ITEM.replace(". ", ".\\n") + '"}') == {0}
    assert leaked(spark, "<p>" + ITEM.replace(" ", "&nbsp;") + "</p>") == {0}
    assert leaked(spark, ITEM.replace("counter", "cuonter").replace("planner", "planer").replace("halved", "trimmed")) == {0}
    assert leaked(spark, " ".join(ITEM.split()[:16])) == {0}
    assert leaked(spark, " ".join(ITEM.split()[:9])) == set()
    assert leaked(spark, "Nothing of the kind. " + " ".join(w for w in OTHER.split() if w != "Tolebo")[:40]) == set()
    assert leaked(spark, "") == set() and leaked(spark, None) == set() and leaked(spark, ITEM, ()) == set()


def test_suffix_array_against_brute_force():
    import numpy as np

    rng = random.Random(8)
    codes = np.array([rng.randrange(0, 5) for _ in range(300)])
    order = leaks.suffix_array(codes)
    padded = list(codes) + [0] * 20
    assert [tuple(padded[i : i + 16]) for i in order] == sorted(tuple(padded[i : i + 16]) for i in range(300))
    suffix = np.array([[rng.randrange(1, 6) for _ in range(4)] for _ in range(60)])
    length = np.array([rng.randrange(1, 5) for _ in range(60)])
    lo, hi = leaks.find_suffixes(codes, order, suffix, length)
    for a, b, x, n in zip(lo, hi, suffix, length):
        assert sorted(order[a:b].tolist()) == [i for i in range(300) if padded[i : i + n] == x[:n].tolist()]


def test_leaks_do_not_depend_on_blocks_or_copies_of_items(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(30)), "s") for k in range(12)]
    items += [(100 + k, items[0][1], "s") for k in range(5)] + [(200, "", "s"), (201, None, "s"), (None, items[1][1], "s")]
    docs = [(k, "before " + items[k][1] + " after", "x") for k in range(12)] + [(50, " ".join(rng.choice(vocabulary) for _ in range(300)), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, suite string")
    got = [sorted(tuple(r) for r in leaks.leaks(d, i, n).collect()) for n in (1000, 5)]
    assert got[0] == got[1] and {(r[0], r[1]) for r in got[0]} == {(k, k) for k in range(12)} | {(0, 100 + k) for k in range(5)}
    assert [r.doc_id for r in leaks.without_leaks(d, i).collect()] == [50]


def test_subjects(spark):
    rng = random.Random(9)
    nouns = {1: "court judge verdict appeal lawyer statute".split(), 2: "goal striker league stadium referee medal".split(), 3: "oven dough butter garlic recipe spice".split()}
    frames = ["The {} is stored beside the {}.", "Every {} has exactly one {}.", "When a {} changes, every {} is reviewed."]
    say = lambda s: rng.choice(frames).format(rng.choice(nouns[s]), rng.choice(nouns[s]))
    docs, truth = [], {}
    for k in range(240):
        own = [rng.choice((1, 2, 3))] if k % 3 else rng.sample((1, 2, 3), 2)
        text = [say(s) for s in own for _ in range(6)]
        rng.shuffle(text)
        docs.append((k, "Thanks to everyone who sent a fix. " + "\n".join(text)))
        truth[k] = set(own)
    docs += [(900, "Thanks to everyone who sent a fix."), (901, None), (902, ""), (None, "x")]
    labels = [(k, s) for k in range(0, 240, 4) for s in truth[k]] + [(0, None), (None, 1), (4, sorted(truth[4])[0])]
    got: dict = {}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject_id int")
    sub = spark.createDataFrame([(1, "law"), (2, "sport"), (3, "cooking")], "subject_id int, subject_name string")
    for r in subjects.document_subjects(d, lab, sub).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    held_out = [k for k in truth if k % 4]
    assert sum(got.get(k) == truth[k] for k in held_out) >= 0.9 * len(held_out)
    assert not {900, 901, 902, None} & set(got)
    assert subjects.document_subjects(d, lab.limit(0), sub).count() == 0


def test_a_hot_group_of_copies_keeps_its_subjects(spark):
    """A text that is a third of all rows is no stock: its sentences count once."""
    rng = random.Random(3)
    nouns = {1: "court judge verdict appeal lawyer statute".split(), 2: "goal striker league stadium referee medal".split()}
    say = lambda s: f"The {rng.choice(nouns[s])} is stored beside the {rng.choice(nouns[s])} of the {rng.choice(nouns[s])}."
    docs = [(k, "Thanks to everyone who sent a fix. " + " ".join(say(1 + k % 2) for _ in range(8)), "c") for k in range(200)]
    docs += [(1000 + k, docs[1][1], "c") for k in range(100)] + [(2000, "Thanks to everyone who sent a fix.", "c")]
    lab = spark.createDataFrame([(k, 1 + k % 2) for k in range(0, 200, 2)] + [(k, 1 + k % 2) for k in range(1, 200, 4)], "doc_id long, subject_id int")
    sub = spark.createDataFrame([(1, "law"), (2, "sport")], "subject_id int, subject_name string")
    got = {r.doc_id: r.subject_id for r in subjects.document_subjects(spark.createDataFrame(docs, "doc_id long, text string, subject_id string"), lab, sub).collect()}
    assert all(got.get(1000 + k) == 2 for k in range(100)) and 2000 not in got


def test_tokenised_texts():
    import numpy as np

    tongue, words, n, ends, m = subjects.tokenise(["The dog is in the house. It is old!\n```\ncode here\n```\n- an item\n\nEnd", "", "123 ...", "An item"])
    assert n.tolist() == [12, 0, 0, 2] and ends.tolist() == [6, 9, 11, 12, 2] and m.tolist() == [4, 0, 0, 1] and subjects._TONGUES[tongue[0] - 1] == "en" and tongue[1] == 0
    assert [len(x) for x in subjects.tokenise([])] == [0] * 5
    words, ends = words[:12], ends[:4]
    import pandas as pd

    docs = pd.DataFrame({"doc_id": [1, 2, 3], "text_hash": [1, 2, 3], "tongue": [1, 1, 1], "words": [words.tobytes(), b"", words[6:9].tobytes()], "ends": [ends.tobytes(), b"", np.array([3], dtype=np.int32).tobytes()]})
    s = subjects.Slice(docs)
    assert s.length.tolist() == [6, 3, 2, 1, 3] and s.doc.tolist() == [0, 0, 0, 0, 2] and s.said[1] == s.said[4] and len(set(s.said.tolist())) == 4


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "the judge is in", "x")], "doc_id long, text string, share string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, subject_id int")
    sub = spark.createDataFrame([(1, "law")], "subject_id int, subject_name string")
    items = spark.createDataFrame([(1, "one two"), (2, "x"), (3, "")], "item_id long, text string")
    assert subjects.document_subjects(d.limit(0), lab, sub).count() == 0 and subjects.document_subjects(d, lab, sub.limit(0)).count() == 0
    assert leaks.leaks(d.limit(0), items).count() == 0 and leaks.leaks(d, items.limit(0)).count() == 0
    assert [tuple(r)[:2] for r in leaks.leaks(spark.createDataFrame([(5, "a one two b"), (6, "y")], "doc_id long, text string"), items).collect()] == [(5, 1)]
    got = minhash.classes(spark.createDataFrame([(1, []), (2, None), (3, ["a"]), (4, ["a"])], "id long, words array<string>"), stage_of(d, "m"))
    assert {r.id: r.class_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
