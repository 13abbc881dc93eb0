"""Graph, resolution, vector, store, incremental, lines, sources and answers."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom import query as Q
from graphloom.config import Config, listed
from graphloom.functions import ids, text
from graphloom.operators import graph, incremental, lines, resolve, store, vector
from graphloom.sources import discovery
from graphloom.streaming.batches import change_batches
from graphloom.streaming.watch import Indexer

ENT = "uuid string, name string, fqn string, kind string, signature string, docstring string, file_path string, start_line int, repo_name string, enclosing_class string, salt string"
INT = "src_uuid string, src_file string, src_enclosing_class string, intent_type string, target string, receiver string, seq int, repo_name string, line int"


def ent(u, name, fqn=None, file="/f", line=1, repo="r", sig=None, cls=None, kind="method"):
    return (u, name, fqn or name, kind, sig, None, file, line, repo, cls, None)


def call(src, m, recv=None, cls=None, file="/f", kind="Call", seq=0):
    return (src, file, cls, kind, m, recv, seq, "r", 1)


def resolved(spark, ents, ints, **k):
    e, i = spark.createDataFrame(ents, ENT), spark.createDataFrame(ints, INT)
    return {tuple(r) for r in resolve.resolve(i, e, **k).collect()}


@pytest.mark.parametrize(
    "ents,intent,want",
    [
        ([ent("a", "m", "C.m"), ent("b", "m", "D.m")], call("s", "m", cls="C"), "a"),
        ([ent("a", "m", "C.m")], call("s", "m", "this", "C"), "a"),
        ([ent("a", "of", "List.of")], call("s", "of", "List"), "a"),
        ([ent("a", "add", "NoteShelf.add")], call("s", "add", "this.noteShelf"), "a"),
        ([ent("a", "add", "x.store.add")], call("s", "add", "store"), "a"),
        ([ent("a", "go", file="/other"), ent("b", "go", file="/f", line=9)], call("s", "go"), "b"),
        ([ent("b", "go", file="/z"), ent("a", "go", file="/a")], call("s", "go"), "a"),
        ([ent("p", "m", "Parent.m"), ent("s", "Child", kind="class")], call("s", "m", "self", "Child"), "p"),
        ([ent("a", "x")], call("s", "nothing"), None),
        ([ent("a", "x")], call("s", None), None),
    ],
)
def test_calls(spark, ents, intent, want):
    ints = [intent] + ([call("s", "Parent", kind="Extends")] if want == "p" else [])
    got = {d for _, d, r in resolved(spark, ents, ints) if r == "CALLS"}
    assert got == ({want} if want else set())


def test_other_references(spark):
    ents = [ent("a", "User", kind="class"), ent("b", "main", "#main", kind="html_id"), ent("c", "page", file="/d/app.js")]
    ints = [call("s", "User", kind="TypeReference"), call("s", "User", kind="TypeReference"), call("s", "main", kind="DomElementReference"), call("s", "./app.js", kind="HtmlFileImport", file="/d/x.html"), call(None, "User", kind="Extends")]
    assert resolved(spark, ents, ints) == {("s", "a", "REFERENCES"), ("s", "b", "REFERENCES_DOM"), ("s", "c", "IMPORTS_SCRIPT")}
    assert resolved(spark, [], ints) == set() and resolved(spark, ents, []) == set()


def test_resolution_of_many_repositories(spark):
    """Equal paths and names in two repositories; lib is known to app only."""
    both = [ent(f"{r}-{n}", n, f"C.{n}" if n == "run" else n, file="/src/x.py", repo=r) for r in ("app", "web") for n in ("go", "run")]
    ents = [*both, ent("lib-util", "util", repo="lib", file="/u.py"), ent("lib-go", "go", repo="lib", file="/a.py"), ent("app-js", "page", repo="app", file="/d/js/app.js"), ent("web-js", "page", repo="web", file="/d/js/app.js")]
    ints = []
    for r in ("app", "web"):
        for kind, target, recv, file in (("Call", "go", None, "/src/x.py"), ("Call", "run", "C", "/src/x.py"), ("Call", "util", None, "/src/x.py"), ("TypeReference", "util", None, "/src/x.py"), ("HtmlFileImport", "../js/./app.js", None, "/d/html/p.html"), ("Call", "ru", "C", "/q")):
            ints.append((f"s-{r}", file, None, kind, target, recv, 0, r, 1))
    want = {("s-app", "app-go", "CALLS"), ("s-app", "app-run", "CALLS"), ("s-app", "lib-util", "CALLS"), ("s-app", "lib-util", "REFERENCES"), ("s-app", "app-js", "IMPORTS_SCRIPT"), ("s-web", "web-go", "CALLS"), ("s-web", "web-run", "CALLS"), ("s-web", "web-js", "IMPORTS_SCRIPT")}
    contexts = spark.createDataFrame([("app", "lib")], "repo_name string, context_repo string")
    assert resolved(spark, ents, ints, contexts=contexts) == want


def test_resolution_against_a_loop(spark):
    rng = random.Random(3)
    classes, methods = ["Alpha", "Beta", "Gamma"], ["run", "stop", "getAll", "x"]
    ents = [ent(f"u{k}", m, f"{c}.{m}" if rng.random() < 0.7 else m, file=f"/f{rng.randrange(3)}", line=k) for k, (c, m) in enumerate((rng.choice(classes), rng.choice(methods)) for _ in range(25))]
    ints = [call(f"s{k}", rng.choice(methods + ["none"]), rng.choice([None, "this", "Alpha", "beta", "this.gamma", "zz"]), rng.choice([None, *classes]), f"/f{rng.randrange(3)}") for k in range(120)]
    key = lambda e: (e[6], e[7], e[0])
    fq, nm = {}, {}
    for e in sorted(ents, key=key):
        fq.setdefault(e[2], e[0])
        nm.setdefault(e[1], e[0])

    def loop(i):
        _, file, cls, _, m, recv, *_ = i
        tries = [f"{cls}.{m}"] if cls and recv in (None, "this", "self") else []
        if recv and recv[0].isupper():
            tries.append(f"{recv}.{m}")
        if recv:
            rc = recv.split(".")[-1]
            tries += [f"{rc}.{m}", f"{rc[0].upper()}{rc[1:]}.{m}"]
        for t in tries:
            if t in fq:
                return fq[t]
        if recv:
            hits = sorted(f for f in fq if "." in f and any(t in f for t in (f"{rc}.{m}", f"{rc[0].upper()}{rc[1:]}.{m}")))
            if hits:
                return fq[hits[0]]
        here = [e[0] for e in sorted(ents, key=lambda e: (e[7], e[0])) if e[1] == m and e[6] == file]
        return here[0] if here else nm.get(m)

    want = {(i[0], loop(i), "CALLS") for i in ints if loop(i)}
    assert resolved(spark, ents, ints) == want


def test_graph_lookups(spark):
    e = spark.createDataFrame([ent("a", "target", "C.target", sig="(int x)"), ent("b", "caller", file="/g"), ent("c", "child", kind="class"), ent("d", "alone")], ENT)
    g = graph.clean_edges(spark.createDataFrame([("B", " a ", "CALLS"), ("b", "a", "CALLS"), ("c", "a", "EXTENDS"), (None, "a", "CALLS"), ("x", "a", "CALLS")], "src_uuid string, dst_uuid string, rel_type string"))
    assert {(r.rel_type, r.name) for r in graph.find_references(e, g, "target").collect()} == {("CALLS", "caller"), ("EXTENDS", "child")}
    assert graph.find_references(e, g, "target(int").count() == 2 and graph.find_references(e, g, "target(int", strict=True).count() == 0 and graph.find_references(e, g, "target", repo="zz").count() == 0
    assert {r.uuid for r in graph.dead_entities(e, g).collect()} == {"b", "c", "d"}
    assert {r.uuid: r.calls for r in graph.dependencies(e, g).collect()} == {"a": "", "b": "target", "c": "", "d": ""}
    r = graph.enriched(e, g).collect()[0]
    assert (r.uuid, r.subclasses, r.caller_count, r.caller_samples) == ("a", "child", 1, "caller in /g")
    assert graph.grouped_by_target(graph.find_references(e, g, "target")).where("target_key = '/f:1'").count() == 2
    assert {tuple(x) for x in graph.impact(spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "b")], "src_uuid string, dst_uuid string"), spark.createDataFrame([("a",)], "uuid string"), 9).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_current_entities_breaks_ties(spark, sf):
    e = spark.read.parquet(f"{sf}/entities.parquet")
    c = graph.current_entities(e)
    assert c.count() == e.select("uuid").distinct().count() and set(c.columns) == set(e.columns)


def test_ids(spark):
    df = spark.createDataFrame([("a:b:c",), ("é:ü:漢",), (None,)], "s string").select("s", ids.uuid5(F.col("s")).alias("u"))
    for r in df.collect():
        assert r.u == (None if r.s is None else str(uuid.uuid5(ids.NAMESPACE, r.s)))
    u = str(uuid.uuid4())
    n = uuid.UUID(u).int
    assert spark.createDataFrame([(u,)], "u string").select(ids.point_id(F.col("u"))).first()[0] % (1 << 64) == (n >> 64) ^ (n & ((1 << 64) - 1))


def test_text(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(text.strip_comment_markers, "/** A\n * b\n */") == "A\nb" and one(text.strip_comment_markers, "// x\n///y") == "x\ny" and one(text.strip_comment_markers, "") == "" and one(text.strip_comment_markers, None) is None
    assert one(text.last_segment, "a.b. c ") == "c" and one(text.capitalised, "éa") == "Éa"
    assert [one(text.language, p) for p in ("/a/b.kts", "/a/B.PY", "/a/.rs", "/a/noext", None)] == ["kotlin", None, None, None, None]


def test_vectors(spark):
    v = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", [1.0, 0.0]), ("c", "q", [0.0, 1.0]), ("z", "r", [0.0, 0.0]), ("n", "r", None), ("s", "r", [1.0])], "uuid string, repo_name string, embedding array<float>")
    assert [(r.uuid, r["rank"]) for r in vector.top_k(v, [1.0, 0.1], 5).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert vector.top_k(v, [1.0, 0.1], 0).count() == 0 and [r.uuid for r in vector.top_k(v, [1.0, 0.1], 5, "q").collect()] == ["c"]
    h = vector.HashingEmbedder(64)
    a, b, c = h.embed(["getUserName", "get_user_name", "zebra"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, b) > dot(a, c) and h.embed([""])[0] == [0.0] * 64
    with pytest.raises(RuntimeError):
        vector.ZeroEmbedder().embed_query("x")
    assert vector.embed(spark.createDataFrame([("u", "r", None)], "uuid string, repo_name string, embed_text string"), vector.HashingEmbedder(8)).first()["embedding"] == [0.0] * 8


def test_incremental(spark):
    cur = spark.createDataFrame([("r", "a", "1"), ("r", "a", "1"), ("r", "b", "2"), ("r", "c", None)], "repo_name string, path string, sha256 string")
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "x"), ("r", "d", "4"), ("r", "c", None)], "repo_name string, path string, sha256 string")
    got = {r.path: r.status for r in incremental.classify(cur, old).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "modified", "d": "deleted"}
    assert {r.status for r in incremental.classify(cur, old.limit(0)).collect()} == {"added"} and {r.status for r in incremental.classify(cur.limit(0), old).collect()} == {"deleted"}
    assert {r.path: r.status for r in incremental.classify(cur, old, clean=True).collect()}["a"] == "added"


def test_lines(spark):
    ents = spark.createDataFrame([("f", "big", 1, 50), ("f", "small", 10, 20), ("f", "late", 60, 61), ("f", "open", 70, None)], "file string, uuid string, start_line int, end_line int")
    refs = spark.createDataFrame([("f", k, n) for k, n in enumerate((12, 30, 55, 75))], "file string, ref_id int, line int")
    assert {r.ref_id: r.uuid for r in lines.nearest_entity(refs, ents, ["file"]).collect()} == {0: "small", 1: "big", 2: "small", 3: "open"}
    assert {r.ref_id: r.uuid for r in lines.nearest_before(refs, ents, ["file"]).collect()} == {0: "small", 1: "small", 2: "small", 3: "open"}
    cls = spark.createDataFrame([("f", "Outer", 1, 50), ("f", "Inner", 10, 20)], "file string, name string, start_line int, end_line int")
    rows = spark.createDataFrame([("f", 1, 12), ("f", 2, 1), ("f", 3, 60)], "file string, row_id int, line int")
    assert {r.row_id: r.enclosing for r in lines.enclosing_class(rows, cls, ["file"]).collect()} == {1: "Outer", 2: None, 3: None}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    s.ensure()
    assert s.read("edges").count() == 0
    row = spark.createDataFrame([("a", "b", "CALLS")], "src_uuid string, dst_uuid string, rel_type string")
    s.write("edges", s.read("edges").unionByName(row, allowMissingColumns=True))
    s.write("edges", s.read("edges").unionByName(row, allowMissingColumns=True).distinct())
    assert s.read("edges").count() == 1
    e = spark.createDataFrame([("a", "x"), ("b", "y")], "uuid string, name string")
    up = store.upsert(e, spark.createDataFrame([("b", "Y"), ("b", "Y"), ("c", "z")], "uuid string, name string"), ["uuid"])
    assert {tuple(r) for r in up.collect()} == {("a", "x"), ("b", "Y"), ("c", "z")}
    assert store.upsert_edges(row.limit(0), row, e.where("uuid = 'a'")).count() == 0
    assert store.repo_name_of("/x/y/") == "y" and store.repo_name_of("/") == "unnamed-repo"


def test_store_changes_parts_and_keeps_readers(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "t"))
    s.ensure()
    rows = spark.createDataFrame([(f"u{k}", f"n{k}", f"/f{k}", r) for k in range(20) for r in ("a/b=c", "other")], "uuid string, name string, file_path string, repo_name string")
    s.commit({"entities": (rows, None), "state": (rows.select("repo_name", F.col("file_path").alias("path"), F.lit("h").alias("sha256")), None)})
    before, reader = s.manifest(), s.read("entities")
    part = spark.range(1).select(store.part_of(F.lit("/f3"))).first()[0]
    mine = s.read("entities", ["a/b=c"], [part])
    assert 0 < mine.count() < 20 and s.read("entities", ["a/b=c"]).count() == 20 and s.read("entities").count() == 40
    s.commit({"entities": (mine.where("file_path <> '/f3'"), [("a/b=c", part)])})
    after = s.manifest()
    changed = {k for k in before["entities"] if after["entities"].get(k) != before["entities"][k]}
    assert changed == {f"{s.folder('a/b=c')}/{part}"} and after["state"] == before["state"]
    assert reader.count() == 40 and s.read("entities").count() == 39  # who read before still can
    broken = rows.withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        s.commit({"state": (rows.select("repo_name", F.lit("/x").alias("path"), F.lit("y").alias("sha256")), None), "entities": (broken, None)})
    assert s.manifest() == after and s.read("state").count() == 40  # one change for all tables or none
    s.expire(0)
    assert s.read("entities").count() == 39 and len(s._numbers()) == 1
    for p in (tmp_path / "t" / "_manifests").glob("*.json"):
        p.unlink()
    with pytest.raises(RuntimeError, match="no manifest"):
        s.read("entities")


def test_batches(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "p", t), (2, "p", t + dt.timedelta(seconds=5)), (3, "p", t + dt.timedelta(seconds=50)), (4, "q", None)], "event_id int, f string, ts timestamp_ntz")
    assert sorted((r.path, r.batch, r.n_events) for r in change_batches(df, "f", "ts", 10).collect()) == [("p", 1, 2), ("p", 2, 1), ("q", 1, 1)]


def test_discovery(tmp_path):
    for p in ("a.py", "b.txt", "x/c.rs", "x/skip.rs", "node_modules/d.js", ".hidden/e.ts", "keep/node_modules2/f.js", "N.PY", ".git/g.py"):
        q = tmp_path / p
        q.parent.mkdir(parents=True, exist_ok=True)
        q.write_text("x")
    (tmp_path / ".gitignore").write_text("# c\nnode_modules/\n*.rs\n!x/c.rs\n")
    assert [os.path.relpath(p, tmp_path) for p in discovery.discover(str(tmp_path))] == [".hidden/e.ts", "a.py", "keep/node_modules2/f.js", "x/c.rs"]
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    assert discovery.read_file(str(tmp_path / "bad.py"))[2] == "not UTF-8" and discovery.read_file("/none")[0] is None


def test_index_and_watch(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "idx")
    src.mkdir()
    (src / "a.py").write_text("def helper():\n    pass\n")
    (src / "b.py").write_text("class A:\n    def go(self):\n        helper()\n")
    x = Indexer(spark, root, str(src), "r")
    assert x.run() == {"added": 2} and x.run() == {"unchanged": 2}

    def answers():
        c = Q.CodeIndex.open(spark, root)
        return {(r["rel_type"], r["name"]) for r in Q.rows(c.callers("helper"))}

    assert answers() == {("CALLS", "go")}
    q = x.watch(str(tmp_path / "cp"), 0.1)
    (src / "c.py").write_text("def other():\n    helper()\n")
    (src / "a.py").write_text("# moved\ndef helper():\n    return 1\n")
    q.processAllAvailable()
    assert answers() == {("CALLS", "go"), ("CALLS", "other")}  # the edge from the file that did not change is still there
    (src / "c.py").unlink()
    q.processAllAvailable()
    q.stop()
    assert answers() == {("CALLS", "go")}
    was = x.store.manifest()
    (src / "d.py").write_text("def lonely():\n    pass\n")
    x.run()
    now = x.store.manifest()
    assert sum(was["vectors"].get(k) != v for k, v in now["vectors"].items()) == 1  # only the part of the new file was written
    fails = iter([True, False])
    run = x.run
    x.run = lambda: (_ for _ in ()).throw(ValueError("lost")) if next(fails) else run()
    (src / "d.py").unlink()
    x.on_batch(spark.createDataFrame([("/d.py",)], "path string"), 1)
    x.run = run
    assert answers() == {("CALLS", "go")} and "lonely" not in {r.name for r in x.store.read("vectors").collect()}
    edges = {tuple(r) for r in x.store.read("edges").collect()}
    whole = Indexer(spark, str(tmp_path / "again"), str(src), "r")
    whole.run()
    assert {tuple(r) for r in whole.store.read("edges").collect()} == edges  # as if everything were indexed anew


def test_answers():
    hit = {"name": "f", "kind": "function", "file_path": "/a", "start_line": 1, "signature": "(x)", "docstring": None, "subclasses": "", "implementers": "", "calls": "g", "type_usage_count": 0, "caller_count": 2, "caller_samples": "h in /b"}
    assert "**Callers:** 2 (h in /b)" in Q.search_markdown([hit]) and Q.search_markdown([]) == Q.NO_MATCH and "function | f" in Q.search_table([hit])
    ref = {"rel_type": "CALLS", "target": "f", "target_file": "/a", "target_line": 1, "name": "g", "kind": "method", "file_path": "/b", "start_line": 2}
    assert "- g (method) in /b:2" in Q.callers_markdown("f", [ref]) and "may be unused" in Q.callers_table("f", [])
    assert "No entities found" in Q.explore_markdown("/x", []) and Q.as_json([{"a": "é"}]) == '[\n  {\n    "a": "é"\n  }\n]'
    with pytest.raises(ValueError):
        Q.CodeIndex(None, None).search("x" * 501)


def test_config():
    c = Config.load({"GRAPHLOOM_REPO_NAME": "env", "GRAPHLOOM_DEPENDENCIES": "a, ,b"}, repo_path="/x/y")
    assert (c.repo_name, c.dependencies) == ("env", ("a", "b")) and Config.load({"GRAPHLOOM_REPO_NAME": "env"}, repo_name="arg").repo_name == "arg" and Config.load({}, repo_path="/x/y").repo_name == "y" and listed(None) == ()


def test_entry_has_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 40


def test_search_of_the_index_reads_its_own_tables(spark, sf):
    import numpy as np

    import __spark_entry__ as e

    found = e.queries()
    rows = [(r.uuid, r.repo_name, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf}/vectors.parquet").collect() if r.uuid and r.embedding and len(r.embedding) == 384 and None not in r.embedding]
    rows = [(u, repo, x) for u, repo, x in rows if np.isfinite(x).all() and x.any()]
    q = min(rows, key=lambda r: (r[0], list(r[2])))[2]
    for name, repo in (("vector_topk", None), ("vector_topk_filtered", "harbor-core")):
        score = {}
        for u, r, x in rows:
            if repo in (None, r):
                score[u] = max(score.get(u, -2.0), round(float(x @ q / np.sqrt((x @ x) * (q @ q))), 6))
        want = sorted(score.items(), key=lambda k: (-k[1], k[0]))[:5]
        got = [(r.uuid, r.score) for r in found[name](spark, sf).orderBy("rank").collect()]
        assert [u for u, _ in got] == [u for u, _ in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, want))
        if repo is None:
            known = {r.uuid: r.name for r in graph.current_entities(spark.read.parquet(f"{sf}/entities.parquet")).collect()}
            hits = [(r.uuid, r.name) for r in found["hybrid_search"](spark, sf).collect()]
            assert hits == [(u, known[u]) for u, _ in want if u in known] and hits


def test_extraction_is_registered_over_all_files(spark, tmp_path):
    import datetime

    import __spark_entry__ as e
    from graphloom.parse import extract

    t = [datetime.datetime(2025, 1, k) for k in (1, 2)]
    py = "class A(B):\n    def f(self):\n        return g(self.x)\n\n\ndef g(x):\n    return x\n"
    rows = [
        (1, "r", "a.py", "python", "def old():\n    pass\n", "h0", t[0]), (1, "r", "a.py", "python", py, "h1", t[1]), (2, "q", "a.py", None, py, "h1", t[0]), (3, "r", "S.java", "java", "class S extends T { void m() { n(); } }", "h2", t[0]),
        (4, "r", "p.html", "html", '<html><body id="top" class="a b"></body></html>', "h3", t[0]), (5, "r", "x.css", "css", "#top { color: red } .a { top: 0 }", "h4", t[0]), (6, "r", "n.py", "python", None, None, t[0]), (7, "r", "b.py", "python", "  \n", "h5", t[0]),
    ]
    spark.createDataFrame(rows, "file_id long, repo_name string, path string, language string, content string, sha256 string, scanned_at timestamp_ntz").write.parquet(str(tmp_path / "files.parquet"))
    latest = [rows[1], *rows[2:6]]
    want = [x for _, repo, path, _, text_, _, _ in latest for x in extract({"py": "python", "java": "java", "html": "html", "css": "css"}[path.rsplit(".")[-1]], text_, path, repo)]
    stable = lambda r: (r["repo_name"], r["file_path"], r["name"], r["kind"], r["fqn"], r["signature"], r["start_line"], r["end_line"], r["enclosing_class"])
    got = e.queries()["extract_entities"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(stable, got))) == sorted(map(repr, map(stable, want))) and len({r["file_path"] for r in got}) == 4 and all(r.embed_text for r in got)
    found = e.queries()["extract_intents"](spark, str(tmp_path)).collect()
    plain = sorted(repr((r["repo_name"], r["file_path"], i["seq"], i["intent_type"], i["target"], i["receiver"], i["line"])) for r in want for i in r["intents"])
    assert sorted(repr((r.repo_name, r.src_file, r.seq, r.intent_type, r.target, r.receiver, r.line)) for r in found) == plain and plain


def test_lines_against_all_pairs(spark):
    rng = random.Random(11)
    ents = [(f"f{rng.randrange(3)}", f"u{k:03d}", a, rng.choice([None, a, a + rng.randrange(0, 9), a + rng.randrange(0, 700)])) for k, a in enumerate(rng.randrange(1, 900) for _ in range(90))]
    refs = [(f"f{rng.randrange(4)}", k, rng.randrange(1, 1000)) for k in range(300)]
    e = spark.createDataFrame(ents, "file string, uuid string, start_line int, end_line int")
    r = spark.createDataFrame(refs, "file string, ref_id int, line int")
    big = 1 << 30
    near, before, out = {}, {}, set()
    for f, k, n in refs:
        mine = [(u, a, big if b is None else b, b) for g, u, a, b in ents if g == f]
        if mine:
            near[k] = min(((0, b - a, a, u) if a <= n <= b else (1, n - a, a, u) if a <= n else (2, a - n, a, u)) for u, a, b, _ in mine)[3]
            before[k] = min(((0, -a, u) if a <= n else (1, a, u)) for u, a, *_ in mine)[2]
        if not any(b is not None and a <= n <= b for _, a, _, b in mine):
            out.add(k)
    assert {x.ref_id: x.uuid for x in lines.nearest_entity(r, e, ["file"]).collect()} == near
    assert {x.ref_id: x.uuid for x in lines.nearest_before(r, e, ["file"]).collect()} == before
    spans = e.where("end_line is not null").select("file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    assert {x.ref_id for x in lines.covered(r.withColumnRenamed("line", "at"), spans, ["file"]).collect()} == out
    got = {x.row_id: x.enclosing for x in lines.enclosing_class(r.withColumnRenamed("ref_id", "row_id"), e.withColumnRenamed("uuid", "name"), ["file"]).collect()}
    want = {k: min(((a, u) for g, u, a, b in ents if g == f and b is not None and a < n < b), default=(0, None))[1] for f, k, n in refs}
    assert got == want and any(want.values()) and out
