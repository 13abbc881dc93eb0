"""Problem 2 on small tables, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.operators import orphans as O

T0 = dt.datetime(2025, 1, 1)
E = "uuid string, fqn string, repo_name string, file_path string, indexed_at timestamp_ntz"
FI = "path string, repo_name string, scanned_at timestamp_ntz, content string"
R = "repo_name string, file_path string, removed_at timestamp_ntz"
I = "intent_id long, repo_name string, src_file string, src_enclosing_class string, intent_type string, target string, receiver string, recorded_at timestamp_ntz"
G = "edge_id long, src_uuid string, dst_uuid string, resolved_at timestamp_ntz, salt string, space string"
X = "name string"


def at(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def run(spark, ents=(), files=(), rem=(), ints=(), edges=(), ext=()):
    d = [spark.createDataFrame(list(rows), schema) for rows, schema in ((ints, I), (edges, G), (ents, E), (files, FI), (rem, R), (ext, X))]
    return {(r.ref_table, r.ref_id) for r in O.orphans(*d).collect()}


def test_liveness_bounds(spark):
    ents = [("u1", "f", "r", "p", at(1)), ("u1", "f", "r", "p", at(10)), ("u2", "g", "r", "q", at(5))]
    rem = [("r", "p", at(4)), ("r", "p", at(4)), ("r", "q", at(5)), ("r", "never", at(1))]
    ints = [(k, "r", "a.py", None, "Call", t, None, at(h)) for k, (t, h) in enumerate([("f", 0), ("f", 1), ("f", 3), ("f", 4), ("f", 9), ("f", 10), (" f ", 99), ("g", 5), (None, 5), ("f", None)])]
    assert run(spark, ents, rem=rem, ints=ints) == {("intents", k) for k in (0, 3, 4, 7)}


def test_keys(spark):
    ents = [("u", n, "r", "p", at(0)) for n in ("#id", ".cls", "mac!", "C.m", "Recv.m", "S::m")]
    files = [("/x.js", "r", at(0), None)]
    ints = [
        (1, "r", "a.js", None, "DomElementReference", "id", None, at(1)), (2, "r", "a.js", None, "CssClassUsage", "cls", None, at(1)), (3, "r", "a.rs", None, "RustMacroCall", "mac", None, at(1)), (4, "r", "a.py", "C", "Call", "m", "self", at(1)),
        (5, "r", "a.py", None, "Call", "m", "Recv", at(1)), (6, "r", "a.rs", "S", "Call", "m", "self", at(1)), (7, "r", "a.html", None, "HtmlFileImport", "/x.js", None, at(1)), (8, "r", "a.html", None, "CssFileImport", "/y.css", None, at(1)),
        (9, "other", "a.py", None, "Call", "m", "Recv", at(1)), (10, "r", "a.py", None, "Call", "known", None, at(1)), (10, "r", "a.py", None, "Call", "known", None, at(1)), (11, "r", "a.py", None, "Call", "gone", None, at(1)),
    ]
    assert run(spark, ents, files, ints=ints, ext=[("known",), (None,)]) == {("intents", 8), ("intents", 9), ("intents", 11)}


def test_edges_and_empty(spark):
    ents = [("AB", "f", "r", "p", at(0)), (None, "g", None, None, None)]
    edges = [(1, " ab ", "ab", at(1), "x", "y"), (2, "ab", "zz", at(1), None, None), (3, None, "ab", at(1), "", ""), (4, None, None, at(1), "", ""), (2, "ab", "zz", at(1), None, None)]
    assert run(spark, ents, edges=edges) == {("edges", 2)}
    assert run(spark) == set()


def test_brute_force_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(O, "BUCKETS", 64)
    monkeypatch.setattr(O, "hot_buckets", lambda df, keys, share=0: list(range(0, O.BUCKETS, 2)))  # every other bucket is hot
    ents = [(f"u{rng.randrange(5)}", rng.choice(["hot", "a", "b"]), "r", f"p{rng.randrange(4)}", at(rng.randrange(50))) for _ in range(60)]
    rem = [("r", f"p{rng.randrange(4)}", at(rng.randrange(50))) for _ in range(15)]
    ints = [(k, "r", "a.py", None, "Call", rng.choice(["hot", "hot", "a", "b", "c"]), None, at(rng.randrange(55))) for k in range(200)]

    def live(fqn, t):
        for _, f, _, p, s in ents:
            stop = min((x for _, q, x in rem if q == p and x >= s), default=None)
            if f == fqn and s <= t and (stop is None or t < stop):
                return True
        return False

    assert run(spark, ents, rem=rem, ints=ints) == {("intents", i[0]) for i in ints if not live(i[5], i[7])}


def test_sweep_gives_the_run_before(spark):
    marks = spark.createDataFrame([("k", 1, 5), ("k", 5, 8), ("k", 10, 12), ("k", 2, 3), ("j", 4, 6)], "key string, t long, end long")
    points = spark.createDataFrame([("k", 0, 0), ("k", 4, 1), ("k", 8, 2), ("k", 10, 3), ("k", 99, 4), ("i", 4, 5), ("j", 4, 6)], "key string, t long, end_ long")
    got = {r.end_: (r.run_start, r.run_end) for r in O.sweep(points, marks, ["key"]).collect()}
    assert got == {0: (None, None), 1: (1, 5), 2: (1, 8), 3: (10, 12), 4: (10, 12), 5: (None, None), 6: (4, 6)}


def test_hot_key_with_disjoint_intervals_is_cut_by_time(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(O, "BUCKETS", 64)
    monkeypatch.setattr(O, "hot_buckets", lambda df, keys, share=0: list(range(O.BUCKETS)))
    spans = [(10 * i, 10 * i + rng.randrange(1, 9)) for i in range(400)] + [(5, 900), (2000, 2400)]
    marks = spark.createDataFrame([("k", a, b) for a, b in spans] + [("j", 0, 1)], "key string, t long, end long")
    times = [rng.randrange(-5, 4100) for _ in range(300)] + [777] * 500  # one instant holds more than half of the points
    points = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)] + [("j", 50, 9999)], "key string, t long, ref long")
    row = "struct<ref:long>"
    p, m = O._sliced(points.select("key", "t", F.lit(None).cast("long").alias("end"), F.struct("ref").cast(row).alias("row")), marks.withColumn("row", F.lit(None).cast(row)), ["key"], list(range(O.BUCKETS)))
    assert p.select("slice").distinct().count() > 20 and p.where("t = 777").select("salt").distinct().count() > 10 and m.where("key = 'k'").groupBy("slice", "salt").count().agg(F.max("count")).first()[0] < 60
    got = {r.ref: r for r in O.sweep(points, marks, ["key"]).collect()}
    assert len(got) == 801 and got[9999].run_end == 1
    for i, t in enumerate(times):
        assert got[i].run_end == max((b for a, b in spans if a <= t), default=None) and (got[i].run_start is None) == (t < 0)


def test_report(spark):
    found = spark.createDataFrame([("edges", 1, 1735689600000000), ("edges", 2, 1735689600000001)], "ref_table string, ref_id long, at long")
    assert [tuple(r) for r in O.orphan_report(found).collect()] == [("edges", "2025-01", 2)]
    assert O.orphan_report(found.where(F.lit(False))).count() == 0
