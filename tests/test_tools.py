"""Paging, tools, registered extractors and SQL functions."""

import io
import json

import pytest
from pyspark.sql import functions as F

from graphloom import parse, tools
from graphloom import query as Q
from graphloom.functions import ids, text
from graphloom.operators import extraction
from graphloom.parse.lexers import lex

ENT = "uuid string, name string, fqn string, kind string, signature string, docstring string, file_path string, start_line int, repo_name string"


@pytest.fixture(scope="module")
def hot(spark):
    """An entity with 10,001 callers."""
    e = spark.range(10_002).select(F.col("id").cast("string").alias("uuid"), F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("name"), F.lit("method").alias("kind"), F.lit("/f").alias("file_path"), F.col("id").cast("int").alias("start_line"), F.lit("r").alias("repo_name"))
    e = e.withColumn("fqn", F.col("name")).withColumns({"signature": F.lit(None).cast("string"), "docstring": F.lit(None).cast("string")})
    g = spark.range(1, 10_002).select(F.col("id").cast("string").alias("src_uuid"), F.lit("0").alias("dst_uuid"), F.when(F.col("id") < 11, "EXTENDS").otherwise("CALLS").alias("rel_type"))
    return Q.CodeIndex(e, g)


def test_long_answers_are_counted_whole(hot):
    found = Q.rows(hot.callers("hot", strict=True))
    assert (len(found), found.total, found.pages, found.groups) == (10_000, 10_001, 2, {"CALLS": 9_991, "EXTENDS": 10})
    shown = Q.callers_markdown("hot", found)
    assert "10001 in all" in shown and "## CALLS (9991)" in shown and "10000 of 10001 rows shown" in shown and "Page 1 of 2" in Q.callers_table("hot", found)
    assert len(Q.rows(hot.callers("hot", strict=True), 2)) == 1 and len(Q.rows(hot.callers("c1", strict=True))) == 0
    with pytest.raises(ValueError):
        Q.rows(hot.callers("hot"), 0)


def test_tools(hot):
    assert [t["name"] for t in tools.list_tools()] == ["search_hybrid_context", "find_callers", "explore_file"]
    assert "10001 in all" in tools.call_tool(hot, "find_callers", {"entity_name": "hot", "repo_name": None})
    for name, given in (("nothing", {}), ("find_callers", {}), ("find_callers", {"entity_name": 3}), ("search_hybrid_context", {"query": "x", "max_results": 99})):
        with pytest.raises(tools.ToolError):
            tools.call_tool(hot, name, given)
    with pytest.raises(tools.ToolError, match="dry run"):
        tools.call_tool(None, "explore_file", {"file_path": "/f"})
    said = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "explore_file", "arguments": {"file_path": "/f"}}}, {"jsonrpc": "2.0", "id": 4, "method": "zz"}]
    out = io.StringIO()
    tools.serve(None, io.StringIO("\n".join(map(json.dumps, said)) + "\n\n{"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, None] and got[2]["result"]["isError"] and "error" in got[3] and "error" in got[4]


def test_a_registered_extractor_runs_in_a_stage(spark, tmp_path):
    files = spark.createDataFrame([("r", "/a.css", "#top { color: red }"), ("r", "/b.py", "x = 1")], "repo_name string, path string, content string")
    plain = {r.name for r in extraction.extract_files(files).collect()}

    def mine(src):
        src.add("mine", "css_class", 0, 1)

    try:
        parse.register("css", mine)
        assert {r.name for r in extraction.extract_files(files).where("language = 'css'").collect()} == {"mine"}
        parse.register("css", "def extract(src):\n    raise ValueError('broken')\n")
        assert {r.name for r in extraction.extract_files(files).collect()} == plain
    finally:
        parse.register("css", None)
    (tmp_path / "css.py").write_text("def extract(src):\n    src.add('yours', 'css_class', 0, 1)\n")
    (tmp_path / "html.py").write_bytes(b"\xff")
    (tmp_path / "python.py").write_text("def extract(:")
    found = parse.from_folder(str(tmp_path))
    assert set(found) == {"css", "python"}
    got = {r.name for r in extraction.extract_files(files, found).collect()}
    assert "yours" in got and got - {"yours"} == {r.name for r in extraction.extract_files(files).where("language = 'python'").collect()}


def test_many_bounded_type_parameters():
    bounds = ", ".join(f"T{i} extends B{i}<T{i}>" for i in range(60))
    for language, path in (("java", "/A.java"), ("typescript", "/a.ts")):
        found = parse.extract(language, f"class A<{bounds}> extends Base {{ }}", path, "r")
        assert [i["target"] for e in found for i in e["intents"] if i["intent_type"] == "Extends"] == ["Base"]
    for head in ("A<T extends { x: number; y: Map<string, { z: B }> }>", "A<T = { x: C[] }, U>"):
        found = parse.extract("typescript", f"class {head} extends Base implements I {{ m() {{ if (a < b) {{ return c > d; }} }} }}", "/a.ts", "r")
        assert [(i["intent_type"], i["target"]) for e in found for i in e["intents"] if i["intent_type"] in ("Extends", "Implements")] == [("Extends", "Base"), ("Implements", "I")] and [e["name"] for e in found] == ["A", "m"]
    assert lex("java", "a < b")


def test_sql_functions(spark):
    extraction.register_sql(spark)
    got = spark.sql("SELECT uuid5_sql('r:/a:f') AS u, cosine_sim(array(1F, 0F), array(1F, 1F)) AS c, cosine_sim(array(0F), array(1F)) AS z, cosine_sim(array(1F), array(1F, 1F)) AS n, strip_comment_markers('/** A\\n * b\\n */') AS s, uuid5_sql(NULL) AS nothing").first()
    assert got.u == ids.entity_uuid("r", "/a", "f") and abs(got.c - 0.5**0.5) < 1e-7 and got.z is None and got.n is None and got.s == "A\nb" and got.nothing is None
    raw = ["/** A\n * b\n */", "// x\n///y", "", "# a 'b'\t\n\n  * c\r"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    df.createOrReplaceTempView("raw_comments")
    assert [tuple(r) for r in spark.sql("SELECT strip_comment_markers(raw) FROM raw_comments").collect()] == [tuple(r) for r in df.select(text.strip_comment_markers(F.col("raw"))).collect()]
    assert spark.sql("SELECT name FROM extract_entities('python', 'def f(): pass', '/a.py', 'r')").first().name == "f"


def _field(number, value):
    """One field of a protocol buffer: an integer, or bytes with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def _tiny_model(table):
    """An ONNX model that looks tokens up in a table: its output is the last layer of a model of no layers."""
    import numpy as np

    def value(name, kind, dims):
        shape = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d.encode())) for d in dims)
        return _field(1, name.encode()) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    weights = _field(1, table.shape[0]) + _field(1, table.shape[1]) + _field(2, 1) + _field(8, b"table") + _field(9, table.astype(np.float32).tobytes())
    node = _field(1, b"table") + _field(1, b"input_ids") + _field(2, b"last") + _field(4, b"Gather")
    graph = _field(1, node) + _field(2, b"tiny") + _field(5, weights) + _field(11, value("input_ids", 7, ["b", "s"])) + _field(11, value("attention_mask", 7, ["b", "s"])) + _field(12, value("last", 1, ["b", "s", table.shape[1]]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13))


def test_onnx_embedder(spark, tmp_path):
    """Tokens, padding, mean over real tokens and length one, with a tiny model made here."""
    pytest.importorskip("onnxruntime")
    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    from graphloom.operators import vector

    words = {"[PAD]": 0, "[UNK]": 1, "open": 2, "the": 3, "file": 4}
    table = np.random.default_rng(0).normal(size=(len(words), 8)).astype(np.float32)
    tok = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "tiny.onnx").write_bytes(_tiny_model(table))
    e = vector.OnnxEmbedder(str(tmp_path / "tiny.onnx"), str(tmp_path / "tokenizer.json"), 8)
    texts = ["open the file", "file", "open open what"]
    want = [table[[2, 3, 4]].mean(0), table[4], table[[2, 2, 1]].mean(0)]
    for got, w in zip(e.embed(texts), want):
        np.testing.assert_allclose(got, w / np.linalg.norm(w), rtol=1e-5)
    df = spark.createDataFrame([(str(i), "r", t, f"n{i}") for i, t in enumerate(texts)], "uuid string, repo_name string, embed_text string, name string")
    made = vector.OnnxEmbedder(str(tmp_path / "tiny.onnx"), str(tmp_path / "tokenizer.json"), 8)
    rows = {r.uuid: r for r in vector.embed(df, made).collect()}
    np.testing.assert_allclose(rows["0"].embedding, want[0] / np.linalg.norm(want[0]), rtol=1e-5)
    assert rows["1"].name == "n1" and vector.top_k(vector.embed(df, made), e.embed(["file"])[0], 1).first().uuid == "1"
