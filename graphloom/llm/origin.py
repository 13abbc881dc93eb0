"""Where source files come from (problem 4): handwritten, generated, minified, vendored or blob.

Each file gives evidence (logs of likelihoods per label, against handwritten) from its own text and name; the labels are then inferred by
belief propagation over the tree of directories: every directory has a hidden dominant label, files and subdirectories tend to share their
parent's, so that siblings speak for each other. Evidence is graded by how much text there is: a long file speaks for itself, one of a
few lines leaves the word to its folder. The tree has no cycles, so one pass up and one pass down are exact. Messages of a directory's
entries are summed before they are shuffled. Directories of a repository are worked off in one task where they are few (MANY), else a
level at a time over all tasks; the results are equal.

Null, empty and blank contents give no evidence of their own and count as written by hand, whatever stands beside them; null paths and
file_ids are left out; repeated deliveries count once. Building the result runs jobs: one that sums the messages per directory and, only
where a repository has more than MANY directories, two a level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.llm.common import partitions, spread
from graphloom.session import cut

LABELS = ("hand", "generated", "minified", "vendored", "blob")
#: P(a child's label = its directory's) against each other label.
SAME, OTHER = 0.80, 0.05
#: Directories of a repository, at most, that are worked off in one task.
MANY = 50_000
#: A library of known third-party files up to this many characters travels to the tasks; a longer one is joined by its shingles.
SMALL_LIBRARY = 20_000_000
WORDS = 5
#: Shares of shingles below this are as good as none.
FLOOR = 0.4
#: Tasks over which the files of one directory are spread, at most.
SALTS = 16

# Names of directories and what they say, in logs; weak, since hand-written code may live anywhere.
DIRECTORIES = {
    "generated": ("generated", "gen", "__generated__", "generated-sources", "autogen", "codegen-out"),
    "vendored": ("vendor", "_vendor", "third_party", "third-party", "thirdparty", "node_modules", "deps", "extern", "external"),
    "minified": ("dist", "public", "static", "assets", "www"),
}
DIRECTORY_SAYS = {"generated": 1.0, "vendored": 0.3, "minified": 0.5}
ROOT = (1.5, 0.0, 0.0, 0.0, 0.0)
#: How much likelier a file is handwritten than anything else before it is read, in logs; a blank one.
HAND, BLANK = 2.0, 9.0
# How often a sign is seen in the label it speaks for, and in handwritten files: lines of the commonest shape, lines alike up to numbers, and
# five-word runs known from a library.
SHAPE, TWIN, KNOWN = (0.55, 0.12), (0.40, 0.05), (0.90, 0.15)

_MARK = re.compile(
    r"@generated\b|\bauto-?generated\b|automatically (?:generated|produced|created)|code generated by|generated (?:by|on|from|with|code|file|automatically)|"
    r"do not (?:edit|modify|change)|any changes? will be (?:lost|overwritten)|machine[- ]generated|this file (?:is|was) (?:auto|generated)|"
    r"(?:werkzeug|automatisch|maschinell) (?:erzeugt|generiert)|wird überschrieben|générée? (?:par|automatiquement)|generado (?:por|automáticamente)|自动生成",
    re.I,
)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|<!--|--|\"\"\"|''')")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|0[xX][0-9a-fA-F]+|\d[\d_.eE]*|[^\W\d]\w*")
_WORD = re.compile(r"\w+")
_NAMED = re.compile(r"(?:\.min\.|[-.]min\.|\.bundle\.|\.prod\.|\.pack\.)")
_GEN_NAMED = re.compile(r"(?:\.g\.|\.generated\.|_pb2\.|\.pb\.|\.gen\.)")


def shingles(text: str) -> set[int]:
    """Hashes of all runs of five words."""
    w = _WORD.findall(text.lower())
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + WORDS])) for i in range(len(w) - WORDS + 1)}


def head_mark(text: str) -> bool:
    """Whether the comment at the very head of the file says that a tool made it."""
    head = []
    for line in text.lstrip("﻿").split("\n"):
        s = line.strip()
        if s and not _COMMENT.match(line) and not (head and head[-1] == "/*"):
            break
        if s:
            head.append("/*" if (s.startswith("/*") or (head and head[-1] == "/*")) and "*/" not in s else s)
            if _MARK.search(s):
                return True
    return False


def _weight(n: float, few: float, many: float) -> float:
    """How many independent signs n are worth: nearly none of a few, and no more than `many` however long the file."""
    return n / (1 + n / many) * n / (n + few) if n else 0.0


def _odds(share: float, n: float, rates: tuple[float, float], few: float, many: float) -> float:
    """The log of the likelihoods' ratio of seeing a sign in `share` of n places, by its rates."""
    p, q = rates
    return _weight(n, few, many) * (share * math.log(p / q) + (1 - share) * math.log((1 - p) / (1 - q)))


def _ramp(x: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (x - low) / (high - low)))


_NUMBER, _IDENT, _DIGITS = re.compile(r"\b\d\w*"), re.compile(r"\b[^\W\d]\w*"), re.compile(r"\d+")


def evidence(path: str, text: str | None, copied: float, n: int) -> tuple[float, ...]:
    """Logs of likelihoods per label from the file's name, text and the share `copied` of its n shingles that a known third-party file has."""
    e = dict.fromkeys(LABELS, 0.0)
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1]
    if not text or not text.strip():
        e["hand"] = BLANK
        return tuple(e[x] for x in LABELS)
    e["hand"] = HAND
    if _NAMED.search(name):
        e["minified"] += 1.5
    if _GEN_NAMED.search(name):
        e["generated"] += 1.0
    e["vendored"] += _odds(copied if copied >= FLOOR else 0.0, n, KNOWN, 10, 30)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    sizes = [len(x) for x in lines]
    code_chars = max(1, len("".join(text.split())))
    long_share = sum(k for k in sizes if k > 200) / sum(sizes)
    blank_share = 1 - code_chars / len(text)
    toks = _TOKEN.findall(text)
    literals = [t for t in toks if t[0] in "\"'`" or t[0].isdigit()]
    literal, literal_chars = len(literals) / max(1, len(toks)), sum(map(len, literals)) / code_chars
    sure = max(len(toks) / (len(toks) + 8), code_chars / (code_chars + 300))
    dense = _ramp(long_share, 0.45, 0.75) * _ramp(-blank_share, -0.10, -0.06) * _ramp(-literal, -0.7, -0.5)
    e["minified"] += sure * (7.0 * dense - 3.0 * (1 - dense))
    if ext in ("css", "scss", "html"):  # their lines are alike and full of values whoever wrote them
        e["blob"] -= 3.0 * sure
        shape = twin = 0.0
    else:
        data = max(_ramp(literal, 0.6, 0.78), _ramp(literal_chars, 0.65, 0.85))
        e["blob"] += sure * (9.0 * data - 3.0 * (1 - data))
        plain = _NUMBER.sub("9", "\n".join(lines))
        shapes = Counter(_IDENT.sub("a", plain).split("\n"))
        del shapes["}"], shapes[")"], shapes["*/"]
        shape = max(shapes.values(), default=0) / len(lines)
        numbers = Counter(b for a, b in zip(lines, _DIGITS.sub("9", "\n".join(lines)).split("\n")) if a != b or "9" in a)
        twin = max(numbers.values(), default=0) / len(lines)
        e["generated"] += max(_odds(shape, len(lines), SHAPE, 3, 30), _odds(twin, len(lines), TWIN, 2, 30))
    if head_mark(text):
        e["generated"] = max(0.0, e["generated"]) + 6.0
    return tuple(e[x] for x in LABELS)


def _library(library_files: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted shingles of the library and the file of each, as two flat arrays; None if the library is too long to be sent to tasks.

    Bounded: SMALL_LIBRARY characters are at most a shingle for every two of them, 12 bytes each.
    """
    size = library_files.agg(F.sum(F.length("content"))).first()[0] or 0
    if size > SMALL_LIBRARY:
        return None
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k, r in enumerate(library_files.select("content").where("content is not null").collect()):
        s = shingles(r.content)
        keys.append(np.fromiter(s, np.uint64, len(s)))
        owners.append(np.full(len(s), k, np.int32))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    o = np.argsort(keys, kind="stable")
    return keys[o], owners[o]


def _share(s: set[int], known: tuple[np.ndarray, np.ndarray]) -> float:
    """The largest share of the shingles that one file of the library has."""
    keys, owners = known
    if not s or not len(keys):
        return 0.0
    x = np.fromiter(s, np.uint64, len(s))
    lo, hi = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
    lo, hi = lo[hi > lo], hi[hi > lo]
    if not len(lo):
        return 0.0
    if int((hi - lo).max()) == 1:
        return float(np.bincount(owners[lo]).max()) / len(s)
    at = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))
    return float(np.bincount(owners[at]).max()) / len(s)


def _similarity_join(files: DataFrame, library_files: DataFrame) -> DataFrame:
    """The files with copied (the largest share of a content's shingles that one library file holds, null if below FLOOR), by shuffled joins.

    Each content is cut up once, however often it is delivered. A library file that holds FLOOR of a content's n shingles holds one of the
    n - FLOOR n + 1 that are rarest in the library: only those are joined, so that a licence text that all have brings nobody together; the
    pairs found are then counted exactly.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "s": [[x - (1 << 63) for x in shingles(t)] for t in b["content"]]})

    def pieces(df: DataFrame) -> DataFrame:
        texts = df.where("content is not null").select(F.md5("content").alias("k"), "content").dropDuplicates(["k"])
        return cut(texts.mapInPandas(cut_up, "k string, s array<long>").where(F.size("s") > 0))

    a, b = pieces(files), pieces(library_files)
    posted = b.select(F.col("k").alias("lib"), F.explode("s").alias("x"))
    common = posted.groupBy("x").agg(F.count("*").alias("df"))
    single = a.select("k", F.size("s").alias("n"), F.explode("s").alias("x")).join(common, "x", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = Window.partitionBy("k").orderBy("df", "x")
    rare = single.withColumn("r", F.row_number().over(w)).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * FLOOR) + 1) & (F.col("df") > 0))
    pairs = rare.join(posted, "x").select("k", "lib").distinct()
    both = pairs.join(a, "k").join(b.select(F.col("k").alias("lib"), F.col("s").alias("t")), "lib")
    shares = both.groupBy("k").agg(F.max(F.size(F.array_intersect("s", "t")) / F.size("s")).alias("copied")).where(F.col("copied") >= FLOOR)
    return files.withColumn("k", F.md5("content")).join(shares, "k", "left").drop("k")


def file_evidence(files: DataFrame, library_files: DataFrame) -> DataFrame:
    """file_id, repo_name, path and e, the evidence per label; one row per file_id."""
    df = files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo_name", F.lit("")).alias("repo_name"), "path", "content").where("file_id is not null and path is not null")
    library = _library(library_files)
    if library is None:
        df = _similarity_join(df, library_files)
    else:
        df = df.withColumn("copied", F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(library)
    schema = "file_id long, repo_name string, path string, e array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for file_id, repo, path, text, copied in zip(b["file_id"], b["repo_name"], b["path"], b["content"], b["copied"]):
                s = shingles(text) if text else set()
                if known is not None:
                    copied = _share(s, known)
                rows.append((file_id, repo, path, evidence(path, text, 0.0 if copied is None or math.isnan(copied) else copied, len(s))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    out = spread(df, "content", "file_id", partitions(files)).mapInPandas(run, schema)
    return out.groupBy("file_id").agg(F.max(F.struct(*out.columns)).alias("r")).select("r.*")


_K = range(len(LABELS))


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in _K]


def _with(df: DataFrame, prefix: str, values: list[Column]) -> DataFrame:
    return df.withColumns({f"{prefix}{i}": v for i, v in zip(_K, values)})


def _through(df: DataFrame, v: str, to: str) -> DataFrame:
    """The message that log-beliefs send across one edge of the tree: the edge's table has SAME on its diagonal, else OTHER.

    In Arrow batches: as JVM expressions the terms are inlined into each other and outgrow what can be compiled.
    """
    given, new = [f"{v}{i}" for i in _K], [f"{to}{i}" for i in _K]
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in new]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[given].to_numpy(dtype=float)
            p = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
            m = np.log(p.sum(axis=1, keepdims=True) * OTHER + p * (SAME - OTHER))
            yield b.assign(**{c: m[:, i] for i, c in enumerate(new)})

    return df.mapInPandas(run, schema)


def _sums(prefix: str) -> list[Column]:
    return [F.sum(f"{prefix}{i}").alias(f"{prefix}{i}") for i in _K]


def _prior(directory: Column) -> list[Column]:
    base = F.lower(F.element_at(F.split(directory, "/"), -1))
    out = []
    for x, root in zip(LABELS, ROOT):
        v = F.when(F.instr(directory, "/") == 0, F.lit(root)).otherwise(F.lit(0.0))
        if x in DIRECTORIES:
            v = v + F.when(base.isin(*DIRECTORIES[x]), F.lit(DIRECTORY_SAYS[x])).otherwise(F.lit(0.0))
        out.append(v)
    return out


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def _levels(own: DataFrame) -> DataFrame:
    """(repo_name, dir, w0..): beliefs of the directories, a level at a time up and down; `own` holds the sums of their files' messages."""
    own = own.withColumn("depth", F.size(F.split("dir", "/")))
    deepest = own.agg(F.max("depth")).first()[0]
    up: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, 0, -1):  # a path's length bounds the number of levels
        here = own.where(F.col("depth") == d).select("repo_name", "dir", *_cols("m"))
        if below is not None:
            sent = below.select("repo_name", _parent(F.col("dir")).alias("dir"), *_cols("m"))
            here = here.unionByName(sent).groupBy("repo_name", "dir").agg(*_sums("m"))
        here = _with(here, "u", [m + p for m, p in zip(_cols("m"), _prior(F.col("dir")))]).drop(*(f"m{i}" for i in _K))
        up[d] = below = cut(_through(here, "u", "m").select("repo_name", "dir", *_cols("u"), *_cols("m")))
    whole = _with(up[1], "w", _cols("u")).select("repo_name", "dir", *_cols("w"))
    every = whole
    for d in range(2, deepest + 1):
        above = whole.select("repo_name", F.col("dir").alias("up"), *_cols("w"))
        kids = up[d].withColumn("up", _parent(F.col("dir"))).join(above, ["repo_name", "up"])
        kids = _through(_with(kids, "r", [w - m for w, m in zip(_cols("w"), _cols("m"))]), "r", "d")
        whole = cut(_with(kids, "w", [u + x for u, x in zip(_cols("u"), _cols("d"))]).select("repo_name", "dir", *_cols("w")))
        every = every.unionByName(whole)
    return every


def _sent(x: np.ndarray) -> np.ndarray:
    """As _through, for rows of an array."""
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return np.log(p.sum(axis=1, keepdims=True) * OTHER + p * (SAME - OTHER))


def _tree(b: pd.DataFrame) -> pd.DataFrame:
    """As _levels, for one repository's directories."""
    at: dict[str, int] = {}
    up: list[int] = []

    def place(d: str) -> int:
        if d not in at:
            above = place(d.rsplit("/", 1)[0]) if "/" in d else -1
            at[d] = len(up)
            up.append(above)
        return at[d]

    rows = np.array([place(d) for d in b["dir"]], dtype=np.int64)
    names = list(at)  # in the order of their numbers: a parent before its children
    u = np.zeros((len(names), len(LABELS)))
    np.add.at(u, rows, b[[f"m{i}" for i in _K]].to_numpy(dtype=float))
    for i, d in enumerate(names):
        base = d.rsplit("/", 1)[-1].lower()
        if "/" not in d:
            u[i] += ROOT
        for k, x in enumerate(LABELS):
            if x in DIRECTORIES and base in DIRECTORIES[x]:
                u[i, k] += DIRECTORY_SAYS[x]
    parent = np.array(up, dtype=np.int64)
    depth = np.zeros(len(names), int)
    for i, p in enumerate(up):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    m = np.zeros_like(u)
    for d in range(int(depth.max(initial=0)), -1, -1):
        here = np.flatnonzero(depth == d)
        m[here] = _sent(u[here])
        if d:
            np.add.at(u, parent[here], m[here])
    w = u.copy()
    for d in range(1, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == d)
        w[here] = u[here] + _sent(w[parent[here]] - m[here])
    out = pd.DataFrame(w[np.unique(rows)], columns=[f"w{i}" for i in _K])
    out.insert(0, "dir", [names[i] for i in np.unique(rows)])
    out.insert(0, "repo_name", b["repo_name"].iloc[0] if len(b) else "")
    return out


def propagate(evidence_rows: DataFrame) -> DataFrame:
    """file_id and b0..b4, the file's log-beliefs, from file_id, repo_name, path and e, the evidence."""
    tidy = F.concat(F.lit("."), F.regexp_replace(F.concat(F.lit("/"), F.col("path")), "/+", "/"))
    leaves = _with(evidence_rows, "e", [F.col("e")[i] for i in _K]).withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int"))
    leaves = cut(_through(leaves.select("file_id", "repo_name", _parent(tidy).alias("dir"), "salt", *_cols("e")), "e", "m"))
    own = cut(leaves.groupBy("repo_name", "dir").agg(*_sums("m"), F.collect_set("salt").alias("salts")))
    messages = own.drop("salts")
    big = messages.groupBy("repo_name").count().where(F.col("count") > MANY).select("repo_name")
    each = "repo_name string, dir string, " + ", ".join(f"w{i} double" for i in _K)
    if big.isEmpty():
        beliefs = messages.groupBy("repo_name").applyInPandas(_tree, each)
    else:
        big = cut(big)
        beliefs = messages.join(big, "repo_name", "left_anti").groupBy("repo_name").applyInPandas(_tree, each).unionByName(_levels(messages.join(big, "repo_name", "left_semi")))
    # a directory's belief goes to as many places as its files do, so that a flat directory of very many files fills no single task
    beliefs = beliefs.join(own.select("repo_name", "dir", F.explode("salts").alias("salt")), ["repo_name", "dir"])
    at = leaves.join(beliefs, ["repo_name", "dir", "salt"])
    at = _through(_with(at, "r", [w - m for w, m in zip(_cols("w"), _cols("m"))]), "r", "d")
    return _with(at, "b", [e + x for e, x in zip(_cols("e"), _cols("d"))]).select("file_id", *_cols("b"))


def file_origins(files: DataFrame, library_files: DataFrame) -> DataFrame:
    """file_id, label and p_hand (probability that it is hand-written), one row per file."""
    p = propagate(file_evidence(files, library_files)).withColumn("top", F.greatest(*_cols("b")))
    label = F.lit(LABELS[-1])
    for i in reversed(_K[:-1]):
        label = F.when(F.col(f"b{i}") == F.col("top"), F.lit(LABELS[i])).otherwise(label)
    total = sum((F.exp(x - F.col("top")) for x in _cols("b")), F.lit(0.0))
    return p.select("file_id", label.alias("label"), F.round(F.exp(F.col("b0") - F.col("top")) / total, 6).alias("p_hand"))


def not_handwritten(files: DataFrame, library_files: DataFrame) -> DataFrame:
    """file_id of the files whose likeliest label is another than hand-written."""
    return file_origins(files, library_files).where("label <> 'hand'").select("file_id")
