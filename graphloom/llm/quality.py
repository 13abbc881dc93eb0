"""Per-document text quality (problem 8): each line is labelled prose, list, table or junk by a hidden Markov model over statistics
of the line, and the labels' shares of the text's characters are summed up per document.

A line is observed as a tuple of small factors (form, common words, length, symbols, repetition, end), independent given the label, and
written as one number. The texts are read once: their observations go to a table in the shared folder, of which the model is fitted (by
expectation maximisation, on counts of neighbouring observations of all documents) and the documents are labelled. What a line is called
depends on its neighbours: a short line among bullets is an item, the same line in a narrow column of text is prose.
Words in a run that the document has three times or more count, from the second time on, as junk and not as prose, however long the repeated block is.
Null, empty and blank texts have no lines: all counts are 0, shares null, and they are no case. Every row given yields one row.
Building the result runs two jobs: one that writes the observations, one that counts them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions
from graphloom.session import written

LABELS = ("prose", "list", "table", "junk")

# Function words by language (the share of common words is counted with them).
COMMON = {
    "en": "a an and are as at be been but by can do does for from had has have i if in is it its my no not of on only or our so that the their them then there they this to was we were what when which who will with would you your",
    "de": "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einen einem einer es für ich im in ist kein mit nach nicht noch nur oder sich sie sind so und um von war wenn wir wird wurde zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur mais ne nous on ou où par pas plus pour que qui quand sa se si son sont sur un une vous",
    "es": "al como con cuando de del el ella en es esta este ha hay la las lo los más me mi muy nadie no nos o para pero por que se si sin son su sus un una y ya",
    "it": "che di e è il non per si con sono della nel una",
    "pt": "não os em um uma para com mais ao dos foi",
    "nl": "het een van niet dat zijn op te voor met",
}
_COMMON = frozenset(w for v in COMMON.values() for w in v.split())
_HAN = frozenset("的了在是我们不有这个就和也还没只才会如果但请它先再被把到时上下中里对从后前为什么")
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{M}]+(?:['’][\p{L}]+)*|\p{N}+")
_BULLET = re.compile(r"\s*(?:[-*+•‣▪◦–·]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+|\[[ xX]?\]\s*|[☐☑✓✗✔]\s*)")
_COUNTED = re.compile(r"\s*[\w.\- ]{1,40}\(\d+\)\s*$")
_NAME = re.compile(r"\s*[\w$]+(?:(?:\.|::|/|->)[\w$]+)+(?:\(\))?[,;]?\s*$")
_GRID = re.compile(r"[│┃┌┐└┘├┤┬┴┼─━═║╔╗╚╝]|^\s*[-=+|: ]{4,}$")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\]?\b|at [\w.$<>]+\(|File \"|Traceback|Caused by:|\$ |>>> |@@ |[+-]{3} |\w+ +\d+ \d\d:\d\d:\d\d)")
_CODE = re.compile(r"(?:[;{}]|\)\s*[:{]|=>|\\)\s*$|^\s*(?:def|class|import|from|return|if|for|while|const|let|var|fn|fun|func|public|private|static|#include|package|use|SELECT|INSERT|else|try|except|catch)\b.*[(){};:=]|[\w\])]\s*(?:[+\-*/|&]?=|==|!=|:=|->|::)\s*[\w\[({\"'].*[(;\"'{]|^\s*[\w.]+\([^)]*\)\s*;?$|</?\w+[^>]*>|^\s*[\w.]+(?:\[[^\]]*\])? [+\-*/|]?= \S|^\s*@\w+(?:\([^)]*\))?$|^\s*(?:return|raise|yield|break|continue|pass|import)\b(?: [\w.]+)?$|^\s*from [\w.]+ import\b|^\s*(?:try|else|finally):$")
_QUOTED = re.compile(r"^(?:>\s?)+")
#: What is no letter, digit, blank or plain punctuation.
_ODD = re.compile(r"[^\w\s,.!?'’\-()。，！？、：；“”\"`]|_")
_HAS_DIGIT = regex.compile(r"[\d\p{No}]")
_GAPS = re.compile(r"\S {3,}\S")
_SENT = regex.compile(r"(?<=[.!?。！？])\s*")
_STOP = tuple(".!?。！？…")
_END = tuple(".!?。！？…:;\"”»)’'")

# The model before it is fitted. Rows are the values of a factor, columns the labels.
PRIOR = {
    "form": {
        "plain": (0.80, 0.15, 0.08, 0.36),
        "bullet": (0.06, 0.62, 0.01, 0.01),
        "item": (0.01, 0.15, 0.04, 0.03),
        "grid": (0.01, 0.02, 0.80, 0.10),
        "code": (0.006, 0.02, 0.03, 0.45),
        "head": (0.10, 0.04, 0.04, 0.05),
    },
    "common": {"void": (0.004, 0.10, 0.20, 0.20), "none": (0.076, 0.62, 0.60, 0.55), "few": (0.12, 0.16, 0.15, 0.17), "many": (0.60, 0.09, 0.03, 0.05), "other": (0.20, 0.03, 0.02, 0.03)},
    "words": {"1-3": (0.10, 0.60, 0.30, 0.30), "4-7": (0.20, 0.28, 0.30, 0.27), "8+": (0.70, 0.12, 0.40, 0.43)},
    "symbols": {"low": (0.88, 0.62, 0.12, 0.22), "mid": (0.11, 0.33, 0.38, 0.33), "high": (0.01, 0.05, 0.50, 0.45)},
    "again": {"new": (0.9845, 0.92, 0.92, 0.60), "again": (0.015, 0.06, 0.06, 0.20), "few": (0.0005, 0.02, 0.02, 0.20)},
    "end": {"stop": (0.62, 0.14, 0.10, 0.18), "open": (0.38, 0.86, 0.90, 0.82)},
}
STAY = 0.76
#: Words in a row that count as a repetition if they stand in a document at least so many times.
RUN, TIMES = 8, 3
#: Different words, at most, of a text that says the same few over and over.
FEW = 12
#: What the model before fitting weighs against all lines of the corpus.
TRUST = 0.2
START = (0.55, 0.15, 0.15, 0.15)
_FACTORS = tuple(PRIOR)


def repeated(words: list[str]) -> np.ndarray:
    """Whether each word stands in a run of RUN words that the document has TIMES times or more; the first time does not count."""
    out = np.zeros(len(words), bool)
    runs = list(map(hash, zip(*(words[i:] for i in range(RUN)))))
    if len(runs) < TIMES or len(set(runs)) > len(runs) - (TIMES - 1):
        return out
    many = {x for x, n in Counter(runs).items() if n >= TIMES}
    seen = set()
    for i, x in enumerate(runs):
        if x in many:
            if x in seen:
                out[i : i + RUN] = True
            seen.add(x)
    return out


def observe(text: str) -> tuple[list[tuple], list[int], dict, np.ndarray]:
    """The lines' observations, their weights (characters that are no white space), the document's counts, and the share of each line's words that are repeated."""
    out: list[tuple] = []
    weights: list[int] = []
    words_all: list[str] = []
    n_common = ended = fence = 0
    coded = False
    symbols = chars = 0
    before: set[str] = set()
    ends: list[int] = []
    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        body = _QUOTED.sub("", s) if s[0] == ">" else s
        ws = _WORD.findall(body)
        low = [w.lower() for w in ws]
        han = 0 if body.isascii() else sum(1 for w in ws if len(w) == 1 and "\u4e00" <= w <= "\u9fff")
        common = sum(1 for w in low if w in _COMMON or w in _HAN or (("'" in w or "’" in w) and re.split("['’]", w)[-1] in _COMMON))
        pieces = body.split()
        n_chars = sum(map(len, pieces))
        n_odd = len(_ODD.findall(body))
        odd = n_odd / max(1, len(body))
        digits = sum(map(str.isdigit, body)) / max(1, len(body)) if _HAS_DIGIT.search(body) else 0.0
        longest = max(map(len, pieces), default=0)
        if s.startswith(("```", "~~~")):
            fence = 1 - fence
            form = "code"
        elif coded and (s.count('"""') == 1 or s.count("'''") == 1):
            fence = 1 - fence
            form = "code"
        elif fence or (longest > 60 and longest > 0.5 * len(body) and not han and longest / max(1, sum(map(str.isalpha, body))) < 3 and odd < 0.2):
            form = "code"
        elif body.count("|") >= 2 or body.count("\t") >= 2 or _GRID.search(body) or ("   " in body and len(_GAPS.findall(body)) >= 2) or (body.count(",") >= 3 and ", " not in body) or body.count(";") >= 2 and body.count("=") >= 2:
            form = "grid"
        elif _BULLET.match(body):
            form = "bullet"
        elif _LOG.match(body) or _CODE.search(body):
            form = "code"
            coded = True
        elif _COUNTED.match(body) or _NAME.match(body) or (len(ws) >= 6 and body.count(",") + body.count(" | ") + body.count(" · ") >= 0.28 * len(ws) and common < 0.1 * len(ws)):
            form = "item"
        elif body.startswith("#"):
            form = "head"
        else:
            form = "plain"
        share = common / max(1, len(ws))
        if share < 0.04:
            other = 0 if body.isascii() else sum(1 for c in body if c.isalpha() and ord(c) > 0x24F and not "\u4e00" <= c <= "\u9fff")
            kind = "other" if other and other > 0.6 * sum(map(str.isalpha, body)) and odd < 0.1 else "void" if share < 0.03 and len(ws) >= 10 and not han else "none"
        else:
            kind = "few" if share < 0.16 else "many"
        if han > 0.3 * len(ws) and kind == "none" and len(ws) > 8:
            kind = "few"
        sents = [x for x in _SENT.split(body) if x]
        same = 0
        for x in sents:
            same += x in before
            before.add(x)
        n = len(ws) - (han * 2) // 3
        sym = odd + max(0.0, digits - 0.05) + (0.3 if ws and max(map(len, ws)) > max(45, 0.5 * n_chars) else 0.0)
        out.append((form, kind, "1-3" if n <= 3 else "4-7" if n <= 7 else "8+", "low" if sym < 0.06 else "mid" if sym < 0.16 else "high", "again" if same * 2 > len(sents) else "new", "stop" if s.endswith(_END if form != "code" else _STOP) else "open"))
        weights.append(n_chars)
        words_all += low
        ends.append(len(words_all))
        n_common += common
        ended += s.endswith(_END)
        symbols += n_odd
        chars += n_chars
    types = len(set(words_all))
    if len(words_all) >= 30 and types <= FEW:
        out = [x[:4] + ("few",) + x[5:] for x in out]  # the same few words over and over
    total = len(words_all)
    stats = {
        "n_words": total,
        "n_lines": len(out),
        "mean_word_length": round(sum(map(len, words_all)) / total, 6) if total else None,
        "symbol_ratio": round(symbols / chars, 6) if chars else None,
        "ended_share": round(ended / len(out), 6) if out else None,
        "common_share": round(n_common / total, 6) if total else None,
    }
    done = np.r_[0, np.cumsum(repeated(words_all))][[0, *ends]]
    return out, weights, stats, np.diff(done) / np.maximum(1, np.diff([0, *ends]))


# Observations as numbers: mixed radix over the factors' values.
_VALUES = [{v: i for i, v in enumerate(PRIOR[f])} for f in _FACTORS]
_RADIX = [len(v) for v in _VALUES]
N_CODES = math.prod(_RADIX)


def encode(lines: list[tuple]) -> list[int]:
    out = []
    for line in lines:
        c = 0
        for v, values, r in zip(line, _VALUES, _RADIX):
            c = c * r + values[v]
        out.append(c)
    return out


def _digits(codes: np.ndarray) -> list[np.ndarray]:
    out = []
    for r in reversed(_RADIX):
        out.insert(0, codes % r)
        codes = codes // r
    return out


_EVERY = _digits(np.arange(N_CODES))


class Model:
    """Start, transition and emission probabilities of the hidden Markov model; `like` has a row for each observation."""

    def __init__(self, start: np.ndarray | None = None, trans: np.ndarray | None = None, emit: list[np.ndarray] | None = None):
        k = len(LABELS)
        if trans is None:
            trans = np.full((k, k), (1 - STAY) / (k - 1))
            np.fill_diagonal(trans, STAY)
        self.start = np.array(START) if start is None else start
        self.trans = trans
        self.emit = [np.array(list(PRIOR[f].values())) for f in _FACTORS] if emit is None else emit
        self.like = np.ones((N_CODES, k))
        for e, at in zip(self.emit, _EVERY):
            self.like *= e[at]

    def alone(self) -> Model:
        """The same without a chain: every line by itself (for comparison)."""
        return Model(self.start, np.tile(self.start, (len(LABELS), 1)), self.emit)

    def posteriors(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """P(label | all lines) of each line of each text, by the forward and backward recursions over all texts at once."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        begin = np.r_[0, np.cumsum(size)]
        flat = self.like[np.concatenate([np.asarray(texts[i], dtype=np.int64) for i in order]) if len(texts) else np.zeros(0, int)]
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max(initial=0)))]  # texts longer than t lines come first
        alpha, beta = np.empty_like(flat), np.ones_like(flat)
        for t, n in enumerate(live):
            at = begin[:n] + t
            a = (self.start if t == 0 else alpha[at - 1] @ self.trans) * flat[at]
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(len(live) - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            b = (flat[at + 1] * beta[at + 1]) @ self.trans.T
            beta[at] = b / b.sum(axis=1, keepdims=True)
        g = alpha * beta
        g /= g.sum(axis=1, keepdims=True)
        out: list = [None] * len(texts)
        for j, i in enumerate(order):
            out[i] = g[begin[j] : begin[j + 1]]
        return out

    def fitted(self, first: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = 6, trust: float = TRUST) -> Model:
        """The model after expectation maximisation on how often each observation begins a text (`first`) and each pair (x, y, times) of
        neighbouring lines is seen; the start before it weighs `trust` times as much as all of them."""
        x, y, n = pairs
        total = n.sum() + first.sum()
        if not total:
            return self
        model = self
        k = len(LABELS)
        for _ in range(rounds):
            trans = self.trans * trust * total / k
            seen = np.zeros((N_CODES, k))
            p = model.start * model.like
            p *= (first / p.sum(axis=1))[:, None]
            seen += p
            start = self.start * trust * max(1.0, first.sum()) + p.sum(axis=0)
            for i in range(0, len(x), 50_000):
                part = slice(i, i + 50_000)
                joint = (model.start * model.like[x[part]])[:, :, None] * model.trans * model.like[y[part]][:, None, :]
                joint *= (n[part] / joint.sum(axis=(1, 2)))[:, None, None]
                trans = trans + joint.sum(axis=0)
                np.add.at(seen, y[part], joint.sum(axis=1))
            emit = []
            for prior, at, r in zip(self.emit, _EVERY, _RADIX):
                e = prior * trust * total / k
                np.add.at(e, at, seen)
                emit.append(e / e.sum(axis=0))
            model = Model(start / start.sum(), trans / trans.sum(axis=1, keepdims=True), emit)
        return model


def shares(codes: list[np.ndarray], weights: list[np.ndarray], again: list[np.ndarray], model: Model) -> np.ndarray:
    """Per text the labels' shares of its characters, of which `again` of each line are repeated; a text without lines has none."""
    out = np.full((len(codes), len(LABELS)), np.nan)
    for i, (p, w, r) in enumerate(zip(model.posteriors(codes), weights, again)):
        if len(w):
            labels = p.copy()
            labels[:, -1] += r * p[:, 0]
            labels[:, 0] *= 1 - r
            w = np.asarray(w, dtype=float) + 1e-9
            out[i] = (labels * (w / w.sum())[:, None]).sum(axis=0)
    return np.round(out, 6)


def measure(text: str | None, model: Model) -> dict:
    """The statistics and the labels' shares of one text."""
    lines, weights, stats, again = observe(text or "")
    s = shares([np.array(encode(lines), dtype=np.int64)], [np.array(weights)], [again], model)[0]
    return stats | {f"{x}_share": float(v) if lines else None for x, v in zip(LABELS, s)}


SCHEMA = "doc_id long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, ended_share double, common_share double, prose_share double, list_share double, table_share double, junk_share double"
_COLS = [c.split()[0] for c in SCHEMA.split(", ")]


_STATS = SCHEMA.split(", prose_share")[0]
_SEEN = _STATS + ", codes array<int>, weights array<int>, again array<float>"


def observations(documents: DataFrame) -> DataFrame:
    """One row per document: its statistics and, per line that is not blank, observation, characters and repeated share; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                lines, weights, stats, again = observe(t or "")
                rows.append(stats | {"codes": encode(lines), "weights": weights, "again": again.astype(np.float32)})
            out = pd.DataFrame(rows, columns=[*_COLS[1:7], "codes", "weights", "again"], index=b.index)
            out.insert(0, "doc_id", b["doc_id"])
            for c in _COLS[3:7]:
                out[c] = out[c].astype(float)
            yield out

    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(df.repartition(partitions(documents), F.xxhash64("doc_id")).mapInPandas(run, _SEEN), "observations")


def fit(seen: DataFrame) -> Model:
    """The model fitted on all lines of all documents.

    Only counts reach the driver, one for each pair of the N_CODES observations that occurs: at most N_CODES * (N_CODES + 1), about a million.
    """
    before = F.concat(F.array(F.lit(N_CODES)), F.slice("codes", F.lit(1), F.size("codes") - 1))
    both = seen.where(F.size("codes") > 0).select(F.explode(F.zip_with(before, F.col("codes"), lambda x, y: x * F.lit(N_CODES) + y)).alias("c"))
    got = both.groupBy("c").count().toPandas().sort_values("c")
    c, n = got["c"].to_numpy(dtype=np.int64), got["count"].to_numpy(dtype=float)
    x, y = c // N_CODES, c % N_CODES
    begins = x == N_CODES
    first = np.bincount(y[begins], weights=n[begins], minlength=N_CODES) if begins.any() else np.zeros(N_CODES)
    return Model().fitted(first, (x[~begins], y[~begins], n[~begins]))


def text_quality(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row of statistics and label shares per document (see SCHEMA); without a model one is fitted on these documents."""
    seen = observations(documents)
    model = model or fit(seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shares([np.asarray(x, dtype=np.int64) for x in b["codes"]], list(b["weights"]), [np.asarray(x, dtype=float) for x in b["again"]], model)
            yield b[_COLS[:7]].assign(**{f"{x}_share": s[:, i] for i, x in enumerate(LABELS)})

    out = seen.mapInPandas(run, SCHEMA)
    return out.withColumns({f"{x}_share": F.when(F.col("n_lines") > 0, F.col(f"{x}_share")) for x in LABELS})


def not_prose(documents: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """doc_id of the documents of whose characters less than `least` stand in lines of prose."""
    return text_quality(documents, model).where((F.col("n_lines") > 0) & (F.col("prose_share") < least)).select("doc_id").distinct()
