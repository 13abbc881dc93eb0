"""The most similar vectors of every vector (problem 5): hierarchical navigable small-world graphs, one per shard, results merged.

Shards are groups of neighbouring Voronoi cells in a projection. Cells come in two levels: the centroids of the first are fitted on a
bounded sample (SAMPLE), those of the second per first cell, in the cluster, each on a bounded sample of its own (CELL_SAMPLE), so that
their number grows with the rows and a shard keeps its size. Every usable vector is indexed, in one shard. A vector near a border asks up
to ASK neighbouring shards too. Graphs are flat arrays of neighbours per layer, built and walked in batches of numpy operations; the
candidates found are ranked by the exact cosine in double precision, rounded to six decimals, the smaller uuid first among equals, and a
row is a candidate of each of its own candidates.

Usable are vectors of DIM finite numbers that are not all zero; of several for one uuid the smallest in bytes counts. Null uuids are left
out. Vectors of one direction, as nearly as six decimals tell, are one node of a graph that stands for all their uuids. A row of which the
candidates cannot settle the ten, as more may tie with the tenth or as a node's members may round differently, is compared with its whole
shard. Of a direction that fills a large part of a shard only the smallest uuids are indexed; the others have the same neighbours and get
them by a join. A shard that is too full all the same is split at random, its vectors then asking every part. Fewer than two usable
vectors give no pairs. Building the result runs jobs: a count, the two fits and the search, whose result is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

DIM, TOP = 384, 10
#: Rows of the first fitted sample, at most; dimensions of the projection for cells; members of a shard, at most, by the sample's counts.
SAMPLE, LOW, MOST = 12_000, 64, 16_000
#: Cells for each shard's worth of rows, and sampled rows that a cell needs at least.
CELLS, ROWS_A_CELL = 24, 40
#: Cells of the first level, at most, where one level is not enough; cells of the second level for each shard's worth of rows; rows of the
#: sample on which those of one first cell are fitted, at most. So there are never more than 256 * 1,000 centroids.
FIRST, LEAVES, CELL_SAMPLE = 256, 4, 40_000
#: Other shards that a vector asks, at most; one is asked if its nearest centroid is at most so many times as far as the nearest of all.
ASK, SPILL = 2, 1.12
#: Members that a direction needs for only its smallest uuids to be indexed.
HOT = 4_000
#: Links of a node (twice as many in the lowest layer), the beam while building and while asking, candidates ranked exactly.
LINKS, BEAM_BUILD, BEAM, RANKED = 20, 32, 32, 24
BATCH = 512
#: Directions at most so far apart (their cosine then rounds to 1) are one node; rounds of looking for them, and the width of a cell.
NEAR, NEAR_ROUNDS, NEAR_CELL = 1e-3, 4, 2e-2


class Hnsw:
    """Layers of a small-world graph over the rows of x; the similarity is the inner product."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BEAM_BUILD, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")  # the uppermost layers' nodes come first
        self.x = self.x[self.order]
        counts = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers: list[tuple[np.ndarray, np.ndarray]] = [None] * len(counts)
        for k in range(len(counts) - 1, -1, -1):
            width = links * (2 if k == 0 else 1)
            self.layers[k] = (np.full((counts[k], width), -1, np.int32), np.full((counts[k], width), -np.inf, np.float32))
            at = counts[k + 1] if k + 1 < len(counts) else 0
            first = min(counts[k], max(at, 256))
            self._link(k, np.arange(first), None, None)
            at = first
            while at < counts[k]:
                new = np.arange(at, min(counts[k], at + min(BATCH, max(64, at))))
                ids, sims = self._walk(k, self.x[new], self._entries(self.x[new], k), beam, at)
                self._link(k, new, ids, sims)
                at = int(new[-1]) + 1

    def _link(self, k: int, new: np.ndarray, ids: np.ndarray | None, sims: np.ndarray | None) -> None:
        """Links the nodes `new` to the best of what they found and of each other, both ways."""
        nbr, sim = self.layers[k]
        width = nbr.shape[1]
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -np.inf)
        keep = min(width, own.shape[1])
        part = np.argpartition(-own, keep - 1, axis=1)[:, :keep]
        cand_i = new[part].astype(np.int32)
        cand_s = np.take_along_axis(own, part, axis=1)
        cand_i[~np.isfinite(cand_s)] = -1
        if ids is not None:
            cand_i, cand_s = np.concatenate([cand_i, ids], axis=1), np.concatenate([cand_s, sims], axis=1)
        if cand_i.shape[1] > width:
            best = np.argpartition(-cand_s, width - 1, axis=1)[:, :width]
            cand_i, cand_s = np.take_along_axis(cand_i, best, axis=1), np.take_along_axis(cand_s, best, axis=1)
        nbr[new, : cand_i.shape[1]], sim[new, : cand_s.shape[1]] = cand_i, cand_s
        to, back, s = cand_i.ravel(), np.repeat(new, cand_i.shape[1]), cand_s.ravel()
        lo = new[0]
        ok = (to >= 0) & (to < lo) if ids is not None else to >= 0
        to, back, s = to[ok], back[ok], s[ok]
        if not len(to):
            return
        o = np.lexsort((-s, to))
        to, back, s = to[o], back[o], s[o]
        begin = np.r_[0, np.flatnonzero(np.diff(to)) + 1]
        rank = np.arange(len(to)) - np.repeat(begin, np.diff(np.r_[begin, len(to)]))
        ok = rank < width
        rows = to[begin]
        row = np.searchsorted(rows, to[ok])
        inc_i, inc_s = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), -np.inf, np.float32)
        inc_i[row, rank[ok]], inc_s[row, rank[ok]] = back[ok], s[ok]
        if ids is None:  # both ends chose among the same nodes: a link may be there already
            there = (inc_i[:, :, None] == nbr[rows][:, None, :]).any(axis=2)
            inc_i[there], inc_s[there] = -1, -np.inf
        all_i, all_s = np.concatenate([nbr[rows], inc_i], axis=1), np.concatenate([sim[rows], inc_s], axis=1)
        best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        nbr[rows], sim[rows] = np.take_along_axis(all_i, best, axis=1), np.take_along_axis(all_s, best, axis=1)

    def _entries(self, q: np.ndarray, below: int, many: int = 8) -> np.ndarray:
        """Good nodes of the layer above `below` to begin at, found from the top down."""
        top = len(self.layers) - 1
        if below >= top:
            return np.zeros((len(q), 1), np.int32)
        at = np.zeros((len(q), 1), np.int32)
        for k in range(top, below, -1):
            size = len(self.layers[k][0])
            if size <= 2048:  # few nodes: the beam holds them all
                s = q @ self.x[:size].T
                keep = min(many, size)
                at = np.argpartition(-s, keep - 1, axis=1)[:, :keep].astype(np.int32)
            else:
                at = self._walk(k, q, at, 16, size)[0][:, :many]
                at = np.where(at < 0, at[:, :1], at)
        return at

    def _walk(self, k: int, q: np.ndarray, entry: np.ndarray, beam: int, size: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes below `size` of layer k that beams of the given width find, best first."""
        nbr = self.layers[k][0]
        n = len(q)
        seen = np.zeros((n, size), bool)
        ids, sims = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        e = min(entry.shape[1], beam)
        ids[:, :e] = entry[:, :e]
        s = np.matmul(self.x[np.maximum(entry[:, :e], 0)], q[:, :, None])[:, :, 0]
        sims[:, :e] = np.where(entry[:, :e] >= 0, s, -np.inf)
        done[:, :e] = entry[:, :e] < 0
        seen[np.repeat(np.arange(n), e), np.maximum(entry[:, :e], 0).ravel()] = True
        live = np.arange(n)
        while len(live):
            li, ls, ld = ids[live], sims[live], done[live]
            open_s = np.where(ld, -np.inf, ls)
            pick = np.argpartition(-open_s, wide - 1, axis=1)[:, :wide]
            good = np.isfinite(np.take_along_axis(open_s, pick, axis=1))
            np.put_along_axis(ld, pick, True, axis=1)
            nodes = np.where(good, np.take_along_axis(li, pick, axis=1), 0)
            new = nbr[nodes]
            new[~good] = -1
            new = np.sort(new.reshape(len(live), -1), axis=1)
            ok = new >= 0
            ok[:, 1:] &= new[:, 1:] != new[:, :-1]
            ok &= ~seen[live[:, None], np.maximum(new, 0)]
            b, c = np.nonzero(ok)
            found = new[b, c]
            seen[live[b], found] = True
            at = np.full(new.shape, -np.inf, np.float32)
            v = np.empty(len(found), np.float32)
            ends = np.r_[0, np.cumsum(ok.sum(axis=1))]
            for i, r in enumerate(live):  # one product per query: its new nodes by itself
                lo, hi = ends[i], ends[i + 1]
                if hi > lo:
                    np.dot(self.x.take(found[lo:hi], axis=0), q[r], out=v[lo:hi])
            at[b, c] = v
            all_i, all_s = np.concatenate([li, new], axis=1), np.concatenate([ls, at], axis=1)
            all_d = np.concatenate([ld, ~ok], axis=1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(v, best, axis=1) for v in (all_i, all_s, all_d))
            more = (~done[live] & np.isfinite(sims[live])).any(axis=1)
            live = live[more]
        o = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, o, axis=1), np.take_along_axis(sims, o, axis=1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def ask(self, q: np.ndarray, member: np.ndarray | None = None, beam: int = BEAM) -> np.ndarray:
        """The nearest nodes (rows of the x given, -1 for none) of each q; `member` holds the node that q itself is, -1 for none."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        out = np.full((len(q), beam), -1, np.int64)
        nbr = self.layers[0][0]
        for at in range(0, len(q), BATCH):
            part = slice(at, min(len(q), at + BATCH))
            x = np.ascontiguousarray(q[part], dtype=np.float32)
            here = np.full(len(x), -1) if member is None else member[part]
            entry = np.full((len(x), 16), -1, np.int32)
            known = here >= 0
            if known.any():  # a node's own links are where its walk begins
                p = place[here[known]]
                entry[known, 0] = p
                entry[known, 1:8] = nbr[p][:, :7]
            e = self._entries(x, 0)
            entry[:, 8 : 8 + e.shape[1]] = e
            ids, _ = self._walk(0, x, entry, beam, len(self.x))
            out[part] = np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1)
        return out


def unpack(packed, dim: int = DIM) -> np.ndarray:
    """Vectors from their bytes: float16 where that lost nothing, else float32."""
    out = np.empty((len(packed), dim), np.float32)
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, np.float16 if len(b) == 2 * dim else np.float32)
    return out


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """uuid and v, the packed vector, of every row with a usable one."""
    rows = vectors.select("uuid", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("uuid").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[ok])
            with np.errstate(over="ignore"):
                half = x.astype(np.float16)
            fits = (half.astype(np.float32) == x).all(axis=1)
            packed = [half[i].tobytes() if fits[i] else x[i].tobytes() for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(packed, pa.binary())], names=["uuid", "v"])

    return rows.mapInArrow(run, "uuid string, v binary")


def _conflicts(vectors: DataFrame) -> bool:
    """Whether some uuid comes with different vectors."""
    h = vectors.select("uuid", F.xxhash64("embedding").alias("h")).where("uuid is not null")
    return not h.groupBy("uuid").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty()


class Cells:
    """Where a vector belongs: a projection, first centroids, and per first cell its centroids with their shards."""

    def __init__(self, basis: np.ndarray, top: np.ndarray, leaves: list[np.ndarray], shard: list[np.ndarray], parts: np.ndarray):
        self.basis, self.top, self.leaves, self.shard, self.parts = basis, top, leaves, shard, parts

    def project(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
        return unit @ self.basis

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each row, and the other shards that it asks (-1 for none), nearest first."""
        z = self.project(x)
        near = _nearest(z, self.top, 3)[0]
        keep = 2 * (ASK + 1)
        dist, at = np.full((len(z), near.shape[1] * keep), np.inf, np.float32), np.full((len(z), near.shape[1] * keep), -1, np.int64)
        for t in np.unique(near):
            rows, col = np.nonzero(near == t)
            i, d = _nearest(z[rows], self.leaves[t], keep)
            spot = col[:, None] * keep + np.arange(i.shape[1])
            dist[rows[:, None], spot], at[rows[:, None], spot] = d, self.shard[t][i]
        order = np.argsort(dist, axis=1, kind="stable")
        dist, at = np.take_along_axis(dist, order, axis=1), np.take_along_axis(at, order, axis=1)
        others = np.full((len(z), ASK), -1, np.int64)
        n = np.zeros(len(z), int)
        for c in range(1, at.shape[1]):
            new = (n < ASK) & (at[:, c] >= 0) & (dist[:, c] <= SPILL * dist[:, 0]) & (at[:, c] != at[:, 0]) & ~(others == at[:, c, None]).any(axis=1)
            others[new, n[new]] = at[new, c]
            n += new
        return at[:, 0], others


def _nearest(z: np.ndarray, centre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centroids of each row and how far they are."""
    k = min(k, len(centre))
    d = np.sqrt(np.maximum(0.0, (z**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1) - 2 * z @ centre.T))
    i = np.argpartition(d, k - 1, axis=1)[:, :k]
    return i, np.take_along_axis(d, i, axis=1)


def _means(z: np.ndarray, cells: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the rows of z and the nearest one of each row."""
    cells = max(1, min(cells, len(z)))
    rng = np.random.default_rng(seed)
    centre = z[rng.choice(len(z), cells, replace=False)].astype(np.float32) if len(z) else np.zeros((1, z.shape[1]), np.float32)
    near = np.zeros(len(z), int)
    for r in range(rounds + 1):
        half = 0.5 * (centre**2).sum(axis=1)
        for i in range(0, len(z), 4096):
            near[i : i + 4096] = np.argmax(z[i : i + 4096] @ centre.T - half, axis=1)
        if r == rounds or not len(z):
            break
        count = np.bincount(near, minlength=cells)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(np.r_[-1, near[order]]))
        centre[near[order][at]] = np.add.reduceat(z[order], at, axis=0) / count[near[order][at]][:, None]
    return centre, near


def _chosen(vectors: DataFrame, share: float, salt: int = 0) -> DataFrame:
    """A share of the rows by the hash of their uuid: the same at every run."""
    return vectors.where(F.pmod(F.xxhash64("uuid", F.lit(salt)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))


def _fit(vectors: DataFrame, n: int, low: int, dim: int) -> Cells:
    """Cells and shards for n rows; one level where the first sample is enough for all cells."""
    got = usable(_chosen(vectors, min(1.0, 0.9 * SAMPLE / max(1, n))), dim).limit(SAMPLE).toPandas().drop_duplicates("uuid").sort_values("uuid")
    x = unpack(list(got["v"]), dim).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, basis = np.linalg.eigh(x.T @ x)
    basis = basis[:, ::-1][:, :low].astype(np.float32)
    z = (x.astype(np.float32) @ basis).astype(np.float32)
    shards = -(-n // MOST)
    if CELLS * shards * ROWS_A_CELL <= SAMPLE:
        centre, near = _means(z, max(1, min(len(z) // ROWS_A_CELL, CELLS * shards)), 11)
        count = np.bincount(near, minlength=len(centre)) / max(1, len(z)) * n
        shard = _grouped(centre, count, MOST)
        # one first cell: every leaf belongs to it
        return Cells(basis, np.zeros((1, basis.shape[1]), np.float32), [centre], [shard], _parts(np.bincount(shard, weights=count)))
    top, near = _means(z, int(min(FIRST, len(z) // ROWS_A_CELL, np.ceil(np.sqrt(shards)))), 11)
    count = np.maximum(1.0, np.bincount(near, minlength=len(top)) / max(1, len(z)) * n)
    leaves, shard, full = _second_level(vectors, dim, basis, top, count)
    return Cells(basis, top, leaves, shard, _parts(full))


def _parts(full: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(1.1 * full / MOST - 0.5).astype(int))


def _second_level(vectors: DataFrame, dim: int, basis: np.ndarray, top: np.ndarray, count: np.ndarray) -> tuple[list, list, np.ndarray]:
    """Per first cell its centroids and their shards, numbered through, with the rows expected in each shard.

    Each first cell is fitted in a task of its own, on at most CELL_SAMPLE of its rows.
    """
    wanted = np.minimum(CELL_SAMPLE, ROWS_A_CELL * LEAVES * np.ceil(count / MOST))
    share = np.minimum(1.0, wanted / count)
    rate = min(1.0, 1.2 * float(share.max()))  # chosen before vectors are unpacked; of those, each cell takes its part
    shared = vectors.sparkSession.sparkContext.broadcast((basis, top, share, rate))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, top, share, rate = shared.value
        cells = Cells(basis, top, [], [], np.zeros(0))
        for b in batches:
            if not len(b):
                continue
            z = cells.project(unpack(list(b["v"]), dim))
            t = _nearest(z, top, 1)[0][:, 0]
            ok = (pd.util.hash_array(b["uuid"].to_numpy(dtype=object)) / 2.0**64) < share[t] / rate
            yield pd.DataFrame({"top": t[ok].astype(np.int32), "uuid": b["uuid"].to_numpy()[ok], "z": [r.tobytes() for r in z[ok].astype(np.float32)]})

    def second(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        share = shared.value[2]
        b = b.drop_duplicates("uuid").sort_values("uuid")
        b = b.iloc[: 2 * CELL_SAMPLE]  # never reached: the expected number is CELL_SAMPLE at most
        z = np.frombuffer(b"".join(b["z"]), np.float32).reshape(len(b), -1)
        rows = len(b) / share[key[0]]
        centre, near = _means(z, int(LEAVES * np.ceil(rows / MOST)), 13)
        full = np.bincount(near, minlength=len(centre)) / max(1, len(z)) * rows
        return pd.DataFrame({"top": np.int32(key[0]), "leaf": np.arange(len(centre), dtype=np.int32), "shard": _grouped(centre, full, MOST).astype(np.int32), "full": full, "centre": [c.tobytes() for c in centre.astype(np.float16)]})

    got = usable(_chosen(vectors, rate), dim).mapInPandas(first, "top int, uuid string, z binary").repartition(max(8, len(top)), "top").groupBy("top").applyInPandas(second, "top int, leaf int, shard int, full double, centre binary").toPandas()
    leaves, shard, full, base = [], [], [], 0
    for t in range(len(top)):
        mine = got[got["top"] == t].sort_values("leaf")
        if len(mine):
            leaves.append(np.frombuffer(b"".join(mine["centre"]), np.float16).astype(np.float32).reshape(len(mine), -1))
            local = mine["shard"].to_numpy().astype(np.int64)
        else:
            leaves.append(top[t : t + 1])
            local = np.zeros(1, np.int64)
        weight = np.bincount(local, weights=mine["full"]) if len(mine) else np.zeros(1)
        shard.append(local + base)
        full.append(weight)
        base += len(weight)
    return leaves, shard, np.concatenate(full)


def _grouped(centre: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Cells joined to shards: the nearest pair first, while a shard has room."""
    k = len(centre)
    root = np.arange(k)
    size = count.astype(float).copy()
    d = (centre**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1) - 2 * centre @ centre.T
    i, j = np.triu_indices(k, 1)
    for p in np.argsort(d[i, j], kind="stable"):
        a, b = root[i[p]], root[j[p]]
        if a != b and size[a] + size[b] <= most:
            root[root == b] = a
            size[a] += size[b]
    return np.unique(root, return_inverse=True)[1]


def _assign(rows: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """(shard, part, uuid, v, member, several): where each vector is indexed (member) or only asks; `several` if it asks more than once."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for b in batches:
            if not len(b):
                continue
            home, others = cells.place(unpack(list(b["v"]), dim))
            uuid, v = b["uuid"].to_numpy(dtype=object), b["v"].to_numpy()
            place = (pd.util.hash_array(uuid).astype(np.uint64) % cells.parts[home].astype(np.uint64)).astype(int)
            several = (others >= 0).any(axis=1) | (cells.parts[home] > 1)
            for c, mine in ((home, True), *((others[:, k], False) for k in range(others.shape[1]))):
                count = np.where(c >= 0, cells.parts[np.maximum(c, 0)], 0)
                for part in range(int(count.max(initial=0))):
                    ok = part < count
                    yield pd.DataFrame({"shard": c[ok].astype(np.int32), "part": np.int32(part), "uuid": uuid[ok], "v": v[ok], "member": (place[ok] == part) & mine, "several": several[ok]})

    return rows.mapInPandas(run, "shard int, part int, uuid string, v binary, member boolean, several boolean")


def _directed(rows: DataFrame, dim: int) -> DataFrame:
    """`rows` with `way`, a hash of the vector's direction on a grid so fine that those of one value have cosines that round to one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mix = np.random.default_rng(17).integers(-(1 << 62), 1 << 62, dim)
        for b in batches:
            x = unpack(list(b["v"]), dim).astype(np.float64)
            grid = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * 65536.0).astype(np.int64)
            with np.errstate(over="ignore"):
                yield b.assign(way=(grid * mix).sum(axis=1))

    return rows.mapInPandas(run, "uuid string, v binary, way long")


def _thinned(rows: DataFrame, dim: int, top: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows to be indexed, and (uuid, lead, last) of the rows left out: the smallest and the largest uuid indexed of their direction.

    Left out are, of a direction with HOT rows or more, all but the smallest top + 1 uuids: each of those left out has ten nearest that
    are nearest to the smallest uuid as well, as all of their cosines round to one.
    """
    ways = _directed(rows, dim).select("uuid", "way")
    hot = ways.groupBy("way").count().where(F.col("count") >= HOT).select("way")  # at most a row for every HOT rows given
    if hot.isEmpty():
        return rows, None
    mine = ways.join(hot, "way")
    w = Window.partitionBy("way").orderBy("uuid")
    kept = mine.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1)  # cut down in each task before the shuffle
    kept = written(kept, "directions")
    last = kept.groupBy("way").agg(F.max("uuid").alias("last"), F.min("uuid").alias("lead"))
    left = written(mine.join(last, "way").where(F.col("uuid") > F.col("last")).select("uuid", "lead", "last"), "copies")
    return rows.join(left.select("uuid"), "uuid", "left_anti"), left


def _directions(x: np.ndarray) -> np.ndarray:
    """For each row of x, of length one, the row that stands for its direction: one within about NEAR of it. A few may stay apart."""
    rep = np.arange(len(x))
    rng = np.random.default_rng(5)
    for _ in range(NEAR_ROUNDS):
        live = np.flatnonzero(rep == np.arange(len(x)))
        z = (x @ rng.normal(size=(x.shape[1], 6)).astype(np.float32))[live]
        cell = np.floor(z / NEAR_CELL + rng.random(6)).astype(np.int32)
        _, first, at = np.unique(cell.view(np.dtype((np.void, 24))).ravel(), return_index=True, return_inverse=True)
        lead = live[first][at]
        new = np.flatnonzero(lead != live)
        new = new[np.linalg.norm(x[live[new]] - x[lead[new]], axis=1) <= NEAR]
        rep[live[new]] = lead[new]
    while (rep[rep] != rep).any():
        rep = rep[rep]
    return rep


def shard_neighbours(uuids: np.ndarray, full: np.ndarray, member: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """For each row the positions (in the sorted uuids) and similarities of its nearest members, -1 padded. uuids are sorted."""
    norm = np.linalg.norm(full.astype(np.float64), axis=1)
    unit = full / norm[:, None].astype(np.float32)
    keys = np.ascontiguousarray(full).view(np.dtype((np.void, full.shape[1] * 4))).ravel()
    mem = np.flatnonzero(member)
    _, first, group = np.unique(keys[mem], return_index=True, return_inverse=True)
    rep = _directions(unit[mem[first]])
    nodes, of = np.unique(rep, return_inverse=True)
    node_row = mem[first[nodes]]  # the row whose vector a node has
    reach = np.zeros(len(nodes))  # how far a node's members are from it
    apart = np.flatnonzero(rep != np.arange(len(rep)))
    for i in range(0, len(apart), BATCH):
        j, k = mem[first[apart[i : i + BATCH]]], node_row[of[apart[i : i + BATCH]]]
        far = np.linalg.norm(full[j] / norm[j][:, None] - full[k] / norm[k][:, None], axis=1)
        np.maximum.at(reach, of[apart[i : i + BATCH]], far + 1e-12)
    group = of[group]
    o = np.lexsort((mem, group))
    begin = np.searchsorted(group[o], np.arange(len(nodes)))
    size = np.diff(np.r_[begin, len(mem)])
    wide = int(min(top + 1, size.max(initial=1)))
    names = np.full((len(nodes), wide), -1, np.int64)  # the smallest uuids of each node
    for j in range(wide):
        has = size > j
        names[has, j] = mem[o[begin[has] + j]]
    node_of = np.full(len(uuids), -1)
    node_of[mem] = group
    graph = Hnsw(unit[node_row])
    out_i, out_s = np.full((len(uuids), top), -1, np.int64), np.full((len(uuids), top), -2.0)

    def keep(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, bad: np.ndarray) -> None:
        key = np.round((2.0 - sims) * 1e6).astype(np.int64) * (1 << 31) + ids
        key[bad] = np.iinfo(np.int64).max
        k = min(top, key.shape[1])
        best = np.argpartition(key, k - 1, axis=1)[:, :k]
        key = np.take_along_axis(key, best, axis=1)
        real = key < np.iinfo(np.int64).max
        out_i[rows[:, None], np.arange(k)] = np.where(real, np.take_along_axis(ids, best, axis=1), -1)
        out_s[rows[:, None], np.arange(k)] = np.where(real, np.take_along_axis(sims, best, axis=1), -2.0)

    beam = min(BEAM, max(8, len(nodes)))
    open_rows, forth, back, how = [], [], [], []
    for at in range(0, len(uuids), BATCH):
        rows = np.arange(at, min(len(uuids), at + BATCH))
        cand = graph.ask(unit[rows], node_of[rows], beam=beam)[:, :RANKED]
        ranked = cand.shape[1]
        own = node_of[rows]
        cand = np.concatenate([cand, np.where((own >= 0) & ~(cand == own[:, None]).any(axis=1), own, -1)[:, None]], axis=1)
        r = node_row[np.maximum(cand, 0)]
        dots = np.empty(cand.shape)
        for i in range(0, len(rows), 128):
            a = full[rows[i : i + 128]].astype(np.float64)
            dots[i : i + 128] = np.matmul(full[r[i : i + 128]].astype(np.float64), a[:, :, None])[:, :, 0]
        cos = dots / (norm[rows][:, None] * norm[r])
        sim = np.round(cos, 6)
        ids = names[np.maximum(cand, 0)].reshape(len(rows), -1)
        keep(rows, ids, np.repeat(sim, wide, axis=1), (ids < 0) | np.repeat(cand < 0, wide, axis=1) | (ids == rows[:, None]))
        real = (ids >= 0) & ~np.repeat(cand < 0, wide, axis=1) & (ids != rows[:, None])
        forth.append(np.repeat(rows, real.sum(axis=1)).astype(np.int32))
        back.append(ids[real].astype(np.int32))
        how.append(np.round(np.repeat(2.0 - sim, wide, axis=1)[real] * 1e6).astype(np.int32))
        least = out_s[rows].min(axis=1) - 1.5e-6  # what may tie with the last that is kept
        more = (ranked == RANKED) & (cand[:, ranked - 1] >= 0) & (sim[:, ranked - 1] >= least - reach.max(initial=0.0))
        far = np.where(cand >= 0, reach[np.maximum(cand, 0)], 0.0)
        split = (far > 0) & (np.round(cos - far, 6) != np.round(cos + far, 6)) & (cos + far >= least[:, None])
        open_rows.append(rows[more | split.any(axis=1)])
    if forth:
        _both_ways(np.concatenate(forth), np.concatenate(back), np.concatenate(how), out_i, out_s)
    asked = np.concatenate(open_rows) if open_rows else np.empty(0, int)
    whole = full[mem].astype(np.float64) if len(asked) else None
    for i in range(0, len(asked), 64):
        rows = asked[i : i + 64]
        sim = np.round((full[rows].astype(np.float64) @ whole.T) / (norm[rows][:, None] * norm[mem]), 6)
        ids = np.broadcast_to(mem, sim.shape)
        keep(rows, ids, sim, ids == rows[:, None])
    return out_i, out_s


def _both_ways(forth: np.ndarray, back: np.ndarray, how: np.ndarray, out_i: np.ndarray, out_s: np.ndarray) -> None:
    """Takes each row as a candidate of its candidates too: `how` is 2 - cosine in millionths, the same from both ends."""
    top = out_i.shape[1]
    worst = np.round((2.0 - out_s[:, -1]) * 1e6).astype(np.int64)
    worst[out_i[:, -1] < 0] = np.iinfo(np.int64).max
    worst = np.maximum(worst, np.round((2.0 - out_s.min(axis=1)) * 1e6).astype(np.int64))
    ok = how <= worst[back]  # others change nothing
    to, new, cost = back[ok].astype(np.int64), forth[ok].astype(np.int64), how[ok].astype(np.int64)
    rows, cols = np.nonzero(out_i >= 0)
    to, new, cost = np.r_[rows, to], np.r_[out_i[rows, cols], new], np.r_[np.round((2.0 - out_s[rows, cols]) * 1e6).astype(np.int64), cost]
    o = np.lexsort((new, cost, to))
    to, new, cost = to[o], new[o], cost[o]
    first = np.r_[True, (to[1:] != to[:-1]) | (new[1:] != new[:-1]) | (cost[1:] != cost[:-1])] if len(to) else np.zeros(0, bool)
    to, new, cost = to[first], new[first], cost[first]
    begin = np.flatnonzero(np.r_[True, np.diff(to) > 0]) if len(to) else np.empty(0, int)
    rank = np.arange(len(to)) - np.repeat(begin, np.diff(np.r_[begin, len(to)]))
    keep = rank < top
    out_i[to[keep], rank[keep]] = new[keep]
    out_s[to[keep], rank[keep]] = 2.0 - cost[keep] / 1e6


def _search(dim: int, top: int):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("uuid").sort_values("uuid", ignore_index=True)
        uuids, member, several = b["uuid"].to_numpy(dtype=object), b["member"].to_numpy(dtype=bool), b["several"].to_numpy(dtype=bool)
        full = unpack(list(b["v"]), dim)
        del b
        if not member.any():
            return pd.DataFrame(columns=["kind", "a", "b", "sim"])
        ids, sims = shard_neighbours(uuids, full, member, top)
        q = np.repeat(np.arange(len(uuids)), ids.shape[1])
        o, s = ids.ravel(), sims.ravel()
        ok = o >= 0
        q, o, s = q[ok], o[ok], s[ok]
        late = several[q]  # whose lists are merged with other shards'
        x, y, z = q[~late], o[~late], several[o[~late]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        pair = np.unique(np.stack([lo, hi, z.astype(np.int64)], axis=1), axis=0) if len(lo) else np.empty((0, 3), np.int64)
        out = [pd.DataFrame({"kind": pair[:, 2].astype(np.int32), "a": uuids[pair[:, 0]], "b": uuids[pair[:, 1]], "sim": np.nan})]
        out.append(pd.DataFrame({"kind": np.int32(2), "a": uuids[q[late]], "b": uuids[o[late]], "sim": s[late]}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest_pairs(vectors: DataFrame, top: int = TOP, dim: int = DIM, low: int = LOW) -> DataFrame:
    """uuid_a, uuid_b (a < b): at least one is among the `top` nearest of the other."""
    rows = usable(vectors, dim)
    if _conflicts(vectors):
        rows = rows.groupBy("uuid").agg(F.min("v").alias("v"))
    n = vectors.where(F.col("uuid").isNotNull() & (F.size("embedding") == dim)).count()
    every = rows
    rows, copies = _thinned(rows, dim, top) if n >= HOT else (rows, None)
    cells = _fit(vectors, n, min(low, dim), dim)
    placed = _assign(rows, cells, dim)
    groups = int(cells.parts.sum())
    spots = placed.repartition(groups * (8 if groups < 200 else 1), "shard", "part") if groups > 1 else placed  # few keys: else they often meet in one task
    found = spots.groupBy("shard", "part").applyInPandas(_search(dim, top), "kind int, a string, b string, sim double")
    found = written(found, "neighbours")
    w = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    merged = found.where("kind = 2").groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    merged = merged.select(F.least("a", "b").alias("uuid_a"), F.greatest("a", "b").alias("uuid_b"))
    shaky = found.where("kind = 1").select(F.col("a").alias("uuid_a"), F.col("b").alias("uuid_b")).unionByName(merged).distinct()
    out = found.where("kind = 0").select(F.col("a").alias("uuid_a"), F.col("b").alias("uuid_b")).unionByName(shaky)
    return out if copies is None else _with_copies(out, copies, every, dim, top)


def _alike(pairs: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """The (lead, b) of `pairs` whose cosine rounds to one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (unpack(list(b[c]), dim).astype(np.float64) for c in ("v", "w"))
            cos = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield b.loc[np.round(cos, 6) >= 1.0, ["lead", "b"]]

    both = pairs.join(rows.select(F.col("uuid").alias("lead"), "v"), "lead").join(rows.select(F.col("uuid").alias("b"), F.col("v").alias("w")), "b")
    return both.select("lead", "b", "v", "w").mapInPandas(run, "lead string, b string")


def _with_copies(pairs: DataFrame, copies: DataFrame, rows: DataFrame, dim: int, top: int) -> DataFrame:
    """`pairs` and those of the rows that were not indexed: with the `top` smallest uuids that are alike.

    Those are among the lead, its ten nearest and what has it among its own ten, and no larger than the last uuid indexed of the direction.
    """
    leads = copies.select("lead", "last").distinct()
    near = pairs.select(F.col("uuid_a").alias("lead"), F.col("uuid_b").alias("b")).unionByName(pairs.select(F.col("uuid_b").alias("lead"), F.col("uuid_a").alias("b"))).join(leads, "lead").where("b <= last").select("lead", "b").distinct()
    near = _alike(near, rows, dim).unionByName(leads.select("lead", F.col("lead").alias("b")))
    w = Window.partitionBy("lead").orderBy("b")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("lead", "b")
    more = copies.join(near, "lead").select(F.least("uuid", "b").alias("uuid_a"), F.greatest("uuid", "b").alias("uuid_b"))
    return pairs.unionByName(more).distinct()


def recall(vectors: DataFrame, pairs: DataFrame, top: int = TOP, dim: int = DIM, one_in: int = 100, chunk: int = 25_000) -> DataFrame:
    """One row: queries, true_pairs (their nearest by brute force), found_pairs (those of them in `pairs`) and recall.

    Queries are all uuids whose hash is divisible by `one_in`, against all rows, in blocks of `chunk` rows: every block gives each query its
    best, and the best of all blocks count.
    """
    rows = usable(vectors, dim).groupBy("uuid").agg(F.min("v").alias("v"))
    blocks = max(1, -(-vectors.count() // chunk))
    asked = rows.where(F.pmod(F.xxhash64("uuid"), F.lit(one_in)) == 0)
    a = rows.withColumn("block", F.pmod(F.xxhash64("uuid", F.lit(1)), F.lit(blocks)).cast("int"))
    b = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("uuid", "v", "block")

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"uuid": np.array([], object), "near": np.array([], object), "sim": np.array([], float)})]
        if len(a) and len(b):
            a = a.sort_values("uuid", ignore_index=True)
            names = a["uuid"].to_numpy(dtype=object)
            x = unpack(list(a["v"]), dim).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                q = unpack(list(part["v"]), dim).astype(np.float64)
                s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ x.T, 6)
                for r, u in enumerate(part["uuid"]):
                    k = min(top + 1, len(names))
                    edge = np.partition(s[r], len(names) - k)[len(names) - k]
                    near = np.flatnonzero(s[r] >= edge)
                    near = near[np.lexsort((near, -s[r][near]))]
                    near = near[names[near] != u][:top]
                    out.append(pd.DataFrame({"uuid": u, "near": names[near], "sim": s[r][near]}))
        return pd.concat(out, ignore_index=True)

    near = a.groupBy("block").cogroup(b.groupBy("block")).applyInPandas(best, "uuid string, near string, sim double")
    w = Window.partitionBy("uuid").orderBy(F.desc("sim"), "near")
    true = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("uuid", F.least("uuid", "near").alias("uuid_a"), F.greatest("uuid", "near").alias("uuid_b"))
    j = true.join(pairs.withColumn("hit", F.lit(1)), ["uuid_a", "uuid_b"], "left")
    return j.agg(F.countDistinct("uuid").alias("queries"), F.count("*").alias("true_pairs"), F.count("hit").alias("found_pairs"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def exact_neighbours(full: np.ndarray, queries: np.ndarray, top: int = TOP) -> np.ndarray:
    """By brute force: positions of the nearest rows of each query row; rows are in the order of their uuids."""
    x = full.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x[queries] @ x.T, 6)
    s[np.arange(len(queries)), queries] = -9
    key = np.round((2.0 - s) * 1e6).astype(np.int64) * (1 << 31) + np.arange(len(x))
    best = np.argpartition(key, top - 1, axis=1)[:, :top]
    return best
