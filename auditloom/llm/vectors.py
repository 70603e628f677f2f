"""Near duplicates of vectors: a navigable small-world graph per shard, audited beams, components.

Every shard's vectors form a graph of layers, the upper ones thinner. Every vector is searched in
every shard with a beam; where it meets neighbours above the threshold, the search goes on along their
links until no more are found. A shard's beam is widened until an audit against brute force passes:
members with links, vectors of other shards and planted ones are asked, groups of each size by themselves.
Links are verified by cosine in double precision.

A task holds one graph. Graphs and vectors travel in pieces of about a megabyte, each graph once per
shard whose vectors ask it, and a task's vectors pass by a piece at a time.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from auditloom.llm.components import components
from auditloom.llm.worker import batches_of, given_back
from auditloom.session import cut

#: Neighbours of a node in the lowest and the upper layers; beam of the build; nodes per build step.
LINKS, UPPER_LINKS, BUILD_BEAM, STEP = 24, 12, 48, 1024
#: Beam of the first search, recall that an audit asks for, and vectors with links of each kind it wants.
BEAM, RECALL, AUDITED = 32, 0.99, 512
#: Members that an audit looks through for links, vectors of other shards that it asks, and vectors
#: that a size of groups needs to be judged by itself.
EXAMINED, FOREIGN, FEW = 8192, 1024, 30
#: Shards at least, vectors and numbers (vectors times length) of a shard at most.
SHARDS, SHARD_SIZE, SHARD_VALUES = 4, 100_000, 16_000_000
#: Bytes and vectors of a piece that travels, rows of a batch of pieces, links that a task holds.
PIECE, PIECE_ROWS, BATCH_PIECES, HELD_LINKS = 1 << 20, 4096, 8, 1 << 19
#: Numbers that a step of a comparison, of a build or of an audit holds at once.
HELD = 4 << 20
#: Nodes a beam expands at once, and what rounding to single precision may hide.
EXPANDED, SLACK = 4, 1e-4
#: How far below the threshold a search still follows links.
REACH = 0.05


def _rows_of(numbers: int, most: int = 512) -> int:
    """Rows of so many numbers that are held at once."""
    return max(1, min(most, HELD // max(numbers, 1)))


def choose(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the candidates `ids` (rows padded with -1) of each node `own`.

    From the nearest on, one is taken if it is nearer to the node than to all taken so far; places
    that are left go to the nearest of the others.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    out = np.full((len(own), most), -1, np.int32)
    step = _rows_of(ids.shape[1] * x.shape[1])
    for at in range(0, len(own), step):
        some, near = ids[at : at + step], sims[at : at + step]
        real = some >= 0
        v = x[np.where(real, some, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(some.shape, bool)
        closest = np.full(some.shape, -np.inf, np.float32)
        count = np.zeros(len(some), np.int64)
        for k in range(some.shape[1]):
            good = real[:, k] & (near[:, k] > closest[:, k]) & (count < most)
            taken[good, k] = True
            count += good
            closest = np.where(good[:, None], np.maximum(closest, between[:, k]), closest)
        rank = np.where(taken, 0, np.where(real, 1, 2))
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked = np.take_along_axis(some, best, 1)
        out[at : at + step, : picked.shape[1]] = picked
    return out


class Graph:
    """Unit vectors with layers of neighbour lists; searches many queries side by side."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int, beam: int = BEAM) -> None:
        self.x, self.layers, self.entry, self.beam = x, layers, entry, beam
        self.reverse: tuple[np.ndarray, np.ndarray] | None = None

    def around(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes that the lowest layer links to or from one of `nodes`."""
        if self.reverse is None:
            target = self.layers[0].ravel()
            order = np.argsort(target, kind="stable")
            order = order[np.searchsorted(target[order], 0) :]
            starts = np.searchsorted(target[order], np.arange(len(self.x) + 1))
            self.reverse = starts, (order // self.layers[0].shape[1]).astype(np.int32)
        starts, source = self.reverse
        many = starts[nodes + 1] - starts[nodes]
        spot = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        near = np.unique(np.concatenate([
            self.layers[0][nodes].ravel(), source[np.repeat(starts[nodes], many) + spot]
        ]))
        return near[near >= 0]

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        n = len(x)
        x = np.ascontiguousarray(x, np.float32)
        draw = np.random.default_rng(seed).random(n)
        height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(UPPER_LINKS)).astype(int), 8)
        graph = cls(x, [np.full((n, LINKS), -1, np.int32)], int(np.argmax(height)))
        for level in range(1, int(height.max(initial=0)) + 1):
            lists = np.full((n, UPPER_LINKS), -1, np.int32)
            members = np.flatnonzero(height >= level)
            graph._connect_all(lists, members)
            graph.layers.append(lists)
        order = np.argsort(-height, kind="stable")
        first = max(int(np.count_nonzero(height)), min(STEP, n))
        graph._connect_all(graph.layers[0], order[:first])
        for at in range(first, n, STEP):
            graph._insert(order[at : at + STEP])
        return graph

    def _connect_all(self, lists: np.ndarray, members: np.ndarray) -> None:
        """Neighbours within a set of nodes that is small enough to compare in full."""
        k = min(2 * lists.shape[1], len(members) - 1)
        if k < 1:
            return
        for at in range(0, len(members), 512):
            own = members[at : at + 512]
            sims = self.x[own] @ self.x[members].T
            sims[np.arange(len(own)), np.arange(at, at + len(own))] = -np.inf
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            lists[own] = choose(
                self.x, own, members[near].astype(np.int32), np.take_along_axis(sims, near, 1),
                lists.shape[1],
            )
        self._link_back(lists, members)

    def _link_back(self, lists: np.ndarray, nodes: np.ndarray) -> None:
        """Offer each node to its neighbours, which keep the best of old and new ones."""
        source = np.repeat(nodes, lists.shape[1])
        target = lists[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order].astype(np.int32), target[order]
        edges = np.flatnonzero(np.r_[len(target) > 0, target[1:] != target[:-1]])
        count = np.diff(np.r_[edges, len(target)])
        at = 0
        while at < len(edges):
            wanted = count[at : at + 512] + lists.shape[1]  # a hub has many: then fewer targets at once
            held = np.maximum.accumulate(wanted) * np.arange(1, len(wanted) + 1) * self.x.shape[1]
            step = max(1, int(np.searchsorted(held, 2 * HELD, side="right")))
            own, many = target[edges[at : at + step]], count[at : at + step]
            wide = np.full((len(own), int(many.max())), -1, np.int32)
            spot = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            begin = int(edges[at])
            wide[np.repeat(np.arange(len(own)), many), spot] = source[begin : begin + int(many.sum())]
            wide[(wide[:, :, None] == lists[own][:, None, :]).any(axis=2)] = -1
            ids = np.concatenate([lists[own], wide], axis=1)
            sims = np.einsum("tkd,td->tk", self.x[np.maximum(ids, 0)], self.x[own])
            sims[ids < 0] = -np.inf
            most = max(lists.shape[1] * 3, 1)
            if ids.shape[1] > most:
                near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                ids, sims = np.take_along_axis(ids, near, 1), np.take_along_axis(sims, near, 1)
            lists[own] = choose(self.x, own, ids, sims, lists.shape[1])
            at += step

    def _insert(self, nodes: np.ndarray) -> None:
        ids, sims = self.nearest(self.x[nodes], BUILD_BEAM)
        among = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(among, -np.inf)
        k = min(LINKS, len(nodes) - 1)
        if k:
            near = np.argpartition(-among, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, nodes[near].astype(np.int32)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], axis=1)
        self.layers[0][nodes] = choose(self.x, nodes, ids, sims, LINKS)
        self._link_back(self.layers[0], nodes)

    def _beam(self, queries: np.ndarray, start: np.ndarray, width: int, lists: np.ndarray):
        """The `width` nearest nodes that a beam search from `start` meets, for each query."""
        nq = len(queries)
        ids = np.full((nq, width), -1, np.int32)
        sims = np.full((nq, width), -np.inf, np.float32)
        open_ = np.zeros((nq, width), bool)
        seen = np.zeros((nq, len(self.x)), bool)
        every = np.arange(nq)
        ids[:, 0], open_[:, 0], seen[every, start] = start, True, True
        sims[:, 0] = np.einsum("qd,qd->q", self.x[start], queries)
        wide = min(EXPANDED, width)
        while len(every):
            waiting = np.where(open_[every], sims[every], -np.inf)
            pick = np.argpartition(-waiting, wide - 1, axis=1)[:, :wide]
            real = np.take_along_axis(waiting, pick, 1) > -np.inf
            going = real.any(axis=1)
            every, pick, real = every[going], pick[going], real[going]
            if not len(every):
                break
            open_[every[:, None], pick] = False
            nodes = ids[every[:, None], pick]
            near = np.where(real[:, :, None], lists[np.maximum(nodes, 0)], -1).reshape(len(every), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[every[:, None], near]] = -1
            row, column = np.nonzero(near >= 0)
            seen[every[row], near[row, column]] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[row, column] = np.einsum(
                "kd,kd->k", self.x[near[row, column]], queries[every[row]]
            )
            all_ids = np.concatenate([ids[every], near], axis=1)
            all_sims = np.concatenate([sims[every], new], axis=1)
            all_open = np.concatenate([open_[every], near >= 0], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[every] = np.take_along_axis(all_ids, best, 1)
            sims[every] = np.take_along_axis(all_sims, best, 1)
            open_[every] = np.take_along_axis(all_open, best, 1)
        return ids, sims

    def nearest(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers (-1: none) and similarities of about the `width` nearest of each query."""
        queries = np.asarray(queries, np.float32)
        out = []
        size = max(1, min(512, (32 << 20) // max(len(self.x), 1), 16 * HELD // (EXPANDED * LINKS * self.x.shape[1])))
        for at in range(0, len(queries), size):
            some = queries[at : at + size]
            start = np.full(len(some), self.entry)
            for lists in self.layers[:0:-1]:
                ids, sims = self._beam(some, start, 2, lists)
                start = ids[np.arange(len(some)), sims.argmax(axis=1)]
            out.append(self._beam(some, start, min(width, len(self.x)), self.layers[0]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def above(self, queries: np.ndarray, least: float, width: int | None = None) -> list[np.ndarray]:
        """Nodes of each query with a similarity of `least` or more that the search finds."""
        return list(self.answers(queries, least, width))

    def answers(self, queries: np.ndarray, least: float, width: int | None = None) -> Iterator[np.ndarray]:
        """What `above` returns, one query after the other."""
        queries = np.asarray(queries, np.float32)
        width = width or self.beam
        whole = width >= len(self.x)
        step = _rows_of(len(self.x), 256) if whole else 512
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            if whole:
                yield from (np.flatnonzero(row) for row in some @ self.x.T >= least)
            else:
                yield from self._followed(some, least, width)

    def _followed(self, queries: np.ndarray, least: float, width: int) -> Iterator[np.ndarray]:
        ids, sims = self.nearest(queries, width)
        seen = np.zeros(len(self.x), bool)
        for q, near, sim in zip(queries, ids, sims):
            edge = near[(sim >= least - REACH) & (near >= 0)]
            close, met = [edge], [edge]
            seen[edge] = True
            while len(edge):  # along the links of what is close, however much there is
                new = self.around(edge)
                new = new[~seen[new]]
                seen[new] = True
                met.append(new)
                edge = new[self.x[new] @ q >= least - REACH]
                close.append(edge)
            seen[np.concatenate(met)] = False
            hits = np.concatenate(close)
            yield hits[self.x[hits] @ q >= least]

    def planted(self, least: float, many: int, rng: np.random.Generator) -> np.ndarray:
        """Vectors at a cosine between `least` and 1 of random members, in random directions."""
        base = self.x[rng.integers(0, len(self.x), many)].astype(np.float64)
        away = rng.normal(size=base.shape)
        away -= (away * base).sum(axis=1, keepdims=True) * base
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        cosine = np.clip(least + (1 - least) * rng.uniform(0.01, 1, (many, 1)), -1, 1)
        made = cosine * base + np.sqrt(1 - cosine * cosine) * away
        return (made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def audit(
        self, least: float, foreign: np.ndarray | None = None, recall: float = RECALL,
        audited: int = AUDITED, seed: int = 11,
    ) -> float:
        """Widen the beam until links are found; the least mean recall of a kind and size of groups.

        Asked are members that have links, their own place left out, `foreign` vectors that have links
        here, and planted ones, which have no place of their own either and are never lacking. A vector
        counts by the share of its links that is found, whatever their number; the mean must pass for
        each kind and size of groups (those with few vectors together). A beam as wide as the shard
        compares all.
        """
        n = len(self.x)
        rng = np.random.default_rng(seed)
        some = rng.permutation(n)[:EXAMINED]
        kinds = [(self.x[some], some), (self.planted(least, audited, rng), None)]
        if foreign is not None and len(foreign):
            kinds.append((foreign.astype(np.float32), None))
        asked, true, strata = [], [], []
        for kind, (queries, own) in enumerate(kinds):
            upto = len(asked) + audited
            step = _rows_of(n, 256)
            for at in range(0, len(queries), 256):
                for low in range(at, min(at + 256, len(queries)), step):
                    part = queries[low : min(low + step, at + 256)]
                    sims = part @ self.x.T
                    if own is not None:
                        sims[np.arange(len(part)), own[low : low + len(part)]] = -np.inf
                    for q, row in zip(part, sims >= least + 1e-6):  # what rounding cannot hide
                        links = int(np.count_nonzero(row))
                        if links:
                            asked.append(q)
                            true.append((links, np.packbits(row)))  # a bit a member, however many links
                            strata.append(16 * kind + int(math.log(links, 4)))
                if len(asked) >= upto:
                    break
        if not asked:
            return 1.0
        strata = np.array(strata)
        names, many = np.unique(strata, return_counts=True)
        strata[np.isin(strata, names[many < FEW])] = -1
        names = np.unique(strata)
        while True:
            found = self.answers(np.stack(asked), least)
            shares = np.array([
                np.count_nonzero(np.unpackbits(bits, count=n)[np.unique(f)]) / links for (links, bits), f in zip(true, found)
            ])
            share = float(min(shares[strata == s].mean() for s in names))
            if share >= recall or self.beam >= n:
                return share
            self.beam = 2 * self.beam if 16 * self.beam <= n else n  # from there comparing all is faster

    def pack(self, vectors: bool = True) -> bytes:
        """The graph as bytes; without `vectors` only its lists, of upper layers the rows in use."""
        out, parts = io.BytesIO(), {"at": np.array([self.entry, self.beam]), "l0": self.layers[0]}
        for i, lists in enumerate(self.layers[1:], 1):
            nodes = np.flatnonzero((lists >= 0).any(axis=1))
            parts |= {f"n{i}": nodes, f"l{i}": lists[nodes]}
        np.savez(out, **parts, **({"x": self.x} if vectors else {}))
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes, x: np.ndarray | None = None) -> Graph:
        """The graph that `pack` wrote; `x` are its vectors where they were left out."""
        with np.load(io.BytesIO(data)) as f:
            layers = [f["l0"]]
            for i in range(1, sum(name.startswith("l") for name in f.files)):
                lists = np.full((len(layers[0]), f[f"l{i}"].shape[1]), -1, np.int32)
                lists[f[f"n{i}"]] = f[f"l{i}"]
                layers.append(lists)
            return cls(f["x"] if x is None else x, layers, int(f["at"][0]), int(f["at"][1]))


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _single(values: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    out = np.empty(values.shape, np.float32)
    for at in range(0, len(values), PIECE_ROWS):
        out[at : at + PIECE_ROWS] = _unit(values[at : at + PIECE_ROWS])
    return out


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches with equal `keys`; rows of one key may come in several slices."""
    for batch in batches:
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        ends = np.flatnonzero(np.r_[(columns[:, 1:] != columns[:, :-1]).any(axis=0), len(batch) > 0]) + 1
        for low, high in zip([0, *ends[:-1]], ends):
            yield tuple(int(c) for c in columns[:, low]), batch.slice(low, high - low)


#: Pieces of a shard: its graph's lists (kind 0) and its vectors with their classes (kind 1).
_PIECES = pa.schema([
    ("shard", pa.int64()), ("dim", pa.int32()), ("beam", pa.int32()), ("recall", pa.float64()),
    ("kind", pa.int32()), ("seq", pa.int32()), ("classes", pa.binary()), ("data", pa.binary()),
])
#: Links of two classes and the vectors in them; those marked `tree` connect all that the others connect.
_LINKS = pa.schema([
    ("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("tree", pa.bool_()),
])


def _ddl(schema: pa.Schema) -> str:
    return from_arrow_schema(schema).simpleString()


def _spot(number: Column, tasks: int) -> Column:
    """The task of a numbered shard or pair; vectors of one length have a task for each number."""
    return F.pmod(F.pmod(F.xxhash64("dim"), F.lit(1 << 30)) + number, F.lit(tasks)).cast("int")


def _number(shard: str) -> Column:
    return F.col(shard).bitwiseAND(F.lit((1 << 32) - 1))


def _pieces(
    shard: int, classes: np.ndarray, values: np.ndarray, others: np.ndarray | None, least: float
) -> Iterator[pa.RecordBatch]:
    """A shard's graph, built and audited, and its vectors."""
    graph = Graph.build(_single(values))
    recall = graph.audit(least - SLACK, None if others is None else _unit(others))
    beam, lists = graph.beam, graph.pack(vectors=False)
    del graph

    def piece(kind: int, seq: int, own: bytes, data: bytes) -> pa.RecordBatch:
        row = [shard, values.shape[1], beam, recall, kind, seq, own, data]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PIECES)], schema=_PIECES)

    for seq, at in enumerate(range(0, len(lists), PIECE)):
        yield piece(0, seq, b"", lists[at : at + PIECE])
    step = max(1, min(PIECE_ROWS, PIECE // values[0].nbytes))
    for seq, at in enumerate(range(0, len(values), step)):
        yield piece(1, seq, classes[at : at + step].tobytes(), values[at : at + step].tobytes())


def graphs(points: DataFrame, least: float, shards: int) -> DataFrame:
    """The pieces of an audited graph per shard, from `shard, dim, cls, size, v`; of one `dim` there are `shards`."""
    members = points.select("shard", "dim", F.lit(0).alias("foreign"), "cls", "size", "v")
    share = FOREIGN / max(points.count(), 1)
    drawn = points.filter(F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30))
    numbers = points.select("dim", F.col("shard").alias("to")).distinct()
    asked = drawn.join(numbers, "dim").filter("shard <> to").select(
        F.col("to").alias("shard"), "dim", F.lit(1).alias("foreign"), "cls", "size", "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, classes, values, others = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if values:
                parts = [np.concatenate(classes), np.concatenate(values), np.concatenate(others) if others else None]
                for held in (classes, values, others):
                    held.clear()
                yield from _pieces(now, *parts, least)

        for (shard, foreign), part in _runs(batches, "shard", "foreign"):
            if shard != now:
                yield from done()
                now = shard
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            (others if foreign else values).append(v.copy())
            if not foreign:
                classes.append(np.stack([part.column(c).to_numpy() for c in ("cls", "size")], axis=1))
        yield from done()

    dealt = members.unionByName(asked).repartitionById(shards, _spot(_number("shard"), shards))
    return cut(dealt.sortWithinPartitions("shard", "foreign", "cls").mapInArrow(given_back(run), _ddl(_PIECES)))


class _Found:
    """Links that a shard's answers make, with marks on those that connect classes for the first time."""

    def __init__(self, classes: np.ndarray) -> None:
        self.classes, self.roots = classes, np.arange(len(classes))
        self.held, self.many = [], 0

    def add(self, own: np.ndarray, hits: np.ndarray) -> None:
        """The class `own` (name and size) links with the shard's members `hits`."""
        hits = hits[self.classes[hits, 0] != own[0]]
        if not len(hits):
            return
        root = self.roots[hits]
        while (self.roots[root] != root).any():
            root = self.roots[root]
        self.roots[hits] = root
        firsts, at = np.unique(root, return_index=True)
        self.roots[firsts] = firsts[0]
        tree = np.zeros(len(hits), bool)
        tree[at] = True
        ends = np.stack([np.broadcast_to(own, (len(hits), 2)), self.classes[hits]])
        ends = np.where(ends[0, :, :1] < ends[1, :, :1], ends, ends[::-1])
        self.held.append((ends, tree))
        self.many += len(hits)

    def links(self) -> Iterator[pa.RecordBatch]:
        if self.many:
            ends, tree = (np.concatenate(c, axis=axis) for c, axis in zip(zip(*self.held), (1, 0)))
            self.held, self.many = [], 0
            columns = [ends[0, :, 0], ends[1, :, 0], ends[0, :, 1], ends[1, :, 1], tree]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_LINKS)


def search(points: DataFrame, built: DataFrame, least: float, shards: int) -> DataFrame:
    """Links `a, b, size_a, size_b, tree` (`a < b`, classes) of all points with all shards.

    `tree` marks links that connect whatever all of them connect, about one per vector and shard.
    """
    single = isinstance(points.schema["v"].dataType.elementType, T.FloatType)
    numbers = F.broadcast(built.select("dim", F.col("shard").alias("one")).distinct())
    met = built.join(numbers, "dim")
    columns = ["dim", "seq", "classes", "data"]
    held = met.select(F.col("one").alias("asker"), F.col("shard").alias("asked"), "kind", *columns)
    asking = met.filter("kind = 1").select(
        F.col("shard").alias("asker"), F.col("one").alias("asked"), F.lit(2).alias("kind"), *columns
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, names, values, tree = None, [], [], [], None
        for (asker, asked, kind), part in _runs(batches, "asker", "asked", "kind"):
            if (asker, asked) != now:
                now, lists, names, values, tree = (asker, asked), [], [], [], None
            for own, data in zip(part.column("classes").to_pylist(), part.column("data").to_pylist()):
                if kind == 0:
                    lists.append(data)
                    continue
                own = np.frombuffer(own, np.int64).reshape(-1, 2)
                v = np.frombuffer(data, np.float32 if single else np.float64).reshape(len(own), -1)
                if kind == 1:
                    names.append(own)
                    values.append(v)
                    continue
                if tree is None:
                    found, exact = _Found(np.concatenate(names)), np.concatenate(values)
                    names, values = [], []
                    tree = Graph.unpack(b"".join(lists), _single(exact))
                    lists = []
                q = _unit(v)
                for i, hits in enumerate(tree.answers(q, least - SLACK)):
                    for low in range(0, len(hits), PIECE_ROWS):
                        some = hits[low : low + PIECE_ROWS]
                        found.add(own[i], some[(_unit(exact[some]) * q[i]).sum(axis=1) >= least])
                    if found.many >= HELD_LINKS:
                        yield from found.links()
                yield from found.links()

    pair = _number("asker") * F.lit(shards) + _number("asked")
    dealt = held.unionByName(asking).repartitionById(shards * shards, _spot(pair, shards * shards))
    order = dealt.sortWithinPartitions("asker", "asked", "kind", "seq")
    with batches_of(points.sparkSession, BATCH_PIECES):
        found = order.mapInArrow(given_back(run), _ddl(_LINKS))
        return cut(found.groupBy("a", "b", "size_a", "size_b").agg(F.max("tree").alias("tree")))


def near_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for each row of `vec_id, embedding`.

    Vectors link if their cosine is `least` or more. Equal vectors are searched once, as a class. A
    vector that is null, empty, zero or holds a null or non-finite component links with nothing, and
    vectors of different lengths do not link. `component_id` is the least id reachable (a null id
    only if there is no other); repeated rows count as vectors of their own. Other columns are ignored.
    """
    given = rows.schema["embedding"].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists("v", lambda c: c != 0)
    usable = F.coalesce(~bad & some, F.lit(False))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    placed = plain.withColumn("cls", F.when(usable, F.xxhash64("v")))
    if single:  # as short as they came, all the way
        placed = placed.withColumn("v", F.col("v").cast("array<float>"))
    placed = cut(placed)
    classes = cut(placed.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.count("*").alias("size"), F.min("vec_id").alias("first"), F.first("v").alias("v")
    ).withColumn("dim", F.size("v")))
    n, values = classes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(SHARDS, -(-n // SHARD_SIZE), -(-values // SHARD_VALUES))
    points = classes.select(
        "cls", "size", "v", "dim",
        (F.col("dim") * F.lit(1 << 32) + F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(shards))).alias("shard"),
    )
    links = search(points, graphs(points, least, shards), least, shards)
    ends = links.select(F.col("a"), F.col("size_b").alias("size")).unionByName(
        links.select(F.col("b").alias("a"), F.col("size_a").alias("size")))
    others = ends.groupBy("a").agg(F.sum("size").alias("others"))
    tree = links.filter("tree").select("a", "b")
    found = components(tree)
    named = (
        classes.join(others.withColumnRenamed("a", "cls"), "cls", "left")
        .join(found.withColumnRenamed("id", "cls"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = cut(named.join(lowest, "component").select(
        "cls", "component_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links")
    ))
    joined = placed.select("vec_id", "cls").join(known, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
