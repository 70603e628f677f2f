"""Hashes of words and word sequences over Arrow text columns, and global counts of them.

Words are `[^\\x20\\x09-\\x0D]+`. All work is on whole Arrow buffers; equal words have equal 64-bit
hashes everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.worker import given_back

#: Bytes of text that one step hashes; a bound of memory.
STEP_BYTES = 2 << 20
#: Bytes whose hashes are made at once, few enough for a processor's cache.
HASHED_BYTES = 1 << 16
#: Names a task gathers before it sends their counts on.
GATHERED = 2 << 20
#: Fixed sizes of what is broadcast: bits of the table of shared names, slots of that of heavy names.
SHARED_BITS, HEAVY_SLOT_BITS, HEAVY = 27, 20, 32

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _letters(fold: bool) -> np.ndarray:
    table = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_RADIX))
    if fold:
        table[65:91] = table[97:123]
    return table


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, column: int, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each (a longer text stands alone)."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a text's start and end bound words as well."""
    space = SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = True, True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of the bytes of each span (in order, not overlapping)."""
    out = np.empty(len(starts), np.uint64)
    table = _letters(fold)
    factors = inverse = np.zeros(0, np.uint64)
    at = 0
    while at < len(starts):  # long texts in pieces, so that helpers stay small
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_BYTES, "right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        if high - low > len(factors):
            size = max(high - low, min(HASHED_BYTES, len(data)))
            factors, inverse = powers(_RADIX, size), powers(_INVERSE, size)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * factors[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[e] - sums[s]) * inverse[s]
        at = upto
    return mix(out ^ (ends - starts).astype(np.uint64))


def hash_words(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order, and the number of words of each text."""
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    return hash_spans(data, starts, ends, fold), counts


def sequences(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of the `n` words from each place on, as far as there are `n`."""
    size = max(len(words) - n + 1, 0)
    if not size:
        return np.zeros(0, np.uint64)
    factors = powers(_RADIX, n) * _U(2 * seed + 1)
    if n <= 8:
        out = np.zeros(size, np.uint64)
        for i in range(n):
            out += words[i : i + size] * factors[i]
        return mix(out)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_RADIX, len(words)), out=sums[1:])
    scaled = (sums[n:] - sums[:size]) * powers(_INVERSE, size)
    return mix(scaled * _U(2 * seed + 1))


def of_windows(words: np.ndarray, counts: np.ndarray, n: int, seed: int = 1):
    """Hashes of all windows of `n` words that lie in one text, their text and their place in it."""
    all_of = sequences(words, n, seed)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(all_of):
        return all_of, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    inside = owner[: len(all_of)] == owner[n - 1 :]
    at = np.flatnonzero(inside)
    own = owner[at]
    return all_of[at], own, at - first[own]


def distinct(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, one after another, and how many; `sizes` are those before."""
    values, ends = np.array(values, np.uint64), np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[(ends - sizes)[sizes > 0]] = True
    return values[keep], np.diff(np.r_[0, np.cumsum(keep)][np.r_[0, ends]])


class Shared:
    """Which names occur more than once, and how often the heavy ones do; of fixed size.

    Different names can share a slot, so `contains` can be true, and `level` too high, for a name
    that is rare, never the other way round.
    """

    def __init__(self, bits: np.ndarray, levels: np.ndarray) -> None:
        self.bits, self.levels = bits, levels

    def contains(self, names: np.ndarray) -> np.ndarray:
        slot = names >> _U(64 - SHARED_BITS)
        return (self.bits[(slot >> _U(3)).astype(np.int64)] >> (7 - (slot & _U(7))).astype(np.uint8)) & 1 == 1

    def level(self, names: np.ndarray) -> np.ndarray:
        """0 for names below `HEAVY` occurrences, else the binary logarithm of the number."""
        return self.levels[(names >> _U(64 - HEAVY_SLOT_BITS)).astype(np.int64)]


def name_filter(names: DataFrame) -> Shared:
    """Of a table with one column of names (long): `contains` is true for each of them."""
    return shared_names(
        names, lambda batch: batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64),
        least=1, slices=lambda batch: [batch],
    )


def shared_names(
    rows: DataFrame, names_of: Callable[[pa.RecordBatch], np.ndarray], least: int = 2,
    slices: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]] = lambda batch: steps(batch, 0),
) -> Shared:
    """Count the names (64-bit hashes) that `names_of` finds in `slices` of `rows`, over all rows.

    `contains` is true for names that occur `least` times or more.
    A task adds up the names it gathers and sends them as arrays, one per range of hashes; each range
    is counted by itself. There are four ranges per shuffle partition, so a range's size follows the
    setting of the cluster. What comes back has `SHARED_BITS` bits and one byte per heavy slot.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max(6, math.ceil(math.log2(4 * partitions))), HEAVY_SLOT_BITS)

    def packed(names: np.ndarray) -> pa.RecordBatch:
        names, counts = np.unique(names, return_counts=True)
        part = (names >> _U(64 - bits)).astype(np.int64)
        low = ((names << _U(bits)) >> _U(32)).astype(np.uint32)
        counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[edges[1:], len(part)]
        return pa.RecordBatch.from_arrays([
            pa.array(part[edges], pa.int32()),
            pa.array([low[s:e].tobytes() for s, e in zip(edges, ends)], pa.binary()),
            pa.array([counts[s:e].tobytes() if counts[s:e].max() > 1 else b""
                      for s, e in zip(edges, ends)], pa.binary()),
        ], ["part", "names", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for step in slices(batch):
                held.append(names_of(step))
                size += len(held[-1])
                if size >= GATHERED:
                    yield packed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def counted(part: int, names: list[bytes], counts: list[bytes]) -> tuple[int, bytes, bytes]:
        low = np.concatenate([np.frombuffer(n, np.uint32) for n in names])
        many = np.concatenate([
            np.frombuffer(c, np.uint32) if c else np.ones(len(n) // 4, np.uint32)
            for n, c in zip(names, counts)
        ]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, many = low[order], many[order]
        edges = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        low, many = low[edges], np.add.reduceat(many, edges)
        flags = np.zeros(1 << (SHARED_BITS - bits), np.uint8)
        flags[low[many >= least] >> np.uint32(32 - SHARED_BITS + bits)] = 1
        levels = np.zeros(1 << (HEAVY_SLOT_BITS - bits), np.uint8)
        heavy = many >= HEAVY
        slots = (low[heavy].astype(np.int64)) >> (32 - HEAVY_SLOT_BITS + bits)
        np.maximum.at(levels, slots, np.log2(many[heavy]).astype(np.uint8))
        return part, np.packbits(flags).tobytes(), levels.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, counts = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(counted(part, names, counts), (pa.int32(), pa.binary(), pa.binary()))],
                ["part", "flags", "levels"],
            )

        for batch in batches:
            for p, n, c in zip(*(x.to_pylist() for x in batch.columns)):
                if p != part and names:
                    yield out()
                    names, counts = [], []
                part = p
                names.append(n)
                counts.append(c)
        if names:
            yield out()

    found = (
        rows.mapInArrow(given_back(gather), "part int, names binary, counts binary")
        .repartition(partitions, "part").sortWithinPartitions("part")
        .mapInArrow(given_back(count), "part int, flags binary, levels binary")
    )
    flags = np.zeros((1 << bits, 1 << max(SHARED_BITS - bits - 3, 0)), np.uint8)
    levels = np.zeros((1 << bits, 1 << (HEAVY_SLOT_BITS - bits)), np.uint8)
    for part, f, l in found.collect():  # of the fixed size above
        flags[part] = np.frombuffer(f, np.uint8)
        levels[part] = np.frombuffer(l, np.uint8)
    return Shared(flags.ravel(), levels.ravel())
