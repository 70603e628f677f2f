"""Pack tokenized documents into fixed-size sequences: best fit, then a swap-based local search.

Documents are tokenized where they are read; only lengths and checksums move on. Pieces are dealt
into groups of bounded size. In each group best fit makes the bins, and a local search moves
documents, or exchanges one for one and two for one, from emptier to fuller bins: every step
increases the sum of squared fills until bins empty. Bins that stay underfull meet those of other
groups in the next round.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.worker import given_back, kept
from auditloom.session import cut

CAPACITY = 4096
#: Pieces that one group holds on average, and from which fill a bin takes no further part.
GROUP, SETTLED = 4096, 0.97
#: Words whose ids a worker remembers, twice: those met lately and those before; a bound of memory, results
#: do not depend on it.
REMEMBERED = 200_000


def _bytes_in(some: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(some)] = True
    return table


_TAIL, _BLANK, _LETTER = _bytes_in(b".,;:!?"), _bytes_in(b" \t\n\r\x0b\x0c"), _bytes_in(bytes(range(97, 123)))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Packed little-endian ids of words, through a tokenizer that never joins words.

    The tokenizer drops white space and cuts at it, so a text's ids are its words' ids. A text is
    lower-cased, and trailing punctuation is cut off after a letter, where the tokenizer cuts as
    well, so that few words are new. Only those are encoded: words of letters many at a time, told
    apart by the suffix that ends a word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def split(texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, lower-cased, punctuation that ends a word apart if a letter comes before."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        joined = b"\n".join([*texts, b""]).lower()
        data = np.frombuffer(joined, np.uint8)
        tail = _TAIL[data]
        first, last = np.flatnonzero(tail[1:] & ~tail[:-1]) + 1, np.flatnonzero(tail[:-1] & ~tail[1:])
        last = last[len(last) - len(first) :]  # a run at the very start has no letter before it
        at = first[_LETTER[data[first - 1]] & _BLANK[data[last + 1]]]
        spaced = np.insert(data, at, 32).tobytes()
        low = 0
        out = []
        for text, high in zip(texts, (ends + np.searchsorted(at, ends)).tolist()):
            if b"<|" in text:  # may hold a special token, whose case counts
                words = [[w] if b"<|" in w else WordEncoder.split([w])[0] for w in text.split()]
                out.append([x for part in words for x in part])
            else:
                out.append(spaced[low:high].split())
            low = high
        return out

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:  # words that do not come again soon are forgotten
            self.older, self.words = self.words, {}
            new = words
        again = {w: self.older[w] for w in new if w in self.older}
        self.words.update(again)
        new = new.difference(again)
        texts = [(w, w.decode("utf-8", "replace")) for w in new]
        plain = [x for x in texts if x[1].isalpha()]
        other = [x for x in texts if not x[1].isalpha()]
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            text = " ".join(t for _, t in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                other += some
                continue
            packed, start = ids.tobytes(), 0
            for (word, _), end in zip(some, (4 * ends).tolist()):
                self.words[word] = packed[start:end]
                start = end
        if other:
            found = self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)
            for (word, _), encoded in zip(other, found):
                self.words[word] = np.array(encoded.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        split = self.split(texts)
        self.learn(set().union(*split))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Rows of `PIECES` for `doc_id, text`: ids, then `end_id`, cut after each `capacity` ids.

    A null or empty text has just the end id. Repeated rows are documents of their own.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"word-encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([t or b"" for t in texts])):
                    ids += end
                    for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        rows.append((doc, number, start // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    )],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(given_back(run), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length: longest first, into the bin with the least room that suffices."""
    bins, count = np.empty(len(lengths), np.int64), 0
    rooms: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, bins[i] = rooms.pop(at)
        else:
            room, bins[i], count = capacity, count, count + 1
        if room > length:
            insort(rooms, (room - length, int(bins[i])))
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Bins after moves and exchanges between all bins that have room, in sweeps until none helps.

    A step takes one or two documents out of a bin and gives it none or one, shorter, back. It is
    taken only into a bin that is no emptier, and kept, so each step raises the sum of squared
    fills; of the steps of a bin the one that moves most is taken. The search ends at the least number
    of bins that the total allows, or when no underfull bin has a step left.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    held: list[list[int]] = [[] for _ in range(len(fill))]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    used = int(np.count_nonzero(fill))
    room = np.where(fill < capacity, capacity - fill, -1)
    moved = True
    while moved and used > least:
        moved = False
        for donor in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[donor] < capacity and used > least:
                step = _step(lengths, bins, held[donor], donor, fill, room)
                if step is None:
                    break
                gain, group, receiver, other = step
                for i in group:
                    held[donor].remove(i)
                    held[receiver].append(i)
                    bins[i] = receiver
                if other is not None:
                    held[receiver].remove(other)
                    held[donor].append(other)
                    bins[other] = donor
                fill[receiver] += gain
                fill[donor] -= gain
                for b in (donor, receiver):
                    room[b] = capacity - fill[b] if fill[b] < capacity else -1
                moved = True
            used = int(np.count_nonzero(fill))
    return bins


def _step(
    lengths: np.ndarray, bins: np.ndarray, own: list[int], donor: int, fill: np.ndarray, room: np.ndarray
) -> tuple[int, list[int], int, int | None] | None:
    """What moves most out of `donor`: how much, which documents, into which bin, and which one back.

    Documents of equal length are alike, so of each length one stands for all, and of each pair
    of lengths one pair.
    """
    open_ = np.where((fill >= fill[donor]) & (room > 0), room, -1)
    open_[donor] = -1
    widest = int(open_.max(initial=-1))
    if widest <= 0:
        return None
    sizes: dict[int, list[int]] = {}
    kinds: dict[int, list[int]] = {}
    for i in own:
        kinds.setdefault(int(lengths[i]), []).append(i)
    each = sorted(kinds)
    for k, a in enumerate(each):
        sizes.setdefault(a, [kinds[a][0]])
        if len(kinds[a]) > 1:
            sizes.setdefault(2 * a, kinds[a][:2])
        for c in each[k + 1 :]:
            sizes.setdefault(a + c, [kinds[a][0], kinds[c][0]])
    taken = np.array(sorted(sizes), np.int64)
    best = (0, None, None, None)
    at = int(np.searchsorted(taken, widest, "right"))
    if at:  # a move without return
        size = int(taken[at - 1])
        fits = np.flatnonzero(open_ >= size)
        best = (size, sizes[size], int(fits[np.argmin(open_[fits])]), None)
    # an exchange: for each document elsewhere, the largest group that its bin can take for it
    limit = open_[bins]
    others = np.flatnonzero(limit > best[0])
    if len(others):
        spot = np.searchsorted(taken, lengths[others] + limit[others], "right") - 1
        gain = np.where(spot >= 0, taken[np.maximum(spot, 0)] - lengths[others], 0)
        top = int(np.argmax(gain))
        if gain[top] > best[0]:
            other = int(others[top])
            best = (int(gain[top]), sizes[int(taken[spot[top]])], int(bins[other]), other)
    return None if best[1] is None else best


def _fewest(lengths: np.ndarray, bins: np.ndarray | None, capacity: int) -> np.ndarray:
    fresh = local_search(lengths, best_fit(lengths, capacity), capacity)
    if bins is None:
        return fresh
    moved = local_search(lengths, bins, capacity)
    return min(fresh, moved, key=lambda b: len(np.unique(b)))


def _search(rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    """One round over `group`: rows with new `bin, fill` and the `offset` in the bin."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields
             if f.name not in ("group", "bin", "fill", "offset")]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", kind="stable").reset_index(drop=True)
        lengths = part["length"].to_numpy(np.int64)
        old = np.unique(part["bin"], return_inverse=True)[1] if turn else None
        bins = np.unique(_fewest(lengths, old, capacity), return_inverse=True)[1]
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, np.diff(bins[order]) > 0]
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        part = part.iloc[order].copy()
        part["offset"] = ends - lengths[order] - base
        part["fill"] = np.bincount(bins, lengths).astype(np.int64)[bins[order]]
        part["bin"] = (turn << 56) + (int(key[0]) << 24) + bins[order]
        return part.drop(columns="group")

    return rows.groupBy("group").applyInPandas(
        run, ", ".join([*names, "offset long", "fill long", "bin long"])
    )


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`rows` (with `length` from 1 to `capacity`) with `sequence_id` and `offset`, long.

    Columns of these names and `uid, group, bin, fill` are replaced. Equal lengths, repeated rows
    and an empty table need no special case: rows are told apart by a number of their own.
    """
    plain = rows.drop("sequence_id", "offset", "uid", "group", "bin", "fill")
    placed = cut(plain.withColumn("uid", F.monotonically_increasing_id()))
    done = [placed.filter(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")}
    )]
    rest = placed.filter(F.col("length") < capacity)
    count, turn = rest.count(), 0
    while count:
        groups = -(-count // GROUP)
        key = F.col("bin") if turn else F.col("uid")
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(groups)))
        found = cut(_search(dealt, turn, capacity))
        settled = F.col("fill") >= SETTLED * capacity
        before, count = count, found.filter(~settled).count()
        last = groups == 1 or count > 0.9 * before
        done.append(
            (found if last else found.filter(settled)).withColumn("sequence_id", F.col("bin"))
        )
        if last:
            break
        rest, turn = found.filter(~settled), turn + 1
    out = [*plain.columns, "sequence_id", "offset"]
    result = done[0].select(*out)
    for part in done[1:]:
        result = result.unionByName(part.select(*out))
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
