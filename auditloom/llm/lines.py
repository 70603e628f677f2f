"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised and named by a hash; equal ones are one line from then on. Each has `SIMHASHES`
independent 64-bit SimHashes, in which every different word has one vote. Their bits are cut into blocks of
`WIDTH` bits; two lines that agree in a block meet. So lines that differ in fewer bits than there are
blocks always meet, others the more likely the nearer they are, and whether two lines meet depends on
nothing but them. Pairs that meet are verified by edit similarity; of every connected group one occurrence
stays, the first by document and line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.components import components
from auditloom.llm.edits import within
from auditloom.llm.words import (
    Shared, buffers, distinct, hash_spans, mix, name_filter, shared_names, spans, steps,
)
from auditloom.llm.worker import given_back
from auditloom.session import cut

#: Least edit similarity in percent, words of the shortest line that takes part.
PERCENT, MIN_WORDS = 80, 1
#: SimHashes of a line, bits of a block (32: a block is half a SimHash).
SIMHASHES, WIDTH = 8, 32
#: Pairs that are compared at once; results do not depend on it.
TOGETHER = 8192
#: Rounds that link lines to leaders before the remaining pairs are joined.
LEADER_ROUNDS = 2

#: Words whose votes are counted in one go, lines that go together; results do not depend on either.
PIECE, ABREAST = 255, 1024

_U = np.uint64
#: ASCII: capitals to small letters, digits to 0, punctuation goes.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_PUNCTUATION = bytes(
    c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)
)


def normalised(text: str) -> bytes:
    """Small letters, 0 for each digit, no ASCII punctuation; line ends stay."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD, _PUNCTUATION)


def _counters(words: np.ndarray, first: np.ndarray, count: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Votes of `PIECE` words at most for each bit of their hashes, the largest `count` first.

    The counters lie across: the `p`-th plane holds bit `p` of 64 counters in each of its numbers. Two words
    are added at a time.
    """
    planes, less = np.zeros((PIECE.bit_length(), len(count), len(seeds)), np.uint64), -count
    for j in range(0, int(count.max(initial=0)), 2):
        many, pairs = np.searchsorted(less, [-j, -j - 1]).tolist()
        one = _seeded(words[first[:many] + j], seeds)
        other = np.zeros_like(one)
        other[:pairs] = _seeded(words[first[:pairs] + j + 1], seeds)
        plane = planes[0, :many]
        both = one ^ other
        carry = one & other
        carry |= both & plane
        plane ^= both
        for p in range(1, min(j + 2, PIECE).bit_length()):
            plane = planes[p, :many]
            over = plane & carry
            plane ^= carry
            carry = over
    return planes


def _seeded(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The words' hashes for each of the `seeds`; the first is the word itself."""
    out = mix(words[:, None] + seeds)
    out[:, 0] = words
    return out


def simhashes(words: np.ndarray, first: np.ndarray, count: np.ndarray, many: int) -> np.ndarray:
    """`many` SimHashes of each line, whose word hashes begin at `first`; every one given has one vote.

    The first decides a tie (of two, a hash of both), so bits are even in lines of any length.
    """
    seeds = np.arange(many, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    deciding, pairs = _seeded(words[first], seeds), np.flatnonzero(count == 2)
    deciding[pairs] = mix(deciding[pairs] + _seeded(words[first[pairs] + 1], seeds))
    out = np.empty((len(count), many), np.uint64)
    short = np.flatnonzero(count <= PIECE)
    short = short[np.argsort(-count[short], kind="stable")]
    for at in range(0, len(short), ABREAST):
        own = short[at : at + ABREAST]
        planes = _counters(words, first[own], count[own], seeds)
        half, more, even = count[own] // 2, np.zeros((len(own), many), np.uint64), ~np.zeros((len(own), many), np.uint64)
        for p in range(len(planes) - 1, -1, -1):
            bit = (_U(0) - (half >> p & 1).astype(np.uint64))[:, None]
            more |= even & planes[p] & ~bit
            even &= ~(planes[p] ^ bit)
        tie = (_U(0) - (count[own] % 2 == 0).astype(np.uint64))[:, None]
        out[own] = more | even & deciding[own] & tie
    long = np.flatnonzero(count > PIECE)  # votes of pieces are added up
    pieces = -(-count[long] // PIECE)
    line = np.repeat(np.arange(len(long)), pieces)
    start = PIECE * (np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    votes = np.zeros((len(long), 64 * many), np.int32)
    for at in range(0, len(line), ABREAST):
        own, begin = line[at : at + ABREAST], start[at : at + ABREAST]
        size = np.minimum(count[long[own]] - begin, PIECE)
        order = np.argsort(-size, kind="stable")
        planes = _counters(words, (first[long[own]] + begin)[order], size[order], seeds).astype(">u8")
        each = np.zeros((len(own), 64 * many), np.uint8)
        for p, plane in enumerate(planes):
            each[order] |= np.unpackbits(plane.view(np.uint8), axis=1) << p
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[edges]] += np.add.reduceat(each, edges, axis=0, dtype=np.int32)
    leading = np.unpackbits(deciding[long].astype(">u8").view(np.uint8), axis=1).reshape(votes.shape)
    out[long] = np.packbits(2 * votes + leading > count[long, None], axis=1).view(">u8")
    return out


def block_keys(sketches: np.ndarray) -> np.ndarray:
    """A key for each block of each line's SimHashes (a row of `sketches`)."""
    blocks = np.ascontiguousarray(sketches).view(np.uint32).astype(np.uint64)
    own = (np.arange(blocks.shape[1], dtype=np.uint64) + _U(1)) * _U(0xA24BAED4963EE407)
    return mix(blocks + own)


class _Lines:
    """Normalised lines of some texts: words of each, name, length and, if `sketched`, SimHashes."""

    def __init__(self, texts: list[str | None], min_words: int, sketched: bool = True) -> None:
        parts = [normalised(t or "") for t in texts]
        self.per_text = np.array([p.count(b"\n") + 1 for p in parts], np.int64)
        joined = b"\n".join(parts)
        data = np.frombuffer(joined, np.uint8)
        self.joined = joined
        starts, ends = spans(data, np.array([0, len(data)]))
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)
        n_lines = len(breaks) + 1 if parts else 0
        words = np.bincount(line, minlength=n_lines)
        self.used = np.flatnonzero(words >= min_words)
        pick = (words >= min_words)[line] if len(line) else np.zeros(0, bool)
        starts, ends, line = starts[pick], ends[pick], line[pick]
        hashes = hash_spans(data, starts, ends)
        count = words[self.used]
        first = np.cumsum(count) - count
        place = (np.arange(len(hashes)) - np.repeat(first, count)).astype(np.uint64)
        self.low, self.high = starts[first], ends[first + count - 1] if len(first) else ends[:0]
        self.length = np.zeros(len(count), np.int64)
        self.names = np.zeros(len(count), np.uint64)
        if len(count):
            placed = mix(hashes ^ ((place + _U(1)) * _U(0xA24BAED4963EE407)))
            self.names = mix(np.add.reduceat(placed, first) + count.astype(np.uint64))
            self.length = np.add.reduceat(ends - starts, first) + count - 1
        ends_of = np.cumsum(self.per_text)
        self.text = np.searchsorted(ends_of, self.used, "right")
        self.place = self.used - (ends_of - self.per_text)[self.text]
        # equal lines are sketched once
        _, self.once, self.kind = np.unique(self.names, return_index=True, return_inverse=True)
        if sketched:
            of = np.repeat(np.isin(np.arange(len(count)), self.once), count)
            own, sizes = distinct(hashes[of], count[np.sort(self.once)])
            sketches = simhashes(own, np.cumsum(sizes) - sizes, sizes, SIMHASHES)
            self.sketches = sketches[np.argsort(np.argsort(self.once))]  # in the order of `once`

    def line(self, i: int) -> bytes:
        """The `i`-th used line, its words joined by one space."""
        return b" ".join(self.joined[self.low[i] : self.high[i]].split())


def document_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id, row, line, name, length, sketch` of the lines with `min_words` words or more.

    `sketch` holds the line's SimHashes, 8 bytes each, where it first occurs in a step; it is null at
    later places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, 2):
                found = _Lines(step.column(2).to_pylist(), min_words)
                first = np.isin(np.arange(len(found.names)), found.once)
                sketch = pa.Array.from_buffers(pa.binary(), len(first), [
                    pa.py_buffer(np.packbits(first, bitorder="little").tobytes()),
                    pa.py_buffer((8 * SIMHASHES * np.r_[0, np.cumsum(first)]).astype(np.int32).tobytes()),
                    pa.py_buffer(found.sketches[np.argsort(found.once)].tobytes()),
                ])
                owner = pa.array(found.text)
                yield pa.RecordBatch.from_arrays([
                    step.column(0).take(owner), step.column(1).take(owner),
                    pa.array(found.place, pa.int32()), pa.array(found.names.view(np.int64)),
                    pa.array(found.length, pa.int32()), sketch,
                ], ["doc_id", "row", "line", "name", "length", "sketch"])

    schema = "doc_id long, row long, line int, name long, length int, sketch binary"
    return docs.select("doc_id", "row", "text").mapInArrow(given_back(run), schema)


def _keys(column: pa.Array) -> np.ndarray:
    data, _ = buffers(column)
    return block_keys(np.frombuffer(data.tobytes(), _U).reshape(len(column), SIMHASHES))


def shared_keys(names: DataFrame) -> DataFrame:
    """`key, name, length`, written: the blocks' keys that several lines have, each with those lines.

    `names` has one row `name, length, sketch` for each different line, written; so the keys of a line that
    stands in many texts are made once, and keys that occur once never travel.
    """
    once = names.select("sketch", "name", "length")
    shared = shared_names(once.select("sketch"), lambda b: _keys(b.column(0)).ravel(), slices=lambda b: [b])
    table = names.sparkSession.sparkContext.broadcast((shared.bits, shared.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shared(*table.value)
        for batch in batches:
            keys = _keys(batch.column(0))
            line, block = np.nonzero(known.contains(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[line, block].view(np.int64)), *batch.select([1, 2]).take(pa.array(line)).columns],
                ["key", "name", "length"],
            )

    keyed = cut(once.mapInArrow(given_back(run), "key long, name long, length int").distinct())
    several = keyed.groupBy("key").agg((F.min("name") != F.max("name")).alias("several")).filter("several")
    return cut(keyed.join(several.select("key"), "key", "left_semi"))


def line_texts(docs: DataFrame, wanted: Shared, min_words: int) -> DataFrame:
    """`name, text` of the lines whose name `wanted` contains (and perhaps a few more)."""
    table = docs.sparkSession.sparkContext.broadcast((wanted.bits, wanted.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shared(*table.value)
        for batch in batches:
            for step in steps(batch, 0):
                found = _Lines(step.column(0).to_pylist(), min_words, sketched=False)
                first = found.once[known.contains(found.names[found.once])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.names[first].view(np.int64)),
                    pa.array([found.line(i).decode("utf-8", "replace") for i in first.tolist()], pa.string()),
                ], ["name", "text"])

    return docs.select("text").mapInArrow(given_back(run), "name long, text string")


def _near(one: str, other: str, percent: int) -> Column:
    return F.expr(
        f"100 * least({one}.length, {other}.length) >= {percent} * greatest({one}.length, {other}.length)"
    )


def similar(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (`a, b`, names of lines) whose `texts` have an edit similarity of `percent` or more.

    The similarity is 1 less the Levenshtein distance over the longer length, in characters. The work for
    a pair of n characters is n x n / 64 steps.
    """
    x = texts.select(F.col("name").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("name").alias("b"), F.col("text").alias("y"))

    def checked(waiting: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(waiting).combine_chunks()
        one, other = table.column("x").to_pylist(), table.column("y").to_pylist()
        longer = np.array([max(len(s), len(t)) for s, t in zip(one, other)], np.int64)
        kept = within(one, other, (100 - percent) * longer // 100)
        return table.select(["a", "b"]).filter(pa.array(kept)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, size = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= TOGETHER or size >= 1 << 24:
                yield from checked(waiting).to_batches()
                waiting, rows, size = [], 0, 0
        if waiting:
            yield from checked(waiting).to_batches()

    met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return cut(met.mapInArrow(given_back(run), "a long, b long"))


def line_groups(keyed: DataFrame, docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`id, component` of all linked lines; `keyed` has the distinct rows `key, name, length`, written.

    In a few linear rounds, every key has one leader, another one in each round, and a line is compared
    with one of its leaders. Then all pairs of lines that meet and are still in different groups are
    joined. So no link is lost, and a large group of variants is not expanded into its pairs.
    """
    wanted = keyed.select("name").distinct()
    texts = line_texts(docs, name_filter(wanted), min_words).join(wanted, "name", "left_semi")
    texts = cut(texts.groupBy("name").agg(F.min("text").alias("text")))
    links = found = None

    def placed() -> DataFrame:
        if found is None:
            return keyed.withColumn("component", F.col("name"))
        return keyed.join(found.withColumnRenamed("id", "name"), "name", "left").withColumn(
            "component", F.coalesce("component", "name")
        )

    for turn in range(LEADER_ROUNDS):
        grouped = placed() if found is None else cut(placed())
        order = F.struct(F.xxhash64("name", F.lit(turn)).alias("o"), "name", "length", "component")
        leader = grouped.groupBy("key").agg(F.min(order).alias("l"), F.count("*").alias("k"))
        met = (
            grouped.alias("b").join(leader.filter("k > 1").select("key", "l.*").alias("a"), "key")
            .filter("a.component <> b.component").filter(_near("a", "b", percent))
            .groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(F.count("*").alias("n"))
        )
        # of its leaders, a line is compared with the one it shares most blocks with
        likely = met.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        more = similar(likely, texts, percent)
        links = more if links is None else links.unionByName(more)
        found = components(links)
    grouped = cut(placed())
    several = grouped.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low <> high").select("key")
    open_ = grouped.join(several, "key")
    pairs = (
        open_.alias("a").join(
            open_.alias("b"),
            F.expr("a.key = b.key AND a.name < b.name AND a.component <> b.component") & _near("a", "b", percent),
        )
        .select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()
    )
    return components(links.unionByName(similar(pairs, texts, percent)))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with `text` less its repeated lines, and `n_lines, n_removed` (long; own ones are replaced).

    Of a group of similar lines the first stays, by `doc_id` (null last), then by place. Lines without a
    word always stay. A null text stays null and has no lines; a text that loses no line stays as it is; all
    other columns are kept, whatever their names. Rows equal in `doc_id` and `text` are one document and
    treated alike; different texts of one id are told apart by 64-bit hashes. Lines of any length take
    part; equal ones are found whole, and a pair of n characters that meets takes n x n / 64 steps.
    """
    row = F.xxhash64("doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    found = cut(document_lines(texts, min_words))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    names = cut(found.groupBy("name").agg(
        F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("several"),
        F.first("length").alias("length"), F.first("sketch", ignorenulls=True).alias("sketch"),
    ))
    groups = line_groups(shared_keys(names), texts, percent, min_words)
    grouped = names.select("name", "first", "several").join(groups.withColumnRenamed("id", "name"), "name", "left")
    grouped = cut(grouped.filter("component IS NOT NULL OR several"))
    least = grouped.filter("component IS NOT NULL").groupBy("component").agg(
        F.min("first").alias("least")
    )
    kept = grouped.join(least, "component", "left").select("name", F.coalesce("least", "first").alias("kept"))
    gone = found.select("doc_id", "row", "line", "name").join(kept, "name").filter(
        (F.col("row") != F.col("kept.row")) | (F.col("line") != F.col("kept.line"))
    ).groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone"))  # at most the lines of one text
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("id"), row.alias("hash"))
    joined = own.join(gone, F.expr("id <=> doc_id AND hash = row"), "left").withColumn(
        "lines", F.when(F.col("gone").isNotNull(), F.split("own.text", "\n"))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    n_lines = F.octet_length("own.text") - F.octet_length(F.replace("own.text", F.lit("\n"), F.lit(""))) + 1
    replaced = ("n_lines", "n_removed")
    return joined.select(
        *((F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(text) if c == "text"
           else F.col("own").getField(c)).alias(c) for c in docs.columns if c not in replaced),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
