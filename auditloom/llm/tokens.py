"""Token counts by a unigram model, computed once per shared prefix of a trie of words.

The distinct words of a step are inserted in a trie by sorting them: neighbours in the order share the
path of their common prefix. The walk goes down the trie depth first and keeps the forward scores of
the current path only, so each trie node is scored once. A word's terminal node stores its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditloom.llm.worker import kept
from auditloom.llm.words import steps

#: The mark before each word, and what a byte of an unknown character costs.
START, BYTE_SCORE = "▁", -20.0
#: Words whose counts a worker remembers; a bound of memory, results do not depend on it.
REMEMBERED = 500_000


@dataclass
class Unigram:
    """Log probability of each piece, and the length of the longest."""

    scores: dict[str, float]
    longest: int


def zipf_unigram(path: str) -> Unigram:
    """A unigram model over the ordinary pieces of a vocabulary file: probability by Zipf's law of rank.

    Nothing is trained: the file lists its pieces by the order in which they were merged.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    scores = {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}
    return Unigram(scores, max(map(len, scores), default=1))


def count_words(model: Unigram, words: list[str]) -> list[int]:
    """Tokens of each word in the best segmentation (of equally good ones the shortest).

    A character that no piece covers counts as its UTF-8 bytes. `words` must be sorted.
    """
    get, longest = model.scores.get, model.longest
    # forward score and count for each prefix of the current path
    best, count = [0.0], [0]
    before, out = "", []
    for word in words:
        path = START + word
        common = 0
        limit = min(len(before), len(path))
        while common < limit and before[common] == path[common]:
            common += 1
        del best[common + 1 :], count[common + 1 :]
        for end in range(common + 1, len(path) + 1):
            bytes_ = len(path[end - 1].encode("utf-8", "surrogatepass"))
            top, least = best[end - 1] + BYTE_SCORE * bytes_, count[end - 1] + bytes_
            for start in range(max(0, end - longest), end):
                score = get(path[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and count[start] + 1 < least):
                        top, least = score, count[start] + 1
            best.append(top)
            count.append(least)
        before = path
        out.append(count[-1])
    return out


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`docs` with `n_words, n_tokens` (long; such columns are replaced).

    Words are white-space separated. A null or empty text has none. Rows are independent of
    each other; a text of any length is read whole.
    """
    plain = docs.drop("n_words", "n_tokens")
    at = plain.columns.index("text")
    fields = T.StructType([
        *plain.schema.fields, T.StructField("n_words", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(f"unigram {vocabulary}", lambda: zipf_unigram(vocabulary))
        known: dict[bytes, int] = kept(f"token counts {vocabulary}", dict)
        for batch in batches:
            for step in steps(batch, at):
                texts = step.column(at).cast(pa.binary()).to_pylist()
                words = [(t or b"").split() for t in texts]
                found = set().union(*words)
                new = found.difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = found
                ordered = sorted(new)
                known.update(zip(ordered, count_words(
                    model, [w.decode("utf-8", "surrogateescape") for w in ordered]
                )))
                get = known.__getitem__
                yield pa.RecordBatch.from_arrays([
                    *step.columns, pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sum(map(get, w)) for w in words], pa.int64()),
                ], fields.names)

    return plain.mapInArrow(run, fields)
