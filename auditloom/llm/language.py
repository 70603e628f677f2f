"""Language of every word by script, character statistics and a Viterbi path, and of every text.

A classifier is fitted on a bounded sample of labelled documents: which scripts a language is written
in, and smoothed log probabilities of hashed character n-grams and whole words. A word's script narrows
the candidate languages; the best path over the words' scores, with a penalty for every switch,
labels spans of mixed-language text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.worker import kept
from auditloom.session import cut

#: Bounds of the fitted classifier: labelled documents per language, hash buckets, languages.
SAMPLE_DOCS, BUCKETS, MOST_LANGUAGES = 2000, 1 << 16, 256
GRAMS = (1, 2, 3)
SMOOTHING, SWITCH, MIN_SCRIPT_SHARE = 0.5, 12.0, 0.01
UNKNOWN = "und"
REMEMBERED = 200_000

#: First code points of script ranges and the script's number; 0 is no script.
SCRIPTS = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1),
    (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x250, 1), (0x2B0, 0),
    (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 14), (0x7C0, 15), (0x800, 0),
    (0x8A0, 6), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 16), (0xF00, 17), (0x1000, 18), (0x10A0, 10),
    (0x1100, 11), (0x1200, 19), (0x13A0, 20), (0x1400, 21), (0x1680, 0), (0x1780, 22), (0x1800, 23),
    (0x18B0, 21), (0x1900, 0), (0x1C80, 3), (0x1C90, 10), (0x1CC0, 0), (0x1D00, 1), (0x1DC0, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2D00, 10), (0x2D30, 24),
    (0x2D80, 19), (0x2DE0, 3), (0x2E00, 0), (0x3005, 13), (0x3008, 0), (0x3040, 12), (0x30A0, 12),
    (0x3100, 25), (0x3130, 11), (0x3190, 0), (0x31A0, 25), (0x31C0, 0), (0x31F0, 12), (0x3200, 0),
    (0x3400, 13), (0x4DC0, 0), (0x4E00, 13), (0xA000, 26), (0xA4D0, 0), (0xA640, 3), (0xA6A0, 0),
    (0xA720, 1), (0xA800, 0), (0xA960, 11), (0xA980, 0), (0xAA60, 18), (0xAA80, 0), (0xAB00, 19),
    (0xAB30, 1), (0xAB70, 20), (0xABC0, 0), (0xAC00, 11), (0xD800, 0), (0xF900, 13), (0xFB00, 1),
    (0xFB13, 4), (0xFB18, 0), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0),
    (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 12), (0xFFA0, 11), (0xFFE0, 0),
    (0x20000, 13), (0x323B0, 0),
)
#: Letters outside these ranges share a number, so that the n-grams tell their languages apart. Signs among
#: letters of other scripts (modifiers, superscripts, letterlike symbols) are of no script.
OTHER_LETTERS, N_SCRIPTS, SIGNS = 27, 28, ((0, 0x370), (0x2000, 0x2C00))


def _ranges() -> tuple[np.ndarray, np.ndarray]:
    """First code points and numbers of `SCRIPTS`, with the other letters."""
    starts = np.array([s for s, _ in SCRIPTS], np.int64)
    numbers = np.array([n for _, n in SCRIPTS], np.int64)
    all_of = np.repeat(numbers, np.diff(np.r_[starts, 0x110000]))
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    for low, high in SIGNS:
        letter[low:high] = False
    all_of[letter & (all_of == 0)] = OTHER_LETTERS
    edges = np.flatnonzero(np.r_[True, all_of[1:] != all_of[:-1]])
    return edges, all_of[edges]


_STARTS, _NUMBERS = _ranges()


@dataclass
class Model:
    """Languages in order, whether language i uses script s, log probability per bucket and language
    (less the mean), and the number of the most common language."""

    languages: list[str]
    uses: np.ndarray
    weights: np.ndarray
    common: int


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased words, each with a space before and after, and their word."""
    text = " " + "  ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    return codes, np.repeat(np.arange(len(words)), lengths)


def _grams(codes: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of all n-grams that lie in one word, and the word."""
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        hashed = (hashed[:size] * np.uint64(0x9E3779B97F4A7C15)) ^ (
            codes[n - 1 :].astype(np.uint64) + np.uint64(n)
        ) * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in GRAMS:
            inside = word[:size] == word[n - 1 :]
            buckets = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
            yield (buckets >> np.uint64(48)).astype(np.int64)[inside] % BUCKETS, word[:size][inside]


def _scripts(codes: np.ndarray) -> np.ndarray:
    return _NUMBERS[np.searchsorted(_STARTS, codes, "right") - 1]


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model from rows of `doc_id, lang, text`; null labels and texts are left out.

    Of each language about `sample_docs` documents are read: those whose id's hash is below the
    share that this makes of all, so the sample does not depend on the order of rows. Texts are
    counted where they are read; at most `BUCKETS` counts per language come together.
    """
    known = labelled.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in
             known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(sample_docs / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(place < share).filter(F.col("text").isNotNull())
    order = {x: i for i, x in enumerate(languages)}
    width = BUCKETS + N_SCRIPTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(order), width), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.lower().split()
                if words:
                    codes, word = _codes(words)
                    row = totals[order[lang]]
                    for buckets, _ in _grams(codes, word):
                        row[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    row[BUCKETS:] += np.bincount(_scripts(codes), minlength=N_SCRIPTS)
        lang, bucket = np.nonzero(totals)
        if len(lang):
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(bucket), pa.array(totals[lang, bucket])], ["l", "b", "n"]
            )

    counted = sample.select("lang", "text").mapInArrow(count, "l long, b long, n long")
    sums = counted.groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((len(languages), width))
    totals[sums["l"].to_numpy(), sums["b"].to_numpy()] = sums["n"].to_numpy()
    grams = totals[:, :BUCKETS] + SMOOTHING
    script = totals[:, BUCKETS:].copy()
    script[:, 0] = 0
    uses = script >= MIN_SCRIPT_SHARE * np.maximum(script.sum(axis=1, keepdims=True), 1)
    weights = np.log(grams / grams.sum(axis=1, keepdims=True))
    weights -= weights.mean(axis=0) if languages else 0
    common = max(range(len(languages)), key=lambda i: sizes[languages[i]], default=0)
    return Model(languages, uses & (script > 0), weights.T.astype(np.float32).copy(), common)


def score_words(model: Model, words: list[str]) -> np.ndarray:
    """Score of each lower-cased word in each language; all 0 without letters of a known script.

    A language that does not use a script in the word gets the least score among candidates less
    a fixed margin, unless no language uses it.
    """
    out = np.zeros((len(words), len(model.languages)), np.float32)
    if not words or not model.languages:
        return out
    codes, word = _codes(words)
    for buckets, owner in _grams(codes, word):
        for i in range(out.shape[1]):
            out[:, i] += np.bincount(owner, model.weights[buckets, i], len(words))
    script = _scripts(codes)
    seen = np.zeros((len(words), N_SCRIPTS), bool)
    seen[word, script] = True
    seen[:, 0] = False
    seen[:, ~model.uses.any(axis=0)] = False
    fits = ~((seen[:, None, :] & ~model.uses[None]).any(axis=2))
    out -= np.where(fits, 0, 8.0).astype(np.float32)
    out[~seen.any(axis=1)] = 0
    return out


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Language per word for texts of `lengths` words, whose scores follow each other.

    All texts advance together, longest first, a word per step.
    """
    total, width = scores.shape
    labels = np.zeros(total, np.int16)
    if not total or not width:
        return labels
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    stay = np.ones((total, width), bool)
    best_before = np.zeros(total, np.int16)
    value = scores[starts].copy()
    for t in range(1, int(lengths[0])):
        n = active[t]
        rows, now = starts[:n] + t, value[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - switch
        keep = now >= jump[:, None]
        stay[rows], best_before[rows] = keep, top
        value[:n] = np.where(keep, now, jump[:, None]) + scores[rows]
    state = value.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        labels[rows] = state[:n]
        state[:n] = np.where(stay[rows, state[:n]], state[:n], best_before[rows])
    return labels


class _Scorer:
    """Scores of words seen before, for one model."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.__init__(self.model)
        new = list(set().union(*texts).difference(self.known)) if texts else []
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, score_words(self.model, new)])
        get = self.known.__getitem__
        rows = np.fromiter((i for t in texts for i in map(get, t)), np.int64)
        return self.scores[rows]


SPANS = "array<struct<start: int, length: int, lang: string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """`docs` with `lang_pred`, `lang_score` and `lang_spans` (columns of these names are replaced).

    A span is a run of white-space separated words with one label. `lang_pred` is the language with
    the most characters in its spans (the first by name among equals), `lang_score` its share of
    them. A null text, one without a letter, or a model without languages gives `und`, 0 and no
    spans; letters of unknown scripts alone give the most common language and 0. Only `text` is looked at; rows are independent of each other.
    """
    plain = docs.drop("lang_pred", "lang_score", "lang_spans")
    parts = (model.languages, model.uses, model.weights, model.common)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    fields = T.StructType([
        *plain.schema.fields, T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_spans", T._parse_datatype_string(SPANS)),
    ])
    at = plain.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        scorer = _Scorer(known)
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [t or "" for t in part.column(at).to_pylist()]
                usable = [len(names) > 1 and letters(t) for t in texts]
                words = [t.lower().split() if u else [] for t, u in zip(texts, usable)]
                lengths = np.array([len(w) for w in words], np.int64)
                scores = scorer(words)
                labels = best_paths(scores, lengths, switch)
                owner = np.repeat(np.arange(len(words)), lengths)
                weight = np.fromiter((len(w) for t in words for w in t), np.int64)
                weight = weight * (scores != 0).any(axis=1)
                sums = np.zeros((len(words), len(names)))
                np.add.at(sums, (owner, labels), weight)
                total = sums.sum(axis=1)
                other = np.where(usable, known.common, len(names) - 1)
                pred = np.where(total > 0, sums.argmax(axis=1), other)
                share = np.where(total > 0, sums.max(axis=1) / np.maximum(total, 1), 0.0)
                new = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
                edge = np.flatnonzero(np.r_[len(owner) > 0, new])
                ends = np.r_[edge[1:], len(owner)][: len(edge)]
                base = np.cumsum(lengths) - lengths
                spans = [[] for _ in words]
                for s, e in zip(edge.tolist(), ends.tolist()):
                    if total[owner[s]] > 0:
                        spans[owner[s]].append(
                            {"start": s - base[owner[s]], "length": e - s, "lang": names[labels[s]]}
                        )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[pred].tolist(), pa.string()),
                     pa.array(share, pa.float64()), pa.array(spans, span)],
                    fields.names,
                )

    return plain.mapInArrow(run, fields)


def held_out(doc_id):
    """Whether a document is kept for testing: crc32 of its id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
