from __future__ import annotations

import random

import numpy as np
import pytest

from auditloom.llm import edits


def plain(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def changed(draw, text, alphabet, edits_):
    out = list(text)
    for _ in range(edits_):
        at = draw.randrange(len(out) + 1)
        out[at : at + draw.randrange(2)] = draw.choice(["", draw.choice(alphabet)])
    return "".join(out)


def drawn(draw, alphabet, most, many):
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("a", "a"), ("a", "b")]
    for _ in range(many):
        x = "".join(draw.choices(alphabet, k=draw.randrange(most)))
        other = changed(draw, x, alphabet, draw.randrange(12)) if draw.random() < 0.7 else "".join(
            draw.choices(alphabet, k=draw.randrange(most))
        )
        pairs.append((x, other))
    return pairs


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "aé漢😀 xyz", [chr(c) for c in range(0x4E00, 0x5200)]])
@pytest.mark.parametrize("short", [edits.SHORT, 0])
def test_distance(alphabet, short, monkeypatch):
    monkeypatch.setattr(edits, "SHORT", short)
    monkeypatch.setattr(edits, "CELLS", 1 << 14)
    pairs = drawn(random.Random(5), alphabet, 200, 120)
    x, y = [p[0] for p in pairs], [p[1] for p in pairs]
    true = np.array([plain(*p) for p in pairs])
    for off in (-1, 0, 1, 5):
        assert edits.within(x, y, true + off).tolist() == [off >= 0] * len(pairs)


def test_length_of_blocks():
    draw = random.Random(2)
    for size in (63, 64, 65, 127, 128, 129, 1024, 1025):
        x = "".join(draw.choices("abc", k=size))
        y = changed(draw, x, "abc", 9)
        d = plain(x, y)
        assert edits.within([x, y, x], [y, x, x], np.array([d, d - 1, 0])).tolist() == [True, False, True]


def test_changed_words_need_no_table(monkeypatch):
    """What both texts begin and end with goes, then words are met in order; only other pairs get a table."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(60)]
    pairs = []
    for left, new in (([0], ["x"]), ([3, 40], ["xy", "z"]), ([5, 30, 59], [])):
        other = [w for i, w in enumerate(words) if i not in left]
        for i, w in zip(left, new):
            other.insert(i, w)
        pairs.append((" ".join(words), " ".join(other)))
    most = np.array([plain(*p) + 30 for p in pairs])
    with monkeypatch.context() as patch:
        patch.setattr(edits, "_together", None)
        patch.setattr(edits, "_alone", None)
        assert edits.within([p[0] for p in pairs], [p[1] for p in pairs], most).all()
    for x, y in pairs:
        d = plain(x, y)
        assert edits.within([x, x], [y, y], np.array([d, d - 1])).tolist() == [True, False]


def test_texts_of_several_lengths_move_together(monkeypatch):
    draw, calls = random.Random(6), []
    together = edits._together
    monkeypatch.setattr(edits, "_together", lambda *a: calls.append(len(a[0])) or together(*a))
    x = ["".join(draw.choices("abcd", k=k)) for k in range(130, 250, 12)]
    y = ["".join(draw.choices("abcd", k=len(s))) for s in x]
    d = np.array([plain(*p) for p in zip(x, y)])
    assert edits.within(x, y, d).all() and not edits.within(x, y, d - 1).any()
    assert calls == [len(x)] * 2


def test_none():
    assert edits.within([], [], np.zeros(0, np.int64)).tolist() == []
