"""Requests sent through a ledger."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from auditloom.operators import scoring

REQUESTS = "repo string, commit_sha string, request string"


def requests(spark, many=30):
    rows = [(f"r{i}", "c", "x" * (4 * i)) for i in range(many)]
    return spark.createDataFrame(rows, REQUESTS).repartition(3)


def sender(folder, dies_at=None, fails=()):
    """A scorer that notes what it was sent; its process ends at one request, others raise."""
    def score(batch):
        for repo in batch["repo"]:
            with open(f"{folder}/{repo}", "a") as note:
                note.write("x")
            if repo == dies_at:
                os._exit(1)
            if repo in fails:
                raise RuntimeError("service down")
        return batch.assign(raw_content="{}", tokens_used=batch["request"].str.len(), model=None)

    return score


def sent(folder):
    return Counter({name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)})


@pytest.fixture
def notes(tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    return str(folder)


def test_a_killed_task_sends_nothing_twice(spark, tmp_path, notes):
    ledger = str(tmp_path / "ledger")
    with pytest.raises(Exception):
        scoring.review_resumable(requests(spark), sender(notes, dies_at="r17"), ledger).collect()
    before = sent(notes)
    assert before["r17"] == 1 and scoring.answers(spark, ledger).count() == sum(before.values()) - 1
    for _ in range(2):
        found = {r.repo: r for r in scoring.review_resumable(requests(spark), sender(notes), ledger).collect()}
        assert len(found) == 30 and set(sent(notes).values()) == {1} and len(sent(notes)) == 30
        assert found["r17"].error == scoring.NO_ANSWER
        assert all(r.error is None and r.tokens_used == 4 * int(k[1:]) and r.model is None
                   for k, r in found.items() if k != "r17")
    again = {r.repo: r for r in scoring.review_resumable(requests(spark), sender(notes), "file:" + ledger, resend=True).collect()}
    assert again["r17"].error is None and sent(notes)["r17"] == 2 and sum(sent(notes).values()) == 31


def test_errors_are_sent_again(spark, tmp_path, notes):
    ledger = str(tmp_path / "ledger")
    found = scoring.review_resumable(requests(spark), sender(notes, fails={"r3", "r9"}), ledger).collect()
    assert {r.repo: r.error for r in found if r.error} == dict.fromkeys(("r3", "r9"), "RuntimeError: service down")
    found = scoring.review_resumable(requests(spark), sender(notes), ledger).collect()
    assert len(found) == 30 and all(r.error is None for r in found)
    assert sent(notes) == Counter({f"r{i}": 1 + (i in (3, 9)) for i in range(30)})


def test_budgets(spark, tmp_path, notes):
    ledger, asked = str(tmp_path / "ledger"), requests(spark)
    costs = sorted((r.key, -(-len(r.request) // 4) + 7, r.repo) for r in scoring.keyed(asked).collect())
    answered = set()
    for budget in (100, 0, 150, 10_000):
        left, spent = budget, set()
        for _, cost, repo in [c for c in costs if c[2] not in answered]:
            if cost > left:
                break
            left -= cost
            spent.add(repo)
        answered |= spent
        rows = scoring.review_resumable(asked, sender(notes), ledger, budget, answer_tokens=7).collect()
        assert {r.repo for r in rows if r.error is None} == answered
        assert {r.error for r in rows if r.repo not in answered} <= {scoring.OVER_BUDGET}
    assert sent(notes) == Counter({f"r{i}": 1 for i in range(30)})
    late = str(tmp_path / "late")
    rows = scoring.review_resumable(asked, sender(notes), late, seconds=-1).collect()
    assert {r.error for r in rows} == {scoring.OUT_OF_TIME} and sum(sent(notes).values()) == 30


def test_equal_and_null_requests(spark, tmp_path, notes):
    rows = [("r1", "c", "q")] * 3 + [("r1", "c", "p"), (None, None, "n")]
    random.Random(4).shuffle(rows)
    asked = spark.createDataFrame(rows, REQUESTS)
    asked = asked.withColumn("key", asked.repo)  # a column of that name is left aside

    def score(batch):
        with open(f"{notes}/sends", "a") as note:
            note.write("x" * len(batch))
        return batch.assign(raw_content=batch["request"], tokens_used=None, model="m")

    found = scoring.review_resumable(asked, score, str(tmp_path / "ledger")).collect()
    assert Counter(r.raw_content for r in found) == Counter({"q": 3, "p": 1, "n": 1})
    assert sent(notes)["sends"] == 3 and {r.tokens_used for r in found} == {None}
    assert scoring.review_resumable(asked.limit(0), score, str(tmp_path / "other")).isEmpty()
