"""Operators that look at one document at a time: quality rules, token counts, language, URLs."""

from __future__ import annotations

import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import language, mixing, quality, tokens, urls
from auditloom.llm.queries import URL_RULES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t ", "one", "a b c d e f g h", "x\x0by\x0cz\xa0w", "la " * 50, "É é ñ — 漢字 #$",
    "a b c d e f g h i a b c d e f g h j", "l\nl\nl\n\nm n", "w" * 3000, "# * $ % & | < >",
]


def documents(spark, texts, extra="", **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(covered),
    )


def test_measures(spark):
    rng = random.Random(1)
    texts = ODD + [
        " ".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)
    ]
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash"))
    rows = quality.measure(docs).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        assert tuple(row[m] for m in quality.MEASURES) == measured(text), text


def test_policies_and_ablations(spark):
    texts = ["w%d" % i + " word" * 0 for i in range(3)] + [
        " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(30)) + " ####",
        "la " * 40,
    ]
    entries = quality.ledger(documents(spark, texts))
    kept = {r.doc_id: r.kept for r in quality.apply_policy(entries, quality.POLICIES["v2"]).collect()}
    assert kept == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False}
    first = {r.doc_id: r.kept for r in quality.apply_policy(entries, quality.POLICIES["v1"]).collect()}
    assert first[4] and not first[5]
    found = {(r.policy_version, r.rule): (r.n_failed, r.n_only)
             for r in quality.ablations(entries).collect()}
    assert found["v1", "few_words"] == (3, 3)
    assert found["v2", "symbols"] == (1, 1)
    assert found["v2", "repeats"][0] == 1


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert quality.ledger(docs).count() == 0
    assert quality.ablations(quality.ledger(docs)).count() == 0
    assert tokens.count_tokens(docs, vocabulary("piece_bpe_32k.model")).count() == 0
    model = language.fit(docs.withColumn("lang", F.lit("en")))
    assert model.languages == []
    named = language.identify(documents(spark, ["a word", None]), model).collect()
    assert [r.lang_pred for r in named] == ["und", "und"]


def brute_count(model, word):
    """Best score, then fewest tokens, over all segmentations; unknown characters as bytes."""
    path = tokens.START + word
    best = {0: (0.0, 0)}
    for end in range(1, len(path) + 1):
        size = len(path[end - 1].encode())
        s, c = best[end - 1]
        options = [(-(s + tokens.BYTE_SCORE * size), c + size)]
        for start in range(end):
            if path[start:end] in model.scores:
                s, c = best[start]
                options.append((-(s + model.scores[path[start:end]]), c + 1))
        s, c = min(options)
        best[end] = (-s, c)
    return best[len(path)][1]


def test_token_counts(spark):
    model = tokens.Unigram({tokens.START: -3.0, "a": -1.0, "ab": -1.5, "b": -1.2, "aba": -9.0}, 3)
    words = sorted("".join(p) for n in range(1, 6) for p in itertools.product("abé", repeat=n))
    assert tokens.count_words(model, words) == [brute_count(model, w) for w in words]
    real = tokens.zipf_unigram(vocabulary("piece_bpe_32k.model"))
    assert math.isclose(sum(map(math.exp, real.scores.values())), 1, rel_tol=1e-6)
    docs = documents(spark, ODD).withColumn("n_tokens", F.lit("clash"))
    for text, row in zip(ODD, tokens.count_tokens(docs, vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()):
        expected = [brute_count(real, w) for w in WORD.findall(text or "") if len(w) < 50]
        if max(map(len, WORD.findall(text or "")), default=0) < 50:
            assert (row.n_words, row.n_tokens) == (len(expected), sum(expected))


def test_best_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 1, 5, 7, 0, 3])
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
    labels = language.best_paths(scores, lengths, 0.7)
    at = 0
    for n in lengths.tolist():
        own = scores[at : at + n]
        def value(path):
            return sum(own[i, p] for i, p in enumerate(path)) - 0.7 * sum(
                a != b for a, b in zip(path, path[1:]))
        if n:
            best = max(itertools.product(range(3), repeat=n), key=value)
            assert value(tuple(labels[at : at + n])) == pytest.approx(value(best), abs=1e-5)
        at += n


def test_language_spans_and_nulls(spark):
    rows = [(i, "en", "the cat and the dog went with that thing " * 3) for i in range(20)]
    rows += [(100 + i, "de", "und der hund ist nicht über die straße gegangen " * 3) for i in range(20)]
    rows += [(200 + i, "ru", "это русский текст про собаку и кошку " * 3) for i in range(20)]
    rows += [(300, None, "ohne sprache"), (301, "de", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    texts = [
        "the dog and the thing went with that cat " * 4 + "der hund ist über die straße gegangen und nicht " * 2,
        "русский текст", None, "123 !!", "", "漢字",
    ]
    docs = documents(spark, texts).withColumn("lang_pred", F.lit(1))
    found = language.identify(docs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[:5]] == ["en", "ru", "und", "und", "und"]
    assert found[5].lang_pred in model.languages and found[5].lang_score == 0
    assert [s.lang for s in found[0].lang_spans] == ["en", "de"]
    assert 0.5 < found[0].lang_score < 1 and found[1].lang_score == 1 and found[2].lang_score == 0


def test_language_of_any_script(spark):
    """Labelled languages in scripts beyond the common ones; two of them share one."""
    samples = {
        "am": "ሰላም ለሁሉም ሰው ዛሬ ጥሩ ቀን ነው", "ti": "ከመይ ኣለኹም ሎሚ ጽቡቕ መዓልቲ እዩ", "km": "សួស្តី អ្នក ទាំងអស់គ្នា ថ្ងៃនេះ ល្អ",
        "my": "မင်္ဂလာပါ ယနေ့ ကောင်းသော နေ့ ဖြစ်သည်", "lo": "ສະບາຍດີ ທຸກຄົນ ມື້ນີ້ ດີ", "bo": "བཀྲ་ཤིས་ བདེ་ལེགས་ དེ་རིང་", "dv": "އައްސަލާމް ޢަލައިކުމް މިއަދު",
        "chr": "ꭳꮟꮿ ꮳꮃꭹ ꭶꮼꮒꭿꮝꮧ", "ii": "ꆈꌠ ꁱꂷ ꉬꄒ", "vai": "ꕙꔤ ꕚꕌ ꖴꖸ", "sat": "ᱥᱟᱱᱛᱟᱲᱤ ᱯᱟᱹᱨᱥᱤ",
    }
    rows = [(i, "en", "the cat and the dog went with that thing") for i in range(60)]
    rows += [(100 * k + i, lang, text) for k, (lang, text) in enumerate(samples.items(), 1) for i in range(10)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    found = language.identify(documents(spark, list(samples.values())), model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.lang_score) for r in found] == [(lang, 1.0) for lang in samples]


def test_every_letter_has_a_script():
    codes = np.array([c for c in range(0x370, 0x110000) if chr(c).isalpha() and not 0x2000 <= c < 0x2C00])
    assert (language._scripts(codes) > 0).all()
    assert (language._scripts(np.array([0x20, 0x31, 0x2E, 0xB5, 0x2BB, 0x2014, 0x1F600])) == 0).all()


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_language_held_out(spark):
    from auditloom.llm.queries import op4_language_id

    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, FOLDER).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_url_parts_and_rules(spark):
    cases = [
        (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None),
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
        ("https://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/"), ("http://x.net/esp/1", "x.net", "/esp/1", None),
        ("http://net/fr/", "net", "/fr/", "net/fr/"), ("http://xcom/", "xcom", "/", None),
        ("http://b.com", "b.com", "", None), ("http://b.com?x=/y", "b.com", "", None),
        ("a://ÉX.com/É://z", "Éx.com", "/É://z", "com/"), ("x://y://z", "y:", "//z", None),
    ]
    rows = [(i, c[0]) for i, c in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {"label": F.lit(None).cast("boolean"), "host": F.lit("clash"), "purity": F.lit(0)}
    )
    found = urls.judge(pages, URL_RULES).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule) for r in found] == cases
    verdicts = {r.rule: r.verdict for r in found}
    assert verdicts["net/es/"] == "block" and verdicts["com/"] == "allow" and verdicts[None] == "allow"


def test_url_templates(spark):
    rows = [(f"http://h.org/shop/{i}.html", i % 10 != 0) for i in range(200)]
    rows += [(f"http://h.org/bad/{i}", i % 10 == 0) for i in range(200)]
    rows += [(f"http://h.org/similar/{i}", i % 9 != 0) for i in range(100)]
    rows += [("http://h.org/bad/fresh", None), ("http://h.org/shop/fresh.html", None), ("http://h.org/a/b/c/d/e/f/g/h", None)]
    pages = spark.createDataFrame(rows, "url string, label boolean")
    found = {r.url: r for r in urls.judge(pages, ()).collect()}
    assert found["http://h.org/bad/fresh"].verdict == "block"
    assert found["http://h.org/shop/fresh.html"].verdict == "allow"
    assert found["http://h.org/shop/fresh.html"].template == "/shop/*.html"
    assert found["http://h.org/similar/3"].class_node == found["http://h.org/shop/3.html"].class_node
    assert found["http://h.org/a/b/c/d/e/f/g/h"].template == "/a/b/c/d/e/**"
    assert urls.judge(pages.filter("false"), ()).count() == 0


def test_url_branches_at_any_depth(spark):
    """Good and bad branches part at the eighth segment, behind one that is variable."""
    deep = "http://h.org/2024/01/02/news/en/topic"
    rows = [(f"{deep}/{i}/{kind}/x", kind == "good") for i in range(100) for kind in ("good", "bad")]
    rows += [(f"{deep}/7/bad/fresh", None), (f"{deep}/7/good/fresh", None), ("http://h.org/2024", True), (None, None)]
    rows += [("http://h.org/" + "a/" * 30 + "b", None), ("http://h.org/" + "a/" * 30 + "c", None)]
    found = {r.url: r for r in urls.judge(spark.createDataFrame(rows, "url string, label boolean"), ()).collect()}
    assert len(found) == len(rows)
    assert found[f"{deep}/7/bad/fresh"].verdict == "block" and found[f"{deep}/7/good/fresh"].verdict == "allow"
    assert {r.verdict for u, r in found.items() if u and "/bad/" in u} == {"block"}
    assert {r.verdict for u, r in found.items() if u and "/good/" in u} == {"allow"}
    assert found[rows[-1][0]].template == "/" + "a/" * 30 + "c"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_ablations_of_all_documents(spark):
    """The registered report against the ledger's bits, counted one by one."""
    from auditloom.llm.queries import QUERIES

    failed = [r.failed for r in QUERIES["op6_quality_rules"](spark, FOLDER).select("failed").collect()]
    expected = {}
    for policy in quality.POLICIES.values():
        for rule in policy.rules:
            bit, of = quality.mask([rule]), quality.mask(policy.rules)
            expected[policy.version, rule] = (sum(f & bit > 0 for f in failed), sum(f & of == bit for f in failed))
    found = QUERIES["op6_quality_ablations"](spark, FOLDER).collect()
    assert {(r.policy_version, r.rule): (r.n_failed, r.n_only) for r in found} == expected
    assert any(n for n, _ in expected.values())


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_source", "h", "whole", "threshold", "own", "planned", "_row", "_time"]
    docs = spark.createDataFrame(
        [(i, "a b c " * (i % 5), "ab"[i % 2], *names) for i in range(40)],
        "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names),
    ).withColumn("taken", F.lit("replaced"))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 40 and all(r[n] == n for r in mixed for n in names)
    assert all(isinstance(r.taken, int) for r in mixed)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in mixed)
