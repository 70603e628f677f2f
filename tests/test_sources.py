from __future__ import annotations

import os

from pyspark.sql import functions as F

from auditloom.functions import paths, text
from auditloom.operators import rules
from auditloom.operators.facts import extract_facts
from auditloom.sources import tree
from auditloom.sources.tables import read_table


def test_tree(spark, tmp_path):
    files = {
        "src/__init__.py": b"", "src/a.py": b"x = 1\r\n", "_top.py": b"y\xff", "setup.cfg": b"",
        ".venv/lib/m.py": b"", "src/build/m.py": b"", "builder/b.py": b"z", "src/x.pyc": b"",
    }
    base = tmp_path / "build" / "o" / "r" / ("c" * 40)  # ignored names above the root do not count
    for name, content in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content)
    listing = tree.list_tree(spark, str(tmp_path / "build"))
    got = {r.file_path: r for r in tree.decoded(tree.read_contents(listing, 3)).collect()}
    assert set(got) == {"src/__init__.py", "src/a.py", "_top.py", "builder/b.py"}
    assert got["src/a.py"].content == "x = 1\n"
    assert got["_top.py"].content == "y�"
    assert {(r.repo, r.commit_sha) for r in got.values()} == {("o/r", "c" * 40)}
    assert got["src/a.py"].size_bytes == 7


def test_empty_tree(spark, tmp_path):
    assert tree.read_contents(tree.list_tree(spark, str(tmp_path))).count() == 0


def test_tree_of_odd_files(spark, tmp_path):
    root, base = tmp_path / "root", tmp_path / "root" / "o" / "r" / "c"
    (base / "src").mkdir(parents=True)
    (tmp_path / "outside.py").write_text("password = 'hunter2xyz'")
    (base / "src" / "a.py").write_text("x = 1\n")
    (base / "data.bin").write_bytes(b"1234567890")
    os.symlink("a.py", base / "src" / "inside.py")
    os.symlink("nowhere.py", base / "src" / "dangling.py")
    os.symlink(tmp_path / "outside.py", base / "src" / "leaves.py")
    os.symlink(tmp_path, base / "folder.py")
    with open(os.path.join(os.fsencode(base), b"odd\xff.py"), "wb") as file:
        file.write(b"y = 2\n")
    listing = tree.list_files(spark, str(root), 3).cache()
    assert tree.snapshot_bytes(listing).first().size_bytes == 28  # the link inside counts, too
    rows = tree.decoded(tree.read_contents(tree.list_tree(spark, str(root), 3), 2)).collect()
    assert {r.file_path: r.content for r in rows} == {
        "src/a.py": "x = 1\n", "src/inside.py": "x = 1\n", "src/dangling.py": None,
        "src/leaves.py": None, "folder.py": None, "odd\ufffd.py": "y = 2\n",
    }
    facts = extract_facts(tree.decoded(tree.read_contents(tree.list_tree(spark, str(root), 3), 2)))
    assert rules.files_failed(facts).first().failed_files == 3


def test_decode(spark):
    raws = [b"abc", b"\xff\xfe", b"a\xc3(b", "é\r\n\rx".encode(), b"\xe2\x82", b"", b"\xf0\x9f\x98\x80"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, b binary")
    rows = df.select("i", text.decode_source(F.col("b")).alias("t")).orderBy("i").collect()
    for row, raw in zip(rows, raws):
        want = raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        assert row.t == want


def test_scan_and_targets(spark):
    rows = [("r", "c", p) for p in ("a.py", "venv/a.py", "env.py", "a.txt", "x/.git/y.py")]
    files = spark.createDataFrame(rows, "repo string, commit_sha string, file_path string")
    assert {r.file_path for r in tree.scanned(files).collect()} == {"a.py", "env.py"}
    wanted = files.filter("file_path LIKE 'venv%' OR file_path = 'a.txt'")
    assert {r.file_path for r in tree.targeted(files, wanted).collect()} == {"venv/a.py"}


def test_relative(spark):
    row = spark.createDataFrame([("/x/y/z.py", "/x/")], "p string, r string").select(
        paths.relative_to(F.col("p"), F.col("r")), paths.relative_to(F.col("p"), F.lit("/q"))
    ).first()
    assert tuple(row) == ("y/z.py", None)


def test_tables(spark, tmp_path):
    spark.createDataFrame([("u1", "a@x")], "id string, email string").write.parquet(str(tmp_path / "users"))
    row = read_table(spark, str(tmp_path), "users").first()
    assert (row.id, row.email, row.is_active) == ("u1", "a@x", None)
