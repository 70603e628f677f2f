"""Rules on small modules, and facts against a plain walk over real ones."""

from __future__ import annotations

import ast
import inspect
import json.decoder
import argparse
import asyncio.base_events
import textwrap

import pytest

from auditloom import fixed
from auditloom.operators.facts import extract_facts
from auditloom.operators.rules import files_analyzed, rule_findings


def found(files, max_lines=5, max_complexity=3):
    return rule_findings(extract_facts(files), max_lines, max_complexity).orderBy("seq").collect()


CASES = {
    "long function": ("""
        def brew():
            heat()
            grind()
            pour()
            wait()
            stir()
            return cup()
        """, "AST-A001", "medium", "architecture", 1),
    "short function": ("def sip():\n    return drop()\n", "AST-A001", None, None, 0),
    "no docstring": ("def public(x: int) -> int:\n    return x\n", "AST-Q002", "low", "quality", 1),
    "private": ("def _private(x):\n    return x\n", "AST-Q002", None, None, 0),
    "docstring": ('def f(x: int) -> int:\n    """Doc."""\n    return x\n', "AST-Q002", None, None, 0),
    "no hints": ('def mix(milk, tea):\n    """D."""\n    return tea\n', "AST-Q003", "low", "quality", 1),
    "hints": ('def cool(cup: int) -> float:\n    """D."""\n    return cup / 2\n', "AST-Q003", None, None, 0),
    "self is skipped": ("class A:\n    def f(self) -> int: return 1\n", "AST-Q003", None, None, 0),
    "cls is not": ("class A:\n    def f(cls) -> int: return 1\n", "AST-Q003", "low", "quality", 1),
    "init needs no result": ("class A:\n    def __init__(self): pass\n", "AST-Q003", None, None, 0),
    "keyword-only is free": ("def f(*a, k=1, **kw) -> int: return 1\n", "AST-Q003", None, None, 0),
    "generic names": ("def f():\n    temp = g()\n    data = h(temp)\n", "AST-Q004", "low", "quality", 2),
    "module level names": ("temp = 1\n", "AST-Q004", None, None, 0),
    "other targets": ("def f():\n    x, y = 1, 2\n    z: int = 1\n    n += 1\n", "AST-Q004", None, None, 0),
    "nested is told twice": ("def f():\n    def g():\n        x = 1\n", "AST-Q004", "low", "quality", 2),
    "chained targets": ("def f():\n    x = tmp = 1\n", "AST-Q004", "low", "quality", 2),
    "complex": ("""
        def f(a, b, c, d):
            if a:
                if b:
                    if c:
                        if d:
                            return True
        """, "AST-Q005", "high", "quality", 1),
    "boolean operands": ("def f(a):\n    return a and a and a or a\n", "AST-Q005", "high", "quality", 1),
    "ternary is free": ("def f(a):\n    return 1 if a else 2 if a else 3 if a else 4\n",
                        "AST-Q005", None, None, 0),
    "wildcard": ("from os.path import *\nfrom typing import Optional\n", "AST-Q001", "medium", "quality", 1),
    "bare except": ("try:\n    f()\nexcept:\n    pass\n", "AST-S001", "high", "security", 1),
    "named except": ("try:\n    f()\nexcept ValueError:\n    pass\n", "AST-S001", None, None, 0),
    "sql f-string": ('c.execute(f"select {u}")\n', "AST-S002", "critical", "security", 1),
    "sql plus": ('c.executemany("select " + u)\n', "AST-S002", "critical", "security", 1),
    "sql percent": ('m.raw("select %s" % u)\n', "AST-S002", "critical", "security", 1),
    "sql parameters": ('c.execute("select %s", (u,))\n', "AST-S002", None, None, 0),
    "sql format": ('c.execute("select {}".format(u))\n', "AST-S002", None, None, 0),
    "sql keyword": ('c.execute(query=f"select {u}")\n', "AST-S002", None, None, 0),
    "sql bare name": ('execute(f"select {u}")\n', "AST-S002", None, None, 0),
}


@pytest.fixture(scope="module")
def case_findings(spark):
    rows = [("o/r", "c", f"{name}.py", textwrap.dedent(case[0])) for name, case in CASES.items()]
    files = spark.createDataFrame(
        rows, "repo string, commit_sha string, file_path string, content string"
    )
    return found(files)


@pytest.mark.parametrize("name", CASES)
def test_case(case_findings, name):
    _, rule, severity, category, count = CASES[name]
    hits = [f for f in case_findings if f.file_path == f"{name}.py" and f.rule_id == rule]
    assert len(hits) == count
    assert all((f.severity, f.category) == (severity, category) for f in hits)


def test_texts(source):
    rows = found(source({"m.py": "from . import *\ndef f(a, b):\n    return a\n"}))
    texts = {r.rule_id: r.description for r in rows}
    assert "'from None import *'" in texts["AST-Q001"]
    assert texts["AST-Q003"] == (
        "In 'f': parameters without type hint: a, b; result type not annotated."
    )


def test_bad_files_are_counted_but_for_errors(source):
    deep = "x = " + "-" * 200_000 + "1\n"
    files = source({"ok.py": "a = 1\n", "bad.py": "def broken(\n", "deep.py": deep, "empty.py": ""})
    status = {
        r.file_path: r.parse_status
        for r in extract_facts(files).filter("kind = 'file'").collect()
    }
    assert status["ok.py"] == status["empty.py"] == "ok"
    assert status["bad.py"] == "syntax_error"
    assert status["deep.py"] in {"error", "syntax_error"}
    counted = files_analyzed(extract_facts(files)).first().files_analyzed
    assert counted == 4 - (status["deep.py"] == "error")


def test_emission_order(source):
    text = '''
    from os import *
    def outer(a):
        x = 1
        def inner(b):
            tmp = 2
        try:
            c.execute(f"q")
        except:
            pass
    def second():
        pass
    '''
    rows = found(source({"m.py": text}), max_lines=2, max_complexity=1)
    order = [(r.rule_id, r.line_start) for r in rows]
    assert order == [
        ("AST-Q001", 2),
        ("AST-A001", 3), ("AST-Q002", 3), ("AST-Q003", 3),
        ("AST-Q004", 4), ("AST-Q004", 6), ("AST-Q005", 3),
        ("AST-Q002", 11), ("AST-Q003", 11),
        ("AST-Q002", 5), ("AST-Q003", 5), ("AST-Q004", 6),
        ("AST-S001", 9), ("AST-S002", 8),
    ]


def plain_findings(text, max_lines, max_complexity):
    """(rule, line, end) per finding, one walk per question."""
    out = []
    tree = ast.parse(text)
    for fn in ast.walk(tree):
        if isinstance(fn, ast.ImportFrom):
            out += [("AST-Q001", fn.lineno, fn.end_lineno) for a in fn.names if a.name == "*"]
        if isinstance(fn, ast.ExceptHandler) and not fn.type:
            out.append(("AST-S001", fn.lineno, fn.end_lineno))
        if isinstance(fn, ast.Call) and getattr(fn.func, "attr", None) in fixed.SQL_METHODS:
            arg = fn.args[0] if fn.args else None
            if isinstance(arg, ast.JoinedStr) or (
                isinstance(arg, ast.BinOp) and type(arg.op) in (ast.Add, ast.Mod)
            ):
                out.append(("AST-S002", fn.lineno, fn.end_lineno))
        if not isinstance(fn, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        span = (fn.lineno, fn.end_lineno)
        inside = list(ast.walk(fn))
        branches = sum(type(n).__name__ in {
            "If", "For", "AsyncFor", "While", "With", "AsyncWith", "ExceptHandler", "Assert",
            "comprehension",
        } for n in inside) + sum(len(n.values) - 1 for n in inside if isinstance(n, ast.BoolOp))
        if span[1] - span[0] + 1 > max_lines:
            out.append(("AST-A001", *span))
        if branches + 1 > max_complexity:
            out.append(("AST-Q005", *span))
        if fn.name[0] != "_" and ast.get_docstring(fn, clean=False) is None:
            out.append(("AST-Q002", *span))
        bare = [a for a in fn.args.args if a.arg != "self" and not a.annotation]
        if bare or (not fn.returns and fn.name != "__init__"):
            out.append(("AST-Q003", *span))
        for n in inside:
            if isinstance(n, ast.Assign):
                out += [("AST-Q004", n.lineno, n.end_lineno) for t in n.targets
                        if getattr(t, "id", None) in fixed.GENERIC_NAMES]
    return sorted(out)


def test_real_modules(source):
    modules = [json.decoder, argparse, asyncio.base_events, inspect, textwrap, ast]
    texts = {m.__name__ + ".py": inspect.getsource(m) for m in modules}
    rows = found(source(texts), 20, 10)
    for path, text in texts.items():
        ours = sorted((r.rule_id, r.line_start, r.line_end) for r in rows if r.file_path == path)
        assert ours == plain_findings(text, 20, 10)


def test_rules_read_the_facts_once(source):
    files = source({"m.py": "def f(): pass\n"})
    plan = rule_findings(extract_facts(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_thresholds(source):
    text = "def f(a: int) -> int:\n    '''D'''\n    if a:\n        return 1\n    return 2\n"
    assert {r.rule_id for r in found(source({"m.py": text}), 4, 1)} == {"AST-A001", "AST-Q005"}
    assert not found(source({"m.py": text}), 5, 2)


def test_constants_in_rank_order():
    assert fixed.SEVERITIES == ["critical", "high", "medium", "low", "info"]
    assert len(fixed.GENERIC_NAMES) == 20
