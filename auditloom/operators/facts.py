"""Syntax facts: one pass over every source file, one row per fact."""

from __future__ import annotations

import ast
import warnings
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom import fixed
from auditloom.schemas import FACTS, FILE_KEY

# A fact's `seq` orders the findings of one file: section, function, slot within the
# function, then a running number.
SECTION, FUNCTION, SLOT = 1 << 60, 1 << 36, 1 << 32
_IMPORTS, _FUNCTIONS, _HANDLERS, _CALLS = range(4)
ASSIGN_SLOT = 3

_FILES_PER_BATCH = 500

_DEFINITIONS = frozenset({ast.FunctionDef, ast.AsyncFunctionDef})
_BRANCHES = frozenset({
    ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith,
    ast.ExceptHandler, ast.Assert, ast.comprehension,
})
_NOTED = _DEFINITIONS | _BRANCHES | {ast.BoolOp, ast.ImportFrom, ast.Assign, ast.Call}
# nodes that tell nothing and have nothing below them
_LEAVES = frozenset({
    ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue,
    *ast.expr_context.__subclasses__(), *ast.operator.__subclasses__(),
    *ast.unaryop.__subclasses__(), *ast.boolop.__subclasses__(), *ast.cmpop.__subclasses__(),
})


class _Function:
    """A function on the way from the module to a node."""

    __slots__ = ("node", "outer", "order", "complexity")

    def __init__(self, node: ast.AST, outer: _Function | None, order: int) -> None:
        self.node, self.outer, self.order, self.complexity = node, outer, order, 1

    def enclosing(self) -> Iterator[_Function]:
        scope = self
        while scope is not None:
            yield scope
            scope = scope.outer


def _argument_kind(node: ast.expr) -> str:
    if isinstance(node, ast.JoinedStr):
        return "fstring"
    if isinstance(node, ast.BinOp):
        return {ast.Add: "add", ast.Mod: "mod"}.get(type(node.op), "other")
    return "other"


def _has_doc(node: ast.AST) -> bool:
    match node.body[0]:
        case ast.Expr(value=ast.Constant(value=str())):
            return True
    return False


def _function_fact(scope: _Function) -> dict:
    node = scope.node
    return {
        "kind": "function",
        "seq": _FUNCTIONS * SECTION + scope.order * FUNCTION,
        "line": node.lineno,
        "end_line": node.end_lineno,
        "name": node.name,
        "has_doc": _has_doc(node),
        "missing_params": [
            a.arg for a in node.args.args if a.annotation is None and a.arg != "self"
        ],
        "has_return": node.returns is not None,
        "complexity": scope.complexity,
    }


def file_facts(text: str, names: frozenset[str], methods: frozenset[str]) -> list[dict]:
    """Facts of one parsed file, from a single breadth-first walk."""
    found: list[dict] = []
    scopes: list[_Function] = []

    def note(kind: str, at: int, node: ast.AST, **more: object) -> None:
        found.append({
            "kind": kind, "seq": at + len(found),
            "line": node.lineno, "end_line": node.end_lineno, **more,
        })

    def look(node: ast.AST, kind: type, scope: _Function | None) -> None:
        if kind is ast.ImportFrom:
            for alias in node.names:
                if alias.name == "*":
                    note("import_from", _IMPORTS * SECTION, node,
                         name="*", module=str(node.module))
        elif kind is ast.Assign and scope:
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id in names:
                    for around in scope.enclosing():
                        at = (_FUNCTIONS * SECTION + around.order * FUNCTION
                              + ASSIGN_SLOT * SLOT)
                        note("assign", at, node, name=target.id, fn_name=around.node.name)
        elif kind is ast.ExceptHandler:
            if node.type is None:
                note("handler", _HANDLERS * SECTION, node, is_bare=True)
        elif kind is ast.Call and node.args and isinstance(node.func, ast.Attribute):
            if node.func.attr in methods:
                note("call", _CALLS * SECTION, node,
                     name=node.func.attr, arg0_kind=_argument_kind(node.args[0]))

    queue: deque[tuple[ast.AST, _Function | None]] = deque([(ast.parse(text), None)])
    while queue:
        node, scope = queue.popleft()
        kind = type(node)
        if kind in _NOTED:
            if kind in _DEFINITIONS:
                scope = _Function(node, scope, len(scopes))
                scopes.append(scope)
            weight = kind in _BRANCHES
            if kind is ast.BoolOp:
                weight = len(node.values) - 1
            if weight and scope:
                for around in scope.enclosing():
                    around.complexity += weight
            look(node, kind, scope)
        for name in kind._fields:
            below = getattr(node, name, None)
            if type(below) is list:
                queue.extend(
                    (child, scope) for child in below
                    if isinstance(child, ast.AST) and type(child) not in _LEAVES
                )
            elif isinstance(below, ast.AST) and type(below) not in _LEAVES:
                queue.append((below, scope))

    return found + [_function_fact(scope) for scope in scopes]


def _file_rows(text: str | None, names: frozenset[str], methods: frozenset[str]) -> list[dict]:
    """A `file` row with the parse status, then the file's facts. Never raises."""
    try:
        facts, status = file_facts(text, names, methods), "ok"
    except SyntaxError:
        facts, status = [], "syntax_error"
    except Exception:  # one bad file must not stop the job
        facts, status = [], "error"
    return [{"kind": "file", "seq": -1, "parse_status": status}, *facts]


def extract_facts(
    files: DataFrame,
    names: Iterable[str] = fixed.GENERIC_NAMES,
    methods: Iterable[str] = fixed.SQL_METHODS,
) -> DataFrame:
    """Facts of all files.

    `files` has repo, commit_sha, file_path and decoded text in `content`. Rows are independent,
    so partitions follow files and a large repository is read by many tasks.
    """
    watched_names, watched_methods = frozenset(names), frozenset(methods)
    types = {f.name: f.dataType for f in FACTS.fields}
    columns = [name for name in types if name not in FILE_KEY]
    arrow = {
        "kind": pa.string(), "seq": pa.int64(), "line": pa.int32(), "end_line": pa.int32(),
        "name": pa.string(), "fn_name": pa.string(), "module": pa.string(),
        "is_bare": pa.bool_(), "has_doc": pa.bool_(),
        "missing_params": pa.list_(pa.string()), "has_return": pa.bool_(),
        "complexity": pa.int32(), "arg0_kind": pa.string(), "parse_status": pa.string(),
    }

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for whole in batches:
                for start in range(0, whole.num_rows, _FILES_PER_BATCH):
                    batch = whole.slice(start, _FILES_PER_BATCH)
                    rows: list[dict] = []
                    owners: list[int] = []
                    for i, text in enumerate(batch.column("content")):
                        facts = _file_rows(text.as_py(), watched_names, watched_methods)
                        rows += facts
                        owners += [i] * len(facts)
                    taken = batch.select(FILE_KEY).take(pa.array(owners, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        taken.columns
                        + [pa.array([r.get(c) for r in rows], arrow[c]) for c in columns],
                        names=[*FILE_KEY, *columns],
                    )

    return files.select(*FILE_KEY, "content").mapInArrow(extract, FACTS)
