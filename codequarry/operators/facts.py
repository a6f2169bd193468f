"""Syntax facts: one parse of each file, one row of nested facts for each file.

This is the only Python on the way: what a tree holds is emitted raw (kinds, arities, levels, names), and weights,
thresholds, joins and orders are Catalyst's. Facts that belong to one function or class are nested in it, so most rules
need neither join nor shuffle. A file that doesn't parse keeps its row, with parse_error set and no facts.

Each evaluation of the facts parses anew: persist or write them before several rules read them. What one rule alone
reads is told by `only`; the rest is then neither gathered nor sent to the JVM.
"""

from __future__ import annotations

import ast
import gc
import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_POINTS = "array<struct<kind:string,arity:int>>"
SCHEMA = f"""rel string, parse_error string,
    functions array<struct<ord:int,name:string,start_line:int,end_line:int,points:{_POINTS},levels:array<int>>>,
    classes array<struct<ord:int,name:string,line:int,members:array<struct<name:string,instance:boolean,points:{_POINTS}>>,stores:array<string>>>,
    decls array<struct<name:string,line:int>>, refs array<string>,
    imports array<struct<ord:int,line:int,plain:boolean,module:string,level:int,aliases:array<string>>>,
    literals array<struct<ord:int,line:int,key:string,hex:boolean,free:boolean,n:int>>, const_spans array<struct<start:int,end:int>>,
    tests array<struct<ord:int,label:string,line:int,signals:array<struct<kind:string,root:string,attr:string>>>>"""
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_KINDS = {getattr(ast, k): v for k, v in {"If": "if", "IfExp": "ternary", "While": "while", "For": "for", "AsyncFor": "for", "ExceptHandler": "except", "match_case": "case"}.items()}
_COMPREHENSIONS = tuple(getattr(ast, k) for k in "GeneratorExp ListComp DictComp SetComp".split())
_BLOCKS = tuple(getattr(ast, k) for k in "Try TryStar With AsyncWith While For AsyncFor If".split())
_PLAIN = frozenset("arg attr conversion ctx id kind level lineno module op ops rest simple tag type_comment".split())
_CONSTANT = re.compile("_?[A-Z][_0-9A-Z]*")
_COLOR = re.compile("0[Xx][a-fA-F0-9]{6,8}")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def decision_points(body: list[ast.stmt]) -> list[dict]:
    """Decision points of a function's body; nested functions, with their decorators and defaults, are left out."""
    out, open_ = [], list(body)
    while open_:
        node = open_.pop()
        if isinstance(node, _DEFS):
            continue
        if (kind := _KINDS.get(type(node))) is not None:
            out.append({"kind": kind, "arity": 1})
        elif isinstance(node, ast.BoolOp):
            out.append({"kind": "bool", "arity": len(node.values)})
        elif isinstance(node, _COMPREHENSIONS):
            out.append({"kind": "comprehension", "arity": len(node.generators)})
        open_.extend(ast.iter_child_nodes(node))
    return out


def block_levels(body: list[ast.stmt]) -> list[int]:
    """The level of every block of statements; the body's own is 1, an exception handler's two more than its try's."""
    out, open_ = [], [(body, 1)]
    while open_:
        block, level = open_.pop()
        out.append(level)
        for s in block:
            if isinstance(s, ast.Match):
                open_ += [(c.body, level + 1) for c in s.cases]
            elif isinstance(s, _BLOCKS):
                inner = [s.body, getattr(s, "orelse", None), getattr(s, "finalbody", None)]
                open_ += [(b, level + 1) for b in inner if b]
                open_ += [(h.body, level + 2) for h in getattr(s, "handlers", ())]
    return out


def _functions(tree: ast.Module) -> list[dict]:
    """Functions reached through classes and functions alone. A class adds its name to the chain; within a function the
    chain begins anew with that function's bare name."""
    out: list[dict] = []

    def visit(node: ast.AST, chain: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, chain + child.name + ".")
            elif isinstance(child, _DEFS):
                own = {"ord": len(out), "name": chain + child.name, "start_line": child.lineno, "end_line": child.end_lineno or child.lineno}
                out.append(own | {"points": decision_points(child.body), "levels": block_levels(child.body)})
                visit(child, child.name + ".")

    visit(tree, "")
    return out


def _classes(nodes: list[ast.AST]) -> list[dict]:
    out = []
    for node in nodes:
        if not isinstance(node, ast.ClassDef):
            continue
        members, stores = [], []
        for m in node.body:
            if not isinstance(m, _DEFS):
                continue
            instance = not any(isinstance(d, ast.Name) and d.id in ("classmethod", "staticmethod") for d in m.decorator_list)
            members.append({"name": m.name, "instance": instance, "points": decision_points(m.body)})
            if instance:
                stores += [a.attr for a in ast.walk(m) if isinstance(a, ast.Attribute) and isinstance(a.ctx, ast.Store) and isinstance(a.value, ast.Name) and a.value.id == "self"]
        out.append({"ord": len(out), "name": node.name, "line": node.lineno, "members": members, "stores": stores})
    return out


def _names(tree: ast.Module, nodes: list[ast.AST]) -> tuple[list[dict], list[str]]:
    """Names declared by single targets at module level, and names that occur anywhere but as a target there."""
    decls, targets = [], set()
    for s in tree.body:
        if isinstance(s, (*_DEFS, ast.ClassDef)):
            decls.append({"name": s.name, "line": s.lineno})
            continue
        to = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        plain = [t for t in to if isinstance(t, ast.Name)]
        targets.update(map(id, plain))
        if len(to) == 1 and plain:
            decls.append({"name": plain[0].id, "line": s.lineno})
    return decls, sorted({n.id for n in nodes if isinstance(n, ast.Name) and id(n) not in targets})


def _imports(nodes: list[ast.AST]) -> list[dict]:
    out = []
    for n in nodes:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            plain = isinstance(n, ast.Import)
            out.append({"ord": len(out), "line": n.lineno, "plain": plain, "module": None if plain else n.module, "level": 0 if plain else n.level or 0, "aliases": [a.name for a in n.names]})
    return out


def _literals(nodes: list[ast.AST], source: str, spans: list[dict]) -> list[dict]:
    """Literals but booleans, None, and strings that name a field: dictionary keys, indexes, patterns. Free ones lie on
    lines that no span covers; n is how many free literals of the file have the key."""
    fields, constants = set(), []
    for n in nodes:
        kind = type(n)
        if kind is ast.Constant:
            constants.append(n)
        elif kind is ast.Dict:
            fields.update(map(id, n.keys))
        elif kind is ast.Subscript:
            fields.add(id(n.slice))
        elif kind is ast.MatchValue:
            fields.add(id(n.value))
    lines: list[bytes] = []

    def lexeme(n: ast.Constant) -> str:
        if not lines:
            lines.extend(x.encode() for x in _LINE.findall(source))
        first, last = n.lineno - 1, n.end_lineno - 1
        if first == last:
            return lines[first][n.col_offset : n.end_col_offset].decode()
        return b"".join([lines[first][n.col_offset :], *lines[first + 1 : last], lines[last][: n.end_col_offset]]).decode()

    spanned = {line for s in spans for line in range(s["start"], s["end"] + 1)}
    found = []
    for n in constants:
        value = n.value
        if isinstance(value, str):
            if id(n) not in fields:
                found.append((n.lineno, value, False))
        elif value is not None and not isinstance(value, bool):
            key = lexeme(n)
            found.append((n.lineno, key, isinstance(value, int) and _COLOR.fullmatch(key) is not None))
    counts = Counter(key for line, key, _ in found if line not in spanned)
    out = []
    for line, key, color in found:
        free = line not in spanned
        # a lone surrogate has no UTF-8
        text = key if key.isascii() else key.encode("utf-8", "replace").decode()
        out.append({"ord": len(out), "line": line, "key": text, "hex": color, "free": free, "n": counts[key] if free else 0})
    return out


def _constant_spans(tree: ast.Module, nodes: list[ast.AST]) -> list[dict]:
    """Lines of the values that module and class bodies give to names in capitals."""
    out = []
    for body in (tree.body, *(n.body for n in nodes if isinstance(n, ast.ClassDef))):
        for s in body:
            if isinstance(s, (ast.Assign, ast.AnnAssign)) and s.value is not None:
                names = [t.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]
                if names and all(map(_CONSTANT.fullmatch, names)):
                    out.append({"start": s.value.lineno, "end": s.value.end_lineno})
    return out


def _signals(body: list[ast.stmt]) -> list[dict]:
    out = []
    for s in body:
        for n in ast.walk(s):
            if isinstance(n, ast.Assert):
                out.append({"kind": "assert", "root": "", "attr": ""})
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
                root = n.func.value
                out.append({"kind": "attribute", "root": root.id if isinstance(root, ast.Name) else "", "attr": n.func.attr})
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
                out.append({"kind": "name", "root": "", "attr": n.func.id})
    return out


def _tests(tree: ast.Module) -> list[dict]:
    """Bodies of functions named test_*, in the module or in classes within classes."""
    out: list[dict] = []

    def visit(node: ast.AST, chain: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, chain + child.name + ".")
            elif isinstance(child, _DEFS) and child.name.startswith("test_"):
                out.append({"ord": len(out), "label": chain + child.name, "line": child.lineno, "signals": _signals(child.body)})

    visit(tree, "")
    return out


@cache
def _inner(kind: type[ast.AST]) -> tuple[str, ...]:
    """Fields of a kind of node that may hold nodes worth a visit."""
    return () if kind in (ast.Name, ast.Constant, ast.alias) else tuple(f for f in kind._fields if f not in _PLAIN)


def _breadth_first(tree: ast.Module) -> list[ast.AST]:
    """All nodes but operators and contexts, which hold nothing."""
    out: list[ast.AST] = [tree]
    for node in out:  # grows as it is read
        held = node.__dict__
        for name in _inner(type(node)):
            child = held.get(name)
            if not child:
                continue
            if isinstance(child, list):
                out += [x for x in child if isinstance(x, ast.AST)]
            elif isinstance(child, ast.AST):
                out.append(child)
    return out


def _spanned_literals(tree: ast.Module, nodes: list[ast.AST], source: str) -> tuple[list[dict], list[dict]]:
    spans = _constant_spans(tree, nodes)
    return _literals(nodes, source, spans), spans


#: Columns and what gathers them from a tree, its nodes and its source.
_GATHER = (
    (("functions",), lambda tree, nodes, source: (_functions(tree),)),
    (("classes",), lambda tree, nodes, source: (_classes(nodes),)),
    (("decls", "refs"), lambda tree, nodes, source: _names(tree, nodes)),
    (("imports",), lambda tree, nodes, source: (_imports(nodes),)),
    (("literals", "const_spans"), _spanned_literals),
    (("tests",), lambda tree, nodes, source: (_tests(tree),)),
)


def extract(source: str | None, only: Collection[str] | None = None) -> dict:
    """All facts of one file, or at least those of the columns `only`; parse_error alone if it doesn't parse, is too deep
    for the parser or for what is gathered, or is null."""
    if source is None:
        return {"parse_error": "unreadable"}
    try:
        tree = ast.parse(source)
        nodes = _breadth_first(tree)
        out: dict = {"parse_error": None}
        for columns, gather in _GATHER:
            if only is None or any(c in only for c in columns):
                out.update(zip(columns, gather(tree, nodes, source)))
        return out
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"parse_error": f"{type(e).__name__}: {e}"}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """What pa.array gives, a column for each field: several times faster than by dicts. Structs are never null here."""
    if pa.types.is_list(kind):
        ends = list(accumulate((len(v or ()) for v in values), initial=0))
        offsets = [None if v is None else at for v, at in zip(values, ends)] + ends[-1:]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _column([x for v in values for x in v or ()], kind.value_type), type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)


def _gathered(contents: list[str | None], only: Collection[str] | None) -> list[dict]:
    # trees are no cycles: looking for some among them takes a third of the parser's time
    paused = gc.isenabled()
    gc.disable()
    try:
        return [extract(c, only) for c in contents]
    finally:
        if paused:
            gc.enable()


def facts(files: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """SCHEMA's columns (rel, parse_error and those in `only`, if it is given) for each row of files (rel, content).
    Filter paths before: the parser runs on what is given."""
    whole = T._parse_datatype_string(SCHEMA)
    if unknown := set(only or ()) - set(whole.names):
        raise ValueError(f"no such facts: {sorted(unknown)}")
    schema = T.StructType([f for f in whole if only is None or f.name in ("rel", "parse_error", *only)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rels, contents = batch.column("rel").to_pylist(), batch.column("content").to_pylist()
            # few files at a time: facts take more room than their source
            for at in range(0, len(rels), 256):
                found = _gathered(contents[at : at + 256], only)
                columns = [rels[at : at + 256] if f.name == "rel" else [x.get(f.name) for x in found] for f in arrow]
                yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return files.select("rel", "content").mapInArrow(run, schema)
