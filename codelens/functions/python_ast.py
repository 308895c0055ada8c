"""One pass over Python source: what a row's code defines, names and uses.

This is the only step Spark's own expressions cannot do. It is an Arrow UDF:
only the code column travels to the Python worker, every other column of the row
stays in the JVM, and a query that uses none of the results never runs it.
"""

from __future__ import annotations

import ast
import gc
import sys
import typing
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship this module inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OK = "ok"
SYNTAX = "syntax_error"
OTHER = "other_error"

ANALYSIS_TYPE = (
    "struct<status:string,error:string,has_function:boolean,has_class:boolean,"
    "has_import:boolean,n_names:int,n_meaningful:int,"
    "findings:array<struct<kind:string,name:string>>>"
)

_FINDING = pa.struct([("kind", pa.string()), ("name", pa.string())])
_FIELDS = [
    ("status", pa.string()),
    ("error", pa.string()),
    ("has_function", pa.bool_()),
    ("has_class", pa.bool_()),
    ("has_import", pa.bool_()),
    ("n_names", pa.int32()),
    ("n_meaningful", pa.int32()),
    ("findings", pa.list_(_FINDING)),
]

# Families of nodes without anything to count in or below them.
_EMPTY = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.type_ignore, ast.Constant)


def _walked_fields(kind: type) -> tuple[str, ...]:
    """The fields of a node kind that can lead to nodes worth a visit, last first.

    Python 3.13 declares the types of fields; before, all fields are looked at.
    """
    declared = getattr(kind, "_field_types", {})

    def leads_on(field: str) -> bool:
        if field not in declared:
            return True
        kinds = typing.get_args(declared[field]) or (declared[field],)
        return any(issubclass(k, ast.AST) and not issubclass(k, _EMPTY) for k in kinds)

    return tuple(field for field in reversed(kind._fields) if leads_on(field))


_WALKED = {
    kind: _walked_fields(kind)
    for kind in vars(ast).values()
    if isinstance(kind, type) and issubclass(kind, ast.AST) and not issubclass(kind, _EMPTY)
}


def inspect_code(code: str) -> tuple:
    """Status, error, three flags, two name counts and the ordered findings.

    Findings are the distinct (kind, name) pairs in the order a depth-first walk
    meets them, parents before children. The walk keeps its own stack, so deep
    nesting cannot exhaust Python's.
    """
    try:
        tree = ast.parse(code)
    except SyntaxError as problem:
        return SYNTAX, str(problem), False, False, False, 0, 0, ()
    except Exception as problem:
        return OTHER, str(problem), False, False, False, 0, 0, ()

    has_function = has_class = has_import = False
    n_names = n_meaningful = 0
    findings: dict[tuple[str, str], None] = {}
    pending = [tree]
    while pending:
        node = pending.pop()
        kind = type(node)
        if kind is ast.Name:
            n_names += 1
            if len(node.id) > 2 and node.id[0] != "_":
                n_meaningful += 1
            continue
        fields = _WALKED.get(kind)
        if fields is None:  # not a node of a listed kind
            continue
        if kind is ast.Attribute:
            findings["attribute", node.attr] = None
        elif kind is ast.Call:
            if type(node.func) is ast.Name:
                findings["call", node.func.id] = None
        elif kind is ast.Import:
            has_import = True
            for item in node.names:
                findings["import", item.name.partition(".")[0]] = None
        elif kind is ast.ImportFrom:
            has_import = True
            if node.module:
                findings["import", node.module.partition(".")[0]] = None
        elif kind is ast.FunctionDef:
            has_function = True
        elif kind is ast.ClassDef:
            has_class = True
        # Pushed last to first, so that the first child is on top of the stack.
        for field in fields:
            below = getattr(node, field, None)
            if type(below) is list:
                pending += below[::-1]
            elif below is not None:
                pending.append(below)
    return OK, None, has_function, has_class, has_import, n_names, n_meaningful, tuple(findings)


def analyse_batch(codes: pa.Array) -> pa.Array:
    """Analyse one Arrow batch, parsing each distinct text in it once."""
    distinct = codes.dictionary_encode()
    # Syntax trees have no cycles; collecting them one by one only costs time.
    collecting = gc.isenabled()
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            rows = [inspect_code(text or "") for text in distinct.dictionary.to_pylist()]
    finally:
        if collecting:
            gc.enable()
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns[:-1], _FIELDS[:-1])]

    offsets, kinds, names = [0], [], []
    for findings in columns[-1]:
        for kind, name in findings:
            kinds.append(kind)
            names.append(name)
        offsets.append(len(names))
    pairs = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(names, pa.string())], fields=list(_FINDING)
    )
    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs))
    table = pa.StructArray.from_arrays(arrays, names=[name for name, _ in _FIELDS])
    return table.take(distinct.indices)


def analysis(code: Column) -> Column:
    """The analysis struct of a non-null code column.

    Marked non-deterministic so that the optimizer never runs the parser twice
    for one row, for instance once for a filter and once for a projection.
    """
    return F.arrow_udf(analyse_batch, ANALYSIS_TYPE).asNondeterministic()(code)
