"""Deeply nested semi-structured records as related flat tables, by shared inlining.

1. ``schema_graph`` reads every record and gives the graph of its element types: an edge for each (parent, child) key seen, with how
   often the child was repeated, an object or a scalar. Partial sums leave each task, so what is shuffled follows the number of keys.
2. ``relations`` decides on the graph alone: an element type gets a table of its own if it is repeated, reached from several parents
   (shared) or from itself (recursive); every other one is inlined into the table of its nearest ancestor that has one.
3. ``shred`` reads the records again and emits a row an element with its keys: ``clave``, its path in the record, unique there, and the
   ``clave`` and table of the element it lies in; besides, the parent list and position by the rules of ``Shape``.

Records arrive as JSON text in any column. Null texts, texts that are not complete JSON (``NaN`` is none), values without an object and
texts nested deeper than the parser allows give no rows; ``rejects`` has them with their reason, so every record is in one or the other. A list may be written as a list, as JSON text inside a string, as an object whose keys are
numbers (the number is the position), as an object whose keys name the elements (``names``), or as one bare element. Null elements
count in the positions but have no row. Wrappers around the record, of any depth, are looked through.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from ..sources.tables import spread

ROOT = "caso"
#: Children of one element type beyond which its keys are taken for data (an open map), not for element types; those that are lists of
#: the shape, or one in so many of the keys met there, remain element types. What lies under the others is in the table OPEN.
OPEN_KEYS = 300
OPEN = "*"


@dataclass(frozen=True)
class Shape:
    """What a reader knows beforehand: ``lists`` are element types that are lists however they are written; ``names`` has, for a list
    whose elements may be keyed by name, the field that is the name and the field a bare list under the name belongs to; ``owners``
    has the list an element type's parent must be, if the nearest enclosing list isn't it by itself."""

    lists: tuple[str, ...] = ()
    names: dict[str, tuple[str, str]] = field(default_factory=dict)
    owners: dict[str, str] = field(default_factory=dict)


def parsed(text: Any) -> Any:
    """The value of a complete JSON text, else None."""
    return _read(text)[0]


def _read(text: Any) -> tuple[Any, str | None]:
    """(value, None), or None and why there is none."""
    if not isinstance(text, str):
        return None, "nulo"
    if not text or text.isspace():
        return None, "vacío"
    try:
        value = json.loads(text.lstrip("﻿"), parse_constant=_no)
    except _NoNumber:
        return None, "número que no es JSON"
    except ValueError:
        return None, "incompleto"
    except RecursionError:
        return None, "demasiado profundo"
    return _read(value) if isinstance(value, str) else (value, None)


class _NoNumber(ValueError):
    pass


def _no(name: str) -> None:
    raise _NoNumber(name)


def opened(value: Any) -> Any:
    """A string that holds a JSON list or object is that list or object."""
    if isinstance(value, str) and (s := value.strip()) and s[0] + s[-1] in ("[]", "{}"):
        inner = parsed(s)
        return value if inner is None else inner
    return value


def numbered(value: dict) -> bool:
    return bool(value) and all(k.isascii() and k.isdigit() for k in value)


def elements(name: str, value: Any, shape: Shape) -> list[tuple[int, Any]] | None:
    """(position, element) of what stands where the list ``name`` belongs, nulls left out; None if there is no list at all."""
    value = opened(value)
    if value is None:
        return None
    if isinstance(value, list):
        return [(i, opened(x)) for i, x in enumerate(value) if x is not None]
    if isinstance(value, dict):
        if not value:
            return []
        if numbered(value):
            return [(int(k), opened(x)) for k, x in value.items() if x is not None]
        if name in shape.names:
            label, content = shape.names[name]
            if label not in value and content not in value:
                return [(i, _named(label, content, k, opened(x))) for i, (k, x) in enumerate(value.items())]
        return [(0, value)]
    return [(0, value)] if value != "" else []


def _named(label: str, content: str, key: str, value: Any) -> dict:
    if isinstance(value, dict) and not numbered(value) and (content in value or label in value):
        return {label: key} | value
    return {label: key, content: value}


def record_in(value: Any, shape: Shape) -> Any:
    """The shallowest object that itself holds one of the lists; the whole value if none does."""
    level = [value]
    while level:
        below = []
        for node in map(opened, level):
            if isinstance(node, dict):
                if any(k in shape.lists for k in node):
                    return node
                below += node.values()
            elif isinstance(node, list):
                below += node
        level = [x for x in below if isinstance(x, (dict, list, str))]
    return opened(value)


class Element(NamedTuple):
    """One element: its table, the parent by the rules of the shape, its key in the record, and the element it lies in."""

    lista: str
    padre_lista: str | None
    padre_pos: int
    pos: int
    clave: str
    padre_tabla: str | None
    padre_clave: str | None
    valor: Any


class _Node(NamedTuple):
    value: Any
    owner: str  # the nearest list of the shape, and the position in it
    owner_pos: int
    table: str  # the nearest element with a table: its table, position and key
    table_pos: int
    key: str
    path: str
    kind: str | None  # the key of the object itself


def linked(value: Any, shape: Shape, lists: frozenset[str], known: dict[str, frozenset[str]] | None = None) -> Iterator[Element]:
    """Every element of ``lists`` in a record; the record itself, if asked for, has the empty key and no parent. ``known``: of the element
    types that are open maps, the keys that are element types; what is repeated or an object under another key is an element of OPEN."""
    known = known or {}
    record = record_in(value, shape)
    if ROOT in lists and isinstance(record, dict):
        yield Element(ROOT, None, -1, 0, "", None, None, record)
    anchored = frozenset(shape.lists) or lists
    stack = [_Node(value, ROOT, -1, ROOT, -1, "", "", None)]
    while stack:
        n = stack.pop()
        node = opened(n.value)
        if isinstance(node, list):
            stack += [n._replace(value=x, path=f"{n.path}/{i}") for i, x in enumerate(node) if isinstance(x, (dict, list))]
            continue
        if not isinstance(node, dict):
            continue
        kind = ROOT if node is record or node == record and n.kind is None else n.kind
        folds = known.get(kind) if kind is not None and OPEN in lists else None
        for key, child in node.items():
            here = f"{n.path}/{_escaped(key)}"
            if key in lists and not (key == ROOT and opened(child) == record):  # a wrapper may bear the root's name
                wanted = shape.owners.get(key)
                if key not in anchored:
                    owner, owner_pos = n.table, n.table_pos
                else:
                    owner, owner_pos = (n.owner, n.owner_pos) if wanted is None or n.owner == wanted else (ROOT, -1)
                seen: set[str] = set()
                for pos, element in elements(key, child, shape) or ():
                    at = f"{here}/{pos}"
                    while at in seen:  # numbers written in two ways
                        at += "'"
                    seen.add(at)
                    yield Element(key, owner, owner_pos, pos, at, n.table, n.key, element)
                    if isinstance(element, (dict, list)):
                        stack.append(_Node(element, *((key, pos) if key in anchored else (n.owner, n.owner_pos)), key, pos, at, at, key))
                continue
            if folds is not None and key not in folds and isinstance(inner := opened(child), (dict, list)):
                for pos, x in enumerate(inner if isinstance(inner, list) else [inner]):
                    if x is not None:
                        at = f"{here}/{pos}"
                        yield Element(OPEN, n.table, n.table_pos, pos, at, n.table, n.key, {"clave": key, "valor": x})
                        stack.append(_Node(x, n.owner, n.owner_pos, OPEN, pos, at, at, OPEN))
            elif isinstance(child, (dict, list)) or (isinstance(child, str) and child[:1] in ("{", "[") and child[-1:] in ("}", "]")):
                stack.append(n._replace(value=child, path=here, kind=None if kind is None else key))


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def walk(value: Any, shape: Shape, lists: frozenset[str]) -> Iterator[tuple[str, str | None, int, int, Any]]:
    """(list, parent list, parent position, position, element) of every element of ``lists`` in a record; the record itself, if asked
    for, has no parent."""
    for e in linked(value, shape, lists):
        yield e.lista, e.padre_lista, e.padre_pos, e.pos, e.valor


def _edges(value: Any, shape: Shape, counts: dict[tuple[str, str], list[int]]) -> None:
    stack: list[tuple[str, Any]] = [(ROOT, record_in(value, shape))]
    while stack:
        parent, node = stack.pop()
        node = opened(node)
        if isinstance(node, list):
            stack += [(parent, x) for x in node]
        elif isinstance(node, dict):
            for key, child in node.items():
                child = opened(child)
                many = isinstance(child, list) or (isinstance(child, dict) and numbered(child)) or (key in shape.lists and isinstance(child, (dict, str)))
                c = counts[parent, key]
                c[0] += 1
                c[1] += many
                c[2] += isinstance(child, dict) or (many and any(isinstance(x, dict) for x in (child if isinstance(child, list) else ())))
                if many:
                    stack += [(key, x) for _, x in elements(key, child, shape) or ()]
                elif isinstance(child, dict):
                    stack.append((key, child))


def schema_graph(records: DataFrame, column: str, shape: Shape = Shape(), open_keys: int = OPEN_KEYS) -> DataFrame:
    """parent, child, n, n_repeated, n_objects over all records. Of a parent with more than ``open_keys`` keys, those are one child,
    ``*``, that the shape does not name as lists and that are fewer than one in ``open_keys`` of the keys met there; what lies below such
    keys, lists of the shape excepted, is of the same type ``*``. So the graph has a bounded number of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        for pdf in batches:
            for text in pdf[column]:
                if (value := parsed(text)) is not None:
                    _edges(value, shape, counts)
            if len(counts) > 50_000:
                yield _frame(counts)
                counts.clear()
        yield _frame(counts)

    def _frame(counts: dict) -> pd.DataFrame:
        return pd.DataFrame([(p, c, *n) for (p, c), n in counts.items()], columns=["parent", "child", "n", "n_repeated", "n_objects"])

    part = spread(records.select(column), column).mapInPandas(count, "parent string, child string, n long, n_repeated long, n_objects long")
    edges = cut(part.groupBy("parent", "child").agg(*(F.sum(c).alias(c) for c in ("n", "n_repeated", "n_objects"))))  # used twice, made once
    degree = edges.groupBy("parent").agg(F.count("*").alias("__d"), F.sum("n").alias("__n"))
    rare = ~F.col("child").isin(*shape.lists) & (F.col("n") * open_keys < F.col("__n"))
    sums = [F.sum(c).alias(c) for c in ("n", "n_repeated", "n_objects")]
    judged = edges.join(degree, "parent").withColumn("folded", (F.col("__d") > open_keys) & rare)
    # names that are only ever keys of open maps: what lies below them is told from no other
    below = judged.groupBy(F.col("child").alias("parent")).agg(F.bool_and("folded").alias("__below")).filter("__below")
    typed = judged.join(below, "parent", "left").withColumn("__below", F.col("__below").isNotNull())
    named = F.col("child").isin(*shape.lists)
    parent = F.when(F.col("__below"), F.lit(OPEN)).otherwise(F.col("parent"))
    child = F.when(F.col("folded") | (F.col("__below") & ~named), F.lit(OPEN)).otherwise(F.col("child"))
    return typed.select(parent.alias("parent"), child.alias("child"), "n", "n_repeated", "n_objects").groupBy("parent", "child").agg(*sums)


@dataclass(frozen=True)
class Plan:
    """tables: element types with a table; inlined: for each of them the paths of the scalars it takes in, as (column, path). A path that
    ends in ``*`` takes in the open map there: one JSON object of its keys that are not in ``named[column's table, path]``. known: of
    each element type that is an open map, the keys that are element types."""

    tables: tuple[str, ...]
    inlined: dict[str, tuple[tuple[str, tuple[str, ...]], ...]]
    named: dict[tuple[str, tuple[str, ...]], frozenset[str]] = field(default_factory=dict)
    known: dict[str, frozenset[str]] = field(default_factory=dict)


def relations(graph: DataFrame) -> Plan:
    """The tables of a schema graph. The graph has one row a pair of element types, open maps folded: small however large the data."""
    edges = [(r.parent, r.child, r.n_repeated, r.n_objects) for r in graph.collect()]
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    complex_, many = set(), set()
    for p, c, repeated, objects in edges:
        children[p].add(c)
        parents[c].add(p)
        if objects or repeated:
            complex_.add(c)
        if repeated:
            many.add(c)

    def reaches(a: str) -> set[str]:
        seen, todo = set(), [a]
        while todo:
            for c in children[todo.pop()] & complex_:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    # only object types count as shared: a scalar is an attribute of whichever element holds it
    shared = {c for c in complex_ if len(parents[c]) > 1}
    recursive = {c for c in complex_ if c in reaches(c)}
    # what is repeated or an object under the keys of open maps has one table
    tables = tuple(sorted({ROOT} | many | shared | recursive | ({OPEN} & complex_)))
    known = {p: frozenset(cs - {OPEN} | set(tables)) for p, cs in children.items() if OPEN in cs}
    inlined, named = {}, {}
    for t in tables:
        if t == OPEN:
            inlined[t] = (("clave", ("clave",)),)
            continue
        paths, todo = [], [(t, ())]
        while todo:
            node, path = todo.pop()
            for c in sorted(children[node]):
                if (c in tables and c != OPEN) or c in path:
                    continue
                if c == OPEN:
                    named[t, (*path, c)] = frozenset(children[node] | set(tables))
                if c in complex_ and c != OPEN:
                    todo.append((c, (*path, c)))
                else:
                    paths.append(("_".join((*path, c)), (*path, c)))
        inlined[t] = tuple(sorted(paths))
    return Plan(tables, inlined, named, known)


def _at(value: Any, path: tuple[str, ...]) -> Any:
    for p in path:
        if not isinstance(value, dict):
            return None
        value = opened(value.get(p))
    return value


KEYS = "lista string, padre_lista string, padre_pos int, pos int"
LINKS = "clave string, padre_tabla string, padre_clave string, valor map<string,string>"


def shred(records: DataFrame, column: str, key: str, plan: Plan, shape: Shape = Shape(), only: tuple[str, ...] | None = None, values: bool = True) -> DataFrame:
    """key, lista, padre_lista, padre_pos, pos and, with ``values``, clave, padre_tabla, padre_clave and ``valor`` (map of inlined columns
    to text; a bare element under ``valor``). A row for each non-null element of the plan's tables, or of ``only`` of them. Extra columns
    of ``records`` are dropped.

    (key, clave) is unique; (key, padre_clave) is the element the row lies in, in the table padre_tabla, the record itself having the
    empty clave.
    """
    lists = frozenset(t for t in plan.tables if only is None or t in only)
    tracked = frozenset(plan.tables) if values else lists
    schema = T.StructType([records.schema[key], *T._parse_datatype_string(KEYS).fields, *(T._parse_datatype_string(LINKS).fields if values else ())])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[column]):
                if (value := parsed(text)) is None:
                    continue
                for e in linked(value, shape, tracked, plan.known):
                    if e.lista in lists:
                        row = (k, *e[:4])
                        out.append((*row, e.clave, e.padre_tabla, e.padre_clave, _values(e.valor, plan, e.lista)) if values else row)
            yield pd.DataFrame(out, columns=names)

    return spread(records.select(key, column), key).mapInPandas(run, schema)


def rejects(records: DataFrame, column: str, key: str, shape: Shape = Shape()) -> DataFrame:
    """key and motivo of every record without rows: null, blank, incomplete, too deep, or a value without an object. Once a record."""
    schema = T.StructType([records.schema[key], T.StructField("motivo", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[column]):
                value, why = _read(text)
                if why or not isinstance(record_in(value, shape), dict):
                    out.append((k, why or "sin objeto"))
            yield pd.DataFrame(out, columns=schema.names)

    return spread(records.select(key, column), key).mapInPandas(run, schema).distinct()


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _values(element: Any, plan: Plan, lista: str) -> dict[str, str]:
    if lista == OPEN:
        return {"clave": element["clave"], "valor": _text(element["valor"])}
    if not isinstance(element, dict):
        return {"valor": _text(element)}
    got = {}
    for column, path in plan.inlined[lista]:
        if (known := plan.named.get((lista, path))) is not None:
            v = _at(element, path[:-1])
            v = {k: x for k, x in v.items() if k not in known} or None if isinstance(v, dict) else None
        else:
            v = _at(element, path)
        if v is not None:
            got[column] = _text(v)
    return got


def flat_table(rows: DataFrame, plan: Plan, lista: str, key: str) -> DataFrame:
    """One relation of ``shred``: its keys and a column for each inlined scalar. Names that clash with the keys' get ``_``."""
    keys = [key, "clave", "padre_tabla", "padre_clave", "padre_lista", "padre_pos", "pos"]
    columns = [*(c for c, _ in plan.inlined.get(lista, ())), "valor"]  # a list no record has is an empty table
    names = {c: (c + "_" if c in keys else c) for c in dict.fromkeys(columns)}
    return rows.filter(F.col("lista") == lista).select(*keys, *(F.col("valor")[c].alias(n) for c, n in names.items()))


def write_tables(rows: DataFrame, plan: Plan, key: str, folder: str) -> None:
    """Every relation of ``shred`` as Parquet under its name; the records are read once for all of them."""
    rows = cut(rows)
    for t in plan.tables:
        flat_table(rows, plan, t, key).distinct().write.mode("overwrite").parquet(f"{folder}/{'_abierta' if t == OPEN else t}")


#: The case documents senders deliver.
CASE_SHAPE = Shape(
    lists=("transcripcion", "dialogos", "medicamentos", "diagnosticos_secundarios", "sintomas"),
    names={"transcripcion": ("fase", "dialogos")},
    owners={"dialogos": "transcripcion", "medicamentos": "diagnosticos_secundarios", "transcripcion": ROOT, "sintomas": ROOT, "diagnosticos_secundarios": ROOT},
)
