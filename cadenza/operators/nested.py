"""Deeply nested semi-structured records as related flat tables.

Each record's text is read once as a stream of tokens into (path, ordinals, value, kind) rows; paths that share
their last repeated ancestor form a group; each group is pivoted into one table whose rows are named by
the record and the positions of their ancestors, so every child row names its parent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\n\r]*(?:("[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|([{}\[\],:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|NaN\b|-?Infinity\b))', re.S)
_BLANK = re.compile(r"[ \t\n\r]*")


class Unreadable(ValueError):
    """The text is no complete JSON value."""


def _text(token: str) -> str:
    return token[1:-1] if "\\" not in token else json.loads(token)


class _Number(str):
    """A number (or NaN, Infinity) as it is written."""


_decode = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number).decode


def _wanted(path: str, under: Collection[str]) -> bool:
    """Whether ``path`` or something below it lies under one of the paths asked for."""
    return not under or any(path.startswith(u) or u.startswith(path) for u in under)


def _walk(v, path: str, ords: tuple, lists: Collection[str], wrappers: Collection[str], depth: int, under: Collection[str], out: list) -> None:
    """The values of a decoded text, in written order, as _read gives them; what lies beside ``under`` is not entered."""
    if under and not _wanted(path, under):
        return
    if isinstance(v, dict):
        out.append((path, ords, None, "object"))
        for name, x in v.items():
            p = f"{path}.{name}" if path else name
            if type(x) is dict:
                if not path and not ords and name in wrappers:
                    p = ""
                elif name in lists:
                    if _wanted(p, under):
                        out.append((p, ords, None, "list"))
                        _walk(x, f"{p}[]", (*ords, 0), lists, (), depth, under, out)
                    continue
            _walk(x, p, ords, lists, (), depth, under, out)
    elif isinstance(v, list):
        out.append((path, ords, None, "list"))
        p = f"{path}[]"
        for i, x in enumerate(v):
            _walk(x, p, (*ords, i), lists, (), depth, under, out)
    elif v is None:
        out.append((path, ords, None, "null"))
    elif v is True or v is False:
        out.append((path, ords, "true" if v else "false", "bool"))
    elif type(v) is _Number:
        out.append((path, ords, str(v), "number"))
    else:
        inner = v.strip(" \t\r\n﻿") if depth and v[-1:] and v.strip(" \t\r\n﻿")[:1] in ("{", "[", '"') else ""
        if len(inner) > 1 and inner[-1] in ("}", "]", '"'):
            try:
                x = _decode(inner)
            except json.JSONDecodeError:
                x = None
            # A quoted text alone is no encoded value.
            if x is not None and not (inner[0] == '"' and not _holds(x, depth - 1)):
                name = path.rpartition(".")[2]
                if type(x) is dict and name in lists:
                    out.append((path, ords, None, "list"))
                    path, ords = f"{path}[]", (*ords, 0)
                _walk(x, path, ords, lists, wrappers if not path else (), depth - 1, under, out)
                return
        out.append((path, ords, v, "string"))


def _holds(v, depth: int) -> bool:
    """Whether a text that was itself quoted holds an object or a list, perhaps encoded again."""
    if not isinstance(v, str):
        return True
    inner = v.strip(" \t\r\n﻿")
    if not depth or len(inner) < 2 or inner[0] not in '{["' or inner[-1] not in '}]"':
        return False
    try:
        x = _decode(inner)
    except json.JSONDecodeError:
        return False
    return inner[0] != '"' or _holds(x, depth - 1)


def triples(text: str, lists: Collection[str] = (), wrappers: Collection[str] = (), depth: int = 8, under: Collection[str] = ()) -> list[tuple[str, tuple[int, ...], str | None, str]]:
    """(path, ordinals, value, kind) of every value in ``text``, in written order; raises Unreadable.

    A path joins field names by dots and marks a list's elements by []; ordinals are the positions, from 0, in the lists on the
    way. Kinds: object, list, string, number, bool, null (objects and lists have no value). Fields named in ``lists`` are
    lists even where a lone object stands. A field of the root named in ``wrappers`` that holds an object is read as the root itself.
    Strings that hold a whole object or list (encoded again, up to ``depth`` times) are read in place. The last of
    repeated keys in an object counts. A mark of byte order and blanks around the text are skipped.

    With ``under`` only paths that begin with one of these (and their ancestors) are given. Texts nested too deep for the standard scanner
    are read token by token.
    """
    text, out = text.lstrip("﻿"), []
    try:
        v = _decode(text)
        _walk(v, "", (), lists, wrappers, depth, under, out)
    except json.JSONDecodeError as e:
        raise Unreadable(str(e)) from None
    except RecursionError:
        out.clear()
        _read(text, "", (), lists, wrappers, depth, out)
        out = [x for x in out if x is not None and (not under or _wanted(x[0], under))]
    return out


def _read(text: str, path: str, ords: tuple, lists: Collection[str], wrappers: Collection[str], depth: int, out: list) -> None:
    stack: list[list] = []  # per open container: kind, path, ordinals, position, spans by key, key, start of the value
    pos, state = 0, "value"  # what may come: value, first (value or end of list), key, first_key, colon, after
    end = len(text)
    while True:
        if state == "after" and not stack:
            if _BLANK.match(text, pos).end() != end:
                raise Unreadable(f"more text at {pos}")
            return
        m = _TOKEN.match(text, pos)
        if not m:
            raise Unreadable(f"no token at {pos}")
        pos = m.end()
        s, mark, plain = m.groups()
        if state in ("key", "first_key"):
            if s is not None:
                top = stack[-1]
                top[5] = _text(s)
                if top[5] in top[4]:  # the last of repeated keys counts
                    for i in range(*top[4][top[5]]):
                        out[i] = None
                top[6] = len(out)
                state = "colon"
                continue
            if mark != "}" or state == "key":
                raise Unreadable(f"no key at {pos}")
            stack.pop()
            state = "after"
        elif state == "colon":
            if mark != ":":
                raise Unreadable(f"no colon at {pos}")
            state = "value"
            continue
        elif state == "after":
            top = stack[-1]
            if mark == ",":
                if top[0] == "{":
                    state = "key"
                else:
                    top[3] += 1
                    state = "value"
                continue
            if mark != ("}" if top[0] == "{" else "]"):
                raise Unreadable(f"no end at {pos}")
            stack.pop()
        else:  # a value
            if mark == "]" and state == "first":
                stack.pop()
                state = "after"
            elif mark in (",", ":", "}", "]"):
                raise Unreadable(f"no value at {pos}")
            else:
                if not stack:
                    p, o, name = path, ords, path.rpartition(".")[2]
                elif stack[-1][0] == "{":
                    top = stack[-1]
                    name = top[5]
                    p, o = (f"{top[1]}.{name}" if top[1] else name), top[2]
                else:
                    top = stack[-1]
                    p, o, name = f"{top[1]}[]", (*top[2], top[3]), None
                if mark == "{":
                    if len(stack) == 1 and name in wrappers and not stack[0][1]:
                        p = ""
                    elif name in lists:
                        out.append((p, o, None, "list"))
                        p, o = f"{p}[]", (*o, 0)
                    out.append((p, o, None, "object"))
                    stack.append(["{", p, o, 0, {}, None, len(out)])
                    state = "first_key"
                    continue
                if mark == "[":
                    out.append((p, o, None, "list"))
                    stack.append(["[", p, o, 0, {}, None, 0])
                    state = "first"
                    continue
                if s is not None:
                    v = _text(s)
                    inner = v.strip(" \t\r\n﻿")
                    if depth and inner[:1] in ("{", "[", '"') and inner[-1:] in ("}", "]", '"') and len(inner) > 1:
                        at = len(out)
                        try:
                            _read(inner, p, o, lists, wrappers if not p else (), depth - 1, out)
                            if inner[0] == '"' and len(out) == at + 1 and out[at][3] == "string":
                                raise Unreadable("only a quoted text")
                        except Unreadable:
                            del out[at:]
                            out.append((p, o, v, "string"))
                    else:
                        out.append((p, o, v, "string"))
                else:
                    out.append((p, o, None if plain == "null" else plain, "null" if plain == "null" else "bool" if plain in ("true", "false") else "number"))
                state = "after"
        if stack and stack[-1][0] == "{" and stack[-1][5] is not None:
            stack[-1][4][stack[-1][5]] = (stack[-1][6], len(out))


def path_values(records: DataFrame, id_col: str, body_col: str, order_col: str, keep: Collection[str] = (), lists: Collection[str] = (), wrappers: Collection[str] = (), under: Collection[str] = ()) -> DataFrame:
    """(id, <keep>, path, ordinals, value, kind) of every readable record, one delivery of each id; see triples for ``under``.

    Of the deliveries of an id the readable one with the greatest ``order_col`` counts (the last by text on ties);
    equal deliveries are dropped before parsing, so an id delivered very often is not gathered. Null or unreadable bodies and null ids
    give no rows. Output columns of ``keep`` must not be named like the others here.
    """
    keep, under = list(keep), tuple(under)
    r = records.where(F.col(id_col).isNotNull() & F.col(body_col).isNotNull()).groupBy(F.col(id_col).alias("id"), F.col(body_col).alias("__body")).agg(F.max(order_col).alias("__order"), *[F.max(c).alias(c) for c in keep])
    r = r.repartition("id").sortWithinPartitions("id", F.desc("__order"), F.desc("__body"))
    kinds = dict(r.dtypes)
    schema = f"id {kinds['id']}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "path string, ordinals array<int>, value string, kind string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            ids, bodies, times, found = b.column("id").to_pylist(), b.column("__body").to_pylist(), [], []
            for i, body in zip(ids, bodies):
                n = 0
                if i != done:
                    try:
                        t = triples(body, lists, wrappers, under=under)
                    except Unreadable:
                        t = []
                    if t and t[0][3] == "object":
                        done, n = i, len(t)
                        found += t
                times.append(n)
            at = pa.array(np.repeat(np.arange(len(ids)), times))
            path, ords, value, kind = zip(*found) if found else ((), (), (), ())
            flat, ends = [x for o in ords for x in o], np.cumsum([0, *map(len, ords)])
            lists_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("id", *keep)], pa.array(path, pa.string()), lists_, pa.array(value, pa.string()), pa.array(kind, pa.string())], names=["id", *keep, "path", "ordinals", "value", "kind"])

    return r.select("id", "__body", *keep).mapInArrow(parse, schema)


def found_columns(values: DataFrame, most: int = 2000) -> dict[str, list[str]]:
    """group -> the paths below it that hold scalars, in order; more than ``most`` in all (a map with free keys) is an error: give that map a long table."""
    r = values.where("kind not in ('object', 'list', 'null')").select("path").distinct().limit(most + 1).collect()  # names of the schema
    if len(r) > most:
        raise ValueError(f"more than {most} different paths")
    out: dict[str, list[str]] = {}
    for path in sorted(x["path"] for x in r):
        at = path.rfind("[]")
        group = path[: at + 2] if at >= 0 else ""
        out.setdefault(group, []).append(path[len(group) :].lstrip("."))
    return out


def group_of(path_col: str = "path"):
    """The last repeated ancestor of a path: everything up to its last []; '' for values of the record itself."""
    return F.regexp_extract(path_col, r"^(.*\[\])", 1)


def pivot_group(values: DataFrame, group: str, columns: Mapping[str, str], keep: Collection[str] = ()) -> DataFrame:
    """One table: a row for each element of ``group`` (or each record, for ''), a string column for each entry of ``columns``.

    ``columns`` maps output names to paths below the group ('' for an element that is itself a value). Rows carry id,
    ``keep``, ``ordinals`` (their key within the record), ``parent`` (the ordinals of the parent row) and ``pos`` (the
    position in the parent). Elements that are null keep their position but are no row; missing fields are null.
    """
    under = f"{group}." if group else ""
    paths = {n: (under + p if p else group) for n, p in columns.items()}
    v = values.where((group_of() == group) & (F.col("kind") != "null") | (F.col("path") == group) & (F.col("kind") == "object"))
    aggs = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(n) for n, p in paths.items()]
    t = v.groupBy("id", *keep, "ordinals").agg(F.bool_or((F.col("path") == group) & (F.col("kind") == "object")).alias("is_object"), *aggs)
    n = F.size("ordinals")
    return t.select("id", *keep, "ordinals", F.slice("ordinals", 1, F.greatest(n - 1, F.lit(0))).alias("parent"), F.when(n > 0, F.element_at("ordinals", -1)).alias("pos"), "is_object", *columns)
