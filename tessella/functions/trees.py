"""JSON records of any depth: walked in one scan, validated against a schema, searched for secrets.

Records are parsed once in Arrow batches and walked with a work list, so neither depth nor width is limited by a plan
or a stack.  Invalid JSON has no values; a repeated key is walked as often as it is there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Members(list):
    """An object's (key, value) pairs in order."""


class Number(str):
    """A number as it is written."""


def _no_constant(name: str):
    raise ValueError(f"not JSON: {name}")


_DECODER = json.JSONDecoder(object_pairs_hook=Members, parse_int=Number, parse_float=Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:"])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """As ``parsed`` for records that are nested more deeply than the decoder's stack: a stack of its own."""
    root: list = []
    stack, at, expect = [(root, "value")], 0, "value"
    keys: list = []
    while True:
        token = _TOKEN.match(text, at)
        if not token:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("not JSON")
            break
        at = token.end()
        mark, number, word = token.groups()
        holder, kind = stack[-1]
        if mark == '"':
            value, at = scanstring(text, at)
        elif number is not None:
            value = Number(number)
        elif word:
            value = _WORDS[word]
        if mark is None or mark == '"':
            if expect == "key" and mark == '"' or expect == "key or end" and mark == '"':
                keys.append(value)
                expect = "colon"
                continue
            if expect not in ("value", "value or end"):
                raise ValueError("not JSON")
        elif mark in "{[":
            if expect not in ("value", "value or end"):
                raise ValueError("not JSON")
            value = Members() if mark == "{" else []
        elif mark == ":" and expect == "colon":
            expect = "value"
            continue
        elif mark == "," and expect == "next" and len(stack) > 1:
            expect = "key" if kind == "object" else "value"
            continue
        elif mark == "}" and kind == "object" and expect in ("next", "key or end") or mark == "]" and kind == "array" and expect in ("next", "value or end"):
            stack.pop()
            expect = "next"
            continue
        else:
            raise ValueError("not JSON")
        holder.append((keys.pop(), value) if kind == "object" else value)
        expect = "next"
        if mark and mark in "{[":
            stack.append((value, "object" if mark == "{" else "array"))
            expect = "key or end" if mark == "{" else "value or end"
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("not JSON")
    return root[0]


def parsed(text: str | None):
    """(whether ``text`` is JSON, its value)."""
    if text is None:
        return False, None
    try:
        try:
            return True, _DECODER.decode(text)
        except RecursionError:
            return True, _deep(text)
    except ValueError:
        return False, None


def scalar(value) -> str | None:
    """A scalar as text."""
    return None if value is None else "true" if value is True else "false" if value is False else str(value)


def leaves(value) -> Iterator[tuple[str, object]]:
    """(path, scalar) in order; the path of the record itself is ``$``."""
    stack = [("$", value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, Members):
            stack += [(f"{path}.{k}", v) for k, v in reversed(value)]
        elif isinstance(value, list):
            stack += [(f"{path}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
        else:
            yield path, value


def _expanded(rows: DataFrame, key: str, column: str, fields: list[tuple[str, str]], of) -> DataFrame:
    """(key, *fields) for every tuple that ``of(text)`` yields."""
    kind = dict(rows.dtypes)[key]
    types = [pa.int32() if t == "int" else pa.string() for _, t in fields]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in of(text):
                    at.append(i)
                    out.append(row)
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], [key, *[n for n, _ in fields]])

    schema = ", ".join([f"`{key}` {kind}", *[f"{n} {t}" for n, t in fields]])
    return rows.select(F.col(key), F.col(column).cast("string")).mapInArrow(run, schema)


def walk(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value): every scalar in the JSON of ``column``, with where it is, at any depth."""

    def of(text):
        good, value = parsed(text)
        return [(p, scalar(v)) for p, v in leaves(value)] if good else []

    return _expanded(rows, key, column, [("path", "string"), ("value", "string")], of)


# --- schemas --------------------------------------------------------------------------------------


def kind_of(value) -> str:
    if isinstance(value, Members):
        return "object"
    if isinstance(value, list):
        return "array"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "integer" if float(value).is_integer() else "number"
    return "string"


def _fits(kind: str, wanted: str) -> bool:
    return kind == wanted or kind == "integer" and wanted == "number"


def _plain(value):
    """A comparable form: numbers by value, objects without order."""
    if isinstance(value, Members):
        return ("object", tuple(sorted((k, _plain(v)) for k, v in value)))
    if isinstance(value, list):
        return ("array", tuple(map(_plain, value)))
    if isinstance(value, Number):
        return ("number", float(value))
    return (kind_of(value), value)


class Check:
    """A node of a compiled schema: what its value must be, and the checks of what is inside."""

    def __init__(self, schema: dict, at: str = "#"):
        known = {"type", "required", "properties", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern"}
        if unknown := sorted(set(schema) - known - {"title", "description", "$schema", "$id", "default"}):
            raise ValueError(f"{at}: not supported: {', '.join(unknown)}")
        kinds = schema.get("type")
        self.kinds = [kinds] if isinstance(kinds, str) else kinds
        self.required = schema.get("required", [])
        self.inside = {k: Check(s, f"{at}/{k}") for k, s in schema.get("properties", {}).items()}
        more = schema.get("additionalProperties", True)
        self.others = Check(more, f"{at}/*") if isinstance(more, dict) else None
        self.closed = more is False
        self.items = Check(schema["items"], f"{at}/[]") if "items" in schema else None
        as_value = lambda v: _plain(_DECODER.decode(json.dumps(v)))
        self.allowed = [as_value(v) for v in schema["enum"]] if "enum" in schema else None
        self.const = [as_value(schema["const"])] if "const" in schema else None
        self.bounds = schema.get("minimum"), schema.get("maximum")
        self.lengths = {"string": (schema.get("minLength"), schema.get("maxLength")), "array": (schema.get("minItems"), schema.get("maxItems"))}
        self.pattern = re.compile(schema["pattern"]) if "pattern" in schema else None

    def errors(self, value) -> list[tuple[str, str]]:
        """(path, error) of a value, by path in the order of the record; missing keys after what is there."""
        out, stack = [], [("$", value, self)]
        while stack:
            path, value, check = stack.pop()
            kind = kind_of(value)
            if check.kinds and not any(_fits(kind, k) for k in check.kinds):
                out.append((path, f"{kind} instead of {' or '.join(check.kinds)}"))
                continue
            if check.const and _plain(value) != check.const[0]:
                out.append((path, "not the constant"))
            if check.allowed is not None and _plain(value) not in check.allowed:
                out.append((path, "not among the values allowed"))
            if kind in ("integer", "number"):
                low, high = check.bounds
                if low is not None and float(value) < low or high is not None and float(value) > high:
                    out.append((path, "out of bounds"))
            if kind in check.lengths:
                low, high = check.lengths[kind]
                if low is not None and len(value) < low or high is not None and len(value) > high:
                    out.append((path, "length out of bounds"))
            if kind == "string" and check.pattern and not check.pattern.search(value):
                out.append((path, "pattern not found"))
            if kind == "object":
                names = {k for k, _ in value}
                out += [(f"{path}.{k}", "missing") for k in check.required if k not in names]
                if check.closed:
                    out += [(f"{path}.{k}", "not expected") for k, _ in value if k not in check.inside]
                stack += [(f"{path}.{k}", v, c) for k, v in reversed(value) if (c := check.inside.get(k) or check.others)]
            elif kind == "array" and check.items:
                stack += [(f"{path}[{i}]", value[i], check.items) for i in range(len(value) - 1, -1, -1)]
        return out


def schema_errors(rows: DataFrame, key: str, column: str, schema: dict) -> DataFrame:
    """(key, path, error): all that is wrong with the JSON of ``column``; records that are right have no row.

    ``schema`` has JSON Schema's type, required, properties, additionalProperties, items, enum, const, and bounds of numbers,
    lengths and patterns; any other keyword is an error when it is compiled.  Text that is no JSON, or null, is one error at ``$``.
    """
    Check(schema)  # a wrong schema fails here, not in a task
    made: list[Check] = []

    def of(text):
        if not made:
            made.append(Check(schema))
        good, value = parsed(text)
        return made[0].errors(value) if good else [("$", "no JSON")]

    return _expanded(rows, key, column, [("path", "string"), ("error", "string")], of)


# --- secrets --------------------------------------------------------------------------------------


def spans(text: str, patterns: dict[str, str], pairs: dict[str, tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(kind, start, end): every match of each pattern; a pair's first pattern counts only if its second is in the text too."""
    out = [(kind, m.start(), m.end()) for kind, p in patterns.items() for m in re.finditer(p, text)]
    for kind, (first, second) in pairs.items():
        if re.search(second, text):
            out += [(kind, m.start(), m.end()) for m in re.finditer(first, text)]
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def text_findings(rows: DataFrame, key: str, column: str, patterns: dict[str, str], pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(key, kind, start, end) of secrets in texts, in code points; only texts with a match of any pattern reach Python."""
    pairs = pairs or {}
    any_ = "|".join(f"(?:{p})" for p in [*patterns.values(), *[first for first, _ in pairs.values()]])
    some = rows.where(F.col(column).rlike(any_))
    return _expanded(some, key, column, [("kind", "string"), ("start", "int"), ("end", "int")], lambda t: spans(t or "", patterns, pairs))


def record_findings(rows: DataFrame, key: str, column: str, patterns: dict[str, str], pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(key, path, kind, start, end) of secrets in the texts of JSON records."""
    pairs = pairs or {}

    def of(text):
        good, value = parsed(text)
        if good:
            for path, v in leaves(value):
                if isinstance(v, str):
                    for kind, start, end in spans(v, patterns, pairs):
                        yield path, kind, start, end

    return _expanded(rows, key, column, [("path", "string"), ("kind", "string"), ("start", "int"), ("end", "int")], of)


def guarded(rows: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """``rows``, reading which fails where one of ``columns`` has a match of a pattern.

    The check is a part of the expression that writes the column, so it can't be skipped and needs no second pass;
    Spark's commit protocol then leaves nothing of the write.  The error names column, kind and place, not the secret.
    """
    made = {}
    for c in columns:
        out = F.col(c)
        for kind, pattern in reversed(patterns.items()):
            at = F.regexp_instr(F.col(c), F.lit(pattern))
            said = F.concat(F.lit(f"secret in {c}: {kind} at "), at.cast("string"))
            out = F.when(F.col(c).rlike(pattern), F.raise_error(said).cast(dict(rows.dtypes)[c])).otherwise(out)
        made[c] = out
    return rows.withColumns(made)
