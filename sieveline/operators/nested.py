"""Deeply nested JSON records into related flat tables.

Each record is read by a streaming parser, token by token and without a tree, into *triples* (node, field,
value) with the ordinal of the node inside its array; triples are grouped by their repeated ancestor
(``readResults``, ``readResults.pages`` ...) and every group is pivoted into one flat table whose rows
carry the key of their parent. The columns of a table are the fields found in its group.

Shapes that count as the same part:

* an array of objects; null elements give no row but keep their position,
* a lone object in place of an array, which is element 0,
* an array written as JSON text.

Defined results for odd input: a null payload, a payload that is not JSON (also one with NaN) and a
payload without nested objects give no nodes. Nesting may be of any depth. Of a key that occurs twice in an
object the last value counts. A repeated record gives its nodes under each of its ids. Extra columns of the
input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = (
    "source_table string, record_id bigint, group_path string, parent_path string, node_path string, "
    "ordinal int, field string, value string, value_type string"
)

#: Rows that a batch of triples may hold before it is handed back to Spark.
FLUSH_ROWS = 20_000


def _no_constant(name: str):
    raise ValueError(name)


def _text(value: str) -> str:
    """A string that can be written as UTF-8 (JSON escapes can spell lone surrogates)."""
    return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


_BLANK = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?").match
_LITERALS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


class _NotJson(Exception):
    pass


class _RepeatedKey(Exception):
    pass


def _plain(value: object) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return ("true" if value else "false"), "boolean"
    if isinstance(value, (int, float)):
        return json.dumps(value), "number"
    return _text(value), "string"


class _Object:
    """An open object: its node, and the key whose value comes next."""

    __slots__ = ("group", "parent", "node", "ordinal", "key", "keys")

    def __init__(self, group: str, parent: str | None, node: str, ordinal: int):
        self.group, self.parent, self.node, self.ordinal = group, parent, node, ordinal
        self.key, self.keys = "", set()


class _Array:
    """An open array: whose part it is, how many elements came, and its plain values while it has no objects."""

    __slots__ = ("outer", "group", "parent", "path", "place", "values", "nested")

    def __init__(self, outer: _Object | _Array | None, group: str, parent: str | None, path: str | None):
        self.outer, self.group, self.parent, self.path = outer, group, parent, path
        self.place, self.values, self.nested = 0, [], False

    def path_of(self) -> str:
        """Where the array lies; for arrays inside arrays it is put together only when an object needs it."""
        steps, array = [], self
        while array.path is None:
            array = array.outer
            steps.append(f"[{array.place}]")
        return array.path + "".join(reversed(steps))


def _stream(text: str, rows: list[tuple], outermost: _Object | _Array | None, labelled: bool) -> _Array | None:
    """Appends the triples of one JSON text while it is read. With ``outermost`` the text must be an array, a part of that object."""
    open_parts: list[_Object | _Array] = []
    at, end = _BLANK(text, 0).end(), len(text)
    part: _Object | _Array | None = None
    first = True
    while True:
        # Here a value begins, or, behind an opening bracket, the part may end at once.
        c = text[at : at + 1]
        closing = first and part is not None and c == ("}" if type(part) is _Object else "]")
        if not closing:
            if type(part) is _Object:
                if c != '"':
                    raise _NotJson
                try:
                    key, at = scanstring(text, at + 1)
                except ValueError:
                    raise _NotJson from None
                if text[at : at + 1] <= " ":
                    at = _BLANK(text, at).end()
                if text[at : at + 1] != ":":
                    raise _NotJson
                if key in part.keys:
                    raise _RepeatedKey
                part.keys.add(key)
                part.key = _text(key)
                at += 1
                c = text[at : at + 1]
                if c <= " ":
                    at = _BLANK(text, at).end()
                    c = text[at : at + 1]
            if c == "{" or c == "[":
                if part is None:
                    group, parent, path, place = "", None, "", 0
                    if outermost is not None:
                        if c == "{":
                            raise _NotJson
                        group, parent, path = outermost.group, outermost.parent, outermost.path
                elif type(part) is _Object:
                    label = labelled and part.parent is None and not part.node
                    name = "*" if label else part.key
                    group, parent, place = (f"{part.group}.{name}" if part.group else name), part.node, 0
                    path = f"{part.node}.{part.key}" if part.node else part.key
                    if c == "{" and not label:
                        path += "[0]"
                else:
                    group, parent, place = part.group, part.parent, part.place
                    path = f"{part.path_of()}[{place}]" if c == "{" else None
                    part.nested = part.nested or c == "{"
                open_parts.append(part)
                if c == "{":
                    part = _Object(group, parent, path, place)
                    rows.append((group, parent, path, place, "", None, "node"))
                else:
                    part = _Array(part, group, parent, path)
                at, first = _BLANK(text, at + 1).end(), True
                continue
            if c == '"':
                try:
                    value, at = scanstring(text, at + 1)
                except ValueError:
                    raise _NotJson from None
            elif c in _LITERALS and c:
                word, value = _LITERALS[c]
                if not text.startswith(word, at):
                    raise _NotJson
                at += len(word)
            else:
                m = _NUMBER(text, at)
                if not m:
                    raise _NotJson
                value = float(m.group()) if m.group(2) or m.group(3) else int(m.group(1)) if len(m.group(1)) < 4000 else m.group(1)
                at = m.end()
            if type(part) is _Object:
                _put(part, value, rows)
            elif part is not None:
                part.values.append(value)
        # Here a value or an empty part is complete; parts that end with it are closed.
        first = False
        while True:
            c = text[at : at + 1]
            if c <= " ":
                at = _BLANK(text, at).end()
                c = text[at : at + 1]
            if part is None:
                if at != end:
                    raise _NotJson
                return None
            if c == ",":
                at += 1
                if text[at : at + 1] <= " ":
                    at = _BLANK(text, at).end()
                if type(part) is _Array:
                    part.place += 1
                break
            if c != ("}" if type(part) is _Object else "]"):
                raise _NotJson
            at += 1
            done, part = part, open_parts.pop()
            if type(done) is _Array:
                if part is None and outermost is not None:
                    if _BLANK(text, at).end() != end:
                        raise _NotJson
                    return done
                if type(part) is _Array:
                    part.nested = part.nested or done.nested
                    if not done.nested:
                        part.values.append(done.values)
                elif type(part) is _Object and not done.nested:
                    rows.append((part.group, part.parent, part.node, part.ordinal, part.key, _text(json.dumps(done.values, ensure_ascii=False)), "array"))


def _put(part: _Object, value: object, rows: list[tuple]) -> None:
    """A plain value of an object, or the array that its text spells."""
    if type(value) is str and value.lstrip(" \t\n\r").startswith("["):
        group = f"{part.group}.{part.key}" if part.group else part.key
        inner = _Array(None, group, part.node, f"{part.node}.{part.key}" if part.node else part.key)
        found: list[tuple] = []
        try:
            array = _stream(value, found, inner, False)
        except (_NotJson, _RepeatedKey):
            array = None
        if array is not None and array.nested:
            rows.extend(found)
            return
    text, kind = _plain(value)
    rows.append((part.group, part.parent, part.node, part.ordinal, part.key, text, kind))


def record_triples(payload: str | None, labelled_root: bool) -> list[tuple]:
    """(group, parent, node, ordinal, field, value, type) of one payload, in document order.

    A row with field '' announces the node itself, so that an object without fields has a row too.
    With ``labelled_root`` the keys of the record are labels: an object below one is the node of
    that name, in the group ``*``.
    """
    rows: list[tuple] = []
    try:
        if payload is not None:
            _stream(payload, rows, None, labelled_root)
    except _NotJson:
        return []
    except _RepeatedKey:
        try:
            return record_triples(json.dumps(json.loads(payload, parse_constant=_no_constant)), labelled_root)
        except (ValueError, RecursionError):
            return []
    return rows


def triples(
    df: DataFrame, source: str, id_col: str = "record_id", payload_col: str = "payload", labelled_root: bool = False
) -> DataFrame:
    """Path-value-ordinal triples of every record, one row per plain field and one per node.

    No shuffle: each task parses the records of its own split and hands the triples on in batches.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in TRIPLES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for key, payload in zip(batch["k"], batch["p"]):
                for group, parent, node, ordinal, field, value, kind in record_triples(payload, labelled_root):
                    rows.append((source, key, group, parent, node, ordinal, field, value, kind))
                    if len(rows) >= FLUSH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    keyed = df.select(F.col(id_col).cast("bigint").alias("k"), F.col(payload_col).cast("string").alias("p"))
    return keyed.where("k is not null and p is not null").mapInPandas(parse, TRIPLES)


def struct_payload(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """A nested column as a JSON payload, so that typed and textual records take one path."""
    payload = F.to_json(F.struct(F.col(column)), {"ignoreNullFields": "false"})
    return df.select(F.col(id_col).alias("record_id"), F.when(F.col(column).isNotNull(), payload).alias("payload"))


def nodes(found: DataFrame) -> DataFrame:
    """One row per nested object; the record itself is no nested object."""
    return found.where("field = '' and parent_path is not null").select(
        "source_table", "record_id", "parent_path", "node_path"
    )


@dataclass(frozen=True)
class TableSpec:
    """One flat table: its group, and the columns it has in any case (name -> (field, SQL type))."""

    group: str
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)


def _column_name(name: str, taken: set[str]) -> str:
    """The field in small letters with underscores; a name that is taken gets a number."""
    plain = re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).lower().strip("_") or "field"
    found, n = plain, 2
    while found in taken:
        found, n = f"{plain}_{n}", n + 1
    return found


def derived_columns(found: DataFrame, spec: TableSpec) -> dict[str, tuple[str, str]]:
    """The columns of a group: those of ``spec``, then every other field that its triples hold, typed by its values.

    Whole numbers become ``bigint`` (``decimal(38,0)`` where they are wider), numbers ``double``, mixed types ``string``.
    A part that has a table of its own is no column, unless somewhere it holds a value that is neither null nor an
    empty array. One row per field name comes to the driver, because a table's columns must be known there.
    """
    value = F.col("value")
    child = F.concat(F.lit(f"{spec.group}." if spec.group else ""), F.col("field"))
    kinds = (
        found.where((F.col("group_path") == spec.group) & (F.col("field") != ""))
        .groupBy("field")
        .agg(
            F.count_if(F.col("value_type").isin("string", "array")).alias("texts"),
            F.count_if(F.col("value_type") == "boolean").alias("booleans"),
            F.count_if(F.col("value_type") == "number").alias("numbers"),
            F.count_if((F.col("value_type") == "number") & ~value.rlike(r"^-?\d+$")).alias("fractions"),
            F.count_if((F.col("value_type") == "number") & (F.length("value") > 18)).alias("wide"),
            F.count_if(value.isNotNull() & (value != "[]")).alias("filled"),
        )
        .join(found.where("field = ''").select(F.col("group_path").alias("_child")).distinct(), child == F.col("_child"), "left")
        .collect()
    )
    columns, known = dict(spec.columns), {f for f, _ in spec.columns.values()}
    taken = {"source_table", "record_id", "parent_path", "node_path", "ordinal", *columns}
    for row in sorted(kinds, key=lambda r: r["field"]):
        if row["field"] in known or row["_child"] is not None and not row["filled"]:
            continue
        if row["texts"] or row["booleans"] and row["numbers"] or not row["booleans"] and not row["numbers"] or row["fractions"] and row["wide"]:
            kind = "string"
        else:
            kind = "boolean" if row["booleans"] else "double" if row["fractions"] else "decimal(38,0)" if row["wide"] else "bigint"
        name = _column_name(row["field"], taken)
        taken.add(name)
        columns[name] = (row["field"], kind)
    return columns


def pivot_group(found: DataFrame, spec: TableSpec, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The triples of one group pivoted into one row per node, with a column for every field of the group.

    Partial aggregation combines the fields of a node before the shuffle. Values that do not cast to the type that
    ``spec`` declares become null (numbers written as text do cast). The group is read twice: ``stored`` cuts its lineage.
    """
    below = (F.col("field") == "") & F.col("group_path").startswith(f"{spec.group}." if spec.group else "")
    kept = stored(found.where((F.col("group_path") == spec.group) | below))
    columns = derived_columns(kept, spec)
    group = kept.where(F.col("group_path") == spec.group)
    picks = [F.max(F.when(F.col("field") == name, F.col("value"))).try_cast(kind).alias(alias) for alias, (name, kind) in columns.items()]
    keys = ["source_table", "record_id", "node_path", "ordinal"]
    parent = F.max("parent_path").alias("parent_path")
    return group.groupBy(*keys).agg(parent, *picks).select(*keys[:2], "parent_path", *keys[2:], *columns)


def group_fields(found: DataFrame) -> DataFrame:
    """Which fields occur in which group, with the number of nodes and of non-null values."""
    return (
        found.where("field <> ''")
        .groupBy("source_table", "group_path", "field")
        .agg(F.count(F.lit(1)).alias("nodes"), F.count("value").alias("present"))
    )
