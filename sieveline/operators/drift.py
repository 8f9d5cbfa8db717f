"""Files whose fields drift between batches: change report and one consistent table.

The header of every file (its leaf paths with their types) is read in parallel. Types are bits, so
folding the headers of a batch is a bitwise or, and the folded mask is a point of a promotion
lattice: ``null`` below ``boolean``, ``number``, ``string`` and ``array``; mixed plain types promote to
``string``, anything with an array to ``array``. Below ``number`` lie whole numbers and fractions: a column of
whole numbers stays exact, one of both is a double unless that would change a wide whole number; then it is text.
The folded headers of neighbouring batches are compared and the differences logged in order.

A path that goes and a path that comes with the same type are a rename if the content goes on: files
that were written in both batches under one name hold the same values. Where no such file shows both,
the paths must be the same words in another spelling.

Paths are dotted, with ``[]`` after an array of objects. Defined results: a null payload, one that is
not JSON or not an object is unreadable and adds nothing; a batch counts as existing when it has a
readable file; null values add the path but no type; repeated rows change nothing; a batch number that
is missing is skipped; two keys that spell one path give a column of arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.operators.nested import _no_constant, _text

BOOLEAN, WHOLE, STRING, ARRAY, FRACTION, WIDE, SEVERAL = 1, 2, 4, 8, 16, 32, 64
NUMBER = WHOLE | FRACTION | WIDE
#: Bits that say which type a value has; SEVERAL only says that a plain path held more than one value.
TYPES = BOOLEAN | STRING | ARRAY | NUMBER
HEADERS = (
    "harness string, file_kind string, batch int, file_name string, path string, mask int, content bigint"
)


def read_object(payload: str | None) -> dict | None:
    """The JSON object of a payload, or None where it is unreadable."""
    if not payload:
        return None
    try:
        value = json.loads(payload, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaves(record: dict) -> dict[str, list]:
    """Path -> its values in document order."""
    found: dict[str, list] = {}
    stack: list[tuple[str, object]] = [("", record)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            below = [(f"{path}.{_text(k)}" if path else _text(k), v) for k, v in value.items()]
            stack.extend(reversed(below))
        elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
            stack.extend((f"{path}[]", x) for x in reversed(value) if isinstance(x, dict))
        else:
            found.setdefault(path, []).append(value)
    return found


def type_bit(value: object) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return WHOLE if abs(value) <= 1 << 53 else WHOLE | WIDE if -(1 << 63) <= value < 1 << 63 else FRACTION | WIDE
    if isinstance(value, float):
        return FRACTION
    return STRING if isinstance(value, str) else ARRAY


def file_headers(files: DataFrame) -> DataFrame:
    """One row per file and leaf path: type mask and a fingerprint of the values (null if all are null)."""
    columns = [c.split()[0] for c in HEADERS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for harness, kind, number, name, payload in zip(*(batch[c] for c in (*columns[:4], "payload"))):
                record = read_object(payload)
                for path, values in leaves(record).items() if record else ():
                    mask = 0
                    for value in values:
                        mask |= type_bit(value)
                    if len(values) > 1 and "[]" not in path:
                        mask |= SEVERAL
                    print_of = blake2b(json.dumps(values).encode(), digest_size=8).digest() if mask & TYPES else None
                    content = int.from_bytes(print_of, "big", signed=True) if print_of else None
                    rows.append((harness, kind, number, name, path, mask, content))
            frame = pd.DataFrame(rows, columns=columns)
            frame["content"] = frame["content"].astype("Int64")
            yield frame

    narrow = files.select("harness", "file_kind", F.col("batch").cast("int").alias("batch"), "file_name", "payload")
    keyed = narrow.where("harness is not null and file_kind is not null and batch is not null and payload is not null")
    return keyed.mapInPandas(read, HEADERS)


def promoted(mask: Column) -> Column:
    """The lattice point of a folded mask; null while only null values were seen."""

    def only(bits: int) -> Column:
        return mask.bitwiseAND(F.lit(TYPES & ~bits)) == 0

    return (
        F.when(only(0), F.lit(None))
        .when(mask.bitwiseAND(F.lit(ARRAY)) != 0, F.lit("array"))
        .when(only(BOOLEAN), F.lit("boolean"))
        .when(only(NUMBER), F.lit("number"))
        .otherwise(F.lit("string"))
    )


def fold(headers: DataFrame, *keys: str) -> DataFrame:
    """Union schema per key: path and promoted type; the fold is combined before the shuffle."""
    folded = headers.groupBy(*keys, "path").agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("n_files"))
    return folded.select(*keys, "path", promoted(F.col("mask")).alias("type"), "n_files")


def _spelling(path: str) -> Column:
    return F.lower(F.regexp_replace(path, r"[^A-Za-z0-9]", ""))


def changes(headers: DataFrame, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """harness, file_kind, batch, change_kind, field_path, new_path, from_batch, old_type, new_type.

    ``headers`` is read twice: hand in a checkpointed or stored table. ``stored`` cuts the lineage of the plain
    differences and of the renames, which are small.
    """
    group = ["harness", "file_kind"]
    step = stored(_differences(fold(headers, *group, "batch")))
    renames = stored(_renames(headers, step))
    base = [*group, "batch", "from_batch"]
    rename_rows = renames.select(
        *base, F.lit("renamed").alias("change_kind"), F.col("old_path").alias("field_path"), "new_path",
        F.col("type").alias("old_type"), F.col("type").alias("new_type"),
    )
    plain = step.select(*base, "change_kind", F.col("path").alias("field_path"), F.lit("").alias("new_path"), "old_type", "new_type")
    sides = F.array(F.struct(F.lit("removed").alias("change_kind"), F.col("old_path").alias("field_path")), F.struct(F.lit("added").alias("change_kind"), F.col("new_path").alias("field_path")))
    taken = renames.select(*group, "batch", F.explode(sides).alias("_s")).select(*group, "batch", "_s.*")
    return plain.join(taken, [*group, "batch", "change_kind", "field_path"], "left_anti").unionByName(rename_rows)


def _differences(schemas: DataFrame) -> DataFrame:
    """Added, removed and retyped paths: each path's batches in order against the batches of its group."""
    group = ["harness", "file_kind"]
    order = W.partitionBy(*group).orderBy("batch")
    around = schemas.select(*group, "batch").distinct().select(*group, "batch", F.lag("batch").over(order).alias("_prev"), F.lead("batch").over(order).alias("_next"))
    of_path = W.partitionBy(*group, "path").orderBy("batch")
    seen = schemas.join(around, [*group, "batch"]).select(
        *group, "batch", "path", "type", "_prev", "_next",
        F.lag("batch").over(of_path).alias("_was"), F.lag("type").over(of_path).alias("_was_type"), F.lead("batch").over(of_path).alias("_will"),
    )

    def row(kind: str, batch: str, before: str, old: Column, new: Column) -> Column:
        return F.struct(F.col(batch).alias("batch"), F.col(before).alias("from_batch"), F.lit(kind).alias("change_kind"), old.alias("old_type"), new.alias("new_type"))

    none, here = F.lit(None).cast("string"), F.col("type")
    told = F.array(
        F.when(F.col("_prev").isNotNull() & (F.col("_was").isNull() | (F.col("_was") < F.col("_prev"))), row("added", "batch", "_prev", none, here)),
        F.when(F.col("_next").isNotNull() & (F.col("_will").isNull() | (F.col("_will") > F.col("_next"))), row("removed", "_next", "batch", here, none)),
        F.when((F.col("_was") == F.col("_prev")) & (F.col("_was_type") != here), row("retyped", "batch", "_prev", F.col("_was_type"), here)),
    )
    return seen.select(*group, "path", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("_c")).select(*group, "path", "_c.*")


def _renames(headers: DataFrame, step: DataFrame) -> DataFrame:
    """Pairs of a gone and a come path whose content goes on, one to one, the best supported first.

    Only the files' values under gone and come paths are looked at; they meet by step and file name, so a
    harness that holds most files is spread over its files.
    """
    group = ["harness", "file_kind"]
    gone = step.where("change_kind = 'removed'").select(*group, "batch", "from_batch", "path", F.col("old_type").alias("type"))
    come = step.where("change_kind = 'added'").select(*group, "batch", "from_batch", "path", F.col("new_type").alias("type"))
    sides = gone.select(*group, F.col("from_batch").alias("_at"), "path", "type", "batch", "from_batch", F.lit(True).alias("_old")).unionByName(
        come.select(*group, F.col("batch").alias("_at"), "path", "type", "batch", "from_batch", F.lit(False).alias("_old"))
    )
    values = headers.where("content is not null").select(*group, F.col("batch").alias("_at"), "file_name", "path", "content")
    where = [*group, "batch", "from_batch", "type"]
    met = (
        values.join(sides, [*group, "_at", "path"])
        .groupBy(*where, "file_name")
        .agg(F.collect_set(F.when(F.col("_old"), F.struct("path", "content"))).alias("_o"), F.collect_set(F.when(~F.col("_old"), F.struct("path", "content"))).alias("_n"))
        .where((F.size("_o") > 0) & (F.size("_n") > 0))
        .withColumn("_o", F.explode("_o"))
        .withColumn("_n", F.explode("_n"))
        .select(*where, F.col("_o.path").alias("old_path"), F.col("_n.path").alias("new_path"), (F.col("_o.content") == F.col("_n.content")).alias("_same"))
    )
    pair = [*where, "old_path", "new_path"]
    shown = met.groupBy(*pair).agg(F.count_if("_same").alias("same"), F.count(F.lit(1)).alias("seen")).withColumn("spelled", F.lit(False))
    spelled = (
        gone.select(*where, F.col("path").alias("old_path"), _spelling("path").alias("_word"))
        .join(come.select(*where, F.col("path").alias("new_path"), _spelling("path").alias("_word")), [*where, "_word"])
        .select(*pair, F.lit(0).cast("bigint").alias("same"), F.lit(0).cast("bigint").alias("seen"), F.lit(True).alias("spelled"))
    )
    both = shown.unionByName(spelled).groupBy(*pair).agg(F.max("same").alias("same"), F.max("seen").alias("seen"), F.max("spelled").alias("spelled"))
    kept = both.where("same = seen and (seen > 0 or spelled)")
    rank = [F.col("same").desc(), F.col("spelled").desc()]
    by_old = W.partitionBy(*group, "batch", "old_path").orderBy(*rank, "new_path")
    by_new = W.partitionBy(*group, "batch", "new_path").orderBy(*rank, "old_path")
    return (
        kept.withColumn("_o", F.row_number().over(by_old))
        .withColumn("_n", F.row_number().over(by_new))
        .where("_o = 1 and _n = 1")
        .select(*group, "batch", "from_batch", "type", "old_path", "new_path")
    )


def consistent_names(renames: list[tuple[str, str]], counts: dict[str, int]) -> dict[str, str]:
    """Path -> the name it has in the consistent table: the most used path among those it was renamed to or from.

    A path below ``[]`` and a plain one hold different numbers of values and never share a column.
    """
    parent: dict[str, str] = {p: p for p in counts}

    def root(path: str) -> str:
        while parent.setdefault(path, path) != path:
            parent[path] = parent[parent[path]]
            path = parent[path]
        return path

    for a, b in renames:
        if ("[]" in a) == ("[]" in b):
            parent[root(a)] = root(b)
    groups: dict[str, list[str]] = {}
    for path in parent:
        groups.setdefault(root(path), []).append(path)
    best = {r: min(paths, key=lambda p: (-counts.get(p, 0), p)) for r, paths in groups.items()}
    return {path: best[root(path)] for path in parent}


def _stored_type(mask: int) -> str:
    """SQL type that holds every value of a folded mask unchanged."""
    mask &= TYPES
    if mask & ARRAY:
        return "array<string>"
    if mask == BOOLEAN:
        return "boolean"
    if mask and not mask & ~(WHOLE | WIDE) and mask & WHOLE:
        return "bigint"
    return "double" if mask and not mask & ~(WHOLE | FRACTION) else "string"


def _cast(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "array<string>":
        items = value if isinstance(value, list) else [value]
        return [x if x is None else _text(x if isinstance(x, str) else json.dumps(x)) for x in items]
    if kind == "double":
        return float(value)
    if kind in ("bigint", "boolean"):
        return value
    return _text(value) if isinstance(value, str) else json.dumps(value)


def own_columns(headers: DataFrame, names: DataFrame) -> DataFrame:
    """(harness, path): paths that occur in one file of the harness beside another path of the same consistent name.

    The paths were renamed into each other elsewhere, but here they are two fields, so all but the first
    (the name itself, or the first in order) keep a column of their own.
    """
    named = headers.select("harness", "batch", "file_name", "path").join(names, "path")
    together = named.groupBy("harness", "batch", "file_name", "name").agg(F.collect_set(F.struct((F.col("path") != F.col("name")).alias("other"), "path")).alias("_p"))
    kept = F.explode(F.slice(F.array_sort("_p"), 2, F.lit(1 << 30)))
    return together.where(F.size("_p") > 1).select("harness", kept.alias("_k")).select("harness", "_k.path").distinct()


def consistent_table(files: DataFrame, headers: DataFrame, change_log: DataFrame, file_kind: str) -> DataFrame:
    """All files of a kind in one table: one row per distinct file row, one column per consistent field.

    Renamed fields share a column, except in a harness whose files hold both. Types are the promoted ones,
    a field below ``[]`` is an array with one value per element that has it. What comes to the driver is the
    union schema and the distinct pairs of renamed paths, because a table's columns must be known there: both
    grow with the number of field names, not with files or harnesses. The files are cast in parallel, without
    a shuffle but for the removal of repeated rows, which compares hashes of the payloads.
    """
    spark = headers.sparkSession
    of_kind = headers.where(F.col("file_kind") == file_kind)
    used = of_kind.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()
    renamed = change_log.where((F.col("change_kind") == "renamed") & (F.col("file_kind") == file_kind))
    pairs = renamed.select("field_path", "new_path").distinct().collect()
    names = consistent_names([(r[0], r[1]) for r in pairs], {r["path"]: r["n"] for r in used})
    table = spark.createDataFrame(sorted(names.items()), "path string, name string")
    own = own_columns(of_kind, table).cache()
    folded = (
        of_kind.join(table, "path").join(own.withColumn("_own", F.lit(True)), ["harness", "path"], "left")
        .groupBy(F.when(F.col("_own"), F.col("path")).otherwise(F.col("name")).alias("name"))
        .agg(F.bit_or("mask").alias("mask"))
        .collect()
    )
    masks = {r["name"]: r["mask"] for r in folded}
    fields = sorted(masks)
    point = {n: _stored_type(masks[n]) for n in fields}
    many = {n for n in fields if "[]" in n or masks[n] & SEVERAL}
    head = "harness string, file_kind string, batch int, file_name string, written_at timestamp_ntz"
    columns = [c.split()[0] for c in head.split(", ")]

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, payload, alone in zip(*(batch[c] for c in (*columns, "payload", "_own"))):
                record = read_object(payload)
                if record is None:
                    continue
                apart = set(alone) if alone is not None else ()
                values = dict.fromkeys(fields)
                for path, found in leaves(record).items():
                    name = path if path in apart else names[path]
                    items = [_cast(x, point[name]) for x in found]
                    values[name] = items if name in many else items[0]
                rows.append((*key, *values.values()))
            yield pd.DataFrame(rows, columns=[*columns, *fields], dtype=object)

    spelled = ", ".join(f"`{n.replace('`', '``')}` " + (f"array<{point[n]}>" if n in many else point[n]) for n in fields)
    narrow = files.where((F.col("file_kind") == file_kind) & F.col("payload").isNotNull()).select(*columns, "payload")
    once = narrow.withColumn("_print", F.sha2("payload", 256)).dropDuplicates([*columns, "_print"]).drop("_print")
    kept = once.join(own.groupBy("harness").agg(F.collect_set("path").alias("_own")), "harness", "left")
    return kept.mapInPandas(cast, f"{head}, {spelled}" if spelled else head)
