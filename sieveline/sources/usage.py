"""Readers: usage records as JSON lines, trace events, source trees, run results."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import constants as C
from sieveline.functions import text as X

USAGE = T.StructType(
    [
        T.StructField("t", T.TimestampType()),
        T.StructField("tool", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("capsule_tokens", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("handed_off", T.BooleanType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
    ]
)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records with a fixed schema; malformed lines are dropped."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)


def stream_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(USAGE).option("mode", "DROPMALFORMED").json(path)


def write_usage(calls: DataFrame, path: str) -> None:
    """Append usage records; the task is kept to 200 characters."""
    calls.withColumn("task", F.substring("task", 1, 200)).write.mode("append").json(path)


def last_usage(trace: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Per trace the usage object of its last ``turn.completed`` event."""
    event = F.from_json(line, "type string, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>")
    events = trace.withColumn("_e", event).where(F.col("_e.type") == "turn.completed")
    return events.groupBy(*keys).agg(F.max_by("_e.usage", order).alias("usage")).select(*keys, "usage.*")


def scan_tree(spark: SparkSession, root: str, most_files: int = 10_000, most_bytes: int = 1_000_000) -> tuple[DataFrame, bool]:
    """(relative, text) of the source files below a local folder, and whether a limit left some out.

    Directories are pruned while walking: build and dependency folders, nested repositories, and what the ignore
    files on the way exclude. At most ``most_files`` paths are held; the files themselves are read by the executors.
    Entries that vanish or cannot be read are passed over.
    """
    paths, truncated = [], False
    rules: list[tuple[re.Pattern, bool]] = []
    for folder, names, files in os.walk(root, onerror=lambda error: None):
        nested = folder != root and os.path.exists(os.path.join(folder, ".git"))
        if nested:
            names[:] = []
            continue
        place = os.path.relpath(folder, root).replace(os.sep, "/")
        place = "" if place == "." else place
        if ".gitignore" in files:
            try:
                with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as lines:
                    rules += [(re.compile(pattern), negated) for pattern, negated in ignore_rules(lines.read(), place)]
            except OSError:
                pass
        names[:] = sorted(n for n in names if not _skipped(n) and not _excluded(f"{place}/{n}" if place else n, rules))
        for name in sorted(files):
            path = os.path.join(folder, name)
            try:
                size = os.path.getsize(path)
            except OSError:
                continue
            if size > most_bytes or len(paths) >= most_files:
                truncated = True
                continue
            paths.append(path)
    if not paths:
        return spark.createDataFrame([], "relative string, text string"), truncated
    read = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    prefix = "file:" + os.path.abspath(root).rstrip("/") + "/"
    relative = F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(prefix), F.lit(""))
    found = read.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("relative"), "text")
    return found.where(X.is_source_path(F.col("relative")) & ~X.is_bundle(F.col("text"))), truncated


def _skipped(name: str) -> bool:
    return name in C.SKIPPED_DIRECTORIES or re.match(r"(?:dist|build|out|target)[-_.]", name) is not None


def _excluded(directory: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    """The last rule that matches decides."""
    verdict = False
    for pattern, negated in rules:
        if pattern.match(directory):
            verdict = not negated
    return verdict


def ignore_rules(text: str, base: str = "") -> list[tuple[str, bool]]:
    """Ignore-file lines as (anchored regular expression, negated), in order; the last match wins."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.lstrip("!").rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        out, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                out, i = out + ".*", i + 2
            elif line[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif line[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + ("\\" + line[i] if line[i] in ".+()[]{}^$|\\" else line[i]), i + 1
        start = f"{base}/" if base else ""
        rules.append((f"^{start}{'' if anchored else '(?:.*/)?'}{out}$", negated))
    return rules


def ignored(directories: DataFrame, rules: list[tuple[str, bool]], column: str = "directory") -> DataFrame:
    """directories with ``ignored``: whether the last rule that matches excludes them."""
    verdict = F.lit(False)
    for pattern, negated in rules:
        verdict = F.when(F.col(column).rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return directories.withColumn("ignored", verdict)
