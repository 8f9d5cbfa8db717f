"""Files that nobody wrote by hand: generated, minified, third-party, bulk data.

Every file is reduced to its identifiers, literals and line shapes. Over all files a character
trigram model of identifiers is trained per language; each trigram counts once per file, so that one
machine-made file cannot teach the model its own names. Then

* ``minified``   the identifiers' mean cross-entropy per character is high; or it is far above the median of the
  file's own project (of the language, where the project is small) and nothing else explains it,
* ``generated``  the names are template-like: many carry a running number, or little is left of them without
  their numbers; or a compiler's or lock tool's marks are in the code or the path,
* ``vendored``   the naming is foreign: runs of declared names that also occur in several other
  projects, or in one other project where the naming style is not the own project's; or the file is
  under a third party's directory, or its first comment begins with another product's name and version,
* ``data``       most of the code is numbers, encoded strings or word lists.

No sentence of a comment decides anything. Paths, compilers' marks and product names tell the few files that have too
little code for a statistic, or no second copy anywhere.

Scale: features need no shuffle. The model is a table of distinct trigrams above a fixed share,
which bounds it. Name runs are counted per project with a partial aggregation and joined back on
their hash; a run that occurs in very many files only repeats its own key.

Defined results: null and empty texts are hand-written (no row); a file indexed again gives a row
under each id; a text without identifiers can only be data; null project or path count as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File extension -> language of the identifier model.
LANGUAGES = {"ts": "js", "tsx": "js", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "py": "py", "json": "json"}
#: A trigram is part of the model from this number per million trigrams on; bounds the model to 1e6 / LEAST_PPM rows a language.
LEAST_PPM = 2.0

#: Bits per character, and bits above the median of all files of the language, from which names are mangled, and the names that a file needs for that.
MANGLED_BITS, MANGLED_ABOVE, LEAST_NAMES = 3.6, 1.2, 8
#: Files with a larger share of very short names do not train the model.
TEACHER_SHORT = 0.5
#: Names whose number follows another name's number, and their share of the long names, from which they come from a template.
TEMPLATE_NAMES, TEMPLATE_SHARE = 5, 0.3
DATA_SHARE, DATA_CHARS = 0.5, 600
#: Bits above the own project's median from which cross-entropy alone tells a file; a project of fewer files is compared with its language.
OUTLIER_BITS, LEAST_FILES = 2.0, 8
#: Long identifiers, and the share of them that is left without numbers, from which a file is numbered through.
NUMBERED_NAMES, STEM_SHARE = 12, 0.25
#: Distance of the share of compound names to the own project's median from which a style is foreign.
STYLE_DISTANCE = 0.25
RUN_LENGTH, FOREIGN_PROJECTS, FOREIGN_SHARE = 3, 3, 0.5
#: Parts that the files of one hot name run are spread over.
SALTS = 16

_TOKEN = re.compile(
    r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<r>(?<=[=(,:!&|?;{}])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)"
    r"|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
    r"|(?P<n>-?\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b)|(?P<i>[^\W\d][\w$]*|\$[\w$]*)|(?P<o>\S)"
)
_TOKEN_PY = re.compile(
    r"(?P<c>#[^\n]*)|(?P<s>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<n>-?\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b)|(?P<i>[^\W\d]\w*)|(?P<o>\S)"
)
_KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue def default del delete do elif else enum except export "
    "extends false finally for from function global if implements import in instanceof interface is lambda let new nonlocal "
    "not null of or pass private protected public raise readonly return static super switch this throw true try type typeof "
    "var void while with yield True False None self number string boolean any unknown never undefined".split()
)
_DECLARED = re.compile(
    r"^(?:export )?(?:default )?(?:abstract )?(?:async )?(?:function\*?|class|interface|enum|type|const|let|var|def) +([A-Za-z_$][\w$]*)", re.M
)
_COMPOUND = re.compile(r"[a-z][A-Z]|[a-z]_[a-z]")
_CAMEL, _SNAKE = re.compile(r"[a-z][A-Z]"), re.compile(r"[A-Za-z0-9]_[A-Za-z]")
_LEADING = re.compile(r"\A(?:﻿|#![^\n]*\n|\s+)*(/\*[\s\S]*?\*/|//[^\n]*|#[^\n]*)?")
_PRODUCT = re.compile(r"[\s/*#!]*(?:@\w+\s+)?(?P<name>[A-Za-z@][\w@/.\-]*?)(?:\.js)?\s+v?\d+\.\d+(?:\.\d+)?\b", re.I)
_VENDOR_DIR = re.compile(
    r"(?:^|/)(?:vendor|vendored|third[_-]?party|node_modules|bower_components|external|externals|deps|site-packages|Pods)/", re.I
)
_LOCK = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|bun\.lockb?|uv\.lock)$", re.I
)
_GENERATED_PATH = re.compile(r"(?:^|/)__generated__/|\.(?:generated|gen|g|pb)\.\w+$|_pb2(?:_grpc)?\.py$", re.I)
_COMPILED = re.compile(
    r"^\s*//[#@] sourceMappingURL=|^Object\.defineProperty\(exports, [\"']__esModule[\"']|^var __(?:awaiter|extends|assign|importDefault|decorate) = \(this && this\.__", re.M
)
_ENCODED = re.compile(r"(?:data:[\w/+.\-]+;base64,)?[A-Za-z0-9+/=_\-]{40,}\Z")


def language_of(path: str | None) -> str:
    return LANGUAGES.get((path or "").rsplit(".", 1)[-1].lower(), "other")


def names_of(text: str, language: str) -> tuple[list[str], int, int, int, int]:
    """Identifiers, characters of code, of literals that are data, number of literals, longest comment-free line."""
    names: list[str] = []
    code = data = literals = longest = 0
    for m in (_TOKEN_PY if language == "py" else _TOKEN).finditer(text):
        kind, piece = m.lastgroup, m.group()
        if kind == "c":
            continue
        code += len(piece)
        if kind == "n":
            data += len(piece)
            literals += 1
        elif kind == "s":
            inner = piece[1:-1]
            if len(inner) < 40 and " " not in inner and "\n" not in inner or _ENCODED.match(inner):
                data += len(piece)
                literals += 1
                longest = max(longest, len(inner))
        elif kind == "i" and piece not in _KEYWORDS:
            names.append(piece)
    return names, code, data, literals, longest


def short_share(names: list[str]) -> float:
    """Share of identifiers of at most three characters."""
    return sum(len(n) <= 3 for n in names) / len(names) if names else 0.0


def trigrams_of(name: str) -> list[str]:
    padded = f"^{name}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def diversity(names: list[str]) -> tuple[int, int, int, int]:
    """Distinct identifiers, those of them with more than three characters besides numbers, what these are without numbers, and how many go on counting."""
    distinct = set(names)
    long = [(n, stem) for n in distinct if len(stem := re.sub(r"\d+", "", n)) > 3]
    numbers = [int(found[-1][:18]) for n, _ in long if (found := re.findall(r"\d+", n))]
    there = set(numbers)
    return len(distinct), len(long), len({stem for _, stem in long}), sum(n - 1 in there for n in numbers)


def naming_style(names: list[str]) -> tuple[float, float]:
    """Shares of the distinct identifiers that are camelCase and snake_case."""
    distinct = set(names)
    total = len(distinct) or 1
    return sum(bool(_CAMEL.search(n)) for n in distinct) / total, sum(bool(_SNAKE.search(n)) for n in distinct) / total


def product_named(text: str, project: str) -> bool:
    """The first comment begins with the name and version of something that is not the project itself."""
    m = _PRODUCT.match(_LEADING.match(text).group(1) or "")
    return m is not None and m.group("name").lower() != project.lower()


def name_runs(text: str) -> list[int]:
    """Hashes of runs of declared top-level names; only runs of at least two distinct compound names tell a source."""
    declared = [re.sub(r"\d+", "", n) for n in _DECLARED.findall(text)]
    declared = [n for n in declared if _COMPOUND.search(n)]
    runs = set()
    for i in range(len(declared) - RUN_LENGTH + 1):
        run = declared[i : i + RUN_LENGTH]
        if len(set(run)) >= 2:
            runs.add(int.from_bytes(blake2b("\n".join(run).encode(), digest_size=8).digest(), "big", signed=True))
    return sorted(runs)


def train_names(files: DataFrame, path_col: str = "relative", text_col: str = "text") -> dict[str, dict[str, float]]:
    """Language -> trigram -> log2 probability of its last character; '' holds the value of an unseen one.

    Each file adds a trigram at most once, and files that consist mostly of very short names teach
    nothing. Counted inside the tasks first, then summed.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for path, text in zip(batch["p"], batch["t"]):
                language = language_of(path)
                names = names_of(text, language)[0]
                if short_share(names) < TEACHER_SHORT:
                    total.update((language, t) for t in {t for name in names for t in trigrams_of(name)})
        if total:
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["language", "trigram", "n"])

    texts = files.select(F.col(path_col).alias("p"), F.col(text_col).cast("string").alias("t")).where("t is not null and t <> ''")
    counts = texts.mapInPandas(count, "language string, trigram string, n bigint").groupBy("language", "trigram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "language").where(F.col("n") * 1e6 >= F.col("total") * LEAST_PPM)
    found: dict[str, dict[str, int]] = {}
    for row in kept.collect():
        found.setdefault(row["language"], {})[row["trigram"]] = row["n"]
    return {language: _log_model(trigrams) for language, trigrams in found.items()}


def _log_model(counts: dict[str, int]) -> dict[str, float]:
    contexts: Counter[str] = Counter()
    for trigram, n in counts.items():
        contexts[trigram[:2]] += n
    letters = 64
    model = {t: math.log2((n + 0.5) / (contexts[t[:2]] + 0.5 * letters)) for t, n in counts.items()}
    model[""] = math.log2(1 / (4 * letters))
    return model


def cross_entropy(names: list[str], model: dict[str, float]) -> float:
    """Mean bits per character of the distinct names; 0 without a model."""
    if not model:
        return 0.0
    bits = length = 0.0
    unseen = model.get("", -8.0)
    for name in set(names):
        for trigram in trigrams_of(name):
            bits -= model.get(trigram, unseen)
            length += 1
    return bits / length if length else 0.0


FEATURES = (
    "language string, names int, bits double, short_share double, code_chars int, data_chars int, literals int, distinct_names int, long_names int, "
    "stems int, numbered int, camel_share double, snake_share double, compiled boolean, product boolean, runs array<bigint>"
)


def file_features(
    files: DataFrame, models: dict[str, dict[str, float]], id_col: str = "file_id", project_col: str = "project",
    path_col: str = "relative", text_col: str = "text",
) -> DataFrame:
    """One row per file with what the rules need; no shuffle."""
    shared = files.sparkSession.sparkContext.broadcast(models)
    kind = dict(files.dtypes)[id_col]
    columns = ["file_id", "project", "relative", *(c.split()[0] for c in FEATURES.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, project, path, text in zip(batch["file_id"], batch["project"], batch["relative"], batch["_text"]):
                language = language_of(path)
                names, code, data, literals, _ = names_of(text, language)
                rows.append((
                    key, project, path, language, len(names), cross_entropy(names, shared.value.get(language, {})), short_share(names), code, data,
                    literals, *diversity(names), *naming_style(names), bool(_COMPILED.search(text)), product_named(text, project), name_runs(text),
                ))
            yield pd.DataFrame(rows, columns=columns)

    narrow = files.select(
        F.col(id_col).alias("file_id"),
        F.coalesce(F.col(project_col), F.lit("")).alias("project"),
        F.coalesce(F.col(path_col), F.lit("")).alias("relative"),
        F.col(text_col).cast("string").alias("_text"),
    ).where("_text is not null and _text <> ''")
    return narrow.mapInPandas(run, f"file_id {kind}, project string, relative string, {FEATURES}")


def foreign_shares(features: DataFrame) -> DataFrame:
    """(file_id, foreign_share, other_share): shares of a file's name runs that occur in several projects, and in any other one.

    A run may occur in a third of all files: projects are made distinct inside the tasks before they are
    counted, and the way back to the files is salted.
    """
    salt = F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int")
    runs = features.select("file_id", "project", F.explode("runs").alias("run"), salt.alias("salt"))
    spread = runs.select("run", "project").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("projects"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    common = spread.where("projects >= 2").select("run", salts, "projects")
    marked = runs.join(common, ["run", "salt"], "left")

    def share(least: int) -> F.Column:
        return F.avg(F.when(F.col("projects") >= least, 1).otherwise(0))

    return marked.groupBy("file_id").agg(share(FOREIGN_PROJECTS).alias("foreign_share"), share(2).alias("other_share"))


def with_own_style(features: DataFrame) -> DataFrame:
    """Adds bits_above and style_distance, against the medians of the file's own project in its language, and language_bits_above.

    Medians, so that the files looked for do not move what they are compared with.
    """
    columns = ("bits", "camel_share", "snake_share")
    told = features.where(F.col("distinct_names") >= LEAST_NAMES)

    def medians(name: str) -> list[F.Column]:
        return [F.percentile_approx(c, 0.5, 1000).alias(f"_{name}_{c}") for c in columns]

    own = told.groupBy("project", "language").agg(F.count(F.lit(1)).alias("_files"), *medians("own"))
    own = own.where(F.col("_files") >= LEAST_FILES).drop("_files")
    every = told.groupBy("language").agg(*medians("all"))
    both = features.join(own, ["project", "language"], "left").join(F.broadcast(every), "language", "left")
    above = {c: F.col(c) - F.coalesce(f"_own_{c}", f"_all_{c}") for c in columns}
    added = both.withColumn("bits_above", F.coalesce(above["bits"], F.lit(0.0))).withColumn(
        "style_distance", F.coalesce(F.greatest(F.abs(above["camel_share"]), F.abs(above["snake_share"])), F.lit(0.0))
    )
    added = added.withColumn("language_bits_above", F.coalesce(F.col("bits") - F.col("_all_bits"), F.lit(0.0)))
    return added.select(*features.columns, "bits_above", "language_bits_above", "style_distance")


def classify(features: DataFrame) -> DataFrame:
    """file_id, kinds (of generated, minified, vendored, data) and the features of every file.

    ``features`` is read several times: hand in a checkpointed or stored table.
    """
    path = F.col("relative")
    bulk = (F.col("data_chars") >= DATA_SHARE * F.col("code_chars")) & (F.col("data_chars") >= DATA_CHARS)
    foreign = (F.coalesce("foreign_share", F.lit(0.0)) >= FOREIGN_SHARE) | (
        (F.coalesce("other_share", F.lit(0.0)) >= FOREIGN_SHARE) & (F.col("style_distance") >= STYLE_DISTANCE)
    )
    numbered = (F.col("numbered") >= TEMPLATE_NAMES) & (F.col("numbered") >= TEMPLATE_SHARE * F.col("long_names"))
    repeated = (F.col("long_names") >= NUMBERED_NAMES) & (F.col("stems") <= STEM_SHARE * F.col("long_names"))
    kinds = {
        "minified": (F.col("names") >= LEAST_NAMES) & (F.col("bits") >= MANGLED_BITS) & (F.col("language_bits_above") >= MANGLED_ABOVE) & ~bulk,
        "generated": (numbered | repeated) & ~bulk | F.col("compiled") | path.rlike(_jvm(_LOCK)) | path.rlike(_jvm(_GENERATED_PATH)),
        "vendored": foreign | path.rlike(_jvm(_VENDOR_DIR)) | F.col("product"),
        "data": bulk,
    }
    outlier = (F.col("distinct_names") >= LEAST_NAMES) & (F.col("bits_above") >= OUTLIER_BITS)
    kinds["minified"] = kinds["minified"] | outlier & ~(kinds["generated"] | kinds["vendored"] | kinds["data"])
    labels = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds.items()]))
    return with_own_style(features).join(foreign_shares(features), "file_id", "left").withColumn("kinds", labels).drop("runs")


def _jvm(pattern: re.Pattern) -> str:
    return "(?i)" + pattern.pattern
