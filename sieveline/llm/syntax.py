"""Source files that do not follow the grammar of their language.

Each text is parsed with a packrat parsing-expression grammar of the language that its file
extension names and must be consumed in full. For a text that is not, the report gives the furthest
position at which a terminal failed, its line, and the likely cause:

* ``conflict``   merge markers at the failure,
* ``truncated``  the text ends (or a cut notice stands) where more was needed,
* ``extension:x``  the text is valid in language x,
* ``syntax``     anything else.

Defined results: null texts and unknown extensions give no row; an empty text is valid except as
JSON; a byte-order mark and a ``#!`` line are allowed; nesting may be of any depth; repeated texts are each reported. Texts are independent, so the only shuffle is the one
of the grouped rates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import grammars_js, grammars_py
from sieveline.llm.peg import Grammar

#: File extension -> language.
EXTENSIONS = {"ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "py": "py", "json": "json"}
#: Languages that a failing text is tried in, to tell a wrong extension.
OTHERS = ("json", "py", "js", "ts", "tsx")

_MARKER = re.compile(r"^[ \t]*(?:<{7}|>{7}|\|{7}|={7})(?:[ \t].*)?\r?$")
_CUT_NOTICE = re.compile(r"…|\.\.\. ?\[|\[\d+ more (?:characters|lines)|\btruncated\b")
_SHEBANG = re.compile(r"#![^\n]*")


@lru_cache(maxsize=None)
def _grammar(language: str) -> Grammar:
    if language == "json":
        return Grammar(grammars_py.JSON, "Text", grammars_py.JSON_TRIVIA)
    if language == "py":
        return Grammar(grammars_py.PYTHON, "Stmt", r" *+", items=True)
    parts = [grammars_js.BASE]
    if language in ("ts", "tsx"):
        parts.append(grammars_js.TYPES)
    if language == "tsx":
        parts.append(grammars_js.MARKUP)
    return Grammar("\n".join(parts), "Item", grammars_js.TRIVIA, {"newline": grammars_js.newline_before}, items=True)


def _start(text: str, language: str) -> int:
    """Where the text begins behind a byte-order mark and, in scripts, a ``#!`` line."""
    start = 1 if text.startswith("﻿") else 0
    shebang = _SHEBANG.match(text, start) if language not in ("json", "py") else None
    return shebang.end() if shebang else start


def accepts(text: str, language: str) -> bool:
    """Whether the text follows the grammar; the first of the two parses of ``parse``."""
    if language != "py":
        return _grammar(language).accepts(text, _start(text, language))
    try:
        return _grammar("py").accepts(grammars_py.Layout(text[_start(text, language) :]).result)
    except grammars_py.LayoutError:
        return False


def parse(text: str, language: str) -> tuple[bool, int]:
    """(valid, furthest failure position) of one text."""
    start = _start(text, language)
    if language == "py":
        try:
            layout = grammars_py.Layout(text[start:])
        except grammars_py.LayoutError as broken:
            return False, start + broken.at
        valid, at = _grammar("py").parse(layout.result)
        return valid, len(text) if valid else start + layout.source(at)
    return _grammar(language).parse(text, start)


def cause(text: str, language: str, at: int) -> str:
    """Why a text that failed at ``at`` is likely broken."""
    lines = text.split("\n")
    row = text.count("\n", 0, at)
    if any(_MARKER.match(line) for line in lines[max(0, row - 1) : row + 2]):
        return "conflict"
    if at >= len(text.rstrip()) or _CUT_NOTICE.search(lines[min(row, len(lines) - 1)]):
        return "truncated"
    for other in OTHERS:
        if other != language and accepts(text, other):
            return f"extension:{other}"
    if any(line.startswith("<<<<<<<") for line in lines) and any(line.startswith(">>>>>>>") for line in lines):
        return "conflict"
    return "syntax"


def _in_known_languages(df: DataFrame, id_col: str, file_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    extension = F.lower(F.regexp_extract(F.col(file_col), r"\.([A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]
    return df.select(F.col(id_col), *keep, language.alias("language"), F.col(text_col).cast("string").alias("_text")).where("language is not null and _text is not null")


def syntax_report(
    df: DataFrame, id_col: str = "evidence_id", file_col: str = "file", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per text in a known language: id, kept columns, language, valid, failed_at, failed_line, cause."""
    kinds = dict(df.dtypes)
    texts = _in_known_languages(df, id_col, file_col, text_col, keep)
    head = [id_col, *keep]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in head)
    schema += ", language string, valid boolean, failed_at int, failed_line int, cause string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for text, language in zip(batch["_text"], batch["language"]):
                valid, at = parse(text, language)
                if valid:
                    results.append((True, -1, -1, ""))
                else:
                    results.append((False, at, text.count("\n", 0, at) + 1, cause(text, language, at)))
            report = pd.DataFrame(results, columns=["valid", "failed_at", "failed_line", "cause"], index=batch.index)
            yield pd.concat([batch[[*head, "language"]], report], axis=1)

    return texts.mapInPandas(run, schema)


def invalid_ids(df: DataFrame, id_col: str = "evidence_id", file_col: str = "file", text_col: str = "text") -> DataFrame:
    """The ids of the texts that ``syntax_report`` calls invalid, without a second parse for place and cause."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [not accepts(text, language) for text, language in zip(batch["_text"], batch["language"])]
            yield batch.loc[bad, [id_col]]

    return _in_known_languages(df, id_col, file_col, text_col, ()).mapInPandas(run, f"`{id_col}` {kind}")


def invalid_rates(report: DataFrame, *groups: str) -> DataFrame:
    """Files, invalid files, their rate and the causes per group, with partial aggregation before the shuffle."""
    bad = F.count_if(~F.col("valid"))
    causes = {
        "conflicts": F.col("cause") == "conflict",
        "truncated": F.col("cause") == "truncated",
        "wrong_extension": F.col("cause").startswith("extension:"),
    }
    return report.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("files"),
        bad.alias("invalid"),
        (bad / F.count(F.lit(1))).alias("invalid_rate"),
        *[F.count_if(test).alias(name) for name, test in causes.items()],
    )
