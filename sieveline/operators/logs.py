"""Log lines of many programs into entries with time, level, component and message.

1. *Token n-gram dictionary.* The head of a line (from its time through the first words after it) becomes a
   shape: times, levels, numbers, names and names with digits are typed, marks stay. Shapes are counted inside
   the tasks and summed up. From them n-grams are counted over all lines: a token behind the whole head before
   it, behind the two tokens before it (trigram) and behind the one before it (bigram), the shorter ones for
   heads that are rare. JSON objects and key=value lines give (key, type of value) pairs in the same table.
2. *Templates.* Only the counts say what a head is. A mark, level or number is a constant of the layout where it
   holds its share of what follows the head before it. A name is a slot where the token behind it is a constant
   border, or where nearly all that ever follows are borders (layouts that begin alike); where words follow, the
   name is the first word of the message and the head ends.
   Slots get roles by type: the time, the first level, names mostly with digits (host, thread, request) and
   numbers (process, line) none, the first name the component. Where a template has several name slots, their
   words are counted too; a slot with one constant word is no field. In objects the majority of a key's value
   types gives its role. An empty dictionary yields times and nothing else.
3. *Entries.* A line with a time at its own head starts an entry that lasts until the next one. Lines
   are numbered within their stream, so a stream is cut into blocks of fixed length, and the lines are
   shuffled once, by stream and block. Entries are formed inside each block; what an entry has in later
   blocks is added from one summary row per block. No task ever holds a whole stream.

Defined results: null lines start no entry; empty and very long lines are ordinary lines; a line
that was delivered again counts once, with its earliest received_at; a line whose date does not
exist starts no entry; lines before the first entry belong to none; extra columns are ignored; a layout of which
the lines hold too small a share for a context of its own is read with the trigrams and bigrams of all layouts.
"""

from __future__ import annotations

import json
import re
from calendar import timegm
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.operators.prefix import value_before

#: Lines of a stream that one block holds.
BLOCK_LINES = 4096
#: Words after the time in a shape at first; doubled while heads are found that go on beyond them.
HEAD_WORDS = 6
#: Share of all heads from which an n-gram is kept; it bounds the dictionary: at most 3 x tokens of a shape / LEAST_SHARE rows.
LEAST_SHARE = 0.0002
#: Share of its place from which a token is a possible part of a layout.
BRANCH_SHARE = 0.02
#: Share of its place from which a token is the constant border of a slot, and a word the constant of its slot.
CONSTANT_SHARE = 0.5
#: Share of its place from which a name is always followed by another name, or by some border.
CHAIN_SHARE = 0.8
#: Weight of the shorter n-grams in the share of a longer one, in lines.
BACK_OFF = 1.0

_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_MONTH = "|".join(_MONTHS)
_CLOCK = r"(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d{1,9}))?"
_ZONE = r"(?: ?(?P<z>Z|UTC|GMT|[+-]\d\d:?\d\d))?"
_TIMES = [
    re.compile(rf"(?P<y>\d{{4}})[-/.](?P<mo>\d\d)[-/.](?P<d>\d\d)(?:[T ]| - ){_CLOCK}{_ZONE}(?![\w:])"),
    re.compile(rf"(?P<d>\d{{1,2}})[ /-](?P<mon>{_MONTH})[ /-](?P<y>\d{{4}})[ :T]{_CLOCK}{_ZONE}(?![\w:])"),
    re.compile(rf"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?(?P<mon>{_MONTH}) +(?P<d>\d{{1,2}})(?:,? (?P<y>\d{{4}}))? {_CLOCK}{_ZONE}(?![\w:])"),
    re.compile(rf"(?P<letter>[TDIWEF])(?P<mo>\d\d)(?P<d>\d\d) {_CLOCK}(?![\w:])"),
]
#: Level words and letters, fixed values.
LEVELS = {
    "trace": "trace", "trc": "trace", "verbose": "trace", "silly": "trace", "finest": "trace", "finer": "trace",
    "debug": "debug", "dbg": "debug", "fine": "debug",
    "info": "info", "inf": "info", "information": "info", "notice": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error", "severe": "error",
    "fatal": "fatal", "critical": "fatal", "crit": "fatal", "ftl": "fatal", "panic": "fatal", "alert": "fatal",
    "emerg": "fatal", "emergency": "fatal",
}
_LETTERS = {"T": "trace", "D": "debug", "I": "info", "W": "warn", "E": "error", "F": "fatal"}
_NUMERIC = ("trace", "debug", "info", "warn", "error", "fatal")
_TIME_KEYS = {"time", "ts", "timestamp", "@timestamp", "t", "date", "datetime", "asctime"}
_LEVEL_KEYS = {"level", "severity", "lvl", "levelname", "loglevel", "log.level"}
_NAME_KEYS = {"component", "logger", "name", "module", "target", "logger_name", "category", "subsystem"}
_TEXT_KEYS = {"msg", "message", "text", "event"}

#: Typed tokens of a shape: a time, a level, and where the line goes on beyond the shape.
TIME, LEVEL, CUT = "\x02", "\x03", "\x06"
_LEVEL_WORDS = "|".join(LEVELS)
_CONTROL = re.compile(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\))")
_PAIR = re.compile(r'(?P<k>[\w.@]+)=(?P<v>"(?:[^"\\]|\\.)*"|\S*)\s*')
_TOKEN = re.compile(
    rf"(?P<gap>\s+)|(?P<T>{TIME})|(?P<L>{LEVEL})|(?P<C>{CUT})|(?P<w>[^\W\d]\w*(?:(?:::|[.\-/])\w+)*)|(?P<n>\d+(?:\.\d+)?(?![\w.]))|(?P<m>\d\w*)"
    rf"|(?P<mark>[^\w\s{TIME}{LEVEL}{CUT}]+)"
)
_NAME = re.compile(r"[^\W\d]\w*(?:(?:::|[.\-/])\w+)*")


def plain_line(line: str) -> str:
    """The line without colour codes and without the carriage return at its end; of overwritten text the last."""
    if "\x1b" in line:
        line = _CONTROL.sub("", line)
    line = line.rstrip("\r\n")
    return line.rsplit("\r", 1)[1] if "\r" in line else line


def level_name(value: object) -> str:
    """trace .. fatal for a level word, letter or number on the scale 10 .. 60; '' if it is none."""
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, (int, float)) or isinstance(value, str) and value.isdigit():
        step = int(float(value)) // 10
        return _NUMERIC[min(step, 6) - 1] if step >= 1 else ""
    word = str(value).strip().lower()
    return LEVELS.get(word) or _LETTERS.get(str(value).strip(), "")


def _zone_ms(zone: str | None) -> int:
    if not zone or zone in ("Z", "UTC", "GMT"):
        return 0
    sign, digits = (-1 if zone[0] == "-" else 1), zone[1:].replace(":", "")
    return sign * (int(digits[:2]) * 60 + int(digits[2:])) * 60_000


@lru_cache(maxsize=1 << 16)
def _day_ms(year: int, month: int, day: int) -> int | None:
    try:
        pd.Timestamp(year=year, month=month, day=day)
    except ValueError:
        return None
    return timegm((year, month, day, 0, 0, 0)) * 1000


def _time_ms(m: re.Match, year: int) -> int | None:
    g = m.groupdict()
    month = _MONTHS[g["mon"]] if g.get("mon") else int(g["mo"])
    day = _day_ms(int(g.get("y") or year), month, int(g["d"]))
    if day is None or int(g["h"]) > 23 or int(g["mi"]) > 59 or int(g["s"]) > 60:
        return None
    clock = ((int(g["h"]) * 60 + int(g["mi"])) * 60 + int(g["s"])) * 1000
    fraction = int((g["f"] + "00")[:3]) if g.get("f") else 0
    return day + clock + fraction - _zone_ms(g.get("z"))


def _value_ms(value: object, year: int) -> int | None:
    """Epoch milliseconds of a value that is a whole time: text, or seconds or milliseconds as a number."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)) or isinstance(value, str) and re.fullmatch(r"\d{10}(?:\.\d+)?|\d{13}", value):
        number = float(value)
        if 1e8 <= number < 1e10:
            return int(number * 1000)
        return int(number) if 1e11 <= number < 1e14 else None
    if isinstance(value, str):
        for pattern in _TIMES[:3]:
            m = pattern.fullmatch(value.strip())
            if m:
                return _time_ms(m, year)
    return None


def _time_at(line: str, at: int) -> re.Match | None:
    for pattern in _TIMES:
        m = pattern.match(line, at)
        if m:
            return m
    return None


# For the vectorised pass, without look-around: where a time may stand at the start of a line.
_BEFORE = rf"(?:[\[(<]?(?i:{_LEVEL_WORDS})[\])>:]?[ \t]+)?[\[(<]?"
_PLAIN_ZONE = r"(?: ?(?:Z|UTC|GMT|[+-]\d\d:?\d\d))?"
_PLAIN_CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d{1,9})?"
_PLAIN_TIME = (
    rf"(?:\d{{4}}[-/.]\d\d[-/.]\d\d(?:[T ]| - ){_PLAIN_CLOCK}{_PLAIN_ZONE}|\d{{1,2}}[ /-](?:{_MONTH})[ /-]\d{{4}}[ :T]{_PLAIN_CLOCK}{_PLAIN_ZONE}"
    rf"|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?(?:{_MONTH}) +\d{{1,2}}(?:,? \d{{4}})? {_PLAIN_CLOCK}{_PLAIN_ZONE})"
)
_GLUED_TIME = rf"\d{{4}} {_PLAIN_CLOCK}"
_TEXT_HEAD = rf"^(?:{_BEFORE}{_PLAIN_TIME}|[TDIWEF]{_GLUED_TIME})"
_OBJECT_HEAD, _PAIR_HEAD = r"^\{.*\d{2}.*\}\s*$", r"^[\w.@]+=\S.*\d\d"


def plain_lines(lines: pa.Array) -> pa.Array:
    """``plain_line`` over a whole batch."""
    if pc.any(pc.match_substring(lines, "\x1b")).as_py():
        lines = pc.replace_substring_regex(lines, r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\\\))", "")
    lines = pc.utf8_rtrim(lines, "\r\n")
    if pc.any(pc.match_substring(lines, "\r")).as_py():
        lines = pc.replace_substring_regex(lines, r"(?s)^.*\r", "")
    return lines


def shapes(heads: pa.Array, words: int = HEAD_WORDS) -> pa.Array:
    """The shapes of lines that begin with a time: letters are ``a`` and digits ``0`` until they are typed."""
    text = pc.replace_substring_regex(heads, r"[\x02-\x06]", " ")
    text = pc.replace_substring_regex(text, rf"^({_BEFORE}){_PLAIN_TIME}", "\\1" + TIME)
    text = pc.replace_substring_regex(text, rf"^[TDIWEF]{_GLUED_TIME}", LEVEL + TIME)
    if words <= 900:
        text = pc.replace_substring_regex(text, rf"(?s)^([^{TIME}]*{TIME}(?:\S*\s+){{{words}}}\S*)\s.*$", "\\1 " + CUT)
    text = pc.replace_substring_regex(text, rf"(^|[\s\[(<|{{{TIME}])(?i:{_LEVEL_WORDS})([\s\])>|:,}}]|$)", "\\1" + LEVEL + "\\2")
    text = pc.replace_substring_regex(text, r"[A-Za-z_]+", "a")
    return pc.replace_substring_regex(text, r"\d+", "0")


@lru_cache(maxsize=1 << 16)
def tokens_of(shape: str) -> tuple[str, ...]:
    """Typed tokens: ``T L w x n m C`` and runs of marks; a blank before and, for marks, ``_`` for a blank behind."""
    found: list[str] = []
    blank = False
    for m in _TOKEN.finditer(shape):
        kind = m.lastgroup
        if kind == "gap":
            if found and found[-1][-1] not in "TLwxnmC":
                found[-1] += "_"
            blank = True
            continue
        text = m.group()
        if kind == "w" and re.search(r"\d", text):
            kind = "x"
        found.append((" " if blank else "") + (text if kind == "mark" else kind))
        blank = False
    if found and found[-1][-1] not in "TLwxnmC_":
        found[-1] += "_"
    return tuple(found)


def value_type(value: object) -> str:
    """time, level, number, name, id (a name with digits), text or other."""
    if isinstance(value, bool) or value is None:
        return "other"
    if _value_ms(value, 2000) is not None:
        return "time"
    if isinstance(value, (int, float)):
        return "level" if value in (10, 20, 30, 40, 50, 60) else "number"
    if not isinstance(value, str):
        return "other"
    if level_name(value):
        return "level"
    if _NAME.fullmatch(value):
        return "id" if re.search(r"\d", value) else "name"
    return "text" if re.search(r"\s", value) else "other"


def _object_pairs(line: str) -> list[tuple[str, object]]:
    try:
        record = json.loads(line)
    except (ValueError, RecursionError):
        return []
    return list(record.items()) if isinstance(record, dict) else []


def _plain_pairs(line: str) -> list[tuple[str, object]]:
    pairs, at = [], 0
    while at < len(line):
        m = _PAIR.match(line, at)
        if not m:
            break
        value = m.group("v")
        if value.startswith('"') and len(value) > 1:
            try:
                value = json.loads(value)
            except ValueError:
                value = value[1:-1]
        pairs.append((m.group("k"), value))
        at = m.end()
    return pairs if len(pairs) > 1 else []


def _fields_of(line: str) -> list[tuple[str, object]]:
    return _object_pairs(line) if line[0] == "{" else _plain_pairs(line)


def count_keys(lines: DataFrame, line_col: str = "line", words: int = HEAD_WORDS) -> DataFrame:
    """(head, n): how often each shape occurs over all lines, and for objects their keys with types of values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["head", "n"])

        for batch in batches:
            plain = plain_lines(batch.column(0).cast(pa.string()))
            counted = pc.value_counts(shapes(pc.filter(plain, pc.match_substring_regex(plain, _TEXT_HEAD)), words))
            for key, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                total[key] += n
            for line in pc.filter(plain, pc.match_substring_regex(plain, rf"{_OBJECT_HEAD}|{_PAIR_HEAD}")).to_pylist():
                pairs = _fields_of(line)
                if pairs:
                    total["{" + "\x1f".join(f"{k}\x1e{value_type(v)}" for k, v in pairs)] += 1
            if len(total) > 300_000:
                yield rows()
                total.clear()
        if total:
            yield rows()

    texts = lines.select(F.col(line_col).cast("string").alias("l")).where("l is not null and l <> ''")
    return texts.mapInArrow(count, "head string, n bigint").groupBy("head").agg(F.sum("n").alias("n"))


def count_ngrams(keys: DataFrame) -> DataFrame:
    """(context, token, n): what follows the whole head, the two tokens and the one token before a place."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for head, n in zip(batch["head"], batch["n"]):
                for context, token in ngrams_of(head):
                    total[context, token] += n
        if total:
            yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["context", "token", "n"])

    counts = keys.mapInPandas(count, "context string, token string, n bigint")
    return counts.groupBy("context", "token").agg(F.sum("n").alias("n"))


def ngrams_of(head: str) -> Iterator[tuple[str, str]]:
    if head[0] == "{":
        pairs = [p.split("\x1e") for p in head[1:].split("\x1f")]
        layout = "{" + "\x1f".join(sorted(k for k, _ in pairs))
        for key, kind in pairs:
            yield layout + "\x1e" + key, kind
            yield "{\x1e" + key, kind
        return
    tokens = tokens_of(head)
    for i in range(1, len(tokens) + 1):
        after = tokens[i] if i < len(tokens) else "$"
        for context in _contexts(tokens, i):
            yield context, after


def _contexts(tokens: tuple[str, ...], i: int) -> tuple[str, str, str]:
    """The contexts of place i: the whole head before it, two tokens, one token."""
    return "^" + "".join(tokens[:i]), "3" + "".join(tokens[max(i - 2, 0) : i]), "2" + tokens[i - 1]


class Dictionary:
    """The n-gram counts: (context, token) -> n, and the total of each context."""

    def __init__(self, counts: dict[tuple[str, str], int], totals: dict[str, int], words: int = HEAD_WORDS, constant_slots: dict[tuple[str, int], bool] | None = None):
        self.counts, self.totals, self.words = counts, totals, words
        self.constant_slots = constant_slots or {}
        self.borders: Counter[str] = Counter()
        for (context, token), n in counts.items():
            if context[0] in "^32" and _type(token) in ("mark", "L"):
                self.borders[context] += n

    def n(self, context: str, token: str) -> int:
        return self.counts.get((context, token), 0)

    def share(self, tokens: tuple[str, ...], i: int, token: str | None) -> float:
        """Share of ``token`` at place i behind tokens[:i], each n-gram backed off to the next shorter one; None: of all borders."""
        value = 0.0
        for context in reversed(_contexts(tokens, i)):
            total = self.totals.get(context, 0)
            if total:
                n = self.borders[context] if token is None else self.n(context, token)
                value = (n + BACK_OFF * value) / (total + (BACK_OFF if value else 0))
        return value

    def type_of(self, layout: str, key: str) -> str:
        """The type that most values of a key have, in this layout or, where it is rare, in all of them."""
        for context in (layout + "\x1e" + key, "{\x1e" + key):
            total = self.totals.get(context, 0)
            for kind in ("time", "level", "number", "name", "id", "text"):
                if total and self.n(context, kind) >= CONSTANT_SHARE * total:
                    return kind
            if total:
                return "other"
        return ""


EMPTY = Dictionary({}, {})


def learn_dictionary(keys: DataFrame, words: int = HEAD_WORDS) -> Dictionary:
    """The frequent n-grams of the keys; their number is bounded by LEAST_SHARE, whatever the number of lines."""
    counts = count_ngrams(keys)
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"))
    heads = keys.agg(F.sum("n").alias("heads"))
    kept = counts.join(totals, "context").crossJoin(F.broadcast(heads)).where(F.col("n") >= F.col("heads") * LEAST_SHARE)
    rows = kept.select("context", "token", "n", "total").collect()
    return Dictionary({(r["context"], r["token"]): r["n"] for r in rows}, {r["context"]: r["total"] for r in rows}, words)


def learn(lines: DataFrame, stored=lambda df: df) -> tuple[DataFrame, Dictionary]:
    """Keys and dictionary; the shapes are taken wider while heads of a notable share go on beyond them.

    ``stored`` cuts the lineage of the keys, which are read several times.
    """
    words = HEAD_WORDS
    while True:
        keys = stored(count_keys(lines, words=words))
        dictionary = learn_dictionary(keys, words)
        if words > 900:
            break
        layouts = learn_templates(keys, dictionary)
        cut = layouts.agg(F.sum(F.when(F.col("is_cut"), F.col("n"))).alias("cut"), F.sum("n").alias("heads")).first()
        if not cut["cut"] or cut["cut"] < LEAST_SHARE * cut["heads"]:
            break
        words *= 2
    several = layouts if words <= 900 else learn_templates(keys, dictionary)
    total = keys.agg(F.sum("n")).first()[0] or 0
    templates = [r["template"] for r in several.where((F.col("names") > 1) & (F.col("n") >= F.lit(total * LEAST_SHARE))).select("template").distinct().collect()]
    if templates:
        dictionary.constant_slots = constant_slots(lines, dictionary, templates)
    return keys, dictionary


def learn_templates(keys: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(template, names, is_cut, n): the layouts of all keys, their name slots and the number of their lines."""
    shared = keys.sparkSession.sparkContext.broadcast(dictionary)

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        total: Counter[tuple[str, int, bool]] = Counter()
        for batch in batches:
            for head, n in zip(batch["head"], batch["n"]):
                if head[0] == "{":
                    pairs = [tuple(p.split("\x1e")) for p in head[1:].split("\x1f")]
                    roles = field_roles(tuple(k for k, _ in pairs), known)
                    if roles is not None:
                        total["fields: " + " ".join(f"{k}=<{roles.get(k, '*')}>" for k, _ in pairs), 1, False] += n
                else:
                    template = template_of(head, known)
                    if template is not None:
                        total[template.label, len(template.names), template.is_cut] += n
        yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["template", "names", "is_cut", "n"])

    derived = keys.mapInPandas(derive, "template string, names int, is_cut boolean, n bigint")
    return derived.groupBy("template", "names", "is_cut").agg(F.sum("n").alias("n"))


def constant_slots(lines: DataFrame, dictionary: Dictionary, templates: list[str]) -> dict[tuple[str, int], bool]:
    """Which name slots of these templates hold one constant word: (slot, word) bigrams counted over all lines.

    Only templates with several name slots are asked for; one row per template and slot comes back.
    """
    shared = lines.sparkSession.sparkContext.broadcast((dictionary, frozenset(templates)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        reader = Reader(known)
        total: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            plain = plain_lines(batch.column(0).cast(pa.string()))
            heads = pc.filter(plain, pc.match_substring_regex(plain, _TEXT_HEAD))
            for line, shape in zip(heads.to_pylist(), shapes(heads, known.words).to_pylist()):
                template = reader.template(shape)
                hit = template.match(line) if template is not None and template.label in wanted else None
                if hit:
                    for slot in template.names:
                        total[template.label, slot, hit.group(f"c{slot}")] += 1
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            ["template", "slot", "word", "n"],
        )

    texts = lines.select(F.col("line").cast("string").alias("l")).where("l is not null and l <> ''")
    words = texts.mapInArrow(count, "template string, slot int, word string, n bigint").groupBy("template", "slot", "word").agg(F.sum("n").alias("n"))
    slots = words.groupBy("template", "slot").agg((F.max("n") / F.sum("n")).alias("top"))
    return {(r["template"], r["slot"]): r["top"] >= CONSTANT_SHARE for r in slots.collect()}


_GAP, _STOP = r"[ \t]+", r"(?=\s|\Z)"
_PIECES = {
    "w": r"[^\W\d]+(?:(?:::|[.\-/])[^\W\d]+)*(?!\w)",
    "x": r"(?=[^\W\d])(?:[^\W\d]+(?:::|[.\-/]))*[^\W\d]*\d\w*(?:(?:::|[.\-/])\w+)*",
    "n": r"\d+(?:\.\d+)?(?![\w.])",
    "m": r"\d\w*",
}
_SHOWN = {"T": "<ts>", "L": "<lvl>", "w": "<*>", "x": "<id>", "n": "<n>", "m": "<id>"}
_OPENING, _CLOSING = "[(<", "])>"


class Template:
    """A layout: its label, the pattern of what follows the time, and the name slots of the pattern."""

    __slots__ = ("label", "pattern", "names", "slot", "is_cut")

    def __init__(self, label: str, pattern: str, names: list[int], is_cut: bool):
        self.label, self.pattern, self.names, self.is_cut = label, re.compile(pattern), names, is_cut
        self.slot: int | None = names[0] if names else None

    def match(self, line: str) -> re.Match | None:
        m = _START.match(line)
        return self.pattern.match(line, m.end()) if m else None


def _type(token: str) -> str:
    return token.strip(" _") if token[-1] in "TLwxnmC$" else "mark"


def _closes(tokens: tuple[str, ...], i: int, known: Dictionary) -> bool:
    """The name at place i is a slot: what follows it is a constant border, or always a name that is a slot itself."""
    while i < len(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else "$"
        kind = _type(after)
        share = known.share(tokens, i + 1, after)
        if kind in ("mark", "L"):
            return share >= CONSTANT_SHARE or share >= BRANCH_SHARE and known.share(tokens, i + 1, None) >= CHAIN_SHARE
        if kind not in "wx" or share < CHAIN_SHARE:
            return False
        i += 1
    return False


def _is_id(tokens: tuple[str, ...], i: int, known: Dictionary) -> bool:
    """Most names in this slot carry digits, as those of hosts, threads and requests do."""
    after = tokens[i + 1] if i + 1 < len(tokens) else "$"
    blank = " " * tokens[i].startswith(" ")
    n = {k: known.n("^" + "".join(tokens[:i]) + blank + k, after) for k in "wx"}
    return n["x"] > n["w"] or n["x"] == n["w"] and tokens[i].endswith("x")


def template_of(shape: str, known: Dictionary) -> Template | None:
    """The layout of a shape as the dictionary tells it; None where the time is not the line's own."""
    tokens = tokens_of(shape)
    start = next((i for i, t in enumerate(tokens) if _type(t) == "T"), None)
    if start is None:
        return None
    i = end = start + 1
    if start and tokens[start - 1].strip(" _")[-1:] in tuple(_OPENING) and not tokens[start].startswith(" "):
        if i >= len(tokens) or tokens[i][0] not in _CLOSING:
            return None
        end = i + 1
        i += 1
    level = any(_type(t) == "L" for t in tokens[:start])
    fork = i
    slots: list[int] = []
    is_cut = after_slot = False
    while i < len(tokens):
        token, kind = tokens[i], _type(tokens[i])
        share = known.share(tokens, i, token)
        part = share > 0 if i == fork else share >= BRANCH_SHARE
        if kind == "C":
            is_cut = True
            break
        if not part:
            break
        if kind in "wx":
            if not _closes(tokens, i, known):
                break
            slots.append(i)
            end = i + 1
        elif kind == "L":
            after = tokens[i + 1] if i + 1 < len(tokens) else "$"
            if level or known.share(tokens, i + 1, after) < BRANCH_SHARE:
                break
            level, end = True, i + 1
        elif kind == "mark" and not token.startswith(" "):
            end = i + 1
        elif kind == "mark" and token.endswith("_"):
            if share < CONSTANT_SHARE and i > fork and not after_slot:
                break
            end = i + 1 if share >= CONSTANT_SHARE or after_slot else end
        after_slot = kind in "wx"
        i += 1
    names = [k for k, at in enumerate(slots) if at < end and not _is_id(tokens, at, known)]
    pieces: list[str] = []
    for k in range(start + 1, end):
        token, kind = tokens[k], _type(tokens[k])
        if kind == "mark":
            text = token.strip(" _")
            piece = re.escape(text) + (_STOP if token.endswith("_") else "")
        elif kind == "L":
            piece = rf"(?P<l>(?i:{_LEVEL_WORDS}))(?!\w)"
        else:
            slot = slots.index(k) if k in slots else None
            piece = rf"(?P<c{slot}>{_PIECES[kind]})" if slot in names else _PIECES[kind]
        pieces.append((_GAP if token.startswith(" ") else "") + piece)
    label = "".join((" " if t.startswith(" ") else "") + _SHOWN.get(_type(t), t.strip(" _")) for t in tokens[:end])
    found = Template(label, "".join(pieces), names, is_cut)
    open_slots = [k for k in names if not known.constant_slots.get((label, k))]
    found.slot = open_slots[0] if open_slots else found.slot
    return found


def field_roles(keys: tuple[str, ...], known: Dictionary) -> dict[str, str] | None:
    """Roles of an object's keys by the types of their values; customary names decide between keys of one type.

    None where the object is no log entry: it has no time, or neither a level nor a text.
    """
    layout = "{" + "\x1f".join(sorted(keys))
    types = {k: known.type_of(layout, k) for k in keys}
    roles: dict[str, str] = {}
    for role, kinds, customary in (("ts", ("time",), _TIME_KEYS), ("lvl", ("level",), _LEVEL_KEYS), ("msg", ("text", "other", "name", "id"), _TEXT_KEYS), ("name", ("name",), _NAME_KEYS)):
        able = [k for k in keys if k not in roles and types[k] in kinds and (role == "msg" or k.lower() not in _TEXT_KEYS)]
        best = [k for k in able if k.lower() in customary] or [k for k in able if role != "msg" or types[k] == "text"]
        if best:
            roles[best[0]] = role
    if "ts" not in roles.values() or not {"lvl", "msg"} & set(roles.values()):
        return None
    return roles


class Head:
    """What a line's head says: ts_ms, level, component, message and the template it follows."""

    __slots__ = ("ts_ms", "level", "component", "message", "template")

    def __init__(self, ts_ms: int, level: str, component: str, message: str, template: str):
        self.ts_ms, self.level, self.component = ts_ms, level, component
        self.message, self.template = message, template


_START = re.compile(
    rf"(?P<before>{_BEFORE})(?:(?P<iso>\d{{4}}[-/]\d\d[-/]\d\d[T ]{_PLAIN_CLOCK}{_PLAIN_ZONE}(?![\w:]))|(?P<any>{_PLAIN_TIME}(?![\w:])))|(?P<glued>[TDIWEF]{_GLUED_TIME}(?![\w:]))"
)


class Reader:
    """Reads lines by the dictionary; the template of a shape and the roles of an object's keys are found once."""

    def __init__(self, known: Dictionary):
        self.known = known
        self.templates: dict[str, Template | None] = {}
        self.roles: dict[tuple[str, ...], dict[str, str] | None] = {}
        self.days: dict[str, int | None] = {}

    def template(self, shape: str) -> Template | None:
        if shape not in self.templates:
            if len(self.templates) > 100_000:
                self.templates.clear()
            self.templates[shape] = template_of(shape, self.known)
        return self.templates[shape]

    def _iso_ms(self, text: str) -> int | None:
        """Epoch milliseconds of the plain ISO form, by its day and its clock."""
        day = text[:10]
        if day not in self.days:
            self.days[day] = _day_ms(int(day[:4]), int(day[5:7]), int(day[8:]))
        base, hour, minute, second = self.days[day], int(text[11:13]), int(text[14:16]), int(text[17:19])
        if base is None or hour > 23 or minute > 59 or second > 60:
            return None
        ms, rest = base + hour * 3_600_000 + minute * 60_000 + second * 1000, text[19:]
        if rest and rest[0] in ".,":
            digits = rest[1:]
            k = 0
            while k < len(digits) and digits[k].isdigit():
                k += 1
            ms += int((digits[:k] + "00")[:3])
            rest = digits[k:]
        return ms - _zone_ms(rest.strip() or None)

    def text_head(self, line: str, shape: str, year: int) -> Head | None:
        m = _START.match(line)
        if not m:
            return None
        if m.lastgroup == "iso" or m.group("iso"):
            ms = self._iso_ms(m.group("iso"))
        else:
            full = _TIMES[3].match(line) if m.group("glued") else _time_at(line, m.start("any"))
            ms = _time_ms(full, year) if full else None
        template = self.template(shape) if ms is not None else None
        if template is None:
            return None
        level = ""
        if m.group("glued"):
            level = level_name(line[0])
        elif m.end("before") > 1:
            level = level_name(m.group("before").strip("[(<>)]: \t"))
        hit = template.pattern.match(line, m.end())
        if not hit:
            return Head(ms, level, "", line[m.end() :].strip(), "")
        named = hit.groupdict()
        if named.get("l"):
            level = level or LEVELS[named["l"].lower()]
        component = named[f"c{template.slot}"] if template.slot is not None else ""
        return Head(ms, level, component, line[hit.end() :].strip(), template.label)

    def field_head(self, line: str, year: int) -> Head | None:
        pairs = _fields_of(line)
        keys = tuple(k for k, _ in pairs)
        if keys not in self.roles:
            if len(self.roles) > 100_000:
                self.roles.clear()
            self.roles[keys] = field_roles(keys, self.known) if keys else None
        roles = self.roles[keys]
        if roles is None:
            return None
        at = {roles[k]: v for k, v in pairs if k in roles}
        ms = _value_ms(at["ts"], year)
        if ms is None:
            return None
        name, text = at.get("name"), at.get("msg")
        label = "fields: " + " ".join(f"{k}=<{roles.get(k, '*')}>" for k in keys)
        return Head(ms, level_name(at.get("lvl")), name if isinstance(name, str) else "", text if isinstance(text, str) else "", label)

    def read(self, line: str, year: int) -> Head | None:
        """One plain line; batches take the shapes of many lines at once."""
        array = pa.array([line], pa.string())
        if pc.match_substring_regex(array, _TEXT_HEAD)[0].as_py():
            return self.text_head(line, shapes(array, self.known.words)[0].as_py(), year)
        return self.field_head(line, year) if line and (line[0] == "{" or _PAIR.match(line)) else None


HEADS = "stream_id bigint, line_no int, received_at timestamp_ntz, ts_ms bigint, level string, component string"


def parse_lines(lines: DataFrame, dictionary: Dictionary, with_message: bool = False) -> DataFrame:
    """Each delivered line with what its head says; ts_ms is null where no entry starts. No shuffle."""
    shared = lines.sparkSession.sparkContext.broadcast(dictionary)
    extra = ["message", "template"] if with_message else []
    schema = HEADS + "".join(f", {c} string" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            text = plain_lines(batch.column("line").cast(pa.string()))
            years = batch.column("_year")
            is_text = pc.fill_null(pc.match_substring_regex(text, _TEXT_HEAD), False)
            is_fields = pc.and_not(pc.fill_null(pc.match_substring_regex(text, rf"{_OBJECT_HEAD}|{_PAIR_HEAD}"), False), is_text)
            found: list[list] = [[None] * len(text) for _ in range(3 + len(extra))]

            def put(i: int, head: Head | None) -> None:
                if head is not None:
                    found[0][i], found[1][i], found[2][i] = head.ts_ms, head.level, _clean(head.component)
                    if extra:
                        found[3][i], found[4][i] = _clean(head.message), head.template

            at = pc.indices_nonzero(is_text)
            heads = pc.take(text, at)
            for i, line, shape, year in zip(at.to_pylist(), heads.to_pylist(), shapes(heads, reader.known.words).to_pylist(), pc.take(years, at).to_pylist()):
                put(i, reader.text_head(line, shape, year))
            at = pc.indices_nonzero(is_fields)
            for i, line, year in zip(at.to_pylist(), pc.take(text, at).to_pylist(), pc.take(years, at).to_pylist()):
                put(i, reader.field_head(line, year))
            columns = [batch.column(c) for c in ("stream_id", "line_no", "received_at")]
            columns += [pa.array(found[0], pa.int64()), *[pa.array(f, pa.string()) for f in found[1:]]]
            yield pa.RecordBatch.from_arrays(columns, ["stream_id", "line_no", "received_at", "ts_ms", "level", "component", *extra])

    narrow = lines.select(
        F.col("stream_id").cast("bigint").alias("stream_id"),
        F.col("line_no").cast("int").alias("line_no"),
        F.col("received_at").cast("timestamp_ntz").alias("received_at"),
        F.col("line").cast("string").alias("line"),
        F.coalesce(F.year("received_at"), F.lit(1970)).alias("_year"),
    )
    return narrow.where("stream_id is not null and line_no is not null").mapInArrow(run, schema)


def _clean(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def delivered_once(parsed: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per (stream_id, line_no), from the earliest delivery, with the line's ``_block``.

    The lines are shuffled here, by stream and block, and not again until entries are joined with the
    few that go on in later blocks.
    """
    rest = [c for c in parsed.columns if c not in ("stream_id", "line_no", "received_at")]
    blocked = parsed.withColumn("_block", F.floor(F.col("line_no") / F.lit(block_lines)).cast("int"))
    first = F.row_number().over(W.partitionBy("stream_id", "_block", "line_no").orderBy(F.col("received_at").asc_nulls_last()))
    parts = max(int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    together = blocked.repartition(parts, "stream_id", "_block")
    return together.withColumn("_turn", first).where("_turn = 1").select("stream_id", "_block", "line_no", *rest)


def assign_entries(once: DataFrame) -> DataFrame:
    """Adds ``entry_no``: the line_no of the head that a line belongs to, null before the first head."""
    own = F.when(F.col("ts_ms").isNotNull(), F.col("line_no"))
    inside = W.partitionBy("stream_id", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lasts = once.groupBy("stream_id", "_block").agg(F.max(own).alias("_last"))
    carried = value_before(lasts, ["stream_id"], "_block", "_last", "_carried", "max").drop("_last")
    return (
        once.withColumn("_own", F.max(own).over(inside))
        .join(carried, ["stream_id", "_block"])
        .withColumn("entry_no", F.coalesce("_own", "_carried"))
        .drop("_own", "_carried")
    )


def segments(once: DataFrame) -> DataFrame:
    """What each block holds of each entry; ``_own`` is null for the lines before the block's first head."""
    keep = [c for c in once.columns if c not in ("stream_id", "_block", "line_no")]
    own = F.when(F.col("ts_ms").isNotNull(), F.col("line_no"))
    inside = W.partitionBy("stream_id", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    head = F.max(F.when(F.col("line_no") == F.col("_own"), F.struct(*keep))).alias("_head")
    marked = once.withColumn("_own", F.max(own).over(inside))
    grouped = marked.groupBy("stream_id", "_block", "_own").agg(F.max("line_no").alias("last_line_no"), F.count(F.lit(1)).alias("n_lines"), head)
    return grouped.select("stream_id", "_block", "_own", "last_line_no", "n_lines", *[f"_head.{c}" for c in keep])


def entries(held: DataFrame) -> DataFrame:
    """One row per entry: line_no, last_line_no, n_lines and the columns of its head line.

    ``held`` are the segments, read twice: hand in a checkpointed or stored table.
    """
    keep = [c for c in held.columns if c not in ("stream_id", "_block", "_own", "last_line_no", "n_lines")]
    blocks = held.groupBy("stream_id", "_block").agg(
        F.max("_own").alias("_last"),
        F.max(F.when(F.col("_own").isNull(), F.struct("last_line_no", "n_lines"))).alias("_lead"),
    )
    goes_on = (
        value_before(blocks, ["stream_id"], "_block", "_last", "_own", "max")
        .where("_lead is not null and _own is not null")
        .groupBy("stream_id", "_own")
        .agg(F.max("_lead.last_line_no").alias("_to"), F.sum("_lead.n_lines").alias("_more"))
    )
    return (
        held.where("_own is not null")
        .join(goes_on, ["stream_id", "_own"], "left")
        .select(
            "stream_id",
            F.col("_own").alias("line_no"),
            F.coalesce("_to", "last_line_no").alias("last_line_no"),
            (F.col("n_lines") + F.coalesce("_more", F.lit(0))).alias("n_lines"),
            *keep,
        )
    )
