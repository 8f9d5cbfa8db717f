"""Find text that was decoded with the wrong encoding, and restore it.

Two kinds of *garbled sequences* are precomputed for every pair of encodings:

* UTF-8 bytes read with a one-byte encoding: every letter of a target alphabet gives one fixed
  sequence of two to four characters (``ü`` read as Windows-1252 is ``Ã¼``);
* one encoding read as another one-byte encoding, also the multi-byte encodings of Chinese, Japanese and
  Korean: the sequences are the garbled forms of the letter trigrams that the corpus itself uses, weighted by
  how much more often the right form occurs, each counted within its script.

One multi-pattern automaton finds all of them in a single pass over the text. Only matched spans
are replaced, so correct text around them stays as it is; a word that is not explained as a whole, because
letters of it belong to no sequence, is reported and left as it is. Sequences that also occur in correct text
(two Cyrillic letters, box drawings, a capital before a closing quote) count only in a run.

U+FFFD marks damage that cannot be restored. Characters between backticks are quoted examples.

Defined results: null and empty texts have no span; a repeated text has spans under each id;
restoring an unaffected text gives the text itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import checkpointed

#: One-byte encodings that UTF-8 is read with. Left out: cp874 and iso8859_5, in which correct Thai and Russian read as UTF-8.
UTF8_READERS = (
    "cp1252", "latin-1", "cp1254", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r",
    "cp1253", "cp1255", "cp1256", "cp1257", "cp852", "iso8859_2", "iso8859_7", "koi8_u", "mac_cyrillic",
)
#: Of these, the ones for which Chinese, Japanese and Korean text is looked for too.
WIDE_READERS = ("latin-1", "cp1252", "cp1254", "cp1251", "mac_roman", "cp437", "cp850")
#: One-byte encodings that are confused with each other: (right, read as).
BYTE_PAIRS = tuple(
    (right, wrong)
    for right in ("cp1252", "cp1254", "cp1250", "cp1251", "koi8_r", "cp866")
    for wrong in ("latin-1", "cp1252", "cp1254", "cp1250", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman")
    if right != wrong
)
#: Multi-byte encodings that are read with a one-byte encoding: (right, read as).
MULTI_PAIRS = tuple((right, wrong) for right in ("gb18030", "shift_jis", "euc_jp", "euc_kr", "big5") for wrong in ("latin-1", "cp1252"))
#: Code points that a garbled sequence may stand for: the alphabets from Latin to Georgian, punctuation, signs, drawings, emoji.
ALPHABET = (
    (0x80, 0x300),
    (0x370, 0x590),
    (0x5D0, 0x5EB),
    (0x620, 0x6D4),
    (0x900, 0x1100),
    (0x1E00, 0x2000),
    (0x2010, 0x203B),
    (0x20A0, 0x20C1),
    (0x2100, 0x2300),
    (0x2500, 0x27C0),
    (0xFF00, 0xFF62),
    (0xFFFD, 0xFFFE),
    (0x1F300, 0x1FB00),
)
WIDE_ALPHABET = ((0x3000, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4))
#: Letters whose two-byte sequences look like correct words in other scripts; they count only in a run.
RUN_ONLY = ((0x180, 0x218), (0x21C, 0x300), (0x370, 0x386), (0x3CF, 0x401), (0x460, 0x490), (0x492, 0x5D0), (0x64B, 0x6D4))
#: A trigram is part of the model from this share of all trigrams of its script on (per million).
LEAST_PPM = 3.0
#: Added to each share, so that an unseen trigram has a share too.
SMOOTH_PPM = 0.5
#: Least log ratio of right to garbled form for a trigram to be a pattern.
LEAST_RATIO = 1.5
#: Sum of the log ratios from which a line counts as garbled, and what a trigram of correct text takes off.
LINE_SCORE, KNOWN_PENALTY = 8.0, 2.0

#: Most that a garbled trigram with symbols adds to a line, as one drawing may look like a frequent trigram.
SYMBOL_RATIO = 2.5

_QUOTED = re.compile(r"`(?!\s)[^`\n]+(?<!\s)`")
_WORD = re.compile(r"[^\W\d_]*[^\W\d_\x00-\x7f][^\W\d_]*")
_SIGNS = re.compile(r"[A-Za-z\u0080-\U0010ffff]{3,}")
_RANK = {name: i for i, name in enumerate(UTF8_READERS)}
_CLOSING = "»”“’‘«„…—–‚•™"


def misread(data: bytes, encoding: str) -> str:
    """Bytes read with a one-byte encoding; bytes without a letter there stay control codes."""
    return "".join(
        piece if (piece := bytes([b]).decode(encoding, "replace")) != "�" else chr(b) for b in data
    )


@lru_cache(maxsize=64)
def _byte_table(right: str, wrong: str) -> dict[str, str]:
    """Garbled letter -> right letter for two one-byte encodings, where they differ."""
    table = {}
    for b in range(0x80, 0x100):
        good, bad = misread(bytes([b]), right), misread(bytes([b]), wrong)
        if good != bad:
            table[bad] = good
    return table


def script_of(char: str) -> int:
    """A number for the script of a letter beyond ASCII: Latin, Chinese and Japanese, or the block of 128 code points."""
    code = ord(char)
    return 0 if code < 0x250 or 0x1E00 <= code < 0x1F00 else 1 if 0x3000 <= code < 0xA000 else code >> 7


def _script(trigram: str) -> int:
    """The script of a trigram's first character beyond ASCII; trigrams with signs are one class."""
    return script_of(next(c for c in trigram if c > "\x7f")) if trigram.isalpha() else -1


@lru_cache(maxsize=1)
def utf8_sequences() -> dict[str, dict[str, str]]:
    """Garbled sequence -> {encoding: right character}."""
    found: dict[str, dict[str, str]] = defaultdict(dict)
    for readers, ranges in ((UTF8_READERS, ALPHABET), (WIDE_READERS, WIDE_ALPHABET)):
        tables = {e: [misread(bytes([b]), e) for b in range(256)] for e in readers}
        for low, high in ranges:
            for code in range(low, high):
                data = chr(code).encode()
                for encoding in readers:
                    table = tables[encoding]
                    found["".join([table[b] for b in data])][encoding] = chr(code)
    for b in range(0x80, 0xA0):  # a C1 control code is a Windows-1252 byte read as Latin-1
        good = bytes([b]).decode("cp1252", "replace")
        found[chr(b)]["c1"] = good
    found["�"]["lost"] = "�"
    return dict(found)


def _run_only(seq: str) -> bool:
    """All characters that the sequence may stand for are rare ones, and no encoding's own, which text garbled twice holds."""
    return all(c not in _readable() and any(low <= ord(c) < high for low, high in RUN_ONLY) for c in utf8_sequences().get(seq, {"": "\x00"}).values())


@lru_cache(maxsize=1 << 16)
def _weight(char: str, length: int) -> float:
    """What a sequence counts for a reading: its length, half of it for the Latin letters of few languages."""
    rare = "ƀ" <= char < "ʰ" and char not in "ƠơƯưȘșȚț" and char not in _readable()
    return length / 2 if rare else length


@lru_cache(maxsize=1)
def _readable() -> frozenset[str]:
    return frozenset(misread(bytes([b]), e) for e in WIDE_READERS for b in range(0x80, 0x100))


def _drawn(text: str) -> bool:
    """Only box drawings and blocks."""
    return all("─" <= c <= "▟" for c in text)


def _cyrillic(text: str) -> bool:
    return all("Ѐ" <= c <= "ӿ" for c in text)


@lru_cache(maxsize=1 << 18)
def _least_run(seq: str) -> int:
    """How many sequences must follow each other for this one to count; 0: only beside others that count."""
    if seq == "�" or len(seq) == 1:
        return 1
    if _drawn(seq):
        return 0
    if _cyrillic(seq):
        return 1 if seq[0].islower() and seq[1:].isupper() else 3
    if len(seq) == 3 and _cyrillic(seq[0]) and all(_cyrillic(c) or c in _CLOSING for c in seq[1:]):
        return 1 if seq[0].islower() and seq[1].isupper() else 2
    if len(seq) == 2 and (_run_only(seq) or all(c >= "Ͱ" and c.isalpha() for c in seq)):
        return 3
    if seq[0] in "–—×" or (seq[0] >= "Ͱ" and seq[0].isalpha() and seq[1] in _CLOSING and len(seq) == 2):
        return 2
    return 1


def _blank_quotes(text: str) -> str:
    return _QUOTED.sub(lambda m: "\x00" * len(m.group()), text) if "`" in text else text


def _trigrams(text: str) -> Iterator[str]:
    for word in _WORD.findall(text):
        for i in range(len(word) - 2):
            tri = word[i : i + 3]
            if not tri.isascii():
                yield tri


def _symbol_trigrams(text: str) -> Iterator[str]:
    """Trigrams of letters and of signs beyond ASCII, with at least one such sign."""
    for run in _SIGNS.findall(text):
        if not run.isalpha():
            for i in range(len(run) - 2):
                tri = run[i : i + 3]
                if not tri.isalpha() and not tri.isascii():
                    yield tri


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(script, trigram, n) over all texts without garbled UTF-8: trigrams with a letter or a sign beyond ASCII.

    Each task counts its own batches first, so the shuffle carries distinct trigrams only.
    """

    def rows(total: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame([(_script(t), t, n) for t, n in total.items()], columns=["script", "trigram", "n"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = _repairer(())
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch["t"]:
                if not text.isascii() and not tool.garbled_utf8(text):
                    total.update(_trigrams(text))
                    total.update(_symbol_trigrams(text))
            if len(total) > 500_000:
                yield rows(total)
                total = Counter()
        if total:
            yield rows(total)

    texts = df.select(F.col(text_col).cast("string").alias("t")).where("t is not null and t <> ''")
    return texts.mapInPandas(count, "script int, trigram string, n bigint").groupBy("script", "trigram").agg(F.sum("n").alias("n"))


def trigram_model(df: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Trigram -> per million of the trigrams of its script; those with signs per million of all letter trigrams.

    A script adds at most 1e6 / LEAST_PPM rows, however large the corpus and however small the script's part in it.
    """
    counts = checkpointed(trigram_counts(df, text_col))
    totals = counts.groupBy("script").agg(F.sum("n").alias("own"))
    words = totals.where("script >= 0").groupBy().agg(F.sum("own").alias("words"))
    kept = (
        counts.join(F.broadcast(totals), "script")
        .crossJoin(F.broadcast(words))
        .where(F.col("n") * 1e6 >= F.col("own") * LEAST_PPM)
        .select("trigram", (F.col("n") * 1e6 / F.when(F.col("script") >= 0, F.col("own")).otherwise(F.greatest("words", F.lit(1)))).alias("ppm"))
    )
    return {r["trigram"]: r["ppm"] for r in kept.collect()}


@lru_cache(maxsize=1 << 20)
def _encoded(text: str, right: str) -> bytes | None:
    try:
        return text.encode(right)
    except UnicodeEncodeError:
        return None


def byte_sequences(model: dict[str, float]) -> dict[str, dict[tuple[str, str], float]]:
    """Garbled trigram -> {(right, read as): log ratio of the right form to the garbled one}; garbled forms may hold any sign."""
    found: dict[str, dict[tuple[str, str], float]] = defaultdict(dict)
    right = [(tri, ppm) for tri, ppm in model.items() if tri.isalpha()]
    for pair in BYTE_PAIRS:
        back = {good: bad for bad, good in _byte_table(*pair).items()}
        for tri, ppm in right:
            garbled = "".join(back.get(c, c) for c in tri)
            if garbled == tri or any(c > "\x7f" and c not in back and not _same(c, pair) for c in tri):
                continue
            ratio = math.log((ppm + SMOOTH_PPM) / (model.get(garbled, 0.0) + SMOOTH_PPM))
            if ratio >= LEAST_RATIO:
                plain = all(c.isalnum() or c in "³²¹º°ª¼½¾" for c in garbled)
                found[garbled][pair] = ratio if plain else min(ratio, SYMBOL_RATIO)
    for pair in MULTI_PAIRS:
        for tri, ppm in right:
            data = _encoded(tri, pair[0]) if all(c >= "\u1100" for c in tri) else None
            if data and len(data) >= 6:
                found[misread(data, pair[1])][pair] = math.log((ppm + SMOOTH_PPM) / SMOOTH_PPM)
    return dict(found)


@lru_cache(maxsize=1 << 16)
def _same(char: str, pair: tuple[str, str]) -> bool:
    """Both encodings have the letter at the same byte."""
    try:
        return char.encode(pair[0]) == char.encode(pair[1])
    except UnicodeEncodeError:
        return False


def _whole_words(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The spans; where a run of characters beyond ASCII holds letters or control codes outside them, none of the run is replaced."""
    kept: list[tuple[int, int, str, str]] = []
    at = 0
    while at < len(found):
        low, high = found[at][0], found[at][1]
        while low > 0 and text[low - 1] > "\x7f":
            low -= 1
        last = at
        while high < len(text) and text[high] > "\x7f":
            high += 1
        while last + 1 < len(found) and found[last + 1][0] < high:
            last += 1
            high = max(high, found[last][1])
            while high < len(text) and text[high] > "\x7f":
                high += 1
        group = found[at : last + 1]
        covered = {i for start, end, _, _ in group for i in range(start, end)}
        broken = any(i not in covered and text[i] > "\x7f" and (text[i].isalpha() or text[i] < "\xa0") for i in range(low, high))
        kept += [(s, e, n, "") for s, e, n, _ in group] if broken else group
        at = last + 1
    return kept


def _multi_spans(text: str, low: int, high: int, pair: tuple[str, str]) -> list[tuple[int, int, str, str]]:
    """The line as one span; replaced only if all of it decodes."""
    right, wrong = pair
    name, line = f"{wrong}<{right}", text[low:high]
    try:
        data = b"".join(c.encode(wrong) if not "\x80" <= c < "\xa0" else c.encode("latin-1") for c in line)
        return [(low, high, name, data.decode(right))]
    except UnicodeError:
        return [(low, high, name, "")]


class Repairer:
    """The automaton over all garbled sequences with the rules on what counts."""

    def __init__(self, model: dict[str, float]):
        self.model = model
        self.utf8 = utf8_sequences()
        self.bytes = byte_sequences(model)
        self.automaton = ahocorasick.Automaton()
        for seq in {*self.utf8, *self.bytes}:
            self.automaton.add_word(seq, seq)
        self.automaton.make_automaton()

    def _parsed(self, ends: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
        """Matches without overlaps. In each stretch one encoding reads what it can, the one that reads most; other matches fill the rest."""
        spans = sorted({(e - len(s) + 1, e + 1, s) for e, s in ends if s in self.utf8})
        stretches: list[list[tuple[int, int, str]]] = []
        high = -1
        for span in spans:
            if span[0] > high:
                stretches.append([])
            stretches[-1].append(span)
            high = max(high, span[1])
        read: list[dict[str, list[tuple[int, int, str]]]] = []
        total: Counter[str] = Counter()
        weights: dict[tuple[int, str], float] = {}
        for stretch in stretches:
            by: dict[str, list[tuple[int, int, str]]] = {}
            for span in stretch:
                for encoding in self.utf8[span[2]]:
                    mine = by.setdefault(encoding, [])
                    if not mine or mine[-1][1] <= span[0]:
                        mine.append(span)
            for encoding, mine in by.items():
                total[encoding] += (worth := sum(_weight(self.utf8[seq][encoding], e - s) for s, e, seq in mine))
                weights[len(read), encoding] = worth
            read.append(by)
        found = []
        for n, by in enumerate(read):
            free: set[int] = set()
            order = sorted(by, key=lambda e: (e in ("c1", "lost"), -weights[n, e], -total[e], _RANK.get(e, 99)))
            for encoding in order:
                for start, end, seq in by[encoding]:
                    if free.isdisjoint(range(start, end)):
                        free.update(range(start, end))
                        found.append((start, end, seq, encoding))
        return sorted(found)

    def _utf8_hits(self, text: str, ends: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
        """Matches (start, end, sequence, encoding) that count, without overlaps."""
        runs: list[list[tuple[int, int, str, str]]] = []
        at = -1
        for span in self._parsed(ends):
            if runs and span[0] == at:
                runs[-1].append(span)
            else:
                runs.append([span])
            at = span[1]
        kept: list[tuple[int, int, str, str]] = []
        doubtful: list[tuple[int, int, str, str]] = []
        for run in runs:
            beside = text[max(0, run[0][0] - 1) : run[0][0]] + text[run[-1][1] : run[-1][1] + 1]
            latin = any(c.isascii() and c.isalpha() for c in beside)
            drawing = all(_drawn(seq) for _, _, seq, _ in run)
            for start, end, seq, encoding in run:
                least = _least_run(seq)
                if drawing or (len(run) < least and not (latin and _cyrillic(seq))):
                    continue
                before = text[start - 1 : start]
                if len(run) == 1 and len(seq) == 2 and seq[1] in _CLOSING and before.isalpha() and before.isupper():
                    doubtful.append((start, end, seq, encoding))
                else:
                    kept.append((start, end, seq, encoding))
        if kept and doubtful:
            kept = sorted(kept + doubtful)
        return kept

    def garbled_utf8(self, text: str) -> bool:
        clean = _blank_quotes(text)
        return bool(self._utf8_hits(clean, list(self.automaton.iter(clean))))

    def _byte_lines(
        self, text: str, ends: list[tuple[int, str]], read: list[tuple[int, int, str, str]]
    ) -> list[tuple[int, int, tuple[str, str]]]:
        """(start, end, pair) of the lines that read better in another one-byte encoding.

        Lines with garbled UTF-8 that restores (``read``) are left to the next turn.
        """
        lines: dict[int, dict[tuple[str, str], float]] = {}
        for end, seq in ends:
            if seq not in self.bytes:
                continue
            low = text.rfind("\n", 0, end) + 1
            score = lines.setdefault(low, defaultdict(float))
            for pair, ratio in self.bytes[seq].items():
                score[pair] += ratio
        found = []
        settled = {text.rfind("\n", 0, start + 1) + 1 for start, end, _, right in read if right and end > start + 1}
        for low, score in lines.items():
            if low in settled:
                continue
            pair, best = max(score.items(), key=lambda x: (x[1], x[0]))
            if best < LINE_SCORE:
                continue
            high = text.find("\n", low)
            high = len(text) if high < 0 else high
            if pair in MULTI_PAIRS:
                found.append((low, high, pair))
                continue
            table = _byte_table(*pair)
            for tri in chain(_trigrams(text[low:high]), _symbol_trigrams(text[low:high])):
                if tri in self.model and pair not in self.bytes.get(tri, ()) and any(c in table for c in tri):
                    best -= KNOWN_PENALTY
            if best >= LINE_SCORE:
                found.append((low, high, pair))
        return found

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, encoding, replacement) of the damaged places; '' as replacement: lost."""
        if not text or text.isascii():
            return []
        clean = _blank_quotes(text)
        ends = list(self.automaton.iter(clean))
        if not ends:
            return []
        hits = self._utf8_hits(clean, ends)
        found = [(start, end, encoding, "" if (right := self.utf8[seq][encoding]) == "�" else right) for start, end, seq, encoding in hits]
        found = _whole_words(text, found)
        taken = {i for start, end, _, _ in found for i in range(start, end)}
        for low, high, pair in self._byte_lines(clean, ends, found):
            if pair in MULTI_PAIRS:
                found = [f for f in found if not low <= f[0] < high] + _multi_spans(clean, low, high, pair)
                continue
            apart = [f for f in found if low <= f[0] < high and not f[3] and text[f[0]] != "�"]
            taken -= {i for start, end, _, _ in apart for i in range(start, end)}
            found = [f for f in found if f not in apart]
            table = _byte_table(*pair)
            found += [
                (i, i + 1, f"{pair[1]}<{pair[0]}", table[clean[i]])
                for i in range(low, high)
                if clean[i] in table and i not in taken
            ]
        return sorted(found)

    def restore(self, text: str) -> tuple[str, int, int, str]:
        """(restored text, damaged places, places that stay lost, encodings), repeated until nothing changes."""
        names: set[str] = set()
        seen = {text}
        damaged = lost = 0
        while True:
            spans = self.spans(text)
            if not spans:
                lost = 0
                break
            names.update(s[2] for s in spans)
            lost = sum(not s[3] for s in spans)
            damaged = damaged or len(spans)
            if lost == len(spans):
                break
            pieces, at = [], 0
            for start, end, _, right in spans:
                pieces += [text[at:start], right or text[start:end]]
                at = end
            text = "".join(pieces) + text[at:]
            if text in seen:
                break
            seen.add(text)
        return text, damaged, lost, ",".join(sorted(names))


@lru_cache(maxsize=2)
def _repairer(key: tuple[tuple[str, float], ...]) -> Repairer:
    return Repairer(dict(key))


def repair(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict[str, float] | None = None) -> DataFrame:
    """One row per affected text: id, restored, n_damaged, n_lost, encodings.

    One pass of mapInPandas without a shuffle; the automaton is built once per Python worker.
    """
    key = tuple(sorted((trigram_model(df, text_col) if model is None else model).items()))
    shared = df.sparkSession.sparkContext.broadcast(key)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = _repairer(shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch["_text"]):
                if text and not text.isascii():
                    restored, damaged, lost, names = tool.restore(text)
                    if damaged:
                        rows.append((key, restored, damaged, lost, names))
            yield pd.DataFrame(rows, columns=[id_col, "restored", "n_damaged", "n_lost", "encodings"])

    texts = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    schema = f"`{id_col}` {kind}, restored string, n_damaged int, n_lost int, encodings string"
    return texts.mapInPandas(run, schema)
