"""Held-out evaluation passages inside a training corpus.

Pigeonhole edit matching on words. A passage is a run of ``min_words`` consecutive words of a test
item. With an error budget of ``k`` word edits it must be cut into ``k + 1`` pieces of which one
survives unchanged; items are therefore cut into aligned pieces short enough that *every* window of
``min_words`` words holds at least ``k + 1`` whole pieces. The pieces of all items form one lookup
table; every document is read once, each exact piece hit gives a candidate alignment, and the
candidate is verified: first by extending the exact run to both sides, then, for windows that are
not equal, with Myers' bit-parallel distance over words.

A word is a maximal run of letters and digits in any script, compared without regard to case.

Scale: documents are never shuffled or paired with each other. The piece table is broadcast in
blocks of items of bounded size (``block_words``), so a larger test set means more passes, not a
larger broadcast.

Defined results: null and empty texts and items with fewer than ``min_words`` words give no row; a
repeated document gives its rows under each id; repeated items are each reported.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W_]+")
#: Words of test items that one broadcast block may hold.
BLOCK_WORDS = 500_000

SCHEMA_TAIL = "longest_run int, distance int, doc_word int, item_word int"


def words(text: str | None) -> list[str]:
    """Words in a form that does not depend on case; both Turkish i count as one letter."""
    if not text:
        return []
    return [w.lower() if w.isascii() else w.upper().lower().replace("̇", "") for w in _WORDS.findall(text)]


def piece_length(min_words: int, max_errors: int) -> int:
    """Longest aligned piece for which each window of min_words holds max_errors + 1 whole pieces."""
    length = (min_words + 1) // (max_errors + 2)
    while (min_words - (length - 1)) // length < max_errors + 1:
        length -= 1
    if length < 1:
        raise ValueError("the error budget is too large for the window")
    return length


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any substring of the text, bit-parallel over words."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        peq[word] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, m
    for word in text:
        eq = peq.get(word, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        best = min(best, score)
    return best


class Matcher:
    """The pieces of one block of items, and the search of one document for them."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int, max_errors: int):
        self.min_words, self.max_errors = min_words, max_errors
        self.length = piece_length(min_words, max_errors)
        self.items = {key: ws for key, ws in items if len(ws) >= min_words}
        self.pieces: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for key, ws in self.items.items():
            for i in range(0, len(ws) - self.length + 1, self.length):
                self.pieces[tuple(ws[i : i + self.length])].append((key, i))
        #: Most words of a document start no piece: one look-up settles them.
        self.first = {piece[0] for piece in self.pieces}

    def _windows(self, doc: list[str], item: list[str], at: int, i: int) -> int | None:
        """Least distance within the budget of an item window around this piece to the document near it."""
        span, k = self.min_words, self.max_errors
        low, high = max(0, i + self.length - span), min(i, len(item) - span)
        best = None
        for start in range(low, high + 1):
            shift = at - i + start
            near = doc[max(0, shift - k) : shift + span + k]
            distance = myers_distance(item[start : start + span], near)
            if distance <= k and (best is None or distance < best):
                best = distance
        return best

    def search(self, ws: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(item, longest exact run, distance, word of the document, word of the item) of each leaked item."""
        found: dict[int, tuple[int, int, int, int]] = {}
        settled: dict[tuple[int, int], int] = {}
        length, span = self.length, self.min_words
        for at in range(len(ws) - length + 1):
            if ws[at] not in self.first:
                continue
            for key, i in self.pieces.get(tuple(ws[at : at + length]), ()):
                if settled.get((key, at - i), -1) > at:
                    continue
                item = self.items[key]
                left, right = 0, length
                while at - left > 0 and i - left > 0 and ws[at - left - 1] == item[i - left - 1]:
                    left += 1
                while at + right < len(ws) and i + right < len(item) and ws[at + right] == item[i + right]:
                    right += 1
                settled[(key, at - i)] = at + right
                run = left + right
                old = found.get(key)
                if run >= span:
                    distance: int | None = 0
                elif old and old[1] == 0 or not self.max_errors:
                    distance = None
                else:
                    distance = self._windows(ws, item, at, i)
                if distance is not None and (old is None or (distance, -run) < (old[1], -old[0])):
                    found[key] = (run, distance, at - left, i - left)
        return [(key, *rest) for key, rest in sorted(found.items())]


def _blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of bounded size, read one by one so that no more than a block is held."""
    block: list[tuple[int, list[str]]] = []
    held = 0
    for row in items.select(item_id, item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
        ws = words(row[1])
        if block and held + len(ws) > block_words:
            yield block
            block, held = [], 0
        block.append((row[0], ws))
        held += len(ws)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 13,
    max_errors: int = 1,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per (document, leaked item): longest exact run, distance of the best window, positions.

    ``distance`` is 0 where a whole window occurs unchanged, else 1..max_errors.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, {SCHEMA_TAIL}"
    columns = [doc_id, item_id, *(c.split()[0] for c in SCHEMA_TAIL.split(", "))]
    texts = docs.select(F.col(doc_id), F.col(doc_text).cast("string").alias("_text")).where("_text is not null")
    parts = []
    for block in _blocks(items, item_id, item_text, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, min_words, max_errors)
            for batch in batches:
                rows = [
                    (key, *hit)
                    for key, text in zip(batch[doc_id], batch["_text"])
                    for hit in matcher.search(words(text))
                ]
                yield pd.DataFrame(rows, columns=columns)

        parts.append(texts.mapInPandas(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
