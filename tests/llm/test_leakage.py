from __future__ import annotations

import random

import pytest

from sieveline.llm.leakage import Matcher, find_leaks, myers_distance, piece_length, words


def edit_distance_to_substring(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for word in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != word), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_words():
    assert words("Über-flow_2, x\tY's İI ıi") == ["über", "flow", "2", "x", "y", "s", "ii", "ii"]
    assert words(None) == [] and words("") == []


def test_myers_against_the_full_table():
    random.seed(1)
    for _ in range(300):
        a = random.choices("abcd", k=random.randint(1, 20))
        b = random.choices("abcd", k=random.randint(0, 30))
        assert myers_distance(a, b) == edit_distance_to_substring(a, b)


@pytest.mark.parametrize(("span", "errors"), [(13, 0), (13, 1), (13, 2), (8, 1)])
def test_every_window_holds_enough_pieces(span, errors):
    length = piece_length(span, errors)
    for start in range(200):
        whole = [i for i in range(0, 400, length) if start <= i and i + length <= start + span]
        assert len(whole) >= errors + 1


def brute(docs, items, span):
    found = set()
    for d, text in docs:
        ws = words(text)
        for k, item in items:
            iw = words(item)
            grams = {tuple(iw[i : i + span]) for i in range(len(iw) - span + 1)}
            if any(tuple(ws[i : i + span]) in grams for i in range(len(ws) - span + 1)):
                found.add((d, k))
    return found


def test_against_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(5, 40)))) for k in range(30)] + [(98, None), (99, "")]
    docs = [(d, " ".join(random.choices(vocabulary, k=random.randint(0, 60)))) for d in range(60)]
    for d in range(60, 120):
        k, text = random.choice(items[:30])
        ws = text.split()
        i = random.randint(0, max(0, len(ws) - 6))
        part = ws[i : i + random.randint(4, 20)]
        if len(part) > 8 and d % 3 == 0:
            part[4] = "EDIT"
        docs.append((d, "Ab, " + "\t ".join(part).upper() + " end"))
    docs += [(500, None), (501, ""), (502, items[0][1]), (503, items[0][1])]
    dd = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id bigint, text string")
    for span, errors, block in ((6, 0, 10**6), (6, 1, 40)):
        got = find_leaks(dd, ii, min_words=span, max_errors=errors, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= span} == brute(docs, items, span)
        assert all(r.distance == 0 for r in got if r.longest_run >= span)
    assert find_leaks(dd, ii.limit(0)).count() == 0
    assert find_leaks(dd.limit(0), ii).count() == 0


def test_edited_windows_are_found():
    item = [f"w{i}" for i in range(20)]
    matcher = Matcher([(1, item)], 13, 1)
    for at in range(13):
        for edited in (item[:at] + ["x"] + item[at + 1 : 13], item[:at] + item[at + 1 : 14], item[:at] + ["x"] + item[at:13]):
            assert matcher.search(["a", *edited, "b"])[0][2] <= 1
