from __future__ import annotations

import pytest

from sieveline.llm.mojibake import UTF8_READERS, WIDE_READERS, Repairer, misread, repair, trigram_model

TEXTS = ["Für größere Aufträge genügt die Stufe — “so”…", "Değişiklikten sonra çıktı, şüpheli bir şey yok", "¿Por qué la función señala?", "予算を超えたため、変更後", "Отчёт сохранён, уровень доверия низкий"]
PLAIN = ["Það þarf að lesa aftur því ný skrá var rýr", "AÇÃO e REVISÃO “AMANHÃ”", "├── src\n│   └── a.ts\n┌──────┐", "The build printed `Ã¼` and `�`", "Её «копёр» — Сёмга, «ТАСС»", "naïve café → x", ""]


@pytest.fixture(scope="module")
def tool():
    return Repairer({})


@pytest.mark.parametrize("encoding", UTF8_READERS)
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_read_with_a_one_byte_encoding(tool, text, encoding):
    if encoding not in WIDE_READERS and "予" in text:
        pytest.skip("wide text is not looked for in these readings")
    garbled = misread(text.encode(), encoding)
    restored, damaged, _, _ = tool.restore(f"Before it.\n{garbled}\nAfter it.")
    assert damaged
    if encoding in ("latin-1", "cp1252", "mac_roman"):
        assert restored == f"Before it.\n{text}\nAfter it."


def test_garbled_twice(tool):
    twice = misread(misread(TEXTS[0].encode(), "cp1252").encode(), "cp1252")
    assert tool.restore(twice)[0] == TEXTS[0]


@pytest.mark.parametrize("text", PLAIN)
def test_correct_text_stays(tool, text):
    assert tool.restore(text) == (text, 0, 0, "")


def test_lost_characters_are_found_but_not_restored(tool):
    text, damaged, lost, _ = tool.restore("Die Pr�fung schl�gt fehl")
    assert (text, damaged, lost) == ("Die Pr�fung schl�gt fehl", 2, 2)


def test_one_byte_encodings_by_the_corpus_own_trigrams(spark):
    turkish, russian, icelandic = TEXTS[1] + " yalnızca güven düşük kaldı, alanını anıyor", TEXTS[4] + ", нужно сократить бюджет и повторить запуск", PLAIN[0]
    wrong = [misread(turkish.encode("cp1254"), "latin-1"), misread(russian.encode("koi8_r"), "cp1251")]
    rows = [(i, t) for i, t in enumerate([turkish, russian, icelandic] * 40 + wrong)] + [(900, None), (901, ""), (902, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, restored string")
    found = {r.doc_id: r.restored for r in repair(df).collect()}
    assert found == {120: turkish, 121: russian}
    assert repair(df.limit(0), model={}).count() == 0
    assert len(trigram_model(df)) > 20


@pytest.mark.parametrize(("right", "wrong"), [("koi8_r", "cp866"), ("koi8_r", "cp437"), ("cp866", "latin-1"), ("cp1251", "cp437"), ("koi8_r", "mac_roman"), ("cp1252", "cp437")])
def test_pairs_whose_garbled_form_holds_signs(right, wrong):
    from collections import Counter

    from sieveline.llm import mojibake as J

    russian = "отчёт сохранён, уровень доверия низкий, нужно сократить бюджет и повторить запуск"
    german = "größere Größe, außer für Grüße müßte das Gefäß größer und süßer sein, schöne größte Straße"
    drawing = "├── src\n│   └── a.ts\n┌──────┐\n│ “x” │ → ≤ 5 „größer“ …"
    counts = Counter(t for text in (russian, german, drawing) for t in (*J._trigrams(text), *J._symbol_trigrams(text)))
    tool = Repairer({t: n * 1e6 / sum(counts.values()) for t, n in counts.items()})
    text = german if right == "cp1252" else russian.replace("ё", "е") if right == "koi8_r" else russian
    assert tool.restore(misread(text.encode(right), wrong))[0] == text
    assert tool.restore(drawing) == (drawing, 0, 0, "")


SCRIPTS = ["ภาษาไทยทดสอบระบบ", "नमस्ते दुनिया", "გამარჯობა მსოფლიო", "Բարեւ աշխարհ", "Ελληνικά κείμενο", "שלום עולם", "مرحبا بالعالم", "Привіт, світе їжак", "你好世界测试", "안녕하세요 세계"]


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1254", "cp1250", "cp1253", "cp1257"])
@pytest.mark.parametrize("text", SCRIPTS)
def test_scripts_come_back_and_stay(tool, text, encoding):
    if encoding not in WIDE_READERS and text in SCRIPTS[-2:]:
        pytest.skip("wide text is not looked for in these readings")
    assert tool.restore(f"x {misread(text.encode(), encoding)} y größer")[0] == f"x {text} y größer"
    assert tool.restore(text) == (text, 0, 0, "")


def test_garbled_many_times(tool):
    text = "größere Aufträge"
    for _ in range(6):
        text = misread(text.encode(), "cp1252")
    assert tool.restore(text)[0] == "größere Aufträge"


def test_a_word_that_no_reading_explains_is_left_alone(tool):
    text = "Ã¼ßßbernÃ¼ chance, Ã¼ber"
    restored, damaged, lost, _ = tool.restore(text)
    assert (restored, damaged, lost) == ("Ã¼ßßbernü chance, über", 3, 1)


def test_long_quoted_examples_do_not_count(tool):
    text = "It printed `" + "Ã¼" * 200 + "` and went on"
    assert tool.restore(text) == (text, 0, 0, "")


@pytest.mark.parametrize(("right", "wrong"), [("gb18030", "latin-1"), ("gb18030", "cp1252"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"), ("euc_kr", "cp1252"), ("euc_jp", "cp1252")])
def test_multi_byte_encodings_by_the_corpus_own_trigrams(spark, right, wrong):
    known = {"gb18030": "这个测试成功了但是还有一些警告需要处理", "shift_jis": "テストは成功しましたが警告が残っています", "euc_kr": "테스트는성공했지만경고가남아있습니다", "euc_jp": "テストは成功しましたが警告が残っています"}[right]
    german = "größere Aufträge müssen geprüft werden"
    rows = [(i, t) for i, t in enumerate([known, german, german.upper()] * 20 + [f"ab 12: {misread(known.encode(right), wrong)} ok\nund größer"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.restored for r in repair(df).collect()} == {60: f"ab 12: {known} ok\nund größer"}


def test_a_rare_script_keeps_its_trigrams(spark):
    russian = "отчёт сохранён, нужно сократить бюджет и повторить запуск"
    rows = [(i, "größere Aufträge müssen überprüft werden " * 300) for i in range(400)] + [(900 + i, russian) for i in range(20)] + [(990, misread(russian.encode("koi8_r", "replace"), "cp1251"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in repair(df).collect()] == [990]
