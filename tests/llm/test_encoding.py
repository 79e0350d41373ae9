import pytest

from quillon.llm import encoding

FR = "// Où est passé le cache créé par le filtre ? Le délai est même à zéro."
RU = "# Здесь хранится последняя запись таблицы, проверка очереди перед закрытием файла."
PL = "// Proszę usunąć również stary plik; część sprawdza każdy błąd później."
ZH, KO, JA = "// 这里保存最后一条记录,先检查队列再关闭文件。", "// 마지막 기록을 여기에 저장한다 파일을 닫기 전에", "// ここでは最後の記録を保存する。ファイルを閉じる前に確認する。"


def read_as(text, true, wrong):
    if wrong in ("cp1252", "cp1251"):
        table = encoding._table(wrong)
        return "".join(table[b] for b in text.encode(true))
    return text.encode(true).decode(wrong)


CASES = [
    *[(FR, "utf-8", w) for w in ("latin-1", "cp1252", "cp437", "cp850", "mac-roman")],
    *[(RU, "utf-8", w) for w in ("latin-1", "cp1252", "cp1251")],
    *[(t, "utf-8", "cp1252") for t in (PL, ZH, KO, JA)],
    (RU, "koi8-r", "cp1251"), (RU, "cp1251", "latin-1"), (RU, "cp1251", "koi8-r"),
    (PL, "cp1250", "latin-1"), (PL, "cp1250", "cp1252"),
    (ZH, "gb2312", "latin-1"), (KO, "euc-kr", "latin-1"), (JA, "euc-jp", "latin-1"),
]


@pytest.mark.parametrize(("text", "true", "wrong"), CASES)
def test_round_trip(text, true, wrong):
    code = "x = 1\n{}\nmsg = 'naïve café'\n"
    garbled = code.format(read_as(text, true, wrong))
    back, n, _, bad = encoding.restore(garbled)
    assert bad and n > 0
    assert back == code.format(text)


def test_twice_garbled():
    bad = read_as(read_as(FR, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert encoding.restore(bad)[0] == FR


@pytest.mark.parametrize("layers", [3, 4, 6])
def test_many_layers(layers):
    bad = FR
    for _ in range(layers):
        bad = read_as(bad, "utf-8", "cp1252")
    assert encoding.restore(bad)[0] == FR


@pytest.mark.parametrize("text", [FR, RU, PL, ZH, KO, JA, "SEÇÃO DE CONFIGURAÇÃO: NÃO", "«РС» и «СССР»", "m³, x¹, ¿es?", "┌┬┐│└┴┘ ├──┤", '"Ã©": "é", "â€™": "’"', "cœur “fold” — 57 € § 4"])
def test_right_text_is_untouched(text):
    assert encoding.restore(text) == (text, 0, None, False)


def test_lost_characters():
    text, n, name, bad = encoding.restore("Wir k�nnen nicht")
    assert bad and n == 0 and text == "Wir k�nnen nicht" and name
    assert not encoding.restore('mark = "�"')[3]


def test_table(spark):
    long = "a" * 300_000 + read_as(FR, "utf-8", "latin-1")
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", None), (4, "Ã©tÃ©", "y"), (4, "Ã©tÃ©", "y"), (5, long, "z"), (6, "k�nnen", "q")]
    df = spark.createDataFrame(rows, "file_id bigint, raw_content string, restored string")
    assert sorted(r.file_id for r in encoding.found(df).collect()) == [4, 5, 6]
    got = encoding.repair(df).collect()
    assert len(got) == 7
    by = {r.file_id: r for r in got}
    assert by[4].restored == "été" and by[4].restorable and by[6].garbled and not by[6].restorable
    assert by[1].restored is None and not by[1].garbled and by[5].restored.endswith(FR)
    assert encoding.found(df.limit(0)).count() == 0
