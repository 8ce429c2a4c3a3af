import pytest

from panelwright.llm import encoding

CLEAN = [
    "El señor tesorero pidió más tiempo; la población de Peñasco es de 25,000 habitantes según la última medición.",
    "The carry-over of ₱13.3 million stays – “as is” – and it doesn’t change (±4.0).",
    "A SITUAÇÃO DO CAIXA É BOA, MAS A PRESTAÇÃO DE CONTAS NÃO ESTÁ COMPLETA. A população é de 3 pessoas.",
    "请核对第54行的数据，合计与明细不一致。General Tagrante在2023年度报告的资本支出为64百万比索。",
    "matched 'Ñabowuwa' → 'Deguñoro' (≈10.88%), rows ≥ 5; … 9.2% (±6.5)\xa0Nota: 5º lugar",
    "Plain text only.",
    "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert encoding.repair(text) == (text, [], 0)


@pytest.mark.parametrize("enc", ["latin-1", "mac_roman", "cp437", "cp850", "iso8859-15"])
@pytest.mark.parametrize("text", CLEAN[:3])
def test_round_trip_of_utf8_read_as(enc, text):
    fixed, layers, lost = encoding.repair(text.encode().decode(enc))
    assert fixed == text and layers and not lost


def test_cp1252_with_undefined_bytes_and_two_layers():
    def read(s):
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in s.encode())

    t = CLEAN[1]
    assert encoding.repair(read(t))[0] == t
    assert encoding.repair(read(read(t)))[0] == t


def test_part_of_a_text_and_other_legacy_pairs():
    t = CLEAN[0] + "\n" + CLEAN[1]
    mixed = CLEAN[0].encode().decode("latin-1") + "\n" + CLEAN[1]
    assert encoding.repair(mixed)[0] == t
    assert encoding.repair("pagó más año".encode("cp1252").decode("mac_roman"))[0] == "pagó más año"
    assert encoding.repair("It doesn’t matter".encode("cp1252").decode("gbk"))[0] == "It doesn’t matter"


def test_lost_characters_are_reported():
    fixed, layers, lost = encoding.repair("La poblaci�n de Peñasco")
    assert lost == 1 and not layers and fixed == "La poblaci�n de Peñasco"


def test_restore(spark):
    bad = CLEAN[0].encode().decode("latin-1")
    rows = [(1, bad, "k"), (2, CLEAN[0], "t"), (3, None, "x"), (4, "", "x"), (5, bad, "k"), (6, "x" * 200_000 + " " + bad, "y"), (7, "caf�", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {r["doc_id"]: r for r in encoding.restore(df).collect()}
    assert set(got) == {1, 5, 6, 7} and got[1]["restored"] == CLEAN[0] and got[6]["restored"].endswith(CLEAN[0]) and not got[7]["complete"]
    assert encoding.restore(df.limit(0)).count() == 0


def test_many_layers_come_off():
    text = bad = "Año nuevo en Peñaranda, niñez"
    for _ in range(6):
        bad = "".join(bytes([b]).decode("latin-1") for b in bad.encode())
    assert encoding.repair(bad)[0] == text


def test_long_runs_are_not_remembered():
    encoding._remembered.cache_clear()
    encoding.repair("词汇" * 4000)
    assert encoding._remembered.cache_info().currsize == 0
