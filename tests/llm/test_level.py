import pytest

from ambarina.llm import level as L

SAMPLE = "/root/testdata/sf0.01"
EASY, HARD = "La gata bebe agua y el oso come pan. ", "La farmacocinética subendotelial del polimorfismo condiciona la trombofilia. "


@pytest.fixture(scope="module")
def model():
    return L.train([(EASY * 3 + HARD, 1), (HARD * 3, 4), (None, 2), ("", 3), ("palabra normal de todos", 2)])


def test_body_decides_over_odd_sentences(model):
    assert model.level(EASY * 10 + HARD)[0] == 1 and model.level(HARD * 10 + EASY)[0] == 4
    assert model.levels == (1, 2, 4)


def test_defined_results(model):
    assert model.level(None) == (None, None, 0) and model.level("") == (None, None, 0) and model.level(" 12 -- ") == (None, None, 2)
    assert model.level("zzz")[0] == 1  # nothing known: equal, the lower level
    assert L.train([]).level("hola")[0] == 1
    assert model.level(EASY * 20000)[0] == 1


def test_mended():
    assert L.mended("mÃ©dico y niÃ±o") == "médico y niño" and L.mended("año") == "año" and L.mended("Ã sola") == "Ã sola"
    assert L.words("MÃ©dico él 3 veces") == ["médico", "él", "veces"]


def test_rows(spark, model):
    df = spark.createDataFrame([(1, EASY * 9, "x", "es"), (2, None, "x", None), (3, HARD, None, "en"), (None, "", "y", "es-ES")], "doc_id long, text string, nivel string, lang string")
    got = {r.doc_id: r.nivel for r in L.levels(df, model).collect()}
    assert got == {1: 1, 2: None, 3: 4, None: None}
    assert L.levels(df.limit(0), model).count() == 0
    marks = spark.createDataFrame([(x,) for x in ("es", "ES", "español", "es-ES", "spa", " es ", None, "en", "ca", "pt", "est")], "lang string")
    assert [r[0] for r in marks.select(L.spanish(marks.lang)).collect()] == [True] * 7 + [False] * 4
    assert L.profile(L.levels(df, model, keep=("lang",)), "lang").count() == 4


def test_seeds_and_bound(spark):
    df = spark.createDataFrame([(i, (EASY if i % 2 else HARD) * 5) for i in range(40)] + [(99, None)], "doc_id long, text string")
    seeded = L.seeds(df, most=10)
    assert len(seeded) == 10 and {lv for t, lv in seeded if t.startswith("La gata")} != {lv for t, lv in seeded if t.startswith("La farm")}
    known = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 2), (3, None), (1000, 1)], "doc_id long, nivel int")
    assert len(L.labelled_texts(df, known)) == 40 and len(L.labelled_texts(df, known, most=5)) <= 5


def test_counting_in_tasks_gives_the_same_model(spark):
    rows = [(EASY * 3 + HARD, 1), (HARD * 3, 4), (None, 2), ("", 3), ("palabra normal de todos", 2), ("sin nivel", None)]
    df = spark.createDataFrame(rows * 3, "text string, nivel int").repartition(5)
    assert L.fitted(df) == L.train(rows * 3)
    assert L.fitted(df.filter("text is null")) is None


def test_held_out_accuracy(spark):
    import os

    if not os.path.exists(SAMPLE.replace("0.01", "0.1")):
        pytest.skip("no sample")
    d = SAMPLE.replace("0.01", "0.1")
    rows = L.labelled_texts(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/niveles_muestra.parquet"))
    right = sum(L.train([r for j, r in enumerate(rows) if j % 5 != f]).level(t)[0] == lv for f in range(5) for t, lv in rows[f::5])
    assert right >= 0.97 * len(rows)
