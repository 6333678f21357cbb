import random

import pytest

from ambarina.operators import units as U

UNITS = [("kg", "masa_corporal", "kg", True, 1.0, 0.0), ("lb", "masa_corporal", "lb", False, 0.453592, 0.0), ("celsius", "temperatura", "°C", True, 1.0, 0.0), ("fahrenheit", "temperatura", "°F", False, 5 / 9, -160 / 9),
         ("cm", "longitud", "cm", True, 1.0, 0.0), ("m", "longitud", "m", False, 100.0, 0.0), ("mm", "longitud", "mm", False, 0.1, 0.0), ("mg", "dosis_masa", "mg", True, 1.0, 0.0), ("g", "dosis_masa", "g", False, 1000.0, 0.0),
         ("ml", "dosis_volumen", "ml", True, 1.0, 0.0), ("l", "dosis_volumen", "l", False, 1000.0, 0.0), ("ui", "dosis_actividad", "UI", True, 1.0, 0.0), ("kui", "dosis_actividad", "kUI", False, 1000.0, 0.0), ("pct_pv", "dosis_concentracion", "% p/v", False, 10.0, 0.0), ("mg_ml", "dosis_concentracion", "mg/ml", True, 1.0, 0.0)]
VITALS = "lectura_id long, case_id string, nombre string, valor double, unidad string, unitem string, texto string, origen string"


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "unidad_id string, magnitud string, simbolo string, es_comun boolean, factor double, desplazamiento double")


@pytest.mark.parametrize("text,want", [("75,3", 75.3), ("1.200.000", 1.2e6), ("1 200 000", 1.2e6), ("1.234,5", 1234.5), ("0.850", 0.85), ("20.000", 20000.0), ("5", 5.0), ("1,234.5", 1234.5), ("x", None)])
def test_number_styles(text, want):
    assert U.number(text) == want


def test_doses(spark, units):
    rows = [("500 mg", "", "mg", 500.0), ("mg 250", None, "mg", 250.0), ("½ g", None, "g", 0.5), ("1/2 g", None, "g", 0.5), ("medio gramo", None, "g", 0.5), ("2000/1000 mg", None, "mg", 2000.0), ("de 5 a 10 mg.", None, "mg", 5.0),
            ("1 200 000U.I.", None, "ui", 1.2e6), ("600 miles de unidades", None, "kui", 600.0), ("5 g/100 ml", None, "pct_pv", 5.0), ("g/100 ml 0.5", None, "pct_pv", 0.5), ("5", "Dosis expresada en ml; una toma", "ml", 5.0),
            ("ver posología", "Tomar g 0.25 cada 8 horas, no pasar de 4 gramos en 24 h", "g", 0.25), (None, "cada 6 horas: 5 mg por ml", "mg_ml", 5.0), ("", "medio comprimido, con 200 ml de agua", None, None),
            (None, "1 sobre por la noche, disuelto en medio litro de agua", None, None), ("N/A", None, None, None), ("0", "x" * 5000, "mg", 0.0)]
    df = spark.createDataFrame([(i, *r[:2], "extra") for i, r in enumerate(rows)] * 2, "medicacion_id long, dosis string, posologia string, valor string")
    got = {r.medicacion_id: (r.unidad_id, r.valor) for r in U.doses_in_common_units(df, units).collect()}
    assert {i: got.get(i, (None, None)) for i in range(len(rows))} == {i: r[2:] for i, r in enumerate(rows)}


def test_vitals_stated_misstated_and_missing(spark, units):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        cm, c = rng.gauss(170, 9), rng.gauss(37.5, 0.8)
        rows += [(2 * i, "a", "talla", float(round(cm)), rng.choice(["cm", "CM", "centímetros"]), None, None, "x"), (2 * i + 1, "a", "temperatura", round(c * 1.8 + 32, 1) if i % 5 == 0 else round(c, 1), "ºF" if i % 5 == 0 else "grados", None, None, None)]
    cases = [(9000, "talla", 1.71, None, None, None, "m"), (9001, "talla", 1.8, "cm", None, None, "m"), (9002, "talla", 1702.0, "-", None, "sin incidencias", "mm"), (9003, "temperatura", 99.5, "°C", None, None, "fahrenheit"),
             (9004, "temperatura", 37.0, "", None, None, "celsius"), (9005, "talla", 205.0, "cm", None, None, "cm"), (9006, "talla", None, None, None, "a las 9:30 Talla de 1,80 mts; se repetirá en 15 min", "m"),
             (9007, "temperatura", None, None, None, "Tª 104,2F, en reposo", "fahrenheit"), (9008, "talla", 1.6, None, "mts", None, "m"), (9009, "talla", 66.0, None, None, "anotado en m por el paciente", "m"), (9010, "talla", -3.0, None, None, None, "cm")]
    rows += [(i, "b", n, v, u, u2, t, None) for i, n, v, u, u2, t, _ in cases]
    rows += [(9100, "b", "talla", None, None, None, "rechaza la toma", None), (9101, "b", "otra cosa", 3.0, "cm", None, None, None), (9102, "b", None, 3.0, "cm", None, None, None), rows[0]]
    got = {r.lectura_id: r for r in U.vitals_in_common_units(spark.createDataFrame(rows, VITALS), units).collect()}
    assert {i: got[i].unidad_id for i, *_, u in cases if i != 9009} == {i: u for i, *_, u in cases if i != 9009}
    assert got[9010].incierto and not got[9000].incierto and got[9001].juicio == "corregida" and abs(got[9001].comun - 180) < 1e-9
    assert not {9100, 9101, 9102} & set(got) and len(got) == 1200 + len(cases)


def test_empty_tables(spark, units):
    assert U.vitals_in_common_units(spark.createDataFrame([], VITALS), units).count() == 0
    assert U.doses_in_common_units(spark.createDataFrame([], "medicacion_id long, dosis string, posologia string"), units).count() == 0


def test_ambiguous_amounts_are_flagged(spark, units):
    """Weights in kg and lb alike: a bare number that either could be is uncertain, one that only one could be is not; and a statement that
    the other unit contradicts without being sure stands, flagged."""
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        kg = rng.gauss(75, 12)
        rows.append((i, "a", "peso", round(kg if i % 2 else kg / 0.453592, 1), "kg" if i % 2 else "lb", None, None, None))
    rows += [(9000, "a", "peso", 113.0, None, None, None, None), (9001, "a", "peso", 72.0, None, None, None, None), (9002, "a", "peso", 190.0, None, None, None, None)]
    rows += [(9004, "a", "perimetro", 90.0, "cm", None, None, None), (9005, "a", None, 90.0, "cm", None, None, None), (9006, "a", "peso", None, "kg", None, "no se toma", None)]
    df = spark.createDataFrame(rows, VITALS)
    got = {r.lectura_id: (r.unidad_id, r.juicio, r.incierto) for r in U.vitals_in_common_units(df, units).collect()}
    assert got[9000][1:] == ("inferida", True) and got[9001] == ("kg", "inferida", False) and got[9002] == ("lb", "inferida", False)
    # a statement where many are wrong: kept, but doubted
    fits = {"peso": U.Fit(4.317, 0.16, {"kg": 0.5, "lb": 0.5}, 0.2, 25.0, 300.0)}
    said = spark.createDataFrame([(1, "peso", "masa_corporal", 118.0, "kg"), (2, "peso", "masa_corporal", 80.0, "kg"), (3, "peso", "masa_corporal", 165.0, "kg")], "lectura_id long, clase string, magnitud string, valor double, dicha string")
    assert {r.lectura_id: (r.unidad_id, r.juicio, r.incierto) for r in U.assign(said, fits, U.units_of(units)).collect()} == {1: ("kg", "dicha", True), 2: ("kg", "dicha", False), 3: ("lb", "corregida", False)}
    assert {r.lectura_id: r.motivo for r in U.unread_vitals(df, units).collect()} == {9004: "clase desconocida", 9005: "clase desconocida", 9006: "sin cantidad"}


def test_doses_without_units_by_the_mixture(spark, units):
    rng = random.Random(2)
    rows = [(i, f"{rng.choice([250, 400, 500, 650, 750, 1000])} mg" if i % 3 else f"{rng.choice(['0,5', '1', '0,25'])} g", None) for i in range(900)]
    rows += [(9000, "500", None), (9001, "0,5", "tras las comidas"), (9002, "650", ""), (9003, None, "con agua")]
    df = spark.createDataFrame(rows, "medicacion_id long, dosis string, posologia string")
    got = {r.medicacion_id: r for r in U.doses_in_common_units(df, units).collect()}
    assert [(got[i].unidad_id, got[i].juicio) for i in (9000, 9001, 9002)] == [("mg", "inferida"), ("g", "inferida"), ("mg", "inferida")]
    assert abs(got[9001].comun - 500) < 1e-9 and not got[9001].incierto
    assert [tuple(r) for r in U.unread_doses(df, units).collect()] == [(9003, "sin cantidad")] and len(got) == 903
