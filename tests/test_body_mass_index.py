import os

import pytest

from ambarina.operators import units as U
from ambarina.plans.queries import QUERIES

from folders import SMALL

VITALS = "lectura_id long, case_id string, nombre string, valor double, unidad string, unitem string, texto string"
UNITS = [("kg", "masa_corporal", "kg", True, 1.0, 0.0), ("lb", "masa_corporal", "lb", False, 0.453592, 0.0), ("cm", "longitud", "cm", True, 1.0, 0.0), ("m", "longitud", "m", False, 100.0, 0.0)]
WEIGHTS = [(1, "kg", None, None), (1, "Kg.", None, None), (1, "kilos", None, None), (1 / 0.453592, "libras", None, None), (1, None, "kg", None), (1, None, None, "pesa {} kg")]
HEIGHTS = [(1, "cm", None, None), (1, "cms", None, None), (0.01, "m", None, None), (1, None, None, "mide {} cm")]


def test_every_spelling_counts(spark, tmp_path):
    """Every way of writing a weight with every way of writing a height, each reading followed by one that must not be taken."""
    rows, want = [], {}
    for i, (w, h) in enumerate((w, h) for w in WEIGHTS for h in HEIGHTS for _ in range(4)):
        true = {"peso": 60.0 + i % 31, "talla": 155.0 + i % 37}
        for name, (factor, unit, unit2, text) in (("talla", h), ("peso", w)):
            value = round(true[name] * factor, 4)
            rows.append((len(rows), f"c{i}", name, None if text else value, unit, unit2, text and text.format(value)))
            rows.append((len(rows), f"c{i}", name, true[name] + 3, {"peso": "kg", "talla": "cm"}[name], None, None))
        want[f"c{i}"] = true["peso"] / (true["talla"] / 100) ** 2
    rows += [(len(rows), "no height", "peso", 70.0, "kg", None, None), (len(rows) + 1, "no amount", "peso", None, "kg", None, "sin datos")]
    rows += rows[:5]  # redelivered
    spark.createDataFrame(rows, VITALS).write.parquet(f"{tmp_path}/constantes.parquet")
    spark.createDataFrame(UNITS, "unidad_id string, magnitud string, simbolo string, es_comun boolean, factor double, desplazamiento double").write.parquet(f"{tmp_path}/unidades.parquet")
    got = {r.case_id: r.imc for r in QUERIES["body_mass_index"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 0.02 for c in want)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")
def test_every_case_with_both_readings(spark):
    """Against the readings in common units, joined by hand."""
    of = {r.lectura_id: r.case_id for r in spark.read.parquet(f"{SMALL}/constantes.parquet").collect()}
    first = {}
    for r in U.vitals_in_common_units(spark.read.parquet(f"{SMALL}/constantes.parquet"), spark.read.parquet(f"{SMALL}/unidades.parquet")).orderBy("lectura_id").collect():
        if r.comun > 0:
            first.setdefault((of[r.lectura_id], r.clase), r.comun)
    want = {c: kg / (first[c, "talla"] / 100) ** 2 for (c, k), kg in first.items() if k == "peso" and (c, "talla") in first}
    got = {r.case_id: r.imc for r in QUERIES["body_mass_index"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 0.001 for c in want)
