import json
import os

import pyarrow.parquet as pq
import pytest

from ambarina.plans.queries import QUERIES

from folders import SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")


def first(name, key):
    """The rows of a table once a key, by hand."""
    out = {}
    for r in pq.read_table(f"{SMALL}/{name}.parquet").to_pylist():
        if r[key] not in out or r["recibido_en"] < out[r[key]]["recibido_en"]:
            out[r[key]] = r
    return list(out.values())


@pytest.fixture(scope="module")
def want():
    found = []
    for c in first("casos", "id"):
        d = c["diagnostico_principal"] or {}
        found += [(c["id"], "diagnostico_principal", 0, d.get("nombre"), s, d.get(s), d.get("snomed_termino")) for s in ("cie10", "snomed_ct")]
        found += [(c["id"], "procedimientos", i, p["nombre"], "snomed_ct", p["snomed_ct"], p["snomed_termino"]) for i, p in enumerate(c["procedimientos"] or [])]
    for e in first("entradas", "entrada_id"):
        if e["lista"] != "diagnostico_principal":
            found += [(e["case_id"], e["lista"], e["idx"], e["nombre"], s, e[s], e["snomed_termino"]) for s in ("cie10", "snomed_ct")]
    for m in first("medicaciones", "medicacion_id"):
        found += [(m["case_id"], "medicamentos", m["idx"], m["nombre"], s, m[s], m["snomed_termino"]) for s in ("atc", "snomed_ct")]
    return [f for f in found if f[5] is not None]


def test_codes_of_all_five_lists(spark, want):
    got = [tuple(r) for r in QUERIES["codes_relation"](spark, SMALL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[1] for g in got} == {"diagnostico_principal", "diagnosticos_secundarios", "sintomas", "procedimientos", "medicamentos"}


def test_counts_and_document_have_every_system(spark, want):
    distinct = {s: len({w[5] for w in want if w[4] == s}) for s in ("cie10", "snomed_ct", "atc")}
    rows = QUERIES["distinct_codes_by_system"](spark, SMALL).collect()
    assert {r.system: (r.n_codes, r.n_occurrences) for r in rows} == {s: (n, sum(w[4] == s for w in want)) for s, n in distinct.items()}
    doc = json.loads(QUERIES["summary_document"](spark, SMALL).first().document)
    assert doc["estadisticas_codigos"] == {f"{s}_unicos": n for s, n in distinct.items()}
    terms = {}
    for w in want:
        terms.setdefault((w[4], w[5]), set()).add(w[6])
    several = {k: len(t - {None}) for k, t in terms.items() if len(t - {None}) > 1}
    assert {(r.system, r.code): r.n_terms for r in QUERIES["ambiguous_codes"](spark, SMALL).collect()} == several
    assert QUERIES["code_frequency"](spark, SMALL).count() == len({w[4:] for w in want})
