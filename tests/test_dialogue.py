import json
import random

import pytest
from pyspark.sql import functions as F

from ambarina.functions import codes as C
from ambarina.functions import text as X
from ambarina.operators import codes as K
from ambarina.operators import dialogue as D
from ambarina.operators import manifest as M
from ambarina.operators import packing as P
from ambarina.operators import status as S
from ambarina.operators import summary as U
from ambarina.schema import CASE
from ambarina.sources import cases as R
from ambarina.sources import sinks


def plain_fold(lengths, budget=4500):
    out, c, s, filled = [], 0, 0, False
    for n in lengths:
        if filled and s + n > budget:
            c, s = c + 1, 0
        s, filled = s + n, True
        out.append(c)
    return out


def packed(spark, by_case, **kw):
    df = spark.createDataFrame([(k, i, n, "x") for k, ns in by_case.items() for i, n in enumerate(ns)], "case_id string, seq int, n_chars long, chunk_no string")
    got = {}
    for r in P.pack(df, **kw).collect():
        got.setdefault(r.case_id, {})[r.seq] = r.chunk_no
    return {k: [v[i] for i in sorted(v)] for k, v in got.items()}


def test_fold_edges(spark, monkeypatch):
    rng = random.Random(1)
    cases = {"exact": [4000, 500, 1], "over": [5001], "between": [10, 4600, 10], "zero": [0, 4500, 0, 1], "one": [1]}
    cases |= {f"r{i}": [rng.choice([0, 1, 300, 2000, 4499, 4500, 4501, rng.randint(0, 6000)]) for _ in range(rng.randint(1, 60))] for i in range(40)}
    want = {k: plain_fold(v) for k, v in cases.items()}
    assert packed(spark, cases) == want
    monkeypatch.setattr(P, "FOLD_TURNS", 3)  # the streamed way gives the same
    assert packed(spark, cases) == want
    kept = packed(spark, cases, limit=5000)
    assert all(kept[k] == (want[k] if sum(v) > 5000 else [0] * len(v)) for k, v in cases.items())
    assert packed(spark, {"a": []}) == {} and P.route(spark.createDataFrame([("a", 5000), ("b", 5001)], "c string, n_chars long")).collect()[1].route == "chunked"


def case(id_="a", turns=(("medico", "Hola."), ("paciente", "Adiós.")), **changes):
    doc = {"id": id_, "especialidad": "X", "audio_file": f"audios/x/{id_}.mp3", "diagnostico_principal": {"nombre": "d", "cie10": "A00.0", "snomed_ct": "N/A", "es_rara": False}, "voces": {"medico_voice_id": "m", "paciente_voice_id": "p"},
           "transcripcion": [{"fase": "motivo_consulta", "dialogos": [{"rol": r, "texto": t} for r, t in turns]}], "sintomas": [{"nombre": "s", "cie10": "R06.0", "snomed_ct": "123456"}],
           "medicamentos": [{"nombre": "z", "atc": "B01AC06 / N02BA01", "snomed_ct": "1"}], "validacion": {"correcciones_aplicadas": ["A00.0 → A00.1 (x); E10.1 → E10.2", "CM → Internacional"], "fuentes_validacion": ["https://a - n", "https://a"]}}
    for k, v in changes.items():
        if v is ...:
            doc.pop(k)
        else:
            doc[k] = v
    return doc


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cases") / "ñ dir+x"
    d.mkdir()
    docs = {
        "ok": case("ok"), "none": case("none", turns=()), "role": case("role", turns=[("medico", "a"), ("padre", "b")]), "voice": case("voice", voces={"paciente_voice_id": "p"}, turns=[("paciente", "b")]),
        "text": case("text", turns=[("medico", None)]), "audio": case("audio", audio_file=...), "dx": case("dx", diagnostico_principal={"cie10": "x"}), "trans": case("trans", transcripcion=...), "phase": case("phase", transcripcion=[{"fase": "x"}]), "noid": case("noid", id=...),
    }
    for n, doc in docs.items():
        (d / f"{n}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    (d / "cut.json").write_text('{"id": "cut", ', encoding="utf-8")
    (d / "array.json").write_text(json.dumps([case("a1"), case("a2")]), encoding="utf-8")
    (d / "_hidden.json").write_text(json.dumps(case("hidden")), encoding="utf-8")
    (d / "note.txt").write_text("x")
    return d


def test_every_file_has_one_status(spark, folder):
    cases = R.one_row_a_file(R.read_cases(spark, str(folder)))
    got = {r.path.rsplit("/", 1)[-1][:-5]: (r.status, r.reason) for r in S.nested_status(cases).collect()}
    reasons = {"role": "role without voice", "voice": "no voces.medico_voice_id", "text": "turn without texto", "audio": "no audio_file", "dx": "no diagnostico_principal.nombre", "trans": "no transcripcion", "phase": "phase without dialogos", "noid": "no id"}
    assert {k: v[1] for k, v in got.items() if k in reasons} == reasons
    assert got["ok"] == got["none"] == ("success", None) and got["cut"][0] == got["array"][0] == "failed" and len(got) == 12
    assert {r.status: r.n_cases for r in S.rollup(S.nested_status(cases)).collect()} == {"success": 2, "failed": 10}
    assert "ñ dir+x" in R.sorted_paths(cases).first().path
    named = R.read_named(spark, [str(folder / "_hidden.json"), str(folder / "absent.json"), str(folder / "cut.json")])
    assert [r.status for r in S.nested_status(named).orderBy("path").collect()] == ["success", "failed", "failed"]
    assert R.read_cases(spark).count() == 0
    spark.conf.set("my.key", "")
    assert R.required_setting(spark, "my.key", "d") is None and R.required_setting(spark, "my.other", "d") == "d"


def test_turns_voices_requests(spark):
    docs = [case("a", turns=[("medico", "[x] uno"), ("padre", "dos"), ("paciente", 'tres "q"')]), case("b", turns=())]
    docs[0]["transcripcion"].insert(0, {"fase": "vacía", "dialogos": []})
    docs[0]["transcripcion"].append({"fase": "plan", "dialogos": [{"rol": "medico", "texto": "fin", "audio_tag": "t"}]})
    cases = spark.read.schema(CASE).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))
    turns = D.turns_of(cases)
    assert [tuple(r) for r in turns.orderBy("case_id", "seq").select("case_id", "phase_idx", "turn_idx", "seq", "rol").collect()] == [("a", 1, 0, 0, "medico"), ("a", 1, 1, 1, "padre"), ("a", 1, 2, 2, "paciente"), ("a", 2, 0, 3, "medico")]
    voiced = D.with_voice(turns, cases)
    assert [r.voice_id for r in voiced.orderBy("seq").collect()] == ["m", None, "p", "m"] and D.voice_dimension(cases).count() == 4
    flat = S.flat_status(cases, turns)
    assert {r.case_id: (r.n_turns, r.reason) for r in flat.collect()} == {"a": (4, "role without voice"), "b": (0, None)}
    chunks = P.plan_chunks(turns, flat.select("case_id", "n_turns", "n_chars"), limit=5, budget=8)
    body = M.requests(voiced, chunks).filter("chunk_no = 0").first()
    assert json.loads(body.payload)["inputs"][0] == {"text": "[x] uno", "voice_id": "m"} and json.loads(body.payload)["model_id"] == "eleven_v3"
    parts = M.chunk_paths(chunks, cases.select(F.col("id").alias("case_id"), M.output_path("/root", "audio_file").alias("path")))
    assert [r.part for r in parts.filter("case_id = 'a'").orderBy("chunk_no").collect()][0] == "/root/audios/x/a_part1.mp3"
    assert M.file_lists(parts).first().content.startswith("file '/root/audios/x/a_part1.mp3'\nfile '")
    one = spark.range(1).select(M.part_path(F.lit("a.mp3/b.mp3"), F.lit(0)).alias("p"), M.output_path("/r", F.lit("/abs.mp3")).alias("q"), M.kilobytes(F.lit(256)).alias("k"), M.folder(F.lit("x/y/z.mp3")).alias("f")).first()
    assert tuple(one) == ("a_part1.mp3/b_part1.mp3", "/abs.mp3", 0.2, "x/y")
    assert [tuple(r) for r in spark.createDataFrame([(x,) for x in ("Médico", " DOCTOR", "padre", "?", None)], "r string").select(D.canonical_rol("r")).collect()] == [("medico",), ("medico",), ("padre",), (None,), (None,)]


def test_codes_and_summary(spark):
    cases = spark.read.schema(CASE).json(spark.sparkContext.parallelize([json.dumps(case("a")), json.dumps(case("b", especialidad="Y", diagnostico_principal={"nombre": "e", "cie10": "A00.0", "es_rara": True}))]))
    codes = K.codes_of(cases)
    assert {r.system: r.n_codes for r in K.distinct_codes(codes).collect()} == {"cie10": 2, "snomed_ct": 3, "atc": 1}
    assert {tuple(r) for r in K.corrections_of(cases).filter("case_id = 'a'").collect()} == {("a", "A00.0", "A00.1"), ("a", "E10.1", "E10.2")}
    assert {r.corrected for r in K.apply_corrections(codes, K.corrections_of(cases).filter("case_id = 'b'")).filter("case_id = 'a' and code = 'A00.0'").collect()} == {"A00.0"}
    assert [r.fuente for r in U.validation_sources(cases).collect()] == ["https://a"]
    doc = json.loads(U.summary_document(cases, D.turns_of(cases), codes).first().document)
    assert doc["total_transcripciones"] == 2 and doc["especialidades"]["Y"] == {"total": 1, "comunes": 0, "raras": 1}
    assert tuple(spark.range(1).select(C.atc_codes(F.lit("A / B")), C.atc_codes(F.lit("N/A")), C.atc_level(F.lit("C03C")), C.real(F.lit("N/A")), X.semantic_tag(F.lit("x (y) (disorder)")), X.leading_tag(F.lit("no [t]")), X.age_years(F.lit(6), F.lit("meses")), X.without_tags(F.lit("[a] b [c] d"))).first()) == (["A", "B"], [], 3, None, "disorder", None, 0.5, "b d")
    assert tuple(U.sizes_mb(spark.createDataFrame([], "n_bytes long")).first()) == (0, None, None)


def test_outcomes_and_sink(spark, tmp_path):
    answers = spark.createDataFrame([("a", 0, 200), ("a", 1, 500), ("a", 2, 200), ("b", 0, 201), ("c", 0, None), ("d", 0, 200)], "case_id string, chunk_no int, http_status int")
    got = {(r.case_id, r.chunk_no): (r.outcome, r.status) for r in S.chunk_outcome(answers).collect()}
    assert got == {("a", 0): ("ok", "failed"), ("a", 1): ("failed", "failed"), ("a", 2): ("not attempted", "failed"), ("b", 0): ("failed", "failed"), ("c", 0): ("failed", "failed"), ("d", 0): ("ok", "success")}
    runs = spark.createDataFrame([("a", 2, "ok"), ("b", 2, "absent"), ("c", 2, "timeout"), ("d", 1, "timeout")], "case_id string, n_chunks int, tool string")
    assert {r.case_id: (r.status, r.detail) for r in S.concat_outcome(runs).collect()} == {"a": ("success", "joined, parts removed"), "b": ("success", "parts kept"), "c": ("failed", "timeout"), "d": ("success", "renamed")}

    def call(payload):
        if payload == "boom":
            raise RuntimeError("x" * 900)
        return (200, b"abc") if payload == "good" else (503, "ñ".encode() * 900)

    req = spark.createDataFrame([("a", 0, "good"), ("a", 1, "bad"), ("b", 0, "boom")], "case_id string, chunk_no int, payload string")
    sinks.write_manifest(req, str(tmp_path / "m"))
    out = {r.chunk_no if r.case_id == "a" else 9: r for r in sinks.send(spark.read.parquet(str(tmp_path / "m")), call).collect()}
    assert out[0].http_status == 200 and out[0].n_bytes == 3 and len(out[1].error) == 500 and out[9].http_status is None and len(out[9].error) == 500
