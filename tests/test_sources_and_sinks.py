import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from ambarina.operators import drift
from ambarina.operators import manifest as M
from ambarina.operators import status as S
from ambarina.sources import cases as R
from ambarina.sources import sinks
from ambarina.sources import summary

REQUEST = "case_id string, chunk_no int, payload string, part string, n_turns long"


def test_named_files_in_order_with_duplicates(spark, tmp_path):
    for name, text in (("_b.json", '{"id": "b"}'), ("a.doc", '{"id": "a", "unknown": 1}'), ("cut.json", '{"id": '), ("bad.json", b'{"id": "\xff"}')):
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    names = ["a.doc", "_b.json", "none.json", "a.doc", "cut.json", "bad.json"]
    got = R.read_named(spark, [("file:" if n == "_b.json" else "") + str(tmp_path / n) for n in names]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(6)) and [r.id for r in got] == ["a", "b", None, "a", None, "�"]
    assert [r._corrupt_record for r in got] == [None, None, "missing file", None, '{"id": ', None]
    table = spark.createDataFrame([(7, str(tmp_path / "a.doc"))], "pos long, path string")
    assert [(r.pos, r.id) for r in R.read_named(spark, table).collect()] == [(7, "a")] and R.read_named(spark, []).count() == 0


def test_roots_in_one_scan(spark, tmp_path):
    for folder in "xy":
        (tmp_path / folder / "deep").mkdir(parents=True)
        (tmp_path / folder / "deep" / "c.json").write_text(json.dumps({"id": folder}))
        (tmp_path / folder / "note.txt").write_text("no")
    roots = [str(tmp_path / "x"), str(tmp_path / "y"), str(tmp_path / "x"), str(tmp_path / "y" / "deep" / "c.json")]
    assert sorted(r.id for r in R.read_cases(spark, *roots).collect()) == ["x", "x", "y", "y"]
    plan = R.read_cases(spark, *roots[:2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_another_type_is_no_unreadable_document(spark, tmp_path):
    """A field of another type than the schema's is null; whether the case can be voiced depends on the fields that matter."""
    doc = {"id": "a", "audio_file": "a.mp3", "diagnostico_principal": {"nombre": "d"}, "voces": {"medico_voice_id": "m", "paciente_voice_id": "p"}, "paciente": {"edad": "doce"}, "sintomas": "[]", "transcripcion": [{"fase": "x", "dialogos": [{"rol": "medico", "texto": "t"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(doc | {"transcripcion": {"x": []}}))
    (tmp_path / "c.json").write_text("5")
    (tmp_path / "d.json").write_text('{"id": ')
    want = {"a": None, "b": "no transcripcion", "c": "unreadable document", "d": "unreadable document"}
    for cases in (R.read_cases(spark, str(tmp_path)), R.read_named(spark, [str(tmp_path / f"{c}.json") for c in "abcd"])):
        assert {r.path.rsplit("/", 1)[-1][0]: r.reason for r in S.nested_status(cases).collect()} == want


def test_drift_names_what_the_schema_lacks(spark):
    texts = ['{"id": 5, "unitem": "kg", "sintomas": {"a": 1}}', '{"id": "x", "constantes_vitales": null, "nueva": [1.5]}', "[1]", None, '{"id": ', "{}"]
    got = {(r.key, r.tipo): (r.n, r.declarado) for r in drift.key_types(spark.createDataFrame([(t,) for t in texts], "payload string"), "payload").collect()}
    assert got == {("id", "number"): (1, "string"), ("id", "string"): (1, "string"), ("unitem", "string"): (1, None), ("sintomas", "object"): (1, "array"), ("constantes_vitales", "null"): (1, "object"), ("nueva", "array"): (1, None)}


def test_summary_document_is_read(spark, tmp_path):
    doc = {"total": 3, "especialidades": {"Cardiología": {"total": 2, "comunes": 1, "raras": 1}, "Urología": {"total": 1, "comunes": 1}}}
    (tmp_path / "s.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    assert {tuple(r) for r in summary.read_summary(spark, str(tmp_path / "s.json")).collect()} == {("Cardiología", 2, 1, 1), ("Urología", 1, 1, None)}
    (tmp_path / "t.json").write_text("{}")
    assert summary.read_summary(spark, str(tmp_path / "t.json")).count() == 0
    assert summary.specialties_of(spark.createDataFrame([(None,), ("{",)], "d string"), "d").count() == 0


@pytest.fixture(scope="module")
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        seen = []

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.seen.append((self.headers["x-key"], self.headers["Content-Type"], body["n"]))
            answer = (body.get("body", "") or "ERR").encode() * body.get("times", 1)
            self.send_response(body["status"])
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/dialogue", Handler.seen
    server.shutdown()


def test_calls_write_bodies_and_end_a_case_at_its_first_failure(spark, tmp_path, service):
    url, seen = service
    rows = [("a", 2, 500, "x", 400), ("a", 0, 200, "uno", 1), ("a", 1, 200, "dos", 1), ("a", 3, 200, "no", 1), ("b", 0, 201, "created", 1), ("c", 0, 200, "ñ", 2)]
    data = [(c, no, json.dumps({"n": f"{c}{no}", "status": s, "body": b, "times": t}), f"{tmp_path}/out/{c}/{no}.mp3", 1) for c, no, s, b, t in rows]
    (tmp_path / "out" / "c").mkdir(parents=True)
    (tmp_path / "out" / "c" / "0.mp3").write_text("an older and longer file")
    req = spark.createDataFrame(data, REQUEST)
    got = {(r.case_id, r.chunk_no): (r.http_status, r.n_bytes, r.error) for r in sinks.send(req, sinks.http_call(url, "x-key", "k", 20)).collect()}
    assert got == {("a", 0): (200, 3, None), ("a", 1): (200, 3, None), ("a", 2): (500, 400, "x" * 400), ("a", 3): (None, None, "not attempted"), ("b", 0): (201, 7, "created"), ("c", 0): (200, 4, None)}
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs) == ["a/0.mp3", "a/1.mp3", "c/0.mp3"]
    assert (tmp_path / "out/a/1.mp3").read_text() == "dos" and (tmp_path / "out/c/0.mp3").read_text() == "ññ"
    assert sorted(n for _, _, n in seen) == ["a0", "a1", "a2", "b0", "c0"] and {s[:2] for s in seen} == {("k", "application/json")}
    nowhere = sinks.send(req.filter("case_id = 'b'"), sinks.http_call("http://127.0.0.1:9/x", "x-key", "k", 2)).first()
    assert nowhere.http_status is None and nowhere.error
    unwritable = sinks.send(req.filter("case_id = 'c'").withColumn("part", F.lit("/proc/none/x.mp3")), sinks.http_call(url, "x-key", "k", 20)).first()
    assert unwritable.http_status is None and unwritable.error
    assert {r.case_id: r.status for r in S.chunk_outcome(sinks.send(req, lambda p: (200, b""))).collect()} == {"a": "success", "b": "success", "c": "success"}


def test_no_key_ends_before_any_work(spark):
    spark.conf.set("service.key", "")
    for setting in ("service.key", "service.unset"):
        with pytest.raises(SystemExit) as e:
            sinks.guard(spark, setting)
        assert e.value.code == 1
    with pytest.raises(sinks.MissingKey):
        sinks.http_call("http://x", "h", "")
    spark.conf.set("service.key", "k")
    assert sinks.guard(spark, "service.key") == "k"


def test_parts_are_joined_in_order_and_removed_after_success(spark, tmp_path):
    rows = []
    for c in ("ok", "error", "absent", "timeout"):
        for no in (2, 0, 1):
            part = f"{tmp_path}/{c}/f_part{no + 1}.mp3"
            os.makedirs(os.path.dirname(part), exist_ok=True)
            with open(part, "w") as f:
                f.write(f"{c}{no};")
            rows.append((c, no, f"{tmp_path}/{c}/f.mp3", part, f"{tmp_path}/{c}/f_filelist.txt"))
    parts = spark.createDataFrame([*rows, ("one", 0, f"{tmp_path}/one.mp3", f"{tmp_path}/one.mp3", None)], "case_id string, chunk_no int, path string, part string, list_file string")

    def tool(list_file, out):
        case = os.path.basename(os.path.dirname(out))
        if case == "absent":
            raise FileNotFoundError
        if case == "timeout":
            raise TimeoutError
        if case == "error":
            return "error"
        with open(list_file) as f, open(out, "w") as o:
            for line in f:
                o.write(open(line.split("'")[1]).read())
        return "ok"

    done = sinks.join_parts(M.join_lists(parts), tool)
    got = {r.case_id: (r.status, r.detail) for r in S.concat_outcome(done).collect()}
    assert got == {"ok": ("success", "joined, parts removed"), "error": ("success", "parts kept"), "absent": ("success", "parts kept"), "timeout": ("failed", "timeout")}
    assert os.listdir(tmp_path / "ok") == ["f.mp3"] and (tmp_path / "ok/f.mp3").read_text() == "ok0;ok1;ok2;"
    assert sorted(os.listdir(tmp_path / "error")) == ["f_filelist.txt", "f_part1.mp3", "f_part2.mp3", "f_part3.mp3"]


def test_progress_counts_what_passes(spark):
    out, seen = sinks.progress(spark.createDataFrame([("a", 0, "xx", "", 3), ("a", 1, "y", "", 4)], REQUEST))
    assert out.count() == 2 and seen.get == {"requests": 2, "cases": 1, "turns": 7, "chars": 3}
