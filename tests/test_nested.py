import json

from ambarina.operators import nested as N

LISTS = frozenset(N.CASE_SHAPE.lists)


def rows(value, lists=LISTS):
    return sorted((a, b, c, d) for a, b, c, d, _ in N.walk(N.parsed(json.dumps(value)), N.CASE_SHAPE, lists))


def test_lists_numbered_objects_and_nulls():
    assert rows({"sintomas": [None, "fiebre", {"nombre": "tos"}]}) == [("sintomas", "caso", -1, 1), ("sintomas", "caso", -1, 2)]
    assert rows({"sintomas": {"3": "a", "1": None, "0": {"x": 1}}}) == [("sintomas", "caso", -1, 0), ("sintomas", "caso", -1, 3)]
    assert rows({"sintomas": {"nombre": "tos"}}) == [("sintomas", "caso", -1, 0)]
    assert rows({"sintomas": []}) == rows({"sintomas": None}) == rows({"sintomas": {}}) == rows({"sintomas": ""}) == []


def test_phases_by_name_and_without_dialogues():
    named = {"transcripcion": {"anamnesis": [{"rol": "a"}, None], "plan": {"dialogos": {"0": {}}}, "x": None}}
    assert rows(named) == [("dialogos", "transcripcion", 0, 0), ("dialogos", "transcripcion", 1, 0), *(("transcripcion", "caso", -1, i) for i in range(3))]
    assert rows({"transcripcion": [{"fase": "a"}, None, {"dialogos": None}]}) == [("transcripcion", "caso", -1, 0), ("transcripcion", "caso", -1, 2)]
    assert rows({"transcripcion": {"fase": "a", "dialogos": {"rol": "x"}}}) == [("dialogos", "transcripcion", 0, 0), ("transcripcion", "caso", -1, 0)]


def test_parents_wrappers_and_embedded_text():
    value = {"diagnosticos_secundarios": [{"nombre": "x"}, {"medicamentos": json.dumps([{"n": 1}, None, {"n": 2}])}], "medicamentos": "[]"}
    want = [("diagnosticos_secundarios", "caso", -1, 0), ("diagnosticos_secundarios", "caso", -1, 1), ("medicamentos", "diagnosticos_secundarios", 1, 0), ("medicamentos", "diagnosticos_secundarios", 1, 2)]
    assert rows(value) == rows([value]) == rows({"data": {"caso": value}, "meta": {}}) == want


def test_incomplete_texts_give_nothing():
    for text in (None, "", "  ", '{"a": ', "null", "{'a': 1}", '{"a": NaN}', "[" * 100_000):
        assert N.parsed(text) is None
    assert N.parsed(json.dumps(json.dumps({"a": 1}))) == {"a": 1}


def test_graph_plan_and_tables(spark):
    docs = [
        {"id": "a", "p": {"edad": 3, "q": {"z": 1}}, "sintomas": ["s"], "medicamentos": [{"nombre": "m", "pos": 7}], "diagnosticos_secundarios": {"nombre": "d", "medicamentos": [{"nombre": "n"}]}},
        {"id": "b", "r": {"t": {"r": {"t": None}}}},
    ]
    data = [(1, json.dumps(docs[0]), "x"), (2, json.dumps(docs[1]), "x"), (3, None, "x"), (4, "{", None), (1, json.dumps(docs[0]), "y")]
    df = spark.createDataFrame(data, "registro_id long, payload string, lista string")
    plan = N.relations(N.schema_graph(df, "payload", N.CASE_SHAPE))
    assert set(plan.tables) == {"caso", "sintomas", "medicamentos", "diagnosticos_secundarios", "r", "t"}  # shared, repeated, recursive
    assert ("p_q_z", ("p", "q", "z")) in plan.inlined["caso"]
    out = N.shred(df, "payload", "registro_id", plan, N.CASE_SHAPE)
    meds = {tuple(r) for r in N.flat_table(out, plan, "medicamentos", "registro_id").select("registro_id", "padre_lista", "padre_pos", "pos", "nombre", "pos_").collect()}
    assert meds == {(1, "caso", -1, 0, "m", "7"), (1, "diagnosticos_secundarios", 0, 0, "n", None)}
    assert out.filter("registro_id in (3, 4)").count() == 0
    assert N.shred(df.limit(0), "payload", "registro_id", plan, N.CASE_SHAPE).count() == 0
    assert N.relations(N.schema_graph(df.limit(0), "payload")).tables == ("caso",)


def test_open_keys_are_one_child(spark):
    df = spark.createDataFrame([(1, json.dumps({f"k{i}": i for i in range(20)}))], "id long, payload string")
    assert [r.child for r in N.schema_graph(df, "payload", open_keys=10).collect()] == ["*"]


def test_many_keys_beside_the_lists_leave_them_in_place(spark):
    """A record with more keys than an open map needs changes no row of another, and its values stay."""
    case = {"id": "a", "transcripcion": [{"fase": "x", "dialogos": [{"rol": "r"}, {"rol": "s"}]}], "sintomas": ["tos"], "diagnosticos_secundarios": [{"nombre": "d", "medicamentos": [{"nombre": "m"}]}]}
    wide = case | {f"k{i}": {"v": i} if i % 2 else i for i in range(N.OPEN_KEYS + 20)}
    alone, both = ([(1, json.dumps(case))], [(1, json.dumps(case)), (2, json.dumps(wide))])
    found = []
    for data in (alone, both):
        df = spark.createDataFrame(data, "id long, payload string")
        plan = N.relations(N.schema_graph(df, "payload", N.CASE_SHAPE))
        rows = N.shred(df, "payload", "id", plan, N.CASE_SHAPE)
        keys = rows.filter(rows.lista.isin(*N.CASE_SHAPE.lists)).select("id", "lista", "padre_lista", "padre_pos", "pos")
        found.append({tuple(r) for r in keys.collect()})
    assert found[0] == {r for r in found[1] if r[0] == 1} == {(1, *r[1:]) for r in found[1] if r[0] == 2}
    assert (1, "medicamentos", "diagnosticos_secundarios", 0, 0) in found[0] and (1, "dialogos", "transcripcion", 0, 1) in found[0]
    kept = [r for r in N.flat_table(rows, plan, "caso", "id").collect() if r.id == 2][0]
    assert json.loads(kept["*"]) == {k: v for k, v in wide.items() if k not in case}


def test_frequent_keys_stay_columns(spark):
    """Keys of many records beside an open map in an inlined object; the map's own values come as one object."""
    docs = [{"id": i, "datos": {"edad": i, f"d{i}": i, f"e{i}": {"z": i}}} for i in range(20)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "n long, payload string")
    plan = N.relations(N.schema_graph(df, "payload", open_keys=10))
    got = {r.n: r for r in N.flat_table(N.shred(df, "payload", "n", plan), plan, "caso", "n").collect()}
    assert all(got[i].datos_edad == str(i) and json.loads(got[i]["datos_*"]) == {f"d{i}": i, f"e{i}": {"z": i}} for i in range(20))


def test_keys_tell_every_element_apart(spark):
    """Children three levels down, of different phases at the same position, have different parents; every parent key is a row's."""
    phases = [{"fase": f, "dialogos": [{"rol": "r", "marcas": [{"t": 1}, {"t": 2}]}]} for f in "ab"]
    docs = [{"id": "a", "transcripcion": phases, "sintomas": {"1": {"marcas": ["x"]}, "01": {"y": 1}}}, {"caso": {"transcripcion": {"a": [{"marcas": [{"t": 3}]}]}}, "extra": [1]}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] * 2, "id long, payload string")
    plan = N.relations(N.schema_graph(df, "payload", N.CASE_SHAPE))
    rows = N.shred(df, "payload", "id", plan, N.CASE_SHAPE).select("id", "lista", "clave", "padre_tabla", "padre_clave").distinct().collect()
    assert len({(r.id, r.clave) for r in rows}) == len(rows)
    there = {(r.id, r.lista, r.clave) for r in rows}
    assert all((r.id, r.padre_tabla, r.padre_clave) in there for r in rows if r.lista != "caso")
    assert {r.padre_clave for r in rows if r.lista == "marcas" and r.id == 0} == {"/transcripcion/0/dialogos/0", "/transcripcion/1/dialogos/0", "/sintomas/1"}
    assert sum(r.lista == "marcas" for r in rows) == 6


def test_private_keys_drop_nothing(spark):
    """400 records, each with keys of its own: scalars, objects and lists; all rows come, however many records there are."""
    docs = [{"id": i, f"k{i}": i, f"o{i}": {"a": {"b": 1}}, f"l{i}": [{"c": 1}, None, 5], "sintomas": ["s"], "medicamentos": [{"nombre": "m", f"x{i}": [1]}], "notas": ["n"]} for i in range(400)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "n long, payload string")
    graph = N.schema_graph(df, "payload", N.CASE_SHAPE)
    plan = N.relations(graph)
    assert graph.count() < 20
    got = {r.lista: r["count"] for r in N.shred(df, "payload", "n", plan, N.CASE_SHAPE).groupBy("lista").count().collect()}
    assert got == {"caso": 400, "sintomas": 400, "medicamentos": 400, "notas": 400, "*": 400 * (1 + 1 + 2 + 1)}  # o, its a, two of l, one of x
    row = [r for r in N.flat_table(N.shred(df, "payload", "n", plan, N.CASE_SHAPE), plan, "*", "n").filter("n = 7").collect() if r.clave_ == "x7"]
    assert [(r.padre_tabla, r.padre_clave, r.valor) for r in row] == [("medicamentos", "/medicamentos/0", "1")]


def test_rows_and_rejects_are_all_records(spark, tmp_path):
    texts = [json.dumps({"sintomas": ["a"]}), None, "", " \n", '{"a": ', "null", "[1, 2]", '"x"', json.dumps(json.dumps({"id": 1})), '{"a": NaN}', "[" * 100_000 + "]" * 100_000, "{}", "[[{}]]"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "id long, payload string, motivo string")
    plan = N.relations(N.schema_graph(df, "payload", N.CASE_SHAPE))
    bad = {r.id: r.motivo for r in N.rejects(df, "payload", "id", N.CASE_SHAPE).collect()}
    assert bad == {1: "nulo", 2: "vacío", 3: "vacío", 4: "incompleto", 5: "sin objeto", 6: "sin objeto", 7: "incompleto", 9: "número que no es JSON", 10: "demasiado profundo", 12: "sin objeto"}
    rows = N.shred(df, "payload", "id", plan, N.CASE_SHAPE)
    assert {r.id for r in rows.filter("lista = 'caso'").collect()} | set(bad) == set(range(len(texts)))
    N.write_tables(rows, plan, "id", str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "caso")).count() == 3 and spark.read.parquet(str(tmp_path / "sintomas")).first().valor == "a"


def test_a_wrapper_named_as_the_root_is_no_element():
    value = {"caso": {"sintomas": ["a"], "caso": {"x": 1}}}
    assert [(e.lista, e.clave, e.padre_clave) for e in N.linked(value, N.CASE_SHAPE, LISTS | {"caso"})] == [("caso", "", None), ("sintomas", "/caso/sintomas/0", ""), ("caso", "/caso/caso/0", "")]
