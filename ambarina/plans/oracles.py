"""The same queries as SQL over the same tables, written independently of the DataFrame code."""

from __future__ import annotations

T = "t AS (SELECT DISTINCT case_id, seq, rol, fase, texto FROM turnos)"
C = "c AS (SELECT * FROM casos QUALIFY row_number() OVER (PARTITION BY id ORDER BY recibido_en, especialidad) = 1)"
ROL = """CASE WHEN translate(trim(lower(rol)), 'áéíóú', 'aeiou') IN ('medico','doctor','doctora','medica') THEN 'medico'
 WHEN translate(trim(lower(rol)), 'áéíóú', 'aeiou') = 'paciente' THEN 'paciente'
 WHEN translate(trim(lower(rol)), 'áéíóú', 'aeiou') IN ('padre','madre','tutor') THEN 'padre' END"""
READ = f"coalesce({ROL}, rol)"


def status_of(rol: str) -> str:
    """h and st: every case with its first failure, in the order in which the document is read; ``rol``: how a role is read."""
    return f""" h AS (SELECT case_id, count(*) AS n_turns, CAST(coalesce(sum(length(texto)),0) AS BIGINT) AS n_chars, bool_or(rol IS NULL) AS no_rol, bool_or(texto IS NULL) AS no_texto,
   bool_or(rol NOT IN ('medico','paciente')) AS no_voice FROM (SELECT case_id, texto, {rol} AS rol FROM t) GROUP BY 1),
 st AS (SELECT coalesce(c.id, h.case_id) AS case_id, coalesce(n_turns,0) AS n_turns, coalesce(n_chars,0) AS n_chars,
   CASE WHEN c.id IS NULL THEN 'no case' WHEN audio_file IS NULL THEN 'no audio_file' WHEN diagnostico_principal.nombre IS NULL THEN 'no diagnostico_principal.nombre'
     WHEN voces['medico_voice_id'] IS NULL THEN 'no voces.medico_voice_id' WHEN voces['paciente_voice_id'] IS NULL THEN 'no voces.paciente_voice_id'
     WHEN no_rol THEN 'turn without rol' WHEN no_texto THEN 'turn without texto' WHEN no_voice THEN 'role without voice' END AS reason
   FROM c FULL JOIN h ON c.id = h.case_id)"""


def pack_of(rol: str) -> str:
    """k: all turns of the cases without a failure, with their voice and chunk, by a recursive fold of one step a turn over all cases at
    once; e: such cases without a turn. A lookup that misses fails its case, so every turn here has a voice."""
    return f"""{status_of(rol)},
 n AS (SELECT t.case_id, seq, texto, length(texto) AS l, n_chars AS total, CASE {rol} WHEN 'medico' THEN voces['medico_voice_id'] ELSE voces['paciente_voice_id'] END AS voice_id
   FROM t JOIN st ON st.case_id = t.case_id AND reason IS NULL JOIN c ON c.id = t.case_id),
 e AS (SELECT case_id FROM st WHERE reason IS NULL AND n_turns = 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS i FROM n),
 f AS (SELECT case_id, i, 0 AS chunk_no, l AS s FROM o WHERE i = 1
   UNION ALL
   SELECT o.case_id, o.i, CASE WHEN o.total > 5000 AND f.s + o.l > 4500 THEN f.chunk_no + 1 ELSE f.chunk_no END,
     CASE WHEN o.total > 5000 AND f.s + o.l > 4500 THEN o.l ELSE f.s + o.l END
   FROM f JOIN o ON o.case_id = f.case_id AND o.i = f.i + 1),
 k AS (SELECT o.*, CAST(f.chunk_no AS INTEGER) AS chunk_no FROM f JOIN o USING (case_id, i))"""


PATHS = """ p AS (SELECT id AS case_id, CASE WHEN audio_file LIKE '/%' THEN audio_file ELSE '/audio/' || audio_file END AS path FROM c),
 g AS (SELECT case_id, chunk_no, max(chunk_no) OVER (PARTITION BY case_id) AS last FROM (SELECT DISTINCT case_id, chunk_no FROM k UNION ALL SELECT case_id, 0 FROM e)),
 cp AS (SELECT g.case_id, chunk_no, CAST(last + 1 AS BIGINT) AS n_chunks, path,
   CASE WHEN last = 0 THEN path ELSE replace(path, '.mp3', '_part' || (chunk_no + 1) || '.mp3') END AS part,
   CASE WHEN last > 0 THEN replace(path, '.mp3', '_filelist.txt') END AS list_file FROM g JOIN p USING (case_id))"""
CODES = """ e1 AS (SELECT * FROM entradas QUALIFY row_number() OVER (PARTITION BY entrada_id ORDER BY recibido_en) = 1),
 m1 AS (SELECT * FROM medicaciones QUALIFY row_number() OVER (PARTITION BY medicacion_id ORDER BY recibido_en) = 1),
 cd AS (SELECT id AS case_id, 'diagnostico_principal' AS kind, 0 AS idx, diagnostico_principal.nombre AS nombre, s.system, s.code, diagnostico_principal.snomed_termino AS term
   FROM c, LATERAL (VALUES ('cie10', diagnostico_principal.cie10), ('snomed_ct', diagnostico_principal.snomed_ct)) s(system, code) WHERE s.code IS NOT NULL
   UNION ALL SELECT id, 'procedimientos', i - 1, procedimientos[i].nombre, 'snomed_ct', procedimientos[i].snomed_ct, procedimientos[i].snomed_termino
   FROM (SELECT id, procedimientos, unnest(range(1, len(procedimientos) + 1)) AS i FROM c) WHERE procedimientos[i].snomed_ct IS NOT NULL),
 ca AS (SELECT * FROM cd
   UNION ALL SELECT case_id, lista, idx, nombre, s.system, s.code, snomed_termino FROM e1, LATERAL (VALUES ('cie10', cie10), ('snomed_ct', snomed_ct)) s(system, code)
   WHERE s.code IS NOT NULL AND lista IN ('diagnosticos_secundarios', 'sintomas')
   UNION ALL SELECT case_id, 'medicamentos', idx, nombre, s.system, s.code, snomed_termino FROM m1, LATERAL (VALUES ('atc', atc), ('snomed_ct', snomed_ct)) s(system, code) WHERE s.code IS NOT NULL)"""
RULES = r""" r AS (SELECT id AS case_id, regexp_replace(regexp_extract(a, '^([A-Z]{0,4} ?[A-Z]?[0-9][0-9A-Z.]*|[A-Z][0-9][0-9A-Z.]*)', 1), '^[A-Z]+ ', '') AS old,
   regexp_replace(regexp_extract(a, '→ *([A-Z]?[0-9][0-9A-Z.]*|[A-Z][0-9][0-9A-Z.]*)', 1), '[.]$', '') AS new
   FROM (SELECT id, unnest(regexp_extract_all(x, '[A-Z]{0,4} ?[A-Z]?[0-9][0-9A-Z.]* *→ *[A-Z]?[0-9][0-9A-Z.]*')) AS a
   FROM (SELECT id, unnest(validacion.correcciones_aplicadas) AS x FROM c)))"""
FOLD = "trim(regexp_replace(translate(lower(nfc_normalize({0})), 'áéíóúüñàèìòùâêîôûçäëïö', 'aeiouunaeiouaeioucaeio'), '[\\s ]+', ' ', 'g'))"
SPEC = "regexp_replace(" + FOLD + ", '^(servicio|serv\\.?|consulta|unidad)( de)? ', '')"

ORACLES: dict[str, str] = {
    "scan_dialogue_sorted": f"WITH {T} SELECT case_id, seq, rol, texto FROM t ORDER BY 1, 2",
    "turn_project_voice": f"""WITH {T}, {C} SELECT t.case_id, seq, texto AS text, CASE rol WHEN 'medico' THEN voces['medico_voice_id'] WHEN 'paciente' THEN voces['paciente_voice_id'] END AS voice_id
      FROM t LEFT JOIN c ON c.id = t.case_id""",
    "voice_dimension": f"WITH {C} SELECT id AS case_id, 'medico' AS rol, voces['medico_voice_id'] AS voice_id FROM c UNION ALL SELECT id, 'paciente', voces['paciente_voice_id'] FROM c",
    "nest_unnest_roundtrip": f"WITH {T} SELECT case_id, seq, rol, texto FROM t",
    "case_measures": f"WITH {T} SELECT case_id, count(*) AS n_turns, CAST(coalesce(sum(length(texto)),0) AS BIGINT) AS n_chars FROM t GROUP BY 1",
    "route_single_vs_chunked": f"WITH {T}, m AS (SELECT case_id, count(*) AS n_turns, CAST(coalesce(sum(length(texto)),0) AS BIGINT) AS n_chars FROM t GROUP BY 1) SELECT *, CASE WHEN n_chars > 5000 THEN 'chunked' ELSE 'single' END AS route FROM m",
    "turns_by_role": f"WITH {T} SELECT rol, count(*) AS n_turns FROM t GROUP BY 1",
    "turns_by_phase": f"WITH {T} SELECT fase, count(*) AS n_turns FROM t GROUP BY 1",
    "canonical_roles": f"WITH {T} SELECT {ROL} AS rol, count(*) AS n_turns FROM t GROUP BY 1",
    "chunk_pack_lines": """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
      o AS (SELECT doc_id, i, length(a[i]) AS l FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d)),
      f AS (SELECT doc_id, i, 0 AS chunk_no, l AS s, l FROM o WHERE i = 1 UNION ALL
        SELECT o.doc_id, o.i, CASE WHEN f.s + o.l > 4500 THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN f.s + o.l > 4500 THEN o.l ELSE f.s + o.l END, o.l
        FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
      SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, count(*) AS n_lines, CAST(sum(l) AS BIGINT) AS n_chars FROM f GROUP BY 1, 2""",
    "output_paths": f"""WITH {C}, p AS (SELECT id, CASE WHEN audio_file LIKE '/%' THEN audio_file ELSE '/audio/' || audio_file END AS path FROM c)
      SELECT id, path, regexp_extract(path, '^(.*)/', 1) AS folder, replace(path, '.mp3', '_filelist.txt') AS list_file FROM p""",
    "error_prefix": "SELECT doc_id, left(text, 500) AS prefix FROM documents",
    "size_kb": "SELECT doc_id, round_even(strlen(text) / 1024.0::DOUBLE, 1) AS kb FROM documents",
    "size_totals_mb": "SELECT count(text) AS n_files, round_even(sum(strlen(text) / 1048576.0::DOUBLE), 1) AS total_mb, round_even(avg(strlen(text) / 1048576.0::DOUBLE), 1) AS mean_mb FROM documents",
    "summary_totals": f"WITH {T}, {C} SELECT (SELECT count(*) FROM c) AS n_cases, (SELECT count(DISTINCT especialidad) FROM c) AS n_especialidades, (SELECT count(*) FROM t) AS n_turns, (SELECT CAST(sum(length(texto)) AS BIGINT) FROM t) AS n_chars",
    "summary_by_specialty": f"WITH {C} SELECT especialidad, count(*) AS total, count(*) FILTER (NOT diagnostico_principal.es_rara) AS comunes, count(*) FILTER (diagnostico_principal.es_rara) AS raras FROM c GROUP BY 1",
    "summary_by_canonical_specialty": f"WITH {C} SELECT {SPEC.format('especialidad')} AS especialidad, count(*) AS total, count(*) FILTER (NOT diagnostico_principal.es_rara) AS comunes, count(*) FILTER (diagnostico_principal.es_rara) AS raras FROM c GROUP BY 1",
    "codes_relation": f"WITH {C}, {CODES} SELECT case_id, kind, CAST(idx AS INTEGER) AS idx, nombre, system, code, term FROM ca",
    "distinct_codes_by_system": f"WITH {C}, {CODES} SELECT system, count(DISTINCT code) AS n_codes, count(*) AS n_occurrences FROM ca GROUP BY 1",
    "code_frequency": f"WITH {C}, {CODES} SELECT system, code, term, count(*) AS n FROM ca GROUP BY 1, 2, 3",
    "ambiguous_codes": f"WITH {C}, {CODES} SELECT system, code, count(DISTINCT term) AS n_terms FROM ca GROUP BY 1, 2 HAVING count(DISTINCT term) > 1",
    "code_shape_check": "SELECT DISTINCT entrada_id, regexp_matches(cie10, '^[A-Z][0-9]{2}(\\.[0-9A-Z]{1,2})?$') AS cie10_ok, regexp_matches(snomed_ct, '^[1-9][0-9]{5,17}$') AS snomed_ok FROM entradas",
    "atc_levels": """WITH m AS (SELECT DISTINCT medicacion_id, atc FROM medicaciones WHERE atc <> 'N/A'), s AS (SELECT medicacion_id, regexp_split_to_array(atc, '\\s*/\\s*') AS a FROM m)
      SELECT medicacion_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS code, CASE length(a[i]) WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 7 THEN 5 END AS level FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM s)""",
    "semantic_tags": "SELECT termino_id, nullif(regexp_extract(snomed_termino, '\\(([^()]*)\\)$', 1), '') AS tag FROM terminologia",
    "validation_sources": f"WITH {C} SELECT DISTINCT string_split(s, ' - ')[1] AS fuente FROM (SELECT unnest(validacion.fuentes_validacion) AS s FROM c)",
    "correction_pairs": f"WITH {C}, {RULES} SELECT * FROM r",
    "corrected_codes": f"WITH {C}, {CODES}, {RULES}, q AS (SELECT case_id, old, min(new) AS new FROM r GROUP BY 1, 2) SELECT cd.case_id, kind, CAST(idx AS INTEGER) AS idx, system, code, coalesce(q.new, code) AS corrected FROM cd LEFT JOIN q ON q.case_id = cd.case_id AND q.old = cd.code",
    "notes_unnest": f"WITH {C} SELECT id, CAST(i - 1 AS INTEGER) AS pos, notas_adicionales[i] AS nota FROM (SELECT id, notas_adicionales, unnest(range(1, len(notas_adicionales) + 1)) AS i FROM c)",
    "voices_unnest": f"WITH {C} SELECT id, e.key AS key, e.value AS voice_id FROM (SELECT id, unnest(map_entries(voces)) AS e FROM c)",
    "age_in_years": f"WITH {C} SELECT id, round(CASE WHEN paciente.edad_unidad = 'meses' THEN paciente.edad / 12.0::DOUBLE ELSE CAST(paciente.edad AS DOUBLE) END, 4) AS years FROM c",
    "rare_cases": f"WITH {C} SELECT id, diagnostico_principal.nombre AS nombre FROM c WHERE diagnostico_principal.es_rara",
    "specialty_mismatch": f"WITH {C}, x AS (SELECT id, {SPEC.format('especialidad')} AS a, {SPEC.format('medico.especialidad')} AS b FROM c) SELECT * FROM x WHERE a <> b",
    "tag_extract": f"WITH {T} SELECT case_id, seq, nullif(regexp_extract(texto, '^\\[([^\\]]+)\\]', 1), '') AS tag, len(regexp_extract_all(coalesce(texto, ''), '\\[([^\\]]+)\\]')) AS n_tags FROM t",
    "tag_frequency": f"WITH {T} SELECT tag, count(*) AS n FROM (SELECT nullif(regexp_extract(texto, '^\\[([^\\]]+)\\]', 1), '') AS tag FROM t) WHERE tag IS NOT NULL GROUP BY 1",
    "json_field_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "pressure_names_joined": "SELECT regexp_replace(nombre, '^(tension|presion)_arterial_', 'presion_arterial_') AS nombre, count(*) AS n FROM (SELECT DISTINCT lectura_id, nombre FROM constantes) GROUP BY 1",
    "misspelt_unit_key": "SELECT DISTINCT lectura_id, unitem AS unidad FROM constantes WHERE unidad IS NULL AND unitem IS NOT NULL",
    "centre_load": "WITH t AS (SELECT DISTINCT case_id, seq, centro_id, texto FROM turnos) SELECT t.centro_id, nombre, count(*) AS n_turns, CAST(sum(length(texto)) AS BIGINT) AS n_chars FROM t LEFT JOIN centros USING (centro_id) GROUP BY 1, 2",
}

OK = "CASE WHEN reason IS NULL THEN 'success' ELSE 'failed' END"
# roles as written, and as read
for _suffix, _rol in (("", "rol"), ("_whole", READ)):
    _pack = f"WITH RECURSIVE {T}, {C}, {pack_of(_rol)}"
    _request = """'{"inputs":[' || string_agg('{"text":' || CAST(to_json(texto) AS VARCHAR) || ',"voice_id":' || CAST(to_json(voice_id) AS VARCHAR) || '}', ',' ORDER BY seq) || '],"model_id":"eleven_v3"}'"""
    ORACLES |= {
        "case_status_canonical" if _suffix else "case_status": f"WITH {T}, {C}, {status_of(_rol)} SELECT case_id, n_turns, n_chars, {OK} AS status, reason FROM st",
        f"chunk_pack_dialogue{_suffix}": f"{_pack} SELECT case_id, chunk_no, count(*) AS n_turns, CAST(sum(l) AS BIGINT) AS n_chars FROM k GROUP BY 1, 2 UNION ALL SELECT case_id, 0, 0, 0 FROM e",
        f"chunk_count_per_case{_suffix}": f"{_pack} SELECT case_id, CAST(max(chunk_no) + 1 AS BIGINT) AS n_chunks FROM (SELECT case_id, chunk_no FROM k UNION ALL SELECT case_id, 0 FROM e) GROUP BY 1",
        f"chunk_paths{_suffix}": f"{_pack}, {PATHS} SELECT * FROM cp",
        f"concat_filelist{_suffix}": f"{_pack}, {PATHS} SELECT case_id, count(*) AS n_parts, string_agg('file ''' || part || '''', chr(10) ORDER BY chunk_no) || chr(10) AS content FROM cp GROUP BY 1 HAVING count(*) > 1",
        f"request_manifest{_suffix}": f"""{_pack} SELECT case_id, chunk_no, count(*) AS n_turns, {_request} AS payload FROM k GROUP BY 1, 2 UNION ALL SELECT case_id, 0, 0, '{{"inputs":[],"model_id":"eleven_v3"}}' FROM e""",
    }
ORACLES["case_status_rollup"] = f"WITH {T}, {C}, {status_of('rol')} SELECT status, count(case_id) AS n_cases FROM (VALUES ('success'),('failed')) v(status) LEFT JOIN st ON {OK} = status GROUP BY 1"

# the summary, and its specialties read back
ORACLES["summary_document"] = f"""WITH {T}, {C}, {CODES}, n AS (SELECT system, count(DISTINCT code) AS n FROM ca GROUP BY 1),
  s AS (SELECT especialidad, count(*) AS total, count(*) FILTER (NOT diagnostico_principal.es_rara) AS comunes, count(*) FILTER (diagnostico_principal.es_rara) AS raras FROM c WHERE especialidad IS NOT NULL GROUP BY 1)
  SELECT '{{"total_transcripciones":' || (SELECT count(*) FROM c) || ',"total_especialidades":' || (SELECT count(DISTINCT especialidad) FROM c) || ',"total_dialogos":' || (SELECT count(*) FROM t)
    || ',"total_caracteres":' || (SELECT sum(length(texto)) FROM t) || ',"estadisticas_codigos":{{"cie10_unicos":' || (SELECT n FROM n WHERE system = 'cie10') || ',"snomed_ct_unicos":' || (SELECT n FROM n WHERE system = 'snomed_ct')
    || ',"atc_unicos":' || (SELECT n FROM n WHERE system = 'atc') || '}},"especialidades":{{' || (SELECT string_agg(CAST(to_json(especialidad) AS VARCHAR) || ':' || CAST(to_json({{'total': total, 'comunes': comunes, 'raras': raras}}) AS VARCHAR), ',' ORDER BY especialidad) FROM s) || '}}}}' AS document"""
ORACLES["summary_keys_as_rows"] = f"WITH {C} SELECT especialidad, count(*) AS total, count(*) FILTER (NOT diagnostico_principal.es_rara) AS comunes, count(*) FILTER (diagnostico_principal.es_rara) AS raras FROM c WHERE especialidad IS NOT NULL GROUP BY 1"

# documents
R = "r AS (SELECT DISTINCT registro_id, payload FROM registros WHERE json_valid(payload))"
KIND = "CASE {0} WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
ORACLES |= {
    "document_turns": f"""WITH {R}, p AS (SELECT registro_id, i - 1 AS phase_idx, a[i] AS p FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT registro_id, CAST(json_extract(payload, '$.transcripcion') AS JSON[]) AS a FROM r WHERE json_type(payload, '$.transcripcion') = 'ARRAY'))),
      g AS (SELECT registro_id, phase_idx, p->>'$.fase' AS fase, CASE WHEN json_type(p, '$.dialogos') = 'ARRAY' THEN CAST(json_extract(p, '$.dialogos') AS JSON[]) ELSE [] END AS a FROM p),
      o AS (SELECT *, coalesce(sum(len(a)) OVER (PARTITION BY registro_id ORDER BY phase_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
      SELECT registro_id, CAST(phase_idx AS INTEGER) AS phase_idx, fase, CAST(i - 1 AS INTEGER) AS turn_idx, CAST(before + i - 1 AS INTEGER) AS seq, a[i]->>'$.rol' AS rol, a[i]->>'$.texto' AS texto FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM o)""",
    "document_vitals": f"""WITH {R}, k AS (SELECT registro_id, payload, unnest(json_keys(payload, '$.constantes_vitales')) AS nombre FROM r WHERE json_type(payload, '$.constantes_vitales') = 'OBJECT'),
      x AS (SELECT registro_id, nombre, json_extract(payload, '$.constantes_vitales."' || nombre || '"') AS x FROM k)
      SELECT registro_id, nombre, CASE WHEN json_type(x, '$.valor') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(x->>'$.valor' AS DOUBLE) END AS valor, x->>'$.unidad' AS unidad FROM x""",
    "schema_drift": f"""WITH {R}, k AS (SELECT payload, unnest(json_keys(payload)) AS key FROM r WHERE json_type(payload) = 'OBJECT'),
      t AS (SELECT key, {KIND.format("json_type(payload, '$.\"' || key || '\"')")} AS tipo FROM k)
      SELECT key, tipo, count(*) AS n, CASE WHEN key IN ('id', 'especialidad', 'resumen', 'audio_file') THEN 'string'
        WHEN key IN ('diagnostico_principal', 'constantes_vitales', 'paciente', 'medico', 'acompañante', 'voces', 'validacion') THEN 'object'
        WHEN key IN ('diagnosticos_secundarios', 'sintomas', 'procedimientos', 'medicamentos', 'notas_adicionales', 'transcripcion') THEN 'array' END AS declarado FROM t GROUP BY 1, 2""",
    "file_counts": "SELECT remitente, count(*) AS n FROM (SELECT DISTINCT registro_id, remitente FROM registros) GROUP BY 1",
}

# a run's answers
A = """a AS (SELECT user_id AS case_id, event_id AS chunk_no, CASE WHEN k % 10 = 3 THEN 500 WHEN k % 10 = 7 THEN 201 WHEN k % 25 <> 4 THEN 200 END AS http_status FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
 w AS (SELECT case_id, min(chunk_no) FILTER (http_status IS NULL OR http_status <> 200) AS bad FROM a GROUP BY 1)"""
_length = "length(payload)"
ORACLES |= {
    "response_success": f"WITH {A} SELECT http_status, coalesce(http_status = 200, false) AS ok, count(*) AS n FROM a GROUP BY 1, 2",
    "chunk_outcomes": f"""WITH {A} SELECT case_id, chunk_no, CASE WHEN chunk_no > bad THEN 'not attempted' WHEN chunk_no = bad THEN 'failed' ELSE 'ok' END AS outcome,
      CASE WHEN bad IS NULL THEN 'success' ELSE 'failed' END AS status FROM a JOIN w USING (case_id)""",
    "run_rollup": f"WITH {A} SELECT status, count(case_id) AS n_cases FROM (VALUES ('success'), ('failed')) v(status) LEFT JOIN w ON (CASE WHEN bad IS NULL THEN 'success' ELSE 'failed' END) = status GROUP BY 1",
    "concat_outcomes": f"""WITH {A}, n AS (SELECT case_id, count(*) AS n, (count(*) + case_id) % 4 AS t FROM a GROUP BY 1)
      SELECT case_id, CASE WHEN n > 1 AND t = 3 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n <= 1 THEN 'renamed' WHEN t = 0 THEN 'joined, parts removed' WHEN t = 3 THEN 'timeout' ELSE 'parts kept' END AS detail FROM n""",
    "send_requests": f"""{ORACLES["request_manifest_whole"].replace("SELECT case_id, chunk_no, count(*) AS n_turns", ", q AS (SELECT case_id, chunk_no, count(*) AS n_turns", 1)}),
      z AS (SELECT *, CASE WHEN {_length} % 11 = 0 THEN NULL WHEN {_length} % 7 <> 0 THEN 200 ELSE 429 END AS st FROM q),
      y AS (SELECT case_id, min(chunk_no) FILTER (st IS NULL OR st <> 200) AS bad FROM z GROUP BY 1)
      SELECT case_id, chunk_no, CASE WHEN bad IS NULL OR chunk_no <= bad THEN st END AS http_status, CASE WHEN bad IS NULL OR chunk_no < bad THEN {_length} % 100 WHEN chunk_no = bad AND st = 429 THEN 9 END AS n_bytes,
        CASE WHEN chunk_no > bad THEN 'not attempted' WHEN chunk_no = bad AND st IS NULL THEN 'no answer' WHEN chunk_no = bad THEN 'slow down' END AS error FROM z JOIN y USING (case_id)""",
}

_no_turn = "list_bool_or(list_transform(flatten(list_transform(CAST(json_extract(payload, '$.transcripcion') AS JSON[]), lambda p: CAST(json_extract(p, '$.dialogos') AS JSON[]))), lambda t: {0}))"
ORACLES["document_status"] = f"""WITH r AS (SELECT DISTINCT registro_id, payload FROM registros),
  x AS (SELECT registro_id, CASE WHEN payload IS NULL OR NOT json_valid(payload) THEN 'unreadable document' WHEN json_type(payload) <> 'OBJECT' THEN 'unreadable document'
    WHEN payload->>'$.id' IS NULL THEN 'no id' WHEN payload->>'$.audio_file' IS NULL THEN 'no audio_file' WHEN payload->>'$.diagnostico_principal.nombre' IS NULL THEN 'no diagnostico_principal.nombre'
    WHEN payload->>'$.voces.medico_voice_id' IS NULL THEN 'no voces.medico_voice_id' WHEN payload->>'$.voces.paciente_voice_id' IS NULL THEN 'no voces.paciente_voice_id'
    WHEN json_type(payload, '$.transcripcion') IS DISTINCT FROM 'ARRAY' THEN 'no transcripcion'
    WHEN list_bool_or(list_transform(CAST(json_extract(payload, '$.transcripcion') AS JSON[]), lambda p: json_type(p, '$.dialogos') IS DISTINCT FROM 'ARRAY')) THEN 'phase without dialogos'
    WHEN {_no_turn.format("t->>'$.rol' IS NULL")} THEN 'turn without rol' WHEN {_no_turn.format("t->>'$.texto' IS NULL")} THEN 'turn without texto'
    WHEN {_no_turn.format("t->>'$.rol' NOT IN ('medico', 'paciente')")} THEN 'role without voice' END AS reason FROM r)
  SELECT registro_id, reason, {OK} AS status FROM x"""
