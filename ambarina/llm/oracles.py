"""SQL of this subpackage's queries, where SQL can say it over whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "p3_found": """WITH t AS (SELECT DISTINCT case_id, seq, texto FROM turnos)
      SELECT case_id, -1 AS seq FROM t GROUP BY case_id HAVING sum(length(texto)) > (SELECT max_chars FROM limites WHERE tipo = 'dialogo')
      UNION ALL SELECT case_id, seq FROM t WHERE length(texto) > (SELECT max_chars FROM limites WHERE tipo = 'turno')""",
    "p2_found": """WITH f AS (SELECT id, regexp_replace(trim(regexp_replace(strip_accents(lower(nfc_normalize(especialidad))), '\\s+', ' ', 'g')), '^(servicio|serv|consulta)\\.?( de)? ', '') AS e,
        trim(regexp_replace(strip_accents(lower(nfc_normalize(diagnostico_principal.nombre))), '\\s+', ' ', 'g')) AS n, CAST(diagnostico_principal.es_rara AS VARCHAR) AS r FROM casos),
      x AS (SELECT id, 'especialidad' AS campo, e AS v FROM f UNION ALL SELECT id, 'diagnostico_principal.nombre', n FROM f UNION ALL SELECT id, 'diagnostico_principal.es_rara', r FROM f),
      h AS (SELECT campo, v, count(DISTINCT id) AS n FROM x GROUP BY 1, 2)
      SELECT plan_id, categoria FROM cuotas q LEFT JOIN h ON h.campo = q.campo AND h.v = trim(strip_accents(lower(nfc_normalize(categoria))))
      WHERE coalesce(h.n, 0) < greatest(minimo, floor(cuota * tamano + 0.5))""",
}
