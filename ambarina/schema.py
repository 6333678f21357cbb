"""The schema of a case document.

Every field is optional in the reader; what a case needs to be usable is judged by ``operators.status``, never by a failing read.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(strings: str = "", **other: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings.split()]
    return T.StructType(fields + [T.StructField(n, t) for n, t in other.items()])


CODED = "nombre cie10 snomed_ct snomed_termino"
CHECKS = ("diagnosticos", "codigos_cie10", "codigos_snomed", "procedimientos", "medicamentos")
TURN = _struct("rol texto audio_tag")
PHASE = _struct("fase", dialogos=T.ArrayType(TURN))
VITALS = T.MapType(T.StringType(), _struct(valor=T.DoubleType(), unidad=T.StringType()))

CASE = T.StructType(
    [
        *_struct("id especialidad resumen").fields,
        T.StructField("diagnostico_principal", _struct(CODED, es_rara=T.BooleanType())),
        T.StructField("diagnosticos_secundarios", T.ArrayType(_struct(CODED))),
        T.StructField("sintomas", T.ArrayType(_struct(CODED))),
        T.StructField("procedimientos", T.ArrayType(_struct("nombre snomed_ct snomed_termino"))),
        T.StructField("medicamentos", T.ArrayType(_struct("nombre dosis posologia atc snomed_ct snomed_termino indicacion"))),
        T.StructField("constantes_vitales", VITALS),
        T.StructField("notas_adicionales", T.ArrayType(T.StringType())),
        T.StructField("paciente", T.StructType([T.StructField("nombre_ficticio", T.StringType()), T.StructField("edad", T.IntegerType()), *_struct("edad_unidad sexo guardian").fields])),
        T.StructField("medico", _struct("nombre_ficticio especialidad")),
        T.StructField("acompañante", _struct("nombre_ficticio relacion")),
        T.StructField("voces", T.MapType(T.StringType(), T.StringType())),
        T.StructField("transcripcion", T.ArrayType(PHASE)),
        T.StructField("audio_file", T.StringType()),
        T.StructField("validacion", _struct(**{f"{c}_verificados": T.BooleanType() for c in CHECKS}, fuentes_validacion=T.ArrayType(T.StringType()), correcciones_aplicadas=T.ArrayType(T.StringType()))),
    ]
)

#: The order of the five phases, and the roles that have a voice with the key of their voice.
PHASES = ("motivo_consulta", "anamnesis", "exploracion", "impresion_diagnostica", "plan_despedida")
VOICE_KEYS = {"medico": "medico_voice_id", "paciente": "paciente_voice_id"}
