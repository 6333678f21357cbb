"""Quantities written in unlike units, brought to the common unit of their magnitude.

An amount is read where it stands (a number column or text), its unit where that stands (a unit column, a misspelt one, the text).
Where the unit is nowhere, or is stated but cannot be right, it is told from the number: for each kind of reading the logarithm of the
amount in the common unit is normal, each unit is a component of the same shape offset by its conversion, and EM fits centre, width,
unit weights and the rate of wrong statements. Assignment is by posterior; what stays uncertain is flagged, never dropped.

The fit sees all rows through a histogram of log values by kind and stated unit, made in one aggregate. Its size depends on the number
of kinds, units and bins only. Everything else is column expressions and a broadcast of the spelling table, which is part of the code.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from ..sources.tables import spread

#: How units are spelled, after ``normal`` (lower case, no accents, no dots after letters). Symbols of the units table count too; ``_`` stands for a blank, which may be missing.
SPELLINGS = {
    "kg": "kg kgs kilo kilos kilogramo kilogramos",
    "gramo_corporal": "g gr grs gramo gramos",
    "lb": "lb lbs libra libras pound pounds",
    "cm": "cm cms centimetro centimetros",
    "m": "m mt mts metro metros",
    "mm": "mm mms milimetro milimetros",
    "pulgada": "in \" '' ” pulg pulgada pulgadas inch inches",
    "celsius": "°c c ° grados centigrados celsius grados_centigrados grados_celsius °_c",
    "fahrenheit": "°f f farenheit fahrenheit grados_fahrenheit grados_farenheit °_f",
    "kelvin": "k °k kelvin kelvins",
    "mmhg": "mmhg mm_hg mm_de_hg mm_de_mercurio milimetros_de_mercurio",
    "cmhg": "cmhg cm_hg cm_de_hg cm_de_mercurio centimetros_de_mercurio",
    "kpa": "kpa kilopascal kilopascales",
    "por_minuto": "lpm ppm bpm rpm lat/min latidos/min latidos_por_minuto pulsaciones/min puls/min pulsaciones_por_minuto resp/min respiraciones/min respiraciones_por_minuto /min 1/min por_minuto",
    "por_segundo": "hz hercios /s 1/s lat/s latidos/s latidos_por_segundo pulsaciones/s pulsaciones_por_segundo resp/s respiraciones/s respiraciones_por_segundo por_segundo",
    "mg_dl": "mg/dl mg% mg_% mg_por_dl mg/100_ml mg/100ml miligramos_por_decilitro",
    "mmol_l": "mmol/l mm mmol_por_l milimoles_por_litro milimoles/litro",
    "porcentaje": "% pct por_ciento porciento",
    "fraccion": "/1 fraccion tanto_por_uno por_uno",
    "mg": "mg mgr mgs miligramo miligramos",
    "g": "g gr grs gramo gramos",
    "ug": "ug mcg mcgr microgramo microgramos",
    "ml": "ml cc mililitro mililitros cm3",
    "l": "l lt lts litro litros",
    "cl": "cl centilitro centilitros",
    "ui": "ui u unidad unidades unidades_internacionales iu",
    "kui": "kui mil_ui mil_u miles_de_ui mil_unidades miles_de_unidades",
    "mui": "mui mill_ui mill_u mill_unidades millon_de_ui millones_de_ui millon_ui millones_ui millon_de_unidades millones_de_unidades",
    "mg_ml": "mg/ml mg_por_ml mgr/ml miligramos/ml miligramos_por_ml miligramos_por_mililitro mg/cc",
    "pct_pv": "%_p/v %p/v % por_ciento g/100_ml g/100ml gr/100_ml g_por_100_ml gramos_por_100_ml",
    "ug_ml": "ug/ml ug_por_ml mcg/ml mcg_por_ml mcgr/ml microgramos/ml microgramos_por_ml microgramos_por_mililitro",
}
#: The magnitude of each kind of reading, and the sizes an adult's can plausibly have, in the common unit.
KINDS = {
    "peso": ("masa_corporal", 25.0, 300.0),
    "talla": ("longitud", 100.0, 230.0),
    "temperatura": ("temperatura", 28.0, 44.0),
    "presion_arterial_sistolica": ("presion", 50.0, 280.0),
    "presion_arterial_diastolica": ("presion", 25.0, 170.0),
    "frecuencia_cardiaca": ("frecuencia", 25.0, 260.0),
    "frecuencia_respiratoria": ("frecuencia", 5.0, 70.0),
    "glucemia": ("glucosa", 20.0, 900.0),
    "saturacion_oxigeno": ("saturacion", 40.0, 100.0),
}
DOSES = ("dosis_masa", "dosis_volumen", "dosis_actividad", "dosis_concentracion")
#: Number words.
WORDS = {"medio": "0.5", "media": "0.5", "cuarto de": "0.25", "un": "1", "una": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "diez": "10"}
NUM = r"\d{1,3}(?:[ .,]\d{3})+(?:[.,]\d+)?(?!\d)|\d+(?:[.,]\d+)?"
#: Clauses of a dosage that speak of something else than the dose.
OTHER = r"agua|zumo|leche|disuel|dilu|maxim|no pasar|no super|no exced|sin pasar|pesa |peso|glucemia|tension|encima|debajo|mas de|menos de|subir|bajar|aument|razon de|por semana|en 24 h|al dia como"
BINS_PER_E = 100
SURE = 0.9


_ACCENTS = str.maketrans("áéíóúüàèìòùµμº₂’′″”", "aeiouuaeiouuu°2''\"\"")
_SIGNS = (("℃", "°c"), ("℉", "°f"), ("½", " 1/2 "), ("¼", " 1/4 "), ("¾", " 3/4 "))


def normal(text: str | None) -> str:
    """Lower case without accents, dots after letters or surplus blanks; null is the empty text."""
    return "" if text is None or text != text else _normal(text)


@lru_cache(100_000)
def _normal(text: str) -> str:
    t = text.lower()
    for a, b in _SIGNS:
        t = t.replace(a, b)
    t = "".join(c for c in unicodedata.normalize("NFC", t).translate(_ACCENTS) if not unicodedata.combining(c))
    return " ".join(re.sub(r"(?<=[a-z])\.", "", t).split())


def number(text: str) -> float | None:
    """A number in any of its styles: 75,3 · 1.200.000 · 1 200 000 · 1.234,5. Three digits after a mark are thousands unless the number starts with 0."""
    t = text.replace(" ", "")
    if re.fullmatch(r"[1-9]\d{0,2}([.,])\d{3}(\1\d{3})*", t):
        t = re.sub("[.,]", "", t)
    elif re.fullmatch(r"\d+(\.\d{3})+,\d+", t):
        t = t.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"\d+(,\d{3})+\.\d+", t):
        t = t.replace(",", "")
    try:
        return float(t.replace(",", "."))
    except ValueError:
        return None


def spellings(units: DataFrame) -> dict[str, dict[str, str]]:
    """{magnitude: {spelling: unit}} for the units of the table (a row a unit: a list that does not grow with the data)."""
    out: dict[str, dict[str, str]] = {}
    for r in units.select("unidad_id", "magnitud", "simbolo").collect():
        own = out.setdefault(r.magnitud, {})
        for s in SPELLINGS.get(r.unidad_id, "").split():
            own.setdefault(s.replace("_", " "), r.unidad_id)
        own.setdefault(normal(r.simbolo), r.unidad_id)
    return out


class Reader:
    """Reads amounts with the spellings of some units."""

    def __init__(self, own: dict[str, str]):
        self.units = {s.replace(" ", ""): u for s, u in own.items()}
        alt = "|".join(re.escape(s).replace(r"\ ", r"\s*") for s in sorted(own, key=lambda s: (-len(s), s)))
        end = r"(?![a-z0-9/%])"
        self.after = re.compile(rf"(?<![\w/.,])({NUM})(?:\s*(-|/|\ba\b)\s*({NUM}))?\s*({alt}){end}")
        self.before = re.compile(rf"(?<![a-z0-9/])({alt})\s*:?\s*({NUM})(?:\s*(-|/|\ba\b)\s*({NUM}))?(?![\w/])")
        self.named = re.compile(rf"(?:\ben\b|unidad:?)\s+({alt}){end}")
        self.bare = re.compile(rf"(?<![\w.,/])({NUM})(?![\w/])")
        long = "|".join(re.escape(s).replace(r"\ ", r"\s*") for s in sorted(own, key=len, reverse=True) if len(s) > 1 or s in "gl")
        self.words = [(re.compile(rf"\b(?:un )?{w} (?=(?:{long}){end})"), n + " ") for w, n in WORDS.items()]
        self.find, self.cue = lru_cache(100_000)(self._find), lru_cache(100_000)(self._cue)

    def unit(self, text: str) -> str | None:
        return self.units.get(text.replace(" ", ""))

    def _find(self, text: str) -> tuple[float | None, float | None, str | None]:
        """(amount, upper end, unit) of the first amount with a unit: number before unit, else unit before number."""
        for word, n in self.words:
            text = word.sub(n, text)
        if m := self.after.search(text):
            n, mark, to, u = m.groups()
        elif m := self.before.search(text):
            u, n, mark, to = m.groups()
        else:
            return None, None, None
        low, high = number(n), number(to) if to else None
        if mark == "/" and n in ("1", "3") and to in ("2", "4") and low < high:
            return low / high, low / high, self.unit(u)
        return low, low if high is None else high, self.unit(u)

    def _cue(self, text: str) -> str | None:
        m = self.named.search(text)
        return self.unit(m[1]) if m else None

    def first(self, text: str) -> float | None:
        m = self.bare.search(text)
        return number(m[1]) if m else None


_ASIDE = re.compile(r"a las \d+[:.]\d+|\b(?:en|los) \d+ min\w*|sato2")


def read_vitals(vitals: DataFrame, units: DataFrame) -> DataFrame:
    """lectura_id, clase, magnitud, valor, dicha (the stated unit or null), fuente of every reading with an amount, once a reading.

    The unit is that of ``unidad``, else ``unitem``, else the text; blank and ``-`` are none; a spelling of another magnitude is none.
    Without ``valor`` the amount is the number before a unit in the text, else its first number that is no time, interval or part of a
    name. Kinds of reading that are not known have no magnitude and are not here, as are rows without an amount: ``unread_vitals`` has
    both. Redelivered rows repeat their content.
    """
    return _read_vitals(vitals, units).filter("valor is not null and magnitud is not null")


def unread_vitals(vitals: DataFrame, units: DataFrame) -> DataFrame:
    """lectura_id and motivo of the readings that ``read_vitals`` leaves out."""
    left = _read_vitals(vitals, units).filter("valor is null or magnitud is null")
    return left.select("lectura_id", F.when(F.col("magnitud").isNull(), "clase desconocida").otherwise("sin cantidad").alias("motivo")).distinct()


def _read_vitals(vitals: DataFrame, units: DataFrame) -> DataFrame:
    own = spellings(units)
    kinds = {k: m for k, (m, _, _) in KINDS.items() if m in own}
    clase = F.regexp_replace(F.col("nombre"), "^tension_", "presion_")
    magnitude = F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("clase")) if kinds else F.lit(None).cast("string")
    v = vitals.select("lectura_id", clase.alias("clase"), "valor", "unidad", "unitem", "texto").withColumn("magnitud", magnitude)
    columns = ["lectura_id", "clase", "magnitud", "valor", "dicha", "fuente"]
    # an amount and a unit written as the list writes it need no reading; what else there is goes through Reader. The list is the code's
    written = vitals.sparkSession.createDataFrame([(m, s, u) for m in own for s, u in own[m].items()], "magnitud string, __s string, dicha string")
    has = F.col("valor").isNotNull() & ~F.isnan("valor")
    v = v.withColumn("__s", F.when(has, F.lower(F.trim("unidad")))).join(F.broadcast(written), ["magnitud", "__s"], "left")
    plain = v.filter("dicha is not null or magnitud is null").withColumn("fuente", F.when(F.col("dicha").isNotNull(), "columna").otherwise("ninguna")).select(*columns)
    rest = v.filter("dicha is null and magnitud is not null").select("lectura_id", "clase", "magnitud", "valor", "unidad", "unitem", "texto")
    schema = T.StructType([v.schema["lectura_id"], *(T.StructField(n, t) for n, t in (("clase", T.StringType()), ("magnitud", T.StringType()), ("valor", T.DoubleType()), ("dicha", T.StringType()), ("fuente", T.StringType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {m: Reader(own[m]) for m in dict.fromkeys(kinds.values())}
        for pdf in batches:
            out = []
            for key, kind, magnitude, value, unit, unit2, text in pdf.itertuples(index=False):
                r = readers[magnitude]
                said, source = r.unit(normal(unit)) or r.unit(normal(unit2)), "columna"
                missing = value is None or value != value
                if said and not missing:
                    out.append((key, kind, magnitude, value, said, source))
                    continue
                plain = _ASIDE.sub(" ", normal(text))
                if missing:
                    value, _, u = r.find(plain)
                    if value is None:
                        value, u = r.first(plain), None
                    said, source = (said, source) if said else (u, "texto")
                elif said is None:
                    said, source = r.cue(plain), "texto"
                out.append((key, kind, magnitude, value, said, source if said else "ninguna"))
            yield pd.DataFrame(out, columns=schema.names)

    return plain.unionByName(spread(rest, "lectura_id").mapInPandas(run, schema)).distinct()


def read_doses(doses: DataFrame, units: DataFrame) -> DataFrame:
    """medicacion_id, magnitud, valor, hasta, dicha, fuente of every dose, once a row; ``hasta`` is the upper end of a range.

    The dose is what ``dosis`` says; its unit may be given in ``posologia``; where ``dosis`` has no number the first amount with a unit
    in those clauses of ``posologia`` that speak of the dose. Counts of tablets are no amounts. A number whose unit is nowhere has a
    null unit and the magnitude of mass. ``unread_doses`` has the rows without a dose.
    """
    return _read_doses(doses, units).filter("valor is not null")


def unread_doses(doses: DataFrame, units: DataFrame) -> DataFrame:
    """medicacion_id and motivo of the rows that ``read_doses`` leaves out."""
    return _read_doses(doses, units).filter("valor is null").select("medicacion_id", F.lit("sin cantidad").alias("motivo")).distinct()


def _read_doses(doses: DataFrame, units: DataFrame) -> DataFrame:
    own = spellings(units)
    every: dict[str, str] = {}
    for m in DOSES:
        for s, u in own.get(m, {}).items():
            every.setdefault(s, u)
    magnitude = {u: m for m in DOSES for u in own.get(m, {}).values()}
    schema = T.StructType([doses.schema["medicacion_id"], *(T.StructField(n, t) for n, t in (("magnitud", T.StringType()), ("valor", T.DoubleType()), ("hasta", T.DoubleType()), ("dicha", T.StringType()), ("fuente", T.StringType())))])
    other = re.compile(OTHER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(every)

        @lru_cache(100_000)
        def spoken(text: str) -> str:
            return " ; ".join(c for c in re.split(r";\s*|,(?=\s)|\(", text) if not other.search(c))

        for pdf in batches:
            out = []
            for key, dose, rest in pdf.itertuples(index=False):
                dose, rest = normal(dose), spoken(normal(rest))
                low, high, unit = r.find(dose)
                source = "columna"
                if low is None:
                    low = high = r.first(dose)
                    low2, high2, unit = r.find(rest)
                    source = "texto"
                    if low is None:
                        low, high = low2, high2
                    else:
                        unit = unit or r.cue(rest)
                out.append((key, magnitude.get(unit, DOSES[0]), low, high, unit, source if unit else "ninguna"))
            yield pd.DataFrame(out, columns=schema.names)

    return spread(doses.select("medicacion_id", "dosis", "posologia"), "medicacion_id").mapInPandas(run, schema).distinct()


# ---------------------------------------------------------------------------------------------- the mixture


@dataclass(frozen=True)
class Unit:
    name: str
    factor: float
    shift: float
    common: bool


@dataclass(frozen=True)
class Fit:
    """Of one kind: centre and width of the log common amount, weight of each unit, rate of wrong statements, plausible bounds."""

    mu: float
    sigma: float
    weights: dict[str, float]
    wrong: float
    low: float
    high: float


#: Share of amounts of any plausible size, however far from the centre.
ANY = 0.05


def units_of(units: DataFrame) -> dict[str, list[Unit]]:
    out: dict[str, list[Unit]] = {}
    for r in units.collect():
        out.setdefault(r.magnitud, []).append(Unit(r.unidad_id, r.factor, r.desplazamiento, r.es_comun))
    return {m: sorted(us, key=lambda u: (not u.common, u.name)) for m, us in out.items()}


def histogram(readings: DataFrame, kind: str = "clase") -> DataFrame:
    """kind, magnitud, dicha, bin, n of the positive amounts: what the fit needs of all rows."""
    b = F.round(F.log("valor") * BINS_PER_E).cast("int")
    return readings.filter("valor > 0").groupBy(kind, "magnitud", "dicha", b.alias("bin")).agg(F.count("*").alias("n"))


def fit(hist: list[tuple[str, str, str | None, int, int]], units: dict[str, list[Unit]], bounds: dict[str, tuple[float, float]], rounds: int = 60) -> dict[str, Fit]:
    """EM for each kind over the histogram's cells (kind, magnitude, stated, bin, n). A kind without rows has no fit."""
    out = {}
    for kind in sorted({h[0] for h in hist}):
        cells = [h for h in hist if h[0] == kind]
        us = units[cells[0][1]]
        x = np.array([math.exp(c[3] / BINS_PER_E) for c in cells])
        n = np.array([c[4] for c in cells], float)
        stated = [c[2] for c in cells]
        common = np.stack([u.factor * x + u.shift for u in us], 1)
        good = common > 0
        logs = np.log(np.where(good, common, 1.0))
        jac = np.where(good, np.stack([u.factor * x for u in us], 1) / np.where(good, common, 1.0), 0)
        low, high = bounds.get(kind, (0.0, 0.0))
        width = math.log(high / low) if low else 1.0
        floor = np.where((common >= low) & (common <= high), 1 / width, 0.0) if low else np.zeros_like(common)
        says = np.array([[s == u.name for u in us] for s in stated])
        told = says.any(1)
        # first guess: statements are right, and where none is, amounts are common
        r0 = np.where(told[:, None], says, [u.common for u in us]) * (floor > 0 if low else 1.0) + 1e-12
        resp = r0 / r0.sum(1, keepdims=True)
        weights, wrong, mu, sigma = np.full(len(us), 1 / len(us)), 0.01, 0.0, 1.0
        for _ in range(rounds):
            w = resp * n[:, None]
            mu = float((w * logs).sum() / w.sum())
            sigma = max(0.01, math.sqrt(float((w * (logs - mu) ** 2).sum() / w.sum())))
            weights = (w.sum(0) + 0.5) / (w.sum() + 0.5 * len(us))
            off = float((w * ~says)[told].sum())
            wrong = float(min(0.2, max(1e-4, (off + 0.1) / (n[told].sum() + 1.0))))
            dens = ((1 - ANY) * np.exp(-0.5 * ((logs - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi)) + ANY * floor) * jac
            if low:
                dens = np.where((common >= low) & (common <= high), dens, dens * 1e-9)
            like = np.where(says, 1 - wrong, wrong / max(1, len(us) - 1))
            post = dens * weights * np.where(told[:, None], like, 1.0) + 1e-300
            new = post / post.sum(1, keepdims=True)
            if np.abs(new - resp).max() < 1e-9:
                break
            resp = new
        out[kind] = Fit(mu, sigma, {u.name: float(v) for u, v in zip(us, weights)}, wrong, low, high)
    return out


def assign(readings: DataFrame, fits: dict[str, Fit], units: dict[str, list[Unit]], kind: str = "clase", sure: float = SURE, keep_common_unless_sure: bool = False) -> DataFrame:
    """Readings with unidad_id, comun (the amount in the common unit), posterior, incierto, juicio (dicha, corregida or inferida).

    A stated unit stands unless another is surer than ``sure``; one that another is likelier than, though not so surely, is uncertain, as
    is an inferred one below SURE. Amounts that are not positive keep their stated (or common) unit and are uncertain. A kind without a
    fit keeps what is stated. Ties fall to the common unit. ``posterior`` is that of the likeliest unit.
    """
    models = {}
    for k, f in fits.items():
        us = next(v for v in units.values() if {u.name for u in v} >= set(f.weights))
        n = len(us)
        models[k] = (f, np.array([u.name for u in us], object), np.array([u.factor for u in us]), np.array([u.shift for u in us]), np.array([f.weights[u.name] for u in us]), 1e-300 * np.arange(n, 0, -1), f.wrong / max(1, n - 1))
    defaults = {m: u.name for m, us in units.items() for u in us if u.common}
    common = {u.name: (u.factor, u.shift) for us in units.values() for u in us}
    names = readings.columns
    added = "unidad_id string, comun double, posterior double, incierto boolean, juicio string"
    schema = T.StructType([*readings.schema.fields, *T._parse_datatype_string(added).fields])

    def likeliest(model: tuple, v: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, u, factor, shift, weight, least, off = model
        part = v[:, None] * factor
        c = part + shift
        at = np.where(c > 0, c, 1.0)
        p = (np.exp(-0.5 * ((np.log(at) - f.mu) / f.sigma) ** 2) * ((1 - ANY) / math.sqrt(2 * math.pi)) / f.sigma + (ANY / math.log(f.high / f.low) if f.low else 0.0)) * part / at * weight
        p *= np.where((c >= f.low) & (c <= (f.high or math.inf)), 1.0, 1e-9)
        stated = said != None  # noqa: E711
        p *= np.where(stated[:, None], np.where(said[:, None] == u, 1 - f.wrong, off), 1.0)
        p = np.where(c > 0, p, 0.0) + least  # of equal ones the first, the common unit
        best = p.argmax(1)
        return u[best], p.max(1) / p.sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            v, said = pdf["valor"].to_numpy(float), pdf["dicha"].astype(object).where(pdf["dicha"].notna(), None).to_numpy(object)
            best, post = np.full(n, None, object), np.full(n, np.nan)
            for k, where in pdf.groupby(kind, sort=False).indices.items():
                where = where[v[where] > 0]
                if k in models and len(where):
                    best[where], post[where] = likeliest(models[k], v[where], said[where])
            bare, known = said == None, best != None  # noqa: E711
            takes = known & (bare | ((best != said) & (post >= sure)))
            unit = np.where(takes, best, np.where(bare, pdf["magnitud"].map(defaults).to_numpy(object), said))
            if keep_common_unless_sure:
                unit = np.where(bare & ~(post >= SURE) & known, pdf["magnitud"].map(defaults).to_numpy(object), unit)
            juicio = np.where(bare, "inferida", np.where(takes, "corregida", "dicha"))
            doubted = ~(v > 0) | (known & (best != said) if sure <= 1 else False)
            told = [common.get(u) for u in unit]
            out = pdf.copy()
            out["unidad_id"] = [u if isinstance(u, str) else None for u in unit]
            out["comun"] = [None if c is None else x * c[0] + c[1] for x, c in zip(v, told)]
            out["posterior"] = [None if np.isnan(p) else p for p in post]
            out["incierto"] = np.where(juicio == "dicha", doubted, ~(post >= SURE))
            out["juicio"] = juicio
            yield out[[*names, "unidad_id", "comun", "posterior", "incierto", "juicio"]]

    return readings.mapInPandas(run, schema)


def bounds() -> dict[str, tuple[float, float]]:
    return {k: (lo, hi) for k, (_, lo, hi) in KINDS.items()}


def vitals_in_common_units(vitals: DataFrame, units: DataFrame) -> DataFrame:
    us, r = units_of(units), cut(read_vitals(vitals, units))  # read once, used by the fit and by the assignment
    fits = fit([tuple(x) for x in histogram(r).collect()], us, bounds())
    return assign(r, fits, us)


def doses_in_common_units(doses: DataFrame, units: DataFrame) -> DataFrame:
    """The same for doses; the kind is the magnitude, there are no plausible bounds, and a stated unit always stands."""
    us, r = units_of(units), cut(read_doses(doses, units).withColumn("clase", F.col("magnitud")))
    fits = fit([tuple(x) for x in histogram(r).collect()], us, {})
    return assign(r, fits, us, sure=1.1, keep_common_unless_sure=True)
