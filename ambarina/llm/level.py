"""How demanding a text is to read: smoothed unigram language models, one a level, and the level of highest posterior likelihood.

The models are trained on texts whose level is known. Their number is bounded by a parameter (``MOST_LABELLED``; of more, those whose
ids hash lowest), so the model has a bounded vocabulary and travels with the tasks; words are counted where the texts are, and no text
reaches the driver. Every text of the corpus is scored, whole. Where no level is known, texts are seeded by a readability formula instead
(``seeded``).

The evidence of all words is summed, so headings, footers and a stray sentence weigh as little as they are long. Text read twice through
a wrong encoding (``Ã³`` for ``ó``) is read as meant. Texts without a word have no level.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread


MOST_LABELLED = 20_000
#: Added to each word's count in each level.
SMOOTHING = 0.3
LEVELS = (1, 2, 3, 4)
_WORD = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"[ÃÂâ][\x80-¿‘-™]")


def mended(text: str) -> str:
    """The text as meant, if its UTF-8 was once read as Latin; stretches that do not decode stay as they are."""
    if not _TWICE.search(text):
        return text
    for codec in ("cp1252", "latin-1"):
        try:
            return text.encode(codec).decode("utf-8")
        except UnicodeError:
            pass
    return re.sub(r"[Â-ô][\x80-¿]{1,3}", lambda m: m[0].encode("latin-1").decode("utf-8", "replace") if "�" not in m[0].encode("latin-1").decode("utf-8", "replace") else m[0], text)


def words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", mended(text)).lower())


@dataclass(frozen=True)
class Model:
    """levels; prior log probabilities; word -> log probability in each level; that of a word never seen, the same in each."""

    levels: tuple[int, ...]
    prior: tuple[float, ...]
    table: dict[str, tuple[float, ...]]

    def scores(self, text: str) -> list[float]:
        s = list(self.prior)
        get = self.table.get
        for w, n in Counter(words(text)).items():
            if (row := get(w)) is not None:
                for i, v in enumerate(row):
                    s[i] += n * v
        return s

    def level(self, text: str | None) -> tuple[int | None, float | None, int]:
        """(level, posterior, words parted by white space). Ties fall to the lower level; without a known word the prior decides."""
        if text is None or not _WORD.search(text):
            return None, None, 0 if text is None else len(text.split())
        s = self.scores(text)
        best = max(range(len(s)), key=lambda i: (s[i], -i))
        return self.levels[best], 1 / sum(math.exp(max(-700.0, v - s[best])) for v in s), len(text.split())


def train(labelled: list[tuple[str, int]], smoothing: float = SMOOTHING) -> Model:
    """A model from (text, level); every level counts as likely as another. Empty texts teach nothing; no text at all gives a flat model."""
    counts: dict[int, Counter] = {}
    for text, lv in labelled:
        if text is not None and lv is not None:
            counts.setdefault(lv, Counter()).update(words(text))
    return model_of(counts, smoothing)


def model_of(counts: dict[int, Counter], smoothing: float = SMOOTHING) -> Model:
    """A model from the counts of words in each level."""
    levels = tuple(sorted(lv for lv, c in counts.items() if c)) or LEVELS
    vocabulary = set().union(*counts.values())
    totals = [sum(counts.get(lv, Counter()).values()) + smoothing * (len(vocabulary) + 1) for lv in levels]
    table = {w: tuple(math.log((counts[lv][w] + smoothing) / t) for lv, t in zip(levels, totals)) for w in vocabulary}
    return Model(levels, tuple(-math.log(len(levels)) for _ in levels), table)


def fitted(labelled: DataFrame, smoothing: float = SMOOTHING) -> Model | None:
    """``train`` of a table (text, level) of bounded size, its words counted in the tasks; None if it has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for text, lv in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                if text is not None and lv is not None:
                    c.update((lv, w) for w in words(text))
        keys = list(c)
        yield pa.RecordBatch.from_arrays([pa.array([lv for lv, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), pa.array([c[k] for k in keys], pa.int64())], names=["lv", "w", "n"])

    text, level = labelled.columns
    rows = labelled.select(text, F.col(level).cast("int")).mapInArrow(count, "lv int, w string, n long").groupBy("lv", "w").agg(F.sum("n").alias("n"))
    counts: dict[int, Counter] = {}
    for r in rows.collect():  # the vocabulary of at most MOST_LABELLED texts
        counts.setdefault(r.lv, Counter())[r.w] = r.n
    return model_of(counts, smoothing) if counts else None


def labelled(documents: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", level: str = "nivel", most: int = MOST_LABELLED) -> DataFrame:
    """text and level of at most ``most`` documents. Two levels for one document both count, as do copies under other ids."""
    k = known.filter(F.col(key).isNotNull() & F.col(level).isNotNull()).select(key, level).distinct()
    k = k.orderBy(F.xxhash64(key), level).limit(most)
    return documents.filter(F.col(text).isNotNull()).select(key, text).join(F.broadcast(k), key).select(text, level)  # k has at most ``most`` rows


def labelled_texts(documents: DataFrame, known: DataFrame, **named) -> list[tuple[str, int]]:
    """``labelled`` as a list, for held-out tests."""
    return [tuple(r) for r in labelled(documents, known, **named).collect()]


def perspicuity(text: Column) -> Column:
    """The Szigriszt-Pazos index of a Spanish text: 206.835 - 62.3 syllables / words - words / sentences; null without a word."""
    n_words = F.regexp_count(text, F.lit(r"[\p{L}]+"))
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?…;:\n]+")), F.lit(1))
    syllables = F.regexp_count(F.lower(text), F.lit("[aeiouáéíóúü]+"))
    return F.when(n_words > 0, 206.835 - 62.3 * syllables / n_words - n_words / sentences)


def seeded(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """text and level by formula of at most ``most`` documents, to train on where no level is known. Bounds of the INFLESZ scale."""
    p = perspicuity(F.col(text))
    lv = F.when(p > 80, 1).when(p > 65, 2).when(p > 40, 3).otherwise(4)
    picked = documents.filter(p.isNotNull()).select(F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(most).select(key)
    return documents.join(F.broadcast(picked), key).select(text, lv.alias("nivel"))  # at most ``most`` ids


def seeds(documents: DataFrame, **named) -> list[tuple[str, int]]:
    return [tuple(r) for r in seeded(documents, **named).collect()]


def spanish(lang: Column) -> Column:
    """Whether a language mark is one of those of Spanish; a text without a mark is taken for Spanish, as the corpus is."""
    m = F.lower(F.trim(lang))
    return lang.isNull() | (m == "") | m.rlike(r"^(es|spa|esp|español|espanol|castellano|spanish)([-_].*)?$")


def levels(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of ``keep``, nivel, posterior, n_words of every document; a null level for a text without words."""
    schema = T.StructType([documents.schema[c] for c in (key, *keep)] + [T.StructField("nivel", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.level(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[key, *keep, "nivel", "posterior", "n_words"])

    return spread(documents.select(key, *keep, text), key).mapInArrow(run, schema)


def profile(leveled: DataFrame, by: str = "source") -> DataFrame:
    """Texts and words by group and level."""
    return leveled.groupBy(by, "nivel").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))
