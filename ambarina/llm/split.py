"""Items longer than a limit, cut into overlapping pieces under it at natural boundaries, by balanced targets.

An item of L characters with limit M and overlap O needs at least n = ceil((L - O) / (M - O)) pieces. Targets for the piece ends are
spaced equally, step (L - O) / n apart; each is snapped to the strongest boundary within a fifth of a step of it (the nearest of equal
ones). Windows of neighbouring targets never meet, so every cut is found on its own. If any piece is above the limit a piece is added and
the item is cut anew, through every count from n upward; at a step of (M - O) / 1.4 no piece can fail.

A piece starts exactly O characters before the end of the one before. Lengths and positions are Unicode code points of the stored text.
Windows are whole numbers, so that what a turn's end just misses is never missed by both of its neighbours.

Two kinds of item: single texts, cut within their row; and dialogues, whose text is all turns in order. No task ever holds a dialogue:
offsets are two-level prefix sums, cuts are found turn by turn and meet in aggregates keyed by (case, count, piece), so a case that holds
a third of all turns is spread like any other rows. Dialogues are cut at n first; those that fail go on, in rounds over the next counts
(``_tries``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.packing import stretches
from ..session import cut

#: Strength of a boundary.
CHAR, WORD, SENTENCE, LINE, TURN = range(5)
#: A target's window is a step divided by REACH to either side.
REACH = 5
#: A limit no text reaches, without overlap.
NO_LIMIT = (2**31 - 2, 0)
#: The least room for new text in a piece.
LEAST_ROOM = 16
#: Counts above the least that dialogues try one by one; a dialogue that none of them fits (it has more than 160 pieces) goes on in steps
#: that double, up to the count that cannot fail.
ONE_BY_ONE = 64

_LINE = re.compile(r"(?:\r\n|[\n\r\v\f\x85  ])+[^\S\n\r]*")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+")
_WORD = re.compile(r"\s+")


def _joins(before: str, after: str) -> bool:
    """Whether a cut between two characters would fall within one that a reader sees as a whole."""
    if before == "\r" and after == "\n" or before == "‍" or after == "‍":
        return True
    return unicodedata.combining(after) > 0 or unicodedata.category(after) in ("Mn", "Me") or "︀" <= after <= "️" or "\U0001f3fb" <= after <= "\U0001f3ff"


def snap(text: str, low: int, high: int, target: float) -> tuple[int, int]:
    """(position, strength) of the strongest boundary in text[low:high], ends included, the nearest to ``target`` of equal ones.

    A cut falls after the line break, after the blanks behind a sentence, after those behind a word.
    """
    low, high = max(low, 1), min(high, len(text) - 1)
    start, stop = max(0, low - 64), min(len(text), high + 64)
    for strength, pattern in ((LINE, _LINE), (SENTENCE, _SENTENCE), (WORD, _WORD)):
        ends = [m.end() for m in pattern.finditer(text, start, stop) if low <= m.end() <= high]
        if ends:
            return min(ends, key=lambda p: (abs(p - target), p)), strength
    at = min(max(round(target), low), high)
    for d in range(0, max(high - low, 0) + 1):
        for p in (at - d, at + d):
            if low <= p <= high and not _joins(text[p - 1], text[p]):
                return p, CHAR
    return at, CHAR


def least_count(length: int, limit: int, overlap: int) -> int:
    return -(-(length - overlap) // (limit - overlap))


def sure_count(length: int, limit: int, overlap: int) -> int:
    """A count that cannot fail: a piece is at most 1.4 steps and a rounded character above the overlap."""
    return -(-(length - overlap) * (REACH + 2) // ((limit - overlap - 1) * REACH))


def window(i: int, n: int, length: int, overlap: int) -> tuple[int, int, float]:
    """(first, last, target) of the positions the i-th of n - 1 cuts may take."""
    new = length - overlap
    return overlap - -(REACH * i * new - new) // (REACH * n), overlap + (REACH * i * new + new) // (REACH * n), overlap + i * new / n


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of the pieces of a text; one piece if it is within the limit."""
    if limit - overlap < LEAST_ROOM:
        raise ValueError("the overlap leaves too little room for new text")
    length = len(text)
    if length <= limit:
        return [(0, length, TURN)]
    for n in range(least_count(length, limit, overlap), sure_count(length, limit, overlap) + 1):
        pieces, start = [], 0
        for i in range(1, n + 1):
            end, strength = snap(text, *window(i, n, length, overlap)) if i < n else (length, TURN)
            if end - start > limit:
                break
            pieces.append((start, end, strength))
            start = end - overlap
        else:
            return pieces
    raise AssertionError("the last count cannot fail")


def split_texts(df: DataFrame, limit: int, overlap: int, keys: tuple[str, ...], text: str = "texto", values: bool = True) -> DataFrame:
    """keys, pieza (from 0), inicio, fin, corte and, with ``values``, the piece's text, of every text above the limit.

    Null, empty and short texts give no row here (they are their only piece). Repeated rows count once. Extra columns are dropped.
    """
    if limit - overlap < LEAST_ROOM:
        raise ValueError("the overlap leaves too little room for new text")
    over = df.filter(F.length(text) > limit).select(*keys, text).distinct()
    fields = [over.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("pieza", "inicio", "fin", "corte")] + [T.StructField("pieza_texto", T.StringType())] * values
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for i, (s, e, strength) in enumerate(split_text(row[-1], limit, overlap)):
                    out.append((*row[:-1], i, s, e, strength, *((row[-1][s:e],) if values else ())))
            yield pd.DataFrame(out, columns=schema.names)

    return over.mapInPandas(run, schema)


# ------------------------------------------------------------------------------------------------ dialogues


def _placed(turns: DataFrame, limit: int) -> DataFrame:
    """case_id, seq, n, at and total of the turns of dialogues above ``limit``: the characters of the turn, of the case before it, and of the
    case. Turns lie in stretches; what is summed over a case is a row a stretch."""
    known = turns.filter("case_id is not null and seq is not null").select("case_id", "seq", F.coalesce(F.length("texto"), F.lit(0)).cast("long").alias("n"))
    # of several lengths at one position the last, the longest, counts
    last = F.filter("__t", lambda t, i: F.coalesce(F.get(F.col("__t"), i + 1)["seq"] != t["seq"], F.lit(True)))
    blocks = stretches(known, "n").select("case_id", "__b", last.alias("__t"))
    case = Window.partitionBy("case_id")
    sums = blocks.select("case_id", "__b", F.aggregate("__t", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("__s"))
    sums = sums.withColumn("total", F.sum("__s").over(case)).filter(F.col("total") > limit)
    before = F.coalesce(F.sum("__s").over(case.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = sums.select("case_id", "__b", "total", before.alias("__o")).join(blocks, ["case_id", "__b"])
    ends = F.aggregate("__t", F.array(F.col("__o")), lambda a, t: F.array_append(a, F.element_at(a, -1) + t["n"]))
    each = both.select("case_id", "total", F.explode(F.arrays_zip(F.col("__t").alias("t"), F.slice(ends, F.lit(1), F.size("__t")).alias("at"))).alias("z"))
    return each.select("case_id", F.col("z.t.seq").alias("seq"), F.col("z.t.n").alias("n"), F.col("z.at").alias("at"), "total")


def _tries(total: Column, limit: int, overlap: int, turn: int) -> Column:
    """The counts that dialogues try in a round, as an array of longs: the least; the next ONE_BY_ONE; the rest in steps
    that double, and the one that cannot fail."""
    least = F.expr(f"(total - {overlap} + {limit - overlap - 1}) div {limit - overlap}")
    sure = F.expr(f"((total - {overlap}) * {REACH + 2} + {(limit - overlap - 1) * REACH - 1}) div {(limit - overlap - 1) * REACH}")
    if turn == 0:
        return F.array(least)
    if turn == 1:
        return F.filter(F.sequence(least + 1, least + ONE_BY_ONE), lambda k: k <= sure)
    far = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda j: least + ONE_BY_ONE + F.pow(F.lit(2.0), j).cast("long"))
    return F.array_distinct(F.array_append(F.filter(far, lambda k: k < sure), sure))


def split_dialogues(turns: DataFrame, limit: int, overlap: int) -> DataFrame:
    """case_id, pieza (from 0), inicio, fin, corte of every dialogue whose turns sum to more than ``limit`` characters.

    turns: case_id, seq, texto. A null text counts 0; turns without case or position belong to no dialogue; redelivered turns (same
    case and position) count once. Of two texts for one position the longer counts.
    """
    if limit - overlap < LEAST_ROOM:
        raise ValueError("the overlap leaves too little room for new text")
    placed = cut(_placed(turns, limit))  # the oversized cases only, without their texts
    # a window inside a turn is shorter than it: no step is under that of the surest count
    shortest = (limit - overlap - 1) // 7 - 1
    texts = turns.filter("case_id is not null and seq is not null").filter(F.length("texto") > shortest).select("case_id", "seq", "texto", F.length("texto").cast("long").alias("n"))
    done, left = None, placed
    for turn in range(3):
        tries = left.withColumn("k", F.explode(_tries(F.col("total"), limit, overlap, turn)))
        pieces = cut(_attempt(tries, texts, overlap))
        size = F.col("fin") - F.col("inicio")
        whole = (F.max(size) <= limit) & (F.count(size) == F.col("k"))
        judged = pieces.groupBy("case_id", "k").agg(whole.alias("fits")).groupBy("case_id").agg(F.min(F.when(F.col("fits"), F.col("k"))).alias("k"))
        got = pieces.join(judged, ["case_id", "k"], "left_semi").select("case_id", (F.col("i") - 1).alias("pieza"), "inicio", "fin", "corte")
        done = got if done is None else done.unionByName(got)
        failed = judged.filter("k is null").select("case_id")
        if turn == 2 or failed.isEmpty():
            break
        left = left.join(failed, "case_id", "left_semi")
    return done


def _attempt(tries: DataFrame, texts: DataFrame, overlap: int) -> DataFrame:
    """case_id, k, i (from 1), inicio, fin, corte: the pieces of every case at every count it tries, whether or not they fit. Of every count
    there is a row, if only with nulls."""
    # positions in units of 1 / (REACH k): the window of cut i is REACH i new - new ... REACH i new + new
    at, end = (F.expr(f"{REACH} * k * ({x} - {overlap})") for x in ("at", "(at + n)"))
    t = tries.withColumn("new", F.col("total") - overlap).withColumn("__at", at).withColumn("__end", end)
    floor = lambda x, y: f"(({x}) - pmod({x}, {y})) div ({y})"
    wide = f"({REACH} * new)"
    at_turns = (
        t.withColumn("i", F.expr(floor(f"2 * __end + {wide}", f"2 * {wide}")))
        .withColumn("far", F.abs(F.expr(f"__end - i * {wide}")))
        .filter("n > 0 and i >= 1 and i < k and far <= new")
        .groupBy("case_id", "k", "i")
        .agg(F.min(F.struct("far", (F.col("at") + F.col("n")).alias("fin"))).alias("m"))
        .select("case_id", "k", "i", "m.fin", F.lit(TURN).alias("corte"))
    )
    # a window without a turn's end lies within one turn: that turn is looked into
    first = F.greatest(F.expr(floor("__at + new", wide)) + 1, F.lit(1))
    last = F.least(-F.expr(floor("new - __end", wide)) - 1, F.col("k") - 1)
    inside = t.withColumn("__a", first).withColumn("__z", last).filter("__a <= __z")
    inside = inside.select("case_id", "seq", "n", "at", "total", "k", F.explode(F.sequence("__a", "__z")).alias("i"))
    wanted = inside.groupBy("case_id", "seq", "n", "at", "total").agg(F.collect_list(F.struct("k", "i")).alias("windows"))
    within = wanted.join(texts, ["case_id", "seq", "n"]).mapInPandas(_look_into(overlap), T.StructType([tries.schema["case_id"], *_fields("k i fin"), T.StructField("corte", T.IntegerType())]))
    within = within.groupBy("case_id", "k", "i").agg(F.max(F.struct("corte", "fin")).alias("m")).select("case_id", "k", "i", "m.fin", "m.corte")
    # the text's beginning and end: every dialogue has a turn at 0
    bound = lambda i, fin, corte: F.struct(i.cast("long").alias("i"), fin.cast("long").alias("fin"), corte.cast("int").alias("corte"))
    bounds = F.explode(F.array(bound(F.lit(0), F.lit(overlap), F.lit(None)), bound(F.col("k"), F.col("total"), F.lit(TURN)))).alias("b")
    heads = tries.filter("at = 0").select("case_id", "total", "k").distinct().select("case_id", "k", bounds).select("case_id", "k", "b.*")
    # each cut ends a piece and begins the next, so one aggregate pairs them
    no = F.lit(None)
    ends = F.struct("i", "fin", "corte", no.cast("long").alias("before"))
    begins = F.struct((F.col("i") + 1).alias("i"), no.cast("long").alias("fin"), no.cast("int").alias("corte"), F.col("fin").alias("before"))
    both = at_turns.unionByName(within).unionByName(heads).select("case_id", "k", F.explode(F.array(ends, begins)).alias("p")).filter("p.i between 1 and k")
    paired = both.groupBy("case_id", "k", F.col("p.i").alias("i")).agg(F.max("p.fin").alias("fin"), F.max("p.corte").alias("corte"), F.max("p.before").alias("before"))
    return paired.select("case_id", "k", "i", (F.col("before") - overlap).alias("inicio"), "fin", "corte")


def _fields(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names.split()]


def _look_into(overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for w in r.windows:
                    low, high, target = window(w["i"], w["k"], r.total, overlap)
                    p, strength = snap(r.texto, low - r.at, high - r.at, target - r.at)
                    out.append((r.case_id, w["k"], w["i"], r.at + p, strength))
            yield pd.DataFrame(out, columns=["case_id", "k", "i", "fin", "corte"])

    return run


def piece_texts(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pieces of ``split_dialogues`` with ``texto`` and ``seqs``, the turns they touch. A turn meets a piece on (case, stretch of
    text), both being cut into stretches of fixed length, so no case is gathered anywhere; a piece's own turns are. Of two texts of equal
    length at one position the last in order counts."""
    stretch = 4096
    known = turns.filter("case_id is not null and seq is not null").select("case_id", "seq", "texto")
    known = known.join(pieces.select("case_id").distinct(), "case_id", "left_semi")
    t = _placed(known, 0).filter("n > 0").withColumn("s", F.explode(F.sequence(F.floor(F.col("at") / stretch), F.floor((F.col("at") + F.col("n") - 1) / stretch))))
    p = pieces.withColumn("s", F.explode(F.sequence(F.floor(F.col("inicio") / stretch), F.floor((F.col("fin") - 1) / stretch))))
    met = t.join(p, ["case_id", "s"]).filter("at < fin and at + n > inicio").select("case_id", "pieza", "inicio", "fin", "corte", "seq", "at", "n").distinct()
    parts = met.join(known.withColumn("n", F.length("texto").cast("long")), ["case_id", "seq", "n"])
    begin, end = F.greatest(F.col("inicio") - F.col("at"), F.lit(0)), F.least(F.col("fin") - F.col("at"), F.col("n"))
    text = F.substring("texto", (begin + 1).cast("int"), (end - begin).cast("int"))
    listed = F.sort_array(F.collect_set(F.struct("at", "seq", text.alias("x"))))  # redelivered turns once
    out = parts.groupBy("case_id", "pieza", "inicio", "fin", "corte").agg(listed.alias("l"))
    last = F.filter("l", lambda x, i: F.coalesce(F.get(F.col("l"), i + 1)["seq"] != x["seq"], F.lit(True)))
    out = out.withColumn("l", last)
    return out.select("case_id", "pieza", "inicio", "fin", "corte", F.array_join(F.transform("l", lambda x: x["x"]), "").alias("texto"), F.transform("l", lambda x: x["seq"]).alias("seqs"))


def limits(table: DataFrame) -> dict[str, tuple[int, int]]:
    """{tipo: (max_chars, solape_chars)} of a table of limits; of several rows for one kind the strictest."""
    out: dict[str, tuple[int, int]] = {}
    for r in table.collect():  # a row a kind of item
        if r.tipo is not None and r.max_chars is not None and (r.tipo not in out or r.max_chars < out[r.tipo][0]):
            out[r.tipo] = (r.max_chars, r.solape_chars or 0)
    return out
