"""Secret scans: fixed patterns, and a battery of randomness tests over everything that could be a key.

Candidates are long runs of key characters. Each is read in the smallest usual encoding that holds it and put to three
tests of uniform, independent characters: chi-squared counts over the alphabet, runs about its middle, and serial
correlation of neighbours; Fisher's method joins their p-values. What fails them is no key. What passes may be a word by luck: the
chance that a string of letters as frequent as in ordinary text repeats characters so little follows from its length and
alphabet alone, so it is the same in every table, and a single key can be told. Benjamini-Hochberg over these chances, within each
length band and alphabet, bounds the share of false finds.

Only expressions of DataFrames are used. What is gathered from the corpus is a table of counts by band, alphabet and chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole

# The patterns the scan must report, and the least length of what they capture.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the runs of [0-9a-f]+ of 24 or more, without trying each shorter one
KINDS = ("assign", "access", "hex", "random")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
FALSE_SHARE = 0.05
LEAST_P = 0.001  # joint p-value of the battery below which a candidate isn't taken for random
CELLS, PER_DECADE = 80, 4  # chances are counted in quarters of a power of ten, down to 1e-20
TOP_BAND = 16
# How often the letters a to z come in ordinary English text, in percent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
_SQUARES, _CUBES = (sum((f / sum(LETTERS)) ** power for f in LETTERS) for power in (2, 3))

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the smallest alphabet up: what the string must look like, and the alphabet in order.
ENCODINGS = [
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Z]+$", _UPPER),
    (r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^[A-Za-z]+$", _UPPER + _LOWER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"", _UPPER + _LOWER + _DIGITS + "-_+/="),
]
# The polynomial of Abramowitz and Stegun, 26.2.17, for the upper tail of the normal distribution.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, kept above zero for logarithms."""
    t = 1 / (1 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in reversed(_TAIL):
        poly = (poly + c) * t
    return F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * poly, F.lit(1e-300))


def one_sided(z: Column) -> Column:
    return F.when(z >= 0, upper_tail(z)).otherwise(1 - upper_tail(-z))


def two_sided(z: Column) -> Column:
    return F.least(2 * upper_tail(F.abs(z)), F.lit(1.0))


def spans(text: Column, matches: Column, pattern: str) -> Column:
    """Array of (start, end, match) in code points, from the texts of all matches of the pattern.

    Matches cut the text into pieces; a running sum over the lengths of pieces and matches gives the places.
    """
    pieces = F.split(text, pattern, -1)
    zipped = F.transform(matches, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), m.alias("m")))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(zipped, empty, step, lambda acc: acc["out"])).otherwise(empty["out"])


def chance(chi: Column, n: Column, k: Column) -> Column:
    """Probability that n letters of ordinary text repeat so little that their coincidences reach `chi` at most.

    Coincidences of draws with the letters' frequencies, in the units of the test for k equally likely characters.
    """
    unit = 2 * n * (n - 1) / k * (1 - 1 / k)
    mean = n * (n - 1) * (_SQUARES - 1 / k) / F.sqrt(unit)
    variance = (4 * n * (n - 1) * (n - 2) * (_CUBES - _SQUARES**2) + 2 * n * (n - 1) * (_SQUARES - _SQUARES**2)) / unit
    return one_sided((mean - chi) / F.sqrt(variance))


def randomness(s: Column) -> Column:
    """(p, chance, k) of one candidate: Fisher's joint p-value of the three tests, the chance of an ordinary string, its alphabet's size."""
    body = F.regexp_replace(s, "=+$", "")
    alphabet = F.lit(ENCODINGS[-1][1])
    for shape, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(s.rlike(shape), F.lit(letters)).otherwise(alphabet)
    return F.transform(F.array(F.struct(F.when(F.length(body) >= 2, body).otherwise(s).alias("s"), alphabet.alias("a"))), _battery)[0]


def _battery(x: Column) -> Column:
    chars = F.filter(F.split(x["s"], ""), lambda c: c != "")
    values = F.transform(chars, lambda c: F.instr(x["a"], c).cast("double") - 1)
    return F.transform(F.array(F.struct(chars.alias("c"), values.alias("v"), F.length(x["a"]).cast("double").alias("k"), F.size(chars).cast("double").alias("n"))), _tests)[0]


def _tests(x: Column) -> Column:
    n, k, v = x["n"], x["k"], x["v"]
    add = lambda acc, y: acc + y
    zero = F.lit(0.0)
    # Chi-squared over the alphabet, in its equal form by coincidences, whose mean and variance hold for short strings.
    same = F.aggregate(F.transform(F.array_distinct(x["c"]), lambda d: F.size(F.filter(x["c"], lambda c: c == d)).cast("double")), zero, lambda acc, c: acc + c * (c - 1))
    chi = (same - n * (n - 1) / k) / F.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
    # Runs about the middle of the alphabet: neighbours fall on different sides with probability 2q(1 - q).
    q = F.floor(k / 2) / k
    turn = 2 * q * (1 - q)
    nexts = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turns = F.aggregate(F.transform(pairs, lambda p: ((p["a"] < F.floor(k / 2)) != (p["b"] < F.floor(k / 2))).cast("double")), zero, add)
    runs = (turns - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
    mean, variance = (k - 1) / 2, (k * k - 1) / 12
    serial = F.aggregate(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)), zero, add) / variance / F.sqrt(n - 1)
    half = -(F.log(one_sided(chi)) + F.log(two_sided(runs)) + F.log(two_sided(serial)))
    return F.struct((F.exp(-half) * (1 + half + half * half / 2)).alias("p"), chance(chi, n, k).alias("chance"), k.cast("int").alias("k"))


def _numbered(found: str | Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, candidates): spans of the fixed patterns and tested candidates of every whole text."""
    read = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_t"))
    read = read.select("doc_id", "_t", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE))])
    text = F.col("_t")
    found = read.select(
        "doc_id",
        F.filter(spans(text, F.col("_assign"), ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_CHARS).alias("assign"),
        F.filter(spans(text, F.col("_access"), ACCESS), lambda x: F.length(x["m"]) >= ACCESS_CHARS).alias("access"),
        spans(text, F.col("_hex"), HEX).alias("hex"),
        spans(text, F.col("_random"), CANDIDATE).alias("random"),
    )
    base = F.array_sort(F.concat(*[_numbered(k, no) for no, k in enumerate(KINDS[:3])]))
    def tested(x: Column) -> Column:
        return F.transform(F.array(F.struct(x.alias("x"), randomness(x["m"]).alias("r"))), lambda y: F.struct(
            y["x"]["start"].alias("start"),
            y["x"]["end"].alias("end"),
            F.least(F.floor(2 * F.log2(F.length(y["x"]["m"]))), F.lit(2 * TOP_BAND)).cast("int").alias("band"),
            y["r"]["k"].alias("k"),
            F.when(y["r"]["p"] >= LEAST_P, F.least(F.floor(-F.log10(y["r"]["chance"]) * PER_DECADE), F.lit(CELLS))).otherwise(0).cast("int").alias("cell"),
        ))[0]

    return found.select("doc_id", base.alias("base"), F.transform("random", tested).alias("candidates"))


def cutoffs(scanned: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[int, int], int]:
    """For each length band and alphabet the first cell of chances that is declared random.

    Benjamini-Hochberg over cells in place of single candidates, each with the greatest chance it can hold, and with the number
    of ordinary strings put at twice those whose chance is above one half. The tables here have a row per band, alphabet
    and cell, whatever the size of the corpus.
    """
    kind = ["band", "k"]
    cells = stored(scanned.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.k", "c.cell").agg(F.count("*").alias("n")), "cells")
    every, least_first = Window.partitionBy(*kind), Window.partitionBy(*kind).orderBy(F.desc("cell"))
    p0 = F.pow(F.lit(10.0), -F.col("cell") / PER_DECADE)
    ordinary = F.least(F.sum("n").over(every), 2 * (1 + F.coalesce(F.sum(F.when(F.col("cell") <= 1, F.col("n"))).over(every), F.lit(0))))
    passing = cells.withColumns({"rank": F.sum("n").over(least_first), "ordinary": ordinary}).where((F.col("cell") > 0) & (p0 <= false_share * F.col("rank") / F.col("ordinary")))
    return {(r["band"], r["k"]): r["cut"] for r in passing.groupBy(*kind).agg(F.min("cell").alias("cut")).collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per input row: doc_id, found (array of start, kind number, end), in code points, ends exclusive.

    Kinds are numbered as in KINDS; `random` spans are candidates the battery declares random that overlap no other span.
    Null counts as the empty text, which holds nothing. Rows are scanned one by one, so repeats and ties change nothing
    but the counts the false-discovery control sees. An empty table gives an empty result; other columns are ignored.
    """
    scanned = stored(scan(docs, id_col, text_col), "scan")
    cuts = cutoffs(scanned, false_share)

    def is_random(c: Column) -> Column:
        hit = F.lit(False)
        for (band, k), cut in sorted(cuts.items()):
            hit = hit | ((c["band"] == band) & (c["k"] == k) & (c["cell"] >= cut))
        return hit & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    random = _numbered(F.filter("candidates", is_random), KINDS.index("random"))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("found"))


def joined(found: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
