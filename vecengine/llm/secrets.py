"""Secret scans: fixed patterns plus a battery of randomness tests on other long tokens.

Patterns give the kinds assign, access and hex. Every further run of 20 or more
token characters is a candidate of kind random. Its encoding is inferred (the
smallest known alphabet that holds it), and within that alphabet three tests
ask whether its symbols could be independent uniform draws: chi-squared
uniformity, a runs test about the middle of the alphabet, and lag-1 serial
correlation. Simes' rule combines their p-values to that of the battery.

The likelihood of the token as ordinary text, divided by its likelihood as
uniform draws from the inferred alphabet, bounds the chance that ordinary text
looks so random (Markov; times the number of alphabets tried). What the battery
doubts counts less: where its p-value is below ``level``, the bound grows by the
ratio of the two. A Benjamini-Hochberg step-up over the candidates of the
document, weighted by length, bounds the rate of false discoveries. In ordinary
text classes change at 5 % of the places, letters have their shares in English
and vowels seldom follow vowels, and digits favour repeats, steps of one, and 0
to 2; digits alone are told apart slowly, so that some 40 of them are needed.

Defined cases: null and empty texts have no spans; spans are counted in code
points, end exclusive; repeated rows are scanned each for itself; an empty
table gives no rows; a text is scanned whole; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import make_room

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
LEAST = {"assign": 12, "access": 18, "hex": 16}

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ALPHABETS = (
    DIGITS,
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    UPPER + "234567",
    DIGITS + LOWER,
    DIGITS + UPPER,
    DIGITS + UPPER + LOWER,
    DIGITS + UPPER + LOWER + "+/",
    DIGITS + UPPER + LOWER + "-_",
)
ANY = DIGITS + UPPER + LOWER + "+/-_"


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(symbols: list[int], size: int) -> float:
    """Upper tail of the chi-squared statistic against equal shares (Wilson-Hilferty)."""
    n, free = len(symbols), size - 1
    seen: dict[int, int] = {}
    for s in symbols:
        seen[s] = seen.get(s, 0) + 1
    x = sum(c * c for c in seen.values()) * size / n - n
    return normal_tail(((max(x, 0) / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))


def runs(symbols: list[int], size: int) -> float:
    """Two-sided normal tail of the number of runs below and above the middle of the alphabet."""
    high = [2 * s >= size for s in symbols]
    n, a = len(high), sum(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    found = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    return 1.0 if var <= 0 else min(1.0, 2 * normal_tail(abs(found - mean) / math.sqrt(var)))


def serial(symbols: list[int]) -> float:
    """Two-sided normal tail of the lag-1 correlation."""
    n = len(symbols)
    mean = sum(symbols) / n
    var = sum((s - mean) ** 2 for s in symbols)
    if not var:
        return 0.0
    r = sum((x - mean) * (y - mean) for x, y in zip(symbols, symbols[1:], strict=False)) / var
    return min(1.0, 2 * normal_tail(abs(r + 1 / n) * math.sqrt(n)))


#: Shares of the letters a to z in English, in thousandths.
LETTER_SHARES = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
VOWELS = "aeiouy"
VOWEL_AFTER_VOWEL, VOWEL_AFTER_CONSONANT = 0.15, 0.55
CHANGE_RATE = 0.05


def char_class(c: str) -> int:
    return 0 if c in DIGITS else 1 if c in LOWER else 2 if c in UPPER else 3


def _shares(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [math.log(w / total) for w in weights]


@lru_cache(maxsize=1)
def step_logs() -> dict[tuple[str, str], float]:
    """Log-probability of each symbol after each other one in ordinary text; an empty one stands before the first."""
    share = dict(zip(LOWER, LETTER_SHARES, strict=True))
    half = {v: sum(w for x, w in share.items() if (x in VOWELS) == v) for v in (True, False)}

    def letters(before: str | None) -> list[float]:
        if before is None:
            return _shares(list(share.values()))
        rate = VOWEL_AFTER_VOWEL if before in VOWELS else VOWEL_AFTER_CONSONANT
        return _shares([w / half[x in VOWELS] * (rate if x in VOWELS else 1 - rate) for x, w in share.items()])

    after = {a: letters(a) for a in LOWER}
    mean = letters(None)
    out = {}
    for a in ["", *ANY]:
        own = char_class(a) if a else -1
        digits = _shares([1 + 8 * (d == a) + 4 * (own == 0 and int(d) == int(a) + 1) + 8 * (d == "0") + 3 * (d in "12") for d in DIGITS])
        for b in ANY:
            new = char_class(b)
            move = math.log(1 / 4 if not a else 1 - CHANGE_RATE if new == own else CHANGE_RATE / 3)
            row = after[a.lower()] if own in (1, 2) else mean
            inner = digits[int(b)] if new == 0 else row[LOWER.index(b.lower())] if new in (1, 2) else math.log(1 / 4)
            out[a, b] = move + inner
    return out


def alphabet_of(token: str) -> str:
    letters = set(token)
    return next((a for a in ALPHABETS if letters <= set(a)), ANY)


def ordinary_p(token: str) -> float:
    """A bound of the chance that ordinary text looks so much more like uniform draws from the token's alphabet."""
    steps = step_logs()
    ordinary = sum(steps[x] for x in zip(["", *token], token, strict=False))
    ratio = ordinary + len(token) * math.log(len(alphabet_of(token)))
    return math.exp(min(0.0, ratio + math.log(len(ALPHABETS) + 1)))


def battery_p(token: str) -> float:
    """The p-values of the three tests in the token's alphabet, combined by Simes' rule."""
    alphabet = alphabet_of(token)
    place = {c: i for i, c in enumerate(alphabet)}
    symbols = [place[c] for c in token]
    found = sorted((uniformity(symbols, len(alphabet)), runs(symbols, len(alphabet)), serial(symbols)))
    return min(1.0, min(3 * p / i for i, p in enumerate(found, 1)))


def secret_p(token: str, level: float, worth: float = 1.0) -> float:
    """The bound of ``ordinary_p``, raised where the battery doubts uniform symbols; what is above ``worth`` anyway is not tested."""
    p = ordinary_p(token)
    return p if p > worth else min(1.0, p * max(1.0, level / max(battery_p(token), 1e-300)))


def discoveries(tokens: list[str], rate: float, level: float) -> list[bool]:
    """Which tokens are secrets: step-up at ``rate`` over their p-values, weighted by length."""
    if not tokens:
        return []
    total = sum(map(len, tokens))
    m = len(tokens)
    weights = [len(t) * m / total for t in tokens]
    scaled = [secret_p(t, level, rate * w) / w for t, w in zip(tokens, weights, strict=True)]
    cut = 0.0
    for i, p in enumerate(sorted(scaled), 1):
        if p <= rate * i / m:
            cut = p
    return [p <= cut for p in scaled] if cut else [p == 0 for p in scaled]


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``."""
    taken = sorted(taken)
    starts = [a for a, _ in taken]
    ends = list(accumulate((b for _, b in taken), max))
    before = [bisect_left(starts, b) for _, b in spans]
    return [(a, b) for (a, b), i in zip(spans, before, strict=True) if not i or ends[i - 1] <= a]


def scan(text: str | None, rate: float = 0.001, level: float = 0.01) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start and then kind."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if LONG_HEX.search(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    spans = apart([m.span() for m in CANDIDATE.finditer(text)], [(a, b) for _, a, b in found])
    hits = discoveries([text[a:b] for a, b in spans], rate, level)
    found += [("random", a, b) for (a, b), hit in zip(spans, hits, strict=True) if hit]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_documents(docs: DataFrame, rate: float = 0.001, level: float = 0.01) -> DataFrame:
    """doc_id and its spans, an array of (kind, begin, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        make_room()
        for batch in batches:
            texts = batch.column(1)
            spans = [[{"kind": k, "begin": a, "end": b} for k, a, b in scan(texts[i].as_py(), rate, level)] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,begin:int,end:int>>")


def redact(text: str | None, mark: str = "[secret]", rate: float = 0.001, level: float = 0.01) -> str | None:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, last = [], 0
    for _, a, b in scan(text, rate, level):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def redact_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced and ``n_chars`` counted anew where it exists."""

    def run(batches):
        make_room()
        for batch in batches:
            i = batch.schema.get_field_index("text")
            column = batch.column(i)
            texts = pa.array([redact(column[j].as_py(), mark) for j in range(len(column))], column.type)
            yield batch.set_column(i, batch.schema.field(i), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``scan_documents``."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
