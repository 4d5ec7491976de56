"""Secret scans: three base patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans come from patterns, leftmost and non-overlapping for each kind: `assign` (a keyword, a sign, a value of 8 or
more), `access` (AKIA and so on, 16 or more), `hex` (32 or more). Their offsets are code points of the whole match, ends
exclusive.

The battery adds spans of kind `random`. A candidate is a run of 20 or more signs of `[A-Za-z0-9+/_-]` and trailing padding
outside every base span, of which letters and digits both occur; any other `=` ends a run. Its encoding is inferred as the
smallest of decimal, hex, base32, base36 and base64 that holds it. If none holds it (`/` or `+` with `-` or `_`), its longest
pieces that base64 or base64url holds are candidates; of pieces that overlap, the one that looks least like words is tested.

Two questions are asked of a candidate. Could it have been drawn evenly from its alphabet? Chi-squared of the alphabet in
eight classes, runs about the middle, and lag-one serial correlation answer; under `EVEN` it is not random, whatever else.
And could it be words, names and numbers? That is the null hypothesis of each discovery: in such tokens letters and digits
alternate seldom, capitals stand in order, and vowels are frequent. The tails of these three counts are combined by
Fisher's method. Over all candidates of the table, in strata by length (long tokens carry more evidence), a
Benjamini-Hochberg step-up bounds the share of structured tokens among the reported ones by `RATE`. Its p-values are
rounded up to a grid, so a few hundred counts decide, however large the table. Base spans are never dropped.

Defined results: a null or empty text has no span; very long texts are scanned whole; repeated rows are scanned one by one
and count one by one in the step-up; null ids are carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_text, stored, table

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
PIECES = [re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*")]
SHORTEST = 20
KINDS = ("assign", "access", "hex", "random")
RATE, CLASSES, EVEN = 0.05, 8, 0.001
#: Of words, names and numbers: how often a letter stands beside a digit, the case changes between letters, and how many letters are vowels.
ALTERNATE, CASES, VOWELS = 0.12, 0.3, 0.36
#: Least lengths of the strata, and the grid of p-values: GRID steps for each power of e, up to LAST.
STRATA, GRID, LAST = (0, 24, 32, 48, 64), 8, 400
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by size of alphabet, smallest first.
ENCODINGS = [
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPERS + "234567"),
    ("base36", DIGITS + LOWERS),
    ("BASE36", DIGITS + UPPERS),
    ("base64", UPPERS + LOWERS + DIGITS + "+/"),
    ("base64url", UPPERS + LOWERS + DIGITS + "-_"),
]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds. A sign that a pattern needs is looked for first."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def infer_encoding(token: str) -> tuple[str, str] | None:
    """Name and alphabet of the smallest encoding that holds the token (padding aside)."""
    signs = set(token.rstrip("="))
    return next(((name, alphabet) for name, alphabet in ENCODINGS if signs <= set(alphabet)), None)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the closed sums for odd and even df."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return min(1.0, total)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, alphabet: str) -> float:
    """Three times the least p-value of the tests, at most 1, if the token was drawn evenly from the alphabet."""
    at = {c: i for i, c in enumerate(alphabet)}
    x = np.array([at[c] for c in token.rstrip("=")], float)
    n, k = len(x), len(alphabet)
    if n < 2:
        return 0.0
    sort = (x * CLASSES // k).astype(int)
    share = np.bincount((np.arange(k) * CLASSES // k), minlength=CLASSES) / k
    chi = float((((np.bincount(sort, minlength=CLASSES) - n * share) ** 2) / (n * share)).sum())
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    d = x - (k - 1) / 2
    serial = two_sided(float((d[1:] * d[:-1]).sum()) / ((k * k - 1) / 12) / math.sqrt(n - 1))
    return min(1.0, 3 * min(chi2_tail(chi, CLASSES - 1), runs, serial))


def upper_tail(k: int, n: int, p: float) -> float:
    """P(a binomial count of n with share p is k or more)."""
    if k <= 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
    total = 0.0
    for i in range(k, n + 1):
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
    return min(1.0, total)


def structure(token: str) -> float:
    """P-value of a token if it was made of words, names and numbers."""
    signs = [c for c in token if c.isalnum()]
    letters = [c for c in signs if c.isalpha()]
    beside = list(zip(signs, signs[1:], strict=False))
    both = [(a, b) for a, b in beside if a.isalpha() and b.isalpha()]
    vowels = sum(c in "aeiouAEIOU" for c in letters)
    tails = [
        upper_tail(sum(a.isdigit() != b.isdigit() for a, b in beside), len(beside), ALTERNATE),
        upper_tail(sum(a.isupper() != b.isupper() for a, b in both), len(both), CASES),
        upper_tail(len(letters) - vowels, len(letters), 1 - VOWELS),
    ]
    # Fisher: minus two logs of the product follow chi-squared with two degrees for each tail
    return chi2_tail(-2 * sum(math.log(max(t, 1e-300)) for t in tails), 2 * len(tails))


def stratum(length: int) -> int:
    return sum(length >= s for s in STRATA) - 1


def step_up(counts: dict[int, int], rate: float = RATE) -> int:
    """counts: of candidates of a stratum by place on the grid. The first place that is reported; LAST + 1 if none is."""
    total, below, first = sum(counts.values()), 0, LAST + 1
    for place in sorted(counts, reverse=True):
        below += counts[place]
        if math.exp(-place / GRID) * total <= rate * below:
            first = place
    return first


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """(start, end, place): runs that an encoding holds, and of the others the pieces; place is that of the p-value, rounded up."""
    out = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < SHORTEST:
            continue
        spans = [m.span()]
        if not infer_encoding(m[0]):
            spans = sorted({(m.start() + p.start(), m.start() + p.end()) for piece in PIECES for p in piece.finditer(m[0]) if p.end() - p.start() >= SHORTEST})
        rated = []
        for a, b in spans:
            token = text[a:b]
            if any(x < b and a < y for x, _, y in taken) or not (re.search("[A-Za-z]", token) and re.search("[0-9]", token)):
                continue
            p = structure(token) if battery(token, infer_encoding(token)[1]) >= EVEN else 1.0
            rated.append((p, a - b, a, b))
        apart: list[tuple[int, int]] = []
        for p, _, a, b in sorted(rated):
            if all(b <= x or y <= a for x, y in apart):
                apart.append((a, b))
                out.append((a, b, min(LAST, math.floor(-GRID * math.log(max(p, 1e-300))))))
    return sorted(out)


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, int]]]:
    """Base spans, and the candidates of the battery."""
    base = base_spans(text or "")
    return base, candidates(text or "", base)


_FOUND = "base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,place:int>>"


def find_secrets(df: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, comma-joined)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    rated = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("place", pa.int32())]))

    def run(part: pa.RecordBatch) -> dict:
        sha, base, more = [], [], []
        for text in part.column("text").to_pylist():
            own, others = scan(text)
            sha.append(hashlib.sha256(_joined(own).encode()).hexdigest())
            base.append([{"start": a, "kind": KINDS.index(k), "end": b} for a, k, b in own])
            more.append([{"start": a, "end": b, "place": place} for a, b, place in others])
        return {"base_sha256": pa.array(sha, pa.string()), "base": pa.array(base, span), "candidates": pa.array(more, rated)}

    scanned = stored(map_text(id_and_text(df, id_col, text_col), run, f"base_sha256 string, {_FOUND}"), "secret-spans")
    one = scanned.select(F.inline("candidates"))
    level = sum((F.when(F.col("end") - F.col("start") >= s, 1).otherwise(0) for s in STRATA[1:]), F.lit(0))
    counts: list[dict[int, int]] = [{} for _ in STRATA]
    for r in one.groupBy(level.alias("stratum"), "place").agg(F.count("*").alias("n")).collect():  # STRATA x LAST rows at most
        counts[r.stratum][r.place] = r.n
    firsts = F.array(*[F.lit(step_up(c, rate)) for c in counts])

    def reported(c):
        return c["place"] >= F.element_at(firsts, sum((F.when(c["end"] - c["start"] >= s, 1).otherwise(0) for s in STRATA[1:]), F.lit(1)))

    added = F.transform(F.filter("candidates", reported), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    text = F.transform("every", lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    count = lambda i: F.size(F.filter("every", lambda x: x["kind"] == i)).cast("bigint")
    number = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    rows = scanned.withColumn("every", F.array_sort(F.concat("base", added)))
    return rows.select("doc_id", *number, "base_sha256", F.array_join(text, ",").alias("spans"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
