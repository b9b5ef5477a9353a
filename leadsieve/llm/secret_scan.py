"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests picks out.

A token (a run of base64-like characters with a letter) is read whole and, where signs divide it, by
its parts, in the smallest encoding that holds its characters. Two kinds of evidence make its p-value.

The likelihood of the token as a uniform string of its encoding is set against that as an ordinary
identifier, whose characters tend to stay in their class (lower, upper, digit, sign) and whose letters
come as often as in written words. Under the identifier model the ratio has mean 1, so its reciprocal is
a p-value, and it can only be small if the token is long enough. The battery (chi-squared uniformity
over the alphabet, a runs test around its middle, the lag-1 serial correlation) says how well the token
fits a uniform random string; its p-value, at most 1, divides the other, so that what fits badly needs
as much more evidence. The best reading of a run counts, times the number of its readings.

Benjamini-Hochberg over all runs of the corpus, apart for each doubling of the length, then bounds
the share of false discoveries. It needs only how many have which p-value, in half powers of two.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import map_batches, small_batches, stored, texts_of

#: Fixed patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # longest runs, so the same as all runs without the short ones
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Characters that a token needs, and the runs of which tokens are read.
LEAST = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PART = re.compile(r"[A-Za-z0-9]{16,}")

#: Level of false discoveries; classes that stay; lower case after upper case (as in `CamelCase`).
FDR = 0.01
STAY = 0.9
CAPITAL = 0.5
MAX_BIN = 200

#: Letters of English text, per ten thousand, a to z.
LETTER_SHARES = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet to the largest; the first that holds a token is taken.
ALPHABETS = tuple(
    {c: i for i, c in enumerate(x)}
    for x in (
        _DIGITS + "abcdef",
        _DIGITS + "ABCDEF",
        _UPPER + "234567",
        _DIGITS + _LOWER,
        _DIGITS + _UPPER,
        _DIGITS + _UPPER + _LOWER,
        _UPPER + _LOWER + _DIGITS + "+/",
        _UPPER + _LOWER + _DIGITS + "-_",
        _UPPER + _LOWER + _DIGITS + "+/-_",
    )
)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(values: list[int], size: int) -> float:
    """The smaller of three p-values against a uniform random string, times three.

    The moments are those of a multinomial sample, which hold for expected counts below one too.
    """
    n = len(values)
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi = size / n * sum(c * c for c in counts.values()) - n
    z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    uniform = 0.5 * math.erfc(z / math.sqrt(2))

    high = [2 * v >= size for v in values]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = 2.0 ** (1 - n)

    mean = sum(values) / n
    var = sum((v - mean) ** 2 for v in values)
    if var:
        r = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:], strict=False)) / var
        serial = _two_sided((r + 1 / n) * math.sqrt(n))
    else:
        serial = 0.0
    return min(1.0, 3 * min(uniform, runs_p, serial))


_LETTER_TOTAL = sum(LETTER_SHARES)
#: The class of a character (digit, lower, upper, sign) and its share of that class.
_CHARACTERS = {
    **{c: (0, 1 / 10) for c in _DIGITS},
    **{c: (1, n / _LETTER_TOTAL) for c, n in zip(_LOWER, LETTER_SHARES, strict=True)},
    **{c: (2, n / _LETTER_TOTAL) for c, n in zip(_UPPER, LETTER_SHARES, strict=True)},
    **{c: (3, 1 / 4) for c in "+/_-"},
}


def _moves(before: int) -> list[float]:
    """Chances of the next character's class in an identifier."""
    if before == 2:  # a capital is followed by capitals or by the rest of its word
        return [(1 - CAPITAL) * (1 - STAY) / 2, CAPITAL, (1 - CAPITAL) * STAY, (1 - CAPITAL) * (1 - STAY) / 2]
    return [STAY if k == before else (1 - STAY) / 3 for k in range(4)]


_MOVES = [_moves(k) for k in range(4)]


def evidence(token: str, size: int) -> float:
    """log2 of the likelihood as a uniform string of `size` characters over that as an identifier."""
    out, before = 0.0, None
    for c in token:
        kind, share = _CHARACTERS[c]
        move = 1 / 4 if before is None else _MOVES[before][kind]
        out -= math.log2(share * move * size)
        before = kind
    return out


def judge(token: str) -> tuple[int, int] | None:
    """(length class, half powers of two of the p-value) of a token with a letter, else None."""
    body = token.rstrip("=")
    if not any(c.isalpha() for c in body):
        return None
    seen = set(body)
    alphabet = next(x for x in ALPHABETS if all(c in x for c in seen))
    bits = evidence(body, len(alphabet))
    if bits > 0:
        bits += math.log2(max(battery([alphabet[c] for c in body], len(alphabet)), 2.0**-MAX_BIN))
    return int(math.log2(len(body))), int(min(MAX_BIN, max(0.0, 2 * bits)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, by start and then kind."""
    low = text.lower()
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, p-value step) of the best reading of every run: whole, or its parts.

    A reading inside one fixed span is that span's; one that reaches beyond it is judged like any other.
    """
    outer: list[tuple[int, int]] = []  # without spans inside others, so that ends rise with starts
    for start, _, end in base:
        if outer and outer[-1][0] == start and end > outer[-1][1]:
            outer.pop()
        if not outer or end > outer[-1][1]:
            outer.append((start, end))
    out, at = [], 0
    for m in TOKEN.finditer(text):
        while at < len(outer) and outer[at][1] <= m.start():
            at += 1
        near, upto = [], at
        while upto < len(outer) and outer[upto][0] < m.end():
            near.append(outer[upto])
            upto += 1
        places = [(m.start(), m.end())]
        body = m.group().rstrip("=")
        if not body.isalnum():
            places += [(m.start() + p.start(), m.start() + p.end()) for p in PART.finditer(body)]
        read = [(s, e, judge(text[s:e])) for s, e in places if not any(b <= s and e <= c for b, c in near)]
        read = [(s, e, *found) for s, e, found in read if found]
        if not read:
            continue
        tests = math.ceil(2 * math.log2(len(read)))
        read = [(s, e, step, max(0, p - tests)) for s, e, step, p in read]
        whole, parts = read[0], read[1:]
        if (whole[0], whole[1]) != places[0]:
            out += read
        elif parts and max(p for *_, p in parts) > whole[3]:
            out += parts
        else:
            out.append(whole)
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "kind", "end")]))
_TOKEN = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "end", "step", "bin")]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of `docs` with `base_spans` and `token_spans`."""
    schema = T.StructType([*docs.schema.fields, T.StructField("base_spans", _SPAN), T.StructField("token_spans", _TOKEN)])
    names = docs.columns

    def make():
        def work(batch):
            texts = texts_of(batch, text_col)
            base = [base_spans(x) for x in texts]
            tokens = [token_spans(x, b) for x, b in zip(texts, base, strict=True)]
            return [
                *(batch.column(x) for x in names),
                [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in base],
                [[dict(zip(("start", "end", "step", "bin"), s, strict=True)) for s in x] for x in tokens],
            ]

        return work

    return map_batches(docs, make, schema)


def cutoffs(scanned: DataFrame, level: float = FDR) -> dict[int, int]:
    """For each length class the p-value step from which tokens are discoveries (Benjamini-Hochberg)."""
    steps = scanned.select(F.explode("token_spans").alias("t")).groupBy("t.step", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    table: dict[int, dict[int, int]] = {}
    for r in steps.collect():  # at most MAX_BIN + 1 rows for each doubling of the length
        table.setdefault(r["step"], {})[r["bin"]] = r["n"]
    out = {}
    for step, bins in table.items():
        total = sum(bins.values())
        above = 0
        for at in sorted(bins, reverse=True):
            above += bins[at]
            if total * 2.0 ** (-at / 2) <= level * above:
                out[step] = at
    return out


def all_spans(cuts: dict[int, int]) -> Column:
    """Fixed and discovered spans (start, kind, end) of a scanned row, by start and then kind."""
    found = F.lit(False)
    discovered = lambda t: [(t["step"] == k) & (t["bin"] >= v) for k, v in cuts.items()]

    def keep(t):
        out = found
        for x in discovered(t):
            out = out | x
        return out

    tokens = F.transform(F.filter("token_spans", keep), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return F.sort_array(F.concat(F.col("base_spans"), tokens))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = FDR) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    NULL and empty texts have no spans. Ids may be NULL or repeat, other columns are not read, an
    empty table gives an empty one. Texts are scanned once, when called: the spans are written to the
    shared scratch folder, counted for the false-discovery cutoffs and read again.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    scanned = stored(scan(narrow, "_text").drop("_text"), "secret-spans")
    df = scanned.withColumn("_all", all_spans(cutoffs(scanned, level)))
    count = lambda k: F.size(F.filter("_all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return df.select("doc_id", *[count(k) for k in range(4)], F.sha2(spelled(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", level: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of a secret replaced by `mark`; rows and columns stay as they are.

    Overlapping spans are replaced as one. NULL texts stay NULL. Texts are scanned twice, for the
    cutoffs and for the result, so that they need not be stored in between.
    """
    small_batches(docs.sparkSession)
    cuts = cutoffs(scan(docs.select(text_col), text_col), level)
    names = docs.columns

    def clean(text):
        base = base_spans(text)
        found = [(s, e) for s, e, step, p in token_spans(text, base) if step in cuts and p >= cuts[step]]
        return replaced(text, [(s, e) for s, _, e in base] + found, mark)

    def make():
        def work(batch):
            return [[x and clean(x) for x in batch.column(x).to_pylist()] if x == text_col else batch.column(x) for x in names]

        return work

    return map_batches(docs, make, docs.schema)


def replaced(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
