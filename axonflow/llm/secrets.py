"""Secret scanning with a randomness test battery (operator 4).

Base spans are fixed patterns. The battery then looks at every other token of 20 or more characters: runs of
``[A-Za-z0-9+/_=-]`` without the base spans in them, split at each ``=`` that is not padding at the end, so that the
value of NAME=value is a token of its own. The smallest alphabet that holds the token is its inferred encoding (hex,
base32, base36, base64 or its URL form). No alphabet holds both ``+/`` and ``-_``: of such a token the longest parts
within base64 and within its URL form are tested, if they have 20 characters. Three tests of the token against uniform draws from that alphabet give p-values: chi-squared of the symbol
counts, runs above and below the middle of the alphabet, and the lag-one serial correlation.

False discoveries are controlled in both directions, among tokens of the same length class (powers of two) and over all
documents, by Benjamini-Hochberg: a token whose battery rejects uniformity is text, not a secret; and a token is kept
only if a model of the corpus's own text rejects it too. That model is a Markov chain of character classes (lower, upper,
digit, mark), whose odds are counted over all shorter runs of all documents. The second p-value is the inverse likelihood
ratio of the token under the uniform and the text model, at most 1 by Markov's inequality, so it shrinks with length:
short tokens need more. p-values enter the step-up procedure as exact counts per length class and value (their logarithm
rounded up to hundredths, at least ``LEAST_LOG``, so at most 70,001 values a class), and nothing but a histogram is
gathered.

Defined cases: null text is empty and has no spans; rows are scanned one by one, repeated ones too; an empty table gives
an empty result; spans are code points [start, end); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonflow.llm.common import materialize, slices, table

# Patterns and least lengths of the base kinds.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Runs of 16 and more, with what stands before them, are the only hex matches that count.
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
TOKEN_LEAST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}")
#: Padding counts only at the end of what is searched.
PIECE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")
PARTS = (re.compile(r"[A-Za-z0-9+/]+(?:=+\Z)?"), re.compile(r"[A-Za-z0-9_-]+(?:=+\Z)?"))

KINDS = ("assign", "access", "hex", "random")
#: False discovery rates: of calling a random token text, and of calling text a secret.
FDR_UNIFORM, FDR_TEXT = 0.01, 0.01

ALPHABETS = (
    ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]

#: p-values under exp(LEAST_LOG) count as that.
LEAST_LOG = -700.0
TOKEN_FIELDS = ("start", "end", "encoding", "length", "log_uniform", "first", "moves", "room")
FOUND_SCHEMA = (
    "doc_id long, base array<struct<start:int,end:int,kind:string>>, moves array<long>, "
    "tokens array<struct<start:int,end:int,encoding:string,length:int,log_uniform:double,first:int,moves:array<long>,room:double>>"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]] if "AKIA" in text else []
    out += [(m.start(), m.end(), 2) for m in HEX_LONG.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[str, float] | None:
    """Inferred encoding and the combined p-value of uniformity; None if no alphabet holds the token."""
    body = token.rstrip("=")
    letters = set(body)
    found = next(((name, at) for name, s, at in _SETS if letters <= s), None)
    if found is None or len(body) < 8:
        return None
    name, at = found
    x, k = np.array([at[c] for c in body], float), len(at)
    n = len(x)
    # chi-squared: the cube root is near normal (Wilson and Hilferty); too uniform is not held against a token
    chi = float(((np.bincount(x.astype(int), minlength=k) - n / k) ** 2).sum() * k / n)
    f = k - 1
    p_chi = 0.5 * math.erfc((((chi / f) ** (1 / 3)) - 1 + 2 / (9 * f)) / math.sqrt(2 / (9 * f)) / math.sqrt(2))
    # runs above and below the middle
    up = x >= k / 2
    a, b = int(up.sum()), int((~up).sum())
    runs = 1 + int((up[1:] != up[:-1]).sum())
    p_runs = 1.0 if a + b < 2 else 2.0 * 0.5 ** min(n, 1000)
    if a and b:
        mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    # lag-one correlation
    d = x - x.mean()
    p_serial = _normal_tail((float((d[1:] * d[:-1]).sum() / (d * d).sum()) + 1 / n) * math.sqrt(n)) if d.any() else 0.0
    return name, min(1.0, 3 * min(p_chi, p_runs, p_serial))


#: Classes of the text model: lower, upper, digit, mark, with how many characters each has.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-")
_CLASS_OF = np.full(256, -1)
for _k, _letters in enumerate(_CLASSES):
    _CLASS_OF[list(_letters.encode())] = _k


def moves(classes: np.ndarray) -> np.ndarray:
    """How often each class follows each other one, 16 counts; -1 stands for other characters."""
    a, b = classes[:-1], classes[1:]
    inside = (a >= 0) & (b >= 0)
    return np.bincount(4 * a[inside] + b[inside], minlength=16)


def text_moves(texts: list[str]) -> np.ndarray:
    """Moves within all runs of the texts that are too short to be tested."""
    classes = _CLASS_OF[np.frombuffer("\n".join(texts).encode("utf-8", "replace"), np.uint8)]
    edges = np.flatnonzero(np.diff(classes >= 0, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    starts, lengths = starts[lengths >= TOKEN_LEAST], lengths[lengths >= TOKEN_LEAST]
    # places of the long runs' characters, all at once
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    classes[np.repeat(starts, lengths) + within] = -1
    return moves(classes)


def log_odds(counts) -> np.ndarray:
    """Natural logarithm of each character's chance after each class, from counted moves (each counted once more)."""
    table = np.asarray(counts, float).reshape(4, 4) + 1
    return (np.log(table / table.sum(axis=1, keepdims=True)) - np.log([len(c) for c in _CLASSES])).ravel()


_START = [-math.log(4 * len(c)) for c in _CLASSES]


def rounded_up(x: float) -> float:
    return min(0.0, max(LEAST_LOG, math.ceil(x * 100) / 100))


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """[start, end) of the tokens to test: pieces of runs outside ``base``, or their parts in one form of base64."""
    for run in RUN.finditer(text):
        at, gaps = run.start(), []
        for a, b, _ in base:
            if a < run.end() and at < b:
                gaps.append((at, a))
                at = b
        for start, end in [*gaps, (at, run.end())]:
            for m in PIECE.finditer(text, start, end) if end - start >= TOKEN_LEAST else ():
                if len(m[0]) < TOKEN_LEAST:
                    continue
                marks = set(m[0])
                if marks.isdisjoint("+/") or marks.isdisjoint("-_"):
                    yield m.span()
                else:
                    yield from sorted({p.span() for part in PARTS for p in part.finditer(text, *m.span()) if len(p[0]) >= TOKEN_LEAST})


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple]]:
    """Base spans, and the tested tokens: ``TOKEN_FIELDS``, of which ``room`` is minus the log-likelihood of uniform draws."""
    base, tokens = base_spans(text), []
    for start, end in candidates(text, base):
        token = text[start:end]
        if (tested := battery(token)) is None:
            continue
        name, p = tested
        body = token.rstrip("=")
        classes = _CLASS_OF[np.frombuffer(body.encode(), np.uint8)]
        size = next(len(at) for n, _, at in _SETS if n == name)
        tokens.append((start, end, name, len(token), rounded_up(math.log(max(p, 1e-300))), int(classes[0]), moves(classes).tolist(), len(body) * math.log(size)))
    return base, tokens


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = list(zip(TOKEN_FIELDS, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.float64()), strict=True))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))),
        ("moves", pa.list_(pa.int64())), ("tokens", pa.list_(pa.struct(token))),
    ])
    for batch in slices(batches):
        base, tokens = [], []
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for text in texts:
            b, t = scan_text(text)
            base.append([dict(zip(("start", "end", "kind"), x, strict=True)) for x in b])
            tokens.append([dict(zip(TOKEN_FIELDS, x, strict=True)) for x in t])
        # one row of a batch has the moves of all
        counted = pa.array([text_moves(texts).tolist()] + [None] * (len(texts) - 1) if texts else [], schema.field("moves").type)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, schema.field("base").type), counted, pa.array(tokens, schema.field("tokens").type)], schema=schema)


@dataclass(frozen=True)
class Rule:
    """The text model's log odds, and for each length class the largest rejected log p of uniformity and of text."""

    odds: tuple[float, ...]
    cuts: dict[int, tuple[float, float]]

    def log_text(self, first: int, counts: list[int], room: float) -> float:
        return rounded_up(_START[first] + sum(o * m for o, m in zip(self.odds, counts, strict=True)) + room)

    def keeps(self, length: int, log_uniform: float, log_text: float) -> bool:
        uniform, text = self.cuts[length.bit_length() - 1]
        return log_text <= text and log_uniform > uniform


def _log_text(t, odds: tuple[float, ...]):
    """As :meth:`Rule.log_text`, as a Spark expression of a token."""
    moved = F.aggregate(F.zip_with(t["moves"], F.lit(list(odds)), lambda m, o: m * o), F.lit(0.0), lambda a, x: a + x)
    start = F.element_at(F.lit(_START), t["first"] + 1)
    return F.least(F.lit(0.0), F.greatest(F.lit(LEAST_LOG), F.ceil((start + moved + t["room"]) * 100) / 100))


def learn_rule(found: DataFrame) -> Rule:
    """The text model from all counted moves, and the cut-offs by Benjamini-Hochberg over all tokens, -inf if none.

    What reaches the driver is 16 counts and one row a length class, at most 31.
    """
    counted = {r["i"]: r["n"] for r in found.select(F.posexplode("moves").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    odds = tuple(log_odds([counted.get(i, 0) for i in range(16)]).tolist())
    tested = found.select(F.explode("tokens").alias("t")).select(
        F.floor(F.log2("t.length")).cast("int").alias("class"), F.col("t.log_uniform").alias("log_uniform"), _log_text(F.col("t"), odds).alias("log_text")
    )

    def cut(column: str, rate: float) -> dict[int, float]:
        counts = tested.groupBy("class", column).agg(F.count(F.lit(1)).alias("n"))
        # a window over the distinct rounded values of a class, 70,001 at most
        upto, total = F.sum("n").over(Window.partitionBy("class").orderBy(column)), F.sum("n").over(Window.partitionBy("class"))
        ranked = counts.select("class", column, upto.alias("rank"), total.alias("m"))
        best = ranked.groupBy("class").agg(F.max(F.when(F.exp(column) <= rate * F.col("rank") / F.col("m"), F.col(column))).alias("cut"))
        return {r["class"]: -math.inf if r["cut"] is None else r["cut"] for r in best.collect()}

    uniform, text = cut("log_uniform", FDR_UNIFORM), cut("log_text", FDR_TEXT)
    return Rule(odds, {k: (uniform[k], text[k]) for k in text})


def _scanned(docs: DataFrame) -> tuple[DataFrame, Rule]:
    found = materialize(docs.select("doc_id", "text").mapInArrow(_scan, FOUND_SCHEMA), "secret-scan")
    return found, learn_rule(found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, end, kind), base ones and random tokens, of every row of ``docs`` (doc_id, text)."""
    found, rule = _scanned(docs)
    kept = F.filter("tokens", lambda t: _passes(t, rule))
    place = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: F.create_map(*(F.lit(x) for kv in place.items() for x in kv))[s["kind"]]
    spans = F.concat("base", F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind"))))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def _passes(t, rule: Rule):
    """Whether a tested token is random and not text, as a Spark condition."""
    out = F.lit(False)
    for k, (uniform, text) in rule.cuts.items():
        inside = (t["length"] >= 2**k) & (t["length"] < 2 ** (k + 1))
        out = out | (inside & (t["log_uniform"] > uniform) & (_log_text(t, rule.odds) <= text))
    return out


def _listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(text: str | None, rule: Rule) -> str | None:
    if not text:
        return text
    base, tokens = scan_text(text)
    for start, end, _, length, uniform, first, counts, room in tokens:
        if rule.keeps(length, uniform, rule.log_text(first, counts, room)):
            base.append((start, end, "random"))
    parts, at = [], 0
    for start, end, kind in sorted(base):
        if end > at:
            parts += [text[at:start], f"[{kind.upper()}]"] if start >= at else []
            at = end
    return "".join(parts) + text[at:] if base else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets and n_chars set anew; rows and columns stay.

    Overlapping spans are replaced as one. The texts are scanned twice: once for the cut-offs, once to redact.
    """
    _, rule = _scanned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([_redacted(t.as_py(), rule) for t in batch.column(at)], batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), n("random"))


SQL: dict[str, str] = {}
QUERIES = {"op4_secret_scan": op4_secret_scan}
