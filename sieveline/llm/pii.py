"""Operator 8: personal data, by weak supervision.

Regular expressions propose spans; shape, checksum, gazetteer, boundary and context labelers vote on each;
expectation-maximisation estimates how reliable each labeler is; a logistic classifier trained on the estimates, which
sees the span's characters and neighbours beside the votes, decides on the spans that the base rules don't already hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, tidy, written

#: The base rules' kinds, and one that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
_DIGIT = re.compile(r"[0-9]")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider proposals: an address written out, a national phone number, a key or token. A part of a host name has 63
# characters and a local part 64 at most, as in RFC 1035 and RFC 5321; a longer run is no address.
_WRITTEN_OUT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{20,}")

TOP_LEVEL = frozenset("com org net edu gov mil int info biz name io co us uk de fr es it nl be ch at se no dk fi pl pt ie eu ca au nz jp cn in br mx ar cl ru".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "852", "886", "971", "972")
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "2221", "2720", "6011", "65", "35", "30", "36", "38")
FOR = {
    "email": re.compile(r"e-?mail|contact|write|correo|courriel|kontakt|schreib", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|dirección|adresse|login", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|credit|debit|tarjeta|carte|karte", re.IGNORECASE),
    "phone": re.compile(r"phone|tel\b|call|mobile|fax|teléfono|móvil|téléphone|appel|anruf|handy", re.IGNORECASE),
    "secret": re.compile(r"token|secret|api.?key|passw|credential|bearer|authori[sz]ation|private.?key", re.IGNORECASE),
}
SHAPES = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|[.](?![.]))*(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9].*[A-Za-z]", re.IGNORECASE),
    "ip": re.compile(r"(?:(?:[1-9][0-9]{0,2}|0)\.){3}(?:[1-9][0-9]{0,2}|0)"),
    "card": re.compile(r"[0-9]{12,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"),
    "secret": re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}"),
}
PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xoxb-", "xoxa-", "xoxp-", "AKIA", "eyJ")
AGAINST = re.compile(r"version|isbn|order|invoice|serial|section|pedido|factura|facture|rechnung|bestell|\bid\b|\bno\b", re.IGNORECASE)
LABELERS = ("shape", "checksum", "gazetteer", "boundary", "context")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def _n_digits(span: str) -> int:
    return len(_DIGIT.findall(span))


def _mixed(span: str) -> bool:
    """Whether a run has digits and ASCII letters."""
    return any(c.isdigit() for c in span) and any(c.isalpha() for c in span)


def _spread(span: str) -> float:
    """Bits of entropy a character."""
    n = np.bincount(np.frombuffer(span.encode(), np.uint8))
    p = n[n > 0] / len(span)
    return float(-(p * np.log2(p)).sum())


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, start, end) of the base rules' spans: leftmost and non-overlapping per kind, then tested."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        last = 0
        for m in _HOST.finditer(text):  # as the whole pattern, but linear: what stands before @ is taken from the left
            at = m.start()
            while at > last and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                found.append(("email", at, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= _n_digits(m.group()) <= 15]
    return sorted(((s, k, s, e) for k, s, e in found), key=lambda x: (x[0], KINDS.index(x[1])))


def more_spans(text: str, base: list[tuple[int, str, int, int]]) -> list[tuple[str, int, int]]:
    """Wider proposals that touch no base span, in order of start."""
    found = []
    if "(at" in (low := text.lower()) or "[at" in low:
        found += [("email", m.start(), m.end()) for m in _WRITTEN_OUT.finditer(text)]
    if _DIGIT.search(text):
        found += [("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= _n_digits(m.group()) <= 19]
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)]
        found += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if _mixed(m.group())]
    out, taken, k = [], -1, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        while k < len(base) and base[k][3] <= s:
            k += 1
        j = k
        while j < len(base) and base[j][2] < e and base[j][3] <= s:
            j += 1
        if s >= taken and not (j < len(base) and base[j][2] < e):
            out.append((kind, s, e))
            taken = e
    return out


def votes(text: str, kind: str, s: int, e: int) -> tuple[int, ...]:
    """Of each labeler: 1 for, -1 against, 0 none. None of them asks the base rules."""
    span, before = text[s:e], text[max(0, s - 48) : s]
    digits = "".join(_DIGIT.findall(span))
    if kind == "email":
        end = re.split(r"[.\])\s]+", span.rstrip(")]"))[-1].lower()
        checksum, known = (1 if end.isalpha() and len(end) > 1 else -1), (1 if end in TOP_LEVEL else -1)
    elif kind == "ip":
        first = span.split(".")[0].lstrip("0")
        checksum, known = (1 if _octets(span) else -1), (-1 if first in ("", "255") else 0)
    elif kind == "card":
        checksum, known = (1 if luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else -1)
    elif kind == "phone":
        checksum, known = (1 if 10 <= len(digits) <= 15 else -1), (1 if span[0] == "+" and digits.startswith(CALLING_CODES) else 0)
    else:
        checksum, known = (1 if _spread(span) >= 3 else -1), (1 if span.startswith(PREFIXES) else 0)
    joined = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e : e + 1].isalnum())
    context = 1 if FOR[kind].search(before) else -1 if AGAINST.search(before) else 0
    return (1 if SHAPES[kind].fullmatch(span) else -1), checksum, known, (-1 if joined else 1), context


def candidates(text: str) -> Iterator[tuple[str, int, int, bool, tuple[int, ...]]]:
    base = base_spans(text)
    for _, kind, s, e in base:
        yield kind, s, e, True, votes(text, kind, s, e)
    for kind, s, e in more_spans(text, base):
        yield kind, s, e, False, votes(text, kind, s, e)


#: Hashed shapes of a span and its neighbours, and numbers of its characters.
SHAPE_BITS, NUMBERS = 7, 6
_CLASS = np.array([0 if chr(c).isdigit() else 1 if chr(c).isupper() else 2 if chr(c).islower() else 3 if chr(c).isspace() else c + 4 for c in range(128)], np.uint64)


def span_features(left: str, span: str, right: str) -> np.ndarray:
    """Of a span's characters alone: how often its shape's trigrams occur, from three characters before it to three after it, and shares."""
    raw = span.encode("ascii", "replace")
    code = _CLASS[np.frombuffer(left[-3:].encode("ascii", "replace") + raw + right[:3].encode("ascii", "replace"), np.uint8) & 127]
    out = np.zeros((1 << SHAPE_BITS) + NUMBERS)
    if len(code) > 2:
        gram = (code[:-2] * np.uint64(1_000_003) + code[1:-1]) * np.uint64(1_000_003) + code[2:]
        at = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)
        out[: 1 << SHAPE_BITS] = np.log1p(np.bincount(at, minlength=1 << SHAPE_BITS)) / 4
    n = max(1, len(span))
    out[1 << SHAPE_BITS :] = (np.log(n) / 4, _n_digits(span) / n, sum(map(str.isupper, span)) / n, sum(map(str.islower, span)) / n, len(set(span)) / n, _spread(span) / 4 if span.isascii() and span else 0)
    return out


def survey(df: DataFrame, text: str, per_pattern: int) -> tuple["pandas.DataFrame", "pandas.DataFrame"]:  # noqa: F821
    """How often each kind and pattern of votes occurs, over all rows (at most 5 * 3^5), and of each `per_pattern` spans with the smallest hash."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        some: dict[tuple[str, str], list[tuple[int, str, str, str]]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for kind, s, e, _, v in candidates(t or ""):
                    key = kind, ",".join(map(str, v))
                    counts[key] = counts.get(key, 0) + 1
                    own = some.setdefault(key, [])
                    around = t[max(0, s - 3) : s], t[s:e], t[e : e + 3]
                    own.append((xxhash.xxh3_64_intdigest("\0".join(around)) >> 1, *around))
                    if len(own) > 2 * per_pattern:
                        some[key] = sorted(set(own))[:per_pattern]
        rows = [(*key, n, None, None, None, None) for key, n in counts.items()]
        rows += [(*key, 0, *x) for key, own in some.items() for x in sorted(set(own))[:per_pattern]]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], ["kind", "votes", "n", "h", "left", "span", "right"])

    found = written(df.select(text).mapInArrow(patterns, "kind string, votes string, n long, h long, left string, span string, right string"), "votes")
    counts = found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").toPandas()
    # Each task sent a bounded number; parts of a pattern are cut before the pattern is.
    spans = found.where("h is not null").dropDuplicates(["kind", "votes", "h"])
    for keys in (("kind", "votes", F.pmod("h", F.lit(64))), ("kind", "votes")):
        spans = spans.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= per_pattern)
    return counts, spans.orderBy("kind", "votes", "h").toPandas()


def reliabilities(v: np.ndarray, kind: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns v (rows of -1, 0, 1) that occur n times.

    Returns P(vote | truth) by labeler, truth and vote, and each pattern's probability of being personal data. Priors
    are by kind; labelers are taken as independent given the truth, and start as better than chance.
    """
    p = 1 / (1 + np.exp(-v.sum(1).astype(float)))
    table = np.full((v.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        prior = np.array([(1 + (n * p)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])[kind]
        for truth, weight in ((1, n * p), (0, n * (1 - p))):
            for value in (-1, 0, 1):
                table[:, truth, value + 1] = ((v == value) * weight[:, None]).sum(0) + 1
        table /= table.sum(2, keepdims=True)
        like = [np.log(np.take_along_axis(table[:, t, :].T, v + 1, 0)).sum(1) for t in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log(1 - prior) - np.log(prior), -50, 50)))
    return table, p


def encode_votes(v: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Features of the span classifier: for and against by labeler, and the kind."""
    return np.hstack([v == 1, v == -1, np.eye(len(KINDS))[kind]]).astype(float)


def fit_logistic(x: np.ndarray, target: np.ndarray, n: np.ndarray, l2: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Newton's method for soft targets, each row standing for n spans."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (n * (p - target)) + l2 * w)
    return w


@dataclass
class Model:
    table: np.ndarray
    weights: np.ndarray
    least: float = 0.5

    def probability(self, text: str, kind: str, s: int, e: int, v: tuple[int, ...]) -> float:
        x = np.append(encode_votes(np.array([v]), np.array([KINDS.index(kind)]))[0], span_features(text[max(0, s - 3) : s], text[s:e], text[e : e + 3]))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def train(df: DataFrame, text: str = "text", least: float = 0.5, per_pattern: int = 20) -> Model:
    """Reliabilities from the votes on the spans of all rows of df, and the classifier from a bounded sample of spans.

    Of each kind and pattern of votes the `per_pattern` spans with the smallest hash stand for all; their target is the
    pattern's probability.
    """
    got, spans = survey(df, text, per_pattern)
    number = lambda table: (np.array([[int(x) for x in s.split(",")] for s in table.votes], int).reshape(-1, len(LABELERS)), np.array([KINDS.index(k) for k in table.kind], int))
    (v, kind), n = number(got), got.n.to_numpy(float)
    table, p = reliabilities(v, kind, n)
    of = {key: k for k, key in enumerate(zip(got.kind, got.votes, strict=True))}
    own = np.array([of[key] for key in zip(spans.kind, spans.votes, strict=True)], int)
    x = np.array([span_features(*r) for r in zip(spans.left, spans.span, spans.right, strict=True)]).reshape(len(own), (1 << SHAPE_BITS) + NUMBERS)
    x = np.hstack([encode_votes(*number(spans)), x])
    weight = n[own] / np.maximum(np.bincount(own, minlength=len(n))[own], 1)
    # A frequent pattern counts more, but not so much more that a rare one is not seen.
    return Model(table, fit_logistic(x, p[own], np.sqrt(weight)), least)


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def spans_of(model: Model, text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a text, by start, then by kind as in KINDS; offsets are code points."""
    text = text or ""
    kept = [(k, s, e, b) for k, s, e, b, v in candidates(text) if b or model.probability(text, k, s, e, v) >= model.least]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


def finder(model: Model):
    """An Arrow function from texts to their spans, SPAN."""
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in spans_of(model, t)] for t in texts.to_pylist()], kind_of)

    return F.arrow_udf(find, SPAN)


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `spans`, SPAN, to df. A null text has none; rows that repeat have theirs each; an empty table gives no rows.

    Two scans and no shuffle beyond vote patterns and their sampled spans. A column named spans is replaced; others,
    whatever their names, stay. A very long text is searched whole, in one pass for each pattern; of spans of a kind
    that start at the same place the longest holds.
    """
    bound_batches(df.sparkSession)
    return df.withColumn("spans", finder(train(df, text))(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span in the texts of df by its kind in angle brackets; of overlapping spans the first gives the kind.

    A null text stays null; an empty table gives no rows; other columns stay as they are.
    """
    bound_batches(df.sparkSession)
    model = train(df, text)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(redacted, batches)

    def redacted(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if found := spans_of(model, t):
                parts, at = [], 0
                for kind, start, end, _ in found:
                    if start >= at:
                        parts += [t[at:start], f"<{kind.upper()}>"]
                    at = max(at, end)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return df.withColumn(text, F.arrow_udf(run, "string")(F.col(text)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
