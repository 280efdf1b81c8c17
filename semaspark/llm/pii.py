"""Personal data: labelers vote, expectation-maximisation weighs them.

Base spans match the fixed patterns and always stay. Looser patterns propose
further candidates. Every span is voted on by a structural labeler (regular
expressions and checksums), a gazetteer labeler (domains, card issuers, special
address ranges, area codes) and a context labeler (cue words before the span).
The votes are counted over all spans of all documents; on these counts EM
estimates each labeler's reliability per kind without labels, and its
posteriors train a logistic span classifier of each kind over votes and shape.
Candidates that the classifier accepts are added.

Cases: addresses may have leading zeros; null or empty text has no spans; overlapping kinds are all kept; a
candidate that overlaps a base span of its kind is dropped; a table without
candidates adds nothing; equal rows give equal spans; other columns are kept
unless named like an output. Texts of any length are scanned once from left to
right.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.common import ROW, carried, carry, map_rows, materialise

KINDS = ("email", "ip", "card", "phone")

# The patterns of base spans.
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL_LEFT_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MORE_EMAIL = re.compile(r"(?i)\b[a-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}(?:\s?[\[(]\s?dot\s?[\])]\s?[a-z0-9-]{1,63})+")
_MORE_IP = re.compile(r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])")
_MORE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

# Gazetteers and cue words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr es it nl eu us ca au jp cn in br ch se no pl".split())
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "2221", "2720")
CUES = {
    "email": frozenset("email mail e-mail contact write reach address courriel correo".split()),
    "ip": frozenset("ip host server address from client peer addr".split()),
    "card": frozenset("card credit visa mastercard debit pan karte carte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon téléphone teléfono".split()),
}
COUNTER_CUES = frozenset("version isbn order invoice id no number page section ticket ref release".split())

CANDIDATE = T.StructType([
    T.StructField("kind", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()),
    T.StructField("feature", T.IntegerType()),
])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind, leftmost and non-overlapping."""
    emails: list[tuple[int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _EMAIL_RIGHT.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _EMAIL_LEFT_CHARS:
                start -= 1
            if start < at:
                emails.append((start, m.end()))
                end = m.end()
                at = text.find("@", end)
                continue
        at = text.find("@", at + 1)
    ips, cards, phones = [], [], []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            ips.append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                phones.append(m.span())
    return [emails, ips, cards, phones]


def _more(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the looser patterns by kind."""
    emails = [m.span() for m in _MORE_EMAIL.finditer(text)] if "at" in text and ("[" in text or "(" in text) else []
    ips = [m.span() for m in _MORE_IP.finditer(text)] if text.count(":") >= 7 else []
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                cards.append(m.span())
    return [emails, ips, cards, [m.span() for m in _MORE_PHONE.finditer(text)]]


#: Votes: 0 against, 1 for, 2 abstains.
def _votes(kind: int, base: bool, span: str, before: str) -> tuple[int, int, int]:
    digits = "".join(c for c in span if c.isdigit())
    name = KINDS[kind]
    if name == "email":
        structure = 1 if base or "at" in span else 0
        place = 1 if re.split(r"[.\s\])]+", span.lower())[-1] in TOP_DOMAINS else 0
    elif name == "ip":
        structure = 1
        first = int(span.split(".")[0].lstrip("0") or "0") if base else 0
        place = 2 if not base else 0 if first in (0, 127) or first >= 224 else 1
    elif name == "card":
        structure = int(luhn(digits))
        place = int(digits.startswith(CARD_ISSUERS))
    else:
        structure = 1 if base else 2
        area = digits[-10:-7]
        place = 2 if len(area) < 3 else 0 if area[0] in "01" or area[1:] == "11" else 1
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", before.lower()))
    context = 1 if words & CUES[name] else 0 if words & COUNTER_CUES else 2
    return structure, place, context


def _feature(kind: int, votes: tuple[int, int, int], length: int) -> int:
    """One number for kind, votes and length class."""
    size = min(3, length // 8)
    return ((kind * 27 + votes[0] * 9 + votes[1] * 3 + votes[2]) << 2) | size


def candidates(text: str | None) -> list[dict]:
    """Base spans and further candidates, by kind and then start."""
    out: list[dict] = []
    if not text:
        return out
    for kind, (base, more) in enumerate(zip(base_spans(text), _more(text), strict=True)):
        spans = [(s, e, True) for s, e in base]
        i = 0
        for s, e in more:
            while i < len(base) and base[i][1] <= s:
                i += 1
            if i == len(base) or base[i][0] >= e:
                spans.append((s, e, False))
        for s, e, own in sorted(spans):
            votes = _votes(kind, own, text[s:e], text[max(0, s - 40) : s])
            out.append({"kind": kind, "start": s, "end": e, "base": own, "feature": _feature(kind, votes, e - s)})
    return out


def weigh(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Probability of each feature by EM and the classifier that it trains.

    ``counts``: spans by feature; at most 432 entries, whatever the input.
    """
    if not counts:
        return {}
    feats = np.array(sorted(counts))
    n = np.array([counts[f] for f in feats], dtype=float)
    code = feats >> 2
    kind, votes = code // 27, np.stack([code // 9 % 3, code // 3 % 3, code % 3], 1)
    post = np.clip(0.5 + 0.25 * ((votes == 1).sum(1) - (votes == 0).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        total = np.zeros_like(post)
        like = np.zeros((2, len(feats)))
        for k in range(len(KINDS)):
            m = kind == k
            prior = (n[m] @ post[m] + 1) / (n[m].sum() + 2)
            like[0, m], like[1, m] = np.log(1 - prior), np.log(prior)
            for j in range(3):
                for y, w in ((0, 1 - post), (1, post)):
                    # A weak prior says that labelers are right more often than not.
                    c = np.array([4.0, 1.0, 2.5]) if y == 0 else np.array([1.0, 4.0, 2.5])
                    for v in range(3):
                        c[v] += (n * w)[m & (votes[:, j] == v)].sum()
                    like[y, m] += np.log(c / c.sum())[votes[m, j]]
        total = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
        if np.abs(total - post).max() < 1e-6:
            break
        post = total
    # A classifier of each kind: what a kind lacks it doesn't take from others.
    out: dict[int, float] = {}
    for k in range(len(KINDS)):
        m = kind == k
        if m.any():
            p = _classify(votes[m], feats[m] & 3, n[m], post[m])
            out |= {int(f): float(v) for f, v in zip(feats[m], p, strict=True)}
    return out


def _classify(votes: np.ndarray, size: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression on soft labels."""
    cols = [np.ones(len(n))] + [(votes[:, j] == v).astype(float) for j in range(3) for v in range(2)] + [(size == s).astype(float) for s in range(4)]
    x, w = np.stack(cols, 1), np.zeros(len(cols))
    weight = n / n.sum()
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (post - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (all by default) and ``pii``, an array of structs
    (kind, start, end in code points, base, score), by kind and then start."""
    keep = [c for c in keep or df.columns if c != "pii"]

    def work():
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("feature", pa.int32())]))
        return lambda b: [pa.array([candidates(t) for t in b.column("text").to_pylist()], kind)]

    named = df.select(carry(df, keep), df[f"`{text}`"].alias("text"))
    found = map_rows(named, named.columns, [T.StructField("candidates", T.ArrayType(CANDIDATE))], work, 2048)
    # Texts aren't needed again unless they are kept.
    found = materialise(found.select(ROW, "candidates"))
    each = found.select(F.explode("candidates.feature").alias("feature")).groupBy("feature").count()
    scores = weigh({r[0]: r[1] for r in each.collect()})  # at most 432 rows
    table = F.array(*[F.lit(scores.get(i, 0.0)) for i in range(len(KINDS) * 27 * 4)])
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.filter("candidates", lambda c: c["base"] | (F.element_at(table, c["feature"] + 1) >= threshold)),
        lambda c: F.struct(F.element_at(names, c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), F.element_at(table, c["feature"] + 1).alias("score")),
    )
    return found.select(*carried(keep), spans.alias("pii"))
