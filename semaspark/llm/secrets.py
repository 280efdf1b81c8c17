"""Secrets: fixed patterns and a battery of randomness tests.

Base spans match the fixed patterns and always stay. Any further run of 20 or
more key characters is a candidate. Its encoding is inferred from its
characters, which become numbers of that alphabet; a chi-squared test of
uniformity, a runs test about the middle and a lag-1 serial correlation test
are combined by Fisher's method. How far ordinary text of that length and
alphabet looks random is not assumed but measured: all texts, cut into windows
of each length class, take the same tests, and the share of windows that look
as random is the candidate's p-value. The rest of a text gives the windows that
fit, and what is left of the texts of a batch is joined and cut likewise, so all
but under 20 letters and digits of a batch count. A class without windows takes
the p-values of the next shorter class, in which chance makes more text look
random, and 1 if that has none either. Benjamini-Hochberg over all candidates of
the corpus, with these p-values by length class and alphabet, keeps the rate of
false discoveries below ``rate``.

Cases: null or empty text has no spans; a candidate that overlaps a base span
is dropped; an empty table gives an empty table; equal rows give equal spans;
other columns are kept unless named like an output.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.common import carried, carry, map_rows, materialise, tidy

KINDS = ("assign", "access", "hex", "random")

# The patterns of base spans.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: Alphabets that a run may be written in, from the narrowest.
ALPHABETS = (
    "0123456789",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
)
#: Length classes by their least length; text windows have that length.
LENGTHS = (20, 24, 32, 40, 64)
#: Bins of Fisher's statistic, of half a unit each.
BINS = 240
CELLS = len(ALPHABETS) * len(LENGTHS) * BINS
_SETS = [frozenset(a) for a in ALPHABETS]
_CODE = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
_K = np.array([10, 16, 32, 36, 64])
_ODD = re.compile(r"[^A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, 0) of the fixed patterns."""
    out = [(m.start(), 0, m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), 0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), 0) for m in _HEX.finditer(text)]
    return sorted(out)


def _log_tail(z: np.ndarray) -> np.ndarray:
    """Natural log of the two-sided normal tail at |z|, by its bounds."""
    z = np.abs(z)
    return np.log(np.clip(np.vectorize(math.erfc, otypes=[float])(np.minimum(z, 25) / math.sqrt(2)), 1e-130, 1))


_TAIL = _log_tail(np.arange(0, 25.01, 0.05))


def _log_p(z: np.ndarray) -> np.ndarray:
    return _TAIL[np.minimum((np.abs(z) * 20).astype(np.int32), len(_TAIL) - 1)]


def _log_p_upper(z: np.ndarray) -> np.ndarray:
    """Log of the upper tail: only too uneven counts against randomness."""
    return np.where(z > 0, _log_p(z) - math.log(2), math.log(0.5))


def battery(codes: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Fisher's statistic of each row of ``codes``, numbers below ``k``; large
    values are unlike random ones."""
    n, size = codes.shape
    k = np.broadcast_to(np.asarray(k), (n,))[:, None]
    x = codes.astype(np.float32)
    bins = (codes * 8) // k
    seen = np.stack([(bins == b).sum(1) for b in range(8)], 1)
    width = np.stack([np.minimum(((b + 1) * k[:, 0] + 7) // 8, k[:, 0]) - (b * k[:, 0] + 7) // 8 for b in range(8)], 1) / k
    want = size * width
    chi = np.where(want > 0, (seen - want) ** 2 / np.maximum(want, 1e-9), 0).sum(1)
    z1 = ((chi / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63)  # Wilson-Hilferty, 7 degrees
    high = codes * 2 >= k
    h = high.sum(1)
    runs = (high[:, 1:] != high[:, :-1]).sum(1) + 1
    pq = 2.0 * h * (size - h)
    mean = pq / size + 1
    var = np.maximum(pq * (pq - size) / (size * size * (size - 1.0)), 1e-9)
    z2 = np.where(pq > size, (runs - mean) / np.sqrt(var), 25.0)
    d = x - x.mean(1, keepdims=True)
    v = (d * d).sum(1)
    r = (d[:, 1:] * d[:, :-1]).sum(1) / np.maximum(v, 1e-9)
    z3 = np.where(v > 0, (r + 1 / size) * math.sqrt(size), 25.0)
    return -2 * (_log_p_upper(z1) + _log_p(z2) + _log_p(z3))


def _alphabet(run: str) -> int:
    chars = set(run)
    return next((i for i, s in enumerate(_SETS) if chars <= s), len(ALPHABETS) - 1)


def _cell(alphabet: int, length: int, stat: float) -> int:
    size = max(i for i, n in enumerate(LENGTHS) if n <= length)
    return (alphabet * len(LENGTHS) + size) * BINS + min(BINS - 1, int(stat * 2))


def spans(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, cell) of base spans and candidates in order; cell is
    the place of a candidate's statistic in the histograms, 0 for base spans."""
    if not text:
        return []
    base = base_spans(text)
    out, i = list(base), 0
    reach = 0  # the furthest end of the base spans before i
    for m in _RUN.finditer(text):
        s, e = m.span()
        while i < len(base) and base[i][0] < e:
            reach = max(reach, base[i][2])
            i += 1
        run = m[0].rstrip("=")
        if reach > s or len(set(run)) < 2:
            continue
        a = _alphabet(run)
        codes = np.array([[_CODE[a].get(c, 63) for c in run]])
        out.append((s, 3, e, _cell(a, len(run), float(battery(np.minimum(codes, _K[a] - 1), int(_K[a]))[0]))))
    return sorted(out)


_LETTER = np.full(256, 255, dtype=np.uint8)
for _i, _c in enumerate(ALPHABETS[4][:62]):
    _LETTER[ord(_c)] = _i


def text_windows(texts: list[str | None]) -> np.ndarray:
    """Counts of text windows by cell. Each text, without all but letters and
    digits, is cut into windows of the length classes in turn, as long as they
    fit; what is left of all texts is joined and cut again, the last of it into
    the longest classes that fit. Each window is tested under each alphabet,
    into which its characters are folded."""
    counts = np.zeros(CELLS, dtype=np.int64)
    block = sum(LENGTHS)
    cut: list[list[np.ndarray]] = [[] for _ in LENGTHS]

    def take(codes: np.ndarray) -> np.ndarray:
        n, at = len(codes) // block, 0
        whole, codes = codes[: n * block].reshape(n, block), codes[n * block :]
        for own, length, end in zip(cut, LENGTHS, np.cumsum(LENGTHS).tolist(), strict=True):
            if n:
                own.append(whole[:, end - length : end])
            if at == end - length and len(codes) >= end:
                own.append(codes[None, at:end])
                at = end
        return codes[at:]

    left = [np.zeros(0, dtype=np.uint8)]
    for t in texts:
        raw = np.frombuffer((t or "").encode("latin-1", "ignore"), dtype=np.uint8)
        codes = _LETTER[raw]
        left.append(take(codes[codes < 255]))
    last = take(np.concatenate(left))
    while len(last) >= LENGTHS[0]:
        size = max(i for i, n in enumerate(LENGTHS) if n <= len(last))
        cut[size].append(last[None, : LENGTHS[size]])
        last = last[LENGTHS[size] :]
    for size, rows in enumerate(cut):
        if not rows:
            continue
        own = np.concatenate(rows).astype(np.int16)
        lower = np.where(own < 26, own, np.where(own < 52, own - 26, own - 26))
        for a, k in enumerate(_K):
            folded = own if a == 4 else lower % k
            stat = np.minimum((battery(folded, int(k)) * 2).astype(np.int64), BINS - 1)
            counts += np.bincount((a * len(LENGTHS) + size) * BINS + stat, minlength=CELLS)
    return counts


def accepted(null: np.ndarray, found: dict[int, int], rate: float) -> list[int]:
    """Cells whose candidates are discoveries at that false-discovery rate."""
    if not found:
        return []
    upto = np.cumsum(null.reshape(-1, BINS), 1)
    for row in range(len(upto)):
        if row % len(LENGTHS) and not upto[row, -1]:
            upto[row] = upto[row - 1]  # the next shorter class of the alphabet
    p = ((upto + 1) / (upto[:, -1:] + 1)).reshape(-1)
    cells = sorted(found, key=lambda c: p[c])
    total, seen, last = sum(found.values()), 0, 0
    for i, c in enumerate(cells):
        seen += found[c]
        if p[c] <= rate * seen / total:
            last = i + 1
    return sorted(cells[:last])


SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "kind", "end", "cell")])


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, rate: float = 0.05) -> DataFrame:
    """``keep`` columns (all by default) and ``secrets``, an array of structs
    (start, end in code points, kind, base) by start and then kind as listed."""
    keep = [c for c in keep or df.columns if c != "secrets"]

    def work():
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in SPAN.names]))

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            texts = b.column("text").to_pylist()
            each = [[dict(zip(SPAN.names, s, strict=True)) for s in spans(t)] for t in texts]
            # The batch's window counts ride on its first row.
            counts = text_windows(texts)
            return [pa.array(each, kind), pa.array([counts, *[None] * (len(texts) - 1)], pa.list_(pa.int64()))]

        return step

    added = [T.StructField("found_spans", T.ArrayType(SPAN)), T.StructField("window_counts", T.ArrayType(T.LongType()))]
    named = df.select(carry(df, keep), df[f"`{text}`"].alias("text"))
    found = materialise(map_rows(named, named.columns, added, work, 1024).drop("text"))
    # Both tables have at most CELLS rows, whatever the input.
    windows = found.where("window_counts is not null").select(F.posexplode("window_counts").alias("cell", "n")).where("n > 0").groupBy("cell").agg(F.sum("n"))
    null = np.zeros(CELLS, dtype=np.int64)
    for c, n in windows.collect():
        null[c] = n
    seen = found.select(F.explode(F.filter("found_spans", lambda s: s["kind"] == 3)).alias("s")).groupBy("s.cell").count()
    good = accepted(null, {r[0]: r[1] for r in seen.collect()}, rate)
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter("found_spans", lambda s: (s["kind"] < 3) | (s["cell"].isin(good) if good else F.lit(False)))
    out = F.transform(kept, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < 3).alias("base")))
    return found.select(*carried(keep), out.alias("secrets"))


MASK = "<SECRET>"


def mask(text: str | None, found: list[dict] | None) -> str | None:
    """The text with MASK for each span, or run of overlapping spans."""
    if not text or not found:
        return text
    out, at, end = [], 0, -1
    for s in sorted(found, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= end:
            out += [text[at : s["start"]], MASK]
        end = at = max(end, s["end"])
    return "".join([*out, text[at:]])


@tidy
def redact(df: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """The columns of ``df``, with each secret of the text masked."""
    rest = [c for c in df.columns if c != text]
    own = df.select(F.struct(F.lit(0).alias("none"), *[df[f"`{c}`"].alias(c) for c in rest]).alias("own"), df[f"`{text}`"].alias("text"))
    found = find(own, rate=rate)

    def work():
        return lambda b: [pa.array([mask(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("secrets").to_pylist(), strict=True)], pa.string())]

    masked = map_rows(found, found.columns, [T.StructField("masked", T.StringType())], work, 1024)
    return masked.select(*[F.col("masked").alias(text) if c == text else F.col("own")[c].alias(c) for c in df.columns])
