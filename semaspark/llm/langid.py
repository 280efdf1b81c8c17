"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is
parsed greedily into the longest phrases that occur in that language's text;
the number of phrases, times the bits to point at one, over the number of
characters, estimates the cross entropy of the text and the language. The
language that needs fewest bits wins.

The labelled text is a bounded sample: about ``train_docs`` documents of each
language by a hash of their ids, of each document ``4 * train_chars / train_docs``
characters in a row at most, from a place that the hash gives, and at most
``train_chars`` characters of each language in all (fewer beyond ten languages,
600,000 of all together). All letters of that text are told apart, in any number of
scripts; a letter that a language's text lacks ends a phrase in it. Whole
texts are identified, in lanes of ``LANE`` characters that are parsed side by side; a phrase also ends where its lane does.

Cases: a text that is null or has no letter is ``und`` with score 0; languages
with equal cost go to the first by name; a table without labelled rows gives
``und`` throughout; rows with null labels or ids aren't learnt from; equal rows
give equal results; an empty table gives an empty table; input columns named
like an output are replaced by it.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.common import carried, carry, map_rows, materialise

LANE = 256
#: Phrases that a text has free, and how far above naming each symbol a text of
#: an unknown language lies.
FREE, ABOVE = 4, 1.25
#: Entries of a table state x symbol; automata with more are kept sparse.
DENSE = 8_000_000


def _states(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``text``."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix automaton of ``text`` as a table state x symbol. An entry is the
    next state times two; where the phrase can't be continued it leads to the
    state of the symbol alone, plus one to count the new phrase."""
    return _dense(_states(text), symbols)


def _dense(nxt: list[dict[int, int]], symbols: int) -> np.ndarray:
    start = np.zeros(symbols, dtype=np.int32)
    for c, q in nxt[0].items():
        start[c] = q
    table = np.tile(start * 2 + 1, (len(nxt), 1)).astype(np.int32)
    for p, out in enumerate(nxt):
        for c, q in out.items():
            table[p, c] = q * 2
    return table


class Automaton:
    """A suffix automaton over the symbols of its own text, as a table while
    that has ``DENSE`` entries at most, or else as sorted transitions, of which
    there are three to a symbol of the text at most."""

    def __init__(self, text: np.ndarray, symbols: int):
        nxt, own = _states(text), np.unique(text)
        # Symbols that the text lacks share the last number.
        self.of = np.full(symbols, len(own), dtype=np.int32)
        self.of[own] = np.arange(len(own))
        self.symbols = len(own) + 1
        nxt = [{int(self.of[c]): q for c, q in out.items()} for out in nxt]
        self.table: np.ndarray | None = None
        if len(nxt) * self.symbols <= DENSE:
            self.table = _dense(nxt, self.symbols).reshape(-1)
            return
        self.start = np.zeros(self.symbols, dtype=np.int32)
        for c, q in nxt[0].items():
            self.start[c] = q
        keys = [(p * self.symbols + c, q) for p, out in enumerate(nxt) for c, q in sorted(out.items())]
        self.keys = np.array([k for k, _ in keys], dtype=np.int64)
        self.to = np.array([q for _, q in keys], dtype=np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Entries, as of ``automaton``, for states and symbols of ``of``."""
        if self.table is not None:
            return self.table[state * self.symbols + code]
        key = state.astype(np.int64) * self.symbols + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at] * 2, self.start[code] * 2 + 1)


class Model:
    """Automata of some languages over the letters of all."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        seen: dict[str, int] = {}
        for t in texts.values():
            for c in t.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.symbols = len(letters) + 2  # the last: letters that aren't in any labelled text
        self.tables: list[Automaton] = []
        self.bits: list[float] = []
        for lang in self.langs:
            codes, _ = self.encode([texts[lang]])
            self.tables.append(Automaton(codes, self.symbols))
            self.bits.append(math.log2(max(2, len(codes))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each begun by a 0, and the number of each."""
        look, letter = _lookup(tuple(self.code.items()), self.symbols - 1)
        joined = "\n" + "\n".join((t or "").replace("\n", " ") for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = look[points]
        head = points == 10
        odd = codes == 0
        keep = head.copy()
        keep[1:] |= ~(odd[1:] & odd[:-1])
        keep[0] = True
        codes, head = codes[keep], head[keep]
        starts = np.flatnonzero(head)
        return codes, np.diff(starts, append=len(codes))

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text and language, and letters-and-gaps of each text."""
        codes, sizes = self.encode(texts)
        starts = np.cumsum(sizes) - sizes
        lanes = np.maximum(1, -(-sizes // LANE))
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = starts[owner] + nth * LANE
        left = np.minimum(LANE, sizes[owner] - nth * LANE)
        order = np.argsort(-left, kind="stable")  # so that the lanes still open come first
        at, left = at[order], left[order]
        out = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            state, own = np.zeros(len(at), dtype=np.int32), table.of[codes]
            count = np.ones(len(at), dtype=np.int64)
            open_ = len(at)
            for j in range(LANE):
                while open_ and left[open_ - 1] <= j:
                    open_ = int(np.searchsorted(-left, -j, side="left"))
                if not open_:
                    break
                got = table.step(state[:open_], own[at[:open_] + j])
                count[:open_] += got & 1
                state[:open_] = got >> 1
            out[:, k] = np.bincount(owner[order], weights=count, minlength=len(texts))
        return out, sizes

    @property
    def plain(self) -> float:
        """Bits that a symbol takes where each is named by itself."""
        return math.log2(max(2, self.symbols))

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, a score and the bits for each symbol of each text."""
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        count, sizes = self.phrases(texts)
        cost = count * np.array(self.bits)
        best = cost.argmin(1)
        # Bits above the best language's, tempered, as a softmax.
        gap = (cost - cost.min(1, keepdims=True)) * 0.1
        score = 1 / np.exp(-np.minimum(gap, 50)).sum(1)
        codes, _ = self.encode(texts)
        starts = np.cumsum(sizes) - sizes
        has = np.add.reduceat((codes > 0).astype(np.int64), starts) > 0
        langs = [self.langs[i] if h else "und" for i, h in zip(best, has, strict=True)]
        # Beyond FREE phrases, a symbol of the text costs so many bits in the best language.
        rate = (cost.min(1) - FREE * np.array(self.bits)[best]) / np.maximum(sizes, 1)
        return langs, np.where(has, score, 0.0), rate


@lru_cache(maxsize=4)
def _lookup(codes: tuple[tuple[str, int], ...], other: int) -> tuple[np.ndarray, None]:
    """Symbol of every code point, in lower case."""
    of = dict(codes)
    out = np.zeros(sys.maxunicode + 1, dtype=np.int32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            out[i] = of.get(c.lower(), other)
    return out, None


def learn(df: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = 96, train_chars: int = 60_000) -> Model:
    """A model of the rows for which ``usable`` holds, from a bounded sample."""
    rows = df.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = materialise(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")))
    if counts.count() <= 100_000:  # labels, as counted
        counts = F.broadcast(counts)
    place = F.xxhash64("k").bitwiseAND((1 << 30) - 1)
    drawn = rows.join(counts, "l").where(place < F.ceil(F.least(F.lit(1.0), F.lit(train_docs) / F.col("n")) * (1 << 30)))
    span = 4 * train_chars // train_docs + 1
    at = F.pmod(F.xxhash64("k", F.lit(7)), F.greatest(F.length("t") - span + 1, F.lit(1))) + 1
    texts: dict[str, list[str]] = {}
    # About train_docs rows for each language come to the driver.
    for name, t in drawn.select("l", F.substring("t", at.cast("int"), F.lit(span)).alias("t"), F.xxhash64("k").alias("h")).orderBy("l", "h", "t").select("l", "t").collect():
        texts.setdefault(name, []).append(t)
    each = max(2_000, min(train_chars, 600_000 // max(1, len(texts))))
    return Model({k: "\n".join(dict.fromkeys(v))[:each] for k, v in texts.items()})


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), ``lang_pred``, ``score`` and
    ``known``: whether the text has letters and its phrases, but for ``FREE`` of
    them, take less than ``ABOVE`` times the bits of its symbols one by one.
    Texts of the languages learnt take about half; in other scripts each letter
    is a phrase."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())]
    keep = [c for c in keep or df.columns if c not in [f.name for f in added]]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by learn()

    def work():
        def step(b: pa.RecordBatch) -> list[pa.Array]:
            langs, score, rate = shared.value.identify(b.column("text").to_pylist())
            known = [x != "und" and r < ABOVE * shared.value.plain for x, r in zip(langs, rate, strict=True)]
            return [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())]

        return step

    named = df.select(carry(df, keep), df[f"`{text}`"].alias("text"))
    return map_rows(named, named.columns, added, work, 1024).select(*carried(keep), *[f.name for f in added])
