"""Toxicity: noisy-channel restoration, then scoring of the restored words.

A character language model (fourth order, all texts) is the source. The channel
writes letters as look-alikes, repeats them, and sets separators between them.
A token with such signs becomes a lattice of readings, of which Viterbi search
over the model's contexts takes the likeliest. Tokens without such signs have
one reading, themselves. Words that mark toxic documents are learnt from a
bounded sample of labelled rows by their log odds, and a logistic regression
over their occurrences in the restored text gives the score.

Cases: tokens of one or two characters are read as they stand; null or empty text has no words and gets the score of a text without
marked words; without any labelled rows, or any toxic ones, the score is 0; rows with
null labels aren't learnt from; several labels of a document count as the
greatest; equal rows give equal scores; an empty table gives an empty table;
input columns named like an output are replaced by it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.common import map_rows, materialise, ship_package

#: Symbols of the character model: 0 between words, 1-26 letters, 27 others.
SYMBOLS = 28

# Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i", "*": "aeiou",
}

_SEPARATORS = frozenset(".-_*~·,'’ \t/")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][ ._*~/-]{1,2}){3,}[^\W_](?!\w)")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_LONG = re.compile(r"([^\W\d_])\1\1")
_INNER = re.compile(r"[^\W\d_][ ._*~·-]+[^\W\d_]")
_RUN = re.compile(r"(.)\1+")
_DOUBLE = re.compile(r"(.)\1", re.IGNORECASE)
#: Signs around words that stand for no letter.
_EDGE = ".,;:?\"')[]{}<>#%&~-_ "
_CLEAN = re.compile(r"([^\W\d_]+)[.,;:?]*")

#: Bytes, about, of tokens that a task remembers before it starts anew.
MEMO = 32 << 20


@lru_cache(1 << 16)
def fold(c: str) -> str:
    """A letter in lower case without marks."""
    return unicodedata.normalize("NFKD", c.lower())[:1]


@lru_cache(1 << 16)
def _symbol(c: str) -> int:
    c = fold(c)
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


_TABLE = np.array([_symbol(chr(i)) for i in range(0x3000)], dtype=np.int32)


def count_grams(texts: list[str | None]) -> np.ndarray:
    """Counts of runs of four symbols."""
    points = np.frombuffer(("\n" + "\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 27)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    c = codes[keep]
    if len(c) < 4:
        return np.zeros(SYMBOLS**4, dtype=np.int64)
    return np.bincount(((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:], minlength=SYMBOLS**4)


class CharModel:
    """Interpolated fourth-order character model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape([SYMBOLS] * 4).astype(np.float64)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(4):
            own = c.sum(axis=tuple(range(3 - order)))
            p = (own + 4 * p) / (own.sum(-1, keepdims=True) + 4)
        self.logp = np.log(p).astype(np.float32)

    def read(self, token: str) -> str:
        """The likeliest words behind a token: letters, and spaces between words."""
        return self.decode(token)[1].strip()

    def decode(self, token: str) -> tuple[float, str]:
        """The log probability and the text of the likeliest reading. Time and
        memory grow with the length of the token."""
        logp = self.logp
        # Context of three symbols -> (log probability, (what was read, the reading before it))
        states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        before = ""
        for c in token:
            f = fold(c)
            readings: list[tuple[float, str]] = []
            if f.isalpha():
                readings.append((0.0, f))
                if f == before:
                    readings.append((-1.0, ""))
            else:
                readings += [(-2.0, x) for x in LOOKALIKES.get(c, "")]
                readings.append((-3.0 if c in _SEPARATORS else -4.0, ""))
                readings.append((-2.5, " "))
            before = f
            new: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for (x, y, z), (p, way) in states.items():
                for cost, out in readings:
                    if not out or (out == " " and z == 0):
                        key, q, t = (x, y, z), p + cost, way
                    else:
                        s = _symbol(out)
                        key, q, t = (y, z, s), p + cost + float(logp[x, y, z, s]), (out, way)
                    if key not in new or q > new[key][0]:
                        new[key] = (q, t)
            states = new
        best, way = max(((p + float(logp[x, y, z, 0]), t) for (x, y, z), (p, t) in states.items()), key=lambda s: s[0])
        text = []
        while way:
            text.append(way[0])
            way = way[1]
        return best, "".join(reversed(text))


def doubtful(token: str) -> bool:
    """Whether a token has signs of disguise: look-alikes, also as its first or
    last sign, threefold letters or separators among its letters."""
    core = token.strip(_EDGE)
    return bool(_LONG.search(core)) or bool(_LETTERS.search(core)) and (bool(_SIGNS.search(core)) or bool(_INNER.search(core)))


class Restorer:
    """Reads tokens through a model, and remembers them."""

    def __init__(self, model: CharModel, known: frozenset[str] = frozenset()):
        self.model, self.known = model, known
        self.bare = {_RUN.sub(r"\1", w) for w in known}
        self.memo: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a token after restoration; only known ones if any are given."""
        m = _CLEAN.fullmatch(token)
        if m and not _DOUBLE.search(m[1]):
            w = m[1].lower()
            if not self.known or w in self.known:
                return (w,)
            if w not in self.bare:
                return ()
        plain = [w.lower() for w in _LETTERS.findall(token)]
        out = list(plain)
        if len(token) > 2 and (doubtful(token) or (self.bare and any(w not in self.known and _RUN.sub(r"\1", w) in self.bare for w in plain))):
            read = self.model.read(token).split()
            if self.known and (squeezed := [w for w in read if w not in self.known]):
                # The model may keep a repeated letter: known words decide.
                read += [k for w in squeezed if (k := self._known(w))]
            out += [w for w in read if w not in out]
        return tuple(w for w in out if w in self.known) if self.known else tuple(out)

    def _known(self, word: str) -> str | None:
        bare = _RUN.sub(r"\1", word)
        return next((k for k in sorted(self.known) if _RUN.sub(r"\1", k) == bare), None) if bare in self.bare else None

    def text(self, text: str | None) -> list[str]:
        """Words of a whole text, spelt-out ones included."""
        tokens, memo = (text or "").split(), self.memo
        tokens += [m[0] for m in _SPACED.finditer(text or "")]
        new = set(tokens).difference(memo)
        if self.held > MEMO:
            memo.clear()
            self.held, new = 0, set(tokens)
        self.held += sum(map(len, new)) + 160 * len(new)
        for t in new:
            memo[t] = self.words(t)
        out: list[str] = []
        for found in map(memo.__getitem__, tokens):
            if found:
                out += found
        return out


def restore(text: str | None, model: CharModel) -> str:
    """The text with each doubtful token replaced by its likeliest reading; one
    that reads as its plain word keeps the signs around it."""

    def one(m: re.Match) -> str:
        if not doubtful(m[0]) or len(m[0]) <= 2:
            return m[0]
        read = model.read(m[0])
        return m[0] if read == "".join(map(fold, m[0].strip(_EDGE + "(*!$"))) else read

    return re.sub(r"\S+", one, _SPACED.sub(lambda m: model.read(m[0]), text or ""))


def learn_characters(df: DataFrame, text: str = "text") -> CharModel:
    """The character model of all texts. At most SYMBOLS ** 4 counts, whatever
    the input, come to the driver."""
    ship_package(df.sparkSession)

    def run(batches):
        total = np.zeros(SYMBOLS**4, dtype=np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                total += count_grams(b.slice(i, 512).column(0).to_pylist())
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    found = df.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**4, dtype=np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return CharModel(counts)


class Scorer:
    """Marked words with weights, and a logistic regression over them."""

    def __init__(self, weights: dict[str, float], prior: float = 0.0):
        self.weights, self.prior = weights, prior
        self.coef: np.ndarray | None = None

    def features(self, words: list[str]) -> tuple[float, float, float]:
        own = [w for w in words if w in self.weights]
        each = set(own)
        return float(bool(each)), min(3.0, sum(self.weights[w] for w in each) / 4), math.log1p(len(own))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(4)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (y - p) - 0.1 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.coef = w

    def score(self, words: list[str]) -> float:
        if self.coef is None:
            return self.prior
        return 1 / (1 + math.exp(-float(np.clip(self.coef[0] + np.dot(self.coef[1:], self.features(words)), -30, 30))))


def learn(df: DataFrame, labels: DataFrame, usable: Column, model: CharModel, text: str = "text", key: str = "doc_id", label: str = "toxic", train_rows: int = 6_000, most_words: int = 500, least: int = 10) -> Scorer:
    """A scorer from ``train_rows`` labelled rows at most, the first by a hash
    of their ids; ``usable`` is a condition on ``labels``. Marked words have
    ``least`` different pairs of neighbours in toxic documents; ``most_words`` of
    them are kept."""
    spark = df.sparkSession
    drawn = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("k"), "k").limit(train_rows)
    shared = spark.sparkContext.broadcast(model)  # SYMBOLS ** 4 numbers

    def work():
        restorer = Restorer(shared.value)

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            words = [restorer.text(t) for t in b.column("t").to_pylist()]
            around = [[f"{p} {q}" for p, q in zip(["", *w], [*w[1:], ""], strict=False)] for w in words]
            return [pa.array(words, pa.list_(pa.string())), pa.array(around, pa.list_(pa.string()))]

        return step

    # At most train_rows pairs of numbers are broadcast.
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(drawn), "k")
    strings = T.ArrayType(T.StringType())
    words = materialise(map_rows(rows, ["k", "y", "t"], [T.StructField("words", strings), T.StructField("around", strings)], work, 256).drop("t"))
    n = {r[0]: r[1] for r in words.groupBy("y").count().collect()}
    toxic, clean = sum(c for y, c in n.items() if y), n.get(0, 0)
    if not toxic or not clean:
        return Scorer({}, 0.0)
    # A word counts once for each pair of neighbours, so copies of a document count once.
    each = words.select("y", F.explode(F.arrays_zip("words", "around")).alias("s")).select("y", F.col("s.words").alias("w"), F.xxhash64("s.around").alias("c"))
    each = each.groupBy("w", "c").agg(F.max("y").alias("y")).groupBy("w").agg(F.sum((F.col("y") > 0).cast("long")).alias("a"), F.sum((F.col("y") == 0).cast("long")).alias("b"))
    each = materialise(each)
    total = each.agg(F.sum("a"), F.sum("b")).first()
    odds = F.log((F.col("a") + 0.5) / (total[0] + 1)) - F.log((F.col("b") + 0.5) / (total[1] + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = each.where(f"a >= {least}").select("w", odds.alias("odds"), z.alias("z")).where("z > 4 and odds > 1.5").orderBy(F.desc("z"), "w").limit(most_words).collect()
    scorer = Scorer({r["w"]: float(r["odds"]) for r in top})
    marked = list(scorer.weights)
    own = words.select("y", F.filter("words", lambda w: w.isin(marked) if marked else F.lit(False)).alias("own")).collect()  # train_rows at most
    scorer.fit(np.array([scorer.features(r["own"]) for r in own]), np.array([float(r["y"] > 0) for r in own]))
    return scorer


def score(df: DataFrame, model: CharModel, scorer: Scorer, text: str = "text", keep: list[str] | None = None, restored: bool = False) -> DataFrame:
    """``keep`` columns (all by default), ``score`` and ``marked``, the marked
    words found; with ``restored`` also the restored text."""
    keep = [c for c in keep or df.columns if c not in ("score", "marked", "restored")]
    shared = df.sparkSession.sparkContext.broadcast((model, scorer))

    def work():
        model, scorer = shared.value
        known = frozenset(scorer.weights)
        restorer = Restorer(model, known or frozenset([""]))

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            texts = b.column(text).to_pylist()
            words = [restorer.text(t) for t in texts]
            out = [pa.array([scorer.score(w) for w in words], pa.float64()), pa.array([list(dict.fromkeys(w)) for w in words], pa.list_(pa.string()))]
            return [*out, pa.array([restore(t, model) for t in texts], pa.string())] if restored else out

        return step

    added = [T.StructField("score", T.DoubleType()), T.StructField("marked", T.ArrayType(T.StringType()))] + [T.StructField("restored", T.StringType())] * restored
    named = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    found = map_rows(named, named.columns, added, work, 512)
    return found.select(*[F.col(f"`{c}`") for c in keep], *[f.name for f in added])


