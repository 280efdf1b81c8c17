"""Jaccard self-join of documents on word n-grams, by chosen paths.

Texts with equal n-gram sets are one class from the start. Each class is
embedded as ``TOKENS`` min-hash tokens. In each of several runs a class follows
random paths: at a node it takes each of its tokens with probability
1 / (threshold' * TOKENS) under a hash of the node, and goes on to the child
named by node and token; alike classes share tokens and so paths. Nodes with
few members are compared by brute force on the tokens; larger ones are split
on, and where nothing more separates their members, compared in tiles of
bounded size. ``runs`` says how many runs find a pair at the threshold with the
recall asked for (0.995). Pairs whose tokens agree enough only tell which classes
may be linked at all (a spanning forest, not the pairs); within each connected
set of these, all pairs are verified exactly on the n-gram sets, again in tiles.

Cases: null text, and text without words, links with nothing; a text of fewer
than ``n`` words has one n-gram, all its words; repeated rows are links of each
other; a key that several texts share is no bond between them, each row is
judged by its own text; rows with null keys take part, and a class of such rows
alone has a null key; other columns don't matter. Words are runs of letters,
digits and underscores in lower case.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.common import ROW, carried, carry, components, forest, map_groups, map_rows, materialise, tidy, tiles

TOKENS = 64
#: Expected children of a node: threshold' = 1 / BRANCH = 0.65.
BRANCH = 1.54
#: Members of a node that are compared without a further split.
SMALL = 200
#: Members of a chunk of a tile, of tokens and of n-gram sets.
TOKEN_CHUNK = 512
CHUNK = 256
#: N-grams that the sets of a chunk hold, about, where texts are long.
CHUNK_GRAMS = 500_000
#: Levels of a path before its nodes are counted.
LEVELS = 2
#: Further levels, at which large nodes are split, with their expected children.
SPLITS = 1
SPLIT_BRANCH = 1.25

#: Bytes, about, of words that a task remembers before it starts anew.
MEMO = 24 << 20

_WORD = re.compile(r"\w+")
_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def runs(threshold: float, recall: float) -> int:
    """Runs that find a pair at the threshold with that recall: a path of such a
    pair goes on to a common child for each token it follows and both share, and
    all levels must be passed, the further splits included."""
    passed = 1.0
    for branch in [SPLIT_BRANCH] * SPLITS + [BRANCH] * LEVELS:
        passed = 1 - math.exp(-threshold * branch * passed)
    return math.ceil(math.log(1 - recall) / math.log(1 - passed))


class Shingler:
    """N-gram sets of texts as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.memo, self.held = n, {}, 0
        self.odd = [_U(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(n)]

    def _hash(self, words: list[str]) -> np.ndarray:
        import xxhash

        memo, digest = self.memo, xxhash.xxh64_intdigest
        if self.held > MEMO:
            memo.clear()
            self.held = 0
        for w in set(words).difference(memo):
            memo[w] = digest(w)
            self.held += 160 + len(w)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = self._hash(words)
        if len(h) < self.n:
            return mix(np.array([sum(int(x) * int(o) for x, o in zip(h, self.odd, strict=False)) + len(h) & (1 << 64) - 1], dtype=np.uint64))
        total = np.zeros(len(h) - self.n + 1, dtype=np.uint64)
        for i, o in enumerate(self.odd):
            total += h[i : i + len(total)] * o
        return np.unique(mix(total))


_SEED = mix(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_A, _B = _SEED[:TOKENS] | _U(1), _SEED[TOKENS:]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens of non-empty sets, 16 bits each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), TOKENS), dtype=np.uint16)
    for i in range(TOKENS):
        low = np.minimum.reduceat(flat * _A[i] + _B[i], starts)
        out[:, i] = (mix(low) >> _U(48)).astype(np.uint16)
    return out


def follow(nodes: np.ndarray, owner: np.ndarray, tokens: np.ndarray, levels: int, branch: float = BRANCH) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that ``levels`` more steps lead to, and whose they are."""
    bound = _U(int(branch / TOKENS * 2**64))
    at = np.arange(1, TOKENS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
    for _ in range(levels):
        r, c = np.nonzero(mix(nodes[:, None] + at[None, :]) < bound)
        owner = owner[r]
        nodes = mix(mix(nodes[r] ^ at[c]) + tokens[owner, c].astype(np.uint64))
    return nodes, owner


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[np.argsort(owner, kind="stable")].view(np.int64)))


def _embed(n: int, count: int):
    def work():
        shingle = Shingler(n)
        roots = mix(np.arange(1, count + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingle(t) for t in b.column("text").to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(size)
            tokens = np.zeros((len(sets), TOKENS), dtype=np.uint16)
            prints = np.zeros((2, len(sets)), dtype=np.uint64)
            if len(full):
                tokens[full] = sketches([sets[i] for i in full])
                prints[0, full] = [np.bitwise_xor.reduce(sets[i]) for i in full]
                prints[1, full] = [np.add.reduce(mix(sets[i] ^ _U(7))) for i in full]
            nodes, owner = follow(np.tile(roots, len(full)), np.repeat(full, count), tokens, LEVELS)
            return [
                pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(size),
                pa.array([x.tobytes() for x in tokens], pa.binary()), _lists(nodes, owner, len(sets)),
            ]

        return step

    return work


_EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
_FOUND = T.StructType([*_EDGE.fields, T.StructField("n", T.LongType())])


def _pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a tile's members in order, and which belong to its row and column."""
    chunk = t.column("chunk").to_numpy()
    row, col = t.column("row")[0].as_py(), t.column("col")[0].as_py()
    return t.column("id").to_numpy(), np.flatnonzero(chunk == row), np.flatnonzero(chunk == col)


def _brute_tokens(agree: float):
    need = int(np.ceil(agree * TOKENS))

    def work():
        def step(t: pa.Table) -> pa.Table:
            ids, row, col = _pairs(t)
            if not len(row) or not len(col):
                return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
            x = np.frombuffer(b"".join(t.column("tokens").to_pylist()), dtype=np.uint16).reshape(-1, TOKENS)
            a, b = [], []
            for i in range(0, len(row), 64):
                r = row[i : i + 64]
                same = np.zeros((len(r), len(col)), dtype=np.uint8)
                for k in range(TOKENS):
                    same += x[r, k][:, None] == x[col, k][None, :]
                p, q = np.nonzero(same >= need)
                ok = ids[r[p]] != ids[col[q]]
                a.append(r[p[ok]])
                b.append(col[q[ok]])
            # What a chunk's own tile connects needs no edge here.
            own = [] if row[0] == col[0] else [g for part in (row, col) for g in _bunches(x, part, need)]
            tree = forest(len(ids), np.concatenate(a), np.concatenate(b), own)
            return pa.table({"u": pa.array([ids[p] for p, _ in tree], pa.int64()), "v": pa.array([ids[q] for _, q in tree], pa.int64())})

        return step

    return work


def _bunches(x: np.ndarray, part: np.ndarray, need: int) -> list[np.ndarray]:
    """Sets of members that agree with one of them, of a few such."""
    out, left = [], part
    for _ in range(8):
        if len(left) < 2:
            break
        near = (x[left] == x[left[0]]).sum(1) >= need
        out.append(left[near])
        left = left[~near]
    return out


def _split():
    def work():
        def step(b: pa.RecordBatch) -> list[pa.Array]:
            nodes = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.frombuffer(b"".join(b.column("tokens").to_pylist()), dtype=np.uint16).reshape(-1, TOKENS)
            return [_lists(*follow(nodes, np.arange(len(nodes)), x, 1, SPLIT_BRANCH), len(nodes))]

        return step

    return work


def intersections(sets: list[np.ndarray], row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows and columns."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(row), len(col)), dtype=np.float32)
    everywhere = df == len(sets)  # once in each, as sets have no repeats
    out += everywhere.sum()
    many = (df > 1) & ~everywhere
    place = np.cumsum(many) - 1
    keep = many[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for c in range(0, int(many.sum()), width):
        i, j = np.searchsorted(column, [c, c + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[owner[i:j], column[i:j] - c] = 1
        out += x[row] @ x[col].T
    return out


def _verify(threshold: float):
    def work():
        def step(t: pa.Table) -> pa.Table:
            ids, row, col = _pairs(t)
            weight = t.column("copies").to_numpy()
            same = t.column("row")[0].as_py() == t.column("col")[0].as_py()
            listed = t.column("shingles").combine_chunks()
            ends, values = listed.offsets.to_numpy(), listed.values.to_numpy()
            sets = [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            u, v, n = [], [], []
            if len(row) and len(col) and len(ids) > 1:
                size = np.array([len(s) for s in sets])
                both = intersections(sets, row, col)
                alike = both >= threshold * (size[row][:, None] + size[col][None, :] - both) - 1e-6
                if same:
                    np.fill_diagonal(alike, False)
                links = np.zeros(len(ids), dtype=np.int64)
                links[row] += alike @ weight[col]
                if not same:
                    links[col] += alike.T @ weight[row]
                p, q = np.nonzero(alike)
                some = np.flatnonzero(links)
                u, v, n = ids[some].tolist(), [None] * len(some), links[some].tolist()
                tree = forest(len(ids), row[p], col[q])
                u += [ids[x] for x, _ in tree]
                v += [ids[y] for _, y in tree]
                n += [0] * len(tree)
            return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

        return step

    return work


_FIRST = "struct<none:boolean,id:bigint,h1:bigint,h2:bigint>"


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h1, h2, p1, p2, size) and classes (p1, p2, size, first, copies,
    links, least) of ``docs`` (id, text, h1, h2). ``first`` names the first row
    of a class, ``least`` the first of all rows that its links lead to."""
    added = [T.StructField("p1", T.LongType()), T.StructField("p2", T.LongType()), T.StructField("size", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.LongType()))]
    every = materialise(map_rows(docs, ["id", "h1", "h2", "text"], added, _embed(n, runs(threshold, recall)), 256).drop("text"))
    named = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    # The number is unique, and stays as it is once written.
    classes = materialise(
        every.where("size > 0").groupBy("p1", "p2", "size").agg(F.count(F.lit(1)).alias("copies"), F.min(named).alias("first"), F.first(F.struct("tokens", "nodes")).alias("s"))
        .select("p1", "p2", "size", "copies", "first", "s.tokens", "s.nodes", F.monotonically_increasing_id().alias("rep"))
    )
    maybe: list[DataFrame] = []
    at = classes.select(F.col("rep").alias("id"), F.explode("nodes").alias("node"))
    tokens = classes.select(F.col("rep").alias("id"), "tokens")
    for left in range(SPLITS, -1, -1):
        counts = materialise(at.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
        members = at.select("id", "node").join(counts, "node").join(tokens, "id")
        if left:
            members = materialise(members)
        now = members.where(F.col("members") <= SMALL) if left else members
        tiled = tiles(now, "node", "id", "members", TOKEN_CHUNK)
        maybe.append(map_groups(tiled.select("node", "row", "col", "chunk", "id", "tokens"), ["node", "row", "col"], _EDGE, _brute_tokens(threshold - 0.15)))
        if left:
            large = members.where(F.col("members") > SMALL)
            at = map_rows(large, ["id", "node", "tokens"], [T.StructField("children", T.ArrayType(T.LongType()))], _split(), 4096).select("id", F.explode("children").alias("node")).distinct()
    edges = maybe[0]
    for e in maybe[1:]:
        edges = edges.unionByName(e)
    sets = components(edges).join(classes.select(F.col("rep").alias("id"), "copies", "size", "first"), "id")
    sets = materialise(sets)
    # Members of a set count more where their texts are long, so that chunks hold no more n-grams.
    sizes = materialise(sets.groupBy("component").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") * CHUNK / CHUNK_GRAMS)).alias("members")))
    members = sets.join(sizes, "component").select("id", "component", "members", "copies", F.col("first.id").alias("doc"), F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"))
    texts = docs.withColumnRenamed("id", "doc").join(members.withColumnRenamed("doc", "of"), (F.col("doc").eqNullSafe(F.col("of"))) & (docs["h1"] == members["h1"]) & (docs["h2"] == members["h2"]))
    texts = texts.select("id", "component", "members", "copies", "text").dropDuplicates(["id"])
    shingled = map_rows(texts, ["id", "component", "members", "copies", "text"], [T.StructField("shingles", T.ArrayType(T.LongType()))], _shingles(n), 256).drop("text")
    tiled = tiles(shingled, "component", "id", "members", CHUNK)
    found = materialise(map_groups(tiled.select("component", "row", "col", "chunk", "id", "copies", "shingles"), ["component", "row", "col"], _FOUND, _verify(threshold)))
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    final = components(found.where("v is not null").select("u", "v")).select(F.col("id").alias("rep"), "component")
    linked = materialise(classes.select("rep", "first").join(final, "rep"))
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    known = materialise(linked.join(least, "component").select("rep", "least").join(links, "rep", "left"))
    known = classes.select("p1", "p2", "size", "first", "rep", "copies").join(known, "rep", "left")
    return every.select("id", "h1", "h2", "p1", "p2", "size"), known.select("p1", "p2", "size", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "first").alias("least"))


def _hashed(df: DataFrame, text: str) -> list[Column]:
    body = F.coalesce(df[f"`{text}`"].cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), body).alias("h1"), F.xxhash64(F.lit(2), body).alias("h2")]


@tidy
def join(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """One row per row of ``df``: the key, ``n_links`` (other rows with Jaccard
    similarity at least ``threshold``), ``class_id`` (smallest key that links
    lead to, its own included) and ``kept`` (it is the row, or equal to the row,
    that its class is named by)."""
    docs = df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{text}`"].alias("text"), *_hashed(df, text))
    every, classes = _classes(docs, n, threshold, recall)
    out = every.join(materialise(classes), ["p1", "p2", "size"], "left")
    lone = F.col("size") == 0
    own = (F.col("id").eqNullSafe(F.col("least.id"))) & (F.col("h1") == F.col("least.h1")) & (F.col("h2") == F.col("least.h2"))
    return out.select(
        F.col("id").alias(key),
        F.when(lone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(lone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        F.when(lone, True).otherwise(own).alias("kept"),
    )


@tidy
def representatives(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """The columns of ``df``, and of each class of alike rows one row: that with
    the smallest key, among equal keys the first by the hash of the text, and
    among rows equal in both the first by the hash of the row. Texts without
    words stay, all of them."""
    docs = df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{text}`"].alias("text"), *_hashed(df, text))
    every, classes = _classes(docs, n, threshold, recall)
    name = ["id", "h1", "h2"]
    first = classes.where(F.col("first") == F.col("least")).select("first.id", "first.h1", "first.h2")
    same = (F.col("id").eqNullSafe(F.col("id_"))) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
    alike = every.where("size > 0").groupBy(*name).agg(F.count(F.lit(1)).alias("rows"))
    first = first.select(*[F.col(c).alias(c + "_") for c in name]).join(alike, same).select(*name, (F.col("rows") > 1).alias("again"))
    bare = every.where("size = 0").select(*name).distinct().withColumn("again", F.lit(False))
    stay = materialise(first.unionByName(bare)).select(*[F.col(c).alias(c + "_") for c in name], "again")
    rows = df.select(carry(df, df.columns), df[f"`{key}`"].cast("long").alias("id"), *_hashed(df, text)).join(stay, same)
    once = rows.where("again").groupBy(*name).agg(F.min_by(ROW, F.xxhash64(ROW)).alias(ROW)).select(ROW)
    return rows.where("not again").select(ROW).unionByName(once).select(*carried(df.columns))


def _shingles(n: int):
    def work():
        shingle = Shingler(n)

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingle(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))]

        return step

    return work


