"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by random signs and fast Hadamard transforms, three times
over; its hash is the signed axis next to it. ``HASHES`` of these make a bucket
of one of ``TABLES`` tables, and multiprobing adds the buckets that the runner-up
axes lead to. Members of a bucket are compared by cosine in double precision,
in tiles of bounded size; a pair that shares several buckets is counted in the
first of them only, so links are counted without listing pairs.

Vectors with equal components are one class from the start. Links of classes
count each copy. Connected components are found over spanning forests of tiles.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length don't link; an id that
several vectors share is no bond between them, each row is judged by its own
vector; rows with null ids take part, and a component of such rows alone is
null; repeated rows are links of each other; an empty table gives an empty
table; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.common import components, forest, map_groups, map_rows, materialise, tidy, tiles

TABLES = 8
HASHES = 2
PROBES = 3
#: Members of a chunk of a tile.
CHUNK = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _signs(d: int) -> np.ndarray:
    return np.random.default_rng(20240131).choice([-1.0, 1.0], size=(TABLES, HASHES, 3, d))


def buckets(x: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of unit vectors, TABLES x PROBES each."""
    n, d = len(x), 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, : x.shape[1]] = x
    signs, rows = _signs(d), np.arange(n)
    out = np.empty((n, TABLES, PROBES), dtype=np.uint64)
    for t in range(TABLES):
        first, second, gap = [], [], []
        for k in range(HASHES):
            y = padded
            for s in signs[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            a = size.argmax(1)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(1)
            axis = lambda i, y=y: 2 * i + (y[rows, i] > 0)
            first.append(axis(a))
            second.append(axis(b))
            gap.append(top - size[rows, b])
        order = np.argsort(np.stack(gap, 1), axis=1)
        for p in range(PROBES):
            code = np.full(n, length * 1_000 + t, dtype=np.uint64)
            for k in range(HASHES):
                other = (order[:, p - 1] == k) if p else np.zeros(n, dtype=bool)
                code = code * np.uint64(2 * d + 1) + np.where(other, second[k], first[k]).astype(np.uint64)
            out[:, t, p] = (code + np.uint64(1)) * _ODD
    return out.reshape(n, TABLES * PROBES)


def _hash():
    def work():
        import xxhash

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            rows = b.column("vec").to_pylist()
            p1, p2 = np.zeros(len(rows), dtype=np.uint64), np.zeros(len(rows), dtype=np.uint64)
            keys: list[list[int] | None] = [None] * len(rows)
            by: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                if r and None not in r:
                    by.setdefault(len(r), []).append(i)
            for length, own in by.items():
                x = np.array([rows[i] for i in own], dtype=np.float64)
                with np.errstate(all="ignore"):
                    scale = np.abs(x).max(1)
                    good = np.isfinite(scale) & (scale > 0)
                    own = [i for i, g in zip(own, good, strict=True) if g]
                    x = x[good] / scale[good][:, None]
                if not own:
                    continue
                found = buckets(x / np.linalg.norm(x, axis=1)[:, None], length)
                for i, f in zip(own, found.view(np.int64), strict=True):
                    raw = np.array(rows[i], dtype=np.float64) + 0.0
                    p1[i], p2[i] = xxhash.xxh64_intdigest(raw.tobytes(), 1), xxhash.xxh64_intdigest(raw.tobytes(), 2)
                    keys[i] = f.tolist()
            return [pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]

        return step

    return work


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v", "n")])


def _compare(threshold: float):
    def work():
        def matrix(c: pa.ChunkedArray, kind) -> np.ndarray:
            listed = c.combine_chunks()
            return listed.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(listed), -1)

        def step(t: pa.Table) -> pa.Table:
            ids, chunk = t.column("id").to_numpy(), t.column("chunk").to_numpy()
            r, c, node = (t.column(k)[0].as_py() for k in ("row", "col", "node"))
            row, col = np.flatnonzero(chunk == r), np.flatnonzero(chunk == c)
            u, v, n = [], [], []
            if len(ids) > 1 and len(row) and len(col):
                x = matrix(t.column("vec"), np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1)[:, None]
                alike = x[row] @ x[col].T >= threshold
                if r == c:
                    np.fill_diagonal(alike, False)
                p, q = np.nonzero(alike)
                if len(p):
                    keys = matrix(t.column("keys"), np.int64).reshape(len(ids), TABLES, PROBES)
                    a, b = keys[row[p]], keys[col[q]]
                    # Counted only in the pair's first bucket: by table, then by number.
                    table = np.nonzero((keys[row[0]] == node).any(1))[0][0]
                    ok = np.ones(len(p), dtype=bool)
                    for i in range(table + 1):
                        for j in range(PROBES):
                            for k in range(PROBES):
                                meet = a[:, i, j] == b[:, i, k]
                                if i == table:
                                    meet &= a[:, i, j] < node
                                ok &= ~meet
                    p, q = p[ok], q[ok]
                weight = t.column("copies").to_numpy()
                links = np.bincount(row[p], weights=weight[col[q]], minlength=len(ids))
                if r != c:
                    links += np.bincount(col[q], weights=weight[row[p]], minlength=len(ids))
                some = np.flatnonzero(links)
                u, v, n = ids[some].tolist(), [None] * len(some), links[some].astype(np.int64).tolist()
                tree = forest(len(ids), row[p], col[q])
                u += [ids[i] for i, _ in tree]
                v += [ids[j] for _, j in tree]
                n += [0] * len(tree)
            return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

        return step

    return work


@tidy
def dedup(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``df``: the key, ``n_links``, ``component_id`` (the
    smallest key that links lead to, its own included) and ``kept`` (the key is
    its component's)."""
    vecs = df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{vector}`"].alias("vec"))
    added = [T.StructField("p1", T.LongType()), T.StructField("p2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    every = materialise(map_rows(vecs, ["id", "vec"], added, _hash(), 4096))
    # A class of equal vectors has a number that is unique, and stays as it is once written.
    classes = materialise(
        every.where("keys is not null").groupBy("p1", "p2")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first(F.struct("vec", "keys")).alias("s"))
        .select("p1", "p2", "copies", "least", "s.vec", "s.keys", F.monotonically_increasing_id().alias("rep"))
    )
    at = classes.select(F.col("rep").alias("id"), F.explode(F.array_distinct("keys")).alias("node"))
    counts = materialise(at.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = at.join(counts, "node")
    tiled = tiles(members, "node", "id", "members", CHUNK)
    full = tiled.join(classes.select(F.col("rep").alias("id"), "vec", "keys", "copies"), "id")
    found = materialise(map_groups(full.select("node", "row", "col", "chunk", "id", "vec", "keys", "copies"), ["node", "row", "col"], _FOUND, _compare(threshold)))
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    final = components(found.where("v is not null").select("u", "v")).select(F.col("id").alias("rep"), "component")
    linked = materialise(classes.select("rep", "least").join(final, "rep"))
    name = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    known = linked.join(name, "component").select("rep", "component_id").join(links, "rep", "left")
    named = materialise(classes.select("p1", "p2", "rep", "copies", "least").join(known, "rep", "left"))
    out = every.select("id", "p1", "p2", F.col("keys").isNull().alias("lone")).join(named, ["p1", "p2"], "left")
    component = F.when(F.col("lone"), F.col("id")).otherwise(F.coalesce("component_id", "least"))
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("lone"), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
