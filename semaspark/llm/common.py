"""Plumbing shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()


#: The prefix of inner column names, which no table is expected to use.
OWN = "__semaspark_"
#: Column that carries a row's own columns through an operator.
ROW = OWN + "row"


def carry(df: DataFrame, keep: Iterable[str]) -> Column:
    """The columns ``keep`` as one struct, so that no name of theirs meets a
    name of the operator's; ``carried`` takes them out again."""
    return F.struct(F.lit(0).alias(OWN + "none"), *[df[f"`{c}`"].alias(c) for c in keep]).alias(ROW)


def carried(keep: Iterable[str]) -> list[Column]:
    return [F.col(ROW)[c].alias(c) for c in keep]


def release() -> None:
    """Give freed memory of this Python worker back: workers are used again, and
    what one stage leaves would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application. Arrow batches hold
    2,048 rows then, if the session leaves Spark's default of 10,000: rows here
    are whole texts."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch, "10000") == "10000":
        spark.conf.set(batch, "2048")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session
    names none, a session on one machine gets a folder of its own; a cluster
    must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "semaspark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: cuts lineage
    and survives lost executors. ``tidy`` or ``discard`` delete it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semaspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written within each ``tidy`` that is open.
_written: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote."""
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("semaspark-"):
            _delete(df.sparkSession, folder)


def tidy(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that leaves only those written tables behind that its result
    reads. The tables of an inner operator are the outer one's to delete."""

    @wraps(make)
    def made(*args, **how) -> DataFrame:
        _written.append([])
        try:
            out = make(*args, **how)
            used = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in out.inputFiles()}
        except BaseException:
            _written.pop()
            raise
        for path in (own := _written.pop()):
            if path.rsplit("/", 1)[-1] not in used:
                _delete(out.sparkSession, path)
        if _written:
            _written[-1] += [p for p in own if p.rsplit("/", 1)[-1] in used]
        return out

    return made


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame,
    columns: list[str],
    added: list[T.StructField],
    work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    rows: int = 1024,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Append columns computed from Arrow batches of at most ``rows`` rows.

    ``columns`` are kept as they are; ``work()`` runs once per task and returns
    a function from a batch to one array per added field; ``done()`` runs at the
    task's end.
    """
    ship_package(df.sparkSession)
    kept = df.select(*[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([*kept.schema.fields, *added])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        try:
            for big in batches:
                for i in range(0, big.num_rows, rows):
                    b = big.slice(i, rows)
                    yield pa.RecordBatch.from_arrays([*b.columns, *step(b)], names=names)
        finally:
            step = big = b = None
            if done:
                done()
            release()

    return kept.mapInArrow(run, schema)


def map_groups(
    df: DataFrame,
    keys: list[str],
    schema: T.StructType,
    work: Callable[[], Callable[[pa.Table], pa.Table]],
) -> DataFrame:
    """Apply a function to each group of rows with equal ``keys`` (integers).

    Groups are streamed from sorted partitions, many in one Arrow batch, so
    tiny groups cost no call into Spark each. A group is held in memory at
    once: callers bound its size, by ``tiles`` for instance.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, rest, t, b = work(), None, None, None
        try:
            for b in batches:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t])
                if not rest.num_rows:
                    continue
                at = [rest.column(k).to_numpy() for k in keys]
                new = np.zeros(rest.num_rows, dtype=bool)
                for c in at:
                    new[1:] |= c[1:] != c[:-1]
                cuts = [0, *np.flatnonzero(new).tolist()]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    yield from step(rest.slice(i, j - i)).to_batches()
                rest = rest.slice(cuts[-1])
            if rest is not None and rest.num_rows:
                yield from step(rest).to_batches()
        finally:
            step = rest = t = b = None
            release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tiles(df: DataFrame, key: str, ident: str, size: str, rows: int) -> DataFrame:
    """Cut each group of ``key`` into chunks of about ``rows`` members, and deal
    each member to one tile for each chunk: columns ``row``, ``col`` (row <= col)
    and ``chunk``. Any two members meet in exactly one tile if in the same chunk
    (row = col) or in different ones; no tile holds more than about twice
    ``rows`` members. ``size`` is the column with the group's size."""
    n = F.ceil(F.col(size) / rows).cast("int")
    chunk = F.pmod(F.xxhash64(ident, F.lit(17)), n).cast("int")
    return (
        df.withColumn("chunk", F.when(n > 1, chunk).otherwise(0))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("row", F.least("chunk", "other"))
        .withColumn("col", F.greatest("chunk", "other"))
        .drop("other")
    )


def forest(n: int, a: np.ndarray, b: np.ndarray, known: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (a, b) of 0..n-1 connect, without those
    inside the sets in ``known``, which are connected elsewhere."""
    root = list(range(n))
    for same in known or ():
        for x in same.tolist():
            root[x] = int(same[0])
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((max(x, y), min(x, y)))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (id, component) of every node of ``edges``
    (columns u, v), by its smallest node.

    Each round points every node at its smallest neighbour, follows the
    pointers to their ends, and contracts the edges. Minimum and distinct
    combine before they shuffle, so hubs do no harm.
    """
    spark = edges.sparkSession
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialise(edges)
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        while True:
            seen = Observation()
            onward = point.select(F.col("u").alias("w"), F.col("p").alias("q"))
            step = point.join(onward, point.p == onward.w).select("u", "p", "q")
            step = step.observe(seen, F.coalesce(F.sum((F.col("p") != F.col("q")).cast("long")), F.lit(0)).alias("moved"))
            old, point = point, materialise(step.select("u", F.col("q").alias("p")))
            discard(old)
            if not seen.get["moved"]:
                break
        if total is None:
            total = point
        else:
            onward = point.select(F.col("u").alias("w"), F.col("p").alias("q"))
            total = materialise(total.join(onward, total.p == onward.w, "left").select("u", F.coalesce("q", "p").alias("p")))
        pu, pv = point.select("u", F.col("p").alias("pu")), point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        nxt = edges.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        old, edges = edges, materialise(nxt)
        discard(old)
    if total is None:
        return spark.createDataFrame([], "id long, component long")
    return total.select(F.col("u").alias("id"), F.col("p").alias("component"))
