"""Benchmark decontamination with SimHash windows; built-in functions only.

A window of a document holds as many word n-grams as an item. Windows slide by
one n-gram, from every start; those that hold no n-gram of an item of their size
have similarity 0 and are left out. Each window and item has a 64-bit SimHash: every
bit is the majority of the n-grams' bits, each n-gram counting by its weight.
They roll: running sums of the bits are kept along a document, and a window's
are the difference of two of them. The fingerprints are cut into ``BLOCKS``; items are listed under all
values of a block within ``FLIPS`` flips, so any window within ``RADIUS`` bits of
an item meets it in a block, and only pairs that meet there are compared. These
are verified exactly: the weight of the n-grams that window and item share, over
the weight of the item's, must reach the threshold. An n-gram weighs one plus
the logarithm of its rareness among items, and one that no item has as much as
one that a single item has.

The radius goes with the threshold: fingerprints of a pair at similarity 0.8 lie
13 bits apart on average, with a standard deviation of 3, so that about one in a
thousand of such pairs lies beyond 23 bits and is lost; of copies, none.

Cases: null or empty documents and items match nothing; a text of fewer words
than ``n`` has one n-gram, all its words; a document shorter than an item is one
window; case and all but letters and digits don't count; documents are judged by
their text alone, so repeated rows, rows with null ids and rows that share an id
get what their own text gets; of an item with several texts each is sought, and
equal rows of the benchmark count once; items with null ids are left out; an
empty benchmark clears every document; other columns are kept unless named like
an output.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semaspark.llm.common import carried, carry, materialise, tidy

#: 8 blocks of 64 bits; two flips in each: 8 * 3 - 1 bits are found for certain.
BLOCKS = tuple((8 * i, 8) for i in range(8))
FLIPS = 2
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
#: Steps of a weight in a fingerprint.
STEPS = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words in lower case; none of null."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def grams(found: Column, n: int) -> Column:
    """Hashes of word n-grams in order; of fewer words than ``n`` one, of all."""

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    return let(found, hashes)


#: Sums of a fingerprint: ``t`` of the weights q, ``s0`` to ``s31`` of those whose
#: hash h has bit j (in the lower half) and j + 32 (in the upper half).
SUMS = {"t": "q"} | {f"s{j}": f"(shiftrightunsigned(h, {j}) & 4294967297) * q" for j in range(32)}


def _majority() -> Column:
    """The fingerprint by the columns SUMS."""
    bits = []
    for j in range(32):
        bits.append(f"IF((s{j} & 4294967295) * 2 > t, {1 << j}L, 0L)")
        bits.append(f"IF(shiftrightunsigned(s{j}, 32) * 2 > t, {f'{1 << j + 32}L' if j < 31 else 'shiftleft(1L, 63)'}, 0L)")
    return F.expr(" | ".join(bits))


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), own).alias("h1"), F.xxhash64(F.lit(2), own).alias("h2")]


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _tag(i: int, block: Column) -> Column:
    """Block number and value as one number."""
    return block + (i << 16)


def _block(print_: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(print_, start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _near(i: int, start: int, width: int) -> Column:
    """Tags of all values of a block of ``item_print`` within FLIPS flips."""
    flips = [0, *[sum(1 << b for b in c) for k in range(1, FLIPS + 1) for c in combinations(range(width), k)]]
    listed = F.split(F.lit(",".join(map(str, flips))), ",")
    return F.transform(listed, lambda x: _tag(i, _block(F.col("item_print"), start, width).bitwiseXOR(x.cast("bigint"))))


def _first_meeting() -> Column:
    """Whether ``tag`` is of the first block in which the two fingerprints meet,
    so that a pair counts once however many blocks it meets in."""
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    meets = [F.bit_count(_block(apart, s, w)) <= FLIPS for s, w in BLOCKS]
    first = F.when(F.lit(False), F.lit(-1))
    for i, m in enumerate(meets):
        first = first.when(m, F.lit(i))
    return F.shiftrightunsigned(F.col("tag"), 16) == first


def windows(placed: DataFrame) -> DataFrame:
    """(h1, h2, span, start, print) of every window that holds an n-gram of an
    item of its size. ``placed``: the n-grams of each text in order, with
    ``spans``, the sizes of the items that have it, or null.

    Rows for the ends of windows stand among the n-grams they end before; there
    the running sums are read."""
    last = F.greatest(F.col("n") - F.col("span"), F.lit(0))
    own = placed.where("spans is not null").select("h1", "h2", "n", "pos", F.explode("spans").alias("span"))
    # Each n-gram gives the starts that the one before it hasn't given.
    given = F.lag("pos", 1, -1).over(Window.partitionBy("h1", "h2", "span").orderBy("pos"))
    own = own.withColumn("low", F.greatest(given + 1, F.col("pos") - F.col("span") + 1, F.lit(0))).withColumn("high", F.least("pos", last))
    starts = own.where("low <= high").select("h1", "h2", "n", "span", F.explode(F.sequence("low", "high")).alias("start"))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.least(F.col("start") + F.col("span"), F.col("n")).alias("pos"), F.lit(1).alias("sign")))
    edges = starts.select("h1", "h2", "span", "start", F.explode(ends).alias("e")).select("h1", "h2", "e.pos", F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("q"), "span", "start", "e.sign")
    none = F.lit(None).cast("int")
    all_ = placed.select("h1", "h2", "pos", "h", "q", none.alias("span"), none.alias("start"), F.lit(0).alias("sign")).unionByName(edges)
    before = Window.partitionBy("h1", "h2").orderBy("pos", F.col("sign") == 0).rowsBetween(Window.unboundedPreceding, 0)
    running = all_.select("h1", "h2", "span", "start", "sign", *[F.sum(F.expr(e)).over(before).alias(c) for c, e in SUMS.items()]).where("sign <> 0")
    whole = running.groupBy("h1", "h2", "span", "start").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS])
    return whole.select("h1", "h2", "span", "start", _majority().alias("print"))


def find(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id",
    n: int = 5, threshold: float = 0.8, broadcast_rows: int = 500_000,
) -> DataFrame:
    """Pairs of alike window and item: ``h1`` and ``h2`` (``text_key`` of the
    document), ``item``, ``start`` (first n-gram of the window, from 0),
    ``distance`` of the fingerprints and ``similarity``. Tables of the
    benchmark's n-grams and of its listed blocks are broadcast while they have
    been counted to hold ``broadcast_rows`` at most."""
    item = items.select(items[f"`{item_key}`"].alias("item"), grams(words(items[f"`{item_text}`"]), n).alias("own")).where("size(own) > 0 and item is not null").distinct()
    item = materialise(item.select("item", "own", F.size("own").alias("span"), F.monotonically_increasing_id().alias("no")))
    total = item.count()
    each = item.select("no", "item", "span", F.explode(F.array_distinct("own")).alias("h"))
    weight = F.lit(1.0) + F.log(F.lit(float(max(total, 1))) / F.col("df"))
    gram = materialise(each.groupBy("h").agg(F.count_distinct("item").alias("df"), F.collect_set("span").alias("spans")).select("h", weight.alias("weight"), "spans"))
    count = gram.count()

    def light(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= broadcast_rows else df

    # Texts that share an n-gram with the benchmark, each once.
    key = text_key(docs[f"`{text}`"])
    own = grams(words(docs[f"`{text}`"]), n)
    some = docs.select(*key, F.explode(F.array_distinct(own)).alias("h")).join(light(gram.select("h"), count), "h", "left_semi").select("h1", "h2").distinct()
    some = materialise(some)
    named = docs.select(*key, docs[f"`{text}`"].alias("text"))
    once = named.join(light(some, some.count()), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    listed = once.select("h1", "h2", grams(words(F.col("text")), n).alias("own")).select("h1", "h2", F.size("own").alias("n"), F.posexplode("own").alias("pos", "h"))
    steps = lambda w: F.round(w * STEPS).cast("bigint")
    foreign = F.lit(1.0) + F.log(F.lit(float(max(total, 1))))
    placed = materialise(listed.join(light(gram, count), "h", "left").select("h1", "h2", "n", "pos", "h", "spans", steps(F.coalesce("weight", foreign)).alias("q")))
    window = materialise(windows(placed))
    # The items' side: fingerprints under all nearby blocks.
    priced = each.join(light(gram, count), "h").select("no", "h", "weight")
    held = priced.groupBy("no").agg(F.sum("weight").alias("full"))
    spread = item.select("no", "span", F.explode("own").alias("h")).join(light(gram.select("h", "weight"), count), "h").withColumn("q", steps(F.col("weight")))
    printed = spread.groupBy("no", "span").agg(*[F.sum(F.expr(e)).alias(c) for c, e in SUMS.items()]).select("no", "span", _majority().alias("item_print"))
    printed = materialise(printed.join(held, "no"))
    index = printed.select("no", "span", "item_print", F.explode(F.array_distinct(F.concat(*[_near(i, s, w) for i, (s, w) in enumerate(BLOCKS)]))).alias("tag"))
    tags = F.array(*[_tag(i, _block(F.col("print"), s, w)) for i, (s, w) in enumerate(BLOCKS)])
    near = window.withColumn("tag", F.explode(tags)).join(light(index, index.count()), ["tag", "span"]).where((_apart("print", "item_print") <= RADIUS) & _first_meeting())
    near = materialise(near.select("h1", "h2", "no", "span", "start", _apart("print", "item_print").alias("distance")))
    # Shared n-grams of each text and item that meet, then of each window of theirs.
    met = near.select("h1", "h2", "no").distinct()
    shared = placed.where("spans is not null").select("h1", "h2", "pos", "h").join(light(priced, each.count()), "h").join(met, ["h1", "h2", "no"])
    inside = near.join(shared, ["h1", "h2", "no"]).where("pos >= start and pos < start + span")
    shared = inside.groupBy("h1", "h2", "no", "start", "h").agg(F.min("weight").alias("weight"), F.min("distance").alias("distance"))
    shared = shared.groupBy("h1", "h2", "no", "start").agg(F.sum("weight").alias("shared"), F.min("distance").alias("distance"))
    names = printed.select("no", "full").join(item.select("no", "item"), "no")
    alike = shared.join(light(names, total), "no").select("h1", "h2", "item", "start", "distance", (F.col("shared") / F.col("full")).alias("similarity"))
    return alike.where(F.col("similarity") >= threshold - 1e-9)


def _found(docs: DataFrame, items: DataFrame, text: str, broadcast_rows: int, how: dict) -> DataFrame:
    """Matches by text, broadcast while counted to be few."""
    found = find(docs, items, text, broadcast_rows=broadcast_rows, **how).groupBy("h1", "h2")
    found = materialise(found.agg(F.sort_array(F.collect_set("item")).alias("found_items"), F.max("similarity").alias("found_similarity")))
    return F.broadcast(found) if found.count() <= broadcast_rows else found


@tidy
def screen(docs: DataFrame, items: DataFrame, text: str = "text", broadcast_rows: int = 500_000, **how) -> DataFrame:
    """Columns of ``docs`` with ``contaminated``, ``item_ids`` (sorted) and
    ``similarity`` (the greatest; 0 without a match)."""
    found = _found(docs, items, text, broadcast_rows, how)
    kept = [c for c in docs.columns if c not in ("contaminated", "item_ids", "similarity")]
    rows = docs.select(carry(docs, kept), *text_key(docs[f"`{text}`"])).join(found, ["h1", "h2"], "left")
    none = F.array().cast(found.schema["found_items"].dataType)
    return rows.select(
        *carried(kept), F.col("found_items").isNotNull().alias("contaminated"),
        F.coalesce("found_items", none).alias("item_ids"), F.coalesce("found_similarity", F.lit(0.0)).alias("similarity"),
    )


@tidy
def clean(docs: DataFrame, items: DataFrame, text: str = "text", broadcast_rows: int = 500_000, **how) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = _found(docs, items, text, broadcast_rows, how).select("h1", "h2")
    rows = docs.select(carry(docs, docs.columns), *text_key(docs[f"`{text}`"])).join(found, ["h1", "h2"], "left_anti")
    return rows.select(*carried(docs.columns))
