"""Sharding in Hilbert-curve order, in DataFrame operations only.

Language, source and length are quantised to cells of a cube; documents are ordered by the cell's
index on the Hilbert curve, then by text, and the order is cut into runs of near equal bytes. A run
covers a compact part of the cube, so that a filter on any of the dimensions skips most shards.
Equal texts stay in one shard. Groups of them that a cut between groups could not even out are dealt
to shards first; the runs then fill what is left of each shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import written

BITS = 5  # of each dimension
SHARDS = 16
#: Parts of a cell, so that no window holds a whole cell, and document ids in a block, for the same reason.
PARTS, BLOCK = 1024, 4096
#: A group of equal texts over this share of a shard's bytes is dealt to a shard before the runs are cut. There are at
#: most shards / LARGE_SHARE such groups, whatever the input.
LARGE_SHARE = 0.01


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The index of a cell on the Hilbert curve, by Gray-code transposition with shifts, ands and xors.

    Each step is an expression on the one before; ``transform`` over a one-element array names it, so
    that the expression doesn't double at every step.
    """
    n = len(dims)

    def step(x: list[Column], q: int, i: int) -> list[Column]:
        p = q - 1
        t = (x[0].bitwiseXOR(x[i])).bitwiseAND(F.lit(p))
        hit = x[i].bitwiseAND(F.lit(q)) != 0
        first = F.when(hit, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0].bitwiseXOR(t))
        if i == 0:
            return [F.when(hit, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0]), *x[1:]]
        return [first, *x[1:i], F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(t)), *x[i + 1 :]]

    def let(state: Column, f) -> Column:
        return F.element_at(F.transform(F.array(state), lambda s: F.array(*f([s[k] for k in range(n)]))), 1)

    state = F.array(*(d.cast("long") for d in dims))
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            state = let(state, lambda x, q=q, i=i: step(x, q, i))
        q >>= 1

    def gray(x: list[Column]) -> list[Column]:
        for i in range(1, n):
            x = [*x[:i], x[i].bitwiseXOR(x[i - 1]), *x[i + 1 :]]
        t, q = F.lit(0).cast("long"), 1 << (bits - 1)
        while q > 1:
            t = F.when(x[n - 1].bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
            q >>= 1
        return [v.bitwiseXOR(t) for v in x]

    state = let(state, gray)

    def joined(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(x[i], b).bitwiseAND(F.lit(1))
                out = out + F.shiftleft(bit, b * n + (n - 1 - i))
        return out

    return F.element_at(F.transform(F.array(state), joined), 1)


def hilbert_shards(
    docs: DataFrame, *, shards: int = SHARDS, key: str = "doc_id", text: str = "text", categories=("lang", "source")
) -> DataFrame:
    """``key, size, text_crc32, hilbert, shard, slot`` for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1). Equal texts lie in one shard; only a group that is larger
    than the mean shard is cut, between documents in order of the key. Shards' bytes differ from the mean by
    about LARGE_SHARE or by a document, unless large groups alone overfill one. Dimensions are the group's
    smallest category values (null is a value of its own) and its size, so equal texts stand together; columns of
    their cells are ``cell0, cell1, ...``. Rows repeated with one key get slots of their own; null keys come
    first. ``slot`` counts from 0 without gaps in each shard. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
            *(F.col(c).cast("string").alias(f"dim{i}") for i, c in enumerate(categories)),
            F.coalesce(F.floor(F.col(key) / BLOCK), F.lit(-1)).cast("long").alias("block"),
        ),
        "hilbert-rows",
    )
    group = ["h", "text_crc32", "size"]
    # Blocks of ids within a group of equal texts: pre-aggregated, so a hot text is many small windows.
    blocks = rows.groupBy(*group, "block").agg(
        F.count("*").alias("n"), *(F.min(f"dim{i}").alias(f"dim{i}") for i in range(len(categories)))
    )
    groups = blocks.groupBy(*group).agg(
        F.sum("n").alias("n"), *(F.min(f"dim{i}").alias(f"dim{i}") for i in range(len(categories)))
    )
    top = (1 << BITS) - 1
    cells = [F.pmod(F.xxhash64(F.coalesce(f"dim{i}", F.lit("\0"))), F.lit(1 << BITS)) for i in range(len(categories))]
    length = F.least(F.lit(top), F.floor(F.log2(F.col("size").cast("double")) * 1.5)).cast("long")
    groups = written(
        groups.select(
            *group, "n", (F.col("n") * F.col("size")).alias("bytes"), hilbert_index([*cells, length]).alias("hilbert"),
            *(c.alias(f"cell{i}") for i, c in enumerate([*cells, length])),
            F.pmod(F.shiftright("h", 20), F.lit(PARTS)).alias("part"),
        ),
        "hilbert-groups",
    )

    # Starts, from coarse to fine: cells on the curve (at most 2^15), parts of a cell, groups of a part.
    def starts(level: DataFrame, over, order: list, prefix: str) -> DataFrame:
        w = (Window.partitionBy(*over) if over else Window.orderBy(*order)).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return level.select(
            "*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{prefix}_{c}") for c in ("n", "bytes"))
        )

    total = groups.agg(F.sum("bytes")).first()[0] or 1  # one number
    large = _dealt_first(groups, group, total, shards)
    on_curve = groups.join(F.broadcast(large.select(*group)), group, "left_anti") if large is not None else groups
    part = on_curve.groupBy("hilbert", "part").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    cell = starts(
        part.groupBy("hilbert").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), [], ["hilbert"], "cell"
    )
    part = starts(part, ["hilbert"], ["part"], "part").drop("n", "bytes").join(cell.drop("n", "bytes"), "hilbert")
    group_starts = starts(on_curve, ["hilbert", "part"], [*group], "own").join(part, ["hilbert", "part"])
    add = lambda *c: reduce(lambda a, b: a + b, map(F.col, c))
    told = ["hilbert", *(f"cell{i}" for i in range(len(categories) + 1))]
    none = F.lit(None).cast("int")
    placed = group_starts.select(
        *group, *told, F.col("n").alias("group_n"), F.col("bytes").alias("group_bytes"), none.alias("dealt"),
        add("own_n", "part_n", "cell_n").alias("row0"), add("own_bytes", "part_bytes", "cell_bytes").alias("byte0"),
    )
    room = [total / shards] * shards  # bytes of the curve that each shard takes
    if large is not None:
        filled = {r["shard"]: r["b"] for r in large.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # a row a shard
        left = [max(0.0, total / shards - filled.get(i, 0)) for i in range(shards)]
        curve = total - sum(filled.values())
        room = [x * curve / (sum(left) or 1) for x in left]
        placed = placed.unionByName(
            groups.join(F.broadcast(large.select(*group, "shard", "row0")), group).select(
                *group, *told, F.col("n").alias("group_n"), F.col("bytes").alias("group_bytes"), F.col("shard").alias("dealt"), "row0", F.lit(0).cast("long").alias("byte0")
            )
        )
    ends = [sum(room[: i + 1]) for i in range(shards - 1)]

    w = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*group, "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    placed = before.join(placed, group)
    rank = F.row_number().over(Window.partitionBy(*group, "block").orderBy(F.col("doc_id").asc_nulls_first()))
    out = rows.select("doc_id", *group, "block", (rank - 1).alias("rank")).join(placed, [*group, "block"])
    nth = F.col("before") + F.col("rank")
    whole = F.col("group_bytes") <= total / shards
    middle = F.when(whole, F.col("byte0") + F.col("group_bytes") / 2).otherwise(F.col("byte0") + F.col("size") * (nth + 0.5))
    run = reduce(lambda a, b: a + b, [(middle >= e).cast("int") for e in ends], F.lit(0))
    out = written(
        out.select("doc_id", "size", "text_crc32", *told, (F.col("row0") + nth).alias("row"), F.coalesce("dealt", run).alias("shard"), F.col("dealt").isNotNull().alias("large")),
        "hilbert-out",
    )
    # Rows of a shard's run come first, then its large groups, whose rows are numbered from 0 in each shard.
    curve = ~F.col("large")
    first = out.groupBy("shard").agg(F.coalesce(F.min(F.when(curve, F.col("row"))), F.lit(0)).alias("first"), F.count_if(curve).alias("runs"))  # a row a shard
    slot = F.when(curve, F.col("row") - F.col("first")).otherwise(F.col("runs") + F.col("row"))
    return out.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", *told, "shard", slot.alias("slot"))


def _dealt_first(groups: DataFrame, group: list[str], total: int, shards: int) -> DataFrame | None:
    """Shard and first row in it of the large groups that fit a shard: the largest first, each to its place on the
    curve if there is room, else to the emptiest shard."""
    mean = total / shards
    rows = groups.where((F.col("bytes") > mean * LARGE_SHARE) & (F.col("bytes") <= mean)).select(*group, "n", "bytes", "hilbert").collect()  # see LARGE_SHARE
    if not rows:
        return None
    cells = groups.groupBy("hilbert").agg(F.sum("bytes").alias("b")).orderBy("hilbert")
    upto = cells.select("hilbert", F.sum("b").over(Window.orderBy("hilbert")).alias("upto")).where(F.col("hilbert").isin(sorted({r["hilbert"] for r in rows})))
    home = {r["hilbert"]: min(shards - 1, int((r["upto"] - 1) * shards // total)) for r in upto.collect()}  # of those groups' cells
    bytes_, count, out = [0] * shards, [0] * shards, []
    for r in sorted(rows, key=lambda r: (-r["bytes"], *(r[c] for c in group))):
        at = home[r["hilbert"]]
        if bytes_[at] + r["bytes"] > mean:
            at = min(range(shards), key=lambda i: (bytes_[i], i))
        out.append((*(r[c] for c in group), r["bytes"], at, count[at]))
        bytes_[at] += r["bytes"]
        count[at] += r["n"]
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    return groups.sparkSession.createDataFrame(out, ", ".join([*(f"{c} {kinds[c]}" for c in group), "bytes long", "shard int", "row0 long"]))


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Least and largest cell of each dimension in each shard: what tells a reader with a filter which shards to skip."""
    cells = [c for c in sharded.columns if c.startswith("cell")]
    return sharded.groupBy("shard").agg(*(f(c).alias(f"{c}_{name}") for c in cells for name, f in (("min", F.min), ("max", F.max))))


def report(docs: DataFrame) -> DataFrame:
    """The columns of op7's contract; the law is ``bytes``."""
    return hilbert_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
