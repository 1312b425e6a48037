"""A trie of conversation prefixes by ROLLUP over positional turn-id columns.

A turn's id is the digest of its role and text. Conversations are laid out in blocks of 8 id columns; a block's row
also bears the key of the node where the block before ends. ``GROUP BY block, key, ROLLUP (t1 .. t8)`` then gives
every node of every block together, whatever the length of a conversation, and ``grouping_id`` tells its depth.

A prefix's key is the sum of hashes of (place, id) over its turns: a sum can be split, so that neither the places
nor the keys of a long conversation need one task (``placed``, ``blocks``). The smallest member of a node is also the
smallest of the child that it goes on to. So each conversation stands for a chain of nodes that ends at its last
turn, every node is in one chain, and sums over a node's subtree are sums over the chains of its members: a second
ROLLUP, over conversations that stand for a node, gives them without climbing the tree.

Defined results: rows with a null conversation id belong to none; null roles and texts are empty; turns are in order
of their number, nulls first, and of their id where numbers tie; a repeated row is a turn of its own. An empty table
has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import Scratch

BLOCK = 8  # turns of a block
STRIDE = 1024  # blocks whose keys one window adds up; strides of a conversation are added up by another
CHUNK_BITS = 12  # ids of 4096 neighbouring numbers make one string of the list of ends
HEAD = 3  # turns at most that a conversation takes from another one
KEYS = ["k1", "k2", "k3", "k4"]
SLOTS = [f"t{j + 1}" for j in range(BLOCK)]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, turn, id: the digest of role and text and the text's number of words."""
    r, x = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, x))
    words = F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.where(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.concat(digest, F.lit(":"), words.cast("string")).alias("id"))


def _words(turn_id: Column) -> Column:
    return F.coalesce(F.substring_index(turn_id, ":", -1).cast("long"), F.lit(0))


def _hashes(place: Column, turn_id: Column) -> list[Column]:
    """Four numbers of 32 bits: sums of two billion of them fit."""
    x, y = F.xxhash64(place, turn_id), F.xxhash64(turn_id, place, F.lit("second"))
    low = F.lit(0xFFFFFFFF)
    return [F.when(turn_id.isNull(), 0).otherwise(h) for h in (x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32))]


def _taken(c: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")


def placed(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (c, part, turn, id) in ranges of (c, turn, id), and pieces (c, part, n, before) of the conversations in them.

    A long conversation spans many ranges; ``before`` counts its turns in earlier ones. Rows that agree in all
    columns are told apart by their place in the input, so that they too are spread.
    """
    rows = turns.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("c", F.asc_nulls_first("turn"), "id", "_tie").drop("_tie")
    turns = scratch.write(ranged.withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = turns.groupBy("c", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return turns, scratch.write(pieces)


def _positions(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, from 1 on, and the columns of their piece."""
    within = Window.partitionBy("c", "part").orderBy(F.asc_nulls_first("turn"), "id")
    return turns.join(pieces, ["c", "part"]).withColumn("pos", F.col("before") + F.row_number().over(within))


def rebuilt(turns: DataFrame, pieces: DataFrame, scratch: Scratch, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows (c, at, id) of the rebuilt conversations, and all conversations (c, n): n turns.

    Conversation c takes its first ``_taken(c)`` turns from conversation c - c % every, and goes on with its own.
    """
    first = pieces.where((F.col("c") % every == 0) & (F.col("before") < HEAD))
    heads = _positions(turns.where(F.col("c") % every == 0), first).where(F.col("pos") <= HEAD)
    heads = heads.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("head")).withColumnRenamed("c", "base")
    convs = pieces.groupBy("c").agg(F.sum("n").alias("own")).withColumns({"base": F.col("c") - F.col("c") % every, "h": _taken(F.col("c"))})
    head = F.slice(F.coalesce("head", F.expr("array()").cast("array<struct<pos:bigint,id:string>>")), F.lit(1), F.col("h"))
    convs = convs.join(heads, "base", "left").withColumn("head", head).withColumn("k", F.size("head"))
    convs = scratch.write(convs.select("c", "h", "k", "head", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    own = _positions(turns, pieces.select("c", "part", "before").join(convs.select("c", "h", "k"), "c")).where(F.col("pos") > F.col("h"))
    own = own.select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("at"), "id")
    taken = convs.select("c", F.posexplode("head").alias("at", "x")).select("c", (F.col("at") + 1).cast("long").alias("at"), "x.id")
    return own.unionByName(taken), convs.select("c", "n")


def blocks(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each block of a conversation, and one for a conversation without turns.

    c, block, t1.., k1..k4 and words: key and words of the turns before the block; b1..b4: the block's own share of the
    key; total: words of the conversation.
    """
    at, turn_id = F.col("at"), F.col("id")
    slot = (at - 1) % BLOCK
    per = rows.groupBy("c", F.floor((at - 1) / BLOCK).alias("block")).agg(
        *(F.max(F.when(slot == j, turn_id)).alias(t) for j, t in enumerate(SLOTS)),
        *(F.sum(h).alias(f"b{i + 1}") for i, h in enumerate(_hashes(at, turn_id))), F.sum(_words(turn_id)).alias("own"),
    )
    none = convs.where("n = 0").select("c", F.lit(0).cast("long").alias("block"), *(F.lit(None).cast("string").alias(t) for t in SLOTS), *(F.lit(0).cast("long").alias(x) for x in ("b1", "b2", "b3", "b4", "own")))
    per = per.unionByName(none).withColumn("stride", F.floor(F.col("block") / STRIDE))
    sums = {**{k: f"b{i + 1}" for i, k in enumerate(KEYS)}, "words": "own"}
    earlier = Window.partitionBy("c", "stride").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c", "stride")
    within = per.withColumns({**{k: F.coalesce(F.sum(b).over(earlier), F.lit(0)) for k, b in sums.items()}, "total": F.sum("own").over(whole)})
    # Conversations of several strides: what the strides before and all of them hold.
    before = Window.partitionBy("c").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = per.groupBy("c", "stride").agg(*(F.sum(b).alias(f"_{k}") for k, b in sums.items()))
    strides = strides.withColumns({"_several": F.count("*").over(Window.partitionBy("c")), "_total": F.sum("_words").over(Window.partitionBy("c"))})
    strides = strides.withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)) for k in sums}).where("_several > 1").drop("_several")
    out = within.join(strides, ["c", "stride"], "left")
    added = {k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums}
    return out.select("c", "block", *SLOTS, *(x.alias(k) for k, x in added.items()), "b1", "b2", "b3", "b4", F.coalesce("_total", "total").alias("total"))


_ROLLUP = f"SELECT block, {', '.join(KEYS)}, words, {', '.join(SLOTS)}, {BLOCK} - bit_count(grouping_id()) AS level, {{}} FROM {{{{rows}}}} GROUP BY block, {', '.join(KEYS)}, words, ROLLUP ({', '.join(SLOTS)})"


def _rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """A row for each node: the columns of its block with t1..t<level> set, ``level`` (1..8, 0 for the root), ``depth``."""
    every = rows.sparkSession.sql(_ROLLUP.format(aggregates), rows=rows)
    last = F.element_at(F.array(*SLOTS), F.greatest(F.col("level"), F.lit(1)))
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull())
    return every.where(real).withColumns({"depth": F.col("block") * BLOCK + F.col("level"), "last": F.when(F.col("level") > 0, last)})


def nodes_of(laid: DataFrame) -> DataFrame:
    """c (the smallest member), depth, n, total, key, parent's key q1..q4, words before and with the last turn."""
    rolled = _rolled(laid, "min(c) AS c, count(*) AS n, sum(total) AS total")
    place = lambda j: F.col("block") * BLOCK + j + 1
    within = [(j, F.when(F.col("level") > j, F.col(t))) for j, t in enumerate(SLOTS)]  # the others are null
    hashes = [_hashes(place(j), t) for j, t in within]
    own = _hashes(F.col("depth"), F.col("last"))
    plus = lambda first, more: sum(more, first)
    key = {k: plus(F.col(k), [h[i] for h in hashes]) for i, k in enumerate(KEYS)}
    words = plus(F.col("words"), [_words(t) for _, t in within])
    out = rolled.select("c", "depth", "n", "total", *(x.alias(k) for k, x in key.items()), *(h.alias(f"h{i + 1}") for i, h in enumerate(own)), words.alias("upto"), _words(F.col("last")).alias("w"))
    return out.select("c", "depth", "n", "total", *KEYS, *((F.col(k) - F.col(f"h{i + 1}")).alias(f"q{i + 1}") for i, k in enumerate(KEYS)), "upto", (F.col("upto") - F.col("w")).alias("before"))


def ends_of(laid: DataFrame) -> DataFrame:
    """depth, key, ends: SHA-256 of the numbers, in order, of the conversations that end at a node.

    A digest needs its text in order. Numbers are joined in chunks of neighbouring ones first; the chunks of a node
    then stream through one task, which holds one batch of them.
    """
    key = [F.max(F.col(k) + F.col(f"b{i + 1}")).alias(k) for i, k in enumerate(KEYS)]  # sums never fall
    size = F.max(F.col("block") * BLOCK + sum((F.col(t).isNotNull().cast("int") for t in SLOTS), F.lit(0))).alias("depth")
    convs = laid.groupBy("c").agg(size, *key)
    at = ["depth", *KEYS]
    chunks = convs.groupBy(*at, F.shiftright("c", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list("c")).alias("own"))
    chunks = chunks.withColumn("own", F.concat_ws(",", F.transform("own", lambda x: x.cast("string"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for *node, own in zip(*(batch.column(c).to_pylist() for c in (*at, "own")), strict=True):
                if node != now:
                    done += [] if now is None else [(*now, digest.hexdigest())]
                    now, digest = node, hashlib.sha256(own.encode())
                else:
                    digest.update(b"," + own.encode())
            if done:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*done, strict=True))[:-1]), pa.array([d[-1] for d in done])], names=[*at, "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([digest.hexdigest()])], names=[*at, "ends"])

    dealt = chunks.withColumn("depth", F.col("depth").cast("long")).repartition(*at).sortWithinPartitions(*at, "chunk")
    return dealt.select(*at, "own").mapInArrow(run, f"{', '.join(f'{c} long' for c in at)}, ends string")


def prefix_trie(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations; see ``report`` for the columns."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, pieces = placed(turn_rows(conversations, conv, turn, role, text), scratch)
    laid = scratch.write(blocks(*rebuilt(turns, pieces, scratch)))
    nodes = scratch.write(nodes_of(laid))
    # Each conversation that is a node's smallest member stands for the nodes from depth ``first`` to its end ``size``.
    chains = nodes.groupBy("c").agg(F.min("depth").alias("first"), F.max("depth").alias("size"), F.max("upto").alias("whole"), F.min("before").alias("skipped"))
    heads = nodes.join(chains.select("c", F.col("first").alias("depth")), ["c", "depth"]).where("depth > 0").select("c", "depth", "q1", "q2", "q3", "q4")
    root = nodes.where("depth = 0").select(F.col("c").alias("root"))  # one row
    upper = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(f"q{i + 1}") for i, k in enumerate(KEYS)), F.col("c").alias("parent"))
    deep = heads.where("depth > 1").join(upper.where("depth > 1"), ["depth", "q1", "q2", "q3", "q4"]).select("c", "depth", "parent")
    flat = heads.where("depth = 1").select("c", "depth", root.scalar().alias("parent"))
    heads = scratch.write(deep.unionByName(flat))
    kids = scratch.write(heads.groupBy(F.col("parent").alias("c"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids")))
    ended = kids.select("c", F.col("depth").alias("size"), F.lit(0).alias("leaf"))
    chains = chains.join(ended, ["c", "size"], "left").join(heads.select("c", "parent"), "c", "left")
    chains = scratch.write(chains.select("c", "first", "size", "parent", "whole", (F.col("whole") - F.col("skipped")).alias("chain"), F.coalesce("leaf", F.lit(1)).alias("leaf")))
    below = _rolled(laid.join(chains.select("c", "chain", "leaf"), "c"), "min(c) AS c, sum(chain) AS chains, sum(leaf) AS leaves").select("c", "depth", "chains", "leaves")
    out = nodes.join(below, ["c", "depth"]).join(chains, "c").join(kids, ["c", "depth"], "left").join(ends_of(laid), ["depth", *KEYS], "left")
    # Words of all members from here on, less those of each node once: the members' chains, with the smallest one's from here.
    saved = (F.col("total") - F.col("n") * F.col("before")) - (F.col("chains") - F.col("chain") + F.col("whole") - F.col("before"))
    parent = F.when(F.col("depth") > F.col("first"), F.col("c")).otherwise(F.col("parent"))
    return out.select(
        F.col("c").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.coalesce("kids", F.lit(0)) + (F.col("size") > F.col("depth")).cast("long")).alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The columns of op13's contract: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    return prefix_trie(conversations.select("conv_id", "turn", "role", "text"))
