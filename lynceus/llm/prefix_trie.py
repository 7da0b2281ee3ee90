"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK`` turns. Chained digests of whole blocks group conversations first: one row
per block and conversation, a group per distinct chain. Turn boundaries are refined only inside blocks whose group has
siblings, that is groups behind the same chain: there, and only there, nodes of several groups can be the same. A group
without siblings is a plain path, all its turns have the group's members.

Digests chain by xor of position-salted 128-bit block hashes, so a chain is a running aggregate: long conversations are
split into stretches of ``STRETCH`` turns whose totals give offsets, and no conversation has to fit one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.llm.base import ready, stored

BLOCK = 4
#: Turns collected into one array; a multiple of BLOCK.
STRETCH = 1024
#: Conversation ids of one node that share a chunk before they are hashed in order.
CHUNK = 4096
#: Fixed value: words end at blanks, tabs and line breaks.
WORD = r"[^\x20\x09-\x0D]+"
LANES = ("d1", "d2")


def turn_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, p, t1, t2, w): place, digest and words of every turn; texts are read once and travel as digests.

    Places are counted in ranges of the global order (conversation, turn, role, digest): ranges hold equal numbers of
    rows, so a conversation with most of the rows is spread like any other, and offsets join the ranges.
    """
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    rows = stored(turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("at"), role_.alias("role"),
        F.xxhash64(F.lit(1), role_, text_).alias("t1"), F.xxhash64(F.lit(2), role_, text_).alias("t2"),
        F.regexp_count(text_, F.lit(WORD)).cast("long").alias("w")), "turns")
    order = [F.col("at").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col("c"), *order).withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("p", F.row_number().over(Window.partitionBy("c", "part").orderBy(*order)).cast("long"))
    local = stored(local.select("c", "part", "p", "t1", "t2", "w"), "ranged")
    sizes = local.groupBy("c", "part").agg(F.max("p").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only conversations cut by a range border have an offset: at most one for each range
    offsets = sizes.withColumn("offset", before).where("offset is not null").select("c", "part", "offset")
    placed = local.join(F.broadcast(offsets), ["c", "part"], "left")
    return placed.select("c", (F.col("p") + F.coalesce("offset", F.lit(0))).alias("p"), "t1", "t2", "w")


def rebuilt_rows(placed: DataFrame, family: int, heads_of: int) -> tuple[DataFrame, DataFrame]:
    """(turn rows with their new places, one row (c, n) per conversation) of the rebuilt conversations.

    Conversation c takes the first h turns of conversation c - c % ``family``, then its own turns after its first h.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads_of
    base = F.col("c") - F.col("c") % family
    convs = placed.groupBy("c").agg(F.max("p").alias("own")).withColumn("h", h).withColumn("base", base)
    heads = placed.where((F.col("c") == base) & (F.col("p") < heads_of))
    heads = heads.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "t1", "t2", "w"))).alias("head"))
    convs = convs.join(heads, "base", "left")
    taken = F.coalesce(F.filter("head", lambda t: t.p <= F.col("h")), F.array().cast(heads.schema["head"].dataType))
    convs = stored(convs.withColumn("taken", taken).select(
        "c", "h", "taken", (F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n")), "convs")
    shift = convs.select("c", "h", F.size("taken").alias("k"))
    own = placed.join(shift, "c").where("p > h").select("c", (F.col("p") - F.col("h") + F.col("k")).alias("d"), "t1", "t2", "w")
    first = convs.select("c", F.inline("taken")).select("c", F.col("p").alias("d"), "t1", "t2", "w")
    return own.unionByName(first), convs.select("c", "n")


def _digest(salt: int, k: Column, turns: Column) -> Column:
    return F.xxhash64(F.lit(salt), k, F.size(turns), F.transform(turns, lambda t: F.struct(t.t1, t.t2)))


def _xor_along(blocks: Column, lane: str, start: Column) -> Column:
    """Running xor of a lane before each block."""
    return F.aggregate(blocks, F.array(start), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(b[lane]))))


def block_rows(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, k, turns, q1, q2, d1, d2, words, last): every block of every conversation with the chain before and after it."""
    stretch = F.floor((F.col("d") - 1) / STRETCH)
    packed = rows.groupBy("c", stretch.alias("s")).agg(F.array_sort(F.collect_list(F.struct("d", "t1", "t2", "w"))).alias("turns"))
    number = lambda i: F.col("s") * (STRETCH // BLOCK) + i
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / BLOCK).cast("int")), lambda i: F.struct(number(i).alias("k"), F.slice("turns", i * BLOCK + 1, BLOCK).alias("turns")))
    hashed = F.transform("cut", lambda b: F.struct(
        b.k.alias("k"), b.turns.alias("turns"), _digest(11, b.k, b.turns).alias("x1"), _digest(12, b.k, b.turns).alias("x2"),
        F.aggregate(b.turns, F.lit(0).cast("long"), lambda a, t: a + t.w).alias("w")))
    packed = packed.select("c", "s", cut.alias("cut")).select("c", "s", hashed.alias("blocks"))
    total = lambda x: F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b[x]))
    packed = stored(packed.select("c", "s", "blocks", total("x1").alias("e1"), total("x2").alias("e2"),
                                  F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b.w).alias("ew")), "stretches")
    # a conversation of more than one stretch needs what lies before each; one row per STRETCH turns is sorted here
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda agg, e: F.coalesce(agg(e).over(before), F.lit(0).cast("long"))
    offsets = packed.select("c", "s", run(F.bit_xor, "e1").alias("o1"), run(F.bit_xor, "e2").alias("o2"), run(F.sum, "ew").alias("ow")).where("s > 0")
    joined = packed.drop("e1", "e2", "ew").join(offsets, ["c", "s"], "left").na.fill(0, ["o1", "o2", "ow"])
    run_w = F.aggregate("blocks", F.array(F.col("ow")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b.w)))
    chained = joined.select(
        "c", "blocks", _xor_along(F.col("blocks"), "x1", F.col("o1")).alias("r1"), _xor_along(F.col("blocks"), "x2", F.col("o2")).alias("r2"), run_w.alias("rw"))
    out = chained.select("c", F.inline(F.transform("blocks", lambda b, i: F.struct(
        b.k.alias("k"), b.turns.alias("turns"), F.get("r1", i).alias("q1"), F.get("r2", i).alias("q2"), F.get("r1", i + 1).alias("d1"),
        F.get("r2", i + 1).alias("d2"), F.get("rw", i).alias("words")))))
    return out.join(convs, "c").withColumn("last", F.col("n") == F.col("k") * BLOCK + F.size("turns")).drop("n")


def _nodes(groups: DataFrame, carried: list[str]) -> DataFrame:
    """A row per turn of every group: (depth, key, parent key, words before and in the turn, carried columns, at_end)."""
    upto = lambda i: F.slice("turns", 1, i)
    step = lambda salt, q, i: F.when(i == 0, F.col(q)).otherwise(F.col(q).bitwiseXOR(_digest(salt, F.col("k"), upto(F.greatest(i, F.lit(1))))))
    words = lambda i: F.col("words") + F.aggregate(F.slice("turns", 1, i), F.lit(0).cast("long"), lambda a, t: a + t.w)
    turn = F.transform("turns", lambda t, i: F.struct(
        (F.col("k") * BLOCK + i + 1).alias("depth"), step(11, "q1", i + 1).alias("d1"), step(12, "q2", i + 1).alias("d2"),
        step(11, "q1", i).alias("p1"), step(12, "q2", i).alias("p2"), words(i).alias("before"), t.w.alias("w"), (i + 1 == F.size("turns")).alias("at_end")))
    return groups.select(*carried, F.inline(turn))


def _refined(nodes: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Nodes of blocks with siblings, the same turn boundary of several groups brought together."""
    return nodes.groupBy("depth", *LANES).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("before").alias("before"), F.first("w").alias("w"), *[c.alias(k) for k, c in sums.items()])


def id_hashes(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, sha): hash of the ascending, comma-joined ids (c) at each key.

    Ids are joined in chunks of one id range; the chunks of a key then stream through one hash in order, so a key with
    most of the conversations costs a task its chunks' bytes in time and one chunk in memory.
    """
    chunk = F.floor(F.col("c") / CHUNK)
    parts = ends.groupBy("depth", *LANES, chunk.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids"))
    keyed = parts.repartition("depth", *LANES).sortWithinPartitions("depth", *LANES, "chunk")
    schema = pa.schema([("depth", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sha", pa.string())])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for *at, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if at == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
            if out:
                yield _batch(out, schema)
        if key is not None:
            yield _batch([(*key, state.hexdigest())], schema)

    return keyed.select("depth", *LANES, "chunk", "ids").mapInArrow(hashed, "depth long, d1 long, d2 long, sha string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def prefix_trie(
    turns: DataFrame, family: int = 20, heads_of: int = 4, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns are ordered by ``turn``, null first; equal numbers by role, then digest. Null roles
    and texts are empty. Rows with a null conversation belong to none and are left out; a repeated row is one more
    turn. A conversation that ends up without turns is a member of the root alone. An empty table has no nodes. Texts of any length count whole; other columns
    are not read.
    """
    ready(turns.sparkSession)
    rows, convs = rebuilt_rows(stored(turn_rows(turns, conv, turn, role, text), "placed"), family, heads_of)
    blocks = stored(block_rows(rows, convs), "blocks")
    key = ["k", "q1", "q2", *LANES]
    groups = blocks.groupBy(*key).agg(
        F.first("turns").alias("turns"), F.first("words").alias("words"), F.min("c").alias("low"), F.count(F.lit(1)).alias("n"),
        F.count_if("last").alias("n_last"))
    siblings = groups.groupBy(F.col("k").alias("_k"), F.col("q1").alias("_q1"), F.col("q2").alias("_q2")).agg(F.count(F.lit(1)).alias("n_groups"))
    groups = groups.join(siblings, (F.col("k") == F.col("_k")) & (F.col("q1") == F.col("_q1")) & (F.col("q2") == F.col("_q2"))).drop("_k", "_q1", "_q2")
    groups = stored(groups, "groups")
    alone = F.col("n_groups") == 1

    # members and smallest member of every node; from them, where each conversation leaves the paths of smaller ones
    shape = ["depth", *LANES, "p1", "p2", "before", "w", "low", "n"]
    plain = _nodes(groups.where(alone), ["low", "n"]).select(*shape)
    fine = _refined(_nodes(groups.where(~alone), ["low", "n"]), {"low": F.min("low"), "n": F.sum("n")}).select(*shape)
    top = convs.agg(F.min("c").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 0")
    zero = F.lit(0).cast("long")
    top = top.select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")],
                     zero.alias("before"), zero.alias("w"), "low", "n")
    nodes = plain.unionByName(fine).unionByName(top)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["depth", *LANES], "left").na.fill(0, ["n_children"]), "nodes")

    owners = nodes.groupBy(F.col("low").alias("c")).agg(
        F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    total = blocks.where("last").select("c", (F.col("words") + F.aggregate("turns", zero, lambda a, t: a + t.w)).alias("all_words"))
    whole = convs.select("c").join(total, "c", "left").join(owners, "c", "left")
    # a conversation equal to a smaller one owns no node: all its words are repeated
    whole = whole.select("c", F.coalesce("shared", "all_words", zero).alias("shared"), F.coalesce("leaf", zero).alias("leaf"))
    whole = stored(whole, "owners")
    shares = blocks.select("c", *key).join(whole, "c").groupBy(*key).agg(
        F.sum("shared").alias("shared"), F.min_by("shared", "c").alias("low_shared"), F.sum("leaf").alias("leaves"))
    full = groups.join(shares, key)

    # words of members' turns that a smaller conversation has already, at and below each node
    saved = (F.col("shared") - F.col("low_shared")) - (F.col("n") - 1) * F.col("before") + F.greatest(F.col("low_shared") - F.col("before"), zero)
    carried = ["n", "shared", "low_shared", "leaves", "n_groups"]
    below = _nodes(full, carried).withColumn("saved", saved)
    plain = below.where(alone).select("depth", *LANES, "saved", "leaves")
    fine = below.where(~alone).groupBy("depth", *LANES).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    top = whole.agg(F.sum("shared").alias("saved"), F.sum("leaf").alias("leaves"), F.count(F.lit(1)).alias("n")).where("n > 0")
    top = top.select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "saved", "leaves")
    sums = plain.unionByName(fine).unionByName(top)

    ends = blocks.where("last").select((F.col("k") * BLOCK + F.size("turns")).alias("depth"), *LANES, "c")
    ends = ends.unionByName(convs.where("n = 0").select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "c"))
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("low").alias("parent"))
    out = nodes.join(sums, ["depth", *LANES]).join(id_hashes(ends), ["depth", *LANES], "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
