"""Balanced label propagation: documents move towards their neighbours' shards under row quotas.

Documents are linked through hubs (equal texts share one).  Rows of one hub that start in one shard form a cell, and
only cells of hubs with several rows take part, so rounds work on counts, not on rows.  Every round lets a hub's cells
propose its fullest shard that has room, and accepts proposals, the largest hubs first (but those no shard can hold last), while
the target shard's quota lasts (its free room and what its own members ask to vacate).  A move brings cells of a hub
together and never parts any, so links within shards only grow, and rounds end when a round moves nothing.
A last pass evens the counts out exactly (at most one apart), moving unlinked documents first.

Quotas and numbering use running totals over a bounded table of (shard, bucket) counts, so no task
or driver sees all documents of a shard, nor all members of a hub.  Rows are written once with a number of their own, which
spreads rows that are alike in all columns over the buckets.

Rows: a null hub links to nothing.  Null and repeated ids are ordinary rows.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, number_within, stash

BUCKETS = 512
PIECE = 4096


def beside(nodes: DataFrame, cells: DataFrame, at: str, total: int, *columns: str) -> DataFrame:
    """nodes with `columns` of cells (hub, `at`, members, ...), null where there is no such cell.

    Hubs of more than a BUCKETS-th of all rows are fewer than BUCKETS, a row a shard each, and come by broadcast.  Their rows,
    and those without a hub, are dealt by their own numbers in the join with the other cells.
    """
    big, facts = F.col("members") * BUCKETS > total, F.struct(*columns)
    few = cells.where(big).select(F.col("hub").alias("hub1"), F.col(at).alias("at1"), facts.alias("few"))
    many = cells.where(~big).select(F.col("hub").alias("hub2"), F.col(at).alias("at2"), F.lit(-1).cast("long").alias("own2"), facts.alias("many"))
    near = nodes.join(F.broadcast(few), (F.col("hub") == F.col("hub1")) & (F.col(at) == F.col("at1")), "left")
    near = near.withColumn("own", F.when(F.col("few").isNull() & F.col("hub").isNotNull(), -1).otherwise(F.col("salt")))
    near = near.join(many, (F.col("hub") == F.col("hub2")) & (F.col(at) == F.col("at2")) & (F.col("own") == F.col("own2")), "left")
    found = F.coalesce("few", "many")
    return near.select(*nodes.columns, *[found.getField(c).alias(c) for c in columns])


def propagate(nodes: DataFrame, shards: int, rounds: int | None = None, slack: float = 0.25) -> DataFrame:
    """nodes (id, hub, salt, ...) with a column shard; rows of one hub together where quotas allow.

    Goes on until a round moves nothing, or for so many rounds.
    """
    total = nodes.count()
    room = max(1, int(total / shards * (1 + slack)))
    placed = nodes.withColumn("origin", F.pmod(F.xxhash64("id", "hub"), F.lit(shards)).cast("int"))
    rows = {r["origin"]: r["n"] for r in placed.groupBy("origin").agg(F.count("*").alias("n")).collect()}  # one row a shard
    now = stash(
        placed.where("hub is not null")
        .groupBy("hub", "origin")
        .agg(F.count("*").alias("n"))
        .withColumn("members", F.sum("n").over(Window.partitionBy("hub")))  # a row a shard at most
        .where("members > 1")
        .withColumn("shard", F.col("origin"))
    )
    first, together, turn = None, None, 0
    while True:
        held = now.groupBy("hub", "shard").agg(F.sum("n").alias("n"), F.first("members").alias("members"))
        square = F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
        found = held.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(square).alias("square")).collect()  # one row a shard
        linked, before, together = {r["shard"]: r["n"] for r in found}, together, sum(int(r["square"]) for r in found)
        first = linked if first is None else first
        if together == before or turn == rounds:
            break
        turn += 1
        sizes = {i: rows.get(i, 0) - first.get(i, 0) + linked.get(i, 0) for i in range(shards)}
        weight = F.when(F.col("shard").isin([i for i, n in sizes.items() if n >= room]), 0).otherwise(F.col("n"))  # a full shard draws no one
        best = held.groupBy("hub").agg(F.max(F.struct(weight.alias("w"), F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("b"))
        wish = (
            held.join(best, "hub")
            .where("shard <> b.shard and b.w > 0")
            .select("hub", "shard", "n", F.col("b.shard").alias("to"), "members")
        )
        # proposals in order of size class, then a hash bucket: a bounded table of running totals
        part = F.when(F.col("members") > room // 8, F.col("shard")).otherwise(-1)  # a large hub moves shard by shard
        size = F.when(F.col("members") > room, 41).otherwise(40 - F.floor(F.log2("members")))  # those no shard can hold go last
        wish = wish.withColumn("rank", size * BUCKETS + F.pmod(F.xxhash64("hub", part), F.lit(BUCKETS)))
        leave = wish.groupBy(F.col("shard").alias("from3")).agg(F.sum("n").alias("leave"))
        loads = nodes.sparkSession.createDataFrame(list(sizes.items()), "to int, held long")  # one row a shard
        loads = loads.join(leave, F.col("to") == F.col("from3"), "left").select("to", (F.col("held") - F.coalesce("leave", F.lit(0))).alias("load"))
        asked = wish.groupBy("to", "rank").agg(F.sum("n").alias("ask")).join(F.broadcast(loads), "to")
        upto = Window.partitionBy("to").orderBy("rank")
        granted = (
            asked.where(F.col("ask") + F.col("load") <= room)  # what can't fit holds up no one behind it
            .withColumn("upto", F.sum("ask").over(upto))
            .where(F.col("upto") + F.col("load") <= room)
            .select(F.col("to").alias("to2"), F.col("rank").alias("rank2"))
        )
        moves = wish.join(granted, (F.col("to") == F.col("to2")) & (F.col("rank") == F.col("rank2"))).select(
            F.col("hub").alias("hub2"), F.col("shard").alias("from2"), "to"
        )
        after = stash(
            now.join(moves, (F.col("hub") == F.col("hub2")) & (F.col("shard") == F.col("from2")), "left")
            .withColumn("shard", F.coalesce("to", "shard"))
            .drop("hub2", "from2", "to")
        )
        drop_stash(now)
        now = after
    return beside(placed, now, "origin", total, "shard").withColumn("shard", F.coalesce("shard", "origin")).drop("origin")


def even_out(nodes: DataFrame, shards: int) -> DataFrame:
    """nodes (id, hub, salt, shard, ...) with counts per shard at most one apart; salt tells rows of one id and hub apart.

    Rows that cost no link move first: unlinked ones (class 0), then members away from their hub's fullest shard or
    of hubs that no shard could hold (class 1), and only then others (class 2).  Of these the smallest hubs go first, each
    whole, or in pieces of about PIECE rows, so that a hub is parted at the ends of a shard's excess or lack alone.
    """
    total = nodes.count()
    target = [total // shards + (i < total % shards) for i in range(shards)]
    sizes = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    excess = [max(0, sizes.get(i, 0) - target[i]) for i in range(shards)]
    lack = [max(0, target[i] - sizes.get(i, 0)) for i in range(shards)]
    if not sum(excess):
        return nodes
    held = nodes.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    hub = Window.partitionBy("hub")  # a row a shard at most
    linked = held.select("hub", "shard", F.max(F.struct("n", (-F.col("shard")).alias("s"))).over(hub).alias("b"), F.sum("n").over(hub).alias("members"))
    linked = linked.where("members > 1").withColumn("home", -F.col("b.s"))
    kind = (
        F.when(F.col("home").isNull(), 0)
        .when((F.col("home") != F.col("shard")) | (F.col("members") > max(1, target[0])), 1)
        .otherwise(2)
    )
    ranked = beside(nodes, linked, "shard", total, "home", "members").withColumn("kind", kind)
    members = F.coalesce("members", F.lit(1))
    piece = F.pmod(F.xxhash64("id", "salt"), F.when(F.col("kind") == 2, F.ceil(members / PIECE)).otherwise(members))
    bucket = F.floor(F.log2(members)) * BUCKETS + F.pmod(F.xxhash64("hub", F.when(F.col("kind") == 0, F.xxhash64("id", "salt")).otherwise(piece)), F.lit(BUCKETS))
    numbered = number_within(ranked, ["shard", "kind"], ["hub", "id", "salt"], "at", bucket=bucket).drop("home", "members")
    free = {(r["shard"], r["kind"]): r["n"] for r in ranked.groupBy("shard", "kind").agg(F.count("*").alias("n")).collect()}
    mover, before = F.lit(None).cast("long"), 0
    for i in range(shards):
        one, two = free.get((i, 0), 0), free.get((i, 0), 0) + free.get((i, 1), 0)
        at = F.col("at") + F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, one).otherwise(two)
        mover = F.when((F.col("shard") == i) & (at < excess[i]), at + before).otherwise(mover)
        before += excess[i]
    to, end = F.col("shard"), sum(lack)
    for i in reversed(range(shards)):
        end -= lack[i]
        to = F.when((F.col("mover") >= end) & (F.col("mover") < end + lack[i]), F.lit(i)).otherwise(to)
    return numbered.withColumn("mover", mover).withColumn("shard", to.cast("int")).drop("mover", "at", "kind")


def assign(docs: DataFrame, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows, cut_links; rows of equal text share a shard where quotas allow.

    group_rows: rows with this text; cut_links: those of them in other shards, so half their sum is the number of cut
    edges.  Null text: size 1, the CRC of no bytes, no hub, a group of one.
    """
    text = F.col("text").cast("string")
    nodes = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("id"),
            F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("hub"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("salt"),
        )
    )
    near = stash(propagate(nodes, shards, rounds))
    spread = stash(even_out(near, shards))
    held = spread.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("here"))
    held = held.withColumn("members", F.sum("here").over(Window.partitionBy("hub"))).where("members > 1")  # a row a shard at most
    counted = beside(spread, held, "shard", spread.count(), "members", "here")
    return number_within(counted, ["shard"], ["id", "text_crc32", "salt"], "slot", BUCKETS).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.coalesce("members", F.lit(1)).alias("group_rows"),
        F.coalesce(F.col("members") - F.col("here"), F.lit(0)).alias("cut_links"),
    )
