"""Sharding by balanced label propagation: DataFrame operations only.

Linked documents start in any shard and move towards the one in which most of their neighbours are, as far as
its quota or an exchange allows; documents without links fill every shard to its exact share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlake.llm.common import join_counted, materialize, rank_within


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _case(shard: Column, values: list[int]) -> Column:
    """One value for each shard; the number of shards is small and fixed."""
    return F.element_at(F.array(*map(F.lit, values)), shard.cast("int") + 1)


def _shard_at(place: Column, ends: list[int]) -> Column:
    return sum(((place >= end).cast("int") for end in ends[:-1]), F.lit(0))


def _ends(shares: list[int], total: int) -> list[int]:
    """Where the parts of ``total`` end that are in proportion to ``shares``."""
    rows, ends, upto = max(sum(shares), 1), [], 0
    for share in shares:
        upto += share
        ends.append(upto * total // rows)
    return ends


def _loads(state: DataFrame, shards: int) -> list[int]:
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [load.get(s, 0) for s in range(shards)]


def _fill(nodes: DataFrame, sizes: list[tuple[int, int]], quotas: list[int]) -> DataFrame:
    """(node, first_hub, shard) for the nodes of hubs (hub, size) beyond a quota: they fill one shard after another.

    There are fewer such hubs than shards for each hub that a node may have.
    """
    starts, at = [], 0
    for hub, size in sizes:
        starts.append((hub, at))
        at += size
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("first_hub"))
    ranked = rank_within(nodes, "first_hub", ["node"], F.xxhash64("node"), at, "turn")
    return ranked.select("node", "first_hub", _shard_at(start + F.col("turn"), _ends(quotas, sum(quotas))).alias("shard"))


def _start(links: DataFrame, quotas: list[int]) -> DataFrame:
    """(node, first_hub, shard): every node where its hash puts it, in proportion to the quotas, and none beyond them.

    Only hubs that no shard can hold are dealt whole, before all others.
    """
    nodes = materialize(links.groupBy("node").agg(F.min("hub").alias("first_hub")), "nodes")
    shards, room = len(quotas), list(quotas)
    large = nodes.groupBy("first_hub").agg(F.count("*").alias("n")).filter(F.col("n") > max(*quotas, 0)).orderBy("first_hub").collect()
    filled = None
    rest = nodes
    if large:
        of_large = F.col("first_hub").isin([r["first_hub"] for r in large])
        filled = materialize(_fill(nodes.filter(of_large), [(r["first_hub"], r["n"]) for r in large], quotas), "filled")
        room = [q - n for q, n in zip(quotas, _loads(filled, shards), strict=True)]
        rest = nodes.filter(~of_large)
    place = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30))
    state = materialize(rest.select("node", "first_hub", _shard_at(place, _ends(room, 1 << 30)).cast("int").alias("shard")), "shards")
    loads = _loads(state, shards)
    if any(n > r for n, r in zip(loads, room, strict=True)):  # little room: exact shares by rank
        total = sum(loads)
        ranked = rank_within(rest.withColumn("all_", F.lit(0)), "all_", ["node"], F.xxhash64("node", F.lit(7)), total, "turn")
        state = materialize(ranked.select("node", "first_hub", _shard_at(F.col("turn"), _ends(room, total)).cast("int").alias("shard")), "shards")
    return state if filled is None else materialize(state.unionByName(filled.withColumn("shard", F.col("shard").cast("int"))), "shards")


def _deal(nodes: DataFrame, total: int, room: list[int]) -> DataFrame:
    """(node, first_hub, shard): whole hubs one after another, in proportion to the room of each shard.

    Hubs are placed by a running sum of their sizes, so only a hub across the end of a shard is cut, and
    only its nodes are ranked.
    """
    ends = _ends(room, total)
    buckets = max(64, min(1 << 20, -(-total // 2_000)))
    sizes = nodes.groupBy("first_hub").agg(F.count("*").alias("size")).withColumn("bucket", F.pmod(F.xxhash64("first_hub"), F.lit(buckets)).cast("int"))
    sizes = materialize(sizes, "hubs")
    sums = sizes.groupBy("bucket").agg(F.sum("size").alias("n")).withColumn("all_", F.lit(0))
    earlier = F.sum("n").over(Window.partitionBy("all_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("bucket", F.coalesce(earlier, F.lit(0)).alias("start"))
    inside = F.sum("size").over(Window.partitionBy("bucket").orderBy("first_hub").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, "bucket").withColumn("start", F.col("start") + F.col("inside"))
    placed = placed.select("first_hub", "size", "start", _shard_at(F.col("start"), ends).alias("low"), _shard_at(F.col("start") + F.col("size") - 1, ends).alias("high"))
    dealt = materialize(join_counted(nodes, materialize(placed, "placed"), "first_hub", "size", total), "dealt")
    cut = rank_within(dealt.filter("low <> high"), "first_hub", ["node"], F.xxhash64("node"), total, "turn")
    cut = cut.select("node", "first_hub", _shard_at(F.col("start") + F.col("turn"), ends).alias("shard"))
    return dealt.filter("low = high").select("node", "first_hub", F.col("low").alias("shard")).unionByName(cut)


def _allowed(wanted: dict[tuple[int, int], int], room: list[int], exchange: bool) -> list[int]:
    """How many may go from each shard to each other: as many as come back, where exchanged, and what there is room for."""
    shards, left, out = len(room), list(room), []
    for a in range(shards):
        for b in range(shards):
            n = wanted.get((a, b), 0)
            back = min(n, wanted.get((b, a), 0)) if exchange else 0
            more = min(n - back, left[b])
            left[b] -= more
            out.append(back + more)
    return out


def _votes(links: DataFrame, state: DataFrame) -> tuple[DataFrame, int, int]:
    """Each hub's nodes by shard and in all, how many ordered pairs of neighbours are together (what every round must raise), and all links."""
    votes = materialize(links.join(state, "node").groupBy("hub", "shard").agg(F.count("*").alias("votes")), "votes")
    n = F.col("votes").cast("decimal(18,0)")
    sums = votes.agg(F.sum(n * n).alias("together"), F.sum("votes").alias("members")).first()
    return votes.withColumn("members", F.sum("votes").over(Window.partitionBy("hub"))), int(sums["together"] or 0), int(sums["members"] or 0)


def _round(links: DataFrame, state: DataFrame, votes: DataFrame, members: int, quotas: list[int], exchange: bool, turn: int) -> tuple[DataFrame | None, int, bool]:
    """The nodes with their shards after one round of moves (None if none may move), how many moved, and whether any more would like to."""
    shards = len(quotas)
    room = [max(0, q - n) for q, n in zip(quotas, _loads(state, shards), strict=True)]
    if not exchange and not any(room):
        return None, 0, True
    offers = join_counted(links, votes, "hub", "members", members).groupBy("node", "shard").agg(F.sum("votes").alias("votes"))
    choice = offers.withColumnRenamed("shard", "to").join(state, "node")
    if not exchange:  # a node's own shard stays open to it; the others only while they have room
        choice = choice.filter((F.col("to") == F.col("shard")) | (_case(F.col("to"), room) > 0))
    tie = F.pmod(F.xxhash64("first_hub", "to", F.lit(turn)), F.lit(1 << 20))
    best = choice.groupBy("node").agg(F.max_by(F.struct("to", "shard", "first_hub"), F.struct(F.col("votes"), tie)).alias("b"))
    way = (F.col("shard") * shards + F.col("to")).alias("way")
    movers = materialize(best.select("node", "b.to", "b.shard", "b.first_hub").filter("to <> shard").select("node", "to", "first_hub", way), "movers")
    wanted = {(r["way"] // shards, r["way"] % shards): r["n"] for r in movers.groupBy("way").agg(F.count("*").alias("n")).collect()}
    allowed = _allowed(wanted, room, exchange)
    if not any(allowed):
        return None, 0, bool(wanted) or not all(room)
    going = movers.filter(_case(F.col("way"), allowed) > 0)
    if any(n > allowed[a * shards + b] > 0 for (a, b), n in wanted.items()):
        ranked = rank_within(going, "way", [F.xxhash64("first_hub"), "node"], F.xxhash64("first_hub"), sum(wanted.values()), "turn", within=F.xxhash64("node"))
        going = ranked.filter(F.col("turn") < _case(F.col("way"), allowed))
    moved = going.select("node", F.col("to").alias("moved"))
    after = materialize(state.join(moved, "node", "left").select("node", "first_hub", F.coalesce("moved", "shard").cast("int").alias("shard")), "shards")
    return after, sum(min(n, allowed[a * shards + b]) for (a, b), n in wanted.items()), True


def _mended(links: DataFrame, state: DataFrame, votes: DataFrame, quotas: list[int]) -> DataFrame | None:
    """Hubs that a shard could hold and that are still apart, dealt whole into the room that they leave; None if there are none."""
    apart = votes.groupBy("hub").agg(F.count("*").alias("shards"), F.max("members").alias("n")).filter((F.col("shards") > 1) & (F.col("n") <= max(quotas)))
    pool = materialize(state.join(apart.select(F.col("hub").alias("first_hub")), "first_hub", "left_semi").select("node", "first_hub"), "apart")
    total = pool.count()
    if not total:
        return None
    others = state.join(pool.select("node"), "node", "left_anti")
    room = [max(0, q - n) for q, n in zip(quotas, _loads(others, len(quotas)), strict=True)]
    dealt = _deal(pool, total, room).select("node", "first_hub", F.col("shard").cast("int").alias("shard"))
    return materialize(others.select("node", "first_hub", "shard").unionByName(dealt), "shards")


def propagate(links: DataFrame, quotas: list[int], history: list[dict[str, int]] | None = None) -> DataFrame:
    """(node, shard) for the nodes in ``links`` (node long, hub long), never more in a shard than its quota.

    Nodes of one hub are neighbours of each other; a hub stands for all their pairs, so a hub of any size
    costs as many rows as it has nodes. A node may have several hubs. All nodes start where their hash puts them (a hub that
    no shard can hold fills one after another). Each round counts, for every hub, its nodes by shard, lets each node prefer
    the shard with most neighbours, and takes as many movers as there is room for, whole hubs one after another; where room
    brings no neighbours together any more, shards exchange as many nodes as want to go either way. When neither does,
    hubs that are still apart for want of room are dealt into the room that they leave, if that brings more together.
    ``history`` gets for each step how many nodes moved and how many ordered pairs of neighbours are then together.
    """
    state = _start(links, quotas)
    votes, together, members = _votes(links, state)
    steps = history if history is not None else []
    steps.append({"moved": 0, "together": together})
    exchange, turn, failed = False, 0, 0
    while True:
        moved, n, more = _round(links, state, votes, members, quotas, exchange, turn)
        turn += 1
        if moved is not None:
            new_votes, new_together, _ = _votes(links, moved)
            if new_together > together:
                steps.append({"moved": n, "together": new_together})
                state, votes, together, exchange, failed = moved, new_votes, new_together, False, 0
                continue
        if not more or exchange and failed:
            break
        failed += exchange  # another turn breaks ties in another way, once
        exchange = True
    mended = _mended(links, state, votes, quotas) if more else None
    if mended is not None:
        _, new_together, _ = _votes(links, mended)
        if new_together > together:
            steps.append({"moved": mended.join(state.withColumnRenamed("shard", "was"), "node").filter("shard <> was").count(), "together": new_together})
            state = mended
    return state.select("node", "shard")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row in one of ``shards`` shards.

    The law is ``rows``: counts of any two shards differ by one at most. Rows with equal texts are linked
    and go to one shard as far as quotas allow; a group larger than a shard fills one shard after another.
    Size is the text's UTF-8 bytes plus 1. Null texts have size 1 and are linked with nothing; empty texts
    are equal texts. Repeated rows and null or repeated ids each get their own slot; slots count from 0
    in each shard without gaps. An empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(text, F.octet_length(text))).alias("hub"),
    )
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()), "rows")  # numbers hold once written
    n = rows.count()
    quotas = _quotas(n, shards)
    groups = materialize(rows.filter("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    links = materialize(join_counted(rows.select("node", "hub"), groups, "hub", "n", n).select("node", "hub"), "links")
    linked = materialize(propagate(links, quotas), "linked")
    load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, total = [], 0
    for s, q in enumerate(quotas):
        total += q - load.get(s, 0)
        ends.append(total)
    free = rows.join(linked.select("node"), "node", "left_anti").select("node", F.lit(0).alias("all_"))
    ranked = rank_within(free, "all_", ["node"], F.xxhash64("node"), max(total, 1), "place")
    shard = F.lit(0)
    for end in ends[:-1]:
        shard = shard + (F.col("place") >= end).cast("int")
    placed = linked.select("node", F.col("shard").cast("int").alias("shard")).unionByName(ranked.select("node", shard.cast("int").alias("shard")))
    slotted = rank_within(materialize(placed, "placed"), "shard", ["node"], F.xxhash64("node"), n, "slot")
    return rows.join(slotted, "node").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cut_links(sharded: DataFrame, links: DataFrame, hub_col: str = "hub", shard_col: str = "shard") -> DataFrame:
    """For each hub, its members and how many of them are outside its largest shard."""
    counts = sharded.join(links, "node").groupBy(hub_col, shard_col).agg(F.count("*").alias("n"))
    return counts.groupBy(hub_col).agg(F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("outside"))
