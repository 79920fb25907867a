"""Shards by balanced label propagation: copies meet in a shard, and counts stay at most one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import free_name, numbered, staged

#: Propagation ends after so many rounds in a row that gain nothing. Balance holds after any round.
PATIENCE = 3

#: Requests that are put in order at once, about.
RUN_ROWS = 100_000


def text_key(text: Column) -> Column:
    """Equal for equal texts (null as empty)."""
    return F.md5(F.coalesce(text, F.lit("")))


def exchanged(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How much of what is asked from shard to shard can move at once, so that no shard gets more than its room.

    Opposite moves go first, then longer circles, which all keep the counts, then moves into room, and into what they leave.
    """
    left, out = dict(asked), {}
    for s, t in asked:
        out.setdefault(s, []).append(t)

    def take(edges: list[tuple[int, int]], n: int) -> None:
        for e in edges:
            left[e] -= n

    for s, t in asked:
        if s < t and (t, s) in left:
            take([(s, t), (t, s)], min(left[s, t], left[t, s]))
    ended: set[int] = set()
    for start in out:
        path = [] if start in ended else [start]
        while path:
            s = path[-1]
            t = next((t for t in out.get(s, []) if t not in ended and left[s, t] > 0), None)
            if t is None:
                ended.add(path.pop())
            elif t in path:
                circle = [*path[path.index(t) :], t]
                edges = list(zip(circle, circle[1:]))
                take(edges, min(left[e] for e in edges))
                path = path[: path.index(t) + 1]
            else:
                path.append(t)
    room, into = list(room), {}
    for s, t in asked:
        into.setdefault(t, []).append(s)
    open_ = [t for t in into if room[t] > 0]
    while open_:
        t = open_.pop()
        for s in into.get(t, []):
            n = min(left[s, t], room[t])
            if n > 0:
                take([(s, t)], n)
                room[t] -= n
                room[s] += n
                open_.append(s)
    return {e: asked[e] - left[e] for e in asked}


def planned(held: dict[int, dict[int, int]], quotas: list[int]) -> tuple[dict[int, dict[int, int]], list[bool]]:
    """How many members of each large group (its members by shard are given) each shard shall have, and which shards that fills.

    Largest groups first: whole into the shard with most of their members that can take them, or else where most fits.
    """
    left, goals = list(quotas), {}
    for group in sorted(held, key=lambda g: (-sum(held[g].values()), g)):
        rest, goals[group] = sum(held[group].values()), {}
        while rest:
            t = max(range(len(left)), key=lambda t: (min(rest, left[t]), held[group].get(t, 0), -t))
            goals[group][t] = min(rest, left[t])
            rest -= goals[group][t]
            left[t] -= goals[group][t]
    return goals, [n == 0 for n in left] if any(left) else [False] * len(left)


def planned_moves(held: dict[int, dict[int, int]], goals: dict[int, dict[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """group, shard, target, n, members of the group: what is too much in one shard goes where it's missing."""
    out = []
    for group, own in held.items():
        missing = sorted((t, n - own.get(t, 0)) for t, n in goals[group].items() if n > own.get(t, 0))
        for s, n in sorted(own.items()):
            n -= goals[group].get(s, 0)
            while n > 0:
                t, m = missing.pop()
                out.append((group, s, t, min(n, m), sum(own.values())))
                if m > n:
                    missing.append((t, m - n))
                n -= m
    return out


def requests(state: DataFrame, full: list[bool], turn: int) -> DataFrame:
    """group, shard, target, n, held: what each group of ``state`` asks to move, and what it has at the target.

    The target is the shard with most of its members, less those in ``full``, which they all leave; equal ones, and in
    every other turn all by their squares, are drawn anew.
    """
    closed = F.get(F.array(*[F.lit(f) for f in full]), F.col("shard"))
    drawn = (F.pmod(F.xxhash64("group", "shard", F.lit(turn)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    order = [F.desc("n"), drawn] if turn % 2 == 0 else [-F.log(drawn) / (F.col("n") * F.col("n"))]
    own, first = Window.partitionBy("group"), Window.partitionBy("group").orderBy("closed", *order)
    others = [s for s, f in enumerate(full) if not f]
    other = F.get(F.array(*[F.lit(s) for s in others]), F.pmod(F.xxhash64("group", F.lit(-1 - turn)), F.lit(len(others))).cast("int"))
    ranked = state.withColumn("closed", closed).withColumn("places", F.count("*").over(own)).filter("places > 1 OR closed")
    ranked = ranked.withColumn("best", F.first(F.struct("closed", "shard", "n")).over(first))
    ranked = ranked.withColumn("target", F.when(F.col("best.closed"), other).otherwise(F.col("best.shard")))
    return ranked.filter("shard != target").select("group", "shard", "target", "n", F.col("best.n").alias("held"))


def propagated(start: DataFrame, quotas: list[int]) -> DataFrame:
    """Where each group's members end: group, shard, n.

    ``start`` has these columns, one row for each group and shard that hold members of it: members of a group
    are all linked and stand for one another, so moving n of them is moving a number. In each round a
    group's members ask to move to the shard with most of their neighbours; for groups with a quarter of a quota, of which there
    are a few for each shard, the shards are planned, so that they don't ask for the same. What can move between two shards is
    granted in the same order everywhere, to whole requests as long as it lasts. ``start`` keeps the quotas. The rounds
    end when no more links are gained; the one with the fewest cut links counts.
    """
    state = best = staged(start)
    linked = lambda df: df.agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("n"))).first()[0] or 0
    large = staged(state.groupBy("group").agg(F.sum("n").alias("total")).filter(F.col("total") * 4 >= max(quotas)).select("group"))

    def held() -> dict[int, dict[int, int]]:
        out: dict[int, dict[int, int]] = {}
        for r in state.join(F.broadcast(large), "group").collect():
            out.setdefault(r["group"], {})[r["shard"]] = r["n"]
        return out

    goals, full = planned(held(), quotas)
    most, turn, idle = linked(state), 0, 0
    while idle < PATIENCE:
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        moves = requests(state.join(F.broadcast(large), "group", "left_anti"), full, turn)
        if goals:
            moves = moves.unionByName(state.sparkSession.createDataFrame(planned_moves(held(), goals), "group long, shard int, target int, n long, held long"))
        moves = staged(moves)
        runs = 1 + moves.count() // (RUN_ROWS * len(quotas))
        moves = moves.withColumn("run", F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(runs)))
        sums = sorted((r["shard"], r["target"], r["run"], r["n"]) for r in moves.groupBy("shard", "target", "run").agg(F.sum("n").alias("n")).collect())
        asked: dict[tuple[int, int], int] = {}
        for s, t, _, n in sums:
            asked[s, t] = asked.get((s, t), 0) + n
        if not asked:
            break
        granted, parts = exchanged(asked, [max(0, q - load.get(s, 0)) for s, q in enumerate(quotas)]), []
        for s, t, run, n in sums:
            parts.append((s, t, run, min(n, granted[s, t])))
            granted[s, t] -= parts[-1][3]
        part = state.sparkSession.createDataFrame([p for p in parts if p[3]] or parts[:1], "shard int, target int, run long, part long")
        order = Window.partitionBy("shard", "target", "run").orderBy(F.desc("held"), F.xxhash64("group", F.lit(turn)), "group")
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        met = moves.join(F.broadcast(part), ["shard", "target", "run"]).withColumn("before", F.coalesce(before, F.lit(0)))
        met = staged(met.withColumn("n", F.least("n", F.col("part") - F.col("before"))).filter("n > 0").select("group", "shard", "target", "n"))
        change = met.select("group", "shard", (-F.col("n")).alias("n")).unionByName(met.select("group", F.col("target").alias("shard"), "n"))
        state = staged(state.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        links, turn, idle = linked(state), turn + 1, idle + 1
        if links > most:
            best, most, idle = state, links, 0
    return best


def sharded(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size (UTF-8 bytes and 16), text_crc32, law ``rows``, shard, slot (gapless from 0) and grown_shard (null).

    Counts of shards are at most one apart. Documents with equal texts are linked: they start at the hash of
    their row and propagate; the others fill what the quotas leave. Null texts count as empty ones, repeated
    rows as documents of their own. More copies than a quota take several shards. Of a text only its size and
    hashes are kept, so its length doesn't matter; an empty table gives an empty result; other columns are left out.
    """
    group, spot = "group", F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(f"`{key}`").alias("_key"),
            (F.octet_length(spot) + 16).cast("long").alias("size"),
            F.crc32(spot).alias("text_crc32"),
            text_key(F.col(f"`{text}`")).alias(group),
        )
    )
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    copies = rows.groupBy(group).agg(F.count("*").alias("copies")).filter("copies > 1")
    marked = staged(rows.join(copies, group, "left"))
    # Number members within their group, and all others as group 0, without gathering either.
    member = marked.withColumn("_number", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.xxhash64(group).bitwiseOR(F.lit(1).cast("long"))))
    order = numbered(member, "_number", "_place")
    linked = order.filter(F.col("copies").isNotNull())
    scattered = linked.groupBy(F.col("_number").alias("group"), F.pmod(F.xxhash64("_place", "_number"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    state = propagated(within(scattered, quotas), quotas)
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # Each group: the numbers of its members at which the next shard begins.
    run = Window.partitionBy("group").orderBy("shard")
    ends = state.withColumn("end", F.sum("n").over(run))
    spans = ends.groupBy(F.col("group").alias("_number")).agg(F.sort_array(F.collect_list(F.struct("end", F.col("shard").cast("int").alias("shard")))).alias("spans"))
    placed = linked.join(spans, "_number").withColumn("shard", F.filter("spans", lambda x: x["end"] > F.col("_place"))[0]["shard"]).withColumn("_shard", F.col("shard").cast("long"))
    columns = ["_key", "size", "text_crc32", "shard", "slot"]
    settled = numbered(placed.select("_key", "size", "text_crc32", "shard", "_shard"), "_shard", "slot").select(columns)
    # The others by number: shard s takes as many as its quota leaves.
    free = [q - load.get(s, 0) for s, q in enumerate(quotas)]
    begin = [sum(free[:s]) for s in range(shards)]
    single = order.filter(F.col("copies").isNull())
    spot = F.filter(F.array(*[F.struct(F.lit(begin[s]).cast("long").alias("begin"), F.lit(free[s]).cast("long").alias("n"), F.lit(s).alias("shard"), F.lit(load.get(s, 0)).cast("long").alias("base")) for s in range(shards)]), lambda x: (F.col("_place") >= x["begin"]) & (F.col("_place") < x["begin"] + x["n"]))[0]
    single = single.withColumn("_spot", spot).withColumn("shard", F.col("_spot.shard")).withColumn("slot", F.col("_spot.base") + F.col("_place") - F.col("_spot.begin"))
    out = settled.unionByName(single.select(columns))
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def within(scattered: DataFrame, quotas: list[int]) -> DataFrame:
    """A start that keeps the quotas: a shard over its quota keeps that part of each group, rounded down; the rest goes round robin."""
    scattered = staged(scattered)
    load = {r["shard"]: r["n"] for r in scattered.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = {s: n for s, n in load.items() if n > quotas[s]}
    if not over:
        return scattered
    part = F.array(*[F.lit(quotas[s] / over[s] if s in over else 1.0) for s in range(len(quotas))])
    kept = scattered.withColumn("kept", F.floor(F.col("n") * F.get(part, F.col("shard"))))
    base = kept.select("group", "shard", F.col("kept").alias("n"))
    rest = numbered(kept.filter("n > kept").select("group", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("kept"))).alias("_one"), F.lit(0).cast("long").alias("_all")), "_all", "_place")
    held = {r["shard"]: r["n"] for r in base.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [quotas[s] - held.get(s, 0) for s in range(len(quotas))]
    begin = [sum(free[:s]) for s in range(len(quotas))]
    spot = F.filter(F.array(*[F.struct(F.lit(begin[s]).alias("begin"), F.lit(free[s]).alias("n"), F.lit(s).alias("shard")) for s in range(len(quotas))]), lambda x: (F.col("_place") >= x["begin"]) & (F.col("_place") < x["begin"] + x["n"]))[0]["shard"]
    return base.unionByName(rest.select("group", spot.alias("shard"), F.lit(1).cast("long").alias("n"))).groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
