"""Mixing sources to target weights by proportional-fair (Pfair) scheduling of blocks.

The mixture is a row of equal blocks.  A source of weight w releases its j-th block at
slot floor((j - 1) / w), with deadline ceil(j / w); of the released blocks the one with
the earliest deadline takes the next slot.  So each source is, at every point of the mixture,
less than one block away from its share.  The texts of a source fill its blocks in a fixed
pseudo-random order, pass after pass, until its share is reached or its passes are used up.

Blocks have a bounded size in tokens, so their number grows with the data.  Weights are multiples of
one part in CYCLE; such a schedule repeats itself after CYCLE blocks, when every source has exactly its
share, so one cycle is scheduled and Spark computes every other slot from it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import shared_table

#: Blocks of a cycle of the schedule, and tokens of a block: the least (small mixtures have fewer blocks) and the most (large ones more cycles).
CYCLE, LEAST_BLOCK, BLOCK_TOKENS = 4096, 2048, 65_536
#: About how many tokens are ordered by one task; a source's order is cut into parts of that size.
PART_TOKENS = 1 << 21
#: Most sources with a target; their plan is made in one place.
SOURCES = 10_000


def plain_source(source: Column) -> Column:
    """A source's name without case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def sized_sources(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): rows of one doc_id count as one text, with their largest size and least source."""
    sizes = counts.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return sizes.join(documents.groupBy("doc_id").agg(F.min("source").alias("source")), "doc_id")


def pfair_slots(blocks: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, source, block) for numbers of blocks by source; earliest deadline first among released blocks.

    Slots and blocks count from 0.  Ties of deadlines go to the heavier source, then to the name.
    """
    total = sum(blocks.values())
    waiting = [(0, source, 0) for source, n in sorted(blocks.items()) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // blocks[source]), -blocks[source], source, j))
        _, _, source, j = heapq.heappop(ready)
        out.append((slot, source, j))
        if j + 1 < blocks[source]:
            heapq.heappush(waiting, ((j + 1) * total // blocks[source], source, j + 1))
    return out


def _share_out(planned: dict[str, float], count: int) -> dict[str, int]:
    """``count`` blocks by largest remainder."""
    whole = sum(planned.values())
    exact = {s: count * p / whole for s, p in planned.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: count - sum(out.values())]:
        out[s] += 1
    return out


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, float]:
    """Tokens to take from each source for a mixture of ``total`` tokens.

    A source whose allowed passes are not enough for its share gives all of them; what it
    lacks is made up by the others in proportion to their targets, as far as they can.
    """
    limit = {s: float(sizes[s] * repeats) for s, (share, repeats) in targets.items() if sizes.get(s) and share > 0 and repeats > 0}
    out: dict[str, float] = {}
    while len(out) < len(limit):
        open_share = sum(targets[s][0] for s in limit if s not in out)
        rest = max(0.0, total - sum(out.values()))
        asked = {s: rest * targets[s][0] / open_share for s in limit if s not in out}
        short = {s: limit[s] for s in asked if asked[s] >= limit[s]}
        out |= short or asked
    return out


def mixture(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(slot, source, doc_id, use_no, n_tokens, start_token): the uses of texts, in the order of the mixture.

    ``texts`` has doc_id, source and n_tokens; ``targets`` source, target_share and
    max_repeats, at most SOURCES sources (more raise a ValueError).  Sources are compared without case and
    outer blanks.  The mixture is as large as all texts together; a source whose
    max_repeats passes are not enough gives all of them and the others make up for it
    (see ``plan``), and the report shows the shares reached.
    Texts without tokens, without source or without target are not used.  Order within the
    mixture: slot, then start_token (the place within the source's own sequence).
    """
    spark = texts.sparkSession
    plain = texts.select("doc_id", plain_source(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    sized = shared_table(plain.withColumn("key", F.xxhash64("source", "doc_id")))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    wanted = targets.groupBy(plain_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    given = wanted.where("source IS NOT NULL").limit(SOURCES + 1).collect()
    if len(given) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources with a target")
    goal = {r["source"]: (r["share"] or 0.0, r["repeats"] or 0) for r in given}
    bits = max(0, (int(total) // PART_TOKENS).bit_length())
    part = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    used = (sized.where(F.col("source").isin(*goal) & (F.col("n_tokens") > 0)) if goal else sized.limit(0)).withColumn("part", part)
    sums = shared_table(used.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens")))
    sizes = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("part_tokens").alias("n")).collect()}
    planned = plan(sizes, goal, total)
    cycle, cycles = schedule_size(planned)

    slots = spark.createDataFrame(pfair_slots(cycle), "in_cycle long, source string, place long")
    passes = spark.createDataFrame(
        [(s, float(p), sizes[s], cycle[s], cycle[s] * cycles, -int(-p // sizes[s])) for s, p in planned.items()],
        "source string, planned double, size long, in_each long, n_blocks long, passes int",
    )
    by_part, in_part = Window.partitionBy("source").orderBy("part"), Window.partitionBy("source", "part").orderBy("key", "doc_id")
    offsets = sums.select("source", "part", (F.sum("part_tokens").over(by_part) - F.col("part_tokens")).alias("offset"))
    placed = used.withColumn("inside", F.sum("n_tokens").over(in_part) - F.col("n_tokens"))
    # Offsets have a row for each part, so they grow with the data and are joined where the parts lie. Passes and
    # the slots of one cycle have at most SOURCES and CYCLE + SOURCES rows.
    sequence = placed.join(offsets, ["source", "part"]).join(F.broadcast(passes), "source")
    uses = sequence.withColumn("use_no", F.explode(F.sequence(F.lit(1), "passes")))
    start = (F.col("use_no") - 1) * F.col("size") + F.col("offset") + F.col("inside")
    taken = uses.withColumn("start_token", start).withColumn("middle", F.col("start_token") + F.col("n_tokens") / 2).where("middle < planned")
    block = F.least(F.floor(F.col("middle") * F.col("n_blocks") / F.col("planned")), F.col("n_blocks") - 1)
    cut = taken.withColumn("block", block).withColumns({"place": F.col("block") % F.col("in_each"), "turn": F.expr("block div in_each")})
    slot = F.col("turn") * sum(cycle.values()) + F.col("in_cycle")
    return cut.join(F.broadcast(slots), ["source", "place"]).select(slot.alias("slot"), "source", "doc_id", F.col("use_no").cast("long").alias("use_no"), "n_tokens", "start_token")


def schedule_size(planned: dict[str, float]) -> tuple[dict[str, int], int]:
    """Blocks of each source in one cycle, and the number of cycles; a source too small for a block of its own still gets one."""
    whole = int(sum(planned.values()))
    if not planned:
        return {}, 1
    cycle = _share_out(planned, max(1, min(CYCLE, whole // LEAST_BLOCK)))
    return {s: max(1, n) for s, n in cycle.items()}, max(1, -(-whole // (CYCLE * BLOCK_TOKENS)))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_tokens, share, most_uses): what the mixture has of each source of ``targets``."""
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("use_no").alias("most_uses"))
    wanted = targets.groupBy(plain_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(reached, "source", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    whole = F.sum("n_tokens").over(Window.partitionBy())
    return both.select(
        "source", "target_share", "n_tokens",
        F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0).alias("share"), F.coalesce("most_uses", F.lit(0)).cast("long").alias("most_uses"),
    )
