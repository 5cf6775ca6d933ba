"""All pairs of vectors of a least cosine, exactly: cells around centres, with the margin that no pair can cross.

Of two unit vectors at a distance of at most r, both lie within r / 2 of their midpoint.  A vector
is put into every cell (of the nearest of some centres) that a point within r / 2 of it can
belong to, so each pair meets in the cell of its midpoint.  The centres decide the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.vectors import unit_rows, usable
from corpuscle.session import shared_table, sized_broadcast

#: Most rows that the centres are taken from; cells of more than BLOCK_ROWS are cut into blocks, of which every two meet.
SAMPLE_ROWS = 16_384
BLOCK_ROWS = 8_192
#: Groups of copies with over this share of all rows (and over HOT_ROWS) meet their rows by broadcast: fewer than 1 / HOT_SHARE exist.
HOT_SHARE = 0.001
HOT_ROWS = 10_000
#: Rounding of scores (digits), and what single precision may be off.
DIGITS, SLACK = 9, 1e-5


def spread_centres(sample: np.ndarray, least: float) -> np.ndarray:
    """Vectors of the sample none of which has a cosine of ``least`` or more with an earlier one that is kept."""
    left, kept = np.arange(len(sample)), []
    while len(left):
        block, near = left[:256], []
        inside = sample[block] @ sample[block].T
        for i in range(len(block)):
            if not near or inside[i, near].max() < least:
                near.append(i)
        chosen = block[near]
        kept.append(chosen)
        left = left[256:]
        left = left[(sample[left] @ sample[chosen].T).max(axis=1) < least]
    return sample[np.concatenate(kept)] if kept else sample


def _cells(centres: np.ndarray, width: int, reach: float):
    """Task function over (row, vector): the cells that a point within ``reach`` of the unit vector can lie in."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, rows, found = unit_rows(batch.column(1), width).astype(np.float32), [], []
            for start in range(0, len(unit), 512):
                cos = unit[start : start + 512] @ centres.T
                home = cos.argmax(axis=1)
                best = cos[np.arange(len(cos)), home]
                # Centres are at most 2 apart; the distance to the plane between two cells decides.
                at, cell = np.nonzero(cos >= (best - 2 * reach - SLACK)[:, None])
                apart = np.linalg.norm(centres[home[at]] - centres[cell], axis=1)
                inside = best[at] - cos[at, cell] <= reach * apart + SLACK
                rows.append(at[inside] + start)
                found.append(cell[inside])
            at = pa.array(np.concatenate(rows))
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found).astype(np.int32))], names=["row", "vector", "cell"])

    return cells


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, place) links that connect the same places as the links a - b, one fewer than each component has."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, low[a], least)
        np.minimum.at(after, low[b], least)
        after = after[after]
        if (after == low).all():
            break
        low = after
    place = np.flatnonzero(low != np.arange(n))
    return low[place], place


def _pairs_of_unit(width: int, least: float, links_only: bool):
    """Group function over (row, vector, side): the pairs between the two sides, or within the one."""

    def pairs(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("row")  # rows arrive in any order; the links must not depend on it
        rows, exact, side = unit.column("row").to_numpy(), unit_rows(unit.column("vector"), width), unit.column("side").to_numpy()
        single = exact.astype(np.float32)
        ones = np.arange(len(rows)) if (side == side[0]).all() else np.flatnonzero(side == side.min())
        others = ones if len(ones) == len(rows) else np.flatnonzero(side == side.max())
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0, len(ones), 512):
            own = ones[start : start + 512]
            i, j = np.nonzero(single[own] @ single[others].T >= least - SLACK)
            i, j = own[i], others[j]
            fresh = rows[i] < rows[j] if others is ones else rows[i] != rows[j]
            i, j = i[fresh], j[fresh]
            for at in range(0, len(i), 100_000):
                x, y = i[at : at + 100_000], j[at : at + 100_000]
                true = np.round(np.einsum("ij,ij->i", exact[x], exact[y]), DIGITS) >= least
                a.append(x[true])
                b.append(y[true])
            if links_only:
                a, b = ([p] for p in _forest(np.concatenate(a), np.concatenate(b), len(rows)))
        x, y = rows[np.concatenate(a)], rows[np.concatenate(b)]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return pairs


def _copies(marks: DataFrame, total: int) -> DataFrame:
    """(a, b): each row but the first of its group of identical vectors, with the first."""
    groups = marks.groupBy("h", "check").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    is_hot, key = F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE)), ["h", "check"]
    hot = sized_broadcast(groups.where(is_hot), int(1 / HOT_SHARE))
    cold = marks.join(hot.select(*key), key, "left_anti").join(groups.where(~is_hot), key)
    return cold.unionByName(marks.join(hot, key)).where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))


def alike_vectors(df: DataFrame, row: str, vector: str, width: int, least: float, links_only: bool = False) -> DataFrame:
    """(a, b): every two different vectors of a cosine (to 9 decimals) of ``least`` or more, smaller row first, without a cap.

    Rows of identical vectors have the same partners: the first (smallest) stands for them in the
    pairs, and each other one comes with that first row once, so a vector that very many rows
    have makes a star and not all pairs.  Vectors that are null, of another length, not finite or all zero take no
    part.  With ``links_only`` each task sends on only links that connect the same rows, for groups.
    """
    named = df.select(F.col(row).cast("long").alias("row"), F.col(vector).alias("vector")).where(usable(F.col("vector"), width))
    marks = shared_table(named.select("row", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("check")))
    total = marks.count()
    copies = shared_table(_copies(marks, total))
    firsts = named.join(copies.select(F.col("b").alias("row")), "row", "left_anti")

    # Drawn by hash: about SAMPLE_ROWS of all rows, without a sort.
    chosen = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(max(1, total))) < SAMPLE_ROWS
    sample = firsts.where(chosen).select("vector").toArrow()
    unit = unit_rows(sample.column("vector"), width).astype(np.float32) if sample.num_rows else np.eye(1, width, dtype=np.float32)
    reach = (2 - 2 * least) ** 0.5 / 2
    centres = spread_centres(unit, 1 - 4 * (1 - least))

    placed = shared_table(firsts.mapInArrow(_cells(centres, width, reach), "row long, vector array<float>, cell int"))
    large = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = placed.join(sized_broadcast(large, SAMPLE_ROWS * 2), "cell", "left").withColumn("blocks", blocks)
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("row", F.lit(3)), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.select("cell", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "row", "vector")
    near = units.groupBy("cell", "low", "high").applyInArrow(_pairs_of_unit(width, least, links_only), "a long, b long")
    return near.unionByName(copies).distinct()
