"""Most similar vectors for every vector: stable projections, kd-trees and a chi-square stopping test.

A Gaussian (2-stable) projection of a difference of length d has squared length d^2 times
a chi-square variable.  Each of a few trees has its own projection to a few dimensions and
a kd-tree over it whose split planes are fitted on a bounded sample; the leaves of the trees deal
the rows to tasks.  A leaf that gets too many rows is split further, by planes fitted on a bounded sample of
its own rows, as often as it takes: leaves do not grow with the table.  Rows of one direction, which no plane parts, are dealt to
parts of their leaf; each of them needs only the first few of the others, and all other rows of the leaf.  A row is put into those trees in whose leaf it lies deepest: there the
normal distribution of projected differences makes it most likely that its neighbours fall on the
same side of all planes, and close rows prefer the same trees.  Within a leaf a finer kd-tree
gives the projected neighbours in waves of buckets, the nearest first; every vector goes on, by itself, until the
projected distance of each bucket left fails the chi-square test against the distance of its k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.format_copies import collapse_copies, join_groups
from corpuscle.session import shared_table, sized_broadcast


#: Levels that one round adds to a leaf of too many rows, sampled rows for each part, and how many rows are too many (times ``leaf_rows``).
MORE_LEVELS, PART_SAMPLE, OVERFULL = 7, 32, 2
#: Rounds at most: beyond them a leaf holds nothing but equal directions, which no plane parts.
ROUNDS = 6
#: Buckets that a wave of the search verifies.
WAVE = 6
#: Greatest distance of two unit vectors in one cell of directions: their cosine is 1 to 9 decimals. Rows from which a cell is crowded.
CELL, CROWDED = 3e-5, 256
#: Parts of a leaf whose results for a row are put together first.
PARTS = 1024
#: How far apart single precision may put two equal cosines; about how many candidates are ranked exactly at once.
TIED, EXACT_PAIRS = 4e-6, 50_000


@dataclass(frozen=True)
class ForestSpec:
    """Parameters of the index.

    ``sample_rows`` bounds the rows that the split planes are fitted on; every row is
    indexed, in ``uses`` of ``trees`` trees.  ``near`` is the length of difference (of unit
    vectors) for which trees are chosen, ``confidence`` that of the chi-square test.
    """

    trees: int = 24
    uses: int = 5
    dims: int = 10
    leaf_rows: int = 2048
    bucket_rows: int = 64
    sample_rows: int = 40_000
    near: float = 0.3
    confidence: float = 0.99
    seed: int = 11


@dataclass(frozen=True)
class Forest:
    """Projections and split planes: arrays by tree and node, nodes numbered from the root downwards."""

    spec: ForestSpec
    projections: np.ndarray
    split_dim: np.ndarray
    split_at: np.ndarray
    depth: int

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """(n, uses) leaf numbers, unique over all trees, of the trees chosen for each unit vector."""
        n, spec = len(unit), self.spec
        leaf = np.empty((n, spec.trees), np.int64)
        inside = np.zeros((n, spec.trees), np.float32)
        rows = np.arange(n)
        for t in range(spec.trees):
            at = unit @ self.projections[t]
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                margin = at[rows, self.split_dim[t, node]] - self.split_at[t, node]
                # log of the chance that a neighbour is on the same side (logistic form of the normal distribution)
                inside[:, t] -= np.log1p(np.exp(-1.702 / spec.near * np.abs(margin)))
                node = 2 * node + 1 + (margin > 0)
            leaf[:, t] = t * 2**self.depth + node - (2**self.depth - 1)
        best = np.argsort(-inside, axis=1, kind="stable")[:, : spec.uses]
        return np.take_along_axis(leaf, best, axis=1)


def fit_forest(sample: np.ndarray, rows: int, spec: ForestSpec) -> Forest:
    """Split planes for ``rows`` rows from a sample of unit vectors; medians of the widest projected dimension."""
    width = sample.shape[1]
    random = np.random.RandomState(spec.seed)
    projections = random.standard_normal((spec.trees, width, spec.dims)).astype(np.float32)
    wanted = max(1.0, rows * spec.uses / spec.trees / spec.leaf_rows)
    depth = min(int(np.ceil(np.log2(wanted))), int(np.log2(max(1, len(sample) // 16))) if len(sample) >= 32 else 0)
    nodes = 2**depth - 1
    split_dim, split_at = np.zeros((spec.trees, max(1, nodes)), np.int64), np.zeros((spec.trees, max(1, nodes)), np.float32)
    for t in range(spec.trees):
        split_dim[t, :nodes], split_at[t, :nodes] = fit_planes(sample @ projections[t], depth)
    return Forest(spec, projections, split_dim, split_at, depth)


def fit_planes(at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and place of the planes of a kd-tree of a depth, by node: medians of the widest dimension."""
    split_dim, split_at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1, np.float32)
    node = np.zeros(len(at), np.int64)
    for level in range(depth):
        for here in range(2**level - 1, 2 ** (level + 1) - 1):
            own = at[node == here]
            if len(own):
                split_dim[here] = dim = int(np.argmax(own.var(axis=0)))
                split_at[here] = np.median(own[:, dim])
        node = 2 * node + 1 + (at[np.arange(len(at)), split_dim[node]] > split_at[node])
    return split_dim, split_at


def chi_square(confidence: float, dims: int) -> float:
    """Quantile of the chi-square distribution (Wilson-Hilferty)."""
    z, spread = NormalDist().inv_cdf(confidence), 2 / (9 * dims)
    return dims * (1 - spread + z * spread**0.5) ** 3


def _buckets(at: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows of each bucket of a kd-tree over projected points."""
    whole, out = [np.arange(len(at))], []
    while whole:
        part = whole.pop()
        if len(part) <= size:
            out.append(part)
            continue
        points = at[part]
        order = np.argpartition(points[:, int(np.argmax(np.ptp(points, axis=0)))], len(part) // 2)
        whole += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


def _cells(unit: np.ndarray) -> np.ndarray:
    """Hash of the cell of directions of each unit vector."""
    random = np.random.RandomState(17).randint(1, 1 << 62, unit.shape[1], dtype=np.int64) | 1
    return (np.floor(unit * (unit.shape[1] ** 0.5 / CELL)).astype(np.int64) * random).sum(axis=1)


def _mark(width: int):
    """Task function over (row, h, check, vector): the vector's cell in place of the vector."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns[:3], pa.array(_cells(_unit(_matrix(batch.column(3), width))))], names=["row", "h", "check", "cell"])

    return mark


def _later_parallels(rows: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's direction, and whether its direction has k + 1 smaller rows: no row of that direction then has it among its k nearest, as all those tie."""
    cell = _cells(unit)
    order = np.lexsort((rows, cell))
    begins = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
    later = np.empty(len(rows), bool)
    later[order] = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows)))) > k
    return cell, later


def nearest(rows: np.ndarray, unit: np.ndarray, projection: np.ndarray, k: int, spec: ForestSpec) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) ids and cosines (nan where there are fewer) of the most similar rows of one leaf; ``unit`` is double."""
    n, test = len(rows), chi_square(spec.confidence, spec.dims)
    single = unit.astype(np.float32)
    at = single @ projection
    cell, later = _later_parallels(rows, unit, k)
    buckets = _buckets(at, spec.bucket_rows)
    low, high = np.array([at[b].min(axis=0) for b in buckets]), np.array([at[b].max(axis=0) for b in buckets])
    out_ids, out_cos = np.full((n, k), -1, np.int64), np.full((n, k), np.nan)
    position = np.empty(n, np.int64)
    position[np.argsort(rows, kind="stable")] = np.arange(n)

    def put(asked: np.ndarray, near: np.ndarray, exact: np.ndarray) -> None:
        """The k best of the candidates by exact cosine to 9 decimals, then by row."""
        exact = np.round(exact, 9)
        key = np.rint((1 - exact) * 1e9).astype(np.int64) * n + position[near]
        key[near == asked[:, None]] = np.iinfo(np.int64).max
        width = min(k, key.shape[1])
        rank = np.argpartition(key, width - 1, axis=1)[:, :width]
        rank = np.take_along_axis(rank, np.argsort(np.take_along_axis(key, rank, 1), axis=1), 1)
        ids, there = np.take_along_axis(near, rank, 1), np.take_along_axis(exact, rank, 1)
        there[ids == asked[:, None]] = np.nan
        out_ids[asked, :width], out_cos[asked, :width] = rows[ids], there

    for own in buckets:
        points = at[own]
        away = np.zeros((len(own), len(buckets)), np.float32)
        for d in range(points.shape[1]):
            gap = np.maximum(low[:, d] - points[:, d, None], points[:, d, None] - high[:, d])
            away += np.square(np.maximum(gap, 0))
        # Waves of buckets, nearest first. A vector takes part in a wave if the test lets it visit one of its buckets.
        order = np.argsort(away.min(axis=0), kind="stable")
        pieces, found = [], []
        best = np.full((len(own), k), -2, np.float32)
        for begin in range(0, len(order), WAVE):
            reach = test * np.maximum(2 - 2 * best[:, 0], 1e-6)
            asking = np.flatnonzero((away[:, order[begin : begin + WAVE]] <= reach[:, None]).any(axis=1)) if begin else np.arange(len(own))
            if not len(asking):
                if not (away[:, order[begin:]] <= reach[:, None]).any():
                    break
                continue
            cand = np.concatenate([buckets[b] for b in order[begin : begin + WAVE]])
            part = np.full((len(own), len(cand)), -2, np.float32)
            cos = single[own[asking]] @ single[cand].T
            cos[own[asking][:, None] == cand] = -2
            if later[cand].any():
                cos[(cell[own[asking]][:, None] == cell[cand]) & later[cand]] = -2
            part[asking] = cos
            pieces.append(cand)
            found.append(part)
            best[asking] = np.sort(np.partition(np.concatenate([best[asking], cos], axis=1), -k, axis=1)[:, -k:], axis=1)
        cand, cos = np.concatenate(pieces), np.concatenate(found, axis=1)
        # Every candidate that single precision can't tell from the k-th best goes on, however many those are.
        least = np.partition(cos, -k, axis=1)[:, -k] - TIED if len(cand) > k else np.full(len(own), -np.inf, np.float32)
        within = (cos >= least[:, None]).sum(axis=1)
        many = 4 * within > len(cand)
        few = np.flatnonzero(~many)[np.argsort(within[~many], kind="stable")]
        cuts = np.flatnonzero(np.diff(np.cumsum(within[few]) // EXACT_PAIRS)) + 1
        for part in filter(len, np.split(few, cuts)):
            take = int(within[part].max())
            near, asked = cand[np.argpartition(-cos[part], take - 1, axis=1)[:, :take]], own[part]
            put(asked, near, np.einsum("ij,ikj->ik", unit[asked], unit[near]))
        if many.any():
            put(own[many], np.broadcast_to(cand, (int(many.sum()), len(cand))), unit[own[many]] @ unit[cand].T)
    return out_ids, out_cos


def usable_vectors(df: DataFrame, row: str, vector: str, width: int) -> DataFrame:
    """(row, vector) of vectors of ``width`` finite numbers, not all zero; all others are left out."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return df.select(F.col(row).cast("long").alias("row"), F.col(vector).alias("vector")).where((F.size("vector") == width) & finite & some)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _assign(forest: Forest, width: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.leaves(_unit(_matrix(batch.column(1), width)).astype(np.float32))
                offsets = np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves.ravel()))
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), lists], names=["row", "vector", "spare", "leaves"])

    return assign


def _projected(forest: Forest, leaf: np.ndarray, shift: int, vectors: np.ndarray) -> np.ndarray:
    """Each vector in the projection of its leaf's tree."""
    unit, tree = _unit(vectors).astype(np.float32), leaf >> shift
    at = np.empty((len(unit), forest.spec.dims), np.float32)
    for t in np.unique(tree):
        at[tree == t] = unit[tree == t] @ forest.projections[t]
    return at


def _fit_leaf(forest: Forest, width: int, shift: int):
    """Task function over the sampled rows of one overfull leaf: its planes, as one row."""

    def fit(group: pa.Table) -> pa.Table:
        leaf, depth = group.column("leaf").to_numpy(), group.column("levels")[0].as_py()
        dims, places = fit_planes(_projected(forest, leaf, shift, _matrix(group.column("vector"), width)), depth)
        columns = [pa.array(leaf[:1]), pa.array([depth], pa.int32()), pa.array([dims.astype(np.int32)], pa.list_(pa.int32())), pa.array([places], pa.list_(pa.float32()))]
        return pa.table(columns, names=["leaf", "levels", "dims", "places"])

    return fit


def _number_parts(forest: Forest, width: int, shift: int):
    """Task function over (row, vector, spare, leaf, levels, dims, places): rows with the number of their part of the leaf."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, levels = batch.column("leaf").to_numpy(), batch.column("levels").fill_null(0).to_numpy()
            part = np.zeros(len(leaf), np.int64)
            own = np.flatnonzero(levels)
            if len(own):
                taken, depth = batch.take(pa.array(own)), levels[own].astype(np.int64)
                at = _projected(forest, leaf[own], shift, _matrix(taken.column("vector"), width))
                first = np.cumsum(2**depth - 1) - (2**depth - 1)
                dims, places = taken.column("dims").flatten().to_numpy(), taken.column("places").flatten().to_numpy()
                node = np.zeros(len(own), np.int64)
                for level in range(int(depth.max())):
                    live = np.flatnonzero(depth > level)
                    here = first[live] + node[live]
                    node[live] = 2 * node[live] + 1 + (at[live, dims[here]] > places[here])
                part[own] = node - (2**depth - 1)
            yield pa.record_batch([batch.column("row"), batch.column("vector"), batch.column("spare"), pa.array((leaf << MORE_LEVELS) | part)], names=["row", "vector", "spare", "leaf"])

    return number


_PLACED = "row long, vector array<float>, spare boolean, leaf long"


def split_overfull(leaves: DataFrame, forest: Forest, width: int) -> tuple[DataFrame, int]:
    """(row, vector, spare, leaf) in which no leaf has over OVERFULL * ``leaf_rows`` rows that are not spare, and how many bits follow the tree in a leaf's number.

    Each round counts the rows of all leaves, fits up to MORE_LEVELS levels of planes on PART_SAMPLE rows
    for each part of an overfull leaf (one small group a leaf), joins them to the leaf's rows and
    numbers the parts.  Spare rows (see ``_spare_rows``) go where the planes send them and are not counted.
    """
    spec, shift = forest.spec, forest.depth
    for _ in range(ROUNDS):
        counts = leaves.where("NOT spare").groupBy("leaf").agg(F.count("*").alias("n"))
        levels = F.least(F.lit(MORE_LEVELS), F.ceil(F.log2(F.col("n") / spec.leaf_rows))).cast("int")
        overfull = shared_table(counts.where(F.col("n") > OVERFULL * spec.leaf_rows).withColumn("levels", levels))
        if not overfull.limit(1).count():
            break
        known = sized_broadcast(overfull)
        share = PART_SAMPLE * F.pow(F.lit(2.0), "levels") / F.col("n")
        sampled = leaves.where("NOT spare").join(known, "leaf").where(F.pmod(F.xxhash64("row", "leaf", F.lit(spec.seed)), F.lit(1 << 20)) < share * (1 << 20))

        planes = shared_table(sampled.groupBy("leaf").applyInArrow(_fit_leaf(forest, width, shift), "leaf long, levels int, dims array<int>, places array<float>"))

        leaves = leaves.join(sized_broadcast(planes), "leaf", "left").select("row", "vector", "spare", "leaf", "levels", "dims", "places").mapInArrow(_number_parts(forest, width, shift), _PLACED)
        leaves = shared_table(leaves)
        shift += MORE_LEVELS
    return leaves, shift


def _spare_rows(marks: DataFrame, k: int) -> DataFrame | None:
    """(row) of crowded cells of directions (row, cell), without the k + 1 smallest rows of each; null if no cell is crowded."""
    crowded = shared_table(marks.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("cell"))
    if not crowded.limit(1).count():
        return None
    inside = marks.join(sized_broadcast(crowded), "cell").select("row", "cell")
    first = inside.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("row"))).where(F.col("place") <= k + 1)
    return shared_table(inside.select("row").join(first.select("row"), "row", "left_anti"))


def deal_spare(leaves: DataFrame, leaf_rows: int) -> DataFrame:
    """``leaves`` with the number of a part: spare rows of a leaf are dealt to parts of about ``leaf_rows``, its other rows are in each of them."""
    counts = leaves.where("spare").groupBy("leaf").agg(F.ceil(F.count("*") / leaf_rows).cast("int").alias("parts")).where("parts > 1")
    both = leaves.join(sized_broadcast(shared_table(counts)), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("spare"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.select("row", "vector", "leaf", part.alias("part"))


def _search(forest: Forest, width: int, k: int, shift: int):
    def search(leaf: pa.Table) -> pa.Table:
        rows, unit = leaf.column("row").to_numpy(), _unit(_matrix(leaf.column("vector"), width))
        tree = leaf.column("leaf")[0].as_py() >> shift
        ids, cos = nearest(rows, unit, forest.projections[tree], k, forest.spec)
        there = ~np.isnan(cos)
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
        loss = np.rint((1 - cos[there]) * 1e9).astype(np.int64)
        return pa.table({
            "row": leaf.column("row").combine_chunks(), "part": leaf.column("part").combine_chunks(),
            "loss": pa.ListArray.from_arrays(offsets, pa.array(loss)), "near": pa.ListArray.from_arrays(offsets, pa.array(ids[there])),
        })

    return search


def nearest_vectors(df: DataFrame, row: str, vector: str, width: int, k: int = 5, spec: ForestSpec = ForestSpec()) -> DataFrame:
    """(row, near, cosine): for every usable vector its k most similar other vectors, with few exceptions.

    Equal similarities (to 9 decimals) come in the order of the smaller row.  Vectors that are
    null, of another length, all zero or not finite take no part; repeated vectors are rows of
    their own.  At most k + 1 rows of each group of identical vectors are indexed, its
    smallest: no other row of the group can be among anyone's k nearest, and the group's
    other rows have the same nearest as the last one that is indexed.  Parallel vectors of other lengths are all indexed, since
    their cosines to a third vector differ in the last decimals, but of those of one direction only the k + 1 smallest answer each other.  Where the table has k or fewer other rows, fewer come out.
    """
    usable = usable_vectors(df, row, vector, width)
    hashed = usable.select("row", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("check"), "vector")
    marks = shared_table(hashed.mapInArrow(_mark(width), "row long, h long, check long, cell long"))
    total = marks.count()
    groups = collapse_copies(marks).where(F.col("n_copies") > k + 1)
    copied = join_groups(marks.drop("cell"), groups, total).select("row", "h", "check")
    order = Window.partitionBy("h", "check").orderBy("row")
    kept = copied.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    extra = shared_table(copied.join(kept.select("row"), "row", "left_anti"))
    has_extra = extra.limit(1).count() > 0
    without_extra = lambda df: df.join(extra.select("row"), "row", "left_anti") if has_extra else df
    spare = _spare_rows(without_extra(marks), k)
    indexed = without_extra(usable)
    indexed = indexed.withColumn("spare", F.lit(False)) if spare is None else indexed.join(spare.withColumn("there", F.lit(True)), "row", "left").select("row", "vector", F.col("there").isNotNull().alias("spare"))

    chosen = F.pmod(F.xxhash64("row", F.lit(spec.seed)), F.lit(max(1, total))) < spec.sample_rows
    sample = indexed.where(chosen & ~F.col("spare")).select("vector").toArrow()
    forest = fit_forest(_unit(_matrix(sample.column(0), width)).astype(np.float32) if sample.num_rows else np.zeros((0, width), np.float32), total, spec)
    placed = indexed.mapInArrow(_assign(forest, width), "row long, vector array<float>, spare boolean, leaves array<long>")
    leaves, shift = split_overfull(placed.select("row", "vector", "spare", F.explode("leaves").alias("leaf")), forest, width)
    parts = leaves.select("row", "vector", "leaf", F.lit(0).alias("part")) if spare is None else deal_spare(leaves, spec.leaf_rows)
    found = parts.groupBy("leaf", "part").applyInArrow(_search(forest, width, k, shift), "row long, part int, loss array<long>, near array<long>")
    hits = found.withColumn("hits", F.arrays_zip("loss", "near"))
    best_of = lambda df, *by: df.groupBy("row", *by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, k).alias("hits"))
    lists = best_of(hits if spare is None else best_of(hits.withColumn("some", F.expr(f"part div {PARTS}")), "some"))
    if has_extra:
        lists = shared_table(lists)
        last = kept.where(F.col("place") == k + 1).select("row", "h", "check").join(lists, "row").join(groups.select("h", "check", "n_copies"), ["h", "check"])
        more = join_groups(extra.select("row", "h", "check"), last.select("h", "check", "n_copies", "hits"), total)
        lists = lists.unionByName(more.select("row", "hits"))
    best = lists.select("row", F.explode("hits").alias("hit"))
    return best.select("row", F.col("hit.near").alias("near"), (1 - F.col("hit.loss") / 1e9).alias("cosine"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(row_a, row_b): each pair of which one is among the other's most similar once, smaller row first."""
    pairs = neighbours.where("row <> near").select(F.least("row", "near").alias("row_a"), F.greatest("row", "near").alias("row_b"))
    return pairs.distinct()
