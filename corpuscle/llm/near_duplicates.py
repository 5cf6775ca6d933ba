"""Near-duplicate texts: a binary-trie self-join of bit signatures, then an exact check.

Every distinct reduced text (a *class*; exact copies are folded first) has 64 minimum
hashes of its five-character substrings.  Its signature is a path in a binary trie: in
trie t the upper levels spell three whole minimum hashes, in which no bit may differ, the
lower 128 levels hold two bits of each of the 64.  Two texts of similarity s differ in
about 64 (1 - s) of the lower bits, unrelated ones in 64.  Pairs of nodes are traversed
together from the root, the differing bits are added up, and a pair of nodes is dropped
as soon as they exceed the budget of its depth.  21 tries with other upper levels give
similar texts 21 chances to share a whole upper path.

Spark deals the tries' upper paths to tasks (equal path, same task), so the joint
traversal starts there.  A path that very many texts share is made longer: its texts go down DEEPER
further minimum hashes, again with a budget of zero, and meet in the longer paths; pairs below
the threshold part there.  What is still crowded after ROUNDS of that are texts similar to each other, whose
pairs are the result; such a path is cut into blocks, and each pair of blocks is a unit of work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.canonical import reduced_text
from corpuscle.llm.format_copies import collapse_copies, join_groups
from corpuscle.session import checkpoint, shared_table, sized_broadcast

WIDTH = 5
HASHES = 64
PREFIX = 3
TRIES = HASHES // PREFIX
BITS = 2 * HASHES
#: Texts that share one upper path and are joined in one piece; beyond, the path is made longer, and cut into blocks at last.
PATH_TEXTS = 4096
#: Longer paths that every text of a crowded path goes down (a similar pair misses all of them once in 0.4 ** 8, 1 in 1,500), and how often at most.
DEEPER, ROUNDS = 8, 4
#: Copies of one text that one task puts into pairs; more are dealt to several.
TASK_COPIES = 20_000
#: Node pairs with at most this many text pairs are finished by comparing whole signatures.
LEAF_PAIRS = 64
_SLICE = 1 << 18

_RANDOM = np.random.RandomState(20240229)
_MULTIPLIERS = (_RANDOM.randint(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_MASKS = _RANDOM.randint(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PAD = "\U0010ffff"


def bit_budgets(similarity: float) -> np.ndarray:
    """Most bits that may differ down to each depth: the mean for ``similarity`` and three and a half deviations."""
    depth = np.arange(BITS + 1)
    miss = (1 - similarity) / 2
    # Two bits of a hash differ together: the variance for each hash is that of 0, 1 or 2 bits.
    spread = (1 - similarity) * 1.5 - (1 - similarity) ** 2
    return np.floor(miss * depth + 3.5 * np.sqrt(spread * depth / 2) + 1).astype(np.int32)


def _signatures(texts: list[str]) -> np.ndarray:
    """(n, HASHES) minimum hashes of the five-character substrings; a shorter text is its own only one."""
    out = np.empty((len(texts), HASHES), np.uint32)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= _SLICE):
            size += len(texts[end])
            end += 1
        part = [t if len(t) >= WIDTH else t.ljust(WIDTH, _PAD) for t in texts[begin:end]]
        points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(t) for t in part])
        starts = np.cumsum(lengths) - lengths
        rolled = np.zeros(len(points) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - WIDTH + 1 + k]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        inside = np.ones(len(points), bool)
        for k in range(1, WIDTH):
            inside[starts + lengths - k] = False
        grams = (rolled >> np.uint64(32)).astype(np.uint32)[inside[: len(rolled)]]
        first = starts - np.arange(len(part)) * (WIDTH - 1)
        for k in range(HASHES):
            mixed = (grams ^ _MASKS[k]) * _MULTIPLIERS[k]
            mixed ^= mixed >> np.uint32(15)
            out[begin:end, k] = np.minimum.reduceat(mixed, first)
        begin = end
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = _signatures(batch.column("reduced").to_pylist())
        scattered = hashes * np.uint32(0x85EBCA6B)
        bits = np.stack([scattered >> np.uint32(31), (scattered >> np.uint32(30)) & np.uint32(1)], axis=2).astype(np.uint8)
        tails = np.packbits(bits.reshape(len(hashes), BITS), axis=1)
        fixed = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        yield pa.record_batch(
            [batch.column(k) for k in ("level", "row", "h", "check")] + [fixed(hashes.astype("<u4")), fixed(tails)],
            names=["level", "row", "h", "check", "hashes", "tail"],
        )


def signatures(texts: DataFrame) -> DataFrame:
    """(level, row, h, check, hashes, tail) of (level, row, text), written once; rows that reduce to nothing drop out."""
    reduced = texts.select("level", "row", reduced_text(F.col("text")).alias("reduced")).where("reduced <> ''")
    marked = reduced.select(
        "level", "row",
        F.unhex(F.md5(F.concat_ws(" ", "level", "reduced"))).alias("h"),
        F.xxhash64("level", "reduced", F.length("reduced")).alias("check"), "reduced",
    )
    return shared_table(marked.mapInArrow(_sign, "level string, row long, h binary, check long, hashes binary, tail binary"))


def _traverse(tails: np.ndarray, roots: np.ndarray, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of signatures within the budget, for root pairs (lo, hi, lo2, hi2) over sorted ``tails``.

    A node is a range of sorted signatures; the frontier holds all node pairs of one depth
    of all tries at once.  Equal ranges stand for a node with itself.
    """
    words = tails.view(">u8").astype(np.uint64).reshape(len(tails), BITS // 64)
    found_i, found_j = [], []

    def finish(pairs: np.ndarray) -> None:
        left, right = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        n = left * right
        at = np.repeat(np.arange(len(pairs)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = pairs[at, 0] + k // right[at], pairs[at, 2] + k % right[at]
        keep = (i < j) | (pairs[at, 0] != pairs[at, 2])
        i, j = i[keep], j[keep]
        near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= budgets[BITS]
        i, j = i[near], j[near]
        # The same rule as on the way down: no depth's budget exceeded, however early a pair is finished.
        kept = (np.cumsum(np.unpackbits(tails[i] ^ tails[j], axis=1), axis=1, dtype=np.int16) <= budgets[1:]).all(axis=1)
        found_i.append(i[kept])
        found_j.append(j[kept])

    frontier = np.column_stack([roots, np.zeros(len(roots), np.int64)]).astype(np.int64)
    for depth in range(BITS):
        small = (frontier[:, 1] - frontier[:, 0]) * (frontier[:, 3] - frontier[:, 2]) <= LEAF_PAIRS
        finish(frontier[small])
        frontier = frontier[~small]
        if not len(frontier):
            break
        bit = (tails[:, depth // 8] >> (7 - depth % 8)) & 1
        ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        lo, hi, lo2, hi2, miss = frontier.T
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        same = lo == lo2
        other = ~same
        frontier = np.concatenate([
            np.column_stack([lo, mid, lo2, mid2, miss]),
            np.column_stack([mid, hi, mid2, hi2, miss]),
            np.column_stack([lo, mid, mid2, hi2, miss + 1]),
            np.column_stack([mid, hi, lo2, mid2, miss + 1])[other],
        ])
        alive = (frontier[:, 0] < frontier[:, 1]) & (frontier[:, 2] < frontier[:, 3]) & (frontier[:, 4] <= budgets[depth + 1])
        frontier = frontier[alive]
    else:
        finish(frontier)
    return np.concatenate(found_i), np.concatenate(found_j)


def _join_tries(budgets: np.ndarray):
    """Task function over rows (path, side, kind, row, tail) sorted by path: pairs (kind, a, b) of rows within the budget."""

    def pairs(path: np.ndarray, side: np.ndarray, kind: np.ndarray, row: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
        runs = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        sizes = np.diff(runs)
        keep = np.repeat(sizes > 1, sizes)
        path, side, kind, row, tail = path[keep], side[keep], kind[keep], row[keep], tail[keep]
        words = tail.view(">u8").reshape(len(tail), BITS // 64)
        order = np.lexsort([words[:, k] for k in reversed(range(words.shape[1]))] + [side, path])
        path, side, kind, row, tail = path[order], side[order], kind[order], row[order], np.ascontiguousarray(tail[order])
        nodes = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (side[1:] != side[:-1]), [True]]))
        lo, hi = nodes[:-1], nodes[1:]
        own = side[lo] == 0
        cross = np.flatnonzero(path[lo[:-1]] == path[lo[1:]]) if len(lo) else np.empty(0, np.int64)
        roots = np.concatenate([np.column_stack([lo, hi, lo, hi])[own], np.column_stack([lo[cross], hi[cross], lo[cross + 1], hi[cross + 1]])])
        i, j = _traverse(tail, roots, budgets) if len(roots) else (np.empty(0, int), np.empty(0, int))
        a, b = row[i], row[j]
        return pa.record_batch([pa.array(kind[i]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["kind", "a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            path, side, kind, row = (batch.column(k).to_numpy() for k in range(4))
            tail = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            held.append((path, side, kind, row, tail))
            if path[-1] == path[0] or sum(len(h[0]) for h in held) < 200_000:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            yield pairs(*(x[:cut] for x in whole))
            held = [tuple(x[cut:] for x in whole)]
        if held:
            yield pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return join


def _parted(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the paths that one task can join, as units of work, and the other paths with their number of texts."""
    hot = sized_broadcast(shared_table(placed.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > PATH_TEXTS)))
    return placed.join(hot.select("path"), "path", "left_anti").select("path", F.lit(0).cast("byte").alias("side"), "kind", "row", "tail"), hot


def trie_candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (level, a, b) of classes (level, row, hashes, tail) whose signatures meet in a trie."""
    paths = F.array(*(F.xxhash64("level", F.lit(t), F.expr(f"substring(hashes, {4 * PREFIX * t + 1}, {4 * PREFIX})")) for t in range(TRIES)))
    kind = F.xxhash64("level")
    placed = classes.select(kind.alias("kind"), "row", "tail", "hashes", F.posexplode(paths).alias("trie", "path"))
    single, hot = _parted(placed)
    for level in range(ROUNDS):
        if hot.limit(1).count() == 0:
            break
        # Hashes behind those that the path spells, in another order for every trie.
        next_hash = [F.pmod(PREFIX * (F.col("trie") + 1) + level * DEEPER + j, F.lit(HASHES)) for j in range(DEEPER)]
        longer = F.array(*(F.xxhash64("path", h, F.substring(F.col("hashes"), 4 * h + 1, F.lit(4))) for h in next_hash))
        deeper = shared_table(placed.join(hot.select("path"), "path", "left_semi").select("kind", "row", "tail", "hashes", "trie", F.explode(longer).alias("path")))
        placed = deeper
        more, hot = _parted(placed)
        single = single.unionByName(more)
    # A hot path: block x block pairs; a row goes to the pairs of its block with every block.
    blocks = F.ceil(F.col("n") * 2 / PATH_TEXTS).cast("int")
    cut = placed.join(hot, "path").withColumns({"block": F.pmod(F.xxhash64("row"), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    crossed = cut.select(
        F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("path"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"), "kind", "row", "tail",
    )
    work = single.unionByName(crossed).repartition("path").sortWithinPartitions("path")
    found = work.mapInArrow(_join_tries(bit_budgets(similarity)), "kind long, a long, b long").distinct()
    levels = sized_broadcast(classes.select("level", kind.alias("kind")).distinct())
    return found.join(levels, "kind").select("level", "a", "b")


def _similar(similarity: float):
    """Task function over (level, a, b, text_a, text_b): the pairs whose five-character substrings are similar enough."""

    def grams(text: str) -> set[str]:
        return {text[k : k + WIDTH] for k in range(max(1, len(text) - WIDTH + 1))}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, last, own = [], None, set()
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if x is not last:
                    last, own = x, grams(x)
                other = grams(y)
                shared = len(own & other)
                near.append(shared >= similarity * (len(own) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in range(3)], names=["level", "a", "b"])

    return keep


def similar_classes(texts: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """(level, a, b): pairs of classes, by their first rows, that are similar enough; a < b."""
    firsts = signed.groupBy("level", "h", "check").agg(F.min("row").alias("row"))
    classes = signed.join(firsts.select("level", "row"), ["level", "row"], "left_semi").dropDuplicates(["level", "row"])
    found = checkpoint(trie_candidates(classes, similarity))
    wanted = found.select("level", F.explode(F.array("a", "b")).alias("row")).distinct()
    reduced = texts.join(wanted, ["level", "row"]).select("level", "row", reduced_text(F.col("text")).alias("reduced"))
    reduced = reduced.dropDuplicates(["level", "row"])
    left = found.join(reduced.select("level", F.col("row").alias("a"), F.col("reduced").alias("text_a")), ["level", "a"])
    both = left.join(reduced.select("level", F.col("row").alias("b"), F.col("reduced").alias("text_b")), ["level", "b"])
    return both.select("level", "a", "b", "text_a", "text_b").mapInArrow(_similar(similarity), "level string, a long, b long")


def members(signed: DataFrame) -> DataFrame:
    """(level, row, class_row, n_copies): every row with text, the first row of its class of exact copies, and the class's size."""
    groups = collapse_copies(signed).withColumnRenamed("first_row", "class_row")
    return join_groups(signed.select("level", "row", "h", "check"), groups, signed.count()).select("level", "row", "class_row", "n_copies")


def _with_copies(pairs: DataFrame, rows: DataFrame, crowded: DataFrame, side: str) -> DataFrame:
    """``pairs`` with each row of the class in column ``side``; the rows of a crowded class are dealt to several keys, and its pairs to all of them."""
    parts = F.coalesce("parts", F.lit(1))
    spread = pairs.join(crowded.withColumnRenamed("class_row", side), ["level", side], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    dealt = F.pmod(F.xxhash64("row"), F.ceil(F.col("n_copies") / TASK_COPIES)).cast("int")
    own = rows.select("level", F.col("class_row").alias(side), F.col("row").alias(f"row_of_{side}"), dealt.alias("part"))
    return spread.join(own, ["level", side, "part"]).drop("part")


def similar_pairs(texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(level, row_a, row_b): rows with different reduced texts of at least the given Jaccard similarity.

    ``texts`` has level, row (unique within its level) and text; similarity is that of the
    sets of five-character substrings of the reduced texts.  Null, blank and mark-only texts take no
    part, rows with equal reduced texts are no pair.  The join runs on one row for each
    distinct text; its copies are put in only at the end, those of a crowded class by several tasks.  An empty table gives no pairs.
    """
    signed = signatures(texts)
    pairs = similar_classes(texts, signed, similarity)
    rows = members(signed)
    parts = F.ceil(F.col("n_copies") / TASK_COPIES).cast("int")
    classes = signed.groupBy("level", "h", "check").agg(F.min("row").alias("class_row"), F.count("*").alias("n_copies"))
    crowded = sized_broadcast(classes.where(F.col("n_copies") > TASK_COPIES).select("level", "class_row", parts.alias("parts")))
    both = _with_copies(_with_copies(pairs, rows, crowded, "a"), rows, crowded, "b")
    return both.select("level", F.least("row_of_a", "row_of_b").alias("row_a"), F.greatest("row_of_a", "row_of_b").alias("row_b"))


def similar_groups(texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(level, row, class_row, group_row, n_links): every row with text, its class, its group and its class's links.

    Groups are the connected components of similar classes, named by their first row;
    ``n_links`` counts the other classes to which the row's class is similar.
    """
    signed = signatures(texts)
    pairs = checkpoint(similar_classes(texts, signed, similarity))
    links = pairs.select("level", "a", "b").unionByName(pairs.select("level", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = links.groupBy("level", F.col("a").alias("class_row")).agg(F.count("*").alias("n_links"))
    grouped = components(links).withColumnRenamed("node", "class_row")
    rows = members(signed).join(degree, ["level", "class_row"], "left").join(grouped, ["level", "class_row"], "left")
    return rows.select("level", "row", "class_row", F.coalesce("label", "class_row").alias("group_row"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def components(links: DataFrame) -> DataFrame:
    """(level, node, label): connected components of symmetric links (level, a, b), named by their smallest node.

    Each round every node takes the least label among its neighbours, then the label of its
    label; a chain of n nodes ends after about log n rounds.  Labels are checkpointed each round.
    """
    labels = checkpoint(links.groupBy("level", F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        seen = links.join(labels.select("level", F.col("node").alias("b"), "label"), ["level", "b"]).groupBy("level", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, ["level", "node"]).select("level", "node", "label", F.least("label", "near").alias("low"))
        jump = labels.select("level", F.col("node").alias("low"), F.col("label").alias("far"))
        after = checkpoint(lower.join(jump, ["level", "low"]).select("level", "node", F.least("low", "far").alias("next"), "label"))
        changed = after.where("next <> label").limit(1).count()
        labels = after.select("level", "node", F.col("next").alias("label"))
        if not changed:
            return labels


def rule_texts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(level, row, text) of stored chunks and documents."""
    return chunks.select(F.lit("chunk").alias("level"), F.col("chunk_row").cast("long").alias("row"), "text").unionByName(
        documents.select(F.lit("document").alias("level"), F.col("doc_row").cast("long").alias("row"), "text")
    )
