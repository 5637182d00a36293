"""Similarity join on word shingles: MinHash bands, an LSH forest cut at one depth, find candidates, exact Jaccard decides.

A document is the set of its five-word shingles (words as for decontamination: A-Z lower-cased, runs of letters,
digits and everything beyond ASCII); fewer than five words are one shingle. Two different texts are *linked* if the Jaccard
similarity of their sets is 0.8 or more.

1. Equal texts are one node. Each node gets ``TREES`` labels, each one hash of a sequence of MinHash values.
2. The sequences have the greatest length, up to ``DEEPEST``, at which a pair of the wanted similarity agrees in some tree with
   at least the target recall. It follows from these numbers before any data is read; there are no tries, and nothing is
   shortened per match: whatever shares a longer prefix shares this one. Nodes with an equal label are candidates of each other.
3. Groups of equal labels become stars around their smallest member, the stars connected components, with hash sums that combine before
   every shuffle: candidates are never listed as pairs.
4. Inside a component every pair is verified exactly, in blocks: a component of up to ``block`` nodes is one unit of work,
   a larger one is cut into blocks and each pair of blocks is a unit, so no task holds more than two blocks. A unit gives the number
   of links per node and a spanning forest of them, not the links.
5. The spanning forests' components are the classes.

Recall: with 40 trees and prefixes of 7 values a pair of similarity 0.8 is missed with a probability below 1e-4, a pair of 0.9 below 1e-11.
Step 4 verifies all pairs of a component, so that is an upper bound for what gets lost.

Defined results: a NULL text is an empty one; texts without words are linked to nothing, equal ones still form a class; repeated rows
belong to the class of their text; a NULL id takes part like any other and a class whose ids are all NULL has the class id NULL;
no documents give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import over_texts, small_batches, text_key, whole_row
from .components import connected_components
from .decontamination import normalising_table

WORDS = 5
SIMILARITY = 0.8
TREES = 40
DEEPEST = 16
RECALL = 0.9999
BLOCK = 256
_SLICE = 4096
_MEMO = 1 << 17


def prefix_depth(trees: int = TREES, similarity: float = SIMILARITY, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of this similarity still meets in one of the trees with this probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.table, self.memo = words, normalising_table(), {}

    def _hash(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(self.table).split()
        memo, hashed = self.memo, self._hash
        values = np.array([memo.get(w) or hashed(w) for w in words], dtype=np.uint64)
        n = min(self.words, len(values))
        if not n:
            return values
        total = np.full(len(values) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + values[k : k + len(total)])
        return np.unique(total)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Labels of a shingle set: one 64-bit number per tree, for its prefix of ``depth`` MinHash values."""

    def __init__(self, trees: int, depth: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = draw.integers(1, 1 << 63, size=(trees * depth, 1), dtype=np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 1 << 63, size=(trees * depth, 1), dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> list[int]:
        if not len(shingles):
            return []
        least = np.full(self.trees * self.depth, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 256):
            values = shingles[at : at + 256] * self.a
            values += self.b
            np.minimum(least, values.min(axis=1), out=least)
        label = np.arange(1, self.trees + 1, dtype=np.uint64)
        for level in least.reshape(self.trees, self.depth).T:
            label = mixed(label * np.uint64(0x9E3779B97F4A7C15) + level)
        return label.view(np.int64).tolist()


def nodes(docs: DataFrame, text: str, trees: int, depth: int, words: int) -> DataFrame:
    """One row per different text: ``node``, ``key``, ``labels``."""

    def make():
        shingles, forest = Shingles(words), Forest(trees, depth)
        return lambda texts: [[forest(shingles(t)) for t in texts]]

    keyed = docs.select(text_key(docs[text]).alias("key"), docs[text].alias("text"))
    labelled = over_texts(keyed, keyed["text"], make, "labels array<bigint>").select(F.col("row.key").alias("key"), "labels")
    different = labelled.groupBy("key").agg(F.first("labels").alias("labels"))
    return stage(different.select(F.monotonically_increasing_id().alias("node"), "key", "labels"), "nodes")


def candidates(found: DataFrame) -> DataFrame:
    """``node``, ``component`` for nodes that share a label with another."""
    entries = found.select("node", F.explode("labels").alias("label"))
    leaders = entries.groupBy("label").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    edges = entries.join(leaders.select("label", "leader"), "label").where("node > leader").select("node", "leader")
    return connected_components(edges, "node", "leader")


def links(units: DataFrame, similarity: float, words: int) -> DataFrame:
    """Per unit of work: ``a``, ``b`` (an edge of the spanning forest, ``n`` = 0) or ``a``, ``n`` (links counted for a node)."""
    small_batches(units.sparkSession)

    def run(batches):
        shingles = Shingles(words)
        current, left, right = None, ([], []), ([], [])
        for batch in batches:
            unit, side, node, text = (batch.column(i) for i in range(4))
            out = []
            for i in range(batch.num_rows):
                name = unit[i].as_py()
                if name != current:
                    out += verified(left, right, similarity)
                    current, left, right = name, ([], []), ([], [])
                to = right if side[i].as_py() else left
                to[0].append(node[i].as_py())
                to[1].append(shingles(text[i].as_py()))
            yield record(out)
        yield record(verified(left, right, similarity))

    def record(rows):
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    return units.mapInArrow(run, "a bigint, b bigint, n bigint")


def verified(left: tuple[list, list], right: tuple[list, list], similarity: float) -> list[tuple]:
    """Links inside the left block, or between both where there is a right one."""
    rows, columns = left, right if right[0] else left
    if not rows[0] or (rows is columns and len(rows[0]) < 2):
        return []
    sizes = [np.array([len(s) for s in side[1]], dtype=np.float64) for side in (rows, columns)]
    both = common_counts(rows[1], columns[1])
    linked = both * (1 + similarity) >= similarity * (sizes[0][:, None] + sizes[1][None, :]) - 1e-9
    linked &= both > 0
    if rows is columns:
        np.fill_diagonal(linked, False)
        counted = zip(rows[0], linked.sum(axis=1).tolist(), strict=True)
    else:
        counted = zip(rows[0] + columns[0], linked.sum(axis=1).tolist() + linked.sum(axis=0).tolist(), strict=True)
    out = [(node, None, n) for node, n in counted if n]
    names = rows[0] if rows is columns else rows[0] + columns[0]
    shift = 0 if rows is columns else len(rows[0])
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows[0])):
        for j in np.flatnonzero(linked[i]).tolist():
            x, y = find(i), find(j + shift)
            if x != y:
                root[max(x, y)] = min(x, y)
    # The forest as stars, which is what the components of most units already are.
    return out + [(names[x], names[find(x)], 0) for x in range(len(names)) if find(x) != x]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right set."""
    sets = left if left is right else left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, number, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = uses[number] > 1
    owner, number = owner[kept], (np.cumsum(uses > 1) - 1)[number[kept]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    n_left, total = len(left), np.zeros((len(left), len(right)))
    width = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, width, _SLICE):
        lo, hi = np.searchsorted(number, [at, at + _SLICE])
        grid = np.zeros((len(sets), min(_SLICE, width - at)), dtype=np.float32)
        grid[owner[lo:hi], number[lo:hi] - at] = 1
        total += grid[:n_left] @ (grid if left is right else grid[n_left:]).T
    return total


def classes_of_texts(docs: DataFrame, text: str, similarity: float, words: int, trees: int, recall: float, block: int) -> DataFrame:
    """``key`` (of a text), ``class`` (a number) and ``n_links`` for each different text."""
    found = nodes(docs, text, trees, prefix_depth(trees, similarity, recall), words)
    near = stage(candidates(found), "near")
    sizes = near.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.expr(f"cast((size + {block - 1}) div {block} as int)")
    placed = near.join(sizes, "component").withColumn("blocks", blocks)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(found.select("node", "key"), "node").select("key", "node", "component", "blocks", "own")

    keyed = docs.select(text_key(docs[text]).alias("key"), docs[text].cast("binary").alias("text"))
    texts = keyed.join(placed, "key").dropDuplicates(["node"])
    # A block meets itself and every other block once: as the left side of later blocks, as the right side of earlier ones.
    pairs = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as x, greatest(own, o) as y, o < own as side))")
    units = texts.select("component", "node", "text", F.explode(pairs).alias("pair")).select(
        F.concat_ws("/", "component", "pair.x", "pair.y").alias("unit"), F.col("pair.side").cast("int").alias("side"), "node", "text"
    )
    units = units.repartition("unit").sortWithinPartitions("unit", "side", "node")
    linked = stage(links(units, similarity, words), "links")
    counts = linked.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = connected_components(linked.where("b is not null"), "a", "b")
    joined = found.select("node", "key").join(counts, "node", "left").join(classes, "node", "left")
    return joined.select("key", F.coalesce("component", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def labelled_texts(docs: DataFrame, doc_id: str, text: str, similarity: float, words: int, trees: int, recall: float, block: int) -> DataFrame:
    """``key``, ``class``, ``n_links``, ``n_copies`` and ``lead`` (the first row of the class: its id, key and how often it is there)."""
    of_text = classes_of_texts(docs, text, similarity, words, trees, recall, block)
    rows = docs.select(docs[doc_id].alias("id"), text_key(docs[text]).alias("key"))
    ids = rows.groupBy("key", "id").agg(F.count("*").alias("same"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "same"))
    per_text = ids.groupBy("key").agg(first.alias("first"), F.sum("same").alias("n_copies")).join(of_text, "key")
    per_text = stage(per_text, "texts")
    leads = per_text.groupBy("class").agg(F.min("first").alias("lead"))
    return per_text.join(leads, "class").select("key", "class", "n_links", "n_copies", "lead")


def similarity_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS,
    trees: int = TREES, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``class_id`` (smallest id of its class), ``n_links`` (different texts linked to its own),
    ``n_copies`` (rows with its text)."""
    labelled = labelled_texts(docs, doc_id, text, similarity, words, trees, recall, block)
    rows = docs.select(docs[doc_id].alias("id"), text_key(docs[text]).alias("key"))
    return rows.join(labelled, "key").select("id", F.col("lead.id").alias("class_id"), "n_links", "n_copies")


def one_per_class(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS,
    trees: int = TREES, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """The row with the smallest id of each class; of repeated rows one."""
    labelled = labelled_texts(docs, doc_id, text, similarity, words, trees, recall, block)
    leads = stage(labelled.select("lead.*").distinct(), "leads")
    rows = docs.select(whole_row(docs).alias("row"), docs[doc_id].alias("id"), text_key(docs[text]).alias("key"))

    def kept(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("id").alias("lead_id"), F.col("key").alias("lead_key"))
        return rows.join(wanted, (rows["key"] == wanted["lead_key"]) & rows["id"].eqNullSafe(wanted["lead_id"]), "left_semi")

    once = kept(leads.where("same = 1"))
    if not leads.where("same > 1").isEmpty():
        once = once.unionByName(kept(leads.where("same > 1")).dropDuplicates(["key"]))
    return once.select("row.*")
