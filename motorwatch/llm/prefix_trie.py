"""Conversation prefix trie, its subtree totals by time-forward processing.

**Turns.** Turns are sorted over the cluster by ranges of (conversation, turn, digest), so one conversation with a third of all rows is
many ranges; a turn's place is its rank in its range plus the sizes of its conversation's earlier ranges. Texts stay where they are: a turn
is its number, 128 bits of digest and its size.

**Nodes.** A node's key is the exclusive or of the digests of (place, turn) over its prefix, 128 bits, taken by windows over blocks of one
conversation and joined to the sums of earlier blocks. Grouping by key, with map-side combine, gives a node's smallest member, members and parent.

**Totals.** Nodes with one member need no tree: they are a chain to one leaf and save nothing. The others are dealt to shards. A node is
heavy if its members are over a share of all conversations; there are at most ``shards`` of them on one level, so their keys are a
bounded broadcast, and they are the top of the tree. The first node of a path that is not heavy is a shard root, and its subtree a shard.
Within a shard the nodes are sorted in reverse level order by Spark's sort, which spills; each takes the messages that wait for
it in a priority queue, which spills sorted runs to disk, adds its own, and sends the total to its parent. Messages of shard roots
are summed per parent and the same pass runs across the top. A level of the top has at most ``shards`` nodes, so that
last pass is short unless many conversations share thousands of turns; it runs in bounded memory in any case.

Defined results: NULL roles and texts are empty; turns with equal numbers are ordered by their digest, NULL numbers first; repeated
rows are repeated turns; a NULL id is one conversation, a member that has no decimal form and is nobody's smallest unless alone; without conversations
there are no rows, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Turns of a conversation in one block of prefix sums, most heavy nodes on one level, and messages held before a queue spills.
BLOCK = 1 << 14
SHARDS = 4096
HELD = 1 << 18
#: Below so many conversations a subtree is never split.
LIGHT = 64
#: Broadcasts of heavy keys are bounded to so many; levels below count as not heavy, and their shards are larger.
MOST_HEAVY = 200_000
ROOT = "0" * 32


def _halves(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def place_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table: ``who`` (a struct of the id, so that NULL is a value), ``at`` (1, 2, ...), ``said`` (digest of role and text), ``size`` (UTF-8 bytes of the text)."""
    spoken = [F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role, text)]
    given = turns.select(
        F.struct(turns[conv].alias("id")).alias("who"), turns[turn].alias("turn"),
        F.md5(F.concat(F.length(spoken[0]).cast("string"), F.lit("|"), *spoken).cast("binary")).alias("said"),
        F.octet_length(spoken[1]).cast("long").alias("size"),
    )
    ranged = stage(given.repartitionByRange("who", "turn", "said").withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("who", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("who").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("who", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("who", "range").orderBy("turn", "said"))
    placed = ranged.withColumn("rank", rank).join(before, ["who", "range"])
    return stage(placed.select("who", (F.col("before") + F.col("rank")).alias("at"), "said", "size"), "placed")


def conversations(placed: DataFrame) -> DataFrame:
    """``who`` and ``n``, its turns."""
    return placed.groupBy("who").agg(F.max("at").alias("n"))


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, one row per key, of which ``weight`` says how many of the ``total`` rows have it.

    Keys with more than a 4096th of the rows are at most 4096, so they are broadcast; no other key makes a hot task.
    """
    hot = keyed.where(F.col(weight) > max(total // 4096, LIGHT))
    few = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(weight) <= max(total // 4096, LIGHT)), key, how)
    return rows.join(few, key).unionByName(rest)


def prefixes(placed: DataFrame) -> DataFrame:
    """A written table of nodes on paths: ``who``, ``at``, ``size``, ``key`` of the prefix that ends here and ``parent``, that of the one before."""
    marks = _halves(F.md5(F.concat(F.col("at").cast("string"), F.lit("|"), F.col("said")).cast("binary")))
    rows = placed.select("who", "at", "size", F.floor((F.col("at") - 1) / BLOCK).alias("block"), marks[0].alias("x"), marks[1].alias("y"))
    sums = rows.groupBy("who", "block").agg(F.bit_xor("x").alias("x0"), F.bit_xor("y").alias("y0"))
    earlier = Window.partitionBy("who").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = sums.select("who", "block", *[F.coalesce(F.bit_xor(c).over(earlier), zero).alias(c) for c in ("x0", "y0")])
    local = Window.partitionBy("who", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("who", "block", "at", "size", "x", "y", F.bit_xor("x").over(local).alias("px"), F.bit_xor("y").over(local).alias("py"))
    joined = within.join(before, ["who", "block"])

    def key(*more: str) -> Column:
        whole = [F.col(p).bitwiseXOR(F.col(o)) for p, o in (("px", "x0"), ("py", "y0"))]
        return F.concat(*[F.lpad(F.hex(h.bitwiseXOR(F.col(m)) if m else h), 16, "0") for h, m in zip(whole, more or ("", ""), strict=True)])

    return stage(joined.select("who", "at", "size", key().alias("key"), key("x", "y").alias("parent")), "prefixes")


class Queue:
    """A priority queue of (depth, key, values) that gives the deepest first, then by key; it holds a bounded number and spills the rest in sorted runs.

    Runs are files of this task alone, in the folder that Spark gives its workers to spill to; they go with the task, and a task that is
    run again writes its own.
    """

    def __init__(self, held: int = HELD):
        self.heap, self.held, self.heads, self.runs = [], held, [], []

    def push(self, depth: int, key: str, *values: int) -> None:
        heapq.heappush(self.heap, (-depth, key, *values))
        if len(self.heap) > self.held:
            folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
            file = tempfile.TemporaryFile(dir=folders[0] if folders else None)  # noqa: SIM115
            self.heap.sort()
            for item in self.heap:
                pickle.dump(item, file)
            file.seek(0)
            self.runs.append(file)
            self.heap = []
            self._next(len(self.runs) - 1)

    def _next(self, run: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(self.runs[run]), run))  # noqa: S301
        except EOFError:
            self.runs[run].close()

    def take(self, depth: int, key: str) -> list[int]:
        """Sums of all messages for this node."""
        sums = [0, 0]
        while True:
            if self.heap and self.heap[0][:2] == (-depth, key):
                item = heapq.heappop(self.heap)
            elif self.heads and self.heads[0][0][:2] == (-depth, key):
                item, run = heapq.heappop(self.heads)
                self._next(run)
            else:
                return sums
            sums = [s + v for s, v in zip(sums, item[2:], strict=True)]

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)


def time_forward(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """``key``, ``n_leaves`` and ``saved_tokens`` of whole subtrees, and ``up``: the parent the totals go to where it lies outside the shard.

    ``nodes``: ``shard``, ``key``, ``parent``, ``depth``, ``leaves`` and ``saved`` (a node's own), ``top`` (whether its parent is outside).
    """
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key")
    chosen = ordered.select("shard", "depth", "key", "parent", "leaves", "saved", "top")
    names = ["key", "n_leaves", "saved_tokens", "up"]

    def run(batches):
        shard, queue = None, Queue(held)
        for batch in batches:
            out = []
            for at, depth, key, parent, leaves, saved, top in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != shard:
                    if len(queue):
                        raise ValueError(f"messages of shard {shard} have no receiver: two prefixes share a key")
                    shard = at
                more = queue.take(depth, key)
                totals = leaves + more[0], saved + more[1]
                if not top:
                    queue.push(depth - 1, parent, *totals)
                out.append((key, *totals, parent if top else None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return chosen.mapInArrow(run, "key string, n_leaves bigint, saved_tokens bigint, up string")


def end_digests(ends: DataFrame) -> DataFrame:
    """``key`` and the SHA-256 of the ids that end there, ascending and comma-joined.

    A running digest takes its ids one after another: a node's ids meet in one task, sorted, and stream through it.
    """
    ordered = ends.where("who.id is not null").select("key", F.col("who.id").alias("id")).repartition("key").sortWithinPartitions("key", "id")
    ordered = ordered.select("key", F.col("id").cast("string").alias("id"))

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if digest:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(i.encode())
                else:
                    digest.update(f",{i}".encode())
            yield record(out)
        if digest:
            yield record([(key, digest.hexdigest())])

    def record(out):
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "ends_sha256"])

    return ordered.mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(placed: DataFrame, everyone: DataFrame | None = None, shards: int = SHARDS, light: int = LIGHT, held: int = HELD) -> DataFrame:
    """The nodes over placed turns (``who``, ``at``, ``said``, ``size``); ``everyone`` lists ``who`` where some have no turns.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    paths = prefixes(placed)
    everyone = stage((everyone if everyone is not None else paths.select("who").distinct()).select("who"), "everyone")
    n_all, n_rows = everyone.count(), paths.count()
    member = F.min("who.id").alias("conv_id")
    below = paths.groupBy("key").agg(
        member, F.min("at").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("size").alias("size")
    )
    top = everyone.agg(F.lit(ROOT).alias("key"), member, F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"))
    top = top.where("n_convs > 0").select("key", "conv_id", "depth", F.lit(None).cast("string").alias("parent"), "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = stage(below.unionByName(top), "nodes")

    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")
    )
    full = stage(nodes.join(kids, "key", "left").na.fill(0, ["n_children", "single"]), "family")

    # Shards: a path's first node that is not heavy stands for all nodes below it.
    shared = full.where("n_convs > 1 or depth = 0")
    heavy_at = max(n_all // shards, light)
    heavy = stage(shared.where((F.col("n_convs") > heavy_at) | (F.col("depth") == 0)).select("key", "depth"), "heavy")
    if heavy.count() > MOST_HEAVY:
        levels = heavy.groupBy("depth").count().withColumn("sum", F.sum("count").over(Window.orderBy("depth")))
        deepest = levels.where(F.col("sum") <= MOST_HEAVY).agg(F.max("depth")).first()[0]
        heavy = heavy.where(F.col("depth") <= deepest)
    flagged = paths.join(F.broadcast(heavy.select("key", F.lit(True).alias("heavy"))), "key", "left")
    roots = flagged.where("heavy is null").groupBy("who").agg(F.min_by("key", "at").alias("shard"), F.max("at").alias("turns"))
    # A node is on the path of its smallest member, whose shard is the node's own; heavy nodes are the top.
    own = roots.select(F.col("who.id").alias("conv_id"), "shard", "turns")
    given = shared.join(F.broadcast(heavy.select("key", F.lit(True).alias("heavy"))), "key", "left")
    shape = ("key", "parent", "depth", F.expr("if(n_children = 0, 1, single)").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    lower = join_hot(given.where("heavy is null").drop("heavy"), own, "conv_id", "turns", n_rows)
    lower = lower.select("shard", *shape, (F.col("key") == F.col("shard")).alias("top"))
    inner = stage(time_forward(lower, held), "shards")
    sent = inner.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    upper = given.where("heavy").select(F.lit("top").alias("shard"), *shape, (F.col("depth") == 0).alias("top"))
    upper = upper.join(sent, "key", "left").na.fill(0, ["more_leaves", "more_saved"])
    upper = upper.withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
    outer = stage(time_forward(upper, held), "top")
    totals = inner.unionByName(outer).drop("up")

    ends = paths.groupBy("who").agg(F.max_by("key", "at").alias("key"))
    silent = everyone.join(paths.where("at = 1").select("who"), "who", "left_anti").select("who", F.lit(ROOT).alias("key"))
    digests = end_digests(ends.unionByName(silent))

    parents = full.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    with_parent = join_hot(full.where("depth > 0"), parents, "parent", "weight", n_rows).drop("weight")
    every = with_parent.unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(full.schema["conv_id"].dataType)))
    none = hashlib.sha256(b"").hexdigest()
    result = every.join(totals, "key", "left").join(digests, "key", "left")
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
