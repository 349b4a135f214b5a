"""Prefix trie of conversations, built from adaptive radix trees over fixed-width turn identifiers.

A turn's identifier is a digest of its role and text, 16 big-endian bytes; a conversation is the string of its turns'
identifiers. The strings are sampled and range-partitioned together with the conversation's number, so that copies of one
conversation spread over as many ranges as they need. A task walks its sorted range block by block: each block becomes a
radix tree with path compression and node layouts that grow from 4 to 16, 48 and 256 children, and a walk over the tree
from its leaves emits a trie node wherever a byte depth ends a turn. What lies on the path of a block's last string is
still open and is carried to the next block, as one small state per turn.

Only the nodes on the paths of a task's first and last strings can have members in several tasks. Their parts (a few rows
a task, whatever the size of the table) are added up by Spark and summed upwards once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.llm import scratch

#: Bytes of a turn identifier.
TURN = 16
#: Bytes of one piece of a list of members that is hashed across tasks.
PIECE = 1 << 16
#: A conversation takes at most so many turns from its group's first one, and groups hold so many numbers.
MOST_SHARED, GROUP = 6, 100


# --- Conversations as strings of turn identifiers ------------------------------------------------


def turn_lists(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``conv_id, ids, sizes``: identifiers (hexadecimal) and code points of a conversation's turns, in order.

    Turns are ordered by turn (null first), then role and text; null role and text count as empty. Rows without a
    conversation number belong to no conversation.
    """
    rows = turns.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text")).alias("item"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def identifier(item: Column) -> Column:
        whole = F.concat(F.length(item["role"]).cast("string"), F.lit(":"), item["role"], item["text"])
        return F.left(F.sha2(whole, 256), F.lit(2 * TURN))

    return listed.select(
        "conv_id", F.transform("items", identifier).alias("ids"), F.transform("items", lambda t: F.length(t["text"])).alias("sizes"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 100; h hangs on c alone."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_SHARED)).cast("int")
    heads = lists.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, MOST_SHARED).alias("base_ids"), F.slice("sizes", 1, MOST_SHARED).alias("base_sizes"))
    keyed = lists.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    both = keyed.join(heads, "base", "left")

    def joined(own: str, first: str, kind: str) -> Column:
        rest = F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(F.col(first), F.lit(1), F.col("h")), F.array().cast(f"array<{kind}>")), rest)

    return both.select("conv_id", joined("ids", "base_ids", "string").alias("ids"), joined("sizes", "base_sizes", "int").alias("sizes"))


# --- Adaptive radix tree -------------------------------------------------------------------------


class Small:
    """Sorted branch bytes beside their children: room for 4, then for 16."""

    __slots__ = ("bytes", "kids", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.kids, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Node):
        """Add or replace a child; the layout to use from now on."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.kids) < self.room:
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)
            return self
        grown = Small(16) if self.room == 4 else Indexed()
        for b, k in self.items():
            grown.put(b, k)
        return grown.put(byte, kid)

    def items(self) -> list[tuple[int, Node]]:
        return list(zip(self.bytes, self.kids))


class Indexed:
    """A table of 256 slot numbers and up to 48 children."""

    __slots__ = ("slots", "kids")

    def __init__(self):
        self.slots, self.kids = bytearray(256), []

    def get(self, byte: int):
        slot = self.slots[byte]
        return self.kids[slot - 1] if slot else None

    def put(self, byte: int, kid: Node):
        slot = self.slots[byte]
        if slot:
            self.kids[slot - 1] = kid
        elif len(self.kids) < 48:
            self.kids.append(kid)
            self.slots[byte] = len(self.kids)
        else:
            grown = Full()
            for b, k in self.items():
                grown.put(b, k)
            return grown.put(byte, kid)
        return self

    def items(self) -> list[tuple[int, Node]]:
        return [(b, self.kids[s - 1]) for b, s in enumerate(self.slots) if s]


class Full:
    """One place for every byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid: Node):
        self.kids[byte] = kid
        return self

    def items(self) -> list[tuple[int, Node]]:
        return [(b, k) for b, k in enumerate(self.kids) if k is not None]


class Node:
    """A branch point or the end of a string: the bytes since its parent, its children, and who ends here."""

    __slots__ = ("edge", "kids", "ends", "sizes")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.ends, self.sizes = edge, None, None, None

    def link(self, kid: Node) -> None:
        self.kids = (self.kids or Small()).put(kid.edge[0], kid)


class RadixTree:
    """Strings with their members. Below a branch byte an edge holds all bytes up to the next branch or end."""

    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, member: int, sizes) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.ends is None:
                    node.ends, node.sizes = [], sizes
                node.ends.append(member)
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                kid = Node(key[at:])
                node.link(kid)
            elif not key.startswith(kid.edge, at):
                kid = self._cut(node, kid, key, at)
            node, at = kid, at + len(kid.edge)

    @staticmethod
    def _cut(parent: Node, kid: Node, key: bytes, at: int) -> Node:
        """Break an edge where the key leaves it."""
        most = min(len(kid.edge), len(key) - at)
        same = next((i for i in range(most) if kid.edge[i] != key[at + i]), most)
        middle = Node(kid.edge[:same])
        kid.edge = kid.edge[same:]
        middle.link(kid)
        parent.link(middle)
        return middle


# --- Trie nodes of one sorted range --------------------------------------------------------------


class Sums:
    """What is known of the members below a place: their number and smallest one, trie nodes right below, leaves, savings."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "rows", "sizes", "pieces")

    def __init__(self):
        self.n, self.low, self.kids, self.leaves, self.saved = 0, None, 0, 0, 0
        self.rows, self.sizes, self.pieces = [], None, 0

    def add(self, other: Sums) -> None:
        self.n += other.n
        if other.low is not None and (self.low is None or other.low < self.low):
            self.low = other.low
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        few, many = sorted((self.rows, other.rows), key=len)
        many.extend(few)
        self.rows = many
        self.sizes = self.sizes if self.sizes is not None else other.sizes

    def above(self, leaves: int, saved: int, rows: list) -> Sums:
        """What a trie node with these sums is to the node above it."""
        up = Sums()
        up.n, up.low, up.kids, up.leaves, up.saved, up.rows, up.sizes = self.n, self.low, 1, leaves, saved, rows, self.sizes
        return up

    def elsewhere(self) -> Sums:
        """Nothing, for a node whose sums reach the node above it another way."""
        up = Sums()
        up.sizes = self.sizes
        return up


def key_of(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[:TURN * depth]).digest()


ROW = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "key", "parent_key")
SCHEMA = ("kind string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, ends binary, key binary, parent_key binary, part int, piece bigint, size bigint")
ARROW = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.binary()), ("key", pa.binary()), ("parent_key", pa.binary()), ("part", pa.int32()), ("piece", pa.int64()),
    ("size", pa.int64())])


class Range:
    """The trie nodes of strings that come in order, block by block.

    ``open`` holds, by depth, what lies below the turns of the last string; ``first`` is how many turns of the range's
    very first string still lead it, as these nodes may have members in the range before.
    """

    def __init__(self, part: int):
        self.part, self.open, self.path, self.first, self.out = part, None, b"", 0, []

    def block(self, keys: list[bytes], members: list[int], sizes: list) -> list[dict]:
        tree = RadixTree()
        for key, member, size in zip(keys, members, sizes):
            tree.add(key, member, size)
        if self.open is None:
            shared, self.first, self.open = -1, len(keys[0]) // TURN, []
        else:
            shared = _common_turns(self.path, keys[0])
            self._close(shared)
            self.first = min(self.first, shared)
        self._walk(tree, keys[0], keys[-1], shared)
        self.path = keys[-1]
        self.first = min(self.first, _common_turns(keys[0], keys[-1]))
        return self._taken()

    def end(self) -> list[dict]:
        """The nodes still open, as parts that other ranges may add to."""
        for depth, sums in enumerate(self.open or []):
            self._border(sums, depth, self.path)
        return self._taken()

    def _taken(self) -> list[dict]:
        out, self.out = self.out, []
        return out

    def _close(self, shared: int) -> None:
        """Turns of the last string below ``shared`` end: no later string has them."""
        while len(self.open) - 1 > shared:
            depth = len(self.open) - 1
            sums = self.open.pop()
            if depth <= self.first:
                self._border(sums, depth, self.path)
            else:
                row = self._row(sums, depth, None, key_of(self.path, depth))
                row["parent_key"] = key_of(self.path, depth - 1)
                self.open[-1].add(sums.above(row["n_leaves"], row["saved_tokens"], []))

    def _row(self, sums: Sums, depth: int, ends: bytes | None, key: bytes | None) -> dict:
        last = sums.sizes[depth - 1] if depth else 0
        row = {"kind": "row", "conv_id": sums.low, "depth": depth, "n_convs": sums.n, "n_children": sums.kids,
               "n_leaves": sums.leaves or 1, "saved_tokens": sums.saved + (sums.n - 1) * last, "ends": ends, "key": key}
        self.out.append(row)
        return row

    def _border(self, sums: Sums, depth: int, path: bytes) -> None:
        self.out.append({
            "kind": "border", "conv_id": sums.low, "depth": depth, "n_convs": sums.n, "n_children": sums.kids,
            "n_leaves": sums.leaves, "saved_tokens": sums.saved, "key": key_of(path, depth),
            "parent_key": key_of(path, depth - 1) if depth else None, "size": int(sums.sizes[depth - 1]) if depth else 0})

    def _pieces(self, members: list[int], sums: Sums, key: bytes) -> None:
        """Members of a node that is not complete here go out as pieces, to be hashed in order later."""
        text = ",".join(map(str, members)).encode()
        for i in range(0, len(text), PIECE):
            self.out.append({"kind": "piece", "key": key, "part": self.part, "piece": sums.pieces,
                             "ends": (b"," if i == 0 else b"") + text[i:i + PIECE]})
            sums.pieces += 1

    def _walk(self, tree: RadixTree, first_key: bytes, last_key: bytes, shared: int) -> None:
        """From the leaves upwards. A place on the way up is (node, depth in bytes above its edge, on the first or last path)."""
        opened: dict[int, Sums] = {}
        done: list[Sums] = []  # sums of finished children, innermost last
        stack = [(tree.root, 0, True, True, False)]
        while stack:
            node, above, on_first, on_last, seen = stack.pop()
            below = above + len(node.edge)
            kids = node.kids.items() if node.kids else []
            if not seen:
                stack.append((node, above, on_first, on_last, True))
                for i in range(len(kids) - 1, -1, -1):
                    stack.append((kids[i][1], below, on_first and i == 0 and node.ends is None, on_last and i == len(kids) - 1, False))
                continue
            sums = Sums()
            for _ in kids:
                sums.add(done.pop())
            ends = node.ends
            if ends is not None:
                own = Sums()
                own.n, own.low, own.sizes = len(ends), ends[0], node.sizes
                sums.add(own)
            # Turns that end on this edge, from its lower end; the root of the trie is the top of the tree.
            lowest, top = below // TURN, above // TURN if node.edge else -1
            for depth in range(lowest, top, -1):
                path = first_key if on_first else last_key
                before = self.open[depth] if on_first and depth <= shared else None
                here = ends if ends is not None and depth * TURN == below else None
                if before is not None:
                    before.add(sums)
                    sums = before
                key = key_of(path, depth) if before is not None or on_last or (on_first and depth <= self.first) else None
                if here is not None and key is not None:
                    self._pieces(here, sums, key)
                if on_last:
                    for row in sums.rows:
                        row["parent_key"] = key
                    sums.rows = []
                    opened[depth], sums = sums, sums.elsewhere()
                elif on_first and depth <= self.first:
                    for row in sums.rows:
                        row["parent_key"] = key
                    self._border(sums, depth, path)
                    sums = sums.elsewhere()
                else:
                    text = ",".join(map(str, here)).encode() if here is not None else b""
                    row = self._row(sums, depth, hashlib.sha256(text).digest() if key is None else None, key)
                    for child in sums.rows:
                        child["parent_conv_id"] = sums.low
                    sums = sums.above(row["n_leaves"], row["saved_tokens"], [row])
            done.append(sums)
        self.open = [opened[d] for d in range(len(last_key) // TURN + 1)]


def _common_turns(a: bytes, b: bytes) -> int:
    turns = min(len(a), len(b)) // TURN
    return next((i for i in range(turns) if a[TURN * i:TURN * (i + 1)] != b[TURN * i:TURN * (i + 1)]), turns)


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = Range(TaskContext.get().partitionId())
    for batch in batches:
        if batch.num_rows:
            path, member, sizes = (batch.column(i) for i in range(3))
            rows = run.block(path.to_pylist(), member.to_pylist(), sizes.to_pylist())
            yield _table(rows)
    yield _table(run.end())


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border nodes with their parts added: sums go from the deepest nodes upwards, then names of parents downwards."""
    rows = {r["key"]: r for batch in batches for r in batch.to_pylist()}
    for row in sorted(rows.values(), key=lambda r: -r["depth"]):
        row["n_leaves"] = row["n_leaves"] or 1
        row["saved_tokens"] += (row["n_convs"] - 1) * row["size"]
        above = rows.get(row["parent_key"])
        if above is not None:
            above["n_convs"] += row["n_convs"]
            above["conv_id"] = row["conv_id"] if above["conv_id"] is None else min(above["conv_id"], row["conv_id"])
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    for row in rows.values():
        above = rows.get(row["parent_key"])
        row["parent_conv_id"] = above["conv_id"] if above is not None else None
    yield _table(list(rows.values()))


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's members, from pieces in order; a piece is in memory at a time."""
    key, running, out = None, None, []
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, running.digest()))
                key, running = k, hashlib.sha256()
                piece = piece[1:]
            running.update(piece)
    if key is not None:
        out.append((key, running.digest()))
    yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in out], pa.binary()) for i in (0, 1)], ["key", "hashed"])


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations of ``lists`` (``conv_id bigint, ids, sizes`` as of `turn_lists`).

    ``conv_id`` (the smallest member), ``depth, parent_conv_id`` (null at the root), ``n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. Conversations without turns end at the root; equal conversations share all nodes; rows
    with a null number are left out; without conversations there is no node. Turns are told apart by 128 bits of SHA-256.
    """
    spark = lists.sparkSession
    strings = lists.where(F.col("conv_id").isNotNull()).select(
        F.unhex(F.array_join("ids", "")).alias("path"), "conv_id", "sizes")
    width = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = strings.repartitionByRange(width, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = scratch.keep(ranges.select("path", "conv_id", "sizes").mapInArrow(_build, SCHEMA), "trie")

    parts = found.where("kind = 'border'").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.first("parent_key").alias("parent_key"), F.max("size").alias("size"))
    whole = scratch.keep(parts.repartition(1).mapInArrow(_add_up, SCHEMA), "trie-borders")  # a few rows a task of the build
    pieces = found.where("kind = 'piece'").repartition("key").sortWithinPartitions("key", "part", "piece")
    hashed = pieces.select("key", "ends").mapInArrow(_hash_pieces, "key binary, hashed binary")

    rows = found.where("kind = 'row'")
    names = rows.where("key is not null").select("key", "conv_id").unionByName(whole.select("key", "conv_id"))
    inner = rows.where("key is null and parent_key is null")
    rest = rows.where("key is not null or parent_key is not null").join(
        names.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), "parent_key", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_parent")).drop("_parent")
    late = rest.unionByName(whole.select(*rest.columns)).join(hashed, "key", "left").withColumn("ends", F.coalesce("hashed", "ends"))
    shown = inner.select(*ROW[:8]).unionByName(late.select(*ROW[:8]))
    nobody = F.sha2(F.lit(""), 256)
    return shown.select(*ROW[:7], F.coalesce(F.lower(F.hex("ends")), nobody).alias("ends_sha256"))
