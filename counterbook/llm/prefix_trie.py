r"""Operator 12: the prefix trie of conversations, by adaptive radix trees.

Every distinct sequence of first turns (role, text) is a node. A turn is a fixed-width id (the first 16 bytes of the SHA-256 of role and text, big-endian),
a conversation the concatenation of its turns' ids. Adaptive radix trees hold these keys: inner layouts for 4, 16, 48 and 256 branches
that grow into one another, and compressed paths. Only byte depths that are whole turns give nodes; branches inside an id pass their figures up.

Scale. Conversations are ranged by key, so each task reads one stretch of the sorted keys and builds trees of at most ``TREE_KEYS`` keys one after
another. A node whose prefix begins neither a tree's first nor its last key lies in that tree as a whole and is final. The others, two paths for each tree, are *open*: their partial
figures are merged by prefix, and what an open node adds to its ancestors (all open too) is summed over the path. So a first turn that a third
of all conversations share is spread over many trees; only its few open nodes meet again. Conversations that are the same as a whole travel as
blocks of ids, so many copies of one key are few rows, and their digest is taken as they stream by. Nothing goes through the driver.

Defined results: turns stand in order of their number, null first, then role, then the turn's id, so repeated numbers have one order; a null role
or text is empty; rows with a null conversation id belong to none; a repeated row is a turn of its own; a text of any length is hashed whole; columns beside the
four are not read; an empty table has no conversation and no node, not even a root. A conversation's turn ids (16 bytes each) and an open node's path are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import type_of, written

WIDTH = 16
#: Keys, and bytes of keys, after which a tree is emitted and the next one begun.
TREE_KEYS, TREE_BYTES = 20_000, 1 << 22
#: Conversation ids of one key that travel in one row.
BLOCK = 4096
SALTS = 64


# -- adaptive radix tree -------------------------------------------------------------------------------------------------------


class Few:
    """Up to 4, then up to 16 branches: their bytes in order beside their nodes."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4):
        self.keys, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node):
        """The layout that holds the branch too: this one, or the next larger one."""
        if len(self.keys) == self.room:
            larger = Few(16) if self.room == 4 else Indexed()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        at = sum(b < byte for b in self.keys)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def swap(self, byte: int, node) -> None:
        self.nodes[self.keys.find(byte)] = node

    def items(self):
        return zip(self.keys, self.nodes, strict=True)


class Indexed:
    """Up to 48 branches: a slot number for each of the 256 bytes (0: none)."""

    __slots__ = ("nodes", "slots")

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int):
        slot = self.slots[byte]
        return self.nodes[slot - 1] if slot else None

    def put(self, byte: int, node):
        if len(self.nodes) == 48:
            larger = Direct()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        self.nodes.append(node)
        self.slots[byte] = len(self.nodes)
        return self

    def swap(self, byte: int, node) -> None:
        self.nodes[self.slots[byte] - 1] = node

    def items(self):
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class Direct:
    """A node for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    swap = put

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """A compressed path, what stands at its end (None: no key ends here), and the branches from there."""

    __slots__ = ("branches", "path", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.branches = path, value, Few()


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def at(self, key: bytes, make):
        """The value of ``key``, made by ``make()`` where it is new."""
        above, byte, node, depth = None, 0, self.root, 0
        while True:
            path = node.path
            same = len(path) if key.startswith(path, depth) else next(k for k in range(len(path)) if depth + k == len(key) or key[depth + k] != path[k])
            if same < len(path):  # the path is split where the key leaves it
                fork = Node(path[:same])
                fork.branches.put(path[same], node)
                node.path = path[same + 1 :]
                above.branches.swap(byte, fork)  # never the root, whose path is empty
                node = fork
            depth += same
            if depth == len(key):
                if node.value is None:
                    node.value = make()
                return node.value
            below = node.branches.get(key[depth])
            if below is None:
                leaf = Node(key[depth + 1 :], make())
                node.branches = node.branches.put(key[depth], leaf)
                return leaf.value
            above, byte, node, depth = node, key[depth], below, depth + 1

    def bottom_up(self) -> Iterator[tuple[Node, int, int]]:
        """(node, byte depth its branch leaves from, byte depth of its end), each after all below it."""
        stack = [(self.root, 0, 0, False)]
        while stack:
            node, top, end, done = stack.pop()
            if done:
                yield node, top, end
                continue
            stack.append((node, top, end, True))
            stack.extend((n, end, end + 1 + len(n.path), False) for _, n in node.branches.items())


# -- one tree's nodes ----------------------------------------------------------------------------------------------------------


class Members:
    """The conversations with one key, added by increasing id. ``way``: where the key is its tree's first or last, the digests of its prefixes."""

    __slots__ = ("count", "digest", "first", "way", "words")

    def __init__(self, words):
        self.words, self.way, self.count, self.first, self.digest = words, None, 0, None, hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if self.count:
            self.digest.update(b",")
        else:
            self.first = ids[0]
        self.digest.update(",".join(map(str, ids)).encode())
        self.count += len(ids)


class Below:
    """What a subtree passes up: members, the smallest id, a member's word counts, a way that it lies on, its topmost nodes, and the closed ones' leaves and saved tokens."""

    __slots__ = ("count", "first", "leaves", "saved", "tops", "way", "words")

    def __init__(self, members: Members | None):
        self.tops, self.leaves, self.saved = [], 0, 0
        self.count, self.first, self.words, self.way = (members.count, members.first, members.words, members.way) if members else (0, None, None, None)

    def join(self, other: Below) -> None:
        self.count += other.count
        self.first = other.first if self.first is None else min(self.first, other.first)
        self.words, self.way = self.words or other.words, self.way or other.way
        self.tops += other.tops
        self.leaves += other.leaves
        self.saved += other.saved


EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_digests(key: bytes) -> list[bytes]:
    """A digest of each prefix of whole turns, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()[:WIDTH]]
    for k in range(0, len(key), WIDTH):
        h.update(key[k : k + WIDTH])
        out.append(h.digest()[:WIDTH])
    return out


def tree_rows(tree: RadixTree) -> list[dict]:
    """The tree's nodes. A row with ``path``, the digests from the root to it, is open; a closed one below an open node names that node's digest in ``parent``."""
    rows: list[dict] = []
    under: dict[int, Below] = {}
    for node, top, end in tree.bottom_up():
        here = Below(node.value)
        for _, child in node.branches.items():
            here.join(under.pop(id(child)))
        for at in range(end - end % WIDTH, -1 if end == 0 else top, -WIDTH):
            depth, path = at // WIDTH, here.way and here.way[: at // WIDTH + 1]
            words = here.words[depth - 1] if depth else 0
            closed = [t for t in here.tops if t["path"] is None]
            if not path:  # an open node's own share is added where its parts meet
                here.leaves = here.leaves or 1
                here.saved += (here.count - 1) * words
            for t in closed:
                t["parent_conv_id"], t["parent"] = (None, path[-1]) if path else (here.first, None)
            ends = node.value.digest.hexdigest() if at == end and node.value else None
            rows.append({
                "conv_id": here.first, "depth": depth, "parent_conv_id": None, "parent": None, "path": path, "n_convs": here.count, "n_children": len(closed),
                "n_leaves": here.leaves, "saved_tokens": here.saved, "words": words, "ends_sha256": ends if path or ends else EMPTY,
            })
            here.tops = [rows[-1]]
            if path:
                here.leaves = here.saved = 0
        under[id(node)] = here
    return rows


def trees(rows: Iterator[tuple[bytes, list[int], list[int]]]) -> Iterator[list[dict]]:
    """The nodes, tree by tree, of (key, words of each turn, ids) in order of key, then id."""
    tree, first, last, size, keys = RadixTree(), None, None, 0, 0

    def done():
        for members, key in ((first, first_key), (last, last_key)):
            members.way = prefix_digests(key)
        return tree_rows(tree)

    last_key = first_key = None
    for key, words, ids in rows:
        if key != last_key:
            if keys >= TREE_KEYS or size >= TREE_BYTES:
                yield done()
                tree, first, size, keys = RadixTree(), None, 0, 0
            last, last_key = tree.at(key, lambda w=words: Members(w)), key
            if first is None:
                first, first_key = last, key
            size, keys = size + len(key), keys + 1
        last.add(ids)
    if first is not None:
        yield done()


# -- whole tables --------------------------------------------------------------------------------------------------------------

TURNS = "array<struct<turn_id:string,words:long>>"


def turn_sequences(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id and ``turns``, each a turn id (hex) and the words of its text, in order."""
    role, text = F.coalesce(rows[role_col], F.lit("")), F.coalesce(rows[text_col], F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)  # the length tells where the role ends
    turns = rows.where(rows[id_col].isNotNull()).select(
        rows[id_col].alias("id"), rows[turn_col].alias("turn"), role.alias("role"), F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * WIDTH).alias("turn_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    gathered = turns.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "turn_id", "words"))).alias("turns"))
    return gathered.select(F.col("id").alias(id_col), F.transform("turns", lambda t: F.struct(t["turn_id"], t["words"])).alias("turns"))


def _node_schema(kind: str) -> str:
    return f"conv_id {kind}, depth int, parent_conv_id {kind}, parent binary, path array<binary>, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"


def _built(sequences: DataFrame, id_col: str) -> DataFrame:
    """The nodes of all trees, open ones in parts."""
    kind = type_of(sequences, id_col)
    keyed = sequences.select(F.col(id_col).alias("id"), F.expr("unhex(array_join(transform(turns, t -> t.turn_id), ''))").alias("key"), F.expr("transform(turns, t -> t.words)").alias("words"))
    blocks = keyed.groupBy("key", F.expr(f"id div {BLOCK}").alias("block")).agg(F.first("words").alias("words"), F.sort_array(F.collect_list("id")).alias("ids"))
    # written first: ranging reads it twice, for the borders and for the rows. id div rounds towards 0, so ids of either sign keep blocks in order
    ranged = written(blocks, "conversation-keys").repartitionByRange("key").sortWithinPartitions("key", "block", F.col("ids")[0])
    fields = [("depth", pa.int32()), ("parent", pa.binary()), ("path", pa.list_(pa.binary())), *((n, pa.int64()) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens", "words")), ("ends_sha256", pa.string())]

    def run(batches):
        id_type = None

        def plain():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(3).type.value_type
                for key, words, ids in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                    yield key.as_py(), words.as_py(), ids.as_py()

        for rows in trees(plain()):
            types = dict(fields) | {"conv_id": id_type, "parent_conv_id": id_type}
            for k in range(0, len(rows), 10_000):
                part = rows[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], types[n]) for n in names], names)

    schema = _node_schema(kind)
    names = [f.split()[0] for f in schema.split(", ")]
    return written(ranged.mapInArrow(run, schema), "trie-nodes")


def _merged(parts: DataFrame) -> DataFrame:
    """The open nodes, their parts added up: own figures from all trees, then the leaves and saved tokens of all below summed along the paths."""
    key = F.element_at("path", -1)
    own = parts.groupBy(key.alias("node")).agg(
        F.first("path").alias("path"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"),
    )
    own = written(own, "open-nodes")
    above = F.expr("if(size(path) > 1, element_at(path, -2), null)")
    children = own.where("depth > 0").groupBy(above.alias("node")).agg(F.count("*").alias("open_children"))
    own = own.join(children, "node", "left").withColumn("n_children", F.expr("n_children + coalesce(open_children, 0)"))
    share = own.select(F.explode("path").alias("node"), F.expr("if(n_children = 0, 1, n_leaves)").alias("leaves"), F.expr("saved_tokens + (n_convs - 1) * words").alias("saved"))
    sums = share.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    full = own.join(sums, "node").select("node", above.alias("above"), "depth", "conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return written(full, "open-nodes-full")


def prefix_trie(sequences: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per node of the trie of ``turn_sequences``: conv_id (the smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves and saved_tokens
    of its subtree, and ends_sha256 over the ids of the members that end there. Conversation ids are integers, one row each."""
    parts = _built(sequences, id_col)
    full = _merged(parts.where("path is not null"))
    out = ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    closed = parts.where("path is null")
    # children of an open node may be a third of all nodes (those of the root): their joins are salted
    salt = F.pmod(F.xxhash64("n.conv_id", "n.depth"), F.lit(SALTS))
    names = full.select(F.col("node").alias("p_node"), F.col("conv_id").alias("p_conv"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("p_salt"))
    nodes = closed.select("conv_id", "parent_conv_id", "parent", *out).unionByName(full.select("conv_id", F.lit(None).cast(type_of(full, "conv_id")).alias("parent_conv_id"), F.col("above").alias("parent"), *out)).alias("n")
    joined = nodes.join(names, (F.col("n.parent") == F.col("p_node")) & (salt == F.col("p_salt")), "left")
    return joined.select(F.col("n.conv_id").alias(id_col), F.coalesce("n.parent_conv_id", "p_conv").alias(f"parent_{id_col}"), *[f"n.{c}" for c in out])


def spliced(sequences: DataFrame, every: int, shared: Column, id_col: str = "conv_id") -> DataFrame:
    """Conversations rebuilt from two: the first ``shared`` turns of the one whose id is the largest multiple of ``every`` up to its own (all if fewer, none if absent), then its own after as many."""
    base = sequences.where(f"{id_col} % {every} = 0").select(F.col(id_col).alias("b_id"), F.col("turns").alias("b_turns"))
    both = sequences.withColumn("h", shared.cast("int")).join(base, F.expr(f"{id_col} - {id_col} % {every} = b_id"), "left")
    return both.select(id_col, F.expr(f"concat(slice(coalesce(b_turns, cast(array() as {TURNS})), 1, h), slice(turns, h + 1, size(turns)))").alias("turns"))
