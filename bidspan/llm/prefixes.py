"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, forests merged across their boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled

#: Conversations of one forest; turn numbers of one slice; ids of the conversation that lends its first turns, and the most it lends.
FOREST, SLICE, LENDER, LENT = 20_000, 256, 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"").digest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FOREST = f"{_NODE}, open boolean, key binary, parent_key binary, n_bytes long, first long, ids string"


def turn_digest(role: Column, text: Column) -> Column:
    """One digest for each different pair of role and text."""
    return F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, turn_key, n_bytes`` with turns numbered from 0, and ``conv_id`` of all conversations.

    Turns are numbered in slices of their turn number, and slices shifted by what
    lies before them, so a conversation with very many turns is not one task. Turns
    of equal number are ordered by role, then by digest, which leaves texts where
    they are.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.expr(f"turn div {SLICE}").alias("slice"), role.alias("role"), turn_digest(role, text).alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    sizes = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by conv_id order by slice nulls first rows between unbounded preceding and 1 preceding), 0)")
    shifts = sizes.select(F.col("conv_id").alias("_c"), F.col("slice").alias("_s"), before.alias("before"))
    place = F.expr("row_number() over (partition by conv_id, slice order by turn nulls first, role, turn_key) - 1")
    placed = rows.withColumn("place", place).join(shifts, (F.col("conv_id") == F.col("_c")) & F.col("slice").eqNullSafe(F.col("_s")))
    return placed.select("conv_id", (F.col("before") + F.col("place")).alias("pos"), F.unhex("turn_key").alias("turn_key"), "n_bytes"), sizes.select("conv_id").distinct()


def rebuilt(conversations: DataFrame, settle: Settled) -> DataFrame:
    """``conv_id, path, sizes``: each conversation's turn digests and text bytes, its first turns borrowed.

    Conversation c takes the first h turns of c - c % 5, h being crc32(c) % 9, and
    goes on with its own turns after its first h. A conversation is one row of 24
    bytes a turn; texts are not gathered.
    """
    turns, ids = numbered_turns(conversations)
    turns = settle(turns)
    packed = F.struct("pos", "turn_key", "n_bytes")
    lent = turns.where((F.col("conv_id") % LENDER == 0) & (F.col("pos") < LENT - 1)).groupBy(F.col("conv_id").alias("lender")).agg(F.sort_array(F.collect_list(packed)).alias("lent"))
    takes = F.crc32(F.col("conv_id").cast("string")) % LENT
    own = turns.where(F.col("pos") >= takes).groupBy(F.col("conv_id").alias("own_id")).agg(F.sort_array(F.collect_list(packed)).alias("own"))
    all_ = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % LENDER).alias("lender"), takes.alias("takes"))
    joined = all_.join(lent, "lender", "left").join(own, F.col("conv_id") == F.col("own_id"), "left")
    none = F.array().cast("array<struct<pos:bigint,turn_key:binary,n_bytes:bigint>>")
    whole = F.concat(F.coalesce(F.filter("lent", lambda x: x["pos"] < F.col("takes")), none), F.coalesce("own", none))
    return settle(joined.select("conv_id", whole.alias("w")).select("conv_id", F.col("w.turn_key").alias("path"), F.col("w.n_bytes").alias("sizes")))


class _Forest:
    """The trie of some sorted rows, unary chains contracted: a node stands for itself and the chain above it."""

    def __init__(self, rows: list[tuple[list[bytes], list[int], int]]):
        groups = [(path, list(same)) for path, same in groupby(rows, key=lambda r: r[0])]
        self.paths, self.sizes = [p for p, _ in groups], [same[0][1] for _, same in groups]
        self.ends = [[r[2] for r in same] for _, same in groups]
        n = len(groups)
        self.depth, self.least, self.count = [len(p) for p in self.paths], [e[0] for e in self.ends], [len(e) for e in self.ends]
        self.low, self.high, self.children, self.ended = list(range(n)), list(range(n)), [[] for _ in range(n)], list(range(n))
        shared = np.array([self._common(i) for i in range(n - 1)], np.int64)
        owner, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        for i in np.argsort(-shared, kind="stable").tolist():  # deepest links first
            a, b = find(i), find(i + 1)
            owner[b] = a
            top[a] = self._merge(top[a], top[b], int(shared[i]))
        self.top = top[find(0)]

    def _common(self, i: int) -> int:
        a, b = self.paths[i], self.paths[i + 1]
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    def _merge(self, a: int, b: int, depth: int) -> int:
        """The node at ``depth`` above both: one of them, or a new one."""
        if self.depth[a] != depth and self.depth[b] == depth:
            a, b = b, a
        if self.depth[a] != depth:
            self.depth.append(depth)
            self.ended.append(None)
            self.children.append([a])
            for values in (self.least, self.count, self.low, self.high):
                values.append(values[a])
            a = len(self.depth) - 1
        if self.depth[b] == depth:  # the same node of two components
            self.children[a] += self.children[b]
            self.ended[a] = self.ended[b] if self.ended[a] is None else self.ended[a]
        else:
            self.children[a].append(b)
        self.least[a], self.count[a] = min(self.least[a], self.least[b]), self.count[a] + self.count[b]
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        return a

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_FOREST``: nodes of one depth each, and what open nodes have in this forest.

        Open nodes are the beginnings of the first and the last row: neighbouring
        forests may hold more of them. They carry sums of their closed children only.
        """
        last = len(self.paths) - 1
        keys = {row: _chain(self.paths[row]) for row in {0, last}}
        order, todo = [], [(self.top, None)]
        while todo:
            x, parent = todo.pop()
            order.append((x, parent))
            todo += [(c, x) for c in self.children[x]]
        leaves, saved = {}, {}
        for x, parent in reversed(order):  # children before their parents
            opened = self.low[x] == 0 or self.high[x] == last
            above = -1 if parent is None else self.depth[parent]
            sizes, n, least = self.sizes[self.low[x]], self.count[x], self.least[x]
            closed = [c for c in self.children[x] if not (self.low[c] == 0 or self.high[c] == last)]
            total, tips = sum(saved[c] for c in closed), sum(leaves[c] for c in closed)
            ids = ",".join(map(str, self.ends[self.ended[x]])) if self.ended[x] is not None else None
            if opened:
                key = keys[0 if self.low[x] == 0 else last]
                for d in range(self.depth[x], above, -1):
                    own = d == self.depth[x]
                    first = self.ends[self.ended[x]][0] if own and ids else None
                    yield least, d, None, n, len(closed) if own else 0, tips if own else 0, total if own else 0, None, True, key[d], key[d - 1] if d else None, sizes[d - 1] if d else 0, first, ids if own else None
                continue
            tips = tips or 1
            outer = parent is not None and (self.low[parent] == 0 or self.high[parent] == last)
            for d in range(self.depth[x], above, -1):
                own = d == self.depth[x]
                total += (n - 1) * (sizes[d - 1] if d else 0)
                digest = hashlib.sha256(ids.encode()).hexdigest() if own and ids else EMPTY
                up, up_key = least, None
                if d == above + 1:
                    up, up_key = (None, keys[0 if self.low[parent] == 0 else last][above]) if outer else (self.least[parent], None)
                yield least, d, up, n, len(self.children[x]) if own else 1, tips, total, digest, False, None, up_key, None, None, None
            leaves[x], saved[x] = tips, total


def _chain(path: list[bytes]) -> list[bytes]:
    """A digest of every beginning of a path, the empty one first."""
    keys = [ROOT]
    for turn in path:
        keys.append(hashlib.md5(keys[-1] + turn).digest())
    return keys


def _table(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _forests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_FOREST)
        held: list[tuple] = []
        for b in batches:
            held += zip(b.column("path").to_pylist(), b.column("sizes").to_pylist(), b.column("conv_id").to_pylist())
            while len(held) >= size:
                yield from _table(list(_Forest(held[:size]).nodes()), schema)
                held = held[size:]
        if held:
            yield from _table(list(_Forest(held).nodes()), schema)

    return run


_MERGED = "key binary, parent_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long"


def _upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the open nodes' sums up, from the deepest to the root."""
    rows = {r["key"]: r for b in batches for r in b.to_pylist()}
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["n_bytes"]
        up = rows.get(r["parent_key"])
        if up:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    schema = _arrow(_MERGED)
    yield from _table([tuple(r[f.name] for f in schema) for r in rows.values()], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's joined id lists, read in order; a list is never held whole."""
    schema, key, state = _arrow("key binary, ends_sha256 string"), None, None
    for b in batches:
        done = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield from _table(done, schema)
    if state is not None:
        yield from _table([(key, state.hexdigest())], schema)


def prefix_trie(conversations: DataFrame, *, forest: int = FOREST) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, with the columns of ``op11``.

    Rebuilt conversations are sorted by their turns (ids break ties, so equal ones
    spread over tasks). Every stretch of ``forest`` rows becomes a forest: links
    between neighbours, as deep as their common prefix, are joined by union-find
    from the deepest up, and every merge makes a branching node. Nodes that reach a
    stretch's first or last row are open; they alone are merged across stretches,
    by a digest of their prefix, and their subtree sums added up in one task of at
    most two paths per stretch. Id lists of open nodes are hashed in pieces.

    Rows without a conversation id take no part; repeated rows are turns each. A
    conversation without turns of its own after its first h still counts, at the
    depth its borrowed turns give. An empty table gives an empty table. Other
    columns are not read.
    """
    settle = Settled(conversations.sparkSession, "prefixes")
    paths = rebuilt(conversations, settle)
    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = settle(dealt.mapInArrow(_forests(forest), _FOREST))
    pieces = found.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    one = pieces.groupBy("key", "parent_key", "depth", "n_bytes").agg(F.min("conv_id").alias("conv_id"), *sums)
    merged = settle(one.repartition(1).mapInArrow(_upwards, _MERGED))
    lists = pieces.where("ids is not null").select("key", "first", "ids")
    ends = lists.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    opened = merged.join(ends, "key", "left").join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    closed = found.where("not open")
    hung = closed.where("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("above", "parent_conv_id")
    names = [c.split()[0] for c in _NODE.split(", ")]
    return opened.select(names).unionByName(closed.where("parent_key is null").select(names)).unionByName(hung.select(names))
