"""Prefix trie of conversations, as balanced parentheses.

A turn is known by a 128-bit fingerprint of role and text, a conversation by the list of its turns' fingerprints. Equal conversations
become one path with a count before anything is sorted. Paths are sorted over the cluster, which is the depth-first order of the trie, and cut into
shards of bounded size. A shard writes the parentheses of the nodes that open in it: how many paths share with the path before is how many
nodes stay open. Blocks of least excess find the close of every node (Parens.close), the distance to it is the subtree; leaves are the ranks of
"()" pairs, members and saved tokens differences of running sums, the smallest member a range minimum.

Nodes still open where a shard ends, or open already where it starts, are its spines. They are keyed by their prefix; each shard gives the part of
their sums that lies within it, and the parts are added up by key. There are as many as shards times the depth two neighbours share.

Texts never travel: only fingerprints and lengths do. A conversation's list of turns (24 bytes a turn) is one row.

Turns are ordered by turn, null first; turns of equal number by fingerprint, and repeated rows are turns of their own. Null role or text is empty.
Rows with a null conversation id belong to none and are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.store import narrow, stored

FINGERPRINT = 16
# Turns a shard holds at most, if it has more than one path.
SHARD = 50_000
BLOCK = 64
# Bytes of ids that are hashed as one piece.
PIECE = 1 << 20
HEAD, STRIDE = 6, 100
NONE = hashlib.sha256(b"").hexdigest()
PARTS = ("shard long, spine boolean, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")


class Parens:
    """A string of parentheses (True opens) after `before` unclosed ones, with the least excess of blocks and of pairs of blocks above."""

    def __init__(self, bits: np.ndarray, before: int):
        self.bits, self.before = bits, before
        self.excess = before + np.cumsum(np.where(bits, 1, -1))
        blocks = max(1, -(-len(bits) // BLOCK))
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.size = 1 << (blocks - 1).bit_length()
        self.least = np.full(2 * self.size, np.iinfo(np.int64).max)
        self.least[self.size:self.size + blocks] = padded.reshape(blocks, BLOCK).min(1)
        for i in range(self.size - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def first_at(self, start: np.ndarray, level: np.ndarray) -> np.ndarray:
        """First position from start on whose excess is at most level; the length of the string where there is none."""
        out = np.full(len(start), len(self.bits))
        left = self._within(start, level, np.arange(len(start)), out)
        node = start[left] // BLOCK + self.size
        # Up, until a block to the right reaches the level, then down into the first such block.
        found = np.zeros(len(left), bool)
        active = np.flatnonzero(node > 1)
        while len(active):
            n = node[active]
            hit = (n % 2 == 0) & (self.least[np.minimum(n + 1, len(self.least) - 1)] <= level[left[active]])
            node[active] = np.where(hit, n + 1, n // 2)
            found[active[hit]] = True
            active = active[~hit]
            active = active[node[active] > 1]
        left, node = left[found], node[found]
        while len(inner := np.flatnonzero(node < self.size)):
            child = 2 * node[inner]
            node[inner] = child + (self.least[child] > level[left[inner]])
        self._within((node - self.size) * BLOCK, level[left], left, out)
        return out

    def _within(self, start, level, names, out) -> np.ndarray:
        """Looks at the rest of each start's block; returns the names not found there."""
        at, left = start.copy(), np.arange(len(start))
        end = np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        missed = []
        while len(left):
            over = at >= end[left]
            missed.append(left[over])
            at, left = at[~over], left[~over]
            hit = self.excess[at] <= level[left] if len(at) else np.zeros(0, bool)
            out[names[left[hit]]] = at[hit]
            at, left = at[~hit] + 1, left[~hit]
        return names[np.sort(np.concatenate(missed))] if missed else names[:0]

    def close(self, opened: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at these positions close; the length of the string if they do not."""
        return self.first_at(opened, self.excess[opened] - 1)


def _shared(marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Turns that each path (but the first) has in common with the one before."""
    both = np.minimum(sizes[1:], sizes[:-1])
    row = np.repeat(np.arange(len(both)), both)
    step = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    differ = (marks[starts[1:][row] + step] != marks[starts[:-1][row] + step]).any(1)
    out = both.copy()
    rows, first = np.unique(row[differ], return_index=True)
    out[rows] = step[differ][first]
    return out


def _keys(marks: np.ndarray, depth: int) -> list[bytes]:
    """Keys of the nodes of a path up to a depth."""
    state, out = hashlib.sha256(), []
    for i in range(depth + 1):
        if i:
            state.update(marks[i - 1].tobytes())
        out.append(state.digest()[:FINGERPRINT])
    return out


class Least:
    """Least value of ranges of rows."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << (len(self.levels) - 1)) <= len(values) // 2:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranges [start, end), none empty."""
        level = np.floor(np.log2(end - start)).astype(int)
        out = np.empty(len(start), np.int64)
        for i in np.unique(level):
            own = level == i
            out[own] = np.minimum(self.levels[i][start[own]], self.levels[i][end[own] - (1 << int(i))])
        return out


@dataclass
class Paths:
    """Sorted distinct paths of a shard: fingerprints and lengths of all turns, and per path its turns, conversations, smallest id, ends."""
    marks: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    ends: list[str]

    def __add__(self, other: Paths) -> Paths:
        return Paths(*[np.concatenate([a, b]) if isinstance(a, np.ndarray) else a + b for a, b in zip(self.__dict__.values(), other.__dict__.values())])

    def cut(self, a: int, b: int) -> Paths:
        bounds = np.r_[0, np.cumsum(self.sizes)]
        inside = slice(bounds[a], bounds[b])
        return Paths(self.marks[inside], self.lengths[inside], self.sizes[a:b], self.counts[a:b], self.least[a:b], self.ends[a:b])


def encode(shard: int, paths: Paths, before: int, after: int) -> pa.RecordBatch:
    """Nodes of a shard. before, after: depth down to which nodes are open already at its start, stay open at its end (-1: none)."""
    sizes, rows = paths.sizes, len(paths.sizes)
    starts = np.cumsum(sizes) - sizes
    shared = np.r_[before, _shared(paths.marks, starts, sizes)]
    opened = sizes - shared
    closed = np.r_[sizes[:-1] - shared[1:], sizes[-1] - after]
    bits = np.repeat(np.tile([True, False], rows), np.stack([opened, closed], 1).ravel())
    parens = Parens(bits, before + 1)
    at = np.flatnonzero(bits)
    depth = parens.excess[at] - 1
    row = np.repeat(np.arange(rows), opened)
    last = np.cumsum(opened) - 1
    token = np.r_[paths.lengths, 0]  # the root has no text
    length = token[np.where(depth > 0, starts[row] + depth - 1, len(token) - 1)]
    # Running sums over positions: what lies before each one.
    width = len(bits) + 1

    def running(values, places):
        out = np.zeros(width, np.int64)
        out[places + 1] = values
        return np.cumsum(out)

    whole = np.r_[0, np.cumsum(paths.lengths)]
    total = whole[starts + sizes] - whole[starts]
    texts, members, spoken = running(length, at), running(paths.counts, at[last]), running(paths.counts * total, at[last])
    leaf = np.flatnonzero(bits[:-1] & ~bits[1:])
    leaves = running(1, leaf)
    ended = running(1, at[last])
    smallest = Least(paths.least)

    def told(first, end, above):
        """Of the nodes from position first to their close: members, leaves, saved tokens, smallest member."""
        n = members[end] - members[first]
        # What members say from the node on, once less for each text that stands in the trie.
        saved = spoken[end] - spoken[first] - above * n - (texts[end] - texts[first])
        a, b = ended[first], ended[end]
        least = np.full(len(n), np.iinfo(np.int64).max)
        some = b > a
        least[some] = smallest.of(a[some], b[some])
        return n, leaves[end] - leaves[first], saved, least

    end = parens.close(at)
    above = np.where(depth > 0, whole[starts[row] + np.maximum(depth - 1, 0)] - whole[starts[row]], 0)
    n, under, saved, least = told(at, end, above)
    # The parent is the last node of one depth less that opened before; if there is none, it was open already.
    order = np.lexsort((at, depth))
    ranked = (depth[order].astype(np.int64)) * width + at[order]
    found = np.searchsorted(ranked, (depth - 1) * width + at) - 1
    parent = np.where(found >= 0, order[np.maximum(found, 0)], -1)
    parent = np.where((parent >= 0) & (depth[parent] == depth - 1), parent, -1)
    children = np.bincount(parent[parent >= 0], minlength=len(at))
    outer = np.bincount(depth[parent < 0], minlength=before + 2)[1:before + 2] if before >= 0 else np.zeros(0, np.int64)

    stays = end == len(bits)
    stays &= depth <= after
    first_keys = _keys(paths.marks, before) if before >= 0 else []
    last_keys = _keys(paths.marks[starts[-1]:], after) if after >= 0 else []
    ends = np.full(len(at), None, object)
    ends[last] = paths.ends
    key_of = lambda i: last_keys[depth[i]]
    keys = [key_of(i) if s else None for i, s in enumerate(stays)]
    up = [None if d == 0 else first_keys[d - 1] if p < 0 else key_of(p) if stays[p] else None for d, p in zip(depth, parent)]
    parent_id = [None if d == 0 or u is not None else int(least[p]) for d, p, u in zip(depth, parent, up)]
    # Nodes open already: their part within this shard.
    old = np.arange(before + 1)
    old_end = parens.first_at(np.zeros(before + 1, int), old)
    start = np.zeros(before + 1, int)
    old_n, old_under, old_saved, old_least = told(start, old_end, np.r_[0, whole[:before]] if before >= 0 else old)
    columns = [
        (np.full(len(at) + len(old), shard), pa.int64()), (np.r_[stays, np.ones(len(old), bool)], pa.bool_()),
        (keys + first_keys, pa.binary()), (up + [None, *first_keys[:-1]][:len(old)], pa.binary()), (np.r_[depth, old], pa.int64()),
        (np.r_[least, old_least], pa.int64()), (parent_id + [None] * len(old), pa.int64()), (np.r_[n, old_n], pa.int64()),
        (np.r_[children, outer], pa.int64()), (np.r_[under, old_under], pa.int64()), (np.r_[saved, old_saved], pa.int64()),
        ([*ends, *[None] * len(old)], pa.string())]
    return pa.record_batch([pa.array(v, t) for v, t in columns], [c.split()[0] for c in PARTS.split(", ")])


def _paths(batch: pa.RecordBatch) -> Paths:
    turns, sizes = batch["path"].flatten(), batch["path"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    marks = b"".join(turns.field("f").to_pylist())
    return Paths(np.frombuffer(marks, np.uint8).reshape(-1, FINGERPRINT).view(np.uint64), turns.field("l").to_numpy(zero_copy_only=False).astype(np.int64),
                 sizes, batch["copies"].to_numpy(zero_copy_only=False), batch["least_id"].to_numpy(zero_copy_only=False), batch["ends"].to_pylist())


def _sharded(edges: dict[int, int]):
    """Cuts each range of sorted paths into shards; edges: what the first path of a range shares with the last one of the range before."""
    after_range = dict(zip(list(edges)[:-1], list(edges.values())[1:]))

    def run(batches):
        held, own, before, number = None, None, None, 0

        def emit(paths, after):
            return encode(own << 32 | number, paths, before, after)

        for batch in batches:
            ranges = batch["range"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ranges)]):
                if a == b:
                    continue
                if ranges[a] != own:
                    if held is not None:
                        yield emit(held, after_range.get(own, -1))
                    own, held, number = int(ranges[a]), None, 0
                    before = edges[own]
                part = _paths(batch.slice(a, b - a))
                held = part if held is None else held + part
                # The path after a shard tells which of its nodes stay open, so the last path always waits.
                while len(held.sizes) > 1 and held.sizes.sum() > SHARD:
                    end = int(np.clip(np.searchsorted(np.cumsum(held.sizes), SHARD, "right"), 1, len(held.sizes) - 1))
                    pair = held.cut(end - 1, end + 1)
                    after = int(_shared(pair.marks, np.r_[0, pair.sizes[0]], pair.sizes)[0])
                    yield emit(held.cut(0, end), after)
                    held, before, number = held.cut(end, len(held.sizes)), after, number + 1
        if held is not None:
            yield emit(held, after_range.get(own, -1))

    return run


def fingerprints(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: c (id) and path, its turns in order as fingerprint f and code points l."""
    plain = narrow(turns, c=conv_col, t=turn_col, r=role_col, x=text_col).filter("c is not null").select(
        F.col("c").cast("long").alias("c"), F.col("t").cast("long").alias("t"), F.coalesce("r", F.lit("")).alias("r"), F.coalesce("x", F.lit("")).alias("x"))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x"), 256), 1, 2 * FINGERPRINT))
    marked = plain.select("c", F.struct("t", mark.alias("f"), F.length("x").cast("long").alias("l")).alias("s"))
    return marked.groupBy("c").agg(F.sort_array(F.collect_list("s")).alias("s")).select("c", F.transform("s", lambda s: F.struct(s.f.alias("f"), s.l.alias("l"))).alias("path"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its hundred; how many, its id's checksum tells."""
    head = (F.crc32(F.col("c").cast("string").cast("binary")) % HEAD).cast("int")
    heads = convs.filter(F.col("c") % STRIDE == 0).select(F.col("c").alias("base"), F.slice("path", 1, HEAD - 1).alias("first"))
    based = convs.withColumn("base", F.col("c") - F.col("c") % STRIDE).join(heads, "base", "left")
    lent = F.coalesce(F.slice("first", F.lit(1), head), F.slice("path", 1, 0))
    return based.select("c", F.concat(lent, F.slice("path", head + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


def _ends(convs: DataFrame) -> DataFrame:
    """key, ends: hash of the sorted ids of the conversations of a path. A path's ids may fill many tasks; pieces of text meet in one, in order."""
    def pieces(batches):
        key, first, held, size = None, None, [], 0
        for batch in batches:
            for k, c in zip(batch["key"].to_pylist(), batch["c"].to_pylist()):
                if held and (k != key or size > PIECE):
                    yield key, first, ",".join(held)
                    held, size = [], 0
                if not held:
                    key, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield key, first, ",".join(held)

    def as_batches(rows, names, types, most):
        buffer, size = [], 0
        for r in rows:
            buffer.append(r)
            size += len(r[-1])
            if len(buffer) >= 5000 or size > most:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*buffer), types)], names)
                buffer, size = [], 0
        if buffer:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*buffer), types)], names)

    def hashes(batches):
        key, state = None, None
        for batch in batches:
            for k, text in zip(batch["key"], batch["ids"]):
                k, text = k.as_py(), text.as_py()
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        yield key, state.hexdigest()
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
        if state is not None:
            yield key, state.hexdigest()

    text, number = pa.string(), pa.int64()
    cut = convs.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(
        lambda b: as_batches(pieces(b), ["key", "first", "ids"], [text, number, text], 4 * PIECE), "key string, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        lambda b: as_batches(hashes(b), ["key", "ends"], [text, text], 4 * PIECE), "key string, ends string")


def nodes(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of convs (c, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = F.sha2(F.array_join(F.transform("path", lambda s: F.hex(s.f)), ""), 256)
    keyed = stored(convs.select("c", "path", key.alias("key")), "trie-conversations")
    distinct = keyed.groupBy("key", "path").agg(F.count(F.lit(1)).alias("copies"), F.min("c").alias("least_id")).join(_ends(keyed), "key").drop("key")
    # Ranges of the sorted paths: tasks of the sort, however Spark cuts it.
    ranged = stored(distinct.repartitionByRange("path").withColumn("range", F.spark_partition_id().cast("long")), "trie-ranges")
    edge = ranged.groupBy("range").agg(F.min("path").alias("a"), F.max("path").alias("b")).withColumn("p", F.lag("b").over(Window.orderBy("range")))
    both = F.least(F.size("a"), F.size("p"))
    same = F.transform(F.sequence(F.lit(0), F.greatest(both - 1, F.lit(0))), lambda i: F.get("a", i).eqNullSafe(F.get("p", i)))
    differ = F.array_position(same, F.lit(False))
    shared = F.when(F.col("p").isNull(), -1).when(both == 0, 0).when(differ == 0, both).otherwise(differ - 1)
    # One number per range reaches the driver.
    edges = {r["range"]: r["shared"] for r in edge.select("range", shared.cast("int").alias("shared")).orderBy("range").collect()}
    parts = stored(ranged.repartition("range").sortWithinPartitions("range", "path").mapInArrow(_sharded(edges), PARTS), "trie-nodes")
    spines = parts.filter("spine")
    merged = stored(spines.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256")), "trie-spines")
    told = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    whole = merged.join(told, "parent_key", "left")
    # A parent on a spine is looked up by shard and key, so that no key is more frequent than a shard is long.
    refs = spines.select("shard", F.col("key").alias("parent_key")).distinct().join(told, "parent_key")
    inner = parts.filter("not spine")
    below = inner.filter("parent_key is not null").drop("parent_conv_id").join(refs, ["shard", "parent_key"]).withColumnRenamed("found", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = inner.filter("parent_key is null").select(columns).unionByName(below.select(columns)).unionByName(
        whole.withColumnRenamed("found", "parent_conv_id").select(columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))


def build(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_heads: bool = False) -> DataFrame:
    """Nodes of the trie of all conversations of a table of turns; shared_heads: with openings taken from the first of each hundred."""
    convs = fingerprints(turns, conv_col, turn_col, role_col, text_col)
    return nodes(with_shared_heads(convs) if shared_heads else convs)
