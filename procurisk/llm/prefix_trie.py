"""The trie of all conversation prefixes: union-find over sorted neighbours, forests of partitions merged across boundaries.

Conversations become sequences of turn digests and are sorted. Within a partition, the edges between sorted neighbours carry the
length of their longest common prefix. Union-find takes them in descending depth: every merge of two components creates a
branching node (or adds a child to the one just created at that depth), and what lies below a merged component is complete.

Only prefixes of a partition's first and last sequence can occur in other partitions. These two spines, with everything that hangs
off them folded into their numbers, are the contracted forest of the partition. Contracted forests of GROUP neighbouring partitions
are merged by prefix, again in descending depth; what is not on the two outer spines of the group is complete there, and the
outer spines go on to the next level, until one group is left. A task holds one partition, or the spines of GROUP partitions.

Turns are ordered by turn, null first, then by digest. A null role or text is empty. Rows without conv_id belong to no conversation
and take no part; equal rows are turns of their own; other columns are ignored. An empty table has no node. A conversation's digests
(some 40 bytes a turn) must fit into a row, its texts need not. Members of a prefix are hashed in order of their ids: those of a
sequence that fills several partitions are joined to one string a partition first, so that the step which has to be
sequential sees only those strings, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.llm import shared

#: Sequences and bytes of digests of a partition, at most about so many.
PARTITION_ROWS = 200_000
PARTITION_BYTES = 32 << 20
#: Partitions whose contracted forests are merged in one task.
GROUP = 64
#: Rows of a batch that leaves a task.
BATCH_ROWS = 10_000
DIGEST = 16
NO_MEMBER = hashlib.sha256(b"").hexdigest()

NODE, SPINE, MEMBERS = 0, 1, 2
#: What a task gives: finished nodes, spine nodes (key, what is complete below), and members of the sequences that end on a spine.
SCHEMA = (
    "kind int, part long, key binary, parent_key binary, depth long, bytes long, conv_id long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, ends_sha256 string, on_first boolean, on_last boolean, members string"
)
FIELDS = [name.split()[0] for name in SCHEMA.split(",")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits for a role and a text; the length of the role keeps the two apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * DIGEST)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (digest, bytes of the text) in order, a row per conversation. Texts are digested before they are shuffled."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = F.struct("turn", turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    turns = F.sort_array(F.collect_list("one"))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns")
    )


def with_shared_heads(lists: DataFrame, every: int, heads: int) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every for its own first h; h = crc32(c) % (heads + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (heads + 1)).cast("int")
    first = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head")
    )
    joined = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def common_depth(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix, by bisection over equal prefixes."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """A key for each prefix, from the empty one on."""
    keys = [b""]
    for at in range(0, len(path), DIGEST):
        keys.append(hashlib.blake2b(keys[-1] + path[at : at + DIGEST], digest_size=DIGEST).digest())
    return keys


class Forest:
    """The compact trie of sorted distinct sequences. A node stands for the chain of prefixes down to its ``depth``."""

    def __init__(self, paths: list[bytes], sizes: list[list[int]], counts: list[int], lows: list[int]):
        self.paths = paths
        #: bytes of the first d texts
        self.before = []
        for row in sizes:
            sums = [0]
            for size in row:
                sums.append(sums[-1] + size)
            self.before.append(sums)
        m = len(paths)
        self.depth = [len(path) // DIGEST for path in paths]
        self.n, self.low = list(counts), list(lows)
        self.kids, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        self.up: list[int | None] = [None] * m
        #: a sequence below the node
        self.sample = list(range(m))
        self._union(m)

    def below(self, node: int) -> int:
        """Childless prefixes under the node, itself included."""
        return self.leaves[node] if self.kids[node] else 1

    def chain(self, node: int, depth: int) -> int:
        """Tokens saved on the node's chain below ``depth``."""
        before = self.before[self.sample[node]]
        return (self.n[node] - 1) * (before[self.depth[node]] - before[depth])

    def _new(self, depth: int, child: int) -> int:
        """A node at ``depth`` above the component that ``child`` tops."""
        self.depth.append(depth)
        self.n.append(0)
        self.low.append(self.low[child])
        for column in (self.kids, self.leaves, self.saved):
            column.append(0)
        self.up.append(None)
        self.sample.append(self.sample[child])
        node = len(self.up) - 1
        self._attach(child, node)
        return node

    def _attach(self, child: int, node: int) -> None:
        self.up[child] = node
        self.n[node] += self.n[child]
        self.low[node] = min(self.low[node], self.low[child])
        self.kids[node] += 1
        self.leaves[node] += self.below(child)
        self.saved[node] += self.saved[child] + self.chain(child, self.depth[node])

    def _union(self, m: int) -> None:
        edges = [common_depth(a, b) for a, b in zip(self.paths, self.paths[1:])]
        parent, top = list(range(m)), list(range(m))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # equal depths from left to right: then the right component's top is always deeper than the edge
        for i in sorted(range(m - 1), key=lambda i: -edges[i]):
            left, right = find(i), find(i + 1)
            node = top[left]
            if self.depth[node] > edges[i]:
                node = self._new(edges[i], node)
            self._attach(top[right], node)
            parent[right] = left
            top[left] = node
        self.root = top[find(0)]
        if self.depth[self.root] > 0:
            self.root = self._new(0, self.root)

    def ancestors(self, node: int | None) -> list[int]:
        found = []
        while node is not None:
            found.append(node)
            node = self.up[node]
        return found


class Rows:
    """Rows of SCHEMA on their way out of a task."""

    def __init__(self):
        self.columns: dict[str, list] = {name: [] for name in FIELDS}

    def add(self, **values) -> None:
        for name in FIELDS:
            self.columns[name].append(values.get(name))

    def full(self) -> bool:
        return len(self.columns["kind"]) >= BATCH_ROWS

    def taken(self) -> pa.RecordBatch:
        types = [TYPES[part.split()[1]] for part in SCHEMA.split(",")]
        arrays = [pa.array(self.columns[name], kind) for name, kind in zip(FIELDS, types)]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, FIELDS)


def partition_forest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finished nodes, spines and spine members of one partition of sequences, sorted by path and conv_id."""
    part, paths, sizes, counts, lows, ends = None, [], [], [], [], []
    members: list[int] = []
    first_members = ""

    def close() -> None:
        nonlocal first_members
        text = ",".join(map(str, members))
        if len(paths) == 1:
            first_members = text
        counts.append(len(members))
        lows.append(members[0])
        ends.append(hashlib.sha256(text.encode()).hexdigest())

    for batch in stream:
        if batch.num_rows and part is None:
            part = batch.column("part")[0].as_py()
        for path, row, conv_id in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv_id"))):
            if not paths or path != paths[-1]:
                if paths:
                    close()
                paths.append(path)
                sizes.append(row)
                members = []
            members.append(conv_id)
    if not paths:
        return
    close()
    last_members = ",".join(map(str, members))
    forest = Forest(paths, sizes, counts, lows)
    m = len(paths)
    spines = [(0, forest.ancestors(0))] + ([(m - 1, forest.ancestors(m - 1))] if m > 1 else [])
    on_spine = {node for _, nodes in spines for node in nodes}
    keys = {leaf: prefix_keys(paths[leaf]) for leaf, _ in spines}
    key_of = {node: keys[leaf][forest.depth[node]] for leaf, nodes in spines for node in nodes}
    done = {node: [0, 0, 0] for node in on_spine}
    out = Rows()
    for node in range(len(forest.up)):
        if node in on_spine:
            continue
        above = forest.up[node]
        top = forest.depth[above]
        if above in on_spine:
            folded = done[above]
            folded[0] += 1
            folded[1] += forest.below(node)
            folded[2] += forest.saved[node] + forest.chain(node, top)
        for depth in range(forest.depth[node], top, -1):
            bottom, upmost = depth == forest.depth[node], depth == top + 1
            out.add(
                kind=NODE,
                part=part,
                depth=depth,
                conv_id=forest.low[node],
                parent_key=key_of.get(above) if upmost else None,
                parent_conv_id=None if upmost and above in on_spine else forest.low[above] if upmost else forest.low[node],
                n_convs=forest.n[node],
                n_children=forest.kids[node] if bottom else 1,
                n_leaves=forest.below(node),
                saved_tokens=forest.saved[node] + forest.chain(node, depth - 1),
                ends_sha256=ends[node] if bottom and node < m else NO_MEMBER,
            )
            if out.full():
                yield out.taken()
    shared_depth = common_depth(paths[0], paths[-1]) if m > 1 else -1
    for leaf, nodes in spines:
        first, last = leaf == 0, leaf == m - 1
        for node in nodes:
            above = forest.up[node]
            for depth in range(forest.depth[node], forest.depth[above] if above is not None else -1, -1):
                if not first and depth <= shared_depth:
                    continue  # given with the first spine
                complete = done[node] if depth == forest.depth[node] else (0, 0, 0)
                before = forest.before[leaf]
                out.add(
                    kind=SPINE,
                    part=part,
                    key=keys[leaf][depth],
                    parent_key=keys[leaf][depth - 1] if depth else None,
                    depth=depth,
                    bytes=before[depth] - before[depth - 1] if depth else 0,
                    conv_id=forest.low[node],
                    n_convs=forest.n[node],
                    n_children=complete[0],
                    n_leaves=complete[1],
                    saved_tokens=complete[2],
                    on_first=first,
                    on_last=last or depth <= shared_depth,
                )
                if out.full():
                    yield out.taken()
        out.add(kind=MEMBERS, part=part, key=keys[leaf][-1], members=first_members if first else last_members)
    # a sequence that ends on a spine without being the first or last one is whole in this partition
    for node in on_spine:
        if 0 < node < m - 1:
            leaf = next(leaf for leaf, nodes in spines if node in nodes)
            out.add(kind=MEMBERS, part=part, key=keys[leaf][forest.depth[node]], ends_sha256=ends[node])
    yield out.taken()


def merged_spines(last: bool):
    """The function that merges the contracted forests of a group; ``last`` if no other group is left."""

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda row: row["part"])
        lowest, highest = rows[0]["part"], rows[-1]["part"]
        nodes: dict[bytes, dict] = {}
        for row in rows:
            row["on_first"] &= row["part"] == lowest
            row["on_last"] &= row["part"] == highest
            node = nodes.setdefault(row["key"], row)
            if node is row:
                continue
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            node["on_first"] |= row["on_first"]
            node["on_last"] |= row["on_last"]
        out = Rows()
        for node in sorted(nodes.values(), key=lambda node: -node["depth"]):
            node["part"] = lowest // GROUP
            if not last and (node["on_first"] or node["on_last"]):
                out.add(**node)
                continue
            node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["bytes"]
            above = nodes[node["parent_key"]] if node["depth"] else None
            closed = {"kind": NODE, "parent_key": None}
            if above is not None:
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]
                if not last and (above["on_first"] or above["on_last"]):
                    closed["parent_key"] = node["parent_key"]
                else:
                    closed["parent_conv_id"] = above["conv_id"]
            out.add(**{**node, **closed})
        return pa.Table.from_batches([out.taken()])

    return merge


def member_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256 of the sequences that end on a spine: strings of members in order of the partitions, one at a time."""

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, given = None, None, None
        found: list[tuple[bytes, str]] = []
        for batch in stream:
            for this, text, known in zip(*(batch.column(c).to_pylist() for c in ("key", "members", "ends_sha256"))):
                if state is None or this != key:
                    if state is not None:
                        found.append((key, given or state.hexdigest()))
                    key, state, given = this, hashlib.sha256(), known
                    state.update((text or "").encode())
                elif text is not None:
                    state.update(b"," + text.encode())
        if state is not None:
            found.append((key, given or state.hexdigest()))
        keys, digests = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])

    ordered = members.select("key", "part", "members", "ends_sha256").repartition("key").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(lists: DataFrame) -> DataFrame:
    """A row per node over (conv_id, turns), as ``turn_lists`` and ``with_shared_heads`` give them.

    conv_id is the node's smallest member, parent_conv_id that of its parent (null at the root); n_convs counts members, n_children
    children, n_leaves childless nodes of the subtree; saved_tokens adds (n_convs - 1) * bytes of the last text over the subtree;
    ends_sha256 digests the ids that end at the node, ascending, joined by commas.
    """
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    sequences = shared.stored(
        lists.select("conv_id", F.unhex(digests).alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")),
        "sequences",
    )
    spark = sequences.sparkSession
    rows, size = sequences.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    needed = max(-(-rows // PARTITION_ROWS), -(-size // PARTITION_BYTES), 1)
    parts = max(needed, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 256) or 1))
    # a sort by path and id: a sequence with a third of all members fills as many partitions as it needs
    ordered = sequences.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("part"), "path", "sizes", "conv_id")
    forests = shared.stored(ordered.mapInArrow(partition_forest, SCHEMA), "forests")

    spines, above = forests.where(F.col("kind") == SPINE), []
    highest = spines.agg(F.max("part")).first()[0] or 0
    while True:
        highest //= GROUP
        grouped = spines.groupBy(F.floor(F.col("part") / GROUP).alias("group"))
        level = shared.stored(grouped.applyInArrow(merged_spines(highest == 0), SCHEMA), "merged-spines")
        above.append(level.where(F.col("kind") == NODE))
        if highest == 0:
            break
        spines = level.where(F.col("kind") == SPINE)
    merged = above[0]
    for more in above[1:]:
        merged = merged.unionByName(more)

    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    final = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    # a popular parent has children in many partitions; within one they are bounded, so they meet by partition and parent
    of_parts = forests.where(F.col("kind") == SPINE).select("part", F.col("key").alias("parent_key")).join(final, "parent_key")
    nodes = forests.where(F.col("kind") == NODE)
    inner = nodes.where("parent_key IS NULL").select(*columns)
    hanging = (
        nodes.where("parent_key IS NOT NULL")
        .join(of_parts, ["part", "parent_key"])
        .withColumn("parent_conv_id", F.col("above"))
        .select(*columns)
    )
    ends = member_digests(forests.where(F.col("kind") == MEMBERS))
    shared_nodes = (
        merged.drop("ends_sha256")
        .join(final, "parent_key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        .join(ends, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBER)))
        .select(*columns)
    )
    return inner.unionByName(hanging).unionByName(shared_nodes)
