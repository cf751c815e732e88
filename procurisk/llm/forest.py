"""Near copies by a MinHash LSH forest.

Every distinct set of shingles has a MinHash signature. Several orders (permutations of the signature) sort the sets; sets that
share a prefix of an order lie next to each other, in a region. A region that is too large is read at a greater depth, others at
the least one. What the depth would part, pivots hold together: some members of the large region meet all others of it, cell by
cell. Members of a large region that are not in one component by then meet too, block by block, so no pair of it is left out. Inside a region short sketches drop pairs that cannot be close enough; whoever is left comes back with the
whole text, and links are confirmed on the full sets. A region hands out a spanning forest of its links, so a group of copies
never becomes all its pairs, and connected components of the links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.llm import batches, shared

SHINGLE_WORDS = 5
#: Linked when 100 * |intersection| >= SIMILAR_PERCENT * |union|.
SIMILAR_PERCENT = 75
#: Signature length, number of orders, and the depths at which a region may be read. A pair of similarity 0.75 shares no prefix of
#: the least depth in any order with a chance of (1 - 0.75**3)**16, about 2e-4; closer pairs less.
SIGNATURE = 48
ORDERS = 16
DEPTHS = (3, 5, 8, 12, 20, 48)
#: Members of a region; beyond it the next depth is taken.
REGION = 2048
#: Members of a larger region that meet all its others, about.
PIVOTS = 256
#: Bins of the sketch (one hash per bin, kept as a byte) and the margin by which its estimate may fall below the limit.
SKETCH = 256
MARGIN = 3.5
SEED = 20_240_229


def permutations() -> np.ndarray:
    """ORDERS x max depth: order t begins with signature positions 3t, 3t + 1, 3t + 2, so the least prefixes share none."""
    random = np.random.default_rng(SEED)
    orders = []
    for t in range(ORDERS):
        first = np.arange(DEPTHS[0]) + DEPTHS[0] * t
        rest = np.setdiff1d(np.arange(SIGNATURE), first)
        orders.append(np.concatenate([first, random.permutation(rest)]))
    return np.array(orders)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    digests = b"".join([hashlib.blake2b(word, digest_size=8).digest() for word in distinct.cast(pa.binary()).to_pylist()])
    return np.frombuffer(digests, dtype="<u8").astype(np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, rising, and their number per text. A-Z count as a-z."""
    items, counts = batches.words(pc.ascii_lower(column))
    code, distinct = batches.codes(items)
    hashes = word_hashes(distinct)[code] if len(code) else np.zeros(0, dtype=np.uint64)
    edges = batches.bounds(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    rows, keys = [], []
    with np.errstate(over="ignore"):
        # one shingle for the whole sequence of a short text: its length takes part, so it equals no part of another text
        for n in range(1, SHINGLE_WORDS):
            short = np.flatnonzero(counts == n)
            key = np.full(len(short), n, dtype=np.uint64)
            for j in range(n):
                key = mixed(key + hashes[edges[short] + j])
            rows.append(short)
            keys.append(key)
        number = max(0, len(hashes) - SHINGLE_WORDS + 1)
        key = np.full(number, SHINGLE_WORDS, dtype=np.uint64)
        for j in range(SHINGLE_WORDS):
            key = mixed(key + hashes[j : j + number])
        inside = text[:number] == text[SHINGLE_WORDS - 1 :] if number else np.zeros(0, dtype=bool)
        rows.append(text[:number][inside])
        keys.append(key[inside])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return key[fresh], np.bincount(row[fresh], minlength=len(counts)).astype(np.int64)


def signatures(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x SIGNATURE: the least value of each hash function over a set; 0 for empty sets."""
    random = np.random.default_rng(SEED)
    factors = random.integers(1, 1 << 63, size=SIGNATURE, dtype=np.uint64) | np.uint64(1)
    found = np.zeros((len(counts), SIGNATURE), dtype=np.uint32)
    filled = np.flatnonzero(counts)
    if not filled.size:
        return found
    starts = batches.bounds(counts)[filled]
    with np.errstate(over="ignore"):
        for i, factor in enumerate(factors):
            found[filled, i] = np.minimum.reduceat(((keys ^ factor) * factor) >> np.uint64(32), starts)
    return found


def sketches(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x SKETCH bytes: per bin of the hash, a byte of the least hash in it; 0 where no hash falls."""
    row = np.repeat(np.arange(len(counts)), counts)
    cell = row * SKETCH + (keys & np.uint64(SKETCH - 1)).astype(np.int64)
    least = np.full(len(counts) * SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, cell, keys >> np.uint64(8))
    byte = 1 + (mixed(least) % np.uint64(255)).astype(np.uint8)
    byte[least == np.iinfo(np.uint64).max] = 0
    return byte.reshape(len(counts), SKETCH)


def close(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For pairs of sketch rows, the estimated similarity plus ``MARGIN`` standard errors."""
    some = ((one != 0) | (two != 0)).sum(axis=-1)
    same = ((one == two) & (one != 0)).sum(axis=-1)
    share = same / np.maximum(some, 1)
    limit = SIMILAR_PERCENT / 100
    return share + MARGIN * np.sqrt(limit * (1 - limit) / np.maximum(some, 1))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty), signature and sketch of every document."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in batches.pieces(batch, "text"):
                keys, counts = shingle_sets(batches.texts(piece))
                edges = batches.bounds(counts)
                raw = keys.astype("<u8").tobytes()
                names = [
                    hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
                    for a, b in zip(edges[:-1], edges[1:])
                ]
                minima, bytes_ = signatures(keys, counts), sketches(keys, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(counts), pa.array(names, type=pa.binary()),
                        pa.array([x.tobytes() for x in minima.astype("<u4")], type=pa.binary()),
                        pa.array([x.tobytes() for x in bytes_], type=pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature", "sketch"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, sketch binary")


def prefix_rows(sets: DataFrame, level: int) -> DataFrame:
    """set_key, t and region, a hash of the first ``DEPTHS[level]`` minima in order t, for all orders."""
    orders, depth = permutations(), DEPTHS[level]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u4").reshape(-1, SIGNATURE)
            with np.errstate(over="ignore"):
                for t in range(ORDERS):
                    key = np.full(len(minima), t + 1, dtype=np.uint64)
                    for position in orders[t][:depth]:
                        key = mixed(key + minima[:, position] + np.uint64(0x9E3779B97F4A7C15))
                    order = pa.array(np.full(len(minima), t, dtype=np.int32))
                    # 0 stands for no region
                    region = pa.array((key | np.uint64(1)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("set_key"), order, region], names=["set_key", "t", "region"]
                    )

    return sets.select("set_key", "signature").mapInArrow(run, "set_key binary, t int, region long")


def regions(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions with more than one member that a set lies in: those to be searched, and the larger ones that need pivots.

    The first table has set_key, t, region, one row per order at most. Counting starts at the least depth; only the members of regions
    over ``REGION`` go on to the next one. Sets that still share the whole signature in such a number are all but equal; each order
    deals them anew into cells, so that together the orders tie them to one another. The second table adds level, members and
    pivoted, the members of the region around that has pivots already: a region gets its own at half of that size.
    """
    left, done, kept, large = None, [], None, []
    for level, depth in enumerate(DEPTHS):
        keyed = prefix_rows(sets, level)
        if left is None:
            keyed = keyed.withColumn("pivoted", F.lit(None).cast("long"))
        else:
            keyed = keyed.join(left, ["set_key", "t"])
        counted = keyed.groupBy("t", "region").agg(F.count("*").alias("members")).where("members > 1")
        kept = shared.stored(keyed.join(counted, ["t", "region"]), f"forest-depth-{depth}")
        done.append(kept.where(F.col("members") <= REGION).select("set_key", "t", "region"))
        over = kept.where(F.col("members") > REGION)
        smaller = F.expr("pivoted IS NULL OR 2 * members <= pivoted")
        large.append(over.where(smaller).select("set_key", "t", "region", F.lit(level).alias("level"), "members", "pivoted"))
        left = over.select("set_key", "t", F.when(smaller, F.col("members")).otherwise(F.col("pivoted")).alias("pivoted"))
        if left.isEmpty():
            break
    else:
        cell = F.pmod(F.xxhash64("set_key", "t"), F.ceil(F.col("members") / (REGION // 2)))
        cells = kept.where(F.col("members") > REGION).select("set_key", "t", F.xxhash64("region", cell).alias("region"))
        done.append(cells)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, large)


def slots(places: Column) -> Column:
    """The regions of a map from order to region, as an array over the orders; 0 for none."""
    return F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda t: F.coalesce(places[t], F.lit(0).cast("long")))


def pivot_cells(large: DataFrame) -> DataFrame:
    """t, region, set_key, slots, marks, side, root: large regions dealt into cells of about ``REGION`` sets, with all pivots in each.

    Pivots are the sets with the least hashes; how many depends on the region, so ``marks`` has a bit for each order in which the set is
    one. A set and a pivot meet once, in the first order that they share and where one of the two is a pivot. Those of the region
    around are left out. The cells of level l are numbered as orders of their own.
    """
    turn = F.pmod(F.xxhash64("set_key", F.lit("pivot")), F.lit(1 << 31)) / float(1 << 31)
    pivot = (turn < PIVOTS / F.col("members")) & (F.col("pivoted").isNull() | (turn >= PIVOTS / F.col("pivoted")))
    at = F.struct("t", "region", "members", F.coalesce(pivot, F.lit(False)).alias("pivot"))
    by_set = large.groupBy("set_key", "level").agg(F.collect_list(at).alias("at"))
    marks = F.expr("aggregate(at, 0, (bits, x) -> bits + IF(x.pivot, shiftleft(1, x.t), 0))")
    placed = by_set.select(
        "set_key",
        "level",
        slots(F.map_from_entries(F.transform("at", lambda x: F.struct(x["t"], x["region"])))).alias("slots"),
        marks.alias("marks"),
        F.inline("at"),
    )
    number = F.ceil(F.col("members") / REGION)
    own = F.array(F.pmod(F.xxhash64("set_key", "t", "level"), number))
    cells = placed.withColumn(
        "cell", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), number - 1)).otherwise(own))
    )
    order = (F.col("t") + ORDERS * (F.col("level") + 1)).cast("int")
    side = F.when(F.col("pivot"), 0).otherwise(2)
    return cells.select(order.alias("t"), F.xxhash64("region", "cell").alias("region"), "set_key", "slots", "marks", side.alias("side"), F.col("set_key").alias("root"))


def block_cells(large: DataFrame, roots: DataFrame) -> DataFrame:
    """t, region, set_key, slots, marks, side, root: every pair of members of a large region that ``roots`` does not join, in a cell.

    ``large`` has the regions of the least depth. Members are dealt into blocks of about half of ``REGION``, those of a component with
    more members than that into blocks of their own; each block meets each other one, except those of its own component. So the rows
    grow with the square of a region only where it has no large components, and a cell stays bounded.
    """
    block = REGION // 2
    named = large.join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select(
        "set_key", "t", "region", F.coalesce("root", "set_key").alias("root")
    )
    counted = named.groupBy("t", "region", "root").agg(F.count("*").alias("n"))
    # the empty name stands for all small components of a region
    group = F.when(F.col("n") > block, F.col("root")).otherwise(F.lit(b""))
    groups = counted.groupBy("t", "region", group.alias("name")).agg(F.ceil(F.sum("n") / block).alias("blocks"))
    groups = shared.stored(groups, "forest-blocks")
    every = groups.groupBy("t", "region").agg(F.collect_list(F.struct("name", "blocks")).alias("every"))
    by_set = large.groupBy("set_key").agg(F.map_from_entries(F.collect_list(F.struct("t", "region"))).alias("places"))
    dealt = (
        named.join(every, ["t", "region"])
        .join(by_set.select("set_key", slots(F.col("places")).alias("slots")), "set_key")
        .withColumn("own", F.expr("coalesce(get(filter(every, x -> x.name = root), 0), get(filter(every, x -> x.name = X''), 0))"))
        .withColumn("own", F.struct("own.name", F.pmod(F.xxhash64("set_key", F.lit("block")), F.col("own.blocks")).alias("number")))
    )
    others = F.expr(
        "flatten(transform(filter(every, x -> x.name = X'' OR x.name <> own.name),"
        " x -> transform(sequence(0L, x.blocks - 1), j -> struct(x.name AS name, j AS number))))"
    )
    met = dealt.withColumn("other", F.explode(others))
    own, other = F.col("own"), F.col("other")
    return met.select(
        "t",
        F.xxhash64("region", F.least(own, other), F.greatest(own, other)).alias("region"),
        "set_key",
        "slots",
        F.lit((1 << ORDERS) - 1).alias("marks"),
        F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"),
        "root",
    )


def whole_regions(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition, cut only between regions."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        held.append(batch)
        t, region = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("t", "region"))
        inner = np.flatnonzero((t != t[-1]) | (region != region[-1]))
        cut = int(inner[-1]) + 1 if inner.size else 0
        before = held[0].column("t")[0], held[0].column("region")[0]
        if not cut and (batch.column("t")[0], batch.column("region")[0]) == before:
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def root_codes(table: pa.Table) -> np.ndarray:
    """A number for the root of each row."""
    return table["root"].combine_chunks().dictionary_encode().indices.to_numpy()


def close_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs that lie in one region, for the first time in the order of the orders, and may be links.

    Rows come by side. Those of side 0 (all of a small region, pivots, a block with itself) meet all rows after them, those of side 1
    only side 2, and side 2 does not meet itself. Rows of one root are joined already.
    """
    t, region, size = (table[name].to_numpy() for name in ("t", "region", "n_shingles"))
    held = table["slots"].combine_chunks().flatten().to_numpy().reshape(-1, ORDERS)
    marks = (table["marks"].to_numpy()[:, None] >> np.arange(ORDERS)) & 1 == 1
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    fresh = np.concatenate([[True], (region[1:] != region[:-1]) | (t[1:] != t[:-1])])
    starts = np.flatnonzero(fresh)
    last = np.repeat(np.append(starts[1:], len(t)), np.diff(np.append(starts, len(t)))) - 1
    side, root = table["side"].to_numpy(), root_codes(table)
    rows = np.flatnonzero(side < 2)
    ahead = last[rows] - rows
    for step in range(1, int(ahead.max(initial=0)) + 1):
        for one in np.array_split(rows[ahead >= step], max(1, len(rows) // 20_000)):
            two = one + step
            fit = 100 * np.minimum(size[one], size[two]) >= SIMILAR_PERCENT * np.maximum(size[one], size[two])
            fit &= ((side[one] == 0) | (side[one] < side[two])) & (root[one] != root[two])
            one, two = one[fit], two[fit]
            shared_orders = (held[one] == held[two]) & (held[one] != 0) & (marks[one] | marks[two])
            first = shared_orders.argmax(axis=1) == t[one] % ORDERS
            one, two = one[first], two[first]
            near = close(sketch[one], sketch[two]) >= SIMILAR_PERCENT / 100
            if near.any():
                yield one[near], two[near]


KEPT = "t int, region long, set_key binary, rep long, n_shingles long, slots array<long>, marks int, sketch binary, side int, root binary"


def close_members(members: DataFrame) -> DataFrame:
    """The rows of a region's members that may be linked with another one there."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_regions(stream):
            near = np.zeros(table.num_rows, dtype=bool)
            for one, two in close_pairs(table):
                near[one] = near[two] = True
            yield from table.filter(pa.array(near)).combine_chunks().to_batches()

    return members.repartition("t", "region").sortWithinPartitions("t", "region", "side", "set_key").mapInArrow(run, KEPT)


def links(members: DataFrame) -> DataFrame:
    """one, two: set keys of confirmed links, a spanning forest for each region.

    Candidates are taken by falling estimate; a pair that the links so far already join is not looked at. Rows whose text is not that
    of the set (another row with the same id) are passed over.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_regions(stream):
            keys, texts = table["set_key"].to_pylist(), table["text"]
            sets: dict[int, np.ndarray] = {}
            for row in range(table.num_rows):
                held = shingle_sets(pa.array([texts[row].as_py() or ""], type=pa.string()))[0]
                if hashlib.blake2b(held.astype("<u8").tobytes(), digest_size=16).digest() == keys[row]:
                    sets[row] = held
            _, first, code = np.unique(root_codes(table), return_index=True, return_inverse=True)
            parent = first[code].tolist()

            def root(row: int) -> int:
                while parent[row] != row:
                    parent[row] = parent[parent[row]]
                    row = parent[row]
                return row

            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            pairs = list(close_pairs(table))
            found: list[tuple[bytes, bytes]] = []
            if pairs:
                one, two = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                order = np.argsort(-np.concatenate([close(sketch[a], sketch[b]) for a, b in pairs]), kind="stable")
                for a, b in zip(one[order].tolist(), two[order].tolist()):
                    x, y = root(a), root(b)
                    if x == y or a not in sets or b not in sets:
                        continue
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * common >= SIMILAR_PERCENT * (len(sets[a]) + len(sets[b]) - common):
                        parent[x] = y
                        found.append((keys[a], keys[b]))
            if found:
                columns = [pa.array(column, type=pa.binary()) for column in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["one", "two"])

    placed = members.repartition("t", "region").sortWithinPartitions("t", "region", "side", "set_key")
    return placed.mapInArrow(run, "one binary, two binary")


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges (one, two): the same root for connected nodes.

    Each round maps every node to the least of itself and its neighbours and contracts the graph by that map, until no edge is left; the
    maps are then applied one after the other. The number of rounds grows with the logarithm of a component's extent.
    """
    maps: list[DataFrame] = []
    left = shared.stored(edges.where("one <> two").distinct(), "links")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("two").alias("one"), F.col("one").alias("two")))
        step = both.groupBy(F.col("one").alias("node")).agg(F.least(F.first("one"), F.min("two")).alias("root"))
        maps.append(shared.stored(step, "contraction"))
        heads = [maps[-1].select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("one", "two")]
        moved = left.join(heads[0], "one").join(heads[1], "two")
        left = moved.select(F.col("one_root").alias("one"), F.col("two_root").alias("two")).where("one <> two").distinct()
        left = shared.stored(left, "links")
    if not maps:
        return edges.select(F.col("one").alias("node"), F.col("two").alias("root")).limit(0)
    found = maps[0]
    for step in maps[1:]:
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    ``component_id`` is the least doc_id among all documents that links connect, ``kept`` whether it is the row's own. Texts without words
    (null too) have no shingles and stand alone. Equal sets are one node from the start. A row without id belongs to the component of
    an equal set that has one, and is kept, without a component_id, if there is none. Rows that repeat an id and a text are all
    kept or all not. An empty table gives no rows.
    """
    rows = shared.stored(described(docs), "shingles")
    sets = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch"),
    )
    sets = shared.stored(sets, "sets")
    searched, large = regions(sets)
    entries = F.map_from_entries(F.collect_list(F.struct("t", "region")))
    placed = searched.groupBy("set_key").agg(entries.alias("places")).select(
        F.explode("places").alias("t", "region"),
        "set_key",
        slots(F.col("places")).alias("slots"),
        F.lit((1 << ORDERS) - 1).alias("marks"),
        F.lit(0).alias("side"),
        F.col("set_key").alias("root"),
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].cast("string").alias("text"))

    def confirmed(cells: DataFrame) -> DataFrame:
        members = (
            sets.drop("signature")
            .join(cells, "set_key")
            .select("t", "region", "set_key", "rep", "n_shingles", "slots", "marks", "sketch", "side", "root")
        )
        near = shared.stored(close_members(members), "close")
        return shared.stored(links(near.join(texts, "rep")), "edges")

    edges = confirmed(placed.unionByName(pivot_cells(large)))
    roots = components(edges)
    unread = large.where("level = 0").select("set_key", "t", "region")
    if not unread.isEmpty():
        edges = edges.unionByName(confirmed(block_cells(unread, roots)))
        roots = components(edges)
    named = (
        sets.select("set_key", "rep")
        .join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left")
        .withColumn("root", F.coalesce("root", "set_key"))
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    labels = named.join(least, "root").select("set_key", "component")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component of near copies, with all columns.

    Rows without id get one from a hash of their text for the time being, below all others of their kind, so they take part like any
    other. Rows that repeat an id and a text count as one; rows that share an id but not the text are told apart by the text.
    """
    own = F.coalesce(docs["doc_id"].cast("long"), -1 - F.abs(F.xxhash64(docs["text"]) % (1 << 62)))
    name = shared.free_name(docs, "near_copy_id")
    decided = near_copies(docs.select(own.alias("doc_id"), "text")).where("kept")
    ids = decided.select(F.col("doc_id").alias(name)).distinct()
    chosen = docs.withColumn(name, own).join(ids, name, "left_semi")
    return chosen.dropDuplicates([name, "text"]).select(*docs.columns)
