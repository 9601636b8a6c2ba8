"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct five-word shingles. Equal sets are folded into one. Sets that may be similar meet in
a tile: a tile holds the sets of one size band and of the band below it that agree in one of ``BANDS`` groups of ``ROWS``
minimal hashes. Bands grow by 1 / 0.8, so two sets that reach the similarity are in one band or in neighbouring ones, and they
share no group with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-9; nothing else can lose a link.

Tiles of the same members count once. Chains of tiles form clusters; these are cut into blocks of bounded size, and in a
block, sorted by size, the bits in which two hashed bitmaps differ bound the overlap from above, and what passes is decided by
intersecting the sorted arrays. Sets already joined are not compared again. Clusters of several blocks are then closed tile by
tile: where a tile holds several components, the bitmaps of its sets outside of the largest one are held against all others,
in blocks dealt over tasks, and only pairs that pass the bound leave a task and have their arrays intersected. A first round
takes each set's likeliest partners alone, so that components join up before the second takes every pair between those left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read_table, ship, slices, small_batches, written
from .graph import components

SHINGLE = 5
PERCENT = 80
ROWS, BANDS = 5, 53
#: Least and most bits of a hashed bitmap; it has about four for each shingle.
BITS = 256, 1 << 18
#: Sets and bytes of shingles per block, and sets of a cluster that stand in each of its blocks so that blocks join up.
BLOCK = 256
BLOCK_BYTES = 16 << 20
LEADERS = 8
#: Components to which the first round of the closing step tries to link a set; the second takes whatever is left.
BEST = 4
#: Sets of a tile in a block of bitmaps.
TILE_BLOCK = 1024
#: Documents in clusters whose places are broadcast (some 80 bytes each) to pick their texts; beyond that they are joined by shuffle.
BROADCAST_DOCS = 1_000_000
_WORDS_KEPT = 150_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 2**31, ROWS * BANDS, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, np.uint64).astype(np.uint32)
_C = _rng.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_D = _rng.integers(0, 2**63, BANDS, np.uint64)
_S = _rng.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles. Words are hashed once and looked up after that."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = (text or b"").lower().split()  # bytes: lowers A-Z alone and splits at ASCII white space alone
        n = len(words)
        if n < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
        known = self.known
        try:
            codes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        except KeyError:
            if len(known) > _WORDS_KEPT:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            codes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        mixed = codes[: n - SHINGLE + 1] * _S[0]
        for k in range(1, SHINGLE):
            mixed = _mix(mixed + codes[k : n - SHINGLE + 1 + k]) * _S[k]
        return np.unique(_mix(mixed))


def tile_keys(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        part = low[at : at + 512]
        np.minimum(least, (_A[:, None] * part + _B[:, None]).min(axis=1), out=least)
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    return _mix(_mix((rows * _C).sum(axis=1, dtype=np.uint64) + _D)).view(np.int64)


_shingler = Shingler()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in slices(batches):
        n, h1, h2, keys = [], [], [], []
        for text in batch.column(1).cast(pa.binary()):
            s = _shingler.shingles(text.as_py())
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            h1.append((d & (2**64 - 1)) - 2**63)
            h2.append((d >> 64) - 2**63)
            keys.append(tile_keys(s) if len(s) else np.zeros(0, np.int64))
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))], names=["doc_id", "n", "h1", "h2", "keys"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text in the last column by its shingles, as bytes of unsigned 64-bit integers."""
    for batch in slices(batches):
        out = [_shingler.shingles(t.as_py()).tobytes() for t in batch.column(batch.num_columns - 1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])


def enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays reach the similarity, by exact intersection."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def bits_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` shingles: the power of two from four for each shingle on, within ``BITS``."""
    return min(max(1 << (4 * n - 1).bit_length(), BITS[0]), BITS[1])


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles that fall on each bit: two sets differ in at least as many shingles as bits."""
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def halved(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits: parities of two bits add up."""
    at = maps.shape[-1] // 2
    return maps[..., :at] ^ maps[..., at:]


def _may_reach(differ: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Whether sets that differ in at least so many shingles can reach the similarity."""
    bound = (sizes + size - differ) // 2
    return 100 * bound >= PERCENT * (sizes + size - bound)


def join_block(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(node, root) of the nodes that link with another in the block; root is the smallest of the joined ones."""
    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), nodes[k]))
    nodes, sets = nodes[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets], np.int64)
    bits = bits_of(int(size[-1]) // 2)
    maps = np.stack([bitmap(s, bits) for s in sets])
    root = np.arange(len(nodes))
    lowest = np.searchsorted(100 * size, PERCENT * size)  # the size band of each set begins here
    for k in range(1, len(nodes)):
        lo = lowest[k]
        if lo >= k:
            continue
        differ = np.bitwise_count(maps[lo:k] ^ maps[k]).sum(axis=1, dtype=np.int64)
        left = lo + np.flatnonzero(_may_reach(differ, size[lo:k], size[k]))
        left = left[np.argsort(differ[left - lo] - size[left], kind="stable")]
        while True:
            left = left[root[left] != root[k]]
            if not len(left):
                break
            if enough(sets[left[0]], sets[k]):
                root[root == root[k]] = root[left[0]]
            left = left[1:]
    least: dict[int, int] = {}
    count: dict[int, int] = {}
    for node, r in zip(nodes.tolist(), root.tolist(), strict=True):
        least[r] = min(least.get(r, node), node)
        count[r] = count.get(r, 0) + 1
    return [(node, least[r]) for node, r in zip(nodes.tolist(), root.tolist(), strict=True) if count[r] > 1]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that are sorted by ``keys``, one table for each key; no more than one key's rows are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in slices(batches):
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        for lo, hi in zip(starts := [0, *np.flatnonzero(new).tolist()], [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[lo] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each block; of rows that share an id and a set one counts."""
    for table in _runs(batches, ["cluster", "block"]):
        if table.num_rows > 1:
            rows = dict.fromkeys(zip(table["node"].to_pylist(), table["shingles"].to_pylist(), strict=True))
            yield _pairs(join_block(np.array([node for node, _ in rows]), [np.frombuffer(raw, np.uint64) for _, raw in rows]))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text in the last column by the number of its shingles, in 8 bytes, and their bitmap."""
    for batch in slices(batches):
        out = []
        for t in batch.column(batch.num_columns - 1).cast(pa.binary()):
            s = _shingler.shingles(t.as_py())
            out.append(np.array([len(s)], np.uint64).tobytes() + bitmap(s, bits_of(len(s))).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "map"])


def near_pairs(left: np.ndarray, right: np.ndarray, outside: np.ndarray, node: np.ndarray, comp: np.ndarray, size: np.ndarray, maps: list[np.ndarray], best: int | None = None) -> Iterator[tuple[int, int]]:
    """Places of a row of ``left`` and one of ``right``, of two components, whose sizes and bitmaps allow the similarity; with
    ``best`` only those of the highest bounds for each row, with so many other components.

    Rows of ``left`` are outside of their tile's largest component; of the others some may be, and such a pair counts once.
    Bitmaps of sizes that can be similar have as many bits, or twice as many, which are halved.
    """
    bits = np.array([len(m) for m in maps])
    for level in np.unique(bits).tolist():
        own, twice = np.flatnonzero(bits == level), np.flatnonzero(bits == 2 * level)
        at = np.concatenate([own, twice])
        stack = np.stack([maps[k] for k in own])
        if len(twice):
            stack = np.concatenate([stack, halved(np.stack([maps[k] for k in twice]))])
        for p in np.flatnonzero(left[at]).tolist():
            k = at[p]
            # two sets of twice the bits meet at their own level
            other = own if p >= len(own) else at
            like = right[other] & (comp[other] != comp[k]) & (~outside[other] | (node[other] > node[k]))
            like &= (100 * size[other] >= PERCENT * size[k]) & (PERCENT * size[other] <= 100 * size[k])
            q = np.flatnonzero(like)
            differ = np.bitwise_count(stack[q] ^ stack[p]).sum(axis=1, dtype=np.int64)
            may = _may_reach(differ, size[other[q]], size[k])
            hits = other[q[may]]
            if best is not None and len(hits) > best:
                hits = hits[np.argsort((differ[may] - size[hits]) / (size[hits] + size[k]), kind="stable")]
                hits = hits[np.sort(np.unique(comp[hits], return_index=True)[1])[:best]]
            for j in hits.tolist():
                yield (int(k), j)


def _bound_tiles(best: int | None):
    """Pairs that pass the bound, with their components, task by task of a tile: outsiders against members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["tile", "i", "j"]):
            node, comp, outside, side = (table[c].to_numpy() for c in ("node", "comp", "outside", "side"))
            raw = [np.frombuffer(m, np.uint64) for m in table["map"].to_pylist()]
            size, maps = np.array([m[0] for m in raw], np.int64), [m[1:] for m in raw]
            left, right = (side == 0) | ((side == 2) & outside), side != 0
            if left.any() and right.any():
                found = {(min(i, j, key=lambda k: node[k]), max(i, j, key=lambda k: node[k])) for i, j in near_pairs(left, right, outside, node, comp, size, maps, best)}
                at = np.array(sorted(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[at[:, 0]], node[at[:, 1]], comp[at[:, 0]], comp[at[:, 1]])], names=["a", "b", "ca", "cb"])

    return run


def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        good = [enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _with_text(docs: DataFrame, picked: DataFrame, n_picked: int, run, name: str) -> DataFrame:
    """Columns of ``picked`` (one row per node or more) and what ``run`` makes of the node's text."""
    picked = F.broadcast(picked) if n_picked <= BROADCAST_DOCS else picked
    joined = docs.join(picked, docs["doc_id"] == picked["node"]).select(*picked.columns, "text")
    return joined.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in picked.dtypes) + f", {name} binary")


def _tiles(nodes: DataFrame) -> DataFrame:
    """(tile, node, n) of the tiles with two members or more, one of those with the same members.

    The keys are shuffled once: both uses of the dealt rows read the same exchange. Nearly all keys have one node and go. The
    rest meets again by size band; a set is in its own band and in the one above.
    """
    dealt = nodes.select("node", "n", F.explode("keys").alias("tile")).repartition("tile")
    twice = dealt.groupBy("tile").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("tile").hint("shuffle_hash")
    shared = written(dealt.join(twice, "tile"), "shared")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    banded = shared.select("node", "n", F.explode(F.transform(F.array(band, band + 1), lambda b: F.xxhash64("tile", b))).alias("tile"))
    members = [F.count("*").alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    each = banded.groupBy("tile").agg(*members).where("lo <> hi")
    once = each.groupBy("members", "lo", "hi", "x", "y").agg(F.min("tile").alias("tile")).select("tile", F.col("lo").alias("lead"), "members")
    out = written(banded.join(once, "tile"), "tiles")
    drop(shared)
    return out


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are lower-cased (A-Z) runs without ASCII white space; a text of fewer than five words is one shingle; a null,
    empty or blank one has the empty set and links with nothing. Documents link at a Jaccard similarity of 0.8 or more, equal
    sets always. component_id is the smallest id reachable. Ids must be whole numbers; a null id takes no part (component
    null). Repeated rows are linked; rows that share an id are one document to the links. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(docs.mapInArrow(_sets, "doc_id long, n long, h1 long, h2 long, keys array<long>"), "sets")

    # equal sets are one node, the smallest id; each map task first folds its own copies
    folded = sets.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    found = _joined(docs, _tiles(folded))

    reps = sets.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    done = reps.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("c"))
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("h1")).alias("h1")
    return sets.select("doc_id", "n", key, "h2").join(done, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def _joined(docs: DataFrame, tiles: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link. ``tiles`` is dropped."""
    spark = docs.sparkSession
    # a node's smallest lead stands for it in its other tiles, so a large group has an edge per node and few between leads
    first = tiles.groupBy("node").agg(F.min("lead").alias("first"))
    between = tiles.join(first, "node").select("first", "lead").where("first <> lead").distinct()
    edges = first.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(between.select(F.col("lead").alias("a"), F.col("first").alias("b")))
    clusters = components(edges).select("node", F.col("component").alias("cluster"))
    sizes = tiles.groupBy("node").agg(F.first("n").alias("n"))
    clusters = written(clusters.join(sizes, "node"), "clusters")
    totals = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(8 * F.col("n")).alias("bytes"))
    totals = totals.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    leads = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("size")) < LEADERS
    block = F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    spread = written(clusters.join(totals, "cluster").select("node", "cluster", "n", "blocks", block.alias("block")), "spread")
    drop(clusters)

    n_spread, n_bytes = spread.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("n")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BLOCK_BYTES)
    rows = _with_text(docs, spread.select("node", "cluster", "block"), n_spread, _arrays, "shingles")
    rows = rows.repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block")
    links = written(rows.mapInArrow(_join_blocks, "a long, b long"), "joined")
    found = components(links)

    wide = written(spread.where("blocks > 1").select("node").distinct(), "wide")
    drop(spread)
    n_wide = wide.count()
    if n_wide:
        found = _closed(docs, tiles, wide, n_wide, found)
    drop(wide, tiles)
    return found


def _closed(docs: DataFrame, tiles: DataFrame, wide: DataFrame, n_wide: int, found: DataFrame) -> DataFrame:
    """``found`` (node, component) with the components joined that links between members of a tile join."""
    maps = _with_text(docs, wide, n_wide, _maps, "map").dropDuplicates(["node", "map"])
    at = maps.join(found, "node", "left").select("node", "map", F.coalesce("component", "node").alias("comp"))
    held = written(tiles.join(at, "node").select("tile", "node", "n", "comp", "map"), "held")
    for best in (BEST, None):
        more = _across_blocks(docs, held, best)
        if more is None or more.isEmpty():
            continue
        moved = components(more).select(F.col("node").alias("comp"), F.col("component").alias("to"))
        last, held = held, written(held.join(moved, "comp", "left").select("tile", "node", "n", F.coalesce("to", "comp").alias("comp"), "map"), "held")
        drop(last, more)
        # a component is named by its smallest node, which may have had no link so far
        named = moved.select(F.col("comp").alias("node"), F.col("to").alias("component"))
        renamed = found.join(moved, F.col("component") == F.col("comp"), "left").select("node", F.coalesce("to", "component").alias("component"))
        found = written(renamed.unionByName(named).distinct(), "found")
    drop(held)
    return found


def _across_blocks(docs: DataFrame, held: DataFrame, best: int | None) -> DataFrame | None:
    """Links (a, b) of components of ``held`` (tile, node, n, comp, map) that share a tile, or None if no tile holds two; with
    ``best`` the likeliest.

    Of two components in a tile one is not its largest; so the pairs with a node outside of the largest are all that can be
    missing. A tile's outsiders and members are cut into blocks, and a task holds one block of each.
    """
    spark = docs.sparkSession
    count = held.groupBy("tile", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("bytes"))
    mixed = count.groupBy("tile").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("inside"), F.sum("m").alias("members"), F.sum("bytes").alias("bytes")).where("inside < members")
    blocks = mixed.select("tile", "main", "bytes", F.ceil(F.col("members") / TILE_BLOCK).cast("int").alias("blocks"), F.ceil((F.col("members") - F.col("inside")) / TILE_BLOCK).cast("int").alias("minor"))
    blocks = written(blocks, "mixed")
    total = blocks.agg(F.sum(F.col("bytes") * F.greatest("blocks", "minor"))).first()[0]
    if total is None:
        drop(blocks)
        return None
    rows = held.join(blocks, "tile").withColumn("outside", F.col("comp") != F.col("main"))
    mine = [F.pmod(F.xxhash64(F.lit(k), "node"), F.col(own)).cast("int") for k, own in enumerate(("minor", "blocks"))]

    def dealt(i, j, side: int):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    as_outsider = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: dealt(mine[0], k, 0))
    as_member = F.transform(F.sequence(F.lit(0), F.col("minor") - 1), lambda k: dealt(k, mine[1], 1))
    # in a tile of one block a row comes once, and stands on both sides if it is an outsider
    alone = F.array(dealt(F.lit(0), F.lit(0), 2))
    tasks = F.when(F.col("blocks") == 1, alone).otherwise(F.concat(F.filter(as_outsider, lambda _: F.col("outside")), as_member))
    each = rows.withColumn("t", F.explode(tasks)).select("tile", "node", "n", "comp", "outside", "t.i", "t.j", "t.side", "map").drop("n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_BYTES)
    each = each.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    pairs = written(each.mapInArrow(_bound_tiles(best), "a long, b long, ca long, cb long").dropDuplicates(["a", "b"]), "pairs")
    drop(blocks)

    ends = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
    arrays = written(_with_text(docs, ends, ends.count(), _arrays, "shingles").dropDuplicates(["node", "shingles"]), "arrays")
    both = pairs.join(arrays.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(arrays.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    more = written(both.select("ca", "cb", "sa", "sb").mapInArrow(_check_pairs, "a long, b long"), "more")
    drop(pairs, ends, arrays)
    return more


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return components_of(read_table(spark, sf_dir, "documents"))


OP7_ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""
