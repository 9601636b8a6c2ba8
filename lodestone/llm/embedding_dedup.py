"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Exact copies of a vector are first folded into one row with a count. Each row has a home cell (its nearest centre) and is a
guest in the cells that can be the home of a partner, so that close vectors on two sides of a border meet. Cells are cut into
blocks of bounded size; a task multiplies two blocks, so a cell of any size is spread over many tasks.

Which cells those are: take a linked pair with homes A and B, and n the unit vector along B's centre less A's. One vector lies
on each side of the border, so one of them is no farther from it than half of what they differ by along n. That is at most
sqrt((1 - t) / 2); and where vectors differ as the sample varies, it is a normal number with a variance of (1 - t^2) / d, d being the
dimension that the sample fills (``filled``). A vector is a guest of each cell whose border with its home is within half of
``SIGMAS`` such deviations, or within the first bound if that is less; ``sigmas=None`` takes the first bound alone and loses
nothing, at a number of guests that grows nearly as that of the cells where vectors form no clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship, slices, small_batches, written
from .graph import components

THRESHOLD = 0.9
#: Rows per cell that the number of centres aims at.
CELL_ROWS = 1024
#: The driver fits the centres of all lengths on samples of so many rows for each, within so many bytes.
SAMPLE_PER_CELL = 12
SAMPLE_BYTES = 96 << 20
#: Lengths of vectors that get centres; rows of rarer lengths meet all of their length, in blocks.
LENGTHS = 8
#: Deviations of a partner's difference for which borders are near, see above.
SIGMAS = 4.5
#: What rounding may add to a distance from a border.
SLACK = 1e-7
#: Rows of a block of hosts and of one of guests; products are taken so many rows of guests at a time.
BLOCK = 1024
GUEST_BLOCK = 8192
ROUNDS = 8


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def filled(x: np.ndarray) -> float:
    """The dimension that unit vectors fill: the participation ratio of their covariance, without what a sample's size adds."""
    if len(x) < 3:
        return 1.0
    y = x - x.mean(axis=0)
    c = y.T @ y / (len(y) - 1)
    trace, square = float(np.trace(c)), float((c * c).sum())
    square -= min(trace * trace / (len(y) - 1), 0.9 * square)
    return max(1.0, min(trace * trace / max(square, 1e-300), x.shape[1] - 1.0))


def reach_of(x: np.ndarray, threshold: float, sigmas: float | None) -> float:
    """How near a border must be for a guest, see above."""
    most = float(np.sqrt(max(0.0, 1 - threshold) / 2))
    return most if sigmas is None else min(most, sigmas / 2 * float(np.sqrt(max(0.0, 1 - threshold**2) / filled(x))))


def fit(sample: dict[int, np.ndarray], cells: dict[int, int], seed: int = 5) -> dict[int, np.ndarray]:
    """Centres by dimension: Lloyd rounds on the sphere from a random start; an empty cell takes the row farthest from its centre."""
    out = {}
    for dim, x in sample.items():
        r = np.random.default_rng(seed)
        c = x[r.permutation(len(x))[: max(1, cells[dim])]].copy()
        for _ in range(ROUNDS):
            at, best = np.empty(len(x), np.int64), np.empty(len(x))
            for lo in range(0, len(x), 2048):  # the driver never holds all products at once
                p = x[lo : lo + 2048] @ c.T
                at[lo : lo + 2048], best[lo : lo + 2048] = p.argmax(axis=1), p.max(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            norm = np.linalg.norm(sums, axis=1)
            empty = np.flatnonzero(norm < 1e-9)
            sums[empty] = x[np.argsort(best)[: len(empty)]]
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        out[dim] = c
    return out


def _seats(u: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and a boolean matrix of the other cells of which it is a guest."""
    p = u @ c.T
    row = np.arange(len(u))
    home = p.argmax(axis=1)
    short = p[row, home][:, None] - p
    norm = (c * c).sum(axis=1)
    widest = 2 * float(np.sqrt(norm.max()))
    i, j = np.nonzero(short <= reach * widest + SLACK)
    guest = np.zeros(p.shape, bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        apart = np.sqrt(np.maximum(((c[home[a]] - c[b]) ** 2).sum(axis=1), 0))
        guest[a, b] = short[a, b] <= reach * apart + SLACK
    guest[row, home] = False
    return home, guest


def _first_cells(centres: dict[int, np.ndarray]) -> dict[int, int]:
    return dict(zip(sorted(centres), np.cumsum([0, *(len(centres[d]) for d in sorted(centres))]).tolist()))


def _assigner(shared, kind: type):
    names = ["vec_id", "h1", "h2", "raw", "dim", "cell", "guests", "seats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        centres, reach = shared.value
        first_cell = _first_cells(centres)
        for batch in slices(batches):
            rows = batch.column(1).to_pylist()
            n = len(rows)
            raw, dims, cell, guests, seats, h1, h2 = ([None] * n for _ in range(7))
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(rows):
                if v and None not in v:
                    by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                x = np.array([rows[k] for k in at], np.float64)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = [k for k, g in zip(at, good, strict=True) if g], x[good]
                if not len(at):
                    continue
                u = _units(x)
                c = centres.get(dim)
                home, guest = _seats(u, c, reach[dim]) if c is not None else (np.zeros(len(u), np.int64), np.zeros((len(u), 1), bool))
                base = first_cell.get(dim, -dim)
                for k, one, own, others in zip(at, (x + 0.0).astype(kind), home + base, guest, strict=True):
                    d = xxhash.xxh3_128_intdigest(one.tobytes())
                    h1[k], h2[k] = (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63
                    raw[k], dims[k], cell[k] = one.tobytes(), dim, int(own)
                    guests[k] = (np.flatnonzero(others) + base).tolist()
                    seats[k] = np.array(guests[k], np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(cell, pa.int32()), pa.array(guests, pa.list_(pa.int32())), pa.array(seats, pa.binary())], names=names)

    return run


class _Joined:
    """Links and groups of the rows of one task, from hits that come block by block."""

    def __init__(self, n: int):
        self.links, self.root = np.zeros(n, np.int64), np.arange(n)

    def _find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return int(k)

    def add(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray, mult: np.ndarray) -> None:
        """Count the links of a boolean block both ways, and join what it links: row by row, first hit by first hit."""
        if not hit.any():
            return
        self.links[rows] += (hit @ mult[cols].astype(np.float64)).astype(np.int64)
        self.links[cols] += (mult[rows].astype(np.float64) @ hit).astype(np.int64)
        self.join(rows, cols, hit)

    def join(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> None:
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            near = cols[hit[k]]
            mine = self._find(int(rows[k]))
            # of columns that already share a root one is enough
            for r in np.unique(self.root[near]).tolist():
                other = self._find(r)
                if other != mine:
                    self.root[max(mine, other)] = mine = min(mine, other)
            self.root[near] = mine

    def table(self, node: np.ndarray) -> pa.Table:
        """Rows with links, and as root the smallest node of their group."""
        root = np.array([self._find(k) for k in np.flatnonzero(self.links).tolist()], np.int64)
        has = self.links > 0
        node, links = node[has], self.links[has]
        order = np.lexsort((node, root))
        first = np.unique(root[order], return_index=True)[1]
        least = np.repeat(node[order][first], np.diff(np.append(first, len(order))))
        return pa.table({"node": node[order], "links": links[order], "root": least})


def _compare(threshold: float, kind: type):
    """Links within one task: a block with itself, two blocks of hosts of a cell, or a block of hosts and one of guests."""

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        mult, cell, side = table["mult"].to_numpy(), table["cell"].to_numpy(), table["side"].to_numpy()
        x = _units(np.frombuffer(b"".join(table["raw"].to_pylist()), kind).reshape(len(node), -1))
        home = table["home"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        joined = _Joined(len(node))
        if not len(b):
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            if hit.any():
                joined.links += (hit @ mult.astype(np.float64)).astype(np.int64)
                joined.join(a, a, hit)
            return joined.table(node)
        seats = [frozenset(np.frombuffer(s, np.int32).tolist()) if s else frozenset() for s in table["seats"].take(pa.array(a)).to_pylist()]
        for lo in range(0, len(b), BLOCK):
            part = b[lo : lo + BLOCK]
            hit = x[a] @ x[part].T >= threshold
            # a guest and a host that are guests of each other meet twice: only the smaller cell counts them
            for other in np.unique(home[part[(home[part] < cell[0]) & hit.any(axis=0)]]).tolist():
                hit[np.ix_([other in s for s in seats], home[part] == other)] = False
            joined.add(a, part, hit, mult)
        return joined.table(node)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, sigmas: float | None = SIGMAS) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Two vectors link at a cosine of ``threshold`` or more in double precision. Every link that is given is exact; which are
    found depends on ``sigmas``, see above. n_links counts other rows linked directly, component_id is the smallest id
    reachable, kept marks the one representative of a group. Vectors that are null, empty, zero or hold a null or a component
    that is not finite link with nothing, as do rows with a null id (component_id null, kept true) and vectors of different
    lengths. Ids must be whole numbers. Repeated rows are linked rows; rows that share an id are one node. An empty table gives
    no rows. Other columns are not read. Centres are fitted on a bounded sample (``SAMPLE_BYTES`` for all lengths), chosen by hash.
    """
    spark = vectors.sparkSession
    ship(spark)
    narrow = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if narrow else np.float64
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    lengths = slim.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS)
    dims = {r["d"]: r["n"] for r in lengths.collect()}
    most = {d: SAMPLE_BYTES * n // sum(dims.values()) // (8 * d) for d, n in dims.items()}
    cells = {d: max(1, min(most[d] // SAMPLE_PER_CELL, n // cell_rows)) for d, n in dims.items()}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "vec_id", "v"), 11) * F.lit(2.0**-53)
    chosen = F.lit(False)
    for d, n in dims.items():
        chosen = chosen | ((F.size("v") == d) & (draw < min(1.0, (SAMPLE_PER_CELL * cells[d] + 256) / n)))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    sample: dict[int, np.ndarray] = {}
    if dims:
        rows = slim.where(chosen & usable).orderBy("vec_id").select(F.size("v").alias("d"), "v").toArrow().combine_chunks()
        for d in dims:
            mine = rows.filter(pa.array(rows["d"].to_numpy() == d))["v"]
            if len(mine):
                sample[d] = _units(mine.combine_chunks().flatten().to_numpy().reshape(len(mine), d))
    fitted = fit(sample, cells)
    centres = spark.sparkContext.broadcast((fitted, {d: reach_of(x, threshold, sigmas) for d, x in sample.items()}))

    units = slim.mapInArrow(_assigner(centres, kind), "vec_id long, h1 long, h2 long, raw binary, dim int, cell int, guests array<int>, seats binary")
    units = written(units, "units")
    folded = units.where("h1 is not null and vec_id is not null").groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"), F.first("raw").alias("raw"), F.first(F.struct("cell", "guests", "seats")).alias("place"))
    reps = written(folded.select("h1", "h2", "dim", "node", "mult", "raw", F.col("place.cell").alias("home"), "place.guests", "place.seats"), "vectors")

    host = reps.select("node", "mult", "raw", "home", "seats", F.col("home").alias("cell"), F.lit(0).alias("side"))
    guest = reps.select("node", "mult", "raw", "home", F.lit(None).cast("binary").alias("seats"), F.explode("guests").alias("cell"), F.lit(1).alias("side"))
    counts = host.select("cell", "side").unionByName(guest.select("cell", "side")).groupBy("cell").agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK).cast("int").alias("hosts"), F.ceil(F.count_if(F.col("side") == 1) / GUEST_BLOCK).cast("int").alias("visitors"))
    # one row per cell: at most SAMPLE_BYTES / (8 * SAMPLE_PER_CELL) for all lengths with centres, plus one for each rare length
    sized = F.broadcast(counts) if len(dims) < LENGTHS else counts
    block = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("side") == 0, F.col("hosts")).otherwise(F.col("visitors")), F.lit(1))).cast("int")
    placed = host.unionByName(guest).join(sized, "cell").where("hosts > 0").withColumn("block", block)
    # tasks of a cell: (i, j) with i <= j < hosts for hosts, (i, hosts + j) for hosts and guests
    last = F.col("hosts") + F.col("visitors") - 1
    as_query = F.transform(F.sequence(F.col("block"), last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_data = F.transform(F.sequence(F.lit(0), F.col("hosts") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    of_host = F.concat(as_query, F.filter(as_data, lambda t: t["i"] < t["j"]))
    of_guest = F.transform(F.sequence(F.lit(0), F.col("hosts") - 1), lambda i: F.struct(i.alias("i"), (F.col("hosts") + F.col("block")).alias("j"), F.lit(1).alias("side")))
    tasks = placed.withColumn("t", F.explode(F.when(F.col("side") == 0, of_host).otherwise(of_guest))).select("cell", "t.i", "t.j", "t.side", "node", "mult", "raw", "home", "seats")
    found = tasks.groupBy("cell", "i", "j").applyInArrow(_compare(threshold, kind), "node long, links long, root long")
    found = written(found, "links")

    groups = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    done = reps.select("h1", "h2", "dim", "node", "mult").join(links, "node", "left").join(groups, "node", "left")
    done = done.select("h1", "h2", "dim", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    # a null id takes no part, whatever its vector
    key = F.when(F.col("vec_id").isNotNull(), F.col("h1")).alias("h1")
    out = units.select("vec_id", key, "h2", "dim").join(done, ["h1", "h2", "dim"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP9_ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len([y FOR y IN x IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN x IF y <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
