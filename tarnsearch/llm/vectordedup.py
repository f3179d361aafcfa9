"""Near-duplicate vectors by an exact metric range join. The metric is the angle between vectors.

1. Equal vectors are one class, counted, so that copies are never compared with each other.
2. Pivots, drawn from a bounded sample and far from one another, cut the space in cells: a
   vector is at home with its nearest pivot.
3. A vector v may have a partner at home in another cell i only if
   ``angle(v, pivot i) <= angle(v, its own pivot) + 2 * reach`` and
   ``angle(v, pivot i) <= radius of cell i + reach`` (triangle inequality). There it is a visitor. Of
   two cells one, chosen by a rule, is visited by the other's vectors, so a pair meets once.
4. Cells are cut into units of a bounded number of residents and visitors. Units are joined
   independently of each other: visitors stream past the residents in blocks, as matrix products.
   A unit returns a number of links and one link per vector, never its pairs.
5. The links make components.

In spaces where all angles are alike (random vectors of many dimensions) every cell is near every
other, and the join does the work of comparing blocks with blocks; its rows stay those of 4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.graph import components
from tarnsearch.llm.text import document_key
from tarnsearch.plans.work import materialize

SAMPLE_BYTES = 16 << 20  # of vectors that pivots are chosen from; they pass the driver
SLACK = 1e-6  # in radians, far above the rounding of an angle


@dataclass(frozen=True)
class VectorDedup:
    """Linked if their cosine is ``cosine`` or more. ``residents`` and ``visitors`` bound a unit
    (on average: vectors are dealt to units by a hash)."""

    cosine: float = 0.95
    residents: int = 4096
    visitors: int = 1 << 18
    sample: int = 4096
    most_pivots: int = 1024


@dataclass(frozen=True)
class Cells:
    """What a task knows of the cells: per width the pivots' numbers and vectors, per cell its
    radius, and into how many blocks and visitor chunks it is cut. At most ``most_pivots`` pivots; a
    width that the sample did not meet has one cell, whose pivot is the first axis."""

    pivots: dict[int, tuple[np.ndarray, np.ndarray]]
    radius: dict[int, float]
    blocks: dict[int, int]
    chunks: dict[int, int]

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width in self.pivots:
            return self.pivots[width]
        axis = np.zeros((1, width))
        axis[0, 0] = 1
        return np.array([-width]), axis


def usable(vector: str | Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one other than 0."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per width the places of its vectors in the column, and the vectors at length 1."""
    widths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(widths)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        rows = flat[(ends[at] - width)[:, None] + np.arange(width)]
        rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        yield at, rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def farthest_first(rows: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Places of rows each as far as possible from those before, until none is ``apart``."""
    chosen = [0]
    nearest = np.clip(rows @ rows[0], -1, 1)
    while len(chosen) < most:
        place = int(nearest.argmin())
        if math.acos(max(-1.0, nearest[place])) <= apart:
            break
        chosen.append(place)
        nearest = np.maximum(nearest, np.clip(rows @ rows[place], -1, 1))
    return np.array(chosen)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def _owns(i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
    """Whether i is visited by j, rather than j by i."""
    return np.where((i + j) % 2 == 0, i < j, i > j)


def _homes(cells: Cells):
    """Per vector its cell and the angle to that cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.empty(batch.num_rows, np.int64)
            angle = np.empty(batch.num_rows)
            for at, rows in unit_rows(batch.column("vec")):
                numbers, pivots = cells.of(rows.shape[1])
                angles = _angles(rows, pivots)
                nearest = angles.argmin(axis=1)
                home[at], angle[at] = numbers[nearest], angles[np.arange(len(rows)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(angle)], [*batch.schema.names, "home", "angle"])

    return run


def _visits(batch: pa.RecordBatch, cells: Cells, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and the foreign cells they visit."""
    home, angle = batch.column("home").to_numpy(), batch.column("angle").to_numpy()
    for at, rows in unit_rows(batch.column("vec")):
        numbers, pivots = cells.of(rows.shape[1])
        radius = np.array([cells.radius.get(int(c), -math.inf) for c in numbers])
        angles = _angles(rows, pivots)
        near = (angles <= angle[at][:, None] + 2 * reach + SLACK) & (angles <= radius + reach + SLACK)
        near &= _owns(numbers[None, :], home[at][:, None]) & (numbers[None, :] != home[at][:, None])
        row, cell = np.nonzero(near)
        yield at[row], numbers[cell]


def _counted(cells: Cells, reach: float):
    """Per cell the number of its visitors from other cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for _, cell in _visits(batch, cells, reach):
                for c, n in zip(*np.unique(cell, return_counts=True)):
                    sums[int(c)] = sums.get(int(c), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["cell", "n"])

    return run


UNIT = "cell bigint, block bigint, chunk bigint, visitor boolean, k string, h bigint, n bigint, node bigint"


def _dealt(cells: Cells, reach: float):
    """Every vector once in its own unit (per chunk of that unit's visitors) and once in each that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("home").to_numpy()
            h = batch.column("h").to_numpy().view(np.uint64)

            def cut(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                known = np.unique(cell)
                place = np.searchsorted(known, cell)
                return tuple(np.array([d[int(c)] for c in known], np.int64)[place] for d in (cells.blocks, cells.chunks))

            def salted(n: np.ndarray, h: np.ndarray, shift: int) -> np.ndarray:
                return ((h >> np.uint64(shift)) % n.astype(np.uint64)).astype(np.int64)

            blocks, chunks = cut(home)
            own = salted(blocks, h, 32)
            # Residents, in every chunk of their block.
            row = np.repeat(np.arange(len(home)), chunks)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            parts = [(row, home[row], own[row], chunk, False)]
            # Visitors from the other blocks of the cell.
            row = np.repeat(np.arange(len(home)), blocks)
            block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            other = (block != own[row]) & _owns(block, own[row])
            row, block = row[other], block[other]
            parts.append((row, home[row], block, salted(chunks[row], h[row], 8), True))
            # Visitors from other cells, to every block.
            for at, cell in _visits(batch, cells, reach):
                if len(at):
                    n_blocks, n_chunks = cut(cell)
                    row, to = np.repeat(at, n_blocks), np.repeat(cell, n_blocks)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
                    parts.append((row, to, block, salted(np.repeat(n_chunks, n_blocks), h[row], 8), True))
            for row, cell, block, chunk, visitor in parts:
                for a in range(0, len(row), 8192):
                    some = slice(a, a + 8192)
                    taken = batch.take(pa.array(row[some]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[some]), pa.array(block[some]), pa.array(chunk[some]), pa.array(np.full(taken.num_rows, visitor))]
                        + [taken.column(c) for c in ("k", "h", "n", "node", "vec")],
                        ["cell", "block", "chunk", "visitor", "k", "h", "n", "node", "vec"],
                    )

    return run


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make a and b of one group; a group's label is its smallest place."""
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


class _Unit:
    """The residents of a unit, and what its links are so far."""

    STEP = 1024

    def __init__(self, cosine: float, first_chunk: bool):
        self.cosine, self.first_chunk = cosine, first_chunk
        self.held: list[tuple] = []
        self.rows = None

    def add(self, rows: np.ndarray, k: np.ndarray, n: np.ndarray, node: np.ndarray) -> None:
        self.held.append((rows, k, n, node))

    def _open(self) -> None:
        if self.rows is not None:
            return
        self.rows, self.k, self.n, self.node = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.empty((0, 1)), *[np.empty(0, np.int64)] * 3)
        self.held = []
        self.links = np.zeros(len(self.rows), np.int64)
        self.label = np.arange(len(self.rows))
        if self.first_chunk:  # residents among themselves, once
            for a in range(0, len(self.rows), self.STEP):
                near = self.rows[a:] @ self.rows[a : a + self.STEP].T >= self.cosine
                near &= np.arange(len(near))[:, None] > np.arange(near.shape[1])
                i, j = np.nonzero(near)
                i, j = i + a, j + a
                self.links += np.bincount(i, self.n[j], len(self.rows)).astype(np.int64)
                self.links += np.bincount(j, self.n[i], len(self.rows)).astype(np.int64)
                join_labels(self.label, i, j)

    def visit(self, rows: np.ndarray, k: np.ndarray, n: np.ndarray, node: np.ndarray) -> Iterator[tuple]:
        self._open()
        if not len(self.rows):
            return
        for a in range(0, len(rows), self.STEP):
            some = slice(a, a + self.STEP)
            near = rows[some] @ self.rows.T >= self.cosine
            i, j = np.nonzero(near)
            if not len(i):
                continue
            self.links += np.bincount(j, n[some][i], len(self.rows)).astype(np.int64)
            links = np.bincount(i, self.n[j], len(near)).astype(np.int64)
            first = near.argmax(axis=1)
            join_labels(self.label, first[i], j)
            hit = np.flatnonzero(links)
            yield k[some][hit], links[hit], node[some][hit], self.node[first[hit]]

    def close(self) -> Iterator[tuple]:
        self._open()
        hit = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        if len(hit):
            yield self.k[hit], self.links[hit], self.node[hit], self.node[self.label[hit]]


FOUND = pa.schema([("k", pa.string()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _joined(how: VectorDedup):
    """Units, one after the other: their rows are neighbours, residents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, key = None, None

        def out(rows):
            for k, links, a, b in rows:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(links), pa.array(a), pa.array(b)], schema=FOUND)

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "block", "chunk")])
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if key is None or (keys[a] != key).any():
                    if unit is not None:
                        yield from out(unit.close())
                    key, unit = keys[a], _Unit(how.cosine, keys[a][2] == 0)
                part = batch.slice(a, b - a)
                ((_, rows),) = unit_rows(part.column("vec"))  # a unit's vectors are of one width
                named = (np.array(part.column("k").to_pylist(), object), part.column("n").to_numpy(), part.column("node").to_numpy())
                if visitor[a]:
                    yield from out(unit.visit(rows, *named))
                else:
                    unit.add(rows, *named)
        if unit is not None:
            yield from out(unit.close())

    return run


def _pivots(classes: DataFrame, how: VectorDedup, n: int, reach: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Far vectors of a sample that is bounded in rows and bytes, for each width that it holds."""
    width = classes.agg(F.max(F.size("vec"))).first()[0]
    rows = max(1, min(how.sample, SAMPLE_BYTES // (8 * width)))
    # The hash leaves about twice the sample, whatever the number of tasks; its lowest are taken.
    few = classes.where(F.pmod("h", F.lit(n)) < 2 * rows) if n > 2 * rows else classes
    drawn = [r.vec for r in few.orderBy("h", "k").limit(rows).select("vec").collect()]
    if not drawn:
        return {}
    most = max(1, min(how.most_pivots, math.ceil(n / how.residents)))
    found, first = {}, 0
    for at, vectors in sorted(unit_rows(pa.array(drawn, pa.list_(pa.float64()))), key=lambda x: -len(x[0])):
        if first < most:
            chosen = vectors[farthest_first(vectors, most - first, 2 * reach)]
            found[vectors.shape[1]] = (np.arange(first, first + len(chosen)), chosen)
            first += len(chosen)
    return found


def near_duplicate_vectors(
    table: DataFrame, how: VectorDedup | None = None, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept (vec_id = component_id).

    ``n_links`` counts the other rows whose cosine is the threshold or more, equal rows among
    them. Vectors that are null, empty or zero, or hold null or non-finite components, have no
    links; vectors of different width have none with each other. Rows that repeat an id have their own
    numbers of links and share a component. Rows without an id are one vector in that sense, below
    all others; null stands for it. An empty table gives no rows; other columns are not looked at.

    No task holds more than about ``residents`` vectors and a batch, and no more rows are made than vectors
    times the units they visit; pairs are never rows. Inside a group of near copies the comparisons (not the
    rows) grow with its square, dealt out over its units.
    """
    how = how or VectorDedup()
    reach = math.acos(how.cosine)
    kind = dict(table.dtypes)[vector]
    value = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    given = table.select(document_key(key).alias("id"), value.alias("vec"))
    rows = materialize(
        given.withColumn("k", F.when(usable("vec"), F.md5(F.col("vec").cast("string"))))
        .withColumn("vec", F.when(F.col("k").isNotNull(), F.col("vec"))),
        "vectors",
    )
    classes = rows.where("k is not null").groupBy("k", "vec").agg(F.count("*").alias("n"), F.min("id").alias("node"))
    classes = materialize(classes.withColumn("h", F.xxhash64("k")), "classes")
    n = classes.count()
    found = classes.select("k", F.lit(0).cast("bigint").alias("links"), F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if n:
        cells = Cells(_pivots(classes, how, n, reach), {}, {}, {})
        homes = materialize(classes.mapInArrow(_homes(cells), f"{_ddl(classes)}, home bigint, angle double"), "homes")
        # One row per cell: at most as many as pivots and widths.
        sizes = homes.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
        cells = Cells(cells.pivots, {r.home: r.radius for r in sizes}, {r.home: math.ceil(r.n / how.residents) for r in sizes}, {})
        seen = homes.mapInArrow(_counted(cells, reach), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        seen = {r.cell: r.n for r in seen.collect()}
        chunks = {r.home: math.ceil(max(1, seen.get(r.home, 0) + r.n // 2) / how.visitors) for r in sizes}
        cells = Cells(cells.pivots, cells.radius, cells.blocks, chunks)
        dealt = homes.mapInArrow(_dealt(cells, reach), f"{UNIT}, vec {dict(classes.dtypes)['vec']}")
        # Their number is given: few bytes may be much work.
        tasks = min(2 * sum(cells.blocks[c] * chunks[c] for c in chunks), 10_000)
        units = dealt.repartition(tasks, "cell", "block", "chunk").sortWithinPartitions("cell", "block", "chunk", "visitor")
        found = materialize(units.mapInArrow(_joined(how), "k string, links bigint, a bigint, b bigint"), "found")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.select("k", "n", "node").join(links, "k", "left")
    good = materialize(
        rows.where("k is not null").select("id", "k").join(named, "k")
        .select("id", "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "linked",
    )
    edges = found.select("a", "b").union(good.select(F.col("id").alias("a"), F.col("node").alias("b")))
    labels = components(edges).withColumnRenamed("node", "id")
    bad = rows.where("k is null").select("id", F.lit(0).cast("bigint").alias("n_links"))
    every = good.select("id", "n_links").union(bad).join(labels, "id", "left")
    component = F.coalesce("component", "id")
    return every.select(
        F.nullif("id", F.lit(-(2**63))).alias("vec_id"),
        "n_links",
        F.nullif(component, F.lit(-(2**63))).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
