"""Near-duplicate vectors by an inverted multi-index.

A codebook for each half of the (normalised) vectors is learned from a bounded
sample; pairs of codes are the cells of a product grid, kept apart by label.
Every vector is stored in its cell and visits other cells as a query by
multi-sequence traversal: the codes of each half are sorted, and their pairs
are walked as far as the summed bound stays within the radius that reaches the
target recall.  Of two cells only one visits the other (``asks``), as a link
needs to be found once.  Cells are compared block by block with matrix products
in double precision, so links are exact and never rows.

Vectors are not sent to cells, of which there are more the more vectors there
are, but to tasks: all vectors of a label go to one, which holds their cells.
A label that is too large for a task is cut into regions by a second, coarse
grid with the same rule, and a vector is sent to the regions it visits; what is
too large even so is cut into parts, and every two parts meet.  Vectors are
sent in waves of about twice their number, each of which is cleared away before
the next, so the disk follows the input.

The bound of a code is the squared distance from the query's half to the plane
between that code and its nearest one.  The radius is the larger of two
figures: what sampled vectors need for the target recall when turned up to the
threshold, evenly or as the data lie, and what the links of a bounded set of
queries need, found by comparing them with all vectors.  The queries are drawn
in turn from the occupied cells of all labels and each counts once, however
many links it has, so a crowded group does not speak for the rest; behind the
largest needs an exponential tail is assumed.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.minhash import runs
from barloom.session import tasks_for
from barloom.sources.sinks import discard, publish


@dataclass(frozen=True)
class Grid:
    """Codebooks of the halves of vectors of ``dim`` numbers."""

    left: np.ndarray
    right: np.ndarray
    dim: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.dim // 2], x[:, self.dim // 2:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (_squares(h, c).argmin(1) for h, c in zip(self.halves(x), (self.left, self.right), strict=True))
        return a * len(self.right) + b

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_plane_bounds(h, c) for h, c in zip(self.halves(x), (self.left, self.right), strict=True))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _plane_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d, gap = _squares(x, c), np.sqrt(np.maximum(_squares(c, c), 0)) + 1e-12
    near = d.argmin(1)
    out = (d - d[np.arange(len(d)), near][:, None]) / (2 * gap[near])
    out[np.arange(len(d)), near] = 0
    return out * out


def traverse(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal for many vectors: (n, i, j) with a[n, i] + b[n, j] up to the radius.

    The codes of both halves are sorted; step by step along the left ones, the
    vectors that are still within the radius take the right ones up to it.
    """
    m = [max(1, int((s <= radius).sum(1).max(initial=0))) for s in (a, b)]
    x, y = a.argsort(1, kind="stable")[:, :m[0]], b.argsort(1, kind="stable")[:, :m[1]]
    a, b = np.take_along_axis(a, x, 1), np.take_along_axis(b, y, 1)
    on, out = np.arange(len(a)), []
    for step in range(m[0]):
        on = on[a[on, step] + b[on, 0] <= radius]
        if not len(on):
            break
        n, j = np.nonzero(a[on, step][:, None] + b[on] <= radius)
        out.append((on[n], x[on[n], step], y[on[n], j]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def visit(a: np.ndarray, b: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """The traversal of one vector: pairs (i, j) in order of a[i] + b[j] up to the radius."""
    _, i, j = traverse(a[None], b[None], radius)
    order = (a[i] + b[j]).argsort(kind="stable")
    return list(zip(i[order].tolist(), j[order].tolist(), strict=True))


def asks(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of two cells visits the other: each visits about half of those around it, and never itself."""
    return ((own < other) == ((own + other) % 2 == 1)) & (own != other)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means; a code without members stays where it is."""
    points = np.unique(x, axis=0)
    k = min(k, len(points))
    c = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        of = _squares(x, c).argmin(1)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _vectors(column: pa.Array | pa.ChunkedArray, dims: np.ndarray, dim: int) -> np.ndarray:
    """Rows of numbers, padded with zeros to ``dim``; of 32 bits if all are stored so.  dims: numbers of each row."""
    widths = pc.binary_length(column).to_numpy() // dims
    out = np.zeros((len(column), dim), np.float32 if (widths == 4).all() else np.float64)
    for d, w in sorted({*zip(dims.tolist(), widths.tolist(), strict=True)}):
        at = np.nonzero((dims == d) & (widths == w))[0]
        raw = column if len(at) == len(column) else column.take(pa.array(at))
        out[at, :d] = np.frombuffer(b"".join(raw.to_pylist()), f"<f{w}").reshape(len(at), d)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float, copy=False)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes: (id, row, label, dim, vec); others get a null vec.

    Numbers take 32 bits where all of a vector are exact so, else 64.
    """
    for b in batches:
        column, out = b.column(3), [None] * b.num_rows
        numbers = column.values.to_numpy(zero_copy_only=False)  # nulls are NaN
        starts = column.offsets.to_numpy()
        usable = np.array(b.column(2).is_valid()) & np.array(column.is_valid())
        sizes = np.where(usable, np.diff(starts), 0)
        for d in np.unique(sizes[sizes > 0]).tolist():
            at = np.nonzero(sizes == d)[0]
            x = numbers[starts[at][:, None] + np.arange(d)]
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            at, x, top = at[good], x[good], top[good]
            x = np.ldexp(x, -np.frexp(top)[1][:, None]) + 0.0  # a power of two: cosines do not change, squares stay finite
            short = x.astype("<f4")
            for i, exact, s, v in zip(at.tolist(), (short == x).all(1).tolist(), short, x.astype("<f8"), strict=True):
                out[i] = (s if exact else v).tobytes()
        dims = pa.array([None if r is None else int(n) for r, n in zip(out, sizes, strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), dims, pa.array(out, pa.binary())], names=["id", "row", "label", "dim", "vec"])


def _needed(grid: Grid, queries: list[tuple[str, int, np.ndarray]], threshold: float, bins: int):
    """Arrow pass: how many links of each query lie in each bin of the summed bound."""
    by_key: dict[tuple[str, int], list[int]] = {}
    for n, (label, dim, _) in enumerate(queries):
        by_key.setdefault((label, dim), []).append(n)
    sides = {}
    for k, ns in by_key.items():
        q = np.stack([queries[n][2] for n in ns])
        sides[k] = (np.array(ns), q, *grid.bounds(q))
    widest = 2 - 2 * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(queries) * (bins + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_vectors(b.column(2), b.column(1).to_numpy(), grid.dim))
            labels, dims = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: dict[tuple[str, int], list[int]] = {}
            for i, k in enumerate(zip(labels, dims, strict=True)):
                rows.setdefault(k, []).append(i)
            for k, at in rows.items():
                if k not in sides:
                    continue
                number, q, left, right = sides[k]
                cell = grid.cells(x[at])
                i, j = np.nonzero(q @ x[at].T >= threshold)
                a, c = np.divmod(cell[j], len(grid.right))
                need = left[i, a] + right[i, c]
                count += np.bincount(number[i] * (bins + 1) + np.minimum((need / widest * bins).astype(int), bins), minlength=len(count))
        some = np.nonzero(count)[0]
        query, at = np.divmod(some, bins + 1)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(at), pa.array(count[some])], names=["query", "bin", "n"])

    return run


def spread_out(groups: list, n: int, seed: int) -> list[int]:
    """Places of n of the groups' members, one of each group in turn, in random order."""
    turn, seen = [], {}
    for i in np.random.default_rng(seed).permutation(len(groups)).tolist():
        seen[groups[i]] = seen.get(groups[i], -1) + 1
        turn.append((seen[groups[i]], len(turn), i))
    return [i for _, _, i in sorted(turn)[:n]]


def reach(found: np.ndarray, recall: float) -> float:
    """Bins up to which queries have the share ``recall`` of their links; found: links by query and bin."""
    found = found[found.sum(1) > 0]
    if not len(found):
        return 0.0
    needs = np.sort((found.cumsum(1) >= recall * found.sum(1)[:, None]).argmax(1) + 1.0)
    tail = needs[-max(1, len(needs) // 10):]
    beyond = math.log(len(tail) / len(needs) / (1 - recall)) if recall < 1 else math.inf
    excess = tail.mean() - tail[0]
    return max(needs[-1], tail[0] + excess * max(0.0, beyond) if excess else 0.0)


def turned(grid: Grid, x: np.ndarray, threshold: float, recall: float, seed: int, n: int = 40000) -> float:
    """Summed bound that unit vectors need, for a share ``recall`` of them, to visit others at the threshold.

    The others are made: x is turned evenly in space, and as rows of x drawn over the cells are spread.
    """
    rng, most = np.random.default_rng(seed), 0.0
    aims = x[spread_out(grid.cells(x).tolist(), max(1, len(x) // 4), seed)]
    for even in (True, False):
        needs = []
        for _ in range(0, n, 4096):
            p = x[rng.integers(0, len(x), 4096)]
            to = rng.normal(size=p.shape) if even else rng.normal(size=(len(p), 256)) @ aims[rng.integers(0, len(aims), 256)]
            to = to - (to * p).sum(1)[:, None] * p
            far = np.sqrt((to * to).sum(1))
            p, to = p[far > 1e-6], to[far > 1e-6] / far[far > 1e-6, None]
            i, j = np.divmod(grid.cells(threshold * p + math.sqrt(max(0.0, 1 - threshold * threshold)) * to), len(grid.right))
            left, right = grid.bounds(p)
            needs.append(left[np.arange(len(p)), i] + right[np.arange(len(p)), j])
        needs = np.concatenate(needs)
        most = max(most, float(np.quantile(needs, recall)) if len(needs) else 0.0)
    return most


def _copies(grid: Grid, x: np.ndarray, radius: float) -> float:
    """Cells that a vector of x is sent to, its own included."""
    own = grid.cells(x)
    n, i, j = traverse(*grid.bounds(x), radius)
    return 1 + asks(own[n], i * len(grid.right) + j).sum() / len(x)


def _place(coarse: Grid | None, radius: float, wide: frozenset, parts: dict | None, wave: int = 0, waves: int = 1):
    """Arrow pass (row, label, dim, vec, times) -> vectors by unit: a label, its region and two of the region's parts.

    wide: the labels with regions; parts: the regions cut into parts, or none
    yet: then only (label, dim, region, size) is given.  ``home`` marks a
    region's own vectors, ``late`` those of the second of two parts.
    """
    names = ["label", "dim", "region", "part", "other", "home", "late", "row", "times", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
                take, region, home = np.arange(len(keys)), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
                cut = np.array([i for i, k in enumerate(keys) if k in wide], int)
                if len(cut):
                    some = b.take(pa.array(cut))
                    x = _unit(_vectors(some.column(3), some.column(2).to_numpy(), coarse.dim))
                    region[cut] = own = coarse.cells(x)
                    n, i, j = traverse(*coarse.bounds(x), radius)
                    other = i * len(coarse.right) + j
                    go = asks(own[n], other)
                    take, region = np.concatenate([take, cut[n[go]]]), np.concatenate([region, other[go]])
                    home = np.arange(len(take)) < len(keys)
                units = [(*keys[i], r) for i, r in zip(take.tolist(), region.tolist(), strict=True)]
                if waves > 1:
                    turn = {u: zlib.crc32(repr(u).encode()) % waves == wave for u in set(units)}
                    now = np.array([turn[u] for u in units], bool)
                    take, region, home, units = take[now], region[now], home[now], [u for u, t in zip(units, now, strict=True) if t]
                if parts is None:
                    t = pa.array(take)
                    yield pa.RecordBatch.from_arrays([
                        b.column(1).take(t), b.column(2).take(t), pa.array(region, pa.int32()),
                        pc.binary_length(b.column(3)).cast(pa.int64()).take(t)], names=[*names[:3], "size"])
                    continue
                of = np.array([parts.get(u, 1) for u in units] if parts else np.ones(len(units)), np.int64)
                row = b.column(0).to_numpy()[take]
                mine = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % of
                every = np.repeat(np.arange(len(take)), of)  # a part meets each part of its region
                other = np.arange(len(every)) - np.repeat(of.cumsum() - of, of)
                first, second = np.minimum(mine[every], other), np.maximum(mine[every], other)
                t = pa.array(take[every])
                yield pa.RecordBatch.from_arrays([
                    b.column(1).take(t), b.column(2).take(t), pa.array(region[every], pa.int32()), pa.array(first, pa.int32()), pa.array(second, pa.int32()),
                    pa.array(home[every]), pa.array((first < second) & (mine[every] == second)), b.column(0).take(t), b.column(4).take(t), b.column(3).take(t)], names=names)

    return run


class _Links:
    """Links and components among the rows of a unit, found by comparing ranges of them.

    Products are taken as the numbers are stored; what comes within ``NEAR`` of
    the threshold is decided in double precision.
    """

    NEAR = 1e-4  # far beyond the error of products in 32 bits

    def __init__(self, x: np.ndarray, times: np.ndarray, late: np.ndarray, halves: bool, threshold: float):
        self.x, self.times, self.late, self.halves, self.threshold = x, times, late, halves, threshold
        self.count, self.root = np.zeros(len(x), np.int64), np.arange(len(x))
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))  # of the largest numbers near 1
        self.inverse, self.bound = (1 / norms)[:, None], norms * x.dtype.type(threshold - self.NEAR)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while (r != (up := self.root[r])).any():
            r = up
        self.root[i] = r
        return r

    def compare(self, p: np.ndarray, start: int, end: int, within: bool = False) -> None:
        """All pairs of rows p and those from start to end; ``within``: only with p before the other."""
        near = (self.x[p] * self.inverse[p]) @ self.x[start:end].T >= self.bound[start:end]
        if not near.any():
            return
        if within:
            near &= p[:, None] < np.arange(start, end)
        if self.halves:
            near &= self.late[p][:, None] != self.late[start:end]
        if 8 * np.count_nonzero(near) > near.size:
            near &= _unit(self.x[p]) @ _unit(self.x[start:end]).T >= self.threshold
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(near)
            sure = [np.einsum("ij,ij->i", _unit(self.x[p[i[n:n + 8192]]]), _unit(self.x[start + j[n:n + 8192]])) >= self.threshold for n in range(0, len(i), 8192)]
            sure = np.concatenate(sure) if sure else np.zeros(0, bool)
            i, j = i[sure], j[sure]
        d = np.arange(start, end)
        np.add.at(self.count, p[i], self.times[d[j]])
        np.add.at(self.count, d[j], self.times[p[i]])
        while len(i):
            a, b = self.roots(p)[i], self.roots(d)[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def _compare(grid: Grid, radius: float, threshold: float, block: int, whole: int):
    """Arrow pass over the units of ``_place``: (row, links, low), low being a row linked with it, maybe by others.

    A unit of up to ``whole`` rows is a single cell.
    """
    schema = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])
    across, cells = len(grid.right), len(grid.left) * len(grid.right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, 5):
            dim, halves = g.column("dim")[0].as_py(), g.column("part")[0] != g.column("other")[0]
            home, late, row, times = (g.column(c).to_numpy() for c in ("home", "late", "row", "times"))
            vec = g.column("vec")
            del g
            if len(row) < 2 or not home.any():
                continue
            x = [_vectors(c, np.full(len(c), dim), dim) for c in vec.chunks]
            del vec
            x = np.concatenate(x)

            def unit(i: np.ndarray, to: int = dim) -> np.ndarray:
                return np.pad(_unit(x[i]), ((0, 0), (0, to - dim)))  # noqa: B023

            pieces = [np.arange(i, min(i + 2048, len(x))) for i in range(0, len(x), 2048)]
            cell = np.zeros(len(x), np.int64)
            if len(x) > whole:
                cell = np.concatenate([grid.cells(unit(i, grid.dim)) for i in pieces])
            order = np.lexsort((~home, cell))  # in a cell, the region's own come first
            home, late, row, times, cell = home[order], late[order], row[order], times[order], cell[order]
            x = x[order]
            starts = np.searchsorted(cell, np.arange(cells + 1))
            own = np.concatenate([[0], home.cumsum()])
            middle = starts[:-1] + own[starts[1:]] - own[starts[:-1]]
            links = _Links(x, times, late, halves, threshold)

            def meet(p: np.ndarray, start: int, end: int, within: bool = False) -> None:
                """Rows p with the rows from start to end, in blocks."""
                for d in range(start, end, block):
                    for i in range(0, len(p), 4 * block):
                        if not within or p[i] < min(d + block, end) - 1:
                            links.compare(p[i:i + 4 * block], d, min(d + block, end), within)  # noqa: B023

            def flush(asked: list, askers: list) -> None:
                at, by = np.concatenate(asked), np.concatenate(askers)
                turn = at.argsort(kind="stable")  # by radix, for 16 bits
                at, by = at[turn], by[turn]
                edges = np.nonzero(np.diff(at.astype(np.int32), prepend=-1, append=cells))[0].tolist()
                mine = home[by]  # noqa: B023
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    c, own = int(at[s]), mine[s:e]
                    for q, end in ((by[s:e][own], starts[c + 1]), (by[s:e][~own], middle[c])):  # noqa: B023
                        if len(q) and end > starts[c]:  # two visitors meet at home  # noqa: B023
                            meet(q, int(starts[c]), int(end))  # noqa: B023

            for c in np.nonzero(np.diff(starts) > 1)[0].tolist():
                s, m, e = int(starts[c]), int(middle[c]), int(starts[c + 1])
                meet(np.arange(s, m), s, m, within=True)
                if s < m < e:
                    meet(np.arange(m, e), s, m)
            asked, askers, n = [], [], 0
            for i in pieces if len(x) > whole else []:
                k, u, v = traverse(*grid.bounds(unit(i, grid.dim)), radius)
                to = u * across + v
                go = asks(cell[i[k]], to) & (starts[to + 1] > starts[to])
                asked.append(to[go].astype(np.uint16))  # at most 256 codes a half
                askers.append(i[k[go]].astype(np.int32))
                n += len(askers[-1])
                if n > 1 << 21:
                    flush(asked, askers)
                    asked, askers, n = [], [], 0
            if n:
                flush(asked, askers)
            hit = np.nonzero(links.count)[0]
            if len(hit):
                table = pa.Table.from_arrays([pa.array(row[hit]), pa.array(links.count[hit]), pa.array(row[links.roots(hit)])], schema=schema)
                yield from table.to_batches(max_chunksize=1 << 16)

    return run


def near_vectors(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
    recall: float = 0.999, sample: int = 20000, queries: int = 256, cell_rows: int = 64, block: int = 1024, seed: int = 3,
    held: int = 1 << 27,
) -> DataFrame:
    """Links and components of vectors with equal labels: (id, n_links, component_id, kept).

    Cosines are compared in double precision.  Null labels, null, empty or zero
    vectors and those with null or non-finite numbers link with nothing; so do
    vectors of different lengths.  Equal vectors are searched once and counted
    as often as they occur.  Codebooks come from at most about ``sample``
    vectors, the radius from about ``queries`` of them.  A task holds about
    ``held`` bytes of vectors.
    """
    raw = vectors.select(F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = publish(raw.mapInArrow(_read, "id long, row long, label string, dim int, vec binary"), "vectors")
    heads = rows.where("vec is not null").groupBy("label", "dim", "vec").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("times"))
    heads = publish(heads.select("row", "label", "dim", "vec", "times"), "vector-heads")
    again = publish(heads.where("times > 1").select("label", "dim", "vec", F.col("row").alias("head"), "times"), "vector-copies")
    member = publish(rows.join(again, ["label", "dim", "vec"], "left").select(
        "id", "row", F.coalesce("head", "row").alias("head"), F.coalesce(F.col("times") - 1, F.lit(0)).alias("copies")), "vector-members")
    for done in (rows, again):
        discard(done)
    sizes = heads.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("vec")).alias("size"))
    stats = sizes.agg(
        F.sum("n").alias("n"), F.max("dim").alias("dim"), (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("typical"),
        F.max("size").alias("largest"), (F.sum("size") / F.sum("n")).alias("each")).first()
    if stats.n:
        pairs = _links(heads, sizes, stats, threshold, recall, sample, queries, cell_rows, block, seed, held)
        discard(heads)
        links = pairs.groupBy("row").agg(F.sum("links").alias("links"))
        comp = publish(connected_components(pairs.select("row", "low").where("row <> low").distinct(), "row", "low"), "vector-components")
        found = member.join(links.withColumnRenamed("row", "head"), "head", "left").join(comp.withColumnRenamed("node", "head"), "head", "left").select(
            "id", "row", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component"))
    else:
        found = member.select("id", "row", F.lit(0).cast("long").alias("n_links"), F.col("head").alias("component"))
    found = publish(found, "vector-labels")
    low = publish(found.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("top")), "vector-heads")
    return found.join(low.select("component", "component_id", F.col("top.row").alias("top")), "component").select(
        F.col("id").alias(id), "n_links", "component_id", (F.col("row") == F.col("top")).alias("kept"))


def _links(heads: DataFrame, sizes: DataFrame, stats, threshold: float, recall: float, sample: int, queries: int, cell_rows: int, block: int, seed: int, held: int) -> DataFrame:
    """(row, links, low) of distinct vectors, once for each unit in which a row has links."""
    draw = F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 20))
    picked = heads.where(draw < F.lit(min(1.0, sample / stats.n) * (1 << 20))).select("label", "dim", "vec").collect()  # about ``sample`` rows
    picked = picked or heads.select("label", "dim", "vec").limit(1).collect()
    picked.sort(key=lambda r: (r.label, r.dim, bytes(r.vec)))
    x = _unit(_vectors(pa.array([bytes(r.vec) for r in picked], pa.binary()), np.array([r.dim for r in picked]), stats.dim))
    widest, bins, half = 2 - 2 * threshold, 500, stats.dim // 2

    def grid_of(k: int) -> Grid:
        return Grid(codebook(x[:, :half], k, seed), codebook(x[:, half:], k, seed + 1), stats.dim)

    def radius_of(grid: Grid, recall: float) -> float:
        if recall >= 1:
            return widest
        some = spread_out([(r.label, r.dim, c) for r, c in zip(picked, grid.cells(x).tolist(), strict=True)], queries, seed)
        asked = [(picked[i].label, picked[i].dim, x[i]) for i in some]
        found = np.zeros((len(asked), bins + 1))
        for r in heads.select("label", "dim", "vec").mapInArrow(_needed(grid, asked, threshold, bins), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).collect():
            found[r.query, r.bin] = r.n
        found[:, 0] = np.maximum(0, found[:, 0] - 1)  # each query meets itself
        return min(widest, max(reach(found, recall) / bins * widest, turned(grid, x, threshold, recall, seed)))

    wide, parts, sent, coarse, near = frozenset(), {}, stats.n, None, 0.0
    if stats.largest > held:
        recall = math.sqrt(recall)  # a link has to be found by two grids
        large = heads.join(F.broadcast(sizes.where(F.col("size") > held).select("label", "dim")), ["label", "dim"])
        labels = sizes.where(F.col("size") > held).collect()  # each is more than a task holds
        wide = frozenset((r.label, r.dim) for r in labels)
        for k in range(2, 33):  # until a region and its visitors fit into a task
            coarse = grid_of(k)
            if stats.largest * _copies(coarse, x, turned(coarse, x, threshold, recall, seed, 8192)) <= held * len(coarse.left) * len(coarse.right):
                break
        near = radius_of(coarse, recall)
        crowds = large.select("row", "label", "dim", "vec", "times").mapInArrow(_place(coarse, near, wide, None), "label string, dim int, region int, size long")
        for r in crowds.groupBy("label", "dim", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect():
            over = -(-2 * r.size // held) if r.size > held else 1
            sent += r.n * over
            if over > 1:
                parts[r.label, r.dim, r.region] = over
        sent -= sum(r.n for r in labels)
    grid = grid_of(int(min(256, max(2, round((stats.typical / cell_rows) ** 0.5)))))
    radius, unit = radius_of(grid, recall), ["label", "dim", "region", "part", "other"]
    waves = -(-sent // (2 * stats.n))
    tasks = tasks_for(heads.sparkSession, 2 * sent // waves, max(1, int(held / stats.each)))
    found = []
    for wave in range(waves):
        spread = heads.mapInArrow(_place(coarse, near, wide, parts, wave, waves), UNIT)
        found.append(publish(spread.repartition(tasks, *unit).sortWithinPartitions(*unit).mapInArrow(
            _compare(grid, radius, threshold, block, 4 * cell_rows), "row long, links long, low long"), "vector-links"))
    return functools.reduce(DataFrame.unionByName, found)


#: Columns of ``_place``.
UNIT = "label string, dim int, region int, part int, other int, home boolean, late boolean, row long, times long, vec binary"
