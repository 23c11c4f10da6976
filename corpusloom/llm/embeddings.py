"""Near-duplicate embeddings by sorted projection passes.

Vectors compare only within a group (label and dimension). In a pass every vector gets BITS random hyperplane signs,
concatenated; the vectors are ordered by group and signs, and each is compared with the next WINDOW ones at least. A pass
is one range exchange over that order (ties are split by id). What travels is a sketch, a byte for each component and the
norm of what rounding took away: it bounds a cosine from both sides, by some 0.01. Pairs surely within the threshold are
united, and a pass hands on no more than one such link for each vector, a spanning forest of what its windows found. Pairs
that the sketch leaves open, and that the sure links of all passes have not joined anyway, are verified on the whole
vectors in double precision.

Number of passes: a pair at the threshold agrees on one sign with probability p = 1 - acos(threshold) / pi. Each pass
measures how many leading signs b narrow the vectors around a vector down to its window, so it finds a pair of that vector
with at least p^b; that holds for vectors of any distribution, as those that share a direction only have a larger b. A
vector is settled when the chance that all passes missed a pair of it is at most MISS. Passes go on, for the groups that
need them, while they cost less than to compare the unsettled vectors of a group with one another; then these are compared,
exactly and in blocks. Of them, those within half the threshold's angle of their mean are all linked and not compared
among themselves.

The links of each vector are then counted exactly inside its component, where all of them must lie. A component of at most
BLOCK vectors is counted in one task, by a matrix product, many of them at once. A larger one is never gathered: vectors within half the
threshold's angle of its centre are all linked to one another, which is counted without looking at pairs; only the others
are compared to all, in blocks.

Equal vectors of a group are one row with a count from the start.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing; null ids are left as they are, with a null component; repeated rows are vectors of their own; ties go to the
smallest id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, read
from corpusloom.llm.components import _local_stars, components

THRESHOLD = 0.93
BITS = 60
WINDOW = 256
MISS = 1e-5
#: Passes that share an exchange, at most.
PASSES_AT_ONCE = 6
BLOCK = 512
#: Rows of a block in which unsettled vectors are compared; the cost of a pair in a window, in pairs of a block.
FINISH_BLOCK = 1024
WINDOW_COST = 4
#: The logarithm of the chance to miss a pair whose whole group lies in the window.
SURE = -1000.0
SEED = 3
#: Angles nearer than this to a bound are left to exact comparison.
SLACK = 1e-6
#: What single precision may add to a cosine of two sketches.
ROUNDING = 1e-5


def passes_for(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    bits = max(0.0, math.log2(max(1, largest) / (window / 2)))
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(0.999, (1 - math.acos(threshold) / math.pi) ** bits))))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of unit length, in double precision; the bytes are those of floats or doubles."""
    data = column.to_pylist()
    kind = np.float32 if len(data) and len(data[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(data), dtype=kind).reshape(-1, dim).astype(np.float64) if len(data) else np.zeros((0, dim))
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of extreme components neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sketches(x: np.ndarray) -> list[bytes]:
    """Of unit vectors: a signed byte for each component, then its unit and the norm of the rest as two floats."""
    unit = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    whole = np.rint(x / unit[:, None]).astype(np.int8)
    rest = np.linalg.norm(x - whole * unit[:, None].astype(np.float64), axis=1)
    tail = np.stack([unit, np.nextafter(rest.astype(np.float32), np.float32(np.inf))], 1).astype("<f4").view(np.int8)
    data = np.concatenate([whole, tail], axis=1)
    return [row.tobytes() for row in data]


def _from_sketches(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors in single precision, and the norms of what rounding took away."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, dim + 8)
    tail = np.ascontiguousarray(data[:, dim:]).view("<f4")
    return data[:, :dim].astype(np.float32) * tail[:, :1], tail[:, 1]


def _packed(vectors: DataFrame) -> DataFrame:
    """vectors: id, grp, dim, embedding (array of float or double). The embedding as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            data = [values[offsets[k] : offsets[k + 1]].tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(data, pa.binary())], names=["id", "grp", "dim", "vec"])

    return vectors.select("id", "grp", "dim", "embedding").mapInArrow(run, "id long, grp long, dim int, vec binary")


def _projected(vectors: DataFrame, passes: list[int], bits: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        power = 2 ** np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = _rows(part.column(3), dim)
                sketch = pa.array(_sketches(x), pa.binary())
                for k in passes:
                    if (k, dim) not in planes:
                        planes[k, dim] = np.random.default_rng([seed, k, dim]).standard_normal((dim, bits))
                    key = (x @ planes[k, dim] > 0) @ power
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), part.column(1), pa.array(key), part.column(0), part.column(2), sketch], names=["pass", "grp", "key", "id", "dim", "vec"])

    return vectors.mapInArrow(run, "pass int, grp long, key long, id long, dim int, vec binary")


def _shared(run_of: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    """Leading signs that each row shares with the row `step` further on: -1 in another group."""
    x = key[step:] ^ key[:-step]
    high, low = np.frexp((x >> 30).astype(float))[1], np.frexp((x & (2**30 - 1)).astype(float))[1]
    return np.where(run_of[step:] == run_of[:-step], BITS - np.where(high > 0, high + 30, low), -1)


def log_miss(run_of: np.ndarray, key: np.ndarray, threshold: float, window: int) -> np.ndarray:
    """Of each row of a partition the logarithm of the chance that this pass misses a pair of it: 0 near its borders."""
    n, step = len(key), window + 1
    bits = np.full(n, BITS)  # the most signs shared with a row that is not compared
    known = np.zeros(n, bool)
    if n > 2 * step:
        shared = _shared(run_of, key, step)
        bits[step:-step] = np.maximum(shared[step:], shared[:-step])
        known[step:-step] = True
    found = np.where(known & (bits < BITS), (1 - math.acos(threshold) / math.pi) ** (bits + 1.0), 0.0)
    return np.where(found == 1.0, SURE, np.log1p(-np.minimum(found, 0.999999)))


def _root_of(stars: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    """Of each id the one its star hangs on, or itself."""
    node, root = stars.column(0).to_numpy(), stars.column(1).to_numpy()
    if not len(node):
        return ids
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    return np.where(node[at] == ids, root[at], ids)


def _windows(threshold: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; the last `window` ones are kept for the next batch. Links that are sure and pairs that are open, then what log_miss says."""
        table, seen = None, []
        for b in batches:
            seen.append([b.column(k).to_numpy() for k in range(4)])
            table = pa.Table.from_batches([b]) if table is None else pa.concat_tables([table.slice(max(0, table.num_rows - window)), pa.Table.from_batches([b])])
            part, group, ids, dims = (table.column(c).to_numpy() for c in ("pass", "grp", "id", "dim"))
            run_of = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (group[1:] != group[:-1])])) if len(ids) else np.zeros(0)
            sure, open_ones = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, rest = _from_sketches(table.column("vec").take(pa.array(at)), dim)
                of, own = run_of[at], ids[at]
                for low in range(0, len(at), window):
                    # A block meets itself and the next one, so each row the next `window` ones at least.
                    mid, high = min(low + window, len(at)), min(low + 2 * window, len(at))
                    cosine = x[low:mid] @ x[low:high].T
                    error = rest[low:mid, None] + rest[None, low:high] + rest[low:mid, None] * rest[None, low:high] + ROUNDING
                    i, j = np.nonzero(cosine + error >= threshold)
                    later = (j > i) & (of[low + i] == of[low + j])
                    i, j = i[later], j[later]
                    certain = cosine[i, j] - error[i, j] >= threshold
                    pairs = np.stack([own[low + i], own[low + j]])
                    sure.append(pairs[:, certain])
                    open_ones.append(pairs[:, ~certain])
            a, c = np.concatenate(sure, axis=1)
            stars = next(_local_stars([pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])]))
            a, c = np.concatenate(open_ones, axis=1)
            apart = _root_of(stars, a) != _root_of(stars, c)  # the others are settled by sure links of the batch
            a, c = np.minimum(a, c)[apart], np.maximum(a, c)[apart]
            n, m = stars.num_rows, len(a)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([stars.column(0), pa.array(a, pa.int64())]), pa.concat_arrays([stars.column(1), pa.array(c, pa.int64())]), pa.nulls(n + m, pa.int64()), pa.nulls(n + m, pa.float64()), pa.array([True] * n + [False] * m, pa.bool_())], names=["a", "b", "grp", "log_miss", "sure"])
        if seen:
            part, group, key, ids = (np.concatenate(x) for x in zip(*seen, strict=True))
            run_of = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (group[1:] != group[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(group), pa.array(log_miss(run_of, key, threshold, window)), pa.nulls(len(ids), pa.bool_())], names=["a", "b", "grp", "log_miss", "sure"])

    return run


def _link_block(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stars of the links between the rows of side 0 (off) and those of side 1."""
        x = _rows(pa.array(pdf["vec"]), int(pdf["dim"].iat[0]))
        off, ids = pdf["off"].to_numpy(), pdf["id"].to_numpy()
        one, two = np.flatnonzero(off), np.flatnonzero(~off)
        a, b = np.nonzero(x[one] @ x[two].T >= threshold)
        stars = next(_local_stars([pa.RecordBatch.from_arrays([pa.array(ids[one][a]), pa.array(ids[two][b])], names=["a", "b"])]))
        return pd.DataFrame({"a": stars.column(0).to_numpy(), "b": stars.column(1).to_numpy()})

    return run


def exact_links(vectors: DataFrame, threshold: float, block: int = FINISH_BLOCK) -> DataFrame:
    """vectors: id, grp, dim, vec. a, b: links that join all vectors of a group which are within the threshold."""
    vectors = vectors.select("id", F.col("grp").alias("cls"), "dim", F.lit(1).cast("long").alias("copies"), "vec")
    sums = vectors.select("id", "cls", "dim", "vec").mapInArrow(_partial_sums, "cls long, dim int, vec binary")
    centres = materialize(sums.groupBy("cls").applyInPandas(_centre, "cls long, centre binary"), "unsettled-centres")
    measured = vectors.join(centres, "cls").select("id", "cls", "dim", "copies", "vec", "centre").mapInArrow(_angles, "id long, cls long, dim int, copies long, vec binary, angle double")
    measured = materialize(measured.withColumn("core", F.col("angle") <= math.acos(threshold) / 2 - SLACK), "unsettled-angles")
    totals = materialize(measured.groupBy("cls").agg(F.min(F.when(F.col("core"), F.col("id"))).alias("first"), F.sum((~F.col("core")).cast("long")).alias("n_off"), F.count(F.lit(1)).alias("n_all")), "unsettled-sizes")
    core = measured.where("core").join(totals, "cls").select(F.col("id").alias("a"), F.col("first").alias("b"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1))
    split = measured.join(totals.where("n_off > 0"), "cls")
    off = split.where(~F.col("core")).select("id", "cls", "dim", "vec", F.lit(True).alias("off"), part("n_off").alias("p"), every("n_all").alias("q"))
    rest = split.select("id", "cls", "dim", "vec", F.lit(False).alias("off"), part("n_all").alias("q"), every("n_off").alias("p")).select(*off.columns)
    return core.unionByName(off.unionByName(rest).groupBy("cls", "p", "q").applyInPandas(_link_block(threshold), "a long, b long"))


def all_links(packed: DataFrame, threshold: float, window: int, miss: float, seed: int) -> DataFrame:
    """packed: id, grp, dim, vec. a, b: links whose components are those of all pairs within the threshold."""
    sizes = materialize(packed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    at_once = min(PASSES_AT_ONCE, passes_for(sizes.agg(F.max("n")).first()[0] or 0, threshold, window, miss))
    links, opened, chances, todo, turn = [], [], None, packed, 0
    while True:
        passes = list(range(turn * at_once, (turn + 1) * at_once))
        turn += 1
        ordered = _projected(todo, passes, BITS, seed).repartitionByRange("pass", "grp", "key", "id").sortWithinPartitions("pass", "grp", "key", "id")
        found = materialize(ordered.mapInArrow(_windows(threshold, window), "a long, b long, grp long, log_miss double, sure boolean"), f"passes{turn}")
        links.append(found.where("sure").select("a", "b").distinct())
        opened.append(found.where("NOT sure").select("a", "b"))
        new = found.where("b IS NULL").groupBy(F.col("a").alias("u_id"), F.col("grp").alias("u_grp")).agg(F.sum("log_miss").alias("log_miss"), F.count(F.lit(1)).alias("n_rows"))
        both = new if chances is None else chances.unionByName(new).groupBy("u_id", "u_grp").agg(F.sum("log_miss").alias("log_miss"), F.sum("n_rows").alias("n_rows"))
        chances = materialize(both, f"chances{turn}")
        # An id with several vectors has more rows than passes: what it is given is not its own.
        done = turn * at_once
        unsettled = chances.where((F.col("log_miss") > math.log(miss)) | (F.col("n_rows") != done))
        # Passes to go, from the mean of what a pass has brought the unsettled vectors of the group.
        groups = unsettled.groupBy("u_grp").agg(F.count(F.lit(1)).alias("n_left"), F.avg("log_miss").alias("brought")).join(sizes, F.col("u_grp") == F.col("grp"))
        to_go = F.greatest(done * (math.log(miss) / F.least("brought", F.lit(-1e-9)) - 1), F.lit(1.0))
        groups = materialize(groups.select("u_grp", (F.col("n_left").cast("double") * F.col("n_left") > to_go * F.col("n") * window * WINDOW_COST).alias("more")), f"unsettled{turn}")
        finish = unsettled.join(groups.where("NOT more").select(F.col("u_grp").alias("f_grp")), F.col("u_grp") == F.col("f_grp"), "left_semi")
        if not groups.where("NOT more").isEmpty():
            links.append(materialize(exact_links(materialize(todo.join(finish, (F.col("id") == F.col("u_id")) & (F.col("grp") == F.col("u_grp")), "left_semi"), f"finish{turn}"), threshold), f"exact{turn}"))
        more = groups.where("more").select(F.col("u_grp").alias("m_grp"))
        if more.isEmpty():
            break
        todo = materialize(todo.join(more, F.col("grp") == F.col("m_grp"), "left_semi"), f"todo{turn}")
        chances = materialize(chances.join(more, F.col("u_grp") == F.col("m_grp"), "left_semi"), f"chances{turn}")
    out, left = links[0], opened[0]
    for more in links[1:]:
        out = out.unionByName(more)
    for more in opened[1:]:
        left = left.unionByName(more)
    return out.unionByName(verified(materialize(left.distinct(), "open-pairs"), out, packed, threshold))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, dim, vec, other: the pairs within the threshold."""
        for batch in batches:
            for dim in np.unique(batch.column(2).to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column(2).to_numpy() == dim))
                near = np.einsum("ij,ij->i", _rows(part.column(3), dim), _rows(part.column(4), dim)) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, links: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Of the open pairs those within the threshold, but for the ones whose ends the links join already."""
    if pairs.isEmpty():
        return pairs
    found = materialize(components(links), "sure-classes")
    of = lambda end: found.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_of"))
    placed = pairs.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    apart = placed.where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")
    one = packed.select(F.col("id").alias("one_id"), "grp", "dim", "vec")
    two = packed.select(F.col("id").alias("two_id"), F.col("grp").alias("two_grp"), F.col("vec").alias("other"))
    both = apart.join(one, F.col("a") == F.col("one_id")).join(two, (F.col("b") == F.col("two_id")) & (F.col("grp") == F.col("two_grp")))
    return both.select("a", "b", "dim", "vec", "other").mapInArrow(_verify(threshold), "a long, b long")


def _component_counts(threshold: float):
    def whole(table: pa.Table) -> pa.RecordBatch:
        """Counts of whole components, all of one size and dimension at once."""
        cls, dims, ids, copies = (table.column(c).to_numpy() for c in ("cls", "dim", "id", "copies"))
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        size = np.diff(np.append(first, len(cls)))
        linked = np.zeros(len(cls), np.int64)
        for dim, n in np.unique(np.stack([dims[first], size]), axis=1).T.tolist():
            starts = first[(dims[first] == dim) & (size == n)]
            at_once = max(1, (1 << 22) // (n * n))
            for low in range(0, len(starts), at_once):
                rows = starts[low : low + at_once, None] + np.arange(n)
                x = _rows(table.column("vec").take(pa.array(rows.ravel())), dim).reshape(len(rows), n, dim)
                near = x @ x.transpose(0, 2, 1) >= threshold
                near[:, np.arange(n), np.arange(n)] = False
                linked[rows] = (near * copies[rows][:, None, :]).sum(2)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked)], names=["id", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of components; the last one of a batch waits for the next batch."""
        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if table.num_rows:
                cls = table.column("cls").to_numpy()
                last = int(np.searchsorted(cls, cls[-1]))
                held = table.slice(last)
                if last:
                    yield whole(table.slice(0, last))
        if held is not None and held.num_rows:
            yield whole(held)

    return run


def _count_block(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Side 0: vectors off the centre; side 1: all of the component. Counts of both; a core one counts side 0 only."""
        x = _rows(pa.array(pdf["vec"]), int(pdf["dim"].iat[0]))
        off, ids, weight, core = (pdf[c].to_numpy() for c in ("off", "id", "copies", "core"))
        a, b = np.flatnonzero(off), np.flatnonzero(~off)
        near = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        mine, theirs = near @ weight[b], weight[a] @ near
        ids_out, n = np.concatenate([ids[a], ids[b][core[b]]]), np.concatenate([mine, theirs[core[b]]])
        return pd.DataFrame({"id": ids_out.astype("int64"), "linked": n.astype("int64")})

    return run


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        cls, dims = b.column(1).to_numpy(), b.column(2).to_numpy()
        for c in np.unique(cls).tolist():
            part = b.filter(pa.array(cls == c))
            dim = int(dims[cls == c][0])
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([dim], pa.int32()), pa.array([_rows(part.column(3), dim).sum(0).tobytes()], pa.binary())], names=["cls", "dim", "vec"])


def _centre(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v, np.float64) for v in pdf["vec"]], axis=0)
    return pd.DataFrame({"cls": pdf["cls"].iloc[:1], "centre": [total.tobytes()]})


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == dim))
            centre = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(-1, dim)
            size = np.linalg.norm(centre, axis=1)
            cosine = np.einsum("ij,ij->i", _rows(part.column(4), dim), centre) / np.where(size > 0, size, 1.0)
            angle = np.where(size > 0, np.arccos(np.clip(cosine, -1.0, 1.0)), math.pi)
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(5)], pa.array(angle)], names=["id", "cls", "dim", "copies", "vec", "angle"])


def link_counts(own: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """own: id, cls, dim, copies, vec. id, linked: the copies of other rows of its component within the threshold."""
    sizes = materialize(own.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "component-sizes")
    sized = materialize(own.join(sizes, "cls").select("id", "cls", "dim", "copies", "vec", "n"), "component-vectors")
    small = sized.where(F.col("n") <= block).select("id", "cls", "dim", "copies", "vec").repartition("cls").sortWithinPartitions("cls").mapInArrow(_component_counts(threshold), "id long, linked long")
    big = sized.where(F.col("n") > block)
    if big.isEmpty():
        return small
    sums = big.select("id", "cls", "dim", "vec").mapInArrow(_partial_sums, "cls long, dim int, vec binary")
    centres = materialize(sums.groupBy("cls").applyInPandas(_centre, "cls long, centre binary"), "centres")
    measured = big.join(centres, "cls").select("id", "cls", "dim", "copies", "vec", "centre").mapInArrow(_angles, "id long, cls long, dim int, copies long, vec binary, angle double")
    core = F.col("angle") <= math.acos(threshold) / 2 - SLACK
    measured = materialize(measured.withColumn("core", core), "angles")
    totals = measured.groupBy("cls").agg(F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_copies"), F.sum((~F.col("core")).cast("long")).alias("n_off"), F.count(F.lit(1)).alias("n_all"))
    totals = materialize(totals, "cores")
    among = measured.where("core").join(totals, "cls").select("id", (F.col("core_copies") - F.col("copies")).alias("linked"))
    half = block // 2
    # Block (p, q): the p-th part of the vectors off the centre against the q-th part of all.
    part = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / half))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / half) - 1))
    split = measured.join(totals.where("n_off > 0"), "cls")
    fields = ("id", "cls", "dim", "copies", "vec", "core")
    off = split.where(~F.col("core")).select(*fields, F.lit(True).alias("off"), part("n_off").alias("p"), every("n_all").alias("q"))
    rest = split.select(*fields, F.lit(False).alias("off"), part("n_all").alias("q"), every("n_off").alias("p")).select(*off.columns)
    blocks = off.unionByName(rest).groupBy("cls", "p", "q").applyInPandas(_count_block(threshold), "id long, linked long")
    return small.unionByName(among).unionByName(blocks).groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links (others linked directly), component_id, kept (the id is the component's)."""
    vector = F.col(vector_col)
    single = table.schema[vector_col].dataType.elementType.simpleString() == "float"
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    sound = F.coalesce((F.size(vector) > 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    # Two hashes of different kinds, 96 bits with those of the group beside them.
    digest = F.when(sound, F.concat_ws(":", F.xxhash64(vector), F.hash(vector)))
    rows = materialize(table.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.xxhash64(label_col, F.size(vector))).alias("grp"), digest.alias("digest")), "vectors")
    equal = rows.where(F.col("grp").isNotNull()).groupBy(F.col("grp").alias("g"), F.col("digest").alias("d")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    equal = materialize(equal, "equal-vectors")
    valid = table.where(sound).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col, F.size(vector)).alias("grp"), F.size(vector).alias("dim"), vector.cast("array<float>" if single else "array<double>").alias("embedding"), digest.alias("digest"))
    # Without copies every vector stands for itself and the table needs no exchange.
    if equal.where("copies > 1").isEmpty():
        reps = valid
    else:
        reps = valid.join(equal, (F.col("id") == F.col("rep")) & (F.col("grp") == F.col("g")) & (F.col("digest") == F.col("d")), "left_semi").dropDuplicates(["id", "grp", "digest"])
    packed = materialize(_packed(reps), "unit-vectors")
    classes = materialize(components(all_links(packed, threshold, window, miss, seed)), "vector-classes")
    members = classes.unionByName(classes.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("c_id"), F.col("component").alias("cls"))
    counted = equal.select("rep", "copies")
    own = packed.join(members, F.col("id") == F.col("c_id")).join(counted, F.col("id") == F.col("rep")).select("id", "cls", "dim", "copies", "vec")
    linked = link_counts(materialize(own, "linked-vectors"), threshold)
    reps_out = equal.join(members, F.col("rep") == F.col("c_id"), "left").join(linked.withColumnRenamed("id", "l_id"), F.col("rep") == F.col("l_id"), "left")
    reps_out = materialize(reps_out.select("g", "d", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("cls", "rep").alias("component")), "vector-results")
    out = rows.join(reps_out, (F.col("grp") == F.col("g")) & (F.col("digest") == F.col("d")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embeddings": op1_embeddings}
