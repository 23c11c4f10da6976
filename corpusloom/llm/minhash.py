"""Near-duplicate texts by BagMinHash signatures of weighted shingles, banding and exact verification.

A text is the bag of its five-word shingles with their counts; texts of fewer words are one shingle; the similarity of two
texts is the weighted Jaccard of their bags. Weights are discretised to the levels 0, 1, 2, ...; a shingle has a Poisson
process over time and level, made by halves: one process for each block of levels [0, 1), [1, 2), [2, 4), [4, 8), ... with
as much rate as the block has levels, whose points fall on a level of the block. A point counts if its level lies below the
shingle's weight. Every point falls on one of the signature's components, which keeps the earliest time it gets. Components
of two texts are equal with the probability of their similarity. Points are made in order of time, in rounds over a batch
of texts, and a shingle is done once its time exceeds all components of its text.

Texts with equal bags are one class from the start, so a group of copies costs one row. Candidates are texts that agree on
a band of ROWS components; candidates are joined into provisional classes (components of a star for each bucket). A small
provisional class is verified in one task, all its pairs. A large one, such as a third of all texts, is never gathered: all
its texts are compared to one pivot; those near it are its class; of the rest, only texts with a distance to the pivot of
at most twice the limit can be near a member (1 - weighted Jaccard is a metric), and these are compared to the members, in
blocks; then the rest gets its own pivot. What is left large after PIVOTS rounds is compared in blocks.

Inside, a bag is known by a number of its own, never by a document's id. The document with the smallest id stands for a bag
and a class, a null id after all others, and of those with one id the one with the smaller hash of its text.

Cases: null texts and texts without words are copies of nothing, each a class of its own; a row with a null id is a
document like any other, a class of such rows only has the null id; repeated rows are copies; different texts under one
id are different documents, but where both stand for a class their classes bear the same id; empty tables give empty
results; other columns are not read by near_duplicates() and carried by keep_one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialize, read
from corpusloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 26
ROWS = 5
#: A provisional class of at most this many texts is verified in one task.
SMALL_CLASS = 200
PIVOTS = 2
#: Texts whose processes advance together.
BATCH_TEXTS = 1000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the text's shingles, repeats included."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").split()  # splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    out.sort()
    return out


def bag_min_hash(bags: list[np.ndarray], length: int) -> np.ndarray:
    """Signatures, one row of `length` times for each bag (sorted hashes with repeats); infinite for an empty bag."""
    out = np.full((len(bags), length), np.inf)
    texts, keys, weights = [], [], []
    for k, bag in enumerate(bags):
        if len(bag):
            first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
            keys.append(bag[first])
            weights.append(np.diff(np.append(first, len(bag))))
            texts.append(np.full(len(first), k))
    if not texts:
        return out
    text, key, weight = map(np.concatenate, (texts, keys, weights))
    # One process for every block of levels that begins below the weight: blocks [0, 1), [1, 2), [2, 4), ...
    parts = [(text, key, np.ones(len(key)), weight.astype(np.float64), np.zeros(len(key)))]
    low = 1
    while (above := weight > low).any():
        n = int(above.sum())
        parts.append((text[above], _mix(key[above] + _U(low * 2 + 1)), np.full(n, float(low)), weight[above].astype(np.float64), np.full(n, float(low))))
        low *= 2
    text, key, width, weight, start = map(np.concatenate, zip(*parts, strict=True))
    time = np.zeros(len(text))
    flat = out.ravel()
    turn = 0
    while len(text):
        turn += 1
        draw = _mix(key + _U(turn * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        other = _mix(draw ^ _U(0xD1B54A32D192ED03))
        component = ((other >> _U(32)) % _U(length)).astype(np.int64)
        level = start + np.floor((other & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width)
        counts = level < weight
        np.minimum.at(flat, text[counts] * length + component[counts], time[counts])
        live = time < out.max(axis=1)[text]
        if not live.all():
            text, key, width, weight, start, time = (x[live] for x in (text, key, width, weight, start, time))
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of hashes with repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    # Shared = sum of the smaller counts: total minus the size of the union, counted by runs.
    keys, first = np.unique(both, return_index=True)
    total = np.diff(np.append(first, len(both)))
    in_a = np.searchsorted(a, keys, "right") - np.searchsorted(a, keys, "left")
    shared = int(np.minimum(in_a, total - in_a).sum())
    return shared / (len(a) + len(b) - shared)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (hash of the text), d1 and d2 (digest of the bag), n (its size), bands (a hash for each band; empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                bags = [shingles(t.as_py()) for t in batch.column(2)]
                sign = bag_min_hash(bags, bands * rows).view(np.uint64).reshape(len(bags), bands, rows)
                band = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.ones((len(bags), 1), np.uint64)
                for k in range(rows):
                    band = _mix(band * _U(0x9E3779B97F4A7C15) + sign[:, :, k])
                # Sums over the bag do not depend on its order.
                d1 = [int(_mix(b).sum(dtype=np.uint64).view(np.int64)) for b in bags]
                d2 = [int(_mix(b ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64)) for b in bags]
                lists = [x.view(np.int64) if len(b) else np.zeros(0, np.int64) for x, b in zip(band, bags, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([len(b) for b in bags], pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["id", "h", "d1", "d2", "n", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), text_col).mapInArrow(run, "id long, h long, d1 long, d2 long, n long, bands array<long>")


def _bags(texts: DataFrame) -> DataFrame:
    """texts: id, cls, text. id, cls, bag (the sorted hashes' bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [shingles(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["id", "cls", "bag"])

    return texts.select("id", "cls", "text").mapInArrow(run, "id long, cls long, bag binary")


def shared_counts(own: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """For every two bags the size of what they share, by products of the matrices "has the shingle at least n times"."""
    text = np.repeat(np.arange(len(own)), [len(x) for x in own])
    key = np.concatenate(own) if own else np.zeros(0, np.uint64)
    order = np.lexsort((text, key))
    text, key = text[order], key[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) if len(key) else np.zeros(0, bool)
    # The n-th copy of a shingle in a text is a feature of its own: (shingle, n).
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    feature = _mix(key + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, feature, uses = np.unique(feature, return_inverse=True, return_counts=True)
    many = uses[feature] > 1
    text, feature = text[many], feature[many]
    _, feature = np.unique(feature, return_inverse=True)
    order = np.argsort(feature, kind="stable")
    text, feature = text[order], feature[order]
    out = np.zeros((len(own), len(own)), np.float64)
    for at in range(0, int(feature[-1]) + 1 if len(feature) else 0, columns):
        a, b = np.searchsorted(feature, [at, at + columns])
        has = np.zeros((len(own), columns), np.float32)
        has[text[a:b], feature[a:b] - at] = 1.0
        out += has @ has.T
    return out


def _near(own: list[np.ndarray], ids: list[int], limit: float, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the near texts of a group; of all pairs near enough, a spanning forest.

    side: pairs are between a text of side 0 and one of side 1 only.
    """
    size = np.array([len(x) for x in own], dtype=np.float64)
    if len(own) < 2:
        return []
    shared = shared_counts(own)
    near = shared >= limit * (size[:, None] + size[None, :] - shared) - 1e-9
    near &= shared > 0
    if side is not None:
        near &= np.array(side)[:, None] != np.array(side)[None, :]
    root = list(range(len(own)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        if find(x) != find(y):
            root[find(y)] = find(x)
            out.append((ids[x], ids[y]))
    return out


def _verify(limit: float, sided: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        own = [np.frombuffer(b, dtype=np.uint64) for b in pdf["bag"]]
        links = _near(own, pdf["id"].tolist(), limit, pdf["side"].tolist() if sided else None)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [weighted_jaccard(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(batch.column(2), batch.column(4), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(sims, pa.float64())], names=["id", "cls", "bag", "pivot", "sim"])


def _blocks(left: DataFrame, right: DataFrame | None, sizes: DataFrame, limit: float) -> DataFrame:
    """Links within the classes of left, or between left and right, by blocks of SMALL_CLASS texts and without gathering a class.

    sizes: cls, n_left, n_right (n_right = n_left without right). A block holds at most about twice SMALL_CLASS texts.
    """
    half = SMALL_CLASS // 2

    def spread(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.ceil(F.col(own) / half)).alias("mine")
        out = df.join(sizes, "cls").select("id", "cls", "bag", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(other) / half) - 1)).alias("theirs"))
        at = (F.col("mine"), F.col("theirs")) if side == 0 else (F.col("theirs"), F.col("mine"))
        return out.select("id", "cls", "bag", F.lit(side).alias("side"), at[0].alias("p"), at[1].alias("q"))

    if right is not None:
        both = spread(left, "n_left", "n_right", 0).unionByName(spread(right, "n_right", "n_left", 1))
        return both.groupBy("cls", "p", "q").applyInPandas(_verify(limit, True), "a long, b long")
    one = spread(left, "n_left", "n_right", 0)
    pair = one.withColumn("low", F.least("p", "q")).withColumn("high", F.greatest("p", "q")).drop("p", "q")
    return pair.groupBy("cls", "low", "high").applyInPandas(_verify(limit, False), "a long, b long")


def verified_links(bags: DataFrame, limit: float = SIMILARITY, pivots: int = PIVOTS) -> list[DataFrame]:
    """bags: id, cls, bag, once for each id. Tables of links that join exactly the texts of a class that are near."""
    sizes = materialize(bags.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), "class-sizes")
    sized = bags.join(sizes, "cls")
    small = sized.where(F.col("n") <= SMALL_CLASS).withColumn("side", F.lit(0))
    links = [small.select("id", "cls", "bag", "side").groupBy("cls").applyInPandas(_verify(limit, False), "a long, b long")]
    left = materialize(sized.where(F.col("n") > SMALL_CLASS).select("id", "cls", "bag"), "large-classes")
    for turn in range(pivots + 1):
        counted = materialize(left.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")), "large-sizes")
        if counted.isEmpty():
            break
        rest = left.join(counted.where(F.col("n") <= SMALL_CLASS), "cls").select("id", "cls", "bag", F.lit(0).alias("side"))
        links.append(materialize(rest.groupBy("cls").applyInPandas(_verify(limit, False), "a long, b long"), f"links-rest{turn}"))
        large = counted.where(F.col("n") > SMALL_CLASS)
        if turn == pivots:
            todo = large.select("cls", F.col("n").alias("n_left"), F.col("n").alias("n_right"))
            links.append(_blocks(left, None, todo, limit))
            break
        pivot_bags = left.join(large.select(F.col("pivot").alias("id"), "pivot"), "id").select("cls", "pivot", F.col("bag").alias("pivot_bag"))
        # Every member meets its class's one pivot; the engine may split a class's rows over tasks.
        pairs = left.join(materialize(pivot_bags, f"pivots{turn}"), "cls").select("id", "cls", "bag", "pivot", "pivot_bag")
        met = materialize(pairs.mapInArrow(_against_pivot, "id long, cls long, bag binary, pivot long, sim double"), f"met{turn}")
        links.append(met.where((F.col("sim") >= limit - 1e-9) & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        members = met.where(F.col("sim") >= limit - 1e-9)
        others = met.where(F.col("sim") < limit - 1e-9)
        # Distances add up: a text near a member of the pivot's class is within twice the limit of the pivot.
        reach = 2 * limit - 1 - 1e-9
        close = others.where(F.col("sim") >= reach)
        n = met.groupBy("cls").agg(F.sum((F.col("sim") >= limit - 1e-9).cast("long")).alias("n_right"), F.sum(((F.col("sim") < limit - 1e-9) & (F.col("sim") >= reach)).cast("long")).alias("n_left"))
        todo = materialize(n.where("n_left > 0 and n_right > 0"), f"close{turn}")
        if not todo.isEmpty():
            links.append(materialize(_blocks(close, members, todo, limit), f"links-close{turn}"))
        left = others.select("id", "cls", "bag")
    return links


def classified(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, h, n (shingles), component_id, kept (it has the id and text that stand for its class)."""
    signed = materialize(signatures(docs, bands, rows, id_col, text_col), "signatures")
    worded = signed.where("n > 0")
    # One row for each bag; its first document stands for it.
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    bags = worded.groupBy("d1", "d2").agg(F.min(first).alias("first"), F.min_by("bands", first).alias("bands"))
    bags = materialize(bags.select("d1", "d2", "first", "bands").withColumn("rep", F.monotonically_increasing_id()), "bags")
    keys = bags.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("band", "key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select(F.col("band").alias("b"), F.col("key").alias("k"), "least")
    stars = materialize(keys.join(buckets, (F.col("band") == F.col("b")) & (F.col("key") == F.col("k"))).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "bucket-stars")
    classes = components(stars)
    cls = classes.unionByName(classes.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("c_rep"), F.col("component").alias("cls"))
    found_in = bags.select("rep", F.col("first.id").alias("f_id"), F.col("first.h").alias("f_h")).join(cls, F.col("rep") == F.col("c_rep")).select("rep", "cls", "f_id", "f_h")
    # The candidates grow with the texts, so the join is the same at every size.
    whole = docs.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    texts = whole.join(found_in.hint("merge"), (F.col("h") == F.col("f_h")) & F.col("d_id").eqNullSafe(F.col("f_id"))).select(F.col("rep").alias("id"), "cls", "text")
    own = materialize(_bags(texts).dropDuplicates(["id"]), "class-bags")
    links = verified_links(own, similarity)
    table = links[0]
    for more in links[1:]:
        table = table.unionByName(more)
    found = components(materialize(table, "links"))
    discard(stars, own)
    placed = bags.select("d1", "d2", "rep", "first").join(found, F.col("rep") == F.col("node"), "left").select(F.col("d1").alias("r1"), F.col("d2").alias("r2"), "first", "rep", "component")
    linked = placed.select("first", F.coalesce("component", "rep").alias("component")).groupBy("component").agg(F.min("first").alias("winner"))
    reps = placed.withColumn("own", F.coalesce("component", "rep")).drop("component").join(linked, F.col("own") == F.col("component")).select("r1", "r2", "winner")
    reps = materialize(reps, "rep-classes")
    joined = signed.select("id", "h", "d1", "d2", "n").join(reps, (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")) & (F.col("n") > 0), "left")
    kept = F.col("winner").isNull() | (F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("h") == F.col("winner.h")))
    return joined.select("id", "h", "n", F.when(F.col("winner").isNull(), F.col("id")).otherwise(F.col("winner.id")).alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of its class), kept (it stands for the class)."""
    out = classified(docs, similarity, bands, rows, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their class, all their columns; of repeated rows of one such id and text one stays.

    Documents without words all stay.
    """
    found = classified(docs).where("kept").groupBy("id", "h").agg(F.count(F.lit(1)).alias("__cl_rows"), F.max("n").alias("__cl_n"))
    found = materialize(found.select(F.col("id").alias("__cl_id"), F.col("h").alias("__cl_h"), ((F.col("__cl_rows") > 1) & (F.col("__cl_n") > 0)).alias("__cl_twice")), "kept-ids")
    keyed = docs.withColumn("__cl_key", F.xxhash64("text"))
    same = (F.col("__cl_key") == F.col("__cl_h")) & F.col("doc_id").eqNullSafe(F.col("__cl_id"))
    if found.where("__cl_twice").isEmpty():
        return keyed.join(found, same, "left_semi").select(*docs.columns)
    both = keyed.join(found, same)
    first = both.where("__cl_twice").dropDuplicates(["__cl_key", "doc_id"])
    return both.where("NOT __cl_twice").unionByName(first).select(*docs.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op5_minhash": op5_minhash}
