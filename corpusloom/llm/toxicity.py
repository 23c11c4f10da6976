"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 6, with < and > at its ends), hashed into BUCKETS vectors; a
passage of WINDOW words is the mean of its distinct words; a linear softmax reads that mean. A passage of fewer than SHORT
distinct words is filled up to SHORT with words of no evidence (zero vectors), so that a lone word decides little.
Embeddings and softmax are trained together by mini-batch descent on labelled documents, first with every passage of a
toxic document as toxic, then with its strongest passages only. A document's logit is that of its strongest passage over
all offsets, so a long text dilutes nothing; two numbers fitted on the training documents turn it into a probability.
Unseen misspellings share n-grams with known words.

Since a word's share in a passage's logit is one number over the passage's number of words, it is kept by word in each
Python worker. N-grams seen fewer than LEAST times in training have no vector and count for nothing.

The training sample is bounded: at most TRAIN_DOCS documents of each label, the ones with the smallest hash of the id, a
row for each id; of them every passage trains. It is gathered and fitted in one executor task, which hands BUCKETS numbers
to the driver. Scoring reads every whole text. Labels of held-out rows are read neither here nor in the choice of the
settings, which was made by training on rows whose remainder is 0 and looking at those whose remainder is 2.

Cases: a null or empty text gets the score of no evidence; equal rows score alike; rows with a null label or id don't
train and a null id is not held out; an id with several labels is toxic if one says so, and of its texts the one with the
smallest hash trains; without rows of both labels every score is 0; other columns of documents are not inputs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialize, read, worker_state

BUCKETS = 1 << 17
DIM = 4
WINDOW = 24
TRAIN_DOCS = 1500
#: Places a passage has at least.
SHORT = 12
LEAST = 4
EPOCHS = 12
BATCH = 256
RATE = 1.0
STRONGEST = 3
SEED = 5
THRESHOLD = 0.7
CACHE_WORDS = 200_000
#: Texts whose new words are scored in one call.
TEXTS_AT_ONCE = 64
STRIP = " \t\r\n.,;:!?\"'()[]{}<>*#$%&|-_"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams, and for each the index of its word."""
    marked = [f"<{w.strip(STRIP)}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    end = np.cumsum(lengths)[owner]
    out, of = [], []
    running = np.zeros(len(codes), dtype=np.uint64)
    position = np.arange(len(codes))
    for n in range(1, 7):
        ahead = codes[n - 1 :]
        running = running[: len(ahead)] * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(1)
        if n >= 3:
            inside = position[: len(ahead)] + n <= end[: len(ahead)]
            mixed = running[inside]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
            of.append(owner[: len(ahead)][inside])
    return np.concatenate(out), np.concatenate(of)


def in_parts(words: list[str], buckets: int = BUCKETS, part: int = 20_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Start, number of words, and subwords() of one part of the words after another, to bound memory."""
    for at in range(0, len(words), part):
        some = words[at : at + part]
        yield at, len(some), *subwords(some, buckets)


def counted_once(words: list, window: int = WINDOW) -> list[bool]:
    """Whether each word counts: not if the same word counted less than a window before, so repeats don't add up."""
    last: dict = {}
    out = []
    for k, w in enumerate(words):
        fresh = k - last.get(w, -window) >= window
        if fresh:
            last[w] = k
        out.append(fresh)
    return out


@dataclass
class Model:
    """share: of each bucket in the sum over a passage's words, NaN without a vector; a and b: logit to probability's logit."""

    share: np.ndarray
    bias: float
    a: float
    b: float

    def word_shares(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for at, some, bucket, of in in_parts(words, len(self.share)):
            value = self.share[bucket]
            known = ~np.isnan(value)
            total = np.bincount(of[known], weights=value[known], minlength=some)
            out[at : at + some] = total / np.maximum(np.bincount(of[known], minlength=some), 1)
        return out

    def logit(self, shares: np.ndarray, counted: np.ndarray, window: int = WINDOW, short: int = SHORT) -> float:
        """Of the strongest passage; counted: whether a word counts."""
        n = len(shares)
        if not n:
            return self.bias
        shares = shares * counted
        if n <= window:
            return self.bias + float(shares.sum()) / max(short, int(counted.sum()))
        sums, words = np.concatenate([[0.0], np.cumsum(shares)]), np.concatenate([[0], np.cumsum(counted)])
        return self.bias + float(((sums[window:] - sums[:-window]) / np.maximum(words[window:] - words[:-window], short)).max())

    def probability(self, logit: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.a * logit + self.b))))


def fit(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS, window: int = WINDOW, short: int = SHORT) -> Model:
    """texts with labels 0 or 1, both present."""
    index: dict[str, int] = {}
    passages: list[np.ndarray] = []
    doc_of: list[int] = []
    for d, text in enumerate(texts):
        ids = [index.setdefault(w, len(index)) for w in words_of(text)]
        for start in range(0, max(len(ids), 1), window):
            passages.append(np.unique(np.array(ids[start : start + window], dtype=np.int32)))
            doc_of.append(d)
    places = np.maximum(np.fromiter(map(len, passages), dtype=np.int64, count=len(passages)), short)
    docs, label = np.array(doc_of), np.array(labels, dtype=np.float32)
    toxic = label[docs] > 0
    vocabulary = list(index) or [""]
    # How often an n-gram occurs, counted by passages.
    uses = np.bincount(np.concatenate(passages), minlength=len(vocabulary)) if passages else np.zeros(1)
    seen = np.zeros(BUCKETS)
    for at, some, b, o in in_parts(vocabulary):
        seen += np.bincount(b, weights=uses[at : at + some][o], minlength=BUCKETS)
    parts = []
    for at, _, b, o in in_parts(vocabulary):
        known = seen[b] >= LEAST
        order = np.argsort(o[known], kind="stable")
        parts.append((b[known][order].astype(np.int32), (o[known][order] + at).astype(np.int32)))
    bucket, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    size = np.bincount(of, minlength=len(vocabulary))
    del of
    first = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.tile(np.array([[-0.5, 0.5]], np.float32), (DIM, 1)), np.zeros(2, np.float32)
    past = [np.ones_like(v) for v in (table, weight, bias)]

    def grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words' n-grams one after another, and for each the place of its word."""
        n = size[words]
        place = np.repeat(np.arange(len(words)), n)
        return bucket[np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(len(place))], place

    def sums(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
        return np.bincount(flat, weights=values.ravel(), minlength=rows * DIM).reshape(rows, DIM).astype(np.float32)

    def forward(some: np.ndarray):
        tokens = np.concatenate([passages[k] for k in some])
        win = np.repeat(np.arange(len(some)), [len(passages[k]) for k in some])
        words, inverse = np.unique(tokens, return_inverse=True)
        at, place = grams(words)
        n = np.maximum(size[words], 1)[:, None].astype(np.float32)
        # The mean, times WINDOW: only the unit in which the softmax's weights are measured.
        part = (WINDOW / places[some])[:, None].astype(np.float32)
        x = sums(win, (sums(place, table[at], len(words)) / n)[inverse], len(some)) * part
        logits = x @ weight + bias
        return x, 1.0 / (1.0 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -60, 60))), (win, inverse, at, place, n, len(words), part)

    def update(which: int, value: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        past[which] += gradient * gradient
        value -= rate * gradient / np.sqrt(past[which])

    use = np.ones(len(passages), bool)
    for epoch in range(epochs):
        if epoch >= epochs // 3:  # the strongest passages of toxic documents stand for them
            p = np.concatenate([forward(some)[1] for some in np.array_split(np.arange(len(passages)), max(1, len(passages) // 512))])
            by = np.lexsort((-p, docs))
            rank = np.empty(len(docs), np.int64)
            rank[by] = np.arange(len(docs)) - np.searchsorted(docs[by], docs[by])
            use = ~(toxic & (rank >= STRONGEST))
        of_use = [rng.permutation(np.flatnonzero(use & (toxic == t))) for t in (False, True)]
        batches = max(1, int(use.sum()) // BATCH)
        # Toxic passages weigh as much as the others together, at most ten times.
        extra = min(10.0, max(1.0, len(of_use[0]) / max(1, len(of_use[1]))))
        for some in zip(*[np.array_split(x, batches) for x in of_use], strict=True):
            some = np.concatenate(some)
            x, p, (win, inverse, at, place, n, n_words, part) = forward(some)
            slope = ((p - toxic[some]) * np.where(toxic[some], extra, 1.0)).astype(np.float32)
            both = np.stack([-slope, slope], 1)
            d_word = sums(inverse, (both @ weight.T * part)[win], n_words) / n
            g_weight = x.T @ both
            update(0, table, sums(at, d_word[place], BUCKETS), RATE)
            update(1, weight, g_weight, RATE / 10)
            update(2, bias, both.sum(0), RATE)
    share = WINDOW * (table @ (weight[:, 1] - weight[:, 0])).astype(np.float64)
    share[seen < LEAST] = np.nan
    model = Model(share, float(bias[1] - bias[0]), 1.0, 0.0)
    shares = model.word_shares(vocabulary)
    split = [words_of(text) for text in texts]
    at = np.array([model.logit(shares[[index[w] for w in words]], np.array(counted_once(words), bool), window, short) for words in split])
    # Platt's targets keep the two numbers finite where the labels are separable.
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(at.std()), 1e-9)
    z = np.stack([at / scale, np.ones_like(at)], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ theta, -60, 60)))
        hessian = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(hessian, z.T @ (p - goal) + 1e-3 * theta)
    return Model(share, model.bias, float(theta[0] / scale), float(theta[1]))


def learnable(doc_id: Column) -> Column:
    """Rows that may train: crc32 of the id as text, modulo 3, is not 1. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text and toxic of at most `most` documents of each label, by the smallest hash of the id; one row for each id."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    # Ids without a document take no place: the ids of documents are looked up first, without their texts.
    known = docs.select(F.col("doc_id").alias("id")).join(ids.select("id"), "id", "left_semi").distinct()
    there = materialize(ids.join(known, "id", "left_semi"), "labelled")
    chosen = None
    for value in (0, 1):
        some = there.where(F.col("toxic") == value).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # Bounded by the parameter: 2 * most rows.
    found = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, toxic: at most 2 * TRAIN_DOCS rows, in one task. The model as one row; none without both labels."""
    rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    if len({int(r[2]) for r in rows}) == 2:
        model = fit([r[1] for r in rows], [int(r[2]) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.share.tobytes()], pa.binary()), *[pa.array([v], pa.float64()) for v in (model.bias, model.a, model.b)]], names=["share", "bias", "a", "b"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model | None:
    """None without documents of both labels."""
    rows = materialize(training_rows(docs, labels, most), "training")
    found = rows.coalesce(1).mapInArrow(_fitted, "share binary, bias double, a double, b double").collect()
    discard(rows)
    return Model(np.frombuffer(bytes(found[0]["share"]), np.float64), found[0]["bias"], found[0]["a"], found[0]["b"]) if found else None


def toxicity(model: Model | None, text: Column | str) -> Column:
    """Score of a text column, 0 to 1."""
    if model is None:
        return F.lit(0.0)
    # The model has a fixed size: BUCKETS numbers.
    shipped = SparkSession.active().sparkContext.broadcast(model)
    name = f"toxic-words:{zlib.crc32(model.share.tobytes())}"

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        cache: dict[str, float] = worker_state(name, dict)
        for batch in batches:
            out = np.empty(len(batch))
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                texts = [words_of(value) for value in batch.iloc[at : at + TEXTS_AT_ONCE]]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                found = [list(map(cache.get, words)) for words in texts]
                new = list({w for words, f in zip(texts, found, strict=True) if None in f for w, x in zip(words, f, strict=True) if x is None})
                if new:
                    cache.update(zip(new, own.word_shares(new).tolist(), strict=True))
                for k, (words, f) in enumerate(zip(texts, found, strict=True)):
                    shares = np.array(list(map(cache.__getitem__, words)) if None in f else f, dtype=np.float64)
                    out[at + k] = own.probability(own.logit(shares, np.array(counted_once(words), bool)))
            yield pd.Series(out)

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all their columns."""
    return docs.where(toxicity(train(docs, labels), docs["text"]) < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op10_toxicity": op10_toxicity}
