"""Best-fit packing of tokenized documents, certified by dual-feasible lower bounds.

Pieces are dealt to packs of PACK pieces by a hash of their row number, so that repeated ids spread. Each pack is packed
best-fit decreasing and gets a lower bound: the largest of the volume bound, the bounds of the thresholded dual-feasible
functions and of the rounding ones, over all thresholds. A pack that meets its bound is final but for its emptiest sequence.
A pack with a gap gives up all its sequences with room. What was given up is dealt anew to fewer and wider packs, so that packs
exchange documents, and packed again. The new packing of what was given up holds if it needs fewer sequences than the
old one, else the old one does and the exchange ends; it ends too when a single pack has held all that was left, or when the
sequences in all are as few as the lower bound of the whole table, which comes from one count of the lengths.

Certificates: pack_bins and pack_bound are the sequences and the bound of the group in which a piece was last packed and
whose other sequences it did not leave (what a pack kept and what it gave up are two groups); n_sequences and lower_bound
are those of the whole table.

Cases: a null text is empty and packs as the single end token; only documents longer than a sequence are cut; equal rows
are packed as separate documents; null ids and ids of any size pass unchanged, they never leave Arrow; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import materialize, read, worker_state

MAX_TOKENS = 4096
END_ID = 1
PACK = 200_000
#: Packs of what was given up hold that many times as many pieces.
WIDER = 4
#: Words kept with their ids in each Python worker; about 200 bytes each. Beyond that all are dropped and met anew.
CACHE_WORDS = 900_000
#: Texts whose new words are encoded in one call.
TEXTS_AT_ONCE = 64


class WordTokens:
    """A tokenizer that encodes what white space separates on its own, with the ids of words it has met."""

    def __init__(self, vocabulary: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.limit = limit
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.ends[ends] = True
        self.marks = {ord(c): self._ids(c).tobytes() for c in ".,"}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, words: list[bytes]) -> None:
        """Words of letters only are one piece each, whose last id marks its end: they are encoded together.

        A point or comma at a word's end, after an ASCII letter or digit, is a piece of its own.
        """
        plain, other, ended, seen = [], [], [], set()
        for w in words:
            core = w
            if w[-1] in self.marks and len(w) > 1 and (97 <= w[-2] <= 122 or 48 <= w[-2] <= 57):
                core = w[:-1]
                ended.append(w)
            if core not in self.known and core not in seen:
                seen.add(core)
                text = core.decode()
                (plain if text.isalpha() else other).append(text)
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):
                other += some
                continue
            data, low = ids.tobytes(), 0
            for text, high in zip(some, (4 * cut).tolist(), strict=True):
                self.known[text.encode()] = data[low:high]
                low = high
        for text, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[text.encode()] = np.array(e.ids, dtype="<u4").tobytes()
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.marks[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The texts' ids as little-endian unsigned 32-bit numbers.

        Special tokens are found before lower-casing: texts that may hold one are encoded whole.
        """
        raw = [(t or "").encode() for t in texts]
        special = [b"<|" in r for r in raw]
        words = [[] if s else r.lower().split() for r, s in zip(raw, special, strict=True)]
        if len(self.known) > self.limit:
            self.known.clear()
        found = [list(map(self.known.get, w)) for w in words]
        new = list({w for ws, fs in zip(words, found, strict=True) if None in fs for w, f in zip(ws, fs, strict=True) if f is None})
        if new:
            self.learn(new)
            known = self.known
            found = [[x if x is not None else known[w] for w, x in zip(ws, fs, strict=True)] if None in fs else fs for ws, fs in zip(words, found, strict=True)]
        return [self._ids(t or "").tobytes() if s else b"".join(f) for t, s, f in zip(texts, special, found, strict=True)]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most max_tokens: id, piece, start, length, ids_crc32 and, if asked for, ids (array of long)."""
    from pathlib import Path

    # The vocabulary file has a fixed size; sent by value, so that executors need no copy of it.
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        tokens = worker_state(f"tokens:{tokenizer_path}", lambda: WordTokens(vocabulary.value))
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * max_tokens
        for batch in batches:
            rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            texts = batch.column(1)
            encoded = (data for at in range(0, len(texts), TEXTS_AT_ONCE) for data in tokens.encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist()))
            for k, data in enumerate(encoded):
                data += end
                for n, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    rows.append(k)
                    pieces.append(n)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype("int64"))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)]]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Fewest sequences any packing needs, by dual-feasible functions. times: how often each size occurs, else once.

    For a threshold t up to half the capacity: sizes over capacity - t count as whole sequences, sizes under t as
    nothing, the rest as they are. For k: a size x of capacity 1 counts x if (k + 1) x is integral, else
    floor((k + 1) x) / k. The volume bound is the threshold 0.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    if times is not None:
        count = np.zeros(capacity + 1, np.int64)
        np.add.at(count, sizes, times)
    volume = count * np.arange(capacity + 1)
    many, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(volume)])
    t = np.arange(capacity // 2 + 1)
    large = many[-1] - many[capacity - t + 1]
    best = int(np.max(large + -(-(mass[capacity - t + 1] - mass[t]) // capacity)))
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 33):
        whole, rest = np.divmod((k + 1) * x, capacity)
        # In units of 1 / (k * capacity), to stay with whole numbers.
        value = np.where(rest == 0, k * x, whole * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """For each size its bin and offset there, and the number of bins. The open bins of each room are kept in stacks."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    has, bins, at, offset = 0, 0, [0] * len(sizes), [0] * len(sizes)
    for k in order:
        size = sizes[k]
        fit = has >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                has ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        at[k], offset[k] = b, capacity - room
        if left := room - size:
            rooms[left].append(b)
            has |= 1 << left
    return at, offset, bins


def _pack(capacity: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Adds sequence_id, offset, open (given up), pack_bins and pack_bound of the part that is kept or given up."""
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), -lengths))
        placed, places, bins = best_fit_decreasing(lengths[order].tolist(), capacity)
        at, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        at[order], offset[order] = placed, places
        fill = np.bincount(at, weights=lengths, minlength=bins).astype(np.int64)
        give = np.zeros(bins, dtype=bool)
        if bins > lower_bound(lengths, capacity):
            give = fill < capacity
        elif fill.min() < capacity:
            give[int(fill.argmin())] = True
        part = give[at]
        counts = np.array([bins - give.sum(), give.sum()])
        bounds = np.array([lower_bound(lengths[~part], capacity), lower_bound(lengths[part], capacity)])
        side = part.astype(np.int64)
        pack = table.column("pack")[0].as_py()
        columns = {"sequence_id": (level << 52) + (pack << 21) + at, "offset": offset, "open": part, "pack_bins": counts[side], "pack_bound": bounds[side]}
        for name, values in columns.items():
            table = table.append_column(name, pa.array(values))
        return table

    return run


def _lengths_bound(pieces: DataFrame, capacity: int) -> int:
    """Lower bound of the whole table; the driver gets one row for each length, capacity at most."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    return lower_bound(np.array([r["length"] for r in counts], dtype=np.int64), capacity, np.array([r["n"] for r in counts], dtype=np.int64)) if counts else 0


def pack_pieces(pieces: DataFrame, capacity: int = MAX_TOKENS, pack: int = PACK, id_col: str = "doc_id") -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32, row: a number of its own) with sequence_id, offset and the certificates.

    WIDER * pack is at most 2^20, so that a pack has less than 2^21 sequences.
    """
    left = pieces.withColumnRenamed(id_col, "id")
    fields = ("id", "piece", "start", "length", "ids_crc32", "row")
    placed = ("sequence_id", "offset", "pack_bins", "pack_bound")
    schema = T.StructType([*[left.schema[c] for c in fields], T.StructField("pack", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("pack_bins", T.LongType()), T.StructField("pack_bound", T.LongType())])
    done, total, before, count, level, kept_bins = [], _lengths_bound(pieces, capacity), None, pieces.count(), 0, 0
    while True:
        packs = max(1, -(-count // (WIDER * pack if level else pack)))
        dealt = left.select(*fields, F.pmod(F.xxhash64("row", F.lit(level)), F.lit(packs).cast("long")).alias("pack"))
        packed = materialize(dealt.groupBy("pack").applyInArrow(_pack(capacity, level), schema), f"packed-{level}")
        # One number for each group of a pack.
        sums = {r["open"]: (r["n"], r["bins"]) for r in packed.groupBy("open", "pack").agg(F.first("pack_bins").alias("b"), F.count(F.lit(1)).alias("m")).groupBy("open").agg(F.sum("m").alias("n"), F.sum("b").alias("bins")).collect()}
        (_, kept), (count, given) = sums.get(False, (0, 0)), sums.get(True, (0, 0))
        if before is not None and kept + given >= before:
            done.append(left.select(*fields, *placed))  # no gain: the old packing holds
            kept_bins += before
            break
        kept_bins += kept
        if not count or packs == 1 or kept_bins + given <= total:
            done.append(packed.select(*fields, *placed))
            kept_bins += given
            break
        done.append(packed.where("NOT open").select(*fields, *placed))
        left, before, level = packed.where("open").select(*fields, *placed), given, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *placed, F.lit(kept_bins).cast("long").alias("n_sequences"), F.lit(total).cast("long").alias("lower_bound"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack documents."""
    pieces = tokenized_pieces(docs, tokenizer_path or default_tokenizer()).withColumn("row", F.monotonically_increasing_id())
    return pack_pieces(materialize(pieces, "pieces"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
