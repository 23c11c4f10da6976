"""Rounds of predictions over what is still pending. A predictor is any function from a batch of rows to results.

Each round is one mapInPandas over the pending rows, written to the shared folder, so a lost executor repeats no more than
its own part of a round. What is done leaves by an anti join; counters are columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize


class Predictor(Protocol):
    """texts and the number of the round to answers, in order."""

    def __call__(self, texts: list[str], turn: int) -> list[str]: ...


def predict(df: DataFrame, predictor: Predictor, text: str, id_col: str, turn: int = 0, out: str = "answer") -> DataFrame:
    """id and the predictor's answer of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], out: predictor([t or "" for t in pdf[text]], turn)})

    schema = df.select(id_col).withColumn(out, F.lit("")).schema
    return df.select(id_col, text).mapInPandas(run, schema)


class Busy(Exception):
    """A remote predictor is over its limit and may be asked again."""


#: Seconds to wait before each further try of a busy predictor.
WAITS = (16.0, 32.0)


def sampled(df: DataFrame, predictor: Callable[[list[str], int, int], list[list[str]]], text: str, id_col: str, samples: int = 1, turn: int = 0, batch: int = 64, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """id_col, responses: `samples` answers of each row, an array in the order in which they came.

    The predictor takes texts, the number of answers and the number of the round, and returns a list for each text. It may
    work on many at once: answers are matched to rows by place. Busy waits and asks again, once for each of the waits, then
    fails the task, which the engine repeats.
    """

    def ask(texts: list[str]) -> list[list[str]]:
        for wait in (*waits, None):
            try:
                answers = predictor(texts, samples, turn)
                break
            except Busy:
                if wait is None:
                    raise
                sleep(wait)
        if len(answers) != len(texts) or any(len(a) != samples for a in answers):
            raise ValueError(f"the predictor gave {[len(a) for a in answers]} answers for {len(texts)} texts, {samples} each were asked for")
        return answers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                answers = ask([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.list_(pa.string()))], names=[id_col, "responses"])

    schema = df.select(id_col).withColumn("responses", F.array(F.lit(""))).schema
    return df.select(id_col, text).mapInArrow(run, schema)


def until_accepted(df: DataFrame, predictor: Predictor, text: str, id_col: str, accept: Column, rounds: int, out: str = "answer") -> DataFrame:
    """id, answer, tries, accepted. Rows are asked again until `accept` (over text and answer) holds, at most `rounds` times.

    The last answer stands, accepted or not.
    """
    pending, done = df.select(id_col, text), None
    for turn in range(rounds):
        asked = materialize(
            pending.join(predict(pending, predictor, text, id_col, turn, out), id_col).withColumn("accepted", F.coalesce(accept, F.lit(False))).withColumn("tries", F.lit(turn + 1)), f"round{turn}"
        )
        over = asked if turn == rounds - 1 else asked.where("accepted")
        done = over if done is None else done.unionByName(over)
        if turn == rounds - 1:
            break
        pending = asked.where("NOT accepted").select(id_col, text)
        if pending.isEmpty():
            break
    return done.select(id_col, out, "tries", "accepted")


def until_found(volumes: DataFrame, targets: DataFrame, scan: Callable[[DataFrame, int], DataFrame], key: str, target: str, passes: int) -> DataFrame:
    """Detections of all passes, one of each target, from the first pass that saw it.

    Volumes with missing targets are scanned again, up to `passes` times. A null volume or target equals another null.
    """
    same = lambda cols: reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])
    keys = lambda df, cols: df.select(*[F.col(c).alias(f"__{c}") for c in cols]).distinct()
    found = None
    for turn in range(passes):
        new = scan(volumes, turn)
        if found is not None:
            new = new.join(keys(found, [key, target]), same([key, target]), "left_anti")
        new = materialize(new.dropDuplicates([key, target]), f"scan{turn}")
        found = new if found is None else found.unionByName(new)
        missing = targets.join(keys(found, [key, target]), same([key, target]), "left_anti")
        volumes = materialize(volumes.join(keys(missing, [key]), same([key]), "left_semi"), f"volumes{turn}")
        if volumes.isEmpty():
            break
    return found


def revise_flagged(rows: DataFrame, predictor: Predictor, text: str, id_col: str, flags: Column, rounds: int, out: str = "answer") -> DataFrame:
    """rows (id, text, answer): those whose answer raises flags are asked again; a new answer replaces the old, better or not."""
    for turn in range(rounds):
        flagged = materialize(rows.where(flags != ""), f"flagged{turn}")
        if flagged.isEmpty():
            break
        fresh = predict(flagged, predictor, text, id_col, turn + 1, "__new")
        rows = materialize(rows.join(fresh, id_col, "left").withColumn(out, F.coalesce("__new", out)).drop("__new"), f"revised{turn}")
    return rows


def append_stream(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A streaming query that appends each micro-batch, transformed, to a Parquet table."""

    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
