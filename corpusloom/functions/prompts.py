"""Prompts: examples, retry suffixes and instructions by volume, and routing by tables of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, normalize_ws
from corpusloom.session import maybe_broadcast


def examples_block(examples: str | Column, source: str = "source", target: str = "target") -> Column:
    """Numbered examples, one below the other, of an array of structs; "" for none."""
    block = lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), e[source], F.lit("\n=> "), e[target])
    return F.coalesce(F.array_join(F.transform(_col(examples), block), "\n\n"), F.lit(""))


def rendered(template: str, parts: dict[str, Column]) -> Column:
    """The template with each {name} replaced, in one pass, so that braces inside a part stay as they are."""
    out, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, closed, tail = after.partition("}")
        if closed and name in parts:
            out += [F.lit(before), F.coalesce(parts[name], F.lit(""))]
            rest = tail
        else:
            out.append(F.lit(before + "{"))
            rest = after
    return F.concat(*out, F.lit(rest))


def prompt(template: str, text: str | Column, *, language: str | Column | None = None, examples: str | Column | None = None, instruction: str | Column | None = None, tries: str | Column | None = None, retry: str = "") -> Column:
    """A prompt: the template's {text}, {language} and {examples}, the instruction below it, and from the second try on the retry suffix."""
    parts = {"text": normalize_ws(text), "language": _col(language) if language is not None else F.lit(""), "examples": examples_block(examples) if examples is not None else F.lit("")}
    extra = F.when(F.coalesce(_col(instruction), F.lit("")) != "", F.concat(F.lit("\n"), _col(instruction))).otherwise("") if instruction is not None else F.lit("")
    again = F.when(_col(tries) > 0, F.lit(retry)).otherwise("") if tries is not None else F.lit("")
    return F.concat(rendered(template, parts), extra, again)


def routed(df: DataFrame, keys: Sequence[str], routes: DataFrame, key: str, value: str, default: str | None = None, skip: bool = False) -> DataFrame:
    """df with the value of the first of its key columns that the routes have, else the default. skip: rows without one go.

    routes: one row for each key. They are broadcast only if they are few.
    """
    out = df
    for k, col in enumerate(keys):
        table = maybe_broadcast(routes.select(F.col(key).alias(f"__k{k}"), F.col(value).alias(f"__v{k}")))
        out = out.join(table, F.col(col) == F.col(f"__k{k}"), "left").drop(f"__k{k}")
    found = F.coalesce(*[F.col(f"__v{k}") for k in range(len(keys))], F.lit(default).cast("string"))
    out = out.withColumn(value, found).drop(*[f"__v{k}" for k in range(len(keys))])
    return out.where(F.col(value).isNotNull()) if skip else out
