"""Gap tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACES, _col, normalize_ws, replace_each, strip

GAP = "<gap>"


def collapse_gaps(c: str | Column) -> Column:
    """Gaps side by side, or with a hyphen between, as one; a space around a gap, none beside its hyphens.

    A chain is a gap, all that follow it, and a hyphen at either end; what is left of it is a gap between its two ends.
    """
    chain = rf"(?U)\s*(?:-\s*)?{GAP}(?:\s*(?:-\s*)?{GAP})*(?:\s*-)?\s*"

    def one(match: Column) -> Column:
        bare = strip(match)
        end = lambda hyphen: F.when(hyphen, "-").otherwise(" ")
        return F.concat(end(F.startswith(bare, F.lit("-"))), F.lit(GAP), end(F.endswith(bare, F.lit("-"))))

    return F.trim(F.regexp_replace(replace_each(c, chain, one, gate=GAP), SPACES, " "))


def normalize_gaps(c: str | Column, dots: int = 3) -> Column:
    """Standalone x, ellipses of at least so many dots and bracketed gaps as the gap token; neighbours collapsed."""
    marked = F.regexp_replace(_col(c), r"(?i)\[\s*gap\s*\]|<\s*gap\s*>", GAP)
    marked = F.regexp_replace(marked, rf"\.{{{dots},}}|…+", f" {GAP} ")
    marked = F.regexp_replace(marked, r"(?iU)(?<![A-Za-z0-9])['’′]?x+['’′]?(?![A-Za-z0-9])", f" {GAP} ")
    return collapse_gaps(marked)


def count_gaps(c: str | Column) -> Column:
    return F.coalesce(F.regexp_count(_col(c), F.lit(GAP)), F.lit(0))


def repair_gaps(source: str | Column, target: str | Column) -> Column:
    """The target without the gaps it has beyond the source's, dropped from the right; none if the source has none."""
    n, parts = count_gaps(source), F.split(_col(target), GAP)
    kept = F.concat(F.array_join(F.slice(parts, 1, n + 1), GAP), F.array_join(F.slice(parts, n + 2, F.size(parts)), ""))
    return F.when((n > 0) & (F.size(parts) - 1 > n), kept).otherwise(_col(target))


def fold_angles(c: str | Column) -> Column:
    """<x> as (x), but gaps, in any case, as the gap token."""
    gaps = F.regexp_replace(_col(c), r"(?i)<\s*gap\s*>", GAP)
    return F.regexp_replace(gaps, r"<(?!gap>)\s*([^<>]+?)\s*>", "($1)")


def gap_share(c: str | Column) -> Column:
    """Share of the words that are gaps."""
    return count_gaps(c) / F.greatest(F.size(F.split(normalize_ws(c), " ")), F.lit(1))
