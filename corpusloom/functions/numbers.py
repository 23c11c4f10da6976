"""Numbers in texts: decimals, fractions, Roman numerals, leading zeros, budgets.

Replacements that depend on the match look it up in a table, one pass over a text for all values of the table.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, bind, look_up, replace_each

# Fractions and their characters.
FRACTIONS = {
    (1, 2): "½", (1, 3): "⅓", (2, 3): "⅔", (1, 4): "¼", (3, 4): "¾", (1, 5): "⅕", (2, 5): "⅖", (3, 5): "⅗", (4, 5): "⅘",
    (1, 6): "⅙", (5, 6): "⅚", (1, 8): "⅛", (3, 8): "⅜", (5, 8): "⅝", (7, 8): "⅞",
}
TENTH = {(1, 10): "⅒"}
# Decimals near these values, to a thousandth, become the character; thirds are found by one decimal place.
DECIMALS = (("¼", 0.25), ("½", 0.5), ("⅙", 1 / 6), ("¾", 0.75), ("⅚", 5 / 6))
# Wordings of twelfths of a shekel in grains: whole shekels before, twelfths, wording.
SHEKELS = ((5, 11, "6 shekels less 15 grains"), (None, 1, "15 grains"), (None, 7, "½ shekel 15 grains"), (None, 5, "⅓ shekel 15 grains"))
#: White space of any script.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def decimal_fractions(c: str | Column) -> Column:
    """Decimals as whole number and fraction character where one fits, else as they stand.

    With f the fractional part: a third for 0.25 < f <= 0.35, two thirds for 0.55 <= f < 0.65, as one decimal place says;
    0.25 itself is nearer a quarter. The rest within a thousandth of a value.
    """
    number = r"(?=[0-9])(?U:\b)[0-9]+\.[0-9]+(?U:\b)"

    def value(x: Column, token: Column) -> Column:
        whole, part = F.floor(x), x - F.floor(x)
        found = F.when((part > 0.25) & (part <= 0.35), "⅓").when((part >= 0.55) & (part < 0.65), "⅔")
        for sign, near in DECIMALS:
            found = found.when(F.abs(part - near) <= 1e-3, sign)
        found = found.when(F.abs(part - 2 / 3) <= 1e-3, "⅔").when(F.abs(part - 1 / 3) <= 1e-3, "⅓")
        return bind(found, lambda f: F.when(f.isNull(), token).when(whole == 0, f).otherwise(F.concat(whole.cast("string"), F.lit(" "), f)))

    def glyph(token: Column) -> Column:
        return bind(token.cast("double"), lambda x: value(x, token))

    return replace_each(c, number, glyph, gate=".")


def roman_numerals(c: str | Column, most: int = 12) -> Column:
    """II to `most` as numbers, with or without "th"; I stays."""
    table = {_roman(n): str(n) for n in range(2, most + 1)}
    # The look-ahead comes first: word boundaries of any script cost more and are then rarely tried.
    return replace_each(c, r"(?=[IVX])(?U:\b)[IVX]+(?:th)?(?U:\b)", lambda sign: F.coalesce(look_up(table, F.regexp_replace(sign, "th$", "")), sign))


def _fraction(table: dict, signs: str, space: str, zeros: bool = True) -> str:
    """A pattern for the table's fractions, by numerators; signs: what may stand between the numbers."""
    below: dict[int, list[int]] = defaultdict(list)
    for a, b in sorted(table):
        below[a].append(b)
    zero = "0*" if zeros else ""
    return "(?:" + "|".join(f"{a}{space}[{signs}]{space}{zero}(?:{'|'.join(map(str, b))})" for a, b in below.items()) + ")(?![0-9])"


def _sign(match: Column, table: dict) -> Column:
    """The character of the fraction at the match's end; a numerator of one digit counts, whatever digits stand before."""
    parts = F.split(F.regexp_extract(match, r"([0-9]\P{Nd}+[0-9]+)$", 1), r"\P{Nd}+0*")
    return look_up({f"{a}/{b}": sign for (a, b), sign in table.items()}, F.concat_ws("/", parts))


def spaced_fractions(c: str | Column) -> Column:
    """a / b with spaces on both sides as a character, but not after "month "."""
    gap = rf"{_SPACE}+"
    ahead = rf"(?=[0-9]+{gap}/)"
    month = rf"(?<!(?i:month){_SPACE}{{1,20}})"
    return replace_each(c, rf"{ahead}(?<![0-9]){month}0*{_fraction(FRACTIONS, '/', gap)}", lambda m: _sign(m, FRACTIONS), gate="/")


def compact_fractions(c: str | Column, mixed_space: str = " ", signs: str = "/", table: dict | None = None) -> Column:
    """a/b as a character, spaces or not; after a whole number mixed_space comes between."""
    table = table or FRACTIONS
    simple = rf"0*{_fraction(table, signs, chr(92) + 's*')}"
    gate = signs if len(signs) == 1 else None
    mixed = replace_each(c, rf"(?=[0-9])(?<![0-9])[0-9]+\s+{simple}", lambda m: F.concat(_whole(m, r"\s"), F.lit(mixed_space), _sign(m, table)), gate)
    return replace_each(mixed, rf"(?=[0-9])(?<![0-9]){simple}", lambda m: _sign(m, table), gate)


def _whole(match: Column, end: str) -> Column:
    """The match's first number, up to what the pattern says."""
    return F.regexp_extract(match, f"^([0-9]+){end}", 1)


def glued_fractions(c: str | Column) -> Column:
    """Mixed, then glued mixed (11/2 is 1 1/2), then simple fractions."""
    fraction = _fraction(FRACTIONS, "/", r"\s*", zeros=False)
    mixed = replace_each(c, rf"(?=[0-9])(?<![0-9/])[0-9]+\s+0*{fraction}", lambda m: F.concat(_whole(m, r"\s"), F.lit(" "), _sign(m, FRACTIONS)), "/")
    glued = replace_each(mixed, rf"(?=[0-9])(?<![0-9/])[0-9]+{fraction}", lambda m: F.concat(_whole(m, r"[0-9]\s*/"), F.lit(" "), _sign(m, FRACTIONS)), "/")
    return compact_fractions(glued)


def shekel_fractions(c: str | Column) -> Column:
    """Twelfths of a shekel in grains; a lone twelfth too."""
    unit, twelfth = rf"{_SPACE}*shekels?(?U:\b)", rf"{_SPACE}*/{_SPACE}*12"

    def chain(t: Column) -> Column:
        out = t
        for whole, n, wording in SHEKELS:
            before = f"{whole}{_SPACE}+" if whole else ""
            out = F.regexp_replace(out, f"{before}{n}{twelfth}{unit}", wording)
        return F.when(F.contains(t, F.lit("/")) & t.rlike(twelfth), F.regexp_replace(out, f"1{twelfth}(?!{unit})", SHEKELS[1][2])).otherwise(t)

    return bind(_col(c), chain)


def leading_zeros(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"(?<![0-9])0+([0-9]+)", "$1")


def generation_budget(c: str | Column, cap: int = 512, ratio: float = 1.7) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(1), F.ceil(F.length(_col(c)) * F.lit(ratio)))).cast("int")


def confidence(logprobs: str | Column) -> Column:
    """exp of the mean log probability; 1 for none."""
    v = _col(logprobs)
    return F.exp(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(v), F.lit(1)))


def span_lengths(tokens: int, density: float = 0.15, span: float = 3.0) -> tuple[int, int]:
    """Longest raw length whose corrupted input has at most `tokens` tokens, and the length of its target."""

    def lengths(n: int) -> tuple[int, int]:
        noise = round(n * density)
        spans = max(1, round(noise / span))
        return n - noise + spans + 1, noise + spans + 1

    n = tokens
    while lengths(n + 1)[0] <= tokens:
        n += 1
    return n, lengths(n)[1]


def span_masks(df: DataFrame, length: str, seed: int = 0, density: float = 0.15, span: float = 3.0, name: str = "mask") -> DataFrame:
    """df with the mask of a row of that many tokens, as an array; the seed of a row is its own, from the columns' values."""

    @F.pandas_udf("array<boolean>")
    def masks(lengths: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([span_mask(int(n), int(s), density, span) for n, s in zip(lengths, seeds, strict=True)])

    own = F.pmod(F.xxhash64(*sorted(df.columns), F.lit(seed)), F.lit(2**31))
    return df.withColumn(name, masks(F.coalesce(F.col(length), F.lit(0)), own))


def span_mask(length: int, seed: int, density: float = 0.15, span: float = 3.0) -> list[bool]:
    """Which of a row's tokens are noise: spans and gaps of random lengths in turn, beginning with a gap."""
    import numpy as np

    noise = min(max(round(length * density), 1), length - 1) if length > 1 else 0
    if not noise:
        return [False] * length
    spans = min(max(round(noise / span), 1), noise, length - noise)
    rng = np.random.default_rng(seed)
    cut = lambda n: np.diff([0, *sorted(rng.choice(np.arange(1, n), spans - 1, replace=False)), n])
    out: list[bool] = []
    for keep, drop in zip(cut(length - noise), cut(noise), strict=True):
        out += [False] * int(keep) + [True] * int(drop)
    return out
