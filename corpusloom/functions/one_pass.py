"""The two document-level cleaners over one text, in plain Python: what cleaners.py says in columns, for texts of Latin letters.

Some seventy regular expressions a text cost the JVM about 10 microseconds a character. Here a note, a gap or a fraction is looked
for only where its first letters stand, and steps without their sign in the text are left out. Texts with other characters
than EASY has stay with the columns, so that white space, cases and word boundaries mean the same in both engines.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable

from corpusloom.functions import cleaners as C
from corpusloom.functions import numbers as N
from corpusloom.functions import profiles as P
from corpusloom.functions.text import FRACTION_GLYPHS

#: Texts of these characters only: ASCII, Latin letters but for dotless and dotted i, long s and capital sharp s, common marks.
EASY = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿĀ-įĲ-ňŊ-žḀ-ẕẠ-ỿ‘’“”„«»–—…]*")

GAP = "<gap>"
#: A word's character for (?U)\b: letters, digits and the low line, but no raised, lowered or fraction characters.
_W = r"[^\W²³¹¼-¾⁰⁴-⁹₀-₉⅐-⅟]"
_B = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _table(pairs: Iterable[tuple[str, str]]) -> tuple[re.Pattern, dict[int, str]]:
    """Characters and what they become, the first of a character counts; and a pattern that finds one."""
    out: dict[int, str] = {}
    for x, to in pairs:
        out.setdefault(ord(x), to)
    return re.compile("[" + "".join(re.escape(chr(x)) for x in out) + "]"), out


def _translate(t: str, table: tuple[re.Pattern, dict[int, str]]) -> str:
    """As str.translate, which looks up each character; here most are passed over."""
    return table[0].sub(lambda m: table[1][ord(m[0])], t)


def _flat(t: str) -> str:
    return " ".join(t.split()) if "  " in t or "\n" in t or "\t" in t or "\r" in t else t.strip()


def _tidy(t: str) -> str:
    t = _flat(t)
    for mark in (" ,", " .", " ;", " :", " !", " ?"):
        if mark in t:
            t = t.replace(mark, mark[1])
    return t


def _squeeze(t: str) -> str:
    return (re.sub(r"\s{2,}", " ", t) if "  " in t else t).strip()


def _triggers(begins: Iterable[str]) -> re.Pattern:
    """A pattern for any of the beginnings in lower case, as a choice of first characters, which the engine finds fastest."""
    rest: dict[str, list[str]] = defaultdict(list)
    for b in begins:
        raised = b.startswith(C._SPELLINGS["ü"])
        for first in "üu" if raised else b[0]:
            rest[first].append("e?" + b[len(C._SPELLINGS["ü"]) :] if raised else b[1:])
    return re.compile("|".join(f"{re.escape(ch)}(?:{'|'.join(dict.fromkeys(x))})" for ch, x in rest.items()))


def _notes(phrases: Iterable[str], first: list[str], begins: list[str]) -> Callable[[str], str]:
    """Notes as a space each: the columns' pattern, tried where a phrase or one of `begins` begins."""
    whole = re.compile(C.note_pattern(phrases, first).replace(r"\b", _B))
    trigger = _triggers([C.phrase(p[:6].rstrip()) for p in phrases] + begins)

    def run(t: str) -> str:
        out, kept, at, low = [], 0, 0, t.lower()
        while hit := trigger.search(low, at):
            at = begin = hit.start()
            while begin > kept and t[begin - 1].isspace():
                begin -= 1
            if begin > kept and t[begin - 1] == "(":
                begin -= 1
            found = whole.match(t, begin) or whole.match(t, at)
            if found:
                out += [t[kept : found.start()], " "]
                kept = at = found.end()
            else:
                at += 1
        return "".join([*out, t[kept:]]) if out else t

    return run


_SIDE_BEGINS = [*(rf"{sign[0].lower()}[\s.]*{sign[1]}" for sign in C.SIDE_SIGNS), r"k\.\s*1", *"0123456789", r"ca\.?\s*[0-9]"]
_COUNTED = [rf"\(?\s*{C.counted(*n)}{'' if n[0].endswith('.') else '[.]?'}\s*\)?" for n in C.COUNTED_NOTES]
_translation_notes = _notes(C.TRANSLATION_NOTES, C._sides() + _COUNTED, _SIDE_BEGINS)
_transliteration_notes = _notes(C.TRANSLITERATION_NOTES, [C._edges()], [r"ob", r"u\s*\.", r"l\s*\.", r"le\s*\.", r"ri\s*\.", r"rev"])
_document_notes = _notes(C.DOCUMENT_NOTES, [], [])


def _terminal() -> list[re.Pattern]:
    lines = f"(?:(?:{C.counted('zz.', True, False)}|{C.counted('z.', True, False)})\\s*)?"
    out = []
    for kind in C.TERMINAL_NOTES:
        notes = [lines + C.phrase(n[4:]) if n.startswith("{n} ") else C.counted(n[7:], False, True) if n.startswith("{span} ") else C.phrase(n) for n in kind]
        out.append(re.compile(rf"(?iu)\s+(?:{'|'.join(notes)})[.]?\s*\Z"))
    return out


_TERMINAL = _terminal()
#: What each of these notes may end with.
_TERMINAL_END = re.compile(r"(?i)(?:weitgehend|ganz|dann|resten?|kontext|s|von|spuren)[.]*\s*\Z")


def _terminal_notes(t: str) -> str:
    """White space is single here, so that a note is no longer than the window but for its numbers."""
    for pattern in _TERMINAL:
        if not _TERMINAL_END.search(t[-20:]):
            break
        if found := pattern.search(t, 0 if re.search("[0-9]{20}", t[-200:]) else max(0, len(t) - 200)):
            t = t[: found.start()]
    return _tidy(t)


def _sign(match: str) -> str:
    a, b = re.search(r"([0-9])[^0-9]+0*([0-9]+)$", match).groups()
    return N.FRACTIONS[int(a), int(b)]


_PLAIN, _ZEROS = N._fraction(N.FRACTIONS, "/", r"\s*", zeros=False), N._fraction(N.FRACTIONS, "/", r"\s*")
_NUMBER = re.compile("[0-9]+")
_MIXED_PLAIN = re.compile(rf"(?<![0-9/])[0-9]+\s+0*{_PLAIN}")
_GLUED = re.compile(rf"(?<![0-9/])[0-9]+{_PLAIN}")
_MIXED = re.compile(rf"(?<![0-9])[0-9]+\s+0*{_ZEROS}")
_SIMPLE = re.compile(rf"(?<![0-9])0*{_ZEROS}")


def _at_slashes(t: str, pattern: re.Pattern, change: Callable[[str], str], unless: re.Pattern | None = None) -> str:
    """pattern.sub for a pattern of numbers and white space up to a slash; unless: what may not stand before."""
    out, kept, slash = [], 0, t.find("/")
    while slash >= 0:
        at = slash
        while at > kept and t[at - 1] in "0123456789 \t\n\r":
            at -= 1
        while number := _NUMBER.search(t, at, slash):
            at = number.end()
            found = pattern.match(t, number.start())
            if found and not (unless and unless.search(t[max(0, found.start() - 25) : found.start()])):
                out += [t[kept : found.start()], change(found[0])]
                kept = found.end()
                break
        slash = t.find("/", max(kept, slash + 1))
    return "".join([*out, t[kept:]]) if out else t


def _mixed(match: str) -> str:
    return f"{_NUMBER.match(match)[0]} {_sign(match)}"


def _glued(match: str) -> str:
    return f"{re.match(r'([0-9]+)[0-9]\s*/', match)[1]} {_sign(match)}"


def _glued_fractions(t: str) -> str:
    t = _at_slashes(_at_slashes(t, _MIXED_PLAIN, _mixed), _GLUED, _glued)
    return _at_slashes(_at_slashes(t, _MIXED, _mixed), _SIMPLE, _sign)


_SPACED = re.compile(rf"(?=[0-9]+\s+/)(?<![0-9])0*{N._fraction(N.FRACTIONS, '/', r'\s+')}")
_MONTH = re.compile(r"(?i)month\s{1,20}\Z")


def _spaced_fractions(t: str) -> str:
    return _at_slashes(t, _SPACED, _sign, _MONTH)


def _decimal(m: re.Match) -> str:
    token = m[0]
    x = float(token)
    if math.isinf(x):
        return token
    part = x - math.floor(x)
    sign = "⅓" if 0.25 < part <= 0.35 else "⅔" if 0.55 <= part < 0.65 else None
    for glyph, near in (*N.DECIMALS, ("⅔", 2 / 3), ("⅓", 1 / 3)):
        sign = sign or (glyph if abs(part - near) <= 1e-3 else None)
    return token if sign is None else sign if math.floor(x) == 0 else f"{math.floor(x)} {sign}"


_DECIMAL = re.compile(rf"[0-9](?<!{_W}[0-9])[0-9]*\.[0-9]+(?!{_W})")
_ROMANS = {N._roman(n): str(n) for n in range(2, 13)}
_ROMAN = re.compile(rf"[IVX](?<!{_W}[IVX])[IVX]*(?:th)?(?!{_W})")
_TWELFTH, _UNIT = r"\s*/\s*12", rf"\s*shekels?{_B}"
_SHEKELS = [(re.compile((rf"{whole}\s+" if whole else "") + f"{n}{_TWELFTH}{_UNIT}"), wording) for whole, n, wording in N.SHEKELS]
_LONE_TWELFTH = re.compile(f"1{_TWELFTH}(?!{_UNIT})")


def _shekels(t: str) -> str:
    if "/" in t and re.search(_TWELFTH, t):
        for pattern, wording in _SHEKELS:
            t = pattern.sub(wording, t)
        t = _LONE_TWELFTH.sub(N.SHEKELS[1][2], t)
    return t


_NAMES = [x for w in P.PERSON_WORDS for x in {w, w.lower(), w.title(), w[0].lower() + w[1:].upper()}]
_PERSONS = re.compile(rf"(?<!\w)(?:{'|'.join(_NAMES)})(?:\s*[{P.DIGITS}]+)?(?!\w)")
_GRAMMAR_WORD = re.compile("|".join(f"{ch}(?<![A-Za-z]{ch})(?i:{w[1:]})(?![A-Za-z])" for w in P.GRAMMAR_WORDS for ch in (w[0], w[0].upper())))
_GRAMMAR = re.compile(rf"(?i)\(?\s*(?<![A-Za-z]){P._any_of(P.GRAMMAR_WORDS)}\.?\s*\)?\.?(?![A-Za-z])")
_MAIN_TARGET = _table([(x, to) for to, group in P.MAIN_TARGET.items() if to for x in group] + [(x, "") for x in P.MAIN_TARGET[""]])


def _tight(t: str) -> str:
    return re.sub(r"\s+([,.])", r"\1", t) if " ," in t or " ." in t else t


def _main_translation(t: str) -> str:
    """The main profile of translations; all white space is spaces here."""
    for old, new in P.MISREAD:
        t = t.replace(old, new)
    low = t.lower()
    if "youplur" in low:
        t = re.sub(r"(?i)(?<!\w)youplur(?:\.(?!\w)|(?!\w))", "you", t)
    for part, whole, before in P.LOST_TEXTILES:
        if part in t:
            t = re.sub(rf"(?<!{before}){part}(?!\w)", whole, t)
    if "<<" in t:
        t = re.sub("<<[^<>]+>>", lambda m: m[0][2:-2].strip(), t)
    if any(n in t for n in _NAMES):
        t = _PERSONS.sub(GAP, t)
    if "?" in t:
        t = re.sub(r"\(\s*\?\s*\)", "", t)
    if '""' in t:
        t = re.sub(r'""\s*\Z', "", t)
    t = _tight(t)
    if _GRAMMAR_WORD.search(t):
        t = _GRAMMAR.sub(" ", t)
    t = _squeeze(_tight(t.replace("(", "").replace(")", "")))
    if "." in t:
        t = _DECIMAL.sub(_decimal, t)
    t = _ROMAN.sub(lambda m: _ROMANS.get(m[0].removesuffix("th"), m[0]), t)
    t = _spaced_fractions(_shekels(t))
    return _squeeze(_translate(t.replace("ß", "ss").replace("ẞ", "ss").replace("β", "ss"), _MAIN_TARGET))


_CHAIN = re.compile(rf"\s*(?:-\s*)?{GAP}(?:\s*(?:-\s*)?{GAP})*(?:\s*-)?\s*")


def _collapse_gaps(t: str) -> str:
    out, kept, at = [], 0, t.find(GAP)
    while at >= 0:
        begin = at
        while begin > kept and t[begin - 1].isspace():
            begin -= 1
        if begin > kept and t[begin - 1] == "-":
            begin -= 1
            while begin > kept and t[begin - 1].isspace():
                begin -= 1
        found = _CHAIN.match(t, begin)
        bare = found[0].strip()
        out += [t[kept:begin], "-" if bare[0] == "-" else " ", GAP, "-" if bare[-1] == "-" else " "]
        kept = found.end()
        at = t.find(GAP, kept)
    return _flat("".join([*out, t[kept:]]))


_SCRIPTS = {kind: C._script_table(kind) for kind in ("sup", "sub")}
_TAG = re.compile(r"(?i)<\s*/?\s*su[pb]")


def _tags(t: str) -> str:
    return C._scripts(t, _SCRIPTS) if "<" in t and _TAG.search(t) else t


def _dots(t: str) -> str:
    return re.sub(r"\.\.+|……*", f" {GAP} ", t) if ".." in t or "…" in t else t


_QUOTES = _table([*((x, "'") for x in C.APOSTROPHES), *((x, '"') for x in C.DOUBLE_QUOTES), *((x, "") for x in "˺˹˫˪")])
_RAISED = _table((x, "") for x in "ᵖˡʳᵘʼ")
_DIGITS = _table(zip(C.SUPERSCRIPT_DIGITS + C.SUBSCRIPT_DIGITS, "0123456789" * 2, strict=True))
_X = re.compile("x(?<![A-Za-z]x)x*(?![A-Za-z])")
_GLYPH = re.compile(f"[{FRACTION_GLYPHS}]")


def unmarked(t: str, own: bool) -> str | None:
    """A text that `translation` leaves to the columns, its quotes folded, without line markers."""
    return C.without_line_markers(_translate(t, _QUOTES)) if own or not EASY.fullmatch(t) else None


def translation(t: str, own: bool) -> str | None:
    """cleaners.cleaned_translation of one text; null if it is not of EASY or, own, its volume has notes of its own."""
    if own or not EASY.fullmatch(t):
        return None
    t = _tidy(C.without_line_markers(_translate(t, _QUOTES)))
    t = _tags(_tidy(_translation_notes(t)))
    t = _translate(t.replace("[", "").replace("]", ""), _RAISED)
    t = _glued_fractions(_translate(_X.sub(GAP, t), _DIGITS))
    t = _tidy(_translation_notes(_main_translation(t)))
    t = _squeeze(_GLYPH.sub(r" \g<0> ", _collapse_gaps(_dots(t))))
    t = _terminal_notes(t).replace("*", "")
    if "/" in t or "⁄" in t:
        t = re.sub(r"\s*[/⁄]\s*", " / ", t)
    return _tidy(t)


_SOURCE = _table([*((x, "'") for x in C.APOSTROPHES[:2]), *((x, "") for x in "‚‛"), ("ʀ", "r"), *((x, "") for x in C.SOURCE_MARKS)])
# Texts of EASY have superscripts only where tags made them.
_SUPERSCRIPTS = _table((x, "") for x in sorted(set(C.superscript_letters()) & {x for table in _SCRIPTS.values() for x in table.values()}))
_LOOSE = _table((x, "") for x in "[]<>?/⁄*'")
_ANY_X = re.compile("[xX]+")
_LONE_X = re.compile("(?i)(?<![A-Za-z0-9])['’′]?x+['’′]?(?![A-Za-z0-9])")


def _lone_x(t: str) -> str:
    out, kept, at = [], 0, 0
    while hit := _ANY_X.search(t, at):
        begin = hit.start()
        found = (_LONE_X.match(t, begin - 1) if begin > kept else None) or _LONE_X.match(t, begin)
        if found:
            out += [t[kept : found.start()], f" {GAP} "]
            kept = at = found.end()
        else:
            at = hit.end()
    return "".join([*out, t[kept:]])


def transliteration(t: str, full: bool) -> str | None:
    """cleaners.cleaned_transliteration of one text; full: of a listed volume. Null if it is not of EASY."""
    if not EASY.fullmatch(t):
        return None
    t = _tidy(_document_notes(_transliteration_notes(_translate(t, _SOURCE))))
    if not full:
        return t
    t = _glued_fractions(_tags(t)).replace("ᵈ", "{d}")
    t = _translate(re.sub("ᵏ[ⁱᶦ]", "{ki}", t), _SUPERSCRIPTS)
    return _collapse_gaps(_lone_x(_dots(_translate(t, _LOOSE))))
