"""How one document is read, in plain Python over normalised text: its lines, its facts, its sentences.

Every step is linear in the text: passes claim characters in one byte array, sentences are found by their ends.
The DataFrame side (atoms, segment) runs this inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from operator import itemgetter
from typing import NamedTuple

from fidelis.functions.exact import moved, narrowed, zh_value
from fidelis.functions.registry import HEADING, MONTHS, P_SIGNS, PASSES, QUOTED, REFERENCES, VARIABLE, Pass

_HEADING, _REFERENCES, _BAR = re.compile(HEADING), re.compile(REFERENCES), re.compile(r"\s*\|")
_VARIABLE = re.compile(VARIABLE)
_BREAK = re.compile(r"\n{2,}")
# one class first: places that can't begin a match are passed over quickly
_ENDS = re.compile(r"[。！？；!?;\n.](?:(?<!\.)|(?=[ \n]))")


_TAILS, _GAPS = re.compile("[ \t]+\n"), re.compile("\n{3,}")


def normal(text: str) -> str:
    """A text in its NFC form, with the lines and empty lines of text.normalized."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if " \n" in text or "\t\n" in text:
        text = _TAILS.sub("\n", text)
    if "\n\n\n" in text:
        text = _GAPS.sub("\n\n", text)
    return text.strip("\n") + "\n" if text else text


class Line(NamedTuple):
    """A line: where it starts, its kind (code, table, references, heading, prose), the number of its code block or
    table, a heading's level and title, its section (0 before the first heading), whether that is the references."""

    start: int
    text: str
    kind: str
    part: int | None
    level: int | None
    title: str | None
    sec: int
    refs: bool


#: Of tuples, without a call that binds names.
_line = partial(tuple.__new__, Line)


class _Kept(dict):
    """Values of a function of short texts, made when first asked for. When full, it begins anew with what is asked for
    again: texts that occur once don't drive out those that come back. Tasks start with none."""

    def __init__(self, of: Callable[[str], tuple], most: int):
        super().__init__()
        self.of, self.most, self.before = of, most, {}

    def __missing__(self, text: str) -> tuple:
        if len(text) > 400:
            return self.of(text)
        if 2 * len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self.before.get(text)
        if value is None:
            value = self.of(text)
        self[text] = value
        return value

    def __reduce__(self):
        return _Kept, (self.of, self.most)


def _read(line: str) -> tuple[bool, bool, int | None, str | None, bool]:
    """Of a line by itself: whether it is a fence, a table row; its level and title, if a heading, and if of references."""
    if line.lstrip().startswith("```"):
        return True, False, None, None, False
    if head := _HEADING.match(line):
        title = head[2].strip()
        return False, False, len(head[1]), title, bool(_REFERENCES.match(title))
    return False, bool(_BAR.match(line)), None, None, False


_LINES = _Kept(_read, 1 << 12)


def lines(text: str) -> list[Line]:
    """Fenced lines are neither headings nor tables, so frozen ranges never overlap."""
    out: list[Line] = []
    at = sec = fences = tables = 0
    refs, beside = -1, False
    for line in text.split("\n"):
        part = None
        fence, bar, level, title, cited = _LINES[line]
        fences += fence
        if fence or fences % 2:
            kind, part, level, title = "code", (fences + 1) // 2, None, None
        elif level:
            kind = "heading"
            sec += 1
            if refs < 0 and cited:
                refs = sec
        elif bar:
            tables += not beside
            kind, part = "table", tables
        else:
            kind = "references" if sec == refs else "prose"
        beside = kind == "table"
        out.append(_line((at, line, kind, part, level, title, sec, sec == refs)))
        at += len(line) + 1
    return out


def masked(parsed: Sequence[Line]) -> str:
    """All but prose blanked at equal length."""
    return "\n".join(x.text if x.kind == "prose" else " " * len(x.text) for x in parsed)


class Fact(NamedTuple):
    kind: str
    surface: str
    canonical: str
    start: int
    end: int


_fact, _start = partial(tuple.__new__, Fact), itemgetter(3)


def _year_month(year: str, month: int | str | None) -> str:
    return f"DATE({year})" if month in (None, "") else f"DATE({year}-{int(month):02d})"


def _years(m: re.Match) -> str:
    value = zh_value(m[2])
    if value is None and m[2].isdecimal():
        value = int(m[2])
    return f"PHRASE({m[0]})" if value is None else f"PHRASE({m[1]}{value}年)"


#: The canonical form of a match, by the form of its pass.
FORMS: dict[str, Callable[[re.Match], str]] = {
    "cites": lambda m: "CITES(%s)" % ",".join(map(str, sorted(int(x) for x in re.split("[,，]", m[1])))),
    "cite_ay": lambda m: f"CITE_AY({''.join(m[1].split()).lower()},{m[2]})",
    "sig": lambda m: f"SIG({moved(m[1], -2)})",
    "pct": lambda m: f"PCT({moved(m[1])})",
    "pct_share": lambda m: f"PCT({moved(m[1], 2)})",
    "amount": lambda m: ("USD" if m[3] == "美元" else "CNY") + f"({moved(m[1], {'万': 4, '亿': 8}.get(m[2], 0))})",
    "iso": lambda m: f"DATE({m[1]}-{m[2]}-{m[3]})",
    "range": lambda m: f"RANGE({m[1]},{m[2]})",
    "zh_date": lambda m: _year_month(m[1], m[2] if not m[2] or m[2].isdecimal() else zh_value(m[2])),
    "en_date": lambda m: _year_month(m[2], MONTHS.index(m[1]) + 1),
    "p": lambda m: f"P({P_SIGNS[narrowed(m[1])]},{moved(m[2])})",
    "p_is": lambda m: f"P(eq,{moved(m[1])})",
    "coef": lambda m: f"COEF({moved(m[1])})",
    "phrase": _years,
    "count": lambda m: f"COUNT({moved(m[1])})",
    "year": lambda m: f"DATE({m[1]})",
    "num": lambda m: f"NUM({moved(m[1])})",
    "term": lambda m: f"TERM({m[1]})",
}
#: Marks that end no address and no identifier.
_TRAILS = {"url": ".,;:、，。；", "doi": ".,;、，。；)"}


def _compiled(one: Pass) -> tuple[Pass, re.Pattern, Callable]:
    return one, re.compile(one.pattern), FORMS.get(one.form)


_PASSES, _QUOTED = [_compiled(p) for p in PASSES], _compiled(QUOTED)
#: Each pass with the characters one of which its matches hold, and whether they claim a digit: all but those of two do,
#: so where no digit is left unclaimed they are not sought.
_SOUGHT = [(p, frozenset(p[0].holds), p[0].form not in ("url", "phrase")) for p in _PASSES]
_DIGIT = re.compile(r"\d")


def _matches(text: str, one: Pass, pattern: re.Pattern, form) -> Iterator[tuple[Fact, int]]:
    """Facts of a pass in order, with the end of what each claims: trimmed surfaces are shorter than that."""
    if one.holds and not any(c in text for c in one.holds):
        return
    for m in pattern.finditer(text):
        start, end = m.span(one.claim)
        if form:
            yield Fact(one.kind, m[0], form(m), start, end), end
            continue
        surface = m[one.claim].rstrip(_TRAILS[one.form])
        name = f"DOI({surface.lower()})" if one.form == "doi" else f"URL({surface})"
        end = end if one.form == "doi" else start + len(surface)
        yield Fact(one.kind, surface, name, start, end), end


#: Where a text is cut: after 。 and ；, after ， , and after a full stop or comma with a blank, so that no match of a pass
#: or of a variable spans the cut or looks across it. What could: a list of cited numbers (a digit follows ，), thousands
#: (a digit or comma stands before the comma), dates such as "Mar. 2021" (a digit follows), names such as "A. Smith (2019)"
#: and "(A. Smith, 2019)", of 41 letters at most. Quoted terms may, and are sought in the whole text.
_CUT = re.compile(r"[。；，,.](?:(?<=[。；])|(?<=，)(?![\s\d])|(?<=[^0-9,],)[ \n](?=[^\s\d])|(?<=\.)[ \n](?=[^\s\d])(?![A-Za-z&.\- ]{0,40}(?:\s*[（(]|,\s*\d)))")


class _Piece(NamedTuple):
    """What passes find in a piece of text, as if it stood alone: facts, which characters they claim, variables' places."""

    facts: list[Fact]
    claimed: bytes
    words: list[tuple[str, int]]


def _claim(found: Iterator[tuple[Fact, int]], claimed: bytearray, out: list[Fact]) -> None:
    for fact, end in found:
        if end > fact.start and claimed.find(1, fact.start, end) < 0:
            claimed[fact.start : end] = b"\1" * (end - fact.start)
            out.append(fact)


def _piece(text: str) -> _Piece:
    claimed, out = bytearray(len(text)), []
    held = set(text)
    digits = [m.start() for m in _DIGIT.finditer(text)]
    for one, holds, numbered in _SOUGHT:
        if (numbered and not digits) or (holds and holds.isdisjoint(held)):
            continue
        found = len(out)
        _claim(_matches(text, *one), claimed, out)
        if len(out) > found:
            digits = [i for i in digits if not claimed[i]]
    out.sort(key=_start)
    return _Piece(out, bytes(claimed), [(m[0], m.start()) for m in _VARIABLE.finditer(text)])


#: An original and its revision share most pieces, and so do papers of one kind (about 30 MB).
_PIECES = _Kept(_piece, 1 << 14)


def _variables(places: dict[str, list[int]], claimed: bytearray) -> Iterator[tuple[Fact, int]]:
    """Variables that stand twice or more, at their first free place (never inside a longer word)."""
    for w, starts in places.items():
        if len(starts) > 1 and (start := next((x for x in starts if claimed.find(1, x, x + len(w)) < 0), None)) is not None:
            yield Fact("variable", w, f"VAR({w})", start, start + len(w)), start + len(w)


def _listed(text: str, kind: str, name: str, words: Sequence[str]) -> Iterator[tuple[Fact, int]]:
    """The first place of each word."""
    for w in words:
        if (start := text.find(w)) >= 0:
            yield Fact(kind, w, f"{name}({w})", start, start + len(w)), start + len(w)


def facts(text: str, glossary: Sequence[str | None] = (), every: bool = False) -> list[Fact]:
    """A masked text's distinct facts in order: passes in order of precedence, each match unless a character of it is
    claimed already; of facts of equal kind and form the first (every: all)."""
    out: list[Fact] = []
    masks: list[bytes] = []
    words: dict[str, list[int]] = {}
    at = 0
    for cut in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        piece = text[at:cut]
        if piece.isspace():
            masks.append(bytes(cut - at))
        elif piece:
            own = _PIECES[piece]
            held, mask, found = own
            out += [_fact((kind, surface, form, start + at, end + at)) for kind, surface, form, start, end in held]
            masks.append(mask)
            for w, start in found:
                words.setdefault(w, []).append(start + at)
        at = cut
    claimed = bytearray(b"".join(masks))
    _claim(_variables(words, claimed), claimed, out)
    _claim(_matches(text, *_QUOTED), claimed, out)
    _claim(_listed(text, "term", "TERM", [w for w in ((g or "").strip() for g in glossary) if w]), claimed, out)
    out.sort(key=_start)
    if every:
        return out
    first: dict[tuple[str, str], Fact] = {}
    for fact in out:
        first.setdefault((fact[0], fact[2]), fact)
    return list(first.values())


def sentence_ends(text: str) -> list[int]:
    """Ends of sentences: after sentence marks and newlines, and after a full stop between a letter and white space."""
    ends = [m.end() for m in _ENDS.finditer(text) if m[0] != "." or (m.start() and text[m.start() - 1].isalpha())]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def context(text: str, ends: Sequence[int], at: int) -> str:
    """The sentence around a place."""
    i = bisect_right(ends, at)
    return text[ends[i - 1] if i else 0 : ends[i]].strip() if i < len(ends) else ""


def contexts(text: str, at: Sequence[int]) -> list[str]:
    """The sentence around each place."""
    ends, kept = sentence_ends(text), {}
    out = []
    for x in at:
        i = bisect_right(ends, x)
        if i not in kept:
            kept[i] = text[ends[i - 1] if i else 0 : ends[i]].strip() if i < len(ends) else ""
        out.append(kept[i])
    return out


def places(text: str, parsed: Sequence[Line], starts: Sequence[int]) -> list[tuple[int, int]]:
    """Section and paragraph within it of each place."""
    heads = [x.start for x in parsed if x.kind == "heading"]
    breaks = [m.end() for m in _BREAK.finditer(text)]
    firsts = [0, *(bisect_right(breaks, h) for h in heads)]
    out = []
    for at in starts:
        sec = bisect_right(heads, at)
        out.append((sec, bisect_right(breaks, at) - firsts[sec]))
    return out


def rebound(before: Sequence[tuple[str, tuple[str, str]]], after: Sequence[tuple[str, tuple[str, str]]], cites: Sequence[str]) -> list[tuple[str, str]]:
    """Citations that stand with other facts than before, while what they stood with stands with another citation.
    Both sides: sentence and (kind, form) of each fact."""

    was, now = ({name: sentence for sentence, name in side if sentence} for side in (before, after))
    out = []
    for cite in (name for name in was if name[0] in cites and name in now):
        old, new = was[cite], now[cite]
        mates = [name for sentence, name in before if sentence == old and name[0] not in cites]
        if not mates or any(sentence == new and name in mates for sentence, name in after):
            continue
        theirs = {now[x] for x in mates if x in now}
        if any(sentence in theirs and name[0] in cites and name in was for sentence, name in after):
            out.append(cite)
    return out


def shape(parsed: Sequence[Line]) -> tuple[list[str], list[list[list[str]]], list[str], str | None]:
    """Headings, tables as rows of cells, code blocks, and the references section (None without one)."""
    heads = [f"{'#' * x.level} {x.title}" for x in parsed if x.kind == "heading"]
    tables: dict[int, list[list[str]]] = {}
    codes: dict[int, list[str]] = {}
    for x in parsed:
        if x.kind == "code":
            codes.setdefault(x.part, []).append(x.text)
        elif x.kind == "table":
            rows = tables.setdefault(x.part, [])
            if row := cells(x.text):
                rows.append([" ".join(c.split()) for c in row])
    refs = [x.text for x in parsed if x.refs]
    return heads, list(tables.values()), ["\n".join(c) for c in codes.values()], "\n".join(refs).strip() if refs else None


_RULER = re.compile(r":?-{2,}:?")


def cells(line: str) -> list[str] | None:
    """The cells of a table row; None of a ruler and of a blank row."""
    row = [c.strip() for c in line.strip().strip("|").split("|")]
    return row if any(c and not _RULER.fullmatch(c) for c in row) else None


NUMBER = re.compile(r"\d+(?:\.\d+)?")
