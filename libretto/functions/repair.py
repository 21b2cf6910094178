"""Unicode repair as an Arrow UDF: mis-decoded text, ligatures, widths, quotes, controls, line ends.

Text that was written as UTF-8 and read as something else is put right by a search
over chains of re-readings, nested ones too: each step takes the runs that some
one-byte encoding would make of UTF-8 and reads them as UTF-8; the chain of the
lowest cost wins. Odd characters cost, and so does a step; a run that people write
by themselves (a letter before a closing quote) is no such run.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'}
#: Full-width forms of ASCII, and the ideographic space.
WIDTHS = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {"　": " "}
TABLE = str.maketrans(LIGATURES | QUOTES | WIDTHS)
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f﻿]")
TERMINAL = re.compile("\x1b\\[[0-9;]*[A-Za-z]")


def reading(name: str) -> str:
    """The characters that bytes 128 to 255 are in a one-byte encoding; a byte it leaves open is the control of that number."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


class Reading:
    """One wrong reading of UTF-8: how to find its runs, and to undo it.

    ``leads`` are the first bytes that count: those whose characters people do not
    write before a continuation. ``least`` characters have to stand in one run.
    """

    #: What stands behind a word, also as a control read as latin-1.
    CLOSING = frozenset("…”’»›\x85\x94\x92\x9b")

    def __init__(self, name: str, leads: str | None = None, least: int = 1):
        chars = reading(name)
        self.bytes = {ord(c): b for b, c in enumerate(chars, 128)}
        every = "".join(c for b, c in enumerate(chars, 128) if 0xC2 <= b <= 0xF4)
        leads = every if leads is None else leads
        of = lambda low, high: "[" + re.escape("".join(c for c in leads if low <= self.bytes[ord(c)] <= high) or "\x00") + "]"
        more = "[" + re.escape("".join(chars[:64])) + "]"
        one = f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{more}|{of(0xF0, 0xF4)}{more}{more}{more})"
        self.runs, self.one, self.least = re.compile(f"{one}{{{least},}}"), re.compile(one), least

    def undo(self, text: str) -> str:
        def decoded(m: re.Match) -> str:
            run = m[0]
            # a letter and the quotes behind it, at the end of a word
            if set(run[1:]) <= self.CLOSING and text[max(0, m.start() - 1) : m.start()].isalpha() and not text[m.end() : m.end() + 1].isalpha():
                return run
            try:
                return bytes(self.bytes[ord(c)] for c in run).decode("utf-8")
            except UnicodeDecodeError:
                return self.one.sub(self._each, run)

        return self.runs.sub(decoded, text)

    def _each(self, m: re.Match) -> str:
        try:
            return bytes(self.bytes[ord(c)] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]


#: Encodings that UTF-8 is commonly read as; of three only the leads that nobody writes by themselves.
READINGS = (Reading("cp1252"), Reading("latin-1"), Reading("mac_roman", "¬√ƒ≈‚"), Reading("cp437", "┬├Γ"), Reading("cp1251", least=3))
#: Controls that are characters of cp1252 read as latin-1.
WINDOWS = str.maketrans({chr(b): c for b, c in enumerate(reading("cp1252")[:32], 128) if ord(c) > 0xFF})
#: What may be a reading of UTF-8 at all, for a first look; and characters that text is seldom made of.
SUSPECT = re.compile("|".join(r.runs.pattern for r in READINGS) + "|[\x80-\x9f]")
CONTROLS = re.compile("[\x80-\x9f�]")
SYMBOLS = re.compile("[¢£¤¥¦§¨ª¬¯±²³´µ¶·¸¹º¼½¾†‡ˆ‰‹›€™˜•√∆≈∫∂∑∏πΩ∞≠≤≥◊┬├Γ⌐░▒▓│┤╡╢╖╕╣║╗╝╜╛┐]")
SELDOM = re.compile("[ƀ-ͯѠ-֏܀-ࣿༀ-᷿ꀀ-꯿-]")
STEP = 0.5
#: Texts of one run that are read on; what the search has found by then stands.
READ = 100


def cost(text: str) -> float:
    """How unlikely a text is: characters beyond ASCII, and more for controls, seldom scripts and stray symbols."""
    return len(text) - len(text.encode("ascii", "ignore")) + 6 * len(CONTROLS.findall(text)) + 6 * len(SELDOM.findall(text)) + 2 * len(SYMBOLS.findall(text))


def decoded(run: str, most: int = 5) -> str:
    """The cheapest text that a chain of at most ``most`` re-readings makes of a run; cheaper ones are read on first, READ of them at most."""
    queue, seen, read = [(cost(run), 0, run)], {run}, 0
    best = queue[0]
    while queue and read < READ:
        at = heapq.heappop(queue)
        best = min(best, at)
        if at[1] == most or not SUSPECT.search(at[2]):
            continue
        read += 1
        for step in (*(r.undo for r in READINGS), lambda t: t.translate(WINDOWS)):
            if (text := step(at[2])) not in seen:
                seen.add(text)
                heapq.heappush(queue, (cost(text) + STEP * (at[1] + 1), at[1] + 1, text))
    return best[2]


class Runs(dict):
    """Runs beyond ASCII, with what stands before and behind, and what becomes of them: texts have few different ones. Long ones are not kept."""

    LIMIT, LONG = 20_000, 64

    def __init__(self, table: dict[int, str]):
        self.table = table

    def __missing__(self, key: tuple[str, bool, bool]) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        run, before, behind = key
        # a letter or a space for either neighbour
        out = (decoded(("x" if before else " ") + run + ("x" if behind else " "))[1:-1] if SUSPECT.search(run) else run).translate(self.table)
        if len(run) <= self.LONG:
            self[key] = out
        return out


BEYOND = re.compile("[^\x00-\x7f]+")
#: What becomes of runs in encoding alone, and with the characters of TABLE, which are all beyond ASCII, put as they are written here.
_RUNS, _WRITTEN = Runs({}), Runs(TABLE)


def fix_encoding(text: str, runs: Runs = _RUNS) -> str:
    def fixed(m: re.Match) -> str:
        a, b = m.span()
        return runs[m[0], text[max(0, a - 1) : a].isalpha(), text[b : b + 1].isalpha()]

    return BEYOND.sub(fixed, text)


def fix_text(text: str | None) -> str | None:
    if text is None or (text.isascii() and "&" not in text and not CONTROL.search(text) and "\r" not in text):
        return text
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    # a terminal's codes go before letters are put otherwise
    text = TERMINAL.sub("", fix_encoding(text)).translate(TABLE) if "\x1b" in text else fix_encoding(text, _WRITTEN)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", CONTROL.sub("", text))


def odd(text: Column) -> Column:
    """Whether ``fix_text`` may change a text: letters beyond ASCII, references, or controls other than tabs and line ends."""
    return (F.octet_length(text) != F.char_length(text)) | F.contains(text, F.lit("&")) | F.contains(text, F.lit("\x7f")) | text.rlike(r"[\x00-\x1f](?<![\t\n])")


@F.pandas_udf(StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return text.map(fix_text, na_action="ignore")


def repaired(text: Column) -> Column:
    """Repaired text; non-deterministic to the optimiser, so that it is computed once. Only texts that may change go to Python."""
    return F.coalesce(_repaired.asNondeterministic()(F.when(odd(text), text)), text)


def misread(text: Column, name: str) -> Column:
    """Text whose UTF-8 was read as a one-byte encoding: the damage that ``repaired`` undoes."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, range(128, 256))), reading(name))
