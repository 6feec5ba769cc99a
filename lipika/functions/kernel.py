"""The transliteration kernel: text to phoneme tokens, tokens to written units, units to text.

Plain Python without Spark.  A token is ``(class, index, kind)``; a unit is a syllable's part ``(kind, class, index, mark, sign, accent)`` with -1 for an
empty slot; verbatim text is a string in either stream.  Tables are compiled once for each process.
"""

from __future__ import annotations

import collections
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from lipika.functions import alphabets as A
from lipika.functions import options as O

Token = tuple[int, int, str]
Unit = tuple[str, int, int, int, int, int]
IGNORED: Unit = ("", -1, -1, -1, -1, -1)
FOLD = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
MARKERS = {ord(c): None for c in A.MARKERS}
#: Words, or pieces of words, remembered lately, and their longest; as many older ones are kept until the memory fills again.
MEMO_WORDS, MEMO_CHARS = 40_000, 64
#: Verbatim parts, or where one that is not closed starts; in ``##`` a single ``#`` takes the character after it along.
VERBATIM = re.compile(r"(<[^>]*>)|##((?:[^#]++|#[^#])*+)##|<|##")
RUNS = re.compile("#?[^#]+|#")
WORDS = re.compile("([ \t\r\n]+)")
#: Words and spaces where small digits count: digits at a word's end are one run with the spaces after it.
DIGIT_WORDS = re.compile(f"[ \t\r\n]+|[^ \t\r\n]*[{A.SUPERSCRIPTS}{A.SUBSCRIPTS}][ \t\r\n]+|[^ \t\r\n]+")
DIGITS = re.compile(f"[{A.SUPERSCRIPTS}{A.SUBSCRIPTS}]")


class Memo(dict):
    """Results by key, made when they are first asked for; what it holds is bounded."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if (found := self.older.get(key)) is None:
            found = self.make(key)
        if len(key if isinstance(key, str) else key[0]) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = self.copy()
                self.clear()
            self[key] = found
        return found


def longest_of(words: Iterable[str]) -> str:
    """A pattern that matches the longest of the words at a place."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        leaves = [c for c, below in node.items() if c and below.keys() == {""}]
        found = [re.escape(c) + pattern(below) for c, below in node.items() if c and c not in leaves]
        found += ["[" + "".join(map(re.escape, leaves)) + "]"] if leaves else []
        if "" in node:
            return f"(?:{'|'.join(found)})?" if found else ""
        return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"

    return pattern(tree)


def parts(text: str) -> list[tuple[str, str | None]]:
    """A text's plain parts, each with the verbatim part after it (None at the end); what follows an unclosed one is lost."""
    text = text.split("\0", 1)[0]
    if "<" not in text and "##" not in text:
        return [(text, None)]
    out, at = [], 0
    for found in VERBATIM.finditer(text):
        literal = found[1] if found[1] is not None else found[2]
        out.append((text[at : found.start()], literal))
        if literal is None:
            return out
        at = found.end()
    return [*out, (text[at:], None)]


class Reader:
    """A source script's spellings."""

    def __init__(self, name: str, script: A.Script):
        self.kind, self.fold = script.kind, name in A.CASELESS
        self.spellings: dict[str, tuple[Token, ...]] = {}
        self._own(script)
        for row in sorted(script.equivalents, key=str.encode):
            tokens = self._meaning(row, script.kind)
            for alias in script.equivalents[row] if tokens else ():
                self._put(alias, tokens)
        if name == "indic":
            for other in A.scripts().values():
                if other.kind != A.LATIN and other.name != script.name:
                    self._own(other)
        self.pieces = re.compile(f"({longest_of(self.spellings)})")
        starts = {k[0] for k, found in self.spellings.items() if any(t[2] == A.TAMIL for t in found)}
        others = {k[0] for k, found in self.spellings.items() if any(t[2] != A.TAMIL and t[0] != A.SYMBOL for t in found)}
        self.tamil = re.compile(self.one_of(starts)) if starts else None
        self.beside_tamil = re.compile(self.one_of(others or {"\0"}))
        self.nasals = re.compile(self.one_of({k[0] for k, found in self.spellings.items() if any(t[:2] == (A.OTHER, 1) for t in found)} or {"\0"}))
        self.chunks = self.chunk_pattern()

    def _put(self, spelling: str, tokens: tuple[Token, ...]) -> None:
        if spelling:
            self.spellings.setdefault(spelling, tokens)

    def _own(self, script: A.Script) -> None:
        for kind, glyphs in enumerate(script.glyphs):
            if kind == A.MARK and script.kind == A.LATIN:
                continue  # a Latin vowel sign is the vowel
            for i, glyph in enumerate(glyphs):
                self._put(glyph, ((kind, i, script.kind),))

    def _meaning(self, row: str, kind: str) -> tuple[Token, ...]:
        """Tokens of a row's key: a phoneme such as ``x:2``, or spellings known so far; none if it cannot be read."""
        if len(row) >= 3 and row[1] == ":":
            return ((A.LETTERS.index(row[0]), int(row[2:]), kind),)
        out: list[Token] = []
        while row:
            size = next((n for n in range(len(row), 0, -1) if row[:n] in self.spellings), 0)
            if not size:
                return ()
            out += self.spellings[row[:size]]
            row = row[size:]
        return tuple(out)

    def one_of(self, chars: Iterable[str]) -> str:
        """A pattern of any of the characters, before folding."""
        both = {x for c in chars for x in (c, c.upper() if self.fold and "a" <= c <= "z" else c)}
        return "[" + "".join(map(re.escape, sorted(both))) + "]"

    def chunk_pattern(self) -> re.Pattern:
        """Pieces of a plain text between which no spelling and no unit reaches, so that each can be read alone.  Not for texts with Tamil letters."""
        after: dict[str, set[str]] = {c: set() for key in self.spellings for c in key}
        doubles = [key for key, found in self.spellings.items() if found[-1][:2] == (A.EXCLUSIVE, A.ADHAK)]
        joining, held = set(), {key[-1] for key in doubles}
        for key, found in self.spellings.items():
            for x, y in zip(key, key[1:]):
                after[x].add(y)
            if found[0][0] in (A.VOWEL, A.MARK, A.OTHER, A.ACCENT):
                joining.add(key[0])
            if doubles and found[-1][0] == A.ACCENT:  # where accents are ignored, the sign sees past them
                held.add(key[-1])
        self.after, self.held = {c: after[c] | joining for c in after}, held
        alike: dict[frozenset[str], list[str]] = {}
        for c in after:
            alike.setdefault(frozenset(self.after[c]), []).append(c)
        kept = [f"{self.one_of(cs)}(?={self.one_of(ys)})" for ys, cs in alike.items() if ys] + ([f"{self.one_of(held)}(?=.)"] if held else [])
        return re.compile(f"(?s)(?:{'|'.join(kept)})*+.")

    def tokens(self, text: str, mask: int = 0) -> list[Token | str]:
        """Tokens and verbatim text: markup ``<...>``, text between ``##`` pairs, and runs that no spelling starts."""
        out: list[Token | str] = []
        spellings, drop = self.spellings, mask & O.IGNORE_ACCENTS
        for plain, literal in parts(text):
            found, at = self.pieces.split(plain.translate(FOLD) if self.fold else plain), 0
            for n in range(0, len(found), 2):
                if gap := found[n]:
                    gap = plain[at : at + len(gap)] if self.fold else gap
                    out.extend(RUNS.findall(gap) if "#" in gap else (gap,))
                    at += len(gap)
                if n + 1 < len(found):
                    piece = found[n + 1]
                    at += len(piece)
                    out.extend([t for t in spellings[piece] if t[0] != A.ACCENT] if drop else spellings[piece])
            if literal is not None:
                out.append(literal)
        return out

    def counts(self, text: str) -> tuple[dict[str, int], int]:
        """How often each spelling occurs, and the number of verbatim parts and runs."""
        pieces, gaps, literals = collections.Counter(), collections.Counter(), 0
        for plain, literal in parts(text):
            found = self.pieces.split(plain.translate(FOLD) if self.fold else plain)
            pieces.update(found[1::2])
            gaps.update(found[::2])
            literals += literal is not None
        return pieces, literals + sum(n * len(RUNS.findall(gap)) for gap, n in gaps.items())


@lru_cache(maxsize=64)
def reader(name: str) -> Reader | None:
    """The reader of a source, None if there is no such script or it can only be written."""
    if name in A.WRITE_ONLY:
        return None
    script = A.find("devanagari" if name == "indic" else name)
    return Reader(name, script) if script else None


@lru_cache(maxsize=1)
def prefixes() -> dict:
    """Tamil prefixes as a tree: unit (class, index, mark, sign, accent) to [whether a prefix ends here, branches]."""
    spellings, root = reader("tamil"), {}
    for word in A.TAMIL_PREFIXES:
        units: list[list[int]] = []
        for kind, i, _ in spellings.tokens(word):
            if kind in (A.MARK, A.OTHER, A.ACCENT):
                units[-1][{A.MARK: 2, A.OTHER: 3, A.ACCENT: 4}[kind]] = i
            else:
                units.append([kind, i, -1, -1, -1])
        branches = root
        for n, unit in enumerate(units):
            node = branches.setdefault(tuple(unit), [False, {}])
            node[0] |= n == len(units) - 1
            branches = node[1]
    return root


class Prefix:
    """How far a word has followed a Tamil prefix; a match holds to the word's end, a mismatch changes nothing."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.branches, self.matched = prefixes(), False

    def step(self, unit: Unit) -> None:
        kind, cls, i = unit[:3]
        if kind != A.TAMIL and cls == A.CONSONANT and i <= 24 and i % 5 != 4:
            i -= i % 5
        if node := self.branches.get((cls, i, *unit[3:])):
            self.matched = self.matched or node[0]
            self.branches = node[1] or self.branches


def is_hard(unit: Unit) -> bool:
    return unit[1] == A.CONSONANT and (unit[2] <= 20 and unit[2] % 5 == 0 or unit[2] == 35)


def is_soft(unit: Unit) -> bool:
    return unit[1] == A.CONSONANT and (unit[2] <= 24 and unit[2] % 5 == 4 or unit[2] in (25, 26, 27, 28, 33, 34, 36))


def raised(text: str) -> int | None:
    """By how much a consonant's index grows before a literal of superscripts or subscripts: half its place there in UTF-8 bytes."""
    for digits in (A.SUPERSCRIPTS, A.SUBSCRIPTS):
        if (at := digits.find(text)) >= 0:
            return len(digits[:at].encode()) // 2
    return None


def units(tokens: list[Token | str], mask: int = 0, carry: list[Unit] | None = None) -> Iterator[Unit | str]:
    """Written units of a token stream; an empty verbatim text ends it.

    ``carry`` has the last unit of the word before, and then of this one: it is all that Tamil words hand on to the next over verbatim text.
    """
    at, n = 0, len(tokens)
    word_start, last, prefix = True, carry[0] if carry else IGNORED, None
    while at < n:
        token = tokens[at]
        at += 1
        if isinstance(token, str):
            if not token:
                return
            word_start = True
            yield token
            continue
        cls, i, kind = token
        if cls == A.EXCLUSIVE and i == A.ADHAK and kind == A.INDIC:
            after = tokens[at] if at < n else ""
            if not isinstance(after, str) and after[0] == A.CONSONANT:
                yield after[2], A.CONSONANT, after[1] - (after[1] % 5 % 2 if after[1] < 24 else 0), 0, -1, -1
            else:
                yield IGNORED
            continue
        if cls == A.EXCLUSIVE and i == A.SKIP:
            yield IGNORED
            continue
        mark = sign = accent = -1
        lead = i
        if kind == A.LATIN:
            if cls == A.CONSONANT:
                voiced = False
                while at < n and not isinstance(follow := tokens[at], str):
                    if follow[0] in (A.VOWEL, A.MARK) and not voiced:
                        voiced = True
                        mark = follow[1] or -1
                    elif follow[0] == A.OTHER:
                        sign = follow[1]
                    elif follow[0] == A.ACCENT:
                        accent = follow[1]
                    else:
                        break
                    at += 1
                if not voiced:
                    mark = 0
            unit: Unit = (kind, cls, lead, mark, sign, accent)
        else:
            primary = cls == A.CONSONANT and i <= 20 and i % 5 == 0
            if cls in (A.CONSONANT, A.VOWEL):
                while at < n:
                    follow = tokens[at]
                    if isinstance(follow, str):
                        by = raised(follow) if kind == A.TAMIL and cls == A.CONSONANT and (primary or i == 7) else None
                        if by is None:
                            break
                        lead = i + by
                    elif follow[0] == A.OTHER:
                        sign = follow[1]
                    elif follow[0] == A.ACCENT:
                        accent = follow[1]
                    elif follow[0] == A.MARK and cls == A.CONSONANT:
                        mark = follow[1]
                    else:
                        break
                    at += 1
            unit = (kind, cls, lead, mark, sign, accent)
            if kind == A.TAMIL:
                prefix = prefix or Prefix()
                after_prefix = False
                if word_start:
                    prefix.reset()
                else:
                    after_prefix = prefix.matched
                if cls != A.CONSONANT:
                    prefix.step(unit)
                elif not mask & O.TAMIL_SUPERSCRIPTED:
                    prefix.step(unit)
                    if primary:
                        ends = at >= n or isinstance(tokens[at], str) or tokens[at][0] == A.SYMBOL
                        unit = allophone(unit, i, last, word_start or after_prefix, ends)
        word_start = cls == A.SYMBOL
        last = IGNORED if word_start else unit
        yield unit
    if carry:
        carry[0] = last


def allophone(unit: Unit, written: int, last: Unit, first: bool, ends: bool) -> Unit:
    """How a Tamil stop sounds: hard at the start, doubled or after a mute stop, else voiced, ச as a sibilant; mute at a word's end not at all."""
    kind, cls, lead, *slots = unit
    if slots[0] == 0:
        return IGNORED if ends else unit
    other = last[:3] != unit[:3]
    mute = last[3] == 0
    if first:
        sibilant = lead == 5 and other and not mute and last[3] not in (2, 4, 10, 13, 16, -1)
        return (kind, cls, 31, *slots) if sibilant else unit
    if mute:
        if not other or is_hard(last):
            return unit
        return (kind, cls, 31 if lead == 5 and not is_soft(last) else written + 2, *slots)
    return (kind, cls, 31 if lead == 5 else written + 2, *slots)


class Writer:
    """A target script's glyphs and rules."""

    def __init__(self, script: A.Script, mask: int):
        self.kind = script.kind
        if script.kind == A.INDIC and not script.vedic:
            mask |= O.IGNORE_ACCENTS
        self.mask = mask
        strip = (lambda s: s) if mask & O.RETAIN_MARKERS else (lambda s: s.translate(MARKERS))
        self.raw, self.strip = script.glyphs, strip
        self.glyphs = [[*map(strip, row), ""] for row in script.glyphs]
        for digit in range(10 if mask & O.ASCII_NUMERALS and self.kind != A.LATIN else 0):
            self.glyphs[A.SYMBOL][digit] = str(digit)
        self.looks_ahead = self.kind == A.LATIN and not self.raw[A.OTHER][1]
        self.texts = Memo(self.alone)

    def alone(self, unit: Unit) -> str:
        """A unit's text where it does not depend on those beside it."""
        out: list[str] = []
        if unit[1] >= 0:
            {A.INDIC: self.indic, A.LATIN: self.latin, A.TAMIL: self.tamil_lead}[self.kind](unit, "", out)
        return "".join(out)

    def glyph(self, cls: int, i: int) -> str:
        row = self.glyphs[cls] if 0 <= cls < len(self.glyphs) else ()
        return row[i] if 0 <= i < len(row) else ""

    def nasal(self, follow: Unit | str) -> str:
        """An anusvara without glyph of its own: the nasal of the next unit's series, m before text and at the end."""
        i = 24
        if not isinstance(follow, str) and 0 <= follow[2] < 24:
            i = follow[2] // 5 * 5 + 4
        return self.glyph(A.CONSONANT, i) + (self.glyph(A.MARK, 0) if self.kind == A.TAMIL else "")

    def write(self, stream: Iterator[Unit | str]) -> str:
        out: list[str] = []
        if self.kind != A.TAMIL and not self.looks_ahead:
            for unit in stream:
                if not unit:
                    break
                out.append(self.strip(unit) if isinstance(unit, str) else self.texts[unit])
            return "".join(out)
        put = self.tamil if self.kind == A.TAMIL else self.latin_ahead
        self.word_start, self.prefix = True, Prefix() if self.kind == A.TAMIL else None
        current = next(stream, "")
        while current:
            follow = next(stream, "")
            if isinstance(current, str):
                out.append(self.strip(current))
                self.word_start = True
            elif current[1] >= 0:
                put(current, follow, out)
                self.word_start = current[1] == A.SYMBOL
            current = follow
        return "".join(out)

    def indic(self, unit: Unit, follow: Unit | str, out: list[str]) -> None:
        _, cls, i, mark, sign, accent = unit
        out.append(self.glyph(cls, i))
        if mark >= 0:
            out.append(self.glyph(A.MARK, mark))
        if sign >= 0:
            out.append(self.glyph(A.OTHER, sign))
        if accent >= 0 and not self.mask & O.IGNORE_ACCENTS:
            out.append(self.glyph(A.ACCENT, accent))

    def latin(self, unit: Unit, follow: Unit | str, out: list[str]) -> None:
        _, cls, i, mark, sign, accent = unit
        out.append(self.glyph(cls, i))
        if cls == A.CONSONANT:
            out.append(self.glyph(A.VOWEL, 0) if mark < 0 else self.glyph(A.MARK, mark) if mark else "")
        if accent >= 0 and not self.mask & O.IGNORE_ACCENTS:
            out.append(self.glyph(A.ACCENT, accent))
        if sign >= 0:
            out.append(self.nasal(follow) if sign == 1 and not self.raw[A.OTHER][1] else self.glyph(A.OTHER, sign))

    def latin_ahead(self, unit: Unit, follow: Unit | str, out: list[str]) -> None:
        if unit[4] == 1:
            self.latin(unit, follow, out)
        else:
            out.append(self.texts[unit])

    def tamil_lead(self, unit: Unit, follow: Unit | str, out: list[str], hard: bool = False) -> None:
        """The unit without sign and accent; ``hard``: with the n inside words."""
        _, cls, i, mark, _, _ = unit
        if cls != A.CONSONANT:
            out.append(self.glyph(cls, i))
            return
        lead = self.raw[cls][i] if 0 <= i < len(self.raw[cls]) else ""
        if hard:
            lead = "ன"
        elif self.mask & O.TAMIL_TRADITIONAL:
            lead = A.TAMIL_TRADITIONAL.get(lead, lead)
        number = ""
        if len(lead) > 1 and lead[-1] in A.SUPERSCRIPTS:
            lead, number = lead[:-1], lead[-1]
        sound = self.raw[A.MARK][mark] if 0 <= mark < len(self.raw[A.MARK]) else ""
        if not self.mask & O.TAMIL_SUPERSCRIPTED:
            number = ""
        out.append(self.strip(lead + sound[:1] + number + sound[1:]))

    def tamil(self, unit: Unit, follow: Unit | str, out: list[str]) -> None:
        _, cls, i, mark, sign, accent = unit
        after_prefix = self.prefix.matched
        if self.word_start:
            self.prefix.reset()
        self.prefix.step(unit)
        if cls == A.CONSONANT and i == 19 and not self.word_start and not after_prefix and (mark != 0 or self.word_ends(follow)):
            self.tamil_lead(unit, follow, out, hard=True)
        else:
            out.append(self.texts[unit])
        if cls not in (A.CONSONANT, A.VOWEL):
            return
        if sign >= 0:
            out.append(self.nasal(follow) if sign == 1 else self.glyph(A.OTHER, sign))
        if accent >= 0 and not self.mask & O.IGNORE_ACCENTS:
            written = self.glyph(A.ACCENT, accent)
            last = next((n for n in range(len(out) - 1, -1, -1) if out[n]), None)
            if last is not None and out[last][-1] in A.TAMIL_SPECIAL:  # the accent goes before such a sign
                out[last] = out[last][:-1] + written + out[last][-1]
            else:
                out.append(written)

    @staticmethod
    def word_ends(follow: Unit | str) -> bool:
        if isinstance(follow, str):
            return not follow or follow not in A.SUPERSCRIPTS
        return follow[1] == A.SYMBOL


@lru_cache(maxsize=256)
def writer(name: str, mask: int) -> Writer | None:
    script = A.find(name)
    return Writer(script, mask) if script else None


class Transliterator:
    """One direction with its options.

    Words are remembered: apart from verbatim parts, and with small digits their spaces, they don't depend on each other, but for a Tamil word with ச,
    whose sound can depend on the unit before the word.  Words that are not known are read in chunks, which are remembered too; between Tamil and other
    scripts chunks hold for reading other scripts only.
    """

    def __init__(self, source: str, target: str, mask: int = 0):
        self.mask = mask
        self.reader = reader(source) if source != target else None
        self.writer = writer(target, mask) if self.reader else None
        self.known = self.writer is not None
        if not self.known:
            return
        self.tamil = self.reader.tamil
        self.to_tamil = self.writer.kind == A.TAMIL
        self.pieces = Memo(self.whole)
        self.words = Memo(self.to_tamil_word if self.to_tamil else self.plain_word)
        self.after = Memo(self.tamil_word)

    def whole(self, text: str) -> str:
        return self.writer.write(units(self.reader.tokens(text, self.mask), self.mask))

    def plain_word(self, word: str) -> str:
        if self.writer.looks_ahead and self.reader.nasals.search(word):
            return self.whole(word)
        return "".join(map(self.pieces.__getitem__, self.reader.chunks.findall(word)))

    def to_tamil_word(self, word: str) -> str:
        if DIGITS.search(word):
            return self.whole(word)
        return self.writer.write(iter(unit_chunks(self.reader, self.mask & O.IGNORE_ACCENTS).read(word)))

    def tamil_word(self, key: tuple[str] | tuple[str, Unit]) -> tuple[str, Unit | None]:
        """A word's text after a unit, and its last unit, None if it has none and hands on what it got."""
        given = tuple([*key[1]]) if len(key) > 1 else (*IGNORED,)
        carry = [given]
        found = self.writer.write(units(self.reader.tokens(key[0], self.mask), self.mask, carry))
        return found, None if carry[0] is given else carry[0]

    def __call__(self, text: str | None) -> str | None:
        """The text in the target script; None for None and where the direction is unknown."""
        if text is None or not self.known:
            return None
        odd = "<" in text or "#" in text or "\0" in text
        if self.tamil and self.tamil.search(text):
            if odd or self.reader.beside_tamil.search(text):  # a prefix's match outlasts words that other scripts start
                return self.whole(text)
            out, last = [], IGNORED
            for word in DIGIT_WORDS.findall(text):
                found, own = self.after[(word, last) if "ச" in word else (word,)]
                out.append(found)
                last = own or last
            return "".join(out)
        if self.to_tamil:
            if odd:
                return self.whole(text)
            return "".join(map(self.words.__getitem__, DIGIT_WORDS.findall(text)))
        if not odd:
            return "".join(map(self.words.__getitem__, WORDS.split(text)))
        out = []
        for plain, literal in parts(text):
            out += map(self.words.__getitem__, WORDS.split(plain))
            if not literal:  # an empty one ends the text
                break
            out.append(self.writer.strip(literal))
        return "".join(out)


class UnitChunks:
    """Units of a plain text without Tamil letters, by remembered chunks."""

    def __init__(self, source: Reader, mask: int):
        self.source = source
        self.memo = Memo(lambda chunk: tuple(units(source.tokens(chunk, mask), mask)))

    def read(self, text: str) -> Iterator[Unit | str]:
        return itertools.chain.from_iterable(map(self.memo.__getitem__, self.source.chunks.findall(text)))


@lru_cache(maxsize=16)
def unit_chunks(source: Reader, mask: int) -> UnitChunks:
    return UnitChunks(source, mask)


class Counter:
    """Counts of a source's tokens and units; of units, chunks are remembered."""

    def __init__(self, source: str, mask: int = 0):
        self.mask, self.reader = mask, reader(source)
        self.memo = Memo(lambda chunk: self.whole(chunk)[1])

    def whole(self, text: str) -> tuple[dict[tuple[int, int], int], tuple[int, int, int]]:
        found = self.reader.tokens(text, self.mask)
        written = [u for u in units(found, self.mask) if not isinstance(u, str) and u[1] >= 0]
        return dict(collections.Counter(t[:2] for t in found if not isinstance(t, str))), (len(written), sum(u[3] == 0 for u in written), sum(u[4] >= 0 for u in written))

    def tokens(self, text: str) -> dict[tuple[int, int], int]:
        out: dict[tuple[int, int], int] = {}
        for piece, n in self.reader.counts(text)[0].items():
            for cls, i, _ in self.reader.spellings[piece]:
                if cls != A.ACCENT or not self.mask & O.IGNORE_ACCENTS:
                    out[cls, i] = out.get((cls, i), 0) + n
        return out

    def total(self, text: str) -> tuple[int, int]:
        """Tokens with verbatim parts and runs, and accents among them."""
        pieces, literals = self.reader.counts(text)
        found = [(n * len(ts), n * sum(t[0] == A.ACCENT for t in ts)) for piece, n in pieces.items() for ts in [self.reader.spellings[piece]]]
        return sum(n for n, _ in found) + literals, sum(n for _, n in found)

    def units(self, text: str) -> tuple[int, int, int]:
        """How many units, mute consonants and signs."""
        if self.reader.tamil and self.reader.tamil.search(text):
            return self.whole(text)[1]
        counts = collections.Counter()
        for plain, literal in parts(text):
            counts.update(self.reader.chunks.findall(plain))
            if not literal:  # an empty one ends the text
                break
        a = b = c = 0
        for chunk, n in counts.items():
            x, y, z = self.memo[chunk]
            a, b, c = a + n * x, b + n * y, c + n * z
        return a, b, c


@lru_cache(maxsize=8)
def counter(source: str, mask: int = 0) -> Counter:
    return Counter(source, mask)


@lru_cache(maxsize=16)
def transliterator(source: str, target: str, mask: int = 0) -> Transliterator:
    return Transliterator(source, target, mask)


def transliterate(text: str | None, source: str, target: str, mask: int = 0) -> str | None:
    return transliterator(source, target, mask)(text)


def empty(text: str | None, source: str, target: str, mask: int = 0) -> str | None:
    """As ``transliterate``, but an empty text where a direction is unknown."""
    return None if text is None else transliterate(text, source, target, mask) or ""


def mixed(source: str) -> str:
    """``indic`` for every source that is not Latin: its reader knows all of their alphabets."""
    script = A.find(source)
    return "indic" if script and script.kind != A.LATIN else source


def lenient(text: str | None, source: str, target: str, mask: int = 0) -> str | None:
    """As ``transliterate``, but text comes back as it is where it is empty, the scripts are equal, or a direction is not offered."""
    s, t = (A.find(x) for x in (source, target))
    unreadable = source != "indic" and (s is None or s.name in ("readableLatin", "wx"))
    if not text or source == target or unreadable or t is None:
        return text
    return transliterate(text, source, target, mask) or ""
