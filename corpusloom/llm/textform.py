"""One consistent form for text that looks alike (tables and word runs).

The tables state which characters count as styled, invisible or look-alike;
the operator over corpora is in :mod:`corpusloom.llm.lookalikes`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝѵгпивткнмьқ", "aeopcyxijshdqwvrnubtkhmbk"))
CYRILLIC |= dict(zip("АВЕЗКМНОРСТУХІЈЅԌԚԜЬ", "ABE3KMHOPCTYXIJSGQWb"))
GREEK = dict(zip("αβγεηικνορτυχωςσ", "abyenikvoptuxwco"))
GREEK |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օսցհոա", "oughnw"))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN

#: Scripts whose letters are taken for Latin ones inside a Latin word.
_OTHER = r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}\p{Script=Cherokee}\p{Script=Coptic}]"
_INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e01ef\x00-\x08\x0e-\x1f\x7f"
_SPACES = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x0b\x0c\x85"

#: Emoji sequences: joiners, selectors, tags and key caps inside them stay.
EMOJI = regex.compile(
    r"(?:\p{Extended_Pictographic}|\p{Regional_Indicator}{2}|[0-9#*](?=\ufe0f?\u20e3))"
    r"(?:[\ufe0e\ufe0f]|\p{Emoji_Modifier}|\u20e3|[\U000e0020-\U000e007f])*"
    r"(?:\u200d\p{Extended_Pictographic}(?:[\ufe0e\ufe0f]|\p{Emoji_Modifier})*)*"
)
INVISIBLE = regex.compile(f"[{_INVISIBLE}]")
SPACE = regex.compile(f"[{_SPACES}]")
#: A maximal run of letters, marks, digits and invisible characters.
RUN = regex.compile(rf"[\p{{L}}\p{{M}}\p{{N}}{_INVISIBLE}]+")
MIXED = regex.compile(_OTHER)
LATIN = regex.compile(r"\p{Script=Latin}")
MARKED = regex.compile(r"\p{L}\p{M}+")
#: Cheap test in the JVM and here: anything outside printable ASCII.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e]*\Z")
WORD = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=65536)
def styled(c: str) -> str | None:
    """The plain form of a styled letter, digit or sign, else None."""
    if c < "\x80":
        return None
    tag = unicodedata.decomposition(c)
    plain = unicodedata.normalize("NFKC", c)
    if tag.startswith(("<font>", "<wide>", "<circle>", "<square>")) or "ﬀ" <= c <= "ﬆ" or (tag.startswith(("<super>", "<sub>")) and c > "\xff" and c != "™"):
        if tag.startswith("<square>") and len(plain) > 1:
            return None
        return plain if plain != c and all(x < "ɐ" or x in "₩€" for x in plain) and not plain.isspace() else None
    name = unicodedata.name(c, "")
    for lead in ("LATIN LETTER SMALL CAPITAL ", "NEGATIVE CIRCLED LATIN CAPITAL LETTER "):
        if name.startswith(lead) and len(name) == len(lead) + 1:
            return name[-1].lower() if "SMALL" in lead else name[-1]
    return None


def _skip(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in EMOJI.finditer(text)]


def plain_run(run: str) -> str:
    """Table form of one word run: styled forms plain, accents joined,
    invisible characters gone, look-alikes inside Latin words replaced."""
    if run.isascii() and not INVISIBLE.search(run):
        return run
    out = INVISIBLE.sub("", run)
    out = "".join(styled(c) or c for c in out)
    if MARKED.search(out):
        out = MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), out)
    if MIXED.search(out) and LATIN.search(out):
        out = "".join(LOOKALIKE.get(c, c) if not LATIN.match(c) else c for c in out)
    return out


def pieces(text: str) -> list[tuple[str, str]]:
    """Split into ("emoji" | "run" | "other", piece); joining gives the text."""
    out, at = [], 0
    for m in regex.finditer(f"(?P<e>{EMOJI.pattern})|(?P<r>{RUN.pattern})", text):
        if m.start() > at:
            out.append(("other", text[at : m.start()]))
        kind = "emoji" if m.lastgroup == "e" else "run"
        if kind == "run" and not LATIN.search(m.group()) and len(m.group()) == 1 and m.group().isdigit():
            kind = "run"
        out.append((kind, m.group()))
        at = m.end()
    if at < len(text):
        out.append(("other", text[at:]))
    return out


def plain_other(piece: str) -> str:
    piece = SPACE.sub(" ", piece)
    return "".join(styled(c) or c for c in piece)


#: A maximal stretch of letters, digits and unusual characters that holds at
#: least one unusual one; everything outside such stretches is plain already.
_ODD = r"[^\t\n\r\x20-\x7e]"
STRETCH = re.compile(rf"[A-Za-z0-9#*]*{_ODD}(?:[A-Za-z0-9]|{_ODD})*")


def _one(stretch: str, words: dict[str, str] | None) -> str:
    out = []
    for kind, piece in pieces(stretch):
        if kind == "emoji":
            out.append(piece)
        elif kind == "run":
            got = words.get(piece) if words else None
            out.append(plain_run(piece) if got is None else got)
        else:
            out.append(plain_other(piece))
    return "".join(out)


@lru_cache(maxsize=65536)
def _plain_stretch(stretch: str) -> str:
    return _one(stretch, None)


def canonical(text: str | None, words: dict[str, str] | None = None) -> str | None:
    """The text in one form; ``words`` maps runs to their chosen spelling.
    None stays None, plain text is returned unchanged."""
    if text is None or PLAIN.match(text):
        return text
    if words:
        return STRETCH.sub(lambda m: _one(m.group(), words), text)
    return STRETCH.sub(lambda m: _plain_stretch(m.group()), text)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, without regard to case."""
    return WORD.findall(text.casefold())
