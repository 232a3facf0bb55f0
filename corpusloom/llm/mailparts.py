"""Problem 6: quoted history, signatures and legal notices in mails.

A recursive layout grammar turns each mail into a tree::

    mail       := part*
    part       := quote | history | signature | device | notice | authored
    quote      := attribution? prefixed-lines      (their content is an old mail)
    history    := (separator | header-block) (prefixed-lines mail | old mail)
                | attribution (prefixed-lines mail | old mail | old paragraph mail)
    signature  := delimiter? line{name} line{role, firm, phone, address}+
    notice     := rule? paragraph{legal cues} rule?

The history of a reply goes to the end of the mail, unless it is prefixed (then it
ends with its prefixes) or an attribution opens the mail (then it is followed by
one old paragraph, and the reply stands below). What stands below is a mail of its
own inside the history's node, and newly written. The tree is serialised
recursively: only nodes that are newly authored, wherever they hang, are kept.
Parsing is linear in the length of the mail for each level of nesting and runs on
whole texts, one mail at a time.

Defined results: a null text gives a null authored text and no parts; an empty
text stays empty; a mail that is all history has an empty authored text;
nesting beyond 40 levels is kept as one leaf; repeated rows are rows of their
own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.mojibake import mails

MAX_DEPTH = 40
_I = regex.I | regex.V0

PREFIX = regex.compile(r"^[ \t]{0,8}[>|](?: ?(?=\S)|[ \t]*$|[ \t])")
SEPARATOR = regex.compile(
    r"^\s*[-_=*]{2,}\s*(?:original message|original appointment|forwarded (?:message|by\b.*)|begin forwarded message|reply message|"
    r"ursprüngliche nachricht|weitergeleitete nachricht|message d.origine|message transféré|mensaje original|mensaje reenviado|mensagem original)\b.*$|^\s*begin forwarded message:?\s*$",
    _I,
)
HEADER = regex.compile(r"^\s*\**(from|sent|date|to|cc|bcc|subject|reply-to|von|gesendet|an|betreff|de|envoyé|à|objet|para|asunto|enviado|assunto)\**\s*:\s*(.*)$", _I)
_DATE = r"(?=.*\d{1,4}\s*[./-]\s*\d{1,2}|.*\b(?:19|20)\d\d\b|.*\d{1,2}:\d\d)"
#: Attribution lines name a date and a verb of writing; the verbs may be garbled.
ATTRIBUTION = regex.compile(
    rf"^\s*(?:On\b{_DATE}.*\bwrote\s*:|Am\b{_DATE}.*\bschrieb\b.*:|Le\b{_DATE}.*\ba \S{{1,8}}crit\s*:|El\b{_DATE}.*\bescribi\S{{1,8}}\s*:|Em\b{_DATE}.*\bescreveu\s*:"
    rf"|\S.*<[^<>\s]+@[^<>\s]+>\s*(?:said|wrote|writes|schrieb)\b.{{0,40}}:|(?=.{{0,120}}$){_DATE}\S.*\b(?:said on|wrote on)\b.{{0,30}}:)\s*$",
    _I,
)
STAMP = regex.compile(r"^\s*\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\s+\d{1,2}:\d\d(?::\d\d)?\s*(?:[AP]M)?\s*$", _I)
RULE = regex.compile(r"^\s*(?:[-_=*~#]\s?){2,}\s*$")
DEVICE = regex.compile(
    r"^\s*(?:sent (?:from|via|by|with) (?:my|a|an|the|mobile|outlook|yahoo|mail|iphone|android|phone)\b.{0,60}|get the .{0,40}\b(?:mail|app)\b.{0,40}|"
    r"get (?:outlook|gmail|mail)\b.{0,40}|envoy\S{1,8} (?:de|depuis) mon\b.{0,40}|(?:von|gesendet von) mein\w* .{0,40}|gesendet von .{0,40}|enviado (?:desde|do|de) mi?e?u?\b.{0,40}|inviato da(?:l mio)? .{0,40})$",
    _I,
)
CLOSING = regex.compile(
    r"^\s*(?:(?:best|kind|warm|many|with best|with kind)\s+)?(?:regards|wishes|thanks|thank you|cheers|sincerely|yours (?:faithfully|sincerely|truly)|talk soon|best|"
    r"remain blessed|god bless|mit freundlichen gr\S+en|viele gr\S+e|cordialement|bien \S+ vous|saludos(?: cordiales)?|un saludo|atenciosamente|abra\S+os)\s*[,.!]?\s*$",
    _I,
)
#: Words of roles; a signature line names one of them, or a firm.
ROLE = regex.compile(
    r"\b(?:engineer|scheduler|director|manager|analyst|administrator|assistant|paralegal|officer|head|lead|president|vp|vice president|counsel|attorney|accountant|consultant|"
    r"coordinator|specialist|supervisor|secretary|trader|broker|controller|auditor|associate|partner|partners|clerk|representative|executive|chair(?:man|woman)?|treasurer|desk|"
    r"risk control|operations|settlements|contracts|sales|marketing|support|department|dept|division|team|office|ltd|inc|llc|llp|gmbh|plc|corp|group|holdings)\b",
    _I,
)
PHONE = regex.compile(r"(?<![\w/])(?:\+|00|\()?\d[\d\s().\-]{6,18}\d(?!\w)")
EMAIL = regex.compile(r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)+")
STREET = regex.compile(
    r"^\s*\d{1,5}\s+\p{Lu}[\w'’-]*(?:\s+\p{Lu}[\w'’-]*)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Crescent|Close|Terrace|Place|Pl|Way|Boulevard|Blvd|Square|Row|Walk|Hill)\b"
    r"|(?:^|,\s)\s*\p{Lu}\w*(?:straße|strasse|stra\S{1,4}e|gasse|allee|weg|platz|ring)\s+\d+|^\s*\d{1,4},?\s+(?:rue|avenue|boulevard|place|chemin)\b|^\s*(?:calle|rua|via|avenida|paseo)\s+\p{Lu}.*\d",
    regex.V0,
)
LABELLED = regex.compile(r"^\s*(?:ph|phone|tel|fax|office|mobile|cell|direct(?: line)?|desk|voice)\b\.?\s*:?\s*[+(]?\d", _I)

CUES = [
    regex.compile(p, _I)
    for p in (
        r"\bconfidential(?:ity)?\b|\bprivileged\b|vertraulich|confidentiel|confidencial",
        r"\b(?:this|the|information in this|any)\s+(?:e-?mail|message|transmission|communication)\b|confidential communication|\battachments?\b|diese e-?mail|diese nachricht|ce message|este (?:mensaje|correo)",
        r"\b(?:named|intended) recipient\b|\bintended (?:solely|only)\b|\baddressee\b|\bnot meant for you\b|destinataire|destinatario|empfänger",
        r"\bunauthori[sz]ed\b|\bunlawful\b|\bprohibited\b|\bcopying or\b|\bdisclos\w+\b|\bread, print or store\b|\bmay hold privileged\b",
        r"\b(?:received|receive) (?:it|this)\b.{0,30}\berror\b|\bdelete (?:every|all|it|this)\b|\bdestroy it\b|\bnotify the sender\b",
        r"\bno liability\b|\bliab(?:le|ility) for\b|\bviews (?:or opinions )?expressed\b|\bnot those of\b|\bforms? (?:a|any) contract\b|\bvirus(?:es)?\b",
    )
]


@dataclass
class Node:
    """kind: authored, closing, quoted, signature or disclaimer. ``inner`` is the
    content of a quoted part, ``below`` the mail that goes on behind it."""

    kind: str
    lines: list[str]
    inner: list[Node] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)


def is_notice(text: str) -> bool:
    """At least two legal cues, one of them beyond naming the message."""
    if len(text) < 40:
        return False
    hits = [bool(c.search(text)) for c in CUES]
    return sum(hits) >= 2 and any(hits[2:] + [hits[0] and hits[1]])


def _headers(lines: list[str], i: int) -> int:
    """Length of a header block at i: two or more header lines, the first From."""
    n, names, sender = 0, [], ""
    while i + n < len(lines) and (m := HEADER.match(lines[i + n])):
        sender = sender or m.group(2).strip()
        names.append(m.group(1).lower())
        n += 1
    if n >= 2 and names[0] in ("from", "von", "de") and len(set(names)) == n and _sender(sender):
        return n
    return 0


def _sender(value: str) -> bool:
    """An address, or a name: no sentence."""
    return "@" in value or (len(value.split()) <= 8 and not regex.search(r"[.!?]$", value)) or bool(regex.search(r"\b(?:Jr|Sr|Inc|Ltd|Co|Corp)\.$", value))


def _lotus(lines: list[str], i: int) -> int:
    """Name, date stamp, To: lines of older mail programs."""
    if i + 2 < len(lines) and lines[i].strip() and len(lines[i]) < 80 and STAMP.match(lines[i + 1]):
        m = HEADER.match(lines[i + 2])
        if m and m.group(1).lower() == "to":
            return 3
    return 0


def _history(lines: list[str], i: int) -> int:
    if SEPARATOR.match(lines[i]):
        return 1
    return _headers(lines, i) or _lotus(lines, i)


def _contact(line: str) -> bool:
    return bool(EMAIL.search(line) or LABELLED.match(line) or STREET.search(line) or (PHONE.search(line) and sum(c.isdigit() for c in line) >= 7 and len(PHONE.sub("", line)) < 28))


def _sig_line(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 90 and not regex.search(r"[.!?]$|[;]|\[URL\]", s) and len(s.split()) <= 12 and not CLOSING.match(s)


def _signature(block: list[str], after_rule: bool) -> int:
    """Index in the block where a signature starts, or -1. A closing with only
    a name above it stays with the author. One pass from the end finds where lines
    of a signature begin and what stands below each of them."""
    found, contact, roles, divided = -1, 0, 0, False
    for start in range(len(block) - 1, -1, -1):
        line = block[start]
        if not _sig_line(line):
            break
        touch = _contact(line)
        contact += touch
        roles += bool(ROLE.search(line))
        divided = divided or bool(regex.search(r"\||\s[-–—]\s", line))
        above = block[start - 1] if start else None
        if above is not None and not CLOSING.match(above) and not regex.match(r"^\s*\p{L}[\w'’.-]*\s*$", above) and not RULE.match(above):
            continue
        size = len(block) - start
        named = bool(regex.match(r"^(?:\p{Lu}\S*\s+){1,4}\p{Lu}\S*$", line.strip())) and not touch
        if size >= 2 and ((named and contact) or (after_rule and (contact or roles or named)) or (named and roles and divided)):
            found = start
    return found


def _prefixed(lines: list[str], i: int) -> int:
    """End of the prefixed lines that start at i (blank lines between them included)."""
    j = i
    while j < len(lines) and (PREFIX.match(lines[j]) or (not lines[j].strip() and j + 1 < len(lines) and PREFIX.match(lines[j + 1]))):
        j += 1
    return j


def _blank(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


def _paragraph(lines: list[str], i: int) -> int:
    while i < len(lines) and lines[i].strip():
        i += 1
    return i


def _quoted(lines: list[str], i: int, body: int, end: int, depth: int) -> Node:
    """The part from i to end, whose old content starts at body."""
    inner = [PREFIX.sub("", x, count=1) if PREFIX.match(x) else x for x in lines[body:end]]
    return Node("quoted", lines[i:end], parse(inner, depth + 1))


def parse(lines: list[str], depth: int = 0) -> list[Node]:
    """The parts of a mail, in order."""
    if depth >= MAX_DEPTH:
        return [Node("authored", lines)]
    root: list[Node] = []
    out = root  # where parts go: into the mail, or below the last history
    i, n = 0, len(lines)
    block: list[str] = []
    ruled: list[str] = []  # a rule waiting for what it introduces

    def flush() -> None:
        nonlocal block, ruled
        if not block:
            return
        text = " ".join(block)
        start = _signature(block, bool(ruled))
        if is_notice(text):
            out.append(Node("disclaimer", ruled + block))
        elif start >= 0:
            if start:
                out.append(Node("authored", block[:start]))
            out.append(Node("signature", ruled + block[start:]))
        else:
            kind = "closing" if CLOSING.match(block[0]) else "authored"
            out.append(Node(kind, ruled + block))
        block, ruled = [], []

    while i < n:
        line = lines[i]
        if PREFIX.match(line):
            flush()
            j = _prefixed(lines, i)
            inner = [PREFIX.sub("", x, count=1) for x in lines[i:j]]
            out.append(Node("quoted", lines[i:j], parse(inner, depth + 1)))
            i = j
        elif (k := _history(lines, i)) or ATTRIBUTION.match(line):
            flush()
            j = _blank(lines, i + (k or 1))
            while j < n and (more := _history(lines, j)):  # headers below a separator
                j = _blank(lines, j + more)
            end = _prefixed(lines, j)
            if end == j:  # no prefixes: to the end, or one paragraph of a reply from below
                end = n if k or out else _paragraph(lines, j)
            out.append(_quoted(lines, i, j, end, depth))
            out = out[-1].below
            i = end
        elif not line.strip():
            flush()
            i += 1
        elif DEVICE.match(line):
            flush()
            out.append(Node("signature", [line]))
            i += 1
        elif RULE.match(line):
            flush()
            ruled = [line]
            if out and out[-1].kind == "disclaimer" and len(out[-1].lines) and RULE.match(out[-1].lines[0]):
                out[-1].lines.append(line)  # the closing rule of a framed notice
                ruled = []
            i += 1
        else:
            block.append(line)
            i += 1
    flush()
    if ruled:
        out.append(Node("authored", ruled))
    return root


def newly(nodes: list[Node]) -> Iterator[Node]:
    """The parts that are not old: those of the mail, and those below old ones."""
    todo = [iter(nodes)]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            continue
        yield x
        todo.append(iter(x.below))


def split_mail(text: str | None) -> tuple[str | None, list[str]]:
    """(newly written text, sorted kinds taken out)."""
    if text is None:
        return None, []
    parts = list(newly(parse(text.replace("\r\n", "\n").split("\n"))))
    kinds = sorted({x.kind for x in parts} & {"quoted", "signature", "disclaimer"})
    if not kinds:
        return text, []
    return "\n\n".join("\n".join(x.lines) for x in parts if x.kind in ("authored", "closing")).strip(), kinds


def reduce_mails(records: DataFrame) -> DataFrame:
    """src, rec_id, authored, parts: one row per input row with src, rec_id, text."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [split_mail(t) for t in pdf["text"]]
            yield pd.DataFrame({"src": pdf["src"], "rec_id": pdf["rec_id"], "authored": [x[0] for x in got], "parts": [x[1] for x in got]})

    return records.select("src", "rec_id", "text").mapInPandas(go, "src string, rec_id bigint, authored string, parts array<string>")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mail and kind taken out."""
    return reduce_mails(mails(spark, sf_dir)).select("src", "rec_id", F.explode("parts").alias("part_kind"))


def p6_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail with only what its sender newly wrote."""
    return reduce_mails(mails(spark, sf_dir)).select("src", "rec_id", F.col("authored").alias("text"), "parts")
