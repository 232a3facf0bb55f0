"""Problem 4: personal information inside free text.

Weak supervision: generous patterns propose spans; regex, gazetteer, shape and
context labelers each vote for, against or not at all. Spans, votes and features
are written once. The vote patterns are counted over the whole corpus (their
number is bounded by 3^labelers per type), expectation-maximisation estimates how
reliable each labeler is, and a logistic span classifier, trained on the resulting
probabilities of a bounded sample of spans (:data:`SAMPLE` a type), decides every
span. Beside the votes it sees features of its own: the span's shape and first
word, the words around it and the place in its line, hashed.

The name gazetteer is learned from greetings and closings of the corpus itself and
stays a table, of any size; the names that a text may hold are joined to it.

Defined results: null or empty texts have no finds and stay as they are; look-alike
characters are read in their plain form (and the masked text is in that form);
overlapping finds keep the earlier, then the longer; repeated rows are rows of
their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm import textform as tf
from corpusloom.llm.overlap import join_hot
from corpusloom.session import cut, discard, spread, table

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}
#: Spans of each type that train the classifier (a sample by hash), and its inputs.
SAMPLE = 20_000
HASHED = 1 << 12
#: Weight of the belief, beside the corpus, that a labeler's vote means what it says.
BELIEF = 0.05

# ---- fixed values: words the labelers know ------------------------------------

TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Rev Sir Lady Capt Captain Hon Herr Frau Señor Señora Monsieur Madame Mme Barrister Chief Engr".split()
FIRMS = (
    "Inc Ltd LLC LLP GmbH plc PLC Corp Corporation Company Co Group Holdings Partners Bank Trust Capital Credit Savings Mutual Insurance Finance Financial Energy Power Water Gas Grid "
    "Telecom Mobile Wireless Broadband Media Networks Utilities Pipeline Metals Mining Freight Shipping Logistics Transit Transport Couriers Courier Express Parcel Airlines Analytics "
    "Systems Software Technologies Solutions Services Markets Market Stores Store Retail Rewards Foundation Institute University Telecoms Industries International Associates Consulting"
).split()
PLACES = "Lake Port North South East West Upper Lower New Old Mount Fort Saint St San Los Las Great Little Bay Cape Isle".split()
CALENDAR = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Mon Tue Wed Thu Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
STREETS = "Street St Avenue Ave Road Rd Drive Dr Lane Ln Court Ct Crescent Cres Close Terrace Ter Place Pl Way Boulevard Blvd Square Sq Row Walk Gardens Grove Mews Parkway Pkwy Highway Hwy Circle Cir Alley Trail Hill Quay Rise Loop".split()
COMMON = (
    "The This That These Those There Please Could Would Can Will Our Your My His Her Their We You They He She It If When After Before Attached Dear Hello Hi Hey Good Best Kind Many Thanks "
    "Thank Regards Cheers Sincerely From To Cc Subject Sent Date Re Fw Fwd Nobody Two One Not No Yes Do Don Call Ring Text Reply Ask Offer Final Winner Notice Toll Route Device Sender Collect "
    "Follow GBP EUR USD CHF Ticket Invoice Order Exit Meet Menu Between Use Write Send Team All Direct Line Office Mobile Fax Tel Phone Support Contact Agent Bring Claim Open Apply Start Settle Unlock Review And Or But For With At In On Of"
).split()
NUMBER_WORDS = "zero oh one two three four five six seven eight nine double triple".split()

TITLE, FIRM, PLACE, CAL, COMMON_SET = map(frozenset, (TITLES, FIRMS, PLACES, CALENDAR, COMMON))
_alt = "|".join
_I = regex.I

# ---- candidates ------------------------------------------------------------------

_AT = r"(?:\s*@\s*|\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+(?:AT|at)\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+(?:DOT|dot)\s+)"
_LOCAL = r"[A-Za-z0-9][\w+'-]*(?:\.[\w+'-]+)*"
_N = r"\p{Lu}[^\s,.;:!?|<>()\[\]{}\"/@0-9_#+=*~$%&]+"
#: One element of a capitalised sequence: title, initial, particle or name.
_E = rf"(?:(?:{_alt(TITLES)})\.(?=\s)|\p{{Lu}}\.(?=\s)|(?:van|von|de|der|da|di|bin|al|el|la)(?=\s\p{{Lu}})|{_N})"

CANDIDATES = {
    "email": regex.compile(rf"(?<![\w.@]){_LOCAL}{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z][\w-]*){{1,4}}(?!\w)"),
    "phone": regex.compile(
        rf"(?<![\w.,/$€£#-])(?:\+|\()?\d(?:[ .()\/-]{{0,3}}\d){{5,16}}(?![\w%])|\b(?:(?:{_alt(NUMBER_WORDS)})[ ,-]+){{6,14}}(?:{_alt(NUMBER_WORDS)})\b", _I
    ),
    "id_number": regex.compile(
        r"(?:\b(?:SSN|NINO?|NIN|TIN|ITIN|EIN|DNI|DL|NHS|(?:soc(?:ial)?\.? sec(?:urity)?|national insurance|insurance (?:no\.?|number|policy)|passport|driv(?:ing|er'?s?|er’s) licen[cs]e|licen[cs]e|tax(?:payer)?(?: id(?:entification)?)?|"
        r"identity(?: card| no\.?| number)?|ID (?:card|no\.?|number)|national(?: ID| identity(?: card)?)|personalausweis|steuer-?id|ausweis)))\b[#:.]?"
        r"(?:[ \t]*(?:no\.?|nr\.?|num(?:ber)?|id|is|card|#|:|\bfield ending\b|\bending\b))*[:#.]?[ \t]*(?P<v>[A-Z]{0,3}[ -]?\d[\dA-Z]*(?:[ -][\dA-Z]*\d[\dA-Z]*)*(?:[ -]?[A-Z]\b)?)"
        r"|(?<![\w-])(?P<s>\d{3}-\d{2}-\d{4}(?:-\d+)?|[A-CEGHJ-PR-TW-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D])(?![\w-])",
        _I,
    ),
    "street_address": regex.compile(
        rf"(?<![\w$€£.,/-])(?:(?:Flat|Apt\.?|Unit|Suite)\s+\w+,?\s+)?\d{{1,5}}[A-Za-z]?,?\s+(?:{_N}\s+){{1,4}}(?:{_alt(STREETS)})\b"
        r"|\b\p{Lu}[^\s,0-9]*(?:stra(?:ß|ss|\W{1,4}|Ã\S)e|str\.|gasse|allee|weg|platz|ring|damm|ufer)\s+\d{1,4}\s?[a-z]?\b|\b\p{Lu}[\p{L}]+(?:\s\p{Lu}[\p{L}]+)?\s(?:Straße|Allee|Gasse|Weg|Platz)\s+\d{1,4}\b"
        r"|(?<![\w$€£.])\d{1,4}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|all\S{1,3}e|quai|impasse)\s+(?:(?:de|du|des|la|le|les|l['’])\s*)*\p{Lu}[\p{L}\p{S}'’-]+"
        r"|\b(?:Calle|Avenida|Avda\.|Paseo|Plaza|Rua|Via|Viale|Piazza)\s+(?:(?:de|del|la|las|los|da|do|dos|das)\s+)*\p{Lu}[\p{L}\p{S}'’-]+(?:\s\p{Lu}[\p{L}]+)?,?\s+\d{1,4}\b"
    ),
    "person_name": regex.compile(rf"(?<![\p{{L}}\d@._-]){_E}(?:[ \n]{_E})*"),
}

CUES = {
    "email": regex.compile(r"\b(?:e-?mail|mail|write|send|contact|support|use|address|to|from|reach|at)\b\W*(?:it )?(?:to )?\W*$", _I),
    "phone": regex.compile(r"\b(?:call|ring|dial|tel|telephone|phone|ph|fax|cell|mobile|whatsapp|sms|text|line|desk|office|reach|contact|voice|hotline|goes to|reach the desk at|me on|number is|cell is)\b(?:\s+(?:me|us|on|at|is|to|now|or|line))*[\s.:(+|-]*$", _I),
    "id_number": regex.compile(r".$"),
    "street_address": regex.compile(r"\b(?:deliver(?:ed)?|address|drop-?off|moved?|lives?|located|ship|send|viewing is|visit|home|office|at|to|on file)\b[^\d]{0,14}$", _I),
    "person_name": regex.compile(r"\b(?:dear|hi|hello|hey|fao|attn|attention|from|to|by|agent|mr|sir|with|sincerely|regards|thanks|cheers|wrote|cc|on|name(?: is)?|late|called|ask|contact)\b[\s:,.]*$|\n\s*$|^\s*$", _I),
}
AGAINST = {
    "email": regex.compile(r"(?:follow|intranet)\W*$", _I),
    "phone": regex.compile(
        r"\b(?:order|invoice|ticket|case|ref(?:erence)?|file|code|pin|id|box|account|acct|conference id|version|build|isbn|sku|tracking|between|and|took|rows?|ssn|sec(?:urity)?|passport|licen[cs]e|dl|insurance|tax(?:payer)?|tin|identity|number|no|nino?|stop to|help to|yes to|info to)\b(?:\s+(?:no|number|nr|is|id|to|code|card))*\W*$",
        _I,
    ),
    "id_number": regex.compile(r"\b(?:ticket|order|invoice|case|ref(?:erence)?|tracking|version|build)\b\W*$", _I),
    "street_address": regex.compile(r"\b(?:exit|room|building|page|bus|route|between|over|about|after)\b\W*$", _I),
    "person_name": regex.compile(r"\b(?:in|near|the|at|between|towards?|reach|bank|of)\s*$", _I),
}


class Gazetteer:
    """Given names, learned from the corpus: a table, or a few of them as a set."""

    def __init__(self, given: frozenset[str] | None = None, names: DataFrame | None = None):
        self.names, self._given = names, given

    @property
    def given(self) -> frozenset[str]:
        if self._given is None:  # only for texts looked at one by one
            self._given = frozenset(r.word for r in self.names.collect())
        return self._given


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def spans(text: str, gaz: Gazetteer) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """(type, start, end, votes) of every candidate."""
    has_digit = any(c.isdigit() for c in text)
    for kind in TYPES:
        if kind == "email" and "@" not in text and not regex.search(r"\bat\b|\bAT\b|\[at\]|\(at\)", text):
            continue
        if kind in ("id_number", "street_address") and not has_digit:
            continue
        for m in CANDIDATES[kind].finditer(text):
            a, b = m.span()
            if kind == "person_name":
                yield from _names(text, a, b, gaz)
                continue
            before, after = text[max(0, a - 40) : a], text[b : b + 24]
            value = m.group()
            cue = 1 if CUES[kind].search(before) else 0
            anti = -1 if AGAINST[kind].search(before) else 0
            if kind == "email":
                plain = "@" in value
                dots = bool(regex.search(r"\.|\bdot\b", value, _I))
                marked = bool(regex.search(r"[\[({<]\s*(?:at|@|dot)\s*[\])}>]|\sAT\s|\sDOT\s", value))
                loose = not plain and not marked
                shape = 1 if plain and dots else 1 if marked else (1 if regex.search(r"\bat\b.*\bdot\b", value) else -1)
                tld = 1 if regex.search(r"(?:\.|dot\W*)(?:com|org|net|edu|gov|example|test|invalid|info|io|[a-z]{2})$", value, _I) else 0
                yield kind, a, b, (shape, tld, cue, anti, -1 if loose and shape < 0 else 0)
            elif kind == "phone":
                words = bool(regex.match(r"[a-z]", value, _I))
                n = sum(regex.sub(r"\W", "", w).lower() not in ("double", "triple") for w in regex.split(r"[ ,-]+", value)) if words else _digits(value)
                n += len(regex.findall(r"\bdouble\b", value, _I)) + 2 * len(regex.findall(r"\btriple\b", value, _I)) if words else 0
                length = 1 if 9 <= n <= 15 else -1
                shaped = 1 if words or regex.match(r"\+|00\d|\(?0\d{2,4}\)?[ -]|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$|1[ -]\d{3}[ -]\d{3}[ -]\d{4}$|(?:\d ){8,}\d$|0\d(?:[ .]\d\d){4}$|0\d{9,10}$|0\d{4} \d{6}$", value) else 0
                other = -1 if regex.match(r"\d{3}-\d{2}-\d{4}(?:-\d+)?$|(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b|\d{1,3}(?:\.\d{1,3}){3}$|\d{3} \d{2} \d{4}$|\d\d-\d{7}$|\d{4}[ -]\d{4}[ -]\d{3}$", value) else 0
                bare = -1 if regex.match(r"\d+$", value) and not value.startswith("0") else 0
                tail = -1 if regex.match(r"\s*(?:rows|units|shipped|tries|covers|is closed|items|-\d)", after) else 0
                yield kind, a, b, (length, shaped, other, cue, min(anti, tail), bare)
            elif kind == "id_number":
                v = m.group("v") or m.group("s") or ""
                key = 1 if m.group("v") else 0
                n = _digits(v)
                length = 1 if n >= 6 and n <= 14 else -1
                partial = -1 if regex.search(r"\bending\b|\bfield\b", value, _I) or regex.match(r"\s*(?:is masked|fee|charge)", after) else 0
                shaped = 1 if regex.match(r"\d{3}[- ]?\d{2}[- ]?\d{4}$|[A-Z]{2}[ -]?(?:\d{2}[ -]?){3}[A-D]$|[A-Z]{1,2}\d{6,8}$|\d{2}-\d{7}$|[A-Z]\d{4}[ -]\d{5}$|\d{4}[ -]\d{4}[ -]\d{3}$|\d{11}$|\d{9}$", v, _I) else 0
                long_tail = -1 if regex.match(r"\d{3}-\d{2}-\d{4}-\d", v) else 0
                yield kind, a, b, (key, length, shaped, min(partial, anti), long_tail)
            else:
                named = 1 if regex.search(rf"\s(?:{_alt(STREETS)})$", value) else 1 if regex.search(r"\d\s?[a-z]?$|^\d", value) else 0
                firm = -1 if any(w in FIRM for w in value.split()[:-1]) else 0
                zip_ = 1 if regex.match(r",?\s*(?:(?:Apt|Flat|Unit|Suite)\.? \w+)?,?\s*\p{Lu}\w+(?:\s\p{Lu}\w+)?(?:,\s*[A-Z]{2}\s+\d{5})?", after) else 0
                cal = -1 if any(w in CAL for w in value.split()) else 0
                yield kind, a, b, (named, cue, zip_, min(firm, cal), anti)


def _names(text: str, a: int, b: int, gaz: Gazetteer) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """Windows of a capitalised sequence that could be a person's name."""
    toks = [(m.group(), a + m.start(), a + m.end()) for m in regex.finditer(r"\S+", text[a:b])]
    i = 0
    while i < len(toks):
        word = toks[i][0].rstrip(".")
        street = regex.search(r"\d\s+(?:\p{Lu}\w+\s)+$", text[max(0, toks[i][1] - 30) : toks[i][1]]) if word == "Dr" else None
        title = word in TITLE and not (street and street.group().split()[-1] not in COMMON_SET)
        j = i + 1 if title else i
        if title and j >= len(toks):
            break
        given = j < len(toks) and _is_given(toks[j][0], gaz)
        end = j
        if given or not title:
            k = j + 1
            while k < len(toks) and regex.fullmatch(r"\p{Lu}\.|van|von|de|der|da|di|bin|al|el|la", toks[k][0]):
                k += 1
            end = k
        family = toks[end][0] if end < len(toks) else None
        if title and family is None:
            family, end = toks[j][0], j
        if family is None:
            i += 1
            continue
        last = family.rstrip(".'’")
        alone = title and end == j
        before = text[max(0, toks[i][1] - 24) : toks[i][1]]
        nxt = toks[end + 1][0].rstrip(".,") if end + 1 < len(toks) else ""
        bad = last in FIRM or last in CAL or last in COMMON_SET or last in PLACE or last in TITLE or (toks[j][0] in PLACE) or (toks[j][0] in COMMON_SET) or (toks[j][0] in CAL and not given)
        road = last in STREETS
        votes = (
            1 if title else 0,
            1 if given else -1 if not title else 0,
            -1 if bad or road else 1 if not _is_given(last, gaz) and nxt not in FIRM else 0,
            1 if CUES["person_name"].search(before) else 0,
            -1 if not title and AGAINST["person_name"].search(before) else 0,
            -1 if last.isupper() and len(last) > 1 and not alone else 0,
        )
        if given or title:
            yield "person_name", toks[i][1], toks[end][2], votes
            i = end + 1
        else:
            yield "person_name", toks[i][1], toks[end][2], votes
            i += 1


def _is_given(word: str, gaz: Gazetteer) -> bool:
    return word in gaz.given or (not word.isascii() and regex.sub(r"[^A-Za-z]+", "*", word) in gaz.given)


# ---- learning -----------------------------------------------------------------------

GREETED = r"(?:^|\n)(?:Hi|Hello|Dear|Hey|Good morning|Good afternoon)\s+(\p{Lu}[\p{Ll}\p{L}]+)\s*[,:!\n-]"
CLOSED = r"(?:[Rr]egards|[Tt]hanks|[Tt]hank you|Cheers|Sincerely|Best|soon|faithfully|Yours)\s*,\s*\n\s*(\p{Lu}[\p{Ll}\p{L}]+)\s*(?:\n|$)"


def learn_gazetteer(records: DataFrame, least: int = 2) -> Gazetteer:
    """Names that greet or sign; counted in the JVM over all records."""
    found = F.explode(F.concat(F.regexp_extract_all("text", F.lit(GREETED), F.lit(1)), F.regexp_extract_all("text", F.lit(CLOSED), F.lit(1)))).alias("word")
    names = records.select(found).groupBy("word").count().where((F.col("count") >= least) & ~F.col("word").isin([*COMMON, *TITLES, *CALENDAR])).select("word")
    # Accented names also match when their accents were lost or garbled.
    return Gazetteer(names=cut(names.unionByName(names.where(F.col("word").rlike(r"[^\x00-\x7f]")).select(_garbled("word").alias("word"))).distinct()))


def _garbled(c: str | Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]+", "*")


def plain(text: str) -> str:
    return tf.canonical(text)


@F.pandas_udf(StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else plain(t))


def with_names(records: DataFrame, gaz: Gazetteer) -> DataFrame:
    """src, rec_id, text, plain and the gazetteer's names that occur in it. Equal
    records share their names, which are joined by the hash of the record."""
    odd = F.col("text").rlike(r"[^\t\n\r\x20-\x7e]")
    rows = records.select("src", "rec_id", "text", F.when(odd, _plain("text")).otherwise(F.col("text")).alias("plain"))
    rows = cut(rows.withColumn("row", F.xxhash64("src", "rec_id", "text")))
    found = F.array_distinct(F.regexp_extract_all("plain", F.lit(r"(\p{Lu}[^\s,.;:!?|<>()\[\]{}\"/@0-9_#+=*~$%&]+)"), F.lit(1)))
    one = F.explode(F.array_distinct(F.flatten(F.transform(found, lambda w: F.array(w, F.regexp_replace(w, "['’]+$", ""), F.when(w.rlike(r"[^\x00-\x7f]"), _garbled(w)).otherwise(w)))))).alias("word")
    words = rows.select("row", one)
    freq = cut(words.groupBy("word").agg(F.count("*").alias("freq")).join(gaz.names, "word", "left_semi"))
    total = freq.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    names = join_hot(words, freq, "word", "freq", total).groupBy("row").agg(F.collect_set("word").alias("names"))
    return rows.join(names, "row", "left").drop("row")


_TOKEN, _OWN, _AGAIN = re.compile(r"\w+|[^\w\s]|\n"), re.compile(r"\w+"), re.compile(r"(.)\1+", re.S)


def _form(value: str) -> str:
    return _AGAIN.sub(r"\1", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in value))


def features(text: str, a: int, b: int) -> list[int]:
    """Hashed: shape, first and last word of the span, words around it, place."""
    value = text[a:b]
    left = _TOKEN.findall(text[max(0, a - 40) : a].lower())[-3:]
    right = _TOKEN.findall(text[b : b + 40].lower())[:2]
    own = ["9" if x[0].isdigit() else x for x in _OWN.findall(value[:200].lower())] or [""]
    got = ["s" + _form(value[:60]), "f" + own[0], "e" + own[-1], f"n{min(len(own), 8)}", "2" + " ".join(left[-2:])]
    got += [f"l{i}{w}" for i, w in enumerate(reversed(left))] + [f"r{i}{w}" for i, w in enumerate(right)]
    got.append("b" + ("^" if a == 0 or text[a - 1] == "\n" else "") + ("$" if b == len(text) or text[b] == "\n" else ""))
    return sorted({xxhash.xxh32_intdigest(g) % HASHED for g in got})


def candidates(records: DataFrame, gaz: Gazetteer) -> DataFrame:
    """src, rec_id, text, plain (null if it is the text) and the spans proposed in
    it, with votes and features. Written once; all later steps read it."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, names in zip(pdf["plain"], pdf["names"]):
                own = Gazetteer(frozenset(names if names is not None else ()))
                out.append([] if not t else [(k, a, b, list(v), features(t, a, b)) for k, a, b, v in spans(t, own)])
            same = pdf["plain"].where(pdf["plain"] != pdf["text"], None)
            yield pd.DataFrame({"src": pdf["src"], "rec_id": pdf["rec_id"], "text": pdf["text"], "plain": same, "spans": out})

    kind = "array<struct<kind:string,a:int,b:int,votes:array<tinyint>,f:array<smallint>>>"
    return cut(with_names(records, gaz).mapInPandas(go, f"src string, rec_id bigint, text string, plain string, spans {kind}"))


def patterns_of(found: DataFrame) -> dict[str, Counter]:
    got = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    out: dict[str, Counter] = {k: Counter() for k in TYPES}
    for r in got:
        out[r.kind][tuple(r.votes)] += r.n
    return out


def count_patterns(records: DataFrame, gaz: Gazetteer) -> dict[str, Counter]:
    """Vote patterns of all candidates of all records."""
    return patterns_of(candidates(records, gaz))


def sampled(found: DataFrame, patterns: dict[str, Counter]) -> dict[str, list[tuple]]:
    """About SAMPLE (votes, features) of each type, by the hash of the span."""
    share = F.coalesce(*(F.when(F.col("s.kind") == k, F.lit(min(1.0, SAMPLE / max(1, sum(n.values()))))) for k, n in patterns.items()))
    u = F.pmod(F.xxhash64("src", "rec_id", "s.kind", "s.a"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out: dict[str, list[tuple]] = {k: [] for k in TYPES}
    for r in found.select("src", "rec_id", F.explode("spans").alias("s")).where(u < share).select("s.kind", "s.votes", "s.f").collect():
        out[r.kind].append((tuple(r.votes), r.f))
    return out


def estimate(patterns: Counter, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over labelers that are independent given the truth: patterns, their
    weights and P(true). A labeler's reliability is P(vote | truth), estimated from
    the corpus and from BELIEF of its size in spans where the vote is right, which
    keeps the two classes from trading places."""
    if not patterns:
        return np.zeros((0, 0), dtype=int), np.zeros(0), np.zeros(0)
    votes = np.array(sorted(patterns), dtype=int)
    n = np.array([patterns[tuple(v)] for v in votes], dtype=float)
    belief = BELIEF * n.sum() + 2
    # Start: labelers' plain majority, an opposing vote weighing double.
    q = 1 / (1 + np.exp(-(1.5 * (votes == 1).sum(1) - 3.0 * (votes == -1).sum(1) - 1.0)))
    for _ in range(rounds):
        pi = np.clip((n * q).sum() / n.sum(), 0.01, 0.99)
        logit = np.full(len(votes), math.log(pi / (1 - pi)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                sure = belief * (v == 1), belief * (v == -1)
                yes = ((n * q)[at].sum() + 1 + sure[0]) / ((n * q).sum() + 3 + belief)
                no = ((n * (1 - q))[at].sum() + 1 + sure[1]) / ((n * (1 - q)).sum() + 3 + belief)
                logit[at] += math.log(yes / no)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return votes, n, q


class SpanClassifier:
    """Logistic regression on votes (one weight per labeler and vote) and features."""

    def __init__(self, weights: dict[str, np.ndarray], own: dict[str, np.ndarray] | None = None):
        self.weights, self.own = weights, own or {}
        self.memo: dict = {}

    @staticmethod
    def features(votes: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(votes), 1)), votes == 1, votes == -1]).astype(float)

    @classmethod
    def train(cls, patterns: dict[str, Counter], sample: dict[str, list[tuple]] | None = None, rounds: int = 400) -> SpanClassifier:
        """On the votes of all patterns; then, with a sample, on features as well."""
        weights, own = {}, {}
        for kind, seen in patterns.items():
            votes, n, q = estimate(seen)
            if not len(votes):
                continue
            x, w = cls.features(votes), np.sqrt(n) / np.sqrt(n).sum()
            beta = np.zeros(x.shape[1])
            for _ in range(rounds):  # Newton steps with a ridge
                p = 1 / (1 + np.exp(-x @ beta))
                h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(beta))
                step = np.linalg.solve(h, x.T @ (w * (q - p)) - 1e-4 * beta)
                beta += np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-6:
                    break
            weights[kind] = beta
            if sample and sample.get(kind):
                own[kind] = cls._learn(sample[kind], dict(zip(map(tuple, votes.tolist()), q)), beta)
        return cls(weights, own)

    @classmethod
    def _learn(cls, sample: list[tuple], truth: dict[tuple, float], beta: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Weights of the hashed features beside the votes: gradient steps with a ridge."""
        q = np.array([truth[v] for v, _ in sample])
        base = cls.features(np.array([v for v, _ in sample])) @ beta
        rows = np.repeat(np.arange(len(sample)), [len(f) for _, f in sample])
        cols = np.concatenate([np.asarray(f, np.int64) for _, f in sample])
        count = np.bincount(cols, minlength=HASHED)
        w = np.zeros(HASHED)
        for _ in range(rounds):
            z = base + np.bincount(rows, w[cols], minlength=len(sample))
            g = np.bincount(cols, (q - 1 / (1 + np.exp(-np.clip(z, -30, 30))))[rows], minlength=HASHED)
            w += 0.5 * (g - 0.5 * w) / (count + 5.0)
        return w

    def accept(self, kind: str, votes: tuple[int, ...], own: list[int] | None = None) -> bool:
        key = (kind, votes)
        if key not in self.memo:
            beta = self.weights.get(kind)
            self.memo[key] = -math.inf if beta is None else float((self.features(np.array([votes])) @ beta)[0])
        w = self.own.get(kind)
        return self.memo[key] + (float(w[own].sum()) if w is not None and own is not None and len(own) else 0.0) > 0


def chosen(got: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """Accepted spans that do not overlap, in order."""
    out, end = [], -1
    for a, b, _, k in sorted((a, -b, TYPES.index(k), k) for a, b, k in got):
        if a >= end:
            out.append((k, a, -b))
            end = -b
    return out


def finds(text: str, gaz: Gazetteer, model: SpanClassifier) -> list[tuple[str, int, int]]:
    """Finds in one text."""
    return chosen([(a, b, k) for k, a, b, v in spans(text, gaz) if model.accept(k, v, features(text, a, b) if model.own else None)])


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def redact(records: DataFrame, classify: bool = True) -> DataFrame:
    """src, rec_id, text with placeholders, finds (type, value): one row per row.
    ``classify`` switches the span classifier's own features off."""
    gaz = learn_gazetteer(records)
    found = candidates(records, gaz)
    discard(gaz.names)
    patterns = patterns_of(found)
    model = SpanClassifier.train(patterns, sampled(found, patterns) if classify else None)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, out = [], []
            for t, p, all_ in zip(pdf["text"], pdf["plain"], pdf["spans"]):
                p = t if p is None else p
                got = chosen([(x["a"], x["b"], x["kind"]) for x in all_ if model.accept(x["kind"], tuple(x["votes"]), x["f"])])
                texts.append(mask(p, got) if got else t)
                out.append([{"pii_type": k, "value": p[a:b]} for k, a, b in got])
            yield pd.DataFrame({"src": pdf["src"], "rec_id": pdf["rec_id"], "text": texts, "finds": out})

    return found.mapInPandas(go, "src string, rec_id bigint, text string, finds array<struct<pii_type:string,value:string>>")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("src"), F.col("rec_id").cast("bigint").alias("rec_id"), "text") for n in ("smishtank_prepared", "mendeley_smishing_prepared", "enron_ham_annotated")]
    return spread(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and type of personal information found."""
    out = redact(_records(spark, sf_dir))
    return out.select("src", "rec_id", F.explode(F.array_distinct(F.transform("finds", lambda x: x["pii_type"]))).alias("pii_type"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with typed placeholders, and its finds."""
    return redact(_records(spark, sf_dir))
