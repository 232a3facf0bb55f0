"""Problem 5: broken prompt and response pairs.

Responses and their sentences are sorted by text and compared with their successor,
which finds shortened versions of other responses; length-limit spikes and the counts
of each response's last phrase (:mod:`corpusloom.llm.endings`) find those whose longer
version is not there; copy, refusal and language rules apply to the whole response. A
pair has one defect, the first of empty, copies_prompt, refusal, wrong_language,
truncated.

Defined results: a null or blank response, or one that is only a placeholder, is
empty whatever the prompt; a null prompt asks for nothing in particular (English)
and cannot be copied; repeated pairs are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import overlap
from corpusloom.llm import textform as tf
from corpusloom.llm.endings import with_verdict
from corpusloom.session import spread, table

_I = regex.I
PLACEHOLDER = regex.compile(
    r"[\W_]*|[\[(<{*\"']*\s*(?:null|none|nil|nan|n/?a|n\.a\.|undefined|empty|blank|missing|tbd|todo|placeholder|(?:no|empty) (?:output|text|answer|response|content|message|data)|"
    r"(?:text|message|content|response|answer|output|insert (?:text|message|content))(?: (?:here|goes here|missing|unavailable|not available))?|not available|not applicable|lorem ipsum)\s*[\])>}*\"'.]*",
    _I,
)
#: An answer of emoji only is not empty.
PICTURE = regex.compile(r"\p{Extended_Pictographic}")

_DECLINE = (
    r"(?:(?:can(?:no|['’])?t|can not|cannot|could not|will not|won['’]t|would rather not|do not|don['’]t|must not|may not|am not able to|['’]m not able to|are not able to|unable to|not able to|"
    r"won['’]t be able to|will not be able to|must decline to|have to decline to|decline to|refuse to|prefer not to|rather not|not going to|not comfortable|not allowed to|not permitted to)\s+)"
)
_TASK = (
    r"(?:assist|help)(?:\s+you)?\s+with\s+(?:that|this|these|those|such|your request|the request|requests?|messages?|content|creating|writing|anything)"
    r"|(?:write|generate|create|produce|draft|compose|provide|make|continue with|do|complete|fulfil+|comply with|engage (?:in|with))\s+"
    r"(?:(?:this|that|it|these|those|such)\s*(?:[.,;!]|$|for you|kind|type|sort|request|task|text|message|content|e-?mail)|(?:any |such |this |that |deceptive |fraudulent |phishing |scam )?(?:content|material|messages?|texts?)\b"
    r"|a (?:text|message|sample|scam|phishing)\s+(?:that|which|of|for|meant|designed|e-?mail|imitat)|(?:[\w-]+\s){1,6}(?:material|content)\b|(?:your|the|that|this) request|deceptive|fraudulent|phishing|scam)"
    r"|comply|fulfil+ (?:this|that|your|the) request|participate|imitate|impersonate|support (?:that|this) request"
)
REFUSAL = regex.compile(rf"\b{_DECLINE}(?:{_TASK})", _I)
RULES = regex.compile(
    r"\b(?:against|violates?|breach(?:es)?|outside|not allowed (?:by|under)|prohibited by)\s+(?:my|our|the|openai['’]?s?|content|usage|safety)\s*(?:usage |content |safety |own )*(?:rules|polic(?:y|ies)|guidelines|terms)\b|"
    r"\bmy (?:guidelines|rules|polic(?:y|ies)|programming) (?:do|does)(?: not|n['’]t) (?:allow|permit)|\bas an? (?:AI|(?:large )?language model|AI (?:model|assistant))\b",
    _I,
)

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and of to in is are was were for with on that this it you your we our i my me he she they his her their be been has have had will would can could please from at by or if not but as so before after until when near only do does did us there what which who all any no now then just got u ur its out up about than more most".split(),
    "de": "der die das und ist sind war ein eine einen einem einer nicht mit für auf von zu zum zur im den dem des ich wir sie ihr uns bitte auch aus bei nach über um muss können kann hat haben wird werden würde noch jemand bis heute oder wenn falls als aber diese dieser dass sehr mehr viele grüße guten hallo".split(),
    "fr": "le la les un une des et est sont pour avec sur dans que qui de du au aux nous vous je il elle ils notre votre mon ma mes pas ne plus par ce cette ces être avoir été déjà selon dès possible avant après pouvez devons merci bonjour cordialement bien où ou si mais à en se son sa ses leur fait faire voudrait".split(),
    "es": "el la los las un una unos unas y es son para con en que de del al nosotros usted ustedes yo mi su sus no más por este esta estos se ha han ya según después antes puede debe tenemos gracias hola saludos estimado lo le pero como o si sin sobre cuando también muy hay fue ser está otra otro quiere pronto posible".split(),
    "pt": "o a os as um uma uns e é são para com em que de do da dos das no na nos nas ao à nós você vocês eu meu minha seu sua não mais por este esta se já segundo depois antes pode precisa temos obrigado obrigada olá atenciosamente abraços mas como ou sem sobre quando também muito há foi ser está outra outro vai até feita".split(),
    "it": "il lo la i gli le un una uno e è sono per con in che di del della dei delle al alla noi voi io mio mia suo sua non più da questo questa si ha hanno già secondo dopo prima può deve abbiamo grazie ciao buongiorno cordiali saluti ma come o se senza quando anche molto".split(),
    "nl": "de het een en is zijn was waren voor met op van naar in dat die dit ik wij we u jij jullie ons onze uw mijn niet ook aan bij uit over om moet kunnen kan heeft hebben wordt worden nog als maar deze zeer meer alstublieft bedankt groeten hallo".split(),
    "pl": "i w na z do nie się to jest są dla od po przez że który która ale czy oraz już tylko proszę dziękuję pozdrawiam dzień dobry".split(),
    "sv": "och är att det en ett som på för med av till inte jag vi du ni har hade kan ska från om eller men hej vänliga hälsningar tack".split(),
}
LANGUAGE_NAMES = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es", "portuguese": "pt", "italian": "it", "dutch": "nl", "polish": "pl", "swedish": "sv"}
ASKED = regex.compile(r"\b(?:in|into|language[:\s]+(?:is\s+|should be\s+|must be\s+)?|write|using|be)\s+(?:\w+\s+)?(" + "|".join(LANGUAGE_NAMES) + r")\b|\b(" + "|".join(LANGUAGE_NAMES) + r")[- ](?:language|speaking|text|message|e-?mail)\b", _I)
FOREIGN = regex.compile(r"(?=\p{L})\P{Script=Latin}")
LETTER = regex.compile(r"\p{L}")


def _profiles() -> dict[str, dict[str, float]]:
    """Weight of a function word for a language: shared words count less."""
    seen: dict[str, int] = {}
    for ws in FUNCTION_WORDS.values():
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    return {lang: {w: 1.0 / seen[w] for w in ws} for lang, ws in FUNCTION_WORDS.items()}


PROFILE = _profiles()
LANGUAGES_OF: dict[str, list[tuple[str, float]]] = {}
for _lang, _weights in PROFILE.items():
    for _word, _weight in _weights.items():
        LANGUAGES_OF.setdefault(_word, []).append((_lang, _weight))


def asked_language(prompt: str | None) -> str:
    m = ASKED.search(prompt or "")
    return LANGUAGE_NAMES[(m.group(1) or m.group(2)).lower()] if m else "en"


def language_scores(text: str) -> dict[str, float]:
    scores = dict.fromkeys(PROFILE, 0.0)
    for w in regex.findall(r"\p{L}+", text.lower()):
        for lang, weight in LANGUAGES_OF.get(w, ()):
            scores[lang] += weight
    return scores


def wrong_language(prompt: str | None, text: str) -> bool:
    want = asked_language(prompt)
    n, other = len(LETTER.findall(text)), len(FOREIGN.findall(text))
    if n < 12:
        return False
    if other > 0.5 * n:
        return True
    s = language_scores(text)
    best = max(s, key=lambda k: (s[k], k == want))
    if best == want:
        return False
    if want == "en":
        return s[best] >= 2.0 and s[best] > 1.5 * s["en"]
    # Function words of another language, or none of the language asked for.
    return s[best] > 1.5 * s[want] and s[best] >= 1.0


def empty(text: str | None) -> bool:
    if text is None:
        return True
    t = tf.canonical(text).strip()
    return not PICTURE.search(t) and PLACEHOLDER.fullmatch(t) is not None


def copies(prompt: str | None, text: str) -> bool:
    """Nothing but the prompt: 80 % of the longer one's words in the same order."""
    if not prompt:
        return False
    a, b = overlap.words(prompt), overlap.words(text)
    return len(a) >= 3 and bool(b) and overlap.near_same(a, b)


def refusal(text: str) -> bool:
    """The response declines the task, at any place of it."""
    t = tf.canonical(text)
    return bool(REFUSAL.search(t) or RULES.search(t))


def rule_defect(prompt: str | None, text: str | None) -> str | None:
    if empty(text):
        return "empty"
    if copies(prompt, text):
        return "copies_prompt"
    if refusal(text):
        return "refusal"
    if wrong_language(prompt, text):
        return "wrong_language"
    return None


def defects(pairs: DataFrame, key: str) -> DataFrame:
    """key, defect_type (null if sound): one row per row of ``pairs`` (key,
    prompt_text, text, channel, origin_model)."""
    short = F.lower(F.trim(F.coalesce(F.col("channel"), F.lit("")))) == "sms"
    rows = pairs.select(key, "prompt_text", "text", F.coalesce("origin_model", F.lit("(none)")).alias("origin_model"), F.when(short, "s").otherwise("e").alias("grp"))
    kind = pairs.schema[key].dataType.simpleString()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [rule_defect(p, t) or ("truncated" if b else None) for p, t, b in zip(pdf["prompt_text"], pdf["text"], pdf["unfinished"])]
            yield pd.DataFrame({key: pdf[key], "defect_type": pd.Series(found, dtype=object)})

    return with_verdict(rows, "origin_model").mapInPandas(go, f"{key} {kind}, defect_type string")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "llm_mass_generation").select("gen_id", "prompt_text", "text", "channel", "origin_model"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective pair and its defect."""
    return defects(_pairs(spark, sf_dir), "gen_id").where("defect_type is not null")
