"""Text functions as Column expressions: cleaning, masking, tokens, keys, bins.

All take and return Columns, so they stay inside code generation. Character
classes are written out (``\\p{L}`` and the like), because ``\\w`` and ``\\s`` mean
ASCII in the JVM. A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, for trimming and collapsing.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDISH = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORDISH}+|[^\p{{L}}\p{{N}}_\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"

# Patterns whose results have to agree with the corpus they describe.
URL_WIDE = r"(?i)(https?://[^\s<>\"']+|www\.[^\s<>\"']+|[a-z0-9][a-z0-9-]*\.[a-z]{2,}(?:/[^\s<>\"']*)?)"
URL_REST = r"(?i)https?://\S*"
URL_COUNT = r"https?://[^\s<>\"']+"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)|\d{2,4})[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
TAG = r"<[^>]{1,200}>"
YEAR = r"(199[5-9]|20[0-2][0-9])"


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def nfkc(c: Column) -> Column:
    """NFKC; plain ASCII (already normal) never leaves the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfkc(c)).otherwise(c)


def normalize_text(c: Column) -> Column:
    """NFKC, replacement and control characters to space, white space collapsed."""
    return collapse(F.regexp_replace(nfkc(c), r"[\x{fffd}\x00-\x1f\x7f]", " "))


def mask_url(c: Column) -> Column:
    """Full, ``www.`` and bare-domain addresses, then leftovers, to ``[URL]``."""
    return F.regexp_replace(F.regexp_replace(c, URL_WIDE, "[URL]"), URL_REST, "[URL]")


def mask_url_once(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)https?://\S+|www\.\S+", "[URL]")


def mask_collapsed(c: Column) -> Column:
    """Symmetric mask for annotation: addresses to ``[URL]``, white space collapsed."""
    return collapse(mask_url_once(c))


def clean_text(c: Column, url: bool = True, email: bool = True, phone: bool = False, html: bool = True, white: bool = True, control: bool = True) -> Column:
    """Configurable cleaner: control bytes removed, tags dropped, addresses masked
    (mail before web), three or more newlines to two, blanks to one."""
    if control:
        c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if html:
        c = F.regexp_replace(c, TAG, " ")
    if email:
        c = F.regexp_replace(c, EMAIL, "[EMAIL]")
    if url:
        c = F.regexp_replace(c, r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+", "[URL]")
    if phone:
        c = F.regexp_replace(c, PHONE, "[PHONE]")
    if white:
        c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))
    return c


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def strip_header_lines(c: Column) -> Column:
    """Body after leading ``Name: value`` lines and the blank line that ends them."""
    return F.regexp_replace(c, r"\A(?:[A-Za-z][A-Za-z-]*:[^\n]*\n(?:[ \t]+[^\n]*\n)*)+\n", "")


def yes_no(c: Column) -> Column:
    """True and false to ``yes`` and ``no``; null counts as no."""
    return F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")


def truthy(c: Column) -> Column:
    """Strings that mean yes: non-empty, not zero, not a word for no."""
    s = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return ~s.isin("", "0", "0.0", "no", "false", "none", "n")


def has_url(c: Column) -> Column:
    return c.rlike(r"(?i)https?://|www\.|\[URL\]")


def has_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def has_phone_or_reply(c: Column) -> Column:
    return c.rlike(rf"(?i){PHONE}|(?:^|[^a-z])(?:call|text|txt|reply|whatsapp)(?:[^a-z]|$)")


def url_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(URL_COUNT)).cast("long")


def token_count(c: Column) -> Column:
    """Word runs and single other signs."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0)).cast("long")


def space_words(c: Column) -> Column:
    """White-space separated words as an array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(space_words(c)).cast("long")


def sentence_marks(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[.!?]+")), F.lit(0)).cast("long")


#: Upper token bounds of short and medium, per channel.
BINS = {"sms": (20, 60), "email": (100, 400), "qa": (75, 250)}


def length_bin(tokens: Column, channel: Column, strict: bool = False) -> Column:
    """short, medium or long; an unknown channel gives null, or an error if strict."""
    out = F.when(F.lit(False), F.lit(None))
    for name, (low, high) in BINS.items():
        out = out.when((channel == name) & (tokens < low), "short").when((channel == name) & (tokens < high), "medium").when(channel == name, "long")
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown channel: "), F.coalesce(channel, F.lit("null"))))) if strict else out


def wc_bin(n: Column) -> Column:
    return F.when(n < 40, "short").when(n < 200, "medium").otherwise("long")


def sha_key(c: Column) -> Column:
    return F.sha2(F.trim(F.coalesce(c, F.lit(""))), 256)


def md5_key(c: Column) -> Column:
    return F.md5(F.trim(F.coalesce(c, F.lit(""))))


def stream_key(stream: Column, c: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", stream, c), 256), 1, 48)


def bucket_share(c: Column, share: float) -> Column:
    """Deterministic membership of about ``share`` of all keys, by CRC-32."""
    if share <= 0:
        return F.lit(False)
    if share >= 1:
        return F.lit(True)
    return F.crc32(F.encode(c, "UTF-8")) % 10000 < int(share * 10000)


def slug(c: Column) -> Column:
    return F.translate(c, "/:.", "___")


def opening(c: Column, n: int = 8) -> Column:
    """First n white-space words, in lower case."""
    return F.lower(F.array_join(F.slice(space_words(c), 1, n), " "))


def first_year(*cols: Column) -> Column:
    """Year from the first field that holds one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), YEAR, 1), F.lit("")) for c in cols)).cast("int")


def ascii_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\x00-\x7f]", "")) / n)


def language_guess(c: Column) -> Column:
    """too_short, english_like or other, by the share of ASCII characters."""
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) < 20, "too_short").when(ascii_ratio(c) > 0.92, "english_like").otherwise("other")


#: A word of Latin letters and apostrophes between word boundaries
#: as Unicode has them (letters, digits and the underscore are word characters).
_BEFORE, _AFTER = rf"(?<!{WORDISH})", rf"(?!{WORDISH})"
WORD = rf"({_BEFORE}[a-zA-Z][a-zA-Z']*(?:(?<=[a-zA-Z]){_AFTER}|(?<=')(?={WORDISH})))"
PLAIN_WORD = rf"({_BEFORE}[a-zA-Z]+{_AFTER})"


def words_lower(c: Column) -> Column:
    """Latin letter words with inner apostrophes, lower case (array)."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(1)), F.lower)


def sentences(c: Column) -> Column:
    """Trimmed, non-empty stretches between sentence marks (array)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


# ---- quality issues of generated texts ----------------------------------------

def issues(*pairs: tuple[str, Column]) -> Column:
    """Names of the tests that hold, as an array without nulls."""
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in pairs)))


def masking_issues(c: Column) -> Column:
    return issues(("unmasked_url", c.rlike(r"(?i)https?://|www\.")), ("unmasked_email", c.rlike(EMAIL)), ("unmasked_phone", c.rlike(r"\+?\d[\d .-]{8,}\d")))


def format_issues(c: Column, channel: Column) -> Column:
    return issues(
        ("too_few_tokens", word_count(c) < 5),
        ("markdown_header", c.rlike(r"(?m)^#{1,6} ")),
        ("markdown_emphasis", c.rlike(r"\*\*[^*]+\*\*|__[^_]+__")),
        ("html_tag", c.rlike(r"</?[a-zA-Z][^>]{0,200}>")),
        ("wrapper_prefix", c.rlike(r"(?i)^\s*(?:here is|here's|sure[,!]|certainly[,!]|subject:)")),
        ("emoji_in_sms", (channel == "sms") & c.rlike(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")),
    )


def quality(c: Column, channel: Column, target_bin: Column) -> Column:
    """struct(passed, issues, token_count, actual_bin)."""
    n = token_count(c)
    got = length_bin(n, channel)
    off = F.when(got != target_bin, F.array(F.concat(F.lit("bin_mismatch:"), got))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(masking_issues(c), format_issues(c, channel), F.coalesce(off, F.array().cast("array<string>")))
    return F.struct((F.size(all_) == 0).alias("passed"), all_.alias("issues"), n.alias("token_count"), got.alias("actual_bin"))
