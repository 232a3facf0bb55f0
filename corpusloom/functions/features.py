"""Text features as Column expressions over shared intermediate arrays.

``prepared`` adds the arrays once (words, sentences, frequency spectra); every
feature is then an expression over them, so a text is tokenised once however
many features are asked for. Frequencies are run lengths of the sorted array,
linear after the sort, instead of a comparison of all pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import collapse, sentences, words_lower
from corpusloom.session import spread

# Word lists whose counts make the lexicon features.
LEXICONS: dict[str, list[str]] = {
    "pronoun": "i me my mine myself you your yours yourself he him his himself she her hers herself we us our ours ourselves they them their theirs themselves it its itself".split(),
    "modal": "can could may might must shall should will would ought".split(),
    "auxiliary": "am is are was were be been being have has had do does did get got getting".split(),
    "article": "a an the".split(),
    "preposition": "in on at by for with from to of about into through after before between under over".split(),
    "conjunction": "and or but nor so yet because although though if unless".split(),
    "det_like": "this that these those some any each every no another such what which".split(),
    "verb_like": (
        "is are was were be been being have has had do does did go goes went gone make made take took taken come came see saw seen know knew known think thought get got give gave "
        "find found tell told ask asked work worked seem seemed feel felt try tried leave left call called"
    ).split(),
    "noun_like": (
        "time year people way day man woman child world life hand part place case week company system program question work number point home water room fact story result change "
        "government money issue service market problem study lot right book business"
    ).split(),
    "adjective_like": "new good high old great big small large long little own other last first next early young important few public bad same able".split(),
    "adverb_like": "not very also just only well even back there however therefore still already never always often sometimes today now here away again once too quite rather almost".split(),
    "negation": "no not never neither nor".split(),
    "question_word": "who whom whose what which where when why how".split(),
}
DISCOURSE = "therefore however moreover furthermore nevertheless meanwhile otherwise consequently thus hence additionally specifically finally first second third".split()
DISCOURSE_PHRASES = ["in conclusion", "for example", "in particular", "on the other hand"]
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has "
    "have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over "
    "own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with you your yours yourself yourselves"
).split()
LISTED = sorted({*DISCOURSE, *(w for ws in LEXICONS.values() for w in ws)})
#: Names of the surface ratios and the characters each counts.
SURFACE = {"digit_ratio": r"\p{Nd}", "uppercase_ratio": r"\p{Lu}", "whitespace_ratio": r"\s", "punctuation_ratio": r"[^\p{L}\p{N}\s]", "alnum_ratio": r"[\p{L}\p{N}]", "non_alnum_symbol_ratio": r"[^\p{L}\p{N}\s]"}
PUNCTUATION = {
    "period_ratio": r"\.", "comma_ratio": ",", "colon_ratio": ":", "semicolon_ratio": ";", "dash_ratio": r"[-\x{2013}\x{2014}]", "quote_ratio": r"['\"\x{201C}\x{201D}\x{2018}\x{2019}]",
    "paren_ratio": r"[()\[\]{}]", "question_ratio": r"\?", "exclamation_ratio": "!",
}


#: The sixty features in order.
NAMES = (
    "char_len word_count sentence_count avg_sentence_len_words std_sentence_len_words avg_word_len_chars std_word_len_chars long_word_ratio short_word_ratio chars_per_word".split()
    + list(SURFACE)
    + ["char_entropy"]
    + list(PUNCTUATION)
    + "ttr corrected_ttr root_ttr hapax_ratio dislegomena_ratio yule_k repetition_rate top_token_share entropy_token_unigram avg_token_length_chars".split()
    + [f"{k}_ratio" for k in LEXICONS]
    + "numeral_token_ratio imperative_like_ratio flesch_reading_ease flesch_kincaid_grade smog_index coleman_liau_index automated_readability_index".split()
    + "stopword_ratio sentence_opener_repeat_rate lexical_burstiness discourse_marker_ratio".split()
)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_run_lengths(df: DataFrame, **items: Column) -> DataFrame:
    """For each name=array a column with how often each distinct item occurs.

    In stages of their own, because an expression inside a lambda is evaluated
    again for every element: sort once, mark the starts of runs, take differences."""
    d = df.withColumns({f"_s_{n}": F.sort_array(c) for n, c in items.items()})

    def starts(n: str) -> Column:
        s = F.col(f"_s_{n}")
        size = F.size(s)
        at = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))

    d = d.withColumns({f"_a_{n}": starts(n) for n in items})
    ends = lambda n: F.concat(F.slice(F.col(f"_a_{n}"), 2, 1_000_000_000), F.array(F.size(f"_s_{n}") + 1))
    d = d.withColumns({n: F.when(F.size(f"_a_{n}") > 0, F.zip_with(f"_a_{n}", ends(n), lambda a, b: b - a)).otherwise(F.array().cast("array<int>")) for n in items})
    return d.drop(*(f"_{x}_{n}" for x in "sa" for n in items))


def with_char_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """How often each distinct character occurs: few are distinct, so each is
    counted by what its removal takes from the length."""
    d = df.withColumn("_distinct", F.array_sort(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")))
    return d.withColumn(name, F.transform("_distinct", lambda c: F.length(F.col(text)) - F.length(F.replace(F.col(text), c, F.lit(""))))).drop("_distinct")


def total(xs: Column, f=lambda x: x) -> Column:  # noqa: ANN001
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def mean_std(xs: Column) -> tuple[Column, Column]:
    """Mean and population deviation of an array, 0 if it is empty."""
    n = F.size(xs)
    mean = ratio(total(xs), n)
    return mean, F.sqrt(F.greatest(F.lit(0.0), ratio(total(xs, lambda x: x * x), n) - mean * mean))


def prepared(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_t`` and the arrays all features share."""
    d = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"_words": words_lower(F.col("_t")), "_sents": sentences(F.col("_t")), "_runs": F.regexp_extract_all(F.lower("_t"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))})
    d = d.withColumn("_listed", F.filter("_runs", lambda x: x.isin(LISTED)))  # few words are in any list
    d = with_char_counts(with_run_lengths(d, _freq=F.col("_words")), "_t", "_chars")
    d = d.withColumns(
        {
            "_swc": F.transform("_sents", lambda s: F.size(words_lower(s))),
            "_wl": F.transform("_words", F.length),
        }
    )
    return d


def lexicon_ratio(words: list[str]) -> Column:
    return ratio(F.size(F.filter("_listed", lambda x: x.isin(words))), F.size("_words"))


def syllables() -> Column:
    """Vowel groups, a silent final e taken off (a heuristic)."""
    one = lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.rlike("[^aeiouyl]e$"), 1).otherwise(0))
    return total(F.col("_words"), one)


def hc60() -> dict[str, Column]:
    """Sixty features by name, over :func:`prepared`."""
    t, words, sents, swc, wl, freq = (F.col(c) for c in ("_t", "_words", "_sents", "_swc", "_wl", "_freq"))
    n_char, n_w, n_s = F.length(t), F.size(words), F.size(sents)
    mean_s, std_s = mean_std(swc)
    mean_w, std_w = mean_std(wl)
    many = lambda xs, f: F.size(F.filter(xs, f))
    count = lambda p: F.regexp_count(t, F.lit(p))
    hapax, dis = many(freq, lambda f: f == 1), many(freq, lambda f: f == 2)
    types, n = F.size(freq), n_w.cast("double")
    squares = total(freq, lambda f: f * f)
    entropy = -total(freq, lambda f: (f / n) * F.log2(f / n + F.lit(1e-12)))
    char_entropy = -total(F.col("_chars"), lambda f: (f / n_char) * F.log2(f / n_char))
    openers = F.transform(sents, lambda s: F.coalesce(F.get(words_lower(s), F.lit(0)), F.lit("")))
    discourse = F.size(F.filter("_listed", lambda x: x.isin(DISCOURSE))) + sum(F.regexp_count(F.lower(t), F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_]){p}(?=[^\p{{L}}\p{{N}}_]|$)")) for p in DISCOURSE_PHRASES)
    letters, syl = F.regexp_count(t, F.lit(r"\p{L}")), syllables()
    sent = F.greatest(n_s, F.lit(1))
    poly = many(words, lambda w: F.regexp_count(w, F.lit("[aeiouy]+")) >= 3)
    some = (n_w > 0) & (F.trim(t) != "")
    read = lambda c: F.when(some, c).otherwise(0.0)
    out = {
        "char_len": n_char.cast("double"),
        "word_count": n,
        "sentence_count": n_s.cast("double"),
        "avg_sentence_len_words": mean_s,
        "std_sentence_len_words": std_s,
        "avg_word_len_chars": mean_w,
        "std_word_len_chars": std_w,
        "long_word_ratio": ratio(many(wl, lambda x: x >= 7), n_w),
        "short_word_ratio": ratio(many(wl, lambda x: x <= 3), n_w),
        "chars_per_word": ratio(n_char, n_w),
        **{k: ratio(count(p), n_char) for k, p in SURFACE.items()},
        "char_entropy": F.when(n_char > 0, char_entropy).otherwise(0.0),
        **{k: ratio(count(p), n_char) for k, p in PUNCTUATION.items()},
        "ttr": ratio(types, n_w),
        "corrected_ttr": F.when(n_w > 1, F.ln(types + 1.0) / F.ln(n_w + 1.0)).otherwise(0.0),
        "root_ttr": ratio(F.size(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 4)))), n_w),
        "hapax_ratio": ratio(hapax, n_w),
        "dislegomena_ratio": ratio(dis, n_w),
        "yule_k": F.when(n_w >= 2, 10000.0 * (squares - n) / (n * n)).otherwise(0.0),
        "repetition_rate": F.when(n_w > 0, 1.0 - ratio(hapax, n_w)).otherwise(0.0),
        "top_token_share": ratio(F.coalesce(F.array_max(freq), F.lit(0)), n_w),
        "entropy_token_unigram": F.when(n_w > 0, entropy).otherwise(0.0),
        "avg_token_length_chars": mean_w,
        **{f"{k}_ratio": lexicon_ratio(ws) for k, ws in LEXICONS.items()},
        "numeral_token_ratio": ratio(F.regexp_count(t, F.lit(r"(?:^|[^\p{L}\p{N}_])\d+(?:[.,]\d+)*(?=[^\p{L}\p{N}_]|$)")), n_w),
        "imperative_like_ratio": ratio(many(sents, lambda s: s.rlike(r"(?i)^(?:please\s+)?[a-z]{3,}(?:[^\p{L}\p{N}_]|$)")), sent),
        "flesch_reading_ease": read(206.835 - 1.015 * n_w / sent - 84.6 * syl / n),
        "flesch_kincaid_grade": read(0.39 * n_w / sent + 11.8 * syl / n - 15.59),
        "smog_index": read(1.043 * F.sqrt(poly * 30.0 / sent) + 3.1291),
        "coleman_liau_index": read(5.88 * letters / n - 29.6 * sent / n - 15.8),
        "automated_readability_index": read(4.71 * letters / n + 0.5 * n_w / sent - 21.43),
        "stopword_ratio": ratio(many(words, lambda w: w.isin(STOPWORDS)), n_w),
        "sentence_opener_repeat_rate": F.when(n_s > 0, 1.0 - ratio(F.size(F.array_distinct(openers)), n_s)).otherwise(0.0),
        "lexical_burstiness": F.when((n_s >= 2) & (mean_s > 0), std_s / mean_s).otherwise(0.0),
        "discourse_marker_ratio": ratio(discourse, n_w),
    }
    return {f"hc60_{k}": v for k, v in out.items()}


def extract_hc60(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the sixty features, one row per row; null reads as empty."""
    return prepared(spread(df.select(*keys, text)), text).select(*keys, *(c.cast("double").alias(n) for n, c in hc60().items()))


# ---- lexical diversity that needs state: MTLD ---------------------------------------


def mtld_of(words: list[str], threshold: float = 0.72, zero: float | None = 0.0) -> float:
    """Mean of forward and backward MTLD; 0 under ten words. ``zero`` is the value
    where no factor was completed, None divides by a very small number instead."""
    if len(words) < 10:
        return 0.0

    def one(ws: list[str]) -> float:
        factors, seen, n = 0.0, set(), 0
        for w in ws:
            n += 1
            seen.add(w)
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        if factors == 0 and zero is not None:
            return zero
        return len(ws) / max(factors, 1e-9)

    return (one(words) + one(words[::-1])) / 2


@F.pandas_udf(T.DoubleType())
def mtld(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: mtld_of(list(ws)))


def stylometric(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Surface stylometry without a tagger: densities per sentence, connectives,
    enumerations, upper case over letters, link marks."""
    d = prepared(spread(df.select(*keys, text)), text)
    t, n_s, n_w = F.col("_t"), F.greatest(F.size("_sents"), F.lit(1)), F.size("_words")
    per = lambda p: ratio(F.regexp_count(t, F.lit(p)), n_s)
    mean_s, _ = mean_std(F.col("_swc"))
    cols = {
        "avg_sentence_len": mean_s,
        "avg_word_len": mean_std(F.col("_wl"))[0],
        "commas_per_sentence": per(","),
        "questions_per_sentence": per(r"\?"),
        "exclamations_per_sentence": per("!"),
        "uppercase_over_letters": ratio(F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}"))),
        "connective_ratio": ratio(F.size(F.filter("_runs", lambda x: x.isin(DISCOURSE))), n_w),
        "enumerations": F.regexp_count(t, F.lit(r"\p{L}+, \p{L}+,? and \p{L}+")).cast("double"),
        "url_mark_rate": ratio(F.regexp_count(t, F.lit(r"\[URL\]")), n_w),
        "ttr": ratio(F.size("_freq"), n_w),
        "guiraud_ttr": F.when(n_w > 0, F.size("_freq") / F.sqrt(2.0 * n_w)).otherwise(0.0),
    }
    return d.select(*keys, *(c.alias(n) for n, c in cols.items()), F.col("_words"))


def dense(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Small dense block: lengths, ratios, entropy of the lower-cased text."""
    df = df.select(*keys, collapse(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    df = with_char_counts(df.withColumn("_low", F.lower("_t")), "_low", "_freq")
    t, freq, n = F.col("_t"), F.col("_freq"), F.length("_t")
    entropy = F.when(n > 0, -total(freq, lambda f: (f / n) * F.log2(f / n)))
    return df.select(*keys, n.cast("double").alias("chars"), F.size(F.filter(F.split(t, " "), lambda w: w != "")).cast("double").alias("words"), entropy.alias("char_entropy"), ratio(F.regexp_count(t, F.lit(r"\p{Lu}")), n).alias("upper"), ratio(F.regexp_count(t, F.lit(r"\p{Nd}")), n).alias("digits"))
