"""Queries over text features (F40-F58, X1-X9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import features as X
from corpusloom.functions.text import words_lower
from corpusloom.plans.q_text import q, sql_words_lower
from corpusloom.plans.registry import Tables, query
from corpusloom.session import spread


def _in(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def _n(pattern: str, c: str = "t") -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def _r(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0e0 ELSE CAST({a} AS DOUBLE) / {b} END"


def _has(words: list[str], runs: str = "runs") -> str:
    return f"len(list_filter({runs}, lambda x: list_contains({_in(words)}, x)))"


_BASE = r"""WITH b AS (SELECT {id}, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, {words_t} AS words,
 list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS sents,
 regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS runs FROM b),
x AS (SELECT *, length(t) AS nc, len(words) AS nw, len(sents) AS ns, list_transform(words, lambda v: length(v)) AS wl,
 list_transform(sents, lambda s: len({words_s})) AS swc,
 map_values(list_histogram(words)) AS freq, map_values(list_histogram(list_filter(regexp_split_to_array(t, ''), lambda c: c <> ''))) AS chars FROM w)
"""


def base(table: str, key: str) -> str:
    return _BASE.replace("{words_t}", sql_words_lower("t")).replace("{words_s}", sql_words_lower("s")).replace("{id}", key).replace("{table}", table).replace("list_histogram(", "list_aggregate(").replace("list_aggregate(words)", "list_aggregate(words, 'histogram')").replace("lambda c: c <> '')))", "lambda c: c <> ''), 'histogram'))")


def _mean(a: str) -> str:
    return f"coalesce(list_avg({a}), 0.0e0)"


def _std(a: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0e0 ELSE sqrt(greatest(0.0e0, list_avg(list_transform({a}, lambda v: CAST(v * v AS DOUBLE))) - list_avg({a}) * list_avg({a}))) END"


SQL: dict[str, str] = {
    "char_len": "CAST(nc AS DOUBLE)", "word_count": "CAST(nw AS DOUBLE)", "sentence_count": "CAST(ns AS DOUBLE)",
    "avg_sentence_len_words": _mean("swc"), "std_sentence_len_words": _std("swc"), "avg_word_len_chars": _mean("wl"), "std_word_len_chars": _std("wl"),
    "long_word_ratio": _r("len(list_filter(wl, lambda v: v >= 7))", "nw"), "short_word_ratio": _r("len(list_filter(wl, lambda v: v <= 3))", "nw"), "chars_per_word": _r("nc", "nw"),
    **{k: _r(_n(p), "nc") for k, p in X.SURFACE.items()},
    **{k: _r(_n(p), "nc") for k, p in X.PUNCTUATION.items()},
    "ttr": _r("len(freq)", "nw"), "corrected_ttr": "CASE WHEN nw > 1 THEN ln(len(freq) + 1.0e0) / ln(nw + 1.0e0) ELSE 0.0e0 END",
    "root_ttr": _r("len(list_distinct(list_transform(words, lambda v: substring(v, 1, 4))))", "nw"),
    "hapax_ratio": _r("len(list_filter(freq, lambda f: f = 1))", "nw"), "dislegomena_ratio": _r("len(list_filter(freq, lambda f: f = 2))", "nw"),
    "yule_k": "CASE WHEN nw >= 2 THEN 10000.0e0 * (list_sum(list_transform(freq, lambda f: CAST(f * f AS DOUBLE))) - nw) / (CAST(nw AS DOUBLE) * nw) ELSE 0.0e0 END",
    "top_token_share": _r("coalesce(list_max(freq), 0)", "nw"),
    "entropy_token_unigram": "CASE WHEN nw > 0 THEN -list_sum(list_transform(freq, lambda f: (f / CAST(nw AS DOUBLE)) * log2(f / CAST(nw AS DOUBLE) + 1e-12))) ELSE 0.0e0 END",
    **{f"{k}_ratio": _r(_has(ws), "nw") for k, ws in X.LEXICONS.items()},
    "stopword_ratio": _r(_has(X.STOPWORDS, "words"), "nw"),
    "lexical_burstiness": f"CASE WHEN ns >= 2 AND {_mean('swc')} > 0 THEN ({_std('swc')}) / {_mean('swc')} ELSE 0.0e0 END",
    "coleman_liau_index": "CASE WHEN nw > 0 AND trim(t) <> '' THEN 5.88e0 * " + _n(r"\p{L}") + " / CAST(nw AS DOUBLE) - 29.6e0 * greatest(ns, 1) / CAST(nw AS DOUBLE) - 15.8e0 ELSE 0.0e0 END",
    "automated_readability_index": "CASE WHEN nw > 0 AND trim(t) <> '' THEN 4.71e0 * " + _n(r"\p{L}") + " / CAST(nw AS DOUBLE) + 0.5e0 * nw / greatest(ns, 1) - 21.43e0 ELSE 0.0e0 END",
}

_VOWELS = "len(regexp_extract_all(v, '[aeiouy]+'))"
_SYL = f"CAST(coalesce(list_sum(list_transform(words, lambda v: greatest(1, {_VOWELS} - CASE WHEN regexp_matches(v, '[^aeiouyl]e$') THEN 1 ELSE 0 END))), 0) AS DOUBLE)"
_POLY = f"len(list_filter(words, lambda v: {_VOWELS} >= 3))"
#: Letters and numbers beyond ASCII as x, so that ASCII word boundaries hold.
_MARKED = "regexp_replace(regexp_replace(t, '[^\\P{L}a-zA-Z]', 'x', 'g'), '[^\\P{N}0-9]', 'x', 'g')"
_READ = lambda x: f"CASE WHEN nw > 0 AND trim(t) <> '' THEN {x} ELSE 0.0e0 END"
_NW, _SENT = "CAST(nw AS DOUBLE)", "greatest(ns, 1)"
SQL |= {
    "char_entropy": "CASE WHEN nc > 0 THEN -list_sum(list_transform(chars, lambda f: (f / CAST(nc AS DOUBLE)) * log2(f / CAST(nc AS DOUBLE)))) ELSE 0.0e0 END",
    "repetition_rate": f"CASE WHEN nw > 0 THEN 1.0e0 - ({SQL['hapax_ratio']}) ELSE 0.0e0 END",
    "avg_token_length_chars": _mean("wl"),
    "numeral_token_ratio": _r(f"len(regexp_extract_all({_MARKED}, '\\b\\d+(?:[.,]\\d+)*\\b'))", "nw"),
    "imperative_like_ratio": _r("len(list_filter(sents, lambda s: regexp_matches(s, '(?i)^(?:please\\s+)?[a-z]{3,}(?:[^\\p{L}\\p{N}_]|$)')))", _SENT),
    "flesch_reading_ease": _READ(f"206.835e0 - 1.015e0 * {_NW} / {_SENT} - 84.6e0 * {_SYL} / nw"),
    "flesch_kincaid_grade": _READ(f"0.39e0 * {_NW} / {_SENT} + 11.8e0 * {_SYL} / nw - 15.59e0"),
    "smog_index": _READ(f"1.043e0 * sqrt({_POLY} * 30.0e0 / {_SENT}) + 3.1291e0"),
    "sentence_opener_repeat_rate": f"CASE WHEN ns > 0 THEN 1.0e0 - CAST(len(list_distinct(list_transform(sents, lambda s: coalesce({sql_words_lower('s')}[1], '')))) AS DOUBLE) / ns ELSE 0.0e0 END",
    "discourse_marker_ratio": _r(_has(X.DISCOURSE) + "".join(f" + len(regexp_extract_all(lower({_MARKED}), '\\b{p}\\b'))" for p in X.DISCOURSE_PHRASES), "nw"),
}

#: Blocks of the sixty features, each a query of its own.
GROUPS = {
    "length": ["char_len", "word_count", "sentence_count", "avg_sentence_len_words", "std_sentence_len_words", "avg_word_len_chars", "std_word_len_chars", "long_word_ratio", "short_word_ratio", "chars_per_word"],
    "surface": list(X.SURFACE),
    "punctuation": list(X.PUNCTUATION),
    "diversity": ["ttr", "corrected_ttr", "root_ttr", "hapax_ratio", "dislegomena_ratio", "yule_k", "top_token_share", "entropy_token_unigram"],
    "functional": [f"{k}_ratio" for k in X.LEXICONS],
    "discourse": ["stopword_ratio", "lexical_burstiness", "coleman_liau_index", "automated_readability_index"],
}


#: Features with logarithms or deviations, which engines give to the last digits only.
INEXACT = {"std_sentence_len_words", "std_word_len_chars", "corrected_ttr", "entropy_token_unigram", "lexical_burstiness", "char_entropy"}


def _register(group: str, names: list[str]) -> None:
    # Ratios of whole numbers agree to the last bit; sums of logarithms do not.
    cut = INEXACT
    cols = ", ".join(f"round({SQL[n]}, 6) AS {n}" if n in cut else f"{SQL[n]} AS {n}" for n in names)

    @query(f"x1_hc60_{group}", base("documents", "doc_id") + f"SELECT doc_id, {cols} FROM x")
    def run(t: Tables) -> DataFrame:
        d = X.prepared(spread(t("documents").select("doc_id", "text")), "text")
        all_ = X.hc60()
        return d.select("doc_id", *((F.round(all_[f"hc60_{n}"], 6) if n in cut else all_[f"hc60_{n}"].cast("double")).alias(n) for n in names))


for _g, _names in GROUPS.items():
    _register(_g, _names)


@query("x1_hc60_all", base("core_records", "core_row_id, label") + "SELECT core_row_id, label, " + ", ".join(f"round({SQL[n]}, 6) AS hc60_{n}" if n in INEXACT else f"{SQL[n]} AS hc60_{n}" for n in X.NAMES) + " FROM x")
def x1_hc60_all(t: Tables) -> DataFrame:
    """All sixty features of every core record."""
    d = X.extract_hc60(t("core_records"), ["core_row_id", "label"])
    return d.select("core_row_id", "label", *(F.round(f"hc60_{n}", 6).alias(f"hc60_{n}") if n in INEXACT else F.col(f"hc60_{n}") for n in X.NAMES))


@query("x4_stylometric", base("core_records", "core_row_id") + f"SELECT core_row_id, {_mean('swc')} AS avg_sentence_len, {_mean('wl')} AS avg_word_len, {_r(_n(','), 'greatest(ns, 1)')} AS commas_per_sentence, {_r(_n(chr(92) + '?'), 'greatest(ns, 1)')} AS questions_per_sentence, {_r(_n('!'), 'greatest(ns, 1)')} AS exclamations_per_sentence, {_r(_n(chr(92) + 'p{Lu}'), _n(chr(92) + 'p{L}'))} AS uppercase_over_letters, {_r(_has(X.DISCOURSE), 'nw')} AS connective_ratio, CAST({_n(chr(92) + 'p{L}+, ' + chr(92) + 'p{L}+,? and ' + chr(92) + 'p{L}+')} AS DOUBLE) AS enumerations, {_r(_n(chr(92) + '[URL' + chr(92) + ']'), 'nw')} AS url_mark_rate, {_r('len(freq)', 'nw')} AS ttr, CASE WHEN nw > 0 THEN len(freq) / sqrt(2.0e0 * nw) ELSE 0.0e0 END AS guiraud_ttr FROM x")
def x4_stylometric(t: Tables) -> DataFrame:
    return X.stylometric(t("core_records"), ["core_row_id"]).drop("_words")


@query("x5_lexical_diversity", base("documents", "doc_id") + f"SELECT doc_id, {SQL['ttr']} AS ttr, round({SQL['yule_k']}, 6) AS yule_k, round({SQL['corrected_ttr']}, 6) AS corrected_ttr FROM x")
def x5_lexical_diversity(t: Tables) -> DataFrame:
    """Type ratios and Yule's K."""
    d = X.prepared(spread(t("documents").select("doc_id", "text")), "text")
    h = X.hc60()
    return d.select("doc_id", h["hc60_ttr"].alias("ttr"), F.round(h["hc60_yule_k"], 6).alias("yule_k"), F.round(h["hc60_corrected_ttr"], 6).alias("corrected_ttr"))


@query("x5_mtld")
def x5_mtld(t: Tables) -> DataFrame:
    """MTLD, which needs state along the text, hence an Arrow UDF."""
    d = spread(t("documents").select("doc_id", "text"))
    return d.select("doc_id", X.mtld(words_lower(F.col("text"))).alias("mtld"))


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "x6_dense",
    f"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) AS t FROM documents),
x AS (SELECT *, length(t) AS nc, map_values(list_aggregate(list_filter(regexp_split_to_array(lower(t), ''), lambda v: v <> ''), 'histogram')) AS chars FROM c)
SELECT doc_id, CAST(nc AS DOUBLE) AS chars, CAST(len(list_filter(string_split(t, ' '), lambda v: v <> '')) AS DOUBLE) AS words,
CASE WHEN nc > 0 THEN round(-list_sum(list_transform(chars, lambda f: (f / CAST(nc AS DOUBLE)) * log2(f / CAST(nc AS DOUBLE)))), 6) END AS char_entropy,
{_r(_n(chr(92) + 'p{Lu}'), 'nc')} AS upper, {_r(_n(chr(92) + 'p{Nd}'), 'nc')} AS digits FROM x""",
)
def x6_dense(t: Tables) -> DataFrame:
    d = X.dense(t("documents"), ["doc_id"])
    return d.withColumn("char_entropy", F.round("char_entropy", 6))


@query("x9_quick_ratios", r"SELECT doc_id, CASE WHEN nw = 0 THEN 0.0e0 ELSE CAST(nd AS DOUBLE) / nw END AS quick_ttr FROM (SELECT doc_id, len(w) AS nw, len(list_distinct(w)) AS nd FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents))")
def x9_quick_ratios(t: Tables) -> DataFrame:
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    return t("documents").select("doc_id", X.ratio(F.size(F.array_distinct(w)), F.size(w)).alias("quick_ttr"))


@query("f53_char_classes", base("documents", "doc_id") + "SELECT doc_id, round(CASE WHEN nc > 0 THEN -list_sum(list_transform(chars, lambda f: (f / CAST(nc AS DOUBLE)) * log2(f / CAST(nc AS DOUBLE)))) ELSE 0.0e0 END, 6) AS char_entropy FROM x")
def f53_char_classes(t: Tables) -> DataFrame:
    d = X.prepared(spread(t("documents").select("doc_id", "text")), "text")
    return d.select("doc_id", F.round(X.hc60()["hc60_char_entropy"], 6).alias("char_entropy"))
