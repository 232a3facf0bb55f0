"""Queries over the text functions (cleaning, masking, tokens, keys, bins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.plans.registry import Tables, query


def q(s: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS = q(X.WS + "+")


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {WS}, ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), {WS}), lambda x: x <> '')"


def sql_count(c: str, pattern: str) -> str:
    return f"coalesce(CAST(len(regexp_extract_all({c}, {q(pattern)})) AS BIGINT), 0)"


TOKENS = sql_count("text", X.TOKEN)


def sql_bin(tokens: str, channel: str = "channel") -> str:
    arms = " ".join(f"WHEN {channel} = '{k}' AND {tokens} < {a} THEN 'short' WHEN {channel} = '{k}' AND {tokens} < {b} THEN 'medium' WHEN {channel} = '{k}' THEN 'long'" for k, (a, b) in X.BINS.items())
    return f"CASE {arms} END"


def channel_norm():  # noqa: ANN201 - Column
    return F.regexp_replace(F.lower(F.trim("channel")), "[-_ ]", "")


SQL_CHANNEL = "regexp_replace(lower(trim(channel)), '[-_ ]', '', 'g')"


@query(
    "f1_normalize_text",
    f"SELECT rec_id, {sql_collapse(chr(39).join(['regexp_replace(text, ', '[' + chr(0xFFFD) + ']', ', ', ' ', ', ', 'g', ')']))} AS clean FROM nigerian_fraud_prepared",
)
def f1_normalize_text(t: Tables) -> DataFrame:
    """NFKC and blank-collapsed form of the raw mail bodies (the table holds both)."""
    return t("nigerian_fraud_prepared").select("rec_id", X.normalize_text(F.col("raw_body")).alias("clean"))


@query(
    "f2_mask_url",
    f"SELECT rec_id, regexp_replace(regexp_replace(text, {q(X.URL_WIDE)}, '[URL]', 'g'), {q(X.URL_REST)}, '[URL]', 'g') AS masked FROM enron_ham_annotated",
)
def f2_mask_url(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").select("rec_id", X.mask_url(F.col("text")).alias("masked"))


@query("f3_mask_url_once", r"SELECT core_row_id, regexp_replace(text, '(?i)https?://\S+|www\.\S+', '[URL]', 'g') AS masked FROM core_records")
def f3_mask_url_once(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", X.mask_url_once(F.col("text")).alias("masked"))


def _sql_clean(c: str) -> str:
    c = f"regexp_replace({c}, {q(chr(92).join(['[', 'x00-', 'x08', 'x0b', 'x0c', 'x0e-', 'x1f', 'x7f]']))}, '', 'g')"
    c = f"regexp_replace({c}, {q(X.TAG)}, ' ', 'g')"
    c = f"regexp_replace({c}, {q(X.EMAIL)}, '[EMAIL]', 'g')"
    web = q("(?i)https?://[^\\s<>\"']+|www\\.[^\\s<>\"']+")
    c = f"regexp_replace({c}, {web}, '[URL]', 'g')"
    three, two = q("\\n{3,}"), "chr(10) || chr(10)"
    return f"trim(regexp_replace(regexp_replace({c}, {three}, {two}, 'g'), '[ \\t]+', ' ', 'g'))"


@query("f4_clean_text", f"SELECT rec_id, {_sql_clean('raw_body')} AS clean FROM nigerian_fraud_prepared")
def f4_clean_text(t: Tables) -> DataFrame:
    return t("nigerian_fraud_prepared").select("rec_id", X.clean_text(F.col("raw_body")).alias("clean"))


@query("f5_mask_collapsed", "SELECT rec_id, " + sql_collapse(r"regexp_replace(text, '(?i)https?://\S+|www\.\S+', '[URL]', 'g')") + " AS masked FROM smishtank_prepared")
def f5_mask_collapsed(t: Tables) -> DataFrame:
    return t("smishtank_prepared").select("rec_id", X.mask_collapsed(F.col("text")).alias("masked"))


_REPLY = rf"(?i){X.PHONE}|(?:^|[^a-z])(?:call|text|txt|reply|whatsapp)(?:[^a-z]|$)"


@query(
    "f6_contact_flags",
    f"""SELECT rec_id, CASE WHEN coalesce(regexp_matches(text, {q("(?i)https?://|www" + chr(92) + ".|" + chr(92) + "[URL" + chr(92) + "]")}), false) THEN 'yes' ELSE 'no' END AS url,
 CASE WHEN coalesce(regexp_matches(text, {q(X.EMAIL)}), false) THEN 'yes' ELSE 'no' END AS email,
 CASE WHEN coalesce(regexp_matches(text, {q(_REPLY)}), false) THEN 'yes' ELSE 'no' END AS phone FROM mendeley_smishing_prepared""",
)
def f6_contact_flags(t: Tables) -> DataFrame:
    c = F.col("text")
    return t("mendeley_smishing_prepared").select("rec_id", X.yes_no(X.has_url(c)).alias("url"), X.yes_no(X.has_email(c)).alias("email"), X.yes_no(X.has_phone_or_reply(c)).alias("phone"))


@query("f7_url_meta", f"SELECT rec_id, CAST(len(regexp_extract_all(text, {q(X.URL_COUNT)})) AS BIGINT) AS n_urls, len(regexp_extract_all(text, {q(X.URL_COUNT)})) > 0 AS any_url FROM enron_ham_annotated")
def f7_url_meta(t: Tables) -> DataFrame:
    n = X.url_count(F.col("text"))
    return t("enron_ham_annotated").select("rec_id", n.alias("n_urls"), (n > 0).alias("any_url"))


def _sql_issues(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce({test}, false) THEN '{name}' END" for name, test in pairs) + "], lambda x: x IS NOT NULL)"


_MASKING = [("unmasked_url", r"regexp_matches(text, '(?i)https?://|www\.')"), ("unmasked_email", f"regexp_matches(text, {q(X.EMAIL)})"), ("unmasked_phone", r"regexp_matches(text, '\+?\d[\d .-]{8,}\d')")]
_FORMAT = [
    ("too_few_tokens", f"len({sql_words('text')}) < 5"),
    ("markdown_header", "regexp_matches(text, '(?m)^#{1,6} ')"),
    ("markdown_emphasis", r"regexp_matches(text, '\*\*[^*]+\*\*|__[^_]+__')"),
    ("html_tag", "regexp_matches(text, '</?[a-zA-Z][^>]{0,200}>')"),
    ("wrapper_prefix", r"regexp_matches(text, '(?i)^\s*(?:here is|here''s|sure[,!]|certainly[,!]|subject:)')"),
    ("emoji_in_sms", r"channel = 'sms' AND regexp_matches(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]')"),
]


@query("f8_masking_issues", f"SELECT gen_id, array_to_string({_sql_issues(_MASKING)}, ',') AS issues FROM llm_mass_generation")
def f8_masking_issues(t: Tables) -> DataFrame:
    return t("llm_mass_generation").select("gen_id", F.array_join(X.masking_issues(F.col("text")), ",").alias("issues"))


@query("f9_format_issues", f"SELECT gen_id, array_to_string({_sql_issues(_FORMAT)}, ',') AS issues FROM llm_mass_generation")
def f9_format_issues(t: Tables) -> DataFrame:
    return t("llm_mass_generation").select("gen_id", F.array_join(X.format_issues(F.col("text"), F.col("channel")), ",").alias("issues"))


_ALL = _sql_issues(_MASKING + _FORMAT + [("MIS", f"{sql_bin(TOKENS)} <> target_bin")])


@query(
    "f10_quality",
    f"""SELECT gen_id, {TOKENS} AS token_count, {sql_bin(TOKENS)} AS actual_bin,
 replace(array_to_string({_ALL}, ','), 'MIS', 'bin_mismatch:' || coalesce({sql_bin(TOKENS)}, '')) AS issues, len({_ALL}) = 0 AS passed FROM llm_mass_generation""",
)
def f10_quality(t: Tables) -> DataFrame:
    r = t("llm_mass_generation").select("gen_id", X.quality(F.col("text"), F.col("channel"), F.col("target_bin")).alias("q"))
    return r.select("gen_id", "q.token_count", "q.actual_bin", F.array_join("q.issues", ",").alias("issues"), "q.passed")


@query("f11_slug_model", "SELECT origin_model, translate(origin_model, '/:.', '___') AS slug, count(*) AS n FROM llm_mass_generation GROUP BY 1, 2")
def f11_slug_model(t: Tables) -> DataFrame:
    return t("llm_mass_generation").groupBy("origin_model", X.slug(F.col("origin_model")).alias("slug")).agg(F.count("*").alias("n"))


@query("f12_truncate", "SELECT rec_id, substring(raw_body, 1, 2000) AS head, length(raw_body) > 2000 AS was_cut FROM nigerian_fraud_prepared")
def f12_truncate(t: Tables) -> DataFrame:
    return t("nigerian_fraud_prepared").select("rec_id", F.substring("raw_body", 1, 2000).alias("head"), (F.length("raw_body") > 2000).alias("was_cut"))


@query("f20_token_count", f"SELECT core_row_id, {TOKENS} AS tokens FROM core_records")
def f20_token_count(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", X.token_count(F.col("text")).alias("tokens"))


@query("f21_word_count", f"SELECT core_row_id, CAST(len({sql_words('text')}) AS BIGINT) AS words FROM core_records")
def f21_word_count(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", X.word_count(F.col("text")).alias("words"))


@query("f22_length_bin", f"SELECT core_row_id, {sql_bin(TOKENS, SQL_CHANNEL)} AS bin FROM core_records")
def f22_length_bin(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", X.length_bin(X.token_count(F.col("text")), channel_norm()).alias("bin"))


@query("f23_wc_bin", f"SELECT CASE WHEN n < 40 THEN 'short' WHEN n < 200 THEN 'medium' ELSE 'long' END AS bin, count(*) AS n_docs FROM (SELECT len({sql_words('text')}) AS n FROM documents) GROUP BY 1")
def f23_wc_bin(t: Tables) -> DataFrame:
    return t("documents").groupBy(X.wc_bin(X.word_count(F.col("text"))).alias("bin")).agg(F.count("*").alias("n_docs"))


@query("f24_sentence_marks", f"SELECT doc_id, {sql_count('text', '[.!?]+')} AS marks FROM documents")
def f24_sentence_marks(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.sentence_marks(F.col("text")).alias("marks"))


@query("f25_sha_key", "SELECT core_row_id, sha256(trim(coalesce(text, ''))) AS key FROM core_records")
def f25_sha_key(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", X.sha_key(F.col("text")).alias("key"))


@query("f26_md5_key", "SELECT core_row_id, md5(trim(coalesce(text, ''))) AS key FROM core_records")
def f26_md5_key(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", X.md5_key(F.col("text")).alias("key"))


@query("f27_stream_key", "SELECT rec_id, substring(sha256(concat_ws('::', subset, text)), 1, 48) AS key FROM enron_ham_annotated")
def f27_stream_key(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").select("rec_id", X.stream_key(F.col("subset"), F.col("text")).alias("key"))


@query("f28_bucket_share")
def f28_bucket_share(t: Tables) -> DataFrame:
    """A fifth of the keys by CRC-32; the other engine has no such function."""
    return t("llm_mass_generation").select("gen_id", X.bucket_share(F.col("gen_id"), 0.2).alias("chosen"))


FINGER = "CASE WHEN question_id IS NOT NULL THEN 'fq|' || question_id ELSE 'std|' || coalesce(provenance_source_file, '') || '|' || coalesce(provenance_line_no, -1) END"


@query("f29_fingerprint", f"SELECT core_row_id, {FINGER} AS fingerprint FROM core_records")
def f29_fingerprint(t: Tables) -> DataFrame:
    return t("core_records").select("core_row_id", fingerprint().alias("fingerprint"))


def fingerprint():  # noqa: ANN201 - Column
    std = F.concat(F.lit("std|"), F.coalesce("provenance_source_file", F.lit("")), F.lit("|"), F.coalesce(F.col("provenance_line_no"), F.lit(-1)).cast("string"))
    return F.when(F.col("question_id").isNotNull(), F.concat(F.lit("fq|"), F.col("question_id").cast("string"))).otherwise(std)


def sql_ascii_wordish(c: str) -> str:
    """Letters and numbers beyond ASCII as 0, so that ASCII word boundaries hold."""
    return f"regexp_replace(regexp_replace({c}, '[^\\P{{L}}a-zA-Z]', '0', 'g'), '[^\\P{{N}}0-9]', '0', 'g')"


def sql_words_lower(c: str) -> str:
    return f"list_transform(regexp_extract_all({sql_ascii_wordish(c)}, '\\b[a-zA-Z][a-zA-Z'']*\\b'), lambda v: lower(v))"


@query("f30_word_tokens", f"SELECT w AS word, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all({sql_ascii_wordish('text')}, '\\b[a-zA-Z]+\\b'))) AS w FROM documents) GROUP BY 1")
def f30_word_tokens(t: Tables) -> DataFrame:
    w = F.explode(F.transform(F.regexp_extract_all("text", F.lit(X.PLAIN_WORD), F.lit(1)), F.lower)).alias("word")
    return t("documents").select(w).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "f31_sentences",
    r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS BIGINT) AS n_sentences,
 """
    + f"CAST(len({sql_words_lower("coalesce(text, '')")}) AS BIGINT) AS n_words FROM documents",
)
def f31_sentences(t: Tables) -> DataFrame:
    c = F.col("text")
    return t("documents").select("doc_id", F.size(X.sentences(c)).cast("long").alias("n_sentences"), F.size(X.words_lower(c)).cast("long").alias("n_words"))


@query("f32_opening", f"SELECT gen_id, lower(array_to_string({sql_words('text')}[1:8], ' ')) AS opening FROM llm_mass_generation")
def f32_opening(t: Tables) -> DataFrame:
    return t("llm_mass_generation").select("gen_id", X.opening(F.col("text")).alias("opening"))


@query("f33_year", f"SELECT rec_id, CAST(nullif(regexp_extract(coalesce(date_raw, ''), {q(X.YEAR)}, 1), '') AS INTEGER) AS year FROM enron_ham_annotated")
def f33_year(t: Tables) -> DataFrame:
    return t("enron_ham_annotated").select("rec_id", X.first_year(F.col("date_raw")).alias("year"))


@query("f34_timestamp_parse", "SELECT rec_id, try_strptime(date_raw, '%m/%d/%Y %I:%M %p') AS ts FROM enron_ham_annotated")
def f34_timestamp_parse(t: Tables) -> DataFrame:
    """Dates of one stated format; anything else gives null."""
    ok = F.col("date_raw").rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$")
    ts = F.when(ok, F.try_to_timestamp("date_raw", F.lit("MM/dd/yyyy hh:mm a")))
    return t("enron_ham_annotated").select("rec_id", ts.cast("timestamp_ntz").alias("ts"))


@query(
    "proj15_language_guess",
    r"""SELECT rec_id, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'too_short' WHEN length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) / CAST(length(text) AS DOUBLE) > 0.92e0 THEN 'english_like' ELSE 'other' END AS guess FROM smishtank_prepared""",
)
def proj15_language_guess(t: Tables) -> DataFrame:
    return t("smishtank_prepared").select("rec_id", X.language_guess(F.col("text")).alias("guess"))


@query("s16_html_strip", "SELECT rec_id, regexp_replace(raw_body, '<[^>]+>', ' ', 'g') AS body FROM nigerian_fraud_prepared")
def s16_html_strip(t: Tables) -> DataFrame:
    return t("nigerian_fraud_prepared").select("rec_id", X.strip_html(F.col("raw_body")).alias("body"))


@query("s17_header_strip", r"SELECT rec_id, regexp_replace(raw_body, '\A(?:[A-Za-z][A-Za-z-]*:[^\n]*\n(?:[ \t]+[^\n]*\n)*)+\n', '') AS body FROM nigerian_fraud_prepared")
def s17_header_strip(t: Tables) -> DataFrame:
    return t("nigerian_fraud_prepared").select("rec_id", X.strip_header_lines(F.col("raw_body")).alias("body"))
