"""Problem 9: mixing sources to target weights.

A classifier trained on the labelled table gives each document a posterior over
the target domains (the sources). Projected-gradient least squares then fits
nonnegative document rates, at most ``max_repeats`` of the document's source, so
that both the expected tokens of each domain (by posterior) and the tokens of each
source (by label) match their target share of all tokens; last, each source is
shifted to its own target. So labels fix how much of a source is used, and the
classifier which of its documents: those that look like what is lacking elsewhere.

Every document has a rate of its own, from its whole posterior. The documents are
fitted in blocks by hash, about :data:`BLOCK` in each and all in one where they are
fewer. Of a domain's target a block has the part that it has of the domain's tokens,
so that blocks which meet their parts meet the whole, and the blocks run side by side
in bounded memory. The shift of a source is found over all its documents.

Defined results: null or empty texts have no tokens and are never used; documents
of a source without a weight are not used; a domain without documents, or whose
documents times repeats fall short of its target, is reported as short; copies
are documents of their own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.textform import words_of
from corpusloom.session import cut, discard, spread, table

#: Folder of the public tokenizer files; a parameter of the queries' operator.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hashed words of the classifier; the model has domains x BUCKETS numbers.
BUCKETS = 4096
#: Documents that are fitted together, about.
BLOCK = 50_000
ITERATIONS = 300
#: Shifts of each source that one pass over the rates tries, and the passes.
TRIES = 64
PASSES = 6
#: Sightings that each word bucket has beforehand in each domain.
SMOOTHING = 0.05
#: Weights of the evidence that calibration chooses from.
TEMPERS = (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08)
SEED = 7


@lru_cache(maxsize=2)
def encoding(folder: str, name: str):  # noqa: ANN201 - tiktoken.Encoding
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bucket_counts(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for w in words_of(text):
        b = xxhash.xxh32_intdigest(w.encode()) % BUCKETS
        out[b] = out.get(b, 0) + 1
    return out


def count_tokens(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, words (bucket and count of each in one number)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            words = [[c * BUCKETS + b for b, c in bucket_counts(t).items()] if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": n, "words": words})

    return docs.select("doc_id", "source", "text").mapInPandas(go, "doc_id bigint, source string, n_tokens bigint, words array<bigint>")


def train(counted: DataFrame, domains: list[str]) -> np.ndarray:
    """log P(word bucket | domain), from all labelled documents."""
    place = {d: i for i, d in enumerate(domains)}
    w = F.explode("words").alias("w")
    sums = counted.where(F.col("source").isin(domains)).select("source", w).groupBy("source", (F.col("w") % BUCKETS).alias("b")).agg(F.sum(F.floor(F.col("w") / BUCKETS)).alias("n"))
    counts = np.full((len(domains), BUCKETS), SMOOTHING)
    for r in sums.collect():  # domains x BUCKETS numbers at most
        counts[place[r.source], r.b] += r.n
    return np.log(counts / counts.sum(1, keepdims=True))


def posterior(logp: np.ndarray, words: np.ndarray, temper: float) -> np.ndarray:
    """Domain posterior; the evidence is weighed by ``temper`` and the text's length."""
    if not len(words):
        return np.full(len(logp), 1 / len(logp))
    b, k = words % BUCKETS, words // BUCKETS
    s = temper * (logp[:, b] @ k) / np.sqrt(k.sum())
    p = np.exp(s - s.max())
    return p / p.sum()


def held_out(counted: DataFrame, domains: list[str], parts: int = 10) -> dict[float, tuple[float, float]]:
    """(log-loss, accuracy) per weight of the evidence on one part of the labelled
    documents, when the classifier is trained on the others."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0
    logp = train(counted.where(~part), domains)
    place = {d: i for i, d in enumerate(domains)}

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, posterior(logp, np.asarray(w, np.int64), t), place[s]) for w, s in zip(pdf["words"], pdf["source"]) for t in TEMPERS]
            yield pd.DataFrame({"temper": [t for t, _, _ in rows], "loss": [-float(np.log(max(x[i], 1e-12))) for _, x, i in rows], "hit": [float(x.argmax() == i) for _, x, i in rows]})

    got = counted.where(part & F.col("source").isin(domains)).mapInPandas(go, "temper double, loss double, hit double").groupBy("temper").agg(F.avg("loss").alias("loss"), F.avg("hit").alias("hit")).collect()
    return {r.temper: (r.loss, r.hit) for r in got}


def calibrate(counted: DataFrame, domains: list[str]) -> float:
    """The weight of the evidence with the least loss on held-out documents."""
    got = held_out(counted, domains)
    return min(got, key=lambda t: (got[t][0], t)) if got else TEMPERS[0]


def memberships(counted: DataFrame, logp: np.ndarray, temper: float) -> DataFrame:
    """doc_id, source, n_tokens, p: the document's posterior."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [posterior(logp, np.asarray(w, np.int64), temper).astype(np.float32) for w in pdf["words"]]
            yield pdf[["doc_id", "source", "n_tokens"]].assign(p=p)

    return counted.mapInPandas(go, "doc_id bigint, source string, n_tokens bigint, p array<float>")


def masses(member: DataFrame, place: dict[str, int], classify: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each domain by posterior and by label, of the documents of its sources."""
    n = len(place)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        soft = np.zeros(n)
        for pdf in batches:
            soft += pdf["n_tokens"].to_numpy(float) @ np.stack(pdf["p"].to_numpy()).astype(float)
        yield pd.DataFrame({"domain": np.arange(n), "n": soft})

    own = member.where(F.col("source").isin(list(place)))
    hard = np.zeros(n)
    for r in own.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
        hard[place[r.source]] = r.n
    if not classify:
        return hard, hard
    soft = np.zeros(n)
    for r in own.mapInPandas(go, "domain int, n double").groupBy("domain").agg(F.sum("n").alias("n")).collect():
        soft[r.domain] = round(r.n)  # whole tokens: the same for any order of the sum
    return soft, hard


def fit(tokens: np.ndarray, p: np.ndarray, source: np.ndarray, caps: np.ndarray, targets: np.ndarray, soft_all: np.ndarray, hard_all: np.ndarray, iterations: int) -> np.ndarray:
    """Rates of a block's documents: projected gradient on domain totals by posterior
    and by label, each step scaled by the domain's mass. ``soft_all`` and ``hard_all``
    are the masses of all blocks, by which a block has its part of the targets."""
    n, cap = len(targets), caps[source]
    r = np.minimum(1.0, cap)
    soft, hard = tokens @ p, np.bincount(source, tokens, n)
    want, want_label = targets * soft / np.maximum(soft_all, 1.0), targets * hard / np.maximum(hard_all, 1.0)
    soft_mass, hard_mass = np.maximum(soft, 1.0), np.maximum(hard, 1.0)
    for _ in range(iterations):
        used = tokens * r
        step = p @ ((used @ p - want) / soft_mass) + ((np.bincount(source, used, n) - want_label) / hard_mass)[source]
        r = np.clip(r - 0.5 * step, 0.0, cap)
    return r


def rates(member: DataFrame, place: dict[str, int], caps: np.ndarray, targets: np.ndarray, iterations: int, classify: bool, block: int = BLOCK) -> DataFrame:
    """doc_id, source, n_tokens, r: the fitted rate of each document, before the shift."""
    soft_all, hard_all = masses(member, place, classify)
    blocks = max(1, -(-member.count() // block))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable", ignore_index=True)  # sums in one order
        source = pdf["source"].map(place)
        own = source.notna().to_numpy()
        r = np.zeros(len(pdf))
        if own.any():
            at = source[own].to_numpy(int)
            p = np.stack(pdf["p"][own].to_numpy()).astype(float) if classify else np.eye(len(place))[at]
            r[own] = fit(pdf["n_tokens"][own].to_numpy(float), p, at, caps, targets, soft_all, hard_all, iterations)
        return pdf[["doc_id", "source", "n_tokens"]].assign(r=r)

    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(blocks)).alias("block")
    return member.groupBy(part).applyInPandas(go, "doc_id bigint, source string, n_tokens bigint, r double")


def shifts(fitted: DataFrame, place: dict[str, int], caps: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The least shift of each source's rates at which it has its target, over all its
    documents; a source that cannot have it is shifted to its repeats."""
    n = len(place)
    low, high = -caps - 1, caps + 1
    own = fitted.where(F.col("source").isin(list(place)) & (F.col("n_tokens") > 0))
    for _ in range(PASSES):
        grid = low[:, None] + (high - low)[:, None] * np.arange(1, TRIES + 1) / TRIES

        def go(batches: Iterator[pd.DataFrame], grid: np.ndarray = grid) -> Iterator[pd.DataFrame]:
            out = np.zeros((n, TRIES))
            for pdf in batches:
                source, r, tokens = pdf["source"].map(place).to_numpy(int), pdf["r"].to_numpy(), pdf["n_tokens"].to_numpy(float)
                for d in np.unique(source):
                    at = source == d
                    out[d] += tokens[at] @ np.clip(r[at][:, None] + grid[d], 0, caps[d])
            yield pd.DataFrame({"domain": np.arange(n), "n": list(out)})

        got = np.zeros((n, TRIES))
        for x in own.mapInPandas(go, "domain int, n array<double>").collect():  # domains x TRIES numbers a task
            got[x.domain] += x.n
        first = np.where((got >= targets[:, None]).any(1), (got >= targets[:, None]).argmax(1), TRIES - 1)
        low, high = np.where(first > 0, grid[np.arange(n), first - 1], low), grid[np.arange(n), first]
    return high


def mix(docs: DataFrame, weights: DataFrame, iterations: int = ITERATIONS, folder: str = TOKENIZERS, name: str = VOCABULARY, classify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mixture: doc_id, source, n_tokens, repeats; shares per source). ``classify``
    switches the classifier off (each document is its label), to see what it does."""
    w = weights.orderBy("source").collect()  # one row a source, given by hand
    domains = [r.source for r in w]
    place, caps = {r.source: i for i, r in enumerate(w)}, np.array([float(r.max_repeats) for r in w])
    counted = cut(count_tokens(docs, folder, name))
    member = cut(memberships(counted, train(counted, domains), calibrate(counted, domains)))
    discard(counted)
    total = member.agg(F.sum("n_tokens")).first()[0] or 0
    targets = np.array([float(x.target_share) for x in w]) * total
    fitted = cut(rates(member, place, caps, targets, iterations, classify))
    discard(member)
    shift = shifts(fitted, place, caps, targets)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf["source"].map(place)
            own, at = at.notna().to_numpy(), at.fillna(0).to_numpy(int)
            cap = np.where(own, caps[at], 0.0)
            r = np.clip(pdf["r"].to_numpy() + shift[at], 0, cap)
            u = np.array([xxhash.xxh64_intdigest(f"{SEED}|{i}".encode()) / 2**64 for i in pdf["doc_id"]])
            whole = np.floor(r + 1e-9)
            pdf["repeats"] = np.where(pdf["n_tokens"] > 0, np.minimum(whole + (u < r - whole), cap), 0).astype(int)
            yield pdf[["doc_id", "source", "n_tokens", "repeats"]]

    mixture = fitted.mapInPandas(go, "doc_id bigint, source string, n_tokens bigint, repeats int")
    have = mixture.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixture_tokens"))
    share = weights.join(have, "source", "left").na.fill(0, ["available_tokens", "mixture_tokens"])
    all_ = have.agg(F.sum("mixture_tokens").alias("_all"))
    report = share.crossJoin(F.broadcast(all_)).select(
        "source",
        "target_share",
        F.round(F.col("mixture_tokens") / F.col("_all"), 6).alias("actual_share"),
        F.round(F.col("mixture_tokens") / F.lit(float(total or 1)), 6).alias("share_of_budget"),
        "available_tokens",
        "mixture_tokens",
        "max_repeats",
        (F.col("available_tokens") * F.col("max_repeats") < F.col("target_share") * F.lit(float(total))).alias("short"),
    )
    return mixture, report


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"))
    return mix(docs, table(spark, sf_dir, "source_weights"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of times the mixture uses it."""
    return _run(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _run(spark, sf_dir)[1]
