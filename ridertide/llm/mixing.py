"""Mixing to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier of hashed words, fitted on the labelled table, gives each document a posterior over domains. Of
the buckets of words only those count in which the documents of some domain differ from all others by more than chance;
in a text a bucket counts once. The log-odds are calibrated on labelled rows that they were not fitted on: two halves
score each other, and a logistic regression of the domains on those scores, weighted by tokens, makes expected totals
those that the labels show. Rates r >= 0 of the documents are then fitted so that the expected domain totals, sum of tokens * posterior * rate,
match the targets in the least squares sense, with a weak pull to rate 1. A step is one aggregate over (tokens,
posterior); what reaches the driver are sums by domain. A document's rate is its expected number of copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.llm.sketch import once, words
from ridertide.llm.tables import stage

#: Domains by the labels, and the share of tokens that each should have: what is labelled toxic is toxic whatever its
#: quality, the rest is good or poor by `quality`.
#: Soft membership gives clean text some share of toxic; a target near 0 would leave out most of it.
TARGETS = {"good": 0.92, "poor": 0.05, "toxic": 0.03}
#: Labelled rows that the classifier is fitted on at most, those with the smallest hash first; buckets of words.
LABELLED_ROWS, BUCKETS = 10_000, 1 << 15
#: Added to the documents of a domain that have a bucket; standard errors by which a domain must differ from the others.
SMOOTHING, APART = 0.5, 3.5
STEPS, CLOSE = 30, 1e-5
#: Pull of the calibration towards no information, in rows of mean length, and of the rates towards 1: a weaker one comes
#: nearer to the targets and leaves out more documents that are hard to tell apart.
PULL, PULL_TO_ONE = 0.5, 0.01


def bucket_of(word: Column, buckets: int) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(buckets)) + 1).cast("int")


@dataclass
class Model:
    """Log-odds of each domain to the first by bucket, 0 for a bucket that tells nothing. A text's sums of them, one for
    each domain but the first, times `slope` and plus `shift`, are its log-odds."""

    odds: np.ndarray
    slope: np.ndarray
    shift: np.ndarray


def log_odds(having: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """By domain and bucket, from the documents that have a bucket and all documents of the domains."""
    share = (having + SMOOTHING) / (documents[:, None] + 2 * SMOOTHING)
    rest_n = documents.sum() - documents
    rest = (having.sum(0) - having + SMOOTHING) / (rest_n[:, None] + 2 * SMOOTHING)
    error = np.sqrt(share * (1 - share) / np.maximum(documents, 1)[:, None] + rest * (1 - rest) / np.maximum(rest_n, 1)[:, None])
    telling = (np.abs(share - rest) > APART * error).any(0)
    return np.where(telling, np.log(share) - np.log(share[0]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], buckets: int = BUCKETS) -> Model | None:
    """None without labelled text. Toxic labels count only where toxic is a domain; a document with several labels is
    toxic if one says so, and poor if one says so."""
    toxic = F.max(F.coalesce("toxic", F.lit(0))) == 1 if "toxic" in domains else F.lit(False)
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    named = named.agg(F.when(toxic, "toxic").when(F.min("quality") == 1, "good").when(F.min("quality").isNotNull(), "poor").alias("domain"))
    named = named.where(F.col("domain").isin(*domains))
    # At most LABELLED_ROWS rows, so this side is small whatever the tables hold.
    named = F.broadcast(named.orderBy(F.xxhash64("labelled"), "labelled").limit(LABELLED_ROWS))
    found = docs.join(named, F.col("doc_id") == F.col("labelled"))
    half = F.pmod(F.xxhash64("labelled", F.lit(3)), F.lit(2)).cast("int").alias("half")
    text = F.coalesce("text", F.lit(""))
    found = stage(found.select("domain", half, F.size(words(text)).alias("n"), buckets_of(text, buckets).alias("buckets")))
    # Bucket 0 counts the documents.
    cells = found.select("half", "domain", F.explode(F.array_append("buckets", F.lit(0))).alias("bucket"))
    counts = np.zeros((2, len(domains), buckets + 1))
    for half_, domain, bucket, n in cells.groupBy("half", "domain", "bucket").count().collect():
        counts[half_, domains.index(domain), bucket] += n
    documents = counts[:, :, 0]
    if not documents.sum():
        return None
    k = len(domains) - 1
    prior = np.log((documents.sum(0) + 1) / (documents.sum() + len(domains)))
    slope, shift = np.zeros((k, k)), (prior - prior[0])[1:]
    # Each half is scored by the table of the other: a few numbers for each of LABELLED_ROWS rows at most.
    odds = [log_odds(counts[1 - h, :, 1:], documents[1 - h]) for h in (0, 1)]
    other = lambda d: F.when(F.col("half") == 0, summed(F.col("buckets"), odds[0][d])).otherwise(summed(F.col("buckets"), odds[1][d]))
    rows = found.where("n > 0").select("domain", "n", *[other(d).alias(f"s{d}") for d in range(1, k + 1)]).collect()
    if rows and k:
        values = np.array([[r[f"s{d}"] for d in range(1, k + 1)] for r in rows])
        slope, shift = calibrated(values, np.array([domains.index(r["domain"]) for r in rows]), np.array([r["n"] for r in rows], float), shift)
    return Model(log_odds(counts[:, :, 1:].sum(0), documents.sum(0)), slope, shift)


def calibrated(scores: np.ndarray, domain: np.ndarray, tokens: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope, shift): logistic regression of the domains but the first on all scores, by Newton's method. Rows weigh by
    their tokens; a weak pull towards slope 0 and the given shifts keeps the fit finite where domains are apart or absent."""
    n, k = scores.shape
    x = np.hstack([scores, np.ones((n, 1))])
    weight = tokens / tokens.mean()
    theta = np.hstack([np.zeros((k, k)), shift[:, None]])
    home = theta.copy()
    is_ = (domain[:, None] == np.arange(1, k + 1)).astype(float)

    def shares(t: np.ndarray) -> tuple[np.ndarray, float]:
        z = x @ t.T
        top = np.maximum(z.max(1, initial=0.0), 0.0)
        total = np.exp(z - top[:, None]).sum(1) + np.exp(-top)
        loss = (weight * (top + np.log(total) - (z * is_).sum(1))).sum() + PULL / 2 * ((t - home) ** 2).sum()
        return np.exp(z - top[:, None]) / total[:, None], loss

    p, loss = shares(theta)
    for _ in range(60):
        slope = ((is_ - p) * weight[:, None]).T @ x - PULL * (theta - home)
        curve = np.zeros((k, k + 1, k, k + 1))
        for a in range(k):
            for b in range(k):
                curve[a, :, b] = (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        size = k * (k + 1)
        step = np.linalg.solve(curve.reshape(size, size) + PULL * np.eye(size), slope.ravel()).reshape(k, k + 1)
        part = 1.0
        while part > 1e-6:
            now, after = shares(theta + part * step)
            if after <= loss:
                break
            part /= 2
        if part <= 1e-6 or loss - after < 1e-10 * abs(loss):
            break
        theta, p, loss = theta + part * step, now, after
    return theta[:, :k], theta[:, k]


def constant(values: np.ndarray) -> Column:
    """A constant array that Spark folds into the plan once."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def added(weights: Column):
    return lambda total, bucket: total + F.element_at(weights, bucket)


def buckets_of(text: Column, buckets: int) -> Column:
    """The buckets that a text's words fall in, each once."""
    return F.array_distinct(F.transform(words(text), lambda w: bucket_of(w, buckets)))


def summed(buckets: Column, weights: np.ndarray) -> Column:
    return F.aggregate(buckets, F.lit(0.0), added(constant(weights)))


def posterior(text: Column, model: Model | None, domains: list[str]) -> Column:
    """One share for each domain. A text without words has the shares that the shifts alone give; without a model all
    domains are equal."""
    if model is None:
        return F.array(*[F.lit(1.0 / len(domains)) for _ in domains])

    def score(buckets: Column) -> Column:
        return F.array(*[summed(buckets, row) for row in model.odds[1:]])

    def logits(sums: Column) -> Column:
        parts = [F.lit(0.0)]
        for row, shift in zip(model.slope, model.shift, strict=True):
            parts.append(sum((F.lit(float(v)) * F.element_at(sums, d + 1) for d, v in enumerate(row)), F.lit(float(shift))))
        return F.array(*parts)

    def normal(logs: Column) -> Column:
        powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return once(powers, lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))

    buckets = buckets_of(F.coalesce(text, F.lit("")), model.odds.shape[1])
    return once(once(once(buckets, score), logits), normal)


def posteriors(docs: DataFrame, model: Model | None, domains: list[str]) -> DataFrame:
    """docs with tokens (words of the text) and posterior (one share for each domain)."""
    docs = docs.withColumn("tokens", F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long"))
    return docs.withColumn("posterior", posterior(F.col("text"), model, domains))


def rate_of(posterior_: Column, away: np.ndarray) -> Column:
    """The rate of a document: 1 less the sum of `away` over its posterior, never below 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.element_at(posterior_, k + 1) * F.lit(float(v)) for k, v in enumerate(away)), F.lit(0.0)))


def fit_rates(known: DataFrame, weights: np.ndarray, pull: float = PULL_TO_ONE, steps: int = STEPS, close: float = CLOSE) -> np.ndarray:
    """What the rates of `rate_of` take, by domain. known: tokens, posterior (written, read many times).

    The rates make least |shares - weights|^2 + pull * (mean over tokens of (rate - 1)^2) among all rates of 0 or more.
    At the least, a document's rate is 1 less its posterior times the gap over the pull, projected to 0 or more; so
    projected gradient steps move d numbers, not one for each document. Steps are scaled by the Gram matrix of the
    documents whose rate is positive and halved while they lead away; each is one aggregate."""
    d = len(weights)
    tokens = F.col("tokens").cast("double")

    def looked_at(away: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(gap to the weights, Gram matrix of the documents that are left) at these rates."""
        rate = rate_of(F.col("posterior"), away).alias("r")
        now = known.select(tokens.alias("t"), *[F.element_at("posterior", k + 1).alias(f"p{k}") for k in range(d)], rate)
        totals = [F.sum(F.expr(f"t * p{k} * r")) for k in range(d)]
        gram = [F.sum(F.expr(f"CASE WHEN r > 0 THEN t * p{j} * p{k} ELSE 0 END")) for j in range(d) for k in range(d)]
        row = [x or 0.0 for x in now.agg(F.sum("t"), *totals, *gram).first()]
        if not row[0]:
            return None
        return np.array(row[1 : d + 1]) / row[0] - weights, np.array(row[d + 1 :]).reshape(d, d) / row[0]

    away = np.zeros(d)
    at = looked_at(away)
    if at is None:
        return away
    for _ in range(steps):
        left = at[0] - pull * away
        if np.abs(left).max() < close:
            break
        step = np.linalg.solve(at[1] + pull * np.eye(d), left)
        while np.abs(step).max() > close:
            after = looked_at(away + step)
            if np.abs(after[0] - pull * (away + step)).sum() < np.abs(left).sum():
                break
            step = step / 2
        else:
            break
        away, at = away + step, after
    return away


def shares(domains: list[str]) -> list[Column]:
    """p_<domain> columns of a posterior. p_toxic is the share of the toxic domain, the others are shares of the rest."""
    part = {name: F.element_at("posterior", k + 1) for k, name in enumerate(domains)}
    rest = sum((p for name, p in part.items() if name != "toxic"), F.lit(0.0))
    others = len(domains) - ("toxic" in domains)
    # Where all is toxic, nothing tells the others apart.
    of_rest = lambda p: F.when(rest > 0, p / rest).otherwise(1.0 / max(others, 1))
    return [(p if name == "toxic" or "toxic" not in part else of_rest(p)).alias(f"p_{name}") for name, p in part.items()]


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, seed: int = 29) -> DataFrame:
    """doc_id, tokens, one p_<domain> column each, rate, copies: what each document contributes to the mix.

    p_toxic is the share of toxic text, p_good and p_poor are shares of the rest and add up to 1.

    copies is the rate rounded up or down at random with the right mean, fixed by doc_id and seed. A null text has no
    tokens and the prior as posterior; rows that share a doc_id are documents of their own with one random number; a
    null doc_id has a random number too; without labels or without tokens every rate is 1; an empty table stays empty.
    """
    domains, _, away, known = fitted(docs, labels, targets)
    rate = rate_of(F.col("posterior"), away)
    out = known.select("doc_id", "tokens", *shares(domains), rate.alias("rate"))
    return out.withColumn("copies", rounded(F.col("rate"), F.col("doc_id"), seed))


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None) -> tuple[list[str], Model | None, np.ndarray, DataFrame]:
    """(domains, classifier, what rates take by domain, the staged table of doc_id, tokens and posterior)."""
    targets = targets or TARGETS
    domains = list(targets)
    weights = np.array([targets[k] for k in domains]) / sum(targets.values())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(texts, labels, domains)
    known = stage(posteriors(texts, model, domains).select("doc_id", "tokens", "posterior"))
    return domains, model, fit_rates(known, weights) if model else np.zeros(len(domains)), known


def rounded(rate: Column, doc_id: Column, seed: int) -> Column:
    random = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1)), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + random).cast("long")


def with_copies(docs: DataFrame, labels: DataFrame, name: str, targets: dict[str, float] | None = None, seed: int = 29) -> DataFrame:
    """docs with the number of copies of each row, as in `mixed`. The posterior is worked out again from the row's own
    text, so rows need no key and no text is moved."""
    domains, model, away, _ = fitted(docs, labels, targets)
    rate = once(posterior(F.col("text"), model, domains), lambda p: rate_of(p, away))
    return docs.withColumn(name, rounded(rate, F.col("doc_id"), seed))
