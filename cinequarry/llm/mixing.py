"""Mixing sources to target weights by soft membership.

A naive-Bayes table, learned from labelled documents, gives every document a
posterior over domains. Projected-gradient least squares then finds a nonnegative
rate for every document so that the expected tokens of each domain meet targets.

DataFrame functions only: no Python runs on executors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import int_table, materialize, words_of

#: Domains, in this order, and the share of the tokens each should have.
TARGETS = {"good": 0.98, "poor": 0.01, "toxic": 0.01}
#: The domain whose own tokens set the size of a mixture, unless a size is given.
ANCHOR = "good"
BUCKETS = 65536
#: Labelled rows used at most, those with the least hash of their id.
MAX_LABELLED = 50_000
#: Weights are integers, SCALE * log ratio, within LIMIT; a word counts only if its ratio is this many standard errors above 1.
SCALE, LIMIT, ERRORS = 25, 127, 4.0
#: Two sums of weights share a long: as a word counts once a document, each stays within half a FIELD.
FIELD = 1 << 25
#: How often a document may be drawn at most; rates are projected onto [0, MAX_RATE].
MAX_RATE = 4.0
#: The descent ends when expected tokens miss the targets by this share in sum, or no longer come nearer.
ROUNDS, TOLERANCE = 200, 1e-4
#: Share of what is missing that a step has to take off at least, or it is halved; the shortest step tried.
GAIN, SHORTEST = 5e-3, 0.1


@dataclass(frozen=True)
class DomainModel:
    """prior: log share of each domain, with what it tells to hold no bucket; weights: for each domain but the first, by bucket,
    SCALE * log of how much likelier its documents hold the bucket than the first's."""

    prior: list[float]
    weights: list[list[int]]


def domain_of() -> Column:
    """Index into TARGETS of a labelled row."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)


def _buckets(words: Column | str, buckets: int) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def learn(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MAX_LABELLED) -> DomainModel:
    """Word counts by bucket and domain over a bounded sample of labelled documents;
    a word counts once a document. Only sums by bucket reach the driver."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), domain_of().alias("_d"))
    own = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id"))
    k = len(TARGETS)
    by = own.select("_d", F.explode(F.concat(F.array(F.lit(-1)), _buckets(words_of("text"), buckets))).alias("b"))
    counts = by.groupBy("b").agg(*[F.count_if(F.col("_d") == i).alias(f"n{i}") for i in range(k)]).collect()
    seen = np.zeros((k, buckets))
    n_docs = np.zeros(k)
    for r in counts:
        column = [r[f"n{i}"] for i in range(k)]
        if r.b < 0:
            n_docs = np.array(column, float)
        else:
            seen[:, r.b] = column
    held = (seen + 0.5) / (n_docs[:, None] + 1)
    ratio, error = np.log(held[1:] / held[0]), np.sqrt(1 / (seen[1:] + 0.5) + 1 / (seen[0] + 0.5))
    telling = ratio >= ERRORS * error  # a common word that is missing says more of a text's length
    absent = np.where(telling, np.log((1 - held[1:]) / (1 - held[0])), 0.0)  # what not to hold a bucket tells
    weights = np.where(telling, np.clip(np.rint(SCALE * (ratio - absent)), -LIMIT, LIMIT), 0)
    prior = np.log((n_docs + 1) / (n_docs.sum() + k)) + np.concatenate([[0.0], absent.sum(axis=1)])
    return DomainModel(prior.tolist(), weights.astype(int).tolist())


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """Adds _n (double: words) and _p (array<double>: posterior of each domain)."""
    df = docs.withColumn("_w", words_of(text_col)).withColumn("_n", F.size("_w").cast("double"))
    df = df.withColumn("_b", _buckets("_w", len(model.weights[0])))

    def sums(weights: list[list[int]]) -> list[Column]:
        """Sums of two domains' weights over a document, gathered at once."""
        packed = int_table([sum(w * FIELD**i for i, w in enumerate(both)) for both in zip(*weights, strict=True)], "bigint")
        whole = F.aggregate("_b", F.lit(0).cast("long"), lambda s, b: s + F.get(packed, b))
        low = F.pmod(whole + FIELD // 2, F.lit(FIELD)) - FIELD // 2
        return [low, (whole - low) / FIELD][: len(weights)]

    rest = [x for i in range(0, len(model.weights), 2) for x in sums(model.weights[i : i + 2])]
    logits = [F.lit(model.prior[0]), *[F.lit(p) + x / SCALE for p, x in zip(model.prior[1:], rest, strict=True)]]
    df = df.withColumn("_z", F.array(*logits)).withColumn("_z", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    total = F.aggregate("_z", F.lit(0.0), lambda s, z: s + z)
    return df.withColumn("_p", F.transform("_z", lambda z: z / total)).drop("_w", "_b", "_z")


def rate_after(steps: list[list[float]]) -> Column:
    """Rate of a document after these gradient steps: from 1, each step takes off the
    posterior's product with the step, then projects onto [0, MAX_RATE]."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    all_steps = F.split(F.lit(";".join(",".join(map(repr, s)) for s in steps)), ";")
    parsed = F.transform(all_steps, lambda s: F.split(s, ",").cast("array<double>"))
    dot = lambda y: F.aggregate(F.zip_with("_p", y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(parsed, rate, lambda r, y: F.least(F.lit(MAX_RATE), F.greatest(F.lit(0.0), r - dot(y))))


@dataclass(frozen=True)
class Mixture:
    """Gradient steps, and tokens by domain: wanted and expected."""

    steps: list[list[float]]
    wanted: list[float]
    expected: list[float]

    @property
    def missed(self) -> float:
        """Share of the wanted tokens that is missed, in sum: above TOLERANCE, the targets can't be met."""
        return sum(abs(a - b) for a, b in zip(self.wanted, self.expected, strict=True)) / (sum(self.wanted) or 1.0)


def solve(sized: DataFrame, targets: dict[str, float] | None = None, size: float | None = None, rounds: int = ROUNDS) -> Mixture:
    """Gradient steps whose rates make expected tokens meet the targets: ``size`` tokens
    dealt by the targets' weights. Without a size, the anchor domain's tokens stay as they
    are and the others follow.

    Minimises |A r - T| over rates in [0, MAX_RATE], A[k, i] = n_i p_ik. The gradient
    needs only the residual by domain, so a round is one sum over the documents and
    sends as many numbers as there are pairs of domains. The residual is scaled by the
    inverse of A D A' (D: 1 / tokens) over the documents that no bound holds, which makes
    a unit step right wherever no further document meets a bound; a step that doesn't
    come nearer by GAIN is halved. Targets are never changed: what can't be met is ``missed``."""
    targets = targets or TARGETS
    weights = np.array(list(targets.values()), float)
    weights = weights / weights.sum()
    k = len(weights)
    p = [F.col("_p")[i] for i in range(k)]

    def state(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain, and A D A' over documents whose rate is free to move."""
        rated = sized.withColumn("_r", rate_after(steps))
        tokens = [F.sum(F.col("_n") * p[i] * F.col("_r")) for i in range(k)]
        free = F.when((F.col("_r") > 0) & (F.col("_r") < MAX_RATE), F.col("_n"))
        gram = [F.sum(free * p[i] * p[j]) for i in range(k) for j in range(k)]
        row = [x or 0.0 for x in rated.agg(*tokens, *gram).first()]
        return np.array(row[:k]), np.array(row[k:]).reshape(k, k)

    now, gram = state([])
    at = list(targets).index(ANCHOR) if targets.get(ANCHOR) else int(np.argmax(now * (weights > 0)))
    aims = weights * (now[at] / weights[at] if size is None else size)
    steps: list[list[float]] = []
    scale = 1.0
    while len(steps) < rounds and np.abs(now - aims).sum() > TOLERANCE * aims.sum() and np.trace(gram) > 0 and scale > SHORTEST:
        step = scale * np.linalg.solve(gram + 1e-5 * np.trace(gram) / k * np.eye(k), now - aims)
        then, then_gram = state([*steps, step.tolist()])
        if np.linalg.norm(then - aims) < np.linalg.norm(now - aims) * (1 - GAIN):
            steps, now, gram, scale = [*steps, step.tolist()], then, then_gram, min(1.0, 2 * scale)
        else:
            scale /= 2
    return Mixture(steps, aims.tolist(), now.tolist())


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, size: float | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens (long: words), p_<domain> (double,
    posteriors, sum 1) and rate (double, how often the document should be drawn); and, the
    same in each row, wanted_<domain> and expected_<domain> (double, tokens of the mixture
    by the targets and by the rates) and missed (double, share of the wanted tokens that isn't
    met, in sum).

    Null and empty texts have no tokens, the prior as posterior and a rate like any
    other. Repeated rows are each a document. With no labelled documents all domains
    are equally likely. A domain that has fewer tokens than its target is repeated, up to
    MAX_RATE; targets that can't be met show in expected tokens. Extra columns are not read."""
    model = learn(docs, labels)
    sized = materialize(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "_n", "_p"), "posteriors")
    mixture = solve(sized, targets, size)
    names = list(targets or TARGETS)
    told = {f"{kind}_{x}": round(v, 3) for kind, values in (("wanted", mixture.wanted), ("expected", mixture.expected)) for x, v in zip(names, values, strict=True)}
    told["missed"] = round(mixture.missed, 6)
    posteriors = [F.round(F.col("_p")[i], 6).alias(f"p_{x}") for i, x in enumerate(names)]
    return sized.select("doc_id", F.col("_n").cast("long").alias("n_tokens"), *posteriors, F.round(rate_after(mixture.steps), 6).alias("rate"), *[F.lit(v).alias(x) for x, v in told.items()])


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, size: float | None = None) -> DataFrame:
    """The mixture itself: every document as often as its rate says. The whole part
    of a rate is kept as copies; the rest decides by a hash of the id, the same at
    every run. Columns are those of ``docs``, whatever their names (doc_id and text
    aside, they travel in one struct); a document of rate 1 or more always stays."""
    rest = F.struct(F.lit(0).alias("__row"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_row")
    known = materialize(with_posteriors(docs.select("doc_id", "text", rest), learn(docs, labels)), "posteriors")
    steps = solve(known.select("_n", "_p"), targets, size).steps
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    df = known.withColumn("_c", F.floor(rate_after(steps) + chance).cast("int"))
    df = df.withColumn("_c", F.explode(F.when(F.col("_c") > 0, F.sequence(F.lit(1), F.col("_c")))))
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"_row.`{c}`").alias(c) for c in docs.columns])
