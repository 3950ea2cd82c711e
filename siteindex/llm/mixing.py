"""Rates for documents so that domains get target shares of the tokens, by soft membership.

A classifier learned from at most ``FIT_ROWS`` labelled rows says how likely a document is of
each domain: counts of labelled documents by hashed word and domain give log-likelihoods, summed
over a document's distinct words; words of no labelled document say nothing. The evidence of a
document counts as that of ``EVIDENCE`` words at most, so that membership stays soft. A document
of ``n`` tokens read at rate ``r`` adds ``r * n * p`` tokens to each domain. The rates minimise the
squared distance of the domains' expected totals to their targets (each relative to its target)
and, weighted by ``RIDGE``, of the rates to 1, subject to ``r >= 0``. Projected gradient steps with
momentum do this: a step needs the totals alone, one number for each domain, and each document
replays the steps since its rate was last written. Steps go on until every total is within
``TOLERANCE`` of its target. Where the squared distance has not fallen to ``PROGRESS`` of its best in
``PATIENCE`` steps, rates may go further from 1 (a tenth of the ridge). Steps end there if the
documents prove that no rates meet the targets, or if the ridge is the least; a warning says
which and by how much the worst total is off.

Defined cases: null and empty texts have no tokens, the prior as membership and a rate all the
same; null ids are never labelled; labels of no target domain are left out; several labels of an
id, and several rows of it, count each in learning; rows equal in id and text are one document
with one rate; a domain without labelled documents has the prior of half a document; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import BLANKS, KEY, VERSION, id_key, id_of, keyed, written

BUCKETS, EVIDENCE, DRAWN, RIDGE, SEED = 1 << 16, 64, 20.0, 1e-3, 7
#: Labelled rows to learn from at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
WRITE_EVERY, TOLERANCE = 12, 2e-3
#: When steps no longer help: squares not below this part of their best in so many steps.
PROGRESS, PATIENCE, LEAST_RIDGE = 0.9, 12, 1e-5


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _features(docs: DataFrame) -> DataFrame:
    """Tokens and distinct word buckets of each document."""
    words = F.filter(F.split(F.lower("text"), f"[{BLANKS}]+"), lambda w: w != "")
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    split = keyed(docs).select(KEY, VERSION, words.alias("words"))
    return split.select(
        KEY,
        VERSION,
        F.size("words").cast("bigint").alias("n_tokens"),
        F.array_distinct(F.transform("words", bucket)).alias("buckets"),
    ).withColumn("n_buckets", F.size("buckets"))


def _weights(features: DataFrame, labelled: DataFrame, domains: list[str]):
    """Log-likelihoods by bucket, a table of ``BUCKETS`` rows at most, and the prior.

    A word's share of a domain's documents is drawn to its share of all, as if ``DRAWN`` more
    documents had that; the logarithm is taken relative to the latter.
    """
    marks = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select(
        id_key().alias(KEY), "domain"
    )
    marks = marks.orderBy(F.xxhash64(F.lit(SEED), KEY), KEY, "domain").limit(FIT_ROWS)
    known = features.join(F.broadcast(marks), KEY)
    each = [F.count_if(F.col("domain") == d).alias(f"c{j}") for j, d in enumerate(domains)]
    docs = [float(c) for c in known.agg(*each).first()]
    total = max(1.0, sum(docs))
    counts = known.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*each)
    seen = sum((F.col(f"c{j}") for j in range(len(domains))), F.lit(0)) / F.lit(total)
    weights = counts.withColumn("s", seen).select(
        "bucket",
        *(
            F.log((F.col(f"c{j}") / F.col("s") + DRAWN) / (n + DRAWN)).alias(f"w{j}")
            for j, n in enumerate(docs)
        ),
    )
    prior = [math.log((n + 0.5) / (total + 0.5 * len(docs))) for n in docs]
    return weights, prior


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """``_key, _version, n_tokens, p``: the probability of each domain, in their order."""
    features = written(_features(docs), "mix-features")
    weights, prior = _weights(features, labelled, domains)
    weights = written(weights, "mix-weights")
    sums = [F.sum(f"w{j}").alias(f"w{j}") for j in range(len(domains))]
    found = (
        features.select(KEY, VERSION, F.explode("buckets").alias("bucket"))
        .join(F.broadcast(weights), "bucket")
        .groupBy(KEY, VERSION)
        .agg(*sums)
    )
    rows = features.groupBy(KEY, VERSION).agg(
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_buckets").alias("n_buckets"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    share = F.lit(float(EVIDENCE)) / F.greatest("n_buckets", F.lit(EVIDENCE)) / F.col("n_rows")
    logs = [
        F.lit(prior[j]) + share * F.coalesce(f"w{j}", F.lit(0.0)) for j in range(len(domains))
    ]
    joined = rows.join(found, [KEY, VERSION], "left").withColumn("l", F.array(*logs))
    odds = F.transform("l", lambda x: F.exp(x - F.array_max("l")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("odds", odds).select(
        KEY, VERSION, "n_tokens", F.transform("odds", lambda x: x / total).alias("p")
    )


def fitted_rates(
    members: DataFrame, targets: Mapping[str, float], epochs: float = 1.0
) -> DataFrame:
    """``members`` with ``rate``; the expected tokens of all are ``epochs`` times those there.

    Warns if the targets were not met; ``expected_shares`` tells what was reached.
    """
    shares = [v / sum(targets.values()) for v in targets.values()]
    at = range(len(shares))
    p = [F.col("p")[j] for j in at]
    spread = sum((F.col("n_tokens") * p[j] * p[j] / F.lit(shares[j]) for j in at), F.lit(0.0))
    tokens, bound = members.agg(F.sum("n_tokens"), F.sum(spread)).first()
    state = members.withColumn("rate", F.lit(1.0)).withColumn("last", F.lit(1.0))
    if not tokens:
        return state.drop("last")
    steep = bound / tokens
    # of each step since the state was written: momentum, ridge, length of the step, gradient
    pulls: list[tuple[float, ...]] = []

    def replayed() -> Column:
        start = F.struct(F.col("rate").alias("r"), F.col("last").alias("b"), F.col("rate").alias("y"))
        if not pulls:
            return start

        def step(s, pull):
            ahead = s["r"] + pull[0] * (s["r"] - s["b"])
            slope = sum((F.col("p")[j] * pull[j + 3] for j in at), F.lit(0.0))
            moved = ahead - pull[2] * (slope + pull[1] * (ahead - 1.0))
            return F.struct(
                F.greatest(F.lit(0.0), moved).alias("r"), s["r"].alias("b"), ahead.alias("y")
            )

        return F.aggregate(F.array(*(_numbers(x) for x in pulls)), start, step)

    ridge, paced, best, since = RIDGE, 0, math.inf, 0
    slopes, proven = [0.0 for _ in at], False
    while True:
        momentum = paced / (paced + 3)
        now = state.select("n_tokens", "p", replayed().alias("s"))
        ahead = F.col("s.r") + F.lit(momentum) * (F.col("s.r") - F.col("s.b"))
        against = F.col("n_tokens") * (F.col("s.y") - F.col("s.r")) * (F.col("s.r") - F.col("s.b"))
        slope = sum((p[j] * F.lit(slopes[j]) for j in at), F.lit(0.0))
        *totals, turned, least = (
            now.select("n_tokens", "p", ahead.alias("y"), against.alias("a"), slope.alias("slope"))
            .agg(
                *(F.sum(F.col("y") * F.col("n_tokens") * p[j]) for j in at),
                F.sum("a"),
                F.min(F.when(F.col("n_tokens") > 0, F.col("slope"))),
            )
            .first()
        )
        proven = proven or _unreachable(shares, slopes, least)
        off = [t / tokens - epochs * s for t, s in zip(totals, shares, strict=True)]
        slopes = [x / s for x, s in zip(off, shares, strict=True)]
        miss, squares = max(map(abs, slopes)), sum(x * y for x, y in zip(off, slopes, strict=True))
        pulls.append((momentum, ridge, 1.0 / (steep + ridge), *slopes))
        if miss < TOLERANCE:
            break
        paced = 0 if turned > 0 else paced + 1  # momentum against the slope starts anew
        since += 1
        if squares < PROGRESS * best:
            best, since = squares, 0
        elif since >= PATIENCE:
            if proven or ridge <= LEAST_RIDGE:
                why = "no rates meet the targets" if proven else "targets not met"
                warnings.warn(f"{why}: a total is off by {miss:.1%} of its target", stacklevel=2)
                break
            ridge, paced, since = ridge / 10, 0, 0
        if len(pulls) == WRITE_EVERY:
            fields = state.withColumn("s", replayed())
            state = written(
                fields.select(*members.columns, F.col("s.r").alias("rate"), F.col("s.b").alias("last")),
                "mix-rates",
            )
            pulls = []
    return state.withColumn("s", replayed()).select(*members.columns, F.col("s.r").alias("rate"))


def _unreachable(shares: list[float], slopes: list[float], least: float) -> bool:
    """Whether no rates bring every total within ``TOLERANCE`` of its target.

    Totals weighted by ``slopes`` are at least ``least``, the smallest weight of a document's
    membership, for each token; within the tolerance of the targets they are at most the right side.
    """
    floor = least * (1 - TOLERANCE if least > 0 else 1 + TOLERANCE)
    return floor > sum(s * x + TOLERANCE * s * abs(x) for s, x in zip(shares, slopes, strict=True))


def expected_shares(
    rates: DataFrame, targets: Mapping[str, float], epochs: float = 1.0
) -> DataFrame:
    """``domain, target, expected``: tokens wanted and expected, as parts of the tokens there.

    ``rates`` is the result of ``fitted_rates`` or ``mixture``. Without tokens ``expected`` is null.
    """
    sums = [F.sum(F.col("rate") * F.col("n_tokens") * F.col("p")[j]) for j in range(len(targets))]
    total = sum(targets.values())
    rows = [
        F.struct(
            F.lit(d).alias("domain"),
            F.lit(epochs * v / total).alias("target"),
            F.try_divide(sums[j], F.sum("n_tokens")).alias("expected"),
        )
        for j, (d, v) in enumerate(targets.items())
    ]
    return rates.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def mixture(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], epochs: float = 1.0
) -> DataFrame:
    """``_key, _version, n_tokens, p, rate, copies`` of each document.

    ``labelled`` has ``doc_id`` and ``domain``; ``copies`` is the rate rounded up or down by a
    seeded hash, so that its expectation is the rate.
    """
    members = written(memberships(docs, labelled, list(targets)), "mix-members")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), KEY, VERSION), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    copies = whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)
    return fitted_rates(members, targets, epochs).withColumn("copies", copies.cast("bigint"))


def mixed_documents(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], epochs: float = 1.0
) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    copies = mixture(docs, labelled, targets, epochs).where("copies > 0").select(KEY, VERSION, "copies")
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        id_key().alias(KEY),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(VERSION),
    )
    repeated = rows.join(copies, [KEY, VERSION]).select(
        "_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    )
    return repeated.select("_row.*")


def mixed_report(rates: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """One row for each document: id, tokens, membership by domain, rate and copies."""
    named = [F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(targets)]
    return rates.select(id_of().alias("doc_id"), "n_tokens", *named, "rate", "copies")
