"""Mixing to target weights: soft domains from labelled documents, rates by projected gradient."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movecheck.llm.common import fresh, staged

#: Hash buckets of the words the classifier knows; bounds its size.
BUCKETS = 16_384
#: Words of evidence at most: a longer text's evidence is averaged down to this many, so that
#: domains stay soft. All its words count.
EVIDENCE = 5.0
MAX_ROUNDS = 40
TOLERANCE = 1e-4


def _words(text: str) -> Column:
    """Words between blanks, which are also the tokens whose totals are mixed."""
    spaced = F.split(F.lower(F.translate(F.col(text), "\t\n\r\f\x0b", "     ")), " ")
    return F.coalesce(F.filter(spaced, lambda w: w != ""), F.array().cast("array<string>"))


def _bucketed(rows: DataFrame, words: Column, *keys: str) -> DataFrame:
    """One row (keys, bucket) per word."""
    return rows.select(*keys, F.explode(words).alias("word")).select(
        *keys, F.when(F.col("word") == "", -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).alias("bucket")
    )


@dataclass
class Domains:
    """Domain names, the logs of their shares, and rows (bucket, w0, w1, …) of log likelihoods."""

    names: list[str]
    priors: list[float]
    weights: DataFrame | None


def learned(labelled: DataFrame, text: str = "text", domain: str = "domain") -> Domains:
    """Multinomial naive Bayes over hashed words, with add-one smoothing (an action).

    Labelled rows with a null domain are left out. The weights are ``BUCKETS`` rows and one
    row of zeros (bucket -1), however much is labelled; the number of domains is the number
    of distinct labels and must be small.
    """
    rows = staged(labelled.filter(F.col(domain).isNotNull()).select(F.col(domain).alias("domain"), F.col(text).alias("text")))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Domains([], [], None)
    per = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(names)]
    counted = staged(_bucketed(rows, _words("text"), "domain").groupBy("bucket").agg(*per))
    totals = counted.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(names))]).first()
    every = labelled.sparkSession.range(-1, BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    logs = [F.log((F.coalesce(f"n{i}", F.lit(0)) + 1) / (F.lit(float(t)) + BUCKETS)) for i, t in enumerate(totals)]
    weights = every.join(counted, "bucket", "left").select(
        "bucket", *[F.when(F.col("bucket") < 0, 0.0).otherwise(w).alias(f"w{i}") for i, w in enumerate(logs)]
    )
    n = sum(sizes.values())
    return Domains(names, [log(sizes[d] / n) for d in names], staged(weights))


def posteriors(docs: DataFrame, domains: Domains, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, p0, p1, …): tokens and domain posteriors of every id.

    Every text ends with an empty word that weighs nothing, so that texts without words have
    a row, with the priors.
    """
    known = F.broadcast(domains.weights)  # BUCKETS + 1 rows
    ending = F.concat(_words(text), F.array(F.lit("")))
    n = range(len(domains.names))
    # One row per document and task: its words are summed before anything is shuffled.
    summed = (
        _bucketed(docs.select(F.col(id).alias("id"), F.col(text)), ending, "id")
        .join(known, "bucket")
        .groupBy("id")
        .agg(F.count_if(F.col("bucket") >= 0).alias("n_tokens"), *[F.sum(f"w{i}").alias(f"s{i}") for i in n])
    )
    soft = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("n_tokens"), F.lit(1)))
    logged = summed.select("id", "n_tokens", *[(F.lit(domains.priors[i]) + F.col(f"s{i}") * soft).alias(f"l{i}") for i in n])
    top = F.array_max(F.array(*[f"l{i}" for i in n]))
    exps = logged.select("id", "n_tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in n])
    total = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in n])
    return exps.select("id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in n])


def _rate(steps: list[list[float]], n: int) -> Column:
    """The rate after the given steps: each moves it along the posteriors and cuts it at zero."""
    rate = F.lit(1.0)
    for step in steps:
        moved = reduce(lambda a, b: a + b, [F.col(f"p{i}") * F.lit(step[i]) for i in range(n)])
        rate = F.greatest(F.lit(0.0), rate + moved)
    return rate


def rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    text: str = "text",
    id: str = "doc_id",
    domain: str = "domain",
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows (id, domain, n_tokens, posterior, rate, gap), one per id of ``docs``.

    ``labelled`` has texts and their ``domain``; a classifier learned from all of it gives
    every document a posterior over the domains. ``rate`` is how often a document is to be
    seen: the rates are at least zero and their expected domain token totals,
    sum of rate * n_tokens * posterior, match the ``targets`` in proportion; ``gap`` is by how much
    the worst of their shares misses its target, the same in every row (domains without a
    target have weight 0, targets without a labelled row are left out). The sum is that of the
    documents before mixing. ``domain`` is the likeliest one; of equals, the first by name.

    Least squares by projected gradient from rate 1, each total scaled by its domain's mass:
    a round is one aggregation that returns one number per domain, and the next rates follow
    from these numbers and the document's own posterior, so no state is kept anywhere. It
    ends when all totals are within ``tolerance`` of the sum, or after ``max_rounds``; ``gap`` above
    ``tolerance`` says that it ended before.

    Null and empty texts have no tokens and the priors; they move no total. Rows that repeat
    an id, or have none, are one document with all their words. Without labelled rows of a
    wanted domain all rates are 1, and the domain is null if there is none. Other columns are
    ignored; an empty table gives no rows.
    """
    domains = learned(labelled, text, domain)
    n = len(domains.names)
    if not n:
        domains = Domains(["?"], [0.0], docs.sparkSession.range(-1, BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0.0).alias("w0")))
    soft = staged(posteriors(docs, domains, text, id))
    wanted = [max(0.0, float(targets.get(d, 0.0))) for d in domains.names]
    steps, gap = fit_rates(soft, [w / sum(wanted) for w in wanted], max_rounds, tolerance) if sum(wanted) else ([], 0.0)
    names = F.array(*[F.lit(d if n else None).cast("string") for d in domains.names])
    posterior = F.array(*[f"p{i}" for i in range(len(domains.names))])
    likeliest = F.get(names, (F.array_position(posterior, F.array_max(posterior)) - 1).cast("int"))
    return soft.select(
        F.col("id").alias(id),
        likeliest.alias("domain"),
        "n_tokens",
        posterior.alias("posterior"),
        _rate(steps, len(domains.names)).alias("rate"),
        F.lit(gap).alias("gap"),
    )


def fit_rates(
    soft: DataFrame, shares: list[float], max_rounds: int, tolerance: float
) -> tuple[list[list[float]], float]:
    """Steps of the projected gradient for rows (n_tokens, p0, p1, …), for ``_rate``, and the
    largest difference between a share and its target after them."""
    n = len(shares)
    tokens = F.col("n_tokens").cast("double")
    masses = [F.sum(tokens * F.col(f"p{i}")) for i in range(n)]
    squares = [F.sum(tokens * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(n) for j in range(n)]
    first = soft.agg(F.coalesce(F.sum(tokens), F.lit(0.0)), *masses, *squares).first()
    whole, mass, square = first[0], first[1 : n + 1], first[n + 1 :]
    steps: list[list[float]] = []
    if not whole:
        return steps, 0.0
    target = [s * whole for s in shares]
    # Scaled by the masses the curvature's row sums bound its largest eigenvalue.
    scale = [1.0 / max(m, 1e-9 * whole) for m in mass]
    bound = max(sum(abs(square[i * n + j]) * (scale[i] * scale[j]) ** 0.5 for j in range(n)) for i in range(n))
    totals = list(mass)
    def gap() -> float:
        return max(abs(t - a) for t, a in zip(target, totals)) / whole

    for _ in range(max_rounds):
        if gap() <= tolerance:
            break
        steps.append([scale[i] * (target[i] - totals[i]) / bound for i in range(n)])
        rate = _rate(steps, n)
        totals = list(soft.agg(*[F.sum(rate * tokens * F.col(f"p{i}")) for i in range(n)]).first())
    return steps, gap()


#: Steps in a doubling of the factor by which rates may be raised.
RAISE_STEPS = 16


def raise_factor(rated: DataFrame, tolerance: float = TOLERANCE) -> float:
    """The least factor at which raising rates below 1 to 1 moves no share by more than ``tolerance``.

    An action: one aggregation to the tokens and expected tokens per step of the rate, which
    is bounded by the range of a double. A rate counts as the lower end of its step, a sixteenth
    of a doubling wide, so what a factor adds is never underrated. No factor raises a rate of
    zero, so those do not count.
    """
    step = F.floor(F.log2("rate") * RAISE_STEPS).cast("int")
    tokens = F.col("n_tokens").cast("double")
    found = (
        rated.filter("n_tokens > 0 and rate > 0")
        .groupBy(step.alias("step"))
        .agg(F.sum(tokens).alias("tokens"), F.sum(tokens * F.col("rate")).alias("expected"))
        .collect()
    )
    whole = sum(r["expected"] for r in found)
    low = [(2.0 ** (r["step"] / RAISE_STEPS), r["tokens"]) for r in found if r["step"] < 0]

    def enough(factor: float) -> bool:
        added = sum(tokens * max(0.0, 1.0 - factor * rate) for rate, tokens in low)
        return added <= tolerance * (added + factor * whole)

    if enough(1.0):
        return 1.0
    # At the inverse of the smallest rate nothing is added any more; less will mostly do.
    below, above = 0.0, -log(min(rate for rate, _ in low))
    for _ in range(60):
        middle = (below + above) / 2
        below, above = (below, middle) if enough(exp(middle)) else (middle, above)
    return exp(above)


def repeated(docs: DataFrame, rated: DataFrame, id: str = "doc_id", keep_all: bool = True) -> DataFrame:
    """Rows of ``docs`` as often as the ``rate`` of their id says; the columns of ``docs``.

    The fraction of a rate is decided by a hash of the id. With ``keep_all`` the mix is made
    by repeating, not by dropping: all rates are multiplied by ``raise_factor`` and none is
    below 1 then, so no text is lost and the shares are still those that the rates ask for.
    The rows grow by that factor: about fourfold where a domain must shrink to a quarter.
    Texts with a rate of zero, as of a domain without a target, stay once beside that.
    """
    id_, rate_, times_, copy_ = (fresh(docs, name) for name in ("__id", "__rate", "__times", "__copy"))
    rate = F.col(rate_)
    if keep_all:
        rate = F.greatest(F.lit(1.0), rate * F.lit(raise_factor(rated)))
    part = F.pmod(F.xxhash64(F.col(id), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)
    known = rated.select(F.col(id).alias(id_), F.col("rate").alias(rate_))
    joined = docs.join(known, docs[id].eqNullSafe(F.col(id_))).withColumn(times_, times.cast("int"))
    copies = joined.filter(F.col(times_) > 0).withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(times_))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
