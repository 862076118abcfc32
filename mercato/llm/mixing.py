"""Mixing to target weights (native): a classifier gives every document soft domain membership, least squares its rate.

Domains come from a labelled table.  A naive Bayes model over the presence of the
most informative words predicts each document's domain posteriors.  Projected gradient
then finds rates between 0 and ``max_rate`` whose expected tokens by domain match
the targets; each step is one aggregate over a narrow table, and only one number
per domain comes back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialize, ready, words


@dataclass(frozen=True)
class Mix:
    """``weights``: target share of expected tokens by domain.

    ``anchor``: if named, the total is such that this domain keeps its tokens;
    otherwise the total is that of the corpus.  ``max_rate``: largest rate (None:
    unbounded).  ``max_labelled``: bound on labelled documents the classifier
    learns from; ``vocabulary``: its words, each found in ``min_docs`` of them or more
    and in a share of ``max_share`` at most.  ``tolerance``: share of the total by
    which a domain may miss its target when the steps end; ``max_steps`` bounds them.
    """

    weights: dict[str, float]
    anchor: str | None = None
    max_rate: float | None = None
    max_labelled: int = 20_000
    vocabulary: int = 64
    min_docs: int = 5
    max_share: float = 0.1
    tolerance: float = 1e-3
    max_steps: int = 40


def _total(columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def learn(docs: DataFrame, labelled: DataFrame, mix: Mix) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Log score by domain of a text without any marker word, and what each marker word adds where it is present.

    ``labelled`` (doc_id, domain) is cut to about ``max_labelled`` rows by hash of doc_id.
    """
    domains = sorted(mix.weights)
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    share = min(1.0, mix.max_labelled / n) if n else 1.0
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    # about max_labelled rows of two columns: bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", F.array_distinct(words(F.col("text"))).alias("w"))
    rows = materialize(rows)
    count = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    found = [d for d in domains if count.get(d)]
    if not found:
        return {}, {}
    total = sum(count.values())
    per_word = rows.select("domain", F.explode("w").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), *[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n_{i}") for i, d in enumerate(found)])

    def share_of(i: int, d: str) -> Column:
        return (F.col(f"n_{i}") + 0.5) / (count[d] + 1.0)

    # markers: words rare in the corpus whose presence says most about the domain.  Common words would mostly tell
    # languages and lengths apart.
    p = (F.col("n") + 0.5) / (total + 1.0)
    gain = _total([F.lit(count[d] / total) * share_of(i, d) * F.log(share_of(i, d) / p) for i, d in enumerate(found)])
    marks = per_word.where((F.col("n") >= mix.min_docs) & (F.col("n") <= mix.max_share * total))
    best = marks.withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(mix.vocabulary).collect()
    weights, blank = {}, {d: math.log(count[d] / total) for d in found}
    for r in best:
        q = {d: (r[f"n_{i}"] + 0.5) / (count[d] + 1.0) for i, d in enumerate(found)}
        weights[r["word"]] = {d: math.log(q[d] / (1 - q[d])) for d in found}
        for d in found:
            blank[d] += math.log(1 - q[d])
    return blank, weights


def posteriors(docs: DataFrame, model, mix: Mix) -> DataFrame:
    """``uid, doc_id, tokens, p`` per input row; ``p`` is an array over the sorted domains, adding up to 1."""
    blank, weights = model
    domains = sorted(mix.weights)
    ws = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.struct(
        F.size(w).cast("double").alias("tokens"), F.array_intersect(w, _strings(sorted(weights))).alias("present"))), F.lit(0))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", ws.alias("m")))
    rows = rows.select("uid", "doc_id", "m.tokens", "m.present")
    if not blank:  # nothing learned: every domain is as likely
        even = F.array(*[F.lit(1.0 / len(domains)) for _ in domains])
        return rows.select("uid", "doc_id", "tokens", even.alias("p"))
    spark = docs.sparkSession
    table = spark.createDataFrame([(w, *[v.get(d, 0.0) for d in domains]) for w, v in sorted(weights.items())] or [("", *[0.0] * len(domains))],
                                  "word string, " + ", ".join(f"s{i} double" for i in range(len(domains))))
    hits = rows.select("uid", "doc_id", "tokens", F.explode_outer("present").alias("word"))
    sums = hits.join(F.broadcast(table), "word", "left").groupBy("uid").agg(  # at most vocabulary rows
        F.first("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"),
        *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(domains))])
    logs = [F.col(f"s{i}") + blank[d] if d in blank else F.lit(-math.inf) for i, d in enumerate(domains)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = sums.select("uid", "doc_id", "tokens", F.array(*[F.exp(x - top) for x in logs]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return parts.select("uid", "doc_id", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def rates(scored: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``rate`` to ``posteriors``: projected gradient from rate 1.

    Minimises the squared miss of each domain's expected tokens relative to the
    domain's size.  With steps measured in tokens the largest curvature is 1, so
    the step size is 1 whatever the corpus.
    """
    domains = sorted(mix.weights)
    n = len(domains)
    scored = materialize(scored.withColumn("rate", F.lit(1.0)))

    def expected(df: DataFrame) -> list[float]:
        row = df.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.get("p", F.lit(i))).alias(f"e{i}") for i in range(n)]).first()
        return [row[f"e{i}"] or 0.0 for i in range(n)]

    mass = expected(scored)
    share = [mix.weights[d] / sum(mix.weights.values()) for d in domains]
    total = sum(mass)
    if mix.anchor is not None and share[domains.index(mix.anchor)] > 0:
        total = mass[domains.index(mix.anchor)] / share[domains.index(mix.anchor)]
    target = [total * s for s in share]
    now = mass
    for step in range(1, mix.max_steps + 1):
        miss = [e - t if m > 0 else 0.0 for e, t, m in zip(now, target, mass)]
        if max(map(abs, miss), default=0.0) <= mix.tolerance * total:
            break
        move = _total([F.get("p", F.lit(i)) * (miss[i] / mass[i]) for i in range(n) if mass[i] > 0])
        rate = F.greatest(F.col("rate") - move, F.lit(0.0))
        rate = rate if mix.max_rate is None else F.least(rate, F.lit(float(mix.max_rate)))
        scored = scored.withColumn("rate", rate)
        if step % 8 == 0:  # keeps the expression short; a lost executor repeats a few steps at most
            scored = materialize(scored)
        before, now = now, expected(scored)
        if max(abs(a - b) for a, b in zip(before, now)) <= 0.1 * mix.tolerance * total:
            break  # the bounds on rates hold the rest back
    return scored


def mix_rates(docs: DataFrame, labelled: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, tokens, p, rate`` per input row (``uid`` sets repeated rows apart).

    Tokens are words.  Null or empty text has no tokens, is classified as a
    text without marker words and gets a rate like any other.  Labels with a null doc_id or
    an unlisted domain are ignored; of several for one doc_id the first in order
    counts.  A domain without labelled documents has posterior 0; without any
    label all domains are equally likely.  Extra columns are ignored; an empty
    table gives no row.
    """
    ready(docs.sparkSession)
    return rates(posteriors(docs, learn(docs, labelled, mix), mix), mix)


def sampled(docs: DataFrame, labelled: DataFrame, mix: Mix, keep_from: float = 0.9) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more with the fractional part as probability.

    The draw is a hash of doc_id (of the text without one), so it repeats.  Rows
    with a rate of ``keep_from`` or more appear at least once.  Rows are matched by
    doc_id and text.  Rows labelled with a domain of weight 0 go, whatever their rate.
    """
    spark = ready(docs.sparkSession)
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text")
    scored = rates(posteriors(own, learn(docs, labelled, mix), mix), mix)
    found = scored.groupBy("doc_id").agg(F.max("rate").alias("rate")).select("doc_id.*", "rate")
    none = [d for d, w in mix.weights.items() if w == 0]
    unwanted = labelled.where(F.col("domain").isin(*none)) if none else spark.createDataFrame([], labelled.schema)
    found = found.join(unwanted.select("doc_id").distinct().withColumn("unwanted", F.lit(True)), "doc_id", "left")
    seed = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(11))).otherwise(F.xxhash64("text_key", F.lit(11)))
    draw = F.pmod(seed, F.lit(1 << 30)) / float(1 << 30)
    copies = F.greatest(F.floor(F.col("rate") + draw), F.when(F.col("rate") >= keep_from, 1).otherwise(0)).cast("int")
    copies = F.when(F.col("unwanted"), 0).otherwise(copies)
    counted = found.select(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), copies.alias("copies"))
    same = F.col("d.doc_id").eqNullSafe(F.col("mix_id")) & (F.xxhash64("d.text") == F.col("mix_key"))
    rows = docs.select(F.struct("*").alias("d")).join(counted, same, "left")  # no name can clash
    kept = rows.withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    return kept.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


def domains_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labels table: ``toxic``, else ``high`` or ``low`` by quality; rows without either label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")
