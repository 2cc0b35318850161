"""Shared links: which merchant they belong to and what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.functions.share import bare_domain, host_suffixes, shared_host
from perkloom.operators import rank
from perkloom.operators.conditions import DEFAULT_POLICY, Policy
from perkloom.operators.ingest import spread_by
from perkloom.operators.skew import hot_splits, skew_join, skew_lookup
from perkloom.session import written


def merchant_of_host(hosts: DataFrame, domains: DataFrame, **bounds) -> DataFrame:
    """(host, merchant_id): the longest matching domain wins, the first on a tie.

    A host is taken apart into the domains it could belong to, so this is an
    equi-join and a look-alike host cannot match. Endings shared by very many hosts
    are split.
    """
    parts = hosts.select("host").distinct().withColumn(
        "_domain", F.explode(host_suffixes(F.col("host")))
    )
    # However many merchants state a domain, only the winner of it is joined.
    owner = F.struct((-F.length("domain")).alias("short"), "seq", "merchant_id")
    owners = domains.groupBy(bare_domain(F.col("domain")).alias("_domain")).agg(
        F.min(owner).alias("_owner")
    )
    met = skew_join(
        parts, owners, ["_domain"], ["host"], ["_domain"],
        hot_splits(parts, None, ["_domain"], **bounds),
    )
    return met.groupBy("host").agg(F.min("_owner").alias("_best")).select(
        "host", F.col("_best.merchant_id").alias("merchant_id")
    )


def resolve_shares(shares: DataFrame, domains: DataFrame, **bounds) -> DataFrame:
    """``shares`` (with ``text``) plus ``host`` and ``merchant_id``, null if unknown.

    Every distinct host is resolved once, however often it is shared.
    """
    with_host = shares.withColumn("host", shared_host(F.col("text")))
    owners = merchant_of_host(with_host.where("host IS NOT NULL"), domains, **bounds)
    return skew_lookup(with_host, owners, ["host"], spread_by(shares, "ctx_id"), **bounds)


def share_outcomes(
    shares: DataFrame,
    domains: DataFrame,
    owned: DataFrame,
    muted: DataFrame,
    benefits: DataFrame,
    policy: Policy = DEFAULT_POLICY,
    **bounds,
) -> DataFrame:
    """Outcome per share: no_merchant, no_benefits or match, with the best benefit
    and the interaction event it logs. A share is always an online purchase.

    ``shares``: ctx_id, user_id, now, text.
    """
    # Every share is needed twice, and finding its merchant is most of the work.
    resolved = written(resolve_shares(shares, domains, **bounds), "resolved")
    contexts = resolved.where("merchant_id IS NOT NULL").select(
        "ctx_id", "user_id", "now", "merchant_id",
        F.lit("online").alias("channel"), F.lit(None).cast("double").alias("cart_amount"),
    )
    usable = rank.candidates(contexts, owned, benefits, policy, muted, **bounds)
    best = F.struct(
        "readiness", (-F.col("saving")).alias("minus"), "age_days", "benefit_seq", "benefit_id"
    )
    found = usable.groupBy("ctx_id").agg(
        F.count(F.lit(1)).alias("n_benefits"), F.min(best).alias("_best")
    )
    outcome: Column = (
        F.when(F.col("merchant_id").isNull(), "no_merchant")
        .when(F.col("n_benefits").isNull(), "no_benefits")
        .otherwise("match")
    )
    return resolved.join(found, "ctx_id", "left").select(
        "ctx_id", "user_id", "host", "merchant_id", outcome.alias("outcome"),
        F.coalesce("n_benefits", F.lit(0).cast("bigint")).alias("n_benefits"),
        F.col("_best.benefit_id").alias("best_id"),
        F.when(F.col("n_benefits") > 0, "share_resolved").otherwise("share_unmatched").alias("kind"),
    )
