"""Hosts out of shared text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions.hosts import browser_host, let
from perkloom.functions.text import trim_all


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def shared_host(text: Column) -> Column:
    """Host of the first link in the text, or of the whole text read as one, as a browser reads it.

    Links may hold any signs a browser puts up with; signs that a browser counts to the host,
    such as a full stop after it, stay."""

    def candidate(said: Column) -> Column:
        first = F.regexp_extract(said, V.FIRST_LINK, 1)
        return F.when(first != "", first).otherwise(trim_all(said))

    with_scheme = let(text, lambda said: let(
        candidate(said), lambda link: F.when(link.contains("://"), link).otherwise(F.concat(F.lit("https://"), link))
    ))
    return F.nullif(bare_domain(browser_host(with_scheme)), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """Every domain the host belongs to: itself and each parent, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
