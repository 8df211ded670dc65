"""Row-level functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import config


def account_key(bank: Column, account: Column) -> Column:
    """``bank:account``; the bank without leading zeros, all zeros ``0``, blank ``?``."""
    b = F.regexp_replace(F.trim(bank), "^0+", "")
    return F.concat(F.when(F.coalesce(F.trim(bank), F.lit("")) == "", "?").when(b == "", "0").otherwise(b), F.lit(":"), F.trim(account))


def bank_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def amount_key(amount: Column) -> Column:
    """A decimal's plain text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(amount, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def country(bank_name: Column) -> Column:
    c = F.regexp_extract(bank_name, r"^(.*?)\s+Bank\s+#", 1)
    c = F.when(c == "Crytpo", "Crypto").otherwise(c)
    return F.when(c.isin(*config.COUNTRIES), c).otherwise(F.lit("USA"))


def entity_type(name: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "#[^#]*$", ""))
    return F.when(t == "", "Unknown").otherwise(t)


def rounded(x: Column | str, digits: int) -> Column:
    """``x`` as a double with so many decimals, rounded as a number scaled by a power of ten and back; ``round`` goes by its shortest text, which differs where that ends in a 5."""
    scale = 10.0**digits
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale


def tick_end(t: Column, tick: int = config.TICK) -> Column:
    return ((F.floor(t / tick) + 1) * tick).cast("long")


def is_round(x: Column) -> Column:
    return (x >= 100) & (F.pmod(x, F.lit(100.0)) == 0)


def norm(x: Column, cap: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / cap))


def canonical_key(nodes: Column) -> Column:
    return F.array_join(F.array_sort(nodes).cast("array<string>"), ",")


def pair_key(src: Column, dst: Column) -> Column:
    return F.shiftleft(src, 32).bitwiseOR(dst)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def role(n_in: Column, n_out: Column) -> Column:
    return F.when((n_in > 0) & (n_out > 0), "PASS_THROUGH").when(n_out > 0, "SOURCE").when(n_in > 0, "SINK").otherwise("ISOLATED")


#: Days a purpose keeps a case.
RETENTION = {"regulatory_reporting": 5 * 365, "fraud_investigation": 2 * 365, "model_training": 3 * 365}


def retention_until(opened: Column, purpose: Column) -> Column:
    days = F.lit(None).cast("int")
    for k, v in RETENTION.items():
        days = F.when(purpose == k, v).otherwise(days)
    return F.date_add(opened, days)


#: Who may read what is kept for a purpose.
SCOPES = {"regulatory_reporting": ("compliance", "fiu_ind_liaison"), "fraud_investigation": ("fraud_ops", "compliance"), "model_training": ("ml_engineering",)}


def is_expired(opened: Column, purpose: Column, today: Column) -> Column:
    """Whether the time to keep is over; null for an unknown purpose."""
    return today >= retention_until(opened, purpose)


def can_access(purpose: Column, role: Column) -> Column:
    allowed = F.lit(False)
    for k, roles in SCOPES.items():
        allowed = F.when(purpose == k, role.isin(*roles)).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


#: The coded reasons of each verdict.
REASONS = {
    "confirmed_ring": ("layering", "mule_network", "structuring", "circular_flow", "bust_out"),
    "confirmed_partial": ("subset_confirmed", "boundary_unclear"),
    "not_a_ring": ("coincidental_structure", "single_actor", "insufficient_linkage"),
    "benign_explained": ("shared_corporate_owner", "payroll_hub", "marketplace_settlement", "family_accounts", "known_customer"),
    "insufficient_evidence": ("needs_kyc", "needs_more_time", "escalated"),
}


def reason_fits(verdict: Column, reason: Column) -> Column:
    """Whether ``reason`` is one of the coded reasons of ``verdict``."""
    fits = F.lit(False)
    for k, reasons in REASONS.items():
        fits = F.when(verdict == k, reason.isin(*reasons)).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([A-Z]+-[0-9]+)\]"), F.lit(1))


def crosses(a: Column, b: Column) -> Column:
    """Whether two banks, or two currencies, differ; unknown where one is."""
    return a != b
