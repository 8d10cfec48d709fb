"""Closed vocabularies; where an order is given, the first that applies wins."""

from __future__ import annotations

# The outcome keys that rules may declare, in order of preference, and what statuses mean.
POSITIVE_KEYS = (
    "match", "within_range", "within_precision", "valid", "compliant", "confirmed_compliant", "accredited", "on_time",
    "requested_and_met", "content_ok", "complete", "sealed", "bundled", "not_a_postal_box", "no_extra_charges",
    "receipt_confirmed", "effective_and_not_aborted",
)
NEGATIVE_KEYS = (
    "mismatch", "outside_range", "exceeds_precision", "invalid", "non_compliant", "noncompliant", "expressly_non_compliant",
    "not_accredited", "late", "requested_and_missed", "content_wrong", "incomplete", "not_sealed", "not_bundled", "postal_box",
    "extra_charges_proposed", "no_receipt_evidence", "not_effective_or_aborted",
)
NEUTRAL_KEYS = ("not_applicable", "not_requested", "unstated", "na")
SEVERITY = {"pass": 0, "dormant": 1, "needs_review": 2, "disqualified": 3}
#: What a comparison's result means: it never disqualifies.
INJECTED = {"match": "pass", "mismatch": "needs_review", "unstated": "needs_review"}
# What the rest of a key says about a field, month names, printed date forms, currency names and signs.
META_SUFFIXES = ("redacted", "confidence", "page", "quote", "verification", "printed", "corrected", "decision", "located")
MONTHS = {
    "january": "jan", "february": "feb", "march": "mar", "april": "apr", "june": "jun", "july": "jul", "august": "aug",
    "september": "sep", "sept": "sep", "october": "oct", "november": "nov", "december": "dec",
}
DATE_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "d/M/yyyy", "d.M.yyyy", "MMMM d, yyyy", "d MMMM, yyyy", "d-M-yyyy")
LABELS = {
    "HKD": "HK$", "USD": "US$", "CAD": "C$", "AUD": "A$", "NZD": "NZ$", "SGD": "S$", "TWD": "NT$", "CNY": "RMB", "EUR": "€",
    "GBP": "£", "JPY": "JPY", "CHF": "CHF", "MOP": "MOP$",
}
DOLLAR_PREFIXES = {
    "hk": "HKD", "us": "USD", "c": "CAD", "ca": "CAD", "can": "CAD", "a": "AUD", "au": "AUD", "nz": "NZD", "s": "SGD",
    "nt": "TWD", "mop": "MOP",
}
CURRENCY_WORDS = {
    "hkd": "HKD", "hong kong dollar": "HKD", "usd": "USD", "us dollar": "USD", "united states dollar": "USD", "cad": "CAD",
    "canadian dollar": "CAD", "aud": "AUD", "australian dollar": "AUD", "nzd": "NZD", "new zealand dollar": "NZD", "sgd": "SGD",
    "singapore dollar": "SGD", "twd": "TWD", "new taiwan dollar": "TWD", "cny": "CNY", "rmb": "CNY", "renminbi": "CNY",
    "yuan": "CNY", "eur": "EUR", "euro": "EUR", "gbp": "GBP", "pound sterling": "GBP", "jpy": "JPY", "yen": "JPY", "chf": "CHF",
    "swiss franc": "CHF", "mop": "MOP", "pataca": "MOP",
}
SIGNS = {"€": "EUR", "£": "GBP"}
SHARED_SIGNS = {
    "$": ("AUD", "CAD", "HKD", "MOP", "NZD", "SGD", "TWD", "USD"),
    "dollar": ("AUD", "CAD", "HKD", "NZD", "SGD", "TWD", "USD"),
    "¥": ("CNY", "JPY"),
}
