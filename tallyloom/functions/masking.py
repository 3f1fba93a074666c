"""Masking of personal data, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks in the order in which they apply.
PII_RULES = [
    (r"eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*", "[JWT_MASKED]"),
    (r"(?i)bearer\s+[a-zA-Z0-9._-]+", "Bearer [TOKEN_MASKED]"),
    (r"(?i)(api[_-]?key|apikey|secret|password|token)\s*[:=]\s*['\"]?([^'\"\s]{8,})['\"]?", "$1: [REDACTED]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL_MASKED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_MASKED]"),
    (r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}", "[UUID_MASKED]"),
]
# Home folders in stack traces.
HOME_RULES = [
    (r"/home/[^/]+/", "/home/[USER]/"),
    (r"/Users/[^/]+/", "/Users/[USER]/"),
    (r"C:\\Users\\[^\\]+\\", r"C:\\Users\\[USER]\\"),
]
SHORT = 8
SHOWN = 4


#: What a text must hold for a rule to apply, in the rules' order; most texts skip the dearest rules.
GUARDS = ("eyJ", None, None, "@", None, "-")


def mask_pii(text: Column) -> Column:
    masked = text
    for (pattern, mask), guard in zip(PII_RULES, GUARDS, strict=True):
        masked = _guarded(masked, pattern, mask, guard) if guard else F.regexp_replace(masked, pattern, mask)
    return F.when(F.trim(text) == "", text).otherwise(masked)


def _guarded(text: Column, pattern: str, mask: str, guard: str) -> Column:
    """A replacement where the text holds the guard; as a lambda over one element, so that the text is computed once."""
    replaced = F.transform(F.array(text), lambda t: F.when(t.contains(guard), F.regexp_replace(t, F.lit(pattern), F.lit(mask))).otherwise(t))
    return F.get(replaced, 0)


def mask_stack_trace(text: Column) -> Column:
    masked = mask_pii(text)
    for pattern, mask in HOME_RULES:
        masked = F.regexp_replace(masked, pattern, mask)
    return masked


def mask_exception(error_type: Column, message: Column) -> Column:
    """``Unknown error`` without an error, the type without a message, else the masked message."""
    return F.when(error_type.isNull(), F.lit("Unknown error")).otherwise(F.coalesce(mask_pii(message), error_type))


def mask_id(value: Column, mask: str = "***") -> Column:
    short = value.isNull() | (F.length(value) < SHORT)
    return F.when(short, F.lit(mask)).otherwise(F.concat(F.left(value, F.lit(SHOWN)), F.lit(mask)))


def mask_fingerprint(value: Column, suffix: bool = False) -> Column:
    if not suffix:
        return mask_id(value, "****")
    short = value.isNull() | (F.length(value) < SHORT)
    shown = F.concat(F.left(value, F.lit(SHOWN)), F.lit("****"), F.right(value, F.lit(SHOWN)))
    return F.when(short, F.lit("****")).otherwise(shown)


def mask_cache_key(key: Column) -> Column:
    return F.coalesce(F.regexp_replace(key, r"(expectation:v\d+:)[^:]+", "$1***"), F.lit("null"))


def mask_account(account: Column) -> Column:
    empty = account.isNull() | (account == "")
    return F.when(empty, F.lit("***")).otherwise(F.concat(F.left(account, F.lit(SHORT)), F.lit("...")))


def mask_name(name: Column) -> Column:
    """First character and stars."""
    return F.when(name.isNull() | (name == ""), F.lit("***")).otherwise(F.concat(F.left(name, F.lit(1)), F.lit("***")))


def mask_ip(address: Column) -> Column:
    """The first two groups of an address."""
    return F.when(address.isNull(), F.lit("***")).otherwise(F.regexp_replace(address, r"^(\d+\.\d+)\..*$", "$1.*.*"))
