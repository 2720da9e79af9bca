"""What a column's name says about it: personal data, a date, a denominator.

A name is lower-cased and cut into tokens at every run of characters other than
``a-z0-9``. The policy is a set of *keys*: a token (``email``), an adjacent token
pair (``first+name``), or a name that consists of one token only (``=name``). A name
is blocked when any of its own keys is in that set. For a given policy that is one
regular expression; for a policy held in a table it is an equi-join on the keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from movecheck.functions.columns import let

# The built-in personal-data names.
SINGLE_TOKENS = (
    "email",
    "phone", "mobile", "msisdn",
    "surname",
    "address", "street", "zip", "zipcode", "postal",
    "ip",
    "useragent", "ua",
    "ssn",
    "dob", "birth", "birthdate", "birthday",
    "lat", "latitude", "lng", "lon", "long", "longitude",
)
TOKEN_PAIRS = (
    "e+mail",
    "user+agent",
    "social+security", "national+id", "tax+id",
    "first+name", "last+name", "full+name", "middle+name",
    "display+name", "contact+name", "maiden+name",
)
WHOLE_NAMES = ("=name",)

# Names that announce a date column.
DATE_NAMES = ("d", "dt", "date", "day", "ds")
DATE_SUFFIXES = ("_date", "_dt", "_day", "_at", "_ts")
# Fixed value: names that announce a denominator.
DENOMINATOR_NAME = r"n|n_.*|.*_n"

_BREAK = r"[^a-z0-9]+"


def pattern_key(pattern: str) -> str:
    """The policy key of one extra pattern, ``token`` or ``token+token``.

    A pattern that could never match (three tokens, or a token with characters names
    are cut at) is refused rather than ignored: a typo here would leave data exposed.
    """
    parts = [part.strip().lower() for part in pattern.split("+") if part.strip()]
    if not 1 <= len(parts) <= 2 or any(re.search(_BREAK, part) for part in parts):
        raise ValueError(f"pattern {pattern!r} must be one token or two joined by '+'")
    return "+".join(parts)


def policy_keys(extras: Iterable[str] = ()) -> list[str]:
    """All keys of the built-in policy plus ``extras``; extras only ever add."""
    return [*SINGLE_TOKENS, *TOKEN_PAIRS, *WHOLE_NAMES, *map(pattern_key, extras)]


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), _BREAK), lambda t: t != "")


def name_keys(name: Column) -> Column:
    """Every key ``name`` answers to."""

    def keys(toks: Column) -> Column:
        rest = F.greatest(F.size(toks) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(toks, 1, rest), F.slice(toks, 2, rest), lambda a, b: F.concat(a, F.lit("+"), b)
        )
        whole = F.when(F.size(toks) == 1, F.transform(toks, lambda t: F.concat(F.lit("="), t)))
        return F.concat(toks, pairs, F.coalesce(whole, F.array().cast("array<string>")))

    return let(tokens(name), keys)


def policy_pattern(extras: Iterable[str] = ()) -> str:
    """The policy as one regular expression over a lower-case name.

    A token is a run of ``a-z0-9`` with something else, or an end, on both sides; a pair
    is two tokens with only other characters between them.
    """
    parts = (key for key in policy_keys(extras) if key not in WHOLE_NAMES)
    words = "|".join("[^a-z0-9]+".join(map(re.escape, key.split("+"))) for key in parts)
    whole = "|".join(key.removeprefix("=") for key in WHOLE_NAMES)
    return rf"(?:^|[^a-z0-9])(?:{words})(?![a-z0-9])|^[^a-z0-9]*(?:{whole})[^a-z0-9]*\z"


def is_blocked(name: Column, extras: Iterable[str] = ()) -> Column:
    """True when a column of this name may never be used. Null and empty names pass."""
    return F.coalesce(F.lower(name).rlike(policy_pattern(extras)), F.lit(False))


def blocked_names(names: Sequence[str], extras: Iterable[str] = ()) -> list[str]:
    """The blocked ones among a schema's names, in order (plan-time metadata only)."""
    pattern = re.compile(policy_pattern(extras).replace(r"\z", r"\Z"))
    return [name for name in names if pattern.search(name.lower())]


def is_date_name(name: str) -> bool:
    lowered = name.lower()
    return lowered in DATE_NAMES or lowered.endswith(DATE_SUFFIXES)


def is_denominator_name(name: str) -> bool:
    """``n``, ``n_*`` and ``*_n`` announce the size behind an aggregate."""
    return re.fullmatch(DENOMINATOR_NAME, name, re.DOTALL | re.IGNORECASE) is not None


def view_name(stem: str) -> str:
    """The view name of a file stem: its letters and digits in lower case, joined by ``_``."""
    name = "_".join(re.findall(r"[a-z0-9]+", stem.lower()))
    return name if re.match(r"[a-z]", name) else "t_" + name
