"""The contract every line of a trace dataset must keep."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movecheck.functions.columns import ident, let
from movecheck.functions.names import is_blocked

# The keys every record has.
REQUIRED_KEYS = (
    "id", "case", "created", "schema_summary", "intake", "hypothesis_slate",
    "hypotheses", "ground_truth", "scores",
)
MAX_NAME_LENGTH = 64  # Fixed value: longer strings are prose, not column names.


def missing_keys(line: Column) -> Column:
    """Required keys a JSON record lacks; null for a line that is not a JSON object."""
    required = F.array(*[F.lit(k) for k in REQUIRED_KEYS])
    return F.array_except(required, F.json_object_keys(line))


# One JSON string after the other: a short one without spaces is captured, any other is
# passed over. Twelve characters may stand for one: a character outside the basic plane is
# written as two coded ones. How long a name really is, is decided once it is decoded.
_SHORT_STRING = rf'"(?:([^" ]{{1,{12 * MAX_NAME_LENGTH}}})"|[^"]*")'


def json_names(line: Column) -> Column:
    """Every name-shaped key and string value of a JSON text at any depth, unescaped.

    Two-character escapes all stand for characters a name is cut at, so one such
    character replaces each of them first. What is left between quotes then needs no
    nested pattern, which on long prose would exhaust the regex engine's stack.
    """

    def names(flat: Column) -> Column:
        found = F.filter(F.regexp_extract_all(flat, F.lit(_SHORT_STRING), F.lit(1)), lambda s: s != "")
        listed = F.concat(F.lit('["'), F.array_join(found, '","'), F.lit('"]'))
        decoded = F.from_json(listed, "array<string>")
        return F.when(F.contains(flat, F.lit("\\u")), decoded).otherwise(found)

    return F.filter(
        let(F.regexp_replace(line, r"\\[^u]", "\u241b"), names),
        lambda s: (F.length(s) <= MAX_NAME_LENGTH) & ~F.contains(s, F.lit(" ")),
    )


def blocked_tokens(line: Column, extras: Iterable[str] = ()) -> Column:
    """Name-shaped keys and values of a JSON line that the personal-data policy blocks."""
    extras = tuple(extras)
    return F.filter(json_names(line), lambda s: is_blocked(s, extras))


def trace_contract(
    lines: DataFrame, *, line: str = "value", extras: Iterable[str] = ()
) -> DataFrame:
    """Adds ``parses``, ``missing``, ``blocked`` and ``valid`` to every line (no shuffle)."""
    keys = missing_keys(ident(line))
    return (
        lines.withColumn("missing", keys)
        .withColumn("parses", F.col("missing").isNotNull())
        .withColumn(
            "blocked",
            F.when(F.col("parses"), F.array_distinct(blocked_tokens(ident(line), extras))),
        )
        .withColumn(
            "valid",
            F.coalesce((F.size("missing") == 0) & (F.size("blocked") == 0), F.lit(False)),
        )
    )
