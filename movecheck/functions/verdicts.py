"""Machine-readable verdict blocks inside documents, read with Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from movecheck.functions.columns import let

# The block's marker, its fence and the two entry shapes. Flags: (?s) a dot
# is any character, (?d) only \n ends a line, (?m) anchors match at lines.
MARKER = "machine-verdicts v1"
FENCE = r"(?s)```(?:ya?ml)?\n(.*?)```"
# The lines after "verdicts:" that are indented, blank or comments. The loop is
# possessive, which the regex engine runs without recursion, however long the section.
SECTION = r"(?dm)^verdicts:[ \t]*(?:#.*)?\n((?:(?:[ \t#].*)?(?:\n|\z))*+)"
_KEY = r"[\"']?([^\s:\"'#{}\[\],][^:\"'{}\[\],\n]*?)[\"']?"
_FLOW = r"\{[ \t]*(?:[^{}\n]*?,[ \t]*)?verdict[ \t]*:[ \t]*[\"']?([^,{}\"'\n]+?)[\"']?[ \t]*(?:,[^{}\n]*)?\}"
_PLAIN = r"[\"']?([^\s{}\[\]\"'#,][^{}\[\]\"'#\n]*?)[\"']?"
_LINE = rf"[ \t]+{_KEY}[ \t]*:[ \t]+(?:{_FLOW}|{_PLAIN})[ \t]*(?:#.*)?"
ENTRY = rf"(?dm)^{_LINE}$"
# An entry spread over lines: a bare key, then deeper lines of which one is the verdict. The
# others are passed over; possessive loops again.
_DEEPER = r"\1[ \t]++(?!verdict[ \t]*:)\S.*"
SPREAD = (
    rf"(?dm)^([ \t]+){_KEY}[ \t]*:[ \t]*(?:#.*)?\n(?:(?:{_DEEPER}|[ \t]*(?:#.*)?)\n)*+"
    rf"\1[ \t]++verdict[ \t]*:[ \t]+{_PLAIN}[ \t]*(?:#.*)?$(?:\n{_DEEPER})*+"
)
# A line that is neither blank, a comment nor an entry.
MALFORMED = rf"(?dm)^(?![ \t]*(?:#.*)?$)(?!{_LINE}$)"

_PAIRS = "array<struct<hypothesis:string,verdict:string>>"


def _last_of_each(entries: Column) -> Column:
    """Keeps the last entry of every id, in the order of the text."""
    ordered = F.array_sort(entries)

    def is_last(all_entries: Column, entry: Column, i: Column) -> Column:
        following = F.get(all_entries, i + 1).getField("hypothesis")
        return F.coalesce(following != entry.hypothesis, F.lit(True))

    last = let(ordered, lambda all_: F.filter(all_, lambda e, i: is_last(all_, e, i)))
    by_place = F.array_sort(
        F.transform(last, lambda e: F.struct(e.position, e.hypothesis, e.verdict))
    )
    return F.transform(by_place, lambda e: F.struct(e.hypothesis, e.verdict))


def _entries(section: Column) -> Column:
    ids, flow, plain = (
        F.regexp_extract_all(section, F.lit(ENTRY), F.lit(group)) for group in (1, 2, 3)
    )
    parsed = F.transform(
        F.arrays_zip(ids.alias("i"), flow.alias("f"), plain.alias("p")),
        lambda e, n: F.struct(
            e["i"].alias("hypothesis"), n.alias("position"), F.concat(e["f"], e["p"]).alias("verdict")
        ),
    )
    return F.when(~section.rlike(MALFORMED), _last_of_each(parsed))


def verdict_entries(text: Column) -> Column:
    """Array of ``(hypothesis, verdict)`` from the first marked block, empty if there is none.

    An entry reads ``H1: {verdict: X}`` or ``H1: X`` under ``verdicts:``, or is ``H1:`` with
    ``verdict: X`` among the deeper lines that follow. One line of any
    other shape makes the block malformed, and a malformed block has no verdicts. A
    repeated id keeps its last verdict. Only bare, ``yaml`` and ``yml`` fences count as
    openings, so the closing fence of a block in another language opens one that ends at
    the next fence; verdict documents keep to the counted kinds.
    """
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    fenced = F.regexp_extract_all(unix, F.lit(FENCE), F.lit(1))
    block = F.get(F.filter(fenced, lambda b: F.contains(b, F.lit(MARKER))), F.lit(0))
    section = F.regexp_replace(
        F.regexp_extract(block, SECTION, 1), F.lit(SPREAD), F.lit("$1$2: {verdict: $3}")
    )
    found = F.when(F.contains(text, F.lit(MARKER)), let(section, _entries))
    return F.coalesce(found, F.array().cast(_PAIRS))
