"""What SQL text may touch, decided on its parsed and on its analysed plan.

Text reads registered views only, whatever way it spells another source, and calls nothing by
reflection. Both plans are only walked; nothing of the text has run when it is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

from movecheck.functions.names import blocked_names
from movecheck.operators.policy import MARK

#: Functions that call any method of the machine's class path.
REFLECTIVE = ("java_method", "reflect", "try_reflect")
#: Leaves that bring their rows in the text itself or name another part of it.
_HARMLESS = ("CTERelationRef", "LocalRelation", "OneRowRelation", "Range", "UnionLoopRef")


class QueryRefused(ValueError):
    """SQL text that must not run; ``check`` and ``name`` say which rule, ``detail`` why."""

    def __init__(self, check: str, name: str, detail: str) -> None:
        self.check, self.name, self.detail = check, name, detail
        super().__init__(f"{check} {name}: {detail}")


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    items = seq.iterator()
    while items.hasNext():
        yield items.next()


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


class _Walk:
    """All nodes and expressions of a plan, those of subqueries included."""

    def __init__(self, spark: SparkSession) -> None:
        self.gateway = spark.sparkContext._gateway
        self.problems: list[str] = []

    def plan(self, node: JavaObject) -> None:
        if not self.enter(node):
            return
        for expression in _each(node.expressions()):
            self.expression(expression)
        for child in [*_each(node.children()), *_each(node.innerChildren())]:
            self.plan(child)

    def expression(self, node: JavaObject) -> None:
        self.meet(node)
        if is_instance_of(self.gateway, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            self.plan(node.plan())
        for child in _each(node.children()):
            self.expression(child)

    def enter(self, node: JavaObject) -> bool:
        return True

    def meet(self, node: JavaObject) -> None:
        pass


class _Names(_Walk):
    """Reflective calls and qualified tables of a parsed plan, where all still have their names."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark)
        self.qualified: list[str] = []

    def enter(self, node: JavaObject) -> bool:
        if _kind(node) == "UnresolvedRelation":
            parts = [str(part) for part in _each(node.multipartIdentifier())]
            if len(parts) > 1:
                self.qualified.append(".".join(parts))
        return True

    def meet(self, node: JavaObject) -> None:
        if _kind(node) == "UnresolvedFunction":
            name = [str(part) for part in _each(node.nameParts())][-1].lower()
            if name in REFLECTIVE:
                self.problems.append(name)
        elif _kind(node) in ("CallMethodViaReflection", "TryReflect"):
            self.problems.append(str(node.prettyName()))


class _Sources(_Walk):
    """Leaves of an analysed plan that are no registered view, and blocked names it uses."""

    def __init__(self, spark: SparkSession, extras: Sequence[str]) -> None:
        super().__init__(spark)
        self.extras, self.blocked = extras, []

    def enter(self, node: JavaObject) -> bool:
        kind = _kind(node)
        if kind == "View":
            inner = node.child()
            while _kind(inner) == "Project":
                inner = inner.child()
            if _kind(inner) != "SubqueryAlias" or inner.alias() != MARK:
                self.problems.append(f"view {node.desc().identifier().unquotedString()}")
            return False  # what a view reads was decided when it was registered
        if not node.children().size() and kind not in _HARMLESS:
            self.problems.append(str(node.simpleString(1))[:80].split("[")[0].strip())
        return True

    def meet(self, node: JavaObject) -> None:
        name = None
        if _kind(node) == "AttributeReference":
            name = node.name()
        elif _kind(node) in ("GetStructField", "GetArrayStructFields"):
            name = node.childSchema().fieldNames()[node.ordinal()] if _kind(node) == "GetStructField" else node.field().name()
        if name is not None and name not in self.blocked and blocked_names([name], self.extras):
            self.blocked.append(name)


def check_text(spark: SparkSession, parsed: JavaObject) -> None:
    """Refuse what analysis itself could act on.

    That is a reflective call, as constants may be evaluated, and a table under a qualified
    name, such as a path, whose files would be listed. Registered views have plain names.
    """
    walk = _Names(spark)
    walk.plan(parsed)
    if walk.problems:
        raise QueryRefused("G-2", "select-only", "reflective calls: " + ", ".join(dict.fromkeys(walk.problems)))
    if walk.qualified:
        raise QueryRefused("G-5", "redaction", "not a registered view: " + ", ".join(dict.fromkeys(walk.qualified)))


def check_sources(analysed: DataFrame, extras: Sequence[str] = ()) -> None:
    """Refuse an analysed query that reads anything but registered views or uses a blocked name.

    A path, a table of the catalog, a stream, a cached relation and a view that was not made by
    ``policy.register`` are each a leaf of the plan with no registered view above it. Names
    count where a column or a field of a struct is used, under an alias too.
    """
    walk = _Sources(analysed.sparkSession, tuple(extras))
    walk.plan(analysed._jdf.queryExecution().analyzed())
    if walk.problems:
        raise QueryRefused("G-5", "redaction", "not a registered view: " + ", ".join(dict.fromkeys(walk.problems)))
    if walk.blocked:
        raise QueryRefused("G-5", "redaction", "personal columns: " + ", ".join(walk.blocked))
