"""Allow-lists for user-written SQL.

A statement or filter is judged on Spark's parsed plan, before any name is
resolved, so nothing that it names is opened, listed or called on the way:

* plan steps: only those of a query (projection, filter, join, aggregate, ...);
  commands, scripts, table functions and generators are no such steps;
* relations: only the bound names and the statement's own common table
  expressions, in subqueries too;
* functions: looked up in the function registry of a fresh session; they must be
  built in and belong to an allowed group.  Groups that reach outside the data
  (reflection, files, session, errors) are not among them.

After analysis every leaf of the plan is held against the dataset's own leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class NotAllowed(ValueError):
    """The statement or filter is not one that may run on the dataset."""


# Groups of the function registry whose members only compute on their arguments.
FUNCTION_GROUPS = {"agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs",
                   "datetime_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs",
                   "string_funcs", "struct_funcs", "window_funcs"}

# Steps of a query in a parsed plan.
STEPS = {"Aggregate", "CTERelationDef", "CTERelationRef", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join",
         "LocalLimit", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving",
         "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "Window",
         "WithCTE", "WithWindowDefinition"}

# Session functions that a bare name stands for where no column has it.
BARE = {"current_user", "session_user", "user"}

#: Groups of the registered expression classes, per application (built-in classes never change).
_CLASS_GROUPS: dict[str, dict[str, set]] = {}

_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


def items(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


class Guard:
    """Checks statements in a session of its own: other settings, temporary views and functions play no part."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.session = spark.newSession()
        copied, own = spark._jsparkSession.conf(), self.session._jsparkSession.conf()
        for key in ("spark.sql.ansi.enabled", "spark.sql.caseSensitive", "spark.sql.session.timeZone"):
            own.set(key, copied.get(key))
        own.set("spark.sql.runSQLOnFiles", "false")
        self.state = self.session._jsparkSession.sessionState()
        self._group_of_name: dict[str, str | None] = {}
        self._plan_expression = self._class("PlanExpression")
        self._unresolved = "org.apache.spark.sql.catalyst.analysis."

    def _class(self, name: str):
        return self.spark._jvm.java.lang.Class.forName(_EXPRESSIONS + name)

    # ------------------------------------------------------------ functions

    def group_of(self, name: str) -> str | None:
        """Registry group of a built-in function, None for any other name."""
        if name not in self._group_of_name:
            found = self.state.functionRegistry().lookupFunction(self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
            info = found.get() if found.isDefined() else None
            self._group_of_name[name] = info.getGroup() if info is not None and info.getSource() == "built-in" else None
        return self._group_of_name[name]

    def _class_groups(self) -> dict[str, set]:
        """Groups under which a class is registered: keywords give expressions without a function name."""
        groups = _CLASS_GROUPS.setdefault(self.spark.sparkContext.applicationId, {})
        if not groups:
            registry = self.state.functionRegistry()
            for name in items(registry.listFunction().toSeq()):
                info = registry.lookupFunction(name).get()
                groups.setdefault(info.getClassName(), set()).add(info.getGroup())
        return groups

    def check_expression(self, expression, subqueries: bool = True, columns: list[str] | None = None) -> list:
        """Raise for a function that is not allowed; returns the plans of the expression's subqueries.

        With ``columns`` given, a bare name of a session function must be one of them.
        """
        known = None if columns is None else {c.lower() for c in columns}
        plans, todo = [], [expression]
        while todo:
            e = todo.pop()
            kind = e.getClass().getName()
            if kind == self._unresolved + "UnresolvedFunction":
                name = ".".join(items(e.nameParts())).lower()
                if self.group_of(name) not in FUNCTION_GROUPS:
                    raise NotAllowed(f"function not allowed: {name}")
            elif kind == self._unresolved + "UnresolvedGenerator":
                raise NotAllowed("function not allowed: " + e.name().unquotedString())
            elif known is not None and kind == self._unresolved + "UnresolvedAttribute":
                name = ".".join(items(e.nameParts())).lower()
                if name in BARE - known:
                    raise NotAllowed(f"function not allowed: {name}")
            elif kind.startswith(_EXPRESSIONS):
                groups = self._class_groups().get(kind)
                if groups and not groups & FUNCTION_GROUPS and not self._plain(kind):
                    raise NotAllowed(f"function not allowed: {e.prettyName()}")
            if self._plan_expression.isInstance(e):
                if not subqueries:
                    raise NotAllowed("a subquery is not allowed here")
                plans.append(e.plan())
            todo += items(e.children())
        return plans

    @staticmethod
    def _plain(kind: str) -> bool:
        """Literals and casts, whatever group their function form is in."""
        return kind.rpartition(".")[2] in ("Cast", "Literal")

    # ------------------------------------------------------------ plans

    def check_plan(self, plan, names: tuple[str, ...]) -> None:
        """Raise for a step, relation or function that is not allowed."""
        bound, relations, todo = {n.lower() for n in names}, [], [plan]
        while todo:
            p = todo.pop()
            kind = p.nodeName()
            if kind not in STEPS:
                raise NotAllowed(f"step not allowed: {kind}")
            if kind == "UnresolvedRelation":
                relations.append(".".join(items(p.multipartIdentifier())))
            if kind == "UnresolvedWith":
                for k in range(p.cteRelations().size()):
                    named = p.cteRelations().apply(k)
                    bound.add(named._1().lower())
                    todo.append(named._2())
            for e in items(p.expressions()):
                todo += self.check_expression(e)
            todo += items(p.children())
        for name in relations:
            if name.lower() not in bound:
                raise NotAllowed(f"relation not allowed: {name}")

    def parsed(self, text: str):
        return self.state.sqlParser().parsePlan(text)

    def check_filter(self, condition: str, columns: list[str]) -> None:
        """A filter: allowed functions on the dataset's columns, no subqueries."""
        self.check_expression(self.state.sqlParser().parseExpression(condition), subqueries=False, columns=columns)

    # ------------------------------------------------------------ analysis

    def analysed(self, df: DataFrame, text: str, names: tuple[str, ...]) -> DataFrame:
        """The checked statement over ``df``, analysed in the guard's session, as a frame of the caller's."""
        frames = self.spark._jvm.org.apache.spark.sql.classic.Dataset
        mine = df._jdf.queryExecution().analyzed()
        for name in names:
            frames.ofRows(self.session._jsparkSession, mine).createOrReplaceTempView(name)
        plan = self.session.sql(text)._jdf.queryExecution().analyzed()
        self._check_bare(plan)
        own = [leaf.canonicalized() for leaf in self._leaves(mine)]
        for leaf in self._leaves(plan):
            if leaf.nodeName() not in ("OneRowRelation", "CTERelationRef", "LocalRelation") and not any(
                    leaf.canonicalized().equals(x) for x in own):
                raise NotAllowed(f"relation not allowed: {leaf.nodeName()}")
        return DataFrame(frames.ofRows(self.spark._jsparkSession, plan), self.spark)

    @staticmethod
    def _check_bare(plan) -> None:
        """Raise where a bare name became a session function (the dataset's own plan, a view, is left out)."""
        todo = [plan, *items(plan.subqueriesAll())]
        while todo:
            p = todo.pop()
            if p.nodeName() == "View":
                continue
            below = items(p.expressions())
            while below:
                e = below.pop()
                if e.getClass().getName() == _EXPRESSIONS + "CurrentUser":
                    raise NotAllowed("function not allowed: current_user")
                below += items(e.children())
            todo += items(p.children()) + items(p.innerChildren())

    @staticmethod
    def _leaves(plan) -> list:
        return [leaf for p in [plan, *items(plan.subqueriesAll())] for leaf in items(p.collectLeaves())]
