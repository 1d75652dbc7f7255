"""Policy check of one read-only statement over the table ``data``.

Spark's own parser builds the tree; the check walks it and accepts only known
query nodes, the one relation, and built-in functions that compute. It is a
policy, not a sandbox: run untrusted text on a cluster that holds no secrets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from sievetable.errors import DataError

TABLE_NAME = "data"
MAX_SQL_BYTES = 64 * 1024

# Plan nodes of a query. Anything else - commands, writes, scripts - is refused.
_QUERY_NODES = frozenset(
    {
        "Aggregate",
        "AsOfJoin",
        "Deduplicate",
        "Distinct",
        "Except",
        "Expand",
        "Filter",
        "Generate",
        "GlobalLimit",
        "Intersect",
        "Join",
        "LateralJoin",
        "LocalLimit",
        "LocalRelation",
        "Offset",
        "OneRowRelation",
        "ParameterizedQuery",
        "Pivot",
        "Project",
        "Sample",
        "Sort",
        "SubqueryAlias",
        "Tail",
        "Union",
        "UnionLoop",
        "UnionLoopRef",
        "UnpivotTransformer",
        "Unpivot",
        "UnresolvedHaving",
        "UnresolvedInlineTable",
        "UnresolvedOrderBy",
        "UnresolvedRelation",
        "UnresolvedSubqueryColumnAliases",
        "UnresolvedTVFAliases",
        "UnresolvedTableValuedFunction",
        "UnresolvedWith",
        "Window",
        "WithWindowDefinition",
    }
)

# Built-in functions that run code, or tell about the machine or the session.
_DENIED_FUNCTIONS = frozenset(
    {
        "reflect",
        "java_method",
        "try_reflect",
        "input_file_name",
        "input_file_block_start",
        "input_file_block_length",
        "current_user",
        "session_user",
        "user",
        "version",
        "python_worker_logs",
        "sql_keywords",
        "collations",
    }
)


def _forbidden(message: str, **context: object) -> DataError:
    return DataError("QUERY_FORBIDDEN", message, **context)


def is_allowed_function(spark: SparkSession, name: str) -> bool:
    """A Spark built-in that is not denied; registered functions are not built in."""
    if name.lower() in _DENIED_FUNCTIONS:
        return False
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    identifier = catalyst.FunctionIdentifier(name.lower())
    registries = (catalyst.analysis.FunctionRegistry, catalyst.analysis.TableFunctionRegistry)
    return any(r.builtin().functionExists(identifier) for r in registries)


def _sequence(seq: object) -> Iterator:
    items = seq.iterator()
    while items.hasNext():
        yield items.next()


def _name(node: object) -> str:
    return node.getClass().getSimpleName()


def _nodes(plan: object) -> Iterator[tuple[str, object]]:
    """Every plan and expression node, through subqueries and CTEs."""
    pending = [plan]
    seen = 0
    while pending:
        node = pending.pop()
        yield _name(node), node
        pending.extend(_sequence(node.children()))
        pending.extend(c for c in _sequence(node.innerChildren()) if _is_tree(c))
        if _is_plan(node):
            pending.extend(_sequence(node.expressions()))
        elif _name(node) in _PLAN_EXPRESSIONS:
            pending.append(node.plan())
        seen += 1
        if seen > 100_000:
            raise _forbidden("The statement is too large.")


_PLAN_EXPRESSIONS = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"})


def _is_plan(node: object) -> bool:
    return hasattr(node, "expressions") and _instance(node, "LogicalPlan")


def _is_tree(node: object) -> bool:
    return _instance(node, "TreeNode")


def _instance(node: object, simple: str) -> bool:
    cls = node.getClass()
    while cls is not None:
        if cls.getSimpleName() == simple:
            return True
        cls = cls.getSuperclass()
    return False


def _relation_name(node: object) -> list[str]:
    return [str(p) for p in _sequence(node.multipartIdentifier())]


def check_statement(
    spark: SparkSession, sql: str, *, max_sql_bytes: int = MAX_SQL_BYTES
) -> None:
    """Raise unless ``sql`` is one SELECT, WITH or VALUES over ``data``."""
    if len(sql.encode()) > max_sql_bytes:
        raise DataError(
            "QUERY_SQL_TOO_LARGE", f"SQL exceeds the {max_sql_bytes}-byte limit.", limit=max_sql_bytes
        )
    if not sql.strip():
        raise _forbidden("A SELECT query is required.")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip())
    except Exception as error:  # the parser's own message is the reason
        raise _forbidden(str(error).strip().split("\n", 1)[0]) from error
    nodes = list(_nodes(plan))
    names = set()
    for kind, node in nodes:
        if kind == "UnresolvedWith":
            for pair in _sequence(node.cteRelations()):
                names.add(str(pair.productElement(0)).lower())
    for kind, node in nodes:
        if _is_plan(node):
            if kind not in _QUERY_NODES:
                raise _forbidden("Only SELECT, WITH ... SELECT, or VALUES is allowed.", node=kind)
            if kind == "UnresolvedRelation":
                parts = _relation_name(node)
                known = len(parts) == 1 and parts[0].lower() in names | {TABLE_NAME}
                if not known:
                    raise _forbidden("Only the table 'data' can be read.", relation=".".join(parts))
            if kind == "UnresolvedTableValuedFunction":
                _check_function(spark, [str(p) for p in _sequence(node.name())])
        elif kind == "UnresolvedFunction":
            _check_function(spark, [str(p) for p in _sequence(node.nameParts())])
        elif kind == "UnresolvedGenerator":
            _check_function(spark, [str(node.name().funcName())])


def _check_function(spark: SparkSession, parts: list[str]) -> None:
    if len(parts) != 1 or not is_allowed_function(spark, parts[0]):
        raise _forbidden("The function is not allowed.", function=".".join(parts))
