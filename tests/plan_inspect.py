"""Plan checks used by the tests: what a good physical plan must (not) contain."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """Formatted physical plan text (no execution)."""
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


PYTHON_OPERATORS = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def unpartitioned_windows(df: DataFrame) -> int:
    """Number of ``Window`` operators fed by a single-partition exchange (possibly through
    a sort): a window with no partition key, which puts every row in one task."""
    lines = physical_plan(df).splitlines()
    count = 0
    for i, line in enumerate(lines):
        if not line.lstrip(" +-:").startswith("Window"):
            continue
        for child in lines[i + 1 : i + 3]:  # the child, or the sort under it
            node = child.lstrip(" +-:")
            if node.startswith("Exchange"):
                count += "SinglePartition" in node
                break
            if not node.startswith("Sort"):
                break
    return count


def plan_problems(df: DataFrame) -> list[str]:
    """Things that would not scale: Python evaluation, cartesian products, or a
    ``Window`` with no partition key (all rows in one task)."""
    plan = formatted_plan(df)
    problems = [op for op in PYTHON_OPERATORS if op in plan]
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        problems.append("nested-loop or cartesian join")
    if unpartitioned_windows(df):
        problems.append("unpartitioned window")
    return problems


_TREE_NODE = re.compile(r"^(?P<lead>[ :|+\-]*)(?P<name>[A-Za-z][\w ]*?) \((?P<id>\d+)\)$")


def single_partition_parents(df: DataFrame) -> list[str]:
    """Operator names directly above every ``Exchange SinglePartition`` of the plan,
    its subqueries included. A partial-then-final aggregate (one row per task crosses)
    is fine; anything else moves whole data to one task."""
    text = formatted_plan(df)
    single = set()
    for block in text.split("\n\n"):
        head = block.split("\n", 1)[0]
        m = re.match(r"^\((\d+)\) Exchange", head)
        if m and "Arguments: SinglePartition" in block:
            single.add(m.group(1))
    parents = []
    stack: list[tuple[int, str]] = []  # (indent, name) of the current tree path
    for line in text.splitlines():
        m = _TREE_NODE.match(line)
        if not m:
            if not line.strip():
                stack = []
            continue
        indent = len(m.group("lead"))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if m.group("name") == "Exchange" and m.group("id") in single:
            parents.append(stack[-1][1] if stack else "")
        stack.append((indent, m.group("name")))
    return parents
