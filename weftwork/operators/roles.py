"""Which tools each role may call, as a table, with its check against the tools that several roles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tools by role; the coder has none.
ROLES = ("PLANNER", "GATHERER", "CODER", "VALIDATOR", "REVIEWER", "COMMITTER")
TOOLS = (
    ("PLANNER", "metadata.get_dependency_graph"),
    ("PLANNER", "kb.search_kb"),
    ("GATHERER", "metadata.get_metadata"),
    ("GATHERER", "metadata.get_form_structure"),
    ("GATHERER", "metadata.get_api_reference"),
    ("GATHERER", "codebase.semantic_search"),
    ("GATHERER", "codebase.get_module"),
    ("GATHERER", "codebase.call_graph"),
    ("GATHERER", "kb.get_pattern"),
    ("GATHERER", "kb.check_method_availability"),
    ("VALIDATOR", "bsl_ls.lint"),
    ("VALIDATOR", "bsl_ls.format"),
    ("VALIDATOR", "kb.check_antipatterns"),
    ("VALIDATOR", "kb.check_method_availability"),
    ("REVIEWER", "kb.get_antipattern"),
    ("REVIEWER", "kb.check_antipatterns"),
    ("REVIEWER", "codebase.get_similar"),
    ("COMMITTER", "git.create_branch"),
    ("COMMITTER", "git.commit"),
    ("COMMITTER", "git.open_pr"),
    ("COMMITTER", "git.diff"),
)
SHARED = (
    ("GATHERER", "kb.check_method_availability"),
    ("VALIDATOR", "kb.check_method_availability"),
    ("VALIDATOR", "kb.check_antipatterns"),
    ("REVIEWER", "kb.check_antipatterns"),
)


def tool_table(spark: SparkSession, rows: tuple[tuple[str, str], ...] = TOOLS) -> DataFrame:
    """(role, server, tool); the server is what stands before the tool's dot."""
    return spark.createDataFrame(list(rows), "role string, tool string").select("role", F.substring_index("tool", ".", 1).alias("server"), "tool")


def shared_tools(tools: DataFrame) -> DataFrame:
    """(role, tool) of the tools that more than one role has."""
    pairs = tools.select("role", "tool").distinct()
    several = pairs.groupBy("tool").agg(F.count("*").alias("n")).where("n > 1").select("tool")
    return pairs.join(several, "tool", "left_semi").select("role", "tool")


def sharing_problems(tools: DataFrame, stated: DataFrame) -> DataFrame:
    """(role, tool, problem): where the stated shared tools (role, tool) and the table differ, either way."""
    found = shared_tools(tools)
    missing = stated.select("role", "tool").exceptAll(found).select("role", "tool", F.lit("stated, not in the table").alias("problem"))
    return missing.unionByName(found.exceptAll(stated.select("role", "tool")).select("role", "tool", F.lit("in the table, not stated").alias("problem")))


def common_tools(tools: DataFrame, a: str, b: str) -> DataFrame:
    """(tool): what two roles both have."""
    return tools.where(F.col("role") == a).select("tool").intersect(tools.where(F.col("role") == b).select("tool"))


def forbidden_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """The calls (role, tool, ...) of tools that their role doesn't have; a null role or tool has none."""
    return calls.join(F.broadcast(tools.select("role", "tool").distinct()), ["role", "tool"], "left_anti").select(*calls.columns)  # the table is fixed
