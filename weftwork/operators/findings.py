"""Findings: fan-in, severity roll-up, gate, routing and escalation predicates, retry text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "warning", "info")


def severity(value: Column) -> Column:
    """Numbers 1-4 and common names as one of three severities; info by default."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "error", "critical", "blocker"), "critical").when(v.isin("2", "warning", "major"), "warning").otherwise("info")


def fan_in(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of findings; `source_ord` keeps the order of the validators."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_ord", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def gate(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the three severities, whether the gate passes (no critical), and failed checks (critical and warning)."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    out = findings.groupBy(*by).agg(*counts) if by else findings.agg(*counts)
    return out.withColumn("passed", F.col("n_critical") == 0).withColumn("n_failed", F.col("n_critical") + F.col("n_warning"))


def count_by_code(findings: DataFrame, code_col: str = "code") -> DataFrame:
    return findings.groupBy(code_col).agg(F.count("*").alias("n"))


def route_after_validate(passed: Column, iterations: Column, most: int = 3) -> Column:
    """Where a task goes after validation."""
    return F.when(passed, "review").when(iterations >= most, "escalate").otherwise("retry")


def route_after_review(approved: Column, iterations: Column, most: int = 3) -> Column:
    return F.when(approved, "commit").when(iterations >= most, "escalate").otherwise("retry")


def route_after_retry(iterations: Column, most: int = 3) -> Column:
    return F.when(iterations >= most, "escalate").otherwise("code")


def route_after_commit(remaining: Column) -> Column:
    return F.when(remaining > 0, "next_subtask").otherwise("done")


def escalation_reason(iterations: Column, criticals: Column, most: int = 3) -> Column:
    """Why a task is escalated: too many iterations, too many criticals, else a tool's error."""
    return F.when(iterations >= most, "max_iterations").when(criticals >= 3, "too_many_criticals").otherwise("tool_error")


def retry_text(findings: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """One text for each key: a line `[severity] code (line): message` for each failed check, in order."""
    failed = findings.where(F.col("severity").isin("critical", "warning"))
    line = F.concat(F.lit("["), "severity", F.lit("] "), "code", F.lit(" ("), F.coalesce(F.col("line").cast("string"), F.lit("-")), F.lit("): "), "message")
    rows = failed.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))).alias("x"))
    return rows.select(by, F.array_join(F.transform("x", lambda r: r["__line"]), "\n").alias("prompt"))


def iteration_log(iterations: DataFrame, keys: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """(keys..., number, code_lines, failed_checks, edit_distance) of the tries of each task: lines of the code, of which an
    empty one has one, and how many checks failed. A try without code has no lines, one without checks none that failed."""
    lines = F.size(F.split("code", "\n", -1))
    return iterations.select(*keys, "number", F.when(F.col("code").isNotNull(), lines).alias("code_lines"), F.greatest(F.size("failed_checks"), F.lit(0)).alias("failed_checks"), F.col("edit_distance_vs_prev").alias("edit_distance"))


def backoff(attempt: Column, base: float, cap: float, kind: str = "exponential") -> Column:
    """Delay before an attempt (1-based): linear or exponential, at most `cap`."""
    delay = F.lit(base) * (attempt if kind == "linear" else F.pow(F.lit(2.0), attempt - 1))
    return F.least(delay, F.lit(float(cap)))


# Kinds of errors and what follows each.
ERROR_ACTIONS = {
    "AgentError": "escalate",
    "PreflightError": "abort",
    "IndexStaleError": "abort",
    "SchemaViolationError": "retry",
    "ToolError": "retry",
    "ToolTimeoutError": "retry",
    "ToolConnectionError": "retry",
    "ToolExecutionError": "escalate",
    "RoleForbiddenError": "abort",
    "LLMError": "retry",
    "LLMUnavailableError": "retry",
    "LLMRateLimitError": "retry",
    "LLMBudgetExceededError": "escalate",
    "ValidationFailedError": "retry",
    "ReviewRejectedError": "retry",
    "MaxIterationsExceededError": "escalate",
    "EscalationRequestedError": "escalate",
    "PersistenceError": "abort",
}
# Reasons of an escalation by the kind of its error; any other kind is a tool's error.
ERROR_REASONS = {
    "MaxIterationsExceededError": "max_iterations_exceeded",
    "SchemaViolationError": "schema_violation_loop",
    "LLMBudgetExceededError": "budget_exceeded",
    "LLMUnavailableError": "llm_unavailable",
}


def error_action(kind: Column) -> Column:
    """retry, escalate or abort for a kind of error; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ERROR_ACTIONS.items() for x in pair]), kind)


def error_reason(kind: Column) -> Column:
    """Why a task with this kind of error is escalated."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ERROR_REASONS.items() for x in pair]), kind), F.lit("tool_error"))
