"""Rule engine: regular expressions with line numbers, secret scan, availability of called names.

Find-all with positions is a Catalyst plan: a text is split at the matches, which are extracted beside, and line numbers are
running sums of the line ends in those pieces. There is no Python in the path. Patterns are given in Python's syntax.
"""

from __future__ import annotations

import re
import re._parser as sre_parser
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh_names

# Methods that the platform has on the server or on the client alone.
SERVER_ONLY = ("ЗаписьЖурналаРегистрации", "УровеньЖурналаРегистрации", "Метаданные", "ПараметрыСеанса", "Константы", "ФоновыеЗадания", "РегламентныеЗадания", "НайтиПоСсылкам", "Заблокировать", "Разблокировать")
CLIENT_ONLY = ("Асинх", "Ждать", "ПоказатьВопрос", "ПоказатьПредупреждение", "ОткрытьФорму", "Закрыть", "Оповестить")
# Shapes of secrets.
SECRETS = {
    "fine-grained token": r"github_pat_[A-Za-z0-9_]{20,}",
    "classic token": r"ghp_[A-Za-z0-9]{36}",
    "access key": r"AKIA[0-9A-Z]{16}",
    "private key": r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "bearer token": r"(?i)Bearer\s+[A-Za-z0-9_\-\.]{20,}",
    "chat token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
}
#: A name that an opening bracket follows.
CALL = r"\b[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*\s*\("


class Rule(NamedTuple):
    rule_id: str
    pattern: str
    severity: str = "warning"
    category: str = "general"
    flags: str = "m"
    message: str = ""


def compile_pattern(pattern: str, flags: str = "m") -> str:
    """Python syntax to Java: our two groups come first, so back-references shift by two; named groups lose the P. The
    end of the text is an empty last match, so that a text's rest is read once and not from each of its places."""
    body = re.sub(r"\(\?P<", "(?<", pattern)
    body = re.sub(r"\\([1-9])(?!\d)", lambda m: f"\\{int(m[1]) + 2}", body)
    on = "".join(f for f in flags if f in "ms") + ("iu" if "i" in flags else "")
    return f"(?Uds)(.*?)((?{on}{'' if 's' in flags else '-s'}:{body})|\\z)"


def test_pattern(pattern: str, flags: str = "m") -> str:
    """The pattern alone, for a test whether it occurs."""
    body = re.sub(r"\(\?P<", "(?<", pattern)
    return f"(?Ud{''.join(f for f in flags if f in 'ms')}{'iu' if 'i' in flags else ''}){body}"


def never_empty(pattern: str) -> bool:
    """Whether every match of a pattern has a character."""
    try:
        return sre_parser.parse(pattern).getwidth()[0] > 0
    except (re.error, OverflowError, RecursionError):
        return False


def _ends(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n")))


def pieces(text: Column, plain: Column, full: Column, solid: Column | bool) -> Column:
    """An array of each match with its line ends and those of the text before it. `plain` is what `test_pattern` gives, `full`
    what `compile_pattern` does; where matches are `never_empty`, the text is split at them, else each is found with the text
    before it, which takes longer."""
    one = lambda x: F.struct(_ends(x["pre"]).alias("p"), _ends(x["hit"]).alias("h"), x["hit"].alias("hit"))
    cut = F.transform(F.filter(F.arrays_zip(F.split(text, plain, -1).alias("pre"), F.regexp_extract_all(text, plain, 0).alias("hit")), lambda x: x["hit"].isNotNull()), one)
    found = F.transform(F.arrays_zip(F.regexp_extract_all(text, full, 1).alias("pre"), F.regexp_extract_all(text, full, 2).alias("hit")), one)
    return (cut if solid else found) if isinstance(solid, bool) else F.when(solid, cut).otherwise(found)


def _pieces(text: Column, pattern: str, flags: str) -> Column:
    return pieces(text, F.lit(test_pattern(pattern, flags)), F.lit(compile_pattern(pattern, flags)), never_empty(pattern))


def row_key(text: Column) -> Column:
    """What tells the texts of one id apart: fixed by the text, so that a task that runs again gives the same."""
    return F.xxhash64(text)


def _located(rows: DataFrame, id_col: str, extra: list[str]) -> DataFrame:
    """Rows (id, row, extra..., pieces) as one row a match, with its line from a running sum over the matches of a text.

    Rows alike in id and text have each match as often as they occur; the sum up to a match is divided by that number.
    """
    found = rows.select(id_col, "row", *extra, F.posexplode("pieces").alias("pos", "m"))
    w = Window.partitionBy(id_col, "row", *extra).orderBy("pos")
    alike = F.count("*").over(w.rangeBetween(0, 0))
    upto = F.sum(F.col("m.p") + F.col("m.h")).over(w.rangeBetween(Window.unboundedPreceding, 0)) / alike - F.col("m.h")
    return found.select(id_col, *extra, (upto + 1).cast("int").alias("line"), "pos", F.col("m.hit").alias("match")).where("match <> ''")


def find_all(df: DataFrame, id_col: str, text_col: str, pattern: str, flags: str = "m") -> DataFrame:
    """(id, line, pos, match): every non-empty match of the pattern, with the 1-based line where it begins. Rows that repeat
    an id are read each for itself; a null text has no match. Only matches are shuffled, no texts."""
    rows = df.select(F.col(id_col), row_key(F.col(text_col)).alias("row"), _pieces(F.col(text_col), pattern, flags).alias("pieces"))
    return _located(rows, id_col, [])


def detect(df: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule], severities: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """(id, rule_id, severity, category, line, match[:100]): findings of the rules that the filters leave; a pattern that
    doesn't compile is skipped. Rules are pruned before the plan is made; one scan of the texts serves all of them."""
    used = []
    for r in rules:
        if (severities and r.severity not in severities) or (categories and r.category not in categories):
            continue
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        used.append(r)
    if not used:
        return df.select(id_col, *[F.lit(None).cast(t).alias(n) for n, t in (("rule_id", "string"), ("severity", "string"), ("category", "string"), ("line", "int"), ("match", "string"))]).limit(0)
    text = F.col(text_col)
    each = [F.struct(F.lit(i).alias("rule"), F.when(text.rlike(test_pattern(r.pattern, r.flags)), _pieces(text, r.pattern, r.flags)).alias("pieces")) for i, r in enumerate(used)]
    rows = df.select(id_col, row_key(text).alias("row"), F.explode(F.array(*each)).alias("x")).select(id_col, "row", "x.rule", "x.pieces").where("pieces is not null")

    def named(field: str) -> Column:
        return F.element_at(F.lit([getattr(r, field) for r in used]), F.col("rule") + 1).alias(field)

    return _located(rows, id_col, ["rule"]).select(id_col, named("rule_id"), named("severity"), named("category"), "line", F.substring("match", 1, 100).alias("match"))


def mask(secret: Column) -> Column:
    """First 8 and last 4 characters; short secrets vanish."""
    return F.when(F.length(secret) > 12, F.concat(F.left(secret, F.lit(8)), F.lit("***"), F.right(secret, F.lit(4)))).otherwise(F.lit("***"))


def secret_scan(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = SECRETS) -> DataFrame:
    """(id, kind, masked): the first pattern that hits a text, masked; clean texts give no row."""
    each = F.array(*[F.struct(F.lit(name).alias("kind"), F.regexp_extract(text_col, p, 0).alias("hit")) for name, p in patterns.items()])
    # A generator keeps the optimizer from naming, and so running, the expressions once more for each use of their result.
    found = df.select(id_col, F.explode(F.slice(F.filter(each, lambda x: x["hit"] != ""), 1, 1)).alias("weft_found"))
    return found.select(id_col, F.col("weft_found.kind").alias("kind"), mask(F.col("weft_found.hit")).alias("masked"))


def availability(calls: DataFrame, name_col: str, methods: DataFrame, server_only: Sequence[str] = SERVER_ONLY, client_only: Sequence[str] = CLIENT_ONLY, context: str = "server") -> DataFrame:
    """`calls` with `available` and `reason`: the method table's flag for the context, else the fixed lists, else yes. Of
    methods that repeat a name one available row is enough. Columns may have any names."""
    name, flag = fresh_names(calls, "weft_name", "weft_flag")
    flags = methods.groupBy(F.col("name").alias(name)).agg(F.max(F.col(context).cast("boolean")).alias(flag))
    listed = F.when(F.col(name_col).isin(list(server_only)), F.lit(context in ("server", "external_connection"))).when(F.col(name_col).isin(list(client_only)), F.lit(context != "server"))
    both = calls.join(flags, F.col(name_col) == F.col(name), "left")
    reason = F.when(F.col(flag).isNotNull(), "table").when(listed.isNotNull(), "list").otherwise("unknown")
    return both.withColumns({"available": F.coalesce(F.col(flag), listed, F.lit(True)), "reason": reason}).drop(name, flag)


def unavailable_calls(code: DataFrame, id_col: str, text_col: str, methods: DataFrame, context: str, keywords: Sequence[str] = ()) -> DataFrame:
    """(id, severity, code, line, message): a critical finding for each name that a text calls and that the context lacks, at
    the name's first call. Keywords before a bracket are no calls."""
    calls = find_all(code, id_col, text_col, CALL, "").select(id_col, "line", F.regexp_extract("match", r"(?U)^\w+", 0).alias("name")).where(~F.col("name").isin(list(keywords)) if keywords else F.lit(True))
    first = calls.groupBy(id_col, "name").agg(F.min("line").alias("line"))
    lacks = availability(first, "name", methods, context=context).where("not available")
    return lacks.select(id_col, F.lit("critical").alias("severity"), F.concat(F.lit("METHOD-CONTEXT-"), "name").alias("code"), "line", F.concat(F.lit("'"), "name", F.lit(f"' is not available in the context '{context}'")).alias("message"))
