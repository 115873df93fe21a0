"""Many rules at once: a table of expressions, of which each text runs only those whose necessary literals it has.

Every match of an expression contains one of a few literals, which are read off the expression. All literals of a table make one
trie-shaped look-ahead that finds, in one pass over a text, which of them it has; a broadcast join brings the rules of those, and
only these candidates run their expressions. Expressions without such a literal are candidates everywhere. An expression that is
a whole word meets the words of the texts by a join instead. Findings equal those of running each rule alone.
"""

from __future__ import annotations

import json
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import _located, compile_pattern, never_empty, pieces, row_key, test_pattern

#: Shortest literal that is worth a look, the longest part of one that is looked for, and the literals of one expression's trie.
LEAST, LONGEST, LITERALS = 2, 24, 4096
#: Characters that fold to one character by upper and lower case alike; others end a literal.
PLAIN = re.compile("[\\x20-\\x7EЀ-џ]+")
#: Characters of words for either boundary test, which a `PLAIN` literal can have.
WORD = re.compile("[A-Za-z0-9_Ѐ-џ]+")


class TableRule(NamedTuple):
    rule_id: str
    collection: str
    severity: str
    category: str
    title: str
    source_type: str
    source_code: str
    source_url: str
    pattern: str
    flags: str


#: Lower-case letters whose capital is also that of another letter, which they are taken for. (Catalyst makes lower(upper(x))
#: to lower(x), so that they have to be named.) A dot is what lower case leaves beside an i.
ALIKE = ("ςſıᲀᲁᲂᲃᲄᲅᲆᲇ\u0307", "σsiвдосттъѣ")


def fold(text: Column) -> Column:
    """Text in one case, so that texts which an expression takes as equal without regard to case are equal."""
    return F.translate(F.lower(text), *ALIKE)


def _runs(said: Iterable[str]) -> list[str]:
    return [m.upper().lower() for m in PLAIN.findall("".join(said)) if len(m) >= LEAST]


def _needed(tree, best) -> frozenset[str] | None:
    """Literals of which every match of a parsed expression has one; None if nothing is known."""
    found: list[frozenset[str]] = []
    run: list[str] = []

    def end() -> None:
        found.extend(frozenset([r[:LONGEST]]) for r in _runs(run))
        run.clear()

    for op, value in tree:
        if op is sre.LITERAL:
            run.append(chr(value))
            continue
        if op is sre.SUBPATTERN and all(o is sre.LITERAL for o, _ in value[3]):
            run.extend(chr(v) for _, v in value[3])
            continue
        if op is sre.AT:
            continue  # takes no character
        end()
        if op is sre.SUBPATTERN:
            found.append(_needed(value[3], best) or frozenset())
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_needed(value[2], best) or frozenset())
        elif op is sre.ATOMIC_GROUP:
            found.append(_needed(value, best) or frozenset())
        elif op is sre.BRANCH:
            each = [_needed(branch, best) for branch in value[1]]
            if all(each):
                found.append(frozenset().union(*each))
    end()
    return best([f for f in found if f])


def necessary(pattern: str, flags: str = "m") -> frozenset[str]:
    """Folded literals of which every match has one at least; empty if none is known, so that the rule always runs.

    Of several choices the one whose shortest literal is longest, then the one with the fewest. An expression in verbose
    mode or one that doesn't compile has none.
    """
    try:
        tree = sre_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return frozenset()
    if tree.state.flags & re.VERBOSE:
        return frozenset()
    return _needed(tree, lambda found: max(found, key=lambda f: (min(map(len, f)), -len(f), sorted(f)), default=None)) or frozenset()


def whole_word(pattern: str) -> str | None:
    """The folded word of an expression that is a word between two word boundaries and nothing else, such as `\\bfoo\\b`.

    A match of it is a whole run of word characters, so that the runs of a text are all that has to be looked at.
    """
    try:
        tree = sre_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    edge = (sre.AT, sre.AT_BOUNDARY)
    parts = list(tree)
    if tree.state.flags & ~re.UNICODE or len(parts) < 3 or parts[0] != edge or parts[-1] != edge or any(op is not sre.LITERAL for op, _ in parts[1:-1]):
        return None
    word = "".join(chr(v) for _, v in parts[1:-1])
    return word.upper().lower() if WORD.fullmatch(word) else None


def trie(literals: Iterable[str]) -> str:
    """An expression that matches the longest literal at a place, as nested alternatives without a common beginning."""
    root: dict = {}
    for lit in literals:
        node = root
        for c in lit:
            node = node.setdefault(c, {})
        node[""] = {}

    def said(node: dict) -> str:
        # A chain of single characters is written out, so that nesting follows the branches and not the characters.
        chain = ""
        while len(node) == 1 and "" not in node:
            ((c, node),) = node.items()
            chain += re.escape(c)
        parts = [re.escape(c) + said(n) for c, n in sorted(node.items()) if c]
        if not parts:
            return chain
        return f"{chain}(?:{'|'.join(parts)}){'?' if '' in node else ''}"

    return said(root)


def present(text: Column, literals: Sequence[str]) -> Column:
    """array<string>: which of the (folded) literals a text has. A look-ahead takes no characters, so that literals which
    overlap are all found; one that is the beginning of a longer one is added."""
    begin = {lit: [x for x in literals if x != lit and lit.startswith(x)] for lit in literals}
    found = F.array_distinct(F.regexp_extract_all(fold(text), F.lit(f"(?s)(?=({trie(literals)}))"), 1))
    nested = {k: v for k, v in begin.items() if v}
    if not nested:
        return found
    more = F.from_json(F.lit(json.dumps(nested)), "map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.concat(F.array(x), F.coalesce(F.try_element_at(more, x), F.array().cast("array<string>"))))))


def rule_rows(rules: DataFrame, collections: Sequence[str] = ("antipattern", "standard"), severities: Sequence[str] | None = None, categories: Sequence[str] | None = None, source_types: Sequence[str] | None = None) -> list[TableRule]:
    """The rules of a loaded table (`stores.read_rules`) that have an expression and pass the filters, by collection and id.
    Without severities antipatterns count if critical or warning, standards always. A knowledge base is small: its rules are
    read by the driver, which makes the plan of them. One whose expression doesn't compile is left out."""
    level = F.col("severity").isin(list(severities)) if severities is not None else (F.col("type") != "antipattern") | F.col("severity").isin("critical", "warning")
    rows = rules.where(F.col("regex_pattern").isNotNull() & F.col("type").isin(list(collections)) & level)
    if categories:
        rows = rows.where(F.col("category").isin(list(categories)))
    if source_types:
        rows = rows.where((F.col("type") != "standard") | F.col("source_type").isin(list(source_types)))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("id", "type", "severity", "category", "title", "source_type", "source_code", "source_url", "regex_pattern")]
    out = []
    for r in rows.select(*text, F.coalesce("flags", F.lit("m")).alias("flags")).orderBy("type", "id").collect():
        try:
            re.compile(r["regex_pattern"])
        except re.error:
            continue
        out.append(TableRule(r["id"], r["type"], r["severity"], r["category"], r["title"], r["source_type"], r["source_code"], r["source_url"], r["regex_pattern"], r["flags"]))
    return out


def detect_table(df: DataFrame, id_col: str, text_col: str, rules: Sequence[TableRule]) -> DataFrame:
    """(id, rule_id, collection, severity, category, source, line, message, match[:100]): the findings of all rules, as
    `rules.detect` has them for each alone.

    Rules of whole words take one scan of the texts' words, whatever their number, and no shuffle. The others take another
    scan; a text is carried once for each of them that is a candidate, but not shuffled: only matches are. Null texts have no
    findings; rows that repeat an id are read each for itself.
    """
    spark = df.sparkSession
    whole = {i: w for i, r in enumerate(rules) if (w := whole_word(r.pattern)) is not None}
    found = [_words_met(df, id_col, text_col, {i: (w, rules[i]) for i, w in whole.items()})] if whole else []
    if len(whole) < len(rules) or not rules:
        found.append(_candidates_met(df, id_col, text_col, {i: r for i, r in enumerate(rules) if i not in whole}))
    located = reduce(DataFrame.unionByName, found)
    names = spark.createDataFrame([(i, r.rule_id, r.collection, r.severity, r.category, (r.source_type, r.source_code, r.source_url), r.title) for i, r in enumerate(rules)], "rule int, rule_id string, collection string, severity string, category string, source struct<type:string,code:string,url:string>, message string")
    return located.join(F.broadcast(names), "rule").select(id_col, "rule_id", "collection", "severity", "category", "source", "line", "message", F.substring("match", 1, 100).alias("match"))


def _words_met(df: DataFrame, id_col: str, text_col: str, rules: dict[int, tuple[str, TableRule]]) -> DataFrame:
    """(id, rule, line, match) of rules that are whole words: the texts' words met by their folded form, which says which rules
    can match; the rule's own expression on the word decides."""
    table = df.sparkSession.createDataFrame([(w, i, test_pattern(r.pattern, r.flags)) for i, (w, r) in rules.items()], "weft_folded string, rule int, weft_plain string")
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("weft_n", "weft_line"))
    said = lines.select(id_col, "weft_n", F.explode(F.regexp_extract_all("weft_line", F.lit(r"(?U)\w+"), 0)).alias("match"))
    met = said.withColumn("weft_folded", fold(F.col("match"))).join(F.broadcast(table), "weft_folded")  # the rules, which the driver holds
    return met.where(F.rlike("match", F.col("weft_plain"))).select(id_col, "rule", (F.col("weft_n") + 1).cast("int").alias("line"), "match")


def _candidates_met(df: DataFrame, id_col: str, text_col: str, rules: dict[int, TableRule]) -> DataFrame:
    """(id, rule, line, match) of rules that run on the texts which have one of their literals."""
    spark = df.sparkSession
    literals = {i: necessary(r.pattern, r.flags) for i, r in rules.items()}
    every = sorted(set().union(*literals.values()))
    heads = [(lit, sorted(found or [""]), i) for i, found in literals.items() for lit in (found or [""])]
    said = {i: (test_pattern(r.pattern, r.flags), compile_pattern(r.pattern, r.flags), never_empty(r.pattern)) for i, r in rules.items()}
    table = spark.createDataFrame([(lit, any_, i, *said[i]) for lit, any_, i in heads], "weft_literal string, weft_any array<string>, weft_rule int, weft_plain string, weft_full string, weft_solid boolean")
    text = F.col(text_col)
    parts = [present(text, every[k : k + LITERALS]) for k in range(0, len(every), LITERALS)]
    has = F.concat(F.array(F.lit("")), *parts)
    rows = df.where(text.isNotNull()).select(F.col(id_col), text.alias("weft_text"), row_key(text).alias("row"), has.alias("weft_has"))
    # Rules meet a row through their literals; of several that a text has the first counts.
    own = F.broadcast(table)  # the rules, which the driver holds
    met = rows.select(id_col, "row", "weft_text", "weft_has", F.explode("weft_has").alias("weft_literal")).join(own, "weft_literal")
    met = met.where(F.element_at(F.array_intersect("weft_any", "weft_has"), 1) == F.col("weft_literal"))
    found = met.select(id_col, "row", F.col("weft_rule").alias("rule"), pieces(F.col("weft_text"), F.col("weft_plain"), F.col("weft_full"), F.col("weft_solid")).alias("pieces"))
    return _located(found, id_col, ["rule"]).drop("pos")
