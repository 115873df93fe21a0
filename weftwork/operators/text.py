"""Text operators: HTML and comment stripping, lines, scopes, regions and chunks."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh_names

#: White space as text has it, the no-break space included.
SPACE = r"[\x20\x09-\x0D\x{A0}]"


COMMON = {n: html5[f"{n};"] for n in ("quot", "gt", "lt", "nbsp", "amp")}


def unescape(text: Column) -> Column:
    """Character references decoded: numbers, decimal or hexadecimal, and all names that HTML has. Unknown ones stay, code
    points that are no characters become U+FFFD, and 128 to 159 are read as Windows-1252, as browsers do. A name without a
    semicolon counts where it stands alone."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    win = F.lit([bytes([n]).decode("cp1252", "replace") for n in range(128, 160)])
    parts = F.regexp_extract_all(text, F.lit(r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"), 0)

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, "^&#([0-9]+)", 1)
        hexa = F.regexp_extract(part, "^&#[xX]0*([0-9a-fA-F]+)", 1)
        n = F.when(hexa != "", F.when(F.length(hexa) < 8, F.conv(hexa, 16, 10).cast("long")).otherwise(F.lit(1 << 30))).otherwise(F.coalesce(digits.try_cast("long"), F.lit(1 << 30)))
        odd = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF) | (n == 0)
        char = F.when(odd, "\ufffd").when(n.between(128, 159), F.element_at(win, (n - 127).cast("int"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        named = F.coalesce(F.try_element_at(names, F.substring(part, 2, 1 << 30)), part)
        for name, common in COMMON.items():  # the table is looked through from its start, so the usual ones are tested first
            named = F.when(part == f"&{name};", common).otherwise(named)
        return F.when(~part.startswith("&"), part).when(part.startswith("&#"), char).otherwise(named)

    # Most texts have no reference at all and are left alone.
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def strip_html(html: Column) -> Column:
    """References decoded, tags as spaces, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(html), "<[^>]*>", " "), f"{SPACE}+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))


def strip_line_comment(line: Column, mark: str = "//") -> Column:
    """The line up to a comment mark outside double quotes; possessive, so that long lines need no stack."""
    first, rest = re.escape(mark[0]), re.escape(mark[1:])
    return F.regexp_extract(line, rf'^((?:[^"{first}]|"[^"]*(?:"|$)|{first}(?!{rest}))*+)', 1)


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line), 1-based; an empty text has one empty line, a null text none."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("p", "line")).select(id_col, (F.col("p") + 1).alias("line_no"), "line")


def enclosing(df: DataFrame, part: str, order: str, marker: Column, out: str = "scope", default: str = "<module>") -> DataFrame:
    """The last marker at or before each row; code before the first marker belongs to the module."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(default)))


def assign_regions(items: DataFrame, regions: DataFrame, key: str, at: str, region_cols: tuple[str, str, str]) -> DataFrame:
    """Each item with the innermost region (name, start, end) that holds it, or null: that with the last start, and of those
    the greatest name. The regions of a key, which is a file, travel as one list to its items, so that this is a join on the
    key alone; repeated items stay. Columns may have any names but `region`."""
    name, start, end = region_cols
    own, lists = fresh_names(items, "weft_key", "weft_regions")
    one = F.struct(F.col(start).alias("s"), F.col(name).alias("n"), F.col(end).alias("e"))
    r = regions.groupBy(F.col(key).alias(own)).agg(F.collect_list(one).alias(lists))
    both = items.join(r, F.col(key) == F.col(own), "left")
    inside = F.filter(lists, lambda x: (F.col(at) >= x["s"]) & (F.col(at) <= x["e"]))
    return both.withColumn("region", F.array_max(inside)["n"]).drop(own, lists)


def pair_regions(marks: DataFrame, key: str, line: str, opens: str, name: str) -> DataFrame:
    """(key, name, start_line, end_line, depth): openings paired with their ends by running depth, siblings included."""
    w = Window.partitionBy(key).orderBy(line)
    depth = F.sum(F.when(F.col(opens), 1).otherwise(-1)).over(w)
    level = marks.withColumn("depth", F.when(F.col(opens), depth).otherwise(depth + 1)).where("depth >= 1")
    d = Window.partitionBy(key, "depth").orderBy(line)
    paired = level.withColumn("end_line", F.lead(line).over(d)).where(F.col(opens) & F.col("end_line").isNotNull())
    return paired.select(key, F.col(name).alias("name"), F.col(line).alias("start_line"), "end_line", "depth")


def chunks(df: DataFrame, id_col: str, text_col: str, prefix: Column, separator: str = "\n") -> DataFrame:
    """(chunk_id, id, pos, chunk): non-blank parts of a text, with ids `prefix_id_pos`."""
    parts = df.select(id_col, prefix.alias("__p"), F.posexplode(F.split(text_col, separator, -1)).alias("pos", "chunk")).where(F.trim("chunk") != "")
    return parts.select(F.concat_ws("_", "__p", F.col(id_col).cast("string"), F.col("pos").cast("string")).alias("chunk_id"), id_col, "pos", "chunk")


def neighbours(rows: DataFrame, id_col: str, text_col: str, span: int = 4096) -> DataFrame:
    """(id, t, u): each row's text and that of the row with the next larger id, whatever the gap; the last row has none.

    Ids are whole numbers and unique; null ids are left out. Rows are ordered in spans of ids, and only each span's least
    id is ordered in one task.
    """
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    own = own.withColumn("part", F.floor(F.col("id") / span))
    heads = own.groupBy("part").agg(F.min("id").alias("head")).select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))
    inside = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    ahead = own.withColumn("next", inside).join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    return ahead.join(own.select(F.col("id").alias("next"), F.col("t").alias("u")), "next").select(F.col("id").alias(id_col), "t", "u")


def neighbour_distances(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, distance): edit distance in characters of the whole texts of all neighbours; null where a text is null."""
    return neighbours(rows, id_col, text_col).select(id_col, F.levenshtein("t", "u").cast("long").alias("distance"))
