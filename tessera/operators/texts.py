"""Table-making extraction from texts: lines, headings, mentions, tokens, colours, sections, diffs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of mentions in documents.
MENTIONS = {
    "version": r"\bv?\d+\.\d+\.\d+\b",
    "phase": r"\bPhase\s+\d+[A-Za-z]?\b",
    "test_baseline": r"\b\d+\s+(?:passed|tests?)\b",
    "dotted_name": r"\b[a-z]+\.[a-z_]+\b",
}
#: What borders before and after a word, and white space, of ASCII alone are to Java, whose own border knows letters of all scripts.
ASCII = [(r"^\\b", r"(?<!\\w)"), (r"\\b$", r"(?!\\w)"), (r"\\s", r"[\\t\\n\\f\\r ]")]
# Forms of colours.
COLOURS = {
    "hex": r"#(?:[0-9a-fA-F]{3}){1,2}(?:[0-9a-fA-F]{2})?(?!\w)",
    "rgb": r"rgba?\(\s*\d+\s*,\s*\d+\s*,\s*\d+(?:\s*,\s*[\d.]+)?\s*\)",
    "hsl": r"hsla?\(\s*\d+(?:\.\d+)?\s*,\s*[\d.]+%\s*,\s*[\d.]+%(?:\s*,\s*[\d.]+)?\s*\)",
}
VARIABLE = r"--([\w-]+)\s*:"


def lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1) and text of each line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "text")).select(key, (F.col("at") + 1).alias("line"), "text")


def headings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """EXT-17: key, line, level (1 to 6) and title of the Markdown headings."""
    form = r"^(#{1,6})\s+(.+?)\s*$"
    found = lines(rows, key, text).filter(F.col("text").rlike(form))
    return found.select(key, "line", F.length(F.regexp_extract("text", form, 1)).alias("level"), F.regexp_extract("text", form, 2).alias("title"))


def title(text: Column, name: Column) -> Column:
    """EXT-09: the first line that begins with one hash, or else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^[ \t]*# (.+)$", 1), F.lit("")), name)


def mentions(rows: DataFrame, key: str, patterns: dict[str, str] = MENTIONS, text: str = "text", most: int | None = 20) -> DataFrame:
    """EXT-18, AGG-24: key, kind and the first `most` different values of each kind, or all, in the order in which they are met.
    Borders of words at the ends of the patterns, whose values begin and end with a character of a word, and white space are those of ASCII, as in SQL."""
    form = lambda p: F.lit(reduce(lambda x, pair: re.sub(*pair, x), ASCII, p))
    values = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(text, form(p), 0), lambda x: F.trim(x)))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (values(p) if most is None else F.slice(values(p), 1, most)).alias("values")) for k, p in patterns.items()])
    return rows.select(key, F.inline(kinds)).filter(F.size("values") > 0)


def colours(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """EXT-20: key, line, kind, value and column (from 0) of the first hard-coded colour of each kind in a line that is neither a
    comment nor defines a variable."""
    plain = lines(rows, key, text).filter(~F.trim("text").startswith("//") & ~F.trim("text").startswith("/*") & ~F.col("text").rlike(VARIABLE))
    parts = [plain.select(key, "line", F.lit(k).alias("kind"), "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0))).alias("value")) for k, p in COLOURS.items()]
    return reduce(DataFrame.unionAll, parts).select(key, "line", "kind", "value", (F.instr("text", F.col("value")) - 1).alias("column"))


def variables(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """EXT-08: key and name of the CSS variables that are defined."""
    return rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(VARIABLE), 1)).alias("name"))


def code_lines(text: Column, comments: bool = True) -> Column:
    """AGG-12: lines that aren't blank and, with comments, don't begin with a hash."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & (F.lit(not comments) | ~F.trim(x).startswith("#"))))


def diff_counts(text: Column) -> list[Column]:
    """EXT-22: insertions and deletions of a unified diff; heads of files don't count."""
    count = lambda a, b: F.size(F.filter(F.split(text, "\n"), lambda x: x.startswith(a) & ~x.startswith(b)))
    return [count("+", "+++").alias("insertions"), count("-", "---").alias("deletions")]


def added_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """EXT-21: file, line and text of the lines that unified diffs add, by their number in the new file.

    A hunk's number and what stands before a line in it give its place; each hunk is taken apart on its own, so that no
    row needs more than its hunk.
    """
    files = diffs.select(F.posexplode(F.split(text, r"(?m)^diff --git .*$")).alias("f", "part"))
    named = files.select(F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?(.+)$", 1).alias("file"), "part").filter("file <> ''")
    hunks = named.select("file", F.explode(F.regexp_extract_all("part", F.lit(r"(?ms)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@.*?(?=^@@ |\z)"), 0)).alias("hunk"))
    body = F.filter(F.slice(F.split("hunk", "\n"), 2, 1 << 30), lambda x: x != "")
    start = F.regexp_extract("hunk", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")
    rows = hunks.select("file", start.alias("start"), body.alias("body")).select("file", "start", F.posexplode("body").alias("at", "said"), "body")
    before = F.size(F.filter(F.slice("body", 1, F.col("at")), lambda x: ~x.startswith("-") & ~x.startswith("\\")))
    return rows.filter(F.col("said").startswith("+")).select("file", (F.col("start") + before).alias("line"), F.expr("substring(said, 2)").alias("text"))


def section(text: Column, heading: str) -> Column:
    """EXT-24: what stands between a heading and the next of its level or above; null without it."""
    level = len(heading) - len(heading.lstrip("#"))
    found = F.regexp_extract(text, rf"(?ms)^\Q{heading}\E[ \t]*\n(.*?)(?=^#{{1,{level}}}\s|\z)", 1)
    return F.when(text.rlike(rf"(?m)^\Q{heading}\E[ \t]*$"), F.regexp_replace(found, r"^\s+|\s+$", ""))


def versions(text: Column) -> Column:
    """EXT-19: the version headings of a changelog, the latest first."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^##\s+\[?(v?\d+\.\d+\.\d+)\]?"), 1)


def stale_baselines(docs: DataFrame, key: str, main: Column, gap: int = 50, text: str = "text") -> DataFrame:
    """AGG-23: documents whose first number of tests lies more than `gap` below the greatest of the main documents."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,9})\s+(?:passed|tests?)\b"), 1), lambda x: x.cast("int"))
    held = docs.select(key, main.alias("main"), numbers.alias("numbers"))
    top = held.filter("main").agg(F.max(F.array_max("numbers")).alias("top"))
    low = F.filter("numbers", lambda x: x < F.col("top") - gap)
    return held.filter("NOT main").crossJoin(top).withColumn("stale", F.try_element_at(low, F.lit(1))).filter("stale IS NOT NULL").select(key, "stale", "top")
