"""Which patterns do texts hold: a join on substrings without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram of a pattern that has no WORD; a shorter pattern is a gram of its own.
GRAM = 6
#: A gram of patterns of words: a run between two spaces, with the character on either side of them. Texts have one for a word, not one
#: for a character. What it matches in a pattern it matches in each text that holds the pattern, as it looks at nothing beyond its match.
WORD = "[^ ] [^ ]*+ [^ ]"
#: Characters of all patterns up to which they are sent to every executor; larger tables of patterns are shuffled.
FEW = 500_000


def _grams(text: Column, kind: int) -> Column:
    """The different runs of `kind` characters of a text, of kind 0 its WORDs, found in one pass over it."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({f'.{{{kind}}}' if kind else WORD}))"), F.lit(1))), F.array().cast("array<string>"))


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """key and pattern for each text that holds a pattern (column pattern, different ones), in any place and as it is.

    Each pattern is looked for by the gram of its own that the fewest texts have: grams of texts meet those of patterns in an equi-join,
    are counted where a pattern has several, and only where a pattern's rarest gram occurs is the text looked at. Texts are cut to grams
    once for each kind of gram that patterns have, GRAM + 1 at most. Few patterns are sent to the texts, which then stay where they
    are read. Otherwise tables that grow with the patterns or texts are merged, never sent through the driver, whatever size their
    files have. An empty or null pattern is in no text.
    """
    kind = F.when(F.col("pattern").rlike(WORD), 0).otherwise(F.least(F.length("pattern"), F.lit(GRAM)))
    own = F.coalesce(*[F.when(F.col("kind") == n, _grams(F.col("pattern"), n)) for n in range(GRAM + 1)])
    wanted = patterns.filter("pattern <> ''").select("pattern", kind.alias("kind")).select("pattern", "kind", own.alias("own"))
    kinds = {r["kind"]: r for r in wanted.groupBy("kind").agg(F.sum(F.length("pattern")).alias("n"), F.max(F.size("own")).alias("most")).collect()}  # GRAM + 1 rows at most
    if not kinds:
        return texts.select(key, F.lit("").alias("pattern")).limit(0)
    few = sum(r["n"] for r in kinds.values()) <= FEW
    how = "broadcast" if few else "merge"
    whole = texts.filter(F.col(key).isNotNull()).select(key, F.col(text).alias("_text"))

    def cut(*chosen: int) -> Column:
        return F.explode(F.concat(*[_grams(F.col("_text"), n) for n in sorted(chosen)])).alias("gram")

    rarest = wanted.filter(F.size("own") == 1).select("pattern", F.col("own")[0].alias("gram"))
    if several := [n for n, r in kinds.items() if r["most"] > 1]:
        grams = wanted.filter(F.size("own") > 1).select("pattern", F.explode("own").alias("gram"))
        counts = whole.select(cut(*several)).join(grams.select("gram").distinct().hint(how), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        counted = grams.join(counts if few else counts.hint("merge"), "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        rarest = rarest.unionAll(counted.filter("r.n > 0").select("pattern", "r.gram"))
    if few:
        tried = whole.select(key, "_text", cut(*kinds)).join(rarest.hint(how), "gram")
    else:
        tried = whole.select(key, cut(*kinds)).join(rarest.hint(how), "gram").select(key, "pattern").distinct().join(whole.hint(how), key)
    return tried.filter(F.contains("_text", "pattern")).select(key, "pattern").distinct()
