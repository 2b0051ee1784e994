"""License scans: sparse TF-IDF cosine of lines and blocks to licence templates, then inheritance from the nearest ancestor directory.

Only DataFrame and SQL functions run here. Each line of a text is compared with all templates. Term weights are counts
times inverse document frequencies among the templates; terms that no template has weigh the most. Lines without a
telling term are left out: the rest of a template's terms have less than MATCH of its length, so such a line can't match. The
terms of other lines are counted in their row, where the templates' vectors are literals. A file's licence is that of its best line, the first template by name on a tie.

Standard headers and full licence texts, wrapped as they may be, are compared by blocks of words: the terms are runs of
SHINGLE words, so comment marks and line ends don't count, and terms that no template has are left out, so that code
around a header doesn't count either; a term counts once. A template has the blocks of twice its span, the power of two from its number of
terms on, that begin at each multiple of the span; any place where it can stand lies in one of them whole. A block goes
before a line, as it says more. Texts without a word of which each block that matches has one, as the templates tell, have
no blocks.

A file without a licence inherits that of the nearest directory on its path, its own first, for which a file declares
one; of several in a directory the least path decides. Directories are resolved once each, before files meet them.
Nulls: a null text has no lines; a null path has no directory. Repeated rows are each a row of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.frames import unused
from tessera.llm.store import written

MATCH = 0.6
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Short forms of notices, as files carry them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "Proprietary": "All rights reserved.",
}
#: Words that any text may have; the first of them that can't make a match between them tell nothing.
COMMON = ("the", "to", "of", "this", "is", "under", "by", "all", "work", "3", "2", "general", "version")

#: Words in a term of a block.
SHINGLE = 3
#: Standard headers and full texts; a licence's name is what comes before a space.
BLOCKS = {x.name.removesuffix(".txt").replace(".header", " header"): x.read_text("utf-8") for x in resources("tessera.llm").joinpath("licence_texts").iterdir()}


def weights(templates: dict[str, str] = TEMPLATES) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Unit vectors of the templates, the terms' inverse document frequencies and that of any other term."""
    return _weights({k: Counter(re.findall(WORD, v.lower())) for k, v in templates.items()})


def _weights(counts: dict[str, Counter]) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    n, seen = len(counts), Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in seen.items()}
    raw = {k: {w: tf * idf[w] for w, tf in c.items()} for k, c in counts.items()}
    norms = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in raw.items()}
    return {k: {w: x / norms[k] for w, x in v.items()} for k, v in raw.items()}, idf, math.log(1 + n) + 1


def telling(templates: dict[str, str] = TEMPLATES, match: float = MATCH) -> list[str]:
    """Terms of which each matching line has one."""
    units, idf, _ = weights(templates)
    weak: set[str] = set()
    for word in COMMON:
        more = weak | {word}
        if all(math.sqrt(sum(x * x for w, x in unit.items() if w in more)) < match for unit in units.values()):
            weak = more
    return sorted(set(idf) - weak)


def line_match(text: Column, templates: dict[str, str] = TEMPLATES, match: float = MATCH) -> Column:
    """The least score's opposite and the licence (least, license) of the line of a text that is most like a template; null for none.

    A line's terms are sorted and their runs counted in the row, and templates are literals, so nothing is joined or grouped.
    """
    units, idf, other = weights(templates)
    names = sorted(units)
    vectors = F.create_map(*[x for w in sorted(idf) for x in (F.lit(w), F.struct(F.lit(idf[w]).alias("idf"), F.array(*[F.lit(units[k].get(w, 0.0)) for k in names]).alias("units")))])
    any_of = "(?i)(?<![a-z0-9])(" + "|".join(re.escape(w) for w in telling(templates, match)) + ")(?![a-z0-9])"

    def scored(line: Column) -> Column:
        words = F.sort_array(F.regexp_extract_all(F.lower(line), F.lit(WORD), 0))
        # (word, how often so far, whether it is the last of its run), folded into the length and the dots.
        nothing = F.struct(F.lit("").alias("word"), F.lit(0).alias("tf"), F.lit(0.0).alias("square"), F.array(*[F.lit(0.0)] * len(names)).alias("dots"))

        def closed(a: Column) -> tuple[Column, Column]:
            known = F.try_element_at(vectors, a["word"])
            w = a["tf"] * F.coalesce(known["idf"], F.lit(other))
            return a["square"] + w * w, F.when(known.isNull(), a["dots"]).otherwise(F.zip_with(a["dots"], known["units"], lambda d, u: d + w * u))

        def step(a: Column, word: Column) -> Column:
            square, dots = closed(a)
            more = F.struct(a["word"].alias("word"), (a["tf"] + 1).alias("tf"), a["square"].alias("square"), a["dots"].alias("dots"))
            return F.when(a["word"] == word, more).otherwise(F.struct(word.alias("word"), F.lit(1).alias("tf"), square.alias("square"), dots.alias("dots")))

        def best(a: Column) -> Column:
            square, dots = closed(a)
            each = F.zip_with(dots, F.array(*map(F.lit, names)), lambda d, k: F.struct((-F.round(d / F.sqrt(square), 6)).alias("least"), k.alias("license")))
            return F.array_min(each)

        return F.aggregate(words, nothing, step, best)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(any_of))
    found = F.array_min(F.filter(F.transform(lines, scored), lambda x: x["least"] <= -match))
    return F.when(text.rlike(any_of), found)


def matches(files: DataFrame, key: str, text: str, templates: dict[str, str] = TEMPLATES, match: float = MATCH) -> DataFrame:
    """key, license and score of the rows with a line like a template; rows that repeat a key are rows of their own."""
    found = files.select(key, line_match(F.col(text), templates, match).alias("best")).filter("best IS NOT NULL")
    return found.select(key, F.col("best.license").alias("license"), (-F.col("best.least")).alias("score"))


def shingles(text: str) -> list[str]:
    """The runs of SHINGLE words of a text."""
    words = re.findall(WORD, text.lower())
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def legal(templates: dict[str, str] = BLOCKS, match: float = MATCH) -> str:
    """A pattern of words in lower case of which each block that matches a template has one: for every template, its terms without such a word are
    less than `match` of its length. Words of five letters or more are taken first, as other texts have fewer of them."""
    return _legal(tuple(sorted(templates.items())), match)


@cache
def _legal(templates: tuple[tuple[str, str], ...], match: float) -> str:
    units = _weights({k: Counter(set(shingles(v))) for k, v in templates})[0]
    left = {k: sum(x * x for x in v.values()) for k, v in units.items()}
    terms = [(k, x * x, set(t.split(" "))) for k, v in units.items() for t, x in v.items()]
    chosen: list[str] = []
    for least in (5, 1):
        while any(x >= match * match for x in left.values()):
            gain: Counter = Counter()
            for k, x, words in terms:
                if left[k] >= match * match:
                    for w in words:
                        if len(w) >= least:
                            gain[w] += x
            if not gain:
                break
            word = min(gain, key=lambda w: (-gain[w], w))
            chosen.append(word)
            for k, x, words in terms:
                if word in words:
                    left[k] -= x
            terms = [t for t in terms if word not in t[2]]
    return "(?<![a-z0-9])(" + "|".join(map(re.escape, chosen)) + ")(?![a-z0-9])"


def _mark(text: Column) -> Column:
    """What tells texts apart where rows repeat a key."""
    return F.xxhash64(F.lower(text), F.octet_length(text))


def blocks(files: DataFrame, key: str, text: str, templates: dict[str, str] = BLOCKS, match: float = MATCH) -> DataFrame:
    """key, mark of the text, license and score of the files with a block like a header or a licence text."""
    spark = files.sparkSession
    said = {k: shingles(v) for k, v in templates.items()}
    units, idf, _ = _weights({k: Counter(set(v)) for k, v in said.items()})
    spans = {k: 1 << (len(v) - 1).bit_length() for k, v in said.items()}
    terms = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    rows = [(w, k, k.split(" ")[0], spans[k], x) for k, v in units.items() for w, x in v.items()]
    vectors = F.broadcast(spark.createDataFrame(rows, "term string, template string, license string, span int, unit double"))
    said = files.filter(F.lower(text).rlike(legal(templates, match))).select(key, F.lower(text).alias("said"), _mark(F.col(text)).alias("mark")).dropDuplicates([key, "mark"])
    words = said.select(key, "mark", F.regexp_extract_all("said", F.lit(WORD), 0).alias("words")).filter(F.size("words") >= SHINGLE)
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(SHINGLE)]))
    known = words.select(key, "mark", F.posexplode(runs).alias("at", "term")).join(terms, "term")
    within = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), (F.floor(F.col("at") / n) - back).alias("block")) for n in sorted(set(spans.values())) for back in (0, 1)]))
    block = [key, "mark", "span", "block"]
    weighed = known.select(key, "mark", "term", "idf", within.alias("in")).select(key, "mark", "in.span", "in.block", "term", "idf").groupBy(*block, "term").agg(F.first("idf").alias("w"))
    weighed = weighed.withColumn("length", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*block))))
    dots = weighed.join(vectors, ["term", "span"]).groupBy(*block, "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"), F.first("length").alias("length"))
    scores = dots.select(key, "mark", "license", F.round(F.col("dot") / F.col("length"), 6).alias("score")).filter(F.col("score") >= match)
    return scores.groupBy(key, "mark").agg(F.min(F.struct((-F.col("score")).alias("least"), "license")).alias("best")).select(key, "mark", F.col("best.license").alias("license"), (-F.col("best.least")).alias("score"))


def declared_by(files: DataFrame, key: str, text: str, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """files without their text, with own_license and own_score: those of a block, or else of a line, like a template; null for none. Each
    row has its own, whatever its key is."""
    mark, of, line = (unused(files, name) for name in ("mark", "of", "line"))
    found = blocks(files, key, text).select(F.col(key).alias(of), F.col("mark").alias(f"{of}_mark"), F.struct(F.col("license"), F.col("score")).alias(f"{of}_best"))
    rows = files.withColumns({mark: _mark(F.col(text)), line: line_match(F.col(text), templates)}).drop(text)
    joined = rows.join(found, F.col(key).eqNullSafe(F.col(of)) & (F.col(mark) == F.col(f"{of}_mark")), "left")
    kept = [c for c in files.columns if c != text]
    return joined.select(*kept, F.coalesce(f"{of}_best.license", f"{line}.license").alias("own_license"), F.coalesce(F.col(f"{of}_best.score"), -F.col(f"{line}.least")).alias("own_score"))


def declares(path: Column) -> Column:
    """Whether a path is that of a licence file."""
    return F.regexp_extract(path, "([^/]*)$", 1).rlike(r"(?i)^(licen[cs]e|copying|notice)(\.|$)")


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def inherited(files: DataFrame, path: str = "path", own: str = "own_license", declared: Column | None = None) -> DataFrame:
    """files with `license` (their own or the inherited) and `inherited_from` (the directory, null if their own or none), which replace columns of these names."""
    files = files.drop(*[c for c in ("license", "inherited_from") if c != own])
    declared = declares(F.col(path)) if declared is None else declared
    folder = unused(files, "folder")
    files = files.withColumn(folder, directory(F.col(path)))
    given = files.filter(F.col(own).isNotNull() & declared & F.col(folder).isNotNull()).groupBy(F.col(folder).alias("above")).agg(F.min(F.struct(path, own)).alias("first"))
    given = given.select("above", F.col(f"first.{own}").alias("theirs"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col(folder) == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.select(folder).filter(F.col(folder).isNotNull()).distinct().select(folder, F.posexplode(above).alias("depth", "above"))
    near = unused(files, "near")
    nearest = folders.join(given, "above").groupBy(folder).agg(F.max(F.struct("depth", "above", "theirs")).alias(near))
    joined = files.join(nearest, folder, "left")
    return joined.select(*[c for c in files.columns if c != folder], F.coalesce(own, f"{near}.theirs").alias("license"), F.when(F.col(own).isNull(), F.col(f"{near}.above")).alias("inherited_from"))


def scan(files: DataFrame, key: str, path: str = "path", text: str = "text", declared: Column | None = None, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """files without their text, with own_license, own_score, license and inherited_from, which replace columns of these names. Files' own
    licences are written first, as directories and files both start from them."""
    files = files.drop("own_license", "own_score", "license", "inherited_from")
    return inherited(written(declared_by(files, key, text, templates), "licenses"), path, declared=declared)
