"""Rule sets over a change list made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import rules as R
from tessera.operators import upkeep as U
from tessera.plans.bindings import CHANGES_SQL, changes
from tessera.session import table

ALLOWED, DENIED, PROTECTED = ["src/*", "tests/", "docs/*.md"], ["*.png", "src/large/"], [".env", "*/models.py", "Docker*"]
EDITABLE, CAUTIOUS, FORBIDDEN = ["src/", "docs/"], ["src/promo/"], ["tests/economy/"]
TASK = ["widget", "bolt"]
#: What a task asks for: a path that is allowed, and a pattern that isn't.
DECLARED = ["src/a.py", "lib/*"]


def change_categories(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-03, PRJ-04, PRJ-05: each path's category, whether it is a schema, and its group."""
    path = F.col("path")
    return changes(spark, d).select("path", P.change_category(path, dotfiles=True).alias("category"), P.is_schema(path).alias("is_schema"), P.group_key(path).alias("group_key"), P.suffix(path).alias("suffix"), P.stem(path).alias("stem"))


def change_groups(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18."""
    return R.groups(changes(spark, d))


def change_group_files(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: the files of each group."""
    return R.group_files(changes(spark, d))


def dependency_file_list(spark: SparkSession, d: str) -> DataFrame:
    """RUL-28."""
    return R.dependency_files(changes(spark, d)).select("id", "path")


def commit_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19."""
    return R.commits(changes(spark, d).withColumn("status", F.when(F.col("id") % 3 == 0, "A").otherwise("M")))


def budget_check(spark: SparkSession, d: str) -> DataFrame:
    """RUL-01, AGG-13 with a limit of lines."""
    return R.budget(changes(spark, d), max_lines=5000)


def dev_guard(spark: SparkSession, d: str) -> DataFrame:
    """RUL-02, AGG-21."""
    return R.development(changes(spark, d), PROTECTED, DENIED, TASK)


def scope_check(spark: SparkSession, d: str) -> DataFrame:
    """RUL-13, PRJ-06, JOI-16."""
    return R.scope(changes(spark, d), ALLOWED, DENIED, PROTECTED, 100)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("id") % 29 == 0, F.lit("lib/pom.xml")).when(F.col("id") % 31 == 0, F.lit("lib/setup.py")).when(F.col("id") % 37 == 0, F.lit("src/requirements-dev.txt")).when(F.col("id") % 41 == 0, F.lit("lib/requirements-dev.txt")).otherwise(F.col("path"))
    rows = changes(spark, d).withColumn("path", path).withColumn("old_hash", F.when(F.col("id") % 10 != 0, F.sha2("path", 256))).withColumn("new_hash", F.when(F.col("id") % 50 == 1, "other").otherwise(F.sha2("path", 256)))
    return R.gate_facts(rows, ALLOWED, PROTECTED, DECLARED)


def gate_findings(spark: SparkSession, d: str) -> DataFrame:
    """RUL-14, RUL-15, RUL-16."""
    return R.denoised(R.gated(_facts(spark, d)))


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15 with and without an anchored authority, and of nothing."""
    some, none = R.gated(_facts(spark, d)), R.gated(_facts(spark, d).filter("rule = 'no such rule'"))
    loose = R.gated(_facts(spark, d).filter("rule = 'scope.unlisted_file_modified'"), anchored=False)
    each = [R.verdict(f).withColumn("case", F.lit(c)) for c, f in (("all", some), ("none", none), ("loose", loose))]
    return R.together(*each)


def severity_tally(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, AGG-16, RUL-29: all rule sets over one change list in one table."""
    rows = changes(spark, d)
    return R.tally(R.together(R.budget(rows), R.development(rows, PROTECTED, DENIED, TASK), R.scope(rows, ALLOWED, DENIED, PROTECTED, 100), R.locks(rows), R.secret_files(rows)))


def lock_sync(spark: SparkSession, d: str) -> DataFrame:
    """RUL-03, JOI-14: of manifests with an even key a lock file changed too."""
    rows = changes(spark, d)
    lock = F.when(P.name(F.col("path")) == "package.json", "/pnpm-lock.yaml").when(P.name(F.col("path")) == "requirements.txt", "/requirements.lock")
    more = rows.filter("id % 2 = 0").select("id", F.concat(P.parent(F.col("path")), lock).alias("path"), "n_lines").filter("path IS NOT NULL")
    return R.locks(rows.unionByName(more))


def companion_tests(spark: SparkSession, d: str) -> DataFrame:
    """JOI-15: sources are among those of which a test with the same stem may be; here stems end with the part's number."""
    rows = changes(spark, d)
    more = rows.filter("id % 9 = 0").select("id", F.concat(F.lit("tests/test_"), P.stem(F.col("path")), F.lit(".py")).alias("path"), "n_lines")
    kept = rows.filter("id % 13 = 0").select("id", F.concat(F.lit("more/tests/test_"), P.stem(F.col("path")), F.lit(".py.snap")).alias("path"), "n_lines")
    return R.companions(rows.unionByName(more).unionByName(kept)).groupBy("tested").agg(F.count("*").alias("n"))


#: Parts of the change list, with a message each, and how SQL picks and names their paths.
MANIFEST_CASES = [
    ("all", "feat: parts", "TRUE", "path"), ("tests", "", "path LIKE 'tests/%' AND path NOT LIKE '%.md'", "path"), ("docs", "", "path LIKE 'docs/%' AND path NOT LIKE '%test_%'", "path"),
    ("none", "Fix: x", "id < 0", "path"), ("cli", "chore: x", "id % 53 = 1", "'app/cli.py'"), ("skill", "docs: x", "id % 59 = 1", "'Skills/x.yaml'"), ("mcp", "", "id % 61 = 1", "'mcp/tests/test_a.py'"),
]


def change_manifest(spark: SparkSession, d: str) -> DataFrame:
    """RUL-22, AGG-17 of parts of the change list."""
    rows = changes(spark, d)
    each = [R.manifest(rows.filter(on).withColumn("path", F.expr(path)), message).withColumn("case", F.lit(case)) for case, message, on, path in MANIFEST_CASES]
    return R.together(*each)


_CORE = "CASE WHEN id % 67 = 0 THEN concat('src/core/a', CAST(id AS VARCHAR(20)), '.py') WHEN id % 71 = 0 THEN concat('dist/x', CAST(id AS VARCHAR(20)), '.go') ELSE path END"


def diff_explained(spark: SparkSession, d: str) -> DataFrame:
    """RUL-11, AGG-18: the hints on the whole change list, and on its manifests alone."""
    rows = changes(spark, d).withColumn("path", F.expr(_CORE))
    few = rows.filter("path LIKE '%package.json' AND id < 2000")
    each = [R.explained(x).withColumn("case", F.lit(case)) for case, x in (("all", rows), ("few", few))]
    return R.together(*each).withColumn("hints", F.array_join("hints", ","))


def merge_checks(spark: SparkSession, d: str) -> DataFrame:
    """RUL-23: what speaks against merging a branch of each part, and whether it is ready."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(
        k.alias("repository"), (k % 3).alias("staged"), F.lit(0).alias("unstaged"), F.when(k % 7 == 0, s).otherwise(0).alias("untracked"), (k % 5).alias("backups"),
        F.when(k % 2 == 0, "main").otherwise(F.concat(F.lit("b"), s)).alias("branch"), F.when(k % 4 == 0, "main").otherwise("next").alias("target"), F.when(k % 11 != 0, s % 3).alias("commits"), (k % 13 != 0).alias("has_index"),
    )
    found = R.merge_checks(rows, "repository", ["main"]).withColumn("severity", F.when(F.col("level") == "blocker", "error").otherwise("warning"))
    ready = U.merge_ready(found, "repository").select("repository", "ready")
    return found.join(ready, "repository").select("repository", "check", "level", "ready")


def change_predicates(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-04: what a path is to the rules; every seventh has another extension."""
    path = F.when(F.col("id") % 7 == 0, F.concat("path", F.when(F.col("id") % 2 == 0, ".vue").otherwise(".mts"))).otherwise(F.col("path"))
    rows = changes(spark, d).select("id", path.alias("path"))
    at = F.col("path")
    return rows.select("id", R.is_config(at).alias("is_config"), P.suffix(at).isin(R.DEV_CODE_EXTENSIONS).alias("is_code"), P.is_reviewed(at).alias("is_reviewed"), P.is_page(at).alias("is_page"), P.is_environment(at).alias("is_environment"), P.is_test(at).alias("is_test"), P.is_schema(at).alias("is_schema"))


def docs_status(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11: the documents that each part's tree is to have; which it has follows from its key."""
    k = F.col("p_partkey")
    held = F.array(*[F.when(k % n == 0, F.struct(F.lit(path).alias("path"), F.when(k % (2 * n) == 0, F.lit(0)).otherwise(F.col("p_size")).alias("size"))) for n, path in ((2, "README.md"), (3, "docs/api.md"), (5, "LICENSE"), (1, "other.md"))])
    trees = table(spark, d, "part").select(k.alias("tree"), F.array_compact(held).alias("held"))
    return R.docs_status(trees, trees.select("tree", F.inline("held")), "tree").select("tree", "path", "status", F.round("share", 6).alias("share"))


def review_first(spark: SparkSession, d: str) -> DataFrame:
    """TOP-04, TOP-03."""
    return R.review_order(changes(spark, d))


def region_paths(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-08."""
    return R.regions(changes(spark, d), EDITABLE, CAUTIOUS, FORBIDDEN).groupBy("region").agg(F.count("*").alias("n"))


_HEADERS = "concat(CASE p_partkey % 6 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'docs' WHEN 3 THEN 'odd' WHEN 4 THEN 'refactor' ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN concat('(', lower(p_type), ')') ELSE '' END, CASE WHEN p_partkey % 1999 = 0 THEN '!' ELSE '' END, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE ': ' END, p_name, CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END)"


def commit_headers(spark: SparkSession, d: str) -> DataFrame:
    """EXT-25, RUL-24."""
    k = F.col("p_partkey")
    header = F.when(k % 13 == 0, F.lit("feat: Upper")).when(k % 17 == 0, F.concat(F.lit("fix("), F.repeat(F.lit("s"), k % 40), F.lit("): "), F.repeat(F.lit("w"), k % 90 + 1))).otherwise(F.expr(_HEADERS))
    rows = table(spark, d, "part").select("p_partkey", header.alias("header"))
    parts = rows.select("p_partkey", *R.commit_parts(F.col("header")))
    return parts.withColumn("problems", F.array_join(R.commit_problems(F.col("type"), F.col("scope"), F.col("subject")), ","))


def commit_messages(spark: SparkSession, d: str) -> DataFrame:
    """RUL-24: messages put together of parts."""
    k = F.col("p_partkey")
    scope, body, breaking = F.when(k % 2 == 0, F.col("p_type")), F.when(k % 3 == 0, F.concat(F.lit(" "), "p_brand", F.lit("\n"))), F.when(k % 5 == 0, F.col("p_name")).otherwise("  ")
    return table(spark, d, "part").select("p_partkey", R.commit_message(F.lit("feat"), F.concat(F.col("p_name"), F.lit(" ")), scope, body, breaking).alias("message"))


def release_plan(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20, TOP-07: the bump, and the last tag in the order of letters."""
    rows = table(spark, d, "part")
    tag = rows.agg(F.max(F.concat(F.lit("v0."), F.col("p_size"), F.lit(".0"))).alias("tag"))
    return R.release(rows.select(F.expr(_HEADERS).alias("header"))).crossJoin(tag).withColumn("next", P.bumped(F.col("tag"), F.col("bump")))


def version_bumps(spark: SparkSession, d: str) -> DataFrame:
    """RUL-25, PRJ-10."""
    version = F.when(F.col("p_partkey") % 7 == 0, F.lit("draft")).otherwise(F.concat(F.when(F.col("p_partkey") % 2 == 0, "v").otherwise(""), F.lit("1."), "p_size", F.lit("."), F.col("p_partkey") % 10))
    bump = F.when(F.col("p_partkey") % 3 == 0, "major").when(F.col("p_partkey") % 3 == 1, "minor").otherwise("patch")
    return table(spark, d, "part").select("p_partkey", P.bumped(version, bump).alias("next"), P.safe_id(F.col("p_brand")).alias("safe"))


def diff_signals(spark: SparkSession, d: str) -> DataFrame:
    """RUL-12."""
    return R.diff_signals(changes(spark, d), ["docs"]).withColumn("hints", F.array_join("hints", ","))


def patch_safety(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-09: why paths may not be patched; some are moved into odd places."""
    path = F.when(F.col("id") % 17 == 0, F.concat(F.lit("../"), "path")).when(F.col("id") % 19 == 0, F.concat(F.lit("dist/"), "path")).when(F.col("id") % 23 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    return changes(spark, d).select("id", P.unsafe(path).alias("reason"))


def review_words(spark: SparkSession, d: str) -> DataFrame:
    """RUL-28: words of interest in paths, here those of parts."""
    return changes(spark, d).select("id", F.array_join(R.review_words(F.col("path"), ["bolt", "red", "src", "test"]), ",").alias("words"))


def repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: names that several parts have, and how many."""
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


QUERIES = {f.__name__: f for f in (change_categories, change_groups, change_group_files, dependency_file_list, commit_suggestions, budget_check, dev_guard, scope_check, gate_findings, gate_verdict, severity_tally, lock_sync, companion_tests, change_manifest, diff_explained, merge_checks, change_predicates, docs_status, review_first, region_paths, commit_headers, commit_messages, release_plan, version_bumps, diff_signals, patch_safety, review_words, repeated_names)}


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_P = f"""c AS ({CHANGES_SQL}), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.]+.*?(\\.[^.]+)$', 1) AS suffix FROM c),
    k AS (SELECT *, CASE WHEN lower(name) IN {_in(P.CHANGE_MANIFESTS)} THEN 'manifest'
        WHEN regexp_matches(lower(path), 'test_|_test\\.|/test/|/tests/|spec\\.') THEN 'test' WHEN suffix IN {_in(P.CHANGE_DOCUMENTS)} THEN 'doc'
        WHEN lower(name) IN {_in(P.CHANGE_CONFIG_NAMES)} OR suffix IN {_in(P.CHANGE_CONFIG_EXTENSIONS)} OR lower(name) IN {_in(P.CHANGE_CONFIG_EXTENSIONS)} THEN 'config'
        WHEN suffix IN {_in(P.CHANGE_SOURCES)} THEN 'source' ELSE 'other' END AS category,
        (name IN ('models.py', 'schema.py') OR name LIKE '%.sql') AS is_schema,
        CASE WHEN path LIKE 'src/%' THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS group_key,
        split_part(path, '/', 1) AS top,
        (path LIKE 'src/%' OR path LIKE 'tests/%' OR (path LIKE 'docs/%.md')) AS allowed,
        (path LIKE '%.png' OR path LIKE 'src/large/%') AS denied,
        (name = '.env' OR path LIKE '%/models.py' OR name LIKE 'Docker%') AS protected FROM n)"""
_FOUND = "SELECT '{0}' AS rule_set, '{1}' AS rule, '{2}' AS severity, CAST({3} AS VARCHAR) AS subject, CAST(NULL AS INTEGER) AS line FROM k {4}"
_BUDGET = [("change.budget", "file_count", "error", "count(*)", "HAVING count(*) > 10"), ("change.budget", "schema_change", "error", "count(*)", "WHERE is_schema HAVING count(*) > 0"), ("change.budget", "per_file_limit", "warning", "path", "WHERE n_lines > 200")]
_LINES = ("change.budget", "line_count", "warning", "sum(n_lines)", "HAVING sum(n_lines) > 5000")
_CONFIG = f"(name IN {_in(R.DEV_CONFIG_NAMES)} OR suffix IN {_in(P.CHANGE_CONFIG_EXTENSIONS)} OR name IN {_in(P.CHANGE_CONFIG_EXTENSIONS)})"
_DEV = [
    ("dev.guard", "mass_refactor", "error", "count(DISTINCT top)", "HAVING count(DISTINCT top) >= 3"),
    ("dev.guard", "protected_path_hit", "error", "path", "WHERE protected"),
    ("dev.guard", "forbidden_file_modification", "error", "path", "WHERE denied"),
    ("dev.guard", "config_in_code", "warning", "'config'", f"HAVING bool_or({_CONFIG}) AND bool_or(suffix IN {_in(R.DEV_CODE_EXTENSIONS)})"),
    ("dev.guard", "large_commit", "warning", "count(*)", "HAVING count(*) > 12"),
    ("dev.guard", "unrelated_change", "warning", "path", "WHERE NOT (lower(path) LIKE '%widget%' OR lower(path) LIKE '%bolt%')"),
]
_SCOPE = [
    ("scope.gate", "max_files", "error", "count(*)", "HAVING count(*) > 100"), ("scope.gate", "denied", "error", "path", "WHERE denied GROUP BY path"),
    ("scope.gate", "protected", "error", "path", "WHERE protected GROUP BY path"), ("scope.gate", "outside_scope", "error", "path", "WHERE NOT allowed AND NOT denied AND NOT protected GROUP BY path"),
]
_LOCK = [("dependency.guard", "lock_not_updated", "warning", "path", "WHERE name IN ('package.json', 'requirements.txt')")]
_SECRET = [("security", "sensitive_data", "error", "path", "WHERE name = '.env' GROUP BY path")]
_all = lambda *rules: " UNION ALL ".join(_FOUND.format(*r) for r in rules)
_GATE = """WITH c AS (""" + CHANGES_SQL + """), m AS (SELECT id, CASE WHEN id % 29 = 0 THEN 'lib/pom.xml' WHEN id % 31 = 0 THEN 'lib/setup.py' WHEN id % 37 = 0 THEN 'src/requirements-dev.txt' WHEN id % 41 = 0 THEN 'lib/requirements-dev.txt' ELSE path END AS path FROM c),
    k AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, (path LIKE 'src/%' OR path LIKE 'tests/%' OR path LIKE 'docs/%.md') AS allowed,
        (regexp_extract(path, '([^/]*)$', 1) = '.env' OR path LIKE '%/models.py' OR regexp_extract(path, '([^/]*)$', 1) LIKE 'Docker%') AS protected,
        regexp_extract(path, '([^/]*)$', 1) IN ('pyproject.toml', 'package.json', 'go.mod', 'Cargo.toml', 'pom.xml') OR regexp_matches(path, '(^|/)requirements[^/]*[.]txt$') AS manifest FROM m),
    f AS (SELECT 'path.protected_modified' AS rule, 'high' AS confidence, path AS subject FROM k WHERE protected
    UNION ALL SELECT 'deps.manifest_changed_without_scope', 'high', path FROM k WHERE NOT allowed AND manifest
    UNION ALL SELECT 'scope.unlisted_file_modified', 'high', path FROM k WHERE NOT allowed AND NOT protected AND NOT manifest
    UNION ALL SELECT 'patch.binary_or_generated_file_modified', 'high', path FROM k WHERE path LIKE '%.png'
    UNION ALL SELECT 'patch.hash_mismatch', 'high', path FROM k WHERE id % 50 = 1 UNION ALL SELECT 'scope.declared_exceeds_authorized', 'high', 'lib/*'),
    s AS (SELECT *, CASE WHEN rule LIKE 'deps%' OR rule LIKE '%exceeds%' THEN 'warn' ELSE 'block' END AS severity FROM f
        UNION ALL SELECT 'patch.unverifiable_source', 'low', path, 'warn' FROM k WHERE id % 10 = 0)"""
_HEAD = f"h AS (SELECT p_partkey, {_HEADERS} AS header FROM part), x AS (SELECT *, regexp_extract(header, '^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$', 1) AS type, regexp_extract(header, '^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$', 2) AS scope, regexp_extract(header, '^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$', 3) = '!' AS breaking, regexp_extract(header, '^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$', 4) AS subject FROM h)"
ORACLES = {
    "change_categories": f"WITH {_P} SELECT path, category, is_schema, group_key, suffix, CASE WHEN suffix = '' THEN name ELSE left(name, length(name) - length(suffix)) END AS stem FROM k",
    "change_groups": f"""WITH {_P}, s AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS m FROM k) SELECT
        CASE WHEN group_key = 'tests' THEN 'test coverage' WHEN group_key = 'docs' THEN 'documentation' ELSE 'other changes' END AS label,
        count(*) AS n_files, count(*) FILTER (category = 'source') AS n_source, count(*) FILTER (category = 'test') AS n_test, count(*) FILTER (category = 'doc') AS n_doc,
        count(*) FILTER (category = 'manifest') AS n_manifest, count(*) FILTER (category = 'config') AS n_config, count(*) FILTER (category = 'other') AS n_other FROM s GROUP BY 1""",
    "change_group_files": f"WITH {_P} SELECT path, CASE WHEN group_key = 'tests' THEN 'test coverage' WHEN group_key = 'docs' THEN 'documentation' ELSE 'other changes' END AS label, category FROM k",
    "dependency_file_list": f"WITH {_P} SELECT id, path FROM k WHERE name IN ('package.json', 'requirements.txt')",
    "commit_suggestions": f"""WITH {_P}, w AS (SELECT *, CASE WHEN category = 'config' AND lower(name) IN {_in(P.CHANGE_CONFIG_EXTENSIONS)} THEN 'other' ELSE category END AS cat FROM k), a AS (SELECT cat AS category, CASE WHEN cat = 'source' THEN top ELSE '' END AS area, id FROM w)
        SELECT category, area, count(*) AS n_files, CASE category WHEN 'test' THEN 'test' WHEN 'doc' THEN 'docs' WHEN 'config' THEN 'chore' WHEN 'manifest' THEN 'chore' ELSE CASE WHEN min(id) % 3 = 0 THEN 'feat' ELSE 'fix' END END AS type FROM a GROUP BY 1, 2""",
    "budget_check": f"WITH {_P} {_all(*_BUDGET, _LINES)}",
    "dev_guard": f"WITH {_P} {_all(*_DEV)}",
    "scope_check": f"WITH {_P} {_all(*_SCOPE)}",
    "gate_findings": f"""{_GATE} SELECT rule, confidence, subject, TRUE AS evidence, severity FROM s WHERE confidence = 'high'
        UNION ALL SELECT rule, confidence, count(*) || ' files', TRUE, severity FROM s WHERE confidence = 'low' GROUP BY ALL""",
    "gate_verdict": f"""{_GATE}, w AS (SELECT 'all' AS "case", severity FROM s UNION ALL SELECT 'loose', 'warn' FROM s WHERE rule LIKE '%unlisted%')
        SELECT x AS "case", CASE WHEN bool_or(severity = 'block') THEN 'block' WHEN count(severity) > 0 THEN 'warn' ELSE 'allow' END AS verdict FROM (VALUES ('all'), ('none'), ('loose')) AS t(x) LEFT JOIN w ON w."case" = x GROUP BY 1""",
    "severity_tally": f"WITH {_P}, f AS ({_all(*_BUDGET, *_DEV, *_SCOPE, *_LOCK, *_SECRET)}) SELECT rule_set, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS passed FROM f GROUP BY 1",
    "lock_sync": f"WITH {_P} SELECT 'dependency.guard' AS rule_set, 'lock_not_updated' AS rule, 'warning' AS severity, path AS subject, CAST(NULL AS INTEGER) AS line FROM k WHERE name IN ('package.json', 'requirements.txt') AND path NOT IN (SELECT path FROM k WHERE id % 2 = 0)",
    "companion_tests": f"""WITH {_P}, s AS (SELECT *, CASE WHEN suffix = '' THEN name ELSE left(name, length(name) - length(suffix)) END AS stem FROM k),
        t AS (SELECT DISTINCT substr(stem, 6) AS stem FROM s WHERE category = 'test' AND stem LIKE 'test_%' UNION SELECT stem FROM s WHERE id % 9 = 0)
        SELECT stem IN (SELECT stem FROM t) OR (suffix = '.py' AND stem IN (SELECT stem FROM s WHERE id % 13 = 0)) AS tested, count(*) AS n FROM s WHERE category = 'source' GROUP BY 1""",
    "change_manifest": f"WITH c AS ({CHANGES_SQL}), m AS (" + " UNION ALL ".join(f"SELECT '{case}' AS c, {path} AS path FROM c WHERE {on}" for case, _, on, path in MANIFEST_CASES)
    + """), f AS (SELECT c, count(*) AS n, coalesce(bool_or(regexp_matches(path, '^test|tests/|test_')), FALSE) AS t, coalesce(bool_or(regexp_matches(path, 'docs/|README|CHANGELOG|[.]md')), FALSE) AS d,
            coalesce(bool_or(regexp_matches(path, '(^|/)cli[.]py$')), FALSE) AS cli, coalesce(bool_or(contains(path, 'mcp/')), FALSE) AS mcp, coalesce(bool_or(regexp_matches(path, 'skills/|skill[.]py|skill[.]yaml|(?i:skill.*[.]yaml$)')), FALSE) AS skill,
            coalesce(bool_or(regexp_matches(path, '(^|/)(cli[.]py|pyproject[.]toml)$|mcp/|(?i:skill.*[.]yaml$)')), FALSE) AS p FROM m GROUP BY c UNION ALL SELECT 'none', 0, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE),
        k AS (SELECT *, CASE c WHEN 'all' THEN 'feature' WHEN 'none' THEN 'fix' WHEN 'cli' THEN 'refactor' WHEN 'skill' THEN 'docs' ELSE CASE WHEN t AND NOT d THEN 'test' WHEN d AND NOT t THEN 'docs' ELSE 'feature' END END AS kind FROM f)
        SELECT c AS "case", n AS n_files, kind AS change_type, p AS public_changed, cli AS cli_changed, skill AS skill_changed, mcp AS mcp_changed, CASE WHEN n = 0 THEN 'R0' WHEN p OR n >= 5 THEN 'R2' ELSE 'R1' END AS risk,
            kind <> 'docs' AND (p OR cli OR skill OR mcp OR kind = 'feature') AS docs_due FROM k""",
    "diff_explained": f"""WITH {_P.replace(f"c AS ({CHANGES_SQL})", f"c AS (SELECT id, {_CORE} AS path, n_lines FROM ({CHANGES_SQL}) c0)")},
        w AS (SELECT *, CASE WHEN suffix = '' THEN name ELSE left(name, length(name) - length(suffix)) END AS stem FROM k), b AS (SELECT 'all' AS c, * FROM w UNION ALL SELECT 'few', * FROM w WHERE path LIKE '%package.json' AND id < 2000),
        f AS (SELECT c, count(*) AS n, sum(n_lines)::BIGINT AS l, count(DISTINCT CASE WHEN category = 'source' THEN group_key END) AS a, bool_or(category = 'manifest' AND NOT regexp_matches(name, 'lock|[.]sum$')) AND NOT bool_or(category = 'source') AS m,
            bool_or(path LIKE 'dist/%') AS g, bool_or(path LIKE 'core/%' OR path LIKE 'src/%core/%') AS o,
            bool_or(category = 'source' AND stem NOT IN (SELECT substr(stem, 6) FROM w WHERE category = 'test' AND stem LIKE 'test!_%' ESCAPE '!')) AS u FROM b GROUP BY c)
        SELECT c AS "case", n AS n_files, l AS n_lines, a AS n_areas, concat_ws(',', CASE WHEN a > 2 THEN concat('cross_module_change:', a, '_top_level_dirs') WHEN a = 2 THEN 'cross_module_change' END, CASE WHEN m THEN 'dependency_manifest_changed_without_code' END,
            CASE WHEN g THEN 'touches_protected_path' END, CASE WHEN o THEN 'core_module_touched' END, CASE WHEN u THEN 'missing_related_tests' END, CASE WHEN n > 10 THEN concat('large_changeset:', n, '_files') END, CASE WHEN l > 300 THEN concat('large_diff:', l, '_lines') END) AS hints FROM f""",
    "merge_checks": """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), f AS (SELECT k, 'working_tree_clean' AS c, 'blocker' AS l FROM p WHERE k % 3 > 0 OR (k % 7 = 0 AND s > 0) UNION ALL SELECT k, 'patch_backups_clean', 'warning' FROM p WHERE k % 5 > 0
        UNION ALL SELECT k, 'source_branch_ok', CASE WHEN k % 4 = 0 THEN 'blocker' ELSE 'warning' END FROM p WHERE k % 2 = 0 UNION ALL SELECT k, 'has_new_commits', 'warning' FROM p WHERE k % 11 = 0 OR s % 3 = 0 UNION ALL SELECT k, 'semantic_index_available', 'warning' FROM p WHERE k % 13 = 0)
        SELECT k AS repository, c AS "check", l AS level, NOT bool_or(l = 'blocker') OVER (PARTITION BY k) AS ready FROM f""",
    "change_predicates": f"""WITH c AS ({CHANGES_SQL}), m AS (SELECT id, CASE WHEN id % 7 = 0 THEN concat(path, CASE WHEN id % 2 = 0 THEN '.vue' ELSE '.mts' END) ELSE path END AS path FROM c), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM m)
        SELECT id, name IN ('Dockerfile', '.env') OR regexp_matches(name, '.[.](json|yaml|yml|toml|ini|cfg|env)$') AS is_config, regexp_matches(name, '.[.](py|ts|go|vue)$') AS is_code, regexp_matches(name, '.[.](py|ts|mts)$') AS is_reviewed, regexp_matches(name, '.[.]vue$') AS is_page,
            name = '.env' AS is_environment, regexp_matches(lower(path), 'test_|_test|/tests?/|spec[.]') AS is_test, name IN ('models.py', 'schema.py') OR name LIKE '%.sql' AS is_schema FROM n""",
    "docs_status": """WITH e(path, n) AS (VALUES ('README.md', 2), ('CONTRIBUTING.md', 0), ('CHANGELOG.md', 0), ('LICENSE', 5), ('docs/architecture.md', 0), ('docs/api.md', 3), ('docs/setup.md', 0), ('docs/development-progress.md', 0), ('docs/bug-notes.md', 0), ('docs/adr.md', 0)),
        s AS (SELECT p_partkey AS tree, path, CASE WHEN n = 0 OR p_partkey % greatest(n, 1) <> 0 THEN 'missing' WHEN p_partkey % (2 * n) = 0 OR p_size = 0 THEN 'empty' ELSE 'existing' END AS status FROM part, e)
        SELECT *, round(avg(CASE WHEN status = 'missing' THEN 0 ELSE 1 END) OVER (PARTITION BY tree), 6) AS share FROM s""",
    "review_first": f"WITH {_P} SELECT id, path, CASE WHEN is_schema THEN 0 WHEN category = 'manifest' THEN 1 WHEN category = 'source' THEN 2 WHEN category = 'test' THEN 3 WHEN category = 'config' AND name <> '.env' THEN 4 ELSE 5 END AS rank FROM k ORDER BY rank, id LIMIT 8",
    "region_paths": f"WITH {_P} SELECT CASE WHEN path LIKE 'tests/economy/%' THEN 'forbidden' WHEN path LIKE 'src/promo/%' THEN 'cautious' WHEN path LIKE 'src/%' OR path LIKE 'docs/%' THEN 'editable' ELSE 'unknown' END AS region, count(*) AS n FROM k GROUP BY 1",
    "commit_headers": f"""WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'feat: Upper' WHEN p_partkey % 17 = 0 THEN concat('fix(', repeat('s', p_partkey % 40), '): ', repeat('w', p_partkey % 90 + 1)) ELSE {_HEADERS} END AS header FROM part),
        e AS (SELECT p_partkey, regexp_extract(header, '^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$', ['type', 'scope', 'mark', 'subject']) AS x FROM h)
        SELECT p_partkey, x.type AS type, x.scope AS scope, x.mark = '!' AS breaking, x.subject AS subject, concat_ws(',', CASE WHEN x.type IN ('odd', '') THEN 'type' END, CASE WHEN x.subject = '' THEN 'subject' END,
            CASE WHEN length(x.subject) > 72 THEN 'length' END, CASE WHEN x.subject = 'Upper' THEN 'capital' END, CASE WHEN x.subject LIKE '%.' THEN 'stop' END, CASE WHEN length(x.scope) > 30 THEN 'scope' END) AS problems FROM e""",
    "commit_messages": """SELECT p_partkey, concat('feat', CASE WHEN p_partkey % 2 = 0 THEN concat('(', p_type, ')') ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '!' ELSE '' END, ': ', p_name,
        CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), chr(10), p_brand) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN concat(chr(10), chr(10), 'BREAKING CHANGE: ', p_name) ELSE '' END) AS message FROM part""",
    "release_plan": f"""WITH {_HEAD} SELECT count(*) AS n_commits, count(*) FILTER (type = 'feat') AS n_feat, bool_or(breaking) AS breaking, CASE WHEN bool_or(breaking) THEN 'major' WHEN count(*) FILTER (type = 'feat') > 0 THEN 'minor' ELSE 'patch' END AS bump, (SELECT max(concat('v0.', p_size, '.0')) FROM part) AS tag,
        CASE WHEN bool_or(breaking) THEN 'v1.0.0' WHEN count(*) FILTER (type = 'feat') > 0 THEN (SELECT concat('v0.', max_by(p_size, CAST(p_size AS VARCHAR)) + 1, '.0') FROM part) ELSE (SELECT concat('v0.', max_by(p_size, CAST(p_size AS VARCHAR)), '.1') FROM part) END AS next FROM x""",
    "diff_signals": f"""WITH {_P}, w AS (SELECT *, CASE WHEN category = 'config' AND lower(name) IN {_in(P.CHANGE_CONFIG_EXTENSIONS)} THEN 'other' ELSE category END AS cat FROM k)
        SELECT count(*) AS n_files, bool_or(cat = 'test') AS tests, bool_or(cat = 'doc') AS docs, bool_or(cat = 'manifest') AS manifests, bool_or(top = 'docs') AS guarded, count(DISTINCT CASE WHEN cat = 'source' THEN top END) AS n_areas,
        concat_ws(',', CASE WHEN count(*) > 10 THEN 'large_changeset' WHEN count(*) > 5 THEN 'multi_file_change' END, CASE WHEN bool_or(top = 'docs') THEN 'touches_protected_path' END, CASE WHEN bool_or(cat = 'manifest') THEN 'dependency_manifest_changed' END,
            CASE WHEN count(DISTINCT CASE WHEN cat = 'source' THEN top END) > 1 THEN 'cross_module_change' END) AS hints FROM w""",
    "patch_safety": f"WITH {_P} SELECT id, CASE WHEN id % 17 <> 0 AND id % 19 = 0 THEN 'skipped_dir' WHEN id % 17 = 0 THEN 'traversal' WHEN id % 23 = 0 THEN 'escape' WHEN suffix = '.png' THEN 'binary' END AS reason FROM k",
    "review_words": f"WITH {_P} SELECT id, concat_ws(',', CASE WHEN path ILIKE '%bolt%' THEN 'bolt' END, CASE WHEN path ILIKE '%red%' THEN 'red' END, CASE WHEN path ILIKE '%src%' THEN 'src' END, CASE WHEN path ILIKE '%test%' THEN 'test' END) AS words FROM k",
    "repeated_names": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "version_bumps": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'draft' ELSE concat(CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END, CASE p_partkey % 3 WHEN 0 THEN '2.0.0' WHEN 1 THEN concat('1.', p_size + 1, '.0') ELSE concat('1.', p_size, '.', p_partkey % 10 + 1) END) END AS next,
        regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AND NOT contains(p_brand, '..') AS safe FROM part""",
}
