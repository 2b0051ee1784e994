"""Reviews of changes: security over diffs, the guard runner, requests to the gate, patterns in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import guards as G
from tessera.operators import rules as R
from tessera.operators import texts as X
from tessera.operators import upkeep as U
from tessera.operators.substrings import contained
from tessera.plans import changes as C
from tessera.plans import sources as S
from tessera.plans.bindings import changes
from tessera.session import table

#: Lines put to the end of TypeScript and Go files of the tree.
TYPESCRIPT_FLAW, GO_FLAW = "x = eval(code)", 'k := "sk-abcdefghijklmnopqrstuv"'


def _lines(spark: SparkSession, d: str) -> DataFrame:
    tree = S.tree(spark, d)
    flaw = F.when(F.col("language") == "typescript", TYPESCRIPT_FLAW).when(F.col("language") == "go", GO_FLAW).otherwise("")
    return X.lines(tree.filter("language IN ('python', 'typescript', 'go')").select("path", F.concat("text", flaw).alias("text")), "path")


def _added(spark: SparkSession, d: str) -> DataFrame:
    """Lines 4 and 7 of every second script of the tree, by a diff of a file of its name in another folder."""
    k = F.col("p_partkey")
    return table(spark, d, "part").filter(k % 32 == 15).select(F.concat(F.lit("other/s"), k, F.lit(".py")).alias("file"), F.explode(F.array(F.lit(4), F.lit(7))).alias("line"))


def security_diffs(spark: SparkSession, d: str) -> DataFrame:
    """RUL-10: findings on added lines where a diff has some of a file, else on all of it, in files of three languages."""
    return R.security_review(_lines(spark, d), changes(spark, d), _added(spark, d)).select("rule", "severity", "subject", "line")


def _guards(spark: SparkSession, d: str) -> tuple[dict, dict]:
    """What makes the findings of each guard, and the same with a guard whose data is broken."""
    diffs, rows = S._diffs(spark, d), changes(spark, d)
    made = {
        "change.budget": lambda: R.budget(rows, max_lines=5000),
        "dev.guard": lambda: R.development(rows.withColumn("path", F.when(F.col("path") != "", F.col("path")).otherwise(F.raise_error(F.lit("no path")))), C.PROTECTED, C.DENIED, C.TASK),
        "dependency.guard": lambda: R.dependency_findings(U.manifest_status(diffs), U.manifest_changes(diffs)),
        "security.review": lambda: R.security_review(_lines(spark, d), rows, _added(spark, d)),
        "diff.explain": lambda: R.companions(rows.select("no_such_column")),
    }
    broken = made | {"change.budget": lambda: R.budget(rows.withColumn("n_lines", F.raise_error(F.concat(F.lit("broken at "), "path")).cast("int")), max_lines=5000)}
    return made, broken


def guard_report(spark: SparkSession, d: str) -> DataFrame:
    """RUL-29, AGG-16: reports of two runs: one with a guard left out and one that asks for a column that isn't there, and one in which
    the data of a guard is broken."""
    made, broken = _guards(spark, d)
    report = G.run(spark, made, ["change.budget", "dev.guard", "dependency.guard", "diff.explain"])[0].unionAll(G.run(spark, broken, ["change.budget", "security.review"])[0])
    return report.select("position", "guard", "state", "errors", "warnings", "infos", F.col("error").isNotNull().alias("has_error"))


def guard_findings(spark: SparkSession, d: str) -> DataFrame:
    """RUL-29: findings of all guards of a run in which one fails."""
    return G.run(spark, _guards(spark, d)[0])[1].groupBy("guard", "rule_set", "rule", "severity").agg(F.count("*").alias("n"))


def gate_requests(spark: SparkSession, d: str) -> DataFrame:
    """RUL-14: facts about requests, one for each part, of which many are malformed or have no authority."""
    k = F.col("p_partkey")
    version = F.when(k % 7 == 0, "").when(k % 7 == 1, "2020-01-01.v0").otherwise(R.CONTRACT)
    scope = F.when(k % 5 == 0, "[]").otherwise('{"allowed_paths": ["src/"]}')
    change = F.when(k % 11 == 0, "3").when(k % 11 == 1, '{"changed_files": {}}').when(k % 11 == 2, '{"patch_id": "p", "diff": "d", "changed_files": []}').otherwise('{"changed_files": []}')
    run = F.when(k % 4 == 0, "../x").otherwise(F.concat(F.lit("run-"), k % 6))
    text = F.concat(F.lit('{"contract_version": "'), version, F.lit('", "task_scope": '), scope, F.lit(', "change": '), change, F.lit(', "run_id": "'), run, F.lit('"}'))
    requests = table(spark, d, "part").select(k.alias("request_id"), F.when(k % 13 == 0, "[1]").when(k % 17 == 0, "{").otherwise(text).alias("request"))
    authorities = spark.range(6).select(F.concat(F.lit("run-"), "id").alias("run_id"), F.when(F.col("id") == 0, "nothing").when(F.col("id") == 1, "[]").when(F.col("id") < 5, '{"allowed_paths": []}').alias("scope"))
    return R.request_facts(requests, authorities).select("request_id", "rule", "subject")


def item_openings(spark: SparkSession, d: str) -> DataFrame:
    """JOI-17: in how many documents the first three words of each benchmark item occur, as they are, in any place."""
    items = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("pattern"))
    met = contained(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", items.select("pattern").distinct())
    return items.join(met.groupBy("pattern").agg(F.count("*").alias("n")), "pattern", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


QUERIES = {f.__name__: f for f in (security_diffs, guard_report, guard_findings, gate_requests, item_openings)}
_SCRIPTS = f"""WITH {S._K}, s AS (SELECT rule, severity, path AS subject, line FROM k, (VALUES {', '.join(map(str, S._FLAWS))}) AS f(rule, severity, line) WHERE k % 16 = 15 AND (k % 32 <> 15 OR line IN (4, 7))
    UNION ALL SELECT 'eval_exec', 'error', path, 10 FROM k WHERE k % 4 = 1 UNION ALL SELECT 'sensitive_data', 'error', path, 15 FROM k WHERE k % 4 = 2
    UNION ALL SELECT DISTINCT 'sensitive_data', 'error', path, CAST(NULL AS INTEGER) FROM ({C.CHANGES_SQL}) c WHERE regexp_matches(path, '(^|/)[.]env$'))"""
_COUNTS = "count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i"
_RUNS = f"""b AS (SELECT {_COUNTS} FROM ({C.ORACLES["budget_check"]})), v AS (SELECT {_COUNTS} FROM ({C.ORACLES["dev_guard"]})), x AS (SELECT {_COUNTS} FROM (SELECT severity FROM ({S.ORACLES["dependency_changes"]}) t, range(n))),
    r AS (SELECT {_COUNTS} FROM ({_SCRIPTS} SELECT * FROM s)),
    a AS (SELECT 0 AS position, 'change.budget' AS guard, * FROM b UNION ALL SELECT 1, 'dev.guard', * FROM v UNION ALL SELECT 2, 'dependency.guard', * FROM x),
    o AS (SELECT *, CASE WHEN e > 0 THEN 'blocked' ELSE 'passed' END AS state FROM a)"""
ORACLES = {
    "security_diffs": f"{_SCRIPTS} SELECT rule, severity, subject, line FROM s",
    "guard_report": f"""WITH {_RUNS}, one AS (SELECT position, guard, state, e, w, i, FALSE AS h FROM o UNION ALL SELECT 3, 'security.review', 'skipped', 0, 0, 0, FALSE UNION ALL SELECT 4, 'diff.explain', 'failed', 0, 0, 0, TRUE
            UNION ALL SELECT 5, 'all', 'blocked', 1 + count(*) FILTER (e > 0), sum(w)::BIGINT, sum(i)::BIGINT, FALSE FROM o),
        two AS (SELECT 0 AS position, 'change.budget' AS guard, 'failed' AS state, 0 AS e, 0 AS w, 0 AS i, TRUE AS h UNION ALL SELECT 3, 'security.review', CASE WHEN e > 0 THEN 'blocked' ELSE 'passed' END, e, w, i, FALSE FROM r
            UNION ALL SELECT p, g, 'skipped', 0, 0, 0, FALSE FROM (VALUES (1, 'dev.guard'), (2, 'dependency.guard'), (4, 'diff.explain')) AS t(p, g) UNION ALL SELECT 5, 'all', 'blocked', 1 + (e > 0)::INT, w, i, FALSE FROM r)
        SELECT position, guard, state, e AS errors, w AS warnings, i AS infos, h AS has_error FROM one UNION ALL SELECT * FROM two""",
    "guard_findings": f"""SELECT 'change.budget' AS guard, rule_set, rule, severity, count(*) AS n FROM ({C.ORACLES["budget_check"]}) GROUP BY ALL UNION ALL SELECT 'dev.guard', rule_set, rule, severity, count(*) FROM ({C.ORACLES["dev_guard"]}) GROUP BY ALL
        UNION ALL SELECT 'dependency.guard', 'dependency.guard', rule, severity, n FROM ({S.ORACLES["dependency_changes"]}) UNION ALL SELECT 'security.review', 'security', rule, severity, count(*) FROM ({_SCRIPTS} SELECT * FROM s) GROUP BY ALL""",
    "gate_requests": """WITH r AS (SELECT p_partkey AS k FROM part), x AS (SELECT k, 'gate.malformed_request' AS rule, 'request_not_object' AS subject FROM r WHERE k % 13 = 0 OR k % 17 = 0
        UNION ALL SELECT k, CASE k % 7 WHEN 0 THEN 'gate.contract_version_missing' ELSE 'gate.contract_version_unsupported' END, '' FROM r WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 7 < 2),
        g AS (SELECT * FROM r WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 7 > 1)
        SELECT k AS request_id, rule, subject FROM x UNION ALL SELECT k, 'gate.malformed_request', 'task_scope_not_object' FROM g WHERE k % 5 = 0 UNION ALL SELECT k, 'gate.malformed_request', 'change_not_object' FROM g WHERE k % 11 = 0
        UNION ALL SELECT k, 'gate.malformed_request', 'change.changed_files_missing_or_not_array' FROM g WHERE k % 11 = 1 UNION ALL SELECT k, 'scope.authority_unverified', '' FROM g WHERE k % 4 = 0 OR k % 6 IN (0, 1, 5)
        UNION ALL SELECT k, 'gate.diff_ignored_patch_id_present', '' FROM g WHERE k % 11 = 2""",
    "item_openings": "WITH b AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS p FROM benchmark) SELECT item_id, count(doc_id) AS n_documents FROM b LEFT JOIN documents ON contains(text, p) GROUP BY 1",
}
