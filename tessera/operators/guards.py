"""The guard runner: rule sets in a fixed order, each on its own, and one report of them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.sources.store import written

# Guards in the order in which they run.
ORDER = ["change.budget", "dev.guard", "dependency.guard", "security.review", "diff.explain"]
REPORT = "position int, guard string, state string, errors long, warnings long, infos long, error string"


def run(spark: SparkSession, guards: dict[str, Callable[[], DataFrame]], select: list[str] | None = None, order: list[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """RUL-29, AGG-16: a report and the findings of guards, by name: what makes the findings of each.

    Guards run in the order given, only those in select if there is one. The findings of each are written to the shared folder and
    counted on the way, so a guard whose data is broken, when it is planned or when it is read, fails alone: its state is failed and
    its error is told, and the others' findings stand. States: passed, blocked (it has errors), failed, skipped. The last row of
    the report is that of all guards: passed only if each that ran passed; its errors are the guards that didn't, warnings and infos are
    summed up. A name in select that isn't in the order is no guard: nothing runs, and the report says so.
    """
    chosen = order if select is None else select
    if unknown := [name for name in chosen if name not in order]:
        row = (len(order), "all", "failed", 1, 0, 0, f"no such guard: {', '.join(unknown)}")
        return spark.createDataFrame([row], REPORT), spark.createDataFrame([], R.FINDING)
    report, found = [], []
    for position, name in enumerate(order):
        if name not in chosen:
            report.append((position, name, "skipped", 0, 0, 0, None))
            continue
        seen = Observation()
        n = lambda s: F.count_if(F.col("severity") == s)
        try:
            findings = guards[name]().observe(seen, n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
            found.append(written(findings, "findings").withColumn("guard", F.lit(name)))
            told = seen.get
            report.append((position, name, "blocked" if told["errors"] else "passed", told["errors"], told["warnings"], told["infos"], None))
        except (PySparkException, KeyError) as error:
            report.append((position, name, "failed", 0, 0, 0, f"{type(error).__name__}: {error}".split("\n")[0][:200]))
    lost = sum(r[2] in ("blocked", "failed") for r in report)
    report.append((len(order), "all", "blocked" if lost else "passed", lost, sum(r[4] for r in report), sum(r[5] for r in report), None))
    none = spark.createDataFrame([], f"{R.FINDING}, guard string")
    return spark.createDataFrame(report, REPORT), R.together(none, *found)
