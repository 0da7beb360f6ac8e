"""Scans that can be resumed: scores, states and the cursor of a run become visible together.

A run writes its scores and the states of its series under its number, and then one small commit row. Whoever
reads looks at commit rows first, so a run that failed on the way has never been; the next one takes its
number and overwrites what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.recurrences import joined, recurrence_scan
from skylattice.operators.revisions import latest_publication


def _commits(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(run, cursor) of the committed runs, in order: one row a run."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return []
    rows = spark.read.schema("run bigint, cursor bigint").option("recursiveFileLookup", "true").parquet(f"{path}/commits").collect()
    return sorted((r["run"], r["cursor"]) for r in rows)


def _commit(spark: SparkSession, path: str, run: int, cursor: int) -> None:
    """The last step of a run; a folder whose writing has not finished holds no file."""
    spark.createDataFrame([(run, cursor)], "run bigint, cursor bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{run}")


def scan_run(readouts: DataFrame, keys: list[str], at: str, number: str, value: str, path: str, snapshot: int, threshold: float = 4.5) -> int:
    """One run over what was published after the cursor and up to ``snapshot``; returns its number.

    Of the publications of an instant the latest up to the snapshot counts. A series whose fresh instants all lie
    after its state goes on from there; one that has been revised further back is folded again from its start, but
    only fresh rows are scored anew. A run that finds nothing fresh moves the cursor alone.
    """
    spark = readouts.sparkSession
    done = _commits(spark, path)
    run, cursor = (done[-1][0] + 1, done[-1][1]) if done else (0, -1)
    rows = latest_publication(readouts, [*keys, at], number, snapshot).select(*keys, at, number, value)
    fresh = rows.where(F.col(number) > cursor).groupBy(*keys).agg(F.min(at).alias("_first"))
    kept = None
    if done:
        old = spark.read.parquet(f"{path}/states/{done[-1][0]}")
        known = joined(fresh, old.select(*keys, "last"), keys, "left")
        again = known.withColumn("_again", F.coalesce(F.col("_first") <= F.col("last"), F.lit(False))).select(*keys, "_again")
        rows = joined(rows, again, keys).where(F.col("_again") | (F.col(number) > cursor)).drop("_again")
        states = joined(old, again, keys, "left")
        going_on = states.where("NOT _again").drop("_again")
        kept = states.where("_again IS NULL").drop("_again")
    else:
        going_on = None
    scores, ends = recurrence_scan(rows, keys, at, value, going_on)
    scores.where(F.col(number) > cursor).withColumn("candidate", F.col("score") >= threshold).write.mode("overwrite").parquet(f"{path}/scores/{run}")
    (ends if kept is None else ends.unionByName(kept.select(*ends.columns))).write.mode("overwrite").parquet(f"{path}/states/{run}")
    _commit(spark, path, run, snapshot)
    return run


def committed_scores(spark: SparkSession, path: str) -> DataFrame:
    """The scores of all committed runs, with their run."""
    out = None
    for run, _ in _commits(spark, path):
        scores = spark.read.parquet(f"{path}/scores/{run}").withColumn("run", F.lit(run).cast("bigint"))
        out = scores if out is None else out.unionByName(scores)
    if out is None:
        raise ValueError(f"no run has been committed in {path}")
    return out
