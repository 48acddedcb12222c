"""The state of requests: a log of versions, merged to the latest, resumed, changed by commands and compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.numbering import numbered

#: A row of the log: what a request's state was from a version on. result_task and result_id are what its result answers.
STATE = (
    "version long, request_id string, product_id string, task string, status string, attempts int, "
    "error struct<code:string,message:string,retryable:boolean>, result_task string, result_id string, result string"
)
COLUMNS = ["request_id", "product_id", "task", "status", "attempts", "error", "result_task", "result_id", "result"]
STATUSES = ("pending", "running", "succeeded", "failed", "excluded")
#: Ids that one row of a list of ids holds.
IDS = 1000


def latest(log: DataFrame) -> DataFrame:
    """The last version of each request of a log (STATE): one aggregation, whose tasks keep one row per request."""
    row = F.struct(*[F.col(c) for c in ["version", *COLUMNS]])
    return log.groupBy("request_id").agg(F.max_by(row, "version").alias("r")).select("r.*")


def append_versions(state: DataFrame, version: int, path: str) -> None:
    """Add rows to the log below ``path`` as one version: a folder, written by one job; writing it again replaces it."""
    state.select(F.lit(version).cast("long").alias("version"), *COLUMNS).write.mode("overwrite").parquet(f"{path.rstrip('/')}/v={version:010d}")


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(STATE).option("recursiveFileLookup", True).parquet(path)


def compact(log: DataFrame, path: str) -> None:
    """Write the latest rows of a log as a log of its own; the old one stays until its readers are done."""
    latest(log).write.mode("error").parquet(f"{path.rstrip('/')}/v=compact")


def resume_plan(asked: DataFrame, earlier: DataFrame) -> DataFrame:
    """The state (COLUMNS) in which requests (request_id, product_id, task) begin, given the latest rows of an earlier log.

    Failed and excluded ones stay so with their error, whatever was asked then; success stays if its result is of the same task
    and request, else the request is pending, as is any other. Attempts are kept, 0 if there are none. A result that fits stays with
    success and exclusion. Requests that are no longer asked for are dropped; product and task are those asked for now.
    """
    e = earlier.select("request_id", *[F.col(c).alias(f"_{c}") for c in ("status", "attempts", "error", "result_task", "result_id", "result")])
    fits = F.coalesce((F.col("_result_task") == F.col("task")) & (F.col("_result_id") == F.col("request_id")), F.lit(False))
    status = F.when(F.col("_status").isin("failed", "excluded"), F.col("_status")).when((F.col("_status") == "succeeded") & fits, "succeeded").otherwise("pending")
    x = asked.select("request_id", "product_id", "task").join(e.hint("merge"), "request_id", "left").withColumn("status", status)
    kept = fits & F.col("status").isin("succeeded", "excluded")
    return x.select(
        "request_id", "product_id", "task", "status", F.when(F.col("_attempts") >= 0, F.col("_attempts")).otherwise(0).cast("int").alias("attempts"),
        F.when(F.col("status").isin("failed", "excluded"), F.col("_error")).alias("error"), *[F.when(kept, F.col(f"_{c}")).alias(c) for c in ("result_task", "result_id", "result")],
    )


def state_transitions(state: DataFrame, commands: DataFrame) -> DataFrame:
    """State after commands (kind, target): ``retry`` a failed request, ``retry_failed`` all, ``exclude`` a product's that did not succeed.

    Exclusion comes before retry. A retried request is pending without its error; attempts stay, as does the error of an excluded one. ``error``
    and ``attempts`` are carried where state has them. Commands of one kind for one target count once.
    """
    c = commands.groupBy("target").agg(F.collect_set("kind").alias("kinds"))
    by_product = c.select(F.col("target").alias("product_id"), F.array_contains("kinds", "exclude").alias("gone"))
    by_request = c.select(F.col("target").alias("request_id"), F.array_contains("kinds", "retry").alias("again"))
    every = commands.where("kind = 'retry_failed'").limit(1).select(F.lit(True).alias("all_again"))
    s = state.join(by_product.hint("merge"), "product_id", "left").join(by_request.hint("merge"), "request_id", "left").join(F.broadcast(every), F.lit(True), "left")
    gone = F.coalesce("gone", F.lit(False)) & (F.col("status") != "succeeded")
    again = ~gone & (F.col("status") == "failed") & (F.coalesce("again", F.lit(False)) | F.coalesce("all_again", F.lit(False)))
    out = s.withColumn("_again", again).withColumn("status", F.when(gone, "excluded").when(again, "pending").otherwise(F.col("status")))
    if "error" in state.columns:
        out = out.withColumn("error", F.when(~F.col("_again"), F.col("error")))
    return out.select(*state.columns)


def task_status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_lists(state: DataFrame) -> DataFrame:
    """(status, part, request_ids): the ids of each status in order, 1,000 a row, since a list of any length is no row."""
    n = numbered(state.select("status", "request_id"), ["status"], ["request_id"])
    part = (F.floor((F.col("n") - 1) / IDS) + 1).alias("part")
    return n.groupBy("status", part).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "request_id"))), lambda x: x["request_id"]).alias("request_ids"))
