"""Runs in a folder: passes over requests that can be stopped at any time and taken up again.

A pass is a table of requests to send.  A stream reads it some files at a time
and writes each micro-batch's attempts to a folder named by its number, so a
batch that is repeated after a crash replaces itself: no answer is in the log
twice, and none that was committed is asked for again.  Failures that may pass
become the next pass's requests, with their attempt and the earliest time at
which they may be sent; the driver waits for it, tasks never do.  What makes
two runs one is kept beside the attempts and another configuration is refused.

    config       what the run is                requests   of all items and conditions
    passes/p=N   requests of a pass             attempts/p=N/b=M   what came of them
    responses    a line for each request        summary    counts; there once a run has ended

An answer counts for all requests with its payload hash; failures are never
taken for answers, so a later run asks again.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import sized
from ..sources import tables
from . import runner

#: Further attempts after a transient failure: a fixed value.
RETRIES = 2
#: Seconds up to which the wait doubles from pass to pass: a fixed value.
LONGEST = 8
#: Requests of a file; a micro-batch takes as many files as tasks run at a time.
BATCH = 1000

PASS = "item_id string, condition string, model_label string, payload_hash string, attempt int, candidate_ids array<string>, user string, system string"
LOGGED = runner.ATTEMPT + ", at double, p int"


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local master without that setting, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomscore-")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def attempts(spark: SparkSession, out: str) -> DataFrame:
    """All attempts of the run so far, ``p`` the pass of each."""
    path = f"{out}/attempts"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], LOGGED)
    return spark.read.schema(LOGGED + ", b int").json(path).drop("b")


def latest(log: DataFrame) -> DataFrame:
    """Of each payload its answer, the last if there are several; else its last failure."""
    answered = (F.col("outcome") == "answered") & F.col("raw_text").isNotNull()
    rank = F.when(answered, F.col("p").cast("long")).otherwise(F.col("p") - F.lit(1 << 40))
    body = F.struct(*(c for c in log.columns if c != "payload_hash"))
    return log.groupBy("payload_hash").agg(F.max_by(body, F.struct(rank, "attempt")).alias("r")).select("payload_hash", "r.*")


def written_passes(spark: SparkSession, out: str) -> int:
    """How many passes are written in full."""
    n = 0
    while tables.exists(spark, f"{out}/passes/p={n}/_SUCCESS"):
        n += 1
    return n


def write_pass(rows: DataFrame, out: str, p: int, batch: int) -> None:
    names = [c.split()[0] for c in PASS.split(", ")]
    rows.select(*names).write.mode("overwrite").option("maxRecordsPerFile", batch).json(f"{out}/passes/p={p}")


def drain(spark: SparkSession, out: str, p: int, adapter: runner.Adapter) -> None:
    """Send what is left of a pass."""

    def sink(rows: DataFrame, number: int) -> None:
        tried = runner.attempted(rows, adapter).withColumn("at", F.unix_micros(F.current_timestamp()) / 1e6)
        tried.write.mode("overwrite").json(f"{out}/attempts/p={p}/b={number}")

    files = spark.readStream.schema(PASS).option("maxFilesPerTrigger", spark.sparkContext.defaultParallelism).json(f"{out}/passes/p={p}")
    query = files.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoints/p={p}").trigger(availableNow=True).start()
    query.awaitTermination()


def settle(spark: SparkSession, asked: DataFrame, adapter: runner.Adapter, out: str, identity: Mapping, cache: DataFrame | None = None, retries: int = RETRIES, batch: int = BATCH, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, good: Column | None = None) -> dict:
    """Send ``asked`` (as ``runner.requests`` makes them) until each is answered or has failed for good; the summary's counts.

    ``good``: of an attempt's columns, which answers a later run doesn't ask for again; by default all with a text.
    """
    if tables.exists(spark, f"{out}/config"):
        runner.same_run(tables.read_document(spark, f"{out}/config"), identity)
    else:
        tables.write_document(spark, dict(identity), f"{out}/config")
    asked.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/requests")
    asked = spark.read.schema(asked.schema).json(f"{out}/requests")
    body = F.struct(*(c for c in asked.columns if c != "payload_hash"))
    senders = asked.groupBy("payload_hash").agg(F.min_by(body, "position_key").alias("r")).select("payload_hash", "r.*")
    answered = F.col("raw_text").isNotNull()
    known = None
    if cache is not None:
        said = [F.col(c) if c in cache.columns else F.lit(None).cast(k).alias(c) for c, k in runner.SAID.items()]
        known = cache.filter(answered).select("payload_hash", *said, F.lit("answered").alias("outcome"), F.lit(0).alias("attempt"), F.lit(-1).alias("p"))

    def state() -> DataFrame:
        log = attempts(spark, out)
        return latest(log.unionByName(known, allowMissingColumns=True) if known is not None else log)

    p = written_passes(spark, out) - 1
    if p >= 0:
        drain(spark, out, p, adapter)  # of a run that was stopped; nothing where it had ended
    fresh = p < 0 or tables.exists(spark, f"{out}/summary")
    first = p + 1 if fresh else 0
    if fresh:
        left = senders.join(state().filter(answered if good is None else answered & good).select("payload_hash"), "payload_hash", "left_anti")
        if not left.isEmpty():
            p += 1
            write_pass(left.withColumn("attempt", F.lit(0)), out, p, batch)
        tables.remove(spark, f"{out}/summary")
        if p == first:
            drain(spark, out, p, adapter)
    pause = F.greatest(F.least(F.pow(F.lit(2.0), F.col("attempt") + 1), F.lit(float(LONGEST))), F.coalesce("retry_after", F.lit(0.0)))
    while True:
        again = state().filter((F.col("outcome") == "transient") & (F.col("attempt") < retries)).select("payload_hash", "attempt", (F.col("at") + pause).alias("not_before"))
        earliest = again.agg(F.min("not_before")).first()[0]
        if earliest is None:
            break
        if (left := earliest - clock()) > 0:
            wait(left)
        due = again.filter(F.col("not_before") <= max(clock(), earliest)).select("payload_hash", (F.col("attempt") + 1).alias("attempt"))
        p += 1
        write_pass(senders.join(sized(due), "payload_hash"), out, p, batch)
        drain(spark, out, p, adapter)
    own = senders.select("payload_hash", F.col("position_key").alias("sender"))
    lines = asked.join(own, "payload_hash").join(state().drop("item_id", "condition", "model_label"), "payload_hash", "left")
    old = F.coalesce(answered & ((F.col("p") < first) | (F.col("position_key") != F.col("sender"))), F.lit(False))
    ordinal = F.conv(F.substring("position_key", 1, 15), 16, 10).cast("long")
    lines.select("item_id", "condition", "model_label", "payload_hash", *runner.answer_columns(), old.alias("from_cache"), ordinal.alias("ordinal")).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/responses")
    counts = runner.run_summary(spark.read.schema("status string, from_cache boolean, error string").json(f"{out}/responses")).first().asDict()
    tables.write_document(spark, counts, f"{out}/summary")
    return counts


def run_folder(spark: SparkSession, items: DataFrame, conditions: tuple[str, ...], adapter: runner.Adapter, prompt: Mapping, config: Mapping, out: str, qa_prompt: Mapping | None = None, seed: int = 0, digests: Mapping | None = None, **options: object) -> dict:
    """``settle`` over items and conditions; ``digests``: of the files that the items and the prompt came from."""
    asked = runner.requests(runner.strip_gold(items), conditions, prompt, config, qa_prompt, seed)
    identity = {**config, "prompt_version": prompt["version"], "conditions": list(conditions), "order_seed": seed, **(digests or {})}
    return settle(spark, asked, adapter, out, identity, **options)
