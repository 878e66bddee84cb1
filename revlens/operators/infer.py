"""Batch model calls: one client per worker and model, errors kept as data.

Every model has a factory of its own, so one job can ask quite different clients. A
client is built when its worker first needs it and kept for the tasks that follow in
that process, the ``KEPT`` last used at most. A client with ``ask_all`` gets all its
requests of an Arrow batch at once, the others get them one by one, side by side.

The result is a call log. Calls cost money and may answer differently when
repeated, so the log is written before anything reads it, in chunks of bounded
size (:func:`infer_to_log`): a lost task repeats the calls of one chunk at most.
A rerun asks only for what the log lacks (:func:`pending`), as a further attempt,
and readers take one row per call key (:func:`latest_calls`).
"""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas
from revlens.session import discard, materialise
from revlens.sources.catalog import MODELS, TASK_BY_NAME, UNSUPPORTED, Model

Client = Callable[[dict], tuple[str, int | None]]
Factory = Callable[[str, str, int], Client]
_LOG_COLUMNS = [c.strip().split(" ")[0] for c in schemas.CALL_LOG.split(",")]
_ASKED = _LOG_COLUMNS[: _LOG_COLUMNS.index("raw_output")]


#: Into how many files the requests of a commit are written, where a task has that many.
FILES_PER_COMMIT = 16
#: So many reviews at most are told to all tasks by their digest.
OPEN_REVIEWS = 2_000_000


def _ask(client: Client | str, request: dict) -> dict:
    """One call as a log row; ``client`` is the message where there is none."""
    row = {c: request.get(c) for c in _ASKED}
    row |= {"raw_output": None, "completion_tokens": None, "elapsed_s": 0.0, "error": None}
    if isinstance(client, str):
        return row | {"error": client}
    start = time.monotonic()
    try:
        text, reported = client(request)
    except Exception as exc:  # noqa: BLE001 - any failure becomes a row
        return row | {"error": str(exc) or type(exc).__name__}
    elapsed = time.monotonic() - start
    return row | {"raw_output": text, "completion_tokens": reported, "elapsed_s": elapsed}


#: Clients of this process by (run, model), the last used at the end.
_CLIENTS: OrderedDict[tuple[str, str], Client] = OrderedDict()
KEPT = 32


def kept_client(run_id: str, model: str, build: Callable[[], Client]) -> Client:
    """The process's client of a model. A client that makes room is closed, if it can be."""
    key = (run_id, model)
    if key not in _CLIENTS:
        _CLIENTS[key] = build()
        while len(_CLIENTS) > KEPT:
            _, old = _CLIENTS.popitem(last=False)
            getattr(old, "close", lambda: None)()
    _CLIENTS.move_to_end(key)
    return _CLIENTS[key]


def _ask_all(client: Client, requests: list[dict]) -> list[dict]:
    """Calls answered together; each one's time is an equal part of the whole."""
    rows = [{c: r.get(c) for c in _ASKED} for r in requests]
    start = time.monotonic()
    try:
        answers = client.ask_all(requests)
        if len(answers) != len(requests):
            raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
    except Exception as exc:  # noqa: BLE001 - any failure becomes the rows'
        failed = {"raw_output": None, "completion_tokens": None, "elapsed_s": 0.0, "error": str(exc) or type(exc).__name__}
        return [row | failed for row in rows]
    each = (time.monotonic() - start) / len(requests)
    return [
        row | {"raw_output": text, "completion_tokens": n, "elapsed_s": each, "error": None}
        for row, (text, n) in zip(rows, answers, strict=True)
    ]


def _run_partition(
    factories: Mapping[str, Factory],
    task: str,
    budget: int,
    pace: Mapping[str, float],
    shares: int,
    at_once: int,
    run_id: str = "",
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``pace``: seconds between any two calls to a model; each of the ``shares``
    partitions takes every shares-th slot, beginning with its own."""

    def client_of(model: str | None) -> Client | str:
        if model not in factories:
            return UNSUPPORTED
        try:
            return kept_client(run_id, model, partial(factories[model], model, task, budget))
        except Exception as exc:  # noqa: BLE001 - a missing key is an error of its rows
            return str(exc) or type(exc).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str | None, Client | str] = {}
        context = TaskContext.get()
        turn = context.partitionId() % shares if context else 0
        began, slots = time.monotonic(), dict.fromkeys(pace, turn)
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                requests = batch.astype(object).where(batch.notna(), None).to_dict("records")
                asked, together = [], {}
                for i, request in enumerate(requests):
                    model = request["model"]
                    if model not in clients:
                        clients[model] = client_of(model)
                    request |= {"task": task}
                    if model in pace:
                        time.sleep(max(0.0, began + slots[model] * pace[model] - time.monotonic()))
                        slots[model] += shares
                    elif hasattr(clients[model], "ask_all"):
                        together.setdefault(model, []).append(i)
                        continue
                    asked.append((i, pool.submit(partial(_ask, clients[model], request))))
                rows: list[dict] = [{}] * len(requests)
                for model, places in together.items():
                    answers = _ask_all(clients[model], [requests[i] for i in places])
                    for i, row in zip(places, answers, strict=True):
                        rows[i] = row
                for i, future in asked:
                    rows[i] = future.result()
                frame = pd.DataFrame(rows, columns=_LOG_COLUMNS)
                frame["completion_tokens"] = frame["completion_tokens"].astype("Int64")
                yield frame

    return run


def batch_infer(
    reqs: DataFrame,
    task: str,
    factories: Mapping[str, Factory],
    models: tuple[Model, ...] = MODELS,
    paced_partitions: int = 4,
    at_once: int = 8,
) -> DataFrame:
    """Run every request through its model's client; lazily, as a DataFrame.

    ``at_once`` calls of a partition are under way at a time. Models with a pace go
    to ``paced_partitions`` partitions whose slots interleave, so that the summed
    rate holds from the first call on, however many rows there are. The clock of a
    call starts after the wait. A request without a model is answered by an error.
    """
    paced = {m.model: m.pace_seconds for m in models if m.pace_seconds > 0}
    budget = TASK_BY_NAME[task].max_tokens
    run = partial(_run_partition, dict(factories), task, budget, run_id=uuid.uuid4().hex)
    if "attempt" not in reqs.columns:
        reqs = reqs.withColumn("attempt", F.lit(1))
    is_paced = F.coalesce(F.col("model").isin(*paced), F.lit(False)) if paced else F.lit(False)
    free = reqs.filter(~is_paced).mapInPandas(run({}, 1, at_once), schemas.CALL_LOG)
    if not paced:
        return free
    slow = (
        reqs.filter(is_paced)
        .repartition(paced_partitions, "review_id")
        .mapInPandas(run(paced, paced_partitions, at_once), schemas.CALL_LOG)
    )
    return free.unionByName(slow)


def log_calls(calls: DataFrame, name: str = "calls") -> DataFrame:
    """Write the log once and read it back. Calls are written as they come, so that the
    requests of one review, which repeat its prompt, stay side by side and compress to about
    one; a folder for each model would have every task sort its calls, prompts and all, and
    keep the prompt once for each."""
    return materialise(calls, name).select(*_LOG_COLUMNS)


def append_log(calls: DataFrame, path: str) -> None:
    writer = calls.write.mode("append").partitionBy("task", "model")
    writer.option("compression", "zstd").parquet(path)  # prompts are most of it


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CALL_LOG).parquet(path)


def latest_calls(log: DataFrame) -> DataFrame:
    """One row per call key: a finished call before a failed one, then the latest
    attempt. A partial aggregate, so a key tried often costs no window. The prompt, by far
    the longest column, is chosen beside the others: who does not use it does not move it."""
    rest = [c for c in _LOG_COLUMNS if c not in (*schemas.CALL_KEYS, "prompt")]
    rank = F.struct(F.col("error").isNull().alias("_done"), "attempt", *[c for c in rest if c != "attempt"])
    best = log.groupBy(*schemas.CALL_KEYS).agg(
        F.max(rank).alias("_best"), F.max_by("prompt", rank).alias("prompt")
    )
    kept = (*schemas.CALL_KEYS, "prompt")
    return best.select(*[F.col(c if c in kept else f"_best.{c}").alias(c) for c in _LOG_COLUMNS])


def _same(a: str, b: str, columns: tuple[str, ...]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


#: What the requests of all models to one review agree in.
_REVIEW = tuple(c for c in schemas.CALL_KEYS if c != "model")


def pending(reqs: DataFrame, log: DataFrame) -> DataFrame:
    """Requests without a finished call, with the number of their next attempt. The log
    is gathered by review, so that the requests of one review, which repeat its text, stay
    side by side."""
    tried = log.groupBy(*schemas.CALL_KEYS).agg(
        F.max("attempt").alias("tried"), F.max(F.col("error").isNull()).alias("done")
    )
    by_review = tried.groupBy(*_REVIEW).agg(F.collect_list(F.struct("model", "tried", "done")).alias("_tried"))
    left = reqs.drop("attempt").alias("r").join(by_review.alias("l"), _same("r", "l", _REVIEW), "left")
    own = F.get(F.filter("l._tried", lambda t: t["model"].eqNullSafe(F.col("r.model"))), F.lit(0))
    left = left.select("r.*", own.alias("_own"))
    return left.filter(~F.coalesce("_own.done", F.lit(False))).select(
        *[c for c in left.columns if c != "_own"], (F.coalesce("_own.tried", F.lit(0)) + 1).alias("attempt")
    )


def _of_open_reviews(reqs: DataFrame, log: DataFrame) -> DataFrame:
    """The requests of reviews of which a call is missing, and perhaps a few others: the texts
    of finished reviews are then not moved to find that out."""
    done = log.filter(F.col("error").isNull()).select(*schemas.CALL_KEYS).distinct()
    left = reqs.select(*schemas.CALL_KEYS).alias("r").join(done.alias("l"), _same("r", "l", schemas.CALL_KEYS), "left_anti")
    review = F.xxhash64(*_REVIEW).alias("_review")
    left = materialise(left.select(review).distinct(), "open-reviews")
    if left.count() > OPEN_REVIEWS:
        return reqs
    return reqs.withColumn("_review", review).join(F.broadcast(left), "_review", "left_semi").drop("_review")


def _commits(due: DataFrame, calls: int) -> list[list[str]]:
    """The files of ``due`` in groups of about so many calls each."""
    counted = due.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    groups, n = [], calls
    for file, rows in sorted((unquote(r.file), r.n) for r in counted.collect()):
        if n >= calls:
            groups.append([])
            n = 0
        groups[-1].append(file)
        n += rows
    return groups


def infer_to_log(
    reqs: DataFrame,
    path: str,
    task: str,
    factories: Mapping[str, Factory],
    models: tuple[Model, ...] = MODELS,
    calls_per_commit: int = 100_000,
    **how,
) -> DataFrame:
    """Ask what the log at ``path`` lacks, committing about ``calls_per_commit`` calls
    at a time, and return the latest calls. Speculative tasks would pay twice."""
    spark = reqs.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise RuntimeError("paid calls need spark.speculation=false")
    append_log(spark.createDataFrame([], schemas.CALL_LOG), path)
    log = read_log(spark, path)
    due = reqs.withColumn("attempt", F.lit(1)) if log.isEmpty() else pending(_of_open_reviews(reqs, log), log)
    # written as it comes, the requests of a review side by side, in files that commits share out
    due = materialise(due, "due-calls", rows_per_file=max(1, calls_per_commit // FILES_PER_COMMIT))
    for files in _commits(due, calls_per_commit):
        asked = spark.read.schema(due.schema).parquet(*files)
        append_log(batch_infer(asked, task, factories, models, **how), path)
    discard(due)
    return latest_calls(read_log(spark, path))
