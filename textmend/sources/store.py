"""Prediction store, integrity checks and versioned tables."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.operators import evaluate as E
from textmend.operators import slots as L
from textmend.schemas import PREDICTION, PREDICTION_KEY


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. In local mode, where the driver is the only
    executor, one is set up if the session names none; on a cluster that is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if told is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return told or context.getCheckpointDir()


_LEFT: set = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from now on; the session's part of it goes at its end."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    own = spark.sparkContext.getCheckpointDir()
    if own and own not in _LEFT:
        _LEFT.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; none if nothing is stored yet."""
    try:
        return spark.read.schema(PREDICTION).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PREDICTION)


def append_predictions(rows: DataFrame, path: str) -> None:
    """Adds rows; refuses other columns than the store's, and keys that are stored or come twice."""
    if set(rows.columns) != set(PREDICTION.names):
        raise ValueError(f"columns differ: {sorted(set(rows.columns) ^ set(PREDICTION.names))}")
    stored = load_predictions(rows.sparkSession, path).select(*PREDICTION_KEY)
    if not rows.join(stored, PREDICTION_KEY, "left_semi").isEmpty():
        raise ValueError("a key is already stored")
    if not rows.groupBy(*PREDICTION_KEY).count().where("count > 1").isEmpty():
        raise ValueError("a key comes twice")
    rows.select(*PREDICTION.names).write.mode("append").partitionBy("method", "method_version").parquet(path)


def pending(damage: DataFrame, stored: DataFrame, method: str, version: str, allow_test: bool = False) -> DataFrame:
    """Rows with slots whose key isn't stored. The test split is closed unless it's allowed."""
    todo = damage.where("k > 0")
    if not allow_test and not todo.where("split = 'test'").isEmpty():
        raise PermissionError("the test split is closed")
    done = stored.where((F.col("method") == method) & (F.col("method_version") == version)).select("id", "severity")
    return todo.join(done, ["id", "severity"], "left_anti")


ANSWER = "id string, severity string, slots_in string, raw_output string, pred_words array<string>, error string, seconds double, timestamp timestamp, failure string"


def answer_views(predict: Callable[[dict], dict]) -> Callable:
    """A function of frames of views for mapInPandas: each row's answer is made once. An exception ends the task's work; the rows
    before it are kept, and one row tells what happened."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ANSWER.split(", ")]
        for f in frames:
            out, failure = [], None
            for row in f.to_dict("records"):
                view = {"id": row["id"], "severity": row["severity"], "split": row["split"], "k": row["k"], "words": list(row["words"]), "slots": [dict(s) for s in row["slots"]]}
                began = time.perf_counter()
                try:
                    told = predict(view)
                except Exception as e:
                    failure = f"{type(e).__name__}: {e}"
                    out.append((row["id"], row["severity"], row["slots_in"], None, None, None, None, None, failure))
                    break
                took = round(time.perf_counter() - began, 3)
                words = told.get("pred_words")
                good = isinstance(words, list) and len(words) == row["k"] and all(isinstance(w, str) for w in words)
                out.append((row["id"], row["severity"], row["slots_in"], told.get("raw_output"), words if good else None, told.get("error"), took, datetime.now(timezone.utc).replace(microsecond=0), None))
            yield pd.DataFrame(out, columns=names).astype({"timestamp": "datetime64[ns, UTC]"})
            if failure:
                return

    return each


def run_method(damage: DataFrame, predict: Callable[[dict], dict], method: str, version: str, model: str, path: str, allow_test: bool = False) -> int:
    """Runs predict(view) on pending rows and stores the answers, good or bad; returns how many.

    Answers are written once, to a folder beside the store's files that readers don't see, and from there checked and
    added. So each row is asked for once (but for tasks that a lost executor makes run again). An exception in predict ends
    its task's part; all answers made are stored, then it's raised. A later run takes up what is missing."""
    spark = damage.sparkSession
    todo = checkpointed(pending(damage, load_predictions(spark, path), method, version, allow_test))  # read by the views and by each check of the answers
    views = L.build_slots(todo)
    views = views.withColumn("slots_in", L.slot_view(F.col("words"), F.col("slots")))
    staged = f"{path}/_answers-{uuid.uuid4()}"
    views.mapInPandas(answer_views(predict), ANSWER).write.parquet(staged)
    told = spark.read.schema(ANSWER).parquet(staged)
    made = store_answers(todo, told.where("failure is null").drop("failure"), method, version, model, path)
    failed = told.where("failure is not null").select("id", "severity", "failure").first()
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if failed:
        raise RuntimeError(f"{failed.failure} (row {failed.id}, {failed.severity}; {made} answers stored)")
    return made


def store_answers(todo: DataFrame, answers: DataFrame, method: str, version: str, model: str, path: str) -> int:
    rows = todo.join(answers, ["id", "severity"])
    good = E.format_ok(F.col("pred_words"), F.col("k"))
    rows = rows.select("id", "severity", "split", F.lit(method).alias("method"), F.lit(version).alias("method_version"), F.lit(model).alias("model_name"), "slots_in", "raw_output", F.when(good, F.col("pred_words")).alias("pred_words"), F.when(good, L.splice(F.col("gold_tokens"), F.col("ops_per_word"), F.col("pred_words"))).alias("spliced_text"), good.alias("format_ok"), "error", "seconds", "timestamp")
    append_predictions(rows, path)
    return answers.count()


def timing(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("method", "severity").agg(F.count("*").alias("rows"), F.avg("seconds").alias("mean_seconds"), F.sum("seconds").alias("seconds"))


def digest(df: DataFrame) -> dict:
    """Rows and two order-free sums over hashes of the rows: equal tables have equal digests."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    one = df.select(text.alias("t")).agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("t")), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.xxhash64("t").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return one.asDict()


def text_digest(content: bytes, whole: bool = False) -> str:
    """sha256 of bytes; unless whole, of a text whose line ends are \\n."""
    return hashlib.sha256(content if whole else content.replace(b"\r\n", b"\n")).hexdigest()


def file_digests(spark: SparkSession, paths: str | list[str], whole: bool = False) -> DataFrame:
    """path, length, sha256 of files of any number, read where the executors are."""
    content = F.col("content") if whole else _plain_ends(F.col("content"))
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2(content, 256).alias("sha256"))


def _plain_ends(content):
    """Binary with \\n for \\r\\n. Latin-1 maps each byte to one character and back."""
    return F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")


def rebuilt_alike(spark: SparkSession, path: str, version: str, rebuilt: DataFrame) -> bool:
    """Whether a frozen version equals the table as it's built now."""
    return digest(spark.read.schema(rebuilt.schema).parquet(f"{path}/v={version}")) == digest(rebuilt)


def freeze_pool(pool: DataFrame, path: str, version: str) -> dict:
    """Freezes a pool of sentences; returns what a checked load needs."""
    from textmend.schemas import SENTENCE

    rows = checkpointed(pool.select(*(F.col(f.name).cast(f.dataType) for f in SENTENCE)))  # read to be written and for the digest
    freeze(rows, path, version)
    return digest(rows)


def check_damage(damage: DataFrame, sentences: int, levels: int) -> DataFrame:
    """Numbers of violations, all 0 for a sound table: rows, double keys, level 0 not clean, wrong numbers of plans."""
    not_clean = (F.col("severity") == "0") & ((F.col("corrupted_text") != F.col("gold_text")) | (F.col("k") != 0))
    keys = damage.groupBy("id", "severity").agg(F.count("*").alias("n"), F.count_if(not_clean).alias("not_clean"), F.count_if(F.size("ops_per_word") != F.col("k")).alias("plans_off"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return keys.agg(F.abs(total("n") - sentences * levels).alias("rows_off"), total("not_clean").alias("not_clean"), total("plans_off").alias("plans_off"), total(F.col("n") - 1).alias("double_keys"))


def freeze(df: DataFrame, path: str, version: str) -> str:
    """Writes a version once: 'written', or 'unchanged' if the same rows are there; other rows are refused."""
    target = f"{path}/v={version}"
    try:
        old = df.sparkSession.read.schema(df.schema).parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("errorifexists").parquet(target)
        return "written"
    if digest(old) != digest(df):
        raise ValueError(f"version {version} holds other rows")
    return "unchanged"


def load_frozen(spark: SparkSession, path: str, version: str, expected: dict) -> DataFrame:
    df = spark.read.parquet(f"{path}/v={version}")
    if digest(df) != expected:
        raise ValueError(f"version {version} isn't what was frozen")
    return df


def snapshot(version: str, config: dict, name: str, rows: dict, sources: dict) -> str:
    """The settings that made a version, its digest and those of its sources, as JSON with sorted keys."""
    import json

    return json.dumps({"version": version, "data": name, "digest": rows, "sources": sources, "config": config}, sort_keys=True, indent=1, ensure_ascii=False)
