"""Answers of a model, asked for once: a log that tasks write batch by batch."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of the log by the prompts' hashes, and prompts that are asked for together.
BUCKETS, BATCH = 64, 16


def _store(folder: str):
    from pyarrow.fs import FileSystem

    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return FileSystem.from_uri(uri)


def _log(folder: str, bucket: int):
    """File system, path and known answers of a part of the log; files that are being written are hidden."""
    from pyarrow.fs import FileSelector

    fs, top = _store(folder)
    place = f"{top}/bucket={bucket:04d}"
    fs.create_dir(place, recursive=True)
    known: dict[str, str] = {}
    for entry in sorted(fs.get_file_info(FileSelector(place)), key=lambda e: e.path):
        if entry.path.endswith(".parquet") and not entry.base_name.startswith("."):
            with fs.open_input_file(entry.path) as f:
                rows = pq.read_table(f).to_pydict()
            for h, answer in zip(rows["prompt_hash"], rows["response"], strict=True):
                known.setdefault(h, answer)
    return fs, place, known


def answered(prompts: DataFrame, ask: Callable[[list[str]], list[str]], folder: str, settings: dict, prompt: str = "prompt", response: str = "response", buckets: int = BUCKETS, batch: int = BATCH) -> DataFrame:
    """Rows with the model's answer to their prompt, in a column ``response``.

    ``ask`` gives an answer for each of a list of prompts. Answers are logged in ``folder`` by the hash of
    the settings and the prompt, whole batches at a time, before the next batch is asked for; so
    equal prompts, a task that is tried again, and a later run ask only for what has no answer yet,
    and other settings ask anew. Null prompts are not asked and have a null answer. ``folder`` must be one that all
    executors see; ``buckets`` belongs to the log and must stay the same for one folder.
    """
    stamp = json.dumps(settings, sort_keys=True, ensure_ascii=False)
    place = f"{folder.rstrip('/')}/settings={hashlib.sha256(stamp.encode()).hexdigest()[:16]}-{buckets}"
    h = F.sha2(F.concat(F.lit(stamp + "\n"), F.col(prompt)).cast("binary"), 256)
    keyed = prompts.withColumn("__hash", h)
    distinct = keyed.where(F.col(prompt).isNotNull()).groupBy("__hash").agg(F.first(prompt).alias("prompt"))
    bucket = F.pmod(F.xxhash64("__hash"), F.lit(buckets)).cast("int")

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, fs, path, known = None, None, "", {}
        open_: list[tuple[str, str]] = []

        def asked() -> pa.RecordBatch:
            answers = ask([p for _, p in open_])
            if len(answers) != len(open_):
                raise ValueError(f"{len(answers)} answers to {len(open_)} prompts")
            rows = pa.RecordBatch.from_pydict({"prompt_hash": pa.array([k for k, _ in open_], pa.string()), "response": pa.array(answers, pa.string())})
            name = f"{uuid.uuid4().hex}.parquet"
            with fs.open_output_stream(f"{path}/.{name}") as out:
                pq.write_table(pa.Table.from_batches([rows]), out)
            fs.move(f"{path}/.{name}", f"{path}/{name}")
            open_.clear()
            return rows

        for b in batches:
            found: list[tuple[str, str]] = []
            for part, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if open_:
                        yield asked()
                    now = part
                    fs, path, known = _log(place, part)
                if key in known:
                    found.append((key, known[key]))
                else:
                    open_.append((key, text))
                    if len(open_) >= batch:
                        yield asked()
            if found:
                yield pa.RecordBatch.from_pydict({"prompt_hash": [k for k, _ in found], "response": pa.array([a for _, a in found], pa.string())})
        if open_:
            yield asked()

    dealt = distinct.withColumn("__bucket", bucket).select("__bucket", "__hash", "prompt").repartition(buckets, "__bucket").sortWithinPartitions("__bucket", "__hash")
    answers = dealt.mapInArrow(run, "prompt_hash string, response string")
    return keyed.join(answers.select(F.col("prompt_hash").alias("__hash"), F.col("response").alias(response)), "__hash", "left").drop("__hash")
