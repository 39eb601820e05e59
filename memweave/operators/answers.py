"""Model calls that survive: an answer is stored before it is used, and no stored one is asked for again.

``AnswerTable`` is a folder of small Parquet files, one for each slice of ``CALLS`` prompts. A
prompt is named by a digest of system, user text and budget. Prompts without a stored answer
are written, sorted by name and dealt to tasks; a task takes them slice by slice, looks for the
file that the slice's names give, and calls only if it is not there. So a second job, a retried
task or a copy of a slow one finds what the first had answered, and loses one slice at most.

A task has ``in_flight`` calls open at once, and ``parallel`` tasks call: together they bound what
the model sees. Answers that come back empty are asked again with larger budgets. Failures are
told in the result and not stored, so that the next run asks again.

The folder must be one that Arrow's file systems open on the executors (a shared mount, or an
object store by its URI).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.operators import providers
from memweave.runtime import materialize

#: Prompts of a slice, and tokens that an empty answer is asked again with, in times of the first budget.
CALLS, BUDGETS = 20, (1, 2, 4)
SCHEMA = pa.schema([("name", pa.string()), ("answer", pa.string()), ("error", pa.string())])


def with_budgets(make: Callable[[], providers.Model], budgets: tuple[int, ...] = BUDGETS) -> Callable[[], providers.Model]:
    """The model again for requests with an empty answer, with a larger budget each time. The last answer stands."""

    def made() -> providers.Model:
        inner = make()

        def run(requests: list[providers.Request]) -> list[str]:
            out: list[str | None] = [None] * len(requests)
            todo = list(range(len(requests)))
            for times in budgets:
                for k, said in zip(todo, inner([requests[k]._replace(max_tokens=requests[k].max_tokens * times) for k in todo]), strict=True):
                    out[k] = said
                todo = [k for k in todo if not (out[k] or "").strip()]
                if not todo:
                    break
            return out

        return run

    return made


class AnswerTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        """``(name, answer)`` of all that was ever answered."""
        files, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        if files.get_file_info(root).type == fs.FileType.NotFound:
            return self.spark.createDataFrame([], "name string, answer string")
        return self.spark.read.schema("name string, answer string, error string").option("recursiveFileLookup", "true").parquet(self.path).where("error IS NULL").select("name", "answer").dropDuplicates(["name"])

    def ask(
        self, df: DataFrame, prompt: Column, name: str, make: Callable[[], providers.Model] = providers.rules, system: str = "", max_tokens: int = providers.MAX_TOKENS,
        parallel: int = providers.HOSTED_CALLS, in_flight: int = 1,
    ) -> DataFrame:
        """``df`` with a model's answer and ``{name}_error``, as ``providers.ask`` has them; equal prompts are one call."""
        key = F.sha2(F.concat_ws("\x1f", F.lit(system), F.lit(str(max_tokens)), F.coalesce(prompt, F.lit(""))), 256)
        told = materialize(df.withColumn("__name", key).withColumn("__prompt", F.coalesce(prompt, F.lit(""))), "prompts")
        open_ = told.select(F.col("__name").alias("name"), F.col("__prompt").alias("prompt")).dropDuplicates(["name"]).join(self.read().select("name"), "name", "left_anti")
        open_ = materialize(open_, "open-prompts")
        path = self.path if "://" in self.path else f"file://{self.path}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = fs.FileSystem.from_uri(path)
            model = None
            for b in batches:
                for k in range(0, len(b), CALLS):
                    names, prompts = (b.column(c).slice(k, CALLS).to_pylist() for c in (0, 1))
                    place = f"{root}/{hashlib.sha256(''.join(names).encode()).hexdigest()}.parquet"
                    if files.get_file_info(place).type != fs.FileType.NotFound:
                        with files.open_input_file(place) as f:
                            held = pq.read_table(f, schema=SCHEMA)
                    else:
                        model = model or make()
                        with ThreadPoolExecutor(in_flight) as pool:
                            said = [x[0] for x in pool.map(lambda p: providers._answered(model, [providers.Request(system, p, max_tokens)]), prompts)]
                        held = pa.table([names, [a for a, _ in said], [e for _, e in said]], schema=SCHEMA)
                        good = held.filter(pc.is_null(held["error"]))
                        if len(good) == len(held):
                            _put(files, root, place, held)
                        elif len(good):  # under a name that no slice has: the rest is asked again
                            _put(files, root, f"{root}/some-{uuid.uuid4().hex}.parquet", good)
                    yield from held.to_batches()

        asked = open_.repartition(parallel, "name").sortWithinPartitions("name").mapInArrow(run, "name string, answer string, error string")
        asked = materialize(asked, "answers")
        known = self.read().select("name", F.col("answer").alias("stored"))
        out = told.join(known, told["__name"] == known["name"], "left").drop("name").join(asked.withColumnRenamed("name", "__asked"), F.col("__name") == F.col("__asked"), "left")
        return out.select(*df.columns, F.coalesce("stored", "answer").alias(name), F.when(F.col("stored").isNull(), F.col("error")).alias(f"{name}_error"))


def _put(files: fs.FileSystem, root: str, place: str, held: pa.Table) -> None:
    """Write beside the place, then move: a file is there as a whole or not at all."""
    files.create_dir(root, recursive=True)
    beside = f"{root}/_{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as f:
        pq.write_table(held, f)
    files.move(beside, place)
