"""Model calls as a distributed operator.

``complete`` runs a user-supplied ``fn(list[str]) -> list[str | None]``
over slices of Arrow batches with ``mapInArrow``.  No provider client lives here:
network access, retries and keys are the callable's business.  Each batch
is isolated per row — a prompt whose call raises gets ``response = null``
and the error text, and the other rows proceed.

Model output is not deterministic, so persist the responses (checkpoint or
table) before anything re-reads them; a recomputed lineage would call the
model again and may get different answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantflow.functions.text import RECORD_FIELDS, parse_records, strip_fences
from grantflow.session import staged

CompleteFn = Callable[[Sequence[str]], Sequence[str | None]]
#: Bytes of a batch, about, that are handed to the function at once.
PART = 4 << 20


def offline(_: Sequence[str]) -> Sequence[str | None]:
    """Default callable: refuses clearly instead of inventing answers."""
    raise RuntimeError("no model function configured: pass fn=... to complete()")


def _call_batch(fn: CompleteFn, prompts: list) -> tuple[list, list]:
    try:
        out = list(fn(prompts))
        if len(out) != len(prompts):
            raise ValueError(f"model returned {len(out)} responses for {len(prompts)} prompts")
        return out, [None] * len(prompts)
    except Exception as e:  # noqa: BLE001 - one bad row never stops the batch
        if len(prompts) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    # A bad prompt is found by halving: one among n repeats the good ones of
    # its halves (fewer than n), not every prompt on its own.
    half = len(prompts) // 2
    left, right = _call_batch(fn, prompts[:half]), _call_batch(fn, prompts[half:])
    return left[0] + right[0], left[1] + right[1]


def complete(df: DataFrame, prompt_col: str, fn: CompleteFn = offline,
             response_col: str = "response", error_col: str = "error",
             partitions: int | None = None) -> DataFrame:
    """Adds ``response`` and ``error`` columns by calling ``fn`` on prompts.

    ``partitions`` spreads a slow client over that many tasks (round-robin
    repartition) — model latency, not data size, sets the parallelism.
    """
    src = df.repartition(partitions) if partitions else df
    schema = T.StructType(src.schema.fields + [
        T.StructField(response_col, T.StringType(), True),
        T.StructField(error_col, T.StringType(), True),
    ])

    def run(batches):
        for part in (p for batch in batches for p in _parts(batch)):
            prompts = [None if p is None or p != p else str(p) for p in part.column(prompt_col).to_pylist()]
            todo = [i for i, p in enumerate(prompts) if p is not None]
            responses: list = [None] * len(prompts)
            errors: list = [None] * len(prompts)
            if todo:
                r, e = _call_batch(fn, [prompts[i] for i in todo])
                for i, ri, ei in zip(todo, r, e):
                    responses[i], errors[i] = ri, ei
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(x, pa.string(), from_pandas=True) for x in (responses, errors))],
                [*part.schema.names, response_col, error_col])

    return src.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PART`` bytes: what a task holds as text at once."""
    each = max(1, PART * batch.num_rows // max(1, batch.nbytes))
    return (batch.slice(i, each) for i in range(0, batch.num_rows, each))


def outcome(df: DataFrame, response_col: str = "response", error_col: str = "error") -> DataFrame:
    """Adds ``status``: ``failed`` when the call raised or answered nothing."""
    return df.withColumn(
        "status", F.when(F.col(error_col).isNotNull() | F.col(response_col).isNull(), "failed")
                   .otherwise("ok"))


def extract_records(prompts: DataFrame, prompt_col: str, fn: CompleteFn = offline) -> tuple[DataFrame, DataFrame]:
    """Prompts -> (records, failed prompts).

    The answers are staged once, so the model is called once per prompt
    however often the results are read.  ``records`` has the other columns of
    ``prompts``, ``record_no``, the record fields and ``other`` (a map of the
    rest); a call that failed or an answer that is no array of objects is a
    row of ``failed`` with its ``error``.
    """
    keep = [c for c in prompts.columns if c != prompt_col]
    answered = staged(complete(prompts, prompt_col, fn).withColumn(
        "records", parse_records(strip_fences(F.col("response")))).drop(prompt_col, "response"), "model-answers")
    failed = answered.filter(F.col("records").isNull()).select(
        *keep, F.coalesce("error", F.lit("the answer is not an array of records")).alias("error"))
    rows = answered.select(*keep, F.posexplode_outer("records").alias("record_no", "r")) \
        .filter(F.col("record_no").isNotNull())
    return rows.select(*keep, "record_no", *[F.col("r")[f].alias(f) for f in RECORD_FIELDS],
                       F.map_filter("r", lambda k, v: ~k.isin(*RECORD_FIELDS)).alias("other")), failed
