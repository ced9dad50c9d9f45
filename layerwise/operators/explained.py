"""Explanations of many differences: questions are columns, answers are kept by the questions' hashes."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import responses
from ..functions.prompts import ANALYST, ANALYST_REPLY, system_text
from ..sources.shared import written
from ..sources.snapshots import Snapshots
from .search import responsible_for

MOST = 40  # candidates that a question shows
LIMIT = 120.0  # seconds that an answer may take
KEPT = 64  # answers that are stored at a time
ANSWERS = "prompt_hash string, answer string"


def mismatch_prompt(difference: Column, candidates: Column) -> Column:
    """The question about a difference (JSON) and its candidates, array<struct<path, cell_index, snippet>>."""
    shown = F.transform(candidates, lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), c["path"], F.lit(", cell "), c["cell_index"].cast("string"), F.lit("\n<code>\n"), c["snippet"], F.lit("\n</code>")))
    code = F.when(F.size(candidates) > 0, F.array_join(shown, "\n")).otherwise(F.lit("No code was found."))
    return F.concat(F.lit("Difference:\n"), difference, F.lit("\n\nCandidates:\n"), code)


def within(task: Callable[[], str], limit: float | None) -> str | None:
    """What the task returns; None if it fails or takes longer. A task that hangs is left behind in a thread of its own."""
    out: list[str] = []

    def run() -> None:
        try:
            out.append(task())
        except Exception:  # an explainer is foreign code
            return

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(limit)
    return out[0] if out else None


def _few(rows: Iterator, n: int) -> Iterator[list]:
    some: list = []
    for r in rows:
        some.append(r)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def answered(prompts: DataFrame, explainer: Callable[[list[dict[str, str]]], str], store: Snapshots, system: str, name: str = "answers", limit: float | None = LIMIT) -> DataFrame:
    """prompts(prompt_hash, prompt, ...) -> with answer, null where the explainer failed or was late.

    Only questions that the store has no answer to are asked, one after the other, KEPT of them at a time on the driver; what
    is answered is kept, also when a later one fails.
    """
    spark = prompts.sparkSession
    known = store.read(name) if store.versions(name) else spark.createDataFrame([], ANSWERS)
    new = prompts.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(known, "prompt_hash", "left_anti")
    for some in _few(new.toLocalIterator(), KEPT):
        got = [(r.prompt_hash, within(lambda r=r: explainer([{"role": "system", "content": system}, {"role": "user", "content": r.prompt}]), limit)) for r in some]
        if kept := [x for x in got if x[1] is not None]:
            known = known.unionByName(spark.createDataFrame(kept, ANSWERS))
            store.publish(known.dropDuplicates(["prompt_hash"]), name)
            known = store.read(name)
    return prompts.join(known, "prompt_hash", "left")


def explained_mismatches(notebooks: DataFrame, mismatches: DataFrame, explainer: Callable[[list[dict[str, str]]], str], store: Snapshots, most: int = MOST, limit: float | None = LIMIT) -> DataFrame:
    """mismatches(table_name, from_stage, to_stage, from_count, to_count, difference) -> with n_candidates, prompt, candidates, responsible
    (the candidate that the explainer points at, or null) and explanation (null if there is no answer).

    All code is read once. A question shows the first `most` candidates of its table.
    """
    first = Window.partitionBy("table_name").orderBy("nb_ord", "cell_index", "stmt_idx")
    found = written(responsible_for(notebooks, mismatches), "responsible")  # listed and counted
    shown = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    listed = shown.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("n", "path", "cell_index", "stmt_idx", "snippet"))).alias("candidates"))
    rows = mismatches.join(listed, "table_name", "left").join(found.groupBy("table_name").agg(F.count("*").alias("n_candidates")), "table_name", "left")
    rows = rows.withColumn("candidates", F.coalesce("candidates", F.array().cast(listed.schema["candidates"].dataType))).fillna(0, ["n_candidates"])
    difference = F.to_json(F.struct(*mismatches.columns))
    rows = rows.withColumn("prompt", mismatch_prompt(difference, F.col("candidates"))).withColumn("prompt_hash", F.sha2("prompt", 256))
    rows = answered(rows, explainer, store, system_text(ANALYST, ANALYST_REPLY), limit=limit)
    said = responses.analysis(F.col("answer"), F.size("candidates"))
    rows = rows.withColumn("_said", F.when(F.col("answer").isNotNull(), said))
    return rows.withColumn("responsible", F.get("candidates", F.col("_said.responsible_index"))).withColumn("explanation", F.col("_said.explanation")).drop("_said", "answer")
