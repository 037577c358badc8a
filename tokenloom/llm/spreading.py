"""Numbers that spread equal rows over many tasks, made from the data alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import scratch

#: An id is heavy above so many rows, and above this share of all rows: at most ``1 / SHARE`` ids are.
HEAVY, SHARE = 10_000, 1e-5
#: Repeats of a row that one task writes out.
RUN = 100_000


def numbered(docs: DataFrame, number: str, heavy: int | None = None) -> DataFrame:
    """``docs`` with a number that differs between equal rows of heavy ids; 0 elsewhere.

    Heavy ids are counted from ``doc_id`` alone. Their rows, null ids too, are
    grouped by all columns before they are shuffled, and each group is dealt out
    again in runs of ``RUN``. So the numbers hang on the data alone, and a task
    that is run again gives the same ones.
    """
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    total = docs.count()
    limit = max(HEAVY, int(total * SHARE)) if heavy is None else heavy
    own, run, copies = scratch.unused(docs, "_heavy", "_run", "_copies")
    found = scratch.materialise(counts.filter(F.col("n") > limit).select(F.col("doc_id").alias(own)), "heavy_ids")
    if not found.limit(1).count():
        return docs.withColumn(number, F.lit(0).cast("long"))
    same = docs["doc_id"].eqNullSafe(found[own])
    ids = F.broadcast(found)  # at most 1 / SHARE ids
    groups = docs.join(ids, same, "left_semi").groupBy(*[docs[c] for c in docs.columns]).agg(F.count("*").alias(copies))
    runs = groups.withColumn(run, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies), F.lit(RUN).cast("long"))))
    last = F.least(F.col(copies), F.col(run) + RUN - 1)
    dealt = runs.repartition(*[F.col(f"`{c}`") for c in docs.columns], run).withColumn(number, F.explode(F.sequence(F.col(run), last)))
    return docs.join(ids, same, "left_anti").withColumn(number, F.lit(0).cast("long")).unionByName(dealt.select(*docs.columns, number))
