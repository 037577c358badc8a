"""Operator 10: mixing sources to target weights by Poisson replication.

Source s with n_s of N documents and weight w_s has the mean repetition rate
w_s * total / n_s, weights summing to one. Each document inverts the Poisson
distribution of that mean at a number in [0, 1) that is hashed from the seed,
its id and its text; it is exploded by the count, and the copies are dealt over
all partitions and ordered within them by a hash of their own; copies with equal
``order_key`` (repeated rows) are ordered by copy and else interchangeable.
Everything hangs on hashes alone, so a lost task makes the same rows again. Rows
repeated very often share all hashes; they are numbered from the data
(``spreading``) and the number helps to deal them out, so no partition gets all.

Weights may be given by source; sources without one get none. Otherwise w_s is
in proportion to n_s ** ``exponent`` (1/2: large sources are damped, small ones
repeated). A mean above ``PART`` is drawn as a sum of equal parts, which is
Poisson again and keeps exp(-mean) in range. A null source is a source of its
own; a null text or id hashes as its own marker, an empty text as itself, a very
long one whole. Repeated rows have the same
hash and so the same count. An empty table gives an empty result. All columns
pass through; those added carry the names given and replace columns that have
these names already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import scratch, spreading

PART = 32.0
#: P(count > STEPS) for a mean of PART is below 1e-25.
STEPS = 128
#: Sources up to which their table (about 1 KB each) is broadcast, and salts beyond.
MOST_SOURCES, SALTS = 10_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, exponent: float = 0.5) -> DataFrame:
    """source -> mean number of copies of each of its documents."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        shares = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame(sorted(weights.items()), "given string, w double")
        shares = sizes.join(given, sizes.source.eqNullSafe(given.given), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    shares = scratch.materialise(shares, "shares")
    all_w, all_n = shares.agg(F.sum("w"), F.sum("n")).first()
    if not all_w:
        return shares.select("source", F.lit(0.0).alias("rate"))
    target = float(all_n if total is None else total)
    return shares.select("source", (F.col("w") / F.lit(float(all_w)) * F.lit(target) / F.col("n")).alias("rate"))


def tables(rate: DataFrame) -> DataFrame:
    """source -> parts, and the cumulative probabilities of one part up to ``STEPS``."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    shaped = rate.select("source", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    step = lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    return shaped.select("source", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["cdf"]).alias("cdf"))


def replicate(docs: DataFrame, seed: int = 7, weights: dict[str, float] | None = None, total: float | None = None, exponent: float = 0.5,
              copy: str = "copy", order: str = "order_key") -> DataFrame:
    """``docs`` exploded by their counts and shuffled, with the copy's number from 1 and its place in the order."""
    columns = docs.columns
    repeat, source, parts, cdf, salt, n_copies, number = scratch.unused(docs, "_repeat", "_source", "_parts", "_cdf", "_salt", "_count", "_number")
    shape = tables(rates(docs.select("source"), weights, total, exponent)).select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    shape = scratch.materialise(shape, "rates")
    docs = spreading.numbered(docs, repeat)
    if shape.count() <= MOST_SOURCES:
        drawn = docs.join(F.broadcast(shape), docs["source"].eqNullSafe(shape[source]))
    else:  # too many to send everywhere: join by source, each source's rows dealt over salts
        salted = shape.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        drawn = docs.join(salted, docs["source"].eqNullSafe(salted[source]) & (own == salted[salt]))
    digest = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("~")).cast("binary"))
    name = [F.lit(str(seed)), docs["doc_id"], digest]
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: uniform(*name, i))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(cdf, lambda c: c <= u)))
    kept = drawn.withColumn(n_copies, count).filter(F.col(n_copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    key = uniform(F.lit("order"), *name, F.col(number))
    others = [docs[c] for c in columns if c.lower() not in (copy.lower(), order.lower())]
    out = kept.select(*others, docs[repeat], F.col(number).cast("long").alias(copy), key.alias(order))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, order, repeat).sortWithinPartitions(order, copy).drop(repeat)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus in its new order, with the columns of ``docs``."""
    copy, order = scratch.unused(docs, "_copy", "_order")
    return replicate(docs, copy=copy, order=order, **settings).drop(copy, order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs).select("doc_id", "source", "copy", F.md5(F.coalesce("text", F.lit("~")).cast("binary")).alias("text_md5"), F.format_string("%.9f", "order_key").alias("order_key"))


SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT source, sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER () * sum(n) OVER () / n AS r FROM sizes),
shape AS (SELECT source, r, greatest(ceil(r / {PART}), 1) AS parts FROM rate),
steps AS (SELECT source, parts, k, exp(-r / parts + k * ln(r / parts) - lgamma(k + 1)) AS p FROM shape, range(0, {STEPS + 1}) t(k)),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
docs AS (SELECT doc_id, source, md5(coalesce(text, '~')) AS h FROM documents),
draws AS (SELECT doc_id, source, h, i, CAST('0x' || substr(md5('7|' || doc_id || '|' || h || '|' || i), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
          FROM docs JOIN (SELECT source, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS i FROM shape) USING (source)),
counts AS (SELECT d.doc_id, d.source, d.h, count(*) FILTER (WHERE c.c <= d.u) AS n FROM draws d JOIN cdf c USING (source) GROUP BY d.doc_id, d.source, d.h),
copies AS (SELECT doc_id, source, h, unnest(range(1, n + 1)) AS copy FROM counts WHERE n > 0)
SELECT doc_id, source, copy, h AS text_md5,
       format('{{:.9f}}', CAST('0x' || substr(md5('order|7|' || doc_id || '|' || h || '|' || copy), 1, 13) AS BIGINT) / 4503599627370496.0) AS order_key
FROM copies
"""
