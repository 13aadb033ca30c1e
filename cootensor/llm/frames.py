"""DataFrame plumbing shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cootensor.session import checkpoint_root


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_ROWS = 2000      # rows of one Arrow batch: texts are long, and a batch is held in the JVM and in Python


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of the session at ``BATCH_ROWS`` rows or fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Unlike an in-memory checkpoint the files keep column pruning, statistics
    (Catalyst sees their size) and survive lost executors.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{checkpoint_root(spark).rstrip('/')}/cootensor-llm/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def annotate(df: DataFrame, keep: list[str], inputs: dict[str, Column],
             fn: Callable[[pa.RecordBatch], list], results: str) -> DataFrame:
    """Rows ``(row, results...)``: ``row`` is a struct of the ``keep`` columns, untouched.

    ``fn`` maps a record batch holding ``inputs`` to one array per result
    column.  The kept columns travel inside a struct, so no name of theirs can
    clash with an input or a result.
    """
    bound_batches(df.sparkSession)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[v.alias(k) for k, v in inputs.items()])
    out = T.StructType([src.schema["row"], *T._parse_datatype_string(results).fields])
    names = out.names

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, fn(b))], names=names)

    return src.mapInArrow(run, out)


def most_counted(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows with the highest counts, as many whole count classes (quarter powers of two) as fit in ``limit``.

    Only the histogram of the classes is looked at first, so no task or driver
    sorts more than it returns.
    """
    step = F.floor(F.log2(F.col(n)) * 4)
    classes = counts.groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect()
    least, held = None, 0
    for r in classes:
        held += r["count"]
        if held > limit:
            break
        least = r.k
    return counts.where(step >= least) if least is not None else counts.limit(0)


def pair_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: ``(node, component)`` for every node with an edge.

    ``component`` is the smallest node id of its component.  Each round every
    node adopts the smallest id among itself and its neighbours, and the edges
    are contracted to those ids; a round at least halves the nodes of a
    non-trivial component, so the number of rounds is logarithmic.  Everything
    stays distributed; each round is cut to the shared folder.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = cut(e, "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "labels")
        steps.append(step)
        left = e.join(step, "a").select(F.col("m").alias("x"), "b")
        both = left.join(step.withColumnRenamed("a", "b"), "b").select(F.least("x", "m").alias("a"),
                                                                       F.greatest("x", "m").alias("b"))
        e = cut(both.where("a <> b").distinct(), "edges")
    if not steps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    out = steps[0].select(F.col("a").alias("node"), F.col("m").alias("component"))
    for step in steps[1:]:
        nxt = step.select(F.col("a").alias("component"), "m")
        out = out.join(nxt, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return cut(out, "components") if len(steps) > 1 else out
