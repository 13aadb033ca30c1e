"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words.  ``targets`` shares the whole size among the sources by weight, no
source above ``repeats`` times its own size.  Each source is a stream of words: its
documents in shuffled order, shuffled anew for every further pass over them, up to its
target.  Streams are cut into blocks of equal size (a document may span blocks), and a
schedule says which source each slot of the mix takes its next block from.

* Schedule: sources own neighbouring intervals of the points 0 .. 2^k - 1, as long as
  they have blocks.  Slot t looks at the van der Corput point of t (its k bits
  reversed), so the slots of each source are spread evenly, and any stretch of the mix
  holds every source near its weight.  Bits reversed twice are the same again, so a
  source generates its own slots from its interval, without a join.
* Rank: how many earlier slots took the same source follows from the bits of the two
  ends of the interval (``_points_below``), so no window ever sorts the slots of a source.
* Stream places are running sums over documents in shuffled order.  They are summed in
  buckets of the shuffled key, the buckets' sums in buckets of buckets and so on, so that
  no task sorts more than about ``GROUP`` rows of one source (``running_sums``).

Sources, documents and slots stay distributed; the driver sees single rows of sums.

Handling: a null text has size 0; documents of size 0 are taken 0 times and are in no
slot.  A null source is a source of its own, last in order.  Null, tied or repeated ids
are fine: rows are told apart by a number of their own.  Reruns agree, as the shuffle is
a digest of seed, pass, id and text; rows that tie in it are equal but for other columns.  Very
long texts span many blocks.  An empty table, or one of empty texts, gives an empty
stream.  Kept columns travel in the struct ``row``, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cootensor.sources.build import dense_index

from .frames import cut

BLOCK = 1024           # words of a slot
REPEATS = 3            # times a document may be taken
GROUP = 1 << 13        # rows of one source a task sorts, about
KEY_BITS = 48          # bits of the shuffled key
RUN = 1 << 12          # points of a source that are made from one row
TASK_SLOTS = 1 << 17   # slots a task makes, about


def n_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled(rank: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights that repeat along the order of the sources."""
    return F.array(*[F.lit(w) for w in weights])[(rank % len(weights)).cast("int")].cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source_id, source_size, weight) with ``target`` (double) and ``quota`` (whole words).

    The whole size is shared by weight; a share above ``repeats`` times the source's size
    stops there, and what is left is shared among the others, until none is above.
    """
    limit = F.col("source_size") * repeats
    sizes = cut(sizes.withColumn("full", F.col("source_size") == 0), "targets")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left = sizes.where(~F.col("full")).agg(F.sum("weight")).first()[0] or 0
        used = sizes.where("full").agg(F.sum(limit)).first()[0] or 0
        share = F.col("weight") * F.lit(float(total - used)) / F.lit(float(left or 1))
        over = ~F.col("full") & (share > limit)
        if not left or sizes.where(over).isEmpty():
            break
        sizes = cut(sizes.withColumn("full", F.col("full") | over), "targets")
    target = F.when(F.col("full"), limit.cast("double")).otherwise(share)
    return cut(sizes.withColumn("target", target).withColumn("quota", F.floor(target + 0.5).cast("long")).drop("full"), "targets")


def running_sums(rows: DataFrame, group: str, key: str, ties: list[str], value: str, out: str,
                 bits: int, most: int = GROUP) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the group before each row, by ``key`` and ``ties``.

    ``key`` is a number of ``bits`` bits, spread evenly.  Groups above ``most`` rows are cut
    at the key's first bits; the sums of those buckets are added up in the same way.
    """
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    order = Window.orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    if largest <= most or bits == 0:
        return rows.withColumn(out, F.coalesce(F.sum(value).over(order.partitionBy(group)), F.lit(0)))
    keep = max(0, bits - max(1, (largest // (most // 2)).bit_length()))
    bucket, inside, total = f"bucket_{bits}", f"inside_{bits}", f"sum_{bits}"
    rows = rows.withColumn(bucket, F.shiftright(key, keep))
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias(total))
    before = running_sums(cut(sums, "buckets"), group, bucket, [], total, f"before_{bits}", bits - keep, most)
    rows = rows.withColumn(inside, F.coalesce(F.sum(value).over(order.partitionBy(group, bucket)), F.lit(0)))
    return rows.join(before.drop(total), [group, bucket]) \
        .withColumn(out, F.col(f"before_{bits}") + F.col(inside)).drop(bucket, inside, f"before_{bits}")


def _reverse(x: Column, k: int) -> Column:
    """The lowest ``k`` bits of ``x`` in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(x), k, "0")), 2, 10).cast("long") if k else F.lit(0).cast("long")


def _points_below(t: Column, x: Column, y: Column, k: int) -> Column:
    """How many of the slots 0 .. t - 1 have a point below ``x`` (0 .. 2^k); ``y`` is ``_reverse(x, k)``.

    [0, x) is one dyadic interval per bit of x; the slots whose points fall into such an
    interval are one residue class.
    """
    if k == 0:
        return F.when(x > 0, t).otherwise(F.lit(0).cast("long"))
    terms = F.lit(0).cast("long")
    for j in range(1, k + 1):
        low = y.bitwiseAND(F.lit((1 << (j - 1)) - 1).cast("long"))
        terms = terms + F.shiftright(y, j - 1).bitwiseAND(F.lit(1).cast("long")) * F.shiftright(t - low + F.lit((1 << j) - 1).cast("long"), j)
    return F.when(x >= F.lit(1 << k), t).otherwise(terms)


def schedule(quotas: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots ``(source_id, rank, slot)`` of the mix from ``(source_id, quota)``: one per block of a source's quota.

    Slot numbers run from 0 with gaps (the points no source owns).
    """
    parts = cut(quotas.select("source_id", F.ceil(F.col("quota") / block).cast("long").alias("n")).where("n > 0"), "blocks")
    total = parts.agg(F.sum("n")).first()[0]
    if not total:
        return parts.select("source_id", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("slot")).limit(0)
    k = (int(total) - 1).bit_length()
    n_ids = int(parts.agg(F.max("source_id")).first()[0]).bit_length()
    owned = running_sums(parts.withColumn("all_", F.lit(0)), "all_", "source_id", [], "n", "first", n_ids).drop("all_")
    ends = owned.select("source_id", "first", (F.col("first") + F.col("n")).alias("last"))
    runs = ends.select("*", _reverse(F.col("first"), k).alias("y0"), _reverse(F.col("last"), k).alias("y1"),
                       F.explode(F.sequence("first", F.col("last") - 1, F.lit(RUN).cast("long"))).alias("from"))
    points = runs.repartition(-(-int(total) // TASK_SLOTS), "source_id", "from") \
        .select("*", F.explode(F.sequence("from", F.least("last", F.col("from") + RUN) - 1)).alias("point"))
    slots = points.withColumn("slot", _reverse(F.col("point"), k))
    rank = _points_below(F.col("slot"), F.col("last"), F.col("y1"), k) - _points_below(F.col("slot"), F.col("first"), F.col("y0"), k)
    return slots.select("source_id", rank.alias("rank"), "slot")


def mix(docs: DataFrame, keep: list[str], source: Column, text: Column, id: Column, weight=cycled,
        block: int = BLOCK, repeats: int = REPEATS, seed: int = 0, most: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """The rows and the mix.

    Rows: ``(n, row, size, source_id, source_size, target)``, one per document.  Mix:
    ``(slot, place, n, pass, from, words)``: in slot order, by place, ``words`` words of row
    ``n`` from its word ``from`` on.  ``weight`` maps a source's rank to its weight.
    """
    tie = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), source.alias("source_name"), id.cast("string").alias("id_"),
                       n_words(text).alias("size"), tie.alias("tie"))
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()), "rows")
    ranks = dense_index(rows, "source_name", "source_id")
    sizes = rows.groupBy("source_name").agg(F.sum("size").alias("source_size"))
    same = F.col("source_name").eqNullSafe(F.col("r_name"))
    sizes = sizes.join(ranks.withColumnRenamed("source_name", "r_name"), same) \
        .select(F.col("source_id").cast("long"), "source_name", "source_size", weight(F.col("source_id")).alias("weight"))
    plan = targets(sizes, repeats)
    p = plan.select(F.col("source_name").alias("r_name"), "source_id", "source_size", "target", "quota")
    rows = cut(rows.join(p, same).drop("r_name", "source_name"), "sized")
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("source_size")).cast("int") - 1))
    copies = rows.where("size > 0 AND quota > 0").select("source_id", "n", "id_", "size", "tie", "source_size", "quota", F.explode(passes).alias("pass"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce("id_", F.lit("")), "tie").cast("binary"))
    copies = copies.withColumn("key", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")) \
        .withColumn("lane", F.col("source_id") * repeats + F.col("pass")).drop("id_")
    placed = running_sums(cut(copies, "copies"), "lane", "key", ["tie", "n"], "size", "before", KEY_BITS, most)
    start = F.col("before") + F.col("pass") * F.col("source_size")
    placed = placed.withColumn("start", start).withColumn("stop", F.least(F.col("start") + F.col("size"), "quota")).where("stop > start")
    hop = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)))
    pieces = placed.select("source_id", "n", "pass", "start", "stop", hop.alias("rank"))
    a, b = F.greatest("start", F.col("rank") * block), F.least("stop", (F.col("rank") + 1) * block)
    pieces = pieces.select("source_id", "rank", "n", "pass", (a - F.col("start")).alias("from"), (b - a).alias("words"), (a % block).alias("place"))
    # The plan's sizes say nothing of what the schedule's rows explode into: never broadcast it.
    stream = pieces.join(schedule(plan, block).hint("merge"), ["source_id", "rank"]).select("slot", "place", "n", "pass", "from", "words")
    return rows.select("n", "row", "size", "source_id", "source_size", "target"), stream


def taken(rows: DataFrame, stream: DataFrame) -> DataFrame:
    """``rows`` with the number of words the mix takes of each."""
    words = stream.groupBy("n").agg(F.sum("words").alias("taken"))
    return rows.join(words, "n", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
