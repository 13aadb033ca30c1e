"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong findings stand alone: ``assign`` (a keyword given a value of 8 or more
characters), ``access`` (``AKIA`` and capitals or digits, 16 or more), ``hex``
(32 or more hex digits).  Weak candidates count only beside complementary parts
of a credential: ``ident`` (a user, client or account name given a value) when a
secret is in scope, ``bare`` (a loose run of 20 or more characters that mixes
capitals, small letters and digits) when an identifier is in scope, ``endpoint``
(a URL or host) when both are.  A scope is ``SCOPE`` code points between starts.

Parts are rows; they are summed up per bin of one scope, and a weak candidate is
joined to its own bin and the two beside it, where the outermost starts of each
role decide.  No pairs of parts are ever formed.  Matches get their places by a
running sum over the pieces between them, so a text may hold any number.

Texts are keyed by two hashes, so copies are scanned and linked once and a null
or repeated id does not matter.

Defined results.  Null or empty text: no findings (counts 0, the hash of the
empty string, empty spans).  Repeated rows keep their rows; extra columns are
untouched; an empty table gives no rows.  Very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

SCOPE = 200
MASK = "[secret]"

# Fixed values of the scan contract.
KINDS = ["assign", "access", "hex", "ident", "bare", "endpoint"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Weak parts.
IDENT = r"""(?i:(access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
BARE = r"[A-Za-z0-9+/_=-]+"
ENDPOINT = r"""(?i:https?|ftps?|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://([^\x00-\x20"'<>]+)"""
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, IDENT, BARE, ENDPOINT]))
ROLES = {"assign": "s", "access": "i", "hex": "s", "ident": "i", "bare": "s", "endpoint": "e"}
# A text without one of these has no finding of any kind.
SIGN = "|".join([r"""(?i:password|passwd|secret|token|api_?key|access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]""",
                 r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}"])
RESULTS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _keeps(kind: str, match: Column, value: Column) -> Column:
    """Whether a raw match of ``kind`` counts."""
    if kind == "assign":
        return F.length(value) >= 8
    if kind == "access":
        return F.length(match) >= 16
    if kind == "hex":
        return F.length(match) >= 32
    if kind == "ident":
        return F.length(value) >= 3
    if kind == "bare":
        return (F.length(match) >= 20) & match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.length(value) >= 1


def _matches(texts: DataFrame, kind: str) -> DataFrame:
    """``(k1, k2, kind, start, end)`` of the leftmost, non-overlapping matches of one kind."""
    pattern = F.lit(PATTERNS[kind])
    group = {"assign": 2, "ident": 2, "endpoint": 1}.get(kind, 0)
    # patterns whose short matches are dropped whole can skip them while matching
    if kind == "access":
        pattern = F.lit(r"AKIA[A-Z0-9]{12,}")
    elif kind == "hex":
        pattern = F.lit(r"[0-9a-f]{32,}")
    elif kind == "bare":
        pattern = F.lit(r"[A-Za-z0-9+/_=-]{20,}")
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(group)) if group else found
    rows = texts.select("k1", "k2", F.posexplode(F.arrays_zip(
        F.split("text", pattern, -1).alias("piece"), found.alias("match"), value.alias("value"))).alias("i", "x"))
    rows = rows.select("k1", "k2", "i", F.length("x.piece").alias("gap"), F.length("x.match").alias("len"),
                       F.when(F.col("x.match").isNotNull(), _keeps(kind, F.col("x.match"), F.col("x.value"))).alias("ok"))
    before = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(before)).where("ok")
    return rows.select("k1", "k2", F.lit(kind).alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans whose complementary parts are in scope."""
    binned = spans.withColumn("bin", F.expr(f"start div {scope}"))
    ends = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{n}_{r}")
            for r in "is" for n, f in (("first", F.min), ("last", F.max))]
    bins = binned.groupBy("k1", "k2", "bin").agg(*ends)
    names = [f"{n}_{r}" for r in "is" for n in ("first", "last")]
    # each bin meets the candidates of its own and both neighbouring bins
    near = bins.select("k1", "k2", F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), F.lit(d).alias("shift"))
                                                      for d in (-1, 0, 1)])).alias("b"), *names) \
        .select("k1", "k2", "b.bin", "b.shift", *names)
    weak = binned.where(F.col("kind").isin("ident", "bare", "endpoint"))
    start = F.col("start")

    def has(role: str) -> Column:
        return F.max(F.when(F.col("shift") == 0, F.col(f"first_{role}").isNotNull())
                     .when(F.col("shift") == 1, F.col(f"last_{role}") >= start - scope)
                     .otherwise(F.col(f"first_{role}") <= start + scope))

    seen = weak.join(near, ["k1", "k2", "bin"]).groupBy("k1", "k2", "kind", "start", "end") \
        .agg(has("i").alias("i"), has("s").alias("s"))
    need = F.when(F.col("kind") == "ident", F.col("s")).when(F.col("kind") == "bare", F.col("i")) \
        .otherwise(F.col("i") & F.col("s"))
    return seen.where(need).select("k1", "k2", "kind", "start", "end")


def find(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(k1, k2, spans)`` per distinct text with findings: structs (start, rank, kind, end) in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*_keys(t), t.alias("text")).where(F.col("text").rlike(SIGN)) \
        .groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = cut(texts, "secret-texts")
    parts = None
    for kind in KINDS:
        rows = _matches(texts, kind)
        parts = rows if parts is None else parts.unionByName(rows)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("kind")]
    parts = parts.select("*", rank.cast("int").alias("rank"), role.alias("role"))
    # a weak candidate inside or across a strong finding is that finding, not another one
    strong = F.col("rank") <= 3
    order = Window.partitionBy("k1", "k2").orderBy("start", "rank")
    left = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    parts = parts.withColumn("left", left).withColumn("right", right) \
        .where(strong | ((F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.col("right").isNull() | (F.col("right") >= F.col("end"))))) \
        .drop("left", "right")
    parts = cut(parts, "secret-parts")
    spans = parts.where(strong).select("k1", "k2", "kind", "start", "end").unionByName(_linked(parts, scope))
    spans = spans.withColumn("rank", rank.cast("int"))
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))


def _written(spans: Column) -> Column:
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.concat_ws(",", one)


def scan(docs: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(row, n_assign, n_access, n_hex, base_sha256, spans, n_linked, found)`` for every document."""
    found = find(docs, text, scope)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *_keys(F.coalesce(F.col(text), F.lit(""))))
    out = rows.join(found, ["k1", "k2"], "left")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    base = F.filter("found", lambda x: x["rank"] <= 3)

    def count(r: int) -> Column:
        return F.size(F.filter("found", lambda x: x["rank"] == r)).cast("long")

    return out.select("row", spans.alias("found")).select(
        "row", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("long").alias("n_linked"), "found")


def redact(scanned: DataFrame, text: str = "text", length: str = "n_chars", mask: str = MASK) -> DataFrame:
    """The kept rows of ``scan`` with every finding in ``row.text`` replaced by ``mask``.

    Overlapping findings are replaced as one stretch; ``row.n_chars``, where
    there is one, is corrected; a row without findings is unchanged.
    """
    t = F.col(f"row.{text}")
    # merged stretches: a finding that starts inside what is covered extends it
    empty = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(t, (acc["end"] + 1).cast("int"), F.greatest(F.lit(0).cast("bigint"), x["start"] - acc["end"]).cast("int"))
        fresh = F.concat(acc["parts"], F.array(gap, F.lit(mask)))
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"),
                        F.when((acc["end"] > x["start"]) & (F.size(acc["parts"]) > 0), acc["parts"]).otherwise(fresh).alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.concat_ws("", acc["parts"]), F.substring(t, (acc["end"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.when(F.size("found") > 0, F.aggregate("found", empty, step, finish)).otherwise(t)
    kinds = {f.name: f.dataType for f in scanned.schema["row"].dataType.fields}
    out = scanned.withColumn("clean", clean)
    new = {text: F.col("clean")}
    if length in kinds:
        new[length] = F.when(F.size("found") > 0, F.length("clean").cast(kinds[length])).otherwise(F.col(f"row.`{length}`"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in kinds])
