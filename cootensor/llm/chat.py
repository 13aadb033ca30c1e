"""Chat formatting: roles recovered by a hidden Markov model, then canonical turns.

The hidden states are roles, the observations lines.  A line shows its speaker
marker (``User:``, ``### Assistant``, ``[bot]`` and the like), its length, its
ending and how it begins; a row's first line, and any line with a marker, follows by
the turn transitions, other lines by the line transitions.  All tables are
counts over every labelled row of the training conversations (plus a prior that
ties a marker to the role it names).  Viterbi gives the best role per line;
neighbouring lines of one role are one turn, markers are dropped, and a turn is
rendered as ``<|role|>\\ntext<|end|>``.

Rows are range-sorted by conversation and turn.  A conversation inside one
sorted partition is decoded as it streams by.  One that crosses partitions or has
more than ``BLOCK`` rows is decoded in blocks: each block is reduced to the best
score between every two roles (max-plus matrices multiply in any grouping), the
blocks' boundary roles are resolved per conversation, then every block is decoded
between its boundary roles.  No conversation is gathered in one task.

Defined results.  Null text is one empty line.  A null ``conv_id`` makes a row a
conversation of its own.  Rows with equal turns are ordered by a hash of their
text; repeated rows stay rows.  Null roles are not trained on; without labelled
rows every role is ``user``.  Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import cut

BLOCK = 4096          # rows decoded in one piece
PRIOR = 50.0          # weight of "a marker names its role" against the counts
SMOOTH = 0.5
MAX_ROLES = 100

MARKERS = {"user": {"user", "human", "customer", "client", "question", "q", "prompt", "me"},
           "assistant": {"assistant", "ai", "bot", "gpt", "agent", "answer", "a", "model", "chatbot"},
           "system": {"system", "instruction", "instructions", "sys"}}
NAMED = {w: role for role, words in MARKERS.items() for w in words}
MARKER = re.compile(r"\s*(?:[#>*\-]+\s*)?(?:<\|(\w{1,12})\|>|\[(\w{1,12})\]:?|\*{0,2}(\w{1,12})\*{0,2}\s*:)\s*")
FEATURES = ("marker", "length", "lines", "end", "begin")


def features(line: str, lines: int) -> tuple:
    """Discrete observations of a line of a row with ``lines`` lines."""
    m = MARKER.match(line)
    name = NAMED.get(next(g for g in m.groups() if g).lower()) if m else None
    body = line.rstrip()
    return (name or "-", min(12, len(body).bit_length()), min(6, lines.bit_length()), body[-1:] if body[-1:] in "?!.:" else "-",
            "A" if body[:1].isupper() else "0" if body[:1].isdigit() else "-")


def strip_marker(line: str) -> str:
    m = MARKER.match(line)
    return line[m.end():] if m and next(g for g in m.groups() if g).lower() in NAMED else line


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass
class Model:
    """Log probabilities: ``start``, ``turn`` and ``line`` transitions, emission tables per feature."""

    roles: list[str]
    start: np.ndarray
    turn: np.ndarray
    line: np.ndarray
    emit: list[dict]
    unseen: list[np.ndarray]

    def scores(self, seen: tuple) -> np.ndarray:
        s = np.zeros(len(self.roles))
        for table, other, value in zip(self.emit, self.unseen, seen):
            s = s + table.get(value, other)
        return s

    def steps(self, rows: list[str | None], first: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(transition, emission) of every line; ``first``: the rows begin their conversation."""
        out = []
        for r, text in enumerate(rows):
            lines = _lines(text)
            for k, line in enumerate(lines):
                seen = features(line, len(lines))
                if k == 0 and r == 0 and first:
                    move = np.broadcast_to(self.start, self.turn.shape)
                else:
                    move = self.line if k and seen[0] == "-" else self.turn       # a speaker marker opens a turn
                out.append((move, self.scores(seen)))
        return out

    def decode(self, steps, entry: int | None = None, end: int | None = None) -> list[int]:
        """Best roles; ``entry``: role before the first line, ``end``: role of the last line, where they are fixed."""
        n = len(self.roles)
        v = np.zeros(n) if entry is None else np.where(np.arange(n) == entry, 0.0, -np.inf)
        back = []
        for move, e in steps:
            s = v[:, None] + move
            b = s.argmax(0)
            v = s[b, np.arange(n)] + e
            back.append(b)
        at = int(v.argmax()) if end is None else end
        path = [at]
        for b in reversed(back[1:]):
            at = int(b[at])
            path.append(at)
        return path[::-1]

    def matrix(self, steps) -> np.ndarray:
        """Best score from each role before the first line to each role of the last."""
        n = len(self.roles)
        m = np.where(np.eye(n) > 0, 0.0, -np.inf)
        for move, e in steps:
            m = (m[:, :, None] + move[None]).max(1) + e
        return m


def _sorted(turns: DataFrame, keep: list[str], conv: str, turn: str, text: str, role: str | None) -> DataFrame:
    alone = F.col(conv).isNull()
    src = turns.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(conv).cast("string").alias("conv"),
                       alone.alias("alone"), F.col(turn).alias("turn"), F.xxhash64(F.col(text)).alias("tie"),
                       F.col(text).alias("text"), (F.col(role) if role else F.lit(None)).cast("string").alias("role"))
    order = ["conv", "turn", "tie"]
    return src.repartitionByRange(*order).sortWithinPartitions(*order, "role")


def train(turns: DataFrame, training: Column, conv: str = "conv_id", turn: str = "turn", text: str = "text",
          role: str = "role") -> Model:
    """Tables counted over all rows with ``training`` and a role."""
    rows = _sorted(turns.where(training & F.col(role).isNotNull()), [], conv, turn, text, role)

    def count(batches):
        n: Counter = Counter()
        first = last = None
        for b in batches:
            for c, alone, x, r in zip(*(b.column(k).to_pylist() for k in ("conv", "alone", "text", "role"))):
                if last is None:
                    first = (c, alone, r)
                elif alone or last[0] != c:
                    n["start", "", r] += 1
                else:
                    n["turn", last[2], r] += 1
                last = (c, alone, r)
                lines = _lines(x)
                n["line", r, r] += len(lines) - 1
                for line in lines:
                    for name, value in zip(FEATURES, features(line, len(lines))):
                        n[name, str(value), r] += 1
        if last is not None:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"kind": k, "a": a, "b": r, "n": c, "pid": pid, "conv": None, "alone": None}
                                              for (k, a, r), c in n.items()] +
                                             [{"kind": k, "a": "", "b": e[2], "n": 0, "pid": pid, "conv": e[0], "alone": e[1]}
                                              for k, e in (("first", first), ("last", last))], schema)

    out = "kind string, a string, b string, n long, pid long, conv string, alone boolean"
    schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64()), ("pid", pa.int64()),
                        ("conv", pa.string()), ("alone", pa.bool_())])
    told = cut(rows.mapInArrow(count, out), "chat-counts")
    # the step from each partition to the next: one row per partition
    edge = told.where(F.col("kind").isin("first", "last")).withColumn("at", F.col("pid") * 2 + (F.col("kind") == "last").cast("int"))
    before = Window.orderBy("at")
    edge = edge.withColumns({"conv0": F.lag("conv").over(before), "role0": F.lag("b").over(before)}).where("kind = 'first'")
    same = (F.col("conv") == F.col("conv0")) & ~F.col("alone")
    edge = edge.select(F.when(same, "turn").otherwise("start").alias("kind"), F.when(same, F.col("role0")).otherwise("").alias("a"),
                       "b", F.lit(1).cast("long").alias("n"))
    counts = told.where(~F.col("kind").isin("first", "last")).select("kind", "a", "b", "n").unionByName(edge) \
        .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()          # roles x feature values
    return _model(counts)


def _model(counts) -> Model:
    roles = sorted({r.b for r in counts}) or ["user"]
    if len(roles) > MAX_ROLES:
        raise ValueError(f"{len(roles)} roles; is this the role column?")
    at = {r: i for i, r in enumerate(roles)}
    n = len(roles)
    start, turn, line = np.full(n, SMOOTH), np.full((n, n), SMOOTH), np.full((n, n), SMOOTH)
    line += np.eye(n) * PRIOR
    tables: list[dict] = [{} for _ in FEATURES]
    for r in counts:
        if r.kind == "start":
            start[at[r.b]] += r.n
        elif r.kind in ("turn", "line"):
            (turn if r.kind == "turn" else line)[at[r.a], at[r.b]] += r.n
        else:
            k = FEATURES.index(r.kind)
            value = int(r.a) if r.kind in ("length", "lines") else r.a
            tables[k].setdefault(value, np.zeros(n))[at[r.b]] += r.n
    total = sum(tables[0].values()) if tables[0] else np.zeros(n)
    total = total + 1
    for name in MARKERS:                       # the prior: one line in PRIOR has its role's marker, a hundredth of that another's
        row = tables[0].setdefault(name, np.zeros(n))
        row += total / PRIOR * np.array([1.0 if r == name else 0.01 for r in roles])
    tables[0].setdefault("-", np.zeros(n))[:] += 1
    emit, unseen = [], []
    for k, t in enumerate(tables):
        add = SMOOTH if k else 0.0
        whole = sum(t.values()) + SMOOTH * (len(t) + 1) if t else np.ones(n)
        emit.append({v: np.log((c + add) / whole) for v, c in t.items()})
        unseen.append(np.log(SMOOTH / whole))
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(roles, norm(start), norm(turn), norm(line), emit, unseen)


def render(text: str | None, roles: list[str]) -> tuple[str, int]:
    """Canonical turns of a row's lines, and how many."""
    turns: list[tuple[str, list[str]]] = []
    for line, r in zip(_lines(text), roles):
        if not turns or turns[-1][0] != r:
            turns.append((r, []))
        turns[-1][1].append(strip_marker(line))
    return "\n".join(f"<|{r}|>\n" + "\n".join(x).strip() + "<|end|>" for r, x in turns), len(turns)


def format_turns(turns: DataFrame, model: Model, keep: list[str], conv: str = "conv_id", turn: str = "turn",
                 text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(row, role_pred, n_turns, rendered)`` for every row; ``role_pred`` is the role of its first line."""
    shared = turns.sparkSession.sparkContext.broadcast(model)           # roles x roles and roles x feature values
    rows = _sorted(turns, keep, conv, turn, text, None).select("row", "conv", "alone", "text")
    extra = "text string, conv string, piece long, place long, opens boolean, role_pred string, n_turns long, rendered string"
    out = T.StructType([rows.schema["row"], *T._parse_datatype_string(extra).fields])
    names = out.names

    def runs(batches) -> Iterator[tuple]:
        """(rows, texts, conv, crosses the start, crosses the end, number) of conversations, in stretches of ``block`` rows."""
        held_rows, held_text, at, part, edge = [], [], None, 0, True
        for b in batches:
            r = b.column(0)
            for i, (c, alone, x) in enumerate(zip(*(b.column(k).to_pylist() for k in ("conv", "alone", "text")))):
                if held_text and (alone or c != at):
                    yield held_rows, held_text, at, edge, False, part
                    held_rows, held_text, part, edge = [], [], 0, False
                elif len(held_text) == block:
                    yield held_rows, held_text, at, edge, True, part
                    held_rows, held_text, part = [], [], part + 1
                at = None if alone else c
                held_rows.append((r, i))
                held_text.append(x)
        if held_text:
            yield held_rows, held_text, at, edge, True, part

    def decode(batches):
        m = shared.value
        pid = TaskContext.get().partitionId()
        got: list[tuple] = []
        for where, texts, c, starts, ends, part in runs(batches):
            # open: may go on in a neighbouring partition, or is one of several blocks
            is_open = c is not None and (starts or ends or part > 0)
            if is_open:
                for k, (w, x) in enumerate(zip(where, texts)):
                    got.append((w, x, c, pid << 32 | part, k, part == 0 and not starts, None, None, None))
            else:
                path, at = m.decode(m.steps(texts, True)), 0
                for w, x in zip(where, texts):
                    mine = [m.roles[p] for p in path[at:at + len(_lines(x))]]
                    at += len(mine)
                    text_out, n = render(x, mine)
                    got.append((w, None, None, None, None, None, mine[0], n, text_out))
            if len(got) >= 4096:
                yield emit(got)
                got = []
        if got:
            yield emit(got)

    def emit(got):
        kept = pa.concat_arrays([r.slice(i, 1) for (r, i), *_ in got])
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([kept, *[pa.array(c, t) for c, t in zip(zip(*[g[1:] for g in got]), types)]], names=names)

    told = cut(rows.mapInArrow(decode, out), "chat")
    done = told.where("piece is null").select("row", "role_pred", "n_turns", "rendered")
    pieces = told.where("piece is not null").select("row", "text", "conv", "piece", "place", "opens")

    # blocks of the conversations left open
    def ordered(t: pa.Table) -> pa.Table:
        return t.sort_by("place")

    def summary(t: pa.Table) -> pa.Table:
        t = ordered(t)
        opens = t["opens"][0].as_py()
        m = shared.value.matrix(shared.value.steps(t["text"].to_pylist(), opens))
        return pa.table({"conv": t["conv"][:1], "piece": t["piece"][:1], "opens": t["opens"][:1],
                         "matrix": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    def boundaries(t: pa.Table) -> pa.Table:
        """Entry and exit role of every block of one conversation."""
        m = shared.value
        t = t.sort_by("piece")
        n = len(m.roles)
        mats = [np.frombuffer(x.as_py(), "<f8").reshape(n, n) for x in t["matrix"]]
        v, back = np.zeros(n), []
        for x in mats:
            s = v[:, None] + x
            back.append(s.argmax(0))
            v = s.max(0)
        at, path = int(v.argmax()), []
        for b in reversed(back):
            path.append((int(b[at]), at))
            at = int(b[at])
        entry, end = zip(*path[::-1])
        return pa.table({"conv": t["conv"], "piece": t["piece"], "entry": pa.array(entry, pa.int64()), "end": pa.array(end, pa.int64())})

    # the first block of a conversation begins it, wherever the partition was cut
    first = pieces.groupBy("conv").agg(F.min("piece").alias("first"))
    pieces = cut(pieces.drop("opens").join(first, "conv").withColumn("opens", F.col("piece") == F.col("first")).drop("first"),
                 "chat-open")
    mats = pieces.select("conv", "piece", "place", "opens", "text").groupBy("conv", "piece") \
        .applyInArrow(summary, "conv string, piece long, opens boolean, matrix binary")
    ends = mats.groupBy("conv").applyInArrow(boundaries, "conv string, piece long, entry long, end long")

    def finish(t: pa.Table) -> pa.Table:
        t = ordered(t)
        m = shared.value
        texts = t["text"].to_pylist()
        path, at, res = m.decode(m.steps(texts, t["opens"][0].as_py()), t["entry"][0].as_py(), t["end"][0].as_py()), 0, []
        for x in texts:
            mine = [m.roles[p] for p in path[at:at + len(_lines(x))]]
            at += len(mine)
            res.append((mine[0], *reversed(render(x, mine))))
        cols = list(zip(*res))
        return pa.table({"row": t["row"], "role_pred": pa.array(cols[0]), "n_turns": pa.array(cols[1], pa.int64()),
                         "rendered": pa.array(cols[2])})

    row_type = T.StructType([pieces.schema["row"], *T._parse_datatype_string("role_pred string, n_turns long, rendered string").fields])
    last = pieces.join(ends, ["conv", "piece"]).groupBy("conv", "piece").applyInArrow(finish, row_type)
    return done.unionByName(last)
