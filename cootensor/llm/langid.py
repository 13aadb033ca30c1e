"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample is built.  A
text is parsed greedily into the longest phrases that occur in the sample; a
text in the sample's language needs few phrases.  The score of a language is
``phrases * log2(sample length) / text length`` (bits per byte) and the lowest
wins.

Texts are handled as bytes: ASCII letters in lower case, every byte from 0x80 on
as itself, any run of other bytes as one separator.  A text is parsed in lanes of
``LANE`` bytes that step through all automata at once, so a very long text is just
more lanes; every byte of every text is read.

The sample bound (the only place where not all rows are used) is
``sample_rows`` rows and ``sample_bytes`` bytes per language; the row that reaches
it enters up to it.  An automaton takes some 3 MB, so the number of languages is
not limited by a table.

Defined results.  Null text, empty text or text without a letter: ``und``,
score 0.  Null ``lang`` or null ``doc_id``: never trained on, still predicted.
No labelled row at all: every text is ``und``.  Ties go to the smaller language
name.  Repeated rows are predicted row by row; extra columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .frames import annotate
from .text import LOWER, buffers, chunks

SAMPLE_ROWS = 64
SAMPLE_BYTES = 48_000
USUAL_CHARS = 4_000        # longer rows enter the sample only where shorter ones lack
LANE = 256
FOREIGN_BITS = 12.0        # bits per byte of a text no sampled language explains
RESULTS = "lang_pred string, score double, bits_per_byte double"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_KEEP = _LETTER.copy()
_KEEP[128:] = True


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every other run replaced by one 0, and the new row offsets."""
    low = LOWER[data]
    keep = _KEEP[low]
    sym = np.where(keep, low, 0)
    first = keep.copy()
    first[1:] |= keep[:-1]                       # a separator byte stays only after a kept byte
    first[off[:-1][off[:-1] < off[1:]]] = True
    return sym[first], np.concatenate([[0], np.cumsum(first)])[off]


def suffix_automaton(sym: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Transitions (state, symbol, next) and state count of the suffix automaton of ``sym``."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sym:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    flat = [(s, c, t) for s, d in enumerate(nxt) for c, t in d.items()]
    a = np.array(flat, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2], len(nxt)


def pack(s: np.ndarray, c: np.ndarray, n: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions as a double array: ``(first, slots)``.

    Symbol ``c`` of state ``s`` has slot ``first[s] + c``, which holds the owner in
    its upper and the next state in its lower 32 bits, so a slot of another
    state is told apart.  States with several symbols are placed by first fit, widest
    first; those with one fill the holes.
    """
    order = np.lexsort((c, s))
    s, c, n = s[order], c[order], n[order]
    count = np.bincount(s, minlength=states)
    begin = np.cumsum(count) - count
    wide = np.flatnonzero(count > 1)
    wide = wide[np.argsort(-count[wide], kind="stable")]
    size = 2 * len(s) + (1 << 16)
    used = np.zeros(size, bool)
    first = np.zeros(states, np.int64)
    low, window = 0, 2048
    for state in wide:
        own = c[begin[state]:begin[state] + count[state]]
        at = low
        while True:
            if at + window + 256 > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            bad = used[at + own[0]:at + own[0] + window].copy()
            for x in own[1:]:
                bad |= used[at + x:at + x + window]
            k = int(bad.argmin())
            if not bad[k]:
                break
            at += window
        first[state] = at + k
        used[at + k + own] = True
        if used[low + 256:low + 256 + window].mean() > 0.9:
            low += window // 4
    single = np.flatnonzero(count == 1)
    sym = c[begin[single]]
    free = np.flatnonzero(~used[256:])[:len(single)] + 256       # symbols are below 256: no slot starts below 0
    if len(free) < len(single):
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
    first[single] = free - sym
    slots = np.full(int(first.max(initial=0)) + 256, -1, np.int64)
    slots[first[s] + c] = s << 32 | n
    return first, slots


@dataclass
class Models:
    """Automata of all languages as double arrays, some 8 bytes a transition and state.

    ``parts``: (first, slots, sample bytes) of each language; (state, symbol, next,
    states, sample bytes) is packed here.
    """

    langs: list[str]
    parts: list[tuple]
    _table: tuple | None = field(default=None, repr=False)

    def __post_init__(self):
        self.parts = [p if len(p) == 3 else (*pack(*p[:4]), p[4]) for p in self.parts]

    def __getstate__(self):
        return {"langs": self.langs, "parts": self.parts, "_table": None}

    def table(self):
        """(first slot of each state, slots, root state of each language, next state and phrases closed
        where a phrase restarts, bits per phrase).

        A restart closes one phrase, two at a symbol the sample never has.
        """
        if self._table is None:
            firsts, slots, roots, again, closed = [], [], [], [], []
            states = at = 0
            for first, own, _ in self.parts:
                root = own[first[0]:first[0] + 256]
                known = root >> 32 == 0
                again.append(np.where(known, (root & 0xFFFFFFFF) + states, states))
                closed.append(np.where(known, 1, 2))
                firsts.append(first + at)
                slots.append(np.where(own >= 0, own + (states << 32 | states), -1))
                roots.append(states)
                states += len(first)
                at += len(own)
            bits = np.array([np.log2(max(2, p[2])) for p in self.parts])
            self._table = (np.concatenate(firsts).astype(np.int32), np.concatenate(slots), np.array(roots, np.int32),
                           np.stack(again).astype(np.int32), np.stack(closed).astype(np.int32), bits)
        return self._table

    def phrase_bits(self, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows x languages: bits the phrases of each row cost."""
        first, slots, start, again, cost, bits = self.table()
        n = np.diff(off)
        lanes = -(-n // LANE)
        row = np.repeat(np.arange(len(n)), lanes)
        k = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = off[:-1][row] + k * LANE
        size = np.minimum(LANE, off[1:][row] - at)
        order = np.argsort(-size, kind="stable")   # live lanes stay in front
        row, at, size = row[order], at[order], size[order]
        code = sym.astype(np.int32)
        steps = int(size[0]) if len(size) else 0
        left = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        closed = np.ones((len(start), len(row)), np.int32)
        state = np.repeat(start[:, None], len(row), 1)
        for i in range(steps):
            live = left[i]
            c = code[at[:live] + i]
            for lang in range(len(start)):
                now = state[lang, :live]
                v = slots[first[now] + c]
                miss = np.flatnonzero(v >> 32 != now)
                state[lang, :live] = v                     # the lower half
                state[lang, miss] = again[lang, c[miss]]
                closed[lang, miss] += cost[lang, c[miss]]
        out = np.zeros((len(n), len(start)))
        for lang in range(len(start)):
            out[:, lang] = np.bincount(row, closed[lang], len(n)) * bits[lang]
        return out

    def predict(self, col: pa.Array) -> list:
        data, off = buffers(col)
        pred: list[str] = []
        score, rate = np.zeros(len(col)), np.zeros(len(col))
        for i, j in chunks(off, 1 << 21):
            part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            if not self.langs:
                pred += ["und"] * (j - i)
                continue
            sym, so = _symbols(part, o)
            cost = self.phrase_bits(sym, so) / np.maximum(1, np.diff(so))[:, None]
            best = cost.argmin(1)
            low = cost[np.arange(j - i), best]
            others = cost.copy()
            others[np.arange(j - i), best] = np.inf
            second = others.min(1)
            score[i:j] = np.where(np.isinf(second), 1.0, 1 - low / np.maximum(second, 1e-12))
            rate[i:j] = low
            ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[LOWER[part]])])[o]
            for r in range(j - i):
                if ascii_letters[r + 1] > ascii_letters[r] or _has_letter(part[o[r]:o[r + 1]]):
                    pred.append(self.langs[best[r]])
                else:
                    pred.append("und")
                    score[i + r] = 0.0
        return [pa.array(pred, pa.string()), score, rate]


def _has_letter(data: np.ndarray) -> bool:
    return bool((data > 127).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


def train(labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang",
          sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Models:
    """Automata from a sample of ``labelled`` (rows with null language or text are left out).

    ``key`` orders the sample: the rows with the smallest hash of it are taken,
    so the choice does not depend on how the table is stored.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, F.col(text)).alias("k"))
    order = Window.partitionBy("lang").orderBy(F.col("long"), F.col("k"))
    chosen = rows.select("lang", "k", (F.length("text") > USUAL_CHARS).alias("long")) \
        .distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("k").sort_values("r")
        got = b""
        for t in pdf["text"]:
            if len(got) < sample_bytes:
                b = np.frombuffer(t.encode(), np.uint8)
                sym, _ = _symbols(b, np.array([0, len(b)]))
                got += sym.tobytes()[:sample_bytes - len(got)] + b"\0"
        first, slots = pack(*suffix_automaton(got))
        return pd.DataFrame([(pdf["lang"].iloc[0], first.astype("<i4").tobytes(), slots.astype("<i8").tobytes(), len(got))],
                            columns=["lang", "first", "slots", "size"])

    sample = rows.join(F.broadcast(chosen), ["lang", "k"]).dropDuplicates(["lang", "k"])  # bounded
    sample = sample.withColumn("text", F.substring("text", 1, sample_bytes))     # no more of a row can enter
    built = sample.groupBy("lang").applyInPandas(build, "lang string, first binary, slots binary, size long")
    parts = sorted(built.collect(), key=lambda r: r.lang)
    return Models([p.lang for p in parts],
                  [(np.frombuffer(p.first, "<i4").astype(np.int64), np.frombuffer(p.slots, "<i8"), p.size) for p in parts])


def identify(docs: DataFrame, models: Models, keep: list[str], text: str = "text") -> DataFrame:
    """``(row, lang_pred, score, bits_per_byte)`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    return annotate(docs, keep, {"text": F.col(text)}, lambda b: shared.value.predict(b.column("text")), RESULTS)
