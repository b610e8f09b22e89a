"""Fill-in-middle: documents cut into prefix, middle and suffix at unit boundaries, by a byte automaton.

Units are `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+` over code points. One table-driven automaton knows the place within a UTF-8
character, white space or word, and how much of a sentinel stands behind it; each transition counts characters, unit begins and sentinels. The first scan
sums the transitions of every text; a second pass goes again over the few stretches that hold a cut and notes where it lies.

Texts are scanned in stretches side by side. The state at a stretch's begin follows from the four bytes before it; where it wouldn't (in damaged UTF-8),
the stretch is scanned together with the one before. So a very long text is no slower per byte than many short ones, and no text is ever cut short.

Null and empty texts are plain and have no unit. Repeated rows give repeated rows, the draws hang on the id alone, null ids count as an empty
one. Kept columns named like the operator's are replaced, in whatever case. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, slices, text_bytes, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: States: nothing read, after white space, after other characters, after `<`, after `<P`, `<S` or `<M`, and 1 to 3 bytes before a character's end.
START, BLANK, SOLID, OPEN, LETTER, LAST1, LAST2, LAST3 = range(8)
#: A transition's count: a character, the begin of a unit, the end of a sentinel.
CHAR, UNIT, MARK = 1, 1 << 21, 1 << 42
_LOW = (1 << 21) - 1
#: Bytes of a stretch; its counts must stay below 2^21.
STRETCH = 512


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, count) of state * 256 + byte."""
    to, count = np.zeros((8, 256), np.int64), np.zeros((8, 256), np.int64)
    for state in range(8):
        for byte in range(256):
            if state >= LAST1 and 0x80 <= byte < 0xC0:
                to[state, byte] = state - 1 if state > LAST1 else SOLID
                continue
            blank = bool(SPACE[byte])
            starts = state == START or (blank and state != BLANK)
            ends = state == LETTER and byte == ord(">")
            count[state, byte] = CHAR + UNIT * starts + MARK * ends
            if blank:
                to[state, byte] = BLANK
            elif byte == ord("<"):
                to[state, byte] = OPEN
            elif state == OPEN and byte in b"PSM":
                to[state, byte] = LETTER
            else:
                to[state, byte] = LAST1 if 0xC2 <= byte < 0xE0 else LAST2 if 0xE0 <= byte < 0xF0 else LAST3 if 0xF0 <= byte < 0xF5 else SOLID
    return to.ravel(), count.ravel()


NEXT, COUNT = _automaton()


def _begins(raw: np.ndarray, offsets: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, state) of all stretches; those whose state four bytes don't tell are left to the one before."""
    size = np.diff(offsets)
    parts = -(-size // stretch)
    text = np.repeat(np.arange(len(size)), parts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[text] + place * stretch
    inner = np.flatnonzero(place)
    able = np.ones((len(inner), 8), bool)
    able[:, START] = False
    for back in range(4, 0, -1):
        after = NEXT.reshape(8, 256)[:, raw[begin[inner] - back]].T
        new = np.zeros_like(able)
        for state in range(1, 8):
            rows = np.flatnonzero(able[:, state])
            new[rows, after[rows, state]] = True
        able = new
    state = np.full(len(text), START)
    state[inner] = able.argmax(1)
    known = np.ones(len(text), bool)
    known[inner] = able.sum(1) == 1
    return text[known], begin[known], state[known]


def _scan(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(counts, bytes read) of stretches; with need, each is read up to its need-th unit begin, whose byte isn't counted."""
    order = np.argsort(begin - end, kind="stable")
    at, left, state = begin[order], (end - begin)[order], state[order]
    sums, read = np.zeros(len(order), np.int64), left.copy()
    wanted, done = None if need is None else need[order], np.zeros(len(order), bool)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))
        key = state[:n] * 256 + raw[at[:n] + step]
        counts = COUNT[key]
        if wanted is not None:
            hit = ~done[:n] & ((sums[:n] >> 21 & _LOW) + (counts >> 21 & _LOW) >= wanted[:n])
            read[:n][hit] = step
            done[:n] |= hit
            counts[done[:n]] = 0
        sums[:n] += counts
        state[:n] = NEXT[key]
    out, stop = np.empty_like(sums), np.empty_like(read)
    out[order], stop[order] = sums, read
    return out, stop


class Scan:
    """The first pass over texts: n_chars, n_units and n_marks of each; `cut` is the second."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, stretch: int = STRETCH):
        self.raw, self.offsets = raw, offsets
        self.text, self.begin, self.state = _begins(raw, offsets, stretch)
        self.end = np.append(self.begin[1:], len(raw))
        counts, _ = _scan(raw, self.begin, self.end, self.state)
        self.chars, self.units = (np.append(0, np.cumsum(x)) for x in (counts & _LOW, counts >> 21 & _LOW))
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        self.n_chars, self.n_units = (np.diff(x[self.first]) for x in (self.chars, self.units))
        self.n_marks = np.diff(np.append(0, np.cumsum(counts >> 42))[self.first])

    def cut(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, characters) of each text's first so many units."""
        size, chars = np.diff(self.offsets)[texts], self.n_chars[texts].copy()
        inner = np.flatnonzero(units < self.n_units[texts])
        wanted = self.units[self.first[texts[inner]]] + units[inner] + 1
        lane = np.searchsorted(self.units[1:], wanted, "left")
        counts, read = _scan(self.raw, self.begin[lane], self.end[lane], self.state[lane], wanted - self.units[lane])
        size[inner] = self.begin[lane] + read - self.offsets[texts[inner]]
        chars[inner] = self.chars[lane] + (counts & _LOW) - self.chars[self.first[texts[inner]]]
        return size, chars


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits for an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Columns `keep` (default: all but the text) with n_units long, form (plain, psm or spm), prefix_chars and middle_chars long (code points; null if plain) and
    output string. A text is transformed in `rate` of 100 cases and of these comes suffix first in `spm` of 100; texts that hold a sentinel stay plain."""
    own = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in (keep if keep is not None else df.columns) if c.lower() not in {*own, text_col.lower()}]
    key, text = unused(keep, "key", "text")
    rows = df.select(*keep, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key), F.coalesce(text_col, F.lit("")).alias(text))
    schema = df.select(*keep).schema.add("n_units", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                raw, offsets = text_bytes(batch.column(text))
                scan = Scan(raw, offsets)
                h = np.array([draws(k, seed) for k in batch.column(key).to_pylist()], np.int64).reshape(-1, 4)
                n = scan.n_units
                moved = np.flatnonzero((n > 0) & (scan.n_marks == 0) & (h[:, 2] % 100 < rate))
                two = h[moved, :2] % (n[moved, None] + 1)
                a, a_chars = scan.cut(moved, two.min(1))
                b, b_chars = scan.cut(moved, two.max(1))
                form = np.full(len(n), "plain", object)
                form[moved] = np.where(h[moved, 3] % 100 < spm, "spm", "psm")
                data = raw.tobytes()
                texts = [data[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                for i, p, q in zip(moved.tolist(), a.tolist(), b.tolist(), strict=True):
                    prefix, middle, suffix = texts[i][:p], texts[i][p:q], texts[i][q:]
                    texts[i] = b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle if form[i] == "psm" else b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
                sizes = np.zeros((2, len(n)), np.int64)
                sizes[:, moved] = a_chars, b_chars - a_chars
                plain = form == "plain"
                chars = [pa.array(x, pa.int64(), mask=plain) for x in sizes]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone. Sentinels don't overlap themselves, so none arises where parts meet."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
