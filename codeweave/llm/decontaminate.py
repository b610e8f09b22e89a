"""Benchmark decontamination by latent semantic retrieval.

Passages of `window` words are TF-IDF vectors over the benchmark's terms (other terms can't meet a query; the weight is 1 / sqrt(document
frequency), over all documents; very common terms are left out of the space, unless an item has no other). A distributed randomised SVD (random range finder, then
Rayleigh-Ritz on one more pass) of the corpus's passages, with the benchmark's own as weighted rows, gives a latent space of at most `dimensions`, however large the
benchmark is. Overlapping passages are projected and held against all benchmark items by cosine; candidates are verified by the longest common subsequence of words,
near-verbatim or, for paraphrases, a lower share together with the item's answer (its last words). What the verifier accepts doesn't hang on the
cosine or on the terms left out: stretches with enough of an item's rarer half of words (by an index from terms to items), or with its last words, are candidates too, and no leak
is outside those.

The benchmark is the query set: it is collected, behind a check of its size, and queried in groups of items whose matrices stay
under a bound. Items longer than a window are queried in parts. Nulls, empty texts
and items without words match nothing; an empty benchmark gives an empty result; repeated rows give one row for each document and item. Very long texts are cut
into windows like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Tables, mix, slices, span_hashes, tasks_for, text_bytes, unused, word_bounds

#: Greatest size of the benchmark's texts, in characters; beyond it, call with parts of the benchmark.
MOST_BENCHMARK = 64 << 20
#: Greatest number of entries of a matrix of terms and dimensions; items beyond it are queried in groups.
MOST_ENTRIES = 1 << 25
_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_SLICES = 16
#: Partial sums that are added in one step.
_GROUP = 16


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the total): A-Z lower-cased, without the signs around."""
    begin, end, first = word_bounds(raw, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), first
    for _ in range(3):
        end = end - (_EDGE[raw[end - 1]] & (end - begin > 1))
        begin = begin + (_EDGE[raw[begin]] & (end - begin > 1))
    return span_hashes(LOWER[raw], begin, end), first


def groups(rows: list[tuple], dimensions: int, most: int) -> list[list[tuple]]:
    """The items in groups with few enough entries (different words, at least the terms, times dimensions); one item at least."""
    out: list[list[tuple]] = [[]]
    seen: set[str] = set()
    for row in rows:
        own = set((row[1] or "").split())
        if out[-1] and len(seen | own) * dimensions > most:
            out.append([])
            seen = set()
        seen |= own
        out[-1].append(row)
    return out


@dataclass
class Benchmark:
    ids: list
    items: list[np.ndarray]  # word hashes
    terms: np.ndarray  # sorted
    likely: np.ndarray  # by the low 16 bits of a hash

    @classmethod
    def of(cls, rows: list[tuple]) -> Benchmark:
        ids, items = [], []
        for i, text in rows:
            w, _ = words(*text_bytes(pa.array([text or ""])))
            if len(w):
                ids.append(i)
                items.append(w)
        terms = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        likely = np.zeros(1 << 16, bool)
        likely[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(ids, items, terms, likely)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that are benchmark terms."""
        at = np.flatnonzero(self.likely[(h & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, h[at]), max(0, len(self.terms) - 1))
        hit = self.terms[term] == h[at]
        return at[hit], term[hit]


def _sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of rows) for sorted groups."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return groups[first], np.add.reduceat(values, first, axis=0)


def gram(places: np.ndarray, terms: np.ndarray, weight: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A basis) for the passages A given by the sorted passage and the term of each entry."""
    use = weight[terms] > 0
    places, terms = places[use], terms[use]
    for at in range(0, len(places), 1 << 16):
        p, t = places[at : at + (1 << 16)], terms[at : at + (1 << 16)]  # a passage cut here counts as two
        w = weight[t][:, None]
        _, y = _sums(basis[t] * w, p)
        row = np.cumsum(np.concatenate([[False], p[1:] != p[:-1]]))
        order = np.argsort(t, kind="stable")
        term, part = _sums(y[row[order]] * w[order], t[order])
        out[term] += part


def lcs(masks: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence of n words, given as bit masks of their places, and a text."""
    v = full = (1 << n) - 1
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def verify(item: np.ndarray, text: np.ndarray, answer: int, least: float = 0.5) -> tuple[float, bool, int]:
    """(largest share of the item's words in common with a stretch of 1.5 its length, whether its last words stand there, where); shares below `least` count as none."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    span, step = n + n // 2 + 1, max(1, n // 4)
    every, least = text.tolist(), -(-n * least // 1)
    last = item[-answer:].tolist()
    best = (0.0, False, 0)
    for at in range(0, max(1, len(every) - span + step), step):
        part = every[at : at + span]
        if sum(w in masks for w in part) < least:
            continue
        share = lcs(masks, n, part) / n
        if share > best[0]:
            found = any(part[i : i + len(last)] == last for i in range(len(part) - len(last) + 1))
            best = (share, found, at)
    return best


@dataclass
class Index:
    """From terms to the items in whose rarer half they are."""

    begin: np.ndarray  # of each term's items
    item: np.ndarray
    need: np.ndarray  # words of its rarer half that a leak of an item holds at least
    span: np.ndarray  # words of a stretch
    last: np.ndarray  # hashes of the items' last words, sorted
    ends: np.ndarray  # their items

    @classmethod
    def of(cls, bench: Benchmark, df: np.ndarray, verbatim: float, paraphrase: float, answer: int) -> Index:
        """A text with a share of an item's words lacks the others at most, so it holds the rest of any half. Of a paraphrase, which has the last words too,
        those are the candidates."""
        terms, items, need = [], [], np.ones(len(bench.items), np.int64)
        for i, words_ in enumerate(bench.items):
            n, term = len(words_), np.searchsorted(bench.terms, words_)
            share = verbatim if n >= answer else min(verbatim, paraphrase)
            half = np.argsort(df[term], kind="stable")[: n // 2 + 1]
            need[i] = max(1, len(half) - n + int(np.ceil(share * n - 1e-9)))
            terms.append(np.unique(term[half]))
            items.append(np.full(len(terms[-1]), i))
        term, item = np.concatenate(terms), np.concatenate(items)
        order = np.argsort(term, kind="stable")
        own = [i for i, x in enumerate(bench.items) if len(x) >= answer]
        last = np.array([_runs(bench.items[i][-answer:], answer)[0] for i in own], np.uint64)
        ends = np.argsort(last, kind="stable")
        spans = np.array([len(x) + len(x) // 2 + 1 for x in bench.items])
        return cls(np.searchsorted(term[order], np.arange(len(bench.terms) + 1)), item[order], need, spans, last[ends], np.array(own, np.int64)[ends])


def held(bench: Benchmark, index: Index, h: np.ndarray, first: np.ndarray, answer: int, block: int = 16) -> Iterator[tuple[int, int, int, int, bool]]:
    """(text, item, begin, end, by the answer): stretches of words outside which no leak can lie: those with enough of an item's
    rarer half, and those around its last words."""
    if not len(h):
        return
    at, term = bench.find(h)
    text = np.searchsorted(first, at, side="right") - 1
    # a number for each block of words, with a gap after each text, so that no stretch goes on into the next one
    widest = int(index.span.max()) // block + 3
    blocks = np.concatenate([[0], np.cumsum(-(-np.diff(first) // block) + widest)])
    many = index.begin[term + 1] - index.begin[term]
    which = np.repeat(np.arange(len(at)), many)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    item = index.item[index.begin[term[which]] + inside]
    key = item * int(blocks[-1]) + (blocks[text] + (at - first[text]) // block)[which]
    key, counts = np.unique(key, return_counts=True)
    total = np.concatenate([[0], np.cumsum(counts)])
    owner = key // int(blocks[-1])
    wide = (index.span[owner] - 2) // block + 2
    enough = np.flatnonzero(total[np.searchsorted(key, key + wide)] - total[:-1] >= index.need[owner])
    opens = np.ones(len(enough), bool)
    opens[1:] = key[enough[1:]] > key[enough[:-1]] + wide[enough[:-1]]
    begins = np.flatnonzero(opens)
    ends = np.append(begins[1:], len(enough)) - 1 if len(begins) else begins
    for a, b in zip(enough[begins].tolist(), enough[ends].tolist(), strict=True):
        i, place = int(owner[a]), int(key[a]) % int(blocks[-1])
        t = int(np.searchsorted(blocks, place, side="right") - 1)
        n = int(first[t + 1] - first[t])
        yield t, i, (place - int(blocks[t])) * block, min(n, (int(key[b]) % int(blocks[-1]) + int(wide[b]) - int(blocks[t])) * block), False
    runs = _runs(h, answer)
    low, high = (np.searchsorted(index.last, runs, side=side) for side in ("left", "right"))
    for p in np.flatnonzero(high > low).tolist():
        t = int(np.searchsorted(first, p, side="right") - 1)
        if p + answer <= first[t + 1]:
            for i in index.ends[low[p] : high[p]].tolist():
                yield t, i, p - int(first[t]), p - int(first[t]) + answer, True


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def around(item: np.ndarray, text: np.ndarray, begin: int, end: int) -> tuple[float, bool, int]:
    """As verify, of the stretches of 1.5 the item's length that hold the words from begin to end."""
    n, masks = len(item), {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    span, best = n + n // 2 + 1, (0.0, True, 0)
    for at in dict.fromkeys(max(0, x) for x in [*range(end - span, begin, max(1, n // 4)), begin]):
        share = lcs(masks, n, text[at : at + span].tolist()) / n
        best = max(best, (share, True, at), key=lambda x: x[0])
    return best


def contamination(
    df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = 64, dimensions: int = 256,
    cosine: float = 0.28, verbatim: float = 0.75, paraphrase: float = 0.5, answer: int = 5, common: float = 0.01, seed: int = 42,
) -> DataFrame:
    """(columns keep, default the id; item, cosine, lcs_share double, answer_found boolean, word long): the contaminated documents, a row for each
    benchmark item in them. Kept columns named like these are replaced. Four passes over the texts for each group of items; what they gather is bounded by
    MOST_ENTRIES (130,000 different words to a group), but for a single item of more."""
    spark = df.sparkSession
    new = [item_col, "cosine", "lcs_share", "answer_found", "word"]
    keep = [c for c in dict.fromkeys([id_col] if keep is None else [id_col, *keep]) if c == id_col or c.lower() not in new]
    text = unused([*keep, *new], "text")[0]
    size = benchmark.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if size > MOST_BENCHMARK:
        raise ValueError(f"the benchmark has {size} characters, more than {MOST_BENCHMARK}: pass it in parts")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = source.drop(text).schema
    for name, kind in zip(new, (benchmark.schema[item_col].dataType, "double", "double", "boolean", "long"), strict=True):
        schema = schema.add(name, kind)
    found, tables = None, Tables(spark, "leaks")
    for i, rows in enumerate(groups(benchmark.select(item_col, item_text).collect(), dimensions, MOST_ENTRIES)):
        bench = Benchmark.of(rows)
        if len(bench.terms):
            part = tables.put(_against(source, text, bench, keep, schema, window, dimensions, cosine, verbatim, paraphrase, answer, common, seed), str(i))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.struct("lcs_share", "cosine", "answer_found", -F.col("word"))
    best = found.groupBy(*[F.col(f"`{c}`") for c in keep], item_col).agg(F.max_by(F.struct("cosine", "lcs_share", "answer_found", "word"), rank).alias("x"))
    return best.select(*[F.col(f"`{c}`") for c in keep], item_col, "x.*")


def _against(
    source: DataFrame, text_name: str, bench: Benchmark, keep: list[str], schema: T.StructType, window: int, dimensions: int,
    cosine: float, verbatim: float, paraphrase: float, answer: int, common: float, seed: int,
) -> DataFrame:
    """The leaks of a group of items, in four passes over the texts; a document and item may come in several rows."""
    spark, n_terms, new = source.sparkSession, len(bench.terms), schema.names[len(keep) :]
    texts = source.select(text_name)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(n_terms, np.int64), 0
        for whole in batches:
            for batch in slices(whole, text_name):
                h, first = words(*text_bytes(batch.column(0)))
                at, term = bench.find(h)
                text = np.searchsorted(first, at, side="right") - 1
                counts += np.bincount(np.unique(text * n_terms + term) % n_terms, minlength=n_terms)
                n += batch.num_rows
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(counts[there], n))], names=["term", "n"])

    counts = dict(texts.mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    total = counts.pop(-1, 0)
    df_ = np.zeros(n_terms)
    df_[list(counts)] = list(counts.values())
    full = (1 / np.sqrt(np.maximum(df_, 1))).astype(np.float32)
    weight = np.where(df_ <= max(20.0, common * total), full, np.float32(0))

    parts = [(i, item[a : a + window]) for i, item in enumerate(bench.items) for a in range(0, len(item), window)]
    own_row = np.repeat(np.arange(len(parts)), [len(p) for _, p in parts])
    own_term = np.searchsorted(bench.terms, np.concatenate([p for _, p in parts]))
    k = min(n_terms, dimensions, len(parts) + 64)
    poor = np.bincount(own_row, weight[own_term] > 0, len(parts)) == 0  # all terms very common: those count after all
    often = own_term[poor[own_row]]
    weight[often] = full[often]
    # the parts as rows of unit length: sorted rows and the weights of their words
    same = own_row * n_terms + own_term
    _, inverse, repeats = np.unique(same, return_inverse=True, return_counts=True)
    norm = np.sqrt(np.bincount(own_row, weight[own_term].astype(np.float64) ** 2 * repeats[inverse], len(parts)))
    own_weight = (weight[own_term] / np.maximum(norm[own_row], 1e-9)).astype(np.float32)

    def own(x: np.ndarray) -> np.ndarray:
        """The parts' rows times a matrix of the terms."""
        out = np.zeros((len(parts), x.shape[1]), np.float32)
        for at in range(0, len(own_row), 1 << 16):
            row, part = _sums(x[own_term[at : at + (1 << 16)]] * own_weight[at : at + (1 << 16), None], own_row[at : at + (1 << 16)])
            out[row] += part
        return out

    def own_back(y: np.ndarray) -> np.ndarray:
        out, order = np.zeros((n_terms, y.shape[1]), np.float32), np.argsort(own_term, kind="stable")
        for at in range(0, len(order), 1 << 16):
            o = order[at : at + (1 << 16)]
            term, part = _sums(y[own_row[o]] * own_weight[o, None], own_term[o])
            out[term] += part
        return out

    def spread(basis: np.ndarray) -> np.ndarray:
        """A'(A basis) over all passages, summed by slices of the terms, and the benchmark's rows with the weight of the strongest term."""
        held = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(basis_shape, np.float32)
            for whole in batches:
                for batch in slices(whole, text_name):
                    h, first = words(*text_bytes(batch.column(0)))
                    at, term = bench.find(h)
                    text = np.searchsorted(first, at, side="right") - 1
                    gram(((at - first[text]) // window) + text * (1 << 32), term, weight, held.value, out)
            group = TaskContext.get().partitionId() // _GROUP
            for i in range(_SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([group]), pa.array([out[i::_SLICES].tobytes()], pa.binary())], names=["slice", "group", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i, g, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    more = np.frombuffer(part.as_buffer(), np.float32)
                    sums[i, g] = sums[i, g] + more if (i, g) in sums else more.copy()
            for (i, g), x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([g // _GROUP]), pa.array([x.tobytes()], pa.binary())], names=["slice", "group", "part"])

        basis_shape = basis.shape
        made = texts.mapInArrow(run, "slice long, group long, part binary")
        for level in range(3):  # a tree: a step adds _GROUP parts of a slice, so no task's share grows with the number of tasks
            made = made.repartition(max(_SLICES, tasks_for(source) // _GROUP**level), "slice", "group").mapInArrow(add, "slice long, group long, part binary")
        # what is left (a 4096th) is added by slice, so the driver gets one matrix however many tasks there were
        made = made.withColumn("group", F.lit(0).cast("long")).repartition(_SLICES, "slice").mapInArrow(add, "slice long, group long, part binary")
        out = np.zeros(basis_shape, np.float32)
        for i, _, part in made.collect():
            out[i::_SLICES] += np.frombuffer(part, np.float32).reshape(-1, basis_shape[1])
        held.unpersist()
        return out + 4 * own_back(own(basis))

    basis = np.linalg.qr(spread(np.random.default_rng(seed).standard_normal((n_terms, k)).astype(np.float32)))[0].astype(np.float32)
    small = basis.T @ spread(basis)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    latent = (basis @ turn[:, ::-1]).astype(np.float32)
    targets = own(latent)  # norm of the projection: how much of the query the space holds
    targets = targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)
    index = Index.of(bench, df_, verbatim, paraphrase, answer)
    shared = spark.sparkContext.broadcast((latent * weight[:, None], targets, bench, np.array([i for i, _ in parts]), index))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, targets, bench, item_of, index = shared.value
        floor = min(verbatim, paraphrase)
        queries_of = [slice(*np.searchsorted(item_of, [i, i + 1])) for i in range(len(bench.items))]
        half = window // 2
        for whole in batches:
            for batch in slices(whole, text_name):
                h, first = words(*text_bytes(batch.column(text_name)))
                sure = list(held(bench, index, h, first, answer))
                at, term = bench.find(h)
                use = weight[term] > 0
                at, term = at[use], term[use]
                text = np.searchsorted(first, at, side="right") - 1
                block = (at - first[text]) // half + text * (1 << 32)
                found: dict[tuple[int, int], tuple] = {}
                tried: set[tuple[int, int, int]] = set()
                for a in range(0, len(at), 1 << 15):
                    b = min(len(at), a + (1 << 15))
                    while b < len(at) and block[b] <= block[b - 1] + 1:  # whole windows
                        b += 1
                    lo = a
                    while lo > 0 and block[lo - 1] >= block[a] - 1:
                        lo -= 1
                    key, y = _sums(project[term[lo:b]], block[lo:b])
                    _, norm = _sums(weight[term[lo:b]].astype(np.float64) ** 2, block[lo:b])
                    pair = np.flatnonzero(key[1:] == key[:-1] + 1)
                    alone = np.setdiff1d(np.arange(len(key)), np.concatenate([pair, pair + 1]))
                    y = np.concatenate([y[pair] + y[pair + 1], y[alone]])
                    norm = np.sqrt(np.concatenate([norm[pair] + norm[pair + 1], norm[alone]]))
                    key = np.concatenate([key[pair], key[alone]])
                    score = (y @ targets.T) / np.maximum(norm, 1e-9)[:, None]
                    for w, q in zip(*np.nonzero(score >= cosine), strict=True):
                        i, t = int(item_of[q]), int(key[w] >> 32)
                        item, begin = bench.items[i], int(key[w] & 0xFFFFFFFF) * half
                        margin = max(half, len(item))
                        lo_w = max(0, begin - margin)
                        mark = (t, i, lo_w)
                        if mark in tried:
                            continue
                        tried.add(mark)
                        share, has, place = verify(item, h[first[t] + lo_w : min(first[t + 1], first[t] + begin + window + margin)], answer, floor)
                        if (share >= verbatim or share >= paraphrase and has) and share > found.get((t, i), (0, 0))[1]:
                            found[t, i] = (float(score[w, q]), share, has, lo_w + place)
                for t, i, begin, end, by_answer in sure:
                    item, whole_text = bench.items[i], h[first[t] : first[t + 1]]
                    share, has, place = around(item, whole_text, begin, end) if by_answer else verify(item, whole_text[begin:end], answer, floor)
                    place += 0 if by_answer else begin
                    if (share >= verbatim or share >= paraphrase and has) and share > found.get((t, i), (0, 0))[1]:
                        _, near = bench.find(whole_text[place : place + window])
                        y = project[near].sum(axis=0)
                        norm = max(float(np.sqrt((weight[near].astype(np.float64) ** 2).sum())), 1e-9)
                        found[t, i] = (float((targets[queries_of[i]] @ y).max(initial=0.0)) / norm, share, has, place)
                if found:
                    rows = pa.array([t for t, _ in found], pa.int64())
                    values = list(found.values())
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in keep], pa.array([bench.ids[i] for _, i in found]), *[pa.array([v[j] for v in values], kind) for j, kind in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.int64()))]], names=[*keep, *new])

    return source.mapInArrow(search, schema)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df without the contaminated documents, all columns as they are."""
    mark, own, of = unused(df.columns, "hash", "id", "of")
    hashed = df.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`")))
    found = contamination(hashed, benchmark, id_col=id_col, text_col=text_col, keep=[mark], **options)
    found = found.select(F.col(id_col).alias(own), F.col(mark).alias(of)).distinct()
    kept = hashed.join(found, hashed[id_col].eqNullSafe(found[own]) & (hashed[mark] == found[of]), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
