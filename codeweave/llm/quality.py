"""Quality classifier by importance resampling.

Each document is the set of its hashed n-grams: words (runs of letters, digits or other signs, A-Z lower-cased), their
first four bytes, words that make up much of the document, and pairs of word shapes (kind, case, repeats). Two generative models give each n-gram's chance in a target document (labelled good, not
toxic) and in a raw one (all documents); a document's log weight is the sum of the log ratios. N-grams whose labels don't
tell target from rejected documents (`ratio` times rarer in target documents at least, and a binomial test corrected for the number of n-grams) count as equally likely under both, so clean
documents weigh alike at any length. Gumbel noise is added to the weights and the top k are the sample, drawn without replacement in proportion to
the weights; k is the sum of the weights, one at most each. The test is fitted on a bounded sample of labelled rows (`most_labelled` of either
label, by the hash of the id), from which near copies are dropped, so that a document that was copied often speaks once.
The raw model covers all rows.

Nulls and empty texts have no n-grams and weight one. Without target or rejected labels everything stays. Labels of one id in several rows
count as toxic, or bad, if any is. Ties at the last place all stay; repeated rows stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, Tables, mix, slices, span_hashes, text_bytes, unused

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 24
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 other signs
_KIND[SPACE] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


#: Minimum hashes of word triples by which near copies among the labelled rows are told.
SKETCH = 4


def _sketch(word: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Minimum hashes of the word triples of each text (of its shorter runs, if it has no triple)."""
    triple = word.copy()
    for step, factor in ((1, 3), (2, 5)):
        same = text[step:] == text[:-step]
        triple[:-step][same] += mix(word[step:][same] + np.uint64(factor))
    first = np.searchsorted(text, np.arange(texts))
    there = np.append(first[1:], len(text)) > first
    out = np.zeros((texts, SKETCH), np.uint64)
    for i in range(SKETCH):
        out[there, i] = np.minimum.reduceat(mix(triple + np.uint64(i)), first[there])
    return out


def ngrams(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the n-grams of the texts, each once a text, in order; fills `sketches`, if given."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none
    kind = _KIND[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(raw))
    solid = kind[begin] > 0
    begin, end = begin[solid], end[solid]
    if not len(begin):
        return none, none
    text = np.searchsorted(offsets, begin, side="right") - 1
    word = span_hashes(LOWER[raw], begin, end)
    if sketches is not None:
        sketches[:] = _sketch(word, text, len(offsets) - 1)
    capitals = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_UPPER[raw], out=capitals[1:])
    size = end - begin
    shape = kind[begin].astype(np.uint64) * np.uint64(8)
    shape += ((capitals[end] - capitals[begin]) * 2 > size).astype(np.uint64) * np.uint64(4)
    letters = kind[begin] == 1
    at = np.flatnonzero(letters)  # repeats: the same word as the word before
    again = np.zeros(len(begin), bool)
    again[at[1:]] = (word[at[1:]] == word[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    shape += again.astype(np.uint64)
    twice = np.zeros(len(begin), bool)
    twice[at[2:]] = again[at[2:]] & again[at[1:-1]]
    shape += twice.astype(np.uint64)
    same = text[1:] == text[:-1]
    pair = mix(shape[:-1] * np.uint64(1 << 20) + shape[1:] + np.uint64(1 << 50))[same]
    stem = letters & (size > 4)
    stems = mix(span_hashes(LOWER[raw], begin[stem], begin[stem] + 4) + np.uint64(1))
    most = np.uint64(buckets)
    words, counts = np.unique(text.astype(np.uint64) * most + word % most, return_counts=True)
    held = np.bincount(text, minlength=len(offsets) - 1)
    dense = words[(counts >= 4) & (counts * 12 >= held[(words // most).astype(np.int64)])]
    dense = dense // most * most + mix(dense % most + np.uint64(1 << 51)) % most
    keys = np.unique(np.concatenate([words, dense, text[stem].astype(np.uint64) * most + stems % most, text[1:][same].astype(np.uint64) * most + pair % most]))
    return (keys // np.uint64(buckets)).astype(np.int64), (keys % np.uint64(buckets)).astype(np.int64)


def _log_tail(a: int, n: int, p: float) -> float:
    """log of the chance of at most a of n, each with chance p (a bound by the largest term where a < n p)."""
    terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) for k in range(max(0, a - 60), a + 1)]
    top = max(terms)
    return top + log(sum(np.exp(np.array(terms) - top)))


def weigh(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most_labelled: int = 20_000, least: int = 5, ratio: float = 20.0, error: float = 0.1, buckets: int = BUCKETS, table: Tables | None = None) -> DataFrame:
    """Columns `keep` (default: the id) with log_weight double (0 or less) and n_telling int, the telling n-grams found.

    Two passes over the texts: the sampled labelled documents for the test, all documents for the raw model and the weights. The driver holds
    the hashes of most_labelled ids of either label and the telling n-grams, buckets at most in number."""
    tables = table or Tables(df.sparkSession, "quality")
    keep = [c for c in dict.fromkeys([id_col] if keep is None else [id_col, *keep]) if c.lower() not in ("log_weight", "n_telling")]
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.xxhash64(id_col).alias("h")).agg((F.min(F.coalesce("quality", F.lit(0))) * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("int").alias("good"))
    some = {g: np.sort(np.array([r[0] for r in marks.where(F.col("good") == g).select("h").orderBy(F.xxhash64("h")).limit(most_labelled).collect()], np.int64)) for g in (0, 1)}
    chosen = np.concatenate([some[0], some[1]])
    good = np.repeat([False, True], [len(some[0]), len(some[1])])[np.argsort(chosen)]
    chosen = np.sort(chosen)
    texts = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text")).where(F.col(f"`{id_col}`").isNotNull())
    read = tables.put(texts.mapInArrow(lambda b: _labelled(b, chosen, good, buckets), f"row long, good boolean, buckets array<long>, {', '.join(f'k{i} long' for i in range(SKETCH))}"), "labelled")
    apart = read.drop("buckets")
    for i in range(SKETCH):
        apart = apart.groupBy(f"k{i}", "good").agg(F.min_by(F.struct("row", *[f"k{j}" for j in range(SKETCH) if j > i]), "row").alias("x")).select("good", "x.*")
    counted = read.join(apart.select("row"), "row", "left_semi").select("good", F.explode(F.concat("buckets", F.array(F.lit(-1)).cast("array<long>"))).alias("bucket"))
    counted = counted.groupBy("bucket").agg(F.count_if("good").alias("target"), F.count_if(~F.col("good")).alias("rejected"))
    counted = tables.put(counted, "counted")
    total = counted.where("bucket < 0").first()
    n_target, n_rejected = (total["target"], total["rejected"]) if total else (0, 0)
    telling: dict[int, int] = {}
    if n_target and n_rejected:
        able = counted.where((F.col("bucket") >= 0) & (F.col("target") + F.col("rejected") >= least))
        share, tests = n_target / (n_target + n_rejected), max(1, able.count())
        fit = able.where((F.col("rejected") >= least) & (F.col("target") * n_rejected * ratio < F.col("rejected") * n_target)).toLocalIterator(prefetchPartitions=True)
        telling = {r["bucket"]: r["target"] for r in fit if _log_tail(r["target"], r["target"] + r["rejected"], share) < log(error / tests)}
    known = np.array(sorted(telling), np.int64)
    text_, found_ = unused([*keep, "log_weight", "n_telling"], "text", "found")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text_))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_):
                text, bucket = ngrams(*text_bytes(batch.column(text_)), buckets)
                hit = np.isin(bucket, known)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[hit], np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(np.searchsorted(known, bucket[hit])))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, found_])

    found = tables.put(source.mapInArrow(find, source.drop(text_).schema.add(found_, T.ArrayType(T.LongType()))), "found")
    n_raw = found.count()
    raw = dict(found.select(F.explode(found_).alias("i")).groupBy("i").count().collect())
    ratio = [min(0.0, log((telling[b] + 0.5) / (n_target + 1)) - log((raw.get(i, 0) + 0.5) / (n_raw + 1))) for i, b in enumerate(known.tolist())]

    @F.arrow_udf(T.DoubleType())
    def weight(lists: pa.Array) -> pa.Array:
        r = np.array([*ratio, 0.0])
        return pa.array([float(r[np.array(x, np.int64)].sum()) if x else 0.0 for x in lists.to_pylist()])

    return found.select(*[F.col(f"`{c}`") for c in keep], weight(found_).alias("log_weight"), F.size(found_).alias("n_telling"))


def _labelled(batches: Iterator[pa.RecordBatch], chosen: np.ndarray, good: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(row, good, buckets, sketch) of the rows whose id is chosen. row: a hash of id and content, so it is the same if the task runs again."""
    if not len(chosen):
        return
    for whole in batches:
        for batch in slices(whole, "text"):
            h = batch.column("h").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
            there = np.flatnonzero(chosen[at] == h)
            if not len(there):
                continue
            raw, offsets = text_bytes(batch.column("text").take(pa.array(there)))
            sketches = np.zeros((len(there), SKETCH), np.uint64)
            text, bucket = ngrams(raw, offsets, buckets, sketches)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(there) + 1)).astype(np.int32)), pa.array(bucket))
            row = mix(h[there].view(np.uint64) ^ mix(sketches[:, 0] + offsets[1:].astype(np.uint64) - offsets[:-1].astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(good[at[there]]), lists, *[pa.array(sketches[:, i].copy().view(np.int64)) for i in range(SKETCH)]], names=["row", "good", "buckets", *[f"k{i}" for i in range(SKETCH)]])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, exactly, by histograms that narrow down on it; a few numbers reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    above = 0
    values = df.select(column)
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        part = values.where((F.col(column) >= low) & (F.col(column) <= high))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width))
        counts = {r[0]: (r[1], r[2], r[3]) for r in part.groupBy(bin_.alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if above + n >= k:
                low, high = least, most
                break
            above += n
        else:
            return low
    return low


def resample(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, temperature: float = 0.2, seed: int = 42, k: int | None = None, **fit) -> DataFrame:
    """The sample: columns `keep` (default: the id) with log_weight, n_telling and gumbel_key, top k by the key log_weight / temperature + noise.
    k: by default the sum of the weights min(1, w). The noise hangs on id, text and seed only."""
    tables = Tables(df.sparkSession, "resample")
    mark = unused([*df.columns, "log_weight", "n_telling", "gumbel_key"], "hash")[0]
    hashed = df.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`")))
    kept = [id_col] if keep is None else [c for c in dict.fromkeys([id_col, *keep])]
    rows = weigh(hashed, labels, id_col=id_col, text_col=text_col, keep=[*kept, mark], table=tables, **fit)
    u = (F.xxhash64(F.col(f"`{id_col}`"), mark, F.lit(seed)).cast("double") + 2.0**63 + 1024) / (2.0**64 + 4096)
    rows = rows.withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(u)))
    rows = tables.put(rows, "keys")
    if k is None:
        k = round(rows.agg(F.coalesce(F.sum(F.exp(F.least(F.lit(0.0), F.col("log_weight") / temperature))), F.lit(0.0))).first()[0])
    last = kth_largest(rows, "gumbel_key", k)
    rows = rows.where(F.col("gumbel_key") >= last) if last is not None else rows.limit(0)
    return rows.drop(mark)


def keep_sample(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that the sample holds, all columns as they are."""
    mark, own, of = unused([*df.columns, "log_weight", "n_telling", "gumbel_key"], "mark", "id", "of")
    hashed = df.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`")))
    sample = resample(hashed, labels, id_col=id_col, text_col=text_col, keep=[mark], **options).select(F.col(id_col).alias(own), F.col(mark).alias(of)).distinct()
    kept = hashed.join(sample, hashed[id_col].eqNullSafe(sample[own]) & (hashed[mark] == sample[of]), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
