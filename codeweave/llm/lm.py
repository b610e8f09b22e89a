"""LM scoring: a gated recurrent network over words, its softmax factored by classes.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. The network's units are frequent words, in classes by frequency, and tail
classes, which the other words share by their last two bytes. The probability of a frequent word is P(class | state) P(word | class, state), both softmaxes;
that of another P(tail class | state) times its training share of the tail class, with add-0.1 smoothing and one place for all unseen words.
The state is carried through the whole document, window by window.

Counts are exact, over all training documents. The network learns from all of them: they are dealt to rounds and, within a round, to logical shards of about
`shard_tokens` tokens by the hash of id and text; each shard is one run of truncated backpropagation in the order of the hashes, starting from the weights and the
optimiser's state that the round before left on average over its shards. How tables are partitioned changes none of this, and what is learnt from grows with the
input. Common words (at most `table` of them) are looked up in memory, all others by a join.

Nulls count as empty texts, which are one end. Null ids are held out. Without training documents the network stays at its start. Repeated rows are scored each; rows
that repeat an id and text are learnt from in one shard. Very long texts are one document of one stream; a window of them at a time is in the network.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, keep_freed, slices, unused
from .gru import Gru, Trainer

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Tail classes, by the last two bytes.
ENDINGS = 32
_SLICES = 8
#: Words that a task remembers the tail class of.
_REMEMBERED = 1 << 17


def tokens(data: bytes | None) -> list[bytes]:
    """The words; the end, which is the empty word, is not among them."""
    return data.translate(_LOWER).split() if data else []


def ending(word: bytes) -> int:
    """0 to ENDINGS - 1."""
    return (word[-1] * 31 + (word[-2] * 17 if len(word) > 1 else 0)) % ENDINGS


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 10."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Units(dict):
    """Units by word; words that aren't frequent get their tail class."""

    def __init__(self, single: dict[bytes, int]):
        super().__init__(single)
        self.first = len(single)

    def __missing__(self, word: bytes) -> int:
        unit = self.first + ending(word)
        if len(self) < _REMEMBERED:
            self[word] = unit
        return unit


def _texts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for whole in batches:
        for batch in slices(whole, column, most):
            yield batch, [tokens(x) for x in batch.column(column).cast(pa.binary()).to_pylist()]


def count_words(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word binary, n long) of the only column; the empty word counts the documents."""
    text = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        counts: Counter[bytes] = Counter()
        for batch, found in _texts(batches, text):
            for words in found:
                counts.update(words)
            counts[b""] += batch.num_rows
            if len(counts) >= flush:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_common(counts: DataFrame, most: int) -> tuple[int, dict[bytes, int]]:
    """(least count, words): all words of at least that count, at most `most`; found by a histogram, not by a sort."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    held, least = 0, None
    for row in sorted(histogram, key=lambda r: -r["level"]):
        if held + row["words"] > most:
            break
        held, least = held + row["words"], row["n"]
    if least is None:
        return 1 << 62, {}
    return least, {bytes(r[0]): r[1] for r in counts.where(F.col("n") >= least).collect()}


def rounds_of(ids: DataFrame, n_rounds: int, n_shards: int, long: int = 4096) -> list[DataFrame]:
    """(shard, place, ids) of each round, from (id, ids): every document is in one round and one of its shards, by the hash of id and units; place orders a
    shard, the documents of over `long` bytes first, so that streams end together."""
    place = F.xxhash64("id", "ids", F.lit(5))
    order = F.xxhash64("id", "ids", F.lit(6))
    order = F.when(F.octet_length("ids") > long, order.bitwiseOR(F.lit(-(1 << 63)))).otherwise(order.bitwiseAND(F.lit((1 << 63) - 1)))
    dealt = ids.select(F.pmod(place, F.lit(n_rounds)).alias("turn"), F.pmod(F.floor(place / n_rounds), F.lit(n_shards)).cast("int").alias("shard"), order.alias("place"), "ids")
    return [dealt.where(F.col("turn") == turn).drop("turn") for turn in range(n_rounds)]


def _train(ids: DataFrame, model: Gru, n_tokens: int, rates: tuple[float, ...], shard_tokens: int, updates: int, most_shards: int, fan_in: int = 64) -> Gru:
    """The model after one run over all documents of ids (id, ids binary: units of 16 bits). Shards' weights are summed in a tree of `fan_in` at a time."""
    spark = ids.sparkSession
    each = n_tokens / len(rates)
    shards = min(most_shards, max(1, round(each / shard_tokens)))
    lanes = int(min(192, max(4, each / shards / updates / 16)))
    for part, rate in zip(rounds_of(ids, len(rates), shards), rates, strict=True):
        start = spark.sparkContext.broadcast((model, model.flat()))

        def run(batches: Iterator[pa.RecordBatch], rate=rate, start=start) -> Iterator[pa.RecordBatch]:
            keep_freed()
            net, flat = start.value
            shard, trainer = None, None

            def end() -> Iterator[pa.RecordBatch]:
                if trainer is not None:
                    seen = trainer.finish()
                    out = net.flat() * seen
                    for i in range(_SLICES):
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([shard], pa.int64()), pa.array([np.append(out[i::_SLICES], seen).tobytes()], pa.binary())], names=["slice", "shard", "part"])

            for batch in batches:
                for s, x in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                    if s != shard:
                        yield from end()
                        shard, trainer = s, Trainer(net.load(flat), rate, lanes)
                    trainer.feed(np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64))
            yield from end()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, sums = None, None
            done = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([sums.tobytes()], pa.binary())], names=["slice", "shard", "part"])
            for batch in batches:
                for i, group, part in zip(batch.column("slice").to_pylist(), batch.column("group").to_pylist(), batch.column("part"), strict=True):
                    more = np.frombuffer(part.as_buffer())
                    if (i, group) == held:
                        sums = sums + more
                        continue
                    if held is not None:
                        yield done()
                    held, sums = (i, group), more.copy()
            if held is not None:
                yield done()

        made = part.repartitionById(shards, "shard").sortWithinPartitions("shard", "place").mapInArrow(run, "slice long, shard long, part binary")
        left = shards
        while True:
            left = -(-left // fan_in)
            made = made.withColumn("group", F.floor(F.col("shard") / fan_in)).repartition(min(_SLICES * left, 4096), "slice", "group").sortWithinPartitions("slice", "group", "shard").mapInArrow(add, "slice long, shard long, part binary")
            if left == 1:
                break
        summed = made.collect()
        if summed:
            flat = model.flat()
            for i, _, x in summed:
                x = np.frombuffer(x)
                flat[i::_SLICES] = x[:-1] / x[-1]
            model.load(flat)
        start.unpersist()
    return model


def score(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, table: int = 1 << 18, singles: int = 256, hidden: int = 20,
    rates: tuple[float, ...] = (0.015, 0.01, 0.005, 0.002), shard_tokens: int = 1 << 20, updates: int = 200, most_shards: int = 1 << 14,
) -> DataFrame:
    """Columns `keep` (default: the id) with held_out boolean, n_tokens, n_known, train_tokens long, base_score and score double (log10).
    Kept columns named like these are replaced.

    Two passes over the texts, counting and coding; then one over the training documents' codes for learning, in rounds, and one over all for scoring. The driver
    holds `table` words and the network; small tables have fewer streams, for `updates` steps a shard, and beyond `most_shards` shards they grow longer instead of more."""
    spark = df.sparkSession
    tables = Tables(spark, "lm")
    new = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in dict.fromkeys([id_col] if keep is None else [id_col, *keep]) if c.lower() not in new]
    text, known_, base_, own_, rest_, ids_, row_, more_, logs_ = unused([*keep, *new, "n", "word"], "text", "known", "base", "own", "rest", "ids", "row", "more", "logs")
    source = df.select(*[F.col(f"`{c}`") for c in keep], held_out(F.col(f"`{id_col}`")).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    counts = tables.put(count_words(source.where(~F.col("held_out")).select(text)), "counts")
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, known = most_common(counts, table)
    frequent = sorted(known, key=lambda w: (-known[w], w))[:singles]
    if b"" not in frequent:
        frequent[singles - 1 :] = [b""]
    single = {w: i for i, w in enumerate(frequent)}
    n_single, end = len(single), single[b""]
    units = n_single + ENDINGS

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = np.zeros((units, 2), np.int64), Units(single)
        for batch in batches:
            c = np.array([of[w] for w in batch.column(0).to_pylist()], np.int64)
            held[:, 0] += np.bincount(c, batch.column(1).to_numpy(zero_copy_only=False), units).astype(np.int64)
            held[:, 1] += np.bincount(c, minlength=units)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(units)), pa.array(held[:, 0].copy()), pa.array(held[:, 1].copy())], names=["unit", "n", "words"])

    held = np.zeros((units, 2))
    for c, n, distinct in counts.mapInArrow(by_unit, "unit long, n long, words long").groupBy("unit").agg(F.sum("n"), F.sum("words")).collect():
        held[c] = n, distinct
    below = np.log10(held[:, 0] + 0.1 * (held[:, 1] + 1))
    words_ = spark.sparkContext.broadcast((list(known), np.array(list(known.values()), np.float64)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        listed, counted = words_.value
        of, places, none = Units(single), {w: i for i, w in enumerate(listed)}, len(listed)
        unit_of = np.array([*(of[w] for w in listed), 0], np.int64)
        log_count = np.append(np.log10(counted + 0.1), 0.0)
        in_class = np.where(unit_of < n_single, 0.0, log_count - below[unit_of])
        in_class[none] = 0.0
        end_count = float(np.log10((counted[places[b""]] if b"" in places else 0) + 0.1))
        for batch, found in _texts(batches, text):  # all words of a batch at once
            n, words = len(found), list(chain.from_iterable(found))
            sizes = np.fromiter(map(len, found), np.int64, n)
            doc, ends = np.repeat(np.arange(n), sizes), np.cumsum(sizes)
            at = np.array(list(map(places.get, words, repeat(none))), np.int64)
            rare = np.flatnonzero(at == none)
            tail = [words[i] for i in rare.tolist()]
            others, rares = np.array([of[w] for w in tail], np.int64), np.bincount(doc[rare], minlength=n)
            c = unit_of[at].astype(np.uint16)
            c[rare] = others
            base = np.bincount(doc, log_count[at], n) + end_count
            own = np.bincount(doc, in_class[at], n) - np.bincount(doc[rare], below[others], n)
            starts = np.append(0, (ends + np.arange(1, n + 1)) * 2).astype(np.int32)
            codes = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts), pa.py_buffer(np.insert(c, ends, end))])
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rares)).astype(np.int32)), pa.array(tail, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], batch.column("held_out"), pa.array(sizes + 1), pa.array(sizes - rares + (n_all > 0)), pa.array(base), pa.array(own), codes, rest],
                names=[*keep, "held_out", "n_tokens", known_, base_, own_, ids_, rest_],
            )

    schema = source.drop(text).schema.add("n_tokens", "long").add(known_, "long").add(base_, "double").add(own_, "double").add(ids_, "binary")
    coded = source.mapInArrow(code, schema.add(rest_, T.ArrayType(T.BinaryType()))).withColumn(row_, F.monotonically_increasing_id())
    coded = tables.put(coded, "coded")  # from here on the row numbers are fixed
    training = coded.where(~F.col("held_out")).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(ids_).alias("ids"))
    model = _train(training, Gru(n_single, ENDINGS, hidden, end, held[:, 0]), n_all, rates, shard_tokens, updates, most_shards)
    net_ = spark.sparkContext.broadcast(model)
    passed = [*keep, "held_out", "n_tokens", known_, base_, own_, row_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        net = net_.value
        for whole in batches:
            for batch in slices(whole, ids_, 1 << 22):  # many documents at once, so that few steps have few of them
                got = net.score([np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in batch.column(ids_)])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(got)], names=[*passed, "score"])

    first = coded.select(*[F.col(f"`{c}`") for c in passed], ids_)
    first = first.mapInArrow(run, first.drop(ids_).schema.add("score", "double"))
    rest = coded.select(row_, F.explode(rest_).alias("word")).join(counts.where(F.col("n") < least), "word", "left")
    rest = rest.groupBy(row_).agg(F.count("n").alias(more_), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias(logs_))
    out = first.join(rest, row_, "left")
    logs = F.coalesce(logs_, F.lit(0.0))
    every = float(np.log10(n_all + 0.1 * (n_distinct + 1)))
    return out.select(
        *[F.col(f"`{c}`") for c in keep], "held_out", "n_tokens", (F.col(known_) + F.coalesce(more_, F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col(base_) + logs - F.col("n_tokens") * every).alias("base_score"), (F.col("score") + F.col(own_) + logs).alias("score"),
    )
