"""Language identification: a unigram model of pieces for each language, all segmentations of a text summed.

The vocabulary is a fixed public one of sentencepiece: its pieces as bytes, single bytes among them, so every text has a segmentation. A language's piece
probabilities are the expected counts of pieces in its training texts, where each segmentation of a word counts by its number of pieces (one expectation
step from equal probabilities), smoothed. A text's likelihood in a language is the product over its words of the sum over all segmentations, by the forward
algorithm; the prediction is the language of the largest likelihood times share of training documents, the score its posterior probability.

Texts are lower-cased; words [^\\x20\\x09-\\x0D]+ begin with the piece's mark for a word. Longer words than `LONGEST` bytes, marks included, are cut into stretches
of at most that at character boundaries, each segmented by itself; every stretch counts. Expected counts are whole multiples of 1 / UNIT for each distinct word,
so sums don't hang on the partitions.

Null texts and those without a letter are `und` with score 0, as all are where nothing can be learnt from. Null ids are held out like an id of no text. Repeated
rows are learnt from and predicted each. A task holds a slice of texts, at most `held` distinct words and the model of one block of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, slices, unused

WORD_MARK = "▁"
LONGEST = 64
UNIT = 1 << 12
#: Languages whose model is in memory at once; more are scored block by block.
BLOCK = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Powers of e that a plain sum may fall to.
_RANGE = 600
#: More than any place in a stretch; a place and a length fit in 16 bits.
_SPAN = 128
#: Words whose segmentations are in memory at once.
CHUNK = 1 << 16


class Pieces:
    """The vocabulary as a byte trie in arrays; piece i has the bytes pieces[i]."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.most = len(pieces), max(map(len, pieces))
        edges: dict[int, int] = {}
        ids = [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                node = edges.setdefault(key, len(ids))
                if node == len(ids):
                    ids.append(-1)
            ids[node] = i
        self.ids = np.array(ids, np.int32)
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, node in edges.items():
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.to[at] = key, node

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.to[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out

    def matches(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every piece at every byte; ends: each byte's word's end."""
        at = np.arange(len(raw))
        node, begins, stops, ids = np.zeros(len(raw), np.int32), [], [], []
        for step in range(self.most):
            inside = at + step < ends[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = self._child(node, raw[at + step])
            alive = node > 0
            at, node = at[alive], node[alive]
            piece = self.ids[node]
            hit = piece >= 0
            begins.append(at[hit])
            stops.append(at[hit] + step + 1)
            ids.append(piece[hit])
        return (np.concatenate(begins), np.concatenate(stops), np.concatenate(ids)) if begins else (np.zeros(0, np.int64),) * 3


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Pieces:
    """The pieces of a sentencepiece model by their bytes, with all single bytes; controls are left out. Once for each worker process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    texts = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Pieces(list(dict.fromkeys([*texts, *(bytes([b]) for b in range(256))])))


class Lattice:
    """All segmentations of distinct words, side by side."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(self.size)
        first = stop - self.size
        begin, end, self.piece = pieces.matches(raw, np.repeat(stop, self.size))
        self.word = np.repeat(np.arange(len(words)), self.size)[begin]
        self.base = first + np.arange(len(words))
        self.begin, self.end = begin - first[self.word], end - first[self.word]
        self.slots = len(raw) + len(words)

    def _steps(self, forward: bool) -> list[np.ndarray]:
        """Arcs in parts by place, from the begin or from the end, and length; those of a part have different targets, as pieces of one length are found in the words' order."""
        place, length = (self.end if forward else self.begin), self.end - self.begin
        key = (place * _SPAN + length).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []
        return parts if forward else parts[::-1]

    def _sums(self, weight: np.ndarray, forward: bool) -> np.ndarray:
        """Sums over all ways from the begin to each place, or from each place to the end; weight: of each arc."""
        out = np.zeros(self.slots)
        out[self.base if forward else self.base + self.size] = 1
        source, target = (self.begin, self.end) if forward else (self.end, self.begin)
        base = self.base[self.word]
        source, target = base + source, base + target
        for arcs in self._steps(forward):
            into = target.take(arcs)
            out[into] = out.take(into) + out.take(source.take(arcs)) * weight.take(arcs)
        return out

    def expected(self) -> np.ndarray:
        """Each arc's share of its word's segmentations, if all pieces are equally likely. A factor for each byte keeps the sums in range and cancels out."""
        weight = np.exp(2.0 * (self.end - self.begin) - 10.4)
        before, after = self._sums(weight, True), self._sums(weight, False)
        base = self.base[self.word]
        return before[base + self.begin] * weight * after[base + self.end] / after[base]

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """ln of the sum over all segmentations for each word and column of p (pieces by languages); in logarithms if a word is too long for plain sums."""
        plain = -np.log(p.min(initial=1)) * self.size.max(initial=0) < _RANGE
        p = p if plain else np.log(p)
        sums = np.full((self.slots, p.shape[1]), 0.0 if plain else -np.inf)
        sums[self.base] = 1 if plain else 0
        base = self.base[self.word]
        source, target = base + self.begin, base + self.end
        for arcs in self._steps(True):
            into = target.take(arcs)
            before, ways, here = sums.take(source.take(arcs), 0), p.take(self.piece.take(arcs), 0), sums.take(into, 0)
            sums[into] = here + before * ways if plain else np.logaddexp(here, before + ways)
        out = sums[self.base + self.size]
        return np.log(out) if plain else out


def log_likelihood(pieces: Pieces, found: list[bytes], p: np.ndarray) -> np.ndarray:
    """That of all words, the short ones by plain sums."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    short = size * -np.log(p.min()) < _RANGE
    out = np.zeros((len(found), p.shape[1]))
    for some in (np.flatnonzero(short), np.flatnonzero(~short)):
        for i in range(0, len(some), CHUNK):
            part = some[i : i + CHUNK]
            out[part] = Lattice(pieces, [found[j] for j in part]).log_likelihood(p)
    return out


def words(data: bytes) -> list[bytes]:
    """The stretches of a text, in UTF-8 and lower case."""
    mark = WORD_MARK.encode()
    found = [mark + w for w in data.split()]
    if len(data) <= LONGEST - len(mark) or max(map(len, found), default=0) <= LONGEST:
        return found
    out = []
    for w in found:
        begin = 0
        while len(w) - begin > LONGEST:
            end = begin + LONGEST
            while end > begin + LONGEST - 3 and 0x80 <= w[end] < 0xC0:
                end -= 1
            out.append(w[begin:end])
            begin = end
        out.append(w[begin:])
    return out


def _lowered(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return pc.utf8_lower(pc.fill_null(batch.column(column), "")).cast(pa.binary()).to_pylist()


def _places(texts: list[list[bytes]], index: dict[bytes, int]) -> np.ndarray:
    """Places of all words in the index, which grows by the new ones."""
    return np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), np.int64, sum(map(len, texts)))


def learn(df: DataFrame, model_file: str, *, lang: str, text: str, held: int = 1 << 19, tokens: int = 1 << 23) -> DataFrame:
    """(lang, piece, n long: expected count times UNIT) over all rows with a language; piece -1 counts the rows. A task's words are pooled up to `held` distinct or `tokens` in all."""
    rows = df.where(F.col(lang).isNotNull()).select(lang, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file)
        index: dict[bytes, int] = {}
        names: dict[str, int] = {}
        seen: list[np.ndarray] = []
        docs: list[int] = []

        def flush() -> pa.RecordBatch:
            found, langs = list(index), list(names)
            pair, times = np.unique(np.concatenate([*seen, np.zeros(0, np.int64)]), return_counts=True)
            lang, word = pair >> 32, pair & 0xFFFFFFFF
            sums: dict[int, np.ndarray] = {}
            for begin in range(0, len(found), CHUNK):
                lattice = Lattice(pieces, found[begin : begin + CHUNK])
                share = np.rint(lattice.expected() * UNIT)
                inside = (word >= begin) & (word < begin + CHUNK)
                for i in np.unique(lang[inside]).tolist():
                    mine = inside & (lang == i)
                    count = np.zeros(len(lattice.size))
                    count[word[mine] - begin] = times[mine]
                    sums[i] = sums.get(i, 0) + np.bincount(lattice.piece, share * count[lattice.word], pieces.n)
            n_docs = np.bincount(docs, minlength=len(langs))
            parts = [(langs[i], np.flatnonzero(x), x[np.flatnonzero(x)]) for i, x in sums.items()]
            lang_out = [x[0] for x in parts for _ in range(len(x[1]))] + langs
            piece = np.concatenate([*[x[1] for x in parts], np.full(len(langs), -1)])
            n = np.concatenate([*[x[2] for x in parts], n_docs]).astype(np.int64)
            index.clear(), names.clear(), seen.clear(), docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang_out, pa.string()), pa.array(piece, pa.int32()), pa.array(n, pa.int64())], names=["lang", "piece", "n"])

        pooled = 0
        for whole in batches:
            for batch in slices(whole, text):
                texts = [words(x) for x in _lowered(batch, text)]
                codes = np.array([names.setdefault(x, len(names)) for x in batch.column(lang).to_pylist()], np.int64)
                seen.append(np.repeat(codes, [len(t) for t in texts]) << 32 | _places(texts, index))
                docs.extend(codes.tolist())
                pooled += len(seen[-1])
                if len(index) > held or pooled > tokens or len(names) > BLOCK:
                    yield flush()
                    pooled = 0
        if docs:
            yield flush()

    return rows.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _score_block(df: DataFrame, keep: list[str], text: str, model_file: str, langs: list[str], p: np.ndarray, prior: np.ndarray, names: tuple[str, str, str], held: int) -> DataFrame:
    """df with the columns lang, best and total (ln of the likelihood of the best language so far and of the sum over all so far) brought up to date by a block."""
    shared = df.sparkSession.sparkContext.broadcast((langs, p, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file)
        langs, p, prior = shared.value
        index: dict[bytes, int] = {}
        known = np.zeros((0, len(langs)))
        for whole in batches:
            for batch in slices(whole, text):
                if len(index) > held:
                    index, known = {}, known[:0]
                texts = [words(x) for x in _lowered(batch, text)]
                place = _places(texts, index)
                if len(index) > len(known):
                    known = np.concatenate([known, log_likelihood(pieces, list(index)[len(known) :], p)])
                n = np.array([len(t) for t in texts])
                doc = np.repeat(np.arange(len(n)), n)
                score = prior + np.stack([np.bincount(doc, known[place, i], len(n)) for i in range(len(langs))], 1)
                top = score.argmax(1)
                best = score[np.arange(len(n)), top]
                total = best + np.log(np.exp(score - best[:, None]).sum(1))
                before = pc.fill_null(batch.column(names[1]), -np.inf).to_numpy(zero_copy_only=False), pc.fill_null(batch.column(names[2]), -np.inf).to_numpy(zero_copy_only=False)
                mine = best > before[0]
                lang = [langs[i] if m else old for i, m, old in zip(top.tolist(), mine.tolist(), batch.column(names[0]).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column(text), pa.array(lang, pa.string()), pa.array(np.maximum(best, before[0])), pa.array(np.logaddexp(total, before[1]))], names=[*keep, text, *names])

    return df.mapInArrow(run, df.schema)


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(
    df: DataFrame, model_file: str, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None,
    smoothing: float = 0.1, block: int = BLOCK, held: int = 1 << 19,
) -> DataFrame:
    """Columns `keep` (default: all but the text) with lang_pred string and score double, learnt from the rows where `train` holds (default: by `held_out` of the id)
    and the language isn't null; `smoothing` is added to each piece's expected count. Kept columns named like these are replaced, in whatever case."""
    keep = [c for c in (keep if keep is not None else df.columns) if c.lower() not in {text_col.lower(), "lang_pred", "score"}]
    tables = Tables(df.sparkSession, "langid")
    train = ~held_out(F.col(id_col)) if train is None else train
    lang, text, best, total, pred = unused([*keep, lang_col], "lang", "text", "best", "total", "pred")
    counts = tables.put(learn(df.where(train).select(F.col(lang_col).alias(lang), F.col(text_col).alias(text)), model_file, lang=lang, text=text, held=held), "counts")
    sizes = {r["lang"]: (r["n"], r["docs"]) for r in counts.groupBy("lang").agg(F.sum(F.when(F.col("piece") >= 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("piece") < 0, F.col("n"))).alias("docs")).collect()}
    langs, n_pieces, all_docs = sorted(sizes), vocabulary(model_file).n, sum(docs for _, docs in sizes.values())
    none = F.lit(None)
    out = df.select(*keep, F.col(text_col).alias(text), none.cast("string").alias(pred), none.cast("double").alias(best), none.cast("double").alias(total))
    for i in range(0, len(langs), block):
        mine = langs[i : i + block]
        p = np.full((n_pieces, len(mine)), smoothing)
        place = {x: j for j, x in enumerate(mine)}
        for r in counts.where(F.col("lang").isin(mine) & (F.col("piece") >= 0)).toLocalIterator():
            p[r["piece"], place[r["lang"]]] += r["n"] / UNIT
        prior = np.log([sizes[x][1] / all_docs for x in mine])
        out = _score_block(out, keep, text, model_file, mine, p / p.sum(0), prior, (pred, best, total), held)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.col(pred).isNotNull()
    return out.select(*keep, F.when(letter, F.col(pred)).otherwise("und").alias("lang_pred"), F.when(letter, F.exp(F.col(best) - F.col(total))).otherwise(0.0).alias("score"))
