"""Language identification against sums over all segmentations, one by one."""

import random
import zlib

import numpy as np
import pytest
from codeweave.llm import langid
from codeweave.llm.langid import Lattice, Pieces
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ([pieces[word[:k]], *rest] for rest in segmentations(word[k:], pieces))


def test_sums_over_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"bb", b"abbab"]
    by_bytes, rng = {p: i for i, p in enumerate(pieces)}, random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 20))).encode() for _ in range(40)]
    p = np.random.default_rng(1).random((len(pieces), 3)) * 1e-9
    lattice = Lattice(Pieces(pieces), words)
    got, arcs = langid.log_likelihood(Pieces(pieces), words, p), lattice.expected()
    assert np.allclose(got, lattice.log_likelihood(p)) and np.allclose(got, lattice.log_likelihood(np.vstack([p, [[1e-200] * 3]])))
    for i, word in enumerate(words):
        sums, counts, all_ = np.zeros(3), np.zeros(len(pieces)), 0.0
        for s in segmentations(word, by_bytes):
            weight = np.exp(-10.4 * len(s))
            sums, all_ = sums + np.prod(p[s] * 1e9, 0) * 1e-9 ** (len(s) - len(word)), all_ + weight
            np.add.at(counts, s, weight)
        assert np.allclose(got[i], np.log(sums) + len(word) * np.log(1e-9))
        assert np.allclose(np.bincount(lattice.piece[lattice.word == i], arcs[lattice.word == i], len(pieces)), counts / all_)


def test_every_byte_has_a_piece_and_stretches_keep_all():
    pieces = langid.vocabulary(MODEL)
    odd = [bytes([b]) * 64 for b in range(256)] + [b"\xf0\x9f\x99\x82" * 16]
    assert np.isfinite(langid.log_likelihood(pieces, odd, np.full((pieces.n, 1), 1e-12))).all()
    text = "x" * 200 + " " + "漢" * 100 + " short"
    stretches = langid.words(text.encode())
    assert b"".join(stretches).decode().replace("▁", " ").strip() == text
    assert max(map(len, stretches)) <= langid.LONGEST
    for s in stretches:
        s.decode()


def texts(rng, lang, n):
    stems = {"en": ["the", "and", "tion", "ing", "house"], "de": ["und", "der", "schaft", "ung", "haus"], "fr": ["le", "que", "ment", "eux", "maison"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, texts(rng, lang, 30), lang, 7, "c") for i in range(300) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(1000, None, "en", 7, "c"), (1001, "", "de", 7, "c"), (1002, "123 456 !!", "fr", 7, "c"), (None, "the house and the house", None, 7, "c"), (1003, texts(rng, "de", 50_000), None, 7, "c"), (1004, "ü" * 300_000, "de", 7, "c"), (5, rows[5][1], rows[5][2], 7, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE int, __text string").repartition(4)


def key(rows):
    return sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in rows)


def test_held_out_documents_are_told(spark, docs):
    out = langid.identify(docs, MODEL, keep=["doc_id", "lang", "SCORE", "__text"])
    assert out.columns == ["doc_id", "lang", "__text", "lang_pred", "score"]
    found = out.collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "de"
    far = [r for r in found if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(far) > 30 and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in far)
    # neither the partitions nor the blocks of languages nor the size of what a task pools change anything
    other = langid.identify(docs.repartition(2), MODEL, keep=["doc_id"], block=1, held=50)
    assert key(other.collect()) == key(found)


def test_score_is_the_posterior(spark):
    docs = spark.createDataFrame([(1, "the the house", "en"), (2, "der die haus", "de"), (3, "the haus", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(docs, MODEL, train=F.lit(True)).collect()}
    pieces = langid.vocabulary(MODEL)
    ln = {}
    for lang, text in (("en", "the the house"), ("de", "der die haus")):
        lattice = Lattice(pieces, langid.words(text.encode()))
        share = np.rint(lattice.expected() * langid.UNIT) / langid.UNIT
        p = np.bincount(lattice.piece, share, pieces.n) + 0.1
        ln[lang] = Lattice(pieces, langid.words(b"the haus")).log_likelihood((p / p.sum())[:, None]).sum() + np.log(0.5)
    total = np.logaddexp(ln["en"], ln["de"])
    best = max(ln, key=ln.get)
    assert out[3].lang_pred == best and out[3].score == pytest.approx(np.exp(ln[best] - total))


def test_nothing_to_learn_from(spark, docs):
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), MODEL).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), MODEL).count() == 0
