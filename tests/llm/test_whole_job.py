"""Stages and operators against plain versions of the whole job."""

import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng, texts = random.Random(3), []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 400]))]
        texts.append(" ".join(words))
        for changed in (0.01, 0.02, 0.025, 0.03, 0.04, 0.06):
            copy = list(words)
            for i in rng.sample(range(len(copy)), max(1, int(changed * len(copy)))):
                copy[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts.append(texts[0].upper())
    rng.shuffle(texts)
    sets, up = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and up[i] != up[j]:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r[0] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert got == sorted(set(up))
    assert 12 <= len(got) < len(texts)


def leaks(spark, docs, items):
    from codeweave.llm import decontaminate

    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3), benchmark)
    return {(r["doc_id"], r["item_id"]) for r in got.select("doc_id", "item_id").collect()}


def test_leaks_in_a_hot_group_of_altered_copies(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"t{rng.randrange(900)}" for _ in range(n))
    item = [f"q{i}" for i in range(40)]
    docs = [text(120) for _ in range(100)]
    for _ in range(60):
        copy = list(item)
        copy[20] = f"z{rng.randrange(10**6)}"
        docs.append(" ".join([text(50), *copy, text(50)]))
    assert leaks(spark, docs, [(7, " ".join(item))]) == {(i, 7) for i in range(100, 160)}


def test_paraphrases_without_the_rare_words(spark):
    rng = random.Random(5)
    draw = lambda n: [f"c{int(rng.paretovariate(0.9)) % 3000}" for _ in range(n)]
    docs, items, want = [" ".join(draw(150)) for _ in range(400)], [], set()
    seen = {}
    for d in docs:
        for w in set(d.split()):
            seen[w] = seen.get(w, 0) + 1
    for i in range(12):
        item = draw(20) + [f"i{i}w{k}" for k in range(15)] + draw(5)
        items.append((i, " ".join(item)))
        rare = sorted(range(len(item) - 5), key=lambda k: seen.get(item[k], 0))
        for share in (0.15, 0.3, 0.4, 0.48):
            copy = list(item)
            for k in rare[: int(share * len(item))]:
                copy[k] = f"y{rng.randrange(10**6)}"
            want.add((len(docs), i))
            docs.append(" ".join([*draw(100), *copy, *draw(100)]))
    assert want <= leaks(spark, docs, items)


def test_every_training_document_is_learnt_from(spark):
    from codeweave.llm import lm

    ids = spark.createDataFrame([(str(i), bytes([i % 250, 0])) for i in range(600)], "id string, ids binary")
    parts = [p.collect() for p in lm.rounds_of(ids, 4, 3)]
    assert sorted(bytes(r["ids"]) for p in parts for r in p) == sorted(bytes(r[0]) for r in ids.select("ids").collect())
    assert all({r["shard"] for r in p} == {0, 1, 2} for p in parts)


def test_shards_are_summed_in_a_tree(spark):
    import numpy as np
    from codeweave.llm import lm
    from codeweave.llm.gru import Gru

    rng = np.random.default_rng(1)
    rows = [(str(i), rng.integers(0, 12, 40).astype(np.uint16).tobytes()) for i in range(60)]
    ids = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id string, ids binary").repartition(3)
    fitted = []
    for fan_in, most in ((64, 1 << 14), (2, 1 << 14), (3, 4)):
        model = Gru(8, lm.ENDINGS, 6, 0, np.full(8 + lm.ENDINGS, 1 / (8 + lm.ENDINGS)))
        fitted.append(lm._train(ids, model, 2400, (0.01, 0.005), 120, 20, most, fan_in).flat())
    assert np.allclose(fitted[0], fitted[1], atol=1e-9) and np.isfinite(fitted[2]).all() and not np.allclose(fitted[0], fitted[2])


def plain_kept(texts):
    sets, up = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and up[i] != up[j]:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return set(up)


def test_near_pairs_come_from_fingerprints_first_and_count_in_few_of_their_cells(spark, monkeypatch):
    from codeweave.llm import shingles, simhash

    draw, words = random.Random(3), [f"w{i}" for i in range(4000)]
    base, texts = draw.choices(words, k=150), []
    for _ in range(60):  # about 0.7 alike, so that most pairs are looked at and few are links
        text = list(base)
        for at in draw.sample(range(150), 3):
            text[at] = draw.choice(words)
        texts.append(" ".join(text))
    texts += [f"{t} end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, made = [], []
    links, candidates = simhash.links, shingles._candidates
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(links(*a, **k)) or asked[-1])

    def counted(now, similarity, stars):
        out = candidates(now, similarity, stars)
        if not stars:
            made.append((out.count(), out.selectExpr("least(digest, d)", "greatest(digest, d)").distinct().count()))
        return out

    monkeypatch.setattr(shingles, "_candidates", counted)
    kept = {r.doc_id for r in simhash.keep_first(docs, words=5, similarity=0.8).collect()}
    assert kept == plain_kept(texts)
    assert asked and asked[0].count() > 0
    assert made and all(rows <= 6 * pairs for rows, pairs in made)


def test_tables_and_components_leave_no_shuffle_files(spark):
    """A table's shuffles are gone once it is written: near_dedup makes hundreds of them, with many small files each."""
    from codeweave.llm.common import Tables
    from codeweave.llm.components import components

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.rsplit("/", 1)[1].split("_")[1] for x in disk.getAllFiles().mkString(",").split(",") if "/shuffle_" in x}
    before, key = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    edges = Tables(spark, "test").put(spark.range(1000).selectExpr("id % 100 as u", "id % 50 as v").distinct(), "edges")
    found = components(edges)
    assert spark.conf.get(key, None) == setting
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert len(found.collect()) == 100


def test_freed_arrays_stay_with_the_process():
    """Loops over arrays of some 100 KB don't fetch their pages anew each time."""
    import subprocess

    loop = "import resource, numpy as np; f = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt; n = f()\nfor _ in range(100): x = [np.ones(k * 10_000) for k in range(2, 10)]; del x\nprint(f() - n)"
    faults = [int(subprocess.run([sys.executable, "-c", begin + loop], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2]).stdout) for begin in ("", "from codeweave.llm.common import keep_freed; keep_freed()\n")]
    assert faults[1] < 5000 < faults[0], faults


def test_codes_of_documents_without_words_between_others(spark):
    from codeweave.llm import lm

    docs = [(1, "a b a"), (2, None), (3, "  "), (4, "c a zz"), (5, "b"), (6, "")]
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), table=2).collect()}
    assert {i: r.n_tokens for i, r in out.items()} == {1: 4, 2: 1, 3: 1, 4: 4, 5: 2, 6: 1}
    assert out[2].base_score == out[3].base_score == out[6].base_score and out[2].score == out[3].score == out[6].score
