"""Operators against brute-force versions on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from codeweave.llm import components, decontaminate, html_text, lm, quality, simhash, substrings, warc
from codeweave.llm.gru import Gru, Trainer
from pyspark.sql import functions as F


def prose(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    for t in [None, "", "One", "a b c", "A B C D E", "É x y z\x0bq r s", *(prose(rng, rng.randrange(200)) for _ in range(30))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def plain_components(nodes, links):
    up = {n: n for n in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_connect_what_all_pairs_would(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(150)]
    dense = rng.getrandbits(64)
    for _ in range(400):  # a crowd around one fingerprint, many to a cell
        f = dense
        for b in rng.sample(range(64), rng.randrange(5)):
            f ^= 1 << b
        prints.append(f)
    for f in prints[:60]:
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            f ^= 1 << b
        prints.append(f)
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in prints})
    arr = np.array(signed, np.int64).view(np.uint64)
    every = [(signed[i], signed[j]) for i in range(len(arr)) for j in (np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4) + i + 1).tolist()]
    want = plain_components(signed, every)
    df = spark.createDataFrame([(f,) for f in signed], "simhash long")
    got = simhash.links(df, distance=4)
    assert {tuple(sorted(r)) for r in got.collect()} <= {tuple(sorted(e)) for e in every}
    roots = {r.node: r.root for r in components.components(got).collect()}
    assert all(roots.get(n, n) == want[n] for n in signed)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 1000), np.uint64)
    e = np.bitwise_count(simhash.embed(a) ^ simhash.embed(b))
    counts = lambda f: np.stack([np.bitwise_count((f >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)]).astype(int)
    assert (e == np.abs(counts(a) - counts(b)).sum(axis=0)).all() and (e <= np.bitwise_count(a ^ b)).all()


def test_chunks_resist_insertions_and_cover():
    rng = random.Random(4)
    t = prose(rng, 3000).encode()
    shifted = b"some new words first " + t
    found = []
    for data in (t, shifted):
        _, b, e = substrings.cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert b[0] == 0 and e[-1] == len(data) and (b[1:] == e[:-1]).all() and (e - b).max() <= substrings.MOST
        found.append({data[x:y] for x, y in zip(b, e, strict=True)})
    assert len(found[0] - found[1]) <= 4


def test_repeats_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    docs = [(i, f"{prose(rng, 80)} {passage} {prose(rng, 50)}") for i in range(5)] + [(10 + i, prose(rng, 150)) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    texts = dict(docs)
    assert all(got[i] == texts[i] for i in (0, 10, 11, 12, 13, 14))
    for i in range(1, 5):
        left = texts[i].replace(passage, "").split()
        assert got[i].split() == left
    spans = substrings.repeated_spans(df).collect()
    assert {r.id for r in spans} == {1, 2, 3, 4} and all(r.first_id < r.id for r in spans)


def test_short_and_periodic_passages_are_found_whole(spark):
    rng = random.Random(13)
    texts, lost = [], []
    for n in range(60):
        kind = n % 3
        passage = prose(rng, 51, 10**6) if kind == 0 else " ".join(["la di da"] * 40) if kind == 1 else " ".join([f"é{n} ünd öh"] * 40)
        for k in range(2):
            texts.append(f"{prose(rng, rng.randrange(20, 60), 10**6)} {passage} {prose(rng, 40, 10**6)}")
        lost.append((len(texts) - 1, passage))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    kept = [(i, p) for i, p in lost if len(set(p.split()) & set(got[i].split())) > 3]
    assert not kept
    over = [len(got[i].split()) - len(texts[i].replace(p, "").split()) for i, p in lost]
    assert all(-2 <= n <= (0 if k % 3 == 0 else 30) for k, n in enumerate(over)), over


def test_resampling_keeps_clean_and_drops_toxic(spark):
    rng = random.Random(6)
    clean = [(i, prose(rng, 120)) for i in range(300)]
    toxic = [(1000 + i, f"{prose(rng, 60)} badword{i % 2} {prose(rng, 50)}") for i in range(60)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    assert kept == set(range(300))
    few = quality.resample(docs, labels, k=50).count()
    assert few == 50


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 520):
        assert quality.kth_largest(df, "v", k, bins=8) == sorted(values, reverse=True)[k - 1]


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        masks = defaultdict(int)
        for i, w in enumerate(a):
            masks[w] |= 1 << i
        assert decontaminate.lcs(masks, len(a), b) == plain_lcs(a, b)


def test_leaks_and_paraphrases(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 20 + 3 * i, 5000)) for i in range(12)] + [(50, prose(rng, 150, 5000))]
    docs, want = [(i, prose(rng, 200, 5000)) for i in range(60)], set()
    for n, (i, t) in enumerate(items):
        docs.append((100 + n, f"{prose(rng, 70 + 7 * n, 5000)} {t.upper()} {prose(rng, 90, 5000)}"))
        w = t.split()
        for j in range(2, len(w) - 6, 6):
            w[j] = "other"
        docs.append((200 + n, f"{prose(rng, 33, 5000)} {' '.join(w)} {prose(rng, 10, 5000)}"))
        want |= {(100 + n, i), (200 + n, i)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    monkeypatch.setattr(decontaminate, "MOST_ENTRIES", 50_000)
    assert 1 < len(decontaminate.groups(items, 256, 50_000)) < len(items)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_lm_counts_and_scores(spark):
    rng = random.Random(10)
    docs = [(i, prose(rng, rng.randrange(1, 60), 300).title()) for i in range(200)] + [(900, None)]
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), table=40).collect()}
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [""]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        r, k = out[i], tok(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(k), sum(c[w] > 0 for w in k), n) and abs(r.base_score - base) < 1e-6
        assert r.score < 0


def test_gru_gradients_and_windows():
    f = np.array([50, 40, 30, 9, 8, 7, 3, 2, 5, 6])
    g = Gru(8, 2, 5, 0, f, classes=3)
    for name in g.NAMES:
        setattr(g, name, getattr(g, name).astype(np.float64))
    r = np.random.default_rng(0)
    xs, ys, weight, h0 = r.integers(0, 10, (6, 3)), r.integers(0, 10, (6, 3)), np.full((6, 3), 1 / 18), r.standard_normal((3, 5))

    def loss():
        h, total = h0, 0.0
        for t in range(6):
            h = g.cell(xs[t], h * (xs[t] != 0)[:, None])
            total -= g.log10_of(h, ys[t]).sum() * np.log(10)
        return total / 18

    grads, _ = g._window(xs, ys, weight, h0)
    for name in g.NAMES:
        w = getattr(g, name)
        for at in ((0,) * w.ndim, tuple(s // 2 for s in w.shape), tuple(s - 1 for s in w.shape)):
            before = w[at]
            w[at] = before + 1e-5
            up = loss()
            w[at] = before - 1e-5
            down = loss()
            w[at] = before
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6
    assert abs(sum(10 ** g.log10_of(np.repeat(h0[:1], 10, axis=0), np.arange(10))) - 1) < 1e-9
    docs = [np.append(r.integers(1, 10, n), 0) for n in (0, 5, 300, 64)]
    assert np.allclose(g.score(docs), g.score(docs, window=7), atol=1e-4)
    plain = []
    for d in docs:
        h, total, last = np.zeros((1, 5)), 0.0, 0
        for u in d:
            h = g.cell(np.array([last]), h)
            total += g.log10_of(h, np.array([u]))[0]
            last = u
        plain.append(total)
    assert np.allclose(g.score(docs), plain, atol=1e-3)


def test_trainer_reads_every_unit_once():
    r = np.random.default_rng(1)
    docs = [np.append(r.integers(1, 10, int(n)), 0) for n in r.integers(0, 300, 60)]
    t = Trainer(Gru(8, 2, 5, 0, np.ones(10)), 0.01, 4, window=16)
    for d in docs:
        t.feed(d)
    assert t.finish() == sum(map(len, docs))


def test_lm_learns_alike_on_any_layout_and_beats_the_counts(spark):
    rng = random.Random(12)
    line = lambda: " ".join(f"a{(k := rng.randrange(20))} b{k} c{k % 5}" for _ in range(40))
    docs, out = [(i, line()) for i in range(300)], []
    for n in (2, 7):
        out.append({r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), shard_tokens=4000, updates=20).collect()})
    assert all(abs(out[0][i].score - out[1][i].score) < 1e-4 * out[0][i].n_tokens for i, _ in docs)
    held = [r for r in out[0].values() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_word_shares_of_a_tail_class_sum_to_one():
    counts = Counter({f"w{i}".encode(): 1 + i % 7 for i in range(200)})
    of = lm.Units({})
    for unit in {of[w] for w in counts}:
        own = [n for w, n in counts.items() if of[w] == unit]
        below = sum(own) + 0.1 * (len(own) + 1)
        assert abs(sum((n + 0.1) / below for n in own) + 0.1 / below - 1) < 1e-12


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies on this site and so on for the best of it.</div>"
        "<article><h1>Head &amp; line</h1><p>The first<b>bold</b>\n paragraph &eacute;.</p><form>Sign up</form><p>Short</p><!-- hidden --></article><aside>More of the same that you may like in the week</aside><section id=comments><article class=comment><p>I like it very much and so will you in the end</p></article></section><footer>(c)</footer>"
    )
    assert html_text.main_text(page)[0] == "Head & line The firstbold paragraph é. Short"
    assert html_text.main_text("<article><p>First</p><video src=a.mp4><p>Second</p></article>")[0] == "First Second"
    assert html_text.main_text(None)[0] == "" and html_text.main_text("<nav>x</nav>")[0] == ""
    plain = "<div>Menu</div><p>" + "It is the one that was in the house for all of us and not for them. " * 4 + "</p><p>End.</p><ul><li><a href=1>one</a></li></ul>"
    assert html_text.main_text(plain)[0].endswith("End.") and "one" not in html_text.main_text(plain)[0].split()[-1]


def test_undecided_blocks_follow_the_nearest():
    rng = random.Random(11)
    for _ in range(50):
        found = [html_text.Block("It is the one that was in the house for all of us." * 6 if rng.random() < 0.2 else "Short", rng.choice(["open", "out"]), 0) for _ in range(rng.randrange(1, 90))]
        sure = [False if b.zone == "out" else True if len(b.text) > 70 else None for b in found]
        want = []
        for i, b in enumerate(found):
            near = [(abs(j - i), not sure[j]) for j in range(len(found)) if sure[j] is not None and found[j].zone == b.zone]
            if sure[i] or sure[i] is None and near and not min(near)[1]:
                want.append(id(b))
        assert [id(b) for b in html_text.main_blocks(found)] == want
    assert html_text.main_text("<p>x</p>" * 100_000)[1] == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b", "<p>One</p><p>Two é</p>"), (2, None, None)], "page_id long, url string, html string")
    derived = warc.derive(warc.from_pages(pages), keep=["page_id"]).cache()
    assert derived.count() == 4
    warc.write_warc(derived, str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w/part-*")).collect()}
    for r in derived.collect():
        got = back[r.record_id]
        assert got.record_type == r.record_type and got.refers_to == r.refers_to and bytes(got.payload).decode() == r.block and r.block_digest == warc.digest(r.block.encode())
    texts = {r.page_id: r.block for r in derived.where("record_type = 'conversion'").collect()}
    assert texts == {1: "One\nTwo é", 2: ""}
    bad = spark.createDataFrame([("<urn:x>", b"abc", "sha1:WRONG")], "record_id string, payload binary, payload_digest string")
    assert [r.digest_ok for r in warc.derive(bad).collect()] == [False, False] and F is not None
