"""Fill-in-middle against a plain version by regular expressions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from codeweave.llm import fim
from codeweave.llm.common import text_bytes
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def noise(rng, n):
    return "".join(rng.choice(["a", "P", "<", "S", "M", ">", " ", "\n", "é", "漢", "🙂", "<P>", "\x0b", " ", " ", "\x1c"]) for _ in range(n))


def test_scan_counts_and_cuts_whatever_the_stretch():
    rng = random.Random(1)
    texts = [noise(rng, rng.randrange(300)) for _ in range(300)] + ["", " ", "P" * 3000, "漢" * 3000, "<" * 1000 + "P" * 1000 + ">", " " * 3000, "🙂 " * 2000, "<P" + "x" * 600 + ">"]
    raw, offsets = text_bytes(pa.array(texts))
    for stretch in (4, 5, 16, 512):
        scan = fim.Scan(raw, offsets, stretch)
        units = [UNIT.findall(t) for t in texts]
        assert scan.n_chars.tolist() == [len(t) for t in texts]
        assert scan.n_units.tolist() == [len(u) for u in units]
        assert (scan.n_marks > 0).tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in texts]
        k = np.array([rng.randrange(len(u) + 1) for u in units])
        size, chars = scan.cut(np.arange(len(texts)), k)
        for i, u in enumerate(units):
            pre = "".join(u[: k[i]])
            assert (size[i], chars[i]) == (len(pre.encode()), len(pre))


def test_damaged_utf8_is_scanned_with_the_stretch_before():
    rng = random.Random(2)
    data = bytes(rng.choice([0x80, 0xC3, 0xE2, 0xF0, 0x20, 0x41, 0xBF]) for _ in range(4000))
    raw, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    whole, cut = fim.Scan(raw, offsets, 1 << 20), fim.Scan(raw, offsets, 8)
    assert whole.n_chars == cut.n_chars and whole.n_units == cut.n_units


def test_transform_and_back(spark):
    rng = random.Random(3)
    rows = [(i, noise(rng, rng.randrange(80)).replace("<", rng.choice(["", "<"]))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (None, "no id at all"), (None, None), (7, "same id"), (7, "same id"), (303, "long " * 200_000), (304, "x" * 500_000), (-5, "a b c <S d")]
    df = spark.createDataFrame([(i, t, "mine", "theirs", 1) for i, t in rows], "doc_id long, text string, Form string, __text string, __key int").repartition(3)
    out = fim.transform(df, keep=["doc_id", "Form", "__text", "__key"])
    assert out.columns == ["doc_id", "__text", "__key", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    found = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found), key=key) == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0
