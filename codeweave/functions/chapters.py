"""Chapters of codes and their distance, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (chapter, first code, last code) of three code systems.
ICD9CM = [
    (1, "001", "139"), (2, "140", "239"), (3, "240", "279"), (4, "280", "289"), (5, "290", "319"), (6, "320", "389"), (7, "390", "459"), (8, "460", "519"), (9, "520", "579"),
    (10, "580", "629"), (11, "630", "679"), (12, "680", "709"), (13, "710", "739"), (14, "740", "759"), (15, "760", "779"), (16, "780", "799"), (17, "800", "999"),
]
ICD10CA = [
    (1, "A00", "B99"), (2, "C00", "D48"), (3, "D50", "D89"), (4, "E00", "E90"), (5, "F00", "F99"), (6, "G00", "G99"), (7, "H00", "H59"), (8, "H60", "H95"), (9, "I00", "I99"), (10, "J00", "J99"), (11, "K00", "K93"),
    (12, "L00", "L99"), (13, "M00", "M99"), (14, "N00", "N99"), (15, "O00", "O99"), (16, "P00", "P96"), (17, "Q00", "Q99"), (18, "R00", "R99"), (19, "S00", "T98"), (20, "V01", "Y98"), (21, "Z00", "Z99"), (22, "U00", "U99"),
]
ICDA8 = [
    (1, "000", "136"), (2, "140", "239"), (3, "240", "279"), (4, "280", "289"), (5, "290", "315"), (6, "320", "389"), (7, "390", "458"), (8, "460", "519"), (9, "520", "577"),
    (10, "580", "629"), (11, "630", "678"), (12, "680", "709"), (13, "710", "738"), (14, "740", "759"), (15, "760", "779"), (16, "780", "796"), (17, "800", "999"),
]
# Target chapters that each ICD-9-CM chapter may map to.
ALIGN_10_9 = {1: [1], 2: [2], 3: [4], 4: [3], 5: [5], 6: [6, 7, 8], 7: [9], 8: [10], 9: [11], 10: [14], 11: [15], 12: [12], 13: [13], 14: [17], 15: [16], 16: [18], 17: [19]}
ALIGN_8_9 = {c: [c] for c in range(1, 18)}

Alignment = dict[int, list[int]]


def pad(code: Column, width: int) -> Column:
    """Left-padded with zeros; longer codes stay as they are."""
    return F.when(F.length(code) >= width, code).otherwise(F.lpad(code, width, "0"))


def once(value: Column, f) -> Column:
    """f(value) with value evaluated once, however often f uses it: merged projections would copy it into every use."""
    return F.transform(F.array(value), f)[0]


def chapter(code: Column, ranges: list[tuple[int, str, str]], *, width: int = 3, alpha: bool = False) -> Column:
    """Chapter of the first range that holds the code's key, null outside all: a chain of literals, so no join."""
    code = code.cast("string")
    key = F.substring(code, 1, 3) if alpha else pad(F.substring_index(code, ".", 1), width)
    return once(key, lambda k: F.coalesce(*[F.when(k.between(a, b), F.lit(n)) for n, a, b in ranges]).cast("int"))


def distance(source: Column, target: Column, align: Alignment) -> Column:
    """Null if a chapter is null, 0 if allowed, 1 if the numbers are neighbours, else 2."""
    allowed = F.create_map(*[x for s, t in align.items() for x in (F.lit(s), F.array(*map(F.lit, t)))])

    def of(pair: Column) -> Column:
        s, t = pair["s"], pair["t"]
        zero = F.coalesce(F.array_contains(allowed[s], t), F.lit(False))
        return F.when(s.isNull() | t.isNull(), F.lit(None).cast("int")).when(zero, 0).when(F.abs(s - t) == 1, 1).otherwise(2)

    return once(F.struct(source.alias("s"), target.alias("t")), of)


def inverse(align: Alignment) -> Alignment:
    """Target chapter to its source chapters."""
    out: Alignment = {}
    for s, targets in align.items():
        for t in targets:
            out.setdefault(t, []).append(s)
    return {t: sorted(s) for t, s in sorted(out.items())}
