"""Small seeded tables with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing names."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, i int, n int, h long, score string, size string, u string, label string, row int, shard string, picks int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"shared{k}" for k in range(60))


def texts(seed: int = 5, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    vocab = {"en": [f"th{a}{b}" for a in "aeiou" for b in "nrstl"], "de": [f"sch{a}{b}" for a in "äöüei" for b in "nrztk"]}
    rows: list[tuple] = []
    for k in range(n):
        lang = r.choice(["en", "de"])
        words = [r.choice(vocab[lang]) + r.choice(["", ".", ",", "A"]) for _ in range(r.choice([3, 5, 12, 40, 90, 200]))]
        if k % 9 == 0:
            at = r.randrange(len(words))
            words[at:at] = PASSAGE.split()[: r.choice([25, 60])]
        rows.append((k, r.choice([" ", "\n", "  "]).join(words), lang if k % 10 else None, r.choice(["a", "b", "ü", None]) if k % 3 else "a"))
    base = rows[7][1].split()
    for k in range(n, n + 40):  # near copies of several degrees, and exact ones
        words = list(base) * 3
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            words[r.randrange(len(words))] = f"new{r.randrange(99)}"
        rows.append((k, " ".join(words), "en", "b"))
    for k, t in enumerate(["A b c d", "a B c d", "a b c d e", "a b c d f", "q w e r t y", "q w e r t z", ""], n + 40):
        rows.append((k, t, "en", "c"))
    rows += [(n + 60, None, None, None), (None, "no id here at all", "en", "a"), (None, None, None, None), (n + 61, "12345 67890 !!", "de", "b"), (n + 62, "x" * 70_000 + " " + "long word " * 9_000, "en", "a"), (n + 63, "\t\n \x0b\x0c", "en", "a"), (n + 64, "é ﬁ 😀 　 zwölf\x00null", "de", "ü")]
    return rows + rows[3:6]  # repeated rows


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, lang, src, None if t is None else len(t), "clash", 7, 8, 9, "s", "big", "u", "l", 1, "z", 3) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3, "doc_id")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def folded(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))
