"""Fill-in-middle against a token by token version, and round trips."""

import hashlib
import random
import re

from lodestone.llm import fill_middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    units = UNITS.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_bits_against_tokens():
    rnd = random.Random(1)
    for k in range(5000):
        text = "".join(rnd.choice(" \t\n\x0b\x0c\ra bc é日 \u0085\xa0𝄞<PSM>") for _ in range(rnd.randrange(60)))
        *got, out = fill_middle.transformed(k, text.encode(), 42, 50, 80)
        assert (*got, out.decode()) == plainly(k, text), text


def test_select():
    for bits, width in ((0b1011001, 7), (1, 1), (1 << 4000 | 1, 4001), ((1 << 999) - 1, 1200)):
        at = [width - 1 - k for k in range(width - 1, -1, -1) if bits >> k & 1]
        assert [fill_middle.select(bits, width, r + 1) for r in range(len(at))] == at


def test_rows(spark):
    rnd = random.Random(2)
    texts = [None, "", " ", "a<P>b", "one", "x " * 50_000, "é" * 100_000, *("".join(rnd.choice("ab \n<é") for _ in range(rnd.randrange(1, 300))) for _ in range(300))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, texts[9]), (9, texts[9]), (None, "some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fill_middle.fill_in_middle(docs)
    got = sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found.collect() if r["doc_id"] is not None)
    assert got == sorted((i, *plainly(i, t or "")) for i, t in rows if i is not None)
    assert {r["form"] for r in found.collect()} == {"plain", "psm", "spm"}
    from pyspark.sql import functions as F

    back = found.where("doc_id IS NOT NULL").select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back)) == sorted((i, t or "") for i, t in rows if i is not None)
    clash = docs.selectExpr("*", "1 AS n", "'x' AS form", "'y' AS output", "2 AS prefix_chars")
    assert sorted(map(repr, fill_middle.fill_in_middle(clash).collect())) == sorted(map(repr, found.collect()))
    assert fill_middle.digest(fill_middle.fill_in_middle(docs.limit(0))).collect() == []
    broken = spark.createDataFrame([(1, bytearray(b"\xff a \xfe b c"))], "doc_id long, raw binary").selectExpr("doc_id", "CAST(raw AS string) AS text")
    (r,) = fill_middle.digest(fill_middle.fill_in_middle(broken)).collect()
    assert r["restored_sha256"] == hashlib.sha256(b"\xff a \xfe b c").hexdigest()
