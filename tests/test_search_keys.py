"""Search keys of every document, against the same rules worked out letter by letter."""

import unicodedata

from factloom.functions import columns as C
from factloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
RANGES = [(0xC0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)]
QUOTES = dict.fromkeys("‘’‚‛′", "'") | dict.fromkeys("“”„‟″", '"') | dict.fromkeys("‐‑‒–—―−", "-")
NO_WIDTH = "​‌‍⁠﻿­"


def fold(text):
    base = lambda c: unicodedata.normalize("NFKD", c)[0] if any(a <= ord(c) < b for a, b in RANGES) else c
    return "".join(base(c) if ord(base(c)) < 0x80 else c for c in text).lower()


def spaced(text, keep):
    return "".join(c if keep(c) else " " for c in text)


def brute(text):
    plain = "".join(QUOTES.get(c, c) for c in text if c not in NO_WIDTH)
    normal = " ".join("".join(" " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else c for c in fold(plain)).split(" ")).strip(" ")
    while "  " in normal:
        normal = normal.replace("  ", " ")
    kept = spaced(fold(text), lambda c: unicodedata.category(c)[0] in "LMN" or c == "₹")
    while "  " in kept:
        kept = kept.replace("  ", " ")
    return normal, kept.lstrip(" "), len(spaced(normal, lambda c: unicodedata.category(c)[0] in "LN").split(" ")) - spaced(normal, lambda c: unicodedata.category(c)[0] in "LN").split(" ").count("")


def test_every_document(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["search_keys"](spark, DATA).collect()
    assert len(got) == len(docs) and len({r.lang for r in docs.values()}) > 1
    assert any(not r.text.isascii() for r in docs.values())
    for r in got:
        assert (r.normal, r.key, r.n_tokens) == brute(docs[r.doc_id].text)


def test_marks_width_and_letters_beyond_latin(spark):
    texts = ["Été à Zürich — “Straße”", "ＦＵＬＬ　Ｗｉｄｔｈ １２３", "договор № 7", "किराया ₹5,000", "契約書 第1条", "soft­hyphen zero​width", "  x y ", "", "naïve‑co‐op"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    text = C.F.col("text")
    for r in rows.select("i", C.normalized(text).alias("a"), C.search_key(text).alias("b"), C.F.size(C.tokens(text)).alias("c")).collect():
        assert (r.a, r.b, r.c) == brute(texts[r.i])
