import hashlib
import re

from factloom.llm import decontaminate as decontamination
from factloom.llm.decontaminate import decontaminate

from .docs import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return str(row)


def test_matches_brute_force(spark, monkeypatch):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    source = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(words(source[i * 3])[i : i + 7 + 2 * i])) for i in range(12)]
    items += [(100, None), (101, ""), (102, "w1 w2"), (103, "W1 É"), (104, items[5][1]), (10, items[4][1]), (105, "w1 " * 15)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(rows, [(str(i), t) for i, t in items]), key=key)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for bits in (24, 15):  # a bitmap that sorts most out, and one that is nearly full
        monkeypatch.setattr(decontamination, "BITS", bits)
        got = decontaminate(docs, bench)
        assert sorted(map(tuple, got.select(*columns).collect()), key=key) == want
    kept = decontaminate(docs, bench, keep_rows=True)
    assert sorted(map(tuple, kept.select(*columns).collect()), key=key) == want
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, rows))
    assert sum(r[5] for r in want) > 20


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(awkward(spark), bench).collect())
