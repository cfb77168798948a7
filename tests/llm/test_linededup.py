import hashlib
import random

from factloom.llm.linededup import DIVISOR, MIN_LINES, line_dedup

from .docs import SCHEMA, awkward, empty


def chunked(text):
    lines = (text or "").split("\n")
    marks = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in lines]
    out, begin = [], 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or (i > 1 and (marks[i - 2] * 31 + marks[i - 1]) % DIVISOR == 0):
            out.append(lines[begin:i])
            begin = i
    return out


def brute(rows):
    docs = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in rows}, key=str)
    order = sorted(docs, key=lambda d: d[:2])
    seen, left = set(), {}
    for doc in order:
        keep = []
        for chunk in chunked(doc[2]):
            text = "\n".join(chunk)
            if len(chunk) >= MIN_LINES and text.strip(" \t\n\x0b\f\r"):
                if text in seen:
                    continue
                seen.add(text)
            keep += chunk
        left[doc] = keep
    out = []
    for r in rows:
        keep = left[(r.doc_id is None, r.doc_id or 0, r.text)]
        n = len((r.text or "").split("\n"))
        out.append((r.doc_id, None if r.text is None else "\n".join(keep), n, n - len(keep)))
    return sorted(map(str, out))


def corpus(spark):
    rng = random.Random(5)
    lines = [f"line {i} of text" for i in range(60)] + ["", " ", "é"]
    shared = [rng.choice(lines) for _ in range(25)]
    rows = []
    for i in range(80):
        own = [f"own {i} {j}" for j in range(rng.randrange(0, 8))]
        rows.append((i, "\n".join(own + (shared if i % 3 else [rng.choice(lines) for _ in range(12)]) + own[:2])))
    rows += [(200, rows[4][1]), (201, rows[4][1]), (4, rows[4][1]), (None, rows[4][1]), (202, "\n" * 40), (203, "\n" * 40), (204, None)]
    return spark.createDataFrame([(i, t, None, "s", None, "k", 1) for i, t in rows], SCHEMA).unionByName(awkward(spark, n=40))


def test_matches_brute_force(spark):
    docs = corpus(spark)
    rows = docs.select("doc_id", "text").collect()
    got = line_dedup(docs, whole=False).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert sum(r.n_removed for r in got) > 200


def test_no_python_in_plan(spark):
    plan = line_dedup(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert line_dedup(empty(spark)).count() == 0
