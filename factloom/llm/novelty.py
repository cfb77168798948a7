"""Secret scans: pattern spans, and strings near sensitive words that a primed compressor finds new.

A candidate is a run of LEAST or more key characters, of at least two kinds (small letters, capitals, digits),
that begins within NEAR characters after a sensitive word (after "=", if the word is part of the run) and isn't in a pattern span already. Its novelty is the
bytes that it adds to the compressed code around it (SIDE characters on either side, all copies of the candidate cut out), by zstandard
with a dictionary of identifiers: random keys cost about a byte a character, names and words that
occur around them or in the dictionary cost less. A candidate of NOVEL bytes a character or more is reported.

The dictionary is the MOST identifiers found in most documents around candidates (ties: by name), counted over all documents, after a
few that are known; it is the only thing that reaches the driver. Candidates themselves are never counted, so a secret copied
to thousands of documents doesn't become known. Texts are read twice and never leave their task.

Defined results: a null text counts as empty; an empty text has no spans; texts of any length are read whole;
repeated rows are scanned like any other row, a null doc_id too; an empty table gives no rows; other columns, whatever their names, are
left out; places are code points, ends exclusive. Spans of several kinds may overlap; those of a kind don't.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, small_batches, table, texts_of

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs below the least length fail anyway, so they needn't match.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: What makes the text after it sensitive.
SENSITIVE = re.compile(
    r"(?ai)pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|encryption[_ -]?key|credential|bearer|authorization"
)
#: A text that ASSIGN or SENSITIVE matches holds one of these, in small letters.
ASSIGNED = ("passw", "secret", "token", "apikey", "api_key")
STEMS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "bearer", "authorization")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
CLASSES = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]")))
LEAST, NEAR, SIDE = 16, 48, 2048
NOVEL, LEVEL = 0.85, 3
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")
MOST = 4096
#: Words of configuration and placeholders that any code may hold.
KNOWN = (
    "access_key application/json authorization bearer changeme client_id client_secret com.example.service config connection "
    "content-type credentials database default example https://www.example.com/index.html localhost null password placeholder "
    "private_key secret_key session token undefined username utf-8 your-api-key-here your_api_key your_secret_here xxxxxxxx 1234567890"
)

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]


def holds(text: str, stems: tuple[str, ...]) -> bool:
    low = text.lower()
    return any(s in low for s in stems)


def base_spans(text: str) -> list[Span]:
    """(start, place of the kind in KINDS, end) of the pattern spans, in that order."""
    found = []
    if holds(text, ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Places of the runs that may be keys, each once."""
    out, done = [], 0
    if not holds(text, STEMS):
        return out
    for word in SENSITIVE.finditer(text):
        stop = word.end() + NEAR
        for run in RUN.finditer(text, max(done, word.end())):
            if run.start() >= stop:
                break
            done, start = run.end(), run.start()
            if start == word.end():  # the word is part of a name; a value follows after "=", if at all
                start = text.find("=", start, done) + 1 or done
            own = text[start:done].rstrip(".")
            if len(own) >= LEAST and sum(c.search(own) is not None for c in CLASSES) > 1:
                out.append((start, start + len(own)))
    if not out or not base:
        return out
    begins = np.array([a for a, _, _ in base])
    reach = np.maximum.accumulate([b for _, _, b in base])  # how far the spans that began so far go
    at = np.searchsorted(begins, [b for _, b in out])
    return [(a, b) for (a, b), i in zip(out, at, strict=True) if i == 0 or reach[i - 1] <= a]


def sides(text: str, start: int, end: int) -> tuple[str, str]:
    """The text before and after, without copies of what stands between."""
    own = text[start:end]
    return text[max(0, start - SIDE) : start].replace(own, ""), text[end : end + SIDE].replace(own, "")


def novelty(compressor: zstandard.ZstdCompressor, text: str, start: int, end: int) -> float:
    """Compressed bytes a character that the candidate adds to what surrounds it."""
    before, after = sides(text, start, end)
    without = len(compressor.compress((before + after).encode()))
    return (len(compressor.compress((before + text[start:end] + after).encode())) - without) / (end - start)


def primed(identifiers: list[str]) -> zstandard.ZstdCompressor:
    """A compressor that knows the identifiers, the commonest nearest."""
    known = " ".join([*reversed(identifiers), KNOWN]).encode()
    primer = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with blanks in place of the spans, which are in order."""
    parts, at = [], 0
    for a, b in spans:
        if b > at:
            parts += [text[at:a], " " * (b - max(a, at))]
            at = b
    return "".join([*parts, text[at:]])


def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, in how many of its documents each identifier stands around a candidate."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            found = candidates(text, base) if text else []
            if not found:
                continue
            code = without(text, sorted(found + [(a, b) for a, _, b in base]))
            names: set[str] = set()
            seen = 0
            for start, end in found:  # what surrounds several is read once
                names.update(IDENTIFIER.findall(code, max(seen, start - SIDE), end + SIDE))
                seen = max(seen, end)
            counts.update(names)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["name", "n"])


def identifiers(docs: DataFrame, most: int = MOST) -> list[str]:
    """The identifiers of most documents around candidates, the commonest first."""
    counts = texts_of(docs).mapInArrow(identified, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return [r.name for r in counts.orderBy(F.desc("n"), "name").limit(most).collect()]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(batches: Iterator[pa.RecordBatch], known: list[str], novel: float) -> Iterator[pa.RecordBatch]:
    compressor = primed(known)
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            new = [(a, 3, b) for a, b in candidates(text or "", base) if novelty(compressor, text, a, b) >= novel]
            kinds = Counter(kind for _, kind, _ in base)
            rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + new))))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=[c.split()[0] for c in SPANS.split(", ")])


def secret_scan(docs: DataFrame, novel: float = NOVEL, keep_rows: bool = False) -> DataFrame:
    """doc_id, counts of pattern spans, their digest, and all spans of every row of docs (keep_rows: and its text and rest)."""
    small_batches(docs.sparkSession)
    known = identifiers(docs)
    return map_texts(docs, lambda it: scanned(it, known, novel), SPANS, keep_rows)


def op12_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
