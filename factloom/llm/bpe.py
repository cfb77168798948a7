"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct new words of a batch form a trie, held as a sorted list: a word's branch leaves that of
the word before it where their common prefix ends. One depth-first walk, in that order, gives each
node the last token of the encoding of its prefix, once. A token t ends the encoding of a prefix exactly if t is a
suffix of it and (u, t) is a pair that BPE leaves as it is, u being the last token of what precedes
t (or nothing precedes and t encodes to itself). So prefixes that words share are encoded once, and
a word's tokens are read by stepping back from its leaf. White-space chunks are looked up by a
bounded cache of what earlier batches encoded; texts are never cut.

Defined results: a null text is empty; an empty text has no tokens, the digests of nothing; rows
with equal doc_ids are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Texts, small_batches, table, texts_of

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
#: What a worker remembers of earlier batches.
MAX_CHUNKS, MAX_WORDS = 500_000, 300_000
#: Tokens rendered at a time.
STEP = 1 << 17

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes words of one-character symbols, the last of which carries the word end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.sizes = {t: len(t) - (len(END) if t.endswith(END) and t != END else 0) for t in vocab}
        self.longest = max(self.sizes.values(), default=1)
        self.known: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        n = self.sizes[token]
        return [*token[: n - 1], token[n - 1 :]]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE; only ever run over the symbols of one or two tokens."""
        while len(symbols) > 1:
            best, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fits(self, left: str, token: str) -> bool:
        """Whether BPE leaves `token` standing after `left` ('' for a word's start)."""
        pair = left, token
        if pair not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            both = (self.symbols(left) if left else []) + self.symbols(token)
            self.known[pair] = self.merged(both) == ([left] if left else []) + [token]
        return self.known[pair]

    def last(self, word: str, depth: int, lasts: list[str], end: str) -> str:
        """The last token of the word's prefix of that depth, given those of all shorter prefixes.

        Exactly one token fits, so the order of trying is free: the token before it drawn out by
        one character, that character alone, then all others from the longest down.
        """
        c, before = word[depth - 1] + end, lasts[depth - 1]
        token = before + c
        if before and token in self.sizes and self.fits(lasts[depth - 1 - self.sizes[before]], token):
            return token
        if self.fits(before, c):
            return c
        for n in range(min(depth, self.longest), 1, -1):
            token = word[depth - n : depth] + end
            if token in self.sizes and self.fits(lasts[depth - n], token):
                return token
        raise ValueError(f"no token ends {word[:depth]!r}")

    def back(self, token: str, depth: int, lasts: list[str]) -> list[int]:
        out = []
        while token:
            out.append(self.vocab[token])
            depth -= self.sizes[token]
            token = lasts[depth]
        return out[::-1]

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of the words, which come in order and once each."""
        out: dict[str, list[int]] = {}
        lasts, previous = [""], ""
        for word in words:
            shared = common_prefix(previous, word)
            del lasts[min(shared, len(word) - 1) + 1 :]
            for depth in range(len(lasts), len(word)):
                lasts.append(self.last(word, depth, lasts, ""))
            out[word] = self.back(self.last(word, len(word), lasts, END), len(word), lasts)
            previous = word[:-1]
        return out


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Codec:
    """The tokenizer of a vocabulary file: normalises, splits, encodes by trie and decodes."""

    def __init__(self, spec: str):
        made = json.loads(spec)
        model = made["model"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.trie = TrieEncoder(model["vocab"], merges)
        split = next(p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        tokens = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        texts = [(tokens.get(i, "") + " ").encode() for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(x) for x in texts])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.rendered = np.frombuffer(b"".join(texts), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.chunks: dict[bytes, int] = {}
        self.at, self.count, self.flat = array("q"), array("q"), array("I")

    def split(self, chunks: list[bytes]) -> list[list[str]]:
        """The words of each chunk, all chunks in one go (none holds a line feed)."""
        text = unicodedata.normalize("NFC", b"\n".join(chunks).decode()).replace("Σ", "σ").lower()
        return [self.pieces.findall(c) for c in text.split("\n")]

    def learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks: their distinct new words by one trie."""
        split = self.split(chunks) if chunks else []
        if len(self.words) > MAX_WORDS:  # what was in use lately stays at hand in `older`
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        new = {w for ws in split for w in ws if w not in words}
        words.update((w, older[w]) for w in new if w in older)
        spell = self.letters.__getitem__
        spelled = {"".join(map(spell, w.encode())): w for w in new if w not in older}
        words.update((spelled[s], ids) for s, ids in self.trie.encode(sorted(spelled)).items())
        for chunk, own in zip(chunks, split, strict=True):
            self.chunks[chunk] = len(self.at)
            self.at.append(len(self.flat))
            for w in own:
                self.flat.extend(words[w])
            self.count.append(len(self.flat) - self.at[-1])

    def keep(self, chunks: list[bytes]) -> None:
        """Forget all chunks but these."""
        kept = [(c, self.chunks[c]) for c in chunks if c in self.chunks]
        at, count, flat = self.at, self.count, self.flat
        self.chunks, self.at, self.count, self.flat = {}, array("q"), array("q"), array("I")
        for chunk, i in kept:
            self.chunks[chunk] = len(self.at)
            self.at.append(len(self.flat))
            self.count.append(count[i])
            self.flat.extend(flat[at[i] : at[i] + count[i]])

    def encode_batch(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        _, first, back = np.unique(texts.hashes(), return_index=True, return_inverse=True)
        own = [texts.word(i) for i in first.tolist()]
        if len(self.chunks) > MAX_CHUNKS:
            self.keep(own)
        self.learn([c for c in own if c not in self.chunks])
        slot = np.fromiter(map(self.chunks.__getitem__, own), np.int64, len(own))[back]
        at, count, flat = np.array(self.at), np.array(self.count), np.array(self.flat)
        counts = count[slot]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(at[slot] - total[:-1], counts) + np.arange(total[-1])].astype("<u4")
        return ids, total[texts.first]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, special tokens in it included."""
        out = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4"))
            elif part:
                out.append(self.encode_batch(Texts(pa.array([part])))[0])
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decoded text in pieces."""
        for a in range(0, len(ids), STEP):
            part = ids[a : a + STEP]
            n = self.lengths[part]
            total = np.cumsum(n)
            out = self.rendered[np.repeat(self.begins[part] - (total - n), n) + np.arange(total[-1])].tobytes()
            yield out if a + STEP < len(ids) else out[:-1]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decoded(np.asarray(ids))).decode(errors="replace")


_codecs: dict[int, Codec] = {}


def codec_of(spec: str) -> Codec:
    """One codec a worker, kept between tasks."""
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encoded(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    codec = codec_of(spec)
    for batch in batches:
        texts = Texts(batch.column(1))
        ids, begins = codec.encode_batch(texts)
        rows = []
        for i in range(len(texts)):
            own = ids[begins[i] : begins[i + 1]]
            text = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
            if codec.special and (raw := text.tobytes()).find(b"<|") >= 0 and codec.specials.search(raw.decode()):
                own = codec.encode(raw.decode())
            digest = hashlib.sha256()
            for part in codec.decoded(own):
                digest.update(part)
            rows.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), digest.hexdigest()))
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def tokenizer_spec(path: str | None = None) -> str:
    """The vocabulary file's content; by default the public file named TOKENIZER."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Path(path).read_text(encoding="utf-8")


def bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(tokenizer_spec(path))
    return texts_of(docs).mapInArrow(lambda it: encoded(it, spec.value), ENCODED)


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"))
