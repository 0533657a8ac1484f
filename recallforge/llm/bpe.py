"""Byte-pair encoding and decoding by traversing a trie of distinct words.

A text is cut into words by the pre-tokenizer's pattern. The distinct words of a batch go into a trie
of their bytes, and a depth-first walk gives every node the last token of the encoding of the bytes on
the way to it. That state follows from the states of shorter prefixes alone: of the tokens that end
here, exactly one forms, with the last token of what stands before it, a pair that the merges leave
apart. A prefix that many words share is therefore computed once; a word's tokens are read backwards
from its node. Decoding concatenates the tokens' bytes.

Work is one pass over the documents without a shuffle. Within a task a worker keeps the words it has seen,
CACHED at most; a full cache is emptied, which changes no result.

Defined cases: null and empty texts have no tokens and the digest of the empty string; the added
token's string inside a text becomes that token, as the tokenizers library does by default; equal
texts get equal values; of merges of equal rank (ties) the leftmost goes first, as in the library; a very long text meets
few others in one trie, and a word longer than KEPT_BYTES isn't kept; extra columns aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import prepare, slices, trim

#: Words that a worker keeps, and the longest word (bytes) that is kept.
CACHED, KEPT_BYTES = 450_000, 64
#: The pre-tokenizer's pattern of byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabulary files: printable Latin-1 stands for itself, the
    other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str, packed: bool = False):
        """packed: keep words' ids as 32-bit numbers, else as text together with the decoded bytes."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, model = byte_alphabet(), spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("not a plain byte-level BPE file")
        before, after = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or after.get("type") != "ByteLevel" or spec.get("post_processor"):
            raise ValueError("only the byte-level pre-tokenizer with its pattern, its decoder and no post-processor are known")
        if any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that stand for exactly their text are known")
        raw = {bytes(to_byte[c] for c in s): i for s, i in model["vocab"].items() if all(c in to_byte for c in s)}
        self.bytes_of = {i: b for b, i in raw.items()}
        self.bytes_of |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (raw[bytes(to_byte[c] for c in x)] for x in (m if isinstance(m, list) else m.split(" ")))
            both = raw[self.bytes_of[a] + self.bytes_of[b]]
            self.rank.setdefault((a, b), r)
            self.made.setdefault((a, b), both)
        self.bytes_id = {b: i for b, i in raw.items() if len(b) == 1}
        # Tokens that merging their own bytes gives; the others never occur in an encoding.
        self.id_of = {b: i for b, i in raw.items() if self._merge(b) == [i]}
        for (a, b), c in self.made.items():  # the split that the merges take on the way to c
            if self.id_of.get(self.bytes_of[c]) == c and self._last_merge(self.bytes_of[c]) == (a, b):
                self.parts[c] = (a, b)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.width = {i: len(b) for i, b in self.bytes_of.items()}
        self.text_of = {} if packed else {i: str(i) for i in self.bytes_of}
        self.packed_of = {i: i.to_bytes(4, "little") for i in self.bytes_of} if packed else {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[str, bytes] | bytes] = {}
        self.packed = packed
        self._tails()

    def _tails(self) -> None:
        """Trie of the reversed tokens: byte to [children, token id or -1]."""
        self.tail: dict = {}
        for b, i in self.id_of.items():
            node = self.tail
            for c in b[:0:-1]:
                node = node.setdefault(c, [{}, -1])[0]
            node.setdefault(b[0], [{}, -1])[1] = i

    def _steps(self, word: bytes):
        ids, last = [self.bytes_id[word[i : i + 1]] for i in range(len(word))], None
        while len(ids) > 1:
            r, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            last = (ids[i], ids[i + 1])
            ids[i : i + 2] = [self.made[last]]
        return ids, last

    def _merge(self, word: bytes) -> list[int]:
        """Plain merging of one word; used to prepare the vocabulary only."""
        return self._steps(word)[0]

    def _last_merge(self, word: bytes):
        return self._steps(word)[1]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens leaves exactly these two tokens.

        Undo the later of the two tokens' last merges step by step; if at any step the touching
        pair would have merged before the undone merge, the two don't stand next to each other.
        """
        known = self.apart.get((left, right))
        if known is None:
            known = self.apart[left, right] = self._stands(left, right)
            if len(self.apart) > CACHED // 2:
                self.apart.clear()
        return known

    def _stands(self, left: int, right: int) -> bool:
        rank, parts = self.rank, self.parts
        made = lambda t: rank[parts[t]] if t in parts else -1
        if (left, right) in rank:
            return False
        while True:
            a, b = made(left), made(right)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token's last merge comes later: undo it, its right part touches
                limit, left = a, parts[left][1]
                if rank.get((left, right), 1 << 60) < limit:
                    return False
            else:  # a touching pair of the same rank stands further left and would have merged first
                limit, right = b + 1, parts[right][0]
                if rank.get((left, right), 1 << 60) < limit:
                    return False

    def encode_words(self, words: list[str]) -> None:
        """Put the encodings of the distinct words into the cache.

        Sorted words are the trie's depth-first order: what a word shares with the one before it is
        the way to their common node, whose states stay, and the rest of the word is new nodes.
        """
        tail, apart, width = self.tail, self.apart, self.width
        way = b""
        last: list[int] = []  # last token at each depth of the way
        for raw, w in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for x, y in zip(way, raw):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared, len(raw)):
                node, i = tail, end
                while True:  # tokens that end here, the shortest first
                    found = node.get(raw[i])
                    if found is None:
                        raise AssertionError(f"no last token for {raw[: end + 1]!r}")
                    node, token = found
                    if token >= 0:
                        if not i:
                            break
                        pair = last[i - 1], token
                        ok = apart.get(pair)
                        if ok or ok is None and self.stands(*pair):
                            break
                    i -= 1
                    if i < 0:
                        raise AssertionError(f"no last token for {raw[: end + 1]!r}")
                last.append(token)
            way, i, ids = raw, len(raw), []
            while i:
                token = last[i - 1]
                ids.append(token)
                i -= width[token]
            ids.reverse()
            self.words[w] = self._entry(ids)

    def _entry(self, ids: list[int]) -> tuple[str, bytes] | bytes:
        """What is kept of a word's ids; see packed."""
        if self.packed:
            return b"".join(map(self.packed_of.__getitem__, ids))
        return ",".join(map(self.text_of.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def entries(self, texts: list[str | None]):
        """The cache entries of each text's words, in order."""
        cut = []
        for t in texts:
            if self.added and any(s in (t or "") for s in self.added):
                words: list[str] = []
                for p in self.special.split(t):
                    words.extend([p] if p in self.added else self.pattern.findall(p))
                cut.append(words)
            else:
                cut.append(self.pattern.findall(t or ""))
        if len(self.words) > CACHED:
            self.words.clear()
        for s, i in self.added.items():
            self.words[s] = self._entry([i])
        distinct: set[str] = set()
        for words in cut:
            distinct.update(words)
        new = distinct - self.words.keys()
        self.encode_words(list(new))
        out = [list(map(self.words.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > KEPT_BYTES:
                del self.words[w]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """(number of tokens, ids joined by commas, decoded bytes) of each text."""
        out = []
        for got in self.entries(texts):
            joined = ",".join([g[0] for g in got])
            out.append((joined.count(",") + bool(joined), joined, b"".join([g[1] for g in got])))
        return out


@lru_cache(maxsize=2)
def load(path: str, packed: bool = False) -> ByteBPE:
    """The vocabulary of a file, read once in each worker."""
    return ByteBPE(path, packed)


def _forget(bpe: ByteBPE) -> None:
    """Empty the caches at the end of a task: the worker may idle through other stages."""
    bpe.words.clear()
    bpe.apart.clear()
    trim()


def _chunks(texts: list, most: int = 4_000_000):
    """Runs of texts of about `most` characters, so that very long texts don't meet in one trie."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= most:
            yield run
            run, held = [], 0
    yield run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    prepare(docs.sparkSession)

    def batches(it):
        bpe = load(path)
        for b in slices(it):
            n, ids, decoded = [], [], []
            for run in _chunks(b.column(1).to_pylist()):
                for k, joined, raw in bpe.encode_batch(run):
                    n.append(k)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _forget(bpe)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, *kept: str) -> DataFrame:
    """doc_id, the columns named in `kept`, n_tokens and ids, array<int>, of each row."""
    prepare(docs.sparkSession)
    names = ["doc_id", *kept]
    shape = docs.select(names).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))

    def batches(it):
        bpe = load(path, packed=True)
        for b in slices(it):
            packed = [b"".join(got) for run in _chunks(b.column(len(names)).to_pylist()) for got in bpe.entries(run)]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(np.diff(ends), pa.int64()), ids], [*names, "n_tokens", "ids"])
        _forget(bpe)

    return docs.select(*names, F.col("text").cast("string").alias("__text")).mapInArrow(batches, shape)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; invalid UTF-8 becomes U+FFFD, null ids become ''."""
    prepare(encoded.sparkSession)

    def batches(it):
        raw = load(path).bytes_of
        for b in slices(it):
            texts = [b"".join(map(raw.__getitem__, ids or [])).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, encoded.select("doc_id").schema.add("text", "string"))
