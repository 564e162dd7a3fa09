"""Byte-level BPE: exact encoding in linear time, decoding by an offset table.

A text is cut into pre-tokens; each pre-token's bytes are encoded by
backtracking.  An Aho-Corasick automaton over the vocabulary gives the longest
token that starts at each byte.  The encoder takes it if it may follow the token
before it, else the next shorter token that is a prefix of it, else it steps
back one token.  Positions that led nowhere are remembered, so each is tried
once.  Two tokens may stand side by side if merging their bytes leaves them so;
that is read off the merge table by undoing the later merge step by step, and
kept in a table of judged pairs.  A sequence whose neighbours are all compatible
is the one that the merges give.

Pre-tokens repeat, so their ids are kept in a table of bounded size, which is
emptied when full; no result depends on it.

Defined results: a null text is empty and has no tokens; repeated rows are
encoded alike; the text of an added token is that one token; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEPT_WORDS = 500_000   # pre-tokens whose ids a worker keeps
KEPT_PAIRS = 300_000   # judged token pairs that a worker keeps


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable Latin-1 stands
    for itself, the others take code points from 256 on, in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


class Tokenizer:
    """Vocabulary tables of one byte-level BPE file, an encoder and a decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # tokens are numbered here by the step that makes them: single bytes, then merges in order
        parts = [as_bytes(t) for t in sorted((t for t in vocab if len(t) == 1), key=vocab.get)]
        number = {t: i for i, t in enumerate(parts)}
        self.halves = [(i, i) for i in range(len(parts))]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = as_bytes(left), as_bytes(right)
            pair = number[a], number[b]
            if a + b not in number:
                number[a + b] = len(parts)
                parts.append(a + b)
                self.halves.append(pair)
            self.joined.setdefault(pair, number[a + b])
        self.parts, self.number = parts, number
        ids = {as_bytes(t): i for t, i in vocab.items()}
        self.public = [ids[t] for t in parts]
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in parts]
        self.longest = ahocorasick.Automaton()
        for i, t in enumerate(parts):
            self.longest.add_word(t.decode("latin-1"), (i, len(t)))
        self.longest.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        # decoding: all tokens' bytes in a row, and where each begins
        n = max([*ids.values(), *self.added.values()]) + 1
        table = [b""] * n
        for t, i in ids.items():
            table[i] = t
        for t, i in self.added.items():
            table[i] = t.encode()
        self.size = np.array([len(t) for t in table], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.packed: dict[str, bytes] = {}
        self.listed: dict[str, str] = {}
        self.judged: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart.  Going back from the
        last step, the token made later falls into its halves; if the parts that
        then touch merge at an earlier step than those still to be undone, the
        merge would have crossed the boundary."""
        known = self.judged.get((left, right))
        if known is not None:
            return known
        a, b, until, ok = left, right, len(self.parts), True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < until:
                ok = False
                break
            if a > b:  # the left token is the later one: undo it, what lies at the boundary is its right half
                until, nxt = a, self.halves[a][1]
                if nxt == a:
                    break
                a = nxt
            else:      # the right token is later, or as late (a merge further left goes first)
                until, nxt = b + 1, self.halves[b][0]
                if nxt == b:
                    until, nxt = a, self.halves[a][1]
                    if nxt == a:
                        break
                    a = nxt
                    continue
                b = nxt
        if len(self.judged) >= KEPT_PAIRS:
            self.judged.clear()
        self.judged[left, right] = ok
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Token numbers of one pre-token."""
        whole = self.number.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        best = [0] * n
        for end, (token, size) in self.longest.iter(word.decode("latin-1")):
            best[end - size + 1] = token  # longer matches from the same byte end later
        parts, open_ = self.parts, bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0]
        while True:
            while token != -1:
                end = at + len(parts[token])
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token == -1:  # nothing fits here: this position is closed, shorten the token before it
                open_[at] = 0
                last = out.pop()
                at -= len(parts[last])
                token = self.shorter[last]
                continue
            out.append(token)
            at = end
            if at == n:
                return out
            token = best[at]

    def _learn(self, word: str) -> None:
        if len(self.packed) >= KEPT_WORDS:
            self.packed.clear()
            self.listed.clear()
        ids = [self.public[t] for t in self.encode_word(word.encode())]
        self.packed[word] = array("i", ids).tobytes()
        self.listed[word] = ",".join(map(str, ids))

    def encode_with_list(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and as decimals joined by commas."""
        packed, listed = [], []
        at = 0
        spans = [(m.start(), m.end(), self.added[m.group()]) for m in self.split_added.finditer(text)] if self.split_added else []
        for start, end, special in [*spans, (len(text), len(text), None)]:
            words = self.words.findall(text, at, start) if not spans else self.words.findall(text[at:start])
            for word in set(words):
                if word not in self.packed:
                    self._learn(word)
            try:
                packed += map(self.packed.__getitem__, words)
                listed += map(self.listed.__getitem__, words)
            except KeyError:  # the table was emptied half-way
                return self._encode_anew(text)
            if special is not None:
                packed.append(np.int32(special).tobytes())
                listed.append(str(special))
            at = end
        return b"".join(packed), ",".join(listed)

    def _encode_anew(self, text: str) -> tuple[bytes, str]:
        """As above, without the table of words: for a text with more different words than it holds."""
        packed, listed, at = [], [], 0
        for m in [*(self.split_added.finditer(text) if self.split_added else ()), None]:
            for word in self.words.findall(text[at:m.start() if m else len(text)]):
                ids = [self.public[t] for t in self.encode_word(word.encode())]
                packed.append(array("i", ids).tobytes())
                listed.append(",".join(map(str, ids)))
            if m:
                packed.append(np.int32(self.added[m.group()]).tobytes())
                listed.append(str(self.added[m.group()]))
                at = m.end()
        return b"".join(packed), ",".join(listed)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_with_list(text)[0], dtype="<i4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 16):
            some = ids[at:at + (1 << 16)]
            size = self.size[some]
            ends = np.cumsum(size)
            where = np.repeat(self.start[some] - (ends - size), size) + np.arange(ends[-1])
            out.append(self.blob[where].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of ``text`` in ``out``."""
    columns = [c for c in docs.columns if c != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != out), f"`{out}` array<int>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            yield b[columns].assign(**{out: [tok.encode(t or "") for t in b[text]]})

    return docs.mapInPandas(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of the token ids; a null array is an empty text."""
    columns = [c for c in rows.columns if c != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out), f"`{out}` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            yield b[columns].assign(**{out: [tok.decode(np.asarray(i if i is not None else [], dtype=np.int64)) for i in b[ids]]})

    return rows.mapInPandas(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text; per document the number of tokens and
    digests of the ids and of the decoded text.  Ids stay inside the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            rows = []
            for t in b["text"]:
                packed, listed = tok.encode_with_list(t or "")
                rows.append((len(packed) // 4, sha(listed.encode()), sha(tok.decode(np.frombuffer(packed, dtype="<i4")).encode())))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=b["doc_id"].to_numpy())

    return (docs.select("doc_id", "text").mapInPandas(run, "n_tokens long, ids_sha256 string, decoded_sha256 string, doc_id long")
            .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
