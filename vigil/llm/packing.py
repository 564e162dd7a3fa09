"""Cost-balanced packing of token sequences.

A document's cost in a sequence is ``LINEAR * n + QUADRATIC * n * n`` for a
piece of n tokens: the attention part grows with the square of a piece, for
pieces do not attend to each other.  Documents are taken in descending order of
cost; each goes to the sequence that has the lowest cost so far and tokens left,
preferring one of the cheapest few that holds it whole, and is cut where its
sequence is full.

Documents are dealt by hash into groups of about ``GROUP_BYTES`` of text, so
their number grows with the data; a group is packed in one task.  A group of T
tokens gets T // capacity full sequences; the tokens that remain fill sequences
whose lengths are the powers of two that add up to them.  No place is padded.

Defined results: a null text is empty, its only token is the end token; a text
longer than a sequence is cut; ties in cost go by doc_id; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.bpe import byte_alphabet
from vigil.llm.common import blocks_for

CAPACITY = 4096
END_TOKEN = 2
GROUP_BYTES = 6 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
TRIES = 8              # cheapest sequences that are tried for one that holds a document whole
KEPT_WORDS = 300_000   # words whose ids a worker keeps; the table is emptied when full
LETTERS_THEN_MARKS = re.compile(r"([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
BYTE_LETTERS = {b: c for c, b in byte_alphabet().items()}
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double")


class WordIds:
    """Ids of whole texts by a tokenizer whose tokens never cross white space:
    texts are split at blanks, and words that were seen before are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.kept: dict[str, bytes] = {"": b""}
        self.model = self.tok.model
        self.bases: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Latin-1 letters need no normalizing but lower case, are one pre-token,
        and never join the marks after them, so they go to the BPE model straight
        away; all other words take the library's whole path."""
        kept, bases, others, pairs = self.kept, self.bases, [], []
        for w in words:
            m = LETTERS_THEN_MARKS(w)
            if m is None:
                others.append(w)
                continue
            base = m[1].lower()
            ids = bases.get(base)
            if ids is None:
                letters = base if base.isascii() else base.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = bases[base] = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
            if m[2]:
                pairs.append((w, ids, m[2]))
            else:
                kept[w] = ids
        marks = {p[2] for p in pairs}.difference(kept)
        others += marks
        for w, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False), strict=True):
            kept[w] = array(self.code, e.ids).tobytes()
        for w, ids, mark in pairs:
            kept[w] = ids + kept[mark]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        out = []
        for at in range(0, len(texts), 32):
            some = [text.replace("\n", " ").split(" ") for text in texts[at:at + 32]]
            if len(self.kept) > KEPT_WORDS:
                self.kept, self.bases = {"": b""}, {}
            new = set().union(*some).difference(self.kept)
            if new:
                self._learn(list(new))
            out += [b"".join(map(self.kept.__getitem__, words)) for words in some]
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized(docs: DataFrame, path: str, n_groups: int) -> DataFrame:
    """``doc_id, grp, ids``: packed ids of every text, and the group it is dealt to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = word_ids(path)
        end = np.array([END_TOKEN], dtype=tok.dtype).tobytes()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "grp": b["grp"], "wide": tok.dtype.itemsize,
                                "ids": [i + end for i in tok.packed([t or "" for t in b["text"]])]})

    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups))
    return (docs.select("doc_id", "text", group.alias("grp"))
            .mapInPandas(run, "doc_id long, grp long, wide int, ids binary"))


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the powers of two that make up the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> Iterator[tuple[int, int, int, int, int]]:
    """``document, start, length, sequence, offset`` of each piece; the lengths
    come in descending order.  A short sequence starts with the cost of the
    places it lacks, so that long documents do not go there first."""
    sizes = capacities(sum(lengths), capacity)
    left = list(sizes)
    heap = [(linear * (capacity - s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            need, tried = length - start, []
            while heap and len(tried) < TRIES:
                tried.append(heapq.heappop(heap))
                if left[tried[-1][1]] >= min(need, capacity):
                    break
            pick = len(tried) - 1 if left[tried[-1][1]] >= min(need, capacity) else 0
            cost, seq = tried.pop(pick)
            for t in tried:
                heapq.heappush(heap, t)
            put = min(need, left[seq])
            yield doc, start, put, seq, sizes[seq] - left[seq]
            start += put
            left[seq] -= put
            if left[seq]:
                heapq.heappush(heap, (cost + linear * put + quadratic * put * put, seq))


def pack(rows: DataFrame, n_groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (see ``PIECES``) of tokenized documents; ``ids`` are little-endian unsigned 32-bit integers."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = int(group["wide"].iloc[0])
        number = int(group["grp"].iloc[0])
        counts = group["ids"].map(len) // wide
        group = group.assign(n=counts).sort_values(["n", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        ids = [np.frombuffer(b, dtype=f"<u{wide}") for b in group["ids"]]
        out = []
        for doc, start, length, seq, offset in assign(group["n"].tolist(), capacity):
            piece = ids[doc][start:start + length].astype("<u4").tobytes()
            out.append((doc, start, length, piece, seq * n_groups + number, offset, LINEAR * length + QUADRATIC * length * length))
        got = pd.DataFrame(out, columns=["doc", "start", "length", "ids", "sequence_id", "offset", "cost"])
        at = got.pop("doc").to_numpy()
        return got.assign(doc_id=group["doc_id"].to_numpy()[at], doc_tokens=group["n"].to_numpy()[at])[[c.split()[0] for c in PIECES.split(", ")]]

    return rows.groupBy("grp").applyInPandas(run, PIECES)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents.  The number of groups follows the bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    n_groups = blocks_for(total, GROUP_BYTES)
    return pack(tokenized(docs, path, n_groups), n_groups, capacity)
