"""Packing by order-preserving dynamic programming.

Documents are tokenised in id order and laid end to end. A sequence is a window of at most ``length`` tokens of that
line. Windows may end where a document or a sentence ends, and, in stretches of more than ``length`` tokens without
such an end, at every full ``length``. The cost of a window is its padding plus a penalty for where it cuts: nothing at a
document's end, a little at a sentence's, more elsewhere. With P the tokens before a boundary, the best cost of a line
that ends at boundary j is length + penalty(j) - P[j] + min(cost[i] + P[i]) over the boundaries i at most ``length`` before
it: a sliding minimum, kept in a monotone queue. A partition holds a range of ids and works through it piece by piece of
bounded size; only the last window of a piece is open and goes into the next.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_parallelism

SENTENCE_PENALTY, CUT_PENALTY = 8, 48
#: Tokens that the dynamic programme works on at once, unless one document is longer.
PIECE = 1_000_000
#: Words whose ids a Python worker keeps, about 100 bytes each and 20 MB in all: workers outlive their tasks.
KEPT_WORDS = 200_000
#: ASCII marks that follow a word as one token string, without the apostrophe.
MARKS = b".,;:!?|*#%&$@-_()[]\""


class WordTokenizer:
    """Ids of a word-level BPE file as the ``tokenizers`` library gives them, with words' ids kept.

    The file's added tokens are taken out of a text first, as they stand; what is between
    falls into words at ASCII white space, which the file drops, so a word's ids don't depend on its neighbours.
    Words that weren't met are normalised and split as the file says, and merged by rank.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError("another kind of tokenizer file")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        plain = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("another kind of added token")
        self.added = {t.encode(): np.array([k], np.uint16).tobytes() for t, k in special.items()}
        self.taken_out = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=lambda t: (-len(t), t))) + b")") if self.added else None
        self.marks = sorted({t[:2] for t in self.added})
        if max(*vocab.values(), *special.values()) > 65_535:
            raise ValueError("more than 65,536 ids")
        ranks = {}
        for token, k in vocab.items():
            if token not in special:
                last = token.endswith(end)
                ranks[bytes(plain[c] for c in token.removesuffix(end)) + b"\xff" * last] = k
        self.encode = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.ends_sentence = np.zeros(65_536, bool)
        for token, k in vocab.items():
            if token.endswith(end) and set(token.removesuffix(end)) & set(".!?"):
                self.ends_sentence[k] = True
        self.kept = _Kept(self)

    def word(self, word: bytes) -> list[int]:
        letters = word.rstrip(MARKS)
        tail = word[len(letters) :]
        if letters.isalpha():  # ASCII letters, then perhaps marks: the usual case
            out = self.encode(letters.lower() + b"\xff")
        else:
            text = word.decode("utf-8", "replace")
            if not text.isascii():
                if any(unicodedata.category(c) == "Cn" for c in text):  # characters newer than Python's tables
                    return self.library.encode(text, add_special_tokens=False).ids
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            begin = text[: len(text) - len(tail)]
            if not begin.isalpha():
                return [x for piece in self.pattern.findall(text) for x in self.encode(piece.encode() + b"\xff")]
            out = self.encode(begin.encode() + b"\xff")
        return out + self.encode(tail + b"\xff") if tail else out

    def __call__(self, text: bytes) -> np.ndarray:
        if any(m in text for m in self.marks):
            return np.frombuffer(b"".join(self.added[p] if p in self.added else self._plain(p) for p in self.taken_out.split(text)), np.uint16)
        return np.frombuffer(self._plain(text), np.uint16)

    def _plain(self, text: bytes) -> bytes:
        return b"".join(map(self.kept.__getitem__, text.split()))


class _Kept(dict):
    """Ids of words as bytes, two to an id; a word that isn't held is worked out."""

    def __init__(self, owner: WordTokenizer) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.owner.word(word), np.uint16).tobytes()
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


def windows(boundary: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """Ends of the windows of least cost; boundary is increasing, from 0, with steps of at most length."""
    p, pen = boundary.tolist(), penalty.tolist()
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(p)):
        low = p[j] - length
        while p[queue[0][1]] < low:
            queue.popleft()
        value, back[j] = queue[0]
        value += pen[j] + length
        best[j] = value - p[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def boundaries(ends_sentence: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a line of tokens, and the penalty there."""
    n = len(ends_sentence)
    cost = np.full(n + 1, -1.0)
    cost[np.flatnonzero(ends_sentence) + 1] = SENTENCE_PENALTY
    cost[0] = 0
    cost[doc_ends] = 0
    cost[n] = 0
    at = np.flatnonzero(cost >= 0)
    for k in np.flatnonzero(np.diff(at) > length).tolist():
        cost[np.arange(at[k] + length, at[k + 1], length)] = CUT_PENALTY
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_tokenizers: dict[str, WordTokenizer] = {}


def _pack(path: str, length: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        sequence = TaskContext.get().partitionId() << 40
        line: list[tuple[int, int, int, np.ndarray]] = []  # id, ids before, ids of the document, ids
        held = 0

        def settle(last: bool) -> pa.RecordBatch | None:
            nonlocal line, held, sequence
            if not line:
                return None
            ids = np.concatenate([x[3] for x in line])
            ends = np.cumsum([len(x[3]) for x in line])
            whole = np.array([x[1] + len(x[3]) == x[2] for x in line])
            cuts = windows(*boundaries(tokenizer.ends_sentence[ids], ends[whole], length), length)
            if not last:
                cuts = cuts[:-1]
            done = int(cuts[-1]) if len(cuts) else 0
            starts = np.concatenate([[0], cuts[:-1]])
            edge = np.unique(np.concatenate([[0], ends[ends < done], cuts]))
            a, b = edge[:-1], edge[1:]
            owner = np.searchsorted(ends, a, side="right")
            seq = np.searchsorted(cuts, a, side="right")
            begin = ends - np.array([len(x[3]) for x in line])
            before, size = (np.array([x[k] for x in line], np.int64) for k in (1, 2))
            doc = pa.array([x[0] for x in line], pa.int64())
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            out = [a - begin[owner] + before[owner], b - a, np.array(crc, np.int64), size[owner], seq + sequence, a - starts[seq] if len(starts) else a]
            sequence += len(cuts)
            rest, to = [], 0
            for (d, s, n, v), e in zip(line, ends.tolist(), strict=True):
                if e > done:
                    skip = max(0, done - to)
                    rest.append((d, s + skip, n, v[skip:]))
                to = e
            line, held = rest, len(ids) - done
            return pa.RecordBatch.from_arrays([doc.take(pa.array(owner)), *(pa.array(x.astype(np.int64), pa.int64()) for x in out)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.append(tokenizer(texts[i].as_py() or b""), np.uint16(end_id))
                line.append((doc, 0, len(ids), ids))
                held += len(ids)
                if held > PIECE:
                    yield settle(False)
        found = settle(True)
        if found is not None:
            yield found

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then end_id; null text: end_id alone. Rows are packed in id order within
    ranges of ids (rows of an equal id one after another, each as a document of its own); every range ends with an own
    window. Rows with a null id are packed too, first of all. Empty input: no rows. Other columns are not read. The file
    at tokenizer_path must stand on every executor.
    """
    partitions = partitions or default_parallelism(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = source.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(_pack(tokenizer_path, length, end_id), PIECES)
