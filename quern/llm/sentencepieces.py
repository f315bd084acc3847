"""Unigram encoding and decoding over a public piece vocabulary.

A double-array trie over the UTF-8 bytes of the pieces finds every piece that
starts at a character; Viterbi takes the segmentation with the largest sum of
log scores. Characters without a piece become byte pieces. A space is written as
the marker U+2581, and one marker is put before the text.

The vocabulary file gives an order of pieces, not probabilities: its scores are
merge ranks. The log scores used here follow from the rank r by the
Zipf-Mandelbrot rule ``-EXPONENT * ln(r + SHIFT)``, normalised over the pieces.

Defined results: null and empty text have no tokens. A literal U+2581 is written
as bytes, so decoding is exact for every text, however long. Of segmentations with
equal scores the one whose last pieces are longest is given. Rows are independent:
repeated rows and rows without doc_id give repeated results and other columns, whatever
their names, don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import KEY_TYPES, by_block, map_arrow

MARK = "▁"
EXPONENT, SHIFT = 1.07, 2.7
#: Score of a character without a piece, below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a worker remembers, and the longest such chunk.
CACHE_SIZE, CACHE_CHARS = 250_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """A trie in two arrays: the child of s by byte b is t = base[s] + b + 1, if check[t] == s."""

    def __init__(self, base: list[int], check: list[int], value: list[int]):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        """Place the sorted keys' nodes breadth first, each sibling set at the first gap that holds it.

        Free slots are the set bits of an integer, so one AND of shifted copies finds every fitting place at once.
        """
        ordered = sorted(keys)
        room = 2 * sum(map(len, ordered)) + 1024
        free = (1 << room) - 2
        base, check, value = {}, {0: 0}, {}
        todo = [(0, 0, len(ordered), 0)]
        for state, lo, hi, depth in todo:
            if lo < hi and len(ordered[lo]) == depth:
                value[state] = keys[ordered[lo]]
                lo += 1
            children: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                b, j = ordered[i][depth], i
                while j < hi and ordered[j][depth] == b:
                    j += 1
                children.append((b + 1, i, j))
                i = j
            if not children:
                continue
            fits = -1
            for b, _, _ in children:
                fits &= free >> b
            at = (fits & -fits).bit_length() - 1
            base[state] = at
            taken = 0
            for b, i, j in children:
                check[at + b] = state
                taken |= 1 << (at + b)
                todo.append((at + b, i, j, depth + 1))
            free ^= taken
        size = max(check) + 258
        return cls(*([d.get(i, none) for i in range(size)] for d, none in ((base, 0), (check, -1), (value, -1))))

    def prefixes(self, data: bytes, start: int = 0) -> list[tuple[int, int]]:
        """(end, value) of every key that starts at ``start``."""
        out, s = [], 0
        for i in range(start, len(data)):
            t = self.base[s] + data[i] + 1
            if self.check[t] != s:
                break
            s = t
            if self.value[s] >= 0:
                out.append((i + 1, self.value[s]))
        return out


@dataclass
class Pieces:
    """A vocabulary: pieces by id, log scores by id, byte pieces' ids, and the trie."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    trie: DoubleArray
    cuttable: bool
    texts: list[bytes]
    unknown: float
    byte_set: frozenset = frozenset()
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls.make(pieces, sorted(plain, key=lambda i: (-model.get_score(i), i)), byte_ids)

    @classmethod
    def make(cls, pieces: list[str], ranked: list[int], byte_ids: list[int], given: dict[int, float] | None = None) -> Pieces:
        """``ranked``: ids of ordinary pieces, likeliest first; ``given``: their log scores, else by rank."""
        raw = [-EXPONENT * math.log(r + 1 + SHIFT) for r in range(len(ranked))]
        whole = math.log(sum(map(math.exp, raw))) if raw else 0.0
        scores = [0.0] * len(pieces)
        for i, x in zip(ranked, raw, strict=True):
            scores[i] = given[i] if given else x - whole
        trie = DoubleArray.build({pieces[i].encode(): i for i in ranked})
        cuttable = all(MARK not in pieces[i].lstrip(MARK) and "\n" not in pieces[i] and not _AFTER_LETTER.search(pieces[i]) for i in ranked)
        texts = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
        worst = min((scores[i] for i in ranked), default=0.0)
        return cls(pieces, scores, byte_ids, trie, cuttable, texts, worst - UNKNOWN_PENALTY, frozenset(byte_ids))

    def viterbi(self, chunk: str) -> list[int]:
        """The best segmentation of a chunk, the earlier found one among equals."""
        data = chunk.encode()
        n = len(data)
        base, check, value, scores, unknown = self.trie.base, self.trie.check, self.trie.value, self.scores, self.unknown
        best = [-1e300] * (n + 1)
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -1e300:
                continue
            s, whole = 0, False
            b = data[i]
            end = i + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            for j in range(i, n):
                t = base[s] + data[j] + 1
                if check[t] != s:
                    break
                s = t
                v = value[s]
                if v >= 0:
                    j += 1
                    whole = whole or j == end
                    x = here + scores[v]
                    if x > best[j]:
                        best[j] = x
                        start[j] = i
                        piece[j] = v
            if not whole and here + unknown > best[end]:
                best[end] = here + unknown
                start[end] = i
                piece[end] = -1
        out: list[int] = []
        at = n
        while at:
            i, v = start[at], piece[at]
            if v >= 0:
                out.append(v)
            else:
                out.extend(self.byte_ids[b] for b in reversed(data[i:at]))
            at = i
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        found = np.array(self.viterbi(chunk), np.int32).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text. Cutting before markers, at line ends and before stops that follow a letter is exact: no piece spans such a place."""
        if not text:
            return np.empty(0, np.int32)
        out: list[bytes] = []
        literal = np.array([self.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(literal)
            part = part.replace(" ", MARK)
            if k == 0:
                part = MARK + part
            get = self.cache.get
            out += [get(c) or self._chunk(c) for c in (_CHUNK.findall(part) if self.cuttable else [part] * bool(part))]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, the first marker taken off."""
        texts = self.texts
        whole = b"".join([texts[i] for i in ids.tolist()])
        first = len(ids) and int(ids[0]) not in self.byte_set
        return (whole[1:] if first and whole[:1] == b" " else whole).decode("utf-8", "replace")


#: A run of markers and what follows up to the next; a full stop or comma after a letter begins a chunk of its own.
_CHUNK = re.compile(rf"{MARK}*[^{MARK}\n](?:[^{MARK}\n.,]|(?<![A-Za-z\u00C0-\u024F])[.,])*|{MARK}+|\n")


_AFTER_LETTER = re.compile(r"[A-Za-z\u00C0-\u024F][.,]")


@lru_cache(2)
def vocabulary(path: str) -> Pieces:
    return Pieces.load(path)


SCHEMA = "n_tokens long, n_byte_tokens long, token_ids array<int>, round_trip boolean"


def encode_column(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``df``: key, number of tokens and of byte tokens, the ids, and whether decoding gives the text back.

    No shuffle: rows are encoded where they are read. The vocabulary goes out once
    as a broadcast of fixed size.
    """
    held = spark.sparkContext.broadcast(vocabulary(path or default_vocabulary()))
    kind = df.schema[key].dataType.simpleString()

    def work(keys: list, texts: list) -> pa.RecordBatch:
        v = held.value
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids] = True
        ids = [v.encode(t) for t in texts]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        byte_sum = np.concatenate([[0], np.cumsum(is_byte[flat])]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, KEY_TYPES.get(kind)),
                pa.array(sizes),
                pa.array(byte_sum[starts[1:]] - byte_sum[starts[:-1]]),
                pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat)),
                pa.array([v.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]),
            ],
            names=[key, "n_tokens", "n_byte_tokens", "token_ids", "round_trip"],
        )

    return map_arrow(df.select(key, text), by_block([key, text], work), f"`{key}` {kind}, {SCHEMA}")




def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents."""
    from .common import table

    return encode_column(spark, table(spark, sf_dir, "documents"))
