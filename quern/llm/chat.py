"""Chat formatting at the level of tokens.

Each turn is encoded as separate segments, role and text, and reserved ids are
spliced around them: ``TURN role MID text END``. Reserved ids lie above the
vocabulary, so no text can produce them. The loss mask covers the text of the
roles to learn; it is kept as a range of token positions that follows from
prefix sums of segment lengths. In the written form a reserved id is a control
string; a control string inside a role or a text gets a backslash before it, and
so does each backslash, which ``unescape`` undoes exactly.

Defined results: null text or role is empty; turns are ordered by turn (null
first), then role, then text, and repeated rows are turns of their own; a null
conv_id is a conversation; a very long text is encoded by itself and a conversation of
any length streams through; other columns, whatever their names, are never read; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, table

#: Control strings of the template, by name.
TURN, MID, END = "### ", ": ", " </turn>\n"
#: What a text may not contain unescaped: every form in which a control string could be read.
CONTROLS = ("###", "</turn>")
LEARNED_ROLES = ("assistant",)
PROBE_TEXT = "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    """A text without control strings: backslashes are doubled, control strings get one in front."""
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def escape_role(role: str) -> str:
    """Roles also escape colons, as ``MID`` ends them."""
    return re.sub(r"\\|###|</turn>|:", lambda m: "\\" + m[0], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", role)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@dataclass
class Codec:
    """A byte-pair vocabulary and the three reserved ids above it."""

    pattern: str
    ranks: dict[bytes, int]

    def __post_init__(self):
        self._encoding = None
        top = max(self.ranks.values()) + 1
        self.turn, self.mid, self.end = top + 1, top + 2, top + 3

    def __getstate__(self):
        return {"pattern": self.pattern, "ranks": self.ranks}

    def __setstate__(self, state):
        self.__init__(**state)

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("segments", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def turn_ids(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids of a turn and the range of them that holds its text."""
        parts = [[self.turn], self.encoding.encode_ordinary(escape_role(role)), [self.mid], self.encoding.encode_ordinary(escape(text)), [self.end]]
        ends = np.cumsum([len(p) for p in parts])
        return np.concatenate([np.array(p, np.int32) for p in parts]), int(ends[2]), int(ends[3])

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """Roles and texts of a run of turns, unescaped."""
        out = []
        for a, m, z in zip(*((ids == x).nonzero()[0].tolist() for x in (self.turn, self.mid, self.end)), strict=True):
            role, text = (self.encoding.decode(ids[i + 1 : j].tolist()) for i, j in ((a, m), (m, z)))
            out.append((unescape_role(role), unescape(text)))
        return out

    def written(self, ids: np.ndarray) -> str:
        """The written form: segments decoded, reserved ids as control strings."""
        names = {self.turn: TURN, self.mid: MID, self.end: END}
        cuts = (ids > max(self.turn - 2, 0)).nonzero()[0].tolist()
        out, lo = [], 0
        for c in cuts:
            out += [self.encoding.decode(ids[lo:c].tolist()), names[int(ids[c])]]
            lo = c + 1
        return "".join(out) + self.encoding.decode(ids[lo:].tolist())


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(pattern, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


_WRITTEN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?! </turn>\n)[^\\])*) </turn>\n", re.S)


def parse_written(form: str) -> list[tuple[str, str]]:
    """Roles and texts read back from the written form."""
    return [(unescape_role(r), unescape(t)) for r, t in _WRITTEN.findall(form)]


TURNS = "conv_id long, turn long, role string, text string, ids binary, text_from long, text_to long"


def encode_turns(spark: SparkSession, turns: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Each turn's ids (int32, little endian) and the range of its text, encoded where the row is read."""
    held = spark.sparkContext.broadcast(codec(*(vocabulary or default_ranks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for lo, hi in blocks(cols[3]):
                conv, turn, role, text = (x[lo:hi] for x in cols)
                made = [c.turn_ids(r or "", t or "") for r, t in zip(role, text, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(conv, pa.int64()),
                        pa.array(turn, pa.int64()),
                        pa.array([r or "" for r in role], pa.string()),
                        pa.array([t or "" for t in text], pa.string()),
                        pa.array([m[0].tobytes() for m in made], pa.binary()),
                        pa.array([m[1] for m in made], pa.int64()),
                        pa.array([m[2] for m in made], pa.int64()),
                    ],
                    names=["conv_id", "turn", "role", "text", "ids", "text_from", "text_to"],
                )

    return map_arrow(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")), run, TURNS)


def in_order(encoded: DataFrame) -> DataFrame:
    """A conversation's turns next to each other, in order. Ids move with the sort keys, role and text among them, as these tell turns of one number apart; a turn at a time is in memory."""
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text")


class _Conversation:
    """Digests of one conversation, fed turn by turn in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = self.tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, c: Codec, ids: np.ndarray, lo: int, hi: int) -> None:
        for role, text in c.read(ids):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(c.encoding.decode(ids[lo:hi].tolist()))
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())
        self.chars += len(c.written(ids))
        self.tokens += len(ids)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def assemble(spark: SparkSession, encoded: DataFrame, learned: tuple[str, ...] = LEARNED_ROLES, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Each turn's place in its conversation: token offset by a running sum, and the loss range (empty for roles not learned).

    ``encoded`` is ``in_order(encode_turns(...))``; the result streams through, so a
    conversation of any length needs the memory of one batch.
    """
    held = spark.sparkContext.broadcast(codec(*(vocabulary or default_ranks())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, last, offset = held.value, object(), 0
        for batch in batches:
            conv, turn, blobs, lo, hi = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for k, t, blob, a, z in zip(conv, turn, blobs, lo, hi, strict=True):
                if k != last:
                    last, offset = k, 0
                ids = np.frombuffer(blob, np.int32)
                role = c.read(ids)[0][0]
                out.append((k, t, offset, ids, offset + a, offset + z if role in learned else offset + a))
                offset += len(ids)
            if out:
                conv, turn, at, ids, a, z = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["conv_id", "turn", "token_offset", "token_ids", "loss_from", "loss_to"])

    return map_arrow(encoded, run, "conv_id long, turn long, token_offset long, token_ids array<int>, loss_from long, loss_to long")


def digests(spark: SparkSession, assembled: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per conversation of ``assemble``, read back from its ids and loss ranges."""
    held = spark.sparkContext.broadcast(codec(*(vocabulary or default_ranks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        now: _Conversation | None = None

        def out(rows: list[_Conversation]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*(r.row() for r in rows), strict=True), DIGEST_TYPES, strict=True)], names=DIGEST_NAMES)

        for batch in batches:
            done = []
            conv, offset, lo, hi = (batch.column(i).to_pylist() for i in (0, 2, 4, 5))
            ids = batch.column(3)
            for i, (k, at, a, z) in enumerate(zip(conv, offset, lo, hi, strict=True)):
                if now is None or now.conv_id != k:
                    done += [now] if now else []
                    now = _Conversation(k)
                now.add(c, ids[i].values.to_numpy(zero_copy_only=False), a - at, z - at)
            if done:
                yield out(done)
        if now:
            yield out([now])

    return map_arrow(assembled, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


DIGEST_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(spark, assemble(spark, in_order(encode_turns(spark, turns))))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS text_chars,
    length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) AS role_chars
  FROM turns
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + role_chars + 2 + text_chars + 9)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
