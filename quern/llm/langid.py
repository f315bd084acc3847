"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters, lower-cased. Its features are hashed character
bigrams and trigrams with word borders, prefix and suffix of three letters, and
membership in a lexicon of words frequent in the training text. Weights of
features and of transitions between languages are learned by stochastic gradient
on the CRF likelihood, over sequences of which many switch language in the
middle. Forward-backward gives each word's marginals; a document's language has
the largest mean marginal, and that mean is the score.

The model is fitted on a bounded sample: ``TRAIN_DOCS`` documents in expectation,
spread over the languages (of more languages than that, the most frequent), and of a
longer document a stretch of ``TRAIN_CHARS`` characters from a place its digest names.
Prediction covers every word of every text, without a shuffle.

Defined results: null text and text without letters give ``und`` with score 0, as
does every text where no labelled document is there to learn from. Of languages with
equal means the first by name is given. Rows are independent, with or without doc_id;
repeated rows repeat their result; texts are labelled together up to a bounded number of
characters, but a longer one is one chain and one task's work, of about 500 bytes a word;
other columns, whatever their names, are kept by ``accept``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import blocks, free_name, give_back, map_arrow, table

TRAIN_DOCS, TRAIN_CHARS = 1600, 4_000
SLOTS = 1 << 16
LEXICON_SIZE, LEXICON_LEAST = 20_000, 3
SEQUENCES, STEPS, BATCH, EPOCHS = 6000, 32, 64, 2
RATE, DECAY = 0.15, 1e-6
UNDETERMINED = "und"
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


@dataclass
class Words:
    """The words of some texts: their document, hash and feature slots."""

    doc: np.ndarray
    hash: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    affixes: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= PRIMES[1]
    x ^= x >> np.uint64(32)
    return x


def words_of(texts: list[str | None]) -> Words:
    lower = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    code = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[code]
    edge = np.diff(is_letter.astype(np.int8))
    start, end = (edge == 1).nonzero()[0] + 1, (edge == -1).nonzero()[0] + 1
    if not len(start):
        none = np.empty(0, np.int64)
        return Words(none, none.astype(np.uint64), none.reshape(0, 2), none, none.reshape(0, 2))
    doc_start = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    doc = np.searchsorted(doc_start, start, "right") - 1
    c = np.where(is_letter, code, 0).astype(np.uint64)
    at = is_letter.nonzero()[0]
    two = c[at - 1] * PRIMES[0] + c[at] * PRIMES[2]
    three = two + c[at + 1] * PRIMES[3] + np.uint64(7)
    mask = np.uint64(SLOTS - 1)
    grams = np.stack([_mix(two) & mask, _mix(three) & mask], 1).astype(np.int64)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), PRIMES[0], np.uint64))
    h = np.add.reduceat(c[at] * power[place], first)
    pre = c[start] * PRIMES[0] + c[np.minimum(start + 1, end - 1)] * PRIMES[2] + c[np.minimum(start + 2, end - 1)] * PRIMES[3] + np.uint64(11)
    suf = c[end - 1] * PRIMES[0] + c[np.maximum(end - 2, start)] * PRIMES[2] + c[np.maximum(end - 3, start)] * PRIMES[3] + np.uint64(13)
    affixes = np.stack([_mix(pre) & mask, _mix(suf) & mask], 1).astype(np.int64)
    return Words(doc, _mix(h), grams, first, affixes)


def narrow_words(texts: list[str]) -> Words:
    """``words_of`` block by block, in small integers: for training, where all words are held at once."""
    slot, parts, letters = np.min_scalar_type(SLOTS - 1), [], 0
    for lo, hi in blocks(texts):
        w = words_of(texts[lo:hi])
        parts.append(((w.doc + lo).astype(np.int32), w.hash, w.grams.astype(slot), w.first + letters, w.affixes.astype(slot)))
        letters += len(w.grams)
    return Words(*map(np.concatenate, zip(*parts, strict=True))) if parts else words_of([])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Log potentials of each word for each language."""
        per_letter = self.weights[w.grams[:, 0]]
        per_letter += self.weights[w.grams[:, 1]]
        e = np.add.reduceat(per_letter, w.first, axis=0)
        e += self.weights[w.affixes[:, 0]]
        e += self.weights[w.affixes[:, 1]]
        if len(self.lexicon):
            k = np.minimum(np.searchsorted(self.lexicon, w.hash), len(self.lexicon) - 1)
            e += np.where((self.lexicon[k] == w.hash)[:, None], self.lexicon_weights[k], np.float32(0))
        return e

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean marginals of each text's words, and the number of words."""
        n, k = len(texts), len(self.labels)
        w = words_of(texts)
        count = np.bincount(w.doc, minlength=n)
        if not k or not len(w.doc):
            return np.zeros((n, k), np.float32), count
        e = self.emissions(w)
        e = np.exp(e - e.max(1, keepdims=True))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        step = np.arange(len(w.doc)) - (np.cumsum(count) - count)[w.doc]
        longest = int(count.max())
        alive = n - np.searchsorted(count[order][::-1], np.arange(longest), "right")
        at = np.concatenate([[0], np.cumsum(alive)])
        slot = at[step] + rank[w.doc]
        packed = np.empty_like(e)
        packed[slot] = e
        a = np.exp(self.transitions).astype(np.float32)
        cuts, ends = at[:-1].tolist(), at[1:].tolist()
        forward = np.empty_like(packed)
        now = None
        for lo, hi in zip(cuts, ends, strict=True):
            x = packed[lo:hi] if now is None else (now[: hi - lo] @ a) * packed[lo:hi]
            now = x / x.sum(1, keepdims=True)
            forward[lo:hi] = now
        back = np.ones((0, k), np.float32)
        for lo, hi in zip(cuts[::-1], ends[::-1], strict=True):
            beta = np.ones((hi - lo, k), np.float32)
            m = len(back)
            beta[:m] = back
            x = forward[lo:hi] * beta
            forward[lo:hi] = x / x.sum(1, keepdims=True)
            back = (beta * packed[lo:hi]) @ a.T
            back /= back.sum(1, keepdims=True)
        marginal = forward[slot]
        total = np.stack([np.bincount(w.doc, marginal[:, j], n) for j in range(k)], 1)
        return total / np.maximum(1, count)[:, None], count


def fit(texts: list[str], languages: list[str], seed: int = 1) -> Model:
    """Learn a model from texts and their languages."""
    labels = sorted(set(languages))
    k = len(labels)
    empty = Model(labels, np.zeros((SLOTS, k), np.float32), np.zeros((k, k), np.float32), np.empty(0, np.uint64), np.zeros((0, k), np.float32))
    w = narrow_words(texts)
    if not len(w.doc):
        return Model([], empty.weights[:, :0], empty.transitions[:0, :0], empty.lexicon, empty.lexicon_weights[:, :0])
    rng = np.random.default_rng(seed)
    label = np.array([labels.index(x) for x in languages])[w.doc]
    seen, times = np.unique(w.hash, return_counts=True)
    keep = np.argsort(-times, kind="stable")[:LEXICON_SIZE]
    lexicon = np.sort(seen[keep][times[keep] >= LEXICON_LEAST])
    n_lex = len(lexicon)
    size = SLOTS + n_lex + 1
    spot = np.minimum(np.searchsorted(lexicon, w.hash), max(0, n_lex - 1))
    lex_slot = np.where(lexicon[spot] == w.hash, SLOTS + spot, size - 1) if n_lex else np.full(len(w.hash), size - 1)
    length = np.diff(np.append(w.first, len(w.grams)))
    theta, squares = np.zeros((size, k)), np.full((size, k), 1e-3)
    trans, trans_squares = np.zeros((k, k)), np.full((k, k), 1e-3)
    by_label = [np.nonzero(label == j)[0] for j in range(k)]

    def sequences(m: int) -> np.ndarray:
        """Word indices of m sequences: one to three runs, each from a random place of a random language."""
        out = np.empty((m, STEPS), np.int64)
        for row in out:
            cuts = [0, *sorted(rng.integers(1, STEPS, rng.integers(0, 3)).tolist()), STEPS]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pool = by_label[rng.integers(k)]
                s = rng.integers(len(pool))
                row[a:b] = pool[(s + np.arange(b - a)) % len(pool)]
        return out

    for _ in range(EPOCHS * SEQUENCES // BATCH):
        seq = sequences(BATCH)
        flat = seq.reshape(-1)
        n = length[flat]
        owner = np.repeat(np.arange(len(flat)), n)
        rows = np.repeat(w.first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        feats = np.concatenate([w.grams[rows, 0], w.grams[rows, 1], w.affixes[flat, 0], w.affixes[flat, 1], lex_slot[flat]])
        whose = np.concatenate([owner, owner, *[np.arange(len(flat))] * 3])
        e = np.stack([np.bincount(whose, theta[feats, j], len(flat)) for j in range(k)], 1)
        e = np.exp(e - e.max(1, keepdims=True)).reshape(BATCH, STEPS, k)
        y = label[seq]
        a = np.exp(trans)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(STEPS):
            x = e[:, t] if t == 0 else (alpha[:, t - 1] @ a) * e[:, t]
            alpha[:, t] = x / x.sum(1, keepdims=True)
        for t in range(STEPS - 2, -1, -1):
            x = (beta[:, t + 1] * e[:, t + 1]) @ a.T
            beta[:, t] = x / x.sum(1, keepdims=True)
        node = alpha * beta
        node /= node.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        true = np.eye(k)[y]
        grad = (true - node).reshape(-1, k)[whose]
        g = np.stack([np.bincount(feats, grad[:, j], size) for j in range(k)], 1)
        g[-1] = 0
        squares += g * g
        theta += RATE * g / np.sqrt(squares) - DECAY * theta
        gt = np.einsum("btj,btk->jk", true[:, :-1], true[:, 1:]) - pair.sum((0, 1))
        trans_squares += gt * gt
        trans += RATE * gt / np.sqrt(trans_squares)
    return Model(labels, theta[:SLOTS].astype(np.float32), trans.astype(np.float32), lexicon, theta[SLOTS:-1].astype(np.float32))


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit_on(docs: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """A model from about ``most`` labelled documents, spread evenly over the languages; held-out documents are never read."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return fit([], [])
    each = max(1, most // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, each / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 40)) / float(1 << 40)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    rows = usable.where(drawn < share).select("doc_id", F.substr("text", start, F.lit(chars)).alias("text"), "lang").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    texts, langs = [r["text"] for r in rows], [r["lang"] for r in rows]
    del rows
    model = fit(texts, langs)
    give_back()
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row with lang_pred and score, named with underscores behind where ``carry`` has these names."""
    held = spark.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("doc"), "text")

    def run(batches):
        m = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            order = np.argsort([len(t or "") for t in texts], kind="stable")
            texts = [texts[i] for i in order]
            shares, counts = [], []
            for lo, hi in blocks(texts):
                s, c = m.shares(texts[lo:hi])
                shares.append(s)
                counts.append(c)
            if not texts:
                continue
            share, count = np.concatenate(shares), np.concatenate(counts)
            good = (count > 0) & bool(m.labels)
            names = np.array([*m.labels, UNDETERMINED], object)
            best = np.where(good, share.argmax(1) if m.labels else 0, len(m.labels))
            score = np.where(good, np.clip(share.max(1), 0, 1) if m.labels else 0.0, 0.0)
            moved = batch.take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [moved.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score.astype(np.float64))],
                names=["doc", "lang_pred", "score"],
            )

    found = map_arrow(packed, run, StructType([packed.schema["doc"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return found.select(*[F.col("doc")[c].alias(c) for c in carry], *[F.col(c).alias(free_name(c, carry)) for c in ("lang_pred", "score")])


#: A document whose words agree on no language to this share is rejected, as is one without words.
LEAST_SCORE = 0.4


def accept(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with a language; a missing lang is filled with the predicted one."""
    names = docs.columns
    lang, score = (F.col(f"`{free_name(c, names)}`") for c in ("lang_pred", "score"))
    found = predict(spark, docs, fit_on(docs), tuple(names)).where((lang != UNDETERMINED) & (score >= LEAST_SCORE))
    return found.select(*[(F.coalesce("lang", lang) if c == "lang" else F.col(f"`{c}`")).alias(c) for c in names])


def op2_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return predict(spark, docs, fit_on(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
