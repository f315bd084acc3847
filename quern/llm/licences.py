"""Licence scans by a positional index of rare words.

Every licence template is a list of words. The index holds, for each of these words,
the templates and positions where it stands; its weight is the inverse document
frequency counted over all documents. In a file, the words of highest weight that it
shares with a template are looked up; each place gives a start of the template in the
file. The other words are intersected at their relative positions, rarest first, and
the share of the template's weight that stands in place is its score. A template
counts only if its key phrases stand, word by word, inside the aligned stretch.

A base phrase is a template that is its own key phrase: all its places are found.
Other templates tolerate words put in or left out (``DRIFT``), and are reported at
their best place if its share reaches ``LEAST_SHARE``.

Defined results: a null text is empty; an empty text, or one without words, has no
place and score 0; texts are read whole (a long one in pieces of ``PIECE`` bytes cut
between words, of which two bytes a word are kept); every row has its result, rows
without doc_id and repeated rows too; of equal shares the first place is given; other
columns, whatever their names, are never read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import map_arrow, table


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# Phrases and labels that every place is reported of.
BASE = (
    Template("gpl", "gnu general public license", ("gnu general public license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("cc-by", "cc by", ("cc by",), True),
    Template("mit", "mit license", ("mit license",), True),
)
# The notices by which licences are known, and what must stand in them word by word.
NOTICES = (
    Template("agpl-3.0", "this program is licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products", "specific prior written permission")),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("gpl-2.0", "this program is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
TEMPLATES = BASE + NOTICES

#: Of a template's words that a file holds, those of highest weight that are looked up.
ANCHORS = 3
#: A word may stand this many words before or behind its place in a notice.
DRIFT = 2
#: Share of a notice's weight that must stand in place.
LEAST_SHARE = 0.6
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Starts that are aligned at once.
STARTS = 1 << 16

#: A-Z to a-z; digits, small letters and bytes beyond ASCII stay; all else is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[str]:
    return text.encode().translate(FOLD).decode().split()


class Aligned(NamedTuple):
    """A template as word codes, weights of their positions, key phrases and, by weight, its distinct words."""

    template: Template
    codes: np.ndarray
    weights: np.ndarray
    keys: list[np.ndarray]
    rarest: list[int]


class Index:
    """Templates by their words; a word's weight comes from the documents that hold it."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, held: dict[str, int] | None = None, documents: int = 0):
        names = sorted({w for t in templates for w in (*words(t.text), *(w for k in t.keys for w in words(k)))})
        self.codes = {w.encode(): i + 1 for i, w in enumerate(names)}
        self.names = ["", *names]
        self.weight = np.array([0.0, *(math.log(1 + documents / (1 + (held or {}).get(w, 0))) for w in names)])
        if not documents:
            self.weight[1:] = 1.0
        self.aligned, self.needs = [], np.zeros((len(templates), len(self.names)), bool)
        for row, t in enumerate(templates):
            codes = self.encode(t.text.encode())
            keys = [self.encode(k.encode()) for k in t.keys]
            for k in keys:
                self.needs[row, k] = True
            w = self.weight[codes]
            self.aligned.append(Aligned(t, codes, w / w.sum(), keys, sorted(set(codes.tolist()), key=self._rarity)))

    def _rarity(self, code: int) -> tuple[float, int]:
        return -self.weight[code], code

    def encode(self, text: bytes) -> np.ndarray:
        """The code of each word of a text, 0 for words of no template."""
        text, get, out, lo = text.translate(FOLD), self.codes.get, [], 0
        while lo < len(text):
            hi = text.find(b" ", lo + PIECE) if lo + PIECE < len(text) else -1
            part = text[lo : hi if hi >= 0 else len(text)].split()
            out.append(np.fromiter(map(get, part, repeat(0)), np.int16, len(part)))
            lo = hi if hi >= 0 else len(text)
        return np.concatenate(out) if out else np.empty(0, np.int16)

    def places(self, file: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """All starts of a phrase: places of its rarest word, kept where the next rarest stands at its relative position, and so on."""
        order = sorted(range(len(phrase)), key=lambda k: (*self._rarity(int(phrase[k])), k))
        at = np.flatnonzero(file == phrase[order[0]]) - order[0]
        at = at[(at >= 0) & (at + len(phrase) <= len(file))]
        for k in order[1:]:
            at = at[file[at + k] == phrase[k]]
        return at

    def best(self, file: np.ndarray, t: Aligned) -> tuple[int, float] | None:
        """(start, share) of the best aligned place of a notice whose key phrases stand in it."""
        keys = [self.places(file, k) for k in t.keys]
        if not all(len(k) for k in keys):
            return None
        present = np.bincount(file, minlength=len(self.names)) > 0
        n, anchors = len(t.codes), [c for c in t.rarest if present[c]][:ANCHORS]
        starts = np.unique(np.concatenate([np.flatnonzero(file == c) - k for c in anchors for k in np.flatnonzero(t.codes == c)]))
        around = np.concatenate([np.zeros(n + DRIFT, np.int16), file, np.zeros(n + DRIFT, np.int16)])
        top = None
        for lo in range(0, len(starts), STARTS):
            s = starts[lo : lo + STARTS]
            for k, phrase in zip(keys, t.keys, strict=True):
                first = np.searchsorted(k, s - DRIFT)
                s = s[np.where(first < len(k), k[np.minimum(first, len(k) - 1)] + len(phrase), np.iinfo(np.int64).max) <= s + n + DRIFT]
            if not len(s):
                continue
            share = np.zeros(len(s))
            for k, (c, w) in enumerate(zip(t.codes, t.weights, strict=True)):
                share += w * np.any([around[s + n + DRIFT + k + d] == c for d in range(-DRIFT, DRIFT + 1)], 0)
            i = int(share.argmax())
            if top is None or share[i] > top[1]:
                top = int(s[i]), float(share[i])
        return top

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        """Number of words, and the places: label, start, words, share, base."""
        file = self.encode(text)
        present = np.bincount(file, minlength=len(self.names)) > 0
        found = []
        for row in np.flatnonzero(~(self.needs & ~present).any(1)):
            t = self.aligned[row]
            if t.template.base:
                found += [{"label": t.template.label, "start": int(s), "words": len(t.codes), "share": 1.0, "base": True} for s in self.places(file, t.codes)]
            elif (top := self.best(file, t)) and top[1] >= LEAST_SHARE:
                found.append({"label": t.template.label, "start": max(0, top[0]), "words": len(t.codes), "share": min(1.0, top[1]), "base": False})
        return len(file), found


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def index_of(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """The index with weights counted over all documents: each task adds up its own, one row for each word of the templates reaches the driver."""
    spark = docs.sparkSession
    plain = spark.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = plain.value, np.zeros(len(plain.value.names), np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                held += np.bincount(index.encode(text), minlength=len(held)) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(held)), pa.int32()), pa.array(held[1:])], names=["code", "held"])

    names = Index(templates).names
    counted = map_arrow(docs.select("text"), run, "code int, held long").groupBy("code").agg(F.sum("held").alias("held")).collect()
    return Index(templates, {names[r["code"]]: r["held"] for r in counted}, docs.count())


FOUND = ArrayType(StructType().add("label", "string").add("start", "long").add("words", "long").add("share", "double").add("base", "boolean"))


def scan(docs: DataFrame, index: Index, key: str = "doc_id") -> DataFrame:
    """(key, n_words, found) of every row; found lists the places of licences."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = StructType([StructField("key", docs.schema[key].dataType)]).add("n_words", "long").add("found", FOUND)
    kind = to_arrow_type(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [held.value.scan(t) for t in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([f for _, f in rows], kind)], names=["key", "n_words", "found"])

    out = map_arrow(docs.select(F.col(f"`{key}`").alias("key"), "text"), run, schema)
    return out.withColumnRenamed("key", key)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    base = F.filter("found", lambda f: f["base"])

    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")

    starts = F.transform(base, lambda f: f["start"])
    return scan(docs, index_of(docs)).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )
