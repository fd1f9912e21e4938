"""Problem 9: the subjects of each document, by anchored non-negative factors.

The matrix of sentences and terms (words, word pairs) is factored into
sentence mixtures and component profiles by alternating multiplicative updates
(Kullback-Leibler). Each subject is one component, anchored by labelled
samples: a sample's sentences may load only on its subjects and on one
background component, all other entries starting near zero. The profiles are then refined in ``rounds``
passes over the whole corpus: each pass folds every sentence in (mixtures given the profiles),
sums what it adds to each profile per term, and blends that with the samples' own sums at
equal weight. A last pass folds in again; a sentence belongs to the
subject with the largest weight if that is at least ``LEAST_WEIGHT``, and a
document has each subject of at least a quarter of its sentences.

The kernel is NumPy over Arrow batches, as iterated updates of small matrices
are no relational operation; sums are combined per batch, before the shuffle.
Labelled samples are used up to ``MAX_SAMPLES``, in the order of a hash (all of a fixed table); corpus terms are those in at least ``TERM_SHARE``
of the documents, which bounds the model whatever the corpus.

Defined cases: a null, empty or blank text has no subject; repeated rows give
their rows again; texts without known terms have none; samples without subjects
train the background; without samples no document has a subject; very long
texts are used whole, in chunks of sentences; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.shared import written

MAX_SAMPLES = 10_000
TERM_SHARE = 1 / 1000
LEAST_WEIGHT = 0.3
QUARTER = 0.25
LEAST_WORDS = 4
CHUNK = 200_000
ROUND_STEPS, LAST_STEPS = 8, 12

_AFTER = r"(?:(?<=[a-zà-ÿ0-9)\]])|(?<=°C)|(?<=[A-Z0-9]{2}))\s+"
_LOST = re.compile(rf"{_AFTER}(?=[A-ZÀ-Þ][a-zà-ÿ’']+[\s:,]|A [a-z])")
_GERMAN = re.compile(r"\d+\)\s+(der|die|das|ein|eine|im|laut)\s", re.IGNORECASE)
_END = re.compile(r"(?<=[.!?])\s+|\n+|\s+(?=\d+\)\s)|(?<=\d --)\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def sentences(text: str, starters: str = "") -> list[str]:
    """The sentences of a text; words broken at line ends are joined.

    Of a numbered sentence that has lost its full stop, the next begins at a capital; in German, where nouns are capitals
    too, only at one of the caller's ``starters`` (words between ``|``), and without them it is not cut.
    """
    text = text.replace("\r\n", "\n").replace("﻿", "").replace("​", "")
    text = re.sub(r"(\w)-\n(?=\w)", r"\1", text)
    text = re.sub(r"\s-\n", " ", text)
    text = re.sub(r"(# [a-z]+)\s+(?=\S)", r"\1\n\n", text)  # a line of code ends with its remark
    text = re.sub(r"(?<![\n.!?])\n(?!\n)(?=[^\W\d_A-ZÀ-ÞŒ])", " ", text)
    found = []
    for part in _END.split(text):
        part = part.strip()
        if re.match(r"\d+\)\s", part):
            german = _GERMAN.match(part) is not None
            if german and not starters:
                found.append(part)
                continue
            lost = re.compile(rf"{_AFTER}(?=(?:{starters})\b)") if german else _LOST
            found += [x for x in (y.strip() for y in lost.split(part, maxsplit=1)) if x]
        elif part:
            found.append(part)
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words:
    """Numbers of the words a worker has met, their hashes, and whether each is a word of more than one sign and no number."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.hashes, self.real = np.zeros(0, np.uint64), np.zeros(0, bool)

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if len(self.numbers) + len(new) > 1_000_000:  # a worker's memory, not its result
            self.__init__()
            new = list(dict.fromkeys(words))
        for w in new:
            self.numbers[w] = len(self.numbers)
        text = ["0" if w[0].isdigit() else w for w in new]
        hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in text]
        self.hashes = np.concatenate([self.hashes, np.array(hashes, np.uint64)])
        self.real = np.concatenate([self.real, np.array([len(w) > 1 and not w[0].isdigit() for w in new], bool)])
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


_MET = _Words()


def terms(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all sentences, one after the other, and how many each has.

    Terms are the distinct words in lower case, numbers as one sign, and pairs of neighbours;
    a scrap of fewer than ``LEAST_WORDS`` words has none. Hashes have 64 bits.
    """
    flat, counts = [], []
    for text in texts:
        for sentence in text:
            words = _WORD.findall(sentence.lower())
            counts.append(len(words))
            flat += words
    counts = np.array(counts, np.int64)
    n = len(counts)
    if not flat:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    at = _MET.of(flat)
    words = _MET.hashes[at]
    real = np.bincount(np.repeat(np.arange(n), counts), _MET.real[at], n) >= LEAST_WORDS
    own = np.repeat(np.arange(n), counts)
    pair = own[1:] == own[:-1]
    pairs = _mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(1))[pair]
    every, where = np.concatenate([words, pairs]), np.concatenate([own, own[1:][pair]])
    every, where = every[real[where]].view(np.int64), where[real[where]]
    order = np.lexsort((every, where))
    every, where = every[order], where[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (where[1:] != where[:-1])
    return every[new], np.bincount(where[new], minlength=n)


def numbered(hashes: np.ndarray, lengths: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the known terms among sorted ``kept`` hashes, and how many each sentence has."""
    if not len(kept) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    at = np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)
    known = kept[at] == hashes
    own = np.repeat(np.arange(len(lengths)), lengths)
    return at[known], np.bincount(own[known], minlength=len(lengths))


def fold_in(flat: np.ndarray, lengths: np.ndarray, profiles: np.ndarray, start: np.ndarray | None = None, steps: int = 10) -> np.ndarray:
    """Mixtures (sentences x components) of sentences given as runs of term numbers."""
    k = profiles.shape[0]
    mix = np.full((len(lengths), k), 1 / k, np.float32) if start is None else start.astype(np.float32)
    full = np.flatnonzero(lengths)
    if not len(full):
        return mix
    loads, own = profiles.T[flat], np.repeat(np.arange(len(full)), lengths[full])
    begin = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
    part = mix[full]
    for _ in range(steps):
        ratio = 1 / (np.einsum("ij,ij->i", loads, part[own]) + 1e-12)
        part = part * np.add.reduceat(loads * ratio[:, None], begin, axis=0) + 1e-12
        part /= part.sum(1, keepdims=True)
    mix[full] = part
    return mix


def profile_sums(flat: np.ndarray, lengths: np.ndarray, mix: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """What the sentences add to each (term, component)."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    loads = profiles.T[flat] * mix[own]
    loads /= loads.sum(1, keepdims=True) + 1e-12
    return np.stack([np.bincount(flat, loads[:, j], profiles.shape[1]) for j in range(profiles.shape[0])])


def normal(profiles: np.ndarray) -> np.ndarray:
    profiles = profiles + 1e-6
    return (profiles / profiles.sum(1, keepdims=True)).astype(np.float32)


class Model:
    """Known terms, component profiles, and the labelled sentences."""

    def __init__(self, samples: list[tuple[str, list[str]]], subjects: list[str], corpus_terms: np.ndarray, steps: int = 25, starters: str = ""):
        cut = [sentences(text, starters) for text, _ in samples]
        hashes, lengths = terms(cut)
        masks = []
        for own, (_, labels) in zip(cut, samples, strict=True):
            allowed = np.full(len(subjects) + 1, 1e-3, np.float32)
            allowed[[*(subjects.index(x) for x in labels if x in subjects), len(subjects)]] = 1
            masks += [allowed] * len(own)
        found, n = np.unique(hashes, return_counts=True)
        self.kept = np.union1d(found[n >= 2], corpus_terms)
        self.flat, self.lengths = numbered(hashes, lengths, self.kept)
        self.masks = np.array(masks, np.float32).reshape(-1, len(subjects) + 1)
        self.masks /= self.masks.sum(1, keepdims=True)
        own = np.repeat(np.arange(len(masks)), self.lengths)
        sums = np.stack([np.bincount(self.flat, self.masks[own, j], len(self.kept)) for j in range(len(subjects) + 1)])
        self.profiles, mix = normal(sums), self.masks
        for _ in range(steps):
            mix = fold_in(self.flat, self.lengths, self.profiles, mix, 1)
            self.profiles = normal(profile_sums(self.flat, self.lengths, mix, self.profiles))

    def blend(self, corpus: np.ndarray) -> None:
        """New profiles from the samples' sums and the corpus's, at equal weight."""
        mix = fold_in(self.flat, self.lengths, self.profiles, self.masks, 10)
        own = profile_sums(self.flat, self.lengths, mix, self.profiles)
        scale = own.sum() / corpus.sum() if corpus.sum() > 0 else 0.0
        self.profiles = normal(own + corpus * scale)


def _chunks(batch: pd.DataFrame, kept: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole sentences of at most about CHUNK terms, as numbers of known terms."""
    if not len(batch):
        return
    hashes, lengths = np.concatenate([np.asarray(x, np.int64) for x in batch["hashes"]]), np.concatenate([np.asarray(x, np.int64) for x in batch["lengths"]])
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + CHUNK, "right")), first + 1)
        yield numbered(hashes[base : ends[last - 1]], lengths[first:last], kept)
        first = last


def document_subjects(documents: DataFrame, samples: DataFrame, subjects: list[str], key: str = "doc_id", rounds: int = 2, starters: str = "") -> DataFrame:
    """``(key, subject)`` for each subject of at least a quarter of a document's sentences."""
    spark = documents.sparkSession
    texts = documents.select(F.col(key).cast("bigint").alias("id"), "text").filter("text IS NOT NULL")

    def hash_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cut = [sentences(t, starters) for t in batch["text"]]
            hashes, lengths = terms(cut)
            after = np.cumsum([len(c) for c in cut])  # sentences up to each document
            ends = np.concatenate(([0], np.cumsum(lengths)))
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "hashes": np.split(hashes, ends[after[:-1]]), "lengths": np.split(lengths.astype(np.int32), after[:-1])})

    matrix = written(texts.mapInPandas(hash_terms, "id bigint, hashes array<bigint>, lengths array<int>"), "sentence-terms")
    labelled = [(r["text"] or "", list(r["subjects"] or [])) for r in samples.select("text", "subjects").orderBy(F.xxhash64("text"), "text").limit(MAX_SAMPLES).collect()]
    common = np.zeros(0, np.int64)
    if labelled:
        each = matrix.select(F.explode(F.array_distinct("hashes")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        # at most (terms of a document on average) / TERM_SHARE
        common = each.filter(F.col("n") >= max(3, matrix.count() * TERM_SHARE)).select("term").toPandas()["term"].to_numpy(np.int64)
    model = Model(labelled, subjects, common, starters=starters)
    kept = spark.sparkContext.broadcast(model.kept)
    for _ in range(rounds if labelled else 0):
        now = spark.sparkContext.broadcast(model.profiles)

        def add_up(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            profiles = now.value
            sums = np.zeros(profiles.shape)
            for batch in batches:
                for flat, lengths in _chunks(batch, kept.value):
                    sums += profile_sums(flat, lengths, fold_in(flat, lengths, profiles, steps=ROUND_STEPS), profiles)
            at = np.flatnonzero(sums.sum(0))
            if len(at):
                yield pd.DataFrame({"term": at.astype(np.int32), "sums": list(sums[:, at].T)})

        rows = matrix.select("hashes", "lengths").mapInPandas(add_up, "term int, sums array<double>")
        columns = [F.sum(F.get("sums", F.lit(j))).alias(f"c{j}") for j in range(len(subjects) + 1)]
        found = rows.groupBy("term").agg(*columns).toPandas()
        corpus = np.zeros(model.profiles.shape)
        corpus[:, found["term"].to_numpy(int)] = found[[f"c{j}" for j in range(len(subjects) + 1)]].to_numpy(float).T
        model.blend(corpus)
    last = spark.sparkContext.broadcast(model.profiles)

    def name_subjects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = last.value
        for batch in batches:
            parts = [(fold_in(flat, lengths, profiles, steps=LAST_STEPS), lengths) for flat, lengths in _chunks(batch, kept.value)]
            if not parts:
                continue
            mix, known = np.concatenate([m for m, _ in parts])[:, :-1], np.concatenate([n for _, n in parts])
            best = np.where((known > 0) & (mix.max(1) >= LEAST_WEIGHT), mix.argmax(1), len(subjects))
            per = batch["lengths"].map(len).to_numpy()
            share = np.zeros((len(batch), len(subjects) + 1))
            np.add.at(share, (np.repeat(np.arange(len(batch)), per), best), 1)
            row, col = np.nonzero((share[:, :-1] > 0) & (share[:, :-1] >= QUARTER * per[:, None]))
            if len(row):
                yield pd.DataFrame({key: batch["id"].to_numpy()[row], "subject": [subjects[c] for c in col]})

    return matrix.mapInPandas(name_subjects, f"{key} bigint, subject string")
