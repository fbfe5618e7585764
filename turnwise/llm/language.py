"""Operator 10: language by hierarchical discrimination.

Languages that look alike form a family.  Linear support vector machines on hashed
character n-grams first tell the families apart, each against the rest; inside the
chosen family one machine for every pair of languages votes with its margin.

The model is fitted on a bounded sample of labelled rows (``per_language``, chosen by a
hash over all of them) and is a few weight vectors of fixed length; scoring reads every
text whole, in Arrow batches, without a shuffle.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; equal
texts get equal results; without any labelled row everything is ``und``; extra columns
are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import hash_sample, remainder

#: Length of the feature vectors, as a power of two.
BITS = 13
WIDTH = 1 << BITS
#: Characters taken together; a text of any length is a sum of blocks.
BLOCK = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Unit vector of the damped counts of hashed 1- to 4-character pieces of the whole text.

    Letters are lower-cased, everything else is a word border.
    """
    counts = np.zeros(WIDTH)
    for start in range(0, len(text), BLOCK):
        part = text[start : start + BLOCK].lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, "<u4").astype(np.uint64)
        # word borders: ASCII that is no letter; other scripts' characters all count
        codes[(codes < 97) | ((codes > 122) & (codes < 170))] = 32
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]])
        mixed = np.zeros(len(codes), np.uint64)
        for size in range(1, 5):
            if len(codes) < size:
                break
            tail = codes[size - 1 :]
            mixed = (mixed[: len(tail)] if size == 1 else mixed[:-1]) * np.uint64(0x9E3779B97F4A7C15) + tail
            hashed = (mixed + np.uint64(size)) * np.uint64(0xFF51AFD7ED558CCD)
            counts += np.bincount((hashed >> np.uint64(64 - BITS)).astype(np.int64), minlength=WIDTH)
    counts = np.sqrt(counts)
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype(np.float32)


def fit_machine(rows: np.ndarray, positive: np.ndarray, rounds: int = 60, c: float = 10.0) -> np.ndarray:
    """Weights of a linear support vector machine, by dual coordinate descent.

    Both sides weigh the same in all, so a rare language is not outvoted.
    """
    sign = np.where(positive, 1.0, -1.0)
    limit = c * len(rows) / 2 / np.where(positive, positive.sum(), (~positive).sum())
    square = np.einsum("ij,ij->i", rows, rows) + 1.0
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(rows.shape[1], np.float32), 0.0
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (rows[i] @ weights + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if step := new - alpha[i]:
                weights += np.float32(step * sign[i]) * rows[i]
                bias += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(weights, bias)


@dataclass
class LanguageModel:
    """Families of languages, a machine per family and one per pair inside a family."""

    families: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not _LETTER.search(text):
            return "und", 0.0
        x = np.append(features(text), np.float32(1.0))
        score, family = 1.0, self.families[0]
        if len(self.families) > 1:
            share = _shares(self.family_weights @ x)
            best = int(share.argmax())
            family, score = self.families[best], float(share[best])
        if len(family) == 1:
            return family[0], score
        votes = np.zeros(len(family))
        for a in range(len(family)):
            for b in range(a + 1, len(family)):
                yes = 1 / (1 + np.exp(-4 * float(self.pair_weights[family[a], family[b]] @ x)))
                votes[a] += yes
                votes[b] += 1 - yes
        votes /= votes.sum()
        best = int(votes.argmax())
        certain = votes[best] * len(family) / 2 if len(family) > 2 else votes[best]
        return family[best], score * float(min(1.0, certain))


def _shares(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(4 * (margins - margins.max()))
    return raised / raised.sum()


def families_of(centres: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages joined with their most similar one when that one is closer than usual.

    Similarity is the cosine of the mean vectors; a link needs to be mutual, or at
    least as strong as the mean of all mutual ones.
    """
    names = sorted(centres)
    if len(names) < 3:
        return [[n] for n in names] if len(names) < 2 else [names]
    units = np.array([centres[n] / max(np.linalg.norm(centres[n]), 1e-12) for n in names])
    alike = units @ units.T
    np.fill_diagonal(alike, -1)
    nearest = alike.argmax(axis=1)
    mutual = [i for i in range(len(names)) if nearest[nearest[i]] == i]
    enough = float(np.mean([alike[i, nearest[i]] for i in mutual]))
    home = list(range(len(names)))
    for i in range(len(names)):
        if nearest[nearest[i]] == i or alike[i, nearest[i]] >= enough:
            old, new = home[i], home[int(nearest[i])]
            home = [new if h == old else h for h in home]
    return [[n for n, h in zip(names, home) if h == f] for f in sorted(set(home))]


def fit_languages(docs: DataFrame, per_language: int = 400) -> LanguageModel:
    """Fit on at most ``per_language`` rows a language, the first by a hash of the row."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sample: dict[str, list[str]] = {}
    # a row that is there many times is learnt from once
    found = hash_sample(rows, "lang", per_language, "doc_id", "text").distinct().collect()
    for row in sorted(found, key=lambda r: (r["place"], r["text"])):
        texts = sample.setdefault(row["lang"], [])
        if len(texts) < per_language:
            texts.append(row["text"])
    return fit_on(sample)


def fit_on(sample: dict[str, list[str]]) -> LanguageModel:
    if not sample:
        return LanguageModel()
    # one table of rows for all machines, some 13 MB a language; languages are stretches of it
    names = sorted(sample)
    rows = np.empty((sum(len(sample[n]) for n in names), WIDTH), np.float32)
    part, start = {}, 0
    for name in names:
        part[name] = np.arange(start, start + len(sample[name]))
        for text in sample[name]:
            rows[start] = features(text)
            start += 1
    model = LanguageModel(families_of({n: rows[part[n]].mean(axis=0) for n in names}))
    if len(model.families) > 1:
        home = np.empty(len(rows), np.int64)
        for k, family in enumerate(model.families):
            for name in family:
                home[part[name]] = k
        model.family_weights = np.array([fit_machine(rows, home == k) for k in range(len(model.families))])
    for family in model.families:
        for a in range(len(family)):
            for b in range(a + 1, len(family)):
                both = rows[np.concatenate([part[family[a]], part[family[b]]])]
                side = np.arange(len(both)) < len(part[family[a]])
                model.pair_weights[family[a], family[b]] = fit_machine(both, side)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with columns lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            yield pd.DataFrame([known.predict(t) for t in batch], columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*kept).alias("row"), predicted(F.col("text")).alias("found"))
    return rows.select("row.*", "found.*")


def held_out(parts: int = 4, which: int = 2):
    """Rows that no model may learn from."""
    return remainder(F.col("doc_id"), parts) == which
