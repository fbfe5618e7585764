"""Operator 6: text quality by compression.

Two zstandard dictionaries of one size are built, from good and from bad labelled texts.
Every text is cut into blocks, each block is compressed with either dictionary, and the
normalised difference of the compressed sizes (over all blocks, and at the worst one)
becomes a probability by a fitted logistic curve.  A third number, by how much the bad
dictionary helps against none, tells texts that repeat themselves: no dictionary does.

Dictionaries and curve are fitted on a bounded sample of labelled rows (``per_label``,
the first by a hash over all of them; half for each purpose); scoring reads every text
whole, in Arrow batches, without a shuffle.

Defined cases: null and empty texts score as a typical good text, there being nothing
against them; equal texts get equal scores; a row with several labels is learnt
with each; without labels of both kinds every score is the share of the kind there is,
or 0.5; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import hash_sample, remainder, saved

#: Bytes compressed at once: short enough for the dictionary to matter everywhere.
BLOCK = 2048
#: Bytes of a typical good text that stand beside every text.
PULL = 200


@dataclass
class QualityModel:
    """The two dictionaries and the curve."""

    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    level: int = 5
    #: what good texts' differences are about; short texts are pulled there
    centre: tuple[float, ...] = (0.0, 0.0, 0.0)

    def ready(self) -> "QualityModel":
        self._compressors = [self._compressor(d) for d in (self.good, self.bad, b"")]
        return self

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        known = None
        if content:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(
            level=self.level, dict_data=known, write_content_size=False, write_dict_id=False
        )

    def differences(self, text: str | None) -> tuple[float, float, float]:
        """(good - bad) / (good + bad) of the sizes in all and at most; (plain - bad) / plain.

        ``PULL`` bytes with the differences of good texts are added to each size, so a
        few words are no evidence against a text.
        """
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data or not self.good or not self.bad:
            return self.centre
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        good, bad, plain = (np.array([len(c.compress(b)) for b in blocks], float) for c in self._compressors)
        total, most, help = self.centre
        return (
            float((good.sum() - bad.sum() + PULL * total) / (good.sum() + bad.sum() + PULL)),
            float(((good - bad + PULL * most) / (good + bad + PULL)).max()),
            float((plain.sum() - bad.sum() + PULL * help) / (plain.sum() + PULL)),
        )

    def score(self, text: str | None) -> float:
        z = self.curve[0] + float(np.dot(self.curve[1:], self.differences(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_curve(values: np.ndarray, good: np.ndarray, share: float, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps; ``share`` is how much the good rows weigh."""
    rows = np.column_stack([np.ones(len(values)), values])
    weight = np.where(good, share / max(good.sum(), 1), (1 - share) / max((~good).sum(), 1))
    beta = np.zeros(rows.shape[1])
    ridge = np.diag([0.0] + [1e-7] * values.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (weight * (good - p)) - ridge @ beta
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge
        step = np.linalg.solve(bend + 1e-10 * np.eye(len(beta)), slope)
        beta = beta + np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def dictionary(texts: list[str], size: int, piece: int = 600) -> bytes:
    """``size`` bytes taken in turns from all texts, so each of them has a say.

    A text gives its pieces in the order of a hash, so they come from all over it however
    many texts there are; texts that fit in ``size`` together are there whole.
    """
    samples = [t.encode("utf-8", "surrogatepass") for t in texts]
    orders = []
    for s in samples:
        seed = zlib.crc32(s)
        starts = range(0, len(s), piece)
        orders.append(sorted(starts, key=lambda i: zlib.crc32(b"%d" % i, seed)))
    longest = max(map(len, orders), default=0)
    turns = (s[o[n] : o[n] + piece] for n in range(longest) for s, o in zip(samples, orders) if n < len(o))
    out = bytearray()
    for part in turns:
        out += part
        if len(out) >= size:
            break
    return bytes(out[:size])


def fit_on(good: list[str], bad: list[str], share: float = 0.5, size: int = 512 << 10) -> QualityModel:
    """Every second text builds the dictionaries, the others fit the curve.

    ``share`` is that of good rows among all labelled ones.
    """
    if not good or not bad:
        only = 50.0 if good else -50.0 if bad else 0.0
        return QualityModel(curve=(only, 0.0, 0.0, 0.0)).ready()
    one, two = dictionary(good[::2], size), dictionary(bad[::2], size)
    same = min(len(one), len(two))
    model = QualityModel(one[:same], two[:same]).ready()
    rest = [(t, True) for t in good[1::2] or good] + [(t, False) for t in bad[1::2] or bad]
    long = [model.differences(t) for t in good[1::2] or good if len(t) >= BLOCK // 2]
    model.centre = tuple(float(x) for x in np.mean(long, axis=0)) if long else model.centre
    values = np.array([model.differences(t) for t, _ in rest])
    model.curve = fit_curve(values, np.array([g for _, g in rest]), share)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> QualityModel:
    """Fit on at most ``per_label`` labelled rows of either label.

    Labels are cut first, by a hash of the id, so only that many texts are looked up.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    chosen = saved(hash_sample(rows, "quality", per_label, "doc_id"))
    # about 3 * per_label ids: the side that is sent to all tasks is that small
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0)
    # an id on many rows is learnt from once, from the least of its texts
    found = found.groupBy("doc_id", "quality", "place").agg(F.min("text").alias("text"))
    texts: dict[int, list[str]] = {0: [], 1: []}
    for row in sorted(found.collect(), key=lambda r: (r["place"], r["doc_id"], r["text"])):
        if len(texts[row["quality"]]) < per_label:
            texts[row["quality"]].append(row["text"])
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit_on(texts[1], texts[0], share)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with columns score and predicted."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.good, model.bad, model.curve, model.level, model.centre)
    )

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = QualityModel(*shared.value).ready()
        for batch in batches:
            yield pd.Series([known.score(t) for t in batch], dtype="float64")

    rows = docs.select(*kept, scored(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(parts: int = 3, which: int = 1):
    """Rows that no model may learn from."""
    return remainder(F.col("doc_id"), parts) == which
