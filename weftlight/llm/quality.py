"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over transformed statistics of a whole text. Class sums and products meet as one small row a task,
so all labelled rows count; covariances shrink to the pooled one and to a round one; a text's score is the difference of
the two log-densities, by Mahalanobis distances from Cholesky factors that are computed once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import columns, crc_fold, discard, written

#: Share of the pooled covariance in a class's, and of a multiple of the identity in the sum (of standardised statistics).
#: Of twelve settings tried on the fold of remainder 1 of sf0.1, fitted on the others but 2, this one had the least log-loss.
POOLED, ROUND = 0.4, 0.1
#: A text is predicted to be of class 1 from this score on.
LEAST_SCORE = 0.7
FEATURES = ("length", "letters", "upper", "digits", "marks", "stops", "spaces", "other", "word_length", "word_spread", "odd_words", "short_words", "distinct_words", "top_word", "repeated_lines", "line_length", "compression")

_KIND = np.zeros(256, np.uint8)  # 0: letters and all bytes of other than ASCII characters
for _i, _chars in enumerate((range(65, 91), range(48, 58), b"#$%&*|<>[]{}()/\\=+^~_@`\"", b".,;:!?'-", b" \t\n\r\x0b\x0c"), 1):
    _KIND[list(_chars)] = _i
_KIND[[c for c in (*range(9), *range(14, 32), 127)]] = 6


def _share(part, whole):
    """A share as log-odds, with half a case added on either side."""
    return np.log(part + 0.5) - np.log(whole - part + 0.5)


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of a whole UTF-8 text, in the order of FEATURES; of an empty text, too.

    Shares are log-odds, lengths logarithms. Nothing but the text goes in.
    """
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7).tolist()
    n = len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    m = len(words)
    plain = sum(c for w, c in counts.items() if w.rstrip(b".,;:!?").isalpha() or w.rstrip(b".,;:!?").translate(None, b"'-").decode("utf-8", "replace").isalpha())
    return [
        np.log1p(n),
        _share(kinds[0] + kinds[1], n),
        _share(kinds[1], kinds[0] + kinds[1]),
        _share(kinds[2], n),
        _share(kinds[3], n),
        _share(kinds[4], n),
        _share(kinds[5], n),
        _share(kinds[6], n),
        np.log1p(sizes.mean()) if m else 0.0,
        np.log1p(sizes.std()) if m else 0.0,
        _share(m - plain, m),
        _share(int((sizes <= 3).sum()), m),
        _share(len(counts), m),
        _share(max(counts.values(), default=0), m),
        _share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(n / max(1, len(lines))),
        np.log((len(zlib.compress(data, 1)) + 1) / (n + 16)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians over standardised statistics; factors are inverted lower Cholesky factors. Without them, a constant."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 per row of statistics."""
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [off - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for m, inv, off in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, rounded: float = ROUND) -> Discriminant:
    """The model from each class's row count, sums (2, d) and sums of products (2, d, d) of statistics.

    If a class has no row, every score is the share of class 1 with one row added to either class.
    """
    prior = float((counts[1] + 1) / (counts.sum() + 2))
    if not counts.min():
        return Discriminant(prior)
    n, d = counts.sum(), sums.shape[1]
    centre = sums.sum(axis=0) / n
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / n - centre**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    means = (sums / counts[:, None] - centre) / scale
    own = [(p / k - np.outer(s / k, s / k)) / np.outer(scale, scale) for p, s, k in zip(products, sums, counts, strict=True)]
    every = sum(k * c for k, c in zip(counts, own, strict=True)) / n
    factors, offsets = [], []
    for c, k in zip(own, counts, strict=True):
        c = (1 - pooled) * c + pooled * every
        c = (1 - rounded) * c + (rounded * np.trace(c) / d + 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(k / n) - np.log(np.diag(lower)).sum())
    return Discriminant(prior, centre, scale, means, np.array(factors), np.array(offsets))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) per row: each text is read once, whole; null counts as empty."""
    rows = columns(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))

    def run(batches):
        for b in batches:
            stats = [statistics(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(stats, pa.list_(pa.float64()))], names=["id", "stats"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def moments(rows: DataFrame, d: int = len(FEATURES)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class the row count, sums and sums of products of all rows (label 0 or 1, stats).

    Each task sums its rows; the 2 (1 + d + d d) numbers of the tasks are summed by place, and only those sums come to the driver.
    """

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, label = _matrix(b.column("stats")) if b.num_rows else np.zeros((0, d)), b.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel())], names=["at", "x"])

    out = np.zeros((2, 1 + d + d * d))
    for r in rows.select("label", "stats").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out.flat[r["at"]] = r["x"]
    return out[:, 0], out[:, 1 : d + 1], out[:, d + 1 :].reshape(2, d, d)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), pooled: float = POOLED, rounded: float = ROUND, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) per row of docs; learnt from all labelled rows outside the held-out fold.

    held_out is (parts, remainder): rows with crc32(id as text) mod parts equal to the remainder are never learnt from; a
    null id folds as the empty string and has no label. An id's label is 1 if any of its rows of labels says 1, 0 if one says 0;
    other values and null say nothing. Null texts are empty and scored like any other. Repeated rows are learnt from each
    and scored alike; further columns are dropped; an empty table gives no row. Without labels of both classes every score is
    the smoothed share of class 1 (0.5 without any). Statistics are computed once, and the result when this is called.
    """
    parts, remainder = held_out
    stats = written(described(docs, id_col, text_col), "stats")
    marks = columns(labels, id_col, label_col).toDF("id", "label").filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    model = discriminant(*moments(stats.filter(crc_fold("id", parts) != remainder).join(marks, "id")), pooled, rounded)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.scores(_matrix(b.column("stats"))))], names=["id", "score"])

    scored = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    out = written(scored.select(F.col("id").alias(id_col), (crc_fold("id", parts) == remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")), "quality")
    discard(stats)
    return out
