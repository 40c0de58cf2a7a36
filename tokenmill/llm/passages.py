"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its bytes and its words, gated
attention weighs the passages, and the weighted sum is scored. Labels are per document; the
attention weights are learned from them. Fitting is numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.batches import out_batch, out_schema, take, text_groups
from tokenmill.llm.byte_cnn import sample, spans, text_bytes
from tokenmill.llm.word_hashes import words

#: Bytes of a passage, size of its encoding and of the attention layer.
PASSAGE, ENCODING, ATTENTION = 512, 24, 12
FEATURES = 256 + 5
#: Texts whose features are computed at once for fitting.
LOT = 100


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and each text's number of passages.

    Roots of the byte frequencies, share of words equal to the word before, share of words that
    occurred in the passage before, mean word length, fill of the passage, and a constant.
    """
    doc, start, end = spans(offsets, PASSAGE)
    end = np.minimum(start + PASSAGE, end)
    size = end - start
    passage = np.repeat(np.arange(len(doc)), size)
    x = np.zeros((len(doc), FEATURES), np.float32)
    counts = np.bincount(passage * 256 + data, minlength=len(doc) * 256).reshape(len(doc), 256)
    x[:, :256] = np.sqrt(counts / np.maximum(1, size)[:, None])
    hashes, at, _ = words(data, offsets)
    if len(hashes):
        home = passage[at]
        n = np.maximum(1, np.bincount(home, minlength=len(doc)))
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (home[1:] == home[:-1])
        x[:, 256] = np.bincount(home, again, len(doc)) / n
        order = np.lexsort((hashes, home))
        repeated = (np.diff(hashes[order]) == 0) & (np.diff(home[order]) == 0)
        x[:, 257] = np.bincount(home[order][1:], repeated, len(doc)) / n
        x[:, 258] = np.log1p(size / n) / 4
    x[:, 259] = size / PASSAGE
    x[:, 260] = 1
    return x, np.bincount(doc, minlength=len(offsets) - 1)


@dataclass
class Bags:
    """Encoder, gated attention (tanh and sigmoid part, their product's weights) and score layer."""

    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.encode, self.tanh, self.gate, self.attend, self.out]

    def forward(self, x: np.ndarray, n: np.ndarray):
        """Scores of the bags, and what the backward pass needs."""
        first = np.cumsum(n) - n
        code = np.tanh(x @ self.encode)
        t, g = np.tanh(code @ self.tanh), 1 / (1 + np.exp(-(code @ self.gate)))
        a = (t * g) @ self.attend
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        bag = np.add.reduceat(code * a[:, None], first, axis=0)
        z = bag @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-z)), (code, t, g, a, bag, first)


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Bags:
    """Fit on labelled texts: Adam on mini-batches of whole bags."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    net = Bags(init(FEATURES, ENCODING) * 2, init(ENCODING, ATTENTION), init(ENCODING, ATTENTION), init(ATTENTION), np.append(init(ENCODING), 0.0))
    # a few texts at a time, since the counts behind the features are larger than the features
    lots = [features(*text_bytes(pa.array(texts[i : i + LOT], pa.string()))) for i in range(0, len(texts), LOT)]
    x, n = (np.concatenate(parts) for parts in zip(*lots))
    del lots
    first = np.cumsum(n) - n
    y = np.asarray(labels, float)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(n)), max(1, len(n) // 64)):
            rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in part])
            own, m = x[rows], n[part]
            p, (code, t, g, a, bag, at) = net.forward(own, m)
            dz = (p - y[part]) / len(part)
            d_bag = np.repeat(dz[:, None] * net.out[:-1], m, axis=0)
            d_a = (d_bag * code).sum(1)
            d_a = a * (d_a - np.repeat(np.add.reduceat(a * d_a, at), m))
            d_t, d_g = d_a[:, None] * net.attend * g * (1 - t * t), d_a[:, None] * net.attend * t * g * (1 - g)
            d_code = (d_bag * a[:, None] + d_t @ net.tanh.T + d_g @ net.gate.T) * (1 - code * code)
            grads = [own.T @ d_code, code.T @ d_t, code.T @ d_g, (t * g).T @ d_a, np.append(bag.T @ dz, dz.sum())]
            step += 1
            for w, d, (m1, m2) in zip(net.parts(), grads, moments):
                d = d + decay * w
                m1 += 0.1 * (d - m1)
                m2 += 0.01 * (d * d - m2)
                w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return net


def score(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
    text_col: str = "text", per_label: int = 2000, prior: float = 0.5, carry: bool = False,
) -> DataFrame:
    """Quality of every whole text: doc_id, score (0 to 1, higher: label 1 likelier), attention
    (byte offset of the passage that weighs most), with ``carry`` also row (all given columns).

    Fitted on at most ``per_label`` documents of either label where ``learn`` holds, joined to
    ``labels`` by id (a repeated label counts once, the larger one). Scores read the text only.
    The sample has both labels in equal parts; ``prior`` is the share of label 1 that scores
    assume. A null or empty text is scored as an empty passage. With one label, or none, to
    learn from, every score is that label, or 0.5. Repeated rows and null ids are kept. An empty
    table gives no rows. Other columns are not read.
    """
    marks = labels.where(F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(
        F.max(F.col(f"`{label_col}`")).cast("int").alias("__label")
    )
    ids = docs.where(learn).select(F.col(f"`{id_col}`").alias("__id")).distinct()
    texts, given = sample(docs, marks.join(ids, "__id").select("__id", "__label"), per_label, id_col, text_col)
    net = train(texts, given) if len(set(given)) == 2 else None
    rest = float(given[0]) if given else 0.5
    shift = 0.0
    if net:
        share = np.clip(np.mean(given), 1e-3, 1 - 1e-3)
        shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = take(docs, id_col, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in text_groups(batches):
            p, top = np.full(batch.num_rows, rest), np.zeros(batch.num_rows, np.int64)
            if net:
                x, n = features(*text_bytes(batch.column("text")))
                p, (_, _, _, a, _, first) = net.forward(x, n)
                p = np.clip(p, 1e-9, 1 - 1e-9)
                p = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + shift)))
                top = np.array([int(a[f : f + k].argmax()) for f, k in zip(first, n)], np.int64) * PASSAGE
            yield out_batch(batch, score=pa.array(p, pa.float64()), attention=pa.array(top, pa.int64()))

    return docs.mapInArrow(run, out_schema(docs, "score double, attention long"))
