"""Language identification by a convolutional network over bytes.

Filters of several widths run over the UTF-8 bytes of fixed-length windows, each is pooled to
its largest response, and a softmax over the pooled responses gives the languages. The network
is trained in numpy on a bounded sample of labelled texts and applied to every window of every
text; a text's probabilities are the normalized geometric mean of its windows'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.batches import out_batch, out_schema, take, text_groups

#: Bytes of a window, widths of the filters (up to 4) and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
UNDETERMINED = "und"
#: Windows that are turned over at once; their responses fit a core's cache.
LOT = 64


@dataclass
class ByteNet:
    """Taps (4, 256, filters) of all filters, zero where a filter is narrower, and the softmax layer."""

    langs: list[str]
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The taps of two neighbouring bytes summed up, for every pair of bytes."""
        both = [self.taps[i][:, None, :] + self.taps[i + 1][None, :, :] for i in (0, 2)]
        return tuple(np.ascontiguousarray(b.reshape(65536, -1)) for b in both)

    def log_probs(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of WINDOW bytes and the three that follow, zero beyond the end of the text."""
    at = starts[:, None] + np.arange(WINDOW + 3)
    return np.where(at < ends[:, None], data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)


def convolve(rows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Filter responses (windows, WINDOW, filters)."""
    pair = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
    out = np.take(pairs[0], pair[:, :WINDOW], axis=0)
    out += np.take(pairs[1], pair[:, 2 : WINDOW + 2], axis=0)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every window; an empty text has one window."""
    n = np.maximum(1, -(-np.diff(offsets) // size))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    return doc, offsets[:-1][doc] + (np.arange(len(doc)) - first) * size, offsets[1:][doc]


def train(texts: list[str], langs: list[str], per_text: int = 8, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit the network on labelled texts: up to ``per_text`` windows of each, Adam on mini-batches."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    width = np.repeat(WIDTHS, FILTERS)
    f = len(width)
    net = ByteNet(names, rng.normal(0, 0.3, (4, 256, f)), np.zeros(f), rng.normal(0, 0.3, (f, len(names))), np.zeros(len(names)))
    for j in range(4):
        net.taps[j][:, width <= j] = 0
    if len(names) < 2:
        return net
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    doc, start, end = spans(offsets, WINDOW)
    order = rng.permutation(len(doc))
    seen = np.zeros(len(texts), int)
    chosen = []
    for i in order:
        if seen[doc[i]] < per_text:
            seen[doc[i]] += 1
            chosen.append(i)
    chosen = np.array(chosen)
    label = np.array([names.index(x) for x in langs])[doc[chosen]]
    rows = windows(data, start[chosen], end[chosen])
    share = 1 / np.maximum(1, np.bincount(label, minlength=len(names)))
    weight = share[label] / share[label].mean()
    params = [net.taps, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            own = rows[part]
            taps = net.taps.astype(np.float32)
            net_now = ByteNet(names, taps, net.bias, net.out, net.out_bias)
            responses = sum(np.take(taps[j], own[:, j : j + WINDOW], axis=0) for j in range(4))
            place = responses.argmax(axis=1)
            pooled = np.take_along_axis(responses, place[:, None, :], axis=1)[:, 0, :]
            hidden = np.maximum(pooled + net.bias, 0)
            delta = (np.exp(net_now.log_probs(pooled)) - np.eye(len(names))[label[part]]) * weight[part, None] / len(part)
            back = (delta @ net.out.T) * (hidden > 0)
            grad = np.zeros_like(net.taps)
            column = np.broadcast_to(np.arange(f), place.shape)
            for j in range(4):
                used = width > j
                byte = np.take_along_axis(own, place + j, axis=1)
                np.add.at(grad[j], (byte[:, used], column[:, used]), back[:, used])
            step += 1
            for p, g, (m, v) in zip(params, [grad, back.sum(0), hidden.T @ delta, delta.sum(0)], moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def sample(docs: DataFrame, marks: DataFrame, per_label: int, id_col: str, text_col: str) -> tuple[list[str], list]:
    """Texts and labels for fitting, at most ``per_label`` texts of each label.

    ``marks`` has the learnable ids and labels. Of each label the ids with the smallest hashes are
    taken, so only ids and labels are shuffled and only the chosen texts are read.
    """
    marks = marks.toDF("id", "label").where("id is not null and label is not null")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = marks.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).collect()
    label = {r["id"]: r["label"] for r in chosen}
    rows = docs.where(F.col(f"`{id_col}`").isin(list(label))).select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).limit(len(chosen)).collect()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    return [r["text"] for r in rows], [label[r["id"]] for r in rows]


def identify(
    docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    per_lang: int = 400, carry: bool = False,
) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (its probability), with ``carry`` also row (all given columns).

    The network learns from at most ``per_lang`` labelled texts of each language where ``learn``
    holds; predictions read the text's bytes only. A null text, or one without a letter, is
    ``und`` with score 0; so is every text when there is nothing to learn from. Repeated rows and
    null ids are kept. An empty table gives no rows. Other columns are not read.
    """
    marks = docs.where(learn).select(F.col(f"`{id_col}`"), F.col(f"`{lang_col}`").cast("string"))
    texts, langs = sample(docs, marks, per_lang, id_col, text_col)
    net = train(texts, langs) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = take(docs, id_col, text_col, carry).withColumn("letters", F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        pairs = [p.astype(np.float32) for p in net.pairs()] if net else None
        for batch in text_groups(batches):
            letters = batch.column("letters").to_pylist()
            lang, score = [UNDETERMINED] * len(letters), [0.0] * len(letters)
            if net:
                data, offsets = text_bytes(batch.column("text"))
                doc, start, end = spans(offsets, WINDOW)
                pooled = np.concatenate([
                    convolve(windows(data, start[i : i + LOT], end[i : i + LOT]), pairs).max(axis=1)
                    for i in range(0, len(doc), LOT)
                ])
                total = np.add.reduceat(net.log_probs(pooled), np.flatnonzero(np.diff(doc, prepend=-1)), axis=0)
                mean = total / np.bincount(doc)[:, None]
                prob = np.exp(mean - mean.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                best = prob.argmax(axis=1)
                for i, has in enumerate(letters):
                    if has:
                        lang[i], score[i] = net.langs[best[i]], float(prob[i, best[i]])
            yield out_batch(batch, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

    return docs.mapInArrow(run, out_schema(docs, "lang_pred string, score double"))
