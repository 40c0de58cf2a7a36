"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

A text is cut into sections, paragraphs (lines) and sentences. Leaves are hashes of sentences,
each inner node is the hash of its children, the root is the fingerprint. Equal roots mean
equal texts; unequal ones are compared from the top down, and only differing branches are
opened, which locates the edits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.batches import take, text_groups
from tokenmill.plans.scan import locate

#: A sentence ends behind its end marks and blanks; a run without marks is cut at this length.
SENTENCE = re.compile(r"[^.!?]{1,120}[.!?]*\s*|[.!?]+\s*")
#: A section starts at a heading, behind a blank line, or behind about every eighth paragraph by content.
SECTION_SHARE = 8
#: Texts shorter than this also keep the words of their sentences, so that short ones can be likened.
SHORT_CHARS = 512
WORD = re.compile(r"\S+\s*|\s+")
MAX_BLOCKS = 4096


class Tree(NamedTuple):
    """Hashes by level. A section is (hash, paragraphs), a paragraph (hash, leaves), a leaf (hash, characters).

    ``words`` has (hash, characters) of the words below each leaf of a short text, by the leaf's hash.
    """

    root: bytes
    sections: list
    n_chars: int
    words: dict


def _hash(text: str, size: int = 16) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _node(children: list[bytes], size: int = 16) -> bytes:
    return blake2b(b"".join(children), digest_size=size).digest()


def tree(text: str) -> Tree:
    """The Merkle tree of a text. An empty text has no sections."""
    sections: list = []
    words: dict = {}
    current: list = []

    def close() -> None:
        nonlocal current
        if current:
            sections.append((_node([p[0] for p in current]), current))
            current = []

    for line in text.splitlines(keepends=True):
        leaves = [(_hash(s), len(s)) for s in SENTENCE.findall(line)]
        if len(text) < SHORT_CHARS:
            words.update((x[0], [(_hash(w, 8), len(w)) for w in WORD.findall(s)]) for x, s in zip(leaves, SENTENCE.findall(line)))
        if line[0] == "#":
            close()
        paragraph = _node([x[0] for x in leaves]), leaves
        current.append(paragraph)
        if line.isspace() or paragraph[0][0] % SECTION_SHARE == 0:
            close()
    close()
    return Tree(_node([s[0] for s in sections], 32), sections, len(text), words)


def _leaves(t: Tree) -> Iterator[tuple[bytes, int]]:
    for _, paragraphs in t.sections:
        for _, leaves in paragraphs:
            yield from leaves


def _common(left: Counter, right: Counter) -> int:
    """Characters of the common (hash, characters) entries."""
    small, large = (left, right) if len(left) < len(right) else (right, left)
    return sum(min(n, large[x]) * x[1] for x, n in small.items() if x in large)


def likeness(a: Tree, b: Tree) -> float:
    """Share of both texts' characters that lie in common leaves, 0 to 1; two empty texts have 1.

    Between short texts, common words of leaves that differ count too.
    """
    if a.root == b.root:
        return 1.0
    left, right = Counter(_leaves(a)), Counter(_leaves(b))
    common = _common(left, right)
    if a.words and b.words:
        rest = [Counter(w for x in (one - other).elements() for w in t.words[x[0]]) for one, other, t in ((left, right, a), (right, left, b))]
        common += _common(*rest)
    return min(1.0, 2.0 * common / (a.n_chars + b.n_chars))


def differences(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Spans (start, end) of a's characters whose leaves differ from b's, found by opening differing branches only."""
    if a.root == b.root:
        return []
    sections = Counter(s[0] for s in b.sections)
    paragraphs = Counter(p[0] for s in b.sections for p in s[1])
    leaves = Counter(x for x, _ in _leaves(b))
    spans: list[tuple[int, int]] = []
    at = 0
    for name, parts in a.sections:
        size = sum(n for _, own in parts for _, n in own)
        if sections[name]:
            sections[name] -= 1
            at += size
            continue
        for para, own in parts:
            if paragraphs[para]:
                paragraphs[para] -= 1
                at += sum(n for _, n in own)
                continue
            for leaf, n in own:
                if leaves[leaf]:
                    leaves[leaf] -= 1
                elif spans and spans[-1][1] == at:
                    spans[-1] = spans[-1][0], at + n
                else:
                    spans.append((at, at + n))
                at += n
    return spans


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and tree of every text: doc_id, n_chars, fingerprint (root in hex), sections (hashes in hex),
    leaves (array of hash and characters).

    A null text counts as empty. Repeated rows are kept, null ids stay null, an empty table
    gives no rows, other columns are not read.
    """
    docs = take(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in text_groups(batches):
            trees = [tree(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([t.n_chars for t in trees], pa.int64()),
                pa.array([t.root.hex() for t in trees], pa.string()),
                pa.array([[s[0].hex() for s in t.sections] for t in trees], pa.list_(pa.string())),
                pa.array([[{"hash": h.hex(), "n_chars": n} for h, n in _leaves(t)] for t in trees],
                         pa.list_(pa.struct([("hash", pa.string()), ("n_chars", pa.int64())]))),
            ], names=["doc_id", "n_chars", "fingerprint", "sections", "leaves"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string, sections array<string>, "
                                "leaves array<struct<hash: string, n_chars: long>>")


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by id range into blocks, each followed by a copy of the next block's first row (``extra`` = 1).

    The driver sees two ids for each block.
    """
    spark = docs.sparkSession
    blocks = max(1, min(MAX_BLOCKS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks)).first()[0]
    cuts = sorted(set(cuts or []))
    at = locate(F.struct(F.col("doc_id").alias("k0")), [(c,) for c in cuts], [docs.schema["doc_id"].dataType])
    docs = docs.withColumn("block", at)
    first = docs.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m"))
    rows = sorted((r["block"], r["m"]["doc_id"]) for r in first.collect())
    if not rows:
        return docs.withColumn("extra", F.lit(0))
    firsts = spark.createDataFrame(
        [(i, rows[k - 1][0]) for k, (_, i) in enumerate(rows)], docs.select(F.col("doc_id").alias("first_id"), F.col("block").alias("before")).schema
    )
    marked = docs.join(F.broadcast(firsts), docs["doc_id"].eqNullSafe(firsts["first_id"]), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("block"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("block"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("block"), F.lit(1).alias("extra")))
    )
    return marked.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*")


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, and compare both and the next document's.

    The edited form keeps the text but for its last floor(n/2) code points, which are the first
    ones (as many, or all) of the next document by ascending id; the last one is followed by the
    first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edits (spans of the text that differ from the edited form).

    The order needs one shuffle of the texts by id range, and no task sees more than some
    ranges. Ids are numbers. A null text counts as empty; null ids come first; rows that share an
    id follow each other by text, and an exact repetition is followed by its copy. A single
    document is followed by itself. An empty table gives no rows. Other columns are not read.
    """
    docs = take(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = _with_next(docs).repartition("block").sortWithinPartitions("block", "extra", "doc_id", "text")

    def run(batches):
        def emit(rows):
            cols = list(zip(*rows))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], ids)] + [pa.array(c, t) for c, t in zip(cols[1:], types)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits"],
            )

        held = None
        for batch in text_groups(batches):
            ids, out = batch.schema.field("doc_id").type, []
            for name, text, block, extra in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "extra")]):
                own = tree(text)
                if held is not None and held[0] == block:
                    _, last, old, old_tree = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = tree(edited)
                    out.append((
                        last, len(old), sha256(edited.encode()).hexdigest(), old_tree.root.hex(), new.root.hex(),
                        likeness(old_tree, new), likeness(old_tree, own),
                        [{"start": a, "end": b} for a, b in differences(old_tree, new)],
                    ))
                held = None if extra else (block, name, text, own)
            if out:
                yield emit(out)

    return order.mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, edits array<struct<start: long, end: long>>"
    )
