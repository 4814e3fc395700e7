"""Spelling variants: words one edit apart, found by walking a trie that is kept as a table of edges.

A node of the trie is a prefix (its hash); the reversed words have a trie of their own.  The frontier is a table of
states (word, position, node, edits).  A state first takes its edit, a replaced or an inserted character, and goes on
with the rest of its word along unedited edges, level by level, each level one join with the edge table; a state whose
rest is empty on a node where a word ends is a neighbour.  Three things keep it small:

* An edge takes the largest power of two of the characters that are left, so that a word of n letters needs log2(n)
  levels, and a state must agree on many characters to live on.  (Words of a million letters need twenty.)
* An edit in the first half of a word leaves its second half whole, so it is made in the trie of reversed words: no
  state ever branches near a root, where every word passes and every letter follows.
* Deletions are insertions seen from the other word, so only insertions are walked.

A word has about two states and one edge for each letter, and a node has no more children than there are letters, so
all tables grow with the words.  Hashes only lead to candidates: pairs are confirmed on the words themselves.
Joins are merged by hint: what Spark expects of these tables is the size of the compressed words, many times less than
their states and edges, and by it the driver would gather them to broadcast.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each
time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage
from acrework.llm.common import documents, text_slices, utf8
from acrework.llm.rolling import Prefix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"  # after lower-casing
#: A run whose hash this divides loses one character.
ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Label of the edge on which a word ends.
_END = np.int32(0x5BD1E99)
#: Nodes of the two tries differ by this.
_SIDES = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
_SLICE = 100_000
_STATES = "id long, node long, label int, char short, inserts boolean, rest array<int>"


def noisy_words(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """``word``, one row for each run of letters; one run in ``one_in`` lacks the character that its hash names."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("_run"))
    hashed = runs.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    return hashed.select(F.when(F.col("_h") % one_in == 0, shorter).otherwise(F.col("_run")).alias("word"))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers from low up to (without) high of each row, and their rows."""
    size = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


class _Side:
    """The words of a slice, read in one direction; positions count from the start of the concatenated words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, side: int):
        if side:
            data, offsets, ids = data[::-1], offsets[-1] - offsets[::-1], ids[::-1]
        self.data, self.ids, self.begin, self.end = data, ids, offsets[:-1], offsets[1:]
        self.half = self.begin + (self.end - self.begin) // 2
        self.prefix, self.salt = Prefix(np.ascontiguousarray(data)), _SIDES[side]

    def node(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.prefix.ranges(self.begin[word], at) ^ self.salt).view(np.int64)

    def step(self, left: np.ndarray) -> np.ndarray:
        """The largest power of two of what is left; 0 at the end."""
        return np.where(left > 0, 1 << np.frexp(np.maximum(left, 1).astype(float))[1] - 1, 0)

    def label(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, self.prefix.ranges(at, at + size).astype(np.uint32).view(np.int32), _END)

    def rest(self, word: np.ndarray, at: np.ndarray) -> pa.Array:
        """The labels of all steps from ``at`` to the end of the word."""
        left = self.end[word] - at
        number = np.zeros(len(at), np.int64)
        for k in range(int(left.max(initial=0)).bit_length()):
            number += left >> k & 1
        offsets = np.concatenate([[0], np.cumsum(number)])
        out, fill = np.zeros(offsets[-1], np.int32), offsets[:-1].copy()
        while len(open_ := np.flatnonzero(at < self.end[word])):
            size = self.step(self.end[word[open_]] - at[open_])
            out[fill[open_]] = self.label(at[open_], size)
            fill[open_] += 1
            at = at.copy()
            at[open_] += size
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words (letters up to U+00FF), one after the other, and their offsets."""
    letters, offsets = utf8(words)
    lead = np.concatenate([[0], np.cumsum((letters & 0xC0) != 0x80)])
    return np.frombuffer(letters.tobytes().decode().encode("latin-1"), np.uint8), lead[offsets]


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[_Side]:
    for batch in text_slices(batches, "word", _SLICE):
        points, offsets = _points(batch.column("word"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for side in (0, 1):
            yield _Side(points, offsets, ids, side)


def _state_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of each word that are about to take their edit: replacing or inserting at each place of the second half."""
    for s in _sides(batches):
        for inserts in (False, True):
            word, at = _spread(s.half, s.end + inserts)
            after = at + (not inserts)
            size = s.step(s.end[word] - after)
            char = np.append(s.data, 0)[at].astype(np.int16)
            if inserts:
                char[at == s.end[word]] = -1  # any character may follow the last one
            yield pa.record_batch(
                [pa.array(s.ids[word]), pa.array(s.node(word, at)), pa.array(s.label(after, size)), pa.array(char), pa.array(np.full(len(at), inserts)), s.rest(word, after + size)],
                ["id", "node", "label", "char", "inserts", "rest"],
            )


def _edge_rows(batches: Iterator[pa.RecordBatch], edited: bool) -> Iterator[pa.RecordBatch]:
    """Edges (node, label) to child.  An edited edge takes one character more, of any kind, before those of its label."""
    for s in _sides(batches):
        word, at = _spread(np.maximum(s.half - 1, s.begin), s.end) if edited else _spread(s.half, s.end)
        after = at + edited
        size = s.step(s.end[word] - after)
        columns = {"node": s.node(word, at), "label": s.label(after, size), "char": s.data[at].astype(np.int16), "child": s.node(word, after + size)}
        if not edited:
            del columns["char"]
        yield pa.record_batch([pa.array(c) for c in columns.values()], list(columns))


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on which words end, in both tries."""
    for s in _sides(batches):
        yield pa.record_batch([pa.array(s.node(np.arange(len(s.ids)), s.end)), pa.array(s.ids)], ["node", "near_id"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that really are one edit apart: what follows their common beginning and the edit is equal."""
    for batch in text_slices(batches, "word", _SLICE):
        a, a_off = _points(batch.column("word"))
        b, b_off = _points(batch.column("near"))
        a_len, b_len = np.diff(a_off), np.diff(b_off)
        pair, at = _spread(np.zeros(len(a_len), np.int64), np.minimum(a_len, b_len))
        differ = np.flatnonzero(a[a_off[:-1][pair] + at] != b[b_off[:-1][pair] + at])
        same = np.minimum(a_len, b_len)  # length of the common beginning
        owner, first = np.unique(pair[differ], return_index=True)
        same[owner] = at[differ[first]]
        left = np.maximum(a_len, b_len) - same - 1  # characters after the edit
        good = (np.abs(a_len - b_len) <= 1) & (left >= 0)
        good &= left <= np.minimum(a_len, b_len)
        pair, at = _spread(np.zeros(len(a_len), np.int64), np.where(good, left, 0))
        good[pair[a[a_off[1:][pair] - 1 - at] != b[b_off[1:][pair] - 1 - at]]] = False
        yield pa.record_batch([batch.column(c).filter(pa.array(good)) for c in ("id", "near_id")], ["id", "near_id"])


def near_words(words: DataFrame) -> DataFrame:
    """``id`` and ``near_id`` of all different words one edit apart, both ways round; words has unique ``id`` and ``word``.

    Words consist of letters up to U+00FF.
    """
    words = words.select("id", "word")
    edges = words.mapInArrow(lambda it: _edge_rows(it, True), "node long, label int, char short, child long").distinct()
    jumps = words.mapInArrow(lambda it: _edge_rows(it, False), "node long, label int, child long").distinct()
    ends = words.mapInArrow(_end_rows, "node long, near_id long")
    states = words.mapInArrow(_state_rows, _STATES).withColumnRenamed("char", "own")
    frontier = states.join(edges.hint("merge"), ["node", "label"]).filter(F.col("own") != F.col("char")).select("id", "inserts", F.col("child").alias("node"), "rest")
    done = []
    while True:
        frontier = cut_lineage(frontier, "trie-frontier")
        done.append(frontier.filter(F.size("rest") == 0).select("id", "inserts", "node"))
        going = frontier.filter(F.size("rest") > 0)
        if going.isEmpty():
            break
        step = going.select("id", "inserts", "node", F.col("rest")[0].alias("label"), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"))
        frontier = step.join(jumps.hint("merge"), ["node", "label"]).select("id", "inserts", F.col("child").alias("node"), "rest")
    terminal = done[0]
    for level in done[1:]:
        terminal = terminal.unionByName(level)
    found = terminal.join(ends.hint("merge"), "node").select("id", "near_id", "inserts")
    pairs = found.select("id", "near_id").unionByName(found.filter("inserts").select(F.col("near_id").alias("id"), F.col("id").alias("near_id"))).distinct()
    near = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"))
    both = pairs.join(words.hint("merge"), "id").join(near.hint("merge"), "near_id")
    return both.select("id", "near_id", "word", "near").mapInArrow(_confirmed, "id long, near_id long")


def _rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word of its chain; forms has word and form (null at the end of a chain).

    Each round doubles the length of the chain that is followed; counts grow along a chain at least by the ratio, so chains
    are short and never close.
    """
    chain = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        chain = cut_lineage(chain, "word-roots")
        ahead = chain.filter(F.col("word") != F.col("root")).select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = chain.join(ahead.hint("merge"), "root", "left")
        if step.filter("_further IS NOT NULL").isEmpty():
            return chain
        chain = step.select("word", F.coalesce("_further", "root").alias("root"))


def spelling_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of ``word`` (different words) and ``n``.

    A word's form is its near word of largest n (ties: the least word), if that n is at least ``ratio`` times its own.
    """
    words = cut_lineage(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    target = words.select(F.col("id").alias("near_id"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("form")).alias("_near"))
    best = near_words(words).join(target.hint("merge"), "near_id").groupBy("id").agg(F.count("*").alias("n_near"), F.min("_near").alias("_best"))
    chosen: Column = -F.col("_best.m") >= ratio * F.col("n")
    forms = words.join(best.hint("merge"), "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("_best.form")).alias("form"), F.when(chosen, -F.col("_best.m")).alias("form_n"))
    forms = cut_lineage(forms, "word-forms")
    return forms.join(_rooted(forms).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all whole texts of ``documents``."""
    words = noisy_words(documents(spark, sf_dir)).filter(F.char_length("word") >= LEAST_LENGTH)
    return spelling_variants(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT))
