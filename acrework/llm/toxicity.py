"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a learnt vector (frequent words of the sample) beside the mean vector of its hashed character
n-grams, so unseen spellings still carry their parts.  Windows of ``WINDOW`` words overlap by half and cover the whole
text; both directions run over each, attention pools its states, and the window logits are pooled by a softmax of
themselves, so that one bad window decides.  All windows of all texts are scored, in tasks, without a shuffle.

The network is trained on the driver on a bounded sample, ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled whole texts.
Vectors start from smoothed log odds of the sample, everything else from fixed random numbers.

Defined results: null and empty texts are scored as a window without words; with labels of one class only, every score is the
bias of that class, and with none it is below 0.5; labels, language, source and id are never inputs; repeated rows get equal scores; other columns are
ignored.  A label with several rows counts as toxic if any of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.llm.common import bounded_sample, documents, held_out, text_slices

WINDOW, STRIDE = 32, 16
#: Bound of the training sample: labelled whole texts of the toxic and of the other class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 3000
#: Bound of the bytes of text of each class in the sample.
SAMPLE_BYTES = 40_000_000
WORDS, GRAMS = 1 << 12, 1 << 15
DIM, HIDDEN = 8, 8
STEPS, BATCH, RATE = 500, 16, 0.01
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def character_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- to 5-grams of ``^word$``, and the word of each."""
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    value, buckets, owners = np.zeros(len(points), np.uint32), [], []
    for n in range(1, 6):
        m = len(points) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        if n >= 3:
            at = np.flatnonzero(owner[:m] == owner[n - 1 :])
            mixed = value[at] ^ (value[at] >> np.uint32(15))
            buckets.append((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15))
            owners.append(owner[at])
    if not buckets:
        return np.zeros(0, np.intp), np.zeros(0, np.intp)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order].astype(np.intp), owners[order]


class Batch:
    """Distinct words of some texts and the windows over them."""

    def __init__(self, texts: list[str | None]):
        split = [t.lower().split() if t else [] for t in texts]
        every = [w for words in split for w in words]
        place = {w: i + 1 for i, w in enumerate(dict.fromkeys(every))}  # 0 pads
        self.words = list(place)
        flat = np.fromiter(map(place.__getitem__, every), np.int32, len(every))
        count = np.asarray([len(words) for words in split])
        self.windows_of = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        self.first = np.cumsum(self.windows_of) - self.windows_of
        doc = np.repeat(np.arange(len(texts)), self.windows_of)
        begin = (np.arange(len(doc)) - self.first[doc]) * STRIDE
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < count[doc][:, None]
        index = np.where(inside, at + (np.cumsum(count) - count)[doc][:, None], 0)
        self.ids = np.where(inside, flat[index] if len(flat) else 0, 0).astype(np.int32)
        self.doc = doc


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.vocabulary = vocabulary
        h = HIDDEN
        self.p = {
            "word": small(WORDS, DIM),
            "gram": small(GRAMS, DIM),
            "into": rng.normal(0, 0.3, (2 * DIM, 6 * h)).astype(np.float32),  # to (reset, update, new) x (forward, backward)
            "bias": np.zeros(6 * h, np.float32),
            "turn": rng.normal(0, 0.3, (2, h, 3 * h)).astype(np.float32),
            "look": rng.normal(0, 0.3, 2 * h).astype(np.float32),
            "out": rng.normal(0, 0.3, 2 * h).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def word_inputs(self, words: list[str]):
        stripped = [w.strip(PUNCTUATION) or w for w in words]
        known = np.fromiter((self.vocabulary.get(w, 0) for w in stripped), np.intp, len(words))
        buckets, owner = character_grams(stripped)
        number = np.maximum(np.bincount(owner, minlength=len(words)), 1).astype(np.float32)
        mean = np.zeros((len(words), DIM), np.float32)
        if len(owner):
            has = np.unique(owner)
            mean[has] = np.add.reduceat(self.p["gram"][buckets], np.searchsorted(owner, has), axis=0)
        return known, buckets, owner, number, np.concatenate((self.p["word"][known], mean / number[:, None]), 1)

    def _turn(self) -> np.ndarray:
        """Both directions' recurrent weights as one matrix that keeps them apart."""
        h, full = HIDDEN, np.zeros((2 * HIDDEN, 3, 2, HIDDEN), np.float32)
        for d in range(2):
            full[d * h : (d + 1) * h, :, d] = self.p["turn"][d].reshape(h, 3, h)
        return full.reshape(2 * h, 6 * h)

    def window_logits(self, batch: Batch, keep: bool = False):
        h, n = HIDDEN, len(batch.ids)
        *words, x = self.word_inputs(batch.words) if batch.words else ((), (), (), (), np.zeros((0, 2 * DIM), np.float32))
        table = np.zeros((len(x) + 1, 3, 2, h), np.float32)
        table[1:] = (x @ self.p["into"] + self.p["bias"]).reshape(-1, 3, 2, h)
        table[0, 1] = 40.0  # padding leaves the state as it is
        ahead, behind = np.ascontiguousarray(table[:, :, 0]), np.ascontiguousarray(table[:, :, 1])
        turn = self._turn()
        state = np.zeros((n, 2 * h), np.float32)
        states = np.zeros((WINDOW, n, 2, h), np.float32)
        kept = []
        gates = np.empty((n, 3, 2, h), np.float32)
        for t in range(WINDOW):
            gates[:, :, 0] = ahead[batch.ids[:, t]]
            gates[:, :, 1] = behind[batch.ids[:, WINDOW - 1 - t]]
            back = (state @ turn).reshape(n, 3, 2 * h)
            flat = gates.reshape(n, 3, 2 * h)
            reset, update = _sigmoid(flat[:, 0] + back[:, 0]), _sigmoid(flat[:, 1] + back[:, 1])
            new = np.tanh(flat[:, 2] + reset * back[:, 2])
            before, state = state, new + update * (state - new)
            if keep:
                kept.append((before, back[:, 2].copy(), reset, update, new))
            both = state.reshape(n, 2, h)
            states[t, :, 0] = both[:, 0]
            states[WINDOW - 1 - t, :, 1] = both[:, 1]
        hidden = states.reshape(WINDOW, n, 2 * h)
        score = (hidden @ self.p["look"]).T
        score[batch.ids == 0] = -1e9
        weight = np.exp(score - score.max(1, keepdims=True))
        weight *= batch.ids != 0
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,tnh->nh", weight, hidden)
        logit = pooled @ self.p["out"] + self.p["base"][0]
        return (logit, (words, x, turn, kept, hidden, weight, pooled)) if keep else logit

    @staticmethod
    def document_logits(logit: np.ndarray, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Window logits pooled by their own softmax, and the share of each window."""
        top = np.maximum.reduceat(logit, batch.first)
        share = np.exp(logit - top[batch.doc])
        share /= np.add.reduceat(share, batch.first)[batch.doc]
        return np.add.reduceat(share * logit, batch.first), share

    def scores(self, texts: list[str | None]) -> np.ndarray:
        batch = Batch(texts)
        return _sigmoid(self.document_logits(self.window_logits(batch), batch)[0].astype(np.float64))

    def gradients(self, texts: list[str], target: np.ndarray) -> dict[str, np.ndarray]:
        h, batch = HIDDEN, Batch(texts)
        logit, (words, x, turn, kept, hidden, weight, pooled) = self.window_logits(batch, keep=True)
        doc_logit, share = self.document_logits(logit, batch)
        d_doc = ((_sigmoid(doc_logit) - target) / len(texts)).astype(np.float32)
        d_logit = d_doc[batch.doc] * share * (1 + logit - doc_logit[batch.doc])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["base"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("tnh,nh->nt", hidden, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["look"] = np.einsum("nt,tnh->h", d_score, hidden)
        d_hidden = weight.T[:, :, None] * d_pooled + d_score.T[:, :, None] * self.p["look"]
        d_table = np.zeros((len(x) + 1, 3, 2, h), np.float32)
        d_turn = np.zeros_like(turn)
        d_state = np.zeros((len(logit), 2 * h), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            d_state[:, :h] += d_hidden[t, :, :h]
            d_state[:, h:] += d_hidden[WINDOW - 1 - t, :, h:]
            before, back_new, reset, update, new = kept[t]
            d_new = d_state * (1 - update) * (1 - new * new)
            d_update = d_state * (before - new) * update * (1 - update)
            d_reset = d_new * back_new * reset * (1 - reset)
            d_flat = np.stack((d_reset, d_update, d_new), 1)
            d_back = np.stack((d_reset, d_update, d_new * reset), 1).reshape(len(logit), -1)
            d_turn += before.T @ d_back
            d_state = d_state * update + d_back @ turn.T
            parts = d_flat.reshape(len(logit), 3, 2, h)
            np.add.at(d_table[:, :, 0], batch.ids[:, t], parts[:, :, 0])
            np.add.at(d_table[:, :, 1], batch.ids[:, WINDOW - 1 - t], parts[:, :, 1])
        full = d_turn.reshape(2, h, 3, 2, h)
        g["turn"] = np.stack([full[d, :, :, d].reshape(h, 3 * h) for d in range(2)])
        d_rows = d_table[1:].reshape(len(x), -1)
        g["into"], g["bias"] = x.T @ d_rows, d_rows.sum(0)
        d_x = d_rows @ self.p["into"].T
        known, buckets, owner, number = words
        np.add.at(g["word"], known, d_x[:, :DIM])
        np.add.at(g["gram"], buckets, (d_x[:, DIM:] / number[:, None])[owner])
        return g


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    odds = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    return np.where(toxic + clean >= 4, np.clip(odds, -3, 3), 0.0).astype(np.float32)


def fit_network(rows: list[tuple[str, int]], steps: int = STEPS) -> Network:
    """Train on (text, label) pairs with Adam, in as many whole rounds as give at least ``steps`` steps."""
    labels = np.asarray([y for _, y in rows])
    n_toxic, n_clean = int(labels.sum()), int(len(labels) - labels.sum())
    in_docs: dict[str, np.ndarray] = {}
    grams = np.zeros((2, GRAMS))
    for text, y in rows:
        words = list({w.strip(PUNCTUATION) or w for w in text.lower().split()})
        for w in words:
            in_docs.setdefault(w, np.zeros(2))[y] += 1
        if words:
            grams[y, np.unique(character_grams(words)[0])] += 1
    frequent = sorted((w for w, n in in_docs.items() if n.sum() >= 3), key=lambda w: (-in_docs[w].sum(), w))
    # words that tell the classes apart come first
    telling = sorted(frequent, key=lambda w: -abs(float(_log_odds(*in_docs[w][::-1, None], max(n_toxic, 1), max(n_clean, 1))[0])) * in_docs[w].sum())
    net = Network({w: i + 1 for i, w in enumerate(telling[: WORDS - 1])})
    if not n_toxic or not n_clean:  # nothing tells the classes apart: the score is that of the bias
        net.p["out"][:] = 0
        net.p["base"][0] = np.log((n_toxic + 0.5) / (n_clean + 1))
        return net
    for w, i in net.vocabulary.items():
        net.p["word"][i, 0] = _log_odds(*in_docs[w][::-1, None], n_toxic, n_clean)[0] / 3
    net.p["gram"][:, 0] = _log_odds(grams[1], grams[0], n_toxic, n_clean) / 3
    rng = np.random.default_rng(5)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, epochs = 0, -(-steps * BATCH // len(rows))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = [rows[i] for i in order[at : at + BATCH]]
            g, step = net.gradients([t for t, _ in some], np.asarray([y for _, y in some])), step + 1
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            rate = RATE / (1 + 3 * step / steps)
            for k, v in g.items():
                v *= min(1.0, 5.0 / max(norm, 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC)) -> Network:
    """Learn from labelled rows that are not held out; at most ``most`` texts of class 0 and 1 reach the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return fit_network([])
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    share = {y: min(1.0, (1.2 * most[y] + 20) / n) for y, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    drawn = known.withColumn("draw", draw).filter(F.col("draw") < limit)  # about 1.2 times the bound: small at any input
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    sample = bounded_sample(rows.withColumn("draw", F.xxhash64("draw", "text") / 2.0**64 + 0.5), "toxic", dict.fromkeys(sizes, 2.0), {y: most[y] for y in sizes}, SAMPLE_BYTES)
    sample = [(r["text"], int(r["toxic"])) for r in sorted(sample.collect(), key=lambda r: (r["draw"], r["text"]))]
    return fit_network(sample)


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # parameters of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 500_000):
            yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
