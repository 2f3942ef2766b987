"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Every word enters as a word embedding beside the mean of its character n-gram embeddings (both hashed into
tables of fixed size) and the highest first component among the n-grams. A recurrent layer runs over a window of words in each direction, attention pools its
states, and a logistic unit scores the window. A text's score is that of its highest window; windows begin at
every half of a window and cover the whole text, so that a passage of half a window lies whole in one of them.

The network is trained in numpy on the driver, on a bounded sample of labelled texts: ``SAMPLE`` of each
label, those with the smallest hash of their id, of at most ``SAMPLE_CHARS`` characters each. Labels are
those of whole texts, so each epoch trains on the window of each text that the network now finds worst.
First components of the embeddings start from the log-odds of words and n-grams in the sample.

Executors get the model (a few MB, fixed by the table sizes) by broadcast. The input products of a word are
computed once and kept in a table per worker; a step over thousands of windows is a gather and one small
matrix product.

Defined cases: a null text is empty; a text without words has the score of an empty window; texts shorter
than a window are one padded window; what has more than ``LONGEST`` characters without a blank, as scripts
without spaces have, counts as words of ``RUN`` characters; very long texts are scored whole; equal texts, and
rows that repeat, get equal scores; without training rows of both labels every score is 0; labels, lang, source
and doc_id are never inputs of a score. Labels that repeat a doc_id count once, as 1 if any of them is 1, and
so does a document that repeats, with its least text; labels of absent documents teach nothing; an empty table
gives no rows; other columns, whatever their names, are passed on as they are.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import ship, slices, texts, widened

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, ATTEND = 8, 6, 8
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
INPUT = 2 * EMBED + 1
GRAMS = (4, 5)
#: Texts of label 0 and 1 that are trained on, and the most characters of one of them.
SAMPLE, SAMPLE_CHARS = (1600, 800), 50_000
EPOCHS = 6
SMOOTH = 10
#: Steps at least, so that a small sample is trained on as well.
STEPS = 240
#: Words that a worker keeps the input products of.
KEPT_WORDS = 300_000
#: Characters of the longest word, and of the words that a longer one is cut into.
LONGEST, RUN = 48, 8
#: Marks that are no part of a word at its ends.
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—"


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if max(map(len, words), default=0) > LONGEST:
        words = [part for w in words for part in ([w] if len(w) <= LONGEST else (w[i : i + RUN] for i in range(0, len(w), RUN)))]
    return words


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word (bare, lower case); rows of all their character n-grams, and how many each word has.

    An n-gram of a word's marked form is hashed from its code points; a form shorter than n is one n-gram.
    """
    rows = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % WORD_ROWS
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(size) - size
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            count = np.maximum(size - n + 1, 1)
            owner = np.repeat(np.arange(len(words)), count)
            at = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            h = np.full(len(at), n, np.uint32)
            for k in range(n):
                inside = k < size[owner]
                h = np.where(inside, (h ^ cp[np.minimum(at + k, len(cp) - 1)]) * np.uint32(0x9E3779B1), h)
                h ^= h >> np.uint32(15)
            owners.append(owner)
            hashes.append(h % np.uint32(GRAM_ROWS))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return rows, np.concatenate(hashes)[order].astype(np.int64), np.bincount(np.concatenate(owners), minlength=len(words))


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words: every STRIDE, the last one at the end."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


def windows(word_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids [window, position], -1 where a text is shorter; and the number of windows of each text."""
    rows, counts = [], np.zeros(len(word_ids), np.int64)
    for k, ids in enumerate(word_ids):
        starts = np.array(window_starts(len(ids)))
        counts[k] = len(starts)
        if len(ids) < WINDOW:
            ids = np.concatenate([ids, np.full(WINDOW - len(ids), -1)])
        rows.append(ids[starts[:, None] + np.arange(WINDOW)])
    return np.concatenate(rows).astype(np.int64), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. Direction 0 reads forwards, 1 backwards; gates are in the order z, r, n."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)

        self.p = {
            "word": 0.1 * draw(WORD_ROWS, EMBED) * np.float32(np.sqrt(WORD_ROWS)),
            "gram": 0.1 * draw(GRAM_ROWS, EMBED) * np.float32(np.sqrt(GRAM_ROWS)),
            "w": draw(2, INPUT, 3 * HIDDEN),
            "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": draw(2, HIDDEN, 3 * HIDDEN),
            "a": draw(2 * HIDDEN, ATTEND),
            "v": draw(ATTEND),
            "o": draw(2 * HIDDEN),
            "c": np.zeros(1, np.float32),
        }

    def inputs(self, word: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vectors of words given by rows."""
        own, first = self.p["gram"][grams], np.cumsum(sizes) - sizes
        summed, most = np.add.reduceat(own, first), np.maximum.reduceat(own[:, 0], first)
        return np.concatenate([self.p["word"][word], summed / sizes[:, None].astype(np.float32), most[:, None]], axis=1)

    def products(self, x: np.ndarray) -> np.ndarray:
        """Input products of words [direction, word, gates], with a last row for padding."""
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        out[:, :-1] = x @ self.p["w"] + self.p["b"][:, None]
        return out

    def forward(self, products: np.ndarray, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window; keep gets what the backward pass needs."""
        n, h3 = len(rows), 2 * HIDDEN
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        padded = (rows < 0).any()
        for d in (0, 1):
            table, u = products[d], self.p["u"][d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                pre, rec = table[rows[:, t]], h @ u
                gates = _sigmoid(pre[:, :h3] + rec[:, :h3])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(pre[:, h3:] + r * rec[:, h3:])
                now = new + z * (h - new)
                if padded:
                    now = np.where(rows[:, t, None] >= 0, now, h)
                if keep is not None:
                    keep.append((d, t, h, z, r, new, rec[:, h3:]))
                h = now
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        attended = np.tanh(states @ self.p["a"])
        weight = attended @ self.p["v"]
        if padded:
            weight = np.where(rows.T >= 0, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if padded:
            pooled[(rows < 0).all(1)] = 0
        if keep is not None:
            keep.append((states, attended, weight, pooled))
        return pooled @ self.p["o"] + self.p["c"]

    def gradients(self, x: np.ndarray, rows: np.ndarray, target: np.ndarray, weight_of_1: float = 1.0) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss, for the parameters but the embeddings, and for the input vectors."""
        keep: list = []
        products = self.products(x)
        logit = self.forward(products, rows, keep)
        states, attended, weight, pooled = keep.pop()
        n = len(rows)
        err = (np.where(target > 0, weight_of_1, 1.0) * (_sigmoid(logit) - target) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        g["o"], g["c"] = pooled.T @ err, err.sum(keepdims=True)
        d_pooled = err[:, None] * self.p["o"]
        d_weight = (states * d_pooled).sum(2)
        d_states = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tn,tna->a", d_score, attended)
        d_att = d_score[:, :, None] * self.p["v"] * (1 - attended**2)
        g["a"] = np.einsum("tnh,tna->ha", states, d_att)
        d_states += d_att @ self.p["a"].T
        d_products = np.zeros_like(products)
        carry = np.zeros((n, HIDDEN), np.float32)
        last = None
        for d, t, h, z, r, new, rec_n in reversed(keep):
            if d != last:
                carry, last = np.zeros((n, HIDDEN), np.float32), d
            dh = d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN] + carry
            live = (rows[:, t, None] >= 0).astype(np.float32)
            through, dh = dh * (1 - live), dh * live
            d_new = dh * (1 - z) * (1 - new**2)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * rec_n * r * (1 - r)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g["u"][d] += h.T @ d_rec
            carry = d_rec @ self.p["u"][d].T + dh * z + through
            np.add.at(d_products[d], rows[:, t], np.concatenate([d_z, d_r, d_new], axis=1) * live)
        d_products = d_products[:, :-1]
        g["b"] = d_products.sum(1)
        g["w"] = x.T @ d_products
        return g, (d_products @ self.p["w"].transpose(0, 2, 1)).sum(0)


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network trained on labelled texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    words = [words_of(x) for x, _ in sample]
    bare = sorted({w.strip(_EDGES) for own in words for w in own}) or [""]
    known = {w: k for k, w in enumerate(bare)}
    docs = [np.array([known[w.strip(_EDGES)] for w in own], np.int64) for own in words]
    label = np.array([y for _, y in sample], np.float32)
    word, grams, sizes = word_rows(bare)
    ends = np.cumsum(sizes)
    # log-odds of words and n-grams by the number of texts that have them
    totals = np.array([[(label == k).sum() + 1] for k in (0, 1)])
    for name in ("word", "gram"):
        seen = np.zeros((2, len(net.p[name])))
        for ids, y in zip(docs, label):
            own = np.unique(ids)
            seen[int(y), np.unique(word[own] if name == "word" else np.concatenate([grams[ends[i] - sizes[i] : ends[i]] for i in own.tolist()] or [grams[:0]]))] += 1
        # what few texts have says little: SMOOTH texts of the usual mix are added
        odds = np.log((seen + SMOOTH * totals / totals.sum()) / totals)
        net.p[name][:, 0] = (odds[1] - odds[0]).clip(-1, 6) / 2
    cut, counts = windows(docs)
    first = np.cumsum(counts) - counts
    moments: dict[str, list] = {}
    step, per_epoch = 0, max(1, (len(label) + min(len(label), int(counts[label == 0].sum()))) // 128)
    share = float(label.mean() / 2)  # of label 1 among what is trained on
    for epoch in range(max(epochs, -(-STEPS // per_epoch))):
        x = net.inputs(word, grams, sizes)
        if epoch:
            products = net.products(x)
            logits = np.concatenate([net.forward(products, cut[i : i + 4096]) for i in range(0, len(cut), 4096)])
        else:
            both = np.append(x[:, 0] + x[:, -1], -9)
            logits = both[cut].max(1)
        worst = np.array([f + int(logits[f : f + c].argmax()) for f, c in zip(first, counts)])
        clean = np.flatnonzero(np.repeat(label, counts) == 0)
        picked = np.concatenate([worst, rng.choice(clean, min(len(clean), len(worst)), replace=False)])
        target = np.repeat(label, counts)[picked]
        order = rng.permutation(len(picked))
        for i in range(0, len(order), 128):
            own = cut[picked[order[i : i + 128]]]
            used, local = np.unique(own, return_inverse=True)
            local = local.reshape(own.shape)
            if used[0] < 0:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            n_grams = sizes[used]
            owner = np.repeat(np.arange(len(used)), n_grams)
            own_grams = grams[(ends - sizes)[used][owner] + np.arange(len(owner)) - (np.cumsum(n_grams) - n_grams)[owner]]
            g, dx = net.gradients(net.inputs(word[used], own_grams, n_grams), local, target[order[i : i + 128]], min(4.0, (1 - share) / share))
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                m = moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.001 * (v * v - m[1])
                net.p[k] -= (rate * m[0] / (np.sqrt(m[1]) + 1e-8)).astype(np.float32)
            np.add.at(net.p["word"], word[used], -0.1 * dx[:, :EMBED])
            np.add.at(net.p["gram"], own_grams, (-0.1 * dx[:, EMBED : 2 * EMBED] / n_grams[:, None])[owner])
    return net


class Scorer:
    """Scores of texts, with the input products of recent words at hand."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known, self.bare, self.fresh = _Places(self), {}, []
        self.products = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _learn(self) -> None:
        """Input products of the words that came up."""
        if self.fresh:
            added = self.net.products(self.net.inputs(*word_rows(self.fresh)))[:, :-1]
            stop = len(self.bare)
            if stop >= self.products.shape[1]:
                self.products = np.concatenate([self.products, np.zeros((2, stop, 3 * HIDDEN), np.float32)], axis=1)
            self.products[:, stop - len(self.fresh) : stop] = added
            self.fresh = []

    def __call__(self, own: list[str]) -> np.ndarray:
        if len(self.bare) > KEPT_WORDS or len(self.known) > 3 * KEPT_WORDS:
            self.clear()
        place, ids = self.known.__getitem__, []
        for x in own:
            words = words_of(x)
            ids.append(np.fromiter(map(place, words), np.int64, len(words)))
        self._learn()
        rows, counts = windows(ids)
        logits = np.concatenate([self.net.forward(self.products, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])
        return _sigmoid(np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64))


class _Places(dict):
    """Word as written -> place of its bare form in the table of input products."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        s, bare = self.scorer, word.strip(_EDGES)
        place = s.bare.get(bare)
        if place is None:
            place = s.bare[bare] = len(s.bare)
            s.fresh.append(bare)
        self[word] = place
        return place


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    """A network from the labelled documents among ``docs``; None where a label is missing.

    The sample is drawn from the labels, and only its ids (2 x sample rows) are broadcast to the scan of texts. One task trains
    on the sample, and the driver gets the network's numbers.
    """
    ship(docs.sparkSession)
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample[y]) for y in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    found = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(F.broadcast(ids), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"), F.xxhash64("doc_id").alias("h"))  # of each id one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [r for b in batches for r in b.to_pylist()]
        own = {y: sorted((r for r in every if r["toxic"] == y), key=lambda r: (r["h"], r["doc_id"]))[: sample[y]] for y in (0, 1)}
        if own[0] and own[1]:
            net = fit([(r["text"], y) for y in (0, 1) for r in own[y]])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)])], names=["net"])

    trained = rows.repartition(1).mapInArrow(run, "net binary").collect()  # one row or none
    return pickle.loads(trained[0]["net"]) if trained else None


def score_texts(docs: DataFrame, net: Network | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of every row, with the score (in a column named ``into``)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else lambda own: np.zeros(len(own))
        for b in slices(batches, text_col, 1_000_000):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer(texts(b, text_col)))], names=[*b.schema.names, into])

    return widened(docs, run, StructField(into, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from rows that are not held out."""
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held_out, F.lit(False))
    net = train(docs.where(~apart), labels.where(~apart))
    scored = score_texts(docs.select("doc_id", "text", apart.alias("held_out")), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
