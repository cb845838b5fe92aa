"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (shares of character classes, word lengths, repetition,
hashed words), a learned layer gives its representation, gated attention weighs the passages, and the weighted
mean is scored:

    h = tanh(x E + b),  a = softmax(w . (tanh(h V) * sigmoid(h U))),  score = sigmoid(sum(a h) . c + d)

Only labels of whole documents are needed; the attention finds the passages that decide. All passages of all
documents are scored. The model is fitted on at most ``sample`` labelled documents (those with the least hash of
their id) and at most ``BAG`` evenly spaced passages of each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import free_name, text_slices
from pairsift.llm.words import pieces, prefix_sums, spans_hash, word_spans

PASSAGE = 64  # words
SAMPLE = 4096
BAG = 256
BUCKETS = 16
_MARKS = b"\n.,|!#%&*$"
_CLASS = np.full(256, 15, np.int64)  # other
_CLASS[list(range(128, 256))] = 14
_CLASS[list(b" \t\r\x0b\x0c")] = 13
_CLASS[list(range(48, 58))] = 12
_CLASS[list(range(65, 91))] = 11
_CLASS[list(range(97, 123))] = 10
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = _k
FEATURES = 16 + 6 + BUCKETS


def _passages(part: bytes) -> np.ndarray:
    """Features of each passage of a text, one row each; a text without words is one row."""
    if not part:
        return np.zeros((1, FEATURES), np.float32)
    buf = np.frombuffer(part, np.uint8)
    start, end = word_spans(buf)
    count = max(1, -(-len(start) // PASSAGE))
    edges = np.append(start[::PASSAGE], len(buf)) if len(start) else np.array([0, len(buf)])
    edges[0] = 0
    owner = np.repeat(np.arange(count), np.diff(edges))
    out = np.zeros((count, FEATURES), np.float32)
    shares = np.bincount(owner * 16 + _CLASS[buf], minlength=16 * count).reshape(count, 16)
    out[:, :16] = np.sqrt(shares / np.diff(edges)[:, None])
    if len(start):
        word = np.arange(len(start)) // PASSAGE
        n = np.bincount(word, minlength=count)
        size = (end - start).astype(np.float64)
        mean = np.bincount(word, size, minlength=count) / n
        hashes = spans_hash(prefix_sums(buf), start, end)
        order = np.lexsort((hashes, word))
        h, w = hashes[order], word[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (word[1:] == word[:-1])))
        out[:, 16] = mean / 10
        out[:, 17] = np.sqrt(np.maximum(0, np.bincount(word, size**2, minlength=count) / n - mean**2)) / 10
        out[:, 18] = np.bincount(w, fresh, minlength=count) / n
        out[:, 19] = np.bincount(word, same, minlength=count) / n
        out[:, 20] = n / PASSAGE
        out[:, 21] = (n < PASSAGE / 2) & (count > 1)
        sign = ((hashes >> np.uint64(63)).astype(np.float64) * 2) - 1
        bucket = (hashes >> np.uint64(8)).astype(np.int64) % BUCKETS
        sums = np.bincount(word * BUCKETS + bucket, sign, minlength=count * BUCKETS).reshape(count, BUCKETS)
        out[:, 22:] = sums / np.sqrt(n)[:, None] / 4
    return out


def encode_passages(text: bytes) -> np.ndarray:
    """Features of all passages of a text; very long texts are encoded piece by piece."""
    return np.concatenate([_passages(p) for p in pieces(text)]) if text else _passages(b"")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Weights, forward pass and gradient of the bag classifier."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        shapes = {"E": (FEATURES, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags; ``x``: passages of all bags, ``at``: where each bag begins."""
        p, n = self.p, np.diff(np.append(at, len(x)))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        a = e / np.repeat(np.add.reduceat(e, at), n)
        bag = np.add.reduceat(a[:, None] * h, at)
        return _sigmoid(bag @ p["c"] + p["d"]), {"z": z, "h": h, "v": v, "u": u, "a": a, "bag": bag, "n": n}

    def gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, decay: float) -> dict:
        p = self.p
        score, s = self.forward(x, at)
        n, h, a, u, v = s["n"], s["h"], s["a"], s["u"], s["v"]
        d = (score - y) / len(y)
        g = {"c": s["bag"].T @ d, "d": np.array([d.sum()])}
        up = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (up * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
        g["w"] = (v * u).T @ de
        dv, du = de[:, None] * p["w"] * u * (1 - v**2), de[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * up + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        g["E"], g["b"] = s["z"].T @ dh, dh.sum(axis=0)
        return {k: g[k] + decay * p[k] for k in p}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = 250, rate: float = 0.03, decay: float = 1e-4) -> AttentionModel:
        x = np.concatenate(bags).astype(np.float64)
        at = np.cumsum([0, *[len(b) for b in bags[:-1]]])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for t in range(1, rounds + 1):
            for k, g in self.gradient(x, at, labels, decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, quality, text) of at most ``sample`` labelled documents outside the held-out third."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = known.join(present.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return present.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids


def _bag_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_slices(batch.column("text")):
            bags = []
            for t in texts:
                x = encode_passages(t)
                bags.append(x[np.unique(np.linspace(0, len(x) - 1, BAG).astype(int))] if len(x) > BAG else x)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, n) for k in ("doc_id", "quality")] + [pa.array([b.tobytes() for b in bags], pa.binary())], ["doc_id", "quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | None:
    """The fitted model; None when no labelled document is there."""
    rows = labelled_sample(docs, labels, sample).mapInArrow(_bag_rows, "doc_id long, quality int, bag binary")
    rows = sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])  # bounded by sample and BAG
    if not rows:
        return None
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, FEATURES) for r in rows]
    return AttentionModel().fit(bags, np.array([float(r["quality"]) for r in rows]))


def _score_rows(model: AttentionModel | None, out: str):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, texts in text_slices(batch.column("text")):
                if model is None:
                    parts.append(np.full(len(texts), 0.5))
                    continue
                bags = [encode_passages(t) for t in texts]
                at = np.cumsum([0, *[len(b) for b in bags[:-1]]])
                parts.append(model.forward(np.concatenate(bags).astype(np.float64), at)[0])
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, out])

    return rows


def with_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, out: str = "_score") -> DataFrame:
    """``docs`` with ``out`` (not a name of its columns), the chance that the text is labelled 1 (0 to 1).

    The score depends on the text alone; null and empty texts get the score of a bag of one empty passage. Without any
    labelled document every score is 0.5. Repeated rows get equal scores; other columns pass unchanged.
    """
    model = train(docs, labels, sample)
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], f"`{out}` double"])
    return docs.mapInArrow(_score_rows(model, out), shape)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; held_out marks ids that are never learnt from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_quality(rows, labels, sample)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    out = free_name("_score", docs)
    return with_quality(docs, labels, sample, out).where(F.col(out) >= least).select(*docs.columns)
