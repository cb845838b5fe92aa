"""Toxicity from subword bags: averaged n-gram embeddings and a linear softmax, learnt together.

Every word, with a mark at both ends, gives its character n-grams (``GRAMS``) and itself as features. Features are hashed
into ``BUCKETS`` rows of one embedding table. A text is the mean of the embeddings of all its features:

    x = mean(weight[feature] * E[feature]),  score = softmax(STEEP * x W + b)[1]

E, W and b are fitted jointly with numpy. A misspelling that no label shows shares most n-grams with the word it
comes from, so it lands near it. At most ``sample`` labelled documents are learnt from, half of them of each label where there are so many;
each label weighs as much as it has rows among all labels. All features of all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import text_slices
from pairsift.llm.words import pieces, prefix_sums, spans_hash

SAMPLE = 4096
BUCKETS = 1 << 16  # a bag has at most so many entries of 6 bytes
WIDTH = 4
GRAMS = (3, 4, 5)
STEEP = 50.0
RARE = 300
THRESHOLD = 0.3
_LETTER = np.ones(128, bool)
_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = False
_MARK = np.uint32(32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one array of code points, a mark before, between and behind them, and where each begins."""
    low = [t.lower() for t in texts]
    cps = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = 1 + np.cumsum([0, *[len(t) + 1 for t in low[:-1]]])
    return np.where((cps < 128) & ~_LETTER[np.minimum(cps, 127)], _MARK, cps), at


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def features(cps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: (places of its features, their buckets), places ascending."""
    outside = cps == _MARK
    marks = np.concatenate(([0], np.cumsum(outside)))
    wide = cps.astype(np.uint64)
    h = wide
    for n in range(2, max(GRAMS) + 1):
        h = h[: max(0, len(cps) - n + 1)] * np.uint64(0x100000001B3) + wide[n - 1 :]
        if n in GRAMS:
            i = np.flatnonzero(marks[n - 1 : len(cps)] == marks[1 : len(cps) - n + 2]) if len(h) else np.zeros(0, np.int64)
            yield i, _bucket(h[i] + np.uint64(n))
    edge = np.flatnonzero(outside[1:] != outside[:-1])
    start, end = edge[::2] + 1, edge[1::2] + 1
    yield start, _bucket(spans_hash(prefix_sums(cps), start, end))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and each one's share; a text without words has none."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in pieces(text.encode("utf-8", "surrogatepass")):
        for _, b in features(code_points([part.decode("utf-8", "surrogatepass")])[0]):
            counts += np.bincount(b, minlength=BUCKETS)
    some = np.flatnonzero(counts)
    return some, (counts[some] / max(1, counts.sum())).astype(np.float32)


class SubwordSoftmax:
    """Embeddings, output weights and their joint gradient.

    Features found in fewer than one of ``RARE`` learnt documents are ignored; the others weigh in the mean by the inverse root of their
    spread, so that words of every text don't drown the telling ones.
    """

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], seed: int = 1):
        spread = np.bincount(np.concatenate([b for b, _ in bags]), minlength=BUCKETS) / len(bags)
        self.known = np.flatnonzero(spread >= 1 / RARE)
        self.weight = np.zeros(BUCKETS, np.float32)
        self.weight[self.known] = np.sqrt(1 / (20 * spread[self.known]))
        place = np.cumsum(spread >= 1 / RARE) - 1
        self.bags = []
        for b, share in bags:
            kept = self.weight[b] > 0
            self.bags.append((place[b[kept]], share[kept] * self.weight[b[kept]]))
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.1, (len(self.known), WIDTH)), "W": r.normal(0, 0.5, (WIDTH, 2)), "b": np.zeros(2)}

    def gradient(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted cross entropy of some bags with its decay, and the gradient of every parameter."""
        at = np.concatenate([self.bags[i][0] for i in rows])
        share = np.concatenate([self.bags[i][1] for i in rows])
        owner = np.repeat(np.arange(len(rows)), [len(self.bags[i][0]) for i in rows])
        E, W = self.p["E"], self.p["W"]
        x = np.stack([np.bincount(owner, share * E[at, k], minlength=len(rows)) for k in range(WIDTH)], axis=1)
        z = STEEP * x @ W + self.p["b"]
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        part = weight[rows] / weight[rows].sum()
        d = (np.exp(log_p) - np.eye(2)[labels[rows]]) * part[:, None]
        dx = STEEP * d @ W.T
        e = np.stack([np.bincount(at, share * dx[owner, k], minlength=len(E)) for k in range(WIDTH)], axis=1)
        loss = -(part * log_p[np.arange(len(rows)), labels[rows]]).sum() + decay / 2 * ((E**2).sum() + (W**2).sum())
        return loss, {"E": e + decay * E, "W": STEEP * x.T @ d + decay * W, "b": d.sum(axis=0)}

    def fit(self, labels: np.ndarray, weight: np.ndarray, rounds: int = 12, size: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 2) -> SubwordSoftmax:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        parts = -(-len(self.bags) // size)
        for t in range(rounds * parts):
            if t % parts == 0:
                batches = np.array_split(r.permutation(len(self.bags)), parts)
            step = rate * (1 - t / (rounds * parts))
            for k, g in self.gradient(batches[t % parts], labels, weight, decay)[1].items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9 ** (t + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (t + 1))) + 1e-8)
        return self

    def scorer(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of label 1, and the log-odds of a text without words.

        The mean comes before the linear layer, so both fold into one number a bucket.
        """
        out = self.p["W"][:, 1] - self.p["W"][:, 0]
        gains = np.zeros(BUCKETS)
        gains[self.known] = STEEP * self.weight[self.known] * (self.p["E"] @ out)
        return gains, float(self.p["b"][1] - self.p["b"][0])


def log_odds(texts: list[bytes], gains: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of label 1 for each text; very long texts are read piece by piece."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    short = [i for i, t in enumerate(texts) if len(pieces(t)) == 1]
    long = sorted(set(range(len(texts))) - set(short))
    for owners, run in [(short, [texts[i] for i in short]), *[([i], [p]) for i in long for p in pieces(texts[i])]]:
        if not run:
            continue
        cps, at = code_points([t.decode("utf-8") for t in run])
        for place, b in features(cps):
            own = np.asarray(owners)[np.searchsorted(at, place + 1, "right") - 1]  # an n-gram may begin with the mark before its text
            total += np.bincount(own, gains[b], minlength=len(texts))
            count += np.bincount(own, minlength=len(texts))
    return bias + total / np.maximum(1, count)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most ``sample`` labelled documents that may be learnt from, and how many have each label.

    Documents are chosen by the hash of their id, up to ``sample`` / 2 of each label; of an id with two labels the lesser counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most two
    halves = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, sample // 2)) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    return docs.join(F.broadcast(chosen), "doc_id"), rows  # at most ``sample`` ids


def _bag_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_slices(batch.column("text")):
            bags = [bag(t.decode("utf-8")) for t in texts]
            packed = [b.astype(np.uint16).tobytes() + s.tobytes() for b, s in bags]
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, len(texts)) for k in ("doc_id", "toxic")] + [pa.array(packed, pa.binary())], ["doc_id", "toxic", "bag"])


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint16, n).astype(np.int64), np.frombuffer(packed[2 * n :], np.float32, n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """What ``SubwordSoftmax.scorer`` gives; None when no labelled document is there."""
    chosen, known = labelled_sample(docs, labels, sample)
    rows = chosen.mapInArrow(_bag_rows, "doc_id long, toxic int, bag binary")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("bag").alias("bag")).collect()  # at most ``sample`` bags of at most 6 * BUCKETS bytes
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    y = np.array([r["toxic"] for r in rows])
    share = {k: known[k] / (y == k).sum() for k in set(y.tolist())}
    bags = [_unpack(bytes(r["bag"])) for r in rows]
    return SubwordSoftmax(bags).fit(y, np.array([share[k] for k in y.tolist()])).scorer()


def _score_rows(model):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, bias = model.value if model is not None else (np.zeros(BUCKETS), 0.0)
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                z = np.clip(log_odds(texts, gains, bias), -40, 40)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return rows


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``held_out`` marks ids that are never learnt from.

    The score is the chance that the text is labelled 1 and depends on the text alone. Null and empty texts and texts without words
    have no feature: their score is that of the intercept. Without a labelled document every score is 0.5; with
    documents of one label only, scores lean to it. Repeated rows and null ids stay and equal texts score alike; other columns of ``docs``
    and ``labels`` are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(rows, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    scored = rows.mapInArrow(_score_rows(shared), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
