"""Quality by random-indexing word vectors and a small network (operator 2)."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold_of, steps, texts_of
from marlstone.llm.tables import Spec, gather, labelled_sample

#: Hash buckets of tokens; dimensions of a vector; nonzero entries of an index vector; words to each side.
BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Buckets(dict):
    """Token to bucket, remembered up to a bound; bucket 0 stands between texts."""

    def __missing__(self, w):
        if len(self) > 400_000:
            self.clear()
        b = self[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
        return b


def index_vectors(seed: int = 5) -> np.ndarray:
    """One sparse vector of +1 and -1 per bucket; the separator has none."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM), dtype=np.int16)
    for row in table[1:]:
        at = rng.permutation(DIM)[:NONZERO]
        row[at] = rng.integers(0, 2, NONZERO) * 2 - 1
    return table


def _ids(texts: list[str], buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens, ``WINDOW`` separators before each text and after the last; where texts begin."""
    flat, begins = [0] * WINDOW, []
    for t in texts:
        begins.append(len(flat))
        flat += map(buckets.__getitem__, _TOKEN.findall(t))
        flat += [0] * WINDOW
    return np.array(flat, dtype=np.int32), np.array(begins, dtype=np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random indexing over all texts: a bucket's vector is the sum of its neighbours' index vectors, to unit length."""

    def count(tables, batch):
        index, buckets, total = index_vectors(), _Buckets(), tables["sum"]
        texts = texts_of(batch.column(0))
        for lo, hi in steps(texts):
            ids, _ = _ids(texts[lo:hi], buckets)
            for a in range(WINDOW, len(ids) - WINDOW, 1 << 18):
                b = min(a + (1 << 18), len(ids) - WINDOW)
                near = sum(index[ids[a + k : b + k]] for k in range(-WINDOW, WINDOW + 1) if k)
                order = np.argsort(ids[a:b], kind="stable")
                own = ids[a:b][order]
                starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
                total[own[starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)

    found = gather(docs.select(F.col(text).cast("string").alias("text")), {"sum": Spec((BUCKETS, DIM))}, count)["sum"].astype(np.float64)
    found[0] = 0
    return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, buckets: _Buckets) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors, how alike words 1 to 3 apart are, and the logarithm of its length."""
    out = np.zeros((len(texts), 2 * DIM + 4))
    for lo, hi in steps(texts, 1 << 20):
        ids, begins = _ids(texts[lo:hi], buckets)
        ends = np.r_[begins[1:], len(ids)] - WINDOW
        for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            if b > a:
                v = vectors[ids[a:b]]
                mean = v.mean(axis=0, dtype=np.float64)
                square = np.einsum("ij,ij->j", v, v, dtype=np.float64) / (b - a)
                alike = [np.einsum("ij,ij->", v[k:], v[:-k], dtype=np.float64) / (b - a - k) if b - a > k else 0.0 for k in (1, 2, 3)]
                out[lo + i] = np.r_[mean, np.sqrt(np.maximum(square - mean * mean, 0)), alike, np.log1p(b - a)]
    return out


class Network:
    """Standardised inputs, one hidden layer of tanh, one logistic output; Adam on cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 80, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(rounds):
            order = rng.permutation(len(z))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
                dh = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[at].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least cross-entropy on rows that were not trained on."""
        z = self.logit(x)
        loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
        self.temperature = min(np.geomspace(0.25, 16, 97), key=loss)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", most_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Word vectors come from random indexing over *all* texts, in a table of fixed size; each whole text
    is pooled to its vectors' mean and spread.  A two-layer network is trained on at most
    ``most_rows`` labelled rows outside fold 0; fold 1 of these sets its temperature instead.

    Null and empty texts have pooled vector 0 and a score all the same; a very long text is pooled whole.  Without labels of both
    classes every score is 1.  Repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, text, id_col, most_rows)
    vectors = word_vectors(docs, text)
    held = spark.sparkContext.broadcast(vectors)

    def features(batches):
        buckets = _Buckets()
        for b in batches:
            f = pooled(texts_of(b.column(2)), held.value, buckets)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(f))], names=["y", "fold", "x"])

    seen = sample.select(F.col("y").cast("long").alias("y"), "fold", "text").mapInArrow(features, "y long, fold long, x array<double>").toPandas()
    x, y, fold = np.array(seen["x"].tolist()).reshape(len(seen), 2 * DIM + 4), seen["y"].to_numpy().astype(float), seen["fold"].to_numpy()
    model = None
    if len(set(y[fold != 1])) == 2:
        model = Network(x[fold != 1], y[fold != 1])
        if (fold == 1).any():
            model.calibrate(x[fold == 1], y[fold == 1])
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        buckets = _Buckets()
        for b in batches:
            f = pooled(texts_of(b.column(1)), held.value, buckets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ones(len(f)) if sent.value is None else sent.value.score(f), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
