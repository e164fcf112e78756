"""Document quality by a byte-level convolutional network, trained and applied with numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk;
their responses are max-pooled within the chunk, and the chunks' pooled vectors are combined (mean and maximum) into
one logistic score. Besides the byte itself a filter sees one more input at each place: how far back the same eight
bytes last occurred in the chunk, so that repetition is visible to a local filter.

Training takes a bounded sample of rows: up to ``TRAIN_DOCS`` labelled documents, those with the smallest hashed ids of
each class, as many of them as have ``TRAIN_BYTES`` together. Their texts are whole, as are all texts that are scored.

Defined results: null and empty texts are one empty chunk and get the score the network gives that; rows with a null
id or label, and labels without a document, teach nothing; with fewer than two classes among the labels every score is
the share of label 1 (0.5 without labels); an empty table gives an empty result; texts of any length are worked off
a block of chunks at a time; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices
from .words import text_buffer

CHUNK, STEP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 8, 32
PAD, BACK = 256, 8
TRAIN_DOCS, TRAIN_BYTES, ROUNDS, LEAST_STEPS, BATCH = 3000, 24 << 20, 10, 500, 32
THRESHOLD = 0.3
BLOCK = 512


@dataclass
class Network:
    """The weights: byte and distance embeddings, filters, and the logistic layer over pooled responses."""

    emb: np.ndarray
    back: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None


def _distance(chunks: np.ndarray) -> np.ndarray:
    """For each place of each chunk the class (0 none, else 1 + log2) of the distance to the same 8 bytes before it."""
    n, c = chunks.shape
    x = chunks.astype(np.uint64)
    gram = np.zeros((n, c - 7), np.uint64)
    for j in range(8):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + x[:, j : j + c - 7]
    order = np.argsort(gram, axis=1, kind="stable")
    ranked = np.take_along_axis(gram, order, 1)
    gap = np.diff(order, axis=1)
    gap[ranked[:, 1:] != ranked[:, :-1]] = 0
    out = np.zeros((n, c), np.uint8)
    level = np.where(gap > 0, np.minimum(1 + np.log2(np.maximum(gap, 1)).astype(np.int64), BACK - 1), 0).astype(np.uint8)
    np.put_along_axis(out, order[:, 1:], level, 1)
    out[chunks == PAD] = 0
    return out


def _windows(net: Network, chunks: np.ndarray, far: np.ndarray) -> np.ndarray:
    """What the filters see at each of their places."""
    x = net.emb[chunks] + net.back[far]
    n, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, places, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2]))


def _pool(net: Network, chunks: np.ndarray) -> np.ndarray:
    """A product for each chunk, so that its rounding does not depend on its neighbours."""
    r = np.ascontiguousarray(_windows(net, chunks, _distance(chunks))) @ net.filters
    return np.maximum(r.max(1) + net.bias, 0)


def chunk_starts(length: int) -> np.ndarray:
    """Starts of the overlapping chunks that cover ``length`` bytes; one even for none."""
    return np.arange(max(1, -(-(length - (CHUNK - STEP)) // STEP))) * STEP


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    own = buf[np.where(inside, at, 0)].astype(np.int16) if len(buf) else np.zeros(at.shape, np.int16)  # wide enough for PAD
    return np.where(inside, own, np.int16(PAD))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """One probability for each row, over all its bytes, a block of chunks at a time."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    buf, offsets = text_buffer(texts)
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-(lengths - (CHUNK - STEP)) // STEP))
    last = np.cumsum(n)
    total, top = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS))
    for a in range(0, int(last[-1]) if len(last) else 0, BLOCK):
        ids = np.arange(a, min(a + BLOCK, last[-1]))
        row = np.searchsorted(last, ids, "right")
        starts = offsets[row] + (ids - (last - n)[row]) * STEP
        pooled = _pool(net, _cut(buf, starts, offsets[row + 1]))
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[first]] += np.add.reduceat(pooled, first, 0)
        top[row[first]] = np.maximum(top[row[first]], np.maximum.reduceat(pooled, first, 0))
    return _sigmoid((np.hstack([total / n[:, None], top]) * net.out).sum(1) + net.out_bias)


def train(texts: list[str], labels: list[int], seed: int = 7, rounds: int | None = None) -> Network:
    """Fits the network by Adam on cross-entropy, classes weighted alike within limits; the same rows give the same weights.

    It sees all rows ``ROUNDS`` times, or as often as it takes for ``LEAST_STEPS`` steps.
    """
    rounds = rounds or max(ROUNDS, -(-LEAST_STEPS * BATCH // max(1, len(texts))))
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.3, (PAD + 1, EMBED)).astype(np.float32),
        rng.normal(0, 0.3, (BACK, EMBED)).astype(np.float32),
        (rng.normal(0, 1, (WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS),
        0.0,
    )
    net.emb[PAD] = net.back[0] = 0
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    docs = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        s = chunk_starts(len(raw))
        chunks = _cut(raw, s, np.full(len(s), len(raw)))
        docs.append((chunks, np.concatenate([_distance(chunks[a : a + BLOCK]) for a in range(0, len(chunks), BLOCK)])))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    names = ("emb", "back", "filters", "bias", "out", "out_bias")
    moments = {k: [np.zeros_like(getattr(net, k), float), np.zeros_like(getattr(net, k), float)] for k in names}
    step, batch = 0, BATCH
    for turn in range(rounds):
        order = rng.permutation(len(docs))
        rate = 0.006 * (1 - turn / rounds) + 0.0005
        for a in range(0, len(order), batch):
            ids = order[a : a + batch]
            chunks, far = (np.concatenate([docs[i][j] for i in ids]) for j in (0, 1))
            row = np.repeat(np.arange(len(ids)), [len(docs[i][0]) for i in ids])
            count = np.bincount(row)
            n, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
            blocks = [slice(at, at + BLOCK) for at in range(0, n, BLOCK)]
            best, pooled, flat = np.zeros((n, FILTERS), np.int64), np.zeros((n, FILTERS), np.float32), None
            for part in blocks:
                win = _windows(net, chunks[part], far[part])
                flat = win.reshape(-1, win.shape[2])
                r = (flat @ net.filters).reshape(-1, places, FILTERS)
                best[part] = r.argmax(1)
                pooled[part] = np.maximum(np.take_along_axis(r, best[part][:, None], 1)[:, 0] + net.bias, 0)
            first = np.r_[0, np.cumsum(count)[:-1]]
            mean, top = np.add.reduceat(pooled, first, 0) / count[:, None], np.maximum.reduceat(pooled, first, 0)
            feats = np.hstack([mean, top])
            d = (_sigmoid(feats @ net.out + net.out_bias) - y[ids]) * weight[ids] / len(ids)
            grads = {"out": feats.T @ d + 1e-5 * net.out, "out_bias": d.sum()}
            g = d[:, None] * net.out
            gp = g[row, :FILTERS] / count[row, None] + g[row, FILTERS:] * (pooled == top[row])
            gp *= pooled > 0
            grads["bias"] = gp.sum(0)
            grads |= {"filters": np.zeros(net.filters.shape), "emb": np.zeros(net.emb.shape), "back": np.zeros(net.back.shape)}
            for part in blocks:
                own, k = best[part], net.filters.shape[0]
                if len(blocks) > 1:
                    flat = _windows(net, chunks[part], far[part]).reshape(-1, k)
                at = (np.arange(len(own))[:, None] * places + own).ravel()
                grads["filters"] += np.einsum("nfk,nf->kf", flat[at].reshape(len(own), FILTERS, k), gp[part])
                back = (gp[part][:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBED)
                where = (own[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(-1, WIDTH)
                who = np.repeat(np.arange(len(own)), FILTERS)[:, None]
                for name, index in (("emb", chunks[part][who, where]), ("back", far[part][who, where])):
                    size = len(getattr(net, name))
                    grads[name] += np.stack([np.bincount(index.ravel(), back[:, :, e].ravel(), size) for e in range(EMBED)], 1)
            grads["emb"][PAD] = grads["back"][0] = 0
            step += 1
            for name in names:
                m, v = moments[name]
                m += 0.1 * (grads[name] - m)
                v += 0.001 * (grads[name] ** 2 - v)
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, float(net.out_bias - move) if name == "out_bias" else (getattr(net, name) - move).astype(getattr(net, name).dtype))
    return net


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """The bounded sample: up to ``most`` labelled rows outside the held-out fold, up to half of them of each class.

    Of these only as many are taken, in the order of their hashed ids, as have ``size`` bytes together, at least one of
    each class. Their texts are whole.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id")).select("doc_id", "quality").distinct()
    own = own.withColumn("h", F.xxhash64("doc_id"))
    picked = own.where("quality = 0").orderBy("h", "doc_id").limit(most // 2)
    picked = picked.unionAll(own.where("quality = 1").orderBy("h", "doc_id").limit(most // 2))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(picked), "doc_id")  # at most `most` labels
    sizes = rows.groupBy("doc_id", "quality", "h").agg(F.max("n").alias("n")).collect()
    left, taken = {0: size // 2, 1: size // 2}, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if left[r.quality] >= r.n or left[r.quality] == size // 2:
            taken.append((r.doc_id, r.quality))
            left[r.quality] -= r.n
        else:
            left[r.quality] = -1
    taken = documents.sparkSession.createDataFrame(taken, T.StructType([documents.schema["doc_id"], T.StructField("quality", T.IntegerType())]))
    rows = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text))
    return [r.text for r in rows], [r.quality for r in rows]


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Network:
    return train(*training_rows(documents, labels, most))


def score(df: DataFrame, net: Network, text_col: str, score_col: str) -> DataFrame:
    """``df`` with the score of each whole text added as ``score_col``."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, at, 8 << 20)):
            scores = pa.array(score_texts(shared.value, b.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*[f"c{i}" for i in range(b.num_columns)], "score"])
        release()

    names = [*df.columns, score_col]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)] + [T.StructField("score", T.DoubleType())])
    return df.mapInArrow(run, inner).toDF(*names)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    net = fit(documents, labels)
    scored = score(documents.select("doc_id", "text"), net, "text", "score")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject, with their columns."""
    from .common import fresh

    name = fresh(documents, "score")
    return score(documents, fit(documents, labels), "text", name).where(F.col(name) >= THRESHOLD).drop(name)
