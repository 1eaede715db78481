"""Language ID by a bidirectional gated recurrent network over bytes.

Two GRUs read a window of bytes from both ends; at every position a softmax over both
states labels the byte, and a document's probabilities are those of its positions, pooled.
The network is trained here, in numpy, by backpropagation through time. A text is read
whole, in windows of `WINDOW` bytes in which the state starts anew, so the windows of many
documents advance together as one matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, small_batches

#: Bytes in a window.
WINDOW = 64
HIDDEN, EMBED = 6, 8
#: The bounded sample of labelled rows that the network learns from, and what is read of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 4
STEPS, BATCH, RATE, SEED = 150, 96, 0.03, 7
#: Values of the hash that a sample is drawn by.
HASHES = 1 << 40
#: Windows that advance together.
TOGETHER = 4096
LETTER = re.compile(r"[^\W\d_]")


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): shaped like tanh, and numpy computes it seven times as fast; its slope is (1 - |y|)^2.

    Candidates are squash(x), gates (1 + squash(x)) / 2.
    """
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


class Network:
    """Weights of both directions: E byte embeddings; W, U, b of the gates z, r and the candidate; V, c on top."""

    def __init__(self, labels: list[str], rng: np.random.Generator):
        self.labels, h, e, k = labels, HIDDEN, EMBED, len(labels)
        self.p = {"E": rng.normal(0, 0.5, (256, e)), "V": rng.normal(0, 0.3, (2 * h, k)), "c": np.zeros(k)}
        for d in "fb":
            self.p |= {f"W{d}": rng.normal(0, 0.4, (e, 3 * h)), f"U{d}": rng.normal(0, 0.3, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the mean cross-entropy of all positions; x (n, WINDOW) bytes, y (n,) labels."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, STEPS + 1):
            at = rng.integers(0, len(x), BATCH)
            for k, g in self.gradients(x[at], mask[at], y[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                rate = RATE * min(1.0, 2 * (1 - t / (STEPS + 1)))
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time, both directions. Masked positions keep the state and carry no loss."""
        p, h, (n, length) = self.p, HIDDEN, x.shape
        emb = p["E"][x]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        state, kept = np.zeros((n, length, 2 * h)), {}
        for d, order, at in (("f", range(length), 0), ("b", range(length - 1, -1, -1), h)):
            inp, now = emb @ p[f"W{d}"] + p[f"b{d}"], np.zeros((n, h))
            for t in order:
                a, u = inp[:, t], now @ p[f"U{d}"][:, : 2 * h]
                zs, rs = squash(a[:, :h] + u[:, :h]), squash(a[:, h : 2 * h] + u[:, h:])
                r = (1 + rs) / 2
                c = squash(a[:, 2 * h :] + (r * now) @ p[f"U{d}"][:, 2 * h :])
                z = np.where(mask[:, t, None], (1 + zs) / 2, 0.0)
                kept[d, t] = (now, z, r, c, zs, rs)
                now = (1 - z) * now + z * c
                state[:, t, at : at + h] = now
        logits = state @ p["V"] + p["c"]
        prob = np.exp(logits - logits.max(2, keepdims=True))
        prob /= prob.sum(2, keepdims=True)
        prob[np.arange(n)[:, None], np.arange(length)[None, :], y[:, None]] -= 1
        dl = prob * mask[:, :, None] / max(1, mask.sum())
        g["V"], g["c"] = state.reshape(-1, 2 * h).T @ dl.reshape(-1, dl.shape[2]), dl.sum((0, 1))
        ds, demb = dl @ p["V"].T, np.zeros_like(emb)
        for d, order, at in (("f", range(length - 1, -1, -1), 0), ("b", range(length), h)):
            u, w, dh = p[f"U{d}"], p[f"W{d}"], np.zeros((n, h))
            for t in order:
                now, z, r, c, zs, rs = kept[d, t]
                dh = dh + ds[:, t, at : at + h]
                dc = dh * z * slope(c)
                dz = np.where(mask[:, t, None], dh * (c - now) * slope(zs) / 2, 0.0)
                drn = dc @ u[:, 2 * h :].T
                dr = drn * now * slope(rs) / 2
                da = np.concatenate([dz, dr, dc], 1)
                g[f"W{d}"] += emb[:, t].T @ da
                g[f"b{d}"] += da.sum(0)
                g[f"U{d}"][:, : 2 * h] += now.T @ da[:, : 2 * h]
                g[f"U{d}"][:, 2 * h :] += (r * now).T @ dc
                demb[:, t] += da @ w.T
                dh = dh * (1 - z) + drn * r + da[:, : 2 * h] @ u[:, : 2 * h].T
        np.add.at(g["E"], x, demb)
        return g

    def frozen(self) -> dict[str, np.ndarray]:
        """For prediction, in single precision: what each byte gives to the gates, and the recurrent weights."""
        out = {k: self.p[k].astype(np.float32) for k in ("V", "c", "Uf", "Ub")}
        return out | {f"T{d}": (self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]).astype(np.float32) for d in "fb"}


def position_probabilities(net: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the label probabilities over each window's positions.

    x is (WINDOW, n); a window shorter than WINDOW is filled up at its end, and its
    backward pass starts where it ends.
    """
    h, (length, n) = HIDDEN, x.shape
    short = int(lengths.min()) if n else 0
    logits = np.repeat(net["c"][:, None], length * n, 1)
    z, r, c, part = (np.empty((n, h), np.float32) for _ in range(4))
    for d, order, at in (("f", range(length), 0), ("b", range(length - 1, -1, -1), h)):
        # each gate by itself, so that all arrays are contiguous
        (t_z, t_r, t_c), (u_z, u_r, u_c) = ([np.ascontiguousarray(m[:, i * h : i * h + h]) for i in range(3)] for m in (net[f"T{d}"], net[f"U{d}"]))
        half_c = u_c / 2
        states = np.empty((length, n, h), np.float32)
        now = np.zeros((n, h), np.float32)
        for t in order:
            for gate, table, u in ((z, t_z, u_z), (r, t_r, u_r)):
                np.matmul(now, u, out=gate)
                gate += np.take(table, x[t], axis=0, out=part, mode="clip")
                gate /= np.add(np.abs(gate, out=part), 1, out=part)
                gate += 1  # twice the gate; the halves follow
            r *= now
            np.matmul(r, half_c, out=c)
            c += np.take(t_c, x[t], axis=0, out=part, mode="clip")
            c /= np.add(np.abs(c, out=part), 1, out=part)
            c -= now
            c *= z
            c *= 0.5
            if t >= short:
                c[t >= lengths] = 0
            now = np.add(now, c, out=states[t])
        logits += np.ascontiguousarray(net["V"][at : at + h].T) @ states.reshape(-1, h).T
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    prob = logits.reshape(-1, length, n)
    if short < length:
        prob *= np.arange(length)[:, None] < lengths[None, :]
    return prob.sum(1, dtype=np.float64).T


def windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: bytes (n, WINDOW), lengths, and the text that each is from."""
    counts = np.array([-(-len(b) // WINDOW) for b in bodies], np.int64)
    flat = np.frombuffer(b"".join(b.ljust(c * WINDOW, b" ") for b, c in zip(bodies, counts.tolist(), strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(bodies)), counts)
    left = np.array([len(b) for b in bodies], np.int64)[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    return flat.reshape(-1, WINDOW), np.minimum(left, WINDOW), owner


def pooled(net: dict[str, np.ndarray], bodies: list[bytes], k: int) -> np.ndarray:
    """The mean label probabilities of each text's positions."""
    x, lengths, owner = windows(bodies)
    order = np.argsort(lengths, kind="stable")  # the full windows, which need no mask, together
    x, lengths, owner = x[order], lengths[order], owner[order]
    total = np.zeros((len(bodies), k))
    for i in range(0, len(x), TOGETHER):
        part = position_probabilities(net, x[i : i + TOGETHER].T.astype(np.intp), lengths[i : i + TOGETHER])
        for j in range(k):
            total[:, j] += np.bincount(owner[i : i + TOGETHER], part[:, j], len(bodies))
    return total / np.maximum(1, [[len(b)] for b in bodies])


def _cuts(spark: SparkSession, cuts: list, kind: T.DataType) -> DataFrame:
    return spark.createDataFrame(cuts, T.StructType([T.StructField("label", kind), T.StructField("cut", T.LongType())]))


def fit(labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Trains on a bounded sample of (id, text, label): `sample_docs` rows by the hash of
    their id, evenly over the labels where there are enough, and of each SAMPLE_WINDOWS
    windows at places spread over its whole text. None where there is nothing to learn from.
    """
    rows = labelled.filter("text is not null and label is not null and length(text) > 0")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return None
    body, at = F.col("text").cast("binary"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(HASHES))
    part = [F.substring(body, (F.pmod(F.xxhash64("id", F.lit(SEED + 1 + i)), F.greatest(F.lit(1), F.length(body) - WINDOW + 1)) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    # one scan serves all labels: of each, the rows below a hash that some more than are wanted reach
    each = max(1, sample_docs // len(labels))
    cuts = [(x, min(HASHES, int(HASHES * (each + 6 * each**0.5 + 20) / n) + 1)) for x, n in counts.items()]
    cut = _cuts(labelled.sparkSession, cuts, rows.schema["label"].dataType)
    chosen = rows.withColumn("h", at).join(F.broadcast(cut), "label").filter("h < cut").select("label", "id", "h", F.array(*part).alias("parts"))
    sample, taken = [], dict.fromkeys(labels, 0)
    for r in sorted(chosen.collect(), key=lambda r: (r.h, r.id)):
        if taken[r.label] < each:
            taken[r.label] += 1
            sample.append(r)
    code = {x: i for i, x in enumerate(labels)}
    parts = [(bytes(x), code[r.label]) for r in sample for x in r.parts if len(x)]
    x, lengths, owner = windows([b for b, _ in parts])
    y = np.array([c for _, c in parts])[owner]
    rng = np.random.default_rng(SEED)
    net = Network(labels, rng)
    if len(labels) > 1:
        net.train(x, np.arange(WINDOW)[None, :] < lengths[:, None], y, rng)
    return net


def predict(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each document: the label of the highest pooled probability.

    `und` with score 0 where the text is null, has no letter, or there is no network. The
    first label in order wins ties. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = Shared(docs.sparkSession, (net.frozen(), net.labels) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen, labels = model.value or ({}, [])
        for batch in batches:
            size = max(1, batch.num_rows)
            step = min(size, 1024)
            for i in range(0, batch.num_rows, step):
                texts = batch.column(1).slice(i, step).to_pylist()
                good = [k for k, t in enumerate(texts) if labels and t and LETTER.search(t)]
                name, score = ["und"] * len(texts), [0.0] * len(texts)
                if good:
                    p = pooled(frozen, [texts[k].encode() for k in good], len(labels))
                    for k, row, best in zip(good, p, p.argmax(1).tolist(), strict=True):
                        name[k], score[k] = labels[best], min(1.0, float(row[best]))
                yield pa.record_batch([batch.column(0).slice(i, step), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, held: int = 2, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows outside the held-out fold, predicts all.

    A row is held out where crc32 of its id as text leaves `held` of `folds`.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    net = fit(docs.filter(~out).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")), sample_docs=sample_docs)
    found = predict(docs, net, id_col=id_col, text_col=text_col)
    return found.select("id", F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
