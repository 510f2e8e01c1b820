"""Language identification by a bidirectional gated recurrent network over bytes.

A GRU reads a text's bytes forwards, another backwards; both states together label every
position, and the positions' probabilities are averaged into the document's. It is trained here,
in numpy, by backpropagation through time, on windows cut from a bounded sample of labelled
documents. Prediction reads whole texts: they are cut into segments of SEGMENT bytes, each with
CONTEXT bytes more on either side to warm the states up, as many as a window of the training has,
and all segments of a batch run side by side, so the work is a fixed number of steps over wide arrays.
A text is read as if at least CONTEXT spaces stood before and after it.

Defined results: a null text, or one with no letter, is `und` with score 0; so is every text
if no labelled row exists. Positions that hold no letter of any alphabet (ASCII other than
A-Z and a-z) are labelled but not pooled. Of equal probabilities the first language by name wins.
Repeated rows are predicted alike. Only text and lang are read, lang only to train; rows with a null
lang are not learned, an empty name is a name. Other columns are passed along; columns of the input
named lang_pred or score give way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

#: Bounds of the training sample: documents of each language, windows of each document, bytes of each window.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 256, 4, 64
#: Windows of fewer bytes teach only languages that have no others.
SHORT = 8
#: STEPS are for up to LANGS languages; more take more, in proportion.
HIDDEN, STEPS, LANGS, BATCH, RATE, SEED = 8, 256, 4, 256, 0.02, 7
SEGMENT, CONTEXT, LANES = 448, 64, 1024


def softsign(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place; it takes the place of tanh, at a fifth of its time in numpy."""
    np.abs(x, out=room)
    room += 1
    x /= room


class Gru:
    """One direction: h = (1 - z) h + z s(c + r (U h)), gates and candidate from the byte's column of table.

    s is the softsign, the gates z and r are (1 + s) / 2.
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.table = rng.normal(0, 0.5, (3 * hidden, 256)).astype("f4")
        self.inner = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype("f4")

    def run(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, hidden, lanes) after each row of data (steps, lanes)."""
        n, (steps, lanes) = self.inner.shape[1], data.shape
        h = np.zeros((n, lanes), "f4")
        out = np.empty((steps, n, lanes), "f4")
        gates, inner, room = (np.empty((3 * n, lanes), "f4") for _ in range(3))
        for t in range(steps):
            np.take(self.table, data[t], axis=1, out=gates, mode="clip")
            np.matmul(self.inner, h, out=inner)
            zr, c = gates[: 2 * n], gates[2 * n :]
            zr += inner[: 2 * n]
            softsign(zr, room[: 2 * n])
            zr *= 0.5
            zr += 0.5
            if keep is not None:
                keep.append((h.copy(), zr.copy(), inner[2 * n :].copy()))
            inner[2 * n :] *= zr[n:]
            c += inner[2 * n :]
            softsign(c, room[2 * n :])
            if keep is not None:
                keep[-1] += (c.copy(),)
            c -= h
            c *= zr[:n]
            h = np.add(h, c, out=out[t])
        return out

    def back(self, data: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and inner, from those of the states, by going back through time."""
        n = self.inner.shape[1]
        d_table, d_inner = np.zeros_like(self.table.T), np.zeros_like(self.inner)
        dh = np.zeros_like(grad[0])
        for t in range(len(keep) - 1, -1, -1):
            h, zr, u, c = keep[t]
            z, r = zr[:n], zr[n:]
            dh = dh + grad[t]
            dc = dh * z * (1 - np.abs(c)) ** 2
            dz = dh * (c - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            direct = np.concatenate([dz, dr, dc])
            through = np.concatenate([dz, dr, dc * r])
            np.add.at(d_table, data[t], direct.T)
            d_inner += through @ h.T
            dh = dh * (1 - z) + self.inner.T @ through
        return d_table.T, d_inner


class ByteLabeller:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.forward, self.backward = Gru(hidden, rng), Gru(hidden, rng)
        self.out = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype("f4")
        self.bias = np.zeros((len(langs), 1), "f4")

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.inner, self.backward.table, self.backward.inner, self.out, self.bias]

    def label(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Probabilities (steps, langs, lanes) from the states (steps, hidden, lanes) of both directions."""
        n = ahead.shape[1]
        scores = np.matmul(np.ascontiguousarray(self.out[:, :n]), ahead)
        scores += np.matmul(np.ascontiguousarray(self.out[:, n:]), behind)
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def train(self, data: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """data (samples, steps) of bytes, target (samples,) of languages: cross-entropy at every position, Adam.

        The number of steps does not depend on the sample; languages are drawn alike, however many windows they have.
        """
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        chance = 1 / np.maximum(np.bincount(target), 1)[target]
        chance /= chance.sum()
        for count in range(1, steps + 1):
            rows = rng.choice(len(data), batch, p=chance)
            x, y = np.ascontiguousarray(data[rows].T), target[rows]
            kept_f, kept_b = [], []
            f = self.forward.run(x, kept_f)
            b = self.backward.run(x[::-1], kept_b)[::-1]
            both = np.concatenate([f, b], axis=1)
            error = self.label(f, b)
            error[:, y, np.arange(len(rows))] -= 1
            error /= error.shape[0] * error.shape[2]
            d_out = np.einsum("tlb,tsb->ls", error, both)
            d_bias = error.sum((0, 2))[:, None]
            grad = np.matmul(self.out.T, error)
            n = self.forward.inner.shape[1]
            grads = [*self.forward.back(x, kept_f, grad[:, :n]), *self.backward.back(x[::-1], kept_b, grad[::-1, n:]), d_out, d_bias]
            step = rate * (1 - count / (steps + 1))
            for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-7)

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, langs) over the positions that hold letters."""
        pooled = np.zeros((len(texts), len(self.langs)), "f8")
        weight = np.zeros(len(texts), "f8")
        lanes: list[tuple[int, int, int]] = []
        for k, text in enumerate(texts):
            lanes += [(k, at, min(at + SEGMENT, len(text))) for at in range(0, len(text), SEGMENT)]
        for lo in range(0, len(lanes), LANES):
            self._segments(texts, lanes[lo : lo + LANES], pooled, weight)
        return pooled / np.maximum(weight, 1)[:, None]

    def _segments(self, texts: list[bytes], lanes: list[tuple[int, int, int]], pooled: np.ndarray, weight: np.ndarray) -> None:
        width = SEGMENT + 2 * CONTEXT
        data = np.full((len(lanes), width), 32, "u1")
        counted = np.zeros((len(lanes), width), bool)
        for i, (k, a, b) in enumerate(lanes):
            begin, end = max(0, a - CONTEXT), min(len(texts[k]), b + CONTEXT)
            at = CONTEXT - (a - begin)
            data[i, at : at + end - begin] = np.frombuffer(texts[k], "u1", end - begin, begin)
            counted[i, CONTEXT : CONTEXT + b - a] = True
        counted &= LETTER[data]
        x, use = np.ascontiguousarray(data.T).astype(np.intp), np.ascontiguousarray(counted.T)
        inside = slice(CONTEXT, CONTEXT + SEGMENT)
        found = self.label(self.forward.run(x)[inside], self.backward.run(x[::-1])[::-1][inside])
        use = use[CONTEXT : CONTEXT + SEGMENT].astype("f4")
        sums = np.einsum("tlb,tb->bl", found, use)
        owner = np.array([k for k, _, _ in lanes])
        np.add.at(pooled, owner, sums)
        np.add.at(weight, owner, use.sum(0))


LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def sample(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_windows: int = SAMPLE_WINDOWS, window: int = WINDOW) -> list[tuple[str, list[bytes]]]:
    """Windows of labelled texts: for each language one document of each of n_docs hash buckets at most.

    The documents are named by a minimum that Spark takes before the shuffle, so a language with
    most of the rows is no hot group; they alone are read again, and only their windows reach the driver.
    """
    labelled = docs.filter("lang IS NOT NULL AND coalesce(text, '') <> ''").withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = cut(labelled.groupBy("lang", F.pmod("h", F.lit(n_docs)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h"))
    rows = labelled.join(broadcast_if_small(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # n_docs rows of each language at most
    size = F.length("text")
    begins = [F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(size - window, F.lit(1))).cast("int") + 1 for i in range(n_windows)]
    taken = rows.select("lang", "h", F.array(*[F.encode(F.substring("text", b, F.lit(window)), "utf-8") for b in begins]).alias("windows"))
    return [(r.lang, [bytes(w) for w in r.windows]) for r in sorted(taken.collect(), key=lambda r: (r.lang, r.h))]


def fit(docs: DataFrame, **options) -> ByteLabeller | None:
    """A labeller from docs (text, lang), or None if nothing with a letter is labelled."""
    found = sample(docs, **options)
    langs = sorted({lang for lang, _ in found})
    if not langs:
        return None
    pieces = [(w[:WINDOW], lang) for lang, windows in found for w in windows if len(w) >= SHORT]
    taught = {lang for _, lang in pieces}
    # A language that has no longer text is learned from its short ones, said over and over.
    pieces += [(((w + b" ") * WINDOW)[:WINDOW], lang) for lang, windows in found if lang not in taught for w in windows if LETTER[list(w)].any()]
    if not pieces:
        return None
    data = np.full((len(pieces), WINDOW), 32, "u1")
    for i, (w, _) in enumerate(pieces):
        data[i, : len(w)] = np.frombuffer(w, "u1")
    model = ByteLabeller(langs)
    model.train(data.astype(np.intp), np.array([langs.index(lang) for _, lang in pieces]), steps=STEPS * max(1, -(-len(langs) // LANGS)))
    return model


def predict(docs: DataFrame, model: ByteLabeller | None, group_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text), and other columns that are passed along."""
    others = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    lettered = "_lettered"
    while lettered in docs.columns:
        lettered += "_"
    source = docs.select(*[f"`{f.name}`" for f in others], F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).rlike(r"\p{L}").alias(lettered))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for pdf in batches:
            names, scores = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            todo = np.flatnonzero(pdf[lettered].to_numpy(bool)) if net else []
            group, size = [], 0

            def flush(group: list, names=names, scores=scores) -> None:
                pooled = net.pool([t for _, t in group])
                best = pooled.argmax(1)
                for (i, _), k, p in zip(group, best, pooled, strict=True):
                    names[i], scores[i] = net.langs[k], min(1.0, max(0.0, float(p[k])))

            texts = pdf["text"]
            for i in todo:
                raw = texts.iloc[i].encode("utf-8", "surrogatepass")
                group.append((i, raw))
                size += len(raw)
                if size >= group_bytes:
                    flush(group)
                    group, size = [], 0
            if group:
                flush(group)
            yield pdf.drop(columns=["text", lettered]).assign(lang_pred=names, score=scores)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return source.mapInPandas(task, f"{kept}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), "text")
    found = predict(keyed, model).withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
