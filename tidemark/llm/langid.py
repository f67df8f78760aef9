"""Language identification by a byte convolutional network.

Bytes fall into about a hundred classes.  Filters of widths 2, 3 and 4 slide over
the classes of a window, each keeps its maximum over the window, and a softmax
layer turns the maxima into languages.  A whole text is read in windows of a fixed
length, which overlap so that no place of a filter is lost; a text's language is
that of the mean of its windows' probabilities, weighted by their letters.

A filter's weights are a table by place and class, so its response is a sum of
table rows; at prediction, the tables of two neighbouring bytes are added up
beforehand.  Training is numpy alone, on windows of a bounded sample of labelled
texts: max pooling sends the gradient of a filter to the classes of one place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_arrow

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 16, 128
STRIDE = LENGTH - max(WIDTHS) + 1
#: The sample: documents of each language at most, documents of all languages (but for one of each), and windows of each document.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_WINDOWS = 600, 60_000, 4
EPOCHS, BATCH, RATE = 14, 256, 0.01


def _classes() -> tuple[np.ndarray, int]:
    """Class of each byte: 0 pads; white space, digits, other signs; letters without case; each continuation byte; leading bytes by length."""
    cls = np.full(256, 3, np.uint8)
    cls[[9, 10, 11, 12, 13, 32]] = 1
    cls[48:58] = 2
    for i in range(26):
        cls[65 + i] = cls[97 + i] = 4 + i
    cls[128:192] = 30 + np.arange(64)
    cls[192:196], cls[196:200], cls[200:208], cls[208:212], cls[212:224], cls[224:240], cls[240:] = 94, 95, 96, 97, 98, 99, 100
    return cls, 101


CLASS, K = _classes()


@dataclass
class Network:
    """filters: of each width, (width, K, FILTERS); dense: (len(WIDTHS) * FILTERS + 1, languages), the last row the bias."""

    filters: list[np.ndarray]
    dense: np.ndarray
    languages: list[str]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a pair of neighbouring bytes adds to all filters, and later bytes to those of widths 3 and 4."""
        two, three, four = self.filters
        pair = np.concatenate([x[0][:, None] + x[1][None] for x in (two, three, four)], 2).reshape(K * K, -1).astype(np.float32)
        return pair, three[2].astype(np.float32), (four[2][:, None] + four[3][None]).reshape(K * K, -1).astype(np.float32)

    def pooled(self, windows: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """The maxima of all filters over each window; windows: (n, LENGTH) classes, 0 past the end."""
        pair, third, rest = tables
        by_place = np.ascontiguousarray(windows.T).astype(np.int32)
        pairs = by_place[:-1] * K + by_place[1:]
        best = np.full((windows.shape[0], pair.shape[1]), -np.inf, np.float32)
        a, b = FILTERS, 2 * FILTERS
        for t in range(LENGTH - max(WIDTHS) + 1):
            got = pair.take(pairs[t], 0)
            got[:, a:b] += third.take(by_place[t + 2], 0)
            got[:, b:] += rest.take(pairs[t + 2], 0)
            np.maximum(best, got, out=best)
        return best

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense[:-1] + self.dense[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes."""
    cls = CLASS[np.frombuffer(raw, np.uint8)]
    n = max(1, -(-(len(cls) - LENGTH) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + LENGTH, np.uint8)
    padded[: len(cls)] = cls
    return np.lib.stride_tricks.as_strided(padded, (n, LENGTH), (STRIDE, 1))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 4) -> Network:
    """Adam on the cross entropy; windows: (n, LENGTH) classes."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (w, K, FILTERS)) for w in WIDTHS]
    for w in weights:
        w[:, 0] = 0  # padding adds nothing, to begin with
    net = Network(weights, rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(languages))), languages)
    params = [*net.filters, net.dense]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, last = 0, LENGTH - max(WIDTHS) + 1
    share = np.bincount(labels, minlength=len(languages)) / max(1, len(labels))
    weigh = 1 / np.maximum(share, 1e-9) / max(1, (share > 0).sum())
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x, y = windows[some].astype(np.int64), labels[some]
            n = len(some)
            maxima, places = [], []
            for w, f in zip(WIDTHS, net.filters, strict=True):
                z = sum(f[j].astype(np.float32)[x[:, j : j + last]] for j in range(w))  # (n, last, FILTERS)
                place = z.argmax(1)
                maxima.append(np.take_along_axis(z, place[:, None], 1)[:, 0])
                places.append(place)
            pooled = np.concatenate(maxima, 1).astype(np.float64)
            p = net.probabilities(pooled)
            p[np.arange(n), y] -= 1
            p *= (weigh[y] / n)[:, None]
            hidden = np.maximum(pooled, 0)
            grads = [np.empty_like(f) for f in net.filters]
            back = (p @ net.dense[:-1].T) * (pooled > 0)
            rows, cols = np.repeat(np.arange(n), FILTERS), np.tile(np.arange(FILTERS), n)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS].ravel()
                for j in range(w):
                    grads[i][j] = np.bincount(x[rows, places[i].ravel() + j] * FILTERS + cols, g, K * FILTERS).reshape(K, FILTERS)
            grads.append(np.concatenate([hidden.T @ p, p.sum(0, keepdims=True)]) + 1e-4 * net.dense)
            step += 1
            for k, (q, g) in enumerate(zip(params, grads, strict=True)):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                q -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample of labelled texts, chosen by a hash of doc_id and text.

    About SAMPLE_DOCS of each language, fewer if all would be more than
    SAMPLE_ALL; every language that labels name is in it.  Rows with a null lang
    or text, or held out, are never in it.  Windows are spread over each whole
    text.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc % 4 != 2))
    known = known.withColumn("u", F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    # a row per language, each an output of the network
    counts = {r.lang: (r.n, r.u) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u")).collect()}
    if not counts:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    languages = sorted(counts)
    spark, most = docs.sparkSession, max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(languages)))
    shares = spark.createDataFrame([(x, max(u, most / n)) for x, (n, u) in counts.items()], "lang string, share double")
    # one row per language; rows repeated with their doc_id count once
    chosen = known.join(F.broadcast(shares), "lang").where(F.col("u") <= F.col("share")).dropDuplicates(["lang", "doc_id", "u"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = windows_of(text.encode("utf-8", "surrogatepass"))
                at = np.unique(np.linspace(0, len(found) - 1, SAMPLE_WINDOWS).round().astype(int))
                out += [(lang, -1 if doc_id is None else doc_id, int(i), found[i].tobytes()) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["lang", "doc_id", "place", "window"])

    got = map_arrow(chosen.select("doc_id", "lang", "text"), cut, "lang string, doc_id long, place int, window binary").collect()
    rows = sorted((r.lang, r.doc_id, r.place, bytes(r.window)) for r in got)
    number = {x: i for i, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, LENGTH)
    return windows, np.array([number[r[0]] for r in rows], np.int64), languages


def fit(docs: DataFrame, seed: int = 4) -> Network | None:
    """The network of a sample of docs (doc_id, lang, text); None without labelled texts."""
    windows, labels, languages = sample(docs)
    return train(windows, labels, languages, seed) if len(languages) else None


def predict_texts(net: Network, texts: list[str | None], tables: tuple[np.ndarray, ...] | None = None) -> list[tuple[str, float]]:
    """Language and score of whole texts."""
    tables = tables or net.tables()
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    total = np.zeros((len(raws), len(net.languages)))
    weight = np.zeros(len(raws))
    owner: list[int] = []
    held: list[np.ndarray] = []

    def go() -> None:
        if held:
            x = np.concatenate(held)
            p = net.probabilities(net.pooled(x, tables))
            letters = (x >= 4).sum(1) + 1e-6
            own = np.array(owner)
            np.add.at(total, own, p * letters[:, None])
            np.add.at(weight, own, letters)
            held.clear()
            owner.clear()

    for i, raw in enumerate(raws):
        found = windows_of(raw)
        for at in range(0, len(found), 2048):
            held.append(found[at : at + 2048])
            owner += [i] * len(held[-1])
            if len(owner) >= 2048:
                go()
    go()
    p = total / weight[:, None]
    best = p.argmax(1)
    return [(net.languages[k], float(min(1.0, x[k]))) for k, x in zip(best.tolist(), p, strict=True)]


UNKNOWN = "und"


def judged(docs: DataFrame, net: Network | None) -> DataFrame:
    """(row, lang_pred, score): each row of docs (text and any other columns) as a struct, judged by its text alone.

    A text that is null or has no letter, and any text without a network, is
    `und` with score 0.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for b in batches:
            which = np.flatnonzero(np.array(b.column(2).to_pylist(), bool)) if net else np.empty(0, np.int64)
            lang = np.full(b.num_rows, UNKNOWN, object)
            score = np.zeros(b.num_rows)
            if len(which):
                got = predict_texts(net, b.column(1).take(pa.array(which)).to_pylist(), tables)
                lang[which], score[which] = [g[0] for g in got], [g[1] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return map_arrow(rows, run, schema)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names; see judged."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return judged(docs, net).select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "score")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang; other columns are ignored)."""
    net = fit(docs)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc % 4 == 2).alias("held_out"), "text")
    return identify(rows, net).select("doc_id", "held_out", "lang_pred", "score")


def least_score(net: Network, sure: float) -> float:
    """The score that lies a share `sure` of the way from chance, one of as many languages as there are, to certainty."""
    chance = 1 / len(net.languages)
    return chance + sure * (1 - chance)


def describe(net: Network) -> str:
    return json.dumps({"languages": net.languages, "classes": K, "filters": FILTERS, "widths": WIDTHS, "window": LENGTH})


__all__ = ["Network", "fit", "held_out", "identify", "judged", "languages", "least_score", "predict_texts", "sample", "train", "windows_of"]
