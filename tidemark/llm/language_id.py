"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, other characters become one space, and n-grams of one to three characters are hashed into a
fixed number of bins. How many documents have each bin is counted over all training documents. The classifier is fitted
by follow-the-regularised-leader with elastic-net penalties on a bounded sample of them, dealt evenly over the
languages; a temperature fitted on a part that it has not seen calibrates its probabilities. Every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, whole_text

BINS = 1 << 15
#: At most about so many documents of each language are fitted on.
PER_LANGUAGE = 2000
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SEED = np.array([0, 0x5BD1E995, 0x1B873593], np.uint32)


def bins(text: str, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a text's n-grams, in order, and how often each occurs; long texts are taken in windows."""
    total = np.zeros(BINS, np.int64)
    carried = ""
    for at in range(0, max(1, len(text)), window):
        part = _OTHER.sub(" ", text[at : at + window].lower())
        if not at:
            part = " " + part.removeprefix(" ")
        elif carried.endswith(" "):
            part = part.removeprefix(" ")
        if at + window >= len(text) and not (carried + part).endswith(" "):
            part += " "
        # n-grams that end inside this part; the two characters before it are carried over
        c = np.frombuffer((carried + part).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(min(3, len(c))):
            h[n:] = h[n:] * np.uint32(31) + c[: len(c) - n] * _MIX[n]
            mixed = h[max(len(carried), n) :] ^ _SEED[n]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(17), minlength=BINS)
        carried = (carried + part)[-2:]
    found = np.flatnonzero(total)
    return found, total[found]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bin, n): how many texts have each bin; bin -1 counts the texts. A task sends each bin once at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(BINS, np.int64), 0
        for b in batches:
            for text in b["text"]:
                seen[bins(text)[0]] += 1
            n += len(b)
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"bin": np.append(found, -1), "n": np.append(seen[found], n)})

    return docs.select("text").mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, n = bins(text)
    x = np.log1p(n) * idf[i]
    norm = np.sqrt((x * x).sum())
    return i, x / norm if norm else x


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, per coordinate, with L1 and L2 penalties, for several classes."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> None:
        """One example: its coordinates, their values, and the probability of each class. The last coordinate is the bias."""
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(i)
        g = weight * x[:, None] * (softmax(x @ w) - y)
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over 0.01 to 100."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, g = np.log(0.01), np.log(100), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """langs, idf and weights of a fitted classifier."""

    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, t: float):
        self.langs, self.idf, self.w, self.t = langs, idf, w, t

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        i, x = weighted(text, self.idf)
        p = softmax((x @ self.w[i] + self.w[-1]) / self.t)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, epochs: int = 4) -> Model:
    """A classifier from the texts and non-null langs of the rows where learn holds.

    About per_language documents of each language at most are fitted on, chosen by a hash; all others count towards the
    document frequencies. What comes to the driver is one number for each bin and language.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select(whole_text().alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(7)).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(BINS), np.zeros((BINS + 1, 0)), 1.0)
    df = {r["bin"]: r["n"] for r in document_frequencies(known).collect()}
    total = df.pop(-1)
    idf = np.full(BINS, np.log1p(total))
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1

    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("lang") == k, F.lit(int(1_000_000 * min(1.0, per_language / n)))).otherwise(share)
    sample = known.where(F.pmod("h", F.lit(1_000_000)) < share)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {k: i for i, k in enumerate(langs)}
        rows = [(*weighted(t, idf), number[k]) for b in batches for t, k in zip(b["text"], b["lang"], strict=True)]
        rows = [r for r in rows if len(r[0])]
        held = rows[::8] if len(rows) >= 80 else []
        seen = [r for n, r in enumerate(rows) if n % 8] if held else rows
        f = Ftrl(BINS, len(langs))
        eye = np.eye(len(langs))
        for e in range(epochs):
            for n in np.random.default_rng(e).permutation(len(seen)):
                i, x, y = seen[n]
                f.learn(i, x, eye[y])
        w = f.weights().astype(np.float32)
        logits = np.array([x @ w[i] + w[-1] for i, x, _ in held])
        yield pd.DataFrame({"w": [w.tobytes()], "t": [temperature(logits, np.array([r[2] for r in held]))]})

    # the sample is bounded, so one task may hold it
    got = sample.repartition(1).sortWithinPartitions("h", "text").mapInPandas(train, "w binary, t double").first()
    return Model(langs, idf, np.frombuffer(got["w"], np.float32).reshape(BINS + 1, len(langs)), got["t"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; text is read, all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages numbers
    columns = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            out = b[columns].copy()
            out["lang_pred"], out["score"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Learns from documents whose crc32(doc_id) modulo 5 is not 0; held_out marks the others. A null text, or one without
    letters, is und with score 0, and so is all where no language is known. Repeated rows are predicted alike; other
    columns are ignored.
    """
    held = bucket_of("doc_id", 5) == 0
    model = fit(docs, ~held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
