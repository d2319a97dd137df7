"""Toxicity by weak supervision.

Voters look for toxic language in a text: lists of insults, words and word beginnings mined from labelled texts (one
word with a beginning may be chance where three are not, so these count as features of their own), and patterns. How often each combination of votes occurs is counted over all documents that may be learned from. A
generative model explains these counts by one hidden label: it gives each voter its rates of firing on toxic and clean
texts, and lets a voter depend on the one it is most correlated with given the label (a Chow-Liu tree), so that copies
of one signal are not counted twice. Its posterior labels, of labelled and unlabelled texts, train a sparse linear
classifier over words and word beginnings, which scores every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, whole_text
from .language_id import Ftrl

# Plain insults of four languages.
INSULTS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile dumb jerk filthy",
    "de": "idiot idioten dumm dummkopf trottel abschaum versager widerlich wertlos arschloch vollidiot",
    "fr": "idiot idiote imbécile stupide connard abruti crétin ordure minable dégoûtant salaud",
    "es": "idiota imbécil estúpido estúpida basura patético asqueroso escoria payaso inútil cabrón",
}
#: Lengths of word beginnings that are looked at besides whole words.
BEGINNINGS = (4, 5, 6)
#: Lists that mined words are dealt to, a voter each.
LISTS = 6
#: Numbers of different words with one beginning that are features.
REPEATS = (1, 2, 3)
#: The classifier is fitted on about so many labelled texts of each class at most, and on so many unlabelled ones.
PER_CLASS = 4000
#: Mined words or beginnings at most, those with the most toxic texts first.
MINED = 600
_WORD = regex.compile(r"\p{L}+")
_SHOUT = regex.compile(r"\p{Lu}{4,}[^\p{L}]{0,4}!{2,}")
_MASKED = regex.compile(r"\b\p{L}+[*@#]{2,}\p{L}+\b")
_MARKS = regex.compile(r"[*@#]{2}")  # what a masked word holds; far quicker to look for


def beginnings_of(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) > n]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(words: set[str]) -> set[str]:
    """The words, and each beginning with a hyphen and how many of the words have it: "abcd-2" if two or more."""
    out = set(words)
    for size in BEGINNINGS:
        counts = Counter([w[:size] for w in words if len(w) > size])
        out.update(f"{b}-{n}" for b, k in counts.items() if k >= REPEATS[0] for n in REPEATS if k >= n)
    return out


_UNSEEN = object()


class Lexicon:
    """Which of given features a text has, through a cache of words."""

    def __init__(self, features: Iterable[str]):
        self.features = set(features)
        self.stems = {f.split("-")[0] for f in self.features if "-" in f}
        self.known: dict[str, tuple[bool, tuple[str, ...]] | None] = {}

    def _seen(self, word: str) -> tuple[bool, tuple[str, ...]] | None:
        if len(self.known) > 200_000:
            self.known.clear()
        got = word in self.features, tuple(b for b in beginnings_of(word) if b in self.stems)
        self.known[word] = got = got if got[0] or got[1] else None
        return got

    def found(self, words: set[str]) -> tuple[list[str], int]:
        """The features, and how many words gave them."""
        get, matched = self.known.get, []
        for w in words:
            got = get(w, _UNSEEN)
            if got is _UNSEEN:
                got = self._seen(w)
            if got is not None:
                matched.append((w, *got))
        if not matched:
            return [], 0
        counts = Counter(b for _, _, stems in matched for b in stems)
        out = [w for w, itself, _ in matched if itself]
        out += [f for b, k in counts.items() for n in REPEATS if k >= n and (f := f"{b}-{n}") in self.features]
        heads = {f.split("-")[0] for f in out if "-" in f}
        return sorted(out), sum(1 for _, itself, stems in matched if itself or not heads.isdisjoint(stems))


def mined(sample: DataFrame, most: int = MINED) -> dict[str, int]:
    """Words and beginnings that mark toxic texts, each with its voter, from (text, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                seen[label].update(features_of(set(words_of(text))))
                if len(seen[0]) + len(seen[1]) <= 300_000:
                    continue
                yield pd.DataFrame([(f, label, n) for label in (0, 1) for f, n in seen[label].items()], columns=["feature", "label", "n"])
                for c in (seen[0], seen[1]):
                    c.clear()
        yield pd.DataFrame([(f, label, n) for label in (0, 1) for f, n in seen[label].items()], columns=["feature", "label", "n"])

    counts = sample.mapInPandas(run, "feature string, label int, n long").groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("clean")
    )
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    if not toxic:
        return {}
    # far likelier in toxic texts, and in so many of them that it's not chance among a million candidates (a likelihood
    # ratio of e^20); the list's length is bounded
    rate = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / (clean + 1))
    share, both = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share) + 1e-9))).otherwise(0)
    best = counts.where((F.col("toxic") > 0) & (rate >= 40) & (gain >= 20)).orderBy(F.desc("toxic"), F.length("feature"), "feature").limit(most).collect()
    lists = {f: n for n, f in enumerate(sorted(r["feature"] for r in best if "-" not in r["feature"]))}
    return {r["feature"]: lists[r["feature"]] % LISTS if r["feature"] in lists else LISTS + BEGINNINGS.index(r["feature"].index("-")) for r in best}


class Voters:
    """The votes of a text as bits. found: mined features with their voters."""

    def __init__(self, found: dict[str, int]):
        self.names = [f"words {i}" for i in range(LISTS)] + [f"beginnings {n}" for n in BEGINNINGS] + list(INSULTS) + ["shouting", "masked", "several", "dense"]
        self.bits = {f: 1 << v for f, v in found.items()}
        for i, k in enumerate(INSULTS):
            for w in INSULTS[k].split():
                self.bits[w] = self.bits.get(w, 0) | 1 << LISTS + len(BEGINNINGS) + i
        self.lexicon = Lexicon(self.bits)

    def votes(self, text: str) -> int:
        words = words_of(text)
        found, hits = self.lexicon.found(set(words))
        out = 0
        for f in found:
            out |= self.bits[f]
        last = len(self.names)
        for i, on in enumerate((_SHOUT.search(text), _MARKS.search(text) and _MASKED.search(text), hits >= 2, hits * 50 >= len(words) > 0)):
            if on:
                out |= 1 << last - 4 + i
        return out


class LabelModel:
    """A hidden label y and a tree of voters: P(y), P(v | parent, y)."""

    def __init__(self, m: int):
        self.m, self.prior, self.parent = m, 0.1, [-1] * m
        self.p = np.full((m, 2, 2), 0.5)  # of firing, by y and the parent's vote

    def _log(self, v: np.ndarray) -> np.ndarray:
        """log P(v, y) for each row of votes and both labels."""
        out = np.log([1 - self.prior, self.prior])[None, :].repeat(len(v), 0)
        for j in range(self.m):
            q = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
            for y in (0, 1):
                p = self.p[j, y][q]
                out[:, y] += np.log(np.where(v[:, j] == 1, p, 1 - p))
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        a = self._log(v)
        return 1 / (1 + np.exp(np.clip(a[:, 0] - a[:, 1], -50, 50)))

    def _tree(self, v: np.ndarray, w: np.ndarray) -> None:
        """Each voter's parent: the maximum spanning tree of mutual information given the label."""
        total = w.sum()
        info = np.zeros((self.m, self.m))
        for y in (0, 1):
            wy = w[:, y]
            py = wy.sum() / total
            one = (wy @ v + 0.5) / (wy.sum() + 1)
            both = (v.T * wy) @ v / (wy.sum() + 1) + 1e-6
            for a in (0, 1):
                for b in (0, 1):
                    pa, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None, :]
                    pab = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                    pab = np.clip(pab, 1e-9, 1)
                    info += py * pab * np.log(pab / np.clip(pa * pb, 1e-12, 1))
        inside, self.parent = {0}, [-1] * self.m
        while len(inside) < self.m:
            i, j = max(((i, j) for i in inside for j in range(self.m) if j not in inside), key=lambda e: info[e])
            self.parent[j] = i if info[i, j] > 1e-3 else -1
            inside.add(j)

    def _maximise(self, v: np.ndarray, w: np.ndarray) -> None:
        self.prior = float(np.clip((w[:, 1].sum() + 1) / (w.sum() + 2), 1e-4, 0.999))
        for j in range(self.m):
            for y in (0, 1):
                for q in (0, 1):
                    if self.parent[j] < 0:
                        sel = w[:, y]
                    else:
                        sel = w[:, y] * (v[:, self.parent[j]] == q)
                    self.p[j, y, q] = (sel @ v[:, j] + 0.1) / (sel.sum() + 0.2)
        self.p = np.clip(self.p, 1e-4, 1 - 1e-4)

    def fit(self, v: np.ndarray, n: np.ndarray, labelled: np.ndarray, rounds: int = 20) -> "LabelModel":
        """By expectation maximisation. v: vote rows; n: documents of each; labelled: those known as (clean, toxic)."""
        free = np.maximum(0, n - labelled.sum(1))
        start = labelled + 1e-3
        self._maximise(v, start)
        for r in range(rounds):
            p = self.posterior(v)
            w = labelled + free[:, None] * np.stack([1 - p, p], 1)
            if r in (1, 5):
                self._tree(v, w)
            self._maximise(v, w)
        return self


class _Kinds(dict):
    """Words to kinds: words of one kind are the same features. Kind 0: of none."""

    def __init__(self, features: Iterable[str], heads: dict[str, int]):
        super().__init__()
        self.features, self.heads = {f for f in features if "-" not in f}, heads
        self.kinds: dict[tuple, int] = {("",) + (0,) * len(BEGINNINGS): 0}

    def __missing__(self, word: str) -> int:
        stems = [self.heads.get(b, 0) for b in beginnings_of(word)]
        key = (word if word in self.features else "", *stems, *[0] * (len(BEGINNINGS) - len(stems)))
        self[word] = kind = self.kinds.setdefault(key, len(self.kinds))
        return kind


class Classifier:
    """A sparse linear score over the words and beginnings that a text has."""

    #: Words of texts that are scored at once.
    RUN = 200_000

    def __init__(self, weights: dict[str, float], bias: float):
        # multiples of 2^-30 add up to the same in any order
        self.weights = {f: round(w * 2**30) / 2**30 for f, w in weights.items()}
        self.bias = round(bias * 2**30) / 2**30
        self.heads = {b: i + 1 for i, b in enumerate(sorted({f.split("-")[0] for f in weights if "-" in f}))}
        # by beginning and number of words that have it, which all fewer words also count for
        self.rising = np.zeros((len(self.heads) + 1, max(REPEATS) + 1))
        for b, i in self.heads.items():
            self.rising[i] = [sum(self.weights.get(f"{b}-{n}", 0.0) for n in REPEATS if n <= k) for k in range(max(REPEATS) + 1)]
        self.kinds = _Kinds(self.weights, self.heads)

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        out, flat, sizes = [np.empty(0)], [], []
        for text in texts:
            if len(self.kinds) > 200_000:
                out.append(self._sums(flat, sizes))
                flat, sizes, self.kinds = [], [], _Kinds(self.weights, self.heads)
            words = set(words_of(text))
            flat.extend(map(self.kinds.__getitem__, words))
            sizes.append(len(words))
            if len(flat) > self.RUN:
                out.append(self._sums(flat, sizes))
                flat, sizes = [], []
        out.append(self._sums(flat, sizes))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40)))

    def _sums(self, flat: list[int], sizes: list[int]) -> np.ndarray:
        """The texts' sums of weights. flat: the kinds of their different words, text after text."""
        kinds = list(self.kinds.kinds)
        own = np.array([self.weights.get(k[0], 0.0) for k in kinds])
        stems = np.array([k[1:] for k in kinds], np.int64)
        ids, text = np.array(flat, np.int64), np.repeat(np.arange(len(sizes)), sizes)
        text, ids = text[ids > 0], ids[ids > 0]
        total = self.bias + np.bincount(text, own[ids], len(sizes))
        of = stems[ids]
        pairs, n = np.unique((text[:, None] * len(self.rising) + of)[of > 0], return_counts=True)
        return total + np.bincount(pairs // len(self.rising), self.rising[pairs % len(self.rising), np.minimum(n, max(REPEATS))], len(sizes))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, epochs: int = 5) -> Classifier:
    """The classifier. docs: (doc_id, text); labels: (doc_id, toxic); learn: the rows whose labels may be seen.

    Words are mined from all labelled texts that may be learned from, and the label model counts the votes of all documents
    and of all labelled ones among them. Only the classifier is fitted on about per_class labelled texts of each class and as
    many unlabelled ones at most, chosen by a hash. Only vote combinations, of 17 voters at most, and bounded lists come to the driver.
    """
    docs = docs.where(learn)
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).where(learn)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("label") == k, F.lit(int(1_000_000 * min(1.0, per_class / n)))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    picked = known.where(drawn < share)
    # labels grow with the documents: never broadcast, at any size
    voters = Voters(mined(docs.join(known.hint("merge"), "doc_id").select("text", "label")))
    m = len(voters.names)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "votes": [voters.votes(t) for t in b["text"]]})

    # the votes are joined with the labels, not the texts
    cast = docs.select("doc_id", "text").mapInPandas(votes, "doc_id long, votes int").join(known.hint("merge"), "doc_id", "left")
    told = cast.groupBy("votes", "label").agg(F.count("*").alias("n")).toPandas()
    rows = np.array(sorted(set(told["votes"])), np.int64)
    where = {v: i for i, v in enumerate(rows.tolist())}
    n, labelled, unlabelled = np.zeros(len(rows)), np.zeros((len(rows), 2)), int(told["n"][told["label"].isna()].sum())
    for v, k, c in zip(told["votes"], told["label"], told["n"], strict=True):
        n[where[v]] += c
        if not pd.isna(k):
            labelled[where[v], int(k > 0)] += c
    v = (rows[:, None] >> np.arange(m)) & 1
    model = LabelModel(m).fit(v, n, labelled) if len(rows) else LabelModel(m)
    posterior = dict(zip(rows.tolist(), model.posterior(v).tolist(), strict=True)) if len(rows) else {}

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # every feature of the bounded sample that five texts have at least
        first, number = [], {}
        for b in batches:
            for text in b["text"]:
                ids = [number.setdefault(f, len(number)) for f in features_of(set(words_of(text)))]
                first.append((np.array(ids, np.int32), posterior[voters.votes(text)]))
        seen = np.zeros(len(number), np.int64)
        for ids, _ in first:
            seen[ids] += 1
        names = sorted(f for f, i in number.items() if seen[i] >= 5)
        place = np.full(len(number), -1)
        place[[number[f] for f in names]] = np.arange(len(names))
        number.clear()
        rows = [(np.sort(at[at >= 0]), y) for at, y in ((place[ids], y) for ids, y in first)]
        f = Ftrl(len(names), 2, alpha=0.2, l1=1.0, l2=1e-2)
        positive = max(1.0, sum(y for _, y in rows))
        balance = min(2.0, max(1.0, (len(rows) - positive) / positive))
        for e in range(epochs):
            for k in np.random.default_rng(e).permutation(len(rows)):
                i, y = rows[k]
                f.learn(i, np.ones(len(i)), np.array([1 - y, y]), balance if y > 0.5 else 1.0)
        w = f.weights()
        w = w[:, 1] - w[:, 0]
        on = np.flatnonzero(w[:-1])
        yield pd.DataFrame({"feature": [names[i] for i in on] + [""], "w": np.append(w[on], w[-1])})

    # two classes of about per_class rows: small enough to send to every task
    sample = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text")
    few = docs.where(drawn < int(1_000_000 * min(1.0, per_class / max(1, unlabelled)))).join(known, "doc_id", "left_anti").select("doc_id", "text")
    got = sample.unionByName(few).repartition(1).sortWithinPartitions("doc_id", "text").select("text").mapInPandas(train, "feature string, w double").toPandas()
    weights = dict(zip(got["feature"], got["w"], strict=True))
    bias = weights.pop("", 0.0)
    return Classifier(weights, bias if counts.get(1) else -4.0)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels are learned only where crc32(doc_id) modulo 3 is not 1; held_out marks the other rows. Null and empty texts
    have the score of a text without words; without any toxic label all scores are low. A document with several labels
    is toxic if one says so. Repeated rows are scored alike; other columns are ignored.
    """
    held = bucket_of("doc_id", 3) == 1
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    model = fit(picked, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), ~held)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            s = m.scores(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return picked.withColumn("held_out", held).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
