"""Toxicity: a convolutional text classifier over hashed word embeddings, written and trained in numpy.

A word's embedding is the sum of three hashed rows: the word, its first four and its first three letters.
Filters of widths 1, 2 and 3 slide over the words; each filter's maximum over the whole text feeds a logistic
output.  Only the places of the maxima get gradients.  The logit is shifted for each detected language so that
its calibrated threshold falls on a score of 0.7.

All labelled rows of folds 0 and 2 are learnt from, whole.  Each pass deals them to tasks, every task trains a copy of
the network on its rows, and the copies are averaged: a weight by the mean of the moves of those copies that moved it.
A fifth of the rows is set aside for the thresholds, which come from all its logits by one count over sorted ranges.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from meterline.llm.common import counted_small, dropped, saved, shuffles_deleted
from meterline.llm.kneser_ney import KneserNey, batches
from meterline.llm.language_id import fit_models, fold

#: Rows of a copy of the network in one pass, and most copies; beyond them copies get more rows.
PER_COPY, MOST_COPIES = 8_000, 128
#: Passes over all rows: so many rows are shown in all, within these numbers of passes.
SHOWN, FEWEST_PASSES, MOST_PASSES = 48_000, 2, 12
#: Weights of a block; copies are averaged block by block.
BLOCK = 1 << 13
#: Words whose features a worker keeps between texts.
KEPT_WORDS = 1 << 17
BATCH, RATE = 32, 0.08
THRESHOLD = 0.7
BUCKETS = 1 << 15
WORD = re.compile(r"\w+")


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS


#: Many words share their first letters.
_prefix = lru_cache(maxsize=1 << 16)(_bucket)


def features(word: str) -> int:
    """Embedding rows of a lower-case word (of the word, its first four and its first three letters) as one number."""
    return _bucket(word) + BUCKETS * (_prefix("4:" + word[:4]) + BUCKETS * _prefix("3:" + word[:3]))


def unpacked(codes: np.ndarray) -> np.ndarray:
    """The three embedding rows of each of :func:`features`."""
    return np.stack((codes % BUCKETS, codes // BUCKETS % BUCKETS, codes // BUCKETS**2), axis=1)


class Vocabulary(dict):
    """Numbers for the words of texts, with their features."""

    def __init__(self):
        self.features: list[int] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.features)
        self.features.append(features(word))
        return k

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.__getitem__, WORD.findall((text or "").lower()))), np.int64)

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        return np.array([self.features[k] for k in numbers.tolist()], np.int64)

    def table(self) -> np.ndarray:
        return unpacked(np.array(self.features, np.int64))


@dataclass
class ConvNet:
    """Weights; filters[w] has shape (width, dim, filters)."""

    widths: tuple[int, ...] = (1, 2, 3)
    dim: int = 12
    n_filters: int = 8
    seed: int = 7
    embedding: np.ndarray = field(init=False)
    filters: list[np.ndarray] = field(init=False)
    bias: list[np.ndarray] = field(init=False)
    out: np.ndarray = field(init=False)
    out_bias: float = 0.0

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        self.embedding = r.normal(0, 0.01, (BUCKETS, self.dim)).astype(np.float32)
        self.filters = [r.normal(0, (2 / (w * self.dim)) ** 0.5, (w, self.dim, self.n_filters)).astype(np.float32) for w in self.widths]
        self.bias = [np.zeros(self.n_filters, np.float32) for _ in self.widths]
        self.out = r.normal(0, 0.3, (len(self.widths), self.n_filters)).astype(np.float32)

    def forward(self, docs: list[np.ndarray], rows: np.ndarray, places: bool = False):
        """Logits of the texts (arrays of word numbers); with ``places``, also the maxima and where they are.

        Words are projected once each, so a text costs one gather for all filters.
        """
        pad = max(self.widths) - 1
        blank = len(rows)  # a last, zero row that pads short texts
        words = np.concatenate((self.embedding[rows].sum(axis=1), np.zeros((1, self.dim), np.float32)))
        flat = np.concatenate([x for d in docs for x in (d, np.full(pad + (len(d) == 0), blank))])
        lengths = np.array([len(d) + (len(d) == 0) for d in docs], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + pad)))[:-1]
        parts = (words @ np.concatenate([x for f in self.filters for x in f], axis=1))[flat].reshape(len(flat), -1, self.n_filters)
        # a row for each filter, so that maxima run over adjacent numbers
        act, at = np.empty((len(self.widths), self.n_filters, len(flat) - pad), np.float32), 0
        for k, w in enumerate(self.widths):
            total = parts[: len(flat) - pad, at]
            for j in range(1, w):
                total = total + parts[j : j + len(flat) - pad, at + j]
            act[k], at = total.T, at + w
        act = act.reshape(-1, len(flat) - pad)
        top = [act[:, s : s + n].argmax(axis=1) + s for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        top = np.array(top, np.int64).reshape(len(docs), -1)
        top, pooled = (x.reshape(len(docs), len(self.widths), -1).swapaxes(0, 1) for x in (top, act[np.arange(len(act)), top]))
        pooled = np.maximum(pooled + np.array(self.bias)[:, None], 0)
        logits = np.einsum("kdf,kf->d", pooled, self.out) + self.out_bias
        return (logits, pooled, top, flat, words) if places else logits

    def train(self, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = BATCH, rate: float = RATE) -> None:
        """Adagrad on the class-weighted logistic loss."""
        r, weight, seen = np.random.default_rng(self.seed), label_weights(len(labels), labels.sum())[labels], self.fresh()
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                local, own = renumbered([docs[i] for i in pick])
                self.step(own, rows[local], labels[pick], weight[pick], seen, rate)

    def step(self, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, seen: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One Adagrad step on a batch; ``seen`` has the sums of squared gradients."""
        logits, pooled, where, flat, words = self.forward(docs, rows, True)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * weight / len(docs)
        grads = {"out": np.einsum("d,kdf->kf", error, pooled), "out_bias": np.array([error.sum()])}
        hit, moves = [], []
        for k, w in enumerate(self.widths):
            delta = error[:, None] * self.out[k] * (pooled[k] > 0)
            grads[f"bias{k}"] = delta.sum(axis=0)
            ids = flat[where[k][None] + np.arange(w)[:, None, None]]
            grads[f"filter{k}"] = np.einsum("df,jdfe->jef", delta, words[ids])
            hit.append(ids.reshape(-1))
            moves.append(np.einsum("df,jef->jdfe", delta, self.filters[k]).reshape(-1, self.dim))
        for name, g in grads.items():
            self._step(name, g, seen, rate)
        d_words = np.zeros((len(words), self.dim))
        np.add.at(d_words, np.concatenate(hit), np.concatenate(moves))
        live = np.flatnonzero(d_words[:-1].any(axis=1))
        touched, back = np.unique(rows[live], return_inverse=True)
        g = np.zeros((len(touched), self.dim))
        np.add.at(g, back.reshape(-1), np.repeat(d_words[live], 3, axis=0))
        seen["embedding"][touched] += g * g
        self.embedding[touched] -= rate * g / np.sqrt(seen["embedding"][touched])

    def fresh(self) -> dict[str, np.ndarray]:
        """Sums of squared gradients before the first step."""
        return {k: np.full_like(x, 1e-3) for k, x in self._arrays().items()}

    def vector(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([x.reshape(-1) for x in self._arrays().values()]).astype(np.float32)

    def load(self, vector: np.ndarray) -> None:
        """Take the weights that :meth:`vector` gave."""
        for name, x in self.parts(vector).items():
            if name == "out_bias":
                self.out_bias = float(x[0])
            else:
                self._arrays()[name][...] = x

    def parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """A row of numbers as arrays of the shapes of the weights."""
        shapes = {k: x.shape for k, x in self._arrays().items()}
        cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
        return {k: x.reshape(s).copy() for (k, s), x in zip(shapes.items(), np.split(vector, cuts), strict=True)}

    def _arrays(self) -> dict[str, np.ndarray]:
        own = {"embedding": self.embedding, "out": self.out, "out_bias": np.array([self.out_bias])}
        for k in range(len(self.widths)):
            own |= {f"filter{k}": self.filters[k], f"bias{k}": self.bias[k]}
        return own

    def _step(self, name: str, g: np.ndarray, seen: dict[str, np.ndarray], rate: float) -> None:
        seen[name] += g * g
        step = rate * g / np.sqrt(seen[name])
        if name == "out_bias":
            self.out_bias -= float(step[0])
        else:
            self._arrays()[name][...] -= step


def renumbered(docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different numbers of several texts, and the texts as places in them."""
    local, inverse = np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]), return_inverse=True)
    return local, np.split(inverse, np.cumsum([len(d) for d in docs])[:-1])


def label_weights(n: int, positive: int) -> np.ndarray:
    """Weights of labels 0 and 1 that give both the same share."""
    return np.array([n / (2 * max(1, n - positive)), n / (2 * max(1, positive))], np.float32)


@dataclass
class ToxicityModel:
    """The network, the language models, and for each language the logit that becomes a score of 0.7."""

    net: ConvNet
    languages: KneserNey
    cuts: dict[str | None, float]
    words: Vocabulary = field(default_factory=Vocabulary)

    def language(self, texts: list[str]) -> list[str | None]:
        """Detected language of each text, from its characters alone."""
        if not self.languages.classes:
            return [None] * len(texts)
        entropy, lengths = self.languages.cross_entropy(texts)
        return [self.languages.classes[k] if n else None for k, n in zip(entropy.argmin(axis=1), lengths, strict=True)]

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > KEPT_WORDS:
            self.words = Vocabulary()
        local, docs = renumbered([self.words.encode(t) for t in texts])
        return self.net.forward(docs, unpacked(self.words.codes(local)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        texts, out = [t or "" for t in texts], np.zeros(len(texts))
        for run in batches(texts, 400_000):
            cut = np.array([self.cuts.get(x, self.cuts[None]) for x in self.language(texts[run])])
            z = self.logits(texts[run]) - cut + np.log(THRESHOLD / (1 - THRESHOLD))
            out[run] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, lang, toxic``: every row of folds 0 and 2 whose id is labelled, with its whole text (null: empty)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    return texts.join(counted_small(known, "toxicity_labels"), "doc_id")


@F.pandas_udf(T.ArrayType(T.LongType()))
def word_codes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    words = Vocabulary()
    for part in parts:
        out = []
        for text in part:
            if len(words) > KEPT_WORDS:
                words = Vocabulary()
            out.append(words.codes(words.encode(text)))
        yield pd.Series(out)


def one_pass(net: ConvNet, seen: np.ndarray, rows: DataFrame, copies: int, number: int, weights: np.ndarray) -> np.ndarray:
    """Train ``copies`` of the network on ``rows(doc_id, words, toxic)``, each row once, and average them into it.

    ``seen`` are the sums of squared gradients in the order of the weights; the new ones are returned.  A copy's rows
    stream through its task in an order of their own for each pass.
    """
    start = net.vector()

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums, rows, labels = ConvNet(net.widths, net.dim, net.n_filters, net.seed), net.parts(seen), [], []
        own.load(start)

        def step() -> None:
            local, docs = renumbered(rows)
            y = np.array(labels, np.int64)
            own.step(docs, unpacked(local), y, weights[y], sums)
            rows.clear()
            labels.clear()

        some = False
        for part in parts:
            for words, label in zip(part["words"], part["toxic"], strict=True):
                rows.append(np.asarray(words, np.int64))
                labels.append(label)
                if len(rows) == BATCH:
                    step()
            some = some or len(part) > 0
        if rows:
            step()
        if some:
            moved = own.vector() - start
            more = np.concatenate([x.reshape(-1) for x in sums.values()]).astype(np.float32) - seen
            at = range(0, len(moved), BLOCK)
            yield pd.DataFrame({"block": at, "moved": [moved[k : k + BLOCK] for k in at], "more": [more[k : k + BLOCK] for k in at]})

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        moved, more = (np.stack(part[c].to_list()) for c in ("moved", "more"))
        # rare words are in few copies, whose moves should not fade
        n = np.maximum(1, (more != 0).sum(axis=0))
        # one order of summing, whatever order the copies arrive in
        moved, more = (np.sort(x, axis=0).sum(axis=0, dtype=np.float64) / n for x in (moved, more))
        return pd.DataFrame({"block": part["block"].iloc[:1], "moved": [moved], "more": [more]})

    order = [F.xxhash64("doc_id", F.lit(number)), F.col("doc_id"), F.xxhash64("words")]
    dealt = rows.select("doc_id", "words", "toxic").repartition(copies, F.xxhash64("doc_id", F.lit(f"copy {number}")))
    made = dealt.sortWithinPartitions(*order).mapInPandas(learn, "block int, moved array<float>, more array<float>")
    with shuffles_deleted(rows.sparkSession):
        # as many numbers as the network has weights
        found = made.groupBy("block").applyInPandas(mean, made.schema).toPandas().sort_values("block")
    net.load(start + np.concatenate(found["moved"].to_list()))
    return (seen + np.concatenate(found["more"].to_list())).astype(np.float32)


def trained(rows: DataFrame, n: int, positive: int) -> ConvNet:
    """The network after all passes over ``rows(doc_id, words, toxic)``; untrained without rows of both labels."""
    net = ConvNet()
    if 0 < positive < n:
        seen = np.concatenate([x.reshape(-1) for x in net.fresh().values()]).astype(np.float32)
        copies = min(MOST_COPIES, -(-n // PER_COPY))
        for number in range(min(MOST_PASSES, max(FEWEST_PASSES, -(-SHOWN // n)))):
            seen = one_pass(net, seen, rows, copies, number, label_weights(n, positive))
    return net


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train on four fifths of all labelled rows, then set each language's threshold on all the rest."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(5))
    rows = saved(labelled(docs, labels).withColumn("aside", part == 0), "toxicity_rows")
    languages = fit_models(rows.filter(F.col("lang").isNotNull()), 3)
    own = saved(rows.filter(~F.col("aside")).select("doc_id", word_codes("text").alias("words"), "toxic"), "toxicity_words")
    n, positive = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = ToxicityModel(trained(own, n, positive), languages, {None: 0.0})
    dropped(own)

    @F.pandas_udf("lang string, z double")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = list(part)
            runs = [texts[run] for run in batches(texts, 400_000)]
            z = np.concatenate([model.logits(x) for x in runs]) if runs else np.zeros(0)
            yield pd.DataFrame({"lang": [x for run in runs for x in model.language(run)], "z": z.astype(float)})

    aside = saved(rows.filter("aside").select("toxic", judged("text").alias("x")).select("toxic", "x.*"), "toxicity_aside")
    dropped(rows)
    found = cuts_of(aside)
    model.cuts[None] = found.pop(None, 0.0)
    model.cuts |= found
    return model


def cuts_of(rows: DataFrame, least: int = 10) -> dict[str | None, float]:
    """Of ``rows(lang, z, toxic)``, the logit that parts the labels with the best F1, in the middle of its gap.

    By language, and of all rows under None; not where a label has fewer than ``least`` rows.  Equal logits are one
    place; of equal F1 the lowest counts.  Ranks come from counts of ranges of logits, so no language is sorted whole.
    """
    each = rows.select(F.explode(F.array_distinct(F.array(F.struct("lang"), F.struct(F.lit(None).cast("string").alias("lang"))))).alias("of"), "z", "toxic")
    each = each.groupBy("of", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
    each = saved(each.withColumn("range", F.floor(F.greatest(F.lit(-60), F.least(F.lit(60), F.col("z"))) * 16)), "toxicity_places")
    # a row for each language and range, of which there are at most 1,921
    above = W.partitionBy("of").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("of")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = each.groupBy("of", "range").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    ranges = ranges.select("of", "range", *(total(c, w).alias(name) for c, w, name in (("n", above, "n_above"), ("pos", above, "pos_above"), ("n", every, "n_all"), ("pos", every, "pos_all"))))
    ranges = ranges.filter((F.col("pos_all") >= least) & (F.col("n_all") - F.col("pos_all") >= least))
    down = W.partitionBy("of", "range").orderBy(F.desc("z")).rowsBetween(W.unboundedPreceding, 0)
    ranked = each.join(F.broadcast(ranges), ["of", "range"])
    f1 = 2 * (F.col("pos_above") + F.sum("pos").over(down)) / (F.col("n_above") + F.sum("n").over(down) + F.col("pos_all"))
    best = ranked.select("of", "z", f1.alias("f1")).groupBy("of").agg(F.max(F.struct("f1", -F.col("z"))).alias("x"))
    best = best.select("of", (-F.col("x.col2")).alias("best"))
    below = each.join(F.broadcast(best), "of").groupBy("of", "best").agg(F.max(F.when(F.col("z") < F.col("best"), F.col("z"))).alias("below"))
    found = below.select("of.lang", ((F.col("best") + F.coalesce("below", F.col("best") - 1)) / 2).alias("cut")).collect()
    dropped(each)
    return {r["lang"]: r["cut"] for r in found}


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the score of a text without words; others of any length are scored whole.  Ids may be null
    (held_out false) or repeated; extra columns are ignored; an empty table gives no rows.  Where no label or only one could be learned, scores are those of an untrained net.
    """

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.scores(list(part)))

    rows = docs.select("doc_id", scored("text").alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
