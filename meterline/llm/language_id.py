"""Language identification by one interpolated Kneser-Ney character model for each language.

The models are fitted on a bounded sample of labelled rows (about ``per_language`` documents of each language, those
of small hashed id, of at most ``max_chars`` characters); every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import counted_small, saved
from meterline.llm.kneser_ney import KneserNey, batches, encode, ngrams

PER_LANGUAGE = 1000
MAX_CHARS = 20_000
ORDER = 4
#: Share of a language's own documents that its limit may reject.
REJECTED = 0.01
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def few(ids: DataFrame, by: str, n: int) -> DataFrame:
    """About ``n`` of the different ``(doc_id, by)`` for each value of ``by``, those of small hash; all where there are fewer.

    The bound follows from the values' counts, so no value, however frequent, is sorted or gathered.
    """
    ids = ids.select("doc_id", by).distinct()
    counts = counted_small(ids.groupBy(by).agg(F.count(F.lit(1)).alias("many")), "sample_counts")
    # hashes are even over all longs, so this bound cuts off a share of n / many
    bound = F.lit(2.0**63) * F.least(F.lit(1.0), 2 * n / F.col("many") - 1)
    return ids.join(counts, by).filter(F.xxhash64("doc_id").cast("double") <= bound).select("doc_id", by)


def texts_of(docs: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """``ids`` with the other columns of ``docs``; of repeated ids, those of the text of smallest hash."""
    others = [c for c in docs.columns if c not in ids.columns]
    least = F.min(F.struct(F.xxhash64("text").alias("h"), *others)).alias("x")
    found = docs.join(counted_small(ids, "sample_ids"), list(keys)).groupBy(*ids.columns).agg(least)
    return found.select(*ids.columns, *(F.col(f"x.{c}").alias(c) for c in others))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> DataFrame:
    """``doc_id, lang, text`` of the documents to learn from; only folds 0 and 2, non-null lang and text."""
    able = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 1) & F.length("text").between(1, max_chars))
    able = able.select("doc_id", "lang", "text")
    return texts_of(able, few(able, "lang", per_language), "doc_id", "lang")


def fit_models(rows: DataFrame, order: int = ORDER) -> KneserNey:
    """Fit from ``(text, lang)`` rows; n-grams are counted in tasks, and only their counts are gathered.

    What is gathered is bounded by the sample: at most one n-gram for each character of it.
    """

    def grams_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, texts in part.groupby("lang")["text"]:
                texts = list(texts)
                for run in batches(texts):
                    codes, n = np.unique(ngrams([encode(t) for t in texts[run]], order)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

    grams = rows.select("text", "lang").mapInPandas(grams_of, "lang string, code long, n long")
    grams = grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    grams = {lang: (g["code"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy()) for lang, g in grams.groupby("lang")}
    order_of = {lang: np.argsort(codes) for lang, (codes, _) in grams.items()}
    return KneserNey({lang: (codes[order_of[lang]], n[order_of[lang]]) for lang, (codes, n) in grams.items()}, order)


@dataclass
class LanguageModel:
    """The language models with the calibration of their margins and the largest accepted cross-entropies."""

    models: KneserNey
    slope: float
    offset: float
    limits: np.ndarray

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang_pred, score, cross_entropy, accepted`` of each text."""
        none = not self.models.classes
        lettered = [t is not None and not none and any(map(str.isalpha, t)) for t in texts]
        use = [t for t, ok in zip(texts, lettered, strict=True) if ok]
        blank = {"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": np.nan, "accepted": False}
        out = pd.DataFrame(blank, index=range(len(texts)))
        for run in batches(use):
            entropy, lengths = self.models.cross_entropy(use[run])
            rows = np.flatnonzero(lettered)[run]
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            out.loc[rows, "lang_pred"] = np.array(self.models.classes, object)[best]
            out.loc[rows, "score"] = self.confidence(margins(entropy, best, lengths))
            out.loc[rows, "cross_entropy"] = least
            out.loc[rows, "accepted"] = least <= self.limits[best]
        return out

    def confidence(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def margins(entropy: np.ndarray, of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How far the class ``of`` is ahead of the best other one, scaled by the root of the length."""
    rows = np.arange(len(of))
    own = entropy[rows, of]
    other = entropy.copy()
    other[rows, of] = np.inf
    best = other.min(axis=1) if entropy.shape[1] > 1 else own + 1
    return (best - own) * np.sqrt(lengths)


def calibrated(models: KneserNey, texts: list[str], langs: list[str]) -> LanguageModel:
    """Fit the confidence (logistic in the margin, over all classes of each text) and each language's limit.

    The limit is the conformal one: of ``n`` held-out cross-entropies the ``ceil((n + 1) (1 - REJECTED))``-th smallest,
    which a further text of the language exceeds with a chance of at most ``REJECTED``; of fewer, the largest, which it
    exceeds with a chance of 1 in n + 1.
    """
    known = {c: k for k, c in enumerate(models.classes)}
    keep = [i for i, lang in enumerate(langs) if lang in known]
    limits = np.full(len(known), np.inf)
    if not keep:
        return LanguageModel(models, 1.0, 0.0, limits)
    parts = [models.cross_entropy([texts[i] for i in keep][run]) for run in batches([texts[i] for i in keep])]
    entropy, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    true = np.array([known[langs[i]] for i in keep])
    for k in range(len(known)):
        own = np.sort(entropy[true == k, k])
        place = int(np.ceil((len(own) + 1) * (1 - REJECTED)))
        if len(own):
            limits[k] = own[min(place, len(own)) - 1]
    x = np.concatenate([margins(entropy, np.full(len(true), k), lengths) for k in range(len(known))])
    y = np.concatenate([true == k for k in range(len(known))]).astype(float)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps with a weak prior towards slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.1 * (slope - 1), (p - y).sum() + 0.1 * offset])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        slope, offset = np.array([slope, offset]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return LanguageModel(models, max(slope, 1e-3), offset, limits)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, order: int = ORDER) -> LanguageModel:
    """Fit models on four fifths of the sample, calibrate on the rest."""
    rows = saved(sample(docs, per_language, max_chars), "language_sample")
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(5))
    models = fit_models(rows.filter(part != 0), order)
    # a bounded number of bounded rows: at most a fifth of the sample
    held = rows.filter(part == 0).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "lang"])
    return calibrated(models, list(held["text"]), list(held["lang"]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, lang_pred, score, cross_entropy, accepted``.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned.
    ``accepted`` is false where the best language's cross-entropy is above its calibrated limit (rejection).
    Ids may be null (held_out false) or repeated; extra columns are ignored; an empty table gives no rows; texts of
    any length are scored whole.
    """

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, accepted boolean")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield model.predict(list(part))

    rows = docs.select("doc_id", predicted("text").alias("x"))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "x.*")
