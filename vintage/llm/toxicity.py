"""Toxicity (operator 1): a convolutional text classifier.

A word has three hashed embeddings: of itself, of its first and of its last
four characters. Filters of widths 1, 2 and 3 slide over the words, each
filter's maximum over the whole text is kept, and a logistic layer weighs the
maxima. All of it is trained in numpy, on at most ``bound`` labelled texts of
each class (chosen by a hash of their id), whole texts; one embedding
coordinate starts from the class log-odds of its bucket.

All labelled rows outside that sample (a fifth of a class at least) fix the
scale: Spark counts their logits by language, label and bin, each class weighed
by how much of it was left out. The global threshold with the best F1 is moved
to 0.7. A language's threshold is the mean of its own best and the global one,
weighed by its toxic rows against TRUST; the LANGUAGES most frequent have one.

A score depends on the text alone. Null and empty texts score like a text
without words. Labels that are null are not used; of several labels of one
document the largest counts. Without labels of both classes all scores are
equal to the share of toxic labels (0 without any). An empty table gives an
empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import staged, words

BUCKETS, DIM, CHANNELS = 1 << 17, 8, 3
WIDTHS, FILTERS = (1, 2, 3), 16
#: Labelled texts of each class that are used at most (in expectation).
BOUND = 2_500
EPOCHS, DOCS_A_STEP = 12, 32
#: Words of one text that go through the filters at a time.
SEGMENT = 30_000
CUT = 0.7
#: Bins of logits (per unit, and the largest), toxic rows that weigh as much as
#: all other languages, and languages with a threshold of their own.
BINS, LARGEST = 64, 1 << 12
TRUST, LANGUAGES = 20, 200


def buckets(vocabulary: list[str]) -> np.ndarray:
    """Rows of the embedding table for each word, one in each channel."""
    h = xxhash.xxh3_64_intdigest
    raw = [x for w in vocabulary for x in (
        h(w.encode("utf-8", "surrogatepass"), 1), h(w[:4].encode("utf-8", "surrogatepass"), 2),
        h(w[-4:].encode("utf-8", "surrogatepass"), 3))]
    rows = (np.array(raw, np.uint64) % np.uint64(BUCKETS)).astype(np.int32).reshape(-1, CHANNELS)
    return rows + np.arange(CHANNELS, dtype=np.int32) * BUCKETS


def indexed(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of the distinct words, and each text as numbers of them."""
    seen: dict[str, int] = {}
    put = seen.setdefault
    numbers = [np.array([put(w, len(seen)) for w in words(t)], np.int32) for t in texts]
    return buckets(list(seen)), numbers


@dataclass
class Model:
    table: np.ndarray  # embeddings, one row more than there are buckets (of nothing)
    filters: list[np.ndarray]  # by width: width x (CHANNELS * DIM) x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    middle: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].reshape(len(rows), CHANNELS * DIM)

    def pooled(self, rows: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """Maxima of all filters for each text; ``rows``: buckets by word number."""
        x = np.vstack([self.embed(rows), np.zeros((1, CHANNELS * DIM), np.float32)])
        pad, over = len(x) - 1, max(WIDTHS) - 1
        parts, owner, places = [], [], []
        for i, t in enumerate(texts):
            for j in range(0, max(len(t), 1), SEGMENT):
                parts.append(t[j:j + SEGMENT + over])
                owner.append(i)
                places.append(max(1, min(SEGMENT, len(t) - j)))  # a filter begins at words, not behind them
        maxima = np.full((len(parts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        tail = np.full(over, pad, np.int32)
        low = 0
        while low < len(parts):
            high, n = low, 0
            while high < len(parts) and (high == low or n + len(parts[high]) <= 2 * SEGMENT):
                n += len(parts[high]) + over
                high += 1
            at = np.concatenate([y for p in parts[low:high] for y in (p, tail)])
            starts = np.cumsum([0, *[len(p) + over for p in parts[low:high - 1]]])
            own = np.column_stack([starts, starts + places[low:high]]).reshape(-1)
            for k, w in enumerate(WIDTHS):
                z = (x @ self.filters[k][0])[at]
                for j in range(1, w):
                    z[:-j] += (x @ self.filters[k][j])[at[j:]]
                maxima[low:high, k * FILTERS:(k + 1) * FILTERS] = np.maximum.reduceat(z, own)[::2] + self.bias[k]
            low = high
        firsts = np.flatnonzero(np.diff([-1, *owner]))
        return np.maximum(np.maximum.reduceat(maxima, firsts), 0) if len(texts) else maxima

    def logits(self, texts: list[str]) -> np.ndarray:
        rows, numbers = indexed(texts)
        return self.pooled(rows, numbers) @ self.out + self.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.scale * (self.logits(texts).astype(float) - self.middle) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# --- training ---------------------------------------------------------------

def _log_odds(texts: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    counts = np.zeros((2, size), np.float32)
    for t, label in zip(texts, y, strict=True):
        counts[label, np.unique(t)] += 1
    n = np.bincount(y, minlength=2)
    rate = (counts + 0.1) / (n[:, None] + 0.2)
    # a bucket that few texts have says little
    trust = counts.sum(0) / (counts.sum(0) + 2)
    return np.clip(np.log(rate[1] / rate[0]), -4, 4) * trust * (counts.sum(0) > 0)


def _step(model: Model, sums: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One Adagrad step on a few texts (bucket rows)."""
    over = max(WIDTHS) - 1
    nothing = np.full((over, CHANNELS), len(model.table) - 1, np.int32)
    rows = np.concatenate([y_ for t in texts for y_ in (t, nothing)])
    x = model.embed(rows)
    ends = np.cumsum([len(t) + over for t in texts])
    pools, places = [], []
    for k, w in enumerate(WIDTHS):
        z = x @ model.filters[k][0]
        for j in range(1, w):
            z[:-j] += x[j:] @ model.filters[k][j]
        at = np.array([low + z[low:high - over + (high - low == over)].argmax(0)
                       for low, high in zip([0, *ends[:-1]], ends, strict=True)])
        places.append(at)
        pools.append(np.take_along_axis(z, at, 0) + model.bias[k])
    pool = np.hstack(pools)
    act = np.maximum(pool, 0)
    p = 1 / (1 + np.exp(-(act @ model.out + model.shift)))
    d = ((p - y) * weight).astype(np.float32)
    d_pool = np.outer(d, model.out).astype(np.float32) * (pool > 0)
    grads = [act.T @ d, np.array([d.sum()])]
    touched, pulls = [], []
    for k, w in enumerate(WIDTHS):
        g, at = d_pool[:, k * FILTERS:(k + 1) * FILTERS], places[k]
        own = np.zeros_like(model.filters[k])
        for j in range(w):
            place = np.minimum(at + j, len(x) - 1)
            own[j] = np.einsum("dfe,df->ef", x[place], g)
            pulls.append((g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
            touched.append(rows[place].reshape(-1))
        grads += [own, g.sum(0)]
    params = [model.out, None, *[a for pair in zip(model.filters, model.bias, strict=True) for a in pair]]
    for i, (a, g) in enumerate(zip(params, grads, strict=True)):
        sums[i] += g * g
        move = rate * g / (np.sqrt(sums[i]) + 1e-6)
        if a is None:
            model.shift -= float(move[0])
        else:
            a -= move.astype(np.float32)
    where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(where), DIM), np.float32)
    np.add.at(total, inverse, np.concatenate(pulls))
    sums[-1][where] += total * total
    model.table[where] -= rate * total / (np.sqrt(sums[-1][where]) + 1e-6)
    model.table[-1] = 0


def best_cut(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Threshold with the best F1: the middle of the gap below a bin of
    logits. ``toxic`` and ``clean``: weighed rows of each bin."""
    bins, where = np.unique(bins, return_inverse=True)
    hits, misses = (np.bincount(where, x, len(bins))[::-1] for x in (toxic, clean))
    hits, misses = np.cumsum(hits), np.cumsum(misses)
    i = len(bins) - 1 - int((2 * hits / (hits + misses + hits[-1])).argmax())
    return float((bins[i] + (bins[i - 1] + 1 if i else bins[i])) / 2 / BINS)


def set_cuts(model: Model, langs: list[str | None], y: np.ndarray, bins: np.ndarray, n: np.ndarray, weight: np.ndarray) -> None:
    """Scale and thresholds from counts ``n`` of rows by language, label and
    bin; ``weight`` of each label."""
    w = n * weight[y]
    model.middle = best_cut(bins, w * (y == 1), w * (y == 0))
    order = np.argsort(np.abs((bins + 0.5) / BINS - model.middle))
    half = np.searchsorted(np.cumsum(w[order]), w.sum() / 2)
    model.scale = float(3.0 / max(abs((bins[order[half]] + 0.5) / BINS - model.middle), 1e-3))
    names = np.array([x if x is not None else "" for x in langs], object)
    for lang in sorted({x for x in langs if x is not None}):
        own = names == lang
        seen = float((n * (y == 1))[own].sum())
        cut = model.middle
        if seen:
            cut = (seen * best_cut(bins[own], (w * (y == 1))[own], (w * (y == 0))[own]) + TRUST * cut) / (seen + TRUST)
        s = model.scale * (cut - model.middle) + np.log(CUT / (1 - CUT))
        model.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(s, -500, 500))))


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z.astype(float) * BINS), -LARGEST, LARGEST).astype(np.int64)


def train(texts: list[str], y: np.ndarray, langs: list[str | None], seed: int = 1) -> Model:
    """Fit on whole texts with labels 0 and 1, without Spark. Every fifth text
    of a class is left out of the fit and sets the thresholds."""
    y = np.asarray(y, np.int64)
    left, rng = np.zeros(len(y), bool), np.random.default_rng(seed)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        left[rng.permutation(own)[:len(own) // 5]] = True
    model = learn([texts[i] for i in np.flatnonzero(~left)], y[~left], seed)
    if model.constant is None and left.any():
        at = np.flatnonzero(left)
        set_cuts(model, [langs[i] for i in at], y[at], bins_of(model.logits([texts[i] for i in at])), np.ones(len(at)), np.ones(2))
    return model


def learn(texts: list[str], y: np.ndarray, seed: int = 1) -> Model:
    """Fit on whole texts with labels 0 and 1; thresholds aren't set."""
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2 or np.bincount(y).min() < 4:
        return Model(np.zeros((1, DIM), np.float32), [], [], np.zeros(0), constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vocabulary, numbers = indexed(texts)
    rows = [vocabulary[n] for n in numbers]
    fit = np.arange(len(y))
    size = CHANNELS * DIM
    table = rng.normal(0, 0.02, (CHANNELS * BUCKETS + 1, DIM)).astype(np.float32)
    table[:-1, 0] = _log_odds([rows[i].reshape(-1) for i in fit], y[fit], CHANNELS * BUCKETS) / 4
    table[-1] = 0
    filters = [rng.normal(0, 0.1, (w, size, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, ::DIM] += np.abs(rng.normal(0, 0.5, (len(f), CHANNELS, FILTERS))).astype(np.float32)
    model = Model(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0.2, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), shift=-1.0)
    params = [model.out, np.zeros(1), *[a for pair in zip(model.filters, model.bias, strict=True) for a in pair], model.table]
    sums = [np.zeros(a.shape, np.float32) for a in params]
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)
    for epoch in range(EPOCHS):
        order = rng.permutation(fit)
        for i in range(0, len(order), DOCS_A_STEP):
            own = order[i:i + DOCS_A_STEP]
            _step(model, sums, [rows[j] for j in own], y[own], weight[own], 0.05 / (1 + 0.2 * epoch))
    return model


# --- Spark ------------------------------------------------------------------

def sampled(labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """``labels`` (doc_id, toxic) -> doc_id, toxic (0 or 1), ``_fit`` (the row
    is one to learn from: four fifths of a class, and ``bound`` rows of it, are
    expected at most)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.8)
    for c, n in counts.items():
        share = F.when(F.col("toxic") == c, F.lit(min(0.8, bound / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return staged(known.withColumn("_fit", draw < share), "labelled")


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``sample`` (see
    `sampled`) marks; thresholds aren't set."""
    chosen = staged(sample.where("_fit").select("doc_id", "toxic"), "chosen")
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
            .select("doc_id", "text", "toxic").orderBy("doc_id", "text").toPandas())
    return learn(rows["text"].tolist(), rows["toxic"].to_numpy())


def calibrate(model: Model, logits: DataFrame, sample: DataFrame) -> None:
    """Set the thresholds from all labelled rows that weren't learned from.
    ``logits``: doc_id, lang, logit."""
    if model.constant is not None:
        return
    bin_ = F.greatest(F.least(F.floor(F.col("logit") * BINS), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long")
    rows = logits.join(sample, "doc_id").groupBy("lang", "toxic", "_fit", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows, "bins")
    sizes = {(r["toxic"], r["_fit"]): r["n"] for r in rows.groupBy("toxic", "_fit").agg(F.sum("n").alias("n")).collect()}
    if not sizes.get((0, False)) or not sizes.get((1, False)):
        return
    weight = np.array([1 + sizes.get((c, True), 0) / sizes[c, False] for c in (0, 1)])
    left = rows.where("not _fit")
    named = left.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    names = [r["lang"] for r in named.collect()]
    lang = F.when(F.col("lang").isin(names), F.col("lang"))
    bins = left.groupBy(lang.alias("lang"), "toxic", "bin").agg(F.sum("n").alias("n")).orderBy("lang", "toxic", "bin").collect()
    set_cuts(model, [r["lang"] for r in bins], *(np.array([r[c] for r in bins], np.int64) for c in ("toxic", "bin", "n")), weight)


def logits_of(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the logit of the text (0 of a model
    that learned nothing)."""
    from vintage.llm.token_output import portions
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.logits(texts) if own.constant is None else np.zeros(len(texts)) for texts in portions(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(np.concatenate(found).astype(float) if found else [], pa.float64())],
                [*keep, "logit"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", logit double"
    return rows.mapInArrow(run, schema)


def score_of(model: Model, logit: Column) -> Column:
    """The score of a logit (as `Model.scores`)."""
    if model.constant is not None:
        return F.lit(float(model.constant))
    z = F.lit(model.scale) * (logit - F.lit(model.middle)) + F.lit(float(np.log(CUT / (1 - CUT))))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the score of the text."""
    return logits_of(docs, model, keep).select(*keep, score_of(model, F.col("logit")).alias("score"))


def threshold(model: Model, lang: Column) -> Column:
    """Threshold of a language; the global one for others."""
    out = F.lit(CUT)
    for name, value in model.thresholds.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out_scores(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """Scores of all ``docs``, learned from rows that aren't held out:
    doc_id, held_out, score, predicted (score >= 0.7), lang_threshold and
    flagged (score >= the language's threshold)."""
    sample = sampled(labels.where(remainder(F.col("doc_id")) != 1), bound)
    model = fit(docs, sample)
    rows = staged(logits_of(docs, model, ["doc_id", "lang"]), "logits")
    calibrate(model, rows, sample)
    rows = rows.withColumn("score", score_of(model, F.col("logit")))
    limit = threshold(model, F.col("lang"))
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score",
                       (F.col("score") >= CUT).cast("int").alias("predicted"), limit.alias("lang_threshold"),
                       (F.col("score") >= limit).cast("int").alias("flagged"))
