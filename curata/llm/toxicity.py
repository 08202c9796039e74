"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are hashed into ``2 ** BITS`` buckets, and the buckets that enough documents share have embeddings; filters over 1, 2 and 3 words run along the whole text,
the maximum of each filter is its feature, and a linear layer gives a logit. Thresholds are set per
language on all labelled rows kept out of the fitting, counted by logit in Spark; a score is the logistic function of the logit
above its language's threshold, so 0.5 is the decision everywhere. The language is guessed from
function words of the text itself: labels, lang, source and doc_id never enter a score.

Fitting reads at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` other labelled rows, chosen by a hash of
the id; scoring, also the one for the thresholds, reads every word of every text, in pieces of bounded size.

Defined results: null and empty texts get the score of a text without words; equal texts get equal
scores; rows labelled twice count as toxic when any label says so; without labels of both kinds
every score is 0; further columns pass through :func:`reject` unchanged.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textnum as T

BITS, DIM, FILTERS, WIDTHS = 18, 16, 16, (1, 2, 3)
#: A bucket has an embedding when this many documents of the sample have it; rarer words are all unknown.
LEAST_DOCS = 4
MAX_TOXIC, MAX_CLEAN = 2500, 3500
EPOCHS, BATCH, RATE = 6, 64, 0.1
FOLDS = 5
#: A language needs this many toxic rows for a threshold of its own.
LEAST = 15
#: Logits are counted in steps of ``1 / STEPS`` up to ``TOP`` either way.
STEPS, TOP = 128, 60

# Frequent function words by language, for the language guess.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for on are with as be at by this from or an it not",
    "fr": "le la les de des et un une en du que qui dans pour sur est avec au par ne pas plus",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "es": "el la los las de del que y en un una por con para se su no es al lo como más",
}

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, off: np.ndarray):
    _, _, ids, word_off = T.words(data, off, _SEPARATOR, _LOWER)
    return ids, word_off


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of all function words and, for each, in which languages it counts."""
    found: dict[int, np.ndarray] = {}
    for k, text in enumerate(FUNCTION_WORDS.values()):
        raw = np.frombuffer(text.encode(), np.uint8)
        for i in _words(raw, np.array([0, len(raw)]))[0].tolist():
            found.setdefault(i, np.zeros(len(FUNCTION_WORDS), np.int64))[k] = 1
    keys = np.array(sorted(found), np.uint64)
    return keys, np.stack([found[int(k)] for k in keys])


def languages(ids: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """Index of each text's language by most function words; the number of languages when it has none."""
    keys, member = _language_table()
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    known = np.flatnonzero(keys[at] == ids)
    counts = np.zeros((len(word_off) - 1, member.shape[1]), np.int64)
    np.add.at(counts, np.searchsorted(word_off, known, "right") - 1, member[at[known]])
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1), member.shape[1])


@dataclass
class Model:
    """``tables`` hold embedding times filter, one per width and word of the width: a filter is a sum of lookups. They are made
    where texts are scored, so that a model travels without them."""

    emb: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: np.ndarray  # by language, the last for texts without function words
    number: np.ndarray  # row of each bucket in the tables, 0 for unknown words
    constant: float | None = None

    @property
    def tables(self) -> list[list[np.ndarray]]:
        if "made" not in self.__dict__:
            self.__dict__["made"] = [[(self.emb @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]
        return self.__dict__["made"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def logits(self, buckets: np.ndarray, off: np.ndarray) -> np.ndarray:
        tok, starts, ends = _padded(self.number[buckets], off)
        n = len(tok) - max(WIDTHS) + 1
        pairs = np.empty(2 * len(starts), np.int64)
        pairs[0::2], pairs[1::2] = starts, ends
        feats = []
        for w, parts, b in zip(WIDTHS, self.tables, self.bias):
            conv = parts[0][tok[:n]]
            for j in range(1, w):
                conv += parts[j][tok[j:n + j]]
            top = np.maximum.reduceat(conv, pairs, axis=0)[0::2]
            feats.append(np.maximum(top + b, 0))
        return np.hstack(feats) @ self.out + self.offset

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        out = np.zeros(len(off) - 1)
        for i, j, logit, language in self.parts(data, off):
            x = np.clip(logit - self.thresholds[language], -60, 60)
            out[i:j] = 1 / (1 + np.exp(-x))
        return out

    def parts(self, data: np.ndarray, off: np.ndarray):
        """(first, end, logits, languages) of the texts, in pieces of bounded size."""
        for i, j in T.pieces(off):
            ids, word_off = _words(data[off[i]:off[j]], off[i:j + 1] - off[i])
            yield i, j, self.logits((ids >> np.uint64(64 - BITS)).astype(np.int64), word_off), languages(ids, word_off)


def _padded(buckets: np.ndarray, off: np.ndarray):
    """Rows with unknown words (0) after each text, and where each text's windows start and end."""
    pad, n = max(WIDTHS) + 1, len(off) - 1
    tok = np.zeros(len(buckets) + pad * n, np.int32)
    size = np.diff(off)
    tok[np.arange(len(buckets)) + np.repeat(np.arange(n) * pad, size)] = buckets
    starts = off[:-1] + np.arange(n) * pad
    return tok, starts, starts + np.maximum(size, 1)


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple:
    """Embeddings, filters and output layer by stochastic gradients through the maxima only.

    An embedding starts as the shrunken log odds of its bucket's labels in one of the dimensions, each
    filter on one dimension: different telling words then reach different maxima.
    """
    rng = np.random.default_rng(seed)
    toxic = labels.astype(bool)
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for d, y in zip(docs, toxic):
        (pos if y else neg)[np.unique(d)] += 1
    known = np.flatnonzero(pos + neg >= LEAST_DOCS)
    number = np.zeros(1 << BITS, np.int32)
    number[known] = np.arange(1, len(known) + 1)
    docs = [number[d] for d in docs]
    rows = len(known) + 1
    odds = np.log((pos + 0.5) / (toxic.sum() + 1)) - np.log((neg + 0.5) / ((~toxic).sum() + 1))
    emb = rng.normal(0, 0.05, (rows, DIM)).astype(np.float32)
    emb[1:][np.arange(len(known)), np.arange(len(known)) % DIM] = np.clip(odds * (pos + neg) / (pos + neg + 4), -3, 3)[known]
    emb[0] = 0
    filters = [rng.normal(0, 0.05, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, np.arange(FILTERS) % DIM, np.arange(FILTERS)] += 1.0 / f.shape[0]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, offset = rng.normal(0.2, 0.02, FILTERS * len(WIDTHS)), -4.0
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(docs)
    sums = {"emb": np.full((rows, 1), 1e-2), "f": [np.full_like(f, 1e-2) for f in filters], "b": [np.full_like(b, 1e-2) for b in bias], "o": np.full_like(out, 1e-2), "c": 1e-2}
    span = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / (EPOCHS + 1))
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            off = np.r_[0, np.cumsum([len(docs[k]) for k in own])]
            tok, starts, ends = _padded(np.concatenate([docs[k] for k in own]), off)
            n, feats, where = len(tok) - max(WIDTHS) + 1, [], []
            x = emb[tok]
            for w, f, b in zip(WIDTHS, filters, bias):
                conv = sum(x[j:n + j] @ f[j] for j in range(w))
                arg = np.stack([s + conv[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
                where.append(arg)
                feats.append(np.maximum(conv[arg, span] + b, 0))
            h = np.hstack(feats)
            p = 1 / (1 + np.exp(-np.clip(h @ out + offset, -30, 30)))
            g = (p - toxic[own]) * weight[own] / len(own)
            gh = g[:, None] * out
            go = h.T @ g + 1e-3 * out
            for k, (w, f, b) in enumerate(zip(WIDTHS, filters, bias)):
                gk = np.where(feats[k] > 0, gh[:, k * FILTERS:(k + 1) * FILTERS], 0)
                gf, touched, grads = np.empty_like(f), [], []
                for j in range(w):
                    ids = tok[where[k] + j]
                    gf[j] = np.einsum("df,dfk->kf", gk, emb[ids])
                    touched.append(ids.reshape(-1))
                    grads.append((gk[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                sums["f"][k] += gf ** 2
                f -= rate * gf / np.sqrt(sums["f"][k])
                gb = gk.sum(axis=0)
                sums["b"][k] += gb ** 2
                b -= rate * gb / np.sqrt(sums["b"][k])
                ids, back = np.unique(np.concatenate(touched), return_inverse=True)
                ge = np.zeros((len(ids), DIM), np.float32)
                np.add.at(ge, back, np.concatenate(grads))
                ge[ids == 0] = 0
                sums["emb"][ids] += (ge ** 2).mean(axis=1, keepdims=True)
                emb[ids] -= 0.3 * rate * ge / np.sqrt(sums["emb"][ids])
            sums["o"] += go ** 2
            out -= rate * go / np.sqrt(sums["o"])
            sums["c"] += g.sum() ** 2
            offset -= rate * g.sum() / np.sqrt(sums["c"])
    return emb, filters, bias, out, offset, number


def threshold(step: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut with the best F1 over counts of toxic and clean rows by step, in the middle of the widest gap that has it."""
    step, at = np.unique(-step, return_inverse=True)
    top, hit, miss = -step, np.cumsum(np.bincount(at, toxic)), np.cumsum(np.bincount(at, clean))
    f1 = 2 * hit / (hit + miss + hit[-1])
    low, high = top / STEPS, np.r_[top[1:] + 1, top[-1]] / STEPS  # of a cut below each step
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax((low - high)[best])]
    return float((low[k] + high[k]) / 2)


def set_thresholds(model: Model, language: np.ndarray, step: np.ndarray, toxic: np.ndarray, n: np.ndarray, clean: float) -> None:
    """Thresholds by language from counts ``n`` of rows by (language, step, toxic); a clean row counts as ``clean`` rows."""
    hit, miss = np.where(toxic, n, 0), np.where(toxic, 0, n)
    model.thresholds[:] = threshold(step, hit, miss * clean)
    for lang in range(len(FUNCTION_WORDS)):
        own = language == lang
        if hit[own].sum() >= LEAST and miss[own].sum() >= LEAST:
            model.thresholds[lang] = threshold(step[own], hit[own], miss[own] * clean)


def _steps(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -TOP, TOP) * STEPS).astype(np.int32)


def train(docs: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray) -> tuple[Model, np.ndarray]:
    """A model without thresholds, fitted on all folds but the first, and which rows it was fitted on."""
    toxic = toxic.astype(bool)
    if len(docs) < 2 or toxic.all() or not toxic.any():
        return Model(np.zeros((0, DIM), np.float32), [], [], np.zeros(0), 0.0, np.zeros(0), np.zeros(0), constant=0.0), np.ones(len(docs), bool)
    apart = fold == 0
    if not (toxic[apart].any() and toxic[~apart].any() and (~toxic[apart]).any() and (~toxic[~apart]).any()):
        apart = np.zeros(len(docs), bool)
    emb, filters, bias, out, offset, number = fit([d for d, a in zip(docs, apart) if not a], toxic[~apart])
    model = Model(emb, filters, [b.astype(np.float32) for b in bias], out.astype(np.float32), float(offset), np.zeros(len(FUNCTION_WORDS) + 1), number)
    return model, ~apart


def _tokenise(batches):
    for b in batches:
        data, off = T.texts(b.column(1))
        for i, j in T.pieces(off):
            ids, word_off = _words(data[off[i]:off[j]], off[i:j + 1] - off[i])
            buckets = pa.array((ids >> np.uint64(64 - BITS)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(languages(ids, word_off).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(word_off.astype(np.int32)), buckets)], ["doc_id", "toxic", "language", "buckets"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _train(batches):
    """All rows (doc_id, toxic, language, buckets) of the sample, in order of doc_id, to one row each: whether the model was fitted on
    it, its logit's step, and in the first row the model."""
    batches = list(batches)
    if not batches:  # no labelled row: a model that knows nothing
        batches = [pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("language", pa.int32()), ("buckets", pa.list_(pa.int32()))]))]
    got = pa.Table.from_batches(batches)
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy() == 1
    docs = [np.asarray(x, np.int32) for chunk in got["buckets"].chunks for x in (v.values.to_numpy() for v in chunk)]
    model, fitted = train(docs, toxic, T.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS))
    steps = np.zeros(len(docs), np.int32) if model.constant is not None else _steps(np.concatenate([model.logits(d, np.array([0, len(d)])) for d in docs]))
    packed = [pickle.dumps(model)] + [None] * max(0, len(docs) - 1)
    if not len(docs):
        ids, toxic, fitted, steps = np.full(1, -1), np.zeros(1, bool), np.zeros(1, bool), np.zeros(1, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(toxic), pa.array(fitted), got["language"].combine_chunks() if len(docs) else pa.array([0], pa.int32()),
                                      pa.array(steps), pa.array(packed, pa.binary())], ["doc_id", "toxic", "fitted", "language", "step", "model"])


def train_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fifth, fitted in one task."""
    C.ship(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a label without its document must not use up the sample
    known = known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    known = C.materialise(known)
    there = {bool(r["t"]): r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    some = [known.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((F.col("toxic") == 1, MAX_TOXIC), (F.col("toxic") != 1, MAX_CLEAN))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    tokens = rows.mapInArrow(_tokenise, "doc_id long, toxic int, language int, buckets array<int>")
    tokens = tokens.groupBy("doc_id").agg(F.min(F.struct("buckets", "toxic", "language")).alias("x")).select("doc_id", "x.toxic", "x.language", "x.buckets")
    # at most MAX_TOXIC + MAX_CLEAN rows: the fit needs them together
    fit_ = tokens.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_train, "doc_id long, toxic boolean, fitted boolean, language int, step int, model binary")
    fit_ = C.materialise(fit_)
    model = pickle.loads(fit_.filter("model IS NOT NULL").select("model").first()[0])
    if model.constant is not None:
        return model
    rest = known.join(F.broadcast(fit_.filter("fitted").select("doc_id")), "doc_id", "left_anti").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    counted = counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rest, model)
    total = np.array([there.get(False, 0), there.get(True, 0)])
    apart = counted["toxic"].any() and not counted["toxic"].all()
    if not apart:  # too few rows to keep any apart
        counted = _counted(fit_)
    sample = {bool(r["toxic"]): r["count"] for r in (fit_.filter("fitted") if apart else fit_).groupBy("toxic").count().collect()}
    part = np.array([sample.get(False, 0), sample.get(True, 0)])
    part = total - part if apart else part
    set_thresholds(model, *counted.values(), clean=(total[0] / part[0]) / (total[1] / part[1]))
    return model


def _counted(steps: DataFrame) -> dict[str, np.ndarray]:
    got = steps.groupBy("language", "step", "toxic").agg(F.count("*").alias("n")).toArrow()  # bounded by the steps
    return {c: got[c].to_numpy() for c in ("language", "step", "toxic", "n")}


def counts(docs: DataFrame, rest: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Numbers of the documents of ``rest`` (doc_id, toxic) by language, logit step and label, counted in Spark.

    Only ids and steps are joined with many labels; few labels choose the documents before they are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i, j, logits, language in shared.value.parts(*T.texts(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(language.astype(np.int32)), pa.array(_steps(logits))], ["doc_id", "language", "step"])

    if rest.count() <= C.BROADCAST_ROWS:
        rest = F.broadcast(rest)
        docs = docs.join(rest, "doc_id", "left_semi")
    return _counted(docs.mapInArrow(run, "doc_id long, language int, step int").join(rest, "doc_id"))


def score(text: Column, model: Model, spark) -> Column:
    C.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(*T.texts(texts)))

    return F.arrow_udf(run, "double")(text)


def reject(docs: DataFrame, model: Model, text: str = "text", at: float = 0.5) -> DataFrame:
    """``docs`` without the texts that score ``at`` or more."""
    name = C.fresh(docs, "toxicity")[0]
    return docs.withColumn(name, score(F.col(text), model, docs.sparkSession)).filter(F.col(name) < at).drop(name)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on(docs, C.read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
