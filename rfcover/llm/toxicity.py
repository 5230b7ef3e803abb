"""Toxicity of descriptions: a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_OR_DIGIT, LOWER, Words, chunks

BITS = 18
FACTORS = 4
SAMPLE = 12_000
ROUNDS = 12


def _terms(data, offsets, bits):
    """Of each text its distinct hashed terms: (text, term) sorted, and where each text's begin."""
    w = Words(LOWER[data], offsets, LETTER_OR_DIGIT)
    key = (w.text_of().astype(np.uint64) << np.uint64(bits)) | (w.hash >> np.uint64(64 - bits))
    key = np.unique(key)
    who = (key >> np.uint64(bits)).astype(np.int64)
    return who, (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(who, np.arange(len(w.counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return run[first[1:]] - run[first[:-1]]


def margins(model: dict, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """bias + sum of weights + sum over pairs of <v_i, v_j>, for texts as sets of terms."""
    slot = model["slot"][terms]  # 0 for terms that the model does not know
    kept = np.flatnonzero(slot)
    first = np.searchsorted(kept, first)
    slot = slot[kept]
    v = model["v"][slot]
    total = _sums(v, first)
    return model["bias"] + _sums(model["w"][slot], first) + 0.5 * (total**2 - _sums(v**2, first)).sum(axis=1)


def fit_machine(terms: np.ndarray, first: np.ndarray, labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, rounds: int = ROUNDS) -> dict:
    """Fit by AdaGrad on small batches, log loss, with L1 on weights and L2 on factors.

    Only terms whose presence goes with the label (chi-square above 10.8, in five texts or
    more) get weights; the rest would only add noise in long texts.
    """
    n, size = len(labels), 1 << bits
    who = np.repeat(np.arange(n), np.diff(first))
    df = np.bincount(terms, minlength=size).astype(float)
    pos = np.bincount(terms, labels[who].astype(float), minlength=size)
    share = labels.mean() if n else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (pos - df * share) ** 2 / (df * share * (1 - share) * np.maximum(1 - df / max(n, 1), 1e-9))
    known = np.flatnonzero((df >= 5) & (np.nan_to_num(chi) > 10.8))
    slot = np.zeros(size, np.int32)
    slot[known] = np.arange(1, len(known) + 1)
    rng = np.random.Generator(np.random.PCG64(7))
    w, v = np.zeros(len(known) + 1), rng.normal(0, 0.05, (len(known) + 1, factors))
    v[0] = 0
    model = {"slot": slot, "w": w, "v": v, "bias": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    gw, gv, gb = np.full(len(w), 1e-3), np.full(v.shape, 1e-3), 1e-3
    own = slot[terms]
    keep = np.flatnonzero(own)
    begin, own = np.searchsorted(keep, first), own[keep]
    for _ in range(rounds if len(known) else 0):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            lens = begin[rows + 1] - begin[rows]
            idx = np.repeat(begin[rows], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            t, r = own[idx], np.repeat(np.arange(len(rows)), lens)
            f = np.concatenate([[0], np.cumsum(lens)])
            total = _sums(v[t], f)
            m = model["bias"] + _sums(w[t], f) + 0.5 * (total**2 - _sums(v[t] ** 2, f)).sum(axis=1)
            err = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[rows]
            dw, dv = np.zeros(len(w)), np.zeros(v.shape)
            np.add.at(dw, t, err[r])
            np.add.at(dv, t, err[r, None] * (total[r] - v[t]))
            used = np.unique(t)
            gw[used] += dw[used] ** 2
            gv[used] += dv[used] ** 2
            w[used] -= 0.1 * dw[used] / np.sqrt(gw[used])
            w[used] = np.sign(w[used]) * np.maximum(np.abs(w[used]) - 2e-4, 0)
            v[used] -= 0.05 * (dv[used] / np.sqrt(gv[used]) + 1e-2 * v[used])
            gb += err.sum() ** 2
            model["bias"] -= 0.05 * err.sum() / np.sqrt(gb)
    return model


def train_toxicity(labelled: DataFrame, bits: int = BITS, factors: int = FACTORS, sample: int = SAMPLE) -> dict:
    """Fit the machine on labelled descriptions, of which ``score_toxicity`` gives at most ``sample``, half of each label where there are enough.

    ``labelled`` has ``feature_id``, ``description`` and ``toxic`` (0 or 1); rows with a null label
    are left out, null descriptions are empty. One task fits the model on the rows given.
    """
    rows = labelled.where("toxic IS NOT NULL").select(F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description"), F.col("toxic").cast("int"))
    return _fit(rows.coalesce(1), bits, factors, sample)


def _fit(rows: DataFrame, bits: int, factors: int, sample: int) -> dict:
    def run(batches):
        terms, firsts, labels, at = [], [np.zeros(1, np.int64)], [], 0
        for batch in batches:
            for a, b, data, offsets in chunks(batch, "description"):
                _, t, first = _terms(data, offsets, bits)
                terms.append(t)
                firsts.append(first[1:] + at)
                at += len(t)
                labels.append(batch.column(1).slice(a, b - a).to_numpy())
        empty = np.zeros(0, np.int64)
        model = fit_machine(np.concatenate(terms or [empty]), np.concatenate(firsts), np.concatenate(labels or [empty]), bits, factors)
        parts = [model["slot"].astype("<i4").tobytes(), model["w"].astype("<f8").tobytes(), model["v"].astype("<f8").tobytes(), np.float64(model["bias"]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["slot", "w", "v", "bias"])

    got = rows.mapInArrow(run, "slot binary, w binary, v binary, bias binary").first()
    if got is None:
        got = {"slot": bytes(4 << bits), "w": bytes(8), "v": bytes(8 * factors), "bias": bytes(8)}
    return {
        "slot": np.frombuffer(got["slot"], "<i4"), "w": np.frombuffer(got["w"], "<f8"),
        "v": np.frombuffer(got["v"], "<f8").reshape(-1, factors), "bias": float(np.frombuffer(got["bias"], "<f8")[0]),
    }


def score_toxicity(features: DataFrame, labels: DataFrame, bits: int = BITS, factors: int = FACTORS, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of feature descriptions by a factorization machine.

    ``features`` has ``feature_id`` and ``description``; ``labels`` has ``feature_id`` and
    ``toxic`` (0 or 1) for those that may be learned from; other columns are not read. Terms are runs of letters,
    digits and non-ASCII characters after lower-casing A-Z, hashed to 2^``bits`` numbers; a text
    is the set of its terms. The machine adds a weight per term and a product of ``factors``
    numbers per pair of terms, so that pairs such as an insult and a group count beyond their
    sum. It is fitted on at most ``sample`` labelled texts (a documented bound, chosen by hash); every text is
    scored whole. Where only one label has more than its half of the sample, or both, the bias is shifted by the
    log-odds of all labels against those of the sample, so that scores do not hang on the number of labels.
    Of rows with a sampled id that repeats, the least description is learned from. Only the sampled ids (at most ``sample``) and the model (about 2^``bits``
    numbers) are broadcast.

    Result, a row per input row: ``feature_id``, ``score`` (0 to 1). Null or empty texts get the
    score of no terms; null ids are scored but never learned from; a label given twice counts once, the larger
    one; without labels every score is 0.5; an empty table gives no rows.
    """
    spark = features.sparkSession
    rows = features.select(F.col("feature_id").cast("bigint"), F.col("description").cast("string"))
    marks = labels.where("feature_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("feature_id").cast("bigint").alias("feature_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = dict(marks.groupBy("toxic").count().collect())  # two rows at most
    drawn = None
    for toxic in (0, 1):
        some = marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("feature_id"), "feature_id").limit(sample // 2)
        drawn = some if drawn is None else drawn.unionByName(some)
    # at most ``sample`` ids, a row for each
    chosen = rows.join(F.broadcast(drawn), "feature_id").groupBy("feature_id").agg(F.min("description").alias("description"), F.max("toxic").alias("toxic"))
    fitted = train_toxicity(chosen.repartition(1).sortWithinPartitions("feature_id"), bits, factors, sample)
    if len(counts) == 2:
        # the sample may hold the two labels at other shares than the table does
        held = [min(counts[toxic], sample // 2) for toxic in (0, 1)]
        fitted["bias"] += float(np.log(counts[1] / counts[0]) - np.log(held[1] / held[0]))
    model = spark.sparkContext.broadcast(fitted)

    def run(batches):
        known = model.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch, "description"):
                _, terms, first = _terms(data, offsets, bits)
                score = 1 / (1 + np.exp(-np.clip(margins(known, terms, first), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["feature_id", "score"])

    return rows.mapInArrow(run, "feature_id bigint, score double")
