"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; one binary classifier per bit tells the
languages with the bit from those without. The classifiers are linear in the
byte 3-grams of the text (A-Z lower-cased), hashed to ``FEATURES`` columns, with
the log-odds of smoothed corpus counts as weights, so fitting is one grouped
sum over all training documents and the model has ``bits x FEATURES`` weights
whatever the input size. Up to ``EXHAUSTIVE`` languages get the exhaustive code
(every split into two groups once), more get seeded random codewords of
``ceil(10 log2 L)`` bits.

Decoding is loss-weighted: a language's distance is the sum over its bits of
the logistic loss of the margin, weighted by how often the bit's classifier is
right on the training documents of that language. The nearest codeword wins;
``score`` is its share of ``exp(-distance)`` and ``ambiguous`` flags a text
whose second-nearest codeword is closer than ``AMBIGUOUS``.

Training uses text and label only, of documents whose ``crc32(doc_id)`` modulo 4
is not 2; a prediction depends on the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0;
null labels are not learned from; a null id counts as the empty string; equal
texts have equal results and repeated rows stay repeated; without any label
every text is ``und``; a single label gets score 1; ties go to the first label
in alphabetic order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import BATCH_ROWS, released, without_texts
from tabprep.session import materialize

FEATURES = 1 << 15
EXHAUSTIVE = 6
SMOOTHING = 0.5
#: What a mean log-odds per 3-gram is multiplied with before the logistic loss.
MARGIN_SCALE = 6.0
AMBIGUOUS = 0.5
HOLD_OUT_MOD, HOLD_OUT_REST = 4, 2
UNKNOWN = "und"
#: Bytes of text whose features are in memory at a time.
BLOCK_BYTES = 200_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 3-grams of the texts, one after the other, the first index of each
    and the number of each (a space stands before and after the text, so there
    is at least one)."""
    raw = [b" " + t.encode("utf-8", "replace").lower() + b"  " for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    code = np.zeros(len(buf), np.uint32)
    code[: len(buf) - 2] = buf[:-2] << np.uint32(16) | buf[1:-1] << np.uint32(8) | buf[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - FEATURES.bit_length() + 1)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    keep = np.ones(len(code), bool)
    keep[ends - 1] = keep[ends - 2] = False  # 3-grams that would reach into the next text
    return code[keep].astype(np.int64), ends - lengths - 2 * np.arange(len(raw)), lengths - 2


def _blocks(texts: list[str]):
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _count(batches):
    for batch in batches:
        counts: dict[str, np.ndarray] = {}
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _blocks(texts):
            code, starts, lengths = features(texts[a:b])
            for lang in set(langs[a:b]):
                mine = np.repeat(np.fromiter((x == lang for x in langs[a:b]), bool, b - a), lengths)
                seen = np.bincount(code[mine], minlength=FEATURES)
                counts[lang] = counts[lang] + seen if lang in counts else seen
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], ["lang", "feature", "n"])


def codewords(langs: list[str], seed: int = 7) -> np.ndarray:
    """A matrix of +1 and -1, one row per language and one column per bit; no
    column is constant and no two rows are equal."""
    n = len(langs)
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1.0 if b >> i & 1 else -1.0 for b in bits] for i in range(n)])
    rng = np.random.default_rng(seed)
    while True:
        m = rng.choice([-1.0, 1.0], size=(n, math.ceil(10 * math.log2(n))))
        if len(np.unique(m, axis=0)) == n and (np.abs(m.sum(axis=0)) < n).all():
            return m


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean log-odds of each text for each bit: texts x bits."""
    out = np.zeros((len(texts), weights.shape[1]))
    for a, b in _blocks(texts):
        code, starts, lengths = features(texts[a:b])
        out[a:b] = np.add.reduceat(weights[code], starts, axis=0, dtype=np.float64) / lengths[:, None]
    return out


def _check_bits(model):
    """Per batch: how often each bit's classifier is right, by language."""
    def run(batches):
        langs, code, weights = model.value
        at = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            own = np.fromiter((at[x] for x in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            right = margins(batch.column(1).to_pylist(), weights) * code[own] > 0
            for k in np.unique(own):
                mine = right[own == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(k)] * code.shape[1], pa.int32()), pa.array(range(code.shape[1]), pa.int32()),
                     pa.array(mine.sum(axis=0), pa.int64()), pa.array([len(mine)] * code.shape[1], pa.int64())],
                    ["lang", "bit", "right", "n"])
    return run


def decode(margin: np.ndarray, code: np.ndarray, bit_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of ``exp(-distance)``, and the lead over the
    second-nearest, by loss-weighted distance."""
    z = MARGIN_SCALE * margin[:, None, :] * code[None, :, :]
    distance = (np.logaddexp(0, -z) * bit_weights[None, :, :]).sum(axis=2)
    best = distance.argmin(axis=1)
    near = np.sort(distance, axis=1)
    lead = near[:, 1] - near[:, 0] if code.shape[0] > 1 else np.full(len(margin), np.inf)
    share = 1 / np.exp(distance.min(axis=1, keepdims=True) - distance).sum(axis=1)
    return best, share, lead


def _predict(model):
    def run(batches):
        langs, code, weights, bit_weights = model.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            real = [i for i, ok in enumerate(batch.column(1).to_pylist()) if ok]
            if real and langs:
                best, share, lead = decode(margins([texts[i] for i in real], weights), code, bit_weights)
                for i, k in zip(real, best):
                    pred[i] = langs[k]
                score[real], unsure[real] = share, lead < AMBIGUOUS
            yield pa.RecordBatch.from_arrays(
                [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_()),
                 *batch.columns[2:]], ["lang_pred", "score", "ambiguous", *batch.schema.names[2:]])
    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        smoothing: float = SMOOTHING):
    """``(langs, code, weights, bit_weights)``: bounded by languages x bits and
    bits x FEATURES."""
    sc = docs.sparkSession.sparkContext
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    train = docs.filter((F.crc32(id_text) % HOLD_OUT_MOD != HOLD_OUT_REST) & F.col(lang).isNotNull()
                        & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"),
                                                          F.col(text).alias("text"))
    counts = materialize(train.mapInArrow(_count, "lang string, feature int, n long")
                         .groupBy("lang", "feature").agg(F.sum("n").alias("n")), "langid-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # the label set
    code = codewords(langs)
    weights = np.zeros((FEATURES, code.shape[1]), np.float32)
    if code.shape[1]:
        bits = docs.sparkSession.createDataFrame(
            [(x, b, bool(code[i, b] > 0)) for i, x in enumerate(langs) for b in range(code.shape[1])],
            "lang string, bit int, side boolean")
        sides = (counts.join(F.broadcast(bits), "lang").groupBy("bit", "feature")
                 .agg(F.sum(F.when(F.col("side"), F.col("n")).otherwise(0)).alias("yes"),
                      F.sum(F.when(~F.col("side"), F.col("n")).otherwise(0)).alias("no")).toPandas())
        yes, no = (np.full((FEATURES, code.shape[1]), smoothing) for _ in range(2))
        yes[sides.feature, sides.bit] += sides.yes
        no[sides.feature, sides.bit] += sides.no
        weights[:] = np.log(yes / yes.sum(axis=0)) - np.log(no / no.sum(axis=0))
    right = np.ones(code.shape)
    if code.shape[1]:
        seen = (train.mapInArrow(_check_bits(sc.broadcast((langs, code, weights))),
                                 "lang int, bit int, right long, n long")
                .groupBy("lang", "bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).toPandas())
        right[seen.lang, seen.bit] = seen.right / seen.n
    return langs, code, weights, right / np.maximum(right.sum(axis=1, keepdims=True), 1e-9) * max(code.shape[1], 1)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model=None) -> DataFrame:
    """One row per document row: ``doc_id, held_out, lang_pred, score, ambiguous``
    and ``tkey``, the text's key.
    ``model`` is what :func:`fit` returns; without it, it is fitted on ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs, doc_id, text, lang))
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"),
                    F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                    F.col(doc_id).alias("doc_id"),
                    (F.crc32(id_text) % HOLD_OUT_MOD == HOLD_OUT_REST).alias("held_out"),
                    F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tkey"))
    out = d.mapInArrow(released(_predict(model)), "lang_pred string, score double, ambiguous boolean, "
                                        f"doc_id {dict(d.dtypes)['doc_id']}, held_out boolean, tkey string")
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "tkey")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    model=None) -> DataFrame:
    """``docs`` (all columns) without the texts that have no language (``und``)
    or whose nearest codeword is ambiguous. Predictions depend on the text, so
    the rejected texts are taken out by their key."""
    rejected = identify(docs, doc_id, text, lang, model).filter((F.col("lang_pred") == UNKNOWN) | F.col("ambiguous"))
    return without_texts(docs, materialize(rejected.select("tkey").distinct(), "rejected", BATCH_ROWS), text)
