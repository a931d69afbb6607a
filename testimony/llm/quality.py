"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

A text's terms are its words (A-Z folded) and its byte trigrams (all capitals alike, and all digits), hashed, and how much of it repeats words. Terms are weighted by inverse
document frequency and projected onto the leading singular vectors of a labelled sample. The labelled vectors are broadcast (their number is a
parameter); every document gets exact cosine products against all of them, in blocks, and its nearest
neighbours vote for their labels with their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.llm.common import hashed_words, runs_of, text_slices, utf8

#: log2 of the hash values of words, and of trigrams.
WORD_BITS, GRAM_BITS = 12, 12
N_TERMS = (1 << WORD_BITS) + (1 << GRAM_BITS) + 4
#: Weight of the last four terms, which all texts have, in place of inverse document frequency.
REPEAT_WEIGHT = 3.0
#: Bytes as trigrams see them: one capital and one digit stand for all.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[65:91], _SEEN[48:58] = 65, 48
#: Texts whose terms are held at once.
ROWS_PER_BLOCK = 128


def terms(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Square roots of term shares of each text, as float32 rows of N_TERMS, for blocks of texts.

    First words, then trigrams of bytes, then the shares of words that repeat the word before and that do not, and of those that
    stand before in the text and that do not.
    """
    for a, b in runs_of(texts):
        for i in range(a, b, ROWS_PER_BLOCK):
            yield _terms(texts[i : min(b, i + ROWS_PER_BLOCK)])


def _terms(part: list[bytes]) -> np.ndarray:
    out = np.zeros((len(part), N_TERMS), np.float32)
    words, ends = hashed_words(part, fold=True)
    start = 0
    for i, (t, end) in enumerate(zip(part, ends.tolist(), strict=True)):
        w, start = words[start:end], end
        if len(w):
            out[i, : 1 << WORD_BITS] = np.bincount((w >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS) / len(w)
            near, again = np.mean(w[1:] == w[:-1]) if len(w) > 1 else 0.0, 1 - len(np.unique(w)) / len(w)
            out[i, -4:] = near, 1 - near, again, 1 - again
        if len(t) > 2:
            c = _SEEN[np.frombuffer(t, np.uint8)]
            g = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS)
            out[i, 1 << WORD_BITS : -4] = np.bincount(g.astype(np.int64), minlength=1 << GRAM_BITS) / len(g)
    return np.sqrt(out)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _project(rows: np.ndarray, idf: np.ndarray, base: np.ndarray) -> np.ndarray:
    return _unit((rows * idf) @ base)


def fit(docs: DataFrame, labels: DataFrame, *, rows_per_label: int = 1000, dims: int = 64, id_col: str, text_col: str, label_col: str) -> dict:
    """Model from at most ``rows_per_label`` labelled documents of each label, those of least hashed id.

    The sample is the only data that reaches the driver: 2 * rows_per_label sparse rows. An id labelled both ways counts
    as 0; of the documents of one id that of the least text hash is taken.
    """
    keys = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    parts = [keys.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_label) for v in (0, 1)]
    picked = parts[0].unionByName(parts[1])

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(np.flatnonzero(r).astype(np.int32), r[r != 0]) for part in terms(utf8(pdf["_text"])) for r in part]
            yield pd.DataFrame({"_id": pdf["_id"], "_label": pdf["_label"], "at": [x[0] for x in got], "v": [x[1] for x in got]})

    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(picked), texts["_d"] == F.col("_id")).select("_id", "_label", F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")).alias("s"))
    once = joined.groupBy("_id", "_label").agg(F.min("s").alias("s")).select("_id", "_label", F.col("s.t").alias("_text"))
    rows = once.mapInPandas(sparse, "_id long, _label int, at array<int>, v array<float>").toPandas().sort_values("_id")
    every = np.concatenate(rows["at"].tolist()).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    used, counts = np.unique(every, return_counts=True)
    idf = np.log((1 + len(rows)) / (1 + counts)).astype(np.float32) + np.float32(0.5)
    idf[used >= N_TERMS - 4] = REPEAT_WEIGHT
    # The one large array of the fit: weighted terms, 2 * rows_per_label rows of N_TERMS at most.
    w = np.zeros((len(rows), len(used)), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["v"], strict=True)):
        k = np.searchsorted(used, at)
        w[i, k] = v * idf[k]
    labels_ = rows["_label"].to_numpy(np.float32)
    del rows, every
    dims = max(1, min(dims, len(w), len(used)))
    # Randomised subspace iteration: the leading right singular vectors of the weighted sample.
    q = np.random.default_rng(5).standard_normal((len(used), dims + 8)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(w.T @ (w @ q))[0] if len(w) else np.linalg.qr(q)[0]
    if len(w):
        _, _, vt = np.linalg.svd(w @ q, full_matrices=False)
        q = q @ vt.T
    base = np.ascontiguousarray(q[:, :dims], np.float32)
    return {"used": used, "idf": idf, "base": base, "vectors": _unit(w @ base), "labels": labels_}


def vote(rows: np.ndarray, model: dict, k: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest labelled vectors, for a block of rows."""
    near = model["vectors"]
    if not len(near):
        return np.full(len(rows), 0.5)
    sim = _project(rows[:, model["used"]], model["idf"], model["base"]) @ near.T
    k = min(k, len(near))
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(sim, top, 1), 1e-6) ** 4
    return (weight * model["labels"][top]).sum(axis=1) / weight.sum(axis=1)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows_per_label: int = 1000,
    k: int = 15,
    cut: float = 0.3,
    folds: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    prefix: str = "",
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= cut) added.

    Labels are learnt only from rows whose crc32(id as text) mod ``folds`` is not 0; ``held_out`` marks the
    others. Scores depend on the text alone.

    Null and empty texts have no terms; all neighbours are then equally near at similarity 0 and they
    get a score as well. Without usable labels every score is 0.5. Ids labelled both ways count
    as 0; labels other than 0 and 1, or of a null id, are ignored. A document of a null id is scored like others and is held out only if the
    empty text's remainder is 0. Repeated rows are scored one by one. Very long texts are read whole. An empty table gives an empty result. Names that
    exist already in ``docs`` are replaced by the added ones.
    """
    fold = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    model = fit(docs, labels.where(fold(F.col(id_col)) != 0), rows_per_label=rows_per_label, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            blocks = [vote(block, shared.value, k) for part in text_slices(column) for block in terms([t or b"" for t in part])]
            yield pa.array(np.concatenate(blocks).astype(np.float64) if blocks else np.zeros(0))

    out = docs.withColumns({prefix + "held_out": fold(F.col(id_col)) == 0, prefix + "score": score.asNondeterministic()(F.col(text_col))})
    return out.withColumn(prefix + "predicted", (F.col(prefix + "score") >= cut).cast("int"))
