"""Operator 5, language ID: averaged hashed subword embeddings under a linear softmax.

A text, lower-cased, with one space for every character that isn't a letter, gives the character n-grams of
2 to 4; each falls into a bucket with an embedding. Their mean goes through a linear layer and a softmax, all
trained here by stochastic gradient descent in numpy on random windows of a bounded sample of labelled rows.
A part of the sample that training doesn't see sets the softmax temperature and the two limits of rejection: a
calibrated score and a share of n-grams that training saw, both below what that part's texts reach. Prediction
reads whole texts; as embedding and layer are linear, a bucket's contribution to each class is one table.

Defined cases: text that is null or has no letter is ``und`` with score 0, rejected; so is every text if no
row is labelled; null and repeated ids are rows like others; an empty table gives no rows; :func:`identify`
keeps all columns and replaces any that are named like its own, in whatever case. A text's result doesn't hang on the
texts beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
_CHUNK = 1 << 17
_ALL = 1 << 62
#: Spaces after each text: what its last n-grams reach into, where none begins.
_PAD = 3
_letter: list[np.ndarray] = []


@dataclass
class Model:
    """``table``: contribution of each bucket to each class; ``seen``: buckets of the training sample."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0
    sizes: tuple[int, ...] = (2, 3, 4)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class scores before the softmax, share of known n-grams, and whether there is a letter, a row a text."""
        points, begins, starts = code_points(texts)
        total = np.zeros((len(texts), len(self.languages)))
        known, count = np.zeros(len(texts)), np.diff(np.append(starts, len(begins))) * len(self.sizes)
        for h in buckets(points, begins, self.sizes, len(self.table)):
            total += np.add.reduceat(self.table[h], starts, axis=0, dtype=np.float64)
            known += np.add.reduceat(self.seen[h], starts, dtype=np.float64)
        lettered = np.add.reduceat(points[begins] != 32, starts) > 0
        return total / count[:, None] + self.bias, known / count, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and whether it is rejected, a row a text."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, known, lettered = self.logits(texts)
        p = softmax(logits * self.temperature)
        best = p.argmax(axis=1)
        score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
        rejected = ~lettered | (score < self.least_score) | (known < self.least_seen)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], score, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, others than letters as spaces; the places where n-grams begin; each text's first of these.

    A space stands before each text, where n-grams begin too, and :data:`_PAD` of them after it, where none do: no
    n-gram reaches the next text.
    """
    if not _letter:
        _letter.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool))
    padded = [f" {t.lower()}{' ' * _PAD}" for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in padded])
    begins = np.ones(len(points), bool)
    for k in range(1, _PAD + 1):
        begins[np.cumsum(sizes) - k] = False
    starts = np.cumsum(sizes - _PAD) - (sizes - _PAD)
    return np.where(_letter[0][points], points, np.uint32(32)), np.flatnonzero(begins), starts


def buckets(points: np.ndarray, begins: np.ndarray, sizes: tuple[int, ...], table: int) -> Iterator[np.ndarray]:
    """For each n-gram size (at most one more than the padding) the bucket of the n-gram that begins at each of ``begins``."""
    own = table // len(sizes)
    for k, n in enumerate(sizes):
        h = np.zeros(len(begins), np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + points[begins + j] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(13)) % np.uint32(own) + np.uint32(k * own)


def train(texts: list[str], labels: list[str], size: int = 3 * 32_768, width: int = 16, steps: int = 600, batch: int = 48, seed: int = 7) -> Model:
    """Fit a model; every fifth text is kept for calibration."""
    languages = sorted(set(labels))
    held = np.arange(len(texts)) % 5 == 4
    rng = np.random.default_rng(seed)
    model = Model(languages, np.zeros((size, len(languages)), np.float32), np.zeros(len(languages)), np.zeros(size, np.float32))
    fit = [i for i in range(len(texts)) if not held[i] and any(c.isalpha() for c in texts[i])]
    if not fit:
        return Model([], model.table, model.bias, model.seen)
    target = {x: k for k, x in enumerate(languages)}
    by_class = [[i for i in fit if labels[i] == x] for x in languages]
    by_class = [c for c in by_class if c]
    emb = rng.normal(0, 1 / width, (size, width))
    layer, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    for step in range(steps):
        rate = 1.0 - step / steps
        chosen = [(c := by_class[rng.integers(len(by_class))])[rng.integers(len(c))] for _ in range(batch)]
        windows = []
        for i in chosen:
            at = rng.integers(max(1, len(texts[i]) - 20))
            windows.append(texts[i][at : at + int(rng.integers(20, 300))])
        points, begins, starts = code_points(windows)
        lengths = np.diff(np.append(starts, len(begins)))
        row = np.tile(np.repeat(np.arange(batch), lengths), len(model.sizes))
        hit = np.concatenate(list(buckets(points, begins, model.sizes, size)))
        model.seen[hit] = 1
        share = 1.0 / (lengths * len(model.sizes))
        x = np.stack([np.bincount(row, emb[hit, k], batch) for k in range(width)], axis=1) * share[:, None]
        grad = softmax(x @ layer + bias)
        grad[np.arange(batch), [target[labels[i]] for i in chosen]] -= 1
        grad /= batch
        back = grad @ layer.T * share[:, None]
        layer -= 20 * rate * x.T @ grad
        bias -= 0.2 * rate * grad.sum(axis=0)
        order = np.argsort(hit, kind="stable")
        edge = np.flatnonzero(np.diff(hit[order], prepend=-1))
        emb[hit[order][edge]] -= 200 * rate * np.add.reduceat(back[row[order]], edge, axis=0)
    model.table, model.bias = (emb @ layer).astype(np.float32), bias
    calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], [x for x, h in zip(labels, held, strict=True) if h], rng)
    return model


def calibrate(model: Model, texts: list[str], labels: list[str], rng: np.random.Generator) -> None:
    """Temperature of least log loss on windows of unseen texts; limits of rejection below what whole texts reach."""
    kept = [(t, x) for t, x in zip(texts, labels, strict=True) if any(c.isalpha() for c in t)]
    if not kept:
        return
    windows = []
    for t, x in kept:
        at = int(rng.integers(max(1, len(t) - 20)))
        windows.append((t[at : at + int(rng.integers(10, 200))], x))
    windows = [(t, x) for t, x in windows if any(c.isalpha() for c in t)] or kept
    logits = model.logits([t for t, _ in windows])[0]
    goal = np.array([model.languages.index(x) for _, x in windows])
    loss = lambda t: -np.log(np.maximum(softmax(logits * t)[np.arange(len(goal)), goal], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.25, 16, 49), key=loss))
    known, scores = [], []
    for t, _ in kept:
        logit, share, _ = model.logits([t])
        known.append(share[0])
        scores.append(softmax(logit * model.temperature).max())
    # An even split is 1 / classes; short texts that mix languages come near it, so the limit stands just above.
    model.least_score = float(min(1.25 / len(model.languages), np.quantile(scores, 0.01))) if len(model.languages) > 1 else 0.0
    model.least_seen = float(np.quantile(known, 0.01)) * 0.5


def _remainder(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4


def share_of(wanted: int, count: int) -> int:
    """Below which 62-bit hashes a row of ``count`` is drawn, for about ``wanted`` of them."""
    return _ALL * min(wanted, count) // count


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = 500, chars: int = 4000, sample_rows: int = 200_000, most_languages: int = 10_000) -> Model:
    """A model from labelled rows whose crc32(id) mod 4 isn't 2.

    The sample: about ``rows_per_language`` rows of each label (fewer where ``sample_rows`` over all labels would be
    exceeded), by a hash of the id, of each text a random window of ``chars`` characters; labels beyond the
    ``most_languages`` most frequent are not learned.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (_remainder(id_col) != 2))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_languages).collect()
    if not counts:
        return Model([], np.zeros((3, 0), np.float32), np.zeros(0), np.zeros(3, np.float32))
    each = max(1, min(rows_per_language, sample_rows // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(share_of(each, r["count"])))])
    drawn = F.xxhash64(F.lit("sample"), "id").bitwiseAND(F.lit(_ALL - 1))
    begin = F.pmod(F.xxhash64(F.lit("window"), "id"), F.greatest(F.lit(1), F.char_length("text") - chars)).cast("int") + 1
    sample = rows.where(drawn < F.try_element_at(share, F.col("label"))).select("id", F.substr("text", begin, F.lit(chars)).alias("text"), "label")
    got = sample.limit(2 * each * len(counts)).toPandas().sort_values(["id", "text"])
    return train(got["text"].tolist(), got["label"].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score`` and ``rejected``."""
    new = T.StructType([T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = [c for c in docs.columns if c.lower() not in new.fieldNames()]
    # By number while Arrow carries them: it takes no names with dots.
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.coalesce(_remainder(id_col) == 2, F.lit(False)).alias("held_out"))
    told = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language, score, rejected = [], [], []
            texts = b.column(at)
            lo = 0
            while lo < b.num_rows:
                part = []
                size = 0
                while lo < b.num_rows and (not part or size < _CHUNK):
                    part.append(texts[lo].as_py() or "")
                    size += len(part[-1])
                    lo += 1
                x, y, z = told.value.predict(part)
                language += x
                score.append(y)
                rejected.append(z)
            new_columns = [pa.array(language, pa.string()), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(np.concatenate([np.zeros(0, bool), *rejected]))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new_columns], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *new.fields[1:]])).toDF(*names, *new.fieldNames())


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The query: a model from labelled documents, applied to all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
