"""Toxicity by compression distance: one zstandard dictionary trained on ordinary text, one on toxic text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, discard, id_and_text, rows_of, stored, utf8

#: Training is on whole texts of a bounded sample: rows of each class for the dictionaries, rows for the calibration.
DICTIONARY_ROWS = 1200
CALIBRATION_ROWS = 4000
#: Bytes of training samples of one class that reach the driver (chosen by hash from all of the texts), and of the dictionaries.
SAMPLE_BYTES = 8_000_000
ORDINARY_BYTES = 16_000
TOXIC_BYTES = 1500
#: Bytes of a scored window, of a training piece of ordinary text, and of the grams that tell toxic words.
WINDOW = 64
PIECE = 400
GRAM = 5
#: A gram is telling if its share of toxic texts is over this many times its share of ordinary ones.
OFTENER = 8.0
#: Segment and gram length with which zstandard trains on toxic words.
TOXIC_TRAINING = {"k": 32, "d": 8}
#: Bytes by which the toxic dictionary must shorten a window, for each of the counts of such windows.
STEPS = (1, 2, 3, 4, 6, 8)
#: Standardised features are cut here, and the intercept's ridge: both keep the calibration bounded where classes part cleanly.
MOST_DEVIATION = 8.0
INTERCEPT_RIDGE = 1e-3


def grams(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def telling_words(text: bytes, telling: set[bytes]) -> bytes:
    """The words of a toxic text of whose grams (with the spaces around it) half or more are telling: its training sample."""
    out = []
    for w in text.split():
        w = b" " + w + b" "
        n = len(w) - GRAM + 1
        if 2 * sum(w[i : i + GRAM] in telling for i in range(n)) >= n > 0:
            out.append(w)
    return b"".join(out)


def trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """The content of a dictionary that zstandard trains; with too little to train on, the end of the samples."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows that end after a space where one is in their second half."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = text.rfind(b" ", at + size // 2, end)
            end = space + 1 if space > 0 else end
        out.append(text[at:end])
        at = end
    return out or [b""]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters(compression_level=3, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return tuple(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (self.ordinary, self.ordinary + self.toxic))

    def features(self, texts: list[bytes]) -> np.ndarray:
        plain, toxic = (c.compress for c in self.compressors())
        out = np.zeros((len(texts), 2 * len(STEPS) + 4))
        for i, t in enumerate(texts):
            gain = np.array([len(plain(w)) - len(toxic(w)) for w in windows(t.lower())])
            n = len(gain)
            counts = [(gain >= s).sum() for s in STEPS]
            up = np.maximum(gain, 0)
            out[i] = [*np.log1p(counts), *(np.array(counts) / n), np.log(n), gain.max(), np.log1p(up.sum()), up.sum() / n]
        return out

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.spread, -MOST_DEVIATION, MOST_DEVIATION)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = self.standardised(self.features(texts)) if len(self.mean) else np.ones((len(texts), 1))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def calibrate(model: Model | None, x: np.ndarray, labels: np.ndarray) -> Model:
    """The model with thresholds on windows' gains: a logistic regression on features x.

    Newton steps are halved until they make the penalised loss smaller, which is strictly convex, so the weights stay
    bounded for clean, noisy and constant labels alike. Without both classes the model gives the rate of label 1.
    """
    rate = np.clip((labels.sum() + 0.5) / (len(labels) + 1), 1e-6, 1 - 1e-6)
    constant = np.array([np.log(rate / (1 - rate))])
    if model is None or not 0 < labels.sum() < len(labels):
        return Model(b"", b"", constant)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = model.standardised(x)
    ridge = np.eye(z.shape[1])
    ridge[0, 0] = INTERCEPT_RIDGE
    w = np.zeros(z.shape[1])
    w[0] = constant[0]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - labels * m).sum() + w @ ridge @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - labels) + ridge @ w)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if loss(w - step) > now or np.abs(step).max() < 1e-8:
            break
        w = w - step
    model.weights = w
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def dictionaries(texts: DataFrame) -> Model | None:
    """A model without weights from whole texts (toxic, text); None without texts of both classes.

    Shares of grams are counted where the texts are. What reaches the driver: the telling grams (each in 1 % of the
    toxic texts at least) and SAMPLE_BYTES a class of samples, which a hash picks from all pieces of all texts.
    """
    size = {r["toxic"]: (r["n"], r["bytes"]) for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if len(size) < 2:
        return None
    n_toxic, n_ordinary = size[1][0], size[0][0]

    def count(batches):
        found = {0: Counter(), 1: Counter()}
        for b in batches:
            for y, t in zip(b.column("toxic").to_pylist(), utf8(b.column("text")), strict=True):
                found[y].update(grams(t.lower()))
        toxic = list(found[1])
        yield batch(gram=(toxic, pa.binary()), t=([found[1][g] for g in toxic], pa.int64()), o=([0] * len(toxic), pa.int64()))
        rest = list(found[0])
        yield batch(gram=(rest, pa.binary()), t=([0] * len(rest), pa.int64()), o=([found[0][g] for g in rest], pa.int64()))

    share = F.col("t") / n_toxic > OFTENER * (F.col("o") + 0.5) / n_ordinary
    counted = arrow_map(texts.select("toxic", "text"), count, "gram binary, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    telling = {bytes(r["gram"]) for r in counted.where(share & (F.col("t") >= max(2, 0.01 * n_toxic))).select("gram").collect()}
    rate = {y: min(1.0, SAMPLE_BYTES / max(1, m)) * 2**32 for y, (_, m) in size.items()}

    def sample(batches):
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for i, y, t in zip(ids, b.column("toxic").to_pylist(), utf8(b.column("text")), strict=True):
                each = [telling_words(p, telling) for p in windows(t.lower(), 100 * PIECE)] if y else windows(t.lower(), PIECE)
                out += [(i, y, k, p) for k, p in enumerate(each) if p and xxhash.xxh32_intdigest(p) < rate[y]]
            yield batch(**{c: (list(v), k) for (c, k), v in zip((("doc_id", pa.int64()), ("toxic", pa.int32()), ("at", pa.int32()), ("piece", pa.binary())), zip(*out, strict=True) if out else ([],) * 4, strict=True)})

    pieces = sorted((r["toxic"], r["doc_id"], r["at"], bytes(r["piece"])) for r in arrow_map(texts, sample, "doc_id long, toxic int, at int, piece binary").collect())
    return Model(trained(ORDINARY_BYTES, [p for y, _, _, p in pieces if not y]), trained(TOXIC_BYTES, [p for y, _, _, p in pieces if y], **TOXIC_TRAINING))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 41) -> Model:
    """A model from the labelled rows outside the held-out fold. The sample is the rows whose hash comes first, so it
    is the same on every run; ids are dealt to dictionary or calibration by the hash too. At most
    2 * DICTIONARY_ROWS + CALIBRATION_ROWS ids are broadcast. Texts stay on the executors: see dictionaries(); of the
    calibration only the features are collected. Labels with a null or other value than 0 and 1 and rows without a
    doc_id are not learned from; of a doc_id labelled twice the larger label counts; a null text is empty."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("pool", F.pmod(F.shiftright("h", 7), F.lit(2)))
    picked = [known.where((F.col("pool") == 0) & (F.col("toxic") == k)).orderBy("h").limit(DICTIONARY_ROWS) for k in (0, 1)] + [known.where("pool = 1").orderBy("h").limit(CALIBRATION_ROWS)]
    ids = picked[0].union(picked[1]).union(picked[2]).select("doc_id", "toxic", "pool").collect()
    ids = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int, pool long")
    texts = stored(id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "pool", F.coalesce("text", F.lit("")).alias("text")))
    model = dictionaries(texts.where("pool = 0").select("doc_id", "toxic", "text"))

    def run(batches):
        for b in batches:
            x = model.features(utf8(b.column("text"))) if model else np.zeros((b.num_rows, 0))
            yield batch(doc_id=(b.column("doc_id"), pa.int64()), toxic=(b.column("toxic"), pa.int32()), x=(list(x), pa.list_(pa.float64())))

    rows = sorted((r["doc_id"], r["toxic"], r["x"]) for r in arrow_map(texts.where("pool = 1").select("doc_id", "toxic", "text").repartition(16), run, "doc_id long, toxic int, x array<double>").collect())
    discard(texts)
    return calibrate(model, np.array([x for _, _, x in rows]), np.array([y for _, y, _ in rows], float))


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for b in batches:
            rows = list(rows_of([b]))
            yield batch(doc_id=([i for i, _ in rows], pa.int64()), score=(model.score([t for _, t in rows]), pa.float64()))

    return arrow_map(id_and_text(docs), run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Each window of a text is compressed with the ordinary dictionary, and with the same one behind which the toxic
    dictionary stands; the gain in bytes is held against several thresholds, and the counts are calibrated to a probability. Only texts enter a score. Null text: empty, scored like any text without
    toxic windows; null doc_id: its text form is empty, in the held-out fold; repeated rows are scored alike;
    without labels of both classes all scores are the rate of label 1; an empty table gives no rows. No shuffle of texts.
    """
    scored = apply(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold. A null text is scored as an empty one; rows
    with a null doc_id and repeated rows are scored like others; an empty table gives no rows."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(model.score(texts) < threshold))

    return arrow_map(docs, run, docs.schema)
