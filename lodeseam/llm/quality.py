"""Quality classifier: a byte-level convolutional network in numpy.

The text's UTF-8 bytes are laid out in blocks of ``BLOCK`` and chunks of two
blocks, so that chunks overlap by half and cover the whole text.  Learned
filters (byte embeddings, then a convolution of ``WIDTH`` bytes) slide over
every byte; each chunk keeps its greatest activation of each filter, and a
document the greatest and the mean over its chunks.  One logistic unit combines
both into the probability of label 1 (labels weigh alike in learning, however rare one is).

Learning: on the driver, by back-propagation and Adam, from a bounded sample: the
whole texts of the ``SAMPLE`` labelled rows with the smallest hash, as far as they
have no more than ``SAMPLE_BYTES`` together.  Rows held out (crc32 of doc_id modulo 5
is 0) are never in it.  The same rows give the same network.  Scoring reads
every byte of every text, in slices of bounded size; it needs no shuffle.

Odd input: a null text counts as empty, and an empty text is two blocks of
padding with a score like any other; null doc_id: never held out, never
learned from; a null label is not learned from; repeated labels count as often
as they stand; without any label of one kind the score is the share of label 1
(0.5 if there are no labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, ranges, slices, table

BLOCK, WIDTH, EMBED, FILTERS = 128, 6, 8, 24
#: Labelled rows that are learned from, at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 4000, 24 << 20
#: Blocks that are worked on at once.
STEP = 512
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-4
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def layout(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first block of each text and the end): texts in whole blocks, two at least, and a block of zeros after each, so that no filter sees two texts."""
    sizes = np.diff(offsets)
    blocks = np.maximum(2, -(-(sizes + WIDTH - 1) // BLOCK)) + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    out[ranges(first[:-1] * BLOCK, sizes)] = raw
    return out, first


class Network:
    """Parameters as float32 arrays, and what follows from them."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.p = {
            "embed": draw.normal(0, 0.5, (256, EMBED)),
            "filters": draw.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "shift": np.zeros(FILTERS),
            "most": draw.normal(0, 0.1, FILTERS),
            "mean": draw.normal(0, 0.1, FILTERS),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pair_tables(self) -> list[np.ndarray]:
        """What each pair of neighbouring bytes adds to each filter, for every second byte of its width."""
        taps = [self.p["embed"] @ self.p["filters"][k * EMBED : (k + 1) * EMBED] for k in range(WIDTH)]
        pairs = [(taps[k][None, :, :] + taps[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        pairs[0] = pairs[0] + self.p["shift"]
        return pairs

    def combine(self, chunks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits from chunk maxima, documents beginning at ``at``."""
        act = np.maximum(chunks, 0)
        most = np.maximum.reduceat(act, at)
        mean = np.add.reduceat(act, at) / np.diff(np.append(at, len(act)))[:, None]
        return most @ self.p["most"] + mean @ self.p["mean"] + self.p["bias"][0]

    def score(self, raw: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the texts between the offsets; work arrays are bounded, whatever a text's length."""
        data, first = layout(raw, offsets)
        codes = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << 8
        blocks, step = np.empty((first[-1], FILTERS), np.float32), 512
        for a in range(0, first[-1], step):
            b = min(first[-1], a + step)
            lo, hi = a * BLOCK, b * BLOCK
            z = tables[0][codes[lo:hi]]
            for k in range(1, len(tables)):
                z += tables[k][codes[lo + 2 * k : hi + 2 * k]]
            blocks[a:b] = z.reshape(b - a, BLOCK, FILTERS).max(1)
        keep = np.ones(first[-1], bool)
        keep[first[1:] - 1] = keep[first[1:] - 2] = False  # a chunk begins at each block but a text's last, and the zeros
        chunks = np.maximum(blocks, np.append(blocks[1:], blocks[:1], 0))[keep]
        return 1 / (1 + np.exp(-self.combine(chunks, first[:-1] - 2 * np.arange(len(first) - 1)).astype(np.float64)))

    def _block_maxima(self, data: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(greatest value of each filter in each block, its first byte's place in ``data``), some blocks at a time."""
        top, place = np.empty((blocks, FILTERS), self.p["filters"].dtype), np.empty((blocks, FILTERS), np.int64)
        for a in range(0, blocks, STEP):
            b = min(blocks, a + STEP)
            x = self.p["embed"][data[a * BLOCK : b * BLOCK + WIDTH - 1]].ravel()
            flat = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED)[::EMBED]
            z = (flat @ self.p["filters"] + self.p["shift"]).reshape(b - a, BLOCK, FILTERS)
            where = z.argmax(1)
            top[a:b] = np.take_along_axis(z, where[:, None], 1)[:, 0]
            place[a:b] = where + np.arange(a, b)[:, None] * BLOCK
        return top, place

    def gradients(self, data: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy over whole texts, as ``layout`` gives them."""
        p, docs, kind = self.p, len(label), self.p["filters"].dtype
        blocks, place = self._block_maxima(data, int(first[-1]))
        keep = np.ones(first[-1], bool)
        keep[first[1:] - 1] = keep[first[1:] - 2] = False
        begin = np.flatnonzero(keep)
        second = blocks[begin + 1] > blocks[begin]
        top, place = np.where(second, blocks[begin + 1], blocks[begin]), np.where(second, place[begin + 1], place[begin])
        at = first[:-1] - 2 * np.arange(docs)
        act, counts = np.maximum(top, 0), np.diff(np.append(at, len(begin)))
        doc = np.repeat(np.arange(docs), counts)
        most = np.maximum.reduceat(act, at)
        mean = np.add.reduceat(act, at) / counts[:, None]
        logit = most @ p["most"] + mean @ p["mean"] + p["bias"][0]
        d = (weight * (1 / (1 + np.exp(-logit)) - label) / docs).astype(kind)
        best = act == most[doc]
        share = np.add.reduceat(best.astype(kind), at)
        d_top = ((d[doc, None] * p["most"]) * best / share[doc] + (d / counts)[doc, None] * p["mean"]) * (top > 0)
        d_filters, d_embed = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        by_tap = p["filters"].reshape(WIDTH, EMBED, FILTERS).transpose(2, 0, 1)
        for a in range(0, len(begin), STEP):
            part = d_top[a : a + STEP]
            seen = data[place[a : a + STEP, :, None] + np.arange(WIDTH)]
            d_filters += np.einsum("nfk,nf->kf", p["embed"][seen].reshape(len(part), FILTERS, -1), part, optimize=True)
            each = (part[:, :, None, None] * by_tap[None]).reshape(-1, EMBED)
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(seen.ravel(), each[:, e], 256).astype(kind)
        return {"embed": d_embed, "filters": d_filters, "shift": d_top.sum(0), "most": most.T @ d, "mean": mean.T @ d, "bias": d.sum(keepdims=True)}


def learn(samples: list[tuple[bytes, int]], seed: int = 7) -> Network | float:
    """A network from (text, label) rows, or a constant score where there is nothing to tell apart."""
    label = np.array([y for _, y in samples], np.float32)
    if len(label) == 0 or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.5
    net = Network(seed)
    # both labels weigh the same in all, so that the rarer one is learned as well
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())).astype(np.float32)
    texts = [np.frombuffer(t, np.uint8) for t, _ in samples]
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    t, steps = 0, EPOCHS * -(-len(label) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(label))
        for a in range(0, len(label), BATCH):
            rows = order[a : a + BATCH]
            own = [texts[i] for i in rows]
            g = net.gradients(*layout(np.concatenate(own), np.cumsum([0, *map(len, own)])), label[rows], weight[rows])
            t += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * t / (steps + 1)))
            for k, v in net.p.items():
                grad = g[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                net.p[k] = (v - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """(whole text, label) of the sample: at most ``sample`` rows, of at most ``most`` bytes together, reach the driver.

    A text that doesn't fit any more is passed over, and those after it have their turn; texts of more
    than a sixteenth of ``most`` come last, so that one of them never takes the room of many.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample is bounded by its parameter, so that it may be broadcast
    joined = texts.join(F.broadcast(chosen), "doc_id")
    order = ["_hash", "doc_id", "quality", "_size", "_text"]
    sizes = joined.select(F.xxhash64("doc_id").alias("_hash"), "doc_id", "quality", F.octet_length("text").cast("long").alias("_size"), F.xxhash64("text").alias("_text"))
    sizes = sizes.orderBy(*order).limit(sample).toPandas()
    room, fit = most, []
    for long in (False, True):
        for i, size in enumerate(sizes["_size"].tolist()):
            if (size > most // 16) == long and size <= room:
                room -= size
                fit.append(i)
    fits = sizes.iloc[sorted(fit)]
    if not len(fits):
        return []
    wanted = docs.sparkSession.createDataFrame(fits[["doc_id", "_text"]].drop_duplicates())
    rows = texts.withColumn("_text", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "_text"]).select("doc_id", "_text", F.col("text").cast("binary").alias("text")).distinct().collect()
    text = {(r.doc_id, r._text): bytes(r.text) for r in rows}
    return [(text[d, t], int(q)) for d, t, q in zip(fits["doc_id"], fits["_text"], fits["quality"], strict=True)]


def score_quality(docs: DataFrame, model: Network | float) -> DataFrame:
    """All columns of ``docs`` (text among them) and score, predicted; columns of these names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("score", "predicted")
    if not isinstance(model, Network):
        return docs.withColumn("score", F.lit(model)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    sent = spark.sparkContext.broadcast(model)
    keep = docs.schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.pair_tables()
        for whole in batches:
            for batch in slices(whole, "text"):
                p = net.score(*binary_parts(batch.column("text")), tables)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(score, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
