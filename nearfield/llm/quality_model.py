"""A byte-level convolutional network for text quality, in numpy.

Every byte of a text is looked up in a learned table, learned filters run over all windows of ``TAPS`` bytes, and the
rectified responses are max-pooled over chunks of two blocks, each chunk overlapping the next by one block. The chunks
cover the whole text. Mean and maximum of the chunks' responses, and the logarithm of the number of blocks, go through a
small dense layer to one probability.

Defined results: a null text counts as empty; an empty text is one blank chunk and gets the probability the network
has for it. Without labels of both kinds to learn from, every score is the share of label 1 (0.5 without any label).
Long texts are read in pieces of bounded size. Repeated rows get equal scores; an id with two labels teaches nothing. An
empty table gives an empty result. Only doc_id and text are read for a score, so that other columns, whatever their
names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .learning import remainder, sample_labelled

BLOCK = 64
TAPS = 6
WIDTH = 8
FILTERS = 16
HIDDEN = 16
#: Labelled texts drawn for training, of each label.
TRAIN_PER_LABEL = 700
STEPS = 700
BATCH = 24
RATE = 4e-3
DECAY = 1e-4
THRESHOLD = 0.3
#: Bytes convolved in one go.
PIECE = 1 << 15
_PAD = 256


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ByteNetwork:
    p: dict[str, np.ndarray]
    constant: float | None = None
    _tables: np.ndarray | None = field(default=None, repr=False)

    def tables(self) -> np.ndarray:
        """For each tap, the response that each byte adds to each filter."""
        return np.einsum("vd,tdf->tvf", self.p["embed"], self.p["filters"]).astype(np.float32)

    def respond(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Responses of the filters at all places of ``codes`` but the last TAPS - 1."""
        n = len(codes) - TAPS + 1
        out = tables[0][codes[:n]]
        for t in range(1, TAPS):
            out += tables[t][codes[t : t + n]]
        return out

    def pooled(self, text: bytes, tables: np.ndarray) -> np.ndarray:
        """Maximal responses of each block of a whole text, piece by piece."""
        codes = encode(text)
        out = []
        for at in range(0, len(codes) - TAPS + 1, PIECE):
            got = self.respond(tables, codes[at : at + PIECE + TAPS - 1])
            out.append(got.reshape(-1, BLOCK, FILTERS).max(1))
        return np.maximum(np.concatenate(out) + self.p["bias"], 0)

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(features @ self.p["w1"] + self.p["b1"], 0)
        return hidden, _sigmoid(hidden @ self.p["w2"] + self.p["b2"])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if self._tables is None:
            self._tables = self.tables()
        return np.array([float(self.head(combine(self.pooled((t or "").encode("utf-8", "replace"), self._tables))[None])[1][0]) for t in texts])


def encode(text: bytes) -> np.ndarray:
    """Byte codes, padded to whole blocks and TAPS - 1 more."""
    n = max(1, -(-len(text) // BLOCK)) * BLOCK + TAPS - 1
    out = np.full(n, _PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def combine(blocks: np.ndarray) -> np.ndarray:
    """One vector a text: mean and maximum over its overlapping chunks of two blocks."""
    chunks = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
    return np.concatenate([chunks.mean(0), chunks.max(0), [np.log1p(len(blocks)) / 4]])


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    embed = rng.normal(0, 0.2, (257, WIDTH))
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:!?'\"()"]
    for k, members in enumerate(kinds):
        embed[list(members), k] += 1
    embed[128:256, 1] += 1
    embed[[c for c in range(33, 127) if not chr(c).isalnum() and bytes([c]) not in kinds[5]], 6] += 1
    embed[_PAD] = 0
    return {
        "embed": embed, "filters": rng.normal(0, 0.35, (TAPS, WIDTH, FILTERS)), "bias": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.3, (2 * FILTERS + 1, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1),
    }


def fit(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 5) -> ByteNetwork:
    """Adam on the cross entropy. The gradient goes through the places that won the pooling only.

    The two labels are drawn alike and the last bias is then moved by the log odds of their true shares.
    """
    ones, zeros = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if not ones or not zeros:
        return ByteNetwork({}, constant=0.5 if not rows else float(bool(ones)))
    rng = np.random.default_rng(seed)
    net = ByteNetwork(initial(rng))
    p = net.p
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    coded = {y: [encode(t.encode("utf-8", "replace")) for t in ts] for y, ts in ((1, ones), (0, zeros))}
    for step in range(1, steps + 1):
        tables = net.tables()
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        d_tables = np.zeros(tables.shape)
        for k in range(BATCH):
            y = k % 2
            codes = coded[y][rng.integers(len(coded[y]))]
            blocks = (len(codes) - TAPS + 1) // BLOCK
            responses = net.respond(tables, codes).reshape(blocks, BLOCK, FILTERS)
            won = responses.argmax(1)
            top = np.take_along_axis(responses, won[:, None], 1)[:, 0] + p["bias"]
            act = np.maximum(top, 0)
            features = combine(act)
            hidden, q = net.head(features[None])
            err = float(q[0] - y) / BATCH
            grad["b2"] += err
            grad["w2"] += err * hidden[0]
            d_hidden = err * p["w2"] * (hidden[0] > 0)
            grad["b1"] += d_hidden
            grad["w1"] += np.outer(features, d_hidden)
            d_features = p["w1"] @ d_hidden
            pairs = np.maximum(act[:-1], act[1:]) if blocks > 1 else act
            d_pairs = np.tile(d_features[:FILTERS] / len(pairs), (len(pairs), 1))
            d_pairs[pairs.argmax(0), np.arange(FILTERS)] += d_features[FILTERS : 2 * FILTERS]
            d_act = d_pairs
            if blocks > 1:
                first = act[:-1] >= act[1:]
                d_act = np.zeros_like(act)
                d_act[:-1] += d_pairs * first
                d_act[1:] += d_pairs * ~first
            d_act = d_act * (top > 0)
            grad["bias"] += d_act.sum(0)
            b, f = np.nonzero(d_act)
            at = b * BLOCK + won[b, f]
            for t in range(TAPS):
                np.add.at(d_tables[t], (codes[at + t], f), d_act[b, f])
        grad["embed"] = np.einsum("tvf,tdf->vd", d_tables, p["filters"])
        grad["filters"] = np.einsum("vd,tvf->tdf", p["embed"], d_tables)
        rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
        for k, v in p.items():
            m, s = moment[k]
            g = grad[k] + DECAY * v
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def calibrated(net: ByteNetwork, share: float) -> ByteNetwork:
    """``net``, trained on as many ones as zeros, for texts of which ``share`` are ones."""
    if net.constant is None:
        share = min(max(share, 0.01), 0.99)
        net.p["b2"] = net.p["b2"] + np.log(share / (1 - share))
    else:
        net.constant = share
    return net


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = TRAIN_PER_LABEL) -> ByteNetwork:
    """A network from the labelled rows that aren't held out."""
    seen = labels.filter(remainder(F.col("doc_id"), 5) > 0).filter(F.col(label).isNotNull())
    total, ones = seen.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    net = fit(sample_labelled(documents, seen, label, per_label))
    return calibrated(net, (ones or 0) / total if total else 0.5)


def score(documents: DataFrame, net: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shipped.value.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(run, SCHEMA)
