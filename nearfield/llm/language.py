"""Language identification with a string kernel.

Two texts are compared by the distinct character n-grams (n = 1 to 3) they share, normalised by how many each has: the
blended-spectrum presence kernel. A bounded number of training texts are the Nystroem landmarks; one-versus-rest kernel
ridge regression in their span gives a score for each language. Texts are scored in batches: presence matrix times
landmark matrix, normalised, times coefficients.

Defined results: a null text, or one without a letter, is ``und`` with score 0; if there is nothing to learn from, every
text is ``und``. Whole texts are read, in slices of bounded size whose n-grams are united. Repeated rows and ids give
equal rows; an id that has two languages teaches nothing. An empty table gives an empty result. Only doc_id and text are
read for a prediction, so that other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .learning import MAX_SAMPLE_BYTES, remainder, sample_labelled

#: Training texts and landmarks for each language; with more languages than MAX_LANDMARKS / 16 each has fewer, but one.
TRAIN_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 16
MAX_LANDMARKS = 1024
RIDGE = 1e-3
#: Characters looked at in one go, and cells of a batch's presence matrix.
SLICE = 1 << 20
BATCH_CELLS = 1 << 22
#: Cells of the landmark matrix that a worker holds at once.
DENSE_CELLS = 1 << 25
UNDETERMINED = "und"

_ASCII = np.arange(128, dtype=np.int64)
_ASCII[[i for i in range(128) if not chr(i).isalpha()]] = 32


def ngrams(text: str) -> np.ndarray:
    """The distinct 1-, 2- and 3-grams of ``text``, lower-cased, packed 21 bits a character, sorted."""
    found: list[np.ndarray] = []
    text = text.lower()
    for at in range(0, max(len(text), 1), SLICE):
        points = np.frombuffer(text[max(0, at - 2) : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        low = points < 128
        points[low] = _ASCII[points[low]]
        three = np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else points[:0]
        two = np.unique(np.append(three >> 21, ((points[:-1] << 21) | points[1:])[-1:]))
        one = np.unique(np.concatenate([two >> 21, points[-1:]]))
        found.append(np.concatenate([one, two, three]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class KernelModel:
    """Landmarks as sorted lists of places in the vocabulary; their matrix is made where it is used, in bounded parts."""

    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, sorted
    landmarks: list[np.ndarray]  # places of each landmark's n-grams
    coefficients: np.ndarray  # landmark by language
    _whole: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_whole": None}

    def part(self, low: int, high: int) -> np.ndarray:
        """Landmark by n-gram, presence over the root of the landmark's n-gram count, of a range of the vocabulary."""
        out = np.zeros((len(self.landmarks), high - low), np.float32)
        for k, places in enumerate(self.landmarks):
            a, b = np.searchsorted(places, [low, high])
            out[k, places[a:b] - low] = 1 / np.sqrt(len(places))
        return out

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        n, step = len(self.vocabulary), max(1, DENSE_CELLS // len(self.landmarks))
        if n > step:
            yield from ((at, min(n, at + step), self.part(at, min(n, at + step))) for at in range(0, n, step))
            return
        if self._whole is None:
            self._whole = self.part(0, n)
        yield 0, n, self._whole

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(grams), len(self.landmarks)), np.float32)
        for low, high, dense in self.parts():
            vocabulary = self.vocabulary[low:high]
            step = max(1, BATCH_CELLS // len(vocabulary))
            for at in range(0, len(grams), step):
                part = grams[at : at + step]
                present = np.zeros((len(part), len(vocabulary)), np.float32)
                for i, g in enumerate(part):
                    where = np.searchsorted(vocabulary, g)
                    where[where == len(vocabulary)] = 0
                    present[i, where[vocabulary[where] == g]] = 1
                out[at : at + step] += present @ dense.T
        return out / np.sqrt([max(len(g), 1) for g in grams]).astype(np.float32)[:, None]

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return self.kernel(grams) @ self.coefficients


def fit(rows: list[tuple[str, str]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> KernelModel | None:
    rows = [r for r in rows if any(map(str.isalpha, r[0]))]
    languages = sorted({r[1] for r in rows})
    if not languages:
        return None
    grams = [ngrams(t) for t, _ in rows]
    marks: list[int] = []
    each = max(1, min(landmarks_per_language, MAX_LANDMARKS // len(languages)))
    for lang in languages:
        own = sorted((i for i, r in enumerate(rows) if r[1] == lang), key=lambda i: -len(grams[i]))
        # every k-th by richness, so that short and long texts both serve as landmarks
        marks += own[:: max(1, len(own) // each)][:each]
    vocabulary = np.unique(np.concatenate([grams[i] for i in marks]))
    model = KernelModel(languages, vocabulary, [np.searchsorted(vocabulary, grams[i]) for i in marks], np.zeros((len(marks), len(languages)), np.float32))
    k_nm = model.kernel(grams).astype(np.float64)
    k_mm = model.kernel([grams[i] for i in marks]).astype(np.float64)
    y = np.array([[float(r[1] == lang) for lang in languages] for r in rows])
    weight = 1 / (y @ y.sum(0))  # each language weighs the same
    weight *= len(rows) / weight.sum()
    left = k_nm.T @ (weight[:, None] * k_nm) + ridge * len(rows) * k_mm + 1e-8 * np.eye(len(marks))
    model.coefficients = np.linalg.solve(left, k_nm.T @ (weight[:, None] * y)).astype(np.float32)
    return model


def predict(texts: list[str | None], model: KernelModel | None) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    for at in range(0, len(known), 512):
        part = known[at : at + 512]
        found = model.scores([ngrams(texts[i]) for i in part])
        for i, k, s in zip(part, found.argmax(1), found.max(1), strict=True):
            names[i], scores[i] = model.languages[k], float(min(max(s, 0.0), 1.0))
    return names, scores


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(documents: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(b.column("text").to_pylist(), shipped.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(run, SCHEMA)


def train(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> KernelModel | None:
    """A model from the texts and languages of the rows that aren't held out; see sample_labelled for the bound."""
    seen = documents.filter((remainder(F.col("doc_id"), 5) > 0) & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_SAMPLE_BYTES))
    return fit(sample_labelled(documents, seen, "lang", per_language))
