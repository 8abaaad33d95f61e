"""Secret scanning with base patterns and a character convolutional network, in numpy.

Three base patterns give spans that always stand. Further candidates are tokens of any length that look like keys; a
network reads each candidate with its surrounding characters, a long one in overlapping windows, and the highest
probability of its windows is the candidate's. It is trained on findings labelled here: the base findings of a bounded
sample of texts and generated keys of common formats are positive; tokens of the sample that no base pattern covers and
that don't look like keys, and generated identifiers of harmless kinds, are negative. A part of the findings is held
back: on it the probability is calibrated by a logistic map, and the threshold is the highest that keeps MIN_RECALL.

Defined results: a null text counts as empty; an empty text has no span. Texts are read whole; offsets count code
points, ends are exclusive. Matches of a kind don't overlap. Candidates that overlap a base span are not added again.
Repeated rows give equal rows. Only doc_id and text are read, so that other columns, whatever their names, don't matter;
an empty table gives an empty result and a network trained on generated findings alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .learning import MAX_SAMPLE_BYTES

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is long enough is matched whole, a shorter one is dropped either way
#: Tokens that the network judges.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])(?=[0-9+/_=.-]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}(?![A-Za-z0-9+/_=.-])")
#: The base patterns in one, for Spark: whether a text has a base finding.
SIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
BEFORE, INSIDE = 24, 40
#: Characters from one window of a long candidate to the next.
STRIDE = INSIDE // 2
LENGTH = BEFORE + INSIDE + 8
TAPS, WIDTH, FILTERS = 5, 10, 24
#: Texts in the sample that training looks at, and generated findings of each kind.
SAMPLE_TEXTS = 1500
GENERATED = 500
EPOCHS = 12
MIN_RECALL = 0.95
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens that don't overlap the base spans, which are in order of start."""
    starts = [s for s, _, _ in base]
    upto = list(accumulate((e for _, _, e in base), max))
    out = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the token's end
        if not before or upto[before - 1] <= m.start():
            out.append(m.span())
    return out


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows that cover a candidate; one where it is short."""
    yield from ((at, at + INSIDE) for at in range(start, end - INSIDE, STRIDE))
    yield max(start, end - INSIDE), end


def window(text: str, start: int, end: int, at: int, to: int) -> np.ndarray:
    """Character codes around a candidate: what is before it, its piece from ``at`` to ``to``, what is after it."""
    line = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[at:to].ljust(INSIDE, "\0") + text[end : end + 8].ljust(8, "\0")
    return np.frombuffer(line.encode("latin-1", "replace"), np.uint8).astype(np.int64) & 127


def extra(text: str, start: int, end: int) -> list[float]:
    """Length, entropy and mix of a piece of a candidate."""
    core = text[start:end]
    n = len(core)
    counts = np.bincount(np.frombuffer(core.encode("ascii", "replace"), np.uint8))
    p = counts[counts > 0] / n
    return [n / 64, float(-(p * np.log2(p)).sum()) / 6, sum(c.isdigit() for c in core) / n, sum(c.isupper() for c in core) / n, sum(c in "._-/" for c in core) / n]


@dataclass
class CharNetwork:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray, more: np.ndarray):
        x = self.p["embed"][codes]
        n = LENGTH - TAPS + 1
        cols = np.concatenate([x[:, t : t + n] for t in range(TAPS)], 2)
        z = cols @ self.p["filters"] + self.p["bias"]
        # the pooling keeps context and candidate apart
        parts = [(0, BEFORE - TAPS + 1), (BEFORE - TAPS + 1, n)]
        at = [a + z[:, a:b].argmax(1) for a, b in parts]
        top = np.concatenate([np.take_along_axis(z, k[:, None], 1)[:, 0] for k in at], 1)
        features = np.concatenate([np.maximum(top, 0), more], 1)
        hidden = np.tanh(features @ self.p["w1"] + self.p["b1"])
        return cols, at, top, features, hidden, hidden @ self.p["w2"] + self.p["b2"]

    def probability(self, codes: np.ndarray, more: np.ndarray) -> np.ndarray:
        logit = self.forward(codes, more)[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def generated(rng: np.random.Generator) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before the key, key, after it, label) of common key formats and of harmless identifiers.

    Some keys, and some identifiers, stand in the middle of a long path or query string.
    """
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda abc, n: "".join(abc[i] for i in rng.integers(len(abc), size=n))
    out = []
    leads = ["key: ", "auth=", "Bearer ", "credential ", "export K=", "private_key ", "the ", "", "use ", "access: "]
    plain = ["file ", "see ", "id ", "version ", "the ", "", "in ", "at ", "path ", "item "]
    for _ in range(GENERATED):
        good = [
            draw(letters, int(rng.integers(24, 48))), "ghp_" + draw(letters, 36), "sk-" + draw(letters, 32), "xoxb-" + draw("0123456789", 12) + "-" + draw(letters, 24),
            base64.b64encode(rng.bytes(int(rng.integers(18, 40)))).decode(), "eyJ" + draw(letters, 20) + "." + draw(letters, 30) + "." + draw(letters, 28), "AIza" + draw(letters + "-_", 35),
        ]
        words = ["data", "report", "part", "image", "final", "index", "page", "chapter", "module", "table", "test", "build", "item", "section", "summary", "release"]
        w = lambda: words[int(rng.integers(len(words)))]
        year = f"20{draw('012', 1)}{draw('0123456789', 1)}"
        bad = [
            f"{w()}-{w()}-{year}-{draw('01', 1)}{draw('123456789', 1)}", f"{w()}_{w()}_{draw('0123456789', 3)}.txt", f"www.{w()}{w()}.com/{w()}/{draw('0123456789', 4)}", f"{w()}/{w()}/{w()}{draw('0123456789', 2)}.html",
            f"{w()}.{draw('0123456789', 2)}.mail{draw('0123456789', 1)}.example.com", f"v{draw('123', 1)}.{draw('0123456789', 2)}.{draw('0123456789', 1)}-{w()}.{draw('0123456789', 1)}", f"{w()}{w()}{w()}{draw('0123456789', 2)}",
        ]
        k = int(rng.integers(7))
        out.append((leads[int(rng.integers(10))], good[k], " and " + w(), 1))
        out.append((plain[int(rng.integers(10))], bad[k], " and " + w(), 0))
        path = lambda: "/".join(w() + (draw("0123456789", 2) if rng.integers(3) == 0 else "") for _ in range(int(rng.integers(2, 12))))
        mark = ["/", "=", "/id=", "-", "_"][int(rng.integers(5))]
        out.append((plain[int(rng.integers(10))] + path() + mark, good[k], "/" + path() + " and " + w(), 1))
        out.append((plain[int(rng.integers(10))], path() + mark + bad[k] + "/" + path(), " and " + w(), 0))
    return out


def labelled_pieces(texts: list[str], seed: int = 11, unsure: Collection[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, extra features, label, number of the finding) of the windows of all findings to learn from.

    Of a key within a longer token the window that holds most of it is there, since the others may hold none. Tokens in
    ``unsure`` aren't there.
    """
    codes, more, y, of = [], [], [], []

    def add(text, start, end, label, low, high):
        spans = list(pieces(start, end))
        if (start, end) != (low, high) and label:
            spans = [max(spans, key=lambda x: min(x[1], high) - max(x[0], low))]
        for at, to in spans:
            codes.append(window(text, start, end, at, to))
            more.append(extra(text, at, to))
            y.append(label)
            of.append(n)

    n = 0
    for t in texts:
        base = base_spans(t)
        for start, kind, end in base:
            if kind == 0:
                value = ASSIGN.match(t, start)
                start = value.start(2)
            add(t, start, end, 1, start, end)
            n += 1
        for start, end in candidates(t, base):
            if t[start:end] not in unsure:
                add(t, start, end, 0, start, end)
                n += 1
    for a, core, b, label in generated(np.random.default_rng(seed)):
        text = a + core + b
        start, end = next((m.span() for m in CANDIDATE.finditer(text) if m.start() <= len(a) and len(a) + len(core) <= m.end()), (len(a), len(a) + len(core)))
        add(text, start, end, label, len(a), len(a) + len(core))
        n += 1
    return np.array(codes), np.array(more), np.array(y, float), np.array(of)


def labelled_findings(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, extra features, label) of the first window there is of each finding to learn from."""
    codes, more, y, of = labelled_pieces(texts, seed)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return codes[first], more[first], y[first]


def fit(texts: list[str], epochs: int = EPOCHS, seed: int = 11) -> CharNetwork:
    """A network that takes the tokens of ``texts`` outside base spans as harmless, but for those that look like keys.

    Such tokens are found by a first network, which learns from base findings and generated ones only; what it takes for a
    secret may be one that no base pattern knows, and teaches the second network nothing.
    """
    first = fit_pieces(*labelled_pieces([t[s:e] for t in texts for s, _, e in base_spans(t)], seed), epochs, seed)
    tokens = {t[s:e] for t in texts for s, e in candidates(t, base_spans(t))}
    unsure = {t for t, spans in zip(tokens, scan([*tokens], first), strict=True) if spans}
    return fit_pieces(*labelled_pieces(texts, seed, unsure), epochs, seed)


def fit_pieces(codes: np.ndarray, more: np.ndarray, y: np.ndarray, of: np.ndarray, epochs: int, seed: int) -> CharNetwork:
    """A network with calibrated probability and a threshold that keeps MIN_RECALL on the findings held back."""
    rng = np.random.default_rng(seed)
    held_back = rng.permutation(of[-1] + 1) < (of[-1] + 1) // 4  # by finding, so that all windows of one are on the same side
    back, learn = np.flatnonzero(held_back[of]), np.flatnonzero(~held_back[of])
    p = {
        "embed": rng.normal(0, 0.4, (128, WIDTH)), "filters": rng.normal(0, 0.2, (TAPS * WIDTH, FILTERS)), "bias": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.2, (2 * FILTERS + 5, 16)), "b1": np.zeros(16), "w2": rng.normal(0, 0.3, 16), "b2": np.zeros(1)[0],
    }
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \n\t")):
        p["embed"][[ord(c) for c in members], k] += 1
    net = CharNetwork(p)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-9), 0.5 / max(1 - y[learn].mean(), 1e-9))
    for _ in range(epochs):
        for at in range(0, len(learn), 64):
            rows = rng.choice(learn, 64)
            cols, won, top, features, hidden, logit = net.forward(codes[rows], more[rows])
            err = weight[rows] * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[rows]) / len(rows)
            d_hidden = np.outer(err, p["w2"]) * (1 - hidden**2)
            d_features = d_hidden @ p["w1"].T
            g = {"w2": hidden.T @ err, "b2": err.sum(), "w1": features.T @ d_hidden, "b1": d_hidden.sum(0), "filters": np.zeros_like(p["filters"]), "bias": np.zeros(FILTERS), "embed": np.zeros_like(p["embed"])}
            for part in range(2):
                d = d_features[:, part * FILTERS : (part + 1) * FILTERS] * (top[:, part * FILTERS : (part + 1) * FILTERS] > 0)
                g["bias"] += d.sum(0)
                picked = np.take_along_axis(cols, won[part][:, :, None], 1)  # row, filter, tap and width
                g["filters"] += np.einsum("rfc,rf->cf", picked, d)
                back_to = np.einsum("rf,cf->rfc", d, p["filters"]).reshape(len(rows), FILTERS, TAPS, WIDTH)
                for t in range(TAPS):
                    np.add.at(g["embed"], codes[rows][np.arange(len(rows))[:, None], won[part] + t], back_to[:, :, t])
            step += 1
            for k in p:
                m, s = moment[k]
                m = moment[k][0] = 0.9 * m + 0.1 * g[k]
                s = moment[k][1] = 0.999 * s + 0.001 * g[k] ** 2
                p[k] = p[k] - 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    first = np.flatnonzero(np.diff(of[back], prepend=-1))  # the highest window of each finding held back
    logit, truth = np.maximum.reduceat(net.forward(codes[back], more[back])[-1], first), y[back][first]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt's map, by gradient on the findings held back
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        a -= 0.1 * float(((q - truth) * logit).mean())
        b -= 0.1 * float((q - truth).mean())
    net.slope, net.shift = max(a, 0.05), b
    positive = np.sort(1 / (1 + np.exp(-np.clip(net.slope * logit + net.shift, -40, 40)))[truth == 1])
    if len(positive):
        net.threshold = float(positive[int((1 - MIN_RECALL) * len(positive))])
    return net


def scan(texts: list[str], net: CharNetwork) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: base spans, and candidates of which a window's probability reaches the threshold."""
    base = [base_spans(t) for t in texts]
    out = [list(b) for b in base]
    todo = ((k, s, e, at, to) for k, t in enumerate(texts) for s, e in candidates(t, base[k]) for at, to in pieces(s, e))
    found = set()
    while part := list(islice(todo, 2048)):
        q = net.probability(np.array([window(texts[k], s, e, at, to) for k, s, e, at, to in part]), np.array([extra(texts[k], at, to) for k, _, _, at, to in part]))
        found.update((k, s, e) for (k, s, e, _, _), x in zip(part, q, strict=True) if x >= net.threshold)
    for k, s, e in found:
        out[k].append((s, 3, e))
    return [sorted(b) for b in out]


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> CharNetwork:
    """A network from a bounded sample of texts: half of them with a base finding and half without, as far as there are.

    They are drawn by a hash over all rows, so that the order of the table doesn't matter.
    """
    sized = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_SAMPLE_BYTES))
    sign = F.col("text").rlike(SIGN)
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    counts = {r[0]: r[1] for r in sized.groupBy(sign).count().collect()}
    n = {k: counts.get(k, 0) for k in (True, False)}
    half = sample_texts // 2
    want = {k: min(n[k], max(half, sample_texts - min(n[not k], half))) for k in n}
    want[False] = min(want[False], sample_texts - want[True])
    # a little more than wanted is drawn, of which those of the lowest hashes are taken
    share = {k: int(min(1.0, (1.1 * want[k] + 50) / max(n[k], 1)) * (1 << 30)) for k in n}
    drawn = (spread < max(share.values())) & (spread < F.when(sign, F.lit(share[True])).otherwise(F.lit(share[False])))
    rows = sorted(sized.select(spread.alias("h"), sign.alias("sign"), "text", drawn.alias("drawn")).filter("drawn").select("h", "sign", "text").limit(2 * sample_texts + 400).collect(), key=lambda r: (r[0], r[2]))
    return fit(sorted(t for k in n for t in [r[2] for r in rows if r[1] == k][: want[k]]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(documents: DataFrame, net: CharNetwork) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = scan([t.as_py() or "" for t in b.column("text")], shipped.value)
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(3)]
            digests = pa.array([hashlib.sha256(join([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digests, pa.array([join(s) for s in spans], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by MASK."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, net: CharNetwork) -> DataFrame:
    """``documents`` with every secret masked in ``text``; n_chars, where it is there, follows. Other rows and columns stay."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(net)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            spans = scan([t or "" for t in texts], shipped.value)
            new = [redact_text(t, s) if t and s else t for t, s in zip(texts, spans, strict=True)]
            columns = [b.column(k) for k in range(b.num_columns)]
            columns[names.index("text")] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = b.column("n_chars").to_pylist()
                columns[k] = pa.array([len(x) if s and x is not None else o for x, s, o in zip(new, spans, old, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(run, documents.schema)
