"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

A text is escaped as the library does it: a dummy blank in front, every space as U+2581. It is cut into units over
which no piece of the vocabulary reaches: runs of blanks with the characters after them, what follows a letter that no
piece joins to letters (most marks), and characters that no longer piece has. Within a unit, adjacent symbol pairs that are pieces wait in an agenda ordered by score, leftmost first; the
best pair is merged and its new neighbours join the agenda. What ends up outside the vocabulary becomes byte pieces.
Units recur, so their ids are kept in two bounded generations of a table.

Every unit that is not in the table, so each at least once, is checked against the sentencepiece library within its
Arrow batch, at most FRESH_UNITS at a time, and so is one whole text of each batch; a difference raises. Decoding is the library's own.

Defined results: a null text counts as empty; an empty text is the end id alone and decodes to an empty text. Texts of
any length are encoded whole. Rows keep their order and number, repeated ones give equal rows, an empty table gives an
empty result. Only doc_id and text are read, so that other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

BLANK = "▁"
#: Units in one generation of the table, and the longest unit that is kept.
KEPT_UNITS = 250_000
KEPT_CHARS = 48
#: Units that wait to be checked against the library.
FRESH_UNITS = 8192


class MergeEncoder:
    """The vocabulary at ``path``, encoding by agenda."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        bytes_at: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_at[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
        self.byte_ids = [bytes_at.get(b) for b in range(256)] if bytes_at else None
        self.unknown = sp.unk_id()
        self.end = sp.eos_id()
        longer = [p for p in self.ids if len(p) > 1]
        inner = sorted({c for p in longer for c in p} - {BLANK})
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            self.unit = re.compile(r"(?s).+")  # pieces reach over blanks: a text is one unit
        else:
            marks, letters = (f"[{''.join(map(re.escape, c))}]" if c else "(?!)" for c in self._joined(inner, longer))
            self.unit = re.compile(f"(?s){BLANK}+{marks}*{letters}*|{marks}+{letters}*|{letters}+|.") if inner else re.compile("(?s).")
        self._pairs(inner)
        self.newline_alone = "\n" not in inner
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.fresh: list[tuple[str, tuple[int, ...]]] = []

    @staticmethod
    def _joined(inner: list[str], longer: list[str]) -> tuple[list[str], list[str]]:
        """(marks, letters): the letters are all that pieces reach from a letter on, so that no piece has a mark behind them."""
        after: dict[str, set[str]] = {}
        for p in longer:
            for a, b in zip(p, p[1:]):
                after.setdefault(a, set()).add(b)
        letters = {c for c in inner if c.isalpha()}
        todo = list(letters)
        while todo:
            new = after.get(todo.pop(), set()) - letters - {BLANK}
            letters |= new
            todo += new
        return [c for c in inner if c not in letters], [c for c in inner if c in letters]

    def _pairs(self, inner: list[str]) -> None:
        """Tables of the merges: a code for each symbol, and for each pair of codes the rank of the score and the piece.

        A piece's code is its id. Characters that pieces have but that are no pieces get codes beyond; all others share one.
        """
        lone = [c for c in [*inner, BLANK] if c not in self.ids]
        size = self.library.get_piece_size()
        self.code = {**self.ids, **{c: size + 1 + k for k, c in enumerate(lone)}}
        self.other = size
        # one number and one name of each id, however many units have it
        self.own = list(range(size))
        self.names = list(map(str, self.own))
        rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.pairs: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.code.get(piece[:cut]), self.code.get(piece[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank[self.score[piece]] << 36 | i

    def merge(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit by the agenda of adjacent pairs.

        An entry of the agenda is one number, in order: rank of the score, place of the left symbol, piece. ``now`` has
        the entry of each left symbol; another one is stale.
        """
        code, pairs, other, own, n = self.code, self.pairs, self.other, self.own, len(unit)
        places = 0xFFFF
        if n > places:  # a place needs more bits
            pairs, places = {k: v >> 36 << 60 | v & 0xFFFFF for k, v in pairs.items()}, 0xFFFFFFFFFF
        find = pairs.get
        symbol = [code.get(c, other) for c in unit]
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        now = [None if (v := find(a << 20 | b)) is None else v + (i << 20) for i, (a, b) in enumerate(zip(symbol, symbol[1:]))]
        now.append(None)
        agenda = [e for e in now if e is not None]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            e = pop(agenda)
            i = e >> 20 & places
            if now[i] != e:
                continue
            j = right[i]
            symbol[i] = m = e & 0xFFFFF
            symbol[j] = -1
            now[i] = now[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                v = find(m << 20 | symbol[k])
                if v is not None:
                    now[i] = v = v + (i << 20)
                    push(agenda, v)
            h = left[i]
            if h >= 0:
                v = find(symbol[h] << 20 | m)
                if v is None:
                    now[h] = None
                else:
                    now[h] = v = v + (h << 20)
                    push(agenda, v)
        if max(symbol) < other:
            return tuple([own[s] for s in symbol if s >= 0])
        out: list[int] = []
        for c, s in zip(unit, symbol, strict=True):
            if s >= other:
                out.extend(self._out(c))
            elif s >= 0:
                out.append(own[s])
        return tuple(out)

    def _out(self, symbol: str) -> tuple[int, ...]:
        if self.byte_ids is None:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in symbol.encode("utf-8"))

    def of_unit(self, unit: str) -> tuple[int, ...]:
        got = self.old.get(unit)
        if got is None:
            got = self.merge(unit)
            self.fresh.append((unit, got))
            if len(self.fresh) >= FRESH_UNITS:
                self.check()
        if len(unit) <= KEPT_CHARS:
            if len(self.young) >= KEPT_UNITS:
                self.old, self.young = self.young, {}
            self.young[unit] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without the end id."""
        if not text:
            return []
        out: list[int] = []
        for u in self.unit.findall(BLANK + text.replace(" ", BLANK)):
            got = self.young.get(u)
            out += got if got is not None else self.of_unit(u)
        return out

    def check(self) -> None:
        """Hold the units encoded since the last call against the library."""
        fresh, self.fresh = self.fresh, []
        led = [(u, ids) for u, ids in fresh if u.startswith(BLANK)]
        rest = [(u, ids) for u, ids in fresh if not u.startswith(BLANK)]
        # the library puts a blank in front of what it is given; behind a newline, which joins no piece, a unit stands alone
        expected = self.library.encode([u[1:].replace(BLANK, " ") for u, _ in led], num_threads=1) if led else []
        for (u, ids), want in zip(led, expected, strict=True):
            if u != BLANK and list(ids) != want:
                raise ValueError(f"unit {u!r}: {list(ids)} but the library has {want}")
        if rest and self.newline_alone:
            lead = self.library.encode("\n", num_threads=1)
            for (u, ids), want in zip(rest, self.library.encode(["\n" + u for u, _ in rest], num_threads=1), strict=True):
                if lead + list(ids) != want:
                    raise ValueError(f"unit {u!r}: {list(ids)} but the library has {want[len(lead):]}")

    def check_text(self, text: str, ids: list[int]) -> None:
        if ids != self.library.encode(text, num_threads=1):
            raise ValueError(f"a text of {len(text)} characters is encoded differently by the library")


_encoders: dict[str, MergeEncoder] = {}


def encoder(path: str) -> MergeEncoder:
    """The encoder of a worker process, made once."""
    if path not in _encoders:
        _encoders[path] = MergeEncoder(path)
    return _encoders[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_row(enc: MergeEncoder, text: str, ids: list[int]) -> tuple[int, str, str]:
    line = " ".join(map(enc.names.__getitem__, ids))
    return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(enc.library.decode(ids).encode("utf-8")).hexdigest()


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [_encoded(enc, t.as_py() or "", k == 0) for k, t in enumerate(b.column("text"))]
            enc.check()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.library.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def _encoded(enc: MergeEncoder, text: str, whole: bool) -> list[int]:
    ids = enc.encode(text)
    if whole:
        enc.check_text(text, ids)
    return [*ids, enc.end]


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for k, t in enumerate(b.column("text")):
                text = t.as_py() or ""
                rows.append(digest_row(enc, text, _encoded(enc, text, k == 0)))
            enc.check()
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
