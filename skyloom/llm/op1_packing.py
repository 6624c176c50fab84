"""Packing by Karmarkar-Karp multiway differencing.

One pass, no shuffle: each task tokenizes its documents, gives every full ``capacity`` of a document a sequence of its
own and gathers the remainders, cut to at most ``cut`` ids, until they fill about ``windows`` sequences. Differencing
then merges partial partitions, the two of largest spread first, large slots onto small ones, so window sums come out
nearly equal; if one exceeds the capacity the number of windows rises by one and the merge is repeated. Memory holds one
such gathering. Sequence ids are a task's number and a counter, the same on every attempt of a task.

Token ids come from the tokenizer file by way of a bounded cache: texts of plain Latin characters are split as the
tokenizer's own pre-tokenizer splits them and each distinct piece is encoded once; all other texts (and those that
spell a special token) are encoded whole.

Defined cases: null or empty text is the single end id; null ids stay null; repeated rows are packed once each, so their pieces
agree in doc_id and start; a very long text is held whole while it is encoded and fills sequences of its own, its remainder is
packed like others; other columns, whatever their names, are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pieces


CAPACITY, CUT, WINDOWS, CACHED = 1024, 256, 192, 400_000
_PLAIN = re.compile("[\\t\\n\\x0b\\x0c\\r -~À-ÖØ-öø-ſ‘’“”–—…€]*")
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ſ0-9]+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable letter."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces by piece; a second generation keeps the frequent ones when the first is full."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters, self.old = tokenizer.model, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
        self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Little-endian 32-bit ids of texts, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = kind["model"]["type"] == "BPE" and not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.pieces = _Pieces(self.tokenizer)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        odd, get = [], self.pieces.__getitem__
        for i, t in enumerate(texts):
            if self.by_piece and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                out[i] = b"".join(map(get, _PIECE.findall(t)))
            else:
                odd.append(i)
        if odd:
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        self.pieces.age()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One per Python worker and file, so that its pieces serve later tasks as well."""
    path = path or default_tokenizer()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each item and the windows' sums, for ``m`` windows."""
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    states = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        sums, slots = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[0], slots[0] = sizes[i], i
        states.append((sums, slots))
    heap = [(-int(s[0][0]), i) for i, s in enumerate(states)]
    heapq.heapify(heap)
    base, nodes = 0, len(sizes)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = states[a], states[b]
        sb, nb = sb[::-1], nb[::-1]
        sums = sa + sb
        both = (na >= 0) & (nb >= 0)
        slots = np.where(na >= 0, na, nb)
        k = int(both.sum())
        if k:
            left += na[both].tolist()
            right += nb[both].tolist()
            slots[both] = np.arange(nodes, nodes + k)
            nodes += k
        order = np.argsort(-sums, kind="stable")
        sums, slots = sums[order], slots[order]
        base += int(sums[-1])
        sums = sums - sums[-1]
        states[a], states[b] = (sums, slots), None
        heapq.heappush(heap, (-int(sums[0]), a))
    sums, slots = states[heap[0][1]]
    window = np.zeros(len(sizes), np.int64)
    for w, root in enumerate(slots.tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < len(sizes):
                window[x] = w
            else:
                stack += [left[x], right[x]]
    return window, sums + base


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity`` for all items; one more window whenever capacity is exceeded."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, m)
        if sums.max() <= capacity:
            return window
        m += 1


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, cut: int = CUT, windows: int = WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and (if asked for) its ids."""
    if cut > capacity or cut < 1:
        raise ValueError("cut must be between 1 and capacity")
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches):
        encode, base, made = encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []  # id, start, ids, tokens of the document
        held = 0

        def emit(rows):
            cols = list(zip(*rows, strict=True))
            crc = [zlib.crc32(x) for x in cols[2]]
            length = [len(x) // 4 for x in cols[2]]
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())]
            if with_ids:
                at = np.concatenate(([0], np.cumsum(length)))
                arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(cols[2]), "<u4").view("<i4"), pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def close():
            nonlocal waiting, held, made
            sizes = np.array([len(x[2]) // 4 for x in waiting], np.int64)
            window = fill(sizes, capacity)
            used: dict[int, int] = {}
            rows = []
            for x, w, n in zip(waiting, window.tolist(), sizes.tolist(), strict=True):
                rows.append((*x, base + made + w, used.get(w, 0)))
                used[w] = used.get(w, 0) + n
            made += int(window.max()) + 1
            waiting, held = [], 0
            return emit(rows)

        for batch in (part for whole in batches for part in pieces(whole, "text")):
            ids = batch.column("id").to_pylist()
            rows = []
            for doc, own in zip(ids, encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                own += end
                n = len(own) // 4
                full = n // capacity * capacity
                for s in range(0, full, capacity):
                    rows.append((doc, s, own[4 * s : 4 * (s + capacity)], n, base + made, 0))
                    made += 1
                for s in range(full, n, cut):
                    waiting.append((doc, s, own[4 * s : 4 * (s + cut)], n))
                held += n - full
                if held >= windows * capacity:
                    yield close()
            if rows:
                yield emit(rows)
        if waiting:
            yield close()

    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return docs.mapInArrow(run, _SCHEMA + (", ids array<int>" if with_ids else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
