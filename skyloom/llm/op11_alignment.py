"""Cross-tokenizer alignment by a cogroup of postings.

Both tokenizers cut " " + text; the ends of A's and B's tokens, merged, cut it into elementary spans, and each span is one
overlapping pair of tokens: the links. Spans between ends that both have are the groups. A ids fall into ``BUCKETS`` buckets by
hash. One pass over the texts writes, for each block of about ``BLOCK`` bytes of text, a row per document and, per bucket, a row
of postings: the linked pairs of ids, in how many of the block's documents each is, and for each of these the document
and the multiplicity. Counts are so combined before any shuffle.

How many documents hold a pair is summed by (a, b), a native aggregation. Counts and postings are then dealt by bucket, which
Spark sorts (and spills) within partitions, so that a bucket's counts come first and its postings stream after them: a task
holds the counts of one bucket (their number depends on the vocabularies, not on the corpus), finds each A id's largest and
turns each row of postings into its documents' contributions, one row per document and bucket. A bucket is dealt in as
many parts, by block, as its postings need, each with the counts; so no id, however frequent, fills a task. Contributions are
summed by document and joined with the rows.

Texts are cut at spaces for B, as its pieces hold spaces only at their start, and each distinct cut is encoded once by way of a
bounded cache; a vocabulary that has other pieces gets whole texts.

Defined cases: a text that is null, empty or not given back by the joined tokens has zeros and an empty ``groups_sha256`` and
takes no part in counts; null ids stay; repeated rows are documents of their own, each counted; very long texts are a block of
their own; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, pieces, quoted
from .op1_packing import CACHED, Encoder, _byte_letters, default_tokenizer

BLOCK, PART, BUCKETS = 2 << 20, 2 << 20, 16
_CUT = re.compile(" +[^ ]*")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class SideA:
    """Ids of texts under a byte-level vocabulary, special tokens' strings being plain text, and each id's bytes."""

    def __init__(self, path: str):
        self.encode = Encoder(path)
        self.encode.tokenizer.encode_special_tokens = True
        self.encode.special = []
        back = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.encode.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int64) for x in self.encode(texts)]


class SideB:
    """Ids of texts under a piece vocabulary that adds a space in front, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        shown = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.by_cut = not any("▁" in p.lstrip("▁") for p in shown) and m.encode("  a  b ") == [i for cut in ("  a", "  b") for i in m.encode(cut[1:])] + [m.piece_to_id("▁")]
        self.known: dict[str, bytes] = {}
        self.fixed = {" ": np.array([m.piece_to_id("▁")], "<u4").tobytes()}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_cut:
            return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]
        cuts = [_CUT.findall(" " + t) for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known or self.known.update(self.fixed) or self.known
        new = list({c for each in cuts for c in each} - known.keys())
        for c, ids in zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True):
            known[c] = np.array(ids, "<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, each)), "<u4").astype(np.int64) for each in cuts]


_sides: dict[tuple, object] = {}


def _side(kind, path: str):
    """One per Python worker and file."""
    if (kind, path) not in _sides:
        _sides[kind, path] = kind(path)
    return _sides[kind, path]


def _joined(ids: np.ndarray, vocabulary: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The bytes of tokens one after another."""
    flat = np.frombuffer(b"".join(vocabulary), np.uint8)
    size = sizes[ids]
    from_ = (np.cumsum(sizes) - sizes)[ids] - (np.cumsum(size) - size)
    return flat[np.repeat(from_, size) + np.arange(int(size.sum()))]


def _per_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of values by text."""
    total = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(lengths)
    return total[end] - total[end - lengths]


def _kept(ids: list[np.ndarray], spaced: list[bytes], side) -> np.ndarray:
    """Which texts their tokens give back."""
    n, want = np.array([len(x) for x in ids], np.int64), np.array([len(s) for s in spaced], np.int64)
    same = _per_text(side.sizes[np.concatenate([np.zeros(0, np.int64), *ids])], n) == want
    at = np.flatnonzero(same)
    got = _joined(np.concatenate([np.zeros(0, np.int64), *(ids[i] for i in at)]), side.bytes, side.sizes)
    wrong = got != np.frombuffer(b"".join(spaced[i] for i in at), np.uint8)
    same[at] = _per_text(wrong, want[at]) == 0
    return same


class Aligned:
    """Tokens, groups and links of a list of texts; texts that the tokens do not give back have none."""

    def __init__(self, texts: list[str | None], a: SideA, b: SideB):
        whole = [t or "" for t in texts]
        spaced = [(" " + t).encode() if t else b"" for t in whole]
        ids_a, ids_b = a([" " + t if t else "" for t in whole]), b(whole)
        good = _kept(ids_a, spaced, a) & _kept(ids_b, spaced, b)
        none = np.zeros(0, np.int64)
        ids_a, ids_b = ([x if g else none for x, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        n = len(whole)
        self.good, self.n_a, self.n_b = good, np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        self.a, self.b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
        end_a, end_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])  # both sides of a text have the same bytes, so ends agree over all texts
        is_a, is_b = (np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool) for _ in "ab")
        is_a[end_a], is_b[end_b] = True, True
        is_both = is_a & is_b
        ends, both = np.flatnonzero(is_a | is_b), np.flatnonzero(is_both)
        before = lambda marks, at: np.cumsum(marks, dtype=np.int32)[at] - marks[at]  # how many marks lie below each place
        left, right = before(is_a, ends), before(is_b, ends)
        doc_a = np.repeat(np.arange(n), self.n_a)
        self.link_a, self.link_b, self.link_doc = self.a[left], self.b[right], doc_a[left] if len(left) else left
        self.n_links = np.bincount(self.link_doc, minlength=n)
        last_a, last_b = before(is_a, both), before(is_b, both)
        self.n_groups = np.bincount(doc_a[last_a] if len(both) else both, minlength=n)
        # tokens in the order of the groups' text: A's of a group, then B's; each with the sign that follows it
        group_a, group_b = before(is_both, end_a), before(is_both, end_b)
        first_b, until_a = np.concatenate(([0], last_b + 1)), last_a + 1
        stop_a, stop_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        stop_a[last_a], stop_b[last_b] = 1, 2
        self.signed = np.zeros(len(self.a) + len(self.b), np.int64)
        self.signed[np.arange(len(self.a)) + first_b[group_a]] = self.a * 3 + stop_a
        self.signed[np.arange(len(self.b)) + until_a[group_b]] = self.b * 3 + stop_b

    def digests(self, shown: list[str]) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        out, at, signed = [], 0, self.signed
        for n in (self.n_a + self.n_b).tolist():
            text = "".join(map(shown.__getitem__, signed[at : at + n].tolist()))
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n else "")
            at += n
        return out

    def postings(self, base: int) -> dict[str, pa.Array]:
        """Per bucket of A ids: pairs, the number of texts with each, and these texts with the pair's multiplicity in them."""
        texts = max(len(self.good), 1)
        pair, times = np.unique((((_bucket(self.link_a) << 20 | self.link_a) << 20) + self.link_b) * texts + self.link_doc, return_counts=True)
        ab, doc = pair // texts, pair % texts
        start = _starts(ab)
        pairs = ab[start]
        first = _starts(pairs >> 40)
        lists = np.append(first, len(pairs)).astype(np.int32)
        blobs = np.append(start[first], len(ab)).astype(np.int32) * 4
        ints = lambda v: pa.ListArray.from_arrays(pa.array(lists), pa.array(v.astype(np.int32)))
        blob = lambda v: pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(blobs), pa.py_buffer(v.astype("<u4"))])
        low = (1 << 20) - 1
        return {
            "key": pa.array(np.full(len(first), base)), "bucket": pa.array((pairs[first] >> 40).astype(np.int32)), "a": ints(pairs >> 20 & low), "b": ints(pairs & low),
            "count": ints(np.diff(np.append(start, len(ab)))), "docs": blob(doc), "times": blob(times),
        }


def _bucket(a: np.ndarray) -> np.ndarray:
    return (a * 2654435761 >> 16) % BUCKETS


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)])


_BLOCKS = "key long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, a array<int>, b array<int>, count array<int>, docs binary, times binary"


def _blocks(path_a: str, path_b: str, most: int):
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    kinds = pa.schema([("key", pa.int64()), ("id", pa.int64()), *((c, pa.int64()) for c in names[2:6]), ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())), ("docs", pa.binary()), ("times", pa.binary())])

    def table(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in kinds], names=names)

    def blocks(batches):
        a, b = _side(SideA, path_a), _side(SideB, path_b)
        shown = [f"{i}{sign}" for i in range(max(len(a.bytes), len(b.bytes))) for sign in (",", "|", ";")]
        key = TaskContext.get().partitionId() << 40
        for part in (x for batch in batches for x in pieces(batch, "text", most)):
            n = part.num_rows
            texts = Aligned(part.column("text").to_pylist(), a, b)
            own = {c: pa.array(getattr(texts, c)) for c in ("n_a", "n_b", "n_groups", "n_links")}
            yield table({"key": pa.array(key + np.arange(n)), "id": part.column("id"), "groups_sha256": pa.array(texts.digests(shown)), **own}, n)
            posted = texts.postings(key)
            if len(posted["key"]):
                yield table(posted, len(posted["key"]))
            key += n

    return blocks


def _contribute(batches):
    """Contributions to documents from rows in the order of (bucket, part): a bucket's counts (no ``docs``), then postings."""
    at, counted, known, best = None, [], None, None
    for batch in batches:
        buckets, parts = (batch.column(c).to_numpy() for c in ("bucket", "part"))
        keys = pc.fill_null(batch.column("key"), 0).to_numpy()
        is_count = batch.column("docs").is_null().to_numpy(zero_copy_only=False)
        a, b, count = (batch.column(c) for c in ("a", "b", "count"))
        ends = b.offsets.to_numpy()
        shift = ends[0]
        ab = (a.flatten().to_numpy().astype(np.int64) << 32) + b.flatten().to_numpy()
        number = count.flatten().to_numpy().astype(np.int64)
        for i in range(batch.num_rows):
            own = slice(ends[i] - shift, ends[i + 1] - shift)
            if (buckets[i], parts[i]) != at:
                at, counted, known = (buckets[i], parts[i]), [], None
            if is_count[i]:
                counted.append((ab[own].copy(), number[own].copy()))
                continue
            if known is None:
                known, total = (np.concatenate(x) for x in zip(*counted, strict=True))
                order = np.argsort(known, kind="stable")
                known, total = known[order], total[order]
                first = _starts(known >> 32)
                best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(known))))
                counted = []
            docs, times = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u4").astype(np.int64) for c in ("docs", "times"))
            place = np.repeat(np.searchsorted(known, ab[own]), number[own])
            n = int(docs.max()) + 1
            # sums of whole numbers; a document's links are far below 2^53, sums of their counts are kept exact in two halves
            of = lambda w: np.bincount(docs, w, n).astype(np.int64)
            weight = times * total[place]
            sums, bests = of(weight & 0xFFFFFF) + (of(weight >> 24) << 24), of(times * best[place])
            there = np.flatnonzero(np.bincount(docs, minlength=n))
            yield pa.RecordBatch.from_arrays([pa.array(keys[i] + there), pa.array(bests[there]), pa.array(sums[there])], names=["key", "n_best", "count_sum"])


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, block: int = BLOCK, part: int = PART) -> DataFrame:
    """One row per row of ``df``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``part``: bytes of postings that a task gets at once, more where a bucket's counts are large.
    """
    spark, made = df.sparkSession, []
    texts = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    blocks = durable(texts.mapInArrow(_blocks(path_a or default_tokenizer(), path_b or default_pieces(), block), _BLOCKS))
    posted = blocks.filter("bucket IS NOT NULL").select("bucket", "a", "b", "count", "key", "docs", "times")
    pairs = posted.select("bucket", F.explode(F.arrays_zip("a", "b", "count")).alias("p")).groupBy("bucket", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.count").alias("count"))
    # one row per A id, of at most as many entries as B has ids
    each = pairs.groupBy("bucket", "a").agg(F.collect_list(F.struct("a", "b", "count")).alias("all"))
    counts = durable(each.select("bucket", F.col("all.a").alias("a"), F.col("all.b").alias("b"), F.col("all.count").alias("count")), made)
    load = posted.groupBy("bucket").agg(F.sum(F.length("docs") * 2).alias("bytes")).join(counts.groupBy("bucket").agg(F.sum(F.size("b") * 12).alias("own")), "bucket")
    parts = F.broadcast(load.select("bucket", (F.expr(f"bytes div greatest({part}, 4 * own)") + 1).cast("int").alias("parts")))  # a row per bucket
    copies = counts.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = posted.withColumn("count", F.col("count").cast("array<long>")).join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).drop("parts")
    both = copies.unionByName(dealt, allowMissingColumns=True).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("docs").isNotNull())
    sums = both.select("bucket", "part", "a", "b", "count", "key", "docs", "times").mapInArrow(_contribute, "key long, n_best long, count_sum long").groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = durable(sums)
    forget(spark, made)
    rows = blocks.filter("bucket IS NULL").select("key", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "key", "left")
    return rows.select(id_col, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
