"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) with the chain of up to ``chain`` content words that follow it in the text. A
word with no anchor among it and the ``reach`` - 1 words before it opens a signature with its next word. Both rules look
at a text's own words only and hold for texts of every length, so every text with a word has a signature. The fingerprint
lists all of a text's signature hashes, ascending, after their number, so it grows with the text.

Sets are partitioned by length: class c holds lengths in [t^-c, t^-(c+1)), so sets of likeness t are at most one class
apart. Likeness is the Jaccard similarity of the full sets; where a least likeness is asked for, pairs whose lengths rule
it out are pruned before their signatures are compared. ``similar`` is the self-join: candidates of the same or the next
class meet on the rarest-first prefix of their signatures that similar sets must share. ``neighbours`` compares a stated
pair list: each text with its edited text and with the next document, and names its length class.

``neighbours`` deals texts by ranges of (descending id, hash of the text). The ranges' first rows, one key for each
partition of the shuffle, come from a narrow sort and are all that the driver holds; such a row also goes to the range
before it, as the successor of that range's last text. A task streams its sorted rows and holds one batch.

Common words are those of four languages below, a parameter. Defined cases: null text is empty; blank texts have the
fingerprint ``0:`` and are like each other (1.0), unlike all others; rows with equal ids are ordered by their text's
hash; null ids come last; extra columns are dropped; empty input gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, hash_spans, lower, mix, pieces, stripped, text_bytes, words

CHAIN, REACH, THRESHOLD, PIECE = 2, 10, 0.8, 2 << 20
#: Frequent words of four languages.
COMMON = tuple(
    "the of and to in is it that was for on are as with be at by this have from or an they which you there is not but "
    "der die das und ist ein eine nicht mit von zu auf für den im des als auch es sich dem "
    "le la les de des et un une est que qui dans pour sur pas au par du elle ou "
    "el los las que en una por con para no del se al lo como más su y es".split()
)
_END = U64(0x5851F42D4C957F2D)
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def signature_sets(column, common=COMMON, chain: int = CHAIN, reach: int = REACH) -> list[np.ndarray]:
    """Sorted distinct signature hashes of each text."""
    data, at = text_bytes(column)
    data = lower(data)
    starts, ends, first = words(data, at)
    h = hash_spans(data, *stripped(data, starts, ends, _PUNCT))
    anchors = text_bytes(pa.array(sorted(set(common)), pa.string()))
    known = np.sort(hash_spans(anchors[0], anchors[1][:-1], anchors[1][1:]))
    is_anchor = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    doc, word = np.repeat(np.arange(len(at) - 1), np.diff(first)), np.arange(len(h))
    content, spot = np.flatnonzero(~is_anchor), np.flatnonzero(is_anchor)
    following, last = np.searchsorted(content, spot), np.searchsorted(content, first)[doc[spot] + 1]
    chained, padded = h[spot], np.concatenate((h[content], np.zeros(chain, U64)))
    for j in range(chain):
        chained = mix(chained * U64(3) + np.where(following + j < last, padded[following + j], _END))
    seen = np.concatenate(([0], np.cumsum(is_anchor)))
    bare = np.flatnonzero(seen[word + 1] == seen[np.maximum(first[doc], word - reach + 1)])
    after = np.where(bare + 1 < first[doc[bare] + 1], np.concatenate((h, [_END]))[bare + 1], _END)
    signature, owner = np.concatenate((chained, mix(h[bare] * U64(5) + after))), np.concatenate((doc[spot], doc[bare]))
    order = np.lexsort((signature, owner))
    signature, owner = signature[order], owner[order]
    new = np.concatenate(([True], (signature[1:] != signature[:-1]) | (owner[1:] != owner[:-1])))[: len(owner)]
    return np.split(signature[new], np.searchsorted(owner[new], np.arange(1, len(at) - 1))) if len(at) > 1 else []


def _sets(texts: list[str], common, chain: int) -> list[np.ndarray]:
    """``signature_sets`` of slices of about 2 MB."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return [x for part in pieces(batch, "text", PIECE) for x in signature_sets(part.column(0), common, chain)]


def fingerprint(signatures: np.ndarray) -> str:
    return f"{len(signatures)}:" + signatures.astype(">u8").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted signature sets; 0 where their lengths rule out ``least``; sizes 0 and 0 are equal."""
    short, long = sorted((len(x), len(y)))
    if not short or short < least * long:
        return float(long == 0)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (short + long - both)


def length_class(n: Column, threshold: float = THRESHOLD) -> Column:
    """The class of sets of ``n`` signatures; -1 for empty sets."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)).otherwise(F.lit(-1)).cast("int")


_KEY = np.dtype([("none", np.int8), ("down", np.int64), ("hash", np.int64)])


def _ranges(keyed: DataFrame, parts: int) -> np.ndarray:
    """The first key of each non-empty range of the narrow table, at most ``parts`` of them."""
    order = ["none", "down", "hash"]
    dealt = keyed.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("k"))
    return np.array(sorted({tuple(r["k"]) for r in dealt.collect()}), _KEY)


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, common=COMMON, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of each text and of its text with the last third replaced by the start of the next text.

    Texts are ordered by descending id, the first follows the last. ``parts``: ranges, by default the shuffle partitions.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = df.withColumns({"none": F.col("doc_id").isNull().cast("byte"), "down": F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "hash": F.xxhash64("text")})
    heads = _ranges(keyed, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    m = max(1, len(heads))

    @F.arrow_udf("array<int>")
    def places(none: pa.Array, down: pa.Array, digest: pa.Array) -> pa.Array:
        """The range of a row, and -1 minus the range that it follows as well, if it is the first of its own."""
        keys = np.zeros(len(none), _KEY)
        keys["none"], keys["down"], keys["hash"] = none.to_numpy(zero_copy_only=False), down.to_numpy(zero_copy_only=False), digest.to_numpy(zero_copy_only=False)
        own = np.searchsorted(heads, keys, "right") - 1
        head = heads[own] == keys
        at = np.concatenate(([0], np.cumsum(1 + head)))
        out = np.zeros(at[-1], np.int32)
        out[at[:-1]] = own
        out[at[1:][head] - 1] = -1 - (own[head] - 1) % m
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32()))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"

    def run(batches):
        waiting: list[tuple[int | None, str]] = []  # texts without a successor as yet
        size = 0

        def done(rows):  # all but the last
            texts = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:])]  # noqa: B905
            plain, changed = _sets(texts, common, chain), _sets(edited, common, chain)
            arrays = [
                pa.array([i for i, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([fingerprint(x) for x in plain[:-1]]), pa.array([fingerprint(x) for x in changed]), pa.array([likeness(x, y) for x, y in zip(plain, changed)]),  # noqa: B905
                pa.array([likeness(x, y) for x, y in zip(plain, plain[1:])]), pa.array([len(x) for x in plain[:-1]], pa.int64()),  # noqa: B905
            ]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

        closed = False
        for batch in batches:
            for i, t, carried in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("carried").to_pylist(), strict=True):
                if closed:
                    continue  # repeats of the first row of the next range
                waiting.append((i, t or ""))
                size += len(t or "")
                closed = carried
                if len(waiting) > 1 and (size > PIECE or closed):
                    yield done(waiting)
                    waiting, size = waiting[-1:], len(waiting[-1][1])

    rows = keyed.withColumn("place", F.explode(places("none", "down", "hash"))).withColumns({"carried": F.col("place") < 0, "part": F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))})
    rows = rows.repartitionById(m, "part").sortWithinPartitions("carried", "none", "down", "hash").select("doc_id", "text", "carried")
    return rows.mapInArrow(run, schema).withColumn("length_class", length_class(F.col("n_signatures")))


def similar(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", common=COMMON, chain: int = CHAIN) -> DataFrame:
    """Classes of equal signature sets and their similar classes: (a, b, likeness), a < b the smallest ids of two classes."""

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found = signature_sets(part.column("text"), common, chain)
                at = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, U64), *found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "sig"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sets, "id long, sig array<long>")
    rows = rows.filter("id is not null and size(sig) > 0").groupBy("sig").agg(F.min("id").alias("id")).select(F.xxhash64("sig").alias("k"), "id", "sig", F.size("sig").alias("n"))
    seen = rows.select(F.explode("sig").alias("s")).groupBy("s").count()
    ranked = rows.select("k", "n", F.explode("sig").alias("s")).join(seen, "s").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("r"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    keys = ranked.select("k", "n", length_class(F.col("n"), threshold).alias("c"), F.explode(F.slice("r", F.lit(1), prefix.cast("int"))).alias("p")).select("k", "n", "c", F.col("p.s").alias("s"))
    near = keys.withColumn("c", F.explode(F.array("c", F.col("c") + 1)))
    pairs = keys.toDF("kb", "nb", "c", "s").join(near.toDF("ka", "na", "c", "s"), ["c", "s"])
    pairs = pairs.filter((F.col("ka") != F.col("kb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)).select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    both = pairs.join(rows.select("k", "id", "sig").toDF("ka", "ia", "sa"), "ka").join(rows.select("k", "id", "sig").toDF("kb", "ib", "sb"), "kb")
    same = F.size(F.array_intersect("sa", "sb"))
    both = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), (same / (F.size("sa") + F.size("sb") - same)).alias("likeness"))
    return both.filter(F.col("likeness") >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
