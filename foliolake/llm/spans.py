"""Long exact spans shared between texts.

A run of at least ``length`` characters that two texts share contains whole
windows of that length, and equal windows have equal minimisers (the least
hash among the k-grams inside). So:

1. each text is scanned once; neighbouring windows with one minimiser form a
   stretch, described by (minimiser, digest of the stretch, position);
2. a minimiser seen in one text only rules its stretches out; of the others, a
   stretch whose digest occurs in two texts is shared as a whole;
3. what remains are stretches at the rims of shared passages: only for these,
   and for one representative of each whole-shared stretch beside them, every
   window's hash is taken and windows found in two texts are shared.

Each step is a grouped minimum and maximum of doc_id, combined before the
shuffle, so a passage held by a third of all texts costs no more than any
other, and no pairs are ever formed. Hashes are 64-bit polynomial values;
apart from their collisions (about n**2 / 2**65) the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.session import cut, spread

LENGTH = 200
GRAM = 100
#: Characters hashed together; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20

# Any odd 64-bit base works; it and the mixers below need no particular value.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_CHARS + 4096)
        p = np.full(size, np.uint64(base), dtype=np.uint64)
        p[0] = 1
        _powers[name] = have = np.multiply.accumulate(p, dtype=np.uint64)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of any substring of one array of code points."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        letters = _mix(codes.astype(np.uint64) + np.uint64(1))
        np.cumsum(letters * _power(_BASE, n, "base"), out=self.sums[1:], dtype=np.uint64)
        self.back = _power(_INVERSE, n + 1, "inverse")

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (block-wise running minima from both sides)."""
    n = len(h)
    pad = -n % w
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def codes_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def stretches(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, lo, hi, minimiser, digest): starts lo..hi of windows with one minimiser."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    roll = Rolling(codes_of(texts))
    n = int(starts[-1])
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    low = sliding_min(roll.grams(gram), length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= starts[owner + 1]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(low)]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    who = owner[first]
    return who, first - starts[who], last - starts[who], low[first], roll.at(first, last + length)


def _chunks(ids: list, texts: list, least: int) -> Iterator[tuple[list, list]]:
    held_i: list = []
    held_t: list = []
    total = 0
    for i, t in zip(ids, texts):
        if t is None or len(t) < least:
            continue
        if held_t and total + len(t) > CHUNK_CHARS:
            yield held_i, held_t
            held_i, held_t, total = [], [], 0
        held_i.append(i)
        held_t.append(t)
        total += len(t)
    if held_t:
        yield held_i, held_t


def scan(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, brief: bool = False) -> DataFrame:
    """(m, d, doc_id, lo, hi): the stretches of every text; texts under ``length`` have none.

    The digest d is cut to 32 bits: it only counts together with m. ``brief``
    leaves just (m, doc_id).
    """
    schema = "m long, doc_id long" if brief else "m long, d int, doc_id long, lo int, hi int"
    wanted = [0, 2] if brief else [0, 1, 2, 3, 4]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some_ids, some in _chunks(ids, texts, length):
                who, lo, hi, low, digest = stretches(some, length, gram)
                columns = [
                    low.view(np.int64),
                    (digest >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    np.asarray(some_ids, dtype=np.int64)[who],
                    lo.astype(np.int32),
                    hi.astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(columns[i]) for i in wanted], names=names)

    slim = documents.select("doc_id", "text").where((F.length("text") >= length) & F.col("doc_id").isNotNull())
    return spread(slim).mapInArrow(run, schema)


def window_hashes(documents: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, start) of every window of the asked (doc_id, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                lo = np.array([r["lo"] for r in ranges], dtype=np.int64)
                count = np.array([r["hi"] for r in ranges], dtype=np.int64) - lo + 1
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                h = Rolling(codes_of([text])).at(at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(len(at), doc, dtype=np.int64)), pa.array(at.astype(np.int32))],
                    names=["h", "doc_id", "start"],
                )

    per_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = documents.select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "h long, doc_id long, start int")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Union of (doc_id, s, e) per document; overlapping or touching ones become one."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("n", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    island = marked.withColumn("i", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "i").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("i")


def shared_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal stretches of a text in which
    every character lies in a run of at least ``length`` characters that also
    occurs in the text of another doc_id.

    Offsets count characters from 0, span_end is exclusive. Null, empty and
    short texts have no spans, nor do texts without an id share any; repeats inside one text don't count; equal
    texts under different ids are shared throughout.
    """
    spread = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most")]
    # Texts are scanned twice, so that only the stretches of shared minimisers are ever kept.
    shared = scan(documents, length, gram, brief=True).groupBy("m").agg(*spread).where("least <> most").select("m")
    hits = cut(scan(documents, length, gram).join(shared, "m"))
    by_stretch = hits.groupBy("m", "d").agg(*spread)
    wide = F.col("least") != F.col("most")
    # Per minimiser: are all its stretches shared whole?
    all_whole = by_stretch.groupBy("m").agg(F.min(wide).alias("all_whole"))
    tagged = by_stretch.join(all_whole, "m").select("m", "d", "all_whole", wide.alias("whole_shared"), "least", "most")
    placed = hits.join(tagged, ["m", "d"])
    whole = placed.where("whole_shared").select("doc_id", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    rims = placed.where("not all_whole and (not whole_shared or doc_id = least or doc_id = most)")
    hashes = window_hashes(documents, rims.select("doc_id", "lo", "hi"), length)
    twice = hashes.groupBy("h").agg(*spread).where("least <> most").select("h")
    part = hashes.join(twice, "h").select("doc_id", F.col("start").alias("s"), (F.col("start") + length).alias("e"))
    return merge_intervals(whole.unionByName(part)).select(
        "doc_id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end")
    )


def shared_report(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_part) for every text; null texts have 0 characters."""
    per = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    both = sizes.join(per, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
    return both.withColumn("shared_part", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
