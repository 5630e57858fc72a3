"""Same or nearly the same labels across splits.

Labels are compared in lower case with only a-z and 0-9, and equal labels are
one text throughout; copies are expanded only in the result. Two texts match
when at most floor(longer / 10) single-character edits turn one into the other.

Winnowing: fingerprints are rolling hashes of 6-grams, of which each window of
two neighbours keeps its minimum. Minima are taken by (count of the gram,
hash), so a window of a template keeps its rarest gram. The texts of the
evaluation splits, the smaller side, store the minima of all their windows; a
training text that allows k edits asks with the minima of k + 1 disjoint
windows, those of least total count. One of these windows is free of edits and
stands in the partner, at the same relative place and so with the same
minimum: no pair is lost. Counts come from a sketch of fixed size; they steer
the work, not the result.

Seeds of a pair are chained: the cheapest collinear chain pays an edit for
every window it skips and for every shift of its diagonal; a pair whose
cheapest chain costs more than k edits can't match. The rest are extended to
the whole texts by banded alignment, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.pages import page_id, page_kind, split_name
from foliolake.llm.spans import Rolling, codes_of, merge_intervals
from foliolake.operators.current import newest
from foliolake.session import cut

MIN_CHARS = 24
#: A window of two 6-grams has 7 characters. k + 1 disjoint windows fit into every text of 24 characters or more, with
#: one exception: a text of 27 and its partner of 30 allow three edits, and four windows of one gram only have room. So
#: texts of 27 also ask with four grams, and texts of 30 store all of theirs.
GRAM = 6
WINDOW = 7
TIGHT_ASKING, TIGHT_STORED = 27, 30
#: Counters of the sketch: 1 MB whatever the data.
SKETCH = 1 << 18
#: A gram stored more often is spread over several join keys.
HOT = 20_000
#: Longer texts choose their windows in segments of about this many characters.
SEGMENT = 120
#: A text of more crops is spread over several join keys; at most HOT_TEXTS such texts are told apart, their ids (8 bytes each) are broadcast.
HOT_CROPS, HOT_TEXTS = 5_000, 10_000


def normal_label(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def most_edits(n: np.ndarray) -> np.ndarray:
    """Edits that a text of n characters may differ by from any partner, also a longer one."""
    longest = n + n // 9
    longest = longest + (longest + 1 - (longest + 1) // 10 <= n)
    longest = longest - (longest - longest // 10 > n)
    return longest // 10


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of every gram of texts of at least GRAM characters."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    h = Rolling(codes_of(texts)).grams(GRAM)
    counts = sizes - GRAM + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    pos = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return owner, pos, h[starts[owner] + pos]


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def gram_sketch(texts: DataFrame) -> np.ndarray:
    """Counts of all grams of all ``texts``, folded to SKETCH counters."""
    blocks = 16
    size = SKETCH // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            some = batch.column(0).to_pylist()
            if some:
                total += np.bincount(slot(gram_hashes(some)[2]), minlength=SKETCH)
        if total.any():
            parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(blocks, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(blocks), type=pa.int32()), pa.array([p.tobytes() for p in parts], type=pa.binary())], names=["b", "c"]
            )

    def add(key, table):
        total = np.zeros(size, dtype=np.int64)
        for c in table.column("c").to_pylist():
            total += np.frombuffer(c, dtype="<i4")
        whole = np.minimum(total, 2**31 - 1).astype("<i4").tobytes()
        return pa.table({"b": pa.array([key[0].as_py()], type=pa.int32()), "c": pa.array([whole], type=pa.binary())})

    rows = texts.select("text").mapInArrow(count, "b int, c binary").groupBy("b").applyInArrow(add, "b int, c binary").collect()
    sketch = np.zeros(SKETCH, dtype=np.int32)
    for r in rows:
        sketch[r.b * size : (r.b + 1) * size] = np.frombuffer(r.c, dtype="<i4")
    return sketch


def window_minima(texts: list[str], sketch: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text index, start, position of the minimum, its hash, its count) of every
    window of ``width`` neighbouring grams; the leftmost of equal minima counts."""
    owner, pos, h = gram_hashes(texts)
    cost = sketch[slot(h)].astype(np.int64)
    low = np.arange(len(h))
    start = low[: len(h) - width + 1]
    for step in range(1, width):
        other = start + step
        now = low[: len(start)]
        better = (cost[other] < cost[now]) | (cost[other] == cost[now]) & (h[other] < h[now])
        low = np.where(better, other, now)
    start = start[owner[start] == owner[np.minimum(start + width - 1, len(h) - 1)]]
    low = low[start]
    return owner[start], pos[start], pos[low], h[low], cost[low]


def choose_disjoint(cost: np.ndarray, take: int, apart: int) -> np.ndarray:
    """For each row of ``cost`` (texts by window starts): ``take`` starts at least
    ``apart`` apart with the least total, as an array (texts, take)."""
    rows, n = cost.shape
    inf = np.int64(1) << 60
    best = np.zeros((n + 1, rows), dtype=np.int64)
    used = np.zeros((take, n, rows), dtype=bool)
    for j in range(take):
        nxt = np.full((n + 1, rows), inf, dtype=np.int64)
        for p in range(n):
            before = best[max(0, p + 1 - apart)] if j == 0 or p + 1 - apart >= 0 else np.full(rows, inf)
            here = before + cost[:, p]
            better = here < nxt[p]
            used[j, p] = better
            nxt[p + 1] = np.where(better, here, nxt[p])
        best = nxt
    out = np.zeros((rows, take), dtype=np.int64)
    at = np.full(rows, n - 1)
    every = np.arange(rows)
    for j in range(take - 1, -1, -1):
        # The last improvement at or before ``at`` ends the j-th window's choice.
        last = np.where(used[j], np.arange(n)[:, None], -1)
        last = np.maximum.accumulate(last, axis=0)
        out[:, j] = last[at, every]
        at = np.maximum(out[:, j] - apart, 0)
    return out


def asking_windows(texts: list[str], sketch: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text index, number of the window, windows, position, hash) of k + 1 disjoint windows' minima of every text.

    A text's windows are shared out evenly over its segments, each of which has
    room for its part; within a segment the choice is the best there is.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    most = most_edits(sizes) - (sizes == TIGHT_ASKING)
    tight = np.flatnonzero(sizes == TIGHT_ASKING)
    out: list[tuple[np.ndarray, ...]] = []
    for who, take, width in ((np.arange(len(texts)), most + 1, WINDOW - GRAM + 1), (tight, most[tight] + 2, 1)):
        if not len(who):
            continue
        span = GRAM + width - 1
        o, _, pos, h, cost = window_minima([texts[i] for i in who], sketch, width)
        begin = np.concatenate([[0], np.cumsum(sizes[who] - span + 1)])
        pieces = -(-sizes[who] // SEGMENT)
        text = np.repeat(np.arange(len(who)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        k, n, of = take[text], sizes[who][text], pieces[text]
        first, after = k * nth // of, k * (nth + 1) // of
        lo, hi = n * first // k, n * after // k
        shape = (after - first) * (1 << 32) + (hi - lo)
        for s in np.unique(shape):
            here = np.flatnonzero(shape == s)
            many, room = int(s >> 32), int(s & 0xFFFFFFFF) - span + 1
            if not many:
                continue
            base = begin[text[here]] + lo[here]
            picked = choose_disjoint(cost[base[:, None] + np.arange(room)], many, span)
            at = (base[:, None] + picked).ravel()
            number = (first[here][:, None] + np.arange(many)).ravel()
            out.append((np.repeat(who[text[here]], many), number, np.repeat(k[here], many), pos[at], h[at]))
    return tuple(np.concatenate(c) for c in zip(*out))


def stored_minima(texts: list[str], sketch: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text index, position, hash) of the minima of all windows of every text, each once."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = []
    for tight in (False, True):
        who = np.flatnonzero((sizes == TIGHT_STORED) == tight)
        if len(who):
            o, _, pos, h, _ = window_minima([texts[i] for i in who], sketch, 1 if tight else WINDOW - GRAM + 1)
            new = np.ones(len(o), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (pos[1:] != pos[:-1])
            out.append((who[o[new]], pos[new], h[new]))
    return tuple(np.concatenate(c) for c in zip(*out))


def signatures(texts: list[str]) -> np.ndarray:
    """Each bit tells whether one letter or digit stands an odd number of times, so an edit changes two bits at most.
    Modulo 38 the codes of a-z and 0-9 all differ."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bits = np.uint64(1) << (codes_of(texts) % np.uint32(38)).astype(np.uint64)
    return np.bitwise_xor.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]])).view(np.int64)


SEED_SCHEMA = "g long, salt int, id long, win int, wins int, pos int, n int, sig long"


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """(train_id, held_id): pairs of different texts, one with train and one with
    evaluation crops, whose seeds form a chain that the allowed edits can pay for.
    ``texts`` has (id, text, n_train, n_held); texts have MIN_CHARS or more."""
    shared = texts.sparkSession.sparkContext.broadcast(gram_sketch(texts.where("n_held > 0")))

    def columns(batch: pa.RecordBatch):
        some = batch.column(1).to_pylist()
        return some, batch.column(0).to_numpy(zero_copy_only=False), np.fromiter(map(len, some), dtype=np.int64, count=len(some)), signatures(some)

    def ways(h: np.ndarray) -> np.ndarray:
        return shared.value[slot(h)].astype(np.int64) // HOT + 1

    def emit(h, salt, ids, win, wins, pos, n, sig) -> pa.RecordBatch:
        small = [pa.array(c.astype(np.int32)) for c in (salt, win, wins, pos, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), small[0], pa.array(ids), *small[1:], pa.array(sig)], names=["g", "salt", "id", "win", "wins", "pos", "n", "sig"]
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                some, ids, sizes, sig = columns(batch)
                o, win, wins, pos, h = asking_windows(some, shared.value)
                w = ways(h)
                every = np.repeat(np.arange(len(h)), w)
                salt = np.arange(len(every)) - np.repeat(np.cumsum(w) - w, w)
                o = o[every]
                yield emit(h[every], salt, ids[o], win[every], wins[every], pos[every], sizes[o], sig[o])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                some, ids, sizes, sig = columns(batch)
                o, pos, h = stored_minima(some, shared.value)
                yield emit(h, (ids[o] & 0x7FFFFFFF) % ways(h), ids[o], pos, pos, pos, sizes[o], sig[o])

    asking = texts.where("n_train > 0").select("id", "text").mapInArrow(ask, SEED_SCHEMA)
    stored = texts.where("n_held > 0").select("id", "text").mapInArrow(store, SEED_SCHEMA).drop("win", "wins")
    a = [F.col(c).alias(f"a_{c}") if c not in ("g", "salt") else F.col(c) for c in asking.columns]
    b = [F.col(c).alias(f"b_{c}") if c not in ("g", "salt") else F.col(c) for c in stored.columns]
    k = F.floor(F.greatest("a_n", "b_n") / 10).cast("int")
    shift = F.col("a_pos") - F.col("b_pos")
    fits = F.abs(shift) + F.abs(F.col("a_n") - F.col("b_n") - shift) <= k
    like = F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig"))) <= 2 * k
    partner = (F.col("a_n") != TIGHT_ASKING) | ((F.col("b_n") == TIGHT_STORED) == (F.col("a_wins") == TIGHT_STORED // 10 + 1))
    # Both sides grow with the data, whatever the planner thinks of their size: never broadcast.
    met = asking.select(*a).hint("merge").join(stored.select(*b), ["g", "salt"]).where(fits & like & partner & (F.col("a_id") != F.col("b_id")))
    seeds = F.array_sort(F.collect_list(F.struct(F.col("a_win").alias("win"), F.col("b_pos").alias("at"), shift.alias("shift"))))
    pairs = met.groupBy(F.col("a_id").alias("train_id"), F.col("b_id").alias("held_id")).agg(
        F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.first("a_wins").alias("wins"), seeds.alias("seeds")
    )
    return pairs.where(chain_cost(F.col("seeds"), F.col("wins"), F.col("a_n") - F.col("b_n")) <= k).select("train_id", "held_id")


def chain_cost(seeds: Column, windows: Column, longer: Column) -> Column:
    """The least number of edits that any collinear chain of ``seeds`` (win, at,
    shift; sorted) leaves to pay: between two of its seeds, and before the first
    and after the last, at least one for each window left out and at least one
    for each place that the diagonal moves. ``windows`` were asked with;
    ``longer`` is by how much the asking text exceeds the other."""
    gap = lambda skipped, moved: F.greatest(skipped, F.abs(moved))
    links = F.aggregate(
        seeds,
        F.expr("cast(array() as array<struct<win:int,at:int,shift:int,cost:int>>)"),
        lambda done, s: F.concat(
            done,
            F.array(
                F.struct(
                    s["win"].alias("win"),
                    s["at"].alias("at"),
                    s["shift"].alias("shift"),
                    F.aggregate(
                        done,
                        gap(s["win"], s["shift"]),
                        lambda least, p: F.least(
                            least,
                            F.when((p["win"] < s["win"]) & (p["at"] < s["at"]), p["cost"] + gap(s["win"] - p["win"] - 1, s["shift"] - p["shift"])).otherwise(least),
                        ),
                    ).alias("cost"),
                )
            ),
        ),
    )
    return F.aggregate(
        links, F.lit(2**30), lambda least, p: F.least(least, p["cost"] + gap(windows - 1 - p["win"], longer - p["shift"]))
    )


def labelled(crops: DataFrame) -> DataFrame:
    """(crop_id, doc, split, text, id) of the current crops with a readable split
    and a long enough label; id is a 64-bit hash of the text."""
    rows = crops.select(
        "crop_id", page_id(F.col("doc")).alias("doc"), split_name(F.col("split")).alias("split"),
        normal_label(F.col("labels")).alias("text"), "loaded_at",
    )
    once = newest(rows.where("crop_id is not null"), [F.col("crop_id")], [F.col("loaded_at").desc_nulls_last(), F.col("text"), F.col("split")])
    return once.where(F.col("split").isNotNull() & (F.length("text") >= MIN_CHARS)).drop("loaded_at").withColumn("id", F.xxhash64("text"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(id, text, n_train, n_held, first_crop) of each distinct text of ``rows``."""
    train = F.sum((F.col("split") == "train").cast("long")).alias("n_train")
    held = F.sum((F.col("split") != "train").cast("long")).alias("n_held")
    return rows.groupBy("id", "text").agg(train, held, F.min("crop_id").alias("first_crop"))


def matching_texts(texts: DataFrame) -> DataFrame:
    """(train_id, held_id, train_text, held_text, edits): matching texts, the one
    with train crops first; a text found on both sides also matches itself."""
    slim = texts.select("id", "text")
    one = slim.select(F.col("id").alias("train_id"), F.col("text").alias("train_text"))
    two = slim.select(F.col("id").alias("held_id"), F.col("text").alias("held_text"))
    checked = candidate_pairs(texts).hint("merge").join(one, "train_id").hint("merge").join(two, "held_id")
    longer = "cast(floor(greatest(length(train_text), length(held_text)) / 10) as int)"
    near = checked.withColumn("edits", F.expr(f"levenshtein(train_text, held_text, {longer})")).where("edits >= 0")
    same = texts.where("n_train > 0 and n_held > 0")
    same = same.select(F.col("id").alias("train_id"), F.col("id").alias("held_id"), F.col("text").alias("train_text"), F.col("text").alias("held_text"), F.lit(0).alias("edits"))
    return near.select("train_id", "held_id", "train_text", "held_text", "edits").unionByName(same)


def hot_texts(texts: DataFrame) -> DataFrame:
    """(id, ways) of the texts of very many crops, HOT_TEXTS at most, to be broadcast."""
    total = texts.agg(F.sum(F.col("n_train") + F.col("n_held"))).first()[0] or 0
    limit = max(HOT_CROPS, -(-total // HOT_TEXTS))
    n = F.col("n_train") + F.col("n_held")
    return F.broadcast(texts.where(n >= limit).select("id", F.ceil(n / HOT_CROPS).cast("int").alias("ways")))


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` of crops with ``salt``: copies of a hot text lie under several keys."""
    return rows.join(hot, "id", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("crop_id"), F.col("ways")), F.lit(0))).drop("ways")


def _for_all_salts(matches: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``matches`` once for each key under which crops of the text ``key`` lie."""
    known = matches.join(hot.withColumnRenamed("id", key), key, "left")
    return known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("ways", F.lit(1)).cast("long") - 1))).drop("ways")


def overlaps(crops: DataFrame) -> DataFrame:
    """(crop_a, crop_b, split, doc_a, doc_b, edits), crop_a < crop_b: one crop in
    train, the other in ``split`` (val or test).

    Null ids, null labels, labels under 24 letters and digits, and rows without a split
    match nothing; crops delivered twice count once, by their newest row. Every pair of
    copies is a row; ``overlap_classes`` has the same content in linear size.
    """
    rows = cut(labelled(crops))
    texts = cut(distinct_texts(rows))
    matches = cut(matching_texts(texts).select("train_id", "held_id", "edits"))
    hot = hot_texts(texts)
    slim = _salted(rows.select("id", "crop_id", "doc", "split"), hot)
    train = slim.where("split = 'train'").select(F.col("id").alias("train_id"), "salt", F.col("crop_id").alias("t"), F.col("doc").alias("t_doc"))
    held = slim.where("split <> 'train'").select(F.col("id").alias("held_id"), "salt", F.col("crop_id").alias("h"), F.col("doc").alias("h_doc"), "split")
    met = _for_all_salts(matches, "train_id", hot).hint("merge").join(train, ["train_id", "salt"]).drop("salt")
    met = _for_all_salts(met, "held_id", hot).hint("merge").join(held, ["held_id", "salt"])
    first = F.col("t") < F.col("h")
    return met.select(
        F.least("t", "h").alias("crop_a"), F.greatest("t", "h").alias("crop_b"), "split",
        F.when(first, F.col("t_doc")).otherwise(F.col("h_doc")).alias("doc_a"),
        F.when(first, F.col("h_doc")).otherwise(F.col("t_doc")).alias("doc_b"), "edits", F.col("h").alias("held_crop"),
        F.col("h_doc").alias("held_doc"),
    )


def overlap_classes(crops: DataFrame) -> DataFrame:
    """(crop_id, split, class_id, n_links): every crop with a readable split and a
    long enough label. class_id is the least crop id with the same normal label;
    n_links counts the crops of the other side (train or evaluation) that match it.
    """
    rows = cut(labelled(crops))
    texts = cut(distinct_texts(rows))
    matches = cut(matching_texts(texts).select("train_id", "held_id"))
    sizes = texts.select("id", "n_train", "n_held")
    of = matches.hint("merge").join(sizes.withColumnRenamed("id", "train_id").drop("n_held"), "train_id")
    of = of.hint("merge").join(sizes.withColumnRenamed("id", "held_id").drop("n_train"), "held_id")
    to_train = of.groupBy(F.col("held_id").alias("id")).agg(F.sum("n_train").alias("to_train"))
    to_held = of.groupBy(F.col("train_id").alias("id")).agg(F.sum("n_held").alias("to_held"))
    known = texts.select("id", "first_crop").hint("merge").join(to_train, "id", "left").hint("merge").join(to_held, "id", "left")
    hot = hot_texts(texts)
    links = F.when(F.col("split") == "train", F.col("to_held")).otherwise(F.col("to_train"))
    met = _salted(rows.select("id", "crop_id", "split"), hot).hint("merge").join(_for_all_salts(known, "id", hot), ["id", "salt"])
    return met.select("crop_id", "split", F.col("first_crop").alias("class_id"), F.coalesce(links, F.lit(0)).alias("n_links"))


def overlap_links(crops: DataFrame) -> DataFrame:
    """(train_class, held_class, edits): matching labels, each under the class_id of ``overlap_classes``."""
    texts = cut(distinct_texts(labelled(crops)))
    matches = matching_texts(texts).select("train_id", "held_id", "edits")
    ids = texts.select("id", "first_crop")
    met = matches.hint("merge").join(ids.select(F.col("id").alias("train_id"), F.col("first_crop").alias("train_class")), "train_id")
    met = met.hint("merge").join(ids.select(F.col("id").alias("held_id"), F.col("first_crop").alias("held_class")), "held_id")
    return met.select("train_class", "held_class", "edits")


def _held_counts(rows: DataFrame, texts: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, pairs): train crops in texts that match the held text."""
    sizes = texts.select(F.col("id").alias("train_id"), "n_train")
    return matches.hint("merge").join(sizes, "train_id").groupBy(F.col("held_id").alias("id")).agg(F.sum("n_train").alias("pairs"))


def overlap_report(crops: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_crops, leaked_crops, leaked_part): per evaluation split and page kind.

    Counted per text before crops are met, so copies are never expanded:
    each held crop has as many pairs as its text has train crops in matching texts.
    """
    rows = cut(labelled(crops))
    texts = cut(distinct_texts(rows))
    per_text = _held_counts(rows, texts, matching_texts(texts).select("train_id", "held_id"))
    source = F.coalesce(page_kind(F.col("doc")), F.lit(""))
    held = rows.where("split <> 'train'").groupBy("id", "split", source.alias("source")).agg(F.count("*").alias("crops"))
    joined = held.hint("merge").join(per_text, "id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return (
        joined.groupBy("split", "source")
        .agg(
            F.sum(F.col("pairs") * F.col("crops")).alias("n_pairs"),
            F.sum("crops").alias("n_crops"),
            F.sum(F.when(F.col("pairs") > 0, F.col("crops")).otherwise(0)).alias("leaked_crops"),
        )
        .withColumn("leaked_part", F.col("leaked_crops") / F.col("n_crops"))
    )


def kept_stretches(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Stretches of ``b`` that an alignment with ``a`` of least edits, at most ``k``, leaves as they are."""
    n, m, inf = len(a), len(b), 1 << 30
    rows = []
    before = {j: j for j in range(min(k, m) + 1)}
    rows.append(before)
    for i in range(1, n + 1):
        now = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            if not j:
                now[j] = i
                continue
            now[j] = min(before.get(j - 1, inf) + (a[i - 1] != b[j - 1]), before.get(j, inf) + 1, now.get(j - 1, inf) + 1)
        rows.append(now)
        before = now
    i, j, out = n, m, []
    while i and j:
        here = rows[i][j]
        if a[i - 1] == b[j - 1] and rows[i - 1].get(j - 1, inf) == here:
            if out and out[-1][0] == j:
                out[-1] = (j - 1, out[-1][1])
            else:
                out.append((j - 1, j))
            i, j = i - 1, j - 1
        elif rows[i - 1].get(j - 1, inf) + 1 == here:
            i, j = i - 1, j - 1
        elif rows[i - 1].get(j, inf) + 1 == here:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def record_coverage(crops: DataFrame) -> DataFrame:
    """(crop_id, split, source, n_pairs, covered_chars, coverage) of every held crop with a label long enough.

    covered_chars counts the characters of the normal label that at least one
    matching train label's alignment leaves as they are; coverage is their
    share of the label. Both are 0 without a match.
    """
    rows = cut(labelled(crops))
    texts = cut(distinct_texts(rows))
    matches = cut(matching_texts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, s, e = [], [], []
            for i, a, b, k in zip(*(c.to_pylist() for c in batch.columns)):
                for x, y in [(0, len(b))] if a == b else kept_stretches(a, b, k):
                    ids.append(i)
                    s.append(x)
                    e.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(s, type=pa.int32()), pa.array(e, type=pa.int32())], names=["doc_id", "s", "e"])

    parts = matches.select("held_id", "train_text", "held_text", "edits").mapInArrow(run, "doc_id long, s int, e int")
    kept = merge_intervals(parts.distinct()).groupBy(F.col("doc_id").alias("id")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("covered"))
    per_text = texts.where("n_held > 0").select("id", F.length("text").alias("n")).hint("merge").join(_held_counts(rows, texts, matches), "id", "left")
    per_text = per_text.hint("merge").join(kept, "id", "left").na.fill(0, ["pairs", "covered"])
    hot = hot_texts(texts)
    held = _salted(rows.where("split <> 'train'").select("id", "crop_id", "doc", "split"), hot)
    met = held.hint("merge").join(_for_all_salts(per_text, "id", hot), ["id", "salt"])
    source = F.coalesce(page_kind(F.col("doc")), F.lit(""))
    return met.select(
        "crop_id", "split", source.alias("source"), F.col("pairs").alias("n_pairs"), F.col("covered").alias("covered_chars"), (F.col("covered") / F.col("n")).alias("coverage")
    )
