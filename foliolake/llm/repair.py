"""Repairing text recognised from scanned pages.

Layout (``layout.py``): a line is page furniture when it is nothing but a page
number, or when it is a running header or footer. Headers stand at page edges or
come again on other pages of the reading; where the page's own text is known
(its own ``expected_text`` or that of another reading of the same page) they
don't belong to it, elsewhere they show a frame (first or last two words) that
headers of other pages have. The remaining lines are the page's text.

Correction: words outside the vocabulary get all candidates within one or two
edits by walking a Levenshtein automaton and the vocabulary trie together
(``tries.py``), in shards of bounded size; neighbouring words, likely
confusions and frequency rank them. Where the page's text is known it is the
vocabulary and the context: the candidate due in a word's place tells whether
the word is misread or cut. Elsewhere the vocabulary has every alphabetic word
of the expected texts, however rare. Frames and vocabulary stay on the
executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.layout import CUT_MARKS, PAGE_NUMBER, frames_of, read_page, reference_of, reflow, words_of
from foliolake.llm.tries import build_trie, within
from foliolake.operators.current import newest
from foliolake.session import cut, parallelism

#: Headers with one frame must stand on this many pages (``doc``) for lines of other pages to count as headers by it.
LEAST_PAGES = 3
#: One frame or word may stand on very many readings; its rows are spread over so many join keys.
SALTS = 16
#: Words per trie.
TRIE_WORDS = 50_000
#: A token stays as it was read when no candidate scores this much: below, more of the words of held-out pages were spoilt than restored.
LEAST_SCORE = -2.0
#: Shapes that recognition confuses, written as pairs (seen, meant).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("7", "t"),
    ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("r", "n"),
    ("n", "r"), ("1", "t"), ("f", "e"), ("l", "1"), ("o", "0"), ("s", "5"), ("b", "8"), ("z", "2"), ("q", "g"),
)


def readings(engine: DataFrame) -> DataFrame:
    """(record_id, doc, ocr_text, expected_text, reference): readings with text, once each.

    ``reference`` is the reading's own expected text or else that of any
    other reading of the same page.
    """
    slim = engine.select("record_id", "doc", "ocr_text", "expected_text", "loaded_at")
    once = newest(slim, [F.col("record_id")], [F.col("loaded_at").desc_nulls_last(), F.col("ocr_text")])
    known = engine.where("expected_text is not null and doc is not null").groupBy("doc").agg(F.max("expected_text").alias("other"))
    # Merged, so that the readings of a page lie together; the texts are never broadcast.
    joined = once.where("ocr_text is not null").hint("merge").join(known, "doc", "left")
    return joined.select("record_id", "doc", "ocr_text", "expected_text", F.coalesce("expected_text", "other").alias("reference"))


def word_counts(engine: DataFrame) -> DataFrame:
    """(word, n): in how many pages' expected texts each alphabetic word stands."""
    texts = engine.where("expected_text is not null").groupBy("doc").agg(F.max("expected_text").alias("t"))
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"))).alias("word"))
    return words.where(F.col("word").rlike(r"^\p{L}{2,}$")).groupBy("word").agg(F.count("*").alias("n"))


FIRST = "record_id long, doc string, done boolean, rows array<struct<line_no:int,kind:string>>, heads array<string>, open array<string>"


def first_reading(pages: DataFrame) -> DataFrame:
    """(record_id, doc, done, rows, heads, open): what each page tells by itself.

    ``rows`` has the lines found; ``heads`` the frames of its headers; ``open``
    those of lines that would be headers if one of their frames were known. A
    page with its text and without open lines is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, rows, heads, still = [], [], [], []
            for text, expected, ref in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                page = read_page(text, reference_of(ref) if ref else None, frozenset(), frozenset())
                lines = page["lines"]
                heads.append(sorted({f for x, k in zip(lines, page["kinds"]) if k == "header" for f in frames_of(x)}))
                still.append(sorted({f for i in page["open"] for f in frames_of(lines[i])}))
                done.append(bool(ref) and not still[-1])
                rows.append(found_lines(page, expected is not None) if done[-1] else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(done, type=pa.bool_()), line_array(rows), pa.array(heads, type=pa.list_(pa.string())), pa.array(still, type=pa.list_(pa.string()))],
                names=["record_id", "doc", "done", "rows", "heads", "open"],
            )

    return pages.select("record_id", "doc", "ocr_text", "expected_text", "reference").mapInArrow(run, FIRST)


def found_lines(page: dict, compared: bool) -> list[tuple[int, str]]:
    found = [(i, k) for i, k in enumerate(page["kinds"]) if k in ("header", "page_no")]
    found += [(i, "break") for i in sorted(page["breaks"])]
    return found + [(i, "misread") for i in sorted(page["wrong"])] if compared else found


def line_array(rows: list[list[tuple[int, str]]]) -> pa.Array:
    kind = pa.struct([("line_no", pa.int32()), ("kind", pa.string())])
    return pa.array([[{"line_no": i, "kind": k} for i, k in r] for r in rows], type=pa.list_(kind))


def header_frames(first: DataFrame) -> DataFrame:
    """(frame): frames of headers on LEAST_PAGES pages or more."""
    seen = first.select("doc", F.explode("heads").alias("frame")).where("doc is not null").distinct()
    return seen.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).select("frame")


def met(rows: DataFrame, asked: str, answers: DataFrame, answer: str) -> DataFrame:
    """(of, found): per record id, which of the ``asked`` strings are among the ``answers``.

    ``rows`` has (record_id, asked array). Answers are repeated for every salt, so a string asked by a
    third of all records is met in SALTS places.
    """
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    left = rows.select("record_id", salt.alias("salt"), F.explode(asked).alias(answer))
    right = answers.select(answer, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = left.hint("merge").join(right, [answer, "salt"], "left_semi")
    return kept.groupBy(F.col("record_id").alias("of")).agg(F.collect_list(answer).alias("found"))


def answered(pages: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``pages`` with the strings of ``found`` as array ``name``."""
    own = found.withColumnRenamed("found", name)
    return pages.hint("merge").join(own, F.col("record_id").eqNullSafe(F.col("of")), "left").drop("of")


def line_frames(pages: DataFrame) -> DataFrame:
    """(record_id, asked): the frames of all lines of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [sorted({f for x in text.split("\n") if not PAGE_NUMBER.fullmatch(x) for f in frames_of(x)}) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(asked, type=pa.list_(pa.string()))], names=["record_id", "asked"])

    return pages.select("record_id", "ocr_text").mapInArrow(run, "record_id long, asked array<string>")


def asked_words(lines: list[list[str]], longest: int) -> set[str]:
    """The words of up to ``longest`` characters whose standing in the vocabulary
    ``read_page`` without a reference, ``reflow`` or ``_suspicious`` may ask for.

    ``lines`` are the blank-separated tokens of the page's own lines. Cut words
    are rejoined over any number of lines of one token, so every such run counts.
    """
    asked: set[str] = set()
    for n, parts in enumerate(lines):
        for t in parts:
            w = words_of(t)
            asked.update(w)
            asked.add("".join(w))
        tail = parts[0]
        first = words_of(tail)[:1]
        for k in range(n - 1, -1, -1):
            last = lines[k][-1]
            if k == n - 1 and first:
                asked.update((last.lower(), first[0], last.lower() + first[0]))
            tail = last.rstrip(CUT_MARKS) + tail
            w = words_of(tail)
            asked.update(w)
            asked.add("".join(w))
            if len(lines[k]) > 1 or sum(map(len, w)) > longest:
                break
    return {w for w in asked if 0 < len(w) <= longest}


def with_known(pages: DataFrame, words: DataFrame) -> DataFrame:
    """``pages`` (record_id, ocr_text, frames) with ``known``: the words of each page that the vocabulary ``words`` has."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = []
            for text, frames in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = read_page(text, None, frozenset(frames or ()), frozenset())
                asked.append(sorted(asked_words([page["lines"][i].split() for i in page["own"]], longest)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(asked, type=pa.list_(pa.string()))], names=["record_id", "asked"])

    asked = pages.select("record_id", "ocr_text", "frames").mapInArrow(run, "record_id long, asked array<string>")
    return answered(pages, met(asked, "asked", words.select("word"), "word"), "known")


def page_lines(engine: DataFrame) -> DataFrame:
    """(record_id, line_no, kind): furniture, cut words and misread lines of every reading.

    kind is header, page_no, break or misread, one row each. line_no counts
    the lines of ``ocr_text`` cut at line feeds from 0. Readings without text
    have no rows; ``misread`` is only told where the reading's own
    expected_text is given; record ids delivered twice count once. Pages that
    tell all by themselves are read once, the others again with the frames (and,
    without any text of the page, the words) that other pages know.
    """
    pages = cut(readings(engine))
    first = cut(first_reading(pages))
    waiting = first.where("not done")
    still = pages.hint("merge").join(waiting.select(F.col("record_id").alias("w")), F.col("record_id").eqNullSafe(F.col("w")), "left_semi")
    framed = answered(still, met(waiting.select("record_id", "open"), "open", header_frames(first), "frame"), "frames")
    framed = cut(framed)
    unread = with_known(framed.where("reference is null or reference = ''"), cut(word_counts(engine)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, expected, ref, frames, known in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                page = read_page(text, reference_of(ref) if ref else None, frozenset(frames or ()), frozenset(known or ()))
                rows.append(found_lines(page, expected is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), line_array(rows)], names=["record_id", "rows"])

    told = framed.where("reference <> ''").withColumn("known", F.lit(None).cast("array<string>")).unionByName(unread)
    told = told.select("record_id", "ocr_text", "expected_text", "reference", "frames", "known").mapInArrow(run, "record_id long, rows array<struct<line_no:int,kind:string>>")
    return first.where("done").select("record_id", "rows").unionByName(told).select("record_id", F.inline("rows"))


def _confusion_cost(seen: str, meant: str) -> float:
    """Edits between two words, likely confusions of equal-length words at half price."""
    if len(seen) == len(meant):
        return sum(0.5 if (a, b) in CONFUSIONS else 1.0 for a, b in zip(seen, meant) if a != b)
    return 1.0


def candidates(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, candidate, cost) of distinct ``token`` against every ``word`` of ``words``.

    Complete within one edit, two from six characters on; the token itself
    is never among its candidates. The words are dealt into shards by hash, the
    tokens into slices; a task gets one shard, builds its trie and walks one
    slice's tokens against it as they come.
    """
    # Little data but much work per row: as many tasks as cores, whatever the size.
    tasks = parallelism(tokens.sparkSession)
    shards = max(1, -(-words.count() // TRIE_WORDS))
    slices = max(1, -(-tasks // shards))
    dealt = lambda df, own, n, other, m, step: df.select(
        F.pmod(F.xxhash64("text"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(step).alias("step"), "text"
    ).select((F.col("shard") * slices + F.col("slice")).alias("part"), "step", "text")
    both = dealt(words.select(F.col("word").alias("text")), "shard", shards, "slice", slices, 0).unionByName(
        dealt(tokens.select(F.col("token").alias("text")).distinct(), "slice", slices, "shard", shards, 1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, trie = None, [], None
        for batch in batches:
            rows = []
            for p, step, t in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, own, trie = p, [], None
                if step == 0:
                    own.append(t)
                    continue
                if trie is None:
                    trie = build_trie(own)
                for w, d in within(trie, t, 1 if len(t) < 6 else 2):
                    if w != t:
                        rows.append((t, w, min(float(d), _confusion_cost(t, w)) if len(t) == len(w) else float(d)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.string()), pa.array(cols[2], type=pa.float64())],
                names=["token", "candidate", "cost"],
            )

    placed = both.repartitionById(shards * slices, "part").sortWithinPartitions("part", "step")
    return placed.mapInArrow(run, "token string, candidate string, cost double")


def _suspicious(token: str, words) -> str:
    """The lower-case core of a token that should be a word but is none; else ''."""
    core = "".join(words_of(token))
    letters = sum(c.isalpha() for c in core)
    if len(core) < 3 or core in words or letters < 2 or len(words_of(token)) != 1:
        return ""
    if any(c.isdigit() for c in core) and (letters < 0.6 * len(core) or len(core) > 12 or token[:1].isdigit() and token[-1:].isdigit()):
        return ""
    return core


def repaired_texts(engine: DataFrame, known_texts: DataFrame | None = None) -> DataFrame:
    """(record_id, doc, repaired_text): continuous text of every reading, without page furniture.

    No reading is compared with its own text: frames, words and word pairs come from
    the expected texts of ``known_texts`` (by default of ``engine``) as a
    whole. To measure the repair, leave the measured pages out of it. Readings
    without text give null.
    """
    pages = cut(readings(engine))
    source = pages if known_texts is None else readings(known_texts)
    frames = header_frames(first_reading(source.where("reference <> ''")))
    framed = answered(pages.select("record_id", "ocr_text"), met(line_frames(pages), "asked", frames, "frame"), "frames")
    words = cut(word_counts(engine if known_texts is None else known_texts))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_tokens, cores = [], []
            for text, frames, known in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                vocabulary = frozenset(known or ())
                flow = reflow(read_page(text, None, frozenset(frames or ()), vocabulary), vocabulary)
                all_tokens.append(flow)
                cores.append([_suspicious(t, vocabulary) for t in flow])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(all_tokens, type=pa.list_(pa.string())), pa.array(cores, type=pa.list_(pa.string()))],
                names=["record_id", "tokens", "cores"],
            )

    read = with_known(cut(framed), words).select("record_id", "ocr_text", "frames", "known")
    flows = cut(read.mapInArrow(tokens, "record_id long, tokens array<string>, cores array<string>"))
    plain = F.transform("tokens", lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", ""))
    at = (
        flows.select("record_id", plain.alias("w"), F.posexplode("cores").alias("i", "token"))
        .where("token <> ''")
        .select("record_id", "i", "token", F.get("w", F.col("i") - 1).alias("before"), F.get("w", F.col("i") + 1).alias("after"))
    )
    options = candidates(at, words)
    texts = (engine if known_texts is None else known_texts).where("expected_text is not null").groupBy("doc").agg(F.max("expected_text").alias("t"))
    seq = texts.select(F.transform(F.split("t", r"\s+"), lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")).alias("w"))
    grams = seq.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))).alias("g"))
    pairs = grams.select("g.*").where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    counts = words.withColumnRenamed("word", "candidate").withColumnRenamed("n", "freq")
    ranked = (
        at.join(options, "token")
        .join(counts, "candidate", "left")
        .join(pairs.select(F.col("a").alias("before"), F.col("b").alias("candidate"), F.col("n").alias("left_n")), ["before", "candidate"], "left")
        .join(pairs.select(F.col("a").alias("candidate"), F.col("b").alias("after"), F.col("n").alias("right_n")), ["candidate", "after"], "left")
    )
    score = (
        F.log(1.0 + F.coalesce("freq", F.lit(0)))
        + 2 * F.log(1.0 + F.coalesce("left_n", F.lit(0)))
        + 2 * F.log(1.0 + F.coalesce("right_n", F.lit(0)))
        - 4 * F.col("cost")
    )
    w = Window.partitionBy("record_id", "i").orderBy(F.desc("score"), "candidate")
    best = ranked.withColumn("score", score).where(F.col("score") >= LEAST_SCORE).withColumn("r", F.row_number().over(w)).where("r = 1")
    fixes = best.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "candidate"))).alias("fix"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens, fix in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for i, word in fix or ():
                    t = tokens[i]
                    lead = re.match(r"[\W_]*", t).group()
                    tail = re.search(r"[\W_]*$", t).group()
                    body = t[len(lead) : len(t) - len(tail)]
                    letters = [c for c in body if c.isalpha()]
                    shaped = word.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else word.capitalize() if body[:1].isupper() else word
                    tokens[i] = lead + shaped + tail
                out.append(" ".join(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["record_id", "repaired_text"])

    text = flows.select("record_id", "tokens").hint("merge").join(fixes, "record_id", "left").select("record_id", "tokens", "fix").mapInArrow(rebuild, "record_id long, repaired_text string")
    return newest(engine.select("record_id", "doc", "loaded_at"), [F.col("record_id")], [F.col("loaded_at").desc_nulls_last(), F.col("doc")]).select("record_id", "doc").hint("merge").join(text, "record_id", "left")
