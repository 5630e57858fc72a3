"""The vocabulary of page repair has every word, and asks for all it needs."""

import random
from datetime import datetime

from foliolake.llm import layout, repair

T0 = datetime(2025, 1, 1)
ENGINE = "record_id long, doc string, profile string, expected_text string, ocr_text string, loaded_at timestamp_ntz"


def test_rare_words_stay_and_are_restored(spark):
    often = "The parcel from hoston was paid in full."
    rows = [(i, f"d{i}", "p", often, often, T0) for i in range(40)]
    rows += [(90, "e0", "p", "The parcel from Yoston was paid in full.", "The parcel from Yoston was paid in full.", T0)]
    rows += [(91, "e1", "p", "Doctor Zaethorn signed the parcel.", "Doctor Zaeth0rn signed the parcel.", T0)]
    rows += [(92, "e2", "p", None, "Bring kettle vumpra here", T0)]
    got = {r.record_id: r.repaired_text for r in repair.repaired_texts(spark.createDataFrame(rows, ENGINE)).collect()}
    assert got[90] == "The parcel from Yoston was paid in full."
    assert got[91] == "Doctor Zaethorn signed the parcel."
    assert got[92] == "Bring kettle vumpra here" and len(got) == 43


def test_far_candidates_leave_the_token(spark):
    rows = [(0, "d0", "p", "gunement", "gunement", T0), (1, "d1", "p", None, "gaementx", T0)]
    got = {r.record_id: r.repaired_text for r in repair.repaired_texts(spark.createDataFrame(rows, ENGINE)).collect()}
    assert got == {0: "gunement", 1: "gaementx"}


def test_candidates_over_several_shards(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(300)})
    tokens = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(60)})
    trie = repair.build_trie(words)
    want = sorted((t, w) for t in tokens for w, _ in repair.within(trie, t, 1 if len(t) < 6 else 2) if w != t)
    monkeypatch.setattr(repair, "TRIE_WORDS", 90)
    out = repair.candidates(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert sorted((r.token, r.candidate) for r in out.collect()) == want and len(want) > 100


class Asked(set):
    """A vocabulary that answers at random and notes the questions."""

    def __init__(self, rng):
        self.rng, self.seen = rng, {}

    def __contains__(self, word):
        return self.seen.setdefault(word, self.rng.random() < 0.5)


def test_asked_words_are_all_that_is_asked():
    rng = random.Random(4)
    bits = ["la-", "zy", "K2-99", "-", "par", "ties", "Foo/ba-", "don't", "E", "x_y", "Ünï-", "(end)"]
    for _ in range(400):
        text = "\n".join(" ".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 1, 1, 3)))) for _ in range(rng.randint(1, 9)))
        known = Asked(rng)
        page = layout.read_page(text, None, frozenset(), known)
        for t in layout.reflow(page, known):
            repair._suspicious(t, known)
        lines = [page["lines"][i].split() for i in page["own"]]
        assert {w for w in known.seen if w} <= repair.asked_words(lines, 10**6)
        short = repair.asked_words(lines, 5)
        assert {w for w in known.seen if 0 < len(w) <= 5} <= short and all(len(w) <= 5 for w in short)
