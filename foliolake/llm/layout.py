"""Lines of a scanned page: furniture, cut words and misread words.

Where the page's own text is known, its words are the vocabulary: a line of
the reading that the text has in its place is right, and each word that is not
gets its candidates from the trie of the page's words by a walk with a
Levenshtein automaton. The context ranks them: the word due in this place
comes first. A word is misread when such a candidate stands in its place, cut
when it and the next line's first word are one candidate.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from foliolake.llm.tries import build_trie, within

PAGE_NUMBER = re.compile(
    r"\s*(?:(?:page|sheet|p\.|pg\.?|seite|blatt)\s*\d{1,4}(?:\s*(?:of|/|von)\s*\d{1,4})?|[-–*\[(]\s*\d{1,4}\s*[-–*\])]|\d{1,4}\s*/\s*\d{1,4}|\d{1,3})\s*",
    re.IGNORECASE,
)
CUT_MARKS = "-‐‑¬­"
#: Characters that must agree where a reading meets its reference again.
SURE = 6
_WORD = re.compile(r"[^\W_]+")
_NUMBERED = re.compile(r"\s+\d{1,4}\s*$")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def solid(text: str) -> str:
    """Lower-case letters and digits only."""
    low = text.lower()
    return low if low.isalnum() else "".join(_WORD.findall(low))


def alike(a: str, b: str) -> bool:
    """Equal up to a fifth of the characters: shared 3-grams decide."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > max(len(a), len(b)) // 4 + 1:
        return False
    x, y = {a[i : i + 3] for i in range(len(a) - 2)}, {b[i : i + 3] for i in range(len(b) - 2)}
    return bool(x and y) and len(x & y) >= 0.5 * max(len(x), len(y))


def bare(line: str) -> str:
    """Letters and digits of a line without a trailing number."""
    return solid(_NUMBERED.sub("", line))


def frames_of(line: str) -> list[str]:
    w = words_of(_NUMBERED.sub("", line))
    if len(w) < 2:
        return []
    return ["^" + " ".join(w[:2]), " ".join(w[-2:]) + "$"]


def _grams(s: str, k: int) -> set[str]:
    return {s[i : i + k] for i in range(max(1, len(s) - k + 1))}


class Reference:
    """A page's own text, prepared once for all readings of the page."""

    def __init__(self, text: str):
        self.words = [w for w in map(solid, text.split()) if w]
        self.flat = "".join(self.words)
        self.ends = list(accumulate(map(len, self.words)))
        self.starts = {0, *self.ends}
        self.known = frozenset(self.words)
        self._trie = None

    def __bool__(self) -> bool:
        return bool(self.flat)

    def word_at(self, p: int) -> int:
        return bisect_right(self.ends, p)

    @property
    def trie(self) -> tuple[dict, dict]:
        if self._trie is None:
            self._trie = build_trie(self.known)
        return self._trie

    def own(self, tokens: list[str], s: str) -> float:
        """Share of the 5-grams of the line ``s`` that the text has; 1 when its whole words make up most of the line."""
        if s in self.flat or sum([len(t) for t in tokens if t in self.known]) >= 0.7 * len(s):
            return 1.0
        return self.share(s, 5)

    def near(self, s: str) -> bool:
        """Has the text most 3-grams of ``s``?"""
        return self.share(s, 3) >= 0.6

    def share(self, s: str, k: int) -> float:
        grams, flat = _grams(s, k), self.flat
        return sum([g in flat for g in grams]) / len(grams)


@lru_cache(maxsize=256)
def reference_of(text: str) -> Reference:
    return Reference(text)


def furniture(lines: list[str], tokens: list[list[str]], reference: Reference | None, frames: frozenset[str]) -> tuple[list[str], list[int]]:
    """'page_no', 'header', 'blank' or 'text' for each line (``tokens`` are its
    solid words); and the lines held for text that would be headers if their frame were known."""
    kinds = ["blank" if not x or x.isspace() else "page_no" if len(x) < 40 and PAGE_NUMBER.fullmatch(x.strip()) else "" for x in lines]
    at = [i for i, k in enumerate(kinds) if k == ""]
    own: dict[int, float] = {}
    joined: dict[int, str] = {}
    if reference:
        joined = {i: "".join(tokens[i]) for i in at}
        own = {i: reference.own(tokens[i], joined[i]) for i in at}
        suspects = [i for i in at if own[i] < 0.5]
    else:
        suspects = at
    known = {i for i in suspects if frames and any(f in frames for f in frames_of(lines[i]))}
    open_lines = [i for i in suspects if i not in known]
    if not reference:  # then only lines with a known frame can be headers
        suspects = sorted(known)
    if not suspects:
        return [k or "text" for k in kinds], open_lines
    filled = [i for i, k in enumerate(kinds) if k != "blank"]
    rank = {i: n for n, i in enumerate(filled)}
    edge = {i for n, i in enumerate(filled) if n in (0, len(filled) - 1) or kinds[filled[n - 1]] == "page_no" or kinds[filled[n + 1]] == "page_no"}
    keys = {i: bare(lines[i]) for i in suspects}
    repeated = set()
    for n, i in enumerate(suspects):
        if len(keys[i]) >= 6:
            for j in suspects[n + 1 :]:
                if (i not in repeated or j not in repeated) and alike(keys[i], keys[j]):
                    repeated.update((i, j))
    header: set[int] = set()
    changed = True
    while changed:  # a header found at an edge makes its neighbour an edge line
        changed = False
        for i in suspects:
            if i in header:
                continue
            if reference:
                yes = i in edge and own[i] < 0.35 and not reference.near(joined[i])
                yes = yes or own[i] < 0.35 and (i in repeated or i in known) or i in repeated and (i in edge or i in known)
                yes = yes and (i in repeated or len(words_of(lines[i])) > 1)
            else:
                yes = i in edge or i in repeated
            if yes:
                header.add(i)
                changed = True
                n = rank[i]
                edge.update(filled[max(0, n - 1) : n + 2])
    return [k or ("header" if i in header else "text") for i, k in enumerate(kinds)], [i for i in open_lines if i not in header]


def _again(reference: Reference, tokens: list[str], i: int, p: int) -> tuple[int, int]:
    """The next token and place where reading and reference agree for SURE
    characters (or up to the end); the least distance wins, without any limit."""
    flat, best = reference.flat, None
    found = (len(tokens), len(flat))
    skipped = 0
    for a in range(i, len(tokens)):
        if best is not None and skipped >= best:
            break
        piece, b = tokens[a], a + 1
        while len(piece) < SURE and b < len(tokens):
            piece += tokens[b]
            b += 1
        if len(piece) >= SURE:
            q = flat.find(piece, p)
        else:
            q = len(flat) - len(piece) if flat.endswith(piece) and len(flat) - len(piece) >= p else -1
        if q >= 0:
            far = abs(q - p - skipped) + min(q - p, skipped)
            if best is None or far < best:
                best, found = far, (a, q)
        skipped += len(tokens[a])
    return found


def compare(lines: list[list[str]], reference: Reference) -> tuple[set[int], set[int]]:
    """Indexes of the ``lines`` (solid tokens) that end in a cut word, and of
    those with a misread word.

    Words are read along the reference. What differs is looked up in the trie of
    the page's words; the candidate due in this place tells the word meant, and
    with it whether letters were lost, changed or only cut. Where no candidate
    is due, reading and reference are brought together again, and the words
    between are looked up among the words passed over.
    """
    flat, ends, words = reference.flat, reference.ends, reference.words
    tokens = [t for line in lines for t in line]
    of = [n for n, line in enumerate(lines) for _ in line]
    breaks: set[int] = set()
    wrong: set[int] = set()
    joined = ["".join(line) for line in lines]
    size = len(flat)
    i = p = 0
    starts = reference.starts

    def meant(word: str, place: int, most: int) -> int | None:
        """Edits between ``word`` and the reference's word in this place, when that is among its candidates."""
        goal, n = words[place], len(word)
        if most == 2 and n < 5 or abs(len(goal) - n) > most:
            return None
        for candidate, d in within(reference.trie, word, most):
            if candidate == goal:
                return d
        return None

    def passed_over(i: int, a: int, p: int, q: int) -> None:
        """Look up tokens i..a among the words of the reference in p..q."""
        if i == a or p >= size:
            return
        there = words[reference.word_at(p) : reference.word_at(max(p, q - 1)) + 1]
        if not there:
            return
        trie = build_trie(there)
        n = i
        while n < a:
            t = tokens[n]
            options = within(trie, t, max(2, (len(t) + 1) // 2))
            d = min((d for _, d in options), default=None)
            if n + 1 < a and d != 0:
                both = t + tokens[n + 1]
                more = within(trie, both, max(1, len(both) // 3))
                e = min(more, key=lambda o: (o[1], o[0]), default=None)
                if e is not None and (d is None or e[1] < d):
                    if of[n] != of[n + 1]:
                        breaks.add(of[n])
                    blame(n, e[0])
                    n += 2
                    continue
            if d:
                wrong.add(of[n])
            n += 1

    def blame(n: int, goal: str) -> None:
        """Tokens n and n + 1 together stand for ``goal``; which of them differ?"""
        head, tail = tokens[n], tokens[n + 1]
        if head + tail == goal:
            return
        if not goal.startswith(head):
            wrong.add(of[n])
        if not goal.endswith(tail):
            wrong.add(of[n + 1])
        if goal.startswith(head) and goal.endswith(tail):
            wrong.add(of[n])

    while i < len(tokens) and p < size:
        line = of[i]
        first = i > 0 and of[i - 1] != line
        if (first or i == 0) and flat.startswith(joined[line], p):
            if first and p not in starts:
                breaks.add(of[i - 1])
            p += len(joined[line])
            i += len(lines[line])
            continue
        t = tokens[i]
        j = bisect_right(ends, p)
        start, end = ends[j - 1] if j else 0, ends[j]
        inside = first and p != start  # the line before ended within this word
        if flat.startswith(t, p):
            q = p + len(t)
            if q in starts or i + 1 < len(tokens) and flat.startswith(tokens[i + 1], q):
                if inside:
                    breaks.add(of[i - 1])
                i, p = i + 1, q
                continue
        head = flat[start:p]
        if inside and flat.startswith(t, end) and (end + len(t) in starts or len(t) >= SURE):
            passed_over(i - 1, i, start, end)  # the word lost its end
            p = end
            continue
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        fits = not after or flat.startswith(after, end)
        alone = both = None
        for most in (1, 2):
            alone = meant(head + t, j, most)
            if after and not (fits and alone is not None):
                both = meant(head + t + after, j, most)
            if alone is not None or both is not None:
                break
        if alone is not None and (both is None or alone <= both):
            if alone:
                wrong.add(line)
            if inside:
                breaks.add(of[i - 1])
            i, p = i + 1, end
            continue
        if both is not None:
            if of[i + 1] != line:
                breaks.add(line)
            if inside:
                breaks.add(of[i - 1])
            blame(i, flat[p:end])
            i, p = i + 2, end
            continue
        a, q = _again(reference, tokens, i, p)
        if a == i and q == p:  # more of the word's end is lost than candidates may lack
            a, q = i + 1, end
        passed_over(i - inside, a, start, q)
        i, p = a, q
    if tokens and 0 < p < size and p not in starts and i == len(tokens):  # the last word lost its end
        passed_over(i - 1, i, ends[bisect_right(ends, p)] - len(words[bisect_right(ends, p)]), p)
    return breaks, wrong


def read_page(text: str, reference: Reference | None, frames: frozenset[str], vocabulary) -> dict:
    """Lines with their kinds, the lines whose last word is cut, and those that differ from the reference.

    ``open`` has the lines that a known frame would make a header. Without a
    reference a word is cut when it ends in a hyphen, or when ``vocabulary``
    has it only together with the next line's first word.
    """
    lines = [x.rstrip("\r") for x in text.split("\n")]
    tokens = [[t if t.isalnum() else "".join(_WORD.findall(t)) for t in x.split()] for x in text.lower().split("\n")]
    kinds, open_lines = furniture(lines, tokens, reference, frames)
    own = [i for i, k in enumerate(kinds) if k == "text"]
    breaks: set[int] = set()
    wrong: set[int] = set()
    if reference:
        live = [(i, w) for i in own if (w := [t for t in tokens[i] if t])]
        cut, bad = compare([w for _, w in live], reference)
        breaks, wrong = {live[n][0] for n in cut}, {live[n][0] for n in bad}
    else:
        for i, k in zip(own, own[1:]):
            last, nxt = lines[i].split()[-1:], lines[k].split()[:1]
            if not last or not nxt or not nxt[0][0].isalnum():
                continue
            stem = last[0].rstrip(CUT_MARKS)
            if stem and stem != last[0] and stem[-1].isalnum():
                breaks.add(i)
            elif last[0].isalpha() and words_of(nxt[0]):
                a, b = last[0].lower(), words_of(nxt[0])[0]
                if a + b in vocabulary and (a not in vocabulary or b not in vocabulary):
                    breaks.add(i)
    return {"lines": lines, "kinds": kinds, "open": open_lines, "own": own, "breaks": breaks, "wrong": wrong}


def reflow(page: dict, vocabulary) -> list[str]:
    """Blank-separated tokens of the page's text with cut words rejoined."""
    tokens: list[str] = []
    glue = False
    for i in page["own"]:
        parts = page["lines"][i].split()
        if glue and tokens and parts:
            head, tail = tokens.pop(), parts.pop(0)
            stem = head.rstrip(CUT_MARKS)
            joined = solid(stem + tail)
            code = any(c.isdigit() for c in stem + tail)
            keep = head.endswith("-") and (code or joined not in vocabulary and all(w in vocabulary for w in words_of(stem + " " + tail)))
            tokens.append((stem + "-" if keep else stem) + tail)
        tokens.extend(parts)
        glue = i in page["breaks"]
    return tokens
