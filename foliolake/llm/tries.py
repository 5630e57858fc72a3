"""Levenshtein automata walked together with vocabulary tries.

The automaton of a word and a number of edits is kept as one integer per
number of edits spent: bit i is the state "i characters of the word are read".
All states step at once with a few shifts.

A trie node maps a character to the next node, or to the whole word where only
one word goes on; the empty string leads to the word that ends in the node.
"""

from __future__ import annotations


def _node(words: list[str], depth: int) -> dict:
    """The node of sorted ``words`` that share their first ``depth`` characters."""
    node: dict = {}
    at, n = 0, len(words)
    if len(words[0]) == depth:
        node[""] = words[0]
        at = 1
    while at < n:
        c = words[at][depth]
        end = at + 1
        while end < n and words[end][depth] == c:
            end += 1
        node[c] = words[at] if end == at + 1 else _node(words[at:end], depth + 1) if depth < 200 else _deep(words[at:end], depth + 1)
        at = end
    return node


def _deep(words: list[str], depth: int) -> dict:
    """As ``_node``, for words that share very long beginnings: without recursion."""
    root: dict = {}
    for w in words:
        node = root
        for c in w[depth:]:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def build_trie(words: list[str]) -> tuple[dict, dict]:
    """The trie of the distinct ``words`` and that of the reversed words."""
    once = sorted(set(words))
    if not once:
        return {}, {}
    return _node(once, 0), _node(sorted([w[::-1] for w in once]), 0)


def _masks(word: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _walk_one(trie: dict, word: str, low: int, back: bool, found: dict[str, int]) -> None:
    """Words within one edit; the edit comes after ``low`` - 1 characters."""
    n, node, at = len(word), trie, 0
    get = _masks(word).get
    goal, keep = 1 << n, (2 << n) - (1 << low)
    while at < low - 1:  # so far every character must agree
        child = node.get(word[at])
        if child is None:
            return
        at += 1
        if type(child) is str:
            node = {child[at] if len(child) > at else "": child}
            while at < low - 1 and at < len(child) and child[at] == word[at]:
                at += 1
                node = {child[at] if len(child) > at else "": child}
            if at < low - 1:
                return
            break
        node = child
    stack = [(node, 1 << at, 2 << at & keep, at + 1)]
    while stack:
        node, r0, r1, depth = stack.pop()
        around = r0 << 1 | r0
        for c, child in node.items():
            if c:
                m = get(c, 0)
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1 | around | n0 << 1) & keep
                if not (n0 or n1):
                    continue
                if type(child) is dict:
                    stack.append((child, n0, n1, depth + 1))
                    continue
                if not -2 < len(child) - n < 2:
                    continue
                for x in child[depth:]:
                    m = get(x, 0)
                    step = (n0 & m) << 1
                    n1 = ((n1 & m) << 1 | n0 << 1 | n0 | step << 1) & keep
                    n0 = step
                    if not (n0 or n1):
                        break
            else:
                n0, n1 = r0, r1
            if n0 & goal:
                found[child[::-1] if back else child] = 0
            elif n1 & goal:
                found.setdefault(child[::-1] if back else child, 1)


def _walk_two(trie: dict, word: str, low: int, back: bool, found: dict[str, int]) -> None:
    """Words within two edits; the second comes after ``low`` - 1 characters."""
    n = len(word)
    get = _masks(word).get
    goal, full, keep = 1 << n, (2 << n) - 1, (2 << n) - (1 << low)
    stack = [(trie, 1, 2 & full, 4 & keep, 1)]
    while stack:
        node, r0, r1, r2, depth = stack.pop()
        one, two = r0 << 1 | r0, r1 << 1 | r1
        for c, child in node.items():
            if c:
                m = get(c, 0)
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1 | one | n0 << 1) & full
                n2 = ((r2 & m) << 1 | two | n1 << 1) & keep
                if not (n1 or n2 or n0):
                    continue
                if type(child) is dict:
                    stack.append((child, n0, n1, n2, depth + 1))
                    continue
                if not -3 < len(child) - n < 3:
                    continue
                for x in child[depth:]:
                    m = get(x, 0)
                    a = (n0 & m) << 1
                    b = ((n1 & m) << 1 | n0 << 1 | n0 | a << 1) & full
                    n2 = ((n2 & m) << 1 | n1 << 1 | n1 | b << 1) & keep
                    n0, n1 = a, b
                    if not (n1 or n2 or n0):
                        break
            else:
                n0, n1, n2 = r0, r1, r2
            if n0 & goal:
                found[child[::-1] if back else child] = 0
            elif n1 & goal:
                if found.get(w := child[::-1] if back else child, 1):
                    found[w] = 1
            elif n2 & goal:
                found.setdefault(child[::-1] if back else child, 2)


def _walk_any(trie: dict, word: str, most: int, low: int, back: bool, found: dict[str, int]) -> None:
    """Words within ``most`` edits; the last comes after ``low`` - 1 characters."""
    n = len(word)
    get = _masks(word).get
    goal, full, keep = 1 << n, (2 << n) - 1, (2 << n) - (1 << low)
    first = [1 << e & full for e in range(most + 1)]
    first[most] &= keep

    def step(states: list[int], m: int) -> list[int]:
        before = states[0]
        new = (before & m) << 1
        after = [new]
        for r in states[1:]:
            new = ((r & m) << 1 | before << 1 | before | new << 1) & full
            after.append(new)
            before = r
        after[most] &= keep
        return after

    stack = [(trie, first, 1)]
    while stack:
        node, states, depth = stack.pop()
        for c, child in node.items():
            after = states
            if c:
                after = step(states, get(c, 0))
                if not any(after):
                    continue
                if type(child) is dict:
                    stack.append((child, after, depth + 1))
                    continue
                if abs(len(child) - n) > most:
                    continue
                for x in child[depth:]:
                    after = step(after, get(x, 0))
                    if not any(after):
                        break
            for e, r in enumerate(after):
                if r & goal:
                    w = child[::-1] if back else child
                    if found.get(w, e) >= e:
                        found[w] = e
                    break


def within(trie: tuple[dict, dict], word: str, most: int) -> list[tuple[str, int]]:
    """All trie words at most ``most`` (1 or more) edits from ``word``, with their distance.

    Trie and automaton are walked together; a branch is left as soon as the
    automaton can't accept any more. One half of the word always has an edit
    less than ``most``: the words whose first half has it are found from the
    front, those whose second half has it from the back, so that no walk
    spends all edits near the root, where tries are widest.
    """
    found: dict[str, int] = {}
    half = len(word) // 2
    for root, w, low in ((trie[0], word, half), (trie[1], word[::-1], len(word) - half + 1)):
        # States that spent all edits before ``low`` are dropped.
        if most == 1:
            _walk_one(root, w, low, root is trie[1], found)
        elif most == 2:
            _walk_two(root, w, low, root is trie[1], found)
        else:
            _walk_any(root, w, most, low, root is trie[1], found)
    return list(found.items())
