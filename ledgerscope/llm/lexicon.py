"""A minimal acyclic transducer from words (bytes) to lists of ids, in flat arrays that are memory-mapped.

Words that share an ending share its states, so the automaton cannot hold an output
per state. Each arc holds instead how many words come before those behind it; the sum
along a word's path is the word's place in sorted order, and that place has the ids.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x4C455831  # first number of a file


def _minimal_states(words: list[bytes]):
    """States of the minimal automaton for sorted distinct ``words``: ``(final, ((byte, state), ...))`` by number."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def settled(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path = [[False, []]]  # the open states along the last word; the arc to the next open state is added when it settles
    last = b""
    for word in words:
        shared = 0
        limit = min(len(word), len(last))
        while shared < limit and word[shared] == last[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            number = settled(path.pop())
            path[-1][1].append((last[depth - 1], number))
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        number = settled(path.pop())
        path[-1][1].append((last[depth - 1], number))
    return states, settled(path.pop())


def compile_lexicon(entries: dict[bytes, list[int]], path: str) -> None:
    """Writes the transducer for ``entries`` to ``path``; the empty word may not be an entry."""
    words = sorted(entries)
    if words and not words[0]:
        raise ValueError("the empty word has no ids")
    states, root = _minimal_states(words)
    behind = np.zeros(len(states), np.int64)  # words accepted from a state; targets have smaller numbers
    first = np.zeros(len(states) + 1, np.int64)
    labels, targets, skips = [], [], []
    for number, (final, arcs) in enumerate(states):
        before = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += int(behind[target])
        behind[number] = before
        first[number + 1] = len(labels)
    keys = np.repeat(np.arange(len(states)), np.diff(first)) * 256 + np.array(labels, np.int64)
    lengths = np.array([0] + [len(entries[word]) for word in words], np.int64)
    ids = np.array([i for word in words for i in entries[word]], np.int64)
    final = np.array([state[0] for state in states], np.int64)
    parts = [keys, np.array(targets, np.int64), np.array(skips, np.int64), final, np.cumsum(lengths), ids]
    header = np.array([MAGIC, root, *(len(part) for part in parts)], np.int64)
    np.concatenate([header, *parts]).astype("<i8").tofile(path)


class Lexicon:
    """A compiled file, memory-mapped and read in place."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i8", "r")
        if data[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root = int(data[1])
        parts, at = [], 8
        for length in data[2:8]:
            parts.append(data[at : at + int(length)])
            at += int(length)
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in sorted order, -1 for words that are not there. All words walk side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.root, np.int64)
        place = np.zeros(len(words), np.int64)
        alive = np.flatnonzero(lengths > 0)
        place[lengths == 0] = -1
        step = 0
        while len(alive):
            key = state[alive] * 256 + text[starts[alive] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            found = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), bool)
            place[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            state[alive] = self.targets[arc]
            place[alive] += self.skips[arc]
            step += 1
            ended = lengths[alive] == step
            stop = alive[ended]
            place[stop[self.final[state[stop]] == 0]] = -1
            alive = alive[~ended]
        return place
