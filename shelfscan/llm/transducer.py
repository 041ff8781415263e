"""Minimal acyclic transducers: words in, sequences of token ids out, as one file that workers map into memory.

Words are added in byte order. As soon as a state can get no more arrows it is merged with an equal one (same
arrows, same outputs, same ending), so common endings are stored once; outputs move as close to the start as the
words that share an arrow allow, so common beginnings share their ids. The file holds three arrays: arrows sorted
by (state, byte), states, and a pool of ids that both point into.
"""

from __future__ import annotations

import numpy as np

ARROW = np.dtype([("key", "<i8"), ("target", "<i4"), ("start", "<i4"), ("size", "<i4")])
STATE = np.dtype([("final", "<i4"), ("start", "<i4"), ("size", "<i4")])


class _State:
    __slots__ = ("arrows", "ends", "rest", "number")

    def __init__(self) -> None:
        self.arrows: dict[int, list] = {}  # byte: [state, ids]
        self.ends = False
        self.rest: tuple[int, ...] = ()  # ids put out where a word ends here
        self.number = -1


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Builder:
    """Takes distinct words in rising byte order."""

    def __init__(self) -> None:
        self.path = [_State()]
        self.last = b""
        self.known: dict[tuple, _State] = {}
        self.states: list[_State] = []

    def _settle(self, depth: int) -> None:
        """Merge the states of the last word beyond ``depth`` with equal ones."""
        while len(self.path) > depth + 1:
            state = self.path.pop()
            key = (state.ends, state.rest, tuple((b, t.number, ids) for b, (t, ids) in state.arrows.items()))
            same = self.known.get(key)
            if same is None:
                state.number = len(self.states)
                self.states.append(state)
                self.known[key] = same = state
            self.path[-1].arrows[self.last[len(self.path) - 1]][0] = same

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        common = 0
        for x, y in zip(word, self.last):
            if x != y:
                break
            common += 1
        self._settle(common)
        for depth in range(common):
            arrow = self.path[depth].arrows[word[depth]]
            n = _shared(arrow[1], ids)
            behind = arrow[1][n:]
            if behind:  # what only some words put out moves on, behind the arrow
                after = self.path[depth + 1]
                for other in after.arrows.values():
                    other[1] = behind + other[1]
                if after.ends:
                    after.rest = behind + after.rest
                arrow[1] = arrow[1][:n]
            ids = ids[n:]
        for depth in range(common, len(word)):
            after = _State()
            self.path[-1].arrows[word[depth]] = [after, ids]
            self.path.append(after)
            ids = ()
        self.path[-1].ends = True
        self.path[-1].rest = ids
        self.last = word

    def write(self, path: str) -> None:
        self._settle(0)
        root = self.path[0]
        root.number = len(self.states)
        self.states.append(root)
        pool: list[int] = []
        places: dict[tuple[int, ...], int] = {(): 0}

        def place(ids: tuple[int, ...]) -> int:
            if ids not in places:
                places[ids] = len(pool)
                pool.extend(ids)
            return places[ids]

        arrows = [(s.number << 8 | b, t.number, place(ids), len(ids)) for s in self.states for b, (t, ids) in s.arrows.items()]
        states = [(s.ends, place(s.rest), len(s.rest)) for s in self.states]
        arrows.sort()
        with open(path, "wb") as f:
            np.array([len(arrows), len(states), len(pool), root.number], "<i8").tofile(f)
            np.array(arrows, ARROW).tofile(f)
            np.array(states, STATE).tofile(f)
            np.array(pool, "<u4").tofile(f)


class Transducer:
    """A written file, mapped into memory: all workers of a machine share its pages."""

    def __init__(self, path: str) -> None:
        n_arrows, n_states, n_pool, self.root = np.fromfile(path, "<i8", 4).tolist()

        def mapped(dtype, count: int, offset: int) -> np.ndarray:
            return np.memmap(path, dtype, "r", offset, (count,)) if count else np.zeros(0, dtype)

        at = 32
        self.arrows = mapped(ARROW, n_arrows, at)
        at += n_arrows * ARROW.itemsize
        self.states = mapped(STATE, n_states, at)
        at += n_states * STATE.itemsize
        self.pool = mapped(np.dtype("<u4"), n_pool, at)

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words at once: which are known, how many ids each puts out, and the ids one word after the other."""
        n = len(offsets) - 1
        sizes = offsets[1:] - offsets[:-1]
        state = np.full(n, self.root, np.int64)
        known = np.ones(n, bool)
        keys = self.arrows["key"]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step, alive = 0, np.arange(n)
        while len(alive):
            alive = alive[sizes[alive] > step]
            key = state[alive] << 8 | data[offsets[alive] + step]
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(alive), bool)
            known[alive[~hit]] = False
            alive, at = alive[hit], at[hit]
            arrows = self.arrows[at]
            state[alive] = arrows["target"]
            some = arrows["size"] > 0
            found.append((alive[some], arrows["start"][some], arrows["size"][some]))
            step += 1
        ends = self.states[state]
        known &= ends["final"] > 0
        some = np.flatnonzero(ends["size"] > 0)
        found.append((some, ends["start"][some], ends["size"][some]))
        word, start, size = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))
        keep = known[word]
        word, start, size = word[keep], start[keep], size[keep]
        order = np.argsort(word, kind="stable")
        word, start, size = word[order], start[order], size[order]
        counts = np.zeros(n, np.int64)
        np.add.at(counts, word, size)
        return known, counts, self.pool[spread(start, size)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of every run, one run after the other."""
    if not len(start):
        return np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)
