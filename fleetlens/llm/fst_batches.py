"""The composition of `sentencepiece_fst`, expanded for many short tapes at once: arrays of lexicon arcs, one step a round."""

from __future__ import annotations

import numpy as np

#: Places of the tapes that are expanded together, and below how many open tapes the rest is left to the caller.
PLACES = 200_000
FEW = 24
#: Slots of the table of pairs that a worker remembers; a new pair takes its slot from the one before.
PAIR_SLOTS = 2**20
NEVER = float("-inf")


class Lexicon:
    """Arcs and pair acceptor of a byte-pair `Transducer` as arrays. Pieces go by their place in its table, -1 is none."""

    def __init__(self, transducer):
        self.of = transducer
        names, self.n = list(transducer.ids), len(transducer.ids)
        self.model_id = np.array([*transducer.ids.values(), -1], np.int64)
        points = sorted({ord(c) for p in names for c in p})
        self.char = np.full(0x110001, -1, np.int32)
        self.char[points] = np.arange(len(points))
        self.width = max(1, len(points))
        symbols = {p: i for i, p in enumerate(names)}
        for c in map(chr, points):
            symbols.setdefault(c, len(symbols))
        self.names, self.symbols = names, symbols
        self._compile_trie()
        self._compile_merges()
        self.pairs = np.full(PAIR_SLOTS, -1, np.int64)

    def _compile_trie(self) -> None:
        """Arcs of the trie as sorted keys (state * width + character); the root's as one row."""
        keys, to, self.root = [], [], np.zeros(self.width, np.int64)
        piece_at, place, todo = [-1], {p: i for i, p in enumerate(self.names)}, [(0, self.of.trie)]
        for state, node in todo:
            for c, below in node.items():
                if not c:
                    piece_at[state] = place[below[0]]
                    continue
                keys.append(state * self.width + int(self.char[ord(c)]))
                to.append(len(piece_at))
                todo.append((len(piece_at), below))
                piece_at.append(-1)
        order = np.argsort(keys)
        self.keys, self.to = np.array([*np.array(keys, np.int64)[order], -1]), np.array([*np.array(to, np.int64)[order], 0])
        self.piece_at = np.array(piece_at, np.int64)
        at_root = self.keys[:-1] < self.width
        self.root[self.keys[:-1][at_root]] = self.to[:-1][at_root]

    def _compile_merges(self) -> None:
        """Scores of all merges by pair of symbols; the steps of a piece are filled in when a pair first asks for them."""
        symbols, scores, found = self.symbols, self.of.scores, {}
        for p in self.names:
            for i in range(1, len(p)):
                if p[:i] in symbols and p[i:] in symbols:
                    found[symbols[p[:i]] * len(symbols) + symbols[p[i:]]] = scores[p]
        keys = np.array(sorted(found), np.int64)
        self.merge_keys, self.merge_scores = np.append(keys, -1), np.array([*map(found.get, keys.tolist()), NEVER])
        longest = max(map(len, self.names), default=1)
        self.known, self.sound = np.zeros(self.n, bool), np.zeros(self.n, bool)
        self.score = np.full((self.n, longest + 1), NEVER)
        self.first, self.last = (np.zeros((self.n, longest + 1), np.int32) for _ in range(2))
        self.head, self.tail = (np.array([symbols[p[k]] for p in self.names], np.int64) for k in (0, -1))

    def _fill(self, pieces: np.ndarray) -> None:
        for x in np.unique(pieces[~self.known[pieces]]).tolist():
            steps, self.sound[x] = self.of._steps(self.names[x])
            for k, (score, first, last) in enumerate(steps):
                self.score[x, k], self.first[x, k], self.last[x, k] = score, self.symbols[first], self.symbols[last]
            self.known[x] = True

    def _may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """`Transducer._may_follow` for arrays of pieces: one step of each pair's replay a round."""
        self._fill(np.concatenate([x, y]))
        ok = self.sound[x] & self.sound[y]
        at = np.flatnonzero(ok)
        x, y = x[at], y[at]
        i, j, end, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), self.tail[x], self.head[y]
        while len(at):
            a, b = self.score[x, i], self.score[y, j]
            key = end * len(self.symbols) + start
            found = np.minimum(np.searchsorted(self.merge_keys[:-1], key), len(self.merge_keys) - 1)
            across = np.where(self.merge_keys[found] == key, self.merge_scores[found], NEVER)
            refused = (across > a) & (across >= b)
            ok[at[refused]] = False
            left = a >= b
            end, start = np.where(left, self.last[x, i], end), np.where(left, start, self.first[y, j])
            i, j = i + left, j + ~left
            on = ~refused & ~(left & (a == NEVER))
            at, x, y, i, j, end, start = (v[on] for v in (at, x, y, i, j, end, start))
        return ok

    def follows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The pair acceptor; bytes (-1) follow and are followed by anything."""
        ok = np.ones(len(x), bool)
        at = np.flatnonzero((x >= 0) & (y >= 0))
        key = x[at] * self.n + y[at]
        slot = ((key * 0x9E3779B1) >> 15) & (PAIR_SLOTS - 1)
        held = self.pairs[slot]
        ok[at] = held & 1
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            asked, of = np.unique(key[new], return_inverse=True)
            got = self._may_follow(asked // self.n, asked % self.n)[of]
            self.pairs[slot[new]] = key[new] * 2 + got
            ok[at[new]] = got
        return ok

    def _arcs(self, text: np.ndarray, end_of_tape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first arc of each place and the end, place where each arc starts, where it ends, its piece), by place and
        length; a character without a piece of its own has its bytes' arc, piece -1."""
        places, chars = np.arange(len(text)), self.char[text].astype(np.int64)
        at, state, levels = places, np.where(chars < 0, 0, self.root[chars]), []
        levels.append((at, self.piece_at[state]))
        k = 1
        while True:
            on = (state > 0) & (at + k < end_of_tape[at])
            at, state = at[on], state[on]
            c = chars[at + k]
            at, state, c = at[c >= 0], state[c >= 0], c[c >= 0]
            if not len(at):
                break
            key = state * self.width + c
            found = np.searchsorted(self.keys[:-1], key)
            hit = self.keys[found] == key
            at, state = at[hit], self.to[found[hit]]
            piece = self.piece_at[state]
            levels.append((at[piece >= 0], piece[piece >= 0]))
            k += 1
        many = np.zeros(len(text), np.int64)
        for at, _ in levels:
            many[at] += 1
        first = np.concatenate([[0], np.cumsum(many)])
        origin, to, pieces = (np.full(first[-1] + 1, -1, np.int64) for _ in range(3))
        free = first[:-1].copy()
        for k, (at, piece) in enumerate(levels, 1):
            where = free[at]
            origin[where], to[where], pieces[where] = at, at + k, piece
            free[at] += 1
        return first, origin, to, pieces

    def finite_paths(self, tapes: list[str]) -> list[tuple[int, ...] | None]:
        """`Transducer._finite_path` of each tape (none empty); None for the last few open ones, which are not worth a
        round.

        Each round takes one step of every open tape: its longest untried arc, if the acceptor lets it follow and its
        state is not known to have no way on, else, without arcs left, one step back."""
        size = np.array([len(t) for t in tapes])
        goal = np.cumsum(size)
        start = goal - size
        text = np.frombuffer("".join(tapes).encode("utf-32-le"), np.uint32)
        first, origin, to, piece = self._arcs(text, np.repeat(goal, size))
        rows = len(tapes)
        depth, last, at = np.zeros(rows, np.int64), np.full(rows, -1, np.int64), start.copy()
        taken, untried = (np.full((rows, int(size.max()) + 1), -1, np.int32) for _ in range(2))
        untried[:, 0] = first[start + 1] - 1
        dead, live = np.zeros(len(to), bool), np.arange(rows)
        while len(live) > FEW:
            d = depth[live]
            arc = untried[live, d].astype(np.int64)
            has = arc >= first[at[live]]
            t, a, k = live[has], arc[has], d[has]
            untried[t, k] -= 1
            ok = self.follows(last[t], piece[a]) & ~dead[a]
            t, a, k = t[ok], a[ok], k[ok] + 1
            depth[t], taken[t, k], at[t], last[t] = k, a, to[a], piece[a]
            on = to[a] < goal[t]
            untried[t[on], k[on]] = first[to[a[on]] + 1] - 1
            t = live[~has]
            if len(t):
                back = taken[t, d[~has]]
                dead[back], at[t] = True, origin[back]
                depth[t] -= 1
                if depth[t].min() < 0:
                    raise ValueError("a tape has no path of finite cost")
                last[t] = piece[taken[t, depth[t]]]
            live = live[at[live] < goal[live]]
        done = at == goal
        used = np.arange(1, taken.shape[1]) <= depth[:, None]
        flat = taken[:, 1:][used]
        ids, spelled = self.model_id[piece[flat]].tolist(), np.flatnonzero(piece[flat] < 0).tolist()
        ends = np.cumsum(depth).tolist()
        out = [tuple(ids[i:j]) if ok else None for ok, i, j in zip(done.tolist(), [0, *ends], ends, strict=False)]
        for tape in np.unique(np.searchsorted(ends, spelled, "right")).tolist():
            if out[tape] is not None:
                arcs = flat[ends[tape] - depth[tape] : ends[tape]].tolist()
                each = [(int(self.model_id[piece[a]]),) if piece[a] >= 0 else self.of.spelled(chr(text[origin[a]])) for a in arcs]
                out[tape] = tuple(x for part in each for x in part)
        return out
