"""SentencePiece encoding as a weighted finite-state transducer: shortest paths in the tropical semiring."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import chunks, held, short_batches, utf8
from fleetlens.llm.fst_batches import FEW, PLACES, Lexicon

MODEL = os.environ.get("FLEETLENS_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
UNIT = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bounds of what a worker keeps; the first ones stay, which have the frequent words.
CACHED_UNITS = 150_000
CACHED_PAIRS = 100_000
CACHED_MERGES = 50_000
#: Units of at most so many characters are kept, and composed many at once.
SHORT = 64


def _fields(b: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of one protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
        else:
            value, i = b[i : i + 8], i + 8
        yield key >> 3, value


#: States of the normaliser: nothing came out yet, inside a word, white space that may be trailing is held back.
START, INSIDE, GAP = 0, 1, 2


class Transducer:
    """Normaliser, pieces and byte fallback of a model, compiled for composition with an input.

    The normaliser's arcs read a character and write what the model makes of it: a space becomes SPACE (or nothing, where
    the model drops white space at the ends and repeats of it), the first character may get a SPACE in front. They cost
    nothing. The piece lexicon is a trie whose final arcs give a piece at its cost, minus its score, and a character that
    no piece covers goes to its bytes' pieces. In a byte-pair model the score is the rank of the piece's merge, and the
    lexicon is composed with an acceptor of pairs: piece y may follow x (at no cost, else never) where merging their
    characters best score first gives x, y again. As merges on both sides of a boundary that none crosses are independent,
    each string has exactly one path with such pairs only, and it is the model's segmentation. So the cheapest path of
    this composition is the answer for both kinds of model; in a unigram one no acceptor restricts it."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("only unigram and byte-pair models with the identity normaliser and plain pieces are compiled")
        self.prefix, self.trim, self.escape = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1))
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.scores = {p: s for p, s, t in pieces if t == NORMAL}
        self.mark = SPACE if self.escape else " "
        self.inner_space = any(self.mark in p.lstrip(self.mark) for p in self.ids)
        self.normaliser = self._normaliser()
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown_cost = -(min(self.scores.values(), default=0.0) - 10.0)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, (i,), -self.scores[p])
        self.out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.encode() for p, _, t in pieces]
        self.units: dict[str | tuple[str, int], tuple[int, ...]] = {}
        self.lexicon: Lexicon | None = None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.merges: dict[str, tuple] = {}

    def _normaliser(self) -> dict[tuple[int, bool], tuple[int, str, bool]]:
        """{(state, whether a space is read): (next state, what is written before the character, whether the character
        is written)}; a space that is written is written as ``mark``."""
        first = self.mark if self.prefix else ""
        if self.trim:
            return {
                (START, True): (START, "", False), (INSIDE, True): (GAP, "", False), (GAP, True): (GAP, "", False),
                (START, False): (INSIDE, first, True), (INSIDE, False): (INSIDE, "", True), (GAP, False): (INSIDE, self.mark, True),
            }
        return {(START, True): (INSIDE, first, True), (START, False): (INSIDE, first, True), (INSIDE, True): (INSIDE, "", True), (INSIDE, False): (INSIDE, "", True)}

    def _tape(self, text: str, state: int = START) -> str:
        """What the normaliser's arcs write for a text read from a state: its composition with the text is one chain."""
        if not self.trim:  # every character is written, as it is read
            return (self.mark if self.prefix and text and state == START else "") + text.replace(" ", self.mark)
        out, arcs, mark = [], self.normaliser, self.mark
        for c in text:
            state, before, kept = arcs[state, c == " "]
            if before:
                out.append(before)
            if kept:
                out.append(mark if c == " " else c)
        return "".join(out)

    def _steps(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """([(score, first part, last part after the merge)], whether the piece comes out): a byte-pair model's merges
        on the piece's characters, best score first, the leftmost of equals."""
        got = self.merges.get(piece)
        if got is None:
            parts, steps = list(piece), []
            while True:
                best = max(((self.scores[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.scores), default=None)
                if best is None:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                steps.append((best[0], parts[0], parts[-1]))
            got = steps, parts == [piece]
            if len(self.merges) < CACHED_MERGES:
                self.merges[piece] = got
        return got

    def _may_follow(self, x: str, y: str) -> bool:
        """Whether merging the characters of x and y gives x, y: both sides' merges are replayed in order of score, and
        none across the boundary may be due before the next one on a side."""
        (left, sound), (right, also) = self._steps(x), self._steps(y)
        if not (sound and also):
            return False
        scores, i, j, end, start, never = self.scores, 0, 0, x[-1], y[0], float("-inf")
        while True:
            a = left[i][0] if i < len(left) else never
            b = right[j][0] if j < len(right) else never
            across = scores.get(end + start)
            if across is not None and across > a and across >= b:
                return False
            if a >= b:
                if a == never:
                    return True
                end = left[i][2]
                i += 1
            else:
                start = right[j][1]
                j += 1

    def _arcs(self, text: str, i: int) -> list[tuple]:
        """(end, piece, ids, cost) of the arcs that leave place i, shortest first; the last resort is a character's bytes."""
        arcs, node = [], self.trie
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                break
            if "" in node:
                arcs.append((j + 1, *node[""]))
        if not arcs or arcs[0][0] != i + 1:
            arcs.insert(0, (i + 1, "", self.spelled(text[i]), self.unknown_cost))
        return arcs

    def spelled(self, char: str) -> tuple[int, ...]:
        """The ids of a character that no piece covers."""
        return tuple(self.bytes.get(x, self.unknown) for x in char.encode()) if self.bytes else (self.unknown,)

    def _follows(self, x: str, y: str) -> bool:
        """The pair acceptor, with what a worker remembers of it; bytes follow and are followed by anything."""
        ok = not (x and y) or self._may_follow(x, y)
        if len(self.pairs) < CACHED_PAIRS:
            self.pairs[x, y] = ok
        return ok

    def shortest_path(self, text: str, state: int = START) -> tuple[int, ...]:
        """The ids on the cheapest path of the transducer composed with a text that is read from a normaliser's state.

        In a byte-pair model one path alone has a finite cost, so the composition is expanded depth first and only as
        far as that path asks; `cheapest_path` gives the same from all states, `Lexicon.finite_paths` for many tapes at once."""
        tape = self._tape(text, state)
        return self._finite_path(tape) if self.kind == BPE else self.cheapest_path(tape)

    def _finite_path(self, tape: str) -> tuple[int, ...]:
        """The one path of finite cost, long pieces first. A state is a place and the piece that ends there; a state
        without a way on is not entered again."""
        n, pairs, dead = len(tape), self.pairs, set()
        path: list[tuple] = [(0, "", (), self._arcs(tape, 0) if n else [])]
        while path[-1][0] < n:
            _, last, _, arcs = path[-1]
            while arcs:
                j, piece, ids, _ = arcs.pop()
                ok = pairs.get((last, piece))
                if (ok or (ok is None and self._follows(last, piece))) and (j, piece) not in dead:
                    path.append((j, piece, ids, self._arcs(tape, j) if j < n else None))
                    break
            else:
                at, piece, *_ = path.pop()
                dead.add((at, piece))
        return tuple(chain.from_iterable(p[2] for p in path))

    def cheapest_path(self, tape: str) -> tuple[int, ...]:
        """The ids on the cheapest path over what the normaliser wrote, from all reached states of the composition.

        A state is a place of the normaliser's chain, in a byte-pair model with the piece that ends there. Places are in
        topological order, so one pass relaxes each arc once: costs add up along a path, the least is kept, the first of
        equals. A pair that the acceptor forbids costs infinitely much."""
        pairwise, pairs = self.kind == BPE, self.pairs
        n = len(tape)
        best: list[list[tuple]] = [[] for _ in range(n + 1)]  # at each place states (cost, piece, ids, state before)
        best[0].append((0.0, "", (), None))
        for i in range(n):
            here = best[i]
            for j, piece, ids, weight in self._arcs(tape, i) if here else ():
                found = None
                for before in here:
                    cost = before[0] + weight
                    if found is None or cost < found[0]:
                        ok = not pairwise or pairs.get((before[1], piece))
                        if ok or (ok is None and self._follows(before[1], piece)):
                            found = (cost, piece, ids, before)
                if found is None:
                    continue
                there = best[j]
                if pairwise or not there:
                    there.append(found)
                elif found[0] < there[0][0]:
                    there[0] = found
        out, at = [], min(best[n], key=lambda x: x[0])
        while at:
            out.append(at[2])
            at = at[3]
        return tuple(chain.from_iterable(reversed(out)))

    def encode(self, text: str) -> list[int]:
        """Piece ids of a text, see `encode_all`."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Piece ids of each text. Where no piece has a space inside, no path crosses from a word into the next space, and
        the normaliser's state before a space is known: so each unit (spaces or SPACE and what follows them) is composed once for
        each state and its path kept. A text's first unit is read from START, all others from INSIDE, as only the last
        one can end with a space."""
        if self.inner_space:
            return [list(self.shortest_path(t)) for t in texts]
        keys: list[list] = [UNIT.findall(t) for t in texts]
        for units in keys:
            if units:
                units[0] = (units[0], START)
        paths = self.units
        new = [u for u in dict.fromkeys(chain.from_iterable(keys)) if u not in paths]
        room = max(0, CACHED_UNITS - len(paths))
        paths.update(zip(new, self._composed(new), strict=True))
        out = [list(chain.from_iterable(map(paths.__getitem__, units))) for units in keys]
        short = [len(u if type(u) is str else u[0]) <= SHORT for u in new]
        kept = set(islice(compress(new, short), room))
        for u in new:
            if u not in kept:
                del paths[u]
        return out

    def _composed(self, keys: list) -> list[tuple[int, ...]]:
        """The paths of units, short ones of a byte-pair model many at once (see `Lexicon`)."""
        tapes = [self._tape(u, INSIDE) if type(u) is str else self._tape(*u) for u in keys]
        paths: list = [() if not t else None for t in tapes]
        if self.kind == BPE and len(tapes) > FEW:
            short = [i for i, t in enumerate(tapes) if 0 < len(t) <= SHORT]
            step = max(1, PLACES * len(short) // max(1, sum(len(tapes[i]) for i in short)))
            self.lexicon = self.lexicon or Lexicon(self)
            for at in range(0, len(short), step):
                part = short[at : at + step]
                for i, path in zip(part, self.lexicon.finite_paths([tapes[i] for i in part]), strict=True):
                    paths[i] = path
        one = self._finite_path if self.kind == BPE else self.cheapest_path
        return [one(t) if path is None else path for t, path in zip(tapes, paths, strict=True)]

    def decode(self, ids) -> str:
        """The text of piece ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.out.__getitem__, ids)).replace(SPACE.encode(), b" ")
        return raw[1 if self.prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace")


def _transducer(model: bytes) -> Transducer:
    return held(("transducer", hash(model)), lambda: Transducer(model))


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file, read by the driver; its size is that of a vocabulary."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """Add token_ids, n_tokens and round_trip (decoding gives the text again) to ``docs``.

    Null and empty texts have no tokens and round-trip. A text with a literal SPACE character does not round-trip, as
    in any such model. Every row gets a row; columns of these names are replaced; texts of any length are encoded whole."""
    short_batches(docs.sparkSession)
    names = ["token_ids", "n_tokens", "round_trip"]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for at, to in chunks(utf8(texts)[1]):
                part = texts.slice(at, to - at).to_pylist()
                ids = t.encode_all([x or "" for x in part])
                same = [t.decode(i) == (x or "") for i, x in zip(ids, part, strict=True)]
                sizes = [len(i) for i in ids]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes))))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns[:-1]), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], [*b.schema.names[:-1], *names])

    given = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, head + "token_ids array<int>, n_tokens long, round_trip boolean")


def decoded(tokens: DataFrame, model: bytes, ids_col: str = "token_ids", into: str = "text") -> DataFrame:
    """Add the decoded text of the ids in ``ids_col``; null ids give null, no ids the empty text."""
    kept = [c for c in tokens.columns if c != into]
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for b in batches:
            texts = [None if i is None else t.decode(i) for i in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], into])

    given = tokens.select(*kept, F.col(ids_col).cast("array<int>").alias("__ids"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, head + f"`{into}` string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document; null and empty texts have none, see `encoded`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, model_bytes(spark)).select("doc_id", "n_tokens", "round_trip", "token_ids")
