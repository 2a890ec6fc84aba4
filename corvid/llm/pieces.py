"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The vocabulary (pieces, scores, byte pieces) is read from a public model file on the
driver and broadcast.  The automaton holds all pieces; at each position its output
links give every piece that ends there, longest first, and each relaxes the best score
at its end.  A character that no piece covers costs the lowest score less ten and is
written as its bytes.  Where no piece has a white-space mark after another character,
the best path is the best paths of the marked words, one after another, so words are
encoded once and remembered.  The new words of some hundred texts go through the automaton
and the relaxations together, a character of all of them at a time; long units go alone.

Text is taken as it is (identity normalisation, one mark put in front, spaces as marks);
decoding gives the text back, but for marks (U+2581) in it, which become spaces.

Edge cases: null and empty texts have no pieces; decoding nothing gives the empty text;
repeated rows and extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: The public model used unless another path is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words remembered by a worker, and the longest of them in characters; beyond the number those that did not come lately are forgotten.
REMEMBERED, LONGEST = 200_000, 48
#: Characters of texts whose words are looked up at once, and the most and fewest words whose paths are found at once.
TOGETHER, WORDS, FEW = 1 << 19, 16384, 64
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_workers: dict[str, "Pieces"] = {}


def read_model(path: str = MODEL) -> dict:
    """name, pieces [(piece, id, score)] and bytes [id of each byte, or -1] and unk of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    byte = [i if sp.is_byte(i) else -1 for i in byte]
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {"name": path, "pieces": [(sp.id_to_piece(i), i, sp.get_score(i)) for i in normal], "bytes": byte, "unk": sp.unk_id()}


class Pieces:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: dict):
        scored = [p for p in model["pieces"] if p[0]]
        self._automaton([p for p, _, _ in scored])
        self.scored = [(len(piece), score, i) for piece, i, score in scored]
        self.single = {p for p, _, _ in scored if len(p) == 1}
        self.floor = min((s for _, _, s in scored if s > -1e8), default=0.0) - 10
        # the last place, -1, is that of a character taken as unknown
        self.lengths, self.ids = np.array([*map(len, (p for p, _, _ in scored)), 1], np.int64), np.array([*(i for _, i, _ in scored), -1], np.int64)
        self.scores = np.array([*(s for _, _, s in scored), self.floor], float)
        self.covered = np.zeros(0x110000, bool)
        self.covered[[ord(p) for p in self.single]] = True
        self.bytes, self.unk = model["bytes"], model["unk"]
        self.by_words = not any(MARK in p.lstrip(MARK) for p, _, _ in scored)
        self.text = {i: p.replace(MARK, " ").encode() for p, i, _ in scored} | {i: bytes([b]) for b, i in enumerate(self.bytes) if i >= 0}
        self.text.setdefault(self.unk, " ⁇ ".encode())
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _automaton(self, pieces: list[str]) -> None:
        """Edges, failure links and output links, states by depth; a state's outputs are the pieces that end there, longest first."""
        self.go: dict[int, int] = {}  # state and character, packed
        go, self.fail, own, at = self.go, [0], [-1], [0] * len(pieces)
        longer, depth = range(len(pieces)), 0
        while longer := [j for j in longer if len(pieces[j]) > depth]:
            for j in longer:
                c = ord(pieces[j][depth])
                key = at[j] << 21 | c
                if key not in go:
                    f = self.fail[at[j]]
                    while (n := go.get(f << 21 | c)) is None and f:
                        f = self.fail[f]
                    go[key] = len(own)
                    own.append(-1)
                    self.fail.append(n or 0)
                at[j] = go[key]
                if len(pieces[j]) == depth + 1:
                    own[at[j]] = j
            depth += 1
        self.outs: list[tuple] = [()]
        for state in range(1, len(own)):
            rest = self.outs[self.fail[state]]
            self.outs.append((own[state], *rest) if own[state] >= 0 else rest)
        self.keys = np.array([*sorted(go), 1 << 62], np.int64)
        self.nexts, self.fails = np.array([*(go[k] for k in sorted(go)), 0], np.int64), np.array(self.fail, np.int64)
        self.n_outs = np.array([*map(len, self.outs)], np.int64)
        self.first_out, self.all_outs = np.cumsum(self.n_outs) - self.n_outs, np.array([*chain.from_iterable(self.outs)], np.int64)

    def follow(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after a character each."""
        out, rows = np.zeros(len(states), np.int64), np.arange(len(states))
        while len(rows):
            key = states << 21 | codes
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            out[rows[hit]] = self.nexts[at[hit]]
            rest = np.flatnonzero(~hit & (states > 0))
            rows, states, codes = rows[rest], self.fails[states[rest]], codes[rest]
        return out

    def viterbi(self, unit: str) -> list[int]:
        """Ids on the best path through a unit."""
        n = len(unit)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        go, fail, state = self.go, self.fail, 0
        for end, c in enumerate(map(ord, unit), 1):
            while (found := go.get(state << 21 | c)) is None and state:
                state = fail[state]
            state = found or 0
            for j in self.outs[state]:
                length, score, i = self.scored[j]
                s = best[end - length] + score
                if s > best[end]:
                    best[end], back[end] = s, (end - length, i)
            # characters that no single piece covers may be taken as unknown
            if not self.covered[c] and best[end - 1] + self.floor > best[end]:
                best[end], back[end] = best[end - 1] + self.floor, (end - 1, -1)
        ids: list[int] = []
        i = n
        while i:
            start, piece = back[i]
            if piece >= 0:
                ids.append(piece)
            elif min(self.bytes) >= 0:
                ids += [self.bytes[b] for b in reversed(unit[start:i].encode())]
            else:
                ids.append(self.unk)
            i = start
        return ids[::-1]

    def paths(self, units: list[str]) -> list[bytes]:
        """Ids on the best path through each unit, int32: what ``viterbi`` finds, a character of all units at a time."""
        joined = "\0".join(units)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes + 1) - 1
        of = np.repeat(np.arange(len(units)), sizes + 1)
        by = np.argsort(-sizes, kind="stable")
        starts, states = (ends - sizes)[by], np.zeros(len(units), np.int64)
        best, back = np.full(len(joined) + 1, -np.inf), np.full(len(joined) + 1, -1)
        best[starts] = 0.0

        def relax(end: np.ndarray, piece: np.ndarray) -> None:
            s = best[end - self.lengths[piece]] + self.scores[piece]
            better = s > best[end]
            end = end[better]
            best[end], back[end] = s[better], piece[better]

        for i in range(sizes.max(initial=0)):
            live = np.searchsorted(-sizes[by], -i)  # units of more than i characters
            end, codes = starts[:live] + i + 1, code[starts[:live] + i]
            states = self.follow(states[:live], codes)
            n, out = self.n_outs[states], self.first_out[states]
            while len(some := np.flatnonzero(n)):
                n, out, end = n[some] - 1, out[some], end[some]
                relax(end, self.all_outs[out])
                out = out + 1
            bare = starts[:live][~self.covered[codes]] + i + 1
            relax(bare, np.full(len(bare), -1))
        on, at = np.zeros(len(joined) + 1, bool), ends
        begin = ends - sizes
        while len(at):
            more = at > begin
            at, begin = at[more], begin[more]
            on[at] = True
            at = at - self.lengths[back[at]]
        path = np.flatnonzero(on)
        ids, char, size = self.ids[back[path]], path - 1, np.ones(len(path), np.int64)
        if min(self.bytes) >= 0:
            wide = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            size = np.where(ids < 0, wide[char], 1)
            first = np.repeat(np.cumsum(wide)[char] - wide[char] - np.cumsum(size) + size, size)  # of a character's bytes, less its place in the result
            raw = np.frombuffer(joined.encode(), np.uint8)
            ids = np.repeat(ids, size)
            unknown = np.flatnonzero(ids < 0)
            ids[unknown] = np.array(self.bytes)[raw[first[unknown] + unknown]]
        else:
            ids[ids < 0] = self.unk
        flat, cuts = ids.astype(np.int32).tobytes(), [0, *(4 * np.cumsum(np.bincount(of[char], size, len(units)).astype(np.int64))).tolist()]
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, int32."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars < TOGETHER):
                chars += len(texts[j] or "")
                j += 1
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts[i:j]]
            units = [(_UNIT.findall(m) if self.by_words else [m]) if m else [] for m in marked]
            if len(self.memory) > REMEMBERED // 2:  # words of the older half that come again are kept
                self.memory, self.older = {}, self.memory
            memory, new = self.memory, set().union(*units).difference(self.memory)
            again = {u: self.older[u] for u in new if u in self.older}
            memory.update(again)
            new.difference_update(again)
            long = {u: np.array(self.viterbi(u), np.int32).tobytes() for u in new if len(u) > LONGEST}
            short = [u for u in new if len(u) <= LONGEST]
            for at in range(0, len(short), WORDS):
                some = short[at : at + WORDS]
                memory.update(zip(some, self.paths(some) if len(some) >= FEW else [np.array(self.viterbi(u), np.int32).tobytes() for u in some], strict=True))
            for us in units:
                yield np.frombuffer(b"".join([long[u] if u in long else memory[u] for u in us] if long else [memory[u] for u in us]), np.int32)
            i = j

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, int32."""
        return next(self.encode_all([text]))

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = self.text
        out = b"".join([text.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _worker(model) -> Pieces:
    value = model.value
    if value["name"] not in _workers:
        _workers[value["name"]] = Pieces(value)
    return _workers[value["name"]]


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>), n_pieces and decoded (the text made of the ids again); columns of these names are replaced."""
    docs = docs.drop("ids", "n_pieces", "decoded")
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = b.column(text_col).to_pylist()
                ids = list(own.encode_all(texts))
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                cols = {n: b.column(n) for n in b.schema.names} | {
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    "n_pieces": pa.array(np.diff(ends), pa.int64()),
                    "decoded": pa.array([None if t is None else own.decode(i.tolist()) for t, i in zip(texts, ids, strict=True)], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(cols)

    return docs.mapInArrow(run, f"{schema}, ids array<int>, n_pieces long, decoded string")


def decode(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with text, decoded from ``ids_col``; null ids give a null text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    @F.pandas_udf("string")
    def text(ids):
        own = _worker(model)
        return ids.map(lambda i: None if i is None else own.decode(i.tolist()))

    return encoded.withColumn("text", text(ids_col))
