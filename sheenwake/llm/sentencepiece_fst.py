"""SentencePiece encoding and decoding as weighted transducers (operator 7).

``Pieces`` compiles a model file into three transducers over characters:

* the normaliser: a space becomes U+2581 and one more is put in front of a text;
* the piece transducer: a trie whose final states emit a piece, with weight minus its score;
* byte fallback: a character that no piece holds emits the bytes of its UTF-8 form.

An input is composed with them into a lattice whose arcs are pieces, and the answer is its shortest
path in the tropical semiring (smallest sum of weights). In a model of the unigram kind that is the
whole of it. A model of the BPE kind admits an arc after another only when the merges of the two pieces
side by side yield these two pieces; a known property of BPE is that one path of the lattice then
remains, the one that merging would give, so shortest path and merge order agree.

Pieces never reach over the border in front of a U+2581, nor over a character without a piece, so
texts are cut there into chunks. The lattices of all new chunks of a batch are solved side by side,
position by position, and the answers kept in a bounded table.
"""
from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, raw

SPACE = "▁"
KEPT_CHUNKS = 800_000


def model_file() -> str:
    """Where the public model file is mounted, on the driver and on executors."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A compiled model. Only the identity normaliser is supported; others raise ValueError."""

    def __init__(self, path: str | None = None):
        from sentencepiece import sentencepiece_model_pb2 as form

        model = form.ModelProto()
        with open(path or model_file(), "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only the identity normaliser with a space put in front is supported")
        self.bpe = model.trainer_spec.model_type == form.TrainerSpec.BPE
        kinds = form.ModelProto.SentencePiece
        self.texts = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.texts[i]) for i in normal):
            raise ValueError("a piece reaches over the border of a word")
        self.ids = {self.texts[i]: i for i in normal}
        self.score = np.array([p.score for p in model.pieces])
        byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.forms = [b"" if p.type == kinds.CONTROL else
                      bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else
                      p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.forms[self.unknown] = " ⁇ ".encode()
        self._compile()
        if self.bpe:
            self._order()
        self.chunks: dict[bytes, bytes] = {}
        self.pair_keys = np.full(1 << 21, -1, np.int64)
        self.pair_fits = np.zeros(1 << 21, bool)

    def _compile(self) -> None:
        """Trie of the pieces as sorted (state, character) keys; characters get small numbers."""
        self.chars = {c: k for k, c in enumerate(sorted(set("".join(self.ids))), 1)}
        width = self.width = len(self.chars) + 1
        steps: dict[int, int] = {}
        final = {0: -1}
        for text, piece in sorted(self.ids.items()):
            state = 0
            for c in text:
                state = steps.setdefault(state * width + self.chars[c], len(steps) + 1)
                final.setdefault(state, -1)
            final[state] = piece
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.final = np.array([final[s] for s in range(len(steps) + 1)], np.int64)
        self.code = np.zeros(0x110000, np.int64)
        for c, k in self.chars.items():
            self.code[ord(c)] = k
        known = "".join(map(re.escape, self.chars))
        self.cut = re.compile(f"[^{known}]|{SPACE}*[{known.replace(SPACE, '')}]+|{SPACE}+")
        self.foreign = re.compile(f"[^{known}]")

    # -- merges ---------------------------------------------------------------------------------

    def _order(self) -> None:
        """Number pieces by merge order, single characters first, and note the last merge of each.

        ``halves[n]`` are the two pieces that merge into piece n; a single character is its own halves.
        """
        texts = sorted(self.ids, key=lambda t: (len(t) > 1, -self.score[self.ids[t]]))
        number = {t: n for n, t in enumerate(texts)}
        self.number = np.full(len(self.texts), -1, np.int64)
        self.halves: list[tuple[int, int]] = []
        for n, t in enumerate(texts):
            self.number[self.ids[t]] = n
            parts = list(t)
            while len(parts) > 2:
                best = min(((number.get(parts[k] + parts[k + 1], len(texts)), k) for k in range(len(parts) - 1)))
                if best[0] >= n:
                    break
                k = best[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and all(x in number for x in parts):
                self.halves.append((number[parts[0]], number[parts[1]]))
            else:
                self.halves.append((n, n))
        self.reached = [len(t) == 1 or h != (n, n) for n, (t, h) in enumerate(zip(texts, self.halves))]
        self.whole = {h: n for n, h in enumerate(self.halves) if h != (n, n)}

    def _pair(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces next to each other as they are (-1: nothing on the left).

        The merges at the border are taken from the outermost inward: a pair of inner parts that
        would have merged before one of them was used up rules the two pieces out.
        """
        b = int(self.number[right])
        if left < 0:
            return self.reached[b]
        a = int(self.number[left])
        if not (self.reached[a] and self.reached[b]):
            return False
        before = len(self.texts)
        while True:
            if self.whole.get((a, b), before) < before:
                return False
            for left_side in ((True, False) if a > b else (False, True)):
                inner = self.halves[a][1] if left_side else self.halves[b][0]
                if inner != (a if left_side else b):
                    break
            else:
                return True
            if left_side:
                before, a = a, inner
            else:
                before, b = b + 1, inner

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether piece ``right`` may follow ``left`` (-1: start of a chunk)."""
        if not self.bpe:
            return np.ones(len(left), bool)
        key = (left + 1) * len(self.texts) + right
        slot = (key * 0x9E3779B1) & (len(self.pair_keys) - 1)
        miss = self.pair_keys[slot] != key
        if miss.any():
            out = np.empty(len(key), bool)
            out[~miss] = self.pair_fits[slot[~miss]]
            new, back = np.unique(key[miss], return_inverse=True)
            answer = np.array([self._pair(k // len(self.texts) - 1, k % len(self.texts)) for k in new.tolist()])
            out[miss] = answer[back]
            at = (new * 0x9E3779B1) & (len(self.pair_keys) - 1)
            for s, k, a in zip(at.tolist(), new.tolist(), answer.tolist()):
                self.pair_keys[s], self.pair_fits[s] = k, a
            return out
        return self.pair_fits[slot]

    # -- shortest paths ---------------------------------------------------------------------------

    def solve(self, chunks: list[str]) -> list[np.ndarray]:
        """Shortest path of each chunk (known characters alone), all lattices advanced together."""
        n, size = len(chunks), max(map(len, chunks))
        text = np.zeros((n, size + 1), np.int64)
        lengths = np.array([len(c) for c in chunks])
        flat = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(n), lengths)
        text[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = self.code[flat]
        cost = np.full((n, size + 1), np.inf)
        last, back = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int64)
        cost[:, 0] = 0
        for start in range(size):
            rows = np.flatnonzero((cost[:, start] < np.inf) & (lengths > start))
            state = np.zeros(len(rows), np.int64)
            end = start
            while len(rows) and end < size:
                key = state * self.width + text[rows, end]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                go = self.keys[at] == key
                rows, state, end = rows[go], self.next[at[go]], end + 1
                piece = self.final[state]
                emit = np.flatnonzero(piece >= 0)
                if not len(emit):
                    continue
                r, p = rows[emit], piece[emit]
                total = cost[r, start] - self.score[p]
                ok = np.flatnonzero((total < cost[r, end]) & self._fits(last[r, start], p))
                r = r[ok]
                cost[r, end], last[r, end], back[r, end] = total[ok], p[ok], start
        at, out = lengths.copy(), []
        live, steps = np.arange(n), np.zeros(n, np.int64)
        while len(live):
            out.append((live, last[live, at[live]]))
            steps[live] += 1
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        # all paths end to end, each filled from its end
        ends = np.cumsum(steps)
        flat = np.empty(int(ends[-1]), np.int32)
        for k, (rows, pieces) in enumerate(out):
            flat[ends[rows] - 1 - k] = pieces
        return [flat[a:b] for a, b in zip((ends - steps).tolist(), ends.tolist())]

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def paths(self, texts: set[str]) -> dict[str, bytes]:
        """Packed ids of chunks, those of like length solved together."""
        out, groups = {}, {}
        for c in texts:
            if len(c) == 1 and c not in self.chars:
                out[c] = array("i", [self.bytes[b] for b in c.encode("utf-8", "replace")]).tobytes()
            else:
                groups.setdefault(len(c).bit_length(), []).append(c)
        for group in groups.values():
            for k in range(0, len(group), 20_000):
                part = group[k:k + 20_000]
                for c, path in zip(part, self.solve(part)):
                    out[c] = path.tobytes()
        return out

    def learn(self, words: set[bytes]) -> None:
        """Keep the ids of words (what stands between two single spaces)."""
        if len(self.chunks) + len(words) > KEPT_CHUNKS:
            self.chunks.clear()
        cut = {w: self.cut.findall(self.normalise(w.decode("utf-8", "replace"))) for w in words}
        paths = self.paths({c for parts in cut.values() for c in parts})
        for w, parts in cut.items():
            self.chunks[w] = paths[parts[0]] if len(parts) == 1 else b"".join(map(paths.__getitem__, parts))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as packed 32-bit numbers.

        Words between single spaces are looked up; a text with runs of spaces or with U+2581 is cut as a whole.
        """
        out, open_, new = [], [], set()
        get, mark = self.chunks.get, SPACE.encode()
        for k, text in enumerate(texts):
            words = text.split(b" ")
            if not text:
                out.append(b"")
            elif b"" in words or mark in text:
                cut = self.cut.findall(self.normalise(text.decode("utf-8", "replace")))
                paths = self.paths(set(cut))
                out.append(b"".join(map(paths.__getitem__, cut)))
            else:
                found = list(map(get, words))
                if None in found:
                    new.update(w for w, f in zip(words, found) if f is None)
                    open_.append((k, words, found))
                    out.append(b"")
                else:
                    out.append(b"".join(found))
        if open_:
            self.learn(new)
            for k, words, found in open_:
                out[k] = b"".join([get(w) if f is None else f for w, f in zip(words, found)])
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; the space put in front is taken off, broken bytes become U+FFFD."""
        text = b"".join(map(self.forms.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def compiled(path: str | None) -> Pieces:
    """The model of a worker, compiled once."""
    return kept(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, text_col: str = "text", out: str = "piece_ids", path: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text (a null or empty text: no ids); ``out`` is replaced if there."""
    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        pieces, texts, parts = compiled(path), raw(text), []
        for k in range(0, len(texts), 500):
            parts += pieces.encode(texts[k:k + 500])
        ends = np.cumsum([0] + [len(p) // 4 for p in parts])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, ids_col: str = "piece_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the text of the ids; null or no ids give the empty text."""
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        pieces = compiled(path)
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        return pa.array([pieces.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())

    return docs.withColumn(out, text(F.col(ids_col)))
