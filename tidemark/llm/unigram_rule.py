"""The unigram rule: the path of the highest sum of piece scores, for strings whole and in chunks."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import ragged
from tidemark.llm.pieces import SPACE, best_paths, codes_of, lattice, marked, parts_of, split_words, traced, vocabulary
from tidemark.llm.words import WordLists

#: Bytes of words that a worker keeps; the arrays and the dictionary take up to twice as much.
KEPT = 12 << 20


class Sums:
    """Max-plus matrices of the unigram rule; a state is how many characters are covered beyond a border."""

    def __init__(self, longest: int):
        self.longest = longest

    def load(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data).reshape(self.longest, self.longest)

    def covered(self, state: int) -> int:
        return state

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, :, None] + b[None, :, :]).max(axis=1)

    def states(self, matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
        """The states at all borders of a row of matrices on the best path from `entry` to `leave`."""
        value = np.full(len(matrices[0]), -np.inf)
        value[entry] = 0
        forward = [value]
        for m in matrices:
            forward.append((forward[-1][:, None] + m).max(axis=0))
        out = [leave]
        for v, m in zip(reversed(forward[:-1]), reversed(matrices)):
            out.append(int((v + m[:, out[-1]]).argmax()))
        return out[::-1]


class Coder:
    """Encodes words and parts of words with one model by the unigram rule; keeps the distinct words."""

    def __init__(self, path: str):
        self.vocab = v = vocabulary(path)
        self.words = WordLists("sentencepiece", lambda words: self.solve([marked(w) for w in words]), KEPT)
        #: What each id stands for in a text.
        self.bytes = [b""] * v.size
        for p, i in v.ids.items():
            self.bytes[i] = p.encode("utf-8", "surrogatepass")
        for b, i in enumerate(v.byte_ids.tolist()):
            if i >= 0:
                self.bytes[i] = bytes([b])
        self.byte_len = np.fromiter(map(len, self.bytes), np.int64, v.size)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.score = v.scores

    def algebra(self) -> Sums:
        return Sums(self.vocab.longest)

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths of strings: how many each, and the ids end to end."""
        flat, lengths = codes_of(words)
        starts, found = np.cumsum(lengths) - lengths, []
        for part in parts_of(lengths, 60_000):
            n = lengths[part]
            own = flat[ragged(starts[part], n)]
            piece_at = self.vocab.pieces_at(own, n)
            pieces, sizes = best_paths(self.vocab, n, lattice(self.vocab, piece_at, self.vocab.scores, self.vocab.unknown))
            found.append((part, *self.ids(own, n, piece_at, pieces, sizes)))
        counts = np.zeros(len(words), np.int64)
        for part, k, _ in found:
            counts[part] = k
        at, ids = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
        for part, k, own in found:
            ids[ragged(at[part], k)] = own
        return counts, ids

    def ids(self, flat: np.ndarray, lengths: np.ndarray, piece_at: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of paths given as lengths of pieces; unknown characters give the ids of their bytes."""
        starts = np.cumsum(lengths) - lengths
        ends = np.cumsum(sizes)
        string = np.repeat(np.arange(len(lengths)), pieces)
        used = np.r_[0, ends][np.r_[0, np.cumsum(pieces)[:-1]]] if len(pieces) else ends
        at = starts[string] + (ends - sizes) - used[string]
        ids = piece_at[sizes - 1, at].astype(np.int64)
        if (ids >= 0).all():
            return pieces, ids
        count, lists = np.ones(len(ids), np.int64), {}
        for k in np.flatnonzero(ids < 0).tolist():
            lists[k] = self.vocab.byte_ids[list(chr(flat[at[k]]).encode("utf-8", "surrogatepass"))]
            count[k] = len(lists[k])
        where, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        out[where[ids >= 0]] = ids[ids >= 0]
        for k, own in lists.items():
            out[where[k] : where[k] + len(own)] = own
        return np.bincount(string, weights=count, minlength=len(pieces)).astype(np.int64), out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [split_words(t) for t in texts]
        n, starts, flat = self.words.gather([w for ws in words for w in ws])
        sums = np.r_[0, np.cumsum(n)]
        ends = np.cumsum([len(ws) for ws in words])
        return sums[ends] - sums[np.r_[0, ends[:-1]]], flat[ragged(starts, n)]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes of the ids end to end, marks for spaces."""
        return self.byte_flat[ragged(self.byte_at[ids], self.byte_len[ids])]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; the marker before the text goes, and bytes that are no UTF-8 give U+FFFD."""
        text = self.raw(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def gives_back(self, n: np.ndarray, ids: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the ids of each text (n of them each) decode to it."""
        sizes = np.r_[0, np.cumsum(self.byte_len[ids])]
        ends = np.cumsum(n)
        own = sizes[ends] - sizes[ends - n]
        want = [(SPACE + t).replace(" ", SPACE).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.fromiter(map(len, want), np.int64, len(want))
        good = own == size
        if not good.all():
            return np.array([self.raw(ids[b - k : b]).tobytes() == w for b, k, w in zip(ends.tolist(), n.tolist(), want)], bool)
        wrong = np.r_[0, np.cumsum(self.raw(ids) != np.frombuffer(b"".join(want), np.uint8))]
        at = np.cumsum(size)
        return wrong[at] == wrong[at - size]

    # --- chunks: `chunk` holds its own characters and, after them, up to longest - 1 of the next chunk ---

    def _paths(self, flat: np.ndarray, entries: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """best[t, entry] of reaching t from each entry by pieces that start before `inside`, and the last piece's length."""
        edge = lattice(self.vocab, self.vocab.pieces_at(flat, np.array([len(flat)])), self.vocab.scores, self.vocab.unknown)
        best = np.full((len(flat) + 1, len(entries)), -np.inf)
        took = np.zeros((len(flat) + 1, len(entries)), np.int8)
        best[entries[entries <= len(flat)], np.flatnonzero(entries <= len(flat))] = 0
        for t in range(1, len(flat) + 1):
            for k in range(min(t, self.vocab.longest), max(1, t - inside + 1) - 1, -1):
                if edge[k - 1, t - k] > -np.inf:
                    other = best[t - k] + edge[k - 1, t - k]
                    better = other > best[t]
                    best[t, better], took[t, better] = other[better], k
        return best, took

    def _cut(self, chunk: str, inside: int) -> tuple[int, int]:
        """First and last place inside the chunk where a path must stop: before a mark that follows something else."""
        places = [i for i in (chunk.find(SPACE, 1), chunk.rfind(SPACE, 1, inside)) if 0 < i < inside]
        if not places:
            return -1, -1
        first, last = places[0], places[-1]
        while first < inside and chunk[first - 1] == SPACE:
            first = chunk.find(SPACE, first + 1) if 0 < chunk.find(SPACE, first + 1) < inside else inside
        while last > 0 and chunk[last - 1] == SPACE:
            last -= 1
        return (first, last) if 0 < first <= last < inside else (-1, -1)

    def matrix(self, before: str, chunk: str, inside: int, is_first: bool) -> np.ndarray:
        """[covered at the start, covered beyond the end]: the best score of the pieces that start in the chunk."""
        n = self.vocab.longest
        flat = codes_of([chunk])[0]
        entries = np.arange(n)
        first, last = self._cut(chunk, inside)
        out = np.full((n, n), -np.inf)
        if first < 0:
            best = self._paths(flat, entries, inside)[0][inside:]
            out[:, : len(best)] = best.T[:, :n]
            return out
        head = self._paths(flat[:first], entries, first)[0][first]
        tail = self._paths(flat[last:], np.zeros(1, np.int64), inside - last)[0][inside - last :, 0]
        _, ids = self._middle(chunk, first, last)
        out[:, : len(tail)] = (head + self.score[ids].sum())[:, None] + tail[None, :n]
        return out

    def _middle(self, chunk: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        return self.encode([chunk[first + 1 : last]]) if last > first else (np.zeros(1, np.int64), np.zeros(0, np.int64))

    def trace(self, before: str, chunk: str, inside: int, entry: int, leave: int) -> np.ndarray:
        """Ids of the pieces that start in the chunk, on the best path between the given states."""
        flat = codes_of([chunk])[0]
        first, last = self._cut(chunk, inside)

        def part(own: np.ndarray, begin: int, end: int, within: int) -> np.ndarray:
            _, took = self._paths(own, np.array([begin]), within)
            k, sizes = traced(took, np.array([end]), np.array([begin]))
            own, n = own[begin:end], np.array([end - begin])
            return self.ids(own, n, self.vocab.pieces_at(own, n), k, sizes)[1]

        if first < 0:
            return part(flat, entry, inside + leave, inside)
        return np.r_[part(flat[:first], entry, first, first), self._middle(chunk, first, last)[1], part(flat[last:], 0, inside - last + leave, inside - last)]
