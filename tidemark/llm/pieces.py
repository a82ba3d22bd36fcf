"""A public SentencePiece vocabulary as numpy tables, and lattice algorithms over many strings at once.

The strings of a batch lie end to end in one array of characters. Edges of the lattice (pieces that match at a
position) come from walking a trie from all positions together; best paths and sums over paths then go over the
strings position by position, all strings together.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: SentencePiece's own constants: the mark for a space, and what an unknown character costs beyond the worst piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0

_RUNS = re.compile(r"\n| *[^ \n]+| +")


def split_words(text: str) -> list[str]:
    """Cut a text where no piece can join: before each run of spaces and around line ends.

    A word stands for itself if it starts with a line end and for a space plus itself otherwise, which is what
    the marker put before each text gives; the mark itself in a text is as good as a space. Texts with runs of spaces take the second, slower way, where words
    keep all but one of their spaces.
    """
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " not in text and " \n" not in text and "\n " not in text and text[:1] not in (" ", "\n") and text[-1:] != " ":
        return text.replace("\n", " \n").split(" ") if text else []
    words: list[str] = []
    for run in _RUNS.findall(" " + text if text else ""):
        if run[0] == " ":
            words.append(run[1:])
        elif run == "\n":
            words.append(run)
        else:  # without a space before it, so right after a line end
            words[-1] += run
    return words


def marked(word: str) -> str:
    """The characters that a word of split_words stands for."""
    return word.replace(" ", SPACE) if word.startswith("\n") else SPACE + word.replace(" ", SPACE)


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and the words' lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


class Vocabulary:
    """Pieces of a model file. Symbols are its pieces and, after them, characters that only occur inside pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("ﬁ  A ") != "▁ﬁ▁▁A▁":
            raise ValueError("only models with an identity normaliser, a leading marker and kept spaces")
        self.size = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        self.pieces: list[str | None] = [None] * self.size
        self.scores = np.zeros(self.size)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[i], self.scores[i] = sp.id_to_piece(i), sp.get_score(i)
        self.ids = {p: i for i, p in enumerate(self.pieces) if p is not None}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a space; words would not be independent")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, self.size + len(self.symbols) - len(self.ids))
        #: Symbol of each code point; -1 for characters in no piece.
        self.of_code = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self._trie()

    def _trie(self) -> None:
        nodes, edges = {"": 0}, {}
        for p in self.ids:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    edges[nodes[p[: n - 1]] << 21 | ord(p[n - 1])] = nodes[p[:n]]
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.edges = PairTable(self.edge_keys)
        self.node_piece = np.full(len(nodes), -1, np.int64)
        for p, i in self.ids.items():
            self.node_piece[nodes[p]] = i
        #: The first step of the walk is a table by code point.
        self.first = np.full(0x110000, -1, np.int32)
        for p, k in nodes.items():
            if len(p) == 1:
                self.first[ord(p)] = k

    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted keys left * width + right of all pairs of symbols that make a piece, its rank and its id."""
        width, found = self.size + len(self.symbols), {}
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        for p, i in self.ids.items():
            for n in range(1, len(p)):
                if (a := self.symbols.get(p[:n])) is not None and (b := self.symbols.get(p[n:])) is not None:
                    found[a * width + b] = i
        keys = np.array(sorted(found), np.int64)
        ids = np.array([found[k] for k in keys.tolist()], np.int64)
        return keys, np.array([order[self.scores[i]] for i in ids.tolist()], np.int64), ids, width

    def pieces_at(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[n-1, position]: id of the piece of n characters that starts there inside its string; -1 if none does."""
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
        out = np.full((self.longest, len(flat)), -1, np.int32)
        node = self.first[flat].astype(np.int64)
        at = np.flatnonzero(node >= 0)
        node = node[at]
        for n in range(1, self.longest + 1):
            if n > 1:
                room = left[at] >= n
                at, node = at[room], node[room]
                k = self.edges.rows(node << 21 | flat[at + n - 1])
                ok = k >= 0
                at, node = at[ok], self.edge_to[k[ok]]
            out[n - 1, at] = self.node_piece[node]
        return out


class PairTable:
    """Numbers to rows 0, 1, ...: an open hash table that looks up many at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.key, self.row = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[slot] == -1
            won, first = np.unique(slot[free], return_index=True)
            mine = todo[free][first]
            self.key[won], self.row[won] = keys[mine], mine
            left = ~np.isin(todo, mine)
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each number; -1 for those that aren't in the table."""
        slot = self._slot(keys)
        there = self.key[slot]
        found = np.where(there == keys, self.row[slot], -1)
        at = np.flatnonzero((there != keys) & (there != -1))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            there = self.key[slot]
            hit = there == keys[at]
            found[at[hit]] = self.row[slot[hit]]
            more = ~hit & (there != -1)
            at, slot = at[more], slot[more]
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The tables of a model file, built once in a Python worker."""
    return Vocabulary(path)


def lattice(vocab: Vocabulary, piece_at: np.ndarray, scores: np.ndarray, unknown: float) -> np.ndarray:
    """edge[n-1, position(, k)]: score of the piece of n characters starting there; -inf if there is none.

    scores: by piece id, with a second axis if there are several sets of scores. Where no piece of one character
    starts, an edge of one character has the score `unknown`.
    """
    none = np.full((1, *scores.shape[1:]), -np.inf)
    edge = np.concatenate([scores, none])[piece_at]
    edge[0, piece_at[0] < 0] = unknown
    return edge


def parts_of(lengths: np.ndarray, together: int) -> list[np.ndarray]:
    """Strings in groups of about `together` characters, the longest of all first: positions in `lengths`."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    group = np.cumsum(lengths[order]) // together
    return np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []


def marginals(vocab: Vocabulary, words: list[str], logs: np.ndarray, unknown: float, together: int = 40_000) -> np.ndarray:
    """log of the sum over all segmentations of the product of piece probabilities, [string, language].

    logs: log probability by piece id and language.
    """
    flat_all, lengths = codes_of(words)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((len(words), logs.shape[1]))
    for part in parts_of(lengths, together):
        n = lengths[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        edge = lattice(vocab, vocab.pieces_at(flat_all[at], n), logs, unknown)
        first = np.cumsum(n) - n
        alpha = np.full((int(n[0]) + 1, len(part), logs.shape[1]), -np.inf)
        alpha[0] = 0
        for t in range(1, int(n[0]) + 1):
            live = int(np.searchsorted(-n, -t, side="right"))  # the strings that reach t; longer ones come first
            back = range(1, min(t, vocab.longest) + 1)
            terms = np.stack([alpha[t - k, :live] + edge[k - 1, first[:live] + t - k] for k in back])
            most = terms.max(axis=0)
            alpha[t, :live] = most + np.log(np.exp(terms - most).sum(axis=0))
        out[part] = alpha[n, np.arange(len(part))]
    return out


def best_paths(vocab: Vocabulary, lengths: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus: the pieces of the best path of each string (how many, and their lengths in order, end to end).

    The strings must be in order of falling length. Of equal paths, the one whose last piece is longest wins.
    """
    n, first = lengths, np.cumsum(lengths) - lengths
    best = np.full((int(n[0]) + 1, len(n)), -np.inf)
    took = np.zeros((int(n[0]) + 1, len(n)), np.int8)
    best[0] = 0
    for t in range(1, int(n[0]) + 1):
        live = int(np.searchsorted(-n, -t, side="right"))
        value, chosen = np.full(live, -np.inf), np.zeros(live, np.int8)
        for k in range(min(t, vocab.longest), 0, -1):
            other = best[t - k, :live] + edge[k - 1, first[:live] + t - k]
            better = other > value
            value, chosen = np.where(better, other, value), np.where(better, k, chosen)
        best[t, :live], took[t, :live] = value, chosen
    return traced(took, n, np.zeros(len(n), np.int64))


def traced(took: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk back from `ends` to `begins` in all strings together: (how many pieces, their lengths in order)."""
    at, strings, steps = ends.copy(), np.arange(len(ends)), []
    while len(strings := strings[at[strings] > begins[strings]]):
        k = took[at[strings], strings].astype(np.int64)
        steps.append((strings, k))
        at[strings] -= k
    if not steps:
        return np.zeros(len(ends), np.int64), np.zeros(0, np.int64)
    who, sizes = (np.concatenate(c) for c in zip(*reversed(steps)))
    order = np.argsort(who, kind="stable")
    return np.bincount(who, minlength=len(ends)), sizes[order]
