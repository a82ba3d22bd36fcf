"""Language identification by segmentation-marginalised unigrams (operator 3).

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, by the forward algorithm; a text's score in a language is the sum of the
logarithms over its words, and the posterior over the languages is what is returned.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, small_batches, text_slices, with_fields
from tidemark.llm.pieces import SPACE, codes_of, lattice, marginals, parts_of, vocabulary
from tidemark.llm.words import WordRows

#: At most about so many documents of a language are learnt from; they are drawn by a hash of their id.
TRAIN_DOCS = 3000
#: Words of a language are as likely to have an unseen piece as if each piece had been seen so often.
SMOOTH = 0.1
#: What characters in no piece add, in any language.
UNKNOWN_LOG = -20.0
#: Longer runs of letters are scored in parts of this length.
LONGEST_WORD = 64

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters; long runs in parts."""
    words = _LETTERS.findall(text.lower())
    if len(text) > LONGEST_WORD and max(map(len, words), default=0) > LONGEST_WORD:
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def has_letter(text: str) -> bool:
    return re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text))


def expected_counts(vocab, words: list[str], times: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words (each taken so many times), over all segmentations."""
    flat_all, lengths = codes_of(words)
    starts, out = np.cumsum(lengths) - lengths, np.zeros(vocab.size)
    for part in parts_of(lengths, 40_000):
        n = lengths[part]
        flat = flat_all[np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        piece_at = vocab.pieces_at(flat, n)
        edge = lattice(vocab, piece_at, logs, UNKNOWN_LOG)
        first, top, lanes = np.cumsum(n) - n, int(n[0]), np.arange(len(part))
        alpha, beta = (np.full((top + 1, len(part)), -np.inf) for _ in range(2))
        alpha[0] = 0
        for t in range(1, top + 1):
            live = int(np.searchsorted(-n, -t, side="right"))
            terms = np.stack([alpha[t - k, :live] + edge[k - 1, first[:live] + t - k] for k in range(1, min(t, vocab.longest) + 1)])
            alpha[t, :live] = np.logaddexp.reduce(terms, axis=0)
        beta[n, lanes] = 0
        for t in range(top - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))  # strings longer than t
            terms = np.stack([beta[t + k, :live] + edge[k - 1, first[:live] + t] for k in range(1, min(vocab.longest, top - t) + 1)])
            beta[t, :live] = np.logaddexp.reduce(terms, axis=0)
        whole, weight = alpha[n, lanes], times[part].astype(float)
        lane = np.repeat(lanes, n)
        place = np.arange(len(flat)) - first[lane]
        for k in range(1, vocab.longest + 1):
            at = np.flatnonzero(piece_at[k - 1] >= 0)
            who, piece = lane[at], piece_at[k - 1, at]
            p = np.exp(alpha[place[at], who] + edge[k - 1, at] + beta[place[at] + k, who] - whole[who])
            np.add.at(out, piece, p * weight[who])
    return out


def train(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> dict:
    """Piece log probabilities of each language, from about `most` of its documents at most.

    Documents without text or language teach nothing. What reaches the driver is a count by language and piece, so
    its size is bounded by the vocabulary, not by the documents.
    """
    small_batches(docs.sparkSession)
    ready = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in ready.groupBy(lang_col).count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, most / n))).otherwise(share)
    picked = ready.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        even = np.log(np.full(vocab.size, 1.0 / vocab.size))
        seen: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, words in seen.items():
                got = expected_counts(vocab, [SPACE + w for w in words], np.fromiter(words.values(), np.int64), even)
                sums[lang] = sums.get(lang, 0) + got
            seen.clear()

        for batch, texts in text_slices(batches, 0):
            for lang, text in zip(batch.column(1).to_pylist(), texts):
                seen.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, seen.values())) > 200_000:
                settle()
        settle()
        for lang, c in sums.items():
            k = np.flatnonzero(c > 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(c[k])], ["lang", "piece", "n"])

    rows = arrow_map(picked.select(text_col, lang_col), count, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs, vocab = sorted(sizes), vocabulary(model)
    counts = np.zeros((vocab.size, len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["piece"].to_numpy(np.int64), k] = own["n"].to_numpy()
    logs = np.log((counts + SMOOTH) / (counts + SMOOTH).sum(axis=0)) if langs else counts
    return {"langs": langs, "logs": logs.astype(np.float32), "key": uuid.uuid4().hex}


_KEPT: dict[str, WordRows] = {}


def _words(model: str, trained: dict) -> WordRows:
    """The scores of the words that this Python worker has met, for one trained model at a time."""
    if trained["key"] not in _KEPT:
        _KEPT.clear()
        vocab, logs = vocabulary(model), trained["logs"].astype(float)
        _KEPT[trained["key"]] = WordRows("language", lambda words: (marginals(vocab, [SPACE + w for w in words], logs, UNKNOWN_LOG).astype(np.float32),))
    return _KEPT[trained["key"]]


def identify(docs: DataFrame, trained: dict, model: str, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", fit_col: str | None = None) -> DataFrame:
    """The frame's columns plus lang_pred and score (posterior of that language, 0 to 1).

    fit_col: a column for the mean log probability of a letter in that language (null for `und`), if it is wanted.

    `und` with score 0 for null texts and texts without a letter, and for all if no language was learnt. Ties go to
    the first language by name. Rows stay one to one; columns that have the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop(pred_col, score_col, *([fit_col] if fit_col else []))
    names = kept.columns
    place = names.index(text_col)
    added = {pred_col: "string", score_col: "double"} | ({fit_col: "double"} if fit_col else {})
    sent = spark.sparkContext.broadcast(trained)  # languages x pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value["langs"], _words(model, sent.value)
        for batch, texts in text_slices(batches, place):
            words = [letter_words(t) for t in texts] if langs else [[] for _ in texts]
            ends = np.cumsum([len(w) for w in words])
            totals = np.zeros((len(texts), max(1, len(langs))))
            rows = table.rows([w for ws in words for w in ws])
            if len(rows):
                sums = np.r_[np.zeros((1, len(langs))), np.cumsum(table.column(0)[rows], axis=0, dtype=float)]
                totals = sums[ends] - sums[np.r_[0, ends[:-1]]]
            best = totals.argmax(axis=1)
            posterior = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            known = np.array([len(w) > 0 and has_letter(t) for w, t in zip(words, texts)], bool)
            pred = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            more = [pa.array(pred, pa.string()), pa.array(np.where(known, posterior, 0.0))]
            if fit_col:
                letters = np.array([sum(map(len, ws)) for ws in words])
                more.append(pa.array(totals.max(axis=1) / np.maximum(1, letters), mask=~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, *((n, c.type) for n, c in zip(added, more))]))

    return arrow_map(kept, run, with_fields(kept, **added))
