"""Token counts of a unigram vocabulary, without making tokens.

Aho-Corasick lists the vocabulary pieces that end at each character; dynamic programming carries the best score and,
beside it, the number of tokens on that path. Rules are those of the unigram model of the tokenizers library with
Metaspace words and byte fallback: among equal scores the earliest start wins, a character that is no piece itself may
be an unknown at the lowest score less ten, and an unknown counts one token per UTF-8 byte.

Words are independent, so each distinct word is solved once per worker, in a cache of at most ``MAX_WORDS`` words of at most
``LONGEST`` characters; longer ones are solved each time.

Cases: a null or empty text has no tokens and no characters; repeated rows are counted each; an empty table gives an empty result; a
column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_texts, replace_column, slices, table
from tessera.llm.tokens import tokenizer_path

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the unigram model
MAX_WORDS, LONGEST = 1_000_000, 64  # of the cache: words, and characters of one


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def solve(self, word: str) -> tuple[int, float]:
        """Tokens on the best path of a word, and the path's score."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done = 0
        single, unknown = self.single, self.unknown

        def close(end: int) -> None:  # the last candidate of an end: its single character as an unknown
            if word[end - 1] not in single:
                score = best[end - 1] + unknown
                if best[end] is None or score > best[end]:
                    best[end], count[end] = score, count[end - 1] + len(word[end - 1].encode())

        for last, (size, piece_score) in self.found.iter(word):
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            start = best[end - size]  # every start is reachable: each character is a piece or an unknown
            score = start + piece_score
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - size] + 1
        while done < n:
            done += 1
            close(done)
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        known, tokens, score = self.known, 0, 0.0
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.solve(SPACE + w)
                if len(w) <= LONGEST:
                    if len(known) >= MAX_WORDS:
                        known.clear()
                    known[w] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, *, path: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``best_score``; one narrow pass."""
    out = docs.drop("n_tokens", "best_score")
    fields = [f for f in out.schema.fields if not (drop_text and f.name == text)]
    place = out.columns.index(text)
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches, place):
            got = [count(t) for t in batch.column(place).to_pylist()]
            batch = replace_column(batch, "n_tokens", pa.array(np.array([g[0] for g in got], np.int64)))
            batch = replace_column(batch, "best_score", pa.array(np.array([g[1] for g in got], np.float64)))
            yield batch.drop_columns([text]) if drop_text else batch

    return map_texts(out, run, schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"), "text")
    return count_tokens(docs, path=tokenizer_path("piece_bpe_32k.model"), drop_text=True)
