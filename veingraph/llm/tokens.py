"""Token counts of a unigram vocabulary by a Viterbi search that keeps counts only."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import table

#: The vocabulary file; any SentencePiece model's pieces and scores will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed value: what an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Counts of so many distinct words are remembered by a worker before it starts anew.
REMEMBERED = 300_000

# Workers get this module's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    unknown: int = 0
    byte_fallback: bool = True


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The pieces and scores of a SentencePiece file, taken as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = tuple(model.id_to_piece(i) for i in ids)
    fallback = all(f"<0x{b:02X}>" in set(pieces[:300]) for b in range(256))
    return Vocabulary(pieces, tuple(model.get_score(i) for i in ids), model.unk_id(), fallback)


def token_counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """A function from a text to its number of tokens.

    The text gets a leading space mark and its spaces become marks. The automaton lists every piece that
    ends at a place, longest first; the best score and the count of its path are kept for each place. As in
    the tokenizer, a later start must be strictly better to win, a character that is no piece of its own may
    be unknown at the worst score less ``UNKNOWN_PENALTY``, and unknown characters become their UTF-8 bytes
    (without byte pieces: neighbouring ones become one token).

    No piece crosses from another character to a space mark, nor holds a line break, if the vocabulary is
    split by words; with whole-number scores, whose sums are exact, words can then be counted one by one
    and remembered. Other vocabularies are searched over the whole text at once.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in zip(vocabulary.pieces, vocabulary.scores):
        if piece:
            automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown_score = min(vocabulary.scores) - UNKNOWN_PENALTY
    single = {p for p in vocabulary.pieces if len(p) == 1}
    by_bytes = vocabulary.byte_fallback

    def count(text: str) -> int:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        size = [0] * (n + 1)
        open_unknown = [False] * (n + 1)
        matches = automaton.iter(text)
        following = next(matches, None)
        for end in range(1, n + 1):
            top = None
            pieces, unknown = 0, False
            while following is not None and following[0] == end - 1:
                length, score = following[1]
                start = end - length
                candidate = best[start] + score
                if top is None or candidate > top:
                    top, pieces = candidate, size[start] + 1
                following = next(matches, None)
            char = text[end - 1]
            if char not in single:
                candidate = best[end - 1] + unknown_score
                if top is None or candidate > top:
                    top, unknown = candidate, True
                    if by_bytes:
                        pieces = size[end - 1] + len(char.encode("utf-8", "surrogatepass"))
                    else:
                        pieces = size[end - 1] + (not open_unknown[end - 1])
            best[end], size[end], open_unknown[end] = top, pieces, unknown
        return size[n]

    crossing = any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in vocabulary.pieces)
    exact = all(float(s).is_integer() for s in vocabulary.scores)
    marked = lambda text: (SPACE if not text.startswith((SPACE, " ")) else "") + text.replace(" ", SPACE)
    if crossing or not exact or not by_bytes:
        return lambda text: count(marked(text)) if text else 0

    class Remembered(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n = count(word)
            return n

    units = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
    lengths = Remembered().__getitem__
    return lambda text: sum(map(lengths, units(marked(text)))) if text else 0


def _worker_counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """The worker's counter, made once per process and vocabulary."""
    store = sys.modules.setdefault("_veingraph_token_counters", types.ModuleType("_veingraph_token_counters"))
    key = hash(vocabulary)
    if key not in store.__dict__.setdefault("made", {}):
        store.made[key] = token_counter(vocabulary)
    return store.made[key]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ``n_tokens``: 0 for null and empty texts; all rows and columns stay (an ``n_tokens`` is replaced).

    The vocabulary is sent once to each executor; its size does not depend on the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _worker_counter(shared.value)
        for texts in batches:
            yield pd.Series([counter(t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", tokens(F.col("text")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    counted = count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())
    return counted.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")
