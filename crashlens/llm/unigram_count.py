"""Token counts of a unigram tokenizer without making tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character;
the dynamic programme carries the best score and, instead of a path, the number of pieces on it.
Tie rules are those of the ``tokenizers`` library's Unigram model, which tests compare with: pieces
are tried by rising start, a later one wins only with a strictly larger score, a character without
a piece of its own can be unknown at the lowest score less 10, and unknown characters count as
their bytes (byte fallback). Scores add up as doubles.

A space becomes the mark U+2581, and one is put in front. Text is cut before a mark where no piece of the vocabulary can
lie across: a piece with a mark inside names the characters that can stand before it (in a run of spaces, marks
themselves), and after any other character the best path has a boundary there. So what lies between two cuts is
scored on its own, with the result of the whole text, and its count is kept for the next
occurrence; a worker keeps CACHE_WORDS.

Defined results: a null or empty text has 0 tokens; rows are counted each; null keys are carried;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without its control pieces; the unknown piece comes first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not model.is_control(i)]
    ids.sort(key=lambda i: not model.is_unknown(i))
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in ids]


class Counter(dict):
    """word (with its mark) -> number of tokens; words not seen yet are scored."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        before = {piece[i - 1] for piece, _ in pieces for i in range(1, len(piece)) if piece[i] == MARK}
        self.runs_only = before <= {MARK}  # pieces lie across marks in runs of spaces alone
        self.cut = re.compile("(?<!^)" + (f"(?<![{re.escape(''.join(sorted(before)))}])" if before else "") + f"(?={MARK})")

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.count(word)
        return n

    def count(self, word: str) -> int:
        """Pieces on the best path of ``word``."""
        n = len(word)
        best, pieces = [0.0, *[None] * n], [0] * (n + 1)
        at, alone = 0, False  # the character whose ending pieces are being read, and whether it is a piece itself
        unknown = self.unknown

        def leave(last: int) -> None:
            nonlocal at, alone
            while at < last:
                if not alone and (best[at + 1] is None or unknown + best[at] > best[at + 1]):
                    best[at + 1], pieces[at + 1] = unknown + best[at], pieces[at] + len(word[at].encode())
                at, alone = at + 1, False

        for end, (length, score) in self.automaton.iter(word):  # by end, longest (so first to start) first
            if end != at:
                leave(end)
            start = end + 1 - length
            value = score + best[start]
            top = best[end + 1]
            if top is None or value > top:
                best[end + 1], pieces[end + 1] = value, pieces[start] + 1
            if length == 1:
                alone = True
        leave(n)
        return pieces[n]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if self.runs_only and "  " not in text:  # every space is a cut
            words = text.split(" ")
            words = words[1:] if not words[0] else words  # a leading space is the mark that is put in front
            return sum(self[MARK + w] for w in words)
        text = text.replace(" ", MARK)
        return sum(self[w] for w in self.cut.split(text if text[0] == MARK else MARK + text))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens of every row; one pass, no shuffle."""
    ship(df.sparkSession)
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            for part in W.slices(batch, "text"):
                n = [own.text(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
