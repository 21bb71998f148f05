"""Operator 9, token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece in a word; dynamic programming keeps, for each end,
the best score, its piece count and whether it ends in an unknown piece, and never the pieces. Rules are those
of the `tokenizers` unigram model: the best sum of scores wins; at a tie the path found first, that is with
the last piece that starts earlier, stays; a character without a piece of its own may be unknown at the lowest
score less 10; neighbouring unknowns are one piece; an unknown is written as its UTF-8 bytes where the vocabulary
has byte pieces. Text is cut before each space as `▁`, one more is put at its start, and words are counted
once each and remembered up to a limit.

Nulls: a null or empty text has 0 tokens and score 0. Repeated rows are counted alike; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import keep_alive, kept, vocabulary

UNKNOWN_PENALTY, SPACE, WORD_LIMIT = 10.0, "▁", 300_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class ViterbiCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = {p for p, _ in pieces} >= {f"<0x{b:02X}>" for b in range(256)}
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path through a word."""
        n, at, best, pieces, single, unk = len(word), 1, None, 0, False, self.unknown
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)

        def close() -> None:
            """All matches that end at `at` are known: try the unknown character last, then fix the best."""
            if not single:
                total = score[at - 1] + unk
                if best is None or total > best:
                    more = len(word[at - 1].encode(errors="surrogatepass")) if self.bytes else 0 if unknown[at - 1] else 1
                    score[at], count[at], unknown[at] = total, count[at - 1] + more, True
                    return
            score[at], count[at] = best, pieces

        # matches come by end, the longest first: a tie keeps the earlier start
        for last, (length, s) in self.machine.iter(word):
            while at <= last:
                close()
                at, best, single = at + 1, None, False
            total = score[at - length] + s
            if best is None or total > best:
                best, pieces = total, count[at - length] + 1
            if length == 1:
                single = True
        while at <= n:
            close()
            at, best, single = at + 1, None, False
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, int, float]:
        """(words, pieces, score) of a text."""
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        tokens, total, memo = 0, 0.0, self.memo
        for w in words:
            got = memo.get(w)
            if got is None:
                if len(memo) >= WORD_LIMIT:  # words used lately stay
                    self.old, self.memo = memo, {}
                    memo = self.memo
                got = self.old.get(w) or self.word(SPACE + w)
                memo[w] = got
            tokens += got[0]
            total += got[1]
        return len(words), tokens, total


def count_tokens(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, score) of every text."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept((path, "counts"), lambda: ViterbiCounter(load_pieces(path)))
        for batch in batches:
            keep_alive()
            got = [counter.text(t or "") for t in batch.column(1).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "n_words", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"`{id_col}` long, n_words long, n_tokens long, score double")


def op9_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_viterbi_token_counts": op9_viterbi_token_counts}
