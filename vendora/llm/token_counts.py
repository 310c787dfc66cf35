"""Word-piece token counts by a linear longest-match automaton (LinMaxMatch; Song et al., 2021).

A trie of the vocabulary with failure links: when no child fits, the link leads to the
node of what is left after the longest tokens at its front are taken off, and each
link carries the number of tokens taken off.  One pass over a word adds these numbers
up; no piece is built.  A word that greedy matching can't cover counts as one unknown
token.  Words are what str.split() gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vendora.llm.store import lean

MEMO_LIMIT = 400_000
_NONE = -1


class LongestMatch:
    """initial: pieces that start a word; later: pieces that go on within one (without a prefix)."""

    def __init__(self, initial: Iterable[str], later: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: within a word
        token = [False, False]
        for root, pieces in ((0, initial), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = len(self.children)
                        self.children[node][c] = nxt
                        self.children.append({})
                        token.append(False)
                    node = nxt
                token[node] |= node > 1
        self.link = [_NONE] * len(self.children)
        self.taken = [0] * len(self.children)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.children[node].items():
                    if token[child]:
                        self.link[child], self.taken[child] = 1, 1
                    else:
                        at, n = self.link[node], self.taken[node]
                        while at != _NONE and c not in self.children[at]:
                            n += self.taken[at]
                            at = self.link[at]
                        if at != _NONE:
                            self.link[child], self.taken[child] = self.children[at][c], n
                    below.append(child)
            level = below

    def count(self, word: str) -> int:
        """Number of pieces; 1 if the word can't be covered, 0 if it is empty."""
        if not word:
            return 0
        children, link, taken = self.children, self.link, self.taken
        node = total = 0
        for c in word:
            nxt = children[node].get(c)
            while nxt is None:
                total += taken[node]
                node = link[node]
                if node == _NONE:
                    return 1
                nxt = children[node].get(c)
            node = nxt
        while node != 1:
            total += taken[node]
            node = link[node]
            if node == _NONE:
                return 1
        return total


def pieces_of_model(model: bytes) -> tuple[list[str], list[str]]:
    """Word-initial and later pieces of a SentencePiece vocabulary: those with and without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    normal = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return [p[1:] for p in normal if p[0] == "▁" and len(p) > 1], [p for p in normal if p[0] != "▁"]


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        out = self.automaton.count(word)
        if len(word) <= 48:
            self[word] = out
        return out


def count_tokens(docs: DataFrame, initial: list[str], later: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text, in one narrow pass.

    Null and empty texts have none.  Repeated rows give repeated rows; other columns of
    docs are ignored.  The vocabulary is sent to the executors; its size does not
    depend on the documents.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    shipped = docs.sparkSession.sparkContext.broadcast((initial, later))
    held: dict[str, _Memo] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["memo"] = _Memo(LongestMatch(*shipped.value))
        memo = held["memo"]
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").split()
                n_words.append(len(found))
                n_tokens.append(sum([memo[w] for w in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lean(run), "doc_id bigint, n_words bigint, n_tokens bigint")
