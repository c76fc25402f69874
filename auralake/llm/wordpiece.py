"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, again and again, the longest piece of the
vocabulary that starts the rest of a word. The automaton counts these pieces in
one pass (Song et al., Fast WordPiece Tokenization, 2021): a trie of all
pieces, a failure link for every node, and for every link the number of pieces
that following it pops. The counts are precomputed, so no piece is ever built.

A word ends in the symbol END, as pieces of the public vocabulary that may only
close a word do. Words are runs of letters, single digits, English clitics, or
runs of other visible characters, of the NFC lower-cased text; their UTF-8 bytes
are mapped to the vocabulary's printable alphabet.

Defined results: a null or blank text has no words and no tokens. A word with a
symbol that no piece starts with counts as one unknown token, as in WordPiece.
Words and texts may have any length. Each row stands alone; rows that repeat
repeat their counts. Columns with the name of an output are replaced.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auralake.llm.session import append_columns

END = "\n"
SUFFIX = "</w>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
CACHE_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """Counts the pieces of greedy longest match in time linear in a word's length."""

    def __init__(self, pieces):
        self.goto: list[dict[str, int]] = [{}]
        final: list[bool] = [False]
        for piece in pieces:
            at = 0
            for symbol in piece:
                step = self.goto[at].get(symbol)
                if step is None:
                    step = self.goto[at][symbol] = len(self.goto)
                    self.goto.append({})
                    final.append(False)
                at = step
            if at:
                final[at] = True
        self.link = np.full(len(self.goto), -1, np.int64).tolist()
        self.pops = [0] * len(self.goto)
        # Breadth first: the link of a child follows from its parent's.
        row = [(0, symbol, child) for symbol, child in self.goto[0].items()]
        while row:
            after = []
            for parent, symbol, node in row:
                if final[node]:
                    self.link[node], self.pops[node] = 0, 1
                else:
                    back, popped = self.link[parent], self.pops[parent]
                    while back >= 0 and symbol not in self.goto[back]:
                        popped += self.pops[back]
                        back = self.link[back]
                    if back >= 0:
                        self.link[node], self.pops[node] = self.goto[back][symbol], popped
                after += [(node, s, c) for s, c in self.goto[node].items()]
            row = after

    def count(self, word: str) -> int | None:
        """Pieces of ``word``; None if greedy matching gets stuck."""
        goto, link, pops, at, found = self.goto, self.link, self.pops, 0, 0
        for symbol in word:
            step = goto[at].get(symbol)
            while step is None:
                found += pops[at]
                at = link[at]
                if at < 0:
                    return None
                step = goto[at].get(symbol)
            at = step
        while at > 0:
            found += pops[at]
            at = link[at]
        return found if at == 0 else None


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces, their end-of-word mark as one symbol."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return [p[: -len(SUFFIX)] + END if p.endswith(SUFFIX) and p != SUFFIX else p for p in vocabulary]


class Counter:
    """Counts words and pieces of texts; remembers words up to a bound."""

    def __init__(self, pieces):
        self.automaton, self.seen = Automaton(pieces), {}
        self.letters = byte_alphabet()

    def of_word(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            spelled = "".join([self.letters[b] for b in word.encode("utf-8", "replace")]) + END
            found = self.automaton.count(spelled)
            found = 1 if found is None else found
            if len(word) <= 64:
                self.seen[word] = found
        return found

    def of_text(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        words = WORDS.findall(unicodedata.normalize("NFC", text).lower())
        seen = self.seen
        try:
            return len(words), sum([seen[w] for w in words])
        except KeyError:
            return len(words), sum(map(self.of_word, words))


@functools.cache
def counter(path: str) -> Counter:
    """One per Python worker, which keeps the automaton and what it has counted from task to task."""
    return Counter(load_pieces(path))


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add n_words and n_tokens. ``vocabulary``: path of a tokenizer file on every executor."""

    def start():
        own = counter(vocabulary or public_tokenizers.path("word_bpe_49k.json"))

        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [own.of_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            return [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]

        return of

    return append_columns(df, [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], start)


def op4_wordpiece_counts(spark, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_words", "n_tokens")
