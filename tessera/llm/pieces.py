"""SentencePiece encoding and decoding by a Viterbi search over a trie of the distinct words.

A text is marked as SentencePiece marks it (spaces become U+2581, one more stands in front) and cut into marked words:
a run of marks and what follows it. Pieces are scored as a unigram model's: by log-probability if the vocabulary is one, and for a
merge vocabulary, whose file holds ranks only, by -log(rank + 2), Zipf's law. The best segmentation of a word maximises
the sum; a character without a piece of its own may fall back to bytes. The distinct words of a batch are sorted, which is the order of a
depth-first walk of their trie: the walk keeps what it knows of the prefix that a word shares with the one before it (forward scores, and
the place in the vocabulary's trie of the longest piece begun) and goes on from there. A place leads to the place of its longest proper suffix
where no piece goes on, and names all pieces that end there, so that a step meets no others.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a U+2581 of the text itself, which must not decode to a space: half of a surrogate pair, which no text holds.
LITERAL = "\ud800"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
#: Words whose segmentation a worker keeps at once, from task to task; it forgets them when they are more, which changes nothing but time.
KEPT_WORDS = 800_000
#: Score of a byte, below any piece's.
BYTE_SCORE = -25.0


class Vocabulary:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.strings = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        whole = all(scores[i] == int(scores[i]) for i in plain)  # ranks, not log-probabilities
        self.pieces = {self.strings[i]: (-math.log(2 - scores[i]) if whole else scores[i], i) for i in plain}
        self.bytes = {int(self.strings[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.unknown = model.unk_id()
        #: What each id decodes to; a byte is written as surrogateescape writes it, so that bytes join to characters when the text is encoded.
        plain = [bytes([self.byte_of[i]]).decode("ascii", "surrogateescape") if i in self.byte_of else "" if i in self.special else s.replace(MARK, " ") for i, s in enumerate(self.strings)]
        self.plain = np.array(plain, object)
        self.build()

    def build(self) -> None:
        #: Ids of the words met so far, as bytes of 32-bit numbers; a word's key leaves out its first mark.
        self.kept: dict[str, bytes] = {}
        #: The pieces' trie: for each node its children by character, the node of its longest proper suffix, and the pieces that end
        #: there, longest first, as (length, score, ids). Node 0 is the root.
        self.children: list[dict[str, int]] = [{}]
        self.suffix: list[int] = [0]
        self.ending: list[tuple[tuple[int, float, tuple[int, ...]], ...]] = [()]
        for piece, (score, i) in self.pieces.items():
            node = 0
            for char in piece:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.suffix.append(0)
                    self.ending.append(())
                node = self.children[node][char]
            self.ending[node] = ((len(piece), score, (i,)),)
        level = list(self.children[0].values())
        while level:  # by depth: a node's suffix is less deep
            for node in level:
                self.ending[node] += self.ending[self.suffix[node]]
                for char, child in self.children[node].items():
                    self.suffix[child] = self.step(self.suffix[node], char)
            level = [child for node in level for child in self.children[node].values()]

    def step(self, node: int, char: str) -> int:
        """The node of the longest piece begun after one more character."""
        children = self.children
        while (found := children[node].get(char)) is None and node:
            node = self.suffix[node]
        return found or 0

    def fall_back(self, char: str) -> tuple[int, float, tuple[int, ...]]:
        raw = (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")
        return 1, BYTE_SCORE * len(raw), tuple(self.bytes.get(b, self.unknown) for b in raw)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def mark(text: str) -> str:
    return MARK + text.replace(MARK, LITERAL).replace(" ", MARK) if text else ""


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first mark."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(mark(text))]


def segment(distinct: Iterable[str], vocab: Vocabulary) -> dict[str, tuple[int, ...]]:
    """The best ids of each marked word, given without its first mark and walked in sorted order; of equal sums, that whose last piece is longest.

    score[i] is the best sum of the first i characters (the mark is the first), last[i] its last piece, at[i] the node of the trie reached there.
    """
    pieces, children, suffix, ending = vocab.pieces, vocab.children, vocab.suffix, vocab.ending
    found: dict[str, tuple[int, ...]] = {}
    score: list[float] = [0.0]
    last: list = [None]
    at = [0]
    before, shared, walk = "", -1, MARK
    for word in ["", *sorted(distinct)]:
        if shared >= 0:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 2 :], last[shared + 2 :], at[shared + 2 :]
            walk = word[shared:]
        node = at[-1]
        for char in walk:
            while (child := children[node].get(char)) is None and node:
                node = suffix[node]
            node = child or 0
            best, own = -1e300, None
            for piece in ending[node]:
                total = score[-piece[0]] + piece[1]
                if total > best:
                    best, own = total, piece
            if char not in pieces:
                piece = vocab.fall_back(char)
                if (total := score[-1] + piece[1]) > best:
                    best, own = total, piece
            score.append(best)
            last.append(own)
            at.append(node)
        end, taken = len(word) + 1, []
        while end:
            own = last[end]
            taken.append(own[2])
            end -= own[0]
        found[word] = tuple(i for ids in reversed(taken) for i in ids)
        before, shared = word, 0
    return found


def decode_ids(ids, vocab: Vocabulary) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD; control pieces vanish."""
    text = "".join(vocab.plain[np.asarray(ids, np.int64)].tolist())
    if not text.isascii():
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text.removeprefix(" ")


def _ids(texts: list[str], vocab: Vocabulary) -> Iterator[np.ndarray]:
    """Ids of each text."""
    own_words, kept = [marked_words(t) for t in texts], vocab.kept
    new = set().union(*own_words).difference(kept)
    if len(kept) + len(new) > KEPT_WORDS:
        kept.clear()
        new = set().union(*own_words)
    for word, ids in segment(new, vocab).items():
        kept[word] = array("i", ids).tobytes()
    for own in own_words:
        yield np.frombuffer(b"".join([kept[w] for w in own]), np.int32)


#: Characters whose words are segmented at once.
BATCH_CHARS = 4_000_000


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for pdf in batches:
            texts = pdf.pop("text").tolist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < BATCH_CHARS or end == at):
                    size += len(texts[end])
                    end += 1
                ids = list(_ids(texts[at:end], vocab))
                back = [decode_ids(own, vocab) == text for own, text in zip(ids, texts[at:end], strict=True)]
                yield pdf.iloc[at:end].assign(n_tokens=[len(own) for own in ids], round_trip=back, ids=ids)
                at = end

    return run


def encode(documents: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, round_trip (whether the ids decode to the text) and ids of each document.

    A null text is empty and has no ids; repeated rows are encoded each; a null id stays null; other columns are ignored, whatever
    their names; an empty table gives one. round_trip decodes the document's own ids. The work stays in the partitions of the input: nothing is
    shuffled, and a worker keeps KEPT_WORDS words and the words of BATCH_CHARS characters at most (of one text, if it is longer). model must
    be readable on every executor.
    """
    rows = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInPandas(_encode(model), "doc_id string, n_tokens long, round_trip boolean, ids array<int>")
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema[id_col].dataType))


def decode(tokens: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """tokens with a column text: the ids' text; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        vocab = vocabulary(model)
        return ids.map(lambda x: decode_ids(x, vocab) if x is not None else "")

    return tokens.withColumn("text", run(F.col(ids_col)))
