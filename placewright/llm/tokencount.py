"""Token counts by trie-shared dynamic programming.

A text is cut into pre-tokens (runs of other than white space, each after a word-start mark). The
distinct pre-tokens of a batch are walked as a trie: in sorted order, neighbours share the path of
their common prefix, and the best segmentation's forward scores of that path are computed once. A
pre-token's terminal count is kept in a bounded memo, and a text's count is the sum over its words.

The segmentation is a unigram model's: the pieces of a public vocabulary with their scores, the
highest sum wins (fewer tokens on ties). A code point that no piece covers costs one token for each of
its UTF-8 bytes. Scores are the logarithms of a rank law, -log(rank + 8), since the vocabulary's own are only
ranks, and tokenizers are not trained here; so a count is this model's own, near that of the
vocabulary's tokenizer but not equal (the README says by how much). A word of any length is
segmented whole, in memory that grows with its shared prefix and its text alone.

Defined cases: null and empty texts, and texts of white space, have no tokens; rows are counted
apart; each text is counted whole.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
MARK = "▁"
#: Words in the memo, and the length from which a word isn't kept there: they bound its bytes.
MEMO, LONG = 200_000, 64
UNKNOWN = -16.0  # a byte's score, below every piece's


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces with scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    use = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + 8) for rank, i in enumerate(use)}


def build_trie(pieces: dict[str, float]) -> dict:
    """Nested dictionaries by code point; a piece's score is under the empty string."""
    root: dict = {}
    for piece, score in pieces.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return root


def counts_of(words: list[str], trie: dict, longest: int) -> list[int]:
    """Tokens of each word; ``words`` must be sorted, ``longest`` is the length of the longest piece.

    Column i of the forward table holds the best (score, tokens) of the first i code points, and
    the vocabulary nodes of pieces that began earlier and are still open there. Columns of the
    prefix shared with the word before are kept, and of the others only those that a piece can
    still begin at, so a long word needs no more memory than its shared prefix.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    opened: list[list[tuple[int, dict]]] = [[]]  # per column: (start, node) of pieces that may go on
    out, keep = [], 0
    for w, word in enumerate(words):
        after = words[w + 1] if w + 1 < len(words) else ""
        shared = 0
        for a, b in zip(word, after):
            if a != b:
                break
            shared += 1
        del best[keep + 1 :], opened[keep + 1 :]
        late: dict[int, tuple[float, int]] = {}
        (s, t), go = best[keep], opened[keep]
        for i in range(keep, len(word)):
            c = word[i]
            size = len(c.encode("utf-8", "surrogatepass"))
            top, tokens = s + UNKNOWN * size, t + size
            was, go = go, []
            for start, node in (*was, (i, trie)):
                nxt = node.get(c)
                if nxt is not None:
                    go.append((start, nxt))
                    own = nxt.get("")
                    if own is not None:
                        s, t = best[start] if start < len(best) else late[start]
                        if s + own > top or (s + own == top and t + 1 < tokens):
                            top, tokens = s + own, t + 1
            s, t = top, tokens
            if i < shared:
                best.append((s, t))
                opened.append(go)
            else:
                late[i + 1] = s, t
                late.pop(i + 1 - longest, None)
        out.append(t)
        keep = shared
    return out


def counted(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document row: doc_id, n_words, n_tokens."""
    held = documents.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo, longest = build_trie(held.value), {}, max(map(len, held.value), default=1)
        for batch in pieces(batches, 256):
            split = [(t or "").split() for t in batch.column("text").to_pylist()]
            new = set().union(*split)
            if len(memo) + len(new) > MEMO:
                memo.clear()
            new = sorted(new.difference(memo))
            memo.update(zip(new, counts_of([MARK + w for w in new], trie, longest), strict=True))
            get = memo.__getitem__
            n_words, n_tokens = list(map(len, split)), [sum(map(get, ws)) for ws in split]
            for w in new:
                if len(w) >= LONG:
                    del memo[w]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
