"""Token counts of a unigram tokenizer by dynamic programming over a trie of the distinct pre-tokens.

A node stands for a prefix of pre-tokens and holds the forward score of its best segmentation, found once from the nodes
above it; the node where a pre-token ends gives its token count and log probability. The vocabulary is a file of a public
tokenizer (a piece in base64 and its rank on each line); a piece's probability follows from its rank by Zipf's law.
Every byte is a piece, so every text can be segmented.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, record, table, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokens of the vocabulary's tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task's trie starts anew beyond so many nodes or pre-tokens held; pre-tokens beyond so many bytes are scored without being kept.
MOST_NODES, MOST_HELD, LONGEST = 400_000, 1_000_000, 128


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces and their log probabilities: those of ranks r are as 1 / (r + 1). A file of fixed size, read by the driver."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    for b in range(256):
        ranks.setdefault(bytes([b]), len(ranks))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class Trie(dict):
    """Pre-tokens to (tokens, log probability); grows by those that it is asked for. When the trie starts anew, what was found
    with it is kept until the next time: pre-tokens that come again are carried along. It starts anew when it has many nodes or
    holds many pre-tokens, carried ones among them, so it never holds more than twice ``MOST_HELD``."""

    def __init__(self, vocabulary: dict[bytes, float]):
        super().__init__()
        self.scores, self.longest = vocabulary, max(map(len, vocabulary))
        self.start()

    def start(self) -> None:
        self.before = dict(self)
        self.clear()
        self.next: dict[int, int] = {}  # by node and byte
        self.best, self.tokens = [0.0], [0]

    def forward(self, word: bytes, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """The best score, and of those the fewest tokens, of word[:end], from those of the shorter prefixes."""
        scores, top, least = self.scores, -math.inf, 0
        for j in range(end - 1, max(-1, end - self.longest - 1), -1):
            p = scores.get(word[j:end])
            if p is not None:
                p += best[j]
                if p > top or p == top and tokens[j] + 1 < least:
                    top, least = p, tokens[j] + 1
        return top, least

    def __missing__(self, text: str) -> tuple[int, float]:
        if len(self) >= MOST_HELD:
            self.start()
        found = self.before.get(text)
        if found is not None:
            self[text] = found
            return found
        word = text.encode()
        if len(word) > LONGEST:
            best, tokens = [0.0], [0]
            for end in range(1, len(word) + 1):
                p, n = self.forward(word, end, best, tokens)
                best.append(p)
                tokens.append(n)
            return tokens[-1], best[-1]
        if len(self.best) > MOST_NODES:
            self.start()
        node, best, tokens = 0, [0.0], [0]
        for end, byte in enumerate(word, 1):
            step = node << 8 | byte
            child = self.next.get(step)
            if child is None:
                p, n = self.forward(word, end, best, tokens)
                child = self.next[step] = len(self.best)
                self.best.append(p)
                self.tokens.append(n)
            node = child
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        self[text] = found = tokens[-1], best[-1]
        return found


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_bytes, n_tokens, log_prob) for every document.

    Null and empty texts have zero of each; ids pass as they are, null ones too. Equal scores: the segmentation with fewer tokens. Repeated ids: a row each.
    Empty table: no rows. Other columns are ignored. Whole texts are counted, pre-tokens of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def setup() -> tuple:
        return Trie(shared.value), regex.compile(PATTERN).findall

    def run(batch: pa.RecordBatch, made: tuple) -> Iterator[pa.RecordBatch]:
        (trie, split), rows = made, []
        for x in texts(batch):
            words = split(x or "")
            found = list(map(trie.__getitem__, words))
            rows.append((len(words), len((x or "").encode()), sum(n for n, _ in found), math.fsum(p for _, p in found)))
        n_pretokens, n_bytes, n_tokens, log_prob = zip(*rows, strict=True)
        yield record(doc_id=batch.column("doc_id"), n_pretokens=n_pretokens, n_bytes=n_bytes, n_tokens=n_tokens, log_prob=log_prob)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, run, f"doc_id {kind}, n_pretokens long, n_bytes long, n_tokens long, log_prob double", setup)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE: dict[str, str] = {}
