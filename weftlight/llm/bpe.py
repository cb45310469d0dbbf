"""BPE encoding by a priority queue of merge ranks over a doubly linked list of symbols; decoding by joining vocabulary strings."""

from __future__ import annotations

import functools
import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import blocks, columns, resident, texts_of
from weftlight.llm.pretokens import Cache, WordPretokens, added_tokens, segments, spec


class Bpe:
    """Merge ranks and vocabulary of one JSON tokenizer."""

    def __init__(self, path: str):
        model = spec(path)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            self.ranks[tuple(pair.split(" ") if isinstance(pair, str) else pair)] = rank
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in added_tokens(path).items()}

    def encode_word(self, word: str) -> list[str]:
        """The symbols of one pre-token after all merges.

        The queue holds (rank, left position, left string, right string); an entry is stale, and skipped, when either
        symbol has since been merged away or changed. O(n log n), so very long words are no trouble.
        """
        symbols: list[str | None] = list(word)
        if not symbols:
            return []
        symbols[-1] += self.suffix
        n = len(symbols)
        if n == 1:
            return symbols
        ranks = self.ranks.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            r = ranks((symbols[i], symbols[i + 1]))
            if r is not None:
                queue.append((r, i, symbols[i], symbols[i + 1]))
        heapify(queue)
        while queue:
            _, i, left, right = heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                r = ranks((symbols[i], symbols[k]))
                if r is not None:
                    heappush(queue, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                r = ranks((symbols[h], symbols[i]))
                if r is not None:
                    heappush(queue, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s is not None]

    def ids(self, word: str) -> list[int]:
        """Symbols that are no vocabulary entries are left out, as the library does without an unknown token."""
        vocab = self.vocab
        return [vocab[s] for s in self.encode_word(word) if s in vocab]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space: the file names no decoder."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


class WordBpeCodec:
    """Whole texts to ids and back for word_bpe_49k, with each chunk's result kept in a bounded cache."""

    def __init__(self, path: str):
        self.path, self.bpe, self.cut = path, Bpe(path), WordPretokens(path)
        self.words = Cache(self.bpe.ids)
        self.digits = Cache(self._digits)

    def _digits(self, chunk: str) -> str:
        """The chunk's ids in decimal, each after a space."""
        return "".join([f" {i}" for w in self.cut.pretokens(chunk) for i in self.words[w]])

    def encode_decimal(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        out = []
        for part, special in segments(self.path, text):
            if special is None:
                out.extend(map(self.digits.__getitem__, self.cut.chunks(part)))
            else:
                out.append(f" {special}")
        return "".join(out)[1:]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decimal(text).split()]

    @functools.cached_property
    def _strings(self) -> dict[str, str]:
        return {str(i): s for i, s in self.bpe.strings.items()}

    def decode_decimal(self, ids: str) -> str:
        return " ".join(map(self._strings.__getitem__, ids.split(" "))) if ids else ""


def codec(path: str) -> WordBpeCodec:
    return resident(("bpe", path), lambda: WordBpeCodec(path))


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text with the word-level BPE file at `path` and decode the ids again.

    Returns (id_col, n_tokens, ids array<int>, decoded) or, with digests, (id_col, n_tokens, ids_sha256, decoded_sha256)
    made inside the same pass, so ids never leave the Python worker. Null and empty texts have no ids and decode to ''.
    Repeated rows give repeated results; further columns are dropped. One narrow pass: no shuffle, memory bounded by a
    block of 8 MB (or one text) and the chunk caches.
    """
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        c = codec(path)
        for b in blocks(batches, 8 << 20):
            n, first, second = [], [], []
            for text in texts_of(b, text_col):
                ids = c.encode_decimal(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                back = c.decode_decimal(ids)
                if digests:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                else:
                    first.append([int(x) for x in ids.split()])
                    second.append(back)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())], names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return columns(docs, id_col, text_col).withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
