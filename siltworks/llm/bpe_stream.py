"""Problem 6: encoding a corpus with a public byte-level BPE, as a streaming transducer of bounded lookahead.

Whether a token stays as it is depends on what stands to its right only through merges that would take its right end
away, each of which was made before the last: ranks fall along such a chain, so its length in bytes is bounded by the
merge list itself. `lookahead` is that bound, computed once from the merges. A token that ends more than `lookahead`
bytes before the end of what has been read is stable and is emitted; the rest starts anew at a token boundary, so that
memory stays constant however long a piece is.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltworks.functions.text import SPLIT
from siltworks.llm import textnum as tn
from siltworks.storage import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# White space as Unicode defines it, in the spelling of Python.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return [c for _, c in sorted([(b, chr(b)) for b in seen] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


class StreamingBpe:
    def __init__(self, model: bytes | str, cache: int = 1 << 18) -> None:
        m = json.loads(model)["model"]
        vocab = m["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.of_byte = [vocab[c] for c in alphabet]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in m["merges"]]
        self.merges = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.bytes_of.values()))
        self.lookahead = self._lookahead()
        self.window = 4 * (self.longest + self.lookahead)
        self.most = cache
        self.coarse = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.fine = regex.compile(SPLIT)
        self.cut = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
        self.ids_of: dict[str, bytes] = {}

    def _lookahead(self) -> int:
        """The bytes beyond a token's end that can decide whether it is in the result.

        reach[t]: bytes beyond t that decide whether t, once its parts stand, is made: the furthest that a merge of its right
        part (or of the right part's right part ...) with something to the right can be decided, among merges made before t.
        """
        reach: dict[int, int] = {}
        taken: dict[int, int] = {}  # by token: the furthest that merges with a right neighbour, of the ranks so far, look
        for (a, b), (_, t) in self.merges.items():  # in order of rank
            reach[t] = max(reach.get(t, 0), taken.get(b, 0), reach.get(b, 0))
            taken[a] = max(taken.get(a, 0), len(self.bytes_of[b]) + reach.get(b, 0))
        return max([0, *reach.values(), *taken.values()])

    def _merge(self, data: bytes) -> list[int]:
        """The merges of one stretch of bytes, in order of rank, leftmost first."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        get = self.merges.get
        if n < 48:
            while n > 1:
                best, at, new = 1 << 60, -1, -1
                for i in range(n - 1):
                    m = get((ids[i], ids[i + 1]))
                    if m is not None and m[0] < best:
                        best, at, new = m[0], i, m[1]
                if at < 0:
                    break
                ids[at : at + 2] = [new]
                n -= 1
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heappush(heap, (m[0], i, new, ids[k], m[1]))
            p = before[i]
            if p >= 0 and (m := get((ids[p], new))):
                heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece of any length, each as soon as it is stable."""
        at = 0
        while len(data) - at > self.window:
            end, stable = 0, self.window - self.lookahead
            for t in self._merge(data[at : at + self.window]):
                if end + len(self.bytes_of[t]) > stable:
                    break
                end += len(self.bytes_of[t])
                yield t
            at += end
        yield from self._merge(data[at:])

    def pieces(self, unit: str) -> bytes:
        ids: list[int] = []
        for piece in self.fine.findall(unit):
            ids.extend(self.stream(piece.encode("utf-8", "replace")))
        return np.array(ids, dtype=np.int32).tobytes()

    def stretches(self, text: str, most: int = 1 << 16) -> Iterator[list[str]]:
        """The units of a text, of about `most` characters at a time: a unit ends wherever white space begins."""
        at = 0
        while len(text) - at > most and (m := self.cut.search(text, at + most)):
            yield self.coarse.findall(text, at, m.start())
            at = m.start()
        yield self.coarse.findall(text, at)

    def encode(self, text: str) -> bytes:
        """The token ids as packed int32. Units between white space are remembered, up to a bound; beside the text and its ids only one
        stretch's units are held."""
        return b"".join(self.encode_stream(text))

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """encode() stretch by stretch."""
        for units in self.stretches(text):
            if len(self.ids_of) > self.most:
                self.ids_of = {}
            have = self.ids_of
            for u in set(units).difference(have):
                have[u] = self.pieces(u)
            yield b"".join(map(have.__getitem__, units))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete: bytes of an unfinished character wait for the next token."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield state.decode(self.bytes_of[i])
        yield state.decode(b"", True)


def _model(df: DataFrame, path: str):
    """The vocabulary file (1.6 MB, whatever the data), read where the driver is and sent once to each executor."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row per row of docs(doc_id, text, ...); ids without special tokens, whose strings are ordinary text.
    Null and empty text give the empty list; repeated rows and null doc_ids are kept; other columns are ignored."""
    model = _model(docs, vocabulary)

    def run(it):
        bpe = StreamingBpe(model.value)
        for b, texts in tn.batches(it):
            out = [bpe.encode(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): the inverse of encode_corpus, null becoming ''."""
    model = _model(encoded, vocabulary)

    def run(it):
        bpe = StreamingBpe(model.value)
        for b in it:
            texts = [bpe.decode(ids or ()) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): as encode_corpus, but only the length of each list."""
    model = _model(docs, vocabulary)

    def run(it):
        bpe = StreamingBpe(model.value)
        counts: dict[str, int] = {}
        for b, texts in tn.batches(it):
            out = []
            for t in texts:
                n = 0
                for units in bpe.stretches(t):
                    if len(counts) > bpe.most:
                        counts = {}
                    for u in set(units).difference(counts):
                        counts[u] = len(bpe.pieces(u)) // 4
                    n += sum(map(counts.__getitem__, units))
                out.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long")


def _library(kind: str, path: str):
    """The length of a text's encoding by one of the public libraries, special tokens being ordinary text."""
    if kind == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if kind == "tiktoken":
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def baseline_counts(docs: DataFrame, baselines: dict[str, tuple[str, str]]) -> DataFrame:
    """(doc_id, t_NAME...): for each row of docs(doc_id, text, ...) how many tokens each of baselines = {name: (library, file)} makes of its
    text, library being tokenizers, tiktoken or sentencepiece, for comparison. The files must be where the executors can read them. Null and
    empty text give 0."""
    names = list(baselines)

    def run(it):
        count = {k: _library(*v) for k, v in baselines.items()}
        for b, texts in tn.batches(it):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(count[k](texts), pa.int64()) for k in names]], names=["doc_id", *[f"t_{k}" for k in names]])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, " + ", ".join(f"t_{k} long" for k in names))
