"""Byte-pair encoding as a finite-state transducer that is determinised lazily.

The merges of a rank file decide which tokens are whole (a token whose own bytes encode to itself) and which
pairs may stand side by side (two tokens whose joined bytes encode to those two). A text's encoding is the one
path through the whole tokens on which every neighbouring pair may stand so. The transducer reads bytes and
keeps every path that is still open: a place in the trie of whole tokens, and the tokens since the last one
emitted. What all open paths agree on is emitted, so output trails input by a bounded lookahead. The set of
open paths is one deterministic state; states and transitions are made when first met and kept.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie on every host.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Transitions and words kept in a task before the caches start anew; results do not depend on them.
STATES_KEPT, WORDS_KEPT = 400_000, 400_000

START = -1


class Transducer:
    def __init__(self, rank_file: str, pattern: str = PATTERN):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        # trie of all tokens: a node is [token or None, {byte: node number}]
        self.nodes: list[list] = [[None, {}]]
        for token, rank in self.ranks.items():
            at = 0
            for b in token:
                at = self.nodes[at][1].setdefault(b, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append([None, {}])
            self.nodes[at][0] = rank
        self._whole: dict[int, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.rest: list[tuple] = []
        self._state(((0, (START,)),))

    def merge(self, data: bytes) -> list[int]:
        """The encoding by repeated merging of the lowest rank; only used on the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _may_follow(self, last: int, token: int) -> bool:
        whole = self._whole.get(token)
        if whole is None:
            whole = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        if not whole or last == START:
            return whole
        fits = self._pair.get((last, token))
        if fits is None:
            fits = self._pair[last, token] = self.merge(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
        return fits

    def _state(self, paths: tuple) -> int:
        found = self.ids.get(paths)
        if found is None:
            found = self.ids[paths] = len(self.states)
            self.states.append(paths)
            self.moves.append({})
            self.rest.append(next(tokens[1:] for node, tokens in paths if node == 0))
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        """The transition's target and output, worked out once."""
        paths = []
        for node, tokens in self.states[state]:
            child = self.nodes[node][1].get(byte)
            if child is None:
                continue
            token, onward = self.nodes[child]
            if token is not None and self._may_follow(tokens[-1], token):
                paths.append((0, (*tokens, token)))
            if onward:
                paths.append((child, tokens))
        out = []
        while all(len(t) > 1 for _, t in paths) and len({t[1] for _, t in paths}) == 1:
            out.append(paths[0][1][1])
            paths = [(n, t[1:]) for n, t in paths]
        move = self.moves[state][byte] = (self._state(tuple(sorted(paths))), tuple(out))
        return move

    def word(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > STATES_KEPT:
            self._reset()
        state, out, moves = 0, [], self.moves
        for byte in data:
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        return (*out, *self.rest[state])

    def encode_into(self, text: str, out: array, words: dict[str, tuple]) -> None:
        for piece in self.split(text):
            ids = words.get(piece)
            if ids is None:
                if len(words) > WORDS_KEPT:
                    words.clear()
                ids = words[piece] = self.word(piece.encode("utf-8", "surrogatepass"))
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out, {})
        return out.tolist()

    def decode(self, tokens: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete."""
        machine = Utf8Machine()
        for t in tokens:
            if piece := machine.feed(self.bytes_of[t]):
                yield piece
        if piece := machine.close():
            yield piece


class Utf8Machine:
    """Incremental UTF-8: bytes go in as they come, whole characters come out."""

    def __init__(self) -> None:
        self.held, self.missing = bytearray(), 0

    def feed(self, data: bytes) -> str:
        whole = bytearray()
        for b in data:
            if self.missing and b & 0xC0 == 0x80:
                self.held.append(b)
                self.missing -= 1
                if self.missing:
                    continue
            elif b < 0x80 or b & 0xC0 == 0x80 or b >= 0xF8:
                self.missing = 0
                self.held.append(b)
            else:
                whole += self.held
                self.held, self.missing = bytearray([b]), 1 + (b >= 0xE0) + (b >= 0xF0)
                continue
            whole += self.held
            self.held.clear()
        return whole.decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held, self.missing = bytes(self.held), bytearray(), 0
        return rest.decode("utf-8", "replace")


_LOADED: dict[str, Transducer] = {}


def transducer(name: str, folder: str = TOKENIZER_DIR) -> Transducer:
    """One transducer for each rank file and Python worker."""
    path = f"{folder}/{name}.tiktoken"
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it lies in fewer splits than that; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; null and empty texts have an empty list.

    Strings that spell a special token are ordinary text. Rows are neither dropped nor merged: repeated doc_ids
    and texts come out as often as they go in. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, words = transducer(tokenizer, folder), {}
        for batch in batches:
            for part in slices(batch):
                out, ends = array("i"), array("i", [0])
                for text in part.column(1).to_pylist():
                    if text:
                        t.encode_into(text, out, words)
                    ends.append(len(out))
                ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(out), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that long texts do not stand in memory together."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, tokens) of every document with a text that is not null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, words = transducer(tokenizer, folder), {}
        for batch in batches:
            counts = array("q")
            for text in batch.column(1):
                out = array("i")
                t.encode_into(text.as_py(), out, words)
                counts.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(memoryview(counts), pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.select("doc_id", "text").where("text <> ''")).mapInArrow(run, "doc_id bigint, tokens bigint")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer, folder)
        for batch in batches:
            for part in slices(batch):
                texts = [None if ids is None else "".join(t.decode(ids)) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
