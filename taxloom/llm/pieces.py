"""SentencePiece BPE encoding by a table of prefixes' last tokens, and decoding."""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class Encoder(dict):
    """Ids of a chunk, remembered: the least recently needed half goes when there are too many.

    A chunk's encoding is found by its prefixes: each prefix has one last token, which ends there by the
    automaton and is compatible with the last token of what stands before it. Two tokens are compatible
    if merging their joined characters gives just these two. From the whole chunk's last token the ids
    are recovered backwards.
    """

    def __init__(self, model: str, most: int = 500_000, most_pairs: int = 2_000_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.ids = {self.model.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds a space after another character; chunks can't be encoded apart")
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.matcher = ahocorasick.Automaton()
        self.first: dict[str, bool] = {"": ""}
        for p in self.ids:
            self.matcher.add_word(p, (p, len(p), {"": p}))  # what is known of the pieces that may follow it; its own name stands under ""
        self.matcher.make_automaton()
        self.most, self.older = most, {}
        self.most_pairs, self.pairs, self.filled = most_pairs, 0, []
        self.chunk, self.finer = self._cuts()

    def _cuts(self) -> tuple[re.Pattern, re.Pattern]:
        """Patterns of pieces of text that no token crosses.

        The quick one cuts before spaces, as no piece has a space after another character, and around line
        ends, if no piece has any. The finer one, for what isn't remembered, cuts also after letters (and all
        that follows letters in any piece) before anything else, and around characters of no piece.
        """
        known = {c for p in self.ids for c in p}
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        word = {c for c in known if c.isalpha()}
        while more := {b for a, b in pairs if a in word} - word:
            word |= more
        w, v = ("".join(map(re.escape, sorted(x))) for x in (word, known - word - {SPACE}))
        alone = "".join(c for c in "\n\r\t" if c not in known)
        quick = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone)
        return re.compile(quick), re.compile(f"{SPACE}*[{v}]*[{w}]+|{SPACE}*[{v}]+|{SPACE}+|[^{SPACE}{v}{w}]")

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging itself, of a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (score := self.scores.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] and after[i] < len(parts) and parts[i] + parts[after[i]] == both:
                j = after[i]
                parts[i], parts[j], after[i] = both, "", after[j]
                if after[i] < len(parts):
                    before[after[i]] = i
                offer(before[i])
                offer(i)
        return [p for p in parts if p]

    def compatible(self, one: str, two: str) -> bool:
        return self.merged(one + two) == ([one, two] if one else [two])

    def tokens(self, chunk: str) -> list[str]:
        last: list[dict | None] = [None] * (len(chunk) + 1)
        last[-1] = self.first  # of the empty prefix
        for end, (piece, size, after) in self.matcher.iter(chunk):  # of those that end at a place, the longest first
            if last[end] is None:
                one = last[end - size]
                if one is None:  # no piece ends there: that character stands alone
                    one = last[end - size] = {"": chunk[end - size]}
                known = one.get(piece)
                if known is None:
                    known = self.compatible(one[""], piece)
                    self._remember(one, piece, known)
                if known:
                    last[end] = after
        at, found = len(chunk) - 1, []
        while at >= 0:
            found.append(last[at][""] if last[at] is not None else chunk[at])
            at -= len(found[-1])
        return found[::-1]

    def _remember(self, one: dict, piece: str, known: bool) -> None:
        """Keeps what a test found; beyond most_pairs all that were found before are forgotten, so that a worker's memory is bounded."""
        if self.pairs >= self.most_pairs:
            for table in self.filled:
                own = table[""]
                table.clear()
                table[""] = own
            self.pairs, self.filled = 0, []
        if len(one) == 1:
            self.filled.append(one)
        one[piece] = known
        self.pairs += 1

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.older.pop(chunk, None)
        if found is None:
            parts = self.finer.findall(chunk)
            found = tuple(chain.from_iterable(map(self.__getitem__, parts))) if len(parts) > 1 else self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def _ids(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in self.tokens(chunk):
            if (i := self.ids.get(token)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in token.encode()]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.chunk.findall(SPACE + text.replace(" ", SPACE)))))


@functools.cache
def encoder(model: str) -> Encoder:
    """One for each worker process and model file."""
    return Encoder(model)


def _worker(model: str, make: Callable, names: list[str], types: list[pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        gc.disable()  # nothing here is cyclic, and walking the remembered chunks costs a tenth of the time
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [make(own, text.as_py()) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names)

    return run


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): each whole text's ids under a BPE model with byte fallback, and what they decode to.

    No begin or end ids and no sampling. A null or empty text has no ids and decodes to "". Characters that are
    no piece become bytes. Repeated rows get a row each; a null doc_id stays null; other columns are ignored; an empty table
    gives no rows. Time and memory are linear in a text's length; nothing is shuffled. model is a path that executors have.
    """
    run = _worker(model, lambda e, text: (ids := e.encode(text), e.model.decode(ids) if ids else ""), ["doc_id", "ids", "decoded"], [pa.list_(pa.int32()), pa.string()])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_pieces() reduced to doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text, without moving the ids."""
    decimal = [str(i) for i in range(1 << 17)]

    def digest(e: Encoder, text: str | None) -> tuple[int, str, str]:
        ids = e.encode(text)
        return len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256((e.model.decode(ids) if ids else "").encode()).hexdigest()

    run = _worker(model, digest, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
