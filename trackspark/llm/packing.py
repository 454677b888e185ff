"""Packing tokenized documents into sequences of a fixed window: bounded-space online best fit.

Every task keeps a fixed number of open windows. What is left of a document after whole windows were cut from it goes
into the open window that it fills best; when it fits in none, the fullest window is emitted and a new one opened. The
windows still open at the end of a task are merged with those of other tasks by the same rule, in groups of bounded size.

Defined cases: a null text is empty, so its document is the end token alone. Rows that share a ``doc_id`` are packed as
separate documents. A null ``doc_id`` stays null. An empty table gives no pieces. Columns other than id and text are
ignored. Texts are tokenized whole; only a document longer than a window is cut.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.tables import id_and_text, release
from trackspark.session import settle

WINDOW = 2048
OPEN_WINDOWS = 96
END = 1
#: Open windows that one task merges.
MERGED = 1 << 14
#: Distinct pieces of text whose ids a task remembers.
REMEMBERED = 400_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

# How the byte-level vocabulary splits text before merging. The letter class is the part of Unicode's
# letters below U+02B0; texts with characters that it can't place go through the tokenizer whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
SPLIT = re.compile(rf"'(?:[st]|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
UNSPLIT = re.compile(rf"[^\x00-\x1b\x20-\x7f{LETTERS}¡-©«-±´¶·¸»¿×÷]|<\|")


def _bytes_of_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces of text, remembered up to a bound."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = self._encode(piece)
        return ids


class Tokens:
    """Ids of texts under a byte-level vocabulary, as little-endian unsigned 32-bit integers.

    Texts are split as the vocabulary's own splitter does, and each distinct piece is merged once. Where the merges of
    the file are in the order of their ids, that is done by rank; the whole tokenizer encodes what remains.
    """

    def __init__(self, path: str):
        self._path, self._model = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, byte = model["vocab"], _bytes_of_characters()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        by_rank = all(ids.get(m) == 256 + k for k, m in enumerate(merged))
        if by_rank:
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in ids.items() if i < 256 + len(merged)}
            merge = tiktoken.Encoding("pieces", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self._known = _Pieces(lambda piece: struct.pack(f"<{len(i := merge(piece.encode()))}I", *i))
        else:
            self._known = _Pieces(lambda piece: self._whole(piece))

    def _whole(self, text: str) -> bytes:
        if self._model is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self._path)
        ids = self._model.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        """Give back the memory of remembered pieces, as the process may go on with other work."""
        self._known.clear()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not text.isascii() and UNSPLIT.search(text):
            return self._whole(text)
        return b"".join(map(self._known.__getitem__, SPLIT.findall(text)))


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One :class:`Tokens` per file and process."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


class Windows:
    """At most ``most`` open windows of ``size``; :meth:`place` says where an item went and which window was emitted."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self._free: list[tuple[int, int]] = []  # room and number of each open window, ascending
        self._next = 0

    def place(self, length: int) -> tuple[int, int, int | None]:
        """Number of the window, offset in it, and the window that was emitted for it."""
        k, emitted = bisect.bisect_left(self._free, (length, -1)), None
        if k < len(self._free):
            room, number = self._free.pop(k)
        else:
            if len(self._free) >= self.most:
                emitted = self._free.pop(0)[1]
            room, number = self.size, self._next
            self._next += 1
        if room > length:
            bisect.insort(self._free, (room - length, number))
        else:
            emitted = number if emitted is None else emitted
        return number, self.size - room, emitted

    def number(self) -> int:
        """A window of its own for a whole piece."""
        self._next += 1
        return self._next - 1

    def open(self) -> list[int]:
        return [number for _, number in self._free]


def _pack(path: str, window: int, most: int, end: int):
    mark = struct.pack("<I", end)
    names = [x.split()[0] for x in PIECES.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = tokens(path), Windows(window, most)
        base = TaskContext.get().partitionId() << 33
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows

        def table(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(names)
            return pa.RecordBatch.from_arrays([*columns, pa.array([is_open] * len(rows))], schema=schema)

        for batch in batches:
            ids, texts, done = batch.column(0), batch.column(1), []
            for doc, text in zip(ids, texts, strict=True):
                coded = encode(text.as_py() or "") + mark
                doc, total = doc.as_py(), len(coded) // 4
                for start in range(0, total, window):
                    piece = coded[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    crc = zlib.crc32(piece)
                    if length == window:
                        done.append((doc, start, length, crc, total, base + windows.number(), 0))
                        continue
                    number, offset, emitted = windows.place(length)
                    waiting.setdefault(number, []).append((doc, start, length, crc, total, base + number, offset))
                    if emitted is not None:
                        done += waiting.pop(emitted)
            yield table(done, False)
        yield table([p for n in windows.open() for p in waiting[n]], True)
        encode.forget()
        release()

    return run


def _merge(window: int, most: int):
    schema = pa.schema([("old", pa.int64()), ("new", pa.int64()), ("shift", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (-r[1], r[0]))
        windows, host, moved = Windows(window, most), {}, []
        for sequence, length in rows:
            number, offset, _ = windows.place(length)
            moved.append((sequence, host.setdefault(number, sequence), offset))
        columns = zip(*moved, strict=True) if moved else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end: int = END,
    merged: int = MERGED,
) -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence of ``window`` tokens.

    ``tokenizer`` is the path of a vocabulary file that every executor has. ``start`` and ``length`` count tokens of the
    document (``end`` included), ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """
    pieces = settle(
        id_and_text(docs).mapInArrow(_pack(tokenizer, window, open_windows, end), f"{PIECES}, open boolean")
    )
    opened = pieces.where("open")
    left = opened.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    tasks = max(1, -(-left.count() // merged))
    moved = left.repartition(tasks, F.xxhash64("sequence_id")).mapInArrow(_merge(window, merged), "old long, new long, shift long")
    placed = opened.join(moved, F.col("sequence_id") == F.col("old")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("new").alias("sequence_id"),
        (F.col("offset") + F.col("shift")).alias("offset"),
    )
    return pieces.where("not open").drop("open").unionByName(placed)
