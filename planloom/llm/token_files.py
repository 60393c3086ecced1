"""Token-id files: Simple-8b word-aligned coding of whole, tokenised documents.

A 64-bit word holds a 4-bit selector and a 60-bit payload; the selector says how many ids of which width the payload
packs.  Selectors 2 to 15 are the published Simple-8b ones; selector 0 is the escape for values of more than 60 bits
(its payload is a position in the file's table of raw values).  Ids are cut into blocks of ``BLOCK`` ids that are
coded apart, each with the offset of its first word: any block decodes without the ones before it, and coding and
decoding run over all blocks at once in numpy.

A file (little-endian):  magic | for each group of ``PART`` blocks its words and raw values | group table (place in the
file, words, raw values) | word offset of each block in its group | doc_id | doc_id is null | ids of each document |
JSON footer | footer length, int64 | magic.  A reader takes the tables from the end and then any group, or any block.

Writing: rows are range-partitioned by doc_id and sorted by (doc_id, hash of the text, text), nulls first.  A task codes
a group as soon as its ids are there and begins another file after ``ROLL_IDS`` ids or ``ROLL_DOCS`` documents, so
neither the size of a partition nor that of a file bounds what it holds; one document's ids are held whole.  Files carry
the name of their attempt, and a file counts only if the task's result row for it (path, documents, ids) comes back:
lost or doubled attempts leave files that no manifest names, and those are deleted.  The driver sees one row for each
file, never a document.  The text enters the range key only if one doc_id has over ``HOT_ROWS`` rows; the order is the
same either way.  Reading: one task for each file of the manifest, group by group.

Tokenising: the plain call of the library, ``encode(text, add_special_tokens=False)``: the strings of special tokens in
a text become the tokens' ids (with ``special_as_text`` they are ordinary text).

Edge cases: null text is empty; an empty document holds the end id alone; repeated rows are coded as often as they
come; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, give_back, narrow, open_fs, text_slices

# The Simple-8b selectors in use, (ids in a word, bits of an id), from selector 2 on.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
BLOCK, PAD, PART = 1024, 60, 128
MAGIC = b"S8BIDS02"
#: A file ends after so many ids or documents.
ROLL_IDS, ROLL_DOCS = 1 << 25, 1 << 20
#: Rows of one doc_id beyond which texts help to deal the rows.
HOT_ROWS = 100_000
#: Bytes of text that are encoded at a time (one longer text is whole).
SLICE_BYTES = 3 << 20
#: Distinct pieces whose ids a task keeps, and the longest of them.
CACHE_ENTRIES, CACHE_PIECE = 200_000, 64


# --- coding ----------------------------------------------------------------------------------------------------


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits of each value, uint8."""
    top = int(values.max(initial=0))
    if top < 1 << 20:
        return np.frexp(np.arange(top + 1, dtype=np.float64))[1].astype(np.uint8)[values.astype(np.int64)]
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1]).astype(np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, raw (escaped) values and the word offset of each block; worked through in parts that fit a CPU's cache."""
    words, raw, offsets, n = [], [], [], 0
    for k in range(0, len(ids), PART * block):
        w, r, o = _encode(ids[k : k + PART * block], block)
        w[w < len(r)] += np.uint64(sum(map(len, raw)))  # only escapes have selector 0
        words.append(w)
        raw.append(r)
        offsets.append(o + n)
        n += len(w)
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in ((words, np.uint64), (raw, np.uint64), (offsets, np.int64)))


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    blocks, stride = -(-len(ids) // block), block + PAD
    padded = np.zeros((blocks, block), np.uint64)
    padded.reshape(-1)[: len(ids)] = ids
    flat = np.pad(padded, ((0, 0), (0, PAD))).reshape(-1)
    width = bit_length(flat)
    spans = {1: width}  # the widest of the 1, 2, 4 ... values from each place on
    for size in (2, 4, 8, 16, 32):
        half = spans[size // 2]
        spans[size] = np.maximum(half, np.append(half[size // 2 :], half[: size // 2]))
    # where a selector fits, so do all that pack fewer ids: the number of fitting ones names the best
    fitting = np.zeros(len(flat), np.uint8)
    for count, bits in reversed(SELECTORS):
        size = 1 << (count.bit_length() - 1)
        widest = np.maximum(spans[size], np.append(spans[size][count - size :], spans[size][: count - size]))
        fits = widest <= bits
        if not fits.any():
            break
        fitting += fits
    selector = np.array([ESCAPE, *range(len(SELECTORS) + 1, 1, -1)], np.uint8)[fitting]
    step = np.array([1, *(c for c, _ in reversed(SELECTORS))])[fitting]
    heads = np.zeros(len(flat), bool)
    at = np.arange(blocks) * stride
    end = at + np.minimum(block, len(ids) - np.arange(blocks) * block)
    while len(at):
        heads[at] = True
        at = at + step[at]
        on = at < end
        at, end = at[on], end[on]
    first = np.flatnonzero(heads)
    chosen = selector[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        where = np.flatnonzero(chosen == s + 2)
        for k in range(count):
            words[where] |= flat[first[where] + k] << np.uint64(k * bits)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, flat[first[escaped]], np.searchsorted(first, np.arange(blocks) * stride)


def decode(words: np.ndarray, raw: np.ndarray, offsets: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    """The ids, uint64: many blocks are unpacked together, selector by selector."""
    ends = np.append(offsets[PART::PART], len(words))
    parts = [_decode(words[o[0] : end], raw, o - o[0], block) for o, end in zip((offsets[k : k + PART] for k in range(0, len(offsets), PART)), ends)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])[:total]


def _decode(words: np.ndarray, raw: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
    blocks, stride = len(offsets), block + PAD
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, 0, *(c for c, _ in SELECTORS)])[chosen]
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(blocks), np.diff(np.append(offsets, len(words))))
    at = before - before[offsets[owner]] + owner * stride if len(words) else before
    flat = np.zeros(blocks * stride, np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s, (count, bits) in enumerate(SELECTORS):
        where = np.flatnonzero(chosen == s + 2)
        for k in range(count):
            flat[at[where] + k] = payload[where] >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)
    where = np.flatnonzero(chosen == ESCAPE)
    flat[at[where]] = raw[payload[where].astype(np.int64)] if len(where) else 0
    return flat.reshape(blocks, stride)[:, :block].reshape(-1)


# --- files -----------------------------------------------------------------------------------------------------


class TokenFile:
    """Writes one file; ids are coded and written as soon as they fill a group."""

    def __init__(self, uri: str, block: int = BLOCK):
        self.uri, self.block, self.group = uri, block, PART * block
        fs, path = open_fs(uri)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.ids, self.held, self.waiting = len(MAGIC), 0, [], 0
        self.groups, self.offsets = [], []
        self.keys, self.nulls, self.lengths = array("q"), array("B"), array("q")

    @property
    def docs(self) -> int:
        return len(self.keys)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents (ids of all of them one after the other, ``lengths`` of each)."""
        self.keys.extend(d or 0 for d in doc_ids)
        self.nulls.extend(d is None for d in doc_ids)
        self.lengths.frombytes(np.asarray(lengths, np.int64).tobytes())
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.group:
            self._code(self.waiting // self.group * self.group)

    def _code(self, size: int) -> None:
        ids = np.concatenate(self.held)
        for k in range(0, size, self.group):
            words, raw, offsets = _encode(ids[k : min(k + self.group, size)], self.block)
            self.groups.append((self.at, len(words), len(raw)))
            self.offsets.append(offsets.astype(np.int64))
            for part in (words, raw):
                if len(part):
                    self.out.write(memoryview(part).cast("B"))
            self.at += 8 * (len(words) + len(raw))
        self.held, self.waiting = ([ids[size:].copy()] if size < len(ids) else []), len(ids) - size

    def close(self) -> dict:
        if self.waiting:
            self._code(self.waiting)
        offsets = np.concatenate([np.zeros(0, np.int64), *self.offsets])
        for part in (np.array(self.groups, np.int64).reshape(-1), offsets, self.keys, self.nulls, self.lengths):
            if len(part):
                self.out.write(memoryview(part).cast("B"))
        footer = json.dumps({"block": self.block, "ids": self.ids, "groups": len(self.groups), "blocks": len(offsets), "docs": self.docs, "tail": self.at}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return {"uri": self.uri, "docs": self.docs, "ids": self.ids}


class TokenReader:
    """Reads one file: its documents' doc_ids (None where null) and lengths, and the ids of any group or stretch."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        end = self.source.read_at(min(size, 16), max(0, size - 16))
        if len(end) < 16 or end[8:] != MAGIC or self.source.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token-id file, or is cut short")
        length = int.from_bytes(end[:8], "little")
        footer = json.loads(self.source.read_at(length, size - 16 - length))
        tail = self.source.read_at(size - 16 - length - footer["tail"], footer["tail"])
        self.block, self.ids, at, parts = footer["block"], footer["ids"], 0, []
        for dtype, n in ((np.int64, 3 * footer["groups"]), (np.int64, footer["blocks"]), (np.int64, footer["docs"]), (np.uint8, footer["docs"]), (np.int64, footer["docs"])):
            parts.append(np.frombuffer(tail, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
        self.groups, self.offsets, self.keys, self.nulls, self.lengths = parts[0].reshape(-1, 3), *parts[1:]

    def doc_ids(self, first: int, last: int) -> list:
        return [None if gone else k for k, gone in zip(self.keys[first:last].tolist(), self.nulls[first:last].tolist())]

    def group(self, g: int) -> np.ndarray:
        """The ids of a group, uint64."""
        at, words, raw = map(int, self.groups[g])
        data = self.source.read_at(8 * (words + raw), at)
        offsets = self.offsets[g * PART : (g + 1) * PART]
        total = min(self.ids - g * PART * self.block, PART * self.block)
        return _decode(np.frombuffer(data, np.uint64, words), np.frombuffer(data, np.uint64, raw, 8 * words), offsets, self.block)[:total]

    def stretch(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` to before ``last``."""
        size, last = PART * self.block, min(last, self.ids)
        parts = [self.group(g)[max(0, first - g * size) : last - g * size] for g in range(first // size, -(-last // size) if last > first else 0)]
        return np.concatenate([np.zeros(0, np.uint64), *parts])

    def checksums(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each group the first document that ends in it and the CRC-32 of that and all others that do."""
        ends, doc, crc = np.cumsum(self.lengths), 0, 0
        for g in range(len(self.groups)):
            ids = self.group(g).astype("<u4")
            raw, begin = memoryview(ids).cast("B"), g * PART * self.block
            last = int(np.searchsorted(ends, begin + len(ids), "right"))
            places = (4 * (ends[doc:last] - begin)).tolist()
            found, at = [], 0
            for end in places:
                found.append(zlib.crc32(raw[at:end], crc))
                crc, at = 0, end
            crc = zlib.crc32(raw[at:], crc)
            if found:
                yield doc, np.array(found, np.int64)
            doc = last

    def close(self) -> None:
        self.source.close()


# --- tokenising ------------------------------------------------------------------------------------------------


#: Stands in a piece for the character before it, which isn't a space.
GLUED = "\x01"
_ENDS_WORD = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Pieces(dict):
    """Ids of pieces of text (None for a piece after which the text can't be cut for certain); unknown ones are encoded
    and kept, up to ``CACHE_ENTRIES`` of at most ``CACHE_PIECE`` characters."""

    def __init__(self, encoder: Encoder, lead: str, marks: _Pieces | None = None):
        super().__init__()
        self.whole, self.tokenize, self.lead, self.mark = encoder.whole, encoder.tokenizer.model.tokenize, lead, lead.translate(_BYTES)
        #: ids of runs of marks, which never begin a piece here
        self.marks = self if marks is None else marks

    def __missing__(self, piece: str) -> bytes | None:
        if piece.isascii() and piece.isalpha():
            ids = array("I", [t.id for t in self.tokenize(self.mark + piece)]).tobytes()
        elif piece[:1] == GLUED:
            return self.marks[piece[1:]]
        elif piece[:1] == "\n" and ("!" <= piece[1:2] <= "~" or piece[1:2].isalpha() and piece[1] < "\u0250"):
            # a line break before anything but white space is a pre-token
            ids = self.marks[piece[1:]]
            ids = None if ids is None else self.marks.line_break() + ids
        elif not piece or not ("!" <= piece[-1] <= "~" or piece[-1].isalnum()):
            ids = None
        else:
            stem = piece.rstrip(_MARKS)
            if stem != piece and stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
                # Latin letters and marks are two pre-tokens
                return self[stem] + self.marks[piece[len(stem) :]]
            elif stem.isalpha() and max(stem) < "\u0250":
                ids = array("I", [t.id for t in self.tokenize(self.mark + piece.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            else:
                ids = self.whole(piece if piece[0] == "\n" else self.lead + piece)
        if len(piece) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def line_break(self) -> bytes:
        if "\n" not in self:
            self["\n"] = self.whole("\n")
        return self["\n"]


class Encoder:
    """Whole texts to ids with the tokenizers library, piece by piece.

    A byte-level BPE without normaliser never merges across the start of a space, or of a line break, that follows a
    character which is not white space, nor between a Latin letter or digit and a mark.  Texts are cut there (of the
    marks only at a comma or full stop before a space), and the library encodes each distinct piece of a batch once.  A text with a piece after which the cut would not be certain (empty, or ending in anything but a letter,
    digit or printable ASCII), or with the string of a special token, goes to the library as a whole, as do all texts
    for any other kind of tokenizer.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        #: strings that the library takes out of a text before it is cut
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_piece = isinstance(self.tokenizer.model, BPE) and not self.tokenizer.normalizer and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.first = _Pieces(self, "")
        self.later = _Pieces(self, " ", self.first)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end`` if given, and the ids of each."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            blobs = [self.whole(t) if t else b"" for t in texts.to_pylist()]
            which = np.arange(len(blobs))
            heads, lists = which, np.arange(len(blobs) + 1)
        else:
            hard = pc.or_(pc.match_substring(texts, " \n"), pc.starts_with(texts, "\n"))
            for s in (GLUED, *self.added):
                hard = pc.or_(hard, pc.match_substring(texts, s))
            cut = pc.replace_substring(pc.if_else(hard, "", texts), "\n", " \n")
            for mark in ",.":
                cut = pc.replace_substring(cut, f"{mark} ", f" {GLUED}{mark} ")
            pieces = pc.split_pattern(cut, " ")
            lists = pieces.offsets.to_numpy()
            heads, values = lists[:-1], pieces.values
            coded = pc.dictionary_encode(values)
            codes = coded.indices.to_numpy()
            used = np.zeros(len(coded.dictionary), bool)
            rest = np.ones(len(codes), bool)
            rest[heads] = False
            used[codes[rest]] = True
            blobs = list(map(self.later.__getitem__, coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()))
            which = (np.cumsum(used) - 1)[codes]
            which[heads] = 0
            # texts that can't be cut, or not there, are encoded whole in place of their first piece
            again = hard.to_numpy(zero_copy_only=False)
            glued = np.flatnonzero(pc.starts_with(coded.dictionary, GLUED).to_numpy(zero_copy_only=False)[codes] & rest)
            loose = ~pc.match_substring_regex(coded.dictionary, _ENDS_WORD).to_numpy(zero_copy_only=False)[codes[glued - 1]]
            if None in blobs or loose.any():
                open_ = np.array([b is None for b in blobs], bool)[which] & rest if blobs else rest
                open_[glued[loose]] = True
                blobs = [b or b"" for b in blobs]
                again = again | np.logical_or.reduceat(open_, heads)
            first = list(map(self.first.__getitem__, values.take(pa.array(heads)).to_pylist()))
            again = np.flatnonzero(again | np.array([b is None for b in first], bool))
            for i in again.tolist():
                text = texts[i].as_py()
                first[i] = self.whole(text) if text else b""
                which[lists[i] : lists[i + 1]] = len(blobs)
            which[heads] = len(blobs) + 1 + np.arange(len(first))
            blobs += [b"", *first]
        if end is not None:
            which = np.insert(which, lists[1:], len(blobs))
            lists = lists + np.arange(len(lists))
            blobs.append(np.uint32(end).tobytes())
        if not len(which):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = np.array([len(b) // 4 for b in blobs])
        counts = size[which]
        place = np.cumsum(size) - size
        total = np.cumsum(counts)
        kind = np.int32 if total[-1] < 1 << 31 and place[-1] < 1 << 31 else np.int64
        at = np.repeat((place[which] - total + counts).astype(kind), counts)
        at += np.arange(total[-1], dtype=kind)
        return np.frombuffer(b"".join(blobs), np.uint32)[at], np.diff(np.append(0, total[lists[1:] - 1]))

    def forget(self) -> None:
        self.first.clear()
        self.later.clear()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a file."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


# --- Spark -----------------------------------------------------------------------------------------------------


def _writer(folder: str, tokenizer: str, end_id: int, special_as_text: bool, roll_ids: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode_texts, out, written = TaskContext.get(), encoder(tokenizer, special_as_text), None, []
        for batch in text_slices(batches, 1, size=min(SLICE_BYTES, roll_ids)):  # an id is a byte at least
            ids, lengths = encode_texts(batch.column(1), end_id)
            out = out or TokenFile(f"{folder}/ids-{context.partitionId():06d}-{len(written):04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.s8b", block)
            out.add(batch.column(0).to_pylist(), lengths, ids)
            if out.ids >= roll_ids or out.docs >= ROLL_DOCS:
                written.append(out.close())
                out = None
        if out:
            written.append(out.close())
        encode_texts.forget()
        give_back()
        if written:
            columns = {"part": pa.array([context.partitionId()] * len(written), pa.int32()), "nth": pa.array(range(len(written)), pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | {k: [w[k] for w in written] for k in ("uri", "docs", "ids")})

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, special_as_text: bool = False, roll_ids: int = ROLL_IDS, block: int = BLOCK) -> list[dict]:
    """Write the table's ids in ascending doc_id order; returns the manifest, one entry for each file in order.

    ``tokenizer`` is the path of a tokenizers file that every executor has.
    """
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    rows = narrow(docs)
    hot = rows.groupBy("doc_id").count().where(F.col("count") > HOT_ROWS).limit(1).count()
    key, tie = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = rows.repartitionByRange(key, tie) if hot else rows.repartitionByRange(key)
    dealt = dealt.sortWithinPartitions(key, tie, "text").select("doc_id", "text")
    rows = dealt.mapInArrow(_writer(folder, tokenizer, end_id, special_as_text, roll_ids, block), "part int, nth int, uri string, docs long, ids long").collect()
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: (r.part, r.nth)):
        manifest.append({"uri": r.uri, "start": start, "docs": r.docs, "ids": r.ids})
        start += r.ids
    named = {m["uri"].rsplit("/", 1)[1] for m in manifest}
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.base_name.endswith(".s8b") and info.base_name not in named:
            fs.delete_file(info.path)
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = TokenReader(uri)
            starts = np.cumsum(held.lengths) - held.lengths + start
            for doc, crc in held.checksums():
                some = slice(doc, doc + len(crc))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(held.doc_ids(doc, doc + len(crc)), pa.int64()), "start": starts[some], "n_tokens": held.lengths[some], "ids_crc32": crc})
            held.close()
    give_back()


def read_ids(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(m["uri"], m["start"]) for m in manifest], "uri string, start long")
    return files.repartition(len(manifest)).mapInArrow(_reader, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Write all documents and read the digest of each back from the files."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, tokenizer, fresh_path(spark, "token-ids"), end_id, **options))
