"""Token ids of documents in binary files of Simple-8b coded words.

A file holds the documents of one shard in ascending order of their ids::

    magic, 6 counts (documents, ids, blocks, words of ids, words of lengths, block size), all 64 bit
    document ids, a null flag per document (one byte each, padded to 8)
    first word of each block of ids
    words of the document lengths, words of the ids

Ids are coded in blocks of BLOCK ids that start on a word, so any block can be decoded by itself from its
offset. A word has a 4-bit selector and 60 bits of equally wide values; selector 0 is an escape: the next
word is one value of more than 60 bits. Encoding and decoding handle all words of a selector at once.

The tokenizer lowers and splits a text at white space first, so a text is encoded by the library chunk by
chunk. Arrow cuts the texts of a batch into numbered distinct chunks, chunks already seen are looked up, and
numpy puts their ids where their numbers stand.

Defined cases: null and empty texts have the end id only; rows without a doc_id come first; rows that
repeat a doc_id are ordered by their ids; an empty table gives no files and no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicloom.llm import shards
from topicloom.llm.common import table
from topicloom.llm.registry import query
from topicloom.session import materialize

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK = 4096
FILE_IDS = 2_000_000  # a file is closed at this many ids
GROUP_BYTES = 4 << 20  # of texts cut into chunks at a time, about
KNOWN_CHUNKS = 400_000  # chunks a worker remembers, and as many it met before those
# Latin letters that are one code point lowered and composed, between ASCII marks. An apostrophe before letters may be
# part of a contraction, and a special token begins with <, so neither may stand before them.
_LETTERS = re.compile("([!-&(-/:;=-@\\[-`{-~]*)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)"
                      "([!-/:-@\\[-`{-~]*)")
# White space of the tokenizer (Unicode White_Space), and what str.split() and Arrow would cut at besides.
_MORE = re.compile("[\\x1c-\\x1f]")
_BLANKS = re.compile("[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+")
_MARKS, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b"!,.:;?")] = True
_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
MAGIC = b"S8BTOKEN"
HEAD = struct.Struct("<8s6q")

# Selector -> (values in a word, bits of each); selector 0 is the escape.
LAYOUT = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
          (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([c for c, _ in LAYOUT])
# Values of a word -> its selector; one value may also need the escape.
_SELECTORS = np.zeros(61, np.uint8)
_SELECTORS[_COUNTS[1:]] = np.arange(1, len(LAYOUT))
_EXPONENT, _BIAS = np.uint64(52), np.uint64(1022)  # of 64-bit floats


def _windows(wide: np.ndarray) -> dict[int, np.ndarray]:
    """Largest bit width in the window of each size that starts at a value (0 padded at the end)."""
    found, size = {1: wide}, 1
    for target in sorted(c for c, _ in LAYOUT[1:]):
        if target == 1:
            continue
        part = found[size]
        shift = target - size
        if shift > size:  # double first
            half = part.copy()
            half[:-size] = np.maximum(part[:-size], part[size:])
            part, shift = half, target - 2 * size
        grown = part.copy()
        grown[:-shift] = np.maximum(part[:-shift], part[shift:])
        found[target], size = grown, target
    return found


def _starts(steps: np.ndarray, block: int) -> np.ndarray:
    """Where words start: every block is walked from its first value, all blocks at once."""
    n = len(steps)
    at, found = np.arange(0, n, block), []
    ends = np.minimum(at + block, n)
    while len(at):
        found.append(at)
        at = at + steps[at]
        inside = at < ends
        if not inside.all():
            at, ends = at[inside], ends[inside]
    return np.sort(np.concatenate(found))


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of non-negative 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if int(values.max()) < 1 << 53:
        exponent = values.astype(np.float64).view(np.uint64) >> _EXPONENT
        wide = (np.maximum(exponent, _BIAS) - _BIAS).astype(np.uint8)
    else:
        wide = np.array([int(v).bit_length() for v in values.tolist()], np.uint8)
    left = np.resize(np.arange(block, 0, -1).clip(max=255).astype(np.uint8), n)
    left[-255:] = np.minimum(left[-255:], np.arange(min(n, 255), 0, -1))
    best = np.ones(n, np.uint8)
    largest = _windows(np.r_[wide, np.zeros(64, np.uint8)])
    for count, bits in LAYOUT[1:]:
        fits = (largest[count][:n] <= bits) & (left >= count)
        np.maximum(best, fits.view(np.uint8) * np.uint8(count), out=best)
    starts = _starts(best, block)
    chosen = _SELECTORS[best[starts]]
    chosen[wide[starts] > 60] = 0
    place = np.arange(len(starts)) + np.r_[0, np.cumsum(chosen == 0)[:-1]]
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    for k, (count, bits) in enumerate(LAYOUT):
        own = chosen == k
        if not own.any():
            continue
        first, to = starts[own], place[own]
        if k == 0:
            words[to + 1] = values[first]
            continue
        word = np.full(len(first), np.uint64(k) << np.uint64(60), np.uint64)
        for j in range(count):
            word |= values[first + j] << np.uint64(bits * j)
        words[to] = word
    return words, place[np.searchsorted(starts, np.arange(0, n, block))]


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of whole blocks of words."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == 0).tolist():  # what follows an escape is a value, not a word
        if not raw[k] and k + 1 < len(words):
            raw[k + 1] = True
    selector[raw] = -1
    counts = np.where(raw, 0, _COUNTS[selector])
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(selector == k)
        if not len(own):
            continue
        if k == 0:
            out[start[own]] = words[own + 1]
            continue
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[start[own] + j] = words[own] >> np.uint64(bits * j) & mask
    return out


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, blocks = pack(ids)
    sizes, _ = pack(np.array(lengths, np.uint64))
    null = bytes(x is None for x in doc_ids)
    return b"".join((
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), len(words), len(sizes), BLOCK),
        np.array([x or 0 for x in doc_ids], np.int64).tobytes(), null + bytes(-len(null) % 8),
        blocks.astype(np.int64).tobytes(), sizes.tobytes(), words.tobytes()))


class TokenFile:
    """A file opened for reading; ``ids`` decodes only the blocks that are asked for."""

    def __init__(self, file):
        self.file = file
        magic, docs, self.n_ids, n_blocks, self.n_words, n_sizes, self.block = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        numbers = np.frombuffer(file.read(8 * docs), np.int64).tolist()
        null = file.read(docs + -docs % 8)
        self.doc_ids = [None if null[k] else x for k, x in enumerate(numbers)]
        self.blocks = np.frombuffer(file.read(8 * n_blocks), np.int64)
        self.lengths = unpack(np.frombuffer(file.read(8 * n_sizes), np.uint64)).astype(np.int64)
        self.base = file.tell()
        if int(self.lengths.sum()) != self.n_ids:
            raise ValueError("the lengths do not add up to the ids")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` up to ``last`` of the file."""
        if last <= first:
            return np.zeros(0, np.uint64)
        low, high = first // self.block, -(-last // self.block)
        start = int(self.blocks[low])
        stop = int(self.blocks[high]) if high < len(self.blocks) else self.n_words
        self.file.seek(self.base + 8 * start)
        values = unpack(np.frombuffer(self.file.read(8 * (stop - start)), np.uint64))
        return values[first - low * self.block:last - low * self.block]


def _split(text: str) -> list[str]:
    """Chunks between the tokenizer's white space."""
    return [x for x in _BLANKS.split(text) if x] if _MORE.search(text) else text.split()


def _grouped(texts: pa.Array):
    """Parts of about GROUP_BYTES, so that a batch of long texts takes no more memory than its longest one."""
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield texts[a:b]


def _chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks, where those of each text begin and the last ones end), no text being null; chunks may be empty."""
    begin, end = texts.offset, texts.offset + len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[begin]:ends[end]]
    if ((data >= 28) & (data <= 31)).any():
        lists = pa.array([_split(x) for x in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    return _marks_apart(lists.values, np.asarray(lists.offsets, np.int64))


def _marks_apart(chunks: pa.Array, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """One mark behind a letter or digit is a chunk of its own: the tokenizer always cuts there."""
    if not len(chunks):
        return chunks, begins
    _, ends, data = chunks.buffers()
    ends = np.frombuffer(ends, np.int32)[chunks.offset:chunks.offset + len(chunks) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    sizes = np.diff(ends)
    at = np.flatnonzero(sizes > 1)
    at = at[_MARKS[data[ends[at + 1] - 1]]]
    last = data[ends[at + 1] - 2]
    before = np.where(sizes[at] > 2, data[ends[at + 1] - 3], 0)
    # Two bytes from U+00C0 to U+024F but \u00D7, \u00F7 and \u0130, whose lower case ends in a mark.
    two = (last >= 0x80) & (before >= 0xC3) & (before <= 0xC9) & ~((before == 0xC3) & (last & 0xDF == 0x97))
    two &= ~((before == 0xC4) & (last == 0xB0))
    at = at[_PLAIN[last] | two]
    cut = np.insert(ends, at + 1, ends[at + 1] - 1)
    return (pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), chunks.buffers()[2]),
            begins + np.searchsorted(at, begins))


class Known(dict):
    """Ids of chunks; a chunk that is missing is looked for among the older ones, then encoded."""

    def __init__(self, older: dict[str, bytes], encode):
        super().__init__()
        self.older = older
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = found = self.older.get(chunk) or self.encode(chunk)
        return found


class Chunks:
    """The library's tokenizer, called once per distinct chunk of text between white space.

    Most chunks are letters with marks around them. The tokenizer lowers and spells them byte by byte and
    cuts them there, so its model alone is asked for the letters.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenize = self.tokenizer.model.tokenize
        self.spelling: dict[str, str] = {}
        self.marks: dict[str, bytes] = {}
        self.known = Known({}, self.chunk)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def letters(self, word: str) -> bytes:
        """A word of letters is one piece of text for the tokenizer's model."""
        spelled = word.lower()
        if not word.isascii():  # ASCII letters are spelled as they are
            spelled = "".join([self.spelling.get(c) or self._spell(c) for c in spelled])
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _spell(self, char: str) -> str:
        self.spelling[char] = found = self.tokenizer.pre_tokenizer.pre_tokenize_str(char)[0][0]
        return found

    def chunk(self, chunk: str) -> bytes:
        """Letters and the marks around them are pieces of their own; anything else goes in whole."""
        if chunk.isascii() and chunk.isalpha():
            return self.letters(chunk)
        parts = _LETTERS.fullmatch(chunk)
        if parts is None:
            return self.plain(chunk).tobytes()
        before, word, after = parts.groups()
        if not before and not after:
            return self.letters(word)
        return self._marked(before) + self.known[word] + self._marked(after)

    def _marked(self, marks: str) -> bytes:
        if not marks:
            return b""
        if marks not in self.marks:
            if len(self.marks) > KNOWN_CHUNKS:
                self.marks.clear()
            self.marks[marks] = self.plain(marks).tobytes()
        return self.marks[marks]

    def encode_all(self, texts) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string(), from_pandas=True)
        return [x for part in _grouped(pc.fill_null(texts, "")) for x in self._encode(part)]

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > KNOWN_CHUNKS:
            self.known = Known(dict(self.known), self.chunk)
        chunks, begins = _chunked(texts.cast(pa.string()))
        coded = chunks.dictionary_encode()
        chunk = coded.indices.to_numpy()
        ids = [self.known[x] if x else b"" for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[chunk]
        stop = np.r_[0, np.cumsum(n)]
        found = flat[np.repeat(begin[chunk] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        cuts = (4 * stop[begins]).tolist()
        return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def tokenizer_text(path: str | None = None) -> str:
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return file.read()


_loaded: dict[int, Chunks] = {}


def encoder(spark: SparkSession, model: str):
    """A column function: text -> ids with the end id, 32-bit little-endian."""
    shared = spark.sparkContext.broadcast(model)
    end = np.uint32(END_ID).tobytes()

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        key = hash(shared.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Chunks(shared.value)
        return pa.array([x + end for x in _loaded[key].encode_all(texts)], pa.binary())

    return encode


def _write(batches, out: shards.ShardWriter, file_ids: int) -> None:
    shard, docs, parts, size = None, [], [], 0

    def close():
        nonlocal size
        if docs:
            ids = np.concatenate(parts)
            out.add(shard, ".s8b", file_bytes(docs, [len(x) for x in parts], ids), len(docs), len(ids))
        docs.clear(), parts.clear()
        size = 0

    for batch in batches:
        for row in batch.select(["doc_id", "ids", "shard"]).to_pylist():
            if row["shard"] != shard:
                close()
                shard = row["shard"]
            docs.append(row["doc_id"])
            parts.append(np.frombuffer(row["ids"], np.uint32))
            size += len(parts[-1])
            if size >= file_ids:
                close()
    close()


def write_tokens(docs: DataFrame, model: str | None = None) -> tuple[str, DataFrame]:
    """Folder and manifest (with ``start``: ids in all files before) of the token files of (doc_id, text)."""
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
    sizes = docs.select(doc_id, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    rows, count = shards.with_shard(docs.select(doc_id, text.alias("text")), sizes, "doc_id", "size",
                                    F.xxhash64("text"))
    rows = rows.select("doc_id", "shard", encoder(spark, model or tokenizer_text())("text").alias("ids"))
    folder, manifest = shards.write_shards(rows, count, ["doc_id", "ids"],
                                           partial(_write, file_ids=FILE_IDS), "tokens")
    # Shards first, then the files of each shard, so that no window sees all files.
    totals = manifest.groupBy("shard").agg(F.sum("items").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.join(totals, "shard").withColumn(
        "start", F.col("base") + F.coalesce(F.sum("items").over(within), F.lit(0))).drop("base")
    return folder, materialize(manifest, "tokens-starts")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])
GROUP_BLOCKS = 64  # blocks decoded at a time


def _read(row, file):
    tokens = TokenFile(file)
    ends = np.cumsum(tokens.lengths)
    crcs, doc, crc, at = [], 0, 0, 0
    step = GROUP_BLOCKS * tokens.block
    while at < tokens.n_ids:
        data = tokens.ids(at, min(at + step, tokens.n_ids)).astype("<u4").tobytes()
        offset, stop = at, at + len(data) // 4
        while doc < len(ends) and offset < stop:
            take = min(int(ends[doc]), stop)
            crc = zlib.crc32(data[4 * (offset - at):4 * (take - at)], crc)
            offset = take
            if take == ends[doc]:
                crcs.append(crc)
                doc, crc = doc + 1, 0
        at = stop
    yield pa.RecordBatch.from_pydict({
        "doc_id": tokens.doc_ids, "start": (row["start"] + ends - tokens.lengths).tolist(),
        "n_tokens": tokens.lengths.tolist(), "ids_crc32": crcs}, schema=READ)


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    return shards.read_shards(folder, manifest, _read,
                              "doc_id long, start long, n_tokens long, ids_crc32 long", ("start",))


@query("op6_token_binary")
def token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(*write_tokens(table(spark, sf_dir, "documents")))
