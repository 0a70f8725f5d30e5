"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

All pieces of a model go into one automaton. It reads a segment once; at each position its output links
give every piece that ends there, and each piece relaxes the best way to reach the position:

* models with log probabilities: the way with the highest sum of scores wins;
* models whose scores are merge ranks (BPE): a sum of ranks does not give their segmentation, as they
  merge pairs greedily. There a piece may only follow a way whose last piece stays separate from it when
  the two are merged by rank; the text then has exactly one such way, the model's own encoding.

Characters without a piece become byte pieces. Blanks are written as U+2581 and one is put in front of
the text. No piece crosses from a character to a following blank, so a text is encoded segment by segment
(blanks and the word after them), and segments already seen are looked up.

Defined cases: null and empty texts have no pieces and decode to the empty string; lone surrogates are
replaced as in UTF-8 output; control pieces in a text are ordinary text; U+2581 in a text decodes to a
blank; repeated rows get equal ids; an empty table gives no rows; other columns pass through. A very long text,
also one without a blank, is taken whole: it needs memory in proportion to its characters and pieces.
"""

from __future__ import annotations

import re
import sys
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import kept, table
from topicloom.llm.registry import query

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
KNOWN_SEGMENTS = 200_000  # segments a worker remembers, and as many it met before those
KNOWN_PAIRS = 400_000
PORTION_CHARS = 300_000  # characters that one run of the automaton takes; it holds about 250 bytes for each
TEXT_PORTIONS = 8  # texts are split in runs of so many portions
FIRST = np.iinfo(np.int64).min
NEVER = -np.inf
END = (NEVER, None)  # no further merge
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_MARKS = re.compile(r"(.*\w)(\W+)\Z", re.S)  # a word and the marks behind it
_BYTE = re.compile(r"^<0x([0-9A-F]{2})>$")


def _segments(text: str) -> list[str]:
    if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
        return _SEGMENT.findall(BLANK + text.replace(" ", BLANK))
    return (BLANK + text.replace(" ", " " + BLANK)).split(" ")


def _portions(segments: list[str], chars: int):
    part, size = [], 0
    for segment in segments:
        part.append(segment)
        size += len(segment or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class Pieces:
    """Vocabulary and automaton of a model file.

    ``remember`` is how many segments are kept, and as many older ones. Pairs, portions and the texts split at
    a time shrink with it; it costs time only.
    """

    def __init__(self, model: bytes, remember: int | None = None):
        self.remember = remember or KNOWN_SEGMENTS
        self.pairs = min(KNOWN_PAIRS, 2 * self.remember)
        self.portion = min(PORTION_CHARS, self.remember) if remember else PORTION_CHARS
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.scores = [sp.get_score(k) for k in range(len(self.names))]
        self.unknown = sp.unk_id()
        self.bytes = {}
        self.ids = {}
        for k, name in enumerate(self.names):
            if sp.is_byte(k):
                self.bytes[int(_BYTE.match(name).group(1), 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.ids[name] = k
        of_byte = {k: bytes([b]) for b, k in self.bytes.items()}
        self.raw = [of_byte.get(k) or name.encode() for k, name in enumerate(self.names)]
        # Merge ranks are whole numbers, log probabilities are not.
        self.merges = all(self.scores[k].is_integer() for k in self.ids.values())
        self.lengths = np.array([len(x) for x in self.names])
        self.weights = np.array(self.scores)
        self.ranks = {name: self.scores[k] for name, k in self.ids.items()}
        self.made: dict[int, tuple[list, list] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for name, k in self.ids.items():
            if len(name) > 1:  # single characters need no search
                self.automaton.add_word(name, k)
        # By code point: its piece, or -1 - code point.
        self.single = -1 - np.arange(sys.maxunicode + 1)
        for name, k in self.ids.items():
            if len(name) == 1:
                self.single[ord(name)] = k
        self.neighbours = {name[k:k + 2] for name in self.ids for k in range(len(name) - 1)}
        self.automaton.make_automaton()
        self.separate: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merges_of(self, piece: int) -> tuple[list, list] | None:
        """The merges by rank, best first and leftmost of equals, that make a piece of its characters: the score of
        each with the last part after it, and with the first part after it. None if they end with several parts."""
        if piece not in self.made:
            parts, lasts, firsts = list(self.names[piece]), [], []
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    score = self.ranks.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, k
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                lasts.append((best, parts[-1]))
                firsts.append((best, parts[0]))
            lasts.append(END)
            firsts.append(END)
            self.made[piece] = (lasts, firsts) if len(parts) == 1 else None
        return self.made[piece]

    def stays_separate(self, code: int) -> bool:
        """Whether merging two pieces by rank ends with just these two.

        Until a merge takes a part of each, both are merged as if alone, the better merge first. It comes when the
        parts that meet make a better one than the next merge of either side.
        """
        left, right = code >> 32, code & 0xFFFFFFFF
        a, b = self.merges_of(left), self.merges_of(right)
        if a is None or b is None:
            return False
        lasts, firsts = iter(a[0]), iter(b[1])
        last, first = self.names[left][-1], self.names[right][0]
        (a_score, a_next), (b_score, b_next) = next(lasts), next(firsts)
        find = self.ranks.get
        while True:
            both = find(last + first, NEVER)
            if both > a_score and both >= b_score:
                return False
            if a_score >= b_score:  # of equal merges the left one is first
                if a_next is None:
                    return True
                last = a_next
                a_score, a_next = next(lasts)
            else:
                first = b_next
                b_score, b_next = next(firsts)

    def spelled(self, char: str) -> tuple[int, ...]:
        data = char.encode("utf-8", "replace")
        if self.bytes:
            return tuple(self.bytes[b] for b in data)
        return (self.unknown,)

    def _ways(self, joined: str, sizes: np.ndarray):
        """Arcs of all segments: (node where it begins, node where it ends, piece), by end within a
        segment, longest first. A character without a piece is an arc of its own, -1 - code point."""
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64)
        ends, pieces = found[::2] + 1, found[1::2]
        begins = ends - self.lengths[pieces]
        inside = np.ones(len(chars), bool)
        inside[np.cumsum(sizes + 1)[:-1] - 1] = False  # the separators
        at = np.flatnonzero(inside)
        begins, ends = np.r_[begins, at], np.r_[ends, at + 1]
        pieces = np.r_[pieces, self.single[chars[at]]]
        first = np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        offset = ends - first[begins]
        order = np.lexsort((begins, ends, offset))
        return begins[order], ends[order], pieces[order], offset[order]

    def viterbi(self, segments: list[str]) -> list[bytes]:
        """Best pieces of each segment as packed ids; all segments advance together, each in one pass."""
        sizes = np.array([len(x) for x in segments])
        begins, ends, pieces, offset = self._ways("\0".join(segments), sizes)
        heads = np.cumsum(sizes + 1) - sizes - 1
        nodes = int(sizes.sum() + len(sizes))
        score = np.full(nodes, -np.inf)
        score[heads] = 0.0
        back, last = np.zeros(nodes, np.int64), np.full(nodes, FIRST, np.int64)
        weight = np.where(pieces < 0, -1e6, self.weights[np.maximum(pieces, 0)])
        cuts = np.r_[np.flatnonzero(np.r_[True, offset[1:] != offset[:-1]]), len(offset)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            b, e, p = begins[low:high], ends[low:high], pieces[low:high]
            total = score[b] + (0.0 if self.merges else weight[low:high])
            open_ = np.flatnonzero(total > -np.inf)
            if self.merges:
                open_ = open_[self._separate(last[b[open_]], p[open_])]
            # The best arc into each node; arcs of equal score keep their order, longest first.
            best = open_[np.lexsort((-total[open_], e[open_]))]
            best = best[np.r_[True, e[best][1:] != e[best][:-1]]] if len(best) else best
            score[e[best]], back[e[best]], last[e[best]] = total[best], b[best], p[best]
        return self._paths(heads, heads + sizes, back, last)

    def _separate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        both = (left >= 0) & (right >= 0)
        out = np.ones(len(left), bool)
        codes, place = np.unique((left[both] << 32) | right[both], return_inverse=True)
        codes = codes.tolist()
        if len(self.separate) > self.pairs:
            self.separate.clear()
        for code in codes:
            if code not in self.separate:
                self.separate[code] = self.stays_separate(code)
        out[both] = np.fromiter(map(self.separate.__getitem__, codes), bool, len(codes))[place]
        return out

    def _paths(self, heads, tails, back, last) -> list[bytes]:
        # Ways are followed back together; only those not yet at their head take a step, so what is held is
        # as much as there are pieces, however long the longest segment is.
        steps, at, live = [], tails.copy(), np.flatnonzero(tails > heads)
        while len(live):
            steps.append((live, last[at[live]]))
            at[live] = back[at[live]]
            live = live[at[live] > heads[live]]
        if not steps:
            return [b""] * len(heads)
        counts = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(heads))
        ids, place = np.empty(int(counts.sum()), np.int64), np.cumsum(counts)
        for x, pieces in steps:
            place[x] -= 1
            ids[place[x]] = pieces
        spelled = np.bincount(np.repeat(np.arange(len(counts)), counts), ids < 0, len(counts)) > 0
        data, stops = ids.astype(np.int32).tobytes(), (np.cumsum(counts) * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *stops[:-1]], stops)]
        for k in np.flatnonzero(spelled):
            parts = np.frombuffer(out[k], np.int32).tolist()
            flat = [i for c in parts for i in ((c,) if c >= 0 else self.spelled(chr(-1 - c)))]
            out[k] = np.array(flat, np.int32).tobytes()
        return out

    def encode_all(self, texts) -> list[np.ndarray]:
        """Piece ids of each text."""
        return [ids for part in _portions(texts, TEXT_PORTIONS * self.portion) for ids in self._encode(part)]

    def _encode(self, texts) -> list[np.ndarray]:
        split = [_segments(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.known)
        if len(self.known) > self.remember:
            # What is met again moves over from the older half; the rest is forgotten.
            self.older, self.known = self.known, {}
            fresh = set().union(*split)
        again = fresh.intersection(self.older)
        self.known.update((x, self.older[x]) for x in again)
        fresh -= again
        # No piece holds the two characters around such a cut, so both sides are encoded by themselves.
        cut = {x: (m.group(1), m.group(2)) for x in fresh
               if (m := _MARKS.match(x)) and x[m.end(1) - 1:m.end(1) + 1] not in self.neighbours}
        fresh.difference_update(cut)
        fresh.update(part for both in cut.values() for part in both if part not in self.known)
        for part in _portions(sorted(fresh, key=len), self.portion):
            self.known.update(zip(part, self.viterbi(part)))
        self.known.update((x, self.known[a] + self.known[b]) for x, (a, b) in cut.items())
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, segments)), np.int32) for segments in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def model_bytes(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(MODEL), "rb") as file:
        return file.read()


def _pieces(shared, remember: int | None = None) -> Pieces:
    """One vocabulary per worker process."""
    data = shared.value
    return kept("pieces", (hash(data), remember), lambda: Pieces(data, remember))


def _listed(rows: list[np.ndarray]) -> pa.Array:
    """Arrow lists of the ids, without a Python object for each id."""
    stops = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    flat = pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32())
    if stops[-1] > np.iinfo(np.int32).max:
        return pa.LargeListArray.from_arrays(stops, flat)
    return pa.ListArray.from_arrays(stops.astype(np.int32), flat)


def _unlisted(ids: pa.Array) -> list[list[int]]:
    """The ids of each row, none for a null."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
    stops = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]


def encoder(spark: SparkSession, model: bytes):
    """A column function: text -> array of piece ids."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _listed(_pieces(shared).encode_all(texts.to_pylist()))

    return encode


def decoder(spark: SparkSession, model: bytes):
    """A column function: array of piece ids -> text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array(map(_pieces(shared).decode, _unlisted(ids)), pa.string())

    return decode


def coder(spark: SparkSession, model: bytes, remember: int | None = None):
    """A column function: text -> its piece ids and the text decoded from them. Spark evaluates a function as often
    as others take its result, so a decoder on top of an encoder would have each text encoded twice."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("ids array<int>, decoded string")
    def code(texts: pa.Array) -> pa.Array:
        pieces = _pieces(shared, remember)
        ids = pieces.encode_all(texts.to_pylist())
        decoded = pa.array((pieces.decode(x.tolist()) for x in ids), pa.string())
        return pa.StructArray.from_arrays([_listed(ids), decoded], ["ids", "decoded"])

    return code


def add_ids(docs: DataFrame, model: bytes | None = None, text: str = "text", into: str = "piece_ids") -> DataFrame:
    """All rows and columns plus the piece ids of the text."""
    return docs.withColumn(into, encoder(docs.sparkSession, model or model_bytes())(
        F.col(text).cast("string")))


def add_text(rows: DataFrame, model: bytes | None = None, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """All rows and columns plus the text of the piece ids."""
    return rows.withColumn(into, decoder(rows.sparkSession, model or model_bytes())(F.col(ids)))


def add_ids_and_text(docs: DataFrame, model: bytes | None = None, text: str = "text", ids: str = "piece_ids",
                     into: str = "decoded", remember: int | None = None) -> DataFrame:
    """What ``add_text(add_ids(docs))`` gives, each text encoded once. ``remember``: see ``Pieces``."""
    both = coder(docs.sparkSession, model or model_bytes(), remember)(F.col(text).cast("string"))
    return docs.withColumn("__coded", both).withColumns(
        {ids: F.col("__coded.ids"), into: F.col("__coded.decoded")}).drop("__coded")


def encode_and_check(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_pieces, piece_ids and whether decoding them gives the text back."""
    coded = add_ids_and_text(docs.select("doc_id", "text"), model)
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANK, " ")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids",
                        (F.col("decoded") == plain).alias("round_trip"))


@query("op2_sentencepiece")
def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"))
