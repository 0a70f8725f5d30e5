"""Spelling variants: words that differ by one code point, found along a trie kept as a table of edges.

Steps, all exact:

1. ``word_counts``: one pass counts words per task, one shuffle of (word, n) adds them up.
2. ``trie``: two tries, of the words and of the words read backwards, as one table of edges. Only nodes where
   words part are kept, so an edge carries the letters up to the next such node (or to the end of its word) and
   a long word makes few edges. A node is named by its prefix, a long one by a 128-bit digest of it.
3. ``frontier``: states (word, node, rest of the word, edits) start at the first node in the second half of
   their word, in either trie, and are joined with the edges of their node level by level. Without an edit a
   state goes on along its own word, and at every other edge it spends its edit: the letter is inserted, or
   put in place of the next one if it is larger (the other half of the pairs is found from the other word).
   With its edit spent it follows its own letters only. A state that reaches the end of a word with nothing
   left has found a neighbour. Two near words share the first or the last half, and they part at a node, so no
   pair is missed.
4. ``spelling_groups``: the near word of largest count becomes a word's form if it is at least RATIO times as
   frequent; forms are followed to the root by doubling.

What a step joins is bounded by the alphabet: a node has at most one edge per letter. A frontier of proven
small size is broadcast; any other one is shuffled with the edges, and AQE splits nodes that many states share.

Defined cases: null, empty or letterless texts have no words; a null ``doc_id`` counts as an empty one in the
query's rule; rows that repeat are counted as often as they occur; a word without near words has n_near 0 and is
its own root; ties of forms go to the smaller word; an empty table gives no rows; other columns are ignored.
A text is taken whole; one of any length needs memory for its distinct words only besides itself.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import table
from topicloom.llm.registry import query
from topicloom.session import materialize, maybe_broadcast

LEAST_LETTERS = 5  # fixed value: code points of the shortest word
LEAST_COUNT = 3  # fixed value: occurrences of the rarest word
RATIO = 2  # fixed value: how much more frequent a form is
DROP_ONE_IN = 97  # fixed value: the query's rule for leaving a letter out

HELD_WORDS = 200_000  # distinct words, and
HELD_LETTERS = 4_000_000  # letters of them, that a task counts before it hands them on
PLAIN_PREFIX = 32  # letters of a prefix that names its node itself
ROWS = 20_000
END = -1  # instead of a letter: a word ends at the node

# Letters are A-Z (lowered), a-z and U+00C0 to U+00FF; Latin-1 has a byte for each of them.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
PREFIXES = pa.schema([("key", pa.string()), ("backward", pa.bool_()), ("depth", pa.int32()),
                      ("node", pa.string()), ("next", pa.int32())])


def letter_runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lowered, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def planted(run: bytes, start: int) -> bytes:
    """The query's rule: a run whose checksum DROP_ONE_IN divides loses one letter."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DROP_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _as_is(run: bytes, start: int) -> bytes:
    return run


def _counter(change):
    def count(batches):
        held, letters = Counter(), 0

        def out():
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()),
                                               pa.array(held.values(), pa.int64())], schema=COUNTS)

        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                start = zlib.crc32(b":" if key is None else b"%d:" % key)
                runs = Counter(r for r in letter_runs(text.as_py()) if len(r) >= LEAST_LETTERS)
                for run, n in runs.items():
                    word = change(run, start)
                    if len(word) >= LEAST_LETTERS:
                        if word not in held:
                            letters += len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield out()
                    held, letters = Counter(), 0
        if held:
            yield out()

    return count


def word_counts(docs: DataFrame, change=_as_is) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = runs.mapInArrow(_counter(change), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _starts(length: int) -> tuple[int, int]:
    """Depth from which a word looks for others in the forward and in the backward trie."""
    return length // 2, length - length // 2


def _prefix_rows(batches):
    """Every prefix of the deeper half of each word, in both tries, with the letter behind it."""
    rows = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PREFIXES)],
                                          schema=PREFIXES)

    for batch in batches:
        for key, word in zip(batch["key"].to_pylist(), batch["word"].to_pylist()):
            # A word one letter shorter looks for this one from its own half on.
            for backward, least in enumerate(_starts(len(word) - 1)):
                letters = word[::-1] if backward else word
                mark = "<" if backward else ">"
                digest = hashlib.blake2b(letters[:max(least, PLAIN_PREFIX)].encode(), digest_size=16)
                for depth in range(least, len(word) + 1):
                    if depth > PLAIN_PREFIX:
                        if depth > least:
                            digest.update(letters[depth - 1].encode())
                        node = f"{mark}#{depth}#{digest.hexdigest()}"
                    else:
                        node = mark + letters[:depth]
                    after = ord(letters[depth]) if depth < len(word) else END
                    rows.append((key, bool(backward), depth, node, after))
                    if len(rows) >= ROWS:
                        yield out()
                        rows.clear()
    if rows:
        yield out()


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (node, next, label, child, ends) of both tries, and the first state of each word in either.

    ``label`` are the letters up to the next node where words part, ``child``; on the last edge of a word
    there is no child and ``ends`` is the word. Where a word ends at a node it has an edge without letters.
    """
    # A long word is named by a digest here, so that its prefixes do not each carry it.
    name = F.when(F.length("word") <= PLAIN_PREFIX, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))
    named = words.select(name.alias("key"), "word")
    prefixes = named.mapInArrow(
        _prefix_rows, "key string, backward boolean, depth int, node string, next int")
    parting = (prefixes.groupBy("node").agg(F.min("next").alias("x"), F.max("next").alias("y"))
               .where("x <> y").select("node"))
    # The nodes on a word's way, in order; their number is bounded by the length of the word.
    way = (prefixes.join(parting, "node", "left_semi").groupBy("key", "backward")
           .agg(F.sort_array(F.collect_list(F.struct("depth", "node", "next"))).alias("way"))
           .join(named, "key").drop("key"))
    letters = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    way = materialize(way.withColumn("letters", letters), "spelling-ways")
    step = way.select("*", F.posexplode("way").alias("i", "at")).select(
        "word", "letters", "at", F.get("way", F.col("i") + 1).alias("to"))
    upto = F.coalesce(F.col("to.depth"), F.length("letters"))
    edges = step.select(
        F.col("at.node").alias("node"), F.col("at.next").alias("next"),
        F.substr("letters", F.col("at.depth") + 1, upto - F.col("at.depth")).alias("label"),
        F.col("to.node").alias("child"), F.when(F.col("to").isNull(), F.col("word")).alias("ends"))
    # All words along an edge agree on it.
    edges = edges.groupBy("node", "next").agg(*[F.min(c).alias(c) for c in ("label", "child", "ends")])
    size = F.length("letters")
    half = F.floor(size / 2)
    least = F.when(F.col("backward"), size - half).otherwise(half)
    first = F.get(F.filter("way", lambda p: p["depth"] >= least), F.lit(0))
    starts = way.select("word", first.alias("p"), "letters").where("p IS NOT NULL").select(
        "word", F.col("p.node").alias("node"), F.expr("substr(letters, p.depth + 1)").alias("rest"),
        F.lit(0).alias("edits"))
    return materialize(edges, "spelling-edges"), starts


def _moves(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, node, rest, edits, near): every state one edge further; ``near`` where a word was reached."""
    met = states.join(edges, "node")
    letter = F.coalesce(F.ascii(F.expr("substr(rest, 1, 1)")), F.lit(0))
    letter = F.when(F.col("rest") == "", F.lit(END)).otherwise(letter)
    spends = (F.col("edits") == 0) & (F.col("next") != letter)
    # What has to lie ahead: the label from its first letter on, or behind the letter the edit is spent on.
    ahead = F.when(spends, F.expr("substr(label, 2)")).otherwise(F.col("label"))
    same, insert, replace = F.lit(0), F.lit(1), F.lit(2)
    kinds = F.when(F.col("next") == letter, F.array(same)).when(
        spends & (F.col("next") != END),
        F.when((F.col("rest") != "") & (F.col("next") > letter), F.array(insert, replace))
        .otherwise(F.array(insert))).otherwise(F.array().cast("array<int>"))
    tried = met.select("word", "child", "ends", "edits", "rest", ahead.alias("ahead"),
                       F.explode(kinds).alias("kind"))
    left = F.when(F.col("kind") == replace, F.expr("substr(rest, 2)")).otherwise(F.col("rest"))
    tried = tried.withColumn("left", left).where(F.startswith("left", "ahead"))
    tried = tried.select(
        "word", F.col("child").alias("node"), F.expr("substr(left, length(ahead) + 1)").alias("rest"),
        F.greatest("edits", F.when(F.col("kind") == same, 0).otherwise(1)).alias("edits"), "ends")
    # Without a child the edge leads to the end of a word; a state's own word is no neighbour.
    found = F.col("node").isNull() & (F.col("rest") == "") & (F.col("edits") == 1)
    return tried.where(F.col("node").isNotNull() | found).withColumn(
        "near", F.when(found, F.col("ends"))).drop("ends")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words that differ by one code point, both ways round."""
    edges, states = trie(words)
    found = None
    while True:
        moved = materialize(_moves(maybe_broadcast(states), edges), "spelling-frontier")
        hits = moved.where("near IS NOT NULL").select("word", "near")
        found = hits if found is None else found.union(hits)
        states = moved.where("near IS NULL").drop("near")
        if not states.limit(1).count():
            break
    return found.union(found.select("near", "word")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Counts at least double on the way, so ways are short."""
    here = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = here.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(here.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots")
        if not step.where("moved").limit(1).count():
            return step.drop("moved")
        here = step.drop("moved")


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, n, form, root, n_near, form_n for a table of distinct words and their counts."""
    words = materialize(words.select("word", "n"), "spelling-words")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near_pairs(words).join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    top_n = -F.col("top.less")
    good = top_n >= RATIO * F.col("n")
    known = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("top.near")).alias("form"), F.when(good, top_n).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
p AS (SELECT doc_id, run, count(*) AS times FROM t WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT *, list_transform(string_split(doc_id || ':' || run, ''), lambda c: ord(c)) AS points FROM p),
y AS (SELECT run, times, flatten(list_transform(points, lambda c:
        CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS bytes FROM b),
z AS (SELECT run, times, list_concat([4294967295::BIGINT], flatten(list_transform(bytes, lambda x:
        list_transform(range(8), lambda k: (x::BIGINT >> k::INTEGER) & 1)))) AS bits FROM y),
h AS (SELECT run, times, xor(list_reduce(bits, lambda c, bit:
        xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295::BIGINT) AS h FROM z),
r AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
      times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM r WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
i AS (SELECT word, unnest(range(length(word))) AS i FROM w),
d AS (SELECT word, i, word[:i] AS x, word[i + 2:] AS y FROM i),
e AS (SELECT d.word, w.word AS near FROM d JOIN w ON d.x || d.y = w.word
      UNION SELECT a.word, b.word FROM d a JOIN d b USING (i, x, y) WHERE a.word <> b.word),
m AS (SELECT word, near FROM e UNION SELECT near, word FROM e),
f AS (SELECT m.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n
      FROM m JOIN w ON w.word = m.near GROUP BY m.word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
      CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN f USING (word)),
s AS (SELECT word, word AS at FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.at
      WHERE g.form IS NOT NULL)
SELECT g.word, g.form, s.at AS root, g.n, g.n_near, g.form_n
FROM g JOIN s USING (word) JOIN g AS last ON last.word = s.at AND last.form IS NULL
"""


@query("op11_spelling_variants", ORACLE)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(table(spark, sf_dir, "documents"), planted))
