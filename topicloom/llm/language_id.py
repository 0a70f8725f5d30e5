"""Language identification with language-bitmask n-gram filters.

Training: words are counted per language over all labelled texts, their character n-grams (word ends
included) get a rate per language, and an n-gram belongs to every language where its rate is at least
MIN_RATE and MIN_SHARE of its highest rate. All memberships go into one bit-sliced Bloom filter: SLOTS
rows of one bit per language, PROBES rows per n-gram, so one AND of PROBES masks returns all languages
that contain the n-gram.

Prediction: the n-grams of a text are looked up, hits are counted per language (a popcount of the masks'
bit columns) and corrected for the filter's false positives; the language with most hits wins.

Size bounds: MIN_RATE bounds the n-grams of a language, SLOTS the filter that is broadcast.

Defined cases: null texts and texts without a letter give ``und`` with score 0, and so does every text if
nothing was learned; a text with letters of which no n-gram is known gets the language that was learned most,
with score 0; ties go to the first language by name; rows without a language or text teach nothing; repeated rows
count as often as they occur; other columns are ignored. Very long texts are taken whole; a word is looked up once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import CACHE_WORDS, bucket, gathered, kept, mixed, odd_keys, table
from topicloom.llm.registry import query
from topicloom.session import materialize

GRAMS = (1, 2, 3, 4)
MIN_RATE = 2e-6
MIN_SHARE = 0.05
SLOT_BITS = 20
PROBES = 3
MAX_LANGUAGES = 63
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEYS = odd_keys(max(GRAMS), seed=8)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, index of its word), words framed by a blank on both sides."""
    joined = " " + " ".join(words) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = chars == 32
    word = np.cumsum(blank) - 1  # the blank before a word belongs to it
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            count = len(chars) - n + 1
            if count <= 0:
                continue
            total = np.full(count, n, np.uint64)
            inner = np.ones(count, bool)
            for k in range(n):
                total += chars[k:k + count] * _KEYS[k]
                if n == 1 or 0 < k < n - 1:
                    inner &= ~blank[k:k + count]
            if n == 2:
                inner &= ~(blank[:count] & blank[1:])
            hashes.append(mixed(total[inner]))
            owners.append(word[:count][inner])
    return np.concatenate(hashes), np.concatenate(owners)


def split_words(text: str) -> list[str]:
    return text.lower().split()


def _train_words(batches):
    counts: dict[tuple[str, str], int] = {}

    def taken():
        frame = pd.DataFrame({"lang": [k[0] for k in counts], "word": [k[1] for k in counts],
                              "n": list(counts.values())})
        counts.clear()
        return frame

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            for word in split_words(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        if len(counts) > CACHE_WORDS:
            yield taken()
    if counts:
        yield taken()


def _train_grams(batches):
    for batch in gathered(batches):
        for lang, part in batch.groupby("lang"):
            grams, owners = word_grams(part["word"].tolist())
            weight = part["n"].to_numpy()[owners]
            distinct, place = np.unique(grams, return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": distinct.view(np.int64),
                                "n": np.bincount(place, weight).astype(np.int64)})


@dataclass
class Model:
    """The filter, the languages of its bits and each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    false_hits: np.ndarray
    usual: str = UNKNOWN  # the language that most of what was learned is in

    @property
    def key(self) -> int:
        """Tells models apart, also those that follow each other in a worker."""
        return xxhash.xxh64_intdigest(repr((self.languages, self.usual, self.false_hits.tolist())).encode()
                                      + self.slots.tobytes())

    def masks(self, grams: np.ndarray) -> np.ndarray:
        found = np.full(len(grams), -1, np.int64)
        for probe in range(PROBES):
            found &= self.slots[slot_of(grams, probe)]
        return found


def slot_of(grams: np.ndarray, probe: int) -> np.ndarray:
    return ((grams >> np.uint64(20 * probe)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on every labelled row of ``docs``."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    words = (rows.mapInPandas(_train_words, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    grams = materialize(words.mapInPandas(_train_grams, "lang string, gram long, n long")
                        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n"))
              .orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(totals)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"at most {MAX_LANGUAGES} languages fit the bit mask")
    slots = np.zeros(1 << SLOT_BITS, np.int64)
    if not languages:
        return Model([], slots, np.zeros(0))
    total = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("lang"))
    bit = F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(languages)
                                      for x in (name, 1 << k))), F.col("lang")).cast("long")
    rated = grams.withColumn("rate", F.col("n") / total).filter(F.col("rate") >= MIN_RATE)
    top = rated.groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("rate", bit.alias("bit"))).alias("all"))
    mask = F.aggregate(F.filter("all", lambda x: x["rate"] >= MIN_SHARE * F.col("top")),
                       F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bit"]))
    probes = F.array(*(F.shiftrightunsigned("gram", 20 * k).bitwiseAND((1 << SLOT_BITS) - 1)
                       for k in range(PROBES)))
    filled = (top.select(mask.alias("mask"), F.explode(probes).alias("slot"))
              .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow())  # 2 ** SLOT_BITS rows at most
    slots[filled["slot"].to_numpy()] = filled["mask"].to_numpy()
    fill = np.array([np.count_nonzero(slots >> k & 1) for k in range(len(languages))]) / len(slots)
    return Model(languages, slots, fill ** PROBES, max(languages, key=lambda x: totals[x]))


def _hits(model: Model, words: list[str]) -> np.ndarray:
    """Per word: its n-grams, hits per language, and whether it has a letter."""
    grams, owners = word_grams(words)
    masks = model.masks(grams)
    columns = [np.bincount(owners, minlength=len(words))[:len(words)]]
    columns += [np.bincount(owners, masks >> k & 1, len(words))[:len(words)]
                for k in range(len(model.languages))]
    columns.append(np.fromiter((_LETTER.search(w) is not None for w in words), bool, len(words)))
    return np.column_stack(columns).astype(np.float64)


def _predict_batch(model: Model, texts: list[str | None], cache: dict) -> tuple[list[str], list[float]]:
    split = [split_words(t) if t else [] for t in texts]
    fresh = list({w for words in split for w in words}.difference(cache.get("place", ())))
    if len(cache.get("place", ())) + len(fresh) > CACHE_WORDS:
        cache.clear()
        fresh = list({w for words in split for w in words})
    place = cache.setdefault("place", {})
    if fresh:
        rows = _hits(model, fresh)
        start = len(place)
        place.update(zip(fresh, range(start, start + len(fresh))))
        if "rows" not in cache or len(cache["rows"]) < len(place):
            grown = np.zeros((2 * len(place), rows.shape[1]))
            if start:
                grown[:start] = cache["rows"][:start]
            cache["rows"] = grown
        cache["rows"][start:start + len(fresh)] = rows
    names, scores = [], []
    for words in split:
        name, score = UNKNOWN, 0.0
        if words and model.languages:
            total = cache["rows"][np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(0)
            if total[-1]:
                share = (total[1:-1] / total[0] - model.false_hits) / (1 - model.false_hits)
                best = int(np.argmax(share))
                name = model.usual
                if share[best] > 0:
                    name, score = model.languages[best], float(min(1.0, share[best]))
        names.append(name)
        scores.append(score)
    return names, scores


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    shared, key = spark.sparkContext.broadcast(model), model.key

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: pd.Series) -> pd.DataFrame:
        names, scores = _predict_batch(shared.value, batches.tolist(), kept("language", key, dict))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the id as text is not 1 modulo 3."""
    return docs.filter(F.coalesce(bucket(F.col("doc_id"), 3) != 1, F.lit(True)))


def identify(docs: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """All rows and columns plus ``lang_pred`` and ``score``, which take the place of columns of these names."""
    text = F.col("text") if text is None else text
    kept = [docs[c] for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn("__lang", predictor(docs.sparkSession, model)(text.cast("string"))).select(
        *kept, "__lang.lang_pred", F.col("__lang.score").alias("score"))


def keep_identified(docs: DataFrame, labelled: DataFrame, min_score: float = 0.2) -> DataFrame:
    """Documents whose language is recognised with at least ``min_score``."""
    model = learn(training_rows(labelled))
    sure = predictor(docs.sparkSession, model)(F.col("text").cast("string"))
    return (docs.withColumn("__lang", sure)
            .filter((F.col("__lang.lang_pred") != UNKNOWN) & (F.col("__lang.score") >= min_score))
            .drop("__lang"))


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(training_rows(docs))
    held_out = F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out, "lang_pred", "score")
