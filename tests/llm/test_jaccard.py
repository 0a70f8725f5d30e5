import random

import numpy as np
import pytest
from compare import check, connect
from conftest import SF
from odd import documents, empty

from topicloom import session
from topicloom.llm import jaccard_join as jj
from topicloom.llm.registry import ORACLES, QUERIES


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)),
                  key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.linked_groups(df).collect()), key=str)


def corpus(seed, groups=12, size=25):
    """Near copies of different closeness, copies, a passage and a line many texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, number = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 300]))
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, len(text) // 40])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text += rng.choices(vocabulary, k=5)
            rows.append((number, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
            number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(documents(spark, rows)) == brute(rows)


def test_long_lists_and_chunks(spark, monkeypatch):
    """Everything is frequent: levels put the passage last, searches run in many chunks."""
    monkeypatch.setattr(jj, "CHUNK_SHINGLES", 2000)
    monkeypatch.setattr(jj, "STAR_ROUNDS", (1,))
    rows = corpus(7, groups=3, size=60)
    assert got(documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("seed", [11])
def test_links_by_long_lists_only(spark, monkeypatch, seed):
    """Lists of more than three nodes are no join keys: their links come from searching blocks."""
    monkeypatch.setattr(jj, "SHORT_LIST", 3)
    monkeypatch.setattr(jj, "BLOCK_NODES", 5)
    monkeypatch.setattr(jj, "STAR_ROUNDS", (1,))
    rows = corpus(seed, groups=8, size=30)
    searched = []
    search = jj.block_links

    def counted(*args):
        found = search(*args)
        searched.append(found.count())
        return found

    monkeypatch.setattr(jj, "block_links", counted)
    assert got(documents(spark, rows)) == brute(rows)
    assert len(searched) == 1


def test_few_rows_are_few_files(spark, monkeypatch):
    """Pairs, links and groups were written by each of all shuffle partitions, again and again."""
    made = []
    write = jj.materialize

    def counted(df, label):
        out = write(df, label)
        made.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    rows = corpus(1)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert got(documents(spark, rows)) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    few = [n for label, n in made if label.split("-")[1] in ("pairs", "wanted", "found", "labels")]
    assert few and max(few) <= spark.sparkContext.defaultParallelism
    assert len(made) < 40


def test_nothing_small_enough_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jj, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(jj, "maybe_broadcast", lambda df: df)
    rows = corpus(3, groups=6)
    assert got(documents(spark, rows)) == brute(rows)


def test_block_search_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(60, 120), replace=False),
                            rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)]) for _ in range(60)]
    frame = jj.pd.DataFrame({"node": range(60), "shingles": [x.tobytes() for x in sets]})
    got = {tuple(r) for r in jj._block_search(frame[:20], frame).itertuples(index=False)}
    assert got == {(a, b) for a in range(20) for b in range(60) if a != b
                   and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert got


def test_query_agrees_with_sql(spark):
    name = "op4_ngram_jaccard_join"
    assert check(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_occurrence_search():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(5000, 300, replace=False)).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(0, 300)), rng.integers(0, 5000, 50).astype(np.uint64)])
            for _ in range(80)]
    for floor in (1, 40, 150, 240):
        want = {k: n for k, s in enumerate(sets) if (n := len(np.intersect1d(base, s))) >= floor}
        assert jj.occurrence_search(base, sets, floor) == want


def test_edge_of_the_threshold(spark):
    words = [f"a{k}" for k in range(40)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:12])), (3, " ".join(words[:10])), (4, " ".join(words[:9])),
            (5, "one two"), (6, "one two"), (7, "one two three"), (8, "ONE\nTWO")]
    assert got(documents(spark, rows)) == brute(rows)


def test_odd_rows_and_one_of_each_group(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(df) == brute(rows)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 2**60 + 1, 2**60 + 3]
    assert ids.count(None) == 2


def test_rows_that_share_an_id_are_kept_by_text(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    c = " ".join(f"c{k}" for k in range(40))
    rows = [(1, a), (7, a), (7, b), (7, b), (9, b), (9, c), (None, c + " c0"), (None, "no id at all"),
            (None, "no id at all"), (3, ""), (3, None), (9, "other words")]
    kept = jj.keep_one(documents(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, a), (7, b), (9, c), (None, "no id at all"), (3, ""), (3, None), (9, "other words")], key=str)


def test_empty_table(spark):
    assert jj.linked_groups(empty(spark)).count() == 0
    assert jj.keep_one(empty(spark)).count() == 0


def listed_sets(texts):
    sets, keys = [], []
    for data, cuts in jj._grouped_texts(jj.pa.array(texts, jj.pa.string())):
        flat, stops = jj._shingled(data, cuts)
        sets += [flat[a:b].tolist() for a, b in zip(stops[:-1], stops[1:])]
        keys += jj._key(flat, stops).tolist()
    return sets, keys


@pytest.mark.parametrize("window, group", [(1, 1), (7, 50), (1 << 17, 1 << 19)])
def test_shingles_of_many_texts_at_once(monkeypatch, window, group):
    """No shingle runs from one text into the next, wherever the bytes are cut."""
    monkeypatch.setattr(jj, "WINDOW_BYTES", window)
    monkeypatch.setattr(jj, "GROUP_BYTES", group)
    rng = random.Random(window)
    texts = [None, "", " \n", "a", "A", "a b c d e", "a b c d e f", "e d c b a", "ab cd", "ba dc", "\x1c a", "x" * 700,
             "x" * 699 + "y", "x" * 300 + " b", *("".join(rng.choices("aAbé \n\x85", k=rng.randint(0, 80)))
                                                  for _ in range(60))]
    words = [(t or "").encode().lower().split() for t in texts]
    want = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    sets, keys = listed_sets(texts)
    assert [len(x) for x in sets] == [len(x) for x in want] and all(x == sorted(set(x)) for x in sets)
    for p, q in ((p, q) for p in range(len(texts)) for q in range(p)):
        assert len(set(sets[p]) & set(sets[q])) == len(want[p] & want[q])
        assert (keys[p] == keys[q]) == (want[p] == want[q])


def test_shingles_do_not_depend_on_what_a_worker_met_before():
    fresh = jj.odd_keys(256, seed=7)
    assert (jj._places(5000)[:256] == fresh).all()


def test_describing_takes_no_step_for_each_word(monkeypatch):
    """Words were hashed one by one in Python, most of what describing and postings took."""
    met = []
    monkeypatch.setattr("topicloom.llm.common.WordCache.__missing__", lambda self, word: met.append(word) or 1)
    batch = jj.pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d e f g", None]})
    rows = next(jj._describe([batch]))
    assert rows["n"].to_pylist() == [3, 0] and not met


def test_long_lists_stand_last_however_full_the_buckets_are(spark):
    """At some GB a list of 257 was taken for chance; all its nodes then met each other in blocks."""
    counts = np.full(1 << jj.SKETCH_BITS, 3000, np.int32)
    counts[7] += jj.SHORT_LIST + 1
    parts = [(k, jj.zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(counts, jj.SKETCH_BLOCKS))]
    levels = jj.rarity(spark.createDataFrame(parts, "block int, counts binary"))
    assert levels[7] > 0 and levels.sum() == levels[7]


def test_shuffle_files_go_with_the_step_that_made_them(spark, monkeypatch):
    """They stayed until the driver collected garbage, so all steps' files could lie on disk at once."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = (str(b).rpartition("/")[2] for b in _items(disk.getAllFiles()))
        return {n.split("_")[1] for n in names if n.startswith("shuffle_")}

    before, left, write = shuffles(), [], jj.materialize

    def counted(df, label):
        out = write(df, label)
        left.append((label, len(shuffles() - before)))
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    rows = corpus(1)
    assert got(documents(spark, rows)) == brute(rows)
    # Files of a small count that has just ended may still be on their way out.
    assert left and max(n for _, n in left) <= 3
    assert spark.conf.get(session.CLEANUP) == "false"


def _items(seq):
    each = seq.iterator()
    while each.hasNext():
        yield each.next()


def test_one_of_each_group_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(session, "fits_broadcast", lambda df, **limits: False)
    monkeypatch.setattr(jj, "fits_broadcast", lambda df: False)
    test_odd_rows_and_one_of_each_group(spark)
    test_rows_that_share_an_id_are_kept_by_text(spark)
    rows = corpus(3, groups=6)
    assert got(documents(spark, rows)) == brute(rows)


def test_only_rows_that_may_match_are_shuffled(spark, monkeypatch):
    """All texts were shuffled as soon as the ids looked for were too many for a broadcast."""
    monkeypatch.setattr(session, "fits_broadcast", lambda df, **limits: False)
    df = spark.range(20_000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id DIV 2 END AS k", "id AS v")
    keys = spark.range(0, 10_000, 10).withColumnRenamed("id", "k")
    rows = [(r.k, r.v) for r in df.collect()]
    want = {x for x in rows if x[0] is not None and x[0] % 10 == 0}
    among, rest = session.rows_among(df, keys, "k"), session.rows_not_among(df, keys, "k")
    assert among.columns == rest.columns == df.columns
    assert {tuple(r) for r in among.collect()} == want and among.count() == len(want)
    assert {tuple(r) for r in rest.collect()} == set(rows) - want and rest.count() == len(rows) - len(want)
    near = session._marked(df, keys, "k", "left").filter("__mark")
    assert len(want) <= near.count() < len(want) + 100
