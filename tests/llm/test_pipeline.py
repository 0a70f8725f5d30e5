import corpus_pipeline as cp
import pytest
from conftest import SF
from odd import documents, empty, plain
from test_decontaminate import brute as leaks
from test_jaccard import brute as groups

from topicloom.llm import pieces, quality
from topicloom.llm.common import table


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_each_stage_against_brute_force(spark, steps):
    docs, good, spoken, single, clean, coded = map(plain, steps)
    judged = plain(quality.judge(steps[0], into="why"))
    assert set(good.doc_id) == set(judged[judged.why.isna()].doc_id)
    assert set(spoken.doc_id) <= set(good.doc_id) and len(spoken) >= 0.98 * len(good)
    kept = {i for i, _, head in groups(list(zip(spoken.doc_id, spoken.text))) if i == head}
    assert set(single.doc_id) == kept and len(single) == len(kept)
    items = plain(table(spark, SF, "benchmark"))
    gone = single[~single.doc_id.isin(clean.doc_id)]
    assert len(gone) and all(any(leaks(t, x) for x in items.text) for t in gone.text)
    stay = clean.head(15)
    assert not any(leaks(t, x) for t in stay.text for x in items.text)
    model = pieces.Pieces(pieces.model_bytes())
    assert coded.round_trip.all() and set(coded.doc_id) == set(clean.doc_id)
    for i, text in zip(coded.doc_id[:20], coded.text[:20]):
        assert coded[coded.doc_id == i].piece_ids.iloc[0] == model.encode(text)


def test_columns_stay_until_the_last_stage(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_run_equals_the_stages(spark, steps):
    a, b = plain(cp.run(spark, SF)), plain(steps[-1])
    assert sorted(a.doc_id) == sorted(b.doc_id) and list(a.columns) == list(b.columns)


def test_odd_and_empty_tables(spark):
    for df in (documents(spark), empty(spark)):
        for _, stage in cp.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= df.count()
