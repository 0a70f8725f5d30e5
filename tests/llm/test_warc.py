import base64
import gzip
import hashlib
import io

import pytest
from compare import check, connect
from conftest import SF
from odd import plain
from pyspark.sql import types as T

from topicloom.llm import shards, warc
from topicloom.llm.registry import ORACLES, QUERIES

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType()), T.StructField("size", T.StringType()),
                       T.StructField("sha1", T.StringType()), T.StructField("refers_to", T.StringType())])

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "", ""),
         (5, "http://é/", "ü" * 200_000), (5, "http://é/", "ü" * 200_000), (7, "u", "ü" * 200_000),
         (None, "n", "<p>one</p>"), (None, "n", "only here"), (2**60 + 1, "big", "end\r\n\r\nWARC/1.1\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        head = first.get(html or "")
        revisit = head is not None and head != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("shard,roll", [(100, 300), (1 << 26, 1 << 23)])
def test_odd_pages(spark, monkeypatch, shard, roll):
    monkeypatch.setattr(shards, "SHARD_BYTES", shard)
    monkeypatch.setattr(warc, "ROLL_BYTES", roll)
    folder, manifest = warc.write_archives(pages(spark))
    assert got(warc.read_archives(folder, manifest)) == expected(PAGES)
    assert (manifest.count() > 2) == (shard == 100)


def test_every_record_has_an_id_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 100)
    rows = PAGES + [(None, None, "x")] * 3 + [(9, "u", "y"), (9, "v", "y"), (9, "u", "z")]
    folder, manifest = warc.write_archives(pages(spark, rows))
    store, path = shards.place(folder)
    heads = [warc.parse(data)[0] for r in manifest.collect()
             for _, data in warc.members(store.open_input_file(f"{path}/{r.name}"))]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(ids) == len(rows) + manifest.count()
    assert {h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h} <= {
        h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}


def test_equal_input_gives_equal_files(spark):
    def files(df):
        folder, manifest = warc.write_archives(df)
        store, path = shards.place(folder)
        return {r.name: store.open_input_file(f"{path}/{r.name}").read() for r in manifest.collect()}

    rows = [(k, f"http://x/{k}", f"<p>{k % 70}</p>" * 50) for k in range(300)]
    assert files(pages(spark, rows).repartition(7)) == files(pages(spark, rows[::-1]).coalesce(1))


def test_members_are_plain_gzip(spark):
    folder, manifest = warc.write_archives(pages(spark))
    store, path = shards.place(folder)
    data = b"".join(store.open_input_file(f"{path}/{r.name}").read() for r in manifest.collect())
    whole = gzip.decompress(data)
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES) + manifest.count() + 1  # one is in a payload
    assert [x for x in store.get_file_info(shards.fs.FileSelector(path)) if "_temporary" in x.path] == []


def test_broken_archives_are_refused():
    record = warc.member(warc.page_record(1, "u", b"abc", 3, warc.digest(b"abc"), None))
    row = {"name": "x"}
    assert sum(b.num_rows for b in warc._read(row, io.BytesIO(record))) == 1
    wrong = warc.member(warc.page_record(1, "u", b"abc", 3, warc.digest(b"abd"), None))
    with pytest.raises(ValueError, match="payload differs"):
        list(warc._read(row, io.BytesIO(wrong)))
    with pytest.raises(ValueError, match="within a record"):
        list(warc._read(row, io.BytesIO(record[:-5])))


def test_query_agrees_with_sql(spark):
    name = "op10_warc"
    assert check(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_empty_table(spark):
    assert plain(warc.read_archives(*warc.write_archives(pages(spark, [])))).empty
