import gzip
import os

import duckdb
import pytest

from revstrand.llm import warc

PAGES = "page_id long, url string, html string, digest string, shard int"
LONG = "<html>" + "äöü text " * 40 + "</html>"


@pytest.fixture()
def pages():
    rows = [(i, f"http://x.example/{i}?q=a b\r\né", f"<p>{i} " + "lorem ipsum " * (i % 40) + "</p>") for i in range(120)]
    rows += [(1000 + i, "http://copy.example/", LONG) for i in range(40)] + [(500, None, LONG), (None, "http://n.example/", LONG)]
    rows += [(2000 + i, "http://short.example/", "short") for i in range(5)] + [(3000, "", None), (3001, "u", ""), (3002, "u", "x" * 99), (3003, "u", "x" * 99), (3004, "u", "y" * 100), (3005, "u", "y" * 100)]
    rows += [(4000, "http://again.example/", "again " * 30)] * 30 + [(4001, "r", "s")] * 3 + [(None, None, None), (5000, "u", "WARC/1.1\r\n\r\n\x1f\x8b \0" * 2000)]
    return rows


def frame(spark, rows, n=4):
    return spark.createDataFrame([(*x, "extra", 9) for x in rows], PAGES).repartition(n)


def said(df):
    return sorted(map(str, (tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect())))


def sql(spark, rows):
    con = duckdb.connect()
    pages = frame(spark, rows).select("page_id", "url", "html").toArrow()
    con.register("pages", pages)
    return sorted(map(str, con.execute(warc.ORACLE).fetchall()))


def files(path):
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".gz")}


def test_round_trip_equals_sql(spark, pages, tmp_path):
    at = f"file://{tmp_path}/a"
    named = warc.write_archives(frame(spark, pages), at, file_bytes=2500, shard_bytes=9000)
    listed = named.collect()
    assert len({r["shard"] for r in listed}) > 2 and max(r["no"] for r in listed) > 0  # several ranges, and files that were rolled
    got = warc.read_archives(spark, at)
    assert said(got) == sql(spark, pages)
    text = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert {v.decode() for v in text.values()} == {h or "" for _, _, h in pages}
    assert all(r["payload"] is None for r in got.where("record_type = 'revisit'").collect())
    assert {r["file"] for r in listed} == set(files(tmp_path / "a")) and sum(r["records"] for r in listed) == len(pages)
    assert sorted(os.listdir(tmp_path / "a")) == sorted([*files(tmp_path / "a"), "_manifest"])  # nothing temporary is left
    for name, body in files(tmp_path / "a").items():
        assert gzip.decompress(body).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert len(body) == next(r["n_bytes"] for r in listed if r["file"] == name)


def test_same_bytes_whatever_the_partitions(spark, pages, tmp_path):
    for name, n in (("a", 1), ("b", 7)):
        warc.write_archives(frame(spark, pages if n > 1 else pages[::-1], n), f"file://{tmp_path}/{name}", file_bytes=2500, shard_bytes=9000)
    assert files(tmp_path / "a") == files(tmp_path / "b")


def test_what_is_not_committed_is_not_read(spark, pages, tmp_path):
    at = f"file://{tmp_path}/a"
    os.makedirs(tmp_path / "a/_temporary-x")
    for name in ("_temporary-x/broken.tmp", "pages-000000-00000.warc.gz", "stray.warc.gz"):
        (tmp_path / "a" / name).write_bytes(b"half a file")
    warc.write_archives(frame(spark, pages), at)
    assert said(warc.read_archives(spark, at, payload=False)) == sql(spark, pages)
    with pytest.raises(FileExistsError):
        warc.write_archives(frame(spark, pages), at)


def test_damage_is_found(spark, pages, tmp_path):
    warc.write_archives(frame(spark, pages), f"file://{tmp_path}/a")
    name, body = next(iter(files(tmp_path / "a").items()))
    raw = gzip.decompress(body).replace(b"lorem ipsum", b"lorem ipsun", 1)
    with pytest.raises(ValueError, match="doesn't match"):
        [warc.parsed(raw[i:]) for i in [raw.find(b"WARC/1.1\r\nWARC-Type: response", max(raw.find(b"ipsun") - 700, 0))]]
    (tmp_path / "a" / name).write_bytes(body[: len(body) // 2])
    with pytest.raises(Exception, match="incomplete"):
        warc.read_archives(spark, f"file://{tmp_path}/a").collect()


def test_defined_cases(spark, tmp_path):
    named = warc.write_archives(frame(spark, []), f"file://{tmp_path}/e")
    assert named.collect() == [] and warc.read_archives(spark, f"file://{tmp_path}/e").collect() == []
    one = warc.write_archives(frame(spark, [(None, None, None)]), f"file://{tmp_path}/one")
    assert [r["records"] for r in one.collect()] == [1]
    r = warc.read_archives(spark, f"file://{tmp_path}/one").first()
    assert (r["page_id"], r["url"], r["payload_bytes"], r["record_type"], bytes(r["payload"])) == (None, "urn:page:None", 0, "response", b"")
