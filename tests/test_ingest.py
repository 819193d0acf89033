"""Files, logs, labeled queries and pages."""

import pytest
from pyspark.sql import functions as F

from gleaner.sources import files, logs, pages, qrels

PNG = bytes.fromhex("89504e470d0a1a0a") + b"picture"
JPG = bytes.fromhex("ffd8ffe0") + b"photo"


def test_scan(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    (one / "deep").mkdir(parents=True), two.mkdir()
    (one / "arch.png").write_bytes(PNG), (one / "deep" / "copy.PNG").write_bytes(PNG), (one / "torn.jpg").write_bytes(b"blank")
    (one / "notes.txt").write_text("x"), (two / "arch2.png").write_bytes(PNG), (two / "pier.jpg").write_bytes(JPG), (two / "noext").write_bytes(PNG)
    scanned = files.scan_corpus(spark, [str(one), str(two)])
    got = {r.relpath: (r.status, (r.duplicate_of or "").rsplit("/", 1)[-1]) for r in scanned.collect()}
    assert got == {"arch.png": ("ok", ""), "deep/copy.PNG": ("duplicate", "arch.png"), "torn.jpg": ("unreadable", ""), "notes.txt": ("skipped", ""),
                   "arch2.png": ("duplicate", "arch.png"), "pier.jpg": ("ok", ""), "noext": ("skipped", "")}
    assert len(scanned.filter("relpath = 'pier.jpg'").first().id) == 16
    sources = spark.createDataFrame([(str(one),), (str(two),), ("gone",)], "source string")
    assert tuple(files.scan_report(scanned, sources).first()) == (2, 2, 2, 1, 1)


def _no_photos(content: bytes) -> bool:
    if b"photo" in content:
        raise ValueError("cannot decode")
    return True


def test_a_decoder_and_a_size_limit(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(PNG), (tmp_path / "b.jpg").write_bytes(JPG), (tmp_path / "big.png").write_bytes(PNG * 50)
    got = {r.relpath: r.status for r in files.scan_corpus(spark, [str(tmp_path)], readable=_no_photos, max_bytes=100).collect()}
    assert got == {"a.png": "ok", "b.jpg": "unreadable", "big.png": "unreadable"}


def test_formats(spark):
    heads = {"JPEG": "ffd8ffe1", "GIF": "474946383961", "WEBP": "524946460000000057454250", "BMP": "424d", "HEIF": "0000001866747970686569630000"}
    df = spark.createDataFrame([(k, bytes.fromhex(v) + b"\0" * 12) for k, v in heads.items()] + [(None, b"%PDF")], "want string, content binary")
    assert all(r.want == r.got for r in df.select("want", files.file_format(F.col("content")).alias("got")).collect())


def test_a_third_of_all_rows_is_one_content(spark):
    rows = [(n, "same" if n % 3 == 0 else f"t{n % 50}", n % 4) for n in range(900)]
    df = spark.createDataFrame(rows, "name int, key string, pos int")
    first = {}
    for n, k, p in sorted(rows, key=lambda r: (r[2], r[0])):
        first.setdefault(k, n)
    for r in files.dedup_by_content(df, "key", ["pos"], "name").collect():
        assert r.first == first[r.key] and r.is_duplicate == (r.name != r.first)


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "a", "value": 1}\n{"id": "b", "value": 2}\n\n{"id": "a", "value": 3}\n{"id": "b", "va')
    assert {(r.id, r.value) for r in logs.compact_log(spark, str(tmp_path / "log.jsonl"), "id string, value int").collect()} == {("a", 3), ("b", 2)}


def test_qrels(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("﻿query,expected\n 礁 ,a/arch.png；pier.png\nunknown,lost.png\nblank,\nshort\nambiguous,same.png\n,x\nback,a\\arch.png\ntwins,b/twin.png\n", encoding="utf-8")
    known = spark.createDataFrame([("a/arch.png",), ("b/pier.png",), ("a/same.png",), ("b/same.png",), ("b/twin.png",), ("b/twin.png",)], "relpath string")
    resolved = qrels.resolve_qrels(qrels.read_qrels(spark, str(path)), known)
    assert {(r.query, r.relevant) for r in qrels.qrels(resolved).collect()} == {("礁", "a/arch.png"), ("礁", "b/pier.png"), ("back", "a/arch.png")}
    assert {r.query for r in qrels.unlabeled(resolved).collect()} == {"unknown", "blank", "short", "ambiguous", "twins"}
    assert {r.name for r in resolved.filter("status = 'unknown'").collect()} == {"lost.png", "same.png", "b/twin.png"}


@pytest.mark.parametrize("url,base,want", [
    ("/pic/arch.png", "https://harbour.example/log/7", "https://harbour.example/pic/arch.png"),
    ("http://ci.xhscdn.com/q/w!z", "https://www.xiaohongshu.com/board/9", "https://ci.xhscdn.com/q/w!z"),
    ("http://harbour.example/arch.png", "https://harbour.example/", "http://harbour.example/arch.png"), ("javascript:open(7)", "https://quay.example/", None),
    ("data:image/gif;base64,R0", "https://quay.example/", None), ("//pics.quay.example/k", "http://quay.example/p", "http://pics.quay.example/k"),
    ("b.png", "https://quay.example/d/e?q=/z", "https://quay.example/d/b.png"), ("../b.png", "https://quay.example/d/e/f", "https://quay.example/d/b.png"),
    ("?p=2", "https://quay.example/d/e?q", "https://quay.example/d/e?p=2"), ("HTTPS://Quay.Example", "https://jetty.example/", "https://quay.example/"), ("", "https://quay.example/", None),
    ("/ü b", "https://quay.example/", "https://quay.example/%C3%BC%20b"), ("c.png", "https://quay.example", "https://quay.example/c.png"),
])
def test_absolute(spark, url, base, want):
    df = spark.createDataFrame([(url, base)], "u string, b string")
    assert df.select(pages.absolute(F.col("u"), F.col("b")).alias("x")).first().x == want


def test_pages(spark):
    html = ('<h1>Two <b>boats</b> &amp; a rope</h1><img data-src="later.png" src="/mast.jpg?s=3&amp;t=4"><img src=\'/mast.jpg?s=3&t=4\'><IMG SRC=/oar.png width=640 height=800>'
            '<img src="/dot.png" width="48" height="48"><img src="/strip.png" width="1200" height="190"><img src="data:image/gif;base64,R0AA">')
    douban = '<img src="/face.png"><img src="https://img3.doubanio.com/view/group_topic/m/public/q7.webp">'
    df = spark.createDataFrame([(1, "https://tieba.baidu.com/f/22", html), (2, "https://www.douban.com/note/5", douban), (3, "https://mytieba.baidu.com.phish.example/", html)],
                               "page_id int, url string, html string")
    got = {}
    for r in pages.page_assets(df).collect():
        got.setdefault(r.page_id, []).append((r.pos, r.url, r.site, r.title))
    assert sorted(got[1]) == [(0, "https://tieba.baidu.com/mast.jpg?s=3&t=4", "百度贴吧", "Two boats & a rope"), (1, "https://tieba.baidu.com/oar.png", "百度贴吧", "Two boats & a rope")]
    assert [x[1:3] for x in got[2]] == [("https://img3.doubanio.com/view/group_topic/l/public/q7.webp", "豆瓣")]
    assert {x[2] for x in got[3]} == {"mytieba.baidu.com.phish.example"}


def test_meta(spark):
    row = ("a", "  小红书 \n x ", "t" * 500, "javascript:open(7)", "https://quay.example/" + "y" * 2000, "extra")
    df = spark.createDataFrame([row], "id string, site string, page_title string, page_url string, image_url string, more string")
    got = pages.clean_meta(df).first()
    assert got.asDict() == {"id": "a", "site": "小红书 x", "page_title": "t" * 200, "page_url": None, "image_url": None}


def test_signatures(spark):
    schema = "source string, size bigint, mtime bigint"
    before = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 1, 1)], schema)
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 3), ("d", 1, 1)], schema)
    changes = files.changed_sources(files.source_signature(before), files.source_signature(after))
    assert {(r.source, r.change) for r in changes.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
