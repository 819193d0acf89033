"""Review, numbering, feeds, sharing and incremental stages."""

import hashlib

from pyspark.sql import functions as F

from gleaner.operators import curation as C
from gleaner.operators import enrichment as E
from gleaner.operators.library import Stage, Store, update


def test_states_and_visibility(spark):
    items = spark.createDataFrame([("a", True, "短"), ("b", True, "短"), ("c", False, "短"), ("d", True, "一段足够长的文字不会被扣下来等待确认"), ("e", True, "短")],
                                  "id string, in_inbox boolean, text string")
    log = spark.createDataFrame([("b", "reject", 1.0, 1), ("b", "keep", 2.0, 2), ("e", "keep", 1.0, 3), ("e", "reject", 1.0, 4)], "id string, decision string, at double, seq int")
    came = spark.createDataFrame([(i, 1.0, 1) for i in "abcde"], "id string, at double, seq int")
    states = C.review_state(items, C.latest_decisions(log), came)
    assert {r.id: r.state for r in states.collect()} == {"a": "pending", "b": "kept", "c": "normal", "d": "normal", "e": "rejected"}
    removed = spark.createDataFrame([("d",)], "id string")
    assert {r.id for r in C.visible(items, C.hidden(states, removed)).collect()} == {"b", "c"}
    assert [r.id for r in C.review_queue(states, came).collect()] == ["a"]


def test_numbers_are_kept(spark):
    numbers = spark.createDataFrame([("x", 1), ("y", 2)], "id string, no int")
    items = spark.createDataFrame([("old", 1.0), ("x", 5.0), ("new", 9.0), ("b", 9.0)], "id string, added double")
    assert {r.id: r.no for r in C.assign_numbers(items, numbers).collect()} == {"x": 1, "y": 2, "old": 3, "b": 4, "new": 5}
    empty = numbers.filter("false")
    assert {r.id: r.no for r in C.assign_numbers(items.limit(1), empty).collect()} == {"old": 1}


def test_item_of_the_day(spark):
    pool = spark.createDataFrame([(f"i{n:03}",) for n in range(37)], "id string")
    days = spark.createDataFrame([("2026-03-0%d" % d,) for d in range(1, 8)], "d string").select(F.to_date("d").alias("day"))
    for r in C.item_of_the_day(days, pool).collect():
        want = int(hashlib.sha256(r.day.isoformat().encode()).hexdigest(), 16) % 37
        assert r.id == f"i{want:03}"


def test_feeds(spark):
    items = spark.createDataFrame([(f"i{n}",) for n in range(10)], "id string")
    seen = spark.createDataFrame([(f"i{n}", float(n + 1)) for n in range(6)], "id string, at double")
    assert {r.id for r in C.rediscover(items, seen, 4).collect()} == {"i6", "i7", "i8", "i9"}
    order = [r.id for r in C.feed_all(items, seen, 1).orderBy("pos").collect()]
    assert set(order[:4]) == {"i6", "i7", "i8", "i9"} and order[4:] == [f"i{n}" for n in range(6)]
    near = spark.createDataFrame([("i3", "i5", 0.9), ("i3", "i1", 0.8), ("i4", "i2", 0.9)], "id string, similar string, score double")
    feed = [r.id for r in C.feed_item(items, "i3", near, 7).orderBy("pos").collect()]
    assert feed[:3] == ["i3", "i5", "i1"] and sorted(feed) == sorted(f"i{n}" for n in range(10))
    assert feed == [r.id for r in C.feed_item(items.repartition(5), "i3", near, 7).orderBy("pos").collect()]
    coll = spark.createDataFrame([("c", n, f"i{n}") for n in range(1, 5)], "cid string, pos int, id string")
    assert [r.id for r in C.feed_collection(coll, "new").orderBy("pos").collect()] == ["i4", "i3", "i2", "i1"]


def test_collections(spark):
    coll = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b"), ("e", 1, "z")], "cid string, pos int, id string")
    new = spark.createDataFrame([("c", 1, "b"), ("c", 2, "d"), ("c", 3, "a"), ("c", 4, "d"), ("c", 5, "f"), ("n", 1, "q")], "cid string, pos int, id string")
    got = C.add_to_collections(coll, new)
    assert {(r.cid, r.pos, r.id) for r in got.collect()} == {("c", 1, "a"), ("c", 2, "b"), ("c", 3, "d"), ("c", 4, "f"), ("e", 1, "z"), ("n", 1, "q")}
    shown = spark.createDataFrame([("a",), ("b",)], "id string")
    added = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "id string, added double")
    assert {tuple(r) for r in C.collection_summary(coll, shown, added).collect()} == {("all", 2, "a"), ("c", 2, "b"), ("e", 0, None)}


def test_sharing(spark):
    export = spark.createDataFrame([("s", 1, "new", 10, True), ("s", 2, "have", 10, True), ("s", 3, "big", 10**8, True), ("s", 4, "bad", 1, False), ("s", 5, "new", 10, True)],
                                   "cid string, pos int, id string, size bigint, ok boolean")
    have = spark.createDataFrame([("have",)], "id string")
    status = C.import_status(export, have)
    assert [(r.pos, r.status) for r in status.orderBy("pos").collect()] == [(1, "added"), (2, "duplicate"), (3, "skipped"), (4, "skipped"), (5, "duplicate")]
    sources = spark.createDataFrame([("new", "微博", None, "https://w.cn/1"), ("new", C.SHARE_SITE, "x", None), ("have", "y", None, None)], "id string, site string, page_title string, page_url string")
    names = spark.createDataFrame([("s", "mine")], "cid string, name string")
    assert {tuple(r) for r in C.import_provenance(status, sources, names).collect()} == {("new", C.SHARE_SITE, "mine", None), ("new", "微博", None, "https://w.cn/1")}
    assert [tuple(r) for r in C.import_sizes(export).collect()] == [("s", 5, False)]
    taken = spark.createDataFrame([("猫",), ("狗",), ("狗（分享）",), ("鸟",), ("鸟（分享 2）",)], "name string")
    wanted = spark.createDataFrame([("1", " 猫 "), ("2", "狗"), ("3", "鸟"), ("4", "全部"), ("5", "新"), ("6", ""), ("7", "猫")], "cid string, name string")
    assert {r.cid: r.name for r in C.free_names(wanted, taken).collect()} == {
        "1": "猫（分享）", "2": "狗（分享 2）", "3": "鸟（分享）", "4": "全部（分享）", "5": "新", "6": "分享的图集", "7": "猫（分享 2）"}


def test_a_collection_beyond_the_limit_is_refused_whole(spark):
    rows = [("a", n, f"x{n}", 1, True) for n in range(4)] + [("b", 1, "x0", 1, True), ("b", 2, "y", 1, False), (None, 1, "z", 1, True)]
    export = spark.createDataFrame(rows, "cid string, pos int, id string, size bigint, ok boolean")
    none = spark.createDataFrame([], "id string")
    got = {(r.cid, r.pos): r.status for r in C.import_status(export, none, max_items=3).collect()}
    assert got == {**{("a", n): "refused" for n in range(4)}, ("b", 1): "added", ("b", 2): "skipped", (None, 1): "added"}


def test_everything_as_a_collection(spark):
    shown = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    added = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("gone", 9.0)], "id string, added double")
    assert [r.id for r in C.collection_all(shown, added).orderBy("pos").collect()] == ["b", "c", "a"]
    assert [r.id for r in C.collection_all(shown, added, "old").orderBy("pos").collect()] == ["a", "c", "b"]


def test_only_suffixes_as_written_count(spark):
    taken = ["x", "x（分享 1）", "y（分享 0）", "z", "z（分享）", "z（分享 02）", "w（分享）", "v", "v（分享）", "v（分享 2）", "v（分享 4）"]
    wanted = list(enumerate(["x", "y", "z", "w", "w", "v", "v", "v", "w（分享）"]))
    got = C.free_names(spark.createDataFrame(wanted, "cid int, name string"), spark.createDataFrame([(n,) for n in taken], "name string"))
    assert [r.name for r in got.orderBy("cid").collect()] == [
        "x（分享）", "y", "z（分享 2）", "w", "w（分享 2）", "v（分享 3）", "v（分享 5）", "v（分享 6）", "w（分享）（分享）"]


def test_the_last_result_of_an_id_counts(spark):
    stage = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "id string, at int, value string")
    results = spark.createDataFrame([("a", 2, "z"), ("a", 3, "c"), ("x", 3, "no")], "id string, at int, value string")
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in E.merge_stage(stage, results, items, ["at"]).collect()} == {("a", 3, "c"), ("b", 1, "old")}


def _fragile(log):
    def make():
        def fn(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            if "bad" in texts:
                raise ValueError("bad one")
            return [len(t) for t in texts]
        return fn
    return make


def test_a_failing_row_only_loses_itself_and_nothing_is_done_twice(spark, tmp_path):
    log = str(tmp_path / "calls")
    items = spark.createDataFrame([(n, "bad" if n == 5 else f"t{n}") for n in range(40)], "id int, text string").coalesce(1)
    store = Store(spark, str(tmp_path / "store"))
    stage = Stage("s", _fragile(log), "text", "bigint", "m", batch=16)
    assert [tuple(r) for r in update(items, [stage], store, "1").collect()] == [("s", 40, 1)]
    calls = len(open(log).readlines())
    assert calls == 40 + 16  # the first batch once whole and once row by row
    assert [tuple(r) for r in update(items, [stage], store, "2").collect()] == [("s", 40, 1)]
    assert len(open(log).readlines()) == calls
    update(items, [Stage("s", _fragile(log), "text", "bigint", "m@8bit", batch=16)], store, "3").collect()
    assert len(open(log).readlines()) == calls
    update(items, [stage], store, "4", retry_failed=True).collect()
    assert len(open(log).readlines()) == calls + 2
    update(items, [Stage("s", _fragile(log), "text", "bigint", "other", batch=16)], store, "5").collect()
    assert len(open(log).readlines()) == 2 * calls + 2


def test_a_repeated_run_loses_nothing(spark, tmp_path):
    items = spark.createDataFrame([(n, f"t{n}") for n in range(6)], "id int, text string")
    store = Store(spark, str(tmp_path / "store"))
    stage = Stage("s", _fragile(str(tmp_path / "calls")), "text", "bigint", "m", batch=4)
    update(items.filter("id < 4"), [stage], store, "a").collect()
    for _ in range(2):
        assert [tuple(r) for r in update(items, [stage], store, "b").collect()] == [("s", 6, 0)]
    assert sorted(r.id for r in store.read("s", "id int").collect()) == list(range(6))


def test_fingerprints(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    one = E.set_fingerprint(texts, "m").first()
    assert one == E.set_fingerprint(texts.orderBy(F.desc("id")).repartition(3), "m").first()
    assert one != E.set_fingerprint(texts.withColumn("text", F.lit("a")), "m").first() and one != E.set_fingerprint(texts, "n").first()
    old = texts.filter("id = 1").select("id", E.row_fingerprint(F.lit("m"), F.col("text")).alias("fingerprint"))
    assert [r.id for r in E.changed_rows(texts, old, "m").collect()] == [2]
