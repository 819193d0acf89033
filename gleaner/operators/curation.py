"""Curation: review decisions, visibility, numbering, collections, feeds, shared collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import dense_length, squeeze
from gleaner.operators.joins import lookup_join
from gleaner.operators.ordering import global_rank, running_sum
from gleaner.sources.logs import latest
from gleaner.sources.pages import clean_meta

# Review, sharing and naming rules.
MIN_CHARS = 15
TRAIN_AFTER, TRAIN_AFTER_REJECTS = 200, 50
MAX_NAME, MAX_ITEMS, MAX_ITEM_BYTES = 40, 2000, 20 * 1024 * 1024
SHARE_SITE = "图集分享"
BUILT_IN = ("全部", "我喜欢")
DEFAULT_NAME = "分享的图集"
SHARED_SUFFIX, SHARED_SUFFIX_N = "（分享）", "（分享 %d）"
LIKED = "liked"


# ---- review and visibility

def latest_decisions(log: DataFrame) -> DataFrame:
    """(id, decision): the last one of each id wins."""
    return latest(log.select("id", "decision", "at", "seq"), ["id"], ["at", "seq"]).select("id", "decision")


def review_state(items: DataFrame, decisions: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, state) for items (id, in_inbox, text): kept, rejected, pending or normal."""
    collected = provenance.select("id").distinct().withColumn("_collected", F.lit(True))
    joined = items.join(decisions.select("id", "decision"), "id", "left").join(collected, "id", "left")
    short = dense_length(F.coalesce("text", F.lit(""))) < MIN_CHARS
    state = (
        F.when(F.col("decision") == "keep", "kept").when(F.col("decision").isNotNull(), "rejected")
        .when(F.col("_collected") & F.col("in_inbox") & short, "pending").otherwise("normal")
    )
    return joined.select("id", state.alias("state"))


def hidden(states: DataFrame, removed: DataFrame) -> DataFrame:
    """(id): pending, rejected or removed."""
    held = states.filter(F.col("state").isin("pending", "rejected")).select("id")
    return held.unionByName(removed.select("id")).distinct()


def visible(items: DataFrame, hidden_ids: DataFrame) -> DataFrame:
    return items.join(hidden_ids.select("id"), "id", "left_anti")


def added_at(items: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, added): when last collected, else when the file was made, else 0."""
    last = provenance.groupBy("id").agg(F.max_by("at", F.struct("at", "seq")).alias("_at"))
    when = F.coalesce(F.nullif(F.col("_at"), F.lit(0)), F.col("mtime"), F.lit(0))
    return items.join(last, "id", "left").select("id", when.alias("added"))


def review_queue(states: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, at, pos): waiting items, newest first."""
    last = provenance.groupBy("id").agg(F.max_by("at", F.struct("at", "seq")).alias("at"))
    waiting = states.filter("state = 'pending'").join(last, "id").select("id", "at")
    return global_rank(waiting, [], [F.desc("at"), F.asc("id")], "pos")


def review_progress(decisions: DataFrame) -> DataFrame:
    n, rejected = F.count(F.lit(1)), F.count_if(F.col("decision") == "reject")
    return decisions.agg(
        n.alias("decided"), rejected.alias("rejected"), (n - rejected).alias("kept"),
        ((n >= TRAIN_AFTER) & (rejected >= TRAIN_AFTER_REJECTS)).alias("can_train"),
    )


def library_status(items: DataFrame, states: DataFrame, hidden_ids: DataFrame) -> DataFrame:
    """One row: items shown, items with text, items waiting for review."""
    gone = hidden_ids.select("id").withColumn("_hidden", F.lit(True))
    one = items.select("id", "text").join(gone, "id", "left").join(states, "id", "left")
    return one.agg(
        F.count_if(F.col("_hidden").isNull()).alias("images"),
        F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"),
        F.count_if(F.col("state") == "pending").alias("pending_review"),
    )


# ---- numbers, days, feeds

def assign_numbers(items: DataFrame, numbers: DataFrame) -> DataFrame:
    """(id, no): the numbers given so far, and the next ones to new items (id, added) in order of arrival."""
    new = items.join(numbers.select("id"), "id", "left_anti").select("id", "added")
    start = numbers.agg(F.coalesce(F.max("no"), F.lit(0)).alias("_start"))
    ranked = global_rank(new, [], [F.asc("added"), F.asc("id")], "_rank").crossJoin(F.broadcast(start))  # one row
    fresh = ranked.select("id", (F.col("_start") + F.col("_rank")).cast("bigint").alias("no"))
    return numbers.select("id", F.col("no").cast("bigint").alias("no")).unionByName(fresh)


def hex_mod(digest: Column, n: Column) -> Column:
    """A long hexadecimal number modulo n, digit by digit."""
    digits = F.transform(F.split(F.upper(digest), ""), lambda c: F.instr(F.lit("0123456789ABCDEF"), c) - 1)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: (acc * 16 + d) % n)


def item_of_the_day(days: DataFrame, pool: DataFrame) -> DataFrame:
    """(day, id): the same item all day; `pool` are the visible items with text."""
    ranked = global_rank(pool.select("id"), [], [F.asc("id")], "_place")
    size = pool.agg(F.count(F.lit(1)).alias("_n"))
    digest = F.sha2(F.date_format("day", "yyyy-MM-dd"), 256)
    picks = days.crossJoin(F.broadcast(size)).filter("_n > 0").select("day", (hex_mod(digest, F.col("_n")) + 1).alias("_place"))
    return picks.join(ranked, "_place").select("day", "id")


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))


def rediscover(items: DataFrame, seen: DataFrame, n: int = 12, seed: int = 0) -> DataFrame:
    """The `n` items never seen or not seen for longest; ties by a seeded draw."""
    joined = items.select("id").join(seen.select("id", "at"), "id", "left")
    ordered = joined.orderBy(F.coalesce("at", F.lit(0)), _draw(seed), "id").limit(n)
    return ordered.select("id", F.coalesce("at", F.lit(0)).alias("last_seen"))


def mark_seen(seen: DataFrame, shown: DataFrame, items: DataFrame) -> DataFrame:
    """(id, at): the latest time of each known id."""
    known = shown.select("id", "at").join(items.select("id"), "id", "left_semi")
    return seen.select("id", "at").unionByName(known).groupBy("id").agg(F.max("at").alias("at"))


def feed_all(items: DataFrame, seen: DataFrame, seed: int = 0) -> DataFrame:
    """(id, pos): everything, not seen for longest first."""
    joined = items.select("id").join(seen.select("id", "at"), "id", "left")
    keyed = joined.select("id", F.coalesce("at", F.lit(0)).alias("_at"), _draw(seed).alias("_draw"))
    return global_rank(keyed, [], [F.asc("_at"), F.asc("_draw"), F.asc("id")], "pos").select("id", "pos")


def feed_collection(items: DataFrame, order: str = "new", seed: int = 0) -> DataFrame:
    """(cid, id, pos): each collection's own order, reversed, or shuffled by a seed. Takes visible (cid, pos, id)."""
    if order == "shuffle":
        keyed = items.select("cid", "id", _draw(seed).alias("_key"))
        by = [F.asc("_key"), F.asc("id")]
    else:
        keyed = items.select("cid", "id", F.col("pos").alias("_key"))
        by = [F.asc("_key"), F.asc("id")] if order == "old" else [F.desc("_key"), F.desc("id")]
    return global_rank(keyed, ["cid"], by, "pos").select("cid", "id", "pos")


def feed_item(items: DataFrame, item, similar: DataFrame, seed: int = 0) -> DataFrame:
    """(id, pos): one item, then the ones like it (id, similar, score), then the rest shuffled."""
    near = similar.filter(F.col("id") == item).select(F.col("similar").alias("id"), "score")
    bucket = F.when(F.col("id") == item, 0).when(F.col("score").isNotNull(), 1).otherwise(2)
    keyed = items.select("id").join(near, "id", "left").select(
        "id", bucket.alias("_bucket"), F.coalesce(-F.col("score"), F.lit(0.0)).alias("_score"), _draw(seed).alias("_draw"))
    keyed = keyed.withColumn("_draw", F.when(F.col("_bucket") == 2, F.col("_draw")).otherwise(""))
    return global_rank(keyed, [], [F.asc("_bucket"), F.asc("_score"), F.asc("_draw"), F.asc("id")], "pos").select("id", "pos")


# ---- collections

def collection_summary(items: DataFrame, shown: DataFrame, added: DataFrame) -> DataFrame:
    """(cid, count, cover): visible items and the last of them; "all" counts everything, newest on top."""
    live = items.join(shown.select("id"), "id", "left_semi")
    per = live.groupBy("cid").agg(F.count(F.lit(1)).alias("count"), F.max_by("id", F.struct("pos", "id")).alias("cover"))
    every = items.select("cid").distinct().join(per, "cid", "left").select(
        F.col("cid").cast("string").alias("cid"), F.coalesce("count", F.lit(0)).alias("count"), "cover")
    newest = F.min(F.struct((-F.col("added")).alias("age"), F.col("id"))).alias("_top")
    total = shown.select("id").join(added, "id").agg(F.count(F.lit(1)).alias("count"), newest)
    return total.select(F.lit("all").alias("cid"), "count", F.col("_top.id").alias("cover")).unionByName(every)


def collection_view(items: DataFrame, shown: DataFrame, sort: str = "new") -> DataFrame:
    """(cid, id, pos): visible items in the collection's order, last added first for `new`."""
    return feed_collection(items.join(shown.select("id"), "id", "left_semi"), sort)


def collection_all(shown: DataFrame, added: DataFrame, sort: str = "new") -> DataFrame:
    """(id, pos): every visible item by when it was added and its id, last first for `new`."""
    by = [F.asc("added"), F.asc("id")] if sort == "old" else [F.desc("added"), F.desc("id")]
    return global_rank(shown.select("id").join(added.select("id", "added"), "id"), [], by, "pos").select("id", "pos")


def collection_waiting(items: DataFrame, indexed: DataFrame) -> DataFrame:
    """(cid, waiting): items put in before they were indexed."""
    absent = items.join(indexed.select("id"), "id", "left_anti").groupBy("cid").agg(F.count(F.lit(1)).alias("_n"))
    return items.select("cid").distinct().join(absent, "cid", "left").select("cid", F.coalesce("_n", F.lit(0)).alias("waiting"))


def add_to_collections(items: DataFrame, new: DataFrame) -> DataFrame:
    """(cid, pos, id): new ids (cid, pos, id) appended in order, each once, unless already there."""
    firsts = new.groupBy("cid", "id").agg(F.min("pos").alias("pos"))
    fresh = firsts.join(items.select("cid", "id"), ["cid", "id"], "left_anti")
    ranked = global_rank(fresh, ["cid"], [F.asc("pos"), F.asc("id")], "_rank")
    ends = items.groupBy("cid").agg(F.max("pos").alias("_end"))
    placed = ranked.join(ends, "cid", "left").select(
        "cid", (F.coalesce("_end", F.lit(0)) + F.col("_rank")).cast("bigint").alias("pos"), "id")
    return items.select("cid", F.col("pos").cast("bigint").alias("pos"), "id").unionByName(placed)


def remove_from_collections(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the listed rows: from one collection if `gone` names it, else from every collection."""
    keys = ["cid", "id"] if "cid" in gone.columns else ["id"]
    return items.join(gone.select(*keys).distinct(), keys, "left_anti")


def remove_items(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(id, action): collected items are rejected, own ones hidden; unknown ids are ignored."""
    known = asked.select("id").distinct().join(items.select("id", "in_inbox"), "id")
    return known.select("id", F.when(F.col("in_inbox"), "reject").otherwise("hide").alias("action"))


def item_page(
    items: DataFrame, provenance: DataFrame, collections: DataFrame, numbers: DataFrame, names: DataFrame
) -> DataFrame:
    """Each item with where it first came from, in how many places and collections it is, number and name."""
    came = provenance.groupBy("id").agg(
        F.min_by(F.struct("site", "page_url"), F.struct("at", "seq")).alias("_first"), F.count(F.lit(1)).alias("n_sources"))
    held = collections.groupBy("id").agg(
        F.count_distinct("cid").alias("n_collections"), F.max(F.col("cid").cast("string") == LIKED).alias("liked"))
    page = items.join(came, "id", "left").join(held, "id", "left").join(numbers, "id", "left").join(names, "id", "left")
    return page.select(
        "id", F.col("_first.site").alias("site"), F.col("_first.page_url").alias("page_url"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_collections", F.lit(0)).alias("n_collections"),
        F.coalesce("liked", F.lit(False)).alias("liked"), "no", "name",
    )


# ---- sharing

def export_collections(items: DataFrame, shown: DataFrame, provenance: DataFrame) -> DataFrame:
    """(cid, pos, id, source_pos, site, page_url, …): visible items in order, one row per distinct source.

    Sources that only say the item was shared before are left out; an item with no source has one empty row.
    """
    fields = [c for c in ("site", "page_title", "page_url", "image_url") if c in provenance.columns]
    meta = clean_meta(provenance, ("id", "at", "seq")).filter(
        ~F.coalesce(F.col("site") == SHARE_SITE, F.lit(False)) & F.coalesce(*fields).isNotNull())
    distinct = meta.groupBy("id", *fields).agg(F.min(F.struct("at", "seq")).alias("_at"))
    sources = global_rank(distinct, ["id"], [F.asc("_at"), *[F.asc_nulls_first(f) for f in fields]], "source_pos").drop("_at")
    ordered = collection_view(items, shown, "old")
    return ordered.join(sources, "id", "left").select("cid", "pos", "id", "source_pos", *fields)


def import_status(export: DataFrame, library: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(cid, pos, id, status) per item of shared collections (id, size, ok): added, duplicate, skipped or refused.

    The first place of an item that is new counts as added, a later one as a duplicate. Collections of more than
    `max_items` are refused whole: nothing of them is added, and their places do not count.
    """
    usable = F.coalesce(F.col("ok") & (F.col("size") <= MAX_ITEM_BYTES), F.lit(False)) & ~F.col("refused")
    sizes = import_sizes(export, max_items)
    read = lookup_join(export.select("cid", "pos", "id", "size", "ok"), sizes, "cid", "items", [F.col("pos"), F.col("id")])
    read = read.withColumn("refused", F.coalesce("refused", F.lit(False))).select("cid", "pos", "id", "refused", usable.alias("_ok"))
    first = read.groupBy("id").agg(
        F.min(F.when(F.col("_ok"), F.struct("cid", "pos"))).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    have = library.select("id").distinct().withColumn("_have", F.lit(True))
    joined = lookup_join(read, first.join(have, "id", "left"), "id", "_copies", [F.col("cid"), F.col("pos")])
    again = F.col("_have").isNotNull() | (F.struct("cid", "pos") != F.col("_first"))
    status = F.when(F.col("refused"), "refused").when(~F.col("_ok"), "skipped").when(again, "duplicate").otherwise("added")
    return joined.select("cid", "pos", "id", status.alias("status"))


def import_sizes(export: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(cid, items, refused): a shared collection beyond the limit is refused whole."""
    n = F.count(F.lit(1))
    return export.groupBy("cid").agg(n.alias("items"), (n > max_items).alias("refused"))


def import_provenance(statuses: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """(id, site, page_title, page_url): the share itself, then what the sharer knew, for added items only."""
    added = statuses.filter("status = 'added'").select("cid", "id")
    share = added.join(names, "cid").select(
        "id", F.lit(SHARE_SITE).alias("site"), F.col("name").alias("page_title"), F.lit(None).cast("string").alias("page_url"))
    told = clean_meta(sources).filter(~F.coalesce(F.col("site") == SHARE_SITE, F.lit(False)))
    told = told.join(added.select("id"), "id", "left_semi").select("id", "site", "page_title", "page_url")
    return share.unionByName(told)


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(cid, name): each wanted name, with the smallest free suffix where it is taken.

    Collections that want the same name get the free ones in order of cid. Only a suffix as it is written here takes
    up its number. With u places of a name taken in order, the place u_j has u_j - j free ones before it, so the t-th
    free place is t and as many as have no more than t: a running count, and no list per name.
    """
    base = F.substring(squeeze(F.coalesce("name", F.lit(""))), 1, MAX_NAME - 6)
    asked = wanted.select("cid", F.when(base == "", F.lit(DEFAULT_NAME)).otherwise(base).alias("_base"))
    spark = wanted.sparkSession
    used = taken.select("name").unionByName(spark.createDataFrame([(b,) for b in BUILT_IN], "name string"))
    head, tail = SHARED_SUFFIX_N.split("%d")
    numbered = f"^(?s)(.+){head}([2-9]|[1-9][0-9]{{1,8}}){tail}$"
    plain = F.when(F.col("name").endswith(SHARED_SUFFIX), F.expr(f"substring(name, 1, length(name) - {len(SHARED_SUFFIX)})"))
    nth = F.regexp_extract("name", numbered, 2)
    places = used.select(F.col("name").alias("_base"), F.lit(0).cast("bigint").alias("_n")).unionByName(
        used.select(plain.alias("_base"), F.lit(1).cast("bigint").alias("_n")).filter(F.col("_base").isNotNull())).unionByName(
        used.filter(nth != "").select(F.regexp_extract("name", numbered, 1).alias("_base"), nth.cast("bigint").alias("_n")))
    places = places.join(asked.select("_base").distinct(), "_base", "left_semi").distinct()
    before = global_rank(places, ["_base"], [F.asc("_n")], "_j").select(
        F.lit(None).cast(asked.schema["cid"].dataType).alias("cid"), "_base",
        (F.col("_n") - F.col("_j") + 1).cast("bigint").alias("_at"), F.lit(1).cast("bigint").alias("_taken"))
    turns = global_rank(asked, ["_base"], [F.asc("cid")], "_turn").select(
        "cid", "_base", (F.col("_turn") - 1).cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("_taken"))
    order = [F.asc("_at"), F.desc("_taken"), F.asc("cid")]
    counted = running_sum(turns.unionByName(before), ["_base"], order, {"_before": "_taken"}).filter("_taken = 0")
    free = F.col("_at") + F.col("_before")
    name = F.when(free == 0, F.col("_base")).when(free == 1, F.concat("_base", F.lit(SHARED_SUFFIX))).otherwise(
        F.concat(F.col("_base"), F.lit(head), free.cast("string"), F.lit(tail)))
    return counted.select("cid", name.alias("name"))
