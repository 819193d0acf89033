"""Assets named on crawled pages, and what is kept of where an item came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import squeeze, strip

# Sizes of real content, sites with rules of their own, and limits of what is recorded.
MIN_SIDE, MAX_ASPECT = 150, 4
SITES = (("tieba.baidu.com", "tieba"), ("xiaohongshu.com", "xiaohongshu"), ("douban.com", "douban"))
SITE_NAMES = {"tieba": "百度贴吧", "xiaohongshu": "小红书", "douban": "豆瓣"}
HTTPS_HOST = "xhscdn.com"
DOUBAN_PICTURE = "doubanio\\.com/view/"
DOUBAN_SIZES, DOUBAN_LARGE = "/view/group_topic/(?:s|m|sqxs|xs)/", "/view/group_topic/l/"
TEXT_LIMITS = {"site": 40, "page_title": 200}
URL_FIELDS, URL_LIMIT = ("page_url", "image_url"), 2000

_VALUE = "\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>]+))"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _attribute(tag: Column, name: str) -> Column:
    pattern = f"(?i)\\s(?:{name}){_VALUE}"
    parts = [F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]
    return F.replace(F.concat(*parts), F.lit("&amp;"), F.lit("&"))


def _in_domain(host: Column, domain: str) -> Column:
    return host.rlike(f"(^|\\.){domain.replace('.', chr(92) + '.')}$")


def site_of(host: Column) -> Column:
    found = F.lit("generic")
    for domain, site in reversed(SITES):
        found = F.when(_in_domain(host, domain), site).otherwise(found)
    return found


def looks_like_content(width: Column, height: Column) -> Column:
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return known & (width >= MIN_SIDE) & (height >= MIN_SIDE) & (
        F.greatest(width / F.greatest(height, F.lit(1)), height / F.greatest(width, F.lit(1))) <= MAX_ASPECT)


def _settled(path: Column) -> Column:
    """Without `.` and `..` segments."""
    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    tail = F.when(path.rlike("/\\.\\.?$"), F.lit("/")).otherwise(F.lit(""))
    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike("(^|/)\\.\\.?(/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(path)


def _escaped(url: Column) -> Column:
    """Characters a URL may not hold, as percent escapes."""
    each = F.transform(
        F.split(url, ""),
        lambda c: F.when(c == " ", F.lit("%20")).when(c.rlike("[^\\x21-\\x7e]|[\"<>`{}]"), F.url_encode(c)).otherwise(c),
    )
    return F.when(url.rlike("[^\\x21-\\x7e]|[\"<>`{}]"), F.array_join(each, "")).otherwise(url)


def base_parts(base: Column) -> Column:
    """What of a page's own address a link may be relative to."""
    root = F.regexp_extract(base, "^https?://[^/?#]*", 0)
    bare = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(bare.rlike("^https?://[^/]+/"), F.regexp_replace(bare, "[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    return F.struct(
        root.alias("root"), F.regexp_extract(base, "^https?:", 0).alias("scheme"), bare.alias("bare"), folder.alias("folder"),
        F.regexp_replace(base, "#.*$", "").alias("page"),
    )


def _joined(url: Column, base: Column) -> Column:
    return (
        F.when(url == "", F.lit(None))
        .when(url.rlike(_SCHEME), url)
        .when(url.startswith("//"), F.concat(base["scheme"], url))
        .when(url.startswith("/"), F.concat(base["root"], url))
        .when(url.startswith("?"), F.concat(base["bare"], url))
        .when(url.startswith("#"), F.concat(base["page"], url))
        .otherwise(F.concat(base["folder"], url))
    )


_PARTS = "(?i)^(https?://[^/?#]+)([^?#]*)(.*)$"


def absolute_all(urls: Column, base: Column) -> Column:
    """Addresses as seen from a page (`base_parts`), null unless http(s); one step at a time, so that no
    expression is repeated inside another."""
    joined = F.transform(F.transform(urls, strip), lambda u: _joined(u, base))
    split = F.transform(joined, lambda u: F.when(u.rlike(_PARTS), F.struct(
        F.lower(F.regexp_extract(u, _PARTS, 1)).alias("head"), F.regexp_extract(u, _PARTS, 2).alias("path"),
        F.regexp_extract(u, _PARTS, 3).alias("rest"))))

    def whole(x: Column) -> Column:
        host = F.regexp_replace(x["head"], "^http://|:\\d+$", "")
        secure = x["head"].startswith("http://") & _in_domain(host, HTTPS_HOST)
        head = F.when(secure, F.regexp_replace(x["head"], "^http:", "https:")).otherwise(x["head"])
        path = F.when(x["path"] == "", F.lit("/")).otherwise(_settled(x["path"]))
        return F.concat(head, path, x["rest"])

    return F.transform(F.transform(split, whole), _escaped)


def absolute(url: Column, base: Column) -> Column:
    """`url` as seen from the page `base`; null unless http(s)."""
    return F.get(absolute_all(F.array(url), base_parts(base)), F.lit(0))


def page_assets(pages: DataFrame, tags: str = "img", attributes: str = "src") -> DataFrame:
    """(page_id, pos, url, site, title): what each page names, absolute, once per page, in order.

    Everything happens inside the page's own row; sizes are checked where the page states them.
    """
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]*)", 1))
    found = F.regexp_extract_all("html", F.lit(f"(?i)<(?:{tags})\\s[^>]*>"), F.lit(0))
    read = pages.select(
        "page_id", host.alias("_host"), site_of(host).alias("_site"), _title().alias("title"),
        base_parts(F.col("url")).alias("_base"), found.alias("_tags"))

    def attributes_of(tag: Column) -> Column:
        return F.struct(_attribute(tag, attributes).alias("url"), *[
            F.regexp_extract(_attribute(tag, n), "^\\d+", 0).try_cast("int").alias(n) for n in ("width", "height")])

    def sizeable(x: Column) -> Column:
        return x["width"].isNull() | x["height"].isNull() | looks_like_content(x["width"], x["height"])

    urls = F.transform(F.filter(F.transform("_tags", attributes_of), sizeable), lambda x: x["url"])
    read = read.withColumn("_urls", F.filter(absolute_all(urls, F.col("_base")), lambda u: u.isNotNull()))
    own = F.transform(
        F.filter("_urls", lambda u: u.rlike(DOUBAN_PICTURE)), lambda u: F.regexp_replace(u, DOUBAN_SIZES, DOUBAN_LARGE)
    )
    chosen = F.when((F.col("_site") == "douban") & (F.size(own) > 0), own).otherwise(F.col("_urls"))
    named = F.col("_host")
    for code, name in SITE_NAMES.items():
        named = F.when(F.col("_site") == code, name).otherwise(named)
    return read.select("page_id", named.alias("site"), "title", F.posexplode(F.array_distinct(chosen)).alias("pos", "url"))


def _title() -> Column:
    """The page's heading, else its title, without markup."""
    heading = F.regexp_extract("html", "(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>", 1)
    title = F.regexp_extract("html", "(?is)<title(?:\\s[^>]*)?>(.*?)</title>", 1)
    text = F.regexp_replace(F.when(heading != "", heading).otherwise(title), "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.substring(strip(text), 1, 200)


def clean_meta(df: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Only the fields that are shown, trimmed; links only if http(s) and not endless."""
    cols = [F.col(c) for c in keep]
    for field, limit in TEXT_LIMITS.items():
        if field in df.columns:
            cols.append(F.nullif(F.substring(squeeze(F.col(field)), 1, limit), F.lit("")).alias(field))
    for field in URL_FIELDS:
        if field in df.columns:
            ok = (F.length(field) <= URL_LIMIT) & F.col(field).rlike("(?i)^https?:")
            cols.append(F.when(ok, F.col(field)).alias(field))
    return df.select(*cols)
