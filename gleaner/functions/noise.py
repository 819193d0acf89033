"""Which lines of a captured text are not its own words. The patterns read alike in Java and in RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import norm, strip

# Platforms, and the patterns that tell furniture from text. Character classes are spelled out,
# because \w, \d, \s and \b mean different things in different engines.
CJK = "[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]"
NOT_CJK = "[^\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]"
SENTENCE_ENDS = "。！？!?…；;"
NAME_ENDS = SENTENCE_ENDS + "，,：:"
PLATFORMS = (
    "小红书", "红书", "抖音", "快手", "微博", "知乎", "bilibili", "哔哩哔哩", "b站", "微信", "豆瓣", "贴吧",
    "tiktok", "instagram", "twitter", "weibo", "xiaohongshu",
)
_W = "[\\p{L}\\p{N}_]"
_NW = "[^\\p{L}\\p{N}_]"
_S = "[\\s\\p{Z}]"
_D = "\\p{Nd}"
_MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
ACCOUNT_ID = f"(?:书号|红号|抖音号|快手号|微信号|微博号|视频号|b站号|uid){_S}*[:：]?|(?:微博|微信|b站|id|小红书|红书|抖音|快手|哔哩哔哩){_S}*[:：]"
ACCOUNT = (
    f"@[^\\s\\p{{Z}}]|https?://|www\\.|{_W}-*\\.(?:com|org|net|cn|io|me)(?:{_NW}|$)"
)
CHROME = (
    "^(?:follow|following|关注|已关注|\\+关注|跟隨|跟随|translate ?tweet|翻译推文|查看翻译|share|分享|转发|评论|点赞|"
    "收藏|回复|显示回复|查看回复|查看动态>?|热门|简介|帖子|貼文|更多|reply|retweet|repost|like|likes|"
    "sign this petition|展开|收起|全文|resolved question|report ?it|reportlt|best ?answer.*|replying to.*)$|"
    f"{_S}(?:follow|关注)$"
)
COUNTS = (
    f"{_D}[\\p{{Nd}},.]*{_S}*(?:[万萬千kw])?{_S}*"
    "(?:notes?|retweets?|likes?|views?|comments?|replies|次查看|次播放|次观看|人看过)"
)
CREDIT = (
    "^(?:翻译|翻譯|翻/製|翻/制|翻制|翻製|译|譯|搬运|搬運|转载|轉載|来源|出处|via|cr|credit)[\\s\\p{Z}]*[:：@]|"
    f"^[:：]{_S}*[^\\s\\p{{Z}}]{{1,8}}$|"
    f"^(?:photo|photos|odai|art|illustration|drawn|video|image|source){_S}+by(?:{_NW}|$)"
)
MONTH = f"^(?:{_MON}|sept)[a-z]*\\.?[\\s\\p{{Z}}\\p{{Nd}},]*$"
MISREAD_MARK = "^小?红.?书.?$|^小红.$"
TIME = (
    f"{_D}{{1,2}}:{_D}{{2}}|{_D}{{3,4}}{_S}*[ap]m|{_D}{{1,2}}{_S}*(?:{_MON})[a-z]*{_S}*{_D}{{2,4}}|"
    f"{_D}+{_S}*(?:秒|分钟|小时|小時|天|周|個月|个月|年)前?|"
    f"(?:^|{_NW})(?:{_MON})[a-z]*\\.?{_S}*{_D}|{_D}{{1,4}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}|"
    f"{_D}+{_S}*(?:seconds?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?){_S}*ago"
)
COUNTER = "^[\\p{Nd}\\s\\p{Z},.，。万萬千kw+↑↓/·•|:：\\-]*$"
MIN_SCORE_LATIN, MIN_SCORE_CJK = 0.65, 0.5


def _any_case(pattern: str) -> str:
    return f"(?iu){pattern}"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(_any_case(pattern))


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_CJK, ""))


def latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def is_account(text: Column) -> Column:
    return matches(text, ACCOUNT)


def is_chrome(text: Column) -> Column:
    return matches(text, CHROME)


def is_account_id(text: Column) -> Column:
    """Looked at only where one of the signs every such mark has is there."""
    sign = F.contains(text, F.lit("号")) | F.contains(text, F.lit(":")) | F.contains(text, F.lit("：")) | F.contains(F.lower(text), F.lit("uid"))
    return sign & matches(text, ACCOUNT_ID)


def is_noise(text: Column, score: Column) -> Column:
    """Everything but the corpus-wide rule (lines common to several documents), which needs a join."""
    t = strip(text)
    return is_furniture(t, norm(text), score) | is_account(t) | is_chrome(t) | is_account_id(t)


def is_furniture(t: Column, n: Column, score: Column) -> Column:
    """The other rules, for a stripped line and its normal form; cheap ones first."""
    latin, three_latin = t.rlike("[A-Za-z]"), t.rlike("[A-Za-z](?:[^A-Za-z]*[A-Za-z]){2}")
    without_time = F.regexp_replace(F.regexp_replace(t, _any_case(TIME), ""), _any_case(COUNTS), "")
    five_cjk = without_time.rlike(f"{CJK}(?:{NOT_CJK}*{CJK}){{4}}")
    return (
        (n == "") | n.isin(*PLATFORMS) | ((F.length(n) <= 4) & n.rlike(MISREAD_MARK))
        | ((F.length(n) <= 2) & latin & has_cjk(t))
        | F.when(has_cjk(t), score < MIN_SCORE_CJK).otherwise(~three_latin | (score < MIN_SCORE_LATIN))
        | matches(t, COUNTER) | matches(t, CREDIT) | matches(t, MONTH)
        | (t.rlike(_D) & (matches(t, TIME) | matches(t, COUNTS)) & ~five_cjk)
    )
