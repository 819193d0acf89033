"""Text a model wrote, checked and made into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import noise as N
from gleaner.functions.text import fold_script, strip

# The answer format, and what a model writes for "nothing".
COMMENT = "【评论】"
NOTHING = ("无", "无。", "（无）", "(无)", "没有文字", "无文字")
NAMED = "^([^：:]{1,24})[：:][\\s\\p{Z}]*(.+)$"
NOTE_TYPES = ("梗图", "表情包", "其他")
NOTE_FIELDS = {"类型": str, "梗": str, "画面": str, "情绪": list, "翻译": str, "说话人": list}
NOTE_COLUMNS = {"类型": "type", "梗": "name", "画面": "scene", "情绪": "mood", "翻译": "translation", "说话人": "speakers"}
DESCRIPTION_FIELDS = ("画面", "文字", "主题", "笑点", "情绪", "梗")
KIND_NAME = "(表情包|表情|梗图)$"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"
WATERMARK = (
    "(?iu)(小红书号|抖音号|快手号|B站|bilibili|微博|微信号|公众号)[\\s\\p{Z}]*[:：]?[\\s\\p{Z}]*@?[\\p{L}\\p{N}_.-]+"
    "|@[\\p{L}\\p{N}_.-]{2,}|(?<![^\\s\\p{Z}])小红书(?![^\\s\\p{Z}])"
)


def _said(line: Column) -> Column:
    """(kind, name, words) of one line."""
    rest = strip(F.substring(line, F.lit(len(COMMENT) + 1), F.length(line)))
    named = rest.rlike(NAMED)
    spoken = strip(F.regexp_replace(strip(F.substring(line, F.lit(2), F.length(line))), "^- ", ""))
    comment, dialogue = line.startswith(COMMENT), line.startswith("- ") | (line == "-")
    return F.struct(
        line.alias("line"),
        F.when(comment, "comment").when(dialogue, "dialogue").otherwise("text").alias("kind"),
        F.when(comment & named, strip(F.regexp_extract(rest, NAMED, 1))).otherwise("").alias("name"),
        F.when(comment & named, strip(F.regexp_extract(rest, NAMED, 2))).when(comment, rest)
        .when(dialogue, spoken).otherwise(line).alias("words"),
    )


def clean_generated(df: DataFrame, raw: str = "raw", out: str = "text", example: Sequence[str] = ()) -> DataFrame:
    """The answer without furniture or anything said twice; one that repeats a phrase of the prompt's own `example` says nothing."""
    text = strip(F.regexp_replace(strip(F.col(raw)), "^`+|`+$", ""))
    nothing = (text == "") | text.isin(*NOTHING)
    for mark in example:
        nothing = nothing | F.contains(text, F.lit(mark))
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda s: s != "")
    one = F.lit(1.0)
    df = df.withColumn("_said", F.when(nothing, F.array().cast("array<string>")).otherwise(lines))
    df = df.withColumn("_said", F.transform("_said", _said))
    df = df.withColumn(
        "_comments", F.transform(F.filter("_said", lambda x: x["kind"] == "comment"), lambda x: x["words"])
    )

    def worth(x: Column) -> Column:
        named = F.concat(x["name"], F.lit("："), x["words"])
        return ~(
            (x["words"] == "") | x["words"].isin(*NOTHING) | N.is_noise(x["words"], one)
            | ((x["kind"] == "comment") & (x["name"] != "") & N.is_noise(named, one))
            | ((x["kind"] != "comment") & F.array_contains(F.col("_comments"), x["words"]))
        )

    written = F.transform(
        F.filter("_said", worth),
        lambda x: F.when(x["kind"] == "dialogue", F.concat(F.lit("- "), x["words"])).otherwise(x["line"]),
    )
    return df.withColumn(out, F.array_join(F.array_distinct(written), "\n")).drop("_said", "_comments")


def object_text(raw: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(raw, "(?s)\\{.*\\}", 0), F.lit(""))


def parse_object(raw: Column) -> Column:
    """The answer's JSON object as a variant; null where there is none.

    Of a key written twice the last counts, if the session allows it (`last_key_counts`).
    """
    parsed = F.try_parse_json(object_text(raw))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def last_key_counts(df: DataFrame) -> None:
    """Answers may repeat a key; Spark refuses such JSON unless the session says otherwise."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _field(obj: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(obj, f"$['{name}']", kind)


def _type_of(obj: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_field(obj, name, "variant")), F.lit("VOID"))


def _word(v: Column) -> Column:
    """One list entry as text, written as the models' answers are elsewhere."""
    kind = F.schema_of_variant(v)
    s = v.cast("string")
    return F.when(kind == "BOOLEAN", F.initcap(s)).when(kind == "VOID", F.lit("None")).otherwise(s)


def _words(obj: Column, name: str) -> Column:
    """A list's entries that are not blank, as they are; an empty list for what is none."""
    values = F.filter(F.transform(_field(obj, name, "array<variant>"), _word), lambda s: strip(s) != "")
    return F.when(_type_of(obj, name).startswith("ARRAY"), values).otherwise(F.array().cast("array<string>"))


def _list(obj: Column, name: str) -> Column:
    return F.transform(_words(obj, name), strip)


def _string(obj: Column, name: str) -> Column:
    return F.when(_type_of(obj, name) == "STRING", strip(_field(obj, name, "string"))).otherwise(F.lit(""))


def subject_name(name: Column) -> Column:
    """Nothing when the model named a kind of picture."""
    return F.when(name.isNull() | strip(name).rlike(KIND_NAME), F.lit("")).otherwise(strip(name))


def structure_notes(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Only the fields asked for, each of the type asked for, plus `ok`: whether there was an object at all."""
    last_key_counts(df)
    df = df.withColumn("_obj", parse_object(F.col(raw)))
    obj = F.col("_obj")
    cols = {NOTE_COLUMNS[f]: (_string if kind is str else _list)(obj, f) for f, kind in NOTE_FIELDS.items()}
    cols["type"] = F.when(cols["type"].isin(*NOTE_TYPES), cols["type"]).otherwise(F.lit(""))
    cols["name"] = subject_name(cols["name"])
    return df.select("*", *[F.coalesce(c).alias(n) for n, c in cols.items()], obj.isNotNull().alias("ok")).drop("_obj")


def describe(df: DataFrame, raw: str = "raw", out: str = "text") -> DataFrame:
    """An answer as one line of `key：value`, lists joined; what is no object stays as it is.

    Zero, false, null and blank values are left out; an object within the answer is written as JSON.
    """
    last_key_counts(df)
    df = df.withColumn("_obj", parse_object(F.col(raw)))
    obj = F.col("_obj")
    parts = []
    for f in DESCRIPTION_FIELDS:
        kind = _type_of(obj, f)
        listed = strip(F.array_join(_words(obj, f), "；"))
        single = strip(_word(_field(obj, f, "variant")))
        number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        nothing = (kind == "VOID") | (single == "False") & (kind == "BOOLEAN") | number & (single.try_cast("double") == 0) | kind.startswith("OBJECT<>")
        value = F.when(kind.startswith("ARRAY"), listed).when(nothing, F.lit("")).otherwise(single)
        parts.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{f}："), value)))
    whole = F.concat_ws(" ", *parts)
    return df.withColumn(out, F.when(obj.isNull(), F.col(raw)).otherwise(whole)).drop("_obj")


def rejects(structured: DataFrame) -> DataFrame:
    """How many answers were no object."""
    return structured.agg(F.count(F.lit(1)).alias("answers"), F.count_if(~F.col("ok")).alias("rejected"))


def wants_translation(text: Column) -> Column:
    """Some letters, and less than half of them Han."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    han = F.length(F.regexp_replace(text, "[^\\x{4e00}-\\x{9fff}]", ""))
    return (letters > 0) & (han * 2 < letters)


def display_text(text: Column) -> Column:
    """Without platform watermarks."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), WATERMARK, " ")
    return strip(F.regexp_replace(cleaned, "[ \\t]{2,}", " "))


def route_texts(main: DataFrame, names: DataFrame | None, descriptions: DataFrame | None) -> DataFrame:
    """(id, route, text): each item's own words with its name, and its description; nothing blank, no errors."""
    words = main.select("id", "text")
    if names is not None:
        named = names.select("id", subject_name(F.col("name")).alias("_name")).filter(F.col("_name") != "")
        joined = strip(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("_name")))
        words = words.join(named, "id", "full_outer").select(
            "id", F.when(F.col("_name").isNotNull(), joined).otherwise(F.col("text")).alias("text")
        )
    out = words.select("id", F.lit("ocr").alias("route"), "text")
    if descriptions is not None:
        good = descriptions.filter(F.col("error").isNull()) if "error" in descriptions.columns else descriptions
        out = out.unionByName(good.select("id", F.lit("vlm").alias("route"), "text"))
    return out.filter(strip(F.col("text")) != "")


def display_texts(main: DataFrame, tidied: DataFrame, script_map: dict[str, str] | None = None) -> DataFrame:
    """(id, text, foreign): the tidied text where there is one, else the rules' text, ready to show."""
    good = tidied.filter(F.col("error").isNull()) if "error" in tidied.columns else tidied
    better = good.select("id", F.col("text").alias("_tidy")).filter(strip(F.col("_tidy")) != "")
    chosen = F.coalesce("_tidy", "text")
    both = main.join(better, "id", "full_outer").select("id", chosen.alias("text")).filter(strip(F.col("text")) != "")
    return both.select(
        "id", fold_script(display_text(F.col("text")), script_map).alias("text"),
        wants_translation(F.col("text")).alias("foreign"),
    )
