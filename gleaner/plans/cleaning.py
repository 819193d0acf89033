"""Cleaning queries: common lines, noise, main text, generated text, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import noise as N
from gleaner.functions.text import norm, strip
from gleaner.operators import cleaning, generated, leaks
from gleaner.operators.ordering import top_k
from gleaner.plans import sql
from gleaner.plans.registry import Tables, query


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {_quoted('(?i)' + pattern)})"


def _cut(t: str, pattern: str) -> str:
    return f"regexp_replace({t}, {_quoted('(?i)' + pattern)}, '', 'g')"


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def noise_sql(t: str, n: str) -> str:
    """The noise rules for text read with full confidence."""
    cjk = f"length(regexp_replace({t}, {_quoted(N.NOT_CJK)}, '', 'g'))"
    latin = f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    left = f"length(regexp_replace({_cut(_cut(t, N.TIME), N.COUNTS)}, {_quoted(N.NOT_CJK)}, '', 'g'))"
    names = ", ".join(_quoted(p) for p in N.PLATFORMS)
    whole = " OR ".join(_hits(t, p) for p in (N.COUNTER, N.ACCOUNT_ID, N.ACCOUNT, N.CHROME, N.CREDIT, N.MONTH))
    return (
        f"({n} = '' OR {n} IN ({names}) OR regexp_matches({n}, {_quoted(N.MISREAD_MARK)}) "
        f"OR (length({n}) <= 2 AND {latin} > 0 AND {cjk} > 0) OR {whole} "
        f"OR (({_hits(t, N.TIME)} OR {_hits(t, N.COUNTS)}) AND {left} <= 4) OR ({cjk} = 0 AND {latin} <= 2))"
    )


LINES = f"""
lines AS (SELECT doc_id AS id, pos, line, {strip_sql('line')} AS t, {sql.norm('line')} AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
common AS (SELECT n, count(DISTINCT id) AS n_docs FROM lines WHERE length(n) >= 2 GROUP BY n HAVING count(DISTINCT id) >= 3),
flagged AS (SELECT id, pos, t, {noise_sql('t', 'n')} AS noise, n IN (SELECT n FROM common) AS shared FROM lines)
"""


def _lined(t: Tables) -> DataFrame:
    return t.docs().select("id", cleaning.plain_lines(F.col("text")).alias("lines"))


@query("o54_common_lines", f"WITH {LINES} SELECT n AS norm, n_docs::BIGINT AS n_docs FROM common")
def common_lines(t: Tables) -> DataFrame:
    return cleaning.common_lines(_lined(t))


@query("o78_is_noise", f"""
WITH {LINES} SELECT id, count(*)::BIGINT AS n_lines, count(*) FILTER (noise)::BIGINT AS n_noise FROM flagged GROUP BY id""")
def is_noise(t: Tables) -> DataFrame:
    flags = F.transform("lines", lambda x: N.is_noise(x["text"], x["score"]))
    read = _lined(t).select("id", F.size("lines").cast("bigint").alias("n_lines"), flags.alias("f"))
    return read.select("id", "n_lines", F.size(F.filter("f", lambda x: x)).cast("bigint").alias("n_noise"))


@query("o70_line_context", f"""
WITH {LINES} SELECT id, pos::BIGINT AS pos, md5(lag(t) OVER w) AS above, md5(lead(t) OVER w) AS below FROM flagged
WINDOW w AS (PARTITION BY id ORDER BY pos)""")
def line_context(t: Tables) -> DataFrame:
    """Each line with its neighbours: a look into the document's own array, no window."""
    with_both = F.transform(
        "lines",
        lambda x, i: F.struct(
            (i + 1).cast("bigint").alias("pos"), F.md5(strip(F.get(F.col("lines"), i - 1)["text"])).alias("above"),
            F.md5(strip(F.get(F.col("lines"), i + 1)["text"])).alias("below"),
        ),
    )
    return _lined(t).select("id", F.inline(with_both))


@query("o77_main_text", f"""
WITH {LINES},
islands AS (SELECT *, sum((noise OR shared)::INT) OVER (PARTITION BY id ORDER BY pos) AS island FROM flagged),
sentences AS (SELECT id, min(pos) AS spot, string_agg(t, ' ' ORDER BY pos) AS s FROM islands WHERE NOT (noise OR shared) GROUP BY id, island),
texts AS (SELECT id, string_agg(s, chr(10) ORDER BY spot) AS text FROM sentences GROUP BY id)
SELECT doc_id AS id, length(coalesce(t.text, ''))::BIGINT AS n_chars, md5(coalesce(t.text, '')) AS digest
FROM documents LEFT JOIN texts t ON t.id = doc_id""")
def main_text(t: Tables) -> DataFrame:
    """Documents without common and noise lines; plain text has no layout, so kept lines run on."""
    text = cleaning.main_text(_lined(t))
    return text.select("id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("o79_join_wrapped", f"""
WITH {LINES} SELECT id, md5(string_agg(t, ' ' ORDER BY pos)) AS digest FROM flagged GROUP BY id""")
def join_wrapped(t: Tables) -> DataFrame:
    """The joining fold alone, over every line of every document (unplaced lines make one row)."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda s: F.struct(
            strip(s).alias("text"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(0.0).alias("right"),
            F.lit(0.0).alias("bottom"), F.lit(True).alias("kept"),
        ),
    )
    return t.docs().select("id", lines.alias("lines")).select("id", F.md5(cleaning.join_wrapped(F.col("lines"))).alias("digest"))


ANSWERS = f"""
answers AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '{generated.COMMENT}' WHEN 'user' THEN '- ' ELSE '' END
                   || text || chr(10) || '- ' || split_part(text, chr(10), 1) AS raw FROM conversations),
said AS (SELECT conv_id, turn, pos, line,
    CASE WHEN starts_with(line, '{generated.COMMENT}') THEN 'comment' WHEN starts_with(line, '- ') OR line = '-' THEN 'dialogue' ELSE 'text' END AS kind
  FROM (SELECT conv_id, turn, {strip_sql('line')} AS line, pos FROM (
    SELECT conv_id, turn, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS pos FROM answers))
  WHERE line <> ''),
parts AS (SELECT *, CASE kind WHEN 'comment' THEN {strip_sql("regexp_replace(substring(line, 5), '^[^：:]{1,24}[：:][[:space:]]*(.+)$', '\\1')")}
    WHEN 'dialogue' THEN {strip_sql(f"regexp_replace({strip_sql('substring(line, 2)')}, '^- ', '')")} ELSE line END AS words FROM said),
normed AS (SELECT *, {sql.norm('words')} AS n FROM parts),
kept AS (SELECT *, CASE kind WHEN 'dialogue' THEN '- ' || words ELSE line END AS written FROM normed p
  WHERE words <> '' AND NOT {noise_sql('words', 'n')}
    AND NOT (kind <> 'comment' AND EXISTS (SELECT 1 FROM parts c WHERE c.conv_id = p.conv_id AND c.turn = p.turn AND c.kind = 'comment' AND c.words = p.words))),
firsts AS (SELECT conv_id, turn, written, min(pos) AS pos FROM kept GROUP BY conv_id, turn, written),
cleaned AS (SELECT conv_id, turn, string_agg(written, chr(10) ORDER BY pos) AS text FROM firsts GROUP BY conv_id, turn)
"""


@query("o82_clean_generated", f"""
WITH {ANSWERS} SELECT a.conv_id, a.turn, length(coalesce(c.text, ''))::BIGINT AS n_chars, md5(coalesce(c.text, '')) AS digest
FROM answers a LEFT JOIN cleaned c USING (conv_id, turn)""")
def clean_generated(t: Tables) -> DataFrame:
    """Turns as answers: an assistant's is a comment, a user's a dialogue; the first line is said again."""
    lead = F.when(F.col("role") == "assistant", generated.COMMENT).when(F.col("role") == "user", "- ").otherwise("")
    again = F.concat(F.lit("\n- "), F.split("text", "\n")[0])
    answers = t.spread("conversations").select("conv_id", "turn", F.concat(lead, F.col("text"), again).alias("raw"))
    cleaned = generated.clean_generated(answers)
    return cleaned.select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _notes(t: Tables) -> DataFrame:
    """Events as a model's notes: purchases answer nothing usable."""
    raw = F.when(F.col("event_type") == "purchase", F.concat(F.lit("no object: "), F.col("event_type"))).otherwise(
        F.concat(F.lit('好的：{"类型": "其他", "梗": "'), F.col("event_type"), F.lit('", "画面": '), F.get_json_object("props", "$.k"),
                 F.lit(', "情绪": ["'), F.col("event_type"), F.lit('", '), F.get_json_object("props", "$.k"), F.lit(', " "], "多余": 1} 完')))
    return t.events.select("event_id", raw.alias("raw"))


@query("o83_structure_notes", """
SELECT event_id, event_type <> 'purchase' AS ok, CASE WHEN event_type = 'purchase' THEN '' ELSE '其他' END AS type,
  CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS name, '' AS scene,
  CASE WHEN event_type = 'purchase' THEN '' ELSE event_type || '；' || json_extract_string(props, '$.k') END AS mood
FROM events""")
def structure_notes(t: Tables) -> DataFrame:
    got = generated.structure_notes(_notes(t))
    return got.select("event_id", "ok", "type", "name", "scene", F.array_join("mood", "；").alias("mood"))


@query("o83_describe", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'no object: purchase' ELSE
  CASE WHEN json_extract_string(props, '$.k') = '0' THEN '' ELSE '画面：' || json_extract_string(props, '$.k') || ' ' END || '情绪：' || event_type || '；' || json_extract_string(props, '$.k') || ' 梗：' || event_type END AS text
FROM events""")
def describe(t: Tables) -> DataFrame:
    return generated.describe(_notes(t)).select("event_id", "text")


@query("o83_rejects", """
SELECT count(*)::BIGINT AS answers, count(*) FILTER (event_type = 'purchase')::BIGINT AS rejected FROM events""")
def rejects(t: Tables) -> DataFrame:
    return generated.rejects(generated.structure_notes(_notes(t)))


@query("o86_route_texts", """
WITH r AS (
  SELECT doc_id AS id, 'ocr' AS route, regexp_replace(text || CASE WHEN source = 'src0' THEN '' ELSE chr(10) || source END, '^\\s+|\\s+$', '', 'g') AS text
  FROM documents
  UNION ALL SELECT doc_id, 'vlm', 'quality：' || quality FROM labels WHERE toxic = 0)
SELECT id, route, md5(text) AS digest FROM r WHERE text <> ''""")
def route_texts(t: Tables) -> DataFrame:
    """Own words with the source as name (src0 names a kind of picture), and labels as descriptions."""
    name = F.when(F.col("source") == "src0", "猫猫表情包").otherwise(F.col("source"))
    names = t.documents.select(F.col("doc_id").alias("id"), name.alias("name"))
    described = t.labels.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("quality："), F.col("quality")).alias("text"),
        F.when(F.col("toxic") == 1, "refused").alias("error"))
    return generated.route_texts(t.docs(), names, described).select("id", "route", F.md5("text").alias("digest"))


@query("o86_display_texts", """
WITH c AS (SELECT doc_id AS id, CASE WHEN l.quality = 1 THEN 'tidy @' || d.source || ' ' || d.lang ELSE d.text END AS text
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(text, '@[\\p{L}\\p{N}_.-]{2,}', ' ', 'g'), '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest,
       regexp_matches(text, '\\p{L}') AS foreign FROM c WHERE regexp_matches(text, '\\S')""")
def display_texts(t: Tables) -> DataFrame:
    """Documents labelled good have a tidied text with an account in it, which is not shown."""
    tidied = t.labels.filter("quality = 1").select(F.col("doc_id").alias("id")).join(
        t.documents.withColumnRenamed("doc_id", "id"), "id").select(
        "id", F.concat(F.lit("tidy @"), F.col("source"), F.lit(" "), F.col("lang")).alias("text"))
    return generated.display_texts(t.docs(), tidied).select("id", F.md5("text").alias("digest"), "foreign")


@query("o22_scan_leaks", """
WITH parts AS (SELECT DISTINCT part FROM (SELECT unnest(regexp_split_to_array(url, '[\\\\/:\\-_.\\s]+')) AS part FROM pages)
  WHERE (length(part) >= 6 OR (length(part) >= 4 AND regexp_matches(part, '[0-9]')))
    AND lower(part) NOT IN ('private', 'memes', 'data', 'path', 'work', 'home', 'users', 'code', 'desktop')),
words AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS word FROM documents)
SELECT id, array_to_string(list_sort(list(DISTINCT part)), ',') AS parts FROM words JOIN parts ON word = lower(part) GROUP BY id""")
def scan_leaks(t: Tables) -> DataFrame:
    """Words of page addresses found in documents."""
    parts = leaks.denylist_parts(t.pages.select(F.col("url").alias("value")))
    found = leaks.leak_report(leaks.scan_leaks(t.docs(), parts))
    return found.select("id", F.array_join("parts", ",").alias("parts"))


@query("o21_pick_captions", """
WITH l AS (SELECT source, doc_id, n_chars, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT *, unnest(range(1, len(lines))) AS i FROM l),
e AS (SELECT source AS template, n_chars, 'src/' || doc_id || '/' || i AS url,
    regexp_replace(lines[i], '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(lines[i + 1], '^\\s+|\\s+$', '', 'g') AS b FROM p),
good AS (SELECT *, a || ' / ' || b AS caption FROM e WHERE a <> '' AND b <> ''
  AND length(a || ' / ' || b) BETWEEN 10 AND 120 AND NOT contains(lower(a || b), 'http') AND regexp_full_match(a || ' / ' || b, '[\\x20-\\x7e]+'))
SELECT template, url, caption, rank FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY n_chars DESC, url) AS rank FROM good) WHERE rank <= 3""")
def pick_captions(t: Tables) -> DataFrame:
    """Every two lines of a document that follow each other as two boxes, its length as votes, its source as template."""
    from gleaner.operators.captions import pick_captions as pick

    lines = F.split("text", "\n")
    entries = t.documents.select("source", "doc_id", "n_chars", F.posexplode(F.arrays_zip(
        lines.alias("a"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("b"))).alias("i", "two"))
    entries = entries.filter(F.col("two.b").isNotNull()).select(
        F.col("source").alias("template"), F.array("two.a", "two.b").alias("boxes"),
        F.concat(F.lit("src/"), "doc_id", F.lit("/"), F.col("i") + 1).alias("url"), F.format_number("n_chars", 0).alias("votes"))
    return pick(entries, 3).select("template", "url", "caption", "rank")


def _glue_sql(a: str, b: str) -> str:
    return f"CASE WHEN regexp_matches(right({a}, 1), '[^\\x00-\\x7f]') AND regexp_matches(left({b}, 1), {_quoted(N.CJK)}) THEN '' ELSE ' ' END"


_WIDE = f"length(regexp_replace(t, {_quoted(N.NOT_CJK)}, '', 'g'))"


@query("o79_join_placed", f"""
WITH RECURSIVE {LINES},
measured AS (SELECT id, pos, t, NOT noise AS kept, length(t) AS n, pos % 2 = 0 AND length(t) % 3 = 0 AS beside,
  lag(length(t)) OVER (PARTITION BY id ORDER BY pos) AS n_above FROM flagged),
cornered AS (SELECT *, (CASE WHEN beside THEN 11 * n_above + 50 * (n % 3) + 20 * (n % 2) - 20 WHEN n % 5 = 0 THEN 300 ELSE 0 END)::DOUBLE AS l,
  (70 * (pos - 1 - beside::INT))::DOUBLE AS u FROM measured),
placed AS MATERIALIZED (SELECT *, l + n * (10 + 2 * (n % 3)) AS r, u + 30 + 12 * (n % 4) AS d FROM cornered),
walk AS (
  SELECT id, pos, CASE WHEN kept THEN l END AS wl, CASE WHEN kept THEN u END AS wu, CASE WHEN kept THEN r END AS wr,
    CASE WHEN kept THEN d END AS wd, kept::INT AS mark FROM placed WHERE pos = 1
  UNION ALL
  SELECT id, pos, CASE WHEN kept THEN CASE WHEN on_it THEN least(wl, l) ELSE l END END, CASE WHEN kept THEN CASE WHEN on_it THEN least(wu, u) ELSE u END END,
    CASE WHEN kept THEN CASE WHEN on_it THEN greatest(wr, r) ELSE r END END, CASE WHEN kept THEN CASE WHEN on_it THEN greatest(wd, d) ELSE d END END,
    CASE WHEN NOT kept THEN 0 WHEN NOT on_it THEN 1 WHEN l - wr > (wd - wu) / 2 THEN 3 ELSE 2 END
  FROM (SELECT p.*, wl, wu, wr, wd, wl IS NOT NULL AND least(wd, d) - greatest(wu, u) >= least(wd - wu, d - u) / 2
      AND least(wd - wu, d - u) >= 0.6::DOUBLE * greatest(wd - wu, d - u) AND l >= wr - (wd - wu) / 2 AS on_it
    FROM walk w JOIN placed p ON p.id = w.id AND p.pos = w.pos + 1)),
marked AS (SELECT id, pos, mark, l, u, r, d, t, sum((mark <= 1)::INT) OVER w AS place,
  CASE mark WHEN 1 THEN '' WHEN 3 THEN ' ' ELSE {_glue_sql('lag(t) OVER w', 't')} END || t AS piece
  FROM walk JOIN placed USING (id, pos) WINDOW w AS (PARTITION BY id ORDER BY pos)),
rows AS (SELECT id, place, max(mark) > 0 AS kept, string_agg(piece, '' ORDER BY pos) AS t, min(l) AS l, min(u) AS u, max(r) AS r, max(d) AS d
  FROM marked GROUP BY id, place),
sized AS (SELECT *, (r - l) / greatest(1, {_WIDE} + 0.55::DOUBLE * (length(t) - {_WIDE})) AS letter FROM rows),
above AS (SELECT *, lag(kept) OVER w AS k0, lag(t) OVER w AS t0, lag(l) OVER w AS l0, lag(u) OVER w AS u0, lag(r) OVER w AS r0, lag(d) OVER w AS d0,
  lag(letter) OVER w AS letter0 FROM sized WINDOW w AS (PARTITION BY id ORDER BY place)),
joined AS (SELECT *, coalesce(k0 AND u - d0 >= 0 AND u - d0 < greatest(d0 - u0, d - u)
  AND least(abs(l - l0), abs((l + r) / 2 - (l0 + r0) / 2)) < 1.5::DOUBLE * greatest(d0 - u0, d - u)
  AND r0 - l0 >= 0.8::DOUBLE * (r - l) AND least(letter, letter0) >= 0.8::DOUBLE * greatest(letter, letter0)
  AND NOT contains('{N.SENTENCE_ENDS}', right(t0, 1)), FALSE) AS goes_on FROM above)
SELECT id, count(*) FILTER (kept AND NOT goes_on)::BIGINT AS n_sentences,
  md5(coalesce(substr(string_agg(CASE WHEN goes_on THEN {_glue_sql('t0', 't')} ELSE chr(10) END || t, '' ORDER BY place) FILTER (kept), 2), '')) AS digest
FROM joined GROUP BY id""")
def join_placed(t: Tables) -> DataFrame:
    """Lines on a page laid out by their own lengths: some stand beside the one before, heights and letters differ, and
    noise lines are dropped between them."""
    def place(s: Column, i: Column, texts: Column) -> Column:
        n = F.length(s)
        beside = (i % 2 == 1) & (n % 3 == 0)
        left = F.when(beside, 11 * F.length(F.get(texts, i - 1)) + 50 * (n % 3) + 20 * (n % 2) - 20).when(n % 5 == 0, 300).otherwise(0).cast("double")
        top = (70 * (i - beside.cast("int"))).cast("double")
        return F.struct(
            s.alias("text"), left.alias("left"), top.alias("top"), (left + n * (10 + 2 * (n % 3))).alias("right"),
            (top + 30 + 12 * (n % 4)).alias("bottom"), (~N.is_noise(s, F.lit(1.0))).alias("kept"),
        )

    texts = t.docs().select("id", F.transform(F.split("text", "\n"), strip).alias("texts"))
    lines = texts.select("id", F.transform("texts", lambda s, i: place(s, i, F.col("texts"))).alias("lines"))
    joined = lines.select("id", cleaning.join_wrapped(F.col("lines")).alias("text"))
    n_sentences = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    return joined.select("id", n_sentences.alias("n_sentences"), F.md5("text").alias("digest"))
