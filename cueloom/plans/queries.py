"""One query per operator or small family, over the driver's whole tables, with its SQL.

``query`` registers a function of (spark, sf_dir); its SQL, if any, is what
follows WITH and is given the named inputs first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T, timecode as C
from ..operators import align, artifacts as A, model_cues, overlaps, providers, replies as R, segment as S, spans, splitter, tokens as K, windows as W
from ..operators.store import Store
from ..shared import removed_at_exit, shared_dir, shared_table
from ..sinks import render
from ..sources import cue_files, timed_text
from ..streaming import events as E
from . import inputs as I, pipelines, table_functions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *given: str, recursive: bool = False):
    """Register the decorated function; ``given`` are common table expressions that ``sql`` reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            head = ",\n".join(given)
            sep = ",\n" if sql.lstrip().startswith("@") else "\n"
            ORACLES[name] = (f"with {'recursive ' if recursive else ''}{head}{sep if given else ''}" if given or recursive else "") + sql.lstrip().removeprefix("@")
        return f

    return add


def _scratch(spark: SparkSession) -> str:
    """A folder for files that a query writes and reads again; removed when the driver ends."""
    path = shared_dir(spark)
    removed_at_exit(spark, path)
    return path


MS = "cast(round_even({0} * 1000, 0) as bigint)"


def clock(x: str, mark: str) -> str:
    ms = f"greatest(0, {MS.format(x)})"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def lrc_clock(x: str) -> str:
    cs = f"cast(round_even(greatest(0, {x}) * 100, 0) as bigint)"
    return f"printf('[%02d:%02d.%02d]', {cs} // 6000, {cs} // 100 % 60, {cs} % 100)"


# --- functions ---------------------------------------------------------------


@query(
    "fn_timecodes",
    f"""select l_orderkey, l_linenumber, s, {clock('s', ',')} srt, {clock('s', '.')} vtt, {lrc_clock('s')} lrc,
  case when s >= 3600 then (cast(floor(s / 60) as bigint) // 60)::varchar || ':' else '' end || printf('%02d:%02d.%d', cast(floor(s / 60) as bigint) % 60, t // 10, t % 10) human,
  printf('chunk-%05d-%d.%03d-%d.%03d', l_linenumber, m // 1000, m % 1000, (m + 1500) // 1000, (m + 1500) % 1000) stem
from (select *, {MS.format('s')} m, cast(round_even((s - floor(s / 60) * 60) * 10, 0) as bigint) t from (select l_orderkey, l_linenumber, l_extendedprice / 10 as s from lineitem))""",
)
def fn_timecodes(spark, sf):
    s = F.col("s")
    rows = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "s", C.srt_time(s).alias("srt"), C.vtt_time(s).alias("vtt"), C.lrc_time(s).alias("lrc"), C.human_time(s).alias("human"), C.chunk_stem(F.col("l_linenumber"), s, s + 1.5).alias("stem"))


@query(
    "fn_cue_texts",
    """select media_id, id, text original, coalesce(nullif(proofread, ''), text) proofread, coalesce(translation, '') translation,
  coalesce(nullif(proofread, ''), text) || case when coalesce(translation, '') = '' then '' else chr(10) || translation end bilingual,
  array_to_string([rtrim(x, ',.;:!?，。；：！？、') for x in string_split(text, chr(10))], chr(10)) bare from cues""",
    I.CUES,
)
def fn_cue_texts(spark, sf):
    mode = lambda m: T.text_by_mode(m, F.col("text"), F.col("proofread"), F.col("translation")).alias(m)
    return I.cues(spark, sf).select("media_id", "id", *[mode(m) for m in render.MODES], T.without_line_stops(F.col("text")).alias("bare"))


@query("fn_shifted_tokens", """select media_id, window_index, pos, text, start + window_index * 12.5::double as start, "end" + window_index * 12.5::double as "end" from tokens""", I.TOKENS)
def fn_shifted_tokens(spark, sf):
    nested = I.tokens(spark, sf).groupBy("media_id", "window_index").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end"))).alias("tokens"))
    moved = nested.select("media_id", "window_index", F.posexplode(K.shifted(F.col("tokens"), F.col("window_index") * 12.5)).alias("pos", "t"))
    return moved.select("media_id", "window_index", "pos", "t.text", "t.start", "t.end")


@query(
    "fn_normal_forms",
    """select doc_id, md5(regexp_replace(text, '[\\s|]', '', 'g')) plain, md5(lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))) content,
  md5(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]', '', 'g')) aligned from documents""",
)
def fn_normal_forms(spark, sf):
    t = F.col("text")
    return I.table(spark, sf, "documents").select("doc_id", F.md5(T.without_spaces(t, True)).alias("plain"), F.md5(T.content_only(t)).alias("content"), F.md5(T.for_alignment(t)).alias("aligned"))


PARTS = "[A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9 \n]"


@query(
    "fn_joined_parts",
    """@parts as (select conv_id, turn, unnest(w) p, unnest(range(len(w))) k from (select conv_id, turn, regexp_extract_all(text, '[A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9 \\n]') w from conversations)),
near as (select *, lag(p) over (partition by conv_id, turn order by k) q from parts)
select conv_id, turn, string_agg(case when q is null or regexp_matches(right(q, 1), '^[(\\[{（【「『，。；：！？、'']$') or regexp_matches(left(p, 1), '^[,.;:!?，。；：！？、)\\]}）】」』'']$') or (regexp_matches(right(q, 1), '[0-9]') and regexp_matches(left(p, 1), '[0-9]')) then p else ' ' || p end, '' order by k) joined
from near group by conv_id, turn""",
    "one as (select 1)",
)
def fn_joined_parts(spark, sf):
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(PARTS), F.lit(0)).alias("parts"))
    return rows.where(F.size("parts") > 0).select("conv_id", "turn", T.join_parts(F.col("parts")).alias("joined"))


@query(
    "fn_measures",
    """@l as (select doc_id, text, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'Japanese' when doc_id % 5 = 2 then ' zh-CN' else lang end named from documents),
r as (select *, case when starts_with(lower(trim(coalesce(named, ''))), 'ja') then 'ja' when starts_with(lower(trim(coalesce(named, ''))), 'zh') then 'zh' else 'en' end resolved from l),
m as (select *, case when resolved in ('ja', 'zh') then length(regexp_replace(text, '\\s', '', 'g')) else length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) end n, case resolved when 'ja' then 26 when 'zh' then 32 else 84 end most from r)
select doc_id, resolved, cast(n as int) n, cast(most as int) most, n > most or n / 15.0::double > 7 as overlong, n > most or n / 15.0::double > 7 * 1.1::double as hard from m""",
    "one as (select 1)",
)
def fn_measures(spark, sf):
    named = F.expr("case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'Japanese' when doc_id % 5 = 2 then ' zh-CN' else lang end")
    limits = T.Limits()
    rows = I.table(spark, sf, "documents").select("doc_id", "text", T.language_of(named, F.col("text")).alias("resolved"))
    rows = rows.withColumn("n", T.measure(F.col("text"), F.col("resolved"))).withColumn("d", F.col("n") / F.lit(15.0))
    over = lambda slack: T.overlong(F.col("d"), F.col("n"), F.col("resolved"), limits, slack)
    return rows.select("doc_id", "resolved", "n", limits.total_chars(F.col("resolved")).alias("most"), over(1.0).alias("overlong"), over(1.10).alias("hard"))


WORDS = ", ".join(f"'{w}'" for w in T.BREAK_BEFORE)
MAJOR_SQL, SOFT_SQL = ("regexp_matches(regexp_replace(trim({0}), '[\"''”’)\\]}）】」』]+$', ''), '[" + s + "]$')" for s in (".!?。！？", ",;:，；：、"))
SCORE_SQL = (
    "greatest(case when " + MAJOR_SQL.replace("{0}", "text") + " then 100.0 when " + SOFT_SQL.replace("{0}", "text") + " then 80.0 else 0.0 end,"
    " case when greatest(0, nstart - \"end\") >= 0.65::double then 70.0 + least(greatest(0, nstart - \"end\"), 1.5) * 5.0 else 0 end,"
    f" case when regexp_extract(lower(trim(nxt)), '^[a-z'']+') in ({WORDS}) then 45 else 0 end)::double"
)


@query(
    "fn_boundaries",
    f"""@n as (select *, lead(text) over w nxt, lead(start) over w nstart from tokens window w as (partition by media_id, window_index order by pos))
select media_id, window_index, pos, {MAJOR_SQL.replace('{0}', 'text')} major, {SOFT_SQL.replace('{0}', 'text')} soft, {SCORE_SQL} score from n where nxt is not null""",
    I.TOKENS,
)
def fn_boundaries(spark, sf):
    by = Window.partitionBy(*I.TOKEN_KEYS).orderBy("pos")
    rows = I.tokens(spark, sf).withColumn("nxt", F.lead("text").over(by)).withColumn("nstart", F.lead("start").over(by)).where("nxt is not null")
    score = T.boundary_score(F.col("text"), F.col("nxt"), F.col("end"), F.col("nstart"), F.lit("en"))
    return rows.select(*I.TOKEN_KEYS, "pos", T.major_boundary(F.col("text")).alias("major"), T.soft_boundary(F.col("text")).alias("soft"), score.alias("score"))


@query(
    "fn_penalties",
    """@m as (select media_id, id, ("end" - start) / 4 d, length(text) n from cues)
select media_id, id, case when d < 0.833::double then (0.833::double - d) / 0.833::double * 35 else 0 end short,
  case when d > 7 then d / 7 - 1 else 0 end + case when n > 84 then n / 84.0::double - 1 else 0 end + case when n / d > 20 then n / d / 20 - 1 else 0 end excess from m""",
    I.CUES,
)
def fn_penalties(spark, sf):
    rows = I.cues(spark, sf).select("media_id", "id", ((F.col("end") - F.col("start")) / 4).alias("d"), F.length("text").alias("n"))
    return rows.select("media_id", "id", T.short_penalty(F.col("d")).alias("short"), T.overflow(F.col("d"), F.col("n"), F.col("n") / F.col("d"), F.lit("en")).alias("excess"))


@query(
    "fn_reply_json",
    """select conv_id, turn, case when turn % 4 < 3 then '{"n":' || turn || '}' end body, case when turn % 4 < 3 then turn else -1 end as n from conversations""",
)
def fn_reply_json(spark, sf):
    reply = F.expr("""case turn % 4 when 0 then concat('{"n":', turn, '}') when 1 then concat('```json\n{"n":', turn, '}\n```') when 2 then concat('Sure: {"n":', turn, '} as asked') else 'no JSON [here' end""")
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", T.json_part(reply).alias("body"))
    return rows.withColumn("n", F.coalesce(F.get_json_object("body", "$.n").cast("long"), F.lit(-1).cast("long")))


@query(
    "fn_prompts",
    """select media_id, id, md5('Put the character | wherever a new subtitle should begin. Change nothing else.' || chr(10) || case when id % 2 = 0 then 'The text is too long for one subtitle: use the delimiter at least once.' || chr(10) else '' end
  || case when coalesce(proofread, '') <> '' then 'Context: ' || proofread || chr(10) else '' end || 'Text: ' || text) prompt from cues""",
    I.CUES,
)
def fn_prompts(spark, sf):
    return I.cues(spark, sf).select("media_id", "id", F.md5(T.prompt(F.col("text"), F.col("proofread"), F.col("id") % 2 == 0)).alias("prompt"))


@query(
    "fn_timed_items",
    "select event_id, event_type as text, case when event_id % 2 = 0 then value else value / 2 end as start, value * 3 as \"end\" from events",
)
def fn_timed_items(spark, sf):
    item = F.expr("case when event_id % 2 = 0 then to_json(named_struct('text', event_type, 'start', value, 'end', value * 3)) else to_json(named_struct('text', '', 'word', event_type, 'start_time', value / 2, 'end_time', value * 3)) end")
    return R.timed_items(I.table(spark, sf, "events").select("event_id", item.alias("item")))


# --- sources and sinks -------------------------------------------------------


@query("src_srt", f"select media_id, id, {MS.format('start')} / 1000.0::double as start, {MS.format('\"end\"')} / 1000.0::double as \"end\", trim(regexp_replace(text, '\\n{2,}', chr(10), 'g'), ' ' || chr(10)) as text from cues where text <> ''", I.CUES)
def src_srt(spark, sf):
    """Cues rendered as SRT files with carriage returns and a byte-order mark, and scanned again."""
    tidy = I.cues(spark, sf).withColumn("text", F.regexp_replace("text", "\n{2,}", "\n"))
    files = render.render_srt(tidy)
    return timed_text.parse_srt(files.select("media_id", F.concat(F.lit("﻿"), F.replace("content", F.lit("\n"), F.lit("\r\n"))).alias("content")))


@query(
    "src_srt_errors",
    """select media_id, case when cast(media_id as bigint) % 3 = 0 then 'duplicate cue id: ' || min(id) else 'timing line does not read' end reason from cues where text <> '' and cast(media_id as bigint) % 3 < 2 group by media_id
union all select media_id, 'cues: ' || count(*) from cues where text <> '' and cast(media_id as bigint) % 3 = 2 group by media_id""",
    I.CUES,
)
def src_srt_errors(spark, sf):
    """Two files of three do not read: their first cue comes twice, or a timing line has an arrow too many. The others do."""
    content = F.expr("case cast(media_id as bigint) % 3 when 0 then concat(content, '\n', split(content, '\n\n')[0], '\n') when 1 then concat(content, '\n99\n00:00:01,000 --> 00:00:02,000 --> 3\nx\n') else content end")
    tidy = I.cues(spark, sf).withColumn("text", F.regexp_replace("text", "\n{2,}", "\n"))
    cues, errors = timed_text.readable_srt(render.render_srt(tidy).select("media_id", content.alias("content")))
    return errors.unionByName(cues.groupBy("media_id").agg(F.concat(F.lit("cues: "), F.count("*")).alias("reason")))


def _song(spark, sf) -> DataFrame:
    rows = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("media_id"), "lang", "text")
    timed = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(C.lrc_time(i * 2.5), C.lrc_time(i * 3.25), F.lit("<00:01.5>"), x))
    return rows.select("media_id", F.lit(".lrc").alias("suffix"), F.concat(F.lit("[ti:song]\r\n[offset:+100]\r\n[la:"), "lang", F.lit("]\r\n"), F.array_join(timed, "\r\n")).alias("content"))


SONG = """l as (select cast(doc_id as varchar) media_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as text, unnest(range(len(string_split(text, chr(10))))) k from documents)"""


@query("src_lrc", "select media_id, cast(row_number() over (partition by media_id order by k) as int) line_no, md5(text) as text from l where text <> ''", SONG)
def src_lrc(spark, sf):
    return timed_text.parse_lrc(_song(spark, sf))[1].withColumn("text", F.md5("text"))


@query("src_lrc_tags", """select cast(doc_id as varchar) media_id, cast(unnest([0, 2]) as int) as at, unnest(['[ti:song]', '[la:' || lang || ']']) line from documents""")
def src_lrc_tags(spark, sf):
    return timed_text.untimed_lines(_song(spark, sf))[0]


@query("src_untimed_lines", "select media_id, cast(row_number() over (partition by media_id order by k) as int) line_no, md5(text) as text from l where text <> ''", SONG)
def src_untimed_lines(spark, sf):
    plain = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("media_id"), F.lit(".txt").alias("suffix"), F.replace("text", F.lit("\n"), F.lit("\r")).alias("content"))
    return timed_text.untimed_lines(plain)[1].withColumn("text", F.md5("text"))


@query("src_media_identity", "select doc_id, substr(sha1(source || '/' || doc_id || '|' || (doc_id * 1000) || '|' || n_chars), 1, 16) media_id from documents")
def src_media_identity(spark, sf):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return I.table(spark, sf, "documents").select("doc_id", T.media_id(path, F.col("doc_id") * 1000, F.col("n_chars")).alias("media_id"))


STEM_SAME = "a.media_id = w.media_id and a.window_index = w.window_index and a.start = w.start and a.\"end\" = w.\"end\" and a.model_id = 'large' and a.language is not distinct from w.hint"


@query("src_cached_asr", f"select w.media_id, w.window_index, payload from windows w left join artifacts a on {STEM_SAME} and a.kind = 'asr'", I.ARTIFACTS, I.WINDOWS)
def src_cached_asr(spark, sf):
    return A.with_asr(I.windows(spark, sf), I.artifacts(spark, sf), "large").select("media_id", "window_index", "payload")


@query("src_cached_alignment", f"select w.media_id, w.window_index, payload from windows w left join artifacts a on {STEM_SAME} and a.kind = 'alignment' and a.transcript_sha1 = sha1(w.transcript)", I.ARTIFACTS, I.WINDOWS)
def src_cached_alignment(spark, sf):
    return A.with_alignment(I.windows(spark, sf), I.artifacts(spark, sf), "large").select("media_id", "window_index", "payload")


SHOWN = "shown as (select media_id, row_number() over (partition by media_id order by id) n, id, start, \"end\", {0} as t from cues)"
BILINGUAL = "coalesce(nullif(proofread, ''), text) || case when coalesce(translation, '') = '' then '' else chr(10) || translation end"


@query("snk_srt", f"select media_id, md5(string_agg(n || chr(10) || {clock('start', ',')} || ' --> ' || {clock('\"end\"', ',')} || chr(10) || t, chr(10) || chr(10) order by n) || chr(10)) content from shown where t <> '' group by media_id", I.CUES, SHOWN.format(BILINGUAL))
def snk_srt(spark, sf):
    return render.render_srt(I.cues(spark, sf), "bilingual").withColumn("content", F.md5("content"))


@query("snk_written_texts", f"select media_id || '.original.srt' as name, md5(string_agg(n || chr(10) || {clock('start', ',')} || ' --> ' || {clock('\"end\"', ',')} || chr(10) || t, chr(10) || chr(10) order by n) || chr(10)) content from shown where t <> '' group by media_id", I.CUES, SHOWN.format("text"))
def snk_written_texts(spark, sf):
    """Files of the output matrix under their own names, written and scanned again byte by byte."""
    path = _scratch(spark)
    cue_files.write_cues(I.cues(spark, sf), path, "srt", suffix=".original")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("content"))


@query("src_written_srt", f"""select media_id, n as id, round(start, 3) as start, round("end", 3) as "end" from shown where t <> ''""", I.CUES, SHOWN.format("text"))
def src_written_srt(spark, sf):
    """Files written and read as the format, by their names."""
    path = _scratch(spark)
    cue_files.write_cues(I.cues(spark, sf), path)
    return cue_files.read_cues(spark, path).select("media_id", F.col("id").cast("long").alias("id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("src_vtt_files", """select media_id, cast(row_number() over (partition by media_id order by n) as int) id, md5(trim(t, ' ' || chr(10))) as text, round(start, 3) as start, round("end", 3) as "end" from shown where t <> '' and starts_with(media_id, '1')""", I.CUES, SHOWN.format("coalesce(translation, '')"))
def src_vtt_files(spark, sf):
    """A condition on media_id chooses the files that are opened."""
    path = _scratch(spark)
    cue_files.write_cues(I.cues(spark, sf), path, "vtt", "translation")
    read = cue_files.read_cues(spark, path, "vtt").where(F.col("media_id").startswith("1"))
    return read.select("media_id", "id", F.md5("text").alias("text"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


LRC_FILES = """said as (select media_id, n, t, round_even(greatest(0, start) * 100, 0) / 100 as start from shown),
lines as (select media_id, n as at_line, false tag, start, t as text from said union all select distinct media_id, 0, true, null, '[ti:' || media_id || ']' from said)"""


@query("src_lrc_files", """select media_id, tag, round(start, 3) as start, md5(text) as text, cast(row_number() over (partition by media_id order by at_line) as int) n from lines""", I.CUES, SHOWN.format("replace(text, chr(10), ' ')"), LRC_FILES)
def src_lrc_files(spark, sf):
    """Tag lines and timed lines."""
    path = _scratch(spark)
    lines = I.cues(spark, sf).select("media_id", F.col("id").alias("at"), F.lit(False).alias("tag"), "start", F.translate("text", "\n", " ").alias("text"))
    tags = lines.select("media_id").distinct().select("media_id", F.lit(0).alias("at"), F.lit(True).alias("tag"), F.lit(None).cast("double").alias("start"), F.concat(F.lit("[ti:"), "media_id", F.lit("]")).alias("text"))
    cue_files.write_rows(lines.unionByName(tags), path, "lrc")
    read = cue_files.read_cues(spark, path, "lrc")
    order = F.row_number().over(Window.partitionBy("media_id").orderBy("at")).alias("n")
    return read.select("media_id", "tag", F.round("start", 3).alias("start"), F.md5("text").alias("text"), order)


@query("snk_vtt", f"select media_id, md5('WEBVTT' || chr(10) || chr(10) || coalesce(string_agg({clock('start', '.')} || ' --> ' || {clock('\"end\"', '.')} || chr(10) || t || chr(10), chr(10) order by n) filter (t <> ''), '')) content from shown group by media_id", I.CUES, SHOWN.format("coalesce(translation, '')"))
def snk_vtt(spark, sf):
    return render.render_vtt(I.cues(spark, sf), "translation").withColumn("content", F.md5("content"))


@query("snk_lrc", f"select media_id, md5('[ti:x]' || chr(10) || '[ar:' || media_id || ']' || chr(10) || string_agg({lrc_clock('start')} || t, chr(10) order by n) || chr(10)) content from shown group by media_id", I.CUES, SHOWN.format("text"))
def snk_lrc(spark, sf):
    cues = I.cues(spark, sf)
    tags = cues.select("media_id").distinct().select("media_id", F.inline(F.array(F.struct(F.lit(1).alias("at"), F.lit("[ti:x]").alias("line")), F.struct(F.lit(2).alias("at"), F.concat(F.lit("[ar:"), "media_id", F.lit("]")).alias("line")))))
    return render.render_lrc(cues, tags).withColumn("content", F.md5("content"))


@query(
    "snk_json",
    """select media_id, md5('[' || chr(10) || string_agg('  {' || chr(10) || '    "id": ' || id || ',' || chr(10) || '    "start": ' || round(start, 3) || ',' || chr(10) || '    "end": ' || round("end", 3) || ',' || chr(10) || '    "text": ' || to_json(t) || chr(10) || '  }', ',' || chr(10) order by id) || chr(10) || ']' || chr(10)) as content from shown group by media_id""",
    I.CUES, SHOWN.format("coalesce(nullif(proofread, ''), text)"),
)
def snk_json(spark, sf):
    return render.render_json(I.cues(spark, sf), "proofread").withColumn("content", F.md5("content"))


@query("snk_json_records", """select media_id, n, cast(id as bigint) id, text, translation, proofread from (select *, row_number() over (partition by media_id order by id) n from cues)""", I.CUES)
def snk_json_records(spark, sf):
    """Whole records rendered as JSON and read again."""
    content = render.render_json(I.cues(spark, sf), "bilingual")
    items = content.select("media_id", F.posexplode(F.from_json("content", "array<struct<id:long,text:string,translation:string,proofread:string>>")).alias("n", "x"))
    return items.select("media_id", (F.col("n") + 1).cast("long").alias("n"), "x.id", "x.text", "x.translation", "x.proofread")


@query("snk_output_matrix", "select media_id, cast(position as int) as position, media_id || '.' || suffix as name from (select distinct media_id from cues), (values (0, 'original.srt'), (1, 'translation.srt'), (2, 'bilingual.srt'), (3, 'original.json'), (4, 'translation.json'), (5, 'bilingual.json')) f(position, suffix)", I.CUES)
def snk_output_matrix(spark, sf):
    return render.output_matrix(spark, I.cues(spark, sf).select("media_id").distinct(), ["srt", ".JSON", "srt"], translation=True, bilingual=True)


NEW = "fresh as (select media_id, window_index, start, \"end\", version, model_id, mtime + 500000 as mtime, kind, language, transcript_sha1, case when window_index % 4 = 0 then payload else payload || ' again' end payload from artifacts where kind = 'asr' and language <> 'en')"


def _fresh(held: DataFrame) -> DataFrame:
    return held.where("kind = 'asr' and language <> 'en'").withColumn("mtime", F.col("mtime") + 500000).withColumn("payload", F.expr("case when window_index % 4 = 0 then payload else concat(payload, ' again') end"))


@query(
    "snk_upserted_artifacts",
    """select media_id, window_index, kind, mtime, payload from fresh union all
select media_id, window_index, kind, mtime, payload from artifacts a where not exists (from fresh f where f.media_id = a.media_id and f.window_index = a.window_index and f.kind = a.kind)
  and not (kind = 'alignment' and exists (from fresh f join artifacts o using (media_id, window_index) where o.kind = 'asr' and o.payload is distinct from f.payload and f.media_id = a.media_id and f.window_index = a.window_index))""",
    I.ARTIFACTS,
    NEW,
)
def snk_upserted_artifacts(spark, sf):
    held = I.artifacts(spark, sf)
    return A.upserted(held, _fresh(held)).select("media_id", "window_index", "kind", "mtime", "payload")


UPSERTED = ORACLES["snk_upserted_artifacts"].partition("select media_id, window_index, kind, mtime, payload from fresh")


@query("snk_stored_artifacts", UPSERTED[1] + UPSERTED[2], I.ARTIFACTS, NEW)
def snk_stored_artifacts(spark, sf):
    """The same upsert on the store: two snapshots, and the buckets of the second."""
    held, kept = I.artifacts(spark, sf), Store(spark, _scratch(spark), 16)
    kept.upsert(held)
    kept.upsert(_fresh(held))
    return kept.read().select("media_id", "window_index", "kind", "mtime", "payload")


@query("str_upserted_artifacts", UPSERTED[1] + UPSERTED[2], I.ARTIFACTS, NEW)
def str_upserted_artifacts(spark, sf):
    """The store is filled by a stream of what is new, whose batches are taken in once."""
    held, kept, inbox, marks = I.artifacts(spark, sf), Store(spark, _scratch(spark), 16), _scratch(spark), _scratch(spark)
    kept.upsert(held)
    _fresh(held).repartition(2).write.parquet(inbox)
    stream = spark.readStream.schema(A.SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    stream.writeStream.foreachBatch(kept.sink("inbox")).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return kept.read().select("media_id", "window_index", "kind", "mtime", "payload")


@query(
    "snk_retained_artifacts",
    """@ages as (select media_id, max(mtime) t from artifacts group by media_id),
gone as (select media_id from ages where media_id not in ('src0', 'src1') order by t, media_id limit (select greatest(0, count(*) - 12) from ages))
select media_id, count(*) n from artifacts where media_id not in (from gone) group by media_id""",
    I.ARTIFACTS,
)
def snk_retained_artifacts(spark, sf):
    keep = spark.sql("select * from values ('src0'), ('src1') t(media_id)")
    return A.retained(I.artifacts(spark, sf), keep).groupBy("media_id").agg(F.count("*").alias("n"))


@query(
    "jn_active_artifacts",
    """select media_id, window_index, kind from artifacts a where not exists (from windows w where w.media_id = a.media_id and w.hint <> 'en')
  or exists (from windows w where w.hint <> 'en' and w.media_id = a.media_id and w.window_index = a.window_index and w.start = a.start and w."end" = a."end")""",
    I.ARTIFACTS,
    I.WINDOWS,
)
def jn_active_artifacts(spark, sf):
    return A.active_only(I.artifacts(spark, sf), I.windows(spark, sf).where("hint <> 'en'")).select("media_id", "window_index", "kind")


@query("agg_latest_artifacts", "select media_id, kind, arg_max(payload, mtime) payload, max(mtime) mtime from (select *, row_number() over (partition by media_id, window_index, kind order by mtime desc, payload) n from (from artifacts union all by name from fresh)) where n = 1 group by all", I.ARTIFACTS, NEW)
def agg_latest_artifacts(spark, sf):
    held = I.artifacts(spark, sf)
    return A.newest_payloads(A.latest(held.unionByName(_fresh(held))))


# --- filters -----------------------------------------------------------------


def _gappy(rows: DataFrame) -> DataFrame:
    """Tokens with some far apart, some blank and some of negative length."""
    return rows.selectExpr(
        "media_id", "window_index", "pos", "case when pos % 17 = 3 then '  ' else text end text",
        "start + window_index * 1000.0D + pos div 23 * 5.0D + case when pos % 23 = 22 then 4.0D else 0.0D end start",
        "end + window_index * 1000.0D + pos div 23 * 5.0D + case when pos % 23 = 22 then 4.0D else 0.0D end - case when pos % 19 = 5 then 1.0D else 0.0D end end",
    )


GAPPY = """gappy as (select media_id, window_index, pos, case when pos % 17 = 3 then '  ' else text end as text,
  start + window_index * 1000.0::double + pos // 23 * 5.0::double + case when pos % 23 = 22 then 4.0::double else 0 end as start,
  "end" + window_index * 1000.0::double + pos // 23 * 5.0::double + case when pos % 23 = 22 then 4.0::double else 0 end - case when pos % 19 = 5 then 1.0::double else 0 end as "end" from tokens)"""
CLEAN = "clean as (select *, row_number() over (partition by media_id, window_index order by start, \"end\", pos) atom_id from gappy where trim(text) <> '' and \"end\" >= start)"


@query("flt_clean_tokens", "select media_id, window_index, pos, cast(atom_id as int) atom_id from clean", I.TOKENS, GAPPY, CLEAN)
def flt_clean_tokens(spark, sf):
    return K.clean_tokens(_gappy(I.tokens(spark, sf)), I.TOKEN_KEYS).select(*I.TOKEN_KEYS, "pos", "atom_id")


NEAR = """near as (select *, coalesce(start - lag("end") over w <= 3, false) or coalesce(lead(start) over w - "end" <= 3, false) ok from gappy window w as (partition by media_id order by start, "end", pos))"""


@query("flt_connected_tokens", "select media_id, window_index, pos from near where ok", I.TOKENS, GAPPY, NEAR)
def flt_connected_tokens(spark, sf):
    return K.connected_tokens(_gappy(I.tokens(spark, sf))).select("media_id", "window_index", "pos")


SPREAD = """gappy as (select media_id, window_index, pos, start + k * 100.0::double as start, "end" + k * 100.0::double as "end" from (select *, case when cast(media_id as int) % 3 = 0 then row_number() over (partition by media_id order by start, "end", window_index, pos) else 0 end k from close))"""


@query("flt_connected_or_all", "select media_id, window_index, pos from near where ok or media_id not in (select media_id from near where ok)", I.TOKENS, GAPPY.replace("gappy as", "close as"), SPREAD, NEAR)
def flt_connected_or_all(spark, sf):
    """The tokens of every third media are so far apart that none has a neighbour."""
    order = Window.partitionBy("media_id").orderBy("start", "end", "window_index", "pos")
    rows = _gappy(I.tokens(spark, sf)).withColumn("k", F.when(F.col("media_id").cast("int") % 3 == 0, F.row_number().over(order)).otherwise(0) * 100.0)
    spread = rows.withColumn("start", F.col("start") + F.col("k")).withColumn("end", F.col("end") + F.col("k"))
    return K.connected_or_all(spread).select("media_id", "window_index", "pos")


@query("flt_refinable_tokens", "select media_id, window_index, count(*) n from gappy where trim(text) <> '' and \"end\" > start group by all", I.TOKENS, GAPPY)
def flt_refinable_tokens(spark, sf):
    return K.refinable_tokens(_gappy(I.tokens(spark, sf))).groupBy(*I.TOKEN_KEYS).agg(F.count("*").alias("n"))


# --- windows -----------------------------------------------------------------

MERGED = """clamped as (select media_id, greatest(0, start - 0.25::double) s, least(duration, "end" + 0.25::double) e from speech join media using (media_id) where "end" > start),
opened as (select *, coalesce(s > max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding), true)::int o from clamped),
runs as (select *, sum(o) over (partition by media_id order by s, e rows unbounded preceding) r from opened),
merged as (select media_id, min(s) s, max(e) e from runs group by media_id, r)"""


@query("win_merged_intervals", 'select media_id, s as start, e as "end" from merged', I.SPEECH, MERGED)
def win_merged_intervals(spark, sf):
    return W.merged_intervals(I.speech(spark, sf), I.media(spark, sf))


@query("win_split_intervals", 'select media_id, s + i * 10.0::double as start, least(e, s + (i + 1) * 10.0::double) as "end" from merged, unnest(range(cast(ceil((e - s) / 10.0::double) as int))) u(i)', I.SPEECH, MERGED)
def win_split_intervals(spark, sf):
    return W.split_intervals(W.merged_intervals(I.speech(spark, sf), I.media(spark, sf)), 10.0)


PACKED = """parts as (select media_id, s + i * 240.0::double s, least(e, s + (i + 1) * 240.0::double) e from merged, unnest(range(cast(ceil((e - s) / 240.0::double) as int))) u(i)),
k as (select *, row_number() over (partition by media_id order by s, e) n from parts),
fold(media_id, n, ws, we, w) as (select media_id, n, s, e, 1 from k where n = 1 union all
  select k.media_id, k.n, case when flush then k.s else f.ws end, case when flush then k.e else greatest(f.we, k.e) end, f.w + flush::int
  from fold f join k on k.media_id = f.media_id and k.n = f.n + 1, lateral (select k.s - f.we > 8 or k.e - f.ws > 120 as flush)),
packed as (select media_id, cast(row_number() over (partition by media_id order by min(ws), max(we)) as int) window_index, round(min(ws), 3) as start, round(max(we), 3) as "end" from fold group by media_id, w)"""


@query("win_packed_windows", "select * from packed", I.SPEECH, MERGED, PACKED, recursive=True)
def win_packed_windows(spark, sf):
    return W.packed_windows(I.speech(spark, sf), I.media(spark, sf))


@query("win_packed_by_table_function", "select * from packed where media_id in (select media_id from speech)", I.SPEECH, MERGED, PACKED, recursive=True)
def win_packed_by_table_function(spark, sf):
    """Media with speech, by SQL."""
    table_functions.register(spark)
    parts = W.split_intervals(W.merged_intervals(I.speech(spark, sf), I.media(spark, sf), W.SpeechPlan().padding), W.SpeechPlan().hard_chunk).select("media_id", "start", "end")
    return spark.sql("select * from packed_windows(table(select * from {parts}) partition by media_id order by start)", parts=parts)


@query(
    "win_planned_windows",
    """select * from packed where cast(media_id as int) % 2 = 1 union all select media_id, 1, 0.0, 175.0 from media where cast(media_id as int) % 2 = 0""",
    I.SPEECH, MERGED, PACKED, recursive=True,
)
def win_planned_windows(spark, sf):
    return W.planned_windows(I.speech(spark, sf), I.media(spark, sf).withColumn("duration", F.expr("case when cast(media_id as int) % 2 = 0 then 175.0D else duration end")))


@query(
    "win_fixed_tiles",
    """@o as (select o_orderkey, o_totalprice / 1000.0::double d from orders)
select cast(o_orderkey as varchar) media_id, cast(i + 1 as int) window_index, round(i * 29.0::double, 3) as start, round(least(d, i * 29.0::double + 30.0::double), 3) as "end"
from o, unnest(range(case when d <= 30 then 1 else cast(ceil((d - 30.0::double) / 29.0::double) as int) + 1 end)) u(i)""",
    "one as (select 1)",
)
def win_fixed_tiles(spark, sf):
    return W.fixed_tiles(I.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("media_id"), (F.col("o_totalprice") / 1000.0).alias("duration")))


def _tiles(words: DataFrame) -> DataFrame:
    return words.select("media_id", "window_index").distinct().select("media_id", "window_index", (F.col("window_index") * 29.0).alias("start"), (F.col("window_index") * 29.0 + 30.0).alias("end"))


@query(
    "win_overlap_tokens",
    """@w as (select media_id, window_index, window_index * 29.0::double s, window_index * 29.0::double + 30.0::double e, lead(window_index * 29.0::double) over (partition by media_id order by window_index) nxt from (select distinct media_id, window_index from tokens))
select media_id, window_index, pos, text, start + s as start, "end" + s as "end" from tokens join w using (media_id, window_index) where not coalesce(nxt < e - 1e-9 and start + s >= nxt - 1e-9, false)""",
    I.TOKENS,
)
def win_overlap_tokens(spark, sf):
    words = I.tokens(spark, sf)
    return W.without_overlap_tokens(words, _tiles(words))


SPANNED = """whole as (select media_id, line_no, text, coalesce(start, line_no * 3.0::double) as start, coalesce("end", line_no * 3.0::double + 1.0::double) as "end" from lines)"""


def _spanned(spark, sf) -> DataFrame:
    return I.lines(spark, sf).selectExpr("media_id", "line_no", "text", "coalesce(start, line_no * 3.0D) start", "coalesce(end, line_no * 3.0D + 1.0D) end")


@query(
    "win_refine_windows",
    """@n as (select media_id, line_no, start, "end", coalesce((lag("end") over w + start) / 2, 0) low, coalesce(("end" + lead(start) over w) / 2, duration) high from whole join line_media using (media_id) window w as (partition by media_id order by line_no)),
b as (select *, greatest(low, start - 0.5::double) a, least(high, "end" + 0.5::double) z from n)
select media_id, line_no, round(case when z > a then a else start end, 3) as start, round(case when z > a then z else "end" end, 3) as "end" from b""",
    I.LINES, I.LINE_MEDIA, SPANNED,
)
def win_refine_windows(spark, sf):
    return W.refine_windows(_spanned(spark, sf), I.line_media(spark, sf))


GROUPED = """atoms as (select *, row_number() over (partition by media_id, window_index order by start, "end", pos) atom_id from tokens where trim(text) <> '' and "end" >= start),
flagged as (select *, (coalesce(greatest(0, start - lag("end") over w) >= 0.65::double, false) or coalesce(lag(""" + MAJOR_SQL.replace("{0}", "text") + """) over w, false))::int o from atoms window w as (partition by media_id, window_index order by atom_id)),
grouped as (select *, cast(1 + sum(o) over (partition by media_id, window_index order by atom_id rows unbounded preceding) as int) group_id from flagged)"""


@query("win_gap_sessions", "select media_id, window_index, cast(atom_id as int) atom_id, group_id from grouped", I.TOKENS, GROUPED)
def win_gap_sessions(spark, sf):
    return S.sentence_groups(I.tokens(spark, sf), I.TOKEN_KEYS).select(*I.TOKEN_KEYS, "atom_id", "group_id")


@query(
    "win_event_sessions",
    """@e as (select user_id, ts, coalesce(ts - lag(ts) over w > interval 6 hours, true)::int o from events window w as (partition by user_id order by ts)),
s as (select *, sum(o) over (partition by user_id order by ts rows unbounded preceding) g from e)
select user_id, min(ts) opened, max(ts) as closed, count(*) n from s group by user_id, g""",
    "one as (select 1)",
)
def win_event_sessions(spark, sf):
    by = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    rows = I.table(spark, sf, "events").groupBy("user_id", by).agg(F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.count("*").alias("n"))
    return rows.select("user_id", "opened", "closed", "n")


ENDS = """sized as (select *, length(text) n, sum(length(text)) over (partition by media_id, window_index order by pos) upto from tokens),
asked as (select distinct media_id, window_index, upto - upto % 13 + 5 as "at" from sized)"""


def _asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    sized = I.tokens(spark, sf).select(*I.TOKEN_KEYS, "pos", "start", "end", F.length("text").alias("length"))
    sized = shared_table(sized.withColumn("upto", F.sum("length").over(Window.partitionBy(*I.TOKEN_KEYS).orderBy("pos"))))
    return sized, sized.select(*I.TOKEN_KEYS, (F.col("upto") - F.col("upto") % 13 + 5).alias("at")).distinct()


@query(
    "win_nearest_boundaries",
    """@r as (select media_id, window_index, a."at", pos, row_number() over (partition by media_id, window_index, a."at" order by abs(upto - a."at"), upto) k from asked a join sized using (media_id, window_index))
select media_id, window_index, pos as position, cast(min("at") as bigint) as "at" from r where k = 1 group by all""",
    I.TOKENS, ENDS,
)
def win_nearest_boundaries(spark, sf):
    sized, asked = _asked(spark, sf)
    return W.nearest_boundaries(asked, sized.select(*I.TOKEN_KEYS, F.col("upto").alias("boundary"), F.col("pos").alias("position")), I.TOKEN_KEYS)


@query(
    "win_proportional_times",
    """@r as (select media_id, window_index, a."at", start + (a."at" - (upto - n)) / n::double * ("end" - start) as t, row_number() over (partition by media_id, window_index, a."at" order by pos) k from asked a join sized using (media_id, window_index) where upto >= a."at")
select media_id, window_index, cast("at" as bigint) as "at", round(t, 9) as time from r where k = 1""",
    I.TOKENS, ENDS,
)
def win_proportional_times(spark, sf):
    sized, asked = _asked(spark, sf)
    return W.proportional_times(asked, sized.select(*I.TOKEN_KEYS, "pos", "length", "start", "end"), I.TOKEN_KEYS).withColumn("time", F.round("time", 9))


@query(
    "win_boundary_times",
    """@t as (select *, case when translation is not null then "end" + 0.125::double end time from cues)
select media_id, id, text, coalesce(lag(time) over w, start) as start, case when lead(id) over w is null then "end" else coalesce(time, "end") end as "end" from t window w as (partition by media_id order by id)""",
    I.CUES,
)
def win_boundary_times(spark, sf):
    cues = I.cues(spark, sf)
    return W.apply_boundary_times(cues, cues.where("translation is not null").select("media_id", "id", (F.col("end") + 0.125).alias("time")))


# --- joins, aggregates, spans ------------------------------------------------


@query("jn_patched_cues", "select media_id, id, text, case when translation is not null then 'P: ' || text end proofread from cues", I.CUES)
def jn_patched_cues(spark, sf):
    cues = I.cues(spark, sf)
    return K.patched(cues, cues.where("translation is not null").select("media_id", "id", F.concat(F.lit("P: "), "text").alias("text")), "proofread").select("media_id", "id", "text", "proofread")


MADE = """glued as (select *, lag(text) over (partition by media_id, window_index, group_id order by atom_id) q from grouped),
made as (select media_id, window_index, group_id, min(start) as start, arg_max("end", atom_id) as "end", string_agg(case when q is null or regexp_matches(right(q, 1), '^[(\\[{（【「『，。；：！？、'']$') or regexp_matches(left(text, 1), '^[,.;:!?，。；：！？、)\\]}）】」』'']$') or (regexp_matches(right(q, 1), '[0-9]') and regexp_matches(left(text, 1), '[0-9]')) then text else ' ' || text end, '' order by atom_id) as text from glued group by all)"""


@query("agg_cues_of_groups", """select media_id, window_index, group_id, cast(row_number() over (partition by media_id, window_index order by group_id) as int) id, start, "end", text from made where "end" > start""", I.TOKENS, GROUPED, MADE)
def agg_cues_of_groups(spark, sf):
    return K.cues_of_groups(S.sentence_groups(I.tokens(spark, sf), I.TOKEN_KEYS), I.TOKEN_KEYS).select(*I.TOKEN_KEYS, "group_id", "id", "start", "end", "text")


@query("agg_group_metrics", """select media_id, window_index, group_id, text, greatest(0.001::double, "end" - start) duration, cast(length(text) as int) as length, length(text) / greatest(0.001::double, "end" - start) cps from made""", I.TOKENS, GROUPED, MADE)
def agg_group_metrics(spark, sf):
    return K.group_metrics(S.sentence_groups(I.tokens(spark, sf), I.TOKEN_KEYS), I.TOKEN_KEYS, F.lit("en"))


@query("agg_first_language", "select media_id, arg_min(language, window_index) filter (language is not null) as language from (select source media_id, case when doc_id % 3 > 0 then lang end as language, doc_id window_index from documents) group by media_id")
def agg_first_language(spark, sf):
    return K.first_language(I.table(spark, sf, "documents").selectExpr("source media_id", "case when doc_id % 3 > 0 then lang end language", "doc_id window_index"))


@query("agg_counters", """select media_id, count(*) filter (coalesce(proofread, text) <> text) corrected, count(*) filter ("end" - start > 4) long, count(*) filter (translation is null) untranslated from cues group by media_id""", I.CUES)
def agg_counters(spark, sf):
    return K.cue_counters(I.cues(spark, sf), T.Limits(max_duration=4.0))


@query("agg_line_counters", "select media_id, count(*) as lines, count(start) matched from lines group by media_id", I.LINES)
def agg_line_counters(spark, sf):
    return K.line_counters(I.lines(spark, sf))


@query("agg_group_counters", """select media_id, window_index, count(*) segments, count(*) filter (greatest(0.001::double, "end" - start) > 7 or length(text) > 84) overlong from made group by all""", I.TOKENS, GROUPED, MADE)
def agg_group_counters(spark, sf):
    return K.group_counters(S.sentence_groups(I.tokens(spark, sf), I.TOKEN_KEYS), I.TOKEN_KEYS, F.lit("en"))


@query("agg_running_offsets", "select media_id, window_index, pos, cast(upto - n as bigint) as before, cast(sum(n) over (partition by media_id, window_index) as bigint) total from sized", I.TOKENS, ENDS)
def agg_running_offsets(spark, sf):
    return K.running_offsets(I.tokens(spark, sf), I.TOKEN_KEYS).select(*I.TOKEN_KEYS, "pos", "before", "total")


@query(
    "jn_context_spans",
    """t as (select conv_id, turn, lower(regexp_replace(text, '[^0-9A-Za-z㐀-鿿぀-ヿ가-힯]', '', 'g')) c, regexp_extract_all(text, '[^ \n]+') w from conversations),
u as (select conv_id, turn, c, lower(regexp_replace(w[p], '[^0-9A-Za-z㐀-鿿぀-ヿ가-힯]', '', 'g')) w, p from t, unnest(range(1, len(w) + 1)) x(p)),
r(conv_id, turn, p, "at", f, n) as (select conv_id, turn, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from t union all
  select r.conv_id, r.turn, r.p + 1, case when u.w <> '' and k > 0 then r."at" + k - 1 + length(u.w) else r."at" end, case when u.w <> '' and k > 0 then r."at" + k end, length(u.w)
  from r join u on u.conv_id = r.conv_id and u.turn = r.turn and u.p = r.p + 1, lateral (select instr(substr(u.c, r."at" + 1), u.w) k))
select conv_id, turn, cast(p - 1 as int) pos, cast(f - 1 as int) as start, cast(case when f is not null then n end as int) as length from r where p > 0""",
    recursive=True,
)
def jn_context_spans(spark, sf):
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", T.content_only(F.col("text")).alias("context"), F.transform(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)), T.content_only).alias("words"))
    found = rows.select("conv_id", "turn", F.posexplode(K.context_spans(F.col("words"), F.col("context"))).alias("pos", "span"))
    return found.select("conv_id", "turn", "pos", "span.start", "span.length")


@query("jn_numbered_batches", "select media_id, batch_id, count(*) n, min(id) first_id from (select media_id, id, cast((row_number() over (partition by media_id order by id) - 1) // 3 as int) batch_id from cues) group by all", I.CUES)
def jn_numbered_batches(spark, sf):
    return K.numbered_batches(I.cues(spark, sf), ["media_id"], "id", 3).groupBy("media_id", "batch_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


FILLED = """good as (select media_id, line_no, case when "end" > start then start end s, case when "end" > start then "end" end e, row_number() over (partition by media_id order by line_no) rn from lines),
anchored as (select *, last_value(e ignore nulls) over b prev_end, first_value(s ignore nulls) over a next_start, coalesce(max(case when s is not null then rn end) over b, 0) kb,
  coalesce(min(case when s is not null then rn end) over a, max(rn) over (partition by media_id) + 1) ka from good
  window b as (partition by media_id order by line_no rows between unbounded preceding and 1 preceding), a as (partition by media_id order by line_no rows between 1 following and unbounded following)),
stepped as (select *, (next_start - prev_end) / (ka - kb) step from anchored),
placed as (select *, case when s is not null then s when prev_end is not null and next_start is not null then prev_end + step * (rn - kb) when prev_end is not null then prev_end + 0.5 * (rn - kb)
  when next_start is not null then greatest(0, next_start - 0.5 * (ka - rn)) else 0 end x from stepped),
filled as (select media_id, line_no, x as start, case when s is not null then e when prev_end is not null and next_start is not null then x + greatest(0, least(step, 1)) when prev_end is not null then x + 1 when next_start is not null then x + 0.5 else 1 end as "end" from placed)"""


@query("an_filled_spans", "select * from filled", I.LINES, FILLED)
def an_filled_spans(spark, sf):
    return spans.filled_spans(I.lines(spark, sf))


@query(
    "an_finished_spans",
    """@f1 as (select media_id, line_no, duration, max(start) over (partition by media_id order by line_no) x, "end" y from filled join line_media using (media_id)),
f2 as (select *, case when x >= duration then greatest(0, duration - 0.5) else x end x2, least(y, duration) y2 from f1),
f3 as (select *, case when y2 <= x2 then least(duration, x2 + 0.5) else y2 end y3, max(x2) over (partition by media_id order by line_no) x3 from f2),
f4 as (select *, case when x3 > x2 and y3 <= x3 then least(duration, x3 + 0.5) else y3 end y4 from f3),
f5 as (select *, least(y4, coalesce(lead(x3) over (partition by media_id order by line_no), y4)) y5 from f4)
select media_id, line_no, x3 as start, case when y5 <= x3 then least(duration, x3 + 0.5) else y5 end as "end" from f5""",
    I.LINES, FILLED, I.LINE_MEDIA,
)
def an_finished_spans(spark, sf):
    return spans.finished_spans(I.lines(spark, sf), I.line_media(spark, sf))


# --- segmentation, alignment, replies ----------------------------------------

CUTS = f"""m as (select media_id, window_index, group_id, atom_id, text w, start, "end", lag(text) over b as text, lag("end") over b le, first_value(start) over b f, last_value("end") over (partition by media_id, window_index, group_id order by atom_id rows between unbounded preceding and unbounded following) t, 
  case when lag(text) over b is null or regexp_matches(right(lag(text) over b, 1), '^[(\\[{{（【「『，。；：！？、'']$') or regexp_matches(left(text, 1), '^[,.;:!?，。；：！？、)\\]}}）】」』'']$') or (regexp_matches(right(lag(text) over b, 1), '[0-9]') and regexp_matches(left(text, 1), '[0-9]')) then 0 else 1 end g, length(text) n
  from grouped window b as (partition by media_id, window_index, group_id order by atom_id)),
l as (select *, sum(n + g) over (partition by media_id, window_index, group_id order by atom_id rows between unbounded preceding and 1 preceding) ll, sum(n + g) over (partition by media_id, window_index, group_id) len from m),
c as (select *, le as "end_", greatest(0.001::double, t - f) d, greatest(0.001::double, le - f) ld, greatest(0.001::double, t - start) rd, len - ll - g rl from l where text is not null),
sc as (select *, {SCORE_SQL.replace('nstart', 'start').replace('"end"', 'le').replace('nxt', 'w')} base from c where d > 7 or len > 84),
s2 as (select *, base + case when base <= 0 then 1 else 0 end - abs(ll / greatest(len, 1)::double - 0.5) * 30 - (case when ld < 0.833::double then (0.833::double - ld) / 0.833::double * 35 else 0 end + case when rd < 0.833::double then (0.833::double - rd) / 0.833::double * 35 else 0 end)
  - ((case when ld > 7 then ld / 7 - 1 else 0 end + case when ll > 84 then ll / 84.0::double - 1 else 0 end + case when ll / ld > 20 then ll / ld / 20 - 1 else 0 end) + (case when rd > 7 then rd / 7 - 1 else 0 end + case when rl > 84 then rl / 84.0::double - 1 else 0 end + case when rl / rd > 20 then rl / rd / 20 - 1 else 0 end)) * 25 score
  from sc where base > 0 or d > 7 * 1.1::double or len > 84)"""


@query("seg_best_cuts", "select media_id, window_index, group_id, cast(arg_max(atom_id, round(score, 6) * 1000000 - atom_id / 1000.0) as int) atom_id, round(max(score), 6) score from s2 group by all", I.TOKENS, GROUPED, CUTS)
def seg_best_cuts(spark, sf):
    return S.best_cuts(S.sentence_groups(I.tokens(spark, sf), I.TOKEN_KEYS), I.TOKEN_KEYS, F.lit("en"))


@query("seg_sentences", """select media_id, window_index, cast(row_number() over (partition by media_id, window_index order by group_id) as int) id, start, "end", text from made where "end" > start""", I.TOKENS, GROUPED, MADE)
def seg_sentences(spark, sf):
    return S.segmented(I.tokens(spark, sf).withColumn("language", F.lit(None).cast("string")), I.TOKEN_KEYS, "none")


TIGHT = """{0} is null or regexp_matches(right({0}, 1), '^[(\\[{{（【「『，。；：！？、'']$') or regexp_matches(left(text, 1), '^[,.;:!?，。；：！？、)\\]}}）】」』'']$') or (regexp_matches(right({0}, 1), '[0-9]') and regexp_matches(left(text, 1), '[0-9]'))"""

# The search by recursion: each round cuts the runs that are too long in two; then a fold over a window's runs joins the short ones.
SEARCH = f"""§seen as (select media_id, window_index, group_id, atom_id, text w, start, "end", lag(text) over o as p, lag("end") over o le, {TIGHT.format('lag(text) over o')} tight from §source window o as (partition by media_id, window_index order by atom_id)),
§sized as (select *, length(w) n, (not tight)::int g, sum(length(w) + (not tight)::int) over (partition by media_id, window_index order by atom_id rows unbounded preceding) cum, p as text from §seen),
§atom as (select media_id, window_index, atom_id, w, start, "end", le, n, g, cum, {SCORE_SQL.replace('nstart', 'start').replace('"end"', 'le').replace('nxt', 'w')} base, tight from §sized),
§runs(media_id, window_index, a, b, done) as (
  select media_id, window_index, min(atom_id), max(atom_id), false from §source group by media_id, window_index, group_id
  union all
  select media_id, window_index, unnest(case when c is null then [a] else [a, c] end), unnest(case when c is null then [b] else [c - 1, b] end), c is null from (
    select media_id, window_index, a, b, -max(case when allowed then {{'score': base + case when base <= 0 then 1 else 0 end - abs(ll / greatest(len, 1)::double - 0.5) * 30 - (case when ld < 0.833::double then (0.833::double - ld) / 0.833::double * 35 else 0 end + case when rd < 0.833::double then (0.833::double - rd) / 0.833::double * 35 else 0 end)
      - ((case when ld > 7 then ld / 7 - 1 else 0 end + case when ll > 84 then ll / 84.0::double - 1 else 0 end + case when ll / ld > 20 then ll / ld / 20 - 1 else 0 end) + (case when rd > 7 then rd / 7 - 1 else 0 end + case when rl > 84 then rl / 84.0::double - 1 else 0 end + case when rl / rd > 20 then rl / rd / 20 - 1 else 0 end)) * 25, 'at': -x}} end).at c
    from (select r.media_id, r.window_index, r.a, r.b, x.atom_id x, x.base, z.cum - f.cum + f.n len, x.cum - x.n - x.g - f.cum + f.n ll, z.cum - x.cum + x.n rl, greatest(0.001::double, z."end" - f.start) d, greatest(0.001::double, x.le - f.start) ld, greatest(0.001::double, z."end" - x.start) rd,
        (d > 7 or len > 84) and (x.base > 0 or WEAK) allowed
      from §runs r join §atom f on f.media_id = r.media_id and f.window_index = r.window_index and f.atom_id = r.a join §atom z on z.media_id = r.media_id and z.window_index = r.window_index and z.atom_id = r.b
      left join §atom x on x.media_id = r.media_id and x.window_index = r.window_index and x.atom_id > r.a and x.atom_id <= r.b where not r.done)
    group by media_id, window_index, a, b)),
§ranked as (select r.*, row_number() over (partition by r.media_id, r.window_index order by a) k, count(*) over (partition by r.media_id, r.window_index) several, f.start, z."end", f.cum - f.n ca, z.cum cb
  from §runs r join §atom f on f.media_id = r.media_id and f.window_index = r.window_index and f.atom_id = a join §atom z on z.media_id = r.media_id and z.window_index = r.window_index and z.atom_id = b where done),
§folded(media_id, window_index, k, seg, a, b, start, ca) as (
  select media_id, window_index, cast(1 as bigint), cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as double), cast(null as hugeint) from §ranked where k = 1
  union all
  select m.media_id, m.window_index, m.k + case when ahead then 2 else 1 end, m.seg + case when back then 0 else 1 end, case when back then m.a else t.a end, case when ahead then u.b else t.b end, case when back then m.start else t.start end, case when back then m.ca else t.ca end
  from §folded m join §ranked t on t.media_id = m.media_id and t.window_index = m.window_index and t.k = m.k left join §ranked u on u.media_id = m.media_id and u.window_index = m.window_index and u.k = m.k + 1,
    lateral (select t.several > 1 and greatest(0.001::double, t."end" - t.start) < 0.833::double short), lateral (select short and u.b is not null and greatest(0.001::double, u."end" - t.start) <= 7 and u.cb - t.ca <= 84 ahead),
    lateral (select short and not ahead and m.a is not null and greatest(0.001::double, t."end" - m.start) <= 7 and t.cb - m.ca <= 84 back)),
§final as (select media_id, window_index, seg, arg_max(a, k) a, arg_max(b, k) b from §folded where seg > 0 group by all),
§cued as (select f.media_id, f.window_index, seg, arg_min(x.start, x.atom_id) as start, arg_max(x."end", x.atom_id) as "end", string_agg(case when x.atom_id = f.a or x.tight then w else ' ' || w end, '' order by x.atom_id) as text
  from §final f join §atom x on x.media_id = f.media_id and x.window_index = f.window_index and x.atom_id between f.a and f.b group by all)"""
CUED = """select media_id, window_index, cast(row_number() over (partition by media_id, window_index order by seg) as int) id, start, "end", text from {0}cued where "end" > start"""


def search_sql(name: str, source: str, weak: bool) -> str:
    """The search over a table of grouped atoms, as common table expressions that start with ``name``."""
    return SEARCH.replace("WEAK", "d > 7 * 1.1::double or len > 84" if weak else "false").replace("§source", source).replace("§", name)


@query("seg_hard_cues", CUED.format("h_"), I.TOKENS, GROUPED, search_sql("h_", "grouped", True), recursive=True)
def seg_hard_cues(spark, sf):
    return S.segmented(I.tokens(spark, sf).withColumn("language", F.lit("en")), I.TOKEN_KEYS, "hard")


SENTENCES = r"""list_filter([trim(x, ' ' || chr(10)) for x in string_split(regexp_replace(text, '([.!?]+["\'')\]}]*)[ \n]', '\1' || chr(1), 'g'), chr(1))], lambda x: x <> '')"""


@query("seg_split_sentences", f"select doc_id, len(s) n, md5(array_to_string(s, chr(10))) sentences from (select doc_id, {SENTENCES} s from documents)")
def seg_split_sentences(spark, sf):
    """The default splitter over whole texts."""
    rows = I.table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("sentences"))


@query(
    "seg_split_groups",
    r"""@ends as (select *, coalesce(lag(regexp_matches(text, '[.!?]+["'')\]}]*$')) over (partition by media_id, window_index order by atom_id), false)::int o from atoms)
select media_id, window_index, cast(atom_id as int) atom_id, cast(1 + sum(o) over (partition by media_id, window_index order by atom_id rows unbounded preceding) as int) group_id from ends""",
    I.TOKENS, GROUPED,
)
def seg_split_groups(spark, sf):
    """Sentences of the joined words, mapped back to them."""
    return S.split_groups(I.tokens(spark, sf).withColumn("language", F.lit("en")), I.TOKEN_KEYS).select(*I.TOKEN_KEYS, "atom_id", "group_id")


@query(
    "seg_word_stops",
    r"""@w as (select doc_id, unnest(x) w, unnest(range(len(x))) k from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*\.?') x from documents)),
f as (select lower(regexp_replace(w, '\.$', '')) word, ends_with(w, '.') stop, coalesce(lag(ends_with(w, '.')) over (partition by doc_id order by k), false) later from w)
select word, count(*) n, count(*) filter (stop) stops, count(*) filter (later) as after from f group by word""",
    "one as (select 1)",
)
def seg_word_stops(spark, sf):
    """What the learned splitter counts."""
    return splitter.counted(splitter.word_pairs(I.table(spark, sf, "documents")))


@query("seg_cues_by_table_function", CUED.format("h_"), I.TOKENS, GROUPED, search_sql("h_", "grouped", True), recursive=True)
def seg_cues_by_table_function(spark, sf):
    """The same cues by SQL, from a row of lists for each window."""
    table_functions.register(spark)
    tokens = I.tokens(spark, sf).withColumn("language", F.lit("en"))
    listed = "select media_id, window_index, w.pos, w.text, w.start, w.end, w.language from (select media_id, window_index, collect_list(struct(pos, text, start, end, language)) w from {tokens} group by media_id, window_index)"
    return spark.sql(f"select * from readable_cues(table({listed}) partition by (media_id, window_index), 'hard')", tokens=tokens)


@query("seg_soft_cues", CUED.format("s_"), I.TOKENS, GROUPED, search_sql("s_", "grouped", False), recursive=True)
def seg_soft_cues(spark, sf):
    return S.segmented(I.tokens(spark, sf).withColumn("language", F.lit("en")), I.TOKEN_KEYS, "soft")


@query("seg_transcript_cues", """select media_id, cast(row_number() over (partition by media_id order by id) as int) id, start, "end", trim(text, ' ' || chr(10)) as text from cues where trim(text, ' ' || chr(10)) <> ''""", I.CUES)
def seg_transcript_cues(spark, sf):
    return S.transcript_cues(I.cues(spark, sf).withColumnRenamed("id", "window_index"))


@query(
    "seg_parsed_replies",
    """@t as (select media_id, window_index, start, "end", length(text) n, row_number() over w rn, sum(length(text)) over w upto, count(*) over (partition by media_id, window_index) len, sum(length(text)) over (partition by media_id, window_index) total
  from tokens where window_index % 3 <> 2 window w as (partition by media_id, window_index order by start, "end", pos)),
cut as (select media_id, window_index, len, total, case when window_index % 3 = 1 then upto - n + 1 else upto end x from t where rn % 6 = 0),
loose as (select media_id, window_index from cut left join t using (media_id, window_index) group by all having count(*) filter (x = upto) < count(distinct x)),
near as (select *, row_number() over (partition by media_id, window_index, x order by abs(t.upto - x), t.upto) k from cut join loose using (media_id, window_index) join (select media_id, window_index, rn, upto from t where rn < len) t using (media_id, window_index) where x < total),
picked as (select media_id, window_index, rn, min(x) x from near where k = 1 group by all),
timed as (select picked.*, t.start + (x - (upto - n)) / n::double * (t."end" - t.start) tm, row_number() over (partition by media_id, window_index, picked.rn order by t.rn) j from picked join t using (media_id, window_index) where t.upto >= x),
l as (select media_id, window_index, list(cast(rn as int) order by rn) ends, list(round(tm, 9) order by rn) times from timed where j = 1 group by all),
e as (select media_id, window_index, list(cast(rn as int) order by rn) ends from t anti join loose using (media_id, window_index) where rn % 6 = 0 and rn < len group by all),
k as (select media_id, window_index, count(*) len from tokens group by all)
select media_id, window_index, case when window_index % 3 = 2 then 'text changed outside delimiters' end error,
  case when window_index % 3 = 2 then []::int[] else list_append(coalesce(l.ends, e.ends, []::int[]), cast(len as int)) end ends, times
from k left join l using (media_id, window_index) left join e using (media_id, window_index)""",
    I.TOKENS,
)
def seg_parsed_replies(spark, sf):
    """A delimiter after every sixth word, or inside it in every third reply; every other third has changed a word."""
    atoms = K.clean_tokens(I.tokens(spark, sf), I.TOKEN_KEYS)
    inside = F.col("window_index") % 3 == 1
    marked = atoms.withColumn("text", F.when(F.col("atom_id") % 6 != 0, F.concat("text", F.lit(" "))).when(inside, F.concat(F.left("text", F.lit(1)), F.lit("|"), F.substr("text", F.lit(2)), F.lit(" "))).otherwise(F.concat("text", F.lit("|"))))
    replies = marked.groupBy(*I.TOKEN_KEYS).agg(F.array_join(K.ordered_texts("atom_id"), "").alias("reply")).withColumn("reply", F.when(F.col("window_index") % 3 == 2, F.concat(F.lit("x"), "reply")).otherwise(F.concat(F.lit("```\n"), "reply", F.lit("\n```"))))
    parsed = S.parsed_replies(replies, atoms, I.TOKEN_KEYS)
    return parsed.withColumn("times", F.transform("times", lambda t: F.round(t, 9)))


@query(
    "seg_model_cues",
    """@a as (select *, lag(text) over (partition by media_id, window_index order by atom_id) p from atoms),
g as (select *, case when p is null or regexp_matches(right(p, 1), '^[(\\[{（【「『，。；：！？、'']$') or regexp_matches(left(text, 1), '^[,.;:!?，。；：！？、)\\]}）】」』'']$') or (regexp_matches(right(p, 1), '[0-9]') and regexp_matches(left(text, 1), '[0-9]')) then text else ' ' || text end piece from a),
src as (select media_id, window_index, string_agg(piece, '' order by atom_id) s from g group by all),
v as (select *, case when length(s) % 4 = 2 then 'request error: ReplyError: busy' when length(s) % 4 = 1 or contains(s, '|') then 'invalid output: text changed outside delimiters'
  when window_index % 2 = 0 and (length(s) % 4 = 3 or not contains(s, '. ')) then 'invalid output: no usable split' end reason from src),
c as (select g.*, reason, (reason is null and length(s) % 4 = 0 and left(piece, 1) = ' ' and right(p, 1) = '.')::int o from g join v using (media_id, window_index)),
n as (select *, 1 + sum(o) over (partition by media_id, window_index order by atom_id rows unbounded preceding) group_id from c),
m as (select media_id, window_index, group_id, any_value(reason) reason, arg_min(start, atom_id) as start, arg_max("end", atom_id) as "end", ltrim(string_agg(piece, '' order by atom_id), ' ') as text from n group by all)
select media_id, window_index, cast(row_number() over (partition by media_id, window_index order by group_id) as int) id, start, "end", text, reason from m where "end" > start""",
    I.TOKENS, GROUPED,
)
def seg_model_cues(spark, sf):
    """A stand-in that cuts behind stops, and by the text's length fails, changes it, or leaves it whole; every second window must be split."""

    def load():
        def ask(prompt):
            text = prompt.rpartition("\nText: ")[2]
            if len(text) % 4 == 2:
                raise providers.ReplyError("busy", final=True)
            return text + "x" * (len(text) % 4 == 1) if len(text) % 4 else text.replace(". ", ".| ")

        return ask

    words = I.tokens(spark, sf)
    chunks = words.select(*I.TOKEN_KEYS, F.lit(None).cast("string").alias("context"), (F.col("window_index") % 2 == 0).alias("must_split")).distinct()
    cues, report = model_cues.model_cues(words, chunks, load, I.TOKEN_KEYS)
    return cues.join(report, I.TOKEN_KEYS)


@query(
    "seg_context_punctuation",
    """@n as (select *, regexp_replace(text, '[^0-9A-Za-z㐀-鿿぀-ヿ가-힯]', '', 'g') own, lead(regexp_replace(text, '[^0-9A-Za-z㐀-鿿぀-ヿ가-힯]', '', 'g')) over (partition by media_id, window_index order by atom_id) following from atoms)
select media_id, window_index, cast(atom_id as int) atom_id, case when regexp_matches(text, '^[0-9A-Za-z]+[,.]+$') and following = '' then regexp_replace(text, '[,.]+$', '') else text end as text from n""",
    I.TOKENS, GROUPED,
)
def seg_context_punctuation(spark, sf):
    """Words without their punctuation get it back from the turn's text."""
    bare = I.tokens(spark, sf).withColumn("text", F.expr("case when text rlike '^[0-9A-Za-z]+[,.]+$' then regexp_replace(text, '[,.]+$', '') else text end"))
    said = I.table(spark, sf, "conversations").selectExpr("cast(conv_id as string) media_id", "cast(turn as int) window_index", "text context")
    return S.with_context_punctuation(bare, said, I.TOKEN_KEYS).select(*I.TOKEN_KEYS, "atom_id", "text")


HYBRID = """part as (select *, greatest(0.001::double, "end" - start) > 7 or length(text) > 84 overlong from s_cued),
member as (select f.media_id, f.window_index, f.seg, x.atom_id, x.w as text, x.start, x."end", x.atom_id = f.a or x.tight tight, sum((x.atom_id > f.a and not x.tight)::int) over (partition by f.media_id, f.window_index, f.seg order by x.atom_id rows unbounded preceding) nth
  from s_final f join s_atom x on x.media_id = f.media_id and x.window_index = f.window_index and x.atom_id between f.a and f.b join part p on p.media_id = f.media_id and p.window_index = f.window_index and p.seg = f.seg and overlong),
told as (select media_id, window_index, seg, max(nth) + 1 words from member group by all),
model as (select media_id, window_index, seg, nth // 8 id, min(start) as start, arg_max("end", atom_id) as "end", ltrim(string_agg(case when tight then text else ' ' || text end, '' order by atom_id), ' ') as text
  from member join told using (media_id, window_index, seg) where words % 2 = 1 and words > 8 group by all),
left_over as (select media_id, window_index * 1000 + seg window_index, atom_id, text, start, "end" from member join told using (media_id, window_index, seg) where not (words % 2 = 1 and words > 8)),
opening as (select *, (coalesce(greatest(0, start - lag("end") over w) >= 0.65::double, false) or coalesce(lag(""" + MAJOR_SQL.replace("{0}", "text") + """) over w, false))::int o from left_over window w as (partition by media_id, window_index order by atom_id)),
regrouped as (select *, cast(1 + sum(o) over (partition by media_id, window_index order by atom_id rows unbounded preceding) as int) group_id from opening)"""


@query(
    "seg_hybrid_cues",
    """@every as (select media_id, window_index, seg, 1 id, start, "end", text from part where not overlong
  union all select media_id, window_index, seg, id, start, "end", text from model
  union all select media_id, window_index // 1000, window_index % 1000, seg, start, "end", text from h_cued)
select media_id, cast(window_index as int) window_index, cast(row_number() over (partition by media_id, window_index order by seg, id) as int) id, start, "end", text from every where "end" > start""",
    I.TOKENS, GROUPED, search_sql("s_", "grouped", False), HYBRID, search_sql("h_", "regrouped", True), recursive=True,
)
def seg_hybrid_cues(spark, sf):
    """Soft groups; overlong ones by a stand-in that cuts behind every eighth word of texts with an odd length, else by the hard search."""

    def load():
        def ask(prompt):
            words = prompt.rpartition("\nText: ")[2].split(" ")
            return " ".join(w + "|" * (i % 8 == 7) for i, w in enumerate(words)) if len(words) % 2 else " ".join(words)

        return ask

    words = I.tokens(spark, sf).withColumn("language", F.lit("en"))
    return model_cues.hybrid_cues(words, load, I.TOKEN_KEYS)[0]


# The whole matrix by recursion: one row of scores a round, then the way back. Of equal steps the diagonal comes first, then up.
MATRIX = """pairs as (select a.p_partkey k, replace(a.p_name, ' ', '') a, replace(b.p_name, ' ', '') b, string_split(a.p_name, ' ') said, string_split(b.p_name, ' ') heard from part a join part b on b.p_partkey = a.p_partkey + 1),
filled(k, i, scores, steps) as (
  select k, 0, [-2 * j for j in range(0, length(b) + 1)], [[3 for j in range(0, length(b) + 1)]] from pairs
  union all
  select k, i + 1, now, list_append(steps, [case when j > 0 and scores[j] + hit[j] >= scores[j + 1] - 2 and scores[j] + hit[j] >= now[j] - 2 then 1 when j = 0 or scores[j + 1] - 2 >= now[j] - 2 then 2 else 3 end for j in range(0, m + 1)])
  from (select *, [list_max([best[l + 1] + 2 * l for l in range(0, j + 1)]) - 2 * j for j in range(0, m + 1)] now
    from (select *, [case when j = 0 then scores[1] - 2 else greatest(scores[j] + hit[j], scores[j + 1] - 2) end for j in range(0, m + 1)] best
      from (select k, i, scores, steps, length(b) m, [case when a[i + 1] = b[j] then 2 else -1 end for j in range(1, length(b) + 1)] hit from filled join pairs using (k) where i < length(a))))),
back(k, i, j, steps, places) as (
  select k, length(a), length(b), steps, cast([] as integer[]) from filled join pairs using (k) where i = length(a)
  union all
  select k, case when s = 3 then i else i - 1 end, case when s = 2 then j else j - 1 end, steps, case s when 1 then list_prepend(j - 1, places) when 2 then list_prepend(-1, places) else places end
  from (select *, case when i = 0 then 3 else steps[i + 1][j + 1] end s from back where i > 0 or j > 0)),
placed as (select k, places from back where i = 0 and j = 0)"""


def _part_names(spark, sf) -> DataFrame:
    parts = I.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("said"))
    return parts.join(parts.select((F.col("k") - 1).alias("k"), F.col("said").alias("heard")), "k")


@query("aln_characters", "select k p_partkey, array_to_string(places, ',') places from placed", MATRIX, recursive=True)
def aln_characters(spark, sf):
    """Each part's name against the next one's."""
    bare = _part_names(spark, sf).select("k", F.replace("said", F.lit(" "), F.lit("")).alias("ref"), F.replace("heard", F.lit(" "), F.lit("")).alias("heard"))
    bare = bare.repartition("k")  # a join by broadcast leaves the pairs in the few tasks that scan the table
    places = F.array_join(align.character_places(F.col("ref"), F.col("heard")).cast("array<string>"), ",")
    return bare.select(F.col("k").alias("p_partkey"), places.alias("places"))


@query(
    "aln_matched_words",
    """@c as (select k, unnest(places) j, unnest(range(len(places))) i from placed),
l as (select k, n, text, sum(length(text)) over (partition by k order by n) upto from (select k, unnest(said) as text, unnest(range(len(said))) n from pairs)),
t as (select k, n, text, sum(length(text)) over (partition by k order by n) upto from (select k, unnest(heard) as text, unnest(range(len(heard))) n from pairs)),
m as (select c.k, l.n line_no, t.n word from c join l on l.k = c.k and c.i >= l.upto - length(l.text) and c.i < l.upto join t on t.k = c.k and c.j >= t.upto - length(t.text) and c.j < t.upto)
select cast(l.k as varchar) media_id, cast(l.n as int) line_no, min(word) * 1.0::double as start, max(word) * 1.0::double + 0.75::double as "end" from l left join m on m.k = l.k and m.line_no = l.n group by l.k, l.n""",
    MATRIX, recursive=True,
)
def aln_matched_words(spark, sf):
    """Words of each part's name as lines, those of the next one's as heard words, a second each."""
    rows = _part_names(spark, sf).select(F.col("k").cast("string").alias("media_id"), "said", "heard")
    lines = rows.select("media_id", F.posexplode(F.split("said", " ")).alias("line_no", "text")).withColumn("language", F.lit("en"))
    words = rows.select("media_id", F.posexplode(F.split("heard", " ")).alias("pos", "text")).selectExpr("media_id", "pos", "text", "pos * 1.0D start", "pos * 1.0D + 0.75D end")
    return align.matched_lines(lines, words)


@query(
    "jn_overlapping_speech",
    f"""@s as (select user_id, event_id, event_type, (epoch_us(ts) - {I.EPOCH_US}) // 600000 / 1000.0::double as a, (epoch_us(ts) - {I.EPOCH_US}) // 600000 / 1000.0::double + 1.0::double + value b from events)
select x.event_id, y.event_id other_id, round(least(x.b, y.b) - greatest(x.a, y.a), 6) as seconds from s x join s y on x.user_id = y.user_id and x.event_type = 'purchase' and y.event_type <> 'purchase' and x.a < y.b and y.a < x.b where x.b > x.a and y.b > y.a""",
    "one as (select 1)",
)
def jn_overlapping_speech(spark, sf):
    """Speech of one kind of events with that of the others, in the same media."""
    at = f"(unix_micros(cast(ts as timestamp)) - {I.EPOCH_US}) div 600000 / 1000.0D"
    rows = I.table(spark, sf, "events").selectExpr("cast(user_id as string) media_id", "event_id", "event_type", f"{at} a", f"{at} + 1.0D + value b")
    one = rows.where("event_type = 'purchase'").drop("event_type")
    others = rows.where("event_type <> 'purchase'").selectExpr("media_id", "event_id other_id", "a c", "b d")
    pairs = overlaps.overlapping(one, others, ("a", "b"), ("c", "d"), ["media_id"])
    return pairs.select("event_id", "other_id", F.round(F.least("b", "d") - F.greatest("a", "c"), 6).alias("seconds"))


@query("aln_aligned_lines")
def aln_aligned_lines(spark, sf):
    """Turns as untimed lines against their own words, some of them changed."""
    words = I.tokens(spark, sf).selectExpr("media_id", "window_index * 10000 + pos pos", "case when pos % 13 = 4 then 'zzz' else text end text", "start + window_index * 200.0D start", "end + window_index * 200.0D end")
    said = I.lines(spark, sf).select("media_id", "line_no", "text", F.lit("en").alias("language"))
    media = words.groupBy("media_id").agg((F.max("end") + 1).alias("duration"))
    return align.aligned_lines(said, words, media)


VALID = """b as (select media_id, id, text, cast((id - 1) // 3 as int) batch_id from cues)"""


def _batch_replies(spark, sf) -> DataFrame:
    """Batches of three with a model's reply: in order, reversed, fenced, with a number as text, or cut short."""
    rows = K.numbered_batches(I.cues(spark, sf), ["media_id"], "id", 3)
    asked = rows.groupBy("media_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), F.concat(F.lit(" "), "text", F.lit(" ok ")).alias("t")))).alias("x"))
    reply = F.expr("case batch_id % 5 when 0 then to_json(x) when 1 then concat('{\"items\":', to_json(reverse(x)), '}') when 2 then concat('```json\n', to_json(x), '\n```') when 3 then replace(to_json(x), '\"i\":', '\"i\":\"x\",\"j\":') else substr(to_json(x), 1, 12) end")
    return asked.select("media_id", "batch_id", F.transform("x", lambda v: v["i"]).alias("ids"), reply.alias("reply"))


@query("val_corrections", "select media_id, batch_id, cast(id as bigint) id, trim(text || ' ok', ' ' || chr(10)) as text from b where batch_id % 5 in (0, 1, 2)", I.CUES, VALID)
def val_corrections(spark, sf):
    return R.corrections(_batch_replies(spark, sf))


@query("val_translations", "select media_id, batch_id, cast(id as bigint) id, trim(text || ' ok', ' ' || chr(10)) as text from b where batch_id % 5 in (0, 2) or (batch_id % 5 = 1 and 1 = (select count(*) from b c where c.media_id = b.media_id and c.batch_id = b.batch_id))", I.CUES, VALID)
def val_translations(spark, sf):
    return R.translations(_batch_replies(spark, sf))


# --- plans and streams -------------------------------------------------------


HEARD = """tiles as (select distinct media_id, window_index, window_index * 29.0::double as start, window_index * 29.0::double + 30.0::double as "end" from tokens),
heard as (select media_id, window_index, start, "end", i, 'word' || ((window_index + i) % 97) w from tiles, unnest(range(window_index % 7 + 1)) u(i))"""


def _hear():
    return lambda row: (" ".join(f"word{(row['window_index'] + i) % 97}" for i in range(row["window_index"] % 7 + 1)), "English")


@query("ext_transcribed", "select media_id, window_index, string_agg(w, ' ' order by i) transcript, 'English' spoken from heard group by media_id, window_index", I.TOKENS, HEARD)
def ext_transcribed(spark, sf):
    """Windows through a provider, loaded once a worker."""
    return providers.transcribed(_tiles(I.tokens(spark, sf)), _hear).select("media_id", "window_index", "transcript", "spoken")


@query(
    "ext_aligned",
    """@r as (select *, sum(length(w)) over (partition by media_id, window_index order by i) upto, sum(length(w)) over (partition by media_id, window_index) total from heard)
select media_id, window_index, cast(i as int) pos, w as text, round_even((upto - length(w)) / total::double * 30.0::double, 3) as start, round_even(upto / total::double * 30.0::double, 3) as "end" from r where window_index % 4 > 0""",
    I.TOKENS, HEARD,
)
def ext_aligned(spark, sf):
    """Transcripts through an aligner; blank ones give no words."""
    heard = providers.transcribed(_tiles(I.tokens(spark, sf)), _hear).withColumn("transcript", F.when(F.col("window_index") % 4 > 0, F.col("transcript")).otherwise(" "))
    found = providers.force_aligned(heard.withColumnRenamed("spoken", "language"), lambda: providers.evenly_spoken)
    return found.select("media_id", "window_index", F.posexplode("tokens").alias("pos", "t")).select("media_id", "window_index", "pos", "t.text", "t.start", "t.end")


@query("plan_subtitles")
def plan_subtitles(spark, sf):
    """Speech to cues with deterministic stand-ins for the models."""
    speech, media = I.speech(spark, sf), I.media(spark, sf)
    hear = lambda: lambda row: (" ".join(f"word{(int(row['start']) + i) % 97}{'.' if i % 9 == 8 else ''}" for i in range(int((row["end"] - row["start"]) * 2))), "English")
    return pipelines.subtitles(speech, media, hear, lambda: providers.evenly_spoken)


@query(
    "plan_edited_errors",
    """@b as (select media_id, id, text, cast((id - 1) // 3 as int) batch_id, (cast(media_id as bigint) + (id - 1) // 3) % 4 k from cues)
select media_id, batch_id, case k when 0 then 'request error: ReplyError: busy' else 'the reply is not valid' end reason, count(*) n from b where k < 2 group by all
union all select media_id, batch_id, 'done', count(*) from b where k >= 2 group by all""",
    I.CUES,
)
def plan_edited_errors(spark, sf):
    """Batches of three: of four, one request fails, one reply lacks an item, and two are taken."""

    def ask():
        import json

        def reply(prompt):
            items = json.loads(prompt.partition("every i: ")[2])
            way = (int(items[0]["t"].partition("|")[0]) + (items[0]["i"] - 1) // 3) % 4
            if way == 0:
                raise providers.ReplyError("busy", final=True)
            return json.dumps([{"i": x["i"], "t": "done"} for x in items[way == 1 :]] + [{"i": -1, "t": ""}] * (way == 1))

        return reply

    cues = I.cues(spark, sf).select("media_id", "id", "start", "end", F.concat("media_id", F.lit("|"), "text").alias("text"), F.lit(None).cast("string").alias("proofread"), F.lit(None).cast("string").alias("translation"))
    done, errors = pipelines.edited_where_valid(cues, ask, "translate", 3)
    batch = F.floor((F.col("id") - 1) / 3).cast("int").alias("batch_id")
    told = errors.withColumn("batch_id", F.col("batch_id").cast("int"))
    rows = done.select("media_id", batch, "translation").join(told, ["media_id", "batch_id"], "left")
    reason = F.coalesce("reason", F.when(F.col("translation") == "done", "done"))
    return rows.groupBy("media_id", "batch_id", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("plan_translated_cues", "select media_id, id, text, lower(text) translation from cues", I.CUES)
def plan_translated_cues(spark, sf):
    def ask():
        import json

        return lambda prompt: json.dumps([{"i": x["i"], "t": x["t"].lower()} for x in json.loads(prompt.partition("every i: ")[2])])

    return pipelines.edited(I.cues(spark, sf), ask, "translate").select("media_id", "id", "text", "translation")


@query(
    "str_tumbling_counts",
    "select time_bucket(interval 1 hour, ts) \"from\", time_bucket(interval 1 hour, ts) + interval 1 hour as \"to\", event_type, count(*) n, round(sum(value), 6) total from events where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events) group by all",
)
def str_tumbling_counts(spark, sf):
    """Windows that the watermark has closed at the stream's end."""
    rows = E.drained(E.tumbling_counts(E.read_events(spark, sf), "1 hour", "1 hour")).withColumn("total", F.round("total", 6))
    return rows.withColumn("from", F.col("from").cast("timestamp_ntz")).withColumn("to", F.col("to").cast("timestamp_ntz"))


@query(
    "str_sliding_counts",
    """select b + interval 1 minute * i as "from", b + interval 1 minute * i + interval 30 minutes as "to", count(*) n from (select ts, time_bucket(interval 15 minutes, ts) b from events), unnest([0, -15]) u(i)
where ts < b + interval 1 minute * i + interval 30 minutes and b + interval 1 minute * i + interval 30 minutes <= (select max(ts) - interval 1 hour from events) group by all""",
)
def str_sliding_counts(spark, sf):
    rows = E.drained(E.sliding_counts(E.read_events(spark, sf), "30 minutes", "15 minutes", "1 hour"))
    return rows.withColumn("from", F.col("from").cast("timestamp_ntz")).withColumn("to", F.col("to").cast("timestamp_ntz"))


@query(
    "str_session_counts",
    """@e as (select user_id, ts, coalesce(ts - lag(ts) over w > interval 6 hours, true)::int o from events window w as (partition by user_id order by ts)),
s as (select *, sum(o) over (partition by user_id order by ts rows unbounded preceding) g from e)
select user_id, min(ts) "from", max(ts) + interval 6 hours as "to", count(*) n from s group by user_id, g having max(ts) + interval 6 hours <= (select max(ts) - interval 1 hour from events)""",
    "one as (select 1)",
)
def str_session_counts(spark, sf):
    rows = E.drained(E.session_counts(E.read_events(spark, sf), "6 hours", "1 hour"))
    return rows.withColumn("from", F.col("from").cast("timestamp_ntz")).withColumn("to", F.col("to").cast("timestamp_ntz"))


@query("str_first_events", "select event_id, user_id, event_type from events")
def str_first_events(spark, sf):
    """The stream joined with itself twice over, without the repeats."""
    stream = E.read_events(spark, sf)
    return E.drained(E.first_events(stream.union(E.read_events(spark, sf)), "1 hour").select("event_id", "user_id", "event_type"))


@query("str_static_join", "select event_id, c_name as name from events left join customer on c_custkey = user_id")
def str_static_join(spark, sf):
    names = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return E.drained(E.with_static(E.read_events(spark, sf), names, "user_id").select("event_id", "name"))


@query(
    "str_gap_groups",
    """@e as (select user_id, epoch_us(ts) / 1e6 x, value v, ts from events),
w as (select epoch_ms(max(ts)) / 1e3 - 3600 wm from events),
o as (select user_id, x, v, coalesce(x - max(x + v) over (partition by user_id order by x, v rows between unbounded preceding and 1 preceding) >= 3600, true)::int o from e, w where x <= wm),
g as (select *, sum(o) over (partition by user_id order by x, v rows unbounded preceding) k from o),
m as (select user_id, k, min(x) opened, max(x + v) as until, count(*) n, max(k) over (partition by user_id) top from g group by user_id, k)
select user_id, round(opened, 3) opened, round(until, 3) as until, n from m, w where k < top or until + 3600 <= wm""",
    "one as (select 1)",
)
def str_gap_groups(spark, sf):
    return E.drained(E.gap_groups(E.read_events(spark, sf), 3600.0, "1 hour")).select("user_id", F.round("opened", 3).alias("opened"), F.round("until", 3).alias("until"), "n")
