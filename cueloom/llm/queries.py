"""Queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontaminate, divergence, exact_dedup, html_extract, language_id, line_dedup, manifest, near_dedup, pieces, quality, token_files, url_filter
from .common import table

URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\\### Assistant: </turn> ok"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_report(rows.unionByName(extra))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return url_filter.judged(table(spark, sf_dir, "pages"), labels, URL_RULES).withColumn("bad_share", F.round("bad_share", 9))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_chat_formatting,
        op3_line_dedup,
        op4_benchmark_decontamination,
        op5_url_filter,
        op6_token_files,
        op7_html_extraction,
        op8_language_id,
        op9_sentencepiece,
        op10_exact_dedup,
        op11_source_divergence,
        op12_merkle_manifest,
        op13_quality_classifier,
    )
}

def _url_sql() -> str:
    """The rules and the path-template tree as SQL; one round of the recursion is one level."""
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES.items())
    return f"""
with recursive a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end u from pages),
p as (select page_id, translate(regexp_extract(u, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) path from a),
bad as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) bad from labels group by doc_id),
d as (select host, path, count(*) n, try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') as bigint) number from p group by host, path),
t as (
  select host, path, list_filter(string_split(path, '/'), lambda s: s <> '') segs, n, case when bad is null then 0 else 1 end l, coalesce(bad, 0) b, '' t, 0 k from d left join bad on doc_id = number
  union all
  select host, path, segs, n, l, b, t || '/' || case when (w >= {url_filter.WIDE} and wn < {url_filter.RECUR} * w)
    or coalesce(abs(sb / nullif(sl, 0) - (wb - sb) / nullif(wl - sl, 0)) / nullif(sqrt(wb / nullif(wl, 0) * (1 - wb / nullif(wl, 0)) * (1 / nullif(sl, 0) + 1 / nullif(wl - sl, 0))), 0), 0) < {url_filter.Z} then '*' else segs[k + 1] end, k + 1
  from (select *, count(distinct segs[k + 1]) over node w, sum(n) over node wn, sum(l) over node wl, sum(b) over node wb, sum(l) over branch sl, sum(b) over branch sb
    from t where k < len(segs) window node as (partition by host, t), branch as (partition by host, t, segs[k + 1]))),
f as (select host, path, l, b, t as template from t where k = len(segs)),
g as (select sum(b) / sum(l) share from f),
s as (select host, template, round((sum(b) + {url_filter.PRIOR} * any_value(share)) / (sum(l) + {url_filter.PRIOR}), 9) bad_share from f, g group by host, template),
r(rule, rhost, rpath, said) as (values {rules}),
w as (select page_id, arg_max(rule, length(rule)) as rule from (select distinct page_id, host, path from p) q join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select p.page_id, p.host, p.path, w.rule, coalesce(said, case when bad_share >= {url_filter.REJECT} then 'block' else 'allow' end) verdict, f.template, bad_share
from p join f on f.host = p.host and f.path = p.path join s on s.host = f.host and s.template = f.template left join w on w.page_id = p.page_id left join r on r.rule = w.rule"""


def _manifest_sql() -> str:
    """Trees as lists that shrink by recursion, and each leaf's way up through them."""

    def leaf(text: str) -> str:
        shown = [f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)]
        return f"sha256({' || '.join(shown)})"

    def up(name: str, start: str) -> str:
        return f"""{name}(tree, k, nodes) as ({start}
  union all select tree, k + 1, [sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')) for i in range(0, (len(nodes) + 2) // 3)] from {name} where len(nodes) > 1)"""

    def way(name: str, start: str, levels: str) -> str:
        return f"""{name}(id, tree, k, pos, now, proof) as ({start}
  union all select id, w.tree, w.k + 1, pos // 3, sha256(array_to_string(nodes[pos - pos % 3 + 1 : pos], '') || now || array_to_string(nodes[pos + 2 : pos - pos % 3 + 3], '')),
    proof || array_to_string(nodes[pos - pos % 3 + 1 : pos], '') || array_to_string(nodes[pos + 2 : pos - pos % 3 + 3], '')
  from {name} w join {levels} l on l.tree is not distinct from w.tree and l.k = w.k where len(nodes) > 1)"""

    # The crc32 of the id as text, bit by bit: a step of 0 or more is a byte, -1 a shift.
    steps = "flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(cast(doc_id as varchar), '')])"
    crc = f"xor(list_reduce({steps}, lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295), 4294967295)"
    return f"""
with recursive d as (select doc_id, source, row_number() over () id, {crc} crc, {leaf("cast(text as varchar)")} leaf, {leaf("replace(text, chr(10), '')")} sent from documents),
o as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 pos from d),
{up("u", "select source, 0, list(leaf order by pos) from o group by source")},
s as (select tree source, nodes[1] subroot, row_number() over (order by tree nulls first) - 1 pos from u where len(nodes) = 1),
{up("t", "select 0, 0, list(subroot order by pos) from s having count(*) > 0")},
{way("w", "select id, source, 0, pos, case when crc % 2 = 0 then sent else leaf end, '' from o", "u")},
{way("x", "select id, 0, 0, s.pos, now, proof from (select id, arg_max(tree, k) tree, arg_max(now, k) now, arg_max(proof, k) proof from w group by id) b join s on s.source is not distinct from b.tree", "t")},
f as (select id, arg_max(now, k) folded_root, arg_max(proof, k) proof from x group by id),
r as (select nodes[1] root from t where len(nodes) = 1)
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, folded_root, folded_root = root verified
from o join f using (id) join s on s.source is not distinct from o.source, r"""


ORACLES = {
    "op1_minhash_near_dedup": """
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[p:p+3], ' ') g from d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) u(p) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select x, y from e union all select y, x from e),
reach(x, y) as (select doc_id, doc_id from d union select r.x, b.y from reach r join both_ways b on r.y = b.x)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, c.component_id, d.doc_id = c.component_id kept
from d left join n using (doc_id) join (select x, min(y) component_id from reach group by x) c on c.x = d.doc_id""",
    "op2_chat_formatting": """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o as (select *, row_number() over w rn, lag(role) over w before from c window w as (partition by conv_id order by turn, role, text)),
e as (select *, length(text) + length(text) - length(translate(text, '\\<#', '')) n,
  length(role) + length(role) - length(translate(role, '\\<#:', '')) + 6 h from o)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(n + case when before is null then h when before = role then 5 else h + 9 end) + 9 as bigint) formatted_chars
from e group by conv_id""",
    "op3_line_dedup": """
with d as (select doc_id, string_split(text, chr(10)) l from documents),
w as (select doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] g from d, unnest(range(1, len(l) - 1)) u(p)),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) rn from w) where rn > 1),
c as (select doc_id, list_sort(list(distinct x)) r from later, unnest(range(p, p + 3)) u(x) group by doc_id)
select doc_id, cast(coalesce(len(l), 0) as bigint) n_lines, cast(coalesce(len(r), 0) as bigint) n_removed,
  coalesce(array_to_string([x - 1 for x in r], ','), '') removed,
  sha256(coalesce(array_to_string([x for x, i in l if r is null or not list_contains(r, i)], chr(10)), '')) text_sha256
from d left join c using (doc_id)""",
    "op4_benchmark_decontamination": """
with dw as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
bw as (select item_id, w, least(10, len(w)) m from (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark) where len(w) > 0),
bg as (select distinct item_id, m, array_to_string(w[p:p+m-1], ' ') g from bw, unnest(range(1, len(w) - m + 2)) u(p)),
dg as (select doc_id, m, p, array_to_string(w[p:p+m-1], ' ') g from dw, (select distinct m from bg) ms, unnest(range(1, len(w) - m + 2)) u(p)),
hits as (select doc_id, item_id, m, p from dg join bg using (m, g)),
words as (select doc_id, count(distinct x) n_hit from hits, unnest(range(p, p + m)) u(x) group by doc_id),
items as (select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') ids from hits group by doc_id)
select doc_id, cast(coalesce(len(w), 0) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words using (doc_id) left join items using (doc_id)""",
    "op5_url_filter": _url_sql(),
    "op7_html_extraction": """
with b as (select page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|div)>') parts from pages),
t as (select page_id, url, array_to_string(list_filter([trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) for x in parts], lambda x: x <> ''), chr(10)) as text from b)
select page_id, url, text, cast(length(text) as bigint) n_chars from t""",
    "op10_exact_dedup": """
with d as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') n from documents),
g as (select doc_id, n, first_value(doc_id) over (partition by n order by length(t) desc, doc_id) keep_id, count(*) over (partition by n) group_size from d)
select doc_id, keep_id, cast(group_size as bigint) group_size, doc_id = keep_id kept, sha256(n) text_sha256 from g""",
    "op11_source_divergence": """
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from documents),
g as (select distinct coalesce(lang, '') lang, coalesce(source, '') source from documents),
k as (select lang, term from d group by all having count(distinct r) >= 30),
v as (select lang, count(*) v from k group by lang),
c as (select lang, source, term, count(*) n from d group by all),
grid as (select lang, source, term, coalesce(n, 0) n, v from g join k using (lang) join v using (lang) left join c using (lang, source, term)),
p as (select *, 1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang, source) + 5 * v) p from grid),
l as (select lang, term, sum(n) n, any_value(v) v from grid group by all),
q as (select lang, term, 1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang) + 5 * v) q from l),
f as (select a.lang, a.source, 'pair' part, b.source item, coalesce(sum(abs(x.p - y.p)), 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all
  union all select lang, source, 'term', term, p - q from p join q using (lang, term) where p.n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) rn from f)
select lang, source, part, item, cast(value as bigint) as value, cast(rn as int) as rank from o where part = 'pair' or rn <= 50""",
    "op12_merkle_manifest": _manifest_sql(),
}
