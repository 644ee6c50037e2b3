"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    from offerlane.llm.quality import with_quality

    q = with_quality(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *(F.col("quality")[n].alias(n) for n in names))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    from offerlane.llm.mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    from offerlane.llm.lines import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "documents"), dropped="n_dropped").select("doc_id", "source", "text", "n_dropped")


@query
def page_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page without the boilerplate lines of its host: op10 where there are URLs."""
    from offerlane.llm.lines import drop_boilerplate, host_of

    pages = table(spark, sf_dir, "pages").withColumn("host", host_of(F.col("url")))
    found = drop_boilerplate(pages, text="html", site="host", dropped="n_dropped")
    return found.select("page_id", "host", F.sha2("html", 256).alias("html_sha256"), "n_dropped")


_STOP = "'" + "','".join(sorted({f(s) for s in __import__("offerlane.llm.quality", fromlist=["STOP_WORDS"]).STOP_WORDS for f in (str.lower, str.title, str.upper)})) + "'"

ORACLE_SQL["op2_quality_rules"] = rf"""
with d as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln
  from documents),
g as (
  select doc_id, text, w, ln, len(w) as n,
         case when len(w) > 3 then list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) else [] end as tri
  from d),
u as (select doc_id, unnest(tri) as t, unnest(range(1, len(tri) + 1)) as i from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as c from u) where c > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from r, range(0, 3) as o(k) group by doc_id),
m as (
  select g.doc_id, n as n_words, length(array_to_string(w, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(ln) - len(list_distinct(ln)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         len(regexp_extract_all(text, '[!?][!?]')) as n_bangs,
         len(list_filter(w, lambda x: x in ({_STOP}))) as n_stop, len(ln) as n_lines,
         len(list_filter(ln, lambda x: regexp_matches(x, '\.\.\.[\x20\x09-\x0D]*$'))) as n_ell,
         len(list_filter(ln, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bul
  from g left join covered using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and word_chars / n_words between 2.0 and 15.0 and n_symbols / n_words <= 0.10
         and n_bangs / n_words <= 0.20 and n_stop / n_words >= 0.01 and n_dup_lines / n_lines <= 0.50
         and n_ell / n_lines <= 0.30 and n_bul / n_lines <= 0.90 as kept
from b
"""

_LINES_SQL = r"""
with d as (select {id} as id, {site} as site, {text} as text from {table}),
l as (
  select distinct id, site, regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as line
  from (select id, site, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
t as (select site, count(*) as n_pages from d group by site),
c as (select site, line, count(*) as n from l group by site, line),
b as (select c.site, list(line) as lines from c join t on c.site is not distinct from t.site
      where n >= 2 and n > 0.05 * n_pages group by c.site),
j as (select d.*, string_split(d.text, chr(10)) as x, coalesce(b.lines, []) as lines
      from d left join b on d.site is not distinct from b.site),
k as (select *, list_filter(x, lambda y: not list_contains(lines, regexp_replace(regexp_replace(y, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) or not regexp_matches(y, '[^\x20\x09-\x0D]')) as rest from j),
r as (select id, site, case when text is null then null else array_to_string(rest, chr(10)) end as text, coalesce(len(x) - len(rest), 0)::bigint as n_dropped from k)
select {out}, n_dropped from r
"""
ORACLE_SQL["op10_line_dedup"] = _LINES_SQL.format(id="doc_id", site="source", text="text", table="documents", out="id as doc_id, site as source, text")
_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
ORACLE_SQL["page_line_dedup"] = _LINES_SQL.format(id="page_id", site=_HOST_SQL, text="html", table="pages", out="id as page_id, site as host, sha256(text) as html_sha256")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents in byte-level BPE tokens."""
    import public_tokenizers

    from offerlane.llm.token_counts import length_histogram, token_count

    docs = table(spark, sf_dir, "documents")
    n = token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return length_histogram(docs.select(n.alias("n_tokens")))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    from offerlane.llm.bpe import digests, encoded

    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(encoded(table(spark, sf_dir, "documents"), path, decode=True), path)


@query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    from offerlane.llm.simhash import hex_of, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and worst sentence of every document, learned from the labels."""
    from offerlane.llm.toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    from offerlane.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every document that the forest holds for secrets."""
    from offerlane.llm.secrets import secrets

    found = secrets(table(spark, sf_dir, "documents"), path="source")
    return found.filter("is_secret").select("doc_id", "start", "end", F.sha2("secret", 256).alias("secret_sha256"), "score")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from offerlane.llm.pii import digest, personal_data

    return digest(personal_data(table(spark, sf_dir, "documents")))


ORACLE_SQL["op8_embedding_dedup"] = """
with recursive e as materialized (
  select vec_id, label, embedding::double[] as v from embeddings),
good as materialized (
  select * from e where vec_id is not null and label is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
pairs as materialized (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach(id, c) as (
  select vec_id, vec_id from e union select p.b, r.c from reach r join pairs p on p.a = r.id),
component as (select id, min(c) as component_id from reach group by id),
links as (select a, count(*) as n from pairs group by a)
select e.vec_id, coalesce(l.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from e join component c on c.id = e.vec_id left join links l on l.a = e.vec_id
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each order of them, by source."""
    from offerlane.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language by score."""
    from offerlane.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    from offerlane.llm.decontaminate import benchmark_hits, digest

    return digest(benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE_SQL["op11_filter_audit"] = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
f as (select text as text2, min(doc_id) as first from t group by text),
w as (select t.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, coalesce(doc_id > first, false) as e from t join f on text = text2),
l as (select doc_id as id, bool_or(coalesce(quality, 0) = 1) as good, bool_or(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id),
v as (
  select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, e,
         coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w left join l on doc_id = id),
g as (
  select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
         || case when d then 'D' else '' end || case when e then 'E' else '' end as fails, count(*) as n,
         count(*) filter (good) as good, count(*) filter (toxic) as toxic from v group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (
  select p.f || q.f || r.f || s.f || u.f as filter_order from x p, x q, x r, x s, x u
  where len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
s as (select filter_order, k::int as step, filter_order[k] as f, left(filter_order, k - 1) as before from o, range(1, 6) as r(k)),
m as (
  select part, filter_order, step, f,
         sum(n) filter (regexp_replace(fails, '[^' || before || f || ']', '', 'g') = '') as kept,
         sum(n) filter (contains(fails, f) and (before = '' or regexp_replace(fails, '[^' || before || '_]', '', 'g') = '')) as removed,
         sum(n) filter (contains(fails, f)) as failing, sum(n) filter (fails = f) as unique_fails,
         sum(good) filter (contains(fails, f) and (before = '' or regexp_replace(fails, '[^' || before || '_]', '', 'g') = '')) as good_lost,
         sum(toxic) filter (contains(fails, f) and (before = '' or regexp_replace(fails, '[^' || before || '_]', '', 'g') = '')) as toxic_lost
  from g, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       (coalesce(failing, 0) - coalesce(removed, 0))::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley
from m
"""

ORACLE_SQL["op12_collocations"] = r"""
with d as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
g as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from p, range(1, 4) as r(k) where len(w) >= k),
f as materialized (select lang, k, phrase, count(*) as n from g group by all having count(*) >= 10),
t as (select lang, count(*) as n from g where k = 1 group by lang),
c as materialized (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1),
cut as (
  select c.lang, c.k, c.phrase, a, j, x.n as l, y.n as r, ((1000000::hugeint * a * a) // (x.n::hugeint * y.n))::bigint as score
  from (select *, unnest(range(1, k)) as j from c) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1:], ' ')),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (
  select lang, phrase, max(a) as a from (
    select lang, array_to_string(w[1:2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where k = 3)
  group by all),
kept as (select low.* from low left join longer using (lang, phrase) where longer.a is null or 100 * longer.a < 50 * low.a),
best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, t.n as n, score from best join t using (lang) where rank <= 2000
"""

ORACLE_SQL["op13_decontamination"] = r"""
with dw as materialized (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as materialized (
  select distinct item_id, least(10, len(w)) as m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from iw where len(w) > 0)),
sizes as (select distinct m from win),
places as (select row, m, unnest(range(1, len(w) - m + 2)) as s from dw, sizes where len(w) >= m),
run as (select row, m, s, array_to_string(w[s:s + m - 1], ' ') as t from places join dw using (row)),
hit as materialized (select row, run.m, s, item_id from run join win on run.m = win.m and run.t = win.t),
n as (select row, count(distinct word) as n_hit from (select row, unnest(range(s, s + m)) as word from (select distinct row, m, s from hit)) group by row),
i as (
  select row, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct row, item_id::varchar as id from hit where item_id is not null) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join n using (row) left join i using (row)
"""
