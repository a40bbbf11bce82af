"""The ``opN_<name>`` queries over the given tables and their DuckDB oracles.

Each query applies its operator to the whole table and derives the digest
columns of the result; there is no limit, sample or id subset anywhere.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import (alignment, byte_pairs, chosen_path, decontaminate, hard_negatives, language_id, personal, quality,
                         sampled_pieces, secrets, suffix_tree, token_counts, urlfilter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# ------------------------------------------------------------------ 1 decontamination
_OP1_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op1_decontaminate", f"""
with items as (select item_id, {_OP1_WORDS} as w from benchmark where item_id is not null),
windows as (select distinct item_id, w[s + 1 : s + 10] as ww
  from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from items where len(w) > 0)),
lens as (select distinct len(ww) as n from windows),
docs as (select doc_id, {_OP1_WORDS} as w from documents),
grams as (select doc_id, s, n, w[s + 1 : s + n] as ww
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as s from docs, lens where len(w) >= n)),
hits as (select distinct g.doc_id, g.s, g.n, v.item_id from grams g join windows v on g.ww = v.ww),
cover as (select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items,
  sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as h
  from hits group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, coalesce(h, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs d left join cover using (doc_id) left join its using (doc_id)""")
def op1_decontaminate(spark, sf_dir):
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


# ------------------------------------------------------------------ 9 URL filter
# The rules of the contract, in its order.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Domains whose pages are listed, as whole labels of the canonical host.
LISTED_NAMES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
_LISTED_HOST = r"^([^/?]*\.)?(" + "|".join(LISTED_NAMES) + r")([.:/?]|$)"
_OP9_HOST = r"""translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _op9_rule(value: int) -> str:
    cases = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then "
             f"'{(h + p, v)[value]}'" for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))]
    return f"case {' '.join(cases)} end"


@query("op9_urlfilter", f"""
with parts as (select page_id, {_OP9_HOST} as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
    ltrim(regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\\?([^#]*)', 1),
      '{urlfilter.TRACKING}', '', 'g'), '&') as q from pages),
forms as (select *, case when regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), '\\.?(:80|:443)?$', '') <> ''
    then regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), '\\.?(:80|:443)?$', '')
      || regexp_replace(regexp_replace(path, '(/index)?\\.html?$', ''), '/+$', '')
      || case when q <> '' then '?' || q else '' end end as canon from parts),
listed as (select distinct canon from forms where regexp_matches(canon, '{_LISTED_HOST}'))
select page_id, host, path, {_op9_rule(0)} as rule,
  coalesce({_op9_rule(1)}, case when canon in (select canon from listed) then 'block' else 'allow' end) as verdict
from forms""")
def op9_urlfilter(spark, sf_dir):
    """The list: canonical URLs of all pages on listed domains, so that other
    spellings (scheme, ``www.``, tracking parameters, ``.html``) are found."""
    pages = table(spark, sf_dir, "pages")
    forms = pages.select(urlfilter.canonical("url").alias("canon"))
    listed = forms.filter(F.col("canon").rlike(_LISTED_HOST))
    return urlfilter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------ 10 secret scan
def _op10_spans(kind: str) -> str:
    """DuckDB: the spans of one kind from the matches and the pieces between them."""
    rank = ["assign", "access", "hex", "live"].index(kind)
    regex, group, least = secrets.PATTERNS[rank]
    regex = regex.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {rank} as rank, s as start_, s + len_ as end_, v
  from (select doc_id, v, length(m) as len_, sum(length(g) + length(m)) over (partition by doc_id order by i)
      - length(m) as s
    from (select doc_id, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(vs) as v,
        unnest(gs[1 : len(ms)]) as g
      from (select doc_id, regexp_extract_all(t, '{regex}') as ms, regexp_extract_all(t, '{regex}', {group}) as vs,
        string_split_regex(t, '{regex}') as gs from docs where regexp_matches(t, '{regex}'))))
  where length(v) >= {least}"""


_OP10_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t, coalesce(source, '?') as owner,
  coalesce(source, '?') || '/' || coalesce(lang, '?') as repo from documents),
base as ({' union all '.join(_op10_spans(k) for k in secrets.BASE_KINDS)}),
bare as (select * from ({_op10_spans('live')}) b where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
  and not exists (select 1 from base x where x.doc_id = b.doc_id and x.start_ < b.end_ and b.start_ < x.end_)),
holders as (select v, owner, repo, rank < 3 as in_base from (select * from base union all select * from bare) join docs using (doc_id)),
classes as (select v, bool_or(in_base) as known, case
    when count(distinct owner) >= {secrets.WIDE_OWNERS} or count(distinct repo) >= {secrets.WIDE_REPOS} then 'example'
    when count(distinct owner) <= {secrets.OWN_OWNERS} and count(distinct repo) <= {secrets.OWN_REPOS}
      and len(list_distinct(string_split(v, ''))) >= {secrets.LIVE_CHARS} then 'live' else 'shared' end as class
  from holders group by v),
every as (select * from base union all select bare.* from bare join classes using (v)
  where class = 'live' or known and class <> 'example'),
lines as (select e.doc_id, e.rank, e.kind, e.start_, e.v, class,
  e.kind || ':' || cast(e.start_ as bigint) || ':' || cast(e.end_ as bigint) as line from every e join classes using (v)),
per_doc as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c,
  count(*) filter (kind = 'hex') as h, string_agg(line, ',' order by start_, rank) filter (rank < 3) as base_spans,
  string_agg(line, ',' order by start_, rank) as spans,
  count(distinct v) filter (rank < 3 and class = 'live') as own,
  count(distinct v) filter (rank < 3 and class = 'example') as wide from lines group by doc_id)
select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(own, 0) as n_owner_specific, coalesce(wide, 0) as n_widely_copied
from docs left join per_doc using (doc_id)"""


@query("op10_secrets", _OP10_SQL)
def op10_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    line = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: line(s["kind"], s))
    every = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                               line(s["kind"], s).alias("line"))),
        F.transform("live", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"),
                                               line(F.lit("live"), s).alias("line"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    classes = lambda k: F.size(F.filter("classes", lambda c: c["class"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(every), lambda s: s["line"]), ",").alias("spans"),
        classes("live").alias("n_owner_specific"), classes("example").alias("n_widely_copied"))


# ------------------------------------------------------------------ 2 quality rules
def _op2_count(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(t) - length(regexp_replace(t, '{quoted}', '', 'g'))"


def _op2_sql() -> str:
    classes = [p for _, p in quality.CLASSES[:-1]]  # disjoint; then the rest of ASCII, then what is beyond it
    ascii_ = _op2_count(quality.CLASSES[-1][1])
    counts = [_op2_count(p) for p in classes]
    bins = ", ".join([*counts, f"({ascii_}) - ({' + '.join(f'({c})' for c in counts)})", f"length(t) - ({ascii_})"])
    space = quality.CLASSES[[n for n, _ in quality.CLASSES].index("space")][1]

    def distance(kind: str) -> str:
        return f"""select d.doc_id, sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end
    + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2, 0)) as distance
  from (select o.doc_id, coalesce(b.v, 0) / o.size as p, r.q from {kind}_docs o join {kind}_ref r using (lang)
    left join {kind}_bins b on b.doc_id = o.doc_id and b.bin = r.bin) d group by d.doc_id"""
    return f"""
with docs as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from docs),
windows as (select doc_id, i, w[i + 1 : i + {quality.REPEAT}] as ww
  from (select doc_id, w, unnest(range(0, len(w) - {quality.REPEAT - 1})) as i from docs where len(w) >= {quality.REPEAT})),
twice as (select doc_id, ww from windows group by doc_id, ww having count(*) > 1),
repeated as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {quality.REPEAT})) as p
  from windows join twice using (doc_id, ww)) group by doc_id),
base as (select d.doc_id, d.lang, cast(len(w) as bigint) as n_words, length(regexp_replace(t, '{space}', '', 'g')) as word_chars,
    {_op2_count(quality.SYMBOLS)} as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, length(t) as n_chars, [{bins}] as classes
  from docs d join lines using (doc_id) left join repeated r using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base),
words as (select doc_id, lang, unnest(w) as word from docs where lang is not null),
common as (select * from (select lang, word, row_number() over (partition by lang order by count(*) desc, word) as bin
  from words group by lang, word) where bin <= {quality.COMMON}),
hits as (select doc_id, bin, count(*) as v from words join common using (lang, word) group by doc_id, bin),
known as (select * from judged where lang in (select lang from common)),
word_bins as (select * from hits union all
  select doc_id, 0, n_words - coalesce(s, 0) from known left join (select doc_id, sum(v) as s from hits group by doc_id) using (doc_id)),
class_bins as (select doc_id, unnest(range(1, 8)) as bin, unnest(classes) as v from judged),
enough as (select lang from known where not base_failed group by lang having sum(n_words) >= {quality.MIN_REFERENCE}),
word_ref as (select lang, bin, coalesce(s, 0) / sum(s) over (partition by lang) as q
  from (select lang, bin from common union select lang, 0 from common) join enough using (lang)
  left join (select lang, bin, sum(v) as s from word_bins join known using (doc_id) where not base_failed
    group by lang, bin) using (lang, bin)),
class_ref as (select lang, bin, s / sum(s) over (partition by lang) as q from (select lang, bin, sum(v) as s
  from class_bins join known using (doc_id) join enough using (lang) where not base_failed group by lang, bin)),
word_docs as (select doc_id, lang, n_words as size from known where n_words >= {quality.MIN_WORDS}),
class_docs as (select doc_id, lang, n_chars as size from known where n_chars >= {quality.MIN_CHARS}),
word_far as ({distance('word')}), class_far as ({distance('class')})
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce(c.distance > {quality.MAX_CLASS_DISTANCE}, false)
    or coalesce(v.distance > {quality.MAX_WORD_DISTANCE}, false)) as kept,
  round(c.distance, 6) + 0.0 as class_distance, round(v.distance, 6) + 0.0 as word_distance
from judged j left join class_far c using (doc_id) left join word_far v using (doc_id)"""


@query("op2_quality", _op2_sql())
def op2_quality(spark, sf_dir):
    six = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        six("class_distance"), six("word_distance"))


# ------------------------------------------------------------------ 3 suffix tree
@query("op3_suffix_tree")
def op3_suffix_tree(spark, sf_dir):
    return suffix_tree.score(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 4 token counts
@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 7 language ID
@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents")).drop("tkey")


# ------------------------------------------------------------------ 5 personal data
@query("op5_personal")
def op5_personal(spark, sf_dir):
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.startswith(kind + ":"))).cast("long")
    base = F.filter("spans", lambda s: ~s.startswith("term:"))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in personal.KINDS],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"),
                        F.sha2("sanitised", 256).alias("sanitised_sha256"))


# ------------------------------------------------------------------ 6 sampled segmentations
def segmentation_digest(sampled: DataFrame) -> DataFrame:
    """The samples with the number and a hash of their ids instead of the ids."""
    return sampled.select("doc_id", "rank", F.size("ids").cast("long").alias("n_tokens"),
                          F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "round_trip")


@query("op6_sampled_pieces")
def op6_sampled_pieces(spark, sf_dir):
    return segmentation_digest(sampled_pieces.sample(table(spark, sf_dir, "documents")))


# ------------------------------------------------------------------ 8 n-gram Jaccard join
@query("op8_chosen_path")
def op8_chosen_path(spark, sf_dir):
    return chosen_path.jaccard_classes(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 11 cross-tokenizer alignment
@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.align(table(spark, sf_dir, "documents"), groups=digest).withColumnRenamed("groups", "groups_sha256")


# ------------------------------------------------------------------ 12 hard negatives
@query("op12_hard_negatives", """
with ints as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.vec_id as anchor_id, r.vec_id as other, a.label = r.label as same,
    cast(list_inner_product(a.v, r.v) as bigint) as score
  from ints a join ints r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
positives as (select anchor_id, other as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
found as (select p.anchor_id, p.positive_id, s.other as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from found where rank <= 3""")
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


# ------------------------------------------------------------------ 13 byte-level BPE
@query("op13_byte_pairs")
def op13_byte_pairs(spark, sf_dir):
    found = byte_pairs.encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
