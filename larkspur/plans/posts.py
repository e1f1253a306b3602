"""Queries over posts, characters and ratings as samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import samples, text
from larkspur.plans.catalog import query
from larkspur.sources import datasets
from larkspur.sources.tables import read


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _each(column: str, pattern: str, made: str) -> str:
    return f"array_to_string([{made} for p in regexp_extract_all({column}, {_quoted(pattern)}, 1)], '')"


def _in_turn(column: str, rules) -> str:
    for pattern, to in rules:
        to = to.replace("$1", chr(92) + "1")
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return column


_PLAIN = r"a-z0-9()<>' `\-"
_HASH = "case when not regexp_matches(p, '^#[^ \t\n\f\r]') then p when upper(p[2:]) = p[2:] then ' <hashtag> ' || lower(p[2:]) || ' <allcaps> ' else ' <hashtag> ' || lower(array_to_string(regexp_extract_all(p[2:], '([A-Z]+[^A-Z]*|[^A-Z]+)', 1), ' ')) end"
_LOUD = f"case when regexp_matches(p, {_quoted(f'^[^{_PLAIN}]{{2,}}$')}) then lower(p) || ' <allcaps> ' else p end"


def _tagged(rows: str) -> str:
    """h, then t: hashtags and capitals of the texts x of ``rows``."""
    hashed = f"h as (select * exclude (x), {_each('x', r'(#[^ \t\n\f\r]+|[^#]+|#)', _HASH)} as x from {rows})"
    return f"{hashed}, t as (select * exclude (x), {_each('x', f'([^{_PLAIN}]{{2,}}|[{_PLAIN}]+|[^{_PLAIN}])', _LOUD)} as x from h)"


@query(f"with r as (select conv_id, turn, text as x from conversations), {_tagged('r')} select conv_id, turn, x as tagged from t")
def x7_x8_tagged_posts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.tag_capitals(text.tag_hashtags(F.col("text"))).alias("tagged"))


#: Runs of three or more of a character, which SQL's patterns cannot tell: characters numbered within their run.
_LONG = """c as (select id, unnest(string_split(x, '')) as c, generate_subscripts(string_split(x, ''), 1) as k from t),
s as (select id, c, k, k - row_number() over (partition by id, c order by k) as run from c),
l as (select id, min(k) as k, any_value(c) as c, count(*) as n from s group by id, s.c, run),
e as (select id, string_agg(case when n > 2 and c <> chr(10) then c || ' <elong> ' else repeat(c, n) end, '' order by k) as x from l group by id)"""
_FIRST, _LAST = text.TAGS, text.CONTRACTIONS


_WORDS = f"""r as (select row_number() over () as id, * from conversations), q as (select id, {_in_turn('text', _FIRST)} as x from r), {_tagged('q')}, {_LONG},
w as (select r.*, case when text is null then null else trim(regexp_replace({_in_turn("translate(lower(coalesce(x, '')), chr(10) || chr(9) || chr(8) || chr(13), '    ')", _LAST)}, '[^A-Za-z<>]+', ' ', 'g')) end as words from r left join e using (id))"""


@query(f"with {_WORDS} select conv_id, turn, words from w")
def x1_x12_post_words(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain_words(text.tag_post(F.col("text"))).alias("words"))


@query(f"""with {_WORDS}, k as (select conv_id, turn, cast(role = 'user' as int) as y, words from w where role <> 'system' and conv_id in (select conv_id from w where role <> 'system' group by conv_id having count(*) > 4 order by count(*) desc, conv_id limit 25)),
n as (select word, count(*) as n from (select unnest(string_split(words, ' ')) as word from w) where word <> '' group by word), v as (select word, row_number() over (order by n desc, word) - 1 as vec_id from n),
o as (select conv_id, turn, y, unnest(string_split(coalesce(words, ''), ' ')) as word from k),
m as (select conv_id, turn, any_value(y) as y, k, round(avg(coalesce(cast(embedding[k] as double), 0)), 6) as v from o left join (select * from v where vec_id < 200) using (word) left join embeddings using (vec_id), (select unnest(range(1, 65)) as k) group by conv_id, turn, k)
select conv_id, turn, any_value(y) as y, list(v order by k) as x from m group by conv_id, turn""")
def s7_post_vectors(spark, sf_dir):
    """Posts of the 25 conversations with most of them, as mean vectors; the 200 commonest words of all have vectors.

    System messages are the neutral ones.
    """
    said = read(spark, sf_dir, "conversations")
    words = said.select(F.explode(F.split(text.plain_words(text.tag_post(F.col("text"))), " ")).alias("word")).where("word <> ''")
    common = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(200)
    ranked = common.withColumn("vec_id", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("long"))  # 200 rows
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(ranked.select("word", "vec_id"), "vec_id").select("word", "embedding")
    posts = datasets.top_owners(said.where("role <> 'system'"), "conv_id", 25, 4).select(F.struct("conv_id", "turn", (F.col("role") == "user").cast("int").alias("y")).alias("post"), "text")
    made = samples.post_vectors(posts, "post", "text", vectors, "word", "embedding", 64, stemmed=False)
    # A small mean below zero is -0.0 in SQL, which Spark's rounding makes 0.0.
    return made.select("post.*", F.transform("x", lambda v: F.signum(v) * F.round(F.abs(v), 6)).alias("x"))


_WIDTH = 80


@query(f"""with c as (select doc_id, [nullif(coalesce(list_position(string_split({_quoted(text.SPEECH)}, ''), c), 0), 0) - 1 for c in string_split(text, '')] as ids from documents where length(text) > {_WIDTH}),
k as (select doc_id, ids, unnest(range(0, len(ids) - {_WIDTH}, {_WIDTH})) as k from c)
select doc_id, cast(k as int) as k, [cast(i as int) for i in ids[k + 1 : k + {_WIDTH}]] as x, cast(ids[k + {_WIDTH} + 1] as int) as y from k""")
def s8_j6_x16_char_samples(spark, sf_dir):
    """Stretches of characters of all documents and what follows each."""
    return samples.char_samples(read(spark, sf_dir, "documents"), "doc_id", "text", text.SPEECH, _WIDTH).select("doc_id", "k", F.col("x").cast("array<int>").alias("x"), F.col("y").cast("int").alias("y"))


_TOP = 500


@query(f"""with r as (select o_custkey as user, l_partkey as item, cast(l_quantity as double) as v from lineitem join orders on l_orderkey = o_orderkey),
n as (select item, count(*) as n from r group by all order by n desc, item limit {_TOP}), p as (select item, row_number() over (order by item) - 1 as place from n),
o as (select user, place, max(v) as v from r join p using (item) group by all), u as (select distinct user from o),
x as (select u.user, list(coalesce(o.v, 0.0) order by g.k) as x from u cross join (select unnest(range({_TOP})) as k) g left join o on o.user = u.user and o.place = g.k group by u.user)
select user, x, c_acctbal as y from x join customer on c_custkey = user where c_acctbal is not null""")
def s16_labelled_ratings(spark, sf_dir):
    """Customers' ratings of the 500 most popular parts, with their balance as label."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ratings = lines.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("double").alias("v"))
    labels = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_acctbal")
    return samples.labelled(samples.rating_rows(ratings, "user", "item", "v", _TOP), labels, "user", "c_acctbal")
