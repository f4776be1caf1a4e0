"""Scripts inside pages, read as sources: their tokens, facts and canonical hashes.

The SQL cuts a script into tokens by one pattern, which is right for scripts without templates, comments, regular
expressions and JSX, as those of the pages are; it ends statements at semicolons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.lineage import cut
from evidentia.operators import facts
from evidentia.operators.tokens import bracket_balance, source_hashes, token_table, tokenize
from evidentia.tables import table


def scripts(pages: DataFrame) -> DataFrame:
    """path (page_id/number.js), text: the bodies of a page's script elements."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    found = pages.select("page_id", F.posexplode(bodies).alias("i", "text"))
    return found.select(F.concat_ws("", F.col("page_id").cast("string"), F.lit("/"), "i", F.lit(".js")).alias("path"), "text")


def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each script: its canonical hash, whether its brackets are sound, what it declares and how often it calls."""
    tokens = cut(tokenize(scripts(table(spark, sf_dir, "pages"))))
    declared = facts.declarations(tokens).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("declared"))
    called = facts.call_sites(tokens).groupBy("path").agg(F.count("*").alias("n_calls"), F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("callees"))
    out = source_hashes(tokens).join(bracket_balance(tokens).select("path", "unmatched", "recovered"), "path").join(declared, "path", "left").join(called, "path", "left")
    return out.na.fill("", ["declared", "callees"]).na.fill(0, ["n_calls"])


def script_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each kind, text and depth of a token: in how many scripts it stands, and how often."""
    tokens = token_table(scripts(table(spark, sf_dir, "pages")))
    return tokens.groupBy("kind", "text", "depth").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_sources"))


_TOKENS = r"""with b as (select page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) as bodies from pages),
  s as (select page_id || '/' || (i - 1) || '.js' as path, bodies[i] as text from (select page_id, bodies, unnest(range(1, len(bodies) + 1)) as i from b)),
  t as (select path, regexp_extract_all(text, '"[^"]*"|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|[^\s]') as w from s where regexp_matches(text, '\S')),
  k as (select path, list_transform(w, lambda x: case when x[1] = '"' then 'string' when regexp_matches(x, '^[A-Za-z_$]') then 'word' when regexp_matches(x, '^[0-9]') then 'number'
    when x in ('(', '[', '{') then 'open' when x in (')', ']', '}') then 'close' else 'punct' end) as kinds, list_transform(w, lambda x: trim(x, '"')) as texts from t)"""
QUERIES = {"script_sources": script_sources, "script_tokens": script_tokens}
ORACLES = {
    "script_tokens": _TOKENS
    + """, n as (select path, kinds, texts, unnest(range(1, len(texts) + 1)) as i from k),
  d as (select path, kinds[i] as kind, texts[i] as text, len(list_filter(kinds[:i - 1], lambda x: x = 'open')) - len(list_filter(kinds[:i], lambda x: x = 'close')) as depth from n)
  select kind, text, cast(depth as integer) as depth, count(*) as n, count(distinct path) as n_sources from d group by all""",
    "script_sources": _TOKENS
    + r""", h as (select path, len(texts) as n_tokens, texts, kinds, string_split(replace(list_aggregate(list_transform(range(1, len(texts) + 1),
      lambda i: case when kinds[i] in ('string', 'number') then kinds[i] else '' end || ':' || texts[i]), 'string_agg', chr(0)), ':;' || chr(0), ':;' || chr(1)), chr(1)) as statements from k)
  select path, cast(n_tokens as bigint) as n_tokens, sha256(list_aggregate(list_transform(statements, lambda x: sha256(x)), 'string_agg', chr(0))) as canonical_fingerprint, '' as unmatched, false as recovered,
    coalesce(list_aggregate(list_sort(list_filter(list_transform(range(2, len(texts) + 1), lambda i: case when texts[i - 1] in ('var', 'let', 'const') then texts[i] end), lambda x: x is not null)), 'string_agg', ','), '') as declared,
    cast(len(list_filter(range(2, len(texts) + 1), lambda i: texts[i] = '(' and kinds[i - 1] = 'word')) as bigint) as n_calls,
    coalesce(list_aggregate(list_sort(list_distinct(list_transform(list_filter(range(2, len(texts) + 1), lambda i: texts[i] = '(' and kinds[i - 1] = 'word'), lambda i: texts[i - 1]))), 'string_agg', ','), '') as callees
  from h""",
}
