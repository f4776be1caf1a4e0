"""The numbered operators as queries over their whole tables, with DuckDB text where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.best_fit import pack_best_fit
from evidentia.llm.bpe_codec import encode_documents
from evidentia.llm.chat_format import digests, format_conversations
from evidentia.llm.lexical import build_index, search
from evidentia.llm.ngram_jaccard import near_duplicates
from evidentia.llm.packing import pack
from evidentia.llm.periodic_runs import periodic_runs
from evidentia.llm.quality_classifier import classify
from evidentia.llm.quality_rules import apply_rules
from evidentia.llm.secret_scan import scan
from evidentia.llm.token_counts import prefix_token_counts, total_tokens
from evidentia.llm.topk import quantized, top_k
from evidentia.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), count_links=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = total_tokens()
    return prefix_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 512).alias("over_limit"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "n_candidates", "n_secrets", "findings")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(extra)))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every text whose id's CRC ends in 0, the words from a certain one on repeat with a certain period."""
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))  # without an id, the text stays as it is
    words = F.when(crc % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    split = docs.select("doc_id", "text", F.floor(crc / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    first = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - F.col("first")) / (3 + F.col("g") % 8))
    placed = split.withColumn("first", F.when(F.col("n") > 0, first)).withColumn("period", F.when(F.col("n") > 0, period))
    source = lambda i: F.when(i < F.col("first"), i).otherwise(F.col("first") + (i - F.col("first")) % F.col("period"))
    repeated = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return runs.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.minus")).alias("length"),
        F.col("longest.period").alias("period"), F.floor(-F.col("longest.minus") * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_OP6 = """
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') as w from documents),
said as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
windows as (select doc_id, i, x || chr(10) || lead(x) over d || chr(10) || lead(x, 2) over d as g from said window d as (partition by doc_id order by i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows where g is not null) where n > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
stats as (select w.doc_id, w, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) as lines, coalesce(repeats.n, 0) as n_repeat_words
  from w left join repeats on w.doc_id = repeats.doc_id),
judged as (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 20 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_dup_lines > 70 * len(lines)
       or 100 * len(list_filter(w, lambda x: upper(x) = x and lower(x) <> x)) > 60 * n_words) as kept
from judged
"""
_OP10 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|TURN |/TURN\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') as escaped, regexp_replace(text, '([\[<])\\(\\*)(/?INST\]|TURN |/TURN\]|/?s>|</?SYS>>)', '\1\2\3', 'g') as bare from c),
f as (select *, bool_or(escaped <> text or bare <> text) over (partition by conv_id) as escapes from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(case when escapes then escaped else text end) + case role when 'user' then 15 when 'system' then 15 when 'assistant' then 7
    else 14 + 2 * strlen(role) end) as bigint) as formatted_chars
from f group by conv_id
"""
_OP7 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as p from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.p, c.p) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
#: Words are joined into windows of six: a run of at least 12 words and two periods has six equal ones in a row, a period apart.
_OP12 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w from documents),
crc as (select doc_id, w, len(w) as n, xor(list_reduce(flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) & 1))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) as h from d),
placed as (select doc_id, w, n, h, (h // 10) % greatest(n, 1) as a, h // 10 as g from crc),
said as (select doc_id, unnest(case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end) as x,
  generate_subscripts(w, 1) - 1 as i from placed),
six as (select doc_id, i, x || chr(10) || lead(x) over d || chr(10) || lead(x, 2) over d || chr(10) || lead(x, 3) over d || chr(10)
  || lead(x, 4) over d || chr(10) || lead(x, 5) over d as v from said window d as (partition by doc_id order by i)),
pairs as (select l.doc_id, l.i, r.i - l.i as q from six l join six r on l.doc_id = r.doc_id and l.v = r.v and l.i < r.i where l.v is not null),
islands as (select doc_id, q, min(i) as s, max(i) - min(i) + 6 + q as n from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pairs) group by doc_id, q, k),
long as (select * from islands where n >= greatest(12, 2 * q)),
runs as (select * from long l where not exists (select 1 from long s where s.doc_id = l.doc_id and s.q < l.q and s.s <= l.s and s.s + s.n >= l.s + l.n)),
listed as (select doc_id, count(*) as n_runs, arg_min({'s': s, 'n': n, 'q': q}, [-n, s, q]) as best, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as lines from runs group by doc_id),
dropped as (select distinct doc_id, unnest(range(s + q, s + n)) as i from runs),
kept as (select said.doc_id, string_agg(x, ' ' order by said.i) as t from said left join dropped on said.doc_id = dropped.doc_id and said.i = dropped.i where dropped.i is null group by said.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.n as length, best.q as period, 1000 * best.n // best.q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from d left join listed on d.doc_id = listed.doc_id left join kept on d.doc_id = kept.doc_id
"""
_OP13 = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
lengths as (select doc_id, len(w) as n from d where len(w) > 0),
totals as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from lengths),
items as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
tf as (select doc_id, term, cast(count(*) as bigint) as tf from (select doc_id, unnest(w) as term from d) where term in (select term from items) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln(cast(2 * (select docs from totals) + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from tf group by term),
m as (select doc_id, 10 + (90 * n * (select docs from totals)) // (select terms from totals) as m from lengths),
scores as (select item_id, tf.doc_id as doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from tf join m on tf.doc_id = m.doc_id join weights on tf.term = weights.term join items on tf.term = items.term group by item_id, tf.doc_id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 10
"""

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_token_counts": op2_token_counts, "op3_secret_scan": op3_secret_scan, "op4_packing": op4_packing, "op5_warc": op5_warc, "op6_quality_rules": op6_quality_rules, "op7_top_k": op7_top_k, "op8_quality_classifier": op8_quality_classifier, "op9_bpe_codec": op9_bpe_codec, "op10_chat_format": op10_chat_format, "op11_best_fit": op11_best_fit, "op12_periodic_runs": op12_periodic_runs, "op13_lexical_search": op13_lexical_search}
ORACLES: dict[str, str] = {"op6_quality_rules": _OP6, "op7_top_k": _OP7, "op10_chat_format": _OP10, "op12_periodic_runs": _OP12, "op13_lexical_search": _OP13}
