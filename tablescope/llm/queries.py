"""The operators over whole tables, with SQL where it can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import (bpe_automaton, class_lm, collocations, compact_windows, decontamination, html_blocks,
                            jaccard_join, language_id, license_rules, licenses, line_dedup, resampling, toxicity, vp_trees)
from tablescope.llm.storage import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(of: int, remainder: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves the remainder; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of)) == remainder, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.train(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    size = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a + 1).cast("long")), F.lit(0).cast("long"),
                       lambda s, x: s + x)
    return found.select(F.col("id").alias("doc_id"), "n_words", size.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.size("starts") > 0).alias("contaminated"))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe_automaton.WordTokenizer(tokenizer_path())
    return bpe_automaton.digests(_table(spark, folder, "documents"), tokenizer).withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages, html_blocks.train(pages)) \
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vp_trees.nearest(_table(spark, folder, "embeddings"), "id % 20 = 0")


def op7_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model, counts = class_lm.train(docs.where(~held_out(7, 2)))
    return class_lm.score(docs, model, counts).select(
        F.col("id").alias("doc_id"), held_out(7, 2, "id").alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(~held_out(5, 0)))
    return toxicity.detect(docs, model).select(
        F.col("id").alias("doc_id"), held_out(5, 0, "id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return compact_windows.repeated_passages(_table(spark, folder, "documents")) \
        .withColumnRenamed("id", "doc_id").withColumnRenamed("rep_id", "rep_doc_id")


def op11_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", *[f"licenses.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(_table(spark, folder, "documents")).withColumnRenamed("grp", "lang")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")) \
        .withColumnRenamed("id", "doc_id")


def _rule_rows() -> str:
    """The license rules as rows of a SQL VALUES list."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {text(r.keyword)}, {text(license_rules.pattern(r.words))}, {text(r.label)}, {r.priority}, {r.confidence}, {r.base})"
                     for i, r in enumerate(license_rules.rules()))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_decontamination, op3_ngram_jaccard_join, op4_bpe, op5_html_extraction, op6_nearest_neighbours,
    op7_class_lm, op8_toxicity, op9_line_dedup, op10_substring_dedup,
    op11_license_scans, op12_collocations, op13_importance_resampling, pipeline)}

ORACLE = {
    "op2_decontamination": rf"""
with recursive d as (select row_number() over () as rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as words
       from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (select rid, i, width, array_to_string(w[i:i + width - 1], ' ') as words
       from (select rid, w, width, unnest(range(1, len(w) - width + 2)) as i
             from d cross join (select distinct width from bw) where len(w) >= width)),
hit as (select rid, i, dw.width, item_id from dw join bw on dw.words = bw.words and dw.width = bw.width),
place as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + width)) as p from hit) group by rid),
found as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
          from (select distinct rid, cast(item_id as varchar) as item_id from hit) group by rid)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join place using (rid) left join found using (rid)""",
    "op3_ngram_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w
       from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select x, y from common join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
reach as (select doc_id as x, doc_id as y from d union select reach.x, link.y from reach join link on reach.y = link.x)
select d.doc_id, coalesce(n, 0) as n_shingles, r.c as component_id
from d left join n using (doc_id) join (select x as doc_id, min(y) as c from reach group by x) r using (doc_id)""",
    "op6_nearest_neighbours": """
with v as (select distinct vec_id, cast(embedding as double[]) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op11_license_scans": rf"""
with d as (select row_number() over () as rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t as (select rid, ' ' || array_to_string(w, ' ') || ' ' as plain,
             array_to_string([' ' || w[i] || '#' || (i - 1) || ' ' for i in range(1, len(w) + 1)], '') as words from d),
rule(ord, keyword, pattern, label, priority, confidence, base) as (values {_rule_rows()}),
m as (select rid, ord, label, priority, confidence, base, unnest(regexp_extract_all(words, pattern)) as s
      from t join rule on contains(plain, keyword)),
h as (select rid, ord, label, priority, confidence, base, cast(regexp_extract(s, '#([0-9]+)', 1) as bigint) as a,
             cast(regexp_extract(s, '#([0-9]+) $', 1) as bigint) as b from m),
told as (select * from h x where base or not exists (select 1 from h y where y.rid = x.rid and y.a <= x.a and y.b >= x.b
           and (y.priority < x.priority or y.priority = x.priority and (y.b - y.a > x.b - x.a or y.ord < x.ord)))),
doc as (select rid, count(*) filter (base) as n_base, min(a) filter (base) as first_word, max(a) filter (base) as last_word,
               string_agg(distinct label, ',' order by label) filter (base) as base_labels,
               string_agg(distinct label, ',' order by label) as labels, max(confidence) as score from told group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score
from d left join doc using (rid)""",
    "op12_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
           from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w join (values (1), (2), (3), (4), (5)) s(k) on len(w) >= k)),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 100),
c as (select lang, f.k as size, phrase, a, unnest(range(1, f.k)) as k from f where f.k > 1),
cut as (select c.*, array_to_string(string_split(phrase, ' ')[:k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as tail
        from c),
s as (select cut.lang, cut.phrase, cut.a, cut.k, x.a as l, y.a as r, n.n, cast((1000::hugeint * cut.a * n.n) // (x.a::hugeint * y.a) as bigint) as score
      from cut join f x on x.lang = cut.lang and x.phrase = head join f y on y.lang = cut.lang and y.phrase = tail
      join n on n.lang = cut.lang),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from best b where not exists (select 1 from f where f.lang = b.lang and len(f.phrase) > len(b.phrase) and f.a >= b.a
           and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000""",
    "op13_importance_resampling": rf"""
with recursive step(i, b, c) as (select 0, range, range from range(256) union all
       select i + 1, b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where i < 8),
crc as (select list(c order by b) as t from step where i = 8),
d as (select row_number() over () as rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
df as (select rid, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as f from d),
bf as (select unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as f from b),
x as (select f, hex(encode(f)) as h from (select f from df union select f from bf)),
y as (select f, [4294967295::bigint] || [(instr('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 1
             for i in range(1, len(h) // 2 + 1)] as bytes from x),
bucket as (select f, xor(list_reduce(bytes, lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1])), 4294967295) % 10000 as k from y, crc),
s as (select k, count(*) as s from df join bucket using (f) group by k),
t as (select k, count(*) as t from bf join bucket using (f) group by k),
g as (select k, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from df) + 10000)
             / ((coalesce(s, 0) + 1)::double * ((select count(*) from bf) + 10000)))) as bigint) as gain
      from range(10000) r(k) left join s using (k) left join t using (k)),
n as (select rid, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight
      from df join bucket using (f) join g using (k) group by rid),
e as (select doc_id, len(w) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             ('0x' || sha256('7:' || coalesce(cast(doc_id as varchar), ''))[:8])::bigint as h from d left join n using (rid)),
z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from e),
r as (select *, case when able then row_number() over (partition by able order by score desc, doc_id, n_features) end as place from z)
select doc_id, n_features, weight, score,
       case when place <= (select 25 * count(*) // 100 from z where able) then place end as rank from r""",
}
