"""Queries op1 to op10 and the pipeline over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, iblt, jaccard, language, packing, pii, quality, substring, tokens, urls
from .frames import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL_OP1 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from w where len(ws) >= 13),
k as (select doc_id, p, array_to_string(ws[p:p+12], ' ') as win from g),
m as (select win, min(doc_id) as first from k group by win),
hit as (select distinct k.doc_id, k.p + o.o as p from k join m using (win), (select unnest(range(0, 13)) as o) o where m.first < k.doc_id),
e as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select e.doc_id, count(*) as kept, string_agg(word, ' ' order by e.p) as t
         from e left join hit on e.doc_id = hit.doc_id and e.p = hit.p where hit.p is null group by e.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_edits(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality.training_rows(docs, read(spark, sf_dir, "labels"), fold(5) != 0, "doc_id", "text", "quality"))
    out = quality.score(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = containment.contamination(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_OP5 = rf"""
with i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (select item, ws, least(13, len(ws)) as n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as p from i where len(ws) > 0),
win as (select distinct item, n, array_to_string(ws[p:p+n-1], ' ') as w from iw),
lens as (select distinct n from win),
d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dp as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, lens where len(ws) >= n),
hit as (select dp.doc_id, dp.p, dp.n, win.item from dp join win on dp.n = win.n and array_to_string(ws[p:p+dp.n-1], ' ') = win.w),
pos as (select count(distinct p + o) as n_hit, doc_id from hit, (select unnest(range(0, 13)) as o) where o < n group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join pos using (doc_id) left join items using (doc_id)
"""


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dictionary = tokens.write_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return tokens.read_tokens(files, dictionary, with_ids=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, with_ids=False)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


SQL_OP8 = rf"""
with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
             else list_distinct(list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p+2], ' '))) end as g from w),
n as (select doc_id, len(g) as n from s),
t as (select doc_id, unnest(g) as g from s),
c as (select g, count(*) as df from t group by g having count(*) > 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from t a join c using (g) join t b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 90 * (a.n + b.n - i)),
e as (select x, y from l union all select y, x from l),
r as (with recursive walk(x, y) as (select x, y from e union select walk.x, e.y from walk join e on walk.y = e.x) select x, min(y) as m from walk group by x)
select n.doc_id, cast(n.n as bigint) as n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) as component_id from n left join r on r.x = n.doc_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold(3) != 1).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql_op10() -> str:
    """Longest prefix rule first, else the pattern rules in order, all tried on every URL."""
    rules = sorted(urls.PREFIXES, key=lambda p: -len(p.rule))
    parts = [(p, *p.rule.partition("/")) for p in rules]
    fits = [(p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{rest}')") for p, h, _, rest in parts]
    rule = "case " + " ".join(f"when {c} then '{p.rule}'" for p, c in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{p.verdict}'" for p, c in fits)
    verdict += "".join(f" when (host != '' or path != '') and regexp_matches(lower(url), '{p.regex}') then '{p.verdict}'" for p in urls.PATTERNS) + " else 'allow' end"
    pattern = "case when " + rule + " is not null then null " + " ".join(f"when (host != '' or path != '') and regexp_matches(lower(url), '{p.regex}') then '{p.name}'" for p in urls.PATTERNS) + " end"
    return f"""
with a as (select page_id, url, case when contains(url, '://') then regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*', '', 's') else '' end as rest from pages),
b as (select page_id, url, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      case when contains(rest, '/') then substr(rest, instr(rest, '/')) else '' end as path from a)
select page_id, host, path, {rule} as rule, {verdict} as verdict, {pattern} as pattern from b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_pii": op2_pii,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_token_output": op6_token_output,
        "op7_packing": op7_packing,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_language_id": op9_language_id,
        "op10_url_filters": op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SQL_OP1, "op5_benchmark_decontamination": SQL_OP5, "op8_ngram_jaccard_join": SQL_OP8, "op10_url_filters": _sql_op10()}
