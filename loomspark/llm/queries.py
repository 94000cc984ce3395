"""One query per operator, over its whole table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, decontam, langid, lattice, linededup, lmscore, ngramjoin, sharding, spiece, tokencount, toxicity, veccodes, wand
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontamination"] = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') w from documents),
ds as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i+4], ' ') else array_to_string(w, ' ') end s
       from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from dw where len(w) > 0)),
iw as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') w from benchmark),
ish as (select distinct item_id, case when len(w) >= 5 then array_to_string(w[i:i+4], ' ') else array_to_string(w, ' ') end s
       from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from iw where len(w) > 0)),
n as (select item_id, count(*) n_item from ish group by item_id)
select doc_id, item_id, count(*) n_shared, any_value(n_item) n_item, count(*)::double / any_value(n_item) containment
from ds join ish using (s) join n using (item_id) group by doc_id, item_id having count(*) >= 0.8 * any_value(n_item) - 1e-9
"""


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chatformat.format_chats(turns).withColumn("back", chatformat.read_back(F.col("formatted")))
    said = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chatformat.unescape(s["text"])), "")
    return chats.withColumn("said", said).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op8_chat_formatting"] = r"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, lag(r) over (partition by conv_id order by turn nulls first, r, x) p,
             length(x) + length(x) - length(replace(replace(x, '\', ''), '<', '')) n,
             length(r) + length(r) - length(replace(replace(replace(r, '\', ''), '<', ''), '>', '')) m from t)
select conv_id, count(*) n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
       coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
       sum(n + case when p is null or p <> r then m + 14 else 6 end)::bigint formatted_chars
from o group by conv_id
"""


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_mod("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = crc_mod("doc_id", 3) != 1
    scored = toxicity.score(docs, toxicity.fit(docs.filter(learn), table(spark, sf_dir, "labels").filter(learn)))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(table(spark, sf_dir, "documents"), n=4, percent=85)


ORACLES["op3_ngram_join"] = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i:i+3], ' ') else array_to_string(w, ' ') end s
      from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
l as (select x.doc_id a, y.doc_id b from s x join s y using (s) join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
      where x.doc_id <> y.doc_id group by x.doc_id, y.doc_id having 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(n, 0)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id
from documents left join n using (doc_id) left join (select a doc_id, min(b) m from r group by a) using (doc_id)
"""


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) != 2).alias("trained"))
    return lmscore.fit_score(docs).select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


ORACLES["op2_embedding_near_dedup"] = r"""
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings),
ok as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) u from e
       where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select x.vec_id a, y.vec_id b from ok x join ok y on x.vec_id <> y.vec_id and len(x.u) = len(y.u) and list_inner_product(x.u, y.u) >= 0.9),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept
from embeddings left join (select a vec_id, count(*) n from l group by a) using (vec_id) left join (select a vec_id, min(b) m from r group by a) using (vec_id)
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after three edits: a redaction, a deletion and an addition at the end."""
    n = F.length("text")
    edit = lambda start, length, put: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(put).alias("replacement"))
    edits = F.array(edit(F.floor(n / 3), 12, "[redacted]"), edit(F.floor(n * 2 / 3), 3, ""), edit(n, 0, "\nEnd of document."))
    return tokencount.recount(table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode(table(spark, sf_dir, "documents"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
e as (select doc_id, unnest(ls) line, unnest(range(len(ls))) pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from e),
c as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) n_lines, count(*) filter (k.key in (from c)) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (k.key not in (from c)), '')) kept_sha256
from k group by doc_id
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = veccodes.fit(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)
    coded = veccodes.with_label_errors(veccodes.encode(rows, books))
    code = F.array_join(F.transform("code", lambda j: F.lpad(F.lower(F.hex(j)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(veccodes.digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out, one after the other: a<k> assigns parts to the codebooks b<k>."""
    ctes = f"""e as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) v from embeddings
      where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] v from e, range({parts}) r(p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 j, v c from x qualify j < {entries})"""
    for k in range(rounds + 1):
        ctes += f""",
a{k} as materialized (select vec_id, label, x.p p, min_by({{'j': j, 'd': d}}, d * {entries} + j) got, any_value(v) v
        from (select vec_id, label, x.p p, j, v, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from x join b{k} b on x.p = b.p) x
        group by vec_id, label, x.p)"""
        if k < rounds:
            ctes += f""",
m{k} as (select p, got.j j, i, sum(y)::bigint s, count(*) n from (select p, got, unnest(v) y, unnest(range(len(v))) i from a{k}) group by p, got.j, i),
n{k} as (select p, j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) c from m{k} group by p, j),
b{k + 1} as materialized (select p, j, coalesce(n{k}.c, o.c) c from b{k} o left join n{k} using (p, j))"""
    last = f"a{rounds}"
    return f"""with {ctes},
o as (select vec_id, any_value(label) label, string_agg(lower(lpad(hex(got.j), 2, '0')), '' order by p) code, sum(got.d)::bigint error from {last} group by vec_id),
s as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, j)) h from b{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, (select h from s) codebooks_sha256 from o
"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLES["op13_ranked_search"] = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) term from documents),
tf as (select doc_id, term, count(*) tf from t group by doc_id, term),
n as (select doc_id, sum(tf)::bigint n from tf group by doc_id),
s as (select count(*) n_docs, sum(n)::bigint n_terms from n),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) term from benchmark),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint w from tf, s where term in (select term from q) group by term, n_docs),
p as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) gain from tf join w using (term) join n using (doc_id), s),
r as (select item_id, doc_id, sum(gain)::bigint score from q join p using (term) group by item_id, doc_id having sum(gain) > 0)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer rank, doc_id, score from r qualify rank <= 50
"""
