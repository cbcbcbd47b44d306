"""One query per operator over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefops.llm import bpe, chat, decontaminate, jaccard, language, merkle, passages, quality, secrets, spelling, tokenfile, toxicity, treebpe
from prefops.llm.frames import rows_of_keys
from prefops.sources import io

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BPE_RANKS = "byte_bpe_50k.tiktoken"
BPE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of all documents whose label says that their quality is good."""
    return rows_of_keys(docs.select("doc_id", "text"), "doc_id", labels.where("quality = 1").select("doc_id"))


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, trusted_texts(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


# What a turn takes beyond its role and text, and one character for every `<` and `[` in them.
MARK_CHARS = len(chat.START + chat.SEP + chat.END)


@query(
    "op2_chat_format",
    rf"""
with c as (
    select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  x as (select *, case when role = 'assistant' then text end learned, role || text both_ from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
  coalesce(sum(length(learned)), 0)::bigint loss_chars, sha256(coalesce(string_agg(learned, '' order by turn), '')) loss_sha256,
  sum({MARK_CHARS} + 2 * length(both_) - length(replace(replace(both_, '<', ''), '[', '')))::bigint formatted_chars
from x group by conv_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    formatted = chat.format_chats(turns.union(own).withColumn("parts", chat.text_part("text")))
    read = formatted.withColumns({"read": chat.read_turns("formatted"), "loss": chat.read_loss("formatted")})
    lines = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_shared_passages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"), each=True)


def hex_sha256(binary: str) -> Column:
    return F.sha2(F.col(binary), 256)


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    both = bpe.decode(ids, ranks, pattern, keep=["doc_id", "n_tokens"])
    return both.select("doc_id", "n_tokens", hex_sha256("packed").alias("ids_sha256"), hex_sha256("decoded").alias("decoded_sha256"))


@query(
    "op5_decontaminate",
    rf"""
with d as (select doc_id, coalesce(regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) ws from documents),
  b as (select cast(item_id as varchar) id, regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
  p as (select id, ws, least(len(ws), 10) k, unnest(generate_series(1, greatest(len(ws) - 9, 1))) i from b where len(ws) > 0),
  win as (select distinct id, k, array_to_string(ws[i:i + k - 1], ' ') g from p),
  ks as (select distinct k from win),
  wnd as (select doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) i from d, ks),
  hit as (select doc_id, i, wnd.k, id from wnd join win on win.k = wnd.k and win.g = array_to_string(ws[i:i + wnd.k - 1], ' ')),
  pos as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) x from hit) group by doc_id),
  its as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, id from hit) group by doc_id)
select d.doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos on pos.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


@query(
    "op6_jaccard_join",
    rf"""
with recursive w as (select doc_id, regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
  p as (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) i from w where len(ws) > 0),
  s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') g from p),
  n as (select doc_id, count(*) n from s group by doc_id),
  c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
  l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
  e as (select x, y from l union all select y, x from l),
  r(doc_id, root) as (select doc_id, doc_id from documents union select e.y, r.root from r join e on e.x = r.doc_id),
  m as (select doc_id, min(root) component_id from r group by doc_id)
select m.doc_id, coalesce(n, 0) n_shingles, component_id from m left join n on n.doc_id = m.doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch_path(spark, "token-files")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BPE_TOKENIZER), END_ID)
    return tokenfile.token_digests(spark, path).withColumnRenamed("key", "doc_id")


def held_out() -> Column:
    """Whether the language model hasn't learned from a document; one without an id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def severity_grades(labels: DataFrame) -> DataFrame:
    """The grades that the labels know: 1 for a toxic document, 0 for another."""
    return labels.select("doc_id", F.col("toxic").alias("grade"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, severity_grades(table(spark, sf_dir, "labels")))
    return toxicity.predict(docs, model, keep=["doc_id"])


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep=["doc_id"])
    base = joined_spans(F.filter("spans", lambda s: s.kind != "random"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), "n_random")


# crc32 of the bytes of a text, bit by bit.
SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex({0}), 2 * i + 1, 2))::bigint)),
  lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"""


@query(
    "op11_merkle_manifest",
    rf"""
with recursive d as (select doc_id, source, lang, n_chars, text, coalesce({SQL_CRC32.format("doc_id::varchar")} % 7 = 0, false) changed from documents),
  f as (select doc_id, lang, changed, n_chars,
      coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') a,
      coalesce(strlen(text) || ':' || text, '-') z from d),
  h as (select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) leaf,
      sha256(a || coalesce(strlen((n_chars + changed::int)::varchar) || ':' || (n_chars + changed::int), '-') || z) claimed from f),
  l as (select *, row_number() over () rid, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from h),
  t as (select lang, row_number() over (order by lang nulls first) - 1 tree, count(*) over () n from (select distinct lang from h)),
  s as (select l.*, t.tree, t.n trees from l join t on l.lang is not distinct from t.lang),
  low(tree, n, level, idx, h) as (
    select tree, n, 0, pos, leaf from s union all
    select tree, (n + 1) // 2, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)) from low where n > 1 group by tree, n, level, idx // 2),
  sub as (select tree, h from low where n = 1),
  up(n, level, idx, h) as (
    select (select count(*) from sub), 0, tree, h from sub union all
    select (n + 1) // 2, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by n, level, idx // 2),
  one(rid, tree, trees, n, level, idx, acc, proof) as (
    select rid, tree, trees, n, 0, pos, claimed, '' from s union all
    select one.rid, one.tree, trees, (one.n + 1) // 2, one.level + 1, one.idx // 2,
      sha256(case when b.h is null then acc when one.idx % 2 = 0 then acc || b.h else b.h || acc end), proof || coalesce(b.h, '')
    from one left join low b on b.tree = one.tree and b.level = one.level and b.idx = xor(one.idx, 1) where one.n > 1),
  two(rid, n, level, idx, acc, proof) as (
    select rid, trees, 0, tree, acc, proof from one where n = 1 union all
    select rid, (two.n + 1) // 2, two.level + 1, two.idx // 2,
      sha256(case when b.h is null then acc when two.idx % 2 = 0 then acc || b.h else b.h || acc end), proof || coalesce(b.h, '')
    from two left join up b on b.level = two.level and b.idx = xor(two.idx, 1) where two.n > 1)
select s.doc_id, s.leaf, sub.h subroot, r.h root, sha256(two.proof) proof_sha256, two.acc folded_root, two.acc = r.h verified
from s join sub on sub.tree = s.tree join two on two.rid = s.rid and two.n = 1 cross join (select h from up where n = 1) r
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(38,0)") + F.when(chosen, 1).otherwise(0)
    tampered = merkle.leaf_hash(list({**fields, "n_chars": more}.values()))
    proofs = merkle.prove(merkle.manifest(docs, merkle.leaf_hash(list(fields.values())), "lang", "doc_id", tampered, whole=False))
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query("op12_tree_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(WORD_TOKENIZER)
    ids = treebpe.encode(table(spark, sf_dir, "documents"), tokenizer)
    both = treebpe.decode(ids, tokenizer, keep=["doc_id", "n_tokens"])
    return both.select("doc_id", "n_tokens", hex_sha256("packed").alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query(
    "op13_spelling_variants",
    rf"""
with recursive w as (select doc_id, unnest(regexp_extract_all({SQL_LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) w from documents),
  c as (select doc_id, w, count(*) n, doc_id || ':' || w k from w where length(w) >= 6 group by doc_id, w),
  h as (select w, n, case when k is null then 1 else {SQL_CRC32.format("k")} end h from c),
  v as (select case when h % 199 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end word, n from h),
  u as (select word, sum(n)::bigint n from v where length(word) >= 6 group by word having sum(n) >= 5),
  i as (select word, n, unnest(range(length(word))) i from u),
  x as (select distinct word, left(word, i::int) || substr(word, i::int + 2) v, left(word, i::int) || '*' || substr(word, i::int + 2) m from i),
  p as (select x.word a, u.word b from x join u on x.v = u.word union select u.word, x.word from x join u on x.v = u.word
    union select x.word, y.word from x join x y on x.m = y.m and x.word <> y.word),
  b as (select a word, count(*) n_near, first(b order by n desc, b) best, max(n) best_n from p join u on u.word = p.b group by a),
  f as (select u.word, u.n, coalesce(n_near, 0) n_near, case when best_n >= 5 * u.n then best end form, case when best_n >= 5 * u.n then best_n end form_n
    from u left join b on b.word = u.word),
  r(word, root, form) as (select word, word, form from f union all select r.word, f.word, f.form from r join f on f.word = r.form)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r on r.word = f.word and r.form is null
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), change=spelling.planted_change)
    return spelling.spelling_variants(words)
