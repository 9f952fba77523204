"""The registered queries of these operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.byte_bpe import encode_and_decode
from lodestone.llm.chat import NO_CONVERSATION, conversation_messages, format_paths, parse, unescaped
from lodestone.llm.language import identify, training_text
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.merkle import folded, manifest, siblings_digest, value_digest
from lodestone.llm.near_duplicates import near_duplicates
from lodestone.llm.nearest import nearest
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import apply_rules
from lodestone.llm.prefix_trie import prefix_trie, turn_digests, with_shared_heads
from lodestone.llm.repeated_windows import repeated_windows
from lodestone.llm.shared import new_path, written
from lodestone.llm.substrings import remove_repeats
from lodestone.llm.token_store import read_store, write_store
from lodestone.llm.words import tidied
from lodestone.plans.patterns import spread

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang) for passes without a shuffle, on all cores even if the file has few row groups."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, and what reading the formatted text back gives."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = format_paths(conversation_messages(said), unique=True)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns, loss, n = hashlib.sha256(), "".join(unescaped(text[s["begin"] : s["end"]]) for s in spans), 0
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                out.append((tree, n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = formatted.select("tree", "formatted", "spans").mapInArrow(tidied(back), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.withColumn("conv_id", F.when(F.col("conv_id") != NO_CONVERSATION, F.col("conv_id")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(documents(spark, sf_dir), WORD_VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(documents(spark, sf_dir), WORD_VOCABULARY, path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(documents(spark, sf_dir), BYTE_VOCABULARY)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir)).drop("rejected_by")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), overlapping=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return identify(docs, training_text(docs)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what the proofs say of rows of which some were tampered with."""
    docs = table(spark, sf_dir, "documents")
    values = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 7 == 0
    other = value_digest([*values[:3], docs["n_chars"] + 1, values[4]])
    leaves = docs.select("doc_id", "lang", value_digest(values).alias("leaf"), F.when(hit, other).alias("tampered"))
    proven = manifest(leaves, order="doc_id", group="lang")
    checked = proven.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return checked.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the head of the first of its five."""
    read = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    head = F.crc32(F.encode(conv.cast("string"), "UTF-8")) % 9
    turns = written(turn_digests(read), "turns")
    return prefix_trie(with_shared_heads(turns, read, head, conv - conv % 5, 8), read).drop("position", "subtree_end")


QUERIES = {f.__name__: f for f in (op1_substrings, op2_chat, op3_near_duplicates, op4_packing, op5_token_store, op6_byte_bpe, op7_nearest, op8_quality, op9_licenses, op10_language, op11_merkle, op12_repeated_windows, op13_prefix_trie)}

def _crc32(digits: str) -> str:
    """SQL: the unsigned CRC-32 of a number's digits; eight shifts for each."""
    shifts = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(string_split({digits}, ''), lambda d: ascii(d)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, b: {shifts}), 4294967295)"


ORACLE: dict[str, str] = {
    "op3_near_duplicates": r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from docs),
each as (select doc_id, unnest(s) as g from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from each a join each b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
reach as (select doc_id as x, doc_id as y from sets union select r.x, l.y from reach r join links l on l.x = r.y),
least as (select x, min(y) as m from reach group by x)
select doc_id, len(s) as n_shingles, m as component_id, doc_id = m as kept from sets join least on x = doc_id""",
    "op11_merkle": f"""
with recursive marked as (
  select row_number() over () as r, *, {_crc32("doc_id::varchar")} % 7 = 0 as hit from documents),
said as (
  select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail from marked),
leaf as (
  select r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as h,
    sha256(head || coalesce(strlen((n_chars + case when hit then 1 else 0 end)::varchar) || ':' || (n_chars + case when hit then 1 else 0 end), '-') || tail) as t from said),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as i, count(*) over (partition by lang) as n from leaf),
up as (
  select lang, 0 as level, i, n, h from placed
  union all
  select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from up where n > 1 group by lang, level, i // 2, n),
subs as (select lang, level, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from up where n = 1),
top as (
  select 0 as level, i, n, h from subs
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, i // 2, n),
steps as (
  select p.r, u.level, u.i % 2 as slot, s.h from placed p join up u on u.lang is not distinct from p.lang and u.i = p.i >> u.level and u.n > 1
    left join up s on s.lang is not distinct from u.lang and s.level = u.level and s.i = xor(u.i, 1)
  union all
  select p.r, b.level + u.level, u.i % 2, s.h from placed p join subs b on b.lang is not distinct from p.lang join top u on u.i = b.i >> u.level and u.n > 1
    left join top s on s.level = u.level and s.i = xor(u.i, 1)),
walk as (
  select r, 0 as level, t as h from placed
  union all
  select w.r, w.level + 1, sha256(case when s.slot = 1 then s.h || w.h else w.h || coalesce(s.h, '') end) from walk w join steps s on s.r = w.r and s.level = w.level),
ends as (select r, arg_max(h, level) as h from walk group by r),
proofs as (select r, sha256(string_agg(coalesce(h, ''), '' order by level)) as proof from steps group by r)
select p.doc_id, p.h as leaf, b.h as subroot, t.h as root, coalesce(f.proof, sha256('')) as proof_sha256, e.h as folded_root, e.h = t.h as verified
from placed p join subs b on b.lang is not distinct from p.lang join top t on t.n = 1 join ends e on e.r = p.r left join proofs f on f.r = p.r""",
    "op12_repeated_windows": r"""
with docs as (select row_number() over (order by doc_id, sha256(coalesce(text, ''))) as o, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
said as (select o, unnest(w) as word, generate_subscripts(w, 1) as i from docs),
seen as (select o, i, array_to_string(docs.w[i:i + 19], ' ') as win from docs, unnest(range(1, len(w) - 18)) as t(i) where len(w) >= 20),
later as (select o, i from (select o, i, row_number() over (partition by win order by o, i) as k from seen) where k > 1),
gone as (select distinct o, i + d as i from later, range(20) as r(d)),
kept as (select s.o, count(*) as n, string_agg(s.word, ' ' order by s.i) as t from said s anti join gone g on g.o = s.o and g.i = s.i group by s.o)
select d.doc_id, len(d.w) as n_words, len(d.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from docs d left join kept k on k.o = d.o""",
    "op13_prefix_trie": f"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as p, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as said
  from conversations where conv_id is not null),
ids as (select distinct conv_id as c, conv_id - conv_id % 5 as s, {_crc32("conv_id::varchar")} % 9 as h from own),
rebuilt as (
  select c, p, said from ids join own on own.conv_id = s and p < h
  union all
  select c, p, said from ids join own on own.conv_id = c and p >= h),
whole as (select i.c, coalesce(list(said order by p) filter (where said is not null), []) as l from ids i left join rebuilt r on r.c = i.c group by i.c),
nodes as (
  select list_slice(l, 1, d) as k, d, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (where len(l) = d), '') as ends
  from whole, unnest(range(0, len(l) + 1)) as t(d) group by 1, 2),
kids as (select list_slice(k, 1, d - 1) as k, count(*) as n from nodes where d > 0 group by 1),
full_ as (select n.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * case when d = 0 then 0 else strlen(n.k[d].t) end as saved from nodes n left join kids on kids.k = n.k),
sub as (select list_slice(k, 1, j) as k, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from full_, unnest(range(0, d + 1)) as t(j) group by 1)
select f.conv_id, f.d as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) as ends_sha256
from full_ f join sub s on s.k = f.k left join nodes p on p.d = f.d - 1 and p.k = list_slice(f.k, 1, f.d - 1)""",
}
