"""Registered queries of embeddings and of texts in comparison with each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import mauve, neighbours, scene_blocks, self_bleu, spice, token_matching
from lodestone.plans.patterns import once, spread
from lodestone.queries import _PAIRS_DUCK, _pairs, query


def _translated(spark: SparkSession, d: str) -> DataFrame:
    """Each vector and a shifted one, as of its translation."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"))
    return v.withColumn("b", F.transform("a", lambda x, i: x + ((F.col("id") * 31 + i * 17) % 7 - 3) * 0.08))


_SIDES = "v as (select vec_id as id, cast(embedding as double[]) as a from embeddings), p as (select id, a, list_transform(a, lambda x, i: x + ((id * 31 + (i - 1) * 17) % 7 - 3) * 8e-2) as b from v), m as (select s.id as i, t.id as j, list_cosine_similarity(s.a, t.b) as sim from p s, p t)"
_ACCURACY = "w as (select i, j, sim{over} as sim from m{joins}), r as (select avg(cast(i = j as int) * 1e0) as a from (select i, j, row_number() over (partition by i order by sim desc, j) as k from w) where k = 1), l as (select avg(cast(i = j as int) * 1e0) as b from (select i, j, row_number() over (partition by j order by sim desc, i) as k from w) where k = 1) select round((a + b) / 2, 6) as accuracy, round(a, 6) as source_to_target, round(b, 6) as target_to_source, round((select avg(sim) from m where i = j), 6) as mean_pair_cosine from r, l"
_AROUND = ", f as (select i, avg(sim) as f from (select i, sim, row_number() over (partition by i order by sim desc) as k from m) where k <= 4 group by i), g as (select j, avg(sim) as g from (select j, sim, row_number() over (partition by j order by sim desc) as k from m) where k <= 4 group by j)"
query("bitext_mining", f"with {_SIDES}, {_ACCURACY.format(over='', joins='')}")(lambda s, d: neighbours.bitext_mining(_translated(s, d), "a", "b"))
query("bitext_mining_margin", f"with {_SIDES}{_AROUND}, {_ACCURACY.format(over=' / ((f + g) / 2)', joins=' join f using (i) join g using (j)')}")(lambda s, d: neighbours.bitext_mining(_translated(s, d), "a", "b", scoring="margin"))

_RULED = "' ' || replace(replace(replace(coalesce(text, ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ') || ' '"
for _name, _sign in self_bleu.REFERENCES_13A:
    _RULED = f"replace({_RULED}, '{_name}', '{_sign}')"
for _rule, _out in self_bleu.RULES_13A:
    _RULED = f"regexp_replace({_RULED}, '{_rule}', '{_out.replace('$', chr(92))}', 'g')"
_GRAMS = " union all ".join(f"select k, {n} as n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], chr(1)))) as g from w" for n in range(1, 5))
_BEST = "c as (select k, n, g, count(*) as c from grams group by all), o as (select *, max(c) over (partition by n, g) as m, count(*) over (partition by n, g) as r from c), p as (select *, sum(cast(c = m as int)) over (partition by n, g) as u, max(case when c < m then c end) over (partition by n, g) as s from o), h as (select k, n, sum(least(c, case when r = 1 then 0 when c = m and u = 1 then coalesce(s, 0) else m end)) as h from p group by k, n)"
_NEAR = "z as (select k, len(w) as l from w), q as (select a.k, a.l, arg_min(b.l, abs(a.l - b.l) * 1000000 + b.l) as o from z a join z b on a.k <> b.k group by a.k, a.l)"
_PER = "t as (select q.k, q.l, q.o, n.n, greatest(q.l - n.n + 1, 0) as t, coalesce(h.h, 0) as h from q, (values (1), (2), (3), (4)) n(n) left join h on h.k = q.k and h.n = n.n), x as (select *, sum(cast(t > 0 and h = 0 as int)) over (partition by k order by n) as z from t), y as (select k, min(l) as l, min(o) as o, max(h) as h, sum(case when t = 0 then 0e0 when h > 0 then ln(h * 1e0 / t) else -ln(power(2e0, z) * t) end) as s, sum(cast(t > 0 as int)) as u from x group by k), sb as (select k, case when h > 0 then 100 * case when l >= o then 1 else exp(1 - o * 1e0 / l) end * exp(s / u) else 0e0 end as v from y)"
_SELF = rf"with w as (select doc_id as k, list_filter(string_split_regex({_RULED}, '\s+'), lambda x: x <> '') as w from documents), grams as ({_GRAMS}), {_BEST}, {_NEAR}, {_PER}"
query("self_bleu", f"{_SELF} select round(avg(v), 6) as self_bleu from sb")(lambda s, d: self_bleu.self_bleu(spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), "doc_id", "text"))
query("self_bleu_scores", f"{_SELF} select k as doc_id, round(v, 6) as self_bleu from sb")(lambda s, d: self_bleu.self_bleu_scores(spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), "doc_id", "text"))


def _tokens(spark: SparkSession, d: str, column: str) -> DataFrame:
    """Eight vectors an example, as of its tokens; the vector's label is the token."""
    v = _translated(spark, d).join(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("token")), "id")
    return v.select(F.floor(F.col("id") / 8).cast("long").alias("example"), F.col("id").alias("at"), F.col(column).alias("v"), "token")


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    a, b = _tokens(spark, d, "a"), _tokens(spark, d, "b").filter("at % 5 <> 0")
    return token_matching.bertscore(token_matching.token_weights(a, a), token_matching.token_weights(a, b), baseline=0.1)


_BERT = "v as (select vec_id as id, vec_id // 8 as e, cast(label as varchar) as k, cast(embedding as double[]) as a from embeddings), p as (select *, list_transform(a, lambda x, i: x + ((id * 31 + (i - 1) * 17) % 7 - 3) * 8e-2) as b from v), n as (select count(distinct e) as n from v), i as (select k, ln(((select n from n) + 1e0) / (count(distinct e) + 1)) as w from v group by k), m as (select r.e, r.id as i, q.id as j, list_cosine_similarity(r.a, q.b) as s, {w} from p r join p q on q.e = r.e and q.id % 5 <> 0{joins}), x as (select e, sum(s * w) / nullif(sum(w), 0) as r from (select e, i, max(s) as s, any_value(wi) as w from m group by e, i) group by e), y as (select e, sum(s * w) / nullif(sum(w), 0) as p from (select e, j, max(s) as s, any_value(wj) as w from m group by e, j) group by e), z as (select e, {p} as p, {r} as r from x join y using (e)) select e as example, round(p, 6) as \"precision\", round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from z".replace(chr(92), "")
query("bertscore", "with " + _BERT.format(w="1e0 as wi, 1e0 as wj", joins="", p="p", r="r"))(lambda s, d: token_matching.bertscore(_tokens(s, d, "a"), _tokens(s, d, "b").filter("at % 5 <> 0")))
query("bertscore_weighted", "with " + _BERT.format(w="ri.w as wi, qi.w as wj", joins=" join i ri on ri.k = r.k join i qi on qi.k = q.k", p="(p - 0.1e0) / 0.9e0", r="(r - 0.1e0) / 0.9e0"))(_weighted)
query("mauve")(lambda s, d: mauve.mauve(s.read.parquet(f"{d}/embeddings.parquet").withColumn("side", F.when(F.col("vec_id") % 2 == 0, "human").otherwise("model")), "side", "embedding", "vec_id", reference="human", generated="model"))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """Tuples of one, two and three words in turn, of the whole texts of each document, and of its prediction, where each third
    tuple has another spelling. Words are split once a text and zipped with those that follow, not split for each tuple."""

    def cut(words: Column, first: Callable[[Column], Column]) -> Column:
        near = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c"))
        two = lambda z: F.when(z["b"].isNull(), F.array(z["a"])).otherwise(F.array(z["a"], z["b"]))
        part = lambda z, i: F.when(i % 3 == 0, F.array(first(z["a"]))).when((i % 3 == 1) | z["c"].isNull(), two(z)).otherwise(F.array(z["a"], z["b"], z["c"]))
        return F.transform(near, part)

    spelled = lambda w: F.replace(w, F.lit("th"), F.lit("t"))
    words = once(_pairs(spark, d), [F.col("doc_id").alias("image")], own=F.split(F.lower("prediction"), " "), other=F.split(F.lower("reference"), " "))
    return once(words, ["image"], own=cut(F.col("own"), spelled), other=cut(F.col("other"), lambda w: w))


def _windows(texts: pa.Array, spelled: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tuples of ``_scenes`` as a cut of whole texts: of each word with up to two that follow."""
    split = pc.split_pattern(texts, " ")
    words, n = split.flatten(), scene_blocks.lengths(split)
    i = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(words))[:, None] + np.arange(3)
    at[np.arange(3) >= np.minimum(i % 3 + 1, np.repeat(n, n) - i)[:, None]] = -1
    if spelled:
        first = np.flatnonzero(i % 3 == 0)
        at[first, 0] = len(words) + np.arange(len(first))
        words = pa.concat_arrays([words, pc.replace_substring(words.take(pa.array(first)), "th", "t")])
    return words, at, n


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """Words that are one but for th and t are synonyms. A prediction has words of its text, or their other spelling."""
    words = _pairs(spark, d).select(F.explode(F.array_distinct(F.split(F.lower("reference"), " "))).alias("word")).distinct()
    spelled = F.replace("word", F.lit("th"), F.lit("t"))
    both = words.select(F.explode(F.array_distinct(F.array("word", spelled))).alias("word"))
    texts = _pairs(spark, d).select(F.col("doc_id").alias("image"), F.array(F.lower("prediction")).alias("own"), F.array(F.lower("reference")).alias("other"))
    return spice.scene_scores(texts, both.select("word", spelled.alias("key")), (partial(_windows, spelled=True), _windows))


_CUT = "list_transform(range(1, len({x}) + 1), lambda i: list_transform({x}[i:i + (i - 1) % 3], lambda w: lower(w)))"
_KEYED = "list_transform({x}, lambda w: replace(w, 'th', 't'))"
_SCENES = f"{_PAIRS_DUCK}, c as (select distinct doc_id as image, t from (select doc_id, unnest(list_transform({_CUT.format(x='p')}, lambda t, i: case when i % 3 = 1 then {_KEYED.format(x='t')} else t end)) as t from pr) where len(t) > 0 and list_min(list_transform(t, lambda w: length(w))) > 0), r as (select distinct doc_id as image, t from (select doc_id, unnest({_CUT.format(x='r')}) as t from pr) where len(t) > 0 and list_min(list_transform(t, lambda w: length(w))) > 0), x as (select c.image, c.t from c join r on r.image = c.image and r.t = c.t)"
_SPICE = "select image, round(m * 1e0 / nullif(c, 0), 6) as \"precision\", round(m * 1e0 / nullif(r, 0), 6) as recall, round(2e0 * m / (c + r), 6) as spice from (select image, sum(c) as c, sum(r) as r, sum(m) as m from ({rows}) group by image)".replace(chr(92), "")
_SIDES3 = "select image, 1 as c, 0 as r, 0 as m from c union all select image, 0, 1, 0 from r union all select image, 0, 0, 1 from x"
_LEFT = f"lc as (select image, {_KEYED.format(x='t')} as k, count(*) as n from c anti join x on x.image = c.image and x.t = c.t group by 1, 2), lr as (select image, {_KEYED.format(x='t')} as k, count(*) as n from r anti join x on x.image = r.image and x.t = r.t group by 1, 2)"
query("spice_scores", f"with {_SCENES} {_SPICE.format(rows=_SIDES3)}")(lambda s, d: spice.scene_scores(_scenes(s, d)))
query("spice_synonyms", f"with {_SCENES}, {_LEFT} {_SPICE.format(rows=_SIDES3 + ' union all select lc.image, 0, 0, least(lc.n, lr.n) from lc join lr on lr.image = lc.image and lr.k = lc.k')}")(_spelled)
_MEANS = "z as ({scores}), n as (select image, {u} as n, c, r, m from ({rows})), f as (select n, 2e0 * sum(m) / (sum(c) + sum(r)) as f from n group by n)"
_SIZED = "select image, len(t) as size, 1 as c, 0 as r, 0 as m from c union all select image, len(t), 0, 1, 0 from r union all select image, len(t), 0, 0, 1 from x"
query("spice", f"with {_SCENES}, {_MEANS.format(scores=_SPICE.format(rows=_SIDES3), u='size', rows=_SIZED)} select round(avg(spice), 6) as spice, round(avg(coalesce(\"precision\", 0)), 6) as \"precision\", round(avg(coalesce(recall, 0)), 6) as recall, (select round(f, 6) from f where n = 1) as object, (select round(f, 6) from f where n = 2) as attribute, (select round(f, 6) from f where n = 3) as relation from z")(lambda s, d: spice.scene_summary(_scenes(s, d)))
