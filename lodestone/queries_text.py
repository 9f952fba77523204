"""SQL of text metrics over whole pairs of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import perturb, self_bleu, structured
from lodestone.plans.patterns import spread
from lodestone.queries import _OUTPUTS, _PAIRS_DUCK, ORACLE, _outputs, query


def _ruled(text: str) -> str:
    """The 13a rules in SQL."""
    out = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for name, sign in self_bleu.REFERENCES_13A:
        out = f"replace({out}, '{name}', '{sign}')"
    out = f"' ' || {out} || ' '"
    for rule, to in self_bleu.RULES_13A:
        out = f"regexp_replace({out}, '{rule}', '{to.replace('$', chr(92))}', 'g')"
    return rf"list_filter(string_split_regex({out}, '\s+'), lambda x: x <> '')"


def _grams(side: str, orders: range) -> str:
    one = "select k, {n} as n, unnest(list_transform(range(1, len({s}) - {b}), lambda i: array_to_string({s}[i:i + {a}], chr(1)))) as g, {r} as r, {p} as p from w"
    return " union all ".join(one.format(n=n, s=side, a=n - 1, b=n - 2, r=int(side == "r"), p=int(side == "p")) for n in orders)


_COUNTS = f"grams as ({_grams('r', range(1, 5))} union all {_grams('p', range(1, 5))}), c as (select k, n, g, sum(r) as r, sum(p) as p from grams group by all)"
_BLEU = f"with {_PAIRS_DUCK}, w as (select doc_id as k, {_ruled(chr(34) + 'a' + chr(34))} as r, {_ruled(chr(34) + 'b' + chr(34))} as p from (select doc_id, array_to_string(r, ' ') as a, array_to_string(p, ' ') as b from pr)), {_COUNTS}, h as (select k, n, sum(least(r, p)) as h from c group by k, n), t as (select w.k, n.n, len(w.p) as l, len(w.r) as o, greatest(len(w.p) - n.n + 1, 0) as t, coalesce(h.h, 0) as h from w, (values (1), (2), (3), (4)) n(n) left join h on h.k = w.k and h.n = n.n)"
_SCORE = "x as (select *, sum(cast(t > 0 and h = 0 as int)) over (partition by k order by n) as z from {t}), y as (select k, min(l) as l, min(o) as o, max(h) as h, sum(case when t = 0 then 0e0 when h > 0 then ln(h * 1e0 / t) else -ln(power(2e0, z) * t) end) as s, sum(cast(t > 0 as int)) as u from x group by k), s as (select k, case when h > 0 then 100 * case when l >= o then 1 else exp(1 - o * 1e0 / l) end * exp(s / u) else 0e0 end as v from y)"
ORACLE["sentence_bleu"] = f"{_BLEU}, {_SCORE.format(t='t')} select k as doc_id, round(v, 6) as sentence_bleu from s"
ORACLE["bleu"] = f"{_BLEU}, all_ as (select 0 as k, n, sum(l) as l, sum(o) as o, sum(t) as t, sum(h) as h from t group by n), {_SCORE.format(t='all_')} select round(v, 6) as bleu from s"

_LOWER = "list_transform({x}, lambda v: lower(v))"
ORACLE["cider"] = f"with {_PAIRS_DUCK}, w as (select doc_id as k, {_LOWER.format(x='r')} as r, {_LOWER.format(x='p')} as p from pr), {_COUNTS}, d as (select n, g, ln((select count(*) from w)) - ln(count(*)) as idf from c where r > 0 group by n, g), v as (select c.k, c.n, c.r * coalesce(d.idf, ln((select count(*) from w))) as wr, c.p * coalesce(d.idf, ln((select count(*) from w))) as wp from c left join d on d.n = c.n and d.g = c.g), s as (select k, n, sum(least(wp, wr) * wr) as dot, sqrt(sum(wr * wr) * sum(wp * wp)) as norm from v group by k, n), e as (select k, sum(case when norm > 0 then dot / norm else 0 end) as s from s group by k) select w.k as doc_id, round(10 * s / 4 * exp(-power(len(w.p) - len(w.r), 2) / 72e0), 6) as cider from w join e using (k)"

_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 79, "multipleOf": 3}}, "additionalProperties": False}
_K = "cast(json_extract_string(output, '$.k') as bigint)"
query("json_schema_fields", f"select round(avg(cast(case when json_valid(output) then {_K} between 10 and 79 and {_K} % 3 = 0 else false end as int) * 1e0), 6) as json_schema_compliance from ({_OUTPUTS})")(lambda s, d: _outputs(s, d).agg(F.avg(structured.schema_error(F.col("output"), _SCHEMA).isNull().cast("double")).alias("json_schema_compliance")))
# every output is a JSON object, or one without its last brace, in which no object or array is whole
ORACLE["extra_content_rate"] = f"select round(avg(cast(not json_valid(output) and regexp_matches(output, '\\{{[^{{}}]*\\}}|\\[[^\\[\\]]*\\]') as int) * 1e0), 6) as extra_content_rate from ({_OUTPUTS})"


_CHARS = "d as (select doc_id, text, i, substring(text, i + 1, 1) as c, md5('7:' || doc_id || ':' || i) as h from (select doc_id, text, unnest(range(length(text))) as i from documents where text is not null)), o as (select doc_id, i, c, case when regexp_matches(c, '^\\p{L}$') and ('0x' || substr(h, 1, 8))::bigint < 214748364 then ('0x' || substr(h, 9, 8))::bigint % 4 else 4 end as op, chr((97 + ('0x' || substr(h, 17, 8))::bigint % 26)::int) as n from d), a as (select *, lead(c) over w as nc, coalesce(lag(op) over w, 4) as p, coalesce(lag(op, 2) over w, 4) as q from o window w as (partition by doc_id order by i)), e as (select doc_id, i, case when p = 0 and q <> 0 then '' when op = 0 and p <> 0 and nc is not null then nc || c when op = 1 then '' when op = 2 then c || n when op = 3 then n else c end as t from a)"
query("add_typos", f"with {_CHARS} select d.doc_id, case when d.text is not null then md5(coalesce(string_agg(e.t, '' order by e.i), '')) end as noisy_md5 from documents d left join e on e.doc_id = d.doc_id group by d.doc_id, d.text")(lambda s, d: spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", F.md5(perturb.typos(F.col("text"), F.col("doc_id"), seed=7)).alias("noisy_md5")))
