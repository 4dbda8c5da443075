"""Registered queries of this package and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontam import op8_decontaminate
from .embeddings import op10_embedding_dedup
from .html_extract import op3_html_extract
from .licenses import op4_license_scan
from .mixing import op1_mix
from .quality import op5_quality
from .sharding import op9_shard
from .simhash import op2_simhash
from .toxicity import op6_toxicity
from .url_filter import OWN, RULES, op7_url_filter

QUERIES = {
    "op1_mix": op1_mix,
    "op2_simhash": op2_simhash,
    "op3_html_extract": op3_html_extract,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_shard": op9_shard,
    "op10_embedding_dedup": op10_embedding_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}')" for r in RULES)
_OWN = " or ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in OWN)

ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": f"""
with p as (select page_id, row_number() over () as rid, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as a from pages),
q as (select page_id, rid, coalesce(translate(regexp_extract(a, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') as host, coalesce(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), '') as path from p),
r(h, s, rule, verdict) as (values {_RULES}),
m as (select rid, rule, verdict, row_number() over (partition by rid order by length(rule) desc) as k from q join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s))
select page_id, host, path, rule, coalesce(verdict, case when {_OWN} then 'block' else 'allow' end) as verdict from q left join (select * from m where k = 1) using (rid)""",
    "op10_embedding_dedup": """
with recursive e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
ok as (select * from e where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select vec_id as a, vec_id as b from e union select r.a, l.b from reach r join l on l.a = r.b),
c as (select a, min(b) as component_id from reach group by 1), n as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from e join c on c.a = vec_id left join n on n.a = vec_id""",
}
