"""SQL for the registered queries that SQL can express over whole tables."""

from __future__ import annotations

from quire.llm.quality_rules import CELLS, PRIOR, RATES, VALLEY

WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mixed(name: str, keys: list[str], parent: str, on: str) -> str:
    """CTE `name`: keys, rate, bin, p of each group's cumulative shares mixed with its parent's."""
    own = " and ".join(f"s.{k} is not distinct from g.{k}" for k in keys)
    by = ", ".join(f"g.{k}" for k in keys)
    return f"""g_{name} as (select {', '.join(f'k.{x}' for x in keys)}, o.rate, o.bin, o.p from (select distinct {', '.join(keys)} from c) k join {parent} o on {on}),
 s_{name} as (select {', '.join(keys)}, rate, bin, sum(n) n from c group by all),
 {name} as (select {by}, g.rate, g.bin, (sum(coalesce(s.n, 0)) over (partition by {by}, g.rate order by g.bin) + {PRIOR}::double * g.p) / (sum(coalesce(s.n, 0)) over (partition by {by}, g.rate) + {PRIOR}::double) p
  from g_{name} g left join s_{name} s on {own} and s.rate = g.rate and s.bin = g.bin)"""


_LEVEL = "case rate " + " ".join(f"when {k} then {r.level}::double" for k, r in enumerate(RATES)) + " end"
_REACH = "case rate " + " ".join(f"when {k} then {r.reach}" for k, r in enumerate(RATES)) + " end"
_AHEAD = "case rate " + " ".join(f"when {k} then max(p) over (partition by lang, rate order by bin range between current row and {r.gap} following)" for k, r in enumerate(RATES)) + " end"
_LIMITS = ", ".join(f"max(case when mid <= most then least(own, most) else own end) filter (where rate = {k}) l{k}" for k in range(len(RATES)))

QUALITY_RULES = f"""with d as (select row_number() over () k, doc_id, lang, source, coalesce(text, '') as t from documents),
 a as (select *, regexp_extract_all(t, '{WORD}') w from d),
 tri as (select k, unnest(range(len(w) - 2)) p, unnest([w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(len(w) - 2)]) g from a where len(w) > 2),
 often as (select k, p from tri qualify count(*) over (partition by k, g) > 1),
 rep as (select k, sum(n) n_repeat_words from (select k, least(3, coalesce(lead(p) over (partition by k order by p) - p, 3)) n from often) group by k),
 li as (select k, unnest(string_split(t, chr(10))) l from d),
 ln as (select k, count(*) n_lines, count(*) - count(distinct l) n_dup_lines from li where regexp_matches(l, '{WORD}') group by k),
 f as (select a.k, doc_id, lang, source, len(w)::bigint n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(n_lines, 0)::bigint n_lines, coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words from a left join rep using (k) left join ln using (k)),
 m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, 1000 * n_symbols // greatest(word_chars, 1) r0, 1000 * n_repeat_words // greatest(n_words, 1) r1, 1000 * n_dup_lines // greatest(n_lines, 1) r2 from f),
 x as (select lang, source, unnest([0, 1, 2]) rate, unnest([r0, r1, r2]) bin from m where not base_failed),
 c as (select lang, source, rate, bin, count(*) n from x group by all),
 ca as (select rate, bin, sum(sum(n)) over (partition by rate order by bin) / sum(sum(n)) over (partition by rate) p from c group by rate, bin),
 {_mixed('cl', ['lang'], 'ca', 'true')},
 va as (select *, {_AHEAD} ahead, min(bin) filter (where p >= 0.5::double) over (partition by lang, rate) mid from cl),
 vl as (select lang, rate, min(bin) filter (where bin >= mid and ahead - p < {VALLEY}::double) most from va group by all),
 gs as (select k.lang, k.source, o.rate, o.bin, o.p from (select distinct lang, source from c) k join cl o on o.lang is not distinct from k.lang),
 cs as (select g.lang, g.source, g.rate, g.bin, g.p, sum(coalesce(s.n, 0)) over (partition by g.lang, g.source, g.rate order by g.bin) below, sum(coalesce(s.n, 0)) over (partition by g.lang, g.source, g.rate) total
  from gs g left join c s on s.lang is not distinct from g.lang and s.source is not distinct from g.source and s.rate = g.rate and s.bin = g.bin),
 q as (select lang, source, rate, min(bin) filter (where p >= ({_LEVEL} * (total + {PRIOR}::double) - below) / {PRIOR}::double) hi, min(bin) filter (where p >= (0.5::double * (total + {PRIOR}::double) - below) / {PRIOR}::double) mid from cs group by all),
 ql as (select q.*, least({CELLS}, hi + ({_REACH.replace('rate', 'q.rate')}) * (hi - mid)) own, most from q join vl on vl.lang is not distinct from q.lang and vl.rate = q.rate),
 lim as (select lang, source, {_LIMITS} from ql group by all)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and r0 <= l0 and r1 <= l1 and r2 <= l2, false) kept, l0 most_symbol_rate, l1 most_repeat_rate, l2 most_dup_line_rate
 from m left join lim on lim.lang is not distinct from m.lang and lim.source is not distinct from m.source"""

SHARDING = """with recursive b0(j, k, c) as (select j, 0, j from range(256) x(j) union all select j, k + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from b0 where k < 8),
 tb as (select list(c order by j) t from b0 where k = 8),
 d as (select row_number() over () k, doc_id, coalesce(text, '') as text from documents),
 bt as (select k, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) l from d where text <> ''),
 cr as (select k, xor(list_reduce(l, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) crc from bt, tb),
 r as (select doc_id, strlen(text) + 1 size, coalesce(crc, 0) text_crc32, ('0x' || substr(md5(text), 1, 15))::bigint h, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint idh from d left join cr using (k)),
 c as (select *, row_number() over (partition by doc_id, size, text_crc32, h) - 1 copy from r),
 tot as (select sum(size) total from c),
 sl as (select h % 4096 s, sum(size) * 128 > any_value(total) heavy from c, tot group by 1),
 gr as (select h, case when sum(size) * 16 <= any_value(total) then 1 else (sum(size) * 128 + any_value(total) - 1) // any_value(total) end pieces from c, tot where h % 4096 in (select s from sl where heavy) group by h having sum(size) * 128 > any_value(total)),
 gs as (select h, pieces, 4096 + coalesce(sum(pieces) over (order by h rows between unbounded preceding and 1 preceding), 0) f from gr),
 v as (select c.*, case when pieces is null then c.h % 4096 else f + (idh + copy) % pieces end::bigint vs from c left join gs using (h)),
 sz as (select vs, sum(size)::bigint n, row_number() over (order by sum(size) desc, vs) i from v group by vs),
 lpt(i, vs, shard, loads) as (select 0::bigint, -1::bigint, -1::bigint, [0::bigint for x in range(16)] union all
  select sz.i, sz.vs, (list_position(loads, list_min(loads)) - 1)::bigint, list_transform(loads, lambda x, j: case when j = list_position(loads, list_min(loads)) then x + sz.n else x end) from lpt join sz on sz.i = lpt.i + 1),
 p as (select v.*, lpt.shard, (idh + h + copy) % greatest(1, ((select count(*) from c) + 1048575) // 1048576) bin from v join lpt using (vs))
 select doc_id, size, text_crc32, 'bytes' law, shard::int shard, row_number() over (partition by shard order by bin, doc_id nulls first, size, h, copy) - 1 slot, null::int grown_shard, vs::int virtual_slot from p"""

SUBSTRING_DEDUP = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
 x as (select doc_id, unnest(range(len(w))) p, unnest(w) word from d),
 s as (select doc_id, unnest(range(len(w) - 19)) p, unnest([array_to_string(w[i + 1:i + 20], ' ') for i in range(len(w) - 19)]) g from d where len(w) >= 20),
 late as (select doc_id, p from s qualify row_number() over (partition by g order by doc_id, p) > 1),
 m as (select x.doc_id, x.p, word, coalesce(x.p - l.p < 20, false) gone from x asof left join late l on x.doc_id = l.doc_id and x.p >= l.p),
 k as (select doc_id, count(*) filter (where gone) n_removed, string_agg(word, ' ' order by p) filter (where not gone) kept from m group by doc_id)
 select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)"""

DECONTAMINATE = f"""with i as (select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ITEM_WORD}') w from benchmark),
 iw as (select distinct item_id, n, unnest([array_to_string(w[j + 1:j + n], ' ') for j in range(len(w) - n + 1)]) g from (select *, least(10, len(w)) n from i) where n > 0),
 d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ITEM_WORD}') w from documents),
 dw as (select doc_id, n, unnest(range(len(w) - n + 1)) p, unnest([array_to_string(w[j + 1:j + n], ' ') for j in range(len(w) - n + 1)]) g from d, (select distinct n from iw) where len(w) >= n),
 h as (select doc_id, p, p + n e, item_id from dw join iw using (n, g)),
 c as (select doc_id, greatest(0, e - greatest(p, coalesce(max(e) over (partition by doc_id order by p, e rows between unbounded preceding and 1 preceding), 0))) n from (select distinct doc_id, p, e from h)),
 hit as (select doc_id, sum(n) n_hit from c group by doc_id),
 it as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from h) group by doc_id)
 select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join hit using (doc_id) left join it using (doc_id)"""

SUFFIX_DEDUP = """with d as (select doc_id, encode(coalesce(text, '')) b from documents),
 s as (select doc_id, unnest(range(octet_length(b) - 49)) p, unnest([b[i + 1:i + 50] for i in range(octet_length(b) - 49)]) g from d where octet_length(b) >= 50),
 late as (select doc_id, p from s qualify min(doc_id) over (partition by g) < doc_id),
 n as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end new from late),
 r as (select *, sum(new) over (partition by doc_id order by p) span from n),
 sp as (select doc_id, span, min(p) a, max(p) + 50 e from r group by doc_id, span),
 e as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) last from sp),
 k as (select e.doc_id, count(*) n_spans, sum(e - a)::bigint n_removed, string_agg(hex(b[last + 1:a]), '' order by a) kept, max(e) last from e join d using (doc_id) group by e.doc_id)
 select d.doc_id, octet_length(b) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:]))) kept_sha256 from d left join k using (doc_id)"""

JACCARD_JOIN = f"""with recursive d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') w from documents),
 s as (select doc_id, unnest(list_distinct([array_to_string(w[i + 1:i + 5], ' ') for i in range(greatest(1, len(w) - 4))])) g from d where len(w) > 0),
 n as (select doc_id, count(*) n from s group by doc_id),
 i as (select a.doc_id a, b.doc_id b, count(*) common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
 e as (select a, b from l union all select b, a from l),
 r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
 select d.doc_id, coalesce(n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id from d left join n using (doc_id) left join (select a doc_id, min(b) m from r group by a) using (doc_id)"""

ORACLE_SQL = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_decontaminate": DECONTAMINATE,
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op6_jaccard_join": JACCARD_JOIN,
    "op9_sharding": SHARDING,
    "op10_quality_rules": QUALITY_RULES,
}
