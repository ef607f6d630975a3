"""The registered queries as DuckDB SQL, put together from named table expressions."""

from __future__ import annotations

from .facts import BLOCK, SIDES


def _facts(side: str, top: str) -> str:
    """The tables of one side of a diff, each name led by the side's letter."""
    s, (status, fields) = side[0], SIDES[side]
    to = f"""case when o_orderpriority = '1-URGENT' and o_orderstatus = '{status}' then greatest(0, c_custkey % {BLOCK} - o_orderkey % 3 - 1) else least({BLOCK - 1}, c_custkey % {BLOCK} + o_orderkey % 3 + 1) end"""
    return f"""{s}_cust as (select {top} || '/' || c_name as module, lower(c_name) as name, c_custkey from customer join nation on c_nationkey = n_nationkey),
{s}_ord as (select * from {s}_cust join orders on c_custkey = o_custkey),
{s}_edges as (select distinct o.module as src, d.module as dst from (select module, c_custkey - c_custkey % {BLOCK} + {to} as key from {s}_ord) o join {s}_cust d on d.c_custkey = key where o.module <> d.module),
{s}_imports as (select src as module, dst as target from {s}_edges union all select distinct module, 'lib/' || o_orderpriority from {s}_ord),
{s}_types as (select module, count(*) filter (where o_totalprice >= 100000) as exported_types, count(*) filter (where o_totalprice >= 100000 and o_orderpriority = '1-URGENT') as abstract_types from {s}_ord group by 1),
{s}_lines as (select module, cast(sum(n) as bigint) as total_lines from {s}_ord join (select l_orderkey, sum(cast(floor(l_quantity) as bigint)) as n from lineitem group by 1) on l_orderkey = o_orderkey group by 1),
{s}_mf as (select module as scope, o_orderkey as method, field from {s}_cust left join orders on o_custkey = c_custkey left join (select distinct l_orderkey, l_partkey % {fields} as field from lineitem) on l_orderkey = o_orderkey)"""


def _coupling(s: str) -> str:
    return f"""select p.module, coalesce(a.n, 0) as ca, coalesce(e.n, 0) as ce from {s}_cust p left join (select target as module, count(distinct module) as n from {s}_imports group by 1) a using (module)
  left join (select module, count(distinct target) as n from {s}_imports group by 1) e using (module)"""


def _lcom(s: str) -> str:
    """Components by recursive reachability between methods that share a field."""
    return f"""{s}_pair as (select distinct a.scope, a.method as x, b.method as y from {s}_mf a join {s}_mf b on a.scope = b.scope and a.field = b.field),
{s}_walk as (select scope, method as x, method as y from {s}_mf where method is not null union select w.scope, w.x, e.y from {s}_walk w join {s}_pair e on e.scope = w.scope and e.x = w.y),
{s}_lcom as (select c.module, count(distinct root) as lcom from {s}_cust c left join (select scope, x, min(y) as root from {s}_walk group by 1, 2) on scope = module group by 1)"""


ZONE = "case when distance < 0.2::double then 'main-sequence' when abstractness < 0.2::double and instability < 0.2::double then 'zone-of-pain' when abstractness > 0.8::double and instability > 0.8::double then 'zone-of-uselessness' else 'normal' end"


def _modules(s: str) -> str:
    return f"""{s}_raw as (select c.*, coalesce(t.exported_types, 0) as exported_types, coalesce(t.abstract_types, 0) as abstract_types, l.lcom, coalesce(n.total_lines, 0) as total_lines
    from ({_coupling(s)}) c left join {s}_types t using (module) left join {s}_lcom l using (module) left join {s}_lines n using (module)),
{s}_ratios as (select *, case when ca + ce = 0 then 0.0::double else ce::double / (ca + ce) end as instability, case when exported_types = 0 then 0.0::double else abstract_types::double / exported_types end as abstractness from {s}_raw),
{s}_dist as (select *, abs(abstractness + instability - 1.0::double) as distance from {s}_ratios),
{s}_modules as (select *, {ZONE} as zone from {s}_dist)"""


FACTS = "with recursive " + _facts("base", "n_name")
LCOM = FACTS + ",\n" + _lcom("b")
MODULES = LCOM + ",\n" + _modules("b")
DIFF = ",\n".join([MODULES, _facts("change", "case when n_nationkey = 0 then 'MOVED' else n_name end"), _lcom("c"), _modules("c")])


def _reach(s: str) -> str:
    return f"""{s}_r as (select src, dst from {s}_edges union select r.src, e.dst from {s}_r r join {s}_edges e on e.src = r.dst),
{s}_scc as (select x.src as node, min(least(x.src, x.dst)) as root from {s}_r x join {s}_r y on x.src = y.dst and x.dst = y.src group by 1),
{s}_big as (select node, root from {s}_scc where root in (select root from {s}_scc group by 1 having count(*) > 1)),
{s}_cycles as (select root, string_agg(node, ' ' order by node) as members, count(*) as n from {s}_big group by 1)"""


EDGES, EDGES2 = _reach("b"), _reach("c")
DELTA = """delta as (select coalesce(b.module, c.module) as module, case when b.module is null then 'added' when c.module is null then 'removed' else 'both' end as state,
  c.ca - b.ca as d_ca, c.ce - b.ce as d_ce, round((c.instability - b.instability) * 1e4) / 1e4 + 0.0::double as d_instability, round((c.abstractness - b.abstractness) * 1e4) / 1e4 + 0.0::double as d_abstractness,
  round((c.distance - b.distance) * 1e4) / 1e4 + 0.0::double as d_distance, c.lcom - b.lcom as d_lcom from b_modules b full outer join c_modules c on b.module = c.module),
cyc as (select members, case when members in (select members from b_cycles) then 'resolved' else 'new' end as state from
  (select members from c_cycles where members not in (select members from b_cycles) union all select members from b_cycles where members not in (select members from c_cycles))),
why as (select 0::bigint as kind_rank, members as subject, 0::bigint as metric_rank, 'new-cycle' as metric, null::double as value from cyc where state = 'new'
  union all select 1, module, 0, 'instability', d_instability from delta where state = 'both' and d_instability >= 0.15::double
  union all select 1, module, 1, 'distance', d_distance from delta where state = 'both' and d_distance >= 0.2::double
  union all select 1, module, 2, 'lcom', d_lcom::double from delta where state = 'both' and d_lcom >= 2)"""
ALL_DIFF = f"{DIFF},\n{EDGES},\n{EDGES2},\n{DELTA}"

BLOCKS = r"""lines as (select doc_id as file, lang as module, text, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) not in ('', '{', '}'))) as sig_lines,
    len(string_split(text, chr(10))) as "end", regexp_replace(regexp_replace(text, '[0-9]+', '_lit', 'g'), '\p{L}+', '_id', 'g') as norm_body from documents),
big as (select *, count(*) over (partition by module, norm_body) as n_blocks, 1::bigint as start from lines where sig_lines >= 6),
listed as (select module, 'd' || substr(sha256(norm_body), 1, 2) as file, start, "end", sig_lines as line_count, round(1.0::double - 1.0::double / (n_blocks + 1), 4) as similarity, file as idx from big where n_blocks > 1),
block_modules as (select module, cast(sum(sig_lines) as bigint) as total_lines from lines group by 1)"""
COVERAGE = """cov as (select p_brand as package, cast(sum(case when l_returnflag <> 'R' then cast(l_quantity as bigint) else 0 end) as bigint) as covered, cast(sum(cast(l_quantity as bigint)) as bigint) as total
  from lineitem join part on l_partkey = p_partkey group by 1 having sum(cast(l_quantity as bigint)) > 0),
measured as (select *, (covered * 1000 // total) / 10.0::double as percent from cov),
floors as (select distinct case when p_brand = 'Brand#1' then 'Brand#99' else p_brand end as package, 66.5::double as floor from part),
eval as (select coalesce(m.package, f.package) as package, percent, floor, case when percent is null then 'stale-floor' when floor is null then 'unregistered' when percent < floor then 'below-floor' else 'pass' end as status
  from measured m full outer join floors f on m.package = f.package),
upd as (select package, percent, case when status = 'unregistered' then case when percent >= 80 then percent end when status = 'pass' then greatest(percent, floor) else floor end as floor,
  case when status = 'unregistered' then case when percent < 80 then 'refused' else 'added' end when status <> 'pass' then status when percent > floor then 'raised' else 'unchanged' end as status from eval)"""
SERIES = """day as (select event_type as package, cast(ts as date) as day, sum(value) as v, count(*) as n from events group by 1, 2),
share as (select *, cast(sum(n) over (partition by package order by day) as bigint)::double / sum(n) over (partition by package) as s from day),
series as (select package, 'instability' as metric, day, round(v / n / 200, 6) as value from share union all select package, 'distance', day, round(s / 2, 6) from share union all select package, 'lcom', day, cast(row_number() over (partition by package order by day) as double) from share)"""


def _fit(days: int) -> str:
    return f"""f{days}a as (select s.*, max(day) over (partition by package, metric) as last from series s),
f{days}b as (select *, cast(date_diff('day', min(day) over (partition by package, metric), day) as double) as x, cast(value as decimal(18, 6)) as y from f{days}a where date_diff('day', day, last) < {days}),
f{days}c as (select package, metric, count(*) as n, sum(x) as sx, sum(x * x) as sxx, cast(sum(y) as double) as sy, cast(sum(y * y) as double) as syy, cast(sum(cast(x as decimal(9, 0)) * y) as double) as sxy, cast(arg_max(y, day) as double) as current from f{days}b group by 1, 2),
f{days}d as (select *, n * sxx - sx * sx as vx, case when abs(n * syy - sy * sy) < 1e-9 then 0.0 else n * syy - sy * sy end as vy, n * sxy - sx * sy as c from f{days}c),
f{days}e as (select *, case when n >= 3 and vx > 0 then c / nullif(vx, 0) end as slope, case when n >= 3 and vx > 0 then coalesce(c * c / nullif(vx * vy, 0), 0.0) end as r2 from f{days}d),
fit{days} as (select package, metric, {days}::bigint as days, n, current, slope, (sy - slope * sx) / n as intercept, r2,
  case when n < 3 or slope is null then 'insufficient-data' when r2 < 0.5 or abs(slope) < case metric when 'lcom' then 0.5 else 0.01 end then 'stable' when slope > 0 then 'degrading' else 'improving' end as trend from f{days}e)"""


FITS = f"with {SERIES},\n" + ",\n".join(map(_fit, (7, 30, 90))) + ",\nfits as (select * from fit7 union all select * from fit30 union all select * from fit90)"
FIT_COLUMNS = "package, metric, days, n, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, round(current, 6) as current, trend"

GRADES = """round(mean_instability, 6) as mean_instability, round(mean_distance, 6) as mean_distance, max_lcom, spread, n_modules, n_cycles, round(dup_percent, 6) as dup_percent, total_lines,
case when mean_distance >= 0.7 then 'F' when mean_distance >= 0.5 then 'C' when mean_distance >= 0.3 then 'C+' when mean_distance >= 0.2 then 'B' when mean_distance >= 0.1 then 'B+' else 'A' end as g_distance,
case when max_lcom >= 6 then 'F' when max_lcom >= 5 then 'C' when max_lcom >= 4 then 'C+' when max_lcom >= 3 then 'B' when max_lcom >= 2 then 'B+' else 'A' end as g_lcom,
case when n_cycles = 0 then 'A' else 'F' end as g_cycles,
case when dup_percent >= 15 then 'F' when dup_percent >= 10 then 'C' when dup_percent >= 5 then 'C+' when dup_percent >= 3 then 'B' when dup_percent > 0 then 'B+' else 'A' end as g_duplication,
case when spread <= 0 then 'A' when spread = 1 then 'B' when spread = 2 then 'C+' else 'F' end as g_spread"""
AGG = """agg as (select (select coalesce(avg(instability), 0) from b_modules) as mean_instability, (select coalesce(avg(distance), 0) from b_modules) as mean_distance, (select max(lcom) from b_modules) as max_lcom,
  (select count(*) from b_modules where instability <= 0.001 or instability >= 0.999) as spread, (select count(*) from b_modules) as n_modules, (select count(*) from b_cycles) as n_cycles,
  (select cast(sum(lc) as bigint) * 100.0::double / (select sum(total_lines) from b_modules) from (select max(line_count) as lc from listed group by file, start, "end")) as dup_percent, (select cast(sum(total_lines) as bigint) from b_modules) as total_lines)"""
HITS = """dupf as (select count(*) as n_blocks, (select string_agg('`' || file || '`', ', ' order by file) from (select distinct file from listed)) as files, (select max(similarity) from listed) as similarity from (select distinct file, start, "end" from listed)),
part_ as (select node as path, 1::double as n, '`' || replace(members, ' ', '`, `') || '`' as rep from b_big join b_cycles using (root)),
hits as (select 'red' as severity, 'lcom4-split' as rule, module as module_path, (lcom - 4)::double as extremity, lcom::double as value, '' as note from b_modules where lcom >= 4
  union all select 'red', 'distance-refactor', module, distance - 0.5::double, distance, zone from b_modules where distance >= 0.5::double
  union all select 'red', 'cycle-break', path, n, n, rep from part_
  union all select 'yellow', 'instability-isolate', module, instability - 0.95::double, instability, '' from b_modules where instability >= 0.95::double
  union all select 'yellow', 'instability-protect', module, 0.05::double - instability, instability, '' from b_modules where instability <= 0.05::double
  union all select 'yellow', 'ce-decouple', module, (ce - 20)::double, ce::double, '' from b_modules where ce > 20
  union all select 'yellow', 'abstractness-interfaces', module, (exported_types - 10)::double, exported_types::double, '' from b_modules where abstractness = 0 and exported_types > 10
  union all select 'red', 'duplication-eliminate', '', dup_percent - 5, n_blocks::double, similarity || '|' || files from agg, dupf where dup_percent >= 5
  union all select 'green', 'duplication-watch', '', dup_percent, n_blocks::double, similarity || '|' || files from agg, dupf where dup_percent > 0 and dup_percent < 5)"""
REPORT = f"{MODULES},\n{EDGES},\n{BLOCKS},\n{AGG},\n{HITS}"
HIT_COLUMNS = "severity, rule, module_path, round(extremity, 6) as extremity, round(value, 6) as value, note"

#: Documents as files, as facts.files() has them.
FILES = """files as (select case when doc_id % 10 = 3 then coalesce(source, 'none') || '/testdata' else coalesce(source, 'none') end as dir, doc_id, lang, text, case when doc_id % 7 = 0 then 'denied' end as error,
      case when lang = 'en' then '.py' when lang = 'de' then '.ts' when doc_id % 2 = 0 then '.gen.go' else '.go' end as ext from documents), f as (select *, dir || '/f' || doc_id || ext as path from files)"""
SQL = {
    "m1_module_metrics": f"{MODULES} select * from b_modules",
    "a1_a2_coupling": f"{FACTS} {_coupling('b')}",
    "j3_internal_edges": f"{FACTS} select src as module, dst as target from b_edges",
    "a23_edge_counters": f"""{FACTS} select p.module, (select count(*) from b_edges where src = p.module) as internal_out, (select count(*) from b_edges where dst = p.module) as internal_in,
      (select count(*) from b_imports i where i.module = p.module and i.target like 'lib/%') as external_out from b_cust p""",
    "a4_type_counts": "select p_brand as module, count(*) filter (where p_size > 2) as exported_types, count(*) filter (where p_size > 2 and p_size > 5 and p_type = 'ECONOMY') as abstract_types from part group by 1",
    "a6_cohesion": f"{LCOM} select module as scope, lcom from b_lcom",
    "a8_cycles": f"{FACTS}, {EDGES} select members, n from b_cycles",
    "a8_strong_components": f"{FACTS}, {EDGES} select node, root from b_big",
    "a16_participation": f"{FACTS}, {EDGES} select node as path, 1::bigint as n_cycles, members as representative from b_big join b_cycles using (root)",
    "a12_a13_aggregates": f"{REPORT} select {GRADES} from agg",
    "a20_graph_stats": f"{MODULES} select count(*) as n_modules, cast(sum(total_lines) as bigint) as total_lines from b_modules",
    "a22_extremes": f"""{MODULES} select (select module from b_modules order by ca desc, module limit 1) as most_ca, (select module from b_modules order by ce desc, module limit 1) as most_ce,
      (select module from b_modules order by lcom, module limit 1) as least_lcom, (select module from b_modules order by lcom desc, module limit 1) as most_lcom,
      count(*) filter (where ce = 0) as leaves, count(*) filter (where ca > 10) as heavy, count(*) filter (where lcom >= 4) as review from b_modules""",
    "j1_module_delta": f"{ALL_DIFF} select * from delta",
    "j2_cycle_delta": f"{ALL_DIFF} select members, state from cyc",
    "a21_direction": f"""{ALL_DIFF} select case when (select count(*) from cyc where state = 'new') > 0 or bool_or(d_instability >= 0.15 or d_distance >= 0.2 or d_lcom >= 2) then 'degrading'
      when (select count(*) from cyc where state = 'resolved') > 0 or bool_or(d_instability <= -0.15 or d_distance <= -0.2 or d_lcom <= -2) then 'improving' else 'stable' end as direction from delta where state = 'both'""",
    "o10_reasons": f"{ALL_DIFF} select * from why",
    "v3_verdict": f"""{ALL_DIFF} select case when (select count(*) from why) > 0 then 'REQUEST_CHANGES' when bool_or(d_instability > 0 or d_distance > 0 or d_lcom > 0) then 'COMMENT' else 'APPROVE' end as verdict,
      (select count(*) from why) as n_reasons from delta where state = 'both'""",
    "f1_violations": f"""{MODULES}, {EDGES}, v as (select module, 0::bigint as rank, 'instability' as metric, instability as value, 0.8::double as "limit" from b_modules union all select module, 1, 'distance', distance, 0.3 from b_modules
      union all select module, 2, 'lcom', lcom::double, 3.0 from b_modules) select module, rank, metric, round(value, 6) as value, "limit" from v where value > "limit"
      union all select '', 99, 'cycles', count(*)::double, 0.0 from b_cycles having count(*) > 0""",
    "v4_rule_hits": f"{REPORT} select {HIT_COLUMNS} from hits",
    "o9_recommendations": f"""{REPORT} select {HIT_COLUMNS} from (select * from hits order by case severity when 'red' then 0 when 'yellow' then 1 else 2 end, extremity desc, module_path, rule, note limit 5)""",
    "v5_report_model": f"""{REPORT}, g as (select {GRADES} from agg), r as (select list_max([list_position(['A','B+','B','C+','C','F'], x) for x in [g_distance, g_lcom, g_cycles, g_duplication, g_spread]]) as worst, g.* from g)
      select r.* exclude (worst), case when worst <= 2 then 'Healthy' when worst <= 4 then 'Mixed' else 'Needs Attention' end as overall, (select count(*) > 0 from hits where severity in ('red', 'yellow')) as has_violations from r""",
    "f4_significant_lines": f"with {BLOCKS} select module, total_lines from block_modules",
    "j4_duplicate_pairs": f"with {BLOCKS} select a.module, a.file as file_a, b.file as file_b, a.sig_lines as sig_lines_a, b.sig_lines as sig_lines_b from big a join big b on a.module = b.module and a.norm_body = b.norm_body and a.file < b.file",
    "j4_duplicate_classes": f"with {BLOCKS} select module, sha256(norm_body) as class, n_blocks, file, sig_lines from big where n_blocks > 1",
    "a10_module_duplication": f"""with {BLOCKS}, o as (select *, row_number() over (partition by module, file, start, "end" order by idx) as rn from listed), d as (select module, sum(line_count) as dup from o where rn = 1 group by 1)
      select m.module, round(coalesce(dup, 0) * 100.0::double / total_lines, 6) as dup_percent from block_modules m left join d using (module)""",
    "a11_overall_duplication": f"""with {BLOCKS} select cast(sum(lc) as bigint) as dup_lines, (select cast(sum(total_lines) as bigint) from block_modules) as total_lines, round(sum(lc) * 100.0::double / (select sum(total_lines) from block_modules), 6) as dup_percent
      from (select max(line_count) as lc from listed group by file, start, "end")""",
    "a14_duplication_facts": f"""with {BLOCKS} select module, count(distinct (file, start, "end")) as n_blocks, (select string_agg(f, ',' order by f) from (select distinct l2.file as f from listed l2 where l2.module = l.module)) as files, max(similarity) as similarity from listed l group by 1""",
    "a15_duplication_rows": f"""with {BLOCKS} select file, start, "end", max(line_count) as line_count, max(similarity) as similarity, count(*) as occurrences from listed group by 1, 2, 3""",
    "a17_coverage": f"with {COVERAGE} select package, covered, total, percent from measured",
    "v6_ratchet_evaluate": f"with {COVERAGE} select * from eval",
    "v7_ratchet_update": f"with {COVERAGE} select * from upd",
    "k8_next_floors": f"with {COVERAGE}, bad as (select bool_or(status in ('stale-floor', 'below-floor', 'refused')) as bad from upd) select package, floor from upd, bad where not bad and floor is not null union all select f.package, f.floor from floors f, bad where bad",
    "a18_status_counts": f"with {COVERAGE} select status, count(*) as n from eval group by 1",
    "t1_t2_trends": f"{FITS} select {FIT_COLUMNS} from fits",
    "t3_t5_crossings": f"{FITS}, x as (select *, (case metric when 'instability' then 0.75 when 'distance' then 0.7 else 5.0 end - current) / nullif(slope, 0) as d from fits where r2 >= 0.5) select package, metric, days, round(d, 6) as days_ahead from x where d > 0 and d <= 30",
    "t4_streaks": f"""with {SERIES}, u as (select *, row_number() over w as i, coalesce(round(value - lag(value) over w, 9) >= case metric when 'instability' then 0.05 when 'distance' then 0.1 else 1.0 end, false) as up from series window w as (partition by package, metric order by day))
      select package, metric, max(i) - coalesce(max(i) filter (where not up), 0) as streak from u group by 1, 2 having max(i) - coalesce(max(i) filter (where not up), 0) >= 1""",
    "t6_retained": """select event_id from events where date_diff('day', cast(ts as date), date '2024-06-20') <= 90 or (date_diff('day', cast(ts as date), date '2024-06-20') <= 365 and dayofweek(ts) = 0)""",
    "t9_baseline": f"""with {SERIES}, mx as (select max(day) as d from series), h as (select package, metric, arg_max(value, day) as was from series, mx where day < d group by 1, 2)
      select s.package, s.metric, value, was, case when was is null then 'new' when round(value - was, 6) > case s.metric when 'lcom' then 1.0 else 0.01 end then 'higher' when round(value - was, 6) < -case s.metric when 'lcom' then 1.0 else 0.01 end then 'lower' else 'equal' end as against
      from series s join mx on day = d left join h on h.package = s.package and h.metric = s.metric""",
    "j14_snapshot_dedup": "select distinct module_path, commit from (select event_type as module_path, cast(user_id as varchar) as commit, value from events) n where not exists (select 1 from (select event_type as mp, cast(user_id as varchar) as c from events where value > 190) s where s.mp = n.module_path and s.c = n.commit)",
    "j6_longest_prefix": r"""with u as (select page_id, string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') as seg from pages), mods as (select distinct seg[1] || '/' || seg[2] as m from u where len(seg) > 2 union select distinct seg[1] from u),
      x as (select page_id, i, array_to_string(seg[1:i], '/') as prefix from u, unnest(range(1, len(seg) + 1)) t(i))
      select u.page_id, (select arg_max(prefix, i) from x where x.page_id = u.page_id and prefix in (select m from mods)) as module from u""",
    "j12_implements": """with i as (select distinct p_type || '/' || p_name as iface, p_size as method from part), t as (select distinct p_brand as type, p_size as method from part),
      n as (select iface, count(*) as need from i group by 1), h as (select iface, type, count(*) as have from i join t using (method) group by 1, 2) select iface, type from h join n using (iface) where have = need""",
    "a19_interface_width": "select p_type as module, string_agg(iface || '=' || width, ',' order by iface) as widths from (select p_type, p_brand as iface, count(distinct p_size) as width from part group by 1, 2) group by 1",
    "u1_warning_union": f"""with {FILES} select 'parse-error' as code, path || ': ' || error as message, dir as module from f where error is not null
      union all select 'unsupported-metric', l || ' has no duplication', '' from (values ('python'), ('typescript')) t(l)""",
    "a5_python_type_counts": "select p_brand as module, count(*) filter (where p_size > 2) as exported_types, count(*) filter (where p_type = 'ECONOMY') as abstract_types from part group by 1",
    "a8_order_components": """with d as (select distinct l_orderkey as o, l_linenumber as n from lineitem), k as (select l_orderkey as o, max(l_linenumber) filter (where l_returnflag = 'R') as k, min(l_linenumber) as f from lineitem group by 1),
      x as (select o, n, f, count(*) over (partition by o) as c from d join k using (o) where n <= k) select o * 8 + n as node, o * 8 + f as root from x where c > 1""",
    "a9_lines_of_code": f"with {FILES} select dir as module, cast(sum(len(string_split(text, chr(10)))) as bigint) as total_lines from f where ext in ('.py', '.ts') group by 1",
    "f3_total_lines": f"""with {FILES} select lang as module, cast(sum(len([x for x in string_split(coalesce(text, ''), chr(10)) if trim(x) not in ('', '{{', '}}')])) as bigint) as total_lines
      from f where not (ext = '.gen.go' or dir like '%/testdata') group by 1""",
    "f6_exported_names": r"with p as (select p_partkey, case when p_size % 2 = 0 then '_' || p_name else p_name end as name from part) select p_partkey, regexp_matches(name, '^\p{Lu}') as go, not starts_with(name, '_') as python from p",
    "f7_last_of_path": "with o as (select o_custkey as module, max(o_orderkey) as k from orders group by 1) select module, k % 7 as ca, k % 5 as ce, (k % 4) / 4.0::double as instability, (k % 8) / 8.0::double as abstractness, (k % 16) / 16.0::double as distance, k % 3 as lcom from o",
    "j7_complete_join": "select p_brand, count(*) as n, cast(sum(cast(floor(l_quantity) as bigint)) as bigint) as quantity from lineitem join part on l_partkey = p_partkey group by 1",
    "j11_corroborated": """with s as (select l_orderkey, l_returnflag, string_agg(distinct p_brand, ' ' order by p_brand) as members from lineitem join part on l_partkey = p_partkey group by 1, 2)
      select members from s where l_returnflag = 'R' except select members from s where l_returnflag = 'A'""",
    "t4_streaks_of_five": """with d as (select distinct l_orderkey, l_linenumber as n from lineitem)
      select cast(l_orderkey as varchar) as package, 'instability' as metric, count(*) - 1 as streak from d group by 1, 2 having count(*) - 1 >= 5""",
    "t8_overall": f"""with {SERIES}, u as (select *, row_number() over w as i, coalesce(round(value - lag(value) over w, 9) >= case metric when 'instability' then 0.05 when 'distance' then 0.1 else 1.0 end, false) as up from series window w as (partition by package, metric order by day)),
      a as (select count(*) as n from (select 1 from u group by package, metric having max(i) - coalesce(max(i) filter (where not up), 0) >= 5)) select case when n > 0 then 'Degrading' end as overall from a""",
    "x6_proximity": """with i as (select distinct p_type as iface, p_size % 5 as method from part), t as (select distinct p_brand as type, p_size % 4 + length(p_brand) % 2 as method from part), n as (select iface, count(*) as need from i group by 1),
      h as (select iface, type, count(*) as have from i join t using (method) group by 1, 2), d as (select distinct iface from h join n using (iface) where have = need) select n.iface, case when d.iface is null then 'consumer' else 'producer' end as proximity from n left join d using (iface)""",
    "w5_sparklines": f"""with {SERIES}, l as (select package, metric, list(value order by day) as v from series group by 1, 2), s as (select package, metric, case when len(v) > 30 then [v[floor(i * len(v) / 30.0)::int + 1] for i in range(30)] else v end as v from l)
      select package, metric, array_to_string([case when list_max(v) - list_min(v) < 1e-10 then '▄' else substr('▁▂▃▄▅▆▇█', floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 7)::int + 1, 1) end for x in v], '') as sparkline from s""",
    "p1_p22_scalars": f"""with p as (select p_partkey, p_size - 1 as ca, p_size % 7 as ce, 'src/' || lower(p_type) || '/' || p_brand as path from part)
      select p_partkey, case when ca + ce = 0 then 0.0::double else ce::double / (ca + ce) end as instability, replace(path, '/', '.') as identity, p_partkey || case when p_partkey = 1 then ' part' else ' parts' end as counted, string_split(replace(path, '/', '.'), '.')[-1] as last_name,
      regexp_replace(path, '/[^/]*$', '') as directory, round(ce::double / 7 * 1e4) / 1e4 as round4 from p""",
}
