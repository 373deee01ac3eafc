"""DuckDB SQL of the registered queries, written apart from the plans and run on the same tables."""

from __future__ import annotations

import re

import numpy as np

from .. import config as C
from .fixtures import MANIFEST_SQL, REGISTRY_ROWS, RESPONSES_SQL


def lit(x: object) -> str:
    if x is None:
        return "null"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def lits(xs) -> str:
    return ", ".join(lit(x) for x in xs)


def array(xs) -> str:
    return f"([{lits(xs)}]::varchar[])"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    star = rf"regexp_replace(lower({strip(x)}), '^\*+|\*+$', '', 'g')"
    return strip(star)


def group1(x: str, pattern: str, flags: str = "") -> str:
    return f"nullif(regexp_extract({x}, {lit(flags + pattern)}, 1), '')"


def confidence(x: str) -> str:
    parts = []
    for p in C.CONFIDENCE_PATTERNS:
        v = f"try_cast({group1(x, p, '(?i)')} as int)"
        parts.append(f"case when {v} between 0 and 100 then {v} end")
    return f"coalesce({', '.join(parts)})"


def abstains(x: str) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {lit('(?i)' + p)})" for p in C.ABSTAIN_PATTERNS) + ")"


def known_answer(x: str, space: list[str]) -> str:
    if not space:
        return "null"
    table = [(a, c) for a, c in C.alias_table() if c in space]
    rules = [f"when {x} = {lit(s.lower())} then {lit(s)}" for s in space] + [f"when {x} = {lit(a)} then {lit(c)}" for a, c in table]
    rules += [f"when contains({x}, {lit(a)}) then {lit(c)}" for a, c in table] + [f"when contains({x}, {lit(s.lower())}) then {lit(s)}" for s in sorted(space, key=len, reverse=True)]
    return "case " + " ".join(rules) + " end"


def by_task(make) -> str:
    return "case task " + " ".join(f"when {lit(t)} then {make(s)}" for t, s in C.ANSWER_SPACES.items()) + " end"


def rotated(space: list[str]) -> str:
    if not space:
        return "[]::varchar[]"
    n = len(space)
    return f"list_concat({array(space)}[cast(ord % {n} as int) + 1 :], {array(space)}[1 : cast(ord % {n} as int)])"


MANIFEST = MANIFEST_SQL.format(events="events")
RESPONSES = f"select *, case when format = 'MC' then {by_task(rotated)} else []::varchar[] end as mc_options from ({RESPONSES_SQL.format(events='events', json='json_extract_string')}) r"


def letter(x: str, pattern: str, flags: str = "") -> str:
    i = f"ascii(upper({group1(x, pattern, flags)})) - 64"
    return f"case when {i} between 1 and len(mc_options) then mc_options[{i}] end"


PARSED = f"""
select *, case when abstained then 'UNSURE' else coalesce(pred, 'UNPARSEABLE') end as pred_answer, not abstained and pred is null as unparseable
from (select *, case when abstained or response = '' then null
    when format = 'MC' and len(mc_options) > 0 then coalesce({letter('stripped', C.ANSWER_LETTER, '(?i)')}, {letter('stripped', C.LEADING_LETTER)}, known)
    else known end as pred
  from (select *, {by_task(lambda s: known_answer('cleaned', s))} as known
    from (select *, {confidence('response')} as confidence, {abstains('response')} as abstained, {strip('response')} as stripped, {clean('response')} as cleaned from responses) a) b) c
"""

#: asserted findings as one boolean per response: whether any counts in grading
FINDING_RE = "(?i)\\b(" + "|".join(p.replace("-", "-") for p in C.FINDING_PHRASES) + ")\\b"
SPLIT = f"string_split(regexp_replace(response, {lit(FINDING_RE)}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
FINDINGS = f"""
select ord, list(f order by i) as asserted_findings from (
  select ord, f, min(i) as i from (
    select ord, i, lower(string_split(ps[i + 1], chr(2))[1]) as f, lower(right(replace(array_to_string(ps[1:i], ''), chr(2), ''), {C.NEGATION_REACH})) as context
    from (select ord, ps, unnest(range(1, len(ps))) as i from (select ord, {SPLIT} as ps from responses where format = 'OE' and not {abstains('response')}) x where len(ps) > 1) y) z
  where not regexp_matches(context, {lit(C.NEGATION)}) group by ord, f) w group by ord
"""


def label(column: str) -> str:
    return f"case when lower(trim({column})) not in ('', 'nan') then lower(trim({column})) end"


GRADED = f"""
select *, confidence / 100.0::double as conf_frac, coalesce(confidence, 0) >= {C.HIGH_CONFIDENCE} and answered and not correct as confidently_wrong,
  abstained and (is_negative_control or task = 'T7-ABSTAIN') as appropriate_abstention,
  format = 'OE' and case task when 'T4-TUMOR' then tumor = 'no' and claims
    when 'T5-LAT' then (tumor = 'no' and claims) or (tumor = 'yes' and side not in ('unknown', 'none') and pred_answer <> side and pred_answer not in ('none', 'UNSURE', 'UNPARSEABLE'))
    when 'T7-ABSTAIN' then claims and pred_answer <> 'UNSURE' else false end as hallucination
from (select *, answered and gt_label <> '' and lower(trim(pred_answer)) = lower(trim(gt_label)) as correct
  from (select *, lower(trim(gt_label)) not in ({lits(C.NO_LABEL)}) as gradeable, not abstained and pred_answer <> 'UNPARSEABLE' as answered
    from (select p.*, coalesce(m.is_negative_control, 0) <> 0 as is_negative_control, lower(coalesce(m.label_tumor_present, 'no')) as tumor, lower(coalesce(m.label_laterality, 'none')) as side,
        coalesce(f.asserted_findings, []::varchar[]) as asserted_findings, list_has_any(coalesce(f.asserted_findings, []::varchar[]), {array(C.GRADED_FINDINGS)}) as claims,
        m.subject_id, m.slice_frac,
        case p.task when 'T4-TUMOR' then coalesce({label('m.slice_tumor_present')}, {label('m.label_tumor_present')}, '')
          when 'T5-LAT' then coalesce({label('m.slice_laterality')}, {label('m.label_laterality')}, '') when 'T1-MOD' then coalesce({label('m.label_modality')}, '')
          when 'T2-PLANE' then coalesce({label('m.label_plane')}, '') when 'T3-ISBRAIN' then case when coalesce(m.is_negative_control, 0) <> 0 then 'no' else 'yes' end
          when 'T7-ABSTAIN' then 'UNSURE' else '' end as gt_label
      from parsed p left join manifest m using (image_id) left join findings f using (ord)) a) b) c
"""
BASE = f"with manifest as ({MANIFEST}), responses as ({RESPONSES}), parsed as ({PARSED}), findings as ({FINDINGS}), graded as ({GRADED})"
REGISTRY = "(values " + ", ".join(f"({lit(r[0])}, cast({lit(r[5])} as double), {lit(r[4])})" for r in REGISTRY_ROWS) + ") as registry(model, params_b, family)"
HEAD = f"headline as (select * from graded where phrasing = 'neutral' and format = 'MC' and task in ({lits(C.HEADLINE_TASKS)}))"
USABLE = f"{HEAD}, usable as (select * from headline where model not in (select model from headline group by model having round(count(case when answered and gradeable then 1 end) / greatest(1, count(case when gradeable then 1 end)), 4) < {C.MIN_COVERAGE}))"
EDGES = "([" + ", ".join(repr(float(e)) + "::double" for e in np.linspace(0, 1, C.ECE_BINS + 1)) + "])"
BIN = f"len(list_filter({EDGES}[1:{C.ECE_BINS}], lambda e: conf_frac >= e)) - 1"
SHORT = "replace(replace(string_split(model, '/')[-1], '-Instruct', ''), '-it', '')"


def bins(source: str, keys: str, where: str) -> str:
    return f"select {keys}, {BIN} as bin, avg(correct::int::double) as acc, avg(conf_frac) as conf, count(*) as n from {source} where conf_frac is not null and {where} group by {keys}, bin"


def ece(source: str, keys: str, where: str = "answered and gradeable") -> str:
    return f"select {keys}, sum(abs(acc - conf) * n) / sum(n) as ece, cast(sum(n) as bigint) as n_conf from ({bins(source, keys, where)}) group by {keys}"


def classes(source: str, keys: str) -> str:
    return f"""select {keys}, class, count(case when class = t and class = p then 1 end) as tp, count(case when class = t and class <> p then 1 end) as fn, count(case when class = p and class <> t then 1 end) as fp
      from (select {keys}, t, p, unnest(list_distinct([t, p])) as class from (select {keys}, lower(trim(gt_label)) as t, lower(trim(pred_answer)) as p from {source} where answered and gradeable)) group by {keys}, class"""


def agreement(source: str, keys: str) -> str:
    return f"""select {keys}, avg(case when tp + fn > 0 then tp::double / (tp + fn) end) as balanced_acc, avg(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)) as macro_f1, cast(sum(tp + fn) as bigint) as n
      from ({classes(source, keys)}) group by {keys}"""


def share(what: str, where: str) -> str:
    return f"avg(case when {where} then ({what})::int::double end)"


def count(where: str) -> str:
    return f"count(case when {where} then 1 end)"


def draws(cells: str, group: str, order: str, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED) -> str:
    """A chain of tables for ``with recursive``: ``cells`` (group, order, m) to ``drawn``, with rep and w.

    Ranges of cells are split in halves, level by level; a split is the binomial quantile of an md5's number, from the
    probabilities within nine deviations of the mean."""
    name = " || ".join(f"coalesce(({k})::varchar, '') || '|'" for k in group.split(", "))
    nulls = ", ".join(f"{c} nulls first" for c in order.split(", "))
    u = f"((('0x' || left(md5('{seed}|' || s.g || '|0|' || lo || '|' || hi || '|' || rep), 13))::ubigint)::double + 0.5) / 4503599627370496.0::double"
    log = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(q) + (n - k) * ln(1 - q)"
    return f"""cells as ({cells}),
placed as (select *, {name} as g, row_number() over (partition by {group} order by {nulls}) - 1 as i, sum(m) over (partition by {group} order by {nulls}) as upto from cells),
ranges as (
  select g, rep, 0::bigint as lo, count(*)::bigint as hi, sum(m)::bigint as n from placed, range({replicates}) r(rep) group by g, rep
  union all
  select g, rep, unnest([lo, mid]), unnest([mid, hi]), unnest([x, n - x]) from (
    select g, rep, lo, mid, hi, n, least(min(k) + count(case when total < u then 1 end), n)::bigint as x from (
      select g, rep, lo, mid, hi, n, u, k, sum(exp({log})) over (partition by g, rep, lo order by k) as total from (
        select *, unnest(range(greatest(0, floor(n * q - 9 * sqrt(n * q * (1 - q)) - 10))::bigint, least(n, ceil(n * q + 9 * sqrt(n * q * (1 - q)) + 10))::bigint + 1)) as k from (
          select s.*, (b.upto - coalesce(a.upto, 0))::double / (c.upto - coalesce(a.upto, 0))::double as q, {u} as u from (select *, (lo + hi) // 2 as mid from ranges where hi - lo > 1) s
            left join placed a on a.g = s.g and a.i = s.lo - 1 join placed b on b.g = s.g and b.i = s.mid - 1 join placed c on c.g = s.g and c.i = s.hi - 1) v) t) z
    group by g, rep, lo, mid, hi, n) y),
drawn as (select placed.* exclude (g, i, upto, m), rep, n as w from ranges join placed on placed.g = ranges.g and i = lo where hi - lo = 1 and n > 0)"""


def ends(keys: str, stat: str, source: str, prefix: str = "") -> str:
    return f"select {keys}, quantile_cont({stat}, 0.025) as {prefix}ci_lo, quantile_cont({stat}, 0.975) as {prefix}ci_hi from ({source}) group by {keys}"


def mean_interval(cells: str, keys: str) -> str:
    """SQL after BASE's tables (with ``recursive``): mean, n and interval from cells (keys, s, c, m)."""
    stat = f"select {keys}, rep, sum(w * s) / sum(w * c) as stat from drawn group by {keys}, rep"
    return f"{draws(cells, keys, 's, c')} select p.*, ci_lo, ci_hi from (select {keys}, sum(s * m) / sum(c * m) as mean, cast(sum(c * m) as bigint) as n from cells group by {keys}) p join ({ends(keys, 'stat', stat)}) q using ({keys})"


def populations(keys: str) -> str:
    """Cells of all populations that the suite's intervals draw from."""
    of = [("scored", SCORED, "lower(trim(gt_label))", "lower(trim(pred_answer))", "null::double", "correct"), ("confidence", f"{SCORED} and conf_frac is not null", "null", "null", "conf_frac", "correct"), ("open", "format = 'OE'", "null", "null", "null::double", "hallucination"), ("abstain", ABST, "null", "null", "null::double", "abstained")]
    each = " union all ".join(f"select {keys}, '{pop}' as pop, {t}::varchar as t, {p}::varchar as p, {c} as c, ({y})::int::double as y from graded where ({where}) and ({y}) is not null" for pop, where, t, p, c, y in of)
    return f"select {keys}, pop, t, p, c, y, count(*) as m from ({each}) group by all"


def suite_intervals(keys: str, cells: str) -> str:
    """``drawn`` and ``suite_ci`` (keys, NAME_ci_lo, NAME_ci_hi)."""
    label = f"""select {keys}, rep, avg(tp / nullif(tp + fn, 0)) as balanced_acc, avg(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)) as macro_f1 from (select {keys}, rep, class, sum(case when class = t and class = p then w else 0 end)::double as tp,
      sum(case when class = t and class <> p then w else 0 end)::double as fn, sum(case when class = p and class <> t then w else 0 end)::double as fp from (select *, unnest(list_distinct([t, p])) as class from drawn where pop = 'scored') group by {keys}, rep, class) group by {keys}, rep"""
    bins_ = f"select {keys}, rep, sum(abs(sy - sc)) / sum(n) as ece from (select {keys}, rep, {BIN.replace('conf_frac', 'c')} as bin, sum(w) as n, sum(w * y) as sy, sum(w * c) as sc from drawn where pop = 'confidence' group by all) group by {keys}, rep"
    mean = lambda pop, x: f"select {keys}, rep, sum(w * {x}) / sum(w) as stat from drawn where pop = '{pop}' group by {keys}, rep"
    parts = [("accuracy", "stat", mean("scored", "y")), ("balanced_acc", "balanced_acc", label), ("macro_f1", "macro_f1", label), ("ece", "ece", bins_), ("brier", "stat", mean("confidence", "(c - y) * (c - y)")), ("hallucination", "stat", mean("open", "y")), ("abstention", "stat", mean("abstain", "y"))]
    joins = " ".join(f"left join ({ends(keys, stat, source, name + '_')}) x_{name} using ({keys})" for name, stat, source in parts)
    return f"{draws(cells, keys + ', pop', 't, p, c, y')}, suite_ci as (select * from (select distinct {keys} from cells) k {joins})"


SCORED = "answered and gradeable"
ABST = "is_negative_control or task = 'T7-ABSTAIN'"
