"""The registered queries as SQL over the same tables, for the correctness check.

Shared parts are named common table expressions; a query is given the ones
it mentions.  The SQL works row by row and by plain windows, so it is an
independent account of what the Spark operators compute.
"""

from __future__ import annotations

import re

from lanternlog.functions import fixed

T0 = 1704067200


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(pairs, default="null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {default} end"


def _ladder(value: str, steps, default="null", quote=False) -> str:
    show = (lambda v: _lit(v)) if quote else (lambda v: f"{v}::double")
    return _case([(f"{value} >= {b}", show(v)) for b, v in steps], default)


def _rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_lit(pattern)})"


def _keywords(words) -> str:
    return "(?i)" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def category(text: str, default: str = "'unknown'") -> str:
    return _case([(_rx(text, _keywords(w)), _lit(n)) for n, w in fixed.ERROR_CATEGORIES], default)


def template(text: str) -> str:
    out = text
    for pattern, put in [
        ("(?i)" + fixed.UUID_PART, "<UUID>"), (fixed.IP_PART, "<IP>"), (fixed.TIME_PART, "<TS>"),
        ("(?i)" + fixed.HEX_PART, "<HEX>"), (r"([/=:# ])\d{4,}", r"\1<ID>"), (fixed.QUOTED_PART, '"<STR>"'),
    ]:
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(put)}, 'g')"
    return f"trim(regexp_replace(lower({out}), '\\s+', ' ', 'g'))"


def words(text: str) -> str:
    return (
        f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), "
        f"lambda w: w <> ''))"
    )


def _round(value: str, digits: int) -> str:
    """Half-even rounding of the double's exact value, as the library rounds."""
    k = f"{10**digits}::double"
    high, low = "x::float::double", "(x - x::float::double)"
    below = f"floor({high} * {k} + {low} * {k})"
    beyond = f"(({high} * {k} - ({below} + 0.5::double)) + {low} * {k})"
    up = f"case when {beyond} > 0 or ({beyond} = 0 and {below} % 2 <> 0) then 1 else 0 end"
    return f"list_transform([({value})::double], lambda x: ({below} + {up}) / {k})[1]"


def _weights(text: str) -> list[str]:
    return [
        f"case when {_rx(text, '(?i)' + r)} then struct_pack(name := 'pattern:{n}', weight := {w}::double) end"
        for n, r, w in fixed.PATTERNS
    ]


HTTP_NAME = _case(
    [(f"http_status = {c}", _lit(n)) for c, n, _ in fixed.HTTP_SIGNALS]
    + [("http_status >= 500", _lit(fixed.HTTP_SERVER_ERROR[0])), ("http_status = 429", _lit(fixed.HTTP_RATE_LIMIT[1])),
       ("http_status in (401, 403)", _lit(fixed.HTTP_AUTH[1]))]
)
HTTP_WEIGHT = _case(
    [(f"http_status = {c}", f"{w}::double") for c, _, w in fixed.HTTP_SIGNALS]
    + [("http_status >= 500", "0.7::double"), ("http_status = 429", "0.5::double"), ("http_status in (401, 403)", "0.4::double")]
)
SEVERITY_WEIGHT = _case([(f"level = '{n}'", f"{w}::double") for n, w in fixed.SEVERITY_WEIGHTS.items()])
PATTERN_NAME = _case([(_rx("message", "(?i)" + r), _lit(n)) for n, r, _ in fixed.PATTERNS])
PATTERN_WEIGHT = _case([(f"pattern = '{n}'", f"{w}::double") for n, _, w in fixed.PATTERNS])
DYING = "coalesce(pattern in ('oom', 'crash', 'resource'), false)"
BLAST = _ladder("services", fixed.BLAST_WEIGHTS)


def _score(statistical: str, context: str) -> str:
    total = (
        f"coalesce(pattern_w, 0) * 0.30::double + coalesce({statistical}, 0) * 0.25::double + "
        f"coalesce({context}, 0) * 0.15::double + coalesce(http_w, 0) * 0.10::double + "
        f"coalesce(severity_w, 0) * 0.10::double + coalesce(structural_w, 0) * 0.10::double"
    )
    return f"greatest(least({_round(total, 3)}, 1.0::double), case when {DYING} then 0.65::double else 0 end)"


def _signal_list(extra=()) -> str:
    parts = [
        "case when severity_w is not null then struct_pack(name := 'severity', weight := severity_w) end",
        *_weights("message"),
        "case when http_name is not null then struct_pack(name := http_name, weight := http_w) end",
        "case when cat is not null then struct_pack(name := 'structural:category:' || cat, weight := 0.3::double) end",
        *[f"case when {w} is not null then struct_pack(name := '{n}', weight := ({w})::double) end" for n, w in extra],
    ]
    return f"list_filter([{', '.join(parts)}], lambda s: s is not null)"


def _signal_text(signals: str) -> str:
    w = _round("s.weight", 3)
    return f"array_to_string(list_sort(list_transform({signals}, lambda s: s.name || '=' || printf('%.3f', {w}))), ',')"


STAT_SIGNALS = [
    ("zscore:sustained_failure", "case when std_rate = 0 and mean_rate >= 0.5 then least(mean_rate * 2, 1) end"),
    ("zscore:elevated_baseline", "case when std_rate = 0 and mean_rate < 0.5 and mean_rate >= 0.1 then mean_rate end"),
    ("zscore:spike", "case when z_score >= 2 then least(z_score / 5, 1) end"),
]
CONTEXT_SIGNALS = [
    ("context:blast_radius", "blast_w"), ("context:velocity", "velocity_w"), ("context:recurrence", "recurrence_w"),
]

RULE_LEVEL_TYPE = _case([(f"level = '{n}'", _lit(t)) for n, _, t in fixed.RULE_LEVELS], "'unknown'")
RULE_LEVEL_SCORE = _case([(f"level = '{n}'", f"{s}::double") for n, s, _ in fixed.RULE_LEVELS], "0::double")
RULE_TYPE = (
    "case when crit then "
    + _case([(_rx("message", _keywords(w)), _lit(n)) for n, w in fixed.RULE_TYPES], "level_type")
    + " when err and level_type in ('error', 'unknown') then 'request_failure' else level_type end"
)
PRIORITY = _case([(f"severity = '{s}' and urgency = '{u}'", _lit(p)) for (s, u), p in fixed.PRIORITY_MATRIX.items()], "'P3'")
STATES = "[" + ", ".join(_lit(s) for s in fixed.STATES) + "]"
IS_ERR = "event_type = 'error' or ((event_id // 400) % 7 = 6 and event_type in ('view', 'click'))"


def _rule(name: str, source: str, features: str) -> dict[str, str]:
    return {
        f"{name}_all": f"""
          select *, {RULE_LEVEL_SCORE} + pattern_score + {features} as raw_score, {RULE_TYPE} as anomaly_type from (
            select *, case when crit then 0.35::double when err then 0.15::double else 0::double end as pattern_score from (
              select *, {_rx('message', fixed.RULE_CRITICAL)} as crit, {_rx('message', fixed.RULE_ERROR)} as err,
                     {RULE_LEVEL_TYPE} as level_type
              from {source}))""",
        name: f"""
          select log_seq, epoch, tenant_id, service, level, message, trace_id, span_id, anomaly_type, pattern_score,
                 least(raw_score, 1) as anomaly_score,
                 case when raw_score >= 0.85 then 'critical' when raw_score >= 0.7 then 'high' else 'medium' end as severity,
                 case when level = 'FATAL' or crit then 'immediate' else 'windowed' end as detection_mode,
                 md5(concat_ws('|', 'rule', tenant_id, service, log_seq::varchar, (epoch * 1000000)::varchar)) as event_id
          from {name}_all where raw_score >= 0.65""",
    }


CTES: dict[str, str] = {
    "logs": f"""
      select event_id as log_seq, 1704067200 + event_id // 4 as epoch,
        't' || ((user_id // 4) % 2)::varchar as tenant_id, 'svc-' || (user_id % 4)::varchar as service,
        case when is_err then case when event_id % 10 = 0 then 'FATAL' else 'ERROR' end
             when event_type = 'signup' then 'WARN' when event_type = 'view' then 'DEBUG' else 'INFO' end as level,
        case when is_err then case event_id % 8
            when 0 then 'Connection refused to 10.0.' || user_id::varchar || '.7:5432 order=' || (event_id + 100000)::varchar
            when 1 then 'Request timeout after 30s for order #' || (event_id + 100000)::varchar
            when 2 then 'java.lang.OutOfMemoryError: Java heap space, pod ' || md5(event_id::varchar)
            when 3 then 'deadlock detected on orders id=' || (event_id + 100000)::varchar
            when 4 then 'Service unavailable: upstream connect error'
            when 5 then 'invalid token for user /' || (user_id + 10000)::varchar
            when 6 then 'No space left on device'
            else 'NullPointerException: null pointer in handler' end
          else 'Request processed seq=' || event_id::varchar end as message,
        case when event_type = 'error' then case event_id % 8 when 0 then 503 when 1 then 504 when 5 then 401 else 500 end
             else 200 end as http_status,
        md5('t' || (event_id // 5)::varchar) as trace_id, substr(md5('s' || event_id::varchar), 1, 16) as span_id,
        value as latency_ms, event_type, user_id
      from (select *, {IS_ERR} as is_err from events)""",
    **_rule("rules", "logs", "0"),
    "hours": """
      select tenant_id, service, epoch - epoch % 3600 as hour_epoch, count(*) as n,
             count(*) filter (level in ('ERROR', 'FATAL', 'CRITICAL')) as errors
      from logs group by all""",
    "lat_ranked": """
      select tenant_id, service, epoch - epoch % 3600 as hour_epoch, round(latency_ms * 1000)::bigint as lat,
             row_number() over (partition by tenant_id, service, epoch - epoch % 3600 order by round(latency_ms * 1000)::bigint) as rn,
             count(*) over (partition by tenant_id, service, epoch - epoch % 3600) as n
      from logs""",
    "features": """
      select h.tenant_id, h.service, h.hour_epoch, h.errors / h.n as error_rate_1h,
             (select max(lat) / 1000.0::double from lat_ranked l where l.tenant_id = h.tenant_id and l.service = h.service
                and l.hour_epoch = h.hour_epoch and l.rn = ceil(l.n * 0.99::double)) as p99_latency_1h,
             h.n::double as request_rate_1h,
             (select count(*) from rules r where r.tenant_id = h.tenant_id and r.service = h.service
                and r.epoch - r.epoch % 3600 = h.hour_epoch) as anomaly_history_count
      from hours h""",
    "latest_features": """
      select * from features qualify row_number() over (partition by tenant_id, service order by hour_epoch desc) = 1""",
    "featured": """
      select l.*, f.error_rate_1h, f.p99_latency_1h, f.anomaly_history_count
      from logs l left join latest_features f using (tenant_id, service)""",
    **_rule(
        "rules_f", "featured",
        "((case when coalesce(error_rate_1h, 0) > 0.1 then 0.1::double else 0 end) + "
        "(case when coalesce(anomaly_history_count, 0) > 5 then 0.1::double else 0 end))",
    ),
    "sig": f"""
      select *, {PATTERN_WEIGHT} as pattern_w, case when cat is not null then 0.3::double end as structural_w from (
        select *, epoch as sec, level in ('ERROR', 'FATAL', 'CRITICAL') as is_error, {PATTERN_NAME} as pattern,
               {HTTP_NAME} as http_name, {HTTP_WEIGHT} as http_w, {SEVERITY_WEIGHT} as severity_w,
               case when level in ('ERROR', 'FATAL', 'CRITICAL') then {category('message', 'null')} end as cat
        from logs)""",
    "cand": f"""
      select tenant_id, service, pattern, sec, min(log_seq) as log_seq from sig
      where {DYING} or (severity_w >= 0.95 and pattern_w >= 0.5) group by tenant_id, service, pattern, sec""",
    "emission": """
      select tenant_id, service, pattern, min(sec) as sec from cand group by tenant_id, service, pattern
      union all
      select c.tenant_id, c.service, c.pattern, min(c.sec) as sec
      from emission e join cand c on c.tenant_id = e.tenant_id and c.service = e.service and c.pattern = e.pattern
           and c.sec >= e.sec + 300
      group by c.tenant_id, c.service, c.pattern""",
    "emitted": "select c.* from cand c join emission e using (tenant_id, service, pattern, sec)",
    "buckets": """
      select tenant_id, service, epoch - epoch % 10 as bucket, count(*) as total,
             count(*) filter (level in ('ERROR', 'FATAL', 'CRITICAL')) as errors
      from logs group by all""",
    "hist": """
      select *, count(*) over w as prev_n, coalesce(sum(r) over w, 0) as prev_r, coalesce(list(r) over w, []) as rates,
             coalesce(sum(errors) over w, 0) as prev_e,
             count(*) over e as edge_n, coalesce(sum(r) over e, 0) as edge_r, coalesce(sum(errors) over e, 0) as edge_e
      from (select *, errors / total as r from buckets)
      window w as (partition by tenant_id, service order by bucket range between 290 preceding and 10 preceding),
             e as (partition by tenant_id, service order by bucket range between 300 preceding and 300 preceding)""",
    "stats": """
      select *, case when std_rate > 0 then round((current_rate - mean_rate) / std_rate, 9) end as z_score from (
        select *, case when s0 < 1e-9 then 0 else s0 end as std_rate from (
          select *, sqrt(list_sum(list_transform(all_rates, lambda r: (r - mean_rate) * (r - mean_rate))) / buckets) as s0 from (
            select *, (sum_r + current_rate) / buckets as mean_rate from (
              select log_seq, run_errors, prev_n + edge as window_n, prev_n + edge + 1 as buckets,
                     prev_r + edge * edge_r as sum_r, prev_e + edge * edge_e as window_errors, run_errors / run_total as current_rate,
                     list_concat(rates, case when edge = 1 then [edge_r] else [] end, [run_errors / run_total]) as all_rates
              from (
                select l.log_seq, h.*, case when l.epoch = h.bucket and h.edge_n > 0 and h.prev_n <= 28 then 1 else 0 end as edge,
                  count(*) over r as run_total, count(*) filter (l.level in ('ERROR', 'FATAL', 'CRITICAL')) over r as run_errors
                from logs l join hist h on h.tenant_id = l.tenant_id and h.service = l.service and h.bucket = l.epoch - l.epoch % 10
                window r as (partition by l.tenant_id, l.service, l.epoch - l.epoch % 10 order by l.log_seq)
              )))))""",
    "velo": """
      select log_seq, case when window_n >= 1 then case when window_errors / window_n < 1
          then case when run_errors >= 10 then 0.8::double when run_errors >= 5 then 0.6 when run_errors >= 2 then 0.4 end
          else case when run_errors / (window_errors / window_n) >= 5 then 0.8::double
                    when run_errors / (window_errors / window_n) >= 3 then 0.5
                    when run_errors / (window_errors / window_n) >= 2 then 0.3 end end end as velocity_w
      from stats""",
    "errsec": "select distinct tenant_id, service, epoch as sec from logs where level in ('ERROR', 'FATAL', 'CRITICAL')",
    "erring": """
      select a.tenant_id, a.sec, count(distinct b.service) as services
      from (select distinct tenant_id, sec from errsec) a
      join errsec b on b.tenant_id = a.tenant_id and b.sec between a.sec - 300 and a.sec group by all""",
    "scored": f"""
      select *, {_score("coalesce(" + ", ".join(w for _, w in STAT_SIGNALS) + ")", "greatest(blast_w, velocity_w, recurrence_w)")} as score
      from (
        select w.*, case when w.is_error then {BLAST} end as blast_w, case when w.is_error then v.velocity_w end as velocity_w,
          case when occ = 1 then 0.3::double when occ <= 5 then 0.1 end as recurrence_w
        from (
          select s.*, t.* exclude (log_seq), case when s.is_error then row_number() over (
              partition by s.tenant_id, s.is_error, {template('s.message')} order by s.log_seq) end as occ
          from sig s join stats t using (log_seq)
          where t.buckets >= 3 and s.log_seq not in (select log_seq from emitted)
        ) w left join velo v using (log_seq) left join erring e on e.tenant_id = w.tenant_id and e.sec = w.sec
      )""",
    "inc": f"""
      select *, '[' || upper(severity) || '] ' || service || ' - ' || substr(description, 1, 120) as title, {PRIORITY} as priority from (
        select log_seq, log_seq as number, 'TICK-' || lpad(log_seq::varchar, 8, '0') as id, tenant_id, service, severity,
          anomaly_type, anomaly_score, event_id, epoch as created_epoch, trace_id,
          {STATES}[(log_seq % 5 + 1)::int] as state,
          case when severity in ('critical', 'high') then 'high' when severity = 'medium' then 'medium' else 'low' end as urgency,
          anomaly_type || ' anomaly detected in ' || service || ' (score=' || printf('%.2f', anomaly_score) || ', severity='
            || severity || '): ' || substr(message, 1, 200) as description,
          case when log_seq % 5 >= 3 then 'cause ' || anomaly_type end as root_cause,
          case when log_seq % 5 >= 1 then epoch + log_seq % 50 * 60 end as ack,
          case when log_seq % 5 >= 3 then epoch + log_seq % 50 * 120 end as mit,
          case when log_seq % 5 >= 4 then epoch + log_seq % 50 * 180 end as res
        from rules)""",
    "troot": """
      select tenant_id, trace_id, min(log_seq) as first_err from logs where level in ('ERROR', 'FATAL', 'CRITICAL') group by all""",
    "trows": """
      select l.*, row_number() over (partition by tenant_id, trace_id order by log_seq) as seq
      from logs l semi join troot using (tenant_id, trace_id)""",
    "tsvc": """
      select tenant_id, trace_id, service, min(log_seq) as first_seen,
             min(log_seq) filter (level in ('ERROR', 'FATAL', 'CRITICAL')) as first_error
      from trows group by all""",
    "flows": """
      select tenant_id, trace_id, list(service order by first_seen) as flow,
             coalesce(list(service order by first_seen) filter (first_error is not null), []) as error_flow,
             arg_max(service, first_seen) filter (first_error is not null) as root,
             arg_max(first_error, first_seen) filter (first_error is not null) as root_row
      from tsvc group by all""",
    "edges": """
      select tenant_id, caller, service as callee, count(*) as n from (
        select *, lag(service) over (partition by tenant_id, trace_id order by first_seen) as caller from tsvc)
      where caller is not null group by all""",
    "llogs": "select * exclude (trace_id), md5('long' || (log_seq // 2000)::varchar) as trace_id from logs",
    "ltroot": """
      select tenant_id, trace_id, min(log_seq) as first_err from llogs where level in ('ERROR', 'FATAL', 'CRITICAL') group by all""",
    "ltrows": """
      select l.*, row_number() over (partition by tenant_id, trace_id order by log_seq) as seq
      from llogs l semi join ltroot using (tenant_id, trace_id)""",
    "ltsvc": """
      select tenant_id, trace_id, service, min(log_seq) as first_seen,
             min(log_seq) filter (level in ('ERROR', 'FATAL', 'CRITICAL')) as first_error
      from ltrows group by all""",
    "roots": "select distinct tenant_id, root from flows",
    "closure": """
      select tenant_id, root, root as svc from roots
      union
      select c.tenant_id, c.root, e.callee from closure c join edges e on e.tenant_id = c.tenant_id and e.caller = c.svc""",
    "blast": """
      select r.tenant_id, r.root, list_sort(list(distinct a.svc) filter (a.svc is not null)) as affected, count(distinct a.svc) as n,
             any_value(t.total) as total
      from roots r
      left join (select tenant_id, root, svc from closure where svc <> root
                 union select tenant_id, callee, caller from edges where caller <> callee) a on a.tenant_id = r.tenant_id and a.root = r.root
      left join (select tenant_id, count(distinct svc) as total from (
                   select tenant_id, caller as svc from edges union all select tenant_id, callee from edges) group by all) t
        on t.tenant_id = r.tenant_id
      group by r.tenant_id, r.root""",
    "fails": f"""
      select f.tenant_id, f.trace_id, f.root as service, f.error_flow, f.flow,
        case when tr.level = 'FATAL' then 'critical' else 'high' end as severity,
        case when tr.level = 'FATAL' then 0.98::double else 0.9::double end as anomaly_score,
        tr.level as trigger_level, {template('tr.message')} as error_message, {category('tr.message')} as trigger_category,
        case when {category('rr.message')} <> 'unknown' then {category('rr.message')} else {category('tr.message')} end as error_category,
        case when b.n > 3 then 'high' when b.n > 1 then 'medium' else 'low' end as impact,
        (select max(epoch) from trows t where t.tenant_id = f.tenant_id and t.trace_id = f.trace_id) as epoch,
        md5(concat_ws('|', 'request_failure', f.tenant_id, f.trace_id)) as event_id
      from flows f join troot r using (tenant_id, trace_id)
      join logs tr on tr.log_seq = r.first_err join logs rr on rr.log_seq = f.root_row
      join blast b on b.tenant_id = f.tenant_id and b.root = f.root""",
    "fail_keys": """
      select *, service || ':request_failure:' || substr(md5(service || ':' || error_category || ':' || error_message), 1, 12) as dedup_key
      from fails where anomaly_score >= 0.5""",
    "fopening": """
      select tenant_id, dedup_key, min(epoch) as sec from fail_keys group by tenant_id, dedup_key
      union all
      select k.tenant_id, k.dedup_key, min(k.epoch) as sec from fopening o
      join fail_keys k on k.tenant_id = o.tenant_id and k.dedup_key = o.dedup_key and k.epoch >= o.sec + 900
      group by k.tenant_id, k.dedup_key""",
    "ftickets": """
      select *, row_number() over (order by epoch, event_id) as num from (
        select k.*, row_number() over w as rank, count(*) over (partition by k.tenant_id, k.dedup_key, o.sec) as n_events
        from fail_keys k asof join fopening o on k.tenant_id = o.tenant_id and k.dedup_key = o.dedup_key and k.epoch >= o.sec
        window w as (partition by k.tenant_id, k.dedup_key, o.sec order by k.epoch, k.event_id))
      where rank = 1""",
    "keyed": "select *, service || ':' || anomaly_type as dedup_key, epoch as sec from rules where anomaly_score >= 0.5",
    "opening": """
      select tenant_id, dedup_key, min(sec) as sec from keyed group by tenant_id, dedup_key
      union all
      select k.tenant_id, k.dedup_key, min(k.sec) as sec from opening o
      join keyed k on k.tenant_id = o.tenant_id and k.dedup_key = o.dedup_key and k.sec >= o.sec + 900
      group by k.tenant_id, k.dedup_key""",
    "member": """
      select k.*, o.sec as open_sec, row_number() over (partition by k.tenant_id, k.dedup_key, o.sec order by k.sec, k.event_id) as rank
      from keyed k asof join opening o on k.tenant_id = o.tenant_id and k.dedup_key = o.dedup_key and k.sec >= o.sec""",
    "tickets": """
      select *, row_number() over (order by epoch, event_id) as num from (
        select *, count(*) over (partition by tenant_id, dedup_key, open_sec) as n_events from member)
      where rank = 1""",
    "every_event": f"""
      select tenant_id, dedup_key, epoch from keyed
      union all select tenant_id, service || ':error_rate_spike', epoch from (
        select s.*, {_score('null', 'null')} as score from sig s semi join emitted using (log_seq)) where {_round('score', 2)} >= 0.5
      union all select tenant_id, service || ':error_rate_spike', epoch from scored where score >= 0.3 and {_round('score', 2)} >= 0.5
      union all select tenant_id, dedup_key, epoch from fail_keys""",
    "every_opening": """
      select tenant_id, dedup_key, min(epoch) as sec from every_event group by tenant_id, dedup_key
      union all
      select k.tenant_id, k.dedup_key, min(k.epoch) as sec from every_opening o
      join every_event k on k.tenant_id = o.tenant_id and k.dedup_key = o.dedup_key and k.epoch >= o.sec + 900
      group by k.tenant_id, k.dedup_key""",
    "evrank": """
      select *, count(*) filter (level in ('ERROR', 'FATAL', 'WARN')) over (partition by tenant_id, service order by log_seq) as ev_no
      from logs""",
    "ev": """
      select i.log_seq as asked, e.log_seq from (select log_seq, tenant_id, service, ev_no from evrank) i
      join evrank e on e.tenant_id = i.tenant_id and e.service = i.service and e.level in ('ERROR', 'FATAL', 'WARN')
        and e.ev_no <= i.ev_no and e.ev_no > i.ev_no - 50""",
    "requests": """
      select id, number, created_epoch + 100 + pos * 60 + number % 7 as req_at, act, pos from (
        select *, unnest([0, 1]) as pos, unnest(case when number % 2 = 0 then ['acknowledged', 'resolved'] else ['investigating', 'mitigated'] end) as act
        from inc where number % 3 <> 0)""",
    "flatf": """
      select message, service, epoch,
        case when log_seq % 17 = 0 then 'VERBOSE' when log_seq % 19 = 0 then '' else level end as level,
        log_seq % 23 = 0 as bad_time from logs""",
}
RECURSIVE = {"emission", "closure", "opening", "fopening", "every_opening"}


def sql(body: str) -> str:
    """The query with every common table expression it needs, in order."""
    wanted: set[str] = set()
    stack = [body]
    while stack:
        text = stack.pop()
        for name, cte in CTES.items():
            if name not in wanted and re.search(rf"(?<![\w.']){name}(?![\w'])", text):
                wanted.add(name)
                stack.append(cte)
    parts = [f"{name} as ({cte})" for name, cte in CTES.items() if name in wanted]
    head = "with recursive " if wanted & RECURSIVE else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


ERR = "level in ('ERROR', 'FATAL', 'CRITICAL')"


def _facet(source: str, sizes: dict[str, int]) -> str:
    parts = [
        f"select '{c}' as facet, {c} as value, count(*) as n, row_number() over (order by count(*) desc, {c}) as rank, {k} as size "
        f"from {source} group by {c}"
        for c, k in sizes.items()
    ]
    return f"select facet, value, n, rank from ({' union all '.join(parts)}) where rank <= size"


def _time_to(where: str = "true") -> str:
    parts = [
        f"select '{m}' as metric, greatest({c} - created_epoch, 0) / 60 as v from inc where state = 'resolved' and {c} is not null and {where}"
        for m, c in (("mttr", "res"), ("mtta", "ack"), ("mttm", "mit"))
    ]
    return f"""
      select metric, {_round('avg(v)', 1)} as avg_minutes, {_round('max(v) filter (rn = n // 2 + 1)', 1)} as median_minutes,
        {_round('max(v) filter (rn = case when n >= 5 then floor(n * 0.95::double)::bigint + 1 else n end)', 1)} as p95_minutes,
        {_round('min(v)', 1)} as min_minutes, {_round('max(v)', 1)} as max_minutes, count(*) as sample_size
      from (select *, row_number() over (partition by metric order by v) as rn, count(*) over (partition by metric) as n
            from ({' union all '.join(parts)})) group by metric"""


def _events(extra, mode: str, source: str, z: str, rate: str, buckets: str) -> str:
    return f"""
      select log_seq, tenant_id, service,
        case when score >= 0.85 then 'critical' when score >= 0.65 then 'high' when score >= 0.45 then 'medium' else 'low' end as severity,
        {_round('score', 2)} as anomaly_score, '{mode}' as detection_mode, {category('message')} as error_category,
        {template('message')} as error_template, {z} as z_score, {rate} as error_rate,
        {_signal_text(_signal_list(extra))} as signals, {buckets} as window_buckets
      from {source}"""


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{fixed.UUID_DNS_NAMESPACE}') || encode({name}))"
    return (
        f"(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' "
        f"|| substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) "
        f"from (select {h} as h))"
    )


LOG_ID = _uuid5("trace_id || '|' || span_id || '|' || strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'")


def _iso(epoch: str) -> str:
    return f"strftime(make_timestamp({epoch} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


DESCRIPTION = (
    "anomaly_type || ' anomaly detected in ' || service || ' (score=' || printf('%.2f', anomaly_score) || ', severity=' "
    "|| severity || '): ' || substr(message, 1, 200)"
)

_BODIES: dict[str, str] = {
    "rule_score_by_service": "select service, severity, count(*) as n, max(anomaly_score) as top_score from rules group by all",
    "rule_score_events": f"""
      select log_seq, tenant_id, service, anomaly_type, round(anomaly_score, 4) as anomaly_score, severity, detection_mode,
        {DESCRIPTION} as description, trace_id, span_id as span_ids, round(pattern_score, 4) as pattern_score from rules""",
    "rule_score_enriched": """
      select tenant_id, service, anomaly_type, severity, count(*) as n, round(max(anomaly_score), 4) as top_score
      from rules_f group by all""",
    "signal_vector": f"""
      select log_seq, {_signal_text(_signal_list())} as signals, {_score('null', 'null')} as score,
        {DYING} or (severity_w >= 0.95 and coalesce(pattern_w >= 0.5, false)) as immediate,
        array_to_string(list_transform(list_slice(list_sort(list_transform({_signal_list()},
          lambda s, i: struct_pack(neg := -s.weight, pos := i, name := s.name))), 1, 3),
          lambda s: s.name || '=' || printf('%.2f', -s.neg)), ', ') as top_signals
      from sig where is_error""",
    "http_stack_signals": f"""
      select {HTTP_NAME} as http, {HTTP_WEIGHT} as http_w, (log_seq % 20)::int as frames,
        {_ladder('log_seq % 20', fixed.FRAME_WEIGHTS)} as stack_w, count(*) as n from logs group by all""",
    "document_signals": f"""
      select source, {PATTERN_NAME} as sig_pattern, {category('message', 'null')} as sig_category, count(*) as n
      from (select source, text as message from documents) group by all""",
    "zscore_labels": """
      select case when z_score >= 4 then 'critical' when z_score >= 3 then 'high' when z_score >= 2.5 then 'medium' else 'low' end as severity,
        case when z_score >= 4 then 0.98::double when z_score >= 3 then 0.9 when z_score >= 2.5 then 0.8 else 0.7 end as confidence,
        count(*) as n from stats where z_score is not null group by all""",
    "error_templates": f"""
      select tenant_id, template, substr(md5(template), 1, 16) as template_id, count(*) as n, min(epoch) as first_epoch, max(epoch) as last_epoch
      from (select *, {template('message')} as template from logs where {ERR}) group by all""",
    "error_categories": f"select tenant_id, {category('message')} as category, count(*) as n from logs where {ERR} group by all",
    "document_templates": f"select doc_id, substr(md5({template('text')}), 1, 16) as template_id from documents",
    "level_normalize": """
      select raw, case when upper(raw) = '' then 'INFO' when upper(raw) in ('CRITICAL', 'ALERT', 'EMERGENCY') then 'FATAL'
        when upper(raw) like 'WARN%' then 'WARN' else upper(raw) end as level, count(*) as n
      from (select ['critical', 'Warning', '', 'alert', 'Emergency', 'info', 'warn', 'error', 'fatal', 'debug', 'TRACE'][(log_seq % 11 + 1)::int] as raw from logs)
      group by all""",
    "otlp_roundtrip": f"""
      select log_seq, epoch, {LOG_ID} as log_id, level, message, service, tenant_id, tenant_id as environment, trace_id, span_id,
        http_status::varchar as http_status from logs""",
    "dlq_route": """
      select target, reason, count(*) as n, sum(chars)::bigint as chars from (
        select case when log_seq % 5 < 3 then 'log' else 'dlq' end as target,
          case when log_seq % 5 = 3 then 'unknown_format' when log_seq % 5 = 4 then 'parse_error' else '' end as reason,
          case when log_seq % 5 < 3 then length(message) when log_seq % 5 = 3 then length('{"a":' || user_id || '}') else length('{bad ') + 5000 end as chars
        from logs) group by all""",
    "parsed_messages": f"""
      select {LOG_ID} as log_id, epoch, level, message,
        case when log_seq % 5 = 1 then 'unknown' else service end as service,
        case when log_seq % 5 = 1 then 'dev-local' else tenant_id end as tenant_id,
        case log_seq % 5 when 0 then 'prod' when 1 then 'dev-local' else tenant_id end as environment,
        case when log_seq % 5 = 0 then 'app' end as scope_name, trace_id,
        case log_seq % 5 when 0 then 'http_status_code,resource_k8s_pod' else 'http_status_code' end as attr_names,
        http_status::varchar as http_status
      from logs where log_seq % 5 < 3""",
    "attr_flatten": """
      select log_seq, 'http_route=/last;ids=[1,"b"];kv={"a\\"b":false};ok=true;resource_http_route=/last;resource_ids=[1,"b"];'
        || 'resource_kv={"a\\"b":false};resource_level=x;resource_ok=true;resource_retry_count=7;retry_count=7' as attrs, user_id::varchar as retries from logs""",
    "attr_nesting": """
      select log_seq, repeat('[{"k":', (log_seq % 12 + 1)::int) || log_seq::varchar || repeat('},null]', (log_seq % 12 + 1)::int) as value from logs""",
    "tenant_inject": """
      select 2 as n_attrs, tenant_id as injected, 'q' as fields, case when log_seq % 3 = 0 then 'dev-local' else tenant_id end as defaulted,
        count(*) as n from logs group by all""",
    "trace_headers": """
      select log_seq, case when log_seq % 4 <> 3 then trace_id end as trace_id, case when log_seq % 4 <> 3 then span_id end as span_id from logs""",
    "bucket_rates": "select tenant_id, service, bucket, total, errors, round(errors / total, 6) as rate from buckets",
    "zscore_rows": """
      select log_seq, buckets, round(current_rate, 6) as current_rate, round(mean_rate, 6) as mean_rate, round(std_rate, 6) as std_rate,
        round(z_score, 5) as z_score from stats where buckets >= 3""",
    "late_repair": """
      select tenant_id, service, bucket, total, errors, buckets, round(mean_rate, 6) as mean_rate, round(std_rate, 6) as std_rate,
        case when std_rate >= 1e-9 then round((r - mean_rate) / std_rate, 5) end as z_score from (
        select *, sqrt(list_sum(list_transform(all_rates, lambda v: (v - mean_rate) * (v - mean_rate))) / buckets) as std_rate from (
          select *, (prev_r + r) / (prev_n + 1) as mean_rate, prev_n + 1 as buckets, list_append(rates, r) as all_rates from hist))""",
    "late_counts": f"""
      select tenant_id, service, count(*) as late, max(mark - epoch)::double as most_seconds from (
        select *, {T0} - 121 + 100 * (log_seq // 400 + case when log_seq % 13 = 0 then 6 else 0 end) as mark from logs)
      where epoch < mark group by all""",
    "velocity": f"select s.log_seq, s.run_errors, v.velocity_w from stats s join velo v using (log_seq) join logs l using (log_seq) where l.{ERR}",
    "recurrence": f"""
      select log_seq, occurrence, case when occurrence = 1 then 0.3::double else 0.1 end as recurrence_w from (
        select log_seq, row_number() over (partition by tenant_id, {template('message')} order by log_seq) as occurrence from logs where {ERR})
      where occurrence <= 5""",
    "erroring_services": f"select tenant_id, sec, services, {BLAST} as blast_w from erring",
    "immediate_events": _events(
        (), "immediate", f"(select s.*, {_score('null', 'null')} as score from sig s semi join emitted using (log_seq))",
        "null::double", "0::double", "null::bigint"),
    "windowed_events": _events(
        [*STAT_SIGNALS, *CONTEXT_SIGNALS], "windowed", "scored where score >= 0.3",
        _round("z_score", 2) + " + 0.0::double", _round("current_rate", 4), "buckets"),
    "anomaly_union": f"""
      select anomaly_type, detection_mode, severity, count(*) as n from (
        select anomaly_type, detection_mode, severity from rules
        union all select 'error_rate_spike', 'immediate', case when score >= 0.85 then 'critical' when score >= 0.65 then 'high'
          when score >= 0.45 then 'medium' else 'low' end from (select {_score('null', 'null')} as score from sig semi join emitted using (log_seq))
        union all select 'error_rate_spike', 'windowed', case when score >= 0.85 then 'critical' when score >= 0.65 then 'high'
          when score >= 0.45 then 'medium' else 'low' end from scored where score >= 0.3
        union all select 'request_failure', null, severity from fails) group by all""",
    "hourly_features": """
      select tenant_id, service, hour_epoch, round(error_rate_1h, 6) as error_rate_1h, p99_latency_1h, request_rate_1h, anomaly_history_count
      from features""",
    "parsed_features": """
      select tenant_id, service, hour_epoch, round(error_rate_1h, 6) as error_rate_1h, p99_latency_1h, request_rate_1h, anomaly_history_count
      from features""",
    "parse_to_incidents": """
      select k.tenant_id, k.dedup_key, o.sec as open_sec, count(*) as n_events, least(count(*), 5)::bigint as similar_count,
        count(*) - least(count(*), 5)::bigint as dropped
      from every_event k asof join every_opening o on k.tenant_id = o.tenant_id and k.dedup_key = o.dedup_key and k.epoch >= o.sec
      group by all""",
    "feature_enrich": """
      select tenant_id, service, round(case when service = 'svc-3' then 0 else error_rate_1h end, 6) as error_rate_1h,
        case when service = 'svc-3' then 0 else p99_latency_1h end as p99_latency_1h,
        case when service = 'svc-3' then 'default' end as source, count(*) as n from featured group by all""",
    "feature_asof": """
      select l.log_seq, round(coalesce(f.error_rate, 0), 6) as error_rate, coalesce(f.n, 0)::double as request_rate,
        coalesce(f.anomalies, 0)::bigint as anomalies, case when f.n is null then 'default' end as source
      from logs l asof left join (
        select tenant_id, service, epoch - epoch % 300 + 300 as computed, count(*) as n, any_value(a.found) as anomalies,
          count(*) filter (level in ('ERROR', 'FATAL', 'CRITICAL')) / count(*) as error_rate
        from (select *, epoch - epoch % 300 as part from logs)
        left join (select tenant_id, service, epoch - epoch % 300 as part, count(*) as found from rules group by all) a using (tenant_id, service, part)
        group by all) f
      on l.tenant_id = f.tenant_id and l.service = f.service and l.epoch >= f.computed""",
    "feature_freshness": f"""
      select max(hour_epoch) + 3600 as newest_epoch, {T0 + 40 * 3600} - (max(hour_epoch) + 3600) as age_seconds,
        {T0 + 40 * 3600} - (max(hour_epoch) + 3600) > 3600 as stale from features""",
    "trace_timeline": """
      select tenant_id, trace_id, count(*)::int as n_rows,
        string_agg(service || ' ' || level || ' ' || log_seq::varchar, '|' order by log_seq) as steps,
        md5(string_agg('  [' || strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S') || '] [' || service || '] [' || level || '] '
          || message || ' (span:' || span_id || ')', chr(10) order by log_seq)) as text_hash
      from trows group by all""",
    "trace_steps": """
      select tenant_id, trace_id, log_seq, seq, ((epoch - lag(epoch) over w) * 1000)::double as gap_ms,
        ((epoch - first_value(epoch) over w) * 1000)::double as offset_ms
      from trows window w as (partition by tenant_id, trace_id order by log_seq)""",
    "request_flow": """
      select tenant_id, trace_id, array_to_string(flow, '>') as flow, array_to_string(error_flow, '>') as error_flow,
        (select string_agg(span_id, ',' order by span_id) from (select distinct span_id from trows t where t.tenant_id = f.tenant_id and t.trace_id = f.trace_id)) as span_ids
      from flows f""",
    "dependency_edges": "select tenant_id, caller, callee, n from edges",
    "causal_root": f"""
      select f.tenant_id, f.trace_id, f.root as root_cause_service, l.span_id as root_cause_span_id,
        array_to_string(list_reverse(f.error_flow), '>') as chain, {category('l.message')} as category
      from flows f join logs l on l.log_seq = f.root_row""",
    "long_trace_roots": f"""
      select t.tenant_id, t.trace_id, t.root as root_cause_service, r.span_id as root_cause_span_id, t.chain, t.flow,
        case when {category('r.message')} <> 'unknown' then {category('r.message')} else {category('g.message')} end as error_category,
        least(n.trace_rows, 200) as shown, n.trace_rows, n.trace_rows > 200 as trace_cut, n.epoch, n.log_seq
      from (
        select tenant_id, trace_id, string_agg(service, '>' order by first_seen) as flow,
          string_agg(service, '>' order by first_seen desc) filter (first_error is not null) as chain,
          arg_max(service, first_seen) filter (first_error is not null) as root,
          arg_max(first_error, first_seen) filter (first_error is not null) as root_row
        from ltsvc group by all) t
      join (select tenant_id, trace_id, count(*) as trace_rows, max(epoch) as epoch, max(log_seq) as log_seq from ltrows group by all) n
        using (tenant_id, trace_id)
      join ltroot f using (tenant_id, trace_id)
      join llogs r on r.log_seq = t.root_row join llogs g on g.log_seq = f.first_err""",
    "long_trace_steps": """
      select tenant_id, trace_id, log_seq, seq, ((epoch - lag(epoch) over w) * 1000)::double as gap_ms,
        ((epoch - first_value(epoch) over w) * 1000)::double as offset_ms
      from ltrows window w as (partition by tenant_id, trace_id order by log_seq)""",
    "long_trace_edges": """
      select tenant_id, caller, service as callee, count(*) as n from (
        select *, lag(service) over (partition by tenant_id, trace_id order by first_seen) as caller from ltsvc)
      where caller is not null group by all""",
    "error_fingerprints": "select tenant_id, trace_id, trigger_level, error_message as error_template, trigger_category as error_category from fails",
    "blast_radius": f"""
      select tenant_id, root, coalesce(array_to_string(affected, ','), '') as affected, {_round("n / greatest(coalesce(total, 0), 1)", 2)} as impact_score,
        case when n > 3 then 'high' when n > 1 then 'medium' else 'low' end as estimated_user_impact from blast""",
    "request_failures": """
      select tenant_id, trace_id, severity, service, 'Request failure in ' || service || ' (' || error_category || ') causing cascade: '
          || array_to_string(list_reverse(error_flow), ' -> ') as description, anomaly_score, error_message, error_category,
        array_to_string(list_reverse(error_flow), '>') as chain, array_to_string(flow, '>') as affected, impact from fails""",
    "ticket_windows": """
      select tenant_id, dedup_key, open_sec, n_events, least(n_events - 1, 4) as grouped, n_events - 1 - least(n_events - 1, 4) as dropped, log_seq
      from tickets""",
    "incident_numbers": "select 'TICK-' || lpad((num + 100)::varchar, 4, '0') as id, num + 100 as number, log_seq from tickets",
    "incidents_open": f"""
      select 'TICK-' || lpad(num::varchar, 4, '0') as id, num as number, tenant_id, service, severity, urgency, {PRIORITY} as priority,
        'identified' as state, '[' || upper(severity) || '] ' || service || ' - ' || substr(description, 1, 120) as title, anomaly_type,
        service || ',' || anomaly_type || ',' || severity as tags, least(n_events, 5) as similar_count, n_evidence, least(n_events, 5)::int as n_timeline,
        epoch as created_epoch, updated_epoch
      from (select t.*, {DESCRIPTION} as description,
              case when severity in ('critical', 'high') then 'high' when severity = 'medium' then 'medium' else 'low' end as urgency,
              (select count(*)::int from ev where ev.asked = t.log_seq) as n_evidence,
              (select max(epoch) from member m where m.tenant_id = t.tenant_id and m.dedup_key = t.dedup_key and m.open_sec = t.open_sec and m.rank <= 5) as updated_epoch
            from tickets t)""",
    "failure_incidents": """
      select 'TICK-' || lpad(num::varchar, 4, '0') as id, f.tenant_id, f.service,
        case when f.severity = 'critical' then 'P1' else 'P2' end as priority,
        substr('Request failure in ' || f.service || ': ' || error_category, 1, 200) as title,
        f.service || ',request_failure,' || f.severity || case when error_category <> 'unknown' then ',' || error_category else '' end as tags,
        error_category as error_type, least(n_events, 5)::int as n_traces, t.steps, least(n_events, 5) as similar_count, t.n_evidence
      from ftickets f join (
        select tenant_id, trace_id, count(*)::int as n_evidence, string_agg(
          case when level in ('ERROR', 'FATAL') then service || ' fails: ' || substr(message, 1, 80)
               else service || ': ' || substr(message, 1, 60) end, '|' order by log_seq) as steps
        from trows group by all) t using (tenant_id, trace_id)""",
    "incident_evidence": """
      select i.id, count(*) as n, min(ev.log_seq) as oldest, max(ev.log_seq) as newest, sum(ev.log_seq)::bigint as seq_sum
      from inc i join ev on ev.asked = i.log_seq group by i.id""",
    "similar_resolved": f"""
      select ask_id, similar_id, rank from (
        select a.id as ask_id, p.id as similar_id, row_number() over (partition by a.id order by p.created_epoch desc, p.id desc) as rank
        from (select id, tenant_id, service, {words('description')} as w from inc) a
        join (select id, tenant_id, service, created_epoch, {words("title || ' ' || description || ' ' || coalesce(root_cause, '')")} as w
              from inc where state in ('mitigated', 'resolved')) p
          on p.tenant_id = a.tenant_id and p.service = a.service and p.id <> a.id and list_has_any(a.w, p.w))
      where rank <= 3""",
    "recent_duplicates": f"""
      select log_seq, incident_id, created_epoch from (
        select a.log_seq, p.id as incident_id, p.created_epoch,
          row_number() over (partition by a.log_seq order by p.created_epoch desc, p.id desc) as rn
        from (select log_seq, tenant_id, service, epoch, {words(template('message'))} as w from logs where {ERR}) a
        join (select id, tenant_id, service, created_epoch, {words('title')} as tw, {words('description')} as dw from inc
              where state in ('identified', 'acknowledged', 'investigating')) p
          on p.tenant_id = a.tenant_id and p.service = a.service and p.created_epoch between a.epoch - 900 and a.epoch
          and (len(list_intersect(a.w, p.tw)) >= greatest(floor(len(a.w) * 0.6::double), 1)
            or len(list_intersect(a.w, p.dw)) >= greatest(floor(len(a.w) * 0.6::double), 1)))
      where rn = 1""",
    "routing": """
      select severity, platform, count(*) as n from (
        select severity, unnest(case severity when 'critical' then ['pagerduty', 'slack', 'servicenow'] when 'high' then ['jira']
          else ['pagerduty', 'jira', 'servicenow', 'opsgenie', 'slack', 'email'] end) as platform from inc)
      where platform in (select ['pagerduty', 'jira', 'servicenow', 'opsgenie', 'slack', 'email'][(r_regionkey + 1)::int] from region where r_regionkey <> 2)
      group by all""",
    "priority_matrix": "select severity, urgency, priority, count(*) as n from inc group by all",
    "incident_context": """
      select i.id, count(*) as n_logs, count(*) filter (l.level in ('ERROR', 'FATAL', 'CRITICAL')) as n_errors,
        min(l.epoch) filter (l.level in ('ERROR', 'FATAL', 'CRITICAL')) as first_epoch,
        arg_min(l.message, l.log_seq) filter (l.level in ('ERROR', 'FATAL', 'CRITICAL')) as first_error_message
      from inc i join logs l on l.tenant_id = i.tenant_id and l.service = i.service and l.epoch between i.created_epoch - 600 and i.created_epoch + 600
      group by i.id""",
    "correlated_traces": """
      select i.id, count(distinct l.trace_id) as n_traces from inc i join logs l on l.tenant_id = i.tenant_id and l.service = i.service
        and l.epoch between i.created_epoch - 600 and i.created_epoch + 600 and l.level in ('ERROR', 'FATAL', 'CRITICAL') group by i.id""",
    "burst_incidents": """
      select tenant_id, service, window_epoch, n_anomalies, n_services, round(top_score, 4) as top_score,
        case when n_services >= 3 or fatal then 'critical' when n_services >= 2 or top_score > 0.7 then 'high' else 'medium' end as severity
      from (select *, count(*) over (partition by tenant_id, window_epoch) as n_services from (
        select tenant_id, service, epoch - epoch % 300 as window_epoch, count(*) as n_anomalies, max(anomaly_score) as top_score,
          bool_or(anomaly_type = 'fatal_error') as fatal from rules group by all having count(*) >= 3))""",
    "fingerprints": "select tenant_id, dedup_key, count(*) as n from fail_keys group by all",
    "transitions": """
      select i.id, coalesce(r.last_act, i.state) as state, coalesce(i.ack, r.ack_at) as acknowledged_at, coalesce(i.mit, r.mit_at) as mitigated_at,
        coalesce(r.res_at, i.res) as resolved_at, coalesce(r.last_at, i.created_epoch) as updated_at,
        case when r.res_at is not null then r.res_at - i.created_epoch when i.number % 5 >= 4 then i.number % 50 * 180 end as mttr_seconds,
        (1 + coalesce(r.n, 0))::int as n_timeline,
        case when r.n is null then 'Anomaly detected: ' || substr(i.description, 1, 100) else 'State changed: ' || r.first_act || ' -> ' || r.last_act end as last_message
      from inc i left join (
        select id, count(*) as n, max(req_at) as last_at, arg_max(act, req_at) as last_act, arg_min(act, req_at) as first_act,
          min(req_at) filter (act = 'acknowledged') as ack_at, min(req_at) filter (act = 'mitigated') as mit_at, max(req_at) filter (act = 'resolved') as res_at
        from requests group by id) r using (id)""",
    "batch_transitions": """
      select ok, result, count(*) as n, max(pos) as last_pos from (
        select l.log_seq % 60 as pos, i.id is not null and l.log_seq % 9 <> 0 as ok,
          case when i.id is null then 'not found' when l.log_seq % 9 = 0 then 'invalid state: explode' else 'acknowledged' end as result
        from logs l left join inc i on i.log_seq = l.log_seq) group by all""",
    "batch_apply": """
      select 'state' as kind, id, arg_max(act, req_at) as detail, 1 + count(*) as n from requests group by id
      union all
      select 'audit', id, lag(act, 1, state) over (partition by id order by pos) || '>' || act || ' by ops', 1
      from requests join (select id, state from inc) using (id)
      union all
      select 'result', '', act, count(*) from requests group by act""",
    "patch": f"""
      select id, new_urgency as urgency, case when p then {PRIORITY.replace('urgency', 'new_urgency')} else priority end as priority,
        case when p then 'u' || number::varchar end as assigned_to,
        service || ',' || anomaly_type || ',' || severity || case when p then ',patched' else '' end as tags,
        case when p then 'note,trace' else 'trace' end as custom_names, case when p then 3 else 1 end as n_timeline,
        case when p then created_epoch + 500 else created_epoch end as updated_epoch,
        case when p then 'urgency: ' || urgency || ' -> low' else 'Anomaly detected: ' || substr(description, 1, 100) end as last_message
      from (select *, number % 4 = 1 as p, case when number % 4 = 1 then 'low' else urgency end as new_urgency from inc)""",
    "patch_audit": """
      select id as incident_id, 'field_change' as action, 'ops' as actor, 'urgency' as field, urgency as old, 'low' as new from inc where number % 4 = 1
      union all select id, 'field_change', 'ops', 'assigned_to', 'None', 'u' || number::varchar from inc where number % 4 = 1""",
    "timeline_notes": """
      select id as incident_id, 0::bigint as pos, created_epoch as at_epoch, 'state_change' as type, 'identified' as state,
        'Anomaly detected: ' || substr(description, 1, 100) as message, 'system' as actor from inc
      union all select id, 1, created_epoch + 60, 'note', state, 'note on ' || service, 'ops' from inc""",
    "audit_latest": """
      select incident_id, seq, action, rank from (
        select tenant_id || '/' || service as incident_id, log_seq as seq, event_type as action,
          row_number() over (partition by tenant_id, service order by log_seq desc) as rank from logs) where rank <= 3""",
    "retention_purge": f"""
      select case when created_epoch < {T0 + 600} then 'expired' else 'kept' end as what, service, count(*) as n from inc group by all""",
    "search_logs": f"""
      select log_seq, epoch, service, level, message from logs
      where tenant_id = 't0' and service = 'svc-1' and level in ('ERROR', 'FATAL') and epoch between {T0} and {T0 + 86400}
        and list_has_any({words("message || ' ' || service")}, ['timeout', 'deadlock', 'handler'])
      order by epoch desc, log_seq desc limit 100""",
    "search_fulltext": f"""
      select doc_id, source, n_chars from documents where list_has_any({words("text || ' ' || source")}, ['license', 'error', 'password'])""",
    "search_60pct": f"""
      select doc_id, lang from documents where len(list_intersect({words('text')}, ['the', 'data', 'and', 'with', 'error'])) >= 3""",
    "search_anomalies": """
      select log_seq, epoch, service, severity, round(anomaly_score, 4) as anomaly_score, anomaly_type from rules
      where tenant_id = 't1' and severity = 'critical' order by epoch desc, event_id desc limit 100""",
    "page_incidents": f"""
      select id, number, state, severity, title from inc where tenant_id = 't0' and severity in ('critical', 'high')
        and state not in ('resolved', 'mitigated')
        and list_has_any({words("title || ' ' || description || ' ' || service || ' ' || anomaly_type || ' ' || severity")}, ['memory', 'timeout'])
      order by number, id desc limit 20 offset 20""",
    "incident_get": """
      select id, tenant_id, service, state, severity, title from inc where id = (select min(id) from inc where tenant_id = 't1')""",
    "page_totals": """
      select count(*) as total, 20 as "limit", 40 as "offset", 60 < count(*) as has_more from inc where tenant_id = 't0' and state = 'resolved'""",
    "latest_logs": "select log_seq, epoch, service, level, message from logs order by epoch desc, log_seq desc limit 100",
    "latest_errors": f"select log_seq, epoch, service, level, message from logs where {ERR} order by epoch desc, log_seq desc limit 50",
    "overview_24h": f"""
      select count(*) as total_logs, round(count(*) filter ({ERR}) / count(*) * 100, 6) as error_rate, count(distinct service) as service_count,
        (select count(*) from rules where epoch between {T0} and {T0 + 86400}) as anomaly_count
      from logs where epoch between {T0} and {T0 + 86400}""",
    "log_facets": _facet("logs", {"level": 10, "service": 20}),
    "incident_facets": _facet("inc", {"state": 10, "severity": 10, "urgency": 10, "priority": 10, "service": 20}),
    "mttr": _time_to(),
    "mttr_by_service": _time_to("service = 'svc-1' and severity = 'high'"),
    "mean_mttr": """
      select round(avg(m) filter (m > 0), 4) as mean_mttr_seconds, count(*) filter (m > 0) as n
      from (select case when number % 5 >= 4 then number % 50 * 180 end as m from inc)""",
    "distribution": """
      select 'level' as kind, level as value, count(*) as n from logs group by all
      union all select 'service', service, count(*) from logs group by all
      union all select 'traces', 'distinct', count(distinct trace_id) from logs""",
    "bar_shares": """
      select service, n, round(n / greatest(max(n) over (), 1), 6) as share from (
        select service, count(*) as n from logs group by all order by n desc, service limit 8)""",
    "stage_totals": f"""
      select received as ingest, produced as stream, produced as process, 0::bigint as process_errors, indexed as "index", a as detect, produced as enrich
      from (select count(*) filter (event_type = 'error') as received, count(*) filter (event_type = 'click') as produced,
              count(*) filter (event_type = 'view') as indexed, count(*) filter ({ERR}) as a from logs)""",
    "lag_sum": """
      select event_type as group_id, 'topic-' || (user_id % 3)::varchar as topic, sum(log_seq % 13)::bigint as lag from logs group by all""",
    "tenant_quota": """
      select tenant_id, epoch - epoch % 60 as minute_epoch, count(*) as requests, count(*) > 120 as over_quota from logs group by all""",
    "api_key_resolve": """
      select o_orderkey as request_id, 'k' || c_custkey::varchar as key_prefix, c_nationkey::bigint as project_id,
        't' || n_nationkey::varchar as tenant_id, 'org' || n_regionkey::varchar as org_id
      from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
      where o_orderkey % 11 <> 0 and c_custkey % 7 <> 0""",
    "api_key_reject": """
      select o_orderkey as request_id, 'key-' || (case when o_orderkey % 11 = 0 then -o_custkey else o_custkey end)::varchar as api_key
      from orders left join customer on c_custkey = o_custkey and o_orderkey % 11 <> 0 and c_custkey % 7 <> 0 where c_custkey is null""",
    "validate_logs": """
      select count(*) as total, true as valid, '' as missing_required, '' as missing_recommended,
        count(*) filter (level in ('VERBOSE', 'TRACE')) as bad_levels, count(*) as readable, count(*) filter (bad_time) as bad_timestamps from flatf""",
    "flat_upload": """
      select service, case when level = '' then 'INFO' else level end as level, 'dev-local' as tenant_id, bad_time, count(*) as n,
        min(epoch) filter (not bad_time) as first_epoch, max(epoch) filter (not bad_time) as last_epoch from flatf group by all""",
    "schema_check": """
      select unnest(['missing:ts', 'missing:log_id', 'missing:level', 'missing:message', 'missing:service', 'missing:tenant_id', 'value:level', 'range:anomaly_score']) as rule,
        unnest([0, 0, 0, 0, count(*) filter (log_seq % 29 = 0), 0, count(*) filter (log_seq % 17 = 0), count(*) filter (log_seq % 31 = 0)]) as broken,
        count(*) as total from logs""",
    "incident_check": """
      select unnest(['missing:id', 'missing:created_at', 'missing:title', 'missing:severity', 'missing:state', 'missing:service', 'missing:tenant_id',
          'value:severity', 'value:state', 'value:urgency', 'value:priority', 'range:anomaly_score', 'unknown:number']) as rule,
        unnest([0, 0, count(*) filter (number % 7 = 0), 0, 0, 0, 0, 0, count(*) filter (number % 3 = 0), 0, count(*) filter (number % 5 = 0), 0,
          count(*)]) as broken, count(*) as total from inc""",
    "schema_rejects": """
      select case when log_seq % 5 = 0 and log_seq % 7 = 0 then 'value:severity,range:anomaly_score' when log_seq % 5 = 0 then 'value:severity'
        else 'range:anomaly_score' end as broken, count(*) as n from rules where log_seq % 5 = 0 or log_seq % 7 = 0 group by all""",
    "export_json": """
      select id, title, state, created_epoch, service || ',' || anomaly_type || ',' || severity as tags, trace_id as trace from inc""",
    "upload_encode": "select log_seq, epoch, level, message, service, trace_id, 'h' || service as host, tenant_id as region from logs",
    "export_csv": f"""
      select form, id, array_to_string(list_transform(cells, lambda c: case when regexp_matches(c, '[,"\n]') then '"' || replace(c, '"', '""') || '"' else c end), ',') as line
      from (
        select 'short' as form, id, [id, title, severity, state, service, {_iso('created_epoch')}, {_iso('created_epoch')}] as cells from inc
        union all select 'long', id, [id, title, severity, state, service, priority, {_iso('created_epoch')}, '',
          case when number % 5 >= 4 then (number % 50 * 180)::varchar else '' end, coalesce(root_cause, '')] from inc)
      union all select 'markdown', id, '| ' || array_to_string([id, title, severity, state, service, {_iso('created_epoch')}], ' | ') || ' |' from inc""",
    "archive_roundtrip": "select tenant_id, service, level, count(*) as n, sum(log_seq)::bigint as seq_sum from logs group by all",
    "file_formats": """
      select 'csv' as format, level, service, count(*) as n, sum(length(message))::bigint as chars from logs group by all
      union all select 'ndjson', level, service, count(*), sum(length(message))::bigint from logs group by all
      union all select 'text', 'INFO', 'unknown', count(*), sum(length(message))::bigint from logs""",
    "typed_rejects": """
      select case when reasons = '' then 'stored' else reasons end as result, count(*) as n,
        sum(case when reasons = '' then http_status else 0 end)::bigint as sum
      from (select *, concat_ws(', ', case when log_seq % 97 = 5 then 'ts: not a timestamp' end,
          case when log_seq % 89 = 7 then 'http_status: not a int' end, case when log_seq % 101 = 3 then 'log_id: missing' end) as reasons from logs)
      group by all""",
    "compact_table": """
      select strftime(date '2024-01-01' + (log_seq % 3)::int, '%Y-%m-%d') as day, count(*) as n, sum(log_seq)::bigint as seq_sum,
        sum(length(message))::bigint as chars, true as packed from logs group by all""",
    "json_array_upload": """
      select case when bad then 'parse_error' else 'read' end as result, case when bad then '-' else level end as level, count(*) as n,
        sum(case when bad then length('{"message": nope ') + length(service) + 1 else length(message) + 9 end)::bigint as chars
      from (select *, log_seq % 50 = 7 as bad from logs) group by all""",
    "daily_upsert": """
      select 'logs-' || strftime(make_timestamp(epoch * 1000000), '%Y.%m.%d') as table_name, level, count(*) as n, count(*) as n_keys from logs group by all""",
    "anomaly_store": """
      select log_seq, case when log_seq % 2 = 0 then event_id
          else substr(sha256('anomaly|' || service || '|' || (epoch * 1000000)::varchar), 1, 20) end as store_key,
        strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d') as day from rules""",
}
ORACLE: dict[str, str] = {name: sql(body) for name, body in _BODIES.items()}
