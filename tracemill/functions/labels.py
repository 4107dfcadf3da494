"""Message names, status, correlation and phase of a packet, as SQL text over its fields.

``g`` is a struct column that ``with_message_fields`` builds: one text per field below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import tables
from tracemill.functions.sqltext import bound, sql_map

# fields read at the top of the message, and fields found anywhere below it
TOP_FIELDS = [
    "message_name", "diameter.Result-Code", "diameter.result_code", "diameter.flags.request",
    "diameter.flags.request_tree", "command_code", "diameter.cmd.code", "http.response.code",
    "http2.headers.status", "http2.headers.method", "http2.headers.path", "gtpv2.message_type",
    "pfcp.message_type", *tables.CORRELATION_FIELDS,
]
DEEP_FIELDS = {
    "gtpv2_cause": ["gtpv2.cause"],
    "nas_eps_type": ["nas_eps.message_type"],
    "nas_5gs_type": ["nas_5gs.mm.message_type", "nas_5gs.sm.message_type", "nas-5gs.mm.message_type", "nas-5gs.sm.message_type"],
    "ngap_procedure": ["ngap.procedureCode"],
    "dns_response": ["dns.flags.response"],
    "dns_name": ["dns.qry.name"],
    "dns_type": ["dns.qry.type"],
    "dns_rcode": ["dns.flags.rcode"],
    "dns_answers": ["dns.count.answers"],
}


def any_int(text: str) -> str:
    """Integer written in any base, or a float cut to an integer; null outside the 64-bit integers, the type of all counts here."""
    number = bound(
        f"lower(trim({text}))",
        "t",
        "case when t rlike '^[+-]?[0-9]+$' then try_cast(t as bigint)"
        " when t rlike '^0x0*[0-9a-f]{1,16}$' then try_cast(conv(substr(t, 3), 16, 10) as bigint)"
        " when t rlike '^0b0*[01]{1,64}$' then try_cast(conv(substr(t, 3), 2, 10) as bigint)"
        " when t rlike '^0o0*[0-7]{1,21}$' then try_cast(conv(substr(t, 3), 8, 10) as bigint)"
        " when t rlike '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$' then try_cast(try_cast(t as double) as bigint) end",
    )
    # a packet has few of the fields that numbers are read from
    return f"if({text} is null, null, {number})"


def flag(text: str) -> str:
    word = f"lower(trim({text}))"
    return f"case when {word} in ('1', 'true', 'yes', 'set') then true when {word} in ('0', 'false', 'no', 'unset') then false end"


def filled(text: str) -> str:
    return f"nullif(trim({text}), '')"


def contains_any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def with_message_fields(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Add map ``g``: every field that the label rules read, taken from the leaves of the message."""
    from tracemill.operators.decode import deep_field, quoted

    deep_names = [n for names in DEEP_FIELDS.values() for n in names]
    few = f"filter({fields}, l -> l.path in ({quoted(TOP_FIELDS)}) or l.key in ({quoted(deep_names)}))"
    top = f"filter(_few, l -> l.path in ({quoted(TOP_FIELDS)}))"
    # the first value of a repeated field counts where a text is wanted; as a number the field has none
    repeated = "exists(slice(t, 1, n), o -> o.path = l.path)"
    first = bound(top, "t", f"filter(t, (l, n) -> not {repeated})")
    many = bound(top, "t", f"array_distinct(transform(filter(t, (l, n) -> {repeated}), l -> struct(concat('many:', l.path) as key, 'x' as value)))")
    deep = ", ".join(f"struct('{out}' as key, {deep_field(names, '_few')} as value)" for out, names in DEEP_FIELDS.items())
    deep = f"if(exists(_few, l -> l.key in ({quoted(deep_names)})), filter(array({deep}), e -> e.value is not null), array())"
    entries = f"concat(transform({first}, l -> struct(l.path as key, l.value as value)), {many}, {deep})"
    return df.withColumn("_few", F.expr(few)).withColumn("g", F.expr(f"map_from_entries({entries})")).drop("_few")


def _numbers() -> dict[str, str]:
    top = lambda *names: "coalesce(" + ", ".join(f"if(g['many:{n}'] is null, nullif(g['{n}'], ''), null)" for n in names) + ")"
    return {
        "result": any_int(top("diameter.Result-Code", "diameter.result_code")),
        "command": any_int(top("command_code", "diameter.cmd.code")),
        "http": any_int(top("http.response.code", "http2.headers.status")),
        "gtp": any_int(top("gtpv2.message_type")),
        "cause": any_int("g['gtpv2_cause']"),
        "eps": any_int("g['nas_eps_type']"),
        "fgs": any_int("g['nas_5gs_type']"),
        "ngap": any_int("g['ngap_procedure']"),
        "dns_response": any_int("g['dns_response']"),
        "dns_type": any_int("g['dns_type']"),
        "dns_rcode": any_int("g['dns_rcode']"),
        "dns_answers": any_int("g['dns_answers']"),
        "request": f"coalesce({flag("g['diameter.flags.request']")}, {flag("g['diameter.flags.request_tree']")})",
    }


def diameter_label(code: str, request: str) -> str:
    name = f"{sql_map(tables.DIAMETER_COMMANDS)}[{code}]"
    kind = f"case when {request} then ' Request' when not {request} then ' Answer' else '' end"
    return f"coalesce(concat({name}, {kind}, ' (', {code}, ')'), concat('Diameter Command ', {code}))"


def gtpv2_request(code: str) -> str:
    return f"{code} in ({', '.join(map(str, tables.GTPV2_REQUESTS))})"


def gtpv2_label(code: str) -> str:
    name = f"{sql_map(tables.GTPV2_MESSAGES)}[{code}]"
    return f"coalesce(concat({name}, if({gtpv2_request(code)}, ' Request (', ' Response ('), {code}, ')'), concat('GTPv2 Message ', {code}))"


def gtpv2_cause(code: str) -> str:
    name = f"if({code} <= 17, null, {sql_map(tables.GTPV2_CAUSES)}[{code}])"
    return f"concat(' · Cause ', {code}, coalesce(concat(' (', {name}, ')'), ''))"


def http_label(code: str) -> str:
    return f"concat('HTTP ', {code}, coalesce(concat(' ', {sql_map(tables.HTTP_PHRASES)}[{code}]), ''))"


def ngap_label(code: str) -> str:
    return f"coalesce(concat({sql_map(tables.NGAP_PROCEDURES)}[{code}], ' (', {code}, ')'), concat('NGAP Procedure ', {code}))"


def nas_label(code: str, variant: str) -> str:
    table = tables.NAS_5GS_MESSAGES if variant == "5gs" else tables.NAS_EPS_MESSAGES
    digits = f"lower(hex({code}))"
    return (
        f"coalesce({sql_map(table)}[{code}],"
        f" concat('NAS-{variant.upper()} 0x', lpad({digits}, greatest(2, length({digits})), '0')))"
    )


def dns_label(name: str, qtype: str, response: str, rcode: str, answers: str) -> str:
    kind = f"coalesce({sql_map(tables.DNS_TYPES)}[{qtype}], concat('TYPE', {qtype}), '')"
    base = f"trim(concat('DNS ', {kind}, ' ', coalesce(rtrim('.', {name}), '')))"
    code = f"coalesce({sql_map(tables.DNS_RCODES)}[{rcode}], concat('rcode ', {rcode}))"
    outcome = (
        f"case when not {response} then '' when coalesce({rcode}, 0) <> 0 then concat(' · ', {code})"
        f" when coalesce({answers}, 0) <> 0 then concat(' · NOERROR (', {answers}, ' ans)') else ' · NOERROR' end"
    )
    return f"concat({base}, {outcome})"


def event_name(protocol: str = "top_protocol", stack: str = "frame_protocols") -> str:
    """SQL text over ``g`` and ``n`` (its numbers): the first rule that names the message."""
    given = filled("g['message_name']")
    outcome = "if(n.result is null, '', concat(' · Result ', n.result))"
    is_dns = f"n.dns_response is not null or {filled("g['dns_name']")} is not null"
    dns_answer = "coalesce(n.dns_response = 1, false) or (n.dns_response is null and coalesce(n.dns_rcode, 0) <> 0)"
    method, path = filled("g['http2.headers.method']"), filled("g['http2.headers.path']")
    stack_label = f"try_element_at(filter(transform({stack}, p -> {sql_map(tables.STACK_LABELS)}[lower(p)]), x -> x is not null), -1)"
    return f"""case
      when {given} is not null then concat({given}, if(contains(lower({given}), 'result'), '', {outcome}))
      when n.command is not null then concat({diameter_label('n.command', 'n.request')}, if(coalesce(n.request, false), '', {outcome}))
      when n.http is not null then {http_label('n.http')}
      when {path} is not null then concat_ws(' ', {method}, {path})
      when n.gtp is not null then concat({gtpv2_label('n.gtp')},
        if({gtpv2_request('n.gtp')} or n.cause is null, '', {gtpv2_cause('n.cause')}))
      when n.eps is not null then {nas_label('n.eps', 'eps')}
      when n.fgs is not null then {nas_label('n.fgs', '5gs')}
      when n.ngap is not null then {ngap_label('n.ngap')}
      when nullif(g['pfcp.message_type'], '') is not null then g['pfcp.message_type']
      when {is_dns} then {dns_label(filled("g['dns_name']"), 'n.dns_type', f'({dns_answer})', 'n.dns_rcode', 'n.dns_answers')}
      else coalesce({stack_label}, upper(coalesce({protocol}, 'signal')))
    end"""


def event_status(name: str = "message_name", anomalies: str = "anomalies") -> str:
    """SQL text: error, response or request."""
    lowered = f"lower({name})"
    return f"""case
      when n.result >= 3000 or n.http >= 400 or n.cause >= 64 or n.dns_rcode <> 0 then 'error'
      when n.dns_response = 1 then 'response'
      when n.dns_response = 0 then 'request'
      when n.request then 'request'
      when not n.request then 'response'
      when size({anomalies}) > 0 then 'error'
      when {contains_any(lowered, tables.ERROR_WORDS)} then 'error'
      when {contains_any(lowered, tables.RESPONSE_WORDS)} then 'response'
      else 'request'
    end"""


def correlation_id() -> str:
    return "coalesce(" + ", ".join(f"concat('{n}:', {filled(f"g['{n}']")})" for n in tables.CORRELATION_FIELDS) + ")"


def with_labels(df: DataFrame, protocol: str = "top_protocol", stack: str = "frame_protocols", anomalies: str = "anomalies") -> DataFrame:
    """Add ``message_name``, ``status`` and ``correlation_id`` to packets that have ``g``."""
    numbers = ", ".join(f"{sql} as {name}" for name, sql in _numbers().items())
    rows = df.withColumn("n", F.expr(f"struct({numbers})"))
    rows = rows.withColumn("message_name", F.expr(event_name(protocol, stack)))
    return rows.withColumn("status", F.expr(event_status("message_name", anomalies))).withColumn(
        "correlation_id", F.expr(correlation_id())
    ).drop("n")


# ------------------------------------------------------------------ names, phases
def base_name(name: str = "message_name") -> str:
    """Name in lower case without its request or response ending."""
    lowered = f"lower(trim({name}))"
    cuts = " ".join(
        f"when endswith(b, '{e}') then trim(left(b, length(b) - {len(e)}))" for e in tables.NAME_ENDINGS
    )
    return bound(lowered, "b", f"case {cuts} else b end")


def is_response(name: str = "message_name", status: str = "status") -> str:
    return f"({status} = 'response' or {contains_any(f'lower(trim({name}))', tables.RESPONSE_HINTS)})"


def profile_family(profile: str) -> str:
    """Family of a profile name, for lanes and phases."""
    lowered = profile.lower()
    for family in ("5g", "lte", "2g3g"):
        if lowered.startswith(family):
            return family
    return "ims" if "ims" in lowered or "voice" in lowered else "generic"


def phase(family: str, name: str = "message_name", status: str = "status") -> str:
    """SQL struct (kind, label)."""
    rules = tables.FAMILY_PHASES.get(family, []) + tables.GENERAL_PHASES
    show = lambda kind, label: f"struct('{kind}' as kind, '{label}' as label)"
    cases = " ".join(f"when {contains_any(f'lower({name})', words)} then {show(kind, label)}" for words, kind, label in rules)
    return f"case {cases} when {status} = 'error' then {show('failure', 'Failure / Retry')} else {show('signaling', 'Signaling')} end"


# ------------------------------------------------------------------ endpoints of a flow
def endpoint_id(e: str) -> str:
    """alias before ip before hostname before role."""
    parts = ", ".join(f"concat('{k}:', nullif({e}.{k}, ''))" for k in ("alias", "ip", "hostname", "role"))
    return f"coalesce({parts}, 'unknown')"


def endpoint_label(e: str) -> str:
    ip, role = filled(f"{e}.ip"), filled(f"{e}.role")
    name = f"coalesce(nullif({filled(f'{e}.hostname')}, coalesce({ip}, '')), nullif({filled(f'{e}.alias')}, coalesce({ip}, '')))"
    return f"coalesce(concat({name}, ' (', {ip}, ')'), {ip}, {name}, {role}, 'unknown')"


def epoch_time(text: str) -> str:
    """Epoch seconds or ISO text to a timestamp."""
    return (
        f"if(trim({text}) rlike '^[+-]?[0-9]+([.][0-9]*)?$',"
        f" timestamp_micros(cast(floor(try_cast(trim({text}) as decimal(20,9)) * 1000000) as bigint)), try_to_timestamp(nullif(trim({text}), '')))"
    )
