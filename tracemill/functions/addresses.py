"""IP addresses and networks as bit strings, so that a network is a plain prefix.

A valid IPv4 address becomes 32 and a valid IPv6 address 128 characters of ``0`` and ``1``;
anything else is null.  Equal addresses have equal bits whatever their spelling.

The functions take and give SQL text: one parsed expression is built far faster from Python
than the same tree of Column calls.
"""

from __future__ import annotations

from tracemill.functions.sqltext import bound

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"r'^{_OCTET}([.]{_OCTET}){{3}}$'"


def _v4_bits(text: str) -> str:
    return f"if({text} rlike {_V4}, array_join(transform(split({text}, '[.]'), o -> lpad(bin(cast(o as bigint)), 8, '0')), ''), null)"


def _v6_bits(text: str) -> str:
    # an IPv4 tail stands for the last two groups
    tail_groups = "concat(head, lower(conv(left(tail, 16), 2, 16)), ':', lower(conv(right(tail, 16), 2, 16)))"
    tail = bound(_v4_bits(f"regexp_extract({text}, '[0-9.]+$', 0)"), "tail", f"if(tail is null, null, {tail_groups})")
    plain = f"if(contains({text}, '.'), {bound(f'regexp_replace({text}, {chr(39)}[0-9.]+${chr(39)}, {chr(39)}{chr(39)})', 'head', tail)}, {text})"
    words = "filter(split(h, ':'), g -> g <> '' or h <> '')"
    filled = "if(size(w[0]) + size(w[1]) < 8, concat(w[0], array_repeat('0', 8 - size(w[0]) - size(w[1])), w[1]), null)"
    halves = bound(f"transform(p, h -> {words})", "w", f"case size(w) when 1 then w[0] when 2 then {filled} end")
    groups = bound(f"split(lower({plain}), '::', -1)", "p", halves)
    good = "size(g8) = 8 and forall(g8, g -> g rlike '^[0-9a-f]{1,4}$')"
    return bound(groups, "g8", f"if({good}, array_join(transform(g8, g -> lpad(conv(g, 16, 2), 16, '0')), ''), null)")


def address_bits(text: str) -> str:
    return bound(f"trim({text})", "t", f"if(contains(t, ':'), {_v6_bits('t')}, {_v4_bits('t')})")


def address_width(text: str) -> str:
    return f"if(contains({text}, ':'), 128, 32)"


def network_length(text: str) -> str:
    """Prefix length of ``address``, ``address/length`` or ``address/netmask``; null when invalid."""
    ones = "length(replace(m, '0', ''))"
    by_mask = f"case when m rlike '^1+0*$' then {ones} when m rlike '^0+1*$' then 32 - {ones} end"
    suffix = "split_part(c, '/', 2)"
    length = (
        f"case when not contains(c, '/') then {address_width('c')} when {suffix} rlike '^[0-9]{{1,3}}$' then cast({suffix} as int)"
        f" when not contains(c, ':') then {bound(_v4_bits(suffix), 'm', by_mask)} end"
    )
    return bound(f"trim({text})", "c", bound(length, "n", f"if(n <= {address_width('c')}, n, null)"))


def network_prefix(text: str, length: str) -> str:
    """The leading bits of a network of the given prefix length; host bits are ignored."""
    return f"left({address_bits(f'split_part(trim({text}), {chr(39)}/{chr(39)}, 1)')}, {length})"


def valid_network(text: str) -> str:
    return bound(network_length(text), "len", f"len is not null and {network_prefix(text, 'len')} is not null")
