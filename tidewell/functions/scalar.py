"""Scalar functions by name, as Columns, with the engine's own edge cases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def _log(f):
    """Logarithms of zero are -Infinity and of negative numbers NaN, not null."""
    return lambda x: F.when(x > 0, f(x.cast("double"))).when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN))


def _whole(f):
    """A rounding that keeps doubles double."""
    return lambda x: f(x).cast("double")


def int_divide(a: Column, b: Column) -> Column:
    """Truncating; division by zero is 0."""
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0)))).cast("long")


def int_modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(a % F.nullif(b, F.lit(0))).cast("long")


def truncate(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def round_to(x: Column, nearest: float = 1.0) -> Column:
    """To a multiple; halves go up."""
    inverse = F.lit(1.0 / nearest)
    return F.floor(x * inverse + F.lit(0.5)) / inverse


def clamp(x: Column, low: float, high: float) -> Column:
    if low > high:
        return F.lit(None).cast("double")
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


MATH = {
    "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "exp": F.exp, "ln": _log(F.ln), "log2": _log(F.log2), "log10": _log(F.log10), "log": lambda x, base: _log(F.ln)(x) / F.ln(base),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)).when(x < 0, F.lit(_NAN)), "pow": F.pow,
    "floor": _whole(F.floor), "ceil": _whole(F.ceil), "round": lambda x: F.round(x, 0), "round_to": round_to, "truncate": truncate,
    "row_max": F.greatest, "clamp": clamp, "clamp_min": lambda x, low: F.when(F.isnan(x), x).otherwise(F.greatest(x, F.lit(float(low)))), "clamp_max": lambda x, high: F.when(F.isnan(x), x).otherwise(F.least(x, F.lit(float(high)))),
    "rad": F.radians, "deg": F.degrees, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "sgn": F.signum,
    "if": lambda condition, a, b: F.when(condition, a).when(~condition, b),
}


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """From 0; past the end is empty."""
    return F.substring(s, start + 1, length if length is not None else 1 << 30)


def pad(s: Column, size: int, fill: str, left: bool) -> Column:
    if size <= 0 or not fill:
        return s
    return (F.lpad if left else F.rpad)(s, size, fill)


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """Null where nothing matches."""
    return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def yes(condition: Column) -> Column:
    return F.when(condition, "true").otherwise("false")


def literal_split(s: Column, separator: str) -> Column:
    return F.split(s, r"\Q" + separator.replace(r"\E", r"\E\\E\Q") + r"\E", -1)


def split_part(s: Column, separator: str, i: int) -> Column:
    return F.lit("") if i < 1 else F.split_part(s, F.lit(separator), F.lit(i))


def split_to_map(s: Column, between: str, inside: str) -> Column:
    """Text of a JSON object; keys as they come, repeated ones stay."""
    parts = F.filter(literal_split(s, between), lambda p: p != "")
    pair = F.transform(parts, lambda p: F.concat(F.lit('"'), F.substring_index(p, inside, 1), F.lit('":"'), F.when(F.contains(p, F.lit(inside)), F.split_part(p, F.lit(inside), F.lit(2))).otherwise(""), F.lit('"')))
    return F.when(F.length(s) < 2, s).otherwise(F.concat(F.lit("{"), F.concat_ws(",", pair), F.lit("}")))


STRINGS = {
    "lpad": lambda s, n, p: pad(s, n, p, True), "rpad": lambda s, n, p: pad(s, n, p, False), "replace": lambda s, a, b="": F.replace(s, F.lit(a), F.lit(b)), "reverse": F.reverse,
    "split": lambda s, sep: F.to_json(literal_split(s, sep)), "split_part": split_part, "split_to_map": split_to_map, "str": lambda s, sub: F.contains(s, F.lit(sub)),
    "strlen": lambda s: F.octet_length(s).cast("long"), "position": lambda s, sub: F.instr(s, sub).cast("long"), "strpos": lambda s, sub: F.instr(s, sub).cast("string"), "substr": substr,
    "levenshtein_distance": lambda a, b: F.levenshtein(a, b).cast("string"), "regexp_extract": regexp_extract, "regexp_like": lambda s, p: yes(F.rlike(s, F.lit(p))),
    "to_lower": F.lower, "to_upper": F.upper,
}

def _as_int(x: Column, kind: str) -> Column:
    return x.cast("int").cast("long") if kind == "boolean" else F.when(F.rlike(x, F.lit(r"^[+-]?\d+$")), x.try_cast("long")) if kind == "string" else truncate(x.cast("double")).cast("long")


def _as_bool(x: Column, kind: str) -> Column:
    """Null, zero, "0" and "" are false, all else is true."""
    true = (x != "0") & (x != "") if kind == "string" else x if kind == "boolean" else x != 0
    return F.coalesce(true, F.lit(False))


def _as_text(x: Column, kind: str) -> Column:
    """Doubles as plain decimals, without an exponent or a trailing zero."""
    if kind not in ("double", "float"):
        return x.cast("string")
    plain = x.cast("decimal(38,10)").cast("string")
    shortest = F.when(x.cast("string").contains("E"), F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))
    return F.when(F.isnan(x), "NaN").when(x == _INF, "+Inf").when(x == -_INF, "-Inf").otherwise(shortest)


#: Casts by type; they get the column and its type's name.
CASTS = {
    "int64": _as_int, "int": _as_int, "integer": _as_int, "float64": lambda x, kind: x.cast("int").cast("double") if kind == "boolean" else x.try_cast("double"),
    "bool": _as_bool, "boolean": _as_bool, "string": _as_text,
}
CASTS["float"] = CASTS["float64"]


def type_name(kind: str) -> str:
    """The engine's name of a Spark type."""
    return {"string": "string", "boolean": "bool", "double": "float64", "float": "float64"}.get(kind, "int64" if kind in ("bigint", "int", "smallint", "tinyint") else "float64" if kind.startswith("decimal") else kind)


#: Characters between the words of a text, for searches.
SEPARATORS = r"[\s,;:.!?'\"()\[\]{}<>/\\|=&*+@#$%^~`-]"


def matches_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase stands at the bounds of words."""
    words = r"\s+".join(re.escape(w) for w in phrase.split())
    return F.rlike(text, F.lit(f"(^|{SEPARATORS}){words}({SEPARATORS}|$)")) if words else F.lit(False)


def like_token(text: Column, pattern: str) -> Column:
    """LIKE over the words of a text: ``_`` is one character, ``%`` any; without a
    wildcard, or with one in front, it is a search for the rest as a word."""
    if not re.search("[_%]", pattern) or pattern[0] in "_%":
        return matches_phrase(text, re.sub("[_%]", "", pattern))
    body = "".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in pattern)
    return F.exists(F.split(text, SEPARATORS + "+"), lambda w: F.rlike(w, F.lit(f"^{body}$")))


URLS = {
    "url_decode": F.try_url_decode, "url_encode": F.url_encode, "url_extract_host": lambda u: F.try_parse_url(u, F.lit("HOST")), "url_extract_path": lambda u: F.try_parse_url(u, F.lit("PATH")),
    "url_extract_protocol": lambda u: F.try_parse_url(u, F.lit("PROTOCOL")), "url_extract_query": lambda u: F.try_parse_url(u, F.lit("QUERY")), "url_extract_fragment": lambda u: F.try_parse_url(u, F.lit("REF")),
    "url_extract_parameter": lambda u, name: F.try_url_decode(F.try_parse_url(u, F.lit("QUERY"), F.lit(name))), "url_extract_port": lambda u: F.nullif(F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), r":(\d+)$", 1), F.lit("")),
}

def json_path(path: str) -> str | None:
    """A path that starts at ``$`` and names at least one step."""
    return path if re.fullmatch(r"\$(\.[^.]+)+", path) else None


def json_extract(s: Column, path: str) -> Column:
    """A value as JSON text, a string without its quotes; the first step of an
    array's path is its place."""
    if json_path(path) is None:
        return F.lit(None).cast("string")
    first, *rest = path[2:].split(".")
    if first.isdigit():
        inside = "".join("." + r for r in rest)
        return F.when(F.ltrim(s).startswith("["), F.get_json_object(s, f"$[{first}]{inside}")).otherwise(F.get_json_object(s, path))
    return F.get_json_object(s, path)


JSON = {
    "json_extract": json_extract,
    "json_extract_scalar": lambda s, path: F.get_json_object(s, path),
    "json_object": lambda *pairs: F.to_json(F.named_struct(*(x for k, v in zip(pairs[::2], pairs[1::2]) for x in (F.lit(k), v))), {"ignoreNullFields": "false"}),
}


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number, null where it isn't one."""
    ok = F.rlike(ip, F.lit(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"))
    parts = F.split(ip, r"\.")
    value = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(ok, value)


def ip_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, 8 * (3 - i)).bitwiseAND(255).cast("string") for i in range(4)))


def ip_mask(ip: Column, bits: int) -> Column:
    n = ip_number(ip)
    return F.when(n.isNotNull(), ip_text(n.bitwiseAND(((1 << 32) - 1) ^ ((1 << 32 - bits) - 1))))


def in_subnet(ip: Column, cidr: str) -> Column:
    net, _, bits = cidr.partition("/")
    octets = [int(x) for x in net.split(".")]
    size = 1 << (32 - int(bits or 32))
    low = sum(x << 8 * (3 - i) for i, x in enumerate(octets)) // size * size
    return F.coalesce(ip_number(ip).between(low, low + size - 1), F.lit(False))


#: Networks that aren't reached from outside.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8")


def ip_to_domain(ip: Column) -> Column:
    own = F.lit(False)
    for cidr in PRIVATE:
        own = own | in_subnet(ip, cidr)
    return F.when(ip_number(ip).isNull(), "invalid ip").when(own, "intranet").otherwise("internet")


def ip_in_range(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a network; false where either is invalid."""
    try:
        return in_subnet(ip, cidr)
    except ValueError:
        return F.lit(False)


def _network(cidr: Column) -> tuple[Column, Column]:
    """The lowest address of a.b.c.d/len, null where it isn't one; and len."""
    size = F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    n = ip_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    block = F.pow(F.lit(2.0), 32 - size).cast("long")
    return F.when(n.isNotNull() & size.between(0, 32) & F.rlike(cidr, F.lit(r"/\d+$")), n - F.pmod(n, block)), size


def ip_subnet_min(cidr: Column) -> Column:
    low, _ = _network(cidr)
    return F.coalesce(F.when(low.isNotNull(), ip_text(low)), F.lit("invalid ip"))


def ip_subnet_max(cidr: Column) -> Column:
    """The lowest address with 255 at its end, whatever the network's size."""
    low, _ = _network(cidr)
    return F.coalesce(F.when(low.isNotNull(), ip_text(low.bitwiseOR(255))), F.lit("invalid ip"))


def ip_subnet_range(cidr: Column) -> Column:
    low = ip_subnet_min(cidr)
    return F.when(low == "invalid ip", low).otherwise(F.concat(F.lit('["'), low, F.lit('", "'), ip_subnet_max(cidr), F.lit('"]')))


#: First digits of phone numbers by carrier, the first that fits.
CARRIERS = {
    "中国电信": "133 149 153 173 177 180 181 189 190 191 193 199 1700 1701 1702 162",
    "中国联通": "130 131 132 145 155 156 166 167 171 175 176 185 186 196 1704 1707 1708 1709",
    "中国移动": "134 135 136 137 138 139 147 148 150 151 152 157 158 159 172 178 182 183 184 187 188 195 197 198 1440 1703 1705 1706 165",
    "中国广电": "192",
    "卫星通信": "1349 174",
}
UNKNOWN_CARRIER = "未知运营商"


def mobile_carrier(phone: Column) -> Column:
    out = F.when(phone.isNull(), F.lit(None).cast("string"))
    for name, starts in CARRIERS.items():
        out = out.when(F.rlike(phone, F.lit(f"^({starts.replace(' ', '|')})")), name)
    return out.otherwise(UNKNOWN_CARRIER)


IPS = {"ip_subnet_min": ip_subnet_min, "ip_subnet_max": ip_subnet_max, "ip_subnet_range": ip_subnet_range, "mobile_carrier": mobile_carrier, "ip_mask": ip_mask, "ip_prefix": lambda ip, bits: F.concat(ip_mask(ip, bits), F.lit(f"/{bits}")), "is_subnet_of": lambda cidr, ip: in_subnet(ip, cidr), "ip_to_domain": ip_to_domain}

FUNCTIONS = MATH | STRINGS | URLS | JSON | IPS
