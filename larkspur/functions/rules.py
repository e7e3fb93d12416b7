"""What the dialect's values mean in Spark SQL text: literals, casts, texts, formats.

Every function takes and returns SQL text; types are those of larkspur.dialect.types. Errors are raised
by the expressions themselves as `[[SQLSTATE]] message`.
"""

from __future__ import annotations

import re

from larkspur.dialect.types import BINS, CHARS, EXACT, FLOATS, INTS, Type
from larkspur.errors import SqlError

DAY = 86_400_000_000
#: Micros (or months) of an interval field.
UNIT = {"YEAR": 12, "MONTH": 1, "DAY": DAY, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}


def quoted(text: str) -> str:
    """A string literal; backslashes are escapes to Spark but not to the dialect."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fail(state: str, message: str, kind: str = "string") -> str:
    return f"CAST(raise_error({quoted(f'[[{state}]] {message}')}) AS {kind})"


def checked(bad: str, value: str, state: str, message: str, kind: str) -> str:
    return f"CASE WHEN {bad} THEN {fail(state, message, kind)} ELSE {value} END"


# texts


def clock(micros: str, digits: int) -> str:
    """HH:MM:SS and a fraction of micros since midnight."""
    part = lambda unit, most: f"lpad(CAST(({micros} DIV {unit}) % {most} AS STRING), 2, '0')"
    out = f"concat({part(3_600_000_000, 100)}, ':', {part(60_000_000, 60)}, ':', {part(1_000_000, 60)}"
    return out + (f", '.', substr(lpad(CAST({micros} % 1000000 AS STRING), 6, '0'), 1, {digits}))" if digits else ")")


def offset_text(off: str) -> str:
    return f"concat(CASE WHEN {off} < 0 THEN '-' ELSE '+' END, lpad(CAST(abs({off}) DIV 60 AS STRING), 2, '0'), ':', lpad(CAST(abs({off}) % 60 AS STRING), 2, '0'))"


def stamp_text(ts: str, digits: int) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss{'.' + 'S' * digits if digits else ''}')"


def interval_text(x: str, t: Type) -> str:
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    a = f"abs({x})"
    two = lambda e: f"lpad(CAST({e} AS STRING), 2, '0')"
    if t.family == "INTERVAL_YM":
        if t.start == t.end:
            return f"CAST({x} DIV {UNIT[t.start]} AS STRING)"
        return f"CASE WHEN {x} IS NOT NULL THEN concat({sign}, CAST({a} DIV 12 AS STRING), '-', {two(f'{a} % 12')}) END"
    fields = ("DAY", "HOUR", "MINUTE", "SECOND")
    i, j = fields.index(t.start), fields.index(t.end)
    parts = [f"CAST({a} DIV {UNIT[t.start]} AS STRING)"]
    for f in fields[i + 1 : j + 1]:
        parts += ["' '" if f == "HOUR" else "':'", two(f"({a} DIV {UNIT[f]}) % {24 if f == 'HOUR' else 60}")]
    if t.end == "SECOND" and t.b:
        parts += ["'.'", f"substr(lpad(CAST({a} % 1000000 AS STRING), 6, '0'), 1, {t.b})"]
    return f"CASE WHEN {x} IS NOT NULL THEN concat({sign}, {', '.join(parts)}) END"


def float_text(x: str) -> str:
    """The shortest form that reads back: whole numbers without a point, exponents from 1e21 and below 1e-6."""
    d = f"CAST({x} AS DOUBLE)" if "CAST" not in x else x
    plain = f"regexp_replace(CAST(CAST(CAST({x} AS STRING) AS DECIMAL(38,16)) AS STRING), '\\\\.?0+$', '')"
    far = f"regexp_replace(regexp_replace(CAST({x} AS STRING), '(\\\\.0)?E(-?)', 'e$2'), 'e([0-9])', 'e+$1')"
    whole = f"CAST(CAST({x} AS DECIMAL(38,0)) AS STRING)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN abs({d}) >= 1e21D OR ({x} <> 0 AND abs({d}) < 1e-6D) THEN {far} WHEN {x} = floor({x}) THEN {whole} ELSE {plain} END"


def text(x: str, t: Type) -> str:
    k = t.kind
    if k in CHARS or k in ("TEXT", "NULL"):
        return x
    if k in BINS:
        return f"hex({x})"
    if k == "BOOLEAN":
        return f"upper(CAST({x} AS STRING))"
    if k in FLOATS:
        return float_text(x)
    if k == "TIME":
        return clock(x, t.a)
    if k == "TIMETZ":
        local = f"pmod({x}.t + {x}.off * 60000000L, {DAY})"
        return f"concat({clock(local, t.a)}, {offset_text(f'{x}.off')})"
    if k == "TIMESTAMP":
        return stamp_text(x, t.a)
    if k == "TIMESTAMPTZ":
        return f"concat({stamp_text(f'timestampadd(MINUTE, {x}.off, {x}.ts)', t.a)}, {offset_text(f'{x}.off')})"
    if k == "INTERVAL":
        return interval_text(x, t)
    return f"CAST({x} AS STRING)"


def text_length(t: Type) -> int:
    """Most characters of a value's text."""
    fixed = {"SMALLINT": 6, "INTEGER": 11, "BIGINT": 20, "REAL": 24, "DOUBLE": 24, "BOOLEAN": 5, "DATE": 10, "TIME": 15, "TIMETZ": 21, "TIMESTAMP": 26, "TIMESTAMPTZ": 32, "INTERVAL": 32, "NULL": 1}
    if t.kind == "DECIMAL":
        return t.a + 2
    return fixed.get(t.kind, t.a * (2 if t.kind in BINS else 1))


# conforming to a declared type


def fit_text(x: str, n: int, pad: bool, longest: int) -> str:
    """Blanks over the length are dropped, anything else over it is an error; CHAR is padded."""
    if longest > n:
        x = checked(f"length(rtrim({x})) > {n}", f"substr({x}, 1, {n})", "22001", f"Text is longer than {n} characters", "string")
    return f"rpad({x}, {n}, ' ')" if pad else x


def fit_bytes(x: str, t: Type, longest: int) -> str:
    if longest > t.a:
        x = checked(f"length({x}) > {t.a}", x, "22001", f"Value is longer than {t.a} bytes", "binary")
    return f"rpad({x}, {t.a}, X'00')" if t.kind == "BINARY" else x


def finite(x: str, kind: str = "double") -> str:
    """NaN and infinity are out of range; negative zero is zero."""
    return checked(f"isnan({x}) OR abs({x}) = double('infinity')", f"({x} + CAST(0 AS {kind}))", "22003", "Number is out of range", kind)


def round_fraction(micros: str, digits: int) -> str:
    unit = 10 ** (6 - digits)
    return micros if digits == 6 else f"(floor(({micros} + {unit // 2}) / {unit}) * {unit})"


def second_micros(ts: str) -> str:
    return f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"


def fit_stamp(ts: str, digits: int, known: int = 6) -> str:
    if digits >= known:
        return ts
    m = second_micros(ts)
    return f"timestampadd(MICROSECOND, CAST({round_fraction(m, digits)} - {m} AS BIGINT), {ts})"


def fit_interval(x: str, t: Type) -> str:
    """Cut to the end field, toward zero."""
    unit = UNIT[t.end] if t.end != "SECOND" else 10 ** (6 - t.b)
    return x if unit == 1 else f"(({x} DIV {unit}) * {unit})"


def leading_check(x: str, t: Type) -> str:
    most = 10**t.a * UNIT[t.start]
    if most >= 2 ** (31 if t.family == "INTERVAL_YM" else 63):
        return x
    return checked(f"abs({x}) >= {most}", x, "22015", f"Leading field of {t} overflows", t.spark)


# casts

_NUMBER = "'^[+-]?([0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_STAMP = "'^ *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]*)?)? *(Z|[+-][0-9]{1,2}:?[0-9]{2})?)? *$'"


def cast(x: str, f: Type, t: Type, zone: str = "UTC", today: str = "current_date()") -> str:
    """x of type f as type t; the pair has been checked by types.can_cast."""
    if f == t and t.kind not in FLOATS:
        return x
    if f.kind == "NULL":
        return f"CAST(NULL AS {t.spark})"
    src, dst = f.family, t.family
    if t.kind in CHARS:
        return fit_text(text(x, f), t.a, t.kind == "CHAR", text_length(f))
    if t.kind in BINS:
        return fit_bytes(x, t, f.a)
    if src in ("CHARACTER", "TEXT"):
        return _from_text(f"trim({x})", x, t, zone, today)
    if dst == "NUMERIC":
        if f.kind == "INTERVAL":
            return cast(f"CAST({x} DIV {UNIT[f.start]} AS BIGINT)", Type("BIGINT"), t)
        if t.kind in INTS:
            return f"CAST(round({x}) AS {t.spark})" if f.kind not in INTS else f"CAST({x} AS {t.spark})"
        if t.kind in FLOATS:
            y = x if f.spark == t.spark else f"CAST({x} AS {t.spark})"
            return finite(y, t.spark) if t.kind == "REAL" and f.kind == "DOUBLE" else y
        return f"CAST({x} AS {t.spark})"
    if t.kind == "INTERVAL":
        if src == "NUMERIC":
            return leading_check(f"CAST(round({x}) * {UNIT[t.start]} AS {t.spark})", t)
        return leading_check(fit_interval(x, t), t)
    if t.kind == "BOOLEAN":
        return x
    return _temporal(x, f, t, zone, today)


def to_utc(ts: str, zone: str) -> str:
    return ts if zone == "UTC" else f"convert_timezone({quoted(zone)}, 'UTC', {ts})"


def to_zone(ts: str, zone: str) -> str:
    return ts if zone == "UTC" else f"convert_timezone('UTC', {quoted(zone)}, {ts})"


def with_offset(utc: str, zone: str) -> str:
    off = "0" if zone == "UTC" else f"CAST(timestampdiff(MINUTE, {utc}, {to_zone(utc, zone)}) AS INT)"
    return f"CASE WHEN {utc} IS NOT NULL THEN named_struct('ts', {utc}, 'off', {off}) END"


def midnight_micros(ts: str) -> str:
    return f"((hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + {second_micros(ts)})"


def _temporal(x: str, f: Type, t: Type, zone: str, today: str) -> str:
    a, b = f.kind, t.kind
    if b == "DATE":
        return f"CAST({to_zone(f'{x}.ts', zone) if a == 'TIMESTAMPTZ' else x} AS DATE)"
    if b == "TIMESTAMP":
        if a in ("DATE", "TIMESTAMP"):
            return fit_stamp(f"CAST({x} AS TIMESTAMP_NTZ)" if a == "DATE" else x, t.a, f.a if a == "TIMESTAMP" else 0)
        if a == "TIMESTAMPTZ":
            return fit_stamp(to_zone(f"{x}.ts", zone), t.a, f.a)
        micros = x if a == "TIME" else f"pmod({x}.t + {x}.off * 60000000L, {DAY})"
        return f"timestampadd(MICROSECOND, {micros}, CAST({today} AS TIMESTAMP_NTZ))"
    if b == "TIMESTAMPTZ":
        if a == "TIMESTAMPTZ":
            return f"CASE WHEN {x} IS NOT NULL THEN named_struct('ts', {fit_stamp(f'{x}.ts', t.a, f.a)}, 'off', {x}.off) END"
        local = _temporal(x, f, Type("TIMESTAMP", t.a), zone, today) if a != "TIMESTAMP" or f.a > t.a else x
        return with_offset(to_utc(local, zone), zone)
    if b == "TIME":
        if a == "TIME":
            return f"pmod({round_fraction(x, t.a)}, {DAY})" if t.a < f.a else x
        if a == "TIMETZ":
            return f"pmod({round_fraction(f'{x}.t', t.a)} + {x}.off * 60000000L, {DAY})"
        return f"CAST(pmod({round_fraction(midnight_micros(to_zone(f'{x}.ts', zone) if a == 'TIMESTAMPTZ' else x), t.a)}, {DAY}) AS BIGINT)"
    if a == "TIMETZ":
        return x
    local = x if a == "TIME" else _temporal(x, f, Type("TIME", t.a), zone, today)
    # the offset is that of the session's zone today
    off = "0" if zone == "UTC" else f"CAST(timestampdiff(MINUTE, CAST({today} AS TIMESTAMP_NTZ), {to_zone(f'CAST({today} AS TIMESTAMP_NTZ)', zone)}) AS INT)"
    return f"CASE WHEN {x} IS NOT NULL THEN named_struct('t', CAST(pmod({local} - {off} * 60000000L, {DAY}) AS BIGINT), 'off', {off}) END"


def _from_text(s: str, raw: str, t: Type, zone: str, today: str) -> str:
    def when(ok: str, value: str, state: str, what: str) -> str:
        return f"CASE WHEN {raw} IS NULL THEN NULL WHEN {ok} THEN {value} ELSE {fail(state, f'Text is not a {what}', t.spark)} END"

    k = t.kind
    if k in INTS:
        return when(f"{s} RLIKE '^[+-]?[0-9]+$'", f"CAST(CAST({s} AS DECIMAL(38,0)) AS {t.spark})", "22018", "whole number")
    if k == "DECIMAL":
        return when(f"{s} RLIKE {_NUMBER}", f"CAST({s} AS {t.spark})", "22018", "number")
    if k in FLOATS:
        return when(f"{s} RLIKE {_NUMBER}", finite(f"CAST({s} AS {t.spark})", t.spark), "22018", "number")
    if k == "BOOLEAN":
        u = f"upper({s})"
        return f"CASE WHEN {raw} IS NULL THEN NULL WHEN {u} = 'TRUE' THEN TRUE WHEN {u} = 'FALSE' THEN FALSE WHEN {u} = 'UNKNOWN' THEN CAST(NULL AS BOOLEAN) ELSE {fail('22018', 'Text is not a truth value', 'boolean')} END"
    if k in ("DATE", "TIMESTAMP", "TIMESTAMPTZ"):
        # the text's own zone, if any, is applied before the session's
        zoned = f"regexp_extract({s}, '(Z|[+-][0-9]{{1,2}}:?[0-9]{{2}})$', 1)"
        bare = f"regexp_replace({s}, ' *(Z|(?<=:[0-9.]{{1,9}} ?)[+-][0-9]{{1,2}}:?[0-9]{{2}})$', '')"
        value = f"try_cast({bare} AS TIMESTAMP_NTZ)"
        local = f"CASE WHEN {value} IS NULL THEN {fail('22008', 'Date or time field is out of range', 'timestamp_ntz')} ELSE {value} END"
        if k == "TIMESTAMPTZ":
            local = fit_stamp(f"({local})", t.a)
            digits = f"regexp_replace({zoned}, '[^0-9]', '')"
            off = f"CAST((CASE WHEN {zoned} LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr({digits}, 1, length({digits}) - 2) AS INT) * 60 + CAST(right({digits}, 2) AS INT)) AS INT)"
            own = f"named_struct('ts', timestampadd(MINUTE, -({off}), {local}), 'off', {off})"
            value = f"CASE WHEN {zoned} RLIKE '[0-9]' AND {s} LIKE '%:%' THEN {own} ELSE {with_offset(to_utc(local, zone), zone)} END"
        else:
            value = f"CAST({local} AS DATE)" if k == "DATE" else fit_stamp(local, t.a)
        return when(f"{s} RLIKE {_STAMP}", value, "22007", "date or timestamp")
    if k in ("TIME", "TIMETZ"):
        part = lambda i: f"coalesce(try_cast(regexp_extract({s}, '^([0-9]{{1,2}}):([0-9]{{1,2}})(:([0-9]{{1,2}}))?([.][0-9]*)?', {i}) AS INT), 0)"
        frac = f"CAST(rpad(substr(concat(regexp_extract({s}, '[.]([0-9]*)', 1), ''), 1, 6), 6, '0') AS INT)"
        bad = f"{part(1)} > 23 OR {part(2)} > 59 OR {part(4)} > 59"
        micros = checked(bad, f"({part(1)} * 3600L + {part(2)} * 60L + {part(4)}) * 1000000L + {frac}", "22008", "Time field is out of range", "bigint")
        value = f"CAST(pmod({round_fraction(f'({micros})', t.a)}, {DAY}) AS BIGINT)"
        if k == "TIMETZ":
            off = f"coalesce(try_cast(regexp_extract({s}, '([+-][0-9]{{1,2}}):?([0-9]{{2}})$', 1) AS INT) * 60, 0)"
            value = f"named_struct('t', pmod({value} - {off} * 60000000L, {DAY}), 'off', {off})"
        return when(f"{s} RLIKE '^[0-9]{{1,2}}:[0-9]{{1,2}}(:[0-9]{{1,2}}([.][0-9]*)?)? *([+-][0-9]{{1,2}}:?[0-9]{{2}})?$'", value, "22007", "time")
    if k == "INTERVAL":
        return _interval_from_text(s, t, when)
    raise SqlError("42846", f"Text cannot be cast to {t}")


def _interval_from_text(s: str, t: Type, when) -> str:
    fields = ("YEAR", "MONTH") if t.family == "INTERVAL_YM" else ("DAY", "HOUR", "MINUTE", "SECOND")
    own = fields[fields.index(t.start) : fields.index(t.end) + 1]
    seps = ["" if i == 0 else "-" if f == "MONTH" else " +" if f == "HOUR" else ":" for i, f in enumerate(own)]
    pattern = "^([+-]?) *" + "".join(f"{sep}([0-9]+)" for sep in seps) + ("([.][0-9]*)?" if t.end == "SECOND" else "") + "$"
    get = lambda i: f"CAST(regexp_extract({s}, '{pattern}', {i}) AS BIGINT)"
    total = " + ".join(f"{get(i + 2)} * {UNIT[f]}L" for i, f in enumerate(own))
    if t.end == "SECOND":
        total += f" + CAST(rpad(substr(regexp_extract({s}, '[.]([0-9]*)', 1), 1, 6), 6, '0') AS BIGINT)"
    value = f"CAST((CASE WHEN {s} LIKE '-%' THEN -1 ELSE 1 END) * ({total}) AS {t.spark})"
    return when(f"{s} RLIKE '{pattern}'", leading_check(fit_interval(value, t), t), "22007", f"value of {t}")


def interval_value(source: str, t: Type) -> int:
    """An interval literal's months or micros."""
    fields = ("YEAR", "MONTH") if t.family == "INTERVAL_YM" else ("DAY", "HOUR", "MINUTE", "SECOND")
    own = fields[fields.index(t.start) : fields.index(t.end) + 1]
    seps = ["" if i == 0 else "-" if f == "MONTH" else r"\s+" if f == "HOUR" else ":" for i, f in enumerate(own)]
    pattern = r"\s*([+-]?)\s*" + "".join(sep + r"(\d+)" for sep in seps) + (r"(?:\.(\d*))?" if t.end == "SECOND" else "") + r"\s*"
    m = re.fullmatch(pattern, source)
    if m is None:
        raise SqlError("22007", f"'{source}' is not a value of {t}")
    numbers = [int(m[i + 2]) for i in range(len(own))]
    limits = {"MONTH": 12, "HOUR": 24, "MINUTE": 60, "SECOND": 60}
    if numbers[0] >= 10**t.a or any(n >= limits[f] for n, f in zip(numbers[1:], own[1:], strict=True)):
        raise SqlError("22015", f"A field of '{source}' overflows {t}")
    total = sum(n * UNIT[f] for n, f in zip(numbers, own, strict=True))
    if t.end == "SECOND":
        total += int(((m[len(own) + 2] or "") + "000000")[:6])
    return -total if m[1] == "-" else total


# formats

_DATE_TOKEN = re.compile(r'YYYY|YY|MM|DD|HH24|HH12|HH|MI|SS|FF[1-6]?|AM|PM|"[^"]*"|.', re.I | re.S)


def date_tokens(fmt: str) -> list[str]:
    return [t if t.startswith('"') else t.upper() if len(t) > 1 else t for t in _DATE_TOKEN.findall(fmt)]


def to_char_datetime(ts: str, fmt: str) -> str:
    """ts: timestamp_ntz text."""
    java = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a", "FF": "SSSSSS"}
    parts = []
    for t in date_tokens(fmt):
        if t.startswith("FF") and len(t) == 3:
            parts.append(f"date_format({ts}, '{'S' * int(t[2])}')")
        elif t in java:
            parts.append(f"date_format({ts}, '{java[t]}')")
        else:
            parts.append(quoted(t.strip('"') if t.startswith('"') else t))
    return f"CASE WHEN {ts} IS NOT NULL THEN concat({', '.join(parts)}) END" if parts else f"CASE WHEN {ts} IS NOT NULL THEN '' END"


def to_char_number(x: str, fmt: str) -> str:
    """9 and 0 are digits (any 0 fills with zeros), a comma groups, FM fills nothing; a sign slot stands first; what is too wide is a row of #."""
    f = fmt.upper()
    fill = not f.startswith("FM")
    f = f if fill else f[2:]
    if not re.fullmatch(r"[90,]*(\.[90,]*)?", f) or not re.search("[90]", f):
        raise SqlError("22018", f"Number format '{fmt}' is not known")
    whole, _, frac = f.partition(".")
    slots, places = len(whole.replace(",", "")), len(frac)
    n = f"round(CAST({x} AS DECIMAL(38,{places + 8})), {places})"
    units = f"CAST(CAST(floor(abs({n})) AS DECIMAL(38,0)) AS STRING)"
    zeros = fill and "0" in whole
    digits = f"lpad({units}, {slots}, '0')" if zeros else units
    if "," in f:
        digits = f"reverse(regexp_replace(reverse({digits}), '([0-9]{{3}})(?=[0-9])', '$1,'))"
    if fill and not zeros:
        digits = f"concat(repeat(' ', {slots} - length({units})), {digits})"
    tail = f", '.', substr(rpad(split_part(CAST(CAST(abs({n}) AS DECIMAL(38,{max(places, 1)})) AS STRING), '.', 2), {places}, '0'), 1, {places})" if "." in f else ""
    out = f"concat(CASE WHEN {n} < 0 THEN '-' ELSE '{' ' if fill else ''}' END, {digits}{tail})"
    if fill:
        out = f"lpad({out}, greatest(length({out}), {len(f) + 1}), ' ')"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN length({units}) > {slots} THEN {quoted('#' * len(f))} ELSE {out} END"


def to_date(x: str, fmt: str) -> str:
    """Text to timestamp_ntz by a format; fields that the format hasn't are those of 1970-01-01 00:00:00."""
    groups, pattern = [], "^"
    digits = {"YYYY": 4, "YY": 2, "MM": 2, "DD": 2, "HH24": 2, "HH12": 2, "HH": 2, "MI": 2, "SS": 2}
    for t in date_tokens(fmt):
        if t in digits:
            groups.append(t)
            pattern += f"([0-9]{{1,{digits[t]}}})"
        elif t.startswith("FF"):
            groups.append("FF")
            pattern += f"([0-9]{{1,{t[2:] or 6}}})"
        elif t in ("AM", "PM"):
            groups.append("AM")
            pattern += "([AaPp][Mm])"
        else:
            pattern += re.sub(r"([^\w ])", r"[\1]" if t != "^" else r"\\^", t.strip('"') if t.startswith('"') else t)
    pattern = quoted(pattern + "$")
    get = lambda g: f"regexp_extract({x}, {pattern}, {groups.index(g) + 1})" if g in groups else None
    number = lambda g, other: f"try_cast({get(g)} AS INT)" if g in groups else other
    year = number("YYYY", f"(2000 + {number('YY', '0')})" if "YY" in groups else "1970")
    hour = number("HH24", None) or "0"
    if "HH24" not in groups and ("HH" in groups or "HH12" in groups):
        hour = number("HH" if "HH" in groups else "HH12", "0")
        if "AM" in groups:
            hour = f"({hour} % 12 + CASE WHEN upper({get('AM')}) = 'PM' THEN 12 ELSE 0 END)"
    frac = f"try_cast(rpad({get('FF')}, 6, '0') AS INT)" if "FF" in groups else "0"
    date = f"concat(lpad(CAST({year} AS STRING), 4, '0'), '-', lpad(CAST({number('MM', '1')} AS STRING), 2, '0'), '-', lpad(CAST({number('DD', '1')} AS STRING), 2, '0'))"
    time = f"concat(' ', lpad(CAST({hour} AS STRING), 2, '0'), ':', lpad(CAST({number('MI', '0')} AS STRING), 2, '0'), ':', lpad(CAST({number('SS', '0')} AS STRING), 2, '0'))"
    value = f"try_cast(concat({date}, {time}) AS TIMESTAMP_NTZ)"
    value = f"coalesce({value}, {fail('22008', 'Date or time field is out of range', 'timestamp_ntz')})"
    if "FF" in groups:
        value = f"timestampadd(SECOND, CASE WHEN {frac} >= 500000 THEN 1 ELSE 0 END, {value})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} RLIKE {pattern} THEN {value} ELSE {fail('22007', f'Text does not follow the format {fmt}', 'timestamp_ntz')} END"


def numeric(t: Type) -> bool:
    return t.kind in EXACT or t.kind in FLOATS


def round_float(x: str, n: str) -> str:
    """Floats round halves up, toward positive infinity."""
    return finite(f"(floor({x} * power(10D, {n}) + 0.5D) / power(10D, {n}))")
