"""Personal data to format-preserving pseudonyms, with keyed Feistel permutations, in SQL functions alone.

Recognised values are validated (Luhn and IBAN check digits, octets, calendar dates, number plans) and then permuted
within their format by a Feistel network whose round function is a keyed SHA-256: equal values have equal pseudonyms in
all documents, no two values of a format share one, and check digits, calendars and separators stay valid. What fails its
validation is left as it is.

    e-mail address   letters and digits of the local part, each within its class
    payment card     13 to 19 digits with a valid Luhn digit: the others are permuted, the Luhn digit follows. In a run
                     of digit groups all spans of whole groups are tried, the usual groupings of cards first: one group,
                     or a usual grouping that is the whole run, or groups that begin, and are as long, as an issuer's
                     cards. In a run of more than 64 digits, a table of numbers, the last holds where four or more such
                     cards follow each other, which chance doesn't explain
    IBAN             account letters and digits, each within its class; the check digits follow
    phone number     the ten digits of the North American plan within the plan; others digit by digit
    social security  within the valid numbers
    IP address       within all four octets
    date             yyyy-mm-dd and dd/mm/yyyy or mm/dd/yyyy of the years 1800 to 2199, within those 400 years
    secret           access key ids, and what follows password, token, secret or key with = or :

Cases: null text stays null, empty text and text without such values stay as they are; repeated rows get equal
results; other columns are passed through, whatever their names (but for one called as ``counted``); an empty table gives an empty result. Whole texts are searched, at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io

ROUNDS = 10
#: The setting of the session that holds the key, and what stands for it where it is unset. The latter is public: whoever
#: has it can invert the pseudonyms, so it is for tests only.
SETTING, PUBLIC_KEY = "spark.shelfspark.pseudonyms.key", "shelfspark pseudonyms"

#: Patterns by kind, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?[A-Za-z0-9+/_.-]{8,}+",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso": r"(?<![0-9/-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "slash": r"(?<![0-9/-])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "abroad": r"(?<![A-Za-z0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])",
}
#: A run of digit groups that may hold cards, and the usual groupings of cards.
CHAIN = r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]*+"
GROUPED = r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: The beginnings of cards by issuer, with their lengths.
ISSUED = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11,16}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|6(?:011|5[0-9]{2})[0-9]{12,15})$"
#: A run of digit groups with more digits than this is a table of numbers, in which only whole numbers are cards, and so many in a row.
TABLE, ROW = 64, 4
#: What every value holds.
HINT = "[0-9@]|AKIA|ASIA|(?i:passw|pwd|token|secret|key)"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(seed: str) -> str:
    """60 keyed pseudo-random bits."""
    return f"cast(conv(left(sha2({seed}, 256), 15), 16, 10) as bigint)"


def feistel_number(kind: str, value: str, a: int, b: int, key: str = PUBLIC_KEY) -> str:
    """SQL that permutes 0 .. a*b-1: alternating rounds add a keyed function of one half to the other."""
    step = _number(f"concat({_quoted(key + '|' + kind)}, '|', i, '|', if(i % 2 = 0, s.r, s.l))")
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', ({value}) div {b}L, 'r', ({value}) % {b}L), "
        f"(s, i) -> if(i % 2 = 0, named_struct('l', (s.l + {step}) % {a}L, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {step}) % {b}L)), "
        f"s -> s.l * {b}L + s.r)"
    )


def feistel_text(kind: str, value: str, key: str = PUBLIC_KEY) -> str:
    """SQL that permutes a string's digits and letters, each within digits, small or capital letters; the rest stays.

    Digits and a-f of a string of only those stay among them.
    """

    def moved(x: str, y: str) -> str:
        k = _number(f"concat({_quoted(key + '|' + kind)}, '|', i, '|', j, '|', {y})")
        c = f"substr({x}, j, 1)"
        hex_ = "'0123456789abcdef'"
        return (
            f"array_join(transform(if(length({x}) = 0, cast(array() as array<int>), sequence(1, length({x}))), j -> case "
            f"when s.h and instr({hex_}, {c}) > 0 then substr({hex_}, cast((instr({hex_}, {c}) - 1 + {k}) % 16 as int) + 1, 1) "
            f"when {c} between '0' and '9' then char(48 + (ascii({c}) - 48 + {k}) % 10) "
            f"when {c} between 'a' and 'z' then char(97 + (ascii({c}) - 97 + {k}) % 26) "
            f"when {c} between 'A' and 'Z' then char(65 + (ascii({c}) - 65 + {k}) % 26) else {c} end), '')"
        )

    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', left({value}, length({value}) div 2), 'r', substr({value}, length({value}) div 2 + 1), 'h', {value} rlike '^[0-9a-f]*$' and {value} rlike '[a-f]'), "
        f"(s, i) -> if(i % 2 = 0, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r, 'h', s.h), named_struct('l', s.l, 'r', {moved('s.r', 's.l')}, 'h', s.h)), "
        f"s -> concat(s.l, s.r))"
    )


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refilled(m: str, digits: str) -> str:
    """m with its digits replaced, one by one, by those of another string."""
    return (
        f"aggregate(transform(sequence(1, length({m})), j -> substr({m}, j, 1)), named_struct('o', '', 'k', 1), "
        f"(s, c) -> if(c between '0' and '9', named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"
    )


def _luhn(d: str, skip: int) -> str:
    """The Luhn sum of a digit string to which ``skip`` digits will be added."""
    v = f"cast(substr({d}, length({d}) - j + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + if((j + {skip}) % 2 = 0, if({v} * 2 > 9, {v} * 2 - 9, {v} * 2), {v}))"


def _mod97(s: str) -> str:
    """The remainder of an IBAN whose first four places have gone to its end; letters count 10 to 35."""
    c = f"substr({s}, j, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, j) -> if({c} between '0' and '9', (t * 10 + ascii({c}) - 48) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _let(name: str, value: str, body: str) -> str:
    """SQL has no let: a one-element array's transform names a value, so that it is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _card(m: str, key: str) -> str:
    # a body of n digits is permuted in two halves of n div 2 and the rest; both bounds depend on n
    a, b = "cast(pow(10, length(w) div 2) as bigint)", "cast(pow(10, length(w) - length(w) div 2) as bigint)"
    step = _number(f"concat({_quoted(key + '|card')}, '|', length(w), '|', i, '|', if(i % 2 = 0, s.r, s.l))")
    body = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast(left(w, length(w) div 2) as bigint), 'r', cast(substr(w, length(w) div 2 + 1) as bigint)), "
        f"(s, i) -> if(i % 2 = 0, named_struct('l', (s.l + {step}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {step}) % {b})), "
        f"s -> concat(lpad(cast(s.l as string), length(w) div 2, '0'), lpad(cast(s.r as string), length(w) - length(w) div 2, '0')))"
    )
    whole = _let("w", "left(d, length(d) - 1)", _let("p", body, f"concat(p, cast((10 - {_luhn('p', 1)} % 10) % 10 as string))"))
    return _let("d", _digits(m), f"if({_luhn('d', 0)} % 10 = 0 and d rlike '[1-9]', {_let('e', whole, _refilled(m, 'e'))}, {m})")


def _rows(f: str, c: str, whole: str) -> str:
    """SQL for those spans of f that are a whole, or one of ROW or more spans of c of which each begins where the last one ends."""

    def meets(spans: str, end: str, other: str) -> str:
        return _let("e", f"transform({spans}, y -> y.{other})", f"filter({c}, x -> array_contains(e, {end}))")

    # ahead: spans that so many others follow; of these and up to ROW - 1 that follow them, the places
    key = "64 * {0}.i + {0}.j - {0}.i"
    ahead = c
    for _ in range(ROW - 1):
        ahead = meets(ahead, "x.j + 2", "i")
    names = [f"r{i}" for i in range(ROW)]
    out = _let("p", f"transform(concat({', '.join(names)}), y -> {key.format('y')})", f"filter({f}, x -> {whole} or array_contains(p, {key.format('x')}))")
    for i in range(ROW - 1, 0, -1):
        out = _let(names[i], meets(names[i - 1], "x.i - 2", "j"), out)
    return _let(names[0], ahead, out)


def _cards(m: str) -> str:
    """SQL for the cards in a run of digit groups: spans that do not overlap, usual groupings first, then long ones."""
    g, n = "g", "cast(size(g) as int)"
    span = "named_struct('i', i, 'j', i + 2 * k, 's', array_join(slice(g, i, 2 * k + 1), ''))"
    spans = f"flatten(transform(filter(sequence(1, {n}), i -> i % 2 = 1), i -> transform(filter(sequence(18, 0, -1), k -> i + 2 * k <= {n}), k -> {span})))"
    luhn = _let("d", _digits("x.s"), f"{_luhn('d', 0)} % 10 = 0")
    # one in ten spans of a row of numbers has a Luhn digit: several groups are a card if they are all there is, or as an issuer numbers them
    whole = f"(x.i = x.j or x.i = 1 and x.j = {n} and x.s rlike {_quoted(GROUPED)})"
    issued = f"{_digits('x.s')} rlike {_quoted(ISSUED)}"
    found = f"filter({spans}, x -> if(x.s rlike '^[0-9]([ -]?[0-9]){{12,18}}$' and x.s rlike '[1-9]' and ({whole} or {issued}), {luhn}, false))"
    valid = _let("f", found, f"if(length({_digits(m)}) <= {TABLE}, f, {_let('c', f'filter(f, x -> {issued})', _rows('f', 'c', whole))})")

    def apart(of: str) -> str:
        none = "cast(array() as array<struct<i: int, j: int, s: string>>)"
        return f"aggregate({of}, {none}, (a, x) -> if(size(a) > 0 and element_at(a, -1).j >= x.i, a, concat(a, array(x))))"

    loose = apart("filter(v, x -> not exists(w, y -> y.i <= x.j and y.j >= x.i))")
    both = _let("w", apart(f"filter(v, x -> x.s rlike {_quoted(GROUPED)})"), f"transform(concat(w, {loose}), x -> x.s)")
    return _let(g, f"regexp_extract_all({m}, '[0-9]+|[ -]+', 0)", _let("v", valid, both))


def _pattern(t: str) -> str:
    """SQL for the pattern of all values in the text t: its own cards stand for the card pattern."""
    kinds = list(PATTERNS)
    before, after = ("|".join(PATTERNS[k] for k in ks) for ks in (kinds[: kinds.index("card")], kinds[kinds.index("card") + 1 :]))
    chains = f"regexp_extract_all({t}, {_quoted(CHAIN)}, 0)"
    cards = f"array_distinct(flatten(transform({chains}, c -> {_cards('c')})))"
    own = _let("p", cards, f"if(size(p) > 0, concat({_quoted(before + '|(?<![0-9])(?:')}, array_join(p, '|'), {_quoted(')(?![0-9])|' + after)}), {_quoted(before + '|' + after)})")
    return f"if({t} rlike {_quoted(CHAIN)}, {own}, {_quoted(before + '|' + after)})"


def _iban(m: str, key: str) -> str:
    turned = "concat(substr(d, 5), left(d, 4))"
    bare = "concat(t, left(d, 2), '00')"
    made = _let("t", feistel_text("iban", "substr(d, 5)", key), _let("b", bare, f"concat(left(d, 2), lpad(cast(98 - {_mod97('b')} as string), 2, '0'), t)"))
    spaced = f"aggregate(transform(sequence(1, length({m})), j -> substr({m}, j, 1)), named_struct('o', '', 'k', 1), (s, c) -> if(c = ' ', named_struct('o', concat(s.o, c), 'k', s.k), named_struct('o', concat(s.o, substr(e, s.k, 1)), 'k', s.k + 1)), s -> s.o)"
    return _let("d", f"replace({m}, ' ', '')", f"if({_let('u', turned, _mod97('u'))} = 1, {_let('e', made, spaced)}, {m})")


def _ip(m: str, key: str) -> str:
    octets = f"transform(split({m}, '[.]'), x -> cast(x as bigint))"
    value = "((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]"
    out = _let("v", feistel_number("ip", "n", 65536, 65536, key), "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)")
    return _let("o", octets, f"if(forall(o, x -> x < 256), {_let('n', value, out)}, {m})")


def _date(m: str, kind: str, key: str) -> str:
    first = "-62091"  # 1800-01-01 in days from 1970-01-01; 146097 = 189 * 773 days follow
    n = f"unix_date(d) - ({first})"
    new = _let("v", feistel_number("date", n, 189, 773, key), f"date_from_unix_date(cast(v as int) + ({first}))")
    if kind == "iso":
        return _let("d", f"try_to_date({m}, 'yyyy-MM-dd')", f"if(d is not null and year(d) between 1800 and 2199, date_format({new}, 'yyyy-MM-dd'), {m})")
    # day first where that is a date, else month first
    return _let(
        "d", f"try_to_date({m}, 'd/M/yyyy')",
        f"if(d is not null and year(d) between 1800 and 2199, date_format({new}, 'dd/MM/yyyy'), "
        + _let("d", f"try_to_date({m}, 'M/d/yyyy')", f"if(d is not null and year(d) between 1800 and 2199, date_format({new}, 'MM/dd/yyyy'), {m})") + ")",
    )


def _ssn(m: str, key: str) -> str:
    area, group, serial = f"cast(left({m}, 3) as bigint)", f"cast(substr({m}, 5, 2) as bigint)", f"cast(right({m}, 4) as bigint)"
    ok = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    n = f"((({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1) * 9999 + {serial} - 1)"
    a = "(v div 989901 + if(v div 989901 >= 665, 2, 1))"
    out = _let("v", feistel_number("ssn", n, 898 * 99, 9999, key), f"concat_ws('-', lpad(cast({a} as string), 3, '0'), lpad(cast(v div 9999 % 99 + 1 as string), 2, '0'), lpad(cast(v % 9999 + 1 as string), 4, '0'))")
    return f"if({ok}, {out}, {m})"


def _phone(m: str, key: str) -> str:
    n = "(((cast(left(t, 3) as bigint) - 200) * 800 + cast(substr(t, 4, 3) as bigint) - 200) * 10000 + cast(right(t, 4) as bigint))"
    made = _let(
        "v", feistel_number("phone", n, 80000, 80000, key),
        "concat(left(d, length(d) - 10), cast(v div 8000000 + 200 as string), cast(v div 10000 % 800 + 200 as string), lpad(cast(v % 10000 as string), 4, '0'))",
    )
    plan = "length(d) <= 13 and left(t, 1) >= '2' and substr(t, 4, 1) >= '2'"
    return _let("d", _digits(m), _let("t", "right(d, 10)", f"if({plan}, {_let('e', made, _refilled(m, 'e'))}, {_abroad(m, key)})"))


def _abroad(m: str, key: str) -> str:
    """The country code, up to three digits after +, stays with the separators."""
    code = f"regexp_extract({m}, '^([+][0-9]{{1,3}})', 1)"
    return f"concat({code}, {feistel_text('phone', f'substr({m}, length({code}) + 1)', key)})"


def _email(m: str, key: str) -> str:
    return f"concat({feistel_text('email', f'substring_index({m}, {_quoted(chr(64))}, 1)', key)}, '@', substring_index({m}, '@', -1))"


def _secret(m: str, key: str) -> str:
    start = _quoted("^[^=:]*[=:] *[\"']?")
    head = f"regexp_extract({m}, {start}, 0)"
    return f"concat({head}, {feistel_text('secret', f'substr({m}, length({head}) + 1)', key)})"


def pseudonym(m: str, key: str = PUBLIC_KEY) -> str:
    """SQL for what stands for the value m."""
    made = {
        "email": _email, "secret": _secret, "access": lambda m, key: f"concat(left({m}, 4), {feistel_text('access', f'substr({m}, 5)', key)})", "iban": _iban, "ip": _ip,
        "iso": lambda m, key: _date(m, "iso", key), "slash": lambda m, key: _date(m, "slash", key), "ssn": _ssn, "card": _card, "phone": _phone, "abroad": _abroad,
    }
    # by its shape, in the patterns' order
    shape = {k: rf"^(?:{p})$" for k, p in PATTERNS.items()}
    return "case " + " ".join(f"when {m} rlike {_quoted(shape[k])} then {made[k](m, key)}" for k in PATTERNS) + f" else {m} end"


def pseudonymised(docs: DataFrame, text: str = "text", counted: str | None = None, key: str | None = None) -> DataFrame:
    """docs with pseudonyms in ``text``; ``counted`` names a column for the number of values that were replaced.

    key: by default the session's setting SETTING. It is part of the plan; spark.sql.redaction.string.regex keeps it
    out of what Spark shows of plans.
    """
    key = key or docs.sparkSession.conf.get(SETTING, PUBLIC_KEY)
    names = [c for c in docs.columns if counted is None or c.lower() != counted.lower()]
    pattern, found, made = (_io.unused(f"pii_{x}", docs) for x in ("pattern", "found", "made"))
    t = f"`{text}`"
    has = f"{t} rlike {_quoted(HINT)} and {t} rlike {pattern}"
    values = f"if({has}, regexp_extract_all({t}, {pattern}, 0), cast(array() as array<string>))"
    df = docs.withColumn(pattern, F.expr(_pattern(t))).withColumn(found, F.expr(values)).withColumn(made, F.expr(f"transform({found}, m -> {pseudonym('m', key)})"))
    joined = f"array_join(flatten(zip_with(split({t}, {pattern}, -1), {made}, (p, m) -> array(p, coalesce(m, '')))), '')"
    n = F.expr(f"size(filter(zip_with({found}, {made}, (a, b) -> a <> b), x -> x))").cast("long")
    new = F.expr(f"if(size({found}) > 0, {joined}, {t})")
    out = [new.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in names]
    return df.select(*out, *([n.alias(counted)] if counted else []))
