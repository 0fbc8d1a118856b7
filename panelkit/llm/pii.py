"""Format-preserving pseudonyms for personal numbers and dates.

Payment cards, bank accounts, social security numbers, telephone numbers, network
addresses, dates and the local parts of e-mail addresses are found, validated (check
digits, ranges, calendar) and put through a keyed Feistel permutation of their own format:
the outcome is valid again, equal values get equal pseudonyms in every document, and
different values different ones. A value is permuted as a whole: every letter and digit of
the pseudonym depends on all of the value. All of it is SQL expressions over one pass of
the texts: a text is split at its matches, the matches are transformed, and the parts
joined again. No pattern repeats a group in a way that the regular expression engine
matches by recursion, so the length of a text or of a match is no matter.

Defined cases: a null text stays null; values that fail validation stay as they are; texts
without findings are unchanged; other columns are kept. The key is a literal of the plan:
whoever can read the session's plans or event logs can read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import wrapped

ROUNDS = 8
#: Dates permuted among themselves: 1900-01-01 to 2099-12-31, 229 * 319 days.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)

EMAIL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Account lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
}


#: Country codes of one and two digits; all others have three.
CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"


def _account(length: int) -> str:
    tail = (length - 4) % 4
    return f"(?:{'|'.join(IBAN_LENGTHS[length].split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(length - 4) // 4}}}" + (f" ?[A-Z0-9]{{{tail}}}" if tail else "") + "(?![A-Za-z0-9])"


IBAN = rf"(?<![A-Za-z0-9])(?:{'|'.join(map(_account, IBAN_LENGTHS))}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9.-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_GROUP = "[0-9]++(?![A-Za-z])"
#: A chain of digit groups, in which cards are looked for; it ends before other values.
CARD = rf"(?<![0-9A-Za-z.-])(?=[0-9](?:[ -]?[0-9]){{12}}){_GROUP}(?:[ -](?!{'|'.join([PHONE, SSN, DATE, ADDRESS])}){_GROUP})*+"
#: Lengths of the groups that cards are written in.
GROUPED = "^(?:1[3-9]|4-4-4-4(?:-[123])?|4-6-[45])$"
ANY = "|".join([EMAIL, IBAN, PHONE, SSN, DATE, ADDRESS, CARD])
KINDS = ("email", "iban", "phone", "ssn", "date", "address", "card")


def _let(value: str, name: str, body: str) -> str:
    """Binds a value once for use in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(left: str, right: str, a: str, b: str, tweak: str, key: str) -> str:
    """(l, r) after keyed rounds over pairs 0 <= left < a, 0 <= right < b."""
    def f(v: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', '{key}', {tweak}, k, {v}), 256), 1, 15), 16, 10) as bigint)"

    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, k) -> if(k % 2 = 0, "
        f"named_struct('l', pmod(s.l + pmod({f('s.r')}, {a}), {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + pmod({f('s.l')}, {b}), {b}))))"
    )


def _base(ch: str) -> str:
    return f"(case when {ch} between '0' and '9' then 48 when {ch} between 'a' and 'z' then 97 else 65 end)"


def _radix(ch: str) -> str:
    return f"(if({ch} between '0' and '9', 10, 26))"


def _shifted(part: str, by: str, tweak: str, key: str) -> str:
    """The letters and digits of ``part``, each moved inside its class by four hexadecimal
    digits of keyed hashes of the other half and the round."""
    block = f"sha2(concat_ws('|', '{key}', {tweak}, k, j, {by}), 256)"
    hashes = f"array_join(transform(sequence(0, (length({part}) - 1) div 16), j -> {block}), '')"
    moved = f"chr({_base('c')} + (ascii(c) - {_base('c')} + cast(conv(substr(hs, i * 4 + 1, 4), 16, 10) as int)) % {_radix('c')})"
    return _let(hashes, "hs", f"array_join(transform(split({part}, ''), (c, i) -> {moved}), '')")


def permuted(s: str, tweak: str, key: str) -> str:
    """A keyed permutation of strings of ASCII letters and digits that keeps the class of
    every character (digit, small or capital letter): Feistel rounds over the two halves of
    the whole string. A single character goes through a keyed order of its class."""
    rounds = (
        f"aggregate(sequence(0, {ROUNDS - 1}), h, (st, k) -> if(k % 2 = 0, named_struct('a', {_shifted('st.a', 'st.b', 't', key)}, 'b', st.b), "
        f"named_struct('a', st.a, 'b', {_shifted('st.b', 'st.a', 't', key)})), st -> concat(st.a, st.b))"
    )
    halves = "named_struct('a', substr(w, 1, cast(length(w) div 2 as int)), 'b', substr(w, cast(length(w) div 2 as int) + 1))"
    ordered = f"array_sort(transform(sequence(0, {_radix('w')} - 1), x -> struct(sha2(concat_ws('|', '{key}', t, 'one', {_base('w')}, x), 256) as o, x as x)))"
    single = f"chr({_base('w')} + {ordered}[ascii(w) - {_base('w')}].x)"
    body = _let(tweak, "t", f"case when length(w) > 1 then {_let(halves, 'h', rounds)} when length(w) = 1 then {single} else '' end")
    return _let(s, "w", body)


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _refilled(form: str, new: str) -> str:
    """The format ``form`` with its letters and digits replaced by those of ``new``."""
    return (
        f"aggregate(split({form}, ''), named_struct('i', 1, 'o', ''), (acc, c) -> if(c rlike '[A-Za-z0-9]', "
        f"named_struct('i', acc.i + 1, 'o', concat(acc.o, substr({new}, acc.i, 1))), named_struct('i', acc.i, 'o', concat(acc.o, c))), acc -> acc.o)"
    )


def _luhn(d: str) -> str:
    """The check digit that belongs after the digits ``d``."""
    doubled = "(case when x > 4 then 2 * x - 9 else 2 * x end)"
    total = f"aggregate(reverse(split({d}, '')), named_struct('i', 0, 't', 0), (acc, c) -> named_struct('i', acc.i + 1, 't', acc.t + {_let('cast(c as int)', 'x', f'if(acc.i % 2 = 0, {doubled}, x)')}), acc -> acc.t)"
    return f"cast(pmod(10 - {total} % 10, 10) as string)"


def _mod97(s: str) -> str:
    return f"aggregate(split({s}, ''), 0, (n, c) -> case when c between '0' and '9' then (n * 10 + ascii(c) - 48) % 97 else (n * 100 + ascii(c) - 55) % 97 end)"


def _valid_card(d: str) -> str:
    return f"(length({d}) between 13 and 19 and {_luhn(f'substr({d}, 1, length({d}) - 1)')} = substr({d}, -1))"


def _card(key: str) -> str:
    """The whole chain if it is one card. Otherwise the runs of groups that are valid, from
    the left: one in a usual grouping first, then the longest other that crosses none."""
    new = _let(f"concat(substr(d, 1, 1), {permuted('substr(d, 2, length(d) - 2)', 'concat(substr(d, 1, 1), chr(99))', key)})", "p", f"concat(p, {_luhn('p')})")
    digits = "array_join(slice(g, a + 1, e - a + 1), '')"
    # a group's candidates: the group they end with and whether the grouping is usual
    ends = f"filter(sequence(a, cast(least(a + 18, size(g) - 1) as int)), e -> {_let(digits, 'd', _valid_card('d'))})"
    usual = f"array_join(transform(slice(g, a + 1, e - a + 1), w -> length(w)), '-') rlike '{GROUPED}'"
    runs = f"transform(sequence(0, size(g) - 1), a -> transform({ends}, e -> named_struct('e', e, 'u', {usual})))"
    own = "element_at(filter(r[a], x -> x.u), 1).e"
    other = "array_max(transform(filter(r[a], x -> x.e = a or not exists(slice(r, a + 2, x.e - a), y -> exists(y, z -> z.u))), x -> x.e))"
    taken = "if(e is null, acc, named_struct('n', e + 1, 'o', array_append(acc.o, named_struct('a', a, 'e', e))))"
    step = f"if(a < acc.n, acc, {_let(f'coalesce(if(exists(r[a], x -> x.u), {own}, null), {other})', 'e', taken)})"
    # a fold over blocks of groups, so that a chain of very many cards appends to short arrays
    inner = f"aggregate(sequence(b * 256, cast(least(b * 256 + 255, size(g) - 1) as int)), named_struct('n', big.n, 'o', cast(array() as array<struct<a:int,e:int>>)), (acc, a) -> {step})"
    outer = _let(inner, "x", "named_struct('n', x.n, 'o', array_append(big.o, x.o))")
    chosen = f"flatten(aggregate(sequence(0, cast((size(g) - 1) div 256 as int)), named_struct('n', 0, 'o', cast(array() as array<array<struct<a:int,e:int>>>)), (big, b) -> {outer}, big -> big.o))"
    # each run in its own format, after the groups since the run before
    run = _let("array_join(slice(h, x.a + 1, x.e - x.a + 1), '')", "m", _let(_digits("m"), "d", _let(new, "q", _refilled("m", "q"))))
    since = "if(i = 0, 0, get(c, i - 1).e + 1)"
    pieces = f"transform(c, (x, i) -> concat(array_join(slice(h, {since} + 1, x.a - {since}), ''), {run}))"
    changed = f"concat(array_join({pieces}, ''), array_join(slice(h, element_at(c, -1).e + 2, size(h)), ''))"
    groups = "split(m, '[ -]')"
    parts = _let("regexp_extract_all(m, '[0-9]+[ -]?', 0)", "h", _let(runs, "r", _let(chosen, "c", f"if(size(c) = 0, m, {changed})")))
    return _let(_digits("m"), "d", f"if({_valid_card('d')}, {_let(new, 'q', _refilled('m', 'q'))}, {_let(groups, 'g', parts)})")


def _iban(key: str) -> str:
    """The whole match, or its longest valid beginning before a space."""
    body = permuted("substr(d, 5)", "concat(substr(d, 1, 2), chr(98))", key)
    check = f"lpad(cast(98 - {_mod97('concat(p, substr(d, 1, 2), chr(48), chr(48))')} as string), 2, '0')"
    new = _let(body, "p", f"concat(substr(d, 1, 2), {check}, p)")
    valid = _let("replace(x, ' ', '')", "d", f"length(d) >= 12 and {_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1")
    begins = "transform(sequence(0, length(m) - length(replace(m, ' ', ''))), k -> substring_index(m, ' ', cast(length(m) - length(replace(m, ' ', '')) + 1 - k as int)))"
    one = _let("replace(v, ' ', '')", "d", f"concat({_let(new, 'q', _refilled('v', 'q'))}, substr(m, length(v) + 1))")
    return _let(f"get(filter({begins}, x -> {valid}), 0)", "v", f"if(v is null, m, {one})")


def _phone(key: str) -> str:
    """The country code stays; it is read off the digits, so spellings of one number are
    linked. A number without one is taken for the numbering plan of +1, in whose national
    forms it is written."""
    code = f"if(startswith(m, '+'), regexp_extract(d, '^({CODES}|[0-9]{{3}})', 1), '')"
    new = f"concat(c, {permuted('substr(d, length(c) + 1)', "concat(if(c = '', '1', c), chr(112))", key)})"
    return _let(_digits("m"), "d", _let(code, "c", f"if(length(d) between 7 and 15, {_let(new, 'q', _refilled('m', 'q'))}, m)"))


def _ssn(key: str) -> str:
    place = "struct(cast(substr(m, 1, 3) as int) as a, cast(substr(m, 5, 2) as int) as g, cast(substr(m, 8, 4) as int) as s)"
    area, rest = "if(x.a > 666, x.a - 2, x.a - 1)", "(x.g - 1) * 9999 + x.s - 1"
    out = "concat(lpad(cast(if(z.l >= 665, z.l + 2, z.l + 1) as string), 3, '0'), '-', lpad(cast(z.r div 9999 + 1 as string), 2, '0'), '-', lpad(cast(z.r % 9999 + 1 as string), 4, '0'))"
    new = _let(_feistel(area, rest, "898", "989901", "'ssn'", key), "z", out)
    return _let(place, "x", f"if(x.a between 1 and 899 and x.a <> 666 and x.g > 0 and x.s > 0, {new}, m)")


def _date(key: str) -> str:
    """ISO, month/day/year, day/month/year where the first can't be a month, and
    day.month.year; one-digit parts stay without a leading zero."""
    form = "case when m like '%-%' then 'yyyy-M-d' when m not like '%/%' then 'd.M.yyyy' when cast(substring_index(m, '/', 1) as int) > 12 then 'd/M/yyyy' else 'M/d/yyyy' end"
    a, b = DAYS
    n = f"datediff(t, date'{FIRST_DAY}')"
    shown = "date_format(e, if(m rlike '(?<![0-9])[0-9](?![0-9])', f, replace(replace(f, 'M', 'MM'), 'd', 'dd')))"
    new = _let(_feistel(f"{n} div {b}", f"{n} % {b}", str(a), str(b), "'date'", key), "z", _let(f"date_add(date'{FIRST_DAY}', cast(z.l * {b} + z.r as int))", "e", shown))
    return _let(form, "f", _let("try_to_date(m, f)", "t", f"if(t between date'{FIRST_DAY}' and date'2099-12-31', {new}, m)"))


def _address(key: str) -> str:
    o = "transform(split(m, '[.]'), x -> cast(x as int))"
    new = _let(_feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "'ip'", key), "z", "concat_ws('.', z.l div 256, z.l % 256, z.r div 256, z.r % 256)")
    return _let(o, "o", f"if(forall(o, x -> x <= 255), {new}, m)")


def _email(key: str) -> str:
    """The letters and digits of the local part, between the signs it has."""
    new = permuted(f"regexp_replace({_local()}, '[^A-Za-z0-9]', '')", _place(), key)
    return f"concat({_let(new, 'q', _refilled(_local(), 'q'))}, substr(m, instr(m, '@')))"


def _local() -> str:
    return "substr(m, 1, instr(m, '@') - 1)"


def _place() -> str:
    return "lower(substr(m, instr(m, '@')))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(m: str) -> str:
    tests = [(EMAIL, "email"), (IBAN, "iban"), (PHONE, "phone"), (SSN, "ssn"), (DATE, "date"), (ADDRESS, "address")]
    return "case " + " ".join(f"when {m} rlike {_quoted('^(?:' + p + ')$')} then '{k}'" for p, k in tests) + " else 'card' end"


def pseudonymised(docs: DataFrame, key: str = "public-test-key", text: str = "text", counts: bool = True) -> DataFrame:
    """The documents with personal values replaced by pseudonyms and, if asked for,
    ``n_<kind>`` columns: how many values of each kind were replaced (input columns of
    these names are replaced). ``key`` is the secret of the permutation."""
    if not key.isascii() or "'" in key or "\\" in key:
        raise ValueError("the key must be plain ASCII without quotes and backslashes")
    names = [c for c in docs.columns if not (counts and c in {f"n_{k}" for k in KINDS})]
    by_kind = {"email": _email(key), "iban": _iban(key), "phone": _phone(key), "ssn": _ssn(key), "date": _date(key), "address": _address(key), "card": _card(key)}
    one = "case kind " + " ".join(f"when '{k}' then {x}" for k, x in by_kind.items()) + " end"
    t = F.col("_row")[text]
    found = wrapped(docs).withColumn("_m", F.regexp_extract_all(t, F.lit(ANY), 0))
    found = found.withColumn("_p", F.when(F.size("_m") > 0, F.split(t, ANY, -1)))
    new = F.expr(f"transform(_m, m -> struct({kind_of('m')} as kind, m as m))")
    found = found.withColumn("_k", F.when(F.size("_m") > 0, new))
    found = found.withColumn("_n", F.expr(f"transform(_k, y -> {_let('y.m', 'm', _let('y.kind', 'kind', one))})"))
    joined = F.expr("array_join(transform(_p, (x, j) -> concat(x, coalesce(get(_n, j), ''))), '')")
    columns = [F.when(F.col("_p").isNull(), t).otherwise(joined).alias(c) if c == text else F.col("_row")[c].alias(c) for c in names]
    if counts:
        columns += [F.expr(f"cast(coalesce(size(filter(_k, (y, j) -> y.kind = '{k}' and y.m <> _n[j])), 0) as int) as n_{k}") for k in KINDS]
    return found.select(*columns)
