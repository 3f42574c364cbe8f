"""Format-preserving pseudonyms for validated numbers and dates, in Spark expressions only.

A value is read as digits of a mixed-radix number; an 8-round alternating Feistel network over
these digits (round function: SHA-512 of key, kind, round and the other half, added modulo each
digit's radix; no two digits share a part of the digest) permutes all values of its format. Equal values get equal pseudonyms in every
document; who has the key can undo the permutation.

Kinds and what is validated and permuted:
- card: 13 to 19 digits, plain or in groups, that pass the Luhn test; all digits but the check
  digit, which is computed anew;
- date: a calendar day of 1900 to 2099 as y-m-d, y/m/d, d.m.y, m/d/y or, where that is no day, d/m/y; the day
  number, so one day has one pseudonym in every notation. The permutation is walked on until the new day of the month is over 12 if the old one was,
  and not if not: so what is written d/m/y reads as d/m/y again, and no two days share a pseudonym;
- iban: a country code and up to 30 letters and digits, plain or in groups, whose check digits are right (mod 97); all but
  the country, each character within its class, with check digits computed anew;
- ssn: ddd-dd-dddd in the issued ranges (area, group and serial);
- phone: ten digits after an optional country code, which stays;
- ip: four numbers up to 255;
- email: letters and digits of the local part, each within its class.
What fails its test (a number of 16 digits with a wrong check digit, 31.02.) stays as it is.

The key is the caller's: ``pseudonymise`` has no default. The registered query and the pipeline read it from the session's
setting ``spanweave.pseudonyms.key``; where that is unset they use a published one, for demonstration.

Defined cases: null text stays null; a text without matches is returned unchanged; other columns
are kept, and columns named like the added ones are replaced; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.text import quoted

#: Not a secret.
DEMONSTRATION_KEY = "public-demonstration-key"
KEY_SETTING = "spanweave.pseudonyms.key"
ROUNDS = 8
#: 1900-01-01 to 2099-12-31 are 73,049 = 17 * 4297 days.
FIRST_DAY, DATE_RADIX = "DATE'1900-01-01'", (17, 4297)
#: Steps of a day's walk, of which about two are taken; one that were not back by then (probability under 1e-14) would not be one-to-one.
WALK = 80

_DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
_CARD = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
PATTERN = rf"(?<![\p{{L}}\p{{N}}]|\d[.,/-])(?=[+(0-9])(?:{_DATE}|{_SSN}|{_IP}|{_CARD}|{_PHONE})(?![\p{{L}}\p{{N}}]|[.,/-]\d)|(?<![\p{{L}}\p{{N}}]){_IBAN}(?![\p{{L}}\p{{N}}])|{_EMAIL}"


def _sql(text: str) -> str:
    """As a raw SQL string literal."""
    return 'r"' + text + '"'


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(values: str, radixes: str, kind: str, key: str) -> str:
    """values, radixes: SQL of array<int> of one length."""
    first = "(size(vs) div 2)"
    other = f"cast(if(r % 2 = 1, slice(acc, {first} + 1, size(acc) - {first}), slice(acc, 1, {first})) as string)"
    # 21 numbers of 24 bits from each digest
    digest = f"transform(sequence(0, greatest(0, size(acc) - 1) div 21), b -> sha2(concat_ws('|', {key}, '{kind}', cast(r as string), cast(b as string), {other}), 512))"
    step = "cast(pmod(v + cast(conv(substr(dg[i div 21], 1 + 6 * (i % 21), 6), 16, 10) as bigint), rs[i]) as int)"
    moved = f"transform(acc, (v, i) -> if((i < {first}) = (r % 2 = 1), {step}, v))"
    fold = f"aggregate(sequence(1, {ROUNDS}), vs, (acc, r) -> {_let('dg', digest, moved)})"
    return _let("vs", values, _let("rs", radixes, fold))


def _ints(chars: str) -> str:
    return f"transform({chars}, c -> cast(c as int))"


def _digits(m: str) -> str:
    """Decimal digits of a string as array<int>."""
    return _ints(f"filter(split({m}, ''), c -> c between '0' and '9')")


def _put_digits(m: str, digits: str) -> str:
    """m with its decimal digits replaced, from the first on, by those of an array."""
    step = "if(c between '0' and '9', struct(concat(a.o, cast(ds[a.k] as string)) as o, a.k + 1 as k), struct(concat(a.o, c) as o, a.k as k))"
    fold = f"aggregate(split({m}, ''), struct('' as o, 0 as k), (a, c) -> {step}, a -> a.o)"
    return _let("ds", digits, fold)


def _luhn(digits: str, double_last: int) -> str:
    """Luhn sum; double_last 1: the last digit given is doubled (a check digit is yet to come)."""
    each = f"if((size(lu) - 1 - j + {double_last}) % 2 = 1, if(d > 4, 2 * d - 9, 2 * d), d)"
    return _let("lu", digits, f"aggregate(transform(lu, (d, j) -> {each}), 0, (s, d) -> s + d)")


def _card(key: str) -> str:
    body = _feistel("slice(dd, 1, size(dd) - 1)", "array_repeat(10, size(dd) - 1)", "card", key)
    whole = _let("cd", body, f"concat(cd, array(cast(pmod(10 - {_luhn('cd', 1)} % 10, 10) as int)))")
    return _let("dd", _digits("m"), f"if({_luhn('dd', 0)} % 10 = 0, {_put_digits('m', whole)}, m)")


def _date(key: str) -> str:
    dash, slash, dots = "substr(m, 5, 1) = '-'", "substr(m, 5, 1) = '/'", "substr(m, 3, 1) = '.'"
    month_first = "concat_ws('-', substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2))"
    day_first = "concat_ws('-', substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2))"
    form = (
        f"case when {dash} then 'yyyy-MM-dd' when {slash} then 'yyyy/MM/dd' when {dots} then 'dd.MM.yyyy' "
        f"when try_cast({month_first} as date) is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    )
    iso = f"case when {dash} or {slash} then replace(m, '/', '-') when fm = 'MM/dd/yyyy' then {month_first} else {day_first} end"
    a, b = DATE_RADIX
    once = _feistel(f"array(cast(cw div {b} as int), cast(cw % {b} as int))", f"array({a}, {b})", "date", key)
    step = _let("nd", once, f"nd[0] * {b} + nd[1]")
    late = lambda n: f"day(date_add({FIRST_DAY}, {n})) > 12"
    moved = f"aggregate(sequence(1, {WALK}), dn, (cw, ct) -> if(ct > 1 and ({late('cw')}) = ({late('dn')}), cw, {step}))"
    shown = _let("dt", f"date_add({FIRST_DAY}, {moved})", "date_format(dt, fm)")
    return _let("fm", form, _let("dn", f"datediff(try_cast({iso} as date), {FIRST_DAY})", f"if(dn between 0 and {a * b - 1}, {shown}, m)"))


def _iban(key: str) -> str:
    """ib: its characters without blanks. Modulo 97 the rearranged number must be 1."""
    number = "if(c between '0' and '9', cast(c as int), ascii(c) - 55)"
    rest = lambda body, check: (
        f"aggregate(concat({body}, slice(ib, 1, 2), {check}), cast(0 as bigint), (t, c) -> pmod(t * if(c between '0' and '9', 10, 100) + {number}, 97))"
    )
    values = "transform(bo, c -> if(c between '0' and '9', cast(c as int), ascii(c) - 65))"
    radixes = "transform(bo, c -> if(c between '0' and '9', 10, 26))"
    moved = _feistel(values, radixes, "iban", key)
    letters = f"transform({moved}, (v, i) -> if(bo[i] between '0' and '9', cast(v as string), char(65 + v)))"
    zeros = "array('0', '0')"
    check = f"lpad(cast(98 - {rest('nb', zeros)} as string), 2, '0')"
    whole = f"concat(slice(ib, 1, 2), split({check}, ''), nb)"
    step = "if(c = ' ', struct(concat(a.o, c) as o, a.k as k), struct(concat(a.o, ni[a.k]) as o, a.k + 1 as k))"
    put = f"aggregate(split(m, ''), struct('' as o, 0 as k), (a, c) -> {step}, a -> a.o)"
    changed = _let("nb", letters, _let("ni", whole, put))
    valid = f"size(ib) between 15 and 34 and {rest('bo', 'slice(ib, 3, 2)')} = 1"
    return _let("ib", "filter(split(m, ''), c -> c <> ' ')", _let("bo", "slice(ib, 5, size(ib) - 4)", f"if({valid}, {changed}, m)"))


def _ssn(key: str) -> str:
    # areas 001-665 and 667-899 are numbered 0 to 897
    area = "if(ar > 666, ar - 2, ar - 1)"
    moved = _feistel(f"array(cast({area} as int), gr - 1, se - 1)", "array(898, 99, 9999)", "ssn", key)
    shown = _let(
        "sv", moved, "concat_ws('-', lpad(cast(if(sv[0] > 664, sv[0] + 2, sv[0] + 1) as string), 3, '0'), lpad(cast(sv[1] + 1 as string), 2, '0'), lpad(cast(sv[2] + 1 as string), 4, '0'))"
    )
    valid = "ar between 1 and 899 and ar <> 666 and gr > 0 and se > 0"
    inner = _let("se", "cast(substr(m, 8, 4) as int)", f"if({valid}, {shown}, m)")
    return _let("ar", "cast(substr(m, 1, 3) as int)", _let("gr", "cast(substr(m, 5, 2) as int)", inner))


def _ip(key: str) -> str:
    moved = f"array_join(transform({_feistel('ip', 'array_repeat(256, 4)', 'ip', key)}, o -> cast(o as string)), '.')"
    return _let("ip", _ints(r"split(m, r'\.')"), f"if(forall(ip, o -> o < 256), {moved}, m)")


def _phone(key: str) -> str:
    moved = _feistel("slice(ph, size(ph) - 9, 10)", "array_repeat(10, 10)", "phone", key)
    return _let("ph", _digits("m"), _put_digits("m", f"concat(slice(ph, 1, size(ph) - 10), {moved})"))


def _email(key: str) -> str:
    base = "if(c between '0' and '9', 48, if(c between 'a' and 'z', 97, 65))"
    plain = "filter(split(lo, ''), c -> c rlike '[0-9A-Za-z]')"
    values = f"transform(al, c -> ascii(c) - {base})"
    radixes = "transform(al, c -> if(c between '0' and '9', 10, 26))"
    moved = _feistel(values, radixes, "email", key)
    letters = f"transform({moved}, (v, i) -> {_let('c', 'al[i]', f'char(v + {base})')})"
    step = "if(c rlike '[0-9A-Za-z]', struct(concat(a.o, nl[a.k]) as o, a.k + 1 as k), struct(concat(a.o, c) as o, a.k as k))"
    fold = f"aggregate(split(lo, ''), struct('' as o, 0 as k), (a, c) -> {step}, a -> a.o)"
    changed = f"concat({_let('nl', letters, fold)}, substr(m, instr(m, '@')))"
    return _let("lo", "substr(m, 1, instr(m, '@') - 1)", _let("al", plain, f"if(size(al) = 0, m, {changed})"))


def pseudonym_sql(key: str) -> str:
    """SQL of the pseudonym of the lambda variable m."""
    k = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    kinds = ((_DATE, _date), (_SSN, _ssn), (_IP, _ip), (_CARD, _card), (_IBAN, _iban))
    cases = "".join(f" when m rlike {_sql(f'^(?:{p})$')} then {f(k)}" for p, f in kinds)
    return f"case when contains(m, '@') then {_email(k)}{cases} else {_phone(k)} end"


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text column pseudonymised and n_matches, n_replaced added or replaced."""
    own = [c for c in docs.columns if c not in ("n_matches", "n_replaced")]
    every = [F.col(quoted(c)) for c in own]
    found = docs.select(*every, F.expr(f"regexp_extract_all(`{text}`, {_sql(PATTERN)}, 0)").alias("_found"))
    new = found.select(*every, "_found", F.expr(f"transform(_found, m -> {pseudonym_sql(key)})").alias("_new"))
    joined = f"array_join(zip_with(split(`{text}`, {_sql(PATTERN)}, -1), _new, (g, m) -> concat(g, coalesce(m, ''))), '')"
    return new.select(
        *[F.expr(f"if(size(_found) > 0, {joined}, `{text}`)").alias(text) if c == text else F.col(quoted(c)) for c in own],
        F.expr("coalesce(size(_found), 0)").alias("n_matches"),
        F.expr("coalesce(size(filter(zip_with(_found, _new, (a, b) -> a <> b), x -> x)), 0)").alias("n_replaced"),
    )


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs.select("doc_id", "text"), key_of(spark))


QUERIES = {"op7_pseudonyms": op7_pseudonyms}
ORACLE: dict[str, str] = {}
