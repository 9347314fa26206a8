"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates; each is validated (payment cards by Luhn sum, IBANs modulo 97, social security
numbers by their ranges, IPv4 addresses by octets, calendar dates of 1900 to 2099, phone numbers by their digits,
e-mail addresses by form) and replaced by a keyed permutation within its format, so that equal values get equal
pseudonyms in all documents, however they are spaced. Candidates that don't validate stay.

Numbers that stand next to each other are one candidate (RUN: 13 digits or more, parts joined by single spaces or
dashes), which ends before a security number, date, address or mailbox. In it cards that are unbroken or grouped as
usual are validated at each part; what lies between them is a card of any grouping or holds phone numbers.

Two Feistel networks, each of ROUNDS rounds with SHA-256 of key, kind, round and the other half: one over the
characters of a string, whose halves shift each other's digits and letters within their class (digits of cards,
IBANs in either case, phone and security numbers, mailbox names); one over pairs of Z_a x Z_b (dates as day numbers, 17 x 4297 days
of 200 years; addresses, 65536 x 65536). Check digits are computed anew; separators, country codes and mail
domains stay.

The key is the session's setting ``spark.quillspark.pii.key``. Where it is unset, DEMO_KEY serves, with a warning:
that one is public, so whoever has this source can invert such pseudonyms.

Defined cases: a null text stays null with 0 found, an empty one empty; rows that repeat get the same answer; an
empty table gives an empty result; extra columns stay, but for a private_kinds, which pseudonymize replaces; of kinds
that fit one candidate the first of EMAIL, IPV4, IBAN, ISO, DMY, MDY, SSN, runs of numbers, PHONE that validates counts; a
very long text is searched whole.
"""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh

ROUNDS = 8
SETTING, DEMO_KEY = "spark.quillspark.pii.key", "quillspark-demo-key"

# Lengths of IBANs by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 "
    "SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def _iban_pattern() -> str:
    """IBANs in groups of four or unbroken, in either case, as long as their country has them; those of countries that
    aren't listed in capitals, of any length."""
    kinds = []
    for n, some in itertools.groupby(sorted(IBAN_LENGTHS, key=lambda x: (int(x[2:]), x)), lambda x: int(x[2:])):
        rest = f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
        kinds.append(f"(?:{'|'.join(x[:2] for x in some)})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}")
    listed = "|".join(x[:2] for x in IBAN_LENGTHS)
    return rf"(?<!\w)(?=[A-Za-z]{{2}}\d\d)(?:(?i:{'|'.join(kinds)})|(?!{listed})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?!\w)"


EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
IBAN = _iban_pattern()
ISO = r"(?<![\w./-])\d{4}-\d{2}-\d{2}(?!(?!T\d\d)\w|[./-]\d)"
DMY = r"(?<![\w./-])\d{1,2}([./-])\d{1,2}\1\d{4}(?!\w|[./-]\d)"
MDY = r"(?<![\w./-])\d{1,2}([/-])\d{1,2}\1\d{4}(?!\w|[./-]\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|-\d)"
LOCAL = r"\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)"
PHONE = rf"(?<![\w.])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])|\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-](?!{LOCAL}))\d{{3,4}}[ .-]\d{{3,4}}(?!\w)|(?<!\w)\+\d{{8,15}}(?!\w)"
#: Where a run of numbers ends: what has a form of its own begins there.
OTHER = "|".join([EMAIL, IPV4, ISO, r"\d{1,2}(?:/\d{1,2}/|-\d{1,2}-|\.\d{1,2}\.)\d{4}(?!\w|[./-]\d)", SSN, r"\d{2,4}\.\d{3,4}[ .-]\d{3,4}(?!\w)"])
RUN_DIGITS = 200
RUN = rf"(?<![\w.+-])\d(?:(?:[ -](?!{OTHER}))?\d){{12,{RUN_DIGITS - 1}}}(?!\w|-\d)"
#: Cards as they are written, 16 digits before 19: what follows 16 valid ones is rather a check value.
GROUPED = [r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{3}", r"\d{13,19}"]
#: Groups of four as on a card, none of them valid: not taken for phone numbers.
FOURS = r"(?<![\w.])\d{4}(?:[ -]\d{4}){3,}(?!\w)"
ANY = "|".join([EMAIL, IPV4, IBAN, ISO, DMY, SSN, RUN, PHONE])


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds a value once, however often body names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(s: str) -> str:
    return f"if(length({s}) = 0, array(), transform(sequence(1, length({s})), j -> substr({s}, j, 1)))"


def _hash(key: str, kind: str, i: str, other: str) -> str:
    return f"sha2(concat_ws('|', {_lit(key)}, {_lit(kind)}, {i}, {other}), 256)"


def _shift(s: str, digest: str) -> str:
    """Each ASCII digit or letter of s moved within its class by what digest has for its place."""
    k = "cast(conv(substr(d, 1 + (j * 4) % 60, 4), 16, 10) as int)"
    cls = "case when c between '0' and '9' then 48 when c between 'a' and 'z' then 97 when c between 'A' and 'Z' then 65 else 0 end"
    new = f"case {cls} when 0 then c when 48 then char(48 + (ascii(c) - 48 + {k}) % 10) when 97 then char(97 + (ascii(c) - 97 + {k}) % 26) else char(65 + (ascii(c) - 65 + {k}) % 26) end"
    return _let(digest, "d", f"array_join(transform({_chars(s)}, (c, j) -> {new}), '')")


def feistel_text(s: str, key: str, kind: str) -> str:
    """SQL: the string s permuted among strings of its form."""
    start = "named_struct('l', substr(v, 1, length(v) div 2), 'r', substr(v, length(v) div 2 + 1))"
    odd = f"named_struct('l', {_shift('a.l', _hash(key, kind, 'i', 'a.r'))}, 'r', a.r)"
    even = f"named_struct('l', a.l, 'r', {_shift('a.r', _hash(key, kind, 'i', 'a.l'))})"
    return _let(s, "v", f"aggregate(sequence(1, {ROUNDS}), {start}, (a, i) -> if(i % 2 = 0, {odd}, {even}), a -> concat(a.l, a.r))")


def feistel_pair(n: str, a: int, b: int, key: str, kind: str) -> str:
    """SQL: the number n of [0, a * b) permuted."""
    number = lambda other: f"cast(conv(substr({_hash(key, kind, 'i', other)}, 1, 14), 16, 10) as bigint)"
    start = f"named_struct('q', v div {b}L, 'r', v % {b}L)"
    odd = f"named_struct('q', (s.q + {number('s.r')}) % {a}L, 'r', s.r)"
    even = f"named_struct('q', s.q, 'r', (s.r + {number('s.q')}) % {b}L)"
    return _let(f"cast({n} as bigint)", "v", f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(i % 2 = 1, {odd}, {even}), s -> s.q * {b}L + s.r)")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, new: str, keep: int | str = 0, chars: str = "[0-9A-Z]") -> str:
    """m with its digits and capitals (chars), from the keep-th on, replaced by the characters of new in turn."""
    step = f"if(c rlike '{chars}', named_struct('n', a.n + 1, 'o', concat(a.o, if(a.n < {keep}, c, substr(w, a.n - {keep} + 1, 1)))), named_struct('n', a.n, 'o', concat(a.o, c)))"
    return _let(new, "w", f"aggregate({_chars(m)}, named_struct('n', 0, 'o', ''), (a, c) -> {step}, a -> a.o)")


def _luhn(d: str) -> str:
    """The Luhn sum of digits d followed by a check digit 0."""
    twice = "2 * cast(c as int) - if(cast(c as int) > 4, 9, 0)"
    return f"aggregate(reverse({_chars(d)}), named_struct('p', 0, 's', 0), (a, c) -> named_struct('p', a.p + 1, 's', a.s + if(a.p % 2 = 0, {twice}, cast(c as int))), a -> a.s)"


def _mod97(s: str) -> str:
    """The number that s stands for, letters as 10 to 35, modulo 97."""
    step = "if(c between '0' and '9', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate({_chars(s)}, 0, (a, c) -> {step})"


def _card(key: str, m: str = "m") -> tuple[str, str]:
    valid = _let(_digits(m), "d", f"length(d) between 13 and 19 and ({_luhn('substr(d, 1, length(d) - 1)')} + cast(right(d, 1) as int)) % 10 = 0 and d <> repeat('0', length(d))")
    payload = feistel_text("substr(d, 1, length(d) - 1)", key, "card")
    new = _let(_digits(m), "d", _let(payload, "x", f"concat(x, cast((10 - {_luhn('x')} % 10) % 10 as string))"))
    return valid, _refill(m, new)


def _iban(key: str) -> tuple[str, str]:
    plain = "upper(replace(m, ' ', ''))"
    valid = _let(plain, "p", f"length(p) between 15 and 34 and {_mod97('concat(substr(p, 5), substr(p, 1, 4))')} = 1")
    check = f"lpad(cast(98 - {_mod97("concat(x, substr(p, 1, 2), '00')")} as string), 2, '0')"
    new = _let(plain, "p", _let(feistel_text("substr(p, 5)", key, "iban"), "x", f"concat({check}, x)"))
    filled = _refill("m", new, 2, "[0-9A-Za-z]")
    return valid, _let(filled, "f", "if(m = lower(m), lower(f), f)")


def _date(key: str, year: str, month: str, day: str, back: str) -> tuple[str, str]:
    y, mo, d = (f"cast({x} as int)" for x in (year, month, day))
    last = f"case when {mo} = 2 then 28 + if({y} % 4 = 0 and ({y} % 100 <> 0 or {y} % 400 = 0), 1, 0) when {mo} in (4, 6, 9, 11) then 30 else 31 end"
    valid = f"{y} between 1900 and 2099 and {mo} between 1 and 12 and {d} between 1 and {last}"
    number = f"datediff(make_date({y}, {mo}, {d}), date'1900-01-01')"
    new = _let(f"date_add(date'1900-01-01', cast({feistel_pair(number, 17, 4297, key, 'date')} as int))", "t", back)
    return valid, new


def _address(key: str) -> tuple[str, str]:
    octet = lambda i: f"cast(element_at(o, {i}) as bigint)"
    valid = "forall(split(m, '\\\\.'), x -> cast(x as int) <= 255)"
    number = _let("split(m, '\\\\.')", "o", f"(({octet(1)} * 256 + {octet(2)}) * 256 + {octet(3)}) * 256 + {octet(4)}")
    new = _let(feistel_pair(number, 65536, 65536, key, "ip"), "x", "concat_ws('.', x div 16777216L, x div 65536L % 256, x div 256L % 256, x % 256)")
    return valid, new


def _phone(key: str) -> tuple[str, str]:
    # digits of a country code behind + stay; they end at a separator, else the first one is taken for the code
    code = "if(m rlike '^\\\\+', greatest(1, length(regexp_extract(m, '^\\\\+([0-9]{1,3})[ .(-]', 1))), 0)"
    valid = f"length({_digits('m')}) between 7 and 15"
    new = _let(code, "k", _refill("m", feistel_text(f"substr({_digits('m')}, k + 1)", key, "phone"), "k"))
    return valid, new


def _piece(kind: str | None, m: str) -> str:
    return f"named_struct('kind', {'cast(null as string)' if kind is None else _lit(kind)}, 'm', {m})"


def _phones(s: str) -> str:
    """SQL: the string s as pieces, its phone numbers and what lies between them."""
    between, found = f"split({s}, {_lit(FOURS + '|' + PHONE)}, -1)", f"regexp_extract_all({s}, {_lit(FOURS + '|' + PHONE)}, 0)"
    kind = f"named_struct('kind', if(p rlike {_lit('^' + FOURS + '$')}, null, 'phone'), 'm', p)"
    return f"flatten(zip_with({between}, {found}, (g, p) -> if(p is null, array({_piece(None, 'g')}), array({_piece(None, 'g')}, {kind}))))"


def _numbers(key: str) -> str:
    """SQL: the run of numbers m as pieces struct(kind, m), kind null for what stays."""
    valid = lambda x: f"({x} <> '' and {_card(key, x)[0]})"
    tries = ", ".join(f"regexp_extract(a.r, {_lit('^' + g + r'(?!\w|-\d)')}, 0)" for g in GROUPED)
    # a: r the rest of the run, g what has stayed since the last card, o the pieces
    part = "regexp_extract(a.r, '^[^ ]+ ?| ', 0)"
    taken = f"named_struct('r', substr(a.r, length(c) + 1), 'g', '', 'o', concat(a.o, array({_piece(None, 'a.g')}, {_piece('card', 'c')})))"
    passed = _let(part, "p", "named_struct('r', substr(a.r, length(p) + 1), 'g', concat(a.g, p), 'o', a.o)")
    step = _let(f"get(filter(array({tries}), x -> {valid('x')}), 0)", "c", f"if(c is null, {passed}, {taken})")
    start = f"named_struct('r', m, 'g', '', 'o', cast(array() as array<struct<kind:string,m:string>>))"
    cut = f"aggregate(sequence(1, 2 * size(split(m, ' '))), {start}, (a, i) -> if(a.r = '', a, {step}), a -> concat(a.o, array({_piece(None, 'a.g')})))"
    # between such cards: one of any grouping, unless a phone number of a fixed form is there
    loose = f"if(s.m rlike {_lit(r'(?<![\w.])' + LOCAL)}, '', regexp_extract(s.m, {_lit(CARD)}, 0))"
    at = "instr(s.m, c)"
    around = f"concat({_phones(f'substr(s.m, 1, {at} - 1)')}, array({_piece('card', 'c')}), {_phones(f'substr(s.m, {at} + length(c))')})"
    gap = _let(loose, "c", f"if({valid('c')}, {around}, {_phones('s.m')})")
    return f"flatten(transform({cut}, s -> if(s.kind = 'card', array(s), {gap})))"


def pseudonym(key: str) -> str:
    """SQL: struct(kinds, value) for a candidate m; no kinds if nothing in it validates."""
    whole = lambda p: f"m rlike {_lit('^(?:' + p + ')$')}"
    sep = "if(m rlike '^[0-9]+/', '/', if(m rlike '^[0-9]+-', '-', '.'))"
    part = lambda i: f"element_at(split(m, '[./-]'), {i})"
    pad = lambda i, f: f"if(length({part(i)}) = 2, date_format(t, '{f}{f}'), date_format(t, '{f}'))"
    mail = ("true", f"concat({feistel_text("substring_index(m, '@', 1)", key, 'mail')}, '@', substring_index(m, '@', -1))")
    ssn = ("substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'", _refill("m", feistel_text(_digits("m"), key, "ssn")))
    kinds = [
        ("email", EMAIL, mail),
        ("ip", IPV4, _address(key)),
        ("iban", IBAN, _iban(key)),
        ("date", ISO, _date(key, part(1), part(2), part(3), "cast(t as string)")),
        ("date", DMY, _date(key, part(3), part(2), part(1), f"concat({pad(1, 'd')}, {sep}, {pad(2, 'M')}, {sep}, date_format(t, 'yyyy'))")),
        ("date", MDY, _date(key, part(3), part(1), part(2), f"concat({pad(1, 'M')}, {sep}, {pad(2, 'd')}, {sep}, date_format(t, 'yyyy'))")),
        ("ssn", SSN, ssn),
        ("phone", PHONE, _phone(key)),
    ]
    cases = " ".join(f"when {whole(p)} and {valid} then named_struct('kinds', array('{kind}'), 'value', {new})" for kind, p, (valid, new) in kinds)
    number = f"case s.kind when 'card' then {_let('s.m', 'm', _card(key)[1])} when 'phone' then if({_let('s.m', 'm', _phone(key)[0])}, {_let('s.m', 'm', _phone(key)[1])}, s.m) else s.m end"
    run = _let(_numbers(key), "l", f"named_struct('kinds', transform(filter(l, s -> s.kind is not null), s -> s.kind), 'value', array_join(transform(l, s -> {number}), ''))")
    return f"case when {whole(RUN)} then {run} {cases} else named_struct('kinds', cast(array() as array<string>), 'value', m) end"


def _replaced(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, list[Column], Column]:
    """(docs with its candidates, its columns with the column text pseudonymised, the kinds replaced)."""
    t, (m, p) = F.col(text), fresh(docs, "_m", "_p")
    found = docs.withColumn(m, F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    found = found.withColumn(p, F.expr(f"transform({m}, m -> {pseudonym(key)})"))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col(p)["value"], lambda g, p: F.array(g, p))
    new = F.when(F.col(p).isNotNull(), F.array_join(F.flatten(pieces), "")).otherwise(t)
    kinds = F.coalesce(F.flatten(F.col(p)["kinds"]), F.array().cast("array<string>"))
    return found, [new.alias(text) if c == text else x for c, x in zip(docs.columns, columns(docs))], kinds


def key_of(spark: SparkSession) -> str:
    """The session's key, or the public one."""
    key = spark.conf.get(SETTING, None)
    if not key:
        warnings.warn(f"{SETTING} is unset: pseudonyms are made with a public key and can be inverted", stacklevel=3)
    return key or DEMO_KEY


def pseudonymize(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with the column text pseudonymised, and private_kinds added: the kinds replaced, in their order.

    Without a key, the session's is taken."""
    found, cols, kinds = _replaced(docs.drop("private_kinds"), text, key or key_of(docs.sparkSession))
    return found.select(*cols, kinds.alias("private_kinds"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5 over all documents: doc_id, text with pseudonyms, how many there are, and their kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", "text", F.size("private_kinds").cast("long").alias("n_private"), F.array_join("private_kinds", ",").alias("private_kinds"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their texts pseudonymised."""
    found, cols, _ = _replaced(docs, "text", key_of(spark))
    return found.select(*cols)
