r"""Operator 8: format-preserving Feistel pseudonyms for personal data, in SQL functions only.

Found and validated: payment cards (13 to 19 digits, Luhn), telephone numbers (``+`` and country code, 8 to 15 digits, or ten with an area code), US social
security numbers (no area 000, 666 or 9xx; with blanks or without signs where they are named), IPv4 addresses (parts up to 255; a port or a mask may follow), IPv6 addresses (eight groups or
``::``), IBANs (length of the country, mod 97, in either case), calendar dates (1900-01-01 to 2099-08-05, written
year first, a time may follow, or with ``/`` or ``.`` day first, else month first). What does not validate stays; in a row of digit groups every run of whole groups is
tried for a card, and behind an IBAN other signs may follow. Each is permuted by a keyed Feistel network over the
numbers of its own format: separators, lengths, country and area codes and check digits remain those of a valid value, and equal values (of the same
digits) get equal pseudonyms in all documents, however they are written: the country code of a telephone number is told by the list of codes, and a number of ten digits is the
one with code 1. E-mail addresses and secrets (assigned ones, bearer tokens, web tokens, keys of well-known forms, private key blocks), which are no numbers, get pseudonyms of
the same kind from a keyed digest.

A text is split once around what may be personal; the parts between are untouched. Null texts stay null, empty ones empty; rows are independent;
empty tables give no row; other columns are passed through, whatever their names, but for one named ``n_masked``, whose place the count takes. Values that
overlap are found from left to right. Who has the key can undo the permutations: it is an argument without a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
#: A row of digit groups that is long enough for a card.
_CARD = r"\d(?:[ -]?\d){12,120}"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\([2-9]\d{2}\) ?\d{3}[ .-]\d{4}|[2-9]\d{2}[.-]\d{3}[.-]\d{4}"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?:[a-z0-9]{11,30}|(?: \d{4}){3,7}(?: \d{1,3})?)"
_IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: With ``::`` the first group has a digit, so that names in code are left alone.
_IPV6 = rf"(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f]{{0,3}}[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}"
_SSN = r"\d{3}-\d{2}-\d{4}"
#: Other ways to write one, behind its name.
_NAMED_SSN = r"(?<=(?i:\bssn|social security|security number)(?: is| no\.)?[:#]? {0,2})\d{3} ?\d{2} ?\d{4}"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
_KEY_NAME = r"(?i:token|secret|password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key)"
#: Eight signs or more with one that is no letter.
_VALUE = r"""(?=[A-Za-z]*[^\sA-Za-z"'<>,;.])[^\s"'<>,;]{7,}[^\s"'<>,;.:)?!]"""
#: A name with parts before and after, a sign, and a value: twelve letters, digits and their like, or eight signs with one that is no letter.
_SECRET = rf"""(?:[A-Za-z0-9]{{1,20}}[_.-]){{0,4}}{_KEY_NAME}(?:[_-][A-Za-z0-9]{{1,20}}){{0,4}}["']? {{0,2}}[=:] {{0,2}}["']?(?:[A-Za-z0-9+/_-]{{12,}}|{_VALUE})"""
_TOLD = rf"""{_KEY_NAME} (?i:is|was):? ["']?{_VALUE}"""
_BEARER = r"(?i:bearer|basic) {1,2}(?=[A-Za-z]*[0-9._~+/=-])[A-Za-z0-9._~+/-]{16,}=*"
_WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
#: Fixed forms of keys that services give out: their prefix stays.
_PREFIXED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}"
_KEY_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]{1,8000}(?:-[^-]{1,8000}){0,8}-----END [A-Z ]{0,20}PRIVATE KEY-----"
#: The country codes of two digits; 1 and 7 have one digit, all others three.
COUNTRY_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: The lengths of IBANs by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
)
_ALONE, _NO_NUMBER = r"(?![\p{L}\p{N}_@])", r"(?![.,/:-]?\p{N})"
#: No letter, digit or joining sign before or after, so that parts of longer numbers and words are left alone; but a time may follow a date, and a port or mask an address.
_PATTERN = rf"(?<![\p{{L}}\p{{N}}_@])(?<![\p{{N}}][.,/:-])(?:{_KEY_BLOCK}|(?:{_WEB_TOKEN}|{_PREFIXED}|{_SECRET}|{_TOLD}|{_BEARER}|{_EMAIL}){_ALONE}|(?:{_DATE})(?:(?=[T ]\d{{2}}:\d{{2}})|{_NO_NUMBER}{_ALONE})|(?<!:)(?:{_IPV6})(?![.:/]?\p{{N}}|:){_ALONE}|{_IPV4}(?![.,-]?\p{{N}}|:\p{{N}}{{6}}|/\p{{N}}{{3}}){_ALONE}|(?:{_SSN}|{_NAMED_SSN}|{_PHONE}|{_CARD}){_NO_NUMBER}{_ALONE}|(?:{_IBAN}){_ALONE})"
_LOW_DAY, _SIDE = "DATE'1900-01-01'", 270  # 270 * 270 days


def _feistel(a: Column, b: Column, left: Column, right: Column, tweak: str, key: str) -> Column:
    """``struct(a, b)`` after all rounds: a is a number below ``left``, b below ``right``, and stays so."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        noise = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), left.cast("string"), right.cast("string"), s["b"].cast("string"))), 1, 14), 16, 10).cast("long")
        side = F.when(i % 2 == 0, left).otherwise(right)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + noise, side).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**k) for k in range(13))), n + 1).cast("long")


def permute_digits(digits: Column, tweak: str, key: str) -> Column:
    """A permutation of the digit strings of each length from 2 to 24."""
    n = F.length(digits)
    high = F.floor(n / 2).cast("int")
    low = n - high
    out = _feistel(F.substring(digits, F.lit(1), high).cast("long"), F.substring(digits, high + 1, low).cast("long"), _power(high), _power(low), tweak, key)
    return F.transform(F.array(out), lambda x: F.concat(F.lpad(x["a"].cast("string"), high, F.lit("0")), F.lpad(x["b"].cast("string"), low, F.lit("0"))))[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """Put the digits, in their order, at the places of the digits of ``form``."""
    def place(i: Column) -> Column:
        sign = F.substring(form, i, F.lit(1))
        return F.when(sign.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(sign)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), place), "")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Sum of the digits, every second one from the right (the first with shift 0 counts singly) doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when((i + shift) % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _one(value: Column, make) -> Column:
    """``make`` applied to a value that is computed once."""
    return F.transform(F.array(value), make)[0]


def _card(m: Column, key: str) -> Column:
    """Cards among the digit groups of ``m``: from the left, at each group the longest run that validates: of groups of three to six digits, one group, or all."""
    def masked(text: Column, d: Column) -> Column:
        new = _one(permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key), lambda b: F.concat(b, F.pmod(10 - _luhn_sum(b, 1) % 10, F.lit(10)).cast("string")))
        return _fill(text, new)

    def valid(d: Column) -> Column:
        return F.length(d).between(13, 19) & (_luhn_sum(d, 0) % 10 == 0) & (F.length(F.regexp_replace(d, "0", "")) > 0)

    def scan(x: Column) -> Column:
        groups, seps = x["groups"], x["seps"]
        n = F.size(groups)
        state = lambda out, after: F.struct(out.alias("out"), after.cast("int").alias("after"))

        def step(s: Column, i: Column) -> Column:
            whole = lambda j: (i == 0) & (j == n - 1)
            usual = lambda run: (F.size(run) == 1) | F.forall(run, lambda g: F.length(g).between(3, 6))
            ends = F.filter(F.reverse(F.sequence(i, F.least(n - 1, i + 18))), lambda j: _one(F.slice(groups, i + 1, j - i + 1), lambda run: (whole(j) | usual(run)) & valid(F.array_join(run, ""))))

            def take(j: Column) -> Column:
                run = F.zip_with(F.slice(groups, i + 1, j - i + 1), F.slice(seps, i + 1, j - i + 1), lambda g, sep: F.concat(sep, g))
                return _one(F.array_join(run, ""), lambda t: state(F.concat(s["out"], F.substring(t, F.lit(1), F.length(F.get(seps, i))), masked(F.substring(t, F.length(F.get(seps, i)) + 1, F.length(t)), _digits(t))), j + 1))

            return F.when(i < s["after"], s).otherwise(_one(F.get(ends, F.lit(0)), lambda j: F.when(j.isNull(), state(F.concat(s["out"], F.get(seps, i), F.get(groups, i)), i + 1)).otherwise(take(j))))

        return F.aggregate(F.sequence(F.lit(0), n - 1), state(F.lit(""), F.lit(0)), step, lambda s: s["out"])

    return _one(F.struct(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)).alias("groups"), F.split(m, "[0-9]+").alias("seps")), scan)


def _phone(m: Column, key: str) -> Column:
    """The country code stays, and for code 1, which ten digits without one have too, the area code."""
    digits = _digits(m)
    n = F.length(digits)
    code = F.when(F.substring(digits, 1, 1).isin("1", "7"), 1).when(F.substring(digits, 1, 2).isin(COUNTRY_CODES.split()), 2).otherwise(3)
    kept = F.when(~m.startswith("+"), 3).when(digits.startswith("1") & (n == 11), 4).otherwise(code)
    return F.when(n.between(8, 15), _fill(m, F.concat(F.substring(digits, F.lit(1), kept), permute_digits(F.substring(digits, kept + 1, n), "phone", key)))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Area 1 to 899 but 666 (898 values), group 1 to 99, serial 1 to 9999: all valid numbers are permuted among themselves."""
    digits = _digits(m)
    area, group, serial = F.substring(digits, 1, 3).cast("int"), F.substring(digits, 4, 2).cast("int"), F.substring(digits, 6, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = _feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key)

    def write(x: Column) -> Column:
        a = F.floor(x["a"] / 99).cast("int") + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return _fill(m, F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["b"] + 1).cast("string"), 4, "0")))

    return F.when(valid, _one(out, write)).otherwise(m)


def _ipv6(m: Column, key: str) -> Column:
    """Groups that are not zero are moved in turn by a keyed digest of all others (a Feistel network of eight parts), four times; zeros and ``::`` stay."""
    parts = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = parts(F.split_part(m, F.lit("::"), F.lit(1))), parts(F.split_part(m, F.lit("::"), F.lit(2)))

    def masked(x: Column) -> Column:
        written = F.concat(x["left"], x["right"])
        valid = F.when(m.contains("::"), F.size(written) < 8).otherwise(F.size(written) == 8)
        zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(8) - F.size(written), F.lit(0)))
        numbers = lambda side: F.transform(side, lambda g: F.conv(g, 16, 10).cast("long"))

        def step(groups: Column, i: Column) -> Column:
            noise = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), F.lit("ipv6"), i.cast("string"), F.array_join(F.transform(groups, lambda g, k: F.when(k == i % 8, F.lit("")).otherwise(g.cast("string"))), ":"))), 1, 14), 16, 10).cast("long")
            return F.transform(groups, lambda g, k: F.when((k == i % 8) & (g > 0), F.pmod(g - 1 + noise, F.lit(65535)) + 1).otherwise(g))

        moved = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.concat(numbers(x["left"]), zeros, numbers(x["right"])), step)
        as_hex = lambda part: F.array_join(F.transform(part, lambda g: F.when(m.rlike("[A-F]"), F.hex(g)).otherwise(F.lower(F.hex(g)))), ":")
        n = F.size(x["left"])
        text = _one(moved, lambda g: F.concat(as_hex(F.slice(g, F.lit(1), n)), F.when(m.contains("::"), "::").otherwise(""), as_hex(F.slice(g, F.lit(9) - F.size(x["right"]), F.size(x["right"])))))
        return F.when(valid, text).otherwise(m)

    return _one(F.struct(left.alias("left"), right.alias("right")), masked)


def _ipv4(m: Column, key: str) -> Column:
    part = [F.split_part(m, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    out = _feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), "ipv4", key)
    write = lambda x: F.concat_ws(".", *((F.floor(x[h] / 256) if k == 0 else x[h] % 256).cast("string") for h in "ab" for k in (0, 1)))
    return F.when(F.greatest(*part) < 256, _one(out, write)).otherwise(m)


def _mod97(text: Column) -> Column:
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(total: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return F.when(v > 9, total * 100 + v).otherwise(total * 10 + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """The part of ``m`` that is as long as its country's IBANs; what follows stays."""
    n = F.try_element_at(F.create_map(*(F.lit(v) for c in IBAN_LENGTHS.split() for v in (c[:2], int(c[2:])))), F.upper(F.substring(m, 1, 2)))
    ends = F.filter(F.sequence(F.lit(1), F.length(m)), lambda k: F.length(F.replace(F.substring(m, F.lit(1), k), F.lit(" "), F.lit(""))) == n)
    return _one(F.coalesce(F.get(ends, F.lit(0)), F.length(m)), lambda k: F.concat(_one(F.substring(m, F.lit(1), k), lambda head: _whole_iban(head, key)), F.substring(m, k + 1, F.length(m))))


def _whole_iban(m: Column, key: str) -> Column:
    """The digits of the account part are permuted; its letters stay; the check digits are computed anew."""
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def masked(p: Column) -> Column:
        account = F.substring(p, F.lit(5), F.length(p))
        figures = _digits(account)
        new = _one(F.when(F.length(figures) > 1, _fill(account, permute_digits(F.substring(figures, F.lit(1), F.least(F.length(figures), F.lit(24))), "iban", key))).otherwise(account), lambda a: F.concat(F.substring(p, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(p, 1, 2), F.lit("00"), a))).cast("string"), 2, "0"), a))
        return F.when((F.length(p).between(15, 34)) & (F.length(figures) <= 24) & (_mod97(p) == 1), new).otherwise(p)

    spread = lambda p: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", " ").otherwise(F.substring(p, F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return _one(_one(plain, masked), spread)


def _date(m: Column, key: str) -> Column:
    form = lambda y, mo, d: F.try_make_timestamp(y.cast("int"), mo.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    sign = F.when(m.contains("-"), "-").when(m.contains("/"), "/").otherwise(".")
    part = [F.split_part(m, sign, F.lit(k)) for k in (1, 2, 3)]
    year_first = m.contains("-")
    day_first = form(part[2], part[1], part[0])
    day = F.when(year_first, form(*part)).otherwise(F.coalesce(day_first, form(part[2], part[0], part[1])))
    order = F.when(year_first, "y").when(day_first.isNotNull(), "d").otherwise("m")

    def masked(x: Column) -> Column:
        number = F.datediff(x["day"], F.expr(_LOW_DAY))
        out = _feistel(F.floor(number / _SIDE), number % _SIDE, F.lit(_SIDE), F.lit(_SIDE), "date", key)
        new = F.transform(F.array(out), lambda s: F.date_add(F.expr(_LOW_DAY), (s["a"] * _SIDE + s["b"]).cast("int")))[0]
        y, mo, d = (F.lpad(f(new).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.dayofmonth, 2)))
        text = F.when(x["order"] == "y", F.concat_ws("-", y, mo, d)).when(x["order"] == "d", F.concat(d, sign, mo, sign, y)).otherwise(F.concat(mo, sign, d, sign, y))
        return F.when(number.between(0, _SIDE * _SIDE - 1), text).otherwise(m)

    return _one(F.struct(day.alias("day"), order.alias("order")), lambda x: F.when(x["day"].isNull(), m).otherwise(masked(x)))


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256)
    return F.concat(F.lit("user-"), F.substring(digest, 1, 16), F.lit("@example.invalid"))


def _masked_tail(m: Column, head: str, key: str) -> Column:
    """What the expression ``head`` matches at the beginning stays; the rest becomes as many signs of a keyed digest."""
    value = F.substring(m, F.length(F.regexp_extract(m, head, 0)) + 1, F.length(m))
    noise = F.concat(*(F.sha2(F.concat(F.lit(f"{key}|secret{k}|"), value), 256) for k in range(2)))
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.substring(F.repeat(noise, F.ceil(F.length(value) / 128).cast("int")), F.lit(1), F.length(value)))


def _after(head: str):
    return lambda m, key: _masked_tail(m, head, key)


def _key_block(m: Column, key: str) -> Column:
    lines = F.regexp_extract_all(m, F.lit("-----(?:BEGIN|END)[A-Z ]*-----"), F.lit(0))
    return F.concat(F.get(lines, F.lit(0)), F.lit("\n"), F.sha2(F.concat(F.lit(f"{key}|block|"), m), 256), F.lit("\n"), F.get(lines, F.lit(1)))


_KINDS = (
    ("key block", "^-----BEGIN", _key_block), ("web token", rf"^(?:{_WEB_TOKEN})$", _after("^eyJ")), ("prefixed", rf"^(?:{_PREFIXED})$", _after("^(?:A[KS]IA|AIza|[a-z]+[_-](?:live_|pat_)?)")),
    ("email", rf"^(?:{_EMAIL})$", _email), ("secret", rf"^(?:{_SECRET})$", _after(r"""^[^=:]*[=:] {0,2}["']?""")), ("told", rf"^(?:{_TOLD})$", _after(rf"""^{_KEY_NAME} \w+:? ["']?""")), ("bearer", rf"^(?:{_BEARER})$", _after("^[A-Za-z]+ +")),
    ("date", rf"^(?:{_DATE})$", _date), ("ipv6", "^[0-9A-Fa-f]*:", _ipv6), ("ipv4", rf"^(?:{_IPV4})$", _ipv4), ("ssn", r"^\d{3}(?:-\d{2}-| ?\d{2} ?)\d{4}$", _ssn), ("phone", rf"^(?:{_PHONE})$", _phone), ("card", r"^[\d -]+$", _card), ("iban", "^[A-Za-z]{2}[0-9]", _iban),
)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value, or the value itself where it does not validate."""
    out = F.lit(None).cast("string")
    for _, form, mask in reversed(_KINDS):
        out = F.when(m.rlike(form), mask(m, key)).otherwise(out)
    return F.coalesce(out, m)


def mask_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with masked ``text`` and ``n_masked``, the number of values replaced. The key is a secret: it takes part in every pseudonym."""
    others = [c for c in docs.columns if c.lower() not in ("text", "n_masked")]
    found_name, new_name = (next(n for n in (base + "_" * k for k in range(len(others) + 1)) if n not in {c.lower() for c in others}) for base in ("found", "new"))
    text, found, new = F.col("text"), F.col(found_name), F.col(new_name)
    values = F.when(text.rlike(r"[0-9@=:]|(?i:password|passwd|pwd|passphrase|secret|token|key|bearer|basic)"), F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.select(*(f"`{c}`" for c in others), text, values.alias(found_name))
    marked = marked.withColumn(new_name, F.transform(found, lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with(F.split(text, _PATTERN, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    columns = {"text": F.when(F.size(found) > 0, joined).otherwise(text)}
    ordered = [columns["text"].alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_masked"]
    return marked.select(*ordered, F.when(text.isNull(), 0).otherwise(changed).cast("long").alias("n_masked"))


#: The key of the registered queries on the synthetic tables, which hold no real data.
FIXTURE_KEY = "fixture"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), FIXTURE_KEY)
