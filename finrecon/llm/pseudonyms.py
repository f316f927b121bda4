"""Format-preserving pseudonyms for personal data: keyed Feistel permutations, as Column expressions only.

Candidates are found by one pattern, validated by kind, and replaced in place; all other text stays as it is. A value is
permuted within the set of valid values of its format, so equal values get equal pseudonyms in every document, different values get different ones, and the
holder of the key can go back with ``revealed``. Kinds:

card    13-19 digits that pass the Luhn test: the first digit stays, the others are permuted, the check digit follows
iban    letters and digits whose mod-97 test passes: country and classes of characters stay, the check digits follow
ssn     ddd-dd-dddd within the issued ranges, permuted within those
phone   + and 8-15 digits, or ten digits written ddd-ddd-dddd, ddd.ddd.dddd or (ddd) ddd-dddd: country code, by the table of codes, and punctuation stay; the digits after the code
        decide alone, so a number is the same with and without separators, and a ten-digit one the same as with +1 in front
ip      four numbers up to 255, permuted as 32 bits
ipv6    eight groups or fewer with ::, permuted as two halves of 64 bits, so addresses of one network stay in one; written as eight groups, which is how they come back
date    a valid day of 1900-2099 written y-m-d, d/m/y or d.m.y: permuted among the days of its century; written with leading zeros;
        m/d/y, told by a day after 12, keeps day and month and gets another year of the century
email   letters and digits before the @ are permuted within their alphabets (``ALPHABETS``); the rest stays

The key is a string, or a Column, such as one joined from a table that only the job may read: a string becomes a literal of the plan, which explain output and event logs show.
The hash is HMAC-SHA-256 under the digest of the key. A Feistel step adds a keyed hash of one half to the other half modulo that half's size, so the pair of sizes can be any product, and no value needs a
second try. Candidates that fail validation stay. Defined cases: a null text stays null; empty texts, repeated rows and other columns are
kept as they are; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv6", "ip", "date")
#: The written forms, in the order in which they are tried.
FORMS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d+.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.+-])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\d-]|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
}
PATTERN = "|".join(f"(?:{FORMS[k]})" for k in KINDS)
#: International dialling codes of one and two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: Alphabets as (first code point, letters): ASCII, Latin-1, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
ALPHABETS = (
    (97, 26), (65, 26), (48, 10), (0xE0, 23), (0xF8, 7), (0xC0, 23), (0xD8, 7), (0x3B1, 25), (0x391, 17), (0x3A3, 7), (0x430, 32), (0x410, 32), (0x5D0, 27),
    (0x627, 20), (0x905, 53), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
)
#: Any form holds one of these; texts without them are passed over by a plain scan.
QUICK = "[0-9@]"


_HEX = "0123456789abcdef"


def _pad(key: Column, byte: int) -> Column:
    """The digest of the key in 64 letters A-P, one block of the hash, with each byte xored."""
    return F.translate(F.sha2(key, 256), _HEX, "".join(chr((65 + i) ^ byte) for i in range(16)))


def hmac(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 of the message under the digest of the key, its hex digits written A-P; as hex digits."""
    inner = F.unhex(F.sha2(F.concat(_pad(key, 0x36), message), 256))
    return F.sha2(F.concat(F.encode(_pad(key, 0x5C), "utf-8"), inner), 256)


def _hash(key: Column, kind: str | Column, turn: Column, half: Column) -> Column:
    digest = hmac(key, F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, turn.cast("string"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: Column, kind: str | Column, back: bool = False) -> Column:
    """struct(x, y) after the rounds; x counts modulo a and y modulo b."""

    def turn(s: Column, r: Column) -> Column:
        to_x = _hash(key, kind, r, s["y"]) % a
        to_y = _hash(key, kind, r, s["x"]) % b
        nx = F.pmod(s["x"] - to_x, a) if back else F.pmod(s["x"] + to_x, a)
        ny = F.pmod(s["y"] - to_y, b) if back else F.pmod(s["y"] + to_y, b)
        odd = r % 2 == 1
        return F.struct(F.when(odd, nx).otherwise(s["x"]).alias("x"), F.when(odd, s["y"]).otherwise(ny).alias("y"))

    turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _of_digits(digits: Column, key: Column, kind: str | Column, back: bool) -> Column:
    """A permutation of the strings of as many digits."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    ten = F.lit(10.0)
    x = F.coalesce(F.substr(digits, F.lit(1), h).try_cast("long"), F.lit(0))
    y = F.coalesce(F.substr(digits, h + 1, n - h).try_cast("long"), F.lit(0))
    s = feistel(x, y, F.pow(ten, h).cast("long"), F.pow(ten, n - h).cast("long"), key, kind, back)
    # One pass over a one-element array names the result once.
    return F.transform(F.array(s), lambda v: F.concat(F.when(h > 0, F.lpad(v["x"].cast("string"), h, "0")).otherwise(""), F.lpad(v["y"].cast("string"), n - h, "0")))[0]


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _filled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn by those given."""
    chars = F.split(shape, "")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("k"),
        ),
    )
    return step["out"]


def luhn(digits: Column) -> Column:
    """Sum of the Luhn test; 0 modulo 10 passes."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(m: Column, key: Column, back: bool) -> Column:
    def put(d: Column) -> Column:
        inner = _of_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", back)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), inner)
        return _named(body, lambda p: F.concat(p, F.pmod(-luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))

    return _named(_digits(m), lambda d: F.when(luhn(d) % 10 == 0, _filled(m, put(d))).otherwise(m))


def _shifted(text: Column, key: Column, kind: str, back: bool) -> Column:
    """Letters and digits permuted within their classes: the even and the odd places are the halves, shifted by a keyed stream."""
    n = F.length(text)

    def turn(s: Column, r: Column) -> Column:
        other = F.array_join(F.filter(F.split(s, ""), lambda c, i: i % 2 == r % 2), "")
        stream = hmac(key, F.concat_ws("|", F.lit(kind), r.cast("string"), n.cast("string"), other))

        def move(c: Column, i: Column) -> Column:
            # Places that are a multiple of twelve apart share a number, which the place shifts.
            by = (F.conv(F.substr(stream, (F.floor(i / 2) % 12 * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int") + F.floor(i / 24)) * (-1 if back else 1)
            code = F.ascii(c)
            chain = F
            for low, size in ALPHABETS:
                new = F.pmod(code - low + by, F.lit(size)) + low
                text_of = F.char(new) if low < 128 else F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE")
                chain = chain.when(code.between(low, low + size - 1), text_of)
            return F.when(i % 2 == r % 2, c).otherwise(chain.otherwise(c))

        return F.array_join(F.transform(F.split(s, ""), move), "")

    turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, text, turn)


def _email(m: Column, key: Column, back: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(_shifted(F.substr(m, F.lit(1), at - 1), key, "email", back), F.substr(m, at, F.length(m)))


def _mod97(text: Column) -> Column:
    """The number that letters as 10-35 and digits spell, modulo 97."""

    def add(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c.rlike("[0-9]"), (r * 10 + code - 48) % 97).when(c.rlike("[A-Z]"), (r * 100 + code - 55) % 97).otherwise(r)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: Column, back: bool) -> Column:
    def put(body: Column) -> Column:
        check = 98 - _mod97(F.concat(body, F.substr(m, F.lit(1), F.lit(2)), F.lit("00")))
        return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), body)

    body = F.substr(m, F.lit(5), F.length(m))
    valid = _mod97(F.concat(body, F.substr(m, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, _named(_shifted(body, key, "iban", back), put)).otherwise(m)


def _ssn(m: Column, key: Column, back: bool) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    s = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", back)

    def put(v: Column) -> Column:
        at = F.floor(v["x"] / 99)
        a = at + 1 + F.when(at >= 665, 1).otherwise(0)
        parts = ((a, 3), (v["x"] % 99 + 1, 2), (v["y"] + 1, 4))
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in parts))

    return F.when(valid, _named(s, put)).otherwise(m)


def _phone(m: Column, key: Column, back: bool) -> Column:
    digits = _digits(m)
    one, two = ([c for c in CODES.split() if len(c) == k] for k in (1, 2))
    code = F.when(~m.startswith("+"), 0).when(F.substr(digits, F.lit(1), F.lit(1)).isin(one), 1).when(F.substr(digits, F.lit(1), F.lit(2)).isin(two), 2).otherwise(3)
    inner = F.substr(digits, code + 1, F.length(digits))
    # The rest is permuted under its country code; ten digits alone are numbers of +1.
    country = F.concat(F.lit("phone"), F.when(code == 0, "1").otherwise(F.substr(digits, F.lit(1), code)))
    valid = F.length(digits).between(8, 15)
    return F.when(valid, _filled(m, F.concat(F.substr(digits, F.lit(1), code), _of_digits(inner, key, country, back)))).otherwise(m)


def _ipv6(m: Column, key: Column, back: bool) -> Column:
    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    left, right = groups(F.split_part(m, F.lit("::"), F.lit(1))), groups(F.split_part(m, F.lit("::"), F.lit(2)))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.when(F.instr(m, "::") > 0, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(groups(m))
    number = F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long"))

    def half(n: Column, at: int, tweak: Column) -> Column:
        return feistel(F.get(n, F.lit(at)) * 65536 + F.get(n, F.lit(at + 1)), F.get(n, F.lit(at + 2)) * 65536 + F.get(n, F.lit(at + 3)), F.lit(1 << 32), F.lit(1 << 32), key, tweak, back)

    def shown(v: Column) -> Column:
        return F.concat_ws(":", *(F.lower(F.hex(F.floor(p / d) % 65536)) for p in (v["x"], v["y"]) for d in (65536, 1)))

    def put(n: Column) -> Column:
        return _named(shown(half(n, 0, F.lit("net"))), lambda net: F.concat_ws(":", net, shown(half(n, 4, F.concat(F.lit("host"), network(n) if back else net)))))

    def network(n: Column) -> Column:
        return F.concat_ws(":", *(F.lower(F.hex(F.get(n, F.lit(k)))) for k in range(4)))

    return F.when((F.size(whole) == 8) & ((missing > 0) | (F.instr(m, "::") == 0)), _named(number, put)).otherwise(m)


def _ip(m: Column, key: Column, back: bool) -> Column:
    part = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    valid = ~F.exists(part, lambda p: p > 255)
    s = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip", back)
    return F.when(valid, _named(s, lambda v: F.concat_ws(".", *(F.floor(p).cast("string") for p in (v["x"] / 256, v["x"] % 256, v["y"] / 256, v["y"] % 256))))).otherwise(m)


def _date(m: Column, key: Column, back: bool) -> Column:
    iso = m.rlike("^....-")
    part = F.split(m, "[-/.]")
    y, mo, d = F.when(iso, part[0]).otherwise(part[2]), part[1], F.when(iso, part[2]).otherwise(part[0])
    first = F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    # A day after the month's number in d/m/y can only be m/d/y.
    swapped = ~iso & first.isNull()
    day = F.coalesce(first, F.when(~iso, F.try_to_date(F.concat_ws("-", y, F.lpad(d, 2, "0"), F.lpad(mo, 2, "0")), "yyyy-MM-dd")))
    late = F.year(day) >= 2000
    start = F.when(late, F.lit("2000-01-01")).otherwise(F.lit("1900-01-01")).cast("date")
    # 1900-1999 has 92 * 397 days, 2000-2099 has 75 * 487.
    a, b = F.when(late, 75).otherwise(92).cast("long"), F.when(late, 487).otherwise(397).cast("long")
    n = F.datediff(day, start).cast("long")
    s = feistel(F.floor(n / b), n % b, a, b, key, "date", back)
    sep = F.when(m.contains("/"), "/").otherwise(".")

    def put(v: Column) -> Column:
        new = F.date_add(start, (v["x"] * b + v["y"]).cast("int"))
        dd, mm, yy = F.date_format(new, "dd"), F.date_format(new, "MM"), F.date_format(new, "yyyy")
        return F.when(iso, F.concat_ws("-", yy, mm, dd)).otherwise(F.concat(dd, sep, mm, sep, yy))

    # Month first: only days 13-31 are told from day first, so the year is permuted in its century and month and day stay; 29 February keeps to leap years.
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    of_century = F.year(day) % 100
    k = F.when(leap, F.floor(of_century / 4) - F.when(late, 0).otherwise(1)).otherwise(of_century)
    ka = F.when(leap, F.when(late, 5).otherwise(4)).otherwise(10).cast("long")
    kb = F.when(leap, F.when(late, 5).otherwise(6)).otherwise(10).cast("long")
    year = feistel(F.floor(k / kb), k % kb, ka, kb, key, "year", back)

    def put_year(v: Column) -> Column:
        new = v["x"] * kb + v["y"]
        full = F.when(late, 2000).otherwise(1900) + F.when(leap, (new + F.when(late, 0).otherwise(1)) * 4).otherwise(new)
        return F.concat(F.substr(m, F.lit(1), F.length(m) - 4), full.cast("string"))

    return F.when(day.isNull() | ~F.year(day).between(1900, 2099), m).when(swapped, _named(year, put_year)).otherwise(_named(s, put))


_PUT = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ipv6": _ipv6, "ip": _ip, "date": _date}


def kind_of(m: Column) -> Column:
    """The first form that all of m has."""
    chain = F
    for k in KINDS:
        chain = chain.when(m.rlike(f"^(?:{FORMS[k]})$"), k)
    return chain


def pseudonym(m: Column, key: Column, back: bool = False) -> Column:
    chain = F
    for k in KINDS:
        chain = chain.when(m.rlike(f"^(?:{FORMS[k]})$"), _PUT[k](m, key, back))
    return chain.otherwise(m)


def _free(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_pseudonyms(df: DataFrame, key: str | Column, text_col: str = "text", back: bool = False, found_col: str | None = None) -> DataFrame:
    """df with personal data in the text replaced. With found_col, also an array of struct(kind, before, after) for each replaced value in order."""
    text, secret = F.col(f"`{text_col}`"), F.lit(key) if isinstance(key, str) else key
    matches, changed = _free(df, "matches"), _free(df, "changed")
    df = df.withColumn(matches, F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    df = df.withColumn(changed, F.when(F.size(matches) > 0, F.transform(matches, lambda m: pseudonym(m, secret, back))))
    between = F.split(text, PATTERN, -1)
    parts = F.zip_with(between, F.concat(F.col(changed), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    if found_col:
        pairs = F.zip_with(matches, changed, lambda a, b: F.struct(kind_of(a).alias("kind"), a.alias("before"), b.alias("after")))
        df = df.withColumn(found_col, F.coalesce(F.filter(pairs, lambda p: p["before"] != p["after"]), F.array().cast("array<struct<kind:string,before:string,after:string>>")))
    return df.withColumn(text_col, F.when(F.col(changed).isNotNull(), F.array_join(parts, "")).otherwise(text)).drop(matches, changed)


def revealed(df: DataFrame, key: str | Column, text_col: str = "text") -> DataFrame:
    """The texts before with_pseudonyms of the same key."""
    return with_pseudonyms(df, key, text_col, back=True)
