"""Format-preserving pseudonyms for personal data (operator 4), in SQL functions only.

One regular expression finds e-mail addresses, dates, phone numbers, social
security numbers, card numbers, IBANs, IP addresses and hexadecimal secrets; each find
is validated (Luhn check, IBAN check, calendar, number ranges) and, if valid, replaced by its
image under a keyed permutation of its own format:

* a Feistel network of ``ROUNDS`` rounds on a product of two ranges (x, y): x += F(y)
  modulo its range, then y += F(x) modulo its own, F being SHA-256 of key, format,
  round and value.  Each round can be undone, so different values of a format get
  different pseudonyms, and equal values equal ones in all documents.
* cards permute all digits but the last, which is the Luhn digit again; dates
  permute the days of their 400-year Gregorian cycle (189 * 773 days), so they stay
  valid (a slash date is read month first, and day first where that is no date); social security
  numbers permute valid area and group-serial numbers; IPv4 addresses permute the octets of as
  many digits each, IPv6 addresses their hexadecimal digits; IBANs permute the digits behind the
  check digits, which are worked out again, and keep country and letters; North American phone
  numbers permute area and exchange within 200 to 999 and the last four digits (ten digits, where area or exchange is none of those),
  others (with a plus sign, 8 to 15 digits) all behind the country's calling code, however they are separated; e-mail names permute their letters and their digits
  (the domain stays), secrets their hexadecimal digits, in pieces of up to 24. A piece of one
  character is permuted by the keyed order of its alphabet.
  Punctuation and case of letters stay in place.

Not covered, as nothing validates them: phone numbers of digits alone or without an area code,
names and postal addresses, hexadecimal secrets of over 64 digits, IPv6 addresses that begin with ``::``, hardware addresses.

The key is a parameter. Queries and the pipeline take it from ``spark.quartzmill.pii.secret`` (a name that Spark redacts where it shows settings); where that is
not set, a random key is made once for the application, so nobody can invert its pseudonyms, and they
link documents within it but not with those of another.  The key is a scalar subquery over a table of one row, so it is
no literal of the plan and stands in no explanation, user interface or event log of the query.

No row is moved: the plan is a scan and a projection.

Defined cases: a null text stays null and an empty one empty, with no finds; what
fails its validation stays; a text without finds is returned as it is; ties and
repeated rows need no care, as each row is treated alone;
a text of any length is one row's work in the JVM; all other columns pass
unchanged (their names must differ from ``n_values`` and ``values`` where those are asked for).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
PIECE = 24
KEY_SETTING = "spark.quartzmill.pii.secret"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
US_DATE = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
DOT_DATE = r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\.?\d)"
PHONE = r"(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\dA-Za-z])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\dA-Za-z])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
WORLD_PHONE = r"(?<![\w+.])\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}(?![\w-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.\d)"
ANY = "|".join((EMAIL, IPV6, ISO_DATE, US_DATE, DOT_DATE, PHONE, WORLD_PHONE, IBAN, SSN, CARD, IPV4, SECRET))

_LETTERS, _DIGITS26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: Days of a 400-year cycle are 189 * 773; it begins on this day.
_EPOCH, _CYCLE = "1600-01-01", (189, 773)


def _round(key: Column, tweak: Column, i: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: Column, tweak: Column, x: Column, y: Column, range_x: Column, range_y: Column) -> Column:
    """struct(x, y): the keyed permutation of range_x * range_y, each below 2**62."""
    both = lambda a, b: F.struct(a.alias("x"), b.alias("y"))

    def step(s: Column, i: Column) -> Column:
        left = both(F.pmod(s["x"] + F.pmod(_round(key, tweak, i, s["y"]), range_x), range_x), s["y"])
        right = both(s["x"], F.pmod(s["y"] + F.pmod(_round(key, tweak, i, s["x"]), range_y), range_y))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), both(x.cast("long"), y.cast("long")), step)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(key: Column, kind: str, s: Column, base: int) -> Column:
    """A string of digits of a base, permuted within its length in pieces of ``PIECE``."""

    def piece(at: Column) -> Column:
        part = F.substring(s, at * PIECE + 1, F.lit(PIECE))

        def permuted(p: Column) -> Column:
            left = F.floor(F.length(p) / 2).cast("int")
            right = F.length(p) - left
            number = lambda t: F.coalesce(F.conv(t, base, 10).cast("long"), F.lit(0).cast("long"))
            size = lambda n: F.pow(F.lit(float(base)), n).cast("long")
            tweak = F.concat_ws(":", F.lit(kind), F.length(s).cast("string"), at.cast("string"))
            out = feistel(key, tweak, number(F.substring(p, F.lit(1), left)), number(F.substring(p, left + 1, right)), size(left), size(right))
            text = lambda v, n: F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), n, F.lit("0"))
            # one character: its place in the keyed order of all of them
            order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(base - 1)), lambda v: F.struct(_round(key, tweak, F.lit(0), v).alias("h"), v.alias("v"))))
            single = text(F.element_at(order, number(p).cast("int") + 1)["v"], F.lit(1))
            return F.when(F.length(p) == 1, single).otherwise(_with(out, lambda o: F.concat(text(o["x"], left), text(o["y"], right))))

        return _with(part, permuted)

    pieces = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / PIECE).cast("int"))
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(pieces, piece), ""))


def _fill(shape: Column, letters: Column, numbers: Column) -> Column:
    """The shape with its letters and digits replaced in turn, case kept."""

    def step(s: Column, c: Column) -> Column:
        low = F.lower(c)
        digit, letter = c.between("0", "9"), low.between("a", "z")
        new = F.substring(letters, s["l"], F.lit(1))
        put = F.when(digit, F.substring(numbers, s["d"], F.lit(1))).when(letter, F.when(c == low, new).otherwise(F.upper(new))).otherwise(c)
        return F.struct(F.concat(s["out"], put).alias("out"), (s["l"] + letter.cast("int")).alias("l"), (s["d"] + digit.cast("int")).alias("d"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("l"), F.lit(1).alias("d"))
    chars = F.split(shape, "(?!^)")
    return F.aggregate(chars, start, step, lambda s: s["out"])


def _refilled(shape: Column, new: Column) -> Column:
    """The shape with its letters and digits replaced in turn by those of ``new``."""

    def step(s: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(s["out"], F.when(own, F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, "(?!^)"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(payload: Column) -> Column:
    """The check digit that follows a string of digits."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(-total, F.lit(10)).cast("string")


def _card(key: Column, m: Column) -> Column:
    def number(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        new = digits(key, "card", payload, 10)
        return F.when(_luhn(payload) == F.substring(d, -1, 1), _fill(m, F.lit(""), _with(new, lambda p: F.concat(p, _luhn(p)))))

    return _with(_only_digits(m), number)


def _date(key: Column, m: Column, form: str) -> Column:
    first = F.lit(_EPOCH).cast("date")
    cycle = _CYCLE[0] * _CYCLE[1]

    def day(d: Column) -> Column:
        since = F.datediff(d, first)
        era = F.floor(since / cycle).cast("int")
        within = F.pmod(since, F.lit(cycle))
        out = feistel(key, F.concat(F.lit("date:"), era.cast("string")), F.floor(within / _CYCLE[1]), F.pmod(within, F.lit(_CYCLE[1])), F.lit(_CYCLE[0]), F.lit(_CYCLE[1]))
        return _with(out, lambda o: F.date_format(F.date_add(first, (era * cycle + o["x"] * _CYCLE[1] + o["y"]).cast("int")), form))

    parsed = F.try_to_timestamp(m, F.lit(form)).cast("date")
    # only years whose whole cycle can be written with four digits
    return _with(parsed, lambda d: F.when(F.year(d).between(1600, 9599), day(d)))


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    x = area - 1 - (area > 666).cast("int")
    out = feistel(key, F.lit("ssn"), x, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    text = _with(out, lambda o: F.format_string("%03d-%02d-%04d", o["x"] + 1 + (o["x"] >= 665).cast("int"), F.floor(o["y"] / 9999) + 1, F.pmod(o["y"], F.lit(9999)) + 1))
    return F.when(valid, text)


def _ipv4(key: Column, m: Column) -> Column:
    """Octets keep their number of digits: 0-9, 10-99 and 100-255 are ranges of their own."""

    def least(o: Column) -> Column:
        return F.when(F.length(o) == 1, 0).when(F.length(o) == 2, 10).otherwise(100)

    def many(o: Column) -> Column:
        return F.when(F.length(o) == 1, 10).when(F.length(o) == 2, 90).otherwise(156)

    def address(o: Column) -> Column:
        at = lambda i: F.element_at(o, i)
        place = lambda i: at(i).cast("int") - least(at(i))
        x, y = place(1) * many(at(2)) + place(2), place(3) * many(at(4)) + place(4)
        tweak = F.concat(F.lit("ipv4:"), *[F.length(at(i)).cast("string") for i in range(1, 5)])
        out = feistel(key, tweak, x, y, many(at(1)) * many(at(2)), many(at(3)) * many(at(4)))
        high = lambda v, i: F.floor(v / many(at(i + 1))) + least(at(i))
        low = lambda v, i: F.pmod(v, many(at(i))) + least(at(i))
        text = _with(out, lambda v: F.format_string("%d.%d.%d.%d", high(v["x"], 1), low(v["x"], 2), high(v["y"], 3), low(v["y"], 4)))
        return F.when(F.forall(o, lambda x: x.cast("int").between(least(x), 255)), text)

    return _with(F.split(m, r"\."), address)


def _phone(key: Column, m: Column) -> Column:
    """Area and exchange of 200 to 999 stay in that range; others, which no network gives, are permuted as digits."""
    every = _only_digits(m)
    national = F.substring(every, -10, 10)
    country = F.substring(every, F.lit(1), F.length(every) - 10)
    area, exchange, line = (F.substring(national, at, n).cast("int") for at, n in ((1, 3), (4, 3), (7, 4)))
    out = feistel(key, F.lit("nanp"), (area - 200) * 800 + exchange - 200, line, F.lit(640_000), F.lit(10_000))
    valid = _with(out, lambda o: F.format_string("%03d%03d%04d", F.floor(o["x"] / 800) + 200, F.pmod(o["x"], F.lit(800)) + 200, o["y"]))
    new = F.when((area >= 200) & (exchange >= 200), valid).otherwise(digits(key, "phone", national, 10))
    return _fill(m, F.lit(""), F.concat(country, new))


#: Country calling codes of two digits; those that begin with 1 or 7 have one, all others three.
CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _world_phone(key: Column, m: Column) -> Column:
    every = _only_digits(m)
    head = F.when(F.substring(every, 1, 1).isin("1", "7"), 1).when(F.substring(every, 1, 2).isin(*CALLING), 2).otherwise(3)
    new = F.concat(F.substring(every, F.lit(1), head), digits(key, "phone", F.substring(every, head + 1, F.length(every)), 10))
    return F.when(F.length(every).between(8, 15), _fill(m, F.lit(""), new))


def _iban_check(account: Column, country: Column) -> Column:
    """The two check digits behind the country of an IBAN: 98 less the number modulo 97, letters counting from 10."""

    def add(rest: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.pmod(rest * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    rest = F.aggregate(F.filter(F.split(F.concat(account, country, F.lit("00")), "(?!^)"), lambda c: c != ""), F.lit(0), add)
    return F.lpad((98 - rest).cast("string"), 2, F.lit("0"))


def _iban(key: Column, m: Column) -> Column:
    def number(flat: Column) -> Column:
        country, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))

        def made(numbers: Column) -> Column:
            return _with(_fill(account, F.regexp_replace(F.lower(account), "[^a-z]", ""), numbers), lambda new: _refilled(m, F.concat(country, _iban_check(new, country), new)))

        tweak_kind = "iban"
        valid = (_iban_check(account, country) == F.substring(flat, 3, 2)) & F.length(flat).between(15, 34)
        return F.when(valid, _with(digits(key, tweak_kind, _only_digits(account), 10), made))

    return _with(F.regexp_replace(m, " ", ""), number)


def _ipv6(key: Column, m: Column) -> Column:
    flat = F.lower(F.regexp_replace(m, ":", ""))
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    valid = m.rlike("[0-9]") & ((groups == 8) | (m.contains("::") & (groups < 8)))
    new = _refilled(m, digits(key, "ipv6", flat, 16))
    return F.when(valid, F.when(m == F.lower(m), new).otherwise(F.upper(new)))


def _email(key: Column, m: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    new = F.translate(digits(key, "email", F.translate(letters, _LETTERS, _DIGITS26), 26), _DIGITS26, _LETTERS)
    return F.concat(_fill(name, new, digits(key, "email", _only_digits(name), 10)), F.substring(m, F.length(name) + 1, F.length(m)))


def _secret(key: Column, m: Column) -> Column:
    new = digits(key, "secret", F.lower(m), 16)
    return F.when(m == F.lower(m), new).otherwise(F.upper(new))


def pseudonym(key: Column, m: Column) -> Column:
    """struct(kind, value) of a find; value null if it is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    kinds = [
        ("email", m.contains("@"), _email(key, m)),
        ("date", whole(r"\d{4}-\d{2}-\d{2}"), _date(key, m, "yyyy-MM-dd")),
        ("ipv6", m.rlike("^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$"), _ipv6(key, m)),
        ("date", whole(r"\d{2}/\d{2}/\d{4}"), F.coalesce(_date(key, m, "MM/dd/yyyy"), _date(key, m, "dd/MM/yyyy"))),
        ("date", whole(r"\d{2}\.\d{2}\.\d{4}"), _date(key, m, "dd.MM.yyyy")),
        ("phone", whole(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), _phone(key, m)),
        ("phone", m.startswith("+"), _world_phone(key, m)),
        ("iban", whole(r"[A-Z]{2}\d{2}[A-Z0-9 ]+"), _iban(key, m)),
        ("ssn", whole(r"\d{3}-\d{2}-\d{4}"), _ssn(key, m)),
        ("card", whole(r"(?:\d{13,19}|\d{4}[ -].*)"), _card(key, m)),
        ("ipv4", m.contains("."), _ipv4(key, m)),
    ]
    out = None
    for kind, test, value in kinds:
        made = F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(F.struct(F.lit("secret").alias("kind"), _secret(key, m).alias("value")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with the text column replaced; with ``report`` also ``n_values`` and ``values``."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text, secret = F.col(text_col), F.col("__key")
    finds = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("was"), pseudonym(secret, m).alias("new")))
    none = F.array().cast("array<struct<was: string, new: struct<kind: string, value: string>>>")
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    found = docs.withColumn("__key", held).withColumn("__finds", F.when(F.coalesce(text.rlike("[0-9@]"), F.lit(False)), finds).otherwise(none))
    news = F.transform("__finds", lambda f: F.coalesce(f["new"]["value"], f["was"]))
    rest = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(rest, F.concat(news, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = found.withColumn("__text", F.when(F.size("__finds") > 0, joined).otherwise(text))
    valid = F.filter("__finds", lambda f: f["new"]["value"].isNotNull())
    columns = [F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if report:
        columns += [F.size(valid).alias("n_values"), F.transform(valid, lambda f: f["new"]).alias("values")]
    return out.select(*columns)


def secret_key(spark: SparkSession) -> str:
    """The key of the setting; where there is none, a random one that the application keeps."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, secret_key(spark), report=True)
