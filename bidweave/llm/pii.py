"""Personal data: validated numbers and dates become keyed pseudonyms of the same format.

Column functions only. A pattern finds candidates, a checksum or range validates them, and a Feistel network whose round
function is a keyed SHA-2 digest permutes each value within its format. Equal values have equal pseudonyms in all documents,
however they are punctuated, and nothing needs to be looked up or shuffled for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"
#: The start of a phone number with a + up to its last digit, of 8 to 15.
COUNTED = r"(?<=\+" + r"[ .()-]{0,3}\d" * 8 + r"(?:[ .()-]{0,3}\d)?" * 7
#: What begins at a group of digits and is no part of a phone number before it. Cards are the last of a row of groups of four.
BEHIND = "|".join([
    EMAIL, IPV4, r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    r"(?<![\w./-])(?:(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d|-)|(?:0?[1-9]|[12]\d|3[01])\.(?:0?[1-9]|1[0-2])\.(?:19|20)\d{2}(?!\w)|\d{1,2}/\d{1,2}/(?:19|20)\d{2}(?![\w/]))",
    r"(?<![\w-])(?:\d{4}(?: \d{4}){3}(?:(?: \d{4}){4}){0,3}(?!\w| \d{4}(?![\w.-]))|\d{4}(?:-\d{4}){3}(?![\w-])|\d{4}[ -]\d{6}[ -]\d{5}(?!\w))",
])
NANP = r"\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
#: The formats, in the order in which they are tried at a place.
PATTERNS = {
    "email": EMAIL,
    "ipv4": IPV4,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?!\d|-)|\d{1,2}\.\d{1,2}\.\d{4}(?!\w)|\d{1,2}/\d{1,2}/\d{4}(?![\w/]))",
    "phone": r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    rf"|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?(?!{BEHIND})\d{{1,5}}(?:[ .-]?(?!{BEHIND}|{COUNTED} ){NANP})\d{{2,5}}){{1,4}}{COUNTED})"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
}
ANY = "|".join(PATTERNS.values())
KINDS = list(PATTERNS)
#: Dates from 1900-01-01 on, as many as 17 x 4297: up to 2099-12-31.
DATES = (17, 4297)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k) for k in range(11)]), n + 1)


def feistel(x: Column, y: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the pairs (x, y) with 0 <= x < a and 0 <= y < b, as struct<x, y>."""

    def round_(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.when(even, s["y"]).otherwise(s["x"]).cast("string")), 256)
        f = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return _let(f, lambda v: F.struct(F.when(even, F.pmod(s["x"] + v, a)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(F.pmod(s["y"] + v, b)).alias("y")))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def _shifted(part: Column, digest: Column) -> Column:
    """part with each digit and small letter moved on within its class, by four hexadecimal digits of the digest."""

    def char(p: Column) -> Column:
        c, by = F.substr(part, p, F.lit(1)), F.conv(F.substr(digest, 4 * p - 3, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        return F.when(c.rlike("[0-9]"), F.char(48 + (code - 48 + by) % 10)).when(c.rlike("[a-z]"), F.char(97 + (code - 97 + by) % 26)).otherwise(c)

    return F.when(F.length(part) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), char), ""))


def feistel_text(s: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of the strings of up to 64 digits and small letters that keeps the class of each character."""

    def round_(st: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.when(even, st["r"]).otherwise(st["l"])), 512)
        return _let(digest, lambda d: F.struct(F.when(even, _shifted(st["l"], d)).otherwise(st["l"]).alias("l"), F.when(even, st["r"]).otherwise(_shifted(st["r"], d)).alias("r")))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda st: F.concat(st["l"], st["r"]))


def _refilled(template: Column, chars: Column, kept: str) -> Column:
    """The characters of class `kept` in template replaced by those of chars, in turn, with the template's case."""

    def char(i: Column) -> Column:
        c = F.substr(template, i, F.lit(1))
        new = F.substr(chars, F.length(F.regexp_replace(F.substr(template, F.lit(1), i), f"[^{kept}]", "")), F.lit(1))
        return F.when(c.rlike(f"[{kept}]"), F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), char), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn's sum; doubled: 0 if the last digit counts double, 1 if the one before it does."""
    n = F.length(digits)

    def add(t: Column, i: Column) -> Column:
        v = F.substr(digits, n - i, F.lit(1)).cast("int")
        return t + F.when(i % 2 == doubled, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _halves(digits: Column, tweak: Column, key: str) -> Column:
    """A permutation of the strings of 2 to 20 digits of one length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    done = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1, v), _power(u), _power(v), tweak, key)
    return _let(done, lambda s: F.concat(F.lpad(s["x"].cast("string"), u, "0"), F.lpad(s["y"].cast("string"), v, "0")))


def _card(m: Column, key: str) -> Column:
    """Keeps the length and the first digit; the last is the check digit of the rest."""

    def made(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _halves(F.substr(d, F.lit(2), F.length(d) - 2), F.concat(F.lit("card"), F.length(d).cast("string"), F.substr(d, F.lit(1), F.lit(1))), key))
        return _let(body, lambda b: _refilled(m, F.concat(b, ((10 - _luhn(b, 0) % 10) % 10).cast("string")), "0-9"))

    return _let(_digits(m), lambda d: F.when(_luhn(d, 1) % 10 == 0, made(d)))


def _phone(m: Column, key: str) -> Column:
    """Keeps the country code (one digit after +1 and +7, else two; 1 without +)."""

    def made(d: Column) -> Column:
        cc = F.when(~F.startswith(m, F.lit("+")), F.lit("")).when(d.rlike("^[17]"), F.substr(d, F.lit(1), F.lit(1))).otherwise(F.substr(d, F.lit(1), F.lit(2)))
        return _let(cc, lambda c: _refilled(m, F.concat(c, _halves(F.substr(d, F.length(c) + 1, F.length(d)), F.concat(F.lit("phone"), F.when(c == "", F.lit("1")).otherwise(c)), key)), "0-9"))

    return _let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), made(d)))


def _email(m: Column, key: str) -> Column:
    """Permutes the letters and digits of the local part, blind to case; keeps the domain."""
    local = F.substring_index(m, "@", 1)
    return F.concat(_refilled(local, feistel_text(F.regexp_replace(F.lower(local), "[^a-z0-9]", ""), "email", key), "A-Za-z0-9"), F.lit("@"), F.substring_index(m, "@", -1))


def _ipv4(m: Column, key: str) -> Column:
    def octet(i: int) -> Column:
        return F.element_at(F.split(m, r"\."), i).cast("long")

    done = feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), F.lit("ipv4"), key)
    return _let(done, lambda s: F.concat_ws(".", *[v.cast("long").cast("string") for v in (F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256)]))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def told(s: Column) -> Column:
        a = F.floor(s["x"] / 99)
        return F.concat_ws("-", F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["y"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(done, told))


def _mod97(s: Column) -> Column:
    """Of an IBAN's characters, A as 10 to Z as 35."""

    def add(t: Column, i: Column) -> Column:
        c = F.substr(s, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (t * 10 + F.ascii(c) - 48) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """Keeps the country and the classes of the account's characters; the check digits are made anew."""

    def made(s: Column) -> Column:
        country = F.substr(s, F.lit(1), F.lit(2))
        account = F.upper(feistel_text(F.lower(F.substr(s, F.lit(5), F.length(s))), "iban", key))
        return _let(account, lambda a: _refilled(m, F.lower(F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)), "A-Z0-9"))

    return _let(F.regexp_replace(m, " ", ""), lambda s: F.when(_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1, made(s)))


def _date(m: Column, key: str) -> Column:
    """ISO dates, day.month.year and month/day/year (day/month/year where only that is a date), from 1900 to 2099."""

    def parts(sep: str) -> list[Column]:
        return [F.element_at(F.split(m, sep), i) for i in (1, 2, 3)]

    def day(y: Column, mo: Column, d: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    iso, dots, slashes = parts("-"), parts(r"\."), parts("/")
    american = day(slashes[2], slashes[0], slashes[1])
    value = F.when(m.contains("-"), day(*iso)).when(m.contains("."), day(dots[2], dots[1], dots[0])).otherwise(F.coalesce(american, day(slashes[2], slashes[1], slashes[0])))

    def told(new: Column) -> Column:
        def like(text: Column, number: Column) -> Column:
            return F.when(F.startswith(text, F.lit("0")) | (F.length(text) == 2), F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))

        y, mo, d = F.year(new).cast("string"), F.month(new), F.dayofmonth(new)
        return (
            F.when(m.contains("-"), F.date_format(new, "yyyy-MM-dd"))
            .when(m.contains("."), F.concat_ws(".", like(dots[0], d), like(dots[1], mo), y))
            .when(american.isNotNull(), F.concat_ws("/", like(slashes[0], mo), like(slashes[1], d), y))
            .otherwise(F.concat_ws("/", like(slashes[0], d), like(slashes[1], mo), y))
        )

    def made(v: Column) -> Column:
        n = F.datediff(v, F.lit("1900-01-01").cast("date"))
        done = feistel(F.floor(n / DATES[1]), n % DATES[1], F.lit(DATES[0]), F.lit(DATES[1]), F.lit("date"), key)
        new = _let(done, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["x"] * DATES[1] + s["y"]).cast("int")))
        return F.when(n.between(0, DATES[0] * DATES[1] - 1), _let(new, told))

    return _let(value, made)


MAKERS = {"email": _email, "ipv4": _ipv4, "iban": _iban, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def _replaced(m: Column, key: str) -> Column:
    """struct<kind, value> for a candidate; kind is null and the value as found if it isn't valid."""
    # An e-mail address or a phone number alone can start with a +. What stood behind the number doesn't count here.
    kind = F.when(m.contains("@"), F.lit("email")).when(F.startswith(m, F.lit("+")), F.lit("phone"))
    for k in KINDS[1:]:
        kind = kind.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k))

    def made(k: Column) -> Column:
        value = F.when(k == KINDS[0], MAKERS[KINDS[0]](m, key))
        for name in KINDS[1:]:
            value = value.when(k == name, MAKERS[name](m, key))
        return _let(value, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, m).alias("value")))

    return _let(kind, made)


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, and the column `pii`: array<struct<kind, value>> of the pseudonyms put in, in order.

    Found are e-mail addresses (letters and digits of the local part permuted), IPv4 addresses, IBANs (checked modulo
    97), US social security numbers, dates from 1900 to 2099, phone numbers of 8 to 15 digits and card numbers (checked
    by Luhn's sum). Candidates that fail their check stay as they are, and so do texts without any. Null stays null and
    empty empty. Rows are neither moved, dropped nor merged, so repeated ones are treated alike; columns of other names
    stay, a column named `pii` is replaced.
    """
    text = F.col(text_col)
    nothing = F.array().cast("array<struct<kind:string,value:string>>")
    found = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replaced(m, key))).otherwise(nothing)
    between = F.split(text, ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col("pii"), lambda a, b: F.array(a, F.coalesce(b["value"], F.lit(""))))), "")
    names = [c for c in docs.columns if c != "pii"]
    return (
        docs.withColumn("pii", found)
        .withColumn(text_col, F.when(F.size("pii") > 0, woven).otherwise(text))
        .withColumn("pii", F.filter("pii", lambda p: p["kind"].isNotNull()))
        .select(*names, "pii")
    )


#: The key of the queries. A deployment passes its own secret.
QUERY_KEY = "bidweave-query-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rewritten text and the number of pseudonyms by kind."""
    done = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key=QUERY_KEY)
    counts = [F.expr(f"bigint(size(filter(pii, p -> p.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), *counts)
