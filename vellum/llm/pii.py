"""Operator 2: format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates; numbers and dates must also be valid: Luhn for cards, mod 97 for IBANs, octets for
addresses, area, group and serial for social security numbers, the calendar for dates, 7 to 15 digits for phones.
What is valid is permuted by a keyed Feistel network on the values of its own format (check digits are computed
anew), so the result is valid too, equal values get equal pseudonyms in all documents, and the key undoes it. Dates
are permuted within their 400 years, which are 189 x 773 days; dates with slashes among those that read as the same order
and widths. E-mail names and assigned secrets, which have no
number format, get keyed hashes of their own form. What isn't valid stays; so do years before 400, the letters, country and
last digit (if alone beyond 15 or 30 digits) of IBANs, and the country codes of phones.

Null text gives null text and no count; empty text stays empty. Each row is handled on its own: repeated rows, null
ids and extra columns don't matter, and only the id and own columns come out (an id column named like one of them as `id`).
An empty table gives no rows; very long texts are handled whole. Nothing is shuffled. The key is in no plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, quoted

ROUNDS = 10
# The formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
SECRET = r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key) {0,3}[:=] {0,3}[\"']?[A-Za-z0-9_-]{16,128}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-])"
ADDRESS = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"
SOCIAL = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
CARD = r"(?<![\w+])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w)"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)"
ANY = "|".join((EMAIL, SECRET, IBAN, DATE, ADDRESS, SOCIAL, CARD, PHONE))
#: Days of 400 years, as a product; days before 1970 from 1600.
DAYS_A, DAYS_B, DAYS_BEFORE = 189, 773, 135_140
#: Steps after which a date that meets no day of its format is given up: the least likely format has a chance of 0.78 a step.
WALK = 300
KINDS = ("email", "secret", "iban", "date", "address", "social", "card", "phone")


def _ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _prf(key: Column, *parts: Column) -> Column:
    """A keyed pseudorandom number below 2^60."""
    data = F.concat_ws(":", key, *[p.cast("string") for p in parts], key)
    return F.conv(F.substring(F.sha2(data, 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: Column, tweak: Column, inverse: bool) -> Column:
    """struct(x, y): a keyed permutation of the pairs with 0 <= x < a, 0 <= y < b; or its inverse."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    add = lambda v, f, m: F.pmod(v - f if inverse else v + f, m)

    def step(s: Column, k: Column) -> Column:
        odd = F.struct(add(s["x"], _prf(key, tweak, k, s["y"]), a).alias("x"), s["y"].alias("y"))
        even = F.struct(s["x"].alias("x"), add(s["y"], _prf(key, tweak, k, s["x"]), b).alias("y"))
        return F.when(k % 2 == 1, odd).otherwise(even)

    return F.aggregate(rounds, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pad(v: Column, n: Column) -> Column:
    text = v.cast("string")
    return F.concat(F.repeat(F.lit("0"), n - F.length(text)), text)


def permuted_digits(digits: Column, key: Column, tweak: str, inverse: bool) -> Column:
    """Digit strings of 2 to 18 digits, permuted among those of their length."""

    def body(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        x, y = F.substr(d, F.lit(1), h).cast("long"), F.substr(d, h + 1).cast("long")
        return _let(feistel(x, y, _ten(h), _ten(n - h), key, F.concat(F.lit(tweak), n.cast("string")), inverse), lambda s: F.concat(_pad(s["x"], h), _pad(s["y"], n - h)))

    return _let(digits, body)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(m: Column, digits: Column) -> Column:
    """The string with its digits replaced, from the left, by others."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    put = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used")))
    return F.aggregate(F.split(m, ""), start, put, lambda s: s["out"])


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum from the right; doubled: 0 to double the last digit, 1 to start with the one before it."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when((i + doubled) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return (F.length(digits) > 12) & (_luhn_sum(digits, 1) % 10 == 0)


def _mod97(text: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c == "", r).when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: Column, inverse: bool) -> Column:
    def body(d: Column) -> Column:
        own = lambda p: refilled(m, F.concat(p, ((10 - _luhn_sum(p, 0) % 10) % 10).cast("string")))
        return F.when(luhn_valid(d), _let(permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse), own))

    return _let(_digits(m), body)


def _iban(m: Column, key: Column, inverse: bool) -> Column:
    def body(t: Column) -> Column:
        rest = F.substr(t, F.lit(5))
        valid = (F.length(t) >= 15) & (F.length(t) <= 34) & (_mod97(F.concat(rest, F.substr(t, F.lit(1), F.lit(4)))) == 1)
        d = _digits(rest)
        parts = [F.substr(d, F.lit(1 + 15 * i), F.lit(15)) for i in range(3)]
        new = F.concat(*[F.when(F.length(p) > 1, permuted_digits(p, key, f"iban{i}", inverse)).otherwise(p) for i, p in enumerate(parts)])

        def checked(r: Column) -> Column:
            check = 98 - _mod97(F.concat(r, F.substr(t, F.lit(1), F.lit(2)), F.lit("00")))
            every = F.concat(F.substr(t, F.lit(1), F.lit(2)), _pad(check, F.lit(2)), r)
            return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")), lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used"))).otherwise(F.struct(F.concat(s["out"], F.substr(every, s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used"))), lambda s: s["out"])

        return F.when(valid, _let(refilled(rest, new), checked))

    return _let(F.regexp_replace(m, " ", ""), body)


def _moved(days: Column, key: Column, inverse: bool, fits=None) -> Column:
    """A day (from 1970) permuted within its 400 years; with `fits`, among those days that fit: what doesn't fit is moved on."""
    o = days + DAYS_BEFORE
    block, i = F.floor(o / (DAYS_A * DAYS_B)).cast("long"), F.pmod(o, F.lit(DAYS_A * DAYS_B))
    day_of = lambda s: (block * (DAYS_A * DAYS_B) + s["x"] * DAYS_B + s["y"] - DAYS_BEFORE).cast("int")
    step = lambda s: feistel(s["x"], s["y"], F.lit(DAYS_A).cast("long"), F.lit(DAYS_B).cast("long"), key, F.lit("date"), inverse)
    start = F.struct(F.floor(i / DAYS_B).cast("long").alias("x"), (i % DAYS_B).cast("long").alias("y"))
    if fits is None:
        return _let(step(start), day_of)
    put = lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), fits(day_of(t)).alias("done"))
    first = F.struct(start["x"].alias("x"), start["y"].alias("y"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, _: F.when(s["done"], s).otherwise(_let(step(s), put)), lambda s: F.when(s["done"], day_of(s)))


def _date(m: Column, key: Column, inverse: bool) -> Column:
    """A date in its own format. Slashed dates are permuted among the strings of their order (day or month first) and widths."""
    days = lambda fmt: F.unix_date(F.try_to_timestamp(m, F.lit(fmt)).cast("date"))
    whole = lambda fmt: _let(_moved(days(fmt), key, inverse), lambda d: F.date_format(F.date_from_unix_date(d), fmt))
    wide = lambda i: F.length(F.element_at(F.split(m, "/"), i)) == 2
    day, month = (lambda d: F.dayofmonth(F.date_from_unix_date(d))), (lambda d: F.month(F.date_from_unix_date(d)))
    field = lambda n, i: F.when(wide(i), F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))

    def slashed(fmt: str, first, second, more) -> Column:
        fits = lambda d: (wide(1) | (first(d) < 10)) & (wide(2) | (second(d) < 10)) & more(d)
        return _let(_moved(days(fmt), key, inverse, fits), lambda d: F.concat(field(first(d), 1), F.lit("/"), field(second(d), 2), F.lit("/"), F.lpad(F.year(F.date_from_unix_date(d)).cast("string"), 4, "0")))

    day_first = slashed("d/M/yyyy", day, month, lambda d: F.lit(True))
    month_first = slashed("M/d/yyyy", month, day, lambda d: day(d) > 12)  # else it reads as day first
    known = F.regexp_extract(m, "[0-9]{4}", 0) >= "0400"
    return F.when(known & m.contains("/"), F.when(days("d/M/yyyy").isNotNull(), day_first).when(days("M/d/yyyy").isNotNull(), month_first)).when(known & m.contains("-") & days("yyyy-MM-dd").isNotNull(), whole("yyyy-MM-dd")).when(known & m.contains(".") & days("dd.MM.yyyy").isNotNull(), whole("dd.MM.yyyy"))


def _address(m: Column, key: Column, inverse: bool) -> Column:
    def body(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("int")
        valid = F.forall(o, lambda x: (x.cast("int") < 256) & ((F.length(x) == 1) | ~x.startswith("0")))
        s = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("address"), inverse)
        return F.when(valid, _let(s, lambda s: F.concat_ws(".", *[F.floor(s[v] / d).cast("long") % 256 for v in ("x", "y") for d in (256, 1)])))

    return _let(F.split(m, r"\."), body)


def _social(m: Column, key: Column, inverse: bool) -> Column:
    area, group, serial = F.substr(m, F.lit(1), F.lit(3)).cast("int"), F.substr(m, F.lit(5), F.lit(2)).cast("int"), F.substr(m, F.lit(8)).cast("int")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)  # 0 to 897
    s = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("social"), inverse)

    def text(s: Column) -> Column:
        i = F.floor(s["x"] / 99)
        return F.concat_ws("-", _pad(i + F.when(i > 664, 2).otherwise(1), F.lit(3)), _pad(s["x"] % 99 + 1, F.lit(2)), _pad(s["y"] + 1, F.lit(4)))

    return F.when(valid, _let(s, text))


def _phone(m: Column, key: Column, inverse: bool) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(m, F.length(country) + 1)
    n = F.length(_digits(rest))
    return F.when((F.length(_digits(m)) >= 7) & (F.length(_digits(m)) <= 15), F.concat(country, refilled(rest, permuted_digits(F.when(n > 1, _digits(rest)), key, "phone", inverse))))


def _email(m: Column, key: Column) -> Column:
    h = lambda what, n, v: F.substring(F.sha2(F.concat_ws(":", key, F.lit(what), F.lower(v), key), 256), 1, n)
    name, place = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(F.lit("u"), h("name", 12, name), F.lit("@d"), h("place", 10, place), F.lit("."), F.substring_index(place, ".", -1))


def _secret(m: Column, key: Column) -> Column:
    value = F.regexp_extract(m, "[A-Za-z0-9_-]{16,128}$", 0)
    stream = F.concat(*[F.sha2(F.concat_ws(":", key, F.lit(f"secret{i}"), value), 256) for i in range(2)])
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), F.substr(stream, F.lit(1), F.length(value)))


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^(?i)(token|secret|pass|api|access)"), "secret")
        .when(m.rlike("^[A-Z]"), "iban")
        .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), "date")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "address")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .when(m.rlike("^([0-9]{13,19}|([0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), "card")
        .otherwise("phone")
    )


def pseudonym(m: Column, key: Column, inverse: bool = False) -> Column:
    """The pseudonym of one candidate; null if it isn't valid (or can't be undone, for hashes)."""
    kind = kind_of(m)
    none = F.lit(None).cast("string")
    return (
        F.when(kind == "email", none if inverse else _email(m, key))
        .when(kind == "secret", none if inverse else _secret(m, key))
        .when(kind == "iban", _iban(m, key, inverse))
        .when(kind == "date", _date(m, key, inverse))
        .when(kind == "address", _address(m, key, inverse))
        .when(kind == "social", _social(m, key, inverse))
        .when(kind == "card", _card(m, key, inverse))
        .when(kind == "phone", _phone(m, key, inverse))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """id, text (with pseudonyms), n_replaced, and a count for each kind."""
    # A literal key would stand in every plan, and so in the UI and in event logs; a subquery's result doesn't.
    held = docs.sparkSession.sql("SELECT key FROM VALUES (:key) AS t(key)", args={"key": key}).scalar()
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("t"), held.alias("key"))
    some = F.col("t").rlike("[0-9@=:]")
    found = base.select("id", "t", "key", F.when(some, F.regexp_extract_all("t", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>")).alias("found"))
    one = lambda m: F.struct(kind_of(m).alias("kind"), m.alias("old"), pseudonym(m, F.col("key"), inverse).alias("new"))
    named = found.select("id", "t", F.when(F.size("found") > 0, F.transform("found", one)).alias("named"))
    pieces = F.zip_with(F.split("t", ANY, -1), F.col("named"), lambda gap, x: F.concat(gap, F.coalesce(x["new"], x["old"], F.lit(""))))
    used = F.filter(F.coalesce(F.col("named"), F.array().cast("array<struct<kind:string,old:string,new:string>>")), lambda x: x["new"].isNotNull())
    whole = named.select("id", F.when(F.col("named").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("t")).alias("text"), used.alias("used"))
    count = lambda kind: F.size(F.filter("used", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return whole.select(F.col("id").alias(own_name(id_col, ("text", "n_replaced", *(f"n_{k}" for k in KINDS)))), "text", F.size("used").cast("long").alias("n_replaced"), *counts)
