"""Format-preserving pseudonyms for personal data, in SQL functions only.

One pattern finds candidates; each is validated (check digits, ranges, the calendar) and then replaced by a value of the same
format. A keyed Feistel network permutes the values of a format, so equal values have equal pseudonyms in all documents and
different values have different ones. Candidates that fail validation stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Candidate patterns by kind, in the order they are tried (fixed values). None begins or ends inside a word or number.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])"
             r"|(?<![A-Za-z0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"
             r"|(?<![A-Za-z0-9.-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "card": r"(?<![A-Za-z0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9]|[.-][0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Days from 1900 to 2099: 73,049 = 17 x 4,297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the pairs below ``left_size`` and ``right_size``, as a struct ``l, r``.

    Rounds add a digest of one half to the other, modulo that half's size; every round can be undone, so the whole is a
    permutation for any two sizes.
    """
    def add(acc: Column, k: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), k.cast("string"), other.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda acc, k: F.struct(
            F.when(k % 2 == 0, F.pmod(acc["l"] + F.pmod(add(acc, k, acc["r"]), left_size), left_size)).otherwise(acc["l"]).alias("l"),
            F.when(k % 2 == 1, F.pmod(acc["r"] + F.pmod(add(acc, k, acc["l"]), right_size), right_size)).otherwise(acc["r"]).alias("r")))


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of at most 36 digits permuted among the strings of its length (one digit: shifted by the key)."""
    def of(d: Column) -> Column:
        n = F.length(d)
        high = F.floor((n + 1) / 2).cast("int")
        pair = feistel(F.substr(d, F.lit(1), high).cast("long"), F.coalesce(F.nullif(F.substr(d, high + 1), F.lit("")), F.lit("0")).cast("long"),
                       power_of_ten(high), power_of_ten(n - high), key, kind)
        return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), high, "0"),
                                            F.when(n > high, F.lpad(p["r"].cast("string"), n - high, "0")).otherwise("")))

    return let(digits, of)


def with_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one by one, by those given."""
    place = F.sequence(F.lit(1), F.length(shape))
    return F.array_join(F.transform(place, lambda i: F.when(
        F.substr(shape, i, F.lit(1)).rlike("[0-9]"),
        F.substr(digits, F.length(digits_of(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1)))), "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of Luhn's digits, with every second one doubled from the last or from the one before it."""
    n = F.length(digits)

    def add(acc, i):
        digit = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = digit * 2
        return acc + F.when(i % 2 == (0 if double_last else 1), F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a string in which A is 10 and Z is 35."""
    def add(acc, i):
        c = F.substr(text, i, F.lit(1))
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(F.when(value > 9, acc * 100 + value).otherwise(acc * 10 + value), F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _email(m: Column, key: str) -> Column:
    """Keyed letters and digits for the part before the mark, as long as it; the domain is the format."""
    name = F.substring_index(m, "@", 1)
    digest = F.concat(*[F.sha2(F.concat_ws(":", F.lit(key), F.lit(f"email{k}"), F.lower(m)).cast("binary"), 256) for k in range(2)])
    letters = F.translate(digest, "0123456789", "ghijklmnop")
    return F.concat(F.substr(letters, F.lit(1), F.greatest(F.length(name), F.lit(8))), F.substr(m, F.length(name) + 1))


def _iban(m: Column, key: str) -> Column:
    """Digits of the account permuted, letters and country kept, check digits made anew; null when the check fails."""
    def of(c: Column) -> Column:
        account = F.substr(c, F.lit(5))
        old = digits_of(account)

        def shaped(account2: Column) -> Column:
            rest = F.lit(98) - mod97(F.concat(account2, F.substr(c, F.lit(1), F.lit(2)), F.lit("00")))
            return with_digits(m, F.concat(F.lpad(rest.cast("string"), 2, "0"), digits_of(account2)))

        valid = (mod97(F.concat(account, F.substr(c, F.lit(1), F.lit(4)))) == 1) & (F.length(c) <= 34) & (F.length(old) > 0)
        return F.when(valid, let(with_digits(account, permuted_digits(old, key, "iban")), shaped))

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
        return F.when(~F.exists(o, lambda x: x > 255), let(pair, lambda p: F.concat_ws(
            ".", *[x.cast("long").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])))

    return let(F.split(m, r"\.").cast("array<int>"), of)


def _date(m: Column, key: str) -> Column:
    """The day within 1900 to 2099 permuted; a slash puts the month first where that is a day, else the day first."""
    iso, slash = m.contains("-"), m.contains("/")

    def of(parts: Column) -> Column:
        def day(y, mo, d):
            return F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

        month_first = slash & day(parts[2], parts[0], parts[1]).isNotNull()
        value = F.when(iso, day(parts[0], parts[1], parts[2])).when(month_first, day(parts[2], parts[0], parts[1])).otherwise(day(parts[2], parts[1], parts[0]))
        pad = F.when(iso | (F.length(m) == 10), 2).otherwise(1)

        def moved(at: Column) -> Column:
            pair = feistel(F.floor(at / DAYS[1]), at % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
            new = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")))

            def shown(d: Column) -> Column:
                y = F.lpad(F.year(d).cast("string"), 4, "0")
                mo, da = (F.when(pad == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")) for x in (F.month(d), F.dayofmonth(d)))
                return F.when(iso, F.concat_ws("-", y, mo, da)).when(month_first, F.concat_ws("/", mo, da, y)).when(
                    slash, F.concat_ws("/", da, mo, y)).otherwise(F.concat_ws(".", da, mo, y))

            return let(new, shown)

        at = F.datediff(value, F.lit(FIRST_DAY).cast("date"))
        return let(at, lambda n: F.when(n.between(0, DAYS[0] * DAYS[1] - 1), moved(n.cast("long"))))

    return let(F.split(m, "[./-]"), of)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    def of(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        rank = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

        def shown(q: Column) -> Column:
            new = F.floor(q["l"] / 99)
            new = F.when(new + 1 >= 666, new + 2).otherwise(new + 1)
            return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((q["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((q["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(pair, shown))

    return let(F.split(m, "-").cast("array<int>"), of)


def _phone(m: Column, key: str) -> Column:
    """All digits after the country code permuted; eight to fifteen digits are a number."""
    code = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)).otherwise("")
    # a code is followed by a mark; without one the last ten digits are the subscriber's
    def of(d: Column) -> Column:
        marked = m.rlike(r"^\+[0-9]{1,3}[ .(-]")
        head = F.when(~m.startswith("+"), 0).when(marked, F.length(code)).otherwise(F.greatest(F.length(d) - 10, F.lit(1)))
        new = F.concat(F.substr(d, F.lit(1), head), permuted_digits(F.substr(d, head + 1), key, "phone"))
        return F.when(F.length(d).between(8, 15), with_digits(m, new))

    return let(digits_of(m), of)


def _card(m: Column, key: str) -> Column:
    """First digit kept, the others permuted, the check digit made anew; null when the check fails."""
    def of(d: Column) -> Column:
        n = F.length(d)
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
        valid = n.between(13, 19) & (luhn_sum(d, False) % 10 == 0)
        return F.when(valid, let(payload, lambda p: with_digits(m, F.concat(p, F.pmod(-luhn_sum(p, True), F.lit(10)).cast("string")))))

    return let(digits_of(m), of)


_RULES = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """Kind of a candidate: the first pattern that takes it whole (its borders are known to be good)."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = m.rlike(f"^(?:{pattern})$")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """Struct ``kind, value`` of a candidate; both null when it fails validation."""
    def of(kind: Column) -> Column:
        value = None
        for name, rule in _RULES.items():
            value = F.when(kind == name, rule(m, key)) if value is None else value.when(kind == name, rule(m, key))
        return let(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value")))

    return let(kind_of(m), of)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced, and a column ``pii`` with the kinds found, in order.

    The key must be a secret that does not change between runs over one corpus. E-mail addresses keep their domain, phone
    numbers their country code, cards their first digit, accounts country and letters; dates stay within 1900 to 2099.
    A null text stays null with no kinds; an empty one stays empty. A text without a digit or an @ is not searched.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col("text").cast("string")
    likely = text.rlike("[0-9@]")
    found = F.when(likely, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(likely, F.split(text, ANY, -1)).otherwise(F.array(text))
    parts = docs.withColumn("__found", F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))).withColumn("__gaps", gaps)
    new = F.array_join(F.zip_with("__gaps", "__found", lambda g, m: F.concat(g, F.coalesce(m["new"]["value"], m["old"], F.lit("")))), "")
    kinds = F.filter(F.transform("__found", lambda m: m["new"]["kind"]), lambda k: k.isNotNull())
    out = parts.withColumn("text", F.when(text.isNotNull(), F.when(F.size("__found") > 0, new).otherwise(text))).withColumn("pii", kinds)
    return out.drop("__found", "__gaps")
