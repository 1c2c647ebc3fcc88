"""Format-preserving pseudonyms for personal numbers, dates and addresses, with built-in functions only.

Every document is cut once by one pattern into plain parts and matches; a match that passes its check is
replaced by a keyed Feistel permutation within its format, so equal values get equal pseudonyms in all
documents, the format stays, and different values of one kind never meet. Every format's values are numbered and
permuted over exactly those numbers (Feistel steps over two parts of any sizes), so no walk is needed:

* card: 13 to 19 digits that pass the Luhn check; all digits but the last are permuted and the check
  digit is set anew; leading zeros stay as many. Other digit runs of that length are kept as they are;
* phone: the digits after the country code (and a bracketed trunk zero) are permuted, leading zeros stay as many; so a number
  is linked in all its notations: with or without spaces, country code and trunk zero;
* social security number: permuted among the numbers that the pattern admits;
* IBAN: passes the mod-97 check; the account's digits are permuted and the check digits set anew;
* date: a real calendar day of the years 1000 to 2999, permuted within 40 years, in the same notation: year first, day first,
  month first (where the second number can't be a month), or with the month's name in English, German, French or Spanish. Days up to the
  12th stay such, so that a pseudonym reads as one day only; 29 February goes to another leap year of 97;
* IPv4: four octets, permuted as 32 bits;
* e-mail: the local part becomes a keyed digest of the same length (8 characters at least), the domain's
  names a digest below `.invalid`;
* secret: a hexadecimal run of 32 to 64 digits, by a keyed digest of the same length and letter case.
"""

from __future__ import annotations

import re
from calendar import isleap, monthrange
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_YEAR, YEARS = 1000, 40  # dates are permuted within blocks of so many years
# Month and day, as one number, of the days after the 12th that every year has; and the leap years.
LATE_DAYS = [m * 100 + d for m in range(1, 13) for d in range(13, monthrange(2001, m)[1] + 1)]
LEAP_YEARS = [y for y in range(1000, 3000) if isleap(y)]
LEAPS = 97  # of 400 years
# Names of the months (English, short English, French, Spanish, German), and the lengths of country codes.
MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr may jun jul aug sep oct nov dec "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "januar februar märz april mai juni juli august september oktober november dezember"
).split()
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
NAMED = "(?iu:" + "|".join(sorted(set(MONTHS), key=lambda n: (-len(n), n))) + ")"
YEAR, DAY, MONTH = "[12][0-9]{3}", "(?:[0-2]?[0-9]|3[01])", "(?:0?[0-9]|1[0-2])"
DAY_NAMED = rf"({DAY})(st|nd|rd|th|\.)?( de | )({NAMED})(\.?,? | de )({YEAR})"
NAMED_DAY = rf"({NAMED})(\.? )({DAY})(st|nd|rd|th)?(,? )({YEAR})"


def _plain(pattern: str) -> str:
    """A pattern without numbered groups."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "card", "phone")
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9]{0,63}[A-Fa-f])(?=[A-Fa-f]{0,63}[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9/.-])(?:{YEAR}-[01][0-9]-[0-3][0-9]|(?:{DAY}/{MONTH}|{MONTH}/{DAY})/{YEAR}|{DAY}\.{MONTH}\.{YEAR}|"
    rf"(?<![\p{{L}}\p{{N}}])(?:{_plain(DAY_NAMED)}|{_plain(NAMED_DAY)}))(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]|[.-][0-9])"
    r"|(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-](?:\(0\) ?)?[0-9]|0[1-9])(?:[ .-][0-9]{2}){4}(?![0-9]|[.-][0-9])"
    r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-](?:\(0\) ?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{4,9}(?![0-9]|[./-][0-9])"
    r"|(?<![\p{L}\p{N}+./-])0[1-9][0-9]{1,3}[ /-][0-9]{5,9}(?![0-9]|[./-][0-9])"
    r"|(?<![\p{L}\p{N}+])\+[0-9]{8,15}(?![0-9])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _noise(key: str, tag: str, turn: Column, size: Column, half: Column) -> Column:
    """60 keyed pseudo-random bits."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), turn, size, half).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A permutation of all digit strings of one length (at most 36), by an unbalanced Feistel network."""
    size = F.length(digits)
    left = F.floor(size / 2).cast("int")
    right = size - left
    start = F.struct(
        F.substr(digits, F.lit(1), left).cast("long").alias("a"),
        F.substr(digits, left + 1, right).cast("long").alias("b"),
        left.alias("m"),
        right.alias("n"),
    )

    def turn(state: Column, i: Column) -> Column:
        mixed = F.pmod(F.coalesce(state.a, F.lit(0)) + _noise(key, tag, i, size, state.b), F.greatest(_ten(state.m), F.lit(1)))
        return F.struct(state.b.alias("a"), mixed.alias("b"), state.n.alias("m"), state.m.alias("n"))

    end = lambda s: F.concat(F.lpad(s.a.cast("string"), left, "0"), F.lpad(s.b.cast("string"), right, "0"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, end)


def permute_number(value: Column, half: int, key: str, tag: str) -> Column:
    """A permutation of 0 .. half**2 - 1."""
    start = F.struct(F.floor(value / half).cast("long").alias("a"), F.pmod(value, F.lit(half)).cast("long").alias("b"))
    turn = lambda s, i: F.struct(s.b.alias("a"), F.pmod(s.a + _noise(key, tag, i, F.lit(half), s.b), F.lit(half)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s.a * half + s.b)


def permute_pair(a: Column, b: Column, a_size: Column, b_size: Column, key: str, tag: str) -> Column:
    """A permutation of all pairs of numbers below `a_size` and `b_size`, as a struct of a and b: in turn, noise of one is added to the other."""
    size = F.concat_ws(",", a_size, b_size)
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), a_size.cast("long").alias("m"), b_size.cast("long").alias("n"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.pmod(s.a + _noise(key, tag, i, size, s.b), s.m)
        return F.struct(s.b.alias("a"), mixed.alias("b"), s.n.alias("m"), s.m.alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def permute_led(digits: Column, key: str, tag: str) -> Column:
    """A permutation of digit strings (at most 36) that keeps how many zeros they begin with; what follows these decides alone."""
    zeros = F.regexp_extract(digits, "^0*", 0)
    n = F.length(digits) - F.length(zeros)
    left = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    least = _ten(left - 1)
    head = F.substr(digits, F.length(zeros) + 1, left).cast("long") - least
    tail = F.coalesce(F.substr(digits, F.length(zeros) + left + 1, n - left).try_cast("long"), F.lit(0))
    moved = permute_pair(head, tail, least * 9, _ten(n - left), key, tag)
    shown = _with(moved, lambda x: F.concat(zeros, (x.a + least).cast("string"), F.lpad(x.b.cast("string"), n - left, "0")))
    return F.when(n > 0, shown).otherwise(digits)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a whole number, its last digit undoubled; a valid one is divisible by ten."""
    places = F.reverse(F.split(digits, ""))
    worth = F.transform(
        F.filter(places, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capital letters (A counts as 10)."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits`, in their order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        number = c.between("0", "9") & (c != "")
        return F.struct(
            F.concat(s.out, F.when(number, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(number, s["at"] + 1).otherwise(s["at"]).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s.out)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    payload = permute_led(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(digits) % 10 == 0, refill(m, F.concat(payload, check))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, rf"^{COUNTRY}(?:[ .-]?\(0\))?[ .-]?", 0)
    rest = F.substr(m, F.length(country) + 1, F.length(m))
    return F.concat(country, refill(rest, permute_led(_only_digits(rest), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(_only_digits(m), F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    ranked = area - F.when(area > 666, 2).otherwise(1)
    moved = permute_pair(ranked, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def shown(x: Column) -> Column:
        parts = (x.a + F.when(x.a >= 665, 2).otherwise(1), F.floor(x.b / 9999) + 1, F.pmod(x.b, F.lit(9999)) + 1)
        return F.concat_ws("-", *(F.lpad(part.cast("string"), n, "0") for part, n in zip(parts, (3, 2, 4), strict=True)))

    return _with(moved, shown)


def _iban(m: Column, key: str) -> Column:
    compact = F.regexp_replace(m, " ", "")
    account = F.substr(compact, F.lit(5), F.length(compact))
    numbers = _only_digits(account)
    moved = F.when(F.length(numbers) >= 2, refill(account, permute_digits(numbers, key, "iban"))).otherwise(account)
    country = F.substr(compact, F.lit(1), F.lit(2))
    check = F.lpad((98 - mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    letters = F.filter(F.split(F.concat(country, check, moved), ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    spaced = F.aggregate(
        F.filter(F.split(m, ""), lambda c: c != ""),
        start,
        lambda s, c: F.struct(
            F.concat(s.out, F.when(c == " ", c).otherwise(F.get(letters, s["at"]))).alias("out"),
            F.when(c == " ", s["at"]).otherwise(s["at"] + 1).alias("at"),
        ),
        lambda s: s.out,
    )
    valid = mod97(F.concat(account, F.substr(compact, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, spaced).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    moved = permute_number(value, 65536, key, "ip")
    return F.concat_ws(".", *(F.pmod(F.floor(moved / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("long").alias("y"), month.cast("long").alias("m"), day.cast("long").alias("d"))


def permute_day(at: Column, key: str) -> Column:
    """A permutation of the days (structs of y, m, d) of the years 1000 to 2999: within 40 years, those up to the 12th among themselves."""
    since = at.y - FIRST_YEAR
    block = F.floor(since / YEARS) * YEARS + FIRST_YEAR
    of_block = F.pmod(since, F.lit(YEARS))
    late, leaps = (F.array(*map(F.lit, values)) for values in (LATE_DAYS, LEAP_YEARS))
    place = F.array_position(leaps, at.y.cast("int")) - 1
    leap = permute_pair(F.pmod(place, F.lit(LEAPS)), F.lit(0), F.lit(LEAPS), F.lit(1), key, "leap day")
    leap = _with(leap, lambda x: _day(F.get(leaps, (x.a + F.floor(place / LEAPS) * LEAPS).cast("int")), F.lit(2), F.lit(29)))
    early = permute_pair(of_block, (at.m - 1) * 12 + at.d - 1, F.lit(YEARS), F.lit(144), key, "early day")
    early = _with(early, lambda x: _day(block + x.a, F.floor(x.b / 12) + 1, F.pmod(x.b, F.lit(12)) + 1))
    other = permute_pair(of_block, F.array_position(late, (at.m * 100 + at.d).cast("int")) - 1, F.lit(YEARS), F.lit(len(LATE_DAYS)), key, "late day")
    number = lambda x: F.get(late, x.b.cast("int"))
    other = _with(other, lambda x: _day(block + x.a, F.floor(number(x) / 100), F.pmod(number(x), F.lit(100))))
    return F.when((at.m == 2) & (at.d == 29), leap).when(at.d <= 12, early).otherwise(other)


def _padded(n: Column, like: Column) -> Column:
    """A number in two digits, or, where the one in its place has one digit, without a leading zero."""
    return F.when(F.length(like) < 2, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))


def _ordinal(n: Column, like: Column) -> Column:
    """The ending of an English ordinal number, where `like` is one."""
    ending = F.when(F.floor(n / 10) == 1, "th").otherwise(F.coalesce(F.get(F.array(F.lit("th"), F.lit("st"), F.lit("nd"), F.lit("rd")), F.pmod(n, F.lit(10)).cast("int")), F.lit("th")))
    return F.when(like.isin("", "."), like).otherwise(ending)


def _date(m: Column, key: str) -> Column:
    ymd, numbers, day_named, named_day = f"^({YEAR})-([0-9]{{2}})-([0-9]{{2}})$", f"^([0-9]{{1,2}})([/.])([0-9]{{1,2}})[/.]({YEAR})$", f"^{DAY_NAMED}$", f"^{NAMED_DAY}$"
    part = lambda pattern, i: F.regexp_extract(m, pattern, i)
    names = F.array(*map(F.lit, MONTHS))

    def place(name: Column, mark: Column) -> Column:  # "5. April" is German
        german = F.array_position(F.array(*map(F.lit, MONTHS[48:])), F.lower(name))
        return F.when((mark == ".") & (german > 0), german + 48).otherwise(F.array_position(names, F.lower(name))) - 1

    def named(at: Column, name: Column, mark: Column) -> Column:
        new = F.get(names, (F.floor(place(name, mark) / 12) * 12 + at.m - 1).cast("int"))
        return F.when(name == F.upper(name), F.upper(new)).when(name == F.lower(name), new).otherwise(F.initcap(new))

    month_first = (part(numbers, 2) == "/") & part(numbers, 3).try_cast("int").between(13, 31)
    first, second = part(numbers, 1), part(numbers, 3)
    by_name = F.pmod(place(part(day_named, 4), part(day_named, 2)), F.lit(12)) + 1
    name_by = F.pmod(place(part(named_day, 1), F.lit("")), F.lit(12)) + 1
    ways = (
        (ymd, _day(part(ymd, 1), part(ymd, 2), part(ymd, 3)), lambda at: F.concat_ws("-", at.y.cast("string"), F.lpad(at.m.cast("string"), 2, "0"), F.lpad(at.d.cast("string"), 2, "0"))),
        (
            numbers,
            _day(part(numbers, 4), F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first)),
            lambda at: F.concat(
                _padded(F.when(month_first, at.m).otherwise(at.d), first), part(numbers, 2), _padded(F.when(month_first, at.d).otherwise(at.m), second), part(numbers, 2), at.y.cast("string")
            ),
        ),
        (
            day_named,
            _day(part(day_named, 6), by_name, part(day_named, 1)),
            lambda at: F.concat(at.d.cast("string"), _ordinal(at.d, part(day_named, 2)), part(day_named, 3), named(at, part(day_named, 4), part(day_named, 2)), part(day_named, 5), at.y.cast("string")),
        ),
        (
            named_day,
            _day(part(named_day, 6), name_by, part(named_day, 3)),
            lambda at: F.concat(named(at, part(named_day, 1), F.lit("")), part(named_day, 2), at.d.cast("string"), _ordinal(at.d, part(named_day, 4)), part(named_day, 5), at.y.cast("string")),
        ),
    )

    def moved(at: Column, shown: Callable[[Column], Column]) -> Column:
        text = F.concat_ws("-", at.y.cast("string"), F.lpad(at.m.cast("string"), 2, "0"), F.lpad(at.d.cast("string"), 2, "0"))
        return F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), _with(permute_day(at, key), shown))

    chain = F.when(F.lit(False), m)
    for pattern, read, shown in ways:
        chain = chain.when(m.rlike(pattern), _with(read, lambda at: moved(at, shown)))  # noqa: B023
    return F.coalesce(chain, m)


def _email(m: Column, key: str) -> Column:
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    digest = lambda x: F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(x)).cast("binary"), 256)
    name = F.concat(F.lit("u"), F.substr(digest(F.concat_ws("@", local, domain)), F.lit(1), F.greatest(F.length(local) - 1, F.lit(7))))
    return F.concat(name, F.lit("@d"), F.substr(digest(domain), F.lit(1), F.lit(8)), F.lit(".invalid"))


def _secret(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("secret"), F.lower(m)).cast("binary"), 256)
    moved = F.substr(digest, F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(moved)).otherwise(moved)


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """Which pattern a match belongs to, in the patterns' order."""
    chain = F.when(F.contains(m, F.lit("@")), F.lit("email"))
    for kind in KINDS[1:]:
        chain = chain.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    return chain.otherwise(F.lit("phone"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a match; a match that fails the check of its kind is returned as it is."""
    chain = F.when(F.lit(False), m)
    for name in KINDS:
        chain = chain.when(kind == name, _MAKERS[name](m, key))
    return chain.otherwise(m)


def pseudonymize(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, n_replaced, and n_<kind> of values replaced.

    A null text stays null with counts of 0; texts without matches are unchanged; repeated rows give
    repeated rows; texts of any length are read whole; an empty table gives an empty result; other columns are not read. No shuffle. The
    digits between two matches, a failed check or longer runs are never touched.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = F.when(F.col("_text").rlike("[0-9@]"), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    matched = source.withColumn("_found", F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    moved = matched.withColumn(
        "_moved", F.transform("_found", lambda x: F.struct(x.m.alias("m"), x.kind.alias("kind"), pseudonym(x.m, x.kind, key).alias("to")))
    )
    parts = F.zip_with(F.split("_text", ANY, -1), F.transform("_moved", lambda x: x["to"]), lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
    text = F.when(F.size("_moved") > 0, F.array_join(parts, "")).otherwise(F.col("_text"))
    changed = F.filter("_moved", lambda x: x.m != x["to"])

    def number(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("_changed", lambda x: x.kind == kind)), F.lit(0)).alias(f"n_{kind}")

    return (
        moved.select("doc_id", text.alias("text"), changed.alias("_changed"))
        .select("doc_id", "text", F.coalesce(F.size("_changed"), F.lit(0)).alias("n_replaced"), *map(number, KINDS))
    )
