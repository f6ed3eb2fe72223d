"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Everything here is DataFrame expressions. One pattern finds candidates; each
is validated (check digits, ranges, calendar) and replaced by its image under
a keyed Feistel permutation within its own format: a card number becomes a
card number with a right check digit, a date a date, an address an address.
Permutations are one-to-one and depend on the key and the value alone, so that
equal values stay linked across documents and different ones stay apart.

A Feistel network splits a value into two parts and adds to one part, in turns,
a keyed hash of the other; additions are taken modulo the size of each
place's alphabet (or of a part's range), so that every step can be undone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a network; even, so that the parts end where they began.
ROUNDS = 8

# fixed values: lengths of account numbers by country
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int) -> str:
    """What follows the check digits: in one piece, or in groups of four."""
    groups, rest = divmod(length - 4, 4)
    return rf"\d{{2}}(?:[A-Z0-9]{{{length - 4}}}|(?: [A-Z0-9]{{4}}){{{groups}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "") + ")"


# candidates; the numbers of the groups count through the whole pattern
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c.replace(' ', '|')}){_account(n)}" for n, c in _IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
_HEXTET = "[0-9A-Fa-f]{1,4}"
_IP6 = (
    rf"(?<![\w:.])(?:(?:{_HEXTET}:){{7}}{_HEXTET}|{_HEXTET}(?::{_HEXTET}){{0,5}}::(?:{_HEXTET}(?::{_HEXTET}){{0,5}})?|::{_HEXTET}(?::{_HEXTET}){{0,6}})(?![\w:]|\.\d)"
)
_YMD = r"(?<![\w./-])(?:19|20)\d{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])(?![\w/-]|\.\d)"
_DMY = r"(?<![\w./-])\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d{2}(?![\w/-]|\.\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}([ .-])\d{2,4}(?:\3\d{2,4}){1,4}(?!\d)"
    r"|(?<![\w+])\+\d{8,15}(?!\d)"
    r"|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.-])\d{3}([.-])\d{3}\4\d{4}(?![\w-])"
    r"|(?<![\w.,/+-])0[1-9]\d{1,3}[ /-]\d{6,8}(?![\w-]|[.,]\d)"
)
_CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\5\d{4}\5\d{4}|\d{4}([ -])\d{6}\6\d{5})(?![\w-])"

#: All candidates.
PATTERN = "|".join((_EMAIL, _IBAN, _IP6, _YMD, _DMY, _IP, _SSN, _PHONE, _CARD))

_FIRST_YEAR, _YEARS = 1900, 200
_FIRST_DAY, _DAYS = "1900-01-01", 73049  # up to 2099-12-31; 73049 = 17 * 4297
#: Days after the 28th in months that always have them, and leap years from 1904 to 2096.
_LATE = [(d, m) for d in (29, 30, 31) for m in range(1, 13) if m != 2 and (d < 31 or m in (1, 3, 5, 7, 8, 10, 12))]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, label: str, turn: Column, part: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), turn.cast("string"), part), 256)


def _number(hexes: Column, at, size: int) -> Column:
    return F.conv(F.substring(hexes, at, size), 16, 10).cast("long")


# permutations


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, label: str) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b; a struct of both."""

    def step(acc: Column, turn: Column) -> Column:
        first = _let(
            (acc["a"] + _number(_digest(key, label, turn, acc["b"].cast("string")), 1, 12)) % size_a,
            lambda x: F.struct(
                x.alias("a"), ((acc["b"] + _number(_digest(key, label, -turn, x.cast("string")), 1, 12)) % size_b).alias("b")
            ),
        )
        return first

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)


#: First character and size of each alphabet; that of a place does not change with the value in it.
ALPHABETS = {"d": (48, 10), "z": (48, 2), "n": (50, 8), "l": (97, 26), "u": (65, 26), "h": (97, 6), "H": (65, 6)}


def _turned(c: Column, kind: Column, by: Column) -> Column:
    def within(first: int, size: int) -> Column:
        return F.char(F.pmod(F.ascii(c) - F.lit(first) + by, F.lit(size)) + F.lit(first))

    out = F.when(kind == "d", within(48, 10))
    for name, (first, size) in ALPHABETS.items():
        out = out.when(kind == name, within(first, size))
    return out.otherwise(c)


def permute_characters(marked: Column, key: str, label: str) -> Column:
    """A keyed permutation of texts that keeps each place's alphabet.

    ``marked`` is an array of structs of a character ``c`` and its alphabet
    ``k``: d digits, z digits below 2, n digits from 2 on, l and u letters, h
    and H letters up to f, x stays as it is. A character's image lies in its
    own alphabet, so texts that differ in an alphabet have images that do.
    Upper and lower case turn alike. Returns the new text.
    """
    per = 16  # places that one digest turns, by four hex digits each

    def step(acc: Column, turn: Column) -> Column:
        other = F.lower(F.array_join(F.transform(acc["r"], lambda e: e["c"]), ""))
        first = _digest(key, label, turn, other)
        # a longer half takes a digest for each sixteen places
        more = F.transform(F.sequence(F.lit(1), F.floor(F.size(acc["l"]) / per).cast("int")), lambda b: _digest(key, label, turn, F.concat_ws("|", b.cast("string"), other)))
        return _let(
            F.when(F.size(acc["l"]) <= per, first).otherwise(F.concat(first, F.array_join(more, ""))),
            lambda h: F.struct(
                acc["r"].alias("l"),
                F.transform(
                    acc["l"],
                    lambda e, i: F.struct(_turned(e["c"], e["k"], _number(h, i * 4 + 1, 4)).alias("c"), e["k"].alias("k")),
                ).alias("r"),
            ),
        )

    def whole(m: Column) -> Column:
        half = F.floor(F.size(m) / 2).cast("int")
        start = F.struct(F.slice(m, F.lit(1), half).alias("l"), F.slice(m, half + 1, F.size(m)).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            start,
            step,
            lambda acc: F.array_join(F.transform(F.concat(acc["l"], acc["r"]), lambda e: e["c"]), ""),
        )

    return _let(marked, whole)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _marked(text: Column, lower: str = "l", upper: str = "u") -> Column:
    """Every character with the alphabet it belongs to."""
    return F.transform(
        _characters(text),
        lambda c: F.struct(
            c.alias("c"),
            F.when(c.rlike("^[0-9]$"), "d").when(c.rlike("^[a-z]$"), lower).when(c.rlike("^[A-Z]$"), upper).otherwise("x").alias("k"),
        ),
    )


def _refill(form: Column, filling: Column, places: str = "[0-9]") -> Column:
    """``form`` with its characters of a class replaced, in order, by those of ``filling``."""
    chars = _characters(form)
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                c.rlike(f"^{places}$"),
                F.substring(filling, F.length(F.regexp_replace(F.substring(form, 1, i + 1), f"[^{places[1:-1]}]", "")), 1),
            ).otherwise(c),
        ),
        "",
    )


# validation and images


def _luhn_sum(digits: Column, odd_doubled: bool) -> Column:
    """Sum of digits from the right, every second one doubled and cast out."""
    backwards = F.transform(_characters(F.reverse(digits)), lambda c: c.try_cast("int"))
    turned = F.transform(
        backwards,
        lambda d, i: F.when((i % 2) == (0 if odd_doubled else 1), F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d),
    )
    return F.aggregate(turned, F.lit(0), lambda a, d: a + d)


def _card(hit: Column, key: str) -> Column:
    """The first digit stays, the check digit is made right again."""

    def of(digits: Column) -> Column:
        inner = _marked(F.substr(digits, F.lit(2), F.length(digits) - 2))
        moved = _let(
            F.concat(F.substring(digits, 1, 1), permute_characters(inner, key, "card")),
            lambda body: _refill(hit, F.concat(body, F.pmod(-_luhn_sum(body, True), F.lit(10)).cast("string"))),
        )
        valid = (_luhn_sum(digits, False) % 10 == 0) & digits.rlike("^[1-9]") & ~digits.rlike(r"^(\d)\1*$")
        return F.when(valid, moved)

    return _let(F.regexp_replace(hit, "[^0-9]", ""), of)


def _mod97(text: Column) -> Column:
    return F.aggregate(
        _characters(text),
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def _iban(hit: Column, key: str) -> Column:
    """The country stays, the check digits are made right again."""

    def of(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain) - 4)
        moved = _let(
            permute_characters(_marked(account), key, "iban"),
            lambda a: _refill(
                hit,
                F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a),
                "[A-Z0-9]",
            ),
        )
        return F.when(_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1, moved)

    return _let(F.regexp_replace(hit, " ", ""), of)


def _ip(hit: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        part = lambda i: F.get(o, F.lit(i)).try_cast("long")
        pair = permute_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ip")
        return _let(pair, lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))

    return _let(F.split(hit, r"\."), of)


def _ip6(hit: Column, key: str) -> Column:
    """Digits stay digits and letters letters in each place; colons stay. A hit without a digit is none."""
    return F.when(hit.rlike("[0-9]"), permute_characters(_marked(hit, "h", "H"), key, "ip6"))


def _ssn(hit: Column, key: str) -> Column:
    """Areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999."""

    def of(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)).try_cast("long") for i in range(3))
        pair = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

        def told(q: Column) -> Column:
            return F.concat_ws(
                "-",
                F.lpad(F.when(q["a"] >= 665, q["a"] + 2).otherwise(q["a"] + 1).cast("string"), 3, "0"),
                F.lpad((F.floor(q["b"] / 9999) + 1).cast("string"), 2, "0"),
                F.lpad((q["b"] % 9999 + 1).cast("string"), 4, "0"),
            )

        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(pair, told))

    return _let(F.split(hit, "-"), of)


def _phone(hit: Column, key: str) -> Column:
    """A country code stays. In numbers of ten digits, area code and exchange stay below 2 or from 2 on; a leading 0 stays."""
    code = F.regexp_extract(hit, r"^\+(1(?!\d{0,6}$)|\d{1,3}(?=[ .(-])|\d{2})", 1)
    trunk = F.regexp_extract(hit, r"^(0)[1-9]\d{1,3}[ /-]\d{6,8}$", 1)

    def of(parts: Column) -> Column:
        held, digits = parts["held"], parts["digits"]
        rest = F.substr(digits, F.length(held) + 1, F.length(digits))
        places = F.transform(
            _characters(rest),
            lambda c, i: F.struct(
                c.alias("c"),
                F.when((parts["trunk"] == "0") & (i == 0), "x")
                .when((F.length(rest) == 10) & ((i == 0) | (i == 3)), F.when(c.rlike("^[2-9]$"), "n").otherwise("z"))
                .otherwise("d")
                .alias("k"),
            ),
        )
        moved = _refill(hit, F.concat(held, permute_characters(places, key, "phone")))
        return F.when((F.length(digits) <= 15) & (F.length(rest) >= 6), moved)

    return _let(F.struct(F.concat(code, trunk).alias("held"), trunk.alias("trunk"), F.regexp_replace(hit, "[^0-9]", "").alias("digits")), of)


def _email(hit: Column, key: str) -> Column:
    """Letters and digits change in place; the last label of the domain stays."""
    body = F.regexp_extract(hit, r"^(.*)\.[^.]+$", 1)
    return F.concat(permute_characters(_marked(body), key, "email"), F.substr(hit, F.length(body) + 1, F.length(hit)))


def _late(year: Column, month: Column, day: Column, key: str) -> Column:
    """The image of a date after the 12th of a month, among those, as year, month and day.

    The 13th to 28th, of any month, later days of months that have them each year,
    and the 29th of February are permuted apart.
    """
    spots = F.array(*[F.lit(d * 100 + m) for d, m in _LATE])
    spot = (F.array_position(spots, (day * 100 + month).cast("int")) - 1).cast("long")
    early = permute_pair((year - _FIRST_YEAR) * 12 + month - 1, day - 13, _YEARS * 12, 16, key, "day")
    rest = permute_pair(year - _FIRST_YEAR, spot, _YEARS, len(_LATE), key, "late")
    leap = F.floor((year - 1904) / 4)
    leaps = permute_pair(leap % 7, F.floor(leap / 7), 7, 7, key, "leap")
    parts = lambda y, m, d: F.struct(*[x.cast("int").alias(n) for n, x in zip("ymd", (y, m, d))])
    return (
        F.when(day <= 28, _let(early, lambda q: parts(F.floor(q["a"] / 12) + _FIRST_YEAR, q["a"] % 12 + 1, q["b"] + 13)))
        .when(month == 2, _let(leaps, lambda q: parts((q["b"] * 7 + q["a"]) * 4 + 1904, F.lit(2), F.lit(29))))
        .otherwise(_let(rest, lambda q: _let(F.get(spots, q["b"].cast("int")), lambda s: parts(q["a"] + _FIRST_YEAR, s % 100, F.floor(s / 100)))))
    )


def _date(hit: Column, key: str) -> Column:
    """Dates from 1900 to 2099. With slashes the month comes first where that is a date, else the day.

    A date whose day must come first, as it is above 12, becomes one of these,
    so that its image can't be read as that of another date.
    """
    sep = F.regexp_extract(hit, "[-/.]", 0)

    def of(p: Column) -> Column:
        one, two, three = (F.get(p, F.lit(i)) for i in range(3))
        year_first = F.length(one) == 4
        month_first = ~year_first & (sep == "/") & (one.try_cast("int") <= 12)
        year = F.when(year_first, one).otherwise(three)
        month = F.when(year_first, two).when(month_first, one).otherwise(two)
        day = F.when(year_first, three).when(month_first, two).otherwise(one)
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        date = F.try_to_date(iso, "yyyy-MM-dd")
        number = F.datediff(date, F.lit(_FIRST_DAY).cast("date"))
        padded = F.length(one) + F.length(two) + F.length(three) >= 8

        def told(new: Column) -> Column:
            part = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
            y, m, d = new["y"].cast("string"), part(new["m"]), part(new["d"])
            return F.when(year_first, F.concat_ws("-", y, m, d)).when(month_first, F.concat_ws("-", m, d, y)).otherwise(F.concat_ws("-", d, m, y))

        def any_date(n: Column) -> Column:
            pair = permute_pair(n % 17, F.floor(n / 17), 17, 4297, key, "date")
            moved = lambda q: F.date_add(F.lit(_FIRST_DAY).cast("date"), (q["b"] * 17 + q["a"]).cast("int"))
            return _let(pair, lambda q: _let(moved(q), lambda d: F.struct(F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"))))

        day_above = ~year_first & ~month_first & (sep == "/")
        late = _late(F.year(date), F.month(date), F.day(date), key)
        moved = F.when(day_above, late).otherwise(any_date(number))
        return F.when(number.between(0, _DAYS - 1), F.replace(_let(moved, told), F.lit("-"), sep))

    return _let(F.split(hit, "[-/.]"), of)


_KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("email", "@", _email),
    ("iban", "^[A-Z]", _iban),
    ("ip6", "^[0-9A-Fa-f]*:", _ip6),
    ("ip", r"^\d{1,3}(\.\d{1,3}){3}$", _ip),
    ("date", r"^(\d{4}([-/.])\d{2}\2\d{2}|\d{1,2}([-/.])\d{1,2}\3\d{4})$", _date),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$", _ssn),
    ("phone", r"^([+(]|\d{3}[.-]\d{3}[.-]\d{4}$|0\d{2,4}[ /-]\d{6,8}$)", _phone),
    ("card", r"^\d", _card),
]


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value"))


def pseudonym(hit: Column, key: str) -> Column:
    """A struct of ``kind`` and ``value`` for one candidate; both null if it isn't valid."""
    found = None
    for kind, form, image in _KINDS:
        one = _let(image(hit, key), _named(kind))
        found = F.when(hit.rlike(form), one) if found is None else found.when(hit.rlike(form), one)
    return found


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with personal values in the text replaced by pseudonyms.

    All rows and columns stay. With ``counts``, columns ``n_replaced`` (bigint)
    and ``kinds`` (array of the kinds replaced, sorted, each once) are added,
    replacing columns of these names. A null text stays null with no
    replacement, an empty one empty; an empty table gives an empty result, and
    repeated rows get equal results. Candidates that fail validation stay as they are, as does
    everything between candidates, byte by byte. No exchange is needed: rows
    are treated one by one, and very long texts cost in proportion.
    """
    text = F.col(text_col)

    def changed(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
        return _let(
            F.transform(hits, lambda h: F.struct(h.alias("raw"), pseudonym(h, key).alias("new"))),
            lambda found: F.struct(
                F.array_join(
                    F.zip_with(
                        F.split(t, PATTERN, -1),
                        found,
                        lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f["new"]["value"], f["raw"], F.lit(""))),
                    ),
                    "",
                ).alias("text"),
                F.size(F.filter(found, lambda f: f["new"]["kind"].isNotNull())).cast("long").alias("n"),
                F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda f: f["new"]["kind"]), lambda k: k.isNotNull()))).alias("kinds"),
            ),
        )

    # most texts have no candidate; every candidate has a digit or an at sign
    has = text.rlike("[0-9@]") & text.rlike(PATTERN)
    untouched = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("kinds"))
    mark = "_changed"
    while mark in docs.columns:
        mark += "_"
    out = docs.withColumn(mark, F.when(has, changed(text)).otherwise(untouched)).withColumn(text_col, F.col(f"{mark}.text"))
    if counts:
        out = out.withColumn("n_replaced", F.col(f"{mark}.n")).withColumn("kinds", F.col(f"{mark}.kinds"))
    return out.drop(mark)
