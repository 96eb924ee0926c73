"""Format-preserving pseudonyms of personal data, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted

ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"

_MONTHS = "January February March April May June July August September October November December".split()
_NAMED = f"(?:{'|'.join(_MONTHS)})"
_HEX4 = "[0-9A-Fa-f]{1,4}"

# What is looked for. The first pattern that fits at a place counts; each is anchored whole to tell a find's kind.
PATTERNS = {
    "email": r"(?:\b[A-Za-z0-9_]|[À-ɏͰ-ӿ])[A-Za-z0-9À-ɏͰ-ӿ._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,8}\b",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b[0-9A-Fa-f]{32,}\b|\b(?i:password)=[0-9A-Za-z]{6,}\b|\bghp_[0-9A-Za-z]{36,}\b|\bsk-[0-9A-Za-z_-]{20,}\b"
    r"|\b(?i:api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?[0-9A-Za-z_-]{8,}\b"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "date": rf"\b{_YEAR}-{_MONTH}-{_DAY}(?:T|\b)|\b{_YEAR}/{_MONTH}/{_DAY}\b|\b{_DAY}\.{_MONTH}\.{_YEAR}\b|\b{_DAY}/{_MONTH}/{_YEAR}\b"
    rf"|\b{_MONTH}/(?:1[3-9]|2[0-9]|3[01])/{_YEAR}\b|\b{_NAMED} (?:[1-9]|[12][0-9]|3[01]), {_YEAR}\b"
    rf"|\b(?:[1-9]|[12][0-9]|3[01]) {_NAMED} {_YEAR}\b",
    "ip": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "ipv6": rf"\b(?:{_HEX4}:){{7}}{_HEX4}\b|\b(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?\b|\b[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b|\b[0-9]{3} [0-9]{2} [0-9]{4}\b",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}\b"
    r"|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b|\+[0-9]{8,15}\b|\+[0-9]{1,3}(?:[ .-](?:\([0-9]{1,4}\)|[0-9]{1,5})){2,6}\b",
    "card": r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b|\b3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}\b|\b[0-9]{13,19}\b",
}
ANY = "|".join(PATTERNS.values())


def _for_jvm(patterns: str) -> str:
    """The same finds, whatever the letters beside them, in time in proportion to a text's length.

    The JVM's \\b knows letters of all scripts before release 19, so a number right after a Chinese letter
    would have none; here borders are those of ASCII words. A run of name characters is tried for an address
    once, at its first word or right after another find, and without backing off.
    """
    name, signs = "A-Za-z0-9_À-ɏͰ-ӿ", "[.%+-]"
    again = rf"(?<=[.%+-])(?:(?<![{name}]{signs}{{1,64}})|(?<=\G{signs}{{1,64}}))"
    first = rf"(?>(?<![{name}.%+-])|{again}|\G)"
    email = PATTERNS["email"]
    patterns = patterns.replace(email, first + email.replace(r"\b", "", 1).replace("]*@", "]*+@"), 1)
    before, after = r"(?<!\w)", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    patterns = patterns.replace(r"(?:T|\b)", f"(?:T|{after})")
    return re.sub(r"(^|\|)\\b", lambda m: m[1] + before, patterns).replace(r"\b", after)


ANY_JVM = _for_jvm(ANY)
# Each find has one of these; most texts have none, and that is told fast.
CLUE = "[0-9@=]|AKIA|PRIVATE KEY|ghp_|sk-|(?i:api.?key)|[A-Fa-f]{32}|::"
DAYS = (4297, 17)  # 4297 * 17 = 73,049: the days from 1900-01-01 to 2099-12-31
# What stays in front of a secret; and the country codes of phone numbers, which stay too (ITU E.164: those of one and two digits, else three).
SECRET_FRONT = r"^(?:AKIA|(?i:password)=|ghp_|sk-|(?i:api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?|-----BEGIN [A-Z ]*-----)"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SIGNS = "0-9A-Za-zÀ-ÖØ-Þà-öø-þ"  # symbols that are permuted
# Classes of symbols: first code point, how many, for whom.
CLASSES = ((0xF8, 7), (0xE0, 23), (0xD8, 7), (0xC0, 23), (97, 26), (65, 26), (48, 10))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, radices: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of all arrays of integers below the given radices.

    The first and the second half of the array take turns: in each round digests of key, tweak, round and
    one half are added, symbol by symbol modulo its radix, to the other half; a digest serves 16 symbols,
    and more are drawn from the first. That is undone by subtraction in reverse order, so distinct values
    stay distinct and equal values stay equal. An array of one symbol is permuted as a pair, a digit of
    radix 2 and one of half the radix; where that makes one value too many, it is passed over.
    """

    def rounds(start: Column, limits: Column) -> Column:
        return _let(start, lambda v: _let(limits, lambda r: all_rounds(v, r)))

    def all_rounds(values: Column, radices: Column) -> Column:
        half = (F.size(values) / 2).cast("int")

        def one_round(state: Column, r: Column) -> Column:
            other = F.when(r % 2 == 0, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))
            first = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)

            def drawn(h: Column) -> Column:
                blocks = F.sequence(F.lit(0), ((F.size(values) - 1) / 16).cast("int"))
                return F.transform(blocks, lambda b: F.when(b == 0, h).otherwise(F.sha2(F.concat_ws("|", h, b.cast("string")), 256)))

            def turn(digests: Column) -> Column:
                def symbol(v: Column, j: Column) -> Column:
                    digest = F.get(digests, (j / 16).cast("int"))
                    add = F.conv(F.substring(digest, 1 + (j % 16) * 4, F.lit(4)), 16, 10).cast("int")
                    return F.when((j < half) == (r % 2 == 0), (v + add) % F.get(radices, j)).otherwise(v)

                return F.transform(state, symbol)

            return _let(_let(first, drawn), turn)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one_round)

    def moved(v: Column, r: Column) -> Column:
        def pair(x: Column, low: Column) -> Column:
            return F.array((x / low).cast("int"), x % low)

        def any_size(low: Column) -> Column:
            alone = F.size(v) == 1
            first = rounds(F.when(alone, pair(v[0], low)).otherwise(v), F.when(alone, F.array(F.lit(2), low)).otherwise(r))

            def joined(p: Column) -> Column:
                x = p[0] * low + p[1]
                # At most one value is passed over, so a second turn is never passed over again.
                again = _let(pair(x, low), lambda q: _let(rounds(q, F.array(F.lit(2), low)), lambda p2: p2[0] * low + p2[1]))
                return F.when(~alone, p).otherwise(F.array(F.when(x < r[0], x).otherwise(again)))

            return _let(first, joined)

        return _let(F.when(F.size(v) > 0, F.ceil(F.get(r, F.lit(0)) / 2).cast("int")), any_size)

    return _let(values, lambda v: _let(radices, lambda r: moved(v, r)))  # computed once: symbols refer to both


def mod97(text: Column) -> Column:
    """The remainder of an IBAN's upper-case letters and digits, A as 10 and so on."""

    def add(total: Column, i: Column) -> Column:
        code = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _kind(find: Column) -> Column:
    chosen = None
    for kind, pattern in PATTERNS.items():
        fits = find.rlike(f"^(?:{pattern})$")
        chosen = F.when(fits, kind) if chosen is None else chosen.when(fits, kind)
    return chosen


_STYLES = (  # of dates: pattern, how Spark spells it, how DuckDB does
    ("^[0-9]{4}-", "yyyy-MM-dd", "%Y-%m-%d"),
    ("^[0-9]{4}/", "yyyy/MM/dd", "%Y/%m/%d"),
    ("^..[.]", "dd.MM.yyyy", "%d.%m.%Y"),
    ("^../(?:1[3-9]|2|3)", "MM/dd/yyyy", "%m/%d/%Y"),
    ("^../", "dd/MM/yyyy", "%d/%m/%Y"),
    ("^[A-Z]", "MMMM d, yyyy", "%B %-d, %Y"),
    ("^", "d MMMM yyyy", "%-d %B %Y"),
)


def _by_style(find: Column, make) -> Column:
    chosen = None
    for pattern, style, _ in _STYLES:
        fits = find.rlike(pattern)
        chosen = F.when(fits, make(style)) if chosen is None else chosen.when(fits, make(style))
    return chosen


def _as_date(find: Column) -> Column:
    bare = F.regexp_replace(find, "T$", "")
    return _by_style(find, lambda style: F.try_to_timestamp(bare, F.lit(style)).cast("date"))


def _spell_date(day: Column, like: Column) -> Column:
    spelled = _by_style(like, lambda style: F.date_format(day, style))
    return F.concat(spelled, F.when(like.rlike("^[0-9-]+T$"), "T").otherwise(""))


def _class_of(code: Column, kind: Column, hexed: Column) -> tuple[Column, Column]:
    """The first code point and the number of the symbols among which a symbol is permuted.

    Letters stay in their case, letters where hexed holds a to f, and digits of phone numbers in 0-1 or 2-9,
    so area codes stay possible.
    """
    digit = (kind == "phone") & (code < 58)
    first, count = F.when(digit, F.when(code >= 50, 50).otherwise(48)), F.when(digit, F.when(code >= 50, 8).otherwise(2))
    for low, many in CLASSES:
        first, count = first.when(code >= low, low), count.when(code >= low, F.when(hexed, 6).otherwise(many) if many == 26 else many)
    return first, count


def _unit(text: Column, low: Column, high: Column, kind: Column, hexed: Column) -> Column:
    """What is permuted of a text: its symbols from place low + 1 to high; signs between them stay, so spellings of one value stay linked."""
    body = F.substring(text, low + 1, high - low)
    codes = F.transform(F.regexp_extract_all(body, F.lit(f"([{SIGNS}])"), F.lit(1)), F.ascii)

    def made(codes: Column) -> Column:
        return F.struct(
            F.transform(codes, lambda c: c - _class_of(c, kind, hexed)[0]).alias("values"),
            F.transform(codes, lambda c: _class_of(c, kind, hexed)[1]).alias("radices"),
            F.transform(codes, lambda c: _class_of(c, kind, hexed)[0]).alias("bases"),
            kind.alias("tweak"),
            text.alias("text"),
            low.cast("int").alias("low"),
            high.cast("int").alias("high"),
        )

    return _let(codes, made)


def _numbers(values: list[Column], radices: list[Column], kind: Column, text: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.struct(
        F.array(*values).cast("array<int>").alias("values"), F.array(*radices).cast("array<int>").alias("radices"), none.alias("bases"),
        kind.alias("tweak"), text.alias("text"), F.lit(0).alias("low"), F.lit(0).alias("high"),
    )


def _put(unit: Column, new: Column) -> Column:
    """The unit's text with its symbols replaced."""
    text, low, high = unit["text"], unit["low"], unit["high"]
    letters = F.transform(new, lambda v, j: F.chr(v + F.get(unit["bases"], j)))
    between = F.split(F.substring(text, low + 1, high - low), f"[{SIGNS}]", -1)
    chars = F.array_join(F.zip_with(between, F.array_append(letters, F.lit("")), lambda a, b: F.concat(a, b)), "")
    spelled = F.concat(F.substring(text, F.lit(1), low), chars, F.substring(text, high + 1, F.length(text)))
    return F.when(F.size(new) > 0, spelled).otherwise(text)


def pseudonym(find: Column, key: str) -> Column:
    """The pseudonym of one find; the find itself where it isn't valid (dates, social security, card and IBAN numbers).

    Fixed are the last label of an address's domain, the front of a secret, the country code of a phone
    number and of an IBAN, and check digits, which are computed anew. Names and domains of addresses are
    permuted apart, so addresses of one domain stay linked. Phone numbers with the country code 1 and
    those without any are one kind of ten digits. Case and separators don't enter.
    """

    def turned(number: Column, check: Column) -> Column:
        return F.concat(F.replace(F.substring(number, F.lit(5), F.length(number)), F.lit(" "), F.lit("")), F.substring(number, 1, 2), check)

    def with_card_digit(new: Column) -> Column:
        trial = luhn_sum(F.concat(_digits(F.substring(new, F.lit(1), F.length(new) - 1)), F.lit("0")))
        return F.concat(F.substring(new, F.lit(1), F.length(new) - 1), ((10 - trial % 10) % 10).cast("string"))

    def with_iban_digits(new: Column) -> Column:
        check = F.lpad((98 - mod97(turned(new, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(new, 1, 2), check, F.substring(new, F.lit(5), F.length(new)))

    def of(kind: Column) -> Column:
        no, whole, zero = F.lit(False), F.length(find), F.lit(0)
        octets = [F.split_part(find, F.lit("."), F.lit(i)).cast("int") for i in range(1, 5)]
        ip = _numbers(octets, [F.lit(256)] * 4, kind, find)

        day = F.datediff(_as_date(find), F.lit("1900-01-01").cast("date"))
        date = _let(day, lambda d: _numbers([(d / DAYS[1]).cast("int"), d % DAYS[1]], [F.lit(DAYS[0]), F.lit(DAYS[1])], kind, find))

        area, group, serial = (F.substring(find, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
        # 898 areas (1 to 899 without 666), 99 groups, 9,999 serial numbers
        triple = [area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1]
        ssn = _numbers(triple, [F.lit(898), F.lit(99), F.lit(9999)], kind, find)

        at = F.instr(find, F.lit("@"))
        name, domain = F.substring(find, F.lit(1), at - 1), F.substring(find, at + 1, whole)
        labels = F.length(F.regexp_extract(domain, "^(.*)[.]", 1))
        email = [_unit(name, zero, F.length(name), kind, no), _unit(domain, zero, labels, F.lit("domain"), no)]

        front = F.length(F.regexp_extract(find, SECRET_FRONT, 0))
        low = (
            F.when(kind == "secret", front)
            .when(kind == "phone", F.length(F.regexp_extract(find, COUNTRY, 0)))
            .when(kind == "iban", 4)
            .otherwise(0)
        )
        high = (
            F.when(kind == "card", whole - 1)
            .when((kind == "secret") & find.startswith("-----"), F.instr(find, F.lit("-----END")) - 1)
            .otherwise(whole)
        )
        hexed = (kind == "ipv6") | (kind == "secret") & F.substring(find, front + 1, whole).rlike("^(?:[0-9a-f]+|[0-9A-Fa-f]{32,})$")
        symbols = _unit(find, low, high, kind, hexed)
        valid = (
            F.when(kind == "date", _as_date(find).isNotNull())
            .when(kind == "ssn", (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0))
            .when(kind == "card", luhn_sum(_digits(find)) % 10 == 0)
            .when(kind == "iban", mod97(turned(find, F.substring(find, 3, 2))) == 1)
            .otherwise(True)
        )
        units = (
            F.when(kind == "email", F.array(*email))
            .when(kind == "ip", F.array(ip))
            .when(kind == "date", F.array(date))
            .when(kind == "ssn", F.array(ssn))
            .otherwise(F.array(symbols))
        )
        gap = F.substring(find, 4, 1)

        def spelled(units: Column, new: Column) -> Column:
            t = new[0]
            written = F.transform(units, lambda u, i: _put(u, F.get(new, i)))
            return (
                F.when(kind == "ip", F.array_join(t.cast("array<string>"), "."))
                .when(kind == "date", _spell_date(F.date_add(F.lit("1900-01-01").cast("date"), t[0] * DAYS[1] + t[1]), find))
                .when(kind == "ssn", F.format_string("%03d%s%02d%s%04d", t[0] + F.when(t[0] > 664, 2).otherwise(1), gap, t[1] + 1, gap, t[2] + 1))
                .when(kind == "email", F.array_join(written, "@"))
                .when(kind == "card", _let(written[0], with_card_digit))
                .when(kind == "iban", _let(written[0], with_iban_digits))
                .otherwise(written[0])
            )

        def permuted(units: Column) -> Column:
            moved = F.transform(units, lambda u: F.when(F.size(u["values"]) > 0, feistel(u["values"], u["radices"], key, u["tweak"])).otherwise(u["values"]))
            return _let(moved, lambda new: spelled(units, new))

        return F.when(valid, _let(units, permuted)).otherwise(find)

    return _let(_kind(find), of)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal data in text_col replaced by keyed pseudonyms of the same format.

    Found are e-mail addresses, access keys, key blocks and other secrets, dates (1900 to 2099, real days
    only, in seven spellings), IPv4 and IPv6 addresses, IBANs (check digits tested), social security, phone
    and card numbers (Luhn checked). All other characters and columns stay as they are. Equal values get
    equal pseudonyms under one key, in every document, and distinct values of a format get distinct ones.
    count_col, if given, gets the number of finds; a name that docs has already is a ValueError. Null text
    stays null with count 0; empty text stays empty; texts of any length are searched whole, and a find may
    be of any length. Rows keep their number and repeats. No rows: no rows. No Python runs on the executors
    and nothing is shuffled.
    """
    if count_col and free_name(docs, count_col) != count_col:
        raise ValueError(f"there is a column {count_col} already")
    text = quoted(text_col)
    has = text.rlike(CLUE) & text.rlike(ANY_JVM)
    finds = F.regexp_extract_all(text, F.lit(f"({ANY_JVM})"), F.lit(1))
    new = F.array_append(F.transform(finds, lambda m: pseudonym(m, key)), F.lit(""))
    joined = F.array_join(F.zip_with(F.split(text, ANY_JVM, -1), new, lambda a, b: F.concat(a, b)), "")
    columns = {text_col: F.when(has, joined).otherwise(text)}
    if count_col:
        columns[count_col] = F.coalesce(F.when(has, F.size(finds)), F.lit(0)).cast("long")
    return docs.withColumns(columns)
