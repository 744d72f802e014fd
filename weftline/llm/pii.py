"""PII: format-preserving Feistel pseudonyms of validated numbers and dates; DataFrame functions only.

Method. One regular expression finds candidates; each is validated (check digits of cards and bank accounts, calendar of dates,
octets of addresses, ranges of phone and social security numbers) and what is valid is permuted within its format by a keyed
Feistel network: digits are added to digits, modulo the size of the alphabet or of half of the range, from the SHA-512 of
key, kind, round and the other half. Around the network ``P`` stands a step that leaves nothing in its place: the pseudonym of x is
``P^-1(P(x) + 1)``, so no value is ever its own pseudonym. Equal values get equal pseudonyms in all documents, different
values of a format different ones, and separators and validity stay.

Formats (``KINDS``):

* email: letters (of either case, which count as different) and digits of the mailbox, by domain; the domain stays;
* iban: digits after the country, with new check digits; letters stay;
* ipv6: the hexadecimal digits of full and shortened addresses;
* phone: international with ``+``, 8 to 15 digits, the country's first digits stay; of ten digits in three groups, where the
  first two groups begin with 2 to 9 before and after;
* ip: four octets, over all 32 bits;
* date, over the 146,097 days of a Gregorian cycle (1800-01-01 to 2199-12-31), taken as 209 x 699: year-month-day, day.month.year,
  month/day/year (with two digits each in the result), day month-name year, month-name day, year;
* ssn: over the valid area-group and serial numbers;
* card: 13 to 19 digits in one run or in groups of 4-4-4-4, 4-4-4-4-3 or 4-6-5, with a new check digit; of a longer run of groups each
  four that are a valid card;
* hex: runs of 32 to 128 hexadecimal digits of one case with digits and letters.

Values that stand side by side are told apart before they are validated: account numbers have the length of their country, a number in groups ends where a date, an address, a
card or another number begins, and a hyphen may join two values.

Every step is a projection: no shuffle, no UDF. Texts without a candidate pass unchanged. The key must be given and hold at least
``LEAST_KEY`` characters; who has it can take a pseudonym back (``inverse``).

Defined cases: a null text stays null and counts nothing; an empty text stays empty; what fails validation stays, and so does a
mailbox without letters and digits; repeated rows give repeated results; extra columns are not read; the columns of the
result are fixed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ipv6", "phone", "ip", "date", "ssn", "card", "hex")
_MONTHS = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: Core pattern, what may stand around it, and the formats for reading and for writing. A value may follow another one with a hyphen between.
_AFTER = r"(?:(?<![0-9-])|(?<=\G-))"
_END = rf"(?![0-9]|-[0-9]{{1,2}}(?![0-9A-Za-z./:@]| {_MONTHS}))"
_YMD, _DMY, _MDY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
_LONG_DMY, _LONG_MDY = rf"[0-9]{{1,2}} {_MONTHS} [0-9]{{4}}", rf"{_MONTHS} [0-9]{{1,2}}, [0-9]{{4}}"
DATES = {
    "ymd": (rf"{_AFTER}{_YMD}{_END}", "yyyy-MM-dd", "yyyy-MM-dd"),
    "dmy": (rf"(?<![0-9.]){_DMY}(?![0-9])", "d.M.yyyy", "dd.MM.yyyy"),
    "mdy": (rf"(?<![0-9/]){_MDY}(?![0-9/])", "M/d/yyyy", "MM/dd/yyyy"),
    "long_dmy": (rf"(?<![0-9]){_LONG_DMY}(?![0-9])", "d MMM yyyy", "d MMMM yyyy"),
    "long_mdy": (rf"(?<![A-Za-z]){_LONG_MDY}(?![0-9])", "MMM d, yyyy", "MMMM d, yyyy"),
}
#: Characters of a bank account number, by country.
ACCOUNT_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN_COUNTRIES = "|".join(c for group in ACCOUNT_SIZES.values() for c in group.split())


def _account(size: int, countries: str) -> str:
    fours, rest = divmod(size - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f"(?: ?[A-Z0-9]{{{rest}}})" if rest else "")


_TEN = r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
NATIONAL = rf"(?<![0-9+]){_TEN}"
_SSN, _IP = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"
#: What begins another value, so that a number in groups ends before it.
_OTHER = rf"{_YMD}(?![0-9])|{_DMY}(?![0-9])|{_MDY}(?![0-9])|{_LONG_DMY}(?![0-9])|{_IP}|{_SSN}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}(?![0-9])|[0-9]{{1,40}}[A-Za-z:]|[0-9A-Za-z._%+-]{{1,64}}@"
_SPACED, _HYPHENED = (rf"[0-9]{{4}}(?:{sep}[0-9]{{4}}){{3}}(?:(?:{sep}[0-9]{{4}}){{4}})*(?![0-9]|{sep}[0-9]{{4}}(?![0-9]))" for sep in " -")
_FOURS = rf"{_SPACED}|{_HYPHENED}|(?:[0-9]{{4}} [0-9]{{6}} [0-9]{{5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{5}}|[0-9]{{13,19}})(?![0-9])"
_RUN = r"[0-9]{{4}}(?:{0}[0-9]{{4}}){{3}}(?:{0}(?!{1})[0-9]{{4}}(?![0-9])){{0,20}}(?:{0}(?!{1})[0-9]{{3}}(?![0-9]))?"
#: Groups of four digits, of which some may be cards.
GROUPS = rf"(?:{_RUN.format(' ', f'{_OTHER}|{_TEN}|{_HYPHENED}')}|{_RUN.format('-', f'{_OTHER}|{_TEN}|{_SPACED}')})"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,24}(?![A-Za-z0-9._%+][A-Za-z0-9._%+-]{0,63}@|@)",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_account(*x) for x in ACCOUNT_SIZES.items())}|(?!{_KNOWN_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){1,7}(?::|(?::?[0-9a-fA-F]{1,4})(?::[0-9a-fA-F]{1,4}){0,6})(?![0-9A-Za-z:])",
    "phone": rf"\+[0-9](?:(?:(?<=\+[0-9]{{1,3}})[ .-]?\(|(?<=\([0-9]{{1,5}})\)[ .-]?|[ .-](?!{_OTHER})(?:(?<=\+[0-9]{{1,3}}[ .-])|(?!{_TEN}|{_FOURS})))?[0-9]){{7,14}}(?![0-9])|{NATIONAL}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "date": "|".join(p for p, _, _ in DATES.values()),
    "ssn": rf"{_AFTER}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "card": rf"(?<![0-9])(?:[0-9]{{13,19}}|{GROUPS}|[0-9]{{4}} [0-9]{{6}} [0-9]{{5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{5}})(?![0-9])",
    "hex": r"(?<![0-9a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9a-fA-F])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
ROUNDS = 8
LEAST_KEY = 16
_EPOCH = "1800-01-01"
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Longest mailbox that is permuted as one number: 62**10 fits in 63 bits.
_AS_NUMBER = 10


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stream(tweak: Column, k: int, other: Column) -> Column:
    return F.sha2(F.concat(tweak, F.lit(f"|{k}|"), other), 512)


def _add(half: Column, stream: Column, base: Column, sign: int) -> Column:
    """Digit by digit, half plus (or minus) the numbers of the stream, modulo base."""

    def digit(i: Column) -> Column:
        own = F.instr(F.lit(_DIGITS), F.substring(half, i, F.lit(1))) - 1
        other = F.conv(F.substring(stream, F.pmod(i * 3, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")
        return F.substring(F.lit(_DIGITS), F.pmod(own + sign * other, base).cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), digit), "")


def _rounds(state: Column, left, right, inverse: bool) -> Column:
    """The halves l and r after all rounds: left and right give the new half from (state, round)."""

    def step(k: int, s: Column) -> Column:
        if k % 2 == 0:
            return F.struct(left(s, k).alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), right(s, k).alias("r"))

    for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        state = _let(state, functools.partial(step, k))
    return state


def feistel(digits: Column, base: Column, tweak: Column, inverse: bool = False) -> Column:
    """A keyed permutation of the strings of a length of 2 or more over the first base characters of 0-9a-zA-Z."""
    sign = -1 if inverse else 1

    def halves(x: Column) -> Column:
        cut = (F.length(x) / 2).cast("int")
        return F.struct(F.substring(x, F.lit(1), cut).alias("l"), F.substring(x, cut + 1, F.length(x)).alias("r"))

    state = _rounds(_let(digits, halves), lambda s, k: _add(s["l"], _stream(tweak, k, s["r"]), base, sign), lambda s, k: _add(s["r"], _stream(tweak, k, s["l"]), base, sign), inverse)
    return _let(state, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(number: Column, a: Column, b: Column, tweak: Column, inverse: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    shift = lambda k, other: F.conv(F.substring(_stream(tweak, k, other.cast("string")), 1, 12), 16, 10).cast("bigint") * (-1 if inverse else 1)
    halves = lambda x: F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    state = _rounds(_let(number, halves), lambda s, k: F.pmod(s["l"] + shift(k, s["r"]), a), lambda s, k: F.pmod(s["r"] + shift(k, s["l"]), b), inverse)
    return _let(state, lambda s: s["l"] * b + s["r"])


def moved(digits: Column, base: Column, tweak: Column, inverse: bool = False) -> Column:
    """``feistel`` there and back around a step of the last digit: a permutation without a fixed string."""
    step = lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.substring(F.lit(_DIGITS), F.pmod(F.instr(F.lit(_DIGITS), F.right(x, F.lit(1))) - 1 + (-1 if inverse else 1), base) + 1, F.lit(1)))
    return feistel(_let(feistel(digits, base, tweak), step), base, tweak, True)


def moved_number(number: Column, a: Column, b: Column, tweak: Column, inverse: bool = False) -> Column:
    """``feistel_number`` there and back around a step of one: a permutation without a fixed number."""
    return feistel_number(F.pmod(feistel_number(number, a, b, tweak) + (-1 if inverse else 1), a * b), a, b, tweak, True)


def _to_number(letters: Column) -> Column:
    chars = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, c: acc * 62 + F.instr(F.lit(_DIGITS), c) - 1)


def _to_letters(number: Column, size: Column) -> Column:
    step = lambda acc, _: F.struct(F.call_function("div", acc["n"], F.lit(62).cast("bigint")).alias("n"), F.concat(F.substring(F.lit(_DIGITS), F.pmod(acc["n"], F.lit(62)).cast("int") + 1, F.lit(1)), acc["s"]).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), size), F.struct(number.alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def _refill(shape: Column, digits: Column, accepts: str) -> Column:
    """shape with its characters of the class replaced, in order, by those of digits."""
    step = lambda acc, c: F.struct((acc["n"] + F.when(c.rlike(accepts), 1).otherwise(0)).alias("n"), F.concat(acc["s"], F.when(c.rlike(accepts), F.substring(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("s"))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def _luhn(digits: Column, from_right: int) -> Column:
    """Luhn sum; from_right: 0 doubles every second digit from the last, 1 from the one before."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.pmod(n - i, F.lit(2)) == from_right
    term = lambda i: F.when(doubled(i), F.pmod(value(i) * 2, F.lit(10)) + F.when(value(i) >= 5, 1).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda x, y: x + y)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters, where A is 10 and Z is 35."""
    value = lambda c: F.instr(F.lit(_DIGITS), F.lower(c)) - 1
    step = lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _read(value: Column) -> Column:
    """What a candidate is: kind, what goes into the network beside the key (tweak), and either digits and their base or n below a * b.

    All is null if the candidate isn't valid.
    """

    def text(kind: str, digits: Column, base: int, tweak: Column | None = None) -> Column:
        return _parts(F.lit(kind), tweak, digits, F.lit(base), *[F.lit(None)] * 3)

    def number(kind: str, n: Column, a: Column | int, b: Column | int, tweak: Column | None = None) -> Column:
        return _parts(F.lit(kind), tweak, F.lit(None), F.lit(None), n, *(x if isinstance(x, Column) else F.lit(x) for x in (a, b)))

    def _parts(kind: Column, tweak: Column | None, digits: Column, base: Column, n: Column, a: Column, b: Column) -> Column:
        tweak = kind if tweak is None else F.concat(kind, F.lit("|"), tweak)
        return F.struct(kind.alias("kind"), tweak.alias("tweak"), digits.cast("string").alias("digits"), base.cast("int").alias("base"), *(x.cast("bigint").alias(c) for x, c in ((n, "n"), (a, "a"), (b, "b"))))

    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    letters, domain = F.regexp_replace(F.regexp_extract(value, "^([^@]*)@", 1), "[^0-9A-Za-z]", ""), F.lower(F.regexp_extract(value, "@(.*)$", 1))
    power, odd = F.pow(F.lit(62), F.floor(F.length(letters) / 2)).cast("bigint"), F.pmod(F.length(letters), F.lit(2)) == 1
    email = F.when(F.length(letters) <= _AS_NUMBER, number("email", _to_number(letters), F.when(odd, power * 2).otherwise(power), F.when(odd, power * 31).otherwise(power), domain))
    account = F.regexp_replace(value, " ", "")
    basic = F.regexp_replace(F.substring(account, F.lit(5), F.length(account)), "[^0-9]", "")
    account_ok = (_mod97(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))) == 1) & (F.length(basic) >= 2) & F.length(account).between(15, 34)
    six = F.regexp_replace(F.lower(value), "[^0-9a-f]", "")
    colons, short = F.length(value) - F.length(F.translate(value, ":", "")), F.instr(value, "::") > 0
    six_ok = ((~short & (colons == 7)) | (short & (colons <= 7) & (F.length(F.regexp_replace(value, "::", "")) == F.length(value) - 2))) & (F.length(six) >= 4) & value.rlike("[0-9]")
    known = _country(value)
    rest = F.regexp_replace(F.substring(value, F.length(known) + 1, F.length(value)), "[^0-9]", "")
    area, office, line = (F.substring(digits, a, n).try_cast("bigint") for a, n in ((1, 3), (4, 3), (7, 4)))
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("bigint"))
    day, plain = F.lit(None).cast("bigint"), F.regexp_replace(value, r"([A-Z][a-z]{2})[a-z]*", "$1")
    for pattern, form, _ in reversed(DATES.values()):
        day = F.when(whole(pattern), F.datediff(F.try_to_timestamp(plain, F.lit(form)).cast("date"), F.lit(_EPOCH).cast("date")).cast("bigint")).otherwise(day)
    group, pair, serial = (F.substring(digits, a, n).try_cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = (group >= 1) & (group <= 899) & (group != 666) & (pair >= 1) & (serial >= 1)
    return (
        F.when(whole(PATTERNS["email"]) & (F.length(letters) > 0), email.otherwise(text("email", letters, 62, domain)))
        .when(whole(PATTERNS["iban"]) & account_ok, text("iban", basic, 10, F.substring(account, 1, 2)))
        .when(whole(PATTERNS["ipv6"]) & six_ok, text("ipv6", six, 16))
        .when(whole(PATTERNS["phone"]) & value.startswith("+") & F.length(digits).between(8, 15), text("phone", rest, 10, known))
        .when(whole(NATIONAL) & (area >= 200) & (office >= 200), number("phone", ((area - 200) * 800 + office - 200) * 10_000 + line, 640_000, 10_000))
        .when(whole(PATTERNS["ip"]) & (F.array_max(octets) <= 255), number("ip", F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x), 65536, 65536))
        .when(whole(PATTERNS["date"]) & day.between(0, 146096), number("date", day, 209, 699))
        .when(whole(PATTERNS["ssn"]) & ssn_ok, number("ssn", ((group - 1 - F.when(group > 666, 1).otherwise(0)) * 99 + pair - 1) * 9999 + serial - 1, 898 * 99, 9999))
        .when(whole(PATTERNS["card"]) & (F.pmod(_luhn(digits, 1), F.lit(10)) == 0), text("card", F.substring(digits, F.lit(1), F.length(digits) - 1), 10))
        .when(whole(PATTERNS["hex"]) & value.rlike("[0-9]") & value.rlike("[a-fA-F]"), text("hex", F.lower(value), 16))
    )


def _country(phone: Column) -> Column:
    """The plus sign and the digits of an international number that stay."""
    return F.when(phone.rlike(r"^\+[0-9]{1,3}[ .(-]"), F.regexp_extract(phone, r"^(\+[0-9]{1,3})", 1)).when(phone.rlike(r"^\+[17]"), F.substring(phone, 1, 2)).otherwise(F.substring(phone, 1, 3))


def _write(value: Column, kind: Column, digits: Column, n: Column) -> Column:
    """The pseudonym in the format of value, from new digits or a new number."""
    cased = F.when(value.rlike("[A-F]"), F.upper(digits)).otherwise(digits)
    box = F.regexp_extract(value, "^([^@]*)@", 1)
    letters = F.coalesce(digits, _to_letters(n, F.length(F.regexp_replace(box, "[^0-9A-Za-z]", ""))))
    account = F.regexp_replace(value, " ", "")
    country = F.substring(account, 1, 2)
    with_check = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    iban = _refill(value, _let(_refill(F.substring(account, F.lit(5), F.length(account)), digits, "[0-9]"), with_check), "[0-9A-Z]")
    div = lambda x, y: F.call_function("div", x, F.lit(y).cast("bigint"))
    ten = F.format_string("%03d%03d%04d", div(n, 8_000_000) + 200, F.pmod(div(n, 10_000), F.lit(800)) + 200, F.pmod(n, F.lit(10_000)))
    known = _country(value)
    phone = F.when(digits.isNull(), _refill(value, ten, "[0-9]")).otherwise(F.concat(known, _refill(F.substring(value, F.length(known) + 1, F.length(value)), digits, "[0-9]")))
    date = F.lit(None).cast("string")
    for pattern, _, form in reversed(DATES.values()):
        date = F.when(value.rlike(f"^(?:{pattern})$"), F.date_format(F.date_add(F.lit(_EPOCH).cast("date"), n.cast("int")), form)).otherwise(date)
    area = div(n, 99 * 9999) + 1
    ssn = F.format_string("%03d-%02d-%04d", area + F.when(area >= 666, 1).otherwise(0), F.pmod(div(n, 9999), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1)
    card = F.concat(digits, F.pmod(10 - F.pmod(_luhn(digits, 0), F.lit(10)), F.lit(10)).cast("string"))
    return (
        F.when(kind == "email", F.concat(_refill(box, letters, "[0-9A-Za-z]"), F.lit("@"), F.regexp_extract(value, "@(.*)$", 1)))
        .when(kind == "iban", iban)
        .when(kind == "ipv6", _refill(value, cased, "[0-9a-fA-F]"))
        .when(kind == "phone", phone)
        .when(kind == "ip", F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
        .when(kind == "date", date)
        .when(kind == "ssn", ssn)
        .when(kind == "card", _refill(value, card, "[0-9]"))
        .when(kind == "hex", cased)
        .otherwise(value)
    )


def _pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """struct(kind, out): the pseudonym of one candidate; kind is null and out the value itself if it isn't valid."""

    def through(p: Column) -> Column:
        tweak = F.concat(F.lit(f"{key}|"), p["tweak"])
        digits = F.when(p["digits"].isNotNull(), moved(p["digits"], p["base"], tweak, inverse))
        return F.struct(p["kind"].alias("kind"), digits.alias("digits"), F.when(p["n"].isNotNull(), moved_number(p["n"], p["a"], p["b"], tweak, inverse)).alias("n"))

    return _let(_let(_read(value), through), lambda p: F.struct(p["kind"].alias("kind"), _write(value, p["kind"], p["digits"], p["n"]).alias("out")))


def _has_kind(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def _pieces(value: Column) -> Column:
    """What of a candidate is looked at: of a run of groups of four digits each four that are a card (or, at the end, five), and the groups between; else the candidate itself."""
    groups = F.split(value, "[ -]")

    def step(acc: Column, i: Column) -> Column:
        left = F.size(groups) - i
        digits = lambda n: F.array_join(F.slice(groups, i + 1, F.lit(n)), "")
        card = lambda n, size: (left >= n) & (F.length(digits(n)) == size) & (F.pmod(_luhn(digits(n), 1), F.lit(10)) == 0)
        taken = F.when(card(5, 19), 5).when(card(4, 16), 4).otherwise(1)
        new = F.struct((i + taken).alias("next"), F.concat(acc["s"], F.array(F.call_function("array_join", F.slice(groups, i + 1, taken), F.substring(value, 5, 1)))).alias("s"))
        return F.when(i < acc["next"], acc).otherwise(new)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("s"))
    run = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda acc: acc["s"])
    return F.when(value.rlike(f"^{GROUPS}$"), run).otherwise(F.array(value))


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", inverse: bool = False) -> DataFrame:
    """(key, text with pseudonyms, n_<kind> for each kind) for every row; inverse takes pseudonyms back."""
    if len(secret) < LEAST_KEY:
        raise ValueError(f"the key needs at least {LEAST_KEY} characters")
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    # all that can be valid has a digit, an @ or a colon pair; most texts have none
    rows = rows.withColumn("found", F.when(F.col("text").rlike("[0-9@]|::"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("pieces", F.when(F.size("found") > 0, F.transform("found", _pieces)))
    rows = rows.withColumn("new", F.transform("pieces", lambda v: F.transform(v, lambda piece: _pseudonym(piece, secret, inverse))))
    between = F.split("text", ANY, -1)
    written = F.zip_with("found", "new", lambda v, x: F.call_function("array_join", x["out"], F.substring(v, 5, 1)))  # only runs of groups have several pieces
    joined = F.array_join(F.zip_with(between, F.concat(written, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    counts = [F.when(F.col("new").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.flatten("new"), functools.partial(_has_kind, k)))).alias(f"n_{k}") for k in KINDS]
    return rows.select(key, F.when(F.col("new").isNull(), F.col("text")).otherwise(joined).alias("text"), *counts)
