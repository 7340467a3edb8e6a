"""PII: format-preserving Feistel pseudonyms for validated numbers and dates.

Native: DataFrame and SQL functions only.

One pattern finds candidates of all kinds; each is validated by its own rule (Luhn, IBAN's modulo
97, number ranges, the calendar).  A valid value is permuted with a key within its format, so equal
values get equal pseudonyms in every document, different values different ones, and separators,
lengths and check digits stay right.  Two Feistel networks do it:

* over characters: halves of a value shift each other, digit by digit modulo 10 and letter by
  letter modulo 26, by a stream from one SHA-512 a round, of key, round and the other half;
* over a number range a * b (dates, social security numbers, addresses): a number is a pair (L, R)
  with L below a and R below b, which shift each other modulo a and b.

Kinds, in the order in which they are tried:

====== =============================================== =========================================
kind   valid if                                        permuted
====== =============================================== =========================================
email  local part of 64 characters at most, domain of  letters and digits of the local part
       2 to 127 labels
iban   modulo 97 is 1                                  characters after the check digits, which
                                                       are computed anew
ip     four octets to 255                              the 32-bit number
ssn    area not 000, 666, 9xx; no part all zero        the rank among valid numbers
date   a day of 1900 to 2099 (ISO; month first with /, the day's rank
       day first with .)
phone  ten digits, country code apart                  the ten digits
card   13 to 19 digits, Luhn                           all digits but the last, which is
                                                       computed anew
====== =============================================== =========================================

Numbers of tokens (IBAN, card) may have other digits or capitals beside them, so the pattern takes
the whole run of tokens and every part of it, from token to token, is validated.  Where valid parts
overlap, IBANs of their country's length come first, then cards in usual groups, social security
numbers and dates, then other IBANs and phones, then other cards; of one rank the longest, then the
first.  A run is settled STRETCH tokens at a time: of parts that overlap where one stretch ends, the
one that begins in the earlier stretch goes first.  Everything here is linear in the text: quantifiers
are bounded or possessive, so that no text, however long, exhausts the stack.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import fresh

#: Set a key of your own: this one is public, and keys are visible in query plans.
KEY = os.environ.get("FLOCKLINE_PII_KEY", "flockline-demo-key")
CHAR_ROUNDS, RANGE_ROUNDS = 8, 10
LONGEST = 64  # characters that feistel_chars takes
STRETCH = 256
LENGTHS = 10, 43  # of a valid part of a run: a date has the fewest characters, a spaced IBAN the most

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
}
# runs of tokens that may hold an IBAN or a card; a token is not the begin of an address or a dotted number
_TOKEN = rf"(?![\w.%+-]{{1,64}}+@|{_OCTET}(?:\.{_OCTET}){{3}}|\d{{2}}[./]\d{{2}}[./]\d{{4}}|\d{{3}}\.\d{{3}}[ .-]\d{{4}})"
_CAPITALS = rf"{_TOKEN}[A-Z0-9]++(?![a-z])"
_DIGITS = rf"{_TOKEN}\d{{1,19}}+(?!\w|\.\d|-(?!\d))"
RUNS = {
    "iban": rf"(?=[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{8}})(?<![A-Za-z0-9]){_CAPITALS}(?:[ -]{_CAPITALS})*+",
    "card": rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_DIGITS}(?:[ -]{_DIGITS})*+",
}
# most characters begin no candidate: the looks ahead come before the looks behind
NUMBERS = f"{RUNS['iban']}|(?=[0-9+(])(?:{'|'.join((PATTERNS | RUNS)[k] for k in ('ip', 'ssn', 'date', 'phone', 'card'))})"
PATTERN = f"{PATTERNS['email']}|{NUMBERS}"
PIECES = "array<struct<text:string,number:boolean>>"
WIDEST = 19  # tokens of a card of single digits
USUAL_CARD = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1(?:\d|\d{4}(?:\1\d{1,3})?)|\d{4}([ -])\d{6}\2\d{4,5})$"
IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"

AREAS, SERIALS = 898, 99 * 9999  # social security numbers: 001-899 but 666; group 01-99, serial 0001-9999
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days, to 2099-12-31


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _number(hex_: Column) -> Column:
    return F.conv(hex_, 16, 10).cast("long")


def _shifted(half: Column, other: Column, key: str, round_: Column) -> Column:
    """Each letter and digit of an array of characters moved on in its class; the rest stays."""
    # 128 hexadecimal digits, four for each of 32 characters
    digest = F.sha2(F.concat_ws("|", F.lit(key), round_.cast("string"), F.array_join(other, "")), 512)

    def moved(h: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            code, step = F.ascii(c), _number(F.substr(h, 4 * i + 1, F.lit(4)))
            turn = lambda low, size: F.char((F.lit(low) + (code - low + step) % size).cast("long"))
            return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).otherwise(c)

        return F.transform(half, move)

    return F.get(F.transform(F.array(digest), moved), F.lit(0))  # hashed once a round


def feistel_chars(chars: Column, key: str) -> Column:
    """A permutation of arrays of one layout of classes: lower-case, upper-case, digit, other.

    Of LONGEST characters at most.

    The halves keep their places, so their layouts need not be alike: each round shifts one half
    by a stream from the other.
    """
    n = F.size(chars)
    cut = (n / 2).cast("int")
    state = F.struct(F.slice(chars, 1, cut).alias("l"), F.slice(chars, cut + 1, n - cut).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, _shifted(s["l"], s["r"], key, i)).otherwise(s["l"])
        right = F.when(i % 2 == 1, _shifted(s["r"], s["l"], key, i)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(CHAR_ROUNDS)), state, step, lambda s: F.concat(s["l"], s["r"]))


def feistel_range(number: Column, a: int, b: int, key: str) -> Column:
    """A permutation of 0 .. a * b - 1."""
    stream = lambda x, i: _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), x.cast("string")), 256), 1, 12))
    n = number.cast("long")
    state = F.struct(F.floor(n / b).cast("long").alias("l"), (n % b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (s["l"] + stream(s["r"], i)) % a).otherwise(s["l"])
        right = F.when(i % 2 == 1, (s["r"] + stream(s["l"], i)) % b).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(RANGE_ROUNDS)), state, step, lambda s: s["l"] * b + s["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(value: Column, chars: Column, class_: str) -> Column:
    """value with its characters of a class replaced, in order, by those of an array."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        inside = c.rlike(class_)
        return F.struct(F.concat(s["out"], F.when(inside, F.get(chars, s["at"] - 1)).otherwise(c)).alias("out"), (s["at"] + inside.cast("int")).alias("at"))

    return F.aggregate(_chars(value), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one counting once."""
    places = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(places, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, A standing for 10."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0), lambda s, c: ((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(F.when(c.rlike("[0-9A-Z]"), c).otherwise(F.lit("0")))) % 97).cast("int"))


def iban_valid(flat: Column) -> Column:
    return mod97(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))) == 1


def _rank(part: Column) -> Column:
    """The rank of a part of a run that is a valid number, null for others."""
    flat, digits = F.regexp_replace(part, " ", ""), _digits(part)
    own = F.array_contains(F.split(F.lit(IBAN_LENGTHS), " "), F.concat(F.substring(flat, 1, 2), F.length(flat).cast("string")))
    shaped = part.rlike(r"^(?:(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}|(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))$")
    iban = F.when(iban_valid(flat), F.when(own, 0).otherwise(2))
    card = F.when(luhn_sum(digits) % 10 == 0, F.when(part.rlike(USUAL_CARD), 1).otherwise(3))
    return F.when(part.rlike(f"^(?:{PATTERNS['iban']})$"), iban).when(shaped, 1).when(part.rlike(f"^(?:{PATTERNS['phone']})$"), 2).when(part.rlike("^[0-9 -]+$") & F.length(digits).between(13, 19), card)


def split_run(m: Column) -> Column:
    """A run of tokens as pieces (text, number): the valid numbers in it, and what lies between."""
    start = F.struct(F.regexp_extract_all(m, F.lit("[A-Z0-9]+|[ -]"), F.lit(0)).alias("bits"))  # tokens and separators in turn

    def settled(_: Column, s: Column) -> Column:
        bits = s["bits"]
        last = ((F.size(bits) - 1) / 2).cast("int")
        # slice() would copy the whole run each time
        cut = lambda a, b: F.transform(F.sequence(a, b), lambda x: F.get(bits, x))
        text = lambda i, j: F.array_join(cut(2 * i, 2 * j), "")

        def parts_from(i: Column) -> Column:
            named = F.transform(F.sequence(i, F.least(i + (WIDEST - 1), last)), lambda j: F.struct(j.alias("j"), text(i, j).alias("text")))
            named = F.filter(named, lambda p: F.length(p["text"]).between(*LENGTHS))
            ranked = F.transform(named, lambda p: F.struct(_rank(p["text"]).alias("rank"), (-F.length(p["text"])).alias("size"), i.alias("i"), p["j"].alias("j"), p["text"].alias("text")))
            return F.filter(ranked, lambda p: p["rank"].isNotNull())

        def stretch(state: Column, k: Column) -> Column:
            begin, end = k * STRETCH, F.least((k + 1) * STRETCH - 1, last)
            parts = F.filter(F.flatten(F.transform(F.sequence(begin, end), parts_from)), lambda p: p["i"] > state["until"])
            none = F.filter(parts, lambda p: F.lit(False))
            apart = lambda held, p: ~F.exists(held, lambda h: (h["i"] <= p["j"]) & (p["i"] <= h["j"]))
            taken = F.aggregate(F.array_sort(parts), none, lambda held, p: F.when(apart(held, p), F.concat(held, F.array(p))).otherwise(held))
            here = cut(2 * begin, F.least(2 * end + 1, 2 * last))  # the tokens of the stretch and what follows each
            return F.get(F.transform(F.array(F.struct(taken.alias("taken"))), lambda t: F.struct(
                F.greatest(state["until"], F.array_max(F.transform(t["taken"], lambda p: p["j"]))).alias("until"),
                F.concat(state["pieces"], pieces(here, 2 * begin, state["until"], t["taken"])).alias("pieces"),
            )), F.lit(0))

        state = F.struct(F.lit(-1).alias("until"), F.array().cast(PIECES).alias("pieces"))
        return F.aggregate(F.sequence(F.lit(0), (last / STRETCH).cast("int")), state, stretch, lambda x: x["pieces"])

    def pieces(here: Column, offset: Column, until: Column, taken: Column) -> Column:
        def piece(bit: Column, n: Column) -> Column:
            at = n + offset
            first = F.get(F.filter(taken, lambda p: (2 * p["i"] <= at) & (at <= 2 * p["j"])), F.lit(0))
            plain = F.struct(bit.alias("text"), F.lit(False).alias("number"))
            return F.when(at <= 2 * until, None).when(first.isNull(), plain).when(2 * first["i"] == at, F.struct(first["text"].alias("text"), F.lit(True).alias("number")))

        return F.filter(F.transform(here, piece), lambda x: x.isNotNull())

    return F.aggregate(F.array(start), F.array().cast(PIECES), settled)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(F.array_join(feistel_chars(_chars(local), f"{key}|email"), ""), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: str) -> Column:
    flat = F.regexp_replace(m, " ", "")
    country, body = F.substring(flat, 1, 2), F.array_join(feistel_chars(_chars(F.substring(flat, 5, 40)), f"{key}|iban"), "")
    check = F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(iban_valid(flat), _refill(m, _chars(F.concat(country, check, body)), "[A-Z0-9]")).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    n = feistel_range(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), 65536, 65536, f"{key}|ip")
    start = F.struct(n.alias("n"))  # named once: the network runs once
    return F.aggregate(F.array(start), F.lit(""), lambda _, s: F.concat_ws(".", *[(F.shiftright(s["n"], k) % 256).cast("string") for k in (24, 16, 8, 0)]))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = (area - 1 - (area > 666).cast("long")) * SERIALS + (group - 1) * 9999 + serial - 1

    def shown(_: Column, s: Column) -> Column:
        a = F.floor(s["n"] / SERIALS).cast("long") + 1
        a = a + (a >= 666).cast("long")
        g = F.floor((s["n"] % SERIALS) / 9999).cast("long") + 1
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in ((a, 3), (g, 2), (s["n"] % 9999 + 1, 4))])

    # SERIALS is a multiple of 9999, so n % 9999 is the serial's rank
    return F.when(valid, F.aggregate(F.array(F.struct(feistel_range(rank, AREAS, SERIALS, f"{key}|ssn").alias("n"))), F.lit(""), shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    out = m
    for shape, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d/", "MM/dd/yyyy"), (r"^\d\d\.", "dd.MM.yyyy")):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        rank = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_range(F.greatest(rank, F.lit(0)), *DAYS, f"{key}|date").cast("int")), form)
        fits = m.rlike(shape) & day.isNotNull() & rank.between(0, DAYS[0] * DAYS[1] - 1)
        out = F.when(fits, new).otherwise(out)
    return out


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    ten = feistel_chars(_chars(F.right(digits, F.lit(10))), f"{key}|phone")
    return _refill(m, F.concat(_chars(F.left(digits, F.length(digits) - 10)), ten), r"\d")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.array_join(feistel_chars(_chars(F.left(digits, F.length(digits) - 1)), f"{key}|card"), "")
    made = F.aggregate(F.array(body), F.lit(""), lambda _, b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, _refill(m, _chars(made), r"\d")).otherwise(m)


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def kind(m: Column) -> Column:
    out = F.lit("card")
    for name in reversed([k for k in PATTERNS if k != "card"]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one candidate; a candidate that is not valid stays as it is."""
    named = F.struct(m.alias("m"), kind(m).alias("k"))

    def made(_: Column, s: Column) -> Column:
        out = s["m"]
        for name, maker in MAKERS.items():
            out = F.when(s["k"] == name, maker(s["m"], key)).otherwise(out)
        return out

    return F.aggregate(F.array(named), F.lit(""), made)


def replaced(docs: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """docs with the valid values in `text` replaced; `names` are those of the two counts."""
    parts, made = fresh(docs, "parts"), fresh(docs, "made")
    text = F.col("text").cast("string")
    at, numbers = text.contains("@"), text.rlike("[0-9]")
    # without an @ there is no address, and without a digit no number: their patterns aren't tried
    by = lambda use: F.when(at, use(PATTERN)).when(numbers, use(NUMBERS))
    split = lambda m: F.when(kind(m).isin(*RUNS), split_run(m)).otherwise(F.array(F.struct(m.alias("text"), F.lit(True).alias("number"))))
    show = lambda x: F.struct(F.when(x["number"], pseudonym(x["text"], key)).otherwise(x["text"]).alias("made"), x["text"].alias("text"), x["number"].alias("number"))
    out = docs.withColumn(parts, F.transform(by(lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))), split))
    any_ = F.coalesce(F.size(parts), F.lit(0)) > 0
    out = out.withColumn(made, F.when(any_, F.transform(parts, lambda xs: F.transform(xs, show))))
    # between the matches lie the pieces of the text: piece 0, match 0, piece 1, ...
    filled = lambda i: F.array_join(F.transform(F.get(F.col(made), i), lambda x: x["made"]), "")
    joined = F.array_join(F.transform(by(lambda p: F.split(text, p, -1)), lambda p, i: F.concat(p, F.coalesce(filled(i), F.lit("")))), "")
    out = out.withColumn("text", F.when(any_, joined).otherwise(F.col("text")))
    count = lambda which: F.aggregate(F.coalesce(F.col(made), F.array()), F.lit(0).cast("long"), which)
    number = count(lambda n, xs: n + F.greatest(F.lit(1), F.size(F.filter(xs, lambda x: x["number"]))).cast("long"))
    changed = count(lambda n, xs: n + F.size(F.filter(xs, lambda x: x["made"] != x["text"])).cast("long"))
    return out.withColumn(names[0], number).withColumn(names[1], changed).drop(parts, made)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with the valid values in `text` replaced; columns n_found and n_replaced are added.

    Defined cases: null text stays null with counts 0; empty text stays empty; n_found counts
    the candidates, of a run the valid ones or one; local parts of over 64 characters and domains
    of over 127 labels are no addresses and stay; a column that is named n_found or n_replaced is
    replaced; all other columns, whatever their names, and repeated rows stay as they are; an
    empty table gives an empty result.
    """
    return replaced(docs, key, ("n_found", "n_replaced"))
