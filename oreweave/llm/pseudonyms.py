"""Format-preserving pseudonyms for personal data, in Spark expressions only.

A value is found by pattern, validated, and permuted by a keyed Feistel network over its own
format, so equal values get equal pseudonyms in all documents and different ones stay different:

card      13 to 19 digits with a correct check digit, in whole groups of a run of digit groups; all
          but the last are permuted, that is set anew
phone     + country code and number: the last ten digits at most are permuted
ipv4      four numbers up to 255: permuted as 32 bits
ssn       nnn-nn-nnnn in the ranges that exist: permuted within them
iban      of its country's length, with correct check digits: digits after the country are permuted, check digits set anew
date      yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy that exist: another day of the same 400 years
email     a keyed digest as mailbox of the same reserved domain
secret    32 hexadecimal digits or more after token, secret, key or password: keyed digits

A domain of a * b values is a pair (left, right) to which rounds add keyed digests of the other
half, left modulo a and right modulo b: a permutation without rejected values. Numbers that do
not validate stay. The key is a secret of the caller.

Defined results: a null text stays null with no findings; text without findings is unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_names, query

ROUNDS = 8
WORD = r"\p{L}\p{N}"
#: Letters and digits in an IBAN of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _ibans(between: str = "") -> str:
    """Pattern of an IBAN of its country's length; `between` is looked for after a blank."""
    forms = []
    for length, lands in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        last = rf"(?: {between})?+[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{lands.replace(' ', '|')})\d{{2}}(?:(?: {between})?+[A-Z0-9]{{4}}){{{fours}}}{last}")
    return rf"(?:{'|'.join(forms)})(?![{WORD}])"


OTHER_IBAN = rf"(?!{_ibans()})"
IPV4 = rf"(?<![{WORD}.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![{WORD}]|\.\d)"
DATE = rf"(?<![{WORD}./-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}\.\d{{2}}\.\d{{4}}|\d{{2}}/\d{{2}}/\d{{4}})(?:(?=T\d)|(?![{WORD}/-]))"
SSN = rf"(?<![{WORD}-])\d{{3}}-\d{{2}}-\d{{4}}(?![{WORD}-])"
#: Numbers of their own that may stand behind a phone or card number.
OTHER = rf"{IPV4}|{DATE}|{SSN}"
CARD = r"^\d(?:[ -]?\d){12,18}$"
CARD_SHAPE = rf"(?:\d{{13,19}}|(?:\d{{4}}[ -]){{3}}\d{{1,7}}|(?:\d{{4}}[ -]){{4}}\d{{1,3}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}})(?![{WORD}])"
SIGNED = r"[ .()-]{0,3}\d"  # Java wants a look behind written out
PHONE = (
    rf"\+(?:1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?![{WORD}])"
    rf"|\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?(?!{OTHER})\d{{2,4}}){{1,4}}(?![{WORD}])(?<!\+{SIGNED * 16}{f'(?:{SIGNED})?' * 7}))"
)
#: Fixed formats, tried in this order at each place of a text. A card is looked for in whole runs of
#: digit groups, also behind a phone number.
FORMATS = {
    "email": rf"(?<![{WORD}._%+-])[{WORD}._%+-]++@(?:[{WORD}-]{{1,63}}\.){{1,8}}\p{{L}}{{2,24}}",
    "secret": r"(?<=(?i:token|secret|key|password)[ ]{0,2}[=:][ ]{0,2}[\"']?)[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "iban": rf"(?<![{WORD}])(?=[A-Z]{{2}}\d{{2}})(?:{_ibans(OTHER_IBAN)}|[A-Z]{{2}}\d{{2}}(?:(?: {OTHER_IBAN})?+[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{WORD}]))",
    "ipv4": IPV4,
    "date": DATE,
    "phone": rf"(?<![{WORD}+]){PHONE}(?:[ -](?!{OTHER})\d++(?![{WORD}]))*+",
    "ssn": SSN,
    "card": rf"(?<![{WORD}])(?=(?:[ -]?\d){{13}})(?!\d{{20}}\d*+(?![ -]\d))\d++(?![{WORD}])(?:[ -](?!{OTHER})\d++(?![{WORD}]))*+",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
#: One of these must be in a text that has a finding: a cheap first look.
HINT = r"[\d@]"
LEADS = {"email": "@", "phone": r"^\+", "ipv4": r"^\d{1,3}(\.\d{1,3}){3}$", "iban": r"^[A-Z]{2}\d{2}",
         "date": r"^(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$", "ssn": r"^\d{3}-\d{2}-\d{4}$",
         "card": r"^(?!\d{20,}$)\d[\d -]*$", "secret": r"^[0-9A-Fa-f]{32,}$"}


def _digest(key: str, *parts: Column) -> Column:
    """The first 60 bits of a keyed digest, as a number."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> tuple[Column, Column]:
    """The permuted pair; left is below a, right below b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(pair: Column, i: Column) -> Column:
        turn = i % 2 == 0
        moved = F.when(turn, (pair.l + _digest(key, F.lit(kind), i, pair.r) % a) % a)
        other = F.when(~turn, (pair.r + _digest(key, F.lit(kind), i, pair.l) % b) % b)
        return F.struct(F.coalesce(moved, pair.l).alias("l"), F.coalesce(other, pair.r).alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return done.l, done.r


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _power(width: Column) -> Column:
    """Ten to a power of up to 18, as a long."""
    return F.rpad(F.lit("1"), width + 1, F.lit("0")).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits permuted among those of the same number, up to 36."""

    def run(parts: Column) -> Column:
        moved = feistel(parts.l.cast("long"), parts.r.cast("long"), _power(F.length(parts.l)), _power(F.length(parts.r)), key, kind)
        pair = F.struct(moved[0].alias("l"), moved[1].alias("r"))
        return _let(pair, lambda m: F.concat(_padded(m.l, F.length(parts.l)), _padded(m.r, F.length(parts.r))))

    half = F.floor(F.length(digits) / 2).cast("int")
    return _let(F.struct(F.substring(digits, F.lit(1), half).alias("l"), F.substring(digits, half + 1, F.length(digits)).alias("r")), run)


def _refilled(shape: Column, digits: Column) -> Column:
    """A text with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, char: Column) -> Column:
        is_digit = char.rlike("^[0-9]$")
        new = F.when(is_digit, F.substring(digits, state.at, F.lit(1))).otherwise(char)
        return F.struct(F.concat(state.out, new).alias("out"), (state.at + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s.out)


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled, starting with the last but one."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * digit).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    def checked(digits: Column) -> Column:
        payload = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        closed = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _refilled(value, closed)).otherwise(value)

    return _let(_digits(value), checked)


def _cards(run: Column, key: str) -> Column:
    """A run of digit groups with its cards replaced (new), and their number (n).

    A card is a sequence of whole groups with 13 to 19 digits and a correct check digit. From left
    to right the shortest goes; one of unusual grouping only where none of the usual ones starts in it.
    """

    def replaced(parts: Column) -> Column:
        count = ((F.size(parts) + 1) / 2).cast("int")  # groups stand at even places, signs between them

        def text(start: Column, end: Column) -> Column:
            return F.array_join(F.slice(parts, 2 * start + 1, 2 * (end - start) + 1), "")

        def ends(start: Column) -> Column:
            def holds(digits: Column) -> Column:
                return F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(False)

            near = F.sequence(start, F.least(start + 18, count - 1))
            return F.filter(near, lambda end: text(start, end).rlike(CARD) & _let(_digits(text(start, end)), holds))

        def found(start: Column) -> Column:
            def pick(valid: Column) -> Column:
                usual = F.filter(valid, lambda end: text(start, end).rlike(f"^{CARD_SHAPE}$"))
                return F.struct(F.get(usual, F.lit(0)).alias("usual"), F.get(valid, F.lit(0)).alias("any"))

            return _let(ends(start), pick)

        def walk(cards: Column) -> Column:
            def step(state: Column, start: Column) -> Column:
                card = F.get(cards, start)
                free = F.when(
                    card["any"].isNotNull(), F.forall(F.sequence(start + 1, F.greatest(card["any"], start + 1)), lambda k: F.get(cards, k)["usual"].isNull())
                )
                end = F.coalesce(card["usual"], F.when(free, card["any"]))

                def go(end: Column) -> Column:
                    new = F.when(end.isNull(), F.get(parts, 2 * start)).otherwise(_card(text(start, end), key))
                    last = F.coalesce(end, start)
                    out = F.concat(state.out, new, F.coalesce(F.get(parts, 2 * last + 1), F.lit("")))
                    return F.struct(out.alias("out"), (last + 1).alias("at"), (state.n + end.isNotNull().cast("int")).alias("n"))

                return F.when(start < state.at, state).otherwise(_let(end, go))

            begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"))
            return F.aggregate(F.sequence(F.lit(0), count - 1), begin, step, lambda s: F.struct(s.out.alias("new"), s.n.alias("n")))

        return _let(F.transform(F.sequence(F.lit(0), count - 1), found), walk)

    return _let(F.regexp_extract_all(run, F.lit(r"\d+|\D+"), F.lit(0)), replaced)


def _phone(value: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        kept = F.greatest(F.length(digits) - 10, F.lit(2))
        kept = F.when(F.length(digits) > 10, F.length(digits) - 10).otherwise(kept).cast("int")
        rest = permuted_digits(F.substring(digits, kept + 1, F.length(digits)), key, "phone")
        new = _refilled(value, F.concat(F.substring(digits, F.lit(1), kept), rest))
        return F.when(F.length(digits).between(8, 15), new).otherwise(value)

    return _let(_digits(value), moved)


def _phones(run: Column, key: str) -> Column:
    """A phone number and the digit groups behind it, replaced (new), and the number of replaced values (n).

    The number ends before the first card of usual grouping, else where its own format does.
    """

    def cut(parts: Column) -> Column:  # a sign, then groups at odd places
        def card_at(k: Column) -> Column:
            def valid(text: Column) -> Column:
                return F.when(text.rlike(f"^{CARD_SHAPE}$"), luhn_sum(_digits(text)) % 10 == 0).otherwise(False)

            return F.exists(F.sequence(F.lit(1), F.lit(5)), lambda n: _let(F.array_join(F.slice(parts, 2 * k + 2, 2 * n - 1), ""), valid))

        starts = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda k: (2 * k + 1 < F.size(parts)) & card_at(k))
        heads = F.transform(starts, lambda k: F.array_join(F.slice(parts, F.lit(1), 2 * k), ""))
        whole = F.filter(heads, lambda h: F.length(_digits(h)).between(8, 15))
        head = F.coalesce(F.get(whole, F.lit(0)), F.get(heads, F.lit(0)), F.regexp_extract(run, f"^{PHONE}", 0))
        return _let(head, split)

    def split(head: Column) -> Column:
        def joined(rest: Column) -> Column:
            lead = F.regexp_extract(rest, r"^\D*", 0)
            behind = F.substring(rest, F.length(lead) + 1, F.length(rest))
            cards = F.when(behind != "", _cards(behind, key)).otherwise(F.struct(F.lit("").alias("new"), F.lit(0).alias("n")))
            both = F.struct(_phone(head, key).alias("phone"), cards.alias("cards"))
            return _let(both, lambda b: F.struct(F.concat(b.phone, lead, b.cards["new"]).alias("new"), (b.cards["n"] + (b.phone != head).cast("int")).alias("n")))

        return _let(F.substring(run, F.length(head) + 1, F.length(run)), joined)

    return _let(F.regexp_extract_all(run, F.lit(r"\d+|\D+"), F.lit(0)), cut)


def _ipv4(value: Column, key: str) -> Column:
    def moved(parts: Column) -> Column:
        high, low = parts[0] * 256 + parts[1], parts[2] * 256 + parts[3]
        pair = feistel(high, low, F.lit(65536), F.lit(65536), key, "ipv4")
        text = _let(
            F.struct(pair[0].alias("h"), pair[1].alias("w")),
            lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p.h / 256), p.h % 256, F.floor(p.w / 256), p.w % 256)]),
        )
        return F.when(F.forall(parts, lambda x: x <= 255), text).otherwise(value)

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), moved)


def _ssn(value: Column, key: str) -> Column:
    def moved(parts: Column) -> Column:
        area, group, serial = parts[0], parts[1], parts[2]
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        rank = area - F.when(area > 666, 2).otherwise(1)
        pair = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

        def text(p: Column) -> Column:
            rank = F.floor(p.a / 99)
            area = rank + F.when(rank >= 665, 2).otherwise(1)
            return F.concat_ws("-", _padded(area, F.lit(3)), _padded(p.a % 99 + 1, F.lit(2)), _padded(p.s + 1, F.lit(4)))

        return F.when(valid, _let(F.struct(pair[0].alias("a"), pair[1].alias("s")), text)).otherwise(value)

    return _let(F.transform(F.split(value, "-"), lambda x: x.cast("long")), moved)


def _iban(value: Column, key: str) -> Column:
    def remainder(text: Column) -> Column:
        def add(total: Column, char: Column) -> Column:
            number = F.when(char.rlike("^[0-9]$"), char.cast("int")).otherwise(F.ascii(char) - 55)
            return F.when(number > 9, total * 100 + number).otherwise(total * 10 + number) % 97

        return F.aggregate(F.split(text, ""), F.lit(0), add)

    def moved(plain: Column) -> Column:
        head, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        valid = remainder(F.concat(body, F.substring(plain, 1, 4))) == 1
        new = _refilled(body, permuted_digits(_digits(body), key, "iban"))
        closed = _let(new, lambda b: F.concat(_padded(98 - remainder(F.concat(b, head, F.lit("00"))), F.lit(2)), _digits(b)))
        return F.when(valid & (F.length(plain) >= 15) & (F.length(_digits(body)) >= 2), _refilled(value, closed)).otherwise(value)

    return _let(F.regexp_replace(value, " ", ""), moved)


def _date(value: Column, key: str) -> Column:
    def moved(form: Column) -> Column:
        day = F.coalesce(*[F.to_date(F.try_to_timestamp(value, F.lit(f))) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")])
        number = F.datediff(day, F.lit("1800-01-01").cast("date"))
        cycle = F.floor(number / 146097)
        place = number - cycle * 146097
        pair = feistel(F.floor(place / 773), place % 773, F.lit(189), F.lit(773), key, "date")
        new = F.date_add(F.lit("1800-01-01").cast("date"), (cycle * 146097 + pair[0] * 773 + pair[1]).cast("int"))
        text = F.when(form == "-", F.date_format(new, "yyyy-MM-dd")).when(form == ".", F.date_format(new, "dd.MM.yyyy"))
        return F.coalesce(text.otherwise(F.date_format(new, "MM/dd/yyyy")), value)

    return _let(F.regexp_extract(value, r"[-./]", 0), moved)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lower(value), F.lit(key)), 256), 1, 20), F.lit("@mail.invalid"))


def _secret(value: Column, key: str) -> Column:
    new = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lower(value), F.lit(key)), 512), F.lit(1), F.length(value))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


PSEUDONYM = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "iban": _iban, "secret": _secret}
RUNS = {"phone": _phones, "card": _cards}  # one found text may hold several values


def pseudonym(value: Column, key: str) -> Column:
    """What stands for a found value (new), itself if it does not validate, and the number of replaced ones in it (n)."""
    out = None
    for kind in ("email", "phone", "ipv4", "date", "ssn", "card", "secret", "iban"):
        found = value.rlike(LEADS[kind])
        if kind in RUNS:
            new = RUNS[kind](value, key)
        else:
            new = _let(PSEUDONYM[kind](value, key), lambda v: F.struct(v.alias("new"), (v != value).cast("int").alias("n")))
        out = F.when(found, new) if out is None else out.when(found, new)
    return out.otherwise(F.struct(value.alias("new"), F.lit(0).alias("n")))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """All rows and columns with `text` rewritten; `count` names a column of replaced values."""
    found, gaps, both = free_names(docs, "_found", "_gaps", "_pairs")
    some = F.col(text).rlike(HINT)
    out = docs.withColumn(found, F.when(some, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    has = F.coalesce(F.size(found) > 0, F.lit(False))
    out = out.withColumn(gaps, F.when(has, F.split(F.col(text), PATTERN, -1)))
    out = out.withColumn(both, F.when(has, F.transform(found, lambda v: pseudonym(v, key))))
    joined = F.array_join(F.zip_with(gaps, both, lambda g, p: F.concat(g, F.coalesce(p["new"], F.lit("")))), "")
    changed = F.aggregate(both, F.lit(0), lambda total, p: total + p["n"])
    out = out.withColumn(gaps, F.when(has, joined))
    if count:
        out = out.withColumn(count, F.when(has, changed).otherwise(0).cast("long"))
    return out.withColumn(text, F.coalesce(gaps, text)).drop(found, gaps, both)


#: For the registered query only; a real run passes its own secret.
DEMO_KEY = "registered-query-key"


@query("op2_pseudonyms")
def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY, count="n_replaced")
