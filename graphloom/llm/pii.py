"""Format-preserving pseudonyms of personal values by a keyed Feistel network (operator 1). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import bind

# Patterns of the formats, each standing alone between characters that could continue it.
# Every repeated group is possessive or has a greatest count: the engine walks those in a loop, and would recurse otherwise.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
KEY_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SETTING = r"(?<![A-Za-z])(?=[PpSsTtAa])(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?)"
SECRET = SETTING + r"[^\s\"',;]{6,}+"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
_SIZED = "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: A known country's length where the run has it; else the run up to where such a number begins.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d\d)(?:{_SIZED}|[A-Z]{{2}}\d{{2}}(?:(?: (?!{_SIZED}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)"
PHONE = r"(?<![\d+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,}+"
#: In order of precedence where several match at one place.
FORMATS = {"email": EMAIL, "key": KEY_ID, "secret": SECRET, "ip": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "iban": IBAN}
ANY = "|".join(FORMATS.values())
#: Texts without any of these hold no value of any format.
HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key)"

DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "abcdef"
ROUNDS = 8
#: Signs that are permuted together; longer values are permuted in blocks of so many.
BLOCK = 4096
#: Stands around the values of a text while it is taken apart.
MARK = "\x01"
#: Further permutations of a card number beside other digits, at most: one in ten or so needs any. A number that needed more
#: would be hidden but not come back.
WALK = 10_000
#: The Gregorian calendar repeats every 146,097 days, which is 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def feistel(values: Column, sizes: Column, key: Column, inverse: bool = False) -> Column:
    """A keyed permutation of the arrays whose i-th number lies in 0 to sizes[i] - 1.

    In each round one half is shifted, number by number, by 32 bits each of hashes of the key, the round and the other
    half; a shift modulo each size can be taken back, so different arrays stay different. Arrays need two numbers at least.
    """
    half = F.floor((F.size(values) + 1) / 2).cast("int")
    return bind(values.cast("array<bigint>"), lambda v: bind(sizes, lambda z: bind(half, lambda h: _rounds(v, z, h, key, inverse))))


def _rounds(values: Column, sizes: Column, half: Column, key: Column, inverse: bool) -> Column:
    numbers = F.sequence(F.lit(0), F.floor(F.size(values) / 16))

    def one(state: Column, r: Column) -> Column:
        first = r % 2 == 0  # shift the first half by the second, then the other way round
        other = F.when(first, F.slice(state, half + 1, F.greatest(F.size(state) - half, F.lit(0)))).otherwise(F.slice(state, F.lit(1), half))
        seed = F.sha2(F.concat_ws("|", key, r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)
        hashes = bind(seed, lambda s: F.transform(numbers, lambda b: F.sha2(F.concat_ws("|", s, b.cast("string")), 512)))

        def shifted(found: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                bits = F.substring(F.element_at(found, F.floor(i / 16).cast("int") + 1), 8 * (i % 16) + 1, F.lit(8))
                by = F.conv(bits, 16, 10).cast("long")
                return F.when((i < half) == first, F.pmod(x - by if inverse else x + by, F.element_at(sizes, i + 1))).otherwise(x)

            return F.transform(state, step)

        return bind(hashes, shifted)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, values, one)


def _signs(text: Column, key: Column, inverse: bool, hex_only: bool | Column = False) -> Column:
    """text with digits, capital and small ASCII letters permuted each within their kind; other signs stay.

    A text of over BLOCK signs is permuted block by block, each under its place and the text's length.
    """
    letters = F.when(F.lit(hex_only) if isinstance(hex_only, bool) else hex_only, F.lit(HEX)).otherwise(F.lit(LOWER))

    def of(signs: Column, key: Column = key) -> Column:
        sets = F.transform(signs, lambda c: F.when(c.between("0", "9"), F.lit(DIGITS)).when(c.between("A", "Z"), F.lit(UPPER)).when(c.between("a", "z"), letters).otherwise(c))
        return bind(sets, lambda s: bind(feistel(F.zip_with(signs, s, lambda c, a: F.instr(a, c) - 1), F.transform(s, F.length), key, inverse), lambda v: F.array_join(F.zip_with(v, s, lambda x, a: F.substring(a, (x + 1).cast("int"), F.lit(1))), "")))

    part = lambda x, b: bind(F.split(x, ""), lambda signs: of(signs, F.concat_ws("|", key, b.cast("string"), F.length(text).cast("string"))))
    blocks = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), part)
    return F.when(F.length(text) > BLOCK, F.array_join(blocks, "")).otherwise(bind(F.split(text, ""), of))


def _into(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of the string digits."""

    def filled(d: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            number = c.between("0", "9")
            sign = F.when(number, F.substring(d, a["n"] + 1, F.lit(1))).otherwise(c)
            return F.struct(F.concat(a["out"], sign).alias("out"), (a["n"] + number.cast("int")).alias("n"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]

    return bind(digits, filled)


def _luhn(digits: Column, times_two_at: int) -> Column:
    """The Luhn sum; digits at an even distance + times_two_at from the right are doubled."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == times_two_at, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    number = F.transform(F.split(text, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _email(m: Column, key: Column, inverse: bool) -> Column:
    """The name, and apart from it the domain but for its last label: equal domains stay equal under different names."""

    def of(at: Column) -> Column:
        domain = F.substring(m, at + 1, F.length(m))
        last = F.length(F.substring_index(domain, ".", -1)) + 1  # with its dot
        hidden = _signs(F.substring(domain, F.lit(1), F.length(domain) - last), F.concat(key, F.lit("|domain")), inverse)
        return F.concat(_signs(F.substring(m, F.lit(1), at - 1), key, inverse), F.lit("@"), hidden, F.substring(m, F.length(m) - last + 1, last))

    return bind(F.instr(m, "@"), of)


def _secret(m: Column, key: Column, inverse: bool) -> Column:
    value = F.regexp_replace(m, f"^{SETTING}", "")
    return bind(value, lambda v: F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), _signs(v, key, inverse, v.rlike("^[0-9a-f]+$"))))


def _ip(m: Column, key: Column, inverse: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    return bind(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), F.array_join(feistel(o, F.array(*[F.lit(256)] * 4), key, inverse).cast("array<string>"), ".")))


def _date(m: Column, key: Column, inverse: bool) -> Column:
    def out(form: str, kind: str) -> Column:
        day = F.datediff(F.try_to_date(m, form), F.lit(FIRST_DAY).cast("date"))
        moved = bind(feistel(F.array(F.floor(day / DAYS[1]), day % DAYS[1]), F.array(*map(F.lit, DAYS)), key, inverse), lambda v: F.element_at(v, 1) * DAYS[1] + F.element_at(v, 2))
        padded = form if kind == "iso" else form.replace("d", "dd", 1).replace("M", "MM", 1)
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int"))
        shown = F.when(F.length(m) == 10, F.date_format(new, padded)).otherwise(F.date_format(new, form))
        return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), shown)

    return F.when(m.contains("-"), out("yyyy-MM-dd", "iso")).when(m.contains("."), out("d.M.yyyy", "dots")).otherwise(out("M/d/yyyy", "slashes"))


def _ssn(m: Column, key: Column, inverse: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    v = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    shown = lambda v: F.format_string("%03d-%02d-%04d", F.element_at(v, 1) + 1 + (F.element_at(v, 1) > 664).cast("int"), F.element_at(v, 2) + 1, F.element_at(v, 3) + 1)
    return F.when(good, bind(feistel(v, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, inverse), shown))


def _phone(m: Column, key: Column, inverse: bool) -> Column:
    """The country code stays. In North American numbers the first digits of area code and exchange stay on their side
    of 2, so that valid numbers remain valid and no others become so."""
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)

    def rest(r: Column) -> Column:
        digits = F.regexp_replace(r, r"\D", "")
        american = (F.length(digits) == 10) & ((code == "") | (code == "+1"))
        bound = lambda i: american & i.isin(0, 3)
        low = lambda x, i: F.when(bound(i) & (x > 1), F.lit(2)).otherwise(F.lit(0))

        def moved(v: Column) -> Column:
            sizes = F.transform(v, lambda x, i: F.when(bound(i), F.when(x > 1, 8).otherwise(2)).otherwise(10))
            new = feistel(F.transform(v, lambda x, i: x - low(x, i)), sizes, key, inverse)
            return _into(r, F.array_join(F.zip_with(new, F.transform(v, low), lambda x, a: (x + a).cast("string")), ""))

        return F.when(F.length(digits).between(7, 14), F.concat(code, bind(F.transform(F.split(digits, ""), lambda c: c.cast("int")), moved)))

    return bind(F.substring(m, F.length(code) + 1, F.length(m)), rest)


def _one_card(m: Column, key: Column, inverse: bool) -> Column:
    """A Luhn-valid number: the issuer's first digit stays, the last is computed anew."""

    def of(d: Column) -> Column:
        body = F.transform(F.split(F.substring(d, F.lit(2), F.length(d) - 2), ""), lambda c: c.cast("int"))
        moved = bind(body, lambda v: F.array_join(feistel(v, F.transform(v, lambda _: F.lit(10)), key, inverse).cast("array<string>"), ""))
        front = F.concat(F.substring(d, 1, 1), moved)
        return bind(front, lambda f: _into(m, F.concat(f, F.pmod(-_luhn(f, 0), F.lit(10)).cast("string"))))

    return bind(F.regexp_replace(m, r"\D", ""), of)


def _cards(m: Column) -> Column:
    """Where in a run of digits the Luhn-valid numbers stand, as structs of at and n: from the left, the longest of 13 to
    19 digits that begins and ends at separators or the run's ends."""

    def of(groups: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            ends = F.sequence(F.least(i + 18, F.size(groups)), i, F.lit(-1))
            digits = lambda e: F.array_join(F.slice(groups, i, e - i + 1), "")
            good = lambda e: bind(digits(e), lambda d: F.when(F.length(d).between(13, 19) & d.rlike("[1-9]"), _luhn(d, 1) % 10 == 0).otherwise(False))
            n = F.length(F.element_at(groups, i))

            def after(e: Column) -> Column:
                size = F.length(F.array_join(F.slice(groups, i, e - i + 1), " "))
                pick = F.struct(state["at"].alias("at"), size.alias("n"))
                return F.struct((state["at"] + n + 1).alias("at"), (e + 1).alias("free"), F.concat(state["picks"], F.array(pick)).alias("picks"))

            passed = F.struct((state["at"] + n + 1).alias("at"), state["free"].alias("free"), state["picks"].alias("picks"))
            found = bind(F.get(F.filter(ends, good), F.lit(0)), lambda e: F.when(e.isNull(), passed).otherwise(after(e)))
            return F.when(i < state["free"], passed).otherwise(found)

        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("free"), F.array().cast("array<struct<at:int,n:int>>").alias("picks"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step)["picks"]

    return bind(F.split(m, "[ -]"), of)


def _card(m: Column, key: Column, inverse: bool) -> Column:
    """The Luhn-valid numbers of a run, one after the other. Where permuted digits would make other groups of the run be
    read as numbers, they are permuted again until they do not, so that the same numbers are found on the way back."""

    def of(picks: Column) -> Column:
        def moved(text: Column, i: Column) -> Column:
            p = F.element_at(picks, i)
            # no group of 19 digits that touches this number reaches past the number before the last, or 40 signs on
            start = F.when(i > 2, F.get(picks, i - 3)["at"] + F.get(picks, i - 3)["n"] + 1).otherwise(F.lit(1))
            known = F.transform(F.slice(picks, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), lambda q: F.struct((q["at"] - start + 1).alias("at"), q["n"].alias("n")))

            def tried(t: Column) -> Column:
                new = F.overlay(t, _one_card(F.substring(t, p["at"], p["n"]), key, inverse), p["at"], p["n"])
                near = lambda x: F.substring(x, start, p["at"] + p["n"] + 40 - start)
                return bind(new, lambda x: F.struct(x.alias("text"), (F.slice(_cards(near(x)), F.lit(1), F.size(known)) == known).alias("done")))

            def again(first: Column) -> Column:
                walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, _: F.when(s["done"], s).otherwise(tried(s["text"])))
                return F.when(first["done"], first["text"]).otherwise(walked["text"])

            return bind(tried(text), again)

        order = F.sequence(F.size(picks), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.size(picks))
        return F.when(F.size(picks) > 0, F.aggregate(order, m, moved))

    return bind(_cards(m), of)


def _iban(m: Column, key: Column, inverse: bool) -> Column:
    """Numbers whose two check digits hold: the country stays, the account is permuted, the check digits computed anew."""

    def of(d: Column) -> Column:
        valid = _mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1
        account = _signs(F.substring(d, F.lit(5), F.length(d)), key, inverse)
        checked = bind(account, lambda a: F.concat(F.substring(d, 1, 2), F.lpad((98 - _mod97(F.concat(a, F.substring(d, 1, 2), F.lit("00")))).cast("string"), 2, "0"), a))
        spaced = bind(checked, lambda c: F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), lambda a, x: F.when(x == " ", F.struct(F.concat(a["out"], x).alias("out"), a["n"].alias("n"))).otherwise(F.struct(F.concat(a["out"], F.substring(c, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))))["out"])
        return F.when(valid & F.length(d).between(15, 34), spaced)

    return bind(F.replace(m, F.lit(" "), F.lit("")), of)


def pseudonym(match: Column, key: str, inverse: bool = False) -> Column:
    """A struct of kind and text for one matched value; kind is null and the text as it was where validation fails."""
    makers = {"email": _email, "key": lambda m, k, i: F.concat(F.substring(m, 1, 4), _signs(F.substring(m, F.lit(5), F.lit(16)), k, i)), "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}
    out = F.lit(None)
    for kind, make in reversed(makers.items()):
        new = bind(make(match, F.lit(f"{key}|{kind}"), inverse), lambda n, kind=kind: F.when(n.isNotNull(), F.struct(F.lit(kind).alias("kind"), n.alias("text"))))
        out = F.when(match.rlike(f"^(?:{FORMATS[kind]})$"), new).otherwise(out)
    return F.coalesce(out, _kept(match))


def _kept(text: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), text.alias("text"))


def _parts(text: Column) -> Column:
    """The text as an array: what stands before the first value, the value, what follows, and so on."""
    marked = F.split(F.regexp_replace(text, f"({ANY})", f"{MARK}$1{MARK}"), MARK)
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    # where the text has the mark itself, values are looked for twice
    apart = F.filter(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, m))), lambda x: x.isNotNull())
    return F.when(F.instr(text, MARK) > 0, apart).otherwise(marked)


def pseudonymise(df: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """df with the personal values of `text` replaced, and pseudonyms, how many were.

    Validated cards (Luhn), phone numbers, social security numbers, IBANs (mod 97), IPv4 addresses and dates (in the
    calendar, 1800 to 2199) are permuted within their format under the key, as are names and domains of mail addresses
    (but for a domain's last label), access key ids and the values of password or token settings of six signs or more.
    Equal values get equal pseudonyms in all documents, without any exchange between them. Numbers that fail validation,
    and all other text, stay as they are. With `inverse` and the same key the values come back.

    Values are permuted whole, whatever their length (signs beyond BLOCK in blocks of their own), and texts of any length
    are read in one pass. Null and empty texts stay as they are with 0 pseudonyms; repeated rows are treated alike; an
    empty table gives no rows. Every column of df stays, whatever its name, but for pseudonyms, which is replaced.
    """
    source = F.col(f"`{text}`")
    others = [c for c in df.columns if c not in (text, "pseudonyms")]
    hint = F.coalesce(source.rlike(HINT), F.lit(False))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0)).alias("row"), source.alias("old"), F.when(hint, _parts(source)).alias("parts"))
    new = F.transform("parts", lambda p, i: F.when(i % 2 == 1, pseudonym(p, key, inverse)).otherwise(_kept(p)))
    rows = rows.select("row", "old", F.when(F.size("parts") > 1, new).alias("new"))
    joined = F.coalesce(F.array_join(F.transform("new", lambda n: n["text"]), ""), F.col("old"))
    count = F.coalesce(F.size(F.filter("new", lambda n: n["kind"].isNotNull())), F.lit(0))
    return rows.select(*[joined.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns if c != "pseudonyms"], count.alias("pseudonyms"))
