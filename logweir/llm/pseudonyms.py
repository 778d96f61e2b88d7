"""Format-preserving pseudonyms for personal numbers and dates in texts, by keyed Feistel rounds."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, whole

#: The shapes that are looked for, in this order, each with what may stand before it. A mail
#: address has 64 characters before the sign and 127 labels after it at most, as the mail and name
#: systems have it; so no repetition of a group is without a bound.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}+@(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,}",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![.]?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)",
    "phone": r"(?<!\d)(?:\+1[ .-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[ .-]?[2-9]\d{2}[ .-]\d{4}(?!\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7})(?!\d)",
}
ANY = "|".join(SHAPES.values())
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A cycle of the calendar, 400 years, has 189 * 773 days.
FIRST_DAY, CYCLE = "1800-01-01", (189, 773)
ROUNDS = 8


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of pairs (left below ``a``, right below ``b``), as a struct ``l, r``.

    In each round one half is moved within its range by a keyed hash of the other half, which
    can be undone, so no two pairs become one.
    """
    def moved(number: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, number.cast("string"), half.cast("string"), F.lit(key)), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    pair = lambda x, y: F.struct(x.cast("long").alias("l"), y.cast("long").alias("r"))
    a, b = a.cast("long"), b.cast("long")
    return F.aggregate(
        F.array(*map(F.lit, range(ROUNDS))), pair(left, right),
        lambda s, i: F.when(i % 2 == 0, pair(F.pmod(s["l"] + moved(i, s["r"], a), a), s["r"]))
        .otherwise(pair(s["l"], F.pmod(s["r"] + moved(i, s["l"], b), b))),
    )


def number_of(text: Column, alphabet: str) -> Column:
    """A text over an alphabet as a number."""
    base = F.lit(len(alphabet)).cast("long")
    return F.aggregate(
        F.regexp_extract_all(text, F.lit("."), 0), F.lit(0).cast("long"),
        lambda n, c: n * base + F.instr(F.lit(alphabet), c).cast("long") - 1,
    )


def text_of(number: Column, length: Column, alphabet: str) -> Column:
    """``length`` letters of an alphabet that stand for a number."""
    base = len(alphabet)
    state = lambda n, t: F.struct(n.cast("long").alias("n"), t.alias("t"))
    return F.aggregate(
        F.array_repeat(F.lit(0), length), state(number, F.lit("")),
        lambda s, _: state(F.floor(s["n"] / base), F.concat(F.substring(F.lit(alphabet), (s["n"] % base + 1).cast("int"), F.lit(1)), s["t"])),
        lambda s: s["t"],
    )


def permuted(text: Column, alphabet: str, key: str, tweak: str) -> Column:
    """Another text of the same length over the alphabet; no two texts of a length become one.

    Longer texts are taken in pieces of 20 letters.
    """
    powers = F.array(*[F.lit(len(alphabet) ** k) for k in range(11)])

    def piece(part: Column, place: Column) -> Column:
        def halves(n: Column) -> Column:
            left, right = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
            a, b = F.element_at(powers, left + 1), F.element_at(powers, right + 1)
            named = F.concat_ws("|", F.lit(tweak), F.lit(alphabet[0]), n.cast("string"), place.cast("string"))
            moved = feistel(key, named, number_of(F.substring(part, F.lit(1), left), alphabet), number_of(F.substring(part, left + 1, right), alphabet), a, b)
            return let(moved, lambda s: F.concat(text_of(s["l"], left, alphabet), text_of(s["r"], right, alphabet)))

        return let(F.length(part), halves)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(".{1,20}"), 0), piece), "")


def only(text: Column, alphabet: str) -> Column:
    return F.regexp_replace(text, f"[^{alphabet[0]}-{alphabet[-1]}]", "")


def refilled(shape: Column, letters: Column, alphabet: str) -> Column:
    """``shape`` with its characters of the alphabet replaced, in order, by ``letters``."""
    taken = lambda s, c: F.substring(letters, s["n"] + 1, F.lit(1))
    state = lambda n, t: F.struct(n.cast("int").alias("n"), t.alias("t"))
    return F.aggregate(
        F.regexp_extract_all(shape, F.lit("(?s)."), 0), state(F.lit(0), F.lit("")),
        lambda s, c: F.when(F.instr(F.lit(alphabet), c) > 0, state(s["n"] + 1, F.concat(s["t"], taken(s, c))))
        .otherwise(state(s["n"], F.concat(s["t"], c))),
        lambda s: s["t"],
    )


def luhn(digits: Column) -> Column:
    """The sum of the Luhn rule, 0 modulo 10 for valid numbers."""
    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    values = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), 0), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def mod97(iban: Column) -> Column:
    """The remainder of an account number, 1 for valid numbers."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c).cast("long") - 1
    return F.aggregate(
        F.regexp_extract_all(turned, F.lit("."), 0), F.lit(0).cast("long"),
        lambda n, c: (n * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )


def new_email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def moved(alphabet: str):
        return lambda x: refilled(x, permuted(only(x, alphabet), alphabet, key, "email"), alphabet)

    for alphabet in (DIGITS, LOWER, UPPER):
        local = let(local, moved(alphabet))
    return F.concat(local, F.lit("@"), domain)


def new_address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "[.]"), lambda x: x.cast("int"))

    def moved(o: Column) -> Column:
        s = feistel(key, F.lit("address"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        return let(s, lambda x: F.concat_ws(".", *[F.floor(v).cast("long").cast("string") for v in (x["l"] / 256, x["l"] % 256, x["r"] / 256, x["r"] % 256)]))

    return let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), moved(o)))


def new_iban(m: Column, key: str) -> Column:
    """Digits after the check digits are permuted, then the check digits made right."""
    head, tail = F.substring(m, 1, 2), F.substr(m, F.lit(5))
    changed = F.concat(head, F.lit("00"), refilled(tail, permuted(only(tail, DIGITS), DIGITS, key, "iban"), DIGITS))
    checked = let(changed, lambda x: F.concat(head, F.lpad((98 - mod97(x)).cast("string"), 2, "0"), F.substr(x, F.lit(5))))
    return F.when(mod97(m) == 1, checked)


def new_date(m: Column, key: str) -> Column:
    """Another day of the same 400 years, in the same form. Equal days agree in all forms."""
    form = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.rlike("[.]"), "dd.MM.yyyy").otherwise("dd/MM/yyyy")
    iso = F.when(m.rlike("^[0-9]{4}-"), m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    size = CYCLE[0] * CYCLE[1]

    def moved(n: Column) -> Column:
        s = feistel(key, F.lit("date"), F.floor(n / CYCLE[1]), n % CYCLE[1], F.lit(CYCLE[0]), F.lit(CYCLE[1]))
        other = let(s, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * CYCLE[1] + x["r"]).cast("int")))
        return let(other, lambda d: F.when(form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd"))
                   .when(form == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")))

    return let(day, lambda n: F.when((n >= 0) & (n < size), moved(n)))


def new_phone(m: Column, key: str) -> Column:
    """Area and exchange stay numbers from 200 on; a country code stays."""
    code = F.regexp_extract(m, r"^\+1", 0)
    digits = F.substring(only(m, DIGITS), -10, 10)

    def moved(d: Column) -> Column:
        left = F.substring(d, 1, 3).cast("long") - 200
        right = F.substring(d, 4, 7).cast("long") - 2_000_000
        s = feistel(key, F.lit("phone"), left, right, F.lit(800), F.lit(8_000_000))
        return let(s, lambda x: F.concat((x["l"] + 200).cast("string"), (x["r"] + 2_000_000).cast("string")))

    return F.concat(code, refilled(F.substr(m, F.length(code) + 1), let(digits, moved), DIGITS))


def new_social(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01 and serials from 0001 on."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(key, F.lit("social"), place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def written(x: Column) -> Column:
        p = F.floor(x["l"] / 99)
        a = F.when(p >= 665, p + 2).otherwise(p + 1)
        return F.format_string("%03d-%02d-%04d", a.cast("long"), (x["l"] % 99 + 1).cast("long"), (x["r"] + 1).cast("long"))

    return F.when(valid, let(s, written))


def new_card(m: Column, key: str) -> Column:
    """All digits but the first are permuted; the last makes the Luhn sum right."""
    digits = only(m, DIGITS)

    def moved(d: Column) -> Column:
        middle = F.concat(F.substring(d, 1, 1), permuted(F.substring(d, F.lit(2), F.length(d) - 2), DIGITS, key, "card"))
        full = let(middle, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn(d) == 0, refilled(m, full, DIGITS))

    return let(digits, moved)


MAKERS = {
    "email": new_email, "address": new_address, "iban": new_iban, "date": new_date,
    "phone": new_phone, "social": new_social, "card": new_card,
}


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of a found value, null if it fails the check of its kind."""
    out = F.lit(None).cast("string")
    for kind in reversed(SHAPES):
        out = F.when(found.rlike(f"^(?:{SHAPES[kind]})$"), MAKERS[kind](found, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_replaced, n_unchecked, text_col`` of each row, personal values replaced.

    Looked for: card numbers (Luhn), account numbers (mod 97), telephone and social security
    numbers, network addresses, dates, and the local part of mail addresses. A value that
    passes its check is mapped, within its format, by a keyed permutation: equal values have equal
    pseudonyms in all documents, different ones different, and pseudonyms pass the same check.
    ``n_unchecked`` counts values of a known shape that fail the check and stay.

    Everything is a column expression on one row; there is no shuffle and no Python. Plans and
    event logs show a digest of ``key``, never the key; keep them private all the same, since the
    digest is enough to map values.

    * A null text stays null with zeros. Texts without such values stay as they are.
    * Repeated rows give repeated rows; an empty table gives none; other columns are not looked at.
    * Dates outside the 400 years from 1800 on, and days that do not exist, stay.
    """
    key = hashlib.sha256(key.encode()).hexdigest()
    t = F.col("_text")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_found", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), 0)).otherwise(none))
    rows = rows.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key)))
    written = F.transform("_new", lambda n, i: F.coalesce(n, F.col("_found")[i]))
    between = lambda parts: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_written"), i), F.lit("")))), "")
    rows = rows.withColumn("_written", written)
    text = F.when(F.size("_found") == 0, t).otherwise(let(F.split(t, ANY, -1), between))
    unchecked = F.size(F.filter("_new", lambda n: n.isNull()))
    return rows.select(
        F.col("_id").alias(id_col),
        (F.size("_new") - unchecked).cast("long").alias("n_replaced"),
        unchecked.cast("long").alias("n_unchecked"),
        text.alias(text_col),
    )
