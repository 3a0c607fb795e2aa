"""Personal data as format-preserving pseudonyms, in DataFrame functions only.

Numbers and dates that validate (payment cards by their check digit, IBANs by theirs, IPv4 octets, social security
numbers, calendar dates), phone numbers, e-mail addresses and secrets are keyed-permuted within their format by Feistel
networks, so that equal values get equal pseudonyms in every document, different values different ones, and the owner of
the key can undo it. Rounds take SHA-256 of the key, the kind, the round and the other half. Digit and letter strings
use a network over their characters (each shifted within its own alphabet), bounded numbers one over a product of two
moduli with cycle walking. Check digits are computed anew. Separators, prefixes and lengths stay.

Secrets and hexadecimal keys may have any length; the whole run of characters that a value can have is permuted.

Null texts stay null, and texts without such values stay as they are. A number that doesn't validate is left alone; so is
an address with a zero in front of an octet.
Equal rows stay equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import texts

# What is looked for, in the order in which alternatives are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "date": r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"(?<![\d])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?!\d)",
    "key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "secret": r"(?i:password|passwd|pwd|secret|token|api_?key)[\"']?[ \t]{0,8}[=:][ \t]{0,8}[\"']?[A-Za-z0-9+/_-]{6,}+(?:\.[A-Za-z0-9+/_-]++)*+",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
LONG = 1200
DAYS = 73_049  # 1900-01-01 to 2099-12-31
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
KEY = "pseudonyms"  # for tests and trials only: who knows the key can undo pseudonyms
KEY_CONF = "spark.tessera.pseudonyms.key"


def prf(key: str, kind: str, turn: Column, value: Column) -> Column:
    """A pseudo-random number below 2^60."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _turns(inverse: bool) -> Column:
    return F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])


def permute_text(c: Column, key: str, kind: str, inverse: bool = False, hexadecimal: bool = False) -> Column:
    """A Feistel network over characters: those at even and at odd places take turns in being shifted by the others."""
    sign = -1 if inverse else 1

    def shift(ch: Column, k: Column) -> Column:
        if hexadecimal:
            alphabet = F.lit(HEX)
        else:
            alphabet = F.when(F.instr(F.lit(DIGITS), ch) > 0, DIGITS).when(F.instr(F.lit(LOWER), ch) > 0, LOWER).when(F.instr(F.lit(UPPER), ch) > 0, UPPER).otherwise("")
        at = F.instr(alphabet, ch) - 1
        return F.when(at >= 0, F.substring(alphabet, F.pmod(at + sign * k, F.length(alphabet)).cast("int") + 1, F.lit(1))).otherwise(ch)

    def turn(acc: Column, r: Column) -> Column:
        other = F.array_join(F.filter(acc, lambda x, j: j % 2 != r % 2), "")
        # of long values the digest, and it is made once a turn: the work grows with the length, not with its square
        other = F.when(F.size(acc) > LONG, F.sha2(other.cast("binary"), 256)).otherwise(other)
        moved = lambda o: F.transform(acc, lambda ch, i: F.when(i % 2 == r % 2, shift(ch, prf(key, kind, r, F.concat_ws("|", o, i.cast("string"))) % 10_000_019)).otherwise(ch))
        return F.element_at(F.transform(F.array(other), moved), 1)

    return F.array_join(F.aggregate(_turns(inverse), F.split(c, ""), turn), "")


def permute_number(c: Column, key: str, kind: str, a: int, b: int, size: int, inverse: bool = False) -> Column:
    """A permutation of 0..size-1 from a Feistel network on Z_a x Z_b (a * b >= size) by cycle walking."""
    sign = -1 if inverse else 1

    def once(n: Column) -> Column:
        start = F.struct((n % a).cast("long").alias("x"), F.floor(n / a).cast("long").alias("y"))

        def turn(acc: Column, r: Column) -> Column:
            even = r % 2 == 0
            return F.struct(
                F.when(even, F.pmod(acc.x + sign * (prf(key, kind, r, acc.y) % a), F.lit(a))).otherwise(acc.x).cast("long").alias("x"),
                F.when(even, acc.y).otherwise(F.pmod(acc.y + sign * (prf(key, kind, r, acc.x) % b), F.lit(b))).cast("long").alias("y"),
            )

        return F.aggregate(_turns(inverse), start, turn, lambda acc: acc.x + acc.y * a)

    if a * b == size:
        return once(c)
    # a value that falls outside walks on; with a * b within a few percent of size, 12 steps never fail in practice
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), c.cast("long"), lambda n, k: F.when((k > 1) & (n < size), n).otherwise(once(n)))


def luhn_digit(payload: Column) -> Column:
    """The check digit of a digit string."""
    digits = F.transform(F.reverse(F.split(payload, "")), lambda x: x.cast("int"))
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return ((F.lit(10) - F.aggregate(weighed, F.lit(0), lambda s, x: s + x) % 10) % 10).cast("string")


def mod97(c: Column) -> Column:
    """An IBAN body with letters as 10..35, modulo 97."""
    value = lambda ch: F.when(F.instr(F.lit(DIGITS), ch) > 0, F.instr(F.lit(DIGITS), ch) - 1).otherwise(F.instr(F.lit(UPPER), ch) + 9)
    return F.aggregate(F.split(c, ""), F.lit(0), lambda s, ch: (s * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97)


def refill(shape: Column, chars: Column, kept: str) -> Column:
    """The characters of `chars` in the places where shape has a character of class `kept`."""
    step = lambda acc, ch: F.when(ch.rlike(kept), F.struct(F.concat(acc.out, F.substring(chars, acc.n + 1, F.lit(1))).alias("out"), (acc.n + 1).alias("n"))).otherwise(F.struct(F.concat(acc.out, ch).alias("out"), acc.n.alias("n")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda acc: acc.out)


def kind_of(x: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        hit = x.rlike(f"^(?:{p})$")
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def pseudonym(x: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value; a value that doesn't validate stays."""
    digits = F.regexp_replace(x, r"\D", "")
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card_ok = F.substring(digits, F.length(digits), F.lit(1)) == luhn_digit(payload)
    new_payload = permute_text(payload, key, "card", inverse)
    card = refill(x, F.concat(new_payload, luhn_digit(new_payload)), r"\d")

    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    # a zero in front would be lost
    ip_ok = F.forall(octets, lambda o: o <= 255) & ~x.rlike(r"(^|\.)0\d")
    n = permute_number(octets[0] + octets[1] * 256 + octets[2] * 65536 + octets[3] * 16777216, key, "ip", 65536, 65536, 1 << 32, inverse)
    ip = F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in range(4)])

    iso = F.when(x.contains("-"), x).when(x.contains("."), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))).otherwise(F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2)))
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd") if hasattr(F, "try_to_date") else iso.try_cast("date"), first)
    moved = F.date_add(first, permute_number(day, key, "date", 271, 270, DAYS, inverse).cast("int"))
    date = F.when(x.contains("-"), F.date_format(moved, "yyyy-MM-dd")).when(x.contains("."), F.date_format(moved, "dd.MM.yyyy")).otherwise(F.date_format(moved, "MM/dd/yyyy"))
    date_ok = F.coalesce(day.between(0, DAYS - 1), F.lit(False))

    area, group, serial = (F.substring(x, a, b).cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    ssn_ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    s = permute_number((F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1, key, "ssn", 88902, 9999, 88902 * 9999, inverse)
    new_area = F.floor(s / 9999 / 99)
    ssn = F.concat_ws("-", F.lpad((F.when(new_area >= 665, new_area + 2).otherwise(new_area + 1)).cast("string"), 3, "0"), F.lpad((F.floor(s / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((s % 9999 + 1).cast("string"), 4, "0"))

    flat = F.replace(x, F.lit(" "), F.lit(""))
    country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    iban_ok = mod97(F.concat(body, country, F.substring(flat, 3, 2))) == 1
    new_body = permute_text(body, key, "iban", inverse)
    check = F.lpad((F.lit(98) - mod97(F.concat(new_body, country, F.lit("00")))).cast("string"), 2, "0")
    iban = refill(x, F.concat(country, check, new_body), "[A-Z0-9]")

    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    email = F.concat(permute_text(local, key, "email", inverse), F.lit("@"), domain)
    country_code = F.regexp_extract(x, r"^\+\d{1,3}?(?=[ .(-]|\d{10}$)", 0)
    country_code = F.when(country_code == "", F.substring(x, 1, 2)).otherwise(country_code)
    rest = F.substring(x, F.length(country_code) + 1, F.length(x))
    phone = F.concat(country_code, permute_text(rest, key, "phone", inverse))
    name = F.regexp_extract(x, r"(?s)^.*?[=:][ \t]*[\"']?", 0)
    value = F.substring(x, F.length(name) + 1, F.length(x))
    # values that look hexadecimal are permuted among themselves, the others walk on until they don't look so
    looks = lambda v: v.rlike("^[0-9a-f]+$")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), value, lambda v, k: F.when((k > 1) & ~looks(v), v).otherwise(permute_text(v, key, "secret", inverse)))
    secret = F.concat(name, F.when(looks(value), permute_text(value, key, "secret", inverse, True)).otherwise(walked))

    kind = kind_of(x)
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", phone)
        .when(kind == "ip", F.when(ip_ok, ip).otherwise(x))
        .when(kind == "date", F.when(date_ok, date).otherwise(x))
        .when(kind == "ssn", F.when(ssn_ok, ssn).otherwise(x))
        .when(kind == "iban", F.when(iban_ok, iban).otherwise(x))
        .when(kind == "card", F.when(card_ok, card).otherwise(x))
        .when(kind == "key", F.concat(F.lit("AKIA"), permute_text(F.substring(x, 5, 16), key, "key", inverse)))
        .when(kind == "secret", secret)
        .when(kind == "hex", permute_text(x, key, "hex", inverse, True))
        .otherwise(x)
    )


def pseudonymize(docs: DataFrame, key: str | None = None, inverse: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_found (values changed), and the kinds found, sorted. The key is the one given, or
    the session's spark.tessera.pseudonyms.key, or else the public KEY."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    rows = texts(docs).withColumn("found", F.regexp_extract_all("text", F.lit(ALL), F.lit(0)))
    # one evaluation for each different value of a document
    rows = rows.withColumn("values", F.array_distinct("found")).withColumn("names", F.transform("values", lambda x: pseudonym(x, key, inverse)))
    new = F.transform("found", lambda x: F.element_at("names", F.array_position("values", x).cast("int")))
    joined = F.array_join(F.zip_with(F.split("text", ALL, -1), new, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", new, lambda a, b: a != b), lambda x: x))
    return rows.select(
        "doc_id", F.when(F.coalesce(F.size("found"), F.lit(0)) <= 0, F.col("text")).otherwise(joined).alias("text"), F.when(F.size("found") > 0, changed).otherwise(0).cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("values", kind_of))), ",").alias("kinds"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
