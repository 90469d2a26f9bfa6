"""Operator 10: format-preserving Feistel pseudonyms for validated numbers and dates.

Main path: DataFrame functions only.  A text is cut at the matches of one pattern; each match
is validated, permuted within its own format by a keyed Feistel network, and put back.  Equal
values have equal pseudonyms in all documents, different values different ones, and every
pseudonym is a valid value of the same format.  What doesn't validate stays as it is, but for
phones if every_phone is set, as op10_pii does: then area codes and exchanges that start with
0 or 1 are formats of their own, permuted apart from the valid ones.

Format        valid if                                   permuted
card          13 to 19 digits, Luhn                      digits but the first; the check digit follows
phone         +1 (NXX) NXX-XXXX, N from 2 to 9           all ten digits, N within 2 to 9 (or 0 to 1)
ipv4          four numbers 0 to 255, no leading zero     the four numbers
ssn           area 001-899 but 666, group and serial > 0 area, group and serial
date          a day of 1800-2199 (ISO, US or dotted)     the day, over the 146,097 days of 400 years
email         local part with a letter or digit          the local part's letters and digits, by class
secret        AKIA and 16 signs; token or password signs the signs, as hex or by class

The network works on a list of small numbers with a modulus each: the two halves in turn add
a keyed hash of the other half, modulo each place's modulus, for ROUNDS rounds.  That is a
bijection for any moduli, so nothing needs to be walked in cycles or stored in tables.

Null texts stay null; empty texts, and texts without a match, stay as they are, with count 0.
No shuffle: repeated rows each get a row, and other columns are kept if asked for.  Texts of
any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import table

ROUNDS = 10
#: What op10_pii takes as its key, so that its results repeat.  It is no secret: give pseudonymise() one of your own.
TEST_KEY = "the test key of op10_pii"
HEX = "0123456789abcdef"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PHONE = r"\+1 \([2-9]\d{2}\) [2-9]\d{2}-\d{4}"
ANY_PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
CARD = r"\d(?:[ -]?\d){12,18}"
KEY_ID = r"AKIA[0-9A-Z]{16}"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRET = r"(?<=token = \")[0-9a-zA-Z]{16,}|(?<=password=)[0-9a-zA-Z]{6,}"
PATTERN = rf"(?<![\w.+-])(?:{PHONE}|{DATE}|{SSN}|{IPV4}|{CARD}|{KEY_ID}|{EMAIL})(?![\w-]|\.\d)|{SECRET}"
ANY_PATTERN = PATTERN.replace(PHONE, ANY_PHONE)
#: The days of 1800-01-01 to 2199-12-31 are 189 * 773.
EPOCH, DAYS = "1800-01-01", (189, 773)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, not wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stream(key: str, kind: Column, round_: Column, half: Column, n: Column) -> Column:
    """Hex digits, eight or more for each of n places, from SHA-512 over key, format, round and the other half."""
    seed = F.concat_ws("|", F.lit(key), kind, round_.cast("string"), F.array_join(F.transform(half, lambda x: x.cast("string")), ","))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int"))
    return let(seed, lambda t: F.array_join(F.transform(blocks, lambda j: F.sha2(F.concat_ws("|", t, j.cast("string")).cast("binary"), 512)), ""))


def feistel(values: Column, moduli: Column, kind: Column, key: str) -> Column:
    """Arrays of longs of one length; a permutation of all value lists under these moduli."""

    def add(own, mod, other, round_):
        moved = let(_stream(key, kind, round_, other, F.size(own)), lambda d: F.transform(own, lambda v, i: F.pmod(v + F.conv(F.substr(d, 8 * i + 1, F.lit(8)), 16, 10).cast("long"), F.get(mod, i))))
        return F.when(F.size(own) == 0, own).otherwise(moved)

    def run(s):
        half, rest = F.floor(F.size(s["v"]) / 2).cast("int"), F.ceil(F.size(s["v"]) / 2).cast("int")
        cut = F.struct(F.slice(s["v"], F.lit(1), half).alias("a"), F.slice(s["v"], half + 1, rest).alias("b"), F.slice(s["m"], F.lit(1), half).alias("ma"), F.slice(s["m"], half + 1, rest).alias("mb"))

        def step(t, r):
            a = F.when(r % 2 == 0, add(t["a"], t["ma"], t["b"], r)).otherwise(t["a"])
            b = F.when(r % 2 == 0, t["b"]).otherwise(add(t["b"], t["mb"], t["a"], r))
            return F.struct(a.alias("a"), b.alias("b"), t["ma"].alias("ma"), t["mb"].alias("mb"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cut, step, lambda t: F.concat(t["a"], t["b"]))

    return let(F.struct(values.alias("v"), moduli.alias("m")), run)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _fill(template: Column, signs: str, new: Column) -> Column:
    """The template with the signs of class `signs`, in order, replaced by those of the array `new`."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def run(fresh):
        def step(s, c):
            hit = c.rlike(f"^[{signs}]$")
            return F.struct(F.concat(s["out"], F.when(hit, F.get(fresh, s["n"])).otherwise(c)).alias("out"), (s["n"] + hit.cast("int")).alias("n"))

        return F.aggregate(_chars(template), start, step, lambda s: s["out"])

    return let(new, run)


def _spelled(text: Column, kind: Column, key: str, alphabet) -> Column:
    """Each sign permuted within its alphabet (a function of sign and place); an array of signs."""

    def run(s):
        values = F.zip_with(s["c"], s["a"], lambda c, a: (F.instr(a, c) - 1).cast("long"))
        moduli = F.transform(s["a"], lambda a: F.length(a).cast("long"))
        return F.zip_with(feistel(values, moduli, kind, key), s["a"], lambda v, a: F.substr(a, (v + 1).cast("int"), F.lit(1)))

    return let(_chars(text), lambda c: let(F.struct(c.alias("c"), F.transform(c, alphabet).alias("a")), run))


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits with the last one not doubled."""
    return F.aggregate(F.reverse(_chars(digits)), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), lambda t, c: F.struct((t["s"] + F.when(t["i"] % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))).alias("s"), (t["i"] + 1).alias("i")), lambda t: t["s"])


def _long(x: Column) -> Column:
    return x.try_cast("long")


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or the match itself if it doesn't validate."""
    by_class = lambda c, i: F.when(c.rlike("^[0-9]$"), DIGITS).when(c.rlike("^[a-z]$"), LOWER).otherwise(UPPER)
    decimal = lambda c, i: F.lit(DIGITS)

    digits = F.regexp_replace(m, "[^0-9]", "")
    head, body = F.substring(digits, 1, 1), F.substr(digits, F.lit(2), F.length(digits) - 2)
    card_body = F.concat(head, F.array_join(_spelled(body, F.lit("card"), key, decimal), ""))
    card = let(card_body, lambda d: F.concat(d, F.pmod(-_luhn(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))
    card = F.when(_luhn(digits) % 10 == 0, _fill(m, "0-9", _chars(card))).otherwise(m)

    local = F.substr(digits, F.lit(2), F.lit(10))
    first = lambda c: F.when(c.isin("0", "1"), "01").otherwise("23456789")
    phone = _spelled(local, F.lit("phone"), key, lambda c, i: F.when(i.isin(0, 3), first(c)).otherwise(DIGITS))
    phone = _fill(m, "0-9", F.concat(F.array(F.lit("1")), phone))

    octets = F.transform(F.split(m, r"\."), _long)
    sound = F.forall(F.split(m, r"\."), lambda o: _long(o).between(0, 255) & (o == _long(o).cast("string")))
    four = F.array(*[F.lit(256).cast("long")] * 4)
    ipv4 = F.when(sound, F.array_join(F.transform(feistel(octets, four, F.lit("ipv4"), key), lambda v: v.cast("string")), ".")).otherwise(m)

    area, group, serial = _long(F.substring(m, 1, 3)), _long(F.substring(m, 5, 2)), _long(F.substring(m, 8, 4))
    order = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(F.array(order, group - 1, serial - 1), F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)]), F.lit("ssn"), key)
    back = let(moved, lambda t: F.concat_ws("-", F.lpad((F.get(t, F.lit(0)) + F.when(F.get(t, F.lit(0)) >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.get(t, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(t, F.lit(2)) + 1).cast("string"), 4, "0")))
    ssn = F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), back).otherwise(m)

    def day(form, kind_of):
        d = F.try_to_date(m, form)
        n = F.date_diff(d, F.lit(EPOCH).cast("date")).cast("long")
        t = feistel(F.array(F.floor(n / DAYS[1]).cast("long"), n % DAYS[1]), F.array(*[F.lit(x).cast("long") for x in DAYS]), F.lit("date"), key)
        days = let(t, lambda x: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (F.get(x, F.lit(0)) * DAYS[1] + F.get(x, F.lit(1))).cast("int")), form))
        return F.when(d.isNotNull() & n.between(0, DAYS[0] * DAYS[1] - 1), days).otherwise(m)

    at = F.instr(m, "@")
    name = F.substr(m, F.lit(1), at - 1)
    plain = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    email = F.when(plain != "", F.concat(_fill(name, "A-Za-z0-9", _spelled(plain, F.lit("email"), key, by_class)), F.substr(m, at, F.length(m)))).otherwise(m)

    is_hex = m.rlike("^[0-9a-f]+$")
    secret = F.array_join(_spelled(m, F.lit("secret"), key, lambda c, i: F.when(is_hex, HEX).otherwise(by_class(c, i))), "")
    key_id = F.concat(F.lit("AKIA"), F.array_join(_spelled(F.substr(m, F.lit(5), F.lit(16)), F.lit("akia"), key, lambda c, i: F.lit(DIGITS + UPPER)), ""))

    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), email)
        .when(whole(KEY_ID), key_id)
        .when(whole(ANY_PHONE), phone)  # without every_phone only valid ones match
        .when(whole(r"\d{4}-\d{2}-\d{2}"), day("yyyy-MM-dd", "iso"))
        .when(whole(r"\d{2}/\d{2}/\d{4}"), day("MM/dd/yyyy", "us"))
        .when(whole(r"\d{2}\.\d{2}\.\d{4}"), day("dd.MM.yyyy", "dotted"))
        .when(whole(SSN), ssn)
        .when(whole(IPV4), ipv4)
        .when(whole(CARD), card)
        .otherwise(secret)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", every_phone: bool = False) -> DataFrame:
    """docs with `text` pseudonymised and n_pseudonyms, the number of values that were replaced by others.

    key: a secret; who has it can invert every pseudonym, so it must not be empty.
    every_phone: phone-shaped values that no numbering plan allows are replaced too.
    """
    if not key:
        raise ValueError("a key is needed: without one, pseudonyms hide nothing")
    pattern = ANY_PATTERN if every_phone else PATTERN
    t = F.col(f"`{text}`")
    # a match has a digit or an @ but for keys and secrets of letters alone; most texts have none of these
    may = F.coalesce(t.rlike('[0-9@]|AKIA|token = "|password='), F.lit(False))
    found = F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = docs.withColumn("_found", found).withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key)))
    pieces = F.split(t, pattern, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda x: x["_found"] != x["_new"])).cast("long")
    return step.withColumn(text, F.when(F.size("_found") > 0, joined).otherwise(t)).withColumn("n_pseudonyms", n).drop("_found", "_new")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY, every_phone=True)
