"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Card numbers, phone numbers, social security numbers, IP addresses, dates
and the letters and digits of e-mail addresses are read as vectors of small
integers, each with its own modulus; a keyed Feistel network over the
vector (its two halves add keyed digests of each other, modulo place by
place) permutes all vectors of that format.  So a value keeps its format and
its validity (Luhn digit, calendar, ranges), and equal values become equal
pseudonyms in every document.  Every format is permuted within itself: dates
written month first, which only a day above 12 shows, are moved again until
the day is above 12 (cycle walking), so no two strings share a pseudonym.

At every place where a match may start each kind is tried, and the first that
passes its validation counts, so a number next to another one isn't lost: a
card ends before a blank and a new number.  Cards in other groups than 4-4-4-4
and 4-6-5 count only where the run of numbers ends and no other match starts
in them.

Defined cases: a null text stays null and has no findings; matches that fail
validation stay as they are (among them IP addresses with leading zeros and
mail domains of more than 253 characters, which are none); texts of any length
are scanned whole; repeated rows are masked each, alike; an empty table gives
an empty result; extra columns of any name pass through ``pseudonymise``,
those named like its outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

KEY = "tidemark-demo-key"
ROUNDS = 8
#: Kinds in the order in which they are tried, and their patterns.
KINDS = ("email", "date", "ip", "ssn", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?=[A-Za-z0-9.-]{4,253}(?![A-Za-z0-9.-]))(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "date": r"\d{4}-\d{2}-\d{2}(?!\d)|\d{4}/\d{2}/\d{2}(?!\d)|\d{2}/\d{2}/\d{4}(?!\d)|\d{2}\.\d{2}\.\d{4}(?!\d)",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]?\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"\d(?:[ -]?\d){12,18}(?![ -]?\d)",
    "phone": r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
}
#: Cards in their usual groups, or unbroken, may stand next to other numbers.
SHAPED = r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!-?\d)"
#: What is tried at a place, in this order; the first that is valid counts.
TRIES = [*((k, PATTERNS[k]) for k in KINDS[:4]), ("card", SHAPED), ("phone", PATTERNS["phone"]), ("card", PATTERNS["card"])]
#: A match starts where no part of a longer word or number stands before it.
START = r"(?<![A-Za-z0-9])(?<!\d[.-])(?=" + "|".join(f"(?:{x})" for x in (*PATTERNS.values(), SHAPED)) + ")"
#: From a start on to where no match can go on: past characters of no kind, or a blank that isn't between numbers.
CLUSTER = START + r"(?:[A-Za-z0-9._%+@()/-]++(?: (?<=[\d)] )(?=[\d(]))?+)++"
#: No match is longer than REACH characters or has more than STARTS starts in it.
REACH, STARTS = 700, 80
#: Dates move within the 400-year cycle 1800 to 2199 of 189 * 773 days.
FIRST_DAY, LAST_DAY, DAYS = "1800-01-01", "2199-12-31", (189, 773)
#: Steps of a cycle walk; three in five days are above 12, so that many miss with a chance of about 1e-26.
WALK = 64


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it stands in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(v: Column, m: Column, kind: str, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """Permute vectors ``v`` of integers below the moduli ``m`` (both array<bigint>, of equal length); a single place is shifted by a digest of the key alone."""

    def one(acc: Column, r: Column) -> Column:
        n = F.size(acc)
        half = F.ceil(n / F.lit(2)).cast("int")
        left = F.pmod(r, F.lit(2)) == 1
        other = F.when(left, F.slice(acc, half + 1, n)).otherwise(F.slice(acc, F.lit(1), half))
        said = F.array_join(other.cast("array<string>"), ",")
        # one digest gives the shifts of four places
        digests = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(4)).cast("int")), lambda j: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n, r, j, said), 256))

        def moved(d: Column) -> Column:
            def place(x: Column, i: Column) -> Column:
                active = F.when(left, i < half).otherwise(i >= half)
                part = F.conv(F.substr(F.element_at(d, F.floor(i / F.lit(4)).cast("int") + 1), F.pmod(i, F.lit(4)) * 15 + 1, F.lit(15)), 16, 10).cast("bigint")
                return F.when(active, F.pmod(x + part, F.element_at(m, i + 1))).otherwise(x)

            return F.transform(acc, place)

        return let(digests, moved)

    return F.aggregate(F.sequence(F.lit(1), F.when(F.size(v) > 0, rounds).otherwise(0), F.when(F.size(v) > 0, 1).otherwise(-1)), v, lambda acc, r: F.when(F.size(acc) > 0, one(acc, r)).otherwise(acc))


def chars(s: Column) -> Column:
    """The characters of a string."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)))


def digits(s: Column) -> Column:
    """The digits of a string as array<bigint>."""
    only = F.regexp_replace(s, r"\D", "")
    return F.when(F.length(only) > 0, F.transform(chars(only), lambda c: c.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def refilled(s: Column, v: Column) -> Column:
    """``s`` with its digits replaced, one by one, by those of ``v``."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(F.substr(s, i, F.lit(1)).rlike(r"\d"), F.element_at(v, F.length(F.regexp_replace(F.substr(s, F.lit(1), i), r"\D", ""))).cast("string")).otherwise(F.substr(s, i, F.lit(1)))), "")


def luhn(v: Column) -> Column:
    """The Luhn sum of all digits but the last, as the digit that must follow."""
    n = F.size(v)
    doubled = F.transform(F.slice(v, F.lit(1), n - 1), lambda x, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _digit(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _card(s: Column, key: str) -> tuple[Column, Column]:
    ok = let(digits(s), lambda v: (F.element_at(v, -1) == luhn(v)) & (F.array_max(v) > 0))

    def moved(v: Column) -> Column:
        return feistel(F.slice(v, F.lit(1), F.size(v) - 1), F.transform(v, lambda x: _digit(10)), "card", key)

    full = let(let(digits(s), moved), lambda body: F.concat(body, F.array(luhn(F.concat(body, F.array(_digit(0)))))))
    return ok, let(full, lambda v: refilled(s, v))


def _phone(s: Column, key: str) -> tuple[Column, Column]:
    # ten national digits, the first of area and exchange from 2 to 9; a country code of 1 stays
    low = F.array(*(_digit(2 if i in (0, 3) else 0) for i in range(10)))
    m = F.array(*(_digit(8 if i in (0, 3) else 10) for i in range(10)))
    ok = let(digits(s), lambda v: (F.element_at(v, -10) >= 2) & (F.element_at(v, -7) >= 2))

    def moved(v: Column) -> Column:
        own = F.zip_with(F.slice(v, F.size(v) - 9, F.lit(10)), low, lambda x, y: x - y)
        return F.concat(F.slice(v, F.lit(1), F.size(v) - 10), F.zip_with(feistel(own, m, "phone", key), low, lambda x, y: x + y))

    return ok, let(let(digits(s), moved), lambda v: refilled(s, v))


def _ssn(s: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substr(s, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    v = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = feistel(v, F.array(*(_digit(x) for x in (898, 99, 9999))), "ssn", key)

    def written(x: Column) -> Column:
        a = F.element_at(x, 1)
        return F.format_string("%03d-%02d-%04d", F.when(a >= 665, a + 2).otherwise(a + 1), F.element_at(x, 2) + 1, F.element_at(x, 3) + 1)

    return ok, let(moved, written)


def _ip(s: Column, key: str) -> tuple[Column, Column]:
    v = F.split(s, r"\.").cast("array<bigint>")
    moved = feistel(v, F.transform(v, lambda x: F.lit(256).cast("bigint")), "ip", key)
    return (F.array_max(v) < 256) & (F.array_join(v.cast("array<string>"), ".") == s), F.array_join(moved.cast("array<string>"), ".")


def _date(s: Column, key: str) -> tuple[Column, Column]:
    year_first = s.rlike(r"^\d{4}")
    format_ = F.when(s.contains("-"), F.lit("yyyy-MM-dd")).when(year_first, F.lit("yyyy/MM/dd")).when(s.contains("."), F.lit("dd.MM.yyyy")).otherwise(F.lit("dd/MM/yyyy"))
    year = F.when(year_first, F.substr(s, F.lit(1), F.lit(4))).otherwise(F.substr(s, F.lit(7), F.lit(4)))
    month = F.when(year_first, F.substr(s, F.lit(6), F.lit(2))).otherwise(F.substr(s, F.lit(4), F.lit(2)))
    day = F.when(year_first, F.substr(s, F.lit(9), F.lit(2))).otherwise(F.substr(s, F.lit(1), F.lit(2)))
    # mm/dd/yyyy if the middle can't be a month
    us = ~year_first & s.contains("/") & (month.cast("int") > 12)
    month, day, format_ = F.when(us, day).otherwise(month), F.when(us, month).otherwise(day), F.when(us, F.lit("MM/dd/yyyy")).otherwise(format_)
    at = F.concat_ws("-", year, month, day).try_cast("date")
    n = F.datediff(at, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    v = F.array(F.floor(n / F.lit(DAYS[1])).cast("bigint"), F.pmod(n, F.lit(DAYS[1])).cast("bigint"))
    m = F.array(*(_digit(x) for x in DAYS))

    def day_of(x: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.element_at(x, 1) * DAYS[1] + F.element_at(x, 2)).cast("int"))

    def walked(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), feistel(v, m, "date", key), lambda x, _: F.when(F.dayofmonth(day_of(x)) > 12, x).otherwise(feistel(x, m, "date", key)))

    new = F.when(us, let(let(v, walked), day_of)).otherwise(let(feistel(v, m, "date", key), day_of))
    ok = at.isNotNull() & at.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))

    def written(x: Column) -> Column:
        y, mo, d = F.date_format(x, "yyyy"), F.date_format(x, "MM"), F.date_format(x, "dd")
        forms = {"yyyy-MM-dd": ("-", y, mo, d), "yyyy/MM/dd": ("/", y, mo, d), "dd.MM.yyyy": (".", d, mo, y), "MM/dd/yyyy": ("/", mo, d, y)}
        out = F.concat_ws("/", d, mo, y)
        for name, parts in forms.items():
            out = F.when(format_ == name, F.concat_ws(*parts)).otherwise(out)
        return out

    return F.coalesce(ok, F.lit(False)), let(new, written)


def _email(s: Column, key: str) -> tuple[Column, Column]:
    # letters and digits before the last dot move within a-z, A-Z and 0-9; dots, the @ and the top domain stay
    tail = F.length(F.substring_index(s, ".", -1)) + 1
    head = F.substr(s, F.lit(1), F.length(s) - tail)
    code = F.transform(chars(head), lambda c: F.ascii(c).cast("bigint"))
    low = lambda c: F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c).cast("bigint")
    size = lambda c: F.when(c.between(48, 57), 10).when(c.between(65, 90) | c.between(97, 122), 26).otherwise(1).cast("bigint")

    def moved(code: Column) -> Column:
        v = feistel(F.transform(code, lambda c: c - low(c)), F.transform(code, size), "email", key)
        return F.array_join(F.zip_with(v, F.transform(code, low), lambda x, y: F.chr(x + y)), "")

    return F.lit(True), F.concat(let(code, moved), F.substr(s, F.length(s) - tail + 1, tail))


_MAKERS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def matches(cluster: Column, key: str = KEY) -> Column:
    """A cluster in pieces, array of struct(kind, s): kind the number in ``KINDS`` of a valid match, null for what stands between."""

    def tried(p: Column, k: Column) -> Column:
        rest = F.substr(F.array_join(F.slice(p, k + 1, F.lit(STARTS)), ""), F.lit(1), F.lit(REACH))

        def first(rest: Column) -> Column:
            out = F.struct(F.lit(None).cast("int").alias("kind"), F.lit("").alias("s"), F.lit(False).alias("loose"))
            for i, (name, pattern) in reversed(list(enumerate(TRIES))):
                s = F.regexp_extract(rest, f"^(?:{pattern})", 0)
                valid = F.when(s != "", let(s, lambda x: _MAKERS[name](x, key)[0])).otherwise(F.lit(False))  # noqa: B023
                out = F.when(valid, F.struct(F.lit(KINDS.index(name)).alias("kind"), s.alias("s"), F.lit(i == len(TRIES) - 1).alias("loose"))).otherwise(out)
            return out

        return let(rest, first)

    def walked(p: Column, found: Column) -> Column:
        piece = lambda kind, s: F.array(F.struct(kind.cast("int").alias("kind"), s.alias("s")))
        none = F.lit(None).cast("int")

        def step(a: Column, k: Column) -> Column:
            own, x = F.element_at(p, k + 1), F.element_at(found, k + 1)
            n, size = F.length(own), F.length(x["s"])
            # a card in unusual groups gives way to any other match that starts in it
            other = F.exists(F.sequence(F.lit(1), F.lit(19)), lambda d: F.coalesce(F.get(found, k + d)["kind"].isNotNull() & ~F.get(found, k + d)["loose"], F.lit(False)) & (F.length(F.array_join(F.slice(p, k + 1, d), "")) < size))
            free = (a["skip"] == 0) & x["kind"].isNotNull()
            take = F.when(free, F.when(x["loose"], ~other).otherwise(F.lit(True))).otherwise(F.lit(False))

            def with_skip(take: Column) -> Column:
                skip = F.when(take, size).otherwise(a["skip"])
                new = F.when(take, piece(x["kind"], x["s"])).otherwise(F.slice(piece(none, F.lit("")), F.lit(1), F.lit(0)))
                left = F.when(n > skip, piece(none, F.substr(own, skip + 1, n))).otherwise(F.slice(piece(none, F.lit("")), F.lit(1), F.lit(0)))
                return F.struct(F.greatest(skip - n, F.lit(0)).alias("skip"), F.concat(a["out"], new, left).alias("out"))

            return let(take, with_skip)

        start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<kind:int,s:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, lambda a: a["out"])

    return let(F.split(cluster, START, -1), lambda p: let(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: tried(p, k)), lambda found: walked(p, found)))


def pseudonym(kind: Column, s: Column, key: str = KEY) -> Column:
    """What stands for a match of a kind; ``s`` itself where kind is null."""
    out = s
    for i, name in enumerate(KINDS):
        out = F.when(kind == i, _MAKERS[name](s, key)[1]).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, n_<kind> of each kind, and n_pii."""
    own = [*(f"n_{k}" for k in KINDS), "n_pii"]
    docs = docs.select(*(c for c in docs.columns if c not in own))
    text = F.col("text")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # the caller's columns travel in one, so that none of their names can clash
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*(f"`{c}`" for c in rest)) if rest else F.lit(0)
    found = docs.select(row.alias("row"), "text", F.coalesce(hits, F.array().cast("array<string>")).alias("hits"))
    done = found.select("row", "text", F.transform("hits", lambda c: F.transform(matches(c, key), lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["kind"], x["s"], key).alias("to")))).alias("to"))
    gaps = F.split(text, CLUSTER, -1)
    masked = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("to")), F.col("to"), lambda g, x: F.concat(g, F.array_join(F.transform(x, lambda y: y["to"]), ""))), ""), F.element_at(gaps, -1))
    counts = [F.size(F.filter(F.flatten("to"), lambda x: x["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    got = done.select(*(F.col("row").getField(c).alias(c) for c in rest), F.when(F.size("to") > 0, masked).otherwise(text).alias("text"), *counts)
    return got.withColumn("n_pii", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's doc_id, masked text, n_<kind>, n_pii."""
    return pseudonymise(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Keyed permutation in SQL would restate every round; the tests hold it against a row-by-row version instead.
SQL = None
