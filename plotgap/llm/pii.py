"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are replaced by others of the same format: their value is a pair (a, b) with a below A and b below
B, and a keyed Feistel network of ``ROUNDS`` rounds permutes all A * B pairs (a <- a + f(b) mod A, b <- b + f(a) mod B, f from
SHA-256 with the key). It is one to one, so equal values stay linked across documents and different ones stay
apart. What validates is preserved: card numbers keep length, first digit and a right check digit; phone numbers
keep their grouping and country; social security numbers stay in the ranges given out; addresses stay addresses; dates stay
dates of 1900 to 2099. Names of mail addresses are permuted as numbers over their letters and digits, place by place of their kind.
Separators and leading signs are kept.

Cards are looked for in whole runs of digit groups, at every group and up to every group's end: other numbers beside a card
do not hide it. Groups of the usual shape come first, then the leftmost and longest; other personal data is never cut into.

DataFrame expressions only; no row leaves its partition. The key is a parameter; keep it secret and equal for linked corpora.

Defined results: null text stays null; what looks alike but does not validate (wrong check digit, month 13, part
over 255) is left; offsets never matter, matches are replaced left to right; repeated rows are treated equally; an
empty table gives an empty result; other columns are kept by ``pseudonymised``, but for one named pii, which
the list of places replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import let
from plotgap.llm.spans import matches, replaced

ROUNDS = 6
#: Fixed patterns, in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![0-9])",
    "address": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9])",
    "security": r"\d{3}-\d{2}-\d{4}(?![0-9-])",
    "phone": r"(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![0-9])",
    "card": r"\d(?:[ -]?\d){12,18}(?![0-9])",
}
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"
KINDS = tuple(PATTERNS)
OTHERS = "(?<![A-Za-z0-9])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "card") + ")"
#: Fixed patterns of runs that can hold cards, and of cards in their usual groups.
RUN = r"(?<![A-Za-z0-9])\d(?:[ -]?\d){12}[0-9 -]*"
SHAPED = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})$"
MOST_GROUPS = 19  # a card has no more digits
DAYS = (17, 4297)  # their product is the number of days of 1900 to 2099


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """(a, b) permuted among all pairs below the sizes."""
    def noise(k: int, v: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(k)), size_a.cast("string"), size_b.cast("string"), v.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 14), 16, 10).cast("bigint")

    state = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    for k in range(ROUNDS):
        state = _turn(state, "ab"[k % 2], (size_a, size_b)[k % 2], noise, k)
    return state


def _turn(state: Column, side: str, size: Column, noise, k: int) -> Column:
    def moved(s: Column) -> Column:
        a, b = s["a"], s["b"]
        if side == "a":
            a = F.pmod(a + noise(k, b), size)
        else:
            b = F.pmod(b + noise(k, a), size)
        return F.struct(a.alias("a"), b.alias("b"))
    return let(state, moved)


def power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("bigint")


def permuted(value: Column, letters: str, key: str, kind: str) -> Column:
    """A string over ``letters`` (at most 36, at most 20 long) permuted among those of its length."""
    radix, digits = len(letters), "0123456789abcdefghijklmnopqrstuvwxyz"[:len(letters)]

    def number(s: Column) -> Column:
        return F.coalesce(F.conv(F.translate(s, letters, digits), radix, 10).cast("bigint"), F.lit(0).cast("bigint"))

    def text(n: Column, size: Column) -> Column:
        return F.when(size > 0, F.translate(F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), size, "0"), digits, letters)).otherwise(F.lit(""))

    half = F.floor(F.length(value) / 2).cast("int")
    rest = F.length(value) - half
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, rest)
    return let(feistel(number(left), number(right), power(radix, half), power(radix, rest), key, f"{kind}{radix}"),
               lambda s: F.concat(text(s["a"], half), text(s["b"], rest)))


def check_digit(body: Column) -> Column:
    """Luhn digit that completes a string of digits."""
    chars = F.reverse(F.split(body, ""))
    total = F.aggregate(F.transform(chars, lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0))),
                        F.lit(0), lambda a, v: a + v)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def refilled(shape: Column, letters: str, new: Column) -> Column:
    """``shape`` with its characters of the class ``letters`` replaced in order by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(a: Column, c: Column) -> Column:
        mine = c.rlike(letters)
        return F.struct(F.concat(a["out"], F.when(mine, F.substring(new, a["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (a["k"] + mine.cast("int")).alias("k"))
    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["out"])


def only(value: Column, others: str) -> Column:
    return F.regexp_replace(value, others, "")


def valid_card(value: Column) -> Column:
    """The pattern of cards and a right check digit."""
    sound = let(only(value, "[^0-9]"), lambda d: check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)))
    return F.when(value.rlike(f"^(?:{PATTERNS['card']})$"), sound).otherwise(False)


def new_card(value: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted(F.substring(d, F.lit(2), F.length(d) - 2), "0123456789", key, "card"))
        return F.when(check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)),
                      let(body, lambda b: refilled(value, "[0-9]", F.concat(b, check_digit(b)))))
    return let(only(value, "[^0-9]"), of)


def new_phone(value: Column, key: str) -> Column:
    def of(d: Column) -> Column:  # ten digits
        new = permuted(d, "0123456789", key, "phone")
        sign = F.regexp_extract(value, r"^\+1[ .-]?", 0)
        return F.concat(sign, refilled(F.substring(value, F.length(sign) + 1, F.length(value)), "[0-9]", new))
    return let(only(F.regexp_replace(value, r"^\+1", ""), "[^0-9]"), of)


def new_security(value: Column, key: str) -> Column:
    area, group, serial = F.substring(value, 1, 3).cast("bigint"), F.substring(value, 5, 2).cast("bigint"), F.substring(value, 8, 4).cast("bigint")
    sound = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - 1 - (area > 666).cast("int")) * 99 + group - 1

    def of(s: Column) -> Column:
        a = F.floor(s["a"] / 99) + 1
        return F.concat_ws("-", F.lpad((a + (a >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((s["b"] + 1).cast("string"), 4, "0"))
    return F.when(sound, let(feistel(place, serial - 1, F.lit(898 * 99), F.lit(9999), key, "security"), of))


def new_address(value: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        n = [F.get(p, k).cast("bigint") for k in range(4)]
        new = let(feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "address"),
                  lambda s: F.concat_ws(".", *[x.cast("string") for v in ("a", "b") for x in (F.floor(s[v] / 256), s[v] % 256)]))
        return F.when(F.forall(p, lambda x: x.cast("int") <= 255), new)
    return let(F.split(value, r"\."), of)


def new_date(value: Column, key: str) -> Column:
    shapes = {r"^\d{4}-": "yyyy-MM-dd", r"^\d\d\.\d\d\.": "dd.MM.yyyy", r"^\d\d/\d\d/": "MM/dd/yyyy"}
    out = F.lit(None).cast("string")
    for shape, form in shapes.items():
        def of(n: Column) -> Column:
            new = let(feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date"), lambda s: s["a"] * DAYS[1] + s["b"])
            return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), new.cast("int")), form))
        day = F.datediff(F.try_to_date(value, form), F.lit("1900-01-01").cast("date"))
        out = F.when(value.rlike(shape), let(day, of)).otherwise(out)
    return out


def new_email(value: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        name = F.get(parts, 0)
        lower = F.lower(name)
        letters, digits = only(lower, "[^a-z]"), only(lower, "[^0-9]")
        bounded = (F.length(letters) <= 20) & (F.length(digits) <= 20)
        new = let(F.struct(permuted(letters, "abcdefghijklmnopqrstuvwxyz", key, "mail").alias("l"), permuted(digits, "0123456789", key, "mail").alias("d")),
                  lambda s: refilled(refilled(lower, "[a-z]", s["l"]), "[0-9]", s["d"]))
        # longer names are folded to twenty characters by the key
        folded = F.translate(F.substring(F.sha2(F.concat(F.lit(key), lower).cast("binary"), 256), 1, 20), "0123456789", "ghijklmnop")
        return F.concat(F.when(bounded, new).otherwise(folded), F.lit("@"), F.get(parts, 1))
    return let(F.split(value, "@"), of)


MAKERS = {"email": new_email, "date": new_date, "address": new_address, "security": new_security, "phone": new_phone, "card": new_card}


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def cards(text: Column, others: Column) -> Column:
    """Array of (start, end, value): card numbers that validate and cut into none of ``others``, not overlapping."""
    none = F.array().cast("array<struct<unshaped:boolean,start:int,less:int,end:int,value:string>>")

    def candidates(groups: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(groups, begin, lambda a, g: F.struct((a["at"] + F.length(g)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def placed(value: Column, start: Column) -> Column:
            return F.struct((~value.rlike(SHAPED)).alias("unshaped"), start.alias("start"), (-F.length(value)).alias("less"),
                            (start + F.length(value)).alias("end"), value.alias("value"))

        def of(start: Column, i: Column) -> Column:
            some = F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_GROUPS), F.size(groups) - i)),
                               lambda k: F.regexp_replace(F.array_join(F.slice(groups, i + 1, k), ""), "[ -]+$", ""))
            return F.transform(F.filter(some, valid_card), lambda v: placed(v, start))
        return F.flatten(F.transform(starts, of))

    def free(c: Column) -> Column:  # a card may only hold others whole, behind its start
        return ~F.exists(others, lambda o: overlap(c, o) & ~((c["start"] < o["start"]) & (o["end"] <= c["end"])))

    def chosen(m: Column) -> Column:
        all_ = let(F.regexp_extract_all(m["value"], F.lit(r"\d+[ -]*"), F.lit(0)), lambda g: candidates(g, m["start"]))
        return F.aggregate(F.sort_array(F.filter(all_, free)), none, lambda a, c: F.when(F.exists(a, lambda o: overlap(c, o)), a).otherwise(F.concat(a, F.array(c))))
    return F.flatten(F.transform(matches(text, RUN), chosen))


def found(text: Column, key: str) -> Column:
    """Array of (start, end, kind, value): what validates, with its pseudonym."""
    def of(m: Column) -> Column:
        value, kind, out = m["value"], F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in reversed([k for k in KINDS if k != "card"]):
            hit = value.rlike(f"^(?:{PATTERNS[name]})$")
            kind, out = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, MAKERS[name](value, key)).otherwise(out)
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), kind.alias("kind"), out.alias("value"))

    def both(others: Column) -> Column:
        def merged(numbers: Column) -> Column:
            new = F.transform(numbers, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("card").alias("kind"), new_card(c["value"], key).alias("value")))
            return F.sort_array(F.concat(F.filter(others, lambda o: ~F.exists(numbers, lambda c: overlap(c, o))), new))
        return let(cards(text, others), merged)
    return let(F.filter(F.transform(matches(text, OTHERS), of), lambda s: s["value"].isNotNull()), both)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and a last column ``pii``: array of (start, end, kind, value) on the input."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    text = docs.select(row, F.col("text").alias("_t"))
    spotted = text.select("_row", "_t", F.when(F.col("_t").rlike(ANY), found(F.col("_t"), key)).otherwise(
        F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")).alias("_s"))
    done = spotted.select("_row", "_s", replaced(F.col("_t"), F.coalesce("_s", F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))).alias("_t"))
    return done.select(*[(F.col("_t") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns if c != "pii"], F.col("_s").alias("pii"))
