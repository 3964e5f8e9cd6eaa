"""Secret scans: known shapes, and windows of high entropy.

Known shapes are assignments to secret-sounding names, access keys and long hexadecimal runs. Beside them every run of
``run`` or more token characters is a candidate: a window of ``window`` characters slides over it, and its Shannon entropy is
kept up by the counts of its characters, one in and one out at a time. Windows reach the threshold of the run's
character class (hexadecimal, letters and digits, all token characters) or not; neighbouring ones that do merge into a
span. Runs on the allow-list (plain words, dotted or slashed names, counting sequences) are suppressed; filler suppresses the
part between separators that holds it, and what stands beside it is judged alone. Of spans that touch a known shape, what
lies beyond the parts between separators that the shape touches remains; letters and digits joined to a shape count as its own.

DataFrame expressions only; no row leaves its partition.

Defined results: null text has no spans; offsets are code points with exclusive ends; overlapping spans are all reported and
redacted as one; repeated rows are scanned each; an empty table gives an empty result; other columns are kept by
``redacted`` and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import let
from plotgap.llm.spans import matches, replaced

#: Fixed patterns of the known shapes.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Fixed alphabet of tokens.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Fixed allow-list, as patterns of whole runs.
ALLOWED = [r"[A-Za-z]+", r"[A-Z]?[a-z]*([-_./=+]+[A-Z]?[a-z]*)*", r"[A-Za-z]+([-_./][A-Za-z]+)*[-_./]*[0-9.]{0,8}", r".*(?i:example|sample|dummy|placeholder|changeme|xxxx).*",
           r".*(0123456789|abcdefghij|ABCDEFGHIJ).*", r"[0-9.+/=_-]+"]
#: Fixed pattern of filler, as in the allow-list, and of parts between separators.
FILLER = r"(?i:example|sample|dummy|placeholder|changeme|xxxx)|0123456789|abcdefghij|ABCDEFGHIJ"
PART = r"[A-Za-z0-9]+"


def minus(start: Column, end: Column, blocks: Column) -> Column:
    """Array of (start, end): what the sorted ``blocks`` (start, end) leave of a span."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def piece(at: Column, to: Column) -> Column:
        return F.when(at < to, F.array(F.struct(at.alias("start"), to.alias("end")))).otherwise(none)

    def step(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.concat(a["out"], piece(a["at"], F.least(b["start"], end))).alias("out"))
    return F.aggregate(blocks, F.struct(start.alias("at"), none.alias("out")), step, lambda a: F.concat(a["out"], piece(a["at"], end)))


def placed(found: Column, offset: Column) -> Column:
    return F.transform(found, lambda m: F.struct((m["start"] + offset).alias("start"), (m["start"] + offset + F.length(m["value"])).alias("end")))


def pieces(m: Column, start: Column, end: Column, blocks: Column) -> Column:
    """Array of (value, start) of the run ``m``: what ``blocks`` leave of a span of it, without separators at the edges."""
    def trimmed(s: Column) -> Column:
        value = F.substring(m["value"], s["start"] - m["start"] + 1, s["end"] - s["start"])
        return F.struct(F.regexp_replace(value, r"^[-+/_.=]+|[-+/_.=]+$", "").alias("value"),
                        (s["start"] + F.length(F.regexp_extract(value, r"^[-+/_.=]*", 0))).alias("start"))
    return F.transform(minus(start, end, blocks), trimmed)


def entropy_spans(value: Column, start: Column, window: int, bits: tuple[float, float, float]) -> Column:
    """Array of (start, end) where sliding windows over ``value`` reach the threshold of its character class."""
    threshold = (F.when(value.rlike(r"^[0-9a-fA-F]+$"), F.lit(bits[0])).when(value.rlike(r"^[A-Za-z0-9]+$"), F.lit(bits[1])).otherwise(F.lit(bits[2])))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def mass(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def code(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(value, at + 1, F.lit(1))) - 1

    def step(a: Column, i: Column) -> Column:
        def counted(codes: Column) -> Column:
            enters, leaves = codes["a"], codes["b"]
            n_in = F.get(a["n"], enters)
            n_out = F.when(leaves >= 0, F.get(a["n"], leaves) + F.when(enters == leaves, 1).otherwise(0))
            s = a["s"] - mass(n_in) + mass(n_in + 1)
            s = F.when(leaves >= 0, s - mass(n_out) + mass(n_out - 1)).otherwise(s)
            n = F.transform(a["n"], lambda v, k: v + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
            return F.struct(n.alias("n"), s.alias("s"))

        def judged(now: Column) -> Column:
            high = (i >= window - 1) & (F.lit(float(window)) * (F.log2(F.lit(float(window))) - threshold) >= now["s"])
            joins = high & (a["end"] >= i - window + 1)
            closes = high & ~joins & (a["end"] > 0)
            return F.struct(now["n"].alias("n"), now["s"].alias("s"),
                            F.when(high & ~joins, i - window + 1).otherwise(a["from"]).alias("from"),
                            F.when(high, i + 1).otherwise(a["end"]).alias("end"),
                            F.when(closes, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["end"].alias("end"))))).otherwise(a["out"]).alias("out"))

        codes = F.struct(code(i).alias("a"), F.when(i >= window, code(i - window)).otherwise(F.lit(-1)).alias("b"))
        return let(let(codes, counted), judged)

    begin = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("from"), F.lit(0).alias("end"), none.alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), begin, step)
    ends = let(walked, lambda a: F.when(a["end"] > 0, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["end"].alias("end"))))).otherwise(none))
    return F.transform(ends, lambda s: F.struct((s["start"] + start).alias("start"), (s["end"] + start).alias("end")))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                                                 (m["start"] + F.length(m["value"])).alias("end")))


def scanned(text: Column, run: int, window: int, bits: tuple[float, float, float]) -> Column:
    """Sorted array of (start, rank, end): rank is the kind's place in KINDS."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 12)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["value"]) >= 18)
    known = F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(matches(text, HEX), "hex"))
    allowed = "^(" + "|".join(ALLOWED) + ")$"
    named = "^(" + "|".join(p for p in ALLOWED if not p.startswith(".*")) + ")$"

    def without_filler(m: Column) -> Column:
        parts = F.filter(matches(m["value"], PART), lambda p: p["value"].rlike(FILLER))
        return F.when(m["value"].rlike(FILLER), pieces(m, m["start"], m["start"] + F.length(m["value"]), placed(parts, m["start"]))).otherwise(F.array(m))
    runs = F.filter(matches(text, "[A-Za-z0-9+/_.=-]{%d,}" % run), lambda m: ~m["value"].rlike(named))
    tokens = F.filter(F.flatten(F.transform(runs, without_filler)), lambda m: (F.length(m["value"]) >= run) & ~m["value"].rlike(allowed))

    def both(base: Column) -> Column:
        def touches(s: Column) -> Column:
            return F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

        def beyond(m: Column, s: Column) -> Column:
            parts = F.filter(placed(matches(m["value"], PART), m["start"]), touches)
            blocks = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), parts))
            rest = F.filter(pieces(m, s["start"], s["end"], blocks), lambda v: (v["value"] != "") & ~v["value"].rlike(allowed))
            return placed(rest, F.lit(0))

        def fresh(m: Column) -> Column:
            return F.flatten(F.transform(entropy_spans(m["value"], m["start"], window, bits), lambda s: F.when(touches(s), beyond(m, s)).otherwise(F.array(s))))
        high = F.flatten(F.transform(tokens, fresh))
        return F.sort_array(F.concat(base, F.transform(high, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end")))))
    return let(known, both)


SETTINGS = {"run": 20, "window": 20, "bits": (2.9, 3.5, 3.7)}


def scan(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, spans): spans is a sorted array of (start, end, kind)."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select("doc_id", scanned(F.col("_t"), **(SETTINGS | settings)).alias("spans"))
    kinds = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["rank"]).alias("kind"))).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", **settings) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, and n_chars (if there is one) brought up to date."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    found = docs.select(row, F.col("text").alias("_t")).select("_row", "_t", scanned(F.coalesce("_t", F.lit("")), **(SETTINGS | settings)).alias("_s"))
    spans = F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("value")))
    new = found.select("_row", F.size("_s").alias("_n"), replaced(F.col("_t"), spans).alias("_t"))
    out = []
    for c, kind in docs.dtypes:
        old = F.col("_row").getField(c)
        changed = F.col("_t") if c == "text" else F.when(F.col("_n") > 0, F.length("_t").cast(kind)).otherwise(old) if c == "n_chars" else old
        out.append(changed.alias(c))
    return new.select(*out)
