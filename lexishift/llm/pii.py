r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Only built-in Spark expressions over one row: nothing shuffles and no Python runs on the executors.

Base kinds (found leftmost, without overlap within a kind): ``email``, ``ip`` (parts up to 255), ``card``
(14 to 19 digits, Luhn) and ``phone`` (10 to 15 digits). The method adds ``iban`` (its country's length, else 15 to 34; mod-97) and
``ssn`` (a three-two-four digit number, which needs a context word nearby). Each span has a score: the kind's
own confidence, plus a bonus where one of its context words stands in the 40 code points before it. Base
spans stay whatever their score is; spans of the added kinds stay from ``threshold`` on.

Patterns are written so that one scan is linear: a run of characters is entered at its start only (or
where the last match ended, ``\G``), and quantifiers are possessive where the next character decides anyway.

Defined results: a null text counts as empty (no spans); a null ``doc_id`` stays null; repeated rows give
repeated results; an empty table gives an empty result; other columns are kept, but for one named ``_spans`` by
:func:`find_spans`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexishift.llm.quality import let
from lexishift.llm.storage import carried, restored


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheaper pattern without which there is no match
    check: object
    score: float
    context: str
    base: bool = True


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    doubled = lambda d: F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
    figures = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(figures, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The account number without spaces leaves 1 when divided by 97, first four characters moved to the end."""
    compact = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _small_parts(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _count_between(x: Column, low: int, high: int) -> Column:
    n = F.length(digits_of(x))
    return (n >= low) & (n <= high)


# Countries of each IBAN length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A number of its country's length, whatever follows it after a blank.
IBAN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
# The kinds in the order that spans of one start take.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda x: F.lit(True), 0.9, "mail|contact|write|courriel|correo"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _small_parts, 0.6, "ip|host|server|address|adresse"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){13}", lambda x: F.when(_count_between(x, 14, 19), luhn(digits_of(x))).otherwise(F.lit(False)), 0.8, "card|credit|visa|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda x: _count_between(x, 10, 15), 0.6, "phone|tel|call|mobile|fax|anruf"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{IBAN})\x20?+[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))", r"[A-Z]{2}[0-9]{2}", mod97, 0.8, "iban|account|konto|compte|cuenta", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda x: ~x.rlike("^(?:000|666|9..)|-00-|-0000$"), 0.3, "ssn|social|security", base=False),
)
BONUS, THRESHOLD, NEAR, CHUNK = 0.35, 0.5, 40, 128


def running_starts(gaps: Column, found: Column) -> Column:
    """Where each match starts, from the lengths of the pieces between matches and of the matches.

    Sums run within chunks and then over chunks, so appending stays cheap in texts with very many matches.
    """
    steps = F.transform(found, lambda x, i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(x).cast("long").alias("own")))

    def chunked(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda c: F.slice(s, c * CHUNK + 1, F.lit(CHUNK)))
        empty, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
        local = F.transform(
            chunks, lambda c: F.aggregate(c, F.struct(zero.alias("pos"), empty.alias("at")), lambda a, x: F.struct((a["pos"] + x["gap"] + x["own"]).alias("pos"), F.array_append(a["at"], a["pos"] + x["gap"]).alias("at")))
        )
        whole = F.aggregate(
            local,
            F.struct(zero.alias("pos"), F.array().cast("array<array<bigint>>").alias("at")),
            lambda a, c: F.struct((a["pos"] + c["pos"]).alias("pos"), F.array_append(a["at"], F.transform(c["at"], lambda s: s + a["pos"])).alias("at")),
        )
        return F.flatten(whole["at"])

    return let(steps, chunked)


def before(gaps: Column, found: Column, i: Column) -> Column:
    """The ``NEAR`` code points before match ``i``, from the last pieces: a match has two or more, so ``NEAR // 2`` of them do."""
    low = F.greatest(i - NEAR // 2, F.lit(0))
    cut = lambda x: F.right(x, F.lit(NEAR))
    pieces = F.zip_with(F.slice(gaps, low + 1, i - low), F.slice(found, low + 1, i - low), lambda g, x: F.concat(cut(g), cut(x)))
    return cut(F.concat(F.array_join(pieces, ""), cut(F.get(gaps, i))))


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,score:double>>"


def spans_of(text: Column, kind: Kind, rank: int, threshold: float = THRESHOLD) -> Column:
    """All confirmed spans of one kind in ``text``: start, rank, end (code points, end exclusive), kind, base, score."""

    def build(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def rows(starts: Column) -> Column:
                near = lambda i: F.lower(before(gaps, found, i)).rlike(rf"(?:{kind.context})")
                score = lambda i: F.lit(kind.score) + F.when(near(i), BONUS).otherwise(0.0)
                every = F.transform(
                    found,
                    lambda x, i: F.struct(
                        F.get(starts, i).alias("start"), F.lit(rank).alias("rank"), (F.get(starts, i) + F.length(x)).alias("end"), F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"),
                        F.when(kind.check(x), score(i)).otherwise(F.lit(-1.0)).alias("score"),
                    ),
                )
                return F.filter(every, lambda s: s["score"] >= (0.0 if kind.base else threshold))

            return let(running_starts(gaps, found), rows)

        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), with_gaps)).otherwise(F.array().cast(SPAN))

    found = F.when(text.rlike(kind.hint), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(found, build)


def find_spans(docs: DataFrame, text: str = "text", kinds=KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``_spans``: all spans by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*[spans_of(t, k, i, threshold) for i, k in enumerate(kinds)])
    return docs.withColumn("_spans", F.array_sort(every))


def _replacement(t: Column, kind: Kind, threshold: float):
    def build(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            near = lambda k: F.lower(before(gaps, found, k)).rlike(rf"(?:{kind.context})")
            scored = lambda k: F.lit(True) if kind.base else F.lit(kind.score) + F.when(near(k), BONUS).otherwise(0.0) >= threshold
            put = F.transform(found, lambda x, k: F.concat(F.get(gaps, k), F.when(kind.check(x) & scored(k), F.lit(f"[{kind.name.upper()}]")).otherwise(x)))
            return F.concat(F.array_join(put, ""), F.element_at(gaps, -1))

        return F.when(F.size(found) > 0, let(F.split(t, kind.pattern, -1), with_gaps)).otherwise(t)

    return build


def redact(docs: DataFrame, text: str = "text", kinds=KINDS, threshold: float = THRESHOLD, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with each confirmed span of ``text`` replaced by its kind in brackets; ``n_chars``, where there is one, counted anew.

    Kinds go in order, each over the text that the kinds before it have left; pieces and replacements are
    zipped and joined, so the work is linear in the text.
    """
    out = carried(docs, text=text)
    for kind in kinds:
        t = F.col("text")
        found = F.when(t.rlike(kind.hint), F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn("text", F.when(t.isNotNull(), let(found, _replacement(t, kind, threshold))))
    return restored(out, docs, **{text: F.col("text"), n_chars: F.length("text")})


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_spans(docs).select("doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("_spans")).alias("spans"))
