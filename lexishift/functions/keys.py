"""Collation keys and scalar functions over text rules, as Spark expressions and as SQL text.

A profile is a set of rules: replacements made first (contractions, expansions) and one ``translate`` a level.
Comparing keys as bytes gives the profile's total order: all first-level weights, then the second level, then
the third, then (where a profile has such characters) the places of characters that the first three ignore, then the string itself. Nulls stay null. Every expression here is code-generated and foldable, so
``key(lit(x))`` becomes a constant.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Accented Latin-1 letters and the letters they are variants of.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy"
FOLD = (UP + ACCENTED, LOW + PLAIN)
SWAP = (LOW + UP, UP + LOW)
CH = ""


@dataclass(frozen=True)
class Profile:
    """``pre`` pairs are replaced in order, then each level translates (a shorter target deletes characters). Characters of ``small`` count for nothing
    on these levels; on a fourth they are compared with their places, every other character being ``OTHER`` there."""

    name: str
    levels: tuple[tuple[str, str], ...]
    pre: tuple[tuple[str, str], ...] = field(default=())
    small: str = ""


#: Names of the levels, and what stands for the other characters on the fourth: it sorts after all of them.
LEVELS, OTHER = ("letter", "accent", "case", "smaller"), "\uffee"


_accents = (UP, LOW)
PROFILES = {
    p.name: p
    for p in (
        Profile("vw_old", ((FOLD[0] + "wW", FOLD[1].replace("w", "v") + "vv"), _accents, SWAP)),
        Profile("vw_new", (FOLD, _accents, SWAP)),
        Profile("ch_old", (FOLD, _accents, SWAP)),
        Profile("ch_new", (FOLD, _accents, SWAP), (("ch", "c" + CH), ("Ch", "C" + CH), ("CH", "C" + CH))),
        Profile("tail_old", ((FOLD[0] + "q", FOLD[1] + "￮"), _accents, SWAP)),
        Profile("tail_new", (FOLD, _accents, SWAP)),
        Profile("ae", (FOLD, _accents, SWAP), (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))),
        Profile("hyphen", ((FOLD[0] + "e", FOLD[1]), _accents, SWAP)),
        Profile("small", (FOLD, _accents, SWAP), small="hH"),
        Profile("same", (FOLD, _accents, SWAP)),
        Profile("bytes", ()),
    )
}


def _pairs(p: Profile) -> list[tuple[str, str]]:
    out = []
    for src, dst in p.levels:
        last = {c: (dst[i] if i < len(dst) else "") for i, c in enumerate(src)} | dict.fromkeys(p.small, "")  # a later rule for a character replaces an earlier one
        keep = [c for c in last if last[c]]
        out.append(("".join(keep) + "".join(c for c in last if not last[c]), "".join(last[c] for c in keep)))
    return out


def levels(col: Column, p: Profile) -> list[Column]:
    for a, b in p.pre:
        col = F.replace(col, F.lit(a), F.lit(b))
    small = [F.regexp_replace(col, _others(p), OTHER)] if p.small else []
    return [F.translate(col, a, b) for a, b in _pairs(p)] + small


def _others(p: Profile) -> str:
    return "[^" + "".join("\\" + c if c in "\\]^-[" else c for c in p.small) + "]"


def key(col: Column, p: Profile) -> Column:
    """the key of a string under a profile; null for null."""
    return F.when(col.isNotNull(), F.concat_ws("\x01", *levels(col, p), col))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def levels_sql(expr: str, p: Profile) -> list[str]:
    for a, b in p.pre:
        expr = f"replace({expr}, {quoted(a)}, {quoted(b)})"
    small = [f"regexp_replace({expr}, {quoted(_others(p))}, {quoted(OTHER)}, 'g')"] if p.small else []
    return [f"translate({expr}, {quoted(a)}, {quoted(b)})" for a, b in _pairs(p)] + small


def key_sql(expr: str, p: Profile) -> str:
    return "(" + " || chr(1) || ".join([*levels_sql(expr, p), expr]) + ")"


def sign(a: Column, b: Column, p: Profile) -> Column:
    """<, > or =, the order of two strings."""
    return F.when(key(a, p) < key(b, p), "<").when(key(a, p) > key(b, p), ">").otherwise("=")


def elements(col: Column, contractions: tuple[str, ...] = ("ch", "ll")) -> Column:
    """collating elements, longest contraction first."""
    return F.regexp_extract_all(col, F.lit("(?s)" + "|".join([*sorted(contractions, key=lambda c: (-len(c), c)), "."])), F.lit(0))


def bucket_expr(col: Column, bound: str, p: Profile) -> Column:
    """early below the bound, late from it on."""
    return F.when(key(col, p) < key(F.lit(bound), p), "early").otherwise("late")


def locale_source(name: Column) -> Column:
    """F8: the name without its codeset (first dot up to @ or the end)."""
    return F.regexp_replace(name, r"^([^.]*)[.][^@]*", "$1")


def normalize_codeset(name: Column) -> Column:
    """letters and digits in lower case, ``iso`` before digits alone."""
    bare = F.lower(F.regexp_replace(F.regexp_extract(name, r"^[^.]*[.]([^@]*)", 1), "[^A-Za-z0-9]", ""))
    return F.when(bare.rlike("^[0-9]+$"), F.concat(F.lit("iso"), bare)).otherwise(bare)


def normal_name(name: Column) -> Column:
    """A locale name with its codeset as F9 writes it, language and modifier kept; names without a codeset stay."""
    return F.when(name.rlike("^[^@.]*[.]"), F.concat(F.regexp_extract(name, "^[^@.]*", 0), F.lit("."), normalize_codeset(name), F.regexp_extract(name, "@.*$", 0))).otherwise(name)


def is_c_like(locale: Column) -> Column:
    """F16: the locales whose order is that of bytes."""
    return F.when(locale.isin("C", "POSIX") | locale.rlike("^[Cc][.]"), "byte order").otherwise("exposed")


def string_name(text: Column) -> Column:
    """``U+0057`` for one character, four digits at least; ``bytes F0 AB`` for several."""
    h = F.hex(F.ascii(text))
    one = F.concat(F.lit("U+"), F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h))
    return F.when(F.length(text) == 1, one).otherwise(F.concat(F.lit("bytes "), F.rtrim(F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", "$1 "))))


def parse_string_name(name: Column) -> Column:
    """the string that ``U+XXXX`` or ``bytes XX XX`` names."""
    one = F.decode(F.unhex(F.lpad(F.regexp_extract(name, "^U[+]([0-9A-F]+)$", 1), 8, "0")), "utf-32")
    return F.when(name.startswith("bytes "), F.decode(F.unhex(F.replace(F.substring(name, 7, 2**31 - 1), F.lit(" "), F.lit(""))), "utf-8")).otherwise(one)


def decode_hex(h: Column, encoding: str) -> Column:
    """hexadecimal bytes to text; encodings that Spark knows (utf-8, utf-16, utf-32, iso-8859-1, us-ascii)."""
    return F.decode(F.unhex(h), encoding)


# Encodings of a server, what each is to it, and the codesets that mean it.
ENCODING_TABLE = """
EUC_JP multibyte EUC-JP eucJP IBM-eucJP sdeckanji CP20932
EUC_CN multibyte EUC-CN eucCN IBM-eucCN GB2312 dechanzi CP20936
EUC_KR multibyte EUC-KR eucKR IBM-eucKR deckorean 5601 CP51949
EUC_TW multibyte EUC-TW eucTW IBM-eucTW cns11643
UTF8 multibyte UTF-8 utf8 CP65001
LATIN1 single ISO-8859-1 ISO8859-1 iso88591 CP28591
LATIN2 single ISO-8859-2 ISO8859-2 iso88592 CP28592
LATIN3 single ISO-8859-3 ISO8859-3 iso88593 CP28593
LATIN4 single ISO-8859-4 ISO8859-4 iso88594 CP28594
LATIN5 single ISO-8859-9 ISO8859-9 iso88599 CP28599
LATIN6 single ISO-8859-10 ISO8859-10 iso885910
LATIN7 single ISO-8859-13 ISO8859-13 iso885913
LATIN8 single ISO-8859-14 ISO8859-14 iso885914
LATIN9 single ISO-8859-15 ISO8859-15 iso885915 CP28605
LATIN10 single ISO-8859-16 ISO8859-16 iso885916
KOI8R single KOI8-R CP20866
KOI8U single KOI8-U CP21866
WIN866 single CP866
WIN874 single CP874
WIN1250 single CP1250
WIN1251 single CP1251 ansi-1251
WIN1252 single CP1252
WIN1253 single CP1253
WIN1254 single CP1254
WIN1255 single CP1255
WIN1256 single CP1256
WIN1257 single CP1257
WIN1258 single CP1258
ISO_8859_5 single ISO-8859-5 ISO8859-5 iso88595 CP28595
ISO_8859_6 single ISO-8859-6 ISO8859-6 iso88596 CP28596
ISO_8859_7 single ISO-8859-7 ISO8859-7 iso88597 CP28597
ISO_8859_8 single ISO-8859-8 ISO8859-8 iso88598 CP28598
SQL_ASCII single US-ASCII
- client SJIS PCK CP932 SHIFT_JIS BIG5 BIG5HKSCS Big5-HKSCS CP950 GBK CP936 UHC CP949 JOHAB CP1361 GB18030 CP54936 SJIS_2004
"""
CODESETS = [(c, None if e == "-" else e, {"single": "single byte", "client": "client only"}.get(k, k)) for e, k, *names in map(str.split, ENCODING_TABLE.strip().splitlines()) for c in names]


def server_encoding(df: DataFrame, codeset: str) -> DataFrame:
    """``df`` with encoding and class of a codeset, whatever its case; no encoding and ``unknown`` for others. The mapping is a small table."""
    known = df.sparkSession.createDataFrame([(c.upper(), e, k) for c, e, k in {c.upper(): (c, e, k) for c, e, k in CODESETS}.values()], "_c string, encoding string, class string")
    return df.join(F.broadcast(known), F.upper(codeset) == F.col("_c"), "left").drop("_c").withColumn("class", F.coalesce("class", F.lit("unknown")))


def case_map(col: Column, lower: str, upper: str, to: str) -> Column:
    """``col`` in lower, upper or initial capital case under a side's one-to-one pairs."""
    if to == "initcap":
        return F.concat(F.translate(F.substring(col, 1, 1), lower, upper), F.translate(F.substring(col, 2, 2**31 - 1), upper, lower))
    return F.translate(col, upper, lower) if to == "lower" else F.translate(col, lower, upper)
