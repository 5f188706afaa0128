"""Visually identical text with different characters (problem 8).

A text is cut into positioned pieces: every code point that could change, and the ones before it,
stand alone; stretches of code points that stay as they are under every rule are one piece. The
pieces are joined with a broadcast table of decompositions and look-alikes (bounded by the code
space of Unicode, whatever the data), combining marks are put in the order of their classes,
clusters are recomposed, and the text is rebuilt. All of it runs in built-in operators.

To find the pieces, active code points are first exchanged for private ones that lie side by side,
so that one range tells them. Texts that hold such private code points themselves are cut into
single code points instead.

The form is one for comparisons: letters that look like Latin ones become Latin letters.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.session import checkpoint

# Letters of other scripts that look like a Latin letter, written as pairs.
LOOK_ALIKES = (
    # Cyrillic
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl ӕæ әə "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW ѴV ӀI ԌG ҮY үy ӔÆ ӘƏ "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp υu ϲc ϳj ϹC ͿJ "
    # Armenian
    "օo հh ոn սu ցg զq յj ՕO ՍU ՏS ԼL "
    # Cherokee
    "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏚS ᏞL ᏟC ᏢP ᏦK ᏙV ᏴB "
    # Coptic
    "ⲀA ⲂB ⲈE ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX ⲭx "
    # Lisu
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    # small Latin letter of the phonetic alphabet; hiragana that look like katakana
    "ɡg へヘ"
)
# Characters that show nothing (ranges of code points, both ends included).
SHOW_NOTHING = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202C), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE001F), (0xE0100, 0xE01EF),
)
# Joined letter forms and blanks whose compatibility decomposition looks the same.
SAME_LOOK = (
    (0x00B5, 0x00B5), (0x0132, 0x0133), (0x0149, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0587, 0x0587),
    (0x2000, 0x200A), (0x205F, 0x205F), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB4F, 0xFB4F),
)
#: compatibility decompositions of these kinds differ in width, joining or breaking alone
SAME_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: stands for a joiner inside an emoji while the other joiners are removed; no character of any text
KEPT_JOINER = "\ufdd0"
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _within(c: int, ranges: tuple) -> bool:
    return any(a <= c <= b for a, b in ranges)


def _attaches(ch: str) -> bool:
    """Whether a code point continues the cluster before it."""
    c = ord(ch)
    return unicodedata.combining(ch) > 0 or _V <= c < _V + 21 or _T < c < _T + 28


@cache
def _decomposed(ch: str) -> str:
    """Full decomposition with look-alikes replaced; Hangul syllables stay whole."""
    c = ord(ch)
    if ch == KEPT_JOINER:
        return "\u200d"
    if _within(c, SHOW_NOTHING):
        return ""
    alike = look_alikes()
    if ch in alike:
        return alike[ch]
    rule = unicodedata.decomposition(ch).split()
    if not rule or _S <= c < _S + 11172:
        return ch
    if rule[0].startswith("<"):
        if rule[0] not in SAME_KINDS and not (rule[0] == "<compat>" and _within(c, SAME_LOOK)):
            return ch
        rule = rule[1:]
    return "".join(_decomposed(chr(int(x, 16))) for x in rule)


@cache
def look_alikes() -> dict[str, str]:
    return {pair[0]: pair[1] for pair in LOOK_ALIKES.split()}


@cache
def tables() -> tuple[list, list, dict, int]:
    """Active code points (ch, parts, alone, joins), those that attach first; others that decompose; pairs by mark; how many attach.

    Active is what does not stay as it is when it stands alone, or attaches to what precedes it.
    ``alone`` is what becomes of it where nothing attaches to it.
    """
    rows, others, pairs = [], [], {}
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or _S <= c < _S + 11172:
            continue
        ch = chr(c)
        parts = _decomposed(ch)
        rule = unicodedata.decomposition(ch)
        if rule and not rule.startswith("<") and unicodedata.normalize("NFC", ch) == ch and len(rule.split()) == 2:
            first, second = (chr(int(x, 16)) for x in rule.split())
            if _decomposed(first) == first or len(unicodedata.normalize("NFD", first)) > 1:
                pairs.setdefault(second, {})[first] = ch
        alone = unicodedata.normalize("NFC", parts)
        if _attaches(ch) or parts != ch:
            joins = _attaches(parts[0]) if parts else False
            row = (ch, [(x, unicodedata.combining(x), _attaches(x)) for x in parts], alone, joins)
            (rows if _attaches(ch) or alone != ch else others).append(row)
    rows.sort(key=lambda r: (not r[3], r[0]))
    assert len(rows) <= _LAST - _FIRST
    return rows, others, pairs, sum(r[3] for r in rows)


#: the private code points that stand for active ones, and their range in a pattern
_FIRST, _LAST = 0xF0000, 0xF1FFF
_PRIVATE = rf"\x{{{_FIRST:X}}}-\x{{{_LAST:X}}}"
#: before single code points of a text that holds private ones itself
_RAW = "="


def _composed(cluster: Column, pairs: Column) -> Column:
    """Compose the sorted parts (ccc, n, ch) of a cluster, which begins with its starter."""
    start = F.struct(F.get(cluster, F.lit(0))["ch"].alias("head"), F.lit("").alias("tail"), F.get(cluster, F.lit(0))["ccc"].alias("last"))

    def add(state: Column, part: Column) -> Column:
        a, b = F.ascii(state["head"]), F.ascii(part["ch"])
        hangul = (
            F.when(a.between(_L, _L + 18) & b.between(_V, _V + 20), F.lit(_S) + ((a - _L) * 21 + (b - _V)) * 28)
            .when(a.between(_S, _S + 11171) & ((a - _S) % 28 == 0) & b.between(_T + 1, _T + 27), a + (b - _T))
        )
        syllable = F.decode(F.unhex(F.lpad(F.hex(hangul), 4, "0")), "UTF-16BE")
        free = (state["tail"] == "") | (state["last"] < part["ccc"])
        made = F.when(free, F.coalesce(F.when((part["ccc"] == 0) & (state["tail"] == ""), syllable), F.try_element_at(F.try_element_at(pairs, part["ch"]), state["head"])))
        return F.struct(
            F.coalesce(made, state["head"]).alias("head"),
            F.when(made.isNull(), F.concat(state["tail"], part["ch"])).otherwise(state["tail"]).alias("tail"),
            F.when(made.isNull(), part["ccc"]).otherwise(state["last"]).alias("last"),
        )

    return F.aggregate(F.slice(cluster, 2, 1_000_000_000), start, add, lambda s: F.concat(s["head"], s["tail"]))


def consistent_forms(texts: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """``(*keys, form)``: the consistent form of every text; ``keys`` must be unique.

    A null text has a null form, an empty one or one of characters that show nothing an empty form. Case,
    words, digits, punctuation, raised and circled digits, emoji, other accents and the number of blanks are
    kept. Texts without an active character are their own form and are not taken apart.
    """
    spark = texts.sparkSession
    rows, others, pairs, attaching = tables()
    table = [(chr(_FIRST + n), *r[1:]) for n, r in enumerate(rows)] + others + [(_RAW + r[0], *r[1:]) for r in rows + others]
    kind = "ch string, parts array<struct<ch:string,ccc:int,joins:boolean>>, alone string, joins boolean"
    known = F.broadcast(spark.createDataFrame(table, kind))
    mates = F.from_json(F.lit(json.dumps(pairs)), "map<string,map<string,string>>")
    emoji = r"\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}"
    text = F.col("text")
    kept = F.when(text.contains("\u200d"), F.regexp_replace("text", rf"([{emoji}])\x{{200D}}(?=[{emoji}])", "$1" + KEPT_JOINER)).otherwise(text)
    coded = F.translate(kept, "".join(r[0] for r in rows), "".join(chr(_FIRST + n) for n in range(len(rows))))
    wide = F.octet_length("text") > F.length("text")  # no character of one byte is active
    given = texts.select(*keys, text.alias("text"))
    touched = F.coalesce(wide & (coded != text), F.lit(False)) | F.coalesce(wide & text.rlike(f"[{_PRIVATE}]"), F.lit(False))
    raw = text.rlike(f"[{_PRIVATE}]")
    active = given.where(touched).select(*keys, raw.alias("raw"), kept.alias("kept"), coded.alias("coded"))
    single = F.transform(F.split("kept", ""), lambda x: F.concat(F.lit(_RAW), x))
    cut = F.regexp_extract_all("coded", F.lit(f"(?s)[^{_PRIVATE}]+(?![{_PRIVATE}])|."), F.lit(0))
    attached = F.col("raw") | F.col("coded").rlike(rf"[\x{{{_FIRST:X}}}-\x{{{_FIRST + attaching - 1:X}}}]")

    def pieces(of: Column) -> DataFrame:
        out = active.where(of).select(*keys, "raw", F.posexplode(F.when(F.col("raw"), single).otherwise(cut)).alias("pos", "ch")).join(known, "ch", "left")
        return out.withColumn("ch", F.when(F.col("raw"), F.expr("substring(ch, 2)")).otherwise(F.col("ch")))

    def rebuilt(parts: DataFrame, order: str) -> DataFrame:
        return parts.groupBy(*keys).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, "ch"))), lambda x: x["ch"])).alias("form"))

    simple = rebuilt(pieces(~attached).select(*keys, "pos", F.coalesce("alone", "ch").alias("ch")), "pos")
    parts = (
        pieces(attached)
        .select(*keys, "pos", F.posexplode(F.coalesce("parts", F.array(F.struct("ch", F.lit(0).alias("ccc"), F.lit(False).alias("joins"))))).alias("sub", "part"))
        .select(*keys, "pos", "sub", "part.ch", "part.ccc", "part.joins")
    )
    w = Window.partitionBy(*keys).orderBy("pos", "sub")
    # a run of marks is ordered by class between starters: jamo and marks of class 0 are starters for the order
    parts = (
        parts.withColumn("cluster", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w))
        .withColumn("n", F.row_number().over(w))
        .withColumn("turn", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(w))
    )
    one = F.size("parts") == 1
    clusters = (
        parts.groupBy(*keys, "cluster")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "ccc", "n", "ch"))).alias("parts"))
        .select(*keys, "cluster", F.when(one, F.get("parts", F.lit(0))["ch"]).otherwise(_composed(F.col("parts"), mates)).alias("ch"))
    )
    made = simple.unionByName(rebuilt(clusters, "cluster"))
    # a text of characters that show nothing alone leaves no piece with a part
    return (
        given.where(~touched).select(*keys, text.alias("form"))
        .unionByName(active.select(*keys).join(made, keys, "left").select(*keys, F.coalesce("form", F.lit("")).alias("form")))
    )


def distinct_forms(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``(k1, k2, form)`` of every different text; the keys are two 64-bit hashes of the text."""
    keyed = df.select(F.col(text_column).alias("text")).where("text is not null").select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    return consistent_forms(keyed.groupBy("k1", "k2").agg(F.min("text").alias("text")), ["k1", "k2"])


def look_same_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``: documents whose texts differ in characters and have one form, ``doc_a < doc_b``.

    Rows with a null id or text are in no pair; an id repeated with another text counts with both; other columns
    are ignored; an empty table gives no rows. Different texts of one form are paired first, and their documents
    joined to those pairs, so copies of one text are never compared with each other.
    """
    docs = df.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")).where("doc is not null and text is not null")
    docs = docs.select("doc", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    forms = checkpoint(distinct_forms(df, text_column).select("k1", "k2", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2")))
    shared = forms.groupBy("f1", "f2").count().where("count > 1").select("f1", "f2")
    several = forms.join(shared, ["f1", "f2"])
    one = several.select("f1", "f2", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    two = several.select("f1", "f2", F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    pairs = one.join(two, ["f1", "f2"]).where("struct(a1, a2) < struct(b1, b2)").drop("f1", "f2")
    left = docs.select(F.col("doc").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    right = docs.select(F.col("doc").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    found = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"])
    return found.where("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
