"""The kernel's stages as relational operators: tokens, units and text as rows, with joins and windows only.

For analysis and verification of single stages; a whole transliteration is cheaper in the kernel, which needs no shuffle.  Latin and Indic sources
are covered; Tamil and the mixed ``indic`` source carry state across words and need the kernel.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from lipika.functions import alphabets as A, kernel, options as O
from lipika.sources import catalog


def piece_pattern(source: str) -> str:
    """A pattern that cuts a text into spellings (the longest first), verbatim parts and single characters, in Java and RE2 alike."""
    keys = sorted(kernel.reader(source).spellings, key=lambda k: (-len(k), k))
    quoted = (re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", k) for k in keys)
    return "(?s)" + "|".join(quoted) + "|<[^>]*>|##(?:[^#]|#[^#])*##|<.*|##.*|."


def spelling_pattern(source: str) -> str:
    """``piece_pattern`` as a tree of characters for Java: the same pieces, found without trying every spelling at every place."""
    return f"(?s){kernel.longest_of(kernel.reader(source).spellings)}|<[^>]*+>|##(?:[^#]++|#[^#])*+##|<.*|##.*|."


def token_rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, pos, class, idx, literal): tokens in order; literals are verbatim parts or single characters."""
    spark = df.sparkSession
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if kernel.reader(source).fold else F.col(text)
    pieces = df.select(F.col(key), F.col(text).alias("whole"), F.posexplode(F.regexp_extract_all(folded, F.lit(spelling_pattern(source)), F.lit(0))).alias("at", "piece"))
    if kernel.reader(source).fold:  # verbatim pieces keep their case
        past = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("at"))
        pieces = pieces.withColumn("spelled", F.substring("whole", (past - F.length("piece") + 1).cast("int"), F.length("piece")))
    else:
        pieces = pieces.withColumn("spelled", F.col("piece"))
    known = catalog.spellings(spark, source).drop("kind")
    tag = F.col("piece").startswith("<") & F.col("piece").endswith(">")
    verbatim = F.col("piece").startswith("##") & F.col("piece").endswith("##") & (F.length("piece") > 3)
    lost = ~tag & ~verbatim & (F.col("piece").startswith("<") | F.col("piece").startswith("##"))
    literal = F.when(verbatim, F.substring("spelled", F.lit(3), F.length("piece") - 4)).otherwise(F.col("spelled"))
    rows = pieces.join(F.broadcast(known), pieces["piece"] == known["spelling"], "left").where(F.col("class").isNotNull() | ~lost)
    return rows.select(
        key,
        (F.col("at") * 8 + F.coalesce("sub", F.lit(0))).alias("pos"),
        F.coalesce("class", F.lit("literal")).alias("class"),
        "idx",
        F.when(F.col("class").isNull(), literal).alias("literal"),
    )


def unit_rows(tokens: DataFrame, key: str, source: str) -> DataFrame:
    """(key, pos, class, idx, mark, sign, accent, literal): units from ``token_rows``; an empty literal ends a text."""
    end = F.min(F.when(F.col("literal") == "", F.col("pos"))).over(Window.partitionBy(key))
    tokens = tokens.withColumn("end", end).where(F.col("end").isNull() | (F.col("pos") < F.col("end"))).drop("end")
    latin = kernel.reader(source).kind == A.LATIN
    joining = ("vowel", "mark", "other", "accent") if latin else ("mark", "other", "accent")
    order = Window.partitionBy(key).orderBy("pos")
    grouped = tokens.withColumn("grp", F.sum(F.when(F.col("class").isin(*joining), 0).otherwise(1)).over(order))
    within = Window.partitionBy(key, "grp").orderBy("pos")
    counted = "vowel" if latin else "mark"
    rows = (
        grouped.withColumn("head", F.first("class").over(within))
        .withColumn("headed", F.col("grp") > 0)
        .withColumn("n", F.sum(F.when(F.col("class") == counted, 1).otherwise(0)).over(within))
        .withColumn("first", F.row_number().over(within) == 1)
    )
    if latin:
        joins = F.col("headed") & (F.col("head") == "consonant") & ~F.col("first") & (F.col("n") <= 1)
    else:
        joins = F.col("headed") & ~F.col("first") & ((F.col("head") == "consonant") | (F.col("head") == "vowel") & (F.col("n") == 0))
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slot = lambda *c: F.max_by("idx", F.when(F.col("joins") & F.col("class").isin(*c), F.col("pos"))).over(whole)
    rows = rows.withColumn("joins", joins).withColumns({"mark": slot("mark", "vowel"), "sign": slot("other"), "accent": slot("accent")})
    joined = rows.where(~F.col("joins"))
    head = F.col("first") & F.col("headed")
    mark = F.when(head & (F.col("class") == "consonant"), F.when(F.col("mark").isNull(), 0).otherwise(F.when(F.col("mark") != 0, F.col("mark")))) if latin else F.when(head, F.col("mark"))
    return joined.select(key, "pos", "class", "idx", mark.alias("mark"), F.when(head, F.col("sign")).alias("sign"), F.when(head, F.col("accent")).alias("accent"), "literal")


def render_rows(units: DataFrame, key: str, target: str, mask: int = 0) -> DataFrame:
    """(key, transliterated): text from ``unit_rows``, for Indic and Latin targets."""
    writer = kernel.writer(target, mask)
    table = {(A.CLASSES[c], i): g for c, row in enumerate(writer.glyphs) for i, g in enumerate(row[:-1])}
    maps = {c: F.create_map(*[F.lit(x) for (k, i), g in table.items() if k == c for x in (i, g)]) for c in A.CLASSES if any(k == c for k, _ in table)}

    def glyph(cls: str, i) -> F.Column:
        return F.coalesce(F.try_element_at(maps[cls], i), F.lit("")) if cls in maps else F.lit("")

    lead = F.lit("")
    for cls in maps:
        lead = F.when(F.col("class") == cls, glyph(cls, F.col("idx"))).otherwise(lead)
    accent = F.lit("") if writer.mask & O.IGNORE_ACCENTS else glyph("accent", F.col("accent"))
    if writer.kind == A.LATIN:
        mark = F.when(F.col("class") == "consonant", F.when(F.col("mark").isNull(), glyph("vowel", F.lit(0))).when(F.col("mark") == 0, "").otherwise(glyph("mark", F.col("mark")))).otherwise("")
        sign = glyph("other", F.col("sign"))
        if not writer.raw[A.OTHER][1]:
            follow = F.lead(F.when(F.col("class") == "literal", 99).when((F.col("class") == "exclusive") & (F.col("idx") == A.SKIP), 99).otherwise(F.col("idx"))).over(
                Window.partitionBy(key).orderBy("pos")
            )
            nasal = F.when(follow < 24, (F.floor(follow / 5) * 5 + 4).cast("int")).otherwise(24)
            sign = F.when(F.col("sign") == 1, glyph("consonant", nasal)).otherwise(sign)
        text = F.concat(lead, mark, accent, sign)
    else:
        text = F.concat(lead, glyph("mark", F.col("mark")), glyph("other", F.col("sign")), accent)
    literal = F.col("literal") if writer.mask & O.RETAIN_MARKERS else F.translate("literal", A.MARKERS, "")
    skip = (F.col("class") == "exclusive") & (F.col("idx") == A.SKIP)
    out = F.when(F.col("class") == "literal", literal).when(skip, "").otherwise(text)
    pieces = units.select(key, "pos", out.alias("s")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("all"))
    return pieces.select(key, F.array_join(F.transform("all", lambda x: x["s"]), "").alias("transliterated"))
